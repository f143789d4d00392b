"""Choice of a model for a request, and what became of its answer."""

from __future__ import annotations

import bisect

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from siltstone.functions.core import let
from siltstone.functions.text import token_estimate

from .lookups import small

# Words in the names and tags of models that do not write prose.
CODING, OTHER_MEDIA = r"\b(?:code|coder|coding)\b", "image|text-to-image|diffusion|tts|speech|audio|whisper|rerank|embed"
#: Models that a catalogue may have where all that fit are listed; it travels as one array.
MAX_MODELS = 20_000


def _catalogue(models: DataFrame) -> Column:
    """The models as an array, the best first: a scalar subquery."""
    if models.limit(MAX_MODELS + 1).count() > MAX_MODELS:
        raise ValueError(f"a catalogue has at most {MAX_MODELS} models")
    static = F.when(F.col("local"), 0.45).otherwise(0.0) + F.when(F.col("free"), 0.0).otherwise(0.25) + F.col("cost_weight")
    order = F.struct((F.col("rank") + F.col("demotion")).alias("a"), F.col("demotion").alias("b"), static.alias("c"), F.lower("m_model").alias("d"), F.col("m_model").alias("e"))
    listed = F.array_sort(F.collect_list(F.struct(order.alias("order"), F.struct(*models.columns).alias("m"))))
    return models.agg(F.transform(listed, lambda x: x["m"]).alias("m")).scalar()


def _fits(m: Column) -> Column:
    """Whether a model may serve the request of the row."""
    reserve = F.coalesce(F.least("reserve", m["max_output"]), m["max_output"])
    return F.coalesce(
        (F.col("provider").isNull() | (m["m_provider"] == F.col("provider")))
        & (F.col("model").isNull() | (m["m_model"] == F.col("model")))
        & ~F.coalesce(F.array_contains("exclude", m["m_model"]), F.lit(False))
        & (~F.coalesce("local_only", F.lit(False)) | m["local"])
        & ((F.col("task") != "extract") | m["supports_json"])
        & (m["context"] >= F.col("input_tokens") + reserve),
        F.lit(False),
    )


def fitting(requests: DataFrame, models: DataFrame) -> DataFrame:
    """Requests and the models that may serve them, one row for each that fits.

    requests: request_id, task, input_tokens, provider, model, exclude (array), local_only, reserve;
    models: m_provider, m_model, local, free, supports_json, context, max_output, rank, cost_weight, demotion.
    The catalogue is one array of at most ``MAX_MODELS``, filtered in place for every request: no pairs are formed.
    """
    found = requests.withColumn("__models", _catalogue(models)).withColumn("__m", F.explode(F.filter("__models", _fits)))
    return found.select(*requests.columns, "__m.*")


#: A stair of a class: with room for this many tokens or fewer, these models are the best, in order.
_BEST = "struct<order: struct<a: double, b: double, c: double, d: string, e: string>, provider: string, model: string>"
_STAIRS = f"class string, kind int, stairs array<struct<least: bigint, best: array<{_BEST}>>>"


def _stairs(keep: int):
    """The stairs of one class: models come by room, the largest first, and a stair begins where the ``keep`` best ones change."""

    kind = to_arrow_type(T.StructType.fromDDL(_STAIRS)["stairs"].dataType)

    def build(group: pa.Table) -> pa.Table:
        found = group.sort_by([("room", "descending")]).to_pylist()
        best: list[tuple] = []
        stairs: list[dict] = []
        for row in found:
            order = row["best"]["order"]
            entry = (tuple((v is not None, v) for v in order.values()), row["best"]["provider"] or "", row["best"]["model"], row["best"])
            at = bisect.bisect_left(best, entry[:3], key=lambda e: e[:3])
            if at >= keep:
                continue
            best.insert(at, entry)
            del best[keep:]
            if not stairs or stairs[-1]["least"] != row["room"]:
                stairs.append({"least": row["room"]})
            stairs[-1]["best"] = [e[3] for e in best]
        return pa.table({"class": group["class"][:1], "kind": group["kind"][:1], "stairs": pa.array([stairs], kind)})

    return build


def _at(stairs: Column, need: Column) -> Column:
    """The best models with room for ``need``, found by halving: along the stairs the room falls."""
    start = F.struct(F.lit(0).alias("low"), F.coalesce(F.size(stairs), F.lit(0)).alias("high"))

    def halve(s: Column, _: Column) -> Column:
        middle = F.floor((s["low"] + s["high"]) / 2).cast("int")
        enough = lambda m: F.coalesce(F.get(stairs, m)["least"] >= need, F.lit(False))
        after = lambda m: F.when(enough(m), F.struct((m + 1).alias("low"), s["high"].alias("high"))).otherwise(F.struct(s["low"].alias("low"), m.alias("high")))
        return F.when(s["low"] < s["high"], let(middle, after)).otherwise(s)

    return let(F.aggregate(F.sequence(F.lit(1), F.lit(32)), start, halve), lambda s: F.when(s["low"] > 0, F.get(stairs, s["low"] - 1)["best"]))


def _class(provider: Column, model: Column, json: Column, local: Column) -> Column:
    """What requests and models must have in common, as text; a null provider or model is an open one."""
    return F.to_json(F.struct(provider.alias("p"), model.alias("m"), json.alias("j"), local.alias("l")))


def choose(requests: DataFrame, models: DataFrame) -> DataFrame:
    """One row per request: the chosen provider and model, or ``none`` and why.

    A model has room for a request if its context holds the input and the smaller of reserve and longest output; that is, if its context less its output holds the
    input, or its context the input and the reserve. So a request asks twice for the best model with room for so many tokens, in its class (provider, model, JSON and
    local, each given or open). A class answers with stairs, found by halving: a request costs a logarithm of the catalogue's size, whatever that is, and no pairs
    are formed. Stairs keep as many models as the longest list of exclusions can remove, and one. Models without a name are not chosen.
    """
    static = F.when(F.col("local"), 0.45).otherwise(0.0) + F.when(F.col("free"), 0.0).otherwise(0.25) + F.col("cost_weight")
    order = F.struct(
        (F.col("rank") + F.col("demotion")).cast("double").alias("a"), F.col("demotion").cast("double").alias("b"), static.cast("double").alias("c"), F.lower("m_model").alias("d"), F.col("m_model").alias("e")
    )
    named = models.where("m_model is not null")
    ranked = named.select("*", F.struct(order.alias("order"), F.col("m_provider").alias("provider"), F.col("m_model").alias("model")).alias("best"))
    none, yes = F.lit(None).cast("string"), lambda c: F.coalesce(F.col(c), F.lit(False))
    classes = [
        F.when((yes("supports_json") if j else F.lit(True)) & (yes("local") if l else F.lit(True)), _class(p, m, F.lit(j), F.lit(l)))
        for p in (F.col("m_provider"), none) for m in (F.col("m_model"), none) for j in (False, True) for l in (False, True)
    ]
    rooms = [F.struct(F.lit(k).alias("kind"), room.cast("long").alias("room")) for k, room in enumerate((F.col("context") - F.col("max_output"), F.col("context")))]
    entered = ranked.withColumn("class", F.explode(F.array_compact(F.array_distinct(F.array(*classes))))).withColumn("r", F.explode(F.array(*rooms)))
    entered = entered.select("class", "r.kind", "r.room", "best").where("room is not null")
    # two numbers: names that a request excludes, and models of one name
    excluded = requests.agg(F.max(F.size(F.array_distinct(F.coalesce("exclude", F.array().cast("array<string>")))))).first()[0] or 0
    alike = named.groupBy("m_model").count().agg(F.max("count")).first()[0]
    stairs = entered.groupBy("class", "kind").applyInArrow(_stairs(excluded * (alike or 1) + 1), _STAIRS)
    two = stairs.groupBy("class").agg(*[F.max(F.when(F.col("kind") == k, F.col("stairs"))).alias(f"__s{k}") for k in (0, 1)])
    wanted = requests.withColumn("class", _class(F.col("provider"), F.col("model"), F.coalesce(F.col("task") == "extract", F.lit(True)), F.coalesce("local_only", F.lit(False))))
    found = wanted.join(small(two), "class", "left")
    needs = (F.col("input_tokens"), F.col("input_tokens") + F.col("reserve"))
    allowed = lambda best: F.get(F.filter(best, lambda m: ~F.coalesce(F.array_contains("exclude", m["model"]), F.lit(False))), F.lit(0))
    best = F.array_min(F.array_compact(F.array(*[allowed(_at(F.col(f"__s{k}"), need)) for k, need in enumerate(needs)])))
    why = (
        F.when(F.lit(models.isEmpty()), "unconfigured")
        .when(F.coalesce("local_only", F.lit(False)), "sensitive_content_no_local_provider")
        .when(F.col("provider").isNotNull(), "provider_unconfigured")
        .when(F.col("model").isNotNull(), "model_unavailable")
        .otherwise("no_model_fit")
    )
    return found.withColumn("__best", best).select(
        *requests.columns, F.coalesce("__best.provider", F.lit("none")).alias("chosen_provider"), F.col("__best.model").alias("chosen_model"), F.when(F.col("__best").isNull(), why).alias("reason")
    )


def is_free_text_model(price: Column, model: Column, takes: Column, gives: Column) -> Column:
    """Whether a listed model is free and writes prose from text: no coding, image, sound, ranking or embedding model."""
    tags = F.lower(F.concat_ws(" ", F.coalesce(model, F.lit("")), F.coalesce(gives, F.lit(""))))
    other = tags.rlike(CODING) | tags.rlike(OTHER_MEDIA)
    return F.coalesce(price == "0", F.lit(False)) & F.coalesce(takes, F.lit("text")).contains("text") & ~other


COMPLETION = (
    "struct<model: string, choices: array<struct<message: struct<content: string>, finish_reason: string, error: struct<message: string>>>, "
    "error: struct<message: string, code: string>, usage: struct<prompt_tokens: bigint, completion_tokens: bigint, cost: string>>"
)
CHAT = "struct<model: string, message: struct<content: string>, done_reason: string, prompt_eval_count: bigint, eval_count: bigint>"


def completion(body: Column) -> Column:
    """struct(text, truncated, in_tokens, out_tokens, cost, error) of a provider's answer, in either of two shapes.

    An answer without text is an error: what the provider says, else that the completion is empty and why it ended.
    """
    a, b = F.from_json(body, COMPLETION), F.from_json(body, CHAT)
    choice = F.get(a["choices"], F.lit(0))
    said = F.coalesce(*[F.nullif(F.trim(m), F.lit("")) for m in (a["error"]["message"], choice["error"]["message"])])
    ended = F.coalesce(choice["finish_reason"], b["done_reason"])
    text = F.nullif(F.coalesce(choice["message"]["content"], b["message"]["content"]), F.lit(""))
    empty = F.concat(F.lit("empty completion"), F.coalesce(F.when(~ended.isin("stop"), F.concat(F.lit(" (finish_reason="), ended, F.lit(")"))), F.lit("")))
    error = F.when(said.isNotNull(), F.concat_ws(": ", F.coalesce(a["error"]["code"], choice["finish_reason"], F.lit("error")), said)).when(text.isNull(), empty)
    return F.struct(
        F.when(error.isNull(), text).alias("text"), F.coalesce(ended == "length", F.lit(False)).alias("truncated"),
        F.coalesce(a["usage"]["prompt_tokens"], b["prompt_eval_count"]).alias("in_tokens"),
        F.coalesce(a["usage"]["completion_tokens"], b["eval_count"]).alias("out_tokens"),
        a["usage"]["cost"].try_cast("double").alias("cost"), error.alias("error"),
    )


def unfenced(c: Column) -> Column:
    """A text without the one Markdown fence around it."""
    inner = F.regexp_extract(c, r"(?s)^\s*```[A-Za-z0-9]*\s*\n?(.*?)\n?\s*```\s*$", 1)
    return F.trim(F.when(c.rlike(r"(?s)^\s*```.*```\s*$"), inner).otherwise(c))


def answer_outcome(text: Column, wants_json: Column) -> Column:
    """success, soft (no JSON where it was asked for) or hard_fail (empty)."""
    blank = F.trim(F.coalesce(text, F.lit(""))) == ""
    return F.when(blank, "hard_fail").when(wants_json & F.try_parse_json(unfenced(text)).isNull(), "soft").otherwise("success")


def prompt(content: Column, title: Column, description: Column, json_ld: Column) -> Column:
    """What a model is shown: title, description, body and structured data, those that exist."""
    return F.concat_ws("\n\n", F.concat(F.lit("Title: "), title), F.concat(F.lit("Description: "), description), content, F.concat(F.lit("Structured data:\n"), json_ld))


def fenced(content: Column, nonce: Column) -> Column:
    """Untrusted text between marks that it cannot hold, since the nonce is made after it."""
    mark = lambda word: F.concat(F.lit(f"<<<{word} "), nonce, F.lit(">>>"))
    return F.concat_ws("\n", mark("CONTENT"), content, mark("END"))


def request_text(task: Column, prompt_: Column, schema: Column, budget: Column, content: Column, nonce: Column) -> Column:
    """The user's message to a model: the request, what shape to answer in, and the fenced text."""
    limit = F.coalesce(F.concat(F.lit(" Use at most "), budget.cast("string"), F.lit(" tokens.")), F.lit(""))
    shape = F.when(task == "extract", F.concat(F.lit("\nAnswer with JSON only"), F.coalesce(F.concat(F.lit(" that meets this schema: "), schema), F.lit("")), F.lit("."))).otherwise("")
    return F.concat(F.lit("Request: "), prompt_, limit, shape, F.lit("\n\n"), fenced(content, nonce))


def finalised(text: Column, wants_json: Column, json_schema, reported: Column) -> Column:
    """struct(result, outcome, issue, out_tokens) of a model's answer: trimmed text, or JSON that meets a schema.

    No JSON, and a schema that cannot be checked, are hard failures; JSON that does not meet its schema is kept, with the first
    failure as its issue.
    """
    from .schema import outcome as checked

    plain = F.trim(F.coalesce(text, F.lit("")))
    inner = unfenced(plain)
    parsed = F.try_parse_json(inner)
    check = checked(inner, json_schema)
    hard = wants_json & (parsed.isNull() | check["unsupported"])
    result = F.when(hard, None).when(wants_json, F.to_json(parsed)).otherwise(plain)
    return F.struct(
        result.alias("result"), F.when(hard | (~wants_json & (plain == "")), "hard_fail").when(wants_json & ~check["valid"], "soft").otherwise("success").alias("outcome"),
        F.when(wants_json & parsed.isNull(), "extract_invalid_json").when(wants_json, check["message"]).alias("issue"),
        F.coalesce(reported, token_estimate(F.coalesce(result, F.lit("")))).alias("out_tokens"),
    )
