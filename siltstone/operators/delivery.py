"""Delivery shapes of records: lean JSON, text with a header, bulk text and JSON under length caps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions import classify, urls
from siltstone.functions.text import SEED_SNIPPET, SNIPPET, clip, printable, rtrim

# What follows the length of a result that was cut.
SNIPPET_NOTE = " characters total — snippeted in this lean payload; the full text is delivered in the tool result's content[0].text (the canonical MCP content channel).]"
TEXT_CAP, JSON_CAP = 50_000, 25_000
COMPACT_URL, COMPACT_FAILURES = 100, 30


def lean_json(*columns: Column | str) -> Column:
    """The given columns as a JSON object without its null fields."""
    return F.to_json(F.struct(*columns))


def field(c: Column) -> Column:
    """A value inside a comment: printable, JSON-escaped, without ``--``."""
    quoted = F.to_json(F.struct(printable(c).alias("v")))
    return F.replace(F.regexp_extract(quoted, r'(?s)^\{"v":"(.*)"\}$', 1), F.lit("--"), F.lit("\\u002d\\u002d"))


def text_payload(final_url: Column, tier: Column, code: Column, body: Column, is_json: Column, cut: Column | None = None) -> Column:
    """A provenance comment and the body; a JSON body stands alone, unless it was cut off."""
    head = F.concat(F.lit("<!-- source: "), field(final_url), F.lit(" tier: "), tier, F.lit(" code: "), code.cast("string"), F.lit(" -->"))
    return F.when(is_json if cut is None else is_json & ~cut, body).otherwise(F.concat_ws("\n\n", head, body))


def debug_lines(attempts: Column) -> Column:
    """One line per attempt (step, outcome, status, reason); those over 50 are cut from the middle."""
    line = lambda a: F.concat_ws(" ", a["step"], a["outcome"], a["status"].cast("string"), a["reason"])
    from .batches import first_and_last

    return F.array_join(first_and_last(F.transform(attempts, line)), "\n")


def snippet(c: Column) -> Column:
    """The start of a long result, with a note of its length."""
    note = F.concat(F.lit("\n\n[… "), F.length(c).cast("string"), F.lit(SNIPPET_NOTE))
    return F.when(F.length(c) <= SNIPPET, c).otherwise(F.concat(rtrim(F.substring(c, 1, SNIPPET)), note))


def record_payload(rows: DataFrame, output: str = "raw", debug: bool = False, version: str = "1") -> Column:
    """The JSON payload of records as ``extract.records`` makes them: fixed keys in a fixed order, null ones left out, credentials in addresses redacted.

    A failed record's error rows are its errors, all others are warnings. ``debug`` adds attempts, redirects, structured data and hashes.
    """
    has = lambda name: F.col(name) if name in rows.columns else F.lit(None).cast("string")
    tier, code = F.col("tier"), F.col("status")
    where = F.struct(tier.alias("tier"), F.col("resolved_via").alias("resolvedVia"), code.alias("code"), F.col("bytes").alias("bytes"))
    more = []
    if debug:
        linked = F.struct(F.col("json_ld").alias("jsonLd"), F.col("meta").alias("meta"), F.col("state_keys").alias("stateKeys"))
        more = [has("attempts").alias("attempts"), F.col("redirects").alias("redirects"), F.col("content_type").alias("httpContentType"), linked.alias("structured"), F.col("content_sha256").alias("contentSha256"), F.col("provenance_hash").alias("provenanceHash")]
    return lean_json(
        F.lit(version).alias("schemaVersion"), (F.col("record_status") != "fail").alias("ok"), F.col("record_status").alias("status"), urls.redact_query(F.col("url")).alias("url"),
        urls.redact_query(F.col("final_url")).alias("finalUrl"), F.col("title").alias("title"), F.lit(output).alias("output"), F.col("content_kind").alias("contentType"), snippet(F.col("result")).alias("result"),
        tier.alias("tier"), code.alias("code"), F.col("code_text").alias("codeText"), F.col("bytes").alias("bytes"), F.col("resolved_via").alias("resolvedVia"), has("platform").alias("platform"),
        F.col("gate.js_required").alias("jsRequired"), F.col("access").alias("access"), F.col("quality").alias("contentQuality"), where.alias("provenance"),
        classify.warnings(tier, F.col("errors")).alias("warnings"), F.col("images").alias("images"), classify.fatal_errors(tier, F.col("errors")).alias("errors"), *more,
    )


def debug_block(rows: DataFrame) -> Column:
    """How a record came about, as text: its verdicts, its attempts, its transform (struct provider, model, reason, in_tokens, out_tokens) and the hash of its content."""
    shown = lambda name: F.coalesce((F.col(name) if name in rows.columns else F.lit(None)).cast("string"), F.lit("0"))
    first = F.concat(
        F.lit("tier: "), F.col("tier"), F.lit("  resolvedVia: "), F.coalesce("resolved_via", F.lit("")), F.lit("  status: "), shown("status"), F.lit("  bytes: "), shown("bytes"), F.lit("  durationMs: "), shown("duration_ms"),
        F.lit("  jsRequired: "), F.coalesce(F.col("gate.js_required"), F.lit(False)).cast("string"),
    )
    t = lambda name: F.col(f"transform.{name}").cast("string")
    part = lambda before, c, after="": F.coalesce(F.concat(F.lit(before), c, F.lit(after)), F.lit(""))
    made = F.concat(F.lit("transform: "), t("provider"), part(" ", t("model")), part(" (", t("reason"), ")"), part(" in=", t("in_tokens")), part(" out=", t("out_tokens"))) if "transform" in rows.columns else F.lit(None).cast("string")
    attempts = F.nullif(debug_lines(F.col("attempts")), F.lit("")) if "attempts" in rows.columns else F.lit(None).cast("string")
    return F.concat_ws("\n", F.lit("--- debug ---"), first, attempts, made, F.concat(F.lit("contentSha256: "), F.col("content_sha256")))


def action_label(a: Column) -> Column:
    return F.concat_ws(":", a["type"], a["reason"], a["method"], a["resource"], a["url"])


#: Characters that a section or a JSON row has at least: its frame.
LEAST_SECTION = 10


def _first(rows: DataFrame, batch: str, most: int) -> DataFrame:
    """The first rows of every batch by ``ord``; the limit is applied before the shuffle."""
    return rows.withColumn("__rank", F.row_number().over(Window.partitionBy(batch).orderBy("ord"))).where(F.col("__rank") <= most).drop("__rank")


def bulk_text(rows: DataFrame, batch: str, fence: Column, cap: int = TEXT_CAP) -> DataFrame:
    """(batch, text, form): sections of a batch's rows (ord, url, status, body) in order: full, else slim, else cut.

    Lengths are summed first; then only the sections that the cap can show are put together, in the chosen form, so
    a batch of any size is a bounded text.
    """
    section = lambda body: F.concat(F.lit("== "), fence, F.lit(" "), F.col("url"), F.lit(" ["), F.col("status"), F.lit("]\n"), body)
    made = rows.select(batch, "ord", section(F.col("body")).alias("full"), section(clip(F.col("body"), SEED_SNIPPET)).alias("slim"))
    whole = lambda c: F.sum(F.length(c)) + 2 * (F.count("*") - 1)
    form = F.when(whole("full") <= cap, "full").when(whole("slim") <= cap, "slim").otherwise("cut")
    forms = made.groupBy(F.col(batch).alias("__batch")).agg(form.alias("form"))
    shown = _first(made, batch, cap // LEAST_SECTION + 1).join(forms, F.col(batch).eqNullSafe(F.col("__batch")))
    part = F.struct("ord", F.when(F.col("form") == "full", F.col("full")).otherwise(F.col("slim")).alias("t"))
    listed = shown.groupBy(batch, "form").agg(F.array_sort(F.collect_list(part)).alias("s"))
    return listed.select(batch, F.substring(F.array_join(F.transform("s", lambda x: x["t"]), "\n\n"), 1, cap).alias("text"), "form")


def bulk_json(rows: DataFrame, batch: str, cap: int = JSON_CAP) -> DataFrame:
    """(batch, json, form): a batch's rows as JSON: full, else lean (without bodies), else compact (a count and the first failures
    with clipped addresses), else bare (a count).

    Lengths are summed first, so only what the cap can show is put together.
    """
    made = rows.select(
        batch, "ord", "status", F.to_json(F.struct("ord", "url", "status", "code", "body")).alias("full"), F.to_json(F.struct("ord", "url", "status", "code")).alias("lean"),
        F.to_json(F.struct("ord", clip(F.col("url"), COMPACT_URL).alias("url"), "status")).alias("compact"),
    )
    frame = len('{"results":[]}')
    whole = lambda c: F.sum(F.length(c)) + F.count("*") - 1 + frame
    form = F.when(whole("full") <= cap, "full").when(whole("lean") <= cap, "lean").otherwise("compact")
    forms = made.groupBy(F.col(batch).alias("__batch")).agg(form.alias("form"), F.count("*").alias("n"))
    fails = _first(made.where("status = 'fail'"), batch, COMPACT_FAILURES)
    own = F.col(batch).eqNullSafe(F.col("__batch"))
    few = forms.where("form = 'compact'").join(fails, own, "left").groupBy("__batch", "n").agg(
        F.array_sort(F.collect_list(F.when(F.col("compact").isNotNull(), F.struct("ord", F.col("compact").alias("t"))))).alias("s")
    )
    text = lambda s: F.array_join(F.transform(s, lambda x: x["t"]), ",")
    counted = lambda inner: F.concat(F.lit('{"count":'), F.col("n").cast("string"), F.lit(',"failures":['), inner, F.lit("]}"))
    short = few.select(F.col("__batch").alias(batch), counted(text("s")).alias("c"), counted(F.lit("")).alias("bare")).select(
        batch, F.when(F.length("c") <= cap, F.col("c")).otherwise(F.col("bare")).alias("json"), F.when(F.length("c") <= cap, "compact").otherwise("bare").alias("form")
    )
    shown = _first(made, batch, cap // LEAST_SECTION + 1).join(forms.where("form != 'compact'"), own)
    part = F.struct("ord", F.when(F.col("form") == "full", F.col("full")).otherwise(F.col("lean")).alias("t"))
    long = shown.groupBy(batch, "form").agg(F.array_sort(F.collect_list(part)).alias("s"))
    return long.select(batch, F.concat(F.lit('{"results":['), text("s"), F.lit("]}")).alias("json"), "form").unionByName(short)
