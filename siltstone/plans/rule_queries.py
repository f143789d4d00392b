"""Rules over requests, responses, structured data and answers: rows are built from table columns, and read back by the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import classify, html, markup, nodes, text, urls
from siltstone.operators import batches, boards, delivery, folds, lookups, models, policy, schema, shaping

from .tables import spread, table



def _events(spark: SparkSession, sf_dir: str, read=table) -> DataFrame:
    """Events with a few numbers to build rows from: k (of props), i (id), u (user), v (cents)."""
    k = F.get_json_object("props", "$.k").cast("long")
    return read(spark, sf_dir, "events").select("event_id", "event_type", k.alias("k"), F.col("event_id").alias("i"), F.col("user_id").alias("u"), F.floor(F.col("value") * 100).cast("long").alias("v"))


_E = "e AS (SELECT event_id, event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k, event_id AS i, user_id AS u, CAST(floor(value * 100) AS BIGINT) AS v FROM events)"


def _text(*parts) -> F.Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def status_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = (100 + F.pmod("v", F.lit(500))).cast("int")
    return _events(spark, sf_dir).select("event_id", text.status_text(status).alias("code_text"), text.is_redirect(status).alias("redirect"))


def response_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers in three spellings, waits in seconds, charsets."""
    name = F.element_at(F.array(F.lit("Retry-After"), F.lit("retry-after"), F.lit("RETRY-AFTER")), (F.pmod("i", F.lit(3)) + 1).cast("int"))
    headers = F.map_from_arrays(F.array(name, F.lit("Content-Type")), F.array(F.array((F.col("k") * 7 - 50).cast("string"), F.lit("x")), F.array(_text("text/html; charset=", F.col("event_type")))))
    status = F.element_at(F.array(F.lit(200), F.lit(429), F.lit(503)), (F.pmod("u", F.lit(3)) + 1).cast("int"))
    return _events(spark, sf_dir).select(
        "event_id", text.header(headers, "retry-after").alias("wait"), text.header(headers, "absent").alias("absent"), text.charset(text.header(headers, "content-type")).alias("charset"),
        text.retry_after(text.header(headers, "Retry-After"), status, F.lit("2024-01-01").cast("timestamp")).alias("wait_ms"),
    )


def forward_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's own POSTs: method, kind, domain, declared and real sizes and header vary with the columns."""
    e = _events(spark, sf_dir)
    domain = F.when(F.pmod("u", F.lit(4)) != 0, _text("d", F.pmod("u", F.lit(2)), ".example"))
    main = _text("d", F.pmod("k", F.lit(2)), ".example")
    kind = F.when(F.pmod("i", F.lit(5)) == 0, "document").when(F.pmod("i", F.lit(2)) == 0, "xhr").otherwise("fetch")
    body = F.when(F.col("k") != 13, F.repeat(F.lit("x"), F.pmod("v", F.lit(120)).cast("int")).cast("binary"))
    header = F.when(F.pmod("v", F.lit(7)) == 0, F.lit("text/plain\r\nx: y")).when(F.pmod("v", F.lit(11)) == 0, F.repeat(F.lit("t"), 257)).otherwise("application/json")
    method = F.when(F.col("event_type") == "error", "GET").otherwise("POST")
    plan = policy.forward_plan(method, kind, domain, main, F.when(F.pmod("i", F.lit(3)) == 0, (F.col("k") * 2).cast("string")), body, header, 100)
    pre = policy.preflight_plan(kind, domain, main)
    return e.select("event_id", plan["plan"].alias("plan"), plan["reason"].alias("reason"), pre["plan"].alias("preflight"), policy.same_domain(domain, main).alias("same"))


def blocked_resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subresources of four hosts: trackers, first parties, heavy kinds and an address that cannot be read."""
    host = F.element_at(F.array(F.lit("cdn.hotjar.com"), F.lit("static.shop.example"), F.lit("hotjar.com.evil.example"), F.lit("")), (F.pmod("v", F.lit(4)) + 1).cast("int"))
    url = F.when(host == "", _text("no address ", F.col("i"))).otherwise(F.concat(F.lit("https://"), host, F.lit("/"), F.col("i").cast("string")))
    kind = F.element_at(F.array(*[F.lit(x) for x in ("script", "image", "font", "xhr", "media")]), (F.pmod("k", F.lit(5)) + 1).cast("int"))
    main = F.when(F.pmod("u", F.lit(3)) == 0, "hotjar.com").otherwise("shop.example")
    return _events(spark, sf_dir).select("event_id", policy.is_blocked(url, kind, main).alias("blocked"), policy.wants_second_read(F.lit("body_read_error"), F.pmod("k", F.lit(3)), F.pmod("u", F.lit(2)) == 0).alias("second_read"))


def oversized_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.oversized(_events(spark, sf_dir), "u", 60)


def render_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).select("event_id", policy.render_units(F.col("v") * 1_000 + 1).alias("units"))


def longest_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three longest texts of each source, ties by id."""
    few = batches.longest_few(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), "source", "text", "doc_id")
    return few.select("source", F.col("rank").cast("long").alias("rank"), "doc_id", F.length("text").cast("long").alias("n"))


def longest_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = batches.longest_of(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), "source", "text", "doc_id")
    return found.select("source", F.sha2(F.col("text").cast("binary"), 256).alias("text_hash"))


def customer_supplier_nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether nations of suppliers are among those of rich customers, as sets."""
    rich = table(spark, sf_dir, "customer").where("c_acctbal > 9000").select(F.col("c_nationkey").alias("n"))
    return batches.compared_sets(rich, table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("n")), "n")


def output_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    requested = F.when(F.col("event_type") == "view", "raw").when(F.col("event_type") == "click", "extract").otherwise("summary")
    failure = F.when(F.pmod("v", F.lit(9)) == 0, "extract_schema_invalid").when(F.pmod("v", F.lit(9)) == 1, "timeout")
    mode = policy.output_mode(
        requested, F.pmod("u", F.lit(13)) == 0, F.when(F.pmod("i", F.lit(10)) == 0, 404).otherwise(200), F.when(F.pmod("i", F.lit(7)) == 0, "2").otherwise("1"), F.pmod("u", F.lit(5)) != 0, failure,
        F.when(F.pmod("k", F.lit(8)) == 0, "none").otherwise("ollama"), F.repeat(F.lit("page "), 700), _text("model ", F.col("i")),
    )
    return e.select("event_id", mode["output"].alias("output"), mode["provider"].alias("provider"), mode["reason"].alias("reason"), F.length(mode["result"]).cast("long").alias("n"))


def rows_not_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeds that gave no page, by what became of them."""
    seeds = _events(spark, sf_dir).select(F.col("event_id").alias("ord"), _text("https://h/", F.col("i")).alias("url"), "event_type")
    out = None
    for kind, event in (("reject", "click"), ("abandoned", "view"), ("failed", "error"), ("aborted", "purchase")):
        part = policy.rows_not_run(seeds.where(F.col("event_type") == event), kind, F.concat(F.lit("code_"), F.col("event_type")), F.repeat(F.col("event_type"), 150))
        out = part if out is None else out.unionByName(part)
    return out.select("ord", "final_url", "status", "tier", "code_text", "resolved_via", F.length("result").cast("long").alias("n"), F.col("errors")[0]["code"].alias("error"))


def free_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as listed models."""
    name = F.concat_ws("/", "p_brand", F.element_at(F.array(*[F.lit(x) for x in ("chat", "Coder-7b", "encoder", "text-embed", "flash")]), (F.pmod("p_size", F.lit(5)) + 1).cast("int")))
    takes = F.when(F.pmod("p_partkey", F.lit(4)) == 0, "image").when(F.pmod("p_partkey", F.lit(4)) == 1, "text+image")
    price = F.when(F.pmod("p_partkey", F.lit(3)) == 0, "0.001").when(F.pmod("p_partkey", F.lit(3)) == 1, "0")
    return table(spark, sf_dir, "part").select("p_partkey", models.is_free_text_model(F.coalesce(price, F.lit("0")), name, takes, F.when(F.col("p_size") > 45, "speech")).alias("free"))


def completions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Providers' answers of two shapes, cut ones, empty ones and errors."""
    answer = _text("answer ", F.col("i"))
    reason = F.when(F.pmod("k", F.lit(4)) == 0, "length").otherwise("stop")
    content = F.when(F.pmod("v", F.lit(6)) == 0, "").otherwise(answer)
    one = F.to_json(F.struct(
        F.array(F.struct(F.struct(content.alias("content")).alias("message"), reason.alias("finish_reason"))).alias("choices"),
        F.struct(F.col("k").alias("prompt_tokens"), F.col("u").alias("completion_tokens"), (F.col("k") / 128).alias("cost")).alias("usage"),
    ))
    two = F.to_json(F.struct(F.struct(content.alias("content")).alias("message"), reason.alias("done_reason"), F.col("k").alias("prompt_eval_count"), F.col("u").alias("eval_count")))
    bad = F.to_json(F.struct(F.struct(F.lit("overloaded").alias("message"), F.lit("529").alias("code")).alias("error")))
    body = F.when(F.col("event_type") == "error", bad).when(F.pmod("i", F.lit(2)) == 0, one).otherwise(two)
    c = _events(spark, sf_dir).select("event_id", models.completion(body).alias("c"))
    return c.select("event_id", *[F.col(f"c.{n}").alias(n) for n in ("text", "truncated", "in_tokens", "out_tokens", "cost", "error")])


ANSWER = {"type": "object", "required": ["k"], "properties": {"k": {"type": "integer", "maximum": 80}}}


def finalised_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers with and without a fence, JSON or not, against a schema."""
    body = _text('{"k": ', F.col("k"), "}")
    answer = F.when(F.pmod("v", F.lit(5)) == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(F.pmod("v", F.lit(5)) == 1, "no json").when(F.pmod("v", F.lit(5)) == 2, '{"q": 1}').otherwise(body)
    made = _events(spark, sf_dir, spread).select("event_id", models.finalised(answer, F.pmod("i", F.lit(3)) != 0, ANSWER, F.lit(None).cast("long")).alias("f"))
    return made.select("event_id", "f.outcome", "f.issue", "f.result")


PERSON = {
    "type": "object", "required": ["id", "tags"], "additionalProperties": False, "minProperties": 2,
    "properties": {
        "id": {"type": "integer", "minimum": 100, "multipleOf": 2}, "name": {"type": "string", "minLength": 4, "pattern": "^[a-z]+$"},
        "tags": {"type": "array", "maxItems": 3, "uniqueItems": True, "items": {"enum": ["a", "b", "c"]}}, "score": {"anyOf": [{"type": "null"}, {"exclusiveMaximum": 50}]},
    },
}


def schema_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first way in which values built from the columns fail a schema."""
    tags = F.when(F.pmod("u", F.lit(6)) == 0, '["a","a"]').when(F.pmod("u", F.lit(6)) == 1, '["a","b","c","d"]').when(F.pmod("u", F.lit(6)) == 2, '["a","z"]').when(F.pmod("u", F.lit(6)) == 3, '"a"').otherwise('["b"]')
    extra = F.when(F.pmod("v", F.lit(10)) == 0, ',"other":1').otherwise("")
    name = F.when(F.col("event_type") == "view", "ab1").when(F.col("event_type") == "error", "LOUD").otherwise(F.col("event_type"))
    score = F.when(F.pmod("i", F.lit(4)) == 0, "null").otherwise(F.col("k").cast("string"))
    value = _text('{"id":', F.col("i"), ',"name":"', name, '","tags":', tags, ',"score":', score, extra, "}")
    made = _events(spark, sf_dir, spread).select("event_id", schema.outcome(value, PERSON).alias("o"))
    return made.select("event_id", "o.valid", "o.message")


def nested_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in pages with nested menus, nested hidden parts, classes that a style sheet hides and shows again, drawings and containers."""
    docs = table(spark, sf_dir, "documents").select("doc_id", text.collapse(F.coalesce("text", F.lit(""))).alias("t"))
    body = F.replace(F.replace(F.col("t"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    head = "<head><style>.x{display:none}.y{display:none}.y{display:block}@media print{.z{display:none}}</style><style media='print'>.z{display:none}</style></head>"
    top = '<body><nav>menu<nav>inner</nav>still menu</nav><div hidden>h<div>inner</div>still hidden</div><div class="a x">gone<b>gone</b></div>'
    main = F.concat(F.lit('<div id="content"><p class="y">'), body, F.lit("</p><svg><defs><text>no</text></defs><text>drawn</text><text display='none'>no</text></svg></div>"))
    page = F.concat(F.lit(head + top), main, F.lit("<div class=z>end</div><aside>side<aside>inner</aside>side</aside></body>"))
    found = docs.select("doc_id", markup.scope(page).alias("s"))
    return found.select("doc_id", F.col("s.kind").alias("kind"), F.sha2(F.col("s.text").cast("binary"), 256).alias("text_hash"))


def streamed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose article is a skeleton and whose text is streamed into a hidden part that a script reveals."""
    e = _events(spark, sf_dir, spread)
    text_ = F.repeat(_text("line ", F.col("k"), " of text. "), (F.pmod("u", F.lit(9)) + 1).cast("int"))
    shown = F.pmod("i", F.lit(2)) == 0
    page = F.concat(
        F.lit("<body><article>wait for it</article>"), F.when(shown, F.lit("<div hidden id='S:1'>")).otherwise(F.lit("<div hidden id='S:2'>")), F.lit("<article>"), text_,
        F.lit("</article></div><script>$RC(\"B:1\",\"S:1\")</script></body>"),
    )
    return e.select("event_id", F.trim(markup.scope(page)["text"]).alias("text"), F.array_join(html.revealed_boundaries(page), ",").alias("revealed"))


def state_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State in scripts with and without an id and in assigned globals, unsafe keys, and JSON that cannot be read."""
    e = _events(spark, sf_dir, spread)
    page = F.concat(
        F.lit('<script type="application/json" id="__NEXT_DATA__">{"k":'), F.col("k").cast("string"), F.lit('}</script><script type="application/json">[1,{"__proto__":2,"b":'), F.col("u").cast("string"),
        F.lit('}]</script><script>var x; window.__INITIAL_STATE__ = {"a":"}","n":[{"v":'), F.col("v").cast("string"), F.lit('}]}; go()</script><script type="application/ld+json">'),
        F.when(F.pmod("i", F.lit(3)) == 0, "{bad").otherwise(_text('{"@type":"Thing","n":', F.col("i"), "}")), F.lit("</script>"),
    )
    found = e.select("event_id", markup.embedded_json(page).alias("j"))
    state = lambda key: F.col("j.state")[key]
    return found.select(
        "event_id", state("__NEXT_DATA__").alias("next_data"), state("__json_script_0__").alias("unnamed"), state("__INITIAL_STATE__").alias("initial"), F.array_join("j.json_ld", "|").alias("json_ld"),
        F.array_join(F.transform("j.errors", lambda x: x["code"]), ",").alias("errors"),
    )


def _linked(value) -> F.Column:
    return F.array(value)


def linked_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content nodes at depths one to five of a chain of links: found up to the fourth level; nothing below a content node counts."""
    e = _events(spark, sf_dir, spread)
    inner = _text('{"@type":["Thing","Article"],"headline":"H', F.col("i"), '","about":{"@type":"Product","description":"below"}}')
    wrap = lambda c, link: F.concat(F.lit('{"@type":"WebPage","' + link + '":'), c, F.lit("}"))
    deep = inner
    for depth, link in ((1, "mainEntity"), (2, "@graph"), (3, "hasPart"), (4, "about")):
        deep = F.when(F.pmod("k", F.lit(5)) >= depth, wrap(deep, link)).otherwise(deep)
    texts = _linked(F.when(F.pmod("u", F.lit(2)) == 0, F.concat(F.lit("[["), deep, F.lit("]]"))).otherwise(deep))
    found = nodes.bearing(texts, F.lit(False))
    return e.select(
        "event_id", F.array_join(F.flatten(F.transform(found, lambda v: nodes.bearing_types(v, F.lit(False)))), ",").alias("types"),
        nodes.lead(found, nodes.walked(texts), F.lit("https://x/"), F.lit(True)).alias("lead"),
    )


def title_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's own title against that of its structured data."""
    raw = F.when(F.pmod("i", F.lit(3)) == 0, _text("Site | STORY ", F.col("k"))).when(F.pmod("i", F.lit(3)) == 1, "Home")
    node = F.when(F.pmod("u", F.lit(4)) == 0, '{"@type":"WebSite","name":"no"}').otherwise(_text('{"@graph":[{"@type":"Article","name":" Story ', F.col("k"), '","description":"d"}]}'))
    return _events(spark, sf_dir).select("event_id", nodes.preferred_title(raw, _linked(node)).alias("title"))


def pin_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The post that a pin's page is about, among others."""
    post = lambda n: _text('{"@type":"SocialMediaPosting","articleBody":"body ', n, '","url":"https://www.pinterest.com/pin/', n, '/"}')
    texts = _linked(F.concat(F.lit("["), post(F.col("k")), F.lit(","), post(F.col("k") + 1), F.lit("]")))
    url = F.when(F.pmod("i", F.lit(3)) == 0, _text("https://www.pinterest.com/pin/", F.col("k") + 1, "/")).when(F.pmod("i", F.lit(3)) == 1, "https://pinterest.co.uk/pin/7/").otherwise("https://example.com/pin/7/")
    return _events(spark, sf_dir).select("event_id", urls.is_pin_page(url).alias("pin_page"), urls.pin_id(url).alias("pin"), nodes.pin_caption(texts, url).alias("caption"), F.size(nodes.postings(texts)).cast("long").alias("posts"))


def lean_structures(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = _text('{"@type":"Article","articleBody":"long","n":', F.col("k"), ',"author":{"description":"gone"},"list":[{"description":"x"},{"b":', F.col("u"), "}]}")
    return _events(spark, sf_dir, spread).select("event_id", markup.lean_structure(F.when(F.pmod("i", F.lit(5)) == 0, '{"description":"all"}').otherwise(data)).alias("lean"))


def bot_walls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses with headers, cookies and bodies of challenges."""
    server = F.element_at(F.array(F.lit("cloudflare"), F.lit("nginx"), F.lit("AkamaiGHost")), (F.pmod("u", F.lit(3)) + 1).cast("int"))
    keys = F.array(F.lit("Server"), F.lit("CF-Mitigated"))
    headers = F.map_from_arrays(keys, F.array(F.array(server), F.array(F.when(F.pmod("v", F.lit(5)) == 0, "challenge").otherwise(""))))
    body = F.when(F.pmod("k", F.lit(4)) == 0, "<script src=/cdn-cgi/challenge-platform/x></script>").when(F.pmod("k", F.lit(4)) == 1, "Checking your browser").when(F.pmod("k", F.lit(4)) == 2, "x captcha-delivery y").otherwise("fine")
    signal = classify.bot_signal(classify.bot_evidence(headers, body, F.when(F.pmod("i", F.lit(2)) == 0, 503).otherwise(200)))
    return _events(spark, sf_dir).select("event_id", signal["signal"].alias("signal"), signal["provider"].alias("provider"))


def render_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    hosts = F.when(F.pmod("u", F.lit(3)) == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("h")))
    reason = classify.render_reason(F.pmod("i", F.lit(9)) != 0, F.when(F.pmod("u", F.lit(3)) == 0, 0).otherwise(F.col("v")), hosts, F.col("v") * 5, F.when(F.pmod("k", F.lit(7)) != 0, F.col("k") * 2))
    return _events(spark, sf_dir).select("event_id", reason.alias("reason"), classify.required_scope(F.when(F.col("event_type") == "view", "raw").otherwise("summary")).alias("scope"))


def error_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of a record and what counts as a warning."""
    errors = F.array(F.struct(F.lit("schema_knob_extracted").alias("code"), F.lit("").alias("message")), F.struct(F.col("event_type").alias("code"), F.lit("").alias("message")))
    tier = F.when(F.pmod("i", F.lit(2)) == 0, "error").otherwise("1")
    codes = lambda c: F.array_join(F.transform(c, lambda x: x["code"]), ",")
    return _events(spark, sf_dir).select("event_id", codes(classify.fatal_errors(tier, errors)).alias("errors"), codes(classify.warnings(tier, errors)).alias("warnings"))


def address_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IPv6 literals, local names and mapped addresses from ids."""
    forms = F.array(
        _text("fd00::", F.hex("k")), _text("2001:4860::", F.hex("k")), _text("::ffff:10.0.0.", F.pmod("k", F.lit(200))), _text("fe80::", F.hex("k")), _text("app", F.col("k"), ".localhost"),
        _text("8.8.", F.pmod("k", F.lit(200)), ".4"), F.lit("LocalHost"), _text("a", F.col("k"), ".example.com"),
    )
    a = F.element_at(forms, (F.pmod("v", F.lit(8)) + 1).cast("int"))
    return _events(spark, sf_dir).select("event_id", urls.is_private(a).alias("private"), urls.is_local_name(a).alias("local"), urls.ip_version(a).cast("long").alias("version"))


def ipv6_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reserved ranges that hold IPv6 addresses made from ids."""
    forms = F.array(_text("fd00::", F.hex("k")), _text("2001:4860::", F.hex("k")), _text("::ffff:10.0.0.", F.pmod("k", F.lit(200))), _text("fe80::", F.hex("k")), _text("[2001:db8::", F.hex("k"), "]"), F.lit("not an address"))
    rows = _events(spark, sf_dir).select("event_id", F.element_at(forms, (F.pmod("v", F.lit(6)) + 1).cast("int")).alias("a"))
    return lookups.in_ranges_v6(rows, "a", lookups.address_ranges_v6(spark)).select("event_id", "cidr")


def redacted_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys in queries and fragments: reasons, and addresses without their values."""
    url = F.element_at(F.array(
        _text("https://a.example/p?id=", F.col("k"), "&access_token=s", F.col("i")), _text("https://a.example/p#access_token=s", F.col("i")), _text("https://a.example/p?id=", F.col("k")),
        _text("https://a.example/#/r?access_token=", F.col("i")),
    ), (F.pmod("v", F.lit(4)) + 1).cast("int"))
    return _events(spark, sf_dir).select("event_id", urls.signed_reason(url).alias("query"), urls.fragment_reason(url).alias("fragment"), urls.redact_query(url, ("access_token",)).alias("shown"))


def embedded_boards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Job boards that pages embed, and the job that an address names in one."""
    page = F.element_at(F.array(
        _text('<script src="https://boards.greenhouse.io/embed/job_board/js?for=org', F.col("u"), '">'), _text("<iframe src='https://jobs.ashbyhq.com/org", F.col("u"), "/embed'>"), F.lit("<p>none</p>"),
    ), (F.pmod("v", F.lit(3)) + 1).cast("int"))
    url = F.when(F.pmod("i", F.lit(2)) == 0, _text("https://shop.example/jobs?ashby_jid=j", F.col("k"))).otherwise("https://shop.example/jobs")
    return _events(spark, sf_dir).select("event_id", html.board_embed(page)["platform"].alias("platform"), html.board_embed(page)["token"].alias("token"), html.ashby_job(url, page).alias("job"), boards.clean_token(html.board_embed(page)["token"]).alias("clean"))


def capped_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages cut at a length, before a tag or a script that the cut would leave open."""
    page = F.concat(F.repeat(F.lit("x"), F.pmod("v", F.lit(40)).cast("int")), F.lit("<b>y</b><script>var a = 1</script>"), F.repeat(F.lit("z"), F.col("k").cast("int")))
    return _events(spark, sf_dir).select("event_id", html.capped(page, 50).alias("kept"))


def tracker_free_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts without the addresses of trackers, where one address begins another."""
    from siltstone.operators.extract import tracker_free

    body = _text("see https://hotjar.com/", F.col("k"), " and https://shop.example/?u=https://hotjar.com/", F.col("k"), "9 or https://hotjar.com/", F.col("k"), "9 end")
    return _events(spark, sf_dir).select("event_id", tracker_free(body, F.when(F.pmod("i", F.lit(2)) == 0, "www.hotjar.com").otherwise("shop.example"), lookups.TRACKERS).alias("text"))


def seed_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of a batch in their classes; attempts cut from the middle; actions counted."""
    values = F.transform(F.sequence(F.lit(1), F.greatest(F.col("k"), F.lit(1)).cast("int")), lambda x: _text("a", x))
    actions = F.array(F.struct(F.lit("abort").alias("type")), F.struct(F.col("event_type").alias("type")), F.struct(F.lit("reject").alias("type")))
    cls = shaping.entry_class(F.when(F.pmod("i", F.lit(4)) == 0, "invalid_url"), F.pmod("u", F.lit(3)) == 0, F.pmod("k", F.lit(2)) == 0)
    return _events(spark, sf_dir).select(
        "event_id", cls.alias("class"), F.array_join(batches.first_and_last(values, 20), " ").alias("shown"), batches.action_count(actions, "abort", "click").alias("actions"),
    )


def client_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles of clients from a settings text, and the lookup with its default."""
    mapped = lookups.profile_map(F.concat(F.lit("u1=reader, u2 = writer ,=reader,u3=unknown,u4=reader,u1=writer,x"), F.lit("")), ["reader", "writer"])
    rows = _events(spark, sf_dir).withColumn("id", _text("u", F.pmod("u", F.lit(6))))
    profiles = spark.createDataFrame([("u0", "admin"), ("u1", "reader")], "id string, profile string")
    return lookups.with_default(rows.withColumn("mapped", F.try_element_at(mapped, F.col("id"))), "id", profiles, "profile", "guest").select("event_id", "mapped", "profile")


def render_pool_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A render's subresources in order against its two pools."""
    rows = _events(spark, sf_dir).select("event_id", "u", F.col("v").alias("size"), (F.col("event_type") == "click").alias("essential"))
    return folds.render_pools(rows, "u", ["event_id"], "size", "essential", 6_000, 9_000).select("event_id", "fits", "essential_bytes", "other_bytes")


def page_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of catalogue pages: tags with their attributes, elements, and what is left without nested, hidden and inert ones."""
    key = F.col("p_partkey").cast("string")
    page = F.concat(
        F.lit('<ul CLASS="a" data-k="'), key, F.lit("\"><li class='x' class='y'>"), F.col("p_brand"), F.lit("</li><li hidden>"), F.col("p_type"), F.lit("<b>!</b></li></ul><nav>n<nav>"), key,
        F.lit("</nav>m</nav><svg><text>"), F.col("p_name"), F.lit("</text><defs><text>no</text></defs></svg><!-- c --><script>x</script>"),
    )
    parts = markup.together(
        page, items=markup.start_tags_reading("li"), lists=markup.start_tags_reading("ul"), contents=markup.elements_reading("li"), without=markup.without_reading("nav", "svg"),
        seen=markup.without_hidden_reading(), live=markup.without_inert_reading(), drawn=markup.drawing_text_reading(), text=markup.visible_reading(),
    )
    tags = F.col("p.items")
    return spread(spark, sf_dir, "part").select("p_partkey", parts.alias("p")).select(
        "p_partkey", F.size(tags).cast("long").alias("items"), tags[0]["attrs"]["class"].alias("class"), (tags[1]["start"] - tags[0]["end"]).cast("long").alias("between"),
        markup.attribute_where(F.col("p.lists"), "data-k", "class", "a").alias("data_k"), F.array_join("p.contents", "|").alias("contents"),
        "p.without", "p.seen", "p.live", "p.drawn", "p.text",
    )


def redirect_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hops of redirects: targets of five forms against a base, what they resolve to, and the hosts that a fetch touched."""
    base = F.when(F.pmod("u", F.lit(2)) == 0, "https://www.shop.example/a/b").otherwise("http://www.shop.example/a/b")
    target = F.element_at(F.array(
        _text("/x", F.col("k")), _text("y", F.col("k")), _text("//cdn.example/z", F.col("k")), _text("http://other.example/", F.col("k")), _text("https://other.example/", F.col("k")),
    ), (F.pmod("v", F.lit(5)) + 1).cast("int"))
    resolved = html.resolve(urls.part(base, "scheme"), urls.host(base), urls.part(base, "path"), target)
    key = lambda u: lookups.host_key(F.when(urls.host(u) == "www.shop.example", "shop.example"), urls.host(u), u)
    touched = batches.egress_union(key(base), F.array(key(resolved)), key(base), F.when(F.pmod("k", F.lit(3)) == 0, F.array(F.lit("render.example"), F.lit("shop.example"))))
    return _events(spark, sf_dir).select("event_id", resolved.alias("resolved"), urls.redirect_error(base, resolved).alias("error"), F.array_join(touched, ",").alias("touched"))


def rendered_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shell pages, some of which a renderer has filled."""
    from siltstone.operators.extract import extract, fetches_from_pages, records, with_rendered

    e = _events(spark, sf_dir, spread)
    shell = F.pmod("i", F.lit(3)) == 0
    pages = e.select("event_id", _text("https://h/", F.col("i")).alias("url"), F.when(shell, '<div id="root"></div><script>x</script>').otherwise(F.concat(F.lit("<p>"), F.repeat(F.lit("word "), 20), F.lit("</p>"))).alias("html"))
    dom = e.where(F.pmod("i", F.lit(2)) == 0).select(F.col("event_id").alias("seed_id"), F.concat(F.lit("<main>"), F.repeat(_text("filled ", F.col("k"), " "), 9), F.lit("</main>")).alias("dom_html"))
    found = with_rendered(records(extract(fetches_from_pages(pages, "event_id"))), dom)
    return found.select(F.col("seed_id").alias("event_id"), "tier", "resolved_via", "record_status", F.length("result").cast("long").alias("n"), F.col("access.reason").alias("access"))


def render_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shell pages that may not be rendered, were not reached, failed, showed nothing, an error page or their text."""
    from siltstone.operators.extract import after_rendering, extract, fetches_from_pages, records

    e = _events(spark, sf_dir, spread)
    pages = e.select("event_id", _text("https://h/", F.col("i")).alias("url"), F.when(F.pmod("i", F.lit(4)) > 0, '<div id="root"></div><script>x</script>').otherwise(F.concat(F.lit("<p>"), F.repeat(F.lit("word "), 20))).alias("html"))
    way, texts = F.pmod("i", F.lit(7)), F.concat(F.lit("<main>"), F.repeat(_text("filled ", F.col("k"), " "), 9), F.lit("</main>"))
    renders = e.where(way > 0).select(
        F.col("event_id").alias("seed_id"), (way > 2).alias("rendered"), F.when(way == 1, "render_unavailable").when(way == 2, "timeout").alias("code"), F.when(way == 2, "too slow").alias("message"),
        F.when(way == 4, 503).otherwise(200).alias("status"), F.lit("text/html").alias("content_type"), F.when(way == 3, '<div id="root"></div>').otherwise(texts).alias("dom_html"), F.col("k").cast("long").alias("render_ms"),
        (F.col("k") * 10).cast("long").alias("egress_bytes"), F.array(_text("cdn", F.col("k"), ".example")).alias("hosts"),
        F.array(F.struct(F.lit("abort").alias("type"), F.lit(None).cast("string").alias("outcome"), F.lit("ad").alias("reason"), F.lit("GET").alias("method"), F.lit(None).cast("string").alias("resource"), F.lit("u").alias("url"))).alias("actions"),
    )
    allowed = F.pmod("seed_id", F.lit(3)) > 0
    found = after_rendering(records(extract(fetches_from_pages(pages, "event_id"))), renders, allowed)
    return found.select(
        F.col("seed_id").alias("event_id"), "tier", "resolved_via", "record_status", F.array_join(F.transform("attempts", lambda a: F.concat_ws(" ", a["tier"], a["outcome"], a["duration_ms"].cast("string"), a["reason"])), ";").alias("attempts"),
        F.array_join(F.transform("errors", lambda x: x["code"]), ",").alias("codes"), (F.col("egress_bytes") - F.when(F.size("attempts") == 0, F.col("bytes")).otherwise(39)).alias("more"), F.array_join("egress_hosts", ",").alias("hosts"),
    )


def model_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a model is shown of conversations' turns, and what it is asked."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("t"), "role")
    title = F.when(F.col("role") == "user", F.concat(F.lit("T"), F.col("turn").cast("string")))
    content = models.prompt(F.col("t"), title, F.when(F.pmod("turn", F.lit(2)) == 0, "about"), F.when(F.pmod("conv_id", F.lit(3)) == 0, '{"a":1}'))
    asked = models.request_text(F.when(F.pmod("turn", F.lit(2)) == 0, "extract").otherwise("summary"), F.lit("sum up"), F.when(F.pmod("conv_id", F.lit(2)) == 0, '{"type":"object"}'), F.when(F.pmod("turn", F.lit(3)) == 0, F.lit(200)), content, F.lit("n0nce"))
    return rows.select("conv_id", "turn", F.sha2(asked.cast("binary"), 256).alias("asked_hash"))


def delivered_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delivery of single records: lean JSON, text with its provenance, attempts, actions."""
    e = _events(spark, sf_dir)
    url = _text("https://h/", F.col("i"), "?a=--b")
    attempts = F.transform(F.sequence(F.lit(1), F.pmod("k", F.lit(3)).cast("int") + 1), lambda x: F.struct(
        x.cast("string").alias("step"), F.lit("ok").alias("outcome"), F.when(x == 1, F.lit(200)).alias("status"), F.when(x == 2, F.col("event_type")).alias("reason")
    ))
    action = F.struct(F.lit("abort").alias("type"), F.col("event_type").alias("reason"), F.lit("GET").alias("method"), F.lit(None).cast("string").alias("resource"), F.lit("u").alias("url"))
    is_json = F.pmod("u", F.lit(2)) == 0
    return e.select(
        "event_id", delivery.lean_json(F.col("k").alias("k"), F.when(F.pmod("i", F.lit(2)) == 0, F.col("event_type")).alias("kind")).alias("lean"),
        delivery.text_payload(url, F.lit("1"), F.lit(200), F.lit("body"), is_json, F.pmod("v", F.lit(3)) == 0).alias("payload"), delivery.debug_lines(attempts).alias("debug"),
        delivery.action_label(action).alias("action"),
    )


def audit_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).select(
        "u", F.col("i").alias("ord"), F.when(F.col("event_type") == "error", "fail").when(F.col("event_type") == "view", "partial").otherwise("pass").alias("status"), F.col("event_type").alias("code"), F.col("v").alias("bytes")
    )
    return batches.audit_rows(rows, "u")


def board_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rosters of parts as boards: capped jobs, counts and titles."""
    parts = table(spark, sf_dir, "part").select(F.lower(F.regexp_replace("p_brand", "#", "")).alias("board"), "p_partkey")
    capped = boards.roster_cap(parts, "board", "p_partkey", 20).withColumn("platform", F.lit("lever"))
    return boards.envelopes(capped).select("board", "job_count", "truncated", "kept", "title")


QUERIES = {f.__name__: f for f in (
    status_texts, response_headers, forward_plans, blocked_resources, oversized_batches, render_units, longest_texts, longest_text, customer_supplier_nations, output_modes, rows_not_run,
    free_models, completions, finalised_answers, schema_failures, nested_pages, streamed_pages, state_roundtrip, linked_nodes, title_choice, pin_captions, lean_structures, bot_walls,
    render_reasons, error_split, address_families, ipv6_ranges, redacted_addresses, embedded_boards, capped_html, tracker_free_texts, seed_classes, client_profiles, render_pool_log, page_parts, redirect_hops, rendered_records, render_outcomes, model_prompts, delivered_rows, audit_rows, board_titles,
)}

_STATUS = ", ".join(f"({k}, '{v.replace(chr(39), chr(39) * 2)}')" for k, v in text.STATUS_TEXT.items())
_T = r"trim(regexp_replace(coalesce(text, ''), '[\s\p{Z}\x{FEFF}\x{85}]+', ' ', 'g'))"

SQL = {
    "status_texts": f"WITH {_E}, t(s, x) AS (VALUES {_STATUS}) SELECT event_id, coalesce(x, '') AS code_text, 100 + v % 500 BETWEEN 300 AND 399 AS redirect FROM e LEFT JOIN t ON s = 100 + v % 500",
    "response_headers": f"""WITH {_E} SELECT event_id, CAST(k * 7 - 50 AS VARCHAR) AS wait, '' AS absent, event_type AS charset,
        CASE WHEN u % 3 > 0 THEN CAST(least(greatest(k * 7 - 50, 0) * 1000, 300000) AS BIGINT) END AS wait_ms FROM e""",
    "forward_plans": f"""WITH {_E}, f AS (SELECT *, CASE WHEN u % 4 <> 0 THEN u % 2 END AS d, coalesce(CASE WHEN u % 4 <> 0 THEN u % 2 END = k % 2, false) AS same, i % 5 <> 0 AS data FROM e),
        r AS (SELECT *, CASE WHEN event_type = 'error' OR NOT data OR NOT same THEN 'unsupported_browser_method' WHEN i % 3 = 0 AND k * 2 > 100 THEN 'request_body_too_large'
            WHEN k = 13 THEN 'unreadable_post_body' WHEN v % 120 > 100 THEN 'request_body_too_large' WHEN v % 7 = 0 OR v % 11 = 0 THEN 'invalid_post_header' END AS reason FROM f)
        SELECT event_id, CASE WHEN reason IS NULL THEN 'forward' ELSE 'abort' END AS plan, reason, CASE WHEN data AND same THEN 'respond' ELSE 'abort' END AS preflight, same FROM r""",
    "blocked_resources": f"""WITH {_E} SELECT event_id, k % 5 IN (1, 2, 4) OR v % 4 = 3 OR (v % 4 = 0 AND u % 3 <> 0) AS blocked, k % 3 = 0 AND u % 2 <> 0 AS second_read FROM e""",
    "oversized_batches": f"WITH {_E} SELECT u, count(*) AS n, 'too_many_urls' AS code FROM e GROUP BY u HAVING count(*) > 60",
    "render_units": f"WITH {_E} SELECT event_id, CAST(ceil((50331648 + (v * 1000 + 1) * 5) / CAST(v * 1000 + 1 AS DOUBLE)) AS BIGINT) AS units FROM e",
    "longest_texts": """SELECT source, row_number() OVER (PARTITION BY source ORDER BY length(text) DESC, doc_id) AS rank, doc_id, length(text) AS n FROM documents WHERE text IS NOT NULL QUALIFY rank <= 3""",
    "longest_text": """SELECT source, sha256(text) AS text_hash FROM documents WHERE text IS NOT NULL QUALIFY row_number() OVER (PARTITION BY source ORDER BY length(text) DESC, doc_id) = 1""",
    "customer_supplier_nations": """WITH c AS (SELECT DISTINCT c_nationkey AS n FROM customer WHERE c_acctbal > 9000), s AS (SELECT DISTINCT s_nationkey AS n FROM supplier)
        SELECT count(*) FILTER (s.n IS NULL) AS left_only, count(*) FILTER (c.n IS NULL) AS right_only, count(*) FILTER (c.n = s.n) AS common FROM c FULL JOIN s ON c.n = s.n""",
    "output_modes": f"""WITH {_E}, r AS (SELECT *, CASE event_type WHEN 'view' THEN 'raw' WHEN 'click' THEN 'extract' ELSE 'summary' END AS req, u % 13 = 0 OR event_type = 'view' OR i % 10 = 0 AS raw,
            CASE WHEN u % 5 = 0 THEN 'unconfigured' WHEN v % 9 = 0 THEN 'schema_validation_failed' WHEN v % 9 = 1 THEN 'transform_failed' END AS why FROM e)
        SELECT event_id, CASE WHEN raw OR why IS NOT NULL OR k % 8 = 0 THEN 'raw' ELSE req END AS output, CASE WHEN raw THEN NULL WHEN why IS NOT NULL OR k % 8 = 0 THEN 'none' ELSE 'ollama' END AS provider,
            CASE WHEN NOT raw THEN why END AS reason,
            CAST(CASE WHEN raw THEN 3500 WHEN why IS NOT NULL THEN CASE WHEN i % 7 = 0 THEN 3500 ELSE {2999 + len(text.EXCERPT_NOTE)} END WHEN k % 8 = 0 AND i % 7 = 0 THEN 3500 ELSE length('model ' || i) END AS BIGINT) AS n FROM r""",
    "rows_not_run": """SELECT event_id AS ord, 'https://h/' || event_id AS final_url, 'fail' AS status, 'error' AS tier,
        CASE event_type WHEN 'error' THEN 'SEED_ERROR' WHEN 'purchase' THEN 'code_purchase' ELSE 'FETCH_REJECTED' END AS code_text,
        CASE event_type WHEN 'click' THEN 'guarded-fetch' WHEN 'view' THEN 'bulk-wall-abandon' WHEN 'error' THEN 'seed-error' ELSE 'bulk-shortcut' END AS resolved_via,
        CAST(least(500, length(event_type) * 150) AS BIGINT) AS n, 'code_' || event_type AS error FROM events WHERE event_type IN ('click', 'view', 'error', 'purchase')""",
    "free_models": """SELECT p_partkey, p_partkey % 3 > 0 AND p_partkey % 4 <> 0 AND p_size % 5 NOT IN (1, 3) AND p_size <= 45 AS free FROM part""",
    "completions": f"""WITH {_E}, c AS (SELECT *, event_type = 'error' AS bad, v % 6 = 0 AS blank, i % 2 = 0 AS one FROM e)
        SELECT event_id, CASE WHEN NOT bad AND NOT blank THEN 'answer ' || i END AS text, NOT bad AND k % 4 = 0 AS truncated, CASE WHEN NOT bad THEN k END AS in_tokens, CASE WHEN NOT bad THEN u END AS out_tokens,
            CASE WHEN NOT bad AND one THEN k / 128 END AS cost,
            CASE WHEN bad THEN '529: overloaded' WHEN blank THEN 'empty completion' || CASE WHEN k % 4 = 0 THEN ' (finish_reason=length)' ELSE '' END END AS error FROM c""",
    "finalised_answers": f"""WITH {_E}, a AS (SELECT *, i % 3 <> 0 AS js, v % 5 AS f FROM e)
        SELECT event_id, CASE WHEN NOT js THEN 'success' WHEN f = 1 THEN 'hard_fail' WHEN f = 2 OR k > 80 THEN 'soft' ELSE 'success' END AS outcome,
            CASE WHEN NOT js THEN NULL WHEN f = 1 THEN 'extract_invalid_json' WHEN f = 2 THEN '$.k is required' WHEN k > 80 THEN '$.k must be <= 80' END AS issue,
            CASE WHEN js AND f = 1 THEN NULL WHEN js AND f = 2 THEN '{{"q":1}}' WHEN js THEN '{{"k":' || k || '}}' WHEN f = 0 THEN '```json' || chr(10) || '{{"k": ' || k || '}}' || chr(10) || '```' WHEN f = 1 THEN 'no json' WHEN f = 2 THEN '{{"q": 1}}' ELSE '{{"k": ' || k || '}}' END AS result FROM a""",
    "schema_failures": f"""WITH {_E}, m AS (SELECT event_id, CASE WHEN i < 100 THEN '$.id must be >= 100' WHEN i % 2 = 1 THEN '$.id must be a multiple of 2' WHEN event_type = 'view' THEN '$.name length must be at least 4'
            WHEN event_type = 'error' THEN '$.name must match pattern ^[a-z]+$' WHEN u % 6 = 0 THEN '$.tags items must be unique' WHEN u % 6 = 1 THEN '$.tags must have at most 3 items'
            WHEN u % 6 = 2 THEN '$.tags[1] must be one of schema enum values' WHEN u % 6 = 3 THEN '$.tags must be array' WHEN i % 4 <> 0 AND k >= 50 THEN '$.score must match at least one anyOf schema'
            WHEN v % 10 = 0 THEN '$.other is not allowed' END AS message FROM e) SELECT event_id, message IS NULL AS valid, message FROM m""",
    "nested_pages": rf"""WITH d AS (SELECT doc_id, {_T} AS t FROM documents), g AS (SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(t || ' drawn', '([€£¥₹$])\s+(\d[\d ,]*)\s*\.\s*(\d{{1,4}})', '\1\2.\3', 'g'), '(\d)\s+\.(\d)', '\1.\2', 'g'),
            '(\d)\s+([€£¥₹])', '\1\2', 'g')) AS c FROM d), k AS (SELECT doc_id, c, length(c) >= 200 AND length(c) >= 0.7 * (length(c) + 4) AS box FROM g)
        SELECT doc_id, CASE WHEN box THEN 'container' ELSE 'body' END AS kind, sha256(CASE WHEN box THEN c ELSE c || ' end' END) AS text_hash FROM k""",
    "streamed_pages": f"""WITH {_E}, s AS (SELECT event_id, i % 2 = 0 AS shown, trim(repeat('line ' || k || ' of text. ', u % 9 + 1)) AS t FROM e)
        SELECT event_id, CASE WHEN shown AND length(t) >= 55 THEN t ELSE 'wait for it' END AS text, 'S:1' AS revealed FROM s""",
    "state_roundtrip": f"""WITH {_E} SELECT event_id, '{{"k":' || k || '}}' AS next_data, '[1,{{"b":' || u || '}}]' AS unnamed, '{{"a":"}}","n":[{{"v":' || v || '}}]}}' AS initial,
        CASE WHEN i % 3 = 0 THEN '' ELSE '{{"@type":"Thing","n":' || i || '}}' END AS json_ld, 'unsafe_json_key' || CASE WHEN i % 3 = 0 THEN ',invalid_json_ld' ELSE '' END AS errors FROM e""",
    "linked_nodes": f"WITH {_E} SELECT event_id, CASE WHEN k % 5 <= 3 THEN 'article' ELSE '' END AS types, CASE WHEN k % 5 <= 3 THEN 'H' || i END AS lead FROM e",
    "title_choice": f"""WITH {_E} SELECT event_id, CASE WHEN i % 3 = 0 THEN 'Site | STORY ' || k WHEN u % 4 = 0 THEN CASE WHEN i % 3 = 1 THEN 'Home' END ELSE 'Story ' || k END AS title FROM e""",
    "pin_captions": f"""WITH {_E} SELECT event_id, i % 3 < 2 AS pin_page, CASE i % 3 WHEN 0 THEN CAST(k + 1 AS VARCHAR) ELSE '7' END AS pin,
        CASE i % 3 WHEN 0 THEN 'body ' || (k + 1) WHEN 1 THEN 'body ' || CASE WHEN k + 1 = 7 THEN 7 ELSE k END END AS caption, CAST(2 AS BIGINT) AS posts FROM e""",
    "lean_structures": f"""WITH {_E} SELECT event_id, CASE WHEN i % 5 <> 0 THEN '{{"@type":"Article","n":' || k || ',"list":[{{"b":' || u || '}}]}}' END AS lean FROM e""",
    "bot_walls": f"""WITH {_E}, s AS (SELECT *, CASE WHEN v % 5 = 0 THEN 'cf-mitigated' WHEN k % 4 IN (0, 2) THEN 'challenge-body' WHEN k % 4 = 1 AND i % 2 = 0 THEN 'verification-phrase' END AS signal FROM e)
        SELECT event_id, signal, CASE WHEN signal IN ('cf-mitigated', 'challenge-body') THEN CASE WHEN k % 4 = 2 THEN 'datadome' WHEN v % 5 = 0 OR u % 3 = 0 THEN 'cloudflare' WHEN u % 3 = 2 THEN 'akamai' ELSE 'unknown' END END AS provider FROM s""",
    "render_reasons": f"""WITH {_E}, r AS (SELECT *, CASE WHEN k % 7 <> 0 THEN k * 2 ELSE 0 END AS shown FROM e) SELECT event_id, CASE WHEN i % 9 = 0 THEN 'render-error' WHEN u % 3 = 0 THEN 'network-blocked'
        WHEN v * 5 >= 4096 AND shown >= 100 THEN 'extraction-gap' WHEN v * 5 < 2048 AND shown < 100 THEN 'empty-dom' ELSE 'unknown' END AS reason, CASE WHEN event_type = 'view' THEN 'read' ELSE 'transform' END AS scope FROM r""",
    "error_split": f"""WITH {_E} SELECT event_id, CASE WHEN i % 2 = 0 THEN event_type ELSE '' END AS errors, CASE WHEN i % 2 = 0 THEN 'schema_knob_extracted' ELSE 'schema_knob_extracted,' || event_type END AS warnings FROM e""",
    "address_families": f"""WITH {_E} SELECT event_id, v % 8 IN (0, 2, 3) AS private, v % 8 IN (4, 6) AS local, CAST(CASE WHEN v % 8 IN (0, 1, 2, 3) THEN 6 WHEN v % 8 = 5 THEN 4 ELSE 0 END AS BIGINT) AS version FROM e""",
    "ipv6_ranges": f"""WITH {_E}, r AS (SELECT event_id, CASE v % 6 WHEN 0 THEN 'fc00::/7' WHEN 2 THEN '::ffff:0:0/96' WHEN 3 THEN 'fe80::/10' WHEN 4 THEN '2001:db8::/32' END AS cidr FROM e) SELECT * FROM r WHERE cidr IS NOT NULL""",
    "redacted_addresses": f"""WITH {_E} SELECT event_id, CASE WHEN v % 4 IN (0, 3) THEN 'signed_or_tokenized_url' END AS query, CASE WHEN v % 4 IN (1, 3) THEN 'signed_or_tokenized_url' END AS fragment,
        CASE v % 4 WHEN 0 THEN 'https://a.example/p?id=' || k || '&access_token=%5BREDACTED%5D' WHEN 1 THEN 'https://a.example/p#access_token=%5BREDACTED%5D' WHEN 2 THEN 'https://a.example/p?id=' || k ELSE 'https://a.example/#/r?access_token=%5BREDACTED%5D' END AS shown FROM e""",
    "embedded_boards": f"""WITH {_E} SELECT event_id, CASE v % 3 WHEN 0 THEN 'greenhouse' WHEN 1 THEN 'ashby' END AS platform, CASE WHEN v % 3 < 2 THEN 'org' || u END AS token,
        CASE WHEN v % 3 = 1 AND i % 2 = 0 THEN 'https://jobs.ashbyhq.com/org' || u || '/j' || k END AS job, CASE WHEN v % 3 < 2 THEN 'org' || u END AS clean FROM e""",
    "capped_html": f"""WITH {_E}, p AS (SELECT *, repeat('x', v % 40) || '<b>y</b><script>var a = 1</script>' || repeat('z', k) AS p, v % 40 AS n FROM e)
        SELECT event_id, CASE WHEN length(p) <= 50 THEN p WHEN n + 34 <= 50 THEN substr(p, 1, 50) ELSE substr(p, 1, n + 8) END AS kept FROM p""",
    "tracker_free_texts": f"""WITH {_E} SELECT event_id, CASE WHEN i % 2 = 0 THEN 'see https://hotjar.com/' || k || ' and https://shop.example/?u=https://hotjar.com/' || k || '9 or https://hotjar.com/' || k || '9 end'
        ELSE 'see  and https://shop.example/?u=https://hotjar.com/' || k || '9 or  end' END AS text FROM e""",
    "seed_classes": f"""WITH {_E}, l AS (SELECT *, list_transform(range(1, greatest(k, 1) + 1), lambda x: 'a' || x) AS a FROM e)
        SELECT event_id, CASE WHEN i % 4 = 0 THEN 'invalid' WHEN u % 3 = 0 THEN 'board' WHEN k % 2 = 0 THEN 'embed' ELSE 'seed' END AS class,
            CASE WHEN len(a) <= 20 THEN array_to_string(a, ' ') ELSE array_to_string(a[1:19], ' ') || ' … ' || (len(a) - 20) || ' more … ' || a[-1] END AS shown,
            CAST(1 + CASE WHEN event_type = 'click' THEN 1 ELSE 0 END AS BIGINT) AS actions FROM l""",
    "client_profiles": f"""WITH {_E} SELECT event_id, CASE u % 6 WHEN 1 THEN 'writer' WHEN 2 THEN 'writer' WHEN 4 THEN 'reader' END AS mapped, CASE u % 6 WHEN 0 THEN 'admin' WHEN 1 THEN 'reader' ELSE 'guest' END AS profile FROM e""",
    "render_pool_log": f"""WITH RECURSIVE {_E}, n AS (SELECT *, event_type = 'click' AS es, row_number() OVER (PARTITION BY u ORDER BY event_id) AS r FROM e),
        p(u, r, event_id, fits, a, b) AS (SELECT u, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS BOOLEAN), CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM (SELECT DISTINCT u FROM e)
            UNION ALL SELECT u, r, event_id, ok, CASE WHEN es AND ok THEN a + v ELSE a END, CASE WHEN NOT es AND ok THEN b + v ELSE b END
            FROM (SELECT n.*, p.a, p.b, CASE WHEN es THEN p.a < 6000 ELSE p.b + v <= 9000 END AS ok FROM p JOIN n ON n.u = p.u AND n.r = p.r + 1))
        SELECT event_id, fits, a AS essential_bytes, b AS other_bytes FROM p WHERE r > 0""",
    "redirect_hops": f"""WITH {_E}, b AS (SELECT *, CASE WHEN u % 2 = 0 THEN 'https' ELSE 'http' END AS s FROM e), r AS (SELECT *, CASE v % 5 WHEN 0 THEN s || '://www.shop.example/x' || k WHEN 1 THEN s || '://www.shop.example/a/y' || k
            WHEN 2 THEN s || '://cdn.example/z' || k WHEN 3 THEN 'http://other.example/' || k ELSE 'https://other.example/' || k END AS resolved FROM b)
        SELECT event_id, resolved, CASE WHEN s = 'https' AND v % 5 = 3 THEN 'scheme_downgrade' END AS error,
            'shop.example' || CASE v % 5 WHEN 2 THEN ',cdn.example' WHEN 3 THEN ',other.example' WHEN 4 THEN ',other.example' ELSE '' END || CASE WHEN k % 3 = 0 THEN ',render.example' ELSE '' END AS touched FROM r""",
    "rendered_records": f"""WITH {_E}, r AS (SELECT *, i % 3 = 0 AS shell, i % 2 = 0 AS drawn FROM e)
        SELECT event_id, CASE WHEN NOT shell THEN '1' WHEN drawn THEN '3' ELSE 'render-blocked' END AS tier, CASE WHEN shell AND NOT drawn THEN 'tier1-shell-gate' ELSE 'tier1-html' END AS resolved_via,
            CASE WHEN shell AND NOT drawn THEN 'fail' ELSE 'pass' END AS record_status, CAST(CASE WHEN NOT shell THEN 99 WHEN drawn THEN 9 * length('filled ' || k || ' ') - 1 ELSE 0 END AS BIGINT) AS n,
            CASE WHEN shell AND NOT drawn THEN 'js-required' ELSE 'none' END AS access FROM r""",
    "render_outcomes": f"""WITH {_E}, r AS (SELECT *, i % 4 > 0 AS shell, event_id % 3 > 0 AS allowed, i % 7 AS way FROM e)
        SELECT event_id, CASE WHEN NOT shell THEN '1' WHEN NOT allowed THEN 'render-blocked' WHEN way = 1 THEN 'render-unavailable' WHEN way IN (0, 2, 3) THEN 'error' WHEN way = 4 THEN '1' ELSE '3' END AS tier,
            CASE WHEN NOT shell THEN 'tier1-html' WHEN NOT allowed THEN 'render-blocked' WHEN way = 1 THEN 'render-unavailable' WHEN way = 4 THEN 'tier1-error' ELSE 'tier3-playwright' END AS resolved_via,
            CASE WHEN NOT shell OR (allowed AND way > 4) THEN 'pass' ELSE 'fail' END AS record_status,
            CASE WHEN NOT shell THEN '' WHEN NOT allowed THEN 'render-blocked block 0 allowRender=false' WHEN way = 0 THEN 'error error 0 render_error' WHEN way = 1 THEN '3 block 0 abort:ad:GET:u;render-unavailable error ' || k || ' render_unavailable'
                WHEN way = 2 THEN '3 block 0 abort:ad:GET:u;error error ' || k || ' timeout' WHEN way = 3 THEN '3 block 0 abort:ad:GET:u;error error ' || k || ' render_empty'
                WHEN way = 4 THEN '3 error ' || k || ' http-error;3 block 0 abort:ad:GET:u' ELSE '3 ok ' || k || ' rendered;3 block 0 abort:ad:GET:u' END AS attempts,
            CASE WHEN NOT shell OR NOT allowed THEN '' ELSE (['render_error', 'render_unavailable', 'timeout', 'render_empty', 'http_error', '', ''])[way + 1] END AS codes,
            CAST(CASE WHEN NOT shell OR NOT allowed OR way = 0 THEN 0 ELSE k * 10 END AS BIGINT) AS more, CASE WHEN shell AND allowed AND way > 0 THEN 'cdn' || k || '.example' ELSE '' END AS hosts FROM r""",
    "model_prompts": """WITH c AS (SELECT conv_id, turn, array_to_string(list_filter([CASE WHEN role = 'user' THEN 'Title: T' || turn END, CASE WHEN turn % 2 = 0 THEN 'Description: about' END, coalesce(text, ''),
            CASE WHEN conv_id % 3 = 0 THEN 'Structured data:' || chr(10) || '{"a":1}' END], lambda x: x IS NOT NULL), chr(10) || chr(10)) AS c FROM conversations)
        SELECT conv_id, turn, sha256('Request: sum up' || CASE WHEN turn % 3 = 0 THEN ' Use at most 200 tokens.' ELSE '' END || CASE WHEN turn % 2 = 0 THEN chr(10) || 'Answer with JSON only' ||
            CASE WHEN conv_id % 2 = 0 THEN ' that meets this schema: {"type":"object"}' ELSE '' END || '.' ELSE '' END || chr(10) || chr(10) || '<<<CONTENT n0nce>>>' || chr(10) || c || chr(10) || '<<<END n0nce>>>') AS asked_hash FROM c""",
    "delivered_rows": f"""WITH {_E} SELECT event_id, '{{"k":' || k || CASE WHEN i % 2 = 0 THEN ',"kind":"' || event_type || '"' ELSE '' END || '}}' AS lean,
        CASE WHEN u % 2 = 0 AND v % 3 <> 0 THEN 'body' ELSE '<!-- source: https://h/' || i || '?a=\\u002d\\u002db tier: 1 code: 200 -->' || chr(10) || chr(10) || 'body' END AS payload,
        '1 ok 200' || CASE WHEN k % 3 >= 1 THEN chr(10) || '2 ok ' || event_type ELSE '' END || CASE WHEN k % 3 = 2 THEN chr(10) || '3 ok' ELSE '' END AS debug, 'abort:' || event_type || ':GET:u' AS action FROM e""",
    "audit_rows": f"""WITH {_E}, s AS (SELECT u, i AS ord, CASE event_type WHEN 'error' THEN 'fail' WHEN 'view' THEN 'partial' ELSE 'pass' END AS outcome, event_type AS code, v AS bytes FROM e)
        SELECT 'seed' AS kind, u, ord, outcome, code, CAST(1 AS BIGINT) AS n, bytes FROM s UNION ALL SELECT 'failure', u, ord, outcome, code, 1, bytes FROM s WHERE outcome = 'fail'
        UNION ALL SELECT 'summary', u, NULL, CASE WHEN count(*) FILTER (outcome = 'fail') = count(*) THEN 'fail' WHEN count(*) FILTER (outcome <> 'pass') = 0 THEN 'pass' ELSE 'partial' END, NULL, count(*), CAST(sum(bytes) AS BIGINT) FROM s GROUP BY u""",
    "page_parts": """WITH p AS (SELECT *, '<ul CLASS="a" data-k="' || p_partkey || '">' AS ul, '<li class=''x'' class=''y''>' || p_brand || '</li>' AS one, '<li hidden>' || p_type || '<b>!</b></li>' AS two,
            '<nav>n<nav>' || p_partkey || '</nav>m</nav>' AS nav, '<svg><text>' || p_name || '</text><defs><text>no</text></defs></svg>' AS svg FROM part)
        SELECT p_partkey, CAST(2 AS BIGINT) AS items, 'x' AS class, length(p_brand) + 5 AS between, CAST(p_partkey AS VARCHAR) AS data_k, p_brand || '|' || p_type || '<b>!</b>' AS contents,
            ul || one || two || '</ul>' || '  ' || '<!-- c --><script>x</script>' AS without, ul || one || ' </ul>' || nav || svg || '<!-- c --><script>x</script>' AS seen,
            ul || one || two || '</ul>' || nav || svg || '  ' AS live, p_name AS drawn, p_brand || ' n ' || p_partkey || ' m ' || p_name AS text FROM p""",
    "board_titles": """WITH b AS (SELECT lower(replace(p_brand, '#', '')) AS board, count(*) AS n FROM part GROUP BY ALL)
        SELECT board, n AS job_count, n > 20 AS truncated, least(n, 20) AS kept, n || ' open role(s) · Lever · ' || board AS title FROM b""",
}
