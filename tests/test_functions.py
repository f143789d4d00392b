"""Column functions over small tables: URLs, addresses, texts, HTML, nodes, verdicts."""

import hashlib
import json
import time

import pytest
from pyspark.sql import functions as F

from siltstone.functions import classify, html, markup, nodes, text, urls
from siltstone.operators import extract, lookups, schema


def column(spark, values, f, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.x for r in rows.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


def test_url_ladder(spark):
    cases = {
        "https://example.com/a": None, "http://example.com": None, "ftp://x/": "unsupported_scheme", "http://u@x/": "userinfo_url", "http://u:p@x/": "userinfo_url",
        "x y": "invalid_url", "": "invalid_url", None: "invalid_url", "https://a/\r\nX": "crlf_url", "https://a/%0D": "crlf_url", "https:///": "invalid_url", "mailto:a@b": "unsupported_scheme",
    }
    assert column(spark, list(cases), urls.url_error) == list(cases.values())
    assert column(spark, ["https://a/" + "x" * 2048, "https://a/"], urls.bulk_url_error) == ["url_too_long", None]


def test_canonical(spark):
    cases = {
        "HTTP://Example.COM": "https://example.com/", "http://a.b:80/x?y#z": "https://a.b/x?y", "https://a.b:443": "https://a.b/", "https://a.b:8443/p q": "https://a.b:8443/p%20q",
        "  https://a.b/c\n": "https://a.b/c", "https:\\\\a.b\\c": "https://a.b/c", "https://[::1]:3000/": "https://[::1]:3000/",
    }
    assert column(spark, list(cases), urls.canonical) == list(cases.values())
    assert column(spark, ["\x01https://u:p@a.b/x", "https://a.b/@x"], urls.without_userinfo) == ["https://a.b/x", "https://a.b/@x"]


def test_private_addresses(spark):
    cases = {
        "10.1.2.3": True, "172.15.0.1": False, "172.31.255.255": True, "192.0.0.9": False, "192.0.0.11": True, "8.8.8.8": False, "255.255.255.255": True, "256.1.1.1": False,
        "::1": True, "[::1]": True, "fe80::1%eth0": True, "2001:4860:4860::8888": False, "2001:db8::1": True, "::ffff:8.8.8.8": True, "64:ff9b::1.2.3.4": True, "fc00::": True,
        "2606:4700::1111": False, "1:2:3:4:5:6:7": False, "::1::2": False, "example.com": False, "": False, None: False, "1:2:3:4:5:6:7:8": False, "ff02::1": True, "3fff:0fff::": True, "3fff:1000::": False,
    }
    assert column(spark, list(cases), urls.is_private) == list(cases.values())
    assert column(spark, ["1.2.3.4", "[::1]", "a.b", "::ffff:1.2.3.4", "1:2"], urls.ip_version) == [4, 6, 0, 6, 0]


def test_hosts(spark):
    assert column(spark, ["localhost", "a.localhost.", "127.9.9.9", "[::1]", "127.attacker.example", "example.com"], urls.is_loopback) == [True] * 4 + [False] * 2
    internal = ["http://x.corp/", "http://10.0.0.1/", "http://localhost:1/", "https://example.com/", "http://169.254.169.254/latest"]
    assert [bool(x) for x in column(spark, internal, urls.internal_reason)] == [True, True, True, False, True]
    assert column(spark, ["http://localhost/x"], lambda c: urls.internal_reason(c, True)) == [None]
    assert column(spark, ["https://www.pinterest.co.uk/pin/12/", "https://pinterest.com/a/pin/", "https://pin.it/x", "https://xpinterest.com/pin/1"], urls.is_pin_page) == [True, False, True, False]
    assert column(spark, ["http://a:22/", "http://a:80/", "http://a/", "http://a:x/"], urls.blocked_port) == [True, False, False, False]


def test_credentials_in_urls(spark):
    cases = {
        "https://a/?X-Amz-Signature=1": True, "https://a/?sig=": False, "https://a/?sig": False, "https://a/?x=1&amp;token=2": True, "https://a/#sig=1": False, "nonsense?key=1": True,
    }
    assert [x is not None for x in column(spark, list(cases), urls.signed_reason)] == list(cases.values())
    fragments = ["https://a/#access_token=1", "https://a/#/cb?access_token=1", "https://a/#access_token", "https://a/"]
    assert [x is not None for x in column(spark, fragments, urls.fragment_reason)] == [True, True, False, False]
    assert [x is not None for x in column(spark, ["https://u:p@a/", "https://u@a/", "https://a/"], urls.password_reason)] == [True, False, False]
    assert column(spark, ["https://a/?x=1&token=abc#access_token=d"], urls.redact_query) == ["https://a/?x=1&token=%5BREDACTED%5D#access_token=%5BREDACTED%5D"]


def test_registrable_domains(spark):
    cases = {
        "www.example.com": "example.com", "a.b.example.co.uk": "example.co.uk", "co.uk": None, "foo.github.io": "foo.github.io", "x.foo.github.io": "foo.github.io", "localhost": None,
        "10.0.0.1": None, "a.b.ck": "a.b.ck", "www.ck": "www.ck", "b.ck": None, "EXAMPLE.Com.": "example.com", "a.unknownsuffix": None,
    }
    df = spark.createDataFrame([(h,) for h in cases], "h string")
    assert {r.h: r.domain for r in lookups.registrable_domains(df, "h").collect()} == cases


def test_trackers(spark):
    cases = {"doubleclick.net": True, "a.b.DoubleClick.net.": True, "notdoubleclick.net": False, "net": False, "x" * 300 + ".doubleclick.net": False}
    assert column(spark, list(cases), lookups.is_tracker) == list(cases.values())


def test_texts(spark):
    assert column(spark, ["abc", "abcd efgh", "abcdefgh"], lambda c: text.clip(c, 6)) == ["abc", "abcd…", "abcde…"]
    assert column(spark, ["a\x00b​c‮d\n"], text.printable) == ["abcd"]
    assert column(spark, [" a    b﻿"], text.collapse) == ["a b"]
    assert column(spark, ["", "abcde", "x" * 4001], text.token_estimate) == [1, 2, 1001]
    assert column(spark, [1553186035299, 0, -5, None], text.iso_time, "long") == ["2019-03-21T16:33:55.299Z", None, None, None]
    assert column(spark, ["text/HTML", "application/json; x", "application/ld+json", None, "image/png"], text.is_html_type) == [True, False, False, True, False]
    assert column(spark, ["application/json; x", "application/ld+json", None], text.is_json_type) == [True, True, False]


def test_retry_after(spark):
    now = F.to_timestamp(F.lit("2024-01-01 00:00:00"))
    values = ["5", "-3", "9999", "Mon, 01 Jan 2024 00:00:30 GMT", "soon", "Sun, 31 Dec 2023 00:00:00 GMT"]
    assert column(spark, values, lambda c: text.retry_after(c, F.lit(429), now)) == [5000, 0, 300_000, 30_000, None, 0]
    assert column(spark, ["5"], lambda c: text.retry_after(c, F.lit(200), now)) == [None]


def test_provenance_hash(spark):
    record = {
        "url": 'https://a/"x"', "finalUrl": "https://a/é", "tier": 1, "code": 200, "output": "raw", "resolvedVia": "tier1-meta", "jsRequired": False, "contentSha256": None,
        "fetchedAt": "t", "transformProvider": None, "transformModel": None,
    }
    given = {k: F.lit(v) for k, v in record.items() if v is not None}
    got = spark.range(1).select(text.provenance_hash(**given)).first()[0]
    assert got == hashlib.sha256(json.dumps(record, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def test_references(spark):
    cases = {"&amp;lt;": "&lt;", "&lt;b&gt; &#65;&#x42; &nope; &#0; &#38;amp;": "<b> AB &nope; &#0; &amp;", "a & b": "a & b", "&eacute;&Eacute;": "é&Eacute;", "&#128512;": "😀", None: None}
    assert column(spark, list(cases), html.decode) == list(cases.values())


def test_html(spark):
    page = """<html><head><title> A &amp; <i>B</i> </title><meta name="Description" content='d "q"'><meta property=og:type content=article>
    <link rel="preload canonical" href="/c?x=1&amp;y=2"></head><body><div id="app" data-x="a>b"></div><p title="1 > 0">one<!-- two --></p>
    <script>if (a < b) { "<p>" }</script><div style="display:none"><b>three</b></div><aside>four</aside><p hidden>five</p>$ 10 .90</body></html>"""
    row = spark.createDataFrame([(page,)], "h string")
    c = F.col("h")
    got = row.select(
        html.title(c).alias("title"), html.visible_text(c).alias("text"), html.meta(c).alias("meta"), html.canonical_link(c).alias("link"), html.has_app_root(c).alias("root"),
        html.tag_count(c, "p").alias("p"), markup.scope(c)["kind"].alias("kind"), html.open_graph(c).alias("og"),
    ).first()
    assert got.title == "A & B" and got.text == "one four $10.90" and got.meta == {"description": 'd "q"', "og:type": "article"}
    assert got.link == "/c?x=1&y=2" and got.root and got.kind == "body" and got.og == {"og:type": "article"}


def test_scope(spark):
    cases = {
        "<main>" + "m " * 50 + "</main><article>" + "a " * 20 + "</article>": "main", "<article>" + "a " * 50 + "</article><main>" + "m " * 50 + "</main>": "article",
        "<main>x</main>": "main", "<p>x</p>": "body", "<!-- <article>x</article> --><p>y</p>": "body", "": "body", None: "body",
    }
    assert column(spark, list(cases), lambda c: markup.scope(c)["kind"]) == list(cases.values())


def test_json_ld(spark):
    scripts = [
        {"@type": "https://schema.org/NewsArticle/", "headline": "H", "articleBody": "B"}, {"@graph": [{"@type": "WebPage"}, {"@type": ["Thing", "JobPosting"], "title": "T"}]},
        {"@type": "WebPage", "mainEntity": {"@type": "Product", "description": "P"}}, {"@type": "SocialMediaPosting", "articleBody": "S"}, {"@type": "Recipe", "recipeInstructions": [{"text": "mix"}, {"text": "bake"}]},
        {"@type": "FAQPage", "mainEntity": [{"name": "q", "acceptedAnswer": {"text": "a"}}]}, {"@type": "Article"}, {"@type": "Article", "headline": "F", "isAccessibleForFree": "False"},
    ]
    pages = [f'<script type="application/ld+json">{json.dumps(s)}</script>' for s in scripts] + ['<script type="application/ld+json">{bad,}</script>', "<p>none</p>"]
    rows = spark.createDataFrame(list(enumerate(pages)), "i int, h string").withColumn("j", html.json_ld(F.col("h")))
    found = rows.withColumn("b", nodes.bearing(F.col("j"), F.lit(False))).select(
        "i", F.get(F.transform("b", lambda v: nodes.harvest(v, True)), F.lit(0)).alias("lead"), nodes.content_kind_of_types(F.flatten(F.transform("b", nodes.types))).alias("kind"),
        nodes.is_paywalled(F.col("j")).alias("paid"),
    )
    got = [(r.lead, r.kind, r.paid) for r in found.orderBy("i").collect()]
    assert got == [
        ("H", "article", False), ("T", "job", False), ("P", "product", False), (None, None, False), ("mix · bake", "article", False), ("q  a", "article", False), (None, None, False),
        ("F", "article", True), (None, None, False), (None, None, False),
    ]
    pin = spark.createDataFrame([(pages[3],)], "h string").select(F.size(nodes.bearing(html.json_ld(F.col("h")), F.lit(True))))
    assert pin.first()[0] == 1


def test_board_embeds(spark):
    cases = {
        '<script src="https://boards.greenhouse.io/embed/job_board/js?for=acme">': ("greenhouse", "acme"), "x jobs.ashbyhq.com/e2/embed y": ("ashby", "e2"),
        "https://api.lever.co/v0/postings/le-ver?mode=json": ("lever", "le-ver"), '"https://jobs.lever.co/abc"': ("lever", "abc"), "none": None,
    }
    assert [tuple(x) if x else None for x in column(spark, list(cases), html.board_embed)] == list(cases.values())


def test_bot_walls(spark):
    rows = [
        ({"server": ["cloudflare"], "cf-mitigated": ["challenge"]}, "", 403, "cf-mitigated", "cloudflare"), ({"Server": ["AkamaiGHost"]}, "x _abck y", 200, "challenge-body", "akamai"),
        ({}, "Verifying your browser", 503, "verification-phrase", None), ({}, "Verifying your browser", 200, None, None), ({"content-type": ["application/json"]}, "checking your browser", 429, None, None),
        ({"set-cookie": ["__cf_bm=1"]}, "ok", 200, None, None), ({}, "https://geo.captcha-delivery.com", 403, "challenge-body", "datadome"), ({"cf-ray": ["1"]}, "fine", 200, None, None),
    ]
    df = spark.createDataFrame([(i, *r[:3]) for i, r in enumerate(rows)], "i int, h map<string,array<string>>, b string, s int")
    got = df.select("i", classify.bot_signal(classify.bot_evidence(F.col("h"), F.col("b"), F.col("s"))).alias("x")).orderBy("i").collect()
    assert [(r.x.signal, r.x.provider) for r in got] == [r[3:] for r in rows]


def test_verdicts(spark):
    none = F.array().cast(extract.NO_ERRORS)
    one = spark.range(1)
    pick = lambda c: one.select(c).first()[0]
    lit = F.lit
    no = lit(None).cast("string")
    assert pick(classify.content_quality(lit("3"), lit(200), lit(" Something went wrong. "), lit(5), lit(False), lit(False))) == "app_error"
    assert pick(classify.content_quality(lit("1"), lit(200), lit("Careers"), lit(100_000), lit(False), lit(False))) == "low_value"
    assert pick(classify.content_quality(lit("1"), lit(200), lit("Careers"), lit(100_000), lit(True), lit(False))) is None
    assert pick(classify.access(lit("1"), lit(404), lit("x"), lit(False), none, lit(False), no, lit(True))["reason"]) == "http_error"
    assert pick(classify.access(lit("render-blocked"), lit(200), lit(""), lit(True), none, lit(False), no, lit(False))["reason"]) == "js-required"
    assert pick(classify.record_status(lit("1"), lit(200), lit("x"), none, lit("none"))) == "partial"
    assert pick(classify.render_reason(lit(True), lit(10), F.array(lit("h")), lit(5000), lit(200))) == "extraction-gap"
    assert pick(classify.gate(lit("text/plain"), lit(False), lit(False))["js_required"]) is False
    assert pick(classify.gate(lit("text/html"), lit(False), lit(False))["reason"]) == "empty-spa-shell"


def test_sensitive(spark):
    cases = {
        "-----BEGIN RSA PRIVATE KEY-----": "content_credential_signal", "set-cookie: sid=" + "a" * 20: "content_header_dump", "go to http://192.168.0.1/admin.": "content_embedded_internal_host",
        "(http://localhost:8080)": None, "http://localhost/#code=1": "content_embedded_loopback_oauth_credential", "https://e.com/a[draft]?sig=1": "content_embedded_signed_or_tokenized_url", "plain": None, None: None,
    }
    assert column(spark, list(cases), classify.sensitive_reason) == list(cases.values())
    assert column(spark, ["https://a.com/?token=1"], lambda c: classify.sensitive_reason(F.lit("x"), c)) == ["signed_or_tokenized_url"]


SCHEMA_CASES = [
    ({"type": "integer"}, "1", True), ({"type": "integer"}, "1.5", False), ({"type": "integer"}, "1.0", True), ({"type": ["string", "null"]}, "null", True), ({"enum": ["a", 1]}, "1", True),
    ({"const": {"b": 1, "a": 2}}, '{"a":2,"b":1}', True), ({"multipleOf": 0.1}, "0.3", True), ({"multipleOf": 2}, "3", False), ({"minLength": 2, "pattern": "^a"}, '"ab"', True),
    ({"required": ["x"]}, '{"y":1}', False), ({"properties": {"x": {"type": "string"}}}, '{"x":1}', False), ({"properties": {"x": {}}, "additionalProperties": False}, '{"x":1,"z":2}', False),
    ({"items": {"type": "number"}, "minItems": 2}, "[1,2.5]", True), ({"uniqueItems": True}, "[1,1]", False), ({"anyOf": [{"type": "string"}, {"minimum": 5}]}, "4", False),
    ({"oneOf": [{"type": "number"}, {"minimum": 5}]}, "7", False), ({"not": {"type": "string"}}, '"x"', False), ({"allOf": [{"minimum": 1}, {"maximum": 3}]}, "2", True), ({}, "bad json", False),
]


def test_schema_checks(spark):
    checks = [schema.valid(F.try_parse_json(F.lit(value)), s).alias(f"c{i}") for i, (s, value, _) in enumerate(SCHEMA_CASES)]
    assert list(spark.range(1).select(*checks).first()) == [x for _, _, x in SCHEMA_CASES]


def test_schema_keywords():
    assert schema.unsupported({"type": "object", "properties": {"a": {"$ref": "#"}}}) == ("unsupported", "$ref", "$.properties.a")
    assert schema.unsupported({"items": [{}]}) == ("tuple_items", "items", "$.items") and schema.unsupported({"minimum": 1}) is None
    assert schema.keyword_message(("unsupported", "budget", "$")).startswith('"budget" at $ is an argument')
    unsafe = ["(a+)+", "(a|ab)*", "(a|a)+", "((a*)b)?", "x" * 129, "("]
    assert all(schema.pattern_problem(p) for p in unsafe) and not any(schema.pattern_problem(p) for p in ("^a+b*$", "(ab|cd)+", "(a+)b", r"\(a+\)+"))
    with pytest.raises(ValueError):
        schema.valid(F.lit("1"), {"if": {}})


def test_hidden_classes(spark):
    page = """<style>.gone { color: red; display : none } .a .b{display:none} @media print { .print{display:none} } /* .c{display:none} */ .x,.off{display:none}</style>
    <p>one</p><div class="big gone">two</div><p class='off'>three</p><p class=print>four</p><div class="gone-not">five</div>"""
    row = spark.createDataFrame([(page,), (None,)], "h string").withColumn("k", html.hidden_classes(F.col("h")))
    got = row.select("k", html.visible_text_of(F.col("h"), F.col("k")).alias("t")).collect()
    assert got[0].k == ["gone", "off"] and got[0].t == "one four five" and got[1].t == ""


def test_capped(spark):
    cases = {"<p>abc</p><p>def</p>": "<p>abc</p><p>", "<p>abc</p> <p>def</p>": "<p>abc</p> ", "<p>abcdef</p>": "<p>abcdef</p>", "<p>a</p><script>var x = 1": "<p>a</p>", "x" * 20: "x" * 13}
    assert column(spark, list(cases), lambda c: html.capped(c, 13)) == list(cases.values())


def test_recovered_options():
    rest, applied, found = schema.recover_options({"type": "object", "budget": 5, "debug": "x", "properties": {"budget": {}}, "maxBytes": 3}, {"maxBytes": 9}, lambda k, v: isinstance(v, int))
    assert rest == {"type": "object", "debug": "x", "properties": {"budget": {}}} and applied == {"budget": 5} and found == ["budget", "maxBytes"]
    assert schema.unsupported(rest) == ("unsupported", "debug", "$") and schema.recover_options("x", {}, bool) == ("x", {}, [])


def test_image_flood_keeps_source_tags(spark):
    page = "".join(f'<img src="/{k}.png">' for k in range(500)) + '<source srcset="last.webp 1x">'
    found = spark.createDataFrame([(page,)], "h string").select(html.image_candidates(F.col("h"))).first()[0]
    assert len(found) == 201 and found[199:] == ["/199.png", "last.webp"]


FLOODS = {
    "blanks": lambda n: '<script type="application/ld+json">' + " " * n + '{"a":' + " " * n + "1}" + " " * n + "</script>",
    "cdata": lambda n: '<script type="application/ld+json">//<![CDATA[ {"a":1}' + " " * n + "]]> " * (n // 4) + "</script>",
    "scripts": lambda n: "<script>" * (n // 8),
    "quotes": lambda n: '<script "' * (n // 9),
    "ends": lambda n: "<script>" + "</script " * (n // 9),
    "metas": lambda n: '<meta name="a" content="b">' * (n // 27),
    "styles": lambda n: "<style >" * (n // 8),
    "mixed": lambda n: "<script><style></script><p hidden>" * (n // 34),
}


@pytest.mark.parametrize("name", FLOODS)
def test_floods_of_a_megabyte_are_read_in_linear_time(spark, name):
    text = FLOODS[name](1_000_000)
    df = spark.createDataFrame([(text,)], "h string").repartition(1)
    shown = [html.json_ld, html.visible_text, html.meta, lambda c: html.capped(c, len(text) - 10), html.title]
    df.select(*[f(F.lit("")) for f in shown]).collect()  # compile
    for f in shown:
        began = time.time()
        df.select(f(F.col("h")).alias("x")).collect()
        assert time.time() - began < 5


def test_cdata_marks(spark):
    cases = {
        '  {"a":1} \n': '{"a":1}', '<![CDATA[{"a":1}]]>': '{"a":1}', '// <![CDATA[\n{"a":1}\n// ]]>\n': '{"a":1}', '/*<![CDATA[*/ {"a":1} /*]]>*/': '{"a":1}',
        ' {"a":"]]>"} ': '{"a":"]]>"}', "]]>": "", "<![CDATA[": "", "": "", '{"a":"//"}': '{"a":"//"}',
    }
    rows = spark.createDataFrame([(c,) for c in cases], "c string").select("c", html.without_cdata(F.col("c")).alias("x")).collect()
    assert {r.c: r.x for r in rows} == cases == {c: markup.without_cdata(c) for c in cases}


def test_elements_without_end_keep_their_content(spark):
    page = "a<script>1</script>b<style>2</style><script>3<b>c</b><style>4</style>"
    assert spark.range(1).select(html.without(F.lit(page), "script", "style")).first()[0].split() == ["a", "b", "<script>3<b>c</b>"]


def test_cuts_before_open_parts(spark):
    pages = {"<p>a</p><script>x</script><style>": "<p>a</p><script>x</script>", "<p><script>1<style>2</script>3": "<p><script>1", "ab <scr": "ab ", "<svg><g></svg>ab": "<svg><g></svg>ab"}
    for page, want in pages.items():
        assert spark.range(1).select(html.capped(F.lit(page + "z" * 9), len(page))).first()[0] == want


def test_equality_of_json_at_any_depth(spark):
    same = [('{"a":1}', {"a": 1.0}, True), ('{"a":[1,{"b":2e0}]}', {"a": [1.0, {"b": 2}]}, True), ('"1"', 1, False), ('{"a":"1.0 x"}', {"a": "1 x"}, False), ("-0", 0, True)]
    same += [('{"1":1}', {"1.0": 1}, False), ('{"b":null,"a":"\\"2.0\\""}', {"a": '"2.0"', "b": None}, True), ("[1,2]", [2, 1], False), ("1.5", 1.5, True), ("true", 1, False)]
    for text, value, want in same:
        v = F.try_parse_json(F.lit(text))
        assert spark.range(1).select(schema.equals(v, value)).first()[0] is want, (text, value)
        assert spark.range(1).select(schema.failure(v, {"enum": [value]}).isNull()).first()[0] is want
    unique = lambda t: spark.range(1).select(schema.failure(F.try_parse_json(F.lit(t)), {"uniqueItems": True}).isNull()).first()[0]
    assert not unique("[1, 1.0]") and not unique('[{"a":[1]},{"a":[1.0]}]') and unique('[1, "1", 2]')


PRESCANS = {
    b'<meta charset="utf-8">': "utf-8", b"<META CHARSET=Windows-1252 >": "windows-1252", b"<meta charset='x'><meta charset='y'>": "x", b"<metadata charset=a><meta charset=b>": "b",
    b'<meta data-charset="a"><meta name="charset=b" content="charset=c">': None, b'<meta http-equiv="Content-Type" content="text/html; charset = ISO-8859-2">': "iso-8859-2",
    b'<meta content="text/html; charset=a" http-equiv=refresh>': None, b"<!-- <meta charset=a> --><meta charset=b>": "b", b"<!-- <meta charset=a>": None, b'<meta charset="utf-8" data="x>': None,
    b'<meta charset=a/><meta name="x" charset>': "a/", b"\xff\xfe<meta charset=a>": "a", b"": None, b" " * 1020 + b"<meta charset=a>": None, b"<p charset=a>": None, b'<meta x="> charset=b"><meta/charset=c>': None,
    b"<meta charset=\"\" http-equiv='content-type' content='charset=q'>": "q",
}


def test_charset_prescan(spark):
    rows = spark.createDataFrame([(i, b) for i, b in enumerate(PRESCANS)], "i int, b binary").select("i", extract.prescan(F.col("b")).alias("x")).orderBy("i").collect()
    assert dict(zip(PRESCANS, [r.x for r in rows])) == PRESCANS


def test_record_payload(spark):
    from siltstone.operators import delivery

    pages = spark.createDataFrame([(1, "https://h.example/?token=abc&x=1", "<title>T</title><article>" + "word " * 900 + "</article>"), (2, "https://h.example/", "<div id=root></div><script></script>")], "page_id long, url string, html string")
    rows = extract.records(extract.extract(extract.fetches_from_pages(pages)))
    rows = rows.withColumn("transform", F.struct(F.lit("none").alias("provider"), F.lit(None).cast("string").alias("model"), F.lit("failed").alias("reason"), F.lit(3).alias("in_tokens"), F.lit(None).cast("int").alias("out_tokens")))
    got = rows.select(delivery.record_payload(rows).alias("p"), delivery.record_payload(rows, debug=True).alias("d"), delivery.debug_block(rows).alias("b")).collect()
    one, two = (json.loads(r.p) for r in got)
    assert one["ok"] is True and one["url"] == "https://h.example/?token=%5BREDACTED%5D&x=1" and one["provenance"]["code"] == 200 and one["title"] == "T" and "platform" not in one and one["result"].startswith("word word")
    assert "[… 4499 characters total — snippeted" in one["result"] and len(one["result"]) < 2200 and list(one)[:4] == ["schemaVersion", "ok", "status", "url"]
    assert two["ok"] is False and two["status"] == "fail" and "contentSha256" not in two and len(json.loads(got[1].d)["contentSha256"]) == 64
    assert got[0].b.split("\n")[0] == "--- debug ---" and "transform: none (failed) in=3" in got[0].b.split("\n")
