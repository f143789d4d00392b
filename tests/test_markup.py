"""The page scanner: nested, hidden and broken markup, embedded JSON, floods; rules of requests and answers."""

import time

import pytest
from pyspark.sql import functions as F

from siltstone.functions import html, markup, nodes
from siltstone.operators import batches, policy, schema

LONG = "a sentence of a page's text. " * 12

SCOPES = [
    ("<article><h1>A</h1><p>x<span hidden>h<span>i</span></span>y</p></article><article>B</article>", "article", "A x y"),
    ("<article>a</article><main>much longer text</main>", "main", "much longer text"),
    ("<article>abcd</article><main>abcde</main>", "article", "abcd"),
    (f"<body><nav>m<nav>n</nav>o</nav><div id=Content>{LONG}<div>inner</div></div><div>other</div></body>", "container", f"{LONG}inner"),
    (f"<body><div class='x entry-content'>short</div><p>{LONG}</p></body>", "body", f"short {LONG.strip()}"),
    ("<style>.a{display:none}.b{display:none} .b{display:block} @media print{.c{display:none}}</style><p class=a>A</p><p class=b>B</p><p class=c>C</p>", "body", "B C"),
    ("<style media=print>.a{display:none}</style><p class=a>A</p><p style='display:block' hidden>B</p><p style='DISPLAY : none !important'>C</p>", "body", "A B"),
    ("<p>price € 12 . 50</p><svg><defs><text>no</text></defs><text>yes</text><text display='none'>no</text></svg><textarea>a<b</textarea>", "body", "price €12.50 yes a<b"),
    ("<div hidden id='S:1'>streamed</div><div hidden id='S:2'>not</div><script>$RC(\"B:1\",\"S:1\")</script>", "body", "streamed"),
    ("a < b &amp;amp; &nbsp; c &Eacute; &nope;", "body", "a < b &amp; c é &nope;"),
    ("<p>a<!-- <p>no</p> --><script>if (1 < 2) '</p>'</script>b", "body", "a b"),
    ("<aside>x<aside>y</aside>z</aside>kept<nav>never closed <p>gone", "body", "kept"),
    ("<body>in</body>after", "body", "in"), ("<head><title>t</title></head>rest", "body", "rest"), ("", "body", ""), (None, "body", ""),
    ("<article>open <p>to the end", "article", "open to the end"), ("<br hidden>a<img hidden>b</p>c", "body", "a b c"),
]


def test_scopes(spark):
    df = spark.createDataFrame([(i, s[0]) for i, s in enumerate(SCOPES)], "i int, h string")
    got = [(r.s.kind, r.s.text) for r in df.select("i", markup.scope(F.col("h")).alias("s")).orderBy("i").collect()]
    assert got == [(kind, " ".join(text.split())) for _, kind, text in SCOPES]


def test_parts(spark):
    page = "<ul><li CLASS='a \"b\"' data-x=1 class=c>one<li>two</li></ul><div hidden>h<div>i</div></div><!-- c --><svg><text>T</text></svg><textarea><p></textarea><a rel='x next' href='/n?a=1&amp;b'>"
    c = F.col("h")
    row = spark.createDataFrame([(page,)], "h string").select(
        markup.start_tags(c, "li").alias("tags"), markup.elements(c, "li").alias("items"), markup.without(c, "ul", "svg").alias("less"), markup.without_hidden(c).alias("seen"),
        markup.without_inert(c).alias("live"), markup.drawing_text(c).alias("drawn"), markup.first_attribute(c, "a", "href", "rel", "next").alias("next"), markup.visible(c).alias("text"),
    ).first()
    assert [t.attrs for t in row.tags] == [{"class": 'a "b"', "data-x": "1"}, {}] and page[row.tags[0].start : row.tags[0].end].startswith("<li CLASS")
    assert row.items == ["one<li>two"] and "two" not in row.less and "T" not in row.less and row.less.endswith("&amp;b'>")
    assert "<div>i" not in row.seen and "<li>two" in row.seen and "<!--" not in row.live and "&lt;p>" in row.live and row.drawn == "T" and row.next == "/n?a=1&b"
    assert row.text == "one two T <p>"


def test_embedded_json(spark):
    page = (
        '<script type="application/ld+json">//<![CDATA[\n{"a":1,"__proto__":{"x":1}}\n//]]></script><script type="application/json" id="">[1]</script><script type="application/json" id=k>{"x":"}"}</script>'
        '<script>window.__INITIAL_STATE__ = {"q":"a\\"}","l":[{}]};x; self.__NUXT_DATA__=[1,[2]] ; __APOLLO_STATE__ = nothing</script><script type="application/ld+json">{bad</script><script type="application/json" id=z>NaN</script>'
    )
    got = spark.createDataFrame([(page,), (None,)], "h string").select(markup.embedded_json(F.col("h")).alias("j")).collect()
    assert got[0].j.json_ld == ['{"a":1}'] and got[0].j.state == {"__json_script_0__": "[1]", "k": '{"x":"}"}', "__INITIAL_STATE__": '{"q":"a\\"}","l":[{}]}', "__NUXT_DATA__": "[1,[2]]"}
    assert [e.code for e in got[0].j.errors] == ["unsafe_json_key", "invalid_json_ld", "invalid_app_state"] and got[1].j.state == {}


FLOODS = ("<div class='a'><p>x", '<a "', "<script>", "<li>", "</p>", "<", "<b>", "<!--", "<p hidden>", "<svg>", "<style>", "<div id=content>", "<article>", "&", "<textarea>", "{")


@pytest.mark.parametrize("flood", FLOODS)
def test_scans_are_linear(flood):
    start = time.time()
    markup.scope_of(flood * 40_000)
    markup.embedded(flood * 40_000)
    assert time.time() - start < 20


def test_floods_through_spark(spark):
    """Attributes, quotes and nesting that once overflowed the stack of the JVM's matcher."""
    pages = ["<p " + " ".join(f'a{i}="v"' for i in range(100_000)) + ">text</p>", '<p title="' + "x" * 1_000_000, "<div hidden>" * 30_000, "<" * 300_000, "<div hidden>" + "a <b>x</b> " * 50_000, "<style>" + "@media{" * 30_000]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "i int, h string")
    c = F.col("h")
    made = df.select(
        "i", html.visible_text(c), html.title(c), html.canonical_link(c), html.images(c, F.lit("https://a/")), html.json_ld(c), html.hidden_classes(c), html.without_classes(c, F.array(F.lit("x"))),
        html.capped(c, 1_000), html.has_app_root(c), markup.scope(c)["text"].alias("text"),
    )
    rows = {r.i: r.text for r in made.collect()}
    assert rows[0] == "text" and rows[2] == "" and len(rows) == len(pages)


def test_images(spark):
    page = '<meta property="og:image" content="/og.png"><img data-src="lazy.jpg"><img src="http://localhost/x"><source data-srcset="s.webp 2x, t.webp"><img src="data:image/png;base64,x"><img src="https://u:p@cdn.example/a.png#f">'
    linked = '[{"@type":"Article","image":["/1.png",{"url":"/2.png"}],"thumbnailUrl":"/3.png"},{"@graph":[{"@type":"ImageObject","contentUrl":"/4.png"},{"@type":"Thing","image":{"contentUrl":"/5.png"}}]}]'
    df = spark.createDataFrame([(page, linked)], "h string, j string")
    got = df.select(html.images(F.col("h"), F.lit("https://example.com/d/p"), nodes.image_addresses(F.array("j")))).first()[0]
    assert got == [f"https://example.com/{x}" for x in ("og.png", "1.png", "2.png", "3.png", "4.png", "5.png", "d/lazy.jpg")] + ["https://cdn.example/a.png", "https://example.com/d/s.webp"]


def test_schema_messages(spark):
    cases = [
        ({"type": ["integer", "null"]}, '"x"', "$ must be integer or null"), ({"properties": {"a": {"items": {"type": "string"}}}}, '{"a":["x",3]}', "$.a[1] must be string"),
        ({"additionalProperties": {"type": "number"}}, '{"b":1,"c":"x"}', "$.c must be number"), ({"allOf": [{"minimum": 3}, {"maximum": 1}]}, "2", "$ must be >= 3"),
        ({"oneOf": [{"minimum": 1}, {"minimum": 2}]}, "3", "$ must match exactly one oneOf schema"), ({"not": {"const": {"a": 1, "b": [1.0]}}}, '{"b":[1],"a":1}', "$ must not match the not schema"),
        ({"const": 1.0}, "1", None), ({"minimum": 2, "exclusiveMinimum": True}, "2", "$ must be > 2"), ({"items": False}, "[1]", "$[0] is not allowed by false schema"), (False, "1", "$ is not allowed by false schema"),
        ({"type": "string", "pattern": "(a+)+$"}, '"aaa"', "$ schema pattern may cause catastrophic backtracking"), ({"required": ["a"]}, "[]", None), ({}, "{bad", "$ is not valid JSON"),
        ({"uniqueItems": True}, "[1,2,1]", "$ items must be unique"), ({"minProperties": 1}, "{}", "$ must have at least 1 properties"),
    ]
    row = spark.range(1).select(*[schema.outcome(F.lit(value), s)["message"].alias(f"m{i}") for i, (s, value, _) in enumerate(cases)]).first()
    assert list(row) == [m for _, _, m in cases]
    found = spark.range(1).select(schema.outcome(F.lit("1"), {"properties": {"a": {"format": "x"}}}).alias("o")).first().o
    assert found.unsupported and not found.valid and 'keyword "format" at $.properties.a' in found.message


def test_guards():
    assert policy.guard("raw") == (policy.GUARD, [])
    made, cut = policy.guard("summary", {"maxConcurrency": 9, "crawlDelayMs": 1, "maxGlobalWallMs": 10**9, "maxRenderedSeeds": -1}, {"maxTransformCostUsd": 0.1, "perSeedTransformCostUsd": 1})
    assert made["maxUrls"] == 10 and made["maxConcurrency"] == 4 and made["crawlDelayMs"] == 500 and made["maxGlobalWallMs"] == 180_000 and made["maxRenderedSeeds"] == 0
    assert made["perSeedTransformCostUsd"] == 0.025 and cut == ["perSeedTransformCostUsd"] * 2


def test_sets(spark):
    one, two = (spark.createDataFrame([(x,) for x in xs], "v string") for xs in (["a", "b", "b", None], ["b", "c"]))
    assert tuple(batches.compared_sets(one, two, "v").first()) == (1, 1, 1) and tuple(batches.compared_sets(one.limit(0), two.limit(0), "v").first()) == (0, 0, 0)
