"""Addresses by the URL standard: known forms, labels against Python's codec, numbers against Python's addresses."""

import ipaddress
import random

import pytest
from pyspark.sql import functions as F

from siltstone.functions import urls, weburl
from siltstone.operators import extract
from siltstone.sources import fetches


def column(spark, values, f):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").repartition(1)
    return [r.x for r in rows.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


HREFS = {
    "http://a.b/a/../b": "http://a.b/b", "http://0x7f.1/": "http://127.0.0.1/", "http://bücher.example/": "http://xn--bcher-kva.example/",
    "http://017700000001/": "http://127.0.0.1/", "http://2130706433": "http://127.0.0.1/", "http://1.2.3.4.5/": None, "http://256.1.1.1/": None,
    "http://1.2.3.4./": "http://1.2.3.4/", "http://EXAMPLE.com:080/%7Ea b?x='y' z#f": 'http://example.com/%7Ea%20b?x=%27y%27%20z',
    "https://[2001:db8:0:0:0:0:0:1]:443/": "https://[2001:db8::1]/", "https://[::]/": "https://[::]/",
    "https://[1:0:0:2:0:0:0:3]/": "https://[1:0:0:2::3]/", "https://[::ffff:1.2.3.4]/": "https://[::ffff:102:304]/",
    "http://a/./b/%2e%2E/c/.": "http://a/c/", "http://a/..": "http://a/", "http://a/b/..": "http://a/", "http:a.b/c": "http://a.b/c",
    "http:\\\\a\\b\\..\\c": "http://a/c", "http://u:p@h@x.y/": "http://x.y/", "http://a%41.b/": "http://aa.b/", "http://a b/": None,
    "http://a/é?é": "http://a/%C3%A9?%C3%A9", "http://ＡＢ。com/": "http://ab.com/", "http://例え.テスト/": "http://xn--r8jz45g.xn--zckzah/",
    "http://straße.de": "http://xn--strae-oqa.de/", "http://a:99999/": None, "http://a:/": "http://a/", "http://a:b/": None, "http://": None,
    "x": None, "http://a?b": "http://a/?b", "ht\ntp://a\t.b/": "http://a.b/", "http://0x/": "http://0.0.0.0/", "http://09.1/": None,
    "http://1.0x100000000/": None, "http://foo.0x1g/": "http://foo.0x1g/", "http://foo.09/": None, "http://a//b///c": "http://a//b///c",
    "http://a/b/../../../c": "http://a/c", "http://a/b//../c": "http://a/b/c", "https://maÑana.com/": "https://xn--maana-pta.com/",
    "http://a/%zz%": "http://a/%zz%", "http://[::1": None, "http://a/..a/.b./...": "http://a/..a/.b./...",
    "http://xn--bcher-kva.example./": "http://xn--bcher-kva.example./",
}
REDIRECTS = [
    ("http://a/b/c/d?q", "g", "http://a/b/c/g"), ("http://a/b/c/d?q", "?y", "http://a/b/c/d?y"), ("http://a/b/c/d?q", "#s", "http://a/b/c/d?q"),
    ("http://a/b/c/d?q", "../g", "http://a/b/g"), ("http://a/b/c/d?q", "//g", "http://g/"), ("http://a/b/c/d?q", "", "http://a/b/c/d?q"),
    ("http://a/b/c/d?q", "/g?x", "http://a/g?x"), ("https://a/", "http://b/", "scheme_downgrade"), ("http://a:8080/x", "y", "http://a:8080/y"),
    ("http://a/b", "http:c", "http://a/c"), ("http://a/b", "ftp://x", "unsupported_scheme"), ("http://a/b", "http://u@x", "userinfo_url"),
    ("http://a/b", "x\r\ny", "crlf_url"), ("zz", "x", "invalid_url"), ("http://a/b", "http://[", "invalid_url"),
]
LABELS = [
    "bücher", "例え", "mañana", "é", "aé", "他们为什么不说中文", "ليهمابتكلموشعربي؟", "3年b組金八先生", "пример", "a-ü-b", "ÿāĀ", "😀x", "üüüüüüüüüüüüüüüüüüüüüüüüüüüüüü", "почемужеонинеговорятпорусски",
]


def test_canonical_text(spark):
    assert dict(zip(HREFS, column(spark, list(HREFS), weburl.href))) == HREFS
    assert column(spark, [None, "http://a:443/", "http://a:80/b#c"], lambda c: weburl.href(c, upgrade=True)) == [None, "https://a/", "https://a/b"]


def test_redirects(spark):
    rows = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(REDIRECTS)], "i int, a string, b string").repartition(1)
    got = [r.x for r in rows.select("i", weburl.redirect(F.col("a"), F.col("b")).alias("x")).orderBy("i").collect()]
    assert [g.error or g.url for g in got] == [want for _, _, want in REDIRECTS]


def test_labels_equal_the_codec(spark):
    rng = random.Random(1)
    made = ["".join(rng.choice("abz09-éüñßжя日本語\U0001f600ا") for _ in range(rng.randrange(1, 40))) + "é" for _ in range(300)]
    words = {w for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect() for w in (r.text or "").lower().split() if not w.isascii()}
    labels = LABELS + made + sorted(words)[:3000]
    assert column(spark, labels, weburl.bootstring) == [x.encode("punycode").decode() for x in labels]


def test_numbers_equal_addresses(spark):
    rng = random.Random(2)
    form = lambda n: rng.choice([str, hex, lambda x: "0" + oct(x)[2:], lambda x: "0X" + hex(x)[2:].upper(), lambda x: "000" + oct(x)[2:]])(n)
    cases = {}
    for _ in range(400):
        value, k = rng.choice([rng.randrange(2**32), rng.randrange(2**16), 0, 2**32 - 1]), rng.randrange(1, 5)
        parts = [value >> (24 - 8 * j) & 255 for j in range(k - 1)] + [value & (2 ** (8 * (5 - k)) - 1)]
        cases[".".join(map(form, parts))] = str(ipaddress.IPv4Address(value))
    cases |= {"4294967296": None, "1.16777216": None, "1.2.65536": None, "1.2.3.256": None, "1.2.3.4.5": None, "1..2": None, "08": None, "0x1g.1": None, "": None}
    assert dict(zip(cases, column(spark, list(cases), weburl.ipv4))) == cases
    assert all(fetches.dotted(k.lower()) == v for k, v in cases.items() if v)


def test_literals_equal_addresses(spark):
    rng = random.Random(3)
    values = [sum(rng.choice([0, 0, 0, 1, 0xDB8, 65535]) << 16 * k for k in range(8)) for _ in range(300)]
    texts = [rng.choice([ipaddress.IPv6Address(v).exploded, ipaddress.IPv6Address(v).compressed.upper()]) for v in values]

    def shortest(v):  # Python writes the last 32 bits of some as dotted numbers, the standard does not
        groups = [f"{v >> 16 * k & 65535:x}" for k in range(7, -1, -1)]
        runs = max(((n, -k) for k in range(8) for n in range(2, 9 - k) if all(g == "0" for g in groups[k : k + n])), default=None)
        return ":".join(groups) if runs is None else ":".join(groups[: -runs[1]]) + "::" + ":".join(groups[-runs[1] + runs[0] :])

    assert column(spark, texts, weburl.ipv6) == [shortest(v) for v in values]
    assert column(spark, ["1::2::3", "fe80::1%1", "", ":::", "g::"], weburl.ipv6) == [None] * 5


def test_private_hosts_in_any_form(spark):
    inside = ["http://0x7f.1/", "http://2130706433/x", "http://0300.0250.1.1/", "http://[::ffff:10.0.0.1]/", "http://１２７.0.0.1/", "http://a.internal./", "http://%31%30.1.1.1/"]
    assert column(spark, inside, urls.internal_reason) == ["internal_host"] * len(inside)
    assert column(spark, ["http://8.8.8.8/", "http://0x08080808/", "http://a.example/"], urls.internal_reason) == [None] * 3
    assert fetches.guarded("http://0x7f.1/") == fetches.guarded("http://017700000001/") == "private_address" and fetches.guarded("http://0x08080808/") is None


@pytest.mark.parametrize("href, want, errors", [("/a/../b?x#y", "https://h.example/b?x", 0), ("//u:p@x.example:443", "https://x.example/", 0), ("http://[", None, 1), ("", None, 0), ("c", "https://h.example/d/c", 0)])
def test_canonical_links(spark, href, want, errors):
    page = spark.createDataFrame([(1, "https://h.example/d/e", f"<link rel='x CANONICAL' href='{href}'><p>t")], "page_id long, url string, html string")
    row = extract.extract(extract.fetches_from_pages(page)).select("canonical_url", "errors").first()
    assert row.canonical_url == want and [e.code for e in row.errors] == ["invalid_canonical_url"] * errors


def test_harvest_of_questions_and_steps(spark):
    from siltstone.functions import nodes

    cases = {
        '{"@type":"FAQPage","mainEntity":[{"name":"A?","acceptedAnswer":{"text":" b "}},{"name":"C?"},{"acceptedAnswer":"d"},3,{}]}': "Q: A? A: b  Q: C?  d",
        '{"@type":"FAQPage","mainEntity":{"name":"A?"}}': "Q: A?", '{"@type":"FAQPage","description":"x"}': "x", '{"@type":"Question","name":"Q","acceptedAnswer":{"text":"a"}}': "Q: Q A: a",
        '{"@type":"Recipe","recipeInstructions":" mix "}': "mix", '{"@type":"Recipe","recipeInstructions":["a","",{"text":"b"},{"name":"c"},{"name":"s","itemListElement":[{"text":"d"},"e"]},null]}': "a · b · c · d · e",
        '{"@type":"Recipe","recipeInstructions":{"@type":"ItemList","itemListElement":[{"text":"a"},{"name":"b"}]}}': "a · b", '{"@type":"HowTo","step":[{"text":"a"}]}': "a", '{"@type":"HowTo","description":"d","step":["a"]}': "d",
        '{"@type":"Recipe","recipeInstructions":[' + ",".join(f'"{k}"' for k in range(60)) + "]}": " · ".join(map(str, range(50))), '{"@type":"Recipe"}': None,
        '{"@type":"Recipe","recipeInstructions":["' + "x" * 5000 + '"]}': "x" * 4095 + "…", '{"@type":"Movie","name":"n"}': None, '{"@type":"Review","reviewBody":"r"}': "r",
    }
    assert dict(zip(cases, column(spark, list(cases), lambda c: nodes.harvest(F.try_parse_json(c))))) == cases
