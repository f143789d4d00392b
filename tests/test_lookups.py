"""Suffix lists, address blocks and model choice at sizes where only the joins can help, against slow versions."""

import ipaddress
import random

import pytest
from pyspark.sql import functions as F

from siltstone.operators import folds, lookups, models

LIST = """// a comment
// ===BEGIN ICANN DOMAINS===
com
  uk
co.uk   // the rest of the line is no rule
*.ck
!www.ck
公司.cn
*.kawasaki.jp
!city.kawasaki.jp
jp
cn
// ===END ICANN DOMAINS===
// ===BEGIN PRIVATE DOMAINS===
github.io
*.compute.example.com
// ===END PRIVATE DOMAINS===
"""


def slow_domain(host, rules, unlisted=False):
    labels = [x if x.isascii() else "xn--" + x.encode("punycode").decode() for x in host.lower().rstrip(".").split(".")]
    if len(labels) < 2 or not all(labels) or all(x.isdigit() for x in labels):
        return None
    best = None
    for k in range(len(labels)):
        name = ".".join(labels[k:])
        if "!" + name in rules:
            best = len(labels) - k - 1
            break
        for rule, size in ((name, len(labels) - k), ("*." + ".".join(labels[k + 1 :]), len(labels) - k)):
            if rule in rules and best is None:
                best = size
    if best is None and unlisted and labels[-1] != "local":
        best = 1
    return ".".join(labels[-best - 1 :]) if best is not None and len(labels) > best else None


HOSTS = ["a.b.com", "com", "b.co.uk", "co.uk", "x.y.ck", "y.ck", "www.ck", "a.www.ck", "例.公司.cn", "公司.cn", "b.a.kawasaki.jp", "city.kawasaki.jp", "x.city.kawasaki.jp", "a.github.io", "B.A.GitHub.IO.", "q.vm.compute.example.com",
         "1.2.3.4", "localhost", "a..com", "", "x.unknown", "p.q.unknown", "printer.local", None]


@pytest.mark.parametrize("private", [True, False])
@pytest.mark.parametrize("unlisted", [True, False])
def test_suffix_lists(spark, tmp_path, private, unlisted):
    path = tmp_path / "list.dat"
    path.write_text(LIST)
    rules = lookups.read_suffix_list(spark, str(path), private)
    text = LIST if private else LIST.split("// ===BEGIN PRIVATE")[0]
    plain = {x.split()[0] for x in text.splitlines() if x.split() and not x.strip().startswith("//")}
    plain = {".".join(y if y.isascii() else "xn--" + y.encode("punycode").decode() for y in x.split(".")) for x in plain}
    assert {("!" if r.kind == "exception" else "*." if r.kind == "wildcard" else "") + r.suffix for r in rules.collect()} == plain
    df = spark.createDataFrame([(h,) for h in HOSTS], "host string").withColumn("domain", F.lit("own"))
    got = {r.host: r.domain for r in lookups.registrable_domains(df, "host", rules, unlisted=unlisted).collect()}
    assert got == {h: slow_domain(h, plain, unlisted) if h else None for h in HOSTS}


def test_ten_thousand_rules(spark, monkeypatch):
    monkeypatch.setattr(lookups, "MAX_RULES", 100)  # the join by shuffle
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randrange(1, 4)))
    rules = {rng.choice(["", "", "*.", "!"]) + ".".join(word() for _ in range(rng.randrange(1, 4))) for _ in range(10_000)}
    rules = {("!" if r.startswith("!") else "") + ".".join(y if y.isascii() else "xn--" + y.encode("punycode").decode() for y in r.removeprefix("!").split(".")) for r in rules}
    rules = {r for r in rules if not r.startswith("!") or r.count(".")}
    hosts = [".".join(word() for _ in range(rng.randrange(1, 5))) for _ in range(2_000)] + ["hot.abc"] * 2_000
    got = lookups.registrable_domains(spark.createDataFrame([(h,) for h in hosts], "host string"), "host", lookups.suffix_rules(spark, sorted(rules))).collect()
    assert len(got) == len(hosts)

    def want(host):
        # of several rules the longest counts, exceptions before all
        labels = [x if x.isascii() else "xn--" + x.encode("punycode").decode() for x in host.split(".")]
        spans = [(kind == "!", len(labels) - k + (kind == "*.") - (kind == "!")) for k in range(len(labels)) for kind in ("", "*.", "!") if kind + ".".join(labels[k:]) in rules]
        span = max(spans)[1] if spans else None
        return ".".join(labels[-span - 1 :]) if span is not None and 0 < len(labels) - span and len(labels) > 1 else None

    assert {r.host: r.domain for r in got} == {h: want(h) for h in hosts}


@pytest.mark.parametrize("bound", [100_000, 10])
def test_blocks_of_any_length(spark, monkeypatch, bound):
    monkeypatch.setattr(lookups, "MAX_RULES", bound)
    rng = random.Random(5)
    four = [ipaddress.ip_network((rng.choice([0x0A000000, rng.randrange(2**32)]), n), strict=False) for n in range(33) for _ in range(6)]
    six = [ipaddress.ip_network((rng.choice([0xFE80 << 112, rng.randrange(2**128)]), n), strict=False) for n in range(0, 129, 3) for _ in range(3)]
    addresses = [str(ipaddress.ip_address(int(n.network_address) + rng.randrange(n.num_addresses)) if n.version == 4 else ipaddress.IPv6Address(int(n.network_address) + rng.randrange(n.num_addresses))) for n in rng.sample(four + six, 200)]
    addresses += ["10.0.0.1"] * 200 + ["x", "", None, "::1", "255.255.255.255"]
    df = spark.createDataFrame([(k, a) for k, a in enumerate(addresses)], "k long, a string").withColumn("cidr_own", F.lit(1))
    for nets, ranges, f in ((four, lookups.address_ranges, lookups.in_ranges), (six, lookups.address_ranges_v6, lookups.in_ranges_v6)):
        table = ranges(spark, sorted({str(n) for n in nets}))
        got = sorted((r.k, r.cidr) for r in f(df, "a", table).collect())
        want = []
        for k, a in enumerate(addresses):
            try:
                address = ipaddress.ip_address(a or "x")
            except ValueError:
                continue
            want += [(k, str(n)) for n in set(nets) if address.version == n.version and address in n]
        assert got == sorted(want) and want
        assert f(df, "a", table.limit(0)).count() == 0


def slow_choice(r, catalogue):
    def fits(m):
        reserve = m["max_output"] if r["reserve"] is None else min(r["reserve"], m["max_output"]) if m["max_output"] is not None else r["reserve"]
        known = None not in (m["context"], r["input_tokens"], reserve, r["task"])
        return (
            (r["provider"] is None or r["provider"] == m["m_provider"]) and (r["model"] is None or r["model"] == m["m_model"]) and m["m_model"] not in (r["exclude"] or ())
            and (not r["local_only"] or m["local"]) and (r["task"] != "extract" or bool(m["supports_json"])) and known and m["context"] >= r["input_tokens"] + reserve
        )

    cost = lambda m: (0.45 if m["local"] else 0.0) + (0.0 if m["free"] else 0.25) + m["cost_weight"]
    fit = [m for m in catalogue if fits(m)]
    best = min(fit, key=lambda m: (m["rank"] + m["demotion"], m["demotion"], cost(m), m["m_model"].lower(), m["m_model"]), default=None)
    return best and (best["m_provider"], best["m_model"])


def test_choice_among_many_models(spark):
    rng = random.Random(7)
    catalogue = [
        {"m_provider": f"p{rng.randrange(5)}", "m_model": f"{rng.choice('mM')}{k}", "local": rng.random() < 0.2, "free": rng.random() < 0.5, "supports_json": rng.choice([True, False, None]), "context": rng.choice([None, rng.randrange(1000, 200_000)]),
         "max_output": rng.choice([None, rng.randrange(100, 9000)]), "rank": rng.randrange(50), "cost_weight": rng.random(), "demotion": rng.choice([0, 0, 0, 1])}
        for k in range(1500)
    ]
    requests = [
        {"request_id": k, "task": rng.choice(["extract", "summary"]), "input_tokens": rng.choice([None, rng.randrange(0, 210_000), rng.randrange(0, 2000)]), "provider": rng.choice([None, None, f"p{rng.randrange(6)}"]),
         "model": rng.choice([None, None, None, rng.choice(catalogue)["m_model"]]), "exclude": rng.choice([None, [], rng.sample([m["m_model"] for m in sorted(catalogue, key=lambda m: m["rank"])[:40]], rng.randrange(30))]),
         "local_only": rng.choice([None, False, True]), "reserve": rng.choice([None, rng.randrange(0, 9000)])}
        for k in range(800)
    ]
    ms = spark.createDataFrame([tuple(m.values()) for m in catalogue], "m_provider string, m_model string, local boolean, free boolean, supports_json boolean, context long, max_output long, rank int, cost_weight double, demotion int")
    rs = spark.createDataFrame([tuple(r.values()) for r in requests], "request_id long, task string, input_tokens long, provider string, model string, exclude array<string>, local_only boolean, reserve long")
    got = {r.request_id: r for r in models.choose(rs, ms).collect()}
    assert {k: (r.chosen_provider, r.chosen_model) for k, r in got.items()} == {r["request_id"]: slow_choice(r, catalogue) or ("none", None) for r in requests}
    assert all((r.reason is None) == (r.chosen_model is not None) for r in got.values())
    assert {r.reason for r in models.choose(rs, ms.limit(0)).collect()} == {"unconfigured"} and models.choose(rs.limit(0), ms).count() == 0


def test_stretches_follow_the_rows(spark):
    rows = [(k,) for k in range(4000)] + [(10**14,), (None,), (-(10**14),)] + [(77,)] * 500
    df = spark.createDataFrame(rows, "at long")
    sizes = {r.c: r["count"] for r in df.groupBy(folds.chunked(df, "at", 200).alias("c")).count().collect()}
    assert len(sizes) >= 18 and max(sizes.values()) <= 1000 and sorted(sizes.values())[-2] <= 450
    spans = df.where("at is not null").groupBy(folds.chunked(df, "at", 200).alias("c")).agg(F.min("at").alias("a"), F.max("at").alias("b")).orderBy("c").collect()
    assert all(x.b < y.a for x, y in zip(spans, spans[1:]))
    assert df.limit(0).select(folds.chunked(df.limit(0), "at", 5)).count() == 0


def test_rendering_keeps_attempts(spark):
    from siltstone.operators import extract

    html = "<div id=root></div><script></script>"
    pages = spark.createDataFrame([(k, f"https://h.example/{k}", html if k else "<p>" + "word " * 30) for k in range(5)], "page_id long, url string, html string")
    rows = extract.records(extract.extract(extract.fetches_from_pages(pages))).withColumn("own", F.lit(1))
    renders = spark.createDataFrame([(1, True, None, None, 200, "text/html", "<main>" + "shown " * 30 + "</main>", 7, 100, ["cdn.example"], []), (2, True, None, None, None, None, None, 3, None, None, None)], extract.RENDERS)
    got = {r.seed_id: r for r in extract.after_rendering(rows, renders, F.col("seed_id") != 4).collect()}
    assert [got[k].tier for k in range(5)] == ["1", "3", "error", "error", "render-blocked"] and all(r.own == 1 for r in got.values())
    assert [len(got[k].attempts) for k in range(5)] == [0, 1, 1, 1, 1] and got[1].result.startswith("shown") and got[1].egress_bytes == len(html) + 100 and got[1].egress_hosts == ["cdn.example"]
    assert [e.code for e in got[2].errors] == ["render_empty"] and [e.code for e in got[3].errors] == ["render_error"] and got[4].attempts[0].reason == "allowRender=false"
    gone = extract.after_rendering(rows, renders, F.lit(True), available=False).collect()
    assert sorted(r.tier for r in gone) == ["1"] + ["render-unavailable"] * 4 and all(r.attempts[0].reason == "render port unconfigured" for r in gone if r.tier != "1")
