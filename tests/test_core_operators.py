"""Operators over small tables, batch against stream, and the fetch source against a recorded client."""

import gzip
import json
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from siltstone.operators import batches, boards, delivery, extract, folds, lookups, models, shaping
from siltstone.sources import fetches
from siltstone.streaming import streams


def test_shaping(spark):
    rows = [(i, f"u{i % 7}", "hot" if i % 7 < 5 else "cold") for i in range(40)]
    df = spark.createDataFrame(rows, "ord long, url string, host string")
    assert sorted(r.ord for r in shaping.first_occurrences(df, "url").collect()) == list(range(7))
    shaped = [(r.ord, r.host) for r in shaping.shape(df, "url", "host", 3, 4).collect()]
    assert shaped == [(0, "hot"), (1, "hot"), (2, "hot"), (5, "cold")]
    d = shaping.disclosure(df, "url", "host", 3, 4).first()
    assert (d.input_urls, d.after_dedupe, d.after_host_limit, d.processed, d.hosts_cut) == (40, 7, 5, 4, 1)
    assert shaping.disclosure(df.limit(0), "url", "host").first().processed == 0


def test_host_limit_is_applied_before_the_shuffle(spark):
    df = spark.range(100).select(F.col("id").alias("ord"), (F.col("id") % 3).alias("host"))
    assert "WindowGroupLimit" in shaping.top_per_key(df, "host", 2)._jdf.queryExecution().executedPlan().toString()


def test_batch_status(spark):
    rows = [(1, "pass"), (1, "pass"), (2, "pass"), (2, "partial"), (3, "fail"), (4, "fail"), (4, "pass")]
    df = spark.createDataFrame(rows, "batch int, status string")
    for c in ("bytes", "egress_bytes", "in_tokens", "out_tokens", "cost_usd"):
        df = df.withColumn(c, F.lit(1))
    assert {r.batch: r.batch_status for r in batches.totals(df, "batch").collect()} == {1: "pass", 2: "partial", 3: "fail", 4: "partial"}
    assert batches.totals(df.limit(0)).first().batch_status == "fail"


def slow_quota(rows, limit, window):
    held, out = {}, {}
    for tenant, at, n, i in sorted(rows, key=lambda r: (r[0], r[1], r[3])):
        open_ = [x for x in held.get(tenant, []) if x[0] > at - window]
        ok = sum(x[1] for x in open_) + n <= limit
        held[tenant] = open_ + [(at, n)] * ok
        out[i] = ok
    return out


def test_quota_batch_equals_stream(spark, tmp_path):
    rng = random.Random(4)
    rows = [(rng.choice("abc"), rng.randrange(600_000), rng.randrange(1, 90), i) for i in range(300)]
    df = spark.createDataFrame(rows, "tenant string, at_ms long, seeds long, request_id long")
    expected = slow_quota(rows, 300, 60_000)
    got = folds.quota_admission(df, "tenant", "at_ms", "seeds", ["request_id"]).collect()
    assert {r.request_id: r.ok for r in got} == expected
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    query = streams.quota_stream(stream).writeStream.format("memory").queryName("quota").outputMode("append").trigger(availableNow=True).start()
    assert query.awaitTermination(60)
    assert {r.request_id: r.ok for r in spark.table("quota").collect()} == expected


def test_quota_edges(spark):
    df = spark.createDataFrame([("a", 0, 300, 1), ("a", 59_999, 1, 2), ("a", 60_000, 1, 3), (None, 5, 1, 4)], "t string, at long, n long, i long")
    got = {r.i: (r.ok, r.code, r.retry_after_ms) for r in folds.quota_admission(df, "t", "at", "n").collect()}
    assert got == {1: (True, None, None), 2: (False, "bulk_quota_exceeded", 1), 3: (True, None, None), 4: (False, "bulk_quota_store_error", None)}


def test_health(spark, tmp_path):
    outcomes = ["hard_fail", "success", "hard_fail", "soft", "hard_fail", "success", "hard_fail", "success", "success", "hard_fail", "hard_fail"]
    expected = [0, 0, 0, 0, 1, 1, 1, 1, 0, 0, 0]
    df = spark.createDataFrame([("m", i, o) for i, o in enumerate(outcomes)], "model string, seq long, outcome string")
    got = folds.model_health(df, "model", ["seq"], "outcome").orderBy("seq").collect()
    assert [r.demotion for r in got] == expected
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    query = streams.health_stream(stream).writeStream.format("memory").queryName("health").outputMode("append").trigger(availableNow=True).start()
    assert query.awaitTermination(60)
    assert [r.demotion for r in spark.table("health").orderBy("seq").collect()] == expected


def test_budget(spark):
    rows = [(1, i, 10, 0.05) for i in range(13)] + [(2, 0, 200, 0.0), (2, 1, 1, 0.0), (3, 0, 1, 0.4), (3, 1, 1, 0.0), (4, 0, 1, 0.6), (4, 1, 1, 0.0)]
    df = spark.createDataFrame(rows, "b int, ord int, bytes long, cost double")
    got = {(r.b, r.ord): (r.dispatch, r.run_transform, r.reason) for r in folds.sequential_budget(df, "b", ["ord"], "bytes", "cost", 10, 100, 0.05, 0.5).collect()}
    assert got[1, 9] == (True, True, None) and got[1, 10] == (False, False, "egress_bytes")  # equality is allowed
    assert got[2, 0] == (True, True, "egress_bytes") and got[2, 1] == (False, False, "egress_bytes")
    assert got[4, 0] == (True, True, "transform_cost") and got[4, 1] == (True, False, None)


def test_token_bucket(spark):
    df = spark.createDataFrame([("h", 0, 1), ("h", 0, 2), ("h", 0, 3), ("h", 10, 4), ("h", 9_000, 5)], "h string, at long, i int")
    got = {r.i: r.start_ms for r in folds.token_bucket(df, "h", "at", ["i"]).collect()}
    assert got == {1: 0, 2: 0, 3: 1000, 4: 2000, 5: 9000}


def test_batch_runner(spark):
    rows = [(1, i, f"h{i}", [f"h{i}", "victim"], 1, 100) for i in range(4)] + [(1, 4, "victim", ["victim"], 1, 100), (2, 0, "a", ["a"], 99, 50_000), (2, 1, "a", ["a"], 5, 10_000), (2, 2, "a", ["a"], 1, 1)]
    df = spark.createDataFrame(rows, "b int, ord int, host string, hosts array<string>, bytes long, duration_ms long").selectExpr("*", "cast(null as double) AS cost", "false AS renders")
    got = {(r.b, r.ord): (r.outcome, r.reason) for r in folds.run_batch(df, "b", ["ord"], host_cap=3, per_seed=1, cap=200, wall_ms=55_000).collect()}
    assert got[1, 3] == ("ran", None) and got[1, 4] == ("skipped", "bulk_per_host_cap") and got[2, 1] == ("ran", None) and got[2, 2] == ("skipped", "bulk_deadline_exceeded")


def slow_bucket(times, burst, refill):
    """Tokens as they drip, one request after the other."""
    tokens, at, out = float(burst), times[0], []
    for t in times:
        now = max(t, at)
        tokens, at = min(burst, tokens + (now - at) / refill), now
        if tokens < 1:
            at = now + round((1 - tokens) * refill)
            tokens = 1.0
        tokens -= 1
        out.append(at)
    return out


@pytest.mark.parametrize("chunk", [1, 3, 100])
def test_sums_and_rates_in_stretches(spark, chunk):
    rng = random.Random(chunk)
    rows = [(k % 3, i, rng.randrange(0, 4_000) * (k % 3 + 1), rng.randrange(0, 50)) for i, k in enumerate(rng.choices(range(3), k=200))]
    df = spark.createDataFrame(rows, "h int, i int, at long, n long")
    got = {r.i: r.start_ms for r in folds.request_starts(df, "h", "at", ["i"], 3, 16, chunk).collect()}
    sums = {r.i: r.bytes_before for r in folds.running_bytes(df, "h", "i", "n", 5, 900, chunk).collect()}
    for h in range(3):
        own = sorted((r for r in rows if r[0] == h), key=lambda r: (r[2], r[1]))
        assert [got[r[1]] for r in own] == slow_bucket([r[2] for r in own], 3, 16)
        total = 0
        for r in sorted(own, key=lambda r: r[1]):
            assert sums[r[1]] == total
            total += r[3]


def slow_batch(rows, host_cap, per_seed, cap, wall, delay, cost_seed, cost_cap, render_cap, render_bytes):
    """The schedule of one batch, rule by rule."""
    clock = size = rendered = 0
    cost, raw, ended, counts, closed, starts, out = 0.0, False, False, {}, set(), {}, []
    for host, hosts, n, ms, price, wants in rows:
        if clock >= wall:
            out.append(("bulk_deadline_exceeded", None, False, False))
            continue
        if ended:
            out.append(("bulk_budget_exceeded", None, False, False))
            continue
        if host in closed or counts.get(host, 0) >= host_cap:
            out.append(("bulk_per_host_cap", None, False, False))
            continue
        asked = [*starts.get(host, []), clock]
        begin = slow_bucket(asked, 2, delay)[-1]
        if begin >= wall:
            out.append(("bulk_deadline_exceeded", None, False, False))
            continue
        if size + per_seed > cap:
            ended = True
            out.append(("bulk_budget_exceeded", None, False, False))
            continue
        starts[host] = asked
        pays = price is not None and not raw and cost + cost_seed <= cost_cap
        draws = wants and rendered < render_cap and size + per_seed + render_bytes <= cap
        rendered += draws
        clock, size, ended = begin + ms, size + n, size + n > cap
        if pays:
            cost += price
            raw = cost > cost_cap
        for h in set(hosts):
            counts[h] = counts.get(h, 0) + 1
            if h != host and counts[h] >= host_cap:
                closed.add(h)
        out.append((None, begin, pays, bool(draws)))
    return out


def test_batch_runner_is_brute_force(spark):
    rng = random.Random(6)
    rows = []
    for b in range(20):
        for k in range(60):
            host = f"h{rng.randrange(6)}"
            rows.append((b, k, host, [host, f"h{rng.randrange(8)}"], rng.randrange(0, 40), rng.randrange(0, 3_000), rng.choice([None, 0.25, 0.5]), rng.random() < 0.3))
    df = spark.createDataFrame(rows, "b int, ord int, host string, hosts array<string>, bytes long, duration_ms long, cost double, renders boolean")
    found = folds.run_batch(df, "b", ["ord"], 9, 30, 800, 45_000, 2, 1_000, 0.25, 4.0, 5, 100).orderBy("b", "ord").collect()
    for b in range(20):
        mine = [(r.reason, r.started_ms, r.transformed, r.rendered) for r in found if r.b == b]
        assert mine == slow_batch([r[2:] for r in rows if r[0] == b], 9, 30, 800, 45_000, 1_000, 0.25, 4.0, 5, 100)
    assert {r.reason for r in found} == {None, "bulk_deadline_exceeded", "bulk_budget_exceeded", "bulk_per_host_cap"}


def test_folds_carry_state_across_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = spark.range(100).select((F.col("id") % 2).alias("k"), "id")
        fold = folds.ordered_fold(df, ["k"], ["id"], lambda: [0], lambda s, r: {"n": s.__setitem__(0, s[0] + 1) or s[0]}, "n int")
        assert {r.id: r.n for r in fold.collect()} == {i: i // 2 + 1 for i in range(100)}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_boards(spark):
    lever = [{"id": "1", "text": " T ", "hostedUrl": "u", "createdAt": 1553186035299, "categories": {"team": "x"}, "salaryRange": {"min": 1, "max": 2, "currency": "EUR", "interval": "year"}}, {}]
    ashby = {"jobs": [{"id": "a", "title": "A", "isListed": False}, {"id": "b", "title": "B", "isRemote": True, "applyUrl": "v"}]}
    green = {"jobs": [{"id": 5, "title": "G", "absolute_url": "g", "location": {"name": "L"}, "updated_at": "2024"}]}
    rows = [("lever", "l", json.dumps(lever)), ("ashby", "a", json.dumps(ashby)), ("greenhouse", "g", json.dumps(green)), ("lever", "bad", "{"), ("ashby", "none", None)]
    got = {(r.platform, r.id): r for r in boards.jobs(spark.createDataFrame(rows, "platform string, board string, body string")).collect()}
    assert set(got) == {("lever", "1"), ("ashby", "b"), ("greenhouse", "5")}
    assert got["lever", "1"].compensation == "EUR 1-2 year" and got["lever", "1"].title == "T" and got["lever", "1"].job_count == 2
    assert got["ashby", "b"].remote is True and got["ashby", "b"].url == "v" and got["ashby", "b"].job_count == 1 and got["greenhouse", "5"].published_at == "2024"
    assert boards.envelopes(boards.jobs(spark.createDataFrame(rows, "platform string, board string, body string"))).where("board = 'g'").first().title == "1 open role(s) · Greenhouse · g"


def test_models(spark):
    catalogue = [("p", "a", False, True, True, 1000, 100, 0, 0.0, 1), ("p", "b", False, True, True, 1000, 100, 1, 0.0, 0), ("l", "c", True, True, False, 9000, 100, 5, 0.0, 0)]
    kinds = "m_provider string, m_model string, local boolean, free boolean, supports_json boolean, context long, max_output long, rank int, cost_weight double, demotion int"
    requests = [(1, "summary", 10, None, None, [], False, None), (2, "summary", 5000, None, None, [], False, None), (3, "extract", 10, None, None, [], True, None), (4, "summary", 10, None, "z", [], False, None)]
    df = spark.createDataFrame(requests, "request_id int, task string, input_tokens long, provider string, model string, exclude array<string>, local_only boolean, reserve long")
    got = {r.request_id: (r.chosen_model, r.reason) for r in models.choose(df, spark.createDataFrame(catalogue, kinds)).collect()}
    # a demoted first choice ties with the second and loses
    assert got == {1: ("b", None), 2: ("c", None), 3: (None, "sensitive_content_no_local_provider"), 4: (None, "model_unavailable")}
    empty = spark.createDataFrame([], kinds)
    assert models.choose(df, empty).first().reason == "unconfigured"
    answers = [('{"choices":[{"message":{"content":"x"},"finish_reason":"length"}],"usage":{"prompt_tokens":3}}',), ('{"message":{"content":"y"},"done_reason":"stop","eval_count":4}',)]
    rows = spark.createDataFrame(answers, "b string").select(models.completion(F.col("b")).alias("c")).collect()
    assert (rows[0].c.text, rows[0].c.truncated, rows[0].c.in_tokens, rows[1].c.text, rows[1].c.out_tokens) == ("x", True, 3, "y", 4)
    fenced = spark.createDataFrame([('```json\n{"a": 1}\n```',), ("{}",), ("no",), (" ",)], "t string")
    assert [r[0] for r in fenced.select(models.answer_outcome(F.col("t"), F.lit(True))).collect()] == ["success", "success", "soft", "hard_fail"]


def test_delivery(spark):
    rows = [(1, i, f"https://x/{i}", "fail" if i == 2 else "pass", 200, "body " * 200) for i in range(4)]
    df = spark.createDataFrame(rows, "b int, ord int, url string, status string, code int, body string")
    assert [delivery.bulk_text(df, "b", F.lit("f"), cap).first().form for cap in (9_999, 2_200, 100)] == ["full", "slim", "cut"]
    assert len(delivery.bulk_text(df, "b", F.lit("f"), 100).first().text) == 100
    forms = [delivery.bulk_json(df, "b", cap).first() for cap in (9_999, 400, 100)]
    assert [r.form for r in forms] == ["full", "lean", "compact"] and json.loads(forms[2].json)["count"] == 4
    assert spark.range(1).select(delivery.field(F.lit('a"--\n'))).first()[0] == 'a\\"\\u002d\\u002d'


PAGES = {
    "article": ("<html><head><title>T</title></head><body><article>" + "word " * 30 + "</article></body></html>", "1", "content-present", "none"),
    "shell": ('<html><body><div id="root"></div><script src="x"></script></body></html>', "render-blocked", "empty-spa-shell", "js-required"),
    "jsonld": ('<script type="application/ld+json">{"@type":"JobPosting","title":"Dev","description":"Do things"}</script><body></body>', "1", "structured-data-found", "none"),
    "state": ('<body><script id="__NEXT_DATA__" type="application/json">{}</script></body>', "1", "structured-data-found", "none"),
    "empty": ("", "render-blocked", "empty-spa-shell", "js-required"),
}


def test_records(spark):
    df = spark.createDataFrame([(i, f"https://h/{k}", v[0]) for i, (k, v) in enumerate(PAGES.items())], "page_id long, url string, html string")
    got = extract.records(extract.extract(extract.fetches_from_pages(df))).orderBy("seed_id").collect()
    assert [(r.tier, r.gate.reason, r.access.reason) for r in got] == [v[1:] for v in PAGES.values()]
    assert got[2].content_kind == "job" and got[2].result == "Do things" and got[0].title == "T"
    plan = extract.records(extract.extract(extract.fetches_from_pages(df)))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 2  # other charsets, then both scans of a page in one evaluation
    rendered = spark.createDataFrame([(1, "<body><p>" + "now there is text " * 10 + "</p></body>")], "seed_id long, dom_html string")
    after = {r.seed_id: r.tier for r in extract.with_rendered(extract.records(extract.extract(extract.fetches_from_pages(df))), rendered).collect()}
    assert after == {0: "1", 1: "3", 2: "1", 3: "1", 4: "render-blocked"}


def test_decoding(spark):
    rows = [(b"caf\xe9", "text/html; charset=ISO-8859-1"), ("é".encode(), None), (b'<meta charset="latin1">\xe9', "text/html"), (b"a\xffb", "text/plain"), (b"", None), ("я".encode("koi8-r"), "text/html; charset=KOI8-R"), (b"\x80", "text/html; charset=ascii"), ("日".encode("shift_jis"), "text/html; charset=x-sjis")]
    df = spark.createDataFrame([(bytearray(b), c) for b, c in rows], "b binary, c string")
    assert [r[0] for r in df.select(extract.decoded(F.col("b"), F.col("c"))).collect()] == ["café", "é", '<meta charset="latin1">é', "a�b", "", "я", "€", "日"]


def recorded():
    return fetches.Recorded({
        "https://a/1": (200, {"Content-Type": ["text/html"]}, b"<p>hi</p>"), "https://a/2": (302, {"Location": ["/1"]}, b""), "https://a/3": (301, {"location": ["http://a/1"]}, b""),
        "https://a/4": (302, {"location": ["/4"]}, b""), "https://a/5": (200, {"content-encoding": ["gzip"]}, gzip.compress(b"zipped")), "https://a/6": (200, {"content-encoding": ["br"]}, b"?"),
        "https://a/7": (200, {"content-encoding": ["gzip"]}, gzip.compress(b"x" * 50_000)[:-4]), "https://a/8": (304, {}, b""),
    })


def test_fetching(spark):
    got = {k: fetches.fetch(recorded(), k, f"https://a/{k}") for k in range(1, 10)}
    assert got[1][6] == b"<p>hi</p>" and got[2][2] == "https://a/1" and got[2][9] == [("https://a/2", 302)]
    assert [got[k][11] for k in (3, 4, 6, 9)] == ["scheme_downgrade", "redirect_limit", "unsupported_encoding", "network_error"]
    assert got[5][6] == b"zipped" and got[8][3] == 304 and fetches.fetch(recorded(), 1, "ftp://x")[11] == "unsupported_scheme"
    for url, code in (("http://127.0.0.1/", "private_address"), ("http://[::1]/", "private_address"), ("https://a:22/", "blocked_port"), ("https://localhost/", "private_address"), ("https://x:y@a/1", "userinfo_url")):
        assert fetches.fetch(recorded(), 1, url)[11] == code
    hop = fetches.Recorded({"https://a/": (302, {"location": ["https://10.0.0.7/x"]}, b"")})
    assert fetches.fetch(hop, 1, "https://a/")[11] == "private_address"
    df = spark.createDataFrame([(k, f"https://a/{k}") for k in (1, 2, 3)], "seed_id long, url string")
    answers = recorded().answers
    rows = {r.seed_id: r for r in fetches.fetch_table(df, lambda: fetches.Recorded(answers)).collect()}
    assert rows[1].status == 200 and rows[2].redirects[0].status == 302 and rows[3].reject_code == "scheme_downgrade"


def test_data_source(spark):
    fetches.register(spark)
    seeds = "\n".join(json.dumps({"seed_id": k, "url": f"https://a/{k}"}) for k in (1, 2))
    df = spark.read.format("responses").option("client", "siltstone.sources.fetches:offline").option("seeds", seeds).load()
    assert [r.reject_code for r in df.collect()] == ["network_error"] * 2


def test_windows_batch_equals_stream(spark, tmp_path):
    df = spark.createDataFrame(
        pd.DataFrame({"ts": pd.date_range("2024-01-01", periods=200, freq="97s"), "kind": ["a", "b"] * 100, "value": [float(i) for i in range(200)]}), "ts timestamp, kind string, value double"
    )
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    query = streams.audit_windows(stream, "ts", "kind", "value").writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    assert query.awaitTermination(60)
    assert sorted(map(tuple, spark.table("windows").collect())) == sorted(map(tuple, streams.audit_windows(df, "ts", "kind", "value").collect()))


def test_page_stream(spark, tmp_path):
    df = spark.createDataFrame([(1, "https://h/", PAGES["article"][0])], "page_id long, url string, html string")
    df.write.parquet(str(tmp_path / "in"))
    query = streams.page_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))).select("seed_id", "tier").writeStream.format("memory").queryName("pages").trigger(availableNow=True).start()
    assert query.awaitTermination(60)
    assert [tuple(r) for r in spark.table("pages").collect()] == [(1, "1")]


def test_profiles(spark):
    got = spark.range(1).select(lookups.profile_map(F.lit("a=fast, b = slow ,=x,c=odd,a=slow"), ["fast", "slow"])).first()[0]
    assert got == {"a": "slow", "b": "slow"}
    df = spark.createDataFrame([("a",), ("z",)], "k string")
    assert {r.k: r.p for r in lookups.with_default(df, "k", spark.createDataFrame([("a", "fast")], "k string, p string"), "p", "plain").collect()} == {"a": "fast", "z": "plain"}


@pytest.mark.parametrize("small", [100_000, 1])
def test_lookups_beyond_the_broadcast_bound(spark, monkeypatch, small):
    monkeypatch.setattr(lookups, "small", lambda df, limit=small: F.broadcast(df) if df.limit(limit + 1).count() <= limit else df)
    df = spark.createDataFrame([("x.ads.example",), ("example",)], "h string")
    listed = spark.createDataFrame([("ads.example",), ("other",)], "domain string")
    assert [r.h for r in lookups.tracker_join(df, "h", listed).collect()] == ["example"]
