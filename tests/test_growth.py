"""Work that is heavy by row is done once a row and by tasks whose number grows with the rows."""

import json
import re

from pyspark.sql import functions as F

from siltstone.functions import markup
from siltstone.operators import schema
from siltstone.plans import catalog, tables


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_page_parts_scan_once(spark, sf_dir):
    found = catalog.queries()["page_parts"](spark, sf_dir)
    assert len(re.findall(r"ArrowEvalPython \[", plan(found))) == 1 and len(re.findall(r"\bscan\(", plan(found))) == 1


def test_together_equals_single_readings(spark):
    pages = ["", '<li class=a>x</li><nav>n<nav>m</nav></nav><li hidden>y', "<svg><text>d</text></svg><!-- c --><script>$RC('B:1','S:1')</script><div hidden id='S:1'>z</div>", None]
    h, rows = F.col("h"), spark.createDataFrame([(p,) for p in pages], "h string")
    both = markup.together(
        h, a=markup.start_tags_reading("li"), b=markup.elements_reading("li"), c=markup.without_reading("nav"), d=markup.without_hidden_reading(), e=markup.without_inert_reading(),
        f=markup.drawing_text_reading(), g=markup.visible_reading(),
    )
    alone = F.struct(
        markup.start_tags(h, "li").alias("a"), markup.elements(h, "li").alias("b"), markup.without(h, "nav").alias("c"), markup.without_hidden(h).alias("d"), markup.without_inert(h).alias("e"),
        markup.drawing_text(h).alias("f"), markup.visible(h).alias("g"),
    )
    got = rows.select(both.alias("both"), alone.alias("alone")).collect()
    assert [r.both.asDict(True) for r in got] == [r.alone.asDict(True) for r in got]


def test_spread_grows_with_rows(spark, tmp_path, monkeypatch):
    spark.range(0, 5_000, 1, 1).write.parquet(str(tmp_path / "t.parquet"))
    cores = spark.sparkContext.defaultParallelism
    assert tables.spread(spark, str(tmp_path), "t").rdd.getNumPartitions() == min(5, 2 * cores)
    monkeypatch.setattr(tables, "MOST_ROWS", 100)
    assert tables.spread(spark, str(tmp_path), "t").rdd.getNumPartitions() == 50


def test_schema_reads_a_value_once(spark, sf_dir):
    assert plan(catalog.queries()["schema_failures"](spark, sf_dir)).count("map<string,variant>") <= 3
    shown = plan(spark.range(1).select(schema.valid(F.try_parse_json(F.col("id").cast("string")), {"enum": [{"a": [1, "x", None]}, 1.0, True, "t"]}).alias("v")))
    assert "regexp_extract_all" not in shown  # constants are compared by parts, not printed for every row


def test_constants_of_all_kinds(spark):
    constants = [None, True, 0, -0.0, 1e20, "1", "", [], {}, [1, [2.0]], {"a": {"b": None}, "c": []}, list(range(70)), 10**30, 1e305]
    texts = ["null", "true", "false", "0", "-0", "0.0", "1e20", "100000000000000000000", '"1"', '""', "[]", "{}", "[1.0,[2]]", "[1,[2],3]", '{"c":[],"a":{"b":null}}', '{"a":{"b":1},"c":[]}',
             str(list(range(70))), str(10**30), "1e30", "1e305", "1"]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").withColumn("v", F.try_parse_json("t"))
    got = rows.select(*[schema.equals(F.col("v"), c).alias(f"c{n}") for n, c in enumerate(constants)], "k").orderBy("k").collect()
    same = lambda a, b: type(a) is type(b) and (len(a) == len(b) and all(map(same, a, b)) if isinstance(a, list) else a.keys() == b.keys() and all(same(a[k], b[k]) for k in a) if isinstance(a, dict) else a == b)
    floats = lambda x: [floats(y) for y in x] if isinstance(x, list) else {k: floats(y) for k, y in x.items()} if isinstance(x, dict) else float(x) if type(x) is int else x
    for r in got:
        for n, c in enumerate(constants):
            assert bool(r[f"c{n}"]) is same(floats(json.loads(texts[r.k])), floats(c)), (texts[r.k], c)


def test_deep_schemas_stay_small(spark):
    rule = {"type": "integer"}
    for _ in range(12):
        rule = {"allOf": [rule], "minimum": 1}
    assert [spark.range(n, n + 1).select(schema.valid(F.try_parse_json(F.col("id").cast("string")), rule)).first()[0] for n in (0, 1)] == [False, True]


def test_narrow_tables_are_dealt(spark, sf_dir):
    for name in ("meta_roundtrip", "sql_json_ld_nodes", "sql_validate_json", "schema_failures", "state_roundtrip", "rendered_records"):
        assert "Repartition" in plan(catalog.queries()[name](spark, sf_dir)), name


def test_meta_elements_are_read_once(spark, sf_dir):
    shown = plan(catalog.queries()["meta_roundtrip"](spark, sf_dir))
    assert shown.count("<meta(?=") == 1


def test_short_blocks_are_not_shuffled(spark, sf_dir, tmp_path, monkeypatch):
    import duckdb
    from siltstone.operators import lookups

    con = duckdb.connect()
    for name in ("orders", "part"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    wanted = sorted(con.execute(catalog.oracle_sql()["address_blocks"]).fetchall())
    for most in (0, 40, 10_000):
        monkeypatch.setattr(lookups, "MAX_RULES", most)
        found = catalog.queries()["address_blocks"](spark, sf_dir)
        assert sorted(tuple(r) for r in found.select("o_orderkey", "n_blocks", "longest").collect()) == wanted
        # with room for 40 blocks the shortest lengths are broadcast, the others joined by shuffle
        assert ("strategy=broadcast" in plan(found)) is (most > 0)
        if most == 40:
            text = plan(found)
            assert "Union" in text and "[0,1,2" in text.replace(" ", "")
    none = spark.createDataFrame([], "cidr string, low long, high long")
    assert lookups.in_ranges(spark.createDataFrame([("1.2.3.4",)], "a string"), "a", none).count() == 0


def test_batches_become_arrow_by_slices(monkeypatch):
    import pyarrow as pa

    alive = []
    read = lambda t: alive.append(t) or t + "!"
    monkeypatch.setattr(markup, "SLICE", 2)
    sizes, make = [], pa.array
    monkeypatch.setattr(markup.pa, "array", lambda values, kind: sizes.append(len(values)) or make(values, kind))
    texts = make(["a", None, "c", "d", "e"], pa.string())
    assert markup._column(texts, pa.string(), read).to_pylist() == ["a!", "!", "c!", "d!", "e!"] and sizes == [2, 2, 1]
    assert markup._column(texts.slice(0, 0), pa.string(), read).to_pylist() == []


def test_pages_are_extracted_once_before_rendering(spark, sf_dir):
    for name in ("rendered_records", "render_outcomes"):
        shown = plan(catalog.queries()[name](spark, sf_dir))
        # one scan of the stored page and one of the rendered, one join of both
        assert len(re.findall(r"\bscan\(", shown)) == 4 and len(re.findall(r"\bdecode\(\w+#", shown)) <= 2 and len(re.findall(r"\bJoin\b", shown)) == 1, name


def test_rendering_keeps_rows(spark):
    from siltstone.operators import extract

    shell, full = "<div id=root></div><script></script>", "<p>" + "word " * 30
    pages = spark.createDataFrame([(1, "https://h/1", shell), (1, "https://h/2", full), (2, "https://h/3", full), (3, "https://h/4", shell), (None, "https://h/5", shell), (4, "https://h/6", shell)], "page_id long, url string, html string")
    dom = spark.createDataFrame([(1, "<main>" + "shown " * 30 + "</main>"), (2, "<main>not wanted</main>"), (3, None), (None, "<main>of nobody</main>")], "seed_id long, dom_html string")
    rows = extract.records(extract.extract(extract.fetches_from_pages(pages)))
    found = extract.with_rendered(rows.withColumn("own", F.lit("x")), dom)
    assert found.columns == [*rows.columns, "own"] and [f.dataType for f in found.schema][:-1] == [f.dataType for f in rows.schema]
    got = {r.url[-1]: r for r in found.collect()}
    # a full page stays beside a shell of its id, one row each; a DOM that is null is an empty page
    assert {k: (r.tier, r.result[:5], r.own) for k, r in got.items()} == {"1": ("3", "shown", "x"), "2": ("1", "word ", "x"), "3": ("1", "word ", "x"), "4": ("3", "", "x"), "5": ("render-blocked", "", "x"), "6": ("render-blocked", "", "x")}
    assert got["1"].content_type == "text/html" and got["2"].content_type == "text/html; charset=utf-8" and got["6"].bytes == len(shell)


def test_canonical_links_are_read_where_there_are_any(spark):
    from siltstone.operators import extract

    rows = [(1, "https://h/a", None, "/b#c"), (2, "https://h/a", None, None), (3, "no address", None, "/b"), (4, "https://h/a", "https://g/", "http://[bad"), (5, None, None, None), (6, "https://h/a", "https://g/x/", "y")]
    page = spark.createDataFrame(rows, "i int, url string, final_url string, link string").withColumn("errors", F.array().cast(extract.NO_ERRORS))
    found = extract.with_canonical(page)
    got = [(r.canonical_url, [e.code for e in r.errors]) for r in found.orderBy("i").collect()]
    assert got == [("https://h/b", []), (None, []), (None, ["invalid_canonical_url"]), (None, ["invalid_canonical_url"]), (None, []), ("https://g/x/y", [])]


def test_empty_pages_are_read_once_a_batch():
    import pyarrow as pa

    asked = []
    read = lambda t: asked.append(t) or t + "!"
    assert markup._column(pa.array(["", None, "a", "", None], pa.string()), pa.string(), read).to_pylist() == ["!", "!", "a!", "!", "!"] and asked == ["", "a"]
