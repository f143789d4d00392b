"""Nulls in any column, empty and very long texts, ties, repeated rows, empty tables, clashing names."""

import pytest
from pyspark.sql import functions as F

from siltstone.llm import decontaminate, embedding_join, html_main, line_dedup, ngram_join, packing, quality, secret_scan, sharding, warc

LONG = " ".join(f"word{i % 977}" for i in range(150_000))
EXTRA = ("id", "key", "sig", "row", "body", "lines", "covered", "kept", "hits", "__hits", "score", "slot", "shard", "findings", "n", "bits", "piece", "h", "start")
ROWS = [
    (1, "a b c d e f\nx\ny", "s"), (1, "a b c d e f\nx\ny", "s"), (2, None, None), (3, "", "s"), (None, "a b c d e f\nx\ny", None), (None, None, None), (4, LONG, "s"),
    (5, LONG, "t"), (6, "   \n\t", "s"), (7, "token = abcdefgh1", "s"),
]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, source string")
    return df.select("*", *[F.lit(f"own {c}").alias(c) for c in EXTRA])


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, "word5 word6 word7 word8 word9 word10"), (2, None), (None, "x y z"), (3, "a b")], "item_id long, text string")


def test_line_dedup(docs):
    out = line_dedup.dedup_lines(docs)
    rows = out.collect()
    assert len(rows) == len(ROWS) and set(docs.columns) | {"n_lines", "n_removed"} == set(out.columns)
    assert all(r[c] == f"own {c}" for r in rows for c in EXTRA)
    assert sum(r.n_removed for r in rows) == 0  # rows of one id are one document, null ids take no part
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0


def test_quality(docs, spark):
    labels = spark.createDataFrame([(1, 1), (4, 0), (5, 0), (None, 1), (7, None), (3, 1)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    rows = quality.with_score(docs, model).collect()
    assert len(rows) == len(ROWS) and all(0 <= r.score <= 1 for r in rows)
    assert quality.with_score(docs.limit(0), model).count() == 0 and quality.train(docs.limit(0), labels).score is not None


def test_decontamination(docs, bench):
    got = decontaminate.contaminated(docs, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(4, 1), (5, 1)}
    clean = decontaminate.clean_documents(docs, bench)
    assert clean.columns == docs.columns and all(r["__hits"] == "own __hits" for r in clean.collect())
    assert clean.count() == len(ROWS) - 2 and decontaminate.contaminated(docs, bench.limit(0)).count() == 0
    assert decontaminate.contaminated(docs.limit(0), bench).count() == 0


def test_ngram_join(docs):
    rows = ngram_join.jaccard_components(docs).collect()
    assert len(rows) == len(ROWS)
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append((r.n_shingles, r.component_id))
    assert by[1] == [(4, 1), (4, 1)] and by[2] == [(0, 2)] and by[3] == [(0, 3)] and by[5][0][1] == 4 and by[6] == [(0, 6)]
    assert all(c is None for _, c in by[None])
    assert ngram_join.jaccard_components(docs.limit(0)).count() == 0


def test_secret_scan(docs):
    rows = secret_scan.digest(secret_scan.with_findings(docs, name="__found"), name="__found").collect()
    assert len(rows) == len(ROWS) and sum(r.n_assign for r in rows) == 1
    assert secret_scan.with_findings(docs.limit(0)).count() == 0


def test_packing(docs):
    rows = packing.pack_documents(docs).collect()
    assert sorted({r.doc_id for r in rows if r.doc_id}) == [1, 2, 3, 4, 5, 6, 7] and sum(r.doc_id is None for r in rows) == 2
    assert [r.length for r in rows if r.doc_id in (2, 3)] == [1, 1]
    assert packing.pack_documents(docs.limit(0)).count() == 0


def test_sharding(docs):
    rows = sharding.assign_shards(docs, "doc_id", 8, 101).collect()
    assert len(rows) == len(ROWS) and all(0 <= r.shard < 8 for r in rows) and len({r.shard for r in rows if r.doc_id is None}) == 1
    assert sharding.assign_shards(docs.limit(0), "doc_id", 8, 101).count() == 0


def test_embeddings(spark):
    v = [1.0] * 8
    rows = [
        (1, v, 0), (1, v, 0), (2, [2.0] * 8, 0), (3, None, 0), (4, [0.0] * 8, 0), (5, [float("nan")] * 8, 0), (6, [None] * 8, 0), (7, v, None), (8, v, 1), (None, v, 0),
        (9, v[:4], 0), (10, [float("inf")] + v[1:], 0), (11, [-1.0] * 8, 0),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("n_links", F.lit(9)).withColumn("rep", F.lit(9))
    got = embedding_join.near_duplicates(df).collect()
    links = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got}
    assert len(got) == len(rows) and links[2] == (2, 1, False) and links[1] == (2, 1, True)
    assert all(links[k] == (0, k, True) for k in (3, 4, 5, 6, 7, 8, 9, 10, 11)) and links[None] == (0, None, True)
    assert embedding_join.near_duplicates(df.limit(0)).count() == 0


def test_pages(spark):
    rows = [(1, "http://a/x", "<p>hi</p>"), (1, "http://a/x", "<p>hi</p>"), (2, None, None), (None, "::odd::", "<p>no id</p>"), (3, "http://b/", "<p>" + LONG)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("own")).withColumn("text", F.lit("own"))
    got = html_main.main_text(df).collect()
    assert len(got) == 5 and sorted(r.n_chars for r in got) == [0, 2, 2, 5, len(LONG)]
    assert html_main.main_text(df.limit(0)).count() == 0
    back = warc.archive_round_trip(df).collect()
    assert len(back) == 5 and sorted(r.record_type for r in back) == ["response"] * 5
    assert warc.archive_round_trip(df.limit(0)).count() == 0
