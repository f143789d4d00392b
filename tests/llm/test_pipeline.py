"""The pipeline's stages against plain Python on the smallest table."""

import re

import __spark_entry__
import corpus_pipeline
from siltstone.llm import registry


def shingles(text, n):
    w = text.encode().lower().split()
    return {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    kept = {}
    at = docs
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, at, sf_dir)
        at = spark.createDataFrame(made.collect(), made.schema)
        kept[name] = {r.doc_id: r for r in at.collect()} if name != "packing" else at.toPandas()
    assert list(kept) == ["quality", "lines", "near_duplicates", "benchmark", "packing"]
    known = [d for d in labels if d in {r.doc_id for r in docs.collect()}]
    assert sum((d in kept["quality"]) == (labels[d] == 1) for d in known) >= 0.97 * len(known)
    # one document of each group of similar texts stays
    after, before = kept["near_duplicates"], kept["lines"]
    sets = {d: shingles(r.text, 5) for d, r in before.items()}
    ids = sorted(sets)
    parent = {d: d for d in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[:i]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    assert set(after) == {d for d in ids if find(d) == d}
    items = [re.findall(r"[^\W_]+", r.text.lower()) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    whole = {d for d, r in after.items() if any(" ".join(i) in " ".join(re.findall(r"[^\W_]+", r.text.lower())) for i in items)}
    assert whole and not whole & set(kept["benchmark"])
    assert set(kept["packing"].doc_id) == set(kept["benchmark"])
    assert len(set(after) - set(kept["benchmark"]) - whole) <= 0.02 * len(after)


def test_registered_names():
    names = list(__spark_entry__.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert set(registry.oracle_sql()) <= set(names)


def test_rows_of_one_id_are_decided_by_a_rule(spark, sf_dir):
    words = " ".join(f"w{k}" for k in range(30))
    rows = [
        (1, words, "en", "b", 3), (1, words, "en", "a", 2), (1, words, "en", "b", 1), (1, "another text of this id", "en", "a", 9), (2, words + " more", "en", "a", 1),
        (3, "alone", "en", "a", 1), (None, "alone", "en", "a", 1), (None, "alone", "en", "a", 1),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(map(tuple, corpus_pipeline.near_duplicates(spark, docs, sf_dir).collect()), key=repr)
    assert got == sorted([rows[1], rows[3], rows[5], rows[6], rows[7]], key=repr)


def test_stages_with_odd_rows(spark, sf_dir):
    rows = [
        (1, "one two three four five six seven", "en", "s", 5), (1, "one two three four five six seven", "en", "s", 5), (2, None, None, None, None), (3, "", "en", "s", 0),
        (None, "one two three four five six seven", "en", "s", 1), (None, None, None, None, None), (4, " ".join(f"w{i % 601}" for i in range(50_000)), "en", "s", 9),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "'x' AS n", "'y' AS id", "'z' AS __score")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        if name != "packing":
            assert out.columns == list(corpus_pipeline.COLUMNS)
        ids = [r.doc_id for r in out.collect()]
        assert (name == "packing" or len(ids) <= len(rows)) and (name == "quality" or {2, 3, 4, None} <= set(ids))
        assert stage(spark, docs.limit(0), sf_dir).count() == 0
