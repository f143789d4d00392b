"""Rows that the operators once got wrong."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.llm import decontaminate, line_dedup, ngram_join, packing, quality, storage, warc


def test_lines_of_one_id_and_different_texts(spark):
    rows = [(0, "a b c\n" * 3), (1, "a b c\n" * 3), (1, "x y z\nx y\nx"), (2, "\t\n\t\n\u3000"), (3, "\t\n\t\n\u3000")]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.text, r.n_removed) for r in got) == [
        (0, "a b c\na b c\na b c\n", 0), (1, "", 4), (1, "x y z\nx y\nx", 0), (2, rows[3][1], 0), (3, rows[4][1], 0)
    ]


def test_tiling_ends_where_hashes_meet_and_words_differ():
    assert decontaminate.tile(np.arange(9), np.arange(9) + 1, np.array([0]), np.array([0]), 5) == []


def test_benchmark_is_dealt_by_its_words(spark):
    items = spark.createDataFrame([(k, "|".join(f"w{k * 9 + i}" for i in range(9))) for k in range(10)], "item_id long, text string")
    made = list(decontaminate.blocks(items, "item_id", "text", 5, 30, False))
    assert [len(b.ids) for b in made] == [3, 3, 3, 1]
    docs = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(90)))], "doc_id long, text string")
    got = decontaminate.contaminated(docs, items, max_words=30).collect()
    assert sorted(r.item_id for r in got) == list(range(10))


def test_one_id_in_very_many_rows_stays_bounded(spark):
    docs = spark.createDataFrame([(k % 2, f"some words {k}") for k in range(600)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k) for k in range(2)], "doc_id long, quality int")
    seen = []
    fit, quality.fit = quality.fit, lambda x, y: seen.append(len(y)) or fit(x, y)
    try:
        quality.train(docs, labels, max_rows=50)
    finally:
        quality.fit = fit
    assert seen[0] <= 50


def test_archives_are_bounded_by_bytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "LARGE", 1_000)
    monkeypatch.setattr(warc, "FILE_BYTES", 20_000)
    rows = [(k, f"http://x/{k}", "abcdefgh" * (1_000 if k % 5 == 0 else 10) + str(k)) for k in range(40)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    warc.write_archives(df, str(tmp_path / "a"), compress=False)
    got = warc.read_archives(spark, str(tmp_path / "a")).collect()
    assert sorted(int(r.record_id.rpartition(":")[2]) for r in got if r.part == "record") == list(range(40))
    sizes = spark.read.format("binaryFile").load(str(tmp_path / "a")).select("length").collect()
    assert max(r.length for r in sizes) < 40_000 and len(sizes) == 5


def test_folded_header_lines_are_read():
    plain = warc.record(1, "http://x/", b"abc", None, "2024-01-01T00:00:00Z") + b"\r\n"
    folded = plain.replace(b"WARC-Date: 2024", b"X-Note: one\r\n  two\r\n\tthree\r\nWARC-Date:\r\n 2024")
    rows = list(warc.salvage(folded))
    assert [(r["part"], r.get("payload")) for r in rows] == [("record", b"abc")]


def test_archives_of_a_round_trip_are_removed(spark):
    df = spark.createDataFrame([(1, "http://x/", "abc")], "page_id long, url string, html string")
    assert warc.archive_round_trip(df).count() == 1
    folder = spark._jvm.org.apache.hadoop.fs.Path(storage.shared_dir(spark))
    names = [f.getPath().getName() for f in folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder)]
    assert not [n for n in names if n.startswith("warc-") and not n.startswith("warc-read")]


def test_half_empty_sequences_of_all_groups_are_packed_again(spark):
    sizes = [(k, 0, 0, 700 if k % 7 else 2_000, k) for k in range(400)]
    pieces = spark.createDataFrame(sizes, "doc_id long, piece int, start long, length long, ids_crc32 long")
    got = packing.pack(pieces, 40).toPandas()
    assert sorted(got.doc_id) == list(range(400))
    for _, rows in got.groupby("sequence_id"):
        rows = rows.sort_values("offset")
        assert rows["length"].sum() <= 2048 and (rows["offset"] == rows["length"].cumsum() - rows["length"]).all()
    fills = got.groupby("sequence_id")["length"].sum()
    assert (fills <= 1024).sum() <= 1
    again = packing.pack(pieces.repartition(3), 40).toPandas()
    key = ["doc_id", "sequence_id", "offset"]
    assert got[key].sort_values(key).values.tolist() == again[key].sort_values(key).values.tolist()


def test_shared_folder(spark):
    assert storage.shared_dir(spark) == storage.shared_dir(spark)

    class Conf:
        def get(self, name, default=None):
            return default

    class Context:
        master = "yarn"
        getConf = Conf
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        storage.shared_dir(Session())


def test_score_of_a_clashing_name_is_replaced(spark):
    df = spark.createDataFrame([(1, "text", "own")], "doc_id long, text string, score string")
    assert 0 <= quality.with_score(df, quality.Gam()).select(F.col("score")).first()[0] <= 1


def test_near_clusters_without_links_write_few_pairs(spark, monkeypatch):
    """Two groups of near copies just below the threshold of each other: work on them stays, what is written is linear."""
    words = [f"w{i}" for i in range(400)]
    other = words[:36] + [f"x{i}" for i in range(14)] + words[50:]
    texts, m = [], 150
    for base in (words, other):
        for k in range(m):
            own = list(base)
            own[60 + 2 * k] = f"own{k}"
            texts.append(" ".join(own))
    texts[m // 2] = " ".join(words[:43] + other[43:])  # links both
    texts += [" ".join(own[20:]) for own in (words,)]
    written = {}
    save = storage.Scratch.save

    def counted(self, df, step, *rest):
        out = save(self, df, step, *rest)
        written[step] = out.count()
        return out

    monkeypatch.setattr(ngram_join.Scratch, "save", counted)
    monkeypatch.setattr(ngram_join, "DENSE", 1)
    for keep in (True, False):
        used = texts if keep else texts[: m // 2] + texts[m // 2 + 1 :]
        df = spark.createDataFrame(list(enumerate(used)), "doc_id long, text string")
        got = {r.doc_id: r.component_id for r in ngram_join.jaccard_components(df, n=1, num=962, den=1000).collect()}
        sets = [set(t.split()) for t in used]
        parent = list(range(len(used)))

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a in range(len(sets)):
            for b in range(a):
                if 1000 * len(sets[a] & sets[b]) >= 962 * len(sets[a] | sets[b]):
                    x, y = find(a), find(b)
                    parent[max(x, y)] = min(x, y)
        assert got == {d: find(d) for d in got}
        assert written["rest"] + written["more"] <= 6 * len(used), written


def test_any_text_of_a_repeated_id_links(spark):
    one, two = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(5, one), (5, two), (7, one), (9, two), (11, "other words entirely")]
    got = ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), n=4, num=85).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(5, 5), (5, 5), (7, 5), (9, 5), (11, 11)]
