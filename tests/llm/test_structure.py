"""Conversation repair, Merkle manifests and the rule ledger against slow versions, with odd rows."""

import random
import re
import sys
import zlib
from collections import Counter, defaultdict
from hashlib import sha256
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from siltstone.llm import conversations, merkle, quality_rules

sys.path.insert(0, str(Path(__file__).parent))
import slow_conversations  # noqa: E402

TURNS = "conv_id long, turn long, role string, text string"
DOCS = "doc_id long, text string, source string, lang string, n_chars long"


def turns(n, seed):
    rng = random.Random(seed)
    roles = ["user", "assistant", "system", "tool", "usher", None, "", "assistant", "user"]
    return [
        (rng.choice([None, *range(60)]), rng.choice([None, *range(30)]), rng.choice(roles), rng.choice([None, "", " ", "a.", "b", "c! ", "d?", "é.", "x\n", "e.", "f.", "g"]))
        for _ in range(n)
    ]


def same_repairs(df):
    got = sorted(map(tuple, conversations.damage_and_repair(df).collect()), key=repr)
    assert got == sorted(slow_conversations.results(df.collect()), key=repr)
    return got


def test_repair_of_odd_rows(spark):
    rows = turns(1200, 1)
    clashing = spark.createDataFrame(rows, TURNS).withColumns({c: F.lit("own") for c in ("key", "n", "code", "times", "seg", "audit", "cost", "gaps")})
    got = same_repairs(clashing)
    assert {c for r in got for c in r[7]} == set("DKR") and any(r[0] is None for r in got)
    assert same_repairs(spark.createDataFrame(rows[:1], TURNS)) and same_repairs(spark.createDataFrame([], TURNS)) == []


def test_repair_without_rows_left(spark):
    gone = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    (row,) = same_repairs(spark.createDataFrame([(gone, 0, "user", "a.")], TURNS))
    assert row == (gone, 0, 0, 0, 0, 0, 0, "", sha256(b"").hexdigest())


def test_repair_of_long_conversations(spark, monkeypatch):
    monkeypatch.setattr(conversations, "SEGMENT", 50)
    monkeypatch.setattr(conversations, "TOGETHER", 300)
    rng = random.Random(2)
    rows = [(7, i, rng.choice(["user", "assistant"]), f"t{i}" + rng.choice([".", ""])) for i in range(4000)]
    rows += [(None, i // 2, rng.choice(["user", "assistant", "tool"]), f"t{i}" + rng.choice([".", ""])) for i in range(700)] + [(8, i, "user", "same.") for i in range(500)]
    same_repairs(spark.createDataFrame(rows + rows[:300] * 3 + turns(300, 3), TURNS).repartition(6))


def test_automaton_stays_small_and_inserts_where_that_is_cheapest():
    a = conversations.Determinised()
    rng = random.Random(4)
    codes = conversations.np.array([rng.choice([0, 1, 2, 3, 4, 5, 6, 7, 8]) for _ in range(20_000)], conversations.np.int8)
    a.scan(codes, conversations.np.array([0, len(codes)]), [conversations.FINAL])
    assert len(a.vectors) < 40
    assert conversations.FINAL == (0, 10, 5, 0) and conversations.finish(1) == "II" and conversations.finish(2) == "I"


def low(text):
    return text if text is None else re.sub("[A-Z]", lambda m: m[0].lower(), text)


def slow_manifest(rows):
    h = lambda *p: sha256("".join(p).encode()).hexdigest()
    enc = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, t: h(*map(enc, (r.doc_id, r.source, r.lang, r.n_chars, t)))

    def tree(nodes):
        levels = [nodes]
        while len(nodes) > 1:
            nodes = [h(*nodes[k : k + 16]) for k in range(0, len(nodes), 16)]
            levels.append(nodes)
        return levels

    def path(levels, i):
        for level in levels[:-1]:
            b = i // 16 * 16
            yield level[b:i], level[i + 1 : b + 16]
            i //= 16

    groups = defaultdict(list)
    for r in rows:
        groups[r.source].append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for g in groups.values():
        g.sort(key=lambda r: (r.doc_id is not None, r.doc_id or 0, leaf(r, r.text)))
    trees = {s: tree([leaf(r, r.text) for r in g]) for s, g in groups.items()}
    top = tree([trees[s][-1][0] for s in order])
    for j, s in enumerate(order):
        for i, r in enumerate(groups[s]):
            p = [*path(trees[s], i), *path(top, j)]
            folded = leaf(r, low(r.text) if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0 else r.text)
            for a, b in p:
                folded = h(*a, folded, *b)
            yield r.doc_id, leaf(r, r.text), trees[s][-1][0], top[-1][0], h(*[x for a, b in p for x in a + b]), folded, folded == top[-1][0]


def same_manifest(df):
    got = sorted(map(tuple, merkle.documents_manifest(df).collect()), key=repr)
    assert got == sorted(slow_manifest(df.collect()), key=repr)
    return got


def test_manifest_of_odd_rows(spark):
    rows = [(None, "a", None, "en", 3), (None, "A", None, None, None), (1, None, "s", None, 0), (1, "X", "s", "q", 1), (1, "X", "s", "q", 1), (2, "", "", None, 1), (5, "Éa B" * 20_000, "É", "e", 1)]
    rows += [(i, f"T{i}", "big", "e", i) for i in range(4500)] + [(9, "Same", "copies", "e", 1)] * 40 + [(i, "x", f"s{i}", "e", 1) for i in range(40)]
    df = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("own") for c in ("digest", "tree", "idx", "block", "path", "leaf", "root")})
    got = same_manifest(df)
    assert len(got) == len(rows) and {r[-1] for r in got} == {True, False}


@pytest.mark.parametrize("n", [0, 1, 2, 16, 17, 257])
def test_manifest_sizes(spark, n):
    assert len(same_manifest(spark.createDataFrame([(i, "T", "s", "e", 1) for i in range(n)], DOCS))) == n


def test_manifest_of_blocks_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(merkle, "HEIGHT", 1)  # two walks above the first
    same_manifest(spark.createDataFrame([(i, f"T{i}", "s", "e", 1) for i in range(700)] + [(i, f"T{i}", "t", "e", 1) for i in range(17)], DOCS))


def slow_measures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    count = Counter(windows)
    inside = {k + j for k, w in enumerate(windows) if count[w] > 1 for j in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(inside)


def test_rules_of_odd_rows(spark):
    rng = random.Random(5)
    texts = [None, "", " \t\n", "a b a b a b", "x\nx\n x\n\n\n", "é" * 9 + "\x85 z", "||| $$$ a### B!!", "one " * 60, "A " * 30 + "b " * 30, "w1 w2 w3 " * 50_000]
    texts += [" ".join(rng.choice(["a", "b", "été", "c\n", "#", "D!!"]) for _ in range(rng.randrange(200))) for _ in range(200)]
    docs = spark.createDataFrame([(i if i % 7 else None, t) for i, t in enumerate(texts)], "doc_id long, text string")
    df = docs.withColumns({c: F.lit("own") for c in ("n_words", "failed", "measured", "kept", "n", "rule")})
    found = quality_rules.with_verdict(quality_rules.ledger(df)).collect()
    assert len(found) == len(texts) and all(r["measured"] == "own" for r in found)
    want = Counter((t, *slow_measures(t)) for t in texts)
    assert Counter((r.text, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in found) == want
    for r in found:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) == bool(r.failed & 3)
        assert not (r.base_failed and r.kept)


def test_ablations_equal_policies_without_a_rule(spark, sf_dir):
    found = quality_rules.ledger(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("failed")
    masks = [r.failed for r in found.collect()]
    bits = {r.name: 1 << r.bit for r in quality_rules.RULES}

    def kept(mask, p, without=None):
        hard, soft = (sum(bits[n] for n in names if n != without) for names in (p.rejects, p.soft))
        return not mask & hard and (mask & soft).bit_count() <= p.allowed

    for p in (quality_rules.BASE, quality_rules.CURRENT, quality_rules.STRICT):
        got = {r.rule: r for r in quality_rules.ablations(found, (p,)).collect()}
        assert set(got) == set(bits)
        for name, bit in bits.items():
            assert got[name].n_failed == sum(bool(m & bit) for m in masks)
            assert got[name].n_removed == sum(bool(m & bit) and not kept(m, p) and name in p.rejects + p.soft for m in masks)
            assert got[name].n_only == sum(not kept(m, p) and kept(m, p, name) for m in masks)
    assert quality_rules.ablations(found.limit(0)).agg(F.sum("n_failed")).first()[0] == 0


def test_rules_keep_good_and_drop_bad(spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = quality_rules.with_verdict(quality_rules.ledger(docs)).join(labels, "doc_id").where("not base_failed").select("quality", "kept").collect()
    good, bad = [r.kept for r in got if r.quality == 1], [r.kept for r in got if r.quality == 0]
    assert sum(good) >= 0.99 * len(good) and sum(bad) <= 0.02 * len(bad)
