"""Whole queries against slow versions of their rules."""

import itertools
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from siltstone.llm import quality, registry, secret_scan

WORD = re.compile(r"[^\W_]+")


def slow_coverage(doc, item, m):
    """Words of an item under greedily laid tiles: the longest common run first, in order of item, then document position."""
    at = {}
    for p in range(len(doc) - m + 1):
        at.setdefault(tuple(doc[p : p + m]), []).append(p)
    free_d, free_i = [True] * len(doc), [True] * len(item)
    while True:
        best, found = m - 1, []
        for q in range(len(item) - m + 1):
            for p in at.get(tuple(item[q : q + m]), ()):
                n = 0
                while q + n < len(item) and p + n < len(doc) and free_i[q + n] and free_d[p + n] and doc[p + n] == item[q + n]:
                    n += 1
                if n > best:
                    best, found = n, [(q, p)]
                elif n == best and n >= m:
                    found.append((q, p))
        if not found:
            return free_i.count(False)
        for q, p in sorted(found):
            if all(free_i[q : q + best]) and all(free_d[p : p + best]):
                free_i[q : q + best] = free_d[p : p + best] = [False] * best


def test_decontamination_query(spark, sf_dir):
    docs = {r.doc_id: WORD.findall((r.text or "").casefold()) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    items = {r.item_id: WORD.findall(r.text.casefold()) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    want = {}
    for d, words in docs.items():
        runs = {tuple(words[k : k + 5]) for k in range(len(words) - 4)}
        for i, item in items.items():
            if len(item) < 5:
                if item and any(words[k : k + len(item)] == item for k in range(len(words) - len(item) + 1)):
                    want[d, i] = len(item)
            elif any(tuple(item[k : k + 5]) in runs for k in range(len(item) - 4)):
                covered = slow_coverage(words, item, 5)
                if 2 * covered >= len(item):
                    want[d, i] = covered
    got = {(r.doc_id, r.item_id): r.covered for r in registry.op2_decontamination(spark, sf_dir).collect()}
    assert got == want and want


TAILS = [
    "", ' password = "hunter22"', " Token:abc", " api_key='abcdef' secret=", " AKIA" + "A1" * 9, " AKIAAKIA" + "B" * 15, " " + "0af3" * 6 + "g", " secret = " + "ab12" * 8, "é passwd:passwd:12345678 x", " APIKEY  :=  zzzzzz/",
    " token='AKIA" + "C" * 20 + "'", ' "password" : "a.b=c-d"', " tokentoken = qwertz1", "AKIA" * 9, " ſecret = abcdefgh", " password==abcdef",
]


def test_base_findings_of_the_query(spark, sf_dir, tmp_path):
    """The fixed patterns, character by character, over a whole table."""
    tail = F.element_at(F.array(*[F.lit(t) for t in TAILS]), (F.pmod("doc_id", F.lit(len(TAILS))) + 1).cast("int"))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("text", F.concat(F.coalesce("text", F.lit("")), tail, F.lit(" "), F.coalesce("text", F.lit("")), tail))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    sf_dir = str(tmp_path)
    key = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
    value = key | set("+/_.=-")

    def assigns(t):
        low, at, out = t.lower() if t.isascii() else "".join(c.lower() if c < "\x80" else c for c in t), 0, []
        while at < len(t):
            word = next((w for w in ("password", "passwd", "secret", "token", "api_key", "apikey") if low.startswith(w, at)), None)
            if word:
                p = at + len(word)
                p += t[p : p + 1] in ('"', "'") and p < len(t)
                while t[p : p + 1] == " ":
                    p += 1
                if t[p : p + 1] in (":", "=") and p < len(t):
                    p += 1
                    while t[p : p + 1] == " ":
                        p += 1
                    p += t[p : p + 1] in ('"', "'") and p < len(t)
                    e = p
                    while e < len(t) and t[e] in value:
                        e += 1
                    if e > p:
                        out += [("assign", at, e)] * (e - p >= 6)
                        at = e
                        continue
            at += 1
        return out

    def runs(t, kind, alphabet, least, head=""):
        at, out = 0, []
        while at < len(t):
            e = at + len(head)
            if t.startswith(head, at) and (e < len(t) and t[e] in alphabet):
                while e < len(t) and t[e] in alphabet:
                    e += 1
                out += [(kind, at, e)] * (e - at >= least)
                at = e
            else:
                at += 1
        return out

    order = {"assign": 0, "access": 1, "hex": 2}
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    found = 0
    for r in registry.op4_secret_scan(spark, sf_dir).collect():
        t = texts[r.doc_id]
        spans = assigns(t) + runs(t, "access", set("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"), 20, "AKIA") + runs(t, "hex", set("0123456789abcdef"), 24)
        spans.sort(key=lambda s: (s[1], order[s[0]]))
        counts = Counter(k for k, _, _ in spans)
        assert (r.n_assign, r.n_access, r.n_hex) == (counts["assign"], counts["access"], counts["hex"]) and r.base_sha256 == secret_scan.sha256(spans)
        assert [s for s in r.spans.split(",") if s and not s.startswith("net")] == [f"{k}:{a}:{b}" for k, a, b in spans]
        found += len(spans)
    assert found > 200


def slow_features(text):
    """What the classifier sees of a text, by its bytes."""
    raw = text.encode()
    lower, upper, digit, other = (sum(1 for b in raw if a <= b <= z) for a, z in ((97, 122), (65, 90), (48, 57), (128, 255)))
    size = max(1, len(raw))
    count = lambda marks: sum(1 for b in raw if b in marks)
    words = [w for w in re.split(rb"[ \t-\r]+", raw) if w]
    wordy = lambda b: chr(b).isalnum() if b < 128 else True
    marked = [w for w in words if len(w) > 2 and not wordy(w[-1]) and not wordy(w[-2])]
    bare = [w for w in words if len(w) <= 2 and not wordy(w[0]) and not (wordy(w[-1]) or w[-1] in b".,;:?!\"')")]
    folded = [w.lower() for w in words]
    n = len(words)
    phrases = [tuple(folded[k : k + 5]) for k in range(n - 4)] if n >= 5 else [tuple(folded)] * (n > 0)
    lines = [x for x in raw.split(b"\n") if x]
    letters = lower + upper + other
    return [
        math.log1p(len(raw)), upper / max(letters, 1), digit / size, count(b"!#$%&*+/<=>@[\\]^_`{|}~") / size, count(b".,;:?") / size, count(b"|") / size, other / size,
        sum(map(len, words)) / max(n, 1), len(marked) / max(n, 1), len(bare) / max(n, 1), len(set(folded)) / max(n, 1) ** 0.8, 1 - len(set(phrases)) / max(len(phrases), 1),
        1 - len(set(lines)) / max(len(lines), 1), len(raw) / max(len(lines), 1), sum(w.endswith(b".") for w in words) / max(n, 1),
    ]


def test_quality_features(spark, sf_dir):
    texts = [r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()] + ["", " ", "a", "É x. x. ** \n\n x", "one two\none two\n" * 9]
    got = quality.features(pa.array(texts))
    for k, t in enumerate(texts):
        want = slow_features(t)
        assert np.allclose(got[k], want, atol=1e-9), [(n, g, w) for n, g, w in zip(quality.FEATURES, got[k], want, strict=True) if abs(g - w) > 1e-9]


def slow_tree(g, h, depth):
    """The best cut of ordered bins by the gain of its two sides, then the same inside, by trying every cut."""
    leaf = sum(g) / (sum(h) + 1.0)
    best, at = sum(g) ** 2 / (sum(h) + 1.0), None
    for k in range(1, len(g)) if depth else ():
        gain = sum(sum(g[s]) ** 2 / (sum(h[s]) + 1.0) for s in (slice(0, k), slice(k, None)))
        if sum(h[:k]) >= 1.0 and sum(h[k:]) >= 1.0 and gain > best + 1e-12:
            best, at = gain, k
    return [leaf] * len(g) if at is None else slow_tree(g[:at], h[:at], depth - 1) + slow_tree(g[at:], h[at:], depth - 1)


def test_boosting_is_brute_force():
    rng = np.random.default_rng(2)
    for _ in range(30):
        g, h = rng.normal(size=9), rng.uniform(0.2, 2, size=9)
        assert np.allclose(quality._tree(g, h, 2), slow_tree(g.tolist(), h.tolist(), 2))
    x, y = rng.normal(size=(300, 3)), (rng.random(300) < 0.5).astype(float)
    model = quality.fit(x, y, bins=6, rounds=2, n_pairs=0)
    good = (y.sum() + 1) / 302
    z, tables = np.full(300, math.log(good / (1 - good))), [np.zeros(len(c) + 1) for c in model.cuts]
    bins = [np.searchsorted(c, x[:, k], "right") for k, c in enumerate(model.cuts)]
    for _, k in itertools.product(range(2), range(3)):
        p = 1 / (1 + np.exp(-z))
        g, h = ([sum(v[bins[k] == b]) for b in range(len(tables[k]))] for v in (y - p, p * (1 - p)))
        step = 0.1 * np.array(slow_tree(g, h, 2))
        tables[k] += step
        z += step[bins[k]]
    assert all(np.allclose(a, b) for a, b in zip(model.tables, tables, strict=True))
    assert np.allclose(model.score(x), 1 / (1 + np.exp(-z)))
