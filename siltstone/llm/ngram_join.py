"""Self-join of documents by the Jaccard similarity of their word n-grams, with token-combination prefixes.

A document's set holds the hashes of its distinct n-word shingles. All shingles have one global order: rare
ones first, then frequent ones, each by hash. Two sets that reach the threshold share enough of what comes
first in that order, so only a prefix is indexed. A rare shingle is indexed alone. Frequent ones are dealt
into small classes by hash and only pairs within a class are indexed, which makes frequent shingles
selective; each class costs the prefix one shingle, so the prefix is extended until

    rare shingles + sum over classes of (its shingles - 1)  >  shingles that a linked set may lack.

Classes depend on a level of the set's size, so that a class holds a few shingles of a prefix in short and
long documents alike; linked sets differ by one level at most, and a document is indexed under its own
level and the next. With this the join is exact at any choice of which shingles count as frequent. That
choice is made from counts over all documents; the most frequent ``MAX_FREQUENT`` are broadcast.

Links within a bucket of the index are found without writing down its pairs: every document is compared
with the bucket's smallest (a number of pairs linear in the bucket), components of these links are formed,
and only buckets that still hold several components go on to a blockwise comparison of documents from
different components. Pairs must pass the size filter and a parity bitmap filter (a lower bound of the
symmetric difference) before the sets themselves are compared: few pairs by a join with their sets; blocks in
which more than ``DENSE`` pairs a document pass get the sets of their documents, compare them in place, and give a
forest of links, so what is written is linear in a block. Equal sets link by a 128-bit fingerprint
and their size. No link between components is lost, so the components are exact.

Scale: every step is a map over rows or a shuffle by shingle, signature or document; hot signatures are
combined before the shuffle or joined in a way adaptive execution can split, large buckets are dealt into
block pairs, and nothing but the bounded list of frequent shingles reaches the driver.

Cases: null or blank text is the empty set, linked with nothing; a text of fewer than n words is one
shingle; a null id is given no component; rows that repeat an id count as one node with the links of all its
texts; very long texts are read whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .graph import components
from .storage import Scratch

#: Most shingles that count as frequent; 8 bytes each are broadcast.
MAX_FREQUENT = 500_000
#: Shingles in fewer documents than this are never called frequent.
LEAST_FREQUENT = 24
#: Shingles that one task counts before it hands on a partial count.
FLUSH = 2_000_000
#: Rows of texts or sets that are in an Arrow batch.
BATCH_ROWS = 1_000
#: Documents of a bucket that are compared with each other in one block pair.
BLOCK = 2_000
#: Shingles of the documents of a block, on average.
BLOCK_SHINGLES = 2_000_000
#: Pairs for each document of a block that may be written down.
DENSE = 4
#: Rows, and bytes of bitmaps or sets, that a group of block pairs has on average.
GROUP_ROWS, GROUP_BYTES = 4_000, 32 << 20
#: Levels whose smallest set is below this index frequent shingles alone, too.
LEAST_COMBINED = 20
#: Classes per shingle of a set at a level.
CLASSES = 0.07
#: Smallest buckets of a document by which pairs that meet oftener are recognised.
LOWEST = 12
#: Least bits of a bitmap per shingle. Few collisions keep its bound close to the true difference.
BITS = 4
U = np.uint64


class Threshold:
    """Similarity num / den and the size levels that follow from it."""

    def __init__(self, num: int, den: int) -> None:
        if not 0 < num <= den:
            raise ValueError("the threshold must be in (0, 1]")
        self.num, self.den = num, den
        step = max(0.05, num / den - 0.001)
        bounds, x = [1], 1.0
        while bounds[-1] < 1 << 40:
            x /= step
            bounds.append(max(bounds[-1] + 1, math.floor(x)))
        self.bounds = np.array(bounds)

    def lacking(self, n: np.ndarray) -> np.ndarray:
        """Shingles of a set of n that a linked set may lack."""
        return n - -(-self.num * n // self.den)

    def level(self, n: int) -> int:
        return int(np.searchsorted(self.bounds, n, "right")) - 1

    def classes(self, level: int) -> int:
        """Number of classes at a level, 0 if frequent shingles are indexed alone there."""
        least = int(self.bounds[level])
        return 0 if least < LEAST_COMBINED else max(1, int(CLASSES * least))

    def may_link(self, a, b, differ):
        """Whether sizes a, b and a lower bound of the symmetric difference allow a link."""
        return (self.num + self.den) * differ <= (self.den - self.num) * (a + b)


def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from tv.slices(batch, text=1)


def sets_of(batch: pa.RecordBatch, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingle, row), distinct and sorted, of a batch whose second column is text."""
    raw, offsets = tv.buffer_of(batch.column(1))
    return tv.distinct(*tv.shingles(tv.words(raw, offsets, tv.table(tv.SPACES)), n))


def frequency_key(values: np.ndarray, buckets: int) -> np.ndarray:
    return (values >> U(32)) % U(buckets) << U(32) | values & U(0xFFFFFFFF)


def partial_counts(df: DataFrame, n: int, buckets: int) -> DataFrame:
    """(bucket, alone, more, times): shingles of a bucket that a task saw once, and oftener with counts."""

    def flush(held: list[np.ndarray]) -> pa.RecordBatch:
        keys, times = np.unique(np.concatenate(held), return_counts=True)
        bucket = (keys >> U(32)).astype(np.int64)
        at = np.flatnonzero(np.diff(bucket, prepend=-1))
        rows = []
        for i, j in zip(at, [*at[1:], len(keys)], strict=True):
            part, k = keys[i:j].astype(np.uint32), times[i:j]
            rows.append((int(bucket[i]), part[k == 1].tobytes(), part[k > 1].tobytes(), k[k > 1].astype(np.uint32).tobytes()))
        kinds = [pa.int64(), pa.binary(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["bucket", "alone", "more", "times"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for part in parts(batches):
            values, _ = sets_of(part, n)
            if len(values):
                held.append(frequency_key(values, buckets))
                size += len(values)
            if size >= FLUSH:
                yield flush(held)
                held, size = [], 0
        if held:
            yield flush(held)

    return df.mapInArrow(run, "bucket long, alone binary, more binary, times binary")


def frequent_shingles(df: DataFrame, n: int, buckets: int, least: int = LEAST_FREQUENT, most: int = MAX_FREQUENT) -> np.ndarray:
    """Sorted keys of the shingles in most documents: at most ``most``, each in at least ``least``."""

    def total(key: tuple, group: pa.Table) -> pa.Table:
        joined = lambda c: np.frombuffer(b"".join(group[c].to_pylist()), np.uint32)
        alone, more, times = joined("alone"), joined("more"), joined("times")
        # a shingle that counts must be in many partial counts or often in one
        keys, inverse = np.unique(np.concatenate([alone, more]), return_inverse=True)
        sums = np.bincount(inverse, weights=np.concatenate([np.ones(len(alone)), times])).astype(np.int64)
        keep = sums >= least
        made = keys[keep].astype(np.int64) | key[0].as_py() << 32
        return pa.table({"key": pa.array(made), "df": pa.array(sums[keep])})

    scratch = Scratch(df.sparkSession, "frequent", BATCH_ROWS)
    counts = scratch.save(partial_counts(df, n, buckets).groupBy("bucket").applyInArrow(total, "key long, df long"), "counts")
    sizes = counts.groupBy(F.floor(F.log2("df")).alias("power")).count().collect()  # one row per power of two
    power, room = 63, most
    for row in sorted(sizes, key=lambda r: -r["power"]):
        room -= row["count"]
        if room < 0:
            break
        power = row["power"]
    found = counts.where(F.floor(F.log2("df")) >= power).select("key").toArrow().column(0).to_numpy()  # at most ``most`` numbers
    scratch.drop()
    return np.sort(found.astype(np.int64).view(U))


class Signer:
    """Signatures, bitmaps and fingerprints of the sets of a batch."""

    def __init__(self, frequent: np.ndarray, buckets: int, threshold: Threshold) -> None:
        self.frequent, self.buckets, self.t = frequent, buckets, threshold
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[(frequent & U((1 << 22) - 1)).astype(np.int64)] = True

    def is_frequent(self, values: np.ndarray) -> np.ndarray:
        out = self.maybe[(values & U((1 << 22) - 1)).astype(np.int64)]
        at = np.flatnonzero(out)
        if len(at):
            keys = frequency_key(values[at], self.buckets)
            place = np.minimum(np.searchsorted(self.frequent, keys), len(self.frequent) - 1)
            out[at] = self.frequent[place] == keys
        return out

    def combinations(self, frequent: np.ndarray, needed: int, level: int) -> np.ndarray:
        """Signatures at a level of a set's frequent shingles (by hash), where ``needed`` must be covered."""
        classes = self.t.classes(level)
        if not classes:
            return tv.mix(frequent[:needed] ^ U(0x5BD1E995))
        own = ((frequent >> U(24)) % U(classes)).astype(np.int64)
        worth = np.ones(len(own), np.int64)
        worth[np.unique(own, return_index=True)[1]] = 0
        end = int(np.searchsorted(np.cumsum(worth), needed)) + 1
        order = np.argsort(own[:end], kind="stable")
        values, own = frequent[:end][order], own[:end][order]
        found, k = [], 1
        while k < len(own) and len(same := np.flatnonzero(own[k:] == own[:-k])):
            found.append(tv.mix(values[same] * U(0x9E3779B97F4A7C15) + values[same + k] * U(0xC2B2AE3D27D4EB4F) + U(level * 2 + 1)))
            k += 1
        return np.concatenate(found) if found else values[:0]

    def signatures(self, values: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
        """(signature, row) of all rows' prefixes."""
        size = np.bincount(row, minlength=rows)
        first = np.cumsum(size) - size
        often = self.is_frequent(values)
        if often.any():
            order = np.argsort(row * 2 + often, kind="stable")
            values, row, often = values[order], row[order], often[order]
        rank = np.arange(len(values)) - first[row]
        lacking = self.t.lacking(size)
        prefix = rank <= lacking[row]
        alone = prefix & ~often
        made, of = [tv.mix(values[alone] ^ U(0x5BD1E995))], [row[alone]]
        for r in np.unique(row[prefix & often]).tolist():
            part = slice(first[r], first[r] + size[r])
            tail = values[part][often[part]]
            needed, level = int(lacking[r]) + 1 - (int(size[r]) - len(tail)), self.t.level(int(size[r]))
            for at in (level, level + 1):
                got = self.combinations(tail, needed, at)
                made.append(got)
                of.append(np.full(len(got), r))
        return np.concatenate(made), np.concatenate(of)

    @staticmethod
    def bitmaps(values: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
        """64-bit words of every row's parity bitmap (a power of two of them), and offsets."""
        size = np.bincount(row, minlength=rows)
        longs = 1 << np.ceil(np.log2(np.maximum(1, size * BITS / 64))).astype(np.int64)
        offsets = np.concatenate([[0], np.cumsum(longs)])
        place = offsets[row] * 64 + ((values >> U(8)).astype(np.int64) & (longs[row] * 64 - 1))
        odd = (np.bincount(place, minlength=int(offsets[-1]) * 64) & 1).astype(np.uint8)
        return np.packbits(odd, bitorder="little").view(np.int64), offsets

    def batch(self, values: np.ndarray, row: np.ndarray, rows: int) -> list[pa.Array]:
        """n, f1, f2, bits, sigs."""
        size = np.bincount(row, minlength=rows)
        prints = []
        for salt in (U(0x1B873593CC9E2D51), U(0xE6546B64B5D1E995)):
            total = np.concatenate([np.zeros(1, U), np.cumsum(tv.mix(values * salt))])
            end = np.cumsum(size)
            prints.append(pa.array((total[end] - total[end - size]).view(np.int64)))
        bits, offsets = self.bitmaps(values, row, rows)
        sigs, of = self.signatures(values, row, rows)
        order = np.argsort(of, kind="stable")
        ends = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=rows))])
        return [
            pa.array(size.astype(np.int64)), *prints,
            pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(bits)),
            pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(sigs[order].view(np.int64))),
        ]


def differ(a, b):
    """Lower bound of the symmetric difference from two bitmap columns; the longer is folded."""
    short = F.least(F.size(a), F.size(b))
    fold = lambda x: F.transform(
        F.sequence(F.lit(0), short - 1),
        lambda i: F.aggregate(
            F.sequence(F.lit(0), F.floor(F.size(x) / short).cast("int") - 1), F.lit(0).cast("long"), lambda s, k: s.bitwiseXOR(F.get(x, i + k * short))
        ),
    )
    return F.aggregate(F.zip_with(fold(a), fold(b), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def shingle_sets(df: DataFrame, n: int) -> DataFrame:
    """(id, s): the sorted set of each document, as bytes of 64-bit values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches):
            values, row = sets_of(part, n)
            ends = np.cumsum(np.bincount(row, minlength=part.num_rows))
            sets = [s.tobytes() for s in np.split(values, ends[:-1])]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.binary())], names=["id", "s"])

    return df.mapInArrow(run, f"id {df.schema['id'].dataType.simpleString()}, s binary")


def verified(pairs: DataFrame, df: DataFrame, n: int, t: Threshold) -> DataFrame:
    """The pairs (u, v) whose sets reach the threshold; sets are made for the documents of pairs only."""
    need = pairs.select(F.explode(F.array("u", "v")).alias("id")).distinct()
    sets = shingle_sets(df.join(need, "id", "left_semi"), n).distinct()  # an id may have several texts

    @F.arrow_udf("boolean")
    def reach(a: pa.Array, b: pa.Array) -> pa.Array:
        out = []
        for x, y in zip(a, b, strict=True):
            p, q = np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U)
            both = int((q[np.minimum(np.searchsorted(q, p), max(0, len(q) - 1))] == p).sum()) if len(p) and len(q) else 0
            out.append(bool(both) and t.den * both >= t.num * (len(p) + len(q) - both))
        return pa.array(out, pa.bool_())

    left, right = sets.select(F.col("id").alias("u"), F.col("s").alias("a")), sets.select(F.col("id").alias("v"), F.col("s").alias("b"))
    return pairs.join(left, "u").join(right, "v").where(reach("a", "b")).select("u", "v").distinct()


class Bucketed:
    """A group of block pairs in order, and the pairs of documents in them that pass the filters."""

    def __init__(self, group: pa.Table, t: Threshold) -> None:
        self.t = t
        self.group = group = group.sort_by([("sig", "ascending"), ("i", "ascending"), ("j", "ascending")])
        self.sig, self.i, self.j, self.side = (group[c].to_numpy() for c in ("sig", "i", "j", "side"))
        self.comp = group["comp"].combine_chunks().dictionary_encode().indices.to_numpy().copy()
        self.n, lists, low = group["n"].to_numpy().astype(np.int64), group["bits"].combine_chunks(), group["low"].combine_chunks()
        self.words, self.ends = lists.values.to_numpy().view(U), lists.offsets.to_numpy()
        self.lows, self.low_ends = low.values.to_numpy(), low.offsets.to_numpy()
        self.least: dict[int, frozenset[int]] = {}
        sig = self.sig
        new = np.diff(sig, prepend=~sig[:1]) | np.diff(self.i, prepend=self.i[:1]) | np.diff(self.j, prepend=self.j[:1])
        cut = np.flatnonzero(new).tolist()
        self.blocks = list(zip(cut, [*cut[1:], len(sig)], strict=True))

    def smallest(self, k: int) -> frozenset[int]:
        if k not in self.least:
            self.least[k] = frozenset(self.lows[self.low_ends[k] : self.low_ends[k + 1]].tolist())
        return self.least[k]

    def partners(self, x: int, end: int) -> Iterator[int]:
        """Rows after x in its block pair, of other components (as they are now), that may link with it."""
        t, n, ends = self.t, self.n, self.ends
        other = np.arange(x + 1, end)
        other = other[self.comp[other] != self.comp[x]]
        if self.i[x] != self.j[x]:
            other = other[self.side[other] != self.side[x]]
        small, large = np.minimum(n[other], n[x]), np.maximum(n[other], n[x])
        other = other[t.den * small >= t.num * large]
        width = np.diff(ends)[other]
        for w in np.unique(width).tolist():  # bitmaps of one width at a time
            some = other[width == w]
            at = np.minimum(w, ends[x + 1] - ends[x])
            theirs = np.bitwise_xor.reduce(self.words[ends[some][:, None] + np.arange(w)].reshape(len(some), -1, at), axis=1)
            mine = np.bitwise_xor.reduce(self.words[ends[x] : ends[x + 1]].reshape(-1, at), axis=0)
            apart = np.bitwise_count(theirs ^ mine).sum(axis=1).astype(np.int64)
            for y in some[t.may_link(n[some], n[x], apart)].tolist():
                # a pair that meets in some of its smallest buckets is given by the first of these only
                if not ((both := self.smallest(x) & self.smallest(y)) and min(both) != self.sig[x]):
                    yield y


def block_pairs(members: DataFrame, t: Threshold, kind: str, groups: int) -> DataFrame:
    """Pairs (u, v) of different components within buckets that pass the size and bitmap filters; of dense block pairs their key (sig, i, j) instead.

    ``members``: sig, i, j (block pair), side (the member's block), id, comp, n, bits, low. Groups hold many
    small buckets or one block pair of a large one.
    """

    def compare(key: tuple, group: pa.Table) -> pa.Table:
        g = Bucketed(group, t)
        us, vs, dense = [], [], []
        for a, b in g.blocks:
            mark, most = len(us), DENSE * (b - a)
            for x in range(a, b - 1):
                for y in g.partners(x, b):
                    us.append(x)
                    vs.append(y)
                if len(us) - mark > most:
                    del us[mark:], vs[mark:]
                    dense.append(a)
                    break
        ids, none = g.group["id"].combine_chunks(), pa.nulls(len(us), pa.int64())
        empty = pa.nulls(len(dense), ids.type)
        keys = {c: pa.concat_arrays([none.cast(g.group[c].type), g.group[c].combine_chunks().take(pa.array(dense, pa.int64()))]) for c in ("sig", "i", "j")}
        return pa.table({
            "u": pa.concat_arrays([ids.take(pa.array(us, pa.int64())), empty]), "v": pa.concat_arrays([ids.take(pa.array(vs, pa.int64())), empty]), **keys
        })

    keyed = members.withColumn("g", F.pmod(F.xxhash64("sig", "i", "j"), F.lit(groups)))
    return keyed.groupBy("g").applyInArrow(compare, f"u {kind}, v {kind}, sig long, i int, j int").where("u is null or u != v")


def block_forest(members: DataFrame, t: Threshold, kind: str, groups: int) -> DataFrame:
    """A forest of the links (u, v) between components in block pairs whose members have their sets ``s``."""

    def compare(key: tuple, group: pa.Table) -> pa.Table:
        g = Bucketed(group, t)
        sets = g.group["s"].combine_chunks()
        us, vs = [], []
        for a, b in g.blocks:
            own = [np.frombuffer(sets[k].as_buffer(), U) for k in range(a, b)]
            for x in range(a, b - 1):
                p = own[x - a]
                for y in g.partners(x, b):
                    q = own[y - a]
                    if g.comp[x] == g.comp[y] or not len(p) or not len(q):
                        continue
                    both = int((q[np.minimum(np.searchsorted(q, p), len(q) - 1)] == p).sum())
                    if t.den * both >= t.num * (len(p) + len(q) - both):
                        us.append(x)
                        vs.append(y)
                        part = g.comp[a:b]
                        part[part == g.comp[y]] = g.comp[x]
        ids = g.group["id"].combine_chunks()
        return pa.table({"u": ids.take(pa.array(us, pa.int64())), "v": ids.take(pa.array(vs, pa.int64()))})

    keyed = members.withColumn("g", F.pmod(F.xxhash64("sig", "i", "j"), F.lit(groups)))
    return keyed.groupBy("g").applyInArrow(compare, f"u {kind}, v {kind}")


def groups_of(members: DataFrame, size) -> int:
    """How many groups keep ``members`` within ``GROUP_ROWS`` and ``GROUP_BYTES`` on average."""
    rows, total = members.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    return max(16, rows // GROUP_ROWS, total // GROUP_BYTES)


def jaccard_components(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, num: int = 80, den: int = 100, name: str = "ngrams"
) -> DataFrame:
    """One row per row of ``df``: id, n_shingles (long) and component_id, the smallest id reachable by links."""
    t, spark = Threshold(num, den), df.sparkSession
    docs = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = docs.schema["id"].dataType.simpleString()
    scratch = Scratch(spark, name, BATCH_ROWS)
    buckets = 4 * max(8, docs.rdd.getNumPartitions())
    signer = Signer(frequent_shingles(docs, n, buckets), buckets, t)
    shared = spark.sparkContext.broadcast(signer)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches):
            values, row = sets_of(part, n)
            made = shared.value.batch(values, row, part.num_rows)
            yield pa.RecordBatch.from_arrays([part.column(0), *made], names=["id", "n", "f1", "f2", "bits", "sigs"])

    signed = scratch.save(docs.mapInArrow(sign, f"id {kind}, n long, f1 long, f2 long, bits array<long>, sigs array<long>"), "signed")
    nodes = signed.where("id is not null and n > 0")
    narrow = nodes.select("id", "n", "f1", "f2", "bits")
    index = nodes.select("id", "n", F.explode("sigs").alias("sig"))
    pivots = index.groupBy("sig").agg(F.min("id").alias("pivot"), F.max("id").alias("last")).where("pivot != last").select("sig", "pivot")
    shared_sigs = scratch.save(index.join(pivots, "sig").select("sig", "id", "n", "pivot"), "shared")

    # Every member against the smallest of its bucket.
    star = shared_sigs.where("id != pivot").select("id", "pivot").distinct()
    side = lambda p: narrow.select(*[F.col(c).alias(p + c) for c in narrow.columns])
    met = star.join(side("u_"), F.col("id") == F.col("u_id")).join(side("v_"), F.col("pivot") == F.col("v_id"))
    sizes = F.lit(den) * F.least("u_n", "v_n") >= F.lit(num) * F.greatest("u_n", "v_n")
    equal = F.expr("u_n = v_n and u_f1 = v_f1 and u_f2 = v_f2")
    near = met.where(sizes).withColumn("equal", equal).where(F.col("equal") | t.may_link(F.col("u_n"), F.col("v_n"), differ(F.col("u_bits"), F.col("v_bits"))))
    # The smallest pivot of each document is enough here: others are compared below unless this joins them.
    first = near.groupBy("id").agg(F.min(F.struct((~F.col("equal")).alias("unequal"), "pivot")).alias("p"))
    best = scratch.save(first.select(F.col("id").alias("u"), F.col("p.pivot").alias("v"), (~F.col("p.unequal")).alias("equal")), "star")
    links = scratch.save(best.where("equal").select("u", "v").unionByName(verified(best.where("not equal").select("u", "v"), docs, n, t)), "links")
    comp = scratch.save(components(links, scratch, "cc1"), "comp1")

    # Buckets that still hold several components.
    member = shared_sigs.select("sig", "id", "n").join(comp, "id", "left").withColumn("comp", F.coalesce("component", "id"))
    mixed = (
        member.groupBy("sig")
        .agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("m"), F.sum("n").alias("shingles"), F.expr("bit_xor(xxhash64(id))").alias("x1"), F.expr("bit_xor(xxhash64(7, id))").alias("x2"))
        .where("lo != hi")
        .groupBy("m", "x1", "x2")  # buckets of the same members are looked at once
        .agg(F.min("sig").alias("sig"), F.max("shingles").alias("shingles"))
        .select("sig", F.greatest(F.ceil(F.col("m") / BLOCK), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    )
    inside = scratch.save(member.join(mixed, "sig").select("sig", "id", "comp", "blocks"), "inside")
    low = inside.groupBy("id").agg(F.slice(F.array_sort(F.collect_set("sig")), 1, LOWEST).alias("low"))
    dealt = inside.withColumn("side", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("sig", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "side", "id", "comp")
    dealt = scratch.save(dealt.join(narrow.select("id", "n", "bits").join(low, "id"), "id"), "mixed")
    rest = scratch.save(block_pairs(dealt, t, kind, groups_of(dealt, F.size("bits") * 8)).distinct(), "rest")
    dense = scratch.save(dealt.join(rest.where("u is null").select("sig", "i", "j"), ["sig", "i", "j"], "left_semi"), "dense")
    found = verified(rest.where("u is not null").select("u", "v"), docs, n, t)
    if not dense.isEmpty():
        sets = shingle_sets(docs.join(dense.select("id").distinct(), "id", "left_semi"), n).distinct()
        found = found.unionByName(block_forest(dense.join(sets, "id"), t, kind, groups_of(dense, F.col("n") * 8)))
    more = scratch.save(found, "more")
    final = scratch.save(components(links.unionByName(more), scratch, "cc2"), "comp2")
    scratch.drop(*[step for step in list(scratch.paths) if step not in ("signed", "comp2")])
    out = signed.select("id", "n").join(final, "id", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))
