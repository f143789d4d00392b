"""Merkle manifest of a table: a tree for every group, a tree over the groups, and a proof for every row.

A leaf is the hash of a row's columns. The leaves of a group lie in order of a key; every ``FANOUT`` consecutive nodes, the
last run as it is, become one node until one is left. Blocks of ``FANOUT ** HEIGHT`` leaves that begin at a multiple of that
size are subtrees of the whole tree, so each is walked alone, in postorder: a walk returns the digest of its subtree and,
while it unwinds, appends the siblings of a child to every leaf inside it. The roots of the blocks are the leaves of the
next distributed walk, until every group has one root; then the roots of the groups are walked alike.

Scale: texts are hashed where they are read and do not move. Leaves (one or two digests and the key) are dealt by ranges of
(group, key), so a group of any size lies in many tasks; ranks come from counts per task; a block has at most 4,096 leaves.
Each further walk sees 1/4,096 of the nodes. Proofs are made in a second pass over the written blocks, which gets the siblings
above every block, so they are not stored. Nothing but the root, one digest, reaches the driver.

Cases: nulls are hashed as ``-``; a null group is a group, and comes first; null keys come first and rows of one key follow their
leaves' digests, repeated rows lie side by side; empty texts have length 0; an empty table gives no row and no root.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import Scratch

FANOUT = 16
HEIGHT = 3
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(*parts: str) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def encoded(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def row_digest(*values: Column) -> Column:
    """The hash of a row's values, lowercase hex."""
    return F.sha2(F.concat(*[encoded(v) for v in values]).cast("binary"), 256)


def tampered_text(text: Column) -> Column:
    """A text with A-Z in lower case."""
    return F.translate(text, _UPPER, _LOWER)


def walk(nodes: list[str], height: int, paths: list[list[str]] | None = None, first: int = 0) -> str:
    """Digest of the subtree of ``height`` levels over ``nodes``; with ``paths``, each leaf gets ``left|right`` of its siblings per level.

    A level's entry is appended once the child that holds the leaf has returned, so entries come from the leaf upward.
    """
    if not height:
        return nodes[0]
    size = FANOUT ** (height - 1)
    run = [walk(nodes[k : k + size], height - 1, paths, first + k) for k in range(0, len(nodes), size)]
    if paths is not None:
        for k in range(len(run)):
            entry = "".join(run[:k]) + "|" + "".join(run[k + 1 :])
            for leaf in range(first + k * size, first + min((k + 1) * size, len(nodes))):
                paths[leaf].append(entry)
    return digest(*run)


def height_of(n: int, whole: bool, height: int) -> int:
    """Levels over the n nodes of a block: as many as reach one node if it is all of its tree, else ``height``."""
    if not whole:
        return height
    levels = 0
    while n > FANOUT**levels:
        levels += 1
    return levels


def fold(leaf: str, path: str) -> str:
    """The root that a leaf and its path lead to; a path is its levels, joined by ``/``."""
    for level in path.split("/") if path else ():
        left, right = level.split("|")
        leaf = digest(left, leaf, right)
    return leaf


def siblings_digest(path: str) -> str:
    """The hash of all siblings of a path, left to right, level by level."""
    return digest(path.replace("|", "").replace("/", ""))


def ranked(nodes: DataFrame, group: str, keys: list[str], scratch: Scratch, step: str) -> DataFrame:
    """``nodes`` with ``idx``: the place from 0 inside the group in order of the keys, nulls first.

    Rows that are equal in all keys are told apart by where they are read, so that no range holds more of them than its share.
    """
    placed = nodes.withColumn("__read", F.monotonically_increasing_id())
    order = [group, *keys, "__read"]
    placed = placed.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    placed = scratch.save(placed.drop("__read").withColumn("__part", F.shiftright("__at", 33)), f"{step}-ordered")
    # how many of a group lie in earlier tasks; a row for each task and group
    runs = placed.groupBy(F.col(group).alias("__g"), F.col("__part").alias("__p")).agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy("__g").orderBy("__p")) - F.col("__n")
    runs = runs.withColumn("__before", before)
    joined = placed.join(runs, (F.col("__part") == F.col("__p")) & F.col(group).eqNullSafe(F.col("__g")))
    return joined.withColumn("idx", F.col("__at") - F.col("__first") + F.col("__before")).select(*nodes.columns, "idx")


@dataclass
class Forest:
    blocks: DataFrame  # group, block, items array<struct(idx, digest, ...)>, whole
    roots: DataFrame  # group, digest
    above: DataFrame | None  # group, block, above: the path of a block's root, where it is not the root of its tree


def plant(nodes: DataFrame, group: str, scratch: Scratch, step: str) -> Forest:
    """Trees over ``nodes`` (group, idx, digest and others, idx gapless from 0): blocks, roots and the paths above blocks."""
    height, size = HEIGHT, FANOUT**HEIGHT
    others = [c for c in nodes.columns if c != group]
    dealt = nodes.groupBy(F.col(group), F.floor(F.col("idx") / size).cast("long").alias("block"))
    blocks = dealt.agg(F.array_sort(F.collect_list(F.struct("idx", *[c for c in others if c != "idx"]))).alias("items"))
    blocks = scratch.save(blocks, f"{step}-blocks")
    # a block that is not full and has number 0 is all of its tree; of full ones only the counts of blocks tell
    counts = blocks.groupBy(F.col(group).alias("__g")).agg(F.max("block").alias("__last"))
    last = blocks.select(group, "block", F.col("items.digest").alias("digests")).join(counts, F.col(group).eqNullSafe(F.col("__g")))
    kind = blocks.schema[group].dataType.simpleString()

    def rooted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = [x == 0 for x in batch.column("__last").to_pylist()]
            found = [walk(d, height_of(len(d), w, height)) for d, w in zip(batch.column("digests").to_pylist(), whole)]
            yield pa.RecordBatch.from_arrays([batch.column(group), batch.column("block"), pa.array(whole), pa.array(found)], names=[group, "block", "whole", "digest"])

    top = last.select(group, "block", "__last", "digests").mapInArrow(rooted, f"{group} {kind}, block long, whole boolean, digest string")
    top = scratch.save(top, f"{step}-roots")
    roots, parts = top.where("whole").select(group, "digest"), top.where("not whole")
    if parts.isEmpty():
        return Forest(blocks, roots, None)
    upper = plant(parts.select(group, F.col("block").alias("idx"), "digest"), group, scratch, f"{step}-up")
    return Forest(blocks, roots.unionByName(upper.roots), paths(upper, group, ["idx"]).select(group, F.col("idx").alias("block"), F.col("path").alias("above")))


def paths(forest: Forest, group: str, keep: list[str], top: DataFrame | None = None) -> DataFrame:
    """(group, keep, path) of every leaf: siblings inside its block, above it, and those of ``top`` (group, path) over the group's root."""
    return _leaves(forest, group, keep, top, None)


def _leaves(forest: Forest, group: str, keep: list[str], top: DataFrame | None, finish) -> DataFrame:
    """Leaves with their paths, or what ``finish(item, path)`` makes of them (a dict of strings), block by block."""
    blocks, height = forest.blocks, HEIGHT
    if forest.above is None:
        blocks = blocks.withColumn("above", F.lit(None).cast("string"))
    else:
        above = forest.above.select(F.col(group).alias("__g"), F.col("block").alias("__b"), "above")
        blocks = blocks.join(above, F.col(group).eqNullSafe(F.col("__g")) & (F.col("block") == F.col("__b")), "left").drop("__g", "__b")
    if top is None:
        blocks = blocks.withColumn("top", F.lit(None).cast("string"))
    else:
        blocks = blocks.join(top.select(F.col(group).alias("__t"), F.col("path").alias("top")), F.col(group).eqNullSafe(F.col("__t")), "left").drop("__t")
    kinds = {f.name: f.dataType.simpleString() for f in blocks.schema["items"].dataType.elementType.fields}
    made = ["path"] if finish is None else list(finish.names)
    schema = ", ".join([f"{group} {blocks.schema[group].dataType.simpleString()}", *[f"{c} {kinds[c]}" for c in keep], *[f"{c} string" for c in made]])

    def unwound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                items = row.column("items").flatten()
                digests = items.field("digest").to_pylist()
                above, over = row.column("above")[0].as_py(), row.column("top")[0].as_py()
                local: list[list[str]] = [[] for _ in digests]
                walk(digests, height_of(len(digests), above is None, height), local)
                tail = [x for x in (above, over) if x]
                found = ["/".join(p + tail) for p in local]
                out = [found] if finish is None else finish(items, found)
                same = pa.concat_arrays([row.column(group)] * len(digests)) if len(digests) else row.column(group).slice(0, 0)
                yield pa.RecordBatch.from_arrays([same, *[items.field(c) for c in keep], *[pa.array(x, pa.string()) for x in out]], names=[group, *keep, *made])

    return blocks.select(group, "items", "above", "top").mapInArrow(unwound, schema)


class _Proof:
    """Columns made from a leaf's path: its proof's hash and the root that the leaf, tampered or not, leads to."""

    names = ("proof_sha256", "folded_root")

    def __call__(self, items: pa.StructArray, found: list[str]) -> list[list[str]]:
        leaves, other = items.field("digest").to_pylist(), items.field("tampered").to_pylist()
        return [[siblings_digest(p) for p in found], [fold(t or leaf, p) for t, leaf, p in zip(other, leaves, found)]]


def manifest(df: DataFrame, group: str, key: str, columns: list[str], tampered: Column | None = None) -> DataFrame:
    """(key, group, leaf, subroot, root, proof_sha256, folded_root, verified) for every row of ``df``.

    ``tampered`` is the hash of the row as found later, null where it is as it was; ``verified`` says whether that row and the stored
    siblings still lead to the root.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "merkle", batch_rows=16)
    leaves = df.select(
        F.col(group).alias("tree"), F.col(key).alias("key"), row_digest(*[F.col(c) for c in columns]).alias("digest"),
        (F.lit(None).cast("string") if tampered is None else tampered).alias("tampered"),
    )
    nodes = ranked(leaves, "tree", ["key", "digest"], scratch, "leaves")
    forest = plant(nodes, "tree", scratch, "tree")
    subroots = scratch.save(forest.roots, "subroots")
    one = subroots.select(F.lit(0).alias("all"), "tree", "digest")
    over = plant(ranked(one, "all", ["tree"], scratch, "top"), "all", scratch, "all")
    root = over.roots.first()
    top = scratch.save(paths(over, "all", ["tree"]).select("tree", "path"), "over")
    found = scratch.save(_leaves(forest, "tree", ["key", "digest"], top, _Proof()), "proofs")
    named = subroots.select(F.col("tree").alias("__t"), F.col("digest").alias("subroot"))
    out = found.join(named, F.col("tree").eqNullSafe(F.col("__t"))).withColumn("root", F.lit(root.digest if root else None).cast("string"))
    return out.select(
        F.col("key").alias(key), F.col("tree").alias(group), F.col("digest").alias("leaf"), "subroot", "root", "proof_sha256", "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def documents_manifest(docs: DataFrame) -> DataFrame:
    """The manifest of ``documents``, and the check of a copy in which every fifth id's text lost its capitals.

    Ids are drawn by the CRC-32 of their decimal text; null ids and null texts are as they were.
    """
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    drawn = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    other = row_digest(*[F.col(c) for c in columns[:-1]], tampered_text(F.col("text")))
    found = manifest(docs, "source", "doc_id", columns, F.when(drawn, other))
    return found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
