"""Near-duplicate embeddings by a subspace pigeonhole join.

Vectors are scaled to length one, turned by a random rotation, so their energy spreads evenly over the coordinates,
and rounded once to multiples of 1 / ``STEPS``; what follows is exact in whole numbers wherever it is computed. The
coordinates are split into blocks of about ``BLOCK``. If two vectors of D coordinates lie within a squared distance s,
then in at least one block of d coordinates they lie within s * d / D. So every block is range-joined under its
share of the budget, by a sweep along the block's first coordinate, and pairs that meet are verified with the exact
cosine of their original values in double precision. A pair belongs to the first block whose share it meets, so
counts add up without writing pairs down: a group gives the links of each vector and a spanning forest of them.

Scale: vectors meet by (label, length). Up to ``CELL`` of them are one cell, shipped once for all blocks. Beyond, every
block is cut by a grid over as many of its first coordinates as the number of vectors asks for; a vector enters its
own cell and those that its range reaches upwards, and a pair belongs to the cell of its coordinate-wise maximum.
A cell that still holds more than ``CELL`` is dealt into pairs of sub-blocks, so no task holds an unbounded group.
Equal vectors (same label, same values, by a 128-bit hash) are collapsed before and carry their number.

Cases: null, zero and non-finite vectors, null components and null labels link with nothing; vectors of different
lengths never link; null ids are kept with no links and no component; every row of a repeated id has the links of its own
vector; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components
from .storage import Scratch

BLOCK = 8
#: Vectors that one group compares.
CELL = 8_000
#: Steps of a coordinate; 16 bits hold them.
STEPS = 16_384
#: Coordinates that are turned together.
TURN = 512


def rotation(dim: int, seed: int = 7) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def cut(dim: int, block: int) -> list[slice]:
    """Blocks of about ``block`` coordinates that cover all of them."""
    n = max(1, round(dim / block))
    ends = [dim * k // n for k in range(n + 1)]
    return [slice(a, b) for a, b in zip(ends, ends[1:], strict=False)]


class Plan:
    """Rotation, blocks and budgets (in steps) for a dimension and a least cosine."""

    def __init__(self, dim: int, cosine: float, block: int = BLOCK) -> None:
        self.dim, self.cosine = dim, cosine
        self.order = np.random.default_rng(dim).permutation(dim)
        self.turns = [(s, rotation(s.stop - s.start, 7 + s.start)) for s in cut(dim, TURN)]
        self.blocks = cut(dim, block)
        # rounding moves each end of a pair by at most half a step in every coordinate
        self.budget = (np.sqrt(2 - 2 * cosine + 1e-9) * STEPS + np.sqrt(dim) + 1) ** 2
        self.share = [int(np.ceil(self.budget * (s.stop - s.start) / dim)) for s in self.blocks]
        self.reach = [int(np.floor(np.sqrt(share))) for share in self.share]

    def steps(self, x: np.ndarray) -> np.ndarray:
        """Rotated coordinates of vectors in whole steps."""
        unit = (x / np.linalg.norm(x, axis=1, keepdims=True))[:, self.order]
        return np.rint(np.hstack([unit[:, s] @ turn for s, turn in self.turns]) * STEPS).astype(np.int16)

    def cells(self, y: np.ndarray, b: int, grid: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) of every cell of block b that a vector enters: its own and those its range reaches upwards."""
        width = 2 * self.reach[b] + 1
        at = y[:, self.blocks[b]][:, :grid].astype(np.int64)
        low, high = at // width, (at + self.reach[b]) // width
        rows, found = [], []
        for corner in range(1 << at.shape[1]):
            up = np.array([corner >> k & 1 for k in range(at.shape[1])], bool)
            enters = ((high > low) | ~up).all(axis=1)
            rows.append(np.flatnonzero(enters))
            found.append(code(low[enters] + up))
        return np.concatenate(rows), np.concatenate(found)

    def home(self, y: np.ndarray, other: np.ndarray, b: int, grid: int) -> np.ndarray:
        """The cell of the coordinate-wise maximum of pairs."""
        part = self.blocks[b]
        return code(np.maximum(y[:, part][:, :grid], other[:, part][:, :grid]).astype(np.int64) // (2 * self.reach[b] + 1))

    def apart(self, y: np.ndarray, other: np.ndarray, b: int) -> np.ndarray:
        """Squared distances of pairs in block b."""
        d = y[:, self.blocks[b]].astype(np.int64) - other[:, self.blocks[b]]
        return (d * d).sum(axis=1)


def code(cell: np.ndarray) -> np.ndarray:
    """One number for each row of grid coordinates."""
    out = np.zeros(len(cell), np.int64)
    for k in range(cell.shape[1]):
        out = out * 1_000_003 + cell[:, k]
    return out


@lru_cache(maxsize=8)
def plan_of(dim: int, cosine: float) -> Plan:
    return Plan(dim, cosine)


def sweep(y: np.ndarray, left: np.ndarray, right: np.ndarray, b: int, plan: Plan) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows in left and right that block b's share allows; each once, where left and right are the same."""
    part = y[:, plan.blocks[b]].astype(np.float64)  # whole numbers, so products are exact in any order
    squares = (part * part).sum(axis=1)
    same = left is right
    left, right = (rows[np.argsort(part[rows, 0], kind="stable")] for rows in (left, right))
    keys, reach, share = part[right, 0], plan.reach[b], plan.share[b]
    for start in range(0, len(left), 256):
        rows = left[start : start + 256]
        first = start if same else np.searchsorted(keys, part[rows[0], 0] - reach, "left")
        others = right[first : np.searchsorted(keys, part[rows[-1], 0] + reach, "right")]
        apart = squares[rows][:, None] + squares[others] - 2 * (part[rows] @ part[others].T)
        p, q = np.nonzero(apart <= share)
        if same:
            p, q = p[q > p], q[q > p]
        yield rows[p], others[q]


def linked_pairs(x: np.ndarray, y: np.ndarray, left: np.ndarray, right: np.ndarray, plan: Plan, block: int = -1, grid: int = 0, cell: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs of rows in left and right: of all blocks, or those that a block's cell owns."""
    us, vs = [left[:0]], [left[:0]]
    for b in range(len(plan.blocks)) if block < 0 else (block,):
        for u, v in sweep(y, left, right, b, plan):
            for at in range(0, len(u), 20_000):
                p, q = u[at : at + 20_000], v[at : at + 20_000]
                mine = np.ones(len(p), bool) if block < 0 else plan.home(y[p], y[q], b, grid) == cell
                for earlier in range(b):  # another block owns the pair
                    mine &= plan.apart(y[p], y[q], earlier) > plan.share[earlier]
                p, q = p[mine], q[mine]
                a, c = x[p], x[q]
                cos = np.einsum("ij,ij->i", a, c) / np.sqrt(np.einsum("ij,ij->i", a, a) * np.einsum("ij,ij->i", c, c))
                us.append(p[cos >= plan.cosine])
                vs.append(q[cos >= plan.cosine])
    return np.concatenate(us), np.concatenate(vs)


def forest(n: int, u: np.ndarray, v: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of links between n rows."""
    parent = list(range(n))
    out = []
    for a, b in zip(u.tolist(), v.tolist(), strict=True):
        x, y = a, b
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        while parent[y] != y:
            parent[y] = parent[parent[y]]
            y = parent[y]
        if x != y:
            parent[max(x, y)] = min(x, y)
            out.append((a, b))
    return out


def vectors(column: pa.Array, dim: int) -> np.ndarray:
    """A list column of one length as a matrix of doubles, each row times a power of two, so that no square overflows or vanishes."""
    x = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def steps_of(column: pa.Array, dim: int) -> np.ndarray:
    """A column of rounded vectors as a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), "<i2").reshape(-1, dim)


CELL_KEY = ("label", "dim", "block", "cell", "i", "j")


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", cosine: float = 0.98) -> DataFrame:
    """One row per vector: id, n_links (long), component_id and kept."""
    scratch = Scratch(df.sparkSession, "embeddings")
    rows = df.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v"), F.col(label_col).alias("label"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = F.col("id").isNotNull() & F.col("label").isNotNull() & ~bad & F.exists("v", lambda x: x != 0)
    # -0.0 and 0.0 are the same value here
    zero = F.lit(0).cast(rows.schema["v"].dataType.elementType)
    keyed = rows.where(usable).withColumn("v", F.transform("v", lambda x: x + zero))
    prints = [F.xxhash64(F.lit(salt), "label", "v").alias(f"h{salt}") for salt in (1, 2)]
    keyed = keyed.select("id", "label", "v", *prints)
    # equal vectors are one node, named by the smallest id
    grouped = keyed.groupBy("h1", "h2", "label").agg(F.min(F.struct("id", "v")).alias("m"), F.count("*").alias("copies"))
    plain = grouped.select("h1", "h2", "label", F.col("m.id").alias("rep"), "copies", F.size("m.v").alias("dim"), F.col("m.v").alias("v"))

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                part = batch.take(pa.array(np.flatnonzero(dims == dim)))
                y = plan_of(dim, cosine).steps(vectors(part.column("v"), dim)).astype("<i2")
                yield part.append_column("y", pa.array([row.tobytes() for row in y], pa.binary()))

    node = f"label {kinds['label']}, rep {kinds['id']}, copies long, dim int, v {kinds['v']}"
    nodes = scratch.save(plain.mapInArrow(turn, f"h1 long, h2 long, {node}, y binary"), "nodes")
    # the labels whose vectors do not fit in one cell: a written table, so Spark knows whether it is small
    sizes = scratch.save(nodes.groupBy("label", "dim").agg(F.count("*").alias("m")).where(F.col("m") > CELL), "sizes")
    sized = nodes.drop("h1", "h2").join(sizes, ["label", "dim"], "left")
    alone = sized.where("m is null").select(
        "label", "dim", F.lit(-1).alias("block"), F.lit(0).alias("grid"), F.lit(0).cast("long").alias("cell"), "rep", "copies", "v", "y"
    )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, grids = batch.column("dim").to_numpy(), np.ceil(np.log2(batch.column("m").to_numpy() / CELL)).astype(int)
            for dim, grid in np.unique(np.stack([dims, grids], 1), axis=0).tolist():
                part = batch.take(pa.array(np.flatnonzero((dims == dim) & (grids == grid)))).drop_columns(["m"])
                plan, y = plan_of(dim, cosine), steps_of(part.column("y"), dim)
                for b in range(len(plan.blocks)):
                    at, cell = plan.cells(y, b, grid)
                    spot = part.take(pa.array(at))
                    for name, made in (("block", np.full(len(at), b, np.int32)), ("grid", np.full(len(at), grid, np.int32)), ("cell", cell)):
                        spot = spot.append_column(name, pa.array(made))
                    yield spot

    spots = sized.where("m is not null").select("label", "rep", "copies", "dim", "v", "y", "m").mapInArrow(place, f"{node}, y binary, block int, grid int, cell long")
    cells = ["label", "dim", "block", "cell"]
    crowded = scratch.save(spots.groupBy(*cells).agg(F.count("*").alias("n")), "cells")
    shipped = crowded.agg(F.sum(F.col("n") * F.ceil(F.col("n") / CELL))).first()[0] or 0
    groups = max(16, (nodes.count() + shipped) // (2 * CELL) * 4)
    parts = spots.join(crowded, cells, "left").withColumn("parts", F.ceil(F.col("n") / CELL).cast("int")).drop("n")
    parts = parts.unionByName(alone.withColumn("parts", F.lit(1)))
    dealt = parts.withColumn("side", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.withColumns({"i": F.least("side", "other"), "j": F.greatest("side", "other")}).drop("other", "parts")

    def compare(key: tuple, group: pa.Table) -> pa.Table:
        group = group.sort_by([(c, "ascending") for c in (*CELL_KEY, "rep")])
        new = np.zeros(group.num_rows, bool)
        for c in CELL_KEY:
            new |= np.diff(group[c].combine_chunks().dictionary_encode().indices.to_numpy(), prepend=-1) != 0
        cuts = np.flatnonzero(new)
        dim, block, grid, cell, side, i, j, weight = (group[c].to_numpy() for c in ("dim", "block", "grid", "cell", "side", "i", "j", "copies"))
        links, tree = np.zeros(group.num_rows, np.int64), []
        for a, z in zip(cuts.tolist(), [*cuts[1:].tolist(), group.num_rows], strict=True):
            if z - a < 2:
                continue
            plan, part = plan_of(int(dim[a]), cosine), group.slice(a, z - a)
            x, y = vectors(part["v"].combine_chunks(), plan.dim), steps_of(part["y"], plan.dim)
            left = right = np.arange(z - a)
            if i[a] != j[a]:
                left, right = np.flatnonzero(side[a:z] == i[a]), np.flatnonzero(side[a:z] == j[a])
            u, v = linked_pairs(x, y, left, right, plan, int(block[a]), int(grid[a]), int(cell[a]))
            np.add.at(links, u + a, weight[v + a])
            np.add.at(links, v + a, weight[u + a])
            tree += [(s + a, t + a) for s, t in forest(z - a, u, v)]
        rep, label = group["rep"].combine_chunks(), group["label"].combine_chunks()
        at = np.flatnonzero(links)
        tu, tv = (np.array([e[k] for e in tree], np.int64) for k in (0, 1))
        return pa.table({
            "label": pa.concat_arrays([label.take(pa.array(at)), label.take(pa.array(tu))]),
            "dim": pa.array(np.concatenate([dim[at], dim[tu]]).astype(np.int32)),
            "u": pa.concat_arrays([rep.take(pa.array(at)), rep.take(pa.array(tu))]),
            "v": pa.concat_arrays([pa.nulls(len(at), rep.type), rep.take(pa.array(tv))]),
            "n": pa.array(np.concatenate([links[at], np.zeros(len(tu), np.int64)])),
        })

    grouped = dealt.withColumn("g", F.pmod(F.xxhash64(*CELL_KEY), F.lit(groups))).groupBy("g")
    found = scratch.save(grouped.applyInArrow(compare, f"label {kinds['label']}, dim int, u {kinds['id']}, v {kinds['id']}, n long"), "found")
    node_key = ["label", "dim", "rep"]
    counts = found.where("v is null").groupBy("label", "dim", F.col("u").alias("rep")).agg(F.sum("n").alias("n"))
    comp = scratch.save(components(found.where("v is not null").select("u", "v"), scratch, "cc"), "components").withColumnRenamed("id", "rep")
    known = nodes.select("h1", "h2", "copies", *node_key).join(counts, node_key, "left").join(comp, "rep", "left")
    known = known.select(
        "h1", "h2", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("c")
    )
    mine = rows.select("id", *[F.when(usable, F.xxhash64(F.lit(s), "label", F.transform("v", lambda x: x + zero))).alias(f"h{s}") for s in (1, 2)])
    out = mine.join(known, ["h1", "h2"], "left")
    out = out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("c", "id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))
