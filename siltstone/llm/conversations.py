"""Conversation structure repair: the cheapest edits that make the roles of a conversation follow a grammar.

Roles must read ``(s?(ua)+)?`` by their initials: an optional system turn, then user and assistant in turn. Turns may be
kept, get another role, or be deleted, and empty turns may be inserted; edits have costs. The grammar is a weighted automaton
of four states. It is determinised lazily: reading turns from the last to the first, the cost to the end from each state is a vector; a vector
less its least entry is a state of a deterministic automaton, found when first met and kept in a transition table with the amount
taken off as its weight. A batch of conversations is then scanned together, one table look-up for each turn. The
cost is the sum of weights; the audit follows tight arcs back over the scan, from the first turn on, and takes the first edit in ASCII order
wherever several are tight, so it is the least of the cheapest audits.

Scale: rows move without texts (a hash stands for the text) until the last step. They are dealt by ranges of (conversation, place), so a long conversation lies in many tasks;
what lies whole inside a task is solved there. Others are cut into segments of at most ``SEGMENT`` rows, whose costs between any two
automaton states are four scans; these small tables are combined per conversation and give every segment the vector at its end, its trace
from each state it may begin in is made apart, and the pieces are joined. A conversation's result is one string, so its segments (one per 32,768 rows) fit where the result does.
The hash of the repaired text reads its rows in order, one at a time and with nothing kept, since SHA-256 cannot be split.

Cases: nulls in ids and turns are one space where a key needs text, null roles and texts are one space; a null id is a conversation; turns
are ordered with nulls first, equal turns by role, then by the SHA-256 of the text, repeated rows lie side by side; an empty table gives an empty result; gaps
that do not fit a long are null; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import Scratch

REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Rows of a segment, and rows that are scanned together.
SEGMENT, TOGETHER = 1 << 15, 1 << 18
#: Classes of role initials, as parts of a row's code; other initials are 3. Rows to be deleted all have the code ``GONE``.
CLASSES, GONE, CUT = "sua", 8, 4
FAR = 1 << 40
#: Grammar: start, after system, after user, after assistant; where a class leads, or -1; the role that may be inserted, and where it leads.
STEP = ((1, 2, -1, -1), (-1, 2, -1, -1), (-1, -1, 3, -1), (-1, 2, -1, -1))
ADDED, NEXT = ("user", "user", "assistant", "user"), (2, 2, 3, 2)
ENDS = (0, 3)
SHOWN = r"[^\x20\x09-\x0D]"


def _closed(v: list[int]) -> list[int]:
    """Costs with insertions at the same place."""
    for _ in range(3):
        v = [min(v[q], INSERT + v[NEXT[q]]) for q in range(4)]
    return v


FINAL = tuple(_closed([0 if q in ENDS else FAR for q in range(4)]))


class Determinised:
    """Vectors of costs to the end, numbered as they are met, and the table that a turn's code leads through."""

    def __init__(self) -> None:
        self.vectors: list[tuple[int, ...]] = []
        self.number: dict[tuple[int, ...], int] = {}
        self.table = np.full((64, 9), -1, np.int32)
        self.weight = np.zeros((64, 9), np.int64)
        self.arcs = np.full((64, 9, 4), -1, np.int32)  # number of the edits taken at a turn
        self.after = np.zeros((64, 9, 4), np.int8)
        self.edits: list[str] = []
        self.edit_of: dict[str, int] = {}

    def state(self, vector: list[int] | tuple[int, ...]) -> tuple[int, int]:
        """The state of a vector, and what was taken off."""
        least = min(vector)
        v = tuple(FAR if x >= FAR else x - least for x in vector)
        if v not in self.number:
            self.number[v] = len(self.vectors)
            self.vectors.append(v)
            if len(self.vectors) > len(self.table):
                self.table = np.concatenate([self.table, np.full_like(self.table, -1)])
                self.weight = np.concatenate([self.weight, np.zeros_like(self.weight)])
                self.arcs = np.concatenate([self.arcs, np.full_like(self.arcs, -1)])
                self.after = np.concatenate([self.after, np.zeros_like(self.after)])
        return self.number[v], least

    @staticmethod
    def options(code: int, q: int) -> list[tuple[str, int, int]]:
        """Edits of a turn with this code in state q, as (initial, cost, state after it), in ASCII order."""
        found = [("D", DELETE, q)]
        if code != GONE:
            extra, role = (TRUNCATED if code >= CUT else 0), code % CUT
            if STEP[q][role] >= 0:
                found.append(("K", extra, STEP[q][role]))
            found.append(("R", REROLE + extra, NEXT[q]))
        return found

    def fill(self, state: int, code: int) -> None:
        """The entries of one state and code: the vector before the turn, and the edits that are tight from each state."""
        v = self.vectors[state]
        before = _closed([min(cost + v[to] for _, cost, to in self.options(code, q)) for q in range(4)])
        to, least = self.state(before)
        self.table[state, code], self.weight[state, code] = to, least
        for q in range(4):
            edits, at = "", q
            while before[at] < FAR:
                tight = [(e, t) for e, cost, t in self.options(code, at) if cost + v[t] == before[at]]
                deleted = bool(tight) and tight[0][0] == "D"
                if not deleted and INSERT + before[NEXT[at]] == before[at]:
                    edits, at = edits + "I", NEXT[at]
                    continue
                e, at = tight[0]
                edits += e
                break
            self.arcs[state, code, q] = self.edit_of.setdefault(edits, len(self.edits))
            if self.arcs[state, code, q] == len(self.edits):
                self.edits.append(edits)
            self.after[state, code, q] = at

    def scan(self, codes: np.ndarray, first: np.ndarray, ends: list[tuple[int, ...]]) -> tuple[np.ndarray, list[list[int]]]:
        """The state after every turn, and the cost vector before each row's first turn. ``first``: begin of each row's codes, one more than rows."""
        size = np.diff(first)
        order = np.argsort(-size, kind="stable")
        size, stop = size[order], first[1:][order]
        found = [self.state(ends[k]) for k in order]
        state, total = np.array([s for s, _ in found], np.int32), np.array([w for _, w in found], np.int64)
        after = np.zeros(len(codes), np.int32)
        left = np.searchsorted(-size, -np.arange(size[0] if len(size) else 0), "left")  # rows with more turns than k
        for k, n in enumerate(left):
            at = stop[:n] - 1 - k
            code, s = codes[at], state[:n]
            after[at] = s
            to = self.table[s, code]
            if (to < 0).any():
                for one, c in {(int(a), int(b)) for a, b in zip(s[to < 0], code[to < 0])}:
                    self.fill(one, c)
                to = self.table[s, code]
            total[:n] += self.weight[s, code]
            state[:n] = to
        costs: list[list[int]] = [[]] * len(order)
        for k, s, t in zip(order, state, total):
            costs[k] = [FAR if x >= FAR else x + int(t) for x in self.vectors[s]]
        return after, costs

    def trace(self, codes: np.ndarray, more: np.ndarray, first: np.ndarray, after: np.ndarray, begin: np.ndarray) -> tuple[list[str], np.ndarray]:
        """The edits of each row from the state it begins in, and the state after its last turn. ``more``: further deletions after a turn."""
        size = np.diff(first)
        order = np.argsort(-size, kind="stable")
        size, start, q = size[order], first[:-1][order], begin[order].astype(np.int8)
        taken = np.zeros(len(codes), np.int32)
        for k, n in enumerate(np.searchsorted(-size, -np.arange(size[0] if len(size) else 0), "left")):
            at = start[:n] + k
            taken[at] = self.arcs[after[at], codes[at], q[:n]]
            q[:n] = self.after[after[at], codes[at], q[:n]]
        shown = [self.edits[x] for x in taken]
        for k in np.flatnonzero(more):
            shown[k] += "D" * int(more[k])
        out = np.zeros(len(order), np.int8)
        out[order] = q
        return ["".join(shown[a:b]) for a, b in zip(first[:-1], first[1:])], out


def finish(q: int) -> str:
    """Insertions that end a conversation in state q."""
    edits = ""
    while q not in ENDS:
        edits, q = edits + "I", NEXT[q]
    return edits


_automaton = Determinised()


def automaton() -> Determinised:
    """A worker's own automaton: what one batch finds the next ones use."""
    return _automaton


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column and where each row begins."""
    offsets = column.offsets.to_numpy()
    return column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]], offsets - offsets[0]


# --- damage: the given table has no faults of its own ------------------------------------------------------------------------


def damaged(df: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, times): rows after a seeded damage, ``times`` 0 for dropped rows and 2 for repeated ones."""
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat_ws(":", plain("conv_id"), plain("turn")).cast("binary")) % 20
    text = F.when(fault == 1, "").when(fault == 2, F.translate(plain("text"), ".!?", "")).otherwise(plain("text"))
    role = F.when(fault == 4, "user").otherwise(plain("role"))
    return df.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1).alias("times"))


# --- rows without texts ------------------------------------------------------------------------------------------------------


def _key() -> Column:
    return F.unhex(F.sha2(F.col("text").cast("binary"), 256))


def _coded(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, key, n, code, role_class, blank, repeated, cut): distinct rows in no order; ``code`` is that of the first of n equal ones."""
    light = rows.where("times > 0").select(
        "conv_id", "turn", "role", _key().alias("key"), "times", (~F.col("text").rlike(SHOWN)).alias("blank"), (~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")).alias("open")
    )
    distinct = light.groupBy("conv_id", "turn", "role", "key").agg(F.sum("times").alias("n"), F.first("blank").alias("blank"), F.first("open").alias("open"))
    # null turns come first
    place = F.struct(F.col("turn").isNotNull(), F.col("turn"))
    firsts = distinct.groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("key").alias("k")).agg(F.min(place).alias("place"))
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("key") == F.col("k"))
    seen = ~F.col("place").eqNullSafe(place)
    initial = F.substring("role", 1, 1)
    role_class = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    code = F.when(F.col("blank") | seen, GONE).otherwise(role_class + F.when(F.col("open"), CUT).otherwise(0))
    return distinct.join(firsts, same).select("conv_id", "turn", "role", "key", "n", "blank", code.cast("byte").alias("code"), role_class.cast("byte").alias("role_class"))


SEGMENTS = (
    "conv_id {kind}, seg long, whole boolean, n_blank long, n_dup long, n_cut long, n_illegal long, head byte, tail byte, cost long, audit string, "
    "codes array<tinyint>, more array<bigint>, costs array<bigint>"
)


def _segments(ordered: DataFrame) -> DataFrame:
    """Runs of one conversation inside a task: solved where no other task can hold more of it, else their codes and costs between states."""
    schema = SEGMENTS.format(kind=ordered.schema["conv_id"].dataType.simpleString())
    basis = [tuple(0 if p == q else FAR for p in range(4)) for q in range(4)]
    names = ["conv_id", "seg", "whole", "n_blank", "n_dup", "n_cut", "n_illegal", "head", "tail", "cost", "audit", "codes", "more", "costs"]

    def solved(table: pa.Table, edges: np.ndarray, whole: np.ndarray, number: int) -> pa.RecordBatch:
        code, kind, n, blank = (table[c].to_numpy() for c in ("code", "role_class", "n", "blank"))
        first, rows = edges[:-1], len(edges) - 1
        total = lambda x: np.add.reduceat(x, first, dtype=np.int64)
        gone = code == GONE
        # pairs inside equal rows are never legal; between neighbours, by their classes
        legal = np.isin(kind[:-1] * 4 + kind[1:], (0 * 4 + 1, 1 * 4 + 2, 2 * 4 + 1))
        between = np.zeros(len(code), np.int64)
        between[1:] = ~legal
        between[first] = 0
        more = n - 1
        cost, audit = np.zeros(rows, np.int64), np.full(rows, None, object)
        picks = np.flatnonzero(whole)
        if len(picks):
            at = np.concatenate([np.arange(edges[k], edges[k + 1]) for k in picks])
            begin = np.concatenate([[0], np.cumsum(edges[picks + 1] - edges[picks])])
            after, costs = automaton().scan(code[at], begin, [FINAL] * len(picks))
            texts, last = automaton().trace(code[at], more[at], begin, after, np.zeros(len(picks), np.int8))
            cost[picks] = [c[0] for c in costs]
            audit[picks] = [t + finish(int(q)) for t, q in zip(texts, last)]
        cost += np.where(whole, DELETE * total(more), 0)
        open_codes, open_more, open_costs = [None] * rows, [None] * rows, [None] * rows
        for k in np.flatnonzero(~whole):
            part = slice(edges[k], edges[k + 1])
            lanes = [automaton().scan(code[part], np.array([0, edges[k + 1] - edges[k]]), [b])[1][0] for b in basis]
            extra = DELETE * int(more[part].sum())
            open_costs[k] = [FAR if lanes[q][p] >= FAR else lanes[q][p] + extra for p in range(4) for q in range(4)]
            open_codes[k], open_more[k] = code[part], more[part]
        columns = [
            table["conv_id"].combine_chunks().take(pa.array(first)), pa.array(number + np.arange(rows)), pa.array(whole), pa.array(total(np.where(blank, n, 0))),
            pa.array(total(np.where(blank, 0, np.where(gone, n, more)))), pa.array(total((code >= CUT) & ~gone)), pa.array(total(more + between)),
            pa.array(kind[first]), pa.array(kind[edges[1:] - 1]), pa.array(cost), pa.array(audit, pa.string()), pa.array(open_codes, pa.list_(pa.int8())),
            pa.array(open_more, pa.list_(pa.int64())), pa.array(open_costs, pa.list_(pa.int64())),
        ]
        return pa.RecordBatch.from_arrays(columns, names=names)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, begun = TaskContext.get().partitionId() << 33, [], False

        def work(table: pa.Table, last: bool) -> tuple[pa.RecordBatch | None, pa.Table | None]:
            """Solve all conversations that end in ``table``; the rows of the last one are kept unless nothing follows."""
            ids = table["conv_id"].combine_chunks()
            one, two = ids.slice(0, len(ids) - 1), ids.slice(1)
            differs = pc.fill_null(pc.not_equal(one, two), pa.scalar(True))
            both = pc.and_(pc.is_null(one), pc.is_null(two))
            changes = np.flatnonzero(pc.and_not(differs, both).to_numpy(zero_copy_only=False)) + 1
            bounds = np.concatenate([[0], changes, [len(ids)]])
            inner = np.ones(len(bounds) - 1, bool)
            inner[0], inner[-1] = begun, False  # a task's first and last conversation may go on in its neighbours
            keep = bounds[-2] if not last and len(ids) - bounds[-2] < SEGMENT else len(ids)
            edges, whole = [0], []
            for a, b, w in zip(bounds[:-1], np.minimum(bounds[1:], keep), inner):
                for at in range(a, b, SEGMENT):
                    edges.append(min(b, at + SEGMENT))
                    whole.append(bool(w) and b - a <= SEGMENT)
            rest = table.slice(keep) if keep < len(ids) else None
            return (solved(table.slice(0, keep), np.array(edges), np.array(whole), number) if len(edges) > 1 else None), rest

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= TOGETHER:
                out, rest = work(pa.Table.from_batches(held), False)
                if out is not None:
                    # where the last conversation was cut at its end so far, what follows is its next segment
                    begun, number = rest is not None and rest.num_rows > 0, number + out.num_rows
                    yield out
                held = rest.to_batches() if rest is not None else []
        if held and sum(b.num_rows for b in held):
            out, _ = work(pa.Table.from_batches(held), True)
            if out is not None:
                yield out

    return ordered.mapInArrow(cut, schema)


def _joined(segments: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv_id, n_blank, n_dup, n_cut, n_illegal, cost, audit) of conversations that are not whole in one task."""
    kind = segments.schema["conv_id"].dataType.simpleString()
    parts = segments.where("not whole").drop("whole", "cost", "audit")
    lists = parts.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("seg", "costs"))).alias("s"))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                items, v = batch.column("s")[k].as_py(), list(FINAL)
                ends, costs = [], []
                for item in reversed(items):
                    ends.append(v)
                    m = item["costs"]
                    v = [min(FAR, *(m[4 * p + q] + v[q] for q in range(4))) for p in range(4)]
                    costs.append(v[0])
                rows = [(items[len(items) - 1 - j]["seg"], e, j == len(items) - 1, costs[j]) for j, e in enumerate(ends)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["seg", "ends", "leads", "cost"])

    ends = scratch.save(lists.mapInArrow(vectors, "seg long, ends array<bigint>, leads boolean, cost long"), "ends")
    pieces = parts.join(ends, "seg").select("conv_id", "seg", "n_blank", "n_dup", "n_cut", "n_illegal", "head", "tail", "leads", "cost", "codes", "more", "ends")
    copied = ["conv_id", "seg", "n_blank", "n_dup", "n_cut", "n_illegal", "head", "tail", "leads", "cost"]

    def traced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, first = _flat(batch.column("codes"))
            more, _ = _flat(batch.column("more"))
            after, _ = automaton().scan(codes, first, [tuple(e) for e in batch.column("ends").to_pylist()])
            audits, exits = [], []
            for q in range(4):
                texts, last = automaton().trace(codes, more, first, after, np.full(batch.num_rows, q, np.int8))
                audits.append(texts)
                exits.append(last)
            columns = [pa.array([list(x) for x in zip(*audits)], pa.list_(pa.string())), pa.array([[int(i) for i in x] for x in zip(*exits)], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in copied], *columns], names=[*copied, "audits", "exits"])

    traces = pieces.mapInArrow(
        traced, f"conv_id {kind}, seg long, n_blank long, n_dup long, n_cut long, n_illegal long, head byte, tail byte, leads boolean, cost long, audits array<string>, exits array<int>"
    )
    joined = traces.groupBy("conv_id").agg(
        *[F.sum(c).alias(c) for c in ("n_blank", "n_dup", "n_cut", "n_illegal")], F.max(F.when(F.col("leads"), F.col("cost"))).alias("cost"),
        F.array_sort(F.collect_list(F.struct("seg", "head", "tail", "audits", "exits"))).alias("s"),
    )

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            audits, illegal = [], batch.column("n_illegal").to_pylist()
            for k in range(batch.num_rows):
                q, out, before = 0, [], None
                for item in batch.column("s")[k].as_py():
                    illegal[k] += before is not None and (before, item["head"]) not in ((0, 1), (1, 2), (2, 1))
                    out.append(item["audits"][q])
                    q, before = item["exits"][q], item["tail"]
                audits.append("".join(out) + finish(q))
            columns = [batch.column("conv_id"), *[batch.column(c) for c in ("n_blank", "n_dup", "n_cut")], pa.array(illegal, pa.int64()), batch.column("cost"), pa.array(audits, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["conv_id", "n_blank", "n_dup", "n_cut", "n_illegal", "cost", "audit"])

    return joined.mapInArrow(chosen, f"conv_id {kind}, n_blank long, n_dup long, n_cut long, n_illegal long, cost long, audit string")


def audits(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv_id, n_blank, n_dup, n_cut, n_illegal, cost, audit) of every conversation that has rows."""
    order = ["conv_id", "turn", "role", "key"]
    ordered = _coded(rows).repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "code", "role_class", "n", "blank")
    segments = scratch.save(_segments(ordered), "segments")
    alone = segments.where("whole").select("conv_id", "n_blank", "n_dup", "n_cut", "n_illegal", "cost", "audit")
    return scratch.save(alone.unionByName(_joined(segments, scratch)), "audits")


# --- repaired texts ----------------------------------------------------------------------------------------------------------


class _Writer:
    """The repaired text of a conversation, hashed as its turns arrive in order."""

    def __init__(self, audit: str) -> None:
        self.audit, self.at, self.q, self.hash, self.lines = audit, 0, 0, hashlib.sha256(), 0

    def line(self, role: str, text: str) -> None:
        self.hash.update((("\n" if self.lines else "") + f"{role}:{text}").encode())
        self.lines += 1

    def inserted(self) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            self.line(ADDED[self.q], "")
            self.q, self.at = NEXT[self.q], self.at + 1

    def turn(self, role: str, text: str) -> None:
        self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.line(role, text)
            self.q = STEP[self.q][CLASSES.index(role[0])]
        elif edit == "R":
            self.line(ADDED[self.q], text)
            self.q = NEXT[self.q]

    def digest(self) -> str:
        self.inserted()
        return self.hash.hexdigest()


def _hashed(rows: DataFrame, found: DataFrame) -> DataFrame:
    """``found`` with ``repaired_sha256``: every conversation's row comes before its turns, in one stream."""
    columns = found.columns
    turns = rows.where("times > 0").withColumn("key", _key())
    own = [F.lit(None).cast(found.schema[c].dataType).alias(c) for c in columns if c != "conv_id"]
    both = found.select("*", F.lit(0).alias("__kind"), *[F.lit(None).cast(turns.schema[c].dataType).alias(f"__{c}") for c in ("turn", "role", "key", "text", "times")]).unionByName(
        turns.select("conv_id", *own, F.lit(1).alias("__kind"), *[F.col(c).alias(f"__{c}") for c in ("turn", "role", "key", "text", "times")])
    )
    stream = both.repartition("conv_id").sortWithinPartitions("conv_id", "__kind", "__turn", "__role", "__key")
    schema = ", ".join([*[f"`{c}` {found.schema[c].dataType.simpleString()}" for c in columns], "repaired_sha256 string"])

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, writer = None, None

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*[row.column(c) for c in columns], pa.array([writer.digest()])], names=[*columns, "repaired_sha256"])

        for batch in batches:
            out = []
            kinds, times = batch.column("__kind").to_pylist(), batch.column("__times").to_pylist()
            roles, texts, edits = batch.column("__role"), batch.column("__text"), batch.column("audit")
            for k, kind in enumerate(kinds):
                if kind == 0:
                    if writer is not None:
                        out.append(done())
                    row, writer = batch.take(pa.array([k])), _Writer(edits[k].as_py() or "")
                else:
                    role, text = roles[k].as_py(), texts[k].as_py()
                    for _ in range(times[k]):
                        writer.turn(role, text)
            if out:
                yield from pa.Table.from_batches(out).combine_chunks().to_batches()
        if writer is not None:
            yield done()

    return stream.mapInArrow(hashes, schema)


def repair(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every conversation.

    ``rows`` (conv_id, turn, role, text, times): each row counts ``times`` times; a conversation whose rows all count 0 has no faults
    and an empty audit.
    """
    scratch = Scratch(rows.sparkSession, "conversations", batch_rows=2_000)
    there = F.col("times") > 0
    turn = F.when(there, F.col("turn").cast("long"))
    spread = rows.groupBy("conv_id").agg(F.min(turn).alias("low"), F.max(turn).alias("high"), F.count_distinct(turn).alias("turns"))
    gaps = F.when(F.col("turns") == 0, F.lit(0).cast("long")).otherwise(F.expr("try_subtract(try_add(try_subtract(high, low), 1L), turns)"))
    made = audits(rows, scratch).withColumnRenamed("conv_id", "c")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
    found = spread.join(made, F.col("conv_id").eqNullSafe(F.col("c")), "left").select(
        "conv_id", gaps.alias("gaps"), zero("n_blank").alias("blank"), zero("n_dup").alias("duplicate"), zero("n_cut").alias("truncated"), zero("n_illegal").alias("illegal"),
        zero("cost").alias("cost"), F.coalesce("audit", F.lit("")).alias("audit"),
    )
    out = scratch.save(_hashed(rows, found), "repaired")
    scratch.drop("segments", "ends", "audits")
    return out


def damage_and_repair(df: DataFrame) -> DataFrame:
    """The repair of a damaged copy of a table of conversations."""
    return repair(damaged(df))
