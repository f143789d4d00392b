"""Best-fit packing of tokenised documents into sequences of a fixed length.

Documents are tokenised with a public byte-level BPE and end with a separator id. Only documents longer
than a sequence are cut, into pieces of exactly one sequence; the first piece takes the remainder. Pieces
are then placed by best-fit decreasing: the tightest open sequence that still has room, found by a descent
in a segment tree over remaining capacities (0..length), in logarithmic time per piece.

Scale: tokenising is a map over rows. Packing sees narrow rows only (ids and lengths, no tokens) in groups
of about ``GROUP`` pieces by a hash of (document, piece), each a random sample of all lengths. A group leaves at
most one sequence filled to one half or less; these are packed once more, ``OPEN`` at a time, as if each were a
piece, so all groups together lose a few sequences only.

Cases: null text is the empty text, whose only token is the separator; repeated rows are packed once each;
a null id is a value like any other; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import Scratch

LENGTH = 2048
SEPARATOR = 0
#: Characters of white space in a row from which a text goes through the file's own library.
LONG_BLANK = 10_000
#: Pieces packed together; a group's rows are some 60 bytes each.
GROUP = 40_000
#: Half-empty sequences (one a group) that are packed together.
OPEN = 4_000
PIECES = "doc_id {id}, piece int, start long, length long, ids_crc32 long"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(maxsize=4)
def encoder(path: str):
    """text -> list of ids, as the file's own library gives them without special tokens around a text.

    Texts that hold an added token of the file (such as its end-of-text mark) or very long white space, which the faster library's
    pattern cannot take back, go through that library; others through one that needs a quarter of the time and gives the same ids (a test
    compares them). Ids are the merge ranks in such files.
    """
    import public_tokenizers
    import tiktoken
    import tokenizers

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    to_byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
    special = {t["content"] for t in spec.get("added_tokens", [])}
    ranks = {bytes(to_byte[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    fast = tiktoken.Encoding("bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    own = tokenizers.Tokenizer.from_file(path)
    # tokens that match in any case, too
    holds = re.compile("|".join([*map(re.escape, sorted(special)), rf"\s{{{LONG_BLANK}}}"]), re.I).search

    def encode(text: str) -> list[int]:
        return own.encode(text, add_special_tokens=False).ids if holds(text) else fast(text)

    return encode


def cut(n: int, length: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n tokens; only the first may be short."""
    head = n % length
    starts = ([0] if head else []) + list(range(head, n, length))
    return [(s, (head if head and s == 0 else length)) for s in starts]


def tokenise(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, length: int = LENGTH, keep_ids: bool = False
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, and the ids themselves if asked for."""
    path = tokenizer or default_tokenizer()
    narrow = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = narrow.schema["doc_id"].dataType.simpleString()
    names = ["piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in batches:
            rows: list[int] = []
            out: list[list] = [[] for _ in names]
            for i, text in enumerate(batch.column(1)):
                ids = np.array([*encode(text.as_py()), SEPARATOR], dtype="<u4")
                for k, (start, n) in enumerate(cut(len(ids), length)):
                    part = ids[start : start + n]
                    rows.append(i)
                    for column, value in zip(out, (k, start, n, zlib.crc32(part.tobytes()), part), strict=False):
                        column.append(value)
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), *(pa.array(c, t) for c, t in zip(out, kinds, strict=False))],
                names=["doc_id", *names],
            )

    return narrow.mapInArrow(run, PIECES.format(id=kind) + ", ids array<long>" * keep_ids)


class OpenSequences:
    """Open sequences by remaining capacity, under a segment tree that marks which capacities occur."""

    def __init__(self, length: int) -> None:
        self.base = 1 << max(1, length.bit_length())
        self.any = bytearray(2 * self.base)
        self.stacks: list[list[int]] = [[] for _ in range(length + 1)]

    def _mark(self, capacity: int, value: int) -> None:
        node = capacity + self.base
        self.any[node] = value
        while node > 1:
            node >>= 1
            now = self.any[2 * node] | self.any[2 * node + 1]
            if self.any[node] == now:
                return
            self.any[node] = now

    def push(self, capacity: int, sequence: int) -> None:
        self.stacks[capacity].append(sequence)
        if len(self.stacks[capacity]) == 1:
            self._mark(capacity, 1)

    def tightest(self, need: int) -> tuple[int, int] | None:
        """(capacity, sequence) with the least capacity of at least ``need``, taken out of the tree."""
        node = need + self.base
        if not self.any[node]:
            while node > 1 and (node & 1 or not self.any[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.base:
                node = 2 * node + (not self.any[2 * node])
        capacity = node - self.base
        sequence = self.stacks[capacity].pop()
        if not self.stacks[capacity]:
            self._mark(capacity, 0)
        return capacity, sequence


def best_fit(lengths: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of every piece, by best-fit decreasing."""
    tree, made = OpenSequences(length), 0
    sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        found = tree.tightest(need)
        if found is None:
            capacity, chosen, made = length, made, made + 1
        else:
            capacity, chosen = found
        sequence[i], offset[i] = chosen, length - capacity
        if capacity > need:
            tree.push(capacity - need, chosen)
    return sequence, offset


def pack(pieces: DataFrame, groups: int, length: int = LENGTH) -> DataFrame:
    """``pieces`` (doc_id, piece, length and others) with ``sequence_id`` and ``offset`` (long)."""
    schema = T.StructType([*pieces.schema.fields, *(T.StructField(c, T.LongType()) for c in ("sequence_id", "offset", "__fill"))])

    def place(key: tuple, group: pa.Table) -> pa.Table:
        group = group.drop_columns(["__group"])
        order = [("doc_id", "ascending"), ("piece", "ascending"), ("start", "ascending")]
        group = group.sort_by(order)  # the same packing however rows arrive
        sizes = group["length"].to_numpy().astype(np.int64)
        sequence, offset = best_fit(sizes, length)
        filled = np.bincount(sequence, sizes).astype(np.int64)[sequence]
        for name, values in (("sequence_id", sequence * groups + key[0].as_py()), ("offset", offset), ("__fill", filled)):
            group = group.append_column(name, pa.array(values))
        return group

    def merge(key: tuple, group: pa.Table) -> pa.Table:
        group = group.drop_columns(["__group"])
        ids, first, of = np.unique(group["sequence_id"].to_numpy(), return_index=True, return_inverse=True)
        sequence, offset = best_fit(group["__fill"].to_numpy()[first], length)
        # a sequence takes the id of the one at its beginning
        head = np.empty(sequence.max() + 1, np.int64)
        head[sequence[offset == 0]] = ids[offset == 0]
        moved = {"sequence_id": head[sequence][of], "offset": group["offset"].to_numpy() + offset[of]}
        for name, values in moved.items():
            group = group.set_column(group.column_names.index(name), name, pa.array(values))
        return group

    keyed = pieces.withColumn("__group", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(groups)))
    placed = keyed.groupBy("__group").applyInArrow(place, schema)
    if groups == 1:
        return placed.drop("__fill")
    placed = Scratch(pieces.sparkSession, "packing").save(placed, "placed")
    half = F.col("__fill") * 2 <= length
    again = placed.where(half).withColumn("__group", F.pmod(F.xxhash64("sequence_id"), F.lit(-(-groups // OPEN))))
    return placed.where(~half).unionByName(again.groupBy("__group").applyInArrow(merge, schema)).drop("__fill")


def pack_documents(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, length: int = LENGTH, group: int = GROUP
) -> DataFrame:
    """Tokenise and pack a table of documents; one row per piece."""
    scratch = Scratch(df.sparkSession, "packing")
    pieces = scratch.save(tokenise(df, id_col, text_col, tokenizer, length), "pieces")
    return pack(pieces, max(1, -(-pieces.count() // group)), length)


def fill(packed: pd.DataFrame, length: int = LENGTH) -> float:
    """Share of all places that hold a token."""
    return packed["length"].sum() / (packed["sequence_id"].nunique() * length)
