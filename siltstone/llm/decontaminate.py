"""Benchmark decontamination by greedy string tiling.

Texts and benchmark items are sequences of words of letters and digits, case folded by Unicode, so punctuation and
layout do not hide a copy; every character of a script without spaces is a word (``folded``). Seeds are the runs of ``min_match`` words of the benchmark. A document meets the
items with which it shares seeds; an item goes on if its shared seeds could cover the threshold. Then tiles
are laid: all runs of words common to the document and the item are found from Karp-Rabin hashes of their
seeds, the longest one that overlaps nothing marked is marked, and so on until none of ``min_match`` words
is left. The share of an item's words under tiles decides, wherever in the document the tiles lie, so
passages in another order are caught as well.

Scale: a map over documents against the benchmark's seeds. These are broadcast in blocks of whole items
with at most ``MAX_WORDS`` words (16 bytes each), or of a single longer item; a larger benchmark takes a pass for
each block. A block passes through the driver, which makes its seeds; hits of all blocks are found in one scan.

Cases: null text has no words; items of fewer than ``min_match`` words are found with ``short_items`` only, and then
wherever all of their words follow each other; repeated rows are treated alike; an empty benchmark finds nothing; equal matches are marked in order of item, then document
position; items with a null id are left out.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv

MIN_MATCH = 5
COVERAGE = 0.5
#: Words of the benchmark that are broadcast at a time.
MAX_WORDS = 2_000_000
HIT = "array<struct<item_id: bigint, covered: int, words: int, tiles: int>>"
U = np.uint64

#: Characters that show nothing, and letters of scripts that put no spaces between words.
INVISIBLE = re.compile("[\u00ad\u200b-\u200d\u2060\ufeff]")
SPACELESS = re.compile(
    "[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\ua9e0-\ua9ff\uaa60-\uaa7f\u3005-\u3007\u3041-\u309f\u30a1-\u30fa\u30fc-\u30ff\u31f0-\u31ff"
    "\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]"
)
BEYOND_ASCII = re.compile(r"[^\w\x00-\x7f]")


def folded(text: str) -> str:
    """A text whose words ASCII separators part: compatible forms and case folded, other separators as spaces."""
    if text.isascii():
        return text
    text = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", INVISIBLE.sub("", text)).casefold())
    # a mark belongs to the letter before it
    text = BEYOND_ASCII.sub(lambda m: m[0] if unicodedata.category(m[0])[0] == "M" else " ", text)
    return SPACELESS.sub(r" \g<0> ", text)


def words_of(texts: pa.Array) -> tv.Words:
    raw, offsets = tv.buffer_of(texts)
    if len(raw) and raw.max() > 127:
        rows = texts.fill_null("").cast(pa.large_binary()).to_pylist()
        raw, offsets = tv.buffer_of(pa.array([folded(t.decode("utf-8", "replace")) for t in rows], pa.large_string()))
    return tv.words(raw, offsets, tv.table(tv.SYMBOLS))


class Seeds:
    """A block of benchmark items: words of every item, and seed hash -> (item, position).

    ``short`` has the items of fewer words than a seed by their number of words: sorted hashes, ids and words.
    """

    def __init__(self, ids: list[int], texts: list[str], min_match: int, short_items: bool = False) -> None:
        w = words_of(pa.array(texts, pa.large_string()))
        self.short: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        count = np.diff(w.first)
        for n in range(1, min_match) if short_items else ():
            own = np.flatnonzero(count == n)
            if len(own):
                every = w.hash[w.first[own][:, None] + np.arange(n)]
                seed = np.array([tv.combine(x, n)[0] for x in every], U)
                order = np.argsort(seed, kind="stable")
                self.short[n] = seed[order], np.array(ids)[own][order], every[order]
        keep = [k for k in range(len(ids)) if w.first[k + 1] - w.first[k] >= min_match]
        self.ids = [ids[k] for k in keep]
        self.words = [w.hash[w.first[k] : w.first[k + 1]] for k in keep]
        self.m = min_match
        runs = [tv.combine(x, min_match) for x in self.words]
        seed = np.concatenate(runs) if runs else np.zeros(0, U)
        order = np.argsort(seed, kind="stable")
        self.seed = seed[order]
        self.item = np.repeat(np.arange(len(runs)), [len(r) for r in runs])[order] if runs else np.zeros(0, int)
        self.place = (np.concatenate([np.arange(len(r)) for r in runs]) if runs else np.zeros(0, int))[order]
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(seed & U((1 << 20) - 1)).astype(np.int64)] = True

    def hits(self, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index into ``seeds``, item, position in the item) of all shared seeds."""
        at = np.flatnonzero(self.maybe[(seeds & U((1 << 20) - 1)).astype(np.int64)])
        low, high = np.searchsorted(self.seed, seeds[at], "left"), np.searchsorted(self.seed, seeds[at], "right")
        times = high - low
        which = np.repeat(low - np.cumsum(times) + times, times) + np.arange(times.sum())
        return np.repeat(at, times), self.item[which], self.place[which]

    def short_hits(self, w: tv.Words) -> Iterator[tuple[int, int, int]]:
        """(row, item id, words) of the short items that rows hold, each once."""
        for n, (seed, ids, every) in self.short.items():
            made = tv.combine(w.hash, n)
            low, high = np.searchsorted(seed, made, "left"), np.searchsorted(seed, made, "right")
            at = np.flatnonzero(high > low)
            row = np.searchsorted(w.first, at, "right") - 1
            within = at + n <= w.first[row + 1]
            at, row = at[within], row[within]
            _, once = np.unique(np.stack([row, low[at]]), axis=1, return_index=True)
            for p, r in zip(at[once].tolist(), row[once].tolist(), strict=True):
                for k in range(low[p], high[p]):
                    if np.array_equal(every[k], w.hash[p : p + n]):
                        yield r, int(ids[k]), n


def tile(doc: np.ndarray, item: np.ndarray, doc_at: np.ndarray, item_at: np.ndarray, m: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (position in the document, position in the item, length) of every tile.

    ``doc_at`` and ``item_at`` are the places of all shared runs of m words. Each round finds the maximal
    unmarked runs on every diagonal and marks the longest; only its overlaps change for the next round. Seeds of
    equal hash but other words are left out first.
    """
    run = np.arange(m)
    same = (doc[doc_at[:, None] + run] == item[item_at[:, None] + run]).all(axis=1)
    doc_at, item_at = doc_at[same], item_at[same]
    free_doc, free_item = np.ones(len(doc) + 1, bool), np.ones(len(item) + 1, bool)
    tiles: list[tuple[int, int, int]] = []
    while len(doc_at):
        # seeds that lie free; consecutive ones of a diagonal are one run
        taken_doc, taken_item = np.concatenate([[0], np.cumsum(~free_doc)]), np.concatenate([[0], np.cumsum(~free_item)])
        free = (taken_doc[doc_at + m] == taken_doc[doc_at]) & (taken_item[item_at + m] == taken_item[item_at])
        doc_at, item_at = doc_at[free], item_at[free]
        if not len(doc_at):
            break
        diagonal = doc_at - item_at
        order = np.lexsort((doc_at, diagonal))
        d, i, g = doc_at[order], item_at[order], diagonal[order]
        new = np.ones(len(d), bool)
        new[1:] = (g[1:] != g[:-1]) | (d[1:] != d[:-1] + 1)
        start = np.flatnonzero(new)
        length = np.diff(np.append(start, len(d))) + m - 1
        longest = length.max()
        # all matches of the greatest length that do not overlap, in order
        best = start[length == longest]
        best = best[np.lexsort((d[best], i[best]))]
        for p, q in zip(d[best].tolist(), i[best].tolist(), strict=True):
            if free_doc[p : p + longest].all() and free_item[q : q + longest].all():
                free_doc[p : p + longest] = False
                free_item[q : q + longest] = False
                tiles.append((p, q, int(longest)))
    return tiles


def blocks(benchmark: DataFrame, id_col: str, text_col: str, min_match: int, max_words: int, short_items: bool) -> Iterator[Seeds]:
    """The benchmark's items, some at a time; the driver holds one block."""
    rows = benchmark.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    ids, texts, size = [], [], 0
    for row in rows.orderBy("i", "t").toLocalIterator():
        n = len(words_of(pa.array([row.t], pa.large_string())).hash) + 1
        if ids and size + n > max_words:
            yield Seeds(ids, texts, min_match, short_items)
            ids, texts, size = [], [], 0
        ids.append(row.i)
        texts.append(row.t)
        size += n
    if ids:
        yield Seeds(ids, texts, min_match, short_items)


def with_hits(
    df: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", name: str = "hits",
    min_match: int = MIN_MATCH, coverage: float = COVERAGE, max_words: int = MAX_WORDS, short_items: bool = False,
) -> DataFrame:
    """``df`` and an array of the items that each row's text contains: item_id, covered, words, tiles."""
    context = df.sparkSession.sparkContext
    found = F.array().cast(HIT)
    for block in blocks(benchmark, item_col, item_text, min_match, max_words, short_items):
        found = F.concat(found, _search(context.broadcast(block), coverage)(F.coalesce(F.col(text_col), F.lit(""))))
    return df.withColumn(name, found)


def _search(shared, coverage: float):
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("covered", pa.int32()), ("words", pa.int32()), ("tiles", pa.int32())]))

    def part(texts: pa.Array) -> pa.Array:
        b: Seeds = shared.value
        w = words_of(texts)
        every = tv.combine(w.hash, b.m)
        at, item, place = b.hits(every)
        row = np.searchsorted(w.first, at, "right") - 1
        inside = at + b.m <= w.first[row + 1]
        at, item, place, row = at[inside], item[inside], place[inside], row[inside]
        out: list[list[dict]] = [[] for _ in range(len(texts))]
        for r, i, n in b.short_hits(w):
            out[r].append({"item_id": i, "covered": n, "words": n, "tiles": 1})
        if not len(row):
            return pa.array(out, kind)
        order = np.lexsort((at, item, row))
        at, item, place, row = at[order], item[order], place[order], row[order]
        cut = np.flatnonzero(np.diff(row, prepend=-1) | np.diff(item, prepend=-1))
        for x, y in zip(cut.tolist(), [*cut[1:].tolist(), len(row)], strict=True):
            r, k = int(row[x]), int(item[x])
            words = b.words[k]
            could = np.zeros(len(words) + 1, np.int64)
            np.add.at(could, place[x:y], 1)
            np.add.at(could, place[x:y] + b.m, -1)
            if (np.cumsum(could)[:-1] > 0).sum() < coverage * len(words):
                continue  # even all shared seeds cover too little
            doc = w.hash[w.first[r] : w.first[r + 1]]
            tiles = tile(doc, words, at[x:y] - w.first[r], place[x:y], b.m)
            covered = sum(t[2] for t in tiles)
            if covered >= coverage * len(words):
                out[r].append({"item_id": b.ids[k], "covered": covered, "words": len(words), "tiles": len(tiles)})
        return pa.array(out, kind)

    @F.arrow_udf(HIT)
    def search(texts: pa.Array) -> pa.Array:
        return tv.over_slices(texts, part, kind)

    return search.asNondeterministic()  # evaluated once, whatever filters stand above


def _unused(df: DataFrame, name: str = "__hits") -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def contaminated(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """One row per document and item it contains: id, item_id, covered, words, tiles, coverage."""
    name = _unused(df)
    rows = with_hits(df, benchmark, name=name, **options).select(F.col(id_col), F.explode(name).alias("h"))
    return rows.select(id_col, "h.item_id", "h.covered", "h.words", "h.tiles", (F.col("h.covered") / F.col("h.words")).alias("coverage"))


def clean_documents(df: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``df`` that contain no item, with their columns as they are."""
    name = _unused(df)
    return with_hits(df, benchmark, name=name, **options).where(F.size(name) == 0).drop(name)
