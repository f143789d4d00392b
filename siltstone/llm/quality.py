"""Quality classifier: a generalised additive model with pairwise interactions.

Each text becomes ``FEATURES`` numbers about its form (no words, labels, languages or sources). Every
feature is cut into quantile bins; cyclic gradient boosting visits the features in turn and adds a shrunken
shallow tree over one feature's bins to that feature's lookup table, then does the same for the pairs of
features whose coarse grids explain most of what is left. A score is the logistic of a sum of table
entries, so scoring is binning and additions over whole batches.

Training takes at most ``MAX_ROWS`` labels (those with the smallest hash of their id) and of the rows that have
them again at most as many, and brings their features, not their texts, to the driver. Scoring is a map over all rows.

Cases: null text scores as the empty text; labels that are null are not used; rows that repeat count as
often as they occur; without labelled rows the model is a constant (smoothed share of good rows, 0.5); an input
column of the name that the score gets is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv

MAX_ROWS = 20_000
FEATURES = (
    "log_bytes", "upper", "digits", "symbols", "stops", "pipes", "other_bytes", "word_bytes", "marked_words", "bare_marks",
    "distinct_words", "repeated_phrases", "repeated_lines", "line_bytes", "sentence_ends",
)


def _mask(chars: bytes) -> np.ndarray:
    out = np.zeros(256, np.uint8)
    out[list(chars)] = 1
    return out


_LOWER, _UPPER, _DIGIT = _mask(bytes(range(97, 123))), _mask(bytes(range(65, 91))), _mask(b"0123456789")
_SYMBOL, _STOP, _PIPE, _OTHER = _mask(b"!#$%&*+/<=>@[\\]^_`{|}~"), _mask(b".,;:?"), _mask(b"|"), _mask(bytes(range(128, 256)))
_WORDY = (_LOWER | _UPPER | _DIGIT | _OTHER).astype(bool)
_PLAIN_END = _WORDY | _mask(b".,;:?!\"')").astype(bool)


def features(texts: pa.Array) -> np.ndarray:
    """(rows, features) of a batch of texts."""
    raw, offsets = tv.buffer_of(texts)
    rows, size = len(texts), np.diff(offsets)

    def share(mask: np.ndarray, of: np.ndarray = size) -> np.ndarray:
        total = np.zeros(rows)
        full = np.flatnonzero(size)
        if len(full):
            total[full] = np.add.reduceat(mask[raw], offsets[:-1][full], dtype=np.int64)
        return total / np.maximum(of, 1)

    def per_row(flags: np.ndarray, first: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags)])
        return total[first[1:]] - total[first[:-1]]

    w = tv.words(raw, offsets, tv.table(tv.SPACES))
    words, row = np.diff(w.first), w.row_of()
    count = np.maximum(words, 1)
    last = raw[w.end - 1] if len(w.end) else raw[:0]
    # a mark of two or more symbols at a word's end
    before = raw[np.maximum(w.end - 2, w.start)] if len(w.end) else raw[:0]
    marked = ~_WORDY[last] & ~_WORDY[before] & (w.end - w.start > 2)
    bare = ~_WORDY[raw[w.start]] & (w.end - w.start <= 2) & ~_PLAIN_END[last] if len(w.start) else np.zeros(0, bool)
    stops = last == ord(".") if len(last) else np.zeros(0, bool)
    distinct = np.bincount(tv.distinct(w.hash, row)[1], minlength=rows)
    phrase, of = tv.shingles(w, 5)
    phrases = np.bincount(of, minlength=rows)
    new = np.bincount(tv.distinct(phrase, of)[1], minlength=rows)
    lines = tv.words(raw, offsets, tv.table(b"\n", fold=False))
    n_lines = np.diff(lines.first)
    own_lines = np.bincount(tv.distinct(lines.hash, lines.row_of())[1], minlength=rows)
    letters = share(_LOWER | _UPPER | _OTHER) * np.maximum(size, 1)
    return np.column_stack([
        np.log1p(size), share(_UPPER, letters), share(_DIGIT), share(_SYMBOL), share(_STOP), share(_PIPE), share(_OTHER),
        per_row(w.end - w.start, w.first) / count, per_row(marked, w.first) / count, per_row(bare, w.first) / count,
        distinct / count**0.8, 1 - new / np.maximum(phrases, 1), 1 - own_lines / np.maximum(n_lines, 1),
        size / np.maximum(n_lines, 1), per_row(stops, w.first) / count,
    ])


@dataclass
class Gam:
    intercept: float = 0.0
    cuts: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)  # i, j, coarse bins of i and j, table

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(c, x[:, k], "right") for k, c in enumerate(self.cuts)]) if self.cuts else np.zeros((len(x), 0), int)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for every row: lookups and additions over whole columns."""
        b = self.bins(x)
        z = np.full(len(x), self.intercept)
        for k, t in enumerate(self.tables):
            z += t[b[:, k]]
        for i, j, ci, cj, t in self.pairs:
            z += t[ci[b[:, i]], cj[b[:, j]]]
        return 1 / (1 + np.exp(-z))


def _leaf(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g / (h + 1.0)


def _tree(g: np.ndarray, h: np.ndarray, depth: int) -> np.ndarray:
    """Values per bin of a regression tree over ordered bins with sums of gradients and hessians."""
    out = np.full(len(g), _leaf(g.sum(), h.sum()))
    if depth and len(g) > 1:
        gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
        gr, hr = g.sum() - gl, h.sum() - hl
        gain = gl**2 / (hl + 1.0) + gr**2 / (hr + 1.0)
        gain[(hl < 1.0) | (hr < 1.0)] = -1
        at = int(np.argmax(gain)) + 1
        if gain[at - 1] > g.sum() ** 2 / (h.sum() + 1.0):
            out[:at], out[at:] = _tree(g[:at], h[:at], depth - 1), _tree(g[at:], h[at:], depth - 1)
    return out


def _grid(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """A tree over two features: one cut of the rows, then one cut of the columns on either side; its gain."""
    best = (np.full(g.shape, _leaf(g.sum(), h.sum())), 0.0)
    for a in range(1, g.shape[0]):
        out, gain = np.empty(g.shape), 0.0
        for part in (slice(0, a), slice(a, None)):
            line = _tree(g[part].sum(0), h[part].sum(0), 1)
            out[part] = line
            for v in np.unique(line):
                gain += g[part].sum(0)[line == v].sum() ** 2 / (h[part].sum(0)[line == v].sum() + 1.0)
        if gain > best[1]:
            best = (out, gain)
    return best


def fit(x: np.ndarray, y: np.ndarray, bins: int = 32, rounds: int = 150, rate: float = 0.1, n_pairs: int = 6, pair_rounds: int = 40) -> Gam:
    """Cyclic boosting of single features, then of the best pairs."""
    good = (y.sum() + 1.0) / (len(y) + 2.0)
    model = Gam(float(np.log(good / (1 - good))))
    if len(np.unique(y)) < 2:
        return model
    model.cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1])) for k in range(x.shape[1])]
    b = model.bins(x)
    model.tables = [np.zeros(len(c) + 1) for c in model.cuts]
    z = np.full(len(y), model.intercept)

    def sums(index: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-z))
        return np.bincount(index, y - p, size), np.bincount(index, p * (1 - p), size)

    for _ in range(rounds):
        for k, t in enumerate(model.tables):
            step = rate * _tree(*sums(b[:, k], len(t)), 2)
            t += step
            z += step[b[:, k]]
    coarse = [np.minimum(7, np.arange(len(t)) * 8 // max(1, len(t))) for t in model.tables]
    gains = []
    for i in range(x.shape[1]):
        for j in range(i):
            g, h = sums(coarse[i][b[:, i]] * 8 + coarse[j][b[:, j]], 64)
            gains.append((_grid(g.reshape(8, 8), h.reshape(8, 8))[1], i, j))
    model.pairs = [(i, j, coarse[i], coarse[j], np.zeros((8, 8))) for _, i, j in sorted(gains, reverse=True)[:n_pairs]]
    for _ in range(pair_rounds):
        for i, j, ci, cj, t in model.pairs:
            at = ci[b[:, i]] * 8 + cj[b[:, j]]
            g, h = sums(at, 64)
            step = rate * _grid(g.reshape(8, 8), h.reshape(8, 8))[0]
            t += step
            z += step.ravel()[at]
    return model


def is_held_out(id_col):
    """Rows never trained on: crc32 of the id's text, modulo 3, is 1; a null id is not held out."""
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = MAX_ROWS) -> Gam:
    """Fit on labelled rows that are not held out: at most ``max_rows`` of them, by the hash of their id."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y is not null")
    sample = known.where(~is_held_out(F.col("id"))).orderBy(F.xxhash64("id"), "y").limit(max_rows)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    joined = rows.join(F.broadcast(sample), "id").select("id", "y", "text")  # max_rows rows of two numbers
    names = ", ".join(f"{f} double" for f in FEATURES)

    def describe(batches):
        for batch in batches:
            for part in tv.slices(batch, text=2):
                x = features(part.column(2))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array(c) for c in x.T)], names=["id", "y", *FEATURES])

    kind = joined.schema["id"].dataType.simpleString()
    described = joined.mapInArrow(describe, f"id {kind}, y int, {names}")
    # an id that many rows share gives no more than the bound
    found = described.orderBy(F.xxhash64("id"), "y", F.xxhash64(*FEATURES)).limit(max_rows).toPandas()
    found = found.sort_values(["id", "y", *FEATURES], kind="stable")  # sums do not depend on the order of tasks
    return fit(found[list(FEATURES)].to_numpy(), found["y"].to_numpy(dtype=np.float64))


def with_score(df: DataFrame, model: Gam, text_col: str = "text", name: str = "score") -> DataFrame:
    """``df`` and a column with every row's score."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # some 20 small tables

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return tv.over_slices(texts, lambda part: pa.array(shared.value.score(features(part))), pa.float64())

    return df.withColumn(name, score.asNondeterministic()(F.coalesce(F.col(text_col), F.lit(""))))
