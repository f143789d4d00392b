"""Quality rules as a bitmask ledger: every rule is evaluated once, policies are masks over the outcome.

``ledger`` gives every text its measurements (counts, so nothing is lost by rounding) and one long with a bit
for each rule that it fails. What follows never looks at a text again: a policy names the bits that reject
a text by themselves and those of which a text may fail some; applying another version, or asking what each rule
of a version removes, is arithmetic on the stored bits. ``ablations`` counts the ledger by its masks first,
combined before the shuffle, and then reads each rule's effect from at most 2^rules counts.

Scale: measuring is a map over rows, in parts of some 2 MB of text; a long text is measured whole. No row is
shuffled; ablations shuffle one count for every mask that occurs in a task.

Cases: null text is the empty text; an empty text has no words and fails ``few_words``; repeated rows and ids are judged row by row;
an empty table gives an empty ledger and ablations of zero; an input column named like one of the ledger's is replaced.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textvec as tv

MEASURES = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_upper", "n_digits", "n_marked_words", "n_plain_words",
)
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


@dataclass(frozen=True)
class Rule:
    """A bit of the ledger and the condition on the measurements under which a text fails."""

    bit: int
    name: str
    fails: Callable[[Callable[[str], Column]], Column]


def _share(part: str, whole: str, percent: int) -> Callable[[Callable[[str], Column]], Column]:
    return lambda m: m(part) * 100 > m(whole) * percent


#: Bits are never reused: a retired rule keeps its place, so stored ledgers stay readable.
RULES = (
    Rule(0, "few_words", lambda m: m("n_words") < 50),
    Rule(1, "repeated_words", _share("n_repeat_words", "n_words", 50)),
    Rule(2, "many_words", lambda m: m("n_words") > 1_000_000),
    Rule(3, "short_words", lambda m: m("word_chars") < m("n_words") * 2),
    Rule(4, "long_words", lambda m: m("word_chars") > m("n_words") * 16),
    Rule(5, "symbols", _share("n_symbols", "n_words", 10)),
    Rule(6, "repeated_lines", _share("n_dup_lines", "n_lines", 50)),
    Rule(7, "shouting", _share("n_upper", "n_letters", 40)),
    Rule(8, "marked_words", _share("n_marked_words", "n_words", 10)),
    Rule(9, "few_plain_words", lambda m: m("n_plain_words") * 100 < m("n_words") * 60),
    Rule(10, "digits", lambda m: m("n_digits") * 100 > m("word_chars") * 30),
)


@dataclass(frozen=True)
class Policy:
    """A version of the verdict: rules that reject alone, and rules of which ``allowed`` may fail."""

    version: str
    rejects: tuple[str, ...]
    soft: tuple[str, ...] = ()
    allowed: int = 0

    @staticmethod
    def mask(names: tuple[str, ...]) -> int:
        bits = {r.name: r.bit for r in RULES}
        return sum(1 << bits[n] for n in names)

    def keeps(self, failed: Column) -> Column:
        """Whether a text with these failure bits stays."""
        hard = failed.bitwiseAND(F.lit(self.mask(self.rejects)).cast("long")) == 0
        return hard & (F.bit_count(failed.bitwiseAND(F.lit(self.mask(self.soft)).cast("long"))) <= self.allowed)


BASE = Policy("base", ("few_words", "repeated_words"))
STRICT = Policy("strict", tuple(r.name for r in RULES))
CURRENT = Policy(
    "2", ("few_words", "repeated_words", "many_words", "symbols", "shouting", "marked_words"), ("short_words", "long_words", "repeated_lines", "few_plain_words", "digits"), 1
)


def _mask(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_SPACE, _SYMBOL, _UPPER, _DIGIT = _mask(tv.SPACES), _mask(b"#*$%&|<>"), _mask(bytes(range(65, 91))), _mask(b"0123456789")
_INNER = _mask(bytes(range(128, 192)))  # bytes inside a code point
_LETTER = _UPPER | _mask(bytes(range(97, 123))) | _mask(bytes(range(192, 256)))
_WORDY = _LETTER | _DIGIT | _INNER


def _repeated(text: bytes) -> int:
    """Words of a text inside three-word windows that it holds at least twice, by the words themselves."""
    words = WORD.findall(text)
    windows = list(zip(words, words[1:], words[2:]))
    count = Counter(windows)
    inside = np.zeros(len(words), bool)
    for k, w in enumerate(windows):
        if count[w] > 1:
            inside[k : k + 3] = True
    return int(inside.sum())


def measure(texts: pa.Array) -> pa.StructArray:
    """The measurements of a batch of texts."""
    raw, offsets = tv.buffer_of(texts)
    rows = len(texts)

    def total(flags: np.ndarray) -> np.ndarray:
        out, full = np.zeros(rows, np.int64), np.flatnonzero(np.diff(offsets))
        if len(full):
            out[full] = np.add.reduceat(flags, offsets[:-1][full], dtype=np.int64)
        return out

    w = tv.words(raw, offsets, tv.table(tv.SPACES, fold=False))
    row = w.row_of()
    per_row = lambda flags: np.bincount(row[flags], minlength=rows)
    last, before = (raw[w.end - 1], raw[np.maximum(w.end - 2, w.start)]) if len(w.end) else (raw[:0], raw[:0])
    marked = ~_WORDY[last] & ~_WORDY[before] & (w.end - w.start > 2)
    plain = _WORDY[raw[w.start]] if len(w.start) else np.zeros(0, bool)
    # windows of equal words have equal hashes: only rows where some hash occurs twice can hold a repeated window
    window, of = tv.shingles(w, 3, whole_short=False)
    twice = np.bincount(of, minlength=rows) > np.bincount(tv.distinct(window, of)[1], minlength=rows)
    repeat, dup, lines = np.zeros(rows, np.int64), np.zeros(rows, np.int64), np.zeros(rows, np.int64)
    data = raw.tobytes()
    for k in range(rows):
        text = data[offsets[k] : offsets[k + 1]]
        if twice[k]:
            repeat[k] = _repeated(text)
        shown = [x for x in text.split(b"\n") if WORD.search(x)]
        lines[k], dup[k] = len(shown), len(shown) - len(set(shown))
    counts = [
        np.diff(w.first), total(~_SPACE[raw] & ~_INNER[raw]), total(_SYMBOL[raw]), dup, repeat, lines, total(_LETTER[raw]), total(_UPPER[raw]), total(_DIGIT[raw]),
        per_row(marked), per_row(plain),
    ]
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in counts], names=list(MEASURES))


def ledger(df: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``df`` with every measurement (long) and ``failed`` (long): a bit for each rule that the text fails."""
    kind = pa.struct([(m, pa.int64()) for m in MEASURES])

    @F.arrow_udf(", ".join(f"{m} long" for m in MEASURES))
    def measured(texts: pa.Array) -> pa.Array:
        return tv.over_slices(texts, measure, kind)

    at = lambda name: F.col(f"__measured.{name}")
    bits = [F.when(r.fails(at), F.lit(1 << r.bit)).otherwise(F.lit(0)).cast("long") for r in rules]
    failed = bits[0]
    for b in bits[1:]:
        failed = failed.bitwiseOR(b)
    found = df.withColumn("__measured", measured.asNondeterministic()(F.coalesce(F.col(text_col), F.lit(""))))
    return found.withColumns({m: at(m) for m in MEASURES} | {"failed": failed}).drop("__measured")


def with_verdict(found: DataFrame, policy: Policy = CURRENT) -> DataFrame:
    """A ledger with ``base_failed`` and ``kept`` under a policy; the base rules hold under every policy."""
    base = ~BASE.keeps(F.col("failed"))
    return found.withColumns({"base_failed": base, "kept": ~base & policy.keeps(F.col("failed"))})


def ablations(found: DataFrame, policies: tuple[Policy, ...] = (BASE, CURRENT, STRICT), rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """What each rule does under each policy, from a ledger's masks alone.

    (policy, rule, n_failed, n_removed, n_only): texts that fail the rule; texts that the policy removes and that fail it; texts
    that would stay if the policy did without the rule. Rules that a policy does not have remove nothing.
    """
    masks = found.groupBy("failed").agg(F.count("*").alias("n"))
    effects = []
    for p in policies:
        for r in rules:
            less = Policy(p.version, tuple(x for x in p.rejects if x != r.name), tuple(x for x in p.soft if x != r.name), p.allowed)
            fails, stays, would = F.col("failed").bitwiseAND(F.lit(1 << r.bit).cast("long")) != 0, p.keeps(F.col("failed")), less.keeps(F.col("failed"))
            known = F.lit(r.name in p.rejects + p.soft)
            effects.append(F.struct(F.lit(p.version).alias("policy"), F.lit(r.name).alias("rule"), fails.alias("f"), (known & fails & ~stays).alias("r"), (~stays & would).alias("o")))
    of = masks.select("n", F.inline(F.array(*effects)))
    summed = of.groupBy("policy", "rule").agg(*[F.sum(F.when(F.col(c), F.col("n")).otherwise(0)).alias(name) for c, name in (("f", "n_failed"), ("r", "n_removed"), ("o", "n_only"))])
    every = found.sparkSession.createDataFrame([(p.version, r.name) for p in policies for r in rules], "policy string, rule string")
    return every.join(F.broadcast(summed), ["policy", "rule"], "left").na.fill(0)  # policies times rules rows
