"""Removal of repeated passages by overlapping windows of three consecutive lines.

Lines are what ``\\n`` separates, compared as they are. Every window of ``window`` consecutive lines is
hashed (128 bits); a window that occurs more than once anywhere keeps its first occurrence in the order
(id, position). All lines that a later occurrence covers are removed; overlapping occurrences merge.

Cases: null text counts as empty; documents of fewer lines than a window, rows with a null id and windows
without any visible character (white space of any script shows nothing) are left alone. Rows of one id and one
text are the same document, so they never remove each other's lines; rows of one id and different texts are
different documents, in the order of a hash of their texts. Columns of any other name pass through.

Everything is DataFrame code. Windows are counted with a map-side combine and joined back by hash (a join
that adaptive execution can split where one window is very common); texts are shuffled once, by id and hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 3
VISIBLE = r"[^\s\p{Z}\p{Cc}\p{Cf}]"


def mark_of(body: Column) -> Column:
    """What tells texts of one id apart."""
    return F.xxhash64(body)


def line_windows(df: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """(id, mark, pos, h1, h2) for every window; ``pos`` counts lines from 0."""
    body = F.coalesce(F.col(text_col), F.lit(""))
    lines = df.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("id"), mark_of(body).alias("mark"), F.split(body, "\n", -1).alias("lines")
    )
    # One hash per line, then one per window: a line's text is read once.
    marks = lines.select(
        "id",
        "mark",
        F.transform(
            "lines", lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit(1), x).alias("b"), x.rlike(VISIBLE).alias("seen"))
        ).alias("m"),
    ).where(F.size("m") >= window)

    def at(i, k):
        return F.get("m", i + k)

    spans = marks.select(
        "id",
        "mark",
        F.explode(
            F.transform(
                F.sequence(F.lit(0), F.size("m") - window),
                lambda i: F.struct(
                    i.alias("pos"),
                    F.xxhash64(*[at(i, k)["a"] for k in range(window)]).alias("h1"),
                    F.xxhash64(*[at(i, k)["b"] for k in range(window)]).alias("h2"),
                    F.array_max(F.array(*[at(i, k)["seen"] for k in range(window)])).alias("seen"),
                ),
            )
        ).alias("w"),
    )
    return spans.where("w.seen").select("id", "mark", "w.pos", "w.h1", "w.h2")


def repeated_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(id, mark, covered): the positions of the lines that later occurrences cover, for documents that have any."""
    spans = line_windows(df, id_col, text_col, window)
    first = (
        spans.groupBy("h1", "h2")
        .agg(F.min(F.struct("id", "mark", "pos")).alias("first"), F.max(F.struct("id", "mark", "pos")).alias("last"))
        .where("first != last")
        .select("h1", "h2", "first")
    )
    later = spans.join(first, ["h1", "h2"]).where(F.struct("id", "mark", "pos") != F.col("first"))
    covered = F.sequence(F.col("pos"), F.col("pos") + (window - 1))
    return later.groupBy("id", "mark").agg(F.array_distinct(F.flatten(F.collect_set(covered))).alias("covered"))


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """All columns of ``df`` with the text shortened, then ``n_lines`` and ``n_removed`` (long).

    Input columns called ``n_lines`` or ``n_removed`` are replaced.
    """
    rows = df.select(
        F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"),
        F.col(id_col).alias("key"),
        F.coalesce(F.col(text_col), F.lit("")).alias("body"),
    ).withColumn("mark", mark_of(F.col("body")))
    hits = repeated_lines(df, id_col, text_col, window).withColumnRenamed("id", "key")
    joined = rows.join(hits, ["key", "mark"], "left").withColumn("lines", F.split("body", "\n", -1))
    # array_except hashes, so long documents stay linear; positions keep their order
    kept = joined.withColumn(
        "kept", F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.coalesce("covered", F.array().cast("array<int>")))
    )
    text = F.when(F.col("covered").isNull(), F.col("body")).otherwise(
        F.array_join(F.transform("kept", lambda i: F.get("lines", i)), "\n")
    )
    out = [
        text.alias(c) if c == text_col else F.col("row").getField(c).alias(c)
        for c in df.columns
        if c not in ("n_lines", "n_removed") or c in (id_col, text_col)
    ]
    n = F.size("lines").cast("long")
    return kept.select(*out, n.alias("n_lines"), (n - F.size("kept")).cast("long").alias("n_removed"))


ORACLE = r"""
WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
w AS (SELECT doc_id, p, lines[p] || chr(10) || lines[p + 1] || chr(10) || lines[p + 2] AS w
      FROM (SELECT doc_id, lines, unnest(range(1, len(lines) - 1)) AS p FROM l WHERE doc_id IS NOT NULL)),
later AS (SELECT doc_id, p FROM (
            SELECT doc_id, p, row_number() OVER (PARTITION BY w ORDER BY doc_id, p) AS rn FROM w
            WHERE regexp_matches(w, '[^\s\p{Z}\p{Cc}\p{Cf}]')) WHERE rn > 1),
gone AS (SELECT doc_id, list(DISTINCT q) AS covered
         FROM (SELECT doc_id, unnest([p, p + 1, p + 2]) AS q FROM later) GROUP BY doc_id)
SELECT l.doc_id,
       coalesce(list_aggregate([l.lines[i] FOR i IN range(1, len(l.lines) + 1)
                                IF NOT list_contains(coalesce(gone.covered, []), i)], 'string_agg', chr(10)), '') AS text,
       CAST(len(l.lines) AS BIGINT) AS n_lines,
       CAST(coalesce(len(gone.covered), 0) AS BIGINT) AS n_removed
FROM l LEFT JOIN gone USING (doc_id)
"""
