"""Roll-ups of batches: totals, status, failures, egress, retries, audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def batch_status(failed: Column, partial: Column, total: Column) -> Column:
    """fail if nothing or everything failed, pass if all passed, else partial."""
    return F.when((total == 0) | (failed == total), "fail").when((failed == 0) & (partial == 0), "pass").otherwise("partial")


def totals(rows: DataFrame, by: str | None = None) -> DataFrame:
    """Sums, counts and status per batch of rows (status, bytes, egress_bytes, in_tokens, out_tokens, cost_usd)."""
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    failed, partial, total = F.count_if(F.col("status") == "fail"), F.count_if(F.col("status") == "partial"), F.count("*")
    grouped = rows.groupBy(by) if by else rows.groupBy()
    return grouped.agg(
        total.alias("n"), (total - failed).alias("passed"), failed.alias("failed"), batch_status(failed, partial, total).alias("batch_status"),
        zero("bytes").alias("bytes"), zero("egress_bytes").alias("egress_bytes"), zero("in_tokens").alias("in_tokens"),
        zero("out_tokens").alias("out_tokens"), F.round(F.coalesce(F.sum("cost_usd"), F.lit(0.0)), 6).alias("cost_usd"),
    )


def egress_union(seed_key: Column, hop_keys: Column, final_key: Column, rendered: Column | None = None) -> Column:
    """Distinct hosts that one fetch touched: the seed's, every hop's, the last one's and those of a render."""
    parts = [F.array(seed_key), F.coalesce(hop_keys, F.array().cast("array<string>")), F.array(final_key)]
    if rendered is not None:
        parts.append(F.coalesce(rendered, F.array().cast("array<string>")))
    return F.array_distinct(F.array_compact(F.concat(*parts)))


def host_touches(rows: DataFrame, hosts_col: str) -> DataFrame:
    """(host, touches): by how many rows each host was touched."""
    return rows.select(F.explode(F.array_distinct(hosts_col)).alias("host")).groupBy("host").agg(F.count("*").alias("touches"))


def distinct_in_order(rows: DataFrame, value: str, order: str = "ord", by: str | None = None) -> DataFrame:
    """First occurrences of a value in order, as an array per batch."""
    keys = [by] if by else []
    first = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.min(order).alias("__o"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("__o", value))), lambda s: s[value])
    return first.groupBy(*keys).agg(listed.alias("values"))


def failures(*parts: DataFrame, columns: tuple[str, ...] = ("ord", "url", "code", "message")) -> DataFrame:
    """Rejects and failed rows; ``class``, then ``ord`` is their order."""
    out = None
    for rank, part in enumerate(parts):
        ranked = part.select(F.lit(rank).alias("class"), *columns)
        out = ranked if out is None else out.unionByName(ranked)
    return out


def merge_attempts(attempts: DataFrame) -> DataFrame:
    """One row per ord of attempts (ord, attempt, status, bytes, redirects, final_url): bytes add up, redirects are
    put one after the other, the rest is that of the last attempt."""
    in_order = F.array_sort(F.collect_list(F.struct("attempt", "redirects")))
    return attempts.groupBy("ord").agg(
        F.sum("bytes").alias("bytes"), F.flatten(F.transform(in_order, lambda a: a["redirects"])).alias("redirects"),
        F.max_by("status", "attempt").alias("status"), F.max_by("final_url", "attempt").alias("final_url"), F.count("*").alias("attempts"),
    )


def wants_retry(status: Column, retry_after_ms: Column, challenged: Column) -> Column:
    """Whether a response may be asked for once more: 429 or 503 with a wait of at most 30 s, not a bot wall."""
    return status.isin(429, 503) & retry_after_ms.isNotNull() & (retry_after_ms <= 30_000) & ~challenged


def audit_rollup(events: DataFrame, batch: str, outcome: str, value: str) -> DataFrame:
    """Counts and sums per batch and outcome, per batch, and over all (null marks a total; ``level`` says which)."""
    return events.rollup(batch, outcome).agg(
        F.grouping_id().cast("long").alias("level"), F.count("*").alias("n"), F.round(F.sum(value), 4).alias("total")
    )


def first_and_last(values: Column, n: int = 50) -> Column:
    """An array of more than n entries as its first n - 1, a note and its last one."""
    omitted = (F.size(values) - n).cast("string")
    note = F.concat(F.lit("… "), omitted, F.lit(" more …"))
    return F.when(F.size(values) <= n, values).otherwise(F.concat(F.slice(values, 1, n - 1), F.array(note), F.array(F.element_at(values, -1))))


def shown_hosts(hosts: Column, n: int = 8) -> Column:
    """Distinct hosts for display: address literals hidden, at most n entries, the last a count of the others."""
    plain = F.array_distinct(F.transform(hosts, lambda h: F.when(h.rlike(r"^[0-9.]+$|:"), "[ip-literal]").otherwise(h)))
    more = F.concat(F.lit("(+"), (F.size(plain) - (n - 1)).cast("string"), F.lit(" more)"))
    return F.when(F.size(plain) <= n, plain).otherwise(F.concat(F.slice(plain, 1, n - 1), F.array(more)))


def action_count(actions: Column, *kinds: str) -> Column:
    return F.size(F.filter(actions, lambda a: a["type"].isin(*kinds))).cast("long")


def longest_of(rows: DataFrame, by: str, value: str, order: str) -> DataFrame:
    """(by, value): the longest text of each group; of equals the first in order."""
    size = F.struct(F.length(value).alias("n"), (-F.col(order)).alias("o"))
    return rows.where(F.col(value).isNotNull()).groupBy(by).agg(F.max_by(value, size).alias(value))


def longest_few(rows: DataFrame, by: str, value: str, order: str, k: int = 3) -> DataFrame:
    """The ``k`` longest texts of each group, with their rank; of equals the first in order. The limit is applied before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.length(value).desc(), order))
    return rows.where(F.col(value).isNotNull()).withColumn("rank", rank).where(F.col("rank") <= k)


def compared_sets(left: DataFrame, right: DataFrame, value: str) -> DataFrame:
    """(left_only, right_only, common): how many distinct values are in one set or in both."""
    marked = left.select(value, F.lit(1).alias("side")).unionByName(right.select(value, F.lit(2).alias("side")))
    sides = marked.where(F.col(value).isNotNull()).groupBy(value).agg(F.bit_or("side").alias("side"))
    count = lambda n: F.coalesce(F.count_if(F.col("side") == n), F.lit(0))
    return sides.agg(count(1).alias("left_only"), count(2).alias("right_only"), count(3).alias("common"))


def audit_rows(rows: DataFrame, batch: str) -> DataFrame:
    """What an audit log keeps of batches of rows (ord, status, code, bytes): a row per seed, one per failure, and a summary per batch.

    Columns: kind, the batch, ord (null for a summary), outcome, code, n and bytes. Append it to the log's table.
    """
    seeds = rows.select(F.lit("seed").alias("kind"), batch, "ord", F.col("status").alias("outcome"), "code", F.lit(1).cast("long").alias("n"), F.col("bytes").cast("long").alias("bytes"))
    failed = seeds.where("outcome = 'fail'").withColumn("kind", F.lit("failure"))
    counts = [F.count_if(F.col("status") == s) for s in ("fail", "partial")]
    summary = rows.groupBy(batch).agg(batch_status(*counts, F.count("*")).alias("outcome"), F.count("*").alias("n"), F.coalesce(F.sum("bytes"), F.lit(0)).cast("long").alias("bytes"))
    summary = summary.select(F.lit("summary").alias("kind"), batch, F.lit(None).cast(rows.schema["ord"].dataType).alias("ord"), "outcome", F.lit(None).cast("string").alias("code"), "n", "bytes")
    return seeds.unionByName(failed).unionByName(summary)
