"""Shaping of batches of addresses: first occurrence, per-host limit, global limit, and what was cut.

All of these work on narrow rows (order, address, key) before any page is attached. A host that holds a
third of all rows is no problem: first occurrences are a combined minimum, per-host limits are pushed
before the shuffle, counts are combined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PER_HOST, RAW_URLS, SUMMARY_URLS, MAX_ENTRIES = 10, 50, 10, 200


def first_occurrences(df: DataFrame, key: str | list[str], order: str = "ord") -> DataFrame:
    """The first row of every key in the given order; ties keep the row that is least as a struct."""
    keys = [key] if isinstance(key, str) else key
    rest = [c for c in df.columns if c not in keys and c != order]
    first = df.groupBy(*keys).agg(F.min(F.struct(order, *rest)).alias("__r"))
    return first.select(*[F.col(c) if c in keys else F.col(f"__r.{c}").alias(c) for c in df.columns])


def top_per_key(df: DataFrame, key: str, n: int = PER_HOST, order: str = "ord") -> DataFrame:
    """At most n rows per key in the given order (the limit is applied before the shuffle as well)."""
    ranked = df.withColumn("__rn", F.row_number().over(Window.partitionBy(key).orderBy(order)))
    return ranked.where(F.col("__rn") <= n).drop("__rn")


def cut_per_key(df: DataFrame, key: str, n: int = PER_HOST) -> DataFrame:
    """(key, kept, dropped) of the keys with more than n rows."""
    counts = df.groupBy(key).agg(F.count("*").alias("__c")).where(F.col("__c") > n)
    return counts.select(key, F.lit(n).cast("long").alias("kept"), (F.col("__c") - n).alias("dropped"))


def first_n(df: DataFrame, n: int, order: str = "ord") -> DataFrame:
    return df.orderBy(order).limit(n)


def shape(df: DataFrame, url_col: str, key_col: str, n_host: int = PER_HOST, n_total: int = RAW_URLS, order: str = "ord") -> DataFrame:
    """First occurrences, then the per-host limit, then the global limit."""
    return first_n(top_per_key(first_occurrences(df, url_col, order), key_col, n_host, order), n_total, order)


def disclosure(df: DataFrame, url_col: str, key_col: str, n_host: int = PER_HOST, n_total: int = RAW_URLS) -> DataFrame:
    """One row: how many entries each step of ``shape`` left."""
    distinct = df.groupBy(url_col).agg(F.count("*").alias("__c"), F.min(key_col).alias(key_col))
    per_host = distinct.groupBy(key_col).agg(F.sum("__c").alias("__rows"), F.count("*").alias("__urls"))
    after_host = F.sum(F.least(F.col("__urls"), F.lit(n_host)))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return per_host.agg(
        zero(F.sum("__rows")).alias("input_urls"), zero(F.sum("__urls")).alias("after_dedupe"), zero(after_host).alias("after_host_limit"),
        F.least(zero(after_host), F.lit(n_total).cast("long")).alias("processed"),
        F.count_if(F.col("__urls") > n_host).alias("hosts_cut"),
    )


def entry_class(url_error: Column, is_board: Column, is_embed: Column) -> Column:
    """Disjoint classes of batch entries: invalid, board, embed or seed."""
    return F.when(url_error.isNotNull(), "invalid").when(is_board, "board").when(is_embed, "embed").otherwise("seed")


def realign(results: DataFrame, seeds: DataFrame, order: str = "ord") -> DataFrame:
    """Results put back to their seeds; ``order`` is the input order. Seeds without a result keep nulls."""
    extra = [c for c in results.columns if c == order or c not in seeds.columns]
    return seeds.join(results.select(*extra), order, "left")
