"""Input tables of the queries."""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame, SparkSession

from siltstone.shipping import ship

#: Rows of a task where each row costs much: few are not worth one of their own, more than the second go to another.
LEAST_ROWS, MOST_ROWS = 1_000, 50_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table whose rows are dealt to all cores, for work that is heavy by row.

    A table of narrow rows is a small file, of which Spark makes one task or a few, whatever is done with its rows. Their number (from the file's footers) sets that of the tasks, so that
    more rows are more tasks rather than longer ones.
    """
    rows = table(spark, sf_dir, name)
    n = rows.count()
    return rows.repartition(max(1, min(ceil(n / LEAST_ROWS), 2 * spark.sparkContext.defaultParallelism), ceil(n / MOST_ROWS)))
