"""Shared working storage: written tables that cut lineage and outlive executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in ``spark.checkpoint.dir``, or the context's checkpoint folder.

    Where neither is set, a local session makes its own; on a cluster that is an error, since executors do not see
    a folder of the driver's machine.
    """
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="siltstone-"))
        found = context.getCheckpointDir()
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


class Scratch:
    """Tables written to the shared folder; ``drop`` removes those no longer needed.

    While a table is written, Arrow batches have at most ``batch_rows`` rows, so that rows of long texts or
    large sets need little memory at a time.
    """

    def __init__(self, spark: SparkSession, name: str, batch_rows: int = 10_000) -> None:
        self.spark, self.name, self.batch_rows, self.paths = spark, name, batch_rows, {}

    def save(self, df: DataFrame, step: str, compression: str = "zstd") -> DataFrame:
        """Write ``df`` once and return the DataFrame that reads it back."""
        path = new_path(self.spark, f"{self.name}-{step}")
        schema = df.schema
        before = self.spark.conf.get(BATCH_ROWS)
        self.spark.conf.set(BATCH_ROWS, str(min(int(before), self.batch_rows)))
        try:
            df.write.option("compression", compression).parquet(path)
        finally:
            self.spark.conf.set(BATCH_ROWS, before)
        self.paths[step] = path
        return self.spark.read.schema(schema).parquet(path)

    def drop(self, *steps: str) -> None:
        for step in steps or list(self.paths):
            if path := self.paths.pop(step, None):
                remove(self.spark, path)


def remove(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
