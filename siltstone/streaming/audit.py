"""An audit log that each micro-batch enters once, however often it is replayed.

A batch is written to a folder of its own, rows of all levels in one job: a row per call, per seed, per failure, and a summary per batch. Then its name enters
a ledger, one small file that is put in place by a rename. A replayed batch that is in the ledger is not written again; one that failed before is
written over. Readers see what the ledger names, so what a failed task left is never read.

Cases: batches without rows enter the ledger only; calls and codes may be null; streams with different names share a log without meeting, and a
stream that begins anew under its old name is refused unless its batches continue where the log ends.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators.batches import batch_status

SEEDS = "call string, tenant string, ord long, status string, code string, bytes long"
LOG = "level string, stream string, batch long, call string, tenant string, ord long, outcome string, code string, n long, bytes long"


def levels(seeds: DataFrame) -> DataFrame:
    """Audit rows (level, call, tenant, ord, outcome, code, n, bytes) of seeds (call, tenant, ord, status, code, bytes)."""
    one = seeds.select("call", "tenant", "ord", F.col("status").alias("outcome"), "code", F.lit(1).cast("long").alias("n"), F.coalesce("bytes", F.lit(0)).cast("long").alias("bytes"))
    counts = [F.count_if(F.col("status") == s) for s in ("fail", "partial")]
    total = [F.count("*").alias("n"), F.coalesce(F.sum("bytes"), F.lit(0)).cast("long").alias("bytes")]
    calls = seeds.groupBy("call", "tenant").agg(batch_status(*counts, F.count("*")).alias("outcome"), *total)
    summary = seeds.groupBy("tenant").agg(batch_status(*counts, F.count("*")).alias("outcome"), *total)
    parts = {"seed": one, "failure": one.where("outcome = 'fail'"), "call": calls, "summary": summary}
    out = None
    for level, rows in parts.items():
        made = rows.withColumn("level", F.lit(level))
        out = made if out is None else out.unionByName(made, allowMissingColumns=True)
    return out


def _name(stream: str, batch: int) -> str:
    return f"{stream}-{batch:012d}"


class Ledger:
    """Names of the batches that a log holds: a folder of small files, each put in place by a rename."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.folder = self.jvm.org.apache.hadoop.fs.Path(f"{path}/_ledger")
        self.files = self.folder.getFileSystem(self.conf)

    def _at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(self.folder, name)

    def holds(self, stream: str, batch: int) -> bool:
        return self.files.exists(self._at(_name(stream, batch)))

    def enter(self, stream: str, batch: int, rows: int) -> None:
        """Name a batch; a ledger that names it already stays as it is."""
        new = self._at(f".{_name(stream, batch)}.new")
        out = self.files.create(new, True)
        out.write(bytearray(json.dumps({"stream": stream, "batch": batch, "rows": rows}).encode()))
        out.close()
        if not self.files.rename(new, self._at(_name(stream, batch))) and not self.holds(stream, batch):
            raise OSError(f"the ledger does not take {_name(stream, batch)}")

    def last(self, stream: str) -> int | None:
        """The last batch of a stream in the ledger."""
        if not self.files.exists(self.folder):
            return None
        named = [re.fullmatch(re.escape(stream) + r"-(\d{12,})", s.getPath().getName()) for s in self.files.listStatus(self.folder)]
        return max((int(m[1]) for m in named if m), default=None)


def write_batch(path: str, stream: str) -> Callable[[DataFrame, int], None]:
    """A function for ``foreachBatch``."""
    if not re.fullmatch(r"[A-Za-z0-9_.]+", stream):
        raise ValueError("a stream's name has letters, digits, dots and underscores")

    def write(seeds: DataFrame, batch: int) -> None:
        spark = seeds.sparkSession
        ledger = Ledger(spark, path)
        if ledger.holds(stream, batch):
            return
        last = ledger.last(stream)
        if last is not None and batch < last:
            raise ValueError(f"the log holds batch {last} of {stream}, so its batch {batch} is of another stream")
        rows = levels(seeds)
        folder = f"{path}/data/stream={stream}/batch={batch}"
        rows.write.mode("overwrite").partitionBy("level").parquet(folder)
        ledger.enter(stream, batch, 0)

    return write


def start(seeds: DataFrame, path: str, checkpoint: str, stream: str = "audit", **trigger):
    """Start a stream of seeds into the log at ``path``; ``trigger`` as Spark's, such as ``availableNow=True``."""
    writer = seeds.writeStream.foreachBatch(write_batch(path, stream)).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()


def read(spark: SparkSession, path: str) -> DataFrame:
    """The rows of all batches in the ledger."""
    ledger = Ledger(spark, path)
    empty = spark.createDataFrame([], LOG)
    if not ledger.files.exists(ledger.folder):
        return empty
    named = spark.read.schema("stream string, batch long, rows long").json(f"{path}/_ledger").select("stream", "batch").distinct()
    if not ledger.files.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/data")):
        return empty
    found = spark.read.schema(LOG).option("basePath", f"{path}/data").parquet(f"{path}/data")
    return found.join(named, ["stream", "batch"], "left_semi").select(*empty.columns)
