"""Streams with state and the audit log: many rows of one key, idle keys, replays and failures."""

import random

import pytest
from pyspark.sql import functions as F

from siltstone.operators import folds
from siltstone.streaming import audit, keyed, streams


def run(stream, name):
    query = stream.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    return stream.sparkSession.table(name)


def test_one_key_with_many_rows_in_a_trigger(spark, tmp_path):
    rng = random.Random(3)
    rows = [("hot" if k % 5 else "cold", rng.randrange(3_000_000), rng.randrange(1, 60), k) for k in range(60_000)]
    df = spark.createDataFrame(rows, "tenant string, at_ms long, seeds long, request_id long")
    df.repartition(6).write.parquet(str(tmp_path / "in"))
    got = {r.request_id: (r.ok, r.used) for r in run(streams.quota_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))), "hot_quota").collect()}
    want = {r.request_id: (r.ok, r.used) for r in folds.quota_admission(df, "tenant", "at_ms", "seeds", ["request_id"]).collect()}
    assert got == want and len({ok for ok, _ in got.values()}) == 2


def test_state_of_idle_keys_goes(spark, tmp_path):
    schema = "tenant string, at_ms long, seeds long, request_id long"
    for k, rows in enumerate([[("a", 1000, 300, 1)], [("b", 3_600_000, 1, 2)], [("b", 7_200_000, 1, 3)], [("a", 7_200_001, 300, 4)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    checkpoint = str(tmp_path / "state")
    query = streams.quota_stream(source).writeStream.format("memory").queryName("idle").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    assert {r.request_id: r.ok for r in spark.table("idle").collect()} == {1: True, 2: True, 3: True, 4: True}
    kept = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "fold").load()
    assert {r.key.tenant for r in kept.select("key").collect()} == {"a", "b"}
    first = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "fold").option("batchId", 2).load()
    assert {r.key.tenant for r in first.select("key").collect()} == {"b"}  # the watermark had passed a's window


def test_models_are_forgotten(spark, tmp_path):
    schema = "model string, seq long, outcome string, at_ms long"
    batches = [[("m", k, "hard_fail", k + 1000) for k in range(3)], [("n", 3, "success", 10_000_000)], [("n", 4, "success", 20_000_000)], [("m", 5, "hard_fail", 20_000_001)]]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    got = {(r.model, r.seq): r.demotion for r in run(streams.health_stream(source, forget_ms=1_000_000), "forgotten").collect()}
    assert got == {("m", 0): 0, ("m", 1): 0, ("m", 2): 1, ("n", 3): 0, ("n", 4): 0, ("m", 5): 0}


def test_ranges_in_order():
    fold = keyed.QuotaFold(10, 100)
    held = {}
    fold.waiting = type("M", (), {"updateValue": lambda s, k, v: held.__setitem__(k, v), "getValue": lambda s, k: held[k], "removeKey": lambda s, k: held.pop(k)})()
    pd = keyed.pd
    frames = [pd.DataFrame({"request_id": [k, k + 1], "at_ms": [500 - k, k], "seeds": [1, 1]}) for k in range(0, 200, 2)]
    out = pd.concat(list(fold._ordered(iter(frames))))
    assert list(out["at_ms"]) == sorted(out["at_ms"]) and len(out) == 200 and not held


SEEDS = [("c1", "t", 0, "pass", None, 10), ("c1", "t", 1, "fail", "timeout", None), ("c2", None, 0, "partial", None, 5), (None, "t", 0, "fail", None, 1)]


def test_replayed_batches_add_nothing(spark, tmp_path):
    seeds, path = spark.createDataFrame(SEEDS, audit.SEEDS), str(tmp_path / "log")
    assert audit.read(spark, path).count() == 0
    write = audit.write_batch(path, "s1")
    for batch in (0, 0, 1, 1):
        write(seeds, batch)
    audit.write_batch(path, "s2")(seeds.limit(0), 0)
    rows = audit.read(spark, path).collect()
    assert {(r.stream, r.batch) for r in rows} == {("s1", 0), ("s1", 1)} and len(rows) == 2 * (4 + 2 + 3 + 2)
    own = sorted(((r.level, r.call, r.tenant, r.outcome, r.n, r.bytes) for r in rows if r.batch == 0 and r.level in ("call", "summary")), key=repr)
    assert own == sorted([("call", "c1", "t", "partial", 2, 10), ("call", "c2", None, "partial", 1, 5), ("call", None, "t", "fail", 1, 1), ("summary", None, "t", "partial", 3, 11), ("summary", None, None, "partial", 1, 5)], key=repr)
    with pytest.raises(ValueError, match="another stream"):
        write(seeds, -1)
    with pytest.raises(ValueError, match="letters"):
        audit.write_batch(path, "a/b")


def test_failed_batches_leave_nothing_that_is_read(spark, tmp_path):
    seeds, path = spark.createDataFrame(SEEDS, audit.SEEDS), str(tmp_path / "log")
    write = audit.write_batch(path, "s")
    write(seeds, 0)
    broken = seeds.withColumn("bytes", F.when(F.col("call") == "c2", F.raise_error(F.lit("lost"))).otherwise(F.col("bytes")).cast("long"))
    with pytest.raises(Exception, match="lost"):
        write(broken, 1)
    audit.levels(seeds).write.partitionBy("level").parquet(f"{path}/data/stream=s/batch=2")  # written, but lost before the ledger
    assert {r.batch for r in audit.read(spark, path).select("batch").distinct().collect()} == {0}
    write(seeds.limit(1), 1)
    write(seeds, 2)
    counts = {r.batch: r["count"] for r in audit.read(spark, path).where("level = 'seed'").groupBy("batch").count().collect()}
    assert counts == {0: 4, 1: 1, 2: 4}


def test_audit_stream_restarts(spark, tmp_path):
    path, checkpoint, schema = str(tmp_path / "log"), str(tmp_path / "state"), spark.createDataFrame(SEEDS, audit.SEEDS).schema
    for k in range(3):
        spark.createDataFrame(SEEDS, schema).coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))
        source = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        query = audit.start(source, path, checkpoint, "calls", availableNow=True)
        assert query.awaitTermination(120)
    rows = audit.read(spark, path)
    assert rows.where("level = 'seed'").count() == 12 and {r.batch for r in rows.select("batch").distinct().collect()} == {0, 1, 2}
