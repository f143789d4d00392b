"""Responses from files of seeds: partitions by platform, row groups, streams that resume, rosters that do not count."""

import pytest
from pyspark.sql import functions as F

from siltstone.operators import boards
from siltstone.sources import fetches

CLIENT = """
from siltstone.sources.fetches import Recorded
class Echo(Recorded):
    def get(self, url):
        return 200, {"Content-Type": ["application/json"]}, b'["' + url.encode() + b'"]'
def factory():
    return Echo({})
"""


@pytest.fixture(scope="module")
def client(spark, tmp_path_factory):
    name = "recorded_echo_client"
    path = tmp_path_factory.mktemp("client") / f"{name}.py"
    path.write_text(CLIENT)
    spark.sparkContext.addPyFile(str(path))
    fetches.register(spark)
    return f"{name}:factory"


def test_seeds_by_platform(spark, tmp_path, client):
    path = str(tmp_path / "seeds")
    rows = [(k, f"https://{p}.example/{k}", p) for k, p in enumerate(["lever", "ashby", "a b/c", None] * 25)]
    spark.createDataFrame(rows, "seed_id long, url string, platform string").repartition(2).write.partitionBy("platform").parquet(path)
    df = spark.read.format("responses").option("client", client).load(path)
    got = df.select("seed_id", "platform", F.col("body").cast("string").alias("b"), "status").collect()
    assert sorted((r.seed_id, r.platform) for r in got) == [(k, p) for k, _, p in rows] and all(r.b == f'["{u}"]' for r in got for k, u, _ in rows if k == r.seed_id)
    parts = lambda d: d.select(F.spark_partition_id().alias("p"), "seed_id").groupBy("p").count().count()
    only = df.where("platform = 'lever' and seed_id < 40")
    assert {r.seed_id for r in only.collect()} == set(range(0, 40, 4)) and df.count() == 100 and parts(df) == 8
    some = spark.read.format("responses").option("client", client).option("platforms", '["lever", null]').load(path)
    assert some.where("seed_id < 40").count() == 20 and some.count() == 50 and parts(some) == 4
    fresh = lambda: spark.read.format("responses").option("client", client).option("pushdown", "true").load(path)
    assert parts(fresh().where("platform = 'lever'")) == 2 and {r.seed_id for r in fresh().where("platform = 'lever' and seed_id < 40").collect()} == set(range(0, 40, 4))
    assert fresh().where("platform in ('ashby', 'a b/c')").count() == 50 and fresh().where("platform = 'none'").count() == 0 and fresh().where("platform is null").count() == 25
    assert fresh().where("platform = 'lever' and platform = 'ashby'").count() == 0


def test_row_groups_are_partitions(spark, tmp_path):
    path = str(tmp_path / "big")
    spark.range(5000).select(F.col("id").alias("seed_id"), F.lit("https://a.example/").alias("url")).coalesce(1).write.option("parquet.block.row.count.limit", 1000).parquet(path)
    names = fetches.Seeds(path).files()
    assert len(names) == 1 and len(fetches.planned(path, names)) == 5 and len(fetches.planned(path, names, groups=3)) == 2
    assert fetches.Seeds(str(tmp_path / "none")).files() == [] and len(fetches.planned(path, [])) == 1


def test_stream_goes_on_from_its_offset(spark, tmp_path, client):
    seeds, out, state = tmp_path / "seeds", str(tmp_path / "out"), str(tmp_path / "state")
    seeds.mkdir()

    def arrive(name, ids):
        folder = tmp_path / f"made-{name}"
        spark.createDataFrame([(k, f"https://a.example/{k}") for k in ids], "seed_id long, url string").coalesce(1).write.parquet(str(folder))
        next(folder.glob("*.parquet")).rename(seeds / f"{name}.parquet")

    def read():
        stream = spark.readStream.format("responses").option("client", client).option("maxFilesPerTrigger", 1).load(str(seeds))
        query = stream.select("seed_id", "status").writeStream.format("parquet").option("path", out).option("checkpointLocation", state).start()
        query.processAllAvailable()
        query.stop()
        return sorted(r.seed_id for r in spark.read.parquet(out).collect())

    arrive("0001", range(3))
    arrive("0002", range(3, 5))
    assert read() == list(range(5))
    arrive("0003", range(5, 9))
    assert read() == list(range(9)) and read() == list(range(9))


def test_rosters_count_only_whole(spark):
    rows = [
        ("ok", 200, b'[{"id":"1"}]', False, False), ("moved", 301, b"[]", False, False), ("cut", 200, b"[]", True, False), ("long", 204, b"[" + b" " * 99 + b"]", False, False),
        ("bad", 200, b"[", False, False), ("refused", 200, b"[]", False, True), ("nulls", None, None, None, None), ("bom", 200, b"\xef\xbb\xbf[]", False, False), ("bytes", 200, b'["\xff"]', None, None),
    ]
    df = spark.createDataFrame([("lever", *r) for r in rows], "platform string, board string, status int, body binary, truncated boolean, rejected boolean").withColumn("own", F.lit(1))
    got = {r.board: (r.dropped, r.body, r.digest is not None) for r in boards.board_bodies(df, max_bytes=50).collect()}
    assert {b: d for b, (d, _, _) in got.items()} == {"ok": None, "moved": "status", "cut": "truncated", "long": "truncated", "bad": "not_json", "refused": "rejected", "nulls": "status", "bom": None, "bytes": None}
    assert got["ok"][1:] == ('[{"id":"1"}]', True) and got["bom"][1] == "[]" and got["bad"][1:] == (None, False) and got["bytes"][1] == '["�"]'
