"""Queries of the ordered folds, each with a recursive SQL twin or a window."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators import folds

from .tables import table

QUOTA_LIMIT, QUOTA_WINDOW = 40, 6 * 3_600_000
MIB = folds.MIB


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "event_id", "user_id", "event_type", F.expr("timestampdiff(MILLISECOND, timestamp_ntz '1970-01-01 00:00:00', cast(ts as timestamp_ntz))").alias("at_ms"), (F.floor("value") % 20 + 1).cast("long").alias("seeds"),
        (F.floor(F.col("value") * 40_000)).cast("long").alias("bytes"), (F.floor(F.col("value")) / 8192).alias("cost"),
    )


def quota_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = folds.quota_admission(_events(spark, sf_dir), "user_id", "at_ms", "seeds", ["event_id"], QUOTA_LIMIT, QUOTA_WINDOW)
    return found.select("event_id", "ok", "used", F.coalesce("retry_after_ms", F.lit(-1)).cast("long").alias("retry_after_ms"))


def health_demotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcome = F.when(F.col("event_type").isin("error", "view"), "hard_fail").when(F.col("event_type") == "signup", "soft").otherwise("success")
    rows = _events(spark, sf_dir).select("event_id", "user_id", outcome.alias("outcome"))
    return folds.model_health(rows, "user_id", ["event_id"], "outcome").select("event_id", F.col("demotion").cast("long").alias("demotion"))


def budget_sequential(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = folds.sequential_budget(_events(spark, sf_dir), "user_id", ["event_id"], "bytes", "cost", 5 * MIB, 100 * MIB, 0.0625, 0.5)
    return found.select("event_id", "dispatch", "run_transform", "reason", "bytes_so_far", "cost_so_far")


def budget_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = folds.running_bytes(_events(spark, sf_dir), "user_id", "event_id", "bytes", 5 * MIB, 100 * MIB)
    return found.select("event_id", "bytes_before", "dispatch")


def token_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = folds.token_bucket(_events(spark, sf_dir), "user_id", "at_ms", ["event_id"], 2, 16_384_000)
    return found.select("event_id", "start_ms", "waited_ms")


def request_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = folds.request_starts(_events(spark, sf_dir), "user_id", "at_ms", ["event_id"], 3, 9_000_000, 40)
    return found.select("event_id", "start_ms", "waited_ms")


def batch_runner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events as a batch's seeds over few hosts. Its rules feed back into each other, so its twin is a test."""
    name = lambda c: F.concat(F.lit("h"), c.cast("string"))
    rows = _events(spark, sf_dir).select(
        "event_id", "user_id", name(F.pmod("event_id", F.lit(5))).alias("host"),
        F.array(name(F.pmod("event_id", F.lit(5))), name(F.pmod(F.col("event_id") * 7, F.lit(9)))).alias("hosts"), "bytes", F.lit(900).alias("duration_ms"),
        F.when(F.pmod("event_id", F.lit(3)) == 0, F.col("cost")).alias("cost"), (F.pmod("event_id", F.lit(4)) == 0).alias("renders"),
    )
    found = folds.run_batch(rows, "user_id", ["event_id"], cost_per_seed=0.0625)
    return found.select("event_id", "outcome", "reason", "started_ms", "bytes_so_far", "cost_so_far", "transformed", "rendered", F.array_join("quarantined", ",").alias("quarantined"))


QUERIES = {
    "quota_admission": quota_admission, "health_demotion": health_demotion, "budget_sequential": budget_sequential, "budget_running": budget_running,
    "token_bucket": token_bucket, "request_starts": request_starts, "batch_runner": batch_runner,
}

_E = """e AS (SELECT event_id, user_id, event_type, epoch_us(ts) // 1000 AS ms, CAST(floor(value) AS BIGINT) % 20 + 1 AS n, CAST(floor(value * 40000) AS BIGINT) AS bytes,
    floor(value) / 8192 AS cost, row_number() OVER (PARTITION BY user_id ORDER BY {order}) AS k FROM events)"""

SQL = {
    "quota_admission": f"""WITH RECURSIVE {_E.format(order='ts, event_id')},
        open_(user_id, k, lst, event_id, ok, used, wait) AS (
            SELECT user_id, CAST(0 AS BIGINT), CAST([] AS STRUCT(a BIGINT, n BIGINT)[]), CAST(NULL AS BIGINT), CAST(NULL AS BOOLEAN), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT) FROM (SELECT DISTINCT user_id FROM events)
            UNION ALL
            SELECT user_id, k, CASE WHEN used + n <= {QUOTA_LIMIT} THEN list_append(act, {{'a': ms, 'n': n}}) ELSE act END, event_id, used + n <= {QUOTA_LIMIT},
                CASE WHEN used + n <= {QUOTA_LIMIT} THEN used + n ELSE used END,
                CASE WHEN used + n > {QUOTA_LIMIT} AND len(act) > 0 THEN greatest(0, act[1].a + {QUOTA_WINDOW} - ms) END
            FROM (SELECT e.user_id, e.k, e.event_id, e.ms, e.n, list_filter(o.lst, lambda x: x.a > e.ms - {QUOTA_WINDOW}) AS act,
                    CAST(coalesce(list_sum(list_transform(list_filter(o.lst, lambda x: x.a > e.ms - {QUOTA_WINDOW}), lambda x: x.n)), 0) AS BIGINT) AS used
                  FROM open_ o JOIN e ON e.user_id = o.user_id AND e.k = o.k + 1))
        SELECT event_id, ok, used, CAST(coalesce(wait, -1) AS BIGINT) AS retry_after_ms FROM open_ WHERE k > 0""",
    "health_demotion": f"""WITH RECURSIVE {_E.format(order='event_id')},
        h(user_id, k, recent, streak, dem, event_id) AS (
            SELECT user_id, CAST(0 AS BIGINT), CAST([] AS BOOLEAN[]), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(NULL AS BIGINT) FROM (SELECT DISTINCT user_id FROM events)
            UNION ALL
            SELECT user_id, k, CASE WHEN recovered THEN [] ELSE win END, CASE WHEN recovered THEN 0 ELSE stk END, CASE WHEN recovered THEN 0 WHEN failed AND len(list_filter(win, lambda x: x)) >= 3 THEN 1 ELSE dem END, event_id
            FROM (SELECT *, NOT failed AND NOT soft AND dem > 0 AND stk >= 2 AS recovered FROM (
                SELECT e.user_id, e.k, e.event_id, h.dem, e.event_type IN ('error', 'view') AS failed, e.event_type = 'signup' AS soft,
                    CASE WHEN e.event_type = 'signup' THEN h.recent ELSE list_append(h.recent, e.event_type IN ('error', 'view'))[-5:] END AS win,
                    CASE WHEN e.event_type = 'signup' THEN h.streak WHEN e.event_type IN ('error', 'view') THEN 0 ELSE h.streak + 1 END AS stk
                FROM h JOIN e ON e.user_id = h.user_id AND e.k = h.k + 1)))
        SELECT event_id, dem AS demotion FROM h WHERE k > 0""",
    "budget_sequential": f"""WITH RECURSIVE {_E.format(order='event_id')},
        b(user_id, k, bytes, cost, stopped, raw, event_id, dispatch, tr, reason) AS (
            SELECT user_id, CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS DOUBLE), false, false, CAST(NULL AS BIGINT), CAST(NULL AS BOOLEAN), CAST(NULL AS BOOLEAN), CAST(NULL AS VARCHAR) FROM (SELECT DISTINCT user_id FROM events)
            UNION ALL
            SELECT user_id, k, nb, nc, stopped OR nb > {100 * MIB}, raw OR (tr AND nc > 0.5), event_id, dispatch, tr,
                CASE WHEN NOT dispatch THEN 'egress_bytes' WHEN tr AND nc > 0.5 THEN 'transform_cost' WHEN nb > {100 * MIB} THEN 'egress_bytes' END
            FROM (SELECT *, CASE WHEN dispatch THEN pb + eb ELSE pb END AS nb, CASE WHEN tr THEN pc + ec ELSE pc END AS nc FROM (
                SELECT e.user_id, e.k, e.event_id, b.stopped, b.raw, b.bytes AS pb, b.cost AS pc, e.bytes AS eb, e.cost AS ec, NOT b.stopped AND b.bytes + {5 * MIB} <= {100 * MIB} AS dispatch,
                    NOT b.stopped AND b.bytes + {5 * MIB} <= {100 * MIB} AND NOT b.raw AND b.cost + 0.0625 <= 0.5 AS tr
                FROM b JOIN e ON e.user_id = b.user_id AND e.k = b.k + 1)))
        SELECT event_id, dispatch, tr AS run_transform, reason, bytes AS bytes_so_far, cost AS cost_so_far FROM b WHERE k > 0""",
    "budget_running": f"""WITH {_E.format(order='event_id')} SELECT event_id, b AS bytes_before, b + {5 * MIB} <= {100 * MIB} AS dispatch FROM (SELECT event_id,
        CAST(coalesce(sum(bytes) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS b FROM e)""",
    "token_bucket": f"""WITH RECURSIVE {_E.format(order='ts, event_id')},
        t(user_id, k, tok, last, event_id, start_ms, waited) AS (
            SELECT user_id, k, CAST(1 AS DOUBLE), CAST(ms AS DOUBLE), event_id, ms, CAST(0 AS BIGINT) FROM e WHERE k = 1
            UNION ALL
            SELECT user_id, k, least(2.0, tok + (st - last) / 16384000.0) - 1, st, event_id, CAST(st AS BIGINT), CAST(st - ms AS BIGINT)
            FROM (SELECT *, CASE WHEN have < 1 THEN now_ + ceil((1 - have) * 16384000.0) ELSE now_ END AS st FROM (
                SELECT *, least(2.0, tok + (now_ - last) / 16384000.0) AS have FROM (
                    SELECT e.user_id, e.k, e.event_id, e.ms, t.tok, t.last, greatest(CAST(e.ms AS DOUBLE), t.last) AS now_ FROM t JOIN e ON e.user_id = t.user_id AND e.k = t.k + 1))))
        SELECT event_id, start_ms, waited AS waited_ms FROM t""",
    # tokens in milliseconds of refill
    "request_starts": f"""WITH RECURSIVE {_E.format(order='ts, event_id')},
        t(user_id, k, tok, last, event_id, start_ms, waited) AS (
            SELECT user_id, k, 18000000, ms, event_id, ms, CAST(0 AS BIGINT) FROM e WHERE k = 1
            UNION ALL
            SELECT user_id, k, least(27000000, tok + st - last) - 9000000, st, event_id, st, st - ms
            FROM (SELECT *, now_ + greatest(0, 9000000 - have) AS st FROM (SELECT *, least(27000000, tok + now_ - last) AS have FROM (
                    SELECT e.user_id, e.k, e.event_id, e.ms, t.tok, t.last, greatest(e.ms, t.last) AS now_ FROM t JOIN e ON e.user_id = t.user_id AND e.k = t.k + 1))))
        SELECT event_id, start_ms, waited AS waited_ms FROM t""",
}
