"""Queries over batches: totals, statuses, egress, failures, retries, roll-ups, delivery, models.

Batches are synthesised from the event table: a user is a batch or tenant, an event a seed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import classify
from siltstone.operators import batches, delivery, models, shaping
from siltstone.streaming import streams

from .tables import table

STATUS_SQL = "CASE event_type WHEN 'error' THEN 'fail' WHEN 'view' THEN 'partial' ELSE 'pass' END"


def seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("event_type") == "error", "fail").when(F.col("event_type") == "view", "partial").otherwise("pass")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("ord"), F.col("user_id").alias("batch"), status.alias("status"), "event_type", "ts", "value",
        F.floor(F.col("value") * 100).cast("long").alias("bytes"), F.floor(F.col("value") * 300).cast("long").alias("egress_bytes"),
        F.floor("value").cast("long").alias("in_tokens"), F.lit(7).cast("long").alias("out_tokens"),
        F.when(F.col("event_type") == "purchase", F.floor(F.col("value") * 100) / 1e6).otherwise(0.0).alias("cost_usd"),
    )


def batch_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batches.totals(seeds(spark, sf_dir), "batch")


def all_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batches.totals(seeds(spark, sf_dir))


def egress_host_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts touched per event: the seed's, two hops' and the last one's, made from ids."""
    name = lambda c: F.concat(F.lit("h"), c.cast("string"))
    rows = table(spark, sf_dir, "events").select(
        batches.egress_union(
            name(F.pmod("user_id", F.lit(20))), F.array(name(F.pmod("event_id", F.lit(7))), name(F.pmod("event_id", F.lit(3)))), name(F.pmod(F.col("event_id") * 3, F.lit(11)))
        ).alias("hosts")
    )
    return batches.host_touches(rows, "hosts")


def cap_breaches(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = batches.distinct_in_order(seeds(spark, sf_dir), "event_type", "ord", "batch")
    return listed.select("batch", F.array_join("values", ",").alias("kinds"))


def failure_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = seeds(spark, sf_dir)
    shaped = rows.select(
        "ord", F.concat(F.lit("https://h/"), F.col("ord").cast("string")).alias("url"),
        F.when(F.pmod("ord", F.lit(9)) == 0, "invalid").when(F.pmod("ord", F.lit(10)) == 0, "board").otherwise("seed").alias("cls"), "status", "event_type",
    )
    none = F.array().cast("array<struct<code: string, message: string>>")
    code = classify.failure_code(F.lit("http"), F.lit(""), F.when(F.pmod("ord", F.lit(4)) == 0, "error").otherwise("1"), F.lit(503), none)
    part = lambda cls, c: shaped.where(F.col("cls") == cls).select("ord", "url", c.alias("code"), F.col("event_type").alias("message"))
    failed = shaped.where((F.col("cls") == "seed") & (F.col("status") == "fail")).select("ord", "url", code.alias("code"), F.col("event_type").alias("message"))
    return batches.failures(part("invalid", F.lit("invalid_url")), part("board", F.lit("tier2_board_not_supported_in_bulk")), failed).withColumn("class", F.col("class").cast("long"))


def retry_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two attempts for events that may be asked for again, merged."""
    rows = seeds(spark, sf_dir).select("ord", F.lit(1).alias("attempt"), F.when(F.col("status") == "fail", 503).otherwise(200).alias("code"), "bytes")
    again = batches.wants_retry(F.col("code"), F.pmod("ord", F.lit(50)) * 1000, F.pmod("ord", F.lit(13)) == 0)
    second = rows.where(again).select("ord", F.lit(2).alias("attempt"), F.lit(200).alias("code"), (F.col("bytes") * 2).alias("bytes"))
    both = rows.unionByName(second).select(
        "ord", "attempt", F.col("code").alias("status"), "bytes", F.array(F.concat(F.lit("r"), F.col("attempt").cast("string"))).alias("redirects"),
        F.concat(F.lit("f"), F.col("attempt").cast("string")).alias("final_url"),
    )
    return batches.merge_attempts(both).select("ord", "bytes", F.array_join("redirects", ",").alias("redirects"), F.col("status").cast("long").alias("status"), "final_url", "attempts")


def seed_realign(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = seeds(spark, sf_dir)
    return shaping.realign(rows.where("status != 'fail'").select("ord", F.col("status").alias("outcome")), rows.select("ord", "batch"))


def audit_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = batches.audit_rollup(seeds(spark, sf_dir), "batch", "event_type", "value")
    return found.withColumns({"batch": F.coalesce(F.col("batch").cast("string"), F.lit("all")), "event_type": F.coalesce("event_type", F.lit("all"))})


def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = streams.audit_windows(table(spark, sf_dir, "events"), "ts", "event_type", "value", "6 hours")
    return found.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))


def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = streams.sessions(table(spark, sf_dir, "events"), "ts", "user_id", "2 hours")
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return found.select(text("session_start").alias("session_start"), text("session_end").alias("session_end"), "user_id", "n")


def bulk_delivery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as batches: delivered text, its form and the form of its JSON."""
    rows = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("batch"), F.col("turn").alias("ord"), F.concat(F.lit("https://c/"), F.col("turn").cast("string")).alias("url"),
        F.when(F.col("role") == "user", "fail").otherwise("pass").alias("status"), F.lit(200).alias("code"), F.coalesce("text", F.lit("")).alias("body"),
    )
    texts = delivery.bulk_text(rows, "batch", F.lit("f0"), cap=2_000).select("batch", F.sha2(F.col("text").cast("binary"), 256).alias("text_hash"), F.col("form").alias("text_form"))
    shapes = delivery.bulk_json(rows, "batch", cap=420).select("batch", F.col("form").alias("json_form"), F.length("json").cast("long").alias("json_length"))
    return texts.join(shapes, "batch")


def shown_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    hosts = F.transform(F.sequence(F.lit(1), F.pmod("user_id", F.lit(14)).cast("int") + 1), lambda i: F.when(i % 5 == 0, F.concat(F.lit("10.0.0."), i.cast("string"))).otherwise(F.concat(F.lit("h"), i.cast("string"), F.lit(".com"))))
    return table(spark, sf_dir, "events").select("event_id", F.array_join(batches.shown_hosts(hosts), " ").alias("hosts"))


CATALOGUE = [
    ("openrouter", "qwen/qwen3.6-flash", False, False, True, 131_072, 65_536, 0, 0.1, 0), ("openrouter", "deepseek/deepseek-v4-flash", False, True, True, 65_536, 16_384, 1, 0.0, 0),
    ("ollama", "small-local", True, True, False, 8_192, 4_096, 2, 0.0, 0), ("ollama", "large-local", True, True, True, 32_768, 8_192, 2, 0.2, 1),
]
MODELS = "m_provider string, m_model string, local boolean, free boolean, supports_json boolean, context long, max_output long, rank int, cost_weight double, demotion int"


def model_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model for each event as a request: task, size and constraints follow from its columns."""
    rows = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("request_id"), F.when(F.col("event_type") == "click", "extract").otherwise("summary").alias("task"),
        F.floor(F.col("value") * 300).cast("long").alias("input_tokens"), F.when(F.pmod("event_id", F.lit(6)) == 0, "ollama").alias("provider"),
        F.when(F.pmod("event_id", F.lit(10)) == 1, "large-local").alias("model"), F.array(F.lit("small-local")).alias("exclude"),
        (F.pmod("event_id", F.lit(4)) == 0).alias("local_only"), F.when(F.pmod("event_id", F.lit(3)) == 0, F.lit(1_000).cast("long")).alias("reserve"),
    )
    return models.choose(rows, spark.createDataFrame(CATALOGUE, MODELS)).select("request_id", "chosen_provider", "chosen_model", "reason")


QUERIES = {
    "batch_totals": batch_totals, "all_totals": all_totals, "egress_host_counts": egress_host_counts, "cap_breaches": cap_breaches, "failure_rows": failure_rows,
    "retry_merge": retry_merge, "seed_realign": seed_realign, "audit_rollup": audit_rollup, "event_windows": event_windows, "event_sessions": event_sessions,
    "bulk_delivery": bulk_delivery, "shown_hosts": shown_hosts, "model_choice": model_choice,
}

_SEEDS = f"""s AS (SELECT event_id AS ord, user_id AS batch, {STATUS_SQL} AS status, event_type, value, CAST(floor(value * 100) AS BIGINT) AS bytes,
    CAST(floor(value * 300) AS BIGINT) AS egress, CAST(floor(value) AS BIGINT) AS it, CASE WHEN event_type = 'purchase' THEN floor(value * 100) / 1e6 ELSE 0.0 END AS cost FROM events)"""
_TOTALS = """count(*) AS n, count(*) FILTER (status <> 'fail') AS passed, count(*) FILTER (status = 'fail') AS failed,
    CASE WHEN count(*) FILTER (status = 'fail') = count(*) THEN 'fail' WHEN count(*) FILTER (status <> 'pass') = 0 THEN 'pass' ELSE 'partial' END AS batch_status,
    CAST(sum(bytes) AS BIGINT) AS bytes, CAST(sum(egress) AS BIGINT) AS egress_bytes, CAST(sum(it) AS BIGINT) AS in_tokens, CAST(7 * count(*) AS BIGINT) AS out_tokens,
    round(CAST(sum(cost) AS DOUBLE), 6) AS cost_usd"""
_CATALOGUE = ", ".join("(" + ", ".join(repr(x) if isinstance(x, str) else str(x).lower() for x in row) + ")" for row in CATALOGUE)

SQL = {
    "batch_totals": f"WITH {_SEEDS} SELECT batch, {_TOTALS} FROM s GROUP BY batch",
    "all_totals": f"WITH {_SEEDS} SELECT {_TOTALS} FROM s",
    "egress_host_counts": """SELECT host, count(*) AS touches FROM (SELECT unnest(list_distinct(['h' || (user_id % 20), 'h' || (event_id % 7), 'h' || (event_id % 3), 'h' || (event_id * 3 % 11)])) AS host
        FROM events) GROUP BY host""",
    "cap_breaches": f"""WITH {_SEEDS}, f AS (SELECT batch, event_type, min(ord) AS o FROM s GROUP BY ALL) SELECT batch, string_agg(event_type, ',' ORDER BY o) AS kinds FROM f GROUP BY batch""",
    "failure_rows": f"""WITH {_SEEDS}, c AS (SELECT *, CASE WHEN ord % 9 = 0 THEN 0 WHEN ord % 10 = 0 THEN 1 ELSE 2 END AS class FROM s)
        SELECT CAST(class AS BIGINT) AS class, ord, 'https://h/' || ord AS url, CASE class WHEN 0 THEN 'invalid_url' WHEN 1 THEN 'tier2_board_not_supported_in_bulk'
            ELSE CASE WHEN ord % 4 = 0 THEN 'fetch_error' ELSE 'http_503' END END AS code, event_type AS message FROM c WHERE class < 2 OR status = 'fail'""",
    "retry_merge": f"""WITH {_SEEDS}, r AS (SELECT *, status = 'fail' AND ord % 50 <= 30 AND ord % 13 <> 0 AS again FROM s)
        SELECT ord, CAST(CASE WHEN again THEN bytes * 3 ELSE bytes END AS BIGINT) AS bytes, CASE WHEN again THEN 'r1,r2' ELSE 'r1' END AS redirects,
            CAST(CASE WHEN again OR status <> 'fail' THEN 200 ELSE 503 END AS BIGINT) AS status, CASE WHEN again THEN 'f2' ELSE 'f1' END AS final_url,
            CAST(CASE WHEN again THEN 2 ELSE 1 END AS BIGINT) AS attempts FROM r""",
    "seed_realign": f"WITH {_SEEDS} SELECT ord, batch, CASE WHEN status <> 'fail' THEN status END AS outcome FROM s",
    "audit_rollup": f"""WITH {_SEEDS} SELECT coalesce(CAST(batch AS VARCHAR), 'all') AS batch, coalesce(event_type, 'all') AS event_type, CAST(grouping(batch, event_type) AS BIGINT) AS level, count(*) AS n, round(sum(value), 4) AS total
        FROM s GROUP BY ROLLUP (batch, event_type)""",
    "event_windows": """SELECT strftime(time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '1970-01-01'), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total
        FROM events GROUP BY ALL""",
    "event_sessions": """WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 2 HOURS THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
        g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
        SELECT strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS session_start, strftime(max(ts) + INTERVAL 2 HOURS, '%Y-%m-%d %H:%M:%S') AS session_end, user_id, count(*) AS n FROM g GROUP BY user_id, k""",
    "bulk_delivery": r"""WITH r AS (SELECT conv_id AS batch, turn AS ord, 'https://c/' || turn AS url, CASE WHEN role = 'user' THEN 'fail' ELSE 'pass' END AS status, coalesce(text, '') AS body FROM conversations),
        k AS (SELECT *, CASE WHEN length(body) <= 500 THEN body ELSE regexp_replace(substr(body, 1, 499), '[\s\p{Z}]+$', '') || '…' END AS slim FROM r),
        j AS (SELECT batch, string_agg('== f0 ' || url || ' [' || status || ']' || chr(10) || body, chr(10) || chr(10) ORDER BY ord, body) AS f,
                string_agg('== f0 ' || url || ' [' || status || ']' || chr(10) || slim, chr(10) || chr(10) ORDER BY ord, body) AS s,
                13 + sum(length('{"ord":' || ord || ',"url":"' || url || '","status":"' || status || '","code":200,"body":' || to_json(body) || '}') + 1) AS nf,
                13 + sum(length('{"ord":' || ord || ',"url":"' || url || '","status":"' || status || '","code":200}') + 1) AS nl, count(*) AS n FROM k GROUP BY batch),
        q AS (SELECT batch, sum(length('{"ord":' || ord || ',"url":"' || url || '","status":"fail"}') + 1) - 1 AS nc FROM (SELECT * FROM r WHERE status = 'fail' QUALIFY row_number() OVER (PARTITION BY batch ORDER BY ord) <= 30) GROUP BY batch),
        c AS (SELECT *, length('{"count":' || n || ',"failures":[]}') AS nb, nb + coalesce(nc, 0) AS nx FROM j LEFT JOIN q USING (batch))
        SELECT batch, sha256(CASE WHEN length(f) <= 2000 THEN f WHEN length(s) <= 2000 THEN s ELSE substr(s, 1, 2000) END) AS text_hash,
            CASE WHEN length(f) <= 2000 THEN 'full' WHEN length(s) <= 2000 THEN 'slim' ELSE 'cut' END AS text_form,
            CASE WHEN nf <= 420 THEN 'full' WHEN nl <= 420 THEN 'lean' WHEN nx <= 420 THEN 'compact' ELSE 'bare' END AS json_form,
            CAST(CASE WHEN nf <= 420 THEN nf WHEN nl <= 420 THEN nl WHEN nx <= 420 THEN nx ELSE nb END AS BIGINT) AS json_length FROM c""",
    "shown_hosts": """WITH l AS (SELECT event_id, list_transform(range(1, user_id % 14 + 2), lambda i: CASE WHEN i % 5 = 0 THEN '[ip-literal]' ELSE 'h' || i || '.com' END) AS h FROM events),
        u AS (SELECT event_id, list_filter(h, lambda x, i: list_position(h, x) = i) AS h FROM l)
        SELECT event_id, CASE WHEN len(h) <= 8 THEN array_to_string(h, ' ') ELSE array_to_string(h[1:7], ' ') || ' (+' || (len(h) - 7) || ' more)' END AS hosts FROM u""",
    "model_choice": f"""WITH m(mp, mm, local, free, js, ctx, mo, rank, cw, dem) AS (VALUES {_CATALOGUE}),
        r AS (SELECT event_id AS request_id, CASE WHEN event_type = 'click' THEN 'extract' ELSE 'summary' END AS task, CAST(floor(value * 300) AS BIGINT) AS it,
            CASE WHEN event_id % 6 = 0 THEN 'ollama' END AS p, CASE WHEN event_id % 10 = 1 THEN 'large-local' END AS mo_, event_id % 4 = 0 AS lo, CASE WHEN event_id % 3 = 0 THEN 1000 END AS rs FROM events),
        f AS (SELECT r.*, m.* FROM r JOIN m ON (p IS NULL OR mp = p) AND (mo_ IS NULL OR mm = mo_) AND mm <> 'small-local' AND (NOT lo OR local) AND (task <> 'extract' OR js) AND ctx >= it + coalesce(least(rs, mo), mo)),
        b AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY rank + dem, dem, CASE WHEN local THEN 0.45 ELSE 0 END + CASE WHEN free THEN 0 ELSE 0.25 END + cw, mm) = 1)
        SELECT r.request_id, coalesce(b.mp, 'none') AS chosen_provider, b.mm AS chosen_model,
            CASE WHEN b.mm IS NULL THEN CASE WHEN r.lo THEN 'sensitive_content_no_local_provider' WHEN r.p IS NOT NULL THEN 'provider_unconfigured' WHEN r.mo_ IS NOT NULL THEN 'model_unavailable' ELSE 'no_model_fit' END END AS reason
        FROM r LEFT JOIN b USING (request_id)""",
}
