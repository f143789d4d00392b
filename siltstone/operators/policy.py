"""Rules of requests: guards of a batch, forwarding of a page's own requests, output modes, rows of seeds that did not run."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions import urls
from siltstone.functions.text import SEED_CONTENT, SEED_SNIPPET, clip, excerpt

from .lookups import TRACKERS, is_tracker

MIB = 1 << 20
# Defaults of a batch's guard, and what no operator or caller may go beyond.
GUARD = {
    "maxUrls": 50, "maxPerHostInBulk": 10, "maxGlobalEgressBytes": 100 * MIB, "maxGlobalWallMs": 55_000, "maxConcurrency": 4, "maxRenderedSeeds": 10,
    "maxPerHostInflight": 2, "crawlDelayMs": 1000, "maxTransformCostUsd": 0.5, "perSeedTransformCostUsd": 0.05,
}
SUMMARY_URLS, WALL_CEILING, DELAY_FLOOR, INPUT_CAP = 10, 180_000, 500, 200
RENDER_POOL, RENDER_SLACK = 48 * MIB, 5
BLOCKED_TYPES, DATA_TYPES = ("image", "font", "media"), ("fetch", "xhr")


def guard(output: str, operator: dict[str, Any] | None = None, caller: dict[str, Any] | None = None) -> tuple[dict[str, Any], list[str]]:
    """The guard of a batch, and which of the caller's wishes were cut. Operators may tighten, callers may lower costs."""
    own, wish, out, cut = operator or {}, caller or {}, dict(GUARD), []
    for name in ("maxTransformCostUsd", "perSeedTransformCostUsd"):
        out[name] = wish.get(name, GUARD[name])
        if out[name] > GUARD[name]:
            out[name] = GUARD[name]
            cut.append(name)
    for name, least in (("maxConcurrency", 1), ("maxPerHostInBulk", 1), ("maxRenderedSeeds", 0)):
        out[name] = min(GUARD[name], max(least, own.get(name, GUARD[name])))
    # seeds that run at once must not pass the cap together
    if out["perSeedTransformCostUsd"] > (share := out["maxTransformCostUsd"] / out["maxConcurrency"]):
        out["perSeedTransformCostUsd"] = share
        cut.append("perSeedTransformCostUsd")
    out["maxPerHostInflight"] = max(1, own.get("maxPerHostInflight", GUARD["maxPerHostInflight"]))
    out["crawlDelayMs"] = max(DELAY_FLOOR, own.get("crawlDelayMs", GUARD["crawlDelayMs"]))
    if "maxGlobalWallMs" in own:
        out["maxGlobalWallMs"] = min(WALL_CEILING, max(1, own["maxGlobalWallMs"]))
    out["maxUrls"] = GUARD["maxUrls"] if output == "raw" else SUMMARY_URLS
    return out, cut


def oversized(seeds: DataFrame, batch: str, cap: int = INPUT_CAP) -> DataFrame:
    """(batch, n, code): batches of more entries than a call may have, which are refused as a whole."""
    return seeds.groupBy(batch).agg(F.count("*").alias("n")).where(F.col("n") > cap).withColumn("code", F.lit("too_many_urls"))


def render_units(page_bytes: Column) -> Column:
    """How many page budgets a render may cost: its essential pool and five pages more, rounded up."""
    return F.ceil((F.lit(RENDER_POOL) + page_bytes * RENDER_SLACK) / page_bytes)


def same_domain(a: Column, b: Column) -> Column:
    """Whether two registrable domains are known and equal."""
    return F.coalesce(a == b, F.lit(False))


def is_blocked(url: Column, kind: Column, main_host: Column, listed: list[str] = TRACKERS) -> Column:
    """Whether a page's subresource is not fetched: heavy kinds, third-party trackers, and addresses that cannot be read."""
    host = urls.host(url)
    tracked = F.when(F.coalesce(host, F.lit("")) == "", True).otherwise(is_tracker(host, listed) & ~urls.is_first_party(host, main_host))
    return kind.isin(*BLOCKED_TYPES) | F.coalesce(tracked, F.lit(True))


def forward_plan(method: Column, kind: Column, domain: Column, main_domain: Column, declared: Column, body: Column, content_type: Column, cap: int) -> Column:
    """struct(plan, reason) of a page's own POST: ``forward``, or ``abort`` and why. Bodies are never cut."""
    own = (method == "POST") & kind.isin(*DATA_TYPES) & same_domain(domain, main_domain)
    length = F.regexp_extract(F.coalesce(declared, F.lit("")), r"^\s*(\d+)", 1).try_cast("double")
    reason = (
        F.when(~F.coalesce(own, F.lit(False)), "unsupported_browser_method")
        .when(length > cap, "request_body_too_large")
        .when(body.isNull(), "unreadable_post_body")
        .when(F.length(body) > cap, "request_body_too_large")
        .when((F.length(content_type) > 256) | content_type.rlike(r"[\r\n\x00]"), "invalid_post_header")
    )
    return F.struct(F.when(reason.isNull(), "forward").otherwise("abort").alias("plan"), reason.alias("reason"))


def preflight_plan(kind: Column, domain: Column, main_domain: Column) -> Column:
    """struct(plan, reason) of the OPTIONS request before such a POST: ``respond`` or ``abort``."""
    own = F.coalesce(kind.isin(*DATA_TYPES), F.lit(False)) & same_domain(domain, main_domain)
    return F.struct(F.when(own, "respond").otherwise("abort").alias("plan"), F.when(~own, "unsupported_browser_method").alias("reason"))


def wants_second_read(code: Column, size: Column, in_batch: Column) -> Column:
    """Whether a fetch that broke off before its first byte is tried once more; never within a batch."""
    return F.coalesce((code == "body_read_error") & (size == 0) & ~in_batch, F.lit(False))


def output_mode(requested: Column, challenged: Column, status: Column, tier: Column, configured: Column, failure: Column, provider: Column, result: Column, transformed: Column) -> Column:
    """struct(output, provider, reason, result): what a record is delivered as.

    Challenges, raw requests, errors of the page and of the fetch stay raw. Without a model, or where it failed or declined, the
    page's own text is given as an excerpt (the whole roster of a job board, tier 2).
    """
    raw = challenged | (requested == "raw") | (status >= 400) | (tier == "error")
    short = F.when(tier == "2", result).otherwise(excerpt(result))
    reason = F.when(raw, None).when(~configured, "unconfigured").when(failure == "extract_schema_invalid", "schema_validation_failed").when(failure.isNotNull(), "transform_failed")
    declined = reason.isNotNull() | (provider == "none")
    return F.struct(
        F.when(raw | declined, "raw").otherwise(requested).alias("output"),
        F.when(raw, None).when(reason.isNotNull(), "none").otherwise(provider).alias("provider"),
        reason.alias("reason"),
        F.when(raw, result).when(reason.isNotNull(), short).when(provider == "none", F.when(tier == "2", result).otherwise(excerpt(transformed))).otherwise(transformed).alias("result"),
    )


#: Seeds that gave no page: what became of them, the text of their code, and how the row came about.
NOT_RUN = {
    "reject": ("FETCH_REJECTED", "guarded-fetch"), "abandoned": ("FETCH_REJECTED", "bulk-wall-abandon"), "failed": ("SEED_ERROR", "seed-error"), "aborted": (None, "bulk-shortcut"),
}


def rows_not_run(seeds: DataFrame, kind: str, code: Column, message: Column, output: str = "raw") -> DataFrame:
    """Result rows of seeds (url and others) that were rejected, abandoned, failed or aborted by a cap; ``ord`` and other columns pass through."""
    code_text, via = NOT_RUN[kind]
    empty = F.array().cast("array<string>")
    return seeds.select(
        *seeds.columns, F.col("url").alias("final_url"), F.lit("fail").alias("status"), F.lit("error").alias("tier"), F.lit(0).alias("code"),
        (code if code_text is None else F.lit(code_text)).alias("code_text"), F.lit(0).cast("long").alias("bytes"), F.lit(0).cast("long").alias("egress_bytes"), F.lit(output).alias("output"),
        F.lit("generic").alias("platform"), F.lit(False).alias("js_required"), F.lit(via).alias("resolved_via"), empty.alias("redirect_hosts"), clip(message, SEED_SNIPPET).alias("result"),
        F.array(F.struct(code.alias("code"), message.alias("message"))).alias("errors"),
    )


def result_rows(records: DataFrame, output: Column) -> DataFrame:
    """Result rows of records (of ``extract.records``): addresses, verdicts, sizes, redirect hosts, snippet and clipped content."""
    errors = F.transform("errors", lambda e: F.struct(e["code"].alias("code"), e["message"].alias("message")))
    fatal = F.col("tier") == "error"
    none = F.array().cast("array<struct<code: string, message: string>>")
    return records.select(
        "seed_id", "url", "final_url", F.col("record_status").alias("status"), "tier", F.col("status").alias("code"), "code_text", "bytes", F.col("bytes").alias("egress_bytes"),
        output.alias("output"), F.lit("generic").alias("platform"), F.col("gate.js_required").alias("js_required"), "resolved_via",
        F.transform("redirects", lambda r: F.coalesce(F.nullif(urls.host(r["url"]), F.lit("")), r["url"])).alias("redirect_hosts"), "content_sha256",
        clip(F.col("result"), SEED_SNIPPET).alias("result"), clip(F.col("result"), SEED_CONTENT).alias("content"),
        F.when(fatal, none).otherwise(errors).alias("warnings"), F.when(fatal, errors).otherwise(none).alias("errors"),
    )
