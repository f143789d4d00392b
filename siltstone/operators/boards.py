"""Job boards: detection of boards in addresses, and rosters from the boards' JSON as one table of jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions import urls
from siltstone.functions.core import let
from siltstone.functions.text import first_text, iso_time

JOB_CAP = 500
FIELDS = ("id", "title", "url", "location", "department", "team", "employment_type", "workplace_type", "remote", "published_at", "compensation")

# Hosts of boards and of their list endpoints, and path segments that are no board.
GREENHOUSE_HOSTS, GREENHOUSE_API = ("boards.greenhouse.io", "job-boards.greenhouse.io"), "boards-api.greenhouse.io"
GREENHOUSE_RESERVED = ("embed", "embedding", "assets", "board")
LEVER_HOSTS, LEVER_APIS = ("jobs.lever.co", "jobs.eu.lever.co"), ("api.lever.co", "api.eu.lever.co")
ASHBY_HOST, ASHBY_API = "jobs.ashbyhq.com", "api.ashbyhq.com"

GREENHOUSE_SCHEMA = (
    "struct<jobs: array<struct<id: string, absolute_url: string, title: string, location: struct<name: string>, first_published: string, updated_at: string>>>"
)
LEVER_SCHEMA = (
    "array<struct<id: string, text: string, hostedUrl: string, categories: struct<commitment: string, department: string, location: string, team: string>, "
    "workplaceType: string, createdAt: bigint, salaryDescriptionPlain: string, salaryRange: struct<min: bigint, max: bigint, currency: string, interval: string>>>"
)
ASHBY_SCHEMA = (
    "struct<jobs: array<struct<id: string, title: string, department: string, team: string, employmentType: string, location: string, isRemote: boolean, "
    "workplaceType: string, publishedAt: string, jobUrl: string, applyUrl: string, isListed: boolean, shouldDisplayCompensationOnJobPostings: boolean, "
    "compensation: struct<scrapeableCompensationSalarySummary: string, compensationTierSummary: string>>>>"
)


def clean_token(c: Column) -> Column:
    """A board's name: letters, digits, dots, underscores and hyphens, at most 128; null for anything else."""
    t = F.trim(c)
    return F.when(t.rlike(r"^[A-Za-z0-9._-]{1,128}$") & ~t.isin(".", ".."), t)


def board_of(url: Column) -> Column:
    """struct(platform, token, source) of a board's address or list endpoint; null for others and for single jobs."""
    host = F.regexp_replace(urls.host(url), r"^www\.", "")
    seg = F.filter(F.split(urls.part(url, "path"), "/"), lambda s: s != "")
    n, at = F.size(seg), lambda k: F.coalesce(F.get(seg, F.lit(k)), F.lit(""))
    low = lambda k: F.lower(at(k))
    single_job = F.concat(F.lit("&"), F.substring(urls.part(url, "query"), 2, 10_000)).rlike(r"&gh_jid(=|&|$)")
    tokens = {
        ("ashby", "url-host"): F.when((host == ASHBY_HOST) & (n == 1) & ~at(0).isin("embed", "api"), at(0)),
        ("ashby", "api-host"): F.when((host == ASHBY_API) & (n == 3) & (low(0) == "posting-api") & (low(1) == "job-board"), at(2)),
        ("greenhouse", "url-host"): F.when(host.isin(*GREENHOUSE_HOSTS) & (n == 1) & ~single_job & ~low(0).isin(*GREENHOUSE_RESERVED), at(0)),
        ("greenhouse", "api-host"): F.when((host == GREENHOUSE_API) & (n == 4) & (low(0) == "v1") & (low(1) == "boards") & (low(3) == "jobs"), at(2)),
        ("lever", "url-host"): F.when(host.isin(*LEVER_HOSTS) & (n == 1), at(0)),
        ("lever", "api-host"): F.when(host.isin(*LEVER_APIS) & (n == 3) & (low(0) == "v0") & (low(1) == "postings"), at(2)),
    }
    found = []
    for (platform, source), token in tokens.items():
        name = clean_token(token)
        found.append(F.when(name.isNotNull(), F.struct(F.lit(platform).alias("platform"), name.alias("token"), F.lit(source).alias("source"))))
    return F.coalesce(*found)


def list_endpoint(platform: Column, token: Column) -> Column:
    """The address that lists a board's jobs."""
    return (
        F.when(platform == "ashby", F.concat(F.lit(f"https://{ASHBY_API}/posting-api/job-board/"), token, F.lit("?includeCompensation=true")))
        .when(platform == "greenhouse", F.concat(F.lit(f"https://{GREENHOUSE_API}/v1/boards/"), token, F.lit("/jobs")))
        .when(platform == "lever", F.concat(F.lit("https://api.lever.co/v0/postings/"), token, F.lit("?mode=json")))
    )


def _job(**columns: Column) -> list[Column]:
    own = {f: columns.get(f, F.lit(None).cast("string")) for f in FIELDS}
    own["remote"] = columns.get("remote", F.lit(None).cast("boolean"))
    shown = {
        "id": F.coalesce(own["id"], own["url"], own["title"], F.lit("")), "title": F.coalesce(own["title"], own["id"], F.lit("")), "url": F.coalesce(own["url"], F.lit("")),
    }
    return [*(shown.get(f, own[f]).alias(f) for f in FIELDS), F.coalesce(own["id"], own["title"], own["url"]).isNotNull().alias("__any")]


def _lever_pay(j: Column) -> Column:
    low, high = j["salaryRange"]["min"].cast("string"), j["salaryRange"]["max"].cast("string")
    pay = F.when(low.isNotNull() & high.isNotNull(), F.concat_ws("-", low, high)).otherwise(F.coalesce(low, high))
    shown = F.when(pay.isNotNull(), F.concat_ws(" ", first_text(j["salaryRange"]["currency"]), pay, first_text(j["salaryRange"]["interval"])))
    return F.coalesce(first_text(j["salaryDescriptionPlain"]), shown)


_ROSTERS = (("ashby", ASHBY_SCHEMA, "jobs"), ("greenhouse", GREENHOUSE_SCHEMA, "jobs"), ("lever", LEVER_SCHEMA, None))


def _listed(platform: str, schema: str, path: str | None, body: Column) -> Column:
    """The jobs of a roster that are listed, as the platform gives them; null for text that is no roster."""
    parsed = F.from_json(body, schema)
    listed = parsed[path] if path else parsed
    return F.filter(listed, lambda j: F.coalesce(j["isListed"], F.lit(True))) if platform == "ashby" else listed


def _fields(platform: str, j: Column) -> list[Column]:
    """A job of a platform in the fields that all platforms have."""
    if platform == "ashby":
        pay = F.when(F.coalesce(j["shouldDisplayCompensationOnJobPostings"], F.lit(False)), first_text(j["compensation"]["scrapeableCompensationSalarySummary"], j["compensation"]["compensationTierSummary"]))
        return _job(
            id=first_text(j["id"]), title=first_text(j["title"]), url=first_text(j["jobUrl"], j["applyUrl"]), location=first_text(j["location"]),
            department=first_text(j["department"]), team=first_text(j["team"]), employment_type=first_text(j["employmentType"]),
            workplace_type=first_text(j["workplaceType"]), remote=j["isRemote"], published_at=first_text(j["publishedAt"]), compensation=pay,
        )
    if platform == "greenhouse":
        return _job(
            id=j["id"], title=first_text(j["title"]), url=first_text(j["absolute_url"]), location=first_text(j["location"]["name"]),
            published_at=first_text(j["first_published"], j["updated_at"]),
        )
    c = j["categories"]
    return _job(
        id=first_text(j["id"]), title=first_text(j["text"]), url=first_text(j["hostedUrl"]), location=first_text(c["location"]),
        department=first_text(c["department"]), team=first_text(c["team"]), employment_type=first_text(c["commitment"]),
        workplace_type=first_text(j["workplaceType"]), published_at=iso_time(j["createdAt"]), compensation=_lever_pay(j),
    )


def roster(platform: Column, body: Column, cap: int = JOB_CAP) -> Column:
    """array<struct(ord, job_count, truncated, and the job's fields)> of a board's list, as ``jobs`` gives them; empty for other platforms and texts."""
    found = []
    for name, schema, path in _ROSTERS:
        def rows(listed: Column, name: str = name) -> Column:
            own = lambda j, k: F.struct(k.cast("long").alias("ord"), F.size(listed).cast("long").alias("job_count"), (F.size(listed) > cap).alias("truncated"), *_fields(name, j))
            kept = F.filter(F.transform(F.slice(listed, 1, cap), own), lambda j: j["__any"])
            return F.transform(kept, lambda j: F.struct(*[j[c].alias(c) for c in ("ord", "job_count", "truncated", *FIELDS)]))

        found.append(F.when(platform == name, let(_listed(name, schema, path, body), rows)))
    return F.coalesce(*found)


def jobs(boards: DataFrame, json_col: str = "body", cap: int = JOB_CAP) -> DataFrame:
    """Jobs of boards (platform, board, body): platform, board, ord, job_count, truncated, and the job's fields.

    Text that is no roster gives no jobs; jobs not listed are dropped before counting, jobs past ``cap``
    and jobs without any name are dropped after. One board's roster is one row of the input, so bounded.
    """
    out = None
    for platform, schema, path in _ROSTERS:
        own = boards.where(F.col("platform") == platform).select("platform", "board", _listed(platform, schema, path, F.col(json_col)).alias("__jobs"))
        rows = own.select("platform", "board", F.size("__jobs").cast("long").alias("job_count"), F.posexplode("__jobs").alias("ord", "j"))
        rows = rows.where(F.col("ord") < cap).select("platform", "board", F.col("ord").cast("long"), "job_count", (F.col("job_count") > cap).alias("truncated"), *_fields(platform, F.col("j")))
        rows = rows.where("__any").drop("__any")
        out = rows if out is None else out.unionByName(rows)
    return out


#: Bytes of a roster; a caller's own limit counts where it is smaller.
MAX_ROSTER = 8 * 1024 * 1024


def board_bodies(responses: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """Fetched rosters (platform, board, status, body as bytes, truncated, rejected) as texts: ``body``, ``digest`` and ``dropped``.

    A roster counts only whole: refused fetches, statuses other than 2xx, bodies that were cut or exceed the limit, and texts that are no JSON have a null body
    and digest, and the first of these reasons in ``dropped``. The digest is the SHA-256 of the bytes.
    """
    limit = MAX_ROSTER if max_bytes is None else min(MAX_ROSTER, max_bytes)
    shown = F.make_valid_utf8(F.regexp_replace(F.make_valid_utf8(F.col("body")), "^\\ufeff", ""))
    reason = (
        F.when(F.coalesce("rejected", F.lit(False)), "rejected")
        .when(~F.coalesce(F.col("status").between(200, 299), F.lit(False)), "status")
        .when(F.coalesce("truncated", F.lit(False)) | (F.length("body") > limit), "truncated")
        .when(F.try_parse_json(shown).isNull(), "not_json")
    )
    made = responses.withColumn("__dropped", reason).withColumn("__digest", F.sha2("body", 256))
    kept = lambda c: F.when(F.col("__dropped").isNull(), c)
    return made.withColumns({"body": kept(shown), "digest": kept(F.col("__digest")), "dropped": F.col("__dropped")}).drop("__dropped", "__digest")


def envelopes(rows: DataFrame) -> DataFrame:
    """One row per board: job_count, truncated, kept jobs and a title."""
    label = F.initcap("platform")
    grouped = rows.groupBy("platform", "board").agg(F.max("job_count").alias("job_count"), F.max("truncated").alias("truncated"), F.count("*").alias("kept"))
    return grouped.withColumn("title", F.concat(F.col("job_count").cast("string"), F.lit(" open role(s) · "), label, F.lit(" · "), F.col("board")))


def roster_cap(rows: DataFrame, board: str, order: str, cap: int = JOB_CAP) -> DataFrame:
    """Already exploded jobs: the count of each board, and its first ``cap`` jobs."""
    counts = rows.groupBy(board).agg(F.count("*").alias("job_count"))
    kept = rows.withColumn("__rn", F.row_number().over(Window.partitionBy(board).orderBy(order))).where(F.col("__rn") <= cap).drop("__rn")
    return kept.join(counts, board).withColumn("truncated", F.col("job_count") > cap)
