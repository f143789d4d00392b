"""Round trips: pages and rosters built from known columns, read back by the operators, compared with the columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.functions import html, nodes, text
from siltstone.operators import boards, extract, schema

from .tables import spread, table


def _escaped(c):
    out = F.replace(c, F.lit("&"), F.lit("&amp;"))
    for raw, name in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(raw), F.lit(name))
    return out


def jsonld_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles in a JSON-LD graph: types, headline and lead come back."""
    docs = table(spark, sf_dir, "documents").select("doc_id", text.collapse(F.coalesce("text", F.lit(""))).alias("t"))
    kind = F.when(F.pmod("doc_id", F.lit(3)) == 0, "JobPosting").when(F.pmod("doc_id", F.lit(3)) == 1, "https://schema.org/NewsArticle").otherwise("Organization")
    node = F.to_json(F.struct(kind.alias("@type"), F.concat(F.lit("H"), F.col("doc_id").cast("string")).alias("headline"), F.col("t").alias("description")))
    page = F.concat(F.lit('<html><head><script type="application/ld+json">{"@graph":['), F.replace(node, F.lit("</"), F.lit("<\\/")), F.lit("]}</script></head><body></body></html>"))
    found = docs.select("doc_id", nodes.bearing(html.json_ld(page), F.lit(False)).alias("b"))
    return found.select(
        "doc_id", F.array_join(F.flatten(F.transform("b", nodes.types)), ",").alias("types"), F.get(F.transform("b", lambda v: nodes.harvest(v, True)), F.lit(0)).alias("lead"),
        nodes.content_kind_of_types(F.flatten(F.transform("b", nodes.types))).alias("kind"),
    )


def meta_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attributes of parts as meta elements: quoting, references and last-wins."""
    parts = spread(spark, sf_dir, "part")
    page = F.concat(
        F.lit('<meta property="og:title" content="old"><meta content="'), _escaped(F.concat(F.col("p_name"), F.lit(' & "x" <'))), F.lit('" property="og:title">'),
        F.lit("<meta name='Brand' content='"), _escaped(F.col("p_brand")), F.lit("'><meta name=size content="), F.col("p_size").cast("string"), F.lit("><link rel='alternate canonical' href='/p?a=1&amp;b=2'>"),
    )
    m = F.col("m")
    return parts.select("p_partkey", html.meta(page).alias("m"), html.canonical_link(page).alias("canonical")).select(
        "p_partkey", html.open_graph_of(m)["og:title"].alias("title"), html.plain_meta_of(m)["brand"].alias("brand"), m["size"].alias("size"), F.size(m).cast("long").alias("n"), "canonical",
    )


def hidden_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visible text between hidden parts, scripts and comments."""
    docs = table(spark, sf_dir, "documents").select("doc_id", text.collapse(F.coalesce("text", F.lit(""))).alias("t"))
    page = F.concat(
        F.lit('<body><script>var a = "<p>no</p>";</script><div hidden>gone</div><p>'), _escaped(F.col("t")), F.lit('</p><span style="color:red; display: none">gone too</span><!-- gone --><p>&#65;&#x42;&amp;lt; $ 10 .90</p></body>'),
    )
    return docs.select("doc_id", html.visible_text(page).alias("text"))


def image_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image addresses from Open Graph and markup, resolved, internal ones dropped, each once."""
    orders = spread(spark, sf_dir, "orders")
    key = F.col("o_orderkey").cast("string")
    page = F.concat(
        F.lit('<meta property="og:image" content="https://cdn.example.com/'), key, F.lit('.png"><img src="/a/'), key, F.lit('.jpg"><img src="//cdn.example.com/'), key,
        F.lit('.png"><source srcset="b.webp 1x, c.webp 2x"><img src="http://127.0.0.1/x.png"><img alt="none">'),
    )
    return orders.select("o_orderkey", F.array_join(html.images(page, F.lit("https://example.com/dir/page")), " ").alias("images"))


def board_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as jobs of boards of three platforms, by brand and a stretch of keys, so a board is bounded."""
    parts = table(spark, sf_dir, "part").withColumn("board", F.concat_ws("-", "p_brand", F.floor(F.col("p_partkey") / 1_000).cast("string")))
    key, name, kind = F.col("p_partkey").cast("string"), F.col("p_name"), F.col("p_type")
    job = {
        "ashby": F.struct(
            key.alias("id"), name.alias("title"), kind.alias("department"), (F.col("p_size") > 25).alias("isRemote"), (F.col("p_size") != 7).alias("isListed"),
            F.concat(F.lit("https://j/"), key).alias("jobUrl"), F.lit(True).alias("shouldDisplayCompensationOnJobPostings"),
            F.struct(F.col("p_retailprice").cast("string").alias("compensationTierSummary")).alias("compensation"),
        ),
        "greenhouse": F.struct(F.col("p_partkey").alias("id"), name.alias("title"), F.concat(F.lit("https://j/"), key).alias("absolute_url"), F.struct(kind.alias("name")).alias("location")),
        "lever": F.struct(
            key.alias("id"), name.alias("text"), F.concat(F.lit("https://j/"), key).alias("hostedUrl"), F.struct(kind.alias("team")).alias("categories"),
            (F.lit(1_553_186_035_299) + F.col("p_partkey") * 1000).alias("createdAt"), F.struct(F.col("p_size").alias("min"), F.lit("EUR").alias("currency"), F.lit("year").alias("interval")).alias("salaryRange"),
        ),
    }
    rosters = None
    for k, (platform, one) in enumerate(job.items()):
        own = parts.where(F.pmod("p_partkey", F.lit(3)) == k).groupBy("board").agg(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", one.alias("j")))), lambda x: x["j"]).alias("jobs"))
        body = F.to_json("jobs") if platform == "lever" else F.to_json(F.struct("jobs"))
        part = own.select(F.lit(platform).alias("platform"), "board", body.alias("body"))
        rosters = part if rosters is None else rosters.unionByName(part)
    return boards.jobs(rosters, cap=10).select(
        "platform", "board", "ord", "job_count", "truncated", "id", "title", "url", "location", "department", "team", F.col("remote").cast("string").alias("remote"), "published_at", "compensation"
    )


def board_fetches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rosters fetched for boards of parts, some of which fail, joined with the jobs that they hold."""
    parts = table(spark, sf_dir, "part").withColumn("board", F.concat_ws("-", "p_brand", F.floor(F.col("p_partkey") / 50).cast("string")))
    one = F.concat(F.lit('{"id":"j'), F.col("p_partkey").cast("string"), F.lit('","text":"'), F.col("p_name"), F.lit('"}'))
    listed = parts.groupBy("board").agg(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", one.alias("j")))), lambda x: x["j"]).alias("jobs"), F.min("p_partkey").alias("k"))
    end = F.when(F.col("k") % 7 == 3, "").otherwise("]")
    fetched = listed.select(
        F.lit("lever").alias("platform"), "board", F.concat(F.lit("["), F.array_join("jobs", ","), end).cast("binary").alias("body"), F.when(F.col("k") % 5 == 0, 404).otherwise(200).alias("status"),
        (F.col("k") % 11 == 1).alias("truncated"), (F.col("k") % 13 == 2).alias("rejected"),
    )
    found = boards.board_bodies(fetched, max_bytes=2_000)
    counts = boards.jobs(found.where("body is not null")).groupBy("board").agg(F.count("*").alias("n_jobs"), F.max("id").alias("last_id"))
    return found.join(counts, "board", "left").select("board", "dropped", "digest", F.coalesce("n_jobs", F.lit(0)).alias("n_jobs"), "last_id")


def board_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses of boards, list endpoints and single jobs, made from ids."""
    forms = [
        "https://boards.greenhouse.io/acme", "https://boards.greenhouse.io/acme/jobs/1", "https://www.job-boards.greenhouse.io/acme?x=1", "https://boards.greenhouse.io/acme?gh_jid=4",
        "https://boards-api.greenhouse.io/v1/boards/acme/jobs", "https://jobs.lever.co/acme", "https://jobs.lever.co/acme/abc", "https://api.lever.co/v0/postings/acme",
        "https://jobs.ashbyhq.com/acme", "https://jobs.ashbyhq.com/embed", "https://api.ashbyhq.com/posting-api/job-board/acme", "https://example.com/acme",
    ]
    form = F.element_at(F.array(*[F.lit(f) for f in forms]), (F.pmod("doc_id", F.lit(len(forms))) + 1).cast("int"))
    rows = table(spark, sf_dir, "documents").select("doc_id", boards.board_of(form).alias("b"))
    return rows.select("doc_id", F.col("b.platform").alias("platform"), F.col("b.source").alias("source"), boards.list_endpoint(F.col("b.platform"), F.col("b.token")).alias("endpoint"))


SCHEMA = {"type": "object", "required": ["k"], "properties": {"k": {"type": "integer", "minimum": 10, "exclusiveMaximum": 90, "not": {"enum": [13, 77]}}}, "additionalProperties": False}


def props_schema_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", schema.valid(F.try_parse_json("props"), SCHEMA).alias("valid"))


def provenance_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = text.provenance_hash(
        url=F.col("url"), finalUrl=F.col("url"), tier=F.lit("1"), code=F.lit(200), output=F.lit("raw"), resolvedVia=F.lit("tier1-html"), jsRequired=F.lit(False),
        contentSha256=text.sha256(F.col("html")), fetchedAt=F.lit(None).cast("string"),
    )
    return table(spark, sf_dir, "pages").select("page_id", digest.alias("provenance_hash"))


PROMPT_CHARS = 2_000


def conversation_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of a conversation as prompts of about ``PROMPT_CHARS`` characters, in order, with their token estimates."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.col("role"), F.lit(": "), F.coalesce("text", F.lit(""))).alias("line"))
    before = F.coalesce(F.sum(F.length("line")).over(Window.partitionBy("conv_id").orderBy("turn", "line").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "line"))), lambda x: x["line"]), "\n")
    prompts = rows.withColumn("chunk", F.floor(before / PROMPT_CHARS).cast("long")).groupBy("conv_id", "chunk").agg(joined.alias("prompt"))
    return prompts.select("conv_id", "chunk", F.sha2(F.col("prompt").cast("binary"), 256).alias("prompt_hash"), text.token_estimate(F.col("prompt")).alias("tokens"))


def capped_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    capped = extract.capped_body(F.coalesce("html", F.lit("")).cast("binary"), 2_000)
    return table(spark, sf_dir, "pages").select("page_id", F.length(capped["body"]).cast("long").alias("kept"), capped["truncated"].alias("truncated"))


QUERIES = {
    "jsonld_roundtrip": jsonld_roundtrip, "meta_roundtrip": meta_roundtrip, "hidden_roundtrip": hidden_roundtrip, "image_roundtrip": image_roundtrip,
    "board_roundtrip": board_roundtrip, "board_fetches": board_fetches, "board_tokens": board_tokens, "props_schema_check": props_schema_check, "provenance_hash": provenance_hash,
    "conversation_prompts": conversation_prompts, "capped_bodies": capped_bodies,
}

_T = r"trim(regexp_replace(coalesce(text, ''), '[\s\p{Z}]+', ' ', 'g'))"

SQL = {
    "jsonld_roundtrip": f"""SELECT doc_id, CASE WHEN doc_id % 3 = 2 OR (doc_id % 3 = 0 AND t = '') THEN '' WHEN doc_id % 3 = 0 THEN 'jobposting' ELSE 'newsarticle' END AS types,
        CASE WHEN doc_id % 3 = 0 THEN CASE WHEN length(t) > 4096 THEN substr(t, 1, 4095) || '…' ELSE nullif(t, '') END WHEN doc_id % 3 = 1 THEN 'H' || doc_id END AS lead,
        CASE WHEN doc_id % 3 = 0 AND t <> '' THEN 'job' WHEN doc_id % 3 = 1 THEN 'article' END AS kind FROM (SELECT doc_id, {_T} AS t FROM documents)""",
    "meta_roundtrip": """SELECT p_partkey, p_name || ' & "x" <' AS title, p_brand AS brand, CAST(p_size AS VARCHAR) AS size, CAST(3 AS BIGINT) AS n, '/p?a=1&b=2' AS canonical FROM part""",
    "hidden_roundtrip": rf"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace({_T} || CASE WHEN {_T} = '' THEN '' ELSE ' ' END || 'AB&lt; $ 10 .90',
        '([€£¥₹$])\s+(\d[\d ,]*)\s*\.\s*(\d{{1,4}})', '\1\2.\3', 'g'), '(\d)\s+\.(\d)', '\1.\2', 'g'), '(\d)\s+([€£¥₹])', '\1\2', 'g') AS text FROM documents""",
    "image_roundtrip": """SELECT o_orderkey, 'https://cdn.example.com/' || o_orderkey || '.png https://example.com/a/' || o_orderkey || '.jpg https://example.com/dir/b.webp' AS images
        FROM orders""",
    "board_fetches": """WITH g AS (SELECT p_brand || '-' || p_partkey // 50 AS board, min(p_partkey) AS k, count(*) AS n, max('j' || p_partkey) AS last,
            string_agg('{"id":"j' || p_partkey || '","text":"' || p_name || '"}', ',' ORDER BY p_partkey) AS jobs FROM part GROUP BY ALL),
        b AS (SELECT *, '[' || jobs || CASE WHEN k % 7 = 3 THEN '' ELSE ']' END AS body FROM g),
        d AS (SELECT *, CASE WHEN k % 13 = 2 THEN 'rejected' WHEN k % 5 = 0 THEN 'status' WHEN k % 11 = 1 OR strlen(body) > 2000 THEN 'truncated' WHEN k % 7 = 3 THEN 'not_json' END AS dropped FROM b)
        SELECT board, dropped, CASE WHEN dropped IS NULL THEN sha256(body) END AS digest, CASE WHEN dropped IS NULL THEN n ELSE 0 END AS n_jobs, CASE WHEN dropped IS NULL THEN last END AS last_id FROM d""",
    "board_roundtrip": """WITH p AS (SELECT *, p_brand || '-' || (p_partkey // 1000) AS board, (['ashby', 'greenhouse', 'lever'])[p_partkey % 3 + 1] AS platform FROM part),
        l AS (SELECT *, row_number() OVER (PARTITION BY platform, board ORDER BY p_partkey) - 1 AS ord, count(*) OVER (PARTITION BY platform, board) AS n FROM p WHERE platform <> 'ashby' OR p_size <> 7)
        SELECT platform, board, ord, n AS job_count, n > 10 AS truncated, CAST(p_partkey AS VARCHAR) AS id, p_name AS title, 'https://j/' || p_partkey AS url,
            CASE WHEN platform = 'greenhouse' THEN p_type END AS location, CASE WHEN platform = 'ashby' THEN p_type END AS department, CASE WHEN platform = 'lever' THEN p_type END AS team,
            CASE WHEN platform = 'ashby' THEN CAST(p_size > 25 AS VARCHAR) END AS remote,
            CASE WHEN platform = 'lever' THEN strftime(make_timestamp((1553186035299 + p_partkey * 1000) * 1000), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' END AS published_at,
            CASE WHEN platform = 'ashby' THEN CAST(p_retailprice AS VARCHAR) WHEN platform = 'lever' THEN 'EUR ' || p_size || ' year' END AS compensation
        FROM l WHERE ord < 10""",
    "board_tokens": """SELECT doc_id, (['greenhouse', NULL, 'greenhouse', NULL, 'greenhouse', 'lever', NULL, 'lever', 'ashby', NULL, 'ashby', NULL])[doc_id % 12 + 1] AS platform,
        (['url-host', NULL, 'url-host', NULL, 'api-host', 'url-host', NULL, 'api-host', 'url-host', NULL, 'api-host', NULL])[doc_id % 12 + 1] AS source,
        CASE WHEN doc_id % 12 IN (0, 2, 4) THEN 'https://boards-api.greenhouse.io/v1/boards/acme/jobs' WHEN doc_id % 12 IN (5, 7) THEN 'https://api.lever.co/v0/postings/acme?mode=json'
            WHEN doc_id % 12 IN (8, 10) THEN 'https://api.ashbyhq.com/posting-api/job-board/acme?includeCompensation=true' END AS endpoint FROM documents""",
    "props_schema_check": """SELECT event_id, k >= 10 AND k < 90 AND k NOT IN (13, 77) AS valid FROM (SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)""",
    "provenance_hash": """SELECT page_id, sha256('{"url":' || to_json(url) || ',"finalUrl":' || to_json(url) || ',"tier":1,"code":200,"output":"raw","resolvedVia":"tier1-html","jsRequired":false,"contentSha256":"'
        || sha256(html) || '","fetchedAt":null,"transformProvider":null,"transformModel":null}') AS provenance_hash FROM pages""",
    "conversation_prompts": f"""WITH l AS (SELECT conv_id, turn, role || ': ' || coalesce(text, '') AS line FROM conversations),
        c AS (SELECT *, CAST(coalesce(sum(length(line)) OVER (PARTITION BY conv_id ORDER BY turn, line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // {PROMPT_CHARS} AS BIGINT) AS chunk FROM l)
        SELECT conv_id, chunk, sha256(p) AS prompt_hash, greatest(1, CAST(ceil(length(p) / 4.0) AS BIGINT)) AS tokens
        FROM (SELECT conv_id, chunk, string_agg(line, chr(10) ORDER BY turn, line) AS p FROM c GROUP BY conv_id, chunk)""",
    "capped_bodies": "SELECT page_id, CAST(least(strlen(html), 2000) AS BIGINT) AS kept, strlen(html) > 2000 AS truncated FROM pages",
}
