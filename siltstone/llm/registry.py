"""Queries of the training-data operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.shipping import ship

from . import conversations, decontaminate, embedding_join, html_main, line_dedup, merkle, ngram_join, oracles, packing, quality, quality_rules, secret_scan, sharding, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_embedding_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_join.near_duplicates(table(spark, sf_dir, "embeddings"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark"), short_items=True)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs)


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return secret_scan.digest(secret_scan.with_findings(docs).drop("text"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(table(spark, sf_dir, "pages"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    scored = quality.with_score(docs, model).drop("text")
    return scored.select(
        "doc_id", quality.is_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 256)


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return ngram_join.jaccard_components(docs, n=4, num=85, den=100)


def op10_html_main(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_main.main_text(table(spark, sf_dir, "pages"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.damage_and_repair(table(spark, sf_dir, "conversations"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.documents_manifest(table(spark, sf_dir, "documents"))


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = quality_rules.with_verdict(quality_rules.ledger(docs))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_embedding_join": op1_embedding_join,
        "op2_decontamination": op2_decontamination,
        "op3_line_dedup": op3_line_dedup,
        "op4_secret_scan": op4_secret_scan,
        "op5_warc": op5_warc,
        "op6_quality": op6_quality,
        "op7_packing": op7_packing,
        "op8_sharding": op8_sharding,
        "op9_ngram_join": op9_ngram_join,
        "op10_html_main": op10_html_main,
        "op11_conversation_repair": op11_conversation_repair,
        "op12_merkle_manifest": op12_merkle_manifest,
        "op13_quality_rules": op13_quality_rules,
    }


# Components in SQL: the smallest node that links reach, label by label until nothing changes.
_REACH = """reach(a, b) AS (SELECT id, id FROM nodes UNION SELECT reach.a, links.v FROM reach JOIN links ON links.u = reach.b),
component AS (SELECT a AS id, min(b) AS c FROM reach GROUP BY a)"""

ORACLES = {
    "op1_embedding_join": f"""WITH RECURSIVE x AS (SELECT vec_id AS id, label, [CAST(e AS DOUBLE) FOR e IN embedding] AS v FROM embeddings),
        ok AS (SELECT * FROM x WHERE label IS NOT NULL AND len(list_filter(v, lambda e: e IS NULL OR NOT isfinite(e))) = 0 AND list_dot_product(v, v) > 0),
        links AS (SELECT p.id AS u, q.id AS v FROM ok p JOIN ok q ON p.label = q.label AND p.id <> q.id
            WHERE list_dot_product(p.v, q.v) / sqrt(list_dot_product(p.v, p.v) * list_dot_product(q.v, q.v)) >= 0.98),
        nodes AS (SELECT id FROM x), {_REACH}
        SELECT x.id AS vec_id, (SELECT count(*) FROM links WHERE u = x.id) AS n_links, c AS component_id, x.id = c AS kept FROM x JOIN component USING (id)""",
    "op3_line_dedup": line_dedup.ORACLE,
    "op5_warc": """WITH p AS (SELECT page_id, url, coalesce(html, '') AS h FROM pages), m AS (SELECT h, max(page_id) AS best FROM p GROUP BY h),
        b AS (SELECT p.*, best, array_to_string([lpad(bin(instr('0123456789abcdef', substr(sha1(h), i, 1)) - 1), 4, '0') FOR i IN range(1, 41)], '') AS bits FROM p JOIN m USING (h))
        SELECT page_id, strlen(h) AS payload_bytes,
            array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + list_sum([CAST(substr(bits, 5 * i + k, 1) AS INTEGER) << (5 - k) FOR k IN range(1, 6)]) AS BIGINT), 1) FOR i IN range(0, 32)], '') AS payload_digest,
            CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> best THEN best END AS refers_to, url FROM b""",
    "op9_ngram_join": f"""WITH RECURSIVE w AS (SELECT doc_id AS id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
        s AS (SELECT id, list_distinct([array_to_string(w[i:i + 3], ' ') FOR i IN range(1, greatest(2, len(w) - 2))]) AS s, len(w) AS n FROM w),
        k AS (SELECT id, CASE WHEN n = 0 THEN [] ELSE s END AS s FROM s), g AS (SELECT id, len(s) AS n, unnest(s) AS t FROM k),
        o AS (SELECT p.id AS u, q.id AS v, p.n AS pn, q.n AS qn, count(*) AS shared FROM g p JOIN g q ON p.t = q.t AND p.id <> q.id GROUP BY ALL),
        links AS (SELECT u, v FROM o WHERE 100 * shared >= 85 * (pn + qn - shared)), nodes AS (SELECT id FROM k), {_REACH}
        SELECT id AS doc_id, CAST(len(s) AS BIGINT) AS n_shingles, c AS component_id FROM k JOIN component USING (id)""",
    "op11_conversation_repair": oracles.CONVERSATIONS,
    "op12_merkle_manifest": oracles.MANIFEST,
    "op13_quality_rules": oracles.RULES,
    # Menus, adverts and footers go from the body, what is left is the text: the stored pages have no other boilerplate.
    "op10_html_main": r"""WITH b AS (SELECT page_id, url, regexp_replace(regexp_extract(coalesce(html, ''), '(?is)<body[^>]*>(.*?)(?:</body>|$)', 1), '(?is)<!--.*?-->|<(?:script|style)[^>]*>.*?</(?:script|style)>', '', 'g') AS h FROM pages),
        k AS (SELECT page_id, url, regexp_replace(h, '(?is)<nav>.*?</nav>|<footer>.*?(?:</footer>|$)|<div class="ad">.*?</div>', '<hr>', 'g') AS h FROM b),
        a AS (SELECT page_id, url, string_split_regex(h, '(?i)</?(?:p|h1|div|article|hr)(?:\s[^>]*)?>') AS parts FROM k),
        t AS (SELECT page_id, url, [trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '(?i)<br>', ' ', 'g'), '<[^>]*>', '', 'g'), '&quot;?', '"', 'g'), '&middot;?', '·', 'g'), '&amp;?', '&', 'g'),
            '[\s\x{00A0}]+', ' ', 'g')) FOR x IN parts] AS parts FROM a)
        SELECT page_id, url, array_to_string(list_filter(parts, lambda x: x <> ''), chr(10)) AS text, length(array_to_string(list_filter(parts, lambda x: x <> ''), chr(10))) AS n_chars FROM t""",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
