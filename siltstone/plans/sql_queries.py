"""Queries written in SQL with the library's SQL names, over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siltstone import sql_names

from .tables import spread, table


def sql_html_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Start tags of every page by name, with their attributes counted."""
    sql_names.register(spark, names=("html_tags",))
    return spark.sql(
        """SELECT page_id, t.name, count(*) AS n, sum(size(t.attributes)) AS n_attributes, min(t.attributes['href']) AS least_href, max(t.position) AS last_position
        FROM {pages} p, LATERAL html_tags(p.html, NULL) t GROUP BY page_id, t.name""",
        pages=table(spark, sf_dir, "pages"),
    )


def sql_json_ld_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of JSON-LD that parts are written into: a product with offers in arrays inside arrays and a chain of links."""
    sql_names.register(spark, names=("json_ld_nodes",))
    return spark.sql(
        """WITH pages AS (SELECT p_partkey, '<html><script type="application/ld+json">//<![CDATA[\\n' || to_json(named_struct('@type', 'Product', '@id', 'p' || p_partkey, 'name', p_name, 'offers',
                array(array(named_struct('@type', array('Offer', p_brand), 'name', CAST(p_retailprice AS STRING))), array()), 'about', named_struct('hasPart', named_struct('subject',
                named_struct('mainEntity', named_struct('about', named_struct('@type', p_type, 'size', p_size))))))) || '\\n//]]></script><script type="application/ld+json">[[[' || p_size || ', {{"name": "'
                || p_type || '"}}]]]</script>' AS html FROM {part})
        SELECT p_partkey, n.script, n.path, n.depth, array_join(n.types, ',') AS types, n.id, n.name FROM pages, LATERAL json_ld_nodes(html) n""",
        part=spread(spark, sf_dir, "part"),
    )


def sql_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rosters of boards that parts are written into, read back as jobs."""
    sql_names.register(spark, names=("jobs",))
    return spark.sql(
        """WITH k AS (SELECT *, p_brand || '-' || p_partkey DIV 1000 AS board, CASE WHEN p_partkey % 2 = 0 THEN 'lever' ELSE 'greenhouse' END AS platform FROM {part}),
        l AS (SELECT platform, board, to_json(transform(array_sort(collect_list(struct(p_partkey, p_name, p_type, p_size))), x -> named_struct('id', 'j' || x.p_partkey, 'text', x.p_name,
                'categories', named_struct('team', x.p_type), 'workplaceType', CASE WHEN x.p_size > 25 THEN 'remote' END, 'createdAt', 1500000000000 + x.p_partkey * 1000))) AS body
            FROM k WHERE platform = 'lever' GROUP BY platform, board),
        g AS (SELECT platform, board, to_json(named_struct('jobs', transform(array_sort(collect_list(struct(p_partkey, p_name, p_type))), x -> named_struct('id', x.p_partkey, 'title', x.p_name,
                'absolute_url', 'https://j/' || x.p_partkey, 'location', named_struct('name', x.p_type))))) AS body FROM k WHERE platform = 'greenhouse' GROUP BY platform, board)
        SELECT b.platform, b.board, j.ord, j.job_count, j.truncated, j.id, j.title, j.url, j.location, j.team, j.workplace_type, j.published_at
        FROM (SELECT * FROM l UNION ALL SELECT * FROM g) b, LATERAL jobs(b.platform, b.body) j""",
        part=table(spark, sf_dir, "part"),
    )


def sql_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on orders that stand for fetched pages."""
    sql_names.register(spark, names=("classify",))
    return spark.sql(
        """SELECT o_orderkey, c.accessible, c.gated, c.reason, c.quality, c.status, c.has_content, c.truncation
        FROM (SELECT o_orderkey, classify(CASE o_orderstatus WHEN 'F' THEN '1' WHEN 'O' THEN 'render-blocked' ELSE 'error' END, CASE WHEN o_custkey % 7 = 0 THEN 404 WHEN o_custkey % 11 = 0 THEN 503 ELSE 200 END,
            CASE WHEN o_orderkey % 5 = 0 THEN '  ' WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_orderpriority END, CAST(o_totalprice AS BIGINT), o_orderkey % 3 = 0,
            CASE WHEN o_custkey % 4 = 0 THEN array(named_struct('code', 'max_bytes', 'message', 'm')) ELSE array() END) AS c FROM {orders})""",
        orders=spread(spark, sf_dir, "orders"),
    )


ORDER = {
    "type": "object", "required": ["key", "line"], "additionalProperties": False,
    "properties": {
        "key": {"type": "integer", "multipleOf": 2}, "price": {"type": "number", "minimum": 1000, "exclusiveMaximum": 200000},
        "line": {"type": "array", "maxItems": 3, "uniqueItems": True, "items": {"oneOf": [{"type": "integer", "maximum": 3}, {"type": "integer", "minimum": 3}]}},
        "status": {"allOf": [{"type": "string"}, {"enum": ["F", "O"]}]}, "nested": {"const": {"a": [1.0, {"b": 2}]}},
    },
}


def sql_validate_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as JSON against a schema with composites, unique items and a nested constant."""
    sql_names.register(spark, {"order": ORDER}, names=("validate_json",))
    return spark.sql(
        """SELECT o_orderkey, v.valid, v.message FROM (SELECT o_orderkey, validate_json('order', '{{"key": ' || o_orderkey || ', "price": ' || CAST(o_totalprice AS DECIMAL(12, 2)) || ', "line": ['
            || o_orderkey % 5 || ', ' || o_custkey % 5 || '.0], "status": "' || o_orderstatus || '", "nested": {{"a": [' || o_custkey % 2 || ', {{"b": 2.0}}]}}}}') AS v FROM {orders})""",
        orders=spread(spark, sf_dir, "orders"),
    )


QUERIES = {
    "sql_html_tags": sql_html_tags, "sql_json_ld_nodes": sql_json_ld_nodes, "sql_jobs": sql_jobs, "sql_classify": sql_classify, "sql_validate_json": sql_validate_json,
}

SQL = {
    # the stored pages have no markup inside scripts, styles and comments
    "sql_html_tags": r"""WITH t AS (SELECT page_id, unnest(regexp_extract_all(html, '<[a-z][a-z0-9]*(?:\s[^>]*)?>')) AS tag, unnest(range(len(regexp_extract_all(html, '<[a-z][a-z0-9]*(?:\s[^>]*)?>')))) AS k FROM pages)
        SELECT page_id, regexp_extract(tag, '<([a-z0-9]+)', 1) AS name, count(*) AS n, CAST(sum(len(regexp_extract_all(tag, '\s[a-z]+='))) AS BIGINT) AS n_attributes,
            min(nullif(replace(regexp_extract(tag, 'href="([^"]*)"', 1), '&amp;', '&'), '')) AS least_href, CAST(max(k) AS INTEGER) AS last_position FROM t GROUP BY page_id, name""",
    "sql_json_ld_nodes": """WITH n AS (SELECT *, CAST(unnest(range(8)) AS INTEGER) AS k FROM part)
        SELECT p_partkey, CAST(k // 7 AS INTEGER) AS script, (['$', '$.offers[0][0]', '$.about', '$.about.hasPart', '$.about.hasPart.subject', '$.about.hasPart.subject.mainEntity',
            '$.about.hasPart.subject.mainEntity.about', '$[0][0][1]'])[k + 1] AS path, CAST(([0, 1, 1, 2, 3, 4, 5, 0])[k + 1] AS INTEGER) AS depth,
            CASE k WHEN 0 THEN 'Product' WHEN 1 THEN 'Offer,' || p_brand WHEN 6 THEN p_type ELSE '' END AS types, CASE k WHEN 0 THEN 'p' || p_partkey END AS id,
            CASE k WHEN 0 THEN p_name WHEN 1 THEN CAST(p_retailprice AS VARCHAR) WHEN 7 THEN p_type END AS name FROM n""",
    "sql_jobs": """WITH k AS (SELECT *, p_brand || '-' || p_partkey // 1000 AS board, CASE WHEN p_partkey % 2 = 0 THEN 'lever' ELSE 'greenhouse' END AS platform FROM part),
        r AS (SELECT *, row_number() OVER (PARTITION BY platform, board ORDER BY p_partkey) - 1 AS ord, count(*) OVER (PARTITION BY platform, board) AS job_count FROM k)
        SELECT platform, board, ord, job_count, job_count > 500 AS truncated, CASE platform WHEN 'lever' THEN 'j' ELSE '' END || p_partkey AS id, p_name AS title,
            CASE platform WHEN 'lever' THEN '' ELSE 'https://j/' || p_partkey END AS url, CASE platform WHEN 'greenhouse' THEN p_type END AS location, CASE platform WHEN 'lever' THEN p_type END AS team,
            CASE WHEN platform = 'lever' AND p_size > 25 THEN 'remote' END AS workplace_type,
            CASE platform WHEN 'lever' THEN strftime(make_timestamp(1500000000000000 + p_partkey * 1000000), '%Y-%m-%dT%H:%M:%S.000Z') END AS published_at FROM r WHERE ord < 500""",
    "sql_classify": """WITH p AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN '1' WHEN 'O' THEN 'render-blocked' ELSE 'error' END AS tier,
            CASE WHEN o_custkey % 7 = 0 THEN 404 WHEN o_custkey % 11 = 0 THEN 503 ELSE 200 END AS status, o_orderkey % 5 <> 0 AND o_orderkey % 13 <> 0 AS said, o_orderkey % 3 = 0 AS js, o_custkey % 4 = 0 AS cut, CAST(trunc(o_totalprice) AS BIGINT) AS o_totalprice_ FROM orders),
        q AS (SELECT *, tier = '1' AND said AS content, CASE WHEN tier <> 'error' AND cut THEN 'max_bytes' END AS truncation FROM p),
        r AS (SELECT *, CASE WHEN status >= 400 THEN 'http_error' WHEN truncation IS NOT NULL THEN 'byte_cap' WHEN NOT content AND (tier = 'render-blocked' OR js) THEN 'js-required' ELSE 'none' END AS reason FROM q)
        SELECT o_orderkey, reason <> 'http_error' AND content AS accessible, reason <> 'none' AS gated, reason, CASE WHEN tier = '1' AND status < 400 AND o_totalprice_ >= 100000 THEN 'low_value' END AS quality,
            CASE WHEN tier = 'error' OR status >= 400 OR NOT content THEN 'fail' WHEN cut THEN 'partial' ELSE 'pass' END AS status, content AS has_content, truncation FROM r""",
    "sql_validate_json": """WITH p AS (SELECT *, o_orderkey % 5 AS a, o_custkey % 5 AS b FROM orders),
        m AS (SELECT o_orderkey, CASE WHEN o_orderkey % 2 <> 0 THEN '$.key must be a multiple of 2' WHEN o_totalprice < 1000 THEN '$.price must be >= 1000' WHEN o_totalprice >= 200000 THEN '$.price must be < 200000'
            WHEN a = b THEN '$.line items must be unique' WHEN a = 3 THEN '$.line[0] must match exactly one oneOf schema' WHEN b = 3 THEN '$.line[1] must match exactly one oneOf schema'
            WHEN o_orderstatus NOT IN ('F', 'O') THEN '$.status must be one of schema enum values' WHEN o_custkey % 2 <> 1 THEN '$.nested must equal schema const' END AS message FROM p)
        SELECT o_orderkey, message IS NULL AS valid, message FROM m""",
}
