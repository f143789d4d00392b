"""Queries over addresses and hosts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import urls, weburl
from siltstone.operators import lookups, shaping

from .tables import spread, table

# Listed domains that occur among the stored hosts, as a replaceable rule table for the queries.
LISTED = ("thther.example.com", "thth.example.net", "ththth.example.net", "ththis.example.org", "tionsh.example.net")


def _hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("ord"), "url")
    keyed = pages.select("ord", urls.canonical(F.col("url")).alias("url"), urls.host(F.col("url")).alias("host"))
    return lookups.registrable_domains(keyed, "host").withColumn("key", lookups.host_key(F.col("domain"), F.col("host"), F.col("url")))


def url_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    return table(spark, sf_dir, "pages").select(
        "page_id", urls.canonical(u).alias("canonical"), urls.host(u).alias("host"), urls.public_address(u).alias("public"),
        F.coalesce(urls.bulk_url_error(u), F.lit("ok")).alias("verdict"), urls.blocked_port(u).alias("blocked"), urls.is_pin_page(u).alias("pin"),
    )


def url_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The input ladder over odd addresses made from ids."""
    forms = [
        "https://example.com/a", "ftp://example.com/a", "http://u:p@example.com/a", "nonsense", "https://example.com/%0d%0aX", "http://example.com:8080/",
        "http://example.com:22/", "HTTP://EXAMPLE.com", "https:///", "http://127.0.0.1/",
    ]
    form = F.element_at(F.array(*[F.lit(f) for f in forms]), (F.pmod("doc_id", F.lit(len(forms))) + 1).cast("int"))
    rows = table(spark, sf_dir, "documents").select("doc_id", form.alias("u"))
    return rows.select(
        "doc_id", F.coalesce(urls.url_error(F.col("u")), F.lit("ok")).alias("verdict"), urls.blocked_port(F.col("u")).alias("blocked"),
        F.coalesce(urls.internal_reason(F.col("u")), F.lit("public")).alias("internal"), urls.without_userinfo(F.col("u")).alias("shown"),
    )


def url_dedupe_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shaping.first_occurrences(_hosts(spark, sf_dir).select("ord", "url"), "url")


def host_top_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shaping.top_per_key(_hosts(spark, sf_dir).select("ord", "host", "url"), "host", 3)


def host_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shaping.cut_per_key(_hosts(spark, sf_dir), "host", 3).select("host", "kept", "dropped")


def registrable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hosts(spark, sf_dir).groupBy("host", "domain").agg(F.count("*").alias("pages"))


def bulk_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shaping.shape(_hosts(spark, sf_dir).select("ord", "url", "host"), "url", "host", 2, 50)


def bulk_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shaping.disclosure(_hosts(spark, sf_dir), "url", "host", 2, 50)


def tracker_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = spark.createDataFrame([(x,) for x in LISTED], "domain string")
    rows = _hosts(spark, sf_dir).select("ord", "host")
    return lookups.tracker_join(rows, "host", listed, keep=True)


def tracker_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listed trackers, their subdomains and look-alikes, made from ids."""
    forms = ["doubleclick.net", "stats.g.doubleclick.net", "notdoubleclick.net", "hotjar.com.", "example.com", "com"]
    form = F.element_at(F.array(*[F.lit(f) for f in forms]), (F.pmod("doc_id", F.lit(len(forms))) + 1).cast("int"))
    rows = table(spark, sf_dir, "documents").select("doc_id", form.alias("h"))
    return rows.select("doc_id", lookups.is_tracker(F.col("h")).alias("tracker"), urls.is_first_party(F.col("h"), F.lit("g.doubleclick.net")).alias("first_party"))


def ipv4_private(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"\b((?:[0-9]{1,3}\.){3}[0-9]{1,3})\b"), F.lit(1))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array_distinct(found)).alias("ip"))
    return rows.select("doc_id", "ip", urls.ip_version(F.col("ip")).cast("long").alias("version"), urls.is_private(F.col("ip")).alias("is_private"))


def ipv4_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses made from orders, joined with the ranges that hold them."""
    k = F.col("o_orderkey")
    octets = [F.pmod(k * 7, F.lit(256)), F.pmod(k * 31, F.lit(256)), F.pmod(k, F.lit(256)), F.pmod(k * 3, F.lit(256))]
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.concat_ws(".", *[o.cast("string") for o in octets]).alias("ip"))
    return lookups.in_ranges(rows, "ip", lookups.address_ranges(spark)).select("o_orderkey", "ip", "cidr")


def url_standard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses in the forms that only the URL standard reads alike: numbers as hosts, dot segments, ports, percent-encoding, names beyond ASCII."""
    v = F.expr("(o_orderkey * 2654435761L) % 4294967296L")
    key, lit = F.col("o_orderkey").cast("string"), F.lit
    forms = [
        F.concat(lit("http://0x"), F.hex(v), lit("/")), F.concat(lit("http://0"), F.conv(v.cast("string"), 10, 8)),
        F.concat(lit("https://"), F.shiftright(v, 24).cast("string"), lit("."), v.bitwiseAND(0xFFFFFF).cast("string"), lit("/a")),
        F.concat(lit(" HTTP:\\\\EXAMPLE.com:080/"), key, lit("/./b/../%2e%2E/"), key, lit("/c/..?q='"), key, lit("' é#f")), F.concat(lit("http://256.1.1."), key, lit("/")),
        F.concat(lit("http://bü"), key, lit(".example/é/"), key), F.concat(lit("https://u:p@h.example/"), key), F.concat(lit("https://h.example:"), key, lit("00/x")),
    ]
    url = F.element_at(F.array(*forms), (F.col("o_orderkey") % len(forms) + 1).cast("int"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", url.alias("url"))
    return rows.select("o_orderkey", weburl.parsed(F.col("url")).alias("p"), weburl.address_error(F.col("url")).alias("error")).select("o_orderkey", weburl.shown(F.col("p")).alias("href"), "error")


def suffix_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registrable domains of hosts made of orders under rules made of parts: exact, wildcard and exception rules, names beyond ASCII."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("k"), (F.col("p_partkey") % 4).alias("f"))
    name = F.element_at(F.array(F.concat(F.lit("e"), "k"), F.concat(F.lit("co.e"), "k"), F.concat(F.lit("w"), "k"), F.concat(F.lit("bü"), "k")), F.col("f").cast("int") + 1)
    rules = part.select(weburl.ascii_host(name).alias("suffix"), F.when(F.col("f") == 2, "wildcard").otherwise("exact").alias("kind"))
    rules = rules.unionByName(part.where("f = 2").select(F.concat(F.lit("city.w"), "k").alias("suffix"), F.lit("exception").alias("kind")))
    rules = rules.withColumn("labels", F.size(F.split("suffix", r"\.")))
    o, n = F.col("o_orderkey"), table(spark, sf_dir, "part").count()
    key = (o % n).cast("string")
    form = F.element_at(F.array(*[F.concat(F.lit(a), key, F.lit(b)) for a, b in (("a.b.e", ""), ("x.co.e", "."), ("a.b.c.W", ""), ("x.city.w", ""), ("a.BÜ", ""), ("none", ""))]), (F.col("o_custkey") % 6 + 1).cast("int"))
    hosts = table(spark, sf_dir, "orders").select("o_orderkey", form.alias("host"))
    return lookups.registrable_domains(hosts, "host", rules).select("o_orderkey", "domain")


def address_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses made of orders and the blocks, from /0 to /32 and made of parts, that hold them."""
    o, p = F.col("o_orderkey"), F.col("p_partkey")
    number = (o * 2654435761) % 4294967296
    dotted = lambda v: F.concat_ws(".", *[F.shiftright(v, s).bitwiseAND(255).cast("string") for s in (24, 16, 8, 0)])
    bits = (p % 33).cast("int")
    size = F.element_at(F.array(*[F.lit(1 << (32 - n)) for n in range(33)]), bits + 1)
    low = F.floor(((p * 40503 * 65537) % 4294967296) / size).cast("long") * size
    blocks = table(spark, sf_dir, "part").select(F.concat(dotted(low), F.lit("/"), bits.cast("string")).alias("cidr"), low.alias("low"), (low + size - 1).alias("high")).distinct()
    rows = spread(spark, sf_dir, "orders").select("o_orderkey", dotted(number).alias("address"))
    found = lookups.in_ranges(rows, "address", blocks).groupBy("o_orderkey").agg(F.count("*").alias("n_blocks"), F.max(F.split_part("cidr", F.lit("/"), F.lit(2)).cast("int")).alias("longest"))
    return found


QUERIES = {
    "suffix_table": suffix_table, "address_blocks": address_blocks,
    "url_standard": url_standard,
    "url_normalized": url_normalized, "url_verdicts": url_verdicts, "url_dedupe_first": url_dedupe_first, "host_top_n": host_top_n, "host_cut": host_cut,
    "registrable_domains": registrable, "bulk_shape": bulk_shape, "bulk_disclosure": bulk_disclosure, "tracker_filter": tracker_filter,
    "tracker_flags": tracker_flags, "ipv4_private": ipv4_private, "ipv4_ranges": ipv4_ranges,
}

_RANGES = ", ".join(f"('{b}')" for b in urls.PRIVATE_V4)
_NET = f"""r AS (SELECT cidr, CAST(split_part(cidr, '/', 2) AS INTEGER) AS bits,
    list_reduce(list_transform(string_split(split_part(cidr, '/', 1), '.'), lambda x: CAST(x AS BIGINT)), lambda a, b: a * 256 + b) AS low FROM (VALUES {_RANGES}) v(cidr)),
ranges AS (SELECT cidr, low, low + (CAST(1 AS BIGINT) << (32 - bits)) - 1 AS high FROM r)"""
_H = r"""h AS (SELECT page_id AS ord, regexp_replace(regexp_replace(url, '^http:', 'https:'), '#.*$', '') AS url,
    lower(regexp_extract(url, '^https?://([^/?#:]*)', 1)) AS host FROM pages)"""
_FIRST = "f AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY url ORDER BY ord) = 1)"

SQL = {
    "suffix_table": """WITH p AS (SELECT *, o_orderkey % (SELECT count(*) FROM part) AS k, o_custkey % 6 AS f FROM orders), q AS (SELECT *, k % 4 AS r, 124 * (2 + length(CAST(k AS VARCHAR))) + 1 AS delta,
            'abcdefghijklmnopqrstuvwxyz0123456789' AS d FROM p),
        x AS (SELECT *, 'xn--b' || k || '-' || substr(d, CAST(2 + (delta - 1) % 35 AS BIGINT), 1) || CASE WHEN (delta - 1) // 35 < 1 THEN substr(d, CAST((delta - 1) // 35 + 1 AS BIGINT), 1)
            ELSE substr(d, CAST(2 + ((delta - 1) // 35 - 1) % 35 AS BIGINT), 1) || substr(d, CAST(((delta - 1) // 35 - 1) // 35 + 1 AS BIGINT), 1) END AS label FROM q WHERE true)
        SELECT o_orderkey, CASE WHEN EXISTS (SELECT 1 FROM part WHERE p_partkey = k) THEN CASE WHEN f = 0 AND r = 0 THEN 'b.e' || k WHEN f = 1 AND r = 0 THEN 'co.e' || k WHEN f = 1 AND r = 1 THEN 'x.co.e' || k WHEN f = 2 AND r = 2 THEN 'b.c.w' || k
            WHEN f = 3 AND r = 2 THEN 'city.w' || k WHEN f = 4 AND r = 3 THEN 'a.' || label END END AS domain FROM x""",
    "address_blocks": """WITH b AS (SELECT DISTINCT ((p_partkey * 40503 * 65537) % 4294967296) >> (32 - p_partkey % 33) AS prefix, p_partkey % 33 AS bits FROM part),
        l AS (SELECT DISTINCT bits FROM b)
        SELECT o_orderkey, count(*) AS n_blocks, CAST(max(bits) AS INTEGER) AS longest FROM orders, l JOIN b USING (bits) WHERE ((o_orderkey * 2654435761) % 4294967296) >> (32 - bits) = prefix GROUP BY o_orderkey""",
    "url_standard": r"""WITH v AS (SELECT *, (o_orderkey * 2654435761) % 4294967296 AS v, CAST(o_orderkey AS VARCHAR) AS k, o_orderkey % 8 AS f, 124 * (2 + length(CAST(o_orderkey AS VARCHAR))) + 1 AS delta FROM orders),
        w AS (SELECT *, (v >> 24) || '.' || ((v >> 16) & 255) || '.' || ((v >> 8) & 255) || '.' || (v & 255) AS ip, (delta - 1) // 35 AS q, 'abcdefghijklmnopqrstuvwxyz0123456789' AS d FROM v),
        x AS (SELECT *, 'xn--b' || k || '-' || substr(d, CAST(2 + (delta - 1) % 35 AS BIGINT), 1) || CASE WHEN q < 1 THEN substr(d, CAST(q + 1 AS BIGINT), 1)
            ELSE substr(d, CAST(2 + (q - 1) % 35 AS BIGINT), 1) || substr(d, CAST((q - 1) // 35 + 1 AS BIGINT), 1) END AS label FROM w)
        SELECT o_orderkey, CASE f WHEN 0 THEN 'http://' || ip || '/' WHEN 1 THEN 'http://' || ip || '/' WHEN 2 THEN 'https://' || ip || '/a' WHEN 3 THEN 'http://example.com/' || k || '/?q=%27' || k || '%27%20%C3%A9'
            WHEN 5 THEN 'http://' || label || '.example/%C3%A9/' || k WHEN 6 THEN 'https://h.example/' || k WHEN 7 THEN CASE WHEN o_orderkey <= 655 THEN 'https://h.example:' || k || '00/x' END END AS href,
            CASE WHEN f = 4 OR (f = 7 AND o_orderkey > 655) THEN 'invalid_url' WHEN f = 6 THEN 'userinfo_url' END AS error FROM x""",
    "url_normalized": r"""SELECT page_id, regexp_replace(regexp_replace(url, '^http:', 'https:'), '#.*$', '') AS canonical, lower(regexp_extract(url, '^https?://([^/?#:]*)', 1)) AS host,
        regexp_replace(url, '[?#].*$', '') AS public, CASE WHEN length(url) > 2048 THEN 'url_too_long' ELSE 'ok' END AS verdict, false AS blocked, false AS pin FROM pages""",
    "url_verdicts": """SELECT doc_id, CASE doc_id % 10 WHEN 1 THEN 'unsupported_scheme' WHEN 2 THEN 'userinfo_url' WHEN 3 THEN 'invalid_url' WHEN 4 THEN 'crlf_url' WHEN 8 THEN 'invalid_url' ELSE 'ok' END AS verdict,
        doc_id % 10 = 6 AS blocked, CASE WHEN doc_id % 10 = 9 THEN 'internal_host' ELSE 'public' END AS internal,
        (['https://example.com/a', 'ftp://example.com/a', 'http://example.com/a', 'nonsense', 'https://example.com/%0d%0aX', 'http://example.com:8080/',
          'http://example.com:22/', 'HTTP://EXAMPLE.com', 'https:///', 'http://127.0.0.1/'])[doc_id % 10 + 1] AS shown FROM documents""",
    "url_dedupe_first": f"WITH {_H}, {_FIRST} SELECT ord, url FROM f",
    "host_top_n": f"WITH {_H} SELECT ord, host, url FROM h QUALIFY row_number() OVER (PARTITION BY host ORDER BY ord) <= 3",
    "host_cut": f"WITH {_H} SELECT host, CAST(3 AS BIGINT) AS kept, count(*) - 3 AS dropped FROM h GROUP BY host HAVING count(*) > 3",
    "registrable_domains": rf"WITH {_H} SELECT host, regexp_extract(host, '([^.]+\.[^.]+)$', 1) AS domain, count(*) AS pages FROM h GROUP BY ALL",
    "bulk_shape": f"""WITH {_H}, {_FIRST}, t AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY host ORDER BY ord) <= 2)
        SELECT ord, url, host FROM t ORDER BY ord LIMIT 50""",
    "bulk_disclosure": f"""WITH {_H}, {_FIRST}, c AS (SELECT host, count(*) AS n FROM f GROUP BY host)
        SELECT (SELECT count(*) FROM h) AS input_urls, CAST(sum(n) AS BIGINT) AS after_dedupe, CAST(sum(least(n, 2)) AS BIGINT) AS after_host_limit,
            CAST(least(sum(least(n, 2)), 50) AS BIGINT) AS processed, count(*) FILTER (n > 2) AS hosts_cut FROM c""",
    "tracker_filter": f"""WITH {_H} SELECT ord, host FROM h WHERE EXISTS (SELECT 1 FROM (VALUES {', '.join(f"('{x}')" for x in LISTED)}) v(d)
        WHERE host = d OR ends_with(host, '.' || d))""",
    "tracker_flags": """SELECT doc_id, doc_id % 6 IN (0, 1, 3) AS tracker, doc_id % 6 IN (0, 1) AS first_party FROM documents""",
    "ipv4_private": rf"""WITH {_NET},
        i AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '\b((?:[0-9]{{1,3}}\.){{3}}[0-9]{{1,3}})\b', 1)) AS ip FROM documents),
        n AS (SELECT doc_id, ip, CASE WHEN regexp_matches(ip, '^(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(\.(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){{3}}$')
            THEN list_reduce(list_transform(string_split(ip, '.'), lambda x: CAST(x AS BIGINT)), lambda a, b: a * 256 + b) END AS v FROM i)
        SELECT doc_id, ip, CAST(CASE WHEN v IS NULL THEN 0 ELSE 4 END AS BIGINT) AS version, EXISTS (SELECT 1 FROM ranges WHERE v BETWEEN low AND high) AS is_private FROM n""",
    "ipv4_ranges": f"""WITH {_NET}, n AS (SELECT o_orderkey, (o_orderkey * 7) % 256 AS a, (o_orderkey * 31) % 256 AS b, o_orderkey % 256 AS c, (o_orderkey * 3) % 256 AS d FROM orders)
        SELECT o_orderkey, concat_ws('.', a, b, c, d) AS ip, cidr FROM n JOIN ranges ON ((a * 256 + b) * 256 + c) * 256 + d BETWEEN low AND high""",
}
