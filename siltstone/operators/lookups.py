"""Lookups against small rule tables: trackers, public suffixes, address ranges, models, profiles.

Rule tables are parameters with a stated size bound (``MAX_RULES``); within it they are broadcast, beyond
it they are joined by shuffle. Big sides are never collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions import urls, weburl

MAX_RULES = 100_000
MAX_HOST = 253

# Registrable domains of advertising, analytics and tracking services.
TRACKERS = """
2mdn.net 3lift.com aaxads.com adform.net admob.com adnxs.com adsafeprotected.com adsrvr.org adroll.com amazon-adsystem.com bidr.io bidswitch.net
bidvertiser.com casalemedia.com connatix.com contextweb.com criteo.com criteo.net doubleclick.net exoclick.com googleadservices.com
googlesyndication.com googletagservices.com indexexchange.com lijit.com media.net mgid.com moatads.com nativo.com openx.net popcash.net
propellerads.com pubmatic.com revcontent.com rtmark.net rubiconproject.com serving-sys.com sharethrough.com smartadserver.com sonobi.com sovrn.com
taboola.com triplelift.com yieldmo.com zergnet.com content.ad outbrain.com amplitude.com atinternet.com chartbeat.com chartbeat.net clarity.ms
clicktale.com contentsquare.net crazyegg.com fullstory.com google-analytics.com googletagmanager.com heapanalytics.com hotjar.com luckyorange.com
matomo.cloud mixpanel.com mouseflow.com mparticle.com mxpnl.com omniture.com omtrdc.net 2o7.net parsely.com segment.io smartlook.com
snowplowanalytics.com statcounter.com tealiumiq.com adsymptotic.com facebook.net analytics.yahoo.com adscore.com appsflyer.com bkrtx.com
bluecava.com bluekai.com branch.io cr-nielsen.com cxense.com demdex.net doubleverify.com eyeota.net gemius.pl imrworldwide.com krxd.net liadm.com
quantcount.com quantserve.com rlcdn.com scorecardresearch.com tapad.com w55c.net addthis.com sumome.com
""".split()
#: Public suffixes by default: a small, documented set. A full list is passed as ``rules``; ``*.`` is a
#: wildcard label and ``!`` an exception.
SUFFIXES = """
com net org edu gov mil int io co dev app info biz me tv ai uk co.uk org.uk ac.uk gov.uk au com.au net.au org.au de fr es it nl se no fi dk pl cz
at ch be eu us ca jp co.jp ne.jp kr co.kr cn com.cn in co.in br com.br mx com.mx nz co.nz za co.za ru *.ck !www.ck github.io gitlab.io
herokuapp.com vercel.app netlify.app pages.dev web.app blogspot.com cloudfront.net s3.amazonaws.com
""".split()


def small(df: DataFrame, limit: int = MAX_RULES) -> DataFrame:
    """A rule table, marked for broadcast if it has at most ``limit`` rows (counted, a bounded read)."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def suffixes(host: Column) -> Column:
    """A host and its parents, longest first: array of 'a.b.c', 'b.c', 'c'."""
    labels = F.split(F.regexp_replace(F.lower(host), r"\.$", ""), r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def is_tracker(host: Column, listed: list[str] = TRACKERS) -> Column:
    """Whether a host or one of its parents is listed; hosts of over 253 characters are not. Stays in generated code."""
    return F.when(F.length(host) <= MAX_HOST, F.arrays_overlap(suffixes(host), F.array(*[F.lit(t) for t in listed]))).otherwise(False)


def tracker_join(df: DataFrame, host_col: str, trackers: DataFrame, keep: bool = False) -> DataFrame:
    """Rows whose host is (``keep``) or is not under a domain of ``trackers`` (domain), by an equi-join of suffixes.

    ``trackers`` may be a table of any size. Rows are told apart by a key made of their host, so each host
    is looked up once and rows keep their number.
    """
    hosts = df.select(F.col(host_col).alias("__h")).distinct().where("__h is not null")
    parents = hosts.where(F.length("__h") <= MAX_HOST).select("__h", F.explode(suffixes(F.col("__h"))).alias("domain"))
    found = parents.join(small(trackers.select("domain").distinct()), "domain").select("__h").distinct()
    return df.join(found, F.col(host_col) == F.col("__h"), "left_semi" if keep else "left_anti")


def suffix_rules(spark, rules: list[str] = SUFFIXES) -> DataFrame:
    """(suffix, labels, kind) of public-suffix rules."""
    rows = []
    for rule in rules:
        kind = "exception" if rule.startswith("!") else "wildcard" if rule.startswith("*.") else "exact"
        name = rule.lstrip("!").removeprefix("*.")
        rows.append((name, name.count(".") + 1, kind))
    return spark.createDataFrame(rows, "suffix string, labels int, kind string")


def read_suffix_list(spark, path: str, private: bool = True) -> DataFrame:
    """Rules (suffix, labels, kind) of a public-suffix list in its published format, names beyond ASCII in their ASCII form.

    ``//`` begins a comment line, a rule ends at the first white space, and rules after the mark of the private section are left out unless ``private``. The list is one file of
    some 300 KB, read as one row.
    """
    whole = F.regexp_replace("value", "\\A\ufeff", "")
    lines = F.split(whole if private else F.regexp_replace(whole, r"(?s)===BEGIN PRIVATE DOMAINS===.*?(?:===END PRIVATE DOMAINS===|\z)", ""), "\n")
    rule = spark.read.text(path, wholetext=True).select(F.explode(lines).alias("line")).select(F.regexp_extract("line", r"^\s*(\S*)", 1).alias("rule")).where("rule != '' and rule not like '//%'")
    kind = F.when(F.col("rule").startswith("!"), "exception").when(F.col("rule").startswith("*."), "wildcard").otherwise("exact")
    name = weburl.ascii_host(F.regexp_replace("rule", r"^(?:!|\*\.)|\.$", ""))
    return rule.select(name.alias("suffix"), kind.alias("kind")).distinct().select("suffix", F.size(F.split("suffix", r"\.")).alias("labels"), "kind")


def registrable_domains(df: DataFrame, host_col: str, rules: DataFrame | None = None, name: str = "domain", unlisted: bool = False) -> DataFrame:
    """``df`` with each host's registrable domain: its public suffix and one label more.

    The longest matching rule wins, exceptions before all; null for an address literal, a single label, a
    public suffix itself and an unknown suffix, which with ``unlisted`` is its last label. Hosts are looked up once each, in their ASCII form, by one equality
    join of their parents with the rules, of which there may be any number.
    """
    rules = rules if rules is not None else suffix_rules(df.sparkSession)
    hosts = df.select(F.col(host_col).alias("__o")).distinct().withColumn("__h", weburl.ascii_host(F.regexp_replace("__o", r"\.$", "")))
    hosts = hosts.where((urls.ip_version(F.col("__h")) == 0) & F.col("__h").contains(".") & (F.length("__h") <= MAX_HOST) & ~F.col("__h").rlike(r"^\.|\.\.|\.$"))
    parents = hosts.select("__o", "__h", F.posexplode(suffixes(F.col("__h"))).alias("__k", "suffix"))
    hits = parents.join(small(rules), "suffix")
    # labels of the public suffix: a wildcard takes one more, an exception one less
    span = F.col("labels") + F.when(F.col("kind") == "wildcard", 1).when(F.col("kind") == "exception", -1).otherwise(0)
    best = hits.groupBy("__o", "__h").agg(F.max_by(span, F.struct((F.col("kind") == "exception").cast("int"), span)).alias("__s"))
    if unlisted:
        rest = hosts.join(best.select("__o"), "__o", "left_anti").where(~F.col("__h").endswith(".local"))
        best = best.unionByName(rest.withColumn("__s", F.lit(1)))
    labels = F.split("__h", r"\.")
    known = best.where(F.size(labels) > F.col("__s")).select("__o", F.array_join(F.slice(labels, F.size(labels) - F.col("__s"), F.col("__s") + 1), ".").alias(name))
    return df.drop(name).join(known, F.col(host_col) == F.col("__o"), "left").drop("__o")


def host_key(domain: Column, host: Column, url: Column) -> Column:
    """Key by which egress is counted: the registrable domain, else the host, else the address itself."""
    return F.coalesce(domain, F.nullif(host, F.lit("")), url)


def address_ranges(spark, blocks: list[str] = urls.PRIVATE_V4) -> DataFrame:
    """(cidr, low, high) of IPv4 blocks."""
    import ipaddress

    nets = [ipaddress.ip_network(b) for b in blocks]
    return spark.createDataFrame([(str(n), int(n.network_address), int(n.broadcast_address)) for n in nets], "cidr string, low long, high long")


def _bits(digits: Column) -> Column:
    """Hexadecimal digits, in eights, as a text of zeros and ones, of which every prefix is a substring."""
    eights = F.regexp_extract_all(digits, F.lit("(.{8})"), F.lit(1))
    return F.when(digits.isNotNull(), F.array_join(F.transform(eights, lambda x: F.lpad(F.conv(x, 16, 2), 32, "0")), ""))


def _in_blocks(df: DataFrame, address_col: str, digits: Column, ranges: DataFrame, low: Column) -> DataFrame:
    """Rows joined with the blocks that hold their address, by equality of (prefix length, prefix).

    An address is looked up under every length that the blocks have (at most 33, or 129), so a block is one row whatever its size. Lengths with few
    blocks, in all at most ``MAX_RULES``, are broadcast: the shortest are among them, whose blocks hold so many addresses that one task would get them all, and nearly
    all hits are theirs. The others are hashed by shuffle, with each distinct address once; memory holds blocks only, never addresses.
    """
    bits = F.split_part("cidr", F.lit("/"), F.lit(2)).cast("int")
    blocks = ranges.select("cidr", bits.alias("__bits"), F.substring(_bits(low), F.lit(1), bits).alias("__prefix")).distinct()
    few, many, total = [], [], 0
    for n, count in sorted((tuple(r) for r in blocks.where("__bits is not null").groupBy("__bits").count().collect()), key=lambda r: r[0]):  # at most 129 rows
        (few if total + count <= MAX_RULES else many).append(n)
        total += count if few and few[-1] == n else 0
    def under(rows: DataFrame, lengths: list[int], join: str) -> DataFrame:
        known = rows.withColumn("__p", _bits(digits)).where("__p is not null")
        keyed = known.withColumn("__bits", F.explode(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"))).withColumn("__prefix", F.substring("__p", F.lit(1), F.col("__bits")))
        return keyed.join(blocks.where(F.col("__bits").isin(*lengths)).hint(join), ["__bits", "__prefix"]).drop("__bits", "__prefix", "__p")

    found = under(df.withColumn("__a", F.col(address_col)), few, "broadcast").drop("__a").select(*df.columns, "cidr")
    if many:
        hits = under(df.select(F.col(address_col).alias("__a")).distinct(), many, "shuffle_hash")
        found = found.unionByName(df.join(hits, F.col(address_col) == F.col("__a")).select(*df.columns, "cidr"))
    return found


def in_ranges(df: DataFrame, address_col: str, ranges: DataFrame) -> DataFrame:
    """Rows of ``df`` joined with the ranges (cidr, low, high) that hold their IPv4 address: one equality join."""
    eight = lambda n: F.lpad(F.lower(F.hex(n)), 8, "0")
    return _in_blocks(df, address_col, eight(urls.v4_number(F.col("__a"))), ranges, eight(F.col("low")))


def address_ranges_v6(spark, blocks: list[str] = urls.PRIVATE_V6) -> DataFrame:
    """(cidr, low, high) of IPv6 blocks; ends as 32 hexadecimal digits."""
    import ipaddress

    nets = [(b, ipaddress.ip_network(b)) for b in blocks]
    return spark.createDataFrame([(b, f"{int(n.network_address):032x}", f"{int(n.broadcast_address):032x}") for b, n in nets], "cidr string, low string, high string")


def in_ranges_v6(df: DataFrame, address_col: str, ranges: DataFrame) -> DataFrame:
    """Rows of ``df`` joined with the ranges that hold their IPv6 address: one equality join, as ``in_ranges``."""
    return _in_blocks(df, address_col, urls.v6_hex(F.col("__a")), ranges, F.col("low"))


def with_default(df: DataFrame, key: str, profiles: DataFrame, value: str, default: str) -> DataFrame:
    """Equi lookup of ``profiles`` (key, value) with a default."""
    found = small(profiles.groupBy(key).agg(F.max(value).alias(value)))
    return df.join(found, key, "left").withColumn(value, F.coalesce(value, F.lit(default)))


def profile_map(text: Column, names: list[str]) -> Column:
    """``id=profile,...`` as a map; entries without an id or with an unknown profile are dropped."""
    pairs = F.transform(F.split(text, ","), lambda p: F.transform(F.split(p, "=", 2), lambda x: F.trim(x)))
    valid = F.filter(pairs, lambda p: (F.size(p) == 2) & (F.get(p, F.lit(0)) != "") & F.get(p, F.lit(1)).isin(*names))
    entries = F.transform(valid, lambda p: F.struct(F.get(p, F.lit(0)).alias("key"), F.get(p, F.lit(1)).alias("value")))
    last = lambda k: F.element_at(F.filter(entries, lambda e: e["key"] == k), -1)["value"]
    keys = F.array_distinct(F.transform(entries, lambda e: e["key"]))
    return F.map_from_arrays(keys, F.transform(keys, last))
