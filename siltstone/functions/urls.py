"""URL parts, canonical forms, host predicates and credentials in URLs, as Column expressions.

A null URL is treated as the empty string, which is an invalid URL. Nothing here raises for odd input.
"""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column
from pyspark.sql import functions as F

from .core import let

# Ports of services that are not web servers.
BLOCKED_PORTS = (22, 25, 465, 587, 993, 995, 1433, 1521, 3306, 3389, 5432, 6379, 9200, 11211, 27017)
# Reserved and private IPv4 ranges.
PRIVATE_V4 = """
0.0.0.0/8 10.0.0.0/8 100.64.0.0/10 127.0.0.0/8 169.254.0.0/16 172.16.0.0/12 192.0.0.0/29 192.0.0.8/32 192.0.0.11/32 192.0.0.12/30
192.0.0.16/28 192.0.0.32/27 192.0.0.64/26 192.0.0.128/25 192.0.2.0/24 192.168.0.0/16 198.18.0.0/15 198.51.100.0/24 203.0.113.0/24
224.0.0.0/4 240.0.0.0/4
""".split()
# Reserved and private IPv6 ranges.
PRIVATE_V6 = """
::1/128 ::/128 ::/96 ::ffff:0:0/96 64:ff9b::/96 64:ff9b:1::/48 100::/64 2001::/32 2001:2::/48 2001:db8::/32 2002::/16 3fff::/20
fec0::/10 fe80::/10 fc00::/7 ff00::/8
""".split()
# Host suffixes of internal networks, and names of instance metadata services.
INTERNAL_SUFFIXES = (".local", ".internal", ".corp", ".intranet", ".localhost", ".priv")
METADATA_HOSTS = ("metadata.google.internal", "metadata.aws.internal")
# Query keys that carry a credential wherever they stand, and those that do on a source URL.
CREDENTIAL_KEYS = (
    "x-amz-credential", "x-amz-signature", "x-amz-security-token", "x-goog-signature", "sig", "signature", "q-signature", "access_token", "api_key",
)
SOURCE_KEYS = (*CREDENTIAL_KEYS, "token", "key", "auth", "expires")
LOOPBACK_KEYS = ("code", "refresh_token", "token", "key", "auth")
MAX_BULK_URL = 2048

_URL = r"^([A-Za-z][A-Za-z0-9+.\-]*):[/\\]*(?:([^/\\?#@]*)@)?(\[[^\]]*\]|[^/\\?#:]*)(?::([0-9]*))?([^?#]*)(\?[^#]*)?(#.*)?$"


def _clean(url: Column) -> Column:
    """Without the control characters and blanks at either end."""
    return F.regexp_replace(F.coalesce(url, F.lit("")), r"^[\x00-\x20]+|[\x00-\x20]+$", "")


def part(url: Column, name: str) -> Column:
    """scheme, userinfo, host, port, path, query (with ``?``) or fragment (with ``#``); '' where absent."""
    group = ("scheme", "userinfo", "host", "port", "path", "query", "fragment").index(name) + 1
    found = F.regexp_extract(_clean(url), _URL, group)
    return F.lower(found) if name in ("scheme", "host") else found


def host(url: Column) -> Column:
    return part(url, "host")


def bare_host(url: Column) -> Column:
    """The host without a trailing dot."""
    return F.regexp_replace(host(url), r"\.+$", "")


def canonical(url: Column, upgrade: bool = True) -> Column:
    """The canonical address by the URL standard, without fragment and user, ``https`` if ``upgrade``; what is no web address stays as it is."""
    from .weburl import href

    return F.coalesce(href(url, upgrade), _clean(url))


def url_error(url: Column) -> Column:
    """Why an input address is refused: crlf_url, invalid_url, unsupported_scheme, userinfo_url; null if accepted."""
    from .weburl import address_error

    return address_error(url)


def bulk_url_error(url: Column) -> Column:
    """The batch entry check: too long, then the same ladder."""
    return F.when(F.length(F.coalesce(url, F.lit(""))) > MAX_BULK_URL, "url_too_long").otherwise(url_error(url))


def redirect_error(base: Column, target: Column) -> Column:
    """``scheme_downgrade`` for a hop from https to http."""
    return F.when((part(base, "scheme") == "https") & (part(target, "scheme") == "http"), "scheme_downgrade")


def blocked_port(url: Column) -> Column:
    return F.coalesce(part(url, "port").try_cast("int").isin(*BLOCKED_PORTS), F.lit(False))


def without_userinfo(url: Column) -> Column:
    """For messages: leading controls and any user information removed."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(url, F.lit("")), r"^[\x00-\x20]+", ""), r"^([A-Za-z][A-Za-z0-9+.\-]*:)[/\\]*[^/\\?#@]*@", "$1//")


def public_address(url: Column) -> Column:
    """Scheme, host, port and path only."""
    port = F.when(part(url, "port") == "", "").otherwise(F.concat(F.lit(":"), part(url, "port")))
    return F.concat(part(url, "scheme"), F.lit("://"), host(url), port, F.when(part(url, "path") == "", "/").otherwise(part(url, "path")))


# --- addresses -------------------------------------------------------------------------------------------------


def _bare_address(address: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(address, F.lit(""))), r"^\[|\]$", ""), r"%.*$", "")


_V4 = r"^(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(\.(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$"


def ip_version(address: Column) -> Column:
    """4, 6 or 0; brackets and zones are tolerated."""
    return let(_bare_address(address), lambda a: F.when(a.rlike(_V4), 4).when(v6_hex(a).isNotNull(), 6).otherwise(0))


def v4_number(address: Column) -> Column:
    """An IPv4 literal as a number, null for anything else."""
    octets = lambda a: F.transform(F.split(a, r"\."), lambda x: x.try_cast("long"))
    return let(_bare_address(address), lambda a: F.when(a.rlike(_V4), F.aggregate(octets(a), F.lit(0).cast("long"), lambda n, x: n * 256 + x)))


def v6_hex(address: Column) -> Column:
    """An IPv6 literal as 32 hexadecimal digits, null for anything else. Strings of this form sort as numbers."""
    return let(let(_bare_address(address), _without_dots), _full_groups)


def _without_dots(a: Column) -> Column:
    """A dotted tail as two groups."""
    groups = lambda n: F.lower(F.concat(F.hex(F.shiftright(n, 16)), F.lit(":"), F.hex(n.bitwiseAND(65535))))
    tail = let(v4_number(F.regexp_extract(a, r"([0-9.]+)$", 1)), groups)
    return F.when(a.contains(":") & a.contains("."), F.concat(F.regexp_replace(a, r"[0-9.]+$", ""), tail)).otherwise(a)


def _full_groups(a: Column) -> Column:
    listed = lambda s: F.filter(F.split(s, ":"), lambda x: x != "")
    sides = F.struct(listed(F.split_part(a, F.lit("::"), F.lit(1))).alias("l"), listed(F.split_part(a, F.lit("::"), F.lit(2))).alias("r"))
    missing = lambda s: 8 - F.size(s["l"]) - F.size(s["r"])
    fill = lambda s: F.concat(s["l"], F.array_repeat(F.lit("0"), F.greatest(missing(s), F.lit(0))), s["r"])
    short = a.contains("::")
    groups = let(sides, lambda s: F.when(short, F.when(missing(s) > 0, fill(s))).otherwise(F.split(a, ":")))
    right = lambda g: (F.size(g) == 8) & F.forall(g, lambda x: x.rlike("^[0-9a-f]{1,4}$"))
    shown = lambda g: F.array_join(F.transform(g, lambda x: F.lpad(x, 4, "0")), "")
    return F.when(a.contains(":") & ~a.rlike(r":::|::.*::"), let(groups, lambda g: F.when(right(g), shown(g))))


def _ranges(blocks: list[str], width: int | None) -> list[tuple]:
    networks = [ipaddress.ip_network(b) for b in blocks]
    ends = [(int(n.network_address), int(n.broadcast_address)) for n in networks]
    return [(f"{a:0{width}x}", f"{b:0{width}x}") for a, b in ends] if width else ends


def _in_ranges(value: Column, ranges: list[tuple]) -> Column:
    out = F.lit(False)
    for low, high in ranges:
        out = out | value.between(F.lit(low), F.lit(high))
    return out


def is_private(address: Column) -> Column:
    """Whether an address literal lies in a private or reserved range; false for anything else."""
    four = let(v4_number(address), lambda v: _in_ranges(v, _ranges(PRIVATE_V4, None)))
    six = let(v6_hex(address), lambda v: _in_ranges(v, _ranges(PRIVATE_V6, 32)))
    return F.coalesce(four, six, F.lit(False))


def is_loopback(name: Column) -> Column:
    """localhost, a name below it, 127.0.0.0/8 or ::1, with or without a trailing dot."""
    four = lambda h: F.coalesce(F.shiftright(v4_number(h), 24) == 127, F.lit(False))
    six = lambda h: F.coalesce(v6_hex(h) == "0" * 31 + "1", F.lit(False))
    return let(F.regexp_replace(_bare_address(name), r"\.$", ""), lambda h: (h == "localhost") | h.endswith(".localhost") | four(h) | six(h))


def is_local_name(name: Column) -> Column:
    h = F.lower(name)
    return (h == "localhost") | h.endswith(".localhost")


def _has_suffix(h: Column, suffixes: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for s in suffixes:
        out = out | (h == s[1:]) | h.endswith(s)
    return out


def internal_reason(url: Column, allow_loopback: bool = False, extra: tuple[str, ...] = ()) -> Column:
    """``internal_host`` for a loopback, internal or private host; null otherwise."""
    from .weburl import parsed

    # the host as clients will read it: 0x7f.1 is 127.0.0.1
    read = F.coalesce(F.regexp_replace(parsed(url)["host"], r"\.+$", ""), bare_host(url))
    inside = lambda h: _has_suffix(h, (*INTERNAL_SUFFIXES, *extra)) | is_private(h)
    return let(read, lambda h: F.when(is_loopback(h), None if allow_loopback else "internal_host").when(inside(h), "internal_host"))


def is_internal_image_host(name: Column) -> Column:
    h = F.regexp_replace(F.lower(name), r"\.+$", "")
    return (h == "localhost") | h.endswith(".localhost") | h.endswith(".local") | h.isin(*METADATA_HOSTS) | is_private(h)


def is_first_party(name: Column, main: Column) -> Column:
    """The same host, or one a subdomain of the other; false for an empty main host."""
    h, m = F.lower(name), F.lower(main)
    return F.coalesce((m != "") & ((h == m) | h.endswith(F.concat(F.lit("."), m)) | m.endswith(F.concat(F.lit("."), h))), F.lit(False))


_PIN_HOST = r"(^|\.)pinterest\.(com|(?:com|co)\.[a-z]{2}|[a-z]{2})$"


def is_pin_host(url: Column) -> Column:
    h = bare_host(url)
    return (h == "pin.it") | h.endswith(".pin.it") | h.rlike(_PIN_HOST)


def is_pin_page(url: Column) -> Column:
    h = bare_host(url)
    return (h == "pin.it") | h.endswith(".pin.it") | (h.rlike(_PIN_HOST) & part(url, "path").rlike(r"^/(?:amp/)?pin/[0-9]+(?:/|$)"))


def pin_id(url: Column) -> Column:
    return F.nullif(F.regexp_extract(F.coalesce(url, F.lit("")), r"/pin/([0-9]+)", 1), F.lit(""))


# --- credentials in URLs ---------------------------------------------------------------------------------------


def _unescaped(url: Column) -> Column:
    return F.regexp_replace(F.coalesce(url, F.lit("")), r"(?i)&(?:amp|#38|#x26);", "&")


def _has_key(pairs: Column, keys: tuple[str, ...]) -> Column:
    """Whether a query string has one of the keys with a value."""
    return F.exists(F.split(pairs, "&"), lambda p: F.lower(F.split_part(p, F.lit("="), F.lit(1))).isin(*keys) & (F.length(p) > F.length(F.split_part(p, F.lit("="), F.lit(1))) + 1))


def query_of(url: Column) -> Column:
    """What stands between the first ``?`` and the next ``#``, of any string."""
    return F.regexp_extract(_unescaped(url), r"^[^?]*\?([^#]*)", 1)


def fragment_of(url: Column) -> Column:
    """Parameters of the fragment, also of one that a hash router uses as an address."""
    after = F.regexp_extract(_unescaped(url), r"^[^#]*#(.*)$", 1)
    return F.when(after.contains("?"), F.regexp_extract(after, r"\?(.*)$", 1)).otherwise(after)


def signed_reason(url: Column, keys: tuple[str, ...] = SOURCE_KEYS) -> Column:
    return F.when(_has_key(query_of(url), keys), "signed_or_tokenized_url")


def fragment_reason(url: Column, keys: tuple[str, ...] = CREDENTIAL_KEYS) -> Column:
    return F.when(_has_key(fragment_of(url), keys), "signed_or_tokenized_url")


def password_reason(url: Column) -> Column:
    return F.when(part(url, "userinfo").rlike(r"^[^:]*:."), "userinfo_credential")


def loopback_reason(url: Column) -> Column:
    """A key of an authorisation flow on a loopback address."""
    plain = _unescaped(url)
    found = _has_key(query_of(plain), LOOPBACK_KEYS) | _has_key(fragment_of(plain), LOOPBACK_KEYS)
    return F.when(is_loopback(bare_host(plain)) & found, "loopback_oauth_credential")


def redact_query(url: Column, keys: tuple[str, ...] = SOURCE_KEYS) -> Column:
    """The address with the values of credential keys replaced in its query and fragment."""
    pattern = "|".join(k.replace("-", r"\-") for k in keys)
    return F.regexp_replace(_unescaped(url), rf"(?i)([?#&](?:{pattern})=)[^&#]+", "$1%5BREDACTED%5D")
