"""Web addresses as the URL standard reads them, as Column expressions: hosts, dot segments, percent-encoding, relative forms.

For the schemes http and https. ``parsed`` gives the parts of an address, or why it is none; ``href`` its canonical text. Hosts are percent-decoded, put
in lower case, encoded label by label (Bootstring), and read as IPv4 numbers in any base and IPv6 literals.

Cases: null is the empty text, which is no address; letters are put in lower case and full-width ones made plain, other compatibility forms of Unicode and the composition of
accents are left as they are, as is ``^`` in paths.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .core import let

# What the URL standard percent-encodes in paths and queries beside control characters and what is not ASCII.
PATH_SET, QUERY_SET = ' "#<>?`{}', " \"#<>'"
# Characters that a host may not hold.
FORBIDDEN = "\\x00-\\x20#/:<>?@\\[\\\\\\]^|%\\x7F"
# Parameters of Bootstring for domain names.
BASE, T_MIN, T_MAX, SKEW, DAMP, BIAS, FIRST = 36, 1, 26, 38, 700, 72, 128
DIGITS = "abcdefghijklmnopqrstuvwxyz0123456789"
DOTS, IGNORED = "\u3002\uff0e\uff61", "\u00ad\u200b\u2060\ufeff"
_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
_PLAIN = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F))


def percent_encoded(c: Column, characters: str) -> Column:
    """Control characters, what is not ASCII and some more characters as UTF-8 bytes, the rest as it is."""
    one = "[\\x00-\\x1F\\x7F-\\x{10FFFF}" + "".join("\\" + x for x in characters) + "]"
    pieces = F.regexp_extract_all(c, F.lit(f"({one}++|[^{one[1:]}++)"), F.lit(1))
    encoded = lambda x: F.regexp_replace(F.hex(x.cast("binary")), "(..)", "%$1")
    return F.when(c.rlike(one), F.array_join(F.transform(pieces, lambda x: F.when(x.rlike("^" + one), encoded(x)).otherwise(x)), "")).otherwise(c)


def percent_decoded(c: Column) -> Column:
    """Percent-encoded bytes as UTF-8, with replacement characters for bad ones."""
    pieces = F.regexp_extract_all(c, F.lit("((?:%[0-9A-Fa-f]{2})++|[^%]++|%)"), F.lit(1))
    plain = lambda x: F.when(x.rlike("^%[0-9A-Fa-f]{2}"), F.make_valid_utf8(F.unhex(F.replace(x, F.lit("%"), F.lit(""))).cast("string"))).otherwise(x)
    return F.when(c.contains("%"), F.array_join(F.transform(pieces, plain), "")).otherwise(c)


# --- labels ------------------------------------------------------------------------------------------------------------------


def _digits(delta: Column, bias: Column) -> Column:
    """A whole number as digits whose thresholds follow the bias."""
    start = F.struct(delta.alias("q"), F.lit("").alias("out"), F.lit(False).alias("done"))

    def step(s: Column, k: Column) -> Column:
        t = F.least(F.greatest(k * BASE - bias, F.lit(T_MIN)), F.lit(T_MAX)).cast("long")

        def next_(t: Column) -> Column:
            more = s["q"] >= t
            digit = F.when(more, t + (s["q"] - t) % (BASE - t)).otherwise(s["q"])
            letter = F.substring(F.lit(DIGITS), (digit + 1).cast("int"), F.lit(1))
            return F.when(s["done"], s).otherwise(
                F.struct(F.when(more, F.floor((s["q"] - t) / (BASE - t)).cast("long")).otherwise(F.lit(0).cast("long")).alias("q"), F.concat(s["out"], letter).alias("out"), (~more).alias("done"))
            )

        return let(t, next_)

    return F.aggregate(F.sequence(F.lit(1), F.lit(14)), start, step)["out"]


def _adapted(delta: Column, points: Column, first: Column) -> Column:
    """The bias after a number has been written."""
    scaled = F.floor(F.when(first, delta / DAMP).otherwise(delta / 2)).cast("long")
    start = let(scaled, lambda d: F.struct((d + F.floor(d / points).cast("long")).alias("d"), F.lit(0).cast("long").alias("k")))
    limit = (BASE - T_MIN) * T_MAX // 2
    step = lambda s, _: F.when(s["d"] > limit, F.struct(F.floor(s["d"] / (BASE - T_MIN)).cast("long").alias("d"), (s["k"] + BASE).alias("k"))).otherwise(s)
    return let(F.aggregate(F.sequence(F.lit(1), F.lit(12)), start, step), lambda s: s["k"] + F.floor((BASE - T_MIN + 1) * s["d"] / (s["d"] + SKEW)).cast("long"))


def _points(label: Column) -> Column:
    """Code points of a text."""
    bytes_ = lambda x: F.conv(F.hex(F.encode(x, "UTF-32")), 16, 10).cast("long")
    return F.transform(F.regexp_extract_all(label, F.lit("(?s)(.)"), F.lit(1)), bytes_)


def bootstring(label: Column) -> Column:
    """A label in its ASCII form without the prefix."""

    def whole(points: Column) -> Column:
        basic = F.array_join(F.transform(F.filter(points, lambda p: p < FIRST), lambda p: F.chr(p)), "")
        rare = F.array_sort(F.array_distinct(F.filter(points, lambda p: p >= FIRST)))

        def over(basic: Column) -> Column:
            n = F.length(basic).cast("long")
            number = lambda x: F.lit(x).cast("long")
            start = F.struct(
                number(FIRST).alias("n"), number(0).alias("delta"), number(BIAS).alias("bias"), n.alias("done"), F.when(n > 0, F.concat(basic, F.lit("-"))).otherwise("").alias("out")
            )

            def point(s: Column, m: Column) -> Column:
                raised = F.struct(m.alias("n"), (s["delta"] + (m - s["n"]) * (s["done"] + 1)).alias("delta"), s["bias"].alias("bias"), s["done"].alias("done"), s["out"].alias("out"))

                def each(t: Column, p: Column) -> Column:
                    moved = lambda delta, bias, done, out: F.struct(t["n"].alias("n"), delta.alias("delta"), bias.alias("bias"), done.alias("done"), out.alias("out"))
                    wrote = moved(number(0), _adapted(t["delta"], t["done"] + 1, t["done"] == n), t["done"] + 1, F.concat(t["out"], _digits(t["delta"], t["bias"])))
                    return F.when(p < m, moved(t["delta"] + 1, t["bias"], t["done"], t["out"])).when(p == m, wrote).otherwise(t)

                after = lambda t: F.struct((t["n"] + 1).alias("n"), (t["delta"] + 1).alias("delta"), t["bias"].alias("bias"), t["done"].alias("done"), t["out"].alias("out"))
                return let(F.aggregate(points, raised, each), after)

            return F.aggregate(rare, start, point)["out"]

        return let(basic, over)

    return let(_points(label), whole)


def ascii_host(name: Column) -> Column:
    """A domain name in lower case and ASCII."""
    folded = F.lower(F.translate(F.translate(name, _WIDE + DOTS, _PLAIN + "..."), IGNORED, ""))
    label = lambda x: F.when(x.rlike("[^\\x00-\\x7F]"), F.concat(F.lit("xn--"), bootstring(x))).otherwise(x)
    return F.when(name.rlike("[^\\x00-\\x7F]"), F.array_join(F.transform(F.split(folded, "\\."), label), ".")).otherwise(F.lower(name))


# --- numbers as hosts --------------------------------------------------------------------------------------------------------


def _number(c: Column) -> Column:
    """A part of an IPv4 address in base 16, 8 or 10; null if it is none."""
    digits = F.regexp_replace(c, "^0[xX]", "")
    big = F.lit(1 << 40)  # more than any address
    based = lambda x, base, most: F.when(F.length(F.regexp_replace(x, "^0+", "")) > most, big).otherwise(F.coalesce(F.conv(F.when(x == "", "0").otherwise(x), base, 10).try_cast("long"), F.lit(0)))
    return (
        F.when(c.rlike("^0[xX][0-9A-Fa-f]*$"), based(digits, 16, 9))
        .when(c.rlike("^0[0-7]+$"), based(c, 8, 12))
        .when(c.rlike("^(0|[1-9][0-9]*)$"), based(c, 10, 12))
    )


def is_numeric(name: Column) -> Column:
    """Whether a host's last label, without a final dot, is a number, so that the host must be an IPv4 address."""
    return name.rlike(r"(?:^|\.)(?:[0-9]+|0[xX][0-9A-Fa-f]*)\.?$")


def ipv4(name: Column) -> Column:
    """The dotted form of an IPv4 address written with 1 to 4 numbers in any base; null if it is none."""

    def joined(n: Column) -> Column:
        size, last = F.size(n), F.element_at(n, -1)
        powers = F.array(*[F.lit(256**k).cast("long") for k in (4, 3, 2, 1)])  # places of the numbers that follow
        head = F.slice(n, 1, F.greatest(size - 1, F.lit(1)))
        front = F.when(size > 1, F.aggregate(F.transform(head, lambda x, k: x * F.get(powers, k + 1)), F.lit(0).cast("long"), lambda a, x: a + x)).otherwise(F.lit(0).cast("long"))
        fits = (size <= 4) & F.forall(n, lambda x: x.isNotNull()) & ((size == 1) | F.forall(head, lambda x: x <= 255)) & (last < F.get(powers, size - 1))
        dotted = lambda v: F.concat_ws(".", *[F.shiftright(v, s).bitwiseAND(255).cast("string") for s in (24, 16, 8, 0)])
        return F.when(F.coalesce(fits, F.lit(False)), let(front + last, dotted))

    return let(F.transform(F.split(F.regexp_replace(name, r"\.$", ""), r"\."), _number), joined)


def ipv6(literal: Column) -> Column:
    """The shortest form of an IPv6 literal, without brackets; null if it is none."""
    from .urls import v6_hex

    def shown(digits: Column) -> Column:
        groups = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.lower(F.regexp_replace(F.substring(digits, k * 4 + 1, F.lit(4)), "^0{1,3}", "")))

        def short(text: Column) -> Column:
            runs = F.regexp_extract_all(text, F.lit("((?<![^:])0(?::0)+(?![^:]))"), F.lit(1))
            longest = lambda r: F.element_at(F.array_sort(F.transform(r, lambda x, k: F.struct((-F.length(x)).alias("n"), k.alias("k"), x.alias("x")))), 1)["x"]

            def cut(run: Column) -> Column:
                around = F.regexp_replace(text, F.concat(F.lit("^(.*?)(?<![^:])"), run, F.lit("(?![^:])(.*)$")), F.lit("$1|$2"))
                side = lambda k: F.regexp_replace(F.split_part(around, F.lit("|"), F.lit(k)), "^:|:$", "")
                return F.concat(side(1), F.lit("::"), side(2))

            return let(runs, lambda r: F.when(F.size(r) > 0, let(longest(r), cut)).otherwise(text))

        return let(F.array_join(groups, ":"), short)

    return F.when(~literal.rlike("[%\\s]"), let(v6_hex(literal), lambda d: F.when(d.isNotNull(), shown(d))))


def host(name: Column) -> Column:
    """A host as the standard writes it, with brackets for IPv6; null if it is none."""

    def domain(a: Column) -> Column:
        return F.when((a == "") | a.rlike(f"[{FORBIDDEN}]"), F.lit(None).cast("string")).when(is_numeric(a), ipv4(a)).otherwise(a)

    literal = F.regexp_extract(name, r"^\[(.*)\]$", 1)
    bracketed = let(ipv6(literal), lambda x: F.concat(F.lit("["), x, F.lit("]")))
    return F.when(name.startswith("["), F.when(name.endswith("]"), bracketed)).otherwise(let(let(percent_decoded(name), ascii_host), domain))


# --- paths and addresses -----------------------------------------------------------------------------------------------------


def path(c: Column) -> Column:
    """A path that begins with a slash, without dot segments, percent-encoded."""
    segments = F.split(F.regexp_replace(F.replace(c, F.lit("\\"), F.lit("/")), "^/", ""), "/")

    def walked(segs: Column) -> Column:
        places = F.transform(segs, lambda x, k: F.struct(x.alias("x"), (k == F.size(segs) - 1).alias("last")))
        empty = F.array().cast("array<string>")

        def step(stack: Column, s: Column) -> Column:
            up, here = s["x"].rlike(r"^(?i)(\.|%2e){2}$"), s["x"].rlike(r"^(?i)(\.|%2e)$")
            end = lambda kept: F.when(s["last"], F.array_append(kept, F.lit(""))).otherwise(kept)
            return F.when(up, end(F.slice(stack, F.lit(1), F.greatest(F.size(stack) - 1, F.lit(0))))).when(here, end(stack)).otherwise(F.array_append(stack, s["x"]))

        return F.concat(F.lit("/"), F.array_join(F.aggregate(places, empty, step), "/"))

    dotted = c.rlike(r"(?i)(?:^|[/\\])(?:\.|%2e){1,2}(?:[/\\]|$)")
    return percent_encoded(F.when(dotted, let(segments, walked)).otherwise(F.concat(F.lit("/"), F.regexp_replace(F.replace(c, F.lit("\\"), F.lit("/")), "^/", ""))), PATH_SET)


_ADDRESS = r"(?s)^([A-Za-z][A-Za-z0-9+.\-]*):[/\\]*([^/\\?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"
_AUTHORITY = r"(?s)^(?:(.*)@)?(\[[^\]]*\]|[^:]*)(?::([0-9]*))?$"


def trimmed(url: Column) -> Column:
    """Without control characters and blanks at either end, and without tabs and line ends anywhere."""
    return F.regexp_replace(F.coalesce(url, F.lit("")), r"\A[\x00-\x20]++|(?<![\x00-\x20])[\x00-\x20]++\z|[\t\r\n]", "")


def parsed(url: Column) -> Column:
    """struct(scheme, userinfo, host, port, path, query, fragment, error) of an absolute address.

    ``error`` is ``invalid_url`` or ``unsupported_scheme``, else null. The port is null where it is the scheme's own; query and fragment have their first
    character, and are null where absent.
    """
    nothing = F.lit(None).cast("string")

    def parts(u: Column) -> Column:
        scheme = F.lower(F.regexp_extract(u, _ADDRESS, 1))
        authority = F.regexp_extract(u, _ADDRESS, 2)

        def whole(s: Column) -> Column:
            a = s["a"]
            number = F.regexp_replace(F.regexp_extract(a, _AUTHORITY, 3), "^0+(?=[0-9])", "")
            own = lambda n: F.when((n == "") | ((s["s"] == "http") & (n == "80")) | ((s["s"] == "https") & (n == "443")), nothing).otherwise(n)
            given = lambda k: F.when(F.regexp_extract(u, _ADDRESS, k) != "", F.regexp_extract(u, _ADDRESS, k))

            def made(h: Column) -> Column:
                bad = ~a.rlike(_AUTHORITY) | h.isNull() | (F.length(number) > 5) | F.coalesce(number.try_cast("int") > 65535, F.lit(False))
                error = F.when(s["s"] == "", "invalid_url").when(~s["s"].isin("http", "https"), "unsupported_scheme").when(bad, "invalid_url")
                query = let(given(4), lambda q: F.when(q.isNotNull(), percent_encoded(q, QUERY_SET)))
                return F.struct(
                    s["s"].alias("scheme"), F.regexp_extract(a, _AUTHORITY, 1).alias("userinfo"), h.alias("host"), own(number).alias("port"), path(F.regexp_extract(u, _ADDRESS, 3)).alias("path"),
                    query.alias("query"), given(5).alias("fragment"), error.alias("error"),
                )

            return let(host(F.regexp_extract(a, _AUTHORITY, 2)), made)

        return let(F.struct(scheme.alias("s"), authority.alias("a")), whole)

    return let(trimmed(url), parts)


def shown(p: Column, upgrade: bool = False, fragment: bool = False) -> Column:
    """The canonical text of a parsed address without its user; null for one with an error. ``upgrade`` makes it https."""
    scheme = F.lit("https") if upgrade else p["scheme"]
    port = F.when(p["port"].isNull() | ((scheme == "https") & (p["port"] == "443")), "").otherwise(F.concat(F.lit(":"), p["port"]))
    end = F.coalesce(p["fragment"], F.lit("")) if fragment else F.lit("")
    return F.when(p["error"].isNull(), F.concat(scheme, F.lit("://"), p["host"], port, p["path"], F.coalesce(p["query"], F.lit("")), end))


def href(url: Column, upgrade: bool = False) -> Column:
    return let(parsed(url), lambda p: shown(p, upgrade))


def address_error(url: Column) -> Column:
    """Why an input address is refused, in order: crlf_url, invalid_url, unsupported_scheme, userinfo_url; null if accepted."""
    forbidden = F.coalesce(url, F.lit("")).rlike(r"(?i)[\r\n]|%0d|%0a")
    return F.when(forbidden, "crlf_url").otherwise(let(parsed(url), lambda p: F.coalesce(p["error"], F.when(p["userinfo"] != "", "userinfo_url"))))


def resolved(base: Column, target: Column) -> Column:
    """The text of an address against a base that has been parsed, not yet canonical: absolute, rooted, relative, query and fragment forms."""

    def against(t: Column) -> Column:
        b = base
        port = F.when(b["port"].isNull(), "").otherwise(F.concat(F.lit(":"), b["port"]))
        root = F.concat(b["scheme"], F.lit("://"), b["host"], port)
        query = F.coalesce(b["query"], F.lit(""))
        same = F.regexp_extract(t, r"^([A-Za-z][A-Za-z0-9+.\-]*):(?![/\\])", 1)
        relative = F.when((same != "") & (F.lower(same) == b["scheme"]), F.regexp_replace(t, r"^[^:]*:", "")).otherwise(t)

        def form(r: Column) -> Column:
            return (
                F.when(r.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), r)
                .when(r.rlike(r"^[/\\]{2}"), F.concat(b["scheme"], F.lit(":"), r))
                .when(r.rlike(r"^[/\\]"), F.concat(root, r))
                .when(r == "", F.concat(root, b["path"], query))
                .when(r.startswith("?"), F.concat(root, b["path"], r))
                .when(r.startswith("#"), F.concat(root, b["path"], query, r))
                .otherwise(F.concat(root, F.regexp_replace(b["path"], "[^/]*$", ""), r))
            )

        return let(relative, form)

    return let(trimmed(target), against)


def joined(base: Column, target: Column, then: Callable[[Column, Column], Column]) -> Column:
    """``then(parsed base, parsed target)``; the target is an error where the base is one."""
    return let(parsed(base), lambda b: let(parsed(resolved(b, target)), lambda p: then(b, p)))


def redirect(base: Column, location: Column) -> Column:
    """struct(url, error) of a redirect: crlf_url, invalid_url, scheme_downgrade, unsupported_scheme, userinfo_url or a canonical address."""
    forbidden = F.coalesce(location, F.lit("")).rlike(r"(?i)[\r\n]|%0d|%0a")
    lower = lambda b, p: (b["scheme"] == "https") & (p["scheme"] == "http")

    def judged(b: Column, p: Column) -> Column:
        error = (
            F.when(forbidden, "crlf_url").when(b["error"].isNotNull() | (p["error"] == "invalid_url"), "invalid_url").when(lower(b, p), "scheme_downgrade")
            .when(p["error"].isNotNull(), p["error"]).when(p["userinfo"] != "", "userinfo_url")
        )
        return let(error, lambda e: F.struct(F.when(e.isNull(), shown(p)).alias("url"), e.alias("error")))

    return joined(base, location, judged)
