"""HTML scanning with regular expressions that stay in generated JVM code.

These expressions read well-formed markup as a tolerant scanner would: quoted attributes may hold ``>``,
elements do not nest unless said so, an unterminated element runs to the end. Markup that only a full
tokenizer can read is left to the reader of raw pages; every function returns a defined value for it.
Null html is the empty page.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import urls
from .core import let, lookup
from .text import collapse

# Named character references and what they stand for.
ENTITIES = {
    "amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "copy": "©", "reg": "®", "trade": "™", "hellip": "…", "mdash": "—",
    "ndash": "–", "lsquo": "‘", "rsquo": "’", "ldquo": "“", "rdquo": "”", "laquo": "«", "raquo": "»", "middot": "·", "bull": "•", "deg": "°",
    "plusmn": "±", "times": "×", "divide": "÷", "euro": "€", "pound": "£", "yen": "¥", "cent": "¢", "sect": "§", "para": "¶", "agrave": "à",
    "aacute": "á", "acirc": "â", "atilde": "ã", "auml": "ä", "aring": "å", "aelig": "æ", "ccedil": "ç", "egrave": "è", "eacute": "é", "ecirc": "ê",
    "euml": "ë", "igrave": "ì", "iacute": "í", "icirc": "î", "iuml": "ï", "ntilde": "ñ", "ograve": "ò", "oacute": "ó", "ocirc": "ô", "otilde": "õ",
    "ouml": "ö", "oslash": "ø", "ugrave": "ù", "uacute": "ú", "ucirc": "û", "uuml": "ü", "yacute": "ý", "yuml": "ÿ", "szlig": "ß",
}
_NAMED = {name: value for name, value in ENTITIES.items() if name != "amp"}
# Ids of elements that scripts fill, and names of framework state.
APP_ROOTS = ("__next", "app", "gatsby-focus-wrapper", "root", "svelte")
STATE_KEYS = ("__NEXT_DATA__", "__NUXT_DATA__", "__INITIAL_STATE__", "__PRELOADED_STATE__", "__APOLLO_STATE__")
# Elements whose content is not page text.
INERT = ("script", "style", "template", "noscript", "svg")
MAX_IMAGES, MAX_IMAGE_URL = 12, 2048
# Rewrites of prices and decimals that markup has split.
NUMBER_GLUE = ((r"([€£¥₹$])\s+(\d[\d ,]*)\s*\.\s*(\d{1,4})", "$1$2.$3"), (r"(\d)\s+\.(\d)", "$1.$2"), (r"(\d)\s+([€£¥₹])", "$1$2"))

# possessive runs: Java's matcher recurses for every turn of a group that it may have to give back
_ATTRS = r"""(?:[^<>"']++|"[^"]*+"|'[^']*+')*+"""


def _html(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def start_tags(c: Column, tag: str) -> Column:
    """Attribute text of every start tag of a name, in order."""
    return F.regexp_extract_all(_html(c), F.lit(rf"(?is)<{tag}(?=[\s/>])({_ATTRS})>"), F.lit(1))


def tag_count(c: Column, tag: str) -> Column:
    return F.size(start_tags(c, tag))


def attribute(attrs: Column, name: str) -> Column:
    """First value of an attribute, with references decoded; null where absent."""
    return decode(_raw_attribute(attrs, name))


def _raw_attribute(attrs: Column, name: str) -> Column:
    pattern = rf"""(?is)(?:^|[\s"'/]){name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    value = lambda a: F.concat(*[F.regexp_extract(a, pattern, k) for k in (1, 2, 3)])
    return let(attrs, lambda a: F.when(a.rlike(pattern), value(a)))


def elements(c: Column, tag: str) -> Column:
    """Content of every element of a name; the first close ends it, without one it runs to the end."""
    return F.regexp_extract_all(_html(c), F.lit(rf"(?is)<{tag}(?:\s{_ATTRS})?>(.*?)(?:</{tag}(?=[\s/>])[^>]*+(?:>|\z)|\z)"), F.lit(1))


def without_comments(c: Column) -> Column:
    """Every comment is one space; what follows an unterminated one is dropped."""
    return F.regexp_replace(_html(c), r"(?s)<!--.*?(?:-->|\z)", " ")


def without(c: Column, *tags: str) -> Column:
    """Elements of these names removed with their content, name by name; an unterminated one keeps its content.

    Where a name has no further end tag, one match takes the rest of the page, so no start tag looks for its end in vain twice.
    """
    for tag in tags:
        start = rf"<{tag}(?:\s{_ATTRS})?>"
        c = F.regexp_replace(c, rf"(?is){start}.*?</{tag}(?=[\s/>])[^>]*+(?:>|\z)|({start}.*+)\z", " $1")
    return c


def without_tags(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?s)</?[A-Za-z!?]{_ATTRS}>", " ")


def without_hidden(c: Column) -> Column:
    """Elements with ``hidden`` or ``display:none`` removed, where they hold no element of their own name."""
    hidden = r"""(?:\shidden(?=[\s>=/])|style\s*=\s*(?:"[^"]*display\s*:\s*none[^"]*"|'[^']*display\s*:\s*none[^']*'))"""
    return F.regexp_replace(c, rf"(?is)<([a-z][a-z0-9]*)(?=[\s>])(?={_ATTRS}>)(?=[^>]*?{hidden}){_ATTRS}>(?:[^<]++|<(?!\1[\s>]|/\1\s*>))*+</\1\s*>", " ")


def hidden_classes(c: Column) -> Column:
    """Classes that a page's style elements set to ``display:none`` by a selector of that class alone.

    At-rules (print and other media) are not looked into.
    """
    plain = lambda t: F.regexp_replace(F.regexp_replace(t, r"(?s)/\*.*?\*/", " "), r"(?s)@[^{;]*\{(?:[^{}]++|\{[^{}]*+\})*+\}", " ")
    rule = F.lit(r"(?is)(?:^|[},])\s*\.([A-Za-z_][A-Za-z0-9_-]*)\s*\{[^}]*display\s*:\s*none")
    return F.array_distinct(F.flatten(F.transform(elements(c, "style"), lambda t: F.regexp_extract_all(plain(t), rule, F.lit(1)))))


def without_classes(c: Column, classes: Column) -> Column:
    """Elements with one of the classes removed, where they hold no element of their own name."""
    before = rf"""(?is)<([a-z][a-z0-9]*)(?=[\s>])(?={_ATTRS}>)(?=[^>]*?\sclass\s*=\s*["']?(?:[^"'>]*\s)?(?:"""
    after = rf""")(?=[\s"'>])){_ATTRS}>(?:[^<]++|<(?!\1[\s>]|/\1\s*>))*+</\1\s*>"""
    pattern = F.concat(F.lit(before), F.array_join(classes, "|"), F.lit(after))
    return F.when(F.size(classes) > 0, F.regexp_replace(c, pattern, F.lit(" "))).otherwise(c)


def capped(c: Column, n: int) -> Column:
    """The first n characters; a cut inside a tag, or inside a script or the like, moves back before it."""

    def before(head: Column, tag: str) -> Column:
        """Length of what precedes the first start tag of a name that has no end tag of its name after it."""
        pattern = rf"(?is)^((?:.*</{tag}(?=[\s>]))?+.*?)<{tag}(?=[\s>])"
        return F.when(head.rlike(pattern), F.length(F.regexp_extract(head, pattern, 1)))

    def cut(x: Column) -> Column:
        head = F.regexp_replace(F.substring(x, 1, n), r"(?s)<[^<>]{0,30}$", "")
        kept = lambda h: F.substring(h, F.lit(1), F.least(F.length(h), *[before(h, t) for t in INERT]))
        return F.when(F.length(x) <= n, x).otherwise(let(head, kept))

    return let(_html(c), cut)


def decode(c: Column) -> Column:
    """Character references decoded in one pass: the ampersand's last, so nothing is decoded twice."""
    return let(c, lambda x: F.when(x.contains("&"), _decode(x)).otherwise(x))


def _decode(c: Column) -> Column:
    names = F.array_distinct(F.regexp_extract_all(c, F.lit("&([A-Za-z][A-Za-z0-9]*);"), F.lit(1)))
    put = lambda text, n: F.coalesce(F.replace(text, F.concat(F.lit("&"), n, F.lit(";")), lookup(_NAMED, n)), text)
    out = F.aggregate(names, c, put)
    return F.regexp_replace(let(out, _decode_numbers), r"(?i)&(?:amp|#38|#x26);", "&")


def _decode_numbers(c: Column) -> Column:
    found = F.array_distinct(F.regexp_extract_all(c, F.lit(r"(&#(?:[0-9]{1,7}|[xX][0-9a-fA-F]{1,6});)"), F.lit(1)))
    digits = lambda e: F.regexp_extract(e, r"&#[xX]?([0-9a-fA-F]+);", 1)
    point = lambda e: F.when(e.rlike("&#[xX]"), F.conv(digits(e), 16, 10).try_cast("int")).otherwise(digits(e).try_cast("int"))
    # a code point as text: its UTF-32 bytes decoded
    char = lambda n: F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
    valid = lambda n: F.coalesce((n > 0) & (n < 0x110000) & ~n.between(0xD800, 0xDFFF) & (n != 38), F.lit(False))
    put = lambda text, e: let(point(e), lambda n: F.when(valid(n), F.replace(text, e, char(n))).otherwise(text))
    return F.when(F.size(found) > 0, F.aggregate(found, c, put)).otherwise(c)


def glue_numbers(c: Column) -> Column:
    """Prices and decimals that markup has split, put together."""
    for pattern, put in NUMBER_GLUE:
        c = F.regexp_replace(c, pattern, put)
    return c


def body(c: Column) -> Column:
    """Content of the body, to the end where it is not closed; the page without its head where there is none."""
    found = lambda x: F.regexp_extract(x, rf"(?is)<body(?:\s{_ATTRS})?>(.*?)(?:</body(?=[\s/>])[^>]*+(?:>|\z)|\z)", 1)
    return let(_html(c), lambda x: F.when(x.rlike(r"(?is)<body[\s>]"), found(x)).otherwise(without(x, "head")))


def visible_text(c: Column) -> Column:
    """Text a reader sees: scripts, styles, hidden parts, comments and tags removed, references decoded."""
    inner = without_hidden(without(body(c), "script", "style", "noscript", "template"))
    return _text_of(inner)


def visible_text_of(c: Column, classes: Column) -> Column:
    """Visible text of a part of a page whose style elements hide ``classes``."""
    inner = without_hidden(without_classes(without(body(c), "script", "style", "noscript", "template"), classes))
    return _text_of(inner)


def _text_of(inner: Column) -> Column:
    return glue_numbers(collapse(decode(without_tags(without_comments(inner)))))


def title(c: Column) -> Column:
    """The first title's text, null where it is empty or absent."""
    return F.nullif(collapse(decode(without_tags(F.coalesce(F.get(elements(c, "title"), F.lit(0)), F.lit(""))))), F.lit(""))


def canonical_link(c: Column) -> Column:
    """href of the first link whose rel holds ``canonical``."""
    links = F.filter(start_tags(c, "link"), lambda a: F.array_contains(F.split(F.lower(F.coalesce(attribute(a, "rel"), F.lit(""))), r"\s+"), "canonical"))
    return attribute(F.get(links, F.lit(0)), "href")


def meta(c: Column) -> Column:
    """map of lower-case property or name to content; the last of a key counts."""
    pairs = F.transform(
        start_tags(c, "meta"),
        lambda a: F.struct(F.lower(F.trim(decode(F.coalesce(_raw_attribute(a, "property"), _raw_attribute(a, "name"))))).alias("key"), attribute(a, "content").alias("value")),
    )
    valid = F.filter(pairs, lambda p: p["key"].isNotNull() & (p["key"] != "") & p["value"].isNotNull())
    placed = F.array_sort(F.transform(valid, lambda p, k: F.struct(p["key"].alias("key"), k.alias("at"), p["value"].alias("value"))))
    # of equal keys, which now lie side by side, the last
    last = let(placed, lambda all_: F.filter(all_, lambda p, k: ~F.get(all_, k + 1)["key"].eqNullSafe(p["key"])))
    return F.map_from_entries(F.transform(last, lambda p: F.struct(p["key"], p["value"])))


def open_graph_of(tags: Column) -> Column:
    """The Open Graph part of a page's ``meta``."""
    return F.map_filter(tags, lambda k, v: k.startswith("og:"))


def plain_meta_of(tags: Column) -> Column:
    """The rest of a page's ``meta``."""
    return F.map_filter(tags, lambda k, v: ~k.startswith("og:"))


def open_graph(c: Column) -> Column:
    return open_graph_of(meta(c))


def plain_meta(c: Column) -> Column:
    return plain_meta_of(meta(c))


def scripts(c: Column, media_type: str) -> Column:
    """array<struct(id, text)> of the scripts of a media type."""
    found = F.transform(
        F.regexp_extract_all(_html(c), F.lit(rf"(?is)(<script(?=[\s/>]){_ATTRS}>.*?)(?:</script(?=[\s/>])[^>]*+(?:>|\z)|\z)"), F.lit(1)),
        lambda s: F.struct(
            F.regexp_extract(s, rf"(?is)^<script({_ATTRS})>", 1).alias("attrs"), F.regexp_extract(s, rf"(?is)^<script{_ATTRS}>(.*)$", 1).alias("text")
        ),
    )
    own = lambda s: F.lower(F.trim(F.split_part(F.coalesce(attribute(s["attrs"], "type"), F.lit("")), F.lit(";"), F.lit(1))))
    return F.transform(F.filter(found, lambda s: own(s) == media_type), lambda s: F.struct(attribute(s["attrs"], "id").alias("id"), s["text"].alias("text")))


def without_cdata(c: Column) -> Column:
    """A script's text without CDATA marks around it, and without the comment marks around these."""
    trimmed = lambda x: F.regexp_replace(x, r"\A\s++|(?<!\s)\s++\z", "")
    opened = F.regexp_replace(trimmed(c), r"\A(?://)?+\s*+(?:/\*)?+\s*+<!\[CDATA\[\s*+(?:\*/)?+", "")
    closed = r"\]\]>\s*+(?:\*/)?\z"
    ended = lambda x: trimmed(F.regexp_replace(trimmed(F.regexp_replace(trimmed(F.regexp_replace(x, closed, "")), r"/\*\z", "")), r"//\z", ""))
    return let(opened, lambda x: F.when(x.rlike(closed), ended(x)).otherwise(trimmed(x)))


def json_ld(c: Column) -> Column:
    """array of the JSON texts of a page's JSON-LD scripts that parse, CDATA marks removed."""
    texts = F.transform(scripts(c, "application/ld+json"), lambda s: without_cdata(s["text"]))
    return F.filter(texts, lambda t: F.try_parse_json(t).isNotNull())


def state_keys(c: Column) -> Column:
    """Names of embedded application state: ids of JSON scripts and assigned globals."""
    own = F.filter(F.transform(scripts(c, "application/json"), lambda s: s["id"]), lambda i: i.isNotNull())
    names = "|".join(STATE_KEYS)
    assigned = F.regexp_extract_all(_html(c), F.lit(rf"window\.({names})\s*="), F.lit(1))
    return F.array_distinct(F.concat(own, assigned))


def has_app_root(c: Column) -> Column:
    """A div with one of the ids that scripts fill, or a root mark."""
    return F.exists(
        start_tags(c, "div"),
        lambda a: F.coalesce(F.lower(attribute(a, "id")).isin(*APP_ROOTS), F.lit(False)) | a.rlike(r"(?i)\sdata-reactroot(?=[\s=/]|$)"),
    )


def srcset_first(c: Column) -> Column:
    return F.split_part(F.trim(F.split_part(c, F.lit(","), F.lit(1))), F.lit(" "), F.lit(1))


#: Tags of one name that are read for images.
MAX_IMAGE_TAGS = 200


def image_candidates(c: Column, json_ld_images: Column | None = None, tags_: Column | None = None) -> Column:
    """Addresses of images: Open Graph first (of ``tags_``, the page's meta map), then those of JSON-LD, then img and source elements, in order."""
    keys = let(meta(c) if tags_ is None else tags_, lambda og: F.transform(F.array(*[F.lit(k) for k in ("og:image", "og:image:url", "og:image:secure_url")]), lambda k: F.try_element_at(og, k)))
    first = lambda a, *names: decode(F.coalesce(*[_raw_attribute(a, n) for n in names]))
    tags = lambda name: F.slice(start_tags(c, name), 1, MAX_IMAGE_TAGS)
    marked = F.concat(
        F.transform(tags("img"), lambda a: first(a, "src", "data-src", "data-lazy-src")), F.transform(tags("source"), lambda a: srcset_first(first(a, "srcset", "data-srcset")))
    )
    linked = F.array().cast("array<string>") if json_ld_images is None else json_ld_images
    return F.filter(F.array_compact(F.concat(F.coalesce(keys, F.array().cast("array<string>")), linked, marked)), lambda u: F.trim(u) != "")


def images(c: Column, page_url: Column, json_ld_images: Column | None = None, tags_: Column | None = None) -> Column:
    """Up to ``MAX_IMAGES`` distinct http addresses of a page's images, resolved, without fragments, credentials and internal hosts."""
    clean = lambda u: F.regexp_replace(F.regexp_replace(u, "#.*$", ""), r"^([A-Za-z][A-Za-z0-9+.-]*://)[^/?#@]*@", "$1")
    base = F.struct(urls.part(page_url, "scheme").alias("s"), urls.host(page_url).alias("h"), urls.part(page_url, "path").alias("p"))
    absolute = let(base, lambda b: F.transform(image_candidates(c, json_ld_images, tags_), lambda u: clean(resolve(b["s"], b["h"], b["p"], F.trim(u)))))
    usable = F.filter(
        absolute, lambda u: F.coalesce(urls.part(u, "scheme").isin("http", "https") & (F.length(u) <= MAX_IMAGE_URL) & ~let(urls.host(u), urls.is_internal_image_host), F.lit(False))
    )
    return F.slice(F.array_distinct(usable), 1, MAX_IMAGES)


def revealed_boundaries(c: Column) -> Column:
    """Ids of the streamed parts that a page's own scripts reveal."""
    calls = F.regexp_extract_all(_html(c), F.lit(r"(\$RC\s*\([^)]*\))"), F.lit(1))
    return F.array_distinct(F.flatten(F.transform(calls, lambda x: F.regexp_extract_all(x, F.lit(r"\b(S:\d+)\b"), F.lit(1)))))


def resolve(base_scheme: Column, base_host: Column, base_path: Column, target: Column) -> Column:
    """An address against a base: absolute, protocol-relative, rooted, query and relative forms; ``weburl.joined`` does all that the standard says."""
    root = F.concat(base_scheme, F.lit("://"), base_host)
    at = F.when(base_path == "", "/").otherwise(base_path)
    return (
        F.when(target.rlike("(?i)^[a-z][a-z0-9+.-]*:"), target)
        .when(target.startswith("//"), F.concat(base_scheme, F.lit(":"), target))
        .when(target.startswith("/"), F.concat(root, target))
        .when(target.rlike(r"^[?#]"), F.concat(root, at, target))
        .otherwise(F.concat(root, F.regexp_replace(at, "[^/]*$", ""), target))
    )


def board_embed(c: Column) -> Column:
    """struct(platform, token) of a job board that a page embeds, null without one."""
    patterns = {
        "ashby": r"jobs\.ashbyhq\.com/([A-Za-z0-9._-]{1,128})/embed",
        "greenhouse": r"""boards\.greenhouse\.io/embed/job_board(?:/js)?\?[^"'\s]{0,256}(?:board|for)=([A-Za-z0-9._-]{1,128})""",
        "lever": r"api\.lever\.co/v0/postings/([A-Za-z0-9._-]{1,128})",
    }
    hits = []
    for platform, pattern in patterns.items():
        token = F.regexp_extract(_html(c), pattern, 1)
        hits.append(F.when(~token.isin("", ".", ".."), F.struct(F.lit(platform).alias("platform"), token.alias("token"))))
    board = F.regexp_extract(_html(c), r"""jobs\.lever\.co/([A-Za-z0-9._-]{1,128})(?=["'/?#]|$)""", 1)
    hits.append(F.when(~board.isin("", ".", ".."), F.struct(F.lit("lever").alias("platform"), board.alias("token"))))
    return F.coalesce(*hits)


def ashby_job(url: Column, page: Column) -> Column:
    """Address of the job that a page embeds: its ``ashby_jid`` under the organisation whose board the page embeds; null without either."""
    job = F.nullif(F.try_parse_url(url, F.lit("QUERY"), F.lit("ashby_jid")), F.lit(""))
    board = F.nullif(F.regexp_extract(_html(page), r"(?i)jobs\.ashbyhq\.com/([a-z0-9_-]+)/embed", 1), F.lit(""))
    return F.concat(F.lit("https://jobs.ashbyhq.com/"), board, F.lit("/"), job)
