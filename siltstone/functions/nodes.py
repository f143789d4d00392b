"""Schema.org nodes in JSON-LD texts, as Column expressions over Variant values."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import urls
from .core import let

# Types whose nodes carry a page's content, those of the article family, and links to nested nodes.
CONTENT_TYPES = (
    "article", "newsarticle", "blogposting", "techarticle", "scholarlyarticle", "report", "jobposting", "product", "event", "course", "recipe",
    "review", "howto", "faqpage", "question", "softwareapplication", "webapplication", "musicrecording", "book", "movie", "tvseries", "tvepisode",
    "game", "dataset", "localbusiness", "restaurant", "store", "socialmediaposting",
)
ARTICLE_TYPES = CONTENT_TYPES[:6]
LINKS = ("mainEntity", "mainEntityOfPage", "about", "subject", "hasPart", "itemListElement")
MAX_TYPES, MAX_FIELD = 64, 4096


def short_type(c: Column) -> Column:
    """``https://schema.org/Article/`` -> ``article``."""
    low = F.regexp_replace(F.regexp_replace(F.trim(F.lower(c)), r"^https?://schema\.org/", ""), "/+$", "")
    return F.trim(F.element_at(F.split(low, "/"), -1))


def types(node: Column) -> Column:
    """Short types of a Variant node; '@type' may be a text or an array."""
    many = F.try_variant_get(node, '$["@type"]', "array<string>")
    one = F.try_variant_get(node, '$["@type"]', "string")
    raw = F.coalesce(many, F.when(one.isNotNull(), F.array(one)), F.array().cast("array<string>"))
    return F.transform(F.slice(raw, 1, MAX_TYPES), short_type)


def text_at(node: Column, path: str) -> Column:
    """The text at a path; null where there is none, or something else than a text."""
    return F.when(F.schema_of_variant(F.try_variant_get(node, path, "variant")) == "STRING", F.try_variant_get(node, path, "string"))


def _cut(v: Column) -> Column:
    return F.when(F.length(v) > MAX_FIELD, F.concat(F.substring(v, 1, MAX_FIELD - 1), F.lit("…"))).otherwise(v)


def field(node: Column, *names: str) -> Column:
    """The first of some text fields that is not blank, trimmed; a longer one ends in an ellipsis; null if there is none."""
    return let(F.coalesce(*[F.nullif(F.trim(text_at(node, f"$.{n}")), F.lit("")) for n in names]), _cut)


#: Entries of an array that are read.
MAX_ENTRIES = 50


def _asked(q: Column) -> Column:
    """A question and its accepted answer as one text; null without either."""
    ask, answer = field(q, "name"), F.coalesce(field(q, "acceptedAnswer.text"), field(q, "acceptedAnswer"))
    said = lambda p: F.when(p["q"].isNotNull() & p["a"].isNotNull(), F.concat(F.lit("Q: "), p["q"], F.lit(" A: "), p["a"])).when(p["q"].isNotNull(), F.concat(F.lit("Q: "), p["q"])).otherwise(p["a"])
    return let(F.struct(ask.alias("q"), answer.alias("a")), said)


def _entries(node: Column, *names: str) -> Column:
    """The first entries of an array field, or its single value; of several fields the first that is there."""
    value = F.coalesce(*[F.try_variant_get(node, f"$.{n}", "variant") for n in names])
    return let(value, lambda v: F.slice(F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.when(v.isNotNull(), F.array(v))), 1, MAX_ENTRIES))


def _joined(texts: Column, by: str) -> Column:
    return F.nullif(F.array_join(F.array_compact(texts), by), F.lit(""))


def _questions(node: Column) -> Column:
    """The questions of a page of questions, each with its answer."""
    return _joined(F.transform(_entries(node, "mainEntity"), _asked), "  ")


def _steps(node: Column, name: str) -> Column:
    """Instructions: texts, steps by their text or name, a list around them, and the steps of one level of sections."""
    own = lambda v: F.when(F.schema_of_variant(v) == "STRING", let(F.nullif(F.trim(F.try_variant_get(v, "$", "string")), F.lit("")), _cut))
    step = lambda v: F.coalesce(own(v), field(v, "text"), field(v, "name"))
    inner = lambda v: _joined(F.transform(_entries(v, "itemListElement", "step"), step), " · ")
    return _joined(F.transform(_entries(node, name), lambda v: F.coalesce(own(v), field(v, "text"), inner(v), field(v, "name"))), " · ")


def harvest(node: Column, lead: bool | Column = False) -> Column:
    """The text that a content node carries, by the order of fields of its type; null if none. As a lead, an article gives its headline first."""
    return let(types(node), lambda own: _harvest(node, own, lead))


def _harvest(node: Column, own: Column, lead: bool | Column) -> Column:
    has = lambda *names: F.arrays_overlap(own, F.array(*[F.lit(n) for n in names]))
    f = lambda *names: field(node, *names)
    short, whole = ("headline", "description", "articleBody"), ("articleBody", "headline", "description")
    article = f(*(short if lead else whole)) if isinstance(lead, bool) else F.when(lead, f(*short)).otherwise(f(*whole))
    return (
        F.when(has("socialmediaposting"), F.lit(None).cast("string"))
        .when(has(*ARTICLE_TYPES), article)
        .when(has("jobposting"), f("description", "title"))
        .when(has("review"), f("reviewBody", "description"))
        .when(has("recipe"), F.coalesce(_steps(node, "recipeInstructions"), field(node, "description")))
        .when(has("howto"), F.coalesce(field(node, "description"), _steps(node, "step")))
        .when(has("faqpage"), F.coalesce(_questions(node), field(node, "description")))
        .when(has("question"), F.coalesce(_asked(node), field(node, "description")))
        .when(has(*CONTENT_TYPES), field(node, "description"))
    )


#: Levels at which nodes are looked for: a script's own nodes, and three below them.
MAX_DEPTH = 4


def _nodes(value: Column) -> Column:
    """Nodes of a Variant: an array's, arrays inside it opened twice, or a single one."""
    listed = lambda x: F.try_variant_get(x, "$", "array<variant>")
    opened = lambda a: F.flatten(F.transform(a, lambda x: F.coalesce(listed(x), F.array(x))))
    one = F.when(F.schema_of_variant(value).startswith("OBJECT"), F.array(value))
    return F.coalesce(opened(opened(listed(value))), one, F.array().cast("array<variant>"))


def _below(v: Column, keys: tuple[str, ...]) -> Column:
    """Nodes under some keys of a node, in the order of the keys."""
    found = lambda m: F.array_compact(F.transform(F.array(*[F.lit(k) for k in keys]), lambda k: F.try_element_at(m, k)))
    held = let(F.try_variant_get(v, "$", "map<string,variant>"), found)
    return F.coalesce(F.flatten(F.transform(held, _nodes)), F.array().cast("array<variant>"))


def roots(texts: Column) -> Column:
    """The nodes of JSON texts, in order."""
    return F.flatten(F.transform(texts, lambda t: let(F.try_parse_json(t), _nodes)))


def walked(texts: Column) -> Column:
    """array<struct(depth, node)> of JSON texts, depth first: each node, then its graph, then its links."""

    def branch(v: Column, depth: int) -> Column:
        own = F.array(F.struct(F.lit(depth).alias("depth"), v.alias("node")))
        if depth == MAX_DEPTH - 1:
            return own
        return F.concat(own, F.flatten(F.transform(_below(v, ("@graph", *LINKS)), lambda x: branch(x, depth + 1))))

    return F.flatten(F.transform(roots(texts), lambda r: branch(r, 0)))


def nested(texts: Column) -> Column:
    """Variant nodes of JSON texts, depth first."""
    return F.transform(walked(texts), lambda n: n["node"])


def is_posting(v: Column) -> Column:
    return F.array_contains(types(v), "socialmediaposting")


def bearing_types(v: Column, is_pin: Column) -> Column:
    """The content types for which a node carries text; a social post counts on a pin's page only, by its body."""
    carries = lambda t: F.when(t == "socialmediaposting", is_pin & field(v, "articleBody").isNotNull()).otherwise(_harvest(v, F.array(t), False).isNotNull())
    return F.filter(types(v), lambda t: t.isin(*CONTENT_TYPES) & carries(t))


def bearing_of(found: Column, is_pin: Column) -> Column:
    """The nodes among ``walked`` ones that carry text; what hangs below such a node is not looked at."""
    ok = lambda v: harvest(v).isNotNull() | (is_pin & is_posting(v) & field(v, "articleBody").isNotNull())
    marked = F.transform(found, lambda n: F.struct(n["depth"].alias("depth"), n["node"].alias("node"), F.coalesce(ok(n["node"]), F.lit(False)).alias("ok")))
    # the depth of the bearing node that is being passed over, or one that nothing lies below
    start = F.struct(F.array().cast("array<variant>").alias("kept"), F.lit(MAX_DEPTH).alias("under"))

    def step(s: Column, n: Column) -> Column:
        inside = n["depth"] > s["under"]
        return F.struct(
            F.when(~inside & n["ok"], F.array_append(s["kept"], n["node"])).otherwise(s["kept"]).alias("kept"),
            F.when(inside, s["under"]).when(n["ok"], n["depth"]).otherwise(F.lit(MAX_DEPTH)).alias("under"),
        )

    return F.aggregate(marked, start, step, lambda s: s["kept"])


def bearing(texts: Column, is_pin: Column) -> Column:
    return bearing_of(walked(texts), is_pin)


def postings_of(found: Column) -> Column:
    """All social posts among ``walked`` nodes."""
    return F.filter(F.transform(found, lambda n: n["node"]), is_posting)


def postings(texts: Column) -> Column:
    return postings_of(walked(texts))


def pin_caption_of(found: Column, url: Column) -> Column:
    """On a pin's page the body of the post that refers to the pin, else of the first post."""
    pin = urls.pin_id(url)
    refs = lambda v: F.array_compact(F.array(*[text_at(v, p) for p in ('$["@id"]', "$.url", "$.mainEntityOfPage", '$.mainEntityOfPage["@id"]', "$.mainEntityOfPage.url")]))
    own = lambda v: F.exists(refs(v), lambda r: urls.is_pin_page(r) & (urls.pin_id(r) == pin))
    chosen = lambda posts: F.coalesce(F.get(F.filter(posts, own), F.lit(0)), F.get(posts, F.lit(0)))
    return F.when(urls.is_pin_page(url), let(let(postings_of(found), chosen), lambda v: field(v, "articleBody")))


def pin_caption(texts: Column, url: Column) -> Column:
    return pin_caption_of(walked(texts), url)


def lead(found: Column, walked_: Column, url: Column, has_text: Column) -> Column:
    """What structured data puts before a page's text: the first content node's text, else a pin's caption; markup removed.

    ``found`` are the bearing nodes among the ``walked`` ones; where the page has text of its own, an article gives its headline
    rather than its body.
    """
    first = F.get(F.filter(found, is_content), F.lit(0))
    plain = lambda t: F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(t, "<[^>]*>", " "), "(?i)&[a-z]+;", " "), r"\s+", " "))
    return plain(F.coalesce(let(first, lambda v: harvest(v, has_text)), pin_caption_of(walked_, url)))


def is_content(v: Column) -> Column:
    """Whether a node has a content type other than that of social posts."""
    return F.exists(types(v), lambda t: t.isin(*[c for c in CONTENT_TYPES if c != "socialmediaposting"]))


def candidates(texts: Column) -> Column:
    """Top nodes and the nodes of their graphs, in order."""
    return F.flatten(F.transform(roots(texts), lambda v: F.concat(F.array(v), _below(v, ("@graph",)))))


def preferred_title(raw: Column, texts: Column) -> Column:
    """A page's title: that of its structured data, unless the page's own title holds it."""
    named = lambda v: F.coalesce(*[F.nullif(F.trim(text_at(v, f"$.{n}")), F.lit("")) for n in ("title", "name", "headline")])
    content = lambda v: is_content(v) & harvest(v).isNotNull()
    found = F.get(F.array_compact(F.transform(F.filter(candidates(texts), content), named)), F.lit(0))
    return let(F.struct(raw.alias("raw"), found.alias("own")), lambda t: F.when(t["own"].isNull() | F.coalesce(F.lower(t["raw"]).contains(F.lower(t["own"])), F.lit(False)), t["raw"]).otherwise(t["own"]))


def image_addresses(texts: Column) -> Column:
    """Image addresses of top nodes and of the nodes of their graphs."""
    one = lambda v: F.coalesce(text_at(v, "$"), text_at(v, "$.url"), text_at(v, "$.contentUrl"))
    plain = lambda v, key: F.coalesce(F.transform(F.try_variant_get(v, f"$.{key}", "array<variant>"), one), F.array(one(F.try_variant_get(v, f"$.{key}", "variant"))))
    own = lambda v: F.when(F.array_contains(types(v), "imageobject"), F.concat(plain(v, "url"), plain(v, "contentUrl"))).otherwise(F.concat(plain(v, "image"), plain(v, "thumbnailUrl")))
    return F.array_compact(F.flatten(F.transform(candidates(texts), own)))


def content_kind_of_types(all_types: Column) -> Column:
    """job before product before article; null if none of the types is content."""
    social_free = [t for t in CONTENT_TYPES if t not in ("jobposting", "product", "socialmediaposting")]
    return (
        F.when(F.array_contains(all_types, "jobposting"), "job")
        .when(F.array_contains(all_types, "product"), "product")
        .when(F.arrays_overlap(all_types, F.array(*[F.lit(t) for t in social_free])), "article")
    )


def is_paywalled(texts: Column) -> Column:
    """Whether a node or a node of its graph says that it is not free."""
    flag = lambda v: F.coalesce(F.lower(F.try_variant_get(v, "$.isAccessibleForFree", "string")) == "false", F.lit(False))
    return F.exists(candidates(texts), flag)
