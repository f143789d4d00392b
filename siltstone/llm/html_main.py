"""Main text of web pages, with a style tree for every site.

The pages of a host are merged into a style tree: an element stands at the path of presentations (tag, role
and classes) that leads to it. A node of the tree has features: the layouts of its elements (presentations of the
elements below them) and the texts that stand there. A feature on d of the node's m pages has the entropy log d over
these pages, so its importance is ``1 - log d / log(m + 0.5)``: near 0 where it is on every page of some, 1 where it is on
one page only, or where a site has one page. The importance of an element is
``(1 - GAMMA) * importance of its layout + GAMMA * mean importance of its texts``, weighted by their lengths.
Branches of an importance under ``LEAST_IMPORTANCE`` are removed from each page. Pages of one main text count once,
so mirrored pages do not make an article look like boilerplate.

Names shift what the tree says: an element one of whose names is made of words for menus, headers, footers, sidebars, adverts,
notices or reader comments and of words for layout only goes in any case (inside an article few of these words count, and none on running text), as do elements that HTML itself or their role marks
so; where such a word stands among others, an importance under ``LEAST_NAMED`` is enough. Some boilerplate differs on every
page (menus that name other pages), and the articles of mirrored pages are alike, so entropy alone is not enough either
way: ``main``, or all of the page's articles, are taken where they hold half of the text that is left, and plain
paragraphs, headings, lists and tables, and what holds half of a page's text, are never removed for their importance.

Scale: pages are parsed by a map; a page gives each of its features once, features are counted with a map-side combine, so a
host with a third of all pages is one of many counts. Features on two pages or more go back to the pages: as sorted numbers that are
broadcast if they are at most ``MAX_SHARED``, else by joins on the feature and on the page, with the same result.

Cases: null html is the empty page, whose text is empty; a null or odd URL is a site of its own; repeated
rows keep their count; unclosed, nested and very long markup is read in linear time.
"""

from __future__ import annotations

import html as html_library
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import Scratch

GAMMA = 0.9
LEAST_IMPORTANCE, LEAST_NAMED = 0.15, 0.6
#: Features that are broadcast, 12 bytes each.
MAX_SHARED = 1_000_000

# Element names of HTML and words that name parts of pages.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr br".split()
)
PLAIN = frozenset("p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd table thead tbody tfoot tr td th blockquote pre article main body figcaption caption".split())
CLOSES_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
SIBLINGS = {
    "li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"),
    "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select"),
}
DROPPED = frozenset(
    "head script style textarea title noscript template svg math iframe object embed canvas audio video form nav menu aside footer button select dialog".split()
)
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
DROPPED_NAMES = frozenset(
    """ad ads adsense adsbygoogle advert adverts advertisement advertising adbox adslot sponsor sponsored sponsors promo promos promotion promoted banner banners
    cookie cookies consent gdpr notice notices notification notifications alert alerts popup modal overlay newsletter subscribe subscription signup
    login register share sharing sharebar social sidebar sidenav aside widget widgets related recommended recommendations trending menu menus nav
    navbar navigation navi topnav breadcrumb breadcrumbs pagination pager toc header masthead topbar toolbar footer foot colophon copyright disclaimer
    comment comments commentlist discussion disqus respond reply replies search searchbox skiplink""".split()
)
#: Words that say nothing about what an element holds.
NEUTRAL = frozenset(
    """area list wrapper wrap container box bar block section item items inner outer content body text link links button buttons group row col column columns
    left right top bottom main site page global primary secondary small large mobile desktop fixed sticky inline unit slot zone panel pane input label title
    heading icon icons count thread tree meta info message reader user post posts article articles blog web center first last id""".split()
)

#: Words that mean no text of an article even inside one; the others, such as "notice" or "discussion", are also used for parts of the text.
STRONG = frozenset(
    """ad ads adsense adsbygoogle advert adverts advertisement advertising adbox adslot sponsor sponsored sponsors promo promos promoted cookie cookies consent
    gdpr newsletter subscribe subscription signup share sharing sharebar social sidebar sidenav related recommended recommendations trending nav navbar navi
    topnav breadcrumb breadcrumbs pagination pager footer comment comments commentlist disqus respond widget widgets""".split()
)
COMMENTS = frozenset("comment comments commentlist disqus respond".split())
#: Elements that hold running text.
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th tr thead tbody tfoot blockquote pre figcaption caption".split())
#: Names that also describe the layout of wrappers, and names of wrappers that hold an article's text.
LAYOUTS = frozenset("ad ads aside banner header menu modal nav overlay promo search share sidebar social toc widget widgets".split())
WRAPPERS = frozenset("article content main body text story post entry page layout wrapper container".split())
#: Elements that do not end a block.
UNBROKEN = INLINE | RAW | {"noscript", "template", "svg", "math", "button", "select", "object", "embed", "canvas", "audio", "video"}

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/><]*)((?:[^<>\"']|\"[^\"]*+\"|'[^']*+'|[\"'])*+)>", re.S)
ATTRIBUTE = re.compile(r"(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
PRIME = (1 << 61) - 1
BASE = 0x1F3D5B79A1C3E5F7 % PRIME


class Page:
    """A page's elements in document order, and its events: an open (index), a close (~index) or a text."""

    def __init__(self, source: str) -> None:
        self.tag: list[str] = ["#root"]
        self.style: list[str] = ["#root"]  # presentation: tag, role and classes
        self.names: list[frozenset[str]] = [frozenset()]
        self.named: list[frozenset[str]] = [frozenset()]  # words for boilerplate of names that say nothing else
        self.strong: list[frozenset[str]] = [frozenset()]  # those that hold inside an article: of classes, and of ids for comments
        self.within: list[bool] = [False]  # an article or main, or inside one
        self.role: list[str] = [""]
        self.parent: list[int] = [-1]
        self.events: list[int | str] = [0]
        self._build(source)

    def _build(self, source: str) -> None:
        stack, open_count = [0], {"#root": 1}
        events, at, n = self.events, 0, len(source)

        def close(depth: int) -> None:
            while len(stack) > depth:
                k = stack.pop()
                open_count[self.tag[k]] -= 1
                events.append(~k)

        def close_nearest(tags: tuple[str, ...], stop: tuple[str, ...]) -> None:
            if any(open_count.get(t) for t in tags):
                for depth in range(len(stack) - 1, 0, -1):
                    name = self.tag[stack[depth]]
                    if name in tags:
                        return close(depth)
                    if name in stop:
                        return None
            return None

        while at < n:
            m = TAG.search(source, at)
            if m is None:
                events.append(source[at:])
                break
            if m.start() > at:
                events.append(source[at : m.start()])
            at = m.end()
            name = m[2]
            if not name:
                continue
            name = name.lower()
            if m[1]:
                if open_count.get(name):
                    depth = len(stack) - 1
                    while self.tag[stack[depth]] != name:
                        depth -= 1
                    close(depth)
                continue
            if name == "body" or (open_count.get("head") and name not in RAW and name not in VOID and name not in ("head", "noscript", "template")):
                close_nearest(("head",), ())
            if name in CLOSES_P and open_count.get("p"):
                close_nearest(("p",), ("table", "td", "th", "div", "section", "article", "button"))
            if name in SIBLINGS:
                same, stop = SIBLINGS[name]
                close_nearest(tuple(same.split()), tuple(stop.split()))
            k = self._element(name, m[3], stack[-1])
            events.append(k)
            if name in VOID or m[3].endswith("/") and name in ("svg", "path"):
                events.append(~k)
            elif name in RAW:
                end = re.compile(rf"</{re.escape(name)}\b[^>]*>?", re.I).search(source, at)
                if name in ("textarea", "title"):
                    events.append(source[at : end.start() if end else n])
                events.append(~k)
                at = end.end() if end else n
            else:
                stack.append(k)
                open_count[name] = open_count.get(name, 0) + 1
        close(0)

    def _element(self, name: str, attributes: str, parent: int) -> int:
        classes, role, names, named, strong = "", "", set(), set(), set()
        if attributes and "=" in attributes:
            for key, *values in ATTRIBUTE.findall(attributes):
                value = html_library.unescape("".join(values))
                if key.lower() == "role":
                    role = value.strip().lower()
                else:
                    for token in value.split():
                        parts = {p.lower() for p in NAME.findall(token)} | ({token.lower()} & DROPPED_NAMES)
                        names |= parts
                        if all(p in DROPPED_NAMES or p in NEUTRAL or p.isdigit() or len(p) == 1 for p in parts):
                            named |= parts & DROPPED_NAMES
                            strong |= parts & (STRONG if key.lower() == "class" else COMMENTS)
                    if key.lower() == "class":
                        classes = ".".join(sorted(value.split()))
        self.tag.append(name)
        self.style.append(f"{name}/{role}/{classes}")
        self.names.append(frozenset(names))
        self.named.append(frozenset(named))
        self.strong.append(frozenset(strong))
        self.within.append(self.within[parent] or name in ("article", "main") or role == "main")
        self.role.append(role)
        self.parent.append(parent)
        return len(self.tag) - 1

    def measure(self, site: str = "") -> None:
        """For every element: its path on a site, the feature of its layout and the length of the text below it; for every text its feature."""
        count = len(self.tag)
        self.path, self.layout, self.length = [0] * count, [0] * count, [0] * count
        self.texts: list[tuple[int, int, int]] = []  # element, feature, length
        layouts = n_layouts = 0
        powers = [1]
        at_open: dict[int, tuple[int, int]] = {}
        at: list[int] = []

        def power(k: int) -> int:
            while len(powers) <= k:
                powers.append(powers[-1] * BASE % PRIME)
            return powers[k]

        for e in self.events:
            if isinstance(e, str):
                clean = " ".join(html_library.unescape(e).split())
                if clean:
                    self.texts.append((at[-1], xxhash.xxh3_64_intdigest(clean, seed=self.path[at[-1]]), len(clean)))
                    self.length[at[-1]] += len(clean)
            elif e >= 0:
                up = self.path[self.parent[e]] if e else xxhash.xxh3_64_intdigest(site)
                self.path[e] = xxhash.xxh3_64_intdigest(self.style[e], seed=up)
                layouts = (layouts * BASE + xxhash.xxh3_64_intdigest(self.style[e]) % PRIME) % PRIME
                n_layouts += 1
                at_open[e] = layouts, n_layouts
                at.append(e)
            else:
                s, ns = at_open.pop(~e)
                below = (layouts - s * power(n_layouts - ns)) % PRIME
                self.layout[~e] = xxhash.xxh3_64_intdigest(below.to_bytes(8), seed=self.path[~e])
                at.pop()
        for k in range(count - 1, 0, -1):
            self.length[self.parent[k]] += self.length[k]
        self.importance = [1.0] * count

    def features(self) -> tuple[list[int], list[int]]:
        """(path, feature) of the layouts and texts that the style tree counts, each once; a path itself counts its pages."""
        found = {(self.path[k], self.layout[k]) for k in range(1, len(self.tag)) if self.branch(k) and self.length[k]}
        found |= {(self.path[k], feature) for k, feature, _ in self.texts}
        found |= {(path, path) for path, _ in found}
        return [p for p, _ in found], [f for _, f in found]

    def weigh(self, shared: dict[int, float]) -> None:
        """Set the importance of every element from that of the features that pages share."""
        sums = [0.0] * len(self.tag)
        for k, feature, n in self.texts:
            sums[k] += n * shared.get(feature, 1.0)
        for k in range(len(self.tag) - 1, 0, -1):
            sums[self.parent[k]] += sums[k]
            if self.length[k]:
                self.importance[k] = (1 - GAMMA) * shared.get(self.layout[k], 1.0) + GAMMA * sums[k] / self.length[k]

    def gone(self, k: int, whole: int) -> bool:
        """Whether an element is no part of the main text, by its tag, role or names, or by the style tree."""
        if self.dropped(k, whole):
            return True
        least = LEAST_NAMED if self.names[k] & DROPPED_NAMES else LEAST_IMPORTANCE
        return self.importance[k] < least and self.branch(k) and 2 * self.length[k] < whole

    def dropped(self, k: int, whole: int) -> bool:
        """Whether an element's tag, role or names mark it as no part of an article's text.

        A wrapper's names do not count where it holds half of the ``whole`` text, nor does a form that does. Inside an article or main
        few names count, and none on elements of running text.
        """
        if self.tag[k] == "form" or self.role[k] in ("form", "search"):
            return 2 * self.length[k] < whole
        if self.tag[k] in DROPPED or self.role[k] in DROPPED_ROLES:
            return True
        inside = k > 0 and self.within[self.parent[k]]
        found = self.strong[k] if inside else self.named[k]
        if inside and (self.tag[k] in TEXTUAL or self.tag[k] == "header"):
            return False
        if found:
            return not (self.named[k] <= LAYOUTS and self.names[k] & WRAPPERS and 2 * self.length[k] >= whole)
        return self.tag[k] == "header"

    def key(self) -> int:
        """What tells pages apart: the main text as it is without the style tree, or all text where there is none."""
        return xxhash.xxh3_64_intdigest(self.text() or repr([feature for _, feature, _ in self.texts]))

    def branch(self, k: int) -> bool:
        """Whether the style tree may remove an element: a container or anything with a class."""
        return self.tag[k] not in INLINE and k > 0 and (self.tag[k] not in PLAIN or self.style[k].count("/") == 2 and not self.style[k].endswith("/"))

    def roots(self) -> list[int]:
        """The elements that hold the main text, in page order: main and the articles outside it, where they hold half of the text of
        the body that is kept; without main all outermost articles, by the same rule; else the body.
        """
        count = len(self.tag)
        whole, body = self.length[0], 0
        out, kept = [False] * count, [0] * count
        found: dict[str, list[int]] = {"article": [], "main": []}
        within = {kind: [False] * count for kind in found}
        for k in range(count):  # parents come first
            up = self.parent[k]
            kind = "main" if self.role[k] == "main" else self.tag[k]
            gone = self.gone(k, whole)
            out[k] = k > 0 and out[up] or kind not in ("main", "body", "html") and gone
            for name, inside in within.items():
                inside[k] = k > 0 and inside[up]
                if kind == name and not out[k] and not inside[k]:
                    inside[k] = True
                    found[name].append(k)
            if kind == "body" and not out[k] and (not body or self.length[k] > self.length[body]):
                body = k
        at = [0]
        for e in self.events:
            if isinstance(e, str):
                if not out[at[-1]]:
                    kept[at[-1]] += len(" ".join(html_library.unescape(e).split()))
            elif e > 0:
                at.append(e)
            elif e < -1:
                at.pop()
        for k in range(count - 1, 0, -1):
            kept[self.parent[k]] += kept[k]
        articles, mains = ([k for k in found[kind] if kept[k]] for kind in ("article", "main"))
        size = lambda ks: sum(kept[k] for k in ks)
        # main and the articles outside it; articles around it count as a whole
        wide = sorted([k for k in mains if not within["article"][k]] + [k for k in articles if not within["main"][k]])
        if mains and 2 * size(wide) >= kept[0]:
            return wide
        if articles and 2 * size(articles) >= kept[0]:
            return articles
        return [body if kept[body] == kept[0] else 0]

    def text(self) -> str:
        """Blocks of the main text."""
        roots = set(self.roots())
        whole = 0
        blocks: list[str] = []
        words: list[str] = []
        skipping = None

        def flush() -> None:
            if line := " ".join("".join(words).split()):
                blocks.append(line)
            words.clear()

        inside = False
        for e in self.events:
            if isinstance(e, str):
                if inside and skipping is None:
                    words.append(html_library.unescape(e))
                continue
            k = e if e >= 0 else ~e
            if k in roots:
                inside, whole = e >= 0, self.length[k]
                flush()
                continue
            if not inside:
                continue
            if skipping is None and e >= 0:
                if self.gone(k, whole):
                    skipping = k
            if skipping is None:
                if self.tag[k] in UNBROKEN:
                    if self.tag[k] == "br" and e >= 0:
                        words.append(" ")
                elif self.tag[k] in ("td", "th"):
                    words.append(" ")
                else:
                    flush()
            elif e < 0 and k == skipping:
                skipping = None
                if self.tag[k] not in UNBROKEN:
                    flush()
        flush()
        return "\n".join(blocks)


def host_of(url):
    """Lower-case host of a URL column, '' where there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def signed(values: list[int]) -> pa.Array:
    """Unsigned 64-bit numbers as Spark's longs."""
    return pa.array(np.array(values, np.uint64).view(np.int64))


def site_features(pages: DataFrame) -> DataFrame:
    """(own, page, path, feature) of pages (own, host, html): the features of every page; ``page`` is equal for mirrored pages of a host."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, keys, paths, found = [], [], [], []
            for i, (host, source) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2), strict=True)):
                page = Page(source.as_py())
                page.measure(host)
                path, feature = page.features()
                rows += [i] * len(path)
                keys += [page.key()] * len(path)
                paths += path
                found += feature
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), signed(keys), signed(paths), signed(found)], names=["own", "page", "path", "feature"])

    return pages.select("own", "host", "html").mapInArrow(run, "own long, page long, path long, feature long")


def shared_features(found: DataFrame) -> DataFrame:
    """(feature, importance) of the features on two pages or more of their node."""
    times = found.select("page", "path", "feature").distinct().groupBy("path", "feature").agg(F.count("*").alias("d"))
    pages = times.where("path = feature").select("path", F.col("d").alias("m"))
    oft = times.where("path != feature and d > 1").join(pages, "path")
    importance = 1 - F.log("d") / F.log(F.col("m") + 0.5)
    return oft.select("feature", F.greatest(importance, F.lit(0.0)).cast("float").alias("importance"))


def main_text(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", most: int = MAX_SHARED) -> DataFrame:
    """One row per page: id, url, text and n_chars (long). Up to ``most`` shared features are broadcast."""
    scratch = Scratch(df.sparkSession, "sites")
    pages = df.select(
        F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), host_of(F.col(url_col)).alias("host"), F.coalesce(F.col(html_col), F.lit("")).alias("html")
    ).withColumn("own", F.xxhash64("page_id", "url", "html"))
    found = scratch.save(site_features(pages), "features")
    shared = scratch.save(shared_features(found), "shared")
    if shared.count() <= most:
        table = shared.toArrow()  # at most ``most`` rows of 12 bytes
        order = np.argsort(table["feature"].to_numpy())
        known = df.sparkSession.sparkContext.broadcast((table["feature"].to_numpy()[order], table["importance"].to_numpy()[order]))

        @F.arrow_udf("string")
        def extract(sources: pa.Array, hosts: pa.Array) -> pa.Array:
            features, importances = known.value
            out = []
            for source, host in zip(sources.to_pylist(), hosts.to_pylist(), strict=True):
                page = Page(source)
                page.measure(host)
                own = np.array([f for _, f, _ in page.texts] + page.layout, np.uint64).view(np.int64)
                at = np.searchsorted(features, own)
                at[at == len(features)] = 0
                hit = np.flatnonzero(features[at] == own) if len(features) else []
                page.weigh({int(own[k]) % (1 << 64): float(importances[at[k]]) for k in hit})
                out.append(page.text())
            return pa.array(out, pa.string())

        texts = pages.select(F.col("page_id").alias(id_col), F.col("url").alias(url_col), extract("html", "host").alias("text"))
    else:
        hits = found.select(F.col("own").alias("o"), "feature").distinct().join(shared, "feature")
        hits = hits.groupBy("o").agg(F.collect_list("feature").alias("features"), F.collect_list("importance").alias("importances"))

        @F.arrow_udf("string")
        def extract(sources: pa.Array, hosts: pa.Array, features: pa.Array, importances: pa.Array) -> pa.Array:
            out = []
            for source, host, own, weights in zip(*(c.to_pylist() for c in (sources, hosts, features, importances)), strict=True):
                page = Page(source)
                page.measure(host)
                page.weigh(dict(zip([f % (1 << 64) for f in own or ()], weights or (), strict=True)))
                out.append(page.text())
            return pa.array(out, pa.string())

        joined = pages.join(hits, F.col("own") == F.col("o"), "left")
        texts = joined.select(F.col("page_id").alias(id_col), F.col("url").alias(url_col), extract("html", "host", "features", "importances").alias("text"))
    return texts.withColumn("n_chars", F.length("text").cast("long"))
