"""One linear scan of a page's markup: nested, hidden and unclosed elements, which regular expressions cannot follow.

A page becomes a flat list of tokens with a mask of those that a reader does not see. Everything that depends on the
nesting of elements (hidden parts, menus inside menus, the element that holds the main text, embedded state) is read off
that list; what does not is left to the column expressions beside it. The scan runs in Arrow batches; the columns that
it gives are a page's scope and its embedded JSON.

Cases: null html is the empty page; an element without an end runs to the end of the page; a close without an element
is ignored; an opening bracket that begins no tag is text.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from typing import Any, NamedTuple

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .html import ENTITIES, NUMBER_GLUE, STATE_KEYS

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/><]*)((?:[^<>"']++|"[^"]*+"|'[^']*+')*+)>|<[!?/][^<>]*+>""", re.S)
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
REFERENCE = re.compile(r"&(?:#([0-9]{1,7})|#[xX]([0-9a-fA-F]{1,6})|([A-Za-z][A-Za-z0-9]*));")
BLANKS = re.compile("[ \\t\\n\\x0b\\f\\r\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff]+")
GLUE = [(re.compile(pattern), put.replace("$", "\\")) for pattern, put in NUMBER_GLUE]
# The call by which a page's own script reveals a streamed part.
REVEAL = re.compile(r"\$RC\s*\([^)]*\)")
DECLARED = re.compile(r"(?i)(?:^|;)\s*display\s*:\s*([^;!]*)")
# Elements without content, elements whose content is no markup, and names of elements that hold a page's text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INERT = frozenset("script style noscript template title textarea".split())
CONTAINER_IDS = frozenset(
    """content bodycontent mw-content-text mw-body-content main-content page-content layout-content primary-content maincol main-column content-body page-body
    mainbody documentation docs-content docs-body article-body dokuwiki__content""".split()
)
CONTAINER_CLASSES = frozenset("entry-content post-content article-content markdown-body td-content document body-content refentry mw-body theme-doc-markdown".split())
# Bounds of the choice of a scope.
MAIN_FACTOR, SKELETON_FACTOR, SKELETON_CHARS = 1.5, 5, 1000
CONTAINERS, COMPARED, LEAST_CHARS, LEAST_SHARE = 16, 3, 200, 0.7
UNSAFE_KEYS = frozenset(("__proto__", "constructor", "prototype"))
JSON_SCRIPTS, STATE_MARKS, STATE_CHARS = 256, 32, 256 * 1024


def attributes(raw: str) -> dict[str, str]:
    """Attributes of a start tag by lower-case name; the first of a name counts, unsafe names are left out."""
    out: dict[str, str] = {}
    for name, *values in ATTRIBUTE.findall(raw):
        if name.lower() not in UNSAFE_KEYS:
            out.setdefault(name.lower(), decoded("".join(values)))
    return out


def decoded(text: str) -> str:
    """Character references decoded once; unknown ones stay."""
    if "&" not in text:
        return text

    def value(m: re.Match) -> str:
        if m[3]:
            return ENTITIES.get(m[3], ENTITIES.get(m[3].lower(), m[0]))
        point = int(m[1]) if m[1] else int(m[2], 16)
        return chr(point) if 0 < point < 0x110000 and not 0xD800 <= point < 0xE000 else m[0]

    return REFERENCE.sub(value, text)


def shown(text: str) -> str:
    """Text as a reader sees it: references decoded, white space collapsed, split numbers put together."""
    text = BLANKS.sub(" ", decoded(text)).strip(" ")
    for pattern, into in GLUE:
        text = pattern.sub(into, text)
    return text


def rules(css: str) -> Iterator[tuple[str, str]]:
    """(selectors, body) of a style sheet's own rules; at-rules are passed over with all that they hold."""
    plain, at = [], 0
    while (start := css.find("/*", at)) >= 0:
        plain.append(css[at:start])
        end = css.find("*/", start + 2)
        at = len(css) if end < 0 else end + 2
    css = " ".join([*plain, css[at:]])
    last = depth = 0
    selectors = ""
    for m in re.finditer(r"[{}]", css):
        if depth:  # inside an at-rule
            depth += 1 if m[0] == "{" else -1
        elif m[0] == "{":
            selectors = css[last : m.start()].rpartition(";")[2].strip()
            depth = selectors.startswith("@")
        elif selectors:
            yield selectors, css[last : m.start()]
            selectors = ""
        last = m.end()


# Media that are no screen.
NO_SCREEN = "print|speech|tv|tty"


def hidden_classes(styles: list[tuple[dict[str, str], str]]) -> set[str]:
    """Classes that the style elements of a screen hide by a selector of the class alone; the last rule of a class counts."""
    last: dict[str, bool] = {}
    for own, css in styles:
        media = own.get("media", "").strip().lower()
        screen = not media or re.search(rf"\bnot\s+(?:{NO_SCREEN})\b", media) or not re.search(r"\bnot\s+screen\b", media) and (
            re.search(r"\b(?:screen|all)\b", media) or not re.search(rf"\b(?:{NO_SCREEN})\b", media)
        )
        if not screen or own.get("type", "").strip().lower() not in ("", "text/css"):
            continue
        for selectors, body in rules(css):
            hides = any(v.strip().lower() == "none" for v in DECLARED.findall(body))
            for one in selectors.split(","):
                if m := re.fullmatch(r"\.([A-Za-z0-9_-]+)", one.strip()):
                    last[m[1]] = hides
    return {name for name, hides in last.items() if hides}


class Page:
    """Tokens of a page: ``kind`` (text, open, close, void, comment, inert), ``name``, ``raw`` and the attributes of tags."""

    def __init__(self, source: str) -> None:
        self.kind: list[str] = []
        self.name: list[str] = []
        self.raw: list[str] = []
        self.own: list[str] = []
        self.scripts: list[tuple[str, str]] = []  # attributes and content
        self.styles: list[tuple[str, str]] = []
        at, last, absent = 0, source.rfind(">"), set()
        low = source.lower()
        while at < len(source):
            m = TOKEN.search(source, at) if at <= last or source.find("<!--", at) >= 0 else None
            if m is None:
                self._add("text", "", source[at:])
                break
            if m.start() > at:
                self._add("text", "", source[at : m.start()])
            at = m.end()
            name = (m[2] or "").lower()
            if not name:
                self._add("comment", "", m[0])
            elif m[1]:
                self._add("close", name, m[0])
            elif name in INERT:
                end = stop = len(source)
                if name not in absent and (c := re.compile(rf"</{name}(?=[\s/>])[^>]*>?").search(low, at)):
                    end, stop = c.start(), c.end()
                else:
                    absent.add(name)  # not looked for again
                if name == "textarea":
                    self._add("text", "", " " + source[at:end].replace("<", "&lt;") + " ")
                else:
                    if name in ("script", "style"):
                        (self.scripts if name == "script" else self.styles).append((m[3], source[at:end]))
                    self._add("inert", name, source[m.start() : stop])
                at = stop
            else:
                self._add("void" if name in VOID or m[3].endswith("/") else "open", name, m[0], m[3])
        self.off = [k == "inert" for k in self.kind]
        self.put = [" " if k in ("inert", "comment") else "" for k in self.kind]  # what stands for a masked token

    def _add(self, kind: str, name: str, raw: str, own: str = "") -> None:
        self.kind.append(kind)
        self.name.append(name)
        self.raw.append(raw)
        self.own.append(own)

    def revealed(self) -> set[str]:
        """Ids of the streamed parts that the page's own scripts reveal."""
        return {i for _, content in self.scripts for call in REVEAL.findall(content) for i in re.findall(r"\bS:\d+\b", call)}

    def hide(self, revealed: set[str]) -> None:
        """Mask hidden elements with all that they hold; an inline display decides before classes and attributes."""
        classes = hidden_classes([(attributes(own), css) for own, css in self.styles])

        def hides(raw: str) -> bool:
            if not re.search(r"(?i)hidden|display|class", raw):
                return False
            own = attributes(raw)
            if found := DECLARED.findall(own.get("style", "")):
                return found[0].strip().lower() == "none"
            if classes and classes & set(own.get("class", "").split()):
                return True
            if "hidden" in own:
                return own.get("id") not in revealed
            return own.get("display", "").strip().lower() == "none"

        stack: list[str] = []
        depth = -1  # of the hidden element
        held: dict[str, int] = {}
        for k, kind in enumerate(self.kind):
            if kind == "open":
                if depth < 0 and hides(self.own[k]):
                    depth, self.put[k] = len(stack), " "
                elif depth >= 0:
                    self.put[k] = ""
                stack.append(self.name[k])
                held[self.name[k]] = held.get(self.name[k], 0) + 1
            elif kind == "close" and held.get(self.name[k]):
                while True:
                    name = stack.pop()
                    held[name] -= 1
                    if name == self.name[k]:
                        break
                if depth >= len(stack):
                    depth = -1
                    self.off[k] = True
            elif depth >= 0:
                self.put[k] = ""
            elif kind == "void" and hides(self.own[k]):
                self.off[k], self.put[k] = True, " "
            if depth >= 0:
                self.off[k] = True

    def drop(self, *names: str) -> None:
        """Mask elements of these names, each with those of its name inside it; one without an end hides the rest."""
        for name in names:
            depth = 0
            for k, own in enumerate(self.name):
                if own == name and not self.off[k] and self.kind[k] in ("open", "close"):
                    self.put[k] = " " if self.kind[k] == "open" and not depth else ""
                    depth += 1 if self.kind[k] == "open" else -1 if depth else 0
                    self.off[k] = True
                elif depth:
                    self.off[k], self.put[k] = True, ""

    def elements(self, name: str) -> list[tuple[int, int]]:
        """Spans of tokens inside the elements of a name: the first close ends one, without a close it runs to the end."""
        out, end = [], 0
        closes = [k for k, own in enumerate(self.name) if own == name and self.kind[k] == "close" and not self.off[k]][::-1]
        for k, own in enumerate(self.name):
            if own == name and self.kind[k] == "open" and not self.off[k] and k >= end:
                while closes and closes[-1] < k:
                    closes.pop()
                end = closes[-1] if closes else len(self.name)
                out.append((k + 1, end))
        return out

    def containers(self, name: str, start: int, stop: int) -> list[tuple[int, int]]:
        """Spans of the first elements of a name, nested ones counted, whose id or class is that of a text's container."""
        ends, stack = {}, []
        for k in range(start, stop):
            if self.name[k] == name and not self.off[k]:
                if self.kind[k] == "open":
                    stack.append(k)
                elif self.kind[k] == "close" and stack:
                    ends[stack.pop()] = k
        out = []
        for k in range(start, stop):
            if self.name[k] == name and self.kind[k] == "open" and not self.off[k]:
                own = attributes(self.own[k])
                if own.get("id", "").lower() in CONTAINER_IDS or CONTAINER_CLASSES & set(own.get("class", "").lower().split()):
                    out.append((k + 1, ends.get(k, stop)))
                    if len(out) == CONTAINERS:
                        break
        return out

    def html(self, span: tuple[int, int]) -> str:
        return "".join(self.put[k] if self.off[k] else self.raw[k] for k in range(*span))

    def text(self, span: tuple[int, int]) -> str:
        """Visible text of a span; of a drawing only its painted text elements."""
        parts: list[str] = []
        drawing = painting = 0
        unpainted = ""
        for k in range(*span):
            kind, name = self.kind[k], self.name[k]
            if kind == "text":
                if not self.off[k] and (not drawing or painting):
                    parts.append(self.raw[k])
                continue
            parts.append(" ")
            if name == "svg" and kind != "void":
                drawing = 1 if kind == "open" and self._ends("svg", k, span[1]) else 0
                painting, unpainted = 0, ""
            elif drawing and name in ("defs", "symbol"):
                unpainted = name if kind == "open" and not unpainted else "" if kind == "close" and name == unpainted else unpainted
            elif drawing and name == "text" and kind != "void":
                own = attributes(self.own[k])
                painting = kind == "open" and not unpainted and own.get("display", "").lower() != "none" and own.get("visibility", "").lower() != "hidden"
        return shown("".join(parts))

    def _ends(self, name: str, at: int, stop: int) -> bool:
        if not hasattr(self, "last"):
            self.last = {n: k for k, n in enumerate(self.name) if self.kind[k] == "close"}
        return at < self.last.get(name, -1) < stop

    def body(self) -> tuple[int, int]:
        """The body's span, or all but the head."""
        if found := self.elements("body"):
            return found[0]
        heads = self.elements("head")
        for start, end in heads[:1]:
            if end < len(self.name):
                self.off[start - 1 : end + 1] = [True] * (end + 2 - start)
        return 0, len(self.name)


def scope_of(source: str) -> dict[str, str]:
    """kind, html and text of the part of a page that holds its content."""
    page = Page(source)
    revealed = page.revealed()
    page.hide(revealed)
    page.drop("aside", "nav")
    footers = list(page.off)
    page.drop("footer")
    articles, mains = page.elements("article"), page.elements("main")
    chosen = None
    if articles or mains:
        texts = {span: page.text(span) for span in {*articles, *mains}}
        size = lambda span: len(texts[span])
        article, main = articles[0] if articles else None, max(mains, key=size) if mains else None
        if article and revealed and size(article) <= SKELETON_CHARS:
            richest = max(articles, key=size)
            article = richest if size(richest) >= SKELETON_FACTOR * size(article) else article
        kind = "main" if main and (not article or size(main) >= MAIN_FACTOR * size(article)) else "article"
        chosen = main if kind == "main" else article
        return {"kind": kind, "html": page.html(chosen), "text": texts[chosen]}
    page.off = footers
    kind, chosen = "body", page.body()
    found = [span for name in ("div", "section") for span in page.containers(name, *chosen)]
    text = page.text(chosen)
    if found and text:
        found.sort(key=lambda span: -sum(len(page.raw[k]) for k in range(*span)))
        texts = [(page.text(span), span) for span in found[:COMPARED]]
        best = max((t for t in texts if len(t[0]) >= LEAST_CHARS), key=lambda t: len(t[0]), default=None)
        if best and len(best[0]) >= LEAST_SHARE * len(text):
            kind, (text, chosen) = "container", best
    return {"kind": kind, "html": page.html(chosen), "text": text}


def balanced(source: str, start: int) -> str | None:
    """The object or array that begins at a place, up to its end; null where it does not end within ``STATE_CHARS``."""
    if source[start : start + 1] not in ("{", "["):
        return None
    stack: list[str] = []
    for m in re.compile(r'"(?:[^"\\]|\\.)*+"|[{}\[\]]', re.S).finditer(source, start, start + STATE_CHARS + 1):
        if m[0] in ("{", "["):
            stack.append("}" if m[0] == "{" else "]")
        elif stack and m[0] == stack[-1]:
            stack.pop()
            if not stack:
                return source[start : m.end()]
    return None


def safe_json(text: str) -> tuple[str | None, list[tuple[str, str]]]:
    """JSON text without unsafe keys, and what was wrong: null for what cannot be parsed."""
    dropped: dict[str, None] = {}

    def kept(pairs: list) -> dict:
        dropped.update((k, None) for k, _ in pairs if k in UNSAFE_KEYS)
        return {k: v for k, v in pairs if k not in UNSAFE_KEYS}

    def refuse(name: str) -> None:
        raise ValueError(name)

    try:
        value = json.loads(text, object_pairs_hook=kept, parse_constant=refuse)
    except (ValueError, RecursionError):
        return None, [("invalid_json", "Embedded JSON could not be parsed safely")]
    return json.dumps(value, ensure_ascii=False, separators=(",", ":")), [("unsafe_json_key", f"Unsafe embedded JSON key ignored: {k}") for k in dropped]


ASSIGNED = re.compile("(?:(?:window|globalThis|self)\\s*\\.\\s*)?(" + "|".join(k for k in STATE_KEYS if k != "__NEXT_DATA__") + ")\\s*=\\s*")


OPENED = re.compile(r"(?://)?+\s*+(?:/\*)?+\s*+<!\[CDATA\[\s*+(?:\*/)?+")
CLOSED = re.compile(r"\]\]>\s*+(?:\*/)?\Z")


def without_cdata(text: str) -> str:
    """A script's text without CDATA marks around it, and without the comment marks around these."""
    text = text.strip()
    if m := OPENED.match(text):
        text = text[m.end() :]
    if m := CLOSED.search(text):
        text = text[: m.start()].rstrip().removesuffix("/*").rstrip().removesuffix("//")
    return text.strip()


def embedded(source: str) -> dict:
    """JSON-LD texts, application state by key, and errors of both."""
    linked, state, errors, unnamed = [], {}, [], 0
    for raw, content in Page(source).scripts:
        own = attributes(raw)
        media = own.get("type", "").split(";")[0].strip().lower()
        found: list[tuple[str, str]] = []
        if media == "application/ld+json":
            value, issues = safe_json(without_cdata(content))
            linked += [value] if value is not None else []
            errors += [("invalid_json_ld" if code == "invalid_json" else code, message) for code, message in issues]
        elif media == "application/json" and content.strip():
            key = own.get("id") or None
            if key is None and unnamed < JSON_SCRIPTS:
                key, unnamed = f"__json_script_{unnamed}__", unnamed + 1
            if key and key not in UNSAFE_KEYS:
                found.append((key, content.strip()))
        for n, m in enumerate(ASSIGNED.finditer(content) if "__" in content else ()):  # every key begins so
            if n < STATE_MARKS and (literal := balanced(content, m.end())):
                found.append((m[1], literal))
        for key, text in found:
            value, issues = safe_json(text)
            if value is not None:
                state[key] = value
            errors += [("invalid_app_state" if code == "invalid_json" else code, f"{key}: {message}") for code, message in issues]
    return {"json_ld": linked, "state": list(state.items()), "errors": [{"code": c, "message": m} for c, m in errors]}


#: Pages whose results are Python objects at a time.
SLICE = 256


def _rows(texts: pa.Array) -> Iterator[str]:
    return (t.as_py() or "" for t in texts)


def _column(texts: pa.Array, kind: pa.DataType, read: Callable[[str], Any]) -> pa.Array:
    """``read`` of every page of a batch. A slice at a time becomes Arrow, so that what a batch needs beside its columns does not grow with its rows.

    The empty page is read once a batch: rows that a plan passes by have it.
    """
    empty: list = []

    def of(text: str) -> Any:
        if text:
            return read(text)
        if not empty:
            empty.append(read(""))
        return empty[0]

    parts = [pa.array([of(t) for t in _rows(texts.slice(k, SLICE))], kind) for k in range(0, len(texts), SLICE)]
    return pa.concat_arrays(parts) if parts else pa.array([], kind)


def scope(html: Column) -> Column:
    """struct(kind, html, text): the first article, the longest main, a named container or the body, without what a reader does not see."""
    kind = pa.struct([("kind", pa.string()), ("html", pa.string()), ("text", pa.string())])

    @F.arrow_udf("struct<kind: string, html: string, text: string>")
    def scan(texts: pa.Array) -> pa.Array:
        return _column(texts, kind, scope_of)

    return scan(html)


def embedded_json(html: Column) -> Column:
    """struct(json_ld, state, errors): the page's JSON-LD texts, its application state as a map of JSON texts, and what could not be read."""
    kind = pa.struct([("json_ld", pa.list_(pa.string())), ("state", pa.map_(pa.string(), pa.string())), ("errors", pa.list_(pa.struct([("code", pa.string()), ("message", pa.string())])))])

    @F.arrow_udf("struct<json_ld: array<string>, state: map<string,string>, errors: array<struct<code: string, message: string>>>")
    def scan(texts: pa.Array) -> pa.Array:
        return _column(texts, kind, embedded)

    return scan(html)


class Reading(NamedTuple):
    """What is read off one page: its type in SQL and in Arrow, and how; readings do not see each other's masks."""

    sql: str
    arrow: pa.DataType
    read: Callable[[Page], Any]


def together(html: Column, **readings: Reading) -> Column:
    """struct of several readings of a page, of which one scan is made for all."""
    kind = pa.struct([(name, r.arrow) for name, r in readings.items()])

    @F.arrow_udf("struct<" + ", ".join(f"{name}: {r.sql}" for name, r in readings.items()) + ">")
    def scan(texts: pa.Array) -> pa.Array:
        return _column(texts, kind, lambda t: _read(t, readings))

    return scan(html)


def _read(source: str, readings: dict[str, Reading]) -> dict[str, Any]:
    page, out = Page(source), {}
    off, put = page.off, page.put
    for name, r in readings.items():
        page.off, page.put = list(off), list(put)
        out[name] = r.read(page)
    return out


def _alone(html: Column, reading: Reading) -> Column:
    @F.arrow_udf(reading.sql)
    def scan(texts: pa.Array) -> pa.Array:
        return _column(texts, reading.arrow, lambda t: reading.read(Page(t)))

    return scan(html)


def visible_reading() -> Reading:
    def read(page: Page) -> str:
        page.hide(page.revealed())
        return page.text(page.body())

    return Reading("string", pa.string(), read)


def visible(html: Column) -> Column:
    """Visible text of a whole page's body."""
    return _alone(html, visible_reading())


def start_tags_reading(name: str, limit: int | None = None) -> Reading:
    def read(page: Page) -> list[dict]:
        at, found = 0, []
        for k, raw in enumerate(page.raw):
            if page.name[k] == name and page.kind[k] in ("open", "void", "inert") and (limit is None or len(found) < limit):
                tag = TOKEN.match(raw)
                found.append({"attrs": list(attributes(tag[3]).items()), "start": at, "end": at + tag.end()})
            at += len(raw)
        return found

    kind = pa.list_(pa.struct([("attrs", pa.map_(pa.string(), pa.string())), ("start", pa.int32()), ("end", pa.int32())]))
    return Reading("array<struct<attrs: map<string,string>, start: int, end: int>>", kind, read)


def start_tags(html: Column, name: str, limit: int | None = None) -> Column:
    """array<struct(attrs, start, end)>: the start tags of a name in order, attributes by lower-case name, places in characters."""
    return _alone(html, start_tags_reading(name, limit))


def attribute_where(tags: Column, attribute: str, where: str, value: str) -> Column:
    """An attribute of the first of ``start_tags`` whose attribute ``where`` holds ``value`` among its words; null without one."""
    words = lambda t: F.split(F.lower(F.coalesce(t["attrs"][where], F.lit(""))), r"\s+")
    return F.get(F.filter(tags, lambda t: F.array_contains(words(t), value)), F.lit(0))["attrs"][attribute]


def first_attribute(html: Column, tag: str, attribute: str, where: str, value: str) -> Column:
    """An attribute of the first tag of a name whose attribute ``where`` holds ``value`` among its words; null without one."""
    return attribute_where(start_tags(html, tag), attribute, where, value)


def elements_reading(name: str) -> Reading:
    def read(page: Page) -> list[str]:
        page.off = [False] * len(page.off)
        return ["".join(page.raw[a:b]) for a, b in page.elements(name)]

    return Reading("array<string>", pa.list_(pa.string()), read)


def elements(html: Column, name: str) -> Column:
    """Contents of the elements of a name in order; the first close ends it, without one it runs to the end."""
    return _alone(html, elements_reading(name))


def _kept(mask: Callable[[Page], None]) -> Reading:
    def read(page: Page) -> str:
        page.off = [False] * len(page.off)
        mask(page)
        return page.html((0, len(page.raw)))

    return Reading("string", pa.string(), read)


def without_reading(*names: str) -> Reading:
    return _kept(lambda page: page.drop(*names))


def without(html: Column, *names: str) -> Column:
    """A page without elements of these names, each with those of its name inside it; one without an end takes the rest along."""
    return _alone(html, without_reading(*names))


def without_hidden_reading() -> Reading:
    return _kept(lambda page: page.hide(page.revealed()))


def without_hidden(html: Column) -> Column:
    """A page without its hidden elements and all that they hold; parts that its scripts reveal stay."""
    return _alone(html, without_hidden_reading())


def without_inert_reading() -> Reading:
    def mask(page: Page) -> None:
        page.off = [k == "inert" or k == "comment" and raw.startswith("<!--") for k, raw in zip(page.kind, page.raw, strict=True)]

    return _kept(mask)


def without_inert(html: Column) -> Column:
    """A page without comments, scripts, styles, templates and titles; a text area is its text."""
    return _alone(html, without_inert_reading())


def drawing_text_reading() -> Reading:
    return Reading("string", pa.string(), lambda page: " ".join(x for a, b in page.elements("svg") if (x := page.text((a - 1, min(b + 1, len(page.raw)))))))


def drawing_text(html: Column) -> Column:
    """Painted text of a page's drawings, in order."""
    return _alone(html, drawing_text_reading())


def without_verbose(text: str) -> str | None:
    """A JSON text without ``articleBody`` and ``description`` anywhere, and without what is empty then."""

    def kept(value):
        if isinstance(value, dict):
            inner = {k: kept(v) for k, v in value.items() if k not in ("articleBody", "description")}
            return {k: v for k, v in inner.items() if v is not None} or None
        if isinstance(value, list):
            return [v for v in map(kept, value) if v is not None] or None
        return value

    try:
        value = kept(json.loads(text))
    except (ValueError, RecursionError):
        return None
    return None if value is None else json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def lean_structure(json_text: Column) -> Column:
    """Structured data for a model's prompt: a JSON text without its long fields; null if nothing is left."""

    @F.arrow_udf("string")
    def strip(texts: pa.Array) -> pa.Array:
        return pa.array([None if t.as_py() is None else without_verbose(t.as_py()) for t in texts], pa.string())

    return strip(json_text)
