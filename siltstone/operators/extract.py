"""From stored responses to records: scope, text, structured data, evidence, verdicts, hashes.

One declarative plan over columns. Two linear scans in Arrow batches (``functions.markup``) give a page's scope with its
text, and its embedded JSON; all else is built-in expressions. Expensive ones are columns of their own and are referred
to, so each is computed once per page.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions import classify, html, markup, nodes, text, urls, weburl
from siltstone.functions.core import let, lookup

MAX_BODY, MAX_CHARS = 5 * 1024 * 1024, 5_000_000
NO_ERRORS = "array<struct<code: string, message: string>>"


def fetches_from_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Stored pages as responses: status 200, HTML, body as bytes."""
    body = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    return pages.select(
        F.col(id_col).alias("seed_id"), F.col(url_col).alias("url"), F.col(url_col).alias("final_url"), F.lit(200).alias("status"),
        F.lit("text/html; charset=utf-8").alias("content_type"), body.alias("body"), F.length(body).cast("long").alias("bytes"),
        F.array().cast("array<struct<url: string, status: int>>").alias("redirects"), F.array().cast(NO_ERRORS).alias("errors"),
    )


def capped_body(body: Column, limit: int = MAX_BODY) -> Column:
    """struct(body, truncated): the first ``limit`` bytes."""
    return F.struct(F.substring(body, 1, limit).alias("body"), (F.length(body) > limit).alias("truncated"))


# Labels of web pages' charsets and Python's names for what they mean.
CHARSETS = {
    "iso-8859-1": "cp1252", "latin1": "cp1252", "latin-1": "cp1252", "ascii": "cp1252", "us-ascii": "cp1252", "windows-1252": "cp1252", "cp1252": "cp1252", "x-cp1252": "cp1252",
    "utf-16": "utf-16-le", "utf-16le": "utf-16-le", "utf-16be": "utf-16-be", "gb2312": "gb18030", "gbk": "gb18030", "gb18030": "gb18030", "big5": "big5hkscs", "shift_jis": "cp932",
    "shift-jis": "cp932", "sjis": "cp932", "x-sjis": "cp932", "euc-jp": "euc_jp", "iso-2022-jp": "iso2022_jp", "euc-kr": "cp949", "ks_c_5601-1987": "cp949", "koi8-r": "koi8_r",
    "koi8-u": "koi8_u", "macintosh": "mac_roman", "windows-874": "cp874", "iso-8859-11": "cp874", "tis-620": "cp874", "iso-8859-9": "cp1254",
    **{f"windows-{n}": f"cp{n}" for n in (1250, 1251, 1253, 1254, 1255, 1256, 1257, 1258)}, **{f"iso-8859-{n}": f"iso8859_{n}" for n in (2, 3, 4, 5, 6, 7, 8, 10, 13, 14, 15, 16)},
}


def prescan(body: Column) -> Column:
    """The charset that a meta element among the first 1024 bytes declares, in lower case; null without one.

    Its ``charset`` attribute, else ``charset=`` in the ``content`` of one with ``http-equiv`` content-type; what looks like either inside another attribute's value or a comment
    is none, and a meta element that does not end before the cut ends the search.
    """
    head = F.lower(F.regexp_replace(F.decode(F.substring(body, 1, 1024), "ISO-8859-1"), r"[^\x00-\x7F]", "_"))
    plain = F.regexp_replace(head, r"(?s)<!--.*?(?:-->|\z)", " ")
    metas = F.regexp_extract_all(plain, F.lit(r"""(?s)<meta(?=[\s/>]|\z)(?:((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|.*\z)"""), F.lit(1))
    pair = r"""([^\s=/>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"'][^\s>]*)))?"""

    def declared(attributes: Column) -> Column:
        def of(pairs: Column) -> Column:
            value = lambda name: F.get(F.transform(F.filter(pairs, lambda p: F.regexp_extract(p, pair, 1) == name), lambda p: F.concat(*[F.regexp_extract(p, pair, k) for k in (2, 3, 4)])), F.lit(0))
            old = F.regexp_extract(value("content"), r"charset\s*=\s*([a-z0-9][a-z0-9_:.+\-]*)", 1)
            return F.coalesce(F.nullif(value("charset"), F.lit("")), F.nullif(F.when(F.trim(value("http-equiv")) == "content-type", old), F.lit("")))

        # a slash where a name could begin ends the attributes
        before = lambda found: F.slice(found, F.lit(1), F.array_position(found, "/") - 1)
        return let(let(F.array_append(F.regexp_extract_all(attributes, F.lit(f"(/|{pair})"), F.lit(1)), F.lit("/")), before), of)

    return F.get(F.array_compact(F.transform(metas, declared)), F.lit(0))


def decoded(body: Column, content_type: Column) -> Column:
    """Bytes as text: the header's charset, else a meta charset among the first 1024 bytes, else UTF-8.

    Unknown names go through UTF-8; bad bytes become replacement characters. Only bodies in another charset than UTF-8 leave
    the JVM.
    """
    name = F.coalesce(text.charset(content_type), F.when(text.is_html_type(content_type), prescan(body)), F.lit("utf-8"))
    other = lookup(CHARSETS, name)

    @F.arrow_udf("string")
    def decode(bodies: pa.Array, codecs: pa.Array) -> pa.Array:
        if codecs.null_count == len(codecs):
            return pa.nulls(len(codecs), pa.string())
        return pa.array([None if c.as_py() is None else b.as_py().decode(c.as_py(), "replace") for b, c in zip(bodies, codecs, strict=True)], pa.string())

    return F.coalesce(decode(F.when(other.isNotNull(), body), F.when(body.isNotNull(), other)), F.make_valid_utf8(body))


def with_canonical(page: DataFrame) -> DataFrame:
    """``page`` (link, final_url, url, errors) with ``canonical_url``: the link against the page's address, without fragment and user.

    A link that cannot be read is an error row. Step by step, since Spark resolves what is nested in one expression level by level.
    """
    # most pages have none, and a null address goes through all steps of reading unless it is left out here
    base = page.withColumn("__base", F.when(F.col("link").isNotNull(), weburl.parsed(F.coalesce("final_url", "url"))))
    found = base.withColumn("__link", F.when(F.col("link").isNotNull(), weburl.parsed(weburl.resolved(F.col("__base"), F.col("link")))))
    bad = F.col("link").isNotNull() & (F.col("__base.error").isNotNull() | F.col("__link.error").isNotNull())
    error = F.struct(F.lit("invalid_canonical_url").alias("code"), F.lit("Canonical URL could not be parsed safely").alias("message"))
    return found.withColumns({
        "canonical_url": F.when(F.col("link").isNotNull() & ~bad, weburl.shown(F.col("__link"))), "errors": F.when(bad, F.array_append("errors", error)).otherwise(F.col("errors")),
    }).drop("__base", "__link")


def extract(fetches: DataFrame) -> DataFrame:
    """One row per response with title, text, structured data, gate evidence and verdicts.

    Responses that are not HTML keep their body as text. Repeated and null bodies are as good as any. A column
    ``headers`` (map<string, array<string>>) is used for bot walls where there is one.
    """
    is_html = text.is_html_type(F.col("content_type"))
    page = fetches if "headers" in fetches.columns else fetches.withColumn("headers", F.create_map().cast("map<string,array<string>>"))
    page = page.withColumn("whole", decoded(F.coalesce("body", F.lit(b"")), F.col("content_type")))
    page = page.withColumn("source", html.capped(F.col("whole"), MAX_CHARS))
    page = page.withColumns({"scope": markup.scope(F.col("source")), "embedded": markup.embedded_json(F.when(is_html, F.col("source")))})
    page = page.withColumns({
        "text": F.when(is_html, F.col("scope.text")).otherwise(F.col("source")),
        "json_ld": F.col("embedded.json_ld"), "state": F.col("embedded.state"), "state_keys": F.map_keys("embedded.state"),
        "raw_title": F.when(is_html, html.title(F.col("source"))),
        "link": F.when(is_html, F.nullif(html.canonical_link(F.col("source")), F.lit(""))),
        "meta": F.when(is_html, html.meta(F.col("source"))),
        "script_count": html.tag_count(F.col("source"), "script"),
        "app_root_found": html.has_app_root(F.col("source")),
        "is_pin": urls.is_pin_page(F.coalesce("final_url", "url")),
        "errors": F.concat(
            F.col("embedded.errors"), F.coalesce("errors", F.array().cast(NO_ERRORS)),
            F.when(F.length("whole") > MAX_CHARS, F.array(F.struct(F.lit("extract_truncated").alias("code"), F.lit(f"Extraction input capped at {MAX_CHARS} chars").alias("message")))).otherwise(F.array().cast(NO_ERRORS)),
        ),
    })
    page = with_canonical(page)
    page = page.withColumn("walked", F.when(F.size("json_ld") > 0, nodes.walked(F.col("json_ld"))).otherwise(F.array().cast("array<struct<depth: int, node: variant>>")))
    linked = lambda value, kind: F.when(F.size("json_ld") > 0, value).otherwise(F.array().cast(kind))
    page = page.withColumns({
        "title": F.when(F.size("json_ld") > 0, nodes.preferred_title(F.col("raw_title"), F.col("json_ld"))).otherwise(F.col("raw_title")),
        "images": F.when(is_html, html.images(F.col("source"), F.coalesce("final_url", "url"), linked(nodes.image_addresses(F.col("json_ld")), "array<string>"), F.col("meta"))),
        "bearing": linked(nodes.bearing_of(F.col("walked"), F.col("is_pin")), "array<variant>"),
    })
    page = page.withColumns({"text_length": F.length("text"), "word_count": text.word_count(F.col("text"))})
    page = page.withColumns({
        "bearing_types": F.flatten(F.transform("bearing", lambda v: nodes.bearing_types(v, F.col("is_pin")))),
        "lead": F.when(F.size("json_ld") > 0, nodes.lead(F.col("bearing"), F.col("walked"), F.coalesce("final_url", "url"), _substantial(F.col("text"), F.col("word_count")))),
        "paywalled": F.when(F.size("json_ld") > 0, nodes.is_paywalled(F.col("json_ld"))).otherwise(False),
        "structured": classify.usable_structure(F.col("bearing"), F.col("state_keys")),
        "bot": classify.bot_signal(classify.bot_evidence(F.col("headers"), F.col("source"), F.col("status"))),
    })
    content = classify.has_content(F.col("scope.html"), F.col("text_length"), F.col("word_count"), F.col("scope.kind").isin("article", "main"))
    page = page.withColumn("gate", classify.gate(F.col("content_type"), F.col("structured"), content))
    kind = classify.content_kind(F.col("content_type"), F.col("bearing_types"), F.get(F.array(F.col("meta")["og:type"]), F.lit(0)), F.coalesce("final_url", "url"), F.col("gate.js_required"))
    return page.withColumns({
        "content_kind": kind, "code_text": text.status_text(F.col("status")),
        "resolved_via": classify.resolved_via(
            F.col("status"), F.col("content_type"), F.col("gate.reason"), F.col("json_ld"), F.col("state_keys"), F.coalesce(F.size("meta"), F.lit(0))
        ),
        "content_sha256": text.sha256(F.col("whole")),
    }).drop("bearing", "walked", "raw_title", "embedded", "whole", "link")


def records(extracted: DataFrame, output: str = "raw", fetched_at: str = "1970-01-01T00:00:00.000Z") -> DataFrame:
    """Final records of extracted pages: tier, access, quality, status and both hashes.

    The time is a parameter, so results can be repeated. A shell page that may not be rendered is a
    ``render-blocked`` record; a page that shows a challenge to bots is no content, whatever its text says.
    """
    walled = F.col("bot.signal").isNotNull()
    js = F.col("gate.js_required") & (F.col("status") < 400)
    rows = extracted.withColumns({
        "tier": F.when(js, "render-blocked").otherwise("1"),
        "result": F.when(F.col("lead").isNotNull() & (F.col("lead") != ""), F.concat_ws("\n\n", "lead", F.nullif("text", F.lit("")))).otherwise(F.col("text")),
        "errors": F.when(F.col("status") >= 400, F.array_append("errors", F.struct(F.lit("http_error").alias("code"), F.trim(F.concat(F.lit("HTTP "), F.col("status").cast("string"), F.lit(" "), F.col("code_text"))).alias("message")))).otherwise(F.col("errors")),
    })
    access = classify.access(F.col("tier"), F.col("status"), F.col("result"), js, F.col("errors"), walled, F.col("bot.provider"), F.col("paywalled"))
    quality = classify.content_quality(F.col("tier"), F.col("status"), F.col("result"), F.col("bytes"), F.size("bearing_types") > 0, walled)
    digest = text.provenance_hash(
        url=F.col("url"), finalUrl=F.col("final_url"), tier=F.col("tier"), code=F.col("status"), output=F.lit(output), resolvedVia=F.col("resolved_via"),
        jsRequired=js, contentSha256=F.col("content_sha256"), fetchedAt=F.lit(fetched_at),
    )
    return rows.withColumns({
        "access": access, "quality": quality, "provenance_hash": digest,
        "record_status": classify.record_status(F.col("tier"), F.col("status"), F.col("result"), F.col("errors"), F.lit(None).cast("string")),
    })


ATTEMPTS = "array<struct<step: int, tier: string, outcome: string, duration_ms: bigint, reason: string, status: int, bytes: bigint>>"
RENDERS = (
    "seed_id long, rendered boolean, code string, message string, status int, content_type string, dom_html string, render_ms long, egress_bytes long, hosts array<string>, "
    "actions array<struct<type: string, outcome: string, reason: string, method: string, resource: string, url: string>>"
)
# Names of the ways in which a page was resolved.
BY_RENDER, NO_RENDER, BLOCKED = "tier3-playwright", "render-unavailable", "render-blocked"
#: Prefix of a first record's columns beside those of the rendered page.
FIRST = "__first_"


def _attempt(tier: Column, outcome: Column, reason: Column, ms: Column | None = None, status: Column | None = None, size: Column | None = None) -> Column:
    none = F.lit(None)
    return F.struct(
        F.lit(3).alias("step"), tier.alias("tier"), outcome.alias("outcome"), F.coalesce(ms, F.lit(0)).cast("long").alias("duration_ms") if ms is not None else F.lit(0).cast("long").alias("duration_ms"), reason.alias("reason"),
        (none if status is None else status).cast("int").alias("status"), (none if size is None else size).cast("long").alias("bytes"),
    )


def _again(tried: DataFrame, shown: Column, body: Column, columns: list[str], **fetched: Column) -> DataFrame:
    """``tried`` with what the extraction of ``body`` gives where ``shown``; its own ``columns`` get the prefix ``FIRST``.

    Rows that are not shown stay in the same plan as empty texts of no address, which cost next to nothing, so the first extraction below runs once: rows read out, left out and put
    together again would be extracted for every one of these.
    """
    none = F.array().cast(NO_ERRORS)
    answer = {
        "url": F.col("url"), "final_url": F.col("final_url"), "status": F.col("status"), "content_type": F.lit("text/html"), "body": body.cast("binary"), "redirects": F.col("redirects"), "errors": none, **fetched,
    }
    answer = {c: F.when(shown, v) for c, v in answer.items()} | {"content_type": F.when(shown, answer["content_type"]).otherwise("text/plain")}
    kept = [F.col(c).alias(FIRST + c) for c in columns] + [c for c in tried.columns if c not in columns]
    return records(extract(tried.select(*kept, F.col("seed_id"), *[v.alias(c) for c, v in answer.items()])))


def after_rendering(records_: DataFrame, renders: DataFrame, allowed: Column, available: bool = True) -> DataFrame:
    """Records after the decision about rendering, with ``attempts``, ``egress_bytes`` and ``egress_hosts``.

    Pages that need no script stay. A shell page is ``render-blocked`` where rendering is not ``allowed``, and ``render-unavailable`` where there is no renderer or it says so. A render that
    failed or showed nothing is an error row; one that the server answered with an error keeps the verdict of its answer; any other becomes the record, tier 3, behind the
    errors and attempts of the first one. ``renders`` (``RENDERS``): what a renderer made of seeds, one row each at most; a seed that it did not reach counts as a failed render. Bytes of the
    first fetch and of the render are added up in every case.
    """
    base = records_ if "attempts" in records_.columns else records_.withColumn("attempts", F.array().cast(ATTEMPTS))
    keep = [c for c in base.columns if c not in ("egress_bytes", "egress_hosts")]
    made = renders.select("seed_id", F.struct(*[c for c in renders.columns if c != "seed_id"]).alias("__r")).where(F.lit(available))
    needs, may, ok = F.col("tier") == "render-blocked", F.coalesce(allowed, F.lit(False)), F.coalesce("__r.rendered", F.lit(False))
    tried = base.select(*keep).join(made, "seed_id", "left").withColumn("__kind", F.when(~needs, "done").when(~may, "blocked").when(ok, "shown").otherwise("failed"))
    dom = F.coalesce("__r.dom_html", F.lit(""))
    if available:
        page = _again(
            tried, F.col("__kind") == "shown", dom, keep, status=F.coalesce("__r.status", "status"), content_type=F.coalesce("__r.content_type", F.lit("text/html")), bytes=F.octet_length(dom).cast("long"),
        )
    else:  # nothing is shown
        page = tried.select("*", *[F.col(c).alias(FIRST + c) for c in keep])
    first = lambda c: F.col(FIRST + c)
    own = [c for c in keep if c in page.columns and c != "seed_id"]
    empty = F.col("gate.js_required") & (F.trim("result") == "")
    code = F.when(F.lit(not available), "render_unavailable").otherwise(F.coalesce("__r.code", F.lit("render_error")))
    both = page.withColumn("__kind", F.when((F.col("__kind") == "failed") & (code == "render_unavailable"), "absent").when((F.col("__kind") == "shown") & empty, "empty").otherwise(F.col("__kind")))
    kind, bad = F.col("__kind"), F.col("status") >= 400
    none = F.array().cast(ATTEMPTS)
    controls = F.transform(F.coalesce("__r.actions", F.array().cast(dict(renders.dtypes)["actions"])), lambda a: _attempt(F.lit("3"), F.coalesce(a["outcome"], F.lit("block")), F.concat_ws(":", a["type"], a["reason"], a["method"], a["resource"], a["url"])))
    ms = F.col("__r.render_ms")
    rendered = _attempt(F.lit("3"), F.when(bad, "error").otherwise("ok"), F.when(bad, "http-error").otherwise("rendered"), ms, F.col("status"), F.col("bytes"))
    lost = _attempt(F.when(kind == "absent", NO_RENDER).otherwise("error"), F.lit("error" if available else "block"), F.when(kind == "empty", "render_empty").when(F.lit(not available), "render port unconfigured").otherwise(code), ms)
    attempts = (
        F.when(kind == "done", none).when(kind == "blocked", F.array(_attempt(F.lit(BLOCKED), F.lit("block"), F.lit("allowRender=false"))))
        .when(kind == "shown", F.concat(F.array(rendered), controls)).otherwise(F.concat(controls, F.array(lost)))
    )
    message = F.when(kind == "empty", "Render produced no content (empty shell)").otherwise(F.coalesce("__r.message", F.lit("Tier-3 render failed" if available else "Tier-3 render is not configured")))
    error = F.array(F.struct(F.when(kind == "empty", "render_empty").otherwise(code).alias("code"), message.alias("message")))
    errors = F.when(kind.isin("done", "blocked"), first("errors")).when(kind == "shown", F.concat(first("errors"), "errors")).otherwise(F.concat(first("errors"), error))
    taken = {c: F.when(kind == "shown", F.col(c)).otherwise(first(c)) for c in own}
    via = F.when(kind == "blocked", BLOCKED).when(kind == "absent", NO_RENDER).when(kind.isin("failed", "empty") | ((kind == "shown") & ~bad), BY_RENDER)
    tier = F.when(kind == "absent", NO_RENDER).when(kind.isin("failed", "empty"), "error").when((kind == "shown") & ~bad, "3")
    ran = ~kind.isin("done", "blocked")
    taken |= {
        "attempts": F.concat(first("attempts"), attempts), "errors": errors, "tier": F.coalesce(tier, taken["tier"]), "resolved_via": F.coalesce(via, taken["resolved_via"]),
        "egress_bytes": F.coalesce(first("bytes"), F.lit(0)) + F.when(ran, F.coalesce("__r.egress_bytes", F.lit(0))).otherwise(0), "egress_hosts": F.when(ran, F.coalesce("__r.hosts", F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>")),
    }
    out = both.select(*[(taken[c] if c in taken else first(c)).alias(c) for c in (*keep, "egress_bytes", "egress_hosts")])
    return out.withColumn("record_status", classify.record_status(F.col("tier"), F.col("status"), F.col("result"), F.col("errors"), F.lit(None).cast("string")))


def _substantial(body: Column, words: Column) -> Column:
    return (F.length(F.trim(body)) >= 80) | (words >= 12)


def with_rendered(records_: DataFrame, rendered: DataFrame) -> DataFrame:
    """Records of shell pages replaced by what a renderer found (seed_id, dom_html); 4xx records stay.

    ``rendered`` holds the pages that were rendered, one row each; the DOM goes through the same extraction.
    """
    made = rendered.select(F.col("seed_id").alias("__seed"), F.struct("dom_html").alias("__made"))
    tried = records_.join(made, (F.col("seed_id") == F.col("__seed")) & (F.col("tier") == "render-blocked"), "left").drop("__seed")
    shown, dom, columns = F.col("__made").isNotNull(), F.col("__made.dom_html"), records_.columns
    page = _again(tried, shown, dom, columns, bytes=F.length(dom).cast("long"), errors=F.col("errors"))
    # errors of the first attempt come before those of the rendered page
    taken = {"tier": F.lit("3"), "errors": F.array_distinct("errors")}
    return page.select(*[(F.when(shown, taken.get(c, F.col(c))).otherwise(F.col(FIRST + c)) if c in page.columns else F.col(FIRST + c)).alias(c) for c in columns])


def tracker_free(body: Column, main_host: Column, listed: list[str]) -> Column:
    """A text for a model without the addresses of third-party trackers; an address that another one begins with is left in that one."""
    address = r"""https?://[^\s"'<>)\]]+"""
    from .lookups import is_tracker

    # the text between addresses, and the addresses: both lists in order
    between, found = F.split(body, address, -1), F.regexp_extract_all(body, F.lit(f"({address})"), F.lit(1))
    kept = F.transform(found, lambda u: F.when(is_tracker(urls.host(u), listed) & ~urls.is_first_party(urls.host(u), main_host), "").otherwise(u))
    return F.array_join(F.zip_with(between, F.array_append(kept, F.lit("")), lambda t, u: F.concat(t, u)), "")
