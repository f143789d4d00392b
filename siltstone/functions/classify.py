"""Evidence and verdicts about fetched pages, as Column expressions over evidence columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import html, nodes, text, urls
from .core import let

# Marks of challenge pages and of client crashes, and their limits.
CF_MARKS = r"(?i)cdn-cgi/challenge-platform|__cf_chl|cf-browser-verification|akamaighost|_abck|px-captcha|/_px/"
DATADOME_MARK, IMPERVA_MARK = r"(?i)captcha-delivery", r"(?i)incapsula incident id|powered by incapsula"
PHRASES = r"(?i)verifying your browser|checking your browser|verify you are a human"
COOKIES = r"(?i)(?:^|,\s*)(?:__cf_bm|__cf_chl_|datadome|_px|incap_ses|visid_incap|nlbi_)="
VENDORS = ("cloudflare", "akamai", "incapsula", "imperva", "perimeterx")
MARK_CHARS = 65_536
CRASHES = ("something went wrong", "application error: a client-side exception", "a critical error occurred")
CRASH_CHARS, LOW_TEXT, LOW_BYTES = 300, 500, 100_000
GAP_BYTES, EMPTY_BYTES, DOM_TEXT = 4096, 2048, 100
# Credentials and header dumps in texts.
CREDENTIALS = (
    r"(?i)-----BEGIN (?:RSA |EC |DSA |OPENSSH |PGP |ENCRYPTED )?PRIVATE KEY-----", r"\bgh[opsu]_[A-Za-z0-9]{20,}\b", r"\bgithub_pat_[A-Za-z0-9_]{20,}\b",
    r"\bsk-ant-[A-Za-z0-9_-]{20,}\b", r"\bsk-(?:proj-)?[A-Za-z0-9_-]{20,}\b", r"\bAKIA[0-9A-Z]{16}\b", r"\bxox[bp]-[A-Za-z0-9-]{10,}\b",
    r"\bAIza[0-9A-Za-z_-]{35}\b", r"\bglpat-[A-Za-z0-9_-]{20,}\b", r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\b",
    r"\bAWS_SECRET_ACCESS_KEY\s*=\s*[A-Za-z0-9/+=]{40}\b", r"\bAWS_SESSION_TOKEN\s*=\s*[A-Za-z0-9/+=_-]{50,}\b",
    r"\bAZURE_CLIENT_SECRET\s*=\s*[A-Za-z0-9._~+/=-]{30,}\b",
)
HEADER_DUMPS = (r"(?i)authorization:\s*(?:bearer|basic)\s+[A-Za-z0-9._~+/=-]{8,}", r"(?i)set-cookie:\s*[^=\s;]{1,64}=[^;\s<]{16,}")
# Fixed value: an address in a text.
URL_IN_TEXT = r"""(?i)(https?://(?:[^\s"'<>)\]\[@/]+(?::[^\s"'<>)\]\[@/]*)?@)?\[[^\]\s]{1,79}\](?::\d{1,5})?(?:[/?#][^\s"'<>]*)?|https?://[^\s"'<>]{1,512})"""
URL_SCAN_CHARS = 500_000


def has_content(scope_html: Column, length: Column, words: Column, landmark: Column) -> Column:
    """Enough text, or a little text in a landmark or under a content tag."""
    tagged = scope_html.rlike(r"(?i)<(?:article|main|p|h1|h2|h3)(?=[\s/>])")
    return F.when((length >= 80) | (words >= 12), True).when(length < 20, False).otherwise(landmark | F.coalesce(tagged, F.lit(False)))


def gate(content_type: Column, structured: Column, content: Column) -> Column:
    """struct(js_required, reason): whether a page is an empty shell that scripts must fill."""
    reason = (
        F.when(~text.is_html_type(content_type), "content-present")
        .when(structured, "structured-data-found")
        .when(content, "content-present")
        .otherwise("empty-spa-shell")
    )
    return F.struct((reason == "empty-spa-shell").alias("js_required"), reason.alias("reason"))


def usable_structure(bearing: Column, state_keys: Column) -> Column:
    """JSON-LD that carries content, or named framework state."""
    return (F.size(bearing) > 0) | F.arrays_overlap(state_keys, F.array(*[F.lit(k) for k in html.STATE_KEYS]))


def resolved_via(status: Column, content_type: Column, gate_reason: Column, json_ld: Column, state_keys: Column, meta_count: Column) -> Column:
    """What a page's content came from."""
    return (
        F.when(status >= 400, "tier1-error")
        .when(~text.is_html_type(content_type), F.when(text.is_json_type(content_type), "tier1-json").otherwise("tier1-text"))
        .when(gate_reason == "empty-spa-shell", "tier1-shell-gate")
        .when(F.size(json_ld) > 0, "tier1-jsonld")
        .when(F.size(state_keys) > 0, "tier1-app-state")
        .when(meta_count > 0, "tier1-meta")
        .otherwise("tier1-html")
    )


def content_kind(content_type: Column, bearing_types: Column, og_type: Column, url: Column, js_required: Column) -> Column:
    """json, job, product, article, pin, spa or unknown."""
    og = F.lower(F.coalesce(og_type, F.lit("")))
    return (
        F.when(text.is_json_type(content_type), "json")
        .when(nodes.content_kind_of_types(bearing_types).isNotNull(), nodes.content_kind_of_types(bearing_types))
        .when(og == "product", "product")
        .when(og == "article", "article")
        .when(urls.is_pin_host(url), "pin")
        .when(js_required, "spa")
        .otherwise("unknown")
    )


def row_has_content(tier: Column, result: Column) -> Column:
    return tier.isin("1", "2", "3") & (F.trim(F.coalesce(result, F.lit(""))) != "")


def first_code(errors: Column, *codes: str) -> Column:
    """The first of these codes among error rows."""
    return F.get(F.filter(errors, lambda e: e["code"].isin(*codes)), F.lit(0))["code"]


def truncation(tier: Column, errors: Column) -> Column:
    return F.when(tier != "error", first_code(errors, "max_bytes", "body_read_error"))


def access(tier: Column, status: Column, result: Column, js_required: Column, errors: Column, bot: Column, provider: Column, paywalled: Column) -> Column:
    """struct(accessible, gated, reason), by precedence."""
    content = row_has_content(tier, result)
    needs = tier.isin("render-blocked", "render-unavailable") | js_required
    reason = (
        F.when(bot, "bot_verification")
        .when(provider.isNotNull(), "captcha")
        .when(status >= 400, "http_error")
        .when(paywalled, "paywall")
        .when(truncation(tier, errors).isNotNull(), "byte_cap")
        .when(~content & needs, "js-required")
        .otherwise("none")
    )
    accessible = F.when(reason.isin("bot_verification", "captcha", "http_error"), False).otherwise(content)
    return F.struct(accessible.alias("accessible"), (reason != "none").alias("gated"), reason.alias("reason"))


def bot_evidence(headers: Column, body: Column, status: Column) -> Column:
    """Booleans and the vendor that a response shows; ``headers`` is map<string, array<string>>."""
    server = F.lower(text.header(headers, "server"))
    vendor = F.lit("none")
    for name in reversed(VENDORS):
        vendor = F.when(server.contains(name), name).otherwise(vendor)
    head = F.substring(F.coalesce(body, F.lit("")), 1, MARK_CHARS)
    cookies = F.array_join(F.coalesce(F.get(F.map_values(F.map_filter(headers, lambda k, v: F.lower(k) == "set-cookie")), F.lit(0)), F.array().cast("array<string>")), "\n")
    json_body = text.is_json_type(text.header(headers, "content-type"))
    return F.struct(
        vendor.alias("vendor"), (text.header(headers, "cf-mitigated") != "").alias("mitigated"), (text.header(headers, "cf-ray") != "").alias("ray"),
        cookies.rlike(COOKIES).alias("cookie"), head.rlike(DATADOME_MARK).alias("datadome"), head.rlike(IMPERVA_MARK).alias("imperva"),
        (head.rlike(DATADOME_MARK) | head.rlike(IMPERVA_MARK) | head.rlike(CF_MARKS)).alias("marked"),
        (status.isin(429, 503) & ~json_body & F.coalesce(body, F.lit("")).rlike(PHRASES)).alias("phrase"),
    )


def bot_signal(evidence: Column) -> Column:
    """struct(signal, provider); a cookie alone is no signal. Both null without one."""
    signal = F.when(evidence["mitigated"], "cf-mitigated").when(evidence["marked"], "challenge-body").when(evidence["phrase"], "verification-phrase")
    provider = (
        F.when(evidence["datadome"], "datadome")
        .when(evidence["imperva"], "imperva")
        .when(evidence["mitigated"] | evidence["ray"] | (evidence["vendor"] == "cloudflare"), "cloudflare")
        .when(evidence["vendor"].isin("incapsula", "imperva"), "imperva")
        .when(evidence["vendor"] != "none", evidence["vendor"])
        .otherwise("unknown")
    )
    return F.struct(signal.alias("signal"), F.when(signal.isin("cf-mitigated", "challenge-body"), provider).alias("provider"))


def content_quality(tier: Column, status: Column, result: Column, network_bytes: Column, bearing: Column, challenged: Column) -> Column:
    """app_error, low_value or null."""
    body = F.lower(F.trim(F.coalesce(result, F.lit(""))))
    crash = F.lit(False)
    for start in CRASHES:
        crash = crash | body.startswith(F.lit(start))
    applies = tier.isin("1", "2", "3") & ~challenged & (status < 400)
    low = (F.length(body) < LOW_TEXT) & (network_bytes >= LOW_BYTES) & ~bearing
    return F.when(applies & (tier == "3") & (F.length(body) <= CRASH_CHARS) & crash, "app_error").when(applies & low, "low_value")


def render_reason(rendered: Column, egress: Column, hosts: Column, dom_bytes: Column, dom_text: Column) -> Column:
    """Why a rendered page gave nothing, as far as sizes tell."""
    shown = F.coalesce(dom_text, F.lit(0))
    return (
        F.when(~rendered, "render-error")
        .when((egress == 0) & (F.size(hosts) == 0), "network-blocked")
        .when((dom_bytes >= GAP_BYTES) & (shown >= DOM_TEXT), "extraction-gap")
        .when((dom_bytes < EMPTY_BYTES) & (shown < DOM_TEXT), "empty-dom")
        .otherwise("unknown")
    )


def record_status(tier: Column, status: Column, result: Column, errors: Column, provider: Column) -> Column:
    """fail, partial or pass of one record."""
    return (
        F.when((tier == "error") | (status >= 400) | ~row_has_content(tier, result), "fail")
        .when((F.size(errors) > 0) | F.coalesce(provider == "none", F.lit(False)), "partial")
        .otherwise("pass")
    )


def fatal_errors(tier: Column, errors: Column) -> Column:
    """Error rows of a failed record; all others are warnings, and recovered options always are."""
    return F.filter(errors, lambda e: (tier == "error") & (e["code"] != "schema_knob_extracted"))


def warnings(tier: Column, errors: Column) -> Column:
    return F.filter(errors, lambda e: (tier != "error") | (e["code"] == "schema_knob_extracted"))


def failure_code(resolved: Column, code_text: Column, tier: Column, status: Column, errors: Column) -> Column:
    return (
        F.when(resolved == "bulk-shortcut", code_text)
        .when(tier == "error", F.coalesce(F.get(errors, F.lit(0))["code"], F.lit("fetch_error")))
        .otherwise(F.concat(F.lit("http_"), status.cast("string")))
    )


def required_scope(output: Column) -> Column:
    return F.when(output == "raw", "read").otherwise("transform")


#: What a text must hold for one of ``CREDENTIALS`` to match, by pattern, and in small letters for ``HEADER_DUMPS`` and the first of them.
CREDENTIAL_MARKS = (
    (), ("gho_", "ghp_", "ghs_", "ghu_"), ("github_pat_",), ("sk-ant-",), ("sk-",), ("AKIA",), ("xoxb-", "xoxp-"), ("AIza",), ("glpat-",), ("eyJ",), ("AWS_SECRET_ACCESS_KEY",),
    ("AWS_SESSION_TOKEN",), ("AZURE_CLIENT_SECRET",),
)
FOLDED_MARKS, DUMP_MARKS = ("private key",), ("authorization:", "set-cookie:")


def _holds(c: Column, marks: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for m in marks:
        out = out | c.contains(m)
    return out


def _credential(c: Column, low: Column) -> Column:
    """Whether a text holds a credential; plain searches come before patterns, since hardly any text passes them."""
    out = _holds(low, FOLDED_MARKS) & c.rlike(CREDENTIALS[0])
    for pattern, marks in zip(CREDENTIALS[1:], CREDENTIAL_MARKS[1:], strict=True):
        out = out | (_holds(c, marks) & c.rlike(pattern))
    return out


def sensitive_reason(content: Column, source_url: Column | None = None) -> Column:
    """Why a text must not leave: source address, credentials, header dumps, then addresses in the text; null if none."""
    body = F.coalesce(content, F.lit(""))

    def scan(low: Column) -> Column:
        dump = F.lit(False)
        for pattern, mark in zip(HEADER_DUMPS, DUMP_MARKS, strict=True):
            dump = dump | (low.contains(mark) & body.rlike(pattern))
        return F.when(_credential(body, low), "content_credential_signal").when(dump, "content_header_dump")

    found = [let(F.lower(body), scan)]
    if source_url is not None:
        own = F.coalesce(urls.signed_reason(source_url), urls.internal_reason(source_url))
        address = F.coalesce(source_url, F.lit(""))
        found = [own, F.when(_credential(address, F.lower(address)), "source_credential_signal"), *found]
    every = F.transform(F.regexp_extract_all(F.substring(body, 1, URL_SCAN_CHARS), F.lit(URL_IN_TEXT), F.lit(0)), _trim_prose)
    reason = lambda u: F.coalesce(
        urls.signed_reason(u, urls.CREDENTIAL_KEYS), urls.fragment_reason(u), urls.password_reason(u), urls.loopback_reason(u), urls.internal_reason(u, True)
    )
    first = F.get(F.filter(F.transform(every, reason), lambda r: r.isNotNull()), F.lit(0))
    return F.coalesce(*found, F.when(body.contains("://"), F.when(first.isNotNull(), F.concat(F.lit("content_embedded_"), first))))


def _trim_prose(url: Column) -> Column:
    """Without the punctuation and the unpaired closing bracket that follow an address in prose."""
    plain = F.regexp_replace(url, r"[.,;:!?]+$", "")
    count = lambda c, s: F.length(c) - F.length(F.replace(c, F.lit(s), F.lit("")))
    for opening, closing in (("[", "]"), ("(", ")")):
        cut = lambda p, o=opening, c=closing: F.when(count(p, c) > count(p, o), F.regexp_replace(p, rf"\{c}+$", "")).otherwise(p)
        plain = let(plain, cut)
    return plain
