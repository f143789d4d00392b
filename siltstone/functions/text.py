"""Clipping, cleaning, hashing, estimates and dates, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .core import lookup

ELLIPSIS = "…"
# Lengths at which texts are cut for delivery.
EXCERPT, SNIPPET, SEED_SNIPPET, SEED_CONTENT, TITLE = 3000, 2000, 500, 8000, 140
EXCERPT_NOTE = (
    "\n\n[… transform unavailable — showing the first 3000 characters of the page. "
    'Retry for a summary, or re-run with output:"raw" for the full content.]'
)
# Output limits of models.
MODEL_OUTPUT = {"deepseek/deepseek-v4-flash": 16_384, "qwen/qwen3.6-flash": 65_536}
DEFAULT_MODEL_OUTPUT, MODEL_OUTPUT_CAP, DEFAULT_OUTPUT = 16_384, 65_536, 8_000


def rtrim(c: Column) -> Column:
    return F.regexp_replace(c, r"[\s\p{Z}]+$", "")


def clip(c: Column, n: int) -> Column:
    """At most n characters; a cut text ends in an ellipsis."""
    return F.when(F.length(c) <= n, c).otherwise(F.concat(rtrim(F.substring(c, 1, n - 1)), F.lit(ELLIPSIS)))


def excerpt(c: Column) -> Column:
    """The start of a long text, with a note."""
    return F.when(F.length(c) <= EXCERPT, c).otherwise(F.concat(rtrim(F.substring(c, 1, EXCERPT)), F.lit(EXCERPT_NOTE)))


def printable(c: Column) -> Column:
    """Without control, zero-width and direction characters."""
    return F.regexp_replace(c, r"[\x00-\x1f\x7f​-‏‪-‮]", "")


def collapse(c: Column) -> Column:
    """Runs of any white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, r"[\s\p{Z}\x{FEFF}\x{85}]+", " "))


def first_text(*columns: Column) -> Column:
    """The first that is not blank, trimmed."""
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in columns])


def sha256(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


def token_estimate(c: Column) -> Column:
    return F.greatest(F.lit(1).cast("long"), F.ceil(F.length(c) / 4))


def output_cap(budget: Column, model: Column, default: int = DEFAULT_OUTPUT) -> Column:
    """Tokens a model may answer with: a positive budget or the default, within the model's limit."""
    limit = F.lit(DEFAULT_MODEL_OUTPUT)
    for name, most in MODEL_OUTPUT.items():
        limit = F.when(model == name, most).otherwise(limit)
    wanted = F.when(F.coalesce(budget > 0, F.lit(False)), budget).otherwise(F.lit(default))
    return F.greatest(F.lit(1), F.least(wanted, limit)).cast("long")


def word_count(c: Column) -> Column:
    return F.when(F.coalesce(c, F.lit("")) == "", 0).otherwise(F.size(F.split(c, r"\s+")))


def iso_time(millis: Column) -> Column:
    """Milliseconds since 1970 as ISO 8601 in UTC (of a UTC session); null unless positive."""
    return F.when(millis > 0, F.date_format(F.timestamp_millis(millis), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))


def json_text(c: Column) -> Column:
    """A string as a JSON literal, null as ``null``."""
    quoted = F.to_json(F.struct(c.alias("v")))
    return F.when(c.isNull(), F.lit("null")).otherwise(F.regexp_extract(quoted, r'(?s)^\{"v":(.*)\}$', 1))


def provenance_hash(**columns: Column) -> Column:
    """SHA-256 of a record's envelope: fixed keys in a fixed order, absent values as null.

    ``tier`` and ``code`` are numbers where they look like numbers; ``jsRequired`` is boolean.
    """
    keys = ("url", "finalUrl", "tier", "code", "output", "resolvedVia", "jsRequired", "contentSha256", "fetchedAt", "transformProvider", "transformModel")
    shown = []
    for key in keys:
        c = columns.get(key, F.lit(None).cast("string"))
        if key in ("tier", "code"):
            text = c.cast("string")
            value = F.when(text.rlike(r"^[0-9]+$"), text).otherwise(json_text(text))
        elif key == "jsRequired":
            value = F.coalesce(c.cast("string"), F.lit("null"))
        else:
            value = json_text(c)
        shown.append(F.concat(F.lit(f'"{key}":'), value))
    return sha256(F.concat(F.lit("{"), F.concat_ws(",", *shown), F.lit("}")))


def retry_after(value: Column, status: Column, now: Column) -> Column:
    """Milliseconds a 429 or 503 asks to wait: seconds or an HTTP date, never negative, at most five minutes."""
    seconds = F.when(value.rlike(r"^\s*-?[0-9]+\s*$"), F.trim(value).try_cast("double") * 1000)
    date = F.try_to_timestamp(F.regexp_replace(value, r"^[A-Za-z]{3}, | GMT$", ""), F.lit("dd MMM yyyy HH:mm:ss"))
    millis = F.coalesce(seconds, (F.unix_millis(date) - F.unix_millis(now)).cast("double"))
    return F.when(status.isin(429, 503) & millis.isNotNull(), F.least(F.greatest(millis, F.lit(0.0)), F.lit(300_000.0)).cast("long"))


def header(headers: Column, name: str) -> Column:
    """First value of a header in a map<string, array<string>>, whatever its case; '' where absent."""
    found = F.filter(F.map_entries(headers), lambda e: F.lower(e["key"]) == name.lower())
    return F.coalesce(F.get(F.get(found, F.lit(0))["value"], F.lit(0)), F.lit(""))


def is_html_type(content_type: Column) -> Column:
    return F.coalesce(content_type, F.lit("")).rlike("(?i)^$|html|xhtml")


def is_json_type(content_type: Column) -> Column:
    primary = F.lower(F.trim(F.split_part(F.coalesce(content_type, F.lit("")), F.lit(";"), F.lit(1))))
    return (primary == "application/json") | primary.endswith("+json")


def charset(content_type: Column) -> Column:
    return F.lower(F.nullif(F.regexp_extract(F.coalesce(content_type, F.lit("")), r"(?i)charset\s*=\s*[\"']?([^\s;\"']+)", 1), F.lit("")))


# Reason phrases of HTTP status codes.
STATUS_TEXT = {
    100: "Continue", 101: "Switching Protocols", 102: "Processing", 103: "Early Hints", 200: "OK", 201: "Created", 202: "Accepted", 203: "Non-Authoritative Information",
    204: "No Content", 205: "Reset Content", 206: "Partial Content", 207: "Multi-Status", 208: "Already Reported", 226: "IM Used", 300: "Multiple Choices",
    301: "Moved Permanently", 302: "Found", 303: "See Other", 304: "Not Modified", 305: "Use Proxy", 307: "Temporary Redirect", 308: "Permanent Redirect",
    400: "Bad Request", 401: "Unauthorized", 402: "Payment Required", 403: "Forbidden", 404: "Not Found", 405: "Method Not Allowed", 406: "Not Acceptable",
    407: "Proxy Authentication Required", 408: "Request Timeout", 409: "Conflict", 410: "Gone", 411: "Length Required", 412: "Precondition Failed", 413: "Payload Too Large",
    414: "URI Too Long", 415: "Unsupported Media Type", 416: "Range Not Satisfiable", 417: "Expectation Failed", 418: "I'm a Teapot", 421: "Misdirected Request",
    422: "Unprocessable Entity", 423: "Locked", 424: "Failed Dependency", 425: "Too Early", 426: "Upgrade Required", 428: "Precondition Required", 429: "Too Many Requests",
    431: "Request Header Fields Too Large", 451: "Unavailable For Legal Reasons", 500: "Internal Server Error", 501: "Not Implemented", 502: "Bad Gateway",
    503: "Service Unavailable", 504: "Gateway Timeout", 505: "HTTP Version Not Supported", 506: "Variant Also Negotiates", 507: "Insufficient Storage", 508: "Loop Detected",
    509: "Bandwidth Limit Exceeded", 510: "Not Extended", 511: "Network Authentication Required",
}


def status_text(status: Column) -> Column:
    """Reason phrase of an HTTP status, '' for an unknown one."""
    return F.coalesce(lookup(STATUS_TEXT, status.cast("int")), F.lit(""))


def is_redirect(status: Column) -> Column:
    """Whether a status sends the client on; false for null."""
    return F.coalesce(status.between(300, 399), F.lit(False))
