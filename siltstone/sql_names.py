"""The library's functions under SQL names: scalar functions, table functions, schema checks.

``register(spark)`` makes them temporary functions of the session. Column functions become SQL functions whose body is the
column's own expression, so Catalyst sees and optimises the same plan as from Python. What one page holds in many rows comes from table
functions, to be used with ``LATERAL``: ``jobs`` is a SQL table function over an expression; ``html_tags`` and ``json_ld_nodes`` read
markup and nested JSON in Python, row by row of the left side, and tell Spark their columns (``analyze``).

Cases: null html, bodies and texts give no rows; a tag's name that is no constant is an error when the query is analysed; names
not registered as schemas give null.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Collection, Iterator
from typing import Any

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from siltstone.functions import classify, html, markup, nodes, text, urls
from siltstone.operators import boards, schema
from siltstone.shipping import ship

# A string or quoted name, which stays, or the name of a call. A call without arguments stays as well.
_CALL = re.compile(r"('(?:[^'\\]|\\.|'')*'|`[^`]*`)|(?<![\w`.])([A-Za-z_]\w*|[!=<>+\-*/%&|^~]+)\((?!\))", re.S)
_PLAIN = ("CAST", "TRY_CAST", "STRUCT", "->")


def sql_text(column: Column) -> str:
    """A column expression as SQL text: calls of operators and functions by their quoted names."""
    return _CALL.sub(lambda m: m[1] or (m[0] if m[2].upper() in _PLAIN else f"`{m[2]}`("), column._jc.node().sql())


ERRORS = "ARRAY<STRUCT<code: STRING, message: STRING>>"


def verdict(tier: Column, status: Column, result: Column, network_bytes: Column, js_required: Column, errors: Column) -> Column:
    """struct(accessible, gated, reason, quality, status, has_content, truncation) of a fetched page without structured data."""
    none, no = F.lit(None).cast("string"), F.lit(False)
    reach = classify.access(tier, status, result, js_required, errors, no, none, no)
    return F.struct(
        reach["accessible"].alias("accessible"), reach["gated"].alias("gated"), reach["reason"].alias("reason"),
        classify.content_quality(tier, status, result, network_bytes, no, no).alias("quality"), classify.record_status(tier, status, result, errors, none).alias("status"),
        classify.row_has_content(tier, result).alias("has_content"), classify.truncation(tier, errors).alias("truncation"),
    )


#: SQL name -> (parameters with types, function of the parameters' columns)
SCALARS: dict[str, tuple[str, Callable[..., Column]]] = {
    "url_error": ("url STRING", urls.url_error),
    "canonical_url": ("url STRING", urls.canonical),
    "url_host": ("url STRING", urls.bare_host),
    "is_private_address": ("address STRING", urls.is_private),
    "ip_version": ("address STRING", urls.ip_version),
    "visible_text": ("html STRING", html.visible_text),
    "page_title": ("html STRING", html.title),
    "page_meta": ("html STRING", html.meta),
    "json_ld": ("html STRING", html.json_ld),
    "word_count": ("content STRING", text.word_count),
    "token_estimate": ("content STRING", text.token_estimate),
    "schema_type": ("type STRING", nodes.short_type),
    "sensitive_reason": ("content STRING", classify.sensitive_reason),
    "board_of": ("url STRING", boards.board_of),
    "classify": (f"tier STRING, status INT, result STRING, network_bytes BIGINT, js_required BOOLEAN, errors {ERRORS}", verdict),
}


class HtmlTags:
    """html_tags(html, tag): start tags of one name, or of all for a null tag: position, name, attributes, place in characters."""

    @staticmethod
    def analyze(page: AnalyzeArgument, tag: AnalyzeArgument) -> AnalyzeResult:
        if not isinstance(page.dataType, (T.StringType, T.NullType)):
            raise ValueError(f"html_tags: the html must be a string, not {page.dataType.simpleString()}")
        if not tag.isConstantExpression or not isinstance(tag.dataType, (T.StringType, T.NullType)):
            raise ValueError("html_tags: the tag must be a constant string or null")
        words = T.MapType(T.StringType(), T.StringType())
        return AnalyzeResult(T.StructType().add("position", "integer").add("name", "string").add("attributes", words).add("start", "integer").add("end", "integer"))

    def eval(self, page: str | None, tag: str | None) -> Iterator[tuple]:
        if page is None:
            return
        found, at, n, wanted = markup.Page(page), 0, 0, tag.lower() if tag else None
        for kind, name, raw in zip(found.kind, found.name, found.raw):
            if kind in ("open", "void", "inert") and wanted in (None, name):
                m = markup.TOKEN.match(raw)
                yield n, name, markup.attributes(m[3]), at, at + m.end()
                n += 1
            at += len(raw)


class JsonLdNodes:
    """json_ld_nodes(html): every object inside a page's JSON-LD scripts at any depth, parents first.

    script, path (keys and places), depth (objects above it), types (as written, an array), id, name, node (its JSON). What one script says
    bounds the work; a stack takes the place of recursion, so nesting has no limit but the parser's.
    """

    @staticmethod
    def analyze(page: AnalyzeArgument) -> AnalyzeResult:
        if not isinstance(page.dataType, (T.StringType, T.NullType)):
            raise ValueError(f"json_ld_nodes: the html must be a string, not {page.dataType.simpleString()}")
        out = T.StructType().add("script", "integer").add("path", "string").add("depth", "integer").add("types", T.ArrayType(T.StringType()))
        return AnalyzeResult(out.add("id", "string").add("name", "string").add("node", "string"))

    def eval(self, page: str | None) -> Iterator[tuple]:
        for script, source in enumerate(markup.embedded(page or "")["json_ld"]):
            yield from self.nodes(script, json.loads(source))

    @staticmethod
    def nodes(script: int, value: Any) -> Iterator[tuple]:
        stack: list[tuple[str, int, Any]] = [("$", 0, value)]
        while stack:
            path, depth, v = stack.pop()
            if isinstance(v, list):
                stack += [(f"{path}[{k}]", depth, x) for k, x in reversed(list(enumerate(v)))]
            elif isinstance(v, dict):
                kinds = v.get("@type")
                shown = lambda k: v[k] if isinstance(v.get(k), str) else None  # noqa: B023, E731
                listed = [kinds] if isinstance(kinds, str) else [t for t in kinds if isinstance(t, str)] if isinstance(kinds, list) else []
                yield script, path, depth, listed, shown("@id"), shown("name"), json.dumps(v, ensure_ascii=False, separators=(",", ":"))
                stack += [(f"{path}.{k}", depth + 1, x) for k, x in reversed(v.items())]


def _jobs_type() -> str:
    kinds = {"ord": "BIGINT", "job_count": "BIGINT", "truncated": "BOOLEAN", "remote": "BOOLEAN"}
    return ", ".join(f"{c} {kinds.get(c, 'STRING')}" for c in ("ord", "job_count", "truncated", *boards.FIELDS))


def register(spark: SparkSession, schemas: dict[str, Any] | None = None, names: Collection[str] | None = None) -> None:
    """Make all names, or some, known to the session; ``schemas`` are JSON Schemas by the name that ``validate_json(name, json)`` gets."""
    ship(spark)
    wanted = lambda name: names is None or name in names
    for name, (parameters, function) in SCALARS.items():
        if not wanted(name):
            continue
        columns = [F.col(p.split()[0]) for p in re.sub(r"<[^()]*>", "", parameters).split(", ")]
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURN {sql_text(function(*columns))}")
    spark.udtf.register("html_tags", F.udtf(HtmlTags))
    spark.udtf.register("json_ld_nodes", F.udtf(JsonLdNodes))
    if wanted("jobs"):
        rows = sql_text(boards.roster(F.col("platform"), F.col("body")))
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION jobs(platform STRING, body STRING) RETURNS TABLE({_jobs_type()}) RETURN SELECT * FROM inline({rows})")
    if not wanted("validate_json"):
        return
    outcome = F.lit(None).cast("struct<valid: boolean, message: string, unsupported: boolean>")
    for name, rule in (schemas or {}).items():
        outcome = F.when(F.col("schema_name") == name, schema.outcome(F.col("content"), rule)).otherwise(outcome)
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION validate_json(schema_name STRING, content STRING) RETURN {sql_text(outcome)}")
