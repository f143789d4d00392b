"""The library's SQL names: scalar and table functions in queries, their errors and odd input."""

import json

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from siltstone import sql_names
from siltstone.operators import boards


@pytest.fixture(scope="module")
def sql(spark):
    sql_names.register(spark, {"small": {"type": "integer", "maximum": 3}, "it's": {"enum": ["a'b", {"c": 1}]}})
    return spark.sql


def test_scalars_equal_their_columns(spark, sql):
    values = ["http://A.example/x?y=1#z", "ftp://x", "", None, "<title>it's &amp; so</title><p>a\\b</p>", "10.0.0.1", "fe80::1", "https://jobs.lever.co/acme", "a 'quoted' \"text\" \\n"]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    df.createOrReplaceTempView("sql_names_values")
    for name, (parameters, function) in sql_names.SCALARS.items():
        if parameters.count("STRING") == 1 and "," not in parameters:
            ours = [json.dumps(r.asDict(True), default=str) for r in df.select(function(F.col("v")).alias("x")).collect()]
            assert ours == [json.dumps(r.asDict(True), default=str) for r in sql(f"SELECT {name}(v) AS x FROM sql_names_values").collect()], name


def test_tags_in_lateral_joins(sql):
    page = "<p>a<!-- <b> --><IMG src='x.png' alt=\"a > b\"><p class=k>b<script>\"<i>\"</script>"
    got = sql(f"SELECT t.* FROM VALUES ('{page.replace(chr(39), chr(92) + chr(39))}'), (NULL), ('') v(h), LATERAL html_tags(h, NULL) t ORDER BY position").collect()
    assert [(r.position, r.name, r.attributes) for r in got] == [(0, "p", {}), (1, "img", {"src": "x.png", "alt": "a > b"}), (2, "p", {"class": "k"}), (3, "script", {})]
    assert all(page[r.start] == "<" and page[r.end - 1] == ">" for r in got)
    assert sql("SELECT count(*) FROM VALUES ('<p><B>') v(h), LATERAL html_tags(h, 'P') t").first()[0] == 1
    left = sql("SELECT v.k, t.name FROM VALUES (1, '<p>'), (2, NULL) v(k, h) LEFT JOIN LATERAL html_tags(h, 'p') t ON true ORDER BY k").collect()
    assert [tuple(r) for r in left] == [(1, "p"), (2, None)]


@pytest.mark.parametrize("query", ["html_tags('x', h)", "html_tags(1, 'p')", "json_ld_nodes(3)"])
def test_arguments_are_checked_when_the_query_is_analysed(sql, query):
    with pytest.raises(AnalysisException, match="must be"):
        sql(f"SELECT * FROM VALUES ('p') v(h), LATERAL {query} t").schema  # noqa: B018


def test_nodes_of_any_depth(spark, sql):
    value = {"@type": ["Leaf", 3, "Last"], "name": "end"}
    for k in range(60):
        value = {"@id": f"n{k}", "hasPart": [[[[[value]]]]]}
    page = f'<script type="application/ld+json">{json.dumps(value)}</script><script type="application/ld+json">not json</script>'
    spark.createDataFrame([(page,), (None,), ("<p>",)], "h string").createOrReplaceTempView("sql_names_pages")
    got = sql("SELECT n.* FROM sql_names_pages, LATERAL json_ld_nodes(h) n ORDER BY depth").collect()
    assert [r.depth for r in got] == list(range(61)) and got[0].id == "n59" and got[60].types == ["Leaf", "Last"] and got[60].name == "end"
    assert got[60].path == "$" + ".hasPart[0][0][0][0][0]" * 60 and json.loads(got[60].node)["name"] == "end"


def test_jobs_equal_the_operator(spark, sql):
    bodies = {
        "ashby": {"jobs": [{"id": "1", "title": "A", "isListed": False}, {"title": "B", "jobUrl": "u"}, {}]}, "greenhouse": {"jobs": [{"id": 4, "title": "C"}, None]},
        "lever": [{"id": "x", "text": "D", "salaryRange": {"min": 1, "max": 2, "currency": "EUR"}}] + [{"id": f"k{k}"} for k in range(600)], "other": [{"id": 1}],
    }
    rows = [(p, "b", json.dumps(b)) for p, b in bodies.items()] + [("lever", "bad", "{"), ("lever", "null", None)]
    df = spark.createDataFrame(rows, "platform string, board string, body string")
    df.createOrReplaceTempView("sql_names_boards")
    key = lambda r: (r.platform, r.ord)
    got = sql("SELECT platform, board, j.* FROM sql_names_boards, LATERAL jobs(platform, body) j").collect()
    assert sorted(got, key=key) == sorted(boards.jobs(df).collect(), key=key) and len(got) == 502


def test_schemas_by_name(sql):
    got = sql("""SELECT validate_json('small', '3').valid a, validate_json('small', '4').message b, validate_json("it's", '{"c":1.0}').valid c, validate_json("it's", '"a\\'b"').valid d,
        validate_json('none', '1') e, validate_json('small', NULL).message f""").first()
    assert tuple(got) == (True, "$ must be <= 3", True, True, None, "$ is not valid JSON")
