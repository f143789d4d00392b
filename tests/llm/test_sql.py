"""The operators that SQL can express, against their SQL on the smallest tables."""

import duckdb
import pytest

from siltstone.llm import registry


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df = registry.queries()[name](spark, sf_dir)
    columns = ", ".join(sorted(df.columns))
    ours = sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=repr)
    theirs = sorted(con.execute(f"SELECT {columns} FROM ({registry.oracle_sql()[name]}) q").fetchall(), key=repr)
    assert ours == theirs and ours
