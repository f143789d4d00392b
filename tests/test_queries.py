"""Every core query against its SQL on the smallest tables, and the entry point."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__
from siltstone.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def rows(df):
    columns = sorted(df.columns)
    plain = lambda v: None if v is None or v is pd.NA or v != v else v.item() if hasattr(v, "item") else v
    return sorted((tuple(plain(v) for v in r) for r in df[columns].itertuples(index=False)), key=repr), columns


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, sf_dir, db, name):
    ours = rows(catalog.queries()[name](spark, sf_dir).toPandas())
    theirs = rows(db.execute(catalog.oracle_sql()[name]).df())
    assert ours[1] == theirs[1] and len(ours[0]) == len(theirs[0]) and ours[0] == theirs[0]


def test_queries_without_sql(spark, sf_dir):
    for name in set(catalog.queries()) - set(catalog.oracle_sql()):
        assert catalog.queries()[name](spark, sf_dir).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
