"""Every query with SQL gives the same rows in both engines."""

import duckdb
import pytest

from quillmill.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


def plain(df):
    cols = sorted(df.columns)
    return df[cols].astype(str).replace({"None": "<NA>", "nan": "<NA>"}).sort_values(cols).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_sql(spark, duck, small, name):
    a, b = plain(registry.queries()[name](spark, small).toPandas()), plain(duck.sql(registry.oracle_sql()[name]).df())
    assert list(a.columns) == list(b.columns) and len(a) == len(b)
    assert a.equals(b)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_other_queries_give_rows(spark, small, name):
    assert registry.queries()[name](spark, small).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["document_id", "signals", "snippet"]
    assert set(registry.queries()) <= set(entry.queries())
