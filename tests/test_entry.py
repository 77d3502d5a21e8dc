import __spark_entry__ as entry
import duckdb
import pytest

from foliant.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def values(frame):
    cols = sorted(frame.columns)
    return sorted(repr(tuple(None if v is None or v != v else round(v, 9) if isinstance(v, float) else str(v) for v in r)) for r in frame[cols].astype(object).itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_against_sql(spark, duck, name):
    assert values(catalogue.queries()[name](spark, SF).toPandas()) == values(duck.sql(catalogue.oracle_sql()[name]).df())


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_without_sql(spark, name):
    assert catalogue.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).columns == ["phrase", "ngram_len", "frequency", "context_window"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
