import duckdb
import pytest

from captionforge.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name not in ORACLES:
        assert len(got)
        return
    con = duckdb.connect()
    for t in ("conversations", "embeddings", "events", "documents", "labels", "pages"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.sql(ORACLES[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = lambda x: sorted(map(str, x[columns].astype(object).where(x[columns].notna(), None).itertuples(index=False, name=None)))
    assert rows(got) == rows(want)
