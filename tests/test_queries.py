"""Every query of the core with SQL gives what the SQL gives."""

import duckdb
import pytest

from farpoint.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = ("orders", "part", "events", "embeddings")


def plain(v):
    """Numbers of any kind as floats: a column of whole numbers with nulls is read as one or the other."""
    if v is None or v != v:
        return None
    return v if isinstance(v, (bool, str)) or not hasattr(v, "__float__") else float(v)


def rows(frame):
    cols = sorted(frame.columns)
    return sorted(repr(tuple(map(plain, r))) for r in frame[cols].astype(object).where(frame[cols].notna(), None).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want, got = con.execute(ORACLES[name]).df(), QUERIES[name](spark, SF).toPandas()
    assert sorted(want.columns) == sorted(got.columns)
    assert rows(got) == rows(want)
