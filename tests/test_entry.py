import __spark_entry__ as e


def test_entry(spark):
    df = e.entry(spark)
    assert {"idx_a", "idx_b", "score"} <= set(df.columns)
    assert df.count() >= 0
    assert set(e.oracle_sql()) <= set(e.queries())
