from tests.conftest import SF001


def test_entry_runs_on_smoke_data(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    rows = df.collect()
    assert 0 < len(rows) <= 20
    assert {"row_id", "score", "label", "rank"} <= set(df.columns)
    assert set(E.oracle_sql()) <= set(E.queries())
    assert SF001.endswith("sf0.001")
