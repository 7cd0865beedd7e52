import __spark_entry__ as entry


def test_names():
    q, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(q) and "p1_found" in q and "p4_found" in q


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
