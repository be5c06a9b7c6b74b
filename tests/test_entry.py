import __spark_entry__ as entry


def test_contract(spark):
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and all(map(callable, q.values()))
    assert entry.entry(spark).count() == 1
