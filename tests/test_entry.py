import __spark_entry__ as entry_module


def test_entry(spark):
    rows = entry_module.entry(spark).collect()
    assert len(rows) == 20 and {r.status for r in rows} == {"purchase"} and [r.id for r in rows] == sorted(r.id for r in rows)


def test_every_oracle_has_a_query():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
