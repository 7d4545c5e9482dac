import __spark_entry__


def test_registry():
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert sql.keys() <= queries.keys()
    assert all(callable(q) for q in queries.values())


def test_flagship(spark):
    df = __spark_entry__.entry(spark)
    assert df.count() > 0
    assert len(set(df.columns)) == len(df.columns)
