import __spark_entry__


def test_every_sql_belongs_to_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_flagship_has_rows(spark):
    df = __spark_entry__.entry(spark)
    assert {"query_id", "doc_id", "score", "rank"} == set(df.columns) and df.count() > 0
