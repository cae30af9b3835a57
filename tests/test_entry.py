import __spark_entry__


def test_contract(spark):
    rows = __spark_entry__.entry(spark).collect()
    assert len(rows) == 5 and rows[0].asDict().keys() == {"c_mktsegment", "n_orders", "revenue"}
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
