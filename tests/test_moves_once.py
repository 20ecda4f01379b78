"""ledger_moves makes the documents once."""

from treeloom.plans import ledger_queries, pairs

DIR = "/root/testdata/sf0.001"


def test_documents_are_not_made_again(spark):
    plan = ledger_queries.ledger_moves(spark, DIR)._jdf.queryExecution().executedPlan().toString()
    assert "lineitem" not in plan and "l_orderkey" not in plan


def test_old_text_comes_where_it_is_asked_for(spark):
    df = spark.createDataFrame([(1, "a b\n\nc", "c\n\nx y z")], "pair_id long, old_md string, new_md string")
    got = {r["old_text"] for r in pairs.compared(df, columns=("op", "old_text")).collect()}
    assert "a b" in got and "old_text" not in pairs.compared(df).columns
