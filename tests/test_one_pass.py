"""Lines and aligned rows of the pass that compares are those made of a table of changes, without a shuffle or a stage table."""

from collections import Counter

from pyspark.sql import functions as F

from treeloom.plans import change_queries, engine, ledger_queries, pairs

DIR = "/root/testdata/sf0.001"


def test_lines_and_rows_are_those_of_changes(spark):
    p = change_queries.markdown_pairs(spark, DIR).limit(60).unionByName(ledger_queries.ledgers(spark, DIR).limit(25).withColumn("pair_id", F.col("pair_id") + 1_000_000))
    some = [(-1, None, "# B\r\n\r\nx"), (-2, "", None), (-3, "> " * 3000 + "x", "y"), (-4, "# A\n\na b c\n\nlast one", "last one\n\n# A\n\na b d")]
    p = p.unionByName(spark.createDataFrame(some, "pair_id long, old_md string, new_md string")).localCheckpoint()
    changes = pairs.compared(p, engine.WHOLE).localCheckpoint()
    plain = lambda df: Counter(map(tuple, df.collect()))
    assert plain(pairs.shown_lines(p, engine.WHOLE)) == plain(pairs.projected(p, changes))
    assert plain(pairs.aligned_rows(p, engine.WHOLE)) == plain(pairs.merged_rows(p, changes))


def test_nothing_is_shuffled_but_the_documents(spark):
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    for query, source in ((change_queries.markdown_merged_rows, change_queries.markdown_pairs), (change_queries.markdown_projection, change_queries.markdown_pairs), (ledger_queries.ledger_projection, ledger_queries.ledgers), (ledger_queries.ledger_merged_rows, ledger_queries.ledgers)):
        made, own = plan(query(spark, DIR)), plan(source(spark, DIR))
        assert made.count("Exchange") == own.count("Exchange") and "Scan ExistingRDD" not in made
