"""A document that is nested too deep to be read is told from an empty one."""

from pyspark.sql import functions as F

from treeloom.plans import change_queries, pairs
from treeloom.plans.document import TOO_DEEP, UNREADABLE, readable


def test_a_document_that_cannot_be_read_says_so(spark):
    df = spark.createDataFrame([(1, "> " * 3000 + "x"), (2, "")], "pair_id long, md string").withColumn("side", F.lit("old"))
    got = {r["pair_id"]: (r["kind"], r["title"]) for r in pairs.nodes_of(df).collect()}
    assert got == {1: (UNREADABLE, TOO_DEEP), 2: ("root", "")}
    assert [(r["pair_id"], r["kind"], r["text"]) for r in pairs.inlines_of(df).collect()] == [(1, UNREADABLE, TOO_DEEP)]


def test_hashes_tell_it_from_an_empty_document(spark, tmp_path):
    deep, empty = readable("> " * 3000 + "x", whole=True), readable("", whole=True)
    assert deep.root.hashes["self"] != empty.root.hashes["self"]
    spark.createDataFrame([(1, "> " * 3000 + "x.." )], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert [(r["kind"], r["title"]) for r in change_queries.markdown_nodes(spark, str(tmp_path)).collect()] == [(UNREADABLE, TOO_DEEP)]
