"""What the signatures of documents shuffle."""

import re

from treeloom.plans.text_queries import minhashes


def test_minima_are_not_shuffled_with_each_token(spark):
    docs = spark.createDataFrame([(1, "a b a c"), (1, "c d"), (2, None), (3, ""), (None, "x y")], "doc_id long, text string")
    m = minhashes(docs)
    assert not re.search(r"hashpartitioning\([^)]*token", m._jdf.queryExecution().executedPlan().toString())
    assert {r["doc_id"]: r["n"] for r in m.collect()} == {1: 4, None: 2}
    one = {r["doc_id"]: r["m0"] for r in minhashes(spark.createDataFrame([(1, "d c b a")], "doc_id long, text string")).collect()}
    assert one[1] == m.filter("doc_id = 1").first()["m0"]
