"""Equal texts, and a text that starts with the other, take no comparison."""

from pyspark.sql import functions as F

from treeloom.functions import similarity as sim
from treeloom.plans.text_queries import PAIR_FUNCTIONS, QUERIES

TEXTS = ["", "a", "ab", "Ab cd", "Ab cd *", "日本 語", "x" * 2001, "x" * 2000 + "y", " "]


def test_scores_are_those_of_a_whole_comparison(spark):
    df = spark.createDataFrame([(a, b) for a in [*TEXTS, None] for b in [*TEXTS, None]], "a string, b string")
    a, b = F.col("a"), F.col("b")
    for f in [*(f for f, _ in PAIR_FUNCTIONS.values()), sim.text_sequence_similarity]:
        assert all(r[0] == r[1] for r in df.select(sim.unless_equal(a, b, f(a, b)), f(a, b)).collect())
    x, y = F.substring(a, 1, 2000), F.substring(b, 1, 2000)
    longest = F.greatest(F.length(x), F.length(y))
    whole = F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(x, y) / longest)
    assert all(r[0] == r[1] for r in df.select(sim.text_sequence_similarity(a, b), whole).collect())


def test_queries_ask_for_equality_first(spark):
    for name in [*PAIR_FUNCTIONS, "text_sequence_similarity"]:
        assert "CASE WHEN (old_text" in QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
