"""Expectations that follow from the formulas, on small tables."""

import pytest
from pyspark.sql import functions as F

from treeloom.functions import similarity as sim
from treeloom.functions import text as t
from treeloom.operators import matching, tree
from treeloom.sources import tables


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("f", "text", "want"),
    [
        (t.normalize_heading_title, "1.2. Setup", "setup"), (t.normalize_heading_title, "2024. Plan", "2024. plan"), (t.normalize_heading_title, "IV) End", "end"),
        (lambda x: t.normalize_heading_title(x, nfkc=True), "① Ａ", "1 a"), (t.slugify_heading, "Hello,  World_x", "hello-world-x"), (t.normalize_identifier, "  Foo 　 BAR ", "foo bar"),
        (t.cjk_bigrams, "你好世界", ["你好", "好世", "世界"]), (t.cjk_bigrams, "你", ["你"]), (t.cjk_bigrams, "", []), (t.tokenize_text, "Don't 3.14 a_b!", ["don't", "3.14", "a_b"]),
        (t.tokenize_text, "ab你好世cd", ["ab", "你好", "好世", "cd"]), (t.character_ngrams, "ABcd", ["abc", "bcd"]), (t.character_ngrams, "A", ["a"]), (t.character_ngrams, "", []),
        (t.excerpt, "x" * 51, "x" * 50 + "…"), (t.extract_attribution, " A b：c: d", "A b"), (t.leading_spaces, "   x", 3), (t.tokenize_for_similarity, "ab 好c d", ["ab", "好", "c", "d"]),
    ],
)
def test_text(spark, f, text, want):
    assert one(spark, f(F.lit(text))) == want


def test_similarities(spark):
    arr = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    assert one(spark, sim.jaccard(arr("a", "b", "c"), arr("b", "c", "d"))) == 0.5 and one(spark, sim.jaccard(arr(), arr())) == 1
    assert one(spark, sim.multiset_jaccard(arr("a", "a", "b"), arr("a", "b", "b"))) == 0.5 and one(spark, sim.multiset_jaccard(arr(), arr("a"))) == 0
    assert one(spark, sim.sequence_similarity(arr("a", "quick", "brown", "fox"), arr("a", "slow", "brown", "fox", "jumps"))) == pytest.approx(0.6)
    assert one(spark, sim.range_closeness(F.lit(10), F.lit(14))) == pytest.approx(0.6)
    assert one(spark, sim.is_path_suffix(arr("A", "B", "C"), arr("B", "C"))) and not one(spark, sim.is_path_suffix(arr("A", "B"), arr("C")))
    assert one(spark, sim.structure_fallback(F.lit(1.0), F.lit(10), F.lit(5), F.lit(1.0), *sim.PARAGRAPH[2])) == pytest.approx(0.75)
    true, one_ = F.lit(True), F.lit(1.0)
    assert one(spark, sim.heading_similarity(one_, F.lit(False), true, one_, true)) == pytest.approx(0.85)
    assert one(spark, t.hamming(F.lit("00000000000000ff"), F.lit("ff000000000000ff"))) == 8


def test_margins_and_mutual_best(spark):
    df = spark.createDataFrame([(1, "a", "x", 0.9), (1, "a", "y", 0.7), (1, "b", "y", 0.9), (1, "c", "z", 0.5)], "p int, o string, n string, score double")
    got = {(r["o"], r["n"]): (r["margin_old"], r["margin_new"]) for r in matching.margins(df, ["p", "o"], ["p", "n"]).collect()}
    assert got["a", "x"] == (0.2, 1.0) and got["b", "y"] == (1.0, 0.2) and got["c", "z"] == (1.0, 1.0)
    assert {(r["o"], r["n"]) for r in matching.mutual_best(df, ["p", "o"], ["p", "n"]).collect()} == {("a", "x"), ("b", "y")}


def test_subtree_hashes_tell_shapes_apart(spark):
    row = lambda p, i, up, d, k: (p, "old", i, up, "heading", d, k, 0, 0, i, "", None)
    schema = "pair_id long, side string, node_id string, parent_id string, kind string, depth int, sibling_index int, sort_a long, sort_b int, title string, text string, checked boolean"
    trees = [row(1, "a", None, 0, 0), row(1, "b", "a", 1, 0), row(1, "c", "a", 1, 1), row(2, "a", None, 0, 0), row(2, "b", "a", 1, 0), row(2, "c", "b", 2, 0), row(3, "a", None, 0, 0), row(3, "b", "a", 1, 0), row(3, "c", "a", 1, 1)]
    h = {(r["pair_id"], r["node_id"]): r["subtree_hash"] for r in tree.hashed(spark.createDataFrame(trees, schema)).collect()}
    assert h[1, "a"] == h[3, "a"] != h[2, "a"] and h[1, "c"] == h[2, "c"]


def test_text_files(spark, tmp_path):
    (tmp_path / "a.md").write_text("# é")
    (tmp_path / "b.txt").write_text("x" * (tables.MOST_BYTES + 1))
    (tmp_path / "c.bin").write_text("no")
    got = {r["path"].rsplit("/", 1)[1]: r for r in tables.text_files(spark, str(tmp_path)).collect()}
    assert set(got) == {"a.md", "b.txt"} and got["a.md"]["text"] == "# é" and got["b.txt"]["text"] is None and "limit" in got["b.txt"]["error"]
