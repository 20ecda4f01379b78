"""Order trees come from one reading of their items, and matching tells nodes by numbers."""

from pyspark.sql import functions as F

from treeloom.functions.text import collapse_whitespace, normalize_heading_title, strip_heading_prefix, trimmed
from treeloom.operators import matching as m
from treeloom.operators import tree
from treeloom.plans import tree_queries as q
from treeloom.sources.tables import order_sections, table, trees, unfolded

DIR = "/root/testdata/sf0.001"


def test_items_are_read_and_dealt_once(spark):
    plan = trees(spark, DIR)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("l_linenumber") and plan.count("lineitem") <= 1 and plan.count("Join") <= 2


def test_hashes_of_sections_are_those_of_nodes(spark):
    rows = [(1, "old", "o1", "c1", "1. A", 0, [(0, "l1", "x", True), (1, "l2", None, None)]), (1, "old", "o2", "c1", "", 1, []), (1, "new", "o1", "c1", "A  b", 0, [(0, "l1", "x y", False)])]
    kind = "pair_id long, side string, node_id string, parent_id string, title string, sibling_index int, items array<struct<sibling_index:int,node_id:string,text:string,checked:boolean>>"
    sections = spark.createDataFrame(rows, kind)
    hashes = ["self_hash", "direct_hash", "subtree_hash", "body_hash"]
    roots = spark.createDataFrame([(1, "old", "c1", "r"), (1, "new", "c1", "r"), (2, "old", "c2", "s")], "pair_id long, side string, node_id string, title string")
    hashed = tree.hashed_sections(sections)
    got = q._unfolded(hashed).select("pair_id", "side", "node_id", *hashes).union(tree.hashed_roots(roots, hashed).select("pair_id", "side", "node_id", *hashes))
    top = roots.select("pair_id", "side", "node_id", F.lit(None).cast("string").alias("parent_id"), F.lit("root").alias("kind"), F.lit(0).alias("depth"), F.lit(0).alias("sibling_index"), F.lit(0).alias("sort_b"), "title", F.lit("").alias("text"), F.lit(None).cast("boolean").alias("checked"))
    want = tree.hashed(top.unionByName(unfolded(sections, []).drop("number", "parent_number"))).select("pair_id", "side", "node_id", *hashes)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() == 9


def test_numbers_tell_nodes_of_a_side(spark):
    rows = unfolded(order_sections(*(table(spark, DIR, x) for x in ("customer", "orders", "lineitem"))), [])
    n = rows.count()
    assert n == rows.select("pair_id", "side", "number").distinct().count() == rows.select("pair_id", "side", "node_id").distinct().count()


def test_covered_nodes_are_no_candidates(spark):
    nodes = spark.createDataFrame([(1, s, i, p) for s in ("old", "new") for i, p in ((1, -1), (2, 1), (3, -1))], "pair_id long, side string, node_id long, parent_id long")
    exact = spark.createDataFrame([(1, 1, 1)], "pair_id long, old_id long, new_id long")
    assert {(r["side"], r["node_id"]) for r in m.uncovered(nodes, exact).collect()} == {("old", 3), ("new", 3)}


def test_plain_titles_are_normalised_as_all_others(spark):
    titles = ["Order 3 URGENT", "1. Intro", "iv) The  End ", "2001. A year", "1.  two", "", " x", "x ", "a\tb", "Ä b", "12.3: x 4. y", "1. ", "x\n", "- a"]
    df = spark.createDataFrame([(x,) for x in [*titles, None]], "x string")
    slow = collapse_whitespace(strip_heading_prefix(F.lower(trimmed(F.col("x")))))
    assert all(r[0] == r[1] for r in df.select(normalize_heading_title(F.col("x")), slow).collect())
