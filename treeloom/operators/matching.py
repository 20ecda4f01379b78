"""Matching of nodes or lines of two versions by hashes, evidence and scores.

Tables have pair_id (or another leading key) and side; every join and window is
within a pair, so work spreads over pairs and no step gathers more than one pair.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treeloom.functions.similarity import NINE

# The options that decide about matches.
MIN_SIMILARITY, MIN_MARGIN = 0.55, 0.12
SIBLING_OFFSET, WITNESS_WINDOW = 3, 5
RECALL_DISTANCE, RECALL_MOST = 24, 6
PRIORITY = {"exact-self": 5, "exact-self-with-context": 5, "exact-direct": 4}


def side_of(rows: DataFrame, side: str, pair: str, columns: list[str]) -> DataFrame:
    return rows.filter(F.col("side") == side).select(pair, *(F.col(c).alias(f"{side}_{c}") for c in columns))


def counts_by_hash(rows: DataFrame, pair: str, key: str, node: str, also: Iterable[str] = ()) -> DataFrame:
    """One row for each key: how often it occurs on each side, and the first node there. A single aggregate for both sides.

    also: columns that come along as old_... and new_..., so that no join has to fetch them: of a key that occurs once on a side those of its node, else their least.
    Where nodes are told by numbers this is a hash aggregate; strings are sorted.
    """
    on = lambda s, x: F.when(F.col("side") == s, x)
    first = [F.min(on(s, F.col(c))).alias(f"{s}_{'id' if c == node else c}") for c in (node, *also) for s in ("old", "new")]
    return rows.groupBy(pair, key).agg(F.count(on("old", F.lit(1))).alias("n_old"), F.count(on("new", F.lit(1))).alias("n_new"), *first)


def unique_shared(rows: DataFrame, pair: str, key: str, node: str, also: Iterable[str] = ()) -> DataFrame:
    """(pair, key, old_id, new_id) of keys that occur once on each side, and what ``counts_by_hash`` lets come along."""
    return counts_by_hash(rows, pair, key, node, also).filter("n_old = 1 AND n_new = 1").drop("n_old", "n_new")


def ambiguous_shared(rows: DataFrame, pair: str, key: str, node: str) -> DataFrame:
    """(pair, key, n) of keys that occur equally often, and more than once, on both sides."""
    return counts_by_hash(rows, pair, key, node).filter("n_old = n_new AND n_old >= 2").select(pair, key, F.col("n_old").alias("n"))


def unmatched(rows: DataFrame, matches: DataFrame, pair: str, node: str) -> DataFrame:
    """Rows of either side that no match has."""
    taken = matches.select(pair, F.lit("old").alias("side"), F.col("old_id").alias(node)).unionByName(matches.select(pair, F.lit("new").alias("side"), F.col("new_id").alias(node)))
    return rows.join(taken.hint("shuffle_hash"), [pair, "side", node], "left_anti")


def uncovered(nodes: DataFrame, exact: DataFrame) -> DataFrame:
    """Nodes that are in no exact subtree by themselves or by their parent."""
    rows = unmatched(nodes, exact, "pair_id", "node_id").withColumnsRenamed({"node_id": "own", "parent_id": "node_id"})
    return unmatched(rows, exact, "pair_id", "node_id").withColumnsRenamed({"node_id": "parent_id", "own": "node_id"})


def exact_subtrees(nodes: DataFrame) -> DataFrame:
    """(pair_id, old_id, new_id): unique equal subtrees, largest first.

    A pair whose parent is a unique pair too is covered by it, and so is all below:
    only pairs with no such parent remain. Roots are matched anyway.
    """
    own = unique_shared(nodes.filter("depth > 0"), "pair_id", "subtree_hash", "node_id", ["parent_id"])
    up = own.select("pair_id", F.col("old_id").alias("old_parent_id"))
    return own.join(up.hint("shuffle_hash"), ["pair_id", "old_parent_id"], "left_anti").select("pair_id", "old_id", "new_id")


def with_parent_match(pairs: DataFrame, matches: DataFrame) -> DataFrame:
    """pairs (pair_id, old_id, new_id, with both parent_id and depth) with parents_matched; a root's children have matched parents."""
    known = matches.select("pair_id", F.col("old_id").alias("old_parent_id"), F.col("new_id").alias("new_parent_id"), F.lit(True).alias("known"))
    rows = pairs.join(known, ["pair_id", "old_parent_id", "new_parent_id"], "left")
    return rows.withColumn("parents_matched", F.coalesce("known", F.lit(False)) | ((F.col("old_depth") == 1) & (F.col("new_depth") == 1))).drop("known")


def witnesses(pairs: DataFrame, nodes: DataFrame, window: int = WITNESS_WINDOW) -> DataFrame:
    """(pair_id, old_id, new_id) of pairs with a witness: siblings within the window on both sides that have one self hash. pairs: pair_id, and of both sides id, parent_id and index."""
    own = pairs.select("pair_id", *(f"{s}_{c}" for s in ("old", "new") for c in ("id", "parent_id", "index")))
    near = lambda s: nodes.filter(F.col("side") == s).select("pair_id", F.col("parent_id").alias(f"{s}_parent_id"), F.col("sibling_index").alias(f"{s}_near"), F.col("self_hash").alias("witness"))
    # The pairs are few: they are looked up, and the nodes go by without being sorted.
    both = own.hint("shuffle_hash").join(near("old"), ["pair_id", "old_parent_id"]).filter(F.abs(F.col("old_near") - F.col("old_index")).between(1, window))
    both = both.hint("shuffle_hash").join(near("new"), ["pair_id", "new_parent_id", "witness"]).filter(F.abs(F.col("new_near") - F.col("new_index")).between(1, window))
    return both.select("pair_id", "old_id", "new_id").distinct()


def candidates(nodes: DataFrame, exact: DataFrame) -> DataFrame:
    """(pair_id, old_id, new_id, match_kind, priority) among nodes that no exact subtree covers.

    Equal selves count where the parents match, or near each other with a witness;
    equal selves with equal children's selves count for sections.
    """
    free = uncovered(nodes.filter("depth > 0"), exact)
    same = unique_shared(free, "pair_id", "self_hash", "node_id", ["parent_id", "depth", "sibling_index"])
    same = with_parent_match(same, exact).withColumnsRenamed({"old_sibling_index": "old_index", "new_sibling_index": "new_index"})
    under = same.filter("parents_matched").select("pair_id", "old_id", "new_id", F.lit("exact-self").alias("match_kind"))
    close = same.filter(~F.col("parents_matched") & (F.abs(F.col("old_index") - F.col("new_index")) <= SIBLING_OFFSET))
    close = witnesses(close, nodes).withColumn("match_kind", F.lit("exact-self-with-context"))
    direct = unique_shared(free.filter("kind = 'heading'"), "pair_id", "direct_hash", "node_id").select("pair_id", "old_id", "new_id", F.lit("exact-direct").alias("match_kind"))
    rows = under.unionByName(close).unionByName(direct)
    rank = F.create_map(*(F.lit(x) for kv in PRIORITY.items() for x in kv))
    return rows.withColumn("priority", rank[F.col("match_kind")])


def highest_priority(rows: DataFrame) -> DataFrame:
    """Candidates that are of the highest priority for both of their ends."""
    old, new = Window.partitionBy("pair_id", "old_id"), Window.partitionBy("pair_id", "new_id")
    top = rows.withColumn("top_old", F.max("priority").over(old)).withColumn("top_new", F.max("priority").over(new))
    return top.filter("priority = top_old AND priority = top_new").drop("top_old", "top_new")


def without_conflicts(rows: DataFrame) -> DataFrame:
    """Candidates whose ends have no other partner; an end with several gets none."""
    rows = rows.select("pair_id", "old_id", "new_id").distinct()
    alone = lambda s: F.count("*").over(Window.partitionBy("pair_id", f"{s}_id")) == 1
    return rows.withColumn("a", alone("old")).withColumn("b", alone("new")).filter("a AND b").drop("a", "b")


def anchor_intervals(lines: DataFrame, anchors: DataFrame, pair: str) -> DataFrame:
    """(pair, pos, low, high) of old rows: between the new places of the nearest anchors; an empty interval allows all (nulls)."""
    rows = lines.filter("side = 'old'").select(pair, "pos").join(anchors.select(pair, F.col("old_id").alias("pos"), "new_id"), [pair, "pos"], "left")
    before = Window.partitionBy(pair).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(pair).orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("low", F.last("new_id", ignorenulls=True).over(before)).withColumn("high", F.last("new_id", ignorenulls=True).over(after))
    empty = F.coalesce(F.col("low") >= F.col("high"), F.lit(False))
    return rows.select(pair, "pos", F.when(~empty, F.col("low")).alias("low"), F.when(~empty, F.col("high")).alias("high"))


def sibling_bounds(nodes: DataFrame, matches: DataFrame) -> DataFrame:
    """(pair_id, node_id, left_old, left_new, right_old, right_new) of old nodes: the nearest matched siblings and their partners' places."""
    place = nodes.filter("side = 'new'").select("pair_id", F.col("node_id").alias("new_id"), F.col("sibling_index").alias("partner"))
    known = matches.select("pair_id", F.col("old_id").alias("node_id"), "new_id").join(place, ["pair_id", "new_id"]).drop("new_id")
    rows = nodes.filter("side = 'old' AND depth > 0").select("pair_id", "node_id", "parent_id", "sibling_index").join(known, ["pair_id", "node_id"], "left")
    w = Window.partitionBy("pair_id", "parent_id")
    found = F.when(F.col("partner").isNotNull(), F.struct(F.col("sibling_index").alias("o"), F.col("partner").alias("n")))
    nearest = lambda order: F.last(found, ignorenulls=True).over(w.orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("l", nearest(F.asc("sibling_index"))).withColumn("r", nearest(F.desc("sibling_index")))
    return rows.select("pair_id", "node_id", F.col("l.o").alias("left_old"), F.col("l.n").alias("left_new"), F.col("r.o").alias("right_old"), F.col("r.n").alias("right_new"))


def recalled(rows: DataFrame, distance: Column, old: list[str], tie: list, most: int = RECALL_MOST, limit: int = RECALL_DISTANCE) -> DataFrame:
    """Of each old row's candidates: all if they are few, else the nearest within the distance, or all if none is."""
    w = Window.partitionBy(*old)
    rows = rows.withColumn("distance", distance).withColumn("n", F.count("*").over(w)).withColumn("near", F.count(F.when(F.col("distance") <= limit, 1)).over(w))
    rows = rows.withColumn("at", F.row_number().over(w.orderBy(F.col("distance") > limit, "distance", *tie)))
    return rows.filter((F.col("n") <= most) | (F.col("near") == 0) | ((F.col("distance") <= limit) & (F.col("at") <= most))).drop("n", "near", "at")


def margins(scored: DataFrame, old: list[str], new: list[str]) -> DataFrame:
    """scored with margin_old and margin_new: the best score less the second best, 1 if there is one only."""

    def margin(keys):
        w = Window.partitionBy(*keys).orderBy(F.desc("score"))
        full = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        return F.coalesce(F.round(F.first("score").over(full) - F.nth_value("score", 2).over(full), NINE), F.lit(1.0))

    return scored.withColumn("margin_old", margin(old)).withColumn("margin_new", margin(new))


def mutual_best(scored: DataFrame, old: list[str], new: list[str], least: float = MIN_SIMILARITY, margin: float = MIN_MARGIN) -> DataFrame:
    """Pairs that are the best for both ends, score enough, and lead clearly on both sides."""
    best = lambda keys: F.max("score").over(Window.partitionBy(*keys))
    rows = margins(scored, old, new).withColumn("best_old", best(old)).withColumn("best_new", best(new))
    return rows.filter((F.col("score") == F.col("best_old")) & (F.col("score") == F.col("best_new")) & (F.col("score") >= least) & (F.col("margin_old") >= margin) & (F.col("margin_new") >= margin)).drop("best_old", "best_new")


def told_apart(members: DataFrame, keys: DataFrame) -> DataFrame:
    """(pair_id, group, old_id, new_id) of groups of equally many nodes on both sides that their children tell apart.

    members: pair_id, side, group, node_id. keys: pair_id, side, node_id, child. A child
    counts where it stands once below its node, and it is evidence if one new node of
    the group alone has it so. A group is resolved as a whole or not at all.
    """
    once = keys.groupBy("pair_id", "side", "node_id", "child").count().filter("count = 1").drop("count").join(members, ["pair_id", "side", "node_id"])
    single = once.filter("side = 'new'").groupBy("pair_id", "group", "child").agg(F.count("*").alias("n"), F.min("node_id").alias("new_id")).filter("n = 1").drop("n")
    found = once.filter("side = 'old'").join(single, ["pair_id", "group", "child"]).groupBy("pair_id", "group", F.col("node_id").alias("old_id"))
    found = found.agg(F.min("new_id").alias("new_id"), F.max("new_id").alias("other")).filter("new_id = other").drop("other")
    size = members.groupBy("pair_id", "group").agg(F.count_if(F.col("side") == "old").alias("n_old"), F.count_if(F.col("side") == "new").alias("n_new"))
    whole = found.groupBy("pair_id", "group").agg(F.count("*").alias("n"), F.countDistinct("new_id").alias("different")).join(size, ["pair_id", "group"])
    return found.join(whole.filter("n = n_old AND n = n_new AND n = different").select("pair_id", "group"), ["pair_id", "group"], "left_semi")


def neighbours_matched(pairs: DataFrame, nodes: DataFrame, matches: DataFrame) -> DataFrame:
    """pairs (pair_id, old_id, new_id) where a node next to the old one has its partner next to the new one."""
    of = lambda s, name: nodes.filter(F.col("side") == s).select("pair_id", F.col("node_id").alias(f"{s}_{name}"), F.col("parent_id").alias(f"{s}_parent"), F.col("sibling_index").alias(f"{s}_{name}_at"))
    own = pairs.select("pair_id", "old_id", "new_id").join(of("old", "id"), ["pair_id", "old_id"]).join(of("new", "id"), ["pair_id", "new_id"])
    near = lambda s: F.abs(F.col(f"{s}_near_at") - F.col(f"{s}_id_at")) == 1
    known = matches.select("pair_id", F.col("old_id").alias("old_near"), F.col("new_id").alias("new_near")).join(of("old", "near"), ["pair_id", "old_near"]).join(of("new", "near"), ["pair_id", "new_near"])
    return own.join(known, ["pair_id", "old_parent", "new_parent"]).filter(near("old") & near("new")).select("pair_id", "old_id", "new_id").distinct()


def bounded(rows: DataFrame, bounds: DataFrame) -> DataFrame:
    """Candidates (pair_id, old_id, new_id, new_index) between the partners of the old node's nearest matched siblings; all of a node's if none is.

    bounds: as ``sibling_bounds`` gives them.
    """
    edges = bounds.select("pair_id", F.col("node_id").alias("old_id"), "left_new", "right_new")
    inside = (F.col("new_index") > F.coalesce("left_new", F.lit(-1))) & (F.coalesce(F.col("new_index") < F.col("right_new"), F.lit(True)))
    rows = rows.join(edges, ["pair_id", "old_id"]).withColumn("inside", inside)
    some = F.max("inside").over(Window.partitionBy("pair_id", "old_id"))
    return rows.withColumn("some", some).filter("inside OR NOT some").drop("inside", "some", "left_new", "right_new")


def child_shapes(pairs: DataFrame, nodes: DataFrame, shape: Column) -> DataFrame:
    """pairs (pair_id, old_id, new_id) with score: how alike the shapes of both nodes' children are as multisets; 1 without children."""
    counts = nodes.filter("depth > 0").groupBy("pair_id", "side", F.col("parent_id").alias("node_id"), shape.alias("shape")).agg(F.count("*").alias("n"))
    each = F.array(F.struct(F.lit("old").alias("side"), F.col("old_id").alias("node_id")), F.struct(F.lit("new").alias("side"), F.col("new_id").alias("node_id")))
    rows = pairs.select("pair_id", "old_id", "new_id").withColumn("x", F.explode(each)).select("pair_id", "old_id", "new_id", "x.*").join(counts, ["pair_id", "side", "node_id"], "left")
    on = lambda s: F.coalesce(F.sum(F.when(F.col("side") == s, F.col("n"))), F.lit(0)).alias(s)
    both = rows.groupBy("pair_id", "old_id", "new_id", "shape").agg(on("old"), on("new"))
    most = F.sum(F.greatest("old", "new"))
    return both.groupBy("pair_id", "old_id", "new_id").agg(F.when(most > 0, F.round(F.sum(F.least("old", "new")) / most, NINE)).otherwise(1.0).alias("score"))
