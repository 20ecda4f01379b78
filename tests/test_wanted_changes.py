"""Comparisons that make and hand over only what is asked for."""

import itertools

from pyspark.sql import functions as F

from treeloom.plans import engine, pairs
from treeloom.sources.ledgers import ledgers

DIR = "/root/testdata/sf0.001"


def test_wanted_columns_of_wanted_changes(spark):
    p = ledgers(spark, DIR).filter("pair_id <= 40").cache()
    whole = pairs.compared(p).cache()
    shown = (F.col("op") != "equal") | F.col("renamed") | F.col("reordered")
    kept = {"all": F.lit(True), "shown": shown, "counted": shown | (F.col("ord") == 0) | (F.size("warnings") > 0), "moved": F.col("move_id") != "", "meta": F.size("meta") > 0, "spans": F.size("spans") > 0, "warned": F.size("warnings") > 0}
    assert set(kept) == set(pairs.KEPT)
    names = [f.name for f in pairs.CHANGE]
    for keep, rule in kept.items():
        for columns in (names, ["meta", "old_line"], ["parent_change_id", "change_id", "spans"], ["ord", "inline_changed", "warnings"]):
            got = pairs.compared(p, columns=columns, keep=keep)
            assert got.columns == ["pair_id", *columns]
            assert sorted(map(str, got.collect())) == sorted(map(str, whole.filter(rule).select("pair_id", *columns).collect())), (keep, columns)


def test_keys_are_equal_where_hashes_are(spark):
    for r in ledgers(spark, DIR).filter("pair_id <= 10").collect():
        _, c = engine.compare(r["old_md"], r["new_md"] + "\n\n> quote\n\n[^a]: note\n\n[^b]: note\n\n| x |\n| :-- |\n| *y* |")
        nodes = c.old.nodes + c.new.nodes
        for name in ("self", "subtree", "body", "direct", "identity", "content"):
            assert len({(n.keys[name], n.hashes[name]) for n in nodes}) == len({n.keys[name] for n in nodes}) == len({n.hashes[name] for n in nodes})
        assert all(n.keys["self"] is not n.hashes["self"] for n in nodes)


def test_pairs_are_dealt_evenly(spark):
    """Not joined to as many tasks as cores by adaptive plans, nor read from a small file by one task."""
    from treeloom.plans.source_queries import part_notes

    least = 4 * spark.sparkContext.defaultParallelism
    assert ledgers(spark, DIR).rdd.getNumPartitions() >= least and part_notes(spark, DIR).rdd.getNumPartitions() >= least
    assert list(itertools.islice(ledgers(spark, DIR).select("pair_id").distinct().toLocalIterator(), 1))
