"""What a comparison leaves unmade, and hashes made when asked for."""

import gc

from pyspark.sql import functions as F

from treeloom.plans import engine, pairs, similarity
from treeloom.plans.document import Document, Node, canonical, md5

TEXT = '# A "title"\n\nwords of a text with *stress*\n\n- [x] one\n- two\n\n| a | b |\n| :-- | --- |\n| 1 | 2 |\n\n[x]: /y "z"'


def test_equal_documents_need_no_words():
    _, c = engine.compare(TEXT, TEXT)
    assert not any("tokens" in vars(n) or "text" in vars(n) for d in (c.old, c.new) for n in d.nodes)


def test_hashes_are_those_of_canonical_json():
    for n in Document(TEXT).nodes:
        kids = [c.hashes for c in n.children]
        body = md5(canonical([k["subtree"] for k in kids]))
        own = [n.kind, n.normal if n.kind == "heading" else "", n.heading_depth, n.list_depth, n.quote_depth, n.checked, n.ordered, n.value, n.lang, n.meta, n.url, n.link_title, n.align, [[c for _, c in r] for r in n.rows], n.inline]
        own += [n.identifier if n.entity == "block" or n.kind == "footnote" else None, body if n.kind in ("listItem", "blockquote", "footnote") else None]
        assert n.hashes["self"] == md5(canonical(own)) and n.hashes["body"] == body
        assert n.hashes["direct"] == md5(canonical([n.hashes["self"], [k["self"] for k in kids]])) and n.hashes["subtree"] == md5(canonical([n.hashes["self"], [k["subtree"] for k in kids]]))


def test_sketches_are_those_of_one_hash_at_a_time():
    found = ["a", "bc", "\U0001f600x", "word" * 9]
    for k, least in enumerate(similarity.sketch(found), 1):
        hashes = []
        for t in found:
            h = k * 2654435761 & 0xFFFFFFFF
            for c in t:
                h = (h ^ ord(c)) * 16777619 & 0xFFFFFFFF
            hashes.append(h)
        assert least == min(hashes)


def test_batches_hold_many_pairs_and_wanted_columns_alone(spark):
    df = spark.range(0, 300, 1, 1).select(F.col("id").alias("pair_id"), F.lit("# A\n\nb").alias("old_md"), F.lit("# A\n\nc").alias("new_md"))
    assert pairs.compared(df).mapInArrow(lambda batches: batches, pairs.compared(df).schema).count() == 900
    nodes = pairs.nodes_of(df.select("pair_id", F.lit("old").alias("side"), F.col("old_md").alias("md")), "kind", "line_start")
    assert nodes.columns == ["pair_id", "side", "node_id", "parent_id", "kind", "line_start"] and nodes.count() == 900
    about = pairs.detailed(df.limit(1), about=True).select("kind", "op", "renamed", "new_text").collect()
    assert [tuple(r) for r in about] == [("paragraph", "replace", False, "c")]


def test_a_told_comparison_leaves_no_cycles():
    gc.collect()
    gc.disable()
    try:
        before = gc.get_count()[0]
        for _ in range(50):
            assert engine.told(TEXT, f"{TEXT}\n\nmore", None, True, lambda root, c: pairs.some_rows(root, c.warnings, ["op"], "shown"))
        assert not gc.isenabled() and gc.get_count()[0] - before < 1000 and not any(isinstance(x, Node) for x in gc.get_objects())
    finally:
        gc.enable()
