"""What the moves' nodes keep."""

from treeloom.plans.change_queries import _move_nodes


def test_nodes_of_moves_are_small(spark):
    nodes = _move_nodes(spark, "/root/testdata/sf0.001")
    kinds = dict(nodes.dtypes)
    assert not {"title", "text", "checked", "sort_a", "sort_b", "body_hash"} & kinds.keys()
    assert all(kinds[c] == "binary" for c in ("self_hash", "direct_hash", "subtree_hash"))
    assert nodes.filter("length(subtree_hash) <> 16 OR subtree_hash IS NULL").isEmpty() and not nodes.isEmpty()
