"""Steps of a comparison that decide about matches: repeated subtrees, anchors, fallback, definitions, renames and moves."""

from treeloom.plans import engine as e
from treeloom.plans import similarity as s
from treeloom.plans.document import Document, structured_tokens


def comparison(old, new):
    return e.Comparison(Document(old), Document(new), e.Options())


def nodes(doc, kind):
    return [n for n in doc.nodes if n.kind == kind]


def test_nodes_are_told_apart_by_a_child_that_one_partner_has():
    c = comparison("- x\n- y", "- x\n- y")
    olds, news = nodes(c.old, "listItem"), nodes(c.new, "listItem")
    keys = {id(olds[0]): "pa", id(olds[1]): "pb", id(news[0]): "pb", id(news[1]): "pa"}
    key = lambda n: list(keys[id(n)])
    assert e.told_apart(olds, news, key) == [(olds[0], news[1]), (olds[1], news[0])]
    keys[id(news[1])] = "pb"
    assert e.told_apart(olds, news, key) == [] and e.told_apart(olds, news[:1], key) == []
    # Equal subtrees have equal children: nothing tells them apart, and none is matched by guess.
    c = comparison("- a\n  - k\n- a\n  - k", "- a\n  - k\n- a\n  - k")
    c.deterministic()
    assert "exact-subtree-resolved" not in {k for k, _ in c.kind.values()}


def test_anchors_bound_where_a_partner_lies():
    c = comparison("# A\n\none\n\n# B\n\ntwo\n\n# C\n\nthree", "# A\n\none\n\n# B\n\nnew\n\n# C\n\nthree")
    assert c.interval(c.old.nodes[3]) == (0, len(c.new.nodes) - 1)
    c.deterministic()
    two = next(n for n in c.old.nodes if n.text == "two")
    low, high = c.interval(two)
    assert low <= next(n for n in c.new.nodes if n.text == "new").preorder <= high < next(n for n in c.new.nodes if n.title == "C").preorder
    c.anchors = [(2, 9), (5, 3)]
    assert c.interval(c.old.nodes[4]) is None
    c.anchors = [(2, 4), (5, 9)]
    assert c.interval(c.old.nodes[4]) == (5, 8)


def test_fallback_scores():
    a, b = Document("# T\n\none\n\ntwo"), Document("# T\n\none\n\nthree")
    p, q = a.nodes[1], b.nodes[1]
    assert s.child_shapes(p, q) == 1 and s.closeness(p, q) == 1 and s.same_path(p, q)
    want = 0.35 * s.similarity(p, q, 0.7) + 0.3 + 0.15 + 0.1 + 0.2
    assert abs(s.fallback_score(p, q, 0.7) - min(1, want)) < 1e-12
    assert s.relabel_score(a.nodes[2], b.nodes[2]) == 1 and s.relabel_score(p, a.nodes[2]) == 0 and 0 < s.relabel_score(a.nodes[3], b.nodes[3]) < 1
    assert s.margin([0.4]) == 1 and abs(s.margin([0.9, 0.2, 0.5]) - 0.4) < 1e-12 and s.recallable(p, p)


def test_a_pair_that_the_fallback_rejects_leaves_a_warning():
    root, _ = e.compare("alpha beta gamma", "1234\n\n5678\n\n90")
    assert "tree-no-candidates" in root.warnings


def test_left_over_definitions_become_pairs():
    c = comparison("[k]: /a", "[k]: /b")
    gone, come = e.Change("delete", nodes(c.old, "definition")[0], None), e.Change("insert", None, nodes(c.new, "definition")[0])
    root = e.Change("equal", c.old.root, c.new.root, [gone, come])
    c.match(c.old.root, c.new.root, "forced-root")
    c.recover_definitions(root)
    assert [x.match_kind for x in root.children] == ["definition-identifier"] and c.by_old[gone.old] is come.new


def test_strong_evidence_of_a_rename():
    root, _ = e.compare("# Old words\n\nfirst\n\nsecond\n\nthird", "# Wholly other\n\nfirst\n\nsecond\n\nchanged here")
    assert e.summary(root)["renames"] == 1
    root, _ = e.compare("# One", "# Zwei")
    assert e.summary(root)["renames"] == 0


def test_neighbours_tell_of_a_move():
    c = comparison("- a\n- b\n- c", "- a\n- x\n- c")
    a, b = nodes(c.old, "listItem"), nodes(c.new, "listItem")
    assert not c.neighbours_matched(a[1], b[1])
    c.match(a[0], b[0], "exact-self")
    assert c.neighbours_matched(a[1], b[1]) and not c.neighbours_matched(a[2], b[1])


def test_leads():
    p, q, x, y = (object() for _ in range(4))
    scores = {(p, x): 0.9, (p, y): 0.5, (q, x): 0.6, (q, y): 0.7}
    lead = e.leads(scores)
    rival = lambda a, b: max(v for (i, j), v in scores.items() if (i is a) != (j is b))
    for (a, b), v in scores.items():
        assert abs(lead(a, b, v) - (v - rival(a, b))) < 1e-12
    assert e.leads({(p, x): 0.6})(p, x, 0.6) == 1


def test_links_and_images_are_tokens():
    block = {"type": "paragraph", "children": [{"type": "link", "url": "/To", "title": "Name", "children": [{"type": "text", "value": "x"}]}, {"type": "image", "alt": "Pic", "url": "/i.png", "title": None}]}
    assert structured_tokens(block) == ["type:paragraph", "url:/to", "title:name", "type:link", "type:text", "url:/i.png", "alt:pic", "type:image"]
    assert structured_tokens({"type": "definition", "identifier": " A  b "})[0] == "id:a b"
    a, b = Document("see [x](/one)"), Document("see [x](/two)")
    assert a.nodes[1].tokens == b.nodes[1].tokens and a.nodes[1].sim != b.nodes[1].sim


def test_trees_of_any_depth(spark):
    from treeloom.operators import tree

    rows = [(1, "old", f"n{d}", f"n{d - 1}" if d else None, "heading", d, 0, d, 0, f"t{d}", "x", None) for d in range(7)]
    df = spark.createDataFrame(rows, "pair_id long, side string, node_id string, parent_id string, kind string, depth int, sibling_index int, sort_a long, sort_b int, title string, text string, checked boolean")
    assert {r["node_id"]: r["subtree_size"] for r in tree.placed(df).collect()} == {f"n{d}": 7 - d for d in range(7)}
    found = {r["node_id"]: r for r in tree.hashed(df).collect()}
    assert len(found) == 7 and len({r["subtree_hash"] for r in found.values()}) == 7
    assert {r["node_id"]: r["path"] for r in tree.paths(df).collect()}["n6"] == "t1 / t2 / t3 / t4 / t5 / t6"
    assert tree.hashed(df.limit(0)).count() == 0 and tree.placed(df.limit(0)).count() == 0
