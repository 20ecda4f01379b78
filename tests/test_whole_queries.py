"""Queries without SQL, held against the same steps run in one process, or against what any right answer must fulfil."""

import itertools
from collections import Counter, defaultdict

import pytest

from treeloom import catalog
from treeloom.plans import change_queries, engine, kernels, pairs, tree_queries
from treeloom.plans.document import Document
from treeloom.sources.tables import line_versions, table, trees

DIR = "/root/testdata/sf0.001"
TESTED = {
    "markdown_changes", "markdown_stats", "markdown_nodes", "markdown_spans", "markdown_projection", "markdown_merged_rows", "markdown_move_peers", "markdown_details", "markdown_change_index", "change_details", "debug_snapshot",
    "display_warnings", "change_navigation", "myers_edit_script", "heckel_align", "histogram_align", "reorder_marks", "hungarian_pairs", "tree_edit_matches",
}


def test_all_of_them_are_here():
    assert catalog.QUERIES.keys() - catalog.SQL.keys() == TESTED


@pytest.fixture(scope="module")
def made(spark):
    """{pair: (old, new, rows of changes)}"""
    found = {}
    for pair_id, old, new in change_queries.markdown_pairs(spark, DIR).collect():
        root, c = engine.compare(old or "", new or "")
        found[pair_id] = (old or "", new or "", pairs.change_rows(root, c.warnings))
    assert len(found) > 100
    return found


def rows(spark, name):
    return catalog.QUERIES[name](spark, DIR).collect()


def test_changes_and_what_is_made_of_them(spark, made):
    names = [f.name for f in pairs.CHANGE if f.name not in ("warnings", "meta", "spans", "score")]
    want = Counter((k, *(c[n] for n in names), None if c["score"] is None else round(c["score"], 6)) for k, (_, _, own) in made.items() for c in own)
    assert Counter((r["pair_id"], *(r[n] for n in names), r["score"]) for r in rows(spark, "markdown_changes")) == want
    on = lambda own, f: sum(1 for c in own if f(c))
    counted = {
        k: (on(own, lambda c: c["op"] == "insert"), on(own, lambda c: c["op"] == "delete"), on(own, lambda c: c["op"] == "replace"), len({c["move_id"] for c in own if c["move_id"]}), on(own, lambda c: c["renamed"]), on(own, lambda c: c["reordered"]))
        for k, (_, _, own) in made.items()
    }
    columns = ("inserts", "deletes", "replaces", "moves", "renames", "reorders")
    assert {r["pair_id"]: tuple(r[c] for c in columns) for r in rows(spark, "markdown_stats")} == counted
    assert {r["pair_id"]: tuple(r[c] for c in columns) for r in rows(spark, "debug_snapshot")} == counted
    spans = Counter((k, c["change_id"], at, *s.values()) for k, (_, _, own) in made.items() for c in own for at, s in enumerate(c["spans"]))
    assert Counter(map(tuple, rows(spark, "markdown_spans"))) == spans
    said = Counter((k, w) for k, (_, _, own) in made.items() for c in own for w in c["warnings"])
    assert sum(r["changes"] for r in rows(spark, "display_warnings")) == sum(said.values()) > 0
    moves = Counter((k, c["move_id"]) for k, (_, _, own) in made.items() for c in own if c["move_id"])
    peers = rows(spark, "markdown_move_peers")
    assert len(peers) == sum(n for n in moves.values() if n == 2) > 0 and all(r["peer_id"] != r["change_id"] for r in peers)
    index = {(r["pair_id"], r["kind"], r["key"]) for r in rows(spark, "markdown_change_index")}
    assert {x[:2] + (x[2],) for x in index if x[1] in ("old", "new")} == {(k, s, c[f"{s}_id"]) for k, (_, _, own) in made.items() for c in own for s in ("old", "new") if c[f"{s}_id"]}


def test_lines_and_rows(spark, made):
    lines = rows(spark, "markdown_projection")
    assert Counter((r["pair_id"], r["side"], r["line"], r["text"]) for r in lines) == Counter((k, s, i, t) for k, both in made.items() for s, md in zip(("old", "new"), both) for i, t in enumerate(md.replace("\r\n", "\n").split("\n"), 1))
    ops = {(k, c["change_id"]): c for k, (_, _, own) in made.items() for c in own}
    for r in lines:
        if r["change_id"]:
            c = ops[r["pair_id"], r["change_id"]]
            assert c[f"{r['side']}_line"] <= r["line"] <= max(c[f"{r['side']}_line"], c[f"{r['side']}_end"])
            assert r["tone"] in (c["op"], "meta", "rename", "reorder")
    merged = defaultdict(list)
    for r in rows(spark, "markdown_merged_rows"):
        merged[r["pair_id"]].append((r["row"], r["old_line"], r["new_line"]))
    for k, (old, new, _) in made.items():
        own = sorted(merged[k])
        assert [x for x, *_ in own] == list(range(len(own)))
        assert sorted(x for _, x, _ in own if x > 0) == list(range(1, old.count("\n") + 2)) and [y for *_, y in own if y > 0] == list(range(1, new.count("\n") + 2))


def test_details_and_navigation(spark, made):
    shown = Counter((k, c["change_id"]) for k, (_, _, own) in made.items() for c in own if c["op"] != "equal" or c["renamed"] or c["reordered"])
    assert Counter((r["pair_id"], r["change_id"]) for r in rows(spark, "markdown_details")) == shown
    nav = {(r["pair_id"], r["change_id"]): r for r in rows(spark, "change_navigation")}
    assert nav.keys() == shown.keys()
    for (k, _), r in nav.items():
        for to, back in (("next_id", "previous_id"), ("previous_id", "next_id")):
            assert not r[to] or nav[k, r[to]][back] == r["change_id"]
    assert {(r["pair_id"], r["change_id"]) for r in rows(spark, "change_details")} >= shown.keys()


def test_nodes(spark, made):
    got = defaultdict(list)
    for r in rows(spark, "markdown_nodes"):
        got[r["pair_id"]].append((r["preorder"], r["node_id"], r["kind"], r["subtree_size"], r["subtree_hash"]))
    for k, (old, _, _) in made.items():
        assert sorted(got[k]) == [(n.preorder, n.id, n.kind, n.size, n.hashes["subtree"]) for n in Document(old).nodes]


@pytest.fixture(scope="module")
def versions(spark):
    found = defaultdict(lambda: {"old": [], "new": []})
    for r in line_versions(table(spark, DIR, "documents")).orderBy("doc_id", "side", "pos").collect():
        found[r["doc_id"]][r["side"]].append(r["text"])
    return found


@pytest.mark.parametrize("name", ["myers_edit_script", "heckel_align", "histogram_align"])
def test_scripts_turn_the_old_version_into_the_new(spark, versions, name):
    got = rows(spark, name)
    assert {r["doc_id"] for r in got} == versions.keys()
    for r in got:
        old, new = iter(versions[r["doc_id"]]["old"]), iter(versions[r["doc_id"]]["new"])
        for op in r["script"]:
            a, b = next(old) if op in "ed" else None, next(new) if op in "ei" else None
            assert op != "e" or a == b
        assert next(old, None) is next(new, None) is None
        assert (r["n_equal"], r["n_delete"], r["n_insert"]) == tuple(r["script"].count(x) for x in "edi")


def test_reordered_lines_are_as_few_as_can_be(spark, versions):
    got = defaultdict(list)
    for r in rows(spark, "reorder_marks"):
        got[r["doc_id"]].append((r["old_pos"], r["new_pos"], r["reordered"]))
    for own in got.values():
        own.sort()
        steady = [n for _, n, moved in own if not moved]
        assert steady == sorted(steady) and len(steady) == len(kernels.longest_increasing([n for _, n, _ in own]))


def test_pairings_cost_least(spark):
    scored = tree_queries._scored(spark, DIR).filter("score >= 0.55").collect()
    costs = defaultdict(dict)
    for r in scored:
        costs[r["pair_id"], r["parent_id"]][r["old_id"], r["new_id"]] = 1 - r["score"] + 1e-6 * abs(r["old_index"] - r["new_index"])
    got = {(r["pair_id"], r["old_id"], r["new_id"]): r["cost"] for r in rows(spark, "hungarian_pairs")}
    seen = 0
    for (pair_id, _), own in costs.items():
        picked = [x for x in own if (pair_id, *x) in got]
        assert len({a for a, _ in picked}) == len({b for _, b in picked}) == len(picked)
        olds, news = sorted({a for a, _ in own}), sorted({b for _, b in own})
        if len(olds) > 4 or len(news) > 5:
            continue
        seen += 1
        ways = (list(zip(left, right, strict=True)) for n in range(len(olds) + 1) for left in itertools.combinations(olds, n) for right in itertools.permutations(news, n))
        best = min((-len(way), sum(own[x] for x in way)) for way in ways if all(x in own for x in way))
        assert len(picked) == -best[0] and sum(own[x] for x in picked) == pytest.approx(best[1], abs=1e-6)
    assert seen > 50


def test_kept_nodes_of_a_tree_edit(spark):
    nodes = {(r["pair_id"], r["side"], r["node_id"]): r for r in trees(spark, DIR).collect()}
    got = defaultdict(list)
    for r in rows(spark, "tree_edit_matches"):
        got[r["pair_id"]].append((nodes[r["pair_id"], "old", r["old_id"]], nodes[r["pair_id"], "new", r["new_id"]]))
    assert len(got) == len({k for k, *_ in nodes})
    for own in got.values():
        assert len({a["node_id"] for a, _ in own}) == len({b["node_id"] for _, b in own}) == len(own) and all(a["kind"] == b["kind"] for a, b in own)
        place = lambda x: (x["sort_a"], x["sort_b"])
        order = sorted(own, key=lambda p: place(p[0]))
        assert [place(b) for _, b in order] == sorted(place(b) for _, b in own)
        partner = {a["node_id"]: b["node_id"] for a, b in own}
        assert all(a["parent_id"] is None or partner.get(a["parent_id"]) == b["parent_id"] for a, b in own)
