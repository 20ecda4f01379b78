"""Scores that spread until they are settled, against exact solutions."""

import numpy as np
import pytest

from treeloom.llm import queries, url_filter as u


def page(k, host, to=None, path="x"):
    return (k, f"http://{host}/{path}", f"<a href='http://{to}/'>" if to else None)


def test_a_long_chain_to_a_blocked_host(spark, tmp_path):
    hosts = [f"h{i}.net" for i in range(16)] + ["bad.com"]
    pages = [page(i, h, to) for i, (h, to) in enumerate(zip(hosts, hosts[1:]))] + [page(99, "bad.com", path="de/1")]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r["host"]: r for r in queries.QUERIES["op2_url_filter"](spark, str(tmp_path)).collect()}
    for i, h in enumerate(hosts[:-1]):
        assert got[h]["distrust"] == pytest.approx(0.85 ** (16 - i), abs=1e-6) and got[h]["verdict"] == "block"


def test_a_graph_with_cycles(spark):
    edges = [("a", "b", 2), ("b", "a", 1), ("b", "c", 1), ("c", "a", 3), ("c", "d", 1), ("d", "d2", 1), ("d2", "c", 5)]
    names = sorted({x for e in edges for x in e[:2]})
    at = {x: i for i, x in enumerate(names)}
    seeds = {"a": (1.0, 0.0), "c": (0.0, 0.5)}
    w = np.zeros((len(names), len(names)))
    for s, t, n in edges:
        w[at[s], at[t]] = n
    solve = lambda m, k: np.linalg.solve(np.eye(len(names)) - u.DAMPING * (m / m.sum(axis=1, keepdims=True)).T, [seeds.get(x, (0, 0))[k] for x in names])
    trust, distrust = solve(w, 0), solve(w.T, 1)
    found = u.scores(
        spark.createDataFrame([(h, *s) for h, s in seeds.items()], "host string, allowed double, blocked double"),
        spark.createDataFrame(edges, "source string, target string, links long"), rounds=None,
    )
    got = {r["host"]: (r["trust"], r["distrust"]) for r in found.collect()}
    assert got == {x: (pytest.approx(trust[i], abs=2e-6), pytest.approx(distrust[i], abs=2e-6)) for x, i in at.items()}


def test_a_hub_is_dealt_to_several_tasks(spark):
    """Three thousand hosts link to a hub and it to them: its edges are cut, and scores are those of the plain rule."""
    n = 3000
    edges = spark.createDataFrame([(f"h{i}", "hub", 1) for i in range(n)] + [("hub", f"h{i}", 1) for i in range(n)], "source string, target string, links long")
    seeds = spark.createDataFrame([("hub", 1.0, 0.0), ("h0", 0.0, 1.0)], "host string, allowed double, blocked double")
    moves = u._moves("trust", edges, "source", "target").groupBy("node").count().collect()
    assert {r["node"]: r["count"] for r in moves}["trust/hub"] == n and len(moves) == n + 1
    got = {r["host"]: r for r in u.scores(seeds, edges, rounds=2).collect()}
    d = u.DAMPING
    assert got["hub"]["trust"] == pytest.approx(1 + d * d) and got["h5"]["trust"] == pytest.approx(d / n) and got["h0"]["distrust"] == pytest.approx(1 + d * d / n)
