"""Tree edits of many children give what the whole table gives, and no customer is left out."""

import random

import pytest

from treeloom.plans import change_queries
from treeloom.plans import kernels as k


def forest(rng, n, deep=False):
    leaf = lambda: (rng.choice("ab") + rng.choice("xyz"), [])
    inner = lambda: (rng.choice("ab") + rng.choice("xy"), [leaf() for _ in range(rng.randrange(3))])
    return [(rng.choice("hk") + rng.choice("123"), [inner() if deep else leaf() for _ in range(rng.randrange(4))]) for _ in range(n)]


@pytest.mark.parametrize("deep", [False, True])
@pytest.mark.parametrize("kinds", [None, lambda n: n[0]])
def test_long_forests(deep, kinds):
    rng = random.Random(9)
    kept = k.MOST_TREE_CELLS
    try:
        for _ in range(40):
            old, new = (forest(rng, rng.randrange(1, 14), deep) for _ in range(2))
            args = old, new, lambda n: n[1], lambda a, b: a[0][0] == b[0][0], lambda a, b: 0.0 if a[0] == b[0] else 0.5
            k.MOST_TREE_CELLS = 10_000
            want, cost = k.tree_edit_matches(*args)
            k.MOST_TREE_CELLS = 0
            found, least = k.tree_edit_matches(*args, kinds=kinds)
            assert [(id(a), id(b)) for a, b in found] == [(id(a), id(b)) for a, b in want] and least == cost
    finally:
        k.MOST_TREE_CELLS = kept


def test_a_customer_with_many_orders(spark, tmp_path):
    n = 130
    one = lambda rows, schema, name: spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    one([(1, "many"), (2, "few")], "c_custkey long, c_name string", "customer")
    one([(i, 1 if i < n else 2, "F", 1.0, "1-URGENT") for i in range(1, n + 5)], "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderpriority string", "orders")
    one(
        [(i, ln, i + ln, ln, 1.0, 2.0, "N") for i in range(1, n + 5) for ln in (1, 2)],
        "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_returnflag string", "lineitem",
    )
    rows = change_queries.tree_edit_matches(spark, str(tmp_path)).collect()
    many = [r for r in rows if r["pair_id"] == 1]
    assert len(many) > n and {r["old_id"] for r in many} >= {"c1", "o1", "l1.0"} and [r for r in rows if r["pair_id"] == 2]
