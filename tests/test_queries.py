"""Each query with an oracle gives the oracle's rows, on the smallest tables; and the plans hold no cross join."""

import math
from collections import Counter

import duckdb
import pytest

from treeloom import catalog
from treeloom.plans import pairs, text_queries

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for name in TABLES:
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DIR}/{name}.parquet'")
    return c


def rows(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])
    clean = lambda v: None if isinstance(v, float) and math.isnan(v) else round(v, 8) if isinstance(v, float) else v
    return Counter(tuple(clean(r[i]) for i in order) for r in found)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_oracle(spark, con, name):
    df = catalog.QUERIES[name](spark, DIR)
    want = con.execute(catalog.SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, map(tuple, df.collect())) == rows(names, want.fetchall())


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_an_oracle_has_rows(con, name):
    assert con.execute(f"SELECT count(*) FROM ({catalog.SQL[name]})").fetchone()[0] > 0


@pytest.mark.parametrize("name", sorted(text_queries.QUERIES))
def test_plans_stay_in_the_engine(spark, name):
    plan = catalog.QUERIES[name](spark, DIR)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_compared_pairs(spark):
    some = [(1, "# A\n\nold text here", "# A\n\nnew text here"), (2, None, "# B"), (3, "x", "x"), (4, "", None)]
    df = spark.createDataFrame(some, "pair_id long, old_md string, new_md string")
    changes = pairs.compared(df)
    stats = {r["pair_id"]: r for r in pairs.statistics(changes).collect()}
    assert stats[1]["replaces"] == 1 and stats[2]["inserts"] == 1 and not any(stats[3][c] for c in ("inserts", "deletes", "replaces"))
    assert {(r["layer"], r["op"], r["old_text"], r["new_text"]) for r in pairs.span_rows(changes).collect()} >= {("word", "replace", "old", "new")}
    tones = {(r["pair_id"], r["side"], r["line"]): r["tone"] for r in pairs.projected(df, changes).collect()}
    assert tones[1, "new", 3] == "replace" and tones[1, "new", 1] == "plain" and tones[2, "new", 1] == "insert"
    merged = [(r["old_line"], r["new_line"]) for r in pairs.merged_rows(df, changes).filter("pair_id = 1").orderBy("row").collect()]
    assert merged == [(1, 1), (2, 2), (3, 3)]
    assert pairs.compared(df.limit(0)).count() == 0
