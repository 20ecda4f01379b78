"""The registered queries give their SQL's rows on the smallest tables."""

from collections import Counter

import duckdb
import pytest

from treeloom.llm import queries

DIR = "/root/testdata/sf0.001"


def rows(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(round(r[i], 8) if isinstance(r[i], float) else r[i] for i in order) for r in found)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    df = queries.QUERIES[name](spark, DIR)
    want = con.execute(queries.SQL[name])
    names = [d[0] for d in want.description]
    assert rows(df.columns, map(tuple, df.collect())) == rows(names, want.fetchall())


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_result_is_not_empty(spark, name):
    assert queries.QUERIES[name](spark, DIR).count() > 0
