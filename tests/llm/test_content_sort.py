import hashlib
import re
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from cases import AWKWARD, EXTRA, SCHEMA, rows, widened

from treeloom.llm import content_sort


def brute(some):
    groups = {}
    for doc_id, text, *_ in some:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", text or ""), []).append((doc_id, text or ""))
    out = []
    for norm, members in groups.items():
        keep = min(members, key=lambda m: (-len(m[1]), m[0]))[0]
        out += [(d, keep, len(members), d == keep, hashlib.sha256(norm.encode()).hexdigest()) for d, _ in members]
    return sorted(out)


def test_matches_brute_force(spark):
    some = rows([*AWKWARD, *(["copy  of\tthis"] * 90), *("copy of this" for _ in range(90)), *(f"copy of this {i % 7}" for i in range(60))])
    got = content_sort.groups(spark.createDataFrame(some, SCHEMA))
    assert sorted(map(tuple, got.collect())) == brute(some)
    wide = content_sort.groups(spark.createDataFrame(widened(some), EXTRA))
    assert sorted(map(tuple, wide.collect())) == brute(some)


def test_hot_group_is_cut_into_salts(spark):
    some = rows(["hot  text", *["hot text"] * 2999, *(f"cold {i}" for i in range(1000))])
    got = content_sort.groups(spark.createDataFrame(some, SCHEMA).repartition(7))
    assert sorted(map(tuple, got.collect())) == brute(some)


def test_repeated_rows_and_nulls_and_none(spark):
    some = [(1, "a b", None, None, 3), (1, "a b", None, None, 3), (1, "ab", None, None, 2), (None, "q", None, None, 1), (2, "q", None, None, 1)]
    df = spark.createDataFrame(some, SCHEMA)
    got = content_sort.groups(df).collect()
    assert sum(r["kept"] for r in got) == 2 and len(got) == 5
    assert {r["keep_id"] for r in got if r["group_size"] == 2} == {None}
    assert sorted((r["doc_id"] or 0, r["text"]) for r in content_sort.distinct(df).collect()) == [(0, "q"), (1, "a b")]
    assert content_sort.groups(df.limit(0)).count() == 0 and content_sort.distinct(df.limit(0)).columns == df.columns
