import sys
import zlib
from pathlib import Path

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

sys.path.insert(0, str(Path(__file__).resolve().parent))

from cases import AWKWARD, EXTRA, SCHEMA, rows, widened
from tokenizers import Tokenizer

from treeloom.llm import bpe, packing

PATH = bpe.default_path()
LIB = Tokenizer.from_file(PATH)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=80))
def test_first_fit_decreasing_is_the_plain_one(sizes):
    bins, offsets = packing.first_fit_decreasing(np.array(sizes, np.int64), 64)
    used: list[int] = []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        b = next((b for b, u in enumerate(used) if u + sizes[i] <= 64), len(used))
        used += [0] * (b == len(used))
        assert (bins[i], offsets[i]) == (b, used[b])
        used[b] += sizes[i]


def valid(got, some, length):
    want = {d: [*LIB.encode(t or "", add_special_tokens=False).ids, 2] for d, t, *_ in some}
    by_doc, by_seq = {}, {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
        ids = want[r["doc_id"]]
        assert r["doc_tokens"] == len(ids)
        assert r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes())
    assert by_doc.keys() == want.keys()
    for d, parts in by_doc.items():
        at = 0
        for r in sorted(parts, key=lambda r: r["start"]):
            assert r["start"] == at
            at += r["length"]
        assert at == len(want[d])
    for parts in by_seq.values():
        at = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == at and r["length"] > 0
            at += r["length"]
        assert at <= length
    return len(by_seq)


def digested(df, length=4096, **how):
    return packing.digests(packing.packed(df, PATH, length, **how)).collect()


def test_packed(spark):
    some = rows([*AWKWARD, *("word " * (i * 37 % 600) for i in range(150)), "the " * 9000])
    for df, length in ((spark.createDataFrame(some, SCHEMA), 4096), (spark.createDataFrame(widened(some), EXTRA), 256)):
        got = digested(df, length)
        n = valid(got, some, length)
        assert n <= sum(r["length"] for r in got) / length + 2
    grouped = digested(df, 256, group=20)
    valid(grouped, some, 256)
    assert packing.packed(df.limit(0), PATH).count() == 0
    whole = packing.sequences(df, PATH, 256, group=20, pad=7).collect()
    assert len({r["sequence_id"] for r in whole}) == len(whole) and sum(r["n_tokens"] for r in whole) == sum(r["length"] for r in grouped)
    assert all(len(r["ids"]) == 256 and set(r["ids"][r["n_tokens"] :]) <= {7} for r in whole)
    parts = {}
    for r in packing.packed(df, PATH, 256, group=20).collect():
        parts.setdefault(r["sequence_id"], []).append((r["offset"], np.frombuffer(r["ids"], "<u4").tolist()))
    assert {r["sequence_id"]: r["ids"][: r["n_tokens"]] for r in whole} == {k: [x for _, ids in sorted(v) for x in ids] for k, v in parts.items()}


def test_repeated_rows_and_null_ids(spark):
    df = spark.createDataFrame([(1, "a b", None, None, 3), (1, "a b", None, None, 3), (None, "c", None, None, 1)], SCHEMA)
    got = sorted((r["doc_id"] or 0, r["length"], r["offset"]) for r in packing.packed(df, PATH).collect())
    assert [g[:2] for g in got] == [(0, 2), (1, 3), (1, 3)] and sorted(g[2] for g in got) == [0, 3, 6]


def test_large_ids_beside_nulls_stay_whole(spark):
    large = [2**53 + 1, 2**60 + 1, 2**60 + 3, -(2**60) - 1]
    some = [(i, f"text {i}") for i in [*large, None]]
    df = spark.createDataFrame(some, "doc_id long, text string").coalesce(1)
    assert sorted(map(repr, (r["doc_id"] for r in packing.packed(df, PATH).collect()))) == sorted(map(repr, [*large, None]))
    named = spark.createDataFrame([("x", "a"), (None, "b")], "doc_id string, text string")
    assert {r["doc_id"] for r in packing.packed(named, PATH).collect()} == {"x", None}


def test_one_id_on_all_rows_is_no_hot_group(spark):
    df = spark.createDataFrame([(None, "same text")] * 400, "doc_id long, text string").repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = packing._dealt(df, "doc_id", "text").rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) == 4 and max(sizes) < 160
