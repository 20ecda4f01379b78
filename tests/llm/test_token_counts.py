import sys
import time
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

sys.path.insert(0, str(Path(__file__).resolve().parent))

from cases import AWKWARD, EXTRA, SCHEMA, rows, widened

from treeloom.llm import token_counts

PATH = token_counts.default_path()


def brute(text, parts, rule):
    """Counts character by character."""
    data, at, spans = text.encode(), 0, []
    char_of = [i for i, c in enumerate(text) for _ in c.encode()]
    bpe = token_counts.loaded(PATH)
    for t in bpe.encoding.encode_ordinary(text):
        b = bpe.encoding.decode_single_token_bytes(t)
        spans.append(range(char_of[at], char_of[at + len(b) - 1] + 1))
        at += len(b)
    assert at == len(data)
    count = {k: 0.0 for k in range(-1, len(parts))}
    for span in spans:
        own = [next((k for k, (s, e) in enumerate(parts) if s <= c < e), -1) for c in span]
        if rule == "split":
            for k in own:
                count[k] += 1 / len(own)
            continue
        tally = {k: own.count(k) for k in own}
        most = max(sorted(tally, key=lambda k: (k < 0, k)), key=lambda k: tally[k])
        count[{"first": own[0], "last": own[-1], "most": most}[rule]] += 1
    return count


@settings(max_examples=150, deadline=None)
@given(st.text("ab \n\r.é🎉1", max_size=60), st.sampled_from(token_counts.RULES), st.data())
def test_allocation(text, rule, data):
    cuts = sorted(data.draw(st.lists(st.integers(0, len(text)), max_size=8)))
    parts = [(a, b) for a, b in zip(cuts[::2], cuts[1::2], strict=False)]
    for own in (parts, token_counts.line_spans(text)):
        starts, ends = token_counts.loaded(PATH).spans(text)
        count, outside, _ = token_counts.allocate(starts, ends, np.array(own, np.int64).reshape(-1, 2), rule)
        want = brute(text, own, rule)
        assert outside == pytest.approx(want.pop(-1)) and count == pytest.approx(list(want.values()))


def test_a_long_blank_run():
    starts, ends = token_counts.loaded(PATH).spans("a" + " " * 300_000 + "b")
    assert starts[0] == 0 and ends[-1] == 300_002 and (starts[1:] == ends[:-1]).all()


@pytest.mark.parametrize("n", [1, 2, 298, 299, 300, 301, 2000])
def test_both_encoders_agree(n):
    bpe = token_counts.loaded(PATH)
    for blank in (" ", "\n", "\t", "\u00a0", " \n"):
        for text in (f"a{blank * n}b", blank * n, f"x {blank * n}", f"{blank * n}1é", f"it's{blank * n}\n🎉{blank * n}"):
            assert bpe.library.encode(text, add_special_tokens=False).ids == bpe.encoding.encode_ordinary(text) == bpe.ids(text)


def test_no_length_of_a_run_is_slow():
    bpe, took = token_counts.loaded(PATH), {}
    for n in (50, 250, 299, 300, 2000, 9_999, 10_000, 200_000):
        text, start = ("w" + " " * n) * (200_000 // n), time.perf_counter()
        bpe.ids(text)
        took[n] = time.perf_counter() - start
    assert max(took.values()) < 2, took


def test_repeated_rows_and_null_ids(spark):
    some = [(None, "a b\nc"), (None, "a b\nc"), (1, "a b\nc"), (1, "other\n\n"), (1, None)]
    got = token_counts.part_counts(spark.createDataFrame(some, "doc_id long, text string"), PATH)
    key = lambda r: (r["doc_id"] is not None, r["start"], r["end"])
    assert sorted(map(key, got.collect())) == sorted((i is not None, *p) for i, t in some for p in token_counts.line_spans(t or ""))


def test_query(spark):
    some = rows([*AWKWARD, "a\n\n\nb  \n c", "\n\n\n", "tail\n"])
    for df in (spark.createDataFrame(some, SCHEMA), spark.createDataFrame(widened(some), EXTRA)):
        got = token_counts.part_counts(df, PATH).collect()
        for doc_id, text, *_ in some:
            own = sorted((r for r in got if r["doc_id"] == doc_id), key=lambda r: r["part"])
            parts = token_counts.line_spans(text or "")
            assert [(r["start"], r["end"]) for r in own] == parts
            want = brute(text or "", parts, "first")
            assert [r["tokens"] for r in own] == [want[k] for k in range(len(parts))]
            assert {r["doc_tokens"] for r in own} == {sum(want.values())}
    assert any(r["crossing"] for r in got)
    assert token_counts.part_counts(df.limit(0), PATH).count() == 0
    with pytest.raises(ValueError):
        token_counts.part_counts(df, PATH, "none")
