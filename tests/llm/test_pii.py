import hashlib
import random
import re
import sys
from pathlib import Path

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

sys.path.insert(0, str(Path(__file__).resolve().parent))

from cases import AWKWARD, EXTRA, SCHEMA, rows, widened

from treeloom.llm import pii


def luhn(d):
    return sum(sum(map(int, str(int(c) * (1 + i % 2)))) for i, c in enumerate(reversed(d))) % 10 == 0


def brute(text):
    """The patterns as they are given."""
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 12 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m[0])) <= 15]
    return sorted(out)


@settings(max_examples=500, deadline=None)
@given(
    st.text("a.b@-_+1 29(é", max_size=40) | st.text("0123456789 -", max_size=60) | st.text("0125.", max_size=40) | st.text("+12 ().-x", max_size=40)
    | st.lists(st.sampled_from(["a@b.cc", "_d@", "@", "1.2.3.4", "4111111111111111", " ", "-", "+1 (555) 555-0199", ".", "é"]), max_size=8).map("".join)
)
def test_base_spans_are_those_of_the_given_patterns(text):
    assert sorted((s, k, e) for k, s, e in pii.base_spans(text)) == brute(text)


def test_linear_on_long_runs():
    for text in ("a" * 400_000, "1" * 400_000, "a@" * 100_000, "+1" + " " * 400_000, "1." * 200_000, "a-" * 200_000 + "@", "(" * 100_000 + "(at)", "1 " * 200_000):
        pii.base_spans(text)
        pii.further_spans(text)


SOME = [
    "call +1 (555) 010-9999 or mail joe.b@mail5.example.com now", "host 10.0.0.1 and 233.233.171.252 or 999.1.1.1", "card 4111 1111 1111 1111 paid",
    "call me at 415-555-2671 please", "phone (212) 555-7788 or (212) 555-7789", "part 900-555-0000x of the build", "ssn 123-45-6789 on file", "order 000-00-0000 here",
    "write joe (at) mail (dot) com", "Dear Mr. Smith and Dr Anna Lee", "1.2.3.4 1.2.3.4 1.2.3.4 1.2.3.4 1.2.3.4",
]


def test_query(spark):
    some = rows([*AWKWARD, *SOME * 5])
    for df in (spark.createDataFrame(some, SCHEMA), spark.createDataFrame(widened(some), EXTRA).repartition(3)):
        got = {r["doc_id"]: r for r in pii.report(df).collect()}
        assert len(got) == len(some)
        for doc_id, text, *_ in some:
            want = brute(text or "")
            said = [f"{pii.BASE[k]}:{s}:{e}" for s, k, e in want]
            r = got[doc_id]
            assert [r[f"n_{k}"] for k in pii.BASE] == [sum(x[1] == j for x in want) for j in range(4)]
            assert r["base_sha256"] == hashlib.sha256(",".join(said).encode()).hexdigest()
            assert set(said) <= set(r["spans"].split(",")) or not said
    at = len(AWKWARD)
    assert "national:11:23" in got[at + 3]["spans"] and "masked:6:29" in got[at + 8]["spans"] and "titled" in got[at + 9]["spans"]
    assert pii.report(df.limit(0)).count() == 0
    assert pii.report(spark.createDataFrame([(1, "nothing")], "doc_id long, text string")).first()["spans"] == ""


def test_reliabilities_are_recovered():
    rng = np.random.default_rng(2)
    truth = rng.random(20_000) < 0.6
    right = np.array([0.9, 0.8, 0.7, 0.85, 0.6])
    hit = rng.random((20_000, 5)) < right
    vote = np.where(hit == truth[:, None], 1, -1)
    vote[rng.random(vote.shape) < 0.2] = 0
    rows, count = np.unique(vote, axis=0, return_counts=True)
    like, chance = pii.reliabilities(rows, np.zeros(len(rows), int), count.astype(float))
    told = chance[:, 1, 2] / (chance[:, 1, 0] + chance[:, 1, 2])
    assert np.abs(told - right).max() < 0.05


def planted(rng):
    """(text, kind, start, end, personal) with one span that personal data could be."""
    digits = lambda n: "".join(str(rng.randrange(10)) for _ in range(n))
    phone = lambda: f"{rng.randrange(2, 10)}{digits(2)}-{rng.randrange(2, 10)}{digits(2)}-{digits(4)}"
    given, family = rng.choice(sorted(pii._GIVEN)).title(), rng.choice(sorted(pii._FAMILY)).title()
    before, span, after, kind, personal = rng.choice([
        (rng.choice(["please call ", "my mobile ", "phone "]), phone(), rng.choice([" today", " now"]), "national", True),
        (rng.choice(["part ", "order ", "build "]), f"{rng.randrange(2)}{digits(2)}-{rng.randrange(2)}{digits(2)}-{digits(4)}", rng.choice([" of the release", " in section two"]), "national", False),
        ("my ssn ", f"{rng.randrange(1, 6)}{digits(2)}-{rng.randrange(1, 9)}{rng.randrange(10)}-{rng.randrange(1, 10)}{digits(3)}", " on file", "social", True),
        ("order ", f"000-{digits(2)}-{digits(4)}", " of the sample", "social", False),
        ("dear ", f"{given} {family}", ", write soon", "name", True),
        ("the ", f"{given} Release", " version notes", "name", False),
    ])
    lead = "words " * rng.randrange(4)
    return lead + before + span + after, kind, len(lead + before), len(lead + before + span), personal


def test_planted_spans_are_told_from_others(spark):
    rng = random.Random(11)
    some = [planted(rng) for _ in range(1200)]
    df = spark.createDataFrame([(i, t) for i, (t, *_) in enumerate(some)], "doc_id long, text string")
    got = {r["doc_id"]: set(r["spans"].split(",")) for r in pii.report(df).collect()}
    hit = [(f"{kind}:{s}:{e}" in got[i], personal) for i, (_, kind, s, e, personal) in enumerate(some)]
    caught, said, true = sum(h and p for h, p in hit), sum(h for h, _ in hit), sum(p for _, p in hit)
    assert caught / true >= 0.9 and caught / said >= 0.9, (caught, said, true)


def test_the_classifier_reads_text_only():
    x = pii.design([pii.features("call 415-555-2671 now", 4, 5, 17), pii.features("part 015-155-2671 now", 4, 5, 17)] * 20)
    w = pii.classifier(x, np.array([0.95, 0.05] * 20))
    p = [pii.likelihood(w, pii.features(f"{word} {number} then", 4, 5, 17)) for word, number in (("call", "212-555-7788"), ("part", "012-155-7788"))]
    assert p[0] > 0.6 > 0.4 > p[1] and all(0 <= k < pii._OFFSETS[-1] for k in pii.features("", 8, 0, 0) + pii.features("é" * 99, 0, 3, 99))


def test_repeated_rows_and_rows_without_ids(spark):
    df = spark.createDataFrame([(1, SOME[0]), (1, SOME[0]), (None, SOME[0]), (None, None)], "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["n_phone"], r["base_sha256"]) for r in pii.report(df).collect())
    assert [g[:2] for g in got] in ([(0, 0), (0, 1), (1, 1), (1, 1)], [(0, 1), (0, 0), (1, 1), (1, 1)]) and len({g[2] for g in got}) == 2


def test_one_row_repeated_very_often(spark):
    one = spark.range(100_000).selectExpr("1L AS doc_id", "'Write to mary.jones@mail.example.org today.' AS text")
    assert pii.report(one).groupBy("n_email").count().collect() == [(1, 100_000)]
    few = spark.createDataFrame([(i, f"Call 555-{i % 900 + 100}-{i + 1000} or write to a{i}@b.org") for i in range(300)], "doc_id long, text string")
    weights = pii.learned(pii.candidates(one.union(few)), most=50)
    kinds = {r["kind"] for r in pii.candidates(few).selectExpr("explode(found) AS x").select("x.kind").distinct().collect()}
    assert len(kinds) == 2 and all(weights[pii._OFFSETS[0] + k] != 0 for k in kinds)


def test_the_classifier_takes_nothing():
    assert not pii.classifier(np.zeros((0, 5), np.float32), np.zeros(0), np.zeros(0)).any()
