import random
import sys
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

from cases import AWKWARD, EXTRA, SCHEMA, rows, widened
from pyspark.sql import functions as F

from treeloom.llm import neighbours
from treeloom.llm.common import drawn, table

LABELS = "doc_id long, quality int, toxic int"


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def brute_counts(text):
    """Features gram by gram."""
    data, count = text.encode("utf-8", "surrogatepass"), Counter()
    kind = lambda b: next((k for k, own in enumerate(neighbours.CLASSES) if chr(b) in own), len(neighbours.CLASSES)) if b < 128 else 0
    low = lambda b: b + 32 if 65 <= b <= 90 else b
    for a, b, c in zip(data, data[1:], data[2:]):
        count[kind(a) * 256 + kind(b) * 16 + kind(c)] += 1
        count[neighbours.STYLES + ((((low(a) << 16) | (low(b) << 8) | low(c)) * 2654435761 & 0xFFFFFFFF) >> 21)] += 1
    return count


@pytest.mark.parametrize("chunk", [7, 1 << 19])
def test_counts(monkeypatch, chunk):
    monkeypatch.setattr(neighbours, "CHUNK", chunk)
    texts = [t or "" for t in AWKWARD if len(t or "") < 6000] + ["A|b # 12", "", "", "zz", "\udc80x"]
    got = neighbours.counts_of(texts)
    for own, text in zip(got, texts, strict=True):
        assert {int(k): own[k] for k in np.flatnonzero(own[: -neighbours.REPEATS])} == brute_counts(text)
    assert set(neighbours.counts_of(["so so so on"])[0, -neighbours.REPEATS :]) == {1.0}


def texts_of(n, seed=0):
    rng, out = random.Random(seed), []
    for _ in range(n):
        words = ["".join(rng.choice("aeioustrln") for _ in range(rng.randrange(2, 8))) for _ in range(rng.randrange(20, 60))]
        bad = rng.random() < 0.3
        out.append((" | ".join(words).upper() if bad else " ".join(words) + ".", 0 if bad else 1))
    return out


def frames(spark, some, schema=SCHEMA, wide=False):
    docs = rows([t for t, _ in some])
    return spark.createDataFrame(widened(docs) if wide else docs, schema), spark.createDataFrame([(i, q, 0) for i, (_, q) in enumerate(some)], LABELS)


def test_scores_against_all_products(spark):
    some = texts_of(200)
    docs, labels = frames(spark, some)
    model = neighbours.fitted(docs.select("doc_id", "text"), labels)
    counts = np.concatenate([neighbours.counts_of([t]) for t, _ in some])
    assert len(model.vectors) == len({t for i, (t, _) in enumerate(some) if not held(i)})
    assert np.allclose(model.idf, np.log(201 / (1 + (counts > 0).sum(0))) + 1, rtol=1e-5)
    got = {r["doc_id"]: r for r in neighbours.scored(docs, labels).collect()}
    for i, x in enumerate(model.embed(counts)):
        near = sorted(((float(x @ v), int(y), float(w)) for v, y, w in zip(model.vectors, model.labels, model.weights, strict=True)), reverse=True)[: neighbours.NEIGHBOURS]
        votes = [(max(s, 0) ** neighbours.SHARPNESS * w, y) for s, y, w in near]
        want = (sum(v for v, y in votes if y) + neighbours.PRIOR * model.prior) / (sum(v for v, _ in votes) + neighbours.PRIOR)
        assert got[i]["score"] == pytest.approx(want, abs=2e-3)
        assert got[i]["held_out"] == held(i) and got[i]["predicted"] == (got[i]["score"] >= 0.7)
    out = [i for i in got if held(i)]
    assert sum(got[i]["predicted"] == some[i][1] for i in out) >= 0.97 * len(out)


def test_held_out_labels_of_the_tables(spark):
    at = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["quality"] for r in table(spark, at, "labels").collect()}
    got = [r for r in neighbours.scored(table(spark, at, "documents"), table(spark, at, "labels")).collect() if r["held_out"] and r["doc_id"] in labels]
    assert sum(r["predicted"] == labels[r["doc_id"]] for r in got) >= 0.95 * len(got)
    assert all(r["held_out"] == held(r["doc_id"]) for r in got)


def test_labels_of_held_out_documents_are_not_read(spark):
    some = texts_of(80, 1)
    docs, labels = frames(spark, some)
    turned = labels.withColumn("quality", F.when(neighbours.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    of = lambda x: sorted(map(tuple, neighbours.scored(docs, x).collect()))
    assert of(labels) == of(turned)


def test_awkward_texts(spark):
    some = texts_of(60, 2)
    cases = [(t, None) for t in AWKWARD] + [("long " * 200_000, None)]
    for wide in (False, True):
        docs, labels = frames(spark, some + cases, EXTRA if wide else SCHEMA, wide)
        docs = docs.union(docs.filter("doc_id >= 60").withColumn("doc_id", F.lit(None).cast("long")))
        got = neighbours.scored(docs, labels).collect()
        assert len(got) == 60 + 2 * len(cases) and all(0 <= r["score"] <= 1 for r in got)
        assert not any(r["held_out"] for r in got if r["doc_id"] is None)
        share = neighbours.fitted(docs.select("doc_id", "text"), labels).prior
        assert all(r["score"] == pytest.approx(share) for r in got if r["doc_id"] in (60, 61))
    assert neighbours.scored(docs.limit(0), labels).count() == 0
    assert {r["score"] for r in neighbours.scored(docs, labels.limit(0)).collect()} == {0.5}
    assert all(r["score"] == pytest.approx(1, abs=1e-5) for r in neighbours.scored(docs, labels.withColumn("quality", F.lit(1))).collect())


def test_the_sample_is_bounded_and_whole(spark):
    one = next(i for i in range(100) if not held(i))
    other = next(i for i in range(one + 1, 100) if not held(i))
    many = [(one, f"Words {i} of many | kinds |", "en", "s", 1) for i in range(3000)] + [(other, "The same text.", "en", "s", 1)] * 3000
    docs, labels = spark.createDataFrame(many, SCHEMA), spark.createDataFrame([(one, 0, 0), (other, 1, 0)] + [(other, 1, 0)] * 500, LABELS)
    x, y, total = neighbours.sample(docs.select("doc_id", "text"), labels, "quality", 40)
    assert sorted(y) == [0] * 40 + [1] and total == {0: 1, 1: 1}
    got = neighbours.scored(docs, labels, most=40).groupBy("doc_id", "predicted").count().collect()
    assert sorted(map(tuple, got)) == sorted([(one, 0, 3000), (other, 1, 3000)])


def test_drawn(spark):
    some = spark.range(20_000).select(F.when(F.col("id") < 30, "few").otherwise("many").alias("g"), F.xxhash64("id").alias("h"))
    got = drawn(some, "g", 50).collect()
    assert Counter(r["g"] for r in got) == {"few": 30, "many": 50}
    least = sorted(r["h"] for r in some.filter("g = 'many'").collect())[:50]
    assert sorted(r["h"] for r in got if r["g"] == "many") == least
    assert drawn(some.limit(0), "g", 50).count() == 0
