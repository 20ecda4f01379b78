"""Near-duplicates with ids that repeat or are missing: one row of each group stays, and no clean one goes."""

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

import corpus_pipeline
from cases import SCHEMA

WORDS = [[f"{x}{i}" for i in range(80)] for x in "abcd"]
NEAR = [" ".join([*w[:40], "other", *w[41:]]) for w in WORDS]
TEXT = [" ".join(w) for w in WORDS]


def test_ids_that_repeat_or_are_missing(spark):
    some = [
        (1, TEXT[0]), (5, NEAR[0]), (5, TEXT[1]),  # 5 stays with its other text
        (None, TEXT[2]), (None, NEAR[2]),  # one of both stays
        (None, NEAR[1]),  # a copy of a row with an id
        (7, TEXT[3]), (7, NEAR[3]), (9, TEXT[3] + " end"), (9, "short"), (None, None),
    ]
    docs = spark.createDataFrame([(i, t, "en", "s", None) for i, t in some], SCHEMA)
    step = corpus_pipeline.near(spark, docs.repartition(3), "")
    assert step.columns == docs.columns
    got = [(r["doc_id"], r["text"]) for r in step.collect()]
    third = [x for x in got if x in [(None, TEXT[2]), (None, NEAR[2])]]
    seventh = [x for x in got if x[0] == 7]
    assert len(third) == len(seventh) == 1
    rest = sorted((x for x in got if x not in third + seventh), key=repr)
    assert rest == sorted([(1, TEXT[0]), (5, TEXT[1]), (9, "short"), (None, None)], key=repr)
