import random
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

import corpus_pipeline
from cases import AWKWARD, SCHEMA, rows
from test_content_sort import brute as exact_brute
from test_ngram_join import brute as near_brute
from test_ngram_join import family
from test_packing import valid
from test_ppm import made
from test_secrets import SECRETS

from treeloom.llm import ppm


def test_stages_against_brute_force(spark, tmp_path):
    rng = random.Random(7)
    langs = [rng.choice(["en", "fr", "de"]) for _ in range(150)]
    texts = [made(rng, k, rng.randrange(5, 60)) for k in langs]
    texts += family(rng, texts[0].split() + texts[1].split(), 60, 12, 4) + texts[:9] + [texts[3] + "  "] + [f"{made(rng, 'en', 30)} {s}" for s in SECRETS]
    texts += AWKWARD
    some = rows(texts, [*langs, *[None] * (len(texts) - len(langs))])
    docs = spark.createDataFrame(some, SCHEMA)
    docs.write.parquet(f"{tmp_path}/documents.parquet")

    model = ppm.fit(ppm.sample(docs))
    judged = zip(some, *model.judge([t for _, t, *_ in some]))
    left = [r for r, name, score in judged if name != "und" and score >= ppm.LEAST]
    kept = {d for d, _, _, k, _ in exact_brute(left) if k}
    left = [r for r in left if r[0] in kept]
    kept = {d for d, _, c in near_brute(left) if d == c}
    left = [r for r in left if r[0] in kept]
    assert 100 < len(left) < len(some) - 20

    step = docs
    for name, stage in corpus_pipeline.STAGES[:4]:
        step = stage(spark, step, str(tmp_path))
        assert step.columns == docs.columns, name
    final = {r["doc_id"]: r["text"] for r in step.collect()}
    assert final.keys() == {r[0] for r in left}
    assert sum(final[r[0]] != r[1] for r in left) >= 5 and all(final[r[0]] == r[1] or "[secret]" in final[r[0]] for r in left)
    valid(corpus_pipeline.run(spark, str(tmp_path)).collect(), list(final.items()), 4096)


def test_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
