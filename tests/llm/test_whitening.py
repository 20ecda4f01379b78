import numpy as np
import pytest

from treeloom.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(vectors):
    x = np.array([[int(np.floor(1024.0 * float(c))) + 100000 for c in v] for v in vectors], dtype=object)
    n, s = len(x), x.sum(0)
    centred = ((n * x - s) / n).astype(float)
    values, basis = np.linalg.eigh(centred.T @ centred / n)
    values, basis = values[::-1], basis[:, ::-1]
    return n, ((n * x - s) ** 2).sum(1), centred @ basis, values


def hold(rows, vectors, ids):
    n, deviation, projected, values = brute(vectors)
    m = min(8, len(values))
    assert len(rows) == len(vectors) * m
    for k in range(1, m + 1):
        own = [r for r in rows if r["component"] == k]
        assert sorted(r["vec_id"] for r in own) == sorted(ids)
        got, want = np.array([r["whitened"] for r in sorted(own, key=lambda r: r["vec_id"])]), projected[np.argsort(ids), k - 1] / np.sqrt(values[k - 1])
        assert np.allclose(got, want, atol=1e-7) or np.allclose(got, -want, atol=1e-7)
        assert {r["n"] for r in own} == {n}
        assert all(r["explained"] == pytest.approx(values[k - 1] / values.sum(), rel=1e-6) for r in own)
        assert {r["vec_id"]: r["deviation"] for r in own} == dict(zip(ids, deviation, strict=True))
        assert max(r["identity_error"] for r in own) < 1e-8
        assert all(r["exact_deviation"] == r["deviation"] for r in own)


def vectors_of(n, size=12, seed=0):
    rng = np.random.default_rng(seed)
    return ((rng.standard_normal((n, size)) @ np.diag(np.linspace(2, 0.3, size))) * 0.3 + 0.5).astype(np.float32).tolist()


@pytest.mark.parametrize("parts", [1, 7])
def test_against_brute_force(spark, parts):
    some = vectors_of(300)
    bad = [(1000, None, 0), (1001, [None] + some[0][1:], 0), (1002, [float("nan")] + some[0][1:], 0), (1003, [float("inf")] + some[0][1:], 0), (1004, [], 1)]
    df = spark.createDataFrame([*((i, v, 0) for i, v in enumerate(some)), *bad], SCHEMA).repartition(parts)
    hold(whitening.whitened(df).collect(), some, list(range(300)))


def test_merging_is_one_pass_over_all():
    x = np.random.default_rng(1).standard_normal((1000, 5)) + 1e6
    whole = whitening.state_of(x, [0] * 5)
    for cut in (1, 17, 999):
        got = whitening.merged(whitening.state_of(x[:cut], [0] * 5), whitening.state_of(x[cut:], [0] * 5))
        assert got.n == 1000 and np.allclose(got.mean, whole.mean) and np.allclose(got.scatter, whole.scatter, rtol=1e-8)


def test_the_odd_cases(spark):
    a, b = vectors_of(40, 3), vectors_of(50, 10, 2)
    rows = [(i, v, 0) for i, v in enumerate(a)] + [(100 + i, v, 0) for i, v in enumerate(b)]
    got = whitening.whitened(spark.createDataFrame(rows, SCHEMA)).collect()
    hold([r for r in got if r["vec_id"] < 100], a, list(range(40)))
    hold([r for r in got if r["vec_id"] >= 100], b, list(range(100, 150)))

    same = whitening.whitened(spark.createDataFrame([(None, [0.5, 0.25], 0)] * 9, SCHEMA)).collect()
    assert len(same) == 18 and all(r["vec_id"] is None and r["deviation"] == 0 and r["whitened"] == 0 and r["explained"] == 0 and r["identity_error"] == 0 for r in same)

    flat = whitening.whitened(spark.createDataFrame([(i, [float(i), 1.0], 0) for i in range(5)], SCHEMA)).collect()
    assert all((r["whitened"] == 0) == (r["component"] == 2 or r["vec_id"] == 2) for r in flat) and max(r["identity_error"] for r in flat) < 1e-9

    far = whitening.whitened(spark.createDataFrame([(0, [3e38, 1.0]), (1, [-3e38, 2.0]), (2, [0.0, 0.0])], "vec_id long, embedding array<double>")).collect()
    assert all(r["deviation"] is None and r["exact_deviation"] is None or r["vec_id"] == 2 for r in far)
    near = whitening.whitened(spark.createDataFrame([(0, [1e9, 1.0]), (1, [-1e9, 2.0]), (2, [0.0, 0.0])], "vec_id long, embedding array<double>")).collect()
    assert [r["exact_deviation"] for r in near if r["vec_id"] == 0 and r["component"] == 1] == [(3 * 1024 * 10**9) ** 2 + 0]

    empty = spark.createDataFrame([], SCHEMA)
    assert whitening.whitened(empty).count() == 0
    assert whitening.whitened(spark.createDataFrame([(1, None, 2)], SCHEMA)).count() == 0


def test_names_and_types(spark):
    df = spark.createDataFrame([(f"v{i}", v, 1, 2, 3.0) for i, v in enumerate(vectors_of(30, 4))], "key string, vec array<double>, n int, component int, whitened double")
    got = whitening.whitened(df, "key", "vec", components=2)
    assert got.schema["vec_id"].dataType.simpleString() == "string" and got.count() == 60
