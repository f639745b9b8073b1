import numpy as np
import pytest

from corvane.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label string"


def expected(rows, components=4):
    """n, deviations, whitened rows (up to sign) and explained shares by the covariance's eigenvectors."""
    kept = [(i, v) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    x = np.array([[int(np.floor(256 * np.float64(np.float32(c)))) for c in v] for _, v in kept], object)
    fit = np.array(sorted(set(map(tuple, x))), object)
    n, total = len(fit), fit.sum(axis=0)
    deviation = ((n * x - total) ** 2).sum(axis=1)
    mean = (total / n).astype(float)
    centred = fit.astype(float) - mean
    e, v = np.linalg.eigh(centred.T @ centred / n)
    e, v = e[::-1], v[:, ::-1]
    return [i for i, _ in kept], n, deviation, (x.astype(float) - mean) @ v[:, :components] / np.sqrt(e[:components]), e[:components] / e.sum()


def held(found, rows, components=4):
    ids, n, deviation, white, share = expected(rows, components)
    by = {}
    for r in found:
        by.setdefault(r["vec_id"], {})[r["component"]] = r
    assert len(found) == len(ids) * white.shape[1]
    signs = np.sign([by[ids[0]][c + 1]["whitened"] * white[0, c] for c in range(white.shape[1])])
    for k, i in enumerate(ids):
        for c in range(white.shape[1]):
            r = by[i][c + 1]
            assert (r["n"], r["deviation"]) == (n, deviation[k])
            assert r["whitened"] == pytest.approx(signs[c] * white[k, c], abs=1e-7)
            assert r["explained"] == pytest.approx(share[c], rel=1e-9)
            assert 0 <= r["identity_error"] < 1e-9


def test_query_equals_brute_force(spark, sf_dir):
    given = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()]
    held(whitening.op13_whitening(spark, sf_dir).collect(), given)


def test_many_blocks_and_triangles(spark, monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK", 7)
    rng = np.random.default_rng(5)
    rows = [(i, [float(c) for c in rng.normal(size=6) * [9, 4, 2, 1, 0.5, 0.25]]) for i in range(400)]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], SCHEMA).repartition(40)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        found = whitening.whitened(df, whitening.fitted(df)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    held(found, [(i, list(map(np.float32, v))) for i, v in rows])


@pytest.mark.parametrize("shape", [(3, 3), (40, 7), (5, 9), (200, 16), (4, 1)])
def test_jacobi_equals_the_svd(shape):
    a = np.random.default_rng(1).normal(size=shape) * np.logspace(0, -6, shape[1])
    s, v = whitening.jacobi(whitening.triangle(a))
    want = np.linalg.svd(a, compute_uv=False)
    assert s[: len(want)] == pytest.approx(want, rel=1e-9, abs=1e-14)
    assert np.abs(v.T @ v - np.eye(shape[1])).max() < 1e-13
    assert np.linalg.norm(a @ v, axis=0) == pytest.approx(s, rel=1e-6, abs=1e-13)


def test_bad_and_repeated_rows(spark):
    good = [(k, [float(k % 5), float(k * k % 7), 1.0]) for k in range(30)]
    bad = [(90, None), (91, [1.0, None, 2.0]), (92, [float("nan"), 1.0, 1.0]), (93, [float("inf"), 1.0, 1.0]), (94, [1.0, 2.0]), (95, []), (96, [1e30, 1.0, 1.0])]
    df = spark.createDataFrame([(i, v, "x") for i, v in [*good, *bad, good[3], good[3]]], SCHEMA)
    found = whitening.whitened(df, whitening.fitted(df)).collect()
    assert {r["component"] for r in found} == {1, 2}  # the third dimension never varies
    assert sum(r["vec_id"] == 3 for r in found) == 3 * 2
    assert {r["vec_id"] for r in found} == set(range(30))
    once = [r for k, r in enumerate(found) if (r["vec_id"], r["component"]) not in {(x["vec_id"], x["component"]) for x in found[:k]}]
    held(once, good, components=2)


def test_no_variance_null_id_and_empty(spark):
    for rows in ([], [(1, [1.0, 2.0], "x")], [(1, [1.0], "x"), (2, [1.0], "x")], [(1, None, "x")]):
        df = spark.createDataFrame(rows, SCHEMA)
        assert whitening.whitened(df, whitening.fitted(df)).collect() == []
    df = spark.createDataFrame([(None, [1.0], "x"), (2, [3.0], "y"), (2, [3.0], "y")], SCHEMA)
    found = sorted((r["vec_id"] or 0, r["n"], r["deviation"], abs(round(r["whitened"], 9))) for r in whitening.whitened(df, whitening.fitted(df)).collect())
    assert found == [(0, 2, 512**2, 1.0), (2, 2, 512**2, 1.0), (2, 2, 512**2, 1.0)]


def test_columns_of_any_name_and_deviations_beyond_64_bits(spark):
    df = spark.createDataFrame([(1, [1e9], 1, 2), (2, [-1e9], 1, 2), (3, [0.0], 1, 2)], "vec_id long, embedding array<float>, x int, part int")
    found = {r["vec_id"]: r["deviation"] for r in whitening.whitened(df, whitening.fitted(df)).collect()}
    assert found == {1: None, 2: None, 3: 0}
