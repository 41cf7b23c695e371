import math
import random

import numpy as np
import pytest

from gazeledger.llm import catalog, jacobi_davidson, whitening

SF = "/root/testdata/sf0.01"


def brute(vectors, components=16):
    """x vectors of the usable rows, n, exact deviations, eigenvalues, |whitened| of the distinct rows' covariance."""
    kept = [[math.floor(64 * c) + 1_000_000 for c in v] for v in vectors]
    fit = sorted(set(map(tuple, kept)))
    n = len(fit)
    s = [sum(col) for col in zip(*fit, strict=True)]
    deviation = [sum((n * x - t) ** 2 for x, t in zip(row, s, strict=True)) for row in kept]
    centre = np.array([[float(n * x - t) / n for x, t in zip(row, s, strict=True)] for row in fit])
    values, q = np.linalg.eigh(centre.T @ centre / n)
    values, q = values[::-1][:components], q[:, ::-1][:, :components]
    rows = np.array([[float(n * x - t) / n for x, t in zip(row, s, strict=True)] for row in kept])
    return n, deviation, values, (rows @ q) / np.sqrt(np.maximum(values, 1e-300)), (centre**2).sum() / n


@pytest.mark.parametrize("kind", ["spread", "flat", "low", "repeated"])
@pytest.mark.parametrize("size", [1, 3, 40, 150])
def test_pairs_match_a_dense_solver(kind, size):
    rng = np.random.default_rng(size)
    q, _ = np.linalg.qr(rng.standard_normal((size, size)))
    e = {"spread": 10.0 ** rng.uniform(-3, 3, size), "flat": 1 + 0.01 * rng.random(size), "low": np.arange(size) < 5, "repeated": 1.0 + (np.arange(size) < 20)}[kind]
    a = (q * e) @ q.T
    a = (a + a.T) / 2
    values, vectors = jacobi_davidson.largest_pairs(lambda u: a @ u, size, 16)
    want = np.sort(np.linalg.eigvalsh(a))[::-1][:16]
    assert np.abs(values - want).max() <= 1e-12 * want[0]
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-12
    assert np.linalg.norm(a @ vectors - vectors * values, axis=0).max() <= 1e-13 * want[0]


def test_minres_solves_shifted_systems():
    rng = np.random.default_rng(1)
    a = rng.standard_normal((25, 25))
    a = a + a.T
    b, shifts = rng.standard_normal((25, 4)), np.array([0.0, 1.0, -2.0, 7.0])
    x = jacobi_davidson.minres(lambda v: a @ v, shifts, b, 60)
    assert np.abs(a @ x - x * shifts - b).max() < 1e-9
    sizes = [np.linalg.norm(a @ y - y * shifts - b, axis=0) for k in (2, 6, 12) for y in [jacobi_davidson.minres(lambda v: a @ v, shifts, b, k)]]
    assert (sizes[0] >= sizes[1]).all() and (sizes[1] >= sizes[2]).all()
    assert not jacobi_davidson.minres(lambda v: a @ v, shifts, 0 * b, 5).any()


def test_query_matches_a_dense_solver(spark):
    rows = [r for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect() if r["embedding"] and all(c is not None and math.isfinite(c) for c in r["embedding"])]
    n, deviation, values, whitened, trace = brute([r["embedding"] for r in rows])
    got = catalog.op13_whitening(spark, SF).collect()
    assert len(got) == 16 * len(rows)
    place = {r["vec_id"]: i for i, r in enumerate(rows)}
    signs = {}
    for r in got:
        i, k = place[r["vec_id"]], r["component"] - 1
        assert (r["n"], r["deviation"]) == (n, deviation[i])
        assert abs(r["explained"] - values[k] / trace) < 1e-10
        assert r["identity_error"] < 1e-10
        if abs(whitened[i, k]) > 0.5:
            sign = signs.setdefault(k, np.sign(r["whitened"] * whitened[i, k]))
        else:
            sign = np.sign(r["whitened"] * whitened[i, k]) or 1
        assert abs(r["whitened"] - sign * whitened[i, k]) < 1e-8


def test_rows_to_drop_and_copies(spark):
    rng = random.Random(9)
    good = [[rng.gauss(0, 1), rng.gauss(1, 2), rng.gauss(0, 0.5)] for _ in range(30)]
    rows = [(i, v) for i, v in enumerate(good)] + [(None, good[0])] * 40 + [(3, good[7])]
    bad = [(100, None), (101, []), (102, [1.0, None, 2.0]), (103, [float("nan"), 1.0, 2.0]), (104, [1.0, float("inf"), 2.0]), (105, [1.0, 2.0]), (106, [1e300, 0.0, 0.0])]
    df = spark.createDataFrame([(i, v, 5) for i, v in rows + bad], "vec_id bigint, embedding array<double>, x int").repartition(3)
    got = whitening.whiten(df).collect()
    n, deviation, values, whitened, trace = brute([v for _, v in rows])
    assert n == 30 and len(got) == 3 * len(rows) and {r["n"] for r in got} == {30}
    assert sorted(r["deviation"] for r in got if r["component"] == 1) == sorted(deviation)
    assert np.allclose(sorted(abs(r["whitened"]) for r in got if r["component"] == 2), sorted(np.abs(whitened[:, 1])), atol=1e-9)
    assert {r["component"] for r in got if r["vec_id"] is None} == {1, 2, 3}
    assert len(whitening.whiten(df, components=2).collect()) == 2 * len(rows)


def test_degenerate_tables(spark):
    def run(rows):
        return whitening.whiten(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")).collect()

    assert run([]) == [] and run([(1, None)]) == [] and run([(1, [1.0, 2.0])] * 5) == []
    line = run([(1, [0.0, 1.0]), (2, [1.0, 1.0]), (3, [2.0, 1.0])])
    assert {r["component"] for r in line} == {1} and all(abs(r["explained"] - 1) < 1e-12 for r in line)
    far = run([(1, [2.0**50, 0.0]), (2, [-(2.0**50), 0.0])])
    assert [r["deviation"] for r in far] == [None, None] and all(abs(abs(r["whitened"]) - 1) < 1e-12 for r in far)
