"""Whitening against numpy's own eigenvectors and exact fractions."""

from fractions import Fraction
from math import floor

import numpy as np
import pytest

from quillgauge.llm import queries, whiten


def brute(rows, wanted=8):
    """{id: [(deviation, whitened by component)]} and the explained shares, with numpy.linalg.eigh."""
    x = [[floor(1024 * c) + 100000 for c in v] for _, v in rows]
    n, d = len(x), len(x[0])
    sums = [sum(r[j] for r in x) for j in range(d)]
    centred = np.array([[float(Fraction(n * r[j] - sums[j], n)) for j in range(d)] for r in x])
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)[:wanted]
    white = centred @ axes[:, order] / np.sqrt(values[order])
    far = [sum((n * r[j] - sums[j]) ** 2 for j in range(d)) for r in x]
    return white, far, values[order] / values.sum()


def test_embeddings(spark, sf):
    rows = [(r[0], [float(c) for c in r[1]]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
    got = queries.op13_whiten(spark, sf).collect()
    assert len(got) == 8 * len(rows)
    white, far, explained = brute(rows)
    at = {i: k for k, (i, _) in enumerate(rows)}
    found = np.empty_like(white)
    for r in got:
        k, c = at[r["vec_id"]], r["component"] - 1
        found[k, c] = r["whitened"]
        assert (r["n"], r["deviation"]) == (len(rows), far[k])
        assert r["explained"] == pytest.approx(explained[c], rel=1e-9)
        assert r["identity_error"] < 1e-9
    signs = np.sign((found * white).sum(axis=0))
    assert np.abs(found * signs - white).max() < 1e-6


def rotated(values, seed=0):
    q, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(values), len(values))))
    return q @ np.diag(np.array(values, float)) @ q.T


@pytest.mark.parametrize(
    "values",
    [
        [3.0], [2, 1], [5, 5], [1, 1, 1, 1], [9, 4, 4, 4, 1, 0, 0], [-3, -1, 0, 2, 8], [1e12, 1, 1e-3], [0, 0, 0],
        list(range(1, 41)), [7] * 10 + [3] * 10 + [1e-9] * 3, list(np.geomspace(1, 1e10, 24)), [1 + 1e-13, 1, 1 - 1e-13, 0.5],
    ],
)
@pytest.mark.parametrize("wanted", [2, 64])
def test_spectral_division(values, wanted):
    v = rotated(values)
    v = (v + v.T) / 2
    found, axes = whiten.components(v, wanted)
    scale = max(1.0, np.abs(values).max())
    assert np.abs(found - np.sort(values)[::-1][:wanted]).max() < 1e-13 * scale * len(values)
    assert np.abs(axes.T @ axes - np.eye(axes.shape[1])).max() < 1e-12
    assert np.abs(v @ axes - axes * found).max() < 1e-12 * scale * len(values)


def test_diagonal_and_polar():
    found, axes = whiten.components(np.diag([1.0, 3.0, 2.0]), 3)
    assert found.tolist() == pytest.approx([3, 2, 1])
    assert np.abs(axes).round(12).argmax(axis=0).tolist() == [1, 2, 0]
    v = rotated([4, 1, -2, -5], 3)
    values, q = np.linalg.eigh(v)
    assert np.abs(whiten.polar((v + v.T) / 2) - q @ np.diag(np.sign(values)) @ q.T).max() < 1e-13


NAN, INF = float("nan"), float("inf")


def frame(spark, rows):
    own = "id long, vector array<double>, whitened string, Deviation string, n int, component int"
    return spark.createDataFrame([(i, v, "x", "y", 1, 2) for i, v in rows], own).repartition(3)


def test_awkward_rows(spark):
    rng = np.random.default_rng(4)
    good = [(k % 7 if k % 3 else None, rng.normal(0, 3, 5).tolist()) for k in range(60)]
    good += [good[5]] * 30
    bad = [(1, None), (2, []), (3, [1.0, None, 2.0, 3.0, 4.0]), (4, [NAN] * 5), (5, [1.0, INF, 0.0, 0.0, 0.0]), (6, [1.0, 2.0]), (None, None)]
    df = frame(spark, [*good, *bad])
    fitted = whiten.fit(df, wanted=8)
    out = whiten.whiten(df, fitted)
    assert out.columns == ["id", "vector", "n", "component", "whitened", "deviation"]
    white, far, explained = brute(good, 5)
    assert fitted.n == len(good) and fitted.explained.tolist() == pytest.approx(explained.tolist())
    key = {tuple(v): (f, np.abs(w)) for (_, v), f, w in zip(good, far, white, strict=True)}
    rows = out.collect()
    assert len(rows) == len(good)
    for r in rows:
        f, w = key[tuple(r["vector"])]
        assert r["deviation"] == f and np.abs(np.abs(r["whitened"]) - w).max() < 1e-8
    empty = frame(spark, bad[:5])
    assert whiten.fit(empty) is None and whiten.whiten(empty, None).count() == 0
    assert whiten.fit(df.limit(0)) is None


def test_rows_without_variance_and_huge_entries(spark):
    same = frame(spark, [(i, [1.5, -2.0]) for i in range(5)])
    fitted = whiten.fit(same)
    assert [(r["whitened"], r["deviation"]) for r in whiten.whiten(same, fitted).collect()] == [([], 0)] * 5
    flat = frame(spark, [(i, [float(i), 2.0 * i, 7.0]) for i in range(9)])
    assert len(whiten.fit(flat).variances) == 1
    huge = frame(spark, [(0, [1e300, 0.0]), (1, [-1e300, 1.0]), (2, [5.0, 2.0])])
    rows = whiten.whiten(huge, fitted := whiten.fit(huge)).collect()
    assert fitted.error < 1e-4
    assert sorted(r["deviation"] is None for r in rows) == [False, True, True]


def test_many_vectors_in_one_task(spark):
    """Blocks, partitions and their sums: the same fit however rows are dealt out."""
    rng = np.random.default_rng(8)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(50, 1, (9000, 12)) * np.arange(1, 13))]
    fits = [whiten.fit(frame(spark, rows).repartition(k)) for k in (1, 7)]
    assert fits[0].sums == fits[1].sums
    assert fits[0].variances == pytest.approx(fits[1].variances, rel=1e-12)
    assert max(f.error for f in fits) < 1e-10
