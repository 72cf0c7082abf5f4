"""Whitening against a full eigendecomposition of the exact covariance."""

from __future__ import annotations

import math

import numpy as np
import pytest

from timelore.llm import whitening
from timelore.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<double>, x string, block int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1) for i, v in rows], SCHEMA)


def brute(rows: list[tuple[int, list[float] | None]]):
    """(rows that take part, n, sums, eigenvalues, components, trace)."""
    kept = [(i, [math.floor(64 * c) + 1_000_000 for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in kept})
    n = len(fit)
    sums = [sum(c) for c in zip(*fit)]
    apart = np.array([[(n * c - s) / n for c, s in zip(x, sums)] for x in fit])
    values, vectors = np.linalg.eigh(apart.T @ apart / n)
    return kept, n, sums, values[::-1], vectors[:, ::-1], float((apart**2).sum() / n)


def compare(got, rows, components: int = 16, rtol: float = 1e-8):
    kept, n, sums, values, vectors, trace = brute(rows)
    k = min(components, int((values > values[0] * 1e-12).sum()))
    by_id = {}
    for r in got:
        by_id.setdefault(r.vec_id, {}).setdefault(r.component, []).append(r)
    assert len(got) == len(kept) * k
    sign = {}
    for i, x in kept:
        apart = np.array([(n * c - s) / n for c, s in zip(x, sums)])
        for c in range(1, k + 1):
            r = by_id[i][c].pop()
            assert (r.n, r.deviation) == (n, sum((n * a - s) ** 2 for a, s in zip(x, sums)))
            assert r.explained == pytest.approx(values[c - 1] / trace, rel=1e-9) and r.identity_error <= 1e-9
            want = float(apart @ vectors[:, c - 1]) / math.sqrt(values[c - 1])
            if abs(want) > 1e-3:
                sign.setdefault(c, 1 if want * r.whitened > 0 else -1)
            assert r.whitened * sign.get(c, 1) == pytest.approx(want, rel=rtol, abs=1e-8)


def test_query_equals_eigendecomposition(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    compare(QUERIES["op12_whitening"](spark, SF).collect(), rows)


def test_odd_rows_and_dependent_dimensions(spark):
    draw = np.random.default_rng(3)
    base = draw.normal(size=(40, 3)).round(3)
    rows = [(i, [float(a), float(b), float(a), 0.25, float(c) * 5, float(a)]) for i, (a, b, c) in enumerate(base)]
    rows += [(100, rows[0][1]), (100, rows[0][1]), (101, [x + 1e-9 for x in rows[1][1]])]  # equal vectors, equal x vectors
    odd = [(200, None), (201, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (202, [float("nan")] * 6), (203, [float("inf")] * 6)]
    got = whitening.whiten(frame(spark, rows + odd)).collect()
    assert {r.component for r in got} == {1, 2, 3}
    compare(got, rows)
    lone = whitening.whiten(frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [])])).collect()
    assert lone == [] and whitening.whiten(frame(spark, [])).count() == 0
    two = whitening.whiten(frame(spark, rows + [(7, [1.0, 2.0]), (8, [2.0, 2.0]), (None, [2.0, 2.0])])).collect()
    assert sorted((r.vec_id or 0, r.component, r.n, abs(round(r.whitened, 9))) for r in two if r.n == 2) == [(0, 1, 2, 1.0), (7, 1, 2, 1.0), (8, 1, 2, 1.0)]


def test_equal_eigenvalues(spark):
    """All signed unit vectors: the covariance is a multiple of the identity, and one start finds one direction only."""
    rows = [(2 * i + s, [float((1 - 2 * s) * (i == j)) for j in range(9)]) for i in range(9) for s in range(2)]
    got = whitening.whiten(frame(spark, rows)).collect()
    assert len(got) == 18 * 9 and max(r.identity_error for r in got) < 1e-12
    assert all(r.explained == pytest.approx(1 / 9) for r in got)


def test_huge_numbers(spark):
    rows = [(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [1e18, 5.0]), (4, [0.0, 2.0])]
    got = whitening.whiten(frame(spark, rows)).collect()
    assert {r.vec_id for r in got} == {1, 2, 3, 4} and all(r.deviation is None or r.deviation >= 0 for r in got)
    centre = whitening.Centre(3_000_000_000, [3_000_000_000 * 1_000_000 + 5] * 2)
    assert centre.deviation(np.array([[1_000_000, 1_000_001]])) == [25 + (3_000_000_000 - 5) ** 2 if 25 + (3_000_000_000 - 5) ** 2 < 1 << 63 else None]
    assert centre.deviation(np.array([[1_000_000, 1_000_009]])) == [None]


def test_early_stop_finds_strong_directions():
    draw = np.random.default_rng(4)
    x = draw.normal(size=(500, 200)) * np.concatenate([[90, 80, 70, 60, 50], np.full(195, 0.5)])
    x -= x.mean(axis=0)
    scans = []

    def scan(p, former):
        scans.append(1)
        u = x @ p
        return float(u @ u), (x @ former).T @ u, x.T @ u

    values, vectors = whitening.bidiagonalise(scan, 200, np.linalg.norm(x), 5, tolerance=1e-12)
    want = np.linalg.svd(x, compute_uv=False)[:5]
    assert np.allclose(values[:5], want, rtol=1e-12) and len(scans) < 40
    assert np.allclose(np.linalg.norm(x @ vectors[:, :5], axis=0), want)
