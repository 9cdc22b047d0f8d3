"""Whitening against numpy's eigenvectors of the same whole numbers, and exact deviations against Python's."""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pytest

from corpuscope.llm import whitening
from corpuscope.llm.base import read
from corpuscope.llm.catalog import op13_whitening


def brute(rows: list[tuple]) -> dict:
    """(vec_id, vector) -> vec_id: (n, deviation, unsigned whitened values, explained)."""
    kept = [(i, [math.floor(64 * float(c)) + 1_000_000 for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in kept})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    centred = np.array([[float(Fraction(n * c - s, n)) for c, s in zip(x, sums, strict=True)] for x in fit])
    covariance = centred.T @ centred / n
    values, vectors = np.linalg.eigh(covariance)
    order = np.argsort(-values)[:16]
    order = order[values[order] > 1e-9 * values.max()]
    out = {}
    for i, x in kept:
        d = [n * c - s for c, s in zip(x, sums, strict=True)]
        out[i] = (n, sum(v * v for v in d), np.abs(np.array([v / n for v in d]) @ vectors[:, order] / np.sqrt(values[order])), values[order] / np.trace(covariance))
    return out


def compared(rows: list, got: list, least: float = 1e-6) -> None:
    want, seen = brute(rows), {}
    for r in got:
        seen.setdefault(r["vec_id"], {})[r["component"]] = r
    assert set(seen) == set(want)
    for i, (n, deviation, values, explained) in want.items():
        mine = [seen[i][k + 1] for k in range(len(seen[i]))]
        assert len(mine) == len(values) and {(m["n"], m["deviation"], int(m["deviation_exact"])) for m in mine} == {(n, deviation, deviation)}
        assert np.allclose([abs(m["whitened"]) for m in mine], values, atol=least) and np.allclose([m["explained"] for m in mine], explained, rtol=1e-9)
        assert max(m["identity_error"] for m in mine) < 1e-8


@pytest.mark.parametrize("scale", ["0.001", "0.01"])
def test_query(spark, scale):
    folder = f"/root/testdata/sf{scale}"
    rows = [(r["vec_id"], r["embedding"]) for r in read(spark, folder, "embeddings").collect()]
    got = op13_whitening(spark, folder).collect()
    assert len(got) == 16 * len(rows)
    compared(rows, got)
    by = {}
    for r in sorted(got, key=lambda r: r["component"]):
        by.setdefault(r["vec_id"], []).append(r["whitened"])
    x = {tuple(math.floor(64 * c) for c in v): np.array(by[i]) for i, v in rows}
    w = np.array(list(x.values()))
    assert np.abs(w.T @ w / len(w) - np.eye(16)).max() < 1e-8  # one sign for all rows


def test_odd_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(v) for v in rng.normal(size=5) * [9, 5, 3, 2, 1]]) for i in range(40)]
    rows += [(100 + i, rows[0][1]) for i in range(50)] + [(200, None), (201, [1.0, None, 2.0, 3.0, 4.0]), (202, [float("nan")] * 5), (203, [float("inf"), 1.0, 1.0, 1.0, 1.0])]
    frame = spark.createDataFrame([(i, v, "x", 9) for i, v in rows], "vec_id long, embedding array<double>, x string, dim int").repartition(4)
    compared(rows, whitening.whiten(frame).collect())
    other = frame.union(spark.createDataFrame([(300, [1.0, 2.0], "x", 9), (301, [], "x", 9)], frame.schema))
    assert {r["vec_id"] for r in whitening.whiten(other).collect()} == set(brute(rows))  # other dimensions go
    twice = frame.union(frame.where("vec_id = 7")).union(spark.createDataFrame([(None, rows[1][1], "x", 9)], frame.schema))
    got = whitening.whiten(twice).collect()
    assert sum(r["vec_id"] == 7 for r in got) == 10 and sum(r["vec_id"] is None for r in got) == 5


def test_rank_and_size(spark):
    flat = [(i, [float(i % 7), 2.0 * (i % 7), 1.0]) for i in range(30)]  # one direction only
    got = whitening.whiten(spark.createDataFrame(flat, "vec_id long, embedding array<double>")).collect()
    assert {r["component"] for r in got} == {1} and abs(got[0]["explained"] - 1) < 1e-12
    same = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>")
    assert whitening.whiten(same).count() == 0 and whitening.whiten(same.where("false")).count() == 0
    wild = [(i, [1e300 if i == 3 else float(i), -1e15 * i, 3e9 * (i % 2)]) for i in range(9)]
    got = whitening.whiten(spark.createDataFrame(wild, "vec_id long, embedding array<double>")).collect()
    x = [[math.floor(min(max(64 * c, -(2.0**53)), 2.0**53)) + 1_000_000 for c in v] for _, v in wild]
    sums = [sum(c) for c in zip(*x, strict=True)]
    exact = {i: sum((9 * c - s) ** 2 for c, s in zip(row, sums, strict=True)) for (i, _), row in zip(wild, x, strict=True)}
    assert {r["vec_id"]: int(r["deviation_exact"]) for r in got} == exact
    assert {r["deviation"] for r in got} == {v if v < 2**63 else None for v in exact.values()}


def test_factors():
    """Eigenvalues and vectors of random, repeated and deficient matrices, against numpy."""
    rng = np.random.default_rng(1)
    for size, rank in ((1, 1), (2, 2), (9, 4), (33, 33), (64, 20)):
        half = rng.normal(size=(size, rank)) * np.exp(rng.normal(size=rank) * 3)
        matrix = half @ half.T
        values, vectors = whitening.components(matrix)
        assert len(values) <= size and np.allclose(values, np.linalg.eigvalsh(matrix)[::-1][: len(values)], rtol=1e-9, atol=1e-12 * values[0])
        assert np.allclose(vectors.T @ vectors, np.eye(len(values)), atol=1e-10) and np.allclose(vectors * values @ vectors.T, matrix, atol=1e-9 * values[0])
    values, vectors = whitening.components(np.eye(6) * 4)
    assert np.allclose(values, 4) and np.allclose(vectors.T @ vectors, np.eye(6))
    assert len(whitening.components(np.zeros((3, 3)))[0]) == 0
