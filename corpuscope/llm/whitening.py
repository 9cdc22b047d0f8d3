"""Whitening of embeddings: pivoted Cholesky of the centred scatter, then one-sided Jacobi on its triangular factor.

Entries become whole numbers first (``floor(64 c) + 1000000``), so counts, sums and deviations are exact. The fit list holds each distinct vector once. A first pass
adds up its size and sums, a second the scatter of n x - S, centred in whole numbers before anything is multiplied; each task sends one row per
dimension. The scatter (dimensions squared, whatever the number of rows) is factored on the driver: pivoted Cholesky stops at the numerical rank, and
rotations of pairs of columns of the triangular factor make them orthogonal. Their squared norms are the eigenvalues of the scatter, the normalised columns its components.
A third pass over the fit list measures the covariance of the whitened vectors.

Cases: rows whose vector is null or holds a null or non-finite entry are dropped, and so are rows of another dimension than most distinct vectors
have (ties: the larger dimension); repeated rows and vectors get equal results and count once in the fit; components end at the rank, so that no
direction without variance is divided by zero (a fit list of one vector gives no rows, nor does an empty table); entries beyond 2^53 / 64 are held at that size;
deviations beyond a long are null in ``deviation`` and whole in ``deviation_exact``; long vectors cost their dimension squared on the driver;
a null vec_id stays null; extra columns are left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscope.llm.base import stored
from corpuscope.session import ship_package, task_count

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 16
MOST = float(2**53)
BLOCK = 4_096


def whole_numbers(vectors: DataFrame) -> DataFrame:
    """``vec_id``, ``x`` (array of longs) and ``dim`` of the rows whose vector is whole and finite."""
    c = vectors["embedding"].cast("array<double>")
    finite = F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    held = vectors.where(c.isNotNull() & finite)
    x = F.transform(c, lambda v: F.floor(F.greatest(F.least(v * SCALE, F.lit(MOST)), F.lit(-MOST))).cast("long") + SHIFT)
    return held.select(vectors["vec_id"].alias("vec_id"), x.alias("x")).withColumn("dim", F.size("x"))


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    """First row and matrix of every ``BLOCK`` rows of a batch of equally long ``x``."""
    for start in range(0, batch.num_rows, BLOCK):
        part = batch.slice(start, BLOCK)
        yield start, part.column("x").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(part.num_rows, -1)


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n x - S in whole numbers: longs where they fit, Python's otherwise."""
    largest = max((abs(s) for s in sums), default=0)
    if n * (int(np.abs(x).max(initial=0)) + 1) < 2**62 and largest < 2**62:
        return x * np.int64(n) - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def deviations(d: np.ndarray) -> list[int]:
    """Row sums of squares, exact."""
    if d.dtype != object and d.size and int(np.abs(d).max()) ** 2 * d.shape[1] >= 2**63:
        d = d.astype(object)
    return [int(v) for v in (d * d).sum(axis=1)]


def _sized(fit: DataFrame) -> tuple[int, int, list[int]]:
    """Dimension, size and sums of the fit list."""
    counted = fit.groupBy("dim").agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("dim")).limit(1).collect()
    if not counted:
        return 0, 0, []
    dim, n = counted[0]["dim"], counted[0]["n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(dim, object)
        for batch in batches:
            for _, x in _blocks(batch):
                total = total + (x.astype(object) if np.abs(x).max(initial=0) >= 2**50 else x).sum(axis=0).astype(object)
        yield pa.RecordBatch.from_arrays([pa.array(range(dim), pa.int32()), pa.array([Decimal(int(t)) for t in total], pa.decimal128(38, 0))], names=["i", "part"])

    parts = fit.where(F.col("dim") == dim).select("x").mapInArrow(run, "i int, part decimal(38,0)")
    sums = {r["i"]: int(r["s"]) for r in parts.groupBy("i").agg(F.sum("part").alias("s")).collect()}
    return dim, n, [sums[i] for i in range(dim)]


def _summed_products(fit: DataFrame, size: int, product: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of ``product`` (a square matrix of a block of ``x``) over the fit list: one row per task and matrix row, added up by streaming."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, any_rows = np.zeros((size, size)), False
        for batch in batches:
            for _, x in _blocks(batch):
                total, any_rows = total + product(x), True
        if any_rows:
            yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), pa.array([r.tobytes() for r in total], pa.binary())], names=["i", "row"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, row in zip(batch.column("i").to_pylist(), batch.column("row").to_pylist(), strict=True):
                held[i] = held.get(i, 0) + np.frombuffer(row)
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([v.tobytes() for v in held.values()], pa.binary())], names=["i", "row"])

    width = task_count(fit.sparkSession)
    rows = fit.select("x").mapInArrow(run, "i int, row binary").repartition(width, "i").mapInArrow(add, "i int, row binary").collect()
    total = np.zeros((size, size))
    for r in rows:
        total[r["i"]] = np.frombuffer(bytes(r["row"]))
    return total


def pivoted_cholesky(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """L and p with matrix[p][:, p] = L L^T, the largest remaining diagonal first; L has as many columns as the matrix has numerical rank."""
    size = len(matrix)
    rest, order = matrix.astype(float).copy(), np.arange(size)
    factor = np.zeros((size, size))
    least = size * np.finfo(float).eps * max(np.diag(rest).max(initial=0.0), 0.0)
    for k in range(size):
        spot = k + int(np.argmax(np.diag(rest)[k:]))
        if rest[spot, spot] <= least:
            return factor[:, :k], order
        for held in (rest, factor):
            held[[k, spot]] = held[[spot, k]]
        rest[:, [k, spot]] = rest[:, [spot, k]]
        order[[k, spot]] = order[[spot, k]]
        factor[k, k] = np.sqrt(rest[k, k])
        factor[k + 1 :, k] = rest[k + 1 :, k] / factor[k, k]
        rest[k + 1 :, k + 1 :] -= np.outer(factor[k + 1 :, k], factor[k + 1 :, k])
    return factor, order


def one_sided_jacobi(factor: np.ndarray, sweeps: int = 60) -> np.ndarray:
    """The factor times rotations that make its columns orthogonal, the columns by falling norm.

    Rounds of a tournament rotate disjoint pairs together; a sweep meets every pair once, and the sweeps end when all pairs were orthogonal to rounding.
    """
    columns = factor.copy()
    many = columns.shape[1]
    if many > 1:
        ring = list(range(many + many % 2))
        for _ in range(sweeps):
            worst = 0.0
            for _ in range(len(ring) - 1):
                pairs = [(min(p), max(p)) for p in zip(ring[: len(ring) // 2], reversed(ring[len(ring) // 2 :]), strict=True) if max(p) < many]
                one, two = (np.array(side) for side in zip(*pairs, strict=True))
                left, right = columns[:, one], columns[:, two]
                alpha, beta, gamma = (left * left).sum(axis=0), (right * right).sum(axis=0), (left * right).sum(axis=0)
                size = np.sqrt(alpha * beta)
                off = np.abs(gamma) > 1e-15 * size
                worst = max(worst, float((np.abs(gamma) / np.where(size > 0, size, 1)).max()))
                zeta = (beta - alpha) / np.where(off, 2 * gamma, 1)
                tangent = np.where(off, np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1, zeta)), 0.0)
                cosine = 1 / np.hypot(1, tangent)
                sine = cosine * tangent
                columns[:, one], columns[:, two] = cosine * left - sine * right, sine * left + cosine * right
                ring = [ring[0], ring[-1], *ring[1:-1]]
            if worst < 1e-14:
                break
    return columns[:, np.argsort(-(columns * columns).sum(axis=0), kind="stable")]


def components(scatter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) of a scatter matrix and unit eigenvectors as columns, as many as its rank."""
    factor, order = pivoted_cholesky(scatter)
    rotated = one_sided_jacobi(factor)
    norms = np.sqrt((rotated * rotated).sum(axis=0))
    vectors = np.zeros_like(rotated)
    vectors[order] = rotated / norms
    return norms**2, vectors


class Fit:
    """What whitening needs: dimension, size and sums of the fit list, the trace of the covariance, its eigenvalues and components."""

    def __init__(self, dim: int, n: int, sums: list[int], trace: float, values: np.ndarray, vectors: np.ndarray):
        self.dim, self.n, self.sums, self.trace, self.values, self.vectors = dim, n, sums, trace, values, vectors

    def whitened(self, d: np.ndarray) -> np.ndarray:
        """Of rows n x - S: (x - S / n) along the components, over the roots of their eigenvalues."""
        return (d / self.n).astype(float) @ (self.vectors / np.sqrt(self.values))


def fitted(fit: DataFrame, most: int = COMPONENTS) -> Fit:
    """The whitening of the distinct vectors ``x`` of a fit list (``x``, ``dim``), read twice, with up to ``most`` components."""
    dim, n, sums = _sized(fit)
    if not dim or n < 2:
        return Fit(dim, n, sums, 0.0, np.zeros(0), np.zeros((dim, 0)))

    def product(x: np.ndarray) -> np.ndarray:
        d = (centred(x, n, sums) / n).astype(float)
        return d.T @ d

    covariance = _summed_products(fit.where(F.col("dim") == dim), dim, product) / n
    values, vectors = components(covariance)
    return Fit(dim, n, sums, float(np.trace(covariance)), values[:most], vectors[:, :most])


def identity_error(fit: DataFrame, model: Fit) -> float:
    """The largest absolute entry of the covariance of the whitened fit list minus the identity."""
    many = len(model.values)
    if not many:
        return 0.0

    def product(x: np.ndarray) -> np.ndarray:  # n x - S adds up to zero exactly, so the values are centred
        w = model.whitened(centred(x, model.n, model.sums))
        return w.T @ w

    total = _summed_products(fit.where(F.col("dim") == model.dim), many, product) / model.n
    return float(np.abs(total - np.eye(many)).max())


def whiten(vectors: DataFrame, most: int = COMPONENTS) -> DataFrame:
    """Per remaining row and component: ``vec_id``, ``component``, ``n``, ``deviation``, ``whitened``, ``explained``, ``identity_error``, ``deviation_exact``, ``eigenvalue``."""
    ship_package(vectors.sparkSession)
    rows = whole_numbers(vectors)
    fit = stored(rows.groupBy("x").agg(F.first("dim").alias("dim")))
    model = fitted(fit, most)
    error, many = identity_error(fit, model), len(model.values)
    kind = dict(rows.dtypes)["vec_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, x in _blocks(batch):
                d = centred(x, model.n, model.sums)
                exact = deviations(d)
                again = lambda values: pa.array([v for v in values for _ in range(many)])
                each = np.tile(np.arange(many), len(x))
                ids = batch.column("vec_id").slice(start, len(x)).take(pa.array(np.repeat(np.arange(len(x)), many)))
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array((each + 1).astype(np.int32)), pa.array(np.full(len(each), model.n)), again([v if v < 2**63 else None for v in exact]).cast(pa.int64()),
                     pa.array(model.whitened(d).ravel()), pa.array((model.values / model.trace)[each]), pa.array(np.full(len(each), error)),
                     again([Decimal(v) for v in exact]).cast(pa.decimal128(38, 0)), pa.array(model.values[each])],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error", "deviation_exact", "eigenvalue"])

    kinds = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_exact decimal(38,0), eigenvalue double"
    own = rows.where(F.col("dim") == model.dim) if many else rows.where("false")
    return own.select("vec_id", "x").mapInArrow(run, kinds)
