"""Whitening of embeddings by polarisation covariance, in whole numbers up to the eigenvectors.

Components become whole numbers x = floor(64 c) + 1000000. The distinct x-vectors of one length are a fit list of n. With
m the whole part of the mean, u = x - m is small, and a task sums the exact squares of u[i] for every dimension and of
u[i] + u[j] for every pair. As sum((n x - S)**2) = n**2 sum(u**2) - n r**2 with r = S - n m, these give the exact variance
of every dimension and pair sum; cov(i, j) = (var(i + j) - var(i) - var(j)) / 2 is then a quotient of whole numbers,
rounded once when the matrix is assembled for ``eigh``. Nothing is subtracted in floating point before that.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sojourn.session import materialize

SCALE, SHIFT = 64, 1_000_000
#: Bytes of vectors worked on at a time.
BLOCK = 1 << 22
#: Below this size of u, squares of pair sums of a block fit in 64 bits; larger ones are summed as Python integers.
SMALL = 1 << 20
#: Eigenvalues below this share of the largest are rounding errors of a matrix of lower rank.
RANK = 1e-12
#: Whole parts beyond this count as this; their squares still add up within 38 digits.
LIMIT = 2.0**50
_SUMS = "dim int, i int, j int, value decimal(38,0)"
ROW = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double"


@dataclass(frozen=True)
class Model:
    """Fit of one vector length: ``m`` and ``r`` give the mean m + r / n; columns of ``axes`` are components over sqrt(e)."""

    n: int
    m: np.ndarray
    r: list[int]
    axes: np.ndarray
    explained: np.ndarray


def packed(vector: pa.Array) -> list[bytes | None]:
    """x-vectors as little-endian 64-bit integers; None for a vector that is NULL or holds a NULL or non-finite entry."""
    lists = vector.cast(pa.large_list(pa.float64()))
    offsets = np.asarray(lists.offsets)
    flat = lists.flatten() if lists.null_count else lists.values.slice(offsets[0], offsets[-1] - offsets[0])
    bounds = np.concatenate([[0], np.cumsum(np.asarray(lists.value_lengths().fill_null(0)))]).astype(np.int64)
    numbers = flat.to_numpy(zero_copy_only=False)  # NULL entries become NaN
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(numbers))])
    usable = (bad[bounds[1:]] == bad[bounds[:-1]]) & ~np.asarray(lists.is_null())
    with np.errstate(invalid="ignore", over="ignore"):
        whole = np.clip(np.nan_to_num(np.floor(SCALE * numbers)), -LIMIT, LIMIT).astype("<i8") + SHIFT
    return [whole[a:b].tobytes() if ok else None for a, b, ok in zip(bounds[:-1], bounds[1:], usable)]


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = pa.array(packed(batch.column(1)), pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), x], ["vec_id", "x"]).filter(x.is_valid())


def _blocks(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, x as a matrix) of rows of one length, about ``BLOCK`` bytes at a time."""
    lengths = np.asarray(pc.binary_length(column)).astype(np.int64)
    for length in np.unique(lengths):
        places = np.flatnonzero(lengths == length)
        step = max(1, BLOCK // max(1, int(length)))
        for low in range(0, len(places), step):
            taken = places[low : low + step]
            data = b"".join(column.take(pa.array(taken)).to_pylist())
            yield taken, np.frombuffer(data, "<i8").reshape(len(taken), int(length) // 8)


def _centred(x: np.ndarray, m: np.ndarray) -> np.ndarray:
    """x - m, as Python integers where squares of pair sums might not fit in 64 bits."""
    u = x - m
    return u if np.abs(u).max(initial=0) < SMALL else u.astype(object)


def _rows(totals: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Sums of a task as rows (dim, i, j, value), one per entry of the upper triangle."""
    for dim, total in totals.items():
        i, j = np.triu_indices(dim) if total.ndim == 2 else (np.arange(dim), np.arange(dim))
        values = total[i, j] if total.ndim == 2 else total
        yield pa.RecordBatch.from_arrays([
            pa.array(np.full(len(i), dim), pa.int32()), pa.array(i, pa.int32()), pa.array(j, pa.int32()),
            pa.array([int(v) for v in values], pa.decimal128(38, 0)),
        ], ["dim", "i", "j", "value"])


def _sums(work: Callable[[dict[int, np.ndarray], np.ndarray], None]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, x in _blocks(batch.column(0)):
                work(totals, x)
        yield from _rows(totals)

    return run


def _add(totals: dict[int, np.ndarray], dim: int, part: np.ndarray) -> None:
    totals[dim] = totals[dim] + part if dim in totals else part


def _plain_sums(totals: dict[int, np.ndarray], x: np.ndarray) -> None:
    """Sums by dimension; whole and remaining part of 2**32 apart, so that no block overflows."""
    high, low = x >> 32, x & 0xFFFFFFFF
    _add(totals, x.shape[1], (high.sum(0).astype(object) << 32) + low.sum(0).astype(object))


def _pair_squares(means: dict[int, np.ndarray]) -> Callable:
    def work(totals: dict[int, np.ndarray], x: np.ndarray) -> None:
        u = _centred(x, means[x.shape[1]])
        dim = u.shape[1]
        squares = np.zeros((dim, dim), object)
        for i in range(dim):
            pair = u[:, i : i + 1] + u[:, i:]  # the entry of i itself is twice u, so its square is four times that of u
            squares[i, i:] = (pair * pair).sum(0)
        _add(totals, dim, squares)

    return work


def _collect(fit: DataFrame, work: Callable) -> dict[int, dict[tuple[int, int], int]]:
    """Sums over the fit list: at most one per pair of dimensions and length reaches the driver."""
    found: dict[int, dict[tuple[int, int], int]] = {}
    summed = fit.select("x").mapInArrow(_sums(work), _SUMS).groupBy("dim", "i", "j").agg(F.sum("value").alias("value"))
    for row in summed.collect():
        found.setdefault(row.dim, {})[row.i, row.j] = int(row.value)
    return found


def covariance(n: int, r: list[int], squares: dict[tuple[int, int], int]) -> np.ndarray:
    """Covariances from sums of squared u[i] + u[j]; ``r`` are the sums of u. Each entry is rounded once."""
    dim = len(r)
    scaled = np.zeros((dim, dim), object)  # n**2 times the variance
    for (i, j), total in squares.items():
        scaled[i, j] = n * total - (r[i] + r[j]) ** 2
    single = [scaled[i, i] // 4 for i in range(dim)]
    v = np.zeros((dim, dim))
    for i in range(dim):
        for j in range(i, dim):
            v[i, j] = v[j, i] = float(Fraction(single[i] if i == j else scaled[i, j] - single[i] - single[j], n * n * (1 if i == j else 2)))
    return v


def fit_models(fit: DataFrame, components: int) -> dict[int, Model]:
    """A model for each vector length of the stored fit list; lengths without variance get no components."""
    counts = {r.length // 8: r.n for r in fit.groupBy(F.octet_length("x").alias("length")).agg(F.count(F.lit(1)).alias("n")).collect()}
    sums = _collect(fit, _plain_sums)
    means, rest = {}, {}
    for dim, n in counts.items():
        s = [sums.get(dim, {}).get((i, i), 0) for i in range(dim)]
        means[dim] = np.array([v // n for v in s], np.int64)
        rest[dim] = [v % n for v in s]
    squares = _collect(fit, _pair_squares(means))
    models = {}
    for dim, n in counts.items():
        v = covariance(n, rest[dim], squares.get(dim, {}))
        e, axes = np.linalg.eigh(v) if dim else (np.zeros(0), v)
        order = np.argsort(-e, kind="stable")[:components]
        order = order[e[order] > RANK * max(e.max(initial=0.0), 0.0)]
        models[dim] = Model(n, means[dim], rest[dim], axes[:, order] / np.sqrt(e[order]), e[order] / np.trace(v) if len(order) else e[order])
    return models


def _whitened(model: Model, x: np.ndarray) -> np.ndarray:
    u = _centred(x, model.m).astype(np.float64)
    return (u - np.array([k / model.n for k in model.r])) @ model.axes


def identity_error(fit: DataFrame, models: dict[int, Model]) -> float:
    """Largest entry of the whitened fit list's covariance minus the identity, from its rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, x in _blocks(batch.column(0)):
                w = _whitened(models[x.shape[1]], x)
                _add(totals, x.shape[1], w.T @ w)
        for dim, total in totals.items():
            i, j = np.indices(total.shape)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(total.size, dim), pa.int32()), pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()), pa.array(total.ravel()),
            ], ["dim", "i", "j", "value"])

    parts = fit.select("x").mapInArrow(run, "dim int, i int, j int, value double").groupBy("dim", "i", "j").agg(F.sum("value").alias("value")).collect()
    return max((abs(p.value / models[p.dim].n - (p.i == p.j)) for p in parts), default=0.0)


def _deviations(model: Model, x: np.ndarray) -> list[int | None]:
    """Sum over dimensions of (n x - S)**2, exact; None where 64 bits do not hold it."""
    u = _centred(x, model.m)
    if u.dtype != object and np.abs(u).max(initial=0) * model.n < 1 << 28 and x.shape[1] < 128:
        return ((u * model.n - np.array(model.r, np.int64)) ** 2).sum(1).tolist()
    exact = ((u.astype(object) * model.n - np.array(model.r, object)) ** 2).sum(1)
    return [int(v) if v < 1 << 63 else None for v in exact]


def whiten(vectors: DataFrame, components: int = 16, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per usable vector and component: ``vec_id, component, n, deviation, whitened, explained, identity_error``.

    Vectors that are NULL or hold NULL or non-finite entries give no rows. Vectors of different lengths have fit lists and components of their own;
    ``identity_error`` is the largest over all. Equal x-vectors count once in the fit, and every row is returned, repeated ones and NULL ids too.
    A fit list of lower rank than ``components`` (one vector, constant dimensions) has fewer components, none without
    variance; an empty table gives no rows. Components of equal eigenvalues are any basis of their space. Entries beyond
    2**50 / 64 count as that. ``deviation`` is NULL where 64 bits do not hold it. Other columns are ignored. Runs jobs while it is built.
    """
    source = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    x = source.mapInArrow(_pack, "vec_id bigint, x binary")
    fit = materialize(x.select("x").distinct(), "fit")
    models = fit_models(fit, components)
    error = identity_error(fit, models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for places, block in _blocks(batch.column(1)):
                model = models[block.shape[1]]
                w = _whitened(model, block)
                k = w.shape[1]
                if not k:
                    continue
                repeated = pa.array(np.repeat(np.arange(len(places)), k))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pa.array(places)).take(repeated), pa.array(np.tile(np.arange(1, k + 1), len(places)), pa.int32()),
                    pa.array(np.full(w.size, model.n), pa.int64()), pa.array(_deviations(model, block), pa.int64()).take(repeated),
                    pa.array(w.ravel()), pa.array(np.tile(model.explained, len(places))),
                ], ["vec_id", "component", "n", "deviation", "whitened", "explained"])

    return x.mapInArrow(run, ROW).withColumn("identity_error", F.lit(error))
