"""Whitening of embeddings by a polarisation covariance: variances only, the cross-covariances are differences of them.

Entries become whole numbers, so every sum is exact.  For each dimension, and for the sum of each pair of dimensions, the
squares of centred values are added up; cov(i, j) is half of var(i + j) - var(i) - var(j).  A value is centred on the whole
part of its mean before it is squared, which keeps squares small; what is left of the mean, r / n, is taken off exactly:
the sum of (n x - S)^2 is n^2 sum(y^2) - n r^2 for y = x - floor(S / n) and r = S - n floor(S / n).

Tasks send a row for each dimension and pair; the driver gets one number each (dimensions squared, whatever the number
of rows), assembles the matrix and takes its eigenvectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradebook.llm.common import stored

SCALE, SHIFT = 64, 1_000_000  # an entry c is floor(SCALE * c) + SHIFT
COMPONENTS = 16
NO_SPREAD = 1e-11  # components with less of the trace than this hold rounding only
_SAFE = 1 << 62
_ROWS = 2048


class Whitener(NamedTuple):
    n: int
    sums: list[int]  # S per dimension
    axes: np.ndarray  # a unit eigenvector a row, by falling eigenvalue
    values: np.ndarray
    explained: np.ndarray


def whole_numbers(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, x): rows whose vector is null or holds null or non-finite entries are dropped.

    Vectors of another length than most (of several, the longer) can't be compared and are dropped too, as are empty ones.
    """
    e = F.col(embedding).cast("array<double>")
    odd = F.exists(e, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    rows = vectors.where(e.isNotNull() & (F.size(e) > 0) & ~F.coalesce(odd, F.lit(False)))
    lengths = rows.groupBy(F.size(e).alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    rows = rows.where(F.size(e) == (lengths[0]["n"] if lengths else 0))
    return rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.transform(e, _whole).alias("x"))


def _whole(c: Column) -> Column:
    # beyond a long's range the largest that leaves room for the shift
    big = float(1 << 61)
    return F.floor(F.greatest(F.least(c * SCALE, F.lit(big)), F.lit(-big))).cast("long") + SHIFT


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, _ROWS):
            yield b.slice(at, _ROWS)


def _centred(x: np.ndarray, centre: np.ndarray, factor: int = 2) -> np.ndarray:
    """x less the centre; Python's own integers where squares of ``factor`` times it, added up, would leave a long."""
    lo, hi = x.min(axis=0), x.max(axis=0)
    most = max(max(abs(int(a) - c), abs(int(b) - c)) for a, b, c in zip(lo, hi, centre.tolist(), strict=True))
    if len(x) * (factor * most) ** 2 < _SAFE:
        return x - centre
    return x.astype(object) - centre.astype(object)


def _squares(fit: DataFrame, centre: np.ndarray) -> dict[tuple[int, int], int]:
    """Exact sums of squares: (i, i) of dimension i, (i, j) of the sum of dimensions i and j; values centred first."""
    dims = len(centre)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [[0] * (dims - i) for i in range(dims)]
        for b in _slices(batches):
            y = _centred(_matrix(b.column(0), dims), centre)
            for i in range(dims):
                z = y[:, i:].copy()
                z[:, 1:] += y[:, i : i + 1]
                sums[i] = [s + int(q) for s, q in zip(sums[i], (z * z).sum(axis=0).tolist(), strict=True)]
        at = [(i, i + k, s) for i, row in enumerate(sums) for k, s in enumerate(row)]
        # in two halves, so that a sum of any size is added up exactly
        high, low = [s >> 40 for *_, s in at], [s & ((1 << 40) - 1) for *_, s in at]
        yield pa.RecordBatch.from_arrays(
            [pa.array([a[0] for a in at], pa.int32()), pa.array([a[1] for a in at], pa.int32()), pa.array(map(str, high), pa.string()), pa.array(low, pa.int64())],
            ["i", "j", "high", "low"],
        )

    parts = fit.select("x").mapInArrow(work, "i int, j int, high string, low long")
    added = parts.groupBy("i", "j").agg(F.sum(F.col("high").cast("decimal(38,0)")).alias("high"), F.sum(F.col("low").cast("decimal(38,0)")).alias("low"))
    return {(r["i"], r["j"]): (int(r["high"]) << 40) + int(r["low"]) for r in added.toLocalIterator()}


def _sums(fit: DataFrame) -> tuple[int, list[int]]:
    """Number of vectors and sum of each dimension."""
    got = fit.select(F.posexplode("x").alias("d", "v")).groupBy("d").agg(F.count("*").alias("n"), F.sum(F.col("v").cast("decimal(38,0)")).alias("s"))
    by = {r["d"]: r for r in got.toLocalIterator()}
    return (by[0]["n"], [int(by[d]["s"]) for d in range(len(by))]) if by else (0, [])


def fitted(fit: DataFrame, components: int = COMPONENTS) -> Whitener | None:
    """The whitener of distinct vectors ``fit`` (x); None where nothing spreads."""
    n, sums = _sums(fit)
    if n == 0:
        return None
    dims = len(sums)
    centre = np.array([s // n for s in sums], np.int64)
    left = [s - n * (s // n) for s in sums]
    squares = _squares(fit, centre)
    # n^2 times the sums of squares about the mean, exactly, for a dimension and for a sum of two
    about = {(i, j): n * n * q - n * (left[i] + (left[j] if i != j else 0)) ** 2 for (i, j), q in squares.items()}
    v = np.zeros((dims, dims))
    for (i, j), q in about.items():
        twice = 2 * q if i == j else q - about[i, i] - about[j, j]
        v[i, j] = v[j, i] = float(Fraction(twice, 2 * n**3))
    values, axes = np.linalg.eigh(v)
    trace = float(np.trace(v))
    order = [k for k in np.argsort(-values, kind="stable")[:components] if trace > 0 and values[k] > NO_SPREAD * trace]
    if not order:
        return None
    axes = axes[:, order].T
    axes *= np.where(np.take_along_axis(axes, np.abs(axes).argmax(axis=1)[:, None], 1) < 0, -1.0, 1.0)  # largest entry positive
    return Whitener(n, sums, np.ascontiguousarray(axes), values[order], values[order] / trace)


def _projector(w: Whitener):
    """Function from whole numbers to whitened components; the mean's whole part is taken off before any rounding."""
    centre = np.array([s // w.n for s in w.sums], np.int64)
    rest = np.array([(s % w.n) / w.n for s in w.sums])
    scaled = w.axes / np.sqrt(w.values)[:, None]
    return lambda x: ((x - centre).astype(np.float64) - rest) @ scaled.T


def identity_error(fit: DataFrame, w: Whitener) -> float:
    """Largest absolute entry of the covariance of the whitened fit list minus the identity, measured on its rows."""
    k, dims = len(w.values), len(w.sums)
    project = _projector(w)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k + 1))
        for b in _slices(batches):
            p = project(_matrix(b.column(0), dims))
            p = np.hstack([p, np.ones((len(p), 1))])
            total += p.T @ p
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()), pa.array(total.ravel())], ["i", "j", "s"])

    m = np.zeros((k + 1, k + 1))
    for r in fit.select("x").mapInArrow(work, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).toLocalIterator():
        m[r["i"], r["j"]] = r["s"]
    mean = m[k, :k] / w.n
    return round(float(np.abs(m[:k, :k] / w.n - np.outer(mean, mean) - np.eye(k)).max()), 9)


SCORED = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """A row per remaining vector and component.

    The whitener is fitted on each distinct vector of whole numbers once.  ``n`` is their number, ``deviation`` the exact
    sum over dimensions of (n x - S)^2 (null beyond a long), ``whitened`` the centred vector on the component over the root
    of its eigenvalue, ``explained`` the eigenvalue's share of the trace, ``identity_error`` one value for all.

    Null ids stay null, repeated rows give repeated rows, other columns are ignored.  Components without spread are left
    out: no rows, one distinct vector or vectors that are all alike give no rows.  Which vectors are dropped: see
    ``whole_numbers``.
    """
    rows = stored(whole_numbers(vectors, vec_id, embedding), "whitening-rows")
    fit = stored(rows.select("x").distinct(), "whitening-fit")
    w = fitted(fit, components)
    if w is None:
        return rows.sparkSession.createDataFrame([], SCORED)
    error, project, k, dims = identity_error(fit, w), _projector(w), len(w.values), len(w.sums)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, rest = np.array([s // w.n for s in w.sums], np.int64), np.array([s % w.n for s in w.sums], np.int64)
        for b in _slices(batches):
            x = _matrix(b.column(1), dims)
            y = _centred(x, centre)
            widest = (max(abs(int(y.min())), abs(int(y.max()))) + 1) * w.n
            z = (y if dims * widest**2 < _SAFE else y.astype(object)) * w.n - rest
            far = [int(d) if d < 1 << 63 else None for d in (z * z).sum(axis=1).tolist()]
            m = len(x)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0).take(pa.array(np.repeat(np.arange(m), k))), pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()),
                    pa.array(np.full(m * k, w.n), pa.int64()), pa.array(far, pa.int64()).take(pa.array(np.repeat(np.arange(m), k))),
                    pa.array(project(x).ravel()), pa.array(np.tile(w.explained, m)), pa.array(np.full(m * k, error)),
                ],
                [c.split()[0] for c in SCORED.split(", ")],
            )

    return rows.mapInArrow(work, SCORED)
