"""Whitening of embeddings by Chebyshev-filtered subspace iteration.

The covariance is never formed. A block of some 32 directions Q goes through passes over the
data, each of which returns XᵀXQ of the centred integer vectors: a task adds up one d x p matrix
over its rows, and matrices of that fixed size are all that travels. Between passes the driver
works on d x p matrices only. The three-term Chebyshev recurrence damps the unwanted end of the
spectrum, QR and Rayleigh-Ritz sharpen the block, and residuals, measured with one more pass,
say when the wanted pairs are done. A second, random block that is kept orthogonal to them then
goes through the same filter: no value above the last wanted one may turn up.

Defined results: vectors that are null, that hold null or non-finite entries, or that have
another length than most vectors (ties: the longer) take no part, nor does an empty table or one
of empty vectors give rows. Repeated rows count, and are returned, as often as they occur. A null
id is kept. Directions without variance are no components, so fewer than ``wanted`` may be
returned. ``deviation`` is null where it does not fit a long. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.llm.common import read
from tapeloom.plans.stage import written

#: Components returned, and directions carried along with them.
WANTED, BLOCK = 8, 32
#: Fixed values of the contract: x = floor(1024 * c) + 100000.
SCALE, SHIFT = 1024, 100_000
#: Highest degree of the filter, and how far it may pull the first direction ahead of the others.
DEGREE, GROWTH = 10, 1e9
#: Lanczos steps for the lower end of the spectrum.
STEPS = 5
#: Residual, in terms of the largest eigenvalue, at which a pair is done.
DONE = 64 * np.finfo(float).eps
#: Sweeps after which the iteration is given up.
SWEEPS = 100
#: Rows a task holds as doubles at once.
ROWS = 4_096
#: Partitions beyond which partial matrices are added up by tasks before they reach the driver.
DIRECT = 256


def _rows_of(column: pa.Array) -> np.ndarray:
    """Equally long lists as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _integers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, ROWS):
            batch = whole.slice(at, ROWS)
            ids, vectors = batch.column(0), batch.column(1).cast(pa.list_(pa.float64()))
            parents, flat = pc.list_parent_indices(vectors), vectors.flatten()
            sound = np.ones(batch.num_rows, bool)
            entries = flat.to_numpy(zero_copy_only=False)  # nulls turn into nan
            sound[parents.to_numpy()[~np.isfinite(entries)]] = False
            sound &= ~np.asarray(vectors.is_null())
            kept = vectors.filter(pa.array(sound))
            values = np.floor(SCALE * kept.flatten().to_numpy(zero_copy_only=False)).astype(np.int64) + SHIFT
            sizes = pc.list_value_length(kept).to_numpy(zero_copy_only=False).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), pa.array(values))
            yield pa.RecordBatch.from_arrays([ids.filter(pa.array(sound)), pa.array(sizes), lists], names=["vec_id", "size", "x"])


@dataclass
class Points:
    """Integer vectors of one length, with their number and sums per dimension."""

    rows: DataFrame
    dimension: int
    count: int
    sums: np.ndarray

    def summed(self, partial: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        """The sum of ``partial(x - mean)`` over all rows, taken some thousand rows at a time."""
        n, sums = self.count, self.sums
        return _summed(self.rows, self.dimension, lambda x: partial(off_mean(x, n, sums) / n), np.float64)

    def times(self, q: np.ndarray) -> np.ndarray:
        """Covariance times ``q``: one pass."""
        return self.summed(lambda x: x.T @ (x @ q)) / self.count


def off_mean(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n x - S, in whole numbers."""
    return n * x - sums


def _summed(rows: DataFrame, dimension: int, partial, dtype) -> np.ndarray:
    """Sum of ``partial(matrix of rows)``; a task gives one array, and the driver a bounded number of them."""
    kind = "bigint" if dtype is np.int64 else "double"

    def over(batches):
        total = None
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = partial(_rows_of(batch.slice(at, ROWS).column(0)))
                total = part if total is None else total + part
        if total is not None:
            yield _one(total, dtype)

    def again(batches):
        total = None
        for batch in batches:
            for part in _rows_of(batch.column(0)) if batch.num_rows else ():
                total = part if total is None else total + part
        if total is not None:
            yield _one(total, dtype)

    parts = rows.select("x").mapInArrow(over, f"part array<{kind}>")
    if rows.rdd.getNumPartitions() > DIRECT:
        parts = parts.repartition(DIRECT // 16).mapInArrow(again, f"part array<{kind}>")
    found = [np.asarray(r.part, dtype) for r in parts.collect()]
    return np.sum(found, axis=0).reshape(partial(np.zeros((0, dimension), np.int64)).shape)


def _one(total: np.ndarray, dtype) -> pa.RecordBatch:
    flat = pa.array(np.asarray(total, dtype).ravel())
    return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat)], names=["part"])


def fit_list(vectors: DataFrame) -> Points | None:
    """The vectors that take part, written once as whole numbers; None if there are none."""
    shaped = written(vectors.select("vec_id", "embedding").mapInArrow(_integers, "vec_id bigint, size int, x array<bigint>"), "points")
    usual = shaped.groupBy("size").agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("size")).first()
    if usual is None or not usual["size"]:
        return None
    rows = shaped.filter(F.col("size") == usual["size"])
    sums = _summed(rows, usual["size"], lambda x: x.sum(axis=0), np.int64)
    return Points(rows, usual["size"], usual.n, sums)


@dataclass
class Pairs:
    """Eigenvalues in falling order, unit eigenvectors as columns, and residual norms."""

    values: np.ndarray
    vectors: np.ndarray
    images: np.ndarray

    @property
    def residuals(self) -> np.ndarray:
        return np.linalg.norm(self.images - self.vectors * self.values, axis=0)


def rayleigh_ritz(times, q: np.ndarray) -> Pairs:
    z = times(q)
    h = q.T @ z
    values, turn = np.linalg.eigh((h + h.T) / 2)
    order = np.argsort(-values)
    return Pairs(values[order], q @ turn[:, order], z @ turn[:, order])


def lower_end(times, q: np.ndarray, steps: int = STEPS) -> float:
    """Below (nearly) all of the spectrum: each column of ``q`` starts a Lanczos run, all in the same passes."""
    before, now, beta = np.zeros_like(q), q, np.zeros(q.shape[1])
    alphas, betas = [], []
    for _ in range(steps):
        w = times(now) - before * beta
        alphas.append((w * now).sum(axis=0))
        w = w - now * alphas[-1]
        beta = np.linalg.norm(w, axis=0)
        betas.append(beta)
        before, now = now, w / np.maximum(beta, np.finfo(float).tiny)
    low = np.inf
    for j in range(q.shape[1]):
        t = np.diag([a[j] for a in alphas]) + np.diag([b[j] for b in betas[:-1]], 1) + np.diag([b[j] for b in betas[:-1]], -1)
        values, turn = np.linalg.eigh(t)
        low = min(low, values[0] - betas[-1][j] * abs(turn[-1, 0]))
    return max(low, 0.0)


def filtered(times, start: Pairs, low: float, high: float, degree: int) -> np.ndarray:
    """The block after a Chebyshev polynomial that is small on [low, high]; its first image is known already."""
    half, middle = (high - low) / 2, (high + low) / 2
    sigma = half / (start.values[0] - middle)
    tau = 2 / sigma
    before, now = start.vectors, (start.images - middle * start.vectors) * (sigma / half)
    for _ in range(degree - 1):
        ahead = 1 / (tau - sigma)
        before, now = now, 2 * (times(now) - middle * now) * (ahead / half) - sigma * ahead * before
        sigma = ahead
    return now


def _degree(top: float, low: float, high: float) -> int:
    """So high that the first direction does not drown the others in rounding."""
    t = (top - (high + low) / 2) / ((high - low) / 2)
    return int(np.clip(np.log(GROWTH) / np.log(t + np.sqrt(t * t - 1)), 2, DEGREE))


def leading_pairs(times, dimension: int, wanted: int = WANTED, block: int = BLOCK, done: float = DONE) -> Pairs:
    """The ``wanted`` leading eigenpairs of the covariance that ``times`` applies, certified.

    Raises if that is not reached: a pair is returned only with a residual at rounding level.
    """
    draw = np.random.default_rng(11)
    size = min(dimension, max(block, wanted + 1))
    q = np.eye(dimension) if size == dimension else np.linalg.qr(draw.standard_normal((dimension, size)))[0]
    low = 0.0 if size == dimension else lower_end(times, q)
    pairs, best, slow, probed = rayleigh_ritz(times, q), np.inf, 0, False
    for _ in range(SWEEPS):
        top = pairs.values[0]
        if top <= 0:
            return Pairs(*(a[..., :0] for a in (pairs.values, pairs.vectors, pairs.images)))
        real = int((pairs.values[:wanted] > dimension * done * top).sum())
        off = pairs.residuals[:real].max() / top
        size = pairs.vectors.shape[1]
        # rounding may leave a residual a little above the aim; more sweeps then change nothing
        settled = off <= done or (off <= 16 * done and off > best / 2)
        whole = size == dimension
        if (settled and (probed or whole)) or (whole and off <= 1e3 * done):
            return Pairs(pairs.values[:real], pairs.vectors[:, :real], pairs.images[:, :real])
        high = max(pairs.values[-1], low + 1e-6 * top)
        slow = slow + 1 if off > best / 4 and not settled else 0
        best = min(best, off)
        if settled and high < pairs.values[real - 1]:
            found = _probe(times, pairs, real, low, high, draw)
            probed = found.values[0] <= pairs.values[real - 1] * (1 + 1e-9)
            if not probed:  # a direction the block had missed
                q = np.linalg.qr(np.column_stack([pairs.vectors[:, :real], found.vectors[:, : size - real]]))[0]
                pairs, best = rayleigh_ritz(times, q), np.inf
            continue
        if slow >= 2 or high >= pairs.values[real - 1]:
            # values too close to the end of the block: a wider one separates them
            more = draw.standard_normal((dimension, min(dimension, 2 * size) - size))
            q, slow = np.linalg.qr(np.column_stack([pairs.vectors, more]))[0], 0
        else:
            q = np.linalg.qr(filtered(times, pairs, low, high, _degree(top, low, high)))[0]
        pairs = rayleigh_ritz(times, q)
    raise ArithmeticError(f"eigenpairs not certified after {SWEEPS} sweeps")


def _probe(times, pairs: Pairs, real: int, low: float, high: float, draw) -> Pairs:
    """What a fresh random block, kept orthogonal to the pairs found, holds after the filter."""
    held = pairs.vectors[:, :real]

    def away(y):
        y = y - held @ (held.T @ y)
        return y - held @ (held.T @ y)

    def rest(y):
        return away(times(y))

    size = min(pairs.vectors.shape[1], held.shape[0] - real)
    q = np.linalg.qr(away(draw.standard_normal((held.shape[0], size))))[0]
    start = Pairs(np.r_[pairs.values[real - 1], np.zeros(size - 1)], q, rest(q))
    return rayleigh_ritz(rest, np.linalg.qr(away(filtered(rest, start, low, high, _degree(pairs.values[real - 1], low, high))))[0])


OUT_DDL = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"


def whitened(vectors: DataFrame, wanted: int = WANTED, block: int = BLOCK) -> DataFrame:
    """A row per vector of ``vectors(vec_id, embedding)`` that takes part and component."""
    points = fit_list(vectors)
    if points is None:
        return vectors.sparkSession.createDataFrame([], OUT_DDL)
    n, sums = points.count, points.sums
    trace = float(points.summed(lambda x: (x * x).sum(axis=0)).sum()) / n
    pairs = leading_pairs(points.times, points.dimension, wanted, block)
    onto = pairs.vectors / np.sqrt(pairs.values)
    k = onto.shape[1]
    if not k:
        return vectors.sparkSession.createDataFrame([], OUT_DDL)

    def gram(x):
        w = x @ onto
        return w.T @ w

    # deviations add up to zero in every dimension, so the projections are centred
    error = float(np.abs(points.summed(gram) / n - np.eye(k)).max())
    explained = pairs.values / trace

    def project(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                off = off_mean(_rows_of(batch.column(1)), n, sums)
                m = len(off)
                yield pa.RecordBatch.from_arrays(
                    [
                        pc.take(batch.column(0), pa.array(np.repeat(np.arange(m), k))),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                        pa.array(np.full(m * k, n)),
                        pc.take(squares(off), pa.array(np.repeat(np.arange(m), k))),
                        pa.array((off / n @ onto).ravel()),
                        pa.array(np.tile(explained, m)),
                        pa.array(np.full(m * k, error)),
                    ],
                    names=[c.split()[0] for c in OUT_DDL.split(", ")],
                )

    return points.rows.select("vec_id", "x").mapInArrow(project, OUT_DDL)


def squares(off: np.ndarray) -> pa.Array:
    """Sum of squares per row, exact; null beyond a long."""
    if len(off) and int(np.abs(off).max()) ** 2 * off.shape[1] >= 2**63:
        exact = (off.astype(object) ** 2).sum(axis=1)
        return pa.array([v if v < 2**63 else None for v in exact], pa.int64())
    return pa.array((off * off).sum(axis=1), pa.int64())


def op11_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitened(read(spark, folder, "embeddings", "vec_id", "embedding"))
