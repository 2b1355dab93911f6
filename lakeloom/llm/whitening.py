"""Embedding whitening: the leading components of the integer vectors by matrix-free block subspace iteration.

Each entry c becomes x = floor(64 c) + OFFSET. The fit list is each distinct x vector once, written as packed
numbers. A pass over it gives n and the exact sums S of its dimensions. Each further pass computes X'(XQ) for a block
Q of directions, rows centred before they are multiplied; the covariance itself is never formed. A pass's block is
made orthogonal to those before it (QR) and joins their span, whose images are all known, so Rayleigh-Ritz over the
whole span costs no pass of its own. The next block is the residuals of the leading Ritz vectors, until those of all k
certify (RESIDUAL of the largest eigenvalue). A span that would grow beyond BASIS is cut to its leading Ritz vectors.
The last pass multiplies the vectors found once more and measures their residuals and the whitened covariance.

What a task holds is some rows and d times the block's width; what reaches the driver is d times that width, summed
by Spark over the tasks, and n and S. A vector that a third of all rows hold is one row before the shuffle.

Defined cases: rows are dropped whose vector is null, empty, holds a null or non-finite entry or one that is no exact
number after the scaling (64 |c| from 2 to the 53), or has another length than most distinct vectors (of equal counts
the longer). Rows without a vec_id and repeated rows are whitened like others, but a vector counts once in the fit.
Components of eigenvalue zero (fewer distinct vectors than dimensions, one vector alone) can't be whitened and are
left; no vectors give no rows. A deviation beyond a long is null. Other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.llm.common import read, small_batches, written

SCALE, OFFSET, K = 64, 1_000_000, 16
#: Directions of a pass, times k; and how many the kept span holds at most, times the pass.
WIDER, SPANS = 2, 8
#: A component is certified when |Vu - eu| is at most so much of the largest eigenvalue; passes until then.
RESIDUAL, PASSES = 1e-13, 400
#: Eigenvalues under so much of the largest are zero.
NOTHING = 1e-12
ROWS = 4096


def scaled(column: pa.Array) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """The rows of a batch whose vectors are whole and finite; and for each length its x, a matrix in order of the rows."""
    wide = column.cast(pa.list_(pa.float64()))
    lengths = wide.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = wide.flatten().to_numpy(zero_copy_only=False) * SCALE  # a null entry becomes NaN
    with np.errstate(invalid="ignore"):
        good = np.isfinite(values) & (np.abs(values) < 2.0**53)
    ends = np.cumsum(lengths)
    bad = np.r_[0, np.cumsum(~good)]
    whole = (lengths > 0) & (bad[ends] == bad[ends - lengths])
    out = []
    for d in np.unique(lengths[whole]).tolist():
        at = np.flatnonzero(whole & (lengths == d))
        cells = (ends[at] - d)[:, None] + np.arange(d)
        out.append((d, at, np.floor(values[cells]).astype(np.int64) + OFFSET))
    return np.flatnonzero(whole), out


def packed(rows: DataFrame, vector: str) -> DataFrame:
    """d, x (the numbers' bytes) for each whole vector of rows."""

    def each(batches):
        for batch in batches:
            for d, _, x in scaled(batch.column(0))[1]:
                data = pa.array([r.tobytes() for r in x.astype("<i8")], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), d, np.int32)), data], names=["d", "x"])

    return rows.select(F.col(vector).cast("array<double>").alias("v")).mapInArrow(each, "d int, x binary")


def matrices(batches, d: int):
    """The packed vectors of batches as matrices of some thousand rows."""
    for batch in batches:
        for i in range(0, batch.num_rows, ROWS):
            some = batch.column(0).slice(i, ROWS)
            yield np.frombuffer(b"".join(some.to_pylist()), "<i8").reshape(-1, d)


def totals(fit: DataFrame, per_task, n: int, kind: str) -> np.ndarray:
    """The sum over all tasks of the n numbers that per_task(batches) gives for one."""

    def each(batches):
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n, dtype=np.int32)), pa.array(per_task(batches))], names=["at", "v"])

    summed = fit.select("x").mapInArrow(each, f"at int, v {kind}").groupBy("at").agg(F.sum("v").alias("v"))
    out = np.zeros(n, np.int64 if kind == "long" else np.float64)
    for r in summed.toLocalIterator():  # n rows: the width of a block times the dimensions
        out[r["at"]] = r["v"]
    return out


@dataclass
class Whitening:
    """What is fitted: distinct vectors n, sums of their dimensions, unit components (a row each), eigenvalues, shares, error."""

    d: int
    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    explained: np.ndarray
    residuals: np.ndarray
    identity_error: float
    passes: int

    def parts(self) -> tuple[np.ndarray, np.ndarray]:
        """The means' nearest whole numbers, and what the sums hold beyond n times those."""
        near = [(2 * s + self.n) // (2 * self.n) for s in self.sums]
        return np.array(near, np.int64), np.array([s - self.n * m for s, m in zip(self.sums, near, strict=True)], np.int64)


def centred(x: np.ndarray, near: np.ndarray, rest: np.ndarray, n: int) -> np.ndarray:
    """x - S/n, each entry rounded once."""
    return (x - near).astype(np.float64) - rest / n


def deviations(x: np.ndarray, near: np.ndarray, rest: np.ndarray, n: int) -> pa.Array:
    """The sum over dimensions of (nx - S)^2, exactly; null beyond a long."""
    about = ((n * (x - near).astype(np.float64) - rest) ** 2).sum(axis=1)
    y = n * (x - near) - rest
    exact = (y * y).sum(axis=1)
    over = np.flatnonzero(about > 2.0**62)
    out = pa.array(exact, mask=about > 2.0**62)
    if not len(over):
        return out
    whole = out.to_pylist()
    for i in over.tolist():
        v = sum((n * (int(a) - int(m)) - int(r)) ** 2 for a, m, r in zip(x[i], near, rest, strict=True))
        whole[i] = v if v < 1 << 63 else None
    return pa.array(whole, pa.int64())


def fit(rows: DataFrame, vector: str = "embedding", k: int = K) -> Whitening | None:
    """The whitening of rows' vectors to k components at most; None if there are none."""
    spark = rows.sparkSession
    small_batches(spark)
    every = written(packed(rows, vector).distinct(), "vectors")
    sizes = every.groupBy("d").count().orderBy(F.desc("count"), F.desc("d")).head(1)
    if not sizes:
        return None
    d, n = sizes[0]["d"], sizes[0]["count"]
    fitted = every.where(F.col("d") == d)

    def sums_of(batches):  # halves, so that no sum can overflow
        out = np.zeros(2 * d, np.int64)
        for x in matrices(batches, d):
            out[:d] += (x >> 26).sum(axis=0)
            out[d:] += (x & (1 << 26) - 1).sum(axis=0)
        return out

    halves = totals(fitted, sums_of, 2 * d, "long")
    sums = [(int(a) << 26) + int(b) for a, b in zip(halves[:d], halves[d:], strict=True)]
    model = Whitening(d, n, sums, np.zeros((0, d)), np.zeros(0), np.zeros(0), np.zeros(0), 0.0, 0)
    near, rest = model.parts()

    def image(q: np.ndarray) -> tuple[np.ndarray, float]:
        """VQ, and the trace of V: one pass."""
        width = q.shape[1]

        def one(batches):
            out, square = np.zeros((d, width)), 0.0
            for x in matrices(batches, d):
                c = centred(x, near, rest, n)
                out += c.T @ (c @ q)
                square += float((c * c).sum())
            return np.r_[out.ravel(), square]

        found = totals(fitted, one, d * width + 1, "double") / n
        model.passes += 1
        return found[:-1].reshape(d, width), float(found[-1])

    width = min(d, WIDER * k)
    q = np.linalg.qr(np.random.default_rng(13).standard_normal((d, width)))[0]
    basis, images = np.zeros((d, 0)), np.zeros((d, 0))
    for _ in range(PASSES):
        aq, trace = image(q)
        basis, images = np.c_[basis, q], np.c_[images, aq]
        inner = basis.T @ images
        values, turn = np.linalg.eigh((inner + inner.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        u, au = basis @ turn, images @ turn
        away = au[:, :width] - u[:, :width] * values[:width]
        far = np.linalg.norm(away[:, :k], axis=0)
        if basis.shape[1] == d or (far <= RESIDUAL * max(values[0], 0.0)).all():
            break
        if basis.shape[1] + width > SPANS * width:
            basis, images = u[:, :width], au[:, :width]
        q = _beyond(basis, away)
        if not q.shape[1]:
            break
    found = np.linalg.qr(u[:, : min(k, d)])[0]
    for _ in range(3):  # the vectors themselves once more, and what rounding left in them is turned out
        again, trace = image(found)
        inner = found.T @ again
        values, turn = np.linalg.eigh((inner + inner.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        far = np.linalg.norm(again @ turn - (found @ turn) * values, axis=0)
        found = found @ turn
        if (far <= 10 * RESIDUAL * max(values[0], 0.0)).all():
            break
    if trace > 0 and far.max() > 1e-9 * values[0]:
        raise ArithmeticError(f"components are certified to {far.max() / values[0]:.1e} of the largest eigenvalue only")
    real = values > NOTHING * max(values[0], 0.0) if trace > 0 else np.zeros(len(values), bool)
    model.components, model.eigenvalues, model.residuals = found[:, real].T.copy(), values[real], far[real]
    if trace > 0:
        model.explained = model.eigenvalues / trace
    size = len(model.eigenvalues)
    if size:
        model.identity_error = _identity_error(fitted, model, near, rest)
    return model


def _beyond(basis: np.ndarray, block: np.ndarray) -> np.ndarray:
    """Orthonormal directions of block that basis doesn't span, at most as many as are left."""
    norms = np.linalg.norm(block, axis=0)
    block = block[:, norms > 0] / norms[norms > 0]
    for _ in range(2):
        block = block - basis @ (basis.T @ block)
    left, sizes, _ = np.linalg.svd(block, full_matrices=False)
    q = left[:, sizes > 1e-8][:, : basis.shape[0] - basis.shape[1]]
    q = q - basis @ (basis.T @ q)
    return np.linalg.qr(q)[0] if q.shape[1] else q


def _identity_error(fitted: DataFrame, model: Whitening, near: np.ndarray, rest: np.ndarray) -> float:
    """The largest absolute entry of the covariance of the whitened fit list, minus the identity."""
    d, n, size = model.d, model.n, len(model.eigenvalues)
    turn = (model.components / np.sqrt(model.eigenvalues)[:, None]).T

    def one(batches):
        square, line = np.zeros((size, size)), np.zeros(size)
        for x in matrices(batches, d):
            z = centred(x, near, rest, n) @ turn
            square += z.T @ z
            line += z.sum(axis=0)
        return np.r_[square.ravel(), line]

    found = totals(fitted, one, size * size + size, "double") / n
    mean = found[size * size :]
    return float(np.abs(found[: size * size].reshape(size, size) - np.outer(mean, mean) - np.eye(size)).max())


RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def transform(rows: DataFrame, model: Whitening | None, vector: str = "embedding", name: str = "vec_id") -> DataFrame:
    """A row for each whole vector of rows and component: see RESULT."""
    spark = rows.sparkSession
    if model is None or not len(model.eigenvalues):
        return spark.createDataFrame([], RESULT)
    near, rest = model.parts()
    size, d, n = len(model.eigenvalues), model.d, model.n
    turn = (model.components / np.sqrt(model.eigenvalues)[:, None]).T
    explained, error = model.explained, model.identity_error

    def each(batches):
        for batch in batches:
            for length, at, x in scaled(batch.column(1))[1]:
                if length != d:
                    continue
                many = len(at)
                z = centred(x, near, rest, n) @ turn
                ids = batch.column(0).take(pa.array(np.repeat(at, size)))
                apart = deviations(x, near, rest, n).take(pa.array(np.repeat(np.arange(many), size)))
                components = pa.array(np.tile(np.arange(1, size + 1, dtype=np.int32), many))
                yield pa.RecordBatch.from_arrays(
                    [ids, components, pa.array(np.full(many * size, n)), apart, pa.array(z.ravel()), pa.array(np.tile(explained, many)), pa.array(np.full(many * size, error))],
                    names=[f.split(" ")[0] for f in RESULT.split(", ")],
                )

    return rows.select(F.col(name).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v")).mapInArrow(each, RESULT)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings")
    return transform(rows, fit(rows))
