"""Embedding whitening with covariances by polarisation.

Entries become whole numbers x = floor(scale * c) + shift; all that is summed over rows is exact. The model is fitted on each
distinct vector once (n of them).

* Centring. With m the whole number next to a dimension's mean and z = x - m, the distance to the exact mean S / n is
  z - r / n, where r is the sum of z and |r| <= n / 2. Squares are taken of the centred z; what the rest r / n changes is exact:
  n times the sum of (z - r / n) ** 2 is n * sum(z ** 2) - r ** 2.
* Polarisation. These squares are summed for every dimension and for the sum of every pair of dimensions. With variances
  of a, b and a + b, the covariance of a and b is (Var(a + b) - Var(a) - Var(b)) / 2: in whole numbers to the last
  division. Tasks add up numpy integers of 64 bits where they are known not to overflow, else Python's; a task's sums leave it as
  two limbs, so that the sums over tasks are exact too.
* Whitening. The covariance is assembled on the driver (dimensions squared numbers) for ``eigh``. Rows are projected
  on the unit eigenvectors and divided by the root of the eigenvalue. The covariance of the whitened fit list is
  summed once more and held against the identity.

Defined results: a row whose vector is null or empty, or holds a null or an entry that isn't finite, is left out; so is one with
another number of entries than most vectors have (ties: the larger number). Scaled entries beyond 2 ** 60 count as
2 ** 60. Repeated rows count once in the fit and each has its results. A null id is kept. Components without variance (fewer
distinct vectors than dimensions, constant dimensions) have no rows; one distinct vector gives none at all. A deviation that
no long holds is null. Other columns are ignored. No rows give no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 16
FAR = float(1 << 60)
LIMB = 60
ROWS = 2048


@dataclass
class Model:
    n: int
    near: list[int]  # m, the whole number next to each mean
    rest: list[int]  # r, the sum of x - m
    values: np.ndarray  # eigenvalues, falling
    vectors: np.ndarray  # one column per component
    explained: np.ndarray
    identity_error: float = 0.0


def whole(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, x) of the rows whose vector is whole and as long as most are; x: array of longs."""
    rows = df.select(F.col(key).alias("key"), F.col(vector).alias("v")).where(F.col("v").isNotNull())
    rows = rows.where((F.size("v") > 0) & F.forall("v", lambda c: F.coalesce(
        ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")), F.lit(False))))
    usual = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    rows = rows.where(F.size("v") == (usual["d"] if usual else 0))
    scaled = F.transform("v", lambda c: F.floor(F.greatest(F.least(c.cast("double") * SCALE, F.lit(FAR)), F.lit(-FAR))) + SHIFT)
    return rows.select("key", scaled.alias("x"))


def _matrix(column: pa.Array) -> np.ndarray:
    """Arrow lists of one length as rows of a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.empty((0, 0), "int64")


def _centred(x: np.ndarray, near: list[int]) -> np.ndarray:
    """x - m: 64-bit integers, or Python's where a difference needs more."""
    if any(abs(m) >= 1 << 61 for m in near) or (len(x) and max(int(x.max()), -int(x.min())) >= 1 << 61):
        return x.astype(object) - np.array(near, object)
    return x - np.array(near, "int64")


def _limbs(rows: list[tuple]) -> pa.RecordBatch:
    """(i, j, sum) with the sum as high * 2 ** LIMB + low."""
    return pa.RecordBatch.from_arrays([
        pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()),
        pa.array([str(r[2] >> LIMB) for r in rows], pa.string()), pa.array([r[2] & ((1 << LIMB) - 1) for r in rows], pa.int64())],
        ["i", "j", "high", "low"])


def _added(parts: DataFrame) -> dict[tuple[int, int], int]:
    """Exact sums over all tasks, per (i, j): as many as there are dimensions, or pairs of them."""
    sums = parts.groupBy("i", "j").agg(F.sum(F.col("high").cast("decimal(38,0)")).alias("high"), F.sum(F.col("low").cast("decimal(38,0)")).alias("low"))
    return {(r["i"], r["j"]): (int(r["high"]) << LIMB) + int(r["low"]) for r in sums.collect()}


def _exact(total: np.ndarray | None, values: np.ndarray) -> np.ndarray:
    """Running totals as Python integers."""
    return values.astype(object) if total is None else total + values.astype(object)


def column_sums(fit: DataFrame) -> tuple[int, list[int]]:
    """Number of vectors, and the exact sum of each dimension."""
    def run(batches):
        n, total = 0, None
        for batch in batches:
            x = _matrix(batch.column(0))
            for at in range(0, len(x), ROWS):
                part = x[at:at + ROWS]  # 2 ** 61 at most: the low and high halves add up in 64 bits
                n += len(part)
                low, high = (part & ((1 << 32) - 1)).sum(axis=0), (part >> 32).sum(axis=0)
                total = _exact(total, (high.astype(object) * (1 << 32)) + low.astype(object))
        if n:
            yield _limbs([(-1, -1, n), *((i, i, int(v)) for i, v in enumerate(total))])

    found = _added(fit.select("x").mapInArrow(run, "i int, j int, high string, low long"))
    return found.pop((-1, -1), 0), [found[i, i] for i in range(len(found))]


def squares(fit: DataFrame, near: list[int]) -> dict[tuple[int, int], int]:
    """Exact sums of the squares of z_i (i, i) and of z_i + z_j (i, j), with z centred."""
    d = len(near)

    def run(batches):
        total = None
        for batch in batches:
            x = _matrix(batch.column(0))
            for at in range(0, len(x), ROWS):
                z = _centred(x[at:at + ROWS], near)
                if z.dtype != object and max(int(z.max()), -int(z.min())) >= 1 << 25:  # (2 * 2 ** 25) ** 2 * ROWS < 2 ** 63
                    z = z.astype(object)
                one = np.zeros((d, d), dtype=z.dtype)
                for i in range(d):
                    pair = z[:, i:] + z[:, i:i + 1] if i + 1 < d else z[:, i:]
                    pair[:, 0] = z[:, i]
                    one[i, i:] = (pair * pair).sum(axis=0)
                total = _exact(total, one)
        if total is not None:
            yield _limbs([(i, j, int(total[i, j])) for i in range(d) for j in range(i, d)])

    return _added(fit.select("x").mapInArrow(run, "i int, j int, high string, low long"))


def covariance(n: int, rest: list[int], sums: dict[tuple[int, int], int]) -> np.ndarray:
    """Covariance, divisor n: exact whole numbers over n * n, rounded once."""
    d = len(rest)
    spread = {k: n * v - (rest[k[0]] + (rest[k[1]] if k[0] != k[1] else 0)) ** 2 for k, v in sums.items()}
    out = np.empty((d, d))
    for i in range(d):
        for j in range(i, d):
            both = spread[i, i] if i == j else (spread[i, j] - spread[i, i] - spread[j, j]) // 2
            out[i, j] = out[j, i] = both / (n * n)
    return out


def _project(z: np.ndarray, model: Model) -> np.ndarray:
    """Whitened components of centred rows."""
    mean = np.array([r / model.n for r in model.rest])
    return (z.astype("float64") - mean) @ model.vectors / np.sqrt(model.values)


def identity_error(fit: DataFrame, model: Model) -> float:
    """Largest entry of the whitened fit list's covariance minus the identity, without sign."""
    k = len(model.values)

    def run(batches):
        first, second, n = np.zeros(k), np.zeros((k, k)), 0
        for batch in batches:
            x = _matrix(batch.column(0))
            if len(x):
                w = _project(_centred(x, model.near), model)
                first, second, n = first + w.sum(axis=0), second + w.T @ w, n + len(w)
        if n:
            at = [(i, j) for i in range(k) for j in range(i, k)]
            yield pa.RecordBatch.from_arrays([
                pa.array([-1] * k + [i for i, _ in at], pa.int32()), pa.array([*range(k), *(j for _, j in at)], pa.int32()),
                pa.array([*first, *(second[i, j] for i, j in at)], pa.float64())], ["i", "j", "s"])

    sums = fit.select("x").mapInArrow(run, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect()
    found = {(r["i"], r["j"]): r["s"] / model.n for r in sums}
    return max(abs(v - found[-1, i] * found[-1, j] - (i == j)) for (i, j), v in found.items() if i >= 0)


def fit(rows: DataFrame, components: int = COMPONENTS) -> Model | None:
    """The model of the distinct vectors ``x`` of ``rows``; None where none of them has a variance."""
    once = stored(rows.select("x").groupBy("x").agg(F.lit(1).alias("one")).select("x"))
    n, sums = column_sums(once)
    if not n:
        return None
    near = [(2 * s + n) // (2 * n) for s in sums]
    rest = [s - n * m for s, m in zip(sums, near)]
    v = covariance(n, rest, squares(once, near))
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1], vectors[:, ::-1]
    trace = float(np.trace(v))
    real = values > max(values[0], 0.0) * len(values) * np.finfo(float).eps
    keep = np.flatnonzero(real)[:components]
    if not len(keep) or not trace > 0:
        return None
    model = Model(n, near, rest, values[keep], vectors[:, keep], values[keep] / trace)
    model.identity_error = identity_error(once, model)
    return model


def apply(rows: DataFrame, model: Model | None) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error) for each row of ``rows`` and component."""
    kind = rows.schema["key"].dataType.simpleString()
    schema = (f"key {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    if model is None:
        return rows.sparkSession.createDataFrame([], schema)

    def run(batches):
        k, n = len(model.values), model.n
        rest = np.array(model.rest, object)
        for batch in batches:
            if not batch.num_rows:
                continue
            z = _centred(_matrix(batch.column(1)), model.near)
            w = _project(z, model)
            most = int(abs(z).max()) * n + n
            y = z * n - rest.astype("int64") if z.dtype != object and most ** 2 * z.shape[1] < 1 << 63 else z.astype(object) * n - rest
            deviation = [int(v) if v < 1 << 63 else None for v in (y * y).sum(axis=1)]
            rows_ = batch.num_rows
            each = pa.array(np.repeat(np.arange(rows_), k))
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(each), pa.array(np.tile(np.arange(1, k + 1, dtype="int32"), rows_)),
                pa.array(np.full(rows_ * k, n, "int64")), pa.array(deviation, pa.int64()).take(each), pa.array(w.ravel()),
                pa.array(np.tile(model.explained, rows_)), pa.array(np.full(rows_ * k, model.identity_error))],
                ["key", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.select("key", "x").mapInArrow(run, schema)


def whiten(df: DataFrame, key: str, vector: str, components: int = COMPONENTS) -> DataFrame:
    """Fit on the distinct vectors of ``df`` and apply to all its whole rows."""
    rows = whole(df, key, vector)
    return apply(rows, fit(rows, components)).withColumnRenamed("key", key)
