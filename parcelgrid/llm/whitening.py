"""Whitening of embeddings by Chebyshev-filtered subspace iteration.

The covariance V of the fit list is never formed: every product VQ is one pass over the vectors, Xᵀ(XQ)/n with X centred
before it is multiplied.  A polynomial in V, applied to a block of directions by the three-term Chebyshev recurrence, damps the
part of the spectrum that is not wanted; the block is then made orthonormal (QR) and turned to the best approximations
within it (Rayleigh-Ritz).  This goes on until the residuals of the wanted components certify them.  Only blocks of dimensions x
directions leave the executors, merged in groups before the driver adds them up.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelgrid.llm.common import save

MERGE = 256  # partial sums that one task adds up
SPREAD = 1e10  # how much more the filter may stretch the first wanted direction than the last of the block
RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, residual double"


@dataclass
class Fit:
    n: int
    sums: np.ndarray        # per dimension, exact
    components: np.ndarray  # dimensions x components, unit columns
    values: np.ndarray      # their eigenvalues, falling
    trace: float
    residual: float         # largest |Vq - eq| of them, relative to the first eigenvalue
    passes: int


def quantized(df: DataFrame, vector: str = "embedding", scale: float = 256.0) -> DataFrame:
    """Usable rows with their vectors as whole numbers in column `x`.

    Vectors that are null or empty or hold null or non-finite entries are left out; so are those of another length than most
    (ties: the longer one), as they have no place in the same space.
    """
    sound: Column = F.col(vector).isNotNull() & F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = df.filter(sound & (F.size(vector) > 0)).withColumn("x", F.transform(vector, lambda c: F.floor(F.lit(scale) * c.cast("double"))))
    sizes = rows.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).agg(F.max(F.struct("n", "d")).alias("most")).first()
    return rows.filter(F.size("x") == (sizes["most"]["d"] if sizes["most"] else 0))


def matrices(batches):
    for batch in batches:
        column = batch.column("x")
        if len(column):
            yield batch, column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def summed(df: DataFrame, part, shape: tuple[int, ...], dtype) -> np.ndarray:
    """Sum of `part(x)`, an array of `shape`, over all batches of vectors; each task adds up its own, groups of tasks are merged."""
    def run(batches):
        total = np.zeros(shape, dtype)
        for _, x in matrices(batches):
            total += part(x)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["part"])

    def merge(table: pa.Table) -> pa.Table:
        total = np.zeros(shape, dtype)
        for part_ in table.sort_by("at").column("part"):
            total += np.frombuffer(part_.as_py(), dtype).reshape(shape)
        return pa.table({"part": pa.array([total.tobytes()], pa.binary())})

    parts = df.select("x").mapInArrow(run, "part binary")
    tasks = df.rdd.getNumPartitions()
    while tasks > MERGE:
        tasks = -(-tasks // MERGE)
        at = F.monotonically_increasing_id()
        parts = (parts.select("part", at.alias("at")).withColumn("group", F.hash("at") % tasks)
                 .groupBy("group").applyInArrow(merge, "part binary"))
    total = np.zeros(shape, dtype)
    for row in parts.collect():  # at most MERGE blocks
        total += np.frombuffer(row["part"], dtype).reshape(shape)
    return total


def lower_bound(product, d: int, steps: int, rng) -> float:
    """A bound below the spectrum from a few Lanczos steps: the least Ritz value less the norm of the last residual."""
    q, before, beta, alphas, betas = rng.standard_normal(d), np.zeros(d), 0.0, [], []
    q /= np.linalg.norm(q)
    for _ in range(min(steps, d)):
        w = product(q[:, None])[:, 0] - beta * before
        alphas.append(float(w @ q))
        w -= alphas[-1] * q
        beta = float(np.linalg.norm(w))
        if beta <= 1e-12 * abs(alphas[0]):
            break
        betas.append(beta)
        before, q = q, w / beta
    inner = betas[:len(alphas) - 1]
    ritz = np.linalg.eigvalsh(np.diag(alphas) + np.diag(inner, 1) + np.diag(inner, -1))
    return max(0.0, float(ritz[0]) - (betas[-1] if betas else 0.0))


def fit(x: DataFrame, components: int = 4, guard: int = 28, tolerance: float = 1e-13, rounds: int = 60, seed: int = 7) -> Fit | None:
    """Leading eigenvectors of the covariance (divisor n) of the rows of `x`, each one vector; None without rows.

    Components whose eigenvalue is nothing but rounding are left out.
    """
    first = x.select("x").limit(1).first()
    if first is None:
        return None
    d, passes = len(first["x"]), 1
    counts = summed(x, lambda m: np.append(m.sum(axis=0), len(m)), (d + 1,), np.int64)
    sums, n = counts[:-1], int(counts[-1])
    mean = sums / n

    def product(q: np.ndarray) -> np.ndarray:
        nonlocal passes
        passes += 1

        def part(m):
            c = m - mean
            return c.T @ (c @ q)

        return summed(x, part, q.shape, np.float64) / n

    passes += 1
    trace = float(summed(x, lambda m: np.square(m - mean).sum(keepdims=True).ravel(), (1,), np.float64)[0]) / n
    wanted, rng = min(components, d), np.random.default_rng(seed)
    k = min(d, components + guard)
    q = np.linalg.qr(rng.standard_normal((d, k)))[0]
    low = lower_bound(product, d, 6, rng) if k < d else 0.0
    best = None
    for _ in range(rounds):
        w = product(q)
        theta, turn = np.linalg.eigh((q.T @ w + w.T @ q) / 2)
        theta, turn = theta[::-1], turn[:, ::-1]
        q, w = q @ turn, w @ turn
        residual = float(np.linalg.norm(w[:, :wanted] - q[:, :wanted] * theta[:wanted], axis=0).max() / max(theta[0], 1e-300))
        done = best is not None and best.residual <= 1e-9 and residual > best.residual / 2  # rounding is reached
        if best is None or residual < best.residual:
            best = Fit(n, sums, q[:, :wanted].copy(), theta[:wanted].copy(), trace, residual, passes)
        if residual <= tolerance or k == d or theta[0] <= 0 or done:
            break
        top = float(theta[-1])
        if top <= low:  # the bound was none: directions below it have grown
            low = max(0.0, 2 * top - float(theta[0]))
        centre, half = (top + low) / 2, max((top - low) / 2, 1e-9 * float(theta[0]))
        stretch = np.arccosh(max(1.0 + 1e-12, (float(theta[0]) - centre) / half))
        degree = int(np.clip(np.log(SPREAD) / stretch, 2, 12))
        previous, current = q, (w - centre * q) / half
        for _ in range(degree - 1):
            previous, current = current, 2 / half * (product(current) - centre * current) - previous
            size = np.linalg.norm(current, axis=0)
            previous, current = previous / size, current / size
        q = np.linalg.qr(current)[0]
    best.passes = passes
    solid = best.values > 1e-12 * max(trace, 1e-300)
    best.components, best.values = best.components[:, solid], best.values[solid]
    return best


def projected(m: np.ndarray, found: Fit) -> np.ndarray:
    return (m - found.sums / found.n) @ found.components / np.sqrt(found.values)


def identity_error(x: DataFrame, found: Fit) -> float:
    """Largest entry of the whitened vectors' covariance less the identity, from the vectors themselves."""
    k = len(found.values)
    mean = summed(x, lambda m: projected(m, found).sum(axis=0), (k,), np.float64) / found.n

    def part(m):
        c = projected(m, found) - mean
        return c.T @ c

    return float(np.abs(summed(x, part, (k, k), np.float64) / found.n - np.eye(k)).max()) if k else 0.0


def deviations(m: np.ndarray, found: Fit) -> list[int | None]:
    """Sum over dimensions of (n*x - S)^2, exact; null where it does not fit a long."""
    reach = max(abs(found.n * int(m.max()) - int(found.sums.min())), abs(found.n * int(m.min()) - int(found.sums.max())))
    if reach * reach * m.shape[1] < 2 ** 63:
        return np.square(found.n * m - found.sums).sum(axis=1).tolist()
    exact = [sum((found.n * int(v) - int(s)) ** 2 for v, s in zip(row, found.sums)) for row in m]
    return [v if v < 2 ** 63 else None for v in exact]


def whiten(df: DataFrame, components: int = 4, vector: str = "embedding", **settings) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error, residual for each usable row and component.

    The fit list holds each distinct vector once, so repeated rows weigh nothing extra but all come out, as do rows with a null id.
    Fewer components come out where the vectors span fewer directions; none where all vectors are equal or there are none.
    """
    rows = quantized(df, vector).select(F.col("vec_id").cast("long"), "x")
    distinct = save(rows.select("x").distinct(), "whitening_fit")
    found = fit(distinct, components, **settings)
    if found is None:
        return df.sparkSession.createDataFrame([], RESULT)
    error, k = identity_error(distinct, found), len(found.values)

    def run(batches):
        for batch, m in matrices(batches):
            white, far = projected(m, found), deviations(m, found)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id").take(pa.array(np.repeat(np.arange(len(m)), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(m))),
                 pa.array(np.full(len(m) * k, found.n, np.int64)), pa.array(far, pa.int64()).take(pa.array(np.repeat(np.arange(len(m)), k))),
                 pa.array(white.ravel()), pa.array(np.tile(found.values / found.trace, len(m))), pa.array(np.full(len(m) * k, error)),
                 pa.array(np.full(len(m) * k, found.residual))],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error", "residual"])

    return rows.mapInArrow(run, RESULT)
