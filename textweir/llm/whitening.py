"""Embedding whitening: components of the covariance by QDWH spectral divide and conquer.

The covariance is summed by partition and added up by Spark; only its numbers (the square of the
dimension) come to the driver. There polar decompositions of the shifted matrix give projectors on
the subspaces above and below the shift; the matrix is split along them until single components
are left. These go back to the tasks with the means, and every row is whitened where it is.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import drop_saved, saved

#: The fixed-point form of an entry: floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 1024, 100_000
#: Entries from here on are out of range. Below it, the sum of a batch is a long.
LIMIT = 1 << 40
#: Rows whose arrays a task holds at once.
BATCH = 4_096


def polar(a: np.ndarray) -> np.ndarray:
    """The orthogonal factor of a nonsingular symmetric matrix by the dynamically weighted Halley iteration."""
    eye = np.eye(len(a))
    x = a / np.linalg.norm(a)
    # a lower bound of the smallest singular value; one that is too small costs a round
    low = max(1.0 / (np.linalg.norm(np.linalg.pinv(x)) * 1.1), np.finfo(float).eps)
    for _ in range(30):
        l2 = min(low * low, 1.0)
        d = (4.0 * (1.0 - l2) / (l2 * l2)) ** (1 / 3)
        root = np.sqrt(1.0 + d)
        f = root + np.sqrt(8.0 - 4.0 * d + 8.0 * (2.0 - l2) / (l2 * root)) / 2.0
        g = (f - 1.0) ** 2 / 4.0
        h = f + g - 1.0
        if h > 100:  # inverse-free
            q, _ = np.linalg.qr(np.concatenate((np.sqrt(h) * x, eye)))
            new = g / h * x + (f - g / h) / np.sqrt(h) * (q[:len(a)] @ q[len(a):].T)
        else:
            new = g / h * x + (f - g / h) * np.linalg.solve(eye + h * (x.T @ x), x.T).T
        new = (new + new.T) / 2
        low = min(low * (f + g * l2) / (1.0 + h * l2), 1.0)
        change, x = np.linalg.norm(new - x), new
        if change < 1e-12 * np.sqrt(len(a)) and 1.0 - low < 1e-8:
            break
    return x


def _split(a: np.ndarray, scale: float) -> tuple[np.ndarray, np.ndarray] | None:
    """Orthonormal bases of the invariant subspaces above and below a shift; None if ``a`` is a multiple of the identity."""
    n = len(a)
    mean = np.trace(a) / n
    spread = np.linalg.norm(a - mean * np.eye(n))
    if spread <= 1e-15 * scale * n:
        return None
    rng = np.random.default_rng(0)
    best = None
    # some eigenvalue lies above the mean and some below; the median splits more evenly, if it splits
    for shift in (np.median(np.diag(a)), mean, *(mean + spread / n * rng.uniform(-0.1, 0.1, 8))):
        moved = a - shift * np.eye(n)
        if np.linalg.norm(moved) == 0:
            continue
        projector = (polar(moved) + np.eye(n)) / 2
        k = int(round(np.trace(projector)))
        if not 0 < k < n:
            continue
        start = rng.standard_normal((n, n))
        q, _ = np.linalg.qr(np.concatenate((projector @ start[:, :k], start[:, k:] - projector @ start[:, k:]), axis=1))
        # once more from bases that lie in the subspaces almost wholly
        q, _ = np.linalg.qr(np.concatenate((projector @ q[:, :k], q[:, k:] - projector @ q[:, k:]), axis=1))
        off = np.linalg.norm(q[:, k:].T @ a @ q[:, :k])
        if best is None or off < best[0]:
            best = off, q, k
        if off <= 1e-14 * scale * n:
            break
    if best is None:
        raise np.linalg.LinAlgError("no shift splits the matrix")
    return best[1][:, :best[2]], best[1][:, best[2]:]


def spectral(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix."""
    scale = float(np.linalg.norm(a))
    parts, todo = [], [np.eye(len(a))]
    while todo:
        basis = todo.pop()
        inner = basis.T @ a @ basis
        halves = _split((inner + inner.T) / 2, scale) if basis.shape[1] > 1 and scale else None
        if halves is None:
            parts.append(basis)
        else:
            todo += [basis @ h for h in halves]
    v = np.concatenate(parts, axis=1) if parts else np.zeros((0, 0))
    for _ in range(2):  # what is left off the diagonal, to first order
        v, _ = np.linalg.qr(v)
        b = v.T @ a @ v
        gap = np.diag(b)[None] - np.diag(b)[:, None]
        apart = np.abs(gap) > 1e-8 * scale
        v = v + v @ np.where(apart, b / np.where(apart, gap, 1.0), 0.0)
    v, _ = np.linalg.qr(v)
    values = np.einsum("ij,ij->j", v, a @ v)
    order = np.argsort(-values, kind="stable")
    return values[order], v[:, order]


def _batches(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for whole in batches:
        for low in range(0, whole.num_rows, BATCH):
            batch = whole.slice(low, BATCH)
            yield batch, batch.column("x").flatten().to_numpy().reshape(batch.num_rows, size)


def _sums(rows: DataFrame, size: int) -> list[int]:
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * size
        for _, x in _batches(batches, size):  # below 2**50 each: a batch does not overflow
            total = [a + b for a, b in zip(total, x.sum(axis=0).tolist())]
        yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), pa.array(map(Decimal, total), pa.decimal128(38, 0))],
                                         names=["i", "s"])

    parts = rows.mapInArrow(add, "i int, s decimal(38,0)")
    found = {r["i"]: int(r["s"]) for r in parts.groupBy("i").agg(F.sum("s").alias("s")).collect()}
    return [found[i] for i in range(size)]


def _products(rows: DataFrame, made, width: int, size: int) -> np.ndarray:
    """The sum over ``rows`` of the outer product of ``made(x)``, a ``width`` of numbers, with itself."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for _, x in _batches(batches, size):
            y = made(x)
            total += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))],
                                         names=["i", "row"])

    cells = (rows.mapInArrow(add, "i int, row array<double>").select("i", F.posexplode("row").alias("j", "v"))
             .groupBy("i", "j").agg(F.sum("v").alias("v")))
    out = np.zeros((width, width))
    for r in cells.collect():  # the square of the dimension
        out[r["i"], r["j"]] = r["v"]
    return out


def _fixed_point(vectors: DataFrame, column: str) -> DataFrame:
    """(vec_id, x) of the rows that are not dropped."""
    good = F.forall("c", lambda e: F.coalesce(F.abs(e) < F.lit(float(LIMIT)), F.lit(False)))  # NaN is larger than any number
    return (vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col(column).cast("array<double>").alias("c"))
            .filter(F.col("c").isNotNull() & (F.size("c") > 0) & good)
            .select("vec_id", F.transform("c", lambda e: F.floor(e * F.lit(float(SCALE))).cast("bigint") + F.lit(SHIFT)).alias("x")))


SCHEMA = ("vec_id bigint, n bigint, deviation bigint, whitened array<double>, explained array<double>, "
          "identity_error double")


def whiten(vectors: DataFrame, components: int = 8, column: str = "embedding") -> DataFrame:
    """One row per usable row of ``vectors`` (vec_id, embedding): vec_id, n, deviation, whitened, explained, identity_error.

    Dropped are rows whose vector is null or empty, holds a null or non-finite entry or one of 2**40 or
    more, or has another length than most (of equally many, the longest). All others are fitted, also those that
    repeat a vec_id or have none. ``whitened`` is the row's x - mean on each of the first
    ``components`` eigenvectors of the covariance, over the root of the eigenvalue; null on one whose eigenvalue is zero
    (to rounding, of the largest). ``explained`` are the shares of the trace, null if it is zero;
    ``identity_error`` is measured on all whitened rows, null without a component; ``deviation``
    is exact, null where it is no long. An empty table gives no rows. Other columns are ignored.
    """
    rows = saved(_fixed_point(vectors, column), "fixed-point")
    sizes = rows.groupBy(F.size("x").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    if sizes is None:
        drop_saved(rows)
        return vectors.sparkSession.createDataFrame([], SCHEMA)
    size, n = sizes["size"], sizes["count"]
    rows = rows.filter(F.size("x") == size)
    sums = _sums(rows, size)
    whole = np.array([s // n for s in sums], np.int64)
    part = np.array([(s % n) / n for s in sums])

    def centred(x: np.ndarray) -> np.ndarray:
        return (x - whole) - part

    covariance = _products(rows, centred, size, size) / n
    values, basis = spectral((covariance + covariance.T) / 2)
    values, basis = values[:components], basis[:, :components]
    trace = float(np.trace(covariance))
    live = values > size * np.finfo(float).eps * max(float(values[0]), 0.0)
    scaled = basis[:, live] / np.sqrt(values[live])
    count = int(live.sum())
    error = None
    if count:
        # the rows were centred before they were projected
        error = float(np.abs(_products(rows, lambda x: centred(x) @ scaled, count, size) / n - np.eye(count)).max())
    shares = [float(v) / trace if trace > 0 else None for v in values]
    held = np.flatnonzero(live)
    wrapped = np.array([(s + (1 << 63)) % (1 << 64) - (1 << 63) for s in sums], np.int64)
    most = 2.0**63 * (1 - 1e-9)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x in _batches(batches, size):
            d = centred(x)
            with np.errstate(over="ignore"):
                deviation = ((x * np.int64(n) - wrapped) ** 2).sum(axis=1)  # exact modulo 2**64
            fits = (d * d).sum(axis=1) * float(n) ** 2 < most
            out = np.zeros((len(d), len(values)))
            out[:, held] = d @ scaled
            flat = pa.array(out.reshape(-1), mask=np.tile(~live, len(d)))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(d) + 1) * len(values), pa.int32()), flat)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array(np.full(len(d), n)), pa.array(deviation, mask=~fits), lists,
                 pa.array([shares] * len(d), pa.list_(pa.float64())), pa.array([error] * len(d), pa.float64())],
                names=["vec_id", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(project, SCHEMA)
