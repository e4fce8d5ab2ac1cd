"""Whitening of embeddings: exact distributed sums, centred covariance, leading eigenvectors, broadcast projection.

The covariance is a square of the dimension's size, whatever the number of rows; its eigenvectors are found on the driver by
Householder tridiagonalisation, bisection on Sturm counts for the leading eigenvalues, and inverse iteration, where
vectors of close eigenvalues are made orthogonal to each other."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .base import forget, saved

EPS = np.finfo(float).eps
SHIFT, SCALE = 1_000_000, 64
#: Partial sums of about so many tasks are added before the last sum.
FAN = 64


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, subdiagonal and reflectors of a symmetric matrix; reflector k acts on the rows after k."""
    a = np.array(matrix, float)
    n = len(a)
    reflectors = []
    for k in range(n - 2):
        v = a[k + 1 :, k].copy()
        size = np.sqrt(v @ v)
        v[0] += size if v[0] >= 0 else -size
        norm = np.sqrt(v @ v)
        v = v / norm if norm > 0 else v
        reflectors.append(v)
        rest = a[k + 1 :, k + 1 :]
        p = 2 * (rest @ v)
        w = p - (p @ v) * v
        rest -= np.outer(v, w) + np.outer(w, v)
        side = a[k + 1 :, k]
        side -= 2 * (side @ v) * v
        a[k, k + 1 :] = side
    return np.diag(a).copy(), np.diag(a, -1).copy(), reflectors


def sturm_counts(diagonal: np.ndarray, below: np.ndarray, points: np.ndarray) -> np.ndarray:
    """The number of eigenvalues under each point: signs of the ratios of the characteristic polynomials."""
    least = np.finfo(float).tiny + EPS * np.abs(below).max(initial=0.0) ** 2 * EPS
    count = np.zeros(len(points), np.int64)
    q = np.ones(len(points))
    for k, d in enumerate(diagonal):
        q = d - points - (below[k - 1] ** 2 / q if k else 0.0)
        q = np.where(np.abs(q) < least, -least, q)
        count += q < 0
    return count


def leading_eigenvalues(diagonal: np.ndarray, below: np.ndarray, count: int) -> np.ndarray:
    """The `count` largest eigenvalues, falling, by bisection to the last bit that the counts resolve."""
    n = len(diagonal)
    reach = np.zeros(n)
    reach[1:] += np.abs(below)
    reach[:-1] += np.abs(below)
    lo = np.full(count, (diagonal - reach).min())
    hi = np.full(count, (diagonal + reach).max())
    wanted = n - np.arange(count)  # of the k-th largest value, n - k values are below
    size = max(abs(lo[0]), abs(hi[0]))
    hi += EPS * size + sys.float_info.min
    for _ in range(200):
        mid = (lo + hi) / 2
        if ((mid == lo) | (mid == hi)).all():
            break
        under = sturm_counts(diagonal, below, mid) >= wanted
        hi, lo = np.where(under, mid, hi), np.where(under, lo, mid)
    return (lo + hi) / 2


def _solved(diagonal: np.ndarray, below: np.ndarray, shift: float, right: np.ndarray) -> np.ndarray:
    """The tridiagonal matrix less shift, solved by elimination with row exchanges; tiny pivots are replaced."""
    n = len(diagonal)
    rows = np.zeros((n, 3))  # diagonal, first and second above
    rows[:, 0] = diagonal - shift
    rows[:-1, 1] = below
    b = right.copy()
    low = below.copy()
    tiny = EPS * max(np.abs(diagonal).max() + 2 * np.abs(below).max(initial=0.0), sys.float_info.min)
    for k in range(n - 1):
        nxt = np.array([low[k], rows[k + 1, 0], rows[k + 1, 1]])
        if abs(nxt[0]) > abs(rows[k, 0]):
            rows[k], nxt = nxt, rows[k].copy()
            b[k], b[k + 1] = b[k + 1], b[k]
        if abs(rows[k, 0]) < tiny:
            rows[k, 0] = tiny
        f = nxt[0] / rows[k, 0]
        rows[k + 1, 0], rows[k + 1, 1] = nxt[1] - f * rows[k, 1], nxt[2] - f * rows[k, 2]
        b[k + 1] -= f * b[k]
    if abs(rows[-1, 0]) < tiny:
        rows[-1, 0] = tiny
    x = np.zeros(n)
    for k in range(n - 1, -1, -1):
        x[k] = (b[k] - (rows[k, 1] * x[k + 1] if k + 1 < n else 0) - (rows[k, 2] * x[k + 2] if k + 2 < n else 0)) / rows[k, 0]
        if abs(x[k]) > 1e150:  # only the direction counts
            x, b = x / abs(x[k]), b / abs(x[k])
    return x


def eigenvectors(matrix: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The `count` largest eigenvalues of a symmetric matrix, falling, and unit eigenvectors as rows."""
    n = len(matrix)
    scale = np.abs(matrix).max(initial=0.0)
    if scale == 0:
        return np.zeros(count), np.eye(n)[:count]
    diagonal, below, reflectors = tridiagonal(matrix / scale)
    values = leading_eigenvalues(diagonal, below, count)
    norm = np.abs(values).max()
    close = 1e-3 * max(norm, EPS)
    vectors = np.zeros((count, n))
    rng = np.random.default_rng(7)  # starting vectors; the result does not depend on them but for its sign
    first = 0
    for k, value in enumerate(values):
        if k and values[k - 1] - value > close:
            first = k  # a new cluster
        near = values[first:k]
        shift = value - EPS * norm * np.count_nonzero(np.abs(near - value) < 8 * EPS * norm)
        v = rng.standard_normal(n)
        for _ in range(5):
            v = _solved(diagonal, below, shift, v / np.linalg.norm(v))
            v /= np.linalg.norm(v)
            for _ in range(2):  # twice is enough
                v -= (vectors[first:k] @ v) @ vectors[first:k]
            v /= np.linalg.norm(v)
        vectors[k] = v
    for k in range(len(reflectors) - 1, -1, -1):
        part = vectors[:, k + 1 :]
        part -= 2 * np.outer(part @ reflectors[k], reflectors[k])
    for k in range(count):  # back-transformed vectors of far values lose no more than rounding; take that back too
        vectors[k] -= (vectors[:k] @ vectors[k]) @ vectors[:k]
        vectors[k] /= np.linalg.norm(vectors[k])
    return values * scale, vectors


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _added(parts: DataFrame, kind: str) -> dict[int, np.ndarray]:
    """Sum of the parts (row, part, vector) of each row, over FAN tasks a row and then over those."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            if batch.num_rows:
                for k, v in zip(batch.column(0).to_pylist(), _matrix(batch.column(2)), strict=True):
                    sums[k] = sums[k] + v if k in sums else v.copy()
        for k, v in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([0], pa.int32()), pa.array([v.tolist()], pa.list_(pa.int64() if kind == "long" else pa.float64()))], names=["row", "part", "vector"])

    schema = f"row int, part int, vector array<{kind}>"
    once = parts.repartition("row", "part").mapInArrow(run, schema)
    return {r.row: np.array(r.vector) for r in once.repartition("row").mapInArrow(run, schema).collect()}  # a row for each dimension


def _parts(rows: DataFrame, kind: str, work) -> DataFrame:
    """(row, part, vector) of each task: work(matrix of a batch) gives a matrix, and a task's are added up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = None
        for batch in batches:
            if batch.num_rows:
                own = work(_matrix(batch.column(0)))
                total = own if total is None else total + own
        if total is not None:
            n = len(total)
            item = pa.int64() if kind == "long" else pa.float64()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(n, dtype=np.int32)), pa.array(np.full(n, TaskContext.get().partitionId() % FAN, np.int32)), pa.array(total.tolist(), pa.list_(item))], names=["row", "part", "vector"])

    return rows.mapInArrow(run, f"row int, part int, vector array<{kind}>")


def _square(vectors: DataFrame, mean: np.ndarray) -> np.ndarray:
    """The sum of the outer products of the rows less the mean."""
    found = _added(_parts(vectors, "double", lambda x: (c := x - mean).T @ c), "double")
    return np.array([found[k] for k in range(len(mean))])


def integral(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id, x: the usable vectors with their entries as integers, floor(64 c) + 1 000 000."""
    finite = F.forall(vector_col, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < 1e15))
    x = F.transform(F.col(vector_col), lambda c: (F.floor(c.cast("double") * SCALE) + SHIFT).cast("long"))
    return vectors.filter(F.col(vector_col).isNotNull() & (F.size(vector_col) > 0) & finite).select(F.col(id_col).cast("long").alias("id"), x.alias("x"))


WHITE = pa.schema([("id", pa.int64()), ("deviation", pa.int64()), ("white", pa.list_(pa.float64()))])


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 32) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each usable vector and component.

    Entries are taken as whole 64ths (x); V is the covariance of x over all usable vectors (divisor n, centred before
    multiplying). Components are unit eigenvectors of V by falling eigenvalue e, of either sign; whitened is the centred x
    on the component over sqrt(e), explained e over V's trace, identity_error the largest absolute entry of whitened's
    covariance less the identity, deviation the exact sum of (n x - S) squared over dimensions (null where a long does not
    hold it). Null vectors, empty ones and those with null or non-finite entries are dropped, as are those of another
    length than most (of ties the longer). There are no more components than dimensions, and none whose eigenvalue is zero
    to rounding, for it cannot be whitened: equal vectors alone give no rows, as does an empty table. Rows that repeat come
    back as often as they stand, null ids as null. Other columns are ignored, whatever their names."""
    rows = saved(integral(vectors, id_col, vector_col), "integral")
    lengths = rows.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not lengths:
        return rows.sparkSession.createDataFrame([], schema)
    d, n = lengths[0]
    used = rows.filter(F.size("x") == d)
    sums = _added(_parts(used.select("x"), "long", lambda x: x.sum(axis=0)[:, None]), "long")
    total = np.array([int(sums[k][0]) for k in range(d)], dtype=object)
    mean = np.array([int(s) / n for s in total])
    whole = np.array([int(s) // n for s in total], np.int64)  # x less this is small and exact
    rest = np.array([(int(s) - int(w) * n) / n for s, w in zip(total, whole, strict=True)])
    covariance = _square(used.select(F.col("x")), mean) / n
    trace = float(np.trace(covariance))
    values, axes = eigenvectors(covariance, min(components, d))
    real = values > max(values.max(), 0.0) * d * EPS * 8
    values, axes = values[real], axes[real]
    if not len(values):
        return rows.sparkSession.createDataFrame([], schema)
    project = (axes / np.sqrt(values)[:, None]).T
    remainder = np.array([int(s) - int(w) * n for s, w in zip(total, whole, strict=True)], dtype=np.int64)
    widest = 2**62 // max(1, d)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(1)) - whole
            if float(np.abs(x).max() + 1) * n < widest**0.5:
                deviation = ((x * n - remainder) ** 2).sum(axis=1).tolist()
            else:  # in whole numbers of any size
                deviation = [sum((int(c) * n - int(r)) ** 2 for c, r in zip(row, remainder, strict=True)) for row in x]
                deviation = [v if v < 2**63 else None for v in deviation]
            white = (x - rest) @ project
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(deviation, pa.int64()), pa.array(white.tolist(), pa.list_(pa.float64()))], schema=WHITE)

    white = saved(used.mapInArrow(run, "id long, deviation long, white array<double>"), "white")
    forget(rows)
    k = len(values)
    found = _added(_parts(white.select("white"), "double", lambda w: np.vstack([w.T @ w, w.sum(axis=0)[None, :]])), "double")
    centre = found[k] / n
    error = float(np.abs(np.array([found[j] for j in range(k)]) / n - np.outer(centre, centre) - np.eye(k)).max())
    explained = F.element_at(F.array(*[F.lit(float(v / trace)) for v in values]), F.col("component"))
    long = white.select(F.col("id").alias("vec_id"), "deviation", F.posexplode("white").alias("k", "whitened")).withColumn("component", F.col("k") + 1)
    return long.select("vec_id", "component", F.lit(n).cast("long").alias("n"), "deviation", "whitened", explained.alias("explained"), F.lit(error).alias("identity_error"))
