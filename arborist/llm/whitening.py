"""Operator 12: whitening of embeddings by the leading eigenvectors of their covariance.

Entries become integers, so the fit is exact whatever the partitioning. One pass sums the count and the entries of each
dimension. A second centres every vector at the rounded mean and sums the products of the centred entries; each task
multiplies blocks so short that their sums are integers below 2**53, where floating-point products are exact, and Spark adds the
upper triangles up as decimals. What the rounding of the mean left is taken off in exact integers, so no digit is lost to
cancellation. The covariance, dims * dims numbers whatever the number of rows, then goes to the driver: Householder
reflections make it tridiagonal, bisection on Sturm counts finds the leading eigenvalues, and inverse iteration, with
reorthogonalisation within clusters of close eigenvalues, their vectors. The components are broadcast and every row is
projected where it lies.

Cases: vectors that are null or hold null or non-finite entries are dropped; vectors of different lengths are fitted apart, each
length as a table of its own, and empty vectors have no components; repeated rows count each, rows without id too; components
whose eigenvalue is not above ``RANK`` of the largest have no direction to double precision and are left out, so equal
vectors alone give no rows; of equal eigenvalues any orthonormal vectors serve; entries must fit in 62 bits as integers, else an
error is raised; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, table

SCALE, SHIFT = 1024.0, 100000
COMPONENTS = 8
#: An eigenvalue below this part of the largest counts as zero.
RANK = 1e-10
#: Eigenvalues closer than this part of the largest are a cluster, whose vectors are made orthogonal to each other.
CLUSTER = 1e-2
EXACT = 1 << 53
EPS = np.finfo(float).eps


# --- eigenvectors of a symmetric matrix, on the driver ---------------------------------------------------------------


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, off-diagonal and the Householder vectors v_k with H a H' = T for H = H_last ... H_0, H_k = I - 2 v_k v_k'."""
    a, n, reflectors = a.astype(float).copy(), len(a), []
    for k in range(n - 2):
        v = a[k + 1 :, k].copy()
        size = np.linalg.norm(v)
        if size == 0:
            reflectors.append(np.zeros(n - k - 1))
            continue
        v[0] += np.copysign(size, v[0])
        v /= np.linalg.norm(v)
        reflectors.append(v)
        rest = a[k + 1 :, k + 1 :]
        p = rest @ v
        w = p - (p @ v) * v
        rest -= 2 * (np.outer(v, w) + np.outer(w, v))
        a[k + 1 :, k] = 0
        a[k + 1, k] = -np.copysign(size, v[0])
    return np.diag(a).copy(), np.diag(a, -1).copy(), reflectors


def sturm_counts(diagonal: np.ndarray, off: np.ndarray, at: np.ndarray, tiny: float) -> np.ndarray:
    """How many eigenvalues of the tridiagonal matrix lie below each of ``at``: the negative pivots of T - x."""
    counts, pivot = np.zeros(len(at), int), np.ones(len(at))
    for i, d in enumerate(diagonal):
        pivot = d - at - (off[i - 1] ** 2 / pivot if i else 0.0)
        pivot = np.where(np.abs(pivot) < tiny, -tiny, pivot)
        counts += pivot < 0
    return counts


def leading_eigenvalues(diagonal: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The k largest eigenvalues, falling, by bisection down to neighbouring doubles."""
    n = len(diagonal)
    reach = np.abs(np.concatenate([[0.0], off])) + np.abs(np.concatenate([off, [0.0]]))
    size = max(float(np.max(np.abs(diagonal) + reach)), np.finfo(float).tiny)
    low = np.full(k, float(np.min(diagonal - reach)) - size * EPS)
    high = np.full(k, float(np.max(diagonal + reach)) + size * EPS)
    below = n - 1 - np.arange(k)  # the j-th largest has so many eigenvalues below it
    while True:
        middle = low + (high - low) / 2
        if np.all((middle <= low) | (middle >= high) | (high - low <= size * EPS / 4)):
            return middle
        beyond = sturm_counts(diagonal, off, middle, max(size * EPS**2, np.finfo(float).tiny)) > below
        high, low = np.where(beyond, middle, high), np.where(beyond, low, middle)


def _solver(diagonal: np.ndarray, off: np.ndarray, value: float, tiny: float):
    """x -> (T - value)^-1 x by Gaussian elimination with row exchanges; vanishing pivots become ``tiny``."""
    n = len(diagonal)
    a, b, c = diagonal - value, np.append(off, 0.0), np.zeros(n)  # pivot row: a, b, c
    steps = []
    for i in range(n - 1):
        below, nxt, after = off[i], a[i + 1], b[i + 1]
        swap = abs(below) > abs(a[i])
        if swap:
            factor = a[i] / below
            a[i], own, b[i], c[i] = below, b[i], nxt, after
            a[i + 1], b[i + 1] = own - factor * nxt, -factor * after
        else:
            a[i] = a[i] if abs(a[i]) > tiny else tiny
            factor = below / a[i]
            a[i + 1], c[i] = nxt - factor * b[i], 0.0
        steps.append((swap, factor))
    a[-1] = a[-1] if abs(a[-1]) > tiny else tiny

    def solve(x: np.ndarray) -> np.ndarray:
        x = x.copy()
        for i, (swap, factor) in enumerate(steps):
            if swap:
                x[i], x[i + 1] = x[i + 1], x[i]
            x[i + 1] -= factor * x[i]
        for i in range(n - 1, -1, -1):
            x[i] -= (b[i] * x[i + 1] if i + 1 < n else 0.0) + (c[i] * x[i + 2] if i + 2 < n else 0.0)
            x[i] /= a[i]
        return x

    return solve


def tridiagonal_vectors(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors, as rows, of falling eigenvalues: inverse iteration, reorthogonalised within clusters."""
    n, out = len(diagonal), np.zeros((len(values), len(diagonal)))
    size = max(float(np.max(np.abs(diagonal))), float(np.max(np.abs(off), initial=0.0)), np.finfo(float).tiny)
    start, first = np.random.default_rng(12), 0
    for j, value in enumerate(values):
        if j and values[j - 1] - value > CLUSTER * size:
            first = j
        solve, x = _solver(diagonal, off, value, size * EPS), start.standard_normal(n)
        for _ in range(6):
            for _ in range(2):
                x -= out[first:j].T @ (out[first:j] @ x)
            x = solve(x / np.linalg.norm(x))
        for _ in range(2):
            x -= out[first:j].T @ (out[first:j] @ x)
        out[j] = x / np.linalg.norm(x)
    return out


def leading_components(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues of a symmetric matrix, falling, and their unit vectors as rows; those of ``RANK`` or less are left out."""
    diagonal, off, reflectors = tridiagonal(matrix)
    values = leading_eigenvalues(diagonal, off, min(k, len(diagonal)))
    values = values[(values > RANK * values[0]) & (values > 0)]
    vectors = tridiagonal_vectors(diagonal, off, values) if len(values) else np.zeros((0, len(diagonal)))
    for i in range(len(reflectors) - 1, -1, -1):
        v, part = reflectors[i], vectors[:, i + 1 :]
        part -= 2 * np.outer(part @ v, v)
    return values, vectors


# --- passes over the vectors -----------------------------------------------------------------------------------------


def _matrices(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dims, rows, integer entries) of a batch's whole vectors, for each length."""
    column = batch["embedding"]
    sizes = np.asarray(column.value_lengths().fill_null(0))
    values = column.flatten().cast(pa.float64())
    flat = np.asarray(values.fill_null(float("nan")))
    first = np.concatenate([[0], np.cumsum(sizes)])
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
    whole = bad[first[1:]] == bad[first[:-1]]
    for dims in np.unique(sizes[whole & (sizes > 0)]).tolist():
        rows = np.flatnonzero(whole & (sizes == dims))
        x = np.floor(SCALE * flat[first[rows][:, None] + np.arange(dims)])
        if np.abs(x).max() >= 2.0**61:
            raise ValueError("an entry of a vector doesn't fit in 62 bits as an integer")
        yield dims, rows, x.astype(np.int64) + SHIFT


def _exact(x: np.ndarray, n: int) -> np.ndarray:
    """x as Python integers where a product with n might not fit in 63 bits."""
    return x if not len(x) or int(np.abs(x).max()) * n < 1 << 62 else x.astype(object)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: dict[int, list] = {}
    for batch in batches:
        for dims, rows, x in _matrices(batch):
            n, sums = found.get(dims, (0, 0))
            found[dims] = n + len(rows), sums + _exact(x, len(x)).sum(0).astype(object)
    for dims, (n, sums) in found.items():
        columns = [pa.array([dims] * dims, pa.int32()), pa.array(range(dims), pa.int32()), pa.array([n] * dims, pa.int64()), pa.array([Decimal(int(s)) for s in sums], pa.decimal128(38, 0))]
        yield pa.RecordBatch.from_arrays(columns, ["dims", "i", "n", "s"])


def exact_products(c: np.ndarray) -> np.ndarray:
    """c'c of integers as Python integers."""
    most = max(1, int(np.abs(c).max(initial=0)))
    rows = EXACT // (most * most)
    if rows < 1:
        c = c.astype(object)
        return c.T @ c
    total = np.zeros((c.shape[1], c.shape[1]), object)
    for k in range(0, len(c), rows):
        block = c[k : k + rows].astype(float)
        total += (block.T @ block).astype(np.int64)
    return total


def _products(middle):
    """Sums of products of the entries less ``middle``, a broadcast {dims: integers}: the upper triangle, once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            for dims, _, x in _matrices(batch):
                found[dims] = found.get(dims, 0) + exact_products(x - np.array(middle.value[dims]))
        for dims, total in found.items():
            i, j = np.triu_indices(dims)
            columns = [pa.array(np.full(len(i), dims, np.int32)), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array([Decimal(int(p)) for p in total[i, j]], pa.decimal128(38, 0))]
            yield pa.RecordBatch.from_arrays(columns, ["dims", "i", "j", "p"])

    return run


def _project(models):
    """Whitened coordinates of every row by a broadcast {dims: (n, sums, vectors, values)}."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dims, rows, x in _matrices(batch):
                n, sums, vectors, values = models.value[dims]
                off = _exact(x, n) * n - (np.array(sums) if max(map(abs, sums)) < 1 << 62 else np.array(sums, object))
                white = (off / n).astype(float) @ vectors.T / np.sqrt(values)
                if off.dtype == object or int(np.abs(off).max()) ** 2 * dims >= 1 << 62:
                    deviation = pa.array([Decimal(sum(int(e) ** 2 for e in row)) for row in off], pa.decimal128(38, 0))
                else:
                    deviation = pa.array((off * off).sum(1)).cast(pa.decimal128(38, 0))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * len(values)), pa.array(white.ravel()))
                yield pa.RecordBatch.from_arrays([batch["vec_id"].take(pa.array(rows)), pa.array(np.full(len(rows), dims, np.int32)), deviation, lists], ["vec_id", "dims", "deviation", "w"])

    return run


def fit(vectors: DataFrame, k: int = COMPONENTS) -> dict[int, tuple]:
    """{dims: (n, sums, components as rows, eigenvalues, trace of the covariance)} of vectors (vec_id, embedding)."""
    spark = vectors.sparkSession
    sums: dict[int, dict] = {}
    for r in vectors.mapInArrow(_sums, "dims int, i int, n long, s decimal(38,0)").groupBy("dims", "i").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect():
        sums.setdefault(r["dims"], {})[r["i"]] = (r["n"], int(r["s"]))
    of = {dims: (s[0][0], [s[i][1] for i in range(dims)]) for dims, s in sums.items()}
    middle = spark.sparkContext.broadcast({dims: [(2 * s + n) // (2 * n) for s in all_] for dims, (n, all_) in of.items()})
    products = vectors.mapInArrow(_products(middle), "dims int, i int, j int, p decimal(38,0)").groupBy("dims", "i", "j").agg(F.sum("p").alias("p"))
    matrices = {dims: np.zeros((dims, dims)) for dims in of}
    for r in products.collect():
        dims, i, j = r["dims"], r["i"], r["j"]
        n, all_ = of[dims]
        rest = [all_[e] - n * middle.value[dims][e] for e in (i, j)]
        matrices[dims][i, j] = matrices[dims][j, i] = (n * int(r["p"]) - rest[0] * rest[1]) / (n * n)
    out = {}
    for dims, v in matrices.items():
        values, components = leading_components(v, k)
        out[dims] = (*of[dims], components, values, float(np.trace(v)))
    return out


def whiten(vectors: DataFrame, k: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each whole vector and component.

    ``deviation`` is a decimal(38,0), n * n times the squared distance from the mean. ``identity_error`` is the largest absolute entry of
    the whitened columns' covariance less the identity.
    """
    spark = vectors.sparkSession
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    models = fit(vectors, k)
    shared = spark.sparkContext.broadcast({dims: m[:4] for dims, m in models.items()})
    rows = materialise(vectors.mapInArrow(_project(shared), "vec_id long, dims int, deviation decimal(38,0), w array<double>"))
    most = max((len(m[3]) for m in models.values()), default=0)
    pairs = [(a, b) for a in range(most) for b in range(a, most)]
    entry = lambda e: F.get("w", F.lit(e))
    # a length with fewer components has nulls, whose covariance is null and not counted
    errors = [F.abs(F.covar_pop(entry(a), entry(b)) - F.lit(float(a == b))) for a, b in pairs]
    error = {r["dims"]: r["e"] for r in rows.groupBy("dims").agg(F.array_max(F.array(*errors)).alias("e")).collect()} if pairs else {}
    stats = [(dims, c + 1, m[0], float(v) / m[4], error[dims]) for dims, m in models.items() for c, v in enumerate(m[3])]
    stats = spark.createDataFrame(stats, "dims int, component int, n long, explained double, identity_error double")
    long = rows.select("vec_id", "dims", "deviation", F.posexplode("w").alias("at", "whitened")).withColumn("component", F.col("at") + 1)
    # at most ``k`` rows for each length of vectors
    out = long.join(F.broadcast(stats), ["dims", "component"])
    return out.select("vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error")


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened embeddings; deviations that don't fit in a long raise an error."""
    return whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding")).withColumn("deviation", F.col("deviation").cast("long"))
