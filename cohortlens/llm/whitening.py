"""Whitening of embeddings by FEAST contour integration.

Entries become integers (256 a unit), so first and second moments are exact sums, the same under any partitioning.  Two
passes over the distinct vectors give sums per dimension, then products of vectors centred at the nearest integer of
the mean; the remainder of less than one half is taken off in integers too.  What reaches the driver is one
number per pair of dimensions.

The wanted end of the spectrum is cut into intervals by inertia counts (signs of a pivoted LDL' of the shifted covariance).
Each interval is solved in a Spark task of its own: complex shifted solves at the points of a Gauss quadrature
round the interval project a random block onto its eigenvectors, Rayleigh-Ritz extracts them, and both repeat until
the residual is at rounding level.  The number found must equal the inertia count of the interval, else
the block grows and the solve is repeated; an interval that never agrees stops the run.

Defined cases: rows whose vector is null or has null or non-finite entries are left out; vectors of another length than
the most frequent one (the longer of ties), also empty ones, are left out too; a null id is kept; repeated rows
are scored each but counted once in the fit; directions without variance give no component, so fewer than
asked may come back, and none for one distinct vector; an empty table gives an empty result; other columns are
not looked at.  Entries beyond 2^55 saturate in the integer conversion.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.runtime import materialise

UNIT = 256
COMPONENTS = 4
NODES = 8  # quadrature points on the upper half of the circle
PER_INTERVAL = 16  # components that one interval may hold before it is split
_DECIMAL = pa.decimal128(38, 0)
_SAFE = float(1 << 62)


# ---- exact moments -------------------------------------------------------------------------------

def quantised(vectors: DataFrame, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """``key`` and the integer vector ``x`` of the rows that can be used."""
    entry = F.col(vector)
    finite = F.forall(entry, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    whole = F.transform(entry, lambda c: F.floor(c.cast("double") * UNIT))
    usable = vectors.where(entry.isNotNull() & finite).select(key, whole.alias("x"))
    lengths = usable.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    usual = lengths.where("d > 0").orderBy(F.col("n").desc(), F.col("d").desc()).first()
    return usable.where(F.size("x") == (usual["d"] if usual else -1))


def _matrices(batches: Iterator[pa.RecordBatch], name: str = "x") -> Iterator[np.ndarray]:
    for batch in batches:
        if batch.num_rows:
            column = batch.column(batch.schema.get_field_index(name))
            yield column.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def _exact(x: np.ndarray) -> np.ndarray:
    return x.astype(object)


def _sums(fit: DataFrame) -> tuple[int, list[int]]:
    """Rows and sums per dimension."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, 0
        for x in _matrices(batches):
            small = float(np.abs(x.astype(np.float64)).max()) * len(x) < _SAFE
            n, total = n + len(x), total + _exact(x.sum(axis=0) if small else _exact(x).sum(axis=0))
        if n:
            values = [n, *total]
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(-1, len(values) - 1), pa.int32()), pa.array([Decimal(int(v)) for v in values], _DECIMAL)], ["i", "total"]
            )

    found = fit.select("x").mapInArrow(run, "i int, total decimal(38,0)").groupBy("i").agg(F.sum("total")).collect()
    by_place = {r[0]: int(r[1]) for r in found}
    return by_place.get(-1, 0), [by_place[i] for i in range(len(by_place) - 1)] if by_place else []


def _products(fit: DataFrame, middle: list[int]) -> dict[tuple[int, int], int]:
    """Sums of products of every pair of dimensions, centred at ``middle`` before multiplying."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre = np.array(middle, dtype=object)
        near = max((abs(m) for m in middle), default=0)
        d = len(middle)
        total, held, bound = np.zeros((d, d), dtype=object), np.zeros((d, d), dtype=np.int64), 0.0
        for x in _matrices(batches):
            peak = float(np.abs(x.astype(np.float64)).max())
            if peak + near < _SAFE:
                z = x - centre.astype(np.int64)
                peak = float(np.abs(z).max())
                if peak * peak * len(z) < float(1 << 53):  # then products and their sums are exact in doubles
                    if bound + peak * peak * len(z) > _SAFE:
                        total, held, bound = total + _exact(held), np.zeros((d, d), dtype=np.int64), 0.0
                    f = z.astype(np.float64)
                    held += (f.T @ f).astype(np.int64)
                    bound += peak * peak * len(z)
                    continue
            z = _exact(x) - centre
            total = total + z.T.dot(z)
        total = total + _exact(held)
        i, j = np.triu_indices(d)
        yield pa.RecordBatch.from_arrays(
            [pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array([Decimal(int(v)) for v in total[i, j]], _DECIMAL)],
            ["i", "j", "total"],
        )

    rows = fit.select("x").mapInArrow(run, "i int, j int, total decimal(38,0)")
    return {(r[0], r[1]): int(r[2]) for r in rows.groupBy("i", "j").agg(F.sum("total")).collect()}


def covariance(fit: DataFrame) -> tuple[int, list[int], np.ndarray]:
    """Rows, sums and covariance (divisor n); every entry of it is rounded once, from exact integers."""
    n, sums = _sums(fit)
    if not n:
        return 0, [], np.zeros((0, 0))
    middle = [(2 * s + n) // (2 * n) for s in sums]
    off = [s - n * m for s, m in zip(sums, middle, strict=True)]
    v = np.zeros((len(sums), len(sums)))
    for (i, j), total in _products(fit, middle).items():
        v[i, j] = v[j, i] = (n * total - off[i] * off[j]) / (n * n)
    return n, sums, v


# ---- eigenpairs ----------------------------------------------------------------------------------

def above(a: np.ndarray, shift: float) -> int:
    """Number of eigenvalues above ``shift``: positive pivots of LDL' with diagonal pivoting (Bunch-Kaufman)."""
    a = a - shift * np.eye(len(a))
    alpha, count = (1 + 17 ** 0.5) / 8, 0
    while len(a):
        first = np.abs(a[1:, 0])
        r = int(first.argmax()) + 1 if len(first) else 0
        most = float(first.max()) if len(first) else 0.0
        if most == 0 or abs(a[0, 0]) >= alpha * most:
            pair = False
        else:
            column = np.abs(a[:, r])
            column[r] = 0
            sigma = float(column.max())
            if abs(a[0, 0]) * sigma >= alpha * most * most:
                pair = False
            else:
                pair = abs(a[r, r]) < alpha * sigma
                at = 1 if pair else 0
                a[[at, r]] = a[[r, at]]
                a[:, [at, r]] = a[:, [r, at]]
        if pair:
            block, side = a[:2, :2], a[2:, :2]
            count += 1  # the chosen 2 x 2 blocks are indefinite: one pivot of each sign
            a = a[2:, 2:] - side @ np.linalg.solve(block, side.T)
        else:
            pivot, side = a[0, 0], a[1:, 0]
            count += bool(pivot > 0)
            a = a[1:, 1:] - np.outer(side, side / pivot) if pivot else a[1:, 1:]
        a = (a + a.T) / 2
    return count


def intervals(a: np.ndarray, wanted: int, most: int = PER_INTERVAL) -> list[tuple[float, float, int]]:
    """Intervals (low, high, eigenvalues inside) that hold at least the ``wanted`` largest positive eigenvalues."""
    top = float(np.abs(a).sum(axis=1).max()) * 1.0001
    floor = len(a) * np.finfo(float).eps * top * 8  # below it an eigenvalue cannot be told from zero
    wanted = min(wanted, above(a, floor))
    if not wanted:
        return []

    def cut(low: float, high: float, count: int) -> float:
        """A place between eigenvalue number ``count`` from the top and the next smaller one, or below a tie."""
        while high - low > 1e-12 * top:
            mid = (low + high) / 2
            n = above(a, mid)
            if n == count:
                return _widen(mid, low, high, count)
            low, high = (mid, high) if n > count else (low, mid)
        return low

    def _widen(inside: float, low: float, high: float, count: int) -> float:
        left, right = [low, inside], [inside, high]
        for _ in range(8):  # towards the middle of the gap, where the contour converges best
            mid = sum(left) / 2
            left = [left[0], mid] if above(a, mid) == count else [mid, left[1]]
            mid = sum(right) / 2
            right = [mid, right[1]] if above(a, mid) == count else [right[0], mid]
        return (left[1] + right[0]) / 2

    out, high, done = [], top, 0
    while done < wanted:
        goal = min(done + most, wanted)
        low = floor if above(a, floor) == goal else cut(floor, high, goal)
        n = above(a, low)
        out.append((float(low), float(high), n - done))
        high, done = low, n
    return out


def feast(a: np.ndarray, low: float, high: float, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and unit eigenvectors of symmetric ``a`` inside (low, high], ``count`` of them."""
    d, eps = len(a), np.finfo(float).eps
    nodes, weights = np.polynomial.legendre.leggauss(NODES)
    turns = np.exp(0.5j * np.pi * (nodes + 1))
    middle, radius = (low + high) / 2, (high - low) / 2
    scale = float(np.abs(a).max())
    for block in sorted({min(d, w) for w in (count + count // 2 + 8, 2 * count + 24, d)}):
        y = np.random.default_rng(block).standard_normal((d, block))
        best = None
        for _ in range(40):
            q = np.zeros((d, block))
            for turn, weight in zip(turns, weights, strict=True):
                z = middle + radius * turn
                q += weight * radius / 2 * (turn * np.linalg.solve(z * np.eye(d) - a, y.astype(complex))).real
            q, _r = np.linalg.qr(q)
            values, u = np.linalg.eigh(q.T @ a @ q)  # Rayleigh-Ritz on the projected block
            y = q @ u
            inside = np.flatnonzero((values > low) & (values <= high))[::-1]
            found, vectors = values[inside], y[:, inside]
            residual = np.abs(a @ vectors - vectors * found).max(initial=0.0)
            if len(inside) == count:
                if best is not None and residual >= best[0] / 4 and best[0] <= 1e3 * d * eps * scale:
                    return best[1], best[2]
                if best is None or residual < best[0]:
                    best = (residual, found, vectors)
                if residual <= eps * scale:
                    return found, vectors
        if best is not None and best[0] <= 1e-10 * scale:
            return best[1], best[2]
    raise RuntimeError(f"inertia counts {count} eigenvalues between {low} and {high}; the contour solves do not agree")


def components(spark: SparkSession, v: np.ndarray, wanted: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest positive eigenvalues of ``v`` and their unit eigenvectors; intervals in parallel tasks."""
    scale = float(np.abs(v).max(initial=0.0))
    if not scale > 0:
        return np.zeros(0), np.zeros((len(v), 0))
    scale = 2.0 ** np.ceil(np.log2(scale))  # a power of two: scaling is exact
    a = v / scale
    cuts = intervals(a, wanted)
    if not cuts:
        return np.zeros(0), np.zeros((len(v), 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, count in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                values, vectors = feast(a, low, high, count)
                yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(list(vectors.T), pa.list_(pa.float64()))], ["value", "vector"])

    jobs = spark.createDataFrame(cuts, "low double, high double, count int").repartition(len(cuts))
    found = sorted((tuple(r) for r in jobs.mapInArrow(run, "value double, vector array<double>").collect()), key=lambda r: (-r[0], r[1]))
    basis = np.array([r[1] for r in found]).T
    if len(cuts) > 1:  # vectors of different intervals are made orthogonal to the last digit
        q, _r = np.linalg.qr(basis)
        values, u = np.linalg.eigh(q.T @ a @ q)
        basis, values = (q @ u)[:, ::-1], values[::-1]
    else:
        values = np.array([r[0] for r in found])
    return values[:wanted] * scale, basis[:, :wanted]


# ---- whitening -----------------------------------------------------------------------------------

def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n x - S, exact: int64 if every value fits, else Python integers."""
    bound = n * float(np.abs(x.astype(np.float64)).max(initial=0.0)) + max(abs(s) for s in sums)
    if bound < _SAFE:
        return x.astype(np.int64) * np.int64(n) - np.array(sums, dtype=np.int64)
    return _exact(x) * n - np.array(sums, dtype=object)


def _deviations(y: np.ndarray) -> list[Decimal]:
    """Exact sums of squares of the rows."""
    about = (y.astype(np.float64) ** 2).sum(axis=1)
    if y.dtype != object and about.max(initial=0.0) < _SAFE:
        return [Decimal(int(v)) for v in (y * y).sum(axis=1)]
    return [Decimal(int(v)) for v in (_exact(y) ** 2).sum(axis=1)]


def _project(n: int, sums: list[int], basis: np.ndarray, values: np.ndarray):
    def whiten(y: np.ndarray) -> np.ndarray:
        return (y.astype(np.float64) / n) @ basis / np.sqrt(values)

    return whiten


def identity_error(fit: DataFrame, n: int, sums: list[int], basis: np.ndarray, values: np.ndarray) -> float:
    """Largest entry of the covariance of the whitened fit list minus the identity."""
    whiten, k = _project(n, sums, basis, values), len(values)
    names = [f"w{i}" for i in range(k)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in _matrices(batches):
            w = whiten(_centred(x, n, sums))
            yield pa.RecordBatch.from_arrays([pa.array(w[:, i]) for i in range(k)], names)

    rows = fit.select("x").mapInArrow(run, ", ".join(f"{c} double" for c in names))
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    found = rows.agg(*[F.covar_pop(names[i], names[j]) for i, j in pairs]).first()
    return max(abs(v - (i == j)) for (i, j), v in zip(pairs, found, strict=True))


def whiten(vectors: DataFrame, wanted: int = COMPONENTS, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """One row per usable vector and component: ``key``, component, n, deviation, whitened, explained, identity_error.

    ``deviation`` is the exact sum of (n x - S)^2 over the dimensions, a decimal because it may pass a long.
    """
    spark = vectors.sparkSession
    usable = materialise(quantised(vectors, vector, key), "vectors")
    fit = materialise(usable.select("x").distinct(), "fit")
    kind = usable.schema[key].dataType
    schema = (
        f"`{key}` {kind.simpleString()}, component int, n bigint, deviation decimal(38,0), whitened double, explained double, "
        "identity_error double"
    )
    n, sums, v = covariance(fit)
    values, basis = components(spark, v, wanted)
    k = len(values)
    if not k:
        return spark.createDataFrame([], schema)
    error = identity_error(fit, n, sums, basis, values)
    explained = values / np.trace(v)
    project = _project(n, sums, basis, values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in _matrices(iter([batch])):
                y, rows = _centred(x, n, sums), len(x)
                each = np.repeat(np.arange(rows), k)
                yield pa.RecordBatch.from_arrays([
                    batch.column(batch.schema.get_field_index(key)).take(pa.array(each)),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                    pa.array(np.full(rows * k, n, dtype=np.int64)),
                    pa.array(_deviations(y), _DECIMAL).take(pa.array(each)),
                    pa.array(project(y).reshape(-1)),
                    pa.array(np.tile(explained, rows)),
                    pa.array(np.full(rows * k, error)),
                ], [key, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return usable.mapInArrow(run, schema)


def long_or_null(column: Column | str) -> Column:
    """A decimal as a long, null where it does not fit."""
    c = F.col(column) if isinstance(column, str) else column
    return c.try_cast("bigint")
