"""Embedding whitening (dealt operator 11): spectral divide and conquer by QDWH polar
decompositions.

The vectors are taken as integers x = floor(1024 * c) + 100000. Their sums S, and then the
sums of products of the vectors less a whole-numbered point next to the mean, are added up in
tasks and merged by Spark (numpy products in double precision are exact below 2**53, and rows
are cut so that no sum passes that), so the covariance V of all rows is exact up to one
rounding, whatever the order or number of tasks.

The components come from V, a matrix whose size is the dimension alone. :func:`polar` finds
the orthogonal factor of a shifted symmetric block by dynamically weighted Halley steps;
half of it plus half the identity is the projector onto the invariant subspace of the
eigenvalues above the shift. :func:`split` turns it into bases of that subspace and of its
complement, and :func:`components` goes on with the blocks in both, as long as they can hold
one of the wanted components, down to blocks of one, or of equal eigenvalues. The mean and the
scaled components are broadcast (dimension x components) and each row is projected in its task.

Defined cases: null vectors, vectors with null or non-finite entries and empty ones are dropped;
so are vectors of another length than the commonest one (of equally common ones, the longest).
Equal rows give equal rows. Components whose eigenvalue is no more than rounding (fewer rows
than dimensions, constant columns) can't be scaled to variance 1 and have no rows, so one
vector alone, or equal ones only, and an empty table give no rows. Of equal eigenvalues any
orthonormal basis is returned. Signs: a component's largest entry is positive. An
entry of more than 2**40 in absolute value is an error, and so are sums beyond 64 bits."""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailcast.llm.scratch import prepare

SCALE, OFFSET, COMPONENTS = 1024, 100000, 8
EXACT = 1 << 53
LIMIT = float(1 << 40)
EPS = np.finfo(float).eps


def polar(a: np.ndarray, most: int = 40) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix by QDWH steps."""
    n = len(a)
    x = a / np.linalg.norm(a)
    try:                                              # a lower bound of the least singular value
        low = 1 / (np.sqrt(n) * np.linalg.norm(np.linalg.inv(x), 1))
    except np.linalg.LinAlgError:
        low = 0.0
    low = min(1.0, max(EPS, low))
    for _ in range(most):
        d = np.cbrt(4 * (1 - low ** 2) / low ** 4)
        weight = np.sqrt(1 + d) + 0.5 * np.sqrt(8 - 4 * d + 8 * (2 - low ** 2) / (low ** 2 * np.sqrt(1 + d)))
        b = (weight - 1) ** 2 / 4
        c = weight + b - 1
        q, _r = np.linalg.qr(np.concatenate([np.sqrt(c) * x, np.eye(n)]))
        new = (b / c) * x + (weight - b / c) / np.sqrt(c) * (q[:n] @ q[n:].T)
        new = (new + new.T) / 2
        low = min(1.0, low * (weight + b * low ** 2) / (1 + c * low ** 2))
        moved, x = np.linalg.norm(new - x), new
        if moved <= 1e-14 * n and 1 - low < 1e-12:
            break
    return x


def split(a: np.ndarray, rounding: float) -> tuple[np.ndarray, np.ndarray] | None:
    """Orthonormal bases of the invariant subspaces of the eigenvalues above and below a shift
    inside the spectrum; None if all eigenvalues are equal up to ``rounding``."""
    n = len(a)
    one, rng = np.eye(n), np.random.default_rng(n)
    middle = np.trace(a) / n
    spread = np.linalg.norm(a - middle * one) / np.sqrt(n)      # standard deviation of the eigenvalues
    if spread <= rounding:
        return None
    for move in (0.0, 0.25, -0.25, 0.5, -0.5, 0.9, -0.9):
        projector = (polar(a - (middle + move * spread) * one) + one) / 2
        k = int(round(np.trace(projector)))
        if not 0 < k < n or np.linalg.norm(projector @ projector - projector) > 1e-10:
            continue                                  # an eigenvalue at the shift, or none beyond it
        bases = []
        for side, size in ((projector, k), (one - projector, n - k)):
            q, _r = np.linalg.qr(side @ rng.standard_normal((n, size)))
            bases.append(np.linalg.qr(side @ q)[0])   # a step more, for full accuracy
        if np.linalg.norm(bases[1].T @ a @ bases[0]) <= n * rounding:
            return bases[0], bases[1]
    raise ArithmeticError("no shift splits the spectrum")


def components(v: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``most`` largest eigenvalues of a symmetric matrix, falling, and their unit
    eigenvectors (columns)."""
    done = []                                         # (eigenvalue, vector)
    rounding = 16 * EPS * len(v) * np.linalg.norm(v)
    todo = [(v, np.eye(len(v)))]
    while todo:
        # the block of the largest eigenvalues first (by its mean: blocks don't interleave)
        todo.sort(key=lambda block: np.trace(block[0]) / len(block[0]))
        a, basis = todo.pop()
        if len(done) >= most:
            break
        halves = split(a, rounding) if len(a) > 1 else None
        if halves is None:
            done += [(float(a[i, i]), basis[:, i]) for i in range(len(a))]
            continue
        for q in halves[::-1]:
            b = q.T @ a @ q
            todo.append(((b + b.T) / 2, basis @ q))
    done = done[:most]
    vectors = np.stack([b for _e, b in done], 1) if done else np.zeros((len(v), 0))
    vectors, _r = np.linalg.qr(vectors)               # orthonormal to rounding, order kept
    values = np.array([q @ v @ q for q in vectors.T])
    order = np.argsort(-values, kind="stable")
    vectors = vectors[:, order]
    signs = np.sign(vectors[np.argmax(np.abs(vectors), axis=0), np.arange(vectors.shape[1])])
    return values[order], vectors * signs


def _matrix(column, dim: int | None):
    """(rows that are kept, their integer vectors) of an Arrow list column."""
    cuts = np.asarray(column.offsets).astype(np.int64)
    values = column.values
    c = values.cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False)
    size = np.diff(cuts)
    if column.null_count:
        size[np.asarray(column.is_null())] = -1
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(c))])
    ok = (size == dim) if dim else size > 0
    ok &= bad[cuts[1:]] == bad[cuts[:-1]]
    rows = np.flatnonzero(ok)
    if dim is None:
        return rows, size
    x = c[cuts[rows][:, None] + np.arange(dim)] if len(rows) else np.empty((0, dim))
    if len(rows) and np.abs(x).max() > LIMIT:
        raise ArithmeticError("a vector entry is beyond 2**40")
    return rows, np.floor(SCALE * x).astype(np.int64) + OFFSET


def _product(y: np.ndarray) -> np.ndarray:
    """Exact y.T @ y of integers as int64, by double products of rows whose sums stay exact."""
    top = int(np.abs(y).max(initial=0)) ** 2
    out = np.zeros((y.shape[1], y.shape[1]), np.int64)
    if top * len(y) >= 1 << 62:
        raise ArithmeticError("sums of products are beyond 64 bits")
    if top >= EXACT:
        return y.T @ y
    step = max(1, EXACT // max(1, top) - 1)
    for lo in range(0, len(y), step):
        part = y[lo:lo + step].astype(float)
        out += (part.T @ part).astype(np.int64)
    return out


def _summed(rows: DataFrame) -> dict[int, np.ndarray]:
    """Sums of equal-length long arrays by key, added up by Spark: (key, v) -> {key: sum}. The
    keys and the lengths are bounded by the dimension."""
    def add(table: pa.Table) -> pa.Table:
        total, key = None, table.column("key")[0]
        for chunk in table.column("v").chunks:
            part = chunk.flatten().to_numpy().reshape(len(chunk), -1)
            if np.abs(part.astype(float)).sum(0).max() + (0 if total is None else np.abs(total.astype(float)).max()) >= 2.0 ** 62:
                raise ArithmeticError("sums are beyond 64 bits")
            total = part.sum(0) + (0 if total is None else total)
        return pa.table({"key": pa.array([key.as_py()], pa.int32()), "v": pa.array([total.tolist()], pa.list_(pa.int64()))})

    return {r.key: np.array(r.v, np.int64) for r in rows.groupBy("key").applyInArrow(add, "key int, v array<long>").collect()}


@dataclass
class Moments:
    """What whitening needs of the fit list: n, sums S, the whole-numbered point next to the
    mean, the remainder S - n * point, and the covariance."""
    n: int
    sums: np.ndarray
    point: np.ndarray
    rest: np.ndarray
    covariance: np.ndarray


def moments(vectors: DataFrame, dim: int) -> Moments:
    """Two passes over the vectors: sums, then centred products."""

    def sums(batches):
        total, n = np.zeros(dim, np.int64), 0
        for batch in batches:
            _rows, x = _matrix(batch.column(0), dim)
            total += x.sum(0)
            n += len(x)
        if n:
            yield pa.record_batch([pa.array([0], pa.int32()), pa.array([[n, *total.tolist()]], pa.list_(pa.int64()))], names=["key", "v"])

    found = _summed(vectors.mapInArrow(sums, "key int, v array<long>"))[0]
    n, total = int(found[0]), found[1:]
    point = np.array([(2 * int(s) + n) // (2 * n) for s in total], np.int64)
    rest = np.array([int(s) - n * int(p) for s, p in zip(total, point)], np.int64)

    def products(batches):
        out, some = np.zeros((dim, dim), np.int64), False
        for batch in batches:
            _rows, x = _matrix(batch.column(0), dim)
            out += _product(x - point)
            some = some or len(x) > 0
        if some:
            yield pa.record_batch([pa.array(np.arange(dim), pa.int32()), pa.array(out.tolist(), pa.list_(pa.int64()))], names=["key", "v"])

    found = _summed(vectors.mapInArrow(products, "key int, v array<long>"))
    # n * n * V in whole numbers: n * products - rest * rest
    exact = [[(n * int(found[i][j]) - int(rest[i]) * int(rest[j])) / (n * n) for j in range(dim)] for i in range(dim)]
    return Moments(n, total, point, rest, np.array(exact, float).reshape(dim, dim))


@dataclass
class Whitening:
    """Fitted components: ``project`` holds the eigenvectors divided by the root of their
    eigenvalue."""
    dim: int
    moments: Moments
    values: np.ndarray
    vectors: np.ndarray
    identity_error: float = 0.0

    @property
    def explained(self) -> np.ndarray:
        return self.values / max(np.trace(self.moments.covariance), np.finfo(float).tiny)

    def whiten(self, x: np.ndarray) -> np.ndarray:
        mean = self.moments.rest / self.moments.n
        return ((x - self.moments.point) - mean) @ (self.vectors / np.sqrt(self.values))


def dimension(vectors: DataFrame) -> int | None:
    """The commonest length among vectors of finite entries."""

    def sizes(batches):
        for batch in batches:
            rows, size = _matrix(batch.column(0), None)
            length, n = np.unique(size[rows], return_counts=True)
            yield pa.record_batch([pa.array(length, pa.int64()), pa.array(n, pa.int64())], names=["length", "n"])

    rows = (vectors.mapInArrow(sizes, "length long, n long").groupBy("length").agg(F.sum("n").alias("n"))
            .orderBy(F.col("n").desc(), F.col("length").desc()).limit(1).collect())
    return int(rows[0].length) if rows else None


def fit(vectors: DataFrame, most: int = COMPONENTS, vector_col: str = "embedding") -> Whitening | None:
    """The whitening of a table's vectors, with the measured error of the whitened covariance;
    None without a vector or without variance."""
    prepare(vectors.sparkSession)
    column = vectors.select(F.col(vector_col).alias("v"))
    dim = dimension(column)
    if dim is None:
        return None
    found = moments(column, dim)
    values, parts = components(found.covariance, min(most, dim))
    solid = values > 64 * dim * EPS * max(np.trace(found.covariance), 0.0)
    if not solid.any():
        return None
    fitted = Whitening(dim, found, values[solid], parts[:, solid])
    shared = vectors.sparkSession.sparkContext.broadcast(fitted)
    size = len(fitted.values)

    def measured(batches):
        total, squares = np.zeros(size), np.zeros((size, size))
        for batch in batches:
            _rows, x = _matrix(batch.column(0), dim)
            z = shared.value.whiten(x)
            total += z.sum(0)
            squares += z.T @ z
        yield pa.record_batch([pa.array([i for i in range(size + 1) for _ in range(size)], pa.int32()), pa.array(list(range(size)) * (size + 1), pa.int32()),
                               pa.array(np.concatenate([total[None], squares]).reshape(-1))], names=["i", "j", "v"])

    cells = column.mapInArrow(measured, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    table = np.zeros((size + 1, size))
    for r in cells:
        table[r.i, r.j] = r.v
    mean = table[0] / found.n
    fitted.identity_error = float(np.abs(table[1:] / found.n - np.outer(mean, mean) - np.eye(size)).max())
    return fitted


def whiten(vectors: DataFrame, fitted: Whitening | None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """A row for each kept vector and component: id, component, n, deviation (decimal(38,0), exact),
    whitened, explained, identity_error."""
    spark = vectors.sparkSession
    id_type = dict(vectors.dtypes)[id_col]
    names = ["id", "squares", "mixed", "component", "whitened", "explained"]
    schema = f"id {id_type}, squares long, mixed long, component int, whitened double, explained double"
    if fitted is None:
        rows, n, rest, error = spark.createDataFrame([], schema), 0, 0, 0.0
    else:
        shared = spark.sparkContext.broadcast(fitted)       # dimension x components
        size = len(fitted.values)

        def project(batches):
            w = shared.value
            for batch in batches:
                kept, x = _matrix(batch.column(1), w.dim)
                y = x - w.moments.point
                if len(y) and w.dim * float(np.abs(y).max()) * max(float(np.abs(y).max()), w.moments.n / 2) >= 2.0 ** 62:
                    raise ArithmeticError("a deviation's sums are beyond 64 bits")
                repeat = np.repeat(np.arange(len(kept)), size)
                yield pa.record_batch([batch.column(0).take(pa.array(kept[repeat])), pa.array((y * y).sum(1)[repeat]), pa.array((y @ w.moments.rest)[repeat]),
                                       pa.array(np.tile(np.arange(1, size + 1), len(kept)), pa.int32()), pa.array(w.whiten(x).reshape(-1)),
                                       pa.array(np.tile(w.explained, len(kept)))], names=names)

        rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).mapInArrow(project, schema)
        n, rest, error = fitted.moments.n, sum(int(r) ** 2 for r in fitted.moments.rest), fitted.identity_error
    # sum of (n * y - rest)^2 = n * n * squares - 2 * n * mixed + sum of rest^2
    whole = lambda c: c.cast("decimal(19,0)")
    times = whole(F.lit(n))
    deviation = times * (times * whole(F.col("squares")) - whole(F.lit(2)) * whole(F.col("mixed"))) + F.lit(Decimal(rest)).cast("decimal(38,0)")
    return rows.select(F.col("id").alias(id_col), "component", F.lit(n).cast("long").alias("n"), deviation.cast("decimal(38,0)").alias("deviation"),
                       "whitened", "explained", F.lit(error).alias("identity_error"))
