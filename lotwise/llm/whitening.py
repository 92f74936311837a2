"""Embedding whitening: leading components by Jacobi-Davidson over distributed products.

Vectors become integer vectors ``x = floor(scale * c)``; the fit list holds each
distinct ``x`` once.  With its mean ``m`` the covariance is ``V = E[(x - m)(x - m)']``;
it is never formed.  All that the solver asks for is ``V B`` for a few columns
``B``: a Spark job in which every task centres its blocks of the fit list before
multiplying, ``(X - m)' ((X - m) B)``, and returns one small matrix.

The solver keeps a search space on the driver (``dimension x`` at most ``SPACE``
columns, independent of the number of rows):

1. Rayleigh-Ritz in the search space; a leading pair whose residual is down to
   double precision is locked and taken out of the space.
2. For every open pair ``(theta, u)`` MINRES approximately solves the correction
   equation ``(I - QQ')(V - theta)(I - QQ') t = -r``, where ``Q`` holds the locked
   and the wanted Ritz vectors; all pairs share each product.
3. The corrections, made orthogonal to the space, extend it; it restarts from its
   best Ritz vectors when it is full.

The fit list is written once, packed into blocks, to the shared checkpoint folder;
partial matrices of very many blocks are added up in tasks before the driver sees
them.

Defined results: rows whose vector is null, or holds a null or non-finite entry,
drop out; a shorter vector counts as filled up with zeros to the longest one's
length; repeated rows and ids each get their rows back, but are fitted once; a null
id stays null; components whose variance is zero up to rounding (one distinct
vector, an empty table, exhausted rank) do not exist and give no rows; a deviation
beyond a long is null.  Columns are taken by name, so others play no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwise.llm import text as T
from lotwise.llm.tables import cut, table

SCALE = 256
COMPONENTS = 4
GUARD = 4                       # extra columns in the search space
SPACE = 96                      # columns of the search space before a restart
INNER = 4                       # MINRES steps per correction
INNER_TOLERANCE = 1e-3          # relative residual at which a correction is good enough
TOLERANCE = 2e-14               # residual, relative to the largest eigenvalue
ROUNDS = 500
SEED = 13
BLOCK_BYTES = 1 << 20
FAN_IN = 1024                   # blocks whose partial matrices the driver adds up itself
RANK = 1e-13                    # variance, relative to the largest, that counts as zero

BLOCKS = "n long, kind string, data binary"
LIMIT = 2 ** 63 - 1


# ---------------------------------------------------------------- the solver

def _orthonormal(columns: np.ndarray, against: np.ndarray) -> np.ndarray:
    """Orthonormal columns spanning what ``columns`` add to ``against``."""
    for _ in range(2):
        columns = columns - against @ (against.T @ columns)
        size = np.linalg.norm(columns, axis=0)
        columns = columns[:, size > 0] / size[size > 0]
    q, s, _ = np.linalg.svd(columns, full_matrices=False)
    q = q[:, s > 1e-8]
    q = q - against @ (against.T @ q)
    return np.linalg.qr(q)[0] if q.shape[1] else q


def minres(apply, rhs: np.ndarray, steps: int = INNER, tolerance: float = INNER_TOLERANCE) -> np.ndarray:
    """Approximate solutions of one symmetric system per column of ``rhs``.

    ``apply`` maps all columns at once, each with its own operator, so a step
    costs one product whatever the number of systems.
    """
    tiny = np.finfo(float).tiny
    safe = lambda a: np.where(a > tiny, a, 1.0)
    first = np.linalg.norm(rhs, axis=0)
    x, w, w_old, v_old = (np.zeros_like(rhs) for _ in range(4))
    v, beta, left = rhs / safe(first), np.zeros_like(first), first.copy()
    cosine, sine, bar, lift = -np.ones_like(first), np.zeros_like(first), np.zeros_like(first), np.zeros_like(first)
    for _ in range(steps):
        p = apply(v)
        alpha = np.sum(v * p, axis=0)
        p = p - alpha * v - beta * v_old
        v_old, beta = v, np.linalg.norm(p, axis=0)
        v = np.where(beta > tiny, p / safe(beta), 0.0)
        lift_old, delta, gamma_bar = lift, cosine * bar + sine * alpha, sine * bar - cosine * alpha
        lift, bar = sine * beta, -cosine * beta
        gamma = np.hypot(gamma_bar, beta)
        cosine, sine = gamma_bar / safe(gamma), beta / safe(gamma)
        w, w_old = (v_old - lift_old * w_old - delta * w) / safe(gamma), w
        x = x + np.where(gamma > tiny, cosine * left, 0.0) * w
        left = sine * left
        if np.all(np.abs(left) <= tolerance * first):
            break
    return x


def jacobi_davidson(product, dimension: int, count: int, space: int = SPACE):
    """The ``count`` largest eigenvalues and eigenvectors of a symmetric positive map.

    ``product`` maps a (dimension x k) matrix; it is all that is known of the map.
    """
    count = min(count, dimension)
    rng = np.random.default_rng(SEED)
    width = min(dimension, count + GUARD)
    space = max(space, 2 * width)
    locked = np.zeros((dimension, 0))
    basis = _orthonormal(rng.standard_normal((dimension, width)), locked)
    image = product(basis)
    scale = 0.0
    for _ in range(ROUNDS):
        h = basis.T @ image
        theta, s = np.linalg.eigh((h + h.T) / 2)
        basis, image, theta = basis @ s[:, ::-1], image @ s[:, ::-1], theta[::-1]
        scale = max(scale, theta[0])
        want = count - locked.shape[1]
        rest = image[:, :want] - basis[:, :want] * theta[:want]
        rest = rest - locked @ (locked.T @ rest)
        whole = locked.shape[1] + basis.shape[1] >= dimension
        good = whole | (np.linalg.norm(rest, axis=0) <= TOLERANCE * scale)
        done = want if good.all() else int(np.argmin(good))
        locked = np.hstack((locked, basis[:, :done]))
        basis, image, theta, rest, want = basis[:, done:], image[:, done:], theta[done:], rest[:, done:], want - done
        if want == 0:
            break
        if basis.shape[1] + want > space:
            basis, image = basis[:, :width], image[:, :width]
        known = np.hstack((locked, basis[:, :want]))
        shift = theta[:want]

        def correction(v):
            v = v - known @ (known.T @ v)
            v = product(v) - v * shift
            return v - known @ (known.T @ v)

        steps = minres(correction, -(rest - known @ (known.T @ rest)))
        held = np.hstack((locked, basis))
        new = _orthonormal(steps, held)
        if new.shape[1] == 0:   # nothing to add: look elsewhere
            new = _orthonormal(rng.standard_normal((dimension, 1)), held)
        basis, image = np.hstack((basis, new)), np.hstack((image, product(new)))
    else:
        raise ArithmeticError("the components did not reach double precision")
    # a last Rayleigh-Ritz puts the locked pairs in order
    h = locked.T @ product(locked)
    theta, s = np.linalg.eigh((h + h.T) / 2)
    return theta[::-1], locked @ s[:, ::-1]


# ------------------------------------------------------- the distributed fit

def remaining(docs: DataFrame, id_col: str, vector_col: str, scale: int = SCALE) -> DataFrame:
    """(id, x) of the rows that remain, as integers."""
    c = F.col(vector_col)
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))
    return (docs.where(c.isNotNull() & F.forall(c, lambda v: F.coalesce(finite(v.cast("double")), F.lit(False))))
            .select(F.col(id_col).cast("long").alias("id"),
                    F.transform(c, lambda v: F.floor(v.cast("double") * F.lit(float(scale)))).alias("x")))


def _matrix(column: pa.Array, dimension: int) -> np.ndarray:
    """Rows of a list column as one integer matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dimension)


def _blocks(vectors: DataFrame, dimension: int) -> DataFrame:
    """The distinct vectors, packed into blocks of the smallest integer kind that holds them."""
    rows = max(1, BLOCK_BYTES // (8 * dimension))

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, rows):
                x = _matrix(batch.column(0).slice(lo, rows), dimension)
                low, high = int(x.min()), int(x.max())
                kind = next(k for k in ("<i2", "<i4", "<i8") if np.iinfo(k).min <= low and high <= np.iinfo(k).max)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([len(x)], pa.int64()), pa.array([kind]), pa.array([x.astype(kind).tobytes()])],
                    ["n", "kind", "data"])

    return vectors.select("x").distinct().mapInArrow(run, BLOCKS)


class Fit:
    """The fit list: its size, sums and centred products."""

    def __init__(self, vectors: DataFrame, dimension: int):
        """``vectors`` has a column ``x`` of arrays of ``dimension`` integers."""
        self.dimension = dimension
        self.blocks = cut(_blocks(vectors, dimension), "fit-list")
        dim = dimension

        def moments(batches):
            count, total, squares = 0, [0] * dim, [0] * dim
            for batch in batches:
                for x in _arrays(batch, dim):
                    small = max(-int(x.min()), int(x.max())) < 1 << 20      # squares of a block fit a long
                    x = x.astype(np.int64 if small else object)
                    count += len(x)
                    total = [a + int(b) for a, b in zip(total, x.sum(axis=0))]
                    squares = [a + int(b) for a, b in zip(squares, (x * x).sum(axis=0))]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(dim)), pa.array([count] * dim, pa.int64()),
                 pa.array([str(v) for v in total]), pa.array([str(v) for v in squares])], ["j", "n", "s", "q"])

        def added(parts: pa.Table) -> pa.Table:
            whole = lambda name: str(sum(map(int, parts.column(name).to_pylist())))
            return pa.table({"j": parts.column("j")[:1], "blocks": pa.array([len(parts)], pa.int64()),
                             "n": pa.array([int(whole("n"))], pa.int64()), "s": pa.array([whole("s")]),
                             "q": pa.array([whole("q")])})

        # whole numbers of any length, one partial row per task and dimension
        rows = (self.blocks.mapInArrow(moments, "j long, n long, s string, q string").groupBy("j")
                .applyInArrow(added, "j long, blocks long, n long, s string, q string").orderBy("j").collect())
        self.parts = rows[0]["blocks"] if rows else 0
        self.n = rows[0]["n"] if rows else 0
        self.sums = [int(r["s"]) for r in rows]
        #: trace of the covariance, from exact integers
        self.trace = sum(self.n * int(r["q"]) - s * s for r, s in zip(rows, self.sums)) / max(1, self.n * self.n)
        self.mean = np.array([s / self.n for s in self.sums])

    def _added(self, shape: tuple[int, int], partial) -> np.ndarray:
        """The sum over all blocks of ``partial(centred block)``, a small matrix."""
        dim, mean, many = self.dimension, self.mean, self.parts > FAN_IN

        def run(batches):
            out = np.zeros(shape)
            for batch in batches:
                for x in _arrays(batch, dim):
                    out += partial(x.astype(np.float64) - mean)
            yield pa.RecordBatch.from_arrays(
                [pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([out.tobytes()])], ["part", "data"])

        def add(rows: pa.Table) -> pa.Table:
            total = sum((np.frombuffer(d) for d in rows.column("data").to_pylist()), np.zeros(shape).ravel())
            return pa.table({"part": pa.array([0], pa.int64()), "data": pa.array([total.tobytes()])})

        rows = self.blocks.mapInArrow(run, "part long, data binary")
        if many:
            groups = max(1, int(self.parts ** 0.5))
            rows = rows.groupBy(F.pmod("part", F.lit(groups))).applyInArrow(add, "part long, data binary")
        found = sorted(rows.collect(), key=lambda r: (r["part"], bytes(r["data"])))
        return sum((np.frombuffer(r["data"]).reshape(shape) for r in found), np.zeros(shape))

    def product(self, columns: np.ndarray) -> np.ndarray:
        """The covariance times ``columns``."""
        return self._added(columns.shape, lambda x: x.T @ (x @ columns)) / self.n

    def covariance(self, columns: np.ndarray) -> np.ndarray:
        """Covariance of the vectors projected on ``columns``."""
        k = columns.shape[1]

        def partial(x):
            p = x @ columns
            return p.T @ p

        return self._added((k, k), partial) / self.n


def _arrays(batch: pa.RecordBatch, dimension: int):
    for kind, data in zip(batch.column("kind").to_pylist(), batch.column("data")):
        yield np.frombuffer(data.as_buffer(), kind).reshape(-1, dimension)


class Whitening:
    """Components of a fit list, and the rows projected on them."""

    def __init__(self, fit: Fit, components: int = COMPONENTS):
        values, vectors = jacobi_davidson(fit.product, fit.dimension, components)
        real = values > RANK * max(values[0], 0.0)
        self.fit, self.values, self.vectors = fit, values[real], vectors[:, real]
        self.scaled = self.vectors / np.sqrt(self.values)
        self.explained = self.values / fit.trace if fit.trace > 0 else self.values
        error = np.abs(fit.covariance(self.scaled) - np.eye(len(self.values))) if real.any() else np.zeros(1)
        self.identity_error = float(error.max())


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Per row, the sum over dimensions of ``(n * x - S) ** 2``, exact; null beyond a long."""
    if len(x) == 0:
        return []
    reach = max(abs(n * v - s) for s, lo, hi in zip(sums, x.min(axis=0).tolist(), x.max(axis=0).tolist())
                for v in (lo, hi))
    if reach * reach * x.shape[1] <= LIMIT:
        gap = x * np.int64(n) - np.array(sums, np.int64)
        return np.sum(gap * gap, axis=1).tolist()
    out = [sum((n * v - s) ** 2 for v, s in zip(row, sums)) for row in x.tolist()]
    return [v if v <= LIMIT else None for v in out]


def whiten(docs: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
           components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """One row per remaining row of ``docs`` and component: (id, component, n, deviation,
    whitened, explained, identity_error)."""
    schema = ("id long, component int, n long, deviation long, whitened double, explained double, "
              "identity_error double")
    spark = docs.sparkSession
    rows = remaining(docs, id_col, vector_col, scale)
    dimension = rows.agg(F.max(F.size("x"))).first()[0]
    if not dimension:
        return spark.createDataFrame([], schema)
    rows = rows.withColumn("x", F.when(F.size("x") == dimension, F.col("x")).otherwise(
        F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(dimension) - F.size("x")))))
    fit = Fit(rows, dimension)
    model = Whitening(fit, components)
    count = len(model.values)
    if count == 0:
        return spark.createDataFrame([], schema)
    n, sums, mean, scaled = fit.n, fit.sums, fit.mean, model.scaled
    explained, error = model.explained, model.identity_error

    def run(batches):
        for batch in batches:
            x = _matrix(batch.column(1), dimension)
            size = len(x)
            whitened = (x.astype(np.float64) - mean) @ scaled
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(np.repeat(np.arange(size), count))),
                 pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), size)),
                 pa.array(np.full(size * count, n)),
                 pa.array([d for d in deviations(x, n, sums) for _ in range(count)], pa.int64()),
                 pa.array(whitened.ravel()), pa.array(np.tile(explained, size)),
                 pa.array(np.full(size * count, error))],
                ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])
        T.release()

    return rows.mapInArrow(run, schema)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``embeddings`` projected on their four leading components, with unit covariance."""
    return whiten(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")
