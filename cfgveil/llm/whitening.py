"""Whiten embeddings: principal components of the corpus and its vectors along them.

The scatter of the vectors is summed on the executors; the driver sees one matrix of the
vectors' dimension, factors it by a pivoted Cholesky decomposition and turns the factor's
columns until they are orthogonal (one-sided Jacobi): their norms give the eigenvalues of
the covariance, their directions the components, and no product of the factor with itself
is formed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cfgveil.llm.blocks import pieces

SCALE, SHIFT = 64, 1_000_000  # an entry c is the integer floor(64 c) + 1000000
ROWS = 4096  # vectors worked on at once
FAN_IN = 64  # partial matrices that a task adds up


@dataclass
class Fit:
    """What the whole list of vectors gives: entries are kept less SHIFT."""

    n: int
    sums: list[int]
    values: np.ndarray  # eigenvalues of the covariance, falling
    components: np.ndarray  # a column for each
    trace: float

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])


def valid_vectors(df: DataFrame, id: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, int, int]:
    """(id, x), their number and dimension: vectors without null or non-finite entries, as integers less SHIFT.

    Integers beyond the range of long are its ends. The dimension is the commonest length (of
    equally common ones the largest) above 0; vectors of other lengths are left out.
    """
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(math.inf))
    rows = df.select(F.col(f"`{id}`").cast("long").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("v"))
    rows = rows.where(F.col("v").isNotNull() & (F.size("v") > 0)).where(F.forall("v", finite))
    common = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    n, d = (common["count"], common["d"]) if common else (0, 0)
    rows = rows.where(F.size("v") == F.lit(d))
    return rows.select("id", F.transform("v", lambda c: F.floor(c * F.lit(float(SCALE)))).alias("x")), n, d


def _tables(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    for table in pieces(batches, 8 * d * ROWS):
        table = table.combine_chunks()
        x = pc.list_flatten(table["x"].combine_chunks()).to_numpy(zero_copy_only=False)
        yield table["id"].combine_chunks(), x.reshape(-1, d)


def _added(parts: DataFrame, dtype: str) -> DataFrame:
    """Sum the arrays `body` of each `row` over the partial results `part`, a few at a time."""

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(len(table["body"][0]), dtype)
        for k in np.argsort(table["part"].to_numpy()):  # one order, so one result
            total += table["body"][int(k)].values.to_numpy()
        first = table.slice(0, 1)
        return pa.table({"part": first["part"], "row": first["row"], "body": pa.array([total], pa.list_(pa.float64()))})

    spec = "part int, row int, body array<double>"
    few = parts.groupBy((F.col("part") / FAN_IN).cast("int").alias("few"), "row").applyInArrow(add, spec)
    return few.groupBy("row").applyInArrow(add, spec)


def fit(vectors: DataFrame, n: int, d: int) -> Fit:
    """Components of the `n` vectors of `valid_vectors`, of dimension `d`.

    Two passes: exact sums of each dimension, then the scatter of the centred vectors. The
    driver gets d sums and d rows of d numbers.
    """
    exploded = vectors.select(F.posexplode("x").alias("i", "x"))
    sums = {r["i"]: int(r["s"]) for r in exploded.groupBy("i").agg(F.sum(F.col("x").cast("decimal(19,0)")).alias("s")).collect()}
    sums = [sums[i] for i in range(d)]
    mean = np.array([s / n for s in sums])

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = None
        for _, x in _tables(batches, d):
            y = x - mean
            total = y.T @ y if total is None else total + y.T @ y
        if total is not None:
            part = np.full(d, TaskContext.get().partitionId(), np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(np.arange(d, dtype=np.int32)), pa.array(list(total), pa.list_(pa.float64()))], ["part", "row", "body"])

    parts = vectors.mapInArrow(scatter, "part int, row int, body array<double>")
    matrix = np.zeros((d, d))
    for r in _added(parts, "float64").collect():
        matrix[r["row"]] = r["body"]
    factor = pivoted_cholesky((matrix + matrix.T) / 2)
    norms, columns = jacobi(factor)
    return Fit(n, sums, norms**2 / n, columns, float(np.trace(matrix)) / n)


def pivoted_cholesky(matrix: np.ndarray) -> np.ndarray:
    """A (d, rank) with A A' = matrix, lower triangular up to the order of its rows.

    The largest remaining diagonal entry is the next pivot. It ends where that entry is within
    rounding of zero, so the number of columns is the numerical rank.
    """
    d = len(matrix)
    rest = np.diag(matrix).astype(np.float64).copy()
    smallest = 16 * d * np.finfo(np.float64).eps * max(rest.max(initial=0.0), 0.0)
    factor = np.zeros((d, d))
    free = np.ones(d, bool)
    for k in range(d):
        p = int(np.argmax(np.where(free, rest, -math.inf)))
        if rest[p] <= smallest:
            return factor[:, :k]
        root = math.sqrt(rest[p])
        free[p] = False
        factor[p, k] = root
        factor[free, k] = (matrix[free, p] - factor[free, :k] @ factor[p, :k]) / root
        rest[free] -= factor[free, k] ** 2
    return factor


def jacobi(factor: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """(norms, unit columns), norms falling, of the factor turned until its columns are orthogonal.

    Each step turns disjoint pairs of columns; the pairs of a sweep are those of a round
    robin. It ends when no pair's cosine is above rounding.
    """
    a = factor.copy()
    m = a.shape[1]
    rounding = np.finfo(np.float64).eps * math.sqrt(len(a))
    ring = np.arange(m + m % 2)
    for _ in range(sweeps if m > 1 else 0):
        worst = 0.0
        for _ in range(len(ring) - 1):
            left, right = ring[: len(ring) // 2], ring[len(ring) // 2 :][::-1]
            real = (left < m) & (right < m)
            p, q = left[real], right[real]
            u, v = a[:, p], a[:, q]
            alpha, beta, gamma = (u * u).sum(axis=0), (v * v).sum(axis=0), (u * v).sum(axis=0)
            scale = np.sqrt(alpha * beta)
            cosine = np.divide(np.abs(gamma), scale, out=np.zeros(len(p)), where=scale > 0)
            worst = max(worst, float(cosine.max(initial=0.0)))
            turn = cosine > rounding
            if turn.any():
                p, q, u, v, g = p[turn], q[turn], u[:, turn], v[:, turn], gamma[turn]
                zeta = (beta[turn] - alpha[turn]) / (2 * g)
                t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
                c = 1 / np.hypot(1.0, t)
                a[:, p], a[:, q] = c * (u - t * v), c * (v + t * u)
            ring = np.concatenate([ring[:1], np.roll(ring[1:], 1)])
        if worst <= rounding:
            break
    norms = np.linalg.norm(a, axis=0)
    order = np.argsort(-norms, kind="stable")
    order = order[norms[order] > 0]
    return norms[order], a[:, order] / norms[order]


def identity_error(vectors: DataFrame, found: Fit, k: int) -> float:
    """Largest entry of the covariance of the first `k` whitened columns, less the identity."""
    d, mean = len(found.sums), found.mean
    by = found.components[:, :k] / np.sqrt(found.values[:k])

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first, second, count = np.zeros(k), np.zeros((k, k)), 0
        for _, x in _tables(batches, d):
            w = (x - mean) @ by
            count += len(w)
            first += w.sum(axis=0)
            second += w.T @ w
        if count:
            rows = np.vstack([second, first])
            part = np.full(k + 1, TaskContext.get().partitionId(), np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(np.arange(k + 1, dtype=np.int32)), pa.array(list(rows), pa.list_(pa.float64()))], ["part", "row", "body"])

    parts = vectors.mapInArrow(moments, "part int, row int, body array<double>")
    rows = np.zeros((k + 1, k))
    for r in _added(parts, "float64").collect():
        rows[r["row"]] = r["body"]
    centre = rows[k] / found.n  # zero but for rounding, as the vectors are centred already
    return float(np.abs(rows[:k] / found.n - np.outer(centre, centre) - np.eye(k)).max(initial=0.0))


OUT = "id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(df: DataFrame, id: str = "vec_id", vector: str = "embedding", *, components: int = 32) -> DataFrame:
    """Every valid vector along the first `components` components, scaled to unit variance.

    (id, component, n, deviation, whitened, explained, identity_error), a row for each vector
    and component. An entry c counts as the integer floor(64 c) + 1000000; null vectors,
    empty ones and those with null or non-finite entries are left out, and so are those of
    another length than the commonest. `n` vectors are left; `deviation` is the sum over
    dimensions of (n x - S)^2, exact (null beyond the range of long, which begins at some
    10^9 / |64 c| vectors). A component has a positive eigenvalue up to rounding, so vectors
    that lie in a subspace have fewer than `components`. Repeated rows count and come back as
    often as they occur; a null id stays null. Equal vectors, a single one or an empty table
    have no component: no rows. The sign of a component is set by its largest entry, which is
    positive. Other columns are not read.
    """
    spark = df.sparkSession
    vectors, n, d = valid_vectors(df, id, vector)
    found = fit(vectors, n, d) if n else None
    k = min(components, len(found.values)) if found else 0
    if not k:
        return spark.createDataFrame([], OUT).withColumnRenamed("id", id)
    strongest = found.components[np.abs(found.components).argmax(axis=0), np.arange(len(found.values))]
    found.components *= np.sign(strongest)
    error = identity_error(vectors, found, k)
    sums, mean = found.sums, found.mean
    by, explained = found.components[:, :k] / np.sqrt(found.values[:k]), found.values[:k] / found.trace

    names = [c.split()[0] for c in OUT.split(", ")]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in _tables(batches, d):
            m = len(x)
            which = pa.array(np.repeat(np.arange(m), k))
            columns = [
                ids.take(which), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)), _deviations(x, n, sums).take(which),
                pa.array(((x - mean) @ by).ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names)

    return vectors.mapInArrow(project, OUT).withColumnRenamed("id", id)


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> pa.Array:
    """Sum of (n x - S)^2 of each row; null where it isn't a long."""
    most = int(max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))) * n + max(abs(s) for s in sums)
    if most * most * len(sums) < 2**63:
        y = x * np.int64(n) - np.array(sums, np.int64)
        return pa.array((y * y).sum(axis=1))
    exact = [sum((v * n - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in x.tolist()]
    return pa.array([e if e < 2**63 else None for e in exact], pa.int64())
