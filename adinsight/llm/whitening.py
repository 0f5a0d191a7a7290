"""Whitening of embeddings with the leading principal components.

Every entry c of a vector becomes the whole number floor(1024 c) + 100000. One pass counts the vectors and sums each
dimension exactly; a second one adds up the outer products of the centred vectors, a matrix per task, matrix rows added
in Spark. The driver sees one d x d matrix: Householder reflections make it tridiagonal, bisection on Sturm counts finds
the leading eigenvalues, inverse iteration their vectors (those of close eigenvalues are kept orthogonal in every step),
and the reflections carry them back. Components and means are broadcast (d x k numbers) to project all vectors; a pass
over the projections measures how far their covariance is from the identity.

Nulls: a null vector and one with a null or non-finite entry is left out. Vectors of another length than the most
frequent one (ties: the shortest; never 0) are left out too; the length bounds what the driver holds. Null ids, repeated
rows and further columns are kept as they are. Entries beyond +-2^52 after scaling count as +-2^52. Components whose
eigenvalue is no more than rounding noise of the largest cannot be whitened and are left out, so that equal vectors, a
single vector and an empty table give no components. Components of equal eigenvalues are any orthonormal basis of
their space. A deviation beyond 64 bits is null.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from fractions import Fraction
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from adinsight.llm.common import packed, table, unpacked

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SCALE, SHIFT = 1024, 100_000
LARGEST = 1 << 52
#: Sums of whole numbers are kept in two parts of this many low bits, so that none can overflow.
_LOW = 26
#: Rows that are multiplied together.
TOGETHER = 4096
_EPS = float(np.finfo(float).eps)


# --- eigenvalues and eigenvectors of a symmetric matrix --------------------------------------------------------------

def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, off-diagonal and unit Householder vectors (the k-th acts on the coordinates after k)."""
    a = np.array(matrix, float)
    n, reflectors = len(a), []
    for k in range(n - 2):
        x = a[k + 1 :, k]
        length = np.linalg.norm(x)
        v = x.copy()
        v[0] += length if x[0] >= 0 else -length
        size = np.linalg.norm(v)
        v = v / size if size else v
        reflectors.append(v)
        rest = a[k + 1 :, k + 1 :]
        p = rest @ v
        w = p - (v @ p) * v
        rest -= 2 * (np.outer(v, w) + np.outer(w, v))
        a[k + 1 :, k] -= 2 * (v @ a[k + 1 :, k]) * v
        a[k, k + 1 :] = a[k + 1 :, k]
    return np.diagonal(a).copy(), np.diagonal(a, 1).copy(), reflectors


def below(diagonal: np.ndarray, off: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Sturm counts: how many eigenvalues lie below each x."""
    squares = np.concatenate([[0.0], off * off])
    least = max(np.finfo(float).tiny, _EPS * _EPS * float(squares.max(initial=0.0)))
    q, count = np.ones_like(x), np.zeros(len(x), np.int64)
    for d, s in zip(diagonal, squares):
        q = (d - x) - s / q
        q = np.where(np.abs(q) < least, -least, q)
        count += q < 0
    return count


def leading_values(diagonal: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The k largest eigenvalues, falling, by bisection between Gershgorin's bounds."""
    n = len(diagonal)
    radius = np.concatenate([[0.0], np.abs(off)]) + np.concatenate([np.abs(off), [0.0]])
    margin = _EPS * n * float(np.abs(diagonal).max() + radius.max()) + np.finfo(float).tiny
    low = np.full(k, float((diagonal - radius).min()) - margin)
    high = np.full(k, float((diagonal + radius).max()) + margin)
    rank = n - 1 - np.arange(k)  # the i-th largest has this many below it
    while True:
        middle = (low + high) / 2
        if ((middle <= low) | (middle >= high)).all():
            return middle
        up = below(diagonal, off, middle) <= rank
        low, high = np.where(up, middle, low), np.where(up, high, middle)


def _solve(diagonal: np.ndarray, off: np.ndarray, shift: float, right: np.ndarray, least: float) -> np.ndarray:
    """(T - shift) y = right by elimination with row exchanges; vanishing pivots become ``least``."""
    n = len(diagonal)
    rows = [[float(diagonal[i]) - shift, float(off[i]) if i + 1 < n else 0.0, 0.0] for i in range(n)]
    y = right.tolist()
    for i in range(n - 1):
        lead, (next_lead, next_mid, next_end) = rows[i][0], (float(off[i]), rows[i + 1][0], rows[i + 1][1])
        if abs(next_lead) > abs(lead):
            rows[i], rows[i + 1] = [next_lead, next_mid, next_end], [lead, rows[i][1], rows[i][2]]
            y[i], y[i + 1] = y[i + 1], y[i]
        else:
            rows[i + 1] = [next_lead, next_mid, next_end]
        if abs(rows[i][0]) < least:
            rows[i][0] = least
        factor = rows[i + 1][0] / rows[i][0]
        rows[i + 1] = [rows[i + 1][1] - factor * rows[i][1], rows[i + 1][2] - factor * rows[i][2], 0.0]
        y[i + 1] -= factor * y[i]
    if abs(rows[-1][0]) < least:
        rows[-1][0] = least
    for i in range(n - 1, -1, -1):
        value = y[i] - (rows[i][1] * y[i + 1] if i + 1 < n else 0.0) - (rows[i][2] * y[i + 2] if i + 2 < n else 0.0)
        y[i] = value / rows[i][0]
    return np.array(y)


def leading_vectors(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors as columns, by inverse iteration; a cluster is made orthogonal after every step."""
    n, norm = len(diagonal), float(np.abs(diagonal).max(initial=0.0) + 2 * np.abs(off).max(initial=0.0)) or 1.0
    start, vectors, cluster = np.random.default_rng(1), np.zeros((n, len(values))), 0
    for j, value in enumerate(values):
        if j and values[j - 1] - value > 1e-3 * norm:
            cluster = j
        shift = value - (j - cluster) * 2 * _EPS * norm
        y = start.standard_normal(n)
        for _ in range(6):
            y = _solve(diagonal, off, shift, y / np.abs(y).max(), _EPS * norm)
            y /= np.abs(y).max()
            for _ in range(2):
                near = vectors[:, cluster:j]
                y = y - near @ (near.T @ y)
            y /= np.linalg.norm(y)
        vectors[:, j] = y
    return vectors


def leading_pairs(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues of a symmetric matrix, falling, and their unit vectors as columns.

    The largest entry of a vector (the first of equal ones) is positive.
    """
    scale = float(np.abs(matrix).max(initial=0.0))
    k = min(k, len(matrix))
    if not scale or not k:
        return np.zeros(0), np.zeros((len(matrix), 0))
    diagonal, off, reflectors = tridiagonal(matrix / scale)
    vectors = leading_vectors(diagonal, off, leading_values(diagonal, off, k))
    for at in range(len(reflectors) - 1, -1, -1):
        v = reflectors[at]
        vectors[at + 1 :] -= 2 * np.outer(v, v @ vectors[at + 1 :])
    for j in range(k):  # orthogonal to the last bit, the leading ones first
        for _ in range(2):
            vectors[:, j] -= vectors[:, :j] @ (vectors[:, :j].T @ vectors[:, j])
        vectors[:, j] /= np.linalg.norm(vectors[:, j])
    values = np.einsum("ij,ij->j", vectors, matrix @ vectors)
    order = np.argsort(-values, kind="stable")
    values, vectors = values[order], vectors[:, order]
    top = vectors[np.abs(vectors).argmax(0), np.arange(k)]
    return values, vectors * np.where(top < 0, -1.0, 1.0)


# --- passes over the vectors -----------------------------------------------------------------------------------------

def whole_numbers(column: pa.Array) -> tuple[np.ndarray, dict[int, tuple[np.ndarray, np.ndarray]]]:
    """Lengths of the usable vectors (-1 for others), and for each length their rows and a matrix of whole numbers."""
    lengths = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    values = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    ends = np.cumsum(np.maximum(lengths, 0))
    odd = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    starts = ends - np.maximum(lengths, 0)
    lengths[(odd[ends] > odd[starts]) | (lengths == 0)] = -1
    out = {}
    for d in np.unique(lengths[lengths > 0]).tolist():
        rows = np.flatnonzero(lengths == d)
        with np.errstate(over="ignore"):
            x = np.floor(SCALE * values[starts[rows][:, None] + np.arange(d)])
        out[d] = rows, np.clip(x, -LARGEST, LARGEST).astype(np.int64) + SHIFT
    return lengths, out


def _summed(parts: DataFrame, size: int) -> np.ndarray:
    """The sum of matrices given as rows (i, part, line): each line in one task, in the order of the parts."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, line in zip(batch.column(0).to_pylist(), batch.column(1)):
                line = line.values.to_numpy()
                lines[i] = lines[i] + line if i in lines else line
        for i, line in lines.items():
            yield pa.RecordBatch.from_pydict({"i": pa.array([i], pa.int32()), "line": pa.array([line], pa.list_(pa.float64()))})

    rows = parts.repartition(min(size, 16), "i").sortWithinPartitions("i", "part").select("i", "line")
    out = np.zeros((size, size))
    for row in rows.mapInArrow(add, "i int, line array<double>").collect():  # size x size numbers
        out[row.i] = row.line
    return out


def _lines(matrix: np.ndarray) -> pa.RecordBatch:
    part = TaskContext.get().partitionId()
    return pa.RecordBatch.from_pydict({"i": pa.array(range(len(matrix)), pa.int32()), "part": pa.array([part] * len(matrix), pa.int32()),
                                       "line": pa.array(list(matrix), pa.list_(pa.float64()))})


class Whitening(NamedTuple):
    """A fitted whitening; its size depends on the length of the vectors only."""

    n: int
    sums: list[int]  # of the whole numbers, by dimension
    values: np.ndarray  # eigenvalues, falling
    vectors: np.ndarray  # d x k
    trace: float
    identity_error: float | None  # None without components

    @property
    def explained(self) -> np.ndarray:
        return self.values / self.trace if self.trace else self.values


class _Centre(NamedTuple):
    """What centres whole numbers: x - base - rest, with a whole base."""

    base: np.ndarray
    rest: np.ndarray

    @classmethod
    def of(cls, n: int, sums: list[int]) -> _Centre:
        base = [s // n for s in sums]
        return cls(np.array(base, np.int64), np.array([float(Fraction(s, n) - b) for s, b in zip(sums, base)]))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return (x - self.base) - self.rest


def _sums(vectors: DataFrame) -> tuple[int, list[int]]:
    """Count and exact sums of the vectors (v) of the most frequent length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        for batch in batches:
            for d, (rows, x) in whole_numbers(batch.column(0))[1].items():
                so_far = found.setdefault(d, [0, np.zeros(d, np.int64), np.zeros(d, np.int64)])
                so_far[0] += len(rows)
                so_far[1] += (x >> _LOW).sum(0)
                so_far[2] += (x & ((1 << _LOW) - 1)).sum(0)
        for d, (n, high, low) in found.items():
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_pydict({"d": pa.array([d], pa.int32()), "n": pa.array([n], pa.int64()), "high": pa.array([high], longs),
                                              "low": pa.array([low], longs)})

    parts = vectors.mapInArrow(run, "d int, n long, high array<long>, low array<long>")
    spread = parts.select("d", F.posexplode(F.arrays_zip(F.transform("high", lambda _: F.col("n")).alias("n"), "high", "low")).alias("i", "s"))
    exact = "decimal(38,0)"
    by_place = spread.groupBy("d", "i").agg(F.sum("s.n").alias("n"), F.sum(F.col("s.high").cast(exact)).alias("high"), F.sum(F.col("s.low").cast(exact)).alias("low"))
    # of equally frequent lengths the shortest; its d rows go to the driver
    chosen = by_place.groupBy("d").agg(F.max("n").alias("n"), F.collect_list(F.struct("i", "high", "low")).alias("sums")).orderBy(F.desc("n"), "d").first()
    if chosen is None:
        return 0, []
    return chosen.n, [(int(s.high) << _LOW) + int(s.low) for s in sorted(chosen.sums)]


def _covariance(vectors: DataFrame, n: int, d: int, centre: _Centre) -> np.ndarray:
    shared = vectors.sparkSession.sparkContext.broadcast(centre)  # d numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, centre = np.zeros((d, d)), shared.value
        for batch in batches:
            x = whole_numbers(batch.column(0))[1].get(d)
            for start in range(0, len(x[0]) if x else 0, TOGETHER):
                c = centre(x[1][start : start + TOGETHER])
                total += c.T @ c
        if total.any():
            yield _lines(total)

    matrix = _summed(vectors.mapInArrow(run, "i int, part int, line array<double>"), d) / n
    return (matrix + matrix.T) / 2


def _distance_from_identity(vectors: DataFrame, n: int, d: int, centre: _Centre, basis: np.ndarray) -> float:
    """The largest entry of (covariance of the projections - identity), measured on all vectors."""
    shared, k = vectors.sparkSession.sparkContext.broadcast((centre, basis)), basis.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, basis = shared.value
        total = np.zeros((k + 1, k + 1))  # the last line sums the projections
        for batch in batches:
            x = whole_numbers(batch.column(0))[1].get(d)
            for start in range(0, len(x[0]) if x else 0, TOGETHER):
                w = centre(x[1][start : start + TOGETHER]) @ basis
                w = np.column_stack([w, np.ones(len(w))])
                total += w.T @ w
        if total.any():
            yield _lines(total)

    total = _summed(vectors.mapInArrow(run, "i int, part int, line array<double>"), k + 1) / n
    mean = total[k, :k]
    return float(np.abs(total[:k, :k] - np.outer(mean, mean) - np.eye(k)).max())


def fit(vectors: DataFrame, vector_col: str = "embedding", components: int = 8) -> Whitening:
    """The whitening of all usable vectors with up to ``components`` components."""
    vectors = vectors.select(F.col(vector_col).alias("v"))
    n, sums = _sums(vectors)
    d = len(sums)
    if not n:
        return Whitening(0, [], np.zeros(0), np.zeros((0, 0)), 0.0, None)
    centre = _Centre.of(n, sums)
    matrix = _covariance(vectors, n, d, centre)
    values, basis = leading_pairs(matrix, components)
    kept = values > 8 * d * _EPS * values.max(initial=0.0)
    values, basis = values[kept], basis[:, kept]
    error = _distance_from_identity(vectors, n, d, centre, basis / np.sqrt(values)) if len(values) else None
    return Whitening(n, sums, values, basis, float(np.trace(matrix)), error)


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Per row the exact sum of (n x - sum)^2, None beyond 64 bits."""
    if not len(x):
        return []
    largest = n * int(np.abs(x).max()) + max(map(abs, sums))
    if largest < 1 << 62:
        away = n * x - np.array(sums, np.int64)
        if int(np.abs(away).max()) ** 2 * x.shape[1] < 1 << 63:
            return (away * away).sum(1).tolist()
        away = away.astype(object)
    else:
        away = n * x.astype(object) - np.array(sums, object)
    return [int(s) if s < 1 << 63 else None for s in (away * away).sum(1)]


def whiten(vectors: DataFrame, model: Whitening, vector_col: str = "embedding", whitened: str = "whitened", deviation: str = "deviation") -> DataFrame:
    """The usable rows of ``vectors`` with an array of their projections over the square roots of the eigenvalues, and
    with their squared distance from the sums."""
    d, basis = len(model.sums), model.vectors / np.sqrt(model.values)
    centre = _Centre.of(model.n, model.sums) if model.n else None
    shared = vectors.sparkSession.sparkContext.broadcast((centre, basis, model.n, model.sums))  # d x k numbers
    rows = packed(vectors, vector_col).select("text", "rest")
    schema = T.StructType([*rows.schema, T.StructField("w", T.ArrayType(T.DoubleType())), T.StructField("d", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, basis, n, sums = shared.value
        for batch in batches:
            found = whole_numbers(batch.column(0))[1].get(d) if n else None
            if found is None:
                continue
            kept, x = batch.take(pa.array(found[0])), found[1]
            for start in range(0, len(x), TOGETHER):
                part = x[start : start + TOGETHER]
                w = centre(part) @ basis
                ends = np.arange(0, w.size + 1, w.shape[1] or 1, dtype=np.int32) if w.shape[1] else np.zeros(len(part) + 1, np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(w.ravel()))
                rows = kept.slice(start, len(part))
                yield pa.RecordBatch.from_arrays([*rows.columns, lists, pa.array(deviations(part, n, sums), pa.int64())],
                                                 names=[*rows.schema.names, "w", "d"])

    out = rows.mapInArrow(run, schema)
    return out.select(*unpacked(out, vectors, vector_col), F.col("w").alias(whitened), F.col("d").alias(deviation))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight whitened components of every usable vector, a row each."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    model = fit(vectors)
    rows = whiten(vectors, model).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    share = F.element_at(F.array(*map(F.lit, model.explained.tolist())), F.col("at") + 1) if len(model.values) else F.lit(None).cast("double")
    return rows.select("vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
                       share.alias("explained"), F.lit(model.identity_error).cast("double").alias("identity_error"))
