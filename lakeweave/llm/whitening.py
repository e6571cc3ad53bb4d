"""Whitening of embeddings by shifted CholeskyQR.

Vectors become whole numbers ``x = floor(scale * c)``. The *fit list* has each distinct ``x`` once, written to the shared folder. Its centred rows are
a tall matrix that is never held anywhere: every pass over it gives one Gram matrix, summed by Spark from one partial product per task. The
driver factors that small matrix:

1. ``G = X'X``; ``R1`` is the Cholesky factor of ``G + s I``. The shift ``s`` makes it exist however badly conditioned ``X`` is.
2. The next passes solve each row against the factors found so far, ``Q = X R1^-1 R2^-1 ...``, and take the Gram matrix of that. What ``Q`` lacks in
   orthogonality is the next factor, until there is none. Directions in which ``X`` has nothing show after the first pass and are left out.
3. ``R = ... R2 R1`` has the singular values and right vectors of ``X``, without the squaring that an eigenvalue solver on ``G`` would suffer from.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeweave.llm.common import materialize

#: Passes after the shifted one, at most; two are enough unless rounding gets in the way.
PASSES = 5
#: What may be missing from an orthonormal Q before another pass is made.
ORTHOGONAL = 1e-13
#: A direction of the shifted Q that holds less than this is empty.
EMPTY = 1e-12
UNIT = np.finfo(np.float64).eps / 2
#: Rows that a task works on at a time.
ROWS = 4096


@dataclass
class Whitening:
    """A fitted whitening: ``n`` and ``sums`` of the fit list, components as rows of unit length, their eigenvalues, the trace of the covariance."""

    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    identity_error: float


def whole_vectors(table: DataFrame, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, x``: the vectors as whole numbers. Null and empty vectors, and those that hold a null or non-finite entry, are left out.

    So are vectors of another length than the most frequent one (of equally frequent lengths the longer one counts), since no covariance joins them.
    """
    vector = F.col(f"`{vector_col}`").cast("array<double>")
    sound = table.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), vector.alias("v")).where(
        F.col("v").isNotNull() & (F.size("v") > 0) & ~F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    )
    lengths = sound.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    length = lengths[0].d if lengths else 0
    return sound.where(F.size("v") == length).select("vec_id", F.transform("v", lambda c: F.floor(c * scale)).alias("x"))


def _matrix(batch: pa.RecordBatch, name: str) -> np.ndarray:
    column = batch.column(batch.schema.get_field_index(name))
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1 if len(column) else 0)


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x - S / n."""
    return x.astype(np.float64) - sums / n


def _mapped(rows: np.ndarray, steps: list[tuple[str, np.ndarray]]) -> np.ndarray:
    """Rows after each step: ``solve`` takes them times the inverse of a triangular factor, ``times`` multiplies."""
    for kind, factor in steps:
        rows = np.linalg.solve(factor.T, rows.T).T if kind == "solve" else rows @ factor
    return rows


def gram(fit: DataFrame, n: int, sums: np.ndarray, steps: list[tuple[str, np.ndarray]]) -> np.ndarray:
    """Q'Q for Q = the centred rows of ``fit`` after ``steps``. Tasks send a matrix each, row by row; Spark adds them up by row."""

    def partial(batches):
        total = None
        for batch in batches:
            rows = _matrix(batch, "x")
            for a in range(0, len(rows), ROWS):
                q = _mapped(_centred(rows[a : a + ROWS], n, sums), steps)
                total = q.T @ q if total is None else total + q.T @ q
        if total is not None:
            yield pa.RecordBatch.from_pydict({"row": pa.array(range(len(total)), pa.int32()), "values": pa.array(list(total), pa.list_(pa.float64()))})

    def added(key, table):
        values = table.column("values").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(table), -1)
        return pa.table({"row": pa.array([key[0].as_py()], pa.int32()), "values": pa.array([values.sum(axis=0)], pa.list_(pa.float64()))})

    shape = "row int, values array<double>"
    parts = fit.select("x").mapInArrow(partial, shape)
    rows = parts.groupBy("row").applyInArrow(added, shape).orderBy("row").collect()
    matrix = np.array([r["values"] for r in rows])
    return (matrix + matrix.T) / 2


def _moments(fit: DataFrame) -> tuple[int, list[int]]:
    """Rows of the fit list and the exact sum of each dimension: tasks send one partial sum per dimension, as text where a long may not hold it."""

    def partial(batches):
        n, total = 0, None
        for batch in batches:
            rows = _matrix(batch, "x")
            if len(rows):
                high, low = (rows >> 32).sum(axis=0), (rows & 0xFFFFFFFF).sum(axis=0)
                own = [int(h) * (1 << 32) + int(w) for h, w in zip(high, low, strict=True)]
                total = own if total is None else [a + b for a, b in zip(total, own, strict=True)]
                n += len(rows)
        if n:
            yield pa.RecordBatch.from_pydict({"dim": pa.array(range(len(total)), pa.int32()), "n": pa.array([n] * len(total), pa.int64()), "s": pa.array([str(s) for s in total])})

    parts = fit.select("x").mapInArrow(partial, "dim int, n long, s string")
    rows = parts.groupBy("dim").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).orderBy("dim").collect()
    return (rows[0].n, [int(r.s) for r in rows]) if rows else (0, [])


def shifted_cholesky_qr(fit: DataFrame, n: int, sums: np.ndarray) -> tuple[np.ndarray, float]:
    """The composed factor R of the centred rows (rank x dimensions), and the sum of their squares."""
    first = gram(fit, n, sums, [])
    d, square = len(first), float(np.trace(first))
    if square <= 0:
        return np.zeros((0, d)), 0.0
    shift = 11 * (n * d + d * (d + 1)) * UNIT * square
    r = np.linalg.cholesky(first + shift * np.eye(d)).T
    steps = [("solve", r)]
    for k in range(PASSES):
        own = gram(fit, n, sums, steps)
        if not k:
            values, vectors = np.linalg.eigh(own)
            full = vectors[:, values > EMPTY]
            if full.shape[1] < d:
                # Rows have nothing outside these directions: X = (Q W) (W' R).
                steps.append(("times", full))
                r, own = full.T @ r, full.T @ own @ full
        if np.abs(own - np.eye(len(own))).max() <= ORTHOGONAL:
            break
        step = np.linalg.cholesky(own).T
        steps.append(("solve", step))
        r = step @ r
    return r, square


def fit_whitening(table: DataFrame, most: int = 4, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, Whitening | None]:
    """The whole-number vectors and the whitening fitted on the distinct ones; None if there is no row.

    Components without variance are left out, so there are at most as many as dimensions that vary independently.
    """
    vectors = whole_vectors(table, scale, id_col, vector_col)
    fit = materialize(vectors.select("x").distinct(), "fit_list")
    n, exact = _moments(fit)
    if not n:
        return vectors, None
    sums = np.array([float(s) for s in exact])
    r, square = shifted_cholesky_qr(fit, n, sums)
    _, sizes, components = np.linalg.svd(r, full_matrices=False)
    count = min(most, len(sizes))
    components, values = components[:count], sizes[:count] ** 2 / n
    error = 0.0
    if count:
        whitener = components.T / np.sqrt(values)
        own = gram(fit, n, sums, [("times", whitener)])
        error = float(np.abs(own / n - np.eye(count)).max())
    return vectors, Whitening(n, exact, components, values, square / n, error)


def _deviation(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over dimensions of (n x - S)^2, exact; None where 64 bits do not hold it."""
    rough = ((x.astype(np.float64) * n - np.array([float(s) for s in sums])) ** 2).sum(axis=1)
    if max(abs(s) for s in sums) < 2**62 and rough.max(initial=0) < 2**62 and float(np.abs(x).max(initial=0)) * n < 2**62:
        return ((x * n - np.array(sums, dtype=np.int64)) ** 2).sum(axis=1).tolist()
    exact = [sum((n * v - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in x.tolist()]
    return [v if v < 2**63 else None for v in exact]


def whiten(table: DataFrame, most: int = 4, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row for each vector and component: ``vec_id, component, n, deviation, whitened, explained, identity_error``.

    Repeated rows and null or repeated ids are kept, each for itself; equal vectors count once in the fit. Vectors that ``whole_vectors`` leaves out have no
    row. Neither has any vector if there is no variance at all: an empty table, or equal vectors only. ``deviation`` is null where it does not fit into 64 bits.
    """
    vectors, fitted = fit_whitening(table, most, scale, id_col, vector_col)
    shape = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if fitted is None or not len(fitted.components):
        return table.sparkSession.createDataFrame([], shape)
    n, sums, error = fitted.n, fitted.sums, fitted.identity_error
    whitener = fitted.components.T / np.sqrt(fitted.eigenvalues)
    explained = fitted.eigenvalues / fitted.trace
    count = len(explained)

    def project(batches):
        mean = np.array([float(s) for s in sums])
        for batch in batches:
            x = _matrix(batch, "x")
            if not len(x):
                continue
            places = np.repeat(np.arange(len(x)), count)
            yield pa.RecordBatch.from_pydict(
                {
                    "vec_id": batch.column(0).take(pa.array(places)),
                    "component": pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), len(x))),
                    "n": pa.array([n] * len(places), pa.int64()),
                    "deviation": pa.array(_deviation(x, n, sums), pa.int64()).take(pa.array(places)),
                    "whitened": pa.array((_centred(x, n, mean) @ whitener).ravel()),
                    "explained": pa.array(np.tile(explained, len(x))),
                    "identity_error": pa.array(np.full(len(places), error)),
                }
            )

    return vectors.select("vec_id", "x").mapInArrow(project, shape)
