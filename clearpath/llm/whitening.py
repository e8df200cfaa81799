"""Whitening of embeddings by two passes for an exact mean and a centred covariance.

An entry c becomes the integer x = floor(64 * c) + 1000000. The *fit list* holds each distinct
integer vector once. Pass one sums it exactly, in integers. Pass two centres before it
multiplies: n * x - S is exact, its quotient by n is rounded once, and a task's vectors
give one product of matrices (NumPy GEMM). Tasks' sums meet in ``treeAggregate``, so no more
than a few d x d matrices are at one place. LAPACK's symmetric ``eigh`` on the driver (d x d)
gives the components; the projection (d x 16 numbers) is sent to all tasks. A third pass
over the fit list measures how far the whitened covariance is from the identity.

Scale: one shuffle, of integer vectors, which copies leave before it (partial aggregation);
all else are scans with sums of d * d numbers a task. What is broadcast or gathered grows
with the square of the dimension, never with the rows.

Defined cases: rows whose vector is null, empty or holds null or non-finite entries are
dropped, and so are vectors shorter than the table's longest. 64 * c is limited to 2**61 either way so that x is
a long. Repeated rows are whitened each and count once in the fit. Null ids stay. A component
without variance (e at most 1e-12 of the largest) cannot be whitened: its ``whitened`` is
null, and it takes no part in the identity; with no variance at all ``explained`` and
``identity_error`` are null. A deviation that is no long is null. Other columns are
not read. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table

COMPONENTS = 16
SCALE, SHIFT, LIMIT = 64.0, 1_000_000, 2.0**61
#: Rows whose integers and products a task holds at a time.
ROWS = 4096
RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def finite(vector: str) -> F.Column:
    """Whether a vector is there and all its entries are finite numbers."""
    return F.col(vector).isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))


def integers(vector: str) -> F.Column:
    within = lambda x: F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), x.cast("double") * SCALE))
    return F.transform(vector, lambda x: F.floor(within(x)) + F.lit(SHIFT).cast("long"))


def matrices(batches, column: int, d: int):
    """The batches' vectors as matrices of ``d`` columns and some rows."""
    for batch in batches:
        x = batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
        for at in range(0, len(x), ROWS):
            yield x[at : at + ROWS]


def exact_sums(x: np.ndarray) -> list[int]:
    """Sums of the columns of an integer matrix, whatever their size."""
    if x.size and int(np.abs(x).max()) > 2**62 // len(x):
        x = x.astype(object)
    return [int(s) for s in x.sum(axis=0)]


def off_centre(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, exactly: as longs if they hold it."""
    most = max(int(np.abs(x).max()) if x.size else 0, max(abs(s) for s in sums) // max(n, 1) + 1)
    kind = np.int64 if n * most < 2**61 else object
    return x.astype(kind) * n - np.array(sums, dtype=kind)


def deviations(off: np.ndarray) -> list[int | None]:
    """Sum of squares of each row, exactly; null beyond a long."""
    if off.dtype != object and off.size and int(np.abs(off).max()) ** 2 * off.shape[1] >= 2**63:
        off = off.astype(object)
    return [int(s) if s < 2**63 else None for s in (off * off).sum(axis=1)]


def total(parts: DataFrame, zero: np.ndarray) -> np.ndarray:
    """The sum of the partial sums (bytes of doubles) of all tasks, merged in a tree."""
    read = parts.rdd.map(lambda r: np.frombuffer(r[0], np.float64).reshape(zero.shape))
    return read.treeAggregate(zero, lambda a, b: a + b, lambda a, b: a + b)


def centred_products(fit: DataFrame, n: int, sums: list[int], project: np.ndarray | None = None) -> np.ndarray:
    """Covariance (divisor n) of the centred vectors of ``fit``, or of their projections."""
    d = len(sums)
    side = d if project is None else project.shape[1]

    def run(batches):
        v = np.zeros((side, side))
        for x in matrices(batches, 0, d):
            y = off_centre(x, n, sums).astype(np.float64) / n
            y = y if project is None else y @ project
            v += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary())], names=["part"])

    return total(fit.mapInArrow(run, "part binary"), np.zeros((side, side))) / n


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """``vectors``: vec_id, embedding. A row for each vector that takes part and each
    component, as the module says; eigenvalue 1 is the largest."""
    rows = vectors.select("vec_id", F.col("embedding").alias("v")).filter(finite("v"))
    d = rows.agg(F.max(F.size("v"))).first()[0]
    if d is None:
        return vectors.sparkSession.createDataFrame([], RESULT)
    rows = rows.filter(F.size("v") == d).select("vec_id", integers("v").alias("x"))
    fit = materialize(rows.select("x").distinct(), "fit-list")

    def summed(batches):
        n, sums = 0, [0] * d
        for x in matrices(batches, 0, d):
            n, sums = n + len(x), [a + b for a, b in zip(sums, exact_sums(x), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([[str(s) for s in sums]], pa.list_(pa.string()))], names=["n", "sums"])

    add = lambda a, b: (a[0] + b[0], [x + y for x, y in zip(a[1], b[1], strict=True)])
    parts = fit.mapInArrow(summed, "n long, sums array<string>").rdd.map(lambda r: (r[0], [int(s) for s in r[1]]))
    n, sums = parts.treeAggregate((0, [0] * d), add, add)

    covariance = centred_products(fit, n, sums)
    values, directions = np.linalg.eigh((covariance + covariance.T) / 2)
    values, directions = values[::-1][:components], directions[:, ::-1][:, :components]
    largest = np.abs(directions).argmax(axis=0)
    directions = directions * np.sign(directions[largest, np.arange(len(values))])  # one sign wherever it is worked out
    whole, some = float(np.trace(covariance)), values > 1e-12 * max(float(values[0]), 0.0)
    project = directions / np.sqrt(np.where(some, values, 1.0))
    error = float(np.abs(centred_products(fit, n, sums, project[:, some]) - np.eye(int(some.sum()))).max()) if some.any() else None
    explained = [float(e) / whole if whole > 0 else None for e in values]
    k = len(values)

    def whitened(batches):
        for batch in batches:
            at = 0
            for x in matrices([batch], 1, d):
                off, ids = off_centre(x, n, sums), batch.column(0).slice(at, len(x))
                at += len(x)
                each = np.repeat(np.arange(len(x)), k)
                value = ((off.astype(np.float64) / n) @ project).ravel()
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(each), n, np.int64)), pa.array(deviations(off), pa.int64()).take(pa.array(each)),
                        pa.array(value, mask=~np.tile(some, len(x))), pa.array(explained * len(x), pa.float64()), pa.array([error] * len(each), pa.float64()),
                    ],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), "x").mapInArrow(whitened, RESULT)


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
