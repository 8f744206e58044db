"""Whitening of vectors: their principal components at unit variance, by MLlib's singular values of centred rows.

1. Entries become whole numbers x = floor(scale * c) + shift, so counts and sums per dimension are exact.
2. A task turns a row into its deviation, the exact sum of (n * x - sum)^2 over dimensions, and the centred
   vector (n * x - sum) / n.
3. ``RowMatrix.computeSVD`` of the centred rows gives singular values s and right vectors; s^2 / n are the
   eigenvalues of the covariance with divisor n. Its Gram matrix is summed up on the executors.
4. The total variance doesn't come from these: it is the sum of all deviations over n^3.
5. A whitened row is the centred one on the components, over the roots of their eigenvalues. The covariance of
   all whitened rows is summed up in tasks, after their means, and compared with the identity.

The driver holds sums per dimension and matrices of dimension by dimension, and nothing that grows with the rows.

Nulls, empties, ties: a vector that is null, empty, or holds null or non-finite entries is dropped, as are vectors of
another length than the most frequent one (of several, the longest); a null or repeated id is a row of its own; equal
eigenvalues give some basis of their space. Components whose eigenvalue is below ``LEAST`` of the first have no variance
to scale and are left out, so equal vectors, one vector, or none give no rows. An entry beyond 2^62 counts as 2^62, and a
deviation beyond 63 bits is null. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
#: Least eigenvalue as a share of the first.
LEAST = 1e-10
_FAR = float(1 << 62)


def entries(vectors: DataFrame, *, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """vec_id and x, whole numbers, of the vectors that can be used."""
    given = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("c"))
    odd = F.exists("c", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    bounded = F.transform("c", lambda c: F.floor(F.greatest(F.least(c * scale, F.lit(_FAR)), F.lit(-_FAR))).cast("long") + shift)
    return given.filter(F.col("c").isNotNull() & (F.size("c") > 0) & ~odd).select("vec_id", bounded.alias("x"))


def deviations(x: np.ndarray, n: int, sums: list[int]) -> tuple[list[int | None], np.ndarray]:
    """Exact sums of squares of n * x - sum by row, null beyond 63 bits, and the differences over n."""
    if max(map(abs, sums), default=0) < 1 << 61 and int(np.abs(x).max(initial=0)) * n < 1 << 61:
        d = x * np.int64(n) - np.array(sums, np.int64)
        most = int(np.abs(d).max(initial=0))
        if most * most * x.shape[1] < 1 << 63:
            return (d * d).sum(axis=1).tolist(), d / n
    d = x.astype(object) * n - np.array(sums, object)
    squares = (d * d).sum(axis=1)
    return [int(s) if s < 1 << 63 else None for s in squares], (d / n).astype(float)


def _centred(batches: Iterator[pa.RecordBatch], n: int, sums: list[int]) -> Iterator[pa.RecordBatch]:
    size = len(sums)
    for whole in batches:
        for batch in common.rows_of([whole]):
            deviation, rows = deviations(batch["x"].flatten().to_numpy(zero_copy_only=False).reshape(-1, size), n, sums)
            yield pa.RecordBatch.from_arrays([batch["vec_id"], pa.array(deviation, pa.int64()), _lists(rows)], ["vec_id", "deviation", "centred"])


def _lists(x: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), pa.array(x.ravel()))


def _matrix(column: pa.ListArray, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def _projected(batches: Iterator[pa.RecordBatch], onto: np.ndarray) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in common.rows_of([whole]):
            yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["deviation"], _lists(_matrix(batch["centred"], onto.shape[0]) @ onto)], ["vec_id", "deviation", "whitened"])


def _summed(batches: Iterator[pa.RecordBatch], size: int, means: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """A task's sums by component, or with ``means`` its sums of products of what is left without them."""
    total = np.zeros(size if means is None else (size, size))
    for batch in batches:
        w = _matrix(batch["whitened"], size)
        total += w.sum(axis=0) if means is None else (w - means).T @ (w - means)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], ["at", "value"])


def covariance(whitened: DataFrame, size: int, n: int) -> np.ndarray:
    """Of all rows, divisor n, centred before they are multiplied."""

    def sums(means: np.ndarray | None) -> np.ndarray:
        told = whitened.select("whitened").mapInArrow(lambda it: _summed(it, size, means), "at long, value double")
        found = dict(map(tuple, told.groupBy("at").agg(F.sum("value")).collect()))
        return np.array([found.get(i, 0.0) for i in range(size if means is None else size * size)]) / n

    return sums(sums(None)).reshape(size, size)


def principal(centred: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of the covariance, falling, and unit eigenvectors as columns."""
    rows = MLUtils.convertVectorColumnsFromML(centred.select(array_to_vector("centred").alias("row")), "row")
    found = RowMatrix(rows).computeSVD(centred.select(F.size("centred")).first()[0], computeU=False, rCond=LEAST**0.5)
    return found.s.toArray() ** 2 / n, found.V.toArray()


SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, *, components: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """A row for each usable row of ``vectors`` (vec_id, embedding) and component.

    vec_id, component (from 1), n, deviation, whitened, explained (the component's share of the total variance) and
    identity_error (the largest difference of the whitened rows' covariance from the identity).
    """
    spark = vectors.sparkSession
    made = common.materialize(entries(vectors, scale=scale, shift=shift), "entries")
    sizes = made.groupBy(F.size("x").alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("size")).first()
    if sizes is None:
        return spark.createDataFrame([], SCHEMA)
    size, n = sizes["size"], sizes["n"]
    fit = made.filter(F.size("x") == size)
    summed = fit.select(F.posexplode("x").alias("at", "x")).groupBy("at").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("sum"))
    found = dict(map(tuple, summed.collect()))  # a row for each dimension
    sums = [int(found[i]) for i in range(size)]
    centred = common.materialize(fit.mapInArrow(lambda it: _centred(it, n, sums), "vec_id long, deviation long, centred array<double>"), "centred")
    exact, beyond, rough = centred.agg(
        F.sum(F.col("deviation").cast("decimal(38,0)")),
        F.count_if(F.col("deviation").isNull()),
        F.sum(F.when(F.col("deviation").isNull(), F.aggregate("centred", F.lit(0.0), lambda s, c: s + c * c))),
    ).first()
    total = int(exact or 0) / n**3 + (rough or 0.0) / n if beyond else int(exact) / n**3
    if not total:
        return spark.createDataFrame([], SCHEMA)
    values, onto = principal(centred, n)
    k = min(components, len(values))
    onto = onto[:, :k] / np.sqrt(values[:k])
    kept = common.materialize(centred.mapInArrow(lambda it: _projected(it, onto), "vec_id long, deviation long, whitened array<double>"), "whitened")
    error = float(np.abs(covariance(kept, k, n) - np.eye(k)).max())
    common.release(made, centred)
    share = F.array(*[F.lit(float(v / total)) for v in values[:k]])
    each = kept.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return each.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", share[F.col("at")].alias("explained"), F.lit(error).alias("identity_error"))
