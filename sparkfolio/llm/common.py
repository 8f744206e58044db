"""Shared storage, column and batch helpers of the training-data operators."""

from __future__ import annotations

import atexit
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import storage

_cleared: set[str] = set()


def work_dir(spark: SparkSession) -> str:
    """The session's folder for intermediate tables, in the folder that all executors share.

    It is removed when the driver's Python ends, or before by ``clear``.
    """
    path = f"{storage.shared_dir(spark)}/sparkfolio/llm-{spark.sparkContext.applicationId}"
    if path not in _cleared:
        _cleared.add(path)
        atexit.register(clear, spark)
    return path


def clear(spark: SparkSession) -> None:
    """Remove all intermediate tables of the session; results that were not written yet go with them."""
    if spark.sparkContext._jsc is not None:  # else the session has stopped
        storage.remove(spark, work_dir(spark))


def work_path(spark: SparkSession, name: str) -> str:
    """A new path for one written table in the shared folder."""
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, outlives executors."""
    spark = df.sparkSession
    path = work_path(spark, name)
    df.write.parquet(path, compression=compression)
    out = spark.read.schema(df.schema).parquet(path)
    out._work_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Remove tables that ``materialize`` wrote and that no later plan reads."""
    for df in tables:
        path = getattr(df, "_work_path", None)
        if path:
            storage.remove(df.sparkSession, path)


def fresh(taken: Iterable[str], *names: str) -> list[str]:
    """Column names like ``names`` that none of ``taken`` equals, whatever their case."""
    used, out = {t.lower() for t in taken}, []
    for name in names:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id's decimal text leaves 0 modulo 5; a null id is never held out."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 5 == 0, F.lit(False))


def crc(data: bytes) -> int:
    return zlib.crc32(data) & 0xFFFFFFFF


def rows_of(batches: Iterator[pa.RecordBatch], most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that the text of each is about ``most_bytes``, one row at least.

    Before each batch, Arrow's pool gives back what it keeps of the ones before.
    """
    for batch in batches:
        pa.default_memory_pool().release_unused()
        n = batch.num_rows
        step = n if batch.nbytes <= most_bytes else max(1, n * most_bytes // batch.nbytes)
        for i in range(0, n, max(1, step)):
            yield batch.slice(i, step)
