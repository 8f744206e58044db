"""Where derived tables are kept: the folder that all executors share."""

from __future__ import annotations

import atexit
import hashlib
import re
import tempfile
import uuid
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

CHECKPOINT = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """What the session names; a local session without the setting gets a folder of its own.

    On a cluster a folder of the driver's machine would be missed by the executors, so there the
    setting must be made.
    """
    named = spark.conf.get(CHECKPOINT, None)
    if not named:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError(f"set {CHECKPOINT} to a folder that all executors share")
        named = Path(tempfile.mkdtemp(prefix="sparkfolio-")).as_uri()
        spark.conf.set(CHECKPOINT, named)
    return named.rstrip("/")


_swept: set[str] = set()


def place(spark: SparkSession, name: str) -> str:
    """A new path in the session's own part of the shared folder, which goes when the driver's Python ends."""
    home = f"{shared_dir(spark)}/sparkfolio/search-{spark.sparkContext.applicationId}"
    if home not in _swept:
        _swept.add(home)
        atexit.register(lambda: spark.sparkContext._jsc is not None and remove(spark, home))
    return f"{home}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a new place in the shared folder and read it back."""
    path = place(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def divided(df: DataFrame, name: str, by: str) -> DataFrame:
    """Like ``stored``, with a folder for each value of one column, so that a filter on it opens its folders only."""
    path = place(df.sparkSession, name)
    df.write.partitionBy(by).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def release(*tables: DataFrame) -> None:
    """Remove tables that ``stored`` wrote and that nothing reads any more."""
    for df in tables:
        if path := getattr(df, "_stored_at", None):
            remove(df.sparkSession, path)


class Buckets:
    """A Parquet table of rows in buckets by ``file_id`` and, in them, in order; partitions are its segments.

    Rows of one file lie in one bucket of every segment, so an aggregate or a join by file needs no shuffle, and a
    filter on file_id or segment reads only theirs. The table's definition is the session's, its files are those below ``path``.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType, buckets: int, order: Sequence[str] = ("file_id",)) -> None:
        self.spark, self.path, self.schema, self.buckets, self.order = spark, path, schema, buckets, list(order)
        self.name = f"sparkfolio_{hashlib.md5(path.encode()).hexdigest()}"
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
        spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        spark.sql(f"CREATE TABLE {self.name} ({columns}, segment STRING) USING parquet PARTITIONED BY (segment) CLUSTERED BY (file_id) SORTED BY ({', '.join(self.order)}) INTO {buckets} BUCKETS LOCATION '{path}'")

    def write(self, rows: DataFrame, segment: str) -> None:
        """Add a segment; a file for each of its buckets that has rows."""
        rows = rows.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in self.schema], F.lit(segment).alias("segment"))
        rows = rows.repartition(self.buckets, "file_id").sortWithinPartitions(*self.order)
        rows.write.partitionBy("segment").bucketBy(self.buckets, "file_id").sortBy(*self.order).mode("append").saveAsTable(self.name)

    def read(self, segments: Sequence[str]) -> DataFrame:
        """The rows of some segments, with ``segment``."""
        self.spark.catalog.refreshTable(self.name)
        return self.spark.table(self.name).filter(F.col("segment").isin(list(segments)) if segments else F.lit(False))


def bucketed(df: DataFrame, name: str, buckets: int, order: Sequence[str] = ("file_id",)) -> DataFrame:
    """Write ``df`` in buckets by file_id to a new place in the shared folder and read it back."""
    table = Buckets(df.sparkSession, place(df.sparkSession, name), df.schema, buckets, order)
    table.write(df, "all")
    out = table.read(["all"]).drop("segment")
    out._stored_at = table.path
    return out


def _at(spark: SparkSession, path: str):  # type: ignore[no-untyped-def]
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _at(spark, path)
    return fs.exists(p)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or folder, if it is there."""
    fs, p = _at(spark, path)
    fs.delete(p, True)


def names(spark: SparkSession, path: str) -> list[str]:
    """What a folder holds; nothing if it isn't there."""
    fs, p = _at(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []


def size(spark: SparkSession, path: str) -> int:
    """Bytes below a path; 0 if it isn't there."""
    fs, p = _at(spark, path)
    return fs.getContentSummary(p).getLength() if fs.exists(p) else 0


def stamp(spark: SparkSession, path: str) -> tuple[int, int]:
    """Bytes below a path and when it, or a file in it, was last written: another stamp, another content."""
    fs, p = _at(spark, path)
    if not fs.exists(p):
        return 0, 0
    times = [fs.getFileStatus(p).getModificationTime(), *(s.getModificationTime() for s in fs.listStatus(p))]
    return fs.getContentSummary(p).getLength(), max(times)


def create_text(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small file whole, or not at all if the name is taken by then."""
    fs, p = _at(spark, path)
    part = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    out = fs.create(part, False)
    out.write(text.encode())
    out.close()
    taken = fs.exists(p) or not fs.rename(part, p)
    if taken:
        fs.delete(part, False)
    return not taken


def read_text(spark: SparkSession, path: str) -> str:
    fs, p = _at(spark, path)
    source = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8")
    finally:
        source.close()
