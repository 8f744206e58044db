"""A cache of recognised pages as a table; recognition itself is a pluggable reader."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import results


def key() -> Column:
    """Identity of a page: what its recognition depends on."""
    return F.sha2(F.concat_ws("|", "path", F.col("size").cast("string"), F.col("mtime_ns").cast("string"), F.col("page").cast("string"), "language", "version", F.col("scale").cast("string")), 256)


def lookup(pages: DataFrame, cache: DataFrame) -> DataFrame:
    """Pages with the cached text, null where they must be recognised."""
    return pages.withColumn("key", key()).join(cache.select("key", F.col("text").alias("cached")), "key", "left")


def put(cache: DataFrame, rows: DataFrame) -> DataFrame:
    """The cache with newer rows in place of those with their keys."""
    return cache.join(rows.select("key"), "key", "left_anti").unionByName(rows)


def touch(cache: DataFrame, used: DataFrame) -> DataFrame:
    """Note the last use: ``used`` has key and used_at."""
    seen = used.groupBy("key").agg(F.max("used_at").alias("_seen"))
    return cache.join(seen, "key", "left").withColumn("used_at", F.greatest("used_at", "_seen")).drop("_seen")


def drop_file(cache: DataFrame, path: str) -> DataFrame:
    return cache.filter(F.col("path") != path)


def trim(cache: DataFrame, most_bytes: int) -> DataFrame:
    """What stays of a cache when the pages unused for longest go until its texts take ``most_bytes`` at most."""
    sized = cache.withColumn("_bytes", F.coalesce(F.octet_length("text"), F.lit(0)))
    return results.latest_within(sized, most_bytes, size="_bytes").drop("_bytes")
