"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _stars(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star round over (u, v) with u > v."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    # large star: every larger neighbour of u moves to the least of u and its neighbours
    large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct()
    low = large.groupBy("u").agg(F.min("v").alias("m"))
    # small star: u and its smaller neighbours all move to the least of them
    moved = large.join(low, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return low.select("u", F.col("m").alias("v")).unionByName(moved).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every id of the long columns u and v; component is the least id reached.

    Alternates large-star and small-star until nothing moves, a logarithmic number of rounds in
    practice. Each round aggregates before it joins, so a hub costs one row per task; each
    round's edges are written to the shared folder, so a lost executor repeats one round only.
    Null ids and self links are ignored; an empty list gives no rows.
    """
    now = common.materialize(
        edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"), F.isnull("u").alias("_a"), F.isnull("v").alias("_b")).filter("not _a and not _b and u > v").select("u", "v").distinct(),
        "edges",
    )
    mark = None
    while True:
        total = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(total) == mark or not total[0]:
            break
        mark = tuple(total)
        later = common.materialize(_stars(now), "edges")
        common.release(now)
        now = later
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
