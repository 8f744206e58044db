"""Pipeline stages: each takes (spark, docs, sf_dir) and applies one operator's decisions.

Decisions are matched to rows by doc_id and a hash of the text, so rows with a null or
repeated id keep their own; rows equal in both get equal decisions. All stages but the last
return the columns of ``docs`` as they are, whatever else they hold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, fertility, langid, minhash, mixing as mixer, packing as packer

#: A language label with a smaller share of a text's words is not trusted.
LEAST_SHARE = 0.5


def _without(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    gone = rejected.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    same = docs["doc_id"].cast("long").eqNullSafe(gone["_id"]) & (F.xxhash64(docs["text"]) == gone["_hash"])
    return docs.join(gone, same, "left_anti")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and lie in their language's bands."""
    return _without(docs, fertility.rules(docs).filter("not kept"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with one recognised main language."""
    return _without(docs, langid.identify(docs).filter((F.col("lang_pred") == "und") | (F.col("score") < LEAST_SHARE)))


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the least id, once."""
    kept = _without(docs, minhash.near_duplicates(docs).filter("not kept"))
    (once,) = common.fresh(docs.columns, "_once")
    kept = kept.withColumn(once, F.xxhash64("text")).dropDuplicates(["doc_id", once])
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture holds them."""
    labels = mixer.domains_of(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return mixer.apply(docs, mixer.mix(docs, labels))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document of the mixture, cut into pieces and placed in sequences."""
    return packer.pack(packer.tokenize(docs, sparing=True).drop("ids"))
