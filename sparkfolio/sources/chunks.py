"""Files and their chunks from tables of texts.

A corpus is two DataFrames. ``files``: file_id, path, name, directory, extension, size, mtime_ns,
source_type, cloud_state, name_norm, path_norm. ``chunks``: file_id, chunk_index, kind, location,
text, norm_text, part_text. Chunks 0 and 1 of each file are its name and its path.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import files as paths
from ..functions import text as texts
from . import storage

#: Longer lines are cut into chunks of this many characters.
LINE = 8000
#: Extensions that table rows get in turn, and sources.
TURNS = (".txt", ".pdf", ".xlsx", ".docx", ".pptx", ".md")
SOURCES = ("local", "smb", "onedrive")
#: 2024-01-01 in seconds; row n is n days younger, counted from 0 again after ``DAYS``.
FIRST_DAY, DAY, DAYS = 1_704_067_200, 86_400, 50_000


class Corpus(NamedTuple):
    files: DataFrame
    chunks: DataFrame


def lines(text: Column) -> Column:
    """array(struct(line, text)) of the non-blank lines of a text, long ones cut into windows."""
    cut = lambda row: F.transform(
        F.sequence(F.lit(0), F.greatest(F.floor((F.length(row["text"]) - 1) / LINE), F.lit(0)).cast("int")),
        lambda w: F.struct(row["line"].alias("line"), F.substring(row["text"], w * LINE + 1, F.lit(LINE)).alias("text")),
    )
    numbered = F.transform(F.split(text, "\r\n|\r|\n"), lambda t, i: F.struct((i + 1).alias("line"), t.alias("text")))
    said = lambda row: row["text"].rlike(r"(?U)\S")
    return F.filter(F.flatten(F.transform(F.filter(numbered, said), cut)), said)


def with_norms(files: DataFrame) -> DataFrame:
    """Names and paths as filters on them compare them."""
    name, path = texts.normalized(F.col("name")), texts.normalized(F.col("path"))
    return files.withColumn("name_norm", name["norm"]).withColumn("path_norm", path["norm"])


def named(files: DataFrame) -> DataFrame:
    """The two chunks that every file has."""
    own = F.explode(F.array(F.struct(F.lit(0).alias("chunk_index"), F.lit("name").alias("kind"), F.col("name").alias("text")), F.struct(F.lit(1).alias("chunk_index"), F.lit("path").alias("kind"), F.col("path").alias("text"))))
    return files.select("file_id", own.alias("c")).select("file_id", "c.chunk_index", "c.kind", F.lit("").alias("location"), "c.text")


def normalize(chunks: DataFrame, **options: bool) -> DataFrame:
    both = chunks.withColumn("_n", texts.normalized(F.col("text"), **options))
    return both.select("file_id", "chunk_index", "kind", "location", "text", F.col("_n.norm").alias("norm_text"), F.col("_n.part").alias("part_text"))


def corpus(files: DataFrame, body: DataFrame) -> Corpus:
    """``body`` has file_id, chunk_index (from 2), kind, location and text."""
    return Corpus(with_norms(files), normalize(named(files).unionByName(body)))


def from_texts(rows: DataFrame) -> Corpus:
    """A corpus of ``rows``: file_id, folder and text, one file each with made-up name, time and source."""
    turn = lambda values: F.element_at(F.array(*map(F.lit, values)), (F.pmod("file_id", F.lit(len(values))) + 1).cast("int"))
    given = rows.withColumn("extension", turn(TURNS)).withColumn("name", F.concat(F.lit("doc_"), F.col("file_id"), F.col("extension")))
    files = given.select(
        "file_id",
        F.concat_ws("/", "folder", "name").alias("path"),
        "name",
        F.col("folder").alias("directory"),
        "extension",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("size"),
        ((F.pmod("file_id", F.lit(DAYS)) * DAY + FIRST_DAY) * 1_000_000_000).alias("mtime_ns"),
        turn(SOURCES).alias("source_type"),
        F.lit("local").alias("cloud_state"),
    )
    said = rows.select("file_id", F.posexplode(lines(F.col("text"))).alias("i", "c"))
    body = said.select("file_id", (F.col("i") + 2).alias("chunk_index"), F.lit("line").alias("kind"), F.concat("c.line", F.lit("行")).alias("location"), "c.text")
    return corpus(files, body)


def documents(spark: SparkSession, sf_dir: str) -> Corpus:
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return from_texts(rows.select(F.col("doc_id").alias("file_id"), F.concat(F.lit("/"), "source", F.lit("/"), "lang").alias("folder"), "text"))


def conversations(spark: SparkSession, sf_dir: str) -> Corpus:
    """One file per conversation and one chunk per turn."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    files = turns.groupBy(F.col("conv_id").alias("file_id")).agg(F.sum(F.octet_length("text")).cast("long").alias("size"))
    files = files.select("file_id", F.concat(F.lit("/conversations/"), "file_id", F.lit(".md")).alias("path"), "size").withColumns({"name": paths.name(F.col("path")), "directory": paths.directory(F.col("path")), "extension": paths.extension(F.col("path"))})
    files = files.withColumns({"mtime_ns": F.lit(FIRST_DAY * 1_000_000_000), "source_type": F.lit("local"), "cloud_state": F.lit("local")})
    body = turns.select(F.col("conv_id").alias("file_id"), (F.col("turn") + 2).cast("int").alias("chunk_index"), F.lit("paragraph").alias("kind"), F.concat_ws("/", "role", "turn").alias("location"), "text")
    return corpus(files, body.filter(F.trim("text") != ""))


def pages(spark: SparkSession, sf_dir: str) -> Corpus:
    """Raw page sources, tags included, under their addresses."""
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet")
    base = from_texts(rows.select(F.col("page_id").alias("file_id"), F.lit("/pages").alias("folder"), F.col("html").alias("text")))
    files = rows.select(F.col("page_id").alias("file_id"), F.col("url").alias("path"), F.col("url").alias("name")).join(base.files.drop("path", "name", "name_norm", "path_norm", "extension"), "file_id")
    return Corpus(with_norms(files.withColumn("extension", F.lit(".html"))), base.chunks.filter("chunk_index > 1").unionByName(normalize(named(files))))


#: Bytes of a table for each bucket of its stored corpus.
BUCKET_BYTES = 128 << 20
_kept: dict[tuple, Corpus] = {}
READERS = {"documents": documents, "conversations": conversations, "pages": pages}


def indexed(spark: SparkSession, sf_dir: str, table: str = "documents") -> Corpus:
    """The corpus of a table, stored on first use in a session and read from there until the table changes.

    Files and chunks lie in equal buckets by file_id, so a search joins and sums them up without a shuffle.
    """
    stamp = storage.stamp(spark, f"{sf_dir}/{table}.parquet")
    key = (spark.sparkContext.applicationId, sf_dir, table, stamp)
    if key not in _kept:
        made = READERS[table](spark, sf_dir)
        buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), stamp[0] // BUCKET_BYTES)
        _kept[key] = Corpus(storage.bucketed(made.files, f"{table}-files", buckets), storage.bucketed(made.chunks, f"{table}-chunks", buckets, ("file_id", "chunk_index")))
    return _kept[key]
