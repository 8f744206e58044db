"""Search over files that keep arriving, as Structured Streaming queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..lang import nodes as q
from ..plans.compile import Options
from ..plans.search import compiled
from ..sources import chunks as source
from ..sources.index import CorpusIndex


def matches(chunks: DataFrame, query: str | q.Node, options: Options = Options()) -> DataFrame:
    """file_id, accepted and hit_count of a stream of normalised chunks; run it in update or complete mode.

    Filters on files need a table of files, so a query may hold conditions on text only.
    """
    plan = compiled(query, options)
    if q.metadata_nodes(plan.root):
        raise ValueError("a stream of chunks has no file columns to filter on")
    per_file = plan.tested(chunks).groupBy("file_id").agg(*plan.aggregates())
    return plan.judge(per_file).select("file_id", "accepted", plan.hit_count().alias("hit_count"))


def hits_per_window(events: DataFrame, words: list[str], *, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Events whose JSON or type holds one of the words, counted per event-time window; late rows are dropped."""
    said = F.lower(F.concat_ws(" ", "event_type", "props"))
    hit = F.array_max(F.array(*[said.contains(w.lower()).cast("int") for w in words])) == 1
    timed = events.withWatermark("ts", late).filter(hit)
    return timed.groupBy(F.window("ts", size).alias("w")).agg(F.count("*").alias("hits")).select(F.col("w.start").alias("start"), "hits")


def keep_index(spark: SparkSession, incoming: str, schema: str, index: CorpusIndex, checkpoint: str, *, files_per_trigger: int = 100) -> StreamingQuery:
    """Take new Parquet files of (file_id, folder, text) into an index, all that wait, and stop.

    A batch that is repeated after a failure finds its files unchanged, so it changes nothing.
    """

    def take(batch: DataFrame, number: int) -> None:
        made = source.from_texts(batch)
        index.refresh(made.files.drop("name_norm", "path_norm"), made.chunks.filter("chunk_index > 1").drop("norm_text", "part_text"), complete=False)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(incoming)
    return stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
