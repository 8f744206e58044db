"""A query over chunks that arrive in any order: each file is decided as early as its chunks allow.

    decide(chunks, "a & !b", files).writeStream...

A stream of chunks holds the rows of ``Corpus.chunks`` and for each file one row of kind ``end`` whose chunk_index is the number of
its chunks (``with_ends``). Terms and nearness are tested by built-in expressions before the rows reach the state. A file's state
is which terms it has shown so far and how many chunks were seen. What isn't known yet is neither true nor false, so an expression is decided
once no further chunk can change it: then ``accept`` or ``reject`` is told, once, and the terms are dropped; the two counts go when the last chunk
has come. A file that stays silent for ``idle`` is judged by what it has shown.
"""

from __future__ import annotations

import contextlib
import functools
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..lang import nodes as q
from ..plans.compile import OWN, Options, Plan
from ..plans.search import compiled

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SCHEMA = "file_id long, outcome string, early boolean, units long"
_STATE = "shown string, seen long, expected long, decided boolean, touched long"


def with_ends(chunks: DataFrame) -> DataFrame:
    """Chunks of whole files, and a row that ends each of them."""
    last = chunks.groupBy("file_id").agg(F.count("*").cast("int").alias("chunk_index"))
    empty = [F.lit("").alias(c) for c in chunks.columns if c not in ("file_id", "chunk_index", "kind")]
    return chunks.unionByName(last.select("file_id", "chunk_index", F.lit("end").alias("kind"), *empty).select(*chunks.columns))


def verdict(node: q.Node | None, known: dict[q.Node, bool | None]) -> bool | None:
    """True or false if no unknown leaf can change it, else None."""
    if node is None:
        return True
    if isinstance(node, (q.Term, q.Near, q.Meta)):
        return known[node]
    if isinstance(node, q.Not):
        inner = verdict(node.child, known)
        return None if inner is None else not inner
    parts = [verdict(c, known) for c in node.children]
    wanted = node.count if isinstance(node, q.AtLeast) else len(parts) if isinstance(node, q.And) else 1
    if parts.count(True) >= wanted:
        return True
    return False if len(parts) - parts.count(False) < wanted else None


class Matcher(StatefulProcessor):
    """State of one file; rows hold what a chunk shows as a string of 0 and 1, a leaf each."""

    def __init__(self, root: q.Node | None, leaves: list[q.Node], fixed: int, idle_ms: int) -> None:
        self.root, self.leaves, self.fixed, self.idle = root, leaves, fixed, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("file", _STATE)

    def judge(self, shown: str, final: bool) -> bool | None:
        """Leaves from ``fixed`` on are of the file, known from its first row; the others can still turn true."""
        known = {leaf: True if c == "1" else False if final or i >= self.fixed else None for i, (leaf, c) in enumerate(zip(self.leaves, shown, strict=True))}
        return verdict(self.root, known)

    def _told(self, file_id: int, accepted: bool, early: bool, units: int) -> pd.DataFrame:
        return pd.DataFrame({"file_id": [file_id], "outcome": ["accept" if accepted else "reject"], "early": [early], "units": [units]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # type: ignore[no-untyped-def]  # noqa: N802, N803
        known = self.state.exists()
        shown, seen, expected, decided, _ = self.state.get() if known else ("0" * len(self.leaves), 0, None, False, 0)
        for frame in rows:
            ends = frame["ends"].to_numpy()
            if ends.any():
                expected = int(frame["chunk_index"][ends].iloc[0])
            seen += int((~ends).sum())
            if not decided:
                shown = "".join(map(max, *[shown, shown, *frame["shown"].unique()]))
        whole = expected is not None and seen >= expected
        if not decided and (answer := self.judge(shown, whole)) is not None:
            yield self._told(key[0], answer, not whole, seen)
            decided, shown = True, ""
        if not whole:
            now = timerValues.getCurrentProcessingTimeInMs()
            self.state.update((shown, seen, expected, decided, now))
            if not known:  # one timer a file, put off when it goes off too early
                self.handle.registerTimer(now + self.idle)
        elif known:  # a file that came whole never has a state
            self.state.clear()
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # type: ignore[no-untyped-def]  # noqa: N802, N803
        if not self.state.exists():
            return
        shown, seen, _, decided, touched = self.state.get()
        if timerValues.getCurrentProcessingTimeInMs() < touched + self.idle:
            self.handle.registerTimer(touched + self.idle)
            return
        if not decided:
            yield self._told(key[0], bool(self.judge(shown, True)), False, seen)
        self.state.clear()


def _leaves(plan: Plan) -> tuple[list[q.Node], int]:
    """Leaves of the text, then those of the file."""
    every = list(dict.fromkeys(n for n in (q.walk(plan.root) if plan.root is not None else ()) if isinstance(n, (q.Term, q.Near, q.Meta))))
    text = [n for n in every if isinstance(n, q.Near) or isinstance(n, q.Term) and _outside(plan.root, n)]
    return [*text, *(n for n in every if isinstance(n, q.Meta))], len(text)


def _outside(node: q.Node | None, term: q.Term) -> bool:
    """Whether a term stands in the query on its own, not only in a NEAR."""
    if node is None or isinstance(node, (q.Near, q.Meta)):
        return False
    return node == term if isinstance(node, q.Term) else any(_outside(c, term) for c in q.below(node))


def decide(chunks: DataFrame, query: str | q.Node | None, files: DataFrame | None = None, options: Options = Options(), *, idle: int = 600) -> DataFrame:
    """file_id, outcome, early (decided before the last chunk) and units (chunks seen by then) of a stream of chunks.

    Conditions on files need the table of ``files``. Conditions on pages that were recognised aren't decided here.
    """
    plan = compiled(query, options)
    leaves, fixed = _leaves(plan)
    meta = leaves[fixed:]
    if any(m.field in ("ocr", "confirmed") for m in meta):
        raise ValueError("a stream of chunks doesn't tell recognised or confirmed files")
    if meta and files is None:
        raise ValueError("conditions on files need the table of files")
    if not options.include_path_names:  # they count as chunks, but show nothing
        blank = F.when(F.col("kind").isin(*OWN), "").otherwise
        chunks = chunks.withColumns({c: blank(F.col(c)) for c in ("norm_text", "part_text")})
    one = lambda test: F.when(F.coalesce(test, F.lit(False)) & (F.col("kind") != "end"), "1").otherwise("0")
    said = [one(plan.near(n) if isinstance(n, q.Near) else plan.needles[plan.of[n]].match()) for n in leaves[:fixed]]
    if meta:
        marks = files.select("file_id", F.concat(*[F.when(F.coalesce(plan.meta(m), F.lit(False)), "1").otherwise("0") for m in meta]).alias("_meta"))
        chunks = chunks.join(marks, "file_id", "left")
        said.append(F.coalesce("_meta", F.lit("0" * len(meta))))
    shown = functools.reduce(F.concat, said) if said else F.lit("")
    rows = chunks.select("file_id", "chunk_index", (F.col("kind") == "end").alias("ends"), shown.alias("shown"))
    return rows.groupBy("file_id").transformWithStateInPandas(Matcher(plan.root, leaves, fixed, idle * 1000), SCHEMA, "append", "ProcessingTime")


@contextlib.contextmanager
def state_store(spark: SparkSession, *, idle_batches: bool = True) -> Iterator[None]:
    """Queries that are started inside keep their state in RocksDB, which such state needs.

    Without ``idle_batches`` none runs when nothing has arrived; timers would ask for another for ever.
    """
    wanted = {"spark.sql.streaming.stateStore.providerClass": PROVIDER, "spark.sql.streaming.noDataMicroBatches.enabled": str(idle_batches).lower()}
    before = {key: spark.conf.get(key, None) for key in wanted}
    try:
        for key, value in wanted.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value) if value else spark.conf.unset(key)


def decided(spark: SparkSession, source: str, schema, query: str | q.Node | None, out: str, checkpoint: str, files: DataFrame | None = None, options: Options = Options(), *, per_trigger: int = 100):  # type: ignore[no-untyped-def]
    """Decide all chunks that wait in a folder of Parquet files, write the outcomes to ``out``, and stop."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(source)
    with state_store(spark, idle_batches=False):
        return decide(stream, query, files, options).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
