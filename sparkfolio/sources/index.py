"""An incrementally kept index: a corpus as Parquet in segments, with what is needed to see changes and to skip what can't match.

A refresh writes one new segment with the files that were added or changed, and the pairs of segment and file that are gone;
nothing else is rewritten. A commit is a numbered list of segments, and a number is taken once, so of two writers one fails and
can try again; readers see a whole commit or the one before, whatever fails meanwhile. When ``FANOUT`` segments of a
level have come together they are merged into one of the next, so a file is rewritten once a level: as often as the logarithm of
their number. ``vacuum`` removes segments that no recent commit names.

Files and chunks lie in equal buckets by file_id across all segments (``storage.Buckets``), so they meet and are summed up by file without a
shuffle. Merging all segments starts a new generation with more buckets once the present ones have grown.

Beside its rows a segment has gram postings (``grams``) and what lets a search pass over it: the ranges of sizes and times, the sets of
extensions and sources, and a Bloom filter of its grams.
"""

from __future__ import annotations

import json
import operator
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import files as paths
from ..lang import nodes as q
from ..plans.compile import Options, Plan
from ..plans.search import Found, compiled, search
from . import grams, storage
from .chunks import Corpus, corpus

EXTRACTOR_VERSION = "1"
#: Segments of a level that are merged.
FANOUT = 8
#: Bytes of a bucket's chunks over all segments; a merge of all makes more buckets from twice as many on.
BUCKET_BYTES = 256 << 20
#: A set of more values isn't kept, so nothing is passed over by it.
VALUES = 1000
#: Ids that a reader is given by name, so that it opens their buckets only; more are joined.
NAMED = 1000
#: From these on a file's status says ``partial`` (its longest chunk) or ``too_large`` (its text). It is stored and searched whole.
CHUNK_CHARS = 64 * 1024
FILE_CHARS = 8 * 1024 * 1024
MARKS = ("size", "mtime_ns", "version")


class IndexUnavailable(RuntimeError):
    """The index can't be read; a search goes to the files instead."""


class Conflict(RuntimeError):
    """Another writer has committed meanwhile; nothing was changed."""


def with_version(files: DataFrame, settings: str = "") -> DataFrame:
    return files.withColumn("version", paths.fingerprint([F.lit(EXTRACTOR_VERSION), F.lit(settings)]))


def changes(now: DataFrame, stored: DataFrame) -> DataFrame:
    """file_id and change of every file: added, updated, unchanged, or removed."""
    same = F.lit(True)
    for c in MARKS:
        same = same & F.col(f"n.{c}").eqNullSafe(F.col(f"s.{c}"))
    both = now.select("file_id", *MARKS).alias("n").join(stored.select("file_id", *MARKS).alias("s"), F.col("n.file_id") == F.col("s.file_id"), "full")
    change = F.when(F.col("n.file_id").isNull(), "removed").when(F.col("s.file_id").isNull(), "added").when(same, "unchanged").otherwise("updated")
    return both.select(F.coalesce("n.file_id", "s.file_id").alias("file_id"), change.alias("change"))


def stale(stored: DataFrame, now: DataFrame, key: str = "file_id") -> DataFrame:
    """Stored files that a complete listing no longer has."""
    return stored.join(now.select(key), key, "left_anti")


def candidates(files: DataFrame, chunks: DataFrame, plan) -> DataFrame:  # type: ignore[no-untyped-def]
    """Files that may match: those with a chunk that holds a needle, or all if the query can match without."""
    some = plan.prefilter()
    return files if some is None else files.join(chunks.filter(some).select("file_id"), "file_id", "left_semi")


def measured(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """Files with chunk_count, text_chars and status: ok, partial, too_large or empty."""
    sizes = chunks.filter("chunk_index > 1").groupBy("file_id").agg(F.count("*").alias("chunk_count"), F.sum(F.length("text")).alias("text_chars"), F.max(F.length("text")).alias("_longest"))
    known = files.join(sizes, "file_id", "left").withColumns({"chunk_count": F.coalesce("chunk_count", F.lit(0)), "text_chars": F.coalesce("text_chars", F.lit(0))})
    status = F.when(F.col("text_chars") > FILE_CHARS, "too_large").when(F.col("chunk_count") == 0, "empty").when(F.col("_longest") > CHUNK_CHARS, "partial").otherwise("ok")
    return known.withColumn("status", status).drop("_longest")


def status(files: DataFrame) -> DataFrame:
    return files.agg(F.count("*").alias("files"), F.coalesce(F.sum("chunk_count"), F.lit(0)).alias("chunks"), F.count_if(F.col("status") != "ok").alias("limited"), F.max("indexed_at").alias("last_indexed"))


@dataclass(frozen=True)
class Segment:
    id: str
    level: int
    files: int
    bytes: int


def statistics(files: DataFrame) -> DataFrame:
    """One row that tells what a segment's files are like; a set that is null may hold anything."""
    some = lambda c, name: F.when(F.size(F.collect_set(c)) <= VALUES, F.sort_array(F.collect_set(c))).alias(name)
    ranges = [f(c).cast(kind).alias(f"{name}_{c}") for c, kind in (("size", "long"), ("mtime_ns", "decimal(38,0)")) for name, f in (("least", F.min), ("most", F.max))]
    return files.agg(*ranges, some(F.regexp_replace(F.lower("extension"), r"^\.+", ""), "extensions"), some("source_type", "sources"))


def _overlap(node: q.Meta) -> Column | None:
    """Whether a segment with such statistics can hold a file that passes a condition; None if it can't be told."""
    if node.field in ("ext", "type"):
        wanted = node.value.split(",") if node.field == "ext" else [x.lstrip(".") for x in paths.EXTENSIONS.get(node.value, ())]
        return F.col("extensions").isNull() | F.arrays_overlap("extensions", F.array(*map(F.lit, wanted))) if wanted else None
    if node.field == "source":
        return F.col("sources").isNull() | F.array_contains("sources", node.value)
    if node.field not in ("size", "modified"):
        return None
    if node.field == "size":
        least, most, read = F.col("least_size"), F.col("most_size"), lambda v: F.lit(int(v))
    else:
        least, most, read = paths.modified_day(F.col("least_mtime_ns")), paths.modified_day(F.col("most_mtime_ns")), lambda v: F.lit(v).cast("date")
    if node.op == "range":
        low, high = map(read, node.value.split("..", 1))
        return (least <= high) & (most >= low)
    edge, test = (least, {"lt": operator.lt, "le": operator.le}[node.op]) if node.op in ("lt", "le") else (most, {"gt": operator.gt, "ge": operator.ge}[node.op])
    return test(edge, read(node.value))


class CorpusIndex:
    """An index under ``path`` of any file system that Spark writes; it stops growing at ``max_bytes``.

    ``buckets`` are those of a new index, as many as the session's shuffles have if it isn't told.
    """

    TABLES = ("files", "chunks", "gone", "postings", "statistics", "blooms")

    def __init__(self, spark: SparkSession, path: str, *, max_bytes: int | None = None, buckets: int | None = None, fanout: int = FANOUT) -> None:
        self.spark, self.path, self.max_bytes, self.fanout = spark, path.rstrip("/"), max_bytes, fanout
        self._new_buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self._open: dict[str, storage.Buckets] = {}

    # commits -----------------------------------------------------------------------------
    def _commits(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in storage.names(self.spark, f"{self.path}/commits") if n.endswith(".json"))

    def _commit(self, number: int) -> dict:
        try:
            commit = json.loads(storage.read_text(self.spark, f"{self.path}/commits/{number}.json"))
        except Exception as e:
            raise IndexUnavailable(f"{self.path}: commit {number} can't be read") from e
        return commit | {"segments": [Segment(**s) for s in commit["segments"]]}

    def _now(self) -> tuple[int, dict | None]:
        known = self._commits()
        return (known[-1], self._commit(known[-1])) if known else (0, None)

    def _folder(self, commit: dict, table: str) -> str:
        return f"{self.path}/{commit['generation']}/{table}"

    def _put(self, number: int, commit: dict) -> None:
        said = commit | {"segments": [s.__dict__ for s in commit["segments"]]}
        if not storage.create_text(self.spark, f"{self.path}/commits/{number + 1}.json", json.dumps(said)):
            raise Conflict(f"{self.path}: commit {number + 1} is taken")

    # tables ------------------------------------------------------------------------------
    def _buckets(self, commit: dict, table: str) -> storage.Buckets:
        folder = self._folder(commit, table)
        if folder not in self._open:
            order = ("file_id", "chunk_index") if table == "chunks" else ("file_id",)
            self._open[folder] = storage.Buckets(self.spark, folder, StructType.fromJson(commit["schemas"][table]), commit["buckets"], order)
        return self._open[folder]

    def _gone(self, commit: dict) -> DataFrame | None:
        """(segment, file_id) of what segments hold no more."""
        folders = [f"{self._folder(commit, 'gone')}/{g}" for g in commit["gone"]]
        return self.spark.read.schema("segment string, file_id long").parquet(*folders) if folders else None

    def _small(self, commit: dict, table: str, schema: str, segments: Sequence[str]) -> DataFrame:
        folder = self._folder(commit, table)
        return self.spark.read.schema(f"{schema}, segment string").option("basePath", folder).parquet(*[f"{folder}/segment={s}" for s in segments])

    def _live(self, commit: dict, table: str, segments: Sequence[str] | None = None) -> DataFrame:
        """Rows of files or chunks with ``segment``."""
        ids = [s.id for s in commit["segments"]]
        rows = self._buckets(commit, table).read(ids if segments is None else segments)
        gone = self._gone(commit)
        return rows if gone is None else rows.join(gone, ["segment", "file_id"], "left_anti").select(*rows.columns)

    def load(self) -> Corpus | None:
        """The corpus of the last commit, None before the first; ``IndexUnavailable`` if it is damaged."""
        _, commit = self._now()
        return None if commit is None else Corpus(*[self._live(commit, t).drop("segment") for t in ("files", "chunks")])

    def verify(self) -> None:
        """Raise ``IndexUnavailable`` unless all segments of the last commit are there and hold as many files as it says."""
        _, commit = self._now()
        if commit is None:
            return
        missing = [s.id for s in commit["segments"] if s.files and not storage.exists(self.spark, f"{self._folder(commit, 'files')}/segment={s.id}")]
        if missing:
            raise IndexUnavailable(f"{self.path}: {', '.join(missing)} is missing")
        try:
            found = dict(map(tuple, self._buckets(commit, "files").read([s.id for s in commit["segments"]]).groupBy("segment").agg(F.count("*")).collect()))
        except Exception as e:
            raise IndexUnavailable(f"{self.path}: {e}") from e
        wrong = [s.id for s in commit["segments"] if found.get(s.id, 0) != s.files]
        if wrong:
            raise IndexUnavailable(f"{self.path}: {', '.join(wrong)} has lost files")

    def size(self) -> int:
        """Bytes of the last commit."""
        _, commit = self._now()
        return sum(s.bytes for s in commit["segments"]) if commit else 0

    # segments ----------------------------------------------------------------------------
    def _write(self, commit: dict, files: DataFrame, chunks: DataFrame, level: int, new: bool = False) -> Segment:
        """Write a segment; no reader sees it before a commit names it. Files that are ``new`` are measured by the chunks as written."""
        name = uuid.uuid4().hex
        self._buckets(commit, "chunks").write(chunks, name)
        self._buckets(commit, "files").write(self._measured(commit, files, self._buckets(commit, "chunks").read([name])) if new else files, name)
        here = self._buckets(commit, "files").read([name])
        n = here.count()
        if n:
            texts = self._buckets(commit, "chunks").read([name])
            into = lambda table: f"{self._folder(commit, table)}/segment={name}"
            made = grams.postings(texts, max(1, -(-n // grams.SHARD))).sortWithinPartitions("gram", "shard")
            made.write.option("parquet.block.size", 1 << 20).option("parquet.page.row.count.limit", 500).parquet(into("postings"))
            statistics(here).write.parquet(into("statistics"))
            grams.bloom(self.spark.read.parquet(into("postings"))).coalesce(1).write.parquet(into("blooms"))
        size = sum(storage.size(self.spark, f"{self._folder(commit, t)}/segment={name}") for t in ("files", "chunks", "postings"))
        return Segment(name, level, n, size)

    def _measured(self, commit: dict, files: DataFrame, chunks: DataFrame) -> DataFrame:
        """New files with all columns that the index has."""
        known = measured(files, chunks).withColumn("indexed_at", F.current_timestamp())
        return known.withColumns({f.name: F.lit(None) for f in StructType.fromJson(commit["schemas"]["files"]) if f.name not in known.columns})

    def _bury(self, commit: dict, gone: DataFrame) -> str:
        name = uuid.uuid4().hex
        gone.select("segment", "file_id").write.parquet(f"{self._folder(commit, 'gone')}/{name}")
        return name

    def _fresh(self, files: DataFrame, chunks: DataFrame, buckets: int) -> dict:
        """A commit of a new generation, without segments."""
        schemas = {"files": files.schema.jsonValue(), "chunks": chunks.schema.jsonValue()}
        return {"generation": uuid.uuid4().hex, "buckets": buckets, "schemas": schemas, "segments": [], "gone": [], "spent": []}

    def _merge(self, commit: dict) -> dict:
        """The commit with full levels merged into the next, from below; ``spent`` are segments that it has made needless."""
        commit = commit | {"spent": []}
        while True:
            levels: dict[int, list[Segment]] = {}
            for s in commit["segments"]:
                levels.setdefault(s.level, []).append(s)
            full = [level for level in sorted(levels) if len(levels[level]) >= self.fanout]
            if not full:
                return commit
            commit = self._merged(commit, levels[full[0]], full[0] + 1)

    def _merged(self, commit: dict, some: list[Segment], level: int) -> dict:
        ids = [s.id for s in some]
        rest = [s for s in commit["segments"] if s.id not in ids]
        rows = [self._live(commit, t, ids).drop("segment") for t in ("files", "chunks")]
        buckets = max(commit["buckets"], sum(s.bytes for s in some) // BUCKET_BYTES)
        spent = [*commit["spent"], *([commit["generation"], i] for i in ids)]
        if not rest and buckets >= 2 * commit["buckets"]:
            new = self._fresh(*rows, buckets)
            return new | {"segments": [self._write(new, *rows, level)], "spent": spent}
        merged = self._write(commit, *rows, level)
        gone = self._gone(commit)
        left = [] if gone is None or not rest else [self._bury(commit, gone.filter(F.col("segment").isin([s.id for s in rest])))]
        return commit | {"segments": [*rest, *([merged] if merged.files else [])], "gone": left, "spent": spent}

    def compact(self) -> None:
        """Merge all segments into one."""
        number, commit = self._now()
        if commit and (len(commit["segments"]) > 1 or commit["gone"]):
            self._put(number, self._merged(commit | {"spent": []}, commit["segments"], max((s.level for s in commit["segments"]), default=0) + 1))

    def vacuum(self, keep: int = 2) -> int:
        """Remove commits but the last ``keep`` and the segments that only they name; returns the number of segments."""
        known = self._commits()
        old, new = ([self._commit(n) for n in part] for part in (known[:-keep], known[-keep:]))
        place = lambda c: {(c["generation"], s.id) for s in c["segments"]}
        spent = {tuple(x) for c in (*old, *new) for x in c["spent"]}
        gone = spent.union(*map(place, old)) - set().union(*map(place, new))
        buried = {(c["generation"], g) for c in old for g in c["gone"]} - {(c["generation"], g) for c in new for g in c["gone"]}
        for n in known[:-keep]:
            storage.remove(self.spark, f"{self.path}/commits/{n}.json")
        for generation, name in gone:
            for table in self.TABLES:
                storage.remove(self.spark, f"{self.path}/{generation}/{table}/segment={name}")
        for generation, name in buried:
            storage.remove(self.spark, f"{self.path}/{generation}/gone/{name}")
        for generation in {c["generation"] for c in old} - {c["generation"] for c in new}:
            storage.remove(self.spark, f"{self.path}/{generation}")
        return len(gone)

    # changes -----------------------------------------------------------------------------
    def pending(self, files: DataFrame, settings: str = "", *, complete: bool = True) -> DataFrame:
        """What a refresh with ``files`` would change (file_id, change); nothing is read but the two lists of files."""
        now, (_, commit) = with_version(files, settings), self._now()
        marks = changes(now, self._live(commit, "files") if commit else now.limit(0))
        return marks if complete else marks.filter("change <> 'removed'")

    def refresh(self, files: DataFrame, body: DataFrame, settings: str = "", *, complete: bool = True) -> DataFrame:
        """Take in ``files`` and the chunks (``body``) of those that changed; returns the changes.

        Files that are missing from ``files`` go only if the listing was ``complete``. An index that has
        reached ``max_bytes`` takes no new files (change ``full``) but still updates and removes. Columns that the index hasn't
        had from its start are left out.
        """
        number, commit = self._now()
        now = with_version(files, settings)
        marks = self.pending(files, settings, complete=complete)
        if self.max_bytes is not None and commit and self.size() >= self.max_bytes:
            marks = marks.withColumn("change", F.when(F.col("change") == "added", "full").otherwise(F.col("change")))
        marks = storage.stored(marks, "changes")
        moved = marks.filter("change in ('updated', 'removed')").select("file_id")
        taken = marks.filter("change in ('added', 'updated')").select("file_id")
        anything, replaced = not taken.isEmpty(), commit is not None and not moved.isEmpty()
        if commit and not anything and not replaced:
            return marks
        fresh = now.join(taken, "file_id", "left_semi")
        new = corpus(fresh, body.join(fresh.select("file_id"), "file_id", "left_semi"))
        after = commit or self._fresh(measured(new.files, new.chunks).withColumn("indexed_at", F.current_timestamp()), new.chunks, self._new_buckets)
        if replaced:
            after = after | {"gone": [*after["gone"], self._bury(after, self._live(after, "files").join(moved, "file_id", "left_semi"))]}
        if anything:
            made = self._write(after, *new, 0, True)
            after = after | {"segments": [*after["segments"], made]}
        self._put(number, self._merge(after))
        return marks

    def _forget(self, choose) -> None:  # type: ignore[no-untyped-def]
        number, commit = self._now()
        if commit is None:
            return
        gone = storage.stored(choose(self._live(commit, "files")).select("segment", "file_id"), "forgotten")
        if not gone.isEmpty():
            self._put(number, commit | {"gone": [*commit["gone"], self._bury(commit, gone)]})
        storage.release(gone)

    def remove(self, condition: Column) -> None:
        """Forget the files for which a condition on ``files`` holds."""
        self._forget(lambda files: files.filter(condition))

    def forget(self, ids: DataFrame) -> None:
        """Forget the files with these ``file_id``."""
        self._forget(lambda files: files.join(ids.select("file_id"), "file_id", "left_semi"))

    def clear(self) -> None:
        self.remove(F.lit(True))

    def rebuild(self, files: DataFrame, body: DataFrame, settings: str = "") -> DataFrame:
        """Write everything anew, whatever is there, and then commit it; readers have the last commit until then."""
        known = self._commits()
        new = corpus(with_version(files, settings), body)
        commit = self._fresh(measured(new.files, new.chunks).withColumn("indexed_at", F.current_timestamp()), new.chunks, self._new_buckets)
        made = self._write(commit, *new, 0, True)
        self._put(known[-1] if known else 0, commit | {"segments": [made]})
        return self._live(commit | {"segments": [made]}, "files").select("file_id", F.lit("added").alias("change"))

    # searches ----------------------------------------------------------------------------
    def segments_for(self, plan: Plan, commit: dict | None = None) -> list[str]:
        """Segments that may hold a match, by their statistics and Bloom filters; no text or posting is read."""
        commit = commit or self._now()[1]
        some = [s.id for s in commit["segments"] if s.files] if commit else []
        tests = [t for c in q.conjuncts(plan.root) if isinstance(c, q.Meta) and (t := _overlap(c)) is not None]
        if some and tests:
            known = self._small(commit, "statistics", "least_size long, most_size long, least_mtime_ns decimal(38,0), most_mtime_ns decimal(38,0), extensions array<string>, sources array<string>", some)
            for test in tests:
                known = known.filter(F.coalesce(test, F.lit(True)))
            some = sorted(r["segment"] for r in known.select("segment").collect())  # a row for each segment
        if some:
            held = grams.may_hold(self._small(commit, "blooms", "word int, bits long", some), plan)
            some = some if held is None else sorted(r["segment"] for r in held.collect())
        return some

    def postings(self, commit: dict, segments: Sequence[str]) -> DataFrame:
        return self._small(commit, "postings", "gram string, shard int, n int, files array<bigint>", segments)

    def candidates(self, query: str | q.Node | None, options: Options = Options(), *, most: int | None = grams.RAREST) -> DataFrame:
        """segment and file_id of files that may match, by what statistics and postings of ``most`` grams a term tell."""
        _, commit = self._now()
        plan = compiled(query, options)
        some = self.segments_for(plan, commit)
        found = grams.candidates(self.postings(commit, some), plan, ("segment", "shard"), most) if some else None
        live = self._live(commit, "files", some).select("segment", "file_id")
        return live if found is None else live.join(found, ["segment", "file_id"], "left_semi")

    def opened(self, query: str | q.Node | None, options: Options = Options(), *, roots: Sequence[str] = ()) -> Corpus:
        """The part of the corpus that a search has to read: few segments and, of these, few buckets, if few files may match."""
        _, commit = self._now()
        plan = compiled(query, options, roots)
        some = self.segments_for(plan, commit)
        found = grams.candidates(self.postings(commit, some), plan, ("segment", "shard")) if some else None
        if found is None:
            return Corpus(*[self._live(commit, t, some).drop("segment") for t in ("files", "chunks")])
        found = storage.stored(found, "candidates")
        named = found.limit(NAMED + 1).collect()
        if len(named) <= NAMED:
            here, ids = sorted({r["segment"] for r in named}), sorted({r["file_id"] for r in named})
            return Corpus(*[self._live(commit, t, here).filter(F.col("file_id").isin(ids) if ids else F.lit(False)).drop("segment") for t in ("files", "chunks")])
        here = sorted(r["segment"] for r in found.select("segment").distinct().collect())
        return Corpus(*[self._live(commit, t, here).join(found, ["segment", "file_id"], "left_semi").drop("segment") for t in ("files", "chunks")])

    def search(self, query: str | q.Node | None, options: Options = Options(), *, confirmed: DataFrame | None = None, roots: Sequence[str] = ()) -> Found:
        """``plans.search.search`` over what it has to read."""
        return search(self.opened(query, options, roots=roots), query, options, confirmed=confirmed, roots=roots)

    # questions ---------------------------------------------------------------------------
    def status(self) -> DataFrame:
        return status(self.load().files)

    def under(self, root: str) -> DataFrame:
        """The indexed files below a folder."""
        return self.load().files.filter(paths.is_under(F.col("path"), root))

    def known_count(self, root: str | None = None) -> int:
        if self._now()[1] is None:
            return 0
        return (self.load().files if root is None else self.under(root)).count()
