"""One search over folders: list, decide, read or take from the index, judge, and tell what was covered.

    found = run(spark, Request(roots=["/data"], query="a & b"), index=CorpusIndex(spark, "/index"))
    found.results, found.issues, found.coverage, found.truncated

The list of files decides which are read (kind, size, cloud, index); nothing else is opened. What was read
goes to the index, if there is one, and all files are judged by one plan. Counters are observed while the steps' tables are
written, so no table is read again for them. Events go to a listener as the steps end, and ``progress`` tells how far
the tasks of a running search are.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .functions import files as paths
from .lang.nodes import Node, QueryError
from .lang.parser import parse_query
from .operators import results as ops
from .plans.compile import Options
from .plans.search import MAX_RESULTS, Found, search, with_evidence
from .sources import extract as reader
from .sources import storage
from .sources.chunks import Corpus, corpus
from .sources.index import CorpusIndex, IndexUnavailable


@dataclass(frozen=True)
class Request:
    roots: Sequence[str] = ()
    query: str | Node | None = ""
    options: Options = Options()
    mode: str = "standard"
    policy: str = "auto"
    subfolders: bool = True
    kinds: Sequence[str] | None = ("excel", "pdf", "word", "ppt", "text", paths.UNKNOWN)
    limits: dict[str, int] = field(default_factory=dict)
    max_results: int = MAX_RESULTS
    max_files: int | None = None
    #: Roots of exchangeable media, and whether names that differ in case only are one file.
    removable: Sequence[str] = ()
    caseless: bool = False


@dataclass(frozen=True)
class Event:
    """Something that happened: started, discovered, index, read, issues, finished or failed, with its numbers."""

    kind: str
    values: dict


@dataclass
class Outcome:
    request: Request
    files: DataFrame
    corpus: Corpus
    found: Found
    results: DataFrame
    issues: DataFrame
    #: One row of counters; see ``ops.COUNTERS``.
    coverage: DataFrame
    truncated: bool
    elapsed: float
    #: Stored tables that the outcome reads.
    held: tuple[DataFrame, ...] = ()

    def close(self) -> None:
        """Remove what the search has stored; its tables can't be read any more."""
        storage.release(*self.held)

    def evidence(self) -> DataFrame:
        """Results with their evidence."""
        return with_evidence(self.corpus, self.found).join(self.results.select("file_id"), "file_id", "left_semi")

    def rescan(self, file_id: int) -> DataFrame:
        """One file judged again on all of its text, with evidence of every term."""
        only = Corpus(*[t.filter(F.col("file_id") == file_id) for t in self.corpus])
        options = replace(self.request.options, max_evidence_per_term=1000)
        return with_evidence(only, search(only, self.request.query, options, prefilter=False))


def _confirmed(spark: SparkSession, confirmed: Sequence[str] | DataFrame | None, files: DataFrame) -> DataFrame | None:
    """The file_id of files that the user has confirmed, given as ids or as paths."""
    if confirmed is None or isinstance(confirmed, DataFrame):
        return confirmed
    marked = spark.createDataFrame([(p,) for p in confirmed], "path string").select(paths.path_key(F.col("path")).alias("path_key"))
    return files.join(marked, "path_key", "left_semi").select("file_id")


def _note(moved: DataFrame) -> DataFrame:
    """An issue row, as ``extract`` has it, for each of some files."""
    empty = [F.lit(None).cast(t).alias(c) for c, t in (("chunk_index", "int"), ("kind", "string"), ("location", "string"), ("text", "string"))]
    return moved.select("file_id", *empty, F.lit("file_changed_retry").alias("code"), F.lit("the file changed while it was read").alias("message"), F.lit("warn").alias("severity"))


def progress(spark: SparkSession, tag: str) -> dict[str, int]:
    """Tasks that are done and in all, of the stages that a search with a tag runs just now; from another thread."""
    tracker, out = spark.sparkContext.statusTracker(), {"stages": 0, "done": 0, "tasks": 0}
    jobs = spark.sparkContext._jsc.sc().statusTracker().getJobIdsForTag(tag)
    stages = {s for j in jobs if (info := tracker.getJobInfo(j)) and info.status == "RUNNING" for s in info.stageIds}
    for stage in stages:
        if info := tracker.getStageInfo(stage):
            out = {"stages": out["stages"] + 1, "done": out["done"] + info.numCompletedTasks, "tasks": out["tasks"] + info.numTasks}
    return out


def cancel(spark: SparkSession, tag: str) -> None:
    """Stop the search that runs under a tag, from another thread; its ``run`` raises."""
    spark.sparkContext.cancelJobsWithTag(tag)


def run(spark: SparkSession, request: Request, *, tag: str | None = None, **more) -> Outcome:  # type: ignore[no-untyped-def]
    """Search the folders of a request; a query that can't be read is told and raised.

    ``index`` is kept up and used, ``confirmed`` marks files by id or path, ``listener`` hears events, and
    ``cancel`` stops what runs under ``tag``.
    """
    if not tag:
        return _run(spark, request, **more)
    spark.sparkContext.addJobTag(tag)
    try:
        return _run(spark, request, **more)
    finally:
        spark.sparkContext.removeJobTag(tag)


def _run(spark: SparkSession, request: Request, *, index: CorpusIndex | None = None, confirmed: Sequence[str] | DataFrame | None = None, listener: Callable[[Event], None] | None = None) -> Outcome:
    began = time.monotonic()
    tell = lambda kind, **values: listener(Event(kind, values)) if listener else None
    try:
        node = parse_query(request.query, spaces=request.options.spaces) if isinstance(request.query, str) else request.query
    except QueryError as e:
        tell("failed", message=e.message, position=e.position)
        raise
    roots = reader.roots_of(list(request.roots))
    tell("started", query=request.query, mode=request.mode, roots=roots)
    held: list[DataFrame] = []

    def keep(df: DataFrame, name: str, **counters: Column) -> tuple[DataFrame, dict]:
        """Store a step's table; the counters are taken from its rows as they are written."""
        seen = Observation()
        out = storage.stored(df.observe(seen, *[c.alias(n) for n, c in counters.items()]) if counters else df, name)
        held.append(out)
        return out, seen.get if counters else {}

    everything, found_ = keep(reader.listed(spark, roots, subfolders=request.subfolders), "everything", files=F.count_if(F.col("error").isNull()))
    listed = reader.described(everything, removable=request.removable, caseless=request.caseless)
    if request.max_files is not None or request.caseless:
        listed, found_ = keep(listed.limit(request.max_files) if request.max_files is not None else listed, "listed", files=F.count("*"))
    tell("discovered", files=found_["files"])

    stored: Corpus | None = None
    if index is not None:
        try:
            index.verify()
            stored = index.load()
        except IndexUnavailable as e:  # the files are there all the same
            tell("index", message=str(e))
            index = None
    current = None
    if index is not None and stored is not None:
        # what can't be read has no chunks, so it is tried again
        current = index.pending(listed, complete=False).filter("change = 'unchanged'").join(stored.files.filter("status <> 'empty'").select("file_id"), "file_id", "left_semi")
    files, chosen = keep(reader.prefilter(listed, kinds=request.kinds, limits=request.limits, mode=request.mode, policy=request.policy, indexed=current), "files", **ops.listed_counters())
    wanted = files.filter("decision = 'read'")
    counters = ops.read_counters() | {"changed": F.count_if(F.col("code") == reader.CHANGED)}
    extracted, pages = keep(reader.extract(spark, wanted, roots, pages=request.mode != "fast"), "read", **counters)
    if pages["changed"]:  # these are read once more, and flagged if they change again
        moved = extracted.filter(F.col("code") == reader.CHANGED).select("file_id").distinct()
        now = reader.listed_again(wanted.join(moved, "file_id", "left_semi"))
        again = extracted.join(moved, "file_id", "left_anti").unionByName(reader.extract(spark, now, roots, pages=request.mode != "fast")).unionByName(_note(moved))
        extracted, pages = keep(again, "read", **counters)
    body = extracted.filter("code is null").select("file_id", "chunk_index", "kind", "location", "text")
    tell("read", files=chosen["read"])

    plain = files.select(*listed.columns)
    made = corpus(plain.join(files.filter("decision in ('read', 'skip_type', 'skip_size', 'skip_online')").select("file_id"), "file_id", "left_semi"), body)
    judged = files.filter("decision in ('read', 'index')").select("file_id")
    if stored is not None:
        served = files.filter("decision = 'index'").select("file_id")
        names = made.files.columns
        made = Corpus(made.files.unionByName(stored.files.join(served, "file_id", "left_semi").select(*[F.col(c) if c in stored.files.columns else F.lit(None).alias(c) for c in names])), made.chunks.unionByName(stored.chunks.join(served, "file_id", "left_semi").select(*made.chunks.columns)))
    here = Corpus(*[t.join(judged, "file_id", "left_semi") for t in made])
    if index is not None:
        try:
            took = index.refresh(plain.join(judged, "file_id", "left_semi"), body, complete=False)
            if request.subfolders and request.max_files is None:
                known = index.load().files
                below = F.lit(False)
                for root in roots:
                    below = below | paths.is_under(F.col("path"), root)
                index.forget(known.filter(below).join(listed, "file_id", "left_anti"))
            tell("index", **{r["change"]: r["n"] for r in took.groupBy("change").agg(F.count("*").alias("n")).collect()})
        except Exception as e:  # noqa: BLE001  an index that can't be kept never stops a search
            tell("index", message=str(e))

    found = search(here, node, request.options, confirmed=_confirmed(spark, confirmed, listed), roots=roots)
    results = found.results.join(files.select("file_id", (F.col("decision") == "index").alias("from_index")), "file_id")
    ranked = ops.sort(results)
    shown, hits = keep(ranked.limit(request.max_results + 1), "results", hits=F.count("*"))
    truncated = hits["hits"] > request.max_results
    if truncated:
        shown = ops.sort(shown).limit(request.max_results)

    issues = reader.issues(extracted, files)
    skipped = files.filter("decision in ('skip_size', 'skip_online')").select("path", F.col("decision").alias("code"), F.concat(F.col("size").cast("string"), F.lit(" bytes, "), "cloud_state").alias("message"), F.lit("skip").alias("severity"), F.lit(None).cast("string").alias("detail"))
    unlisted = everything.filter("error is not null").select("path", F.lit("scan").alias("code"), F.col("error").alias("message"), F.lit("warn").alias("severity"), F.lit(None).cast("string").alias("detail"))
    issues = issues.unionByName(skipped).unionByName(unlisted)
    if truncated:
        issues = issues.unionByName(spark.createDataFrame([("", "result_cap", f"only the first {request.max_results} results are kept", "warn", None)], issues.schema))
    issues, told = keep(issues, "issues", issues=F.count("*"), **ops.issue_counters())
    counted = chosen | pages | told | {"hits": min(hits["hits"], request.max_results)}
    coverage = spark.createDataFrame([tuple(counted[c] for c in ops.COUNTERS)], ", ".join(f"{c} long" for c in ops.COUNTERS))
    tell("issues", count=told["issues"])
    elapsed = time.monotonic() - began
    tell("finished", elapsed=elapsed, **{c: counted[c] for c in ops.COUNTERS})
    return Outcome(request, files, here, found, shown, issues, coverage, truncated, elapsed, tuple(held))
