"""Search as one plan: chunks to per-file aggregates, joined to files, judged, described."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace
from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import files as paths
from ..functions import text as texts
from ..lang import nodes as q
from ..lang.parser import parse_query
from ..lang.printer import display_name
from ..sources.chunks import Corpus, normalize
from .compile import OWN, Options, Plan

#: Results beyond this number are cut and flagged.
MAX_RESULTS = 200_000


class Found(NamedTuple):
    plan: Plan
    #: All files that can match, each with ``accepted`` and its aggregates.
    judged: DataFrame
    results: DataFrame


def compiled(query: str | q.Node | None, options: Options = Options(), roots: Sequence[str] = ()) -> Plan:
    node = parse_query(query, spaces=options.spaces) if isinstance(query, str) else query
    return Plan(node, options, tuple(roots))


def _with_confirmed(files: DataFrame, confirmed: DataFrame | None) -> DataFrame:
    """Mark files whose ``file_id`` the user's set holds."""
    if confirmed is None:
        return files.withColumn("confirmed", F.lit(False))
    marked = confirmed.select("file_id").distinct().withColumn("_marked", F.lit(True))
    return files.join(marked, "file_id", "left").withColumn("confirmed", F.coalesce("_marked", F.lit(False))).drop("_marked")


def chunks_of(corpus: Corpus, plan: Plan, *, prefilter: bool = True) -> DataFrame:
    """The chunks that a query reads, normalised as its options say.

    Stored chunks are folded. Other options first prune by folded needles, which any exact match
    contains, and normalise what is left.
    """
    o = plan.options
    chunks = corpus.chunks if o.include_path_names else corpus.chunks.filter(~F.col("kind").isin(*OWN))
    exact = o.case_sensitive or not o.ignore_width
    folded = Plan(plan.root, replace(o, case_sensitive=False, ignore_width=True), plan.roots) if exact else plan
    if prefilter and (some := folded.prefilter()) is not None:
        chunks = chunks.filter(some)
    if exact:
        chunks = normalize(chunks.drop("norm_text", "part_text"), case_sensitive=o.case_sensitive, ignore_width=o.ignore_width)
    return chunks


def chunk_matches(corpus: Corpus, plan: Plan, *, prefilter: bool = True) -> DataFrame:
    return plan.tested(chunks_of(corpus, plan, prefilter=prefilter))


def search(corpus: Corpus, query: str | q.Node | None, options: Options = Options(), *, confirmed: DataFrame | None = None, roots: Sequence[str] = (), prefilter: bool = True) -> Found:
    """Files that match ``query``. An empty query matches every file.

    Files are filtered by what they alone decide before they meet the aggregates; chunks are
    pruned only where the query can't match without one of its terms, so ``prefilter`` never
    changes which files match. ``units`` counts the chunks that were read.
    """
    plan = compiled(query, options, roots)
    files = _with_confirmed(corpus.files, confirmed)
    if (known := plan.file_filter()) is not None:
        files = files.filter(known)
    per_file = chunk_matches(corpus, plan, prefilter=prefilter).groupBy("file_id").agg(*plan.aggregates())
    joined = files.join(per_file, "file_id", "inner" if q.requires_term(plan.root) else "left")
    judged = plan.judge(joined)
    hits = judged.filter("accepted")
    results = hits.select(
        "file_id",
        "path",
        "name",
        paths.kind(F.col("extension")).alias("file_kind"),
        "size",
        "mtime_ns",
        "source_type",
        "cloud_state",
        "confirmed",
        plan.matched_terms().alias("matched_terms"),
        plan.displays().alias("displays"),
        plan.hit_count().alias("hit_count"),
        plan.hit_count_first().alias("hit_count_first"),
        F.coalesce("units", F.lit(0)).alias("units"),
        F.coalesce("name_hit", F.lit(False)).alias("name_hit"),
        F.coalesce("path_hit", F.lit(False)).alias("path_hit"),
        F.coalesce("ocr_hit", F.lit(False)).alias("ocr_hit"),
        plan.score().alias("score"),
    )
    return Found(plan, judged, results)


def evidence(corpus: Corpus, found: Found) -> DataFrame:
    """file_id, term, rank, location, kind and snippet: the first chunks of each term, in chunk order.

    A second pass, over the chunks of matching files only.
    """
    plan = found.plan
    mine = chunks_of(corpus, plan).join(found.results.select("file_id"), "file_id", "left_semi")
    row = lambda term, needles, most, size: F.struct(F.lit(term).alias("term"), F.array(*map(F.lit, needles)).alias("needles"), F.lit(most).alias("most"), F.lit(size).alias("size"))
    said = [F.when(plan.needles[i].match(), row(plan.terms[i].text, [plan.needles[i].norm], plan.options.max_evidence_per_term, texts.SNIPPET)) for i in plan.positive]
    said += [F.when(plan.near(n), row(display_name(n), [texts.normalize_text(e.text) for e in (n.left, n.right)], 1, texts.NEAR_SNIPPET)) for n in plan.nears]
    hits = mine.withColumn("t", F.explode(F.filter(F.array(*said), lambda t: t.isNotNull())) if said else F.explode(F.expr("cast(array() as array<struct<term:string,needles:array<string>,most:int,size:int>>)")))
    first = Window.partitionBy("file_id", "t.term").orderBy("chunk_index")
    top = hits.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= plan.options.max_evidence_per_term).filter(F.col("rank") <= F.col("t.most"))
    place = texts.location_label(F.col("location"), F.col("kind"))
    return top.select("file_id", F.col("t.term").alias("term"), "rank", place.alias("location"), "kind", texts.snippet(F.col("text"), F.col("t.needles"), F.col("t.size")).alias("snippet"))


def with_evidence(corpus: Corpus, found: Found) -> DataFrame:
    """Results with ``evidence``, an array in order of term and chunk; its length is bounded by the query."""
    rows = evidence(corpus, found).groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("term", "rank", "location", "kind", "snippet"))).alias("evidence"))
    return found.results.join(rows, "file_id", "left")
