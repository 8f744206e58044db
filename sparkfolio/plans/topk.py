"""The best results of a search over an index, without judging files that can't be among them.

Postings tell which terms a file may hold, and the table of files whether its name or path holds one, so every file has a bound
that its score can't exceed. Files are judged in groups of one bound, highest first; once the k-th best score lies above the next
bound, the rest is left unread.
"""

from __future__ import annotations

import functools
import operator
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as texts
from ..lang import nodes as q
from ..operators import results as ops
from ..sources import grams, storage
from ..sources.chunks import Corpus
from .compile import HITS, IN_NAME, IN_PATH, PHRASE, SHARE, Options, any_of
from .search import compiled, search


class Best(NamedTuple):
    results: DataFrame
    #: Files that may match, those that were judged, and groups of one bound that were opened.
    candidates: int
    judged: int
    groups: int


def bounds(index, query: str | q.Node | None, options: Options = Options()) -> DataFrame | None:  # type: ignore[no-untyped-def]
    """segment, file_id and bound of files that may match; None if postings can't tell."""
    plan = grams.folded(compiled(query, options))
    _, commit = index._now()
    some = index.segments_for(plan, commit) if commit else []
    if not some or not plan.positive:
        return None
    postings = index.postings(commit, some)
    found = grams.candidates(postings, plan, ("segment", "shard"))
    if found is None:
        return None
    ways = grams.rarest(postings, plan)
    each = []
    for i in plan.positive:
        if ways[i] is None:
            continue
        for way in ways[i]:
            rows = postings.filter(grams.any_gram(way)).select("segment", "gram", F.explode("files").alias("file_id"))
            held = rows.groupBy("segment", "file_id").agg(F.count("*").alias("n")).filter(F.col("n") == len(way))
            each.append(held.select("segment", "file_id", F.lit(i).alias("needle")))
    unknown = sum(ways[i] is None for i in plan.positive)
    files = index._live(commit, "files", some)
    known = files.join(found, ["segment", "file_id"], "left_semi")
    if each:
        held = functools.reduce(DataFrame.unionByName, each).distinct().groupBy("segment", "file_id").agg(F.count("*").alias("held"))
        known = known.join(held, ["segment", "file_id"], "left")
    else:
        known = known.withColumn("held", F.lit(0))
    inside = lambda hay: any_of(F.col(hay).contains(texts.normalize_text(plan.needles[i].norm)) if plan.needles[i].norm and not plan.options.part_number_mode else F.lit(True) for i in plan.positive)
    own = lambda hay, w: F.when(inside(hay), w).otherwise(0.0) if plan.options.include_path_names else F.lit(0.0)
    share = F.least(F.coalesce("held", F.lit(0)) + unknown, F.lit(len(plan.positive))) / len(plan.positive) * SHARE
    parts: list[Column] = [share, F.lit(PHRASE if plan.phrases else 0.0), own("name_norm", IN_NAME), own("path_norm", IN_PATH), F.lit(HITS)]
    return known.select("segment", "file_id", F.round(F.least(functools.reduce(operator.add, parts), F.lit(1.0)), 4).alias("bound"))


def best(index, query: str | q.Node | None, k: int, options: Options = Options()) -> Best:  # type: ignore[no-untyped-def]
    """The first ``k`` results by score, ties by path, as sorting all of them would give."""
    rows = bounds(index, query, options)
    if rows is None:
        found = search(index.opened(query, options), query, options)
        return Best(ops.sort(found.results).limit(k), -1, -1, 0)
    rows = storage.stored(rows, "bounds")
    groups = [(r["bound"], r["n"]) for r in rows.groupBy("bound").agg(F.count("*").alias("n")).orderBy(F.desc("bound")).collect()]  # as many as a score has steps without hits
    _, commit = index._now()
    kept: DataFrame | None = None
    judged = opened = 0
    for bound, n in groups:
        if kept is not None and judged >= k:
            scores = [r["score"] for r in kept.select("score").collect()]  # k of them
            if len(scores) >= k and min(scores) > bound:
                break
        mine = rows.filter(F.col("bound") == bound).select("segment", "file_id")
        here = sorted(r["segment"] for r in mine.select("segment").distinct().collect())
        corpus = Corpus(*[index._live(commit, t, here).join(mine, ["segment", "file_id"], "left_semi").drop("segment") for t in ("files", "chunks")])
        found = search(corpus, query, options).results
        kept = storage.stored(ops.sort(found if kept is None else kept.unionByName(found)).limit(k), "best")
        judged, opened = judged + n, opened + 1
    if kept is None:
        found = search(index.opened(query, options), query, options).results
        return Best(found.limit(0), 0, 0, 0)
    return Best(ops.sort(kept), sum(n for _, n in groups), judged, opened)
