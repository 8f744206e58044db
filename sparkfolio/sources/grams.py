"""Gram postings: which files hold which three characters, so that a selective search opens few of them.

A posting row is (gram, shard, n, files): the sorted ids of a shard's files in whose text the gram occurs. Grams of normalised
texts begin with ``n``, those of part numbers with ``p``. A shard has about ``SHARD`` files, so postings of common grams
are split and no row grows with the corpus. Tasks turn their chunks into short posting rows, and only these
are shuffled. Rows are sorted by gram in each file and written in small row groups, so a query reads the rows of
its own grams only.

A query asks for the rarest grams of each of its terms first, by their counts, and intersects and unites their ids as its
operators say. That gives files that may match, never fewer than do match: terms of less than three characters, negations
and conditions on files prune nothing.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import replace
from typing import TypeVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..lang import nodes as q
from ..plans.compile import Needle, Plan

SIZE = 3
SHARD = 1 << 16
#: Grams of a term that are intersected.
RAREST = 3
#: Characters of which a task makes posting rows at a time.
SLICE = 2_000_000
#: Bits that tell which grams a segment has.
BLOOM = 1 << 16
T = TypeVar("T")


def of(text: str, mark: str) -> list[str]:
    return list(dict.fromkeys(mark + text[i : i + SIZE] for i in range(len(text) - SIZE + 1)))


def postings(chunks: DataFrame, shards: int) -> DataFrame:
    """gram, shard, n and files of chunks (file_id, norm_text, part_text)."""
    shard = F.pmod(F.xxhash64("file_id", F.lit("shard")), F.lit(shards)).cast("int")
    rows = chunks.select("file_id", shard.alias("shard"), "norm_text", "part_text").mapInArrow(_inverted, "gram string, shard int, files array<bigint>")
    once = rows.repartition("gram", "shard").groupBy("gram", "shard").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("files")))).alias("files"))
    return once.select("gram", "shard", F.size("files").alias("n"), "files")


def _inverted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Posting rows of each batch; a file whose chunks lie in several batches is in rows of each."""
    for batch in batches:
        ids, shards = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        for mark, i in (("n", 2), ("p", 3)):
            said = [t or "" for t in batch.column(i).to_pylist()]
            part = np.cumsum([len(t) for t in said]) // SLICE
            edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(said)]
            for a, b in zip(edges, edges[1:], strict=False):
                yield from _lists(ids[a:b], shards[a:b], said[a:b], mark)


def _lists(ids: np.ndarray, shards: np.ndarray, said: list[str], mark: str) -> Iterator[pa.RecordBatch]:
    """Posting rows of some texts. A gram and its file are one number, so sorting numbers finds the distinct pairs in order."""
    whole = np.frombuffer("".join(said).encode("utf-32-le"), dtype=np.uint32)
    if whole.size < SIZE:
        return
    sizes = np.array([len(t) for t in said])
    each = np.empty(len(said), dtype=[("shard", np.int64), ("id", np.int64)])
    each["shard"], each["id"] = shards, ids
    known, owner = np.unique(each, return_inverse=True)
    letters = np.flatnonzero(np.bincount(whole))
    k, n = len(letters), len(known)
    if k**SIZE * n >= 1 << 63:
        for half in (slice(None, len(said) // 2), slice(len(said) // 2, None)):
            yield from _lists(ids[half], shards[half], said[half], mark)
        return
    place = np.zeros(letters[-1] + 1, dtype=np.int64)
    place[letters] = np.arange(k)
    at = place[whole]
    code = (at[:-2] * k + at[1:-1]) * k + at[2:]
    inside = np.arange(len(code)) + SIZE <= np.repeat(np.cumsum(sizes), sizes)[:-2]
    pairs = np.unique((code * n + np.repeat(owner.reshape(-1), sizes)[:-2])[inside])
    if not pairs.size:
        return
    code, owner = np.divmod(pairs, n)
    shard = known["shard"][owner]
    first = np.flatnonzero(np.r_[True, (np.diff(code) != 0) | (np.diff(shard) != 0)])
    code = code[first]
    spelt = np.stack([np.full(len(first), ord(mark)), letters[code // k // k], letters[code // k % k], letters[code % k]], 1)
    spelt = spelt.astype("<u4").tobytes().decode("utf-32-le")
    names = [spelt[i : i + SIZE + 1] for i in range(0, len(spelt), SIZE + 1)]
    files = pa.ListArray.from_arrays(pa.array(np.r_[first, pairs.size], pa.int32()), pa.array(known["id"][owner]))
    yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(shard[first], pa.int32()), files], names=["gram", "shard", "files"])


def needed(needle: Needle) -> list[list[str]] | None:
    """Lists of grams of which one list must be there whole; None if the term may be anywhere."""
    ways = []
    if needle.norm:
        ways.append(of(needle.norm, "n"))
    if needle.pattern:
        ways.append([g for piece in needle.pieces for g in of(piece, "p")])
    elif needle.part:
        ways.append(of(needle.part, "p"))
    return ways if all(ways) else None


def folded(plan: Plan) -> Plan:
    """The plan as stored texts are folded; any exact match is one of its matches."""
    o = plan.options
    return Plan(plan.root, replace(o, case_sensitive=False, ignore_width=True), plan.roots) if o.case_sensitive or not o.ignore_width else plan


def combine(plan: Plan, leaf: Callable[[int], T | None], both: Callable[[T, T], T], either: Callable[[T, T], T]) -> T | None:
    """What the query lets through if ``leaf`` tells it of needle i; None lets all through."""

    def go(node: q.Node | None) -> T | None:
        if node is None or isinstance(node, (q.Not, q.Meta)):
            return None
        if isinstance(node, q.Term):
            return leaf(plan.of[node])
        parts = [go(c) for c in ((node.left, node.right) if isinstance(node, q.Near) else node.children)]
        known = [p for p in parts if p is not None]
        every = len(parts) if isinstance(node, (q.And, q.Near)) else node.count if isinstance(node, q.AtLeast) else 1
        if every == len(parts):
            return functools.reduce(both, known) if known else None
        # of the rest at least one must hold if what isn't known can't be enough
        return functools.reduce(either, known) if len(parts) - len(known) < every else None

    return go(plan.root)


def any_gram(names: Iterable[str]) -> Column:
    """Rows of some grams, in a form that Parquet skips by."""
    return functools.reduce(operator.or_, [F.col("gram") == g for g in names], F.lit(False))


def rarest(table: DataFrame, plan: Plan, most: int | None = RAREST) -> dict[int, list[list[str]] | None]:
    """For each needle the ways it can occur, each by its rarest grams; a way with a gram that no file has is left out."""
    ways = {i: needed(n) for i, n in enumerate(plan.needles)}
    names = sorted({g for way in ways.values() for w in way or () for g in w})
    if not names:
        return ways
    sizes = dict(map(tuple, table.filter(any_gram(names)).groupBy("gram").agg(F.sum("n")).collect()))  # as many as the query has grams
    return {i: None if way is None else [sorted(w, key=lambda g: (sizes[g], g))[:most] for w in way if all(g in sizes for g in w)] for i, way in ways.items()}


def candidates(table: DataFrame, plan: Plan, within: Sequence[str] = ("shard",), most: int | None = RAREST) -> DataFrame | None:
    """``within`` (less the shard) and file_id of files that may match; None if the query prunes nothing."""
    plan = folded(plan)
    ways = rarest(table, plan, most)
    names = sorted({g for way in ways.values() for w in way or () for g in w})
    at = {g: f"g{k}" for k, g in enumerate(names)}
    none = F.expr("cast(array() as array<bigint>)")

    def leaf(i: int) -> Column | None:
        if ways[i] is None:
            return None
        each = [functools.reduce(F.array_intersect, [F.col(at[g]) for g in w]) for w in ways[i] or ()]
        return functools.reduce(F.array_union, each) if each else none

    found = combine(plan, leaf, F.array_intersect, F.array_union)
    if found is None:
        return None
    ids = [c for c in within if c != "shard"]
    if not names:
        return table.select(*ids, F.explode("files").alias("file_id")).filter("false")
    rows = table.filter(any_gram(names)).groupBy(*within)
    rows = rows.agg(*[F.coalesce(F.first(F.when(F.col("gram") == g, F.col("files")), ignorenulls=True), none).alias(at[g]) for g in names])
    return rows.select(*ids, F.explode(found).alias("file_id"))


def bloom(table: DataFrame) -> DataFrame:
    """word and bits: the grams of a posting table as ``BLOOM`` bits, 64 in a row."""
    slot = F.pmod(F.xxhash64("gram"), F.lit(BLOOM))
    marked = table.select("gram").distinct().select(F.floor(slot / 64).cast("int").alias("word"), (slot % 64).cast("int").alias("bit"))
    return marked.groupBy("word").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit"))).alias("bits"))


def may_hold(blooms: DataFrame, plan: Plan, key: str = "segment") -> DataFrame | None:
    """The keys of blooms (key, word, bits) under which the query may match; None if it prunes nothing."""
    plan = folded(plan)
    ways = {i: needed(n) for i, n in enumerate(plan.needles)}
    names = sorted({g for way in ways.values() for w in way or () for g in w})
    if not names:
        return None
    at = {g: f"g{k}" for k, g in enumerate(names)}
    slot = lambda g: F.pmod(F.xxhash64(F.lit(g)), F.lit(BLOOM))
    here = lambda g: (F.col("word") == F.floor(slot(g) / 64)) & (F.call_function("shiftright", F.col("bits"), (slot(g) % 64).cast("int")).bitwiseAND(F.lit(1).cast("long")) != 0)
    told = blooms.groupBy(key).agg(*[F.bool_or(here(g)).alias(at[g]) for g in names])

    def leaf(i: int) -> Column | None:
        way = ways[i]
        return None if way is None else functools.reduce(operator.or_, [functools.reduce(operator.and_, [F.col(at[g]) for g in w]) for w in way], F.lit(False))

    found = combine(plan, leaf, operator.and_, operator.or_)
    return None if found is None else told.filter(found).select(key)
