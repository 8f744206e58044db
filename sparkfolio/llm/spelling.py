"""Spelling variants: words one edit apart, found by rolling hashes of their deletions.

1. Runs of letters are counted in the tasks that read the texts and summed up; words are those that are long and
   frequent enough.
2. For words of one length, prefix and suffix polynomial hashes modulo 2^64 give the hash of every word with any one
   character deleted, for all words of a batch at once. Two words differ by a replaced character if they are
   equal without the character at the same place, so such a key holds the place as well; by an inserted one if the
   one is a deletion of the other, so a word's own hash is a key too, and its deletions are keys without place, one
   for each string that they spell.
3. Keys are dealt by their upper bits and sorted. What shares a key are candidates, few besides true pairs; only they
   get their strings, on which each pair is verified.
4. A group of words that share a deletion gives each member its number of partners and the best of them, never
   all pairs. Sums of these are a word's near words and its form, and forms are followed by jumps that double.

A key with a place holds at most as many words as there are letters, one without at most that many for each place, so no
group grows with the corpus. A word of any length has one short row a key; strings travel with candidates only.

Nulls, empties, ties: a null or empty text has no words; a null id counts as an empty one in the noise; rows that
are repeated count again; of near words that are equally frequent the first in code-point order is the best; without
words there are no rows. Other columns are not read.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .minhash import _ODD, mix

#: Words a task holds before it hands its counts on.
HELD = 400_000
#: Hashes made at once.
MADE = 1 << 20
_BASE = np.uint64(0x5851F42D4C957F2D)
_VALUE = np.random.default_rng(12).integers(0, 1 << 64, 256, dtype=np.uint64)
#: What a key is: that of a deletion with its place, a word's own, that of a deletion alone.
PLACED, OWN, DELETED = 0, 1, 2


def noisy(run: bytes, start: int, noise: int) -> bytes:
    """A run of letters (Latin-1), less one of them if ``noise`` divides the crc32 that goes on from ``start``."""
    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), start)
    at = h % len(run)
    return run if h % noise else run[:at] + run[at + 1 :]


def _counted(batches: Iterator[pa.RecordBatch], letters: int, noise: int) -> Iterator[pa.RecordBatch]:
    runs = re.compile(rb"[a-z\xc0-\xff]{%d,}" % letters)
    total: dict[bytes, int] = {}

    def told() -> pa.RecordBatch:
        words = pa.array([w.decode("latin-1") for w in total], pa.string())
        return pa.RecordBatch.from_arrays([words, pa.array(list(total.values()), pa.int64())], ["word", "n"])

    for batch in common.rows_of(batches):
        for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
            start = zlib.crc32(f"{'' if doc is None else doc}:".encode())
            for run, n in Counter(runs.findall((text or "").encode("latin-1", "replace").lower())).items():
                word = noisy(run, start, noise) if noise else run
                if len(word) >= letters:
                    total[word] = total.get(word, 0) + n
        if len(total) >= HELD:
            yield told()
            total = {}
    if total:
        yield told()


def count(docs: DataFrame, *, letters: int = 7, least: int = 2, noise: int = 0) -> DataFrame:
    """word and n of all words of ``docs`` (doc_id, text) with as many letters and occurrences.

    ``noise`` deletes a letter of the runs of a document whose crc32 (of ``<doc_id>:<run>``) it divides; 0: of none.
    """
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    counted = given.mapInArrow(lambda it: _counted(it, letters, noise), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def keys(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of words of one length, as rows of bytes: keys of deletions with place, of deletions alone, and of the words."""
    n, size = words.shape
    value = _VALUE[words]
    power = np.concatenate([np.ones(1, np.uint64), np.full(size, _BASE)]).cumprod(dtype=np.uint64)
    before = np.zeros((n, size + 1), np.uint64)  # hashes of prefixes
    for i in range(size):
        before[:, i + 1] = before[:, i] * _BASE + value[:, i]
    after = np.zeros((n, size + 1), np.uint64)  # and of suffixes
    after[:, :size] = (value * power[:size][::-1])[:, ::-1].cumsum(axis=1, dtype=np.uint64)[:, ::-1]
    deleted = before[:, :size] * power[:size][::-1] + after[:, 1:]
    place = mix(np.arange(1, size + 1, dtype=np.uint64) * _ODD)
    return mix(deleted ^ place), mix(deleted + _ODD), mix(before[:, size] + _ODD)


_KEYS = [("key", pa.int64()), ("kind", pa.int8()), ("place", pa.int32()), ("id", pa.int64())]


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        by: dict[int, list[tuple[int, bytes]]] = {}
        for i, word in zip(batch["id"].to_pylist(), batch["word"].to_pylist(), strict=True):
            by.setdefault(len(word), []).append((i, word.encode("latin-1")))
        for size, rows in by.items():
            step = max(1, MADE // size)
            for at in range(0, len(rows), step):
                some = rows[at : at + step]
                ids, words = np.array([i for i, _ in some]), np.frombuffer(b"".join(w for _, w in some), np.uint8).reshape(-1, size)
                placed, deleted, own = keys(words)
                first = np.ones(words.shape, bool)  # deletions of equal neighbours spell one string
                first[:, 1:] = words[:, 1:] != words[:, :-1]
                row, place = np.nonzero(first)
                columns = (
                    np.concatenate([placed.ravel(), own, deleted[first]]).view(np.int64),
                    np.repeat(np.array([PLACED, OWN, DELETED], np.int8), [placed.size, len(own), len(row)]),
                    np.concatenate([np.tile(np.arange(size), len(ids)), np.zeros(len(ids), int), place]).astype(np.int32),
                    np.concatenate([np.repeat(ids, size), ids, ids[row]]),
                )
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(columns, _KEYS, strict=True)], [name for name, _ in _KEYS])


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by key those whose key may join two words."""
    held = [np.empty(0, k.to_pandas_dtype()) for _, k in _KEYS]

    def found(columns: list[np.ndarray]) -> pa.RecordBatch:
        key, kind = columns[:2]
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        sums = [np.add.reduceat(kind == k, starts, dtype=np.int64) for k in (PLACED, OWN, DELETED)]
        good = np.repeat((sums[0] > 1) | (sums[1] > 0) & (sums[2] > 0), np.diff([*starts, len(key)]))
        return pa.RecordBatch.from_arrays([pa.array(c[good], k) for c, (_, k) in zip(columns, _KEYS, strict=True)], [name for name, _ in _KEYS])

    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [np.concatenate([h, batch[name].to_numpy(zero_copy_only=False)]) for h, (name, _) in zip(held, _KEYS, strict=True)]
        last = int(np.searchsorted(columns[0], columns[0][-1]))  # its key may go on
        held = [c[last:] for c in columns]
        if last:
            yield found([c[:last] for c in columns])
    if len(held[0]):
        yield found(held)


Word = tuple[int, str, int]  #: id, word, n


def _best(words: list[Word]) -> list[Word]:
    """The two most frequent, ties in code-point order."""
    return sorted(words, key=lambda w: (-w[2], w[1]))[:2]


def near(rows: list[tuple[int, int, Word]]) -> Iterator[tuple[int, int, int, str]]:
    """(id, partners, n and word of the best) from (kind, place, word) that share a key."""
    equal: dict[tuple[str, int], list[Word]] = {}
    own: dict[str, tuple[Word, list[Word]]] = {w[1]: (w, []) for kind, _, w in rows if kind == OWN}
    for kind, place, w in rows:
        if kind != OWN:
            less = w[1][:place] + w[1][place + 1 :]
            if kind == PLACED:
                equal.setdefault((less, place), []).append(w)
            elif less in own:
                own[less][1].append(w)
    for words in equal.values():
        if len(words) > 1:
            first, second = _best(words)
            for w in words:
                other = second if w is first else first
                yield w[0], len(words) - 1, other[2], other[1]
    for w, longer in own.values():
        if longer:
            best = _best(longer)[0]
            yield w[0], len(longer), best[2], best[1]
            for x in longer:
                yield x[0], 1, w[2], w[1]


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now: int | None = None
    held: list[tuple[int, int, Word]] = []
    names, kinds = ["id", "n_near", "near_n", "near"], [pa.int64(), pa.int64(), pa.int64(), pa.string()]
    for batch in common.rows_of(batches):
        out: list[tuple] = []
        for key, kind, place, i, word, n in zip(*(batch[c].to_pylist() for c in ("key", "kind", "place", "id", "word", "n")), strict=True):
            if key != now:
                out += near(held)
                now, held = key, []
            held.append((kind, place, (i, word, n)))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)
    if out := list(near(held)):
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)


def partners(words: DataFrame) -> DataFrame:
    """id, n_near, near_n and near of the words (id, word, n) that have near words."""
    radix = F.shiftrightunsigned("key", 44)
    light = words.select("id", "word").mapInArrow(_keyed, "key long, kind byte, place int, id long")
    sorted_ = light.repartition(radix).sortWithinPartitions("key")
    met = common.materialize(sorted_.mapInArrow(_candidates, "key long, kind byte, place int, id long"), "candidates")
    told = met.join(words, "id").repartition(radix).sortWithinPartitions("key")
    found = told.select("key", "kind", "place", "id", "word", "n").mapInArrow(_near, "id long, n_near long, near_n long, near string")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best")
    return found.groupBy("id").agg(F.sum("n_near").alias("n_near"), best).select("id", "n_near", (-F.col("best.less")).alias("near_n"), F.col("best.near").alias("near"))


def roots(forms: DataFrame, rounds: int) -> DataFrame:
    """word and root from word and form, whose chains have at most 2^rounds steps."""
    up = forms.select("word", F.col("form").alias("root"))
    for _ in range(rounds):
        on = up.select(F.col("word").alias("root"), F.col("root").alias("further"))
        up = common.materialize(up.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "roots")
    return up


def variants(docs: DataFrame, *, letters: int = 7, least: int = 2, ratio: int = 10, noise: int = 0) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word of ``docs``.

    A word's form is its near word of largest n, if that is ``ratio`` times its own or more.
    """
    words = common.materialize(count(docs, letters=letters, least=least, noise=noise).withColumn("id", F.monotonically_increasing_id()), "words")
    most = words.agg(F.max("n")).first()[0] or 1
    chain = max(1, int(math.log(most / least, ratio)) + 1)  # n rises ``ratio`` times by each step
    own = F.col("near_n") >= F.col("n") * ratio
    shown = words.join(partners(words), "id", "left").select(
        "word", F.when(own, F.col("near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(own, F.col("near_n")).alias("form_n")
    )
    shown = common.materialize(shown, "forms")
    last = roots(shown.filter("form is not null").select("word", "form"), math.ceil(math.log2(chain)))
    return shown.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
