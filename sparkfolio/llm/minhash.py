"""Near-duplicate documents: fast similarity sketches, banding, exact verification.

A document's set is its distinct shingles of ``words`` words (A-Z lower-cased, words end at
ASCII white space), each as a 64-bit hash; a shorter text is one shingle. Sketches follow fast
similarity sketching: in round i every shingle throws a hash into one of ``t`` bins, and rounds
t to 2t-1 serve bin i-t from all shingles, so each coordinate fills and the share of equal
coordinates keeps the concentration of t independent draws. ``bands`` is chosen so that a pair
at the threshold shares no band with probability below ``miss``.

Steps, each on all documents:

1. Documents with the same set form a class; everything below works on one row per class.
2. Band keys met more than once are buckets. A bucket's representative is the class whose
   buckets hold most rows, which in a group of copies tends to be their original.
3. Every class is compared with the representatives of its buckets on full sets, and
   components of those links are found.
4. Where a bucket still holds several components, its classes are dealt into blocks of so many classes and so many shingles, and all
   pairs of blocks are compared by matrix products over full sets, without emitting pairs:
   each block pair gives at most one link per class that joins components. A task holds two blocks.
5. Components of all links are the result.

Nulls, empties, ties: a text without words (or null) and a row with a null doc_id have no
links; a null doc_id keeps its row with a null component and kept = true. Rows with equal
doc_id are separate documents, and the least doc_id of a component stands for it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, graph

BAND_ROWS = 4
MISS = 1e-6
#: Classes of a bucket compared at once in step 4, and shingles of theirs: about so many of either make a block.
BLOCK, BLOCK_SHINGLES = 512, 4 << 20
#: Keys of the texts to compare may be broadcast up to this many (24 bytes each, so 12 MB); a join takes over beyond.
BROADCAST_IDS = 500_000

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_S30, _S27, _S31, _S32 = (np.uint64(x) for x in (30, 27, 31, 32))
_LOW = np.uint64(0xFFFFFFFF)
_ODD = np.uint64(0x9E3779B97F4A7C15)


@np.errstate(over="ignore")  # scalars warn, arrays don't
def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    x = (x ^ (x >> _S30)) * _M1
    x = (x ^ (x >> _S27)) * _M2
    return x ^ (x >> _S31)


class Words(dict):
    """Hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 400_000:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


def shingles(text: str | None, size: int, known: Words) -> np.ndarray:
    """Sorted distinct shingle hashes of a text."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    h = np.array([known[w] for w in words], dtype=np.uint64)
    k = min(size, len(h))
    out = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        out = mix(out * _ODD + h[i : len(h) - k + 1 + i])
    return np.unique(out)


@np.errstate(over="ignore")
def sketch(x: np.ndarray, t: int) -> np.ndarray:
    """``t`` coordinates of fast similarity sketching over hashes ``x``, which isn't empty."""
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    out, size, i = np.full(t, full), np.uint64(t), 0
    while i < t:
        rounds = np.arange(i, min(t, i + max(1, 2 * t // len(x))), dtype=np.uint64)
        h = mix((x[None, :] ^ mix((rounds + np.uint64(1)) * _ODD)[:, None]))
        key = (rounds[:, None] << _S32) | (h & _LOW)
        np.minimum.at(out, (((h >> _S32) * size) >> _S32).ravel().astype(np.int64), key.ravel())
        i += len(rounds)
        if not (out == full).any():
            return out
    for j in np.flatnonzero(out == full):
        h = mix(x ^ mix(np.uint64((t + int(j) + 1)) * _ODD))
        out[j] = (np.uint64(t + int(j)) << _S32) | (h & _LOW).min()
    return out


def bands_for(similarity: float, rows: int = BAND_ROWS, miss: float = MISS) -> int:
    return math.ceil(math.log(miss) / math.log1p(-(similarity**rows)))


def _signatures(batches: Iterator[pa.RecordBatch], size: int, bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    known, number = Words(), np.arange(1, bands + 1, dtype=np.uint64)
    for batch in common.rows_of(batches):
        ids, sets, counts, keys = batch["doc_id"], [], [], []
        for text in batch["text"].to_pylist():
            x = shingles(text, size, known)
            counts.append(len(x))
            if not len(x):
                sets.append(None)
                keys.append(None)
                continue
            sets.append(int(mix(np.add.reduce(mix(x)) + np.uint64(len(x))).view(np.int64)))
            s = sketch(x, bands * rows).reshape(bands, rows)
            h = number * _ODD
            for k in range(rows):
                h = mix(h ^ s[:, k])
            keys.append(h.view(np.int64))
        yield pa.RecordBatch.from_arrays([ids, batch["text_hash"], pa.array(sets, pa.int64()), pa.array(counts, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "text_hash", "cls", "n", "keys"])


def _sets(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    known = Words()
    for batch in common.rows_of(batches):
        sets = [shingles(t, size, known) for t in batch["text"].to_pylist()]
        values = pa.array(np.concatenate([*sets, np.empty(0, np.uint64)]).view(np.int64))
        ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
        yield pa.RecordBatch.from_arrays([batch["cls"], pa.ListArray.from_arrays(pa.array(ends), values)], ["cls", "grams"])


def lists_of(column: pa.ListArray) -> list[np.ndarray]:
    """The rows of a list column as arrays of their own."""
    values, ends = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return [values[a:b].copy() for a, b in zip(ends[:-1], ends[1:], strict=True)]


def incidence(sets: list[np.ndarray], vocabulary: np.ndarray) -> np.ndarray:
    out = np.zeros((len(sets), len(vocabulary)), np.float32)
    for i, s in enumerate(sets):
        at = np.searchsorted(vocabulary, s)
        at[at == len(vocabulary)] = 0
        out[i, at[vocabulary[at] == s]] = 1
    return out


def common_counts(left: list[np.ndarray], right: list[np.ndarray], width: int = 16_384) -> np.ndarray:
    """Sizes of the intersections of all pairs, from products of incidence matrices."""
    total = np.zeros((len(left), len(right)), np.int64)
    a, b = np.unique(np.concatenate(left)), np.unique(np.concatenate(right))
    shared = a[np.isin(a, b, assume_unique=True)]
    for i in range(0, len(shared), width):
        v = shared[i : i + width]
        total += np.rint(incidence(left, v) @ incidence(right, v).T).astype(np.int64)
    return total


def _forest(links: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Links that join different components, found by union and find over component labels."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.get(x, x)) != x:
            parent[x] = parent.get(p, p)
            x = p
        return x

    out = []
    for i, j in zip(*np.nonzero(links), strict=True):
        a, b = int(left[i]), int(right[j])
        if (x := root(a)) != (y := root(b)):
            parent[x] = y
            out.append((a, b))
    return out


def _compare(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (band, key, i, j, side); yields links between component labels."""
    held: list[dict] = []
    now = None

    def links() -> list[tuple[int, int]]:
        left, right = [r for r in held if r["side"] == 0], [r for r in held if r["side"] == 1]
        right = right if now[2] != now[3] else left
        if not left or not right:
            return []
        comp = [np.array([r["comp"] for r in x]) for x in (left, right)]
        open_ = comp[0][:, None] != comp[1][None, :]
        if open_.any():  # pairs that share an earlier band are compared there
            keys = [np.array([r["keys"] for r in x]) for x in (left, right)]
            for band in range(now[0]):
                open_ &= keys[0][:, band, None] != keys[1][None, :, band]
        n = [np.array([r["n"] for r in x]) for x in (left, right)]
        open_ &= 100 * np.minimum.outer(*n) >= percent * np.maximum.outer(*n)
        if not open_.any():
            return []
        rows, cols = np.flatnonzero(open_.any(1)), np.flatnonzero(open_.any(0))
        both = common_counts(*[[x[i]["grams"] for i in at] for x, at in ((left, rows), (right, cols))])
        union = np.add.outer(n[0][rows], n[1][cols]) - both
        hit = open_[np.ix_(rows, cols)] & (100 * both >= percent * union)
        return _forest(hit, comp[0][rows], comp[1][cols])

    def batch_of(found: list[tuple[int, int]]) -> pa.RecordBatch:
        u, v = zip(*found, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    for batch in batches:
        light = batch.select(["band", "key", "i", "j", "side", "n", "comp"]).to_pylist()
        for row, keys, grams in zip(light, lists_of(batch["keys"]), lists_of(batch["grams"]), strict=True):
            row |= {"keys": keys, "grams": grams}
            at = (row["band"], row["key"], row["i"], row["j"])
            if at != now:
                if held and (found := links()):
                    yield batch_of(found)
                held, now = [], at
            held.append(row)
    if held and (found := links()):
        yield batch_of(found)


def link_classes(docs: DataFrame, classes: DataFrame, *, words: int, percent: int, block: int) -> DataFrame:
    """(cls, component) of classes that link with another; steps 2 to 5."""
    rows = classes.select("cls", "n", F.posexplode("keys").alias("band", "key"))
    buckets = rows.groupBy("band", "key").agg(F.count("*").alias("size")).filter("size > 1")
    members = common.materialize(rows.join(buckets, ["band", "key"]), "members")
    weight = members.groupBy("cls").agg(F.sum("size").alias("weight"))
    heads = members.join(weight, "cls").groupBy("band", "key").agg(F.max_by(F.struct("cls", "n"), F.struct("weight", "cls")).alias("head"))
    near = (F.col("n") * 100 >= F.col("head.n") * percent) & (F.col("head.n") * 100 >= F.col("n") * percent)
    pairs = members.join(heads, ["band", "key"]).filter((F.col("cls") != F.col("head.cls")) & near).select("cls", F.col("head.cls").alias("head"), "n", F.col("head.n").alias("head_n")).distinct()

    # full sets of all classes in buckets, from the text of one document of each
    wanted = members.select("cls").distinct().join(classes.select("cls", "doc_id", "text_hash"), "cls")
    wanted = common.materialize(wanted, "wanted")
    ids = F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted
    texts = docs.join(ids, ["doc_id", "text_hash"]).select("cls", "text")
    schema = "cls long, grams array<long>"
    sets = texts.mapInArrow(lambda it: _sets(it, words), schema).dropDuplicates(["cls"])  # one row may be there twice
    sets = common.materialize(sets, "sets")

    both = F.size(F.array_intersect("grams", "head_grams")).cast("long")
    checked = (
        pairs.join(sets, "cls")
        .join(sets.select(F.col("cls").alias("head"), F.col("grams").alias("head_grams")), "head")
        .select("cls", "head", "n", "head_n", both.alias("both"))
        .filter(F.col("both") * 100 >= (F.col("n") + F.col("head_n") - F.col("both")) * percent)
    )
    stars = common.materialize(checked.select(F.col("cls").alias("u"), F.col("head").alias("v")), "stars")
    first = common.materialize(graph.components(stars), "first")

    labelled = members.join(first, members.cls == first.id, "left").select("band", "key", "cls", "n", "size", F.coalesce("component", "cls").alias("comp"))
    mixed = labelled.groupBy("band", "key").agg(F.min("comp").alias("a"), F.max("comp").alias("b"), F.max("size").alias("rows"), F.sum("n").alias("shingles"))
    # two rows that differ have met already, one of them as the representative
    blocks = F.least(F.greatest(F.ceil(F.col("rows") / block), F.ceil(F.col("shingles") / BLOCK_SHINGLES)), F.col("rows"))
    mixed = mixed.filter("a < b and rows > 2").select("band", "key", blocks.cast("int").alias("blocks"))
    dealt = labelled.drop("size").join(mixed, ["band", "key"]).withColumn("own", F.pmod(F.xxhash64("cls", "band"), F.col("blocks")).cast("int"))
    dealt = dealt.join(classes.select("cls", "keys"), "cls").join(sets, "cls")
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    i, j = F.least("own", "other"), F.greatest("own", "other")
    dealt = dealt.select("band", "key", i.alias("i"), j.alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"), "cls", "n", "comp", "keys", "grams")
    at = ["band", "key", "i", "j"]
    more = dealt.repartition(*at).sortWithinPartitions(*at, "side", "cls").mapInArrow(lambda it: _compare(it, percent), "u long, v long")
    links = common.materialize(first.select(F.col("id").alias("u"), F.col("component").alias("v")).unionByName(more), "links")
    out = graph.components(links).select(F.col("id").alias("cls"), "component")
    common.release(members, wanted, sets, stars)
    return out


def near_duplicates(docs: DataFrame, *, words: int = 5, percent: int = 80, rows: int = BAND_ROWS, miss: float = MISS, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id, kept and text_hash for every row of ``docs`` (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    bands = bands_for(percent / 100, rows, miss)
    signed = docs.mapInArrow(lambda it: _signatures(it, words, bands, rows), "doc_id long, text_hash long, cls long, n long, keys array<long>")
    signed = common.materialize(signed, "signed")
    known = signed.filter("doc_id is not null and cls is not null")
    # a class's rows agree in n and keys; the row of its least doc_id gives the text that is compared
    least = F.min(F.struct("doc_id", "text_hash")).alias("least")
    classes = known.groupBy("cls").agg(least, F.first("n").alias("n"), F.first("keys").alias("keys"))
    classes = common.materialize(classes.select("cls", "least.*", "n", "keys"), "classes")
    linked = link_classes(docs, classes, words=words, percent=percent, block=block)
    named = classes.select("cls", "doc_id").join(linked, "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = named.join(least, "component").select("cls", "component_id")
    return signed.join(named, "cls", "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"),
        F.coalesce(F.col("doc_id") == F.coalesce("component_id", "doc_id"), F.lit(True)).alias("kept"),
        "text_hash",
    )
