"""Near-duplicate vectors: Euclidean p-stable hashing, then exact cosines.

Vectors are scaled to length 1, where cosine ``c`` is the distance sqrt(2 - 2c). Each table hashes a
vector by several Gaussian projections, shifted and cut into cells of ``width``. The number of
projections grows with the logarithm of the number of vectors of one label, so that a cell holds about as many
unrelated vectors at any size; the number of tables follows from the chance that a pair at the threshold meets in no
table, below ``miss``. Only vectors of one non-null label share a cell.

Equal vectors of one label form a class, and everything after that works on one row per class with its
count. Cells with several classes are dealt into blocks of ``block`` classes by hash, and pairs
of blocks are compared by one matrix product in double precision. A pair that shares several
cells counts in the first table only, told by 32 bits of each key. What leaves a block pair is a
count per class and links that join components, never all pairs.

Nulls, empties, ties: a vector that is null, empty, zero, or holds null or non-finite components,
or has a null label or id, links with nothing (its component is its own id). Labels of any atomic type are
compared by value: whole numbers as they are, others by 64 bits of a hash of theirs. Vectors of other
lengths than the pair's are never compared: the length is part of the cell. A repeated vec_id
is a vector of its own; the least id stands for a component.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, FractionalType, IntegralType

from . import common, graph
from .minhash import _ODD, _forest, lists_of, mix

WIDTH = 1.0
MISS = 1e-6
#: What an unrelated vector in a cell costs, in cells.
PAIR = 1 / 16
BLOCK = 512
SEED = 20_240_607


def collision(distance: float, width: float) -> float:
    """Chance that one projection puts two points at ``distance`` into the same cell."""
    if distance <= 0:
        return 1.0
    r = width / distance
    tail = 0.5 * math.erfc(r / math.sqrt(2))
    return 1 - 2 * tail - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def tables_for(cosine: float, projections: int, width: float = WIDTH, miss: float = MISS) -> int:
    p = collision(math.sqrt(max(0.0, 2 - 2 * cosine)), width) ** projections
    return max(1, math.ceil(math.log(miss) / math.log1p(-p))) if p < 1 else 1


def projections_for(n: int, cosine: float, width: float = WIDTH, miss: float = MISS) -> int:
    """Projections a table for ``n`` vectors of one label: those that cost least.

    A vector costs its cells and, at a rate of ``PAIR``, the unrelated vectors in them, which lie
    about sqrt(2) away.
    """
    far = collision(math.sqrt(2), width)
    return min(range(2, 65), key=lambda k: tables_for(cosine, k, width, miss) * (1 + PAIR * n * far**k))


def _by_length(column: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and matrices of the vectors of each length; a null component is nan, null vectors are left out."""
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    starts = np.cumsum(sizes) - sizes
    for size in np.unique(sizes[sizes > 0]).tolist():
        rows = np.flatnonzero(sizes == size)
        yield rows, values[starts[rows][:, None] + np.arange(size)]


def _units(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _start(size: int, label: np.ndarray) -> np.ndarray:
    return mix((np.full(1, size, np.uint64) * _ODD) + label.astype(np.int64).view(np.uint64))


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The class of each vector, null for one that links with nothing."""
    for batch in batches:
        label = batch["label"].fill_null(0).to_numpy(zero_copy_only=False)
        known = batch["label"].is_valid().to_numpy(zero_copy_only=False)
        cls, there = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, bool)
        for rows, x in _by_length(batch["embedding"]):
            good = known[rows] & np.isfinite(x).all(axis=1) & x.any(axis=1)
            rows, x = rows[good], _units(x[good])
            start = _start(x.shape[1], label[rows])
            own = mix((start[:, None] ^ x.view(np.uint64)) + np.arange(x.shape[1], dtype=np.uint64) * _ODD)
            cls[rows], there[rows] = mix(own.sum(axis=1, dtype=np.uint64)).view(np.int64), True
        yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["label"], batch["embedding"], pa.array(cls, pa.int64(), mask=~there)], ["vec_id", "label", "embedding", "cls"])


def _keys(batches: Iterator[pa.RecordBatch], tables: int, projections: int, width: float) -> Iterator[pa.RecordBatch]:
    """The keys of the cells of each class, a table after the other."""
    planes: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    number = np.arange(1, tables + 1, dtype=np.uint64)
    for whole in batches:
        for batch in common.rows_of([whole], 256 << 10):
            keys = np.zeros((batch.num_rows, tables), np.uint64)
            label = batch["label"].to_numpy(zero_copy_only=False)
            for rows, x in _by_length(batch["embedding"]):
                size = x.shape[1]
                if size not in planes:
                    rng = np.random.default_rng([SEED, size])
                    planes[size] = rng.standard_normal((size, tables * projections)), rng.uniform(0, width, tables * projections)
                a, b = planes[size]
                cells = np.floor((_units(x) @ a + b) / width).astype(np.int64).view(np.uint64).reshape(len(rows), tables, projections)
                h = mix(_start(size, label[rows])[:, None] ^ (number * _ODD))
                for k in range(projections):
                    h = mix(h ^ cells[:, :, k]) + _ODD
                keys[rows] = h
            ends = pa.array(np.arange(0, keys.size + 1, tables, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([batch["cls"], pa.ListArray.from_arrays(ends, pa.array(keys.view(np.int64).ravel()))], ["cls", "keys"])


def _compare(batches: Iterator[pa.RecordBatch], cosine: float) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (table, key, i, j, side); yields (u, v, links): links of u, or a joining pair."""
    held: list[dict] = []
    now = None

    def found() -> pa.RecordBatch | None:
        sides = [[r for r in held if r["side"] == s] for s in (0, 1)]
        same = now[2] == now[3]
        left, right = sides[0], sides[0] if same else sides[1]
        if not left or not right:
            return None
        units = []
        for rows in (left, right):
            units.append(_units(np.array([r["embedding"] for r in rows], np.float64)))
        hit = units[0] @ units[1].T >= cosine
        cls = [np.array([r["cls"] for r in x]) for x in (left, right)]
        hit &= cls[0][:, None] != cls[1][None, :]
        keys = [np.array([r["keys"] for r in x]) for x in (left, right)]
        for table in range(now[0]):
            if not hit.any():
                return None
            hit &= keys[0][:, table, None] != keys[1][None, :, table]
        counts = [np.array([r["count"] for r in x]) for x in (left, right)]
        out = [(int(c), None, int(n)) for c, n in zip(cls[0], hit @ counts[1], strict=True) if n]
        if not same:
            out += [(int(c), None, int(n)) for c, n in zip(cls[1], counts[0] @ hit, strict=True) if n]
        out += [(a, b, 0) for a, b in _forest(hit, *cls)]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["u", "v", "links"]) if out else None

    for batch in batches:
        light = batch.select(["table", "key", "i", "j", "side", "cls", "count"]).to_pylist()
        for row, keys, vector in zip(light, lists_of(batch["keys"]), lists_of(batch["embedding"]), strict=True):
            row |= {"keys": keys, "embedding": vector}
            at = (row["table"], row["key"], row["i"], row["j"])
            if at != now:
                if held and (out := found()):
                    yield out
                held, now = [], at
            held.append(row)
    if held and (out := found()):
        yield out


def _label(vectors: DataFrame) -> Column:
    """A whole number for each label: equal for equal labels, null for a null one."""
    kind, label = vectors.schema["label"].dataType, F.col("label")
    if isinstance(kind, IntegralType):
        return label.cast("long")
    if isinstance(kind, FractionalType) and not isinstance(kind, DecimalType):
        label = label + F.lit(0).cast(kind)  # one zero
    return F.when(F.col("label").isNotNull(), F.xxhash64(label))


def near_vectors(vectors: DataFrame, *, cosine: float = 0.98, projections: int | None = None, width: float = WIDTH, miss: float = MISS, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row of ``vectors`` (vec_id, embedding, label)."""
    kind = "float" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "double"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), _label(vectors).alias("label"), F.col("embedding").cast(f"array<{kind}>").alias("embedding"))
    named = common.materialize(rows.mapInArrow(_named, f"vec_id long, label long, embedding array<{kind}>, cls long"), "vectors")
    known = named.filter("vec_id is not null and cls is not null")
    first = [F.first(c).alias(c) for c in ("label", "embedding")]
    classes = common.materialize(known.groupBy("cls").agg(F.min("vec_id").alias("least"), F.count("*").alias("count"), *first), "classes")
    if projections is None:
        most = classes.groupBy("label").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
        projections = projections_for(most, cosine, width, miss)
    tables = tables_for(cosine, projections, width, miss)
    keyed = common.materialize(classes.select("cls", "label", "embedding").mapInArrow(lambda it: _keys(it, tables, projections, width), "cls long, keys array<long>"), "keys")
    cells = keyed.select("cls", F.posexplode("keys").alias("table", "key"))
    shared = cells.groupBy("table", "key").agg(F.count("*").alias("size")).filter("size > 1")
    shared = shared.select("table", "key", F.ceil(F.col("size") / block).cast("int").alias("blocks"))
    dealt = cells.join(shared, ["table", "key"]).withColumn("own", F.pmod(F.xxhash64("cls", "table"), F.col("blocks")).cast("int"))
    told = keyed.select("cls", F.transform("keys", lambda k: F.shiftright(F.shiftleft(k, 32), 32).cast("int")).alias("keys"))
    dealt = dealt.join(classes.select("cls", "count", "embedding").join(told, "cls"), "cls")
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    i, j = F.least("own", "other"), F.greatest("own", "other")
    dealt = dealt.select("table", "key", i.alias("i"), j.alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"), "cls", "count", "embedding", "keys")
    at = ["table", "key", "i", "j"]
    found = common.materialize(dealt.repartition(*at).sortWithinPartitions(*at, "side", "cls").mapInArrow(lambda it: _compare(it, cosine), "u long, v long, links long"), "found")
    degree = found.filter("v is null").groupBy("u").agg(F.sum("links").alias("links"))
    parts = graph.components(found.filter("v is not null").select("u", "v"))
    parts = (
        classes.select("cls", "least", "count")
        .join(degree, F.col("cls") == F.col("u"), "left")
        .join(parts, F.col("cls") == F.col("id"), "left")
        .select("cls", "least", (F.coalesce("links", F.lit(0)) + F.col("count") - 1).alias("n_links"), F.coalesce("component", "cls").alias("component"))
    )
    least = parts.groupBy("component").agg(F.min("least").alias("component_id"))
    parts = common.materialize(parts.join(least, "component").select("cls", "n_links", "component_id"), "parts")
    common.release(classes, keyed, found)
    return named.select("vec_id", F.when(F.col("vec_id").isNotNull(), F.col("cls")).alias("cls")).join(parts, "cls", "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.coalesce("component_id", "vec_id"), F.lit(True)).alias("kept"),
    )
