"""Token-id files: blocks of ids cut into byte or bit planes, each compressed with zstandard.

The format. A dataset has one shard per writing task and shards follow each other in
ascending doc_id order. A shard is a run of blocks of exactly ``block`` ids (the last one may
be shorter). A block's payload is ``PLNS``, a header (version, bits per plane element, id count,
plane count), the chunk index (byte length of every compressed plane), the planes and the
crc32 of the raw ids. Beside each payload stand its first id's place in the shard and the documents that overlap the block
(ordinal in the shard, doc_id, first id, id count), so one block can be read by itself.
Spark's Parquet writer is only the container: its commit protocol makes a shard appear whole
or not at all when an executor is lost, on any file system that Spark reaches.

Nulls and ties: a null text is an empty document and holds only the end id; documents with
a null doc_id come first; rows with equal doc_id are all written, in order of a hash of the text.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, tokens

BLOCK = 65_536
MAGIC = b"PLNS"
_HEAD = struct.Struct("<4sBBIH")
BLOCK_SCHEMA = "shard int, block int, start long, n_ids int, payload binary, docs array<struct<ord:long,doc_id:long,first:long,n:long>>"
_DOC = pa.struct([("ord", pa.int64()), ("doc_id", pa.int64()), ("first", pa.int64()), ("n", pa.int64())])


def pack_block(ids: bytes, planes: str = "byte", level: int = 3) -> bytes:
    """The payload of one block of little-endian unsigned 32-bit ids."""
    raw = np.frombuffer(ids, dtype=np.uint8).reshape(-1, 4)
    n = len(raw)
    if planes == "byte":
        width, rows = 8, np.ascontiguousarray(raw.T)
    elif planes == "bit":
        bits = np.unpackbits(raw, axis=1, bitorder="little")  # 32 columns, bit 0 first
        width, rows = 1, np.packbits(bits.T, axis=1, bitorder="little")
    else:
        raise ValueError(f"planes must be 'byte' or 'bit', not {planes!r}")
    squeeze = zstandard.ZstdCompressor(level=level)
    parts = [squeeze.compress(r.tobytes()) for r in rows]
    index = struct.pack(f"<{len(parts)}I", *map(len, parts))
    return _HEAD.pack(MAGIC, 1, width, n, len(parts)) + index + b"".join(parts) + struct.pack("<I", zlib.crc32(ids))


def unpack_block(payload: bytes) -> bytes:
    """The ids of one payload; a payload that is damaged or cut short raises ValueError."""
    try:
        return _unpacked(payload)
    except (struct.error, zstandard.ZstdError) as e:
        raise ValueError(f"a damaged block of bit planes: {e}") from e


def _unpacked(payload: bytes) -> bytes:
    magic, version, width, n, count = _HEAD.unpack_from(payload)
    if magic != MAGIC or version != 1:
        raise ValueError("not a block of bit planes")
    sizes = struct.unpack_from(f"<{count}I", payload, _HEAD.size)
    at = _HEAD.size + 4 * count
    expand = zstandard.ZstdDecompressor()
    rows = []
    for size in sizes:
        rows.append(np.frombuffer(expand.decompress(payload[at : at + size]), dtype=np.uint8))
        at += size
    if width == 8:
        ids = np.ascontiguousarray(np.stack(rows).T).tobytes() if n else b""
    else:
        bits = np.unpackbits(np.stack(rows), axis=1, count=n, bitorder="little")
        ids = np.packbits(bits.T, axis=1, bitorder="little").tobytes()
    if zlib.crc32(ids) != struct.unpack_from("<I", payload, at)[0]:
        raise ValueError("a block of bit planes fails its checksum")
    return ids


def _times(a: int, b: int) -> int:
    """Product of two polynomials modulo that of crc32, lowest power in the highest bit."""
    out = 0
    for bit in range(31, -1, -1):
        if a >> bit & 1:
            out ^= b
        b = b >> 1 ^ (0xEDB88320 if b & 1 else 0)
    return out


def join_crc(first: int, second: int, size: int) -> int:
    """crc32 of two byte strings together, from both values and the size of the second."""
    power, square, n = 1 << 31, 1 << 23, size  # x**0 and x**8
    while n:
        if n & 1:
            power = _times(power, square)
        square = _times(square, square)
        n >>= 1
    return _times(power, first) ^ second


def _shard(batches: Iterator[pa.RecordBatch], vocabulary: str, end_id: int, block: int, planes: str) -> Iterator[pa.RecordBatch]:
    encoder = tokens.encoder(vocabulary)
    shard, number, done, ordinal = TaskContext.get().partitionId(), 0, 0, 0
    held = bytearray()
    docs: list[tuple] = []
    end = end_id.to_bytes(4, "little")

    def cut(size: int) -> pa.RecordBatch:
        nonlocal number, done, docs
        payload = pack_block(bytes(held[: 4 * size]), planes)
        del held[: 4 * size]
        row = pa.RecordBatch.from_arrays(
            [
                pa.array([shard], pa.int32()),
                pa.array([number], pa.int32()),
                pa.array([done], pa.int64()),
                pa.array([size], pa.int32()),
                pa.array([payload], pa.binary()),
                pa.array([[dict(zip(("ord", "doc_id", "first", "n"), d, strict=True)) for d in docs]], pa.list_(_DOC)),
            ],
            ["shard", "block", "start", "n_ids", "payload", "docs"],
        )
        done, number = done + size, number + 1
        docs = [d for d in docs if d[2] + d[3] > done]
        return row

    for batch in common.rows_of(batches):
        for doc_id, ids in zip(batch["doc_id"].to_pylist(), encoder.encode_all(batch["text"].to_pylist()), strict=True):
            first = done + len(held) // 4
            held += ids + end
            docs.append((ordinal, doc_id, first, done + len(held) // 4 - first))
            ordinal += 1
            while len(held) >= 4 * block:
                yield cut(block)
                # a document that ends where the block ends is not in the next one
    if held:
        yield cut(len(held) // 4)


def write(docs: DataFrame, path: str, *, vocabulary: str = tokens.BYTE_BPE, end_id: int = 0, block: int = BLOCK, planes: str = "byte") -> None:
    """Encode ``text``, append ``end_id`` to each document and write the files to ``path``."""
    ordered = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        .withColumn("tie", F.xxhash64("text"))
        .repartitionByRange(F.col("doc_id").asc_nulls_first(), F.col("tie"))
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("tie"))
        .drop("tie")
    )
    blocks = ordered.mapInArrow(lambda it: _shard(it, vocabulary, end_id, block, planes), BLOCK_SCHEMA)
    blocks.write.option("compression", "none").parquet(path)


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BLOCK_SCHEMA).parquet(path)


def _segments(batches: Iterator[pa.RecordBatch], keep_ids: bool) -> Iterator[pa.RecordBatch]:
    names = ["shard", "ord", "doc_id", "first", "n", "block", "size", "crc", *["ids"] * keep_ids]
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * keep_ids]
    for batch in batches:
        starts = batch["start"].to_pylist()
        for shard, block, payload, docs, start in zip(batch["shard"].to_pylist(), batch["block"].to_pylist(), batch["payload"], batch["docs"].to_pylist(), starts, strict=True):
            ids = memoryview(unpack_block(payload.as_py()))
            size = len(ids) // 4
            rows = []
            for d in docs:
                a, b = max(0, d["first"] - start), min(size, d["first"] + d["n"] - start)
                part = ids[4 * a : 4 * b]
                rows.append((shard, d["ord"], d["doc_id"], d["first"], d["n"], block, b - a, common.crc(part), *[bytes(part)] * keep_ids))
            columns = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def segments(spark: SparkSession, path: str, *, keep_ids: bool = False) -> DataFrame:
    """What each block holds of each document: crc32 of the part and, if asked for, its ids."""
    blocks = read_blocks(spark, path).select("shard", "block", "payload", "docs", "start")
    schema = "shard int, ord long, doc_id long, first long, n long, block int, size long, crc long" + (", ids binary" if keep_ids else "")
    return blocks.mapInArrow(lambda it: _segments(it, keep_ids), schema)


def _joined(parts: pd.Series) -> pd.Series:
    """crc32 of whole documents from arrays of (block, size, crc) in any order."""

    def one(xs: list[dict]) -> int:
        value = 0
        for x in sorted(xs, key=lambda x: x["block"]):
            value = join_crc(value, x["crc"], 4 * x["size"])
        return value

    return parts.map(one)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens and ids_crc32 of all its ids.

    Parts of a document that spans blocks are joined by the algebra of crc32, so no task ever
    holds more than one block of it.
    """
    shards = read_blocks(spark, path).groupBy("shard").agg(F.sum(F.col("n_ids").cast("long")).alias("total"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as there are shards
    base = shards.select("shard", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    part = F.struct("block", "size", "crc")
    docs = (
        segments(spark, path)
        .groupBy("shard", "ord", "doc_id", "first", "n")
        .agg(F.min("crc").alias("crc"), F.collect_list(part).alias("parts"))
        .withColumn("one", F.size("parts") == 1)
    )
    whole = docs.filter("one").select("shard", "doc_id", "first", "n", "crc")
    cut = docs.filter(~F.col("one")).select("shard", "doc_id", "first", "n", F.pandas_udf(_joined, "long")("parts").alias("crc"))
    return (
        whole.unionByName(cut)
        .join(F.broadcast(base), "shard")  # one row per shard
        .select("doc_id", (F.col("base") + F.col("first")).alias("start"), F.col("n").alias("n_tokens"), F.col("crc").alias("ids_crc32"))
    )
