"""Byte-level BPE of whole texts in which chunks that documents share are encoded once.

1. A polynomial rolling hash over ``WINDOW`` bytes cuts every text where its top bits are zero, so equal passages
   fall into equal chunks wherever they stand. Chunks of all documents are counted by 64 bits of their digest; what is
   met more than once is marked in a bitmap of at most ``MOST_BITS`` bits, which the workers get. A bit that is
   set by another chunk only sends a chunk the longer way, so a bitmap that fills up costs time, never a result.
2. A text without a marked chunk is encoded where it lies and never moves. Any other becomes parts in order, which are
   written: each stretch between marked chunks, and each marked chunk as a reference. Marked chunks become distinct by a shuffle, each
   is encoded once, and a join hands its ids to all its references.
3. A chunk's own ids hold in any context between the first and the last space in it that follows another
   character than white space: the byte-level splitting cuts there whatever stands around. So its encoding
   has three fields: the open head, the ids in between, the open tail. Parts of one text are joined in order by encoding
   tail and head anew; a chunk without such a space joins the window whole, and the window grows until it reaches one,
   from where on the chunk's ids agree exactly with those of the whole text.

Where a vocabulary's file asks for another way of splitting (``Encoder.cuts`` is false), that doesn't hold, and all
texts are encoded whole where they lie.

Memory of a task: a batch of texts, the bitmap, and one text's parts. A chunk that very many texts hold gives as many
references, which the join splits like any skewed key; its text is reduced before it is shuffled.

Nulls, empties, ties: a null or empty text has no ids; a null id and repeated rows are encoded row by row, as each row of
the written parts has a number of its own; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, tokens

WINDOW = 48
#: Chunks hold about 2 to this many bytes, at least ``LEAST`` but at a text's end, and at most ``MOST``.
BITS = 10
LEAST, MOST = 128, 8192
#: Bits of the bitmap for each marked chunk, and in all (16 MB).
SPARSE, MOST_BITS = 16, 1 << 27
BLOCK = 1 << 18
_BASE = 0x5851F42D4C957F2D
_PAGE = 1 << 15


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A value for each byte, powers of the base, and their inverses, all modulo 2^64."""
    n = BLOCK + WINDOW
    powers = [np.concatenate([np.ones(1, np.uint64), np.full(n, b, np.uint64)]).cumprod(dtype=np.uint64) for b in (_BASE, pow(_BASE, -1, 1 << 64))]
    return np.random.default_rng(48).integers(0, 1 << 64, 256, dtype=np.uint64), *powers


def rolling(data: np.ndarray) -> np.ndarray:
    """Hashes of all windows of ``WINDOW`` bytes in a block, from prefix sums."""
    value, up, down = _tables()
    sums = np.concatenate([np.zeros(1, np.uint64), (value[data] * up[: len(data)]).cumsum(dtype=np.uint64)])
    return (sums[WINDOW:] - sums[:-WINDOW]) * down[: len(data) - WINDOW + 1]


def cut(data: bytes) -> list[int]:
    """Ends of a text's chunks in bytes; none lies inside a character."""
    n, b = len(data), np.frombuffer(data, np.uint8)
    found: list[int] = []
    for i in range(0, n - WINDOW + 1, BLOCK):
        h = rolling(b[i : i + BLOCK + WINDOW - 1])
        found += (np.flatnonzero(h >> np.uint64(64 - BITS) == 0) + (i + WINDOW)).tolist()
    ends, last = [], 0

    def whole(at: int) -> int:
        while at < n and data[at] & 0xC0 == 0x80:
            at += 1
        return at

    for at in (*map(whole, found), n):
        while at - last > MOST:
            last = whole(last + MOST)
            ends.append(last)
        if at - last >= LEAST or at == n > last:
            last = at
            ends.append(last)
    return ends


def digests(data: bytes, ends: list[int]) -> list[bytes]:
    return [hashlib.blake2b(data[a:b], digest_size=16).digest() for a, b in zip([0, *ends], ends, strict=False)]


def edges(text: str) -> tuple[int, int]:
    """The first and the last place where a text splits whatever stands around; (-1, -1) without one."""
    first = text.find(" ", 1)
    while first > 0 and text[first - 1].isspace():
        first = text.find(" ", first + 1)
    if first < 0:
        return -1, -1
    last = text.rfind(" ")
    while text[last - 1].isspace():
        last = text.rfind(" ", 0, last)
    return first, last


def parts(texts: list[str], encoder: tokens.Encoder) -> list[tuple[str, bytes | None, str]]:
    """(head, ids, tail) of each stretch of text; ids are null if all of it is open."""
    found = [edges(t) for t in texts]
    ids = iter(encoder.encode_all([t[first:last] for t, (first, last) in zip(texts, found, strict=True) if first >= 0]))
    return [(t, None, "") if first < 0 else (t[:first], next(ids), t[last:]) for t, (first, last) in zip(texts, found, strict=True)]


def part(text: str, encoder: tokens.Encoder) -> tuple[str, bytes | None, str]:
    return parts([text], encoder)[0]


def windows(parts: Iterable[tuple[str, bytes | None, str]]) -> list[str | bytes]:
    """What the ids of the text whose parts these are come from in turn: ids, and texts that are to be encoded."""
    out: list[str | bytes] = []
    window: list[str] = []
    for head, ids, tail in parts:
        window.append(head)
        if ids is not None:
            out += ["".join(window), ids]
            window = [tail]
    return [*out, "".join(window)]


def filled(each: list[list[str | bytes]], encoder: tokens.Encoder) -> list[bytes]:
    """The ids of several texts from their ``windows``."""
    ids = iter(encoder.encode_all([x for some in each for x in some if isinstance(x, str)]))
    return [b"".join([next(ids) if isinstance(x, str) else x for x in some]) for some in each]


def join(parts: Iterable[tuple[str, bytes | None, str]], encoder: tokens.Encoder) -> bytes:
    """The ids of the text whose parts these are."""
    return filled([windows(parts)], encoder)[0]


def _seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in common.rows_of(batches):
        keys = [d[:8] for t in batch["text"].to_pylist() if t for data in [t.encode()] for d in digests(data, cut(data))]
        yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b"".join(keys), "<i8"))], ["key"])


def _narrow(encoder: tokens.Encoder) -> str:
    return "<u2" if encoder.size <= 1 << 16 else "<u4"


def _packed(ids: bytes | None, kind: str) -> bytes | None:
    return ids if ids is None or kind == "<u4" else np.frombuffer(ids, "<u4").astype(kind).tobytes()


def _wide(ids: bytes | None, kind: str) -> bytes | None:
    return ids if ids is None or kind == "<u4" else np.frombuffer(ids, kind).astype("<u4").tobytes()


#: Bytes of a batch whose texts are encoded together, less than elsewhere, as all of their parts are held.
BATCH = 1 << 20
#: What a row is: parts have head, ids and tail, references a digest and the chunk's text as head.
PART, REFERENCE = 1, 2
_PARTS = "row long, doc_id long, text_hash long, kind byte, ord int, digest binary, head string, ids binary, tail string"
_FIELDS = [(f.split()[0], {"long": pa.int64(), "byte": pa.int8(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string()}[f.split()[1]]) for f in _PARTS.split(", ")]


def _batch(rows: list[tuple], fields: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(columns, fields, strict=True)], [name for name, _ in fields])


class Marks:
    """The bitmap of chunks that are met more than once."""

    def __init__(self, sent) -> None:  # type: ignore[no-untyped-def]
        self.bits = np.frombuffer(sent.value, np.uint8)
        self.mask = np.uint64(max(0, 8 * len(self.bits) - 1))

    def of(self, data: bytes) -> tuple[list[int], list[bytes], list[int]]:
        """Ends and digests of a text's chunks, and which of them are marked."""
        ends = cut(data) if len(self.bits) else []
        known = digests(data, ends)
        if not known:
            return ends, known, []
        slots = np.frombuffer(b"".join([d[:8] for d in known]), "<u8") & self.mask
        return ends, known, np.flatnonzero(self.bits[slots >> np.uint64(3)] >> (slots & np.uint64(7)).astype(np.uint8) & 1).tolist()


def _split(batches: Iterator[pa.RecordBatch], marked, path: str) -> Iterator[pa.RecordBatch]:  # type: ignore[no-untyped-def]
    """The parts of texts with marked chunks."""
    encoder, marks = tokens.encoder(path), Marks(marked)
    kind = _narrow(encoder)
    for batch in common.rows_of(batches, BATCH):
        rows, stretches = [], []
        for row, doc, hash_, text in zip(*(batch[c].to_pylist() for c in ("row", "doc_id", "text_hash", "text")), strict=True):
            name, data = (row, doc, hash_), (text or "").encode()
            ends, known, hit = marks.of(data)
            at, number = 0, 0
            for i in hit:
                start = ends[i - 1] if i else 0
                if start > at:
                    rows.append((*name, PART, number, None))
                    stretches.append(data[at:start].decode())
                    number += 1
                rows.append((*name, REFERENCE, number, known[i], data[start : ends[i]].decode(), None, None))
                at, number = ends[i], number + 1
            if hit and at < len(data):
                rows.append((*name, PART, number, None))
                stretches.append(data[at:].decode())
        made = iter(parts(stretches, encoder))
        yield _batch([(*row, head, _packed(ids, kind), tail) for row in rows if row[3] == PART for head, ids, tail in [next(made)]] + [row for row in rows if row[3] == REFERENCE], _FIELDS)


def _whole(batches: Iterator[pa.RecordBatch], marked, path: str) -> Iterator[pa.RecordBatch]:  # type: ignore[no-untyped-def]
    """The ids of texts without marked chunks."""
    encoder, marks = tokens.encoder(path), Marks(marked)
    for batch in common.rows_of(batches, BATCH):
        texts = zip(*(batch[c].to_pylist() for c in ("doc_id", "text_hash", "text")), strict=True)
        own = [(doc, hash_, text) for doc, hash_, text in texts if not marks.of((text or "").encode())[2]]
        yield _batch([(doc, hash_, ids) for (doc, hash_, _), ids in zip(own, encoder.encode_all([text for *_, text in own]), strict=True)], _RESULT)


def _encoded(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    encoder = tokens.encoder(path)
    kind = _narrow(encoder)
    for batch in common.rows_of(batches, BATCH):
        made = parts(batch["head"].to_pylist(), encoder)
        heads, ids, tails = zip(*made, strict=True) if made else ((), (), ())
        yield pa.RecordBatch.from_arrays([batch["digest"], pa.array(heads, pa.string()), pa.array([_packed(x, kind) for x in ids], pa.binary()), pa.array(tails, pa.string())], ["digest", "head", "ids", "tail"])


_RESULT = [("doc_id", pa.int64()), ("text_hash", pa.int64()), ("ids", pa.binary())]


def _joined(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (row, ord); yields a row for each text."""
    encoder = tokens.encoder(path)
    kind = _narrow(encoder)
    now: tuple | None = None
    held: list[tuple[str, bytes | None, str]] = []
    for batch in common.rows_of(batches, BATCH):
        done, texts = [], []
        for row, doc, hash_, head, ids, tail in zip(*(batch[c].to_pylist() for c in ("row", "doc_id", "text_hash", "head", "ids", "tail")), strict=True):
            if now is not None and now[0] != row:
                done.append(now[1:])
                texts.append(windows(held))
                held = []
            now = (row, doc, hash_)
            held.append((head, _wide(ids, kind), tail))
        yield _batch([(*name, ids) for name, ids in zip(done, filled(texts, encoder), strict=True)], _RESULT)
    if now is not None:
        yield _batch([(*now[1:], join(held, encoder))], _RESULT)


def shared(docs: DataFrame) -> bytes:
    """The bitmap of chunks that are met more than once; empty if there are none."""
    seen = docs.select("text").mapInArrow(_seen, "key long").groupBy("key").agg(F.count("*").alias("n"))
    twice = common.materialize(seen.filter("n > 1").select("key"), "twice")
    n = twice.count()
    if not n:
        return b""
    size = min(MOST_BITS, 1 << max(16, math.ceil(math.log2(SPARSE * n))))
    slot = F.col("key").bitwiseAND(F.lit(size - 1))
    pages = twice.groupBy((F.shiftright(slot, 15)).cast("int").alias("page")).agg(F.bitmap_construct_agg(slot.bitwiseAND(F.lit(_PAGE - 1))).alias("bits"))
    out = bytearray(size // 8)
    for page, bits in pages.collect():  # at most MOST_BITS bits
        out[page * _PAGE // 8 : (page + 1) * _PAGE // 8] = bits
    common.release(twice)
    return bytes(out)


def encode(docs: DataFrame, *, path: str = tokens.BYTE_BPE) -> DataFrame:
    """doc_id, text_hash and ids (little-endian unsigned 32-bit) for every row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("string").alias("text"))
    marked = spark.sparkContext.broadcast(shared(given) if tokens.encoder(path).cuts else b"")
    numbered = given.select(F.monotonically_increasing_id().alias("row"), "*")
    parts = common.materialize(numbered.mapInArrow(lambda it: _split(it, marked, path), _PARTS), "parts", "zstd")
    chunks = parts.filter(F.col("kind") == REFERENCE).select("digest", "head").distinct()
    chunks = chunks.mapInArrow(lambda it: _encoded(it, path), "digest binary, head string, ids binary, tail string")
    columns = ["row", "doc_id", "text_hash", "ord", "head", "ids", "tail"]
    filled = parts.filter(F.col("kind") == REFERENCE).select("row", "doc_id", "text_hash", "ord", "digest").join(chunks, "digest").select(*columns)
    every = parts.filter(F.col("kind") == PART).select(*columns).unionByName(filled)
    kind = "doc_id long, text_hash long, ids binary"
    joined = every.repartition("row").sortWithinPartitions("row", "ord").mapInArrow(lambda it: _joined(it, path), kind)
    whole = given.mapInArrow(lambda it: _whole(it, marked, path), kind)
    return whole.unionByName(joined)


def _read(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    decoder = tokens.decoder(path)
    for batch in common.rows_of(batches):
        yield batch.append_column("text", pa.array([decoder.decode(x) for x in batch["ids"].to_pylist()], pa.string()))


def decode(encoded: DataFrame, *, path: str = tokens.BYTE_BPE) -> DataFrame:
    """The rows of ``encode`` with the text that their ids spell."""
    return encoded.select("doc_id", "text_hash", "ids").mapInArrow(lambda it: _read(it, path), "doc_id long, text_hash long, ids binary, text string")


def _digested(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    decoder = tokens.decoder(path)
    spelt = [str(i) for i in range(tokens.encoder(path).size)]
    for batch in common.rows_of(batches, BATCH):
        rows = []
        for doc, ids in zip(batch["doc_id"].to_pylist(), batch["ids"].to_pylist(), strict=True):
            said = ",".join(map(spelt.__getitem__, np.frombuffer(ids, "<u4").tolist()))
            rows.append((doc, len(ids) // 4, hashlib.sha256(said.encode()).hexdigest(), hashlib.sha256(decoder.decode(ids).encode()).hexdigest()))
        yield _batch(rows, [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def digest(encoded: DataFrame, *, path: str = tokens.BYTE_BPE) -> DataFrame:
    """doc_id, n_tokens, and digests of the ids and of the text they decode to."""
    return encoded.select("doc_id", "ids").mapInArrow(lambda it: _digested(it, path), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
