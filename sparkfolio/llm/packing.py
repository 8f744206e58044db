"""Packing documents into fixed-length sequences by the sum-of-squares rule.

Pieces are dealt evenly into groups and packed group by group, longest first. A piece goes to
the open sequence for which the sum over gaps of the squared counts of open sequences with
that gap becomes smallest, ties to the tightest fit; a new one is opened only where none fits.
Sequences that stay open in any group are then packed again, each as one unit, so the
remainders of different groups share sequences. Memory per task: the open sequences of one
group of at most ``GROUP`` pieces, or of ``WIDER`` times as many sequences that are packed again.

Nulls, ties, empties: a null text is empty and its document is the end id alone; a null doc_id
or repeated rows are packed like any other; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, tokens

LENGTH = 1024
#: Pieces packed together; more make a little less waste and a longer task.
GROUP = 65_536
#: Sequences that are packed again are light, so their groups are larger by this.
WIDER = 8


class SumOfSquares:
    """Open sequences of one group, counted by gap."""

    def __init__(self, capacity: int) -> None:
        self.capacity = capacity
        self.count = np.zeros(capacity + 1, dtype=np.int64)
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.opened = 0

    def place(self, size: int) -> tuple[int, int]:
        """(sequence, offset) for a piece of ``size`` tokens, 1 to capacity."""
        cap, n = self.capacity, self.count
        if size < cap:
            here, rest = n[size:cap], n[: cap - size]
            change = 2 * (rest - here) + 2  # of the sum of squares, one leaves gap g for g - size
            change[0] = 1 - 2 * here[0]  # an exact fit leaves no open sequence
            change[here == 0] = np.iinfo(np.int64).max
            best = int(change.argmin())  # the first: the tightest fit
            if here[best]:
                gap = size + best
                which = self.open[gap].pop()
                n[gap] -= 1
                self._keep(which, best)
                return which, cap - gap
        which = self.opened
        self.opened += 1
        self._keep(which, cap - size)
        return which, 0

    def _keep(self, which: int, gap: int) -> None:
        if gap:
            self.open[gap].append(which)
            self.count[gap] += 1


def cut_points(n: int, length: int = LENGTH) -> list[tuple[int, int]]:
    """(start, size) of a document's pieces: all of ``length`` tokens, but perhaps the first."""
    first = n % length or min(n, length)
    return [(0, first), *[(a, length) for a in range(first, n, length)]] if n else []


def _pieces(batches: Iterator[pa.RecordBatch], vocabulary: str, end_id: int, length: int, sparing: bool = False) -> Iterator[pa.RecordBatch]:
    encoder = tokens.encoder(vocabulary, sparing=sparing)
    end = end_id.to_bytes(4, "little")
    for batch in common.rows_of(batches):
        rows = []
        for doc_id, ids in zip(batch["doc_id"].to_pylist(), encoder.encode_all(batch["text"].to_pylist()), strict=True):
            ids += end
            for k, (a, n) in enumerate(cut_points(len(ids) // 4, length)):
                rows.append((doc_id, k, a, n, ids[4 * a : 4 * (a + n)]))
        if rows:
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids"])


def tokenize(docs: DataFrame, *, vocabulary: str = tokens.BYTE_BPE, end_id: int = 2, length: int = LENGTH, sparing: bool = False) -> DataFrame:
    """doc_id, piece, start, length and ids (little-endian unsigned 32-bit) of every piece; ``sparing`` takes less memory and more time."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        lambda it: _pieces(it, vocabulary, end_id, length, sparing), "doc_id long, piece int, start long, length long, ids binary"
    )


def _place(batches: Iterator[pa.RecordBatch], capacity: int, size: str, group: str, at: str, offset: str) -> Iterator[pa.RecordBatch]:
    packer, task = SumOfSquares(capacity), TaskContext.get().partitionId()
    for batch in batches:
        where = [packer.place(n) for n in batch[size].to_pylist()]
        table = pa.Table.from_batches([batch])
        for name, values in ((group, [task] * len(where)), (at, [w for w, _ in where]), (offset, [o for _, o in where])):
            table = table.append_column(name, pa.array(values, pa.int64()))
        yield from table.to_batches()


def _packed(rows: DataFrame, n: int, size: str, capacity: int, group_rows: int, names: tuple[str, str, str]) -> DataFrame:
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + "".join(f", `{x}` long" for x in names)
    groups = max(1, -(-n // group_rows))
    return rows.repartition(groups).sortWithinPartitions(F.col(size).desc(), *[F.col(f"`{c}`") for c in rows.columns if c != size]).mapInArrow(lambda it: _place(it, capacity, size, *names), schema)


def pack(pieces: DataFrame, *, length: int = LENGTH, group_rows: int = GROUP) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces that have a ``length`` column.

    Every row's ``length`` must be 1 to ``length``. Other columns pass through, whatever their
    names (but ``sequence_id`` and ``offset``, which are replaced); give keys and light columns only
    and join what is heavy afterwards, since rows are shuffled twice.
    """
    given = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    size, group, at, offset, fill, group2, at2, base = common.fresh(given, "_size", "_group", "_at", "_offset", "_fill", "_group2", "_at2", "_base")
    rows = common.materialize(pieces.select(*[F.col("length").alias(size) if c == "length" else F.col(f"`{c}`") for c in given]), "pieces")
    placed = common.materialize(_packed(rows, rows.count(), size, length, group_rows, (group, at, offset)), "placed")
    common.release(rows)
    open_ = placed.groupBy(group, at).agg(F.sum(size).alias(fill)).filter(F.col(fill) < length)
    open_ = common.materialize(open_, "open")
    least = open_.agg(F.min(fill)).first()[0]
    open_ = open_.filter(F.col(fill) <= length - (least or 0))  # a fuller one takes no other
    again = _packed(open_, open_.count(), fill, length, WIDER * group_rows, (group2, at2, base)).drop(fill)
    first = F.when(F.col(at2).isNull(), F.shiftleft(F.col(group), 32) + F.col(at)).otherwise(-1 - F.shiftleft(F.col(group2), 32) - F.col(at2))
    return placed.join(again, [group, at], "left").select(
        *[F.col(size).alias("length") if c == "length" else F.col(f"`{c}`") for c in given],
        first.alias("sequence_id"),
        (F.col(offset) + F.coalesce(F.col(base), F.lit(0))).alias("offset"),
    )
