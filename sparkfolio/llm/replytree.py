"""Reply trees: enumerate root-to-leaf paths by iterative self-joins, rank branches, format paths.

Messages that follow their parent's number as its only reply are taken together as one run first, within
``RUN`` numbers, so an unbranched thread is one row. ``jump`` tables come from self-joins of the
runs: joining a table with itself doubles the distance it spans, so a path of n runs takes log2(n)
rounds. They carry the length and the summed score of the messages passed, which ranks leaves;
the chosen leaves then walk up through the tables from the widest jump to the narrowest, which meets each ancestor
exactly once, and runs are taken apart again.

The template marks a message as ``<|im_start|>role`` newline ``text<|im_end|>`` newline. In texts and
roles every ``<``, backslashes, ``|`` gets one more backslash after the ``<``, so no marker can
arise and the step is undone exactly; newlines and backslashes of roles are escaped first.

Nulls, ties, repeats: a null role or text is empty; a message whose parent is null or missing is a
root; messages of one tree and node stand together, ordered by role and text, and count as one with the least parent and score; messages on a cycle have no root and are left out; leaves of equal score rank by node;
a tree key may be null. ``threads`` orders a conversation by turn (nulls first), role and
text, so repeated or tied rows all stay.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Messages of one run at most.
RUN = 4096
START, END = "<|im_start|>", "<|im_end|>\n"
_bare, _escaped = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    return _bare.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _escaped.sub(r"<\1|", text)


def _role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def _unrole(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def parse(text: str) -> list[tuple[str, str]]:
    """(role, text) of each message of a formatted conversation; other input raises ValueError."""
    out, at = [], 0
    while at < len(text):
        if not text.startswith(START, at) or (line := text.find("\n", at)) < 0 or (end := text.find(END, line + 1)) < 0:
            raise ValueError("not a formatted conversation")
        out.append((_unrole(text[at + len(START) : line]), unescape(text[line + 1 : end])))
        at = end + len(END)
    return out


def threads(turns: DataFrame) -> DataFrame:
    """Messages of unbranched conversations: tree, node, parent, role, text, score."""
    rows = turns.select(F.col("conv_id").cast("long").alias("tree"), F.col("turn").cast("long").alias("turn"), "role", "text")
    order = Window.partitionBy("tree").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    rows = rows.withColumn("node", F.row_number().over(order).cast("long"))
    return rows.select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(1.0).alias("score"))


def _on(a: str, b: str, left: str, right: str):  # type: ignore[no-untyped-def]
    return F.col(f"{a}.tree").eqNullSafe(F.col(f"{b}.tree")) & (F.col(f"{a}.{left}") == F.col(f"{b}.{right}"))


def _runs(nodes: DataFrame) -> DataFrame:
    """Each node with its run: ``tail`` (the run's last node), ``size``, ``total`` and ``back`` (nodes behind it there).

    ``head_parent`` is the parent of the run's first node; it is the tail of another run, or none.
    """
    replies = nodes.filter("parent is not null").groupBy("tree", "parent").agg(F.count("*").alias("replies"))
    known = nodes.alias("a").join(replies.alias("b"), _on("a", "b", "parent", "parent"), "left").select("a.*", F.coalesce("b.replies", F.lit(0)).alias("replies"))
    block = F.floor(F.col("node") / RUN)
    inside = Window.partitionBy("tree", "block").orderBy("node")
    starts = ~((F.col("replies") == 1) & F.col("parent").eqNullSafe(F.lag("node").over(inside)))
    cut = known.withColumn("block", block).withColumn("starts", F.coalesce(starts, F.lit(True)).cast("int"))
    cut = cut.withColumn("run", F.sum("starts").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    whole = Window.partitionBy("tree", "block", "run").orderBy("node").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return cut.select(
        "tree",
        "node",
        F.last("node").over(whole).alias("tail"),
        F.first("parent").over(whole).alias("head_parent"),
        F.count("*").over(whole).alias("size"),
        F.sum("score").over(whole).alias("total"),
        (F.count("*").over(whole) - F.row_number().over(Window.partitionBy("tree", "block", "run").orderBy("node"))).alias("back"),
    )


def paths(messages: DataFrame, *, best: int = 1) -> DataFrame:
    """(tree, leaf, rank, node, up): the nodes of the ``best`` leaves of each tree; up is 0 at the leaf."""
    nodes = messages.groupBy("tree", "node").agg(F.min(F.struct("parent", F.coalesce("score", F.lit(0.0)).cast("double").alias("score"))).alias("x")).select("tree", "node", "x.*")
    each = common.materialize(_runs(common.materialize(nodes, "nodes")), "runs")
    runs = each.filter("node = tail").select("tree", "node", F.col("head_parent").alias("parent"), "size", "total")
    jump = (
        runs.alias("a")
        .join(runs.select("tree", "node").alias("b"), _on("a", "b", "parent", "node"), "left")
        .select("a.tree", "a.node", F.col("b.node").alias("above"), "a.size", "a.total")
    )
    table = common.materialize(jump, "jump")
    top, jumps, written = table.filter("above is null"), [table.filter("above is not null")], [table]  # who has reached a root rests
    most = runs.count().bit_length() + 1  # a longer way up is a cycle
    while len(jumps) <= most and not jumps[-1].isEmpty():
        step = (
            jumps[-1].alias("a")
            .join(jumps[-1].unionByName(top).alias("b"), _on("a", "b", "above", "node"))
            .select("a.tree", "a.node", "b.above", (F.col("a.size") + F.col("b.size")).alias("size"), (F.col("a.total") + F.col("b.total")).alias("total"))
        )
        table = common.materialize(step, "jump")
        top = top.unionByName(table.filter("above is null"))
        jumps.append(table.filter("above is not null"))
        written.append(table)
    leaves = top.alias("a").join(runs.alias("b"), _on("a", "b", "node", "parent"), "left_anti")
    by = Window.partitionBy("tree").orderBy((F.col("total") / F.col("size")).desc(), "node")
    chosen = leaves.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= best)
    way = common.materialize(chosen.select("tree", F.col("node").alias("leaf"), "rank", "node", F.lit(0).cast("long").alias("up")), "way")
    ways = [way]
    for k in range(len(jumps) - 2, -1, -1):
        far = (
            way.alias("a")
            .join(jumps[k].alias("b"), _on("a", "b", "node", "node"))
            .select("a.tree", "a.leaf", "a.rank", F.col("b.above").alias("node"), (F.col("a.up") + F.col("b.size")).alias("up"))
        )
        ways.append(common.materialize(far, "way"))  # only what is new; all of it takes the next narrower jump
        way = way.unionByName(ways[-1])
    common.release(*written)
    return way.alias("a").join(each.alias("b"), _on("a", "b", "node", "tail")).select("a.tree", "a.leaf", "a.rank", "b.node", (F.col("a.up") + F.col("b.back")).alias("up"))


def _format(batches: Iterator[pa.RecordBatch], trained: str) -> Iterator[pa.RecordBatch]:
    now, parts, spans, size = None, [], [], 0

    def row() -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
        values = [*now, "".join(parts), [{"start": a, "end": b} for a, b in spans]]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], ["tree", "leaf", "rank", "formatted", "loss"])

    for batch in batches:
        for r in batch.to_pylist():
            at = (r["tree"], r["leaf"], r["rank"])
            if at != now:
                if now:
                    yield row()
                now, parts, spans, size = at, [], [], 0
            head, body = f"{START}{_role(r['role'] or '')}\n", escape(r["text"] or "")
            if r["role"] == trained:
                spans.append((size + len(head), size + len(head) + len(body)))
            parts += [head, body, END]
            size += len(head) + len(body) + len(END)
    if now:
        yield row()


def conversations(messages: DataFrame, *, best: int = 1, trained: str = "assistant") -> DataFrame:
    """tree, leaf, rank, formatted and loss (spans of characters that are trained on) of the best paths.

    One path is one text, so its task holds that path and no more.
    """
    messages = common.materialize(messages.select("tree", "node", "parent", "role", "text", "score"), "messages")
    said = paths(messages, best=best).alias("a").join(messages.alias("b"), _on("a", "b", "node", "node"))
    said = said.select("a.tree", "a.leaf", "a.rank", "a.up", "b.role", "b.text")
    ordered = said.repartition("tree", "leaf").sortWithinPartitions("tree", "leaf", F.col("up").desc(), "role", "text")
    return ordered.mapInArrow(lambda it: _format(it, trained), "tree long, leaf long, rank int, formatted string, loss array<struct<start:long,end:long>>")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for tree, text, loss in zip(batch["tree"].to_pylist(), batch["formatted"].to_pylist(), batch["loss"].to_pylist(), strict=True):
            turns = parse(text)
            whole = hashlib.sha256("".join(f"{role}\n{said}\n" for role, said in turns).encode())
            under = "".join(unescape(text[s["start"] : s["end"]]) for s in loss)
            rows.append((tree, len(turns), whole.hexdigest(), len(under), hashlib.sha256(under.encode()).hexdigest(), len(text)))
        if rows:
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def digest(formatted: DataFrame) -> DataFrame:
    """What formatted conversations say when they are read back."""
    return formatted.select("tree", "formatted", "loss").mapInArrow(_digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
