"""Many stored queries against a corpus in one plan, whose size doesn't grow with their number.

Queries become tables. Each needle has one gram, the characters of it that are rarest; texts meet the needles by grams, and what
meets is verified on the text, so a text is compared with few needles only. A needle without blanks lies in one word of a chunk, so it
is looked for and counted in words; others (phrases, pairs that are near, part numbers) in whole chunks. Then the boolean trees are evaluated from below, a
level of all queries at a time, over rows (query, file, part): a part holds if enough of its children hold, which covers AND, OR and
k-of-n. Only parts whose value differs from that in a file without any term have rows, so a negation costs nothing where its term is
absent.

Queries must need a term; others match files without any, and are refused.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from typing import Any, NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import files as paths
from ..functions import text as texts
from ..lang import nodes as q
from ..lang.parser import parse_query
from ..sources import storage
from ..sources.chunks import Corpus
from .compile import OWN, Needle, Options, Plan

#: Characters of a gram of chunks, and of one of words.
SIZE, WORD_SIZE = 3, 4
#: What words are parted by.
_BLANK = " \t\n\x0b\f\r"
#: Letters of prose by falling frequency, an estimate that only costs are based on.
_COMMON = "etaoinshrdlcumwfgypbvkjxqz"
_LEAVES = "query_id long, part int, parent int, sign int, needle int"
_METAS = "query_id long, part int, parent int, sign int, field string, op string, value string, low string, high string"
_PARTS = "query_id long, part int, parent int, sign int, level int, need int, base int, rest int"
_NEEDLES = "needle int, mark string, gram string, norm string, part_norm string, pattern string, left string, right string, distance int"


class Tables(NamedTuple):
    """Stored queries as rows. ``base`` is the sum of a part's children in a file without terms, ``rest`` its own value there."""

    needles: list[tuple]
    leaves: list[tuple]
    metas: list[tuple]
    parts: list[tuple]
    helping: list[tuple]
    levels: int


def _gram(text: str, size: int = SIZE) -> str:
    """The rarest ``size`` characters of a needle, or all of a shorter one."""
    rank = lambda c: _COMMON.find(c) if c in _COMMON else len(_COMMON)
    return max((text[i : i + size] for i in range(max(1, len(text) - size + 1))), key=lambda g: (sum(map(rank, g)), g))


def _ways(needle: Needle) -> list[tuple[str, str]]:
    """(column, gram) by which a chunk with the needle is met."""
    ways = [("n", _gram(needle.norm))] if needle.norm else []
    if needle.pattern:
        ways.append(("p", _gram(max(needle.pieces, key=len))))
    elif needle.part:
        ways.append(("p", _gram(needle.part)))
    return ways


def compiled(queries: Mapping[int, str | q.Node], options: Options = Options()) -> Tables:
    out = Tables([], [], [], [], [], 0)
    known: dict[Any, int] = {}
    deepest = 0

    def needle_of(key: Any, rows: Iterable[tuple[str, str]], *rest: Any) -> int:
        if key not in known:
            known[key] = len(known)
            out.needles.extend((known[key], mark, gram, *rest) for mark, gram in rows)
        return known[key]

    for query_id, query in queries.items():
        node = parse_query(query, spaces=options.spaces) if isinstance(query, str) else query
        if not q.requires_term(node):
            raise ValueError(f"query {query_id} matches files without any of its terms")
        plan = Plan(node, options)
        numbers = iter(range(1 << 30))

        def go(node: q.Node, parent: int, sign: int, plan: Plan = plan, numbers=numbers, query_id: int = query_id) -> tuple[int, int]:  # type: ignore[no-untyped-def]
            """(level, value without terms) of a node that counts ``sign`` for its parent."""
            nonlocal deepest
            if isinstance(node, q.Not):
                level, value = go(node.child, parent, -sign)
                return level, 1 - value
            me = next(numbers)
            if isinstance(node, q.Term):
                n = plan.needles[plan.of[node]]
                out.leaves.append((query_id, me, parent, sign, needle_of(n, _ways(n), n.norm, n.part, n.pattern, None, None, None)))
                return 0, 0
            if isinstance(node, q.Near):
                left, right = (texts.normalize_text(t.text, ignore_width=options.ignore_width, case_sensitive=options.case_sensitive) for t in (node.left, node.right))
                key = ("near", left, right, node.distance)
                out.leaves.append((query_id, me, parent, sign, needle_of(key, [("n", _gram(left))], None, None, texts.near_pattern(left, right, node.distance), left, right, node.distance)))
                return 0, 0
            if isinstance(node, q.Meta):
                low, high = node.value.split("..", 1) if node.op == "range" else (None, None)
                value = texts.normalize_text(node.value) if node.field in ("name", "path") else node.value
                out.metas.append((query_id, me, parent, sign, node.field, node.op, value, low, high))
                return 0, 0
            below = [(go(c, me, 1), c) for c in node.children]
            level = 1 + max(x for (x, _), _ in below)
            base = sum(v for (_, v), _ in below)
            need = node.count if isinstance(node, q.AtLeast) else len(below) if isinstance(node, q.And) else 1
            value = int(base >= need)
            out.parts.append((query_id, me, parent, sign, level, need, base, value))
            deepest = max(deepest, level)
            return level, value

        go(q.Or((node,)), -1, 1)  # so that every query has a part above its leaves
        for i in plan.positive:
            n = plan.needles[i]
            out.helping.append((query_id, needle_of(n, _ways(n), n.norm, n.part, n.pattern, None, None, None)))
    return out._replace(levels=deepest)


def _is_word(row: tuple) -> bool:
    """Whether a row of ``_NEEDLES`` is a literal that a blank can't part, and the only way to find it."""
    _, mark, _, norm, part, pattern, left, *_ = row
    return mark == "n" and bool(norm) and not part and not pattern and left is None and not set(norm) & set(_BLANK)


def _in_words(chunks: DataFrame, rows: list[tuple]) -> DataFrame:
    """file_id, needle and hits in each word that holds a needle; ``rows`` are of ``_NEEDLES`` and pass ``_is_word``."""
    mine = [(row[0], _gram(row[3], WORD_SIZE), row[3]) for row in rows]
    sizes = sorted({len(gram) for _, gram, _ in mine})
    needles = F.broadcast(chunks.sparkSession.createDataFrame(mine, "needle int, gram string, norm string"))
    words = chunks.select("file_id", F.explode(F.split("norm_text", r"[ \t\n\x0B\f\r]+")).alias("word")).filter(F.length("word") >= sizes[0])
    grams = words.withColumn("at", F.explode(F.sequence(F.lit(1), F.length("word") - (sizes[0] - 1))))
    if len(sizes) > 1:
        grams = grams.withColumn("size", F.explode(F.array(*map(F.lit, sizes)))).filter(F.col("at") + F.col("size") <= F.length("word") + 1)
    else:
        grams = grams.withColumn("size", F.lit(sizes[0]))
    both = grams.withColumn("gram", F.substring(F.col("word"), F.col("at"), F.col("size"))).join(needles, "gram")
    once = F.call_function("instr", F.col("word"), F.col("gram")) == F.col("at")  # a word may hold a gram again
    found = both.filter(once & F.call_function("contains", F.col("word"), F.col("norm")))
    return found.select("file_id", "needle", ((F.length("word") - F.length(F.replace("word", "norm", F.lit("")))) / F.length("norm")).cast("long").alias("hits"))


def _in_chunks(chunks: DataFrame, wanted: list[tuple], part_numbers: bool) -> DataFrame:
    """file_id, needle and hits in each chunk that holds a needle; ``wanted`` are rows of ``_NEEDLES``."""
    needles = chunks.sparkSession.createDataFrame(wanted, _NEEDLES)
    none = F.expr("cast(array() as array<string>)")

    def each(text: str, mark: str) -> Column:
        mine = sorted({g for _, m, g, *_ in wanted if m == mark})
        every = [F.regexp_extract_all(F.col(text), F.lit(f"(?s)(?=(.{{{k}}}))"), 1) for k in sorted({len(g) for g in mine})]
        known = F.array_intersect(F.concat(*every), F.array(*map(F.lit, mine))) if mine else none
        return F.transform(known, lambda g: F.concat(F.lit(mark), g))

    every = F.concat(each("norm_text", "n"), each("part_text", "p")) if part_numbers else each("norm_text", "n")
    rows = chunks.select("file_id", "chunk_index", "norm_text", "part_text", F.explode(every).alias("gram"))
    both = rows.join(F.broadcast(needles.withColumn("gram", F.concat("mark", "gram"))), "gram")
    hay, part = F.col("norm_text"), F.col("part_text")
    inside = lambda hay, c: F.call_function("contains", hay, F.col(c)) & (F.col(c) != "")
    count = lambda hay, c: F.when(F.col(c) != "", ((F.length(hay) - F.length(F.replace(hay, F.col(c), F.lit("")))) / F.length(c)).cast("long")).otherwise(0)
    rlike = lambda hay: F.call_function("rlike", hay, F.col("pattern"))
    first, last = F.call_function("instr", hay, F.col("left")), F.length(hay) - F.call_function("instr", F.reverse(hay), F.reverse("left")) - F.length("left") + 2
    near = F.when(F.col("left") == F.col("right"), (first > 0) & (last > first) & (last - first <= F.col("distance"))).otherwise(inside(hay, "left") & inside(hay, "right") & rlike(hay))
    in_part = F.when(F.col("pattern") != "", rlike(part)).otherwise(inside(part, "part_norm"))
    test = F.when(F.col("left").isNotNull(), near).otherwise(inside(hay, "norm") | in_part)
    in_norm = count(hay, "norm")
    hits = F.when(F.col("left").isNotNull(), 0).otherwise(F.greatest(F.when(in_norm > 0, in_norm).when(F.col("pattern") != "", F.call_function("regexp_count", part, F.col("pattern"))).otherwise(count(part, "part_norm")), F.lit(1)))
    found = both.filter(test).select("file_id", "chunk_index", "needle", hits.cast("long").alias("hits"))
    if part_numbers:  # a chunk may be met in two ways
        found = found.groupBy("file_id", "chunk_index", "needle").agg(F.max("hits").alias("hits"))
    return found.select("file_id", "needle", "hits")


def _met(chunks: DataFrame, needles: list[tuple], part_numbers: bool) -> DataFrame:
    """file_id, needle and hits of the needles that files hold; ``needles`` are rows of ``_NEEDLES``.

    Needles were a list on the driver, so they are sent to all tasks; no text and no gram of one is shuffled.
    """
    words, others = [row for row in needles if _is_word(row)], [row for row in needles if not _is_word(row)]
    found = _in_words(chunks, words) if words else None
    if others or not words:
        rest = _in_chunks(chunks, others, part_numbers)
        found = found.unionByName(rest) if found is not None else rest
    return found.groupBy("file_id", "needle").agg(F.sum("hits").alias("hits"))


def _holds(asked: Iterable[str]) -> Column:
    """Whether a file passes the condition in field, op, value, low and high; columns of fields other than ``asked`` aren't read."""
    op, value = F.col("op"), F.col("value")

    def compared(mine: Column, read) -> Column:  # type: ignore[no-untyped-def]
        v = read(value)
        return F.when(op == "range", mine.between(read(F.col("low")), read(F.col("high")))).when(op == "lt", mine < v).when(op == "le", mine <= v).when(op == "gt", mine > v).otherwise(mine >= v)

    tests = {
        "type": lambda: paths.kind(F.col("extension")) == value,
        "ext": lambda: F.array_contains(F.split(value, ","), F.regexp_replace(F.lower("extension"), r"^\.+", "")),
        "size": lambda: compared(F.col("size"), lambda v: v.try_cast("long")),
        "modified": lambda: compared(paths.modified_day(F.col("mtime_ns")), lambda v: v.try_cast("date")),
        "name": lambda: F.call_function("contains", F.col("name_norm"), value),
        "path": lambda: F.call_function("contains", F.col("path_norm"), value),
        "source": lambda: F.col("source_type") == value,
    }
    return F.coalesce(*[F.when(F.col("field") == f, tests[f]()) for f in sorted(set(asked))], F.lit(False))


def matches(corpus: Corpus, queries: Mapping[int, str | q.Node], options: Options = Options()) -> DataFrame:
    """query_id, file_id and hit_count of every file that a stored query matches.

    Conditions may be on type, ext, size, modified, name, path and source.
    """
    spark: SparkSession = corpus.files.sparkSession
    if options.case_sensitive or not options.ignore_width:
        raise ValueError("stored queries are compared with stored texts, which are folded")
    t = compiled(queries, options)
    if odd := {m[4] for m in t.metas} - {"type", "ext", "size", "modified", "name", "path", "source"}:
        raise ValueError(f"stored queries can't ask for {', '.join(sorted(odd))}")
    table = lambda rows, schema: spark.createDataFrame(rows, schema)
    chunks = corpus.chunks if options.include_path_names else corpus.chunks.filter(~F.col("kind").isin(*OWN))
    met = _met(chunks, t.needles, options.part_number_mode)
    met = storage.stored(met, "met")
    level_of = {(p[0], p[1]): p[4] for p in t.parts}
    added = lambda rows: rows.select("query_id", "file_id", "part", "parent", F.col("sign").alias("adds"))
    if t.metas:
        pairs = met.join(table(sorted({(x[0], x[4]) for x in t.leaves}), "query_id long, needle int"), "needle").select("query_id", "file_id").distinct()
        pairs = pairs.join(table(t.metas, _METAS), "query_id").join(corpus.files, "file_id")
        told = storage.stored(added(pairs.filter(_holds(m[4] for m in t.metas))), "metas")
    # rows of parts whose value differs from that without terms: what they add to their parent
    parts, above = table(t.parts, _PARTS), None
    for level in range(1, t.levels + 1):
        rows = added(met.join(table([x for x in t.leaves if level_of[x[0], x[2]] == level], _LEAVES), "needle"))
        for more in ([told] if t.metas else []) + ([above] if above is not None else []):
            rows = rows.unionByName(more)
        own = parts.filter(F.col("level") == level).select("query_id", F.col("part").alias("me"), F.col("parent").alias("above"), "sign", "need", "base", "rest")
        summed = rows.join(own, (rows["query_id"] == own["query_id"]) & (rows["parent"] == own["me"])).groupBy(own["query_id"], "file_id", "me", "above", "sign", "need", "base", "rest").agg(F.sum("adds").alias("more"))
        value = (F.col("base") + F.col("more") >= F.col("need")).cast("int")
        changed = summed.filter(value != F.col("rest"))
        new = storage.stored(changed.select("query_id", "file_id", F.col("me").alias("part"), F.col("above").alias("parent"), (F.col("sign") * (1 - 2 * F.col("rest"))).alias("adds")), "parts")
        above = new if above is None else above.unionByName(new)
    found = above.filter("parent = -1").select("query_id", "file_id")
    helping = table(t.helping, "query_id long, needle int").join(met, "needle")
    hits = found.join(helping, ["query_id", "file_id"], "left").groupBy("query_id", "file_id")
    return hits.agg(F.coalesce(F.sum("hits"), F.lit(0)).alias("hit_count"))
