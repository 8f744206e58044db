"""From a query tree to columns: what to test per chunk, aggregate per file, and decide."""

from __future__ import annotations

import functools
import operator
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import files as paths
from ..functions import text as texts
from ..lang import nodes as q
from ..lang.printer import display_name

#: Fixed values of the labels and of the score.
HOLDS, FAILS, JOIN = "一致:", " / 未一致:", "、"
SHARE, PHRASE, IN_NAME, IN_PATH, HITS, OCR, MOST_HITS = 0.60, 0.10, 0.15, 0.10, 0.05, 0.02, 20
#: With more stars than this a pattern counts as one without any.
MOST_STARS = 6
OWN = ("name", "path")


@dataclass(frozen=True)
class Options:
    case_sensitive: bool = False
    ignore_width: bool = True
    part_number_mode: bool = False
    max_evidence_per_term: int = 3
    include_path_names: bool = True
    spaces: str = "OR"


@dataclass(frozen=True)
class Needle:
    """How one term is found in a chunk."""

    norm: str
    part: str = ""
    pattern: str = ""
    #: What a pattern has between its stars.
    pieces: tuple[str, ...] = ()

    def match(self) -> Column:
        found = F.col("norm_text").contains(self.norm) if self.norm else F.lit(False)
        if self.pattern:
            return found | F.col("part_text").rlike(self.pattern)
        return found | F.col("part_text").contains(self.part) if self.part else found

    def count(self) -> Column:
        """Occurrences in a chunk that matches, one at least."""
        found = texts.occurrences(F.col("norm_text"), self.norm) if self.norm else F.lit(0)
        if self.pattern:
            part = F.regexp_count("part_text", F.lit(self.pattern))
        else:
            part = texts.occurrences(F.col("part_text"), self.part) if self.part else F.lit(0)
        return F.greatest(F.when(found > 0, found).otherwise(part), F.lit(1)).cast("long")


def needle(term: q.Term, options: Options) -> Needle:
    norm = texts.normalize_text(term.text, ignore_width=options.ignore_width, case_sensitive=options.case_sensitive)
    if not options.part_number_mode:
        return Needle(norm)
    part = texts.canonical_part(term.text, case_sensitive=options.case_sensitive, keep_star=True)
    if "*" in part and part.count("*") <= MOST_STARS and part.strip("*"):
        return Needle(norm, pattern=texts.part_pattern(part), pieces=tuple(part.split("*")))
    return Needle(norm, part.replace("*", ""))


def any_of(columns: Iterable[Column]) -> Column:
    return functools.reduce(operator.or_, columns, F.lit(False))


@dataclass
class Plan:
    """A compiled query. Column i of each kind belongs to ``needles[i]``."""

    root: q.Node | None
    options: Options
    roots: tuple[str, ...] = ()
    needles: list[Needle] = field(default_factory=list)
    terms: list[q.Term] = field(default_factory=list)
    positive: list[int] = field(default_factory=list)
    phrases: list[int] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.of: dict[q.Term, int] = {}
        for term in q.all_terms(self.root):
            n = needle(term, self.options)
            if n not in self.needles:
                self.needles.append(n)
                self.terms.append(term)
            self.of[term] = self.needles.index(n)
        helping = q.terms(self.root)
        self.positive = list(dict.fromkeys(self.of[t] for t in helping))
        self.phrases = sorted({self.of[t] for t in helping if t.phrase})
        self.nears = q.nears(self.root)
        self.levels: list[list[q.Node]] = []
        self._place(self.root)
        self.named = {part: f"v{k}" for k, part in enumerate(p for level in self.levels for p in level)}

    def _place(self, node: q.Node | None) -> int:
        """Put the parts of the query into ``levels``, each above those it reads; a part once."""
        if node is None:
            return -1
        own = () if isinstance(node, q.Near) else q.below(node)
        at = 1 + max(map(self._place, own), default=-1)
        self.levels += [[] for _ in range(at + 1 - len(self.levels))]
        if node not in self.levels[at]:
            self.levels[at].append(node)
        return at

    # chunks ------------------------------------------------------------------------------
    def prefilter(self) -> Column | None:
        """Chunks that can matter, where no other chunk can change an answer."""
        if not q.requires_term(self.root):
            return None
        return any_of(n.match() for n in self.needles)

    def near(self, node: q.Near) -> Column:
        left, right = (texts.normalize_text(t.text, ignore_width=self.options.ignore_width, case_sensitive=self.options.case_sensitive) for t in (node.left, node.right))
        return texts.near(F.col("norm_text"), left, right, node.distance)

    def tested(self, chunks: DataFrame) -> DataFrame:
        """Chunks with m0, c0, ... (whether and how often a needle occurs) and n0, ... (nearness)."""
        found = {f"m{i}": n.match() for i, n in enumerate(self.needles)} | {f"n{j}": self.near(n) for j, n in enumerate(self.nears)}
        some = chunks.withColumns(found) if found else chunks  # counts read these columns, so no needle is sought twice
        counts = [F.when(F.col(f"m{i}"), n.count()).alias(f"c{i}") for i, n in enumerate(self.needles)]
        return some.select("file_id", "chunk_index", "kind", *found, *counts)

    # files -------------------------------------------------------------------------------
    def aggregates(self) -> list[Column]:
        out = [F.count("*").alias("units")]
        for i in range(len(self.needles)):
            out += [F.bool_or(f"m{i}").alias(f"p{i}"), F.sum(f"c{i}").alias(f"h{i}"), F.min_by(f"c{i}", F.when(F.col(f"m{i}"), F.col("chunk_index"))).alias(f"f{i}")]
        out += [F.bool_or(f"n{j}").alias(f"near{j}") for j in range(len(self.nears))]
        helps = any_of(F.col(f"m{i}") for i in self.positive)
        out += [F.bool_or(helps & (F.col("kind") == k)).alias(f"{k}_hit") for k in OWN]
        out.append(F.bool_or((F.col("kind") == "ocr") & (helps if self.positive else F.lit(True))).alias("ocr_hit"))
        return out

    def present(self, i: int) -> Column:
        return F.coalesce(F.col(f"p{i}"), F.lit(False))

    def judge(self, files: DataFrame) -> DataFrame:
        """Files with a column for the verdict on each part of the query, and ``accepted``.

        A part reads the columns of the parts below it. Missing aggregates are false before anything is
        negated.
        """
        for parts in self.levels:
            files = files.withColumns({self.named[part]: self._verdict(part) for part in parts})
        return files.withColumn("accepted", F.lit(True) if self.root is None else self.verdict(self.root))

    def verdict(self, node: q.Node) -> Column:
        return F.col(self.named[node])

    def _verdict(self, node: q.Node) -> Column:
        if isinstance(node, q.Term):
            return self.present(self.of[node])
        if isinstance(node, q.Near):
            return F.coalesce(F.col(f"near{self.nears.index(node)}"), F.lit(False))
        if isinstance(node, q.Meta):
            return F.coalesce(self.meta(node), F.lit(False))
        if isinstance(node, q.Not):
            return ~self.verdict(node.child)
        parts = [self.verdict(c) for c in node.children]
        if isinstance(node, q.AtLeast):
            return functools.reduce(operator.add, [p.cast("int") for p in parts]) >= node.count
        return functools.reduce(operator.and_ if isinstance(node, q.And) else operator.or_, parts)

    def meta(self, node: q.Meta) -> Column:
        value = node.value
        if node.field == "type":
            return paths.kind(F.col("extension")) == value
        if node.field == "ext":
            return F.regexp_replace(F.lower("extension"), r"^\.+", "").isin(*value.split(","))
        if node.field in ("size", "modified"):
            mine = F.col("size") if node.field == "size" else paths.modified_day(F.col("mtime_ns"))
            read = (lambda v: F.lit(int(v))) if node.field == "size" else (lambda v: F.lit(v).cast("date"))
            if node.op == "range":
                low, high = value.split("..", 1)
                return mine.between(read(low), read(high))
            return {"lt": operator.lt, "le": operator.le, "gt": operator.gt, "ge": operator.ge}[node.op](mine, read(value))
        if node.field in ("name", "path"):
            return F.col(f"{node.field}_norm").contains(texts.normalize_text(value))
        if node.field == "source":
            return F.col("source_type") == value
        if node.field == "root":
            return F.lit(any(texts.normalize_text(value) in texts.normalize_text(r) for r in self.roots))
        marked = F.col("confirmed" if node.field == "confirmed" else "ocr_hit")
        return F.coalesce(marked, F.lit(False)) == (value == "true")

    def file_filter(self) -> Column | None:
        """The part of the query that files alone decide, for use before any text is read."""
        known = [c for c in q.conjuncts(self.root) if isinstance(c, q.Meta) and c.field != "ocr"]
        return functools.reduce(operator.and_, [F.coalesce(self.meta(c), F.lit(False)) for c in known]) if known else None

    # results -----------------------------------------------------------------------------
    def matched_terms(self) -> Column:
        said = [F.when(self.present(i), F.lit(self.terms[i].text)) for i in self.positive]
        return F.filter(F.array(*said), lambda t: t.isNotNull()) if said else F.array().cast("array<string>")

    def _sum(self, kind: str) -> Column:
        return functools.reduce(operator.add, [F.coalesce(F.col(f"{kind}{i}"), F.lit(0)) for i in self.positive], F.lit(0).cast("long"))

    def hit_count(self) -> Column:
        return self._sum("h")

    def hit_count_first(self) -> Column:
        """Hits in the first chunk of each term only."""
        return self._sum("f")

    def score(self) -> Column:
        if not self.positive:
            return F.lit(0.0)
        tenth = lambda c, w: F.when(c, w).otherwise(0.0)
        flag = lambda name: F.coalesce(F.col(name), F.lit(False))
        matched = functools.reduce(operator.add, [self.present(i).cast("int") for i in self.positive])
        total = matched / len(self.positive) * SHARE + tenth(any_of(self.present(i) for i in self.phrases), PHRASE)
        total += tenth(flag("name_hit"), IN_NAME) + tenth(flag("path_hit"), IN_PATH)
        total += F.least(self.hit_count(), F.lit(MOST_HITS)) / MOST_HITS * HITS - tenth(flag("ocr_hit"), OCR)
        return F.round(F.least(F.greatest(total, F.lit(0.0)), F.lit(1.0)), 4)

    def _labels(self, node: q.Node) -> Column:
        """array of labels of the parts of ``node`` that hold, for a file that matches it."""
        if isinstance(node, q.AtLeast):
            part = lambda hold: F.array_join(F.filter(F.array(*[F.when(self.verdict(c) == hold, display_name(c)) for c in node.children]), lambda x: x.isNotNull()), JOIN)
            count = functools.reduce(operator.add, [self.verdict(c).cast("int") for c in node.children])
            return F.array(F.concat(F.lit(HOLDS), part(True), F.lit(FAILS), part(False), F.lit("（"), count.cast("string"), F.lit(f"/{len(node.children)}）")))
        inside = any(isinstance(x, q.AtLeast) for x in q.walk(node))
        if isinstance(node, q.Or) or isinstance(node, q.And) and inside:
            none = F.array().cast("array<string>")
            deep = lambda c: isinstance(c, (q.And, q.Or, q.AtLeast)) and any(isinstance(x, q.AtLeast) for x in q.walk(c))
            own = [F.when(self.verdict(c), self._labels(c) if deep(c) else F.array(F.lit(display_name(c)))).otherwise(none) for c in node.children]
            return F.array_distinct(F.flatten(F.array(*own)))
        return F.array(F.lit(display_name(node)))

    def displays(self) -> Column:
        return F.array().cast("array<string>") if self.root is None else self._labels(self.root)
