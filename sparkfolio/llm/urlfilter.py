"""URL filter: rules first, then the ratio of two variable-order Markov models of characters.

Everything is DataFrame expressions. URLs that a rule decides train the models: every
character is counted after contexts of 0 to ``order`` characters, per verdict. Probabilities
are interpolated from the longest context down (Witten-Bell weights), and an unseen character
after a seen context takes that context's escape mass times the shorter context's value. The
log-ratios of the two models go into a table by the key's 64-bit hash that holds every counted key and
grows with them. Up to ``slots`` keys it is broadcast and characters look it up where they are; a
larger one is joined by shuffles with the distinct grams of the URLs, whose values are then
joined to the characters. A URL's score is its log-ratio per character. The threshold is
the one with the best balanced accuracy on decided URLs that were held out of training.

Nulls, empties, ties: a null URL or one without ``://`` has an empty host and path, meets no
rule and scores 0; without decided URLs of both kinds nothing is learned, scores are 0 and the
threshold 0, so such URLs are allowed. Repeated URLs are scored once and get the same verdict.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

ORDER = 4
#: Keys up to which the table is sent to every executor; a larger one is joined by shuffles.
SLOTS = 1 << 20
#: Characters that one task scores.
CHARS = 1_000_000
#: Characters assumed possible at order 0.
ALPHABET = 256
PAD = "\u0002"
RULES = (
    ("com/", "allow"),
    ("example.com/en/", "block"),
    ("www.example.com/en/", "allow"),
    ("net/es/", "block"),
    ("net/fr/", "block"),
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPLIT = r"(?s)\A.*?://([^/?#]*)([^?#]*)(.*)\z"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _SPLIT, 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _SPLIT, 2), F.lit(""))


def match(rules: Sequence[tuple[str, str]], host: Column, path: Column) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in sorted(rules, key=lambda r: (len(r[0]), r[0])):  # the last test made is the first in the chain
        at, slash, rest = rule.partition("/")
        fits = ((host == at) | host.endswith("." + at)) & path.startswith(slash + rest)
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def _positions(urls: DataFrame, order: int) -> DataFrame:
    """A row per character: g0..gK end at it (k characters of context), c1..cK are its contexts."""
    padded = urls.filter(F.length("said") > 0).withColumn("_p", F.concat(F.lit(PAD * order), "said"))
    at = padded.withColumn("_i", F.explode(F.sequence(F.lit(1), F.length("said"))))
    grams = [F.substring(F.col("_p"), F.col("_i") + (order - k), F.lit(k + 1)).alias(f"g{k}") for k in range(order + 1)]
    return at.select(*urls.columns, *grams)


def learn(urls: DataFrame, *, order: int = ORDER) -> DataFrame:
    """(key, weight, value): log-ratios of grams ("g...") and of escapes from contexts ("e...").

    ``urls`` has ``said`` and ``verdict``.
    """
    grams = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"g{k}").alias("gram")) for k in range(order + 1)]))
    seen = _positions(urls, order).select("verdict", grams.alias("x")).groupBy("x.k", "x.gram")
    n = lambda v: F.sum((F.col("verdict") == v).cast("long"))
    counts = common.materialize(seen.agg(n("allow").alias("a"), n("block").alias("b")), "grams")
    counts = counts.withColumn("context", F.expr("substring(gram, 1, length(gram) - 1)"))
    kinds = lambda c: F.sum((F.col(c) > 0).cast("long"))
    contexts = counts.groupBy("k", "context").agg(F.sum("a").alias("na"), F.sum("b").alias("nb"), kinds("a").alias("ta"), kinds("b").alias("tb"))

    def smoothed(c: str, lower: Column) -> Column:
        mass = F.col(f"n{c}") + F.col(f"t{c}")
        return F.when(mass > 0, (F.col(c) + F.col(f"t{c}") * lower) / mass).otherwise(lower)

    levels, before = [], None
    for k in range(order + 1):
        level = counts.filter(F.col("k") == k).join(contexts.filter(F.col("k") == k).drop("k"), "context")
        if before is None:
            pa = pb = F.lit(1.0 / ALPHABET)
        else:
            level = level.withColumn("shorter", F.expr("substring(gram, 2)")).join(before, "shorter")
            pa, pb = F.col("la"), F.col("lb")
        level = common.materialize(level.select("gram", "a", "b", smoothed("a", pa).alias("pa"), smoothed("b", pb).alias("pb")), f"level{k}")
        before = level.select(F.col("gram").alias("shorter"), F.col("pa").alias("la"), F.col("pb").alias("lb"))
        levels.append(level.select(F.concat(F.lit("g"), "gram").alias("key"), (F.col("a") + F.col("b")).alias("weight"), F.ln(F.col("pa") / F.col("pb")).alias("value")))
    escape = lambda c: F.when(F.col(f"n{c}") > 0, F.ln(F.col(f"t{c}") / (F.col(f"n{c}") + F.col(f"t{c}")))).otherwise(0.0)
    out = contexts.filter("k > 0").select(F.concat(F.lit("e"), "context").alias("key"), (F.col("na") + F.col("nb")).alias("weight"), (escape("a") - escape("b")).alias("value"))
    for level in levels:
        out = out.unionByName(level)
    return out


def table_of(model: DataFrame, slots: int = SLOTS) -> DataFrame:
    """The model as (h, value), h the hash of a key: every key, whatever ``slots``."""
    value = F.max_by("value", F.struct("weight", "key")).alias("value")  # keys of one 64-bit hash, if ever
    return model.groupBy(F.xxhash64("key").alias("h")).agg(value)


def score(urls: DataFrame, table: DataFrame, *, order: int = ORDER, slots: int = SLOTS) -> DataFrame:
    """(said, score) of each distinct non-empty ``said``."""
    small = table.count() <= slots
    whole = f"g{order}"
    parts = max(1, -(-(urls.agg(F.sum(F.length("said"))).first()[0] or 0) // CHARS))
    # by characters, as rows of a few bytes become a row a character
    at = _positions(urls.select("said").repartition(parts, "said").dropDuplicates(["said"]), order)
    grams = at if small else at.drop("said").dropDuplicates([whole])
    keys = {"h0": F.concat(F.lit("g"), "g0")}
    for k in range(1, order + 1):
        keys |= {f"h{k}": F.concat(F.lit("g"), f"g{k}"), f"e{k}": F.concat(F.lit("e"), F.expr(f"substring(g{k}, 1, {k})"))}
    kept = "said" if small else whole
    found = grams.select(kept, *[F.xxhash64(v).alias(n) for n, v in keys.items()])
    for n in keys:
        values = table.select(F.col("h").alias(n), F.col("value").alias(f"v{n}"))
        found = found.join(F.broadcast(values) if small else values, n, "left")
    ratio = F.coalesce("vh0", F.lit(0.0))
    for k in range(1, order + 1):
        ratio = F.coalesce(F.col(f"vh{k}"), F.coalesce(f"ve{k}", F.lit(0.0)) + ratio)
    valued = found.select(kept, ratio.alias("ratio"))
    if not small:
        valued = at.select("said", whole).join(valued, whole)
    return valued.groupBy("said").agg(F.avg("ratio").alias("score"))


def threshold(scored: DataFrame) -> DataFrame:
    """One row, ``threshold``: the cut in steps of 0.01 with the best balanced accuracy, 0 without both kinds.

    ``scored`` has ``verdict`` and ``score``; scores beyond 5 either way count as 5, so at most
    1001 steps are compared.
    """
    step = F.round(F.least(F.greatest("score", F.lit(-5.0)), F.lit(5.0)) * 100).cast("int")
    n = lambda v: F.sum((F.col("verdict") == v).cast("long"))
    bins = scored.groupBy(step.alias("step")).agg(n("allow").alias("a"), n("block").alias("b"))
    bins = bins.agg(F.array_sort(F.collect_list(F.struct("step", "a", "b"))).alias("bins"), F.sum("a").alias("na"), F.sum("b").alias("nb"))
    # allowed at or above a cut, blocked below it
    kept = "aggregate(filter(bins, y -> y.step >= x.step), 0D, (s, y) -> s + y.a) / na"
    cut = "aggregate(filter(bins, y -> y.step < x.step), 0D, (s, y) -> s + y.b) / nb"
    best = bins.select(F.expr(f"array_max(transform(bins, x -> struct({kept} + {cut} as gain, -abs(x.step) as near, x.step as step)))").alias("best"), "na", "nb")
    return best.select(F.when((F.col("na") > 0) & (F.col("nb") > 0), F.col("best.step") / 100.0).otherwise(0.0).alias("threshold"))


def judge(pages: DataFrame, *, rules: Sequence[tuple[str, str]] = RULES, order: int = ORDER, slots: int = SLOTS) -> DataFrame:
    """page_id, host, path, rule, verdict, score and threshold for every row of ``pages`` (page_id, url)."""
    url = F.col("url").cast("string")
    host, path = host_of(url), path_of(url)
    rest = F.coalesce(F.regexp_extract(url, _SPLIT, 3), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"), F.concat(host, path, rest).alias("said"))
    rows = rows.withColumn("hit", match(rules, F.col("host"), F.col("path")))
    decided = rows.filter("hit is not null").select("said", F.col("hit.verdict").alias("verdict"))
    later = F.conv(F.substring(F.md5(F.encode("said", "UTF-8")), 1, 4), 16, 10).cast("int") % 5 == 0
    table = common.materialize(table_of(learn(decided.filter(~later), order=order), slots), "table")
    scores = common.materialize(score(rows, table, order=order, slots=slots), "scores")
    cut = threshold(decided.filter(later).join(scores, "said"))
    return (
        rows.join(scores, "said", "left")
        .withColumn("score", F.coalesce("score", F.lit(0.0)))
        .withColumn("threshold", F.coalesce(cut.scalar(), F.lit(0.0)))
        .select("page_id", "host", "path", F.col("hit.rule").alias("rule"), F.coalesce("hit.verdict", F.when(F.col("score") >= F.col("threshold"), "allow").otherwise("block")).alias("verdict"), "score", "threshold")
    )
