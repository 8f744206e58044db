"""Mixing by soft membership: document rates whose expected domain totals meet target weights.

Everything is DataFrame expressions, MLlib's DataFrame API and sums; no Python runs on the executors.

1. A logistic regression learns the labelled domains from exactly ``SAMPLE`` labelled documents (or all, if there are
   fewer), the first by a hash of the id: how many of its different words fall into each of ``SLOTS`` hashed slots, and a few
   measures of the whole text. Gradients are summed up on the executors, and the model has a fixed size. A fifth of these documents
   is left out of the fit and sets one temperature, so that memberships are as sure as held-out labels say they may be.
2. Every different word of every document is looked up in the model's table and summed up. A document's posterior is the model's, with a
   little of the prior (``SMOOTH``), so no domain is impossible.
3. Rates r >= 0 minimise the squared relative errors of sum(r * tokens * posterior) against the targets plus ``RIDGE`` times the mean of
   (r - 1)^2 over tokens, by projected gradient steps: r = max(0, 1 - sum of steps * posterior), from r = 1. The
   penalty keeps rates near 1 where a target could be met by extreme rates only; what it costs shows in ``reached_``. Steps are scaled by
   the inverse Gram matrix of the documents with positive rates; several dampings and step sizes are
   tried in one pass over the posteriors, which returns a few sums for each, and the best is kept.

Copies of a document: the whole part of its rate, plus one with the fraction's probability by
a hash of id and text, the same in every run; so the rates meet the targets, and the
copies in expectation. The mixture holds as many tokens as the corpus (``TOTAL``).

Nulls, empties, ties: a null or empty text has 0 tokens, no words, and a rate like
others; rows with a null id are mixed too; a document labelled several times counts in the worst of its domains; repeated rows have
equal rates; if labels name one domain or none, posteriors are the prior, which counts every domain once more than its labels do. A domain
that has no tokens cannot reach its target and keeps its error, which ``reached_`` columns show.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import NamedTuple

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from . import common

SAMPLE = 20_000
SLOTS = 1 << 15
ROW = 256
#: Weight of the squared coefficients in the fit, and its iterations.
PENALTY, ITERATIONS = 0.03, 30
#: Share of the prior in a posterior.
SMOOTH = 0.01
TEMPERATURES = tuple(round(0.5 * 1.15**i, 4) for i in range(16))
#: Weight of the mean squared distance of rates from 1 against squared relative errors of the totals.
RIDGE = 1e-3
ROUNDS = 30
#: Dampings and sizes of the steps that are tried.
STEPS = ((0.0, 1.0), (0.0, 0.3), (1e-3, 1.0), (1e-2, 1.0), (1e-1, 1.0))
#: Shares of the mixture, and its size as a share of the corpus.
TARGETS = {"high": 0.90, "low": 0.08, "toxic": 0.02}
TOTAL = 1.0
_SPACE = r"[\x20\x09-\x0D]+"
_MARKS, _EDGES = "#*$%&|<>", ".,;:!?\"'()"
DENSE = ("size", "marked", "lines", "distinct", "other", "length")


def domains_of(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) from quality and toxic marks; a null mark says nothing against a document."""
    marks = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    marks = marks.agg(F.max(F.coalesce("toxic", F.lit(0))).alias("toxic"), F.min(F.coalesce("quality", F.lit(1))).alias("quality"))
    return marks.select("doc_id", F.when(F.col("toxic") > 0, "toxic").when(F.col("quality") > 0, "high").otherwise("low").alias("domain"))


def draw(labelled: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, domain) of the labelled documents that teach."""
    return labelled.orderBy(F.xxhash64("doc_id"), "doc_id", "domain").limit(sample)


def _spread(docs: DataFrame, *keep: str) -> DataFrame:
    """A row for each different word of each row of ``docs``, one at least; ``w`` is empty where there is no word."""
    text = F.coalesce("text", F.lit(""))
    words, lines = F.split(text, _SPACE), F.split(text, "\n")
    given = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), *keep, text.alias("text"), words.alias("words"), F.array_distinct(words).alias("different"), lines.alias("lines"))
    blank = (F.element_at("words", 1) == "").cast("long") + ((F.size("words") > 1) & (F.element_at("words", -1) == "")).cast("long")
    other = F.length(F.regexp_replace("text", r"[\p{L}\s]+", "")) / F.greatest(F.length("text"), F.lit(1))
    told = given.select("row", "doc_id", "text_hash", *keep, (F.size("words") - blank).alias("n_tokens"), (F.size(F.array_distinct("lines")) / F.size("lines")).alias("lines"), (F.size("different") / F.size("words")).alias("distinct"), other.alias("other"), (F.length("text") / F.size("words")).alias("length"), "different")
    return told.select(*_KEY, *keep, F.explode("different").alias("w"))


def _slot(slots: int) -> Column:
    """The slot of a word, without marks at its ends; null for none."""
    return F.when(F.col("w") != "", F.pmod(F.xxhash64(F.btrim(F.lower("w"), F.lit(_EDGES))), F.lit(slots)).cast("int"))


_KEY = ["row", "doc_id", "text_hash", "n_tokens", "lines", "distinct", "other", "length"]


def _marked() -> Column:
    """How many different words hold a mark."""
    return F.count_if(F.translate("w", _MARKS, "") != F.col("w")).alias("marked")


def _dense() -> list[Column]:
    return [F.log1p("n_tokens") / 10, F.col("marked") / F.greatest("n_tokens", F.lit(1)), F.col("lines"), F.col("distinct"), F.col("other"), F.least(F.col("length") / 20, F.lit(1.0))]


def features(docs: DataFrame, *keep: str, slots: int = SLOTS) -> DataFrame:
    """doc_id, text_hash, ``keep`` and ``features``, a sparse vector, for every row of ``docs``; for rows that are few."""
    words = _spread(docs, *keep)
    dense = words.groupBy(*_KEY, *keep).agg(_marked())
    counts = words.withColumn("slot", _slot(slots)).filter("slot is not null").groupBy("row", "slot").agg(F.count("*").alias("n"))
    held = counts.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("slot", "n"))).alias("held"))
    both = dense.join(held, "row", "left").withColumn("held", F.coalesce("held", F.expr("cast(array() as array<struct<slot:int,n:bigint>>)")))
    indices = F.concat(F.array(*[F.lit(i) for i in range(len(DENSE))]), F.transform("held", lambda x: x["slot"] + len(DENSE)))
    values = F.concat(F.array(*[x.cast("double") for x in _dense()]), F.transform("held", lambda x: x["n"].cast("double")))
    vector = F.struct(F.lit(0).cast("byte").alias("type"), F.lit(slots + len(DENSE)).alias("size"), indices.alias("indices"), values.alias("values"))
    made = common.materialize(both.select("doc_id", "text_hash", *keep, vector.alias("features")), "features")
    # the fields of a sparse vector, read as one
    kinds = StructType([StructField(f.name, VectorUDT() if f.name == "features" else f.dataType) for f in made.schema])
    out = docs.sparkSession.read.schema(kinds).parquet(made._work_path)
    out._work_path = made._work_path
    return out


class Model(NamedTuple):
    """``known`` domains are told apart by ``weights`` (a row each: dense features, then slots) and ``own``; without them all posteriors are the prior."""

    domains: list[str]
    prior: list[float]
    known: list[int]
    weights: np.ndarray
    own: np.ndarray
    temperature: float


def learn(docs: DataFrame, drawn: DataFrame, domains: list[str], *, slots: int = SLOTS) -> Model:
    """``drawn`` is broadcast: it holds a bounded number of short rows."""
    number = F.array_position(F.array(*map(F.lit, domains)), F.col("domain")).cast("int") - 1
    marks = drawn.select(F.col("doc_id").alias("_drawn"), number.alias("domain"))
    said = docs.select("doc_id", "text").join(F.broadcast(marks), F.col("doc_id").cast("long") == F.col("_drawn"))
    rows = features(said, "domain", slots=slots)
    later = common.held_out(F.col("doc_id"))
    sizes = dict(map(tuple, rows.groupBy("domain").agg(F.count("*")).collect()))  # a row for each domain
    prior = [(sizes.get(i, 0) + 1) / (sum(sizes.values()) + len(domains)) for i in range(len(domains))]
    known = [r["domain"] for r in rows.filter(~later).select("domain").distinct().orderBy("domain").collect()]
    if len(known) < 2:
        common.release(rows)
        return Model(domains, prior, known, np.zeros((0, 0)), np.zeros(0), 1.0)
    place = F.array_position(F.array(*map(F.lit, known)), F.col("domain")).cast("double") - 1
    fitting = LogisticRegression(featuresCol="features", labelCol="place", family="multinomial", regParam=PENALTY, maxIter=ITERATIONS)
    taught = rows.filter(~later).select(place.alias("place"), "features")
    found = fitting.fit(taught.coalesce(docs.sparkSession.sparkContext.defaultParallelism))
    model = Model(domains, prior, known, found.coefficientMatrix.toArray(), found.interceptVector.toArray(), 1.0)
    test = said.filter(later)
    losses = loss(test, model, TEMPERATURES)
    common.release(rows)
    return model._replace(temperature=min(TEMPERATURES, key=lambda t: (losses[t], abs(t - 1)))) if losses else model


def _table(spark: SparkSession, model: Model) -> DataFrame:
    """One row: for each known domain its weights of slots, ``ROW`` to an array."""
    slots = model.weights[:, len(DENSE) :].astype(np.float32)
    row = tuple([part.tolist() for part in np.array_split(w, max(1, len(w) // ROW))] for w in slots)
    return spark.createDataFrame([(row,)], "t struct<" + ", ".join(f"l{j}: array<array<float>>" for j in range(len(row))) + ">")


def logits(docs: DataFrame, model: Model, *keep: str) -> DataFrame:
    """doc_id, text_hash, ``keep``, n_tokens and x0, x1, ... of the known domains for every row of ``docs``."""
    words = _spread(docs, *keep)
    k = len(model.known) if len(model.own) else 0
    sums = []
    if k:
        slots = model.weights.shape[1] - len(DENSE)
        words = words.withColumn("slot", _slot(slots))
        high, low = F.floor(F.col("slot") / ROW).cast("int"), (F.col("slot") % ROW).cast("int")
        t = _table(docs.sparkSession, model).select("t").scalar()
        sums = [F.sum(t[f"l{j}"][high][low].cast("double")).alias(f"s{j}") for j in range(k)]
    told = words.groupBy(*_KEY, *keep).agg(_marked(), *sums)
    x = [float(model.own[j]) + F.coalesce(f"s{j}", F.lit(0.0)) + sum((float(w) * d for w, d in zip(model.weights[j], _dense(), strict=False)), F.lit(0.0)) for j in range(k)]
    return told.select("doc_id", "text_hash", *keep, "n_tokens", *[v.alias(f"x{j}") for j, v in enumerate(x)])


def memberships(model: Model, temperature: float | None = None) -> list[Column]:
    """The posterior of each domain over rows of ``logits``."""
    if not len(model.own):
        return [F.lit(p) for p in model.prior]
    x = [F.col(f"x{j}") / (temperature or model.temperature) for j in range(len(model.known))]
    top = F.greatest(*x)
    whole = sum((F.exp(v - top) for v in x), F.lit(0.0))
    odds = {i: F.exp(v - top) / whole for i, v in zip(model.known, x, strict=True)}
    return [(odds[i] * (1 - SMOOTH) if i in odds else F.lit(0.0)) + SMOOTH * p for i, p in enumerate(model.prior)]


def loss(labelled: DataFrame, model: Model, temperatures: Sequence[float]) -> dict[float, float]:
    """Mean log-loss of labelled rows (doc_id, text, domain) at each temperature; empty without rows."""
    of = lambda t: F.avg(-F.ln(F.element_at(F.array(*memberships(model, t)), F.col("domain") + 1)))
    row = logits(labelled, model, "domain").agg(*[of(t).alias(f"t{i}") for i, t in enumerate(temperatures)]).first()
    return {} if row["t0"] is None else {t: row[f"t{i}"] for i, t in enumerate(temperatures)}


def posteriors(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, text_hash, n_tokens and p0, p1, ... for every row of ``docs``."""
    return logits(docs, model).select("doc_id", "text_hash", "n_tokens", *[p.alias(f"p{i}") for i, p in enumerate(memberships(model))])


def rate_of(moves: np.ndarray) -> Column:
    """The rate of a row with posteriors p0, p1, ... after steps that sum up to ``moves``."""
    return F.greatest(F.lit(0.0), F.lit(1.0) - sum((float(m) * F.col(f"p{i}") for i, m in enumerate(moves)), F.lit(0.0)))


def fit(soft: DataFrame, targets: np.ndarray, *, rounds: int = ROUNDS, ridge: float = RIDGE, tolerance: float = 1e-9) -> tuple[Column, np.ndarray]:
    """The rate of a row of ``soft`` as a column, and the expected totals it gives."""
    k = len(targets)
    pairs = [(i, j) for i in range(k) for j in range(i + 1)]
    p, n = [F.col(f"p{i}") for i in range(k)], F.col("n_tokens").cast("double")
    scale = np.where(targets > 0, targets, max(targets.sum(), 1.0))
    weight = ridge / max(targets.sum(), 1.0)

    def measured_(tried: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray, float]]:
        """For each sum of steps the totals, the Gram matrix of the rows with positive rates, and the sum of (r - 1)^2."""
        sums = []
        for e, moves in enumerate(tried):
            rate = rate_of(moves)
            sums += [F.sum(rate * n * x).alias(f"t{e}_{i}") for i, x in enumerate(p)]
            sums += [F.sum(F.when(rate > 0, n * p[i] * p[j])).alias(f"g{e}_{i}_{j}") for i, j in pairs]
            sums.append(F.sum(n * (rate - 1) * (rate - 1)).alias(f"f{e}"))
        row = soft.agg(*sums).first().asDict()
        value = lambda name: row[name] or 0.0
        return [(np.array([value(f"t{e}_{i}") for i in range(k)]), np.array([[value(f"g{e}_{max(i, j)}_{min(i, j)}") for j in range(k)] for i in range(k)]), value(f"f{e}")) for e in range(len(tried))]

    cost = lambda end: float((((end[0] - targets) / scale) ** 2).sum() + weight * end[2])
    moves = np.zeros(k)
    (now,) = measured_([moves])
    for _ in range(rounds):
        gram = now[1] / np.outer(scale, scale)
        away = (now[0] - targets) / scale - weight * moves * scale
        if np.abs(gram @ away).max(initial=0) <= tolerance * max(1.0, np.trace(gram)):
            break
        tried = []
        for damping, size in STEPS:
            damped = gram + (weight + damping * max(np.trace(gram) / k, 1e-12)) * np.eye(k)
            tried.append(moves + size * np.linalg.lstsq(damped, away, rcond=1e-12)[0] / scale)
        ends = measured_(tried)
        best = int(np.argmin([cost(e) for e in ends]))
        if cost(ends[best]) >= cost(now) * (1 - 1e-4):
            break
        moves, now = tried[best], ends[best]
    return rate_of(moves), now[0]


def mix(docs: DataFrame, labelled: DataFrame, *, targets: Mapping[str, float] = TARGETS, total: float = TOTAL, sample: int = SAMPLE, slots: int = SLOTS, ridge: float = RIDGE, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, text_hash, n_tokens, p_<domain>, rate and copies for every row of ``docs``.

    ``target_<domain>`` and ``reached_<domain>`` tell the tokens that are asked for and those the rates give.
    """
    domains = sorted(targets)
    drawn = common.materialize(draw(labelled.filter(F.col("domain").isin(*domains)), sample), "drawn")
    soft = common.materialize(posteriors(docs, learn(docs, drawn, domains, slots=slots)), "soft")
    common.release(drawn)
    size = soft.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n")).first()["n"]
    shares = np.array([targets[d] for d in domains], float)
    wanted = shares / shares.sum() * total * size
    rate, reached = fit(soft, wanted, rounds=rounds, ridge=ridge)
    drawn_ = F.pmod(F.xxhash64("doc_id", "text_hash", F.lit("copies")), F.lit(1 << 30)) / float(1 << 30)
    shown = soft.select("doc_id", "text_hash", "n_tokens", *[F.col(f"p{i}").alias(f"p_{d}") for i, d in enumerate(domains)], rate.alias("rate"))
    shown = shown.withColumn("copies", (F.floor("rate") + (drawn_ < F.col("rate") - F.floor("rate")).cast("long")).cast("int"))
    return shown.select("*", *[F.lit(float(x)).alias(f"{name}_{d}") for name, xs in (("target", wanted), ("reached", reached)) for d, x in zip(domains, xs, strict=True)])


def apply(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """The rows of ``docs``, each as often as ``mixed`` has copies of it, with the columns of ``docs``."""
    id_, hash_, own, copies, copy = common.fresh(docs.columns, "_id", "_hash", "_own", "_copies", "_copy")
    times = mixed.select(F.col("doc_id").alias(id_), F.col("text_hash").alias(hash_), F.col("copies").alias(copies)).dropDuplicates([id_, hash_]).filter(F.col(copies) > 0)
    kept = docs.withColumn(own, F.xxhash64("text")).join(times, F.col("doc_id").cast("long").eqNullSafe(F.col(id_)) & (F.col(own) == F.col(hash_)))
    return kept.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*[F.col(f"`{c}`") for c in docs.columns])
