"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word enters as two vectors: an embedding of the word (hashed) and the scaled sum of embeddings
of its character n-grams (hashed, with marks at both ends, so prefixes and suffixes are told
apart). A gated recurrent pass in each direction gives every word a state. Windows of ``WINDOW``
words start at every word of a text (a shorter text is one window); the states of a window's words
are pooled by attention and a logistic unit scores the window. As attention weights and scores belong to words, sums
over all overlapping windows are differences of running sums, and a text costs one pass however
its windows overlap. A text's score is a logistic function of its best window and of the logarithm
of its number of windows, fitted on whole documents that the network didn't see.

The passes read a text in runs of ``RUN`` words, each after ``LEAD`` words before it and behind it that
only warm the state up. So a text of any length is read whole in bounded steps, and words in
front of a text hardly move the scores of its windows.

Training draws exactly ``PER_CLASS`` labelled documents of each class (or all, if there are fewer) in
order of a hash of the id, and reads all of their text on the executors: log-odds of words and
n-grams over whole texts start the first coordinate of both tables, every window of a drawn text is
ranked by them, and ``BEST`` windows and ``ANY`` from hashed places are sent to the driver with ``LEAD``
words on either side. So the driver holds 2 * PER_CLASS * (BEST + ANY) * (WINDOW + 2 * LEAD)
words at most, whatever the texts' lengths. In toxic documents the windows that train are chosen
again as the network improves, which suits labels that hold for a document but come from a few
words. One drawn document in five trains nothing; scores of those whole texts, computed on the executors,
fit the last logistic function.

Nulls, empties, ties: a null text is empty; a text without words has one empty window; documents
labelled both ways count as toxic; null labels and null ids teach nothing; of rows with one id, one
teaches; without both classes the score is the share of toxic labels, or 0; repeated rows get
equal scores; very long texts are read to their end, an Arrow batch of texts at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .wordgrams import Grams, number, split

PER_CLASS = 2000
WINDOW, LEAD, RUN = 32, 16, 512
#: Windows of a drawn document that may train: those with the largest log-odds, and any.
BEST, ANY = 5, 3
#: A window is ranked by its words with the largest log-odds, so many.
CUES = 3
SLOTS = 1 << 15
SIZES = (3, 5, 7)
EMBED, HIDDEN = 8, 8
STEPS, BATCH = 500, 64
#: States that are held at a time, about.
HELD = 1 << 19
SEED = 9


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


class Network:
    """The network's weights; input 0 is padding."""

    def __init__(self, rng: np.random.Generator) -> None:
        e, h = EMBED, HIDDEN
        draw = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape).astype(np.float32)
        self.words = rng.normal(0, 0.05, (SLOTS, e)).astype(np.float32)
        self.chars = rng.normal(0, 0.05, (SLOTS, e)).astype(np.float32)
        # per direction: input, recurrent and bias weights of update, reset and candidate
        self.w = [draw(2 * e, 3 * h) for _ in range(2)]
        self.u = [draw(h, 3 * h) for _ in range(2)]
        self.b = [np.zeros(3 * h, np.float32) for _ in range(2)]
        self.attend, self.point = draw(2 * h, h), draw(h)
        self.out, self.bias = draw(2 * h), np.zeros(1, np.float32)
        self.calibration = (1.0, 0.0, 0.0)
        self.constant: float | None = None

    def vectors(self, words: list[bytes]) -> np.ndarray:
        """Inputs of distinct words, after a row of zeros for padding."""
        step = Grams.STEP
        parts = [self._vectors(words[i : i + step]) for i in range(0, len(words), step)]
        return np.concatenate([np.zeros((1, 2 * EMBED), np.float32), *[p[1:] for p in parts]])

    def _vectors(self, words: list[bytes]) -> np.ndarray:
        own, grams = Grams(words, (), SLOTS, whole=True), Grams(words, SIZES, SLOTS)
        x = np.zeros((len(words) + 1, 2 * EMBED), np.float32)
        if words:
            x[1:, :EMBED] = self.words[own.ids]
            x[1:, EMBED:] = grams.means(self.chars)
        return x

    def project(self, x: np.ndarray) -> list[np.ndarray]:
        return [x @ w + b for w, b in zip(self.w, self.b, strict=True)]

    def step(self, d: int, x: np.ndarray, s: np.ndarray, live: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
        """Update, reset, candidate and new state of direction ``d``; a state that isn't live stays."""
        h2 = 2 * HIDDEN
        gates = _sigmoid(x[:, :h2] + s @ self.u[d][:, :h2])
        z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
        if live is not None:
            z = z * live[:, None]
        c = np.tanh(x[:, h2:] + (r * s) @ self.u[d][:, h2:])
        return z, r, c, s + z * (c - s)

    def run(self, projected: list[np.ndarray], ids: np.ndarray, scored: np.ndarray, keep: bool = False):  # type: ignore[no-untyped-def]
        """Logits of spans of inputs (spans, words) with padding behind; ``scored`` marks the window's words."""
        n, t = ids.shape
        h = HIDDEN
        states = np.empty((t, n, 2 * h), projected[0].dtype)
        trace: list = [[None] * t, [None] * t]
        live = (ids > 0).astype(states.dtype)
        for d in range(2):
            s = np.zeros((n, h), states.dtype)
            for i in range(t) if d == 0 else range(t - 1, -1, -1):
                z, r, c, later = self.step(d, projected[d][ids[:, i]], s, live[:, i])
                if keep:
                    trace[d][i] = (s, z, r, c)
                s = states[i, :, d * h : (d + 1) * h] = later
        a = np.tanh(states @ self.attend)
        weight = np.where(scored.T, a @ self.point, -np.inf)
        weight = np.exp(weight - weight.max(axis=0))
        weight /= weight.sum(axis=0)
        context = np.einsum("tn,tnk->nk", weight, states)
        logits = context @ self.out + self.bias
        return (logits, states, trace, a, weight, context) if keep else logits

    def score(self, best: np.ndarray, windows: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(best), self.constant)
        a, b, c = self.calibration
        return _sigmoid(a * best + b * np.log(windows) + c)


def _states(net: Network, projected: list[np.ndarray], x: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """States (words, 2 * HIDDEN) of texts that lie one after another in ``x``, read in runs."""
    first, last, left, right = [], [], [], []
    for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
        cuts = np.arange(a, b, RUN)
        first.append(cuts)
        last.append(np.minimum(cuts + RUN, b))
        left.append(np.maximum(cuts - LEAD, a))
        right.append(np.minimum(last[-1] + LEAD, b))
    first, last, left, right = (np.concatenate([*v, np.empty(0, np.int64)]).astype(np.int64) for v in (first, last, left, right))
    out = np.zeros((len(x) + 1, 2 * HIDDEN), np.float32)  # the last row takes what only warms up
    for d, (begin, stop) in enumerate(((left, last), (first, right))):
        size = stop - begin
        order = np.argsort(-size, kind="stable")
        begin_, stop_, size = begin[order], stop[order], size[order]
        own_first, own_last = first[order], last[order]
        s = np.zeros((len(order), HIDDEN), np.float32)
        active = np.searchsorted(-size, -np.arange(1, (size[0] if len(size) else 0) + 1), side="right")
        for i, n in enumerate(active.tolist()):
            at = begin_[:n] + i if d == 0 else stop_[:n] - 1 - i
            s = net.step(d, projected[d][x[at]], s[:n])[3]
            out[np.where((at >= own_first[:n]) & (at < own_last[:n]), at, len(x)), d * HIDDEN : (d + 1) * HIDDEN] = s
    return out[:-1]


def window_logits(net: Network, projected: list[np.ndarray], texts: list[np.ndarray], window: int = WINDOW) -> Iterator[np.ndarray]:
    """For each text of input numbers, the logits of the windows that start at its words."""
    sizes = np.array([len(t) for t in texts], np.int64)
    cuts = [0, *(np.flatnonzero(np.diff(np.cumsum(sizes) // HELD)) + 1).tolist(), len(texts)]
    for i, j in zip(cuts, cuts[1:], strict=False):
        ends = np.cumsum(sizes[i:j])
        starts = ends - sizes[i:j]
        x = np.concatenate([*texts[i:j], np.empty(0, np.int64)])
        states = _states(net, projected, x, starts, ends)
        weight = np.exp((np.tanh(states @ net.attend) @ net.point).astype(np.float64))
        below = np.concatenate([[0.0], np.cumsum(weight)])
        above = np.concatenate([[0.0], np.cumsum(weight * (states @ net.out))])
        for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
            if a == b:
                yield net.bias.astype(np.float64)
                continue
            w = min(window, b - a)
            yield (above[a + w : b + 1] - above[a : b + 1 - w]) / (below[a + w : b + 1] - below[a : b + 1 - w]) + float(net.bias[0])


def best_windows(net: Network, words: list[bytes], texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Per text the largest logit of its windows and their number."""
    projected = net.project(net.vectors(words))
    found = [(float(x.max()), len(x)) for x in window_logits(net, projected, [t + 1 for t in texts])]
    return np.array([b for b, _ in found]), np.array([n for _, n in found], np.int64)


class _Adagrad:
    def __init__(self, rate: float) -> None:
        self.rate, self.seen = rate, {}

    def step(self, name: str, weights: np.ndarray, grad: np.ndarray, rows: np.ndarray | None = None) -> None:
        s = self.seen.setdefault(name, np.full(weights.shape, 1e-4, np.float32))
        if rows is None:
            s += grad * grad
            weights -= self.rate * grad / np.sqrt(s)
        else:
            s[rows] += grad * grad
            weights[rows] -= self.rate * grad / np.sqrt(s[rows])


def _summed(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct row numbers and the sums of their values."""
    order = np.argsort(rows, kind="stable")
    rows = rows[order]
    first = np.flatnonzero(np.diff(rows, prepend=-1))
    return rows[first], np.add.reduceat(values[order], first, axis=0) if len(first) else values[:0]


def _learn(net: Network, opt: _Adagrad, x: np.ndarray, own: Grams, grams: Grams, ids: np.ndarray, scored: np.ndarray, gold: np.ndarray) -> None:
    """One step of gradient descent on spans ``ids`` of words with inputs ``x``."""
    h, t = HIDDEN, ids.shape[1]
    used, local = np.unique(ids, return_inverse=True)
    local = local.reshape(ids.shape) + (used[0] > 0)
    if used[0] > 0:
        used = np.concatenate([[0], used])
    vectors = x[used]
    logits, states, trace, a, weight, context = net.run(net.project(vectors), local, scored, keep=True)
    d_logit = ((_sigmoid(logits) - gold) / len(gold)).astype(vectors.dtype)
    opt.step("out", net.out, context.T @ d_logit)
    opt.step("bias", net.bias, d_logit.sum(keepdims=True))
    d_context = d_logit[:, None] * net.out
    d_states = weight[:, :, None] * d_context[None]
    d_weight = np.einsum("nk,tnk->tn", d_context, states)
    d_raw = weight * (d_weight - (weight * d_weight).sum(axis=0))
    opt.step("point", net.point, np.einsum("tn,tnh->h", d_raw, a))
    d_a = d_raw[:, :, None] * net.point * (1 - a * a)
    d_states += d_a @ net.attend.T
    opt.step("attend", net.attend, np.einsum("tnk,tnh->kh", states, d_a))
    d_vectors = np.zeros_like(vectors)
    for d in range(2):
        d_u, carry = np.zeros_like(net.u[d]), np.zeros((len(ids), h), vectors.dtype)
        d_in = np.empty((t, len(ids), 3 * h), vectors.dtype)
        for i in range(t - 1, -1, -1) if d == 0 else range(t):
            s, z, r, c = trace[d][i]
            g = d_states[i, :, d * h : (d + 1) * h] + carry
            d_c = g * z * (1 - c * c)
            d_rs = d_c @ net.u[d][:, 2 * h :].T
            d_gates = np.concatenate([g * (c - s) * z * (1 - z), d_rs * s * r * (1 - r)], axis=1)
            carry = g * (1 - z) + d_rs * r + d_gates @ net.u[d][:, : 2 * h].T
            d_u[:, : 2 * h] += s.T @ d_gates
            d_u[:, 2 * h :] += (r * s).T @ d_c
            d_in[i] = np.concatenate([d_gates, d_c], axis=1)
        d_in[local.T == 0] = 0  # behind a span nothing is read
        rows, sums = _summed(local.T.ravel(), d_in.reshape(-1, 3 * h))
        d_x = np.zeros((len(used), 3 * h), vectors.dtype)
        d_x[rows] = sums
        d_vectors += d_x @ net.w[d].T
        opt.step(f"w{d}", net.w[d], vectors.T @ d_x)
        opt.step(f"u{d}", net.u[d], d_u)
        opt.step(f"b{d}", net.b[d], d_x.sum(axis=0))
    words, d_vectors = used[1:] - 1, d_vectors[1:]
    rows, grad = _summed(own.ids[words], d_vectors[:, :EMBED])
    opt.step("words", net.words, grad, rows)
    slots, place = grams.of(words)
    rows, grad = _summed(slots, (d_vectors[:, EMBED:] / np.sqrt(np.maximum(grams.counts[words], 1))[:, None])[place])
    opt.step("chars", net.chars, grad, rows)


class Span:
    """A window of a document with the words around it: all words, and the window's first and last."""

    __slots__ = ("words", "first", "last")

    def __init__(self, words: list[bytes], first: int, last: int) -> None:
        self.words, self.first, self.last = words, first, last


def span(words: list[bytes], start: int) -> Span:
    a, b = max(0, start - LEAD), min(len(words), start + WINDOW)
    return Span(words[a : b + LEAD], start - a, b - a)


def train(docs: list[list[Span]], toxic: list[int], odds: tuple[np.ndarray, np.ndarray] | None = None, *, steps: int = STEPS, seed: int = SEED) -> Network:
    """Fit a network to the spans of documents, the likeliest first, and the documents' labels."""
    rng = np.random.default_rng(seed)
    net = Network(rng)
    y = np.array(toxic, np.float32)
    if len(set(toxic)) < 2:
        net.constant = float(y.mean()) if len(y) else 0.0
        return net
    if odds:
        net.words[:, 0], net.chars[:, 0] = odds
    words, at = number([s.words for d in docs for s in d])
    spans = [s for d in docs for s in d]
    widest = WINDOW + 2 * LEAD
    ids = np.zeros((len(spans), widest), np.int32)
    scored = np.zeros((len(spans), widest), bool)
    for k, (s, x) in enumerate(zip(spans, at, strict=True)):
        ids[k, : len(x)] = x + 1
        scored[k, s.first : max(s.last, s.first + 1)] = True
    ends = np.cumsum([len(d) for d in docs])
    of = [np.arange(e - len(d), e) for e, d in zip(ends, docs, strict=True)]
    own, grams = Grams(words, (), SLOTS, whole=True), Grams(words, SIZES, SLOTS)
    opt = _Adagrad(0.05)
    x = net.vectors(words)
    pools = [np.flatnonzero(y == k) for k in (0, 1)]
    hardest = np.array([o[0] for o in of])
    for round_ in range(4):
        if round_:
            projected = net.project(net.vectors(words))
            logits = np.concatenate([net.run(projected, ids[k : k + 4096], scored[k : k + 4096]) for k in range(0, len(ids), 4096)])
            hardest = np.array([o[int(logits[o].argmax())] for o in of])
        for _ in range(steps // 4):
            drawn = np.concatenate([pool[rng.integers(len(pool), size=BATCH // 2)] for pool in pools])
            chosen = hardest[drawn]
            # a clean document is clean everywhere
            for b in range(0, BATCH // 2, 2):
                chosen[b] = of[drawn[b]][int(rng.integers(len(of[drawn[b]])))]
            batch = ids[chosen]
            used = np.unique(batch[batch > 0]) - 1
            x[used + 1, :EMBED] = net.words[own.ids[used]]
            slots, place = grams.of(used)
            if len(place):
                rows, sums = _summed(place, net.chars[slots])
                x[used[rows] + 1, EMBED:] = sums / np.sqrt(grams.counts[used[rows]])[:, None]
            _learn(net, opt, x, own, grams, batch, scored[chosen], y[drawn])
    return net


def calibrate(net: Network, best: np.ndarray, windows: np.ndarray, toxic: np.ndarray) -> None:
    """Fit the last logistic function to whole documents that trained nothing."""
    if net.constant is None and len(set(toxic.tolist())) == 2:
        net.calibration = _logistic(best.astype(float), np.log(windows), toxic)


def _logistic(best: np.ndarray, size: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Newton steps for a regularised logistic fit, both classes weighing the same."""
    x = np.stack([best, size, np.ones(len(y))], axis=1)
    weight = np.where(y > 0, 0.5 / (y > 0).sum(), 0.5 / (y == 0).sum()) * len(y)
    theta = np.array([1.0, 0.0, 0.0])
    pull = np.array([2.0, 5.0, 0.05])
    for _ in range(30):
        p = _sigmoid(x @ theta)
        grad = x.T @ (weight * (p - y)) + pull * (theta - [1, 0, 0])
        step = np.linalg.solve((x * (weight * np.maximum(p * (1 - p), 1e-3))[:, None]).T @ x + np.diag(pull), grad)
        theta = theta - step * min(1.0, 1.0 / max(np.abs(step).max(), 1e-9))
    return float(max(theta[0], 0.05)), float(theta[1]), float(theta[2])


def sample(docs: DataFrame, labels: DataFrame, *, per_class: int = PER_CLASS) -> DataFrame:
    """doc_id, toxic, later and text of the documents that teach, at most ``per_class`` of a class.

    ``later`` marks the fifth that calibrates. Documents that are held out are never drawn.
    """
    marks = labels.filter("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    marks = marks.filter(~common.held_out(F.col("doc_id")))
    draw = F.xxhash64("doc_id", F.lit("toxicity"))
    one, two = (marks.filter(F.col("toxic") == k).orderBy(draw, "doc_id").limit(per_class) for k in (0, 1))
    picked = one.unionByName(two)  # so many short rows at most
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(picked), "doc_id")
    rows = rows.groupBy("doc_id", "toxic").agg(F.min_by(F.coalesce("text", F.lit("")), F.xxhash64("text")).alias("text"))
    return rows.withColumn("later", F.pmod(F.xxhash64("doc_id", F.lit("calibration")), F.lit(5)) == 0)


def _slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each document the distinct slots of its words (table 0) and of their n-grams (table 1)."""
    for batch in common.rows_of(batches):
        words, at = number([split(t) for t in batch["text"].to_pylist()])
        own, grams = Grams(words, (), SLOTS, whole=True), Grams(words, SIZES, SLOTS)
        counts = np.zeros((2, 2, SLOTS), np.int32)
        for x, toxic in zip(at, batch["toxic"].to_pylist(), strict=True):
            x = np.unique(x)
            for table, features in enumerate((own, grams)):
                counts[table, toxic][np.unique(features.of(x)[0])] += 1
        table, slot = np.nonzero(counts.sum(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(table.astype(np.int32)), pa.array(slot.astype(np.int32)), *[pa.array(counts[table, k, slot].astype(np.int64)) for k in (0, 1)]], ["kind", "slot", "clean", "toxic"])


def log_odds(drawn: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds of the classes by slot of both tables, from all words of the drawn documents."""
    fit = drawn.filter("not later")
    sizes = {r["toxic"]: r["n"] for r in fit.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    rows = fit.select("text", "toxic").mapInArrow(_slots, "kind int, slot int, clean long, toxic long")
    found = rows.groupBy("kind", "slot").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).toArrow()  # two tables of SLOTS rows at most
    kind, slot, clean, toxic = (found[c].to_numpy() for c in ("kind", "slot", "clean", "toxic"))
    odds = np.log((toxic + 0.5) / (sizes.get(1, 0) + 1)) - np.log((clean + 0.5) / (sizes.get(0, 0) + 1))
    # what few documents show says little
    odds = np.clip(odds * ((clean + toxic) / (clean + toxic + 4)), -3, 3)
    out = np.zeros((2, SLOTS), np.float32)
    out[kind, slot] = odds
    return out[0], out[1]


def _ranked(values: np.ndarray) -> np.ndarray:
    """What each window of a text says at first sight, from its words' log-odds."""
    if len(values) <= WINDOW:
        return np.sort(values)[-CUES:].sum(keepdims=True)
    wide, step = sliding_window_view(values, WINDOW), 65_536
    return np.concatenate([np.partition(wide[i : i + step], WINDOW - CUES, axis=1)[:, -CUES:].sum(axis=1) for i in range(0, len(wide), step)])


def starts_of(values: np.ndarray, seed: int) -> list[int]:
    """The windows of one document that are sent: apart from each other, best first, then any."""
    rank, out = _ranked(values), []
    n = len(rank)
    for _ in range(BEST):
        i = int(rank.argmax())
        if out and not np.isfinite(rank[i]):
            break
        out.append(i)
        rank[max(0, i - WINDOW + 1) : i + WINDOW] = -np.inf
    rng = np.random.default_rng(seed)
    return out + [int(rng.integers(n)) for _ in range(ANY if n > 1 else 0)]


def _spans(batches: Iterator[pa.RecordBatch], odds: tuple[np.ndarray, np.ndarray]) -> Iterator[pa.RecordBatch]:
    for batch in common.rows_of(batches):
        words, at = number([split(t) for t in batch["text"].to_pylist()])
        own, grams = Grams(words, (), SLOTS, whole=True), Grams(words, SIZES, SLOTS)
        value = odds[0][own.ids] + grams.means(odds[1][:, None])[:, 0] if words else np.zeros(0, np.float32)
        rows = []
        for doc_id, toxic, x in zip(batch["doc_id"].to_pylist(), batch["toxic"].to_pylist(), at, strict=True):
            for k, start in enumerate(starts_of(value[x], doc_id & 0xFFFFFFFF) if len(x) else [0]):
                a, b = max(0, start - LEAD), min(len(x), start + WINDOW)
                rows.append((doc_id, toxic, k, b" ".join(words[i] for i in x[a : b + LEAD]), start - a, b - a))
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int32(), pa.int32()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "toxic", "k", "words", "first", "last"])


def fit(docs: DataFrame, labels: DataFrame, *, per_class: int = PER_CLASS) -> Network:
    """A network that learned from labelled documents."""
    drawn = common.materialize(sample(docs, labels, per_class=per_class), "toxic")
    odds = log_odds(drawn)
    spans = drawn.filter("not later").select("doc_id", "toxic", "text").mapInArrow(lambda it: _spans(it, odds), "doc_id long, toxic int, k int, words binary, first int, last int")
    found = spans.toArrow().sort_by([("doc_id", "ascending"), ("k", "ascending")])
    held: dict[int, list[Span]] = {}
    toxic: dict[int, int] = {}
    for doc_id, mark, words, first, last in zip(*[found[c].to_pylist() for c in ("doc_id", "toxic", "words", "first", "last")], strict=True):
        held.setdefault(doc_id, []).append(Span(words.split(), first, last))
        toxic[doc_id] = mark
    net = train(list(held.values()), list(toxic.values()), odds)
    if net.constant is None:
        sent = docs.sparkSession.sparkContext.broadcast(net)
        judged = drawn.filter("later").select("doc_id", "text", "toxic").mapInArrow(lambda it: _best(it, sent), "doc_id long, toxic int, best double, windows long").toArrow().sort_by("doc_id")
        calibrate(net, *[judged[c].to_numpy() for c in ("best", "windows", "toxic")])
    common.release(drawn)
    return net


def _judged(batches: Iterator[pa.RecordBatch], sent) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:  # type: ignore[no-untyped-def]
    net: Network = sent.value
    for batch in common.rows_of(batches):
        words, at = number([split(t) for t in batch["text"].to_pylist()])
        yield batch, *best_windows(net, words, at)


def _best(batches: Iterator[pa.RecordBatch], sent) -> Iterator[pa.RecordBatch]:  # type: ignore[no-untyped-def]
    for batch, best, n in _judged(batches, sent):
        yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["toxic"], pa.array(best, pa.float64()), pa.array(n, pa.int64())], ["doc_id", "toxic", "best", "windows"])


def _scored(batches: Iterator[pa.RecordBatch], sent) -> Iterator[pa.RecordBatch]:  # type: ignore[no-untyped-def]
    for batch, best, n in _judged(batches, sent):
        yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(sent.value.score(best, n).astype(float), pa.float64())], ["doc_id", "score"])


def score(docs: DataFrame, net: Network) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of ``docs`` (doc_id, text)."""
    sent = docs.sparkSession.sparkContext.broadcast(net)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lambda it: _scored(it, sent), "doc_id long, score double")
    return rows.select("doc_id", common.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, fit(docs, labels))
