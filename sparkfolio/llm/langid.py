"""Language identification by a linear-chain conditional random field over words.

A word's features are its affixes and character n-grams (hashed, with marks at both ends) and the
word itself (lexicon); transitions between the labels of neighbouring words are learned. Training
sequences are spliced from windows of documents of different languages, so the field learns to
switch inside a text. A whole text is labelled by forward-backward; its language is the label with
the largest expected number of words, and the score is that share.

Training draws at most ``PER_LANGUAGE`` documents of each language in order of a hash of the id, of the ``LANGUAGES``
languages that have most labelled documents, so neither dirty labels nor many rows let the sample or the weights grow. The
executors read their whole texts and send up to ``SPANS`` spans of ``SPAN`` words from hashed places
anywhere in each, so the driver holds that many words at most, whatever the texts' lengths. The
weights are one table of ``SLOTS`` rows, sent to the executors. A text of more than ``CELLS`` words is
labelled by blocks that hand their forward states on, which gives the same posteriors
in bounded memory.

Nulls, empties, ties: null texts and texts without a letter are ``und`` with score 0; documents
with a null id or language teach nothing but are labelled; rows equal in id, language and text teach once; a tie goes to the language first in
order; without any language to learn from, all is ``und``; repeated rows get equal answers.
"""

from __future__ import annotations

import random
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .wordgrams import Grams, number, split

PER_LANGUAGE = 800
#: Languages that are learned at most; the weights take 256 KB for each.
LANGUAGES = 64
SPANS, SPAN = 12, 30
SLOTS = 1 << 16
SIZES = (1, 2, 3, 4)
STEPS = 300
BATCH, LENGTH = 32, 40
SEED = 71
#: Words times documents that are labelled at once.
CELLS = 200_000
#: Words of a very long text that are held at once.
STRETCH = 4096


class Field:
    """Weights of the field: a row per feature slot, transitions and start scores."""

    def __init__(self, labels: list[str], slots: int = SLOTS, sizes: tuple[int, ...] = SIZES) -> None:
        k = len(labels)
        self.labels, self.slots, self.sizes = labels, slots, sizes
        self.features = np.zeros((slots, k), np.float32)
        self.moves = np.zeros((k, k), np.float64)
        self.start = np.zeros(k, np.float64)

    def grams(self, words: list[bytes]) -> Grams:
        return Grams(words, self.sizes, self.slots, whole=True)

    def emissions(self, words: list[bytes], grams: Grams | None = None) -> np.ndarray:
        """Scores of distinct words; a word without a letter says nothing."""
        out = (grams or self.grams(words)).sums(self.features).astype(np.float64)
        silent = [i for i, w in enumerate(words) if not any(map(str.isalpha, w.decode("utf-8", "replace")))]
        out[silent] = 0
        return out

    def marginals(self, scores: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Posterior label shares (texts, words, labels) by forward-backward, and expected moves."""
        n, t, k = scores.shape
        e = np.exp(scores - scores.max(axis=2, keepdims=True))
        a = np.exp(self.moves - self.moves.max())
        start = np.exp(self.start - self.start.max())
        live = np.arange(t)[None, :] < lengths[:, None]
        e[~live] = 1.0
        ahead = np.empty_like(e)
        ahead[:, 0] = start * e[:, 0]
        ahead[:, 0] /= ahead[:, 0].sum(axis=1, keepdims=True)
        for i in range(1, t):
            x = (ahead[:, i - 1] @ a) * e[:, i]
            ahead[:, i] = x / x.sum(axis=1, keepdims=True)
        back = np.ones((n, k))
        share = np.empty_like(e)
        moves = np.zeros((k, k))
        ends = lengths - 1
        for i in range(t - 1, -1, -1):
            back[ends == i] = 1.0
            x = ahead[:, i] * back
            share[:, i] = x / x.sum(axis=1, keepdims=True)
            if i:
                y = e[:, i] * back
                pair = ahead[:, i - 1][:, :, None] * a[None] * y[:, None, :]
                on = live[:, i]
                if on.any():
                    moves += (pair[on] / pair[on].sum(axis=(1, 2), keepdims=True)).sum(axis=0)
                back = y @ a.T
                back /= back.sum(axis=1, keepdims=True)
        share[~live] = 0
        return share, moves

    def shares(self, scores: np.ndarray, texts: list[np.ndarray]) -> list[np.ndarray]:
        """Expected label shares of whole texts of word numbers, from the words' scores."""
        out: list[np.ndarray] = [np.zeros(len(self.labels))] * len(texts)
        order = sorted((i for i in range(len(texts)) if len(texts[i])), key=lambda i: len(texts[i]))
        while order and len(texts[order[-1]]) > CELLS:
            i = order.pop()
            out[i] = self._long(scores, texts[i]) / len(texts[i])
        while order:
            longest = len(texts[order[-1]])
            at, order = order[-max(1, CELLS // longest) :], order[: -max(1, CELLS // longest)]
            lengths = np.array([len(texts[i]) for i in at])
            block = np.zeros((len(at), longest, len(self.labels)))
            for j, i in enumerate(at):
                block[j, : lengths[j]] = scores[texts[i]]
            total = self._shares(block, lengths)
            for j, i in enumerate(at):
                out[i] = total[j] / lengths[j]
        return out

    def _long(self, scores: np.ndarray, text: np.ndarray) -> np.ndarray:
        """Sums of posteriors of one text; only the forward states at the ends of blocks are kept."""
        a = np.exp(self.moves - self.moves.max())
        cuts = range(0, len(text), STRETCH)

        def ahead(cut: int, before: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
            e = scores[text[cut : cut + STRETCH]]
            e = np.exp(e - e.max(axis=1, keepdims=True))
            states = np.empty_like(e)
            for i in range(len(e)):
                x = (np.exp(self.start - self.start.max()) if before is None else before @ a) * e[i]
                before = states[i] = x / x.sum()
            return e, states

        ends: list[np.ndarray | None] = [None]
        for cut in cuts:
            ends.append(ahead(cut, ends[-1])[1][-1])
        back, total = np.ones(len(self.labels)), np.zeros(len(self.labels))
        for k in range(len(cuts) - 1, -1, -1):
            e, states = ahead(cuts[k], ends[k])
            for i in range(len(e) - 1, -1, -1):
                x = states[i] * back
                total += x / x.sum()
                back = a @ (e[i] * back)
                back /= back.sum()
        return total

    def _shares(self, scores: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Sums of posteriors over words; like ``marginals`` without the moves."""
        scores = np.ascontiguousarray(scores.transpose(1, 0, 2))
        t, n, k = scores.shape
        e = np.exp(scores - scores.max(axis=2, keepdims=True))
        a = np.exp(self.moves - self.moves.max())
        ahead = e  # row i is replaced once it has been read
        x = np.exp(self.start - self.start.max()) * e[0]
        kept = e.copy()
        ahead[0] = x / x.sum(axis=1, keepdims=True)
        for i in range(1, t):
            x = (ahead[i - 1] @ a) * kept[i]
            ahead[i] = x / x.sum(axis=1, keepdims=True)
        back, total, ends = np.ones((n, k)), np.zeros((n, k)), lengths - 1
        shortest = ends.min()
        for i in range(t - 1, -1, -1):
            if i >= shortest:
                back[ends == i] = 1.0
            x = ahead[i] * back
            x /= x.sum(axis=1, keepdims=True)
            if i > shortest:
                x[ends < i] = 0
            total += x
            if i:
                back = (kept[i] * back) @ a.T
                back /= back.sum(axis=1, keepdims=True)
        return total


def train(texts: dict[str, list[list[bytes]]], *, steps: int = STEPS, seed: int = SEED, slots: int = SLOTS) -> Field:
    """Fit a field to word lists by language, by Adagrad on the log-likelihood of spliced sequences."""
    labels = sorted(k for k, v in texts.items() if any(v))
    field = Field(labels, slots)
    if not labels:
        return field
    flat = [(y, words) for y, k in enumerate(labels) for words in texts[k] if words]
    words, at = number([w for _, w in flat])
    grams = field.grams(words)
    by = [[x for x, (y, _) in zip(at, flat, strict=True) if y == k] for k in range(len(labels))]
    rng = random.Random(seed)
    k = len(labels)
    seen = [np.full_like(x, 1e-6, dtype=np.float64) for x in (field.features, field.moves, field.start)]
    for _ in range(steps):
        ids, gold = np.empty((BATCH, LENGTH), np.int64), np.empty((BATCH, LENGTH), np.int64)
        for b in range(BATCH):
            n = 0
            while n < LENGTH:
                y = rng.randrange(k)
                own = by[y][rng.randrange(len(by[y]))]
                size = min(rng.randrange(3, 30), LENGTH - n, len(own))
                first = rng.randrange(len(own) - size + 1)
                ids[b, n : n + size], gold[b, n : n + size] = own[first : first + size], y
                n += size
        slot, place = grams.of(ids.ravel())
        scores = np.zeros((BATCH * LENGTH, k))
        for y in range(k):
            scores[:, y] = np.bincount(place, field.features[slot, y], BATCH * LENGTH)
        share, moves = field.marginals(scores.reshape(BATCH, LENGTH, k), np.full(BATCH, LENGTH))
        off = share.reshape(-1, k).copy()
        off[np.arange(len(off)), gold.ravel()] -= 1
        np.add.at(moves, (gold[:, :-1].ravel(), gold[:, 1:].ravel()), -1.0)
        first = share[:, 0].sum(axis=0) - np.bincount(gold[:, 0], minlength=k)
        used, inverse = np.unique(slot, return_inverse=True)
        grad = np.stack([np.bincount(inverse, off[place, y], len(used)) for y in range(k)], axis=1) / BATCH
        seen[0][used] += grad**2
        field.features[used] -= 0.1 * grad / np.sqrt(seen[0][used])
        for weights, g, s in ((field.moves, moves / BATCH, seen[1]), (field.start, first / BATCH, seen[2])):
            s += g**2
            weights -= 0.1 * g / np.sqrt(s)
    return field


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in common.rows_of(batches):
        kept = []
        for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
            words = split(text)
            most = max(1, len(words) - SPAN + 1)
            starts = sorted({zlib.crc32(f"{doc_id}:{k}".encode()) % most for k in range(min(SPANS, 1 + len(words) // SPAN))})
            kept.append([b" ".join(words[a : a + SPAN]) for a in starts])
        yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["lang"], batch["text_hash"], pa.array(kept, pa.list_(pa.binary()))], ["doc_id", "lang", "text_hash", "spans"])


def sample(docs: DataFrame, *, per_language: int = PER_LANGUAGE, languages: int = LANGUAGES) -> dict[str, list[list[bytes]]]:
    """Bounded training spans by language, from documents that are not held out."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text", F.xxhash64("text").alias("text_hash"))
    rows = rows.filter(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~common.held_out(F.col("doc_id")))
    most = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(languages)
    sizes = {r["lang"]: r["n"] for r in most.collect()}
    if not sizes:
        return {}
    draw, some = F.pmod(F.xxhash64("doc_id", F.lit("langid")), F.lit(1 << 30)), F.lit(False)
    for lang, n in sorted(sizes.items()):  # about twice as many as are needed, before any row moves
        some = some | ((F.col("lang") == lang) & (draw < int(min(1.0, (2 * per_language + 100) / n) * (1 << 30))))
    key = ["doc_id", "lang", "text_hash"]
    first = Window.partitionBy("lang").orderBy(draw, "doc_id", "text_hash")
    picked = rows.filter(some).select(*key).distinct().withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= per_language)
    spans = rows.join(F.broadcast(picked.select(*key)), key).select(*key, "text").mapInArrow(_spans, "doc_id long, lang string, text_hash long, spans array<binary>")
    out: dict[str, list[list[bytes]]] = {}
    found = spans.groupBy(*key).agg(F.first("spans").alias("spans")).toArrow().sort_by([(k, "ascending") for k in key])
    for lang, parts in zip(found["lang"].to_pylist(), found["spans"].to_pylist(), strict=True):
        out.setdefault(lang, []).extend(p.split() for p in parts if p)
    return out


def _label(batches: Iterator[pa.RecordBatch], sent) -> Iterator[pa.RecordBatch]:  # type: ignore[no-untyped-def]
    field: Field = sent.value
    for batch in common.rows_of(batches, 2 << 20):
        texts = batch["text"].to_pylist()
        spoken = [bool(field.labels) and text is not None and any(map(str.isalpha, text)) for text in texts]
        words, at = number([split(t) if s else [] for t, s in zip(texts, spoken, strict=True)])
        scores = field.emissions(words)
        found = field.shares(scores, at)
        lang = [field.labels[int(f.argmax())] if s else "und" for s, f in zip(spoken, found, strict=True)]
        score = [min(1.0, float(f.max())) if s else 0.0 for s, f in zip(spoken, found, strict=True)]
        yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(lang, pa.string()), pa.array(score, pa.float64()), batch["text_hash"]], ["doc_id", "lang_pred", "score", "text_hash"])


def identify(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score and text_hash for every row of ``docs`` (doc_id, text, and lang to learn from)."""
    if field is None:
        field = train(sample(docs))
    sent = docs.sparkSession.sparkContext.broadcast(field)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    out = rows.mapInArrow(lambda it: _label(it, sent), "doc_id long, lang_pred string, score double, text_hash long")
    return out.select("doc_id", common.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "text_hash")
