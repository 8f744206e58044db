"""Quality rules on how well public tokenisers fit a text, with bands per language and script.

Measured on whole texts: characters per token and byte-fallback share of a sentence-piece
vocabulary, characters per token of a byte-level one, and the entropy of the token histogram in
bits. Natural texts of one language and length give close values; a text far outside is rejected.
A band is per group (language if a column names it, and main script) and per octave of the token
count, since entropy grows with length: median plus or minus ``spread`` times the distance from
the median to the quartile on that side, at least ``slack`` of the measure; above it ``spread_above`` and
``slack_above``, which are wider, as few characters a token and little entropy are what junk shows.

Quartiles come from histograms: values of all documents are rounded to ``STEPS`` and counted by group, octave and
step, which is exact however rows are partitioned and takes memory by the number of steps. Wider groups add these
small histograms up: those of a script in an octave, and those of a script in all octaves, where the entropy
is taken less the script's slope by octave. A group of n documents has quartiles of its own with weight n and
those of its script in its octave with weight ``pull``, which in turn are drawn to those of the script in all octaves, so
a verdict moves smoothly with the size of a group and none is too small for one. Scripts aren't compared with one another, as
how a vocabulary covers a script says nothing of a text: a text alone in its script is kept.

Bands are counted and, up to ``BROADCAST_BANDS`` of them, broadcast to the documents, so a group of any
size moves no row; more are joined under ``SALTS`` copies of each, which splits hot groups.

Base rules are exact: fewer than ``min_words`` words, or more than ``max_repeat`` percent of words
in 8-word windows found twice or more, fail a text outright.

Nulls, empties, ties: a null text counts as empty, has no words and fails the base rules; a null
language forms its own group; repeated rows and null ids are judged one by one.
"""

from __future__ import annotations

import functools
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, tokens
from .minhash import _ODD

PIECES = public_tokenizers.path("piece_bpe_32k.model")
WINDOW = 8
SYMBOLS = "#*$%&|<>"
MEASURES = ("piece_chars", "byte_share", "bpe_chars", "entropy")
#: Values are rounded to these before they are counted.
STEPS = {"piece_chars": 0.005, "byte_share": 0.002, "bpe_chars": 0.005, "entropy": 0.01}
#: Bands are rows of about 150 bytes.
BROADCAST_BANDS, SALTS = 50_000, 16
SCHEMA = "script string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_tokens long, piece_chars double, byte_share double, bpe_chars double, entropy double"
#: Bytes of text measured together: more take more memory at once, fewer look words up more often.
BATCH = 2 << 20
_SPACE = " \t\n\x0b\x0c\r"


class Pieces(dict):
    """Sentence-piece ids of words as 32-bit bytes; words that come again are remembered up to a bound, and as many of the time before."""

    def __init__(self, path: str) -> None:
        super().__init__()
        self._model = sentencepiece.SentencePieceProcessor(model_file=path)
        self._before: dict[str, bytes] = {}
        self.is_byte = np.array([self._model.is_byte(i) for i in range(self._model.get_piece_size())])

    def of(self, words: list[str], again: list[bool]) -> list[bytes]:
        """The ids of each word; those not known are encoded in one call, and remembered if they stand in the texts ``again``."""
        out = list(map(self.get, words))
        new = []
        for i in [i for i, ids in enumerate(out) if ids is None]:
            out[i] = self._before.get(words[i])
            if out[i] is None:
                new.append(i)
            else:
                self._remember(words[i], out[i])
        if new:
            found = self._model.encode([words[i] for i in new], num_threads=1)
            for i, ids in zip(new, found, strict=True):
                out[i] = array("I", ids).tobytes()
                if again[i] and len(words[i]) <= tokens.LONGEST:
                    self._remember(words[i], out[i])
        return out

    def _remember(self, word: str, ids: bytes) -> None:
        if len(self) >= tokens.FEWER:
            self._before = dict(self)
            self.clear()
        self[word] = ids


@functools.cache
def pieces(path: str) -> Pieces:
    return Pieces(path)


@functools.cache
def _script(char: str) -> str:
    return unicodedata.name(char, "?").split()[0].split("-")[0] if char.isalpha() else ""


def script_of(text: str) -> str:
    """First word of the Unicode name that most letters share, such as LATIN; none without letters."""
    if text.isascii():
        return "LATIN" if any(map(str.isalpha, set(text))) else ""
    points, counts = np.unique(np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32), return_counts=True)
    found: dict[str, int] = {}
    for p, n in zip(points.tolist(), counts.tolist(), strict=True):
        if s := _script(chr(p)):
            found[s] = found.get(s, 0) + n
    return min(found, key=lambda s: (-found[s], s)) if found else ""


def repeated_words(h: np.ndarray, window: int = WINDOW) -> int:
    """Words that lie in a window of ``window`` words found twice or more, from the words' hashes."""
    n = len(h) - window + 1
    if n < 2:
        return 0
    out = np.zeros(n, np.uint64)
    for i in range(window):
        out = out * _ODD + h[i : n + i]
    ordered = np.sort(out)
    if not (ordered[1:] == ordered[:-1]).any():
        return 0
    _, at, counts = np.unique(out, return_inverse=True, return_counts=True)
    twice = np.flatnonzero(counts[at] > 1)
    edge = np.zeros(len(h) + 1, np.int64)
    np.add.at(edge, twice, 1)
    np.add.at(edge, twice + window, -1)
    return int((np.cumsum(edge) > 0).sum())


def duplicate_lines(text: str) -> int:
    seen: set[str] = set()
    again = 0
    for line in text.split("\n"):
        if line.strip(_SPACE):
            again += line in seen
            seen.add(line)
    return again


def _words(parts: list[str]) -> tuple[list[str], np.ndarray]:
    """The words of texts' parts one after another, and how many each part has."""
    words: list[str] = []
    sizes, done = np.ones(len(parts), np.int64), 0
    for i in [i for i, p in enumerate(parts) if not p or not p.isprintable()]:
        several = [w.decode() for w in parts[i].encode().split()]
        words += parts[done:i] + several
        sizes[i], done = len(several), i + 1
    return words + parts[done:], sizes


def measures(texts: list[str], piece_ids: Pieces, encoder: tokens.Encoder) -> list[tuple]:
    """Each text's values in the order of ``SCHEMA``; what is known by word is found once for each different one."""
    cut = tokens.Cut.of(texts)
    words, sizes = _words(cut.parts)
    at, each = tokens.gathered(np.arange(len(words)), sizes, cut.at)
    ends = np.concatenate([[0], np.cumsum(cut.sums(each))])
    hashes = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)[at]  # these never leave the process
    found = piece_ids.of(words, (np.bincount(at, minlength=len(words)) > 1).tolist())
    ids, each = tokens.gathered(np.frombuffer(b"".join(found), np.uint32), tokens.sizes_of(found), at)
    stops = np.concatenate([[0], np.cumsum(each)])[ends].tolist()
    ends = ends.tolist()
    bpe = encoder.sizes(texts, cut).tolist()
    is_byte = piece_ids.is_byte[ids]
    rows = []
    for i, text in enumerate(texts):
        chars = len(text) - sum(map(text.count, _SPACE))
        own = ids[stops[i] : stops[i + 1]]
        n = len(own)
        shown = (None,) * 4
        if n:
            counts = np.bincount(own) if n > 4096 else np.unique(own, return_counts=True)[1]
            share = counts[counts > 0] / n
            shown = (chars / n, float(is_byte[stops[i] : stops[i + 1]].mean()), chars / bpe[i], float(-(share * np.log2(share)).sum()))
        rows.append((script_of(text), ends[i + 1] - ends[i], chars, sum(map(text.count, SYMBOLS)), duplicate_lines(text), repeated_words(hashes[ends[i] : ends[i + 1]]), n, *shown))
    return rows


def _measured(batches: Iterator[pa.RecordBatch], piece_file: str, vocabulary: str) -> Iterator[pa.RecordBatch]:
    piece_ids, encoder = pieces(piece_file), tokens.encoder(vocabulary, sparing=True)
    kinds = [pa.string(), *[pa.int64()] * 6, *[pa.float64()] * 4]
    names = [part.split()[0] for part in SCHEMA.split(", ")]
    for batch in common.rows_of(batches, BATCH):
        rows = measures([t or "" for t in batch["text"].to_pylist()], piece_ids, encoder)
        made = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
        yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["language"], batch["text_hash"], *made], ["doc_id", "language", "text_hash", *names])


def _bands(some: DataFrame, group: list[str], pull: float) -> DataFrame:
    """Quartiles q_<measure> of every group, drawn to those of wider groups."""
    counted = [some.groupBy(*group, F.lit(m).alias("measure"), F.round(F.col(m) / STEPS[m]).alias("step")).agg(F.count("*").alias("count")) for m in MEASURES]
    steps = common.materialize(functools.reduce(DataFrame.unionByName, counted), "steps")
    slope = F.least(F.greatest(F.coalesce(F.regr_slope("entropy", "octave"), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    slopes = some.groupBy("script").agg(slope.alias("slope"))
    size = F.element_at(F.create_map(*[F.lit(x) for m in MEASURES for x in (m, STEPS[m])]), F.col("measure"))
    steps = steps.join(F.broadcast(slopes), "script")  # a row for each script
    steps = steps.withColumn("value", F.col("step") * size)
    trend = F.when(F.col("measure") == "entropy", F.col("slope") * F.col("octave")).otherwise(0.0)

    def quartiles(of: list[str], value, name: str) -> DataFrame:  # type: ignore[no-untyped-def]
        return steps.groupBy(*of, "measure").agg(F.sum("count").alias(f"n_{name}"), F.percentile(value, [0.25, 0.5, 0.75], F.col("count")).alias(f"q_{name}"))

    own = quartiles([*group, "slope"], F.col("value"), "own")
    near = quartiles(["script", "octave"], F.col("value"), "near")
    wide = quartiles(["script"], F.round((F.col("value") - trend) / size) * size, "wide")
    drawn = own.join(near, ["script", "octave", "measure"]).join(wide, ["script", "measure"])
    near_ = F.transform("q_near", lambda q, i: (q * F.col("n_near") + (F.col("q_wide")[i] + trend) * pull) / (F.col("n_near") + pull))
    drawn = drawn.withColumn("near", near_)
    drawn = drawn.withColumn("q", F.transform("q_own", lambda q, i: (q * F.col("n_own") + F.col("near")[i] * pull) / (F.col("n_own") + pull)))
    return drawn.groupBy(*group).agg(*[F.max(F.when(F.col("measure") == m, F.col("q"))).alias(f"q_{m}") for m in MEASURES])


def rules(
    docs: DataFrame,
    *,
    language: str | None = "lang",
    piece_file: str = PIECES,
    vocabulary: str = tokens.BYTE_BPE,
    min_words: int = 20,
    max_repeat: int = 30,
    spread: float = 6.0,
    slack: float = 0.06,
    spread_above: float = 8.0,
    slack_above: float = 0.15,
    pull: float = 10.0,
) -> DataFrame:
    """One row per document: doc_id, the measures, base_failed, band_failed, kept and text_hash."""
    lang = F.col(language).cast("string") if language and language in docs.columns else F.lit(None).cast("string")
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), lang.alias("language"), F.xxhash64("text").alias("text_hash"), "text")
    measured = given.mapInArrow(lambda it: _measured(it, piece_file, vocabulary), f"doc_id long, language string, text_hash long, {SCHEMA}")
    measured = measured.withColumn("octave", F.floor(F.log2(F.greatest("n_tokens", F.lit(1)))).cast("int"))
    measured = common.materialize(measured.withColumn("language", F.coalesce("language", F.lit("?"))), "fertility")
    group = ["language", "script", "octave"]
    bands = common.materialize(_bands(measured.filter("n_tokens > 0"), group, pull), "bands")
    outside = F.lit(False)
    for m in MEASURES:
        low, mid, high = (F.col(f"q_{m}")[i] for i in range(3))
        below = F.col(m) < mid - F.greatest((mid - low) * spread, mid * slack)
        above = F.col(m) > mid + F.greatest((high - mid) * spread_above, F.lit(0.05) if m == "byte_share" else mid * slack_above)
        outside = outside | (above if m == "byte_share" else below | above)
    base = (F.col("n_words") < min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * max_repeat)
    if bands.count() <= BROADCAST_BANDS:
        judged = measured.join(F.broadcast(bands), group, "left")
    else:
        salt = F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(SALTS))
        copies = bands.withColumn("salt", F.explode(F.expr(f"sequence(0L, {SALTS - 1}L)")))
        judged = measured.withColumn("salt", salt).join(copies, [*group, "salt"], "left")
    judged = judged.withColumn("base_failed", base)
    judged = judged.withColumn("band_failed", F.coalesce(outside, F.lit(False)))
    shown = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "band_failed", *MEASURES]
    return judged.select(*shown, (~F.col("base_failed") & ~F.col("band_failed")).alias("kept"), "text_hash")
