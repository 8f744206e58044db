"""Hashed character n-grams of words, computed for many words at once."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import xxhash

from .minhash import _ODD, mix


def split(text: str | None) -> list[bytes]:
    """Words of a text: A-Z lower-cased, cut at ASCII white space."""
    return text.encode("utf-8", "replace").lower().split() if text else []


def number(texts: Iterable[list[bytes]]) -> tuple[list[bytes], list[np.ndarray]]:
    """The distinct words of several texts, and each text as indices into them."""
    index: dict[bytes, int] = {}
    at = [np.array([index.setdefault(w, len(index)) for w in words], dtype=np.int64) for words in texts]
    return list(index), at


class Grams:
    """For each of ``words``: hashed n-grams of the word between two marks, n in ``sizes``.

    ``ids`` holds the slots of all words one after another, ``starts`` where each begins. An n-gram
    with a mark is a prefix or a suffix. With ``whole``, one slot of the word itself comes first.
    """

    #: Words that are hashed at once, which bounds what is held beside the result.
    STEP = 20_000

    def __init__(self, words: list[bytes], sizes: tuple[int, ...], slots: int, whole: bool = False) -> None:
        parts = [self._some(words[i : i + self.STEP], sizes, slots, whole) for i in range(0, max(1, len(words)), self.STEP)]
        self.ids = np.concatenate([ids for ids, _ in parts])
        self.counts = np.concatenate([counts for _, counts in parts])
        self.starts = np.cumsum(self.counts) - self.counts

    @staticmethod
    def _some(words: list[bytes], sizes: tuple[int, ...], slots: int, whole: bool) -> tuple[np.ndarray, np.ndarray]:
        text = np.frombuffer(b"".join([b"\x02" + w + b"\x03" for w in words]), np.uint8).astype(np.uint64)
        length = np.array([len(w) + 2 for w in words], np.int64)
        owner = np.repeat(np.arange(len(words)), length)
        found, owners = [], []
        if whole and words:
            found.append(np.array([xxhash.xxh3_64_intdigest(w) for w in words], np.uint64))
            owners.append(np.arange(len(words)))
        for n in sizes:
            if len(text) < n:
                continue
            h = np.full(len(text) - n + 1, n, np.uint64)
            for i in range(n):
                h = h * _ODD + text[i : len(text) - n + 1 + i]
            inside = owner[: len(h)] == owner[n - 1 :]
            found.append(mix(h[inside]))
            owners.append(owner[: len(h)][inside])
        ids = np.concatenate([*found, np.empty(0, np.uint64)])
        of = np.concatenate([*owners, np.empty(0, np.int64)])
        out = (ids & np.uint64(slots - 1)).astype(np.int32)
        return (out[np.argsort(of, kind="stable")] if len(found) > 1 else out), np.bincount(of, minlength=len(words))

    def sums(self, table: np.ndarray) -> np.ndarray:
        """Per word, the sum of the table's rows at its slots; every word must have a slot."""
        return np.add.reduceat(table[self.ids], self.starts, axis=0) if len(self.starts) else np.zeros((0, table.shape[1]), table.dtype)

    def of(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The slots of several words, repeated words included, and for each slot the place of its word."""
        counts = self.counts[words]
        place = np.repeat(np.arange(len(words)), counts)
        within = np.arange(len(place)) - np.repeat(np.cumsum(counts) - counts, counts)
        return self.ids[np.repeat(self.starts[words], counts) + within], place

    def means(self, table: np.ndarray) -> np.ndarray:
        """Per word, the sum of the table's rows at its slots over the root of their number; 0 without slots."""
        out = np.zeros((len(self.counts), table.shape[1]), table.dtype)
        held = np.flatnonzero(self.counts)
        if len(held):
            out[held] = np.add.reduceat(table[self.ids], self.starts[held], axis=0) / np.sqrt(self.counts[held], dtype=table.dtype)[:, None]
        return out
