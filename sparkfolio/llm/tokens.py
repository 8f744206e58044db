"""Byte-level BPE ids of whole texts with the ``tokenizers`` library.

A byte-level pre-tokenizer ends a token before any white space that follows another
character, so a text whose spaces stand singly can be cut before every space and the pieces
encoded on their own. Pieces recur, so a worker keeps the ids of those it has met in a table
of bounded size; of many texts together each different piece is looked up once. A sparing encoder remembers
fewer pieces, and of many texts only those that stand there twice, as most others don't come again soon. A piece of letters goes straight to the library's BPE model, any other piece
and every text with other spacing through its whole tokenizer, as does every text if the vocabulary's
file asks for another pre-tokenizer, a normalizer, another model or marks that a cut or a run of letters could split.

Strings of the vocabulary's own marks, such as ``<|endoftext|>``, become their ids in a text, as the library's plain call
has it; ``marks_as_text`` spells them out like other text.
"""

from __future__ import annotations

import functools
import json
import os
from collections.abc import Callable, Sequence
from typing import NamedTuple

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
#: Pieces remembered; as many of the time before stay at hand.
REMEMBERED = 400_000
#: The same of a sparing encoder.
FEWER = 100_000
#: Longer pieces are not remembered.
LONGEST = 64
#: Characters of texts from which on it pays to number their pieces, and of those that are numbered at once, which bounds memory.
FEW, MANY = 1 << 12, 1 << 22
#: Marks that end a word and are tokens of their own after a letter.
_TAIL = ".,;:!?"


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = (b for b in range(256) if b not in shown)
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Cut(NamedTuple):
    """Texts cut at every space, and round every line end if no space and no other line end stands next to one (``by_line``).

    ``parts`` are the different parts, ``at`` has the number of each part in turn, and a text's begin at ``bounds``.
    """

    parts: list[str]
    at: np.ndarray
    bounds: np.ndarray
    by_line: np.ndarray

    @classmethod
    def of(cls, texts: Sequence[str]) -> Cut:
        by_line = [not ("\n\n" in t or " \n" in t or "\n " in t) for t in texts]
        lists = pc.split_pattern(pa.array([t.replace("\n", " \n ") if lines else t for t, lines in zip(texts, by_line, strict=True)], pa.string()), " ")
        numbered = lists.values.dictionary_encode()
        parts = numbered.dictionary.to_numpy(zero_copy_only=False).tolist()
        return cls(parts, numbered.indices.to_numpy().astype(np.int64), lists.offsets.to_numpy().astype(np.int64), np.array(by_line, bool))

    def sums(self, each: np.ndarray) -> np.ndarray:
        """Per text, the sum of a value of each of ``at``."""
        return np.diff(np.concatenate([[0], np.cumsum(each)])[self.bounds])


def sizes_of(ids: list[bytes]) -> np.ndarray:
    return np.fromiter(map(len, ids), np.int64, len(ids)) // 4


def gathered(data: np.ndarray, sizes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``data`` holds some items of each number one after another; those of each of ``at`` in turn, and how many each gave."""
    each = sizes[at]
    places = np.repeat((np.cumsum(sizes) - sizes)[at] - (np.cumsum(each) - each), each)
    places += np.arange(len(places))
    return data[places], each


class _Uneven(LookupError):
    """White space stands next to a cut, so the text can't be encoded by pieces."""


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str, marks_as_text: bool = False, sparing: bool = False) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self._all = Tokenizer.from_file(path)
        self._all.encode_special_tokens = marks_as_text
        self._all.no_truncation()
        self._all.no_padding()
        self._spelt = self._all.model.tokenize
        kind = json.loads(self._all.to_str())
        cut, model = kind["pre_tokenizer"] or {}, kind["model"]
        # any other file is read by the library alone
        plain = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")
        marks = any(a["lstrip"] or a["rstrip"] or a["single_word"] or all(c.isalpha() or c in _TAIL for c in a["content"]) or any(map(str.isspace, a["content"])) for a in kind["added_tokens"])
        #: Whether a text may be cut before any space that follows another character than white space.
        self.cuts = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space") and kind["normalizer"] is None and model["type"] == "BPE" and not any(model.get(x) for x in plain) and not marks
        self._letters = _byte_letters()
        self._bytes = [i.to_bytes(4, "little") for i in range(self._all.get_vocab_size())]
        self._sparing = sparing
        self._known: dict[str, bytes] = {}
        self._before: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return np.asarray(self._all.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4").tobytes()

    def _part(self, part: str) -> bytes:
        """Of a part that has no space but perhaps its first character."""
        ids = self._known.get(part)
        return self._learn(part) if ids is None else ids

    def _once(self, part: str) -> bytes:
        """As ``_part``, but the part isn't remembered."""
        ids = self._known.get(part) or self._before.get(part)
        return self._spell(part, self._once) if ids is None else ids

    def _learn(self, piece: str) -> bytes:
        ids = self._before.get(piece)
        if ids is None:
            ids = self._spell(piece, self._part)
        if len(piece) <= LONGEST:
            if len(self._known) >= (FEWER if self._sparing else REMEMBERED):
                self._before, self._known = self._known, {}
            self._known[piece] = ids
        return ids

    def _spell(self, piece: str, part: Callable[[str], bytes]) -> bytes:
        """The ids of a piece that isn't known; ``part`` gives those of what it is made of."""
        core = piece.rstrip(_TAIL)
        letters = core[1:] if core[:1] == " " else core
        if not letters.isalpha() or not (letters.isascii() or max(letters) < "ɐ"):  # beyond these, versions of Unicode may differ
            return self._odd(piece, part)
        if core is not piece and len(core) < len(piece):
            return part(core) + part(piece[len(core) :])
        spelt = "Ġ" + letters if letters.isascii() and letters is not core else core.encode().decode("latin-1").translate(self._letters)
        of = self._bytes
        return b"".join([of[t.id] for t in self._spelt(spelt)])

    def _odd(self, piece: str, part: Callable[[str], bytes]) -> bytes:
        if piece == "\n":
            return self._whole(piece)
        if not piece or piece[-1].isspace() or piece[1:2].isspace():
            raise _Uneven
        lines = piece.split("\n")
        if len(lines) > 1 and all(lines) and not any(x[-1].isspace() or i and x[0].isspace() for i, x in enumerate(lines)):
            return part("\n").join([part(x) for x in lines])
        return self._whole(piece)

    def encode(self, text: str | None) -> bytes:
        """The ids of one text; a null text counts as empty."""
        if not text:
            return b""
        if not self.cuts or "\0" in text:
            return self._whole(text)
        get, learn = self._known.get, self._learn
        pieces = text.replace(" ", "\0 ").split("\0")
        try:
            out = [get(x) or learn(x) for x in (pieces if pieces[0] else pieces[1:])]
        except _Uneven:
            return self._whole(text)
        return b"".join(out)

    def encode_all(self, texts: Sequence[str | None]) -> list[bytes]:
        """The ids of each text."""
        out: list[bytes] = []
        some: list[str] = []
        size = 0
        for t in texts:
            if some and size + len(t or "") > MANY:
                out += self._together(some, size)
                some, size = [], 0
            some.append(t or "")
            size += len(t or "")
        return out + self._together(some, size)

    def _together(self, texts: list[str], size: int) -> list[bytes]:
        if not self.cuts or not FEW <= size <= MANY:
            return [self.encode(t) for t in texts]
        cut = Cut.of(texts)
        found, at, uneven = self._numbered(cut)
        ids, each = gathered(np.frombuffer(b"".join(found), "<u4"), sizes_of(found), at)
        ends = 4 * np.concatenate([[0], np.cumsum(each)])[cut.bounds]
        said, ends = ids.tobytes(), ends.tolist()
        return [self._whole(t) if odd else said[a:b] for t, odd, a, b in zip(texts, uneven.tolist(), ends, ends[1:], strict=False)]

    def sizes(self, texts: Sequence[str], cut: Cut) -> np.ndarray:
        """How many ids each text has."""
        if not self.cuts:
            return np.array([len(self._whole(t)) // 4 for t in texts], np.int64)
        found, at, uneven = self._numbered(cut)
        out = cut.sums(sizes_of(found)[at])
        for i in np.flatnonzero(uneven).tolist():
            out[i] = len(self._whole(texts[i])) // 4
        return out

    def _numbered(self, cut: Cut) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """The ids of the different pieces, the number of each piece in turn, and which texts can't be encoded by pieces.

        A piece is a part with the space before it; a text's first part has none, nor have line ends and what follows them.
        """
        parts = cut.parts
        ends = np.array([p == "\n" for p in parts], bool)[cut.at]
        bare = ends.copy()
        bare[1:] |= ends[:-1]
        bare[cut.bounds[:-1]] = True
        piece = 2 * cut.at + ~bare
        used = np.zeros(2 * len(cut.parts), bool)
        used[piece] = True
        number = np.cumsum(used) - 1
        names = [" " + parts[i >> 1] if i & 1 else parts[i >> 1] for i in np.flatnonzero(used).tolist()]
        found = list(map(self._known.get, names))
        odd = np.zeros(len(names), bool)
        at = number[piece]
        most, once = (FEWER, (np.bincount(at, minlength=len(names)) < 2).tolist()) if self._sparing else (REMEMBERED, None)
        for i in [i for i, ids in enumerate(found) if ids is None]:
            name = names[i]
            if (ids := self._before.get(name)) is not None and len(self._known) < most:
                found[i] = self._known[name] = ids
                continue
            try:
                found[i] = (self._once if once and once[i] else self._learn)(name) if name else b""
            except _Uneven:
                found[i], odd[i] = b"", True
        blank = np.array([p[:1].isspace() for p in parts], bool)[cut.at]
        blank[cut.bounds[:-1]] = False
        uneven = (cut.sums(odd[at] | (blank & ~ends)) > 0) | (~cut.by_line & (cut.sums(ends) > 0))
        return found, at, uneven

    @property
    def size(self) -> int:
        return len(self._bytes)


class Decoder:
    """Texts of ids, marks included, as the library's ``decode(ids, skip_special_tokens=False)`` gives them."""

    def __init__(self, path: str) -> None:
        self._all = Tokenizer.from_file(path)
        kind = json.loads(self._all.to_str())
        self._spelt: list[bytes] | None = None
        if (kind["decoder"] or {}).get("type") == "ByteLevel":
            of = {c: b for b, c in _byte_letters().items()}
            tokens = (self._all.id_to_token(i) or "" for i in range(self._all.get_vocab_size()))
            self._spelt = [bytes(of[c] for c in t) if all(c in of for c in t) else t.encode() for t in tokens]

    def decode(self, ids: bytes) -> str:
        """The text of little-endian unsigned 32-bit ids."""
        listed = np.frombuffer(ids, "<u4").tolist()
        if self._spelt is None:
            return self._all.decode(listed, skip_special_tokens=False)
        return b"".join(map(self._spelt.__getitem__, listed)).decode("utf-8", "replace")


@functools.cache
def encoder(path: str = BYTE_BPE, marks_as_text: bool = False, sparing: bool = False) -> Encoder:
    """The worker's own encoder for a vocabulary file; kept from task to task."""
    return Encoder(path, marks_as_text, sparing)


@functools.cache
def decoder(path: str = BYTE_BPE) -> Decoder:
    return Decoder(path)
