"""Many texts at once: what is known by word or piece is found once for each different one."""

import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from sparkfolio.llm import chunkreuse, fertility, tokens

PLAIN = Tokenizer.from_file(tokens.BYTE_BPE)
PARTS = ["a", "b ", " ", "\n", "\t", "\r\n", "\n\n", "\x85", "　", "\x1c", "é", "12", "'s", ".", "x<|endoftext|>", "\n a", "foo bar", "\0", "日本"]


def plain(text):
    return PLAIN.encode(text, add_special_tokens=False).ids


def test_many_texts_are_encoded_as_the_library_does():
    rng = random.Random(5)
    texts = [None, "", *("".join(rng.choices(PARTS, k=rng.randrange(10))) for _ in range(3000))]
    e = tokens.Encoder(tokens.BYTE_BPE)
    want = [plain(t or "") for t in texts]
    assert [np.frombuffer(x, "<u4").tolist() for x in e.encode_all(texts)] == want
    assert [np.frombuffer(e.encode(t), "<u4").tolist() for t in texts] == want
    said = [t or "" for t in texts]
    assert e.sizes(said, tokens.Cut.of(said)).tolist() == list(map(len, want))
    assert e.encode_all([]) == [] and e.encode_all(["x y"]) == [e.encode("x y")]


def test_pieces_are_looked_up_once_in_many_texts(monkeypatch):
    asked = []
    e = tokens.Encoder(tokens.BYTE_BPE)
    learn = e._learn
    monkeypatch.setattr(e, "_learn", lambda piece: asked.append(piece) or learn(piece))
    monkeypatch.setattr(tokens, "LONGEST", 0)  # nothing is remembered
    got = e.encode_all(["same words again\nand again"] * 1000)
    assert len(asked) < 20 and {tuple(np.frombuffer(x, "<u4").tolist()) for x in got} == {tuple(plain("same words again\nand again"))}


def test_sparing_tables_hold_what_comes_again(monkeypatch):
    once = [" ".join(f"{chr(97 + i % 26)}{chr(97 + j % 26)}x{'abcdefghij'[i // 26]}{'abcdefghij'[j // 26]}, again and again." for j in range(150)) for i in range(150)]
    pieces, e = fertility.Pieces(fertility.PIECES), tokens.encoder(sparing=True)
    assert fertility.measures(once, pieces, e)[7] == fertility.measures(once[7:8], fertility.Pieces(fertility.PIECES), tokens.Encoder(tokens.BYTE_BPE))[0]
    assert "again" in pieces and " again" in e._known and len(pieces) + len(e._known) < 100  # of 22 500 words that stand once
    monkeypatch.setattr(tokens, "FEWER", 20)
    rng = random.Random(7)
    for _ in range(40):
        texts = ["".join(rng.choices([*PARTS, *" ".join(once[:3]).split(" ")[:60], " and", " or, "], k=rng.randrange(60))) for _ in range(200)]
        assert [np.frombuffer(x, "<u4").tolist() for x in e.encode_all(texts)] == list(map(plain, texts))
        fertility.measures(texts, pieces, e)
        assert max(map(len, (pieces, pieces._before, e._known, e._before))) <= 100
    assert max(map(len, (pieces, pieces._before, e._known, e._before))) <= 20
    assert [pieces.of(texts[:50], [False] * 50)] == [fertility.Pieces(fertility.PIECES).of(texts[:50], [True] * 50)]


def test_a_text_that_begins_with_a_space_is_encoded_by_pieces(monkeypatch):
    e = tokens.Encoder(tokens.BYTE_BPE)
    want = plain(" some words of a chunk")
    whole = e._whole
    monkeypatch.setattr(e, "_whole", lambda text: pytest.fail("encoded whole") if len(text) > 5 else whole(text))
    assert np.frombuffer(e.encode(" some words of a chunk"), "<u4").tolist() == want
    head, ids, tail = chunkreuse.part("ope some words of a chunk tai", e)
    assert (head, tail) == ("ope", " tai") and np.frombuffer(ids, "<u4").tolist() == want


def test_measures_of_many_texts_are_those_of_each():
    rng = random.Random(6)
    texts = ["", *("".join(rng.choices([*PARTS, "one two three four five six seven eight "], k=rng.randrange(40))) for _ in range(400))]
    pieces, encoder = fertility.Pieces(fertility.PIECES), tokens.Encoder(tokens.BYTE_BPE)
    names = [part.split()[0] for part in fertility.SCHEMA.split(", ")]
    for text, row in zip(texts, fertility.measures(texts, pieces, encoder), strict=True):
        assert row == fertility.measures([text], pieces, encoder)[0]
        got, words = dict(zip(names, row, strict=True)), text.encode().split()
        ids = [i for w in words for i in pieces._model.encode(w.decode())]
        spots = {}
        for i in range(len(words) - 7):
            spots.setdefault(tuple(words[i : i + 8]), []).append(i)
        again = {i + k for at in spots.values() if len(at) > 1 for i in at for k in range(8)}
        assert (got["n_words"], got["n_tokens"], got["n_repeat_words"]) == (len(words), len(ids), len(again))
        if ids:
            assert got["bpe_chars"] == got["word_chars"] / len(plain(text)) and got["byte_share"] == pytest.approx(np.mean([pieces.is_byte[i] for i in ids]))
