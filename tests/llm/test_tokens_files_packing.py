import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sparkfolio.llm import bitplane, packing, queries, tokens

from .conftest import ODD

SF = "/root/testdata/sf0.001"


PLAIN = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def ids(text):
    return PLAIN.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "Ab", " ", "  ", "\n", "\n\n", "é", "'s", "don't", ".", "!?", "\t", "　", "12", "日本", "\x1c", "\0", "<|endoftext|>", "ª", "\xa0", "😀"]), max_size=12).map("".join))
def test_pieces_encode_as_the_whole(text):
    assert np.frombuffer(tokens.encoder().encode(text), "<u4").tolist() == ids(text)


def test_marks_become_their_ids_unless_asked_otherwise():
    text = "a <|endoftext|> b.<|endoftext|>\n<|endoftext|>  x"
    got = np.frombuffer(tokens.encoder().encode(text), "<u4").tolist()
    assert got == ids(text) and got.count(50256) == 3
    spelt = np.frombuffer(tokens.encoder(tokens.BYTE_BPE, True).encode(text), "<u4").tolist()
    assert 50256 not in spelt and PLAIN.decode(spelt, skip_special_tokens=False) == text


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 50256), max_size=30))
def test_any_ids_decode_as_the_library_does(some):
    assert tokens.decoder().decode(np.array(some, "<u4").tobytes()) == PLAIN.decode(some, skip_special_tokens=False)


def test_memory_of_pieces_is_bounded(monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 50)
    e = tokens.Encoder(tokens.BYTE_BPE)
    rng = random.Random(3)
    for _ in range(50):
        text = " ".join("".join(rng.choices("abcde", k=4)) for _ in range(40))
        assert np.frombuffer(e.encode(text), "<u4").tolist() == ids(text)
    assert len(e._known) <= 51


@pytest.mark.parametrize("planes", ["byte", "bit"])
@pytest.mark.parametrize("n", [0, 1, 7, 1000])
def test_blocks_round_trip(planes, n):
    raw = np.random.default_rng(n).integers(0, 2**32, n, dtype=np.uint32).tobytes()
    payload = bitplane.pack_block(raw, planes)
    assert bitplane.unpack_block(payload) == raw
    if n > 1:
        with pytest.raises(ValueError):
            bitplane.unpack_block(payload[:-4] + bytes(4) if payload[-4:] != bytes(4) else payload[:-4] + b"1234")
    for cut in (*range(0, 60, 7), len(payload) - 1):
        if cut < len(payload):
            with pytest.raises(ValueError):
                bitplane.unpack_block(payload[:cut])


def test_crc_of_parts_joins():
    a, b = b"hello", bytes(range(256)) * 40
    assert bitplane.join_crc(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


def expected(rows, end):
    """Ids of documents in file order."""
    return [(i, np.array([*ids(t), end], "<u4").tobytes()) for i, t in rows]


def test_files_hold_every_document(spark, odd, tmp_path):
    path = str(tmp_path / "ids")
    bitplane.write(odd, path, block=512)
    got = sorted(map(tuple, bitplane.manifest(spark, path).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == sorted((i for i, _, _ in ODD), key=lambda i: (i is not None, i))
    start = 0
    want = {}
    for i, body in expected([(i, t) for i, t, _ in ODD], 0):
        want.setdefault(i, []).append((len(body) // 4, zlib.crc32(body)))
    for doc, first, n, crc in got:
        assert first == start and (n, crc) in want[doc]
        start += n
    assert bitplane.segments(spark, path, keep_ids=True).filter("doc_id = 5").count() > 3


def test_files_of_nothing(spark, none, tmp_path):
    bitplane.write(none, str(tmp_path / "ids"))
    assert bitplane.manifest(spark, str(tmp_path / "ids")).count() == 0


def test_op1_against_plain_encoding(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    start, want = 0, []
    for i, body in expected(docs, 0):
        want.append((i, start, len(body) // 4, zlib.crc32(body)))
        start += len(body) // 4
    assert sorted(map(tuple, queries.op1_bitplane_ids(spark, SF).collect())) == want


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=60))
def test_the_rule_of_squares(sizes):
    packer, bins, gaps = packing.SumOfSquares(20), {}, {}
    for n in sizes:
        count = {}
        for g in gaps.values():
            count[g] = count.get(g, 0) + 1
        cost = lambda g: sum(v * v for k, v in {**count, g: count[g] - 1, **({g - n: count.get(g - n, 0) + 1} if g > n else {})}.items())
        fits = sorted((cost(g), g) for g in count if g >= n)
        where, offset = packer.place(n)
        if fits:
            assert where in bins and (cost(gaps[where]), gaps[where]) == fits[0]
        else:
            assert where not in bins
        bins.setdefault(where, []).append((offset, n))
        gaps[where] = gaps.get(where, 20) - n
        if not gaps[where]:
            del gaps[where]
    for items in bins.values():
        assert [o for o, _ in items] == np.cumsum([0] + [n for _, n in items])[:-1].tolist() and sum(n for _, n in items) <= 20


def check(rows, length=1024):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for items in by.values():
        at = 0
        for offset, n in sorted(items):
            assert offset == at
            at += n
        assert at <= length
    return by


def test_op4_places_every_piece(spark):
    rows = queries.op4_sum_of_squares_packing(spark, SF).collect()
    want = []
    for i, body in expected(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect(), 2):
        for k, (a, n) in enumerate(packing.cut_points(len(body) // 4)):
            want.append((i, k, a, n, zlib.crc32(body[4 * a : 4 * (a + n)])))
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == sorted(want)
    assert len(check(rows)) <= 1.03 * sum(w[3] for w in want) / 1024 + 1


def test_groups_share_their_remainders(spark):
    pieces = spark.range(4000).select(F.col("id").alias("doc_id"), (F.col("id") * 37 % 1000 + 1).alias("length"), F.lit("x").alias("offset_"), F.lit(1).alias("_other"))
    rows = packing.pack(pieces, group_rows=500).collect()
    by = check(rows)
    assert len(rows) == 4000 and len(by) <= 1.03 * sum(r["length"] for r in rows) / 1024 + 8
    assert packing.pack(pieces.filter("false")).count() == 0


def test_own_column_names_may_be_taken(spark):
    names = ["_size", "_group", "_at", "_offset", "_fill", "_group2", "_at2", "_base", "_SIZE_", "sequence_id"]
    pieces = spark.range(50).select(F.col("id").alias("doc_id"), (F.col("id") + 1).alias("length"), *[(F.col("id") * 2).alias(n) for n in names])
    rows = packing.pack(pieces).collect()
    check(rows)
    assert len(rows) == 50 and all(r[n] == 2 * r["doc_id"] for r in rows for n in names[:-1])


def test_other_vocabularies_are_read_by_the_library(tmp_path):
    import json

    kind = json.loads(tokens.encoder()._all.to_str())
    kind["pre_tokenizer"]["add_prefix_space"] = True
    (tmp_path / "other.json").write_text(json.dumps(kind))
    other = tokens.Encoder(str(tmp_path / "other.json"))
    assert np.frombuffer(other.encode("ab cd"), "<u4").tolist() == other._all.encode("ab cd", add_special_tokens=False).ids != ids("ab cd")


def test_odd_documents_are_packed(odd):
    rows = packing.pack(packing.tokenize(odd).drop("ids")).collect()
    check(rows)
    assert {r["doc_id"] for r in rows} == {i for i, _, _ in ODD}
    assert sum(r["length"] for r in rows) == sum(len(ids(t)) + 1 for _, t, _ in ODD)
    long = sorted((r["piece"], r["start"], r["length"]) for r in rows if r["doc_id"] == 5)
    assert [n for _, _, n in long[1:]] == [1024] * (len(long) - 1) and long[0][2] <= 1024
