import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkfolio.llm import chunkreuse, queries, tokens

from .conftest import ODD
from .test_tokens_files_packing import PLAIN, ids

SF = "/root/testdata/sf0.001"
PIECES = st.lists(st.sampled_from(["a", "Ab", " ", "  ", "\n", "\n\n", " \n", "é", "'s", "don't", ".", "!?", "\t", "　", "12", "日本", "\x1c", "\0", "<|endoftext|>", "ª", "\xa0", "😀", " the", " of"]), max_size=40).map("".join)


@settings(max_examples=400, deadline=None)
@given(PIECES, st.data())
def test_chunks_cut_anywhere_join_to_the_whole(text, data):
    places = sorted(data.draw(st.lists(st.integers(0, len(text)), max_size=6)))
    parts = [text[a:b] for a, b in zip([0, *places], [*places, len(text)], strict=True)]
    e = tokens.encoder()
    assert np.frombuffer(chunkreuse.join((chunkreuse.part(p, e) for p in parts), e), "<u4").tolist() == ids(text)


def plain_hash(window):
    value, up, _ = chunkreuse._tables()
    return sum(int(value[b]) * int(up[i]) for i, b in enumerate(window)) % 2**64


def test_rolling_hash_is_that_of_each_window(monkeypatch):
    data = np.random.default_rng(1).integers(0, 256, 300, dtype=np.uint8)
    got = chunkreuse.rolling(data).tolist()
    assert got == [plain_hash(data[i : i + chunkreuse.WINDOW].tolist()) for i in range(300 - chunkreuse.WINDOW + 1)]


def test_cuts_follow_content_and_spare_characters(monkeypatch):
    rng = np.random.default_rng(2)
    passage = "".join(rng.choice(list("abcdé日 ."), 30_000))
    a, b = ("x" * 1000 + passage).encode(), ("yé" * 777 + passage + "tail").encode()
    cuts = [set(chunkreuse.digests(t, chunkreuse.cut(t))) for t in (a, b)]
    assert len(cuts[0] & cuts[1]) >= len(cuts[0]) - 4
    for t in (a, b, b"", b"x" * 20_000, "é".encode() * 10_000):
        ends = chunkreuse.cut(t)
        sizes = np.diff([0, *ends])
        assert b"".join(t[i:j] for i, j in zip([0, *ends], ends, strict=False)) == t and (sizes <= chunkreuse.MOST + 3).all() and (sizes[:-1] >= chunkreuse.LEAST).all()
        for i, j in zip([0, *ends], ends, strict=False):
            t[i:j].decode()
    monkeypatch.setattr(chunkreuse, "BLOCK", 700)  # blocks don't show
    assert chunkreuse.cut(a) == sorted(chunkreuse.cut(a)) and set(chunkreuse.digests(a, chunkreuse.cut(a))) == cuts[0]


def expected(rows):
    out = []
    for i, text in rows:
        found = ids(text)
        out.append((i, len(found), hashlib.sha256(",".join(map(str, found)).encode()).hexdigest(), hashlib.sha256(PLAIN.decode(found, skip_special_tokens=False).encode()).hexdigest()))
    return sorted(out, key=str)


def test_op11_against_plain_encoding(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert sorted(map(tuple, queries.op11_chunk_reuse_encoding(spark, SF).collect()), key=str) == expected(docs)


@pytest.mark.parametrize("bits", [1 << 16, 1 << 27])
def test_odd_and_shared_texts(spark, odd, monkeypatch, bits):
    """A full bitmap only sends chunks the longer way."""
    monkeypatch.setattr(chunkreuse, "MOST_BITS", bits)
    if bits == 1 << 16:
        real = chunkreuse.shared
        monkeypatch.setattr(chunkreuse, "shared", lambda docs: real(docs) and b"\xff" * (bits // 8))
    rng = np.random.default_rng(3)
    say = lambda n: " ".join("".join(rng.choice(list("abcdefgh"), 5)) for _ in range(n))
    common = [say(900) for _ in range(3)]
    more = [(100 + i, say(i * 7) + " <|endoftext|>  " + common[i % 3] + "\n\n" + say(50) + common[(i + 1) % 3][i:]) for i in range(12)]
    docs = odd.select("doc_id", "text").unionByName(spark.createDataFrame([*more, more[0]], "doc_id long, text string"))
    got = chunkreuse.encode(docs.repartition(5))
    want = expected([*[(i, t) for i, t, _ in ODD], *more, more[0]])
    assert sorted(map(tuple, chunkreuse.digest(got).collect()), key=str) == want
    texts = {r["doc_id"]: r["text"] for r in chunkreuse.decode(got).collect()}
    assert all(texts[i] == t for i, t in more) and texts[1] == ""


def test_nothing(spark, none):
    assert chunkreuse.digest(chunkreuse.encode(none)).count() == 0


def test_each_shared_chunk_is_encoded_once(spark, monkeypatch):
    rng = np.random.default_rng(4)
    passage = " ".join("".join(rng.choice(list("abcdefgh"), 5)) for _ in range(2000))
    docs = spark.createDataFrame([(i, f"{i} {passage}") for i in range(30)], "doc_id long, text string")
    bits = chunkreuse.shared(docs)
    assert bits and chunkreuse.shared(docs.filter("doc_id = 3")) == b""
    marked = spark.sparkContext.broadcast(bits)
    from pyspark.sql import functions as F

    rows = docs.withColumn("row", F.col("doc_id")).withColumn("text_hash", F.lit(0)).mapInArrow(lambda it: chunkreuse._split(it, marked, tokens.BYTE_BPE), chunkreuse._PARTS)
    uses = rows.filter(F.col("kind") == chunkreuse.REFERENCE)
    assert uses.count() == 30 * uses.select("digest").distinct().count() and uses.agg(F.sum(F.length("head"))).first()[0] > 0.85 * 30 * len(passage)
