import random

import pytest

from sparkfolio.functions import text as texts
from sparkfolio.lang.parser import HYPHENS
from sparkfolio.sources import grams
from sparkfolio.sources.chunks import lines

ROWS = [(1, "abcabc", "abc"), (1, "xabc", None), (2, "ab", "日本語😀x"), (3, "", ""), (4, "a\nb😀é", "aaaa"), (5, None, "zz9"), (1, "cabx", "")]


def _plain(rows, shards_of):
    want: dict = {}
    for file_id, *said in rows:
        for mark, text in zip("np", said, strict=True):
            for i in range(len(text or "") - 2):
                want.setdefault((mark + text[i : i + 3], shards_of[file_id]), set()).add(file_id)
    return {k: sorted(v) for k, v in want.items()}


@pytest.mark.parametrize("shards", [1, 3])
@pytest.mark.parametrize("cut", [5, 2_000_000])
def test_postings_equal_a_plain_listing(spark, monkeypatch, shards, cut):
    rng = random.Random(5)
    rows = ROWS + [(rng.randint(6, 40), "".join(rng.choices("abcd é😀", k=rng.randint(0, 30))), "".join(rng.choices("ab1", k=rng.randint(0, 9)))) for _ in range(200)]
    monkeypatch.setattr(grams, "SLICE", cut)
    chunks = spark.createDataFrame(rows, "file_id long, norm_text string, part_text string")
    where = {r[0]: r[1] for r in chunks.selectExpr("file_id", f"cast(pmod(xxhash64(file_id, 'shard'), {shards}) as int)").distinct().collect()}
    made = grams.postings(chunks.repartition(5), shards)
    assert made._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1  # pairs of file and gram are not dealt out
    got = made.collect()
    assert {(r["gram"], r["shard"]): r["files"] for r in got} == _plain(rows, where) and all(r["n"] == len(r["files"]) for r in got)
    assert len(got) == len({(r["gram"], r["shard"]) for r in got})


def test_posting_rows_of_many_letters():
    """As many letters and files as one number can't hold: halves are taken apart."""
    import numpy as np

    said = ["".join(chr(0x4E00 + (i * 7919 + j) % 20000) for j in range(700)) for i in range(600)]
    whole = said + ["".join(map(chr, [*range(0x20000, 0x2A000), *range(0x30000, 0x31000), *range(0xE0000, 0x10E000)]))] * 2
    ids = np.arange(len(whole))
    got: dict = {}
    for batch in grams._lists(ids, ids * 0, whole, "n"):
        for gram, files in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            got.setdefault(gram, []).extend(files)
    want: dict = {}
    for i, text in enumerate(whole):
        for g in {text[j : j + 3] for j in range(len(text) - 2)}:
            want.setdefault("n" + g, []).append(i)
    assert {k: sorted(v) for k, v in got.items()} == want


def test_parts_and_blank_lines_follow_their_rule(spark):
    every = "".join(map(chr, [*range(0x500), *range(0x2000, 0x3100), 0xFF0D, 0xFF70, 0x1F600]))
    folded = texts.normalize_text(every)
    assert texts.canonical_part(every) == "".join(c for c in folded if c not in HYPHENS and c.isalnum())
    assert texts.canonical_part("a*-_1", keep_star=True) == "a*1"
    said = spark.createDataFrame([("a\n \t 　\n\nb\r\n\x0b\x85 ",)], "t string").select(lines("t"))
    assert [(r["line"], r["text"]) for r in said.first()[0]] == [(1, "a"), (4, "b")]
