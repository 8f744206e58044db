import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkfolio.llm import queries, spelling

from .conftest import ODD

SF = "/root/testdata/sf0.001"


def plain_counts(docs, noise):
    total = {}
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if noise and h % noise == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            total[run] = total.get(run, 0) + 1
    return {w: n for w, n in total.items() if len(w) >= 7 and n >= 2}


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(words):
    """All pairs of words whose halves agree somewhere are compared: one edit leaves one half as it is."""
    by = {}
    for w in words:
        for k in range(len(w) // 2 - 2, len(w) // 2 + 3):
            by.setdefault((0, w[:k]), set()).add(w)
            by.setdefault((1, w[-k:]), set()).add(w)
    out = {}
    for w, n in words.items():
        half = len(w) // 2
        met = {x for k in (half - 1, half, half + 1) for side in ((0, w[:k]), (1, w[-k:])) for x in by.get(side, ())}
        close = [x for x in met if x != w and one_apart(w, x)]
        best = min(close, key=lambda x: (-words[x], x), default=None)
        out[w] = (best if best and words[best] >= 10 * n else None, n, len(close))
    rows = []
    for w, (form, n, close) in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        rows.append((w, form, root, n, close, words[form] if form else None))
    return sorted(rows)


def test_op12_against_plain_search(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = plain(plain_counts(docs, 31))
    got = sorted(map(tuple, queries.op12_deletion_hash_variants(spark, SF).collect()))
    assert got == want and any(r[1] for r in want) and any(r[4] > 1 for r in want)


@pytest.mark.parametrize("letters", ["ab", "abcdé"])
def test_dense_words_and_chains(spark, letters, monkeypatch):
    monkeypatch.setattr(spelling, "MADE", 50)
    rng = np.random.default_rng(5)
    words = {"".join(rng.choice(list(letters), rng.integers(7, 10))): int(10 ** rng.uniform(0.4, 4)) for _ in range(400)}
    chain = {"chained" + "z" * k: 2 * 10**k for k in range(5)}
    words |= chain | {"y" * k: 3 for k in (300, 301, 302)}
    given_ = spark.createDataFrame([(w, n, i) for i, (w, n) in enumerate(words.items())], "word string, n long, id long").repartition(3)
    monkeypatch.setattr(spelling, "count", lambda docs, **_: given_.select("word", "n"))
    got = sorted(map(tuple, spelling.variants(None).collect()))
    assert got == plain(words)
    assert {r[2] for r in got if r[0] in chain} == {"chainedzzzz"}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("abé", min_size=9, max_size=9), min_size=1, max_size=5))
def test_keys_are_those_of_the_strings(words):
    of = lambda x: np.frombuffer("".join(x).encode("latin-1"), np.uint8).reshape(len(x), -1)
    placed, deleted, _ = spelling.keys(of(words))
    for i, w in enumerate(words):
        for j in range(len(w)):
            less = w[:j] + w[j + 1 :]
            assert deleted[i, j] == spelling.keys(of([less]))[2][0]
            other = w[:j] + "x" + w[j + 1 :]
            assert placed[i, j] == spelling.keys(of([other]))[0][0, j] and (j == 0 or placed[i, j] != placed[i, j - 1])


def test_keys_that_collide_are_told_apart_by_strings(spark, monkeypatch):
    """With one key for all, everything is a candidate."""
    words = {"aaaaaaab": 50, "aaaaaaac": 2, "aaaaaab": 4, "bcbcbcbcb": 9, "cbcbcbcb": 7}
    rows = []
    for i, (w, n) in enumerate(words.items()):
        rows += [(kind, at, (i, w, n)) for kind in (spelling.PLACED, spelling.DELETED) for at in range(len(w)) if kind == spelling.PLACED or not at or w[at] != w[at - 1]]
        rows.append((spelling.OWN, 0, (i, w, n)))
    total, best = {}, {}
    for i, count, n, word in spelling.near(rows):
        total[i] = total.get(i, 0) + count
        best[i] = min(best.get(i, (0, "")), (-n, word))
    want = plain(words)
    names = list(words)
    assert {names[i]: c for i, c in total.items()} == {r[0]: r[4] for r in want if r[4]}
    assert {names[i]: w for i, (_, w) in best.items()} == {"aaaaaaab": "aaaaaab", "aaaaaaac": "aaaaaaab", "aaaaaab": "aaaaaaab", "bcbcbcbcb": "cbcbcbcb", "cbcbcbcb": "bcbcbcbcb"}


def test_odd_documents(spark, odd, none, monkeypatch):
    monkeypatch.setattr(spelling, "HELD", 2)
    more = [(20, "Straßenbäume, STRASSENBÄUME straßenbäume ×÷×÷×÷× ×÷×÷×÷×"), (-9, "x" * 20_000), (21, "x" * 19_999 + " " + "x" * 19_999), (22, "x" * 19_998 + "yx " * 3)]
    docs = odd.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    rows = [*[(i, t) for i, t, _ in ODD], *more]
    for noise in (0, 31, 1):
        assert sorted(map(tuple, spelling.variants(docs, noise=noise).collect())) == plain(plain_counts(rows, noise))
    assert spelling.variants(none).count() == 0
