import itertools

from decimal import Decimal

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkfolio.llm import graph, minhash, pstable, queries

SF = "/root/testdata/sf0.001"


def joined(nodes, links):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {n: root(n) for n in nodes}


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 300)], [(i, i ^ 1) for i in range(20)], [(9, 4), (4, 9), (None, 3), (7, 2), (2, 9)]])
def test_components(spark, edges):
    got = {r["id"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    real = [(a, b) for a, b in edges if None not in (a, b) and a != b]
    assert got == joined({x for e in real for x in e}, real)


@settings(max_examples=50, deadline=None)
@given(st.integers(1, 400), st.floats(0.0, 1.0), st.integers(0, 10**6))
def test_sketches_fill_and_estimate(n, share, seed):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 2**63, 2 * n, dtype=np.uint64)
    k = int(share * n)
    a, b = x[:n], x[n - k : 2 * n - k]
    s, t = minhash.sketch(a, 256), minhash.sketch(b, 256)
    assert not (s == np.uint64(2**64 - 1)).any() and (minhash.sketch(a[::-1].copy(), 256) == s).all()
    real = len(set(a) & set(b)) / len(set(a) | set(b))
    assert abs((s == t).mean() - real) < 0.2


def test_band_count():
    b = minhash.bands_for(0.85)
    assert (1 - 0.85**4) ** b < 1e-6 < (1 - 0.85**4) ** (b - 1)


def sets(rows, size):
    out = []
    for i, t in rows:
        w = (t or "").encode().lower().split()
        out.append((i, {tuple(w[j : j + size]) for j in range(max(1, len(w) - size + 1))} if w else set()))
    return out


def brute(rows, size, percent):
    s = sets(rows, size)
    links = [(a, b) for (a, x), (b, y) in itertools.combinations(s, 2) if x and y and min(len(x), len(y)) * 100 >= percent * max(len(x), len(y)) and 100 * len(x & y) >= percent * len(x | y)]
    return {i: len(x) for i, x in s}, joined([i for i, _ in rows], links)


def agree(found, rows, size, percent):
    sizes, parts = brute(rows, size, percent)
    got = {r["doc_id"]: r for r in found.collect()}
    assert {i: r["n_shingles"] for i, r in got.items()} == sizes
    assert {i: r["component_id"] for i, r in got.items()} == parts
    assert all(r["kept"] == (i == r["component_id"]) for i, r in got.items())


def test_op5_against_all_pairs(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    agree(queries.op5_fast_similarity_dedup(spark, SF), rows, 3, 85)


@pytest.mark.parametrize("block", [512, 7])
def test_a_group_of_near_copies_keeps_all_links(spark, block):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 10**6, 60)
    rows = []
    for i in range(120):
        w = base.copy()
        at = rng.integers(0, 60, rng.integers(0, 4))
        w[at] = rng.integers(0, 10**6, len(at))
        rows.append((int(i) * 3 + 1000, " ".join(map(str, w))))
    rows += [(2, "a B c"), (3, "A b C"), (5, "a b"), (6, "A b"), (8, "b a"), (9, ""), (10, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    agree(minhash.near_duplicates(df, words=3, percent=85, block=block), rows, 3, 85)


def test_blocks_follow_the_size_of_sets(spark, monkeypatch):
    """Long near-copies are compared in blocks of few, with the same result."""
    rng = np.random.default_rng(8)
    base = [f"w{x}" for x in rng.integers(0, 10_000, 400)]
    rows = []
    for i in range(40):
        words = list(base)
        for k in rng.integers(0, 400, i):
            words[k] = f"x{rng.integers(0, 10_000)}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(map(tuple, minhash.near_duplicates(docs, words=2, percent=70).collect()))
    monkeypatch.setattr(minhash, "BLOCK_SHINGLES", 900)
    assert sorted(map(tuple, minhash.near_duplicates(docs, words=2, percent=70).collect())) == want
    assert 1 < len({r[2] for r in want}) < 40


def test_odd_documents(spark, odd, none):
    rows = minhash.near_duplicates(odd).collect()
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append((r["n_shingles"], r["component_id"], r["kept"]))
    assert len(rows) == 12 and by[None][0][1:] == (None, True)
    assert by[1] == [(0, 1, True)] and by[2] == [(0, 2, True)] and by[3] == [(0, 3, True)]
    assert [x[1:] for x in by[6] + by[7]] == [(6, True), (6, True), (6, False)]
    assert by[-9] == [(1, -9, True)] and by[5] == [(1, 5, True)]
    assert minhash.near_duplicates(none).count() == 0


def test_intersections_by_products():
    rng = np.random.default_rng(0)
    x = [np.unique(rng.integers(0, 90, rng.integers(1, 60))) for _ in range(9)]
    want = [[len(set(a) & set(b)) for b in x[4:]] for a in x[:4]]
    assert minhash.common_counts(x[:4], x[4:], width=16).tolist() == want


def vectors_agree(rows, found, cosine=0.98):
    ok = [(i, np.array(v, float) / np.linalg.norm(v), lab) for i, v, lab in rows if v is not None and lab is not None and len(v) and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    links = [(a, b) for (a, x, k), (b, y, m) in itertools.combinations(ok, 2) if k == m and len(x) == len(y) and x @ y >= cosine]
    degree = {i: 0 for i, _, _ in rows}
    for e in links:
        for i in e:
            degree[i] += 1
    parts = joined(degree, links)
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in found.collect()}
    assert got == {i: (degree[i], parts[i], parts[i] == i) for i in degree}


@pytest.mark.parametrize("block", [512, 5])
def test_op10_against_all_pairs(spark, block):
    rng = np.random.default_rng(7)
    rows = []
    for c in range(6):
        centre = rng.standard_normal(16)
        for _ in range(25):
            rows.append((len(rows), (centre + rng.standard_normal(16) * rng.choice([0.02, 0.1, 0.2])).tolist(), int(rng.integers(2))))
    rows += [(len(rows) + k, rows[3][1], rows[3][2]) for k in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("cls", F.lit("x")).withColumn("keys", F.lit(1))
    vectors_agree(rows, pstable.near_vectors(df, block=block))


def test_odd_vectors(spark):
    v = [1.0, 0.0]
    rows = [(1, v, 1), (2, [2.0, 0.0], 1), (3, v, None), (4, v, None), (5, None, 1), (6, [], 1), (7, [0.0, 0.0], 1), (8, [1.0, None], 1), (9, [float("nan"), 1.0], 1), (10, [float("inf"), 1.0], 1), (11, [1.0], 1), (12, v, 2), (13, [1e300, 0.0], 1), (14, [1e-300, 0.0], 1)]
    schema = "vec_id long, embedding array<double>, label int"
    vectors_agree([(i, [x / 1e150 for x in y] if i == 13 else [x * 1e150 for x in y] if i == 14 else y, k) for i, y, k in rows], pstable.near_vectors(spark.createDataFrame(rows, schema)))
    assert pstable.near_vectors(spark.createDataFrame([], schema)).count() == 0
    again = pstable.near_vectors(spark.createDataFrame([(None, v, 1), (1, v, 1), (1, v, 1)], schema)).collect()
    assert sorted((r["vec_id"] or 0, r["n_links"], r["component_id"] or 0, r["kept"]) for r in again) == [(0, 0, 0, True), (1, 1, 1, True), (1, 1, 1, True)]


@pytest.mark.parametrize(("kind", "labels"), [("double", [1.2, 1.7, 0.0, -0.0, None, 1.2]), ("string", ["a", "b", "", "", None, "a"]), ("decimal(9,2)", [Decimal("1.20"), Decimal("1.70"), Decimal(0), Decimal(0), None, Decimal("1.2")]), ("bigint", [2**62, 2**62 + 1, 0, 0, None, 2**62])])
def test_labels_of_any_type_are_compared_by_value(spark, kind, labels):
    df = spark.createDataFrame([(i, [1.0, 2.0], x) for i, x in enumerate(labels)], f"vec_id long, embedding array<double>, label {kind}")
    for parts in (1, 6):  # with and without the null among the others
        got = {r["vec_id"]: r["component_id"] for r in pstable.near_vectors(df.repartition(parts)).collect()}
        assert got == {0: 0, 1: 1, 2: 2, 3: 2, 4: 4, 5: 0}


def test_tables_follow_from_the_miss_rate():
    p = pstable.collision(0.2, 1.0) ** 8
    n = pstable.tables_for(0.98, 8)
    assert (1 - p) ** n < 1e-6 <= (1 - p) ** (n - 1)


def test_projections_follow_from_the_number_of_vectors():
    far = pstable.collision(2**0.5, 1.0)
    chosen = [pstable.projections_for(10**e, 0.98) for e in range(0, 11, 2)]
    assert chosen == sorted(chosen) and chosen[0] < chosen[-1]
    assert all(10**e * far**k < 100 for e, k in zip(range(0, 11, 2), chosen, strict=True))


def test_op10_as_registered_against_all_pairs(spark):
    rows = [(r["vec_id"], [float(x) for x in r["embedding"]], r["label"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    vectors_agree(rows, queries.op10_pstable_near_duplicates(spark, SF))


def test_rows_of_one_id_are_documents_of_their_own(spark):
    words = lambda k: [f"{k}{i}" for i in range(60)]
    near = lambda k: " ".join([*words(k)[:-1], "other"])
    df = spark.createDataFrame([(6, " ".join(words("a"))), (6, " ".join(words("b"))), (6, " ".join(words("b"))), (7, near("a")), (8, near("b")), (9, " ".join(words("c")))], "doc_id long, text string")
    got = sorted((r["doc_id"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(df, words=3, percent=85).collect())
    assert got == [(6, 6, True)] * 3 + [(7, 6, False), (8, 6, False), (9, 9, True)]
