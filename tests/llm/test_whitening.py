import math

import numpy as np
import pytest

from sparkfolio.llm import queries, whitening

SF = "/root/testdata/sf0.001"


def plain(rows, components=32):
    """(ids, deviations, covariance's eigenvalues and vectors, centred rows) by numpy, from whole numbers."""
    good = [(i, [math.floor(64 * float(c)) + 1_000_000 for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    n = len(good)
    x = np.array([v for _, v in good], object)
    s = x.sum(axis=0)
    deviation = ((x * n - s) ** 2).sum(axis=1)
    c = ((x * n - s) / n).astype(float)
    values, vectors = np.linalg.eigh(c.T @ c / n)
    return [i for i, _ in good], deviation, values[::-1][:components], vectors[:, ::-1][:, :components], c


def check(got, rows, components=32):
    ids, deviation, values, vectors, c = plain(rows, components)
    k, n = max(r["component"] for r in got), len(ids)
    assert sorted({r["component"] for r in got}) == list(range(1, k + 1)) and len(got) == k * n
    assert sorted((r["vec_id"], r["deviation"]) for r in got if r["component"] == 1) == sorted(zip(ids, deviation, strict=True))
    assert {r["n"] for r in got} == {n} and len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-8
    trace = (c * c).sum() / n
    for j in range(k):
        mine = dict((r["vec_id"], r) for r in got if r["component"] == j + 1)
        assert {round(r["explained"] / (values[j] / trace), 9) for r in mine.values()} == {1.0}
        want = c @ vectors[:, j] / math.sqrt(values[j])
        have = np.array([mine[i]["whitened"] for i in ids])
        assert min(np.abs(have - want).max(), np.abs(have + want).max()) < 1e-6
    return k


def test_op13_against_numpy(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()]
    assert check(queries.op13_whitening(spark, SF).collect(), rows) == 32


def test_odd_vectors(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [float(c) for c in rng.normal(size=5) * [9, 5, 3, 1, 0] + i % 3]) for i in range(200)]
    odd = [(900, None), (901, []), (902, [1.0, None, 1.0, 1.0, 1.0]), (903, [float("nan")] * 5), (904, [math.inf] * 5)]
    df = spark.createDataFrame([(i, v, 0, "x") for i, v in [*rows, *odd, (905, [1.0, 2.0])]], "vec_id long, embedding array<double>, n int, deviation string").repartition(3)
    assert check(whitening.whiten(df).collect(), [*rows, *odd]) == 5
    assert check(whitening.whiten(df, components=2).collect(), rows, 2) == 2
    again = spark.createDataFrame([(None, rows[0][1]), (7, rows[1][1]), (7, rows[1][1]), (7, rows[2][1])], "vec_id long, embedding array<double>")
    got = whitening.whiten(again).collect()
    assert len(got) == 4 * max(r["component"] for r in got) and sum(r["vec_id"] is None for r in got) * 4 == len(got)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]])
def test_no_variance_no_rows(spark, rows):
    out = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert out.count() == 0 and out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_less_than_full_rank(spark):
    """Two dimensions that rise together have one component."""
    rows = [(i, [float(i), float(i), 1.0]) for i in range(50)]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {r["component"] for r in got} == {1} and abs(got[0]["explained"] - 1) < 1e-12


def test_deviations_are_exact_or_null():
    x = np.array([[1 << 40, 3], [5, -(1 << 40)]], np.int64)
    sums = [int(c) for c in x.sum(axis=0)]
    exact = [sum((2 * int(v) - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in x]
    got, centred = whitening.deviations(x, 2, sums)
    assert got == [e if e < 2**63 else None for e in exact] == [None, None] and centred[0, 0] == ((1 << 40) - 5) / 2
    got, _ = whitening.deviations(x >> 12, 2, [int(c) for c in (x >> 12).sum(axis=0)])
    assert got[0] == sum((2 * int(v) - s) ** 2 for v, s in zip((x >> 12)[0], (x >> 12).sum(axis=0).tolist(), strict=True))


def test_huge_entries(spark):
    rows = [(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [0.0, 2.0])]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {r["vec_id"]: r["deviation"] for r in got} == {1: None, 2: None, 3: 36864} and abs(got[0]["explained"] - 1) < 1e-9
