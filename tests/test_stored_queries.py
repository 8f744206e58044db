import random

import pytest

from sparkfolio import queries
from sparkfolio.plans import stored
from sparkfolio.plans.compile import Options
from sparkfolio.plans.search import search
from sparkfolio.sources.chunks import Corpus, from_texts


@pytest.fixture(scope="module")
def library(spark):
    rng = random.Random(9)
    words = ["alpha", "beta", "ab-12", "ab12", "x", "it", "gamma delta", "delta", "alphabeta", "日本"]
    rows = [(i, "/d", "\n".join(" ".join(rng.choices(words, k=rng.randint(1, 5))) for _ in range(rng.randint(0, 5)))) for i in range(50)]
    made = from_texts(spark.createDataFrame(rows, "file_id long, folder string, text string"))
    return Corpus(made.files.cache(), made.chunks.cache())


ASKED = [
    "alpha", "alpha & beta", "alpha | x", "alpha & !beta", "2of(alpha,beta,delta)", "2of(alpha,beta,type:pdf) & it", '"gamma delta" & !x', "NEAR(alpha,delta,12)",
    "NEAR(x,x,9)", "alpha & type:pdf", "alpha & (type:pdf | size:<40)", "beta & !type:pdf & source:smb", "x & modified:2024-01-05..2024-01-20", "it & ext:md,txt", "alpha & name:doc_1 | delta & path:d/doc_2",
    "(alpha & !(beta | x)) | (delta & !(alpha & !it))", "alpha & alpha", "1of(alpha, 2of(beta, delta, x)) & it", "日本 & !nothing", "alphabeta", "doc_3 & alpha", "nothing",
]


@pytest.mark.parametrize("options", [Options(), Options(part_number_mode=True), Options(include_path_names=False)])
def test_stored_queries_equal_single_searches(library, options):
    asked = dict(enumerate([*ASKED, "ab-12", "ab*12 & x"] if options.part_number_mode else ASKED))
    got: dict = {}
    for r in stored.matches(library, asked, options).collect():
        got.setdefault(r["query_id"], set()).add((r["file_id"], r["hit_count"]))
    for i, query in asked.items():
        want = {(r["file_id"], r["hit_count"]) for r in search(library, query, options).results.collect()}
        assert got.get(i, set()) == want, query
    assert sum(map(len, got.values())) > 100


def test_a_thousand_queries_have_the_plan_of_ten(library):
    """Only tables grow with the number of queries."""
    rng = random.Random(1)
    words = ["alpha", "beta", "delta", "gamma", "alphabeta", "it", "x"]
    one = lambda: f"{rng.choice(words)} & !{rng.choice(words)}{rng.randint(0, 9)} | 2of({','.join(rng.sample(words, 3))})"
    plans = {}
    for n in (10, 1000):
        asked = {i: one() for i in range(n)}
        found = stored.matches(library, asked)
        rows = found.collect()
        plans[n] = found._jdf.queryExecution().optimizedPlan().toString().count("\n")
        assert {r["query_id"] for r in rows} <= set(asked) and rows
    assert plans[1000] == plans[10]


def test_queries_that_need_no_term_are_refused(library):
    for query in ("!alpha", "alpha | type:pdf", "type:pdf"):
        with pytest.raises(ValueError, match="without any of its terms"):
            stored.matches(library, {1: query})
    with pytest.raises(ValueError, match="confirmed"):
        stored.matches(library, {1: "alpha & confirmed:true"})
    with pytest.raises(ValueError, match="folded"):
        stored.matches(library, {1: "alpha"}, Options(case_sensitive=True))


def test_no_text_is_shuffled(library, monkeypatch):
    """Needles go to the chunks; what is dealt out by file are ids and counts."""
    plans, real = [], stored.storage.stored
    monkeypatch.setattr(stored.storage, "stored", lambda df, name: plans.append((name, df._jdf.queryExecution().executedPlan().toString())) or real(df, name))
    assert stored.matches(library, {1: "alpha & !beta", 2: "delta"}).count() > 0
    (plan,) = [p for n, p in plans if n == "met"]
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and plan.count("Exchange hashpartitioning") == 1


def test_words_are_counted_as_in_whole_chunks(spark):
    """Needles that overlap themselves, hold a gram again, are short or stand between odd blanks."""
    said = "aaaaaaaaa aaaab\tthatthathat that　x", "xx\x0bababababab ab\x0cthat", "𝒳aaaa日本aaaa日本 thathat"
    made = from_texts(spark.createDataFrame([(i, "/d", s) for i, s in enumerate(said)], "file_id long, folder string, text string"))
    library = Corpus(made.files.cache(), made.chunks.cache())
    asked = dict(enumerate(["aaaa", "abab", "that", "x", "日本", "aaaa & that & !x", '"aaaab that" | that']))
    got = {(r["query_id"], r["file_id"], r["hit_count"]) for r in stored.matches(library, asked).collect()}
    assert got == {(i, r["file_id"], r["hit_count"]) for i, query in asked.items() for r in search(library, query).results.collect()}


def test_the_corpus_is_not_stored_before_its_one_pass(spark, monkeypatch):
    def refused(*_):
        raise AssertionError("texts were written")

    monkeypatch.setattr(stored.storage, "bucketed", refused)
    monkeypatch.setattr(queries.source, "_kept", {})
    assert queries.QUERIES["stored_queries"](spark, "/root/testdata/sf0.001").count() >= 0
