"""Plans against a plain model of the language, on literal corpora."""

import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from sparkfolio import queries
from sparkfolio.functions import files as paths
from sparkfolio.functions import text as texts
from sparkfolio.lang import nodes as q
from sparkfolio.lang.parser import parse_query
from sparkfolio.operators import results as ops
from sparkfolio.plans.compile import Options
from sparkfolio.plans.search import evidence, search, with_evidence
from sparkfolio.sources.chunks import Corpus, corpus, lines

SF = "/root/testdata/sf0.001"
FILES = "file_id long, path string, name string, directory string, extension string, size long, mtime_ns long, source_type string, cloud_state string"


def make(spark, texts_, **columns):
    """A corpus with one file per list of chunks."""
    files, body = [], []
    for i, chunks in enumerate(texts_):
        ext = columns.get("ext", [".txt"])[i % len(columns.get("ext", [".txt"]))]
        files.append((i, f"/d/f{i}{ext}", f"f{i}{ext}", "/d", ext, 1000 * i, i * 86_400 * 10**9, ("local", "smb")[i % 2], "local"))
        body += [(i, k, "ocr" if c.startswith("OCR") else "line", f"{k}行", c) for k, c in enumerate(chunks, 2)]
    return corpus(spark.createDataFrame(files, FILES), spark.createDataFrame(body, "file_id long, chunk_index int, kind string, location string, text string"))


def ids(found):
    return sorted(r["file_id"] for r in found.results.select("file_id").collect())


GOLDEN = [
    ("AAA&BBB", [["AAA", "BBB"]], True, {}),
    ("2of(A1,B1,C1)", [["A1", "C1"]], True, {}),
    ("2of(A1,B1,C1)", [["A1"]], False, {}),
    ("A1 & !B1", [["A1", "B1"]], False, {}),
    ("!zzz", [["a"]], True, {}),
    ("NEAR(電源,ノイズ,10)", [["電源とノイズ"]], True, {}),
    ("NEAR(電源,ノイズ,2)", [["電源とノイズ"]], False, {}),
    ("NEAR(電源,ノイズ,3)", [["電源とノイズ"]], True, {}),
    ("NEAR(ノイズ,電源,3)", [["電源とノイズ"]], True, {}),
    ("NEAR(電源,ノイズ,100)", [["電源", "ノイズ"]], False, {}),
    ("NEAR(ab,ab,4)", [["ab..ab"]], True, {}),
    ("NEAR(ab,ab,3)", [["ab..ab"]], False, {}),
    ("NEAR(ab,ab,9)", [["ab"]], False, {}),
    ("abc", [["ＡＢＣ"]], True, {}),
    ("abc", [["ＡＢＣ"]], False, {"ignore_width": False}),
    ("Abc", [["abc"]], False, {"case_sensitive": True}),
    ("Abc & !abc", [["Abc"]], True, {"case_sensitive": True}),
    *[("ABC-123", [[t]], True, {"part_number_mode": True}) for t in ("ABC-123", "ABC123", "ＡＢＣ－１２３", "ABC 123")],
    ("2SC4117", [["2SC411T"]], False, {"part_number_mode": True}),
    ("ABC*123", [["ABC-999-123"]], True, {"part_number_mode": True}),
    ("ABC*123", [["ABC-999"]], False, {"part_number_mode": True}),
    ("ABC*123", [["ABC-999-123"]], False, {}),
    (r'"a\\E.b"', [[r"x a\E.b y"]], True, {}),
    ("ocr:true & a", [["OCR a"]], True, {}),
    ("ocr:true", [["OCR a"]], True, {}),
    ("ocr:true & a", [["a"]], False, {}),
    ("name:f0", [["a"]], True, {}),
    ("f0.txt", [["a"]], True, {}),
    ("f0.txt", [["a"]], False, {"include_path_names": False}),
]


@pytest.mark.parametrize("query, texts_, accepted, options", GOLDEN)
def test_golden(spark, query, texts_, accepted, options):
    assert ids(search(make(spark, texts_), query, Options(**options))) == ([0] if accepted else [])


def test_counts_terms_labels_evidence(spark):
    c = make(spark, [["AAA AAA zz", "aaa", "AAA", "AAA"], ["BBB"], ["CCC x", "AAA"]])
    rows = {r["file_id"]: r for r in with_evidence(c, search(c, "2of(AAA,CCC,BBB) | BBB")).collect()}
    assert sorted(rows) == [1, 2]
    assert rows[1]["displays"] == ["BBB"] and rows[2]["displays"] == ["一致:AAA、CCC / 未一致:BBB（2/3）"]
    rows = with_evidence(c, search(c, "AAA & !ZZZ")).orderBy("file_id").collect()
    assert [r["hit_count"] for r in rows] == [5, 1] and [r["hit_count_first"] for r in rows] == [2, 1]
    assert [e["location"] for e in rows[0]["evidence"]] == ["2行", "3行", "4行"]
    assert rows[0]["matched_terms"] == ["AAA"] and rows[0]["score"] == 0.6125
    assert search(c, "f1 & BBB").results.first()["score"] == pytest.approx(0.8575, abs=1e-4)
    assert evidence(c, search(c, "NEAR(aaa,zz,9)")).filter("term like 'NEAR%'").count() == 1


VOCABULARY = ["ab", "bc", "cd", "a", "xyz"]


def random_tree(rng, depth=3):
    kind = rng.choice(["term"] * 3 + ["and", "or", "not", "k", "near", "meta"] if depth else ["term", "meta"])
    if kind == "term":
        return q.Term(rng.choice(VOCABULARY))
    if kind == "near":
        return q.Near(q.Term(rng.choice(VOCABULARY)), q.Term(rng.choice(VOCABULARY)), rng.randint(1, 6))
    if kind == "meta":
        return rng.choice([q.Meta("type", "eq", "pdf"), q.Meta("size", "ge", "4000"), q.Meta("source", "eq", "smb"), q.Meta("modified", "le", "1970-01-04"), q.Meta("name", "contains", "f1")])
    if kind == "not":
        return q.Not(random_tree(rng, depth - 1))
    children = tuple(random_tree(rng, depth - 1) for _ in range(rng.randint(2, 3)))
    return q.AtLeast(rng.randint(1, len(children)), children) if kind == "k" else (q.And if kind == "and" else q.Or)(children)


def model(node, i, chunks, ext):
    """Whether file i matches, by the meaning of the language."""
    everything = [f"f{i}{ext}", f"/d/f{i}{ext}", *chunks]
    if isinstance(node, q.Term):
        return any(node.text in c for c in everything)
    if isinstance(node, q.Near):
        starts = lambda c, w: [m.start() for m in re.finditer(f"(?={re.escape(w)})", c)]
        if node.left == node.right:
            return any(len(s := starts(c, node.left.text)) > 1 and s[-1] - s[0] <= node.distance for c in everything)
        return any(abs(x - y) <= node.distance for c in everything for x in starts(c, node.left.text) for y in starts(c, node.right.text))
    if isinstance(node, q.Meta):
        return {"type": ext == ".pdf", "size": 1000 * i >= 4000, "source": i % 2 == 1, "modified": i <= 3, "name": "f1" in f"f{i}{ext}"}[node.field]
    if isinstance(node, q.Not):
        return not model(node.child, i, chunks, ext)
    held = [model(c, i, chunks, ext) for c in node.children]
    return sum(held) >= node.count if isinstance(node, q.AtLeast) else all(held) if isinstance(node, q.And) else any(held)


def test_random_queries_agree_with_the_model_with_and_without_pruning(spark):
    rng = random.Random(11)
    said = [["".join(rng.choices("abcdxyz ", k=rng.randint(1, 14))) for _ in range(rng.randint(0, 3))] for _ in range(12)]
    said = [[c for c in chunks if c.strip()] for chunks in said]
    made = make(spark, said, ext=[".txt", ".pdf", ".md"])
    c = Corpus(made.files.cache(), made.chunks.cache())
    for _ in range(25):
        tree = random_tree(rng)
        want = [i for i, chunks in enumerate(said) if model(tree, i, chunks, (".txt", ".pdf", ".md")[i % 3])]
        assert ids(search(c, tree)) == want, tree
        assert ids(search(c, tree, prefilter=False)) == want, tree


def test_pruning_reaches_the_scan(spark):
    plan = search(queries._docs(spark, SF), "thenwh").results._jdf.queryExecution().executedPlan().toString()
    assert "StringContains(norm_text,thenwh)" in plan
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan


def test_result_operators(spark):
    c = make(spark, [["a"], ["a a"], ["b"], ["a"]], ext=[".pdf", ".txt"])
    r = search(c, "a", confirmed=spark.createDataFrame([(3,)], "file_id long"), options=Options(include_path_names=False)).results
    assert [x["file_id"] for x in ops.sort(r, "hits").collect()] == [1, 0, 3]
    assert [x["file_id"] for x in ops.sort(r, "filename").collect()] == [0, 1, 3]
    assert [x["file_id"] for x in ops.page(ops.sort(r, "path"), 1, 1).collect()] == [1]
    assert {tuple(x) for x in ops.facets(r).collect()} == {("kind", "pdf", 1), ("kind", "text", 2), ("source", "local", 1), ("source", "smb", 2)}
    assert [x["file_id"] for x in ops.narrow(r, confirmed=True).collect()] == [3]
    assert ops.capped(r, 2)[0].count() == 2 and ops.capped(r, 2)[1].first()[0] and not ops.capped(r, 3)[1].first()[0]
    e = with_evidence(c, search(c, "a"))
    assert ops.clipboard(e).filter("file_id = 1").first()["text"].startswith("/d/f1.txt\n  [")
    assert set(ops.CSV.values()) <= set(ops.csv_rows(e).columns) and len(ops.CSV) == 12
    assert ops.coverage(search(c, "a", prefilter=False, options=Options(include_path_names=False)).judged).first().asDict() == {"discovered": 4, "scanned": 4, "matched": 3, "rejected": 1, "bytes": 6000, "units": 4}
    counters = spark.createDataFrame([(1200, 4, 3, 1, 3, 0, 2, 0, 1, 5, 0, 9)], ", ".join(f"{n} long" for n in ops.COUNTERS))
    assert ops.coverage_text(counters).first()[0] == "発見 1,200 / 検索完了 4 / Hit 3資料 / 索引 1 / 実読込 3 / OCR 0ページ / Online-only skip 2 / 警告 5"
    assert ops.summary_text(counters).first()[0] == "検索完了 4件 / 対象外 1 / 未取得 2 / 警告 5"


def test_pages_of_a_ranked_store_open_their_ranges_only(spark):
    c = make(spark, [["a " * (i % 7 + 1)] for i in range(60)])
    r = search(c, "a", options=Options(include_path_names=False)).results
    want = [x["file_id"] for x in ops.sort(r, "hits").collect()]
    ranked = ops.Ranked(r, "hits", ranges=6)
    assert ranked.total == 60 and len(ranked.starts) > 3
    for offset, limit in ((0, 5), (7, 20), (55, 20), (60, 5), (0, 100)):
        got = ranked.page(offset, limit)
        assert [x["file_id"] for x in got.collect()] == want[offset : offset + limit]
    plan = ranked.page(20, 5)._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan and "PartitionFilters: [isnotnull(_range" in plan or "PartitionFilters: [_range" in plan


def test_starts_and_spans(spark):
    rng = random.Random(3)
    said = ["".join(rng.choices("abx", k=rng.randint(0, 30))) for _ in range(60)] + ["", "aaaa", "a.b\\Ea.b", "ab" * 50]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(said)], "i int, t string")
    for needle in ("a", "ab", "aa", "aba", "a.b", "\\E"):
        got = {r["i"]: r["at"] for r in df.select("i", texts.starts(F.col("t"), needle).alias("at")).collect()}
        assert got == {i: [m.start() for m in re.finditer(f"(?={re.escape(needle)})", s)] for i, s in enumerate(said)}
    for left, right, d in (("ab", "x", 3), ("x", "ab", 4), ("a", "ba", 2), ("a", "a", 5)):
        rows = df.select("i", texts.spans(F.col("t"), left, right, d).alias("s"), texts.near(F.col("t"), left, right, d).alias("near")).collect()
        for r in rows:
            at = lambda w, s=said[r["i"]]: [m.start() for m in re.finditer(f"(?={re.escape(w)})", s)]
            if left == right:
                want = [(at(left)[0], at(left)[-1])] if len(at(left)) > 1 and at(left)[-1] - at(left)[0] <= d else []
            else:
                near = [(a, min((b for b in at(right) if abs(a - b) <= d), key=lambda b: (abs(a - b), b), default=None)) for a in at(left)]  # noqa: B023
                want = [(a, b) for a, b in near if b is not None]
            assert [(x["left"], x["right"]) for x in r["s"]] == want and all(abs(x["left"] - x["right"]) == x["distance"] for x in r["s"])
            assert bool(r["s"]) == bool(r["near"])


def test_search_joins_without_a_shuffle(spark):
    for query in ("thenwh & !reed.", "!the", "2of(thenwh,ouque,type:pdf)"):
        found = search(queries._docs(spark, SF), query).results
        found.collect()
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "Exchange hashpartitioning" not in plan and "SelectedBucketsCount" in plan


def test_lines_are_cut_and_blank_ones_counted(spark):
    df = spark.createDataFrame([("a\n \n" + "x" * 8001 + "\n",)], "t string").select(F.explode(lines(F.col("t"))).alias("c")).select("c.line", F.length("c.text"))
    assert [tuple(r) for r in df.collect()] == [(1, 1), (3, 8000), (3, 1)]


def test_text_and_path_functions(spark):
    row = spark.range(1).select(
        paths.path_key(F.lit(r"C:\a\.\b\..\C.TXT"), caseless=True).alias("key"),
        paths.extension(F.lit("/a.b/c")).alias("none"),
        paths.extension(F.lit("/a/.hidden")).alias("hidden"),
        paths.kind(F.lit("XLSX")).alias("kind"),
        paths.source_type(F.lit(r"\\srv\x")).alias("smb"),
        paths.is_under(F.lit("/ab"), "/a").alias("under"),
        paths.human_size(F.lit(1536)).alias("size"),
        texts.page_of(F.lit("p 12/3")).alias("page"),
        texts.snippet(F.lit("x" * 300 + "needle" + "y" * 300), F.array(F.lit("yy"), F.lit("needle"))).alias("snippet"),
        texts.highlight(F.lit("A.b ab"), ["a.B"]).alias("marked"),
        texts.collapse_whitespace(F.lit(" a\r\n\t b ")).alias("flat"),
        paths.path_key(F.lit("/A/./b/../C.TXT")).alias("exact"),
    ).first()
    assert row["key"] == "c:/a/c.txt" and row["exact"] == "/A/C.TXT" and row["none"] == row["hidden"] == "" and row["kind"] == "excel" and row["smb"] == "smb" and not row["under"]
    assert row["size"] == "1.5 KB" and row["page"] == 12 and row["snippet"] == "..." + "x" * 130 + "needle" + "y" * 124 + "..." and row["marked"] == "<mark>A.b</mark> ab" and row["flat"] == "a b"
    assert [paths.column_letter(i) for i in (0, 25, 26, 701, 702)] == ["A", "Z", "AA", "ZZ", "AAA"]
    assert texts.canonical_part("ＡＢ－ー 1*") == "ab1"


ONLINE = {
    ("fast", "auto", False): "skip", ("fast", "auto", True): "skip", ("fast", "skip", False): "skip", ("fast", "skip", True): "skip",
    ("fast", "fetch", False): "read", ("fast", "fetch", True): "read", ("standard", "auto", False): "read", ("standard", "auto", True): "index",
    ("standard", "skip", False): "skip", ("standard", "skip", True): "skip", ("standard", "fetch", False): "read", ("standard", "fetch", True): "read",
    ("full", "auto", False): "read", ("full", "auto", True): "index", ("full", "skip", False): "skip", ("full", "skip", True): "skip",
    ("full", "fetch", False): "read", ("full", "fetch", True): "read",
}


def test_files_that_lie_online_only(spark):
    row = spark.range(1).select(*[paths.cloud_decision(F.lit("online"), F.lit(i), m, p).alias(f"{m} {p} {i}") for m, p, i in ONLINE], paths.cloud_decision(F.lit("local"), F.lit(True), "fast", "skip").alias("local")).first()
    assert {k: row[" ".join(map(str, k))] for k in ONLINE} == ONLINE and row["local"] == "read"


def _plain(frame):
    return sorted(tuple(str(round(v, 6) if isinstance(v, float) else v) for v in r) for r in frame)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "pages", "labels", "events", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, SF), con.sql(queries.ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert _plain(map(tuple, got.select(*columns).collect())) == _plain(want.select(", ".join(f'"{c}"' for c in columns)).fetchall())


def test_parse_of_root_filter(spark):
    c = make(spark, [["a"]])
    assert ids(search(c, "root:proj", roots=["/data/PROJ"])) == [0] and ids(search(c, parse_query("root:proj"), roots=["/x"])) == []


@pytest.mark.parametrize("name", ["meta_modified_range", "export_csv_projection", "segment_search"])
def test_days_after_the_made_up_times_begin_anew(spark, tmp_path, name):
    """Rows whose number passes the days after which stored times begin anew, and those that 64 bits of nanoseconds hold."""
    rows = [(i, "the thenwh reed.", "en", "src1", 16) for i in (*range(30, 60), *range(50_040, 50_060), *range(100_040, 100_060), 2_950_000)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = con.sql(queries.ORACLES[name]).fetchall()
    got = [tuple(r) for r in queries.QUERIES[name](spark, str(tmp_path)).collect()]
    assert _plain(got) == _plain(want) and want
