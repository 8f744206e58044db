import datetime
import io
import json
import random
import threading
import time
import zipfile
import zlib
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from sparkfolio import __main__ as command
from sparkfolio.lang.nodes import QueryError
from sparkfolio.operators import results as ops
from sparkfolio.plans import topk
from sparkfolio.plans.compile import Options
from sparkfolio.plans.search import compiled, search
from sparkfolio.session import Request, cancel, run
from sparkfolio.settings import Settings
from sparkfolio.sources import extract, index, listing, ocr_cache, storage
from sparkfolio.sources.chunks import Corpus, corpus, from_texts
from sparkfolio.sources.index import CorpusIndex
from sparkfolio.streaming import incremental, matcher

W = "http://w"


def _spin(spark):
    """A job that takes long."""
    spark.range(4, numPartitions=4).select(F.udf(lambda i: time.sleep(20))("id")).collect()


def _zip(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in parts.items():
            z.writestr(name, body)
    return out.getvalue()


def _pdf(*pages):
    """Pages of one line each, compressed streams, a map of codes for the second font."""
    out, kids = [], []
    for n, text in enumerate(pages):
        said = "".join(f"\\{c}" if c in "()\\" else c for c in text)
        body = zlib.compress(f"BT /F1 12 Tf 72 700 Td ({said[:4]}) Tj [({said[4:]}) -20 ( )] TJ 0 -14 Td /F2 12 Tf <0102> Tj ET".encode())
        kids.append(f"{10 + 2 * n} 0 R")
        out.append(f"{10 + 2 * n} 0 obj\n<</Type /Page /Parent 2 0 R /Contents {11 + 2 * n} 0 R>>\nendobj\n".encode())
        out.append(f"{11 + 2 * n} 0 obj\n<</Filter /FlateDecode /Length {len(body)}>>\nstream\n".encode() + body + b"\nendstream\nendobj\n")
    cmap = "1 beginbfchar <01> <96FB> endbfchar 1 beginbfrange <02> <03> <6E90> endbfrange"
    head = f"""%PDF-1.5
1 0 obj <</Type /Catalog /Pages 2 0 R>> endobj
2 0 obj <</Type /Pages /Kids [{' '.join(kids)}] /Resources <</Font <</F1 3 0 R /F2 4 0 R>>>>>> endobj
3 0 obj <</Type /Font>> endobj
4 0 obj <</Type /Font /ToUnicode 5 0 R>> endobj
5 0 obj <</Length {len(cmap)}>>
stream
{cmap}
endstream endobj
"""
    return head.encode() + b"".join(out)


def _write(root):
    (root / "sub").mkdir(parents=True)
    (root / "utf8.txt").write_text("AAA 評価\n\nBBB 電源\n", encoding="utf-8")
    (root / "sub" / "sjis.txt").write_bytes("電源ノイズ 測定".encode("cp932"))
    (root / "utf16.txt").write_bytes("温度 上昇".encode("utf-16"))
    (root / "data.dat").write_text("落下 試験", encoding="utf-8")
    (root / "binary.bin").write_bytes(bytes(range(256)) * 16)
    (root / "a.pdf").write_bytes(_pdf("AAA in a page", "two (words)"))
    (root / "old.xls").write_bytes(b"\xd0\xcf\x11\xe0")
    (root / "a.docx").write_bytes(_zip(**{"word/document.xml": f'<d xmlns="{W}"><p><t>AAA 落下</t></p><tbl><p><t>BBB</t></p></tbl></d>', "word/header1.xml": f'<d xmlns="{W}"><p><t>社外秘</t></p></d>'}))
    (root / "a.pptx").write_bytes(_zip(**{"ppt/slides/slide1.xml": f'<s xmlns="{W}"><p><t>AAA 耐久</t></p></s>', "ppt/slides/slide2.xml": f'<s xmlns="{W}" show="0"><p><t>CCC</t></p></s>', "ppt/notesSlides/notesSlide1.xml": f'<s xmlns="{W}"><p><t>BBB</t></p></s>'}))
    (root / "a.xlsx").write_bytes(
        _zip(
            **{
                "xl/workbook.xml": f'<w xmlns="{W}"><sheet name="評価"/><definedName name="範囲">評価!A1</definedName></w>',
                "xl/sharedStrings.xml": f'<s xmlns="{W}"><si><t>AAA</t></si></s>',
                "xl/worksheets/sheet1.xml": f'<s xmlns="{W}"><c r="A1" t="s"><v>0</v></c><c r="B2"><f>SUM(1,2)</f><v>3</v></c></s>',
                "xl/comments1.xml": f'<c xmlns="{W}"><comment ref="A3"><t>注</t></comment></c>',
            }
        )
    )
    (root / "evil.docx").write_bytes(_zip(**{"word/document.xml": '<!DOCTYPE x [<!ENTITY a "b">]><d/>'}))
    (root / "a.zip").write_bytes(_zip(**{"inner.txt": "異音 確認", "../up.txt": "no", "deep.zip": _zip(**{"x.txt": "深い", "deeper.zip": _zip(**{"y.txt": "no"})})}))


def test_scan_and_extract(spark, tmp_path):
    root = tmp_path / "corpus"
    _write(root)
    files = extract.scan(spark, f"{root}; {root}")
    assert files.count() == 12 and files.filter("name = 'sjis.txt'").first()["extension"] == ".txt"
    named = dict(map(tuple, files.select("file_id", "name").collect()))
    said = {}
    for r in extract.extract(spark, files).collect():
        said.setdefault(named[r["file_id"]], []).append((r["kind"], r["location"], r["text"].rstrip("\n")) if r["code"] is None else r["code"])
    assert said["utf8.txt"] == [("line", "1行", "AAA 評価"), ("line", "3行", "BBB 電源")]
    assert said["sjis.txt"][0][2] == "電源ノイズ 測定" and said["utf16.txt"][0][2] == "温度 上昇" and said["data.dat"][0][2] == "落下 試験"
    assert said["binary.bin"] == said["old.xls"] == ["unsupported"] and said["evil.docx"] == ["unsafe_xml"]
    assert said["a.pdf"] == [("page", "1ページ", "AAA in a page \n電源"), "no_recogniser", ("page", "2ページ", "two (words) \n電源")]
    assert said["a.docx"] == [("paragraph", "段落1", "AAA 落下"), ("table", "表1", "BBB"), ("header", "段落1", "社外秘")]
    assert ("slide", "スライド2（非表示）", "CCC") in said["a.pptx"] and ("note", "スライド1", "BBB") in said["a.pptx"]
    assert {("cell", "評価!A1", "AAA"), ("formula", "評価!B2", "=SUM(1,2)"), ("cell", "評価!B2", "3"), ("defined_name", "名前", "範囲 評価!A1"), ("comment", "A3", "注")} <= set(said["a.xlsx"])
    assert said["a.zip"] == [("line", "a.zip > inner.txt / 1行", "異音 確認"), "zip_path", ("line", "a.zip > deep.zip / deep.zip > x.txt / 1行", "深い"), "zip_depth"]
    chunks = extract.extract(spark, files, str(root)).filter("code is null").drop("code", "message", "severity")
    c = corpus(files, chunks)
    assert sorted(r["name"] for r in search(c, "AAA & BBB").results.collect()) == ["a.docx", "a.pptx", "utf8.txt"]
    told = extract.issues(extract.extract(spark, files, str(root)), files).collect()
    assert sorted((r["code"], r["severity"]) for r in told) == [("no_recogniser", "warn"), ("unsafe_xml", "skip"), ("unsupported", "skip"), ("unsupported", "skip"), ("zip_depth", "warn"), ("zip_path", "warn")]


def test_all_names_are_listed_and_told_apart(spark, tmp_path):
    for name in ("A/x.txt", "a/x.txt", "a/X.txt", "_draft.txt", ".note.txt", "plain.txt", "_h/.i/y.txt", "per%cent 日本.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(f"said in {name}")
    (tmp_path / "loop").symlink_to(tmp_path)
    files = extract.scan(spark, f"{tmp_path};{tmp_path}/a\n{tmp_path}/")
    rows = {r["path"].removeprefix(f"{tmp_path}/"): r for r in files.collect()}
    assert set(rows) == {"A/x.txt", "a/x.txt", "a/X.txt", "_draft.txt", ".note.txt", "plain.txt", "_h/.i/y.txt", "per%cent 日本.txt"}
    assert all(r["size"] == (tmp_path / n).stat().st_size and r["mtime_ns"] == (tmp_path / n).stat().st_mtime_ns for n, r in rows.items())
    said = extract.extract(spark, files).join(files.select("file_id", "path"), "file_id").collect()
    assert sorted(r["text"] for r in said) == sorted(f"said in {n}" for n in rows) and all(r["code"] is None for r in said)
    assert extract.scan(spark, str(tmp_path), caseless=True).count() == 6 and extract.scan(spark, str(tmp_path), subfolders=False).count() == 4
    found = run(spark, Request([str(tmp_path)], "said"))
    assert found.results.count() == 8
    assert {r["path"] for r in run(spark, Request([str(tmp_path / "none")], "x")).issues.collect()} == {str(tmp_path / "none")}


def test_a_wide_tree_is_dealt_to_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(listing, "PARTS", 4)
    for i in range(30):
        (tmp_path / f"d{i % 7}" / f"e{i % 3}").mkdir(parents=True, exist_ok=True)
        (tmp_path / f"d{i % 7}" / f"e{i % 3}" / f"f{i}").write_text("x")
        (tmp_path / f"g{i}").write_text("x")
    dealt = listing._deal([str(tmp_path)], True)
    assert len(dealt) == 4
    names = [r for whole, flat in dealt for b in listing.walk(listing.Folders(whole, flat)) for r in b["path"].to_pylist()]
    assert len(names) == len(set(names)) == 60


def test_listing_as_a_stream(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(listing, "SETTLED", 0.0)
    spark.dataSource.register(listing.FolderListing)
    (tmp_path / "in").mkdir()
    stream = spark.readStream.format("folder_listing").options(roots=json.dumps([str(tmp_path / "in")])).load()
    q = stream.writeStream.format("memory").queryName("arrived").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        for n in ("_a", "b"):
            (tmp_path / "in" / n).write_text(n)
            until = time.time() + 60
            while time.time() < until and n not in {r["path"][-len(n) :] for r in spark.table("arrived").collect()}:
                time.sleep(0.2)
        assert sorted(r["path"] for r in spark.table("arrived").collect()) == [str(tmp_path / "in" / n) for n in ("_a", "b")]
    finally:
        q.stop()


def test_lines_end_where_text_files_end_them():
    assert [c[1:] for c in extract.text_lines("a\x0cb\u2028c\x85d\r\ne\rf\n\ng".encode())] == [("1行", "a\x0cb\u2028c\x85d\r\n"), ("2行", "e\r"), ("3行", "f\n"), ("5行", "g")]


def test_scanned_pages_go_to_the_recogniser(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(_pdf("x"))
    extract.recognise_with(lambda data, page: f"seen on {page}")
    try:
        rows = extract.extract(spark, extract.scan(spark, str(tmp_path)), str(tmp_path)).collect()
    finally:
        extract.recognise_with(None)
    assert [(r["kind"], r["text"]) for r in rows] == [("page", "x \n電源"), ("ocr", "seen on 0")]


def test_office_parts():
    said = lambda reader, **parts: [c for c in reader("x", _zip(**parts))]
    box = f'<d xmlns="{W}" xmlns:m="http://m"><p><t>before</t><m:AlternateContent><m:Choice><txbxContent><p><t>in a box</t></p></txbxContent></m:Choice><m:Fallback><txbxContent><p><t>in a box</t></p></txbxContent></m:Fallback></m:AlternateContent></p></d>'
    assert said(extract.read_word, **{"word/document.xml": box}) == [("paragraph", "段落1", "before"), ("textbox", "テキストボックス", "in a box")]
    rel = lambda **x: "<r>" + "".join(f'<Relationship Id="{i}" Target="{t}"/>' for i, t in x.items()) + "</r>"
    sheet = lambda v: f'<s xmlns="{W}"><c r="A1"><v>{v}</v></c></s>'
    book = f'<w xmlns="{W}" xmlns:r="http://r"><sheet name="one" r:id="b"/><sheet name="two" r:id="a"/></w>'
    got = said(extract.read_sheets, **{"xl/workbook.xml": book, "xl/_rels/workbook.xml.rels": rel(a="worksheets/sheet1.xml", b="/xl/worksheets/sheet2.xml"), "xl/worksheets/sheet1.xml": sheet(1), "xl/worksheets/sheet2.xml": sheet(2)})
    assert got[2:] == [("cell", "two!A1", "1"), ("cell", "one!A1", "2")]
    slide = lambda t: f'<s xmlns="{W}"><p><t>{t}</t></p></s>'
    show = f'<p xmlns="{W}" xmlns:r="http://r"><sldId r:id="y"/><sldId r:id="x"/></p>'
    got = said(extract.read_slides, **{"ppt/presentation.xml": show, "ppt/_rels/presentation.xml.rels": rel(x="slides/slide1.xml", y="slides/slide2.xml"), "ppt/slides/slide1.xml": slide("last"), "ppt/slides/slide2.xml": slide("first"), "ppt/charts/chart1.xml": f'<c xmlns="{W}"><t>title</t><v>7</v></c>', "ppt/diagrams/data1.xml": f'<c xmlns="{W}"><t>step</t></c>'})
    assert got == [("slide", "スライド1", "first"), ("slide", "スライド2", "last"), ("chart", "グラフ", "title"), ("chart", "グラフ", "7"), ("textbox", "SmartArt", "step")]


def test_cell_spellings():
    day = datetime.datetime(2025, 1, 2, 3, 4, 5)
    assert extract.cell_spellings(True) == ["True", "TRUE", "true"] and extract.cell_spellings(None) == []
    assert extract.cell_spellings(7) == ["7", "7.0", "7.00", "007", "0007", "00007"]
    assert extract.cell_spellings(7.0, "0.000") == ["7.0", "7", "7.00", "007", "0007", "00007", "7.000"]
    assert extract.cell_spellings(1.25, "0.0") == ["1.25", "1.2"] and extract.cell_spellings("a") == ["a"]
    assert extract.cell_spellings(day)[1:] == ["2025/01/02", "2025-01-02", "2025/1/2", "2025/01/02 03:04", "2025/01/02 03:04:05"]


def test_encodings():
    assert extract.sniff_encoding("ab 日本".encode("utf-16-le")) == "utf-16-le" and extract.sniff_encoding("ab".encode("utf-16-be")) == "utf-16-be"
    assert extract.sniff_encoding("日本 a".encode("cp932")) == "cp932" and extract.sniff_encoding("日本".encode()) == "utf-8"


def test_prefilter_decides_from_the_list(spark):
    rows = [(1, "/a.txt", ".txt", 10, "local"), (2, "/b.txt", ".txt", 60 << 20, "local"), (3, "/c.zip", ".zip", 1, "local"), (4, "/d.xls", ".xls", 1, "local"), (5, "/e.md", ".md", 1, "online"), (6, "/f.md", ".md", 1, "local"), (7, "/g", "", 1, "local")]
    files = spark.createDataFrame(rows, "file_id long, path string, extension string, size long, cloud_state string")
    known = spark.createDataFrame([(5,), (6,)], "file_id long")
    decide = lambda **x: [r["decision"] for r in extract.prefilter(files, indexed=known, **x).orderBy("file_id").collect()]
    assert decide(kinds=["text", "excel", "?"]) == ["read", "skip_size", "skip_type", "skip_type", "index", "index", "read"]
    assert decide(mode="fast") == ["read", "skip_size", "read", "skip_type", "skip_online", "index", "read"]
    assert decide(mode="full", policy="fetch", limits={"text": 1 << 30}) == ["read", "read", "read", "skip_type", "read", "read", "read"]


def test_session(spark, tmp_path):
    root = tmp_path / "corpus"
    _write(root)
    events = []
    idx = CorpusIndex(spark, str(tmp_path / "index"))
    ask = Request([str(root)], "AAA & BBB")
    first = run(spark, ask, index=idx, confirmed=[str(root / "utf8.txt")], listener=events.append)
    names = lambda found: sorted((r["name"], r["from_index"], r["confirmed"]) for r in found.results.collect())
    assert names(first) == [("a.docx", False, False), ("a.pptx", False, False), ("utf8.txt", False, True)] and not first.truncated
    row = first.coverage.first()
    assert (row["discovered"], row["scanned"], row["hits"], row["indexed"], row["read"], row["skipped_type"]) == (12, 9, 3, 0, 9, 3)
    assert {r["code"] for r in first.issues.collect()} == {"unsafe_xml", "no_recogniser"}
    assert [e.kind for e in events][:2] == ["started", "discovered"] and events[-1].kind == "finished" and events[-1].values["hits"] == 3
    (root / "utf8.txt").write_text("AAA only\n", encoding="utf-8")
    (root / "a.docx").unlink()
    again = run(spark, ask, index=idx)
    assert names(again) == [("a.pptx", True, False)]
    row = again.coverage.first()
    assert row["indexed"] >= 6 and row["indexed"] + row["read"] == 8
    assert idx.under(str(root)).filter("name = 'a.docx'").count() == 0
    capped = run(spark, replace(ask, query="AAA | 評価", max_results=1, mode="full"))
    assert capped.truncated and capped.results.count() == 1 and "result_cap" in {r["code"] for r in capped.issues.collect()}
    one = again.results.first()["file_id"]
    assert [e["term"] for e in again.rescan(one).first()["evidence"]] == ["AAA", "BBB"]
    storage.remove(spark, _folder_of(idx))
    assert names(run(spark, ask, index=idx)) == [("a.pptx", False, False)]
    with pytest.raises(QueryError):
        run(spark, replace(ask, query="("), listener=events.append)
    assert events[-1].kind == "failed"


def test_a_file_that_changes_is_read_again(spark, tmp_path):
    (tmp_path / "a.txt").write_text("old")
    (tmp_path / "gone.txt").write_text("newer too")

    def meanwhile(event):
        if event.kind == "discovered":
            (tmp_path / "a.txt").write_text("newer words")
            (tmp_path / "gone.txt").unlink()

    found = run(spark, Request([str(tmp_path)], "newer"), listener=meanwhile)
    assert found.results.count() == 1 and sorted((r["path"][-5:], r["code"]) for r in found.issues.collect()) == [("a.txt", "file_changed_retry"), ("e.txt", "file_changed_retry")]
    found.close()
    with pytest.raises(Exception):  # noqa: B017  what it had stored is gone
        found.results.count()


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "a.txt").write_text("alpha beta\nalpha")
    args = ["--search", str(tmp_path / "docs"), "--settings", str(tmp_path / "s.json"), "--query"]
    assert command.main([*args, "alpha", "--json", "--out", str(tmp_path / "out.json")]) == 0
    shown = json.loads(capsys.readouterr().out)
    assert shown["results"] == [{"path": str(tmp_path / "docs" / "a.txt"), "kind": "text", "hits": 2, "displays": ["alpha"], "from_index": False}] and shown["coverage"]["hits"] == 1
    assert json.loads((tmp_path / "out.json").read_text()) == shown
    assert command.main([*args, "beta", "--limit", "1"]) == 0
    lines = capsys.readouterr().out.splitlines()
    assert lines[0].startswith("発見 1 / 検索完了 1 / Hit 1資料") and lines[1] == f"    1  text      {tmp_path}/docs/a.txt"
    assert command.main([*args, "("]) == 2 and command.main([]) == 2 and command.main(["--diagnostics"]) == 0
    kept = Settings.load(tmp_path / "s.json")
    assert kept.history == ["beta", "alpha"] and kept.recent_roots == [str(tmp_path / "docs")]


def test_settings(tmp_path):
    path = tmp_path / "s.json"
    s = Settings.load(path)
    for i in range(250):
        s.remember(f"q{i % 230}")
    assert len(s.history) == 200 and s.history[0] == "q19"
    assert s.toggle_confirmed("/a") and s.confirmed == ["/a"] and not s.toggle_confirmed("/a")
    s.mode = "full"
    s.keep_preset("mine")
    s.mode = "fast"
    s.save(path)
    t = Settings.load(path)
    assert t == s
    t.apply_preset("mine")
    assert t.mode == "full" and t.history == s.history
    path.write_text('{"mode": "odd", "query": 7, "spaces": "AND"}')
    assert Settings.load(path) == Settings(spaces="AND")
    path.write_text("{")
    assert Settings.load(path) == Settings() and len(list(tmp_path.glob("s.broken-*"))) == 1


def test_index_of_nothing_is_no_error(spark, tmp_path):
    found = run(spark, Request([str(tmp_path)], "a"), index=CorpusIndex(spark, str(tmp_path / "i")))
    assert found.results.count() == 0 and found.coverage.first()["discovered"] == 0


def _rows(spark, *pairs):
    return spark.createDataFrame([(i, "/x", t) for i, t in pairs], "file_id long, folder string, text string")


def _refresh(idx, rows, **more):
    made = from_texts(rows)
    return dict(map(tuple, idx.refresh(made.files.drop("name_norm", "path_norm"), made.chunks.filter("chunk_index > 1").drop("norm_text", "part_text"), **more).collect()))


def test_index_keeps_up(spark, tmp_path):
    idx = CorpusIndex(spark, str(tmp_path / "index"))
    assert idx.load() is None
    assert _refresh(idx, _rows(spark, (1, "alpha"), (2, "beta"), (3, ""))) == {1: "added", 2: "added", 3: "added"}
    assert idx.status().first()["files"] == 3 and {r["status"] for r in idx.load().files.collect()} == {"ok", "empty"}
    assert _refresh(idx, _rows(spark, (1, "alpha"), (2, "beta changed"), (4, "alpha"))) == {1: "unchanged", 2: "updated", 3: "removed", 4: "added"}
    assert sorted(r["file_id"] for r in search(idx.load(), "alpha | changed").results.collect()) == [1, 2, 4]
    assert _refresh(idx, _rows(spark, (5, "x")), complete=False) == {5: "added"}
    assert idx.load().files.count() == 4
    assert _refresh(idx, _rows(spark, (5, "x")), settings="other", complete=False) == {5: "updated"}
    idx.remove(F.col("file_id") == 1)
    assert idx.load().files.count() == 3
    idx.clear()
    assert idx.load().files.count() == 0


def _folder_of(idx, table="files"):
    commit = idx._now()[1]
    return f"{idx._folder(commit, table)}/segment={commit['segments'][-1].id}"


def _words(i):
    rng = random.Random(i)
    return " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(60))


def test_index_writes_what_arrives(spark, tmp_path):
    idx = CorpusIndex(spark, str(tmp_path / "index"), buckets=2, fanout=4)
    texts = {i: f"alpha {i} {_words(i)}" for i in range(20)}
    for i in range(0, 20, 4):
        _refresh(idx, _rows(spark, *[(j, texts[j]) for j in range(i, i + 4)]), complete=False)
    segments = idx._now()[1]["segments"]
    assert [s.level for s in segments] == [1, 0] and [s.files for s in segments] == [16, 4]
    texts[7] += " beta"
    before = {s.id for s in segments}
    assert _refresh(idx, _rows(spark, (7, texts[7]), (30, "alpha new")), complete=False) == {7: "updated", 30: "added"}
    now = idx._now()[1]
    assert before < {s.id for s in now["segments"]} and len(now["segments"]) == 3 and len(now["gone"]) == 1  # nothing was rewritten
    assert [r["file_id"] for r in search(idx.load(), "beta").results.collect()] == [7] and idx.load().files.count() == 21
    assert _refresh(idx, _rows(spark, *texts.items(), (30, "alpha new"))) == dict.fromkeys([*range(20), 30], "unchanged") and idx._now()[1] == now
    idx.remove(F.col("file_id") < 5)
    idx.compact()
    (one,) = idx._now()[1]["segments"]
    assert one.files == 16 and idx._now()[1]["gone"] == [] and idx.load().chunks.select("file_id").distinct().count() == 16
    idx.verify()
    old = idx._commits()
    assert idx.vacuum(keep=1) == 7 and idx._commits() == old[-1:] and sorted(r["file_id"] for r in idx.search("alpha").results.collect()) == [*range(5, 20), 30]
    idx.clear()
    idx.compact()
    assert idx.load().files.count() == idx.load().chunks.count() == 0 and idx.size() == 0 and idx.search("alpha").results.count() == 0
    assert _refresh(idx, _rows(spark, (1, "alpha"))) == {1: "added"} and idx.search("alpha").results.count() == 1


def test_bytes_written_follow_what_arrives(spark, tmp_path):
    """Twelve batches: each file is written once, and once more a level, never with all others."""
    written = []
    real = CorpusIndex._write

    def counted(self, *args):
        made = real(self, *args)
        written.append(made.bytes)
        return made

    idx = CorpusIndex(spark, str(tmp_path / "index"), buckets=1, fanout=4)
    CorpusIndex._write = counted
    try:
        for i in range(12):
            _refresh(idx, _rows(spark, (i, _words(i))), complete=False)
    finally:
        CorpusIndex._write = real
    own = sum(sorted(written)[:12])
    assert len(written) == 15 and sum(written) < 2.5 * own and idx.load().files.count() == 12


def test_a_grown_index_gets_more_buckets(spark, tmp_path, monkeypatch):
    idx = CorpusIndex(spark, str(tmp_path / "index"), buckets=1)
    for i in range(2):
        _refresh(idx, _rows(spark, *[(i * 10 + j, _words(i * 10 + j)) for j in range(10)]), complete=False)
    monkeypatch.setattr(index, "BUCKET_BYTES", idx.size() // 4)
    idx.compact()
    assert idx._now()[1]["buckets"] >= 3 and idx.load().files.count() == 20 and idx.vacuum(keep=1) == 2 and idx.load().chunks.count() == 60


def test_segments_and_buckets_that_a_search_opens(spark, tmp_path):
    idx = CorpusIndex(spark, str(tmp_path / "index"), buckets=16)
    for day in range(4):
        rows = [(i, f"{_words(i)} " + ("needle" if i == 205 else f"only{'abcd'[day]}x")) for i in range(day * 100, day * 100 + 100)]
        _refresh(idx, _rows(spark, *rows), complete=False)
    opened = lambda query: idx.segments_for(compiled(query))
    ids = [s.id for s in idx._now()[1]["segments"]]
    assert opened("needle") == [ids[2]] and opened("onlyax | onlydx") == sorted([ids[0], ids[3]]) and opened("onlyax & onlydx") == [] and len(opened("!needle")) == 4
    assert opened("modified:2024-01-01..2024-02-01") == [ids[0]] and opened("modified:>=2024-12-01") == [ids[3]] and len(opened("size:>1")) == 4 and opened("size:>1GB") == []
    assert opened("ext:zip") == [] and len(opened("type:pdf | needle")) == 4 and opened("source:removable") == []
    found = idx.search("needle & !zzz").results
    assert [r["file_id"] for r in found.collect()] == [205]

    some, every = idx.opened("needle").chunks, _bytes_read(idx.load().chunks)
    assert 0 < _bytes_read(some) < 0.3 * every  # one segment of four, and of that
    assert "SelectedBucketsCount: 1 out of 16" in some._jdf.queryExecution().executedPlan().toString()


def _bytes_read(df):
    """What the scans of a finished plan say that they have read."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    total, stack = 0, [plan]
    while stack:
        node = stack.pop()
        if hasattr(node, "finalPhysicalPlan") and node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            stack.append(node.finalPhysicalPlan())
            continue
        metrics = node.metrics()
        if metrics.contains("filesSize"):
            total += metrics.apply("filesSize").value()
        children = node.children()
        stack += [children.apply(i) for i in range(children.size())]
    return total


@pytest.mark.parametrize("options", [Options(), Options(part_number_mode=True), Options(case_sensitive=True)])
def test_index_searches_equal_the_plain_scan(spark, tmp_path, options):
    rng = random.Random(4)
    rows = [(i, "\n".join("".join(rng.choices(["ab", "abc", "ABC", "-1", " ", "xyz", "needle", "ab*c", "日本"], k=12)) for _ in range(4))) for i in range(60)]
    idx = CorpusIndex(spark, str(tmp_path / "index"), buckets=4)
    _refresh(idx, _rows(spark, *rows[:40]))
    _refresh(idx, _rows(spark, *rows[10:]))
    plain = from_texts(_rows(spark, *rows[10:]))
    plain = Corpus(plain.files.cache(), plain.chunks.cache())
    asked = ["abcneedle & !xyzxyz", "2of(abc-1, xyz日本, ABCABC)", "NEAR(needle,xyzabc,20) | doc_1 & ab"]
    for query in [*asked, "xyz日本 | type:pdf", "abc*xyz & needle", '"needle xyz" | 1of(ABCxyz, ab-1ab)']:
        want = sorted((r["file_id"], r["hit_count"], r["score"]) for r in search(plain, query, options).results.collect())
        assert sorted((r["file_id"], r["hit_count"], r["score"]) for r in idx.search(query, options).results.collect()) == want, query
        if query not in asked:
            continue
        assert {r["file_id"] for r in idx.candidates(query, options).collect()} >= {i for i, _, _ in want}, query
        first = [(r["file_id"], r["score"]) for r in topk.best(idx, query, 5, options).results.collect()]
        assert first == [(r["file_id"], r["score"]) for r in ops.sort(search(plain, query, options).results).limit(5).collect()], query


def test_the_best_results_are_found_without_judging_all(spark, tmp_path):
    idx = CorpusIndex(spark, str(tmp_path / "index"), buckets=4)
    _refresh(idx, _rows(spark, *[(i, "alpha " * 30 + "beta " * (i % 10 == 0) + "gamma " * (i % 40 == 0)) for i in range(200)]))
    got = topk.best(idx, "alpha, beta, gamma", 4)
    want = ops.sort(idx.search("alpha, beta, gamma").results).limit(4)
    assert [r["file_id"] for r in got.results.collect()] == [r["file_id"] for r in want.collect()]
    assert got.candidates == 200 and got.judged == 5 and got.groups == 1
    assert topk.best(idx, "nothing", 4).results.count() == 0


def test_index_keeps_long_texts_whole(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(index, "CHUNK_CHARS", 50)
    monkeypatch.setattr(index, "FILE_CHARS", 200)
    idx = CorpusIndex(spark, str(tmp_path / "index"))
    _refresh(idx, _rows(spark, (1, "x" * 60 + "needle"), (2, ("y" * 40 + "\n") * 9 + "needle"), (3, "needle"), (4, "")))
    assert {r["file_id"]: r["status"] for r in idx.load().files.collect()} == {1: "partial", 2: "too_large", 3: "ok", 4: "empty"}
    assert search(idx.load(), "needle").results.count() == 3


def test_index_stops_growing_and_tells_damage(spark, tmp_path):
    idx = CorpusIndex(spark, str(tmp_path / "index"), max_bytes=1)
    assert _refresh(idx, _rows(spark, (1, "alpha"), (2, "beta"))) == {1: "added", 2: "added"}
    assert _refresh(idx, _rows(spark, (1, "alpha"), (2, "beta new"), (3, "gamma"))) == {1: "unchanged", 2: "updated", 3: "full"}
    assert idx.known_count() == 2 and idx.known_count("/x") == 2 and idx.under("/y").count() == 0
    idx.verify()
    stale = CorpusIndex(spark, idx.path)
    stale._now = lambda n=idx._now(): n  # a writer that began before
    idx.remove(F.col("file_id") == 1)
    with pytest.raises(index.Conflict):
        stale.remove(F.col("file_id") == 2)
    idx.forget(spark.createDataFrame([(77,)], "file_id long"))
    assert idx.known_count() == 1
    storage.remove(spark, _folder_of(idx))
    with pytest.raises(index.IndexUnavailable):
        idx.verify()
    made = from_texts(_rows(spark, (9, "new")))
    idx.rebuild(made.files.drop("name_norm", "path_norm"), made.chunks.filter("chunk_index > 1").drop("norm_text", "part_text"))
    idx.verify()
    assert idx.known_count() == 1


@pytest.mark.parametrize("query", ["alpha & !beta", "2of(alpha,beta,type:pdf) & !gamma | NEAR(alpha,beta,9)", "!type:pdf & !alpha | gamma & size:>30"])
def test_files_are_decided_as_their_chunks_arrive(spark, tmp_path, query):
    rng = random.Random(6)
    made = from_texts(_rows(spark, *[(i, "\n".join(rng.choice(["alpha", "beta alpha", "gamma", "delta", "other"]) for _ in range(rng.randint(0, 9)))) for i in range(40)]))
    c = Corpus(made.files.cache(), made.chunks.cache())
    rows = matcher.with_ends(c.chunks)
    rows.orderBy(F.rand(3)).repartition(12).write.parquet(str(tmp_path / "in"))
    q = matcher.decided(spark, str(tmp_path / "in"), rows.schema, query, str(tmp_path / "out"), str(tmp_path / "cp"), c.files, per_trigger=3)
    assert q.awaitTermination(300) and q.exception() is None
    got = {r["file_id"]: r for r in spark.read.schema(matcher.SCHEMA).parquet(str(tmp_path / "out")).collect()}
    want = {r["file_id"] for r in search(c, query).results.collect()}
    assert len(got) == 40 and {i for i, r in got.items() if r["outcome"] == "accept"} == want
    chunks = dict(map(tuple, c.chunks.groupBy("file_id").count().collect()))
    assert any(r["early"] for r in got.values()) and all(r["units"] == chunks[i] for i, r in got.items() if not r["early"])
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] == 0  # nothing is kept of files that have ended


def test_a_silent_file_is_decided_by_what_it_showed(spark, tmp_path):
    made = from_texts(_rows(spark, (1, "alpha\nbeta"), (2, "gamma")))
    made.chunks.filter("chunk_index < 3").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(made.chunks.schema).parquet(str(tmp_path / "in"))
    with matcher.state_store(spark):
        q = matcher.decide(stream, "alpha & !beta", idle=1).writeStream.format("memory").queryName("silent").outputMode("append").trigger(processingTime="1 second").start()
    try:
        until = time.time() + 90
        while time.time() < until and spark.table("silent").count() < 2:
            time.sleep(0.5)
        assert {r["file_id"]: (r["outcome"], r["early"]) for r in spark.table("silent").collect()} == {1: ("accept", False), 2: ("reject", False)}
    finally:
        q.stop()


def test_streams(spark, tmp_path):
    incoming, idx = str(tmp_path / "in"), CorpusIndex(spark, str(tmp_path / "index"))
    schema = "file_id long, folder string, text string"
    for i in (1, 2):
        _rows(spark, (i, f"alpha {i}")).coalesce(1).write.mode("append").parquet(incoming)
        q = incremental.keep_index(spark, incoming, schema, idx, str(tmp_path / "cp"))
        q.awaitTermination(120)
        assert q.exception() is None and idx.load().files.count() == i
    chunks = idx.load().chunks
    chunks.write.parquet(str(tmp_path / "chunks"))
    stream = spark.readStream.schema(chunks.schema).parquet(str(tmp_path / "chunks"))
    q = incremental.matches(stream, "alpha & !2").writeStream.outputMode("complete").format("memory").queryName("found").start()
    q.processAllAvailable()
    q.stop()
    assert [r["file_id"] for r in spark.table("found").filter("accepted").collect()] == [1]


def test_event_windows_drop_late_rows(spark, tmp_path):
    schema = "ts timestamp, event_type string, props string"
    q = None
    for i, rows in enumerate(([("2024-01-01 00:10:00", "click", ""), ("2024-01-01 05:00:00", "view", "click")], [("2024-01-01 00:20:00", "click", ""), ("2024-01-01 09:00:00", "x", "")])):
        df = spark.createDataFrame(rows, "ts string, event_type string, props string").withColumn("ts", F.to_timestamp("ts"))
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "e"))
        if q is None:
            out = incremental.hits_per_window(spark.readStream.schema(schema).parquet(str(tmp_path / "e")), ["click"])
            q = out.writeStream.outputMode("append").format("memory").queryName("windows").start()
        q.processAllAvailable()
        time.sleep(0.1)
    q.stop()
    assert [r["hits"] for r in spark.table("windows").orderBy("start").collect()][0] == 1


def test_ocr_cache(spark):
    pages = spark.createDataFrame([("/a", 1, 1, p, "jpn", "1", 2.0) for p in (1, 2)], "path string, size long, mtime_ns long, page int, language string, version string, scale double")
    cache = pages.filter("page = 1").select(ocr_cache.key().alias("key"), "path", F.lit("text").alias("text"), F.lit(1).alias("used_at"))
    assert [r["cached"] for r in ocr_cache.lookup(pages, cache).orderBy("page").collect()] == ["text", None]
    assert ocr_cache.put(cache, cache.withColumn("text", F.lit("new"))).first()["text"] == "new"
    assert ocr_cache.touch(cache, cache.select("key", F.lit(9).alias("used_at"))).first()["used_at"] == 9
    assert ocr_cache.drop_file(cache, "/a").count() == 0
    many = spark.range(1000).select(F.col("id").alias("key"), F.lit("ten bytes!").alias("text"), (F.col("id") * 7 % 1000).alias("used_at"))
    left = ocr_cache.trim(many, 5_500).collect()
    assert len(left) == 400 and min(r["used_at"] for r in left) == 600 and ocr_cache.trim(many, 10_000).count() == 1000


def test_a_changed_table_is_read_anew(spark, tmp_path):
    from sparkfolio.sources.chunks import indexed

    for text in ("alpha", "beta gamma"):
        spark.createDataFrame([(1, text, "en", "s")], "doc_id long, text string, lang string, source string").write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
        assert search(indexed(spark, str(tmp_path)), text).results.count() == 1


def test_a_search_can_be_cancelled(spark, tmp_path):
    (tmp_path / "a.txt").write_text("alpha")
    with pytest.raises(Exception, match="(?i)cancel"):
        run(spark, Request([str(tmp_path)], "alpha"), tag="mine", listener=lambda e: e.kind == "discovered" and (threading.Timer(0.4, cancel, (spark, "mine")).start(), _spin(spark)))
    assert run(spark, Request([str(tmp_path)], "alpha"), tag="mine").results.count() == 1
