"""Files of a folder and their text, by extension, with the standard library only.

``scan`` lists files without reading them and ``prefilter`` decides from that list which are read.
``extract`` reads those in Python tasks, one file at a time, and yields chunks, and issue rows for what
can't be read. Handlers are asked in order; the first that supports an extension wins, and ``register``
puts one in front. ``recognise_with`` sets a function that reads scanned pages.
"""

from __future__ import annotations

import datetime
import io
import json
import posixpath
import re
import zipfile
from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import files as paths
from . import listing, pdf
from .chunks import LINE

Chunk = tuple[str, str, str]  # kind, location, text


class Note(NamedTuple):
    """Something a reader passed over; the file's other text is there."""

    code: str
    message: str


Handler = Callable[[str, bytes], Iterator["Chunk | Note"]]

#: The largest file whose text is read by kind, and bounds on archives.
SIZE_LIMITS = {"excel": 500 << 20, "word": 500 << 20, "ppt": 500 << 20, "pdf": 1 << 30, "text": 50 << 20, "archive": 512 << 20, paths.UNKNOWN: 50 << 20}
ZIP_DEPTH, ZIP_ENTRIES, ZIP_MEMBER, ZIP_TOTAL, ZIP_RATIO = 2, 2000, 512 << 20, 512 << 20, 200
PROBE = 64 * 1024
#: A page with less text than this counts as scanned.
NATIVE = 40
#: Bytes of files that one task reads, about.
TASK_BYTES = 64 << 20
#: The issue of a file that changed between its listing and its reading.
CHANGED = "file_changed"
SCHEMA = "file_id long, chunk_index int, kind string, location string, text string, code string, message string, severity string"


class Unreadable(ValueError):
    """A file that is skipped; ``code`` names the reason."""

    def __init__(self, code: str, message: str) -> None:
        super().__init__(message)
        self.code = code


# ---------------------------------------------------------------------------- plain text
def sniff_encoding(data: bytes) -> str:
    marks = ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16"))
    for mark, name in marks:
        if data.startswith(mark):
            return name
    if 0 in data[:4096] and 0 in data[:2]:  # without a mark the first letter tells, if it is a Latin one
        return "utf-16-le" if data[1:2] == b"\0" else "utf-16-be"
    for name in ("utf-8", "cp932", "shift_jis"):
        try:
            data.decode(name)
            return name
        except UnicodeDecodeError as e:
            if e.start >= len(data) - 4 and len(data) == PROBE:  # cut inside a character
                return name
    return "cp932"


def looks_binary(data: bytes) -> bool:
    head = data[:4096]
    control = sum(b < 32 and b not in (9, 10, 12, 13, 27) for b in data[:PROBE])
    return bool(head) and (head.count(0) > len(head) * 0.02 or control > len(data[:PROBE]) * 0.10)


def text_lines(data: bytes) -> Iterator[Chunk]:
    said = data.decode(sniff_encoding(data[:PROBE]), errors="replace")
    for n, line in enumerate(io.StringIO(said, newline=""), 1):  # ends at \n, \r and both, and nowhere else
        for a in range(0, len(line), LINE):
            if line[a : a + LINE].strip():
                yield "line", f"{n}行", line[a : a + LINE]


def read_text(name: str, data: bytes) -> Iterator[Chunk]:
    return text_lines(data)


def read_unknown(name: str, data: bytes) -> Iterator[Chunk]:
    if looks_binary(data):
        raise Unreadable("unsupported", "not text")
    return text_lines(data)


# -------------------------------------------------------------------------- office files
def _parts(data: bytes, pattern: str) -> Iterator[tuple[str, ElementTree.Element]]:
    """The XML parts of an office file whose name fits, in natural order; entity definitions are refused."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = [i for i in z.infolist() if re.fullmatch(pattern, i.filename)]
        for info in sorted(names, key=lambda i: [int(x) if x.isdigit() else x for x in re.split(r"(\d+)", i.filename)]):
            if info.file_size > ZIP_MEMBER or info.file_size > ZIP_RATIO * max(1, info.compress_size):
                raise Unreadable("too_large", info.filename)
            xml = z.read(info)
            if b"<!DOCTYPE" in xml or b"<!ENTITY" in xml:
                raise Unreadable("unsafe_xml", info.filename)
            yield info.filename, ElementTree.fromstring(xml)


def _targets(data: bytes, part: str) -> dict[str, str]:
    """The parts that a part's relations name, by relation id."""
    folder, name = posixpath.split(part)
    rels = re.escape(f"{folder}/_rels/{name}.rels")
    found = [x for _, root in _parts(data, rels) for x in root.iter() if _tag(x) == "Relationship"]
    return {x.get("Id", ""): posixpath.normpath(posixpath.join("/", folder, x.get("Target", ""))).lstrip("/") for x in found}


def _listed(data: bytes, part: str, tag: str) -> list[tuple[str, str]]:
    """(part, name) of the elements of a part that refer to others, in order."""
    targets = _targets(data, part)
    out = []
    for _, root in _parts(data, re.escape(part)):
        for x in (x for x in root.iter() if _tag(x) == tag):
            ref = next((v for k, v in x.attrib.items() if k.endswith("}id")), "")
            out.append((targets.get(ref, ""), x.get("name", "")))
    return out


def _tag(e: ElementTree.Element) -> str:
    return e.tag.rpartition("}")[2]


def _said(e: ElementTree.Element, tag: str = "t") -> str:
    return "".join(x.text or "" for x in e.iter() if _tag(x) == tag)


def _own(e: ElementTree.Element) -> Iterator[ElementTree.Element]:
    """An element and what is in it, without text boxes and without second versions of drawings."""
    yield e
    for x in e:
        if _tag(x) not in ("txbxContent", "Fallback"):
            yield from _own(x)


def read_word(name: str, data: bytes) -> Iterator[Chunk | Note]:
    kinds = (("document", "paragraph"), ("header", "header"), ("footer", "footer"), ("footnotes", "note"), ("endnotes", "note"), ("comments", "comment"))
    for part, root in _parts(data, r"word/(document|header\d*|footer\d*|footnotes|endnotes|comments)\.xml"):
        kind = next(k for start, k in kinds if part.startswith(f"word/{start}"))
        cells = {p: f"表{t}" for t, table in enumerate((x for x in root.iter() if _tag(x) == "tbl"), 1) for p in table.iter() if _tag(p) == "p"}
        for n, p in enumerate((x for x in _own(root) if _tag(x) == "p"), 1):
            if (text := "".join(x.text or "" for x in _own(p) if _tag(x) == "t")).strip():
                yield ("table" if p in cells else kind), (cells.get(p) or f"段落{n}"), text
        again = {x for f in root.iter() if _tag(f) == "Fallback" for x in f.iter()}
        for box in (x for x in root.iter() if _tag(x) == "txbxContent" and x not in again):
            for p in (x for x in _own(box) if _tag(x) == "p"):
                if (text := "".join(x.text or "" for x in _own(p) if _tag(x) == "t")).strip():
                    yield "textbox", "テキストボックス", text


def read_slides(name: str, data: bytes) -> Iterator[Chunk | Note]:
    order = {part: n for n, (part, _) in enumerate(_listed(data, "ppt/presentation.xml", "sldId"), 1) if part}
    noted = {target: n for part, n in order.items() for target in _targets(data, part).values()}
    found = list(_parts(data, r"ppt/(slides/slide|notesSlides/notesSlide|comments/.*)\d+\.xml"))
    place = lambda part: order.get(part) or noted.get(part) or int(re.search(r"(\d+)\.xml", part)[1])
    for part, root in sorted(found, key=lambda x: ("slides/" not in x[0], place(x[0]))):
        hidden = "（非表示）" if root.get("show") == "0" else ""
        kind = "note" if "notes" in part else "comment" if "comment" in part else "slide"
        for p in (x for x in root.iter() if _tag(x) in ("p", "text")):
            text = _said(p) if _tag(p) == "p" else p.text or ""
            if text.strip():
                yield kind, f"スライド{place(part)}{hidden}", text
    for _, root in _parts(data, r"ppt/charts/.*\.xml"):
        for x in root.iter():
            if _tag(x) in ("t", "v") and (x.text or "").strip():
                yield "chart", "グラフ", x.text
    for _, root in _parts(data, r"ppt/diagrams/data.*\.xml"):
        for x in root.iter():
            if _tag(x) == "t" and (x.text or "").strip():
                yield "textbox", "SmartArt", x.text


def decimals(number_format: str) -> int | None:
    """Digits behind the point that a number format shows; None if it shows none."""
    shown = re.match(r"[^.]*\.([0#]+)", number_format)
    return min(len(shown[1]), 10) if shown else None


def cell_spellings(value: object, number_format: str = "") -> list[str]:
    """How a cell's value may be written, first as it is: for readers of binary sheets, whose cells have no text."""
    if value is None:
        return []
    out = [str(value)]
    whole = int(value) if isinstance(value, float) and value.is_integer() else value
    if isinstance(value, bool):
        out += [str(value).upper(), str(value).lower()]
    elif isinstance(whole, int):
        out += [f"{whole}", f"{whole}.0", f"{whole}.00", *(f"{whole:0{n}d}" for n in (3, 4, 5))]
    elif isinstance(value, datetime.date):
        formats = ["%Y/%m/%d", "%Y-%m-%d", f"{value.year}/{value.month}/{value.day}"]
        formats += ["%Y/%m/%d %H:%M", "%Y/%m/%d %H:%M:%S"] if isinstance(value, datetime.datetime) else []
        out += [value.strftime(f) for f in formats]
    if isinstance(value, float) and (digits := decimals(number_format)) is not None:
        out.append(f"{value:.{digits}f}")
    return list(dict.fromkeys(out))


def read_sheets(name: str, data: bytes) -> Iterator[Chunk | Note]:
    strings = [_said(si) for _, root in _parts(data, r"xl/sharedStrings\.xml") for si in root if _tag(si) == "si"]
    sheets = _listed(data, "xl/workbook.xml", "sheet")
    for i, (_, title) in enumerate(sheets, 1):
        yield "sheet", f"シート{i}", title
    for _, root in _parts(data, r"xl/workbook\.xml"):
        for x in root.iter():
            if _tag(x) == "definedName":
                yield "defined_name", "名前", f"{x.get('name')} {x.text or ''}"
    titles = {part: title for part, title in sheets if part}
    for n, (part, root) in enumerate(_parts(data, r"xl/worksheets/sheet\d+\.xml")):
        title = titles.get(part) or (sheets[n][1] if not titles and n < len(sheets) else f"sheet{n + 1}")
        for cell in (x for x in root.iter() if _tag(x) == "c"):
            place = f"{title}!{cell.get('r', '')}"
            value, formula = _said(cell, "v"), _said(cell, "f")
            if cell.get("t") == "s" and value.isdigit() and int(value) < len(strings):
                value = strings[int(value)]
            elif cell.get("t") == "inlineStr":
                value = _said(cell)
            elif cell.get("t") == "b":
                value = "TRUE" if value == "1" else "FALSE"
            if formula:
                yield "formula", place, "=" + formula
            if value.strip():
                yield "cell", place, value
    for _, root in _parts(data, r"xl/comments\d*\.xml"):
        for c in (x for x in root.iter() if _tag(x) == "comment"):
            yield "comment", c.get("ref", ""), _said(c)
    for _, root in _parts(data, r"xl/(drawings/drawing|charts/chart)\d+\.xml"):
        for p in (x for x in root.iter() if _tag(x) == "p"):
            if (text := _said(p)).strip():
                yield "drawing", "図形", text


# ----------------------------------------------------------------------------------- pages
#: Reads a scanned page: (file's bytes, page from 0) to text. None without a recogniser.
_recogniser: list[Callable[[bytes, int], str] | None] = [None]


def recognise_with(reader: Callable[[bytes, int], str] | None) -> None:
    """Read pages without text by ``reader`` from now on; it travels to the executors with each extraction."""
    _recogniser[0] = reader


def _unseen(data: bytes, page: int) -> str:
    """Stands for a recogniser where pages aren't to be read."""
    return ""


def read_pdf(name: str, data: bytes) -> Iterator[Chunk | Note]:
    reader, told = _recogniser[0], False
    try:
        for n, text in enumerate(pdf.pages(data)):
            if text:
                yield "page", f"{n + 1}ページ", text
            if len(text) >= NATIVE:
                continue
            if reader and (seen := reader(data, n)).strip():
                yield "ocr", f"{n + 1}ページ", seen
            elif not reader and not told:
                told = True
                yield Note("no_recogniser", "scanned pages aren't read")
    except pdf.Encrypted as e:
        raise Unreadable("encrypted", "an encrypted file") from e


# ------------------------------------------------------------------------------ archives
def safe_name(name: str) -> bool:
    flat = name.replace("\\", "/")
    return bool(flat) and not flat.startswith("/") and not re.match(r"[A-Za-z]:", flat) and ".." not in flat.split("/")


def _refused(info: zipfile.ZipInfo, depth: int) -> Note | None:
    """Why a member isn't read."""
    if not safe_name(info.filename):
        return Note("zip_path", f"unsafe path {info.filename}")
    if info.flag_bits & 1:
        return Note("zip_encrypted", info.filename)
    if info.file_size > ZIP_MEMBER or info.file_size > ZIP_RATIO * max(1, info.compress_size):
        return Note("zip_ratio" if info.file_size <= ZIP_MEMBER else "zip_member", info.filename)
    if depth >= ZIP_DEPTH and paths_extension(info.filename) == ".zip":
        return Note("zip_depth", info.filename)
    return None


def read_zip(name: str, data: bytes, depth: int = 1) -> Iterator[Chunk | Note]:
    total = 0
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        members = [i for i in z.infolist() if not i.is_dir()]
        if len(members) > ZIP_ENTRIES:
            yield Note("zip_entries", f"{len(members) - ZIP_ENTRIES} of {len(members)} members aren't read")
        for info in members[:ZIP_ENTRIES]:
            if refused := _refused(info, depth):
                yield refused
                continue
            total += info.file_size
            if total > ZIP_TOTAL:
                yield Note("zip_total", f"not read from {info.filename} on")
                return
            inner = paths_extension(info.filename)
            if handler_for(inner) is read_unknown and inner in paths.BINARY:
                continue
            shown = f"{posixpath.basename(name)} > {info.filename}"
            try:
                body = z.read(info)
                for found in read_zip(info.filename, body, depth + 1) if inner == ".zip" else handler_for(inner)(info.filename, body):
                    yield Note(found.code, f"{shown}: {found.message}") if isinstance(found, Note) else (found[0], f"{shown} / {found[1]}", found[2])
            except (ValueError, zipfile.BadZipFile, ElementTree.ParseError, KeyError) as e:
                yield Note(getattr(e, "code", "broken"), f"{shown}: {e}")


def _unsupported(name: str, data: bytes) -> Iterator[Chunk]:
    raise Unreadable("unsupported", "no reader for this kind of file")


HANDLERS: list[tuple[tuple[str, ...], Handler]] = [
    ((".xlsx", ".xlsm", ".xltx", ".xltm"), read_sheets),
    ((".docx", ".docm"), read_word),
    ((".pptx", ".pptm"), read_slides),
    ((".pdf",), read_pdf),
    ((".xls", ".xlsb", ".7z", ".rar"), _unsupported),
    ((".zip",), read_zip),
    (paths.EXTENSIONS["text"], read_text),
]


def register(extensions: Sequence[str], handler: Handler) -> None:
    """Read files with these extensions by ``handler`` from now on."""
    HANDLERS.insert(0, (tuple(extensions), handler))


def handler_for(extension: str) -> Handler:
    return next((h for known, h in HANDLERS if extension in known), read_unknown)


def paths_extension(name: str) -> str:
    return posixpath.splitext(name.lower())[1]


def listed(spark: SparkSession, roots: str | Sequence[str], *, subfolders: bool = True) -> DataFrame:
    """path, size, mtime_ns, uri and error of everything below one or more roots, each URI once.

    Roots in a store that only Spark can open are listed by Spark's own reader, which hides names that begin with ``_`` or ``.``.
    """
    own, foreign = [], []
    for root in roots_of(roots):
        (own if listing.scheme(root) in listing.KNOWN else foreign).append(root)
    spark.dataSource.register(listing.FolderListing)
    found = spark.read.format("folder_listing").options(roots=json.dumps(own), subfolders=str(subfolders).lower()).load()
    if foreign:
        others = spark.read.format("binaryFile").option("recursiveFileLookup", str(subfolders).lower()).load(foreign)
        found = found.unionByName(others.select("path", F.col("length").alias("size"), (F.unix_micros("modificationTime") * 1000).alias("mtime_ns"), F.col("path").alias("uri"), F.lit(None).cast("string").alias("error")))
    return found.dropDuplicates(["uri"])  # roots may overlap


def described(found: DataFrame, *, removable: Sequence[str] = (), caseless: bool = False) -> DataFrame:
    """Files of a listing with file_id and what their paths tell. ``caseless`` roots hold no two names that differ in case only."""
    out = found.filter("error is null").drop("error").withColumn("file_id", F.xxhash64("uri"))
    path = F.col("path")
    out = out.withColumns({"name": paths.name(path), "directory": paths.directory(path), "extension": paths.extension(path), "source_type": paths.source_type(path, removable), "path_key": paths.path_key(path, caseless=caseless)})
    out = out.withColumn("cloud_state", paths.cloud_state(F.lit(0), F.col("source_type")))
    return out.dropDuplicates(["path_key"]) if caseless else out


def scan(spark: SparkSession, roots: str | Sequence[str], *, subfolders: bool = True, max_files: int | None = None, removable: Sequence[str] = (), caseless: bool = False) -> DataFrame:
    """The files below one or more roots (a string may part them by ``;`` or line), each once; no content is read."""
    out = described(listed(spark, roots, subfolders=subfolders), removable=removable, caseless=caseless)
    return out.limit(max_files) if max_files else out


def prefilter(files: DataFrame, *, kinds: Sequence[str] | None = None, limits: dict[str, int] | None = None, mode: str = "standard", policy: str = "auto", indexed: DataFrame | None = None) -> DataFrame:
    """``files`` with ``kind`` and ``decision``: read, index, or skip_type, skip_size, skip_online. No content is read.

    ``indexed`` has the file_id of files whose rows in an index are up to date.
    """
    kind = paths.kind(F.col("extension"))
    known = files.withColumn("kind", kind)
    if indexed is None:
        known = known.withColumn("_indexed", F.lit(False))
    else:
        there = indexed.select("file_id").distinct().withColumn("_there", F.lit(True))
        known = known.join(there, "file_id", "left").withColumn("_indexed", F.coalesce("_there", F.lit(False))).drop("_there")
    limit = F.lit(None).cast("long")
    for name, most in (SIZE_LIMITS | (limits or {})).items():
        limit = F.when(F.col("kind") == name, F.lit(most)).otherwise(limit)
    unread = [x for x in dict.fromkeys([*paths.BINARY, *(x for xs, h in HANDLERS if h is _unsupported for x in xs)]) if handler_for(x) in (_unsupported, read_unknown)]
    cloud = paths.cloud_decision(F.col("cloud_state"), F.col("_indexed"), mode, policy)
    wanted = F.col("kind").isin(*kinds) if kinds is not None else F.lit(True)
    decision = (
        F.when(~wanted | F.lower("extension").isin(*unread), "skip_type")
        .when(F.col("size") > limit, "skip_size")
        .when(cloud == "skip", "skip_online")
        .when(F.col("_indexed") & F.lit(mode != "full"), "index")
        .otherwise("read")
    )
    return known.withColumn("decision", decision).drop("_indexed")


def _extract(frames: Iterator[pd.DataFrame], handlers: list, recogniser) -> Iterator[pd.DataFrame]:  # type: ignore[no-untyped-def, type-arg]
    """Read one file at a time; a file whose size or time is another than listed, before or after, has an issue row."""
    HANDLERS[:], _recogniser[0] = handlers, recogniser  # what the driver registered
    columns = [c.split()[0] for c in SCHEMA.split(", ")]
    made = lambda rows: pd.DataFrame(rows, columns=columns).astype({"chunk_index": "Int32"})
    for frame in frames:
        held = frame["content"] if "content" in frame else [None] * len(frame)
        for file_id, path, uri, size, mtime, content in zip(frame["file_id"], frame["path"], frame["uri"], frame["size"], frame["mtime_ns"], held, strict=True):
            rows: list[tuple] = []
            issue = lambda code, message, severity, i=file_id: (i, None, None, None, None, code, str(message)[:300], severity)
            at = 2
            try:
                data = listing.content(uri) if content is None else bytes(content)
                now = listing.stat(uri) if content is None else (len(data), mtime)
                if now != (size, mtime) or len(data) != size:
                    rows.append(issue(CHANGED, f"{size} bytes listed, {len(data)} read", "warn"))
                for found in handler_for(paths_extension(path))(path, data):
                    if isinstance(found, Note):
                        rows.append(issue(found.code, found.message, "warn"))
                    else:
                        rows.append((file_id, at, *found, None, None, None))
                        at += 1
                    if len(rows) == 5000:
                        yield made(rows)
                        rows = []
            except Unreadable as e:
                rows.append(issue(e.code, e, "skip"))
            except FileNotFoundError as e:
                rows.append(issue(CHANGED, e, "warn"))
            except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, ValueError, OSError) as e:
                rows.append(issue("broken", e, "error"))
            if rows:
                yield made(rows)


def roots_of(roots: str | Sequence[str]) -> list[str]:
    """Folders, parted by ``;`` or line in a string, each once."""
    return list(dict.fromkeys(r.strip() for r in (re.split(r"[;\n]", roots) if isinstance(roots, str) else roots) if r.strip()))


def extract(spark: SparkSession, files: DataFrame, roots: str | Sequence[str] = (), *, pages: bool = True) -> DataFrame:
    """Chunks (code is null) and issues (code is set) of ``files``, which ``scan`` listed.

    The names are dealt to as many tasks as their sizes ask for, and each task opens its own files one by one. Files in a store
    that only Spark can open come from Spark's reader of the ``roots`` they lie in. Scanned pages are recognised unless ``pages`` is
    false.
    """
    handlers, recogniser = list(HANDLERS), _recogniser[0] if pages else _unseen
    bare = files.select("file_id", "path", "uri", "size", "mtime_ns")
    foreign = [r for r in roots_of(roots) if listing.scheme(r) not in listing.KNOWN]
    if foreign:
        found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(foreign).select(F.col("path").alias("uri"), "content")
        bare = bare.join(found, "uri", "left").select("file_id", "path", "uri", "size", "mtime_ns", "content")
    else:
        total = bare.agg(F.sum("size")).first()[0] or 0
        bare = bare.repartition(max(spark.sparkContext.defaultParallelism, -(-total // TASK_BYTES)), "file_id")
    return bare.mapInPandas(lambda it: _extract(it, handlers, recogniser), SCHEMA)


def _again(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        found = [listing.stat(u) for u in frame["uri"]]
        there = [x is not None for x in found]
        yield frame[there].assign(size=[x[0] for x in found if x], mtime_ns=[x[1] for x in found if x])


def listed_again(files: DataFrame) -> DataFrame:
    """``files`` with the size and time that they have now, without those that are gone; only these are looked at."""
    return files.mapInPandas(_again, files.schema)


def issues(extracted: DataFrame, files: DataFrame) -> DataFrame:
    """path, code, message, severity and detail of files that weren't read, or not whole."""
    bad = extracted.filter("code is not null").join(files.select("file_id", "path"), "file_id")
    return bad.select("path", "code", "message", "severity", F.lit(None).cast("string").alias("detail"))
