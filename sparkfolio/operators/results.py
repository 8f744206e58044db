"""What is done with results: sort, page, filter, facets, coverage, export."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import files as paths
from ..functions import text as texts
from ..sources import storage

SORTS = {
    "relevance": "score",
    "filename": "name",
    "path": "path",
    "type": "file_kind",
    "hits": "hit_count",
    "modified": "mtime_ns",
    "size": "size",
    "confirmed": "confirmed",
    "source": "source_type",
}
#: Sorted downwards unless asked otherwise.
DOWNWARDS = ("relevance", "hits", "modified", "size")


def _order(by: str, descending: bool | None) -> list[Column]:
    key = texts.caseless(F.col(SORTS[by])) if by in ("filename", "path", "type", "source") else F.col(SORTS[by])
    down = by in DOWNWARDS if descending is None else descending
    return [key.desc() if down else key.asc(), F.col("path").asc(), F.col("file_id").asc()]


def sort(results: DataFrame, by: str = "relevance", descending: bool | None = None) -> DataFrame:
    """By one column, ties by path upwards."""
    return results.orderBy(*_order(by, descending))


def page(results: DataFrame, offset: int, limit: int) -> DataFrame:
    """Rows of an ordered result from ``offset`` on."""
    return results.offset(offset).limit(limit)


def capped(results: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """At most ``most`` results, and one row, ``truncated``, that tells whether there are more."""
    more = results.limit(most + 1).agg((F.count("*") > most).alias("truncated"))
    return results.limit(most), more


class Ranked:
    """A sorted result store: ranges of the order, and how many results lie before each, so a page opens the ranges it lies in."""

    def __init__(self, results: DataFrame, by: str = "relevance", descending: bool | None = None, *, ranges: int | None = None) -> None:
        order = _order(by, descending)
        dealt = results.repartitionByRange(ranges, *order) if ranges else results.repartitionByRange(*order)
        self.by, self.descending, self.columns = by, descending, results.columns
        self.table = storage.divided(dealt.withColumn("_range", F.spark_partition_id()), "ranked", "_range")
        sizes = sorted(map(tuple, self.table.groupBy("_range").agg(F.count("*")).collect()))  # a row for each range
        self.starts: list[tuple[int, int, int]] = []
        self.total = 0
        for part, n in sizes:
            self.starts.append((part, self.total, n))
            self.total += n

    def page(self, offset: int, limit: int) -> DataFrame:
        """Results ``offset`` to ``offset + limit``; only the ranges that hold them are read and sorted."""
        here = [(part, start) for part, start, n in self.starts if start < offset + limit and start + n > offset]
        if not here:
            return self.table.select(*self.columns).limit(0)
        rows = self.table.filter(F.col("_range").isin([part for part, _ in here])).select(*self.columns)
        return page(sort(rows, self.by, self.descending), offset - here[0][1], limit)


def narrow(results: DataFrame, *, kinds: list[str] | None = None, sources: list[str] | None = None, ocr_only: bool = False, confirmed: bool | None = None, folder: str | None = None, without: str | None = None) -> DataFrame:
    """The results that pass facet filters; ``without`` drops one path."""
    tests: list[Column] = []
    tests += [F.col("file_kind").isin(*kinds)] if kinds else []
    tests += [F.col("source_type").isin(*sources)] if sources else []
    tests += [F.col("ocr_hit")] if ocr_only else []
    tests += [F.col("confirmed") == confirmed] if confirmed is not None else []
    tests += [paths.is_under(F.col("path"), folder)] if folder else []
    tests += [F.col("path") != without] if without else []
    for test in tests:
        results = results.filter(test)
    return results


def facets(results: DataFrame) -> DataFrame:
    """facet, value and n: counts by kind and by source from one pass, and of OCR hits."""
    both = F.explode(F.array(F.struct(F.lit("kind").alias("facet"), F.col("file_kind").alias("value")), F.struct(F.lit("source").alias("facet"), F.col("source_type").alias("value")), F.struct(F.lit("ocr").alias("facet"), F.when(F.col("ocr_hit"), "true").alias("value"))))
    return results.select(both.alias("f")).filter("f.value is not null").groupBy("f.facet", "f.value").agg(F.count("*").alias("n"))


def coverage(judged: DataFrame) -> DataFrame:
    """One row of counters over all files that were judged."""
    n = lambda test: F.count_if(test).alias
    return judged.agg(
        F.count("*").alias("discovered"),
        n(F.col("units").isNotNull())("scanned"),
        n(F.col("accepted"))("matched"),
        n(~F.col("accepted"))("rejected"),
        F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"),
        F.coalesce(F.sum("units"), F.lit(0)).alias("units"),
    )


#: Counters of a search over folders.
COUNTERS = ("discovered", "scanned", "hits", "indexed", "read", "ocr_pages", "skipped_online", "skipped_size", "skipped_type", "warnings", "errors", "bytes")


def listed_counters() -> dict[str, Column]:
    """Counters of listed files with their ``decision``."""
    by = F.col("decision")
    return {
        "discovered": F.count("*"),
        "scanned": F.count_if(by.isin("read", "index", "skip_online")),
        "indexed": F.count_if(by == "index"),
        "read": F.count_if(by == "read"),
        **{f"skipped_{x}": F.count_if(by == f"skip_{x}") for x in ("online", "size", "type")},
        "bytes": F.coalesce(F.sum("size"), F.lit(0)),
    }


def read_counters() -> dict[str, Column]:
    """Counters of chunks that were read."""
    return {"ocr_pages": F.count_if(F.col("kind") == "ocr")}


def issue_counters() -> dict[str, Column]:
    return {"warnings": F.count_if(F.col("severity") == "warn"), "errors": F.count_if(F.col("severity") == "error")}


def covered(files: DataFrame, results: DataFrame, issues: DataFrame, extracted: DataFrame) -> DataFrame:
    """One row of ``COUNTERS`` over tables that are there; a session observes the same counters while it writes them."""
    all_ = lambda df, counters: df.agg(*[c.alias(n) for n, c in counters.items()])
    row = all_(files, listed_counters())
    for other in (results.agg(F.count("*").alias("hits")), all_(issues, issue_counters()), all_(extracted, read_counters())):  # one row each
        row = row.join(F.broadcast(other), F.lit(True))
    return row.select(*COUNTERS)


def coverage_text(row: DataFrame) -> DataFrame:
    """The counters as a line (fixed format); warnings and errors only if there are any."""
    number = lambda c: F.format_number(F.col(c), 0)
    parts = [F.concat(F.lit(f"{label} "), number(c), F.lit(unit)) for c, label, unit in (("discovered", "発見", ""), ("scanned", "検索完了", ""), ("hits", "Hit", "資料"), ("indexed", "索引", ""), ("read", "実読込", ""), ("ocr_pages", "OCR", "ページ"), ("skipped_online", "Online-only skip", ""))]
    parts += [F.when(F.col(c) > 0, F.concat(F.lit(f"{label} "), number(c))) for c, label in (("warnings", "警告"), ("errors", "エラー"))]
    return row.select(F.concat_ws(" / ", *parts).alias("text"))


def summary_text(row: DataFrame) -> DataFrame:
    """A short line for the end of a search (fixed format); what is 0 is left out."""
    some = (("skipped_type", "対象外 "), ("skipped_online", "未取得 "), ("skipped_size", "サイズ超過 "), ("warnings", "警告 "), ("errors", "エラー "))
    parts = [F.when(F.col(c) > 0, F.concat(F.lit(label), F.format_number(F.col(c), 0))) for c, label in some]
    return row.select(F.concat_ws(" / ", F.concat(F.lit("検索完了 "), F.format_number("scanned", 0), F.lit("件")), *parts).alias("text"))


def progress(scanned: Column, discovered: Column, done: Column) -> Column:
    """The share of files that are judged, from 0 to 1; null until all are listed."""
    return F.when(done & (discovered > 0), F.least(F.lit(1.0), scanned / discovered))


def latest_within(cache: DataFrame, most_bytes: int, *, key: str = "key", size: str = "chars", used: str = "used_at", batch: int = 200) -> DataFrame:
    """The rows of a cache that stay when the longest unused go, in whole batches, until it fits.

    Rows are dealt out by ranges of their last use; totals of the ranges, one row each, give every range
    what lies before it.
    """
    newest = [F.col(used).desc(), F.col(key).desc()]
    dealt = storage.stored(cache.repartitionByRange(*newest).withColumn("_part", F.spark_partition_id()), "cache")
    ranges = dealt.groupBy("_part").agg(F.sum(size).alias("_bytes"), F.count("*").alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # over as many rows as there are ranges
    ranges = ranges.select("_part", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ("_bytes", "_rows")])
    inside = Window.partitionBy("_part").orderBy(*newest)
    aged = dealt.join(F.broadcast(ranges), "_part").withColumns(
        {
            "_total": F.col("_bytes_before") + F.sum(size).over(inside.rowsBetween(Window.unboundedPreceding, 0)),
            "_age": F.col("_rows_before") + F.row_number().over(inside),
        }
    )
    left = aged.agg((F.count("*") - F.ceil(F.count_if(F.col("_total") > most_bytes) / batch) * batch).alias("left"))
    return aged.filter(F.col("_age") <= left.scalar()).select(*cache.columns)


def shown_rows(results: DataFrame) -> DataFrame:
    """The columns of a list of results, and ``tags`` that tell how a row is drawn; ``odd`` follows the order of ``sort``."""
    has = lambda c: c in results.columns
    kind = F.when(F.col("from_index"), F.concat("file_kind", F.lit("*"))).otherwise(F.col("file_kind")) if has("from_index") else F.col("file_kind")
    tags = F.array(F.when(F.col("confirmed"), "confirmed"), F.when(F.col("ocr_hit"), "ocr"))
    return results.select(
        "file_id",
        F.when(F.col("confirmed"), "✓").otherwise("").alias("confirmed"),
        "name",
        F.array_join("displays", " / ").alias("displays"),
        "hit_count",
        kind.alias("kind"),
        _time(F.col("mtime_ns")).alias("modified"),
        paths.human_size(F.col("size")).alias("size_text"),
        paths.source_label(F.col("source_type"), F.col("cloud_state")).alias("source"),
        "path",
        F.filter(tags, lambda t: t.isNotNull()).alias("tags"),
    )


def _time(mtime_ns: Column) -> Column:
    shown = F.date_format(F.timestamp_seconds(F.floor(mtime_ns / 1_000_000_000).cast("long")), "yyyy-MM-dd HH:mm")
    return F.regexp_replace(shown, r"^\+", "")  # stands before years of five digits


#: Headings of the CSV export (fixed values), with the columns of ``csv_rows`` under them.
CSV = {"済": "confirmed", "ファイル": "name", "一致条件": "displays", "Hit数": "hit_count", "種類": "file_kind", "更新日時": "modified", "サイズ": "size_text", "Source": "source", "OCR": "ocr", "場所": "location", "根拠": "snippet", "Path": "path"}
#: More rows than these aren't exported by themselves at the end of a search (fixed value).
MOST_AUTOSAVED = 100_000


def csv_rows(results: DataFrame) -> DataFrame:
    """The columns of the CSV export, and matched_terms and score; of evidence the first only."""
    first = F.try_element_at("evidence", F.lit(1)) if "evidence" in results.columns else F.lit(None).cast("struct<location:string,snippet:string>")
    return results.select(
        F.when(F.col("confirmed"), "✓").otherwise("").alias("confirmed"),
        "name",
        "path",
        "file_kind",
        F.array_join("displays", " / ").alias("displays"),
        F.array_join("matched_terms", " ").alias("matched_terms"),
        "hit_count",
        _time(F.col("mtime_ns")).alias("modified"),
        paths.human_size(F.col("size")).alias("size_text"),
        "source_type",
        paths.source_label(F.col("source_type"), F.col("cloud_state")).alias("source"),
        F.when(F.col("ocr_hit"), "OCR").otherwise("").alias("ocr"),
        F.coalesce(first["location"], F.lit("")).alias("location"),
        F.coalesce(first["snippet"], F.lit("")).alias("snippet"),
        "score",
    )


def write_csv(results: DataFrame, path: str) -> None:
    """A folder of CSV parts; each starts with the mark of UTF-8, so that spreadsheets read it as such."""
    rows = csv_rows(results).select(*[F.col(c).alias(("\ufeff" if i == 0 else "") + h) for i, (h, c) in enumerate(CSV.items())])
    rows.write.csv(path, header=True, quoteAll=True, emptyValue="")


def json_rows(results: DataFrame) -> DataFrame:
    return results.select(F.to_json(F.struct("path", F.col("file_kind").alias("kind"), F.col("hit_count").alias("hits"), "displays", *[c for c in ("from_index",) if c in results.columns])).alias("json"))


def json_document(results: DataFrame, coverage: DataFrame, *, query: str, mode: str, elapsed: float) -> str:
    """One document with the query, the coverage and all results; for results that are limited."""
    rows = [json.loads(r["json"]) for r in json_rows(sort(results)).toLocalIterator()]
    return json.dumps({"query": query, "mode": mode, "elapsed": round(elapsed, 3), "coverage": coverage.first().asDict(), "results": rows}, ensure_ascii=False, indent=2)


def text_rows(results: DataFrame) -> DataFrame:
    return results.select("file_id", F.format_string("%5d  %-9s %s", "hit_count", "file_kind", "path").alias("line"))


def clipboard(results: DataFrame) -> DataFrame:
    """path, then a line per piece of evidence."""
    lines = F.transform("evidence", lambda e: F.concat(F.lit("  ["), e["location"], F.lit("] "), e["snippet"]))
    return results.select("file_id", F.concat_ws("\n", F.array("path"), F.coalesce(lines, F.array().cast("array<string>"))).alias("text"))


def toggled(confirmed: DataFrame, file_id: int) -> DataFrame:
    """A user's set of confirmed files with one file put in, or taken out if it was there."""
    one = confirmed.sparkSession.range(file_id, file_id + 1).select(F.col("id").cast(confirmed.schema["file_id"].dataType).alias("file_id"))
    both = confirmed.select("file_id").distinct().unionByName(one)
    return both.groupBy("file_id").agg(F.count("*").alias("n")).filter((F.col("file_id") != file_id) | (F.col("n") == 1)).select("file_id")


def preview(chunks: DataFrame, file_id: int, needles: list[str], most_chars: int = 40_000) -> DataFrame:
    """The lines of one file with their locations, blanks dropped, marked, cut at ``most_chars``."""
    mine = chunks.filter(F.col("file_id") == file_id)
    rows = mine.select("chunk_index", "location", "kind", F.posexplode(F.split("text", "\n")).alias("line", "text")).filter(F.trim("text") != "")
    order = Window.orderBy("chunk_index", "line").rowsBetween(Window.unboundedPreceding, 0)
    cut = rows.withColumn("_total", F.sum(F.length("text")).over(order)).filter(F.col("_total") <= most_chars)
    return cut.select("chunk_index", "line", texts.location_label(F.col("location"), F.col("kind")).alias("location"), texts.highlight(F.col("text"), needles).alias("text"))


def page_count(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("file_id").agg(F.max(texts.page_of(F.col("location"))).alias("pages"))
