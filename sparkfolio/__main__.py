"""Command line: ``python -m sparkfolio --search FOLDER --query "a & b" [--json]``."""

from __future__ import annotations

import argparse
import json
import os
import platform
import sys
from collections.abc import Sequence

from pyspark.sql import SparkSession
from pyspark.version import __version__ as spark_version

from .lang.nodes import QueryError
from .operators import results as ops
from .plans.compile import Options
from .session import Request, run
from .settings import MODES, POLICIES, Settings
from .sources.index import CorpusIndex

VERSION = "0.2"


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="sparkfolio", description="Search the text of the files in folders.")
    out.add_argument("--version", action="version", version=f"sparkfolio {VERSION}")
    out.add_argument("--diagnostics", action="store_true", help="tell versions and settings")
    out.add_argument("--search", metavar="FOLDERS", help="folders, parted by ;")
    out.add_argument("--query", default="", help="what to look for; the last default otherwise")
    out.add_argument("--mode", choices=MODES)
    out.add_argument("--policy", choices=POLICIES, help="what to do with files that lie online only")
    out.add_argument("--index", metavar="PATH", help="keep an index here")
    out.add_argument("--json", action="store_true", help="one JSON document instead of lines")
    out.add_argument("--limit", type=int, default=0, help="results to show; 0 for all")
    out.add_argument("--out", help="write what is shown to a file too")
    out.add_argument("--settings", default=os.path.join(os.path.expanduser("~"), ".sparkfolio.json"))
    return out


def main(argv: Sequence[str] | None = None) -> int:
    args = parser().parse_args(argv)
    settings = Settings.load(args.settings)
    spark = SparkSession.builder.appName("sparkfolio").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    if args.diagnostics:
        shown = json.dumps({"sparkfolio": VERSION, "spark": spark_version, "python": platform.python_version(), "master": spark.sparkContext.master, "settings": args.settings}, indent=1)
    elif not args.search:
        parser().print_usage(sys.stderr)
        return 2
    else:
        options = Options(settings.case_sensitive, settings.ignore_width, settings.part_number_mode, include_path_names=settings.include_path_names, spaces=settings.spaces)
        request = Request([args.search], args.query or settings.query, options, args.mode or settings.mode, args.policy or settings.policy, settings.subfolders, settings.kinds, settings.limits)
        request = Request(**{**request.__dict__, "roots": args.search.split(";")})
        place = args.index or settings.index_path
        index = CorpusIndex(spark, place, max_bytes=settings.index_max_bytes or None) if place else None
        try:
            found = run(spark, request, index=index, confirmed=settings.confirmed)
        except QueryError as e:
            print(e.pretty(str(request.query)), file=sys.stderr)
            return 2
        results = found.results.limit(args.limit) if args.limit else found.results
        shown = ops.json_document(results, found.coverage, query=str(request.query), mode=request.mode, elapsed=found.elapsed) if args.json else "\n".join([ops.coverage_text(found.coverage).first()["text"], *(r["line"] for r in ops.text_rows(ops.sort(results)).toLocalIterator())])
        settings.remember(args.query, request.roots)
        settings.save(args.settings)
    print(shown)
    if args.out:
        with open(args.out, "w", encoding="utf-8") as f:
            f.write(shown + "\n")
    return 0


if __name__ == "__main__":
    sys.exit(main())
