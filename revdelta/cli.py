"""Compare two revisions from a table of pages and print a report.

spark-submit revdelta/cli.py PAGES.parquet --report text|csv|json|markdown [--rasters RASTERS.parquet]

Exit codes: 0 done, 1 changes or unreadable text found (with --fail-on-...), 2 wrong use,
3 the run failed.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revdelta.functions.geometry import SENSITIVITY, threshold
from revdelta.functions.text import PAGE_MATCH
from revdelta.operators import compare, rasters, report

RENDER = {"text": report.to_text, "csv": report.to_csv, "json": report.to_json, "markdown": report.to_markdown}


def arguments(argv: list[str]) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="revdelta")
    parser.add_argument("pages", help="Parquet with pair_id, side, page_number, text")
    parser.add_argument("--report", "--format", dest="format", choices=sorted(RENDER), default="text")
    parser.add_argument("--out", help="folder for one report per document; else they are printed")
    parser.add_argument("--rasters", help="Parquet with pair_id, side, page_number, width, height, data (RGBA) for pixel comparison")
    parser.add_argument("--images", help="folder for a table (pair_id, file_name, png) of the overlays of changed pages")
    parser.add_argument("--text-only", action="store_true", help="skip pixel comparison")
    parser.add_argument("--threshold", "--match-threshold", dest="match_threshold", type=float, default=PAGE_MATCH)
    parser.add_argument("--sensitivity", type=float, default=SENSITIVITY)
    parser.add_argument("--no-detect-moves", "--no-moves", dest="no_moves", action="store_true")
    parser.add_argument("--no-align", action="store_true", help="do not cancel a small shift of a page")
    parser.add_argument("--fail-on-change", action="store_true")
    parser.add_argument("--fail-on-unreadable", action="store_true")
    parser.add_argument("--quiet", action="store_true", help="no warnings; the report is still told")
    parser.add_argument("-V", "--version", action="version", version=str(report.VERSION))
    given = parser.parse_args(argv)
    for name, most in (("match_threshold", 1), ("sensitivity", 100)):
        if not 0 <= getattr(given, name) <= most:
            parser.error(f"--{name.split('_')[-1]} must lie between 0 and {most}")
    if given.images and (given.text_only or not given.rasters):
        parser.error("--images needs a pixel comparison: give --rasters and omit --text-only")
    return given


def overlays(rows: DataFrame, pairs: DataFrame, given: argparse.Namespace) -> DataFrame:
    """(pair_id, file_name, png) of the pages that changed or moved."""
    told = rows.where("status != 'same' or alignment = 'moved'").select("pair_id", "idx", "earlier_page", "newer_page")
    drawn = rasters.compare(pairs.join(told, ["pair_id", "idx"], "left_semi"), threshold(given.sensitivity), align=not given.no_align, overlays=True)
    name = F.format_string("a%s-b%s.png", F.coalesce(F.col("earlier_page").cast("string"), F.lit("x")), F.coalesce(F.col("newer_page").cast("string"), F.lit("x")))
    return drawn.join(told, ["pair_id", "idx"]).select("pair_id", name.alias("file_name"), F.col("overlay").alias("png"))


def run(given: argparse.Namespace) -> int:
    spark = SparkSession.builder.getOrCreate()
    rows = compare.compare_text(spark.read.parquet(given.pages), given.match_threshold, not given.no_moves).persist()
    shown, pairs = rows, None
    if given.rasters and not given.text_only:
        pairs = rasters.on_common_grid(rows, spark.read.parquet(given.rasters))
        shown = compare.compare_pairs(rows, pairs, sensitivity=given.sensitivity, align=not given.no_align).drop("regions").persist()
    changes = shown.where("n_changes > 0").select("pair_id", "idx", F.explode("text_changes").alias("c"))
    changes = changes.select("pair_id", "idx", "c.seq", "c.kind", "c.before", "c.after")
    reports = RENDER[given.format](shown, changes)
    if given.out:
        reports.write.mode("overwrite").partitionBy("pair_id").text(given.out)
    else:
        for row in reports.orderBy("pair_id").toLocalIterator():
            print(row["report"])
    if given.images:
        overlays(shown, pairs, given).write.mode("overwrite").parquet(given.images)
    totals = report.totals(shown, ["pair_id"])
    told = totals.agg(F.sum("unreadable_pages").alias("unreadable_pages"), F.sum("pages").alias("pages")).first()
    gate = report.gates(totals).agg(F.max("has_unreadable").alias("u"), F.max("has_changes").alias("c")).first()
    if gate["u"] and not given.quiet:
        print(f"warning: {told['unreadable_pages']} of {told['pages']} pages have text that cannot be decoded", file=sys.stderr)
    shown.unpersist()
    rows.unpersist()
    return int(bool(given.fail_on_unreadable and gate["u"] or given.fail_on_change and gate["c"]))


def main(argv: list[str]) -> int:
    given = arguments(argv)
    try:
        return run(given)
    except Exception as error:  # whatever stopped the run is told in one line
        print(f"revdelta: {error}", file=sys.stderr)
        return 3


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
