"""Command line: the three jobs over a stored page table or result files.

  python -m lotwise source   --pages PATH --source cars.com --out DIR [limits]
  python -m lotwise combined --pages PATH --out DIR [--sites ...] [--max-pages N] [--no-parquet] [limits]
  python -m lotwise merge    --input 'DIR/*_results.csv' --output DIR/combined_listings.csv

Runs on the active (cluster) session; on a laptop it starts a local one.
"""

from __future__ import annotations

import argparse
from functools import partial
from datetime import datetime, timezone

from pyspark.sql import SparkSession

from lotwise.operators import dedupe
from lotwise.plans import jobs
from lotwise.operators.sites import SITES
from lotwise.schema import COMBINED_LIMITS, DEFAULT_CRITERIA, FILE_STEM, SOURCES
from lotwise.session import apply_conf, ship_package
from lotwise.sources.pages import read_pages


def _limits(ap: argparse.ArgumentParser, price_default: int, with_year: bool = True) -> None:
    ap.add_argument("--price-max", type=int, default=price_default)
    ap.add_argument("--miles-max", type=int, default=DEFAULT_CRITERIA["mileage_max"])
    if with_year:
        ap.add_argument("--year-min", type=int, default=DEFAULT_CRITERIA["year_min"])


# Names a user may give for a source: its own, and its result files' stem.
SITE_NAMES = {**{s: s for s in SOURCES}, **{stem: s for s, stem in FILE_STEM.items()}}


def site_list(text: str) -> list[str]:
    """Sources by name; an unknown name is refused."""
    names = [x.strip().lower() for x in text.split(",") if x.strip()]
    if unknown := [n for n in names if n not in SITE_NAMES]:
        raise argparse.ArgumentTypeError(f"unknown site {', '.join(unknown)}; known: {', '.join(SITE_NAMES)}")
    return list(dict.fromkeys(SITE_NAMES[n] for n in names))


def main(argv=None) -> None:
    ap = argparse.ArgumentParser(prog="lotwise")
    sub = ap.add_subparsers(dest="cmd", required=True)
    s = sub.add_parser("source", help="one source: pages -> rows -> de-dupe -> stats -> filter -> CSV")
    s.add_argument("--pages", required=True)
    s.add_argument("--source", required=True, choices=SOURCES)
    s.add_argument("--out", required=True)
    s.add_argument("--max-pages", type=int)
    _limits(s, DEFAULT_CRITERIA["price_max"])
    c = sub.add_parser("combined", help="all sources: union, de-dupe, limits, sort, snapshot, counts")
    c.add_argument("--pages", required=True)
    c.add_argument("--out", required=True)
    c.add_argument("--sites", type=site_list, default=SOURCES, help="comma-separated: " + ", ".join(SITE_NAMES))
    c.add_argument("--max-pages", type=int, default=8)
    c.add_argument("--no-parquet", action="store_true")
    c.add_argument("--run-ts", help="run stamp (ISO, UTC); default now")
    _limits(c, COMBINED_LIMITS["price_max"], with_year=False)
    m = sub.add_parser("merge", help="result CSV files -> earliest first_seen per URL")
    m.add_argument("--input", required=True)
    m.add_argument("--output", required=True)
    a = ap.parse_args(argv)

    # No web UI (no extra port); an existing (cluster) session is reused as is.
    spark = SparkSession.builder.config("spark.ui.enabled", "false").getOrCreate()
    apply_conf(spark)
    ship_package(spark)
    if a.cmd == "source":
        pages = read_pages(a.pages, spark, sources=[a.source], max_page=a.max_pages)
        run = jobs.job_source(pages, a.source, dict(price_max=a.price_max, mileage_max=a.miles_max,
                                                    year_min=a.year_min), out_dir=a.out)
        run.summary.show(truncate=False)
        run.crawls.show(truncate=False)
        print(f"wrote {run.csv_path}; quarantined pages: {run.errors.count()}")
    elif a.cmd == "combined":
        run_ts = a.run_ts or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%S")
        quarantined = {}

        def rows_of(src: str):
            pages = read_pages(a.pages, spark, sources=[src], max_page=a.max_pages)
            rows, _, errors = jobs.source_rows(pages, run_ts=run_ts)
            quarantined[src] = errors.count()
            return dedupe.dedupe_keep_blank(rows, jobs.ORDER) if SITES[src].dedupes else rows

        per_source = {src: partial(rows_of, src) for src in a.sites}
        run = jobs.job_combined(per_source, jobs.ORDER, dict(price_max=a.price_max, mileage_max=a.miles_max),
                                out_dir=a.out, run_ts=run_ts, write_parquet=not a.no_parquet)
        run.counts.show()
        print(f"snapshot: {run.snapshot}; quarantined pages: {quarantined}; failed sources: {run.failed}")
    else:
        merged = jobs.job_merge(spark, a.input, a.output)
        print("No rows found to merge." if merged is None else f"merged {merged.count()} rows into {a.output}")


if __name__ == "__main__":
    main()
