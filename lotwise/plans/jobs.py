"""Composite jobs: one source, all sources combined, file merge.

Each job is a lazy plan plus the writes; the costly extraction output is
checkpointed once (reliable checkpoint in the shared folder) because stops,
stats and rows all read it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwise.operators import dedupe, extract as X, filters, pages as PG, shape, stats
from lotwise.plans.sizing import broadcast_if_small, materialised, staged
from lotwise.operators.sites import SITES, Site
from lotwise.schema import COMBINED_LIMITS, DEFAULT_CRITERIA, LISTING, LISTING_COLS
from lotwise.session import freed_shuffles, small_splits
from lotwise.sinks import writers as W
from lotwise.sources.files import NUMBER_ORDER, as_listings, named, numbered_listing_csv

CRAWL = ["source", "category", "crawl_id"]


@dataclass
class SourceRun:
    rows: DataFrame        # filtered listing rows, reading order columns kept
    summary: DataFrame     # counts and stats before / after the filter
    crawls: DataFrame      # per crawl: first stop and its reason
    errors: DataFrame      # quarantined pages
    progress: DataFrame    # per parsed page: rows on it and the running total for the source
    csv_path: str | None


def category_rank(sites: dict[str, Site] = SITES):
    """The place of a page's category among its source's."""
    out = F.lit(0)
    for name, site in sites.items():
        for i, category in enumerate(site.categories):
            out = F.when((F.col("source") == name) & (F.col("category") == category), F.lit(i)).otherwise(out)
    return out


def source_rows(pages: DataFrame, checkpoint: bool = True, with_progress: bool = False, gap_is_stop: bool = False,
                run_ts: str | None = None, sites: dict[str, Site] = SITES):
    """Pages -> (extracted rows up to each crawl's first stop, stops, errors
    [, per-page progress]).  With ``gap_is_stop`` a missing page number also
    ends its crawl (reason 'missing page').  If the pages carry ``fetch_no``, a page that
    was fetched again (after a bot check, say) counts once, with its best version, before
    any stop is looked for."""
    ext = X.extract(pages, run_ts, sites)
    if checkpoint:
        ext = materialised(ext)
    heads = X.page_heads(ext)
    if "fetch_no" in pages.columns:  # of a page fetched again, the better version counts
        gone, _ = broadcast_if_small(PG.superseded(heads, [*CRAWL, "page_no"]), PG.MAX_BROADCAST_CRAWLS)
        ext, heads = PG.without(ext, gone), PG.without(heads, gone)
    stop, reason = PG.is_stop(error="error", sites=sites), PG.stop_reason(sites=sites)
    if gap_is_stop:
        gaps = PG.gap_pages(heads, CRAWL).withColumn("_gap", F.lit(True))
        heads = heads.join(gaps, [*CRAWL, "page_no"], "left")
        gap = F.coalesce(F.col("_gap"), F.lit(False))
        stop, reason = stop | gap, F.when(gap, F.lit("missing page")).otherwise(reason)
    stops = PG.first_stops(heads, CRAWL, ["page_no"], stop, reason)
    rows = PG.prefix(X.listings(ext), stops, CRAWL, ["page_no"])
    rows = rows.withColumn("category_rank", category_rank(sites))
    if not with_progress:
        return rows, stops, X.errors(ext)
    # Parsed pages (before each stop) with their row counts; the running total
    # runs on across the categories and crawls of a source, in reading order.
    parsed = PG.prefix(heads.filter(F.col("n_rows") > 0), stops, CRAWL, ["page_no"]).withColumn(
        "category_rank", category_rank(sites))
    progress = PG.running_total(parsed.select("source", "category", "category_rank", "crawl_id", "page_no", "n_rows"),
                                ["source"], ["category_rank", "crawl_id", "page_no"], "n_rows", "cumulative",
                                chunk="range")
    return rows, stops, X.errors(ext), progress


ORDER = ["category_rank", "crawl_id", "page_no", "pos"]


def job_source(pages: DataFrame, source: str, criteria: dict | None = None, out_dir: str | None = None,
               approx: bool = False, gap_is_stop: bool = False, run_ts: str | None = None,
               sites: dict[str, Site] = SITES) -> SourceRun:
    """One source of ``sites``: pages -> rows -> de-dupe -> stats -> filter -> stats -> CSV."""
    site = sites[source]
    c = dict(DEFAULT_CRITERIA, **(criteria or {}))
    p = pages.filter(F.col("source") == source)
    rows, stops, errs, progress = source_rows(p, with_progress=True, gap_is_stop=gap_is_stop, run_ts=run_ts, sites=sites)
    deduped = materialised(dedupe.dedupe_keep_blank(rows, ORDER)) if site.dedupes else rows  # one source per run
    passes = filters.passes(c["price_max"], c["mileage_max"] if site.limits_mileage else None, c["year_min"])
    summary = stats.raw_vs_filtered(deduped, passes, by=["source"], fields=list(site.reported), approx=approx)
    counts = dedupe.dedupe_counts(rows, by=["source"])
    summary = counts.join(summary, "source", "right")
    kept = deduped.filter(passes)
    path = None
    if out_dir:
        path = f"{out_dir.rstrip('/')}/{site.file_stem}_results.csv"
        W.write_csv(kept, path, order=ORDER)
    return SourceRun(kept, summary, stops, errs, progress, path)


def source_rank(mapping: dict) -> F.Column:
    """The rank of a row's source; unknown sources come last."""
    e = None
    for k, v in mapping.items():
        e = F.when(F.col("source") == k, F.lit(v)) if e is None else e.when(F.col("source") == k, F.lit(v))
    return e.otherwise(F.lit(len(mapping)))


@dataclass
class CombinedRun:
    rows: DataFrame
    counts: DataFrame
    snapshot: str | None
    failed: dict[str, str]  # sources whose rows could not be computed, and why


def _staged_sources(per_source, sources, stamp: str) -> tuple[DataFrame, int, dict[str, str]]:
    """The typed rows of all sources in one table partitioned by source, their
    number, and the sources that failed.  All are written at once; only if that fails
    is each written alone, to tell which ones do."""
    failed: dict[str, str] = {}
    tables: dict[str, DataFrame] = {}

    def tried(name: str, make: Callable):
        try:
            return make()
        except Exception as ex:  # noqa: BLE001 -- one source's failure is reported, the others go on
            failed[name] = f"{type(ex).__name__}: {ex}"
            return None

    if isinstance(per_source, DataFrame):
        chosen = per_source if sources is None else per_source.where(F.col("source").isin(*sources))
        tables["all"] = as_listings(chosen, stamp)
    else:
        for name, rows in per_source.items():
            if sources is None or name in set(sources):
                t = tried(name, lambda: as_listings(rows() if callable(rows) else rows, stamp))  # noqa: B023
                tables.update({name: t} if t is not None else {})
    empty = SparkSession.active().createDataFrame([], LISTING)
    try:
        return *staged(shape.union_all([*tables.values(), empty]), "combined", "source"), failed
    except Exception:  # noqa: BLE001 -- narrowed down to its source below
        if isinstance(per_source, DataFrame) or not tables:
            raise
    parts = {name: tried(name, lambda: staged(t, "combined", "source")) for name, t in tables.items()}  # noqa: B023
    parts = [p for p in parts.values() if p]
    return shape.union_all([*(p[0] for p in parts), empty]), sum(p[1] for p in parts), failed


def job_combined(per_source: DataFrame | dict[str, DataFrame | Callable[[], DataFrame]], order: list[str],
                 limits: dict | None = None, out_dir: str | None = None, run_ts: str | None = None, sources=None,
                 write_parquet: bool = True, sites: dict[str, Site] = SITES) -> CombinedRun:
    """All sources: per-source outputs, union, de-dupe (first by source rank
    then reading order), limits, sort by price and mileage, snapshot, counts.
    De-dupe comes before the limits, as in the combined run.

    ``per_source`` is one table with all sources, read once, or a table (or a function
    that makes it) for each.  Their typed rows (URLs without tracking parameters, numbers,
    a first_seen) are written once, and all further steps read that table; it is
    counted while it is written.  With a table for each, a source that fails counts as
    empty, is named in ``failed``, and the others go on.  Without any row nothing is
    written.  Per-source outputs are one write partitioned by source; the sorted result
    is materialised too, so the snapshot's CSV and Parquet copies and the counts reuse one sort.
    """
    lim = dict(COMBINED_LIMITS, **(limits or {}))
    stamp = run_ts or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%S")
    union, n, failed = _staged_sources(per_source, sources, stamp)
    if out_dir and n:
        W.write_per_source(union, f"{out_dir}/by_source_csv", fmt="csv")
        if write_parquet:
            W.write_per_source(union, f"{out_dir}/by_source_parquet", fmt="parquet")
    keyed = ["source_rank", *[c for c in order if c in union.columns]]
    ranked = union.withColumn("source_rank", source_rank({n: s.rank for n, s in sites.items()}))
    combined = filters.limits(dedupe.dedupe_collapse(ranked, keyed), lim["price_max"], lim["mileage_max"])
    ordered = shape.sort_price_miles(combined, keyed)
    snap = None
    if out_dir and run_ts and n:
        ordered = materialised(ordered)
        if not ordered.isEmpty():
            snap = W.write_snapshot(ordered, f"{out_dir}/combined", run_ts, parquet=write_parquet)
    return CombinedRun(ordered, stats.by_source(ordered), snap, failed)


def job_merge(spark: SparkSession, input_glob: str, output: str | None = None) -> DataFrame | None:
    """Per-source CSV files -> one row per URL, earliest ``first_seen``,
    in order of first encounter.  No files or no rows: nothing is written, None back.

    Rows are told apart by numbers; the names of their files come back only in the result's ``first_pos``.
    The merged rows are kept as Parquet, and each step's shuffle files go when it ends.  The files are
    read more than once, always in the same pieces."""
    with freed_shuffles(spark), small_splits(spark):
        read = numbered_listing_csv(spark, input_glob, exclude=output)
        if read is None:
            return None
        rows, files = read
        merged, n = staged(dedupe.merge_first_seen(rows, NUMBER_ORDER, keep=LISTING_COLS), "merged")
        if not n:
            return None
        if output:
            W.write_merged(merged, output)
    return named(merged, "first_pos", files)


__all__ = ["job_source", "job_combined", "job_merge", "SourceRun", "CombinedRun"]
