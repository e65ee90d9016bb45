"""Page-level operators: usable pages, stop pages, crawl prefixes, progress.

A crawl is a sequence of pages (or events) ordered by ``order`` columns
within ``crawl`` key columns.  The source stops a crawl at its first
unusable page; here that is a keyed aggregate (first stop per crawl) joined
back, not a window over the crawl -- a crawl holding a third of all rows is
combined map-side instead of sorted in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lotwise.functions.scalars import py_strip
from lotwise.operators.extract import bot_check, partial_banner  # noqa: F401  (re-exported)
from lotwise.plans.sizing import broadcast_if_small, materialised
from lotwise.operators.sites import SITES, names

# Crawls per broadcast of the first-stop table (one small row per crawl).
MAX_BROADCAST_CRAWLS = 2_000_000


def ok(pages: DataFrame) -> DataFrame:
    """Pages fetched with status 200 (a predicate the Parquet scan receives)."""
    return pages.filter(F.col("status") == 200)


def _banner(source: str, partial: str, sites) -> Column:
    """The out-of-area banner on a page of a source where it ends a crawl."""
    return F.col(source).isin(*names(sites, banner_stops=True)) & F.coalesce(F.col(partial), F.lit(False))


def is_stop(source="source", status="status", n_rows="n_rows", partial="partial", error: str | None = None, sites=SITES) -> Column:
    """A page that ends its crawl: fetch failed or not 200, no listings, or
    (where the source's banner stops) the out-of-area banner.  A page whose parsing failed
    (``error`` set) is quarantined and ends nothing: what it holds is unknown."""
    st = F.col(status)
    none = F.coalesce(F.col(n_rows), F.lit(0)) == 0
    if error is not None:
        none = none & F.col(error).isNull()
    return st.isNull() | (st != 200) | none | _banner(source, partial, sites)


def stop_reason(source="source", status="status", n_rows="n_rows", partial="partial", sites=SITES) -> Column:
    """Why a page stops its crawl (NULL if it does not)."""
    st = F.col(status)
    return (F.when(st.isNull(), F.lit("failed to fetch"))
            .when((st != 200) & F.col(source).isin(*names(sites, banner_stops=True)), F.lit("failed to fetch"))
            .when(st != 200, F.concat(F.lit("HTTP "), st.cast("string")))
            .when(_banner(source, partial, sites), F.lit("partial matches"))
            .when(F.coalesce(F.col(n_rows), F.lit(0)) == 0, F.lit("no results")))


def first_stops(heads: DataFrame, crawl: Sequence[str], order: Sequence[str], stop: Column,
                reason: Column | None = None) -> DataFrame:
    """Per crawl: the order key of its first stop page (``stop_at``) and,
    if given, that page's reason."""
    key = F.struct(*[F.col(c) for c in order])
    aggs = [F.min(key).alias("stop_at")]
    if reason is not None:
        aggs.append(F.min_by(reason, key).alias("stop_reason"))
    return heads.filter(stop).groupBy(*crawl).agg(*aggs)


def gap_pages(heads: DataFrame, crawl: Sequence[str], page: str = "page_no") -> DataFrame:
    """Pages whose predecessor is missing from the table (a first page above
    1 included): the crawl must have ended before them.  An anti-join on
    (crawl, page) keys, which are unique per page, so no key is hot."""
    have = heads.select(*crawl, F.col(page).alias("_p"))
    succ = have.select(*crawl, (F.col("_p") + 1).alias("_p"))
    return have.filter(F.col("_p") > 1).join(succ, [*crawl, "_p"], "left_anti").withColumnRenamed("_p", page)


def prefix(rows: DataFrame, stops: DataFrame, crawl: Sequence[str], order: Sequence[str],
           max_broadcast: int = MAX_BROADCAST_CRAWLS) -> DataFrame:
    """Rows that come before their crawl's first stop (the stopping page
    contributes nothing).  ``stops`` is the output of ``first_stops``.

    The stop table has one row per crawl; it is broadcast after a row count
    proves it small, and shuffle-joined (AQE splits skewed crawls) past that.
    """
    s, _ = broadcast_if_small(stops.select(*crawl, "stop_at"), max_broadcast)
    key = F.struct(*[F.col(c) for c in order])
    j = rows.join(s, list(crawl), "left")
    return j.filter(F.col("stop_at").isNull() | (key < F.col("stop_at"))).drop("stop_at")


def running_total(df: DataFrame, crawl: Sequence[str], order: Sequence[str], value: str, out: str,
                  chunk: Column | str | None = None, max_broadcast: int = MAX_BROADCAST_CRAWLS,
                  range_parts: int | None = None) -> DataFrame:
    """Running sum of ``value`` along each crawl.

    With ``chunk`` (a column that never decreases along ``order``, e.g. the
    day of a timestamp) the sum is built in two levels so no crawl is sorted
    whole in one task: a window inside each (crawl, chunk), plus the totals of
    earlier chunks, which come from a small per-chunk aggregate.

    ``chunk="range"`` makes the chunks from the data: rows are range-
    partitioned on (crawl, order) and the partition number is the chunk, so
    even one crawl holding a third of all rows -- or one busy day of it -- is
    cut into bounded pieces.
    """
    o = [F.col(c) for c in order]
    if chunk is None:
        w = Window.partitionBy(*crawl).orderBy(*o).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return df.withColumn(out, F.sum(value).over(w))
    if isinstance(chunk, str) and chunk == "range":
        n = range_parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        # partition numbers grow along (crawl, order); AQE only merges neighbours
        # Materialised: each range exchange samples bounds of its own, so the
        # chunk numbers must come from one and the same run.
        d = materialised(df.repartitionByRange(n, *crawl, *order).withColumn("_chunk", F.spark_partition_id()))
    else:
        d = df.withColumn("_chunk", chunk)
    w_in = Window.partitionBy(*crawl, "_chunk").orderBy(*o).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    tot = d.groupBy(*crawl, "_chunk").agg(F.sum(value).alias("_t"))
    w_prev = Window.partitionBy(*crawl).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = tot.withColumn("_off", F.coalesce(F.sum("_t").over(w_prev), F.lit(0))).drop("_t")
    offsets, _ = broadcast_if_small(offsets, max_broadcast)
    return (d.withColumn("_in", F.sum(value).over(w_in))
            .join(offsets, [*crawl, "_chunk"], "left")
            .withColumn(out, F.col("_off") + F.col("_in"))
            .drop("_chunk", "_in", "_off"))


def suspects(heads: DataFrame) -> DataFrame:
    """Pages with no listings that look like a bot check: to be fetched
    again (by another client)."""
    return heads.filter((F.col("n_rows") == 0) & F.col("bot_check"))


def superseded(heads: DataFrame, page: Sequence[str]) -> DataFrame:
    """Versions of a page that a better one replaces: its keys and ``fetch_no``.

    Best is a version fetched with status 200 that was parsed and is not suspect, then
    any with status 200, then the latest.  ``heads`` are one row per version; the choice
    is a keyed aggregate, and only pages with several versions are looked at again."""
    fine = (F.col("status") == 200) & F.col("error").isNull() & ~((F.col("n_rows") == 0) & F.col("bot_check"))
    rank = F.when(fine, 2).when(F.col("status") == 200, 1).otherwise(0)
    version = F.struct(F.coalesce(rank, F.lit(0)).alias("rank"), F.coalesce("fetch_no", F.lit(0)).alias("fetch_no"))
    versions = heads.select(*page, version.alias("v"))
    many = versions.groupBy(*page).agg(F.max("v").alias("best"), F.min("v").alias("_least")).where(
        F.col("best") != F.col("_least")).drop("_least")
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in page]
    cond = F.col("a.v") != F.col("b.best")
    for c in same:
        cond = cond & c
    return versions.alias("a").join(many.alias("b"), cond).select(*[F.col(f"a.{c}").alias(c) for c in page],
                                                                  F.col("a.v.fetch_no").alias("fetch_no")).distinct()


def without(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """``rows`` (of pages or listings) without the versions in ``gone``."""
    page = [c for c in gone.columns if c != "fetch_no"]
    cond = F.coalesce(F.col("a.fetch_no"), F.lit(0)) == F.col("b.fetch_no")
    for c in page:
        cond = cond & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    return rows.alias("a").join(gone.alias("b"), cond, "left_anti")


def category_choice(setting: Column) -> Column:
    """Category list from a setting: 'both' / 'all' -> cto, cta; else the
    listed valid ones in order; none valid -> cto."""
    s = py_strip(F.lower(setting))
    listed = F.filter(F.transform(F.split(s, ","), lambda x: py_strip(x)),
                      lambda x: x.isin("cto", "cta"))
    return (F.when(s.isin("both", "all"), F.array(F.lit("cto"), F.lit("cta")))
            .when(F.size(listed) > 0, listed)
            .otherwise(F.array(F.lit("cto"))))
