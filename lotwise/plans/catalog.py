"""Registered queries: one per operator of the inventory.

Each entry is ``(spark, sf_dir) -> DataFrame`` over the driver tables (or
data Spark derives from them), plus, where the result is SQL-expressible, a
DuckDB statement computing the same rows for the oracle check.  Every
computed column is aliased to the same name on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwise.functions import scalars as fn
from lotwise.operators import dedupe, filters, shape, stats
from lotwise.operators import extract as X
from lotwise.operators import pages as PG
from lotwise.plans import jobs as J
from lotwise.plans import sqlparts as S
from lotwise.schema import COMBINED_RANK, FILE_RANK, FILE_STEM, LISTING, LISTING_COLS
from lotwise.session import scratch_path
from lotwise.sinks import writers as W
from lotwise.sources import files as FS
from lotwise.sources.derived import ORDER, derived_lines, derived_listings, derived_text, line_order, listings_of, read_table
from lotwise.sources.pages import frontier
from lotwise.sources.render import render_pages

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

# Limits used by the derived-listing queries (prices here run ~900-105,000).
TEST_LIMITS = dict(price_max=50000, mileage_max=150000, year_min=1998)
RUN_TS = "2024-01-01T00:00:00"


def query(name: str, sql: str | None = None):
    def deco(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f
    return deco


def combined_rank():
    return J.source_rank(COMBINED_RANK)


def file_rank():
    return J.source_rank(FILE_RANK)


# ---- 2.5 scalar functions -------------------------------------------------------------------

@query("fn_clean_number", S.with_(S.DERIVED_TEXT) + """
SELECT seq, price_text, mileage_text, title,
       TRY_CAST(NULLIF(regexp_replace(price_text, '[^0-9]', '', 'g'), '') AS BIGINT) AS price,
       TRY_CAST(NULLIF(regexp_replace(mileage_text, '[^0-9]', '', 'g'), '') AS BIGINT) AS mileage,
       TRY_CAST(NULLIF(regexp_replace(title, '[^0-9]', '', 'g'), '') AS BIGINT) AS title_digits,
       TRY_CAST(NULLIF(regexp_replace(dealer || location, '[^0-9]', '', 'g'), '') AS BIGINT) AS dealer_loc_digits,
       COALESCE(TRY_CAST(regexp_replace(repeat(price_text, 4), '[^0-9]', '', 'g') AS BIGINT), 9223372036854775807) AS past_long
FROM derived_text""")
def q_fn_clean_number(spark, d):
    t = derived_text(spark, d)
    return t.select("seq", "price_text", "mileage_text", "title",
                    fn.clean_number("price_text").alias("price"),
                    fn.clean_number("mileage_text").alias("mileage"),
                    fn.clean_number("title").alias("title_digits"),
                    fn.clean_number(F.concat("dealer", "location")).alias("dealer_loc_digits"),
                    fn.clean_number(F.repeat("price_text", 4)).alias("past_long"))


@query("fn_url_strip", """
SELECT page_id, url, regexp_replace(url, '(?s)[?#].*$', '') AS url_stripped FROM pages""")
def q_fn_url_strip(spark, d):
    return read_table(spark, d, "pages").select("page_id", "url", fn.url_strip("url").alias("url_stripped"))


@query("fn_url_untrack", f"""
SELECT page_id, url, {S.untrack('url')} AS url_untracked FROM pages""")
def q_fn_url_untrack(spark, d):
    return read_table(spark, d, "pages").select("page_id", "url", fn.url_untrack("url").alias("url_untracked"))


_JOIN_BASE = "https://www.cars.com"


def _href_shapes(url):
    path = F.regexp_replace(url, "^[A-Za-z]+://[^/]+", "")
    host_path = F.regexp_replace(url, "^[A-Za-z]+:", "")
    shape_ = F.col("page_id") % 5
    return (F.when(shape_ == 0, path)
            .when(shape_ == 1, F.regexp_replace(path, "^/", ""))
            .when(shape_ == 2, host_path)
            .when(shape_ == 3, url)
            .otherwise(F.regexp_replace(path, "^[^?#]*", "")))


@query("fn_url_join", """
WITH h AS (
  SELECT page_id,
         CASE page_id % 5
           WHEN 0 THEN regexp_replace(url, '^[A-Za-z]+://[^/]+', '')
           WHEN 1 THEN regexp_replace(regexp_replace(url, '^[A-Za-z]+://[^/]+', ''), '^/', '')
           WHEN 2 THEN regexp_replace(url, '^[A-Za-z]+:', '')
           WHEN 3 THEN url
           ELSE regexp_replace(regexp_replace(url, '^[A-Za-z]+://[^/]+', ''), '^[^?#]*', '') END AS href
  FROM pages)
SELECT page_id, href,
       CASE WHEN href IS NULL THEN NULL
            WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN href
            WHEN starts_with(href, '//') THEN 'https:' || href
            WHEN starts_with(href, '/') THEN 'https://www.cars.com' || href
            WHEN href = '' THEN 'https://www.cars.com'
            WHEN starts_with(href, '?') THEN 'https://www.cars.com' || href
            WHEN starts_with(href, '#') THEN 'https://www.cars.com' || href
            ELSE 'https://www.cars.com/' || href END AS joined
FROM h""")
def q_fn_url_join(spark, d):
    p = read_table(spark, d, "pages").select("page_id", _href_shapes(F.col("url")).alias("href"))
    return p.select("page_id", "href", fn.url_join("href", _JOIN_BASE).alias("joined"))


@query("fn_url_encode", f"""
SELECT page_id, 'u=' || {S.form_encode('url')} || '&page=' || CAST(page_id % 7 + 1 AS VARCHAR) AS query
FROM pages""")
def q_fn_url_encode(spark, d):
    p = read_table(spark, d, "pages")
    return p.select("page_id", F.concat(F.lit("u="), fn.url_encode("url"), F.lit("&page="),
                                        fn.url_encode(F.col("page_id") % 7 + 1)).alias("query"))


@query("fn_strip_parens", S.with_(S.DERIVED_TEXT) + """,
w AS (SELECT seq, CASE l_suppkey % 3 WHEN 0 THEN '(' || location || ')' WHEN 1 THEN '((' || location
                  ELSE location END AS wrapped FROM derived_text)
SELECT seq, wrapped, trim(wrapped, '()') AS stripped FROM w""")
def q_fn_strip_parens(spark, d):
    t = derived_text(spark, d)
    loc = F.col("location")
    w = t.select("seq", F.when(F.col("l_suppkey") % 3 == 0, F.concat(F.lit("("), loc, F.lit(")")))
                 .when(F.col("l_suppkey") % 3 == 1, F.concat(F.lit("(("), loc)).otherwise(loc).alias("wrapped"))
    return w.select("seq", "wrapped", fn.strip_parens("wrapped").alias("stripped"))


@query("fn_title_year", S.with_(S.DERIVED_TEXT) + f"""
SELECT seq, title, {S.year_of('title')} AS year, {S.year_of('substr(title, 6)')} AS name_year FROM derived_text""")
def q_fn_title_year(spark, d):
    t = derived_text(spark, d)
    return t.select("seq", "title", fn.title_year("title").alias("year"),
                    fn.title_year(F.substring("title", 6, 1 << 20)).alias("name_year"))


@query("fn_is_blank", S.with_(S.DERIVED_TEXT) + f""",
w AS (SELECT seq, location, CASE WHEN l_suppkey % 10 = 1 THEN '  ' WHEN l_suppkey % 10 = 2 THEN '' ELSE dealer END AS dealer
      FROM derived_text)
SELECT seq, location, dealer, {S.blank('location')} AS location_blank, {S.blank('dealer')} AS dealer_blank FROM w""")
def q_fn_is_blank(spark, d):
    t = derived_text(spark, d)
    dealer = (F.when(F.col("l_suppkey") % 10 == 1, F.lit("  ")).when(F.col("l_suppkey") % 10 == 2, F.lit(""))
              .otherwise(F.col("dealer")))
    w = t.select("seq", "location", dealer.alias("dealer"))
    return w.select("seq", "location", "dealer", fn.is_blank("location").alias("location_blank"),
                    fn.is_blank("dealer").alias("dealer_blank"))


@query("fn_to_numeric", S.with_(S.DERIVED_TEXT) + """
SELECT seq, TRY_CAST(regexp_replace(price_text, '[$,]', '', 'g') AS BIGINT) AS price,
       TRY_CAST(mileage_text AS BIGINT) AS mileage FROM derived_text""")
def q_fn_to_numeric(spark, d):
    t = derived_text(spark, d)
    return t.select("seq", fn.to_numeric(F.regexp_replace("price_text", "[$,]", "")).alias("price"),
                    fn.to_numeric("mileage_text").alias("mileage"))


@query("fn_fmt_int", S.with_(S.DERIVED) + """
SELECT seq, COALESCE(format('{:,}', mileage), 'n/a') AS mileage_fmt,
       COALESCE(format('{:,}', CASE WHEN l_suppkey % 10 = 0 THEN NULL ELSE price END), 'n/a') AS price_fmt
FROM derived""")
def q_fn_fmt_int(spark, d):
    t = derived_listings(spark, d)
    return t.select("seq", fn.fmt_int("mileage").alias("mileage_fmt"),
                    fn.fmt_int(F.when(F.col("l_suppkey") % 10 != 0, F.col("price"))).alias("price_fmt"))


@query("fn_fmt_currency", S.with_(S.DERIVED) + """
SELECT seq, COALESCE('$' || format('{:,}', CASE WHEN l_suppkey % 10 = 0 THEN NULL ELSE price END), 'n/a') AS price_fmt
FROM derived""")
def q_fn_fmt_currency(spark, d):
    t = derived_listings(spark, d)
    return t.select("seq", fn.fmt_currency(F.when(F.col("l_suppkey") % 10 != 0, F.col("price"))).alias("price_fmt"))


@query("fn_fmt_duration", """
WITH g AS (
  SELECT user_id, CAST(ts AS DATE) AS day,
         (epoch_us(max(ts)) - epoch_us(min(ts))) // 1000000 AS seconds
  FROM events GROUP BY GROUPING SETS ((user_id), (user_id, CAST(ts AS DATE))))
SELECT user_id, day, seconds,
       CASE WHEN seconds >= 3600 THEN printf('%d:%02d:%02d', seconds // 3600, (seconds // 60) % 60, seconds % 60)
            ELSE printf('%d:%02d', (seconds // 60) % 60, seconds % 60) END AS elapsed
FROM g""")
def q_fn_fmt_duration(spark, d):
    e = read_table(spark, d, "events").select("user_id", "ts", F.to_date("ts").alias("day"))
    # per user and per (user, day) in one scan: grouping sets
    g = e.groupingSets([["user_id"], ["user_id", "day"]], "user_id", "day").agg(
        F.min("ts").alias("t0"), F.max("ts").alias("t1"))
    micros = F.unix_micros(F.col("t1").cast("timestamp")) - F.unix_micros(F.col("t0").cast("timestamp"))
    secs = F.floor(micros / 1_000_000).cast("bigint")
    return g.select("user_id", "day", secs.alias("seconds"), fn.fmt_duration(secs).alias("elapsed"))


@query("fn_utc_stamp", """
SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS first_seen, strftime(ts, '%Y%m%d-%H%M%S') AS run_stamp
FROM events""")
def q_fn_utc_stamp(spark, d):
    e = read_table(spark, d, "events")
    return e.select("event_id", fn.utc_stamp("ts").alias("first_seen"), fn.run_stamp("ts").alias("run_stamp"))


# ---- 2.6 row filters ------------------------------------------------------------------------

_L = TEST_LIMITS


@query("flt_criteria_full", S.with_(S.DERIVED) + f"""
SELECT seq, {S.LISTING} FROM derived WHERE {S.passes(_L['price_max'], _L['mileage_max'], _L['year_min'])}""")
def q_flt_criteria_full(spark, d):
    t = derived_listings(spark, d)
    return filters.criteria_full(t, _L["price_max"], _L["mileage_max"], _L["year_min"]).select("seq", *LISTING_COLS)


@query("flt_criteria_no_miles", S.with_(S.DERIVED) + f"""
SELECT seq, {S.LISTING} FROM derived WHERE {S.passes(_L['price_max'], None, _L['year_min'])}""")
def q_flt_criteria_no_miles(spark, d):
    t = derived_listings(spark, d)
    return filters.criteria_no_miles(t, _L["price_max"], _L["year_min"]).select("seq", *LISTING_COLS)


@query("flt_limits", S.with_(S.DERIVED) + f"""
SELECT seq, {S.LISTING} FROM derived WHERE {S.passes(_L['price_max'], _L['mileage_max'], None)}""")
def q_flt_limits(spark, d):
    t = derived_listings(spark, d)
    return filters.limits(t, _L["price_max"], _L["mileage_max"]).select("seq", *LISTING_COLS)


@query("flt_sources", S.with_(S.DERIVED) + f"""
SELECT seq, {S.LISTING} FROM derived WHERE source IN ('cars.com', 'craigslist')""")
def q_flt_sources(spark, d):
    t = derived_listings(spark, d)
    return filters.sources(t, ["cars.com", "craigslist"]).select("seq", *LISTING_COLS)


def nation_criteria(spark, d) -> DataFrame:
    """One saved search per nation (a region), limits spread by key."""
    n = read_table(spark, d, "nation")
    k = F.col("n_nationkey")
    return n.select(
        k.cast("bigint").alias("criteria_id"),
        F.format_string("%05d", (k + 19100)).alias("zip"),
        (F.col("n_regionkey") * 50 + 50).cast("int").alias("radius_miles"),
        (k * 3000 + 20000).cast("bigint").alias("price_max"),
        (k * 6000 + 40000).cast("bigint").alias("mileage_max"),
        (k % 7 + 1995).cast("int").alias("year_min"),
        F.lower(F.regexp_replace("n_name", "[^A-Za-z]", "")).alias("region"),
    )


NATION_CRITERIA_SQL = """crit AS (
  SELECT CAST(n_nationkey AS BIGINT) AS criteria_id, printf('%05d', n_nationkey + 19100) AS zip,
         CAST(n_regionkey * 50 + 50 AS INTEGER) AS radius_miles,
         CAST(n_nationkey * 3000 + 20000 AS BIGINT) AS price_max,
         CAST(n_nationkey * 6000 + 40000 AS BIGINT) AS mileage_max,
         CAST(n_nationkey % 7 + 1995 AS INTEGER) AS year_min,
         lower(regexp_replace(n_name, '[^A-Za-z]', '', 'g')) AS region
  FROM nation)"""


@query("flt_many_criteria", S.with_(S.DERIVED, NATION_CRITERIA_SQL) + f"""
SELECT c.criteria_id, d.seq, d.url, d.price, d.mileage
FROM derived d JOIN crit c
  ON d.l_suppkey % 25 = c.criteria_id AND COALESCE(d.price <= c.price_max, TRUE) AND COALESCE(d.mileage <= c.mileage_max, TRUE)
 AND COALESCE({S.year_of('d.title')} >= c.year_min, TRUE)""")
def q_flt_many_criteria(spark, d):
    t = derived_listings(spark, d).select("seq", "url", "price", "mileage", "title",
                                          (F.col("l_suppkey") % 25).cast("bigint").alias("criteria_id"))
    out = filters.many_criteria(t, nation_criteria(spark, d))
    return out.select("criteria_id", "seq", "url", "price", "mileage")


# ---- 2.7 de-duplication and merge -----------------------------------------------------------

@query("ded_url_keep_blank", S.with_(S.DERIVED) + f"""
SELECT seq, {S.LISTING} FROM derived WHERE url IS NULL OR url = ''
UNION ALL
SELECT seq, {S.LISTING} FROM derived WHERE url <> ''
QUALIFY row_number() OVER (PARTITION BY url ORDER BY {S.ORDER}) = 1""")
def q_ded_url_keep_blank(spark, d):
    t = derived_listings(spark, d)
    return dedupe.dedupe_keep_blank(t, ORDER).select("seq", *LISTING_COLS)


@query("ded_url_collapse", S.with_(S.DERIVED) + f"""
SELECT seq, {S.LISTING} FROM derived
QUALIFY row_number() OVER (PARTITION BY NULLIF(url, '') ORDER BY {S.COMBINED_RANK}, {S.ORDER}) = 1""")
def q_ded_url_collapse(spark, d):
    t = derived_listings(spark, d).withColumn("source_rank", combined_rank())
    return dedupe.dedupe_collapse(t, ["source_rank", *ORDER]).select("seq", *LISTING_COLS)


_MERGE_SQL = S.with_(S.DERIVED) + f""",
m AS (
  SELECT {S.LISTING}, {S.FILE_RANK} AS file_rank, seq,
         row_number() OVER (PARTITION BY url ORDER BY (first_seen IS NULL OR first_seen = ''),
                            CASE WHEN first_seen IS NULL OR first_seen = '' THEN '' ELSE first_seen END,
                            {S.FILE_RANK}, {S.ORDER}) AS win,
         first_value({S.FILE_RANK}) OVER (PARTITION BY url ORDER BY {S.FILE_RANK}, {S.ORDER}) AS first_file_rank,
         first_value(seq) OVER (PARTITION BY url ORDER BY {S.FILE_RANK}, {S.ORDER}) AS first_seq,
         min(met) OVER (PARTITION BY url) AS first_met
  FROM (SELECT *, row_number() OVER (ORDER BY {S.FILE_RANK}, {S.ORDER}) AS met FROM derived WHERE url <> ''))
"""


@query("mrg_first_seen", _MERGE_SQL + f"SELECT {S.LISTING} FROM m WHERE win = 1")
def q_mrg_first_seen(spark, d):
    t = derived_listings(spark, d).withColumn("file_rank", file_rank())
    return dedupe.merge_first_seen(t, ["file_rank", *ORDER], keep=LISTING_COLS).select(*LISTING_COLS)


@query("mrg_order", _MERGE_SQL + f"""
SELECT {S.LISTING}, first_file_rank, first_seq, row_number() OVER (ORDER BY first_met) AS position FROM m WHERE win = 1""")
def q_mrg_order(spark, d):
    t = derived_listings(spark, d).withColumn("file_rank", file_rank())
    m = dedupe.merge_first_seen(t, ["file_rank", *ORDER], keep=LISTING_COLS)
    return shape.with_position(dedupe.merge_order(m)).select(
        *LISTING_COLS, F.col("first_pos.file_rank").alias("first_file_rank"),
        F.col("first_pos.seq").alias("first_seq"), "position")


@query("ded_counts", S.with_(S.DERIVED) + """
SELECT source, count(*) AS total_rows,
       count(DISTINCT NULLIF(url, '')) + CAST(count_if(url IS NULL OR url = '') AS BIGINT) AS unique_rows,
       count(*) - (count(DISTINCT NULLIF(url, '')) + CAST(count_if(url IS NULL OR url = '') AS BIGINT)) AS dropped_rows
FROM derived GROUP BY source""")
def q_ded_counts(spark, d):
    return dedupe.dedupe_counts(derived_listings(spark, d), by=["source"])


# ---- 2.8 aggregations -----------------------------------------------------------------------

@query("agg_numeric_stats", S.with_(S.DERIVED) + f"""
SELECT source, count(*) AS rows, {S.stats('price', 'price')}, {S.stats('mileage', 'mileage')}
FROM derived GROUP BY source""")
def q_agg_numeric_stats(spark, d):
    t = derived_listings(spark, d)
    return stats.numeric_summary(t.select("source", "price", "mileage"), {"price": F.col("price"), "mileage": F.col("mileage")}, ["source"],
                                 [F.count(F.lit(1)).alias("rows")])


@query("agg_missing", S.with_(S.DERIVED) + f"""
SELECT source, CAST(count_if({S.blank('title')}) AS BIGINT) AS missing_title, CAST(count_if({S.blank('dealer')}) AS BIGINT) AS missing_dealer,
       CAST(count_if({S.blank('location')}) AS BIGINT) AS missing_location
FROM derived GROUP BY source""")
def q_agg_missing(spark, d):
    t = derived_listings(spark, d)
    return t.groupBy("source").agg(*stats.missing_counts(["title", "dealer", "location"]))


def _combined(spark, d, price_max=_L["price_max"], mileage_max=_L["mileage_max"]):
    t = derived_listings(spark, d).withColumn("source_rank", combined_rank())
    return filters.limits(dedupe.dedupe_collapse(t, ["source_rank", *ORDER]), price_max, mileage_max)


_COMBINED_SQL = S.with_(S.DERIVED) + f""",
comb AS (
  SELECT * FROM (
    SELECT *, {S.COMBINED_RANK} AS source_rank FROM derived
    QUALIFY row_number() OVER (PARTITION BY NULLIF(url, '') ORDER BY {S.COMBINED_RANK}, {S.ORDER}) = 1)
  WHERE {S.passes(_L['price_max'], _L['mileage_max'], None)})
"""


@query("agg_by_source", _COMBINED_SQL + """
SELECT source, count(NULLIF(url, '')) AS listings FROM comb GROUP BY source ORDER BY source""")
def q_agg_by_source(spark, d):
    return stats.by_source(_combined(spark, d))


def per_source_deduped(t: DataFrame) -> DataFrame:
    """Each source's own de-dupe: A and C keep the first row per URL (blank
    URLs all kept); B does not de-duplicate."""
    return dedupe.dedupe_keep_blank(t, ORDER, scope=["source"], keep_all=F.col("source") == "cargurus")


def source_passes():
    """Each source's own filter: A and B check price, mileage and year; C
    checks price and year only."""
    full = filters.passes(_L["price_max"], _L["mileage_max"], _L["year_min"])
    no_miles = filters.passes(_L["price_max"], None, _L["year_min"])
    return F.when(F.col("source") == "craigslist", no_miles).otherwise(full)


_PER_SOURCE_SQL = S.with_(S.DERIVED) + f""",
ps AS (
  SELECT * FROM derived WHERE source = 'cargurus'
  UNION ALL
  SELECT * FROM derived WHERE source <> 'cargurus' AND (url IS NULL OR url = '')
  UNION ALL
  SELECT * FROM derived WHERE source <> 'cargurus' AND url <> ''
  QUALIFY row_number() OVER (PARTITION BY source, url ORDER BY {S.ORDER}) = 1),
psf AS (
  SELECT *, CASE WHEN source = 'craigslist' THEN {S.passes(_L['price_max'], None, _L['year_min'])}
                 ELSE {S.passes(_L['price_max'], _L['mileage_max'], _L['year_min'])} END AS passes
  FROM ps)
"""


@query("agg_raw_vs_filtered", _PER_SOURCE_SQL + f"""
SELECT source, count(*) AS raw_rows, CAST(count_if(passes) AS BIGINT) AS kept_rows,
       {S.stats('price', 'raw_price')}, {S.stats('mileage', 'raw_mileage')},
       {S.stats('CASE WHEN passes THEN price END', 'kept_price')},
       {S.stats('CASE WHEN passes THEN mileage END', 'kept_mileage')},
       CAST(count_if({S.blank('title')}) AS BIGINT) AS missing_title, CAST(count_if({S.blank('dealer')}) AS BIGINT) AS missing_dealer,
       CAST(count_if({S.blank('location')}) AS BIGINT) AS missing_location,
       count(*) - CAST(count_if(passes) AS BIGINT) AS dropped_rows
FROM psf GROUP BY source""")
def q_agg_raw_vs_filtered(spark, d):
    t = per_source_deduped(derived_listings(spark, d))
    return stats.raw_vs_filtered(t, source_passes())


@query("agg_total", S.with_(S.DERIVED) + """
SELECT source, count(*) AS rows FROM derived GROUP BY ROLLUP (source)""")
def q_agg_total(spark, d):
    return stats.total(derived_listings(spark, d), by=["source"])


# ---- 2.9 sort, limit, set, schema -----------------------------------------------------------

@query("srt_price_miles", _COMBINED_SQL + f"""
SELECT seq, {S.LISTING}, row_number() OVER (
  ORDER BY price ASC NULLS LAST, mileage ASC NULLS LAST, source_rank, {S.ORDER}) AS position FROM comb""")
def q_srt_price_miles(spark, d):
    c = _combined(spark, d)
    ordered = shape.sort_price_miles(c, ["source_rank", *ORDER])
    return shape.with_position(ordered).select("seq", *LISTING_COLS, "position")


@query("set_union", S.with_(S.DERIVED) + f"""
SELECT seq, source, title, price, mileage, dealer, location, url, first_seen FROM derived WHERE source = 'cars.com'
UNION ALL
SELECT seq, source, title, price, mileage, dealer, location, url, first_seen FROM derived WHERE source = 'cargurus'
UNION ALL
SELECT seq, source, title, price, NULL AS mileage, NULL AS dealer, location, url, first_seen
FROM derived WHERE source = 'craigslist'""")
def q_set_union(spark, d):
    t = derived_listings(spark, d).select("seq", *LISTING_COLS)
    a = t.filter(F.col("source") == "cars.com")
    b = t.filter(F.col("source") == "cargurus")
    c = t.filter(F.col("source") == "craigslist").drop("mileage", "dealer")
    return shape.union_all([a, b, c]).select("seq", *LISTING_COLS)


@query("sch_project", S.with_(S.DERIVED) + """
SELECT source, title, price, mileage, CAST(NULL AS VARCHAR) AS dealer, location, url, first_seen FROM derived""")
def q_sch_project(spark, d):
    t = derived_listings(spark, d).drop("dealer")  # extra columns present, one missing
    return shape.project_listing(t)


@query("sch_default", S.with_(S.DERIVED) + f"""
SELECT seq, source, title, price, mileage, dealer, location, url, '{RUN_TS}' AS first_seen FROM derived""")
def q_sch_default(spark, d):
    t = derived_listings(spark, d).drop("first_seen")
    return shape.default_first_seen(t, RUN_TS).select("seq", *LISTING_COLS)


# ---- 2.4 extraction (round trip: derived listings -> rendered pages -> extracted rows) -------


def rendered_pages(spark, d) -> DataFrame:
    return render_pages(derived_lines(spark, d))


def extracted(spark, d) -> DataFrame:
    return X.extract(rendered_pages(spark, d))


_EXP = S.with_(S.DERIVED_TEXT) + f""",
pg AS (
  SELECT *, CAST(l_orderkey // 1000 AS BIGINT) * 100000
           + CAST((row_number() OVER (PARTITION BY source, l_orderkey ORDER BY {S.ORDER}) - 1) // 150 AS BIGINT) AS crawl_id,
         CAST(l_orderkey % 1000 + 1 AS INTEGER) AS page_no,
         CASE WHEN source = 'craigslist' THEN CASE WHEN (l_orderkey // 1000) % 2 = 0 THEN 'cto' ELSE 'cta' END
              ELSE '' END AS category,
         l_orderkey % 2 = 0 AS structured, l_partkey % 11 = 0 AS guard, l_partkey % 5 = 1 AS rel,
         '/vehicledetail/' || CAST(l_partkey AS VARCHAR) AS path,
         CAST(floor(l_extendedprice) AS BIGINT) AS price_n, CAST(floor(l_quantity * 4000) AS BIGINT) AS miles_n,
         CASE WHEN l_orderkey % 107 = 13 THEN 503 ELSE 200 END AS status,
         l_orderkey % 101 = 7 AS challenge,
         l_orderkey % 109 = 17 AND l_orderkey % 107 <> 13 AND l_orderkey % 101 <> 7
           AND (source = 'cars.com' OR l_orderkey % 2 = 1) AS broken
  FROM derived_text),
pgx AS (
  SELECT *, CASE WHEN l_orderkey % 7 <> 3 THEN min(first_seen) OVER (PARTITION BY source, l_orderkey, crawl_id) END
              AS fetched_at FROM pg),
exp0 AS (
  SELECT source, category, crawl_id, page_no, l_orderkey, {S.ORDER.replace('first_seen', 'first_seen AS fs')},
         fetched_at AS first_seen,
         CASE WHEN source = 'cars.com' THEN 'cards' WHEN structured AND source = 'cargurus' THEN 'json'
              WHEN structured THEN 'jsonld' ELSE 'cards' END AS extractor,
         CASE WHEN guard THEN NULL
              WHEN source = 'cars.com' AND l_partkey % 2 = 1 THEN substr(title, 1, 4) || substr(title, 6)
              ELSE title END AS title,
         CASE WHEN guard THEN NULL
              WHEN source = 'cars.com' AND rel THEN 'https://www.cars.com' || path
              WHEN source = 'cargurus' AND structured AND l_partkey % 4 = 2 THEN 'https://www.cargurus.com' || path
              WHEN source = 'cargurus' AND NOT structured AND l_partkey % 3 = 2 THEN 'https://www.cargurus.com' || path
              WHEN source = 'craigslist' AND rel THEN 'https://philadelphia.craigslist.org' || path
              ELSE 'https://www.example.com' || path END AS url,
         CASE WHEN source = 'cargurus' AND structured AND NOT guard AND l_partkey % 4 = 3 THEN price_n * 10 + 5
              WHEN source = 'craigslist' AND structured AND l_partkey % 3 = 0 THEN price_n * 100
              ELSE price_n END AS price,
         CASE WHEN source = 'craigslist' THEN NULL ELSE miles_n END AS mileage,
         CASE WHEN source = 'craigslist' THEN NULL ELSE dealer END AS dealer,
         CASE WHEN source = 'cargurus' AND structured AND guard THEN NULL ELSE location END AS location
  FROM pgx WHERE status = 200 AND NOT challenge AND NOT broken),
exp1 AS (
  SELECT * FROM exp0 WHERE url IS NOT NULL OR title IS NOT NULL OR extractor = 'json'),
expected AS (
  SELECT * FROM exp1 WHERE source = 'cargurus' OR url IS NULL
  UNION ALL
  SELECT * FROM exp1 WHERE source <> 'cargurus' AND url IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY source, l_orderkey, crawl_id, url
                             ORDER BY {S.ORDER.replace('first_seen', 'fs')}) = 1),
pages_exp AS (
  SELECT p.source, p.category, p.l_orderkey, p.crawl_id, p.page_no, p.status, p.structured, p.challenge, p.broken,
         p.fetched_at,
         CAST(COALESCE(e.n, 0) AS INTEGER) AS n_rows,
         CASE WHEN p.status <> 200 OR p.broken THEN NULL WHEN COALESCE(e.n, 0) = 0 THEN 'cards'
              WHEN p.source = 'cargurus' AND p.structured THEN 'json'
              WHEN p.source = 'craigslist' AND p.structured THEN 'jsonld' ELSE 'cards' END AS extractor
  FROM (SELECT DISTINCT source, category, l_orderkey, crawl_id, page_no, status, structured, challenge, broken, fetched_at
        FROM pgx) p
  LEFT JOIN (SELECT source, l_orderkey, crawl_id, count(*) AS n FROM expected GROUP BY ALL) e
    ON p.source = e.source AND p.l_orderkey = e.l_orderkey AND p.crawl_id = e.crawl_id)
"""
_EX_COLS = ["source", "crawl_id", "page_no", "title", "price", "mileage", "dealer", "location", "url", "first_seen",
            "extractor"]
_EX_SQL_COLS = ", ".join(_EX_COLS)


def _ex_rows(spark, d, cond, source: str):
    # Page filters go before the extraction job by hand: Catalyst cannot
    # push a predicate on the job's output through it.
    pages = rendered_pages(spark, d).filter(F.col("source") == source)
    return X.listings(X.extract(pages)).filter(cond).select(*_EX_COLS)


@query("ex_cards_a", _EXP + f"SELECT {_EX_SQL_COLS} FROM expected WHERE source = 'cars.com'")
def q_ex_cards_a(spark, d):
    return _ex_rows(spark, d, F.col("source") == "cars.com", "cars.com")


@query("ex_json_b", _EXP + f"SELECT {_EX_SQL_COLS} FROM expected WHERE source = 'cargurus' AND extractor = 'json'")
def q_ex_json_b(spark, d):
    return _ex_rows(spark, d, F.col("extractor") == "json", "cargurus")


@query("ex_cards_b", _EXP + f"SELECT {_EX_SQL_COLS} FROM expected WHERE source = 'cargurus' AND extractor = 'cards'")
def q_ex_cards_b(spark, d):
    return _ex_rows(spark, d, F.col("extractor") == "cards", "cargurus")


@query("ex_jsonld_c", _EXP + f"SELECT {_EX_SQL_COLS} FROM expected WHERE source = 'craigslist' AND extractor = 'jsonld'")
def q_ex_jsonld_c(spark, d):
    return _ex_rows(spark, d, F.col("extractor") == "jsonld", "craigslist")


@query("ex_rows_c", _EXP + f"SELECT {_EX_SQL_COLS} FROM expected WHERE source = 'craigslist' AND extractor = 'cards'")
def q_ex_rows_c(spark, d):
    return _ex_rows(spark, d, F.col("extractor") == "cards", "craigslist")


@query("ex_json_find", _EXP + """
SELECT crawl_id, page_no, extractor, n_rows FROM pages_exp WHERE source = 'cargurus'""")
def q_ex_json_find(spark, d):
    pages = rendered_pages(spark, d).filter(F.col("source") == "cargurus")
    return X.page_heads(X.extract(pages)).select("crawl_id", "page_no", "extractor", "n_rows")


@query("ex_fallback", _EXP + """
SELECT source, crawl_id, page_no, extractor, n_rows FROM pages_exp""")
def q_ex_fallback(spark, d):
    return X.page_heads(extracted(spark, d)).select("source", "crawl_id", "page_no", "extractor", "n_rows")


@query("ex_guard", _EXP + """
SELECT source, extractor, count(*) AS rows, CAST(count_if(url IS NULL AND title IS NULL) AS BIGINT) AS rows_without_url_or_title
FROM expected GROUP BY ALL""")
def q_ex_guard(spark, d):
    rows = X.listings(extracted(spark, d))
    return rows.groupBy("source", "extractor").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(fn.is_empty("url") & fn.is_empty("title")).alias("rows_without_url_or_title"))


@query("ex_page_dedupe", _EXP + """
SELECT source, crawl_id, page_no, count(*) AS rows, count(DISTINCT url) AS distinct_urls
FROM expected GROUP BY ALL""")
def q_ex_page_dedupe(spark, d):
    rows = X.listings(extracted(spark, d))
    return rows.groupBy("source", "crawl_id", "page_no").agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("url").alias("distinct_urls"))


@query("ex_stamp", _EXP + f"""
SELECT source, crawl_id, page_no, min(COALESCE(first_seen, '{RUN_TS}')) AS first_seen_min,
       max(COALESCE(first_seen, '{RUN_TS}')) AS first_seen_max, min(p.fetched_at) AS fetched_at
FROM expected e JOIN (SELECT source AS s2, crawl_id AS c2, page_no AS p2, fetched_at FROM pages_exp) p
  ON e.source = p.s2 AND e.crawl_id = p.c2 AND e.page_no = p.p2
GROUP BY ALL""")
def q_ex_stamp(spark, d):
    rows = X.listings(X.extract(rendered_pages(spark, d), RUN_TS))
    return rows.groupBy("source", "crawl_id", "page_no").agg(
        F.min("first_seen").alias("first_seen_min"), F.max("first_seen").alias("first_seen_max"),
        F.min("fetched_at").alias("fetched_at"))


@query("ex_map_b", S.with_(S.DERIVED_TEXT) + """
SELECT seq,
       CASE WHEN l_partkey % 11 = 0 THEN NULL ELSE title END AS title,
       CASE WHEN l_partkey % 11 <> 0 AND l_partkey % 4 = 3 THEN CAST(floor(l_extendedprice) AS BIGINT) * 10 + 5
            ELSE CAST(floor(l_extendedprice) AS BIGINT) END AS price,
       CAST(floor(l_quantity * 4000) AS BIGINT) AS mileage, dealer,
       CASE WHEN l_partkey % 11 = 0 THEN NULL ELSE location END AS location,
       CASE WHEN l_partkey % 11 = 0 THEN NULL
            WHEN l_partkey % 4 = 2 THEN 'https://www.cargurus.com/vehicledetail/' || CAST(l_partkey AS VARCHAR)
            ELSE 'https://www.example.com/vehicledetail/' || CAST(l_partkey AS VARCHAR) END AS url
FROM derived_text WHERE source = 'cargurus'""")
def q_ex_map_b(spark, d):
    from lotwise.sources.render import item_b
    items = derived_text(spark, d).filter(F.col("source") == "cargurus").select("seq", item_b().alias("item"))
    return X.map_json_items(items, "item", ["seq"])


# ---- 2.3 page-level operators ---------------------------------------------------------------


def event_pages(spark, d) -> DataFrame:
    """Events as crawl pages: a user is a crawl, (ts, event_id) the page
    order, an error event a failed fetch (HTTP 500), floor(value) the number
    of listings on the page (0 = no results)."""
    e = read_table(spark, d, "events")
    return e.select(
        "user_id", "event_id", "ts", F.lit("events").alias("source"), F.lit(False).alias("partial"),
        F.when(F.col("event_type") == "error", F.lit(500)).otherwise(F.lit(200)).alias("status"),
        F.floor("value").cast("bigint").alias("n_rows"),
    )


_EV_ORDER = ["ts", "event_id"]

_EV_SQL = """WITH ev AS (
  SELECT user_id, event_id, ts, CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status,
         CAST(floor(value) AS BIGINT) AS n_rows FROM events),
st AS (
  SELECT user_id, ts AS sts, event_id AS sid,
         CASE WHEN status <> 200 THEN 'HTTP ' || CAST(status AS VARCHAR) ELSE 'no results' END AS stop_reason
  FROM ev WHERE status <> 200 OR n_rows = 0
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1),
kept AS (
  SELECT ev.* FROM ev LEFT JOIN st USING (user_id)
  WHERE sts IS NULL OR ev.ts < sts OR (ev.ts = sts AND ev.event_id < sid))
"""


def _event_prefix(spark, d):
    ev = event_pages(spark, d)
    stops = PG.first_stops(ev, ["user_id"], _EV_ORDER, PG.is_stop())
    return PG.prefix(ev, stops, ["user_id"], _EV_ORDER)


@query("pg_prefix", _EV_SQL + "SELECT user_id, event_id, n_rows FROM kept")
def q_pg_prefix(spark, d):
    return _event_prefix(spark, d).select("user_id", "event_id", "n_rows")


@query("pg_stop_reason", _EV_SQL + "SELECT user_id, sid AS stop_event_id, stop_reason FROM st")
def q_pg_stop_reason(spark, d):
    ev = event_pages(spark, d)
    stops = PG.first_stops(ev, ["user_id"], _EV_ORDER, PG.is_stop(), PG.stop_reason())
    return stops.select("user_id", F.col("stop_at.event_id").alias("stop_event_id"), "stop_reason")


@query("pg_progress", _EV_SQL + """
SELECT user_id, event_id, n_rows,
       CAST(sum(n_rows) OVER (PARTITION BY user_id ORDER BY ts, event_id
                              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS cumulative
FROM kept""")
def q_pg_progress(spark, d):
    kept = _event_prefix(spark, d)
    out = PG.running_total(kept, ["user_id"], _EV_ORDER, "n_rows", "cumulative", chunk="range")
    return out.select("user_id", "event_id", "n_rows", "cumulative")


def web_pages(spark, d) -> DataFrame:
    """The driver's ``pages`` table as ``PAGES`` rows of a source with no
    rule table ('web'): crawl page_id div 50, page page_id % 50 + 1."""
    p = read_table(spark, d, "pages")
    return p.select(F.lit("web").alias("source"), F.lit("").alias("category"),
                    (F.col("page_id") / 50).cast("bigint").alias("crawl_id"),
                    (F.col("page_id") % 50 + 1).cast("int").alias("page_no"), "url",
                    F.lit(200).alias("status"), F.lit(None).cast("string").alias("fetched_at"), "html")


def odd_pages(spark, d) -> DataFrame:
    """A page per nation of source B whose listing holds half a surrogate pair, a
    number that is none, one beyond any type, or values of wrong types (a row each), or a
    link that cannot be resolved (an error)."""
    n = F.col("n_nationkey")
    listing = (F.when(n % 5 == 0, '{"title":"half \\ud83d","price":5}').when(n % 5 == 1, '{"title":"t","price":NaN}')
               .when(n % 5 == 2, F.concat(F.lit('{"title":"t","price":'), F.repeat(F.lit("9"), 60), F.lit("}")))
               .otherwise('{"title":{"a":[1]},"price":[true],"url":7}'))
    html = F.when(n % 5 == 4, '<div data-listingid="0"><a href="http://[">x</a></div>').otherwise(
        F.concat(F.lit('<script>{"l":['), listing, F.lit("]}</script>")))
    return read_table(spark, d, "nation").select(
        F.lit("cargurus").alias("source"), F.lit("odd").alias("category"), n.cast("bigint").alias("crawl_id"),
        F.lit(1).alias("page_no"), F.lit("u").alias("url"), F.lit(200).alias("status"),
        F.lit(None).cast("string").alias("fetched_at"), html.alias("html"))


_WEB_SQL = """web AS (
  SELECT 'web' AS source, CAST(page_id // 50 AS BIGINT) AS crawl_id, CAST(page_id % 50 + 1 AS INTEGER) AS page_no,
         url, html FROM pages)"""


@query("src_pages", "WITH " + _WEB_SQL + """
SELECT source, crawl_id, page_no, url, CAST(length(html) AS INTEGER) AS html_chars FROM web""")
def q_src_pages(spark, d):
    from lotwise.sources.pages import read_pages
    p = read_pages(web_pages(spark, d))
    return p.select("source", "crawl_id", "page_no", "url", F.length("html").alias("html_chars"))


@query("pg_ok", _EXP + "SELECT DISTINCT source, crawl_id, page_no FROM pgx WHERE status = 200")
def q_pg_ok(spark, d):
    return PG.ok(rendered_pages(spark, d)).select("source", "crawl_id", "page_no")


def _phrase_sql(col: str, phrases) -> str:
    return "(" + " OR ".join(f"contains(lower({col}), '{p}')" for p in phrases) + ")"


@query("pg_bot_check", _EXP + ", " + _WEB_SQL + f"""
SELECT DISTINCT source, crawl_id, page_no, status = 200 AND challenge AS bot_check FROM pgx
UNION ALL
SELECT source, crawl_id, page_no, COALESCE({_phrase_sql('html', X.BOT_PHRASES)}, FALSE) AS bot_check FROM web""")
def q_pg_bot_check(spark, d):
    p = rendered_pages(spark, d).unionByName(web_pages(spark, d))
    return p.select("source", "crawl_id", "page_no", PG.bot_check("html").alias("bot_check"))


@query("pg_partial", _EXP + ", " + _WEB_SQL + f"""
SELECT DISTINCT source, crawl_id, page_no, status = 200 AND NOT challenge AND l_orderkey % 103 = 11 AS partial FROM pgx
UNION ALL
SELECT source, crawl_id, page_no,
       COALESCE(contains(lower(html), '{X.BANNER_PHRASE_1}')
                OR (contains(lower(html), '{X.BANNER_PHRASE_2}') AND contains(lower(html), '{X.BANNER_PHRASE_3}')),
                FALSE) AS partial
FROM web""")
def q_pg_partial(spark, d):
    p = rendered_pages(spark, d).unionByName(web_pages(spark, d))
    return p.select("source", "crawl_id", "page_no", PG.partial_banner("html").alias("partial"))


@query("pg_suspect", _EXP + "SELECT source, crawl_id, page_no FROM pages_exp WHERE status = 200 AND challenge")
def q_pg_suspect(spark, d):
    return PG.suspects(X.page_heads(extracted(spark, d))).select("source", "crawl_id", "page_no")


_EXP_TWICE = _EXP.replace(
    "AND NOT challenge AND NOT broken", "AND (NOT challenge OR again) AND NOT broken").replace(
    "l_orderkey % 101 = 7 AS challenge,", "l_orderkey % 101 = 7 AS challenge, l_orderkey % 202 = 7 AND l_orderkey % 109 <> 17 AS again,")


@query("pg_versions", _EXP_TWICE + """,
pst AS (
  SELECT *, status <> 200 OR (n_rows = 0 AND NOT broken)
            OR (source = 'cars.com' AND status = 200 AND l_orderkey % 103 = 11
                AND (NOT challenge OR (l_orderkey % 202 = 7 AND l_orderkey % 109 <> 17))) AS stop
  FROM pages_exp),
fst AS (SELECT source, category, crawl_id, min(page_no) AS stop_page FROM pst WHERE stop GROUP BY ALL)
SELECT e.source, e.category, e.crawl_id, e.page_no,
       CASE WHEN e.l_orderkey % 202 = 7 AND e.l_orderkey % 109 <> 17 THEN 2 ELSE 1 END AS fetch_no, count(*) AS rows
FROM expected e LEFT JOIN fst f USING (source, category, crawl_id)
WHERE f.stop_page IS NULL OR e.page_no < f.stop_page GROUP BY ALL""")
def q_pg_versions(spark, d):
    lines = derived_lines(spark, d)
    pages = render_pages(lines).withColumn("fetch_no", F.lit(1)).unionByName(
        render_pages(lines, second_fetch=True).withColumn("fetch_no", F.lit(2)))
    rows, _, _ = J.source_rows(pages)
    return rows.groupBy("source", "category", "crawl_id", "page_no", "fetch_no").agg(F.count(F.lit(1)).alias("rows"))


@query("lim_pages", _EXP + "SELECT DISTINCT source, category, crawl_id, page_no FROM pgx WHERE page_no <= 8")
def q_lim_pages(spark, d):
    return shape.limit_pages(rendered_pages(spark, d), 8).select("source", "category", "crawl_id", "page_no")


@query("err_isolate", _EXP + ", " + _WEB_SQL + """
SELECT p.source, count(*) AS pages, CAST(COALESCE(sum(p.n_rows), 0) AS BIGINT) AS rows,
       CAST(count_if(p.broken) AS BIGINT) AS error_pages
FROM pages_exp p GROUP BY p.source
UNION ALL
SELECT 'web' AS source, count(*) AS pages, CAST(0 AS BIGINT) AS rows, count(*) AS error_pages FROM web
UNION ALL
SELECT 'odd' AS source, count(*) AS pages, CAST(count_if(n_nationkey % 5 <> 4) AS BIGINT) AS rows,
       CAST(count_if(n_nationkey % 5 = 4) AS BIGINT) AS error_pages FROM nation""")
def q_err_isolate(spark, d):
    ext = X.extract(rendered_pages(spark, d).unionByName(web_pages(spark, d)).unionByName(odd_pages(spark, d)))
    heads = X.page_heads(ext).withColumn("source", F.when(F.col("category") == "odd", "odd").otherwise(F.col("source")))
    return heads.groupBy("source").agg(
        F.count(F.lit(1)).alias("pages"), F.sum("n_rows").alias("rows"),
        F.count_if(F.col("error").isNotNull()).alias("error_pages"))


# ---- 2.1 sources and 2.2 sinks (write to a fresh folder under the shared dir, read back) -----


def _read_csv(spark, path) -> DataFrame:
    return (spark.read.schema(LISTING).option("header", True).option("multiLine", True).option("escape", '"')
            .csv(path))


_LISTING_SQL = S.with_(S.DERIVED) + f"SELECT {S.LISTING} FROM derived"
_CSV_SQL = S.with_(S.DERIVED) + f"SELECT {S.LISTING_CSV} FROM derived"


@query("snk_csv", _CSV_SQL)
def q_snk_csv(spark, d):
    path = scratch_path(spark, "csv")
    W.write_csv(derived_listings(spark, d), path)
    return _read_csv(spark, path)


@query("snk_parquet", _LISTING_SQL)
def q_snk_parquet(spark, d):
    path = scratch_path(spark, "parquet")
    W.write_parquet(derived_listings(spark, d), path)
    return spark.read.parquet(path).select(*LISTING_COLS)


@query("snk_per_source", _LISTING_SQL)
def q_snk_per_source(spark, d):
    path = scratch_path(spark, "per-source")
    W.write_per_source(derived_listings(spark, d), path)
    return spark.read.parquet(path).select(*LISTING_COLS)


@query("snk_snapshot", S.with_(S.DERIVED) + f"SELECT {S.LISTING_CSV}, 'run=20240101-000000' AS run FROM derived")
def q_snk_snapshot(spark, d):
    base = scratch_path(spark, "snapshots")
    path = W.write_snapshot(derived_listings(spark, d), base, RUN_TS)
    return _read_csv(spark, f"{path}/csv").withColumn("run", F.lit(path.rsplit("/", 1)[1]))


@query("snk_merged", _MERGE_SQL + f"""
SELECT {S.LISTING_CSV}, row_number() OVER (ORDER BY first_met) AS position FROM m WHERE win = 1""")
def q_snk_merged(spark, d):
    t = derived_listings(spark, d).withColumn("file_rank", file_rank())
    merged = dedupe.merge_first_seen(t, ["file_rank", *ORDER], keep=LISTING_COLS)
    path = scratch_path(spark, "merged")
    W.write_merged(merged, path)
    back = _read_csv(spark, path).select("*", F.col("_metadata.file_name").alias("_file"),
                                         F.monotonically_increasing_id().alias("_row"))
    return shape.with_position(back.orderBy("_file", "_row")).drop("_file", "_row")


@query("snk_skip_empty", S.with_(S.DERIVED) + """
SELECT s.source, count(d.seq) > 0 AS written, count(d.seq) AS rows
FROM (VALUES ('cars.com'), ('cargurus'), ('craigslist')) s(source)
LEFT JOIN derived d ON d.source = s.source AND d.source <> 'cargurus'
GROUP BY s.source""")
def q_snk_skip_empty(spark, d):
    t = derived_listings(spark, d).filter(F.col("source") != "cargurus")
    base = scratch_path(spark, "skip-empty")
    W.write_if_any(t, W.write_per_source, base, fmt="csv")  # one write; an empty source has no folder
    found = (spark.read.schema(LISTING).option("header", True).option("multiLine", True).option("escape", '"').csv(base)
             .groupBy("source").agg(F.count(F.lit(1)).alias("n")))
    names = spark.createDataFrame([(s,) for s in FILE_STEM], "source string")
    return names.join(found, "source", "left").select(
        "source", F.col("n").isNotNull().alias("written"), F.coalesce("n", F.lit(0)).alias("rows"))


def _write_results_files(spark, d, base: str, layouts: dict | None = None, stems: dict | None = None) -> None:
    """Derived listings as per-source result files, rows in reading order."""
    t = derived_listings(spark, d)
    for src, stem in (stems or FILE_STEM).items():
        part = t.filter(F.col("source") == src).orderBy(*ORDER)
        cols = (layouts or {}).get(src, LISTING_COLS)
        sel = [F.col(c) if c in part.columns else F.lit("x").alias(c) for c in cols]
        (part.select(*sel).write.mode("overwrite").option("header", True).option("escape", '"')
         .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
         .csv(f"{base}/{stem}_results.csv"))


@query("src_csv_glob", S.with_(S.DERIVED) + """
SELECT source, NULLIF(title, '') AS title, price, mileage,
       CASE WHEN source = 'cargurus' THEN NULL ELSE NULLIF(dealer, '') END AS dealer,
       location, NULLIF(url, '') AS url, NULLIF(first_seen, '') AS first_seen,
       CASE source WHEN 'cars.com' THEN 'carscom_results.csv' WHEN 'cargurus' THEN 'cargurus_results.csv'
            ELSE 'combined_listings.csv.craigslist_results.csv' END AS results_file
FROM derived""")
def q_src_csv_glob(spark, d):
    base = scratch_path(spark, "results")
    layouts = {
        "cars.com": [*(f"extra_{i}" for i in range(40)), *LISTING_COLS],  # a wide file
        "cargurus": ["vin", "source", "title", "price", "mileage", "location", "url", "first_seen"],
        "craigslist": list(reversed(LISTING_COLS)),
    }
    # an earlier merged output in the same folder must be left out, a file with
    # a similar name must not
    stems = {**FILE_STEM, "craigslist": "combined_listings.csv.craigslist"}
    _write_results_files(spark, d, base, layouts, stems)
    earlier = dedupe.merge_first_seen(derived_listings(spark, d).withColumn("file_rank", file_rank()),
                                      ["file_rank", *ORDER], keep=LISTING_COLS)
    W.write_merged(earlier, f"{base}/combined_listings.csv")
    rows = FS.typed(FS.read_listing_csv(spark, f"{base}/*.csv", exclude=f"{base}/combined_listings.csv"))
    return rows.select(*LISTING_COLS,
                       F.regexp_extract("file", "([^/]+_results\\.csv)/", 1).alias("results_file"))


@query("src_rows", S.with_(S.DERIVED_TEXT) + f"""
SELECT source, title, TRY_CAST(NULLIF(regexp_replace(price_text, '[^0-9]', '', 'g'), '') AS BIGINT) AS price,
       TRY_CAST(NULLIF(regexp_replace(mileage_text, '[^0-9]', '', 'g'), '') AS BIGINT) AS mileage,
       dealer, location, {S.untrack('raw_url')} AS url, '{RUN_TS}' AS first_seen
FROM derived_text""")
def q_src_rows(spark, d):
    t = derived_text(spark, d)
    rows = t.select("source", "title", fn.clean_number("price_text").cast("string").alias("price"),
                    fn.clean_number("mileage_text").alias("mileage"), "dealer", "location",
                    F.col("raw_url").alias("url"))
    return FS.as_listings(rows, RUN_TS).select(*LISTING_COLS)


_FRONTIER_SQL = S.with_(NATION_CRITERIA_SQL) + """,
crawls(source, category) AS (VALUES ('cars.com', ''), ('cargurus', ''), ('craigslist', 'cto'), ('craigslist', 'cta')),
pg AS (SELECT CAST(range AS INTEGER) AS page_no FROM range(1, 9))
SELECT c.criteria_id, w.source, w.category, p.page_no,
  CASE w.source
    WHEN 'cars.com' THEN 'https://www.cars.com/shopping/results/?stock_type=used&maximum_distance=' || c.radius_miles
      || '&zip=' || c.zip || '&list_price_max=' || c.price_max || '&mileage_max=' || c.mileage_max
      || '&year_min=' || c.year_min || '&page=' || p.page_no || '&page_size=50'
    WHEN 'cargurus' THEN 'https://www.cargurus.com/Cars/inventorylisting/viewDetailsFilterViewInventoryListing.action'
      || '?zip=' || c.zip || '&radius=' || c.radius_miles || '&maxPrice=' || c.price_max
      || '&maxMileage=' || c.mileage_max || '&minYear=' || c.year_min || '&inventorySearch=true&page=' || p.page_no
    ELSE 'https://' || c.region || '.craigslist.org/search/' || w.category || '?postal=' || c.zip
      || '&search_distance=' || c.radius_miles || '&max_price=' || c.price_max || '&auto_year_min=' || c.year_min
      || '&auto_miles_max=' || c.mileage_max || '&s=' || ((p.page_no - 1) * 120) END AS url
FROM crit c CROSS JOIN crawls w CROSS JOIN pg p"""


@query("src_frontier", _FRONTIER_SQL)
def q_src_frontier(spark, d):
    return frontier(nation_criteria(spark, d), 8)


_CATEGORY_SETTINGS = ["both", "all", "cta", "cto,cta", "xyz", " CTA , cto "]


@query("src_categories", """
WITH s AS (
  SELECT n_nationkey, CASE n_nationkey % 6 WHEN 0 THEN 'both' WHEN 1 THEN 'all' WHEN 2 THEN 'cta'
                            WHEN 3 THEN 'cto,cta' WHEN 4 THEN 'xyz' ELSE ' CTA , cto ' END AS setting
  FROM nation)
SELECT n_nationkey, setting,
       CASE n_nationkey % 6 WHEN 0 THEN 'cto,cta' WHEN 1 THEN 'cto,cta' WHEN 2 THEN 'cta' WHEN 3 THEN 'cto,cta'
            WHEN 4 THEN 'cto' ELSE 'cta,cto' END AS categories
FROM s""")
def q_src_categories(spark, d):
    n = read_table(spark, d, "nation")
    setting = F.element_at(F.array(*[F.lit(x) for x in _CATEGORY_SETTINGS]), (F.col("n_nationkey") % 6 + 1).cast("int"))
    s = n.select("n_nationkey", setting.alias("setting"))
    return s.select("n_nationkey", "setting", F.array_join(PG.category_choice(F.col("setting")), ",").alias("categories"))


# ---- 2.10 composite jobs ------------------------------------------------------------------

@query("job_source", _EXP + f""",
pst AS (
  SELECT *, status <> 200 OR (n_rows = 0 AND NOT broken)
            OR (source = 'cars.com' AND status = 200 AND NOT challenge AND l_orderkey % 103 = 11) AS stop
  FROM pages_exp WHERE source = 'cars.com'),
fst AS (SELECT source, category, crawl_id, min(page_no) AS stop_page FROM pst WHERE stop GROUP BY ALL),
pre AS (
  SELECT e.* FROM expected e LEFT JOIN fst f USING (source, category, crawl_id)
  WHERE e.source = 'cars.com' AND (f.stop_page IS NULL OR e.page_no < f.stop_page)),
dd AS (
  SELECT * FROM pre
  QUALIFY url IS NULL OR row_number() OVER (PARTITION BY url ORDER BY crawl_id, page_no,
                                           {S.ORDER.replace('first_seen', 'fs')}) = 1)
SELECT 'listing' AS kind, source, title, price, mileage, dealer, location, url, first_seen,
       CAST(NULL AS BIGINT) AS crawl_id, CAST(NULL AS INTEGER) AS page_no, CAST(NULL AS BIGINT) AS n_rows,
       CAST(NULL AS BIGINT) AS cumulative
FROM dd WHERE {S.passes(_L['price_max'], _L['mileage_max'], _L['year_min'])}
UNION ALL
SELECT 'progress', source, NULL, NULL, NULL, NULL, NULL, NULL, NULL, crawl_id, page_no, n_rows,
       CAST(sum(n_rows) OVER (ORDER BY crawl_id, page_no) AS BIGINT)
FROM pst LEFT JOIN fst f USING (source, category, crawl_id)
WHERE n_rows > 0 AND (f.stop_page IS NULL OR page_no < f.stop_page)""")
def q_job_source(spark, d):
    out = scratch_path(spark, "job-source")
    run = J.job_source(rendered_pages(spark, d), "cars.com", criteria=TEST_LIMITS, out_dir=out)
    progress = run.progress.select(F.lit("progress").alias("kind"), "source", "crawl_id", "page_no",
                                   F.col("n_rows").cast("bigint").alias("n_rows"), "cumulative")
    return _read_csv(spark, run.csv_path).withColumn("kind", F.lit("listing")).unionByName(
        progress, allowMissingColumns=True)


@query("job_combined", _COMBINED_SQL + f"SELECT {S.LISTING_CSV} FROM comb")
def q_job_combined(spark, d):
    t = derived_listings(spark, d)
    tracked = F.when(~fn.is_empty("url"), F.concat("url", F.lit("?utm_source="), "source", F.lit("#top"))).otherwise(F.col("url"))
    t = t.withColumn("url", tracked)  # one listing under several tracked URLs
    out = scratch_path(spark, "job-combined")
    run = J.job_combined(t, ORDER, limits=TEST_LIMITS, out_dir=out, run_ts=RUN_TS)
    return _read_csv(spark, f"{run.snapshot}/csv")


@query("job_merge", _MERGE_SQL + f"SELECT {S.LISTING_CSV} FROM m WHERE win = 1")
def q_job_merge(spark, d):
    base = scratch_path(spark, "job-merge")
    W.write_results_files(derived_lines(spark, d), f"{base}/results", line_order(),
                          {src: f"{stem}_results.csv" for src, stem in FILE_STEM.items()}, finish=listings_of, compression="lz4")
    output = f"{base}/combined_listings.csv"
    J.job_merge(spark, f"{base}/results/file=*_results.csv", output)
    return _read_csv(spark, output)
