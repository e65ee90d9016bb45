"""Page tables and the search frontier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwise.functions.scalars import url_encode
from lotwise.schema import PAGE_SIZE_A, PAGE_STEP_C, PAGES, SOURCE_A, SOURCE_B, SOURCE_C

PAGE_COLS = [f.name for f in PAGES.fields]


def read_pages(src: DataFrame | str, spark: SparkSession | None = None, sources=None, max_page: int | None = None) -> DataFrame:
    """A ``PAGES`` table (Parquet path or DataFrame), pruned to its columns.

    Source and page filters are plain predicates, so Catalyst pushes them
    into the Parquet scan (and prunes ``source=`` partitions) before any
    HTML is read.
    """
    df = spark.read.parquet(src) if isinstance(src, str) else src
    df = df.select(*PAGE_COLS)
    if sources is not None:
        df = df.filter(F.col("source").isin(list(sources)))
    if max_page is not None:
        df = df.filter(F.col("page_no") <= max_page)
    return df


# ---- fixed values: search URLs of the three sites ---------------------------------------------
SEARCH_A = "https://www.cars.com/shopping/results/"
SEARCH_B = "https://www.cargurus.com/Cars/inventorylisting/viewDetailsFilterViewInventoryListing.action"
SEARCH_C_HOST = ".craigslist.org/search/"
# Parameters in order, as (name, criteria column or literal).
PARAMS_A = [("stock_type", "=used"), ("maximum_distance", "radius_miles"), ("zip", "zip"),
            ("list_price_max", "price_max"), ("mileage_max", "mileage_max"), ("year_min", "year_min"),
            ("page", "#page"), ("page_size", f"={PAGE_SIZE_A}")]
PARAMS_B = [("zip", "zip"), ("radius", "radius_miles"), ("maxPrice", "price_max"), ("maxMileage", "mileage_max"),
            ("minYear", "year_min"), ("inventorySearch", "=true"), ("page", "#page")]
PARAMS_C = [("postal", "zip"), ("search_distance", "radius_miles"), ("max_price", "price_max"),
            ("auto_year_min", "year_min"), ("auto_miles_max", "mileage_max"), ("s", "#offset")]


def _query(params) -> Column:
    parts = []
    for i, (name, v) in enumerate(params):
        if v.startswith("="):
            val = F.lit(v[1:])
        elif v == "#page":
            val = F.col("page_no")
        elif v == "#offset":
            val = (F.col("page_no") - 1) * PAGE_STEP_C
        else:
            val = F.col(v)
        parts += [F.lit(("&" if i else "") + name + "="), url_encode(val)]
    return F.concat(*parts)


def frontier(criteria: DataFrame, max_pages: int, categories: Column | None = None) -> DataFrame:
    """One page URL per (criteria, source, category, page 1..max_pages).

    Generated with ``explode`` (no join): each criteria row fans out to a
    fixed number of pages, so the plan is a narrow map.
    """
    cats = categories if categories is not None else F.array(F.lit("cto"), F.lit("cta"))
    crawls = F.concat(
        F.array(F.struct(F.lit(SOURCE_A).alias("source"), F.lit("").alias("category")),
                F.struct(F.lit(SOURCE_B).alias("source"), F.lit("").alias("category"))),
        F.transform(cats, lambda c: F.struct(F.lit(SOURCE_C).alias("source"), c.alias("category"))),
    )
    x = (criteria.withColumn("_crawl", F.explode(crawls))
         .withColumn("page_no", F.explode(F.sequence(F.lit(1), F.lit(max_pages))))
         .select("*", "_crawl.source", "_crawl.category").drop("_crawl"))
    url = (F.when(F.col("source") == SOURCE_A, F.concat(F.lit(SEARCH_A + "?"), _query(PARAMS_A)))
           .when(F.col("source") == SOURCE_B, F.concat(F.lit(SEARCH_B + "?"), _query(PARAMS_B)))
           .otherwise(F.concat(F.lit("https://"), F.col("region"), F.lit(SEARCH_C_HOST), F.col("category"),
                               F.lit("?"), _query(PARAMS_C))))
    return x.select("criteria_id", "source", "category", F.col("page_no").cast("int").alias("page_no"),
                    url.alias("url"))
