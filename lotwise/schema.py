"""Fixed schemas: listing rows, fetched pages, search criteria."""

from __future__ import annotations

from pyspark.sql import types as T

# The listing schema: same 8 names, same order, in every writer and reader.
LISTING_COLS = ["source", "title", "price", "mileage", "dealer", "location", "url", "first_seen"]

LISTING = T.StructType(
    [
        T.StructField("source", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("price", T.LongType()),
        T.StructField("mileage", T.LongType()),
        T.StructField("dealer", T.StringType()),
        T.StructField("location", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("first_seen", T.StringType()),
    ]
)

# One row per fetched page.  (source, category, crawl_id) names a crawl;
# page_no orders the pages of a crawl.
PAGE_KEYS = ["source", "category", "crawl_id", "page_no"]
PAGES = T.StructType(
    [
        T.StructField("source", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("crawl_id", T.LongType()),
        T.StructField("page_no", T.IntegerType()),
        T.StructField("url", T.StringType()),
        T.StructField("status", T.IntegerType()),
        T.StructField("fetched_at", T.StringType()),
        T.StructField("html", T.StringType()),
    ]
)

# One row per saved search.
CRITERIA = T.StructType(
    [
        T.StructField("criteria_id", T.LongType()),
        T.StructField("zip", T.StringType()),
        T.StructField("radius_miles", T.IntegerType()),
        T.StructField("price_max", T.LongType()),
        T.StructField("mileage_max", T.LongType()),
        T.StructField("year_min", T.IntegerType()),
        T.StructField("region", T.StringType()),
    ]
)

# ---- fixed values (must equal the behaviour being reproduced) ---------------
SOURCE_A = "cars.com"
SOURCE_B = "cargurus"
SOURCE_C = "craigslist"
SOURCES = [SOURCE_A, SOURCE_B, SOURCE_C]

# Order of sources in the combined run: craigslist, cars.com, cargurus.
COMBINED_RANK = {SOURCE_C: 0, SOURCE_A: 1, SOURCE_B: 2}
# Order of per-source result files in the file merge (alphabetical file names:
# cargurus_results, carscom_results, craigslist_results).
FILE_RANK = {SOURCE_B: 0, SOURCE_A: 1, SOURCE_C: 2}
# Result file stem per source.
FILE_STEM = {SOURCE_A: "carscom", SOURCE_B: "cargurus", SOURCE_C: "craigslist"}

# Default search criteria, and the limits of the combined run.
DEFAULT_CRITERIA = dict(zip="19102", radius_miles=200, price_max=4500, mileage_max=200000, year_min=2004, region="philadelphia")
COMBINED_LIMITS = dict(price_max=4000, mileage_max=200000)

# Page geometry of the three sites.
PAGE_SIZE_A = 50
PAGE_STEP_C = 120
CATEGORIES_C = ["cto", "cta"]
