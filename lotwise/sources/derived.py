"""Listings derived from the driver's TPC-H-like tables.

``lineitem`` joined with ``part`` on the part key gives one listing per line:
the same expressions are written in SQL in ``lotwise.plans.sqlparts`` so the
two engines can be compared.  ``seq`` is not unique, so row order is
``ORDER`` (seq, then the inputs every output column depends on).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwise.functions.scalars import clean_number, url_strip, utc_stamp
from lotwise.schema import SOURCE_A, SOURCE_B, SOURCE_C

# Reading order of derived rows (total on distinct outputs).
ORDER = ["seq", "l_partkey", "l_suppkey", "first_seen", "l_extendedprice", "l_quantity"]

LINE_COLUMNS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_shipdate", "p_name",
                "p_brand"]

URL_BASE = "https://www.example.com/vehicledetail/"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def derived_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines that listing rows are made of, with their source."""
    li = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_shipdate"
    )
    pt = read_table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand")
    # No hint: the planner broadcasts `part` only when its measured size is
    # under the threshold, and shuffles both sides on the part key otherwise.
    ln = F.col("l_linenumber")
    source = F.when(ln % 3 == 0, F.lit(SOURCE_A)).when(ln % 3 == 1, F.lit(SOURCE_B)).otherwise(F.lit(SOURCE_C))
    return li.join(pt, li.l_partkey == pt.p_partkey).select(*li.columns, "p_name", "p_brand", source.alias("source"))


def line_seq() -> Column:
    return (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("bigint")


def text_of(lines: DataFrame) -> DataFrame:
    """Lines as listing rows in text, the way a page shows them; further columns stay."""
    ln = F.col("l_linenumber")
    more = [c for c in lines.columns if c not in (*LINE_COLUMNS, "source")]
    return lines.select(
        line_seq().alias("seq"),
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "source",
        F.concat(F.year("l_shipdate").cast("string"), F.lit(" "), F.col("p_name")).alias("title"),
        F.concat(F.lit("$"), F.format_number(F.floor("l_extendedprice"), 0)).alias("price_text"),
        F.concat(F.floor(F.col("l_quantity") * 4000).cast("string"), F.lit(" mi.")).alias("mileage_text"),
        F.col("p_brand").alias("dealer"),
        F.when(F.col("l_suppkey") % 10 == 0, F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("Loc "), F.col("l_suppkey").cast("string"))).alias("location"),
        F.concat(F.lit(URL_BASE), F.col("l_partkey").cast("string"), F.lit("?utm_source=s"), ln.cast("string"),
                 F.lit("#top")).alias("raw_url"),
        utc_stamp("l_shipdate").alias("first_seen"), *more,
    )


def derived_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listing rows as text, the way a page shows them (before cleaning)."""
    return text_of(derived_lines(spark, sf_dir))


def clean(text: DataFrame) -> DataFrame:
    """Text listing rows -> typed ``LISTING`` columns (plus order columns)."""
    return text.select(
        *[c for c in text.columns if c not in ("price_text", "mileage_text", "raw_url")],
        clean_number("price_text").alias("price"),
        clean_number("mileage_text").alias("mileage"),
        url_strip("raw_url").alias("url"),
    )


def _seen(first_seen: Column) -> Column:
    at = (F.col("l_partkey") + F.col("l_suppkey")) % 29
    return F.when(at == 6, F.lit(None)).when(at == 7, F.lit("")).otherwise(first_seen)


def line_order() -> list[Column]:
    """``ORDER`` of the listings that are made of ``derived_lines``, by the lines' own columns."""
    made = {"seq": line_seq(), "first_seen": _seen(utc_stamp("l_shipdate"))}
    return [made.get(c, F.col(c)) for c in ORDER]


def with_gaps(t: DataFrame) -> DataFrame:
    """Unknown and blank values, by part and supplier key, in every listing
    column; a quarter of the URLs is shared by all sources."""
    k, s = F.col("l_partkey"), F.col("l_suppkey")
    null = F.lit(None)
    own = F.when(k % 4 == 1, F.lit("")).otherwise(F.concat(F.lit("/"), (F.col("l_linenumber") % 3).cast("string")))
    return t.withColumns({
        "title": F.when(s % 19 == 2, null).when(s % 19 == 3, F.lit("")).when(s % 19 == 4, F.substring("title", 6, 1 << 20))
        .otherwise(F.col("title")),
        "dealer": F.when(s % 17 == 5, null).when(s % 17 == 6, F.lit("  ")).otherwise(F.col("dealer")),
        "first_seen": _seen(F.col("first_seen")),
        "price": F.when(s % 13 != 1, F.col("price")),
        "mileage": F.when(s % 11 != 7, F.col("mileage")),
        "url": F.when(k % 23 == 4, null).when(k % 23 == 5, F.lit("")).otherwise(F.concat("url", own)),
    })


def listings_of(lines: DataFrame) -> DataFrame:
    """Lines as cleaned listings, row by row: LISTING columns plus ``ORDER`` columns."""
    return with_gaps(clean(text_of(lines)))


def derived_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned derived listings: LISTING columns plus ``ORDER`` columns."""
    return listings_of(derived_lines(spark, sf_dir))
