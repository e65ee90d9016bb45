"""Sort, limit, union and schema operators."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lotwise.plans.sizing import staged
from lotwise.schema import LISTING


def sort_price_miles(df: DataFrame, tie: Sequence[str | Column] = ()) -> DataFrame:
    """price ascending, then mileage ascending, NULLs last; ``tie`` keeps the
    input order among equal rows (a distributed range sort)."""
    return df.orderBy(F.asc_nulls_last("price"), F.asc_nulls_last("mileage"), *tie)


def with_position(ordered: DataFrame, name: str = "position") -> DataFrame:
    """Number the rows of a sorted table from 1 in its order: the place within
    the sort's partition plus the sizes of the partitions before it."""
    rows, _ = staged(ordered.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}), "positions")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offsets = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select(
        "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    place = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("_offset") + 1
    return rows.join(offsets, "_part").withColumn(name, place).drop("_part", "_at", "_offset")


def limit_pages(pages: DataFrame, max_pages: int) -> DataFrame:
    """At most ``max_pages`` pages per crawl (page numbers start at 1).
    A plain predicate on ``page_no``: it reaches the Parquet scan."""
    return pages.filter(F.col("page_no") <= max_pages)


def union_all(dfs: Sequence[DataFrame]) -> DataFrame:
    """Stack tables by column name; a column one table lacks is NULL there.  At
    least one table is needed (an empty choice has no columns)."""
    if not dfs:
        raise ValueError("no table to stack")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def project_listing(df: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """The 8 listing columns in fixed order, typed; missing ones are NULL."""
    have = set(df.columns)
    cols = [
        (F.col(f.name).cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name)
        for f in LISTING.fields
    ]
    return df.select(*cols, *extra)


def default_first_seen(df: DataFrame, run_ts: str) -> DataFrame:
    """Add ``first_seen`` = ``run_ts`` only when the column is absent."""
    if "first_seen" in df.columns:
        return df
    return df.withColumn("first_seen", F.lit(run_ts))


__all__ = ["sort_price_miles", "with_position", "limit_pages", "union_all", "project_listing", "default_first_seen"]
