"""Row filters: search limits, source choice, many saved searches at once.

Limits are inclusive and unknown values pass: only a known price above the
maximum, a known mileage above the maximum, or a known model year below the
minimum rejects a row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotwise.functions.scalars import title_year


def _v(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def passes(price_max=None, mileage_max=None, year_min=None) -> Column:
    """The row predicate; a limit left as None is not checked."""
    cond = F.lit(True)
    if price_max is not None:
        cond = cond & F.coalesce(F.col("price") <= _v(price_max), F.lit(True))
    if mileage_max is not None:
        cond = cond & F.coalesce(F.col("mileage") <= _v(mileage_max), F.lit(True))
    if year_min is not None:
        cond = cond & F.coalesce(title_year("title") >= _v(year_min), F.lit(True))
    return cond


def criteria_full(df: DataFrame, price_max, mileage_max, year_min) -> DataFrame:
    """Price, mileage and year limits (sources A and B)."""
    return df.filter(passes(price_max, mileage_max, year_min))


def criteria_no_miles(df: DataFrame, price_max, year_min) -> DataFrame:
    """Price and year limits; mileage is not checked (source C)."""
    return df.filter(passes(price_max, None, year_min))


def limits(df: DataFrame, price_max, mileage_max) -> DataFrame:
    """Price and mileage limits only (the combined run)."""
    return df.filter(passes(price_max, mileage_max, None))


def sources(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Rows of the chosen sources (exact names)."""
    return df.filter(F.col("source").isin(list(names)))


def many_criteria(df: DataFrame, criteria: DataFrame, use_year: bool = True, use_miles: bool = True) -> DataFrame:
    """Listings of many saved searches: each row is held against the limits of
    the search it was crawled for (``criteria_id``, unique in ``criteria``).

    An equality join: the planner broadcasts the searches while they are small
    and shuffles both sides on the search beyond that (AQE splits a search that
    holds a large share of the rows).  Rows without a known search are left out.
    """
    c = criteria.select(
        "criteria_id",
        F.col("price_max").alias("_pmax"),
        F.col("mileage_max").alias("_mmax"),
        F.col("year_min").alias("_ymin"),
    )
    cond = passes(F.col("_pmax"), F.col("_mmax") if use_miles else None, F.col("_ymin") if use_year else None)
    return df.join(c, "criteria_id").filter(cond).drop("_pmax", "_mmax", "_ymin")
