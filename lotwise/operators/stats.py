"""Summaries: min / median / mean, missing fields, per-source counts.

Counts, minima and means are one aggregate.  The exact median is found by counting
selection in two aggregates.  The first counts, per group, the buckets that the
values fall into (the value with its low bits cleared; at most some 65,000 buckets for
each power of 2^8) along with everything else; from these counts follows the
bucket that holds the middle.  The second counts single values inside that bucket only:
smaller and larger values are moved to its ends, which changes no middle.  Both counts are
combined before the shuffle, so a group that holds a third of all rows costs a few
small tables, and the rows are never sorted.  ``approx=True`` uses
``percentile_approx`` instead, within a single aggregate.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotwise.functions.scalars import is_blank

#: Whole numbers under 2^bits (and over -2^bits) get buckets of 2^shift values.
BUCKET_TIERS = [(16, 0), (24, 8), (32, 16), (40, 24), (48, 32), (56, 40)]
LAST_SHIFT = 47
#: Groups whose middle buckets may be broadcast; checked when the query runs.
MAX_GROUPS = 1_000_000


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _by_tier(v: Column, value_of) -> Column:
    """``value_of(shift)`` for the tier of ``v``."""
    out = None
    for bits, shift in BUCKET_TIERS:
        inside = (v >= -(1 << bits)) & (v < (1 << bits))
        out = F.when(inside, value_of(shift)) if out is None else out.when(inside, value_of(shift))
    return out.when(v.isNotNull(), value_of(LAST_SHIFT))


def bucket_start(v: Column) -> Column:
    """The value with its low bits cleared: it never decreases as ``v`` grows."""
    return _by_tier(v, lambda s: F.call_function("shiftleft", F.shiftright(v, s), F.lit(s)))


def bucket_last(start: Column) -> Column:
    """A value at or after the last one of the bucket that begins at ``start``."""
    return start + _by_tier(start, lambda s: F.lit((1 << s) - 1).cast("bigint"))


def _numeric(c: Column, prefix: str) -> list[Column]:
    n = F.count(c)
    # Summed as decimal(38,0), so it cannot overflow; ``div`` cuts toward zero.
    mean = F.when(n > 0, F.call_function("div", F.sum(c.cast("decimal(38,0)")), n.cast("decimal(20,0)")))
    return [F.min(c).alias(f"{prefix}_min"), mean.cast("bigint").alias(f"{prefix}_avg")]


def numeric_stats(x, prefix: str, approx: bool = False) -> list[Column]:
    """``<prefix>_min`` and ``<prefix>_avg`` ignoring NULL, and with ``approx``
    ``<prefix>_median``; cut to whole numbers toward zero."""
    c = _c(x)
    out = _numeric(c, prefix)
    if approx:
        out.append(F.percentile_approx(c, 0.5, 10000).cast("bigint").alias(f"{prefix}_median"))
    return out


def _middle(column: str, upper: bool) -> Column:
    """The lower (upper) middle value of a column, whose values doubles hold exactly."""
    return F.expr(f"CAST(percentile_disc(0.5) WITHIN GROUP (ORDER BY `{column}`{' DESC' if upper else ''}) AS BIGINT)")


def numeric_summary(df: DataFrame, columns: dict[str, Column], by: Sequence[str], others: Sequence[Column] = (),
                    approx: bool = False, max_groups: int | None = MAX_GROUPS) -> DataFrame:
    """min / exact median / avg of each of ``columns`` per group, plus ``others``.

    ``df`` should hold only the columns used here: the second aggregate reads the same
    columns as the first, so that an exchange below them (of a de-dupe) is computed once
    and read twice.  The first one's row per group is joined to the rows; it is broadcast, and the query stops if there are more than ``max_groups``; with
    ``max_groups=None`` the rows are shuffled to it instead, for any number of groups."""
    numbers = {k: _c(v).cast("bigint") for k, v in columns.items()}
    if approx:
        return df.groupBy(*by).agg(*others, *[c for k, v in numbers.items() for c in numeric_stats(v, k, True)])
    keyed = df.withColumns({f"_v_{k}": v for k, v in numbers.items()})
    keyed = keyed.withColumns({f"_b_{k}": bucket_start(F.col(f"_v_{k}")) for k in numbers})
    first = keyed.groupBy(*by).agg(
        *others, *[c for k in numbers for c in _numeric(F.col(f"_v_{k}"), k)],
        *[_middle(f"_b_{k}", up).alias(f"_{side}_{k}") for k in numbers for side, up in (("lo", False), ("hi", True))])
    shown = [c for c in first.columns if c not in by and not c.startswith(("_lo_", "_hi_"))]
    starts = first.select(*[F.col(b).alias(f"_by_{i}") for i, b in enumerate(by)], F.struct(*shown).alias("_first"),
                          *[c for c in first.columns if c.startswith(("_lo_", "_hi_"))])
    if max_groups is not None:
        # The hash makes the count read the same columns, so it shares the aggregate.
        known = F.struct(F.count(F.lit(1)).alias("n"), F.max(F.xxhash64(*starts.columns)).alias("h"))
        groups = starts.agg(known.alias("known")).scalar().getField("n")
        starts = F.broadcast(starts.where(F.assert_true(
            groups <= max_groups, F.lit("more groups than max_groups: call with max_groups=None")).isNull()))
    same = F.lit(True)
    for i, b in enumerate(by):
        same = same & F.col(b).eqNullSafe(F.col(f"_by_{i}"))
    rows = keyed.select(*by, *[f"_v_{k}" for k in numbers], F.xxhash64(*df.columns).alias("_all")).join(starts, same)

    def within(k: str, side: str) -> Column:
        v, start = F.col(f"_v_{k}"), F.col(f"_{side}_{k}")
        return F.when(v.isNotNull(), F.greatest(F.least(v, bucket_last(start)), start) - start)

    rows = rows.withColumns({f"_in_{side}_{k}": within(k, side) for k in numbers for side in ("lo", "hi")})
    second = rows.groupBy(*by).agg(
        F.any_value("_first").alias("_first"), F.max("_all").alias("_all"),
        *[(F.any_value(f"_{side}_{k}").cast("decimal(20,0)") + _middle(f"_in_{side}_{k}", side == "hi").cast("decimal(20,0)"))
          .alias(f"_{side}_{k}") for k in numbers for side in ("lo", "hi")])
    return second.select(*by, "_first.*", *[
        ((F.col(f"_lo_{k}") + F.col(f"_hi_{k}")) / 2).cast("bigint").alias(f"{k}_median") for k in numbers])


def missing_counts(fields: Sequence[str]) -> list[Column]:
    """``missing_<field>``: NULL, empty or whitespace-only values."""
    return [F.count_if(is_blank(f)).alias(f"missing_{f}") for f in fields]


def summary(df: DataFrame, by: Sequence[str] = ("source",), fields: Sequence[str] = ("dealer", "location"),
            approx: bool = False) -> DataFrame:
    """Numeric stats of price and mileage plus missing-field counts per group."""
    df = df.select(*by, "price", "mileage", *[f for f in fields if f not in by])
    return numeric_summary(df, {"price": F.col("price"), "mileage": F.col("mileage")}, by,
                           [F.count(F.lit(1)).alias("rows"), *missing_counts(fields)], approx)


def raw_vs_filtered(df: DataFrame, passes: Column, by: Sequence[str] = ("source",),
                    fields: Sequence[str] = ("title", "dealer", "location"), approx: bool = False) -> DataFrame:
    """Stats before and after a row filter.

    ``passes`` is the filter predicate; rows it rejects count as dropped.
    """
    df = df.select(*by, "price", "mileage", *[f for f in fields if f not in by], F.coalesce(passes, F.lit(False)).alias("_passes"))
    p = F.col("_passes")
    columns = {"raw_price": F.col("price"), "raw_mileage": F.col("mileage"),
               "kept_price": F.when(p, F.col("price")), "kept_mileage": F.when(p, F.col("mileage"))}
    counts = [F.count(F.lit(1)).alias("raw_rows"), F.count_if(p).alias("kept_rows"), *missing_counts(fields)]
    return numeric_summary(df, columns, by, counts, approx).withColumn(
        "dropped_rows", F.col("raw_rows") - F.col("kept_rows"))


def by_source(df: DataFrame, url: str = "url") -> DataFrame:
    """Listings with a non-blank URL per source, sorted by source."""
    return (
        df.groupBy("source")
        .agg(F.count(F.nullif(F.col(url), F.lit(""))).alias("listings"))
        .orderBy("source")
    )


def total(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Number of rows; with ``by``, per group and in all (the group is NULL)."""
    return (df.rollup(*by) if by else df).agg(F.count(F.lit(1)).alias("rows"))
