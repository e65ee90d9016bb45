"""De-duplication and the earliest-seen merge.

"First" is always an explicit order (a list of order columns carried from
the source: rank, page, position), never partition order.  The first row per URL
is ``row_number() = 1``: Spark keeps the first row of a URL in each map task before
the shuffle, so a URL that holds a third of all rows collapses there.  The merge is a
keyed aggregate, combined map-side alike.

Both sort rows by URL inside a task.  URLs of a site begin with the same letters, and a
sort compares eight bytes of its first key cheaply, but whole texts slowly.  So the
first key is a hash of the URL, and the URL itself only decides among equal hashes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lotwise.functions.scalars import is_empty


def _cols(names: Sequence[str | Column]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in names]


def _first(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The first row per ``keys``, which begin with a hash of the others.  They should be
    columns that the rows have anyway, so that no text goes through the shuffle twice."""
    first = Window.partitionBy(*keys).orderBy(*_cols(order))
    return df.withColumn("_n", F.row_number().over(first)).where("_n = 1")


def dedupe_keep_blank(df: DataFrame, order: Sequence[str | Column], url: str = "url",
                      scope: Sequence[str] = (), keep_all: Column | None = None) -> DataFrame:
    """First row per URL (within ``scope`` columns, e.g. per source); every
    row with a blank URL is kept, and so is every row where ``keep_all`` is
    true (a source that does not de-duplicate).  They go through the same shuffle, each under
    a number of its own, so the input is computed once."""
    solo = is_empty(url) if keep_all is None else (is_empty(url) | F.coalesce(keep_all, F.lit(False)))
    keyed = df.withColumn("_solo", F.when(solo, F.monotonically_increasing_id()).otherwise(F.lit(-1).cast("bigint")))
    if keep_all is None:
        names = [*scope, url]
    else:  # the URLs of rows that all stay need not be sent, unless they are asked for
        keyed = keyed.withColumn("_k", F.when(~solo, F.struct(*[F.col(c) for c in scope], F.col(url).alias("_u"))))
        names = ["_k"]
    return _first(keyed.withColumn("_h", F.xxhash64(*names, "_solo")), ["_h", "_solo", *names], order).select(*df.columns)


def dedupe_collapse(df: DataFrame, order: Sequence[str | Column], url: str = "url") -> DataFrame:
    """First row per URL; all blank URLs (NULL or '') count as one URL.  A blank URL goes
    through the shuffle as NULL, with a mark if it was ''.  (``order`` names other columns.)"""
    keyed = df.withColumn("_empty", F.col(url) == "").withColumn(url, F.nullif(F.col(url), F.lit("")))
    first = _first(keyed.withColumn("_h", F.xxhash64(url)), ["_h", url], order)
    return first.withColumn(url, F.when(F.col("_empty"), F.lit("")).otherwise(F.col(url))).select(*df.columns)


def dedupe_counts(df: DataFrame, url: str = "url", by: Sequence[str] = ()) -> DataFrame:
    """total rows, unique by URL (each blank URL counts as its own), dropped."""
    blank = is_empty(url)
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_rows"),
        (F.count_distinct(F.when(~blank, F.col(url))) + F.count_if(blank)).alias("unique_rows"),
    ).withColumn("dropped_rows", F.col("total_rows") - F.col("unique_rows"))


def merge_first_seen(
    df: DataFrame,
    pos: Sequence[str | Column],
    keep: Sequence[str] | None = None,
    url: str = "url",
    first_seen: str = "first_seen",
) -> DataFrame:
    """Per URL, the row with the smallest non-blank ``first_seen`` (text
    order); ties, and URLs whose stamps are all blank, keep the row met
    first.  Blank-URL rows are dropped.  Adds ``first_pos``: the position
    where the URL was met first, even if a later row replaced it.
    """
    keep = list(keep or df.columns)
    fs_blank = is_empty(first_seen)
    # What the key or the group says anyway is not sent again: the URL, and among equal
    # stamps a stamp that is not blank.
    ties = [F.when(fs_blank, F.col(c)).alias(c) if c == first_seen else F.col(c) if isinstance(c, str) else c for c in pos]
    winner_key = F.struct(fs_blank.alias("b"), F.when(fs_blank, F.lit("")).otherwise(F.col(first_seen)).alias("fs"), *ties)
    sent = [c for c in keep if c != url] or [first_seen]
    return (
        df.filter(~is_empty(url))
        .groupBy(F.xxhash64(url).alias("_h"), F.col(url).alias("_k"))
        .agg(
            F.min_by(F.struct(*[F.col(c) for c in sent]), winner_key).alias("_r"),
            F.min(F.struct(*_cols(pos))).alias("first_pos"),
        )
        .select(*[F.col("_k").alias(url) if c == url else F.col(f"_r.{c}") for c in keep], "first_pos")
    )


def merge_order(merged: DataFrame) -> DataFrame:
    """Order merged rows by first encounter (a distributed range sort)."""
    return merged.orderBy("first_pos")
