"""Exact dedup by content sort (DataFrame functions only).

Sampled splitters range-partition the normalised texts, each range is sorted
externally so that equal texts are adjacent, and neighbours are compared in
full (the window operator finds a group's end by comparing whole keys).

A text that holds a large share of the rows is found beforehand by counting
64-bit hashes; its rows get a salt after the text in the sort key, so that the
splitters can cut inside the group.  Splitters hold the text's first ``PREFIX``
letters and the hash that orders texts with the same beginning, not whole texts,
so the sample that the driver gets stays small.  The few winners of its salted pieces are
merged afterwards.  The number of such texts is at most ``4 * partitions``,
since each holds more than ``1 / (4 * partitions)`` of all rows.

Defined results: null text counts as empty; null ids never win against others;
of repeated rows with the same id exactly one is kept; an empty table gives an
empty result; further columns are ignored unless carried.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lotwise.llm.common import ascii_lower, stored, table, text_of

PREFIX = 32


def _sorted_groups(docs: DataFrame, id_col: str, text_col: str, carry: list[str]) -> DataFrame:
    """A row per document: its group's piece (``text_sha256``, ``salt``), the
    rank in the piece (largest id first), the piece's largest id and size."""
    spark = docs.sparkSession
    cols = [F.col(id_col).alias("_id"), text_of(F.col(text_col)).alias("_text")]
    kept = docs.select(*cols, F.struct(*carry).alias("_row")) if carry else docs.select(*cols)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Equal normalised texts are equal after lower() too, so its hash marks whole groups.
    kept = kept.withColumn("_hash", F.xxhash64(F.lower("_text")))
    sizes = kept.groupBy("_hash").agg(F.count(F.lit(1)).alias("_n"))
    total = docs.count()
    piece = max(1000, -(-total // (4 * parts)))
    hot = sizes.where(F.col("_n") > piece).select(
        "_hash", F.ceil(F.col("_n") / piece).cast("int").alias("_pieces"))
    keyed = (
        kept.join(F.broadcast(hot), "_hash", "left")
        .withColumn("_salt", F.coalesce(F.pmod(F.xxhash64("_id"), F.col("_pieces")), F.lit(-1).cast("bigint")))
        .withColumn("_norm", ascii_lower(F.col("_text")))
        .withColumn("_prefix", F.substring("_norm", 1, PREFIX))
        .drop("_pieces", "_text")
    )
    # Partitioned by range on a part of the window's keys: no further exchange.
    group = Window.partitionBy("_prefix", "_hash", "_salt", "_norm")
    return (
        keyed.repartitionByRange("_prefix", "_hash", "_salt")
        .withColumn("_rank", F.row_number().over(group.orderBy(F.col("_id").desc_nulls_last())))
        .withColumn("_max", F.max("_id").over(group))
        .withColumn("_size", F.count(F.lit(1)).over(group))
        .withColumn("text_sha256", F.sha2(F.col("_norm").cast("binary"), 256))
        .drop("_norm", "_prefix", "_hash")
    )


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, keep_id (the largest id of equal texts),
    group_size, kept, text_sha256 (of the text with A-Z lower-cased)."""
    rows = stored(_sorted_groups(docs, id_col, text_col, []), "exact")
    pieces = rows.where((F.col("_salt") >= 0) & (F.col("_rank") == 1))
    merged = pieces.groupBy("text_sha256").agg(F.max("_max").alias("_all_max"), F.sum("_size").alias("_all_size"))
    keep = F.coalesce("_all_max", "_max")
    return rows.join(F.broadcast(merged), "text_sha256", "left").select(
        F.col("_id").alias(id_col),
        keep.alias("keep_id"),
        F.coalesce("_all_size", "_size").alias("group_size"),
        ((F.col("_rank") == 1) & F.col("_id").eqNullSafe(keep)).alias("kept"),
        "text_sha256",
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns.  Only the winner of each
    sorted piece leaves the sort; winners of one salted text are merged."""
    rows = _sorted_groups(docs, id_col, text_col, docs.columns).where("_rank = 1")
    rows = stored(rows.select("_id", "_salt", "text_sha256", "_row"), "exact-kept")
    best = Window.partitionBy("text_sha256").orderBy(F.col("_id").desc_nulls_last())
    whole = rows.where("_salt < 0").select("_row.*")
    split = rows.where("_salt >= 0").withColumn("_best", F.row_number().over(best)).where("_best = 1")
    return whole.unionByName(split.select("_row.*"))


def op3_content_sort(spark, sf_dir):
    return exact_groups(table(spark, sf_dir, "documents"))


OP3_SQL = """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
  FROM documents
), g AS (
  SELECT doc_id, norm, max(doc_id) OVER (PARTITION BY norm) AS keep_id,
         count(*) OVER (PARTITION BY norm) AS group_size,
         row_number() OVER (PARTITION BY norm ORDER BY doc_id DESC NULLS LAST) AS rn
  FROM d
)
SELECT doc_id, keep_id, group_size, rn = 1 AS kept, sha256(norm) AS text_sha256 FROM g
"""
