"""Size guards: broadcast only what has been counted and weighed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from lotwise.session import few_folders, scratch_path, shared_dir

# A side is broadcast up to this many bytes of row text.
MAX_BROADCAST_BYTES = 64 << 20


def materialised(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder (a reliable
    checkpoint), so several readers share it and a lost executor costs
    nothing of it."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def staged(df: DataFrame, name: str, partition_by: str | None = None) -> tuple[DataFrame, int]:
    """``df`` written once as Parquet in the shared folder and read back, and its
    number of rows, counted while writing.  Unlike a checkpoint it stays columnar: later
    readers take only the columns, and of ``partition_by`` only the folders, they need."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    seen = Observation()
    writer = df.observe(seen, F.count(F.lit(1)).alias("rows")).write
    with few_folders(spark):
        (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path).select(*df.columns), seen.get["rows"]


def broadcast_if_small(small: DataFrame, max_rows: int,
                       max_bytes: int = MAX_BROADCAST_BYTES) -> tuple[DataFrame, bool]:
    """(``small`` hinted for broadcast, True) if it has at most ``max_rows``
    rows and ``max_bytes`` bytes, else (``small``, False) so the caller
    shuffles instead.  The side is materialised first: the count and the join
    compute it once."""
    small = materialised(small)
    n, size = small.agg(F.count(F.lit(1)), F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()
    return (F.broadcast(small), True) if n <= max_rows and (size or 0) <= max_bytes else (small, False)
