"""Writers for listing tables.

CSV output: UTF-8, header, the 8 listing columns in fixed order, NULL and ''
both written as empty fields, quotes doubled inside quoted fields.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwise.operators.shape import project_listing
from lotwise.schema import LISTING_COLS
from lotwise.session import few_folders, freed_shuffles

#: Rows of a file that one task must read whole.
MAX_WHOLE_FILE = 500_000
#: An empty file inside a published snapshot; without it a folder is none.
PUBLISHED = "_PUBLISHED"


def _csv(w):
    # Blanks at either end of a field are part of it.
    return (w.option("header", True).option("escape", '"').option("nullValue", "").option("emptyValue", "")
            .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False))


def write_csv(df: DataFrame, path: str, order: Sequence[str] | None = None, mode: str = "overwrite") -> None:
    """Listing CSV.  With ``order``, rows are range-sorted so part files
    follow reading order (part-00000 first)."""
    out = df.orderBy(*order) if order else df
    _csv(project_listing(out).write.mode(mode)).csv(path)


def write_parquet(df: DataFrame, path: str, enabled: bool = True, mode: str = "overwrite") -> bool:
    """Parquet twin of a listing output; ``enabled=False`` skips it."""
    if not enabled:
        return False
    project_listing(df).write.mode(mode).parquet(path)
    return True


def write_per_source(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """One output per source: ``source=<name>/`` directories, so a reader
    filtering on ``source`` prunes whole directories."""
    w = project_listing(df).write.mode(mode).partitionBy("source")
    with few_folders(df.sparkSession):
        (_csv(w).csv(path) if fmt == "csv" else w.parquet(path))


def write_results_files(df: DataFrame, base: str, order: Sequence[str | Column], names: dict,
                        finish: Callable[[DataFrame], DataFrame] | None = None, compression: str | None = None) -> None:
    """Every source's result CSV: rows range-sorted in reading order, one folder per
    source named ``file=<name>`` from ``names`` (source -> file name), so folder order is
    file-name order and part files follow reading order.

    Sources are written one after the other, so the disk holds the shuffle of one of them, which goes when it is
    written.  Rows of sources without a name come with the last one, in a folder of their own.
    The range sort samples its input in a job of its own, which computes it again from the last shuffle: that
    takes time but, unlike a copy of all rows, no disk.

    ``finish`` makes listings of rows in their order, row by row, after they were sorted: until
    then only its inputs, ``source`` and what ``order`` needs are moved.  With ``compression`` (a codec of Spark's
    CSV writer) a part file cannot be split, so it holds at most ``MAX_WHOLE_FILE`` rows."""
    fname = None
    for src, name in names.items():
        c = F.when(F.col("source") == src, F.lit(name))
        fname = c if fname is None else fname.when(F.col("source") == src, F.lit(name))
    if finish is None:
        df, finish = project_listing(df, extra=[o for o in order if o not in LISTING_COLS]), lambda t: t
    *others, last = names
    for i, src in enumerate(names):
        own = ~F.coalesce(F.col("source").isin(others), F.lit(False)) if src == last else F.col("source") == src
        ordered = df.where(own).repartitionByRange(*order).sortWithinPartitions(*order)
        w = _csv(project_listing(finish(ordered)).withColumn("file", fname).write.mode("append" if i else "overwrite"))
        if compression:
            w = w.option("compression", compression).option("maxRecordsPerFile", MAX_WHOLE_FILE)
        with few_folders(df.sparkSession), freed_shuffles(df.sparkSession):
            w.partitionBy("file").csv(base)


def snapshot_path(base: str, run_ts: str) -> str:
    """``<base>/run=YYYYMMDD-HHMMSS`` for a run stamp in ISO form."""
    from datetime import datetime

    return f"{base.rstrip('/')}/run={datetime.fromisoformat(run_ts).strftime('%Y%m%d-%H%M%S')}"


def _file_system(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def write_snapshot(df: DataFrame, base: str, run_ts: str, order: Sequence | None = None,
                   parquet: bool = True) -> str:
    """Combined output under a run stamp, CSV and Parquet published together.

    Both copies go to a staging folder, which gets a marker and its final name by one
    rename, so readers see both or nothing; where a rename moves files one by one, the
    marker is what ``read_snapshots`` asks for.  If a copy fails, the staging
    folder is taken away.  An existing snapshot is never overwritten (the write fails
    instead)."""
    spark = df.sparkSession
    path = snapshot_path(base, run_ts)
    fs, final = _file_system(spark, path)
    if fs.exists(final):
        raise FileExistsError(f"there is a snapshot {path}")
    stage = f"{base.rstrip('/')}/_staging-{uuid.uuid4().hex[:12]}"
    _, staged = _file_system(spark, stage)
    out = df.orderBy(*order) if order else df
    try:
        _csv(project_listing(out).write.mode("errorifexists")).csv(f"{stage}/csv")
        if parquet:
            project_listing(out).write.mode("errorifexists").parquet(f"{stage}/parquet")
        fs.create(_file_system(spark, f"{stage}/{PUBLISHED}")[1]).close()
        # A rename into a folder made meanwhile would put the stage inside it: it must be absent.
        if fs.exists(final) or not fs.rename(staged, final):
            raise FileExistsError(f"the snapshot {path} could not be published")
    finally:
        if fs.exists(staged):
            fs.delete(staged, True)
    return path


def published_snapshots(spark: SparkSession, base: str) -> list[str]:
    """The snapshots under ``base`` that were published whole, oldest first."""
    fs, root = _file_system(spark, base.rstrip("/"))
    if not fs.exists(root):
        return []
    found = [s.getPath().toString() for s in fs.listStatus(root) if s.getPath().getName().startswith("run=")]
    return sorted(p for p in found if fs.exists(_file_system(spark, f"{p}/{PUBLISHED}")[1]))


def read_snapshots(spark: SparkSession, base: str, latest: bool = False) -> DataFrame:
    """The Parquet copies of the published snapshots (or of the latest only), with
    their run as column ``run``."""
    from pyspark.sql import functions as F

    from lotwise.schema import LISTING

    paths = published_snapshots(spark, base)[-1 if latest else 0:]
    if not paths:
        return spark.createDataFrame([], LISTING).withColumn("run", F.lit(None).cast("string"))
    rows = spark.read.schema(LISTING).parquet(*[f"{p}/parquet" for p in paths])
    return rows.select("*", F.regexp_extract(F.col("_metadata.file_path"), "/run=([0-9-]+)/", 1).alias("run"))


def write_merged(merged: DataFrame, path: str) -> None:
    """Merged listings in order of first encounter (``first_pos``)."""
    _csv(project_listing(merged.orderBy("first_pos")).write.mode("overwrite")).csv(path)


def write_if_any(df: DataFrame, writer, *args, **kwargs) -> bool:
    """Write only when there is at least one row (no empty outputs)."""
    if df.isEmpty():
        return False
    writer(df, *args, **kwargs)
    return True


__all__ = ["write_csv", "write_parquet", "write_per_source", "write_results_files", "write_snapshot",
           "published_snapshots", "read_snapshots", "write_merged", "write_if_any", "snapshot_path"]
