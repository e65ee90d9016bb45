"""The earliest-seen merge, kept up to date as new listing files arrive.

Runs repeat over time and each run writes new result files; instead of
re-merging every file ever written, a file stream feeds the names of new files to
``foreachBatch``, which merges their rows into the state.  The state is cut into
``BUCKETS`` by a hash of the URL: a batch reads and rewrites only the buckets
that its rows fall into, and a small manifest per batch says which version of
each bucket is current.  A retried batch rewrites the same versions, so the sink
is idempotent; every version is a written table, so lineage never grows across
batches.  ``vacuum`` deletes the versions that no kept manifest names.

State rows keep the position where their URL was met first; new rows sort
after every state row, so a tie on ``first_seen`` keeps the row met first,
as in the one-shot merge.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwise.operators.dedupe import merge_first_seen
from lotwise.schema import LISTING_COLS
from lotwise.sources.files import FILE_ORDER, read_listing_csv

BUCKETS = 64
_FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def bucket_of(url: Column) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(BUCKETS)).cast("int")


def merge_batch(state: DataFrame | None, batch_rows: DataFrame, batch_id: int) -> DataFrame:
    """Merge bound listing rows (``LISTING`` text + ``FILE_ORDER``) of one
    batch into the state (``LISTING`` + ``first_pos``)."""
    new = batch_rows.select(*LISTING_COLS, F.struct(F.lit(batch_id + 1).cast("bigint").alias("batch"),
                                                     *[F.col(c) for c in FILE_ORDER]).alias("pos"))
    if state is not None:
        old = state.select(*LISTING_COLS, F.col("first_pos").alias("pos"))
        new = old.unionByName(new)
    # first_pos of a surviving state row is kept: it is the smallest position.
    return merge_first_seen(new, ["pos"], keep=LISTING_COLS).select(
        *LISTING_COLS, F.col("first_pos.pos").alias("first_pos"))


def _manifest(spark: SparkSession, state_dir: str, batch_id: int) -> dict[int, int]:
    """Bucket -> the batch that wrote its current version (at most BUCKETS rows)."""
    if batch_id < 0:
        return {}
    rows = spark.read.schema("bucket int, version bigint").parquet(f"{state_dir}/manifest/batch={batch_id}").collect()
    return {r.bucket: r.version for r in rows}


def _buckets(spark: SparkSession, state_dir: str, versions: dict[int, int]) -> DataFrame | None:
    paths = [f"{state_dir}/data/batch={v}/bucket={b}" for b, v in sorted(versions.items())]
    return spark.read.parquet(*paths) if paths else None


def apply_batch(spark: SparkSession, files: list[str], state_dir: str, batch_id: int) -> None:
    """Merge the rows of new files into the state of the batch before."""
    versions = _manifest(spark, state_dir, batch_id - 1)
    rows = read_listing_csv(spark, files)
    touched = {r.b for r in rows.where("url <> ''").select(bucket_of(F.col("url")).alias("b")).distinct().collect()}
    state = _buckets(spark, state_dir, {b: v for b, v in versions.items() if b in touched})
    merged = merge_batch(state, rows, batch_id).withColumn("bucket", bucket_of(F.col("url")))
    merged.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{state_dir}/data/batch={batch_id}")
    now = sorted({**versions, **{b: batch_id for b in touched}}.items())
    spark.createDataFrame(now, "bucket int, version bigint").coalesce(1).write.mode("overwrite").parquet(
        f"{state_dir}/manifest/batch={batch_id}")


def start(spark: SparkSession, input_glob: str, state_dir: str, checkpoint_location: str, once: bool = True):
    """Start the stream over files matching ``input_glob`` (e.g.
    ``out/*_results.csv/*.csv``); ``once``: process what is there now, then
    stop."""
    state_dir = state_dir.rstrip("/")

    def on_batch(df: DataFrame, batch_id: int) -> None:
        files = [r.path for r in df.select("path").distinct().collect()]  # the batch's file names
        apply_batch(df.sparkSession, files, state_dir, batch_id)

    names = spark.readStream.format("binaryFile").schema(_FILE_SCHEMA).load(input_glob).select("path")
    w = names.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint_location)
    w = w.trigger(availableNow=True) if once else w.trigger(processingTime="1 minute")
    return w.start()


def latest(spark: SparkSession, state_dir: str, batch_id: int) -> DataFrame:
    """The merged listings after a batch."""
    state_dir = state_dir.rstrip("/")
    state = _buckets(spark, state_dir, _manifest(spark, state_dir, batch_id))
    return state if state is not None else merge_batch(None, read_listing_csv(spark, []), batch_id)


def vacuum(spark: SparkSession, state_dir: str, batch_id: int) -> None:
    """Delete the bucket versions and manifests that batch ``batch_id`` and
    later ones do not need."""
    state_dir = state_dir.rstrip("/")
    current = _manifest(spark, state_dir, batch_id)
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(state_dir).getFileSystem(spark._jsc.hadoopConfiguration())
    for old in range(batch_id):
        for b in range(BUCKETS):
            if current.get(b) != old:
                fs.delete(path(f"{state_dir}/data/batch={old}/bucket={b}"), True)
        fs.delete(path(f"{state_dir}/manifest/batch={old}"), True)
