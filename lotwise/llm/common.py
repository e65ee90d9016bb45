"""Small helpers shared by the operators of this subpackage.

Every operator selects the columns it needs by name, so further columns of the
input (whatever they are called) never reach its plan.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwise.session import shared_dir

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: The six white space characters of the contracts: \x20 and \x09 to \x0D.
BLANKS = " \t\n\x0b\f\r"
WORD_RE = r"[^\x20\x09-\x0D]+"
#: Text bytes handled at once inside a Python worker.
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def text_of(text: Column) -> Column:
    """The text as a string; null counts as empty."""
    return F.coalesce(text.cast("string"), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only.  A text of ASCII bytes takes the fast ``lower``,
    any other is translated letter by letter, so É or İ stay as they are."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, LOWER))


def stage_dir(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share."""
    return f"{shared_dir(spark)}/llm-{name}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: the
    lineage ends there, and a lost executor loses nothing of it."""
    spark = df.sparkSession
    path = stage_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def hash_sample(df: DataFrame, key: Column, want: int) -> DataFrame:
    """The ``want`` rows with the smallest hash of ``key`` (all of a smaller
    table).  Rows over a bound of the hash go first, so that the driver gets little
    more than ``want`` rows however many partitions there are."""
    n = df.count()
    at = F.pmod(F.xxhash64(key.cast("string")), F.lit(1 << 40))
    rows = df.withColumn("_at", at)
    if n > want:
        rows = rows.where(F.col("_at") < int((1 << 40) * min(1.0, 1.5 * (want + 20) / n)))
    return rows.orderBy("_at").limit(want).drop("_at")


def hot_keys(counts: DataFrame, rows: str) -> DataFrame:
    """Of a stored table with a row per key, those with more than a quarter of a
    partition's share of all ``rows``: at most four times as many as partitions."""
    parts = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = counts.agg(F.sum(rows)).first()[0] or 0
    return counts.where(F.col(rows) > max(1000, total // (4 * parts)))


def join_hot(left: DataFrame, right: DataFrame, key: str, hot: DataFrame) -> DataFrame:
    """``left`` joined to ``right`` (a row per key), all rows of ``left`` kept.  The
    rows of ``hot`` keys stay where they are and get their few partners sent; null keys
    have no partner and are not moved either."""
    hot = F.broadcast(hot)
    some = left.where(F.col(key).isNotNull())
    rest = some.join(hot, key, "left_anti").join(right.join(hot, key, "left_anti"), key, "left")
    few = F.broadcast(right.join(hot, key, "left_semi"))
    out = rest.unionByName(some.join(hot, key, "left_semi").join(few, key, "left"))
    return out.unionByName(left.where(F.col(key).isNull()), allowMissingColumns=True)


def small_batches(spark: SparkSession) -> None:
    """Keep the Arrow batches of Python stages small: texts and sets are large
    rows, and a batch is held several times over (JVM, pipe, Python)."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def slices(batch: pa.RecordBatch, text_at: int = 1) -> Iterator[list]:
    """The columns of a batch as Python lists, a few megabytes of text at a
    time, so that memory follows SLICE_BYTES and the longest single text."""
    sizes = pc.binary_length(batch.column(text_at)).fill_null(0).to_pylist()
    start = held = 0
    for i, n in enumerate(sizes):
        held += n
        if held >= SLICE_BYTES:
            yield [c.to_pylist() for c in batch.slice(start, i + 1 - start).columns]
            start, held = i + 1, 0
    if start < len(sizes):
        yield [c.to_pylist() for c in batch.slice(start).columns]


def map_slices(df: DataFrame, per_slice: Callable, schema: str, text_at: int = 1) -> DataFrame:
    """``mapInArrow`` over bounded slices: ``per_slice(*columns)`` takes lists
    and returns lists, one per column of ``schema``."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    small_batches(df.sparkSession)
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for columns in slices(batch, text_at):
                out = per_slice(*columns)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(out, arrow)], schema=arrow)

    return df.mapInArrow(run, schema)
