"""Mixing sources to target weights along a curriculum (DataFrame functions only).

A source's weight changes over the training time t in [0, 1].  Its schedule is
``T * (1 + g * (1 - 2t))``: T words in all, front-loaded for g > 0, back-loaded
for g < 0.  Integrated, it demands ``D(t) = T * (t + g * (t - t^2))`` words by
time t.  A document that takes the words [c, c + n) of its source's demand is
placed at the time t where ``D(t)`` reaches their middle, that is at the root of
a quadratic; the sum of all demands at t is its position in training.  Ordering
by position is one range sort.  A source with a target over its size is gone
through again: pass p takes the words from ``p * source_size`` on, so a document
has a place in training for each pass that takes words of it.

Targets: sources in code point order (null last) weigh 5, 2, 1, 5, ... and share
all words by weight; none gets more than ``cap`` times its size, and what is
over is shared again among the others.  The fixed point has a closed form over
the sources ordered by size/weight, so no loop is needed.  The source table (one
row per source) is the only thing ordered in one task.

Running sums inside a source are two-level, so one source with a third of all
rows is cut into buckets of about ``BUCKET_ROWS`` rows by a hash of the id: a
window inside the bucket, plus the totals of the buckets before it.

Defined results: null text has size 0; a null source is a source of its own, the
last; documents of size 0 take 0 words; ties of the hash (equal ids) are ordered
by id and size, so rows that still tie are equal; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lotwise.llm.common import BLANKS, stored, table, text_of

WEIGHTS = (5, 2, 1)
#: g of each weight class: heavy sources come early, light ones late.
RAMPS = (0.5, 0.0, -0.5)
CAP = 3
BUCKET_ROWS = 20_000


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in a text: each word with the blanks
    after it becomes one letter, and the letters are counted."""
    trimmed = F.trim(text, F.lit(BLANKS))
    one = F.regexp_replace(trimmed, r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*", "x")
    return F.char_length(one).cast("bigint")


def _by_class(rank: Column, values: tuple) -> Column:
    out = F.lit(values[0])
    for i, v in enumerate(values[1:], 1):
        out = F.when(F.pmod(rank - 1, F.lit(len(values))) == i, F.lit(v)).otherwise(out)
    return out


def source_targets(sized: DataFrame, weights=WEIGHTS, ramps=RAMPS, cap: int = CAP) -> DataFrame:
    """A row per source: source, source_size, target (double), ramp, and the
    sums of all targets and of all targets times ramp."""
    whole = "decimal(38,0)"
    every = Window.partitionBy()
    ordered = Window.orderBy(F.col("source").isNull(), "source")
    by_ratio = Window.orderBy("_ratio", F.col("source").isNull(), "source")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    s = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    s = s.withColumn("_rank", F.row_number().over(ordered))
    s = s.withColumns({"_w": _by_class(F.col("_rank"), weights).cast("bigint"),
                       "ramp": _by_class(F.col("_rank"), ramps).cast("double"),
                       "_most": F.col("source_size") * cap})
    s = s.withColumn("_ratio", F.col("_most").cast("double") / F.col("_w").cast("double"))
    s = s.withColumns({"_total": F.sum("source_size").over(every),
                       "_full": F.coalesce(F.sum("_most").over(before), F.lit(0)),
                       "_open": F.sum("_w").over(after)})
    # A source is full if it holds less than its share of what those before it left.
    s = s.withColumn("_capped", F.col("_most").cast(whole) * F.col("_open").cast("decimal(18,0)")
                     < F.col("_w").cast("decimal(18,0)") * (F.col("_total") - F.col("_full")).cast(whole))
    s = s.withColumns({
        "_rest": F.col("_total") - F.coalesce(F.sum(F.when(F.col("_capped"), F.col("_most"))).over(every), F.lit(0)),
        "_share": F.coalesce(F.sum(F.when(~F.col("_capped"), F.col("_w"))).over(every), F.lit(1))})
    shared = F.col("_w").cast("double") * F.col("_rest").cast("double") / F.col("_share").cast("double")
    s = s.withColumn("target", F.when(F.col("_capped"), F.col("_most").cast("double")).otherwise(shared))
    inorder = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return s.select("source", "source_size", "ramp", "target",
                    F.sum("target").over(inorder).alias("all_words"),
                    F.sum(F.col("target") * F.col("ramp")).over(inorder).alias("all_bent"))


def curriculum(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
               weights=WEIGHTS, ramps=RAMPS, cap: int = CAP, bucket_rows: int = BUCKET_ROWS,
               row_key: Column | None = None) -> DataFrame:
    """One row per document: id, source, size, source_size, target, taken (words
    taken, repeats counted), first_cut (words taken of the last, partial pass),
    position (training position of the first taken words in words, null if none
    are taken) and positions (that of each pass that takes words of it, at most
    ``cap`` + 1), range-sorted by position.  ``row_key`` orders rows of the same
    id and size, and is returned as ``row_key``."""
    key = F.lit(0).cast("bigint") if row_key is None else row_key
    sized = stored(docs.select(F.col(id_col).alias("_id"), F.col(source_col).cast("string").alias("source"),
                               word_count(text_of(F.col(text_col))).alias("size"), key.alias("row_key")), "mix-sizes")
    targets = stored(source_targets(sized, weights, ramps, cap), "mix-targets")
    digits = min(8, max(1, math.ceil(math.log(max(2, sized.count() / bucket_rows), 16))))
    rows = sized.withColumn("_hash", F.md5(F.coalesce(F.col("_id").cast("string"), F.lit("")).cast("binary")))
    rows = rows.withColumn("_bucket", F.substring("_hash", 1, digits))
    inner = Window.partitionBy("source", "_bucket").orderBy(
        "_hash", F.col("_id").asc_nulls_first(), "size", "row_key").rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        rows.groupBy("source", "_bucket").agg(F.sum("size").alias("_n"))
        .withColumn("_offset", F.coalesce(F.sum("_n").over(outer), F.lit(0)))
        .join(targets.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")))
        .select(F.col("source").alias("_s"), F.col("_bucket").alias("_b"), "_offset",
                "source_size", "target", "ramp", "all_words", "all_bent")
    )
    rows = (
        rows.withColumn("_before", F.coalesce(F.sum("size").over(inner), F.lit(0)))
        .join(offsets, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_bucket") == F.col("_b")))
    )
    passes = F.when(F.col("source_size") > 0, F.floor(F.floor("target") / F.col("source_size"))).otherwise(F.lit(0))
    begin = F.col("_offset") + F.col("_before")
    rows = rows.withColumns({"_begin": begin, "_passes": passes})
    extra = F.floor("target") - F.col("_passes") * F.col("source_size")
    rows = rows.withColumn("first_cut", F.greatest(F.lit(0), F.least("size", extra - F.col("_begin"))).cast("bigint"))
    rows = rows.withColumn("taken", (F.col("_passes") * F.col("size") + F.col("first_cut")).cast("bigint"))
    # The first pass of a source takes its documents in order, whole or cut.
    first = F.when(F.col("_passes") > 0, F.col("size")).otherwise(F.col("first_cut"))
    g = F.col("ramp")

    def place(begin: Column, words: Column) -> Column:
        """Position of the words [begin, begin + words) of a source's demand."""
        x = (begin.cast("double") + words.cast("double") / 2.0) / F.col("target")
        t = 2.0 * x / ((1.0 + g) + F.sqrt((1.0 + g) * (1.0 + g) - 4.0 * g * x))
        return F.round(F.col("all_words") * t + F.col("all_bent") * (t - t * t), 3)

    # Whole passes and, if it takes words of the document, the partial one.
    numbers = F.sequence(F.lit(0).cast("bigint"), F.col("_passes") - (F.col("first_cut") == 0).cast("bigint"))
    each = F.transform(numbers, lambda p: place(
        F.col("_begin") + p * F.col("source_size"),
        F.when(p < F.col("_passes"), F.col("size")).otherwise(F.col("first_cut"))))
    # Documents that take nothing have no position: the id spreads them.
    by_position = [F.col("position").asc_nulls_last(), F.xxhash64(id_col).asc()]
    return (
        rows.select(F.col("_id").alias(id_col), "source", "size", "source_size", "target", "taken", "first_cut",
                    F.when(F.col("taken") > 0, place(F.col("_begin"), first)).alias("position"),
                    F.when(F.col("taken") > 0, each).alias("positions"), *([] if row_key is None else ["row_key"]))
        .repartitionByRange(*by_position).sortWithinPartitions(*by_position)
    )


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", **kw) -> DataFrame:
    """The mixed table with the columns of ``docs``, in training order: a document
    is repeated once per whole pass taken, and once more if at least half of it is
    in the last, partial pass, each copy at the position of its pass.  Documents
    without words stay once, at the end.  Rows are found again by id and a hash of
    all their columns; equal rows are one row with the copies of all."""
    def key_of(id_: Column) -> Column:
        return F.coalesce(F.concat(F.lit("="), id_.cast("string")), F.lit(""))

    plan = curriculum(docs, id_col, row_key=F.xxhash64(*docs.columns), **kw)
    copies = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + 0.5)).otherwise(F.lit(1)).cast("int")
    places = F.when(F.col("size") > 0, F.slice("positions", F.lit(1), copies)).otherwise(
        F.array(F.lit(None).cast("double")))
    plan = plan.where(copies > 0).select(key_of(F.col(id_col)).alias("_mix_id"), F.col("row_key").alias("_mix_key"),
                                         F.explode(places).alias("_at"))
    rows = (
        docs.select(F.struct(*docs.columns).alias("_row"), key_of(F.col(id_col)).alias("_id"),
                    F.xxhash64(*docs.columns).alias("_key"))
        .groupBy("_id", "_key").agg(F.first("_row").alias("_row"))
        .join(plan, (F.col("_id") == F.col("_mix_id")) & (F.col("_key") == F.col("_mix_key")))
    )
    by_place = [F.col("_at").asc_nulls_last(), F.col("_key").asc()]
    return rows.repartitionByRange(*by_place).sortWithinPartitions(*by_place).select("_row.*")


def op2_curriculum_mix(spark, sf_dir):
    """With the places of all passes: ``position`` and ``position_2`` to ``position_4``
    (a target is at most ``CAP`` times its source's size, so there are no more)."""
    later = [F.get("positions", F.lit(p - 1)).alias(f"position_{p}") for p in range(2, CAP + 2)]
    return curriculum(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken", "position", *later)


OP2_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents
), s0 AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), s1 AS (
  SELECT *, (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 AS k FROM s0
), s2 AS (
  SELECT source, source_size, source_size * 3 AS most,
         CASE k WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w,
         CASE k WHEN 0 THEN 0.5::DOUBLE WHEN 1 THEN 0.0::DOUBLE ELSE -0.5::DOUBLE END AS g
  FROM s1
), s3 AS (
  SELECT *, sum(source_size) OVER () AS total,
         coalesce(sum(most) OVER (ORDER BY most::DOUBLE / w, source IS NULL, source
                                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS taken_up,
         sum(w) OVER (ORDER BY most::DOUBLE / w, source IS NULL, source
                      ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_w
  FROM s2
), s4 AS (
  SELECT *, most::HUGEINT * open_w < w * (total - taken_up) AS capped FROM s3
), s5 AS (
  SELECT *, total - coalesce(sum(most) FILTER (WHERE capped) OVER (), 0) AS rest,
         coalesce(sum(w) FILTER (WHERE NOT capped) OVER (), 1) AS share FROM s4
), targets AS (
  SELECT source, source_size, g,
         CASE WHEN capped THEN most::DOUBLE ELSE w::DOUBLE * rest::DOUBLE / share::DOUBLE END AS target
  FROM s5
), sums AS (
  SELECT sum(target) AS all_t, sum(target * g) AS bent FROM targets
), placed AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.g,
         CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY md5(coalesce(CAST(d.doc_id AS VARCHAR), '')),
           d.doc_id NULLS FIRST, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS beg,
         CASE WHEN t.source_size > 0 THEN CAST(floor(floor(t.target) / t.source_size) AS BIGINT) ELSE 0 END AS passes
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
), cut AS (
  SELECT *, greatest(0, least(size, CAST(floor(target) AS BIGINT) - passes * source_size - beg)) AS first_cut
  FROM placed
), x AS (
  SELECT *, passes * size + first_cut AS taken, X_OF_PASSES
  FROM cut
), t AS (
  SELECT *, T_OF_PASSES FROM x
)
SELECT doc_id, size, source_size, target, CAST(taken AS BIGINT) AS taken, POSITIONS
FROM t, sums
"""
# The same expressions for the first to the fourth pass (numbered from 0).
_PASSES = range(CAP + 1)
OP2_SQL = OP2_SQL.replace("X_OF_PASSES", ",\n         ".join(
    f"CASE WHEN size > 0 AND ({p} < passes OR ({p} = passes AND first_cut > 0)) THEN ((beg + {p} * source_size)::DOUBLE"
    f" + (CASE WHEN {p} < passes THEN size ELSE first_cut END)::DOUBLE / 2.0::DOUBLE) / target END AS x{p}" for p in _PASSES))
OP2_SQL = OP2_SQL.replace("T_OF_PASSES", ",\n         ".join(
    f"2.0::DOUBLE * x{p} / ((1.0::DOUBLE + g) + sqrt((1.0::DOUBLE + g) * (1.0::DOUBLE + g) - 4.0::DOUBLE * g * x{p})) AS t{p}"
    for p in _PASSES))
OP2_SQL = OP2_SQL.replace("POSITIONS", ",\n       ".join(
    f"round(all_t * t{p} + bent * (t{p} - t{p} * t{p}), 3) AS position{f'_{p + 1}' if p else ''}" for p in _PASSES))
