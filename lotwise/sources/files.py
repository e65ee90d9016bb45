"""Listing files: CSV outputs of earlier runs, and loose row tables."""

from __future__ import annotations

from collections.abc import Sequence
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lotwise.functions.scalars import let, to_numeric, url_untrack
from lotwise.plans.sizing import broadcast_if_small, staged
from lotwise.schema import LISTING, LISTING_COLS

# Reading order of bound rows: files by folder, part number and name, then rows.
FILE_ORDER = ["file_pos", "row_no"]
# The same order in numbers (``numbered_listing_csv``).
NUMBER_ORDER = ["file_no", "block", "row_no"]
#: Files whose layout may be broadcast.
MAX_BROADCAST_FILES = 1_000_000
BOUND = (", ".join(f"{c} string" for c in LISTING_COLS)
         + ", file string, file_pos struct<folder:string,part:bigint,name:string,block:bigint>, row_no bigint")


def _qualified(spark: SparkSession, path: str) -> str:
    """The full form of a path in its own file system."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toString().rstrip("/")


def _plain(path: str) -> str:
    """A file name as Spark reports it (percent-encoded), decoded and in one spelling of its scheme."""
    path = unquote(path)
    return "file:" + path[len("file://"):] if path.startswith("file:///") else path


# ---- records of a file (JVM side) -------------------------------------------------------------
def _inside_after(line: Column, inside: bool) -> Column:
    """Whether a reader stands inside a quoted field after a line that it enters
    at the start of a record, or ``inside`` a quoted field.

    A fold over the pieces between quotes.  Outside (0) a quote opens a field only where
    one begins; inside (1) it closes; just closed (2) another one is a quote in the text."""
    pieces = F.split(line, '"')

    def step(state, piece):
        at = state["at"]
        fresh = piece.endswith(",") | ((piece == "") & state["first"] & F.lit(not inside))
        after = F.when(at == 1, 2).when((at == 2) & (piece == ""), 1).when(fresh, 1).otherwise(0)
        return F.struct(after.alias("at"), F.lit(False).alias("first"))

    start = F.struct(F.lit(int(inside)).alias("at"), F.lit(True).alias("first"))
    # The last piece is followed by no quote.
    before_quotes = F.slice(pieces, F.lit(1), F.size(pieces) - 1)
    return F.when(line.contains('"'), F.aggregate(before_quotes, start, step, lambda s: s["at"] == 1)).otherwise(F.lit(inside))


def _lines(spark: SparkSession, paths) -> DataFrame | None:
    """The lines of the files with their place: file (its path as Spark reports it, see
    ``_file_name``), block, i (in order within a block), opens (a record that begins with the
    line goes on after it)."""
    if not paths:
        return None
    try:
        lines = spark.read.text(paths)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    return lines.select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"),
                        F.col("_metadata.file_block_start").alias("block"),
                        F.monotonically_increasing_id().alias("i"), _inside_after(F.col("value"), False).alias("opens"))


def _file_name(path: Column) -> Column:
    """The decoded form of a reported path; for one row a file, not one a line."""
    return F.regexp_replace(F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), "^file:///", "file:/")


def _stitched(lines: DataFrame) -> DataFrame:
    """Lines of files in which records span lines -> their records.

    A line turns the state it is entered with (outside or inside a quoted field) into
    another.  Of such a turn there are four: none, a change, always outside, always inside;
    so the state before a line follows from the last line with a fixed outcome and the
    number of changes since.  Both are running values, first inside each block of a
    file, then over its blocks (one row each).  Lines of one record are joined by its key, wherever
    they were read."""
    out, into = F.col("opens"), _inside_after(F.col("line"), True)
    turned = lines.withColumn("_in", into).withColumns({
        "_fixed": F.when(out == F.col("_in"), out.cast("int")), "_change": (out & ~F.col("_in")).cast("int")})
    place = Window.partitionBy("file", "block").orderBy("i")
    earlier = place.rowsBetween(Window.unboundedPreceding, -1)
    upto = place.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    turned = turned.withColumn("_changes", F.sum("_change").over(upto))
    mark = F.when(F.col("_fixed").isNotNull(), F.struct(F.col("_fixed").alias("v"), F.col("_changes").alias("n")))
    turned = turned.withColumn("_mark", mark).withColumns({
        "_last": F.last("_mark", ignorenulls=True).over(earlier),
        "_so_far": F.coalesce(F.sum("_change").over(earlier), F.lit(0))})
    # Blocks: the state each is entered with, from the outcomes of those before it.
    blocks = turned.groupBy("file", "block").agg(F.sum("_change").alias("n"), F.max_by("_mark", F.when(F.col("_mark").isNotNull(), F.col("i"))).alias("m"))
    ordered = Window.partitionBy("file").orderBy("block")
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_n", F.sum("n").over(ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    whole = F.when(F.col("m").isNotNull(), F.struct(F.col("m.v").alias("v"), (F.col("_n") - F.col("n") + F.col("m.n")).alias("n")))
    blocks = blocks.withColumn("_whole", whole).withColumns({
        "_last_block": F.last("_whole", ignorenulls=True).over(before), "_n_before": F.col("_n") - F.col("n")})
    entered = F.coalesce((F.col("_last_block.v") + F.col("_n_before") - F.col("_last_block.n")) % 2, F.col("_n_before") % 2)
    blocks = blocks.select("file", "block", entered.alias("_entered"))
    turned = turned.join(blocks, ["file", "block"])
    inside = F.coalesce((F.col("_last.v") + F.col("_so_far") - F.col("_last.n")) % 2, (F.col("_entered") + F.col("_so_far")) % 2)
    starts = turned.withColumn("_start", inside == 0).withColumn(
        "_record", F.last(F.when(F.col("_start"), F.col("i")), ignorenulls=True).over(upto))
    # Lines before a block's first start belong to the last record begun in an earlier one.
    heads = starts.groupBy("file", "block").agg(F.max(F.when(F.col("_start"), F.col("i"))).alias("last_start"))
    begun = F.when(F.col("last_start").isNotNull(), F.struct(F.col("block").alias("b"), F.col("last_start").alias("i")))
    heads = heads.withColumn("_begun", begun).select("file", "block", F.last("_begun", ignorenulls=True).over(before).alias("_open"))
    keyed = starts.join(heads, ["file", "block"]).select(
        "file", F.when(F.col("_record").isNotNull(), F.col("block")).otherwise(F.col("_open.b")).alias("_b"),
        F.coalesce("_record", "_open.i").alias("_r"), F.struct("block", "i", "line").alias("part"))
    records = keyed.groupBy("file", "_b", "_r").agg(F.array_sort(F.collect_list("part")).alias("parts"))
    return records.select("file", F.col("_b").alias("block"), F.col("_r").alias("i"),
                          F.array_join(F.col("parts.line"), "\n").alias("line"))


def _fields(record: Column, width: int) -> Column:
    """The fields of a record as texts, ``width`` of them."""
    schema = ", ".join(f"c{i} string" for i in range(width))
    parsed = F.from_csv(record, schema, {"mode": "PERMISSIVE", "escape": '"', "maxColumns": str(max(width, 20480))})
    return let(parsed, lambda r: F.array(*[r[f"c{i}"] for i in range(width)]))


def read_listing_csv(spark: SparkSession, paths: str | Sequence[str], exclude: str | None = None) -> DataFrame:
    """Read listing CSV files and bind columns by *header name*, per file.

    Files may differ in column order, width, and extra or missing columns.  They
    are read as lines, split at any place.  One pass finds each file's header and whether a
    record of it spans lines; only lines of such files are stitched together
    (``_stitched``), in many tasks too.  Of the headers only the greatest width reaches the
    driver: the places of the listing columns are a table by file.  ``exclude`` is a file, or
    a folder of part files, to leave out (compared as full paths).  A repeated name binds
    to its last column; blank lines are no records.  No matching file gives an empty table.

    Adds ``file``, ``file_pos`` (files in order of folder, part number and
    name, and blocks within a file) and ``row_no`` (rows within a block): the
    reading order is ``FILE_ORDER``.
    """
    read = _bound_rows(spark, paths, exclude)
    if read is None:
        return spark.createDataFrame([], BOUND)
    return read[0].select(*LISTING_COLS, F.col("name").alias("file"), _file_pos(), "row_no")


def numbered_listing_csv(spark: SparkSession, paths: str | Sequence[str],
                         exclude: str | None = None) -> tuple[DataFrame, DataFrame] | None:
    """``read_listing_csv`` with a row's place in numbers only, ``NUMBER_ORDER``: names of files, which are long, need not
    be moved with every row.  Beside the rows comes the table of files, ``file_no`` with the names that ``named``
    asks for.  Without any file or header: None."""
    read = _bound_rows(spark, paths, exclude, numbered=True)
    return read and (read[0].select(*LISTING_COLS, *NUMBER_ORDER), read[1].select("file_no", "_folder", "_part", "name"))


def named(rows: DataFrame, place: str, files: DataFrame) -> DataFrame:
    """``rows`` with their column ``place``, a struct of ``NUMBER_ORDER``, as one of ``FILE_ORDER``."""
    told = rows.join(files, F.col(f"{place}.file_no") == F.col("file_no"))
    pos = told.withColumns({"block": F.col(f"{place}.block"), "row_no": F.col(f"{place}.row_no")})
    return pos.withColumn(place, F.struct(_file_pos(), "row_no")).select(*rows.columns)


def _file_pos() -> Column:
    return F.struct(F.col("_folder").alias("folder"), F.col("_part").alias("part"), "name", "block").alias("file_pos")


def _bound_rows(spark: SparkSession, paths: str | Sequence[str], exclude: str | None,
                numbered: bool = False) -> tuple[DataFrame, DataFrame] | None:
    """The rows of ``read_listing_csv`` with all that says where they stand, and the table of
    files (with ``file_no``, their number in reading order, if asked for)."""
    lines = _lines(spark, paths)
    if lines is None:
        return None
    shown = F.when(F.trim("line") != "", F.struct("block", "i", "line"))
    # The set of marks (two at most) lets Spark aggregate by hashing: without it, the least
    # line, which is a text, makes it sort all lines by file.
    spans = F.array_contains(F.collect_set("opens"), F.lit(True))
    files = staged(lines.groupBy("file").agg(F.min(shown).alias("first"), spans.alias("spans")), "csv-files")[0]
    files = files.withColumn("name", _file_name(F.col("file")))
    if exclude:  # lines of other files than these meet no layout below
        left_out = _plain(_qualified(spark, exclude))
        files = files.where((F.col("name") != left_out) & ~F.startswith("name", F.lit(left_out + "/")))
    # A header that goes on over several lines is one of the stitched records.
    spanning = files.where("spans").select("file")
    whole = lines.select("file", "block", "i", "line")
    if not spanning.isEmpty():
        sent, _ = broadcast_if_small(spanning, MAX_BROADCAST_FILES)
        stitched = staged(_stitched(lines.join(sent, "file", "left_semi")), "csv-records")[0]
        whole = whole.join(sent, "file", "left_anti").unionByName(stitched)
        long = stitched.where(F.trim("line") != "").groupBy("file").agg(F.min(F.struct("block", "i", "line")).alias("first"))
        files = files.where("not spans").select("file", "name", "first").unionByName(
            long.join(files.select("file", "name"), "file"))
    names = header_names(F.col("first.line"))
    widths = files.where("first is not null").select("file", "name", "first", names.alias("names"))
    width = widths.agg(F.max(F.size("names"))).first()[0]
    if not width:
        return None
    at = F.struct(*[(F.size("names") - F.coalesce(F.array_position(F.reverse(F.col("names")), F.lit(c)), F.lit(0)).cast("int") + 1)
                    .alias(c) for c in LISTING_COLS])
    part = F.regexp_extract("name", "/part-([0-9]{1,18})[^/]*$", 1).try_cast("bigint")
    folder = F.when(part.isNotNull(), F.regexp_replace("name", "/[^/]*$", "")).otherwise(F.col("name"))
    layouts = widths.select(
        "file", "name", folder.alias("_folder"), F.coalesce(part, F.lit(-1)).alias("_part"),
        F.struct("first.block", "first.i").alias("_head"), F.size("names").alias("_size"), at.alias("_at"))
    if numbered:  # numbers that grow in the order of a sort; the table is computed once below
        layouts = layouts.orderBy("_folder", "_part", "name").withColumn("file_no", F.monotonically_increasing_id())
    binding, _ = broadcast_if_small(layouts, MAX_BROADCAST_FILES)
    rows = whole.where(F.trim("line") != "").join(binding, "file").where(F.struct("block", "i") != F.col("_head"))
    rows = rows.withColumn("_fields", _fields(F.col("line"), width))

    def bound(c: str) -> Column:
        place = F.col(f"_at.{c}")
        return F.when(place <= F.col("_size"), F.get("_fields", place - 1)).alias(c)

    where = [*(["file_no"] if numbered else []), "_folder", "_part", "name", "block", F.col("i").alias("row_no")]
    return rows.select(*[bound(c) for c in LISTING_COLS], *where), binding


def header_names(line: Column) -> Column:
    """The names in a header line: split at commas outside quotes, quotes taken off."""
    cut = F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(',((?:"[^"]*")+|[^,]*)'), F.lit(1))
    return F.transform(cut, lambda f: F.when(
        f.startswith('"'), F.replace(F.substring(f, F.lit(2), F.length(f) - 2), F.lit('""'), F.lit('"'))).otherwise(f))


def typed(df: DataFrame) -> DataFrame:
    """Text listing columns -> LISTING types (bad numbers -> NULL)."""
    out = []
    for f in LISTING.fields:
        c = F.col(f.name)
        out.append((to_numeric(c) if isinstance(f.dataType, T.LongType) else c).alias(f.name))
    keep = [c for c in df.columns if c not in LISTING_COLS]
    return df.select(*out, *keep)


def as_listings(df: DataFrame, run_ts: str) -> DataFrame:
    """Loose listing rows -> typed table: URL without tracking parameters,
    price and mileage numeric, ``first_seen`` = ``run_ts`` only if absent."""
    cols = {c: F.col(c) for c in df.columns}
    if "url" in cols:
        cols["url"] = url_untrack("url")
    for c in ("price", "mileage"):
        if c in cols:
            cols[c] = to_numeric(c)
    if "first_seen" not in cols:
        cols["first_seen"] = F.lit(run_ts)
    return df.select(*[v.alias(k) for k, v in cols.items()])
