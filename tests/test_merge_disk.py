"""The merge job's disk: no copies of all rows, no names moved with rows, shuffle files gone when a step ends."""

import datetime
import glob
import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotwise.plans import jobs as J
from lotwise.schema import LISTING
from lotwise.sinks import writers as W
from lotwise.sources import derived as D
from lotwise.sources import files as FS

NAMES = {"cargurus": "b_results.csv", "cars.com": "a_results.csv"}
ROW = "source string, title string, price bigint, mileage bigint, dealer string, location string, url string, first_seen string, at int"


def _rows(spark):
    sources = ["cargurus", "cars.com", "other", None]
    return spark.createDataFrame([(sources[i % 4], f't "{i}"', i, None, "", " x ", f"u{i % 7}", f"2024-01-{i % 9 + 1:02d}", -i)
                                  for i in range(80)], ROW).repartition(5)


def _put(folder: str, **texts: str) -> None:
    for name, text in texts.items():
        with open(f"{folder}/{name}_results.csv", "w") as f:
            f.write(text)


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _shuffled(spark) -> set[str]:
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()
    return {str(blocks.apply(i)) for i in range(blocks.size()) if str(blocks.apply(i)).startswith("shuffle_")}


def _nothing_new(spark, before: set[str]) -> bool:
    for _ in range(50):  # they are removed by another thread
        if not _shuffled(spark) - before:
            return True
        time.sleep(0.1)
    return False


def test_result_files_are_written_without_a_copy(spark, scratch, monkeypatch):
    rows, before = _rows(spark), _shuffled(spark)
    monkeypatch.setattr(DataFrame, "checkpoint", lambda *a, **k: 1 / 0)
    W.write_results_files(rows, f"{scratch}/r", ["at"], NAMES)
    assert _nothing_new(spark, before)
    files = FS._lines(spark, f"{scratch}/r/file=*/*.csv").collect()
    folders = {r.file.rsplit("/", 2)[1] for r in files}
    assert folders == {"file=a_results.csv", "file=b_results.csv", "file=__HIVE_DEFAULT_PARTITION__"}
    for name, want in (("a_results.csv", range(77, 0, -4)), ("b_results.csv", range(76, -1, -4))):
        own = sorted((r.file, r.block, r.i, r.line) for r in files if f"file={name}/" in r.file and not r.line.startswith("source,"))
        assert [r[3].split('""')[1] for r in own] == [str(i) for i in want]
    rest = [r.line for r in files if "__HIVE" in r.file and not r.line.startswith("source,")]
    assert len(rest) == 40 and sum(x.startswith("other,") for x in rest) == 20


def test_texts_are_made_after_the_sort_and_files_may_be_packed(spark, scratch, monkeypatch):
    monkeypatch.setattr(W, "MAX_WHOLE_FILE", 3)
    rows = _rows(spark)
    W.write_results_files(rows, f"{scratch}/plain", ["at"], NAMES)
    W.write_results_files(rows.drop("title"), f"{scratch}/packed", [F.col("at")], NAMES, compression="lz4",
                          finish=lambda t: t.withColumn("title", F.format_string('t "%d"', -F.col("at"))))
    read = {k: [tuple(r)[:8] for r in FS.read_listing_csv(spark, f"{scratch}/{k}/file=*_results.csv").orderBy(*FS.FILE_ORDER).collect()]
            for k in ("plain", "packed")}
    assert len(read["plain"]) == 40 and read["plain"] == read["packed"]
    packed = glob.glob(f"{scratch}/packed/file=a_results.csv/part-*.lz4")
    assert len(packed) >= 7 and all(r.n <= 4 for r in spark.read.text(packed).groupBy(F.input_file_name()).agg(F.count("*").alias("n")).collect())
    one, two = (J.job_merge(spark, f"{scratch}/{k}/file=*_results.csv") for k in ("plain", "packed"))
    assert len(first := sorted(map(tuple, one.drop("first_pos").collect()))) == 7 and first == sorted(map(tuple, two.drop("first_pos").collect()))


def test_lines_have_the_order_of_their_listings(spark):
    day = datetime.datetime(2020, 5, 5, 1, 2, 3)
    keys = [(1, 1, 1), (1, 3, 3), (1, 3, 4), (1, 3, 3), (None, 3, 3), (2, None, 1)]
    lines = [(k[0], k[1], k[2], n, float(q), float(-q), day + datetime.timedelta(seconds=q * 7 % 5, microseconds=q) if q % 3 else None, "a nut", "B")
             for q, (k, n) in enumerate([(k, n) for k in keys for n in (1, 2, 2)])]
    df = spark.createDataFrame(lines, "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double,"
                                      "l_extendedprice double, l_shipdate timestamp, p_name string, p_brand string").withColumn("source", F.lit("cars.com"))
    shown = [c for c in D.ORDER if c != "l_quantity"]
    by_text = D.listings_of(df).orderBy(*D.ORDER).select(*shown, "title").collect()
    by_line = D.listings_of(df.orderBy(*D.line_order())).select(*shown, "title").collect()
    assert by_text == by_line and len(by_line) == 18


def test_the_merge_moves_numbers_and_leaves_no_shuffle(spark, scratch, monkeypatch):
    _put(scratch, a="url,title,first_seen\n/1,x,2024-02\n/2,y,\n,z,1\n", b='first_seen,title,url\n2024-01,"late\nlines",/1\n2023,n,/3\n,w,/2\n')
    kept, staged, before = {}, J.staged, _shuffled(spark)
    monkeypatch.setattr(J, "staged", lambda df, name, *a: kept.update({name: _plan(df)}) or staged(df, name, *a))
    splits = spark.conf.get("spark.sql.files.maxPartitionBytes")
    merged = J.job_merge(spark, f"{scratch}/*_results.csv", f"{scratch}/out.csv")
    assert _nothing_new(spark, before) and spark.conf.get("spark.sql.files.maxPartitionBytes") == splits
    sort = next(x for x in kept["merged"].splitlines() if "SortAggregate" in x)
    assert "file_no" in sort and "folder" not in sort and "name" not in sort
    got = merged.orderBy("first_pos").collect()
    assert merged.columns == [*LISTING.names, "first_pos"]
    assert [(r.url, r.title, r.first_seen, r.first_pos.file_pos.name.rsplit("/", 1)[1]) for r in got] == [
        ("/1", "late\nlines", "2024-01", "a_results.csv"), ("/2", "y", None, "a_results.csv"), ("/3", "n", "2023", "b_results.csv")]
    want = FS.read_listing_csv(spark, f"{scratch}/*_results.csv").select(F.struct(*FS.FILE_ORDER).alias("first_pos"))
    assert merged.schema["first_pos"].dataType.simpleString() == want.schema["first_pos"].dataType.simpleString()


def test_files_are_numbered_in_reading_order(spark, scratch):
    _put(scratch, **{f"f{i}": f"url\n/{i}\n/{i}b\n" for i in (3, 1, 2, 10)}, empty="url\n", blank="")
    rows, files = FS.numbered_listing_csv(spark, f"{scratch}/*_results.csv")
    placed = rows.select("url", F.struct(*FS.NUMBER_ORDER).alias("place"))
    by_number = [r.url for r in placed.orderBy("place").collect()]
    assert by_number == [r.url for r in FS.read_listing_csv(spark, f"{scratch}/*_results.csv").orderBy(*FS.FILE_ORDER).collect()]
    told = FS.named(placed, "place", files).orderBy("place").collect()
    assert [r.url for r in told] == by_number and all(r.place.file_pos.folder == r.place.file_pos.name for r in told)
    assert FS.numbered_listing_csv(spark, f"{scratch}/nothing-*") is None
