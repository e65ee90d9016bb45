"""Scalar functions on hand-written values."""

from pyspark.sql import functions as F

from lotwise.functions import scalars as fn


def col_of(spark, values, f, typ="string"):
    df = spark.createDataFrame([(v,) for v in values], f"x {typ}")
    return [r[0] for r in df.select(f("x")).collect()]


def test_clean_number(spark):
    assert col_of(spark, ["ask", "", None, "$1,200 or $950", "$8,120.25", "9" * 20], fn.clean_number) == [
        None, None, None, 1200950, 812025, fn.LONG_MAX]


def test_url_strip(spark):
    assert col_of(spark, ["https://a.com/p?q=1#f", "HTTP://A.com/x#y?z", "\thttp://a.com/b\n?c", None],
                  fn.url_strip) == ["https://a.com/p", "http://A.com/x", "http://a.com/b", None]


def test_url_untrack(spark):
    got = col_of(spark, ["http://A.com/b?UTM_x=1&a=b%20c&d&e=é#f", "https://x.org/p?utm_source=s&utm_medium=m",
                         "https://x.org/p?a=1&&b=*~", "https://x.org/p?v=%zz"], fn.url_untrack)
    assert got == ["http://A.com/b?a=b+c&d=&e=%C3%A9", "https://x.org/p", "https://x.org/p?a=1&b=%2A~",
                   "https://x.org/p?v=%25zz"]


def test_url_join(spark):
    got = col_of(spark, ["https://o.com/a", "//cdn.com/x", "/p/q", "?s=1", "#top", "rel/x", "", None],
                 lambda c: fn.url_join(c, "https://www.cars.com"))
    assert got == ["https://o.com/a", "https://cdn.com/x", "https://www.cars.com/p/q", "https://www.cars.com?s=1",
                   "https://www.cars.com#top", "https://www.cars.com/rel/x", "https://www.cars.com", None]


def test_url_encode(spark):
    assert col_of(spark, ["a b*~é/:"], fn.url_encode) == ["a+b%2A~%C3%A9%2F%3A"]


def test_strip_parens_and_year(spark):
    assert col_of(spark, ["(Philly)", "((x", "a(b)", None], fn.strip_parens) == ["Philly", "x", "a(b", None]
    assert col_of(spark, ["2010 Ford", "201x Ford", "99", "", None], fn.title_year) == [2010, None, None, None, None]


def test_is_blank(spark):
    assert col_of(spark, [None, "", "  ", " \t", "x", " x "], fn.is_blank) == [True, True, True, True, False, False]


def test_to_numeric(spark):
    assert col_of(spark, ["4000", " 12 ", "4000.0", "4000.5", "abc", None], fn.to_numeric) == [
        4000, 12, 4000, None, None, None]


def test_formats(spark):
    assert col_of(spark, [1234567, None, 0], fn.fmt_int, "bigint") == ["1,234,567", "n/a", "0"]
    assert col_of(spark, [4000, None], fn.fmt_currency, "bigint") == ["$4,000", "n/a"]
    assert col_of(spark, [0.0, 59.0, 61.0, 3599.0, 3600.0, 3661.9, 86400.0], fn.fmt_duration, "double") == [
        "0:00", "0:59", "1:01", "59:59", "1:00:00", "1:01:01", "24:00:00"]


def test_stamps(spark):
    df = spark.createDataFrame([("2024-03-05 06:07:08",)], "s string").select(F.to_timestamp("s").alias("t"))
    r = df.select(fn.utc_stamp("t"), fn.run_stamp("t")).first()
    assert tuple(r) == ("2024-03-05T06:07:08", "20240305-060708")
