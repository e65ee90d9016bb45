"""How listing files are read and rows merged: the same results with less sorted and sent."""

import re

from lotwise.operators import dedupe
from lotwise.sources import files as FS


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_layouts_are_found_without_a_sort_of_all_lines(spark, scratch, monkeypatch):
    for name, text in {"a b.csv": "url,title\n/1,x\n", "c+d.csv": 'title,url\n"two\nlines",/2\n', "out.csv": "url\n/3\n"}.items():
        with open(f"{scratch}/{name}", "w") as f:
            f.write(text)
    kept, staged = [], FS.staged
    monkeypatch.setattr(FS, "staged", lambda df, name, *a: kept.append((name, _plan(df))) or staged(df, name, *a))
    rows = FS.read_listing_csv(spark, f"{scratch}/*.csv", exclude=f"{scratch}/out.csv").collect()
    plan = dict(kept)["csv-files"]
    assert "ObjectHashAggregate" in plan and "SortAggregate" not in plan
    assert sorted((r.file.rsplit("/", 1)[1], r.url, r.title) for r in rows) == [("a b.csv", "/1", "x"), ("c+d.csv", "/2", "two\nlines")]
    assert all(r.file == r.file_pos.folder == r.file_pos.name and r.file_pos.part == -1 for r in rows)


def test_a_merge_sends_the_url_once(spark):
    rows = [("u", "b", 1, None), ("u", "a", 2, ""), ("u", "c", 3, None), ("v", "d", 4, "2024"), ("v", "e", 5, "2023"), ("", "f", 6, "1")]
    df = spark.createDataFrame(rows, "url string, title string, pos int, first_seen string")
    m = dedupe.merge_first_seen(df, ["first_seen", "pos"])
    assert m.columns == [*df.columns, "first_pos"]
    assert sorted((r.url, r.title, r.first_seen, tuple(r.first_pos)) for r in m.collect()) == [
        ("u", "b", None, (None, 1)), ("v", "e", "2023", ("2023", 5))]
    assert not re.search(r"min_by\(struct\([^()]*\burl,", _plan(m))
