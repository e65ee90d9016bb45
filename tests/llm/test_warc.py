"""WARC archives: a whole round trip, damaged archives, edge rows."""

import hashlib

import pytest

from lotwise.llm import warc

SCHEMA = "page_id bigint, url string, html string, payload string, revisit int"


def brute(rows):
    firsts = {}
    for i, _, h, *_ in rows:
        if i is not None:
            firsts[h or ""] = max(firsts.get(h or "", i), i)
    out = []
    for i, _, h, *_ in rows:
        data, first = (h or "").encode(), firsts.get(h or "")
        again = len(data) >= 1000 and i != first
        out.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", first if again else None))
    return sorted(out, key=repr)


def round_trip(spark, rows, folder):
    warc.write_archives(spark.createDataFrame(rows, SCHEMA), folder)
    back = warc.read_archives(spark, folder, payloads=True).collect()
    assert all(r.problem is None for r in back)
    num = lambda x: None if x is None else int(x)
    got = [(num(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, num(r.refers_to)) for r in back]
    assert sorted(got, key=repr) == brute(rows)
    for r in back:
        assert r.payload is None or len(r.payload) == r.payload_bytes
    return back


def test_round_trip(spark, scratch):
    long, short = "<p>é" * 400, "<p>same</p>"
    rows = [(1, "http://a/", long, "", 0), (2, None, long, "", 0), (3, "http://b/\r\nX: y", None, "", 0), (4, "u", "", "", 0),
            (5, "u", short, "", 0), (6, "u", short, "", 0), (None, "u", long, "", 0), (2, None, long, "", 0),
            (7, "u", "x" * 3_000_000, "", 0), (8, "u", "a\r\n\r\nWARC/1.1", "", 0), (None, "v", "y" * 1000, "", 0)]
    rows += [(100 + i, f"http://h/{i}", f"<html>{i} " + "word " * 300, "", 0) for i in range(300)]
    back = round_trip(spark, rows, scratch + "/a")
    assert {r.page_id: r.url for r in back}["100"] == "http://h/0"


def test_many_archives(spark, scratch, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 1)
    made = warc.write_archives(spark.createDataFrame([(i, "u", "h" * i, "", 0) for i in range(40)], SCHEMA), scratch + "/m")
    assert made.count() == 40 and warc.read_archives(spark, scratch + "/m").count() == 40


def test_empty_table(spark, scratch):
    df = spark.createDataFrame([], SCHEMA)
    assert warc.write_archives(df, scratch + "/e").count() == 0
    assert warc.read_archives(spark, scratch + "/e").count() == 0


def test_damage_is_told():
    good = warc.record_bytes("1", "u", b"abc", 3, hashlib.sha1(b"abc").hexdigest(), None, False)
    assert warc.parse_record(good)["payload"] == b"abc"
    for bad in (good[:-1], good + b"x", good.replace(b"WARC/1.1", b"WARC/9"), good.replace(b"abc", b"abd"),
                good.replace(b"WARC-Date", b"Date"), b""):
        with pytest.raises(ValueError):
            warc.parse_record(bad)
    for bad in (b"", b"x" * 20, warc.dictionary_frame(b"d")[:9], warc.dictionary_frame(b"d") + warc.ZSTD_MAGIC):
        with pytest.raises((ValueError, warc.zstandard.ZstdError)):
            list(warc.read_archive(bad))
    assert list(warc.read_archive(warc.dictionary_frame(b"d" * 100))) == []


def test_plain_dictionary_frame():
    import struct

    words = b"some plain dictionary " * 20
    packer = warc.zstandard.ZstdCompressor(dict_data=warc._loaded(words))
    archive = struct.pack("<II", warc.DICT_MAGIC, len(words)) + words + packer.compress(b"one") + packer.compress(b"two" * 90000)
    assert list(warc.read_archive(archive)) == [b"one", b"two" * 90000]
