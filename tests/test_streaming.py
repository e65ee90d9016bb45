"""Incremental merge over arriving files equals the one-shot merge."""

import os

from lotwise.plans import jobs as J
from lotwise.schema import LISTING
from lotwise.streaming import incremental_merge as IM


def _write(spark, rows, path):
    spark.createDataFrame(rows, LISTING).coalesce(1).write.option("header", True).csv(path)


def test_incremental_equals_one_shot(spark, scratch):
    inp, state, ckpt = f"{scratch}/in", f"{scratch}/state", f"{scratch}/ckpt"
    os.makedirs(inp)
    b1 = [("cars.com", "A", 1, 1, "d", "l", "http://1", "2024-01-02T00:00:00"),
          ("cars.com", "B", 2, 2, "d", "l", "http://2", "2024-01-05T00:00:00"),
          ("cars.com", "B0", 2, 2, "d", "l", "http://2", "2024-01-05T00:00:00")]
    b2 = [("cargurus", "C", 3, 3, "d", "l", "http://2", "2024-01-01T00:00:00"),
          ("cargurus", "D", 4, 4, "d", "l", "http://1", "2024-01-02T00:00:00"),
          ("cargurus", "E", 5, 5, "d", "l", "http://3", "")]
    _write(spark, b1, f"{inp}/a_results.csv")
    IM.start(spark, f"{inp}/*_results.csv/*.csv", state, ckpt).awaitTermination()
    _write(spark, b2, f"{inp}/b_results.csv")
    IM.start(spark, f"{inp}/*_results.csv/*.csv", state, ckpt).awaitTermination()
    IM.vacuum(spark, state, 1)
    got = sorted((r.url, r.title) for r in IM.latest(spark, state, 1).collect())
    one_shot = sorted((r.url, r.title) for r in J.job_merge(spark, f"{inp}/*_results.csv").collect())
    assert got == one_shot == [("http://1", "A"), ("http://2", "C"), ("http://3", "E")]
