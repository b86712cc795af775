"""The streaming batcher: full batches, deadlines, late requests, what is open at the end."""

from __future__ import annotations

import datetime
import random

import numpy as np

from framewright.streaming import schedule
from framewright.streaming.batcher import count_or_timeout, cut, deliver

START = datetime.datetime(2024, 1, 1)


def triggers(spark, folder, parts, size, wait, shards=1, shard=None):
    """One file a trigger, in their order."""
    at = lambda ms: START + datetime.timedelta(milliseconds=ms)
    for n, rows in enumerate(parts):
        spark.createDataFrame([(i, at(ms)) for i, ms in rows], "id long, ts timestamp").coalesce(1).write.parquet(str(folder / "in" / f"part={n}"))
    stream = schedule.stream_table(spark, str(folder / "in" / "part=*"), "id long, ts timestamp", most_files=1)
    out = deliver(count_or_timeout(stream, "id", "ts", size, wait, shards, shard, timers=False), str(folder / "out"), str(folder / "checkpoint"))
    return sorted(tuple(r) for r in out.select("batch_no", "slot", "request_id", "full", "late").collect())


def test_count_or_timeout(spark, tmp_path):
    parts = [[(i, i) for i in range(7)], [(10, 500)], [(20, 10_000), (21, 10_001), (22, 10_002), (23, 10_003)]]
    got = triggers(spark, tmp_path, parts, 3, 100)
    full = [(0, 0, 0), (0, 1, 1), (0, 2, 2), (1, 0, 3), (1, 1, 4), (1, 2, 5), (4, 0, 20), (4, 1, 21), (4, 2, 22)]
    partial = [(2, 0, 6), (3, 0, 10), (5, 0, 23)]
    assert got == sorted([(*x, True, False) for x in full] + [(*x, False, False) for x in partial])


def test_late_requests_are_delivered(spark, tmp_path):
    """The third file holds earlier times than the first two: its requests join the open batch and those after it."""
    parts = [[(0, 1000), (1, 1001)], [(2, 1002), (3, 5000)], [(4, 10), (5, 11), (6, 12), (7, 6000)]]
    got = triggers(spark, tmp_path, parts, 4, 100)
    assert got == [(0, 0, 0, False, False), (0, 1, 1, False, False), (0, 2, 2, False, False), (1, 0, 3, True, False), (1, 1, 4, True, True), (1, 2, 5, True, True), (1, 3, 6, True, True), (2, 0, 7, False, False)]


def test_every_request_comes_out_once(spark, tmp_path):
    rnd = random.Random(2)
    ids = list(range(400))
    parts = [[(i, rnd.randrange(3000)) for i in ids[k::4]] for k in range(4)]
    got = triggers(spark, tmp_path, parts, 8, 50, shards=3)
    assert sorted(r[2] for r in got) == ids and any(r[4] for r in got)


def test_cut():
    at = np.array([0, 1, 2, 150, 151, 400])
    assert cut(at, 0, 0, 2, 100) == ([(2, True), (3, False), (5, True)], 1, 500)
    assert cut(at, 1, 90, 4, 100) == ([(3, True), (5, False)], 1, 500)
    assert cut(np.array([], np.int64), 2, 90, 4, 100) == ([], 2, 90)
    # one that waits is closed by a request at its deadline
    assert cut(np.array([90]), 1, 90, 4, 100) == ([(0, False)], 1, 190)


def test_timers_close_batches_of_a_stream_that_goes_on(spark, tmp_path):
    """Nothing more comes, and the batch of two leaves when its wait is over."""
    import time

    from framewright.streaming.batcher import rocks_store

    spark.createDataFrame([(1, START), (2, START)], "id long, ts timestamp").coalesce(1).write.parquet(str(tmp_path / "in"))
    out = count_or_timeout(schedule.stream_table(spark, str(tmp_path / "in"), "id long, ts timestamp"), "id", "ts", 8, 500, 1)
    with rocks_store(spark):
        query = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="1 second").start()
    try:
        until = time.time() + 60
        got = []
        while not got and time.time() < until and query.isActive:
            time.sleep(1)
            if (tmp_path / "out" / "_spark_metadata").exists():
                got = spark.read.schema("request_id long, batch_no long, slot int, full boolean").parquet(str(tmp_path / "out")).collect()
    finally:
        query.stop()
    assert sorted((r.request_id, r.batch_no, r.slot, r.full) for r in got) == [(1, 0, 0, False), (2, 0, 1, False)]
