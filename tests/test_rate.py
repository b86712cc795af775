"""The counter that starts again, against going frame by frame."""

from __future__ import annotations

import datetime
import random

import pytest

from framewright.streaming import rate

START = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)


def by_hand(rows, period):
    out = []
    for s in {s for s, _, _ in rows}:
        frames = sorted((ms, i) for q, ms, i in rows if q == s)
        start, n = frames[0][0], 0
        for ms, _ in frames:
            n += 1
            if ms - start > period:
                out.append((s, start, n, ms - start, n * period // (ms - start)))
                start, n = ms, 0
    return sorted(out)


@pytest.mark.parametrize("span", [2_000, 60_000, 900_000])
def test_rates(spark, span):
    rnd = random.Random(span)
    rows = [(rnd.choice("aaaaaab"), rnd.randrange(span), i) for i in range(900)] + [("c", 5, 1)] + [("d", 7, i) for i in range(50)]
    df = spark.createDataFrame([(s, START + datetime.timedelta(milliseconds=ms), i) for s, ms, i in rows] + [(None, START, 1), ("a", None, 1)], "s string, ts timestamp, id long").repartition(4)
    base = int(START.timestamp() * 1000)
    got = sorted((r.stream, r.start_ms - base, r.frames, r.elapsed_ms, r.rate) for r in rate.rates(df, "ts", "id", 1000, "s").collect())
    assert got == by_hand(rows, 1000)


def test_no_frames(spark):
    assert rate.rates(spark.createDataFrame([], "ts timestamp, id long"), "ts", "id").count() == 0
