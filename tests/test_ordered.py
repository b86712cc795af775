"""Running numbers, percentiles and smoothing, against plain Python, with one key that holds nearly all rows."""

from __future__ import annotations

import datetime
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from framewright.operators import metrics, ordered
from framewright.streaming import schedule


def skewed(n=600, seed=1):
    rnd = random.Random(seed)
    return [(None if rnd.random() < 0.02 else rnd.choice("a" * 20 + "bc"), k, rnd.choice([rnd.random(), 0.5, float(rnd.randrange(5))])) for k in range(n)]


def groups(rows):
    out = defaultdict(list)
    for g, k, v in rows:
        out[g].append((k, v))
    return out


def test_running_totals(spark):
    rows = skewed()
    df = spark.createDataFrame(rows, "g string, k long, v double").repartition(5)
    got = ordered.running(df, ["g"], ["k"], {"n": F.lit(1).cast("bigint"), "s": F.col("v")})
    want = {}
    for g, of in groups(rows).items():
        total = 0.0
        for i, (k, v) in enumerate(sorted(of)):
            total += v
            want[k] = (g, i + 1, pytest.approx(total))
    assert {r.k: (r.g, r.n, r.s) for r in got.collect()} == want
    assert ordered.running(df.where("false"), ["g"], ["k"], {"n": F.lit(1)}).count() == 0


def test_one_key_spreads_over_tasks(spark):
    placed = ordered.in_parts(spark.range(4000).withColumn("g", F.lit(1)), ["g"], ["id"])
    sizes = [r["count"] for r in placed.groupBy("_part").count().collect()]
    assert len(sizes) >= 4 and max(sizes) < 2000
    slots = schedule.slots(spark.createDataFrame([(k, datetime.datetime(2024, 1, 1, 0, 0, k % 60)) for k in range(500)], "id long, ts timestamp"), "ts", ["id"], 8)
    order = sorted(range(500), key=lambda k: (k % 60, k))
    assert {r.id: (r.batch_no, r.slot) for r in slots.collect()} == {k: divmod(i, 8) for i, k in enumerate(order)}


def test_percentiles_are_exact(spark):
    rows = skewed(500, 3) + [("one", 9000, 4.0), ("two", 9001, 1.0), ("two", 9002, 2.0), ("none", 9003, None)]
    df = spark.createDataFrame(rows, "g string, k long, v double").repartition(7)
    want = {r.g: tuple(r)[1:] for r in df.groupBy("g").agg(*[F.percentile("v", p) for p in metrics.POINTS.values()]).collect() if r.g != "none"}
    got = {r.g: tuple(r)[1:] for r in metrics.percentiles(df, ["g"], "v").collect()}
    assert got.keys() == want.keys() and all(got[g] == pytest.approx(want[g], abs=1e-12) for g in want)
    plan = metrics.percentiles(df, ["g"], "v")._jdf.queryExecution().toString()
    assert "percentile(" not in plan and "collect_list" not in plan


@pytest.mark.parametrize("n", [1, 2, 3, 7, 40])
def test_smoothing(spark, n):
    rnd = random.Random(n)
    rows = [(g, x, rnd.random()) for g in (None, "a") for x in range(n) for _ in range(rnd.randrange(1, 3))]
    got = metrics.smooth(spark.createDataFrame(rows, "g string, x long, y double"), "g", "x", "y")
    assert "collect_list" not in got._jdf.queryExecution().toString()
    win = 1 if n < 2 else n // 3 + 1
    for g in (None, "a"):
        means = [sum(v) / len(v) for v in ([y for q, k, y in rows if q == g and k == x] for x in range(n))]
        mirrored = lambda j: means[k] if (k := j % (2 * n)) < n else means[2 * n - 1 - k]  # noqa: B023, E731
        want = {x: pytest.approx(sum(mirrored(x - win // 2 + k) for k in range(win)) / win) for x in range(n)}
        assert {r.x: r.y_smooth for r in got.collect() if r.g == g} == want
