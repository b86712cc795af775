"""A frame counter that starts again: it shows a rate once more than a period has gone, and counts anew from there.

A frame's successor is the first one more than a period later; the counter starts again at the successor of
its last start.  Successors come from running counts.  Frames are dealt in ranges of time; within a range, paths are
followed frame by frame, but only from frames that a path can come in at, so a range needs no
other.  What leads from range to range is one row for each such frame, and doubling its steps finds those that the counter's own path
takes, in rounds that grow with the logarithm of the ranges.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.operators import ordered
from framewright.session import written
from framewright.streaming.schedule import event_time


def _follow(numbers, succ) -> dict[int, int]:
    """Where the path from each frame of a range leaves it; 0 if it ends."""
    out: dict[int, int] = {}
    for i, s in sorted(zip(numbers, succ), reverse=True):
        out[i] = out.get(s, s)
    return out


def _exits(pdf: pd.DataFrame) -> pd.DataFrame:
    """(stream, i, exit) for the frames of a range that paths come in at."""
    out = _follow(pdf["i"].tolist(), pdf["succ"].tolist())
    into = pdf["i"][pdf["entry"]].tolist()
    return pd.DataFrame({"stream": pdf["stream"].iloc[0], "i": into, "exit": [out[i] for i in into]}, columns=["stream", "i", "exit"])


def _starts(pdf: pd.DataFrame) -> pd.DataFrame:
    """(stream, i, succ) for the frames on the path, from those of the range that it comes in at."""
    succ, rows = dict(zip(pdf["i"].tolist(), pdf["succ"].tolist())), []
    for i in pdf["i"][pdf["taken"]].tolist():
        while i in succ:
            rows.append((i, succ[i]))
            i = succ[i]
    return pd.DataFrame({"stream": pdf["stream"].iloc[0], "i": [r[0] for r in rows], "succ": [r[1] for r in rows]}, columns=["stream", "i", "succ"])


def successors(frames: DataFrame, period_ms: int) -> DataFrame:
    """(stream, i, ms, succ): frames numbered from 1 in order of time, and the number of each one's successor (0: none)."""
    numbered = written(ordered.running(frames, ["stream"], ["ms", "id"], {"i": F.lit(1).cast("bigint")}), "frames")
    points = numbered.select("stream", "ms", F.lit(0).alias("probe"), "i").unionAll(numbered.select("stream", F.col("ms") + period_ms, F.lit(1), "i"))
    counted = ordered.running(points, ["stream"], ["ms", "probe", "i"], {"upto": (1 - F.col("probe")).cast("bigint")})
    later = counted.where("probe = 1").select("stream", "i", (F.col("ms") - period_ms).alias("ms"), (F.col("upto") + 1).alias("succ"))
    whole = numbered.groupBy("stream").agg(F.max("i").alias("n"))
    return later.join(whole, "stream").select("stream", "i", "ms", F.when(F.col("succ") <= F.col("n"), F.col("succ")).otherwise(F.lit(0)).cast("bigint").alias("succ"))


def rates(requests: DataFrame, ts: str, key: str, period_ms: int = 1000, stream: str | None = None) -> DataFrame:
    """(stream, start_ms, frames, elapsed_ms, rate) for each time the counter shows: frames since it last did, and so many a period, rounded down.

    The clock starts with the first frame, which counts.  ``stream`` names a column that tells streams apart (none: one stream, 0); frames of equal times are in order of ``key``.
    Frames without a time or stream don't count.
    """
    name = F.lit(0) if stream is None else F.col(stream)
    frames = requests.select(name.alias("stream"), F.unix_millis(event_time(F.col(ts))).alias("ms"), F.col(key).alias("id")).where("stream is not null and ms is not null")
    kind = frames.schema["stream"].dataType.simpleString()
    paths = ordered.in_parts(successors(frames, period_ms), ["stream"], ["i"])
    where = paths.select(F.col("stream"), F.col("i").alias("succ"), F.col("_part").alias("to"))
    across = paths.join(where, ["stream", "succ"]).where("to <> _part").select("stream", F.col("succ").alias("i")).distinct()
    into = across.unionAll(paths.where("i = 1").select("stream", "i")).distinct().withColumn("entry", F.lit(True))
    marked = written(paths.join(into, ["stream", "i"], "left").withColumn("entry", F.coalesce("entry", F.lit(False))), "ranges")
    steps = written(marked.groupBy("stream", "_part").applyInPandas(_exits, f"stream {kind}, i long, exit long"), "steps")
    taken = steps.where("i = 1").select("stream", "i")
    while True:
        ahead = taken.join(steps, ["stream", "i"]).where("exit > 0").select("stream", F.col("exit").alias("i"))
        more = written(taken.unionAll(ahead).distinct(), "taken")
        twice = steps.select("stream", "i", F.col("exit").alias("mid")).join(steps.select("stream", F.col("i").alias("mid"), "exit"), ["stream", "mid"]).where("exit > 0").select("stream", "i", "exit")
        taken, steps = more, written(twice, "steps")
        if steps.isEmpty():
            break
    own = marked.join(taken.withColumn("taken", F.lit(True)), ["stream", "i"], "left").withColumn("taken", F.coalesce("taken", F.lit(False)))
    path = own.groupBy("stream", "_part").applyInPandas(_starts, f"stream {kind}, i long, succ long").where("succ > 0").distinct()
    at = lambda number, ms: paths.select("stream", F.col("i").alias(number), F.col("ms").alias(ms))
    shown = path.join(at("i", "start_ms"), ["stream", "i"]).join(at("succ", "end_ms"), ["stream", "succ"])
    frames_ = F.col("succ") - F.col("i") + (F.col("i") == 1).cast("bigint")
    elapsed = F.col("end_ms") - F.col("start_ms")
    return shown.select("stream", "start_ms", frames_.alias("frames"), elapsed.alias("elapsed_ms"), F.floor(frames_ * period_ms / elapsed).cast("bigint").alias("rate"))
