"""Execution modes: plain batches, pipelines of stages, micro-batches, streams.

Synchronous: the stages of a runner one after the other.  Asynchronous: the same
stages over partitions, which Spark runs side by side.  Micro-batched: requests of
one tick of event time get consecutive slots, at most ``size`` a batch; a batch closes
when it is full or its tick ends, and the rest of a tick is never dropped.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framewright.operators import ordered

Stage = Callable[[DataFrame], DataFrame]


def event_time(ts: Column) -> Column:
    """Event time with a zone, as watermarks and windows need it."""
    return ts.cast("timestamp")


def run_sync(requests: DataFrame, stages: list[Stage]) -> DataFrame:
    for stage in stages:
        requests = requests.transform(stage)
    return requests


def run_async(requests: DataFrame, stages: list[Stage], partitions: int | None = None) -> DataFrame:
    """The stages over partitions of their own; stages without a shuffle are one pipeline in each task."""
    return run_sync(requests.repartition(partitions) if partitions else requests, stages)


def slots(requests: DataFrame, ts: str, order: list[str], size: int, tick: str = "1 hour") -> DataFrame:
    """Adds ``tick``, ``batch_no`` within it and ``slot`` within the batch, first come first served; a tick that holds all requests is numbered in parts."""
    rows = requests.withColumn("tick", F.window(event_time(F.col(ts)), tick)["start"])
    placed = ordered.running(rows, ["tick"], [ts, *order], {"_place": F.lit(1).cast("bigint")}).withColumn("_place", F.col("_place") - 1)
    return placed.withColumns({"batch_no": F.floor(F.col("_place") / size).cast("int"), "slot": (F.col("_place") % size).cast("int")}).drop("_place")


def batch_sizes(requests: DataFrame, ts: str, size: int, tick: str = "1 hour") -> DataFrame:
    """(requests, batches): how many micro-batches have how many requests, from counts of each tick alone."""
    counts = requests.groupBy(F.window(event_time(F.col(ts)), tick).alias("w")).agg(F.count("*").alias("n"))
    full, rest = F.floor(F.col("n") / size), F.col("n") % size
    each = counts.select(F.explode(F.array(F.struct(F.lit(size).cast("bigint").alias("requests"), full.alias("batches")), F.struct(rest.alias("requests"), (rest > 0).cast("bigint").alias("batches")))).alias("b"))
    return each.where("b.batches > 0").groupBy("b.requests").agg(F.sum("b.batches").cast("bigint").alias("batches"))


def shed(requests: DataFrame, ts: str, order: list[str], capacity: int, tick: str = "1 hour") -> DataFrame:
    """At most ``capacity`` requests of each tick: the newest are dropped, as by a full queue that nobody empties."""
    place = F.row_number().over(Window.partitionBy("_tick").orderBy(ts, *order))
    return requests.withColumn("_tick", F.window(event_time(F.col(ts)), tick)["start"]).withColumn("_place", place).where(F.col("_place") <= capacity).drop("_tick", "_place")


def ring_capacity(size: int) -> int:
    """Usable places of a ring of at least ``size`` that is a power of two with one place always free."""
    return (1 << max(1, (size - 1).bit_length())) - 1


def frames_per_second(requests: DataFrame, ts: str, per: str = "1 second") -> DataFrame:
    """(w, frames, fps) for each window that has frames."""
    seconds = F.unix_timestamp(F.col("w.end")) - F.unix_timestamp(F.col("w.start"))
    return requests.groupBy(F.window(event_time(F.col(ts)), per).alias("w")).agg(F.count("*").alias("frames")).withColumn("fps", F.floor(F.col("frames") / seconds).cast("bigint"))


def guarded(df: DataFrame, value: Column, problem: Column) -> DataFrame:
    """``value`` where there is no problem, else an ``error`` on that row; other rows are not touched."""
    return df.withColumns({"error": problem, "value": F.when(problem.isNull(), value)})


def drain(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process all that is there now, write it and stop; what was taken in is written once."""
    stream.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def drain_triggers(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> int:
    """Process all that is there in as many triggers as the source's own limit makes of it, write it and stop; gives their number."""
    query = stream.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(processingTime="0 seconds").start()
    try:
        query.processAllAvailable()
        return query.lastProgress["batchId"] + (query.lastProgress["numInputRows"] > 0)
    finally:
        query.stop()


def drain_batches(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """The same with a function of each micro-batch and its number."""
    stream.writeStream.outputMode(mode).foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def stream_table(spark: SparkSession, path: str, schema, most_files: int = 16) -> DataFrame:
    """A folder of Parquet files as a stream with a bounded number of files a batch (back-pressure)."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", most_files).parquet(path)


def closed_loop(action: Callable[[], object], seconds: float, least: int, warm_up: int = 0, clients: int = 1) -> tuple[list[float], float]:
    """Latencies in ms of actions that each client repeats until time is over and it has run enough of them itself, and the wall time; warm-up runs don't count."""
    for _ in range(warm_up):
        action()
    samples: list[float] = []
    began = time.perf_counter()

    def client() -> None:
        own: list[float] = []
        while time.perf_counter() - began < seconds or len(own) < least:
            t = time.perf_counter()
            action()
            own.append((time.perf_counter() - t) * 1000)
        samples.extend(own)

    with ThreadPoolExecutor(clients) as pool:
        for done in [pool.submit(client) for _ in range(clients)]:
            done.result()
    return samples, (time.perf_counter() - began) * 1000
