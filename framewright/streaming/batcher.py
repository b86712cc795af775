"""A streaming batcher: a batch closes when it is full, or when its oldest request has waited long enough.

Requests are dealt over shards, each with its own queue in keyed state, so the work
spreads and a shard's state never holds more than one open batch.  A batch has waited long
enough when a request of its shard comes whose time is its deadline or later, or, on a stream that goes on, when as much
time has passed on the clock (a timer of the state).  Every request comes out once: one that is late, with a time
before what its shard has seen in earlier triggers, joins the open batch and is marked; what is still open
when the input ends is a last, partial batch of its shard.  There is no watermark, so nothing is dropped behind one.

What a shard gets in one trigger is sorted in memory; the source's limits of files and bytes a trigger bound it.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from framewright.session import written
from framewright.streaming.schedule import drain, event_time

OUTPUT = "request_id long, shard int, batch_no long, slot int, full boolean, late boolean"
WAITING = "request_id long, batch_no long, slot int, late boolean"
HEAD = "deadline long, number long, newest long, timer long"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def cut(at: np.ndarray, opened: int, deadline: int, size: int, wait: int) -> tuple[list[tuple[int, bool]], int, int]:
    """Where batches end among requests in order of time, when ``opened`` more wait before them.

    Gives (end, full) of each closed batch, how many wait at the end, and their deadline.
    """
    closed, start, n = [], 0, opened
    while start < len(at) or n:
        if not n:
            deadline = int(at[start]) + wait
        end = max(start, min(int(np.searchsorted(at, deadline, "left")), start + size - n))
        n, start = n + end - start, end
        full = n == size
        if not full and start == len(at):
            break  # nothing has come at the deadline or later
        closed.append((end, full))
        n = 0
    return closed, n, deadline


class Batcher(StatefulProcessor):
    """The queue of a shard: requests that wait, and the deadline, batch number, newest time and timer that go with them."""

    def __init__(self, size: int, wait_ms: int, timers: bool):
        self.size, self.wait, self.timers = size, wait_ms, timers

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", WAITING)
        self.head = handle.getValueState("head", HEAD)

    def _held(self, number: int) -> pd.DataFrame:
        rows = [tuple(r) for r in self.waiting.get()]
        return pd.DataFrame(rows, columns=["request_id", "batch_no", "slot", "late"]).astype({"request_id": "int64", "batch_no": "int64", "slot": "int32", "late": "bool"})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        deadline, number, newest, timer = self.head.get() if self.head.exists() else (0, 0, -(1 << 62), 0)
        held = self._held(number)
        new = pd.concat(list(rows)).sort_values(["at", "request_id"])
        at = new["at"].to_numpy().astype("datetime64[ms]").astype(np.int64)
        closed, left, deadline = cut(at, len(held), deadline, self.size, self.wait)
        ends = np.array([end for end, _ in closed], np.int64) + len(held)
        every = pd.concat([held, pd.DataFrame({"request_id": new["request_id"].to_numpy(np.int64), "late": at < newest})], ignore_index=True)
        place = np.arange(len(every))
        batch = np.searchsorted(ends, place, "right")
        every["batch_no"], every["slot"] = number + batch, (place - np.concatenate(([0], ends))[batch]).astype(np.int32)
        out = batch < len(closed)
        rest = every[~out]
        if closed and timer:
            self.handle.deleteTimer(timer)
            timer = 0
        if left and not timer and self.timers:
            timer = timerValues.getCurrentProcessingTimeInMs() + self.wait
            self.handle.registerTimer(timer)
        self.waiting.put([(int(i), int(b), int(s), bool(x)) for i, b, s, x in zip(rest["request_id"], rest["batch_no"], rest["slot"], rest["late"])]) if left else self.waiting.clear()
        self.head.update((int(deadline), number + len(closed), max(newest, int(at[-1])) if len(at) else newest, timer))
        if closed:
            yield self._result(every[out], key, np.array([full for _, full in closed])[batch[out]])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        deadline, number, newest, timer = self.head.get() if self.head.exists() else (0, 0, 0, 0)
        if not timer or expiredTimerInfo.getExpiryTimeInMs() != timer:
            return
        held = self._held(number)
        self.waiting.clear()
        self.head.update((deadline, number + 1, newest, 0))
        if len(held):
            yield self._result(held, key, False)

    @staticmethod
    def _result(rows: pd.DataFrame, key, full) -> pd.DataFrame:
        return rows.assign(shard=np.int32(key[0]), full=full, late=rows["late"].astype(bool))[["request_id", "shard", "batch_no", "slot", "full", "late"]]

    def close(self) -> None:
        pass


def count_or_timeout(stream: DataFrame, key: str, ts: str, size: int, wait_ms: int, shards: int | None = None, shard: Column | None = None, timers: bool = True) -> DataFrame:
    """(request_id, shard, batch_no, slot, full, late) for each request of a stream, when its batch closes.

    ``shard`` deals the requests (default: by a hash of the key over as many shards as the session has shuffle partitions).
    Timers close batches of a stream that goes on; as they wait for more to come, a stream that is to end (``deliver``) has none.
    The session's state store must be RocksDB, see ``rocks_store``.
    """
    shards = shards or int(stream.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = F.pmod(F.xxhash64(F.col(key)), F.lit(shards)) if shard is None else shard
    queued = stream.select(F.col(key).cast("long").alias("request_id"), event_time(F.col(ts)).alias("at"), dealt.cast("int").alias("shard"))
    return queued.groupBy("shard").transformWithStateInPandas(Batcher(size, wait_ms, timers), OUTPUT, "append", "processingTime" if timers else "none")


@contextlib.contextmanager
def rocks_store(spark: SparkSession):
    """State of queries that start inside is kept in RocksDB."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


def still_open(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The requests that wait in the state of a stopped batcher, as rows of its result."""
    state = spark.read.format("statestore").option("stateVarName", "waiting").load(checkpoint)
    return state.select(F.col("key.shard").alias("shard"), "list_element.*").select("request_id", "shard", "batch_no", "slot", F.lit(False).alias("full"), "late")


def deliver(batches: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Runs a batcher without timers over all that is there, as the last of its input, and gives every request: closed batches, then what was open at the end.

    The input is over then: a stream that goes on from this checkpoint would deliver the open requests again.
    """
    spark = batches.sparkSession
    with rocks_store(spark):
        drain(batches, path, checkpoint)
    closed = spark.read.parquet(path)
    return closed.unionByName(written(still_open(spark, checkpoint), "open"))
