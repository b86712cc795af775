"""Shared helpers: the shared work folder, written tables, table readers."""

from __future__ import annotations

import contextlib
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.session import shared_folder

#: The ASCII white-space characters that end a word in ``[^\x20\x09-\x0D]+``.
WHITE = " \t\n\x0b\x0c\r"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: What the operator at work keeps in a Python worker; the next operator's things take its place.
_kept: dict = {}


def on_worker(key, make):
    """``make()``, once in each Python worker as long as the key stays the same.

    Functions find this by its module's name, so tasks of one worker share it; a
    module's own variable would travel with each task's function as a copy.
    """
    if key not in _kept:
        _kept.clear()
        _kept[key] = make()
    return _kept[key]


def forget_kept() -> None:
    _kept.clear()


def small_batches(batches, rows: int = 512):
    """Arrow batches of at most so many rows: bounds what a worker holds besides the batch itself."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def work_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; in local mode (tests) a temporary one where it is unset."""
    return shared_folder(spark)


class _Run(threading.local):
    """Written tables that lazily read results may still need; ``clear_scratch`` deletes them.  Each thread of the driver has its own, so runs side by side leave each other's tables alone."""

    def __init__(self):
        self.paths: list[str] = []


_scratch = _Run()
_cleaning = threading.Lock()
_cleaners, _before = 0, "false"


@contextlib.contextmanager
def _shuffles_removed(spark: SparkSession):
    """What is shuffled inside is of no use afterwards: Spark removes it at the end of each query instead of at some later collection of garbage."""
    global _cleaners, _before
    with _cleaning:
        if not _cleaners:
            _before = spark.conf.get(CLEANUP, "false")
            spark.conf.set(CLEANUP, "true")
        _cleaners += 1
    try:
        yield
    finally:
        with _cleaning:
            _cleaners -= 1
            if not _cleaners:
                spark.conf.set(CLEANUP, _before)


#: Bytes of the tables that another one is made of, for each task that writes it, about.
TASK_BYTES = 1 << 20


def tasks_of(*tables: DataFrame) -> int:
    """How many tasks are enough to write what is made of these written tables: by their bytes, and one for each core at least."""
    spark, total = tables[0].sparkSession, 0
    for table in tables:
        at = spark._jvm.org.apache.hadoop.fs.Path(table.framewright_path)
        total += at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(at).getLength()
    return max(spark.sparkContext.defaultParallelism, -(-total // TASK_BYTES))


def write_table(df: DataFrame, name: str, scratch: bool = True, tasks: int | None = None) -> DataFrame:
    """Write ``df`` under the shared work folder and read it back: cuts the lineage, survives lost executors.

    With ``tasks``, as of ``tasks_of``, a small table isn't written in as many files as there are shuffle partitions.
    """
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with _shuffles_removed(spark):
        (df.coalesce(tasks) if tasks else df).write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.framewright_path = path
    if scratch:
        _scratch.paths.append(path)
    return out


def drop_table(df: DataFrame | None) -> None:
    """Delete a table of ``write_table`` that no later plan reads."""
    path = getattr(df, "framewright_path", None)
    if path:
        _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    if path in _scratch.paths:
        _scratch.paths.remove(path)


def scratch_tables() -> set[str]:
    """Paths of the work tables that exist because a lazily read result may still need them."""
    return set(_scratch.paths)


def clear_scratch(spark: SparkSession, paths: set[str]) -> None:
    """Delete work tables, once the results that read them have been written themselves."""
    for path in paths & scratch_tables():
        _delete(spark, path)


def word_array(text):
    """Words ``[^\\x20\\x09-\\x0D]+`` of a column as an array, inside the JVM; null gives no words."""
    blank = F.translate(F.coalesce(text, F.lit("")), WHITE, " " * len(WHITE))
    return F.array_remove(F.split(blank, " "), "")
