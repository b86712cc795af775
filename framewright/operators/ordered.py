"""Running totals and numbers in order within keys, where one key may hold most rows.

Rows are dealt by ranges of key and order, so a key's rows are spread over neighbouring parts of about the same size.
Totals are added up within each part, and what the parts before add is one row for each key and part.
No window is over a whole key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewright.session import written


def in_parts(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The rows with ``_part``: ranges of key and order, as many as the session has shuffle partitions.  Rows that are equal in both stay together."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return written(df.repartitionByRange(parts, *keys, *order).withColumn("_part", F.spark_partition_id()), "parts")


def running(df: DataFrame, keys: list[str], order: list[str], totals: dict[str, Column]) -> DataFrame:
    """The rows with each total of its column over the rows of the key up to this one; ``order`` tells the rows of a key apart.

    Null keys are one key, as in a window.
    """
    placed = in_parts(df.withColumns({f"_{n}": c for n, c in totals.items()}), keys, order)
    sums = placed.groupBy("_part", *keys).agg(*[F.sum(f"_{n}").alias(f"_{n}") for n in totals])
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part
    before = sums.select(F.col("_part").alias("_of_part"), *[F.col(k).alias(f"_of_{k}") for k in keys], *[F.sum(f"_{n}").over(earlier).alias(f"_before_{n}") for n in totals])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys], F.col("_part") == F.col("_of_part"))
    here = Window.partitionBy("_part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    joined = placed.join(before, same).withColumns({n: F.sum(f"_{n}").over(here) + F.coalesce(f"_before_{n}", F.lit(0)) for n in totals})
    return joined.select(*df.columns, *totals)
