"""Latency reports: percentiles, means, throughput, grids, smoothing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.operators import ordered
from framewright.session import written

POINTS = {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}
# Fixed order of the modes in reports; others come last.
MODE_ORDER = {"Sync": 0, "Async": 1, "Batch": 2}


def percentiles(df: DataFrame, keys: list[str], latency: str) -> DataFrame:
    """(keys, one column for each point), exact, with linear interpolation between neighbours; nulls don't count.

    Equal values are one row with their number, and running numbers tell which values a point lies between: no task has all values of a key.
    """
    keyed = df.select(*keys, F.col(latency).cast("double").alias("x")).where("x is not null").groupBy(*keys, "x").agg(F.count("*").alias("n"))
    placed = ordered.running(keyed, keys, ["x"], {"upto": F.col("n")})
    whole = keyed.groupBy(*[F.col(k).alias(f"_of_{k}") for k in keys]).agg(F.sum("n").alias("all"))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys])
    at = lambda p: (F.col("all") - 1) * F.lit(p)
    value = lambda place: F.max(F.when((F.col("upto") - F.col("n") <= place) & (place < F.col("upto")), F.col("x")))
    near = [(F.floor(at(p)), F.ceil(at(p)), at(p)) for p in POINTS.values()]
    found = placed.join(whole, same).groupBy(*keys).agg(F.any_value("all").alias("all"), *[value(x).alias(f"{n}_{k}") for n, (low, high, _) in zip(POINTS, near) for k, x in (("low", low), ("high", high))])
    between = lambda n, low, high, at: F.when(low == high, F.col(f"{n}_low")).otherwise((high - at) * F.col(f"{n}_low") + (at - low) * F.col(f"{n}_high"))
    return found.select(*keys, *[between(n, *x).alias(f"latency_{n}_ms") for n, x in zip(POINTS, near)])


def with_percentiles(counted: DataFrame, samples: DataFrame, keys: list[str], latency: str) -> DataFrame:
    """A report's groups with the percentiles of their samples."""
    of = percentiles(samples, keys, latency).withColumnsRenamed({k: f"_of_{k}" for k in keys})
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys])
    return counted.join(of, same, "left").drop(*[f"_of_{k}" for k in keys])


def summary(latency: str) -> list[Column]:
    return [F.avg(latency).alias("latency_avg_ms"), F.min(latency).alias("latency_min_ms"), F.max(latency).alias("latency_max_ms")]


def throughput(count: Column, wall_ms: Column) -> Column:
    """Requests a second; 0 if no time has passed."""
    return F.when(wall_ms > 0, count / wall_ms * 1000).otherwise(F.lit(0.0))


def report(samples: DataFrame, mode: str, latency: str, wall_ms: Column, override_batch: int = 0) -> DataFrame:
    """One result row for each mode; ``wall_ms`` is an aggregate expression."""
    rows = samples.withColumn("mode", F.col(mode))
    counted = rows.groupBy("mode").agg(F.count(latency).alias("total_requests"), wall_ms.cast("double").alias("wall_time_ms"), *summary(latency))
    whole = with_percentiles(counted, rows, ["mode"], latency)
    return whole.withColumns({"override_batch": F.lit(override_batch), "throughput_qps": throughput(F.col("total_requests"), F.col("wall_time_ms"))})


def filled(result: DataFrame, modes: list[str]) -> DataFrame:
    """A row for every mode; a mode without samples has zeros."""
    spark = result.sparkSession
    every = spark.createDataFrame([(m,) for m in modes], "mode string")
    numbers = [c for c in result.columns if c != "mode"]
    return every.join(result, "mode", "left").select("mode", *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in numbers])


def group_means(rows: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Mean of each field for each group; a missing value counts as 0."""
    return rows.groupBy(*keys).agg(*[F.avg(F.coalesce(F.col(f), F.lit(0.0))).alias(f) for f in fields])


def mode_rank(mode: Column) -> Column:
    out = F.lit(len(MODE_ORDER))
    for name, i in MODE_ORDER.items():
        out = F.when(mode == name, i).otherwise(out)
    return out


def complete_grid(cells: DataFrame, rows: str, columns: str, values: list[str]) -> DataFrame:
    """Every pair of a row and a column; absent cells are null.

    The distinct columns of a report are few: they become an array on each row.
    """
    across = [r[0] for r in cells.select(columns).distinct().orderBy(columns).collect()]
    grid = cells.select(rows).distinct().withColumn(columns, F.explode(F.array(*map(F.lit, across))))
    return grid.join(cells.select(rows, columns, *values), [rows, columns], "left")


def overridden(base: Column, over: Column, is_set: Column) -> Column:
    """The override where it is set, else the base value."""
    return F.coalesce(F.when(is_set, over), base)


def smooth(points: DataFrame, group: str, x: str, y: str) -> DataFrame:
    """Moving average of each group's points in order of x, equal x averaged first.

    The window has max(1, n // 3 + 1) points, one more to the left if even, and the
    ends are mirrored with the end point repeated.  A window's sum is the difference of two running sums, which each
    point looks up by number; beyond an end the running sum is mirrored too.  No curve is gathered.
    """
    means = points.groupBy(group, x).agg(F.avg(y).alias("y"))
    curve = written(ordered.running(means, [group], [x], {"i": F.lit(1).cast("bigint"), "s": F.col("y")}), "curve")
    whole = curve.groupBy(F.col(group).alias("_of")).agg(F.max("i").alias("n"), F.max_by("s", "i").alias("whole"))
    half, win = F.floor(F.col("win") / 2), F.when(F.col("n") < 2, 1).otherwise(F.floor(F.col("n") / 3) + 1).cast("bigint")
    wide = curve.join(whole, F.col(group).eqNullSafe(F.col("_of"))).drop("_of").withColumn("win", win)
    # points of the mirrored curve before place j, which is within one curve's length of the ends
    ends = wide.withColumns({"to": F.col("i") - 1 - half + F.col("win"), "since": F.col("i") - 1 - half})
    place = lambda j: F.when(j < 0, -j).when(j > F.col("n"), 2 * F.col("n") - j).otherwise(j)
    sums = lambda name: curve.select(F.col(group).alias(f"_{name}_of"), F.col("i").alias(f"_{name}_i"), F.col("s").alias(f"_{name}"))
    for name in ("to", "since"):
        ends = ends.join(sums(name), F.col(group).eqNullSafe(F.col(f"_{name}_of")) & (place(F.col(name)) == F.col(f"_{name}_i")), "left")
    upto = lambda j, s: F.when(j < 0, -s).when(j > F.col("n"), 2 * F.col("whole") - s).otherwise(s)
    of = lambda name: upto(F.col(name), F.coalesce(F.col(f"_{name}"), F.lit(0.0)))
    return ends.select(group, x, "y", ((of("to") - of("since")) / F.col("win")).alias("y_smooth"))
