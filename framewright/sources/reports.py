"""Benchmark reports: JSON and CSV files, tables, chart data."""

from __future__ import annotations

import datetime
import glob
import json
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.config import BenchmarkConfig
from framewright.operators.metrics import MODE_ORDER, group_means, mode_rank

#: Fixed formats: columns of the reports with their decimals (None: integers and text).
COLUMNS = {
    "mode": None, "override_batch": None, "total_requests": None, "wall_time_ms": 2, "throughput_qps": 2,
    "latency_avg_ms": 4, "latency_min_ms": 4, "latency_max_ms": 4, "latency_p50_ms": 4, "latency_p90_ms": 4, "latency_p95_ms": 4, "latency_p99_ms": 4,
}
RESULT = "struct<mode:string,override_batch:bigint,total_requests:bigint,total_wall_ms:double,throughput_qps:double," + "".join(f"{c}:double," for c in COLUMNS if c.startswith("latency")) + "samples_count:bigint>"
SCHEMA = f"benchmark struct<concurrent_clients:int,mode:string,model_type:string>, timestamp bigint, results array<{RESULT}>, _corrupt_record string"


def rounded(results: DataFrame) -> DataFrame:
    return results.select(*[F.col(c) if d is None else F.round(c, d).alias(c) for c, d in COLUMNS.items()])


def report_name(kind: str, now: datetime.datetime) -> str:
    return f"benchmark_{now:%Y%m%d_%H%M%S}.{kind}"


def report_names(kind: str, ts: Column) -> Column:
    """The same of a column of times."""
    return F.concat(F.lit("benchmark_"), F.date_format(ts, "yyyyMMdd_HHmmss"), F.lit(f".{kind}"))


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A file on any file system that Spark reaches."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)
    try:
        out.write(text.encode("utf-8"))
    finally:
        out.close()


def write_json(results: DataFrame, config: BenchmarkConfig, path: str, timestamp: int) -> None:
    """One report file.  A report has one row for each mode, so it is put together on the driver."""
    rows = []
    for r in rounded(results).collect():
        row = r.asDict()
        row["total_wall_ms"], row["samples_count"] = row.pop("wall_time_ms"), row["total_requests"]
        rows.append(row)
    names = ("config_path", "image_path", "model_type", "mode", "warmup_count", "test_duration_sec", "min_iterations", "concurrent_clients", "show_gpu_stats", "output_dir")
    over = {k: {"batch": o.batch, "buffer_size": o.buffer_size} for k, o in (("sync", config.sync_override), ("async", config.async_override), ("batch", config.batch_override))}
    whole = {"benchmark": {n: getattr(config, n) for n in names}, "overrides": over, "timestamp": timestamp, "results": rows}
    write_text(results.sparkSession, path, json.dumps(whole, indent=2))


def read_json(spark: SparkSession, folder: str) -> DataFrame:
    """(concurrent_clients, results' fields) from all ``benchmark_*.json``, in order of their names; broken files are skipped."""
    raw = spark.read.schema(SCHEMA).option("multiLine", True).option("mode", "PERMISSIVE").json(os.path.join(folder, "benchmark_*.json"))
    good = raw.where(F.col("_corrupt_record").isNull() & F.col("results").isNotNull())
    each = good.select(F.col("_metadata.file_path").alias("file"), "benchmark.concurrent_clients", F.explode("results").alias("r"))
    return each.select("file", "concurrent_clients", "r.*").orderBy("file")


def write_csv(results: DataFrame, config: BenchmarkConfig, path: str) -> None:
    """Lines with # for the configuration, a header, and one line for each mode."""
    over = [(k, getattr(config, f"{k}_override")) for k in ("sync", "async", "batch")]
    names = ("config_path", "image_path", "model_type", "mode", "warmup_count", "test_duration_sec", "min_iterations", "concurrent_clients")
    lines = [f"# {n}: {getattr(config, n)}" for n in names] + [f"# {k}_override: batch={o.batch}, buffer_size={o.buffer_size}" for k, o in over]
    lines.append(",".join(COLUMNS))
    for r in rounded(results).collect():
        lines.append(",".join(str(r[c]) if d is None else f"{r[c]:.{d}f}" for c, d in COLUMNS.items()))
    write_text(results.sparkSession, path, "\n".join(lines) + "\n")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    kinds = {"mode": "string", "override_batch": "int", "total_requests": "bigint"}
    return spark.read.schema(", ".join(f"{c} {kinds.get(c, 'double')}" for c in COLUMNS)).option("header", True).option("comment", "#").csv(path)


def load_any(folder: str) -> list[str]:
    return sorted(glob.glob(os.path.join(folder, "benchmark_*.json")))


def table(results: DataFrame) -> DataFrame:
    """Texts for the console: wall time and throughput with one decimal, latencies with two."""
    decimals = {"wall_time_ms": 1, "throughput_qps": 1}
    return results.select(*[F.col(c).cast("string").alias(c) if d is None else F.regexp_replace(F.format_number(c, decimals.get(c, 2)), ",", "").alias(c) for c, d in COLUMNS.items() if c != "override_batch"])


def summary(reports: DataFrame) -> DataFrame:
    """Means for each mode and number of clients, modes in their fixed order."""
    fields = ["override_batch", "total_requests", "throughput_qps", "latency_avg_ms", "latency_p50_ms", "latency_p90_ms", "latency_p95_ms", "latency_p99_ms"]
    means = group_means(reports, ["mode", "concurrent_clients"], fields).withColumns({c: F.col(c).cast("bigint") for c in ("override_batch", "total_requests")})
    return means.orderBy(mode_rank(F.col("mode")), "mode", "concurrent_clients")


def chart_rows(reports: DataFrame) -> DataFrame:
    """Long form for charts: (mode, clients, metric, value), each metric's mean."""
    metrics = ["throughput_qps", *(c for c in COLUMNS if c.startswith("latency"))]
    means = group_means(reports, ["mode", "concurrent_clients"], metrics)
    return means.unpivot(["mode", "concurrent_clients"], metrics, "metric", "value")


def utilization(lines: DataFrame, column: str = "value") -> DataFrame:
    """Means of polled ``utilization, memory`` lines; lines that are no numbers are left out."""
    parts = F.split(F.col(column), ",")
    number = lambda i: F.try_element_at(parts, F.lit(i)).try_cast("double")
    return lines.select(number(1).alias("gpu"), number(2).alias("memory")).where("gpu is not null and memory is not null").agg(F.avg("gpu").alias("gpu_avg"), F.avg("memory").alias("memory_avg"))


__all__ = ["COLUMNS", "MODE_ORDER", "chart_rows", "load_any", "read_csv", "read_json", "report_name", "rounded", "summary", "table", "utilization", "write_csv", "write_json"]
