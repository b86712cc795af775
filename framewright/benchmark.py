"""The benchmark: modes under load of closed-loop clients, reported as JSON and CSV.

    python -m framewright.benchmark --mode all --clients 4 --duration 2 --image picture.png --output-dir /tmp/reports

Each client repeats one request: a picture through a detector.  Synchronous requests run one
plan each, asynchronous ones spread over partitions, and batched ones feed the model many rows at once.
"""

from __future__ import annotations

import datetime
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.config import BenchmarkConfig, ModelConfig, from_arguments
from framewright.operators import metrics, runners
from framewright.sources import images, onnx_models, reports
from framewright.streaming import schedule

MODES = {"sync": "Sync", "async": "Async", "batch": "Batch"}


def measure(spark: SparkSession, config: BenchmarkConfig, actions: dict[str, Callable[[], object]]) -> DataFrame:
    """One result row for each mode that the configuration asks for."""
    out = None
    for mode in MODES if config.mode == "all" else [config.mode]:
        latencies, wall = schedule.closed_loop(actions[mode], config.test_duration_sec, config.min_iterations, config.warmup_count, config.concurrent_clients)
        samples = spark.createDataFrame([(MODES[mode], x) for x in latencies], "mode string, ms double")
        one = metrics.report(samples, "mode", "ms", F.lit(wall), getattr(config, f"{mode}_override").batch).select(*reports.COLUMNS)
        out = one if out is None else out.unionByName(one)
    return out


def export(results: DataFrame, config: BenchmarkConfig, now: datetime.datetime) -> list[str]:
    """The report files, by the formats that the configuration asks for."""
    written = []
    for kind, wanted in (("json", config.export_json), ("csv", config.export_csv)):
        if wanted:
            written.append(f"{config.output_dir}/{reports.report_name(kind, now)}")
            if kind == "json":
                reports.write_json(results, config, written[-1], int(now.timestamp()))
            else:
                reports.write_csv(results, config, written[-1])
    return written


def detection(spark: SparkSession, config: BenchmarkConfig, rows: int = 8) -> dict[str, Callable[[], object]]:
    """A request of each mode: the picture through a small detector over 8 x 8 planes."""
    picture = images.read_images(spark, config.image_path).select("image")
    model = onnx_models.identity([3, 8, 8])

    def request(n: int, partitions: int | None, batch: int) -> None:
        runner = runners.Detector(ModelConfig("identity", shape=(8, 8), classes=("a", "b"), batch=batch, auto_aspect_ratio=False), model, "y")
        some = picture.withColumn("request_id", F.explode(F.sequence(F.lit(1), F.lit(n)).cast("array<bigint>")))
        runner.run(some.repartition(partitions) if partitions else some).write.format("noop").mode("overwrite").save()

    sizes = {m: max(1, getattr(config, f"{m}_override").batch) for m in MODES}
    return {"sync": lambda: request(1, None, sizes["sync"]), "async": lambda: request(rows, rows, sizes["async"]), "batch": lambda: request(rows, None, max(sizes["batch"], rows))}


def main(arguments: list[str]) -> list[str]:
    from framewright.session import local_session

    config, spark = from_arguments(arguments), local_session()
    results = measure(spark, config, detection(spark, config)).cache()
    reports.table(results).show(truncate=False)
    return export(results, config, datetime.datetime.now())


if __name__ == "__main__":
    print("\n".join(main(sys.argv[1:])))
