"""Registered queries, one or more for each operator, each with its SQL where SQL can say it.

Inputs stand in for requests: ``embeddings`` are tensors of 64 values, ``orders`` give
image sizes, ``events`` are a stream of requests with a latency and a mode.
"""

from __future__ import annotations

import dataclasses
import tempfile
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framewright.config import (
    BACKENDS, EXECUTION_MODES, GRAPH_LEVELS, LOG_LEVELS, BenchmarkConfig, ModelConfig, Override, benchmark_config, from_arguments, model_config, parse_backend, parse_execution_mode, parse_graph_level, parse_log_level, parse_yaml,
)
from framewright.functions import geometry, tensor
from framewright.operators import detect, infer, metrics, pixels, runners, table_functions
from framewright.session import work_folder
from framewright.sources import frames, images, onnx_models, reports
from framewright.streaming import batcher, rate, schedule

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


# --- inputs

LABELS = ["person", "bicycle", "car", "motorcycle"]
CONF, NMS = 0.1, 0.45


def sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return read(spark, sf_dir, "orders").select("o_orderkey", (64 + k % 1900).cast("int").alias("w"), (64 + (k * 7) % 1900).cast("int").alias("h"))


SIZES = "(select o_orderkey, (64 + o_orderkey % 1900)::int as w, (64 + (o_orderkey * 7) % 1900)::int as h from orders)"


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("e"))


VECTORS = "(select vec_id, label, embedding::double[] as e from embeddings)"


def pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A 4 x 4 picture of three channels from the first 48 values."""
    return vectors(spark, sf_dir).select("vec_id", F.transform(F.slice("e", 1, 48), lambda v: F.floor((v + 1) * 127.5).cast("int")).alias("p"))


PICTURES = "(select vec_id, [floor((v + 1) * 127.5)::int for v in e[1:48]] as p from " + VECTORS + ")"


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors of [8, 8] tensors with centre boxes in pixels, their score and class."""
    rows = detect.with_class(detect.anchors(vectors(spark, sf_dir), "e", 8, 8))
    return rows.select("vec_id", F.col("label").alias("image"), "i", "score", "class_id", (320 + 640 * F.col("cx")).alias("cx"), (320 + 640 * F.col("cy")).alias("cy"), (F.abs("w") * 1200).alias("w"), (F.abs("h") * 1200).alias("h"))


BOXES = f"""(
  select vec_id, label as image, i::int as i, greatest(0.0, list_max(s)) as score,
    (case when list_max(s) > 0 then list_position(s, list_max(s)) - 1 else 0 end)::int as class_id,
    320 + 640 * e[i + 1] as cx, 320 + 640 * e[8 + i + 1] as cy, abs(e[16 + i + 1]) * 1200 as w, abs(e[24 + i + 1]) * 1200 as h
  from (select *, [e[(4 + c) * 8 + i + 1] for c in range(4)] as s from {VECTORS}, unnest(range(8)) as u(i))
)"""


def rects(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = boxes(spark, sf_dir)
    whole = lambda x: F.round(x).cast("bigint")
    return detect.confident(b, CONF).select("image", "vec_id", "i", "score", "class_id", whole(F.col("cx") - F.col("w") / 2).alias("x"), whole(F.col("cy") - F.col("h") / 2).alias("y"), whole(F.col("w")).alias("w"), whole(F.col("h")).alias("h"))


RECTS = f"""(
  select image, vec_id, i, score, class_id, round(cx - w / 2)::bigint as x, round(cy - h / 2)::bigint as y, round(w)::bigint as w, round(h)::bigint as h
  from {BOXES} where score >= {CONF}
)"""

# --- sources and configuration


@query()
def src1_image_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every picture as a PNG file, read back by the image source."""
    rows = pictures(spark, sf_dir)
    folder = f"{_scratch(spark)}/images"
    images.write_png_files(rows.select("vec_id", as_image(F.col("p"), 4, 4).alias("image")), "vec_id", "image", folder)
    found = images.require_decoded(images.read_images(spark, folder, skip_broken=True)).select("image.*")
    return found.select(F.regexp_extract("origin", r"(\d+)\.png$", 1).cast("bigint").alias("vec_id"), "height", "width", "nChannels", "mode", F.hex("data").alias("pixels"))


ORACLES["src1_image_scan"] = f"""
select vec_id, 4 as height, 4 as width, 3 as nChannels, 16 as mode,
  array_to_string([format('{{:02X}}', x) for x in p], '') as pixels from {PICTURES}
"""


@query(f"select vec_id as number, 4 as height, 4 as width, array_to_string([format('{{:02X}}', x) for x in p], '') as pixels from {PICTURES}")
def src2_frame_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of a container as a stream of several triggers: numbers and pixels."""
    at, rows = _scratch(spark), picture_images(spark, sf_dir)
    frames.write_frames(rows, f"{at}/frames", "vec_id", "image")
    seen = frames.stream_frames(spark, f"{at}/frames", max(1, rows.count() // 3)).select("number", "height", "width", F.hex("data").alias("pixels"))
    schedule.drain_triggers(seen, f"{at}/out", f"{at}/checkpoint")
    return spark.read.parquet(f"{at}/out")


def as_image(p: Column, height: int, width: int) -> Column:
    """An image struct of values 0 to 255."""
    data = F.unhex(F.array_join(F.transform(p, lambda x: F.lpad(F.hex(x), 2, "0")), ""))
    return F.struct(F.lit(None).cast("string").alias("origin"), F.lit(height).alias("height"), F.lit(width).alias("width"), F.lit(3).alias("nChannels"), F.lit(images.BGR).alias("mode"), data.alias("data"))


# Configurations come as texts, one for each part; they are read on the executors, a batch of rows at a time.


def part_key() -> Column:
    return F.col("p_partkey")


def settings(spark: SparkSession, sf_dir: str, text: Column, read_one: Callable[[str], list[tuple]], fields: str) -> DataFrame:
    """(p_partkey, fields) for each tuple that ``read_one`` makes of a part's text.

    Reading takes far longer than the few bytes of a row tell, so parts are dealt to all tasks of the session however few files they come in.
    Equal texts of a batch are read once.
    """

    def run(batches):
        for pdf in batches:
            known = {x: read_one(x) for x in pdf["text"].unique()}
            rows = [(key, *row) for key, x in zip(pdf["p_partkey"].tolist(), pdf["text"]) for row in known[x]]
            yield pd.DataFrame(rows, columns=["p_partkey", *(f.split(" ")[0] for f in fields.split(", "))])

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = read(spark, sf_dir, "part").select("p_partkey").repartition(tasks, "p_partkey")
    return parts.select("p_partkey", text.alias("text")).mapInPandas(run, f"p_partkey long, {fields}")


@query("""
select p_partkey, m as mode, (p_partkey % 9 + 1)::int as concurrent_clients, 10.0::double as test_duration_sec, (case when p_partkey % 2 = 0 then p_partkey % 40 + 1 else 50 end)::int as min_iterations,
  (case m when 'batch' then p_partkey % 16 + 1 else 1 end)::int as batch, case m when 'sync' then 1 when 'async' then 4 else 16 end::int as buffer_size, -1 as warm_up
from part, (select unnest(['sync', 'async', 'batch']) as m)
""")
def src5_benchmark_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Defaults, anchors and merge keys: three rows for each text, one for each mode."""

    def modes(text: str) -> list[tuple]:
        c = benchmark_config({k: v for k, v in parse_yaml(text).items() if k != "base"})
        return [(m, c.concurrent_clients, c.test_duration_sec, c.min_iterations, o.batch, o.buffer_size, o.warm_up) for m, o in (("sync", c.sync_override), ("async", c.async_override), ("batch", c.batch_override))]

    shared = "base: &base {batch: 1, buffer_size: 4}\nsync_override: {<<: *base, buffer_size: 1}\nasync_override: *base\n"
    own = F.when(part_key() % 2 == 0, F.format_string("\nmin_iterations: %d", part_key() % 40 + 1)).otherwise("")
    text = F.concat(F.lit(shared), F.format_string("batch_override: {<<: *base, batch: %d, buffer_size: 16}\nconcurrent_clients: %d", part_key() % 16 + 1, part_key() % 9 + 1), own)
    return settings(spark, sf_dir, text, modes, "mode string, concurrent_clients int, test_duration_sec double, min_iterations int, batch int, buffer_size int, warm_up int")


@query("""
select p_partkey, 'm' || p_partkey || '.onnx' as path, 'onnxruntime' as backend, (32 * (p_partkey % 10 + 1))::int as height, (32 * (p_partkey % 7 + 1))::int as width, (case when p_partkey % 3 = 0 then p_partkey % 64 + 1 else 1 end)::int as batch,
  4 as buffer_size, 0 as warm_up, ['person', 'c' || p_partkey] as classes, case when p_partkey % 5 = 0 then 'ORT_PARALLEL' end as execution_mode, case when p_partkey % 2 = 0 then 0.5 else 0.25 end::double as conf, 0.45::double as nms, 300 as max_detections,
  p_partkey % 2 <> 0 as auto_aspect_ratio, case when p_partkey % 2 = 0 then [0, 10, (p_partkey % 256)::int] else [114, 114, 114] end as pad_color, true as bgr_to_rgb from part
""")
def src4_model_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model's configuration: what is given, and defaults for the rest."""

    def one(text: str) -> list[tuple]:
        c = model_config(parse_yaml(text))
        return [(c.path, c.backend, *c.shape, c.batch, c.buffer_size, c.warm_up, list(c.classes), c.session_options.get("execution_mode"), c.conf, c.nms, c.max_detections, c.auto_aspect_ratio, list(c.pad_color), c.bgr_to_rgb)]

    given = lambda every, text, *x: F.when(part_key() % every == 0, F.format_string(text, *x)).otherwise("")
    text = F.concat(
        F.format_string("model:\n  path: m%d.onnx\n  shape: [%d, %d]\n  classes: [person, c%d]\n", part_key(), 32 * (part_key() % 10 + 1), 32 * (part_key() % 7 + 1), part_key()),
        given(3, "  batch: %d\n", part_key() % 64 + 1), given(5, "  session_options: {execution_mode: ORT_PARALLEL}\n"), given(2, "preprocess: {auto_aspect_ratio: false, pad_color: [0, 10, %d]}\npostprocess: {conf: 0.5}\n", part_key() % 256),
    )
    return settings(spark, sf_dir, text, one, "path string, backend string, height int, width int, batch int, buffer_size int, warm_up int, classes array<string>, execution_mode string, conf double, nms double, max_detections int, auto_aspect_ratio boolean, pad_color array<int>, bgr_to_rgb boolean")


@query("""
select p_partkey, case when p_partkey % 2 = 0 then 'batch' else 'all' end as mode, (case when p_partkey % 2 = 0 then p_partkey % 9 + 1 else 8 end)::int as concurrent_clients, case when p_partkey % 2 = 0 then 2.5 else 10.0 end::double as test_duration_sec, 50 as min_iterations, 5 as warmup_count,
  case when p_partkey % 2 = 0 then 'resnet' else 'yolo' end as model_type, p_partkey % 2 <> 0 as export_json, true as export_csv, 16 as batch_buffer_size from part
""")
def src10_arguments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Command line over file over default: with arguments of its own, and with the file alone."""
    file = {"concurrent_clients": 8, "batch_override": {"batch": 8, "buffer_size": 16}}

    def one(text: str) -> list[tuple]:
        c = from_arguments(["--config", "b.yaml", *text.split()], lambda path: file)
        return [(c.mode, c.concurrent_clients, c.test_duration_sec, c.min_iterations, c.warmup_count, c.model_type, c.export_json, c.export_csv, c.batch_override.buffer_size)]

    own = F.format_string("--mode batch --clients %d --duration 2.5 --model resnet --no-json", part_key() % 9 + 1)
    return settings(spark, sf_dir, F.when(part_key() % 2 == 0, own).otherwise(""), one, "mode string, concurrent_clients int, test_duration_sec double, min_iterations int, warmup_count int, model_type string, export_json boolean, export_csv boolean, batch_buffer_size int")


PARSERS = {"backend": (parse_backend, BACKENDS), "execution": (parse_execution_mode, EXECUTION_MODES), "graph": (parse_graph_level, GRAPH_LEVELS), "log": (parse_log_level, LOG_LEVELS)}
NAMES = [f"{kind}:{name}" for kind, (_, names) in PARSERS.items() for name in (*names, "other")]


@query(f"select p_partkey, split_part(x, ':', 1) as kind, split_part(x, ':', 2) as name, split_part(x, ':', 2) <> 'other' as known from (select p_partkey, {NAMES}[p_partkey % {len(NAMES)} + 1] as x from part)")
def prj26_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that a configuration may use; an unknown one is refused."""

    def one(text: str) -> list[tuple]:
        kind, name = text.split(":")
        try:
            PARSERS[kind][0](name)
        except ValueError:
            return [(kind, name, False)]
        return [(kind, name, True)]

    return settings(spark, sf_dir, F.array(*map(F.lit, NAMES))[(part_key() % len(NAMES)).cast("int")], one, "kind string, name string, known boolean")


@query("""
select avg(try_cast(trim(split_part(line, ',', 1)) as double)) as gpu_avg, avg(try_cast(trim(split_part(line, ',', 2)) as double)) as memory_avg
from (select (event_id % 101)::varchar || ', ' || (user_id % 37)::varchar as line from events)
""")
def src9_utilization(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Polled utilization lines: parsed, then averaged."""
    line = F.concat((F.col("event_id") % 101).cast("string"), F.lit(", "), (F.col("user_id") % 37).cast("string"))
    return reports.utilization(read(spark, sf_dir, "events").select(line.alias("value")))


# --- projections: geometry


def _letterbox(spark: SparkSession, sf_dir: str, auto: bool) -> DataFrame:
    boxed = sizes(spark, sf_dir).withColumn("g", geometry.letterbox(F.col("w"), F.col("h"), 640, 640, auto))
    return boxed.select("o_orderkey", F.round(F.col("g.scale").cast("double"), 6).alias("scale"), *[f"g.{c}" for c in ("new_w", "new_h", "pad_left", "pad_top", "pad_right", "pad_bottom", "error")])


def _letterbox_sql(auto: bool) -> str:
    first = f"select *, least((640::double / w)::float, (640::double / h)::float) as s0 from {SIZES}"
    if auto:
        first = f"select *, round((w::double * s0)::float)::int as a, round((h::double * s0)::float)::int as b from ({first})"
        first = f"select o_orderkey, w, h, least(((a - a % 32)::double / w)::float, ((b - b % 32)::double / h)::float) as s0 from ({first})"
    return f"""
    select o_orderkey, round(s0::double, 6) as scale, new_w, new_h, floor((640 - new_w) / 2.0)::int as pad_left, floor((640 - new_h) / 2.0)::int as pad_top,
      (640 - new_w - floor((640 - new_w) / 2.0)::int)::int as pad_right, (640 - new_h - floor((640 - new_h) / 2.0)::int)::int as pad_bottom,
      case when new_w = 0 or new_h = 0 then 'image collapses' end as error
    from (select o_orderkey, s0, round((w::double * s0)::float)::int as new_w, round((h::double * s0)::float)::int as new_h from ({first}))
    """


@query(_letterbox_sql(True))
def prj1_letterbox_auto(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _letterbox(spark, sf_dir, True)


@query(_letterbox_sql(False))
def prj1_letterbox_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _letterbox(spark, sf_dir, False)


@query(f"""
select o_orderkey, case when w <= 576 and h <= 576 then (576 - w) // 2 end as pad_left, case when w <= 576 and h <= 576 then (576 - h) // 2 end as pad_top,
  case when w <= 576 and h <= 576 then 576 - w - (576 - w) // 2 end as pad_right, case when w <= 576 and h <= 576 then 576 - h - (576 - h) // 2 end as pad_bottom,
  case when not (w <= 576 and h <= 576) then 'target is smaller than the image' end as error from {SIZES}
""")
def prj3_center_pad(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sizes(spark, sf_dir).select("o_orderkey", geometry.center_pad(F.col("w"), F.col("h"), 576, 576).alias("g")).select("o_orderkey", "g.*")


@query(f"select o_orderkey, (w * round((256::double / least(w, h))::float)::int)::int as new_w, (h * round((256::double / least(w, h))::float)::int)::int as new_h from {SIZES}")
def prj8_resize_legacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sizes(spark, sf_dir).select("o_orderkey", geometry.resize_shorter(F.col("w"), F.col("h"), legacy=True).alias("g")).select("o_orderkey", "g.*")


RESIZED = f"(select o_orderkey, round((w::double * (256::double / least(w, h))::float)::float)::int as new_w, round((h::double * (256::double / least(w, h))::float)::float)::int as new_h from {SIZES})"


@query(f"select * from {RESIZED}")
def prj8_resize_true(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sizes(spark, sf_dir).select("o_orderkey", geometry.resize_shorter(F.col("w"), F.col("h")).alias("g")).select("o_orderkey", "g.*")


@query(f"""
select o_orderkey, case when w >= 224 and h >= 224 then (w - 224) // 2 end as "left", case when w >= 224 and h >= 224 then (h - 224) // 2 end as "top",
  case when not (w >= 224 and h >= 224) then 'image is smaller than the crop' end as error from {SIZES}
""")
def prj9_center_crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sizes(spark, sf_dir).select("o_orderkey", geometry.center_crop(F.col("w"), F.col("h")).alias("g")).select("o_orderkey", "g.*")


@query(f"select o_orderkey, greatest(w, h) as square, round((greatest(w, h)::double / 640)::float::double, 6) as factor from {SIZES}")
def prj11_square_pad(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = sizes(spark, sf_dir).select("o_orderkey", geometry.square_pad(F.col("w"), F.col("h")).alias("g"))
    return g.select("o_orderkey", "g.square", F.round(F.col("g.factor").cast("double"), 6).alias("factor"))


# --- projections: tensors


@query(f"select vec_id, [p[j - j % 3 + 2 - j % 3 + 1] for j in range(48)] as rgb from {PICTURES}")
def prj4_swap_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pictures(spark, sf_dir).select("vec_id", tensor.swap_channels(F.col("p"), 16).alias("rgb"))


@query(f"select vec_id, [round((x * (1.0::double / 255))::float::double, 6) for x in p] as scaled from {PICTURES}")
def prj5_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pictures(spark, sf_dir).select("vec_id", F.transform(tensor.normalize(F.col("p")), lambda x: F.round(x.cast("double"), 6)).alias("scaled"))


@query(f"select vec_id, [p[(j % 16) * 3 + (2 - j // 16) + 1] for j in range(48)] as planes from {PICTURES}")
def prj6_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pictures(spark, sf_dir).select("vec_id", tensor.hwc_to_chw(F.col("p"), 16).alias("planes"))


@query(f"""
select vec_id, [round((p[(j % 16) * 3 + (2 - j // 16) + 1]::double / 255 - [0.485, 0.456, 0.406][j // 16 + 1]::double) / [0.229, 0.224, 0.225][j // 16 + 1]::double, 6) for j in range(48)] as blob
from {PICTURES}
""")
def prj10_standardize(spark: SparkSession, sf_dir: str) -> DataFrame:
    from framewright.operators.runners import MEAN, STD

    planes = tensor.hwc_to_chw(F.col("p"), 16)
    return pictures(spark, sf_dir).select("vec_id", F.transform(tensor.standardize(planes, 16, MEAN, STD), lambda x: F.round(x, 6)).alias("blob"))


@query(f"select vec_id, [floor(greatest(0.0, least(1.0, v * 4)) * 255 + 0.5)::int for v in e] as u8 from {VECTORS}")
def prj12_denormalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).select("vec_id", tensor.denormalize(F.transform("e", lambda v: v * 4)).alias("u8"))


@query(f"select vec_id, [p[(2 - j % 3) * 16 + ((j // 3) // 2 + 1) * 4 + (j // 3) % 2 + 1 + 1] for j in range(18)] as bgr from {PICTURES}")
def prj13_unpad_crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A window of 3 rows and 2 columns out of planes of 4 x 4."""
    return pictures(spark, sf_dir).select("vec_id", tensor.crop_to_hwc(F.col("p"), 4, 4, 1, 1, 3, 2).alias("bgr"))


@query(f"select vec_id, e[33:48] as item from {VECTORS}")
def prj14_batch_item(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).select("vec_id", tensor.batch_item(F.col("e"), 2, 16).alias("item"))


@query(f"select vec_id, i::int as i, e[i + 1] as cx, e[8 + i + 1] as cy, e[16 + i + 1] as w, e[24 + i + 1] as h from {VECTORS}, unnest(range(8)) as u(i)")
def prj15_anchor_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.anchors(vectors(spark, sf_dir), "e", 8, 8).select("vec_id", "i", "cx", "cy", "w", "h")


@query(f"select vec_id, [e[(j % 8) * 8 + j // 8 + 1] for j in range(64)] as t from {VECTORS}")
def prj16_transpose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).select("vec_id", tensor.transpose(F.col("e"), 8, 8).alias("t"))


def decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes back in an original image of 600 x 500 that stood in the box at half scale with 10 and 20 pixels of padding."""
    box = geometry.decode_corners(F.col("cx"), F.col("cy"), F.col("w"), F.col("h"), F.lit(0.5), F.lit(10), F.lit(20), F.lit(600), F.lit(500))
    return boxes(spark, sf_dir).select("vec_id", "i", "score", box.alias("b"))


DECODED = f"""(
  select vec_id, i, score, greatest(0.0, least(600.0, (cx - 0.5 * w - 10) / 0.5))::double as x1, greatest(0.0, least(500.0, (cy - 0.5 * h - 20) / 0.5))::double as y1,
    greatest(0.0, least(600.0, (cx + 0.5 * w - 10) / 0.5))::double as x2, greatest(0.0, least(500.0, (cy + 0.5 * h - 20) / 0.5))::double as y2 from {BOXES}
)"""


@query(f"select vec_id, i, round(x1, 6) as x1, round(y1, 6) as y1, round(x2, 6) as x2, round(y2, 6) as y2 from {DECODED}")
def prj17_box_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decoded(spark, sf_dir).select("vec_id", "i", *[F.round(f"b.{c}", 6).alias(c) for c in ("x1", "y1", "x2", "y2")])


@query(f"select vec_id, i, round(x1)::int as x, round(y1)::int as y, round(x2 - x1)::int as w, round(y2 - y1)::int as h from {DECODED}")
def prj18_box_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decoded(spark, sf_dir).select("vec_id", "i", geometry.to_rect(F.col("b")).alias("r")).select("vec_id", "i", "r.*")


@query(f"select vec_id, i, trunc(x1)::int as x, trunc(y1)::int as y, trunc(x2 - x1)::int as w, trunc(y2 - y1)::int as h from {DECODED}")
def prj19_box_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decoded(spark, sf_dir).select("vec_id", "i", geometry.to_rect(F.col("b"), truncate=True).alias("r")).select("vec_id", "i", "r.*")


@query(f"select vec_id, i, trunc((cx - 0.5 * w) * 1.5)::int as x, trunc((cy - 0.5 * h) * 0.75)::int as y, trunc(w * 1.5)::int as w, trunc(h * 0.75)::int as h from {BOXES}")
def prj20_prototype_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = geometry.prototype_rect(F.col("cx"), F.col("cy"), F.col("w"), F.col("h"), F.lit(1.5), F.lit(0.75))
    return boxes(spark, sf_dir).select("vec_id", "i", r.alias("r")).select("vec_id", "i", "r.*")


@query(f"select vec_id, i, class_id, {LABELS}[class_id + 1] as label from {BOXES}")
def prj21_class_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.with_label(boxes(spark, sf_dir).select("vec_id", "i", "class_id"), LABELS)


@query("""
with s as (select p_partkey, [1, case when p_partkey % 3 = 0 then 3 else p_partkey % 7 end, case when p_partkey % 5 = 0 then 0 else 320 end, case when p_partkey % 2 = 0 then 3 else 320 end]::bigint[] as shape from part)
select p_partkey, case when shape[2] in (1, 3, 4) then [shape[1], shape[2], case when shape[3] <> 0 then 640 else shape[3] end, case when shape[3] <> 0 then 512 else shape[4] end]
  when shape[4] in (1, 3, 4) then [shape[1], shape[4], case when shape[2] <> 0 then 640 else shape[2] end, case when shape[2] <> 0 then 512 else shape[3] end] end as input_shape from s
""")
def prj22_input_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    shape = F.array(F.lit(1), F.when(k % 3 == 0, 3).otherwise(k % 7), F.when(k % 5 == 0, 0).otherwise(320), F.when(k % 2 == 0, 3).otherwise(320)).cast("array<bigint>")
    rows = read(spark, sf_dir, "part").select("p_partkey", shape.alias("shape"))
    return rows.select("p_partkey", tensor.layout(F.col("shape"), 640, 512).alias("input_shape"))


SHAPES = "(select vec_id, [vec_id % 5 + 1, 3, label + 1, 8]::bigint[] as shape from embeddings)"


@query(f"select vec_id, list_product(shape)::bigint as elements, (list_product(shape) / shape[1])::bigint as plane, (4 * list_product(shape))::bigint as bytes from {SHAPES}")
def prj23_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings").select("vec_id", F.array(F.col("vec_id") % 5 + 1, F.lit(3), F.col("label") + 1, F.lit(8)).cast("array<bigint>").alias("shape"))
    s = F.col("shape")
    return rows.select("vec_id", tensor.elements(s).alias("elements"), tensor.plane_size(s).alias("plane"), tensor.byte_size(s).alias("bytes"))


@query("select vec_id, embedding as data, [8, 8]::bigint[] as shape from embeddings")
def prj24_tensor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select("vec_id", tensor.tensor(F.col("embedding"), F.array(F.lit(8), F.lit(8))).alias("t")).select("vec_id", "t.*")


@query("select vec_id, embedding as primary_data, true as has_logits, false as has_boxes from embeddings")
def prj25_named_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outputs by name; the primary one is named, never the first of a map."""
    out = F.create_map(F.lit("logits"), tensor.tensor(F.col("embedding"), F.array(F.lit(64))))
    rows = read(spark, sf_dir, "embeddings").select("vec_id", out.alias("o"))
    return rows.select("vec_id", F.col("o")["logits"]["data"].alias("primary_data"), F.map_contains_key("o", "logits").alias("has_logits"), F.map_contains_key("o", "boxes").alias("has_boxes"))


# --- pixels and models


def picture_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pictures(spark, sf_dir).select("vec_id", as_image(F.col("p"), 4, 4).alias("image"))


@query(f"""
select vec_id, [round((case when (j % 64) // 8 in (0, 1, 6, 7) or (j % 64) % 8 in (0, 1, 6, 7) then 114 else p[(((j % 64) // 8 - 2) * 4 + (j % 64) % 8 - 2) * 3 + 2 - j // 64 + 1] end * (1.0::double / 255))::float::double, 5) for j in range(192)] as planes
from {PICTURES}
""")
def prj7_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Padding to 8 x 8, channels reversed, scaled, as planes: one numpy pass."""
    got = pixels.preprocess(picture_images(spark, sf_dir), "vec_id", "image", lambda x: pixels.pad_to(x, 8, 8))
    return got.select("vec_id", F.transform("data", lambda v: F.round(v.cast("double"), 5)).alias("planes"))


#: (vec_id, c, y, x, v): the pictures enlarged to 8 x 8, with half-pixel centres and clamped edges; c counts channels from red.
ENLARGED = f"""(
  select vec_id, c, y, x, floor((p[(y0 * 4 + x0) * 3 + 3 - c] * (1 - fx) + p[(y0 * 4 + x1) * 3 + 3 - c] * fx) * (1 - fy) + (p[(y1 * 4 + x0) * 3 + 3 - c] * (1 - fx) + p[(y1 * 4 + x1) * 3 + 3 - c] * fx) * fy + 0.5)::int as v
  from {PICTURES}, (
    select c, y, x, floor(ay)::int as y0, least(3, floor(ay)::int + 1) as y1, ay - floor(ay) as fy, floor(ax)::int as x0, least(3, floor(ax)::int + 1) as x1, ax - floor(ax) as fx
    from (select c, y, x, least(3, greatest(0, (y + 0.5) * 0.5 - 0.5)) as ay, least(3, greatest(0, (x + 0.5) * 0.5 - 0.5)) as ax from unnest(range(3)) a(c), unnest(range(8)) b(y), unnest(range(8)) d(x)))
)"""


@query(f"""
select g.vec_id, list(coalesce(v, 114)::int order by g.c, g.y, g.x) as planes
from (select vec_id, c, y, x from embeddings, unnest(range(3)) a(c), unnest(range(8)) b(y), unnest(range(12)) d(x)) g
left join {ENLARGED} e on e.vec_id = g.vec_id and e.c = g.c and e.y = g.y and e.x = g.x - 2 group by g.vec_id
""")
def prj2_letterbox_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Enlarged by bilinear interpolation into a wider box, padded left and right: every value of all three planes."""
    got = pixels.preprocess(picture_images(spark, sf_dir), "vec_id", "image", lambda x: pixels.letterbox(x, 12, 8, auto=False))
    return got.select("vec_id", F.transform("data", lambda v: F.round(v * 255).cast("int")).alias("planes"))


@query(f"select vec_id, 4 as height, 4 as width, p as pixels from {PICTURES}")
def restore_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Padded, through an identity model, clamped, cut out again: the picture itself."""
    runner = runners.Restorer(ModelConfig("identity", shape=(8, 8), batch=64), onnx_models.identity([3, 8, 8]), "y", "vec_id")
    got = runner.run(picture_images(spark, sf_dir))
    byte = lambda i: F.conv(F.substring(F.hex("data"), 2 * i + 1, 2), 16, 10).cast("int")
    return got.select("vec_id", "height", "width", F.array(*[byte(i) for i in range(48)]).alias("pixels"))


#: Weights in eighths and inputs in 256ths: the model's 32-bit sums are exact.
WEIGHTS = [[((i * 7 + j * 3) % 11 - 5) / 8 for j in range(4)] for i in range(64)]
LOGITS = f"(select vec_id, [list_sum([floor(e[i + 1] * 256) / 256 * (((i * 7 + j * 3) % 11 - 5) / 8.0::double) for i in range(64)]) for j in range(4)] as logits from {VECTORS})"


def logits(spark: SparkSession, sf_dir: str, batch: int = 64, model: bytes | None = None) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda v: (F.floor(v * 256) / 256).cast("float")).alias("x"))
    return infer.infer(rows, "vec_id", "x", (64,), model or onnx_models.linear(WEIGHTS), "logits", batch)


FOUR_LOGITS = f"select vec_id, logits[1] + 0.0 as logit_0, logits[2] + 0.0 as logit_1, logits[3] + 0.0 as logit_2, logits[4] + 0.0 as logit_3, null::varchar as error from {LOGITS}"


def four_logits(rows: DataFrame) -> DataFrame:
    return rows.select("vec_id", *[(F.col("logits")[j].cast("double") + 0.0).alias(f"logit_{j}") for j in range(4)], "error")


@query(FOUR_LOGITS)
def udf6_linear_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every logit to its last bit; a negative zero is a zero."""
    return four_logits(logits(spark, sf_dir))


HEADS = {"scores": WEIGHTS, "box": [[((i * 5 + j * 7) % 9 - 4) / 8 for j in range(2)] for i in range(64)]}


@query(f"""
select vec_id, [l[1] + 0.0, l[2] + 0.0, l[3] + 0.0, l[4] + 0.0] as scores, [4] as scores_shape, [b[1] + 0.0, b[2] + 0.0] as box, [2] as box_shape from (
  select vec_id, logits as l, [list_sum([floor(e[i + 1] * 256) / 256 * (((i * 5 + j * 7) % 9 - 4) / 8.0::double) for i in range(64)]) for j in range(2)] as b from {LOGITS} join {VECTORS} using (vec_id))
""")
def udf5_named_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model with two outputs runs once and gives both by name, with their shapes."""
    rows = read(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda v: (F.floor(v * 256) / 256).cast("float")).alias("x"))
    got = infer.infer(rows, "vec_id", "x", (64,), onnx_models.heads(HEADS), ("scores", "box"))
    plain = lambda c: F.transform(F.col(c)["data"], lambda v: v.cast("double") + 0.0)
    return got.select("vec_id", *[x for c in HEADS for x in (plain(c).alias(c), F.col(c)["shape"].cast("array<int>").alias(f"{c}_shape"))])


@query(FOUR_LOGITS)
def str6_partial_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of 61: the rest of every partition is a smaller batch, and all its rows are delivered."""
    return four_logits(logits(spark, sf_dir, 61))


@query(FOUR_LOGITS)
def src7_optimized_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The optimized copy beside a model file is read in its place and gives the same logits."""
    with tempfile.TemporaryDirectory() as folder:  # the driver's own; workers get bytes
        path = f"{folder}/m.onnx"
        with open(path, "wb") as f:
            f.write(onnx_models.linear(WEIGHTS))
        infer.write_optimized(path)
        model = infer.read_model(path)
    return four_logits(logits(spark, sf_dir, model=model))


@query("select distinct label, 'logits' as output, [(label + 1)::int] as shape from embeddings")
def str11_warm_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each label has a model with as many outputs as it says; three runs on zeros before serving tell the shape of one item of each output."""

    def warm(pdf: pd.DataFrame) -> pd.DataFrame:
        label = int(pdf["label"].iloc[0])
        shapes = infer.OnnxBackend(onnx_models.linear([[1.0] * (label + 1)] * 64)).warm_up((64,), 3)
        return pd.DataFrame([(label, name, list(shape)) for name, shape in shapes.items()], columns=["label", "output", "shape"])

    return read(spark, sf_dir, "embeddings").select("label").distinct().groupBy("label").applyInPandas(warm, "label int, output string, shape array<int>")


@query(f"select vec_id, (list_position(logits, list_max(logits)) - 1)::int as class_id, {LABELS}[list_position(logits, list_max(logits))] as label from {LOGITS}")
def classify_end_to_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors through a model to labels."""
    return detect.with_label(logits(spark, sf_dir).select("vec_id", tensor.argmax(F.col("logits")).alias("class_id")), LABELS)


PLANE_WEIGHTS = [[((n * 7 + j * 3) % 11 - 5) / 10 for j in range(4)] for n in range(147)]


@query(f"""
with m as (select [{", ".join(map(str, runners.MEAN))}] as mean, [{", ".join(map(str, runners.STD))}] as std),
v as (select vec_id, c * 49 + y * 7 + x as n, (v / 255.0::double - mean[c + 1]) / std[c + 1] as v from {ENLARGED}, m where y < 7 and x < 7),
l as (select vec_id, j, sum(v * (((n * 7 + j * 3) % 11 - 5) / 10.0::double)) as logit from v, unnest(range(4)) u(j) group by vec_id, j)
select vec_id, arg_max(j, logit)::int as class_id, {LABELS}[arg_max(j, logit) + 1] as label, null::varchar as error from l group by vec_id
""")
def classify_images_end_to_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures to labels: resized to the shorter side, cropped, standardized planes, a model, the best class."""
    runner = runners.Classifier(ModelConfig("linear", shape=(7, 7), classes=tuple(LABELS), batch=64), onnx_models.linear_over_planes(PLANE_WEIGHTS, [3, 7, 7]), "y", "vec_id")
    return runner.run(picture_images(spark, sf_dir)).select("vec_id", "class_id", "label", "error")


@query(f"select count(*) as n, count(*) filter (list_max(logits) > 0) as positive from {LOGITS}")
def str5_batch_size_equivalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model in batches of 8 and of 64 gives the same rows."""
    one, other = logits(spark, sf_dir, 8), logits(spark, sf_dir, 64).withColumnRenamed("logits", "again").drop("error")
    top = F.array_max("logits")
    near = F.forall(F.zip_with("logits", "again", lambda a, b: F.abs(a - b)), lambda d: d < 1e-5)
    return one.join(other, "vec_id").where(near).agg(F.count("*").alias("n"), F.count_if(top > 0).alias("positive"))


MIXED = [(4, 4), (2, 8), (5, 3), (1, 21)]


@query(f"select [3, h, w] as shape, count(*) as n, true as all_same, true as full_but_one from (select vec_id, {[h for h, _ in MIXED]}[vec_id % 4 + 1] as h, {[w for _, w in MIXED]}[vec_id % 4 + 1] as w from embeddings) group by h, w")
def str5_mixed_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures of four shapes through one model in batches of 16: the same values come back, and a partition has one partial batch at most of each shape."""
    kind = (F.col("vec_id") % len(MIXED)).cast("int")
    shape = F.array(*[F.array(F.lit(3), F.lit(h), F.lit(w)) for h, w in MIXED])[kind]
    rows = read(spark, sf_dir, "embeddings").select("vec_id", shape.alias("shape"), F.slice("embedding", F.lit(1), shape[0] * shape[1] * shape[2]).alias("x"))
    got = infer.infer(rows, "vec_id", "x", "shape", onnx_models.identity([3, "h", "w"]), "y", 16, keep=("x", "shape"), number="batch").withColumn("partition", F.spark_partition_id())
    each = got.groupBy("partition", "batch", "shape").agg(F.count("*").alias("n"), F.every(F.col("y") == F.col("x")).alias("same"))
    of = each.groupBy("partition", "shape").agg(F.sum("n").alias("n"), F.every("same").alias("same"), F.count_if(F.col("n") < 16).alias("partial"))
    return of.groupBy("shape").agg(F.sum("n").alias("n"), F.every("same").alias("all_same"), F.every(F.col("partial") <= 1).alias("full_but_one"))


# --- filters, aggregates, joins, suppression over anchors


@query(f"select vec_id, i, round(score, 6) as score, class_id from {BOXES}")
def agg1_anchor_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boxes(spark, sf_dir).select("vec_id", "i", F.round("score", 6).alias("score"), "class_id")


@query(f"select vec_id, (list_position(e, list_max(e)) - 1)::int as class_id from {VECTORS}")
def agg2_classify_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).select("vec_id", tensor.argmax(F.col("e")).alias("class_id"))


@query(f"select vec_id, i, class_id from {BOXES} where score >= 0.25")
def flt1_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.confident(boxes(spark, sf_dir), 0.25).select("vec_id", "i", "class_id")


@query(f"select vec_id, i, class_id from {BOXES} where score > 0.25")
def flt1b_confidence_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.confident(boxes(spark, sf_dir), 0.25, strict=True).select("vec_id", "i", "class_id")


@query(f"select vec_id, i from {DECODED} where not (x2 <= x1 or y2 <= y1)")
def flt2_degenerate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decoded(spark, sf_dir).where(~geometry.degenerate(F.col("b"))).select("vec_id", "i")


@query("select vec_id, case when vec_id % 4 <> 0 then 'expected three dimensions' when vec_id % 8 <> 0 then 'shape and data differ in size' end as error, case when vec_id % 8 = 0 then 64 end::bigint as value from embeddings")
def flt3_tensor_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two dimensions, or three of the wrong size, are errors."""
    wide = F.array(F.lit(1), F.lit(8), F.when(F.col("vec_id") % 8 == 0, 8).otherwise(7))
    shape = F.when(F.col("vec_id") % 4 == 0, wide).otherwise(F.array(F.lit(8), F.lit(8)))
    rows = read(spark, sf_dir, "embeddings").select("vec_id", shape.alias("shape"), "embedding")
    return schedule.guarded(rows, tensor.elements(F.col("shape")), detect.valid_tensor(F.col("shape"), F.col("embedding"))).select("vec_id", "error", "value")


@query(f"""
select image, vec_id, i, class_id from (select *, row_number() over (partition by image order by score desc, vec_id, i) as r from {BOXES} where score >= {CONF}) where r <= 100
""")
def flt5_filter_and_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best class, threshold and a deterministic cap in one pass."""
    return detect.top_detections(detect.confident(boxes(spark, sf_dir), CONF), "image", ["vec_id", "i"], 100).select("image", "vec_id", "i", "class_id")


@query(f"select vec_id, i from {BOXES} where score >= {CONF} and score > {CONF}")
def flt6_refilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The threshold asked for twice, the second time strictly."""
    return detect.confident(detect.confident(boxes(spark, sf_dir), CONF), CONF, strict=True).select("vec_id", "i")


@query(f"select vec_id, least(5, count(*) filter (score >= {CONF}))::int as kept from {BOXES} group by vec_id")
def flt7_count_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = boxes(spark, sf_dir).groupBy("vec_id").agg(F.count_if(F.col("score") >= CONF).cast("int").alias("n"))
    return counted.select("vec_id", detect.clamp_count(F.col("n"), 5).cast("int").alias("kept"))


@query(f"select image, vec_id, i from (select *, row_number() over (partition by image order by score desc, vec_id, i) as r from {BOXES} where score >= {CONF}) where r <= 30")
def top3_max_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.top_detections(detect.confident(boxes(spark, sf_dir), CONF), "image", ["vec_id", "i"], 30).select("image", "vec_id", "i")


@query(f"select image, vec_id, i from {RECTS}")
def top4_no_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rects(spark, sf_dir).select("image", "vec_id", "i")


@query(f"select vec_id, [e[1:8], e[9:16]][1] as first_item from {VECTORS}")
def top5_first_item(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).select("vec_id", F.element_at(F.array(F.slice("e", 1, 8), F.slice("e", 9, 8)), 1).alias("first_item"))


@query(f"select b.vec_id, b.i, b.class_id, l.label from {BOXES} b left join (select unnest([0, 1, 2]) as class_id, unnest({LABELS[:3]}) as label) l using (class_id)")
def jn1_label_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Against a dictionary without the last class, whose boxes have no label."""
    labels = spark.createDataFrame(list(enumerate(LABELS[:3])), "class_id int, label string")
    return detect.join_labels(boxes(spark, sf_dir).select("vec_id", "i", "class_id"), labels).select("vec_id", "i", "class_id", "label")


@query(f"""
with k as (select image, vec_id * 8 + i as k, x, y, w, h from {RECTS}),
pairs as (
  select a.image, a.k as a_k, b.k as b_k,
    (greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y)))::bigint as intersection,
    (a.w * a.h + b.w * b.h)::bigint as areas
  from k a join k b on a.image = b.image and a.k < b.k)
select image, a_k, b_k, intersection, areas - intersection as union_area from pairs
where case when areas - intersection = 0 then 1.0 > {NMS} else intersection > {NMS}::double * (areas - intersection) end
""")
def jn2_iou_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of an image's boxes that overlap; boxes without area overlap each other wholly."""
    rows = rects(spark, sf_dir).withColumn("k", F.col("vec_id") * 8 + F.col("i"))
    return detect.overlapping_pairs(rows, "image", "k", NMS).unionByName(detect.flat_pairs(rows, "image", "k", NMS))


NMS_SQL = f"""
with recursive sorted as (
  select image, list({{'s': score, 'v': vec_id, 'i': i, 'x': x, 'y': y, 'w': w, 'h': h}} order by score desc, vec_id, i) as l from {RECTS} group by image
), r(image, rest, kept) as (
  select image, l, list_filter(l, lambda q: false) from sorted
  union all
  select image, list_filter(rest[2:], lambda q: not (
      greatest(0, least(rest[1].x + rest[1].w, q.x + q.w) - greatest(rest[1].x, q.x)) * greatest(0, least(rest[1].y + rest[1].h, q.y + q.h) - greatest(rest[1].y, q.y))
      > {NMS}::double * (rest[1].w * rest[1].h + q.w * q.h - greatest(0, least(rest[1].x + rest[1].w, q.x + q.w) - greatest(rest[1].x, q.x)) * greatest(0, least(rest[1].y + rest[1].h, q.y + q.h) - greatest(rest[1].y, q.y)))
      or rest[1].w * rest[1].h + q.w * q.h = 0
    )), list_append(kept, rest[1]) from r where len(rest) > 0
), final as (select image, unnest(kept) as b from r where len(rest) = 0)
select image, b.v as vec_id, b.i as i, round(b.s, 6) as score, b.x as x, b.y as y, b.w as w, b.h as h from final
"""


@query(NMS_SQL)
def win1_suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy suppression for each image, largest score first, without regard to classes; boxes come from many rows."""
    return detect.suppress_groups(rects(spark, sf_dir), "image", ["vec_id", "i"], NMS).withColumn("score", F.round("score", 6))


@query(NMS_SQL)
def win1_suppression_in_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with groups too large for one array: pairs, and parts of about a hundred boxes."""
    return detect.suppress_groups(rects(spark, sf_dir), "image", ["vec_id", "i"], NMS, fold=100).withColumn("score", F.round("score", 6))


BOXES32 = f"""(
  select vec_id, i, score, class_id, cx::float::double as cx, cy::float::double as cy, w::float::double as w, h::float::double as h from {BOXES}
)"""
def detect_sql(anchors: str, conf: float, side: float, scale: float) -> str:
    """From anchors (vec_id, i, score, class_id, cx, cy, w, h) of a square image to boxes that stay."""
    corner = lambda c, half, of: f"greatest(0.0, least({side}, ({c} {half} * {of}) / {scale}))"
    return f"""
with recursive c as (
  select vec_id, i, score, class_id, {corner("cx", "- 0.5", "w")} as x1, {corner("cy", "- 0.5", "h")} as y1, {corner("cx", "+ 0.5", "w")} as x2, {corner("cy", "+ 0.5", "h")} as y2
  from {anchors} where score > {conf}
), q as (
  select vec_id, i, score, class_id, round(x1)::bigint as x, round(y1)::bigint as y, round(x2 - x1)::bigint as w, round(y2 - y1)::bigint as h from c where x2 > x1 and y2 > y1
), sorted as (
  select vec_id, list({{'s': score, 'i': i, 'c': class_id, 'x': x, 'y': y, 'w': w, 'h': h}} order by score desc, i) as l from q group by vec_id
), r(vec_id, rest, kept) as (
  select vec_id, l, list_filter(l, lambda d: false) from sorted
  union all
  select vec_id, list_filter(rest[2:], lambda d: not (
      greatest(0, least(rest[1].x + rest[1].w, d.x + d.w) - greatest(rest[1].x, d.x)) * greatest(0, least(rest[1].y + rest[1].h, d.y + d.h) - greatest(rest[1].y, d.y))
      > {NMS}::double * (rest[1].w * rest[1].h + d.w * d.h - greatest(0, least(rest[1].x + rest[1].w, d.x + d.w) - greatest(rest[1].x, d.x)) * greatest(0, least(rest[1].y + rest[1].h, d.y + d.h) - greatest(rest[1].y, d.y)))
      or rest[1].w * rest[1].h + d.w * d.h = 0
    )), list_append(kept, rest[1]) from r where len(rest) > 0
), final as (select vec_id, unnest(kept) as b from r where len(rest) = 0)
select vec_id, b.x::int as x, b.y::int as y, b.w::int as w, b.h::int as h, round(b.s, 4) as score, b.c as class_id, {LABELS}[b.c + 1] as label from final
"""


@query(detect_sql(BOXES32, CONF, 640.0, 1.0))
def detect_end_to_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw output tensors to labelled boxes within each row: decoding, filters and suppression without a shuffle."""
    part = lambda a, f: F.transform(F.slice("e", 8 * a + 1, 8), f)
    centre, side = (lambda v: 320 + 640 * v), (lambda v: F.abs(v) * 1200)
    raw = F.concat(part(0, centre), part(1, centre), part(2, side), part(3, side), F.slice("e", 33, 32))
    fixed = {"scale": 1.0, "pad_left": 0, "pad_top": 0, "orig_w": 640, "orig_h": 640}
    rows = vectors(spark, sf_dir).select("vec_id", raw.cast("array<float>").alias("y"), *[F.lit(v).alias(n) for n, v in fixed.items()], F.lit(None).cast("string").alias("error"))
    runner = runners.Detector(ModelConfig("raw", classes=tuple(LABELS), conf=CONF, nms=NMS), b"", "y", "vec_id")
    return labelled_boxes(runner.postprocess(rows))


def labelled_boxes(found: DataFrame) -> DataFrame:
    each = found.select("vec_id", F.explode("detections").alias("d")).select("vec_id", "d.*")
    return each.withColumn("score", F.round(F.col("score").cast("double"), 4))


#: Which values of the picture a model output adds up, and by what it divides them: powers of two, so that 32 bits are exact.
OF_FIRST, OF_SECOND = (lambda k: k * 5 % 192), (lambda k: (k * 11 + 3) % 192)
BOX_WEIGHTS = [[(int(OF_FIRST(k) == n) / (64 if k < 32 else 256)) + int(k < 32 and OF_SECOND(k) == n) / 64 for k in range(64)] for n in range(192)]
IMAGE_BOXES = f"""(
  select vec_id, i, list_max(s) as score, (list_position(s, list_max(s)) - 1)::int as class_id, y[i + 1] as cx, y[8 + i + 1] as cy, y[16 + i + 1] as w, y[24 + i + 1] as h from (
    select vec_id, y, i::int as i, [y[(4 + c) * 8 + i + 1] for c in range(4)] as s from (
      select vec_id, [case when k < 32 then (f[k * 5 % 192 + 1] + f[(k * 11 + 3) % 192 + 1]) / 64.0::double else f[k * 5 % 192 + 1] / 256.0::double end for k in range(64)] as y
      from (select vec_id, list(v order by c, y, x) as f from {ENLARGED} group by vec_id)), unnest(range(8)) as u(i))
)"""


@query(detect_sql(IMAGE_BOXES, 0.5, 4.0, 2.0))
def detect_images_end_to_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures to labelled boxes: letterbox, planes, a model, decoding, filters and suppression, each request in its row."""
    config = ModelConfig("boxes", shape=(8, 8), classes=tuple(LABELS), conf=0.5, nms=NMS, auto_aspect_ratio=False, batch=64)
    runner = runners.Detector(config, onnx_models.linear_over_planes(BOX_WEIGHTS, [3, 8, 8], whole=True), "y", "vec_id")
    return labelled_boxes(runner.run(picture_images(spark, sf_dir)))


@query(detect_sql(IMAGE_BOXES, 0.5, 4.0, 2.0))
def udf3_detect_from_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same path as a table function, called in SQL text."""
    config = ModelConfig("boxes", shape=(8, 8), classes=tuple(LABELS), conf=0.5, nms=NMS, auto_aspect_ratio=False, batch=64)
    table_functions.register_detector(spark, "detect_images", config, onnx_models.linear_over_planes(BOX_WEIGHTS, [3, 8, 8], whole=True), "y")
    return spark.sql("""
        select vec_id, x, y, w, h, round(double(score), 4) as score, class_id, label
        from detect_images(table(select vec_id, image, pmod(vec_id, 8) as part from {pictures}) partition by part) where error is null
    """, pictures=picture_images(spark, sf_dir))


@query(f"""
select vec_id, count(*) as candidates, count(*) filter (score >= {CONF}) as n from {BOXES} group by vec_id
""")
def agg13_detections_per_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes counted in the row that holds them: no shuffle."""
    rows = vectors(spark, sf_dir)
    best = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.greatest(F.lit(0.0), *[F.col("e")[(F.lit(a * 8) + i).cast("int")] for a in range(4, 8)]))
    return rows.select("vec_id", F.size(best).cast("bigint").alias("candidates"), F.size(F.filter(best, lambda s: s >= CONF)).cast("bigint").alias("n"))


@query(f"select count(*) filter (score >= {CONF}) as total, count(*) filter (score >= {CONF}) = 0 as empty from {BOXES}")
def agg12_total_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.count_if(F.col("score") >= CONF)
    return boxes(spark, sf_dir).agg(n.alias("total"), (n == 0).alias("empty"))


@query(f"select image, count(*) as n, count(*) filter (k = 3) as success from (select image, vec_id, count(*) as k from {RECTS} group by image, vec_id) group by image")
def agg11_success_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = rects(spark, sf_dir).groupBy("image", "vec_id").agg(F.count("*").alias("k"))
    return each.groupBy("image").agg(F.count("*").alias("n"), F.count_if(F.col("k") == 3).alias("success"))


# --- reports over events


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", "ts", "user_id", F.col("event_type").alias("mode"), F.col("value").alias("latency_ms"))


SAMPLES = "(select event_id, ts, user_id, event_type as mode, value as latency_ms from events)"
P_SQL = ", ".join(f"round(quantile_cont(latency_ms, {p}), 6) as latency_{n}_ms" for n, p in metrics.POINTS.items())
S_SQL = "round(avg(latency_ms), 6) as latency_avg_ms, round(min(latency_ms), 6) as latency_min_ms, round(max(latency_ms), 6) as latency_max_ms"
R6 = lambda df: df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query(f"select mode, {P_SQL} from {SAMPLES} group by mode")
def agg3_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R6(metrics.percentiles(samples(spark, sf_dir), ["mode"], "latency_ms"))


@query(f"select mode, {S_SQL} from {SAMPLES} group by mode")
def agg4_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R6(samples(spark, sf_dir).groupBy("mode").agg(*metrics.summary("latency_ms")))


@query(f"select mode, count(*) as n, round(count(*) / sum(latency_ms) * 1000, 6) as throughput_qps from {SAMPLES} group by mode")
def agg5_throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = samples(spark, sf_dir).groupBy("mode").agg(F.count("*").alias("n"), F.sum("latency_ms").alias("wall"))
    return counted.select("mode", "n", F.round(metrics.throughput(F.col("n"), F.col("wall")), 6).alias("throughput_qps"))


@query(f"select mode, count(*) as n, round(avg(latency_ms), 6) as latency_avg_ms from {SAMPLES} group by mode")
def agg6_clients_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of four clients as one set: the client is a column, so one scan reads them all."""
    client = F.pmod("user_id", F.lit(4))
    merged = samples(spark, sf_dir).withColumn("client", client).where(F.col("client").isNotNull())
    return merged.groupBy("mode").agg(F.count("*").alias("n"), F.round(F.avg("latency_ms"), 6).alias("latency_avg_ms"))


MODES = ["click", "none"]


@query(f"""
select m.mode, coalesce(n, 0) as n, coalesce(a, 0.0) as latency_avg_ms from (select unnest({MODES}) as mode) m
left join (select mode, count(*) as n, round(avg(latency_ms), 6) as a from {SAMPLES} group by mode) using (mode)
""")
def agg7_empty_is_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = samples(spark, sf_dir).groupBy("mode").agg(F.count("*").alias("n"), F.round(F.avg("latency_ms"), 6).alias("latency_avg_ms"))
    return metrics.filled(got, MODES)


@query(f"select user_id % 8 as clients, mode, round(avg(case when event_id % 10 = 0 then 0.0 else latency_ms end), 6) as latency_ms from {SAMPLES} group by 1, 2")
def agg8_group_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = samples(spark, sf_dir).select((F.col("user_id") % 8).alias("clients"), "mode", F.when(F.col("event_id") % 10 != 0, F.col("latency_ms")).alias("latency_ms"))
    return R6(metrics.group_means(s, ["clients", "mode"], ["latency_ms"]))


@query(f"select distinct user_id % 8 as clients, mode from {SAMPLES}")
def agg9_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples(spark, sf_dir).select((F.col("user_id") % 8).alias("clients"), "mode").distinct()


@query(f"select mode, round(avg(user_id % 101), 6) as utilization from {SAMPLES} group by mode")
def agg10_mean_utilization(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples(spark, sf_dir).groupBy("mode").agg(F.round(F.avg(F.col("user_id") % 101), 6).alias("utilization"))


@query(f"select mode, user_id % 30 as x, round(avg(latency_ms), 6) as y from {SAMPLES} group by 1, 2")
def agg14_average_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples(spark, sf_dir).groupBy("mode", (F.col("user_id") % 30).alias("x")).agg(F.round(F.avg("latency_ms"), 6).alias("y"))


@query(f"""
select c.clients, m.mode, round(a, 6) as latency_ms from (select distinct user_id % 8 as clients from {SAMPLES}) c cross join (select distinct mode from {SAMPLES}) m
left join (select user_id % 8 as clients, mode, avg(latency_ms) as a from {SAMPLES} where (user_id % 8 + length(mode)) % 3 <> 0 group by 1, 2) g on g.clients = c.clients and g.mode = m.mode
""")
def jn3_grid_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = samples(spark, sf_dir).select((F.col("user_id") % 8).alias("clients"), "mode", "latency_ms")
    there = F.when((F.col("clients") + F.length("mode")) % 3 != 0, F.col("latency_ms"))
    cells = s.groupBy("clients", "mode").agg(F.avg(there).alias("latency_ms"))
    return R6(metrics.complete_grid(cells, "clients", "mode", ["latency_ms"]))


@query("""
select o_orderkey, case when o_orderkey % 5 > 0 then o_orderkey % 5 else 16 end::bigint as batch, case when o_orderkey % 7 - 1 >= 0 then o_orderkey % 7 - 1 else 3 end::bigint as warm_up,
  case when o_orderkey % 3 = 0 then 'CPUExecutionProvider' else 'CUDAExecutionProvider' end as provider from orders
""")
def jn4_override_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overrides win where they are above 0, at least 0, or not empty."""
    k = F.col("o_orderkey")
    over = read(spark, sf_dir, "orders").select("o_orderkey", (k % 5).alias("batch"), (k % 7 - 1).alias("warm_up"), F.when(k % 3 == 0, "CPUExecutionProvider").otherwise("").alias("provider"))
    c = F.col
    return over.select(
        "o_orderkey", metrics.overridden(F.lit(16), c("batch"), c("batch") > 0).cast("bigint").alias("batch"), metrics.overridden(F.lit(3), c("warm_up"), c("warm_up") >= 0).cast("bigint").alias("warm_up"),
        metrics.overridden(F.lit("CUDAExecutionProvider"), c("provider"), c("provider") != "").alias("provider"),
    )


@query(f"select event_id as request_id, mode, latency_ms from {SAMPLES}")
def jn5_request_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results meet their requests by id, whatever order batches finish in."""
    s = samples(spark, sf_dir)
    results = s.select(F.col("event_id").alias("request_id"), "latency_ms")
    return s.select(F.col("event_id").alias("request_id"), "mode").join(results, "request_id")


@query(f"select 'sync' as kind, mode, count(*) as n from {SAMPLES} group by mode union all select 'batch', mode, count(*) from {SAMPLES} where latency_ms > 50 group by mode")
def set1_union_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = samples(spark, sf_dir)
    count = lambda df, kind: df.groupBy("mode").agg(F.count("*").alias("n")).withColumn("kind", F.lit(kind))
    return count(s, "sync").unionByName(count(s.where("latency_ms > 50"), "batch")).select("kind", "mode", "n")


@query(f"select client_id, count(*) as n from (select 0 as client_id, * from {SAMPLES} where user_id % 2 = 0 union all select 1, * from {SAMPLES} where user_id % 2 = 1) group by client_id")
def set2_union_clients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The union of two clients' samples: one scan that names the client."""
    client = F.pmod("user_id", F.lit(2)).cast("int")
    return samples(spark, sf_dir).select(client.alias("client_id")).where(F.col("client_id").isin(0, 1)).groupBy("client_id").agg(F.count("*").alias("n"))


@query(f"select distinct mode from {SAMPLES}")
def set3_distinct_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples(spark, sf_dir).select("mode").distinct()


@query("select p_partkey, m as mode, case m when 'Sync' then 0 when 'Async' then 1 when 'Batch' then 2 else 3 end::int as rank from (select p_partkey, ['Other', 'Batch', 'Sync', 'Async'][p_partkey % 4 + 1] as m from part)")
def top6_mode_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*map(F.lit, ["Other", "Batch", "Sync", "Async"]))
    rows = read(spark, sf_dir, "part").select("p_partkey", names[(F.col("p_partkey") % 4).cast("int")].alias("mode"))
    return rows.withColumn("rank", metrics.mode_rank(F.col("mode"))).orderBy("rank", "p_partkey")


WIN2_SQL = f"""
with m as (select mode, user_id % 30 as x, avg(latency_ms) as y from {SAMPLES} group by 1, 2),
c as (select mode, x, y, row_number() over (partition by mode order by x) - 1 as i, count(*) over (partition by mode) as n from m),
w as (select *, case when n < 2 then 1 else greatest(1, n // 3 + 1) end as win from c),
o as (select w.mode, w.x, w.y, w.win, ((w.i + k - w.win // 2) % (2 * w.n) + 2 * w.n) % (2 * w.n) as j, w.n from w, unnest(range(64)) as u(k) where k < w.win)
select o.mode, o.x, round(any_value(o.y), 6) as y, round(sum(p.y) / any_value(o.win), 6) as y_smooth
from o join w p on p.mode = o.mode and p.i = case when o.j < o.n then o.j else 2 * o.n - 1 - o.j end group by o.mode, o.x
"""


@query(WIN2_SQL)
def win2_smoothing(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = samples(spark, sf_dir).select("mode", (F.col("user_id") % 30).alias("x"), "latency_ms")
    return R6(metrics.smooth(s, "mode", "x", "latency_ms"))


# --- micro-batches and streams

TICK = "time_bucket(interval '1 hour', ts)"


@query(f"select event_id, (r // 8)::int as batch_no, (r % 8)::int as slot from (select event_id, row_number() over (partition by {TICK} order by ts, event_id) - 1 as r from events)")
def win3_microbatch_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schedule.slots(read(spark, sf_dir, "events"), "ts", ["event_id"], 8).select("event_id", "batch_no", "slot")


STR4_SQL = f"select requests, count(*) as batches from (select count(*) as requests from (select {TICK} as t, (row_number() over (partition by {TICK} order by ts, event_id) - 1) // 8 as b from events) group by t, b) group by requests"


@query(STR4_SQL)
def str4_microbatch_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schedule.batch_sizes(read(spark, sf_dir, "events"), "ts", 8)


@query("select frames, fps, count(*) as windows from (select count(*) as frames, count(*) // 3600 as fps from events group by time_bucket(interval '1 hour', ts)) group by frames, fps")
def win4_fps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schedule.frames_per_second(read(spark, sf_dir, "events"), "ts", "1 hour").groupBy("frames", "fps").agg(F.count("*").alias("windows"))


@query("""
with recursive f as (select ms, row_number() over (order by ms, event_id) as i from (select event_id, epoch_us(ts) // 1000 as ms from events)),
r(i, ms, succ) as (
  select i, ms, (select min(g.i) from f g where g.ms > f.ms + 3600000) from f where i = 1
  union all
  select f.i, f.ms, (select min(g.i) from f g where g.ms > f.ms + 3600000) from r join f on f.i = r.succ
)
select r.ms as start_ms, r.succ - r.i + (r.i = 1)::bigint as frames, f.ms - r.ms as elapsed_ms, (r.succ - r.i + (r.i = 1)::bigint) * 3600000 // (f.ms - r.ms) as rate from r join f on f.i = r.succ
""")
def win4_counter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rate each time that more than an hour has gone since it was last shown."""
    return rate.rates(read(spark, sf_dir, "events"), "ts", "event_id", 3_600_000).drop("stream")


@query(f"select event_id from (select event_id, row_number() over (partition by {TICK} order by ts, event_id) as r from events) where r <= 7")
def str10_load_shed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schedule.shed(read(spark, sf_dir, "events"), "ts", ["event_id"], schedule.ring_capacity(5)).select("event_id")


@query("select event_id, case when value > 100 then 'value above 100' end as error, case when value > 100 then null else value end as value from events")
def str7_error_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").select("event_id", F.col("value").alias("v"))
    return schedule.guarded(rows, F.col("v"), F.when(F.col("v") > 100, "value above 100")).select("event_id", "error", "value")


STAGES: list[schedule.Stage] = [
    lambda df: df.withColumn("e", F.col("embedding").cast("array<double>")),
    lambda df: df.withColumn("score", F.array_max("e")),
    lambda df: df.select("vec_id", F.round("score", 6).alias("score"), tensor.argmax(F.col("e")).alias("class_id")),
]
STAGES_SQL = f"select vec_id, round(list_max(e), 6) as score, (list_position(e, list_max(e)) - 1)::int as class_id from {VECTORS}"


@query(STAGES_SQL)
def str1_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schedule.run_sync(read(spark, sf_dir, "embeddings"), STAGES)


@query(STAGES_SQL)
def str3_async(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schedule.run_async(read(spark, sf_dir, "embeddings"), STAGES, 8)


def _scratch(spark: SparkSession) -> str:
    return work_folder(spark, "stream")


def _events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = read(spark, sf_dir, "events").schema
    return schedule.stream_table(spark, f"{sf_dir}/events.parque[t]", schema)


@query("select event_id, event_type as mode, value as latency_ms from events")
def str2_drain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All requests that are there are processed, then the stream ends."""
    at = _scratch(spark)
    schedule.drain(_events_stream(spark, sf_dir).select("event_id", F.col("event_type").alias("mode"), F.col("value").alias("latency_ms")), f"{at}/out", f"{at}/checkpoint")
    return spark.read.parquet(f"{at}/out")


@query(STR4_SQL)
def str4_stream_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sizes of micro-batches from a stream: counts of each tick in event time, closed by the watermark."""
    at = _scratch(spark)
    events = _events_stream(spark, sf_dir).select(schedule.event_time(F.col("ts")).alias("at")).withWatermark("at", "1 hour")
    counts = events.groupBy(F.window("at", "1 hour").alias("w")).agg(F.count("*").alias("n"))

    def keep(df: DataFrame, number: int) -> None:
        df.select(F.col("w.start").alias("tick"), "n").write.mode("append").parquet(f"{at}/counts")

    # each micro-batch gives the ticks that it changed; those behind the watermark leave the state, and a tick's last count is its largest
    schedule.drain_batches(counts, keep, f"{at}/checkpoint", mode="update")
    n = F.col("n")
    final = spark.read.parquet(f"{at}/counts").groupBy("tick").agg(F.max("n").alias("n"))
    each = final.select(F.explode(F.array(F.struct(F.lit(8).cast("bigint").alias("requests"), F.floor(n / 8).alias("batches")), F.struct((n % 8).alias("requests"), F.when(n % 8 > 0, 1).otherwise(0).cast("bigint").alias("batches")))).alias("b"))
    return each.where("b.batches > 0").groupBy("b.requests").agg(F.sum("b.batches").cast("bigint").alias("batches"))


BATCHER_SQL = """
with recursive r as (
  select event_id, user_id % 16 as shard, epoch_us(ts) // 1000 as ms, row_number() over (partition by user_id % 16 order by ts, event_id) as n from events
), ends as (
  select r.shard, r.n, (select min(q.n) from r q where q.shard = r.shard and q.ms >= r.ms + 600000) as due, (select max(q.n) from r q where q.shard = r.shard) as last from r
), b(shard, batch_no, first, next, is_full) as (
  select shard, 0::bigint, n, least(n + 8, coalesce(due, last + 1)), n + 8 <= coalesce(due, last + 1) from ends where n = 1
  union all
  select e.shard, b.batch_no + 1, e.n, least(e.n + 8, coalesce(e.due, e.last + 1)), e.n + 8 <= coalesce(e.due, e.last + 1) from b join ends e on e.shard = b.shard and e.n = b.next
)
select r.event_id as request_id, b.shard::int as shard, b.batch_no, (r.n - b.first)::int as slot, b.is_full as full, false as late from b join r on r.shard = b.shard and r.n >= b.first and r.n < b.next
"""


@query(BATCHER_SQL)
def str4_count_or_timeout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of eight, or of what came within ten minutes, for each of sixteen queues: numbers and slots of every request."""
    at = _scratch(spark)
    stream = _events_stream(spark, sf_dir).select("event_id", "ts", "user_id")
    out = batcher.count_or_timeout(stream, "event_id", "ts", 8, 600_000, shard=F.pmod("user_id", F.lit(16)), timers=False)
    return batcher.deliver(out, f"{at}/out", f"{at}/checkpoint")


@query("select event_id % 5 // 2 as batch, count(distinct event_id % 5)::int as files, count(*) as requests, min(event_id) as first_id, max(event_id) as last_id from events group by 1")
def str8_back_pressure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five files wait, one after the other, and no batch takes more than two: which requests each batch has."""
    at, events = _scratch(spark), read(spark, sf_dir, "events").select("event_id")
    for k in range(5):
        events.where(F.col("event_id") % 5 == k).coalesce(1).write.mode("append").parquet(f"{at}/in")

    def seen(df: DataFrame, n: int) -> None:
        df.groupBy(F.lit(n).cast("bigint").alias("batch"), F.col("_metadata.file_path").alias("file")).agg(F.count("*").alias("n"), F.min("event_id").alias("low"), F.max("event_id").alias("high")).write.mode("append").parquet(f"{at}/out")

    schedule.drain_batches(schedule.stream_table(spark, f"{at}/in", events.schema, 2).select("event_id", "_metadata"), seen, f"{at}/checkpoint")
    return spark.read.parquet(f"{at}/out").groupBy("batch").agg(F.count("*").cast("int").alias("files"), F.sum("n").alias("requests"), F.min("low").alias("first_id"), F.max("high").alias("last_id"))


@query("select 3 as clients, 15 as requests, 15 as runs")
def str12_closed_loop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three clients that each send five requests, one after the other, when no time is set."""
    runs: list[int] = []
    latencies, _ = schedule.closed_loop(lambda: runs.append(spark.range(1).count()), 0.0, 5, clients=3)
    return spark.createDataFrame([(3, len(latencies), len(runs))], "clients int, requests int, runs int")


# --- sinks


@query(f"select vec_id, 4 as height, 4 as width, array_to_string([format('{{:02X}}', x) for x in p], '') as pixels from {PICTURES}")
def snk1_image_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures written as PNG files, moved into place together, and read back."""
    folder = f"{_scratch(spark)}/pictures"
    images.write_png_files(picture_images(spark, sf_dir), "vec_id", "image", folder)
    found = images.require_decoded(images.read_images(spark, folder)).select("image.*")
    return found.select(F.regexp_extract("origin", r"(\d+)\.png$", 1).cast("bigint").alias("vec_id"), "height", "width", F.hex("data").alias("pixels"))


@query(f"select vec_id as number, 4 as height, 4 as width, array_to_string([format('{{:02X}}', x) for x in p], '') as pixels from {PICTURES}")
def src2_frame_container(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container read at once, in byte ranges."""
    path = f"{_scratch(spark)}/frames"
    frames.write_frames(picture_images(spark, sf_dir), path, "vec_id", "image")
    return frames.read_frames(spark, path).select("number", "height", "width", F.hex("data").alias("pixels"))


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.report(samples(spark, sf_dir), "mode", "latency_ms", F.sum("latency_ms"), 8).select(*reports.COLUMNS)


RESULTS = f"""(
  select mode, 8 as override_batch, count(*) as total_requests, sum(latency_ms) as wall_time_ms, count(*) / sum(latency_ms) * 1000 as throughput_qps,
    avg(latency_ms) as latency_avg_ms, min(latency_ms) as latency_min_ms, max(latency_ms) as latency_max_ms,
    {", ".join(f"quantile_cont(latency_ms, {p}) as latency_{n}_ms" for n, p in metrics.POINTS.items())} from {SAMPLES} group by mode
)"""
ROUNDED = ", ".join(c if d is None else f"round({c}, {d}) as {c}" for c, d in reports.COLUMNS.items())


CONFIG = BenchmarkConfig(config_path="config.yaml", concurrent_clients=8, batch_override=Override(batch=8))


@query(f"select 8 as concurrent_clients, mode, override_batch::bigint as override_batch, total_requests, round(wall_time_ms, 2) as total_wall_ms, round(throughput_qps, 2) as throughput_qps, {', '.join(f'round({c}, 4) as {c}' for c in reports.COLUMNS if c.startswith('latency'))}, total_requests as samples_count from {RESULTS}")
def snk2_json_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _scratch(spark)
    reports.write_json(results(spark, sf_dir), CONFIG, f"{folder}/benchmark_20240101_000000.json", 1_704_067_200)
    reports.write_text(spark, f"{folder}/benchmark_broken.json", "{")
    return reports.read_json(spark, folder).drop("file")


REPORT_FILES = [("benchmark_20240103_000000.json", 3), ("benchmark_20240101_000000.json", 1), ("benchmark_20240102_000000.json", 2)]


@query(f"""
select f as file, dense_rank() over (order by f)::int as place, k::int as concurrent_clients, mode, total_requests
from (select unnest({[f for f, _ in REPORT_FILES]}) as f, unnest({[k for _, k in REPORT_FILES]}) as k), (select mode, total_requests from {RESULTS})
""")
def top7_report_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several report files in order of their names; a broken one between them is left out."""
    folder = _scratch(spark)
    for name, clients in REPORT_FILES:
        reports.write_json(results(spark, sf_dir), dataclasses.replace(CONFIG, concurrent_clients=clients), f"{folder}/{name}", 1_704_067_200)
    reports.write_text(spark, f"{folder}/benchmark_20240101_120000.json", "{")
    file = F.regexp_extract("file", r"([^/]+)$", 1)
    place = F.dense_rank().over(Window.orderBy("file")).cast("int")  # a handful of report rows
    return reports.read_json(spark, folder).withColumn("place", place).select(file.alias("file"), "place", "concurrent_clients", "mode", "total_requests")


@query(f"""
select vec_id, string_agg(format('{{:02X}}', case when ((x between x0 and x1) and (y = y0 or y = y1)) or ((y between y0 and y1) and (x = x0 or x = x1)) then [0, 255, 0][ch + 1] else v end), '' order by j) as pixels
from (select vec_id, j, p[j + 1] as v, j // 12 as y, j % 12 // 3 as x, j % 3 as ch, vec_id % 3 as x0, vec_id % 2 as y0, least(3, vec_id % 3 + 2) as x1, vec_id % 2 + 2 as y1 from {PICTURES}, unnest(range(48)) u(j)) group by vec_id
""")
def snk9_drawn_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The outline of a box drawn on every picture."""
    corner = F.array(F.struct((F.col("vec_id") % 3).cast("int").alias("x"), (F.col("vec_id") % 2).cast("int").alias("y"), F.lit(2).alias("w"), F.lit(2).alias("h")))
    return pixels.drawn(picture_images(spark, sf_dir).withColumn("boxes", corner), "vec_id", "image", "boxes").select("vec_id", F.hex("data").alias("pixels"))


@query(f"select {ROUNDED} from {RESULTS}")
def snk3_csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{_scratch(spark)}/benchmark_20240101_000000.csv"
    reports.write_csv(results(spark, sf_dir), CONFIG, path)
    return reports.read_csv(spark, path)


@query("select event_id, 'benchmark_' || strftime(ts, '%Y%m%d_%H%M%S') || '.json' as json, 'benchmark_' || strftime(ts, '%Y%m%d_%H%M%S') || '.csv' as csv from events")
def snk7_report_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of reports by their time."""
    return read(spark, sf_dir, "events").select("event_id", *[reports.report_names(kind, F.col("ts")).alias(kind) for kind in ("json", "csv")])


@query(f"select mode, total_requests::varchar as total_requests, {', '.join(f'''printf('%.{1 if c in ('wall_time_ms', 'throughput_qps') else 2}f', round({c}, {1 if c in ('wall_time_ms', 'throughput_qps') else 2})) as {c}''' for c in list(reports.COLUMNS)[3:])} from (select {ROUNDED} from {RESULTS})")
def snk4_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = reports.rounded(results(spark, sf_dir))
    return reports.table(r.select(*[F.col(c) if d is None else F.round(c, 1 if c in ("wall_time_ms", "throughput_qps") else 2).alias(c) for c, d in reports.COLUMNS.items()]))


CLIENT_REPORTS = f"(select user_id % 8 as concurrent_clients, mode, {S_SQL}, {P_SQL}, round(count(*) / sum(latency_ms) * 1000, 6) as throughput_qps, count(*) as total_requests, 8 as override_batch from {SAMPLES} group by 1, 2)"


def client_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = samples(spark, sf_dir).withColumn("concurrent_clients", F.col("user_id") % 8)
    keys = ["concurrent_clients", "mode"]
    counted = s.groupBy(*keys).agg(*metrics.summary("latency_ms"), metrics.throughput(F.count("*"), F.sum("latency_ms")).alias("throughput_qps"), F.count("*").alias("total_requests"), F.lit(8).alias("override_batch"))
    return R6(metrics.with_percentiles(counted, s, keys, "latency_ms"))


@query(f"select mode, concurrent_clients, override_batch::bigint as override_batch, total_requests, {', '.join(f'round({c}, 4) as {c}' for c in ('throughput_qps', 'latency_avg_ms', 'latency_p50_ms', 'latency_p90_ms', 'latency_p95_ms', 'latency_p99_ms'))} from {CLIENT_REPORTS}")
def snk5_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = reports.summary(client_reports(spark, sf_dir))
    return got.select(*[F.round(c, 4).alias(c) if t == "double" else F.col(c) for c, t in got.dtypes])


@query(f"""
select mode, concurrent_clients, metric, round(value, 4) as value from (
  unpivot (select mode, concurrent_clients, throughput_qps, {', '.join(c for c in reports.COLUMNS if c.startswith('latency'))} from {CLIENT_REPORTS})
  on throughput_qps, {', '.join(c for c in reports.COLUMNS if c.startswith('latency'))} into name metric value value)
""")
def snk6_chart_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.chart_rows(client_reports(spark, sf_dir)).withColumn("value", F.round("value", 4))
