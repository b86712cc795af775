"""Golden vectors and properties of geometry, tensors, suppression and reports."""

from __future__ import annotations

import datetime
import random
import threading
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import yaml
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from framewright import benchmark, config, session
from framewright.functions import geometry, tensor
from framewright.operators import detect, metrics, pixels
from framewright.operators.infer import OnnxBackend, infer
from framewright.operators.runners import Classifier, Detector
from framewright.plans.queries import QUERIES
from framewright.plans.queries import settings as part_settings
from framewright.sources import images, onnx_models, reports
from framewright.streaming import schedule

LETTERBOX = [
    (810, 1080, True, 0.592592597, 480, 640, (80, 0, 80, 0)),
    (1280, 720, True, 0.488888890, 626, 352, (7, 144, 7, 144)),
    (1280, 720, False, 0.5, 640, 360, (0, 140, 0, 140)),
    (640, 480, True, 1.0, 640, 480, (0, 80, 0, 80)),
    (500, 375, True, 1.279999971, 640, 480, (0, 80, 0, 80)),
    (333, 500, True, 1.249249220, 416, 625, (112, 7, 112, 8)),
    (333, 500, False, 1.279999971, 426, 640, (107, 0, 107, 0)),
    (100, 37, True, 6.054054260, 605, 224, (17, 208, 18, 208)),
]


@pytest.mark.parametrize("w,h,auto,scale,new_w,new_h,pads", LETTERBOX)
def test_letterbox(spark, w, h, auto, scale, new_w, new_h, pads):
    g = spark.range(1).select(geometry.letterbox(F.lit(w), F.lit(h), 640, 640, auto).alias("g")).first().g
    assert (g.new_w, g.new_h, (g.pad_left, g.pad_top, g.pad_right, g.pad_bottom), g.error) == (new_w, new_h, pads, None)
    assert abs(g.scale - scale) < 1e-6
    assert pixels.letterbox_size(w, h, 640, 640, auto)[1:] == (new_w, new_h, pads[0], pads[1])


def test_letterbox_collapse(spark):
    g = spark.range(1).select(geometry.letterbox(F.lit(1000), F.lit(20), 640, 640).alias("g")).first().g
    assert g.error and (g.new_w, g.new_h) == (0, 0)
    with pytest.raises(ValueError):
        pixels.letterbox(np.zeros((20, 1000, 3), np.uint8), 640, 640)


@pytest.mark.parametrize("h,w,resized,offset", [(480, 640, (480, 640), (208, 128)), (300, 400, (300, 400), (88, 38)), (160, 300, (320, 600), (188, 48)), (128, 128, (256, 256), (16, 16)), (200, 200, (200, 200), None), (513, 700, (0, 0), None)])
def test_classifier_legacy_geometry(spark, h, w, resized, offset):
    r = geometry.resize_shorter(F.lit(w), F.lit(h), legacy=True)
    row = spark.range(1).select(r.alias("r")).select("r", geometry.center_crop(F.col("r.new_w"), F.col("r.new_h")).alias("c")).first()
    assert (row.r.new_h, row.r.new_w) == resized
    assert (row.c.left, row.c.top) == (offset or (None, None)) and bool(row.c.error) == (offset is None)


def test_pad_denormalize_argmax_percentiles(spark):
    pad = lambda w, h: spark.range(1).select(geometry.center_pad(F.lit(w), F.lit(h), 576, 576).alias("g")).first().g
    assert (pad(400, 300).pad_left, pad(400, 300).pad_top) == (88, 138)
    assert pad(576, 576).pad_left == 0 and pad(575, 577).error
    row = spark.range(1).select(
        tensor.denormalize(F.array(*map(F.lit, [-0.2, 0.0, 0.5, 1.0, 1.7]))).alias("u8"), tensor.best_class(F.array(*map(F.lit, [0.1, 0.3, 0.3]))).alias("a"), tensor.best_class(F.array(F.lit(-1.0), F.lit(-2.0))).alias("b")
    ).first()
    assert row.u8 == [0, 0, 128, 255, 255] and tuple(row.a) == (0.3, 1) and tuple(row.b) == (0.0, 0)
    p = lambda xs, q: spark.createDataFrame([(float(x),) for x in xs], "x double").agg(F.percentile("x", q)).first()[0]
    assert p([1, 2, 4], 0.5) == 2 and abs(p([1, 2, 3, 4], 0.9) - 3.7) < 1e-9 and p([], 0.5) is None


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 40), st.integers(1, 40), st.integers(0, 10), st.integers(0, 10))
def test_pixels_round_trip(w, h, more_w, more_h):
    image = np.random.default_rng(w * 50 + h).integers(0, 256, (h, w, 3), dtype=np.uint8)
    padded, (_, left, top, ow, oh) = pixels.pad_to(image, w + more_w, h + more_h)
    assert (pixels.from_planes(pixels.to_planes(padded), left, top, ow, oh) == image).all()
    assert (pixels.resize(image, w, h) == image).all()
    flat = pixels.resize(np.full((h, w, 3), 7, np.uint8), w + more_w, h + more_h)
    assert (flat == 7).all()


def test_suppression_is_idempotent_and_separates(spark):
    rng = np.random.default_rng(3)
    rows = [(0, i, float(rng.random()), *map(int, rng.integers(0, 60, 2)), *map(int, rng.integers(0, 40, 2))) for i in range(120)]
    df = spark.createDataFrame(rows, "image int, i int, score double, x int, y int, w int, h int")
    kept = detect.suppress_groups(df, "image", ["i"], 0.45)
    once = sorted(map(tuple, kept.collect()))
    assert sorted(map(tuple, detect.suppress_groups(kept, "image", ["i"], 0.45).collect())) == once
    assert detect.overlapping_pairs(kept, "image", "i", 0.45).count() == 0 and detect.flat_classes(kept, "image", "i").count() == 0 and 0 < len(once) < 120


def test_onnx_backend_and_errors(spark):
    weights = [[1.0, 0.0], [0.0, 2.0], [1.0, 1.0]]
    backend = OnnxBackend(onnx_models.linear(weights))
    assert backend.warm_up((3,)) == {"logits": (2,)}
    df = spark.createDataFrame([(1, [1.0, 2.0, 3.0]), (2, [0.0, 0.0, 0.0])], "id int, d array<float>")
    got = {r.id: r.logits for r in infer(df, "id", "d", (3,), onnx_models.linear(weights), "logits").collect()}
    assert got == {1: [4.0, 7.0], 2: [0.0, 0.0]}
    bad = infer(spark.createDataFrame([(1, [1.0]), (2, [1.0])], "id int, d array<float>"), "id", "d", (3,), onnx_models.linear(weights), "logits").collect()
    assert all(r.error and r.logits is None for r in bad)


def test_several_outputs(spark):
    model = onnx_models.heads({"a": [[1.0, 2.0], [3.0, 4.0]], "b": [[1.0], [-1.0]]})
    df = spark.createDataFrame([(1, [1.0, 1.0]), (2, None), (3, [0.0, 2.0])], "id int, d array<float>")
    got = {r.id: r for r in infer(df, "id", "d", (2,), model, ("b", "a")).collect()}
    assert (got[1].a.data, got[1].b.data, got[3].a.data, got[3].b.data) == ([4.0, 6.0], [0.0], [6.0, 8.0], [-2.0])
    assert got[1].a.shape == [2] and got[1].b.shape == [1] and got[2].a is None and got[2].b is None and got[2].error is None
    assert all(r.error for r in infer(df.where("id <> 2"), "id", "d", (2,), model, ("a", "none")).collect())


def picture(spark, image):
    h, w = image.shape[:2]
    return spark.createDataFrame([(1, ("", h, w, 3, images.BGR, bytearray(image.tobytes())))], "request_id long, image struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>")


def test_detector_and_classifier_end_to_end(spark):
    # an identity model over [3, 8, 8]: its 192 values read as 4 + 2 attributes of 32 anchors
    c = config.ModelConfig("m", shape=(8, 8), classes=("a", "b"), conf=0.25, auto_aspect_ratio=False)
    image = np.random.default_rng(1).integers(0, 256, (8, 8, 3), dtype=np.uint8)
    got = Detector(c, onnx_models.identity([3, 8, 8]), "y").run(picture(spark, image)).first()
    t = pixels.to_planes(image).reshape(6, 32).astype(np.float64)
    want = []
    order = sorted(range(32), key=lambda i: (-max(t[4, i], t[5, i]), i))
    for i in order:
        s, cls = max(t[4, i], t[5, i]), int(t[5, i] > t[4, i])
        x1, x2 = (min(8, max(0, t[0, i] + k * t[2, i])) for k in (-0.5, 0.5))
        y1, y2 = (min(8, max(0, t[1, i] + k * t[3, i])) for k in (-0.5, 0.5))
        if s <= 0.25 or x2 <= x1 or y2 <= y1:
            continue
        r = lambda v: int(np.floor(v + 0.5))
        b = (r(x1), r(y1), r(x2 - x1), r(y2 - y1))

        def over(p, q):
            inter = max(0, min(p[0] + p[2], q[0] + q[2]) - max(p[0], q[0])) * max(0, min(p[1] + p[3], q[1] + q[3]) - max(p[1], q[1]))
            u = p[2] * p[3] + q[2] * q[3] - inter
            return u == 0 or inter > 0.45 * u

        if not any(over(b, k[0]) for k in want):
            want.append((b, cls))
    assert [((d.x, d.y, d.w, d.h), d.class_id) for d in got.detections] == want and want
    c = config.ModelConfig("m", shape=(8, 8), classes=("a", "b"))
    weights = [[1.0 if j == i % 2 else -1.0 for j in range(2)] for i in range(192)]
    model = onnx_models.linear(weights)

    class Flat(Classifier):
        def input_shape(self):
            return (192,)

    assert Flat(c, model, "logits").run(picture(spark, image)).first().label in ("a", "b")


def test_bad_picture_is_an_error_row(spark):
    c = config.ModelConfig("m", shape=(8, 8), classes=("a",))
    wide = picture(spark, np.zeros((1, 1000, 3), np.uint8))
    row = Detector(c, onnx_models.identity([3, 8, 8]), "y").run(wide).first()
    assert row.error == "image collapses" and row.detections is None


def test_drawing_and_png(spark, tmp_path):
    image = np.zeros((6, 7, 3), np.uint8)
    drawn = pixels.draw_box(image, 1, 1, 3, 3)
    assert drawn.sum() > 0 and image.sum() == 0
    images.write_png_files(picture(spark, drawn), "request_id", "image", str(tmp_path / "png"))
    back = images.read_images(spark, str(tmp_path / "png")).select("image.*").first()
    assert (back.height, back.width, back.mode, bytes(back.data)) == (6, 7, images.BGR, drawn.tobytes())
    (tmp_path / "png" / "broken.png").write_bytes(b"no image")
    with pytest.raises(Exception, match="cannot decode"):
        images.require_decoded(images.read_images(spark, str(tmp_path / "png"))).collect()
    assert images.read_images(spark, str(tmp_path / "png"), skip_broken=True).count() == 1


def test_image_stream(spark, tmp_path):
    images.write_png_files(picture(spark, np.zeros((2, 2, 3), np.uint8)), "request_id", "image", str(tmp_path / "frames"))
    schedule.drain(images.stream_images(spark, str(tmp_path / "frames")).select("path", "length"), str(tmp_path / "out"), str(tmp_path / "c"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_configuration(tmp_path):
    (tmp_path / "m.yaml").write_text("model: {path: a.onnx, batch: 8, classes: [x, y]}\npreprocess: {pad_color: [1, 2, 3]}\npostprocess: {conf: 0.5}\n")
    m = config.model_config(config.load_yaml(str(tmp_path / "m.yaml")))
    assert (m.batch, m.classes, m.pad_color, m.conf, m.nms, m.shape, m.warm_up) == (8, ("x", "y"), (1, 2, 3), 0.5, 0.45, (640, 640), 0)
    over = config.merged(m, config.Override(buffer_size=9, warm_up=0, execution_providers="CPUExecutionProvider"))
    assert (over.batch, over.buffer_size, over.session_options) == (8, 9, {"execution_providers": ["CPUExecutionProvider"]}) and m.session_options == {}
    (tmp_path / "b.yaml").write_text("mode: sync\nconcurrent_clients: 3\nsync_override: {batch: 2}\n")
    c = config.from_arguments(["--config", str(tmp_path / "b.yaml"), "--clients", "5"])
    assert (c.mode, c.concurrent_clients, c.sync_override.batch, c.min_iterations) == ("sync", 5, 2, 50)
    c = config.from_arguments(["--model", "resnet", "--no-csv", "--no-gpu-stats"])
    assert c.model_type == "resnet" and c.export_json and not c.export_csv and not c.show_gpu_stats
    for parse in (config.parse_backend, config.parse_graph_level, config.parse_execution_mode, config.parse_log_level):
        with pytest.raises(ValueError):
            parse("ORT_ENABLE_BASE")


def test_configurations_are_read_by_all_tasks(spark, tmp_path):
    """However few files they come in, and by libyaml where it is there; anchors, merge keys and empty texts as before."""
    text = "a: &a {x: 1, y: 2}\nb: {<<: *a, y: 3}\n"
    assert config.parse_yaml(text) == yaml.safe_load(text) == {"a": {"x": 1, "y": 2}, "b": {"x": 1, "y": 3}} and config.parse_yaml("") == {}
    spark.range(1000).coalesce(1).withColumnRenamed("id", "p_partkey").write.parquet(str(tmp_path / "part.parquet"))
    got = QUERIES["src4_model_config"](spark, str(tmp_path)).withColumn("task", F.spark_partition_id()).groupBy("task").count().collect()
    assert len(got) == 4 and sum(r["count"] for r in got) == 1000
    if yaml.__with_libyaml__:
        with pytest.raises(yaml.YAMLError) as e:
            config.parse_yaml("a: [")
        assert type(e.value.problem_mark).__module__ == "yaml._yaml"


def test_equal_configurations_are_read_once_a_batch(spark, tmp_path):
    """Each row has what its own text says; reading is counted in the worker."""
    spark.range(1000).withColumnRenamed("id", "p_partkey").write.parquet(str(tmp_path / "part.parquet"))
    seen = []
    got = part_settings(spark, str(tmp_path), F.concat(F.lit("n"), F.col("p_partkey") % 3), lambda x: seen.append(x) or [(x, len(seen)), (x, -len(seen))], "name string, reading int").collect()
    assert sorted((r.p_partkey, r.name) for r in got) == sorted((k, f"n{k % 3}") for k in range(1000) for _ in range(2))
    assert {r.reading for r in got} == {-3, -2, -1, 1, 2, 3}


def test_reports(spark, tmp_path):
    assert reports.report_name("json", datetime.datetime(2024, 1, 2, 3, 4, 5)) == "benchmark_20240102_030405.json"
    s = spark.createDataFrame([("Sync", 1.0), ("Sync", 3.0), ("Batch", 2.0)], "mode string, ms double")
    r = metrics.report(s, "mode", "ms", F.sum("ms")).select(*reports.COLUMNS)
    reports.write_csv(r, config.BenchmarkConfig(), str(tmp_path / "r.csv"))
    assert (tmp_path / "r.csv").read_text().count("#") == 11
    assert {x.mode: x.latency_avg_ms for x in reports.read_csv(spark, str(tmp_path / "r.csv")).collect()} == {"Sync": 2.0, "Batch": 2.0}
    assert [x.mode for x in r.orderBy(metrics.mode_rank(F.col("mode"))).collect()] == ["Sync", "Batch"]


def test_ring_and_closed_loop():
    assert schedule.ring_capacity(100) == 127 and schedule.ring_capacity(5) == 7
    calls = []
    latencies, wall = schedule.closed_loop(lambda: calls.append(1), 0.0, 5, warm_up=2)
    assert len(latencies) >= 5 and len(calls) == len(latencies) + 2 and wall >= sum(latencies)


def test_clients_and_reports_from_arguments(spark, tmp_path):
    calls = []
    latencies, _ = schedule.closed_loop(lambda: calls.append(threading.get_ident()) or time.sleep(0.002), 0.05, 10, clients=3)
    assert len(calls) == len(latencies) and len(set(calls)) == 3 and min(map(calls.count, set(calls))) >= 10
    images.write_png_files(picture(spark, np.zeros((4, 4, 3), np.uint8)), "request_id", "image", str(tmp_path / "png"))
    c = config.from_arguments(["--mode", "all", "--clients", "2", "--duration", "0", "--warmup", "0", "--min-iterations", "2", "--image", str(tmp_path / "png"), "--output-dir", str(tmp_path / "out")])
    got = benchmark.measure(spark, c, benchmark.detection(spark, c)).cache()
    assert {r.mode for r in got.collect()} == {"Sync", "Async", "Batch"} and all(r.total_requests >= 2 for r in got.collect())
    files = benchmark.export(got, c, datetime.datetime(2024, 1, 2))
    assert {r.concurrent_clients for r in reports.read_json(spark, str(tmp_path / "out")).collect()} == {2} and reports.read_csv(spark, files[1]).count() == 3


@pytest.mark.parametrize("threshold", [0.0, 0.45, 0.9])
def test_pairs_and_suppression_across_rows(spark, threshold):
    """Against every pair, and box by box: negative corners, boxes without area, equal scores, boxes over several cells."""
    rnd = random.Random(5)
    side = lambda: rnd.choice([0, 1, 50, rnd.randrange(700)])
    rows = [(rnd.randrange(3), k, rnd.choice([0.1, 0.2, rnd.random()]), rnd.randrange(-300, 600), rnd.randrange(-300, 600), side(), side()) for k in range(300)]
    df = spark.createDataFrame(rows, "g int, k long, score double, x long, y long, w long, h long")

    def alike(a, b):
        both = max(0, min(a[3] + a[5], b[3] + b[5]) - max(a[3], b[3])) * max(0, min(a[4] + a[6], b[4] + b[6]) - max(a[4], b[4]))
        whole = a[5] * a[6] + b[5] * b[6] - both
        return a[0] == b[0] and (both > threshold * whole if whole else 1.0 > threshold)

    area = lambda r: r[5] * r[6] > 0
    want = sorted((a[0], a[1], b[1]) for a in rows for b in rows if a[1] < b[1] and area(a) and area(b) and alike(a, b))
    for most in (1000, 7):
        got = [tuple(r) for r in detect.overlapping_pairs(df, "g", "k", threshold, most).select("g", "a_k", "b_k").collect()]
        assert sorted(got) == want
    flat = {g: [r[1] for r in rows if r[0] == g and not area(r)] for g in range(3)}
    assert sorted(map(tuple, detect.flat_classes(df, "g", "k").collect())) == [(g, min(k), max(k), len(k)) for g, k in flat.items()]
    stay = []
    for b in sorted(rows, key=lambda r: (-r[2], r[1])):
        if not any(alike(a, b) for a in stay):
            stay.append(b)
    for fold in (1024, 20):
        assert sorted(r.k for r in detect.suppress_groups(df, "g", ["k"], threshold, fold).collect()) == sorted(b[1] for b in stay)


def test_only_boxes_of_like_shape_and_place_are_compared(spark, monkeypatch):
    """With areas that let every pair through: what is compared then is near in shape and place, and has all pairs that overlap."""
    rnd = random.Random(7)
    rows = [(1, k, rnd.randrange(600), rnd.randrange(600), rnd.choice([20, 100, 280]), rnd.choice([20, 100, 280])) for k in range(300)]
    df = spark.createDataFrame(rows, "g int, k int, x int, y int, w int, h int")
    pairs = lambda: {(r.a_k, r.b_k) for r in detect.overlapping_pairs(df, "g", "k", 0.45).collect()}
    overlapping = pairs()
    for name in ("intersection", "union"):
        monkeypatch.setattr(detect, name, lambda a, b: F.lit(1).cast("bigint"))
    compared = pairs()
    assert 0 < len(overlapping) and overlapping <= compared
    for a, b in compared:
        for p, n in ((2, 4), (3, 5)):
            longest = max(rows[a][n], rows[b][n])
            assert rows[a][n] == rows[b][n] and abs(rows[a][p] - rows[b][p]) <= 0.55 * longest + 1


def test_every_pair_of_boxes_without_area(spark, tmp_path):
    """In slices of any size, and in the query: each of an image's n such boxes overlaps the n - 1 others."""
    rnd = random.Random(6)
    rows = [(k % 3 or None, k, rnd.randrange(-99, 99), rnd.randrange(-99, 99), *rnd.choice([(0, 0), (0, 9), (9, 0), (9, 9)])) for k in range(200)]
    df = spark.createDataFrame(rows, "g int, k long, x long, y long, w long, h long")
    want = [(a[0], a[1], b[1], 0, 0) for a in rows for b in rows if a[0] and a[0] == b[0] and a[1] < b[1] and a[4] * a[5] == b[4] * b[5] == 0]
    for most in (1000, 7):
        assert sorted(map(tuple, detect.flat_pairs(df, "g", "k", 0.45, most).collect())) == sorted(want)
    assert detect.flat_pairs(df, "g", "k", 1.0).count() == 0
    # sides of 0, and scores of 1 from the fifth part of the vector on
    spark.createDataFrame([(v, str(v % 2), [0.0] * 32 + [1.0] * 32) for v in range(6)], "vec_id long, label string, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = QUERIES["jn2_iou_pairs"](spark, str(tmp_path)).collect()
    assert len({(r.a_k, r.b_k) for r in got}) == len(got) == 2 * (24 * 23 // 2)


@pytest.mark.parametrize("n,fold", [(600, 6), (2400, detect.FOLD)])
def test_suppression_finds_few_of_many_pairs(spark, monkeypatch, n, fold):
    """Twelve places: all boxes of a place overlap each other, and one of them stays."""
    found = []

    def counted(df, name):
        table = session.written(df, name)
        found.append(table.count() if name == "pairs" else 0)
        return table

    monkeypatch.setattr(detect, "written", counted)
    rows = [(1, k, (k * 7919 % n) / n, 300 * (k % 12), k % 5, 100, 100 + k % 7) for k in range(n)]
    df = spark.createDataFrame(rows, "g int, k int, score double, x int, y int, w int, h int")
    kept = detect.suppress_groups(df, "g", ["k"], 0.45, fold).collect()
    assert sorted(r.k for r in kept) == sorted(max(rows[c::12], key=lambda r: (r[2], -r[1]))[1] for c in range(12))
    assert sum(found) <= n


@pytest.mark.parametrize("n", [60, 600])
def test_tables_do_not_grow_with_a_chain(spark, monkeypatch, n):
    """Each box overlaps the next and is better than it: every second one stays."""
    names = []
    monkeypatch.setattr(detect, "written", lambda df, name: names.append(name) or session.written(df, name))
    df = spark.createDataFrame([(1, k, 1.0 - k / 1000, 10 * k, 0, 20, 20) for k in range(n)], "g int, k int, score double, x int, y int, w int, h int")
    kept = detect.suppress_groups(df, "g", ["k"], 0.3, fold=n // 3)
    assert sorted(r.k for r in kept.collect()) == list(range(0, n, 2)) and len(names) <= 14


def test_optimized_copy_is_written(tmp_path):
    from framewright.operators.infer import OnnxBackend, read_model, write_optimized

    (tmp_path / "m.onnx").write_bytes(onnx_models.linear([[1.0], [2.0]]))
    write_optimized(str(tmp_path / "m.onnx"))
    model = read_model(str(tmp_path / "m.onnx"))
    assert (tmp_path / "optimized_m.onnx").read_bytes() == model
    assert OnnxBackend(model).infer(np.ones((1, 2), np.float32))["logits"].tolist() == [[3.0]]


def test_model_file_prefers_the_optimized_copy(tmp_path):
    from framewright.operators.infer import read_model

    (tmp_path / "m.onnx").write_bytes(b"plain")
    assert read_model(str(tmp_path / "m.onnx")) == b"plain"
    (tmp_path / "optimized_m.onnx").write_bytes(b"better")
    assert read_model(str(tmp_path / "m.onnx")) == b"better"


def test_batches_are_put_together_by_shape():
    from framewright.operators.infer import assembled

    rows = [(i, (2, i % 3) if i % 5 else None) for i in range(200)]
    parts = [rows[:7], rows[7:8], rows[8:150], rows[150:]]
    batches = [pa.RecordBatch.from_pydict({"id": [i for i, _ in p], "shape": pa.array([s and list(s) for _, s in p], pa.list_(pa.int32()))}) for p in parts]
    got = [(kind, b.column(0).to_pylist()) for kind, b in assembled(iter(batches), 8, 1)]
    assert sorted(i for _, ids in got for i in ids) == list(range(200)) and all(dict(rows)[i] == kind for kind, ids in got for i in ids)
    assert max(Counter(kind for kind, ids in got if len(ids) < 8).values()) == 1
    assert [b.num_rows for _, b in assembled(iter(batches), 64)] == [64, 64, 64, 8] and list(assembled(iter([]), 4)) == []


def test_table_function_reports_errors(spark):
    from framewright.operators.table_functions import register_detector

    c = config.ModelConfig("m", shape=(8, 8), classes=("a", "b"), auto_aspect_ratio=False)
    register_detector(spark, "detect_some", c, onnx_models.identity([3, 8, 8]), "y")
    kind = "id long, image struct<height:int,width:int,data:binary>, part int"
    good = np.random.default_rng(1).integers(0, 256, (8, 8, 3), dtype=np.uint8)
    spark.createDataFrame([(1, (8, 8, bytearray(good.tobytes())), 0), (2, (8, 8, bytearray(b"short")), 0), (3, None, 0)], kind).createOrReplaceTempView("some_pictures")
    got = spark.sql("select * from detect_some(table(some_pictures) partition by part)").collect()
    assert {r.id for r in got if r.error} == {2, 3} and [r for r in got if r.id == 1] and all(r.x is not None for r in got if r.id == 1)
    want = Detector(c, onnx_models.identity([3, 8, 8]), "y").run(picture(spark, good)).first().detections
    assert [(d.x, d.y, d.w, d.h, d.class_id) for d in want] == [(r.x, r.y, r.w, r.h, r.class_id) for r in got if r.id == 1]
    with pytest.raises(Exception, match="a key first and a picture"):
        spark.sql("select * from detect_some(table(select 1 as id))").collect()
