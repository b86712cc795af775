"""Containers of frames and files that appear together or not at all."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewright.sources import frames, images
from framewright.sources.shared_files import write_files
from framewright.streaming import schedule

KIND = "number long, image struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>"


def movie(spark, numbers):
    rng = np.random.default_rng(1)
    sizes = {n: (1 + n % 5, 2 + n % 3) for n in numbers}
    data = {n: rng.integers(0, 256, (*sizes[n], 3), dtype=np.uint8).tobytes() for n in numbers}
    df = spark.createDataFrame([(n, ("", *sizes[n], 3, images.BGR, bytearray(data[n]))) for n in numbers], KIND)
    return df, [(n, *sizes[n], data[n]) for n in sorted(numbers)]


def rows(df):
    return [(r.number, r.height, r.width, bytes(r.data)) for r in df.collect()]


def test_container(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "c")
    df, want = movie(spark, [*range(50), *range(70, 90)][::-1])
    frames.write_frames(df.repartition(3), path, "number", "image")
    assert sorted(rows(frames.read_frames(spark, path))) == want
    more, later = movie(spark, range(100, 110))
    frames.write_frames(more, path, "number", "image")
    assert sorted(rows(frames.read_frames(spark, path))) == want + later
    monkeypatch.setattr(frames, "SPLIT", 100)
    container = frames.Container(path)
    ranges = container.ranges(10, 75)
    assert container.count() == 80 and len(ranges) > 5
    assert [(n, h, w, d) for r in ranges for b in container.read(r) for n, h, w, d in zip(*(c.to_pylist() for c in b.columns))] == (want + later)[10:75]
    assert not (tmp_path / "c" / "_temporary").exists() or not any((tmp_path / "c" / "_temporary").iterdir())


def test_stream_of_frames_in_triggers(spark, tmp_path):
    path = str(tmp_path / "c")
    df, want = movie(spark, range(40))
    frames.write_frames(df, path, "number", "image")
    stream = frames.stream_frames(spark, path, 12)
    assert schedule.drain_triggers(stream, str(tmp_path / "out"), str(tmp_path / "check")) == 4
    assert sorted(rows(spark.read.parquet(str(tmp_path / "out")))) == want
    more, later = movie(spark, range(60, 65))  # the same stream goes on where it was
    frames.write_frames(more, path, "number", "image")
    schedule.drain_triggers(frames.stream_frames(spark, path, 2, str(tmp_path / "check")), str(tmp_path / "out"), str(tmp_path / "check"))
    assert sorted(rows(spark.read.parquet(str(tmp_path / "out")))) == want + later


def test_empty_and_broken_containers(spark, tmp_path):
    df, _ = movie(spark, [])
    frames.write_frames(df, str(tmp_path / "none"), "number", "image")
    assert frames.read_frames(spark, str(tmp_path / "none")).count() == 0
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "x.frames").write_bytes(b"no frames at all, just some text")
    with pytest.raises(Exception, match="not a container"):
        frames.read_frames(spark, str(tmp_path / "bad")).count()
    twice = movie(spark, [1, 2])[0]
    with pytest.raises(Exception, match="frame 1 after 1"):
        frames.write_frames(twice.unionAll(twice).coalesce(1), str(tmp_path / "twice"), "number", "image")


def test_a_failed_job_leaves_no_file(spark, tmp_path):
    good = spark.range(40).select(F.concat("id", F.lit(".txt")).alias("name"), F.col("id").cast("string").cast("binary").alias("content"))
    write_files(good.repartition(4), str(tmp_path / "good"))
    assert sorted(int(f.stem) for f in (tmp_path / "good").rglob("*.txt")) == list(range(40))
    bad = good.withColumn("name", F.when(F.col("name") == "37.txt", "a/b").otherwise(F.col("name")))
    with pytest.raises(Exception, match="not a file name"):
        write_files(bad.repartition(4), str(tmp_path / "bad"))
    assert not [f for f in (tmp_path / "bad").rglob("*") if f.is_file()]
