"""A container of frames in order, as a batch and streaming source and a batch sink.

A container is a folder of ``.frames`` files, each with its frames one after the other and an index behind
them: number, place, height and width of each.  Files are named by their first frame, so their order is the frames' order.
A reader knows all frames from the indexes, and tasks read byte ranges.  A stream's offset is the number of frames
that it has given, so it can stop between any two; frames of files that come later follow.
"""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from framewright.sources.shared_files import AttemptWriter, located

MAGIC, SCHEMA = b"FRAMES01", "number long, height int, width int, data binary"
ENTRY = np.dtype([("number", "<i8"), ("at", "<i8"), ("size", "<i8"), ("height", "<i4"), ("width", "<i4")])
#: Bytes of frames that a task reads, unless one frame is larger.
SPLIT = 32 << 20


class FrameWriter(AttemptWriter):
    """One file for each task, whose rows come in order of number."""

    def fill(self, system, folder, batches):
        index, name = [], f"{folder}/frames"
        with system.open_output_stream(name) as out:
            out.write(MAGIC)
            at, last = len(MAGIC), None
            for batch in batches:
                for number, height, width, data in zip(*(batch.column(i).to_pylist() for i in range(4))):
                    if number is None or last is not None and number <= last:
                        raise ValueError(f"frame {number} after {last}")
                    out.write(data)
                    index.append((number, at, len(data), height, width))
                    at, last = at + len(data), number
            out.write(np.array(index, ENTRY).tobytes())
            out.write(struct.pack("<qq", len(index), at) + MAGIC)
        return name, f"{index[0][0]:020d}-{uuid.uuid4().hex}.frames" if index else None


def read_index(system: fs.FileSystem, path: str) -> np.ndarray:
    """The frames of a file."""
    tail = struct.calcsize("<qq") + len(MAGIC)
    with system.open_input_file(path) as f:
        f.seek(f.size() - tail)
        count, at = struct.unpack("<qq", (end := f.read(tail))[:-8])
        if end[-8:] != MAGIC:
            raise ValueError(f"{path} is not a container of frames")
        f.seek(at)
        return np.frombuffer(f.read(count * ENTRY.itemsize), ENTRY)


@dataclass
class Range(InputPartition):
    """Frames of one file that stand one after the other."""

    path: str
    index: bytes


class Container:
    """The files of a container and their frames; an index is read once."""

    def __init__(self, path: str):
        self.path, self.known = path, {}

    def indexes(self) -> list[tuple[str, np.ndarray]]:
        system, path = located(self.path)
        for f in system.get_file_info(fs.FileSelector(path, allow_not_found=True)):
            if f.path.endswith(".frames") and f.path not in self.known:
                self.known[f.path] = read_index(system, f.path)
        return sorted(self.known.items())

    def count(self) -> int:
        return sum(len(x) for _, x in self.indexes())

    def ranges(self, start: int, end: int) -> list[Range]:
        """The frames from ``start`` to before ``end``, in byte ranges of about ``SPLIT``."""
        out, before = [], 0
        for path, index in self.indexes():
            ours = index[max(0, start - before) : max(0, end - before)]
            before += len(index)
            if len(ours):
                part = (ours["at"] - ours["at"][0]) // SPLIT
                out += [Range(path, x.tobytes()) for x in np.split(ours, np.flatnonzero(np.diff(part)) + 1)]
        return out

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        system, index = located(self.path)[0], np.frombuffer(part.index, ENTRY)
        with system.open_input_file(part.path) as f:
            for some in np.array_split(index, max(1, int(index["size"].sum()) // (8 << 20))):
                if len(some):
                    f.seek(int(some["at"][0]))
                    held = f.read(int(some["size"].sum()))
                    at = some["at"] - some["at"][0]
                    data = [held[a : a + n] for a, n in zip(at.tolist(), some["size"].tolist())]
                    yield pa.RecordBatch.from_pydict({"number": pa.array(some["number"]), "height": pa.array(some["height"]), "width": pa.array(some["width"]), "data": pa.array(data, pa.binary())})


class FrameReader(DataSourceReader):
    def __init__(self, path: str):
        self.container = Container(path)

    def partitions(self) -> list[Range]:
        return self.container.ranges(0, self.container.count())

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return self.container.read(partition) if isinstance(partition, Range) else iter(())


class FrameStream(DataSourceStreamReader):
    """Offsets are numbers of frames; a trigger gets at most ``per_trigger`` more.  ``first``: how many frames were given before a restart."""

    def __init__(self, path: str, per_trigger: int, first: int):
        self.container, self.per_trigger, self.offered = Container(path), per_trigger, first

    def initialOffset(self) -> dict:  # noqa: N802
        return {"frame": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        self.offered = min(self.offered + self.per_trigger, max(self.offered, self.container.count()))
        return {"frame": self.offered}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        self.offered = max(self.offered, end["frame"])
        return self.container.ranges(start["frame"], end["frame"])

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return self.container.read(partition)

    def commit(self, end: dict) -> None:
        pass


class FrameSource(DataSource):
    """``frames``: option ``path``; for a stream ``per_trigger`` and ``first``."""

    @classmethod
    def name(cls) -> str:
        return "frames"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> FrameReader:
        return FrameReader(self.options["path"])

    def streamReader(self, schema: StructType) -> FrameStream:  # noqa: N802
        return FrameStream(self.options["path"], int(self.options.get("per_trigger", 1 << 40)), int(self.options.get("first", 0)))

    def writer(self, schema: StructType, overwrite: bool) -> FrameWriter:
        return FrameWriter(dict(self.options))


def write_frames(df: DataFrame, path: str, number: str, image: str) -> None:
    """Image structs as a container, or more frames for one; numbers are unique, and more frames have higher ones."""
    df.sparkSession.dataSource.register(FrameSource)
    rows = df.select(F.col(number).cast("long").alias("number"), *[F.col(image)[c].alias(c) for c in ("height", "width", "data")])
    rows.repartitionByRange("number").sortWithinPartitions("number").write.format("frames").option("path", path).mode("append").save()


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """(number, height, width, data) of a container."""
    spark.dataSource.register(FrameSource)
    return spark.read.format("frames").option("path", path).load()


def given(checkpoint: str) -> int:
    """How many frames a stream with this checkpoint has planned to give."""
    system, path = located(checkpoint)
    logs = [f for f in system.get_file_info(fs.FileSelector(f"{path}/offsets", allow_not_found=True)) if f.base_name.isdigit()]
    if not logs:
        return 0
    with system.open_input_stream(max(logs, key=lambda f: int(f.base_name)).path) as f:
        return json.loads(f.read().decode().strip().split("\n")[-1])["frame"]


def stream_frames(spark: SparkSession, path: str, per_trigger: int | None = None, checkpoint: str | None = None) -> DataFrame:
    """The same as a stream, in order.  A stream with a limit names the checkpoint that it is written with, to go on from there."""
    spark.dataSource.register(FrameSource)
    reader = spark.readStream.format("frames").option("path", path).option("first", given(checkpoint) if checkpoint else 0)
    return (reader.option("per_trigger", per_trigger) if per_trigger else reader).load()
