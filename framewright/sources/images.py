"""Image files: Spark's image source, and a PNG writer of the standard library."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.sources.shared_files import write_files

#: The image source's number for three channels of 8 bits in BGR order.
BGR = 16


def read_images(spark: SparkSession, path: str, skip_broken: bool = False) -> DataFrame:
    """(image) for each file: origin, height, width, nChannels, mode and BGR data; broken files have a height of -1 or are skipped."""
    return spark.read.format("image").option("dropInvalid", str(skip_broken).lower()).option("recursiveFileLookup", "true").load(path)


def require_decoded(images: DataFrame) -> DataFrame:
    """Fails on an image that could not be decoded."""
    broken = (F.col("image.height") <= 0) | F.col("image.data").isNull()
    return images.withColumn("image", F.when(broken, F.raise_error(F.concat(F.lit("cannot decode "), F.col("image.origin")))).otherwise(F.col("image")))


def stream_images(spark: SparkSession, folder: str, most_files: int = 100) -> DataFrame:
    """Frames as they arrive in a folder: (path, content), at most so many files a batch."""
    return spark.readStream.format("binaryFile").option("maxFilesPerTrigger", most_files).option("recursiveFileLookup", "true").schema("path string, modificationTime timestamp, length long, content binary").load(folder)


def png(image: np.ndarray) -> bytes:
    """An HWC picture (BGR, u8) as a PNG file."""
    h, w = image.shape[:2]
    rows = np.zeros((h, 1 + 3 * w), np.uint8)
    rows[:, 1:] = image[:, :, ::-1].reshape(h, 3 * w)
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(rows.tobytes())) + part(b"IEND", b"")


def as_png(df: DataFrame, key: str, image: str) -> DataFrame:
    """(key, png) from image structs."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            rows = [png(np.frombuffer(d, np.uint8).reshape(h, w, 3)) for h, w, d in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], names=[key, "png"])

    return df.select(F.col(key), F.col(f"{image}.height"), F.col(f"{image}.width"), F.col(f"{image}.data")).mapInArrow(run, f"{key} {kind}, png binary")


def write_png_files(df: DataFrame, key: str, image: str, folder: str) -> None:
    """A file ``<key>.png`` for each row below a shared folder; all of them or none."""
    write_files(as_png(df, key, image).select(F.concat(F.col(key).cast("string"), F.lit(".png")).alias("name"), F.col("png").alias("content")), folder)
