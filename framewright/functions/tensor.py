"""Column functions over small dense tensors: flat, row-major arrays.

They stay in the JVM.  For real images use ``operators.pixels``, which works on
Arrow batches with numpy.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tensor(data: Column, shape: Column) -> Column:
    return F.struct(data.cast("array<float>").alias("data"), shape.cast("array<bigint>").alias("shape"))


def elements(shape: Column) -> Column:
    """Product of the dimensions; 1 for no dimensions."""
    return F.aggregate(shape.cast("array<bigint>"), F.lit(1).cast("bigint"), lambda a, x: a * x)


def plane_size(shape: Column) -> Column:
    """Elements of one batch item."""
    return F.floor(elements(shape) / shape[0]).cast("bigint")


def byte_size(shape: Column, width: int = 4) -> Column:
    return elements(shape) * width


def batch_item(data: Column, item: int, plane: int) -> Column:
    return F.slice(data, item * plane + 1, plane)


def transpose(data: Column, rows: int, columns: int) -> Column:
    """[rows, columns] to [columns, rows]."""
    j = F.sequence(F.lit(0), F.lit(rows * columns - 1))
    return F.transform(j, lambda x: data[((x % rows) * columns + F.floor(x / rows)).cast("int")])


def swap_channels(data: Column, size: int) -> Column:
    """Reverse the three channels of an HWC image of ``size`` pixels."""
    return F.transform(F.sequence(F.lit(0), F.lit(3 * size - 1)), lambda j: data[(j - j % 3 + 2 - j % 3).cast("int")])


def normalize(data: Column, scale: float = 1 / 255) -> Column:
    return F.transform(data, lambda x: (x * F.lit(scale)).cast("float"))


def hwc_to_chw(data: Column, size: int, swap: bool = True) -> Column:
    """Pixels of a three-channel HWC image as planes, with the channels reversed if asked."""

    def at(j: Column) -> Column:
        channel = F.floor(j / size)
        return data[((j % size) * 3 + (2 - channel if swap else channel)).cast("int")]

    return F.transform(F.sequence(F.lit(0), F.lit(3 * size - 1)), at)


def convert_and_normalize(data: Column, size: int, scale: float = 1 / 255, swap: bool = True) -> Column:
    return normalize(hwc_to_chw(data, size, swap), scale)


def standardize(data: Column, size: int, mean: tuple, std: tuple) -> Column:
    """Planes of u8 values to (x / 255 - mean) / std for each channel."""
    means, stds = F.array(*map(F.lit, mean)), F.array(*map(F.lit, std))
    return F.transform(data, lambda x, i: (x / 255 - means[F.floor(i / size).cast("int")]) / stds[F.floor(i / size).cast("int")])


def denormalize(data: Column) -> Column:
    """Values in [0, 1] to u8, clamped, half up."""
    return F.transform(data, lambda v: F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)) * 255 + 0.5).cast("int"))


def crop_to_hwc(data: Column, height: int, width: int, top: int, left: int, new_height: int, new_width: int) -> Column:
    """Cut a window out of three RGB planes and give it as an HWC image in BGR."""
    size = height * width

    def at(j: Column) -> Column:
        pixel, channel = F.floor(j / 3), j % 3
        row, column = F.floor(pixel / new_width) + top, pixel % new_width + left
        return data[((2 - channel) * size + row * width + column).cast("int")]

    return F.transform(F.sequence(F.lit(0), F.lit(3 * new_height * new_width - 1)), at)


def argmax(scores: Column) -> Column:
    """Position of the first largest value, from 0."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def best_class(scores: Column) -> Column:
    """(score, class_id) from a start of (0, 0): only a larger score wins, and the first of equals."""
    top = F.array_max(scores)
    return F.struct(F.greatest(F.lit(0.0).cast("double"), top).alias("score"), F.when(top > 0, argmax(scores)).otherwise(0).cast("int").alias("class_id"))


def layout(shape: Column, height: int, width: int) -> Column:
    """Input shape as NCHW: channels are 1, 3 or 4, else the shape is an error; a height other than 0 gives way to the configured size."""
    channel = lambda x: x.isin(1, 3, 4)
    put = lambda n, c, h, w: F.array(n, c, F.when(h != 0, F.lit(height)).otherwise(h), F.when(h != 0, F.lit(width)).otherwise(w)).cast("array<bigint>")
    s = [shape[i] for i in range(4)]
    known = F.when(channel(s[1]), put(s[0], s[1], s[2], s[3])).when(channel(s[3]), put(s[0], s[3], s[1], s[2]))
    return F.when(F.size(shape) == 4, known)
