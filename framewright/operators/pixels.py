"""Pixels with numpy, one Arrow batch at a time: resize, pad, crop, planes."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def resize(image: np.ndarray, width: int, height: int) -> np.ndarray:
    """Bilinear, with half-pixel centres and clamped edges; u8 in and out."""
    h, w = image.shape[:2]

    def axis(n: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.clip((np.arange(m) + 0.5) * (n / m) - 0.5, 0, n - 1)
        low = np.floor(at).astype(int)
        return low, np.minimum(low + 1, n - 1), at - low

    (y0, y1, fy), (x0, x1, fx) = axis(h, height), axis(w, width)
    src, fx, fy = image.astype(np.float64), fx[None, :, None], fy[:, None, None]
    rows = lambda y: src[y][:, x0] * (1 - fx) + src[y][:, x1] * fx
    return np.floor(rows(y0) * (1 - fy) + rows(y1) * fy + 0.5).astype(np.uint8)


def letterbox_size(w: int, h: int, dst_w: int, dst_h: int, auto: bool = True, stride: int = 32) -> tuple[float, int, int, int, int]:
    """(scale, new width, new height, left, top) in 32-bit arithmetic; the columns of ``functions.geometry`` give the same."""
    f = np.float32
    near = lambda x: int(np.floor(np.float64(x) + 0.5))
    scale = min(f(dst_w) / f(w), f(dst_h) / f(h))
    if auto:
        new_w, new_h = (n - n % stride for n in (near(f(w) * scale), near(f(h) * scale)))
        scale = min(f(new_w) / f(w), f(new_h) / f(h))
    new_w, new_h = near(f(w) * scale), near(f(h) * scale)
    if not new_w or not new_h:
        raise ValueError("image collapses")
    return float(scale), new_w, new_h, (dst_w - new_w) // 2, (dst_h - new_h) // 2


def letterbox(image: np.ndarray, dst_w: int, dst_h: int, auto: bool = True, color: tuple = (114, 114, 114)) -> tuple[np.ndarray, tuple]:
    """The image in a box of one colour, and (scale, left, top, original width, original height)."""
    h, w = image.shape[:2]
    scale, new_w, new_h, left, top = letterbox_size(w, h, dst_w, dst_h, auto)
    out = np.empty((dst_h, dst_w, 3), np.uint8)
    out[:] = color
    out[top : top + new_h, left : left + new_w] = image if (new_w, new_h) == (w, h) else resize(image, new_w, new_h)
    return out, (scale, left, top, w, h)


def pad_to(image: np.ndarray, dst_w: int, dst_h: int, color: tuple = (114, 114, 114)) -> tuple[np.ndarray, tuple]:
    """The image in the middle of a larger one."""
    h, w = image.shape[:2]
    if w > dst_w or h > dst_h:
        raise ValueError("target is smaller than the image")
    left, top = (dst_w - w) // 2, (dst_h - h) // 2
    out = np.empty((dst_h, dst_w, 3), np.uint8)
    out[:] = color
    out[top : top + h, left : left + w] = image
    return out, (1.0, left, top, w, h)


def square(image: np.ndarray, side: int) -> np.ndarray:
    """Zero padding to a square with the image top left, then resized."""
    h, w = image.shape[:2]
    out = np.zeros((max(h, w), max(h, w), 3), np.uint8)
    out[:h, :w] = image
    return resize(out, side, side)


def classifier_crop(image: np.ndarray, shorter: int = 256, crop: int = 224) -> np.ndarray:
    h, w = image.shape[:2]
    factor = np.float32(shorter) / np.float32(min(w, h))
    near = lambda n: int(np.floor(np.float64(np.float32(n) * factor) + 0.5))
    image = resize(image, near(w), near(h))
    left, top = (image.shape[1] - crop) // 2, (image.shape[0] - crop) // 2
    return image[top : top + crop, left : left + crop]


def to_planes(image: np.ndarray, swap: bool = True, mean: tuple | None = None, std: tuple | None = None) -> np.ndarray:
    """HWC u8 to CHW float in [0, 1], channels reversed if asked, standardized if mean and std are given."""
    planes = (image[:, :, ::-1] if swap else image).transpose(2, 0, 1).astype(np.float32) * np.float32(1 / 255)
    if mean is not None:
        planes = (planes - np.array(mean, np.float32)[:, None, None]) / np.array(std, np.float32)[:, None, None]
    return np.ascontiguousarray(planes, np.float32)


def from_planes(planes: np.ndarray, left: int, top: int, width: int, height: int) -> np.ndarray:
    """RGB planes in [0, 1] to a BGR image, cut out of its padding."""
    u8 = np.floor(np.clip(planes, 0, 1) * 255 + 0.5).astype(np.uint8)
    return np.ascontiguousarray(u8[:, top : top + height, left : left + width].transpose(1, 2, 0)[:, :, ::-1])


def draw_box(image: np.ndarray, x: int, y: int, w: int, h: int, color: tuple = (0, 255, 0)) -> np.ndarray:
    """A copy with the outline of a box."""
    out, (rows, columns) = image.copy(), image.shape[:2]
    x0, y0, x1, y1 = max(0, x), max(0, y), min(columns - 1, x + w), min(rows - 1, y + h)
    if x0 <= x1 and y0 <= y1:
        out[y0, x0 : x1 + 1] = out[y1, x0 : x1 + 1] = color
        out[y0 : y1 + 1, x0] = out[y0 : y1 + 1, x1] = color
    return out


def drawn(df: DataFrame, key: str, image: str, box: str, color: tuple = (0, 255, 0)) -> DataFrame:
    """(key, height, width, data): image structs with the outlines of their arrays of boxes (x, y, w, h)."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            out = []
            for h, w, data, boxes in zip(*(batch.column(i).to_pylist() for i in range(1, 5))):
                picture = np.frombuffer(data, np.uint8).reshape(h, w, 3)
                for b in boxes or ():
                    picture = draw_box(picture, b["x"], b["y"], b["w"], b["h"], color)
                out.append(picture.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(out, pa.binary())], names=[key, "height", "width", "data"])

    return df.select(key, F.col(f"{image}.height"), F.col(f"{image}.width"), F.col(f"{image}.data"), box).mapInArrow(run, f"{key} {kind}, height int, width int, data binary")


def preprocess(df: DataFrame, key: str, image: str, fit: Callable[[np.ndarray], tuple[np.ndarray, tuple]], swap: bool = True) -> DataFrame:
    """(key, data, scale, pad_left, pad_top, orig_w, orig_h, error) from image structs (height, width, data: BGR bytes).

    ``fit`` puts a picture into the model's size.  A picture that can't be fitted
    gives an error row.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            rows = []
            for h, w, data in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
                try:
                    fitted, (scale, left, top, ow, oh) = fit(np.frombuffer(data, np.uint8).reshape(h, w, 3))
                    rows.append((to_planes(fitted, swap).reshape(-1), scale, left, top, ow, oh, None))
                except (ValueError, TypeError) as e:
                    rows.append((None, None, None, None, w, h, str(e)))
            c = list(zip(*rows)) or [()] * 7
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(c[0], pa.list_(pa.float32())), pa.array(c[1], pa.float32()), *(pa.array(c[i], pa.int32()) for i in (2, 3, 4, 5)), pa.array(c[6], pa.string()),
            ], names=[key, "data", "scale", "pad_left", "pad_top", "orig_w", "orig_h", "error"])

    picked = df.select(F.col(key), F.col(f"{image}.height"), F.col(f"{image}.width"), F.col(f"{image}.data"))
    return picked.mapInArrow(run, f"{key} {kind}, data array<float>, scale float, pad_left int, pad_top int, orig_w int, orig_h int, error string")


def restore(df: DataFrame, key: str, planes: str, height: int, width: int) -> DataFrame:
    """(key, height, width, data, error) from restored planes and their padding columns; a row without planes has only its error."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            rows = [
                (None, None, None) if p is None else (h, w, from_planes(np.array(p, np.float32).reshape(3, height, width), left, top, w, h).tobytes())
                for p, left, top, w, h in zip(*(batch.column(i).to_pylist() for i in range(1, 6)))
            ]
            c = list(zip(*rows)) or [()] * 3
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(c[0], pa.int32()), pa.array(c[1], pa.int32()), pa.array(c[2], pa.binary()), batch.column(6)], names=[key, "height", "width", "data", "error"])

    return df.select(key, planes, "pad_left", "pad_top", "orig_w", "orig_h", "error").mapInArrow(run, f"{key} {kind}, height int, width int, data binary, error string")
