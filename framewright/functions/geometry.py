"""Column functions for image geometry, in 32-bit arithmetic where the results depend on it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _f32(x: Column) -> Column:
    return x.cast("float")


def _half_away(x: Column) -> Column:
    return F.round(x).cast("int")


def letterbox(w: Column, h: Column, dst_w: int, dst_h: int, auto: bool = True, stride: int = 32) -> Column:
    """(scale, new_w, new_h, pad_left, pad_top, pad_right, pad_bottom, error) for an image of w x h in a box.

    With ``auto`` the new size goes down to multiples of the stride, and scale and
    size are computed again from that.  A side of 0 is an error, not a box.
    """
    scale = _f32(F.least(_f32(F.lit(dst_w) / w), _f32(F.lit(dst_h) / h)))
    if auto:
        aligned_w, aligned_h = (x - x % stride for x in (_half_away(_f32(w * scale)), _half_away(_f32(h * scale))))
        scale = _f32(F.least(_f32(aligned_w / w), _f32(aligned_h / h)))
    new_w, new_h = _half_away(_f32(w * scale)), _half_away(_f32(h * scale))
    left, top = (F.floor((F.lit(d) - n) / 2).cast("int") for d, n in ((dst_w, new_w), (dst_h, new_h)))
    return F.struct(
        scale.alias("scale"), new_w.alias("new_w"), new_h.alias("new_h"), left.alias("pad_left"), top.alias("pad_top"),
        (F.lit(dst_w) - new_w - left).alias("pad_right"), (F.lit(dst_h) - new_h - top).alias("pad_bottom"),
        F.when((new_w == 0) | (new_h == 0), "image collapses").alias("error"),
    )


def center_pad(w: Column, h: Column, dst_w: int, dst_h: int) -> Column:
    """(pad_left, pad_top, pad_right, pad_bottom, error); a target that is smaller than the image is an error."""
    fits = (w <= dst_w) & (h <= dst_h)
    left, top = F.floor((F.lit(dst_w) - w) / 2).cast("int"), F.floor((F.lit(dst_h) - h) / 2).cast("int")
    parts = {"pad_left": left, "pad_top": top, "pad_right": dst_w - w - left, "pad_bottom": dst_h - h - top}
    return F.struct(*[F.when(fits, x).alias(n) for n, x in parts.items()], F.when(~fits, "target is smaller than the image").alias("error"))


def resize_shorter(w: Column, h: Column, side: int = 256, legacy: bool = False) -> Column:
    """(new_w, new_h) with the shorter side at ``side``; ``legacy`` rounds the factor to an integer first."""
    factor = _f32(F.lit(side) / F.least(w, h))
    if legacy:
        factor = F.round(factor).cast("int")
        return F.struct((w * factor).alias("new_w"), (h * factor).alias("new_h"))
    return F.struct(_half_away(_f32(w * factor)).alias("new_w"), _half_away(_f32(h * factor)).alias("new_h"))


def center_crop(w: Column, h: Column, crop_w: int = 224, crop_h: int = 224) -> Column:
    """(left, top, error); an image smaller than the crop is an error."""
    fits = (w >= crop_w) & (h >= crop_h)
    offset = lambda x, c: F.when(fits, F.floor((x - c) / 2).cast("int"))
    return F.struct(offset(w, crop_w).alias("left"), offset(h, crop_h).alias("top"), F.when(~fits, "image is smaller than the crop").alias("error"))


def square_pad(w: Column, h: Column, side: int = 640) -> Column:
    """(square, factor): the image stands top left in a square, which is resized to ``side``."""
    square = F.greatest(w, h)
    return F.struct(square.alias("square"), _f32(square / F.lit(side)).alias("factor"))


def decode_corners(cx: Column, cy: Column, w: Column, h: Column, scale: Column, pad_left: Column, pad_top: Column, orig_w: Column, orig_h: Column) -> Column:
    """Corners of a centre box in the original image: the letterbox undone, clamped to the image."""
    along = lambda c, half, pad, limit: F.greatest(F.lit(0.0), F.least(limit.cast("double"), (c + half - pad) / scale))
    return F.struct(
        along(cx, -0.5 * w, pad_left, orig_w).alias("x1"), along(cy, -0.5 * h, pad_top, orig_h).alias("y1"),
        along(cx, 0.5 * w, pad_left, orig_w).alias("x2"), along(cy, 0.5 * h, pad_top, orig_h).alias("y2"),
    )


def degenerate(box: Column) -> Column:
    return (box["x2"] <= box["x1"]) | (box["y2"] <= box["y1"])


def to_rect(box: Column, truncate: bool = False) -> Column:
    """Integer (x, y, w, h) from corners: each of the corner and the differences is rounded (or truncated)."""
    whole = (lambda x: x.cast("int")) if truncate else _half_away
    return F.struct(whole(box["x1"]).alias("x"), whole(box["y1"]).alias("y"), whole(box["x2"] - box["x1"]).alias("w"), whole(box["y2"] - box["y1"]).alias("h"))


def prototype_rect(cx: Column, cy: Column, w: Column, h: Column, factor_x: Column, factor_y: Column) -> Column:
    """Truncated box scaled by a factor for each axis, without clamping."""
    part = lambda x: x.cast("int")
    return F.struct(part((cx - 0.5 * w) * factor_x).alias("x"), part((cy - 0.5 * h) * factor_y).alias("y"), part(w * factor_x).alias("w"), part(h * factor_y).alias("h"))
