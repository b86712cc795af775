"""Detection as a table function: pictures in, boxes out, from SQL text.

``select * from detect_images(table(select id, image, part from pictures) partition by part)``: the function
runs letterbox, planes, model, decoding and suppression over batches within each partition of its table, so the column that
the table is partitioned by deals the work.  A picture that fails gives one row with its error.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, udtf
from pyspark.sql.types import FloatType, IntegerType, StringType, StructType

from framewright.config import ModelConfig
from framewright.operators import pixels
from framewright.operators.infer import open_backend


def boxes_of(y: np.ndarray, fit: tuple, config: ModelConfig) -> list[tuple[int, int, int, int, float, int]]:
    """(x, y, w, h, score, class) of an output [4 + classes, anchors] that stay, best first; ``fit`` is (scale, left, top, width, height)."""
    scale, left, top, width, height = fit
    y = y.reshape(4 + len(config.classes), -1).astype(np.float64)
    along = lambda c, half, pad, limit: np.clip((c + half - pad) / np.float64(np.float32(scale)), 0, limit)
    x1, y1, x2, y2 = (along(y[a], sign * 0.5 * y[a + 2], pad, limit) for sign in (-1, 1) for a, pad, limit in ((0, left, width), (1, top, height)))
    score = y[4:].max(0)
    good = np.flatnonzero((score > config.conf) & (score > 0) & (x2 > x1) & (y2 > y1))
    whole = np.floor(np.stack((x1, y1, x2 - x1, y2 - y1))[:, good] + 0.5).astype(np.int64)
    kept: list[tuple] = []
    for k in np.lexsort((good, -score[good])):
        a = whole[:, k]

        def overlaps(b: tuple, a=a) -> bool:
            both = max(0, min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0])) * max(0, min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1]))
            union = a[2] * a[3] + b[2] * b[3] - both
            return bool(both > config.nms * union if union else config.nms < 1)

        if not any(overlaps(b) for b in kept):
            kept.append((*map(int, a), float(np.float32(score[good[k]])), int(y[4:, good[k]].argmax())))
    return kept


@dataclass
class Analyzed(AnalyzeResult):
    """The result's schema, and which column has the pictures."""

    image: str = ""


def register_detector(spark: SparkSession, name: str, config: ModelConfig, model: bytes, output: str) -> None:
    """Registers a table function over (key, image struct, further columns): its rows are (key, x, y, w, h, score, class_id, label, error)."""

    @udtf
    class Detect:
        @staticmethod
        def analyze(images: AnalyzeArgument) -> AnalyzeResult:
            if not images.isTable:
                raise ValueError("the argument is a table of pictures")
            fields = images.dataType.fields
            image = next((f.name for f in fields if isinstance(f.dataType, StructType) and {"height", "width", "data"} <= set(f.dataType.names)), None)
            if image is None or fields[0].name == image:
                raise ValueError("the table has a key first and a picture (height, width, data)")
            out = StructType().add(fields[0].name, fields[0].dataType)
            for column in ("x", "y", "w", "h"):
                out = out.add(column, IntegerType())
            return Analyzed(out.add("score", FloatType()).add("class_id", IntegerType()).add("label", StringType()).add("error", StringType()), image=image)

        def __init__(self, analyzed: Analyzed):
            self.image = analyzed.image
            self.waiting: list[tuple] = []

        def eval(self, row):
            image, (h, w) = row[self.image], config.shape
            try:
                if image is None:
                    raise ValueError("no picture")
                fitted, fit = pixels.letterbox(np.frombuffer(image.data, np.uint8).reshape(image.height, image.width, 3), w, h, config.auto_aspect_ratio, config.pad_color)
                self.waiting.append((row[0], pixels.to_planes(fitted, config.bgr_to_rgb), fit))
            except (ValueError, TypeError) as e:
                yield (row[0], None, None, None, None, None, None, None, str(e))
            if len(self.waiting) >= config.batch:
                yield from self.run()

        def terminate(self):
            if self.waiting:
                yield from self.run()

        def run(self):
            batch, self.waiting = self.waiting, []
            try:
                found = open_backend("onnxruntime", model, config.session_options).infer(np.stack([planes for _, planes, _ in batch]))[output]
            except Exception as e:  # noqa: BLE001  the rows of this batch carry it
                yield from ((key, None, None, None, None, None, None, None, f"{type(e).__name__}: {e}"[:500]) for key, _, _ in batch)
                return
            for (key, _, fit), y in zip(batch, found):
                for *box, score, label in boxes_of(y, fit, config):
                    yield (key, *box, score, label, config.classes[label], None)

    spark.udtf.register(name, Detect)
