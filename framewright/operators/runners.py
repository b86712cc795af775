"""Runners: preprocess, infer and postprocess as DataFrame transformations.

``Detector``, ``Classifier`` and ``Restorer`` share one shape, and every stage is a
function from a DataFrame to a DataFrame.  Any runner works in every execution mode.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.config import ModelConfig
from framewright.functions import geometry
from framewright.functions.tensor import argmax
from framewright.operators import detect, pixels
from framewright.operators.infer import infer

# Fixed values of the usual colour statistics for classifiers.
MEAN = (0.485, 0.456, 0.406)
STD = (0.229, 0.224, 0.225)


@dataclass(frozen=True)
class Runner:
    config: ModelConfig
    model: bytes
    output: str
    key: str = "request_id"

    def preprocess(self, images: DataFrame) -> DataFrame:
        raise NotImplementedError

    def postprocess(self, rows: DataFrame) -> DataFrame:
        raise NotImplementedError

    def input_shape(self) -> tuple[int, ...]:
        return (3, *self.config.shape)

    def infer(self, rows: DataFrame) -> DataFrame:
        """The model's output in place of ``data``, in one pass; rows that failed before or in the model carry an ``error``."""
        keep = tuple(c for c in rows.columns if c not in (self.key, "data", "error"))
        return infer(rows, self.key, "data", self.input_shape(), self.model, self.output, self.config.batch, self.config.session_options, keep=keep)

    def run(self, images: DataFrame) -> DataFrame:
        return self.postprocess(self.infer(self.preprocess(images)))


class Detector(Runner):
    def preprocess(self, images: DataFrame) -> DataFrame:
        (h, w), auto, color = self.config.shape, self.config.auto_aspect_ratio, self.config.pad_color
        return pixels.preprocess(images, self.key, "image", lambda x: pixels.letterbox(x, w, h, auto, color), self.config.bgr_to_rgb)

    def postprocess(self, rows: DataFrame) -> DataFrame:
        """(key, detections, error): one row for each request, with an array of boxes."""
        attributes, conf, nms, labels = 4 + len(self.config.classes), self.config.conf, self.config.nms, self.config.classes
        names = F.array(*map(F.lit, labels))

        def found(y: Column) -> Column:
            count = F.floor(F.size(y) / attributes).cast("int")

            def anchor(i: Column) -> Column:
                at = [y[(F.lit(a) * count + i).cast("int")].cast("double") for a in range(attributes)]
                scores = F.array(*at[4:])
                box = geometry.decode_corners(*at[:4], F.col("scale"), F.col("pad_left"), F.col("pad_top"), F.col("orig_w"), F.col("orig_h"))
                return F.struct((-F.array_max(scores)).alias("neg"), i.alias("i"), argmax(scores).alias("class_id"), box.alias("box"))

            # decoding takes scores from the threshold on, and suppression only those above it
            good = F.filter(F.transform(F.sequence(F.lit(0), count - 1), anchor), lambda d: (-d["neg"] > conf) & (-d["neg"] > 0) & ~geometry.degenerate(d["box"]))
            rect = lambda d: F.struct(d["neg"], d["i"], d["class_id"], *[geometry.to_rect(d["box"])[p].alias(p) for p in ("x", "y", "w", "h")])
            return F.sort_array(F.transform(good, rect))

        def once(value: Column, body) -> Column:
            """Binds a value to a name, so that it is computed once however often the body uses it."""
            return F.transform(F.array(value), body)[0]

        label = lambda d: F.struct(d["x"], d["y"], d["w"], d["h"], (-d["neg"]).cast("float").alias("score"), d["class_id"], F.try_element_at(names, d["class_id"] + 1).alias("label"))
        final = once(F.col(self.output), lambda y: once(found(y), lambda boxes: F.transform(detect.suppress(boxes, nms), label)))
        return rows.select(self.key, F.when(F.col("error").isNull(), final).alias("detections"), "error")


class Classifier(Runner):
    def preprocess(self, images: DataFrame) -> DataFrame:
        h, w = self.config.shape
        side = max(h, w) * 256 // 224

        def fit(image: np.ndarray) -> tuple[np.ndarray, tuple]:
            return pixels.classifier_crop(image, side, h), (1.0, 0, 0, image.shape[1], image.shape[0])

        rows = pixels.preprocess(images, self.key, "image", fit, True)
        means, stds = F.array(*map(F.lit, MEAN)), F.array(*map(F.lit, STD))
        channel = lambda i: F.floor(i / (h * w)).cast("int")
        return rows.withColumn("data", F.transform("data", lambda x, i: ((x - means[channel(i)]) / stds[channel(i)]).cast("float")))

    def postprocess(self, rows: DataFrame) -> DataFrame:
        """(key, class_id, label, error)."""
        return detect.with_label(rows.select(self.key, argmax(F.col(self.output)).alias("class_id"), "error"), list(self.config.classes))


class Restorer(Runner):
    def preprocess(self, images: DataFrame) -> DataFrame:
        (h, w), color = self.config.shape, self.config.pad_color
        return pixels.preprocess(images, self.key, "image", lambda x: pixels.pad_to(x, w, h, color), self.config.bgr_to_rgb)

    def postprocess(self, rows: DataFrame) -> DataFrame:
        """(key, height, width, data, error): the image cut out of its padding, in BGR."""
        h, w = self.config.shape
        return pixels.restore(rows, self.key, self.output, h, w)
