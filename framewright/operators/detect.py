"""Detection: anchors of a raw output tensor to labelled boxes.

A tensor of [4 + classes, anchors] stays in one row until its anchors are boxes,
so an image's detections need no shuffle; suppression folds over an array.
"""

from __future__ import annotations

import math
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewright.functions.tensor import best_class, elements
from framewright.operators import ordered
from framewright.session import written


def valid_tensor(shape: Column, data: Column) -> Column:
    """An error text unless the tensor has three dimensions and as many elements as they say."""
    return F.when(F.size(shape) != 3, "expected three dimensions").when(elements(shape) != F.size(data), "shape and data differ in size")


def anchors(df: DataFrame, data: str, attributes: int, count: int) -> DataFrame:
    """One row for each anchor: ``i``, cx, cy, w, h and the array ``scores``; element (a, i) is at a * count + i."""
    at = lambda a: F.col(data)[F.lit(a * count) + F.col("i")].cast("double")
    rows = df.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
    named = {"cx": at(0), "cy": at(1), "w": at(2), "h": at(3), "scores": F.array(*[at(a) for a in range(4, attributes)])}
    return rows.withColumns(named).drop(data)


def with_class(df: DataFrame, scores: str = "scores") -> DataFrame:
    """Adds ``score`` and ``class_id``: the largest score from 0 on, the first of equals."""
    return df.withColumn("_best", best_class(F.col(scores))).withColumns({"score": F.col("_best.score"), "class_id": F.col("_best.class_id")}).drop("_best", scores)


def confident(df: DataFrame, conf: float = 0.25, strict: bool = False) -> DataFrame:
    """Rows whose score reaches ``conf`` (``strict``: exceeds it)."""
    return df.where(F.col("score") > conf if strict else F.col("score") >= conf)


def top_detections(df: DataFrame, image: str, order: list[str], most: int) -> DataFrame:
    """At most ``most`` rows of each image: largest score first, ties in the given order."""
    by = Window.partitionBy(image).orderBy(F.desc("score"), *order)
    return df.withColumn("_rank", F.row_number().over(by)).where(F.col("_rank") <= most).drop("_rank")


def with_label(df: DataFrame, labels: list[str], class_id: str = "class_id") -> DataFrame:
    """Adds the class name; null beyond the list."""
    return df.withColumn("label", F.try_element_at(F.array(*map(F.lit, labels)), F.col(class_id) + 1))


def join_labels(df: DataFrame, labels: DataFrame) -> DataFrame:
    """The same from a table (class_id, label), which Spark broadcasts if it is small enough."""
    return df.join(labels, "class_id", "left")


Box = Column | dict[str, Column]


def intersection(a: Box, b: Box) -> Column:
    """Area that two integer boxes share."""
    along = lambda p, s: F.greatest(F.lit(0), F.least(a[p] + a[s], b[p] + b[s]) - F.greatest(a[p], b[p]))
    return (along("x", "w") * along("y", "h")).cast("bigint")


def union(a: Box, b: Box) -> Column:
    return (a["w"] * a["h"] + b["w"] * b["h"]).cast("bigint") - intersection(a, b)


def overlaps(a: Box, b: Box, threshold: float) -> Column:
    """Intersection over union above the threshold; two boxes without area overlap wholly."""
    whole = union(a, b)
    return F.when(whole == 0, F.lit(1.0) > threshold).otherwise(intersection(a, b) > F.lit(threshold) * whole)


def suppress(boxes: Column, threshold: float = 0.45) -> Column:
    """Greedy suppression over an array in order of preference: a box stays unless it overlaps one that stayed."""
    none = F.filter(boxes, lambda b: F.lit(False))
    step = lambda kept, b: F.when(F.exists(kept, lambda k: overlaps(k, b, threshold)), kept).otherwise(F.concat(kept, F.array(b)))
    return F.aggregate(boxes, none, step)


def flat_classes(df: DataFrame, group: str, key: str) -> DataFrame:
    """(group, first, last, members) for each group with several boxes without area, which all overlap each other wholly: one row stands for all their pairs."""
    flat = df.where(~has_area())
    return flat.groupBy(group).agg(F.min(key).alias("first"), F.max(key).alias("last"), F.count("*").alias("members")).where("members > 1")


def flat_pairs(df: DataFrame, group: str, key: str, threshold: float, most: int = 1000) -> DataFrame:
    """Pairs of a group's boxes without area, each once, with the columns of ``overlapping_pairs``: they overlap each other wholly wherever they are.

    A group's boxes are dealt into slices of about ``most``, and every two slices meet in a cell of their own.
    """
    slices = flat_classes(df, group, key).select(group, F.ceil(F.col("members") / most).alias("slices"))
    boxes = df.where(~has_area()).select(group, F.col(key).alias("key"), *SIDES).join(slices, group)
    own, cells = F.pmod(F.xxhash64("key"), F.col("slices")), [group, "i", "j"]
    left = boxes.withColumn("i", own).withColumn("j", F.explode(F.sequence("i", F.col("slices") - 1)))
    right = boxes.withColumn("j", own).withColumn("i", F.explode(F.sequence(F.lit(0).cast("bigint"), "j")))
    pairs = _named(left, "a", cells).join(_named(right, "b", cells), cells).where(((F.col("i") < F.col("j")) | (F.col("a_key") < F.col("b_key"))) & overlaps(_box("a"), _box("b"), threshold))
    return _paired(pairs, group, key)


SIDES = ["x", "y", "w", "h"]


def _box(name: str) -> dict[str, Column]:
    return {p: F.col(f"{name}_{p}") for p in SIDES}


def _named(rows: DataFrame, name: str, cells: list[str], *more: str) -> DataFrame:
    """The boxes at their cells, their columns named after the side of the join.

    Columns and no struct: a struct is read anew for every pair that is looked at.
    A cell's pairs are many more than its rows, so tasks aren't merged by the size of their rows.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, *cells).select(*cells, *more, *[F.col(c).alias(f"{name}_{c}") for c in ["key", *SIDES]])


def _paired(pairs: DataFrame, group: str, key: str) -> DataFrame:
    return pairs.select(
        group, F.least("a_key", "b_key").alias(f"a_{key}"), F.greatest("a_key", "b_key").alias(f"b_{key}"),
        intersection(_box("a"), _box("b")).alias("intersection"), union(_box("a"), _box("b")).alias("union_area"),
    )


def has_area() -> Column:
    return F.col("w") * F.col("h") > 0


def overlapping_pairs(df: DataFrame, group: str, key: str, threshold: float, most: int = 1000) -> DataFrame:
    """Pairs of a group's boxes with area that overlap above the threshold (0 or more), each once; ``flat_pairs`` has the others."""
    boxes = _with_area(df, group, key)
    return _paired(_meeting(boxes, boxes, group, threshold, True, most), group, key)


def _with_area(df: DataFrame, group: str, key: str) -> DataFrame:
    return df.where(has_area() & F.col(group).isNotNull()).select(group, F.col(key).alias("key"), *[F.col(c).cast("bigint").alias(c) for c in SIDES])


def _meeting(seekers: DataFrame, homes: DataFrame, group: str, threshold: float, once: bool, most: int = 1000) -> DataFrame:
    """Pairs of a box of ``seekers`` (a) and one of ``homes`` (b) that overlap above the threshold; ``once``: both are the same boxes, and each pair counts once.

    Boxes have a class for their width and one for their height, and every two classes that differ by less than a factor of
    1 / threshold have a grid of their own, with cells of half the larger class.  There a box of ``homes`` is in the cell of its corner, and one of
    ``seekers`` in all cells where the corner of a box can be that overlaps it enough: few, whatever the boxes' sizes.
    So boxes that meet in a cell are of like shape and place: many of them mean many pairs.  Cells with more than ``most``
    boxes of ``homes`` are cut in slices of about so many, each of which all that look there visit.
    """
    base = min(max(1 / threshold, 1.25), 2.5) if threshold > 0 else 2.5
    number = lambda side: side / math.log(base)
    if threshold > 0:
        reach = lambda n: F.sequence(F.greatest(F.lit(0), F.floor(number(F.log(F.col(n) * threshold)) - 1e-9).cast("int")), F.floor(number(F.log(F.col(n) / threshold)) + 1e-9).cast("int"))
    else:
        largest = seekers.unionByName(homes).agg(F.max(F.greatest("w", "h"))).first()[0] or 1
        reach = lambda n: F.sequence(F.lit(0), F.lit(math.floor(number(math.log(largest))) + 1))

    def classed(rows: DataFrame, own: str, other: str) -> DataFrame:
        rows = rows.withColumns({f"{own}{n}": F.floor(number(F.log(n))).cast("int") for n in "wh"})
        rows = rows.withColumn(f"{other}w", F.explode(reach("w"))).withColumn(f"{other}h", F.explode(reach("h")))
        rows = rows.where((F.col("aw") < F.col("bw")) | ((F.col("aw") == F.col("bw")) & (F.col("ah") <= F.col("bh")))) if once else rows
        return rows.withColumn("kind", F.col("aw") + 256 * (F.col("ah") + 256 * (F.col("bw") + F.lit(256).cast("bigint") * F.col("bh"))))

    up = lambda c: F.pow(F.lit(base), c + 1)
    side = lambda n: up(F.greatest(f"a{n}", f"b{n}")) / 2
    there = classed(homes, "b", "a").withColumns({"i": F.floor(F.col("x") / side("w")), "j": F.floor(F.col("y") / side("h"))})

    def around(p: str, n: str) -> Column:
        """Of two boxes that share so much, the second begins less than this before the first, or after it."""
        longest = up(F.col(f"b{n}")) * (1 + 1e-9)
        longest = F.least(longest, F.col(n) / threshold) if threshold > 0 else longest
        before = F.greatest(F.lit(0.0), longest - threshold * F.greatest(F.col(n), longest))
        return F.explode(F.sequence(F.floor((F.col(p) - before - 1e-6) / side(n)), F.floor((F.col(p) + (1 - min(threshold, 1)) * F.col(n) + 1e-6) / side(n))))

    looking = classed(seekers, "a", "b").withColumn("alike", (F.col("aw") == F.col("bw")) & (F.col("ah") == F.col("bh"))).withColumn("i", around("x", "w")).withColumn("j", around("y", "h"))
    cells = [group, "kind", "i", "j"]
    # one row for more than ``most`` others
    dense = F.broadcast(there.groupBy(*cells).agg(F.count("*").alias("n")).where(F.col("n") > most).select(*cells, F.ceil(F.col("n") / most).alias("slices")))
    slices = F.coalesce("slices", F.lit(1))
    there = there.join(dense, cells, "left").withColumn("slice", F.pmod(F.xxhash64("key"), slices))
    looking = looking.join(dense, cells, "left").withColumn("slice", F.explode(F.sequence(F.lit(0).cast("bigint"), slices - 1)))
    cells = [*cells, "slice"]
    # bounds for the other's sides and corner, looked at before areas are: whole numbers, a little too far where in doubt
    bound = lambda rows, n: rows.withColumns({f"{n}_far_{p}": F.ceil(F.col(f"{n}_{p}") + (1 - min(threshold, 1)) * F.col(f"{n}_{q}") + 1e-6) for p, q in ("xw", "yh")})
    a = bound(_named(looking, "a", cells, "alike"), "a")
    a = a.withColumns({f"a_{e}_{n}": c for n in "wh" for e, c in (("least", F.ceil(F.col(f"a_{n}") * threshold - 1e-6)), ("most", F.floor(F.col(f"a_{n}") / threshold + 1e-6) if threshold > 0 else F.lit(2**63 - 1)))})
    met = a.join(bound(_named(there, "b", cells), "b"), cells)
    for n in "wh":
        met = met.where(F.col(f"b_{n}").between(F.col(f"a_least_{n}"), F.col(f"a_most_{n}")))
    for p in "xy":
        met = met.where((F.col(f"b_{p}") <= F.col(f"a_far_{p}")) & (F.col(f"a_{p}") <= F.col(f"b_far_{p}")))
    met = met.where(~F.col("alike") | (F.col("a_key") < F.col("b_key"))) if once else met
    return met.where(intersection(_box("a"), _box("b")) > F.lit(threshold) * union(_box("a"), _box("b")))


#: Boxes that are gone through one by one: the best of a group, or those of a part.
FOLD = 2048
#: A batch reaches so many times as far down as the batches before it.
GROWTH = 8


def suppress_groups(df: DataFrame, group: str, ties: list[str], threshold: float = 0.45, fold: int = FOLD) -> DataFrame:
    """The rows (group, score, ties, x, y, w, h) that stay, where boxes of a group come from several rows.

    Exactly what going through a group box by box gives; ``ties`` tell the boxes of a group apart.  A group of at most ``fold``
    boxes is one array.  A larger one is never brought together: its best ``fold`` boxes are an array, and the others follow in
    batches by rank, each of which reaches eight times as far as those before.  Of a batch all boxes go that overlap one that stayed so far,
    which few boxes ever do more than a few times, since those overlap each other little; only of what is left the pairs are
    found.  Where places don't follow from scores that is a few pairs for each box, however many overlap.  A box without a group is alone and stays.
    """
    kept = [group, *ties, "score", "x", "y", "w", "h"]
    rows = df.select(*kept, F.struct((-F.col("score")).alias("neg"), *ties).alias("rank"))
    sizes = rows.where(F.col(group).isNotNull()).groupBy(group).agg(F.count("*").alias("n"))
    large = written(sizes.where(F.col("n") > fold).select(group, "n"), "large_groups")
    small = rows.where(F.col(group).isNotNull()).join(large, group, "left_anti")
    in_array = lambda of, *more: of.groupBy(group).agg(F.explode(suppress(F.sort_array(F.collect_list(F.struct("rank", *ties, "score", "x", "y", "w", "h", *more))), threshold)).alias("b")).select(group, "b.*")
    out = in_array(small).select(*kept).unionByName(rows.where(F.col(group).isNull()).select(*kept))
    if large.isEmpty():
        return out
    ours = rows.join(large.select(group), group, "left_semi")
    # of the boxes without area, which all overlap each other, the best one stays
    best = ours.where(~has_area()).groupBy(group).agg(F.min("rank").alias("rank"))
    flat = ours.where(~has_area()).join(best, [group, "rank"], "left_semi") if threshold < 1 else ours.where(~has_area())
    boxes = written(ordered.running(ours.where(has_area()), [group], ["rank"], {"place": F.lit(1).cast("bigint")}), "boxes")
    last = boxes.agg(F.max("place")).first()[0] or 0
    stay, done = written(in_array(boxes.where(F.col("place") <= fold), "place").select(*kept, "place"), "stay"), fold
    while done < last:
        batch = boxes.where((F.col("place") > done) & (F.col("place") <= done * GROWTH))
        gone = _meeting(_with_area(stay, group, "place"), _with_area(batch, group, "place"), group, threshold, False).select(group, F.col("b_key").alias("place")).distinct()
        free = _dealt(batch.join(gone, [group, "place"], "left_anti"), group, fold)
        gone = _decided(free, group, threshold).where("gone").select(group, "place")
        stay = stay.unionByName(written(free.join(gone, [group, "place"], "left_anti").select(*kept, "place"), "stay"))
        done *= GROWTH
    return out.unionByName(flat.select(*kept)).unionByName(stay.select(*kept))


def _dealt(boxes: DataFrame, group: str, most: int) -> DataFrame:
    """The boxes with ``part``: of each group neighbours in a curve through the plane, ``most`` in each."""
    digits = lambda p, n: F.split(F.lpad(F.bin(F.floor(F.col(p) + F.col(n) / 2).cast("bigint") + F.lit(1 << 40)), 42, "0"), "")
    woven = F.array_join(F.zip_with(digits("x", "w"), digits("y", "h"), lambda a, b: F.concat(a, b)), "")
    along = ordered.running(boxes.withColumn("curve", woven), [group], ["curve", "place"], {"spot": F.lit(1).cast("bigint")})
    return written(along.withColumn("part", F.floor((F.col("spot") - 1) / most)).drop("curve", "spot"), "free")


def _decided(boxes: DataFrame, group: str, threshold: float) -> DataFrame:
    """(group, place, gone) for every box that some better one overlaps, where places are in order of rank.

    Each part goes through its own pairs, better boxes first, as far as the boxes of other parts that it depends on are
    decided.  Rounds go on until all are: their number grows with the parts that a chain of overlaps passes through, not with its length.
    """
    pairs = overlapping_pairs(boxes.withColumn("at", F.struct("place", "part")), group, "at", threshold)
    met = written(pairs.select(group, *[F.col(f"{x}_at.{c}").alias(f"{n}_{c}") for x, n in (("a", "better"), ("b", "worse")) for c in ("place", "part")]), "pairs")
    # a better box that nothing better overlaps stays
    under = met.select(group, F.col("worse_place").alias("better_place")).distinct().withColumn("waits", F.lit(True))
    left = met.join(under, [group, "better_place"], "left").withColumn("better_gone", F.when(F.col("waits").isNull(), F.lit(False))).drop("waits")
    left = written(left, "pairs")

    def through(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        """The boxes of a part that can be decided: gone if a better one stays, staying if all better ones are gone."""
        fate: dict[int, bool | None] = {}
        rows = rows.sort_values("worse_place")
        pairs = zip(rows["worse_place"].tolist(), rows["better_place"].tolist(), (rows["better_part"] == rows["worse_part"]).tolist(), rows["better_gone"].tolist())
        for worse, of in groupby(pairs, key=lambda p: p[0]):
            fates = [bool(gone) if gone is not None else fate.get(better) if here else None for _, better, here, gone in of]
            fate[worse] = True if False in fates else None if None in fates else False
        known = [(key[0], w, gone) for w, gone in fate.items() if gone is not None]
        return pd.DataFrame(known, columns=[group, "place", "gone"])

    fields = f"{group} {boxes.schema[group].dataType.simpleString()}, place long, gone boolean"
    decided = boxes.where("false").select(group, "place", F.lit(False).alias("gone"))
    while not left.isEmpty():
        now = written(left.groupBy(group, "worse_part").applyInPandas(through, fields), "decided")
        decided = decided.unionByName(now)
        of_better = now.select(group, F.col("place").alias("better_place"), F.col("gone").alias("now_gone"))
        rest = left.join(now.select(group, F.col("place").alias("worse_place")), [group, "worse_place"], "left_anti").join(of_better, [group, "better_place"], "left")
        left = written(rest.withColumn("better_gone", F.coalesce("better_gone", "now_gone")).drop("now_gone"), "pairs")
    return decided


def clamp_count(n: Column, most: int) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(most), n))
