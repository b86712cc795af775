"""Vectors as short codes: product quantization, its codebooks fitted by the filtering form of Lloyd's method.

Components become integers, floor(256 * x).  A vector is cut into equal consecutive
parts; each part position has a codebook, which starts as that part of the vectors
with the smallest ids and takes ``rounds`` rounds of Lloyd's method: every part goes to
its nearest entry (squared Euclidean distance, ties to the lower index), and an entry
becomes the componentwise floor of its parts' mean; an entry without parts stays.

Every partition cuts its vectors into blocks and builds a kd-tree for each part position
of a block, once: points in the tree's order, and for each leaf its bounding box and the sum and number of its
points, from which the inner nodes follow.  The trees are a table in the shared folder.
A round goes down the trees with the entries that are still possible: the entry nearest to the middle of a box rules out
each entry that is farther from every corner of it, and once one entry is left the
whole subtree is added to it by its cached sum and number.  Only leaves with several
entries left are looked at point by point.  All this is in whole numbers, so neither
blocks nor partitions change a result.  A round sends one row for each part position and
entry of a task; the driver holds the codebooks and nothing else.

Rows without a vector, or with a component that is null, not a number or infinite, are
dropped, and so are vectors whose length isn't a multiple of the number of parts, or differs from that of
the vector with the smallest id.  Components beyond what 64 bits can square and add up for that length (524,288 with 64
components) count as that bound.  Null ids come after all others; equal ids are told apart by their vectors, and
repeated rows each have their code.  With fewer vectors than entries the codebooks are smaller.  An empty
table gives an empty one.  Extra columns of any name are not read.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.llm.common import drop_table, write_table

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Vectors of a block, whose trees are built together, and the most points of a leaf (2 at least: no leaf is empty).
BLOCK, LEAF = 8192, 16


# --- trees


def bounds(n: int, level: int) -> np.ndarray:
    """Where the nodes of a level begin in the tree's order, and the end: each node's points are halved among its children."""
    return (np.arange((1 << level) + 1) * n) >> level


def depth(n: int) -> int:
    return max(0, math.ceil(math.log2(max(1, n) / LEAF)))


def tree_order(points: np.ndarray) -> np.ndarray:
    """The points' numbers in the order of a kd-tree that halves each node along the widest side of its box."""
    n = len(points)
    order = np.arange(n)
    for level in range(depth(n)):
        starts = bounds(n, level)
        there = points[order]
        wide = np.argmax(np.maximum.reduceat(there, starts[:-1]) - np.minimum.reduceat(there, starts[:-1]), axis=1)
        node = np.repeat(np.arange(1 << level), np.diff(starts))
        order = order[np.lexsort((there[np.arange(n), wide[node]], node))]
    return order


@dataclass
class Tree:
    """Points in the tree's order with boxes and sums of the leaves; ``levels`` has (low, high, sum, starts) from the root down."""

    points: np.ndarray
    levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]

    @classmethod
    def of(cls, points: np.ndarray, low: np.ndarray, high: np.ndarray, total: np.ndarray) -> Tree:
        n, levels = len(points), []
        for level in range(depth(n), -1, -1):
            levels.append((low, high, total, bounds(n, level)))
            low, high, total = np.minimum(low[::2], low[1::2]) if level else low, np.maximum(high[::2], high[1::2]) if level else high, total[::2] + total[1::2] if level else total
        return cls(points, levels[::-1])


def leaves(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(low, high, sum) of the leaves of points in the tree's order."""
    starts = bounds(len(points), depth(len(points)))[:-1]
    return np.minimum.reduceat(points, starts), np.maximum.reduceat(points, starts), np.add.reduceat(points.astype(np.int64), starts)


def spans(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All numbers of the given ranges, one range after the other."""
    lengths = ends - starts
    return np.repeat(starts - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths) + np.arange(lengths.sum())


def filtered(tree: Tree, book: np.ndarray):
    """Yields (positions in the tree's order, entry or entries, sum or None) until every point is assigned.

    With a sum the positions are a whole subtree's and go to one entry; without, each position has its own.
    """
    square = (book * book).sum(1)
    number = np.arange(len(book))
    nodes, open_ = np.zeros(1, np.int64), np.ones((1, len(book)), bool)
    for level, (low, high, total, starts) in enumerate(tree.levels):
        lo, hi = low[nodes].astype(np.int64), high[nodes].astype(np.int64)
        # twice the middle against twice the entries; any open entry would do, the nearest rules out most
        apart = ((lo + hi)[:, None, :] - 2 * book[None]) ** 2
        near = np.argmin(np.where(open_, apart.sum(2), np.iinfo(np.int64).max), axis=1)
        # how much nearer than the near entry each entry is, at the corner of the box where that is most
        step = book[None] - book[near][:, None, :]
        gain = square[near][:, None] - square[None] + 2 * (step * np.where(step > 0, hi[:, None, :], lo[:, None, :])).sum(2)
        open_ = open_ & ~((gain < 0) | ((gain == 0) & (number[None] > near[:, None])))
        one = open_.sum(1) == 1
        for node, entry in zip(nodes[one].tolist(), near[one].tolist()):
            yield slice(starts[node], starts[node + 1]), entry, total[node]
        nodes, open_ = nodes[~one], open_[~one]
        if not len(nodes):
            return
        if level < len(tree.levels) - 1:
            nodes, open_ = (2 * nodes[:, None] + np.arange(2)).reshape(-1), np.repeat(open_, 2, axis=0)
        else:
            at = spans(starts[nodes], starts[nodes + 1])
            possible = np.repeat(open_, starts[nodes + 1] - starts[nodes], axis=0)
            far = ((tree.points[at].astype(np.int64)[:, None, :] - book[None]) ** 2).sum(2)
            yield at, np.argmin(np.where(possible, far, np.iinfo(np.int64).max), axis=1), None


# --- blocks of a partition


def _blocks(batches, dims: int):
    """(ids, labels, integer vectors) of at most BLOCK rows each."""
    kept: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        while batch.num_rows:
            head = batch.slice(0, BLOCK - n)
            batch = batch.slice(head.num_rows)
            kept.append(head)
            n += head.num_rows
            if n == BLOCK:
                yield _columns(kept, dims)
                kept, n = [], 0
    if n:
        yield _columns(kept, dims)


def _columns(batches: list[pa.RecordBatch], dims: int):
    whole = pa.Table.from_batches(batches)
    return whole.column(0), whole.column(1), pa.concat_arrays(whole.column(2).chunks).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _one(column: pa.ChunkedArray) -> pa.ListArray:
    """A column as the one list of a row."""
    flat = pa.concat_arrays(column.chunks)
    return pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat)


def _grow(batches, dims: int, parts: int):
    """A row for each block: ids, labels, and for all part positions the points in order, the order, and the leaves."""
    d = dims // parts
    for ids, labels, vectors in _blocks(batches, dims):
        orders, points, low, high, total = [], [], [], [], []
        for p in range(parts):
            part = vectors[:, p * d : (p + 1) * d]
            order = tree_order(part)
            ordered = np.ascontiguousarray(part[order])
            orders.append(order.astype(np.int32))
            points.append(ordered)
            for held, new in zip((low, high, total), leaves(ordered)):
                held.append(new)
        packed = [np.stack(x).tobytes() for x in (points, orders, low, high, total)]
        yield pa.RecordBatch.from_arrays([_one(ids), _one(labels), *[pa.array([x], pa.binary()) for x in packed]], names=["ids", "labels", "points", "orders", "low", "high", "total"])


def _trees(batch: pa.RecordBatch, row: int, parts: int, d: int) -> list[Tree]:
    """The trees of a block, one for each part position."""
    get = lambda c, kind: np.frombuffer(batch.column(c)[row].as_py(), kind).reshape(parts, -1, d)
    return [Tree.of(*x) for x in zip(get("points", np.int32), get("low", np.int32), get("high", np.int32), get("total", np.int64))]


def _round(batches, books: np.ndarray):
    """For each part position and entry of a task that has points: their number and sum."""
    parts, entries, d = books.shape
    n, total = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, d), np.int64)
    for batch in batches:
        for row in range(batch.num_rows):
            for p, tree in enumerate(_trees(batch, row, parts, d)):
                for at, entry, whole in filtered(tree, books[p]):
                    if whole is not None:
                        n[p, entry] += at.stop - at.start
                        total[p, entry] += whole
                    else:
                        np.add.at(n[p], entry, 1)
                        np.add.at(total[p], entry, tree.points[at])
    p, e = np.nonzero(n)
    yield pa.RecordBatch.from_arrays([pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(n[p, e]), *[pa.array(total[p, e, j]) for j in range(d)]], names=["part", "entry", "n", *[f"s{j}" for j in range(d)]])


def _encode(batches, books: np.ndarray, names: list[str]):
    """(id, label, code, error) of every vector."""
    parts, _, d = books.shape
    for batch in batches:
        for row in range(batch.num_rows):
            trees, orders = _trees(batch, row, parts, d), np.frombuffer(batch.column("orders")[row].as_py(), np.int32).reshape(parts, -1)
            n = orders.shape[1]
            codes, error = np.zeros((n, parts), np.uint8), np.zeros(n, np.int64)
            for p, tree in enumerate(trees):
                for at, entry, _ in filtered(tree, books[p]):
                    of = orders[p][at]
                    codes[of, p] = entry
                    error[of] += ((tree.points[at] - books[p][entry]) ** 2).sum(1)
            digits = codes.tobytes().hex()
            code = [digits[k : k + 2 * parts] for k in range(0, 2 * parts * n, 2 * parts)]
            yield pa.RecordBatch.from_arrays([batch.column("ids")[row].values, batch.column("labels")[row].values, pa.array(code, pa.string()), pa.array(error)], names=names)


# --- the whole table


@dataclass
class Codes:
    """``rows``: (id, label, code, error); ``books``: the codebooks, an array (part position, entry, component), or None without vectors."""

    rows: DataFrame
    books: np.ndarray | None

    def digest(self) -> str:
        """SHA-256 of all entries' components in order, as decimal numbers joined by commas."""
        return hashlib.sha256(",".join(map(str, self.books.reshape(-1).tolist() if self.books is not None else [])).encode()).hexdigest()


def integers(df: DataFrame, id_col: str, vector: str, label: str, parts: int, scale: int) -> tuple[DataFrame, int]:
    """(id, label, v) of the rows that are kept, as whole numbers, and the number of components (0: no rows)."""
    sound = F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))))
    rows = df.select(df[id_col].alias("id"), df[label].alias("label"), df[vector].cast("array<double>").alias("v")).where(F.col("v").isNotNull() & (F.size("v") > 0) & (F.size("v") % parts == 0) & sound)
    first = rows.orderBy(F.col("id").asc_nulls_last(), "v").select(F.size("v")).first()
    dims = first[0] if first else 0
    most = math.isqrt((1 << 62) // max(1, dims)) // 2
    whole = lambda x: F.least(F.greatest(F.floor(x * scale), F.lit(-most)), F.lit(most)).cast("int")
    return rows.where(F.size("v") == dims).withColumn("v", F.transform("v", whole)), dims


def compress(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> Codes:
    """Codes of all vectors, two hexadecimal digits for each part, with the squared distance to what they stand for; at most 256 entries."""
    if not 0 < entries <= 256:
        raise ValueError("1 to 256 entries")
    kinds = dict(df.dtypes)
    schema = f"`{id_col}` {kinds[id_col]}, `{label}` {kinds[label]}, code string, error long"
    rows, dims = integers(df, id_col, vector, label, parts, scale)
    if not dims:
        return Codes(df.sparkSession.createDataFrame([], schema), None)
    d = dims // parts
    # (entry, dims) to (part, entry, component)
    seeds = rows.orderBy(F.col("id").asc_nulls_last(), "v").select("v").limit(entries).collect()
    books = np.array([r.v for r in seeds], np.int64).reshape(len(seeds), parts, d).transpose(1, 0, 2).copy()
    stored = f"ids array<{kinds[id_col]}>, labels array<{kinds[label]}>, points binary, orders binary, low binary, high binary, total binary"
    blocks = write_table(rows.mapInArrow(lambda batches: _grow(batches, dims, parts), stored), "trees")
    sums = ", ".join(f"s{j} long" for j in range(d))
    for _ in range(rounds):
        now = books.copy()
        met = blocks.select("points", "low", "high", "total").mapInArrow(lambda batches: _round(batches, now), f"part int, entry int, n long, {sums}")  # noqa: B023  runs before the next round
        for r in met.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(f"s{j}").alias(f"s{j}") for j in range(d)]).collect():
            books[r.part, r.entry] = [r[f"s{j}"] // r.n for j in range(d)]
    names = [id_col, label, "code", "error"]
    coded = write_table(blocks.mapInArrow(lambda batches: _encode(batches, books, names), schema), "codes")
    drop_table(blocks)
    return Codes(coded, books)


def label_errors(codes: Codes, label: str = "label") -> DataFrame:
    """The rows with ``label_error``, the error of all rows of their label (null is one): sums of each label meet the rows, which stay where they are or are split."""
    sums = codes.rows.groupBy(F.col(label).alias("_label")).agg(F.sum("error").alias("label_error"))
    return codes.rows.join(sums, F.col(label).eqNullSafe(F.col("_label")), "left").drop("_label")
