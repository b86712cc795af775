"""Batched model inference: one Arrow batch is one input tensor.

A backend turns an array [n, ...] into arrays by output name.  Each Python
worker opens its session once.  A batch that fails gives every row of it an
error text instead of a result; other batches go on.  Rows without data are not fed.

Batches are put together across the Arrow batches of a partition, items of like shape together, so that a
partition has one partial batch at most for each shape.
"""

from __future__ import annotations

from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.config import parse_backend, parse_execution_mode, parse_graph_level, parse_log_level

_sessions: dict[bytes, "OnnxBackend"] = {}


class Backend(Protocol):
    def infer(self, batch: np.ndarray) -> dict[str, np.ndarray]: ...


class OnnxBackend:
    """ONNX Runtime on one thread; the first input is fed, outputs go by name."""

    def __init__(self, model: bytes, options: dict | None = None):
        import onnxruntime as ort

        options, known = options or {}, ort.SessionOptions()
        known.intra_op_num_threads = int(options.get("intra_op_num_threads", 1))
        known.inter_op_num_threads = int(options.get("inter_op_num_threads", 1))
        known.graph_optimization_level = getattr(ort.GraphOptimizationLevel, parse_graph_level(options.get("graph_optimization_level", "ORT_ENABLE_BASIC")))
        known.execution_mode = getattr(ort.ExecutionMode, parse_execution_mode(options.get("execution_mode", "ORT_SEQUENTIAL")))
        known.log_severity_level = parse_log_level(options.get("log_severity_level", "ERROR"))
        there = ort.get_available_providers()
        wanted = [p for p in options.get("execution_providers", []) if p in there]
        self.session = ort.InferenceSession(model, known, providers=wanted or ["CPUExecutionProvider"])
        self.input = self.session.get_inputs()[0]
        self.outputs = [o.name for o in self.session.get_outputs()]

    def infer(self, batch: np.ndarray) -> dict[str, np.ndarray]:
        return dict(zip(self.outputs, self.session.run(self.outputs, {self.input.name: batch})))

    def warm_up(self, shape: tuple[int, ...], times: int = 1) -> dict[str, tuple[int, ...]]:
        """Shape of one item of each output, from runs on zeros."""
        out = {}
        for _ in range(max(1, times)):
            out = self.infer(np.zeros((1, *shape), np.float32))
        return {k: v.shape[1:] for k, v in out.items()}


def open_backend(kind: str, model: bytes, options: dict | None = None) -> OnnxBackend:
    parse_backend(kind)
    if model not in _sessions:
        _sessions.clear()
        _sessions[model] = OnnxBackend(model, options)
    return _sessions[model]


def read_model(path: str) -> bytes:
    """The model's bytes; an optimized copy beside it (``optimized_<name>``) is preferred."""
    import os

    folder, name = os.path.split(path)
    better = os.path.join(folder, f"optimized_{name}")
    with open(better if os.path.exists(better) else path, "rb") as f:
        return f.read()


def write_optimized(path: str, options: dict | None = None) -> str:
    """Writes the optimized copy that ``read_model`` prefers, beside the model, and gives its path."""
    import os

    import onnxruntime as ort

    folder, name = os.path.split(path)
    better, known = os.path.join(folder, f"optimized_{name}"), ort.SessionOptions()
    known.graph_optimization_level = getattr(ort.GraphOptimizationLevel, parse_graph_level((options or {}).get("graph_optimization_level", "ORT_ENABLE_BASIC")))
    known.optimized_model_filepath = better
    ort.InferenceSession(path, known, providers=["CPUExecutionProvider"])
    return better


#: Rows that wait for batches of their shape to fill; beyond, the largest group goes as it is.
MOST_WAITING = 4096


def assembled(batches, size: int, shape: int | None = None):
    """(shape, rows) in batches of ``size``, put together across the Arrow batches that come; ``shape`` is the column with each row's, if they differ.

    What is left of each shape comes at the end.
    """
    waiting: dict[tuple | None, list[pa.RecordBatch]] = {}
    held: dict[tuple | None, int] = {}

    def take(kind: tuple | None) -> pa.RecordBatch:
        held.pop(kind)
        return pa.Table.from_batches(waiting.pop(kind)).combine_chunks().to_batches()[0]

    for whole in batches:
        if shape is None:
            groups = {None: whole}
        else:
            places: dict[tuple | None, list[int]] = {}
            for i, x in enumerate(whole.column(shape).to_pylist()):
                places.setdefault(None if x is None else tuple(x), []).append(i)
            groups = {kind: whole.take(pa.array(at)) for kind, at in places.items()}
        for kind, rows in groups.items():
            while rows.num_rows:
                head = rows.slice(0, size - held.get(kind, 0))
                rows = rows.slice(head.num_rows)
                waiting.setdefault(kind, []).append(head)
                held[kind] = held.get(kind, 0) + head.num_rows
                if held[kind] == size:
                    yield kind, take(kind)
        while sum(held.values()) > max(MOST_WAITING, size):
            most = max(held, key=held.get)
            yield most, take(most)
    for kind in list(waiting):
        yield kind, take(kind)


def _listed(got: np.ndarray, there: np.ndarray) -> pa.ListArray:
    """Items of equal size as lists, null for the rows that were not fed."""
    offsets = np.concatenate(([0], np.cumsum(there))) * got.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(got.reshape(-1).astype(np.float32)), mask=pa.array(~there))


def _tensors(got: np.ndarray, there: np.ndarray) -> pa.StructArray:
    """The same with the shape of one item: (data, shape)."""
    data = _listed(got.reshape(len(got), -1), there)
    shape = pa.array([got.shape[1:] if x else None for x in there.tolist()], pa.list_(pa.int64()))
    return pa.StructArray.from_arrays([data, shape], ["data", "shape"], mask=pa.array(~there))


def infer(
    df: DataFrame, key: str, data: str, shape: tuple[int, ...] | str, model: bytes, output: str | tuple[str, ...], batch: int = 64, options: dict | None = None, backend: str = "onnxruntime", keep: tuple[str, ...] = (), number: str | None = None,
) -> DataFrame:
    """(key, output: array<float>, error, and the columns to keep) for each row; ``data`` holds one item's elements in row-major order.

    Several outputs are a column each, a tensor (data, shape) by the output's own name; the model runs once for all.
    ``shape`` is that of every item, or names a column that has each item's (an array of integers).
    ``number`` names a column for the number of a row's batch in its partition.
    A row without data has no output and keeps the ``error`` that it came with.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    kinds = dict(df.dtypes)
    kept = "".join(f", {c} {kinds[c]}" for c in keep) + (f", {number} long" if number else "")
    own = shape if isinstance(shape, str) else None
    outputs, one = ((output,), True) if isinstance(output, str) else (tuple(output), False)
    kind = "array<float>" if one else "struct<data:array<float>,shape:array<bigint>>"
    empty = pa.list_(pa.float32()) if one else pa.struct([("data", pa.list_(pa.float32())), ("shape", pa.list_(pa.int64()))])

    def run(batches):
        session = open_backend(backend, shared.value, options)
        for n_batch, (dims, part) in enumerate(assembled(batches, batch, 3 if own else None)):
            there = part.column(1).is_valid().to_numpy(zero_copy_only=False)
            n, error = int(there.sum()), part.column(2)
            results = [pa.nulls(part.num_rows, empty)] * len(outputs)
            try:
                if n:
                    flat = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float32, copy=False)
                    got = session.infer(flat.reshape(n, *(shape if dims is None else dims)))
                    results = [_listed(got[o].reshape(n, -1), there) if one else _tensors(got[o], there) for o in outputs]
            except Exception as e:  # noqa: BLE001  the rows of this batch carry it
                text = f"{type(e).__name__}: {e}"[:500]
                error = pa.array([text if x else y for x, y in zip(there.tolist(), error.to_pylist())], pa.string())
            more = [part.column((4 if own else 3) + k) for k in range(len(keep))] + [pa.array(np.full(part.num_rows, n_batch))] * bool(number)
            yield pa.RecordBatch.from_arrays([part.column(0), *results, error, *more], names=[key, *outputs, "error", *keep, *[number] * bool(number)])

    before = F.col("error") if "error" in df.columns else F.lit(None).cast("string").alias("error")
    named = ", ".join(f"`{o}` {kind}" for o in outputs)
    return df.select(key, F.col(data).cast("array<float>").alias("_data"), before, *([F.col(own).cast("array<int>").alias("_shape")] if own else []), *keep).mapInArrow(run, f"{key} {kinds[key]}, {named}, error string{kept}")
