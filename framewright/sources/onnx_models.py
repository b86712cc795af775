"""Small ONNX models as bytes, encoded by hand: matrix products, and an identity."""

from __future__ import annotations

import struct


def _varint(n: int) -> bytes:
    out = b""
    while n > 0x7F:
        out += bytes([n & 0x7F | 0x80])
        n >>= 7
    return out + bytes([n])


def _number(field: int, n: int) -> bytes:
    return _varint(field << 3) + _varint(n)


def _bytes(field: int, data: bytes | str) -> bytes:
    data = data.encode() if isinstance(data, str) else data
    return _varint(field << 3 | 2) + _varint(len(data)) + data


def _value(name: str, dims: list[int | str]) -> bytes:
    """A float tensor's name and type; a text as a dimension names a free one."""
    shape = b"".join(_bytes(1, _number(1, d) if isinstance(d, int) else _bytes(2, d)) for d in dims)
    return _bytes(1, name) + _bytes(2, _bytes(1, _number(1, 1) + _bytes(2, shape)))


def _model(nodes: list[bytes], tensors: list[bytes], inputs: bytes, *outputs: bytes) -> bytes:
    graph = b"".join(_bytes(1, n) for n in nodes) + _bytes(2, "g") + b"".join(_bytes(5, t) for t in tensors) + _bytes(11, inputs) + b"".join(_bytes(12, o) for o in outputs)
    return _number(1, 8) + _bytes(7, graph) + _bytes(8, _bytes(1, "") + _number(2, 13))


def _node(kind: str, inputs: list[str], output: str) -> bytes:
    return b"".join(_bytes(1, x) for x in inputs) + _bytes(2, output) + _bytes(4, kind)


def _tensor(name: str, dims: list[int], flat: list[float]) -> bytes:
    return b"".join(_number(1, d) for d in dims) + _number(2, 1) + _bytes(8, name) + _bytes(9, struct.pack(f"<{len(flat)}f", *flat))


def _weights(weights: list[list[float]], name: str = "w") -> bytes:
    return _tensor(name, [len(weights), len(weights[0])], [v for row in weights for v in row])


def linear(weights: list[list[float]], x: str = "x", y: str = "logits") -> bytes:
    """y = x @ weights."""
    return _model([_node("MatMul", [x, "w"], y)], [_weights(weights)], _value(x, ["n", len(weights)]), _value(y, ["n", len(weights[0])]))


def linear_over_planes(weights: list[list[float]], shape: list[int], whole: bool = False, x: str = "x", y: str = "y") -> bytes:
    """y = flattened x @ weights; ``whole``: planes in [0, 1] become whole numbers up to 255 first."""
    steps = [_node("Mul", [x, "c"], "m"), _node("Round", ["m"], "r"), _node("Flatten", ["r"], "f")] if whole else [_node("Flatten", [x], "f")]
    return _model([*steps, _node("MatMul", ["f", "w"], y)], [_weights(weights), *[_tensor("c", [], [255.0])] * whole], _value(x, ["n", *shape]), _value(y, ["n", len(weights[0])]))


def identity(shape: list[int], x: str = "x", y: str = "y") -> bytes:
    return _model([_node("Identity", [x], y)], [], _value(x, ["n", *shape]), _value(y, ["n", *shape]))


def heads(weights: dict[str, list[list[float]]], x: str = "x") -> bytes:
    """A product of the same input for each output."""
    size = len(next(iter(weights.values())))
    nodes = [_node("MatMul", [x, f"w_{name}"], name) for name in weights]
    return _model(nodes, [_weights(w, f"w_{name}") for name, w in weights.items()], _value(x, ["n", size]), *[_value(name, ["n", len(w[0])]) for name, w in weights.items()])
