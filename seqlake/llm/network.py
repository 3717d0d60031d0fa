"""Small networks that onnxruntime runs in a task, one thread each.

An ONNX model is a protocol buffer; as the package that writes them is not at hand, the few messages
needed here are written field by field.
"""

from __future__ import annotations

KINDS = {"float32": 1, "float64": 11, "int64": 7}


def _number(n: int) -> bytes:
    return bytes([n]) if n < 128 else bytes([n & 127 | 128]) + _number(n >> 7)


def _field(key: int, value: int | str | bytes) -> bytes:
    if isinstance(value, int):
        return _number(key << 3) + _number(value)
    value = value.encode() if isinstance(value, str) else value
    return _number(key << 3 | 2) + _number(len(value)) + value


def node(op: str, inputs: str, outputs: str, **attributes: int | list[int]) -> bytes:
    """An operator on the values ``inputs`` (names by spaces); attributes are whole numbers from 0 on, or lists of them."""
    out = [*(_field(1, x) for x in inputs.split()), *(_field(2, x) for x in outputs.split()), _field(4, op)]
    for name, value in attributes.items():
        own = _field(20, 2) + _field(3, value) if isinstance(value, int) else _field(20, 7) + b"".join(_field(8, x) for x in value)
        out.append(_field(5, _field(1, name) + own))
    return b"".join(out)


def _value(name: str, kind: str, rank: int) -> bytes:
    shape = b"".join(_field(1, _field(2, f"{name}{k}")) for k in range(rank))
    return _field(1, name) + _field(2, _field(1, _field(1, KINDS[kind]) + _field(2, shape)))


def session(nodes: list[bytes], inputs: dict[str, tuple[str, int]], outputs: dict[str, tuple[str, int]]):
    """What runs ``nodes``; inputs and outputs have a kind and a rank each."""
    import onnxruntime as ort

    graph = b"".join(_field(1, x) for x in nodes) + _field(2, "network")
    graph += b"".join(_field(11, _value(k, *x)) for k, x in inputs.items()) + b"".join(_field(12, _value(k, *x)) for k, x in outputs.items())
    model = _field(1, 8) + _field(7, graph) + _field(8, _field(1, "") + _field(2, 17))
    options = ort.SessionOptions()
    options.intra_op_num_threads = options.inter_op_num_threads = 1
    return ort.InferenceSession(model, options, providers=["CPUExecutionProvider"])
