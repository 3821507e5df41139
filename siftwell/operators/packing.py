"""Columns in few bytes, for rows that must be shuffled in large numbers: packed by the task that makes them, unpacked by the one that reads them."""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa

_CODEC = "zstd"
# Decimals that a column of doubles may have to be packed as whole numbers, if that gives each of them back.
_SCALE = 1e6


def _planes(numbers: np.ndarray) -> bytes:
    """Steps from one number to the next, the low bytes of all before the high ones."""
    step = np.diff(numbers.astype(np.int64), prepend=np.int64(0))
    return ((step << 1) ^ (step >> 63)).view(np.uint8).reshape(-1, 8).T.tobytes()


def _numbers(planes: bytes | np.ndarray) -> np.ndarray:
    data = np.frombuffer(planes, np.uint8) if isinstance(planes, bytes) else planes
    step = np.ascontiguousarray(data.reshape(8, -1).T).view(np.uint64).ravel()
    return np.cumsum((step >> np.uint64(1)).astype(np.int64) ^ -(step & np.uint64(1)).astype(np.int64))


def _compressed(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + pa.Codec(_CODEC).compress(data, asbytes=True)


def _whole(packed: bytes) -> bytes:
    return pa.Codec(_CODEC).decompress(packed[8:], int.from_bytes(packed[:8], "little"), asbytes=True)


def squeeze(*parts: np.ndarray) -> bytes:
    """Arrays of whole numbers as bytes; ``released`` gives them back."""
    return np.array([len(p) for p in parts], np.int64).tobytes() + _compressed(b"".join(_planes(p) for p in parts))


def released(packed: bytes, parts: int) -> list[np.ndarray]:
    sizes = np.frombuffer(packed, np.int64, parts)
    data = np.frombuffer(_whole(packed[8 * parts :]), np.uint8)
    edges = np.concatenate([[0], 8 * np.cumsum(sizes)]).tolist()
    return [_numbers(data[a:b]) for a, b in zip(edges, edges[1:], strict=False)]


def _decimals(values: np.ndarray) -> np.ndarray | None:
    scaled = np.rint(values * _SCALE)
    if not (np.abs(scaled) < 2**52).all() or not (scaled / _SCALE == values).all() or (np.signbit(values) & (values == 0)).any():
        return None
    return scaled.astype(np.int64)


def pack_columns(batch: pa.RecordBatch) -> bytes:
    """A batch of any columns as bytes; ``unpack_columns`` gives it back."""
    out = []
    for column in batch.columns:
        kind = column.type
        if not len(column) or column.null_count:
            made = None
        elif pa.types.is_signed_integer(kind):
            made = ("i", _planes(column.to_numpy()))
        elif pa.types.is_string(kind) or pa.types.is_binary(kind):
            ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
            made = ("s", _planes(np.diff(ends)), bytes(column.buffers()[2][int(ends[0]) : int(ends[-1])]) if ends[-1] > ends[0] else b"")
        elif pa.types.is_float64(kind) and (whole := _decimals(column.to_numpy())) is not None:
            made = ("d", _planes(whole))
        else:
            made = None
        out.append(made or ("r", pa.RecordBatch.from_arrays([column], ["c"]).serialize().to_pybytes()))
    return _compressed(pickle.dumps(out))


def unpack_columns(packed: bytes, schema: pa.Schema) -> pa.RecordBatch:
    columns = []
    for field, (how, data, *text) in zip(schema, pickle.loads(_whole(packed)), strict=True):
        if how == "r":
            columns.append(pa.ipc.read_record_batch(pa.py_buffer(data), pa.schema([pa.field("c", field.type)])).column(0))
        elif how == "s":
            ends = np.concatenate([[0], np.cumsum(_numbers(data))]).astype(np.int32)
            columns.append(pa.Array.from_buffers(field.type, len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(text[0])]))
        else:
            found = _numbers(data)
            columns.append(pa.array(found / _SCALE) if how == "d" else pa.array(found).cast(field.type))
    return pa.RecordBatch.from_arrays(columns, schema=schema)
