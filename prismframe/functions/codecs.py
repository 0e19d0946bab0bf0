"""Chunk codecs on bytes and arrays: pure functions of one chunk, run by the readers and writers inside Spark tasks.

PIZ, DWAA and DWAB are recognised and refused. A payload of the unpacked size is a raw chunk.
"""

from __future__ import annotations

import functools
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from . import numeric

#: Pairs of places in a block of 4 x 4 whose differences a packed block holds, in the order of its bits.
EDGES = ((0, 4), (4, 8), (8, 12), (0, 1), (4, 5), (8, 9), (12, 13), (1, 2), (5, 6), (9, 10), (13, 14), (2, 3), (6, 7), (10, 11), (14, 15))
_FROM, _TO = (np.array(x) for x in zip(*EDGES, strict=True))
_PLACES = np.array([18, 12, 6, 0])
#: Shifts of a block from 0 to 12, with which any differences of 16-bit numbers fit: 2^shift - 1, and shift + 1.
_ROUND, _NEXT = ((1 << np.arange(13, dtype=np.int32)) - 1)[:, None], np.arange(1, 14, dtype=np.int32)[:, None]
_RUN = re.compile(rb"(.)\1{1,127}", re.DOTALL)


class InvalidData(ValueError):
    """The bytes are no valid file."""


class Unsupported(ValueError):
    """The file is valid and uses a feature that is not supported."""


def interleave(raw: bytes) -> bytes:
    return raw[::2] + raw[1::2]


def uninterleave(data: bytes) -> bytes:
    out = np.empty(len(data), np.uint8)
    x, half = np.frombuffer(data, np.uint8), (len(data) + 1) // 2
    out[::2], out[1::2] = x[:half], x[half:]
    return out.tobytes()


def predict(raw: bytes) -> bytes:
    """Differences of neighbours, 128 standing for none; the first byte stays."""
    x = np.frombuffer(raw, np.uint8)
    return raw[:1] + (x[1:] - x[:-1] + np.uint8(128)).tobytes()


def unpredict(data: bytes) -> bytes:
    x = np.frombuffer(data, np.uint8).copy()
    x[1:] -= np.uint8(128)
    return np.cumsum(x, dtype=np.uint8).tobytes()


def runs(raw: bytes, least: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, byte) of the runs of at least `least` equal bytes."""
    x = np.frombuffer(raw, np.uint8)
    start = np.concatenate([[0], np.nonzero(np.diff(x))[0] + 1]) if len(x) else np.zeros(0, np.int64)
    length = np.diff(np.append(start, len(x)))
    long = length >= least
    return start[long], length[long], x[start[long]]


def on_bytes(kernel):
    """A function of bytes as a Column function of BINARY values, a batch at a time; null stays null."""

    @F.arrow_udf("binary")
    def apply(x: pa.Array) -> pa.Array:
        return mapped(kernel, x)

    return apply


def mapped(kernel, x: pa.Array) -> pa.Array:
    """kernel of each value of a BINARY array; one value at a time is an object, the others stay in the buffers."""
    data, ends = bytearray(), np.zeros(len(x) + 1, np.int64)
    for i, v in enumerate(x):
        if v.is_valid:
            data += kernel(v.as_py())
        ends[i + 1] = len(data)
    if len(data) >= 1 << 31:
        raise ValueError("more than 2 GB of results in a batch: lower spark.sql.execution.arrow.maxRecordsPerBatch")
    valid = x.is_valid().buffers()[1] if x.null_count else None
    return pa.BinaryArray.from_buffers(pa.binary(), len(x), [valid, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)])


def run_column():
    """runs() as a Column function: array<struct<start int, length long, byte int>>; null stays null."""
    kind = pa.struct([("start", pa.int32()), ("length", pa.int64()), ("byte", pa.int32())])

    @F.arrow_udf("array<struct<start:int,length:bigint,byte:int>>")
    def apply(x: pa.Array) -> pa.Array:
        found = [runs(v or b"") for v in x.to_pylist()]
        at = np.concatenate([[0], np.cumsum([len(f[0]) for f in found])])
        columns = [np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in range(3)]
        values = pa.StructArray.from_arrays([pa.array(c.astype(np.int64)).cast(kind.field(i).type) for i, c in enumerate(columns)], fields=list(kind))
        return pa.ListArray.from_arrays(pa.array(at, pa.int32()), values, mask=x.is_null() if x.null_count else None)

    return apply


def inflate(data: bytes, size: int) -> bytes:
    try:
        out = zlib.decompressobj().decompress(data, size + 1)
    except zlib.error as e:
        raise InvalidData(f"zlib: {e}") from None
    if len(out) != size:
        raise InvalidData(f"{len(out)} bytes instead of {size}")
    return out


def rle_pack(raw: bytes) -> bytes:
    """Runs of 2 to 128 equal bytes as (n - 1, byte), other bytes in stretches of up to 127 after minus their number."""
    out, at = bytearray(), 0
    for m in [*_RUN.finditer(raw), None]:
        end = m.start() if m else len(raw)
        for i in range(at, end, 127):
            part = raw[i : min(i + 127, end)]
            out += bytes([256 - len(part)]) + part
        if m:
            out += bytes([m.end() - m.start() - 1]) + m[1]
            at = m.end()
    return bytes(out)


def rle_unpack(data: bytes, size: int) -> bytes:
    out, i = bytearray(), 0
    while i < len(data):
        n = data[i]
        if n > 127:
            part, i = data[i + 1 : i + 257 - n], i + 257 - n
            if len(part) != 256 - n:
                raise InvalidData("a run of literals is cut off")
        else:
            part, i = data[i + 1 : i + 2] * (n + 1), i + 2
            if not part:
                raise InvalidData("a repeated byte is cut off")
        out += part
        if len(out) > size:
            raise InvalidData("too many bytes")
    if len(out) != size:
        raise InvalidData(f"{len(out)} bytes instead of {size}")
    return bytes(out)


def pack(raw: bytes, codec: str) -> bytes:
    """raw under NONE, RLE, ZIPS or ZIP, or raw itself where that is no longer."""
    if codec == "NONE":
        return raw
    if codec not in ("RLE", "ZIPS", "ZIP"):
        raise Unsupported(f"compression {codec}")
    if codec != "RLE" and len(raw) <= 8:
        return raw  # no zlib stream is shorter
    stream = predict(interleave(raw))
    packed = rle_pack(stream) if codec == "RLE" else zlib.compress(stream)
    return packed if len(packed) < len(raw) else raw


def unpack(data: bytes, size: int, codec: str) -> bytes:
    if codec not in ("NONE", "RLE", "ZIPS", "ZIP"):
        raise Unsupported(f"compression {codec}")
    if len(data) == size:
        return data
    if codec == "NONE":
        raise InvalidData(f"{len(data)} bytes instead of {size}")
    return uninterleave(unpredict(rle_unpack(data, size) if codec == "RLE" else inflate(data, size)))


#: Bytes a sample in a native and in a 24-bit-float chunk, by pixel type.
NATIVE = {"UINT": 4, "HALF": 2, "FLOAT": 4}
REDUCED = {"UINT": 4, "HALF": 2, "FLOAT": 3}


def to_native(values: np.ndarray, kind: str) -> bytes:
    code = {"UINT": numeric.to_uint, "HALF": numeric.to_half}.get(kind, lambda x: x.astype("<f4", copy=False))(values)
    return code.astype(code.dtype.newbyteorder("<"), copy=False).tobytes()


def from_native(data: bytes, kind: str) -> np.ndarray:
    x = np.frombuffer(data, {"UINT": "<u4", "HALF": "<u2", "FLOAT": "<f4"}[kind])
    return numeric.from_half(x) if kind == "HALF" else x.astype(np.float32, copy=False)


def pxr24_pack(rows: list[tuple[np.ndarray, str]]) -> bytes:
    """Rows of (samples, kind): differences within a row in byte planes, the high bytes first, then zlib."""
    planes = []
    for values, kind in rows:
        code = {"FLOAT": numeric.to_pxr24, "UINT": numeric.to_uint, "HALF": numeric.to_half}[kind](values).astype(np.uint32)
        delta = np.diff(code, prepend=np.uint32(0)).astype(np.uint32)
        planes += [((delta >> np.uint32(8 * i)) & np.uint32(255)).astype(np.uint8).tobytes() for i in range(REDUCED[kind] - 1, -1, -1)]
    raw = b"".join(planes)
    packed = zlib.compress(raw)
    return packed if len(packed) < len(raw) else raw


def pxr24_unpack(data: bytes, rows: list[tuple[int, str]]) -> list[np.ndarray]:
    size = sum(n * REDUCED[kind] for n, kind in rows)
    raw = np.frombuffer(data if len(data) == size else inflate(data, size), np.uint8)
    at, out = 0, []
    for n, kind in rows:
        width = REDUCED[kind]
        planes = raw[at : at + n * width].reshape(width, n).astype(np.uint32)
        at += n * width
        delta = sum((planes[i] << np.uint32(8 * (width - 1 - i)) for i in range(width)), np.zeros(n, np.uint32))
        code = np.cumsum(delta, dtype=np.uint32)
        out.append({"FLOAT": numeric.from_pxr24, "HALF": lambda c: numeric.from_half(c & np.uint32(0xFFFF)), "UINT": lambda c: c.astype(np.float32)}[kind](code))
    return out


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    return numeric.linear_tables()


def _keys(code: np.ndarray) -> np.ndarray:
    code = code.astype(np.int64)
    return np.where(code & 0x7C00 == 0x7C00, 0x8000, np.where(code & 0x8000, 0xFFFF - code, code + 0x8000))


def b44_pack(values: np.ndarray, flat: bool = False, linear: bool = False) -> bytes:
    """A half plane in blocks of 4 x 4, each 14 bytes, or 3 where flat is set and all samples of the block are equal."""
    height, width = values.shape
    code = numeric.to_half(values)
    if linear:
        code = _tables()[0][code]
    padded = np.pad(code, ((0, -height % 4), (0, -width % 4)), mode="edge")
    t = _keys(padded.reshape(len(padded) // 4, 4, -1, 4).transpose(0, 2, 1, 3).reshape(-1, 16))
    top = t.max(axis=1)
    shift, d, r = np.zeros(len(t), np.int64), np.zeros_like(t), np.zeros((len(t), 15), np.int64)
    for a in range(0, len(t), 1024):  # the least shift whose 15 differences along the tree fit into 6 bits
        some = slice(a, a + 1024)
        x = ((top[some, None] - t[some]) << 1)[:, None].astype(np.int32)
        own = (x + _ROUND + (x >> _NEXT & 1)) >> _NEXT
        steps = own[:, :, _FROM] - own[:, :, _TO] + 32
        at = np.arange(len(x))
        shift[some] = best = (steps & ~63 == 0).all(axis=2).argmax(axis=1)
        d[some], r[some] = own[at, best], steps[at, best]
    first = t[:, 0] if linear else top - (d[:, 0] << shift)
    fields = np.concatenate([shift[:, None], r], axis=1).reshape(-1, 4, 4)  # four of 6 bits in three bytes
    words = (fields << _PLACES).sum(axis=2)
    packed = np.empty((len(t), 14), np.uint8)
    packed[:, 0], packed[:, 1] = first >> 8, first & 255
    for i in range(3):
        packed[:, 2 + i :: 3] = words >> (16 - 8 * i) & 255
    if not flat:
        return packed.tobytes()
    same = (t == t[:, :1]).all(axis=1)
    packed[same, 2] = 0xFC
    return packed[np.arange(14) < np.where(same, 3, 14)[:, None]].tobytes()


def _block_places(x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, bytes, flat) of n blocks laid end to end. Where each block begins follows from those before it.

    Stretches of blocks of one size are taken at once: as long as the guess holds, it is doubled.
    """
    at, size, done, place, guess = np.zeros(n, np.int64), np.zeros(n, np.int64), 0, 0, 16
    while done < n:
        if place + 3 > len(x):
            raise InvalidData("a block is cut off")
        own = 3 if x[place + 2] >= 0x34 else 14
        some = place + own * np.arange(min(guess, n - done))
        some = some[some + 2 < len(x)]
        alike = (x[some + 2] >= 0x34) == (own == 3)
        k = int(alike.argmin()) if not alike.all() else len(some)
        at[done : done + k], size[done : done + k] = some[:k], own
        done, place, guess = done + k, place + k * own, min(2 * guess, 4096) if k == len(some) else 16
    if place > len(x):
        raise InvalidData("a block is cut off")
    return at, size, size == 3


def b44_unpack(data: bytes, height: int, width: int, linear: bool = False) -> tuple[np.ndarray, int]:
    """(plane, bytes read)."""
    rows, cols = -(-height // 4), -(-width // 4)
    x, n = np.frombuffer(data, np.uint8), rows * cols
    at, size, is_flat = _block_places(x, n)
    whole = np.append(x, np.zeros(14, np.uint8))[at[:, None] + np.arange(14)]
    blocks = np.where(np.arange(14) < size[:, None], whole, 0).astype(np.uint8)
    at = int(at[-1] + size[-1]) if n else 0
    blocks = blocks.astype(np.int64)
    words = blocks[:, 2::3] << 16 | blocks[:, 3::3] << 8 | blocks[:, 4::3]
    fields = (words[:, :, None] >> _PLACES & 63).reshape(-1, 16)  # the shift and 15 differences
    steps = np.zeros((n, 4, 4), np.int64)  # by the tree: down the first column, then along each row
    np.multiply(~is_flat[:, None], (fields[:, 1:] - 32) << np.where(is_flat, 0, fields[:, 0])[:, None], out=fields[:, 1:])
    steps[:, 0, 0] = blocks[:, 0] << 8 | blocks[:, 1]
    steps[:, 1:, 0] = fields[:, 1:4]
    steps[:, :, 1:] = fields[:, 4:].reshape(-1, 3, 4).transpose(0, 2, 1)
    steps[:, :, 0] = np.cumsum(steps[:, :, 0], axis=1)
    s = np.cumsum(steps, axis=2).reshape(-1, 16) & 0xFFFF
    code = np.where(s & 0x8000, s & 0x7FFF, ~s & 0xFFFF).astype(np.uint16)
    if linear:
        code = _tables()[1][code]
    plane = code.reshape(rows, cols, 4, 4).transpose(0, 2, 1, 3).reshape(rows * 4, cols * 4)[:height, :width]
    return numeric.from_half(plane), at
