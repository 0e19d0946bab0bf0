"""Many small files of one spec, written and read together: chunks of one place of many files are made and decoded at once.

exr.write() and exr.read_lines() spread a large file over many tasks, and cost a few milliseconds of Python for every hundred chunks.
Here a task has whole files. Writing: it gets all rows of its files, makes their images as arrays over files, and writes each
file once, with no table between. Reading: it opens each small file once and decodes chunks of one shape together; files
of more than split_bytes are cut and dealt as in exr.read_chunks(). The bytes are those of layout.encode_file().
"""

from __future__ import annotations

import struct
import tempfile
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codecs
from ..plans.lineage import work_tasks
from . import exr, layout, planning
from .layout import InvalidData, Part
from .planning import Wanted

#: Files that are made together at most, and rows of them that a task gathers at least, but for its last ones.
FILES, ROWS = 128, 1 << 16
#: Bytes of a file's chunks that are held in memory while it is made; more go to a temporary file.
HELD = 4 << 20
#: Files dealt to a task at most, about.
DEALT = 4096


def tasks_for(spark: SparkSession, files: int) -> int:
    return max(work_tasks(spark), -(-files // DEALT))


# writing


@dataclass
class Flat:
    """A level of a flat part of n files: an array (n, height, width) for each channel, in the part's order."""

    planes: list[np.ndarray]


@dataclass
class Deep:
    """A level of a deep part of n files: the number of samples of each pixel and the place of its first one, both
    (n, height, width), and the samples of all files for each channel, in the part's order."""

    counts: np.ndarray
    starts: np.ndarray
    values: list[np.ndarray]


Images = dict[tuple[int, int, int], Flat | Deep]


class _Packed(dict):
    """Packed forms of bytes, which many chunks share (empty ones, say), each made once. Long ones are not kept."""

    LONG = 1 << 14

    def __init__(self, codec: str):
        super().__init__()
        self.codec = codec

    def __missing__(self, raw: bytes) -> bytes:
        out = codecs.pack(raw, self.codec)
        if len(raw) <= self.LONG:
            self[raw] = out
        return out


def _flat_bodies(part: Part, place: tuple[int, int, int, int], image: Flat, known: _Packed) -> list[bytes]:
    x, y, w, h = part.box(*place)
    head = struct.pack("<4i", *place) if part.tiled else struct.pack("<i", part.y0 + y)
    n = len(image.planes[0])
    if part.codec not in ("NONE", "RLE", "ZIPS", "ZIP") or any((c.xs, c.ys) != (1, 1) for c in part.channels):
        lines = ({(c.name, r): (p[i, r // c.ys, -(-x // c.xs) : -(-(x + w) // c.xs)], None) for c, p in zip(part.channels, image.planes, strict=True) for r in range(y, y + h) if r % c.ys == 0} for i in range(n))
        return [layout.encode_chunk(part, *place, own)[0] for own in lines]
    rows = [np.frombuffer(codecs.to_native(np.ascontiguousarray(p[:, y : y + h, x : x + w]), c.kind), np.uint8).reshape(n, h, -1) for c, p in zip(part.channels, image.planes, strict=True)]
    raw = (rows[0] if len(rows) == 1 else np.concatenate(rows, axis=2)).reshape(n, -1)
    return [head + struct.pack("<i", len(body)) + body for body in (known[raw[i].tobytes()] for i in range(n))]


def _deep_bodies(part: Part, place: tuple[int, int, int, int], image: Deep, known: _Packed) -> list[bytes]:
    x, y, w, h = part.box(*place)
    head = struct.pack("<4i", *place) if part.tiled else struct.pack("<i", part.y0 + y)
    counts, starts = (a[:, y : y + h, x : x + w].astype(np.int64) for a in (image.counts, image.starts))
    sums = counts.cumsum(axis=2)
    if sums.size and sums.max() >= 2**31:
        raise InvalidData("a row of more than 2^31 - 1 samples")
    n, own = len(counts), counts.ravel()
    before = np.concatenate([[0], np.cumsum(own)])
    at = np.repeat(starts.ravel() - before[:-1], own) + np.arange(before[-1])
    ends = before[:: w * h].tolist()
    tables, values = sums.reshape(n, -1).astype("<i4"), [codecs.to_native(v[at], c.kind) for c, v in zip(part.channels, image.values, strict=True)]
    width = [codecs.NATIVE[c.kind] for c in part.channels]
    out = []
    for i in range(n):
        raw = b"".join(v[ends[i] * k : ends[i + 1] * k] for v, k in zip(values, width, strict=True))
        table, packed = known[tables[i].tobytes()], known[raw]
        out.append(head + struct.pack("<3Q", len(table), len(packed), len(raw)) + table + packed)
    return out


def _laid_places(part: Part) -> list[tuple[int, tuple[int, int, int, int]]]:
    """(number, (tx, ty, lvl_x, lvl_y)) of the chunks of a part in the order in which they lie."""
    return sorted(enumerate(part.chunks()), key=lambda c: layout.laid(part, c[0]))


def files_of(spec: list[Part], images: Images) -> Iterator[Iterator[bytes]]:
    """The bytes of each of n files, in pieces; images has all levels of all parts."""
    layout.check_parts(spec)
    many = len(spec) > 1 or bool(spec[0].name)
    n = len(next(iter(images.values())).planes[0]) if isinstance(next(iter(images.values())), Flat) else len(next(iter(images.values())).counts)
    spools = [tempfile.SpooledTemporaryFile(max_size=HELD) for _ in range(n)]  # noqa: SIM115  closed below
    numbers, sizes = [], []
    tops, packed = np.zeros((n, len(spec)), np.int64), {p.codec: _Packed(p.codec) for p in spec}
    try:
        for no, part in enumerate(spec):
            if part.deep:
                tops[:, no] = np.max([images[no, *level].counts.max(axis=(1, 2)) for level in part.grids], axis=0)
            tag, base = (struct.pack("<i", no) if many else b""), sum(p.count for p in spec[:no])
            for number, place in _laid_places(part):
                bodies = (_deep_bodies if part.deep else _flat_bodies)(part, place, images[no, *place[2:]], packed[part.codec])
                for spool, body in zip(spools, bodies, strict=True):
                    spool.write(tag + body)
                numbers.append(base + number)
                sizes.append([len(tag) + len(body) for body in bodies])
        size = np.array(sizes, np.int64).reshape(-1, n)
        table = np.empty((n, len(numbers)), np.int64)
        table[:, numbers] = (size.cumsum(axis=0) - size).T
        heads: dict[tuple, bytes] = {}
        for i, spool in enumerate(spools):
            own = tuple(tops[i].tolist())
            if own not in heads:
                heads[own] = layout.encode_headers(spec, list(own))
            yield _pieces(heads[own] + (table[i] + len(heads[own]) + 8 * len(numbers)).astype("<u8").tobytes(), spool)
    finally:
        for spool in spools:
            spool.close()


def _pieces(head: bytes, spool) -> Iterator[bytes]:
    yield head
    spool.seek(0)
    while piece := spool.read(1 << 20):
        yield piece


def whole_files(batches: Iterator[pa.RecordBatch], key: str = "file") -> Iterator[pa.Table]:
    """Tables of all rows of up to FILES files each, from batches in which the rows of a file follow one another."""
    held, size, least = [], 0, ROWS

    def cut(table: pa.Table, last: bool) -> tuple[list[pa.Table], pa.Table]:
        of = table.column(key).to_numpy()
        begins = np.concatenate([[0], np.nonzero(np.diff(of))[0] + 1])
        stops = [*begins[FILES::FILES].tolist(), len(of) if last else int(begins[-1])]
        firsts = [0, *stops[:-1]]
        return [table.slice(a, b - a).combine_chunks() for a, b in zip(firsts, stops, strict=True) if b > a], table.slice(stops[-1])

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.num_rows
        if size >= least:
            found, rest = cut(pa.Table.from_batches(held), False)
            yield from found
            held, size = rest.to_batches(), rest.num_rows
            least = max(ROWS, 2 * size)  # a file of very many rows is not gathered anew with each batch
    if held:
        yield from cut(pa.Table.from_batches(held), True)[0]


def write(rows: DataFrame, spec: list[Part], folder: str, images: Callable[[pa.Table], tuple[list[int], Images]], files: int) -> DataFrame:
    """Write folder/N.exr for each number N in the column file of rows, and give rows as exr.write() does.

    images: numbers and images of the files of a table that has all their rows, in any order within a file. files: about how many
    there are. A file appears when it is whole, and a task that is run again does no harm.
    """
    text = exr.parts_json(spec)
    exr.make_folder(rows.sparkSession, folder)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        told, schema = exr.parts_of_json(text), exr.arrow_schema(exr.WRITTEN)
        system, root = fs.FileSystem.from_uri(folder)
        for table in whole_files(batches):
            numbers, made = images(table)
            names, sizes = [f"{root}/{number}.{exr.EXTENSION}" for number in numbers], []
            for name, pieces in zip(names, files_of(told, made), strict=True):
                draft = f"{root}/_draft-{uuid.uuid4().hex}"
                with system.open_output_stream(draft) as out:
                    for piece in pieces:
                        out.write(piece)
                    sizes.append(out.tell())
                system.move(draft, name)
            yield pa.RecordBatch.from_pydict({"path": [str(n) for n in numbers], "file": names, "bytes": sizes}, schema=schema)

    return rows.repartition(tasks_for(rows.sparkSession, files), "file").sortWithinPartitions("file").mapInArrow(work, exr.WRITTEN)


# reading

BLOCKS = "path string, part_no int, lvl_x int, lvl_y int, channel string, y0 int, x0 int, w int, samples array<float>, pixels array<int>, nth array<int>"
#: Bytes of samples that are decoded together, about, or one chunk.
DECODED = 8 << 20


@dataclass(eq=False)
class Shape:
    """Chunks of one size of a part. plain: they are decoded together, many at a time."""

    part: Part
    w: int
    h: int

    def __post_init__(self) -> None:
        self.width = [codecs.NATIVE[c.kind] for c in self.part.channels]
        self.size = self.w * self.h * sum(self.width)
        self.plain = self.part.deep or self.part.codec in ("NONE", "RLE", "ZIPS", "ZIP") and all((c.xs, c.ys) == (1, 1) for c in self.part.channels)

    def takes(self, table_size: int) -> bool:
        return self.plain and table_size <= 4 * self.w * self.h  # a larger table is that of a whole tile


@lru_cache(maxsize=1024)
def _part(text: str) -> Part:
    return exr._part(text)


@lru_cache(maxsize=65536)
def _shape(text: str, w: int, h: int) -> Shape:
    return Shape(_part(text), w, h)


#: Of a plain chunk: its shape, path, part_no, lvl_x, lvl_y, x, y, table_size, unpacked_size and payload.
Chunk = tuple[Shape, str, int, int, int, int, int, int, int, bytes]


class Known:
    """What files with the same header bytes share: the plan, its parts as JSON, and how each chunk begins if the tables are in order."""

    def __init__(self, head: bytes, plan: layout.Plan):
        self.head, self.plan, self.texts = head, plan, [exr._part_json(p) for p in plan.parts]
        self.table, self.chunks = struct.Struct(f"<{sum(plan.counts)}Q"), []
        whole = all(p.count == n for p, n in zip(plan.parts, plan.counts, strict=True))
        for no, part in enumerate(plan.parts if whole else []):  # or else the window may tell of any number
            tag = struct.pack("<i", no) if plan.many else b""
            for tx, ty, lx, ly in part.chunks():
                x, y, w, h = part.box(tx, ty, lx, ly)
                begin = tag + (struct.pack("<4i", tx, ty, lx, ly) if part.tiled else struct.pack("<i", part.y0 + y))
                self.chunks.append((begin, _shape(self.texts[no], w, h), no, lx, ly, x, y))
        self.plain = whole and all(c[1].plain for c in self.chunks)

    def cut(self, path: str, data: bytes) -> list[Chunk] | None:
        """The chunks of a file of plain ones whose tables are in order; None of any other, and of any damage."""
        if not self.plain:
            return None
        offsets, n, out = self.table.unpack_from(data, self.plan.at), len(data), []
        if min(offsets) < self.plan.body or len(set(offsets)) < len(offsets):
            return None
        for (begin, shape, no, lx, ly, x, y), at in zip(self.chunks, offsets, strict=True):
            if not data.startswith(begin, at):
                return None
            at += len(begin)
            table_size = unpacked = 0
            if shape.part.deep:
                if at + 24 > n:
                    return None
                table_size, size, unpacked = _THREE.unpack_from(data, at)
                at, size = at + 24, table_size + size
            else:
                if at + 4 > n:
                    return None
                (size,) = _ONE.unpack_from(data, at)
                at += 4
            if size < 0 or at + size > n or not shape.takes(table_size):
                return None
            out.append((shape, path, no, lx, ly, x, y, table_size, unpacked, data[at : at + size]))
        return out


_ONE, _THREE = struct.Struct("<i"), struct.Struct("<3Q")


class Heads:
    """What is known of files by their header bytes, each made once."""

    MOST = 64

    def __init__(self) -> None:
        self.known: list[Known] = []

    def of(self, data: bytes) -> Known:
        for k in self.known:
            if data.startswith(k.head) and k.plan.body <= len(data) and all(p.width * p.height <= 4 * len(data) * 65536 for p in k.plan.parts):
                return k
        plan = layout.plan_of(data, len(data))
        self.known = [Known(data[: plan.at], plan), *self.known[: self.MOST - 1]]
        return self.known[0]


def file_chunks(path: str, data: bytes, entry: str, heads: Heads) -> list[Chunk] | list[dict]:
    """The chunks of a whole file; as exr.range_rows() gives them where they are not plain, or do not lie as its headers tell."""
    known = heads.of(data)
    plan = known.plan
    exr._guard(plan.version, plan.parts, entry)
    if found := known.cut(path, data):
        return found
    read = lambda at, n: data[at : at + n]
    index, rows = planning.index_of(plan, read, len(data)), []
    for no, number, at in zip(index.part.tolist(), index.number.tolist(), index.start.tolist(), strict=True):
        row, _ = plan.chunk(data, at)
        if row["part_no"] != no:
            raise InvalidData(f"a chunk of part {row['part_no']} in the table of part {no}; a walk by headers (recover) does not need the table")
        row.update(path=path, part=known.texts[no], chunk_idx=number)
        rows.append(row)
    if not index.walked:
        planning.check_places(plan, read, len(data), rows, Wanted())
    return rows


class _Unpacked(dict):
    """Bytes by (packed, size), each unpacked once."""

    def __init__(self, codec: str):
        super().__init__()
        self.codec = codec

    def __missing__(self, key: tuple[bytes, int]) -> bytes:
        out = self[key] = codecs.unpack(*key, self.codec)
        return out


def _list(values: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum(sizes)])
    if ends[-1] >= 2**31:
        raise InvalidData("more than 2^31 - 1 samples at once")
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values, kind))


def _none(n: int) -> pa.Array:
    return pa.nulls(n, pa.list_(pa.int32()))


def _flat_blocks(shape: Shape, found: list[Chunk]) -> tuple[pa.Array, pa.Array, pa.Array]:
    """samples, pixels and nth of chunks of one shape, a list for each chunk and channel."""
    known, n = _Unpacked(shape.part.codec), len(found) * len(shape.width)
    raw = b"".join([known[c[-1], shape.size] for c in found])
    if n == len(found):
        values = codecs.from_native(raw, shape.part.channels[0].kind)
    else:
        rows, ends = np.frombuffer(raw, np.uint8).reshape(len(found), shape.h, -1), np.cumsum([0, *(k * shape.w for k in shape.width)])
        values = np.stack([codecs.from_native(rows[:, :, a:b].tobytes(), c.kind).reshape(len(found), -1) for c, a, b in zip(shape.part.channels, ends[:-1], ends[1:], strict=True)], axis=1).ravel()
    return _list(values, np.full(n, shape.w * shape.h), pa.float32()), _none(n), _none(n)


def _deep_blocks(shape: Shape, found: list[Chunk]) -> tuple[pa.Array, pa.Array, pa.Array]:
    part, w, h, width = shape.part, shape.w, shape.h, shape.width
    many, known = len(width), _Unpacked(part.codec)
    tables = np.frombuffer(b"".join([known[payload[:n], 4 * w * h] for *_, n, _, payload in found]), "<i4").reshape(len(found), h, w).astype(np.int64)
    counts = np.diff(tables, axis=2, prepend=0)
    if counts.min() < 0:
        raise InvalidData("cumulative counts that fall")
    totals = tables[:, :, -1].sum(axis=1)
    told, raw = (totals * sum(width)).tolist(), []
    for (*_, n, unpacked, payload), size in zip(found, told, strict=True):
        if unpacked != size:
            raise InvalidData(f"the samples take {size} bytes, not the {unpacked} that are told")
        raw.append(known[payload[n:], size] if size else b"")
    if len(set(c.kind for c in part.channels)) == 1:
        values = codecs.from_native(b"".join(raw), part.channels[0].kind)
    else:
        cuts = [np.cumsum([0, *(n * k for k in width)]).tolist() for n in totals.tolist()]
        values = np.concatenate([codecs.from_native(data[a:b], c.kind) for data, at in zip(raw, cuts, strict=True) for c, a, b in zip(part.channels, at[:-1], at[1:], strict=True)])
    own = np.repeat(counts.reshape(len(found), -1), many, axis=0)  # of each chunk and channel
    sizes, flat = own.sum(axis=1), own.ravel()
    pixels = np.repeat(np.tile(np.arange(w * h, dtype=np.int32), len(own)), flat)
    nth = np.arange(len(values)) - np.repeat(np.cumsum(flat) - flat, flat)
    return _list(values, sizes, pa.float32()), _list(pixels, sizes, pa.int32()), _list(nth.astype(np.int32), sizes, pa.int32())


def _columns(names: list[str], places: list[tuple], w: int, lists: tuple[pa.Array, pa.Array, pa.Array]) -> list[pa.Array]:
    """Columns of BLOCKS of chunks (path, part_no, lvl_x, lvl_y, x, y) with these channels."""
    path, *keys = zip(*places, strict=True)
    no, lx, ly, x, y = (pa.array(np.repeat(np.array(k, np.int32), len(names))) for k in keys)
    rows = len(places) * len(names)
    paths = pa.array(path, pa.string())
    return [paths if len(names) == 1 else paths.take(pa.array(np.repeat(np.arange(len(path)), len(names)))), no, lx, ly, pa.array(names * len(places), pa.string()), y, x, pa.array(np.full(rows, w, np.int32)), *lists]


def _batch(held: dict[Shape, list[Chunk]], single: list[dict]) -> pa.RecordBatch:
    """A batch of BLOCKS of chunks by shape, and of single ones."""
    out = []
    for shape, found in held.items():
        lists = (_deep_blocks if shape.part.deep else _flat_blocks)(shape, found)
        out.append(_columns([c.name for c in shape.part.channels], [c[1:7] for c in found], shape.w, lists))
    for r in single:
        for channel, y, x, counts, samples in layout.decode_chunk(_part(r["part"]), r):
            w, n = len(samples) if counts is None else len(counts), np.array([len(samples)])
            pixels = nth = _none(1)
            if counts is not None:
                pixels = _list(np.repeat(np.arange(w, dtype=np.int32), counts), n, pa.int32())
                nth = _list((np.arange(len(samples)) - np.repeat(np.cumsum(counts) - counts, counts)).astype(np.int32), n, pa.int32())
            out.append(_columns([channel], [(r["path"], r["part_no"], r["lvl_x"], r["lvl_y"], x, y)], max(w, 1), (_list(samples, n, pa.float32()), pixels, nth)))
    return pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in zip(*out, strict=True)], names=exr._names(BLOCKS))


def decoded(chunks: Iterator[Chunk | dict]) -> Iterator[pa.RecordBatch]:
    """Batches of BLOCKS of about DECODED bytes of samples."""
    held, single, size = {}, [], 0
    for c in chunks:
        if isinstance(c, dict):
            x, y, w, h = _part(c["part"]).box(c["tx"], c["ty"], c["lvl_x"], c["lvl_y"])
            shape, row = _shape(c["part"], w, h), c
            c = (shape, c["path"], c["part_no"], c["lvl_x"], c["lvl_y"], x, y, c["table_size"], c["unpacked_size"], c["payload"])
        shape = c[0]
        own = 256 + (max(c[8], len(c[9])) if shape.part.deep else shape.size)
        if size and size + own > DECODED:
            yield _batch(held, single)
            held, single, size = {}, [], 0
        size += own
        if shape.takes(c[7]):
            held.setdefault(shape, []).append(c)
        else:
            single.append(row)
    if size:
        yield _batch(held, single)


def read(spark: SparkSession, path: str, entry: str = "any", files: int = 0, split_bytes: int = 4 << 20) -> DataFrame:
    """Rows of BLOCKS of all files under path: the samples of a channel of a chunk, row by row from (x0, y0) on, w pixels a row.

    pixels and nth tell of each sample of a deep part the pixel of the block and its number there; they are null for
    flat ones. Damage is an error. files: about how many there are.
    """

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, length in zip(batch.column("path").to_pylist(), batch.column("length").to_pylist(), strict=True):
                if length <= split_bytes:  # opened once, where it is decoded
                    rows.append({"path": name, "length": length, "start": 0, "stop": length})
                else:
                    with exr.open_file(name) as f:
                        rows += exr.file_splits(f, name, length, split_bytes, entry)
            yield pa.RecordBatch.from_pylist(rows, schema=exr.arrow_schema(exr.SPLITS))

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        heads = Heads()
        for batch in batches:
            small = batch.column("offsets").is_null().to_numpy(zero_copy_only=False)
            for i, (name, length) in enumerate(zip(batch.column("path").to_pylist(), batch.column("length").to_pylist(), strict=True)):
                if small[i]:
                    with exr.open_file(name) as f:
                        data = f.read_at(length, 0)
                    yield from file_chunks(name, data, entry, heads)
                else:
                    for rows in exr.range_rows(iter([batch.slice(i, 1)]), entry):
                        yield from rows

    found = exr.listed(spark, path).coalesce(work_tasks(spark)).mapInArrow(plan, exr.SPLITS)
    return found.repartition(tasks_for(spark, files), "path", "start").mapInArrow(lambda batches: decoded(chunks(batches)), BLOCKS)


def samples(blocks: DataFrame, keys: tuple[str, ...] = ("path", "part_no", "lvl_x", "lvl_y", "channel")) -> DataFrame:
    """keys, y, x, sample_idx, value of rows of BLOCKS; flat samples have sample_idx -1."""
    told = blocks.select(*keys, "y0", "x0", "w", "pixels", "nth", F.posexplode("samples").alias("i", "value"))
    at = F.coalesce(F.get("pixels", F.col("i")), F.col("i"))
    whole = told.select(*keys, "y0", "x0", "w", at.alias("at"), F.coalesce(F.get("nth", F.col("i")), F.lit(-1)).alias("sample_idx"), "value")
    return whole.select(*keys, (F.col("y0") + F.expr("CAST(at DIV w AS INT)")).alias("y"), (F.col("x0") + F.col("at") % F.col("w")).alias("x"), "sample_idx", "value")
