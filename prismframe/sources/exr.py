"""Raster files as relations: headers, attributes, channels, chunks, scanlines and pixels, and back to files.

read_chunks() plans byte ranges from the headers and offset tables alone, deals them to tasks, and each task reads and cuts its
ranges, so one large file is read and decoded by many tasks. It opens files through Arrow's file systems. files() goes through
Spark's binaryFile source instead, for any store that Spark reads: there a file is read by one task and must fit in a cell
(2 GB), and chunks(..., spread=n) deals its chunks to further tasks for decoding. Filters and column choices come before decoding.

Writing goes the other way: rows of samples are dealt to chunks and encoded by many tasks. write() then streams each file from
its finished chunks, whose places follow from a running sum of their sizes; encode() makes small files as rows (path, content).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from dataclasses import asdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry
from ..functions.numeric import preview_quantise
from ..operators.tables import running_offsets
from ..plans.lineage import cut, work_tasks
from . import layout, planning
from .layout import Channel, InvalidData, Part, Unsupported
from .planning import Wanted

EXTENSION = "exr"
#: Readers by name, as (many parts, kinds, level modes) that each accepts. "single" gives level (0, 0) only, and
#: the readers of deep tiles, but for "mixed" and "any", refuse levels that are rounded up.
_FLAT, _DEEP = ("scanlineimage", "tiledimage"), ("deepscanline", "deeptile")
ENTRIES = {
    "single": (False, _FLAT, (0, 1, 2)), "tiled_multilevel": (False, ("tiledimage",), (0, 1, 2)), "multipart": (True, ("scanlineimage",), (0,)), "multipart_tiled": (True, ("tiledimage",), (0,)),
    "multipart_tiled_multilevel": (True, ("tiledimage",), (0, 1, 2)), "deep_scanline": (False, ("deepscanline",), (0,)), "deep_multipart": (True, ("deepscanline",), (0,)), "deep_tiled": (False, ("deeptile",), (0,)),
    "multipart_deep_tiled": (True, ("deeptile",), (0,)), "deep_tiled_mipmap": (False, ("deeptile",), (1,)), "deep_tiled_ripmap": (False, ("deeptile",), (2,)), "multipart_deep_tiled_mipmap": (True, ("deeptile",), (1,)),
    "multipart_deep_tiled_ripmap": (True, ("deeptile",), (2,)), "mixed": (True, (*_FLAT, *_DEEP), (0, 1, 2)), "any": (None, (*_FLAT, *_DEEP), (0, 1, 2)),
}

_VALUE = "ints array<long>, floats array<double>, string string, strings array<string>, raw binary"
ATTRIBUTES = f"path string, version long, part_no int, attr_idx int, name string, type_name string, {_VALUE}"
PARTS = "path string, version long, part_no int, name string, kind string, codec string, width long, height long, x0 int, y0 int, tile_x long, tile_y long, mode int, up boolean, chunks long"
CHANNELS = "path string, part_no int, ch_idx int, name string, pixel_type string, p_linear boolean, x_sampling int, y_sampling int"
SPLITS = "path string, length long, start long, stop long, part_nos array<int>, chunk_idxs array<int>, offsets array<long>, walked boolean, error string"
CHUNKS = "path string, part string, part_no int, chunk_idx int, y int, tx int, ty int, lvl_x int, lvl_y int, table_size long, unpacked_size long, payload binary, error string"
LINES = "path string, part_no int, lvl_x int, lvl_y int, channel string, y int, x0 int, counts array<int>, starts array<int>, samples array<float>"
#: What a damaged file or chunk does: an error of the job, a row with nothing but its place and the error, or no row.
MODES = FAILFAST, PERMISSIVE, DROPMALFORMED = ("FAILFAST", "PERMISSIVE", "DROPMALFORMED")


def files(spark: SparkSession, path: str) -> DataFrame:
    """Rows (path, content) of the files under path."""
    return spark.read.format("binaryFile").option("pathGlobFilter", f"*.{EXTENSION}").load(path).select("path", "content")


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


_ARROW = {"string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(), "int": pa.int32(), "long": pa.int64(), "float": pa.float32(), "double": pa.float64()}


def arrow_schema(schema: str) -> pa.Schema:
    """The Arrow schema of a DDL string of the types used here."""
    out = []
    for field in schema.split(", "):
        name, kind = field.split()
        out.append((name, pa.list_(_ARROW[kind[6:-1]]) if kind.startswith("array<") else _ARROW[kind]))
    return pa.schema(out)


def _rows(schema: str, make: Callable[[bytes], Iterator[dict]], batch_bytes: int = 8 << 20) -> Callable:
    """A mapInArrow function that turns (path, content) into rows (dicts) of a schema, in batches of about batch_bytes."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told, rows, size = arrow_schema(schema), [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                path, content = batch.column("path")[i].as_py(), batch.column("content")[i].as_py()
                for r in make(content):
                    rows.append({"path": path} | r)
                    size += 1024 + len(r.get("payload") or b"")
                    if size > batch_bytes:
                        yield pa.RecordBatch.from_pylist(rows, schema=told)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=told)

    return work


def _part_json(part: Part) -> str:
    return json.dumps(asdict(part), default=list)  # bytes as numbers


def _part(text: str) -> Part:
    d = json.loads(text)
    return Part(**{**d, "channels": [Channel(**c) for c in d["channels"]], "tile": tuple(d["tile"]), "extra": [tuple(x) for x in d["extra"]]})


def parts_json(spec: list[Part]) -> str:
    """Parts as the option `parts` of the sink."""
    return json.dumps([_part_json(p) for p in spec])


def parts_of_json(text: str) -> list[Part]:
    return [_part(x) for x in json.loads(text)]


class _Parts(dict):
    """Parts by their text, each made once a task."""

    def __missing__(self, text: str) -> Part:
        out = self[text] = _part(text)
        return out


def _attribute_rows(content: bytes) -> list[dict]:
    version, parts, _ = layout.decode_header(content)
    return [{"version": version, "part_no": no, "attr_idx": i, "name": n, "type_name": k, "raw": d} | layout.decode_value(k, d) for no, own in enumerate(parts) for i, (n, k, d) in enumerate(own)]


def attribute_batches(path: str, content: bytes) -> Iterator[pa.RecordBatch]:
    yield pa.RecordBatch.from_pylist([{"path": path} | r for r in _attribute_rows(content)], schema=arrow_schema(ATTRIBUTES))


def attributes(found: DataFrame) -> DataFrame:
    """Every attribute of every part, in order; found has path and content, of which the headers suffice."""
    return found.mapInArrow(_rows(ATTRIBUTES, _attribute_rows), ATTRIBUTES)


def parts(found: DataFrame) -> DataFrame:
    def make(content: bytes) -> list[dict]:
        version, headers, _ = layout.decode_header(content)
        told = [layout.part_of(version, h)[0] for h in headers]
        return [{"version": version, "part_no": no, "tile_x": p.tile[0] if p.tiled else None, "tile_y": p.tile[1] if p.tiled else None, "chunks": p.count} | {k: getattr(p, k) for k in ("name", "kind", "codec", "width", "height", "x0", "y0", "mode", "up")} for no, p in enumerate(told)]

    return found.mapInArrow(_rows(PARTS, make), PARTS)


def channels(found: DataFrame) -> DataFrame:
    def make(content: bytes) -> list[dict]:
        version, headers, _ = layout.decode_header(content)
        return [
            {"part_no": no, "ch_idx": i, "name": c.name, "pixel_type": c.kind, "p_linear": c.linear, "x_sampling": c.xs, "y_sampling": c.ys}
            for no, h in enumerate(headers) for i, c in enumerate(layout.part_of(version, h)[0].channels)
        ]

    return found.mapInArrow(_rows(CHANNELS, make), CHANNELS)


def _guard(version: int, told: list[Part], entry: str) -> None:
    many, kinds, modes = ENTRIES[entry]
    wrong = any(p.kind not in kinds or p.tiled and p.mode not in modes or p.up and p.deep and entry not in ("mixed", "any") for p in told)
    if wrong or many is not None and many != bool(version & layout.MULTIPART):
        raise Unsupported(f"the reader {entry} does not read this kind of file")


def _first_level(packed: DataFrame, entry: str) -> DataFrame:
    return packed.where("lvl_x = 0 AND lvl_y = 0") if entry == "single" else packed


def chunks(found: DataFrame, entry: str = "any", spread: int | None = None) -> DataFrame:
    """A row for each chunk with its packed payload; found has path and content.

    entry: refuse files that the reader of this name refuses. spread: deal the chunks to so many tasks.
    """

    packed = _first_level(found.mapInArrow(_rows(CHUNKS, lambda content: _chunks_of(content, entry)), CHUNKS), entry)
    return packed if spread is None else packed.repartition(spread, "path", "part_no", "chunk_idx")


def _chunks_of(content: bytes, entry: str) -> Iterator[dict]:
    version, headers, _ = layout.decode_header(content)
    told = [layout.part_of(version, h)[0] for h in headers]
    _guard(version, told, entry)
    texts = [_part_json(p) for p in told]
    return ({"part": texts[r["part_no"]]} | r for r in layout.walk_chunks(content))


def lines_of(found: DataFrame, entry: str = "any") -> DataFrame:
    """Rows as lines(chunks(found, entry)) gives them; a file is cut and decoded by one worker, and its chunks are no rows between."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = ((path.as_py(), content.as_py()) for batch in batches for path, content in zip(batch.column("path"), batch.column("content"), strict=True))
        rows = ({"path": path} | r for path, content in files for r in _chunks_of(content, entry))
        return _decoded((r for r in rows if entry != "single" or r["lvl_x"] == r["lvl_y"] == 0), None, Wanted(), FAILFAST)

    return found.mapInArrow(work, LINES)


def open_file(path: str):
    """A file of a path or URI for reading in ranges."""
    from pyarrow import fs

    system, place = fs.FileSystem.from_uri(path)
    return system.open_input_file(place)


def range_reader(f) -> Callable[[int, int], bytes]:
    return lambda at, n: f.read_at(n, at)


def listed(spark: SparkSession, path: str) -> DataFrame:
    """Rows (path, length) of the files under path; no file is opened."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{EXTENSION}").option("recursiveFileLookup", "true").load(path)
    return found.select("path", "length")


def heads(spark: SparkSession, path: str) -> DataFrame:
    """Rows (path, content) for attributes(), parts() and channels(): of each file only what holds its headers."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, length in zip(batch.column("path").to_pylist(), batch.column("length").to_pylist(), strict=True):
                with open_file(path) as f:
                    at = layout.plan_by_ranges(range_reader(f), length).at
                    yield pa.RecordBatch.from_pydict({"path": [path], "content": [f.read_at(at, 0)]}, schema=arrow_schema("path string, content binary"))

    return listed(spark, path).coalesce(work_tasks(spark)).mapInArrow(read, "path string, content binary")


def file_splits(f, path: str, length: int, split_bytes: int, entry: str = "any", wanted: Wanted = Wanted(), recover: bool = False, mode: str = FAILFAST, within: tuple[int, int] | None = None) -> list[dict]:  # noqa: B008  not changed
    """Rows of SPLITS of an open file, of its wanted chunks. within: only of chunks that begin in this range of bytes."""
    whole = {"path": path, "length": length, "start": 0, "stop": 0, "part_nos": [], "chunk_idxs": [], "offsets": [], "walked": False}
    lead = within is None or within[0] == 0
    try:
        plan = layout.plan_by_ranges(range_reader(f), length)
        _guard(plan.version, plan.parts, entry)
        index = planning.index_of(plan, range_reader(f), length, wanted, recover, mode == FAILFAST)
    except (InvalidData, Unsupported) as e:
        if mode == FAILFAST:
            raise
        return [whole | {"error": f"{type(e).__name__}: {e}"}] if lead else []
    if within is not None:
        index = index.take(np.nonzero((index.start >= within[0]) & (index.start < within[1]))[0])
    rows = []
    for a, b in planning.runs(index, split_bytes):
        rows.append(whole | {"start": index.start[a], "stop": index.stop[b - 1], "part_nos": index.part[a:b], "chunk_idxs": index.number[a:b], "offsets": index.start[a:b], "walked": index.walked, "error": None})
    for no, number, what in index.bad if lead else []:
        rows.append(whole | {"part_nos": [no], "chunk_idxs": [number], "offsets": [-1], "error": f"InvalidData: {what}"})
    return rows


def splits(spark: SparkSession, path: str, split_bytes: int = 4 << 20, entry: str = "any", wanted: Wanted = Wanted(), recover: bool = False, mode: str = FAILFAST) -> DataFrame:  # noqa: B008  not changed
    """Rows of SPLITS: runs of neighbouring chunks of about split_bytes, from headers and offset tables alone."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, length in zip(batch.column("path").to_pylist(), batch.column("length").to_pylist(), strict=True):
                with open_file(path) as f:
                    rows = file_splits(f, path, length, split_bytes, entry, wanted, recover, mode)
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=arrow_schema(SPLITS))

    return listed(spark, path).coalesce(work_tasks(spark)).mapInArrow(split, SPLITS)


def range_rows(batches: Iterator[pa.RecordBatch], entry: str, wanted: Wanted = Wanted(), mode: str = FAILFAST) -> Iterator[list[dict]]:  # noqa: B008  not changed
    """The rows of CHUNKS of each row of SPLITS, with missing columns left out; a task holds one range at a time."""
    last, plan, texts = None, None, []
    for batch in batches:
        for i in range(batch.num_rows):  # one by one: the places of all ranges of a batch are many objects
            s = batch.slice(i, 1).to_pylist()[0]
            if s["error"]:
                if mode == PERMISSIVE:
                    place = {"part_no": s["part_nos"][0], "chunk_idx": s["chunk_idxs"][0]} if s["part_nos"] else {}
                    yield [{"path": s["path"], "error": s["error"]} | place]
                continue
            if not 0 <= s["start"] <= s["stop"] <= s["length"]:
                raise InvalidData(f"a chunk outside {s['path']}")
            rows = []
            with open_file(s["path"]) as f:
                if s["path"] != last:
                    last, plan = s["path"], layout.plan_by_ranges(range_reader(f), s["length"])
                    _guard(plan.version, plan.parts, entry)
                    texts = [_part_json(p) for p in plan.parts]
                data = f.read_at(s["stop"] - s["start"], s["start"])
                for no, idx, at in zip(s["part_nos"], s["chunk_idxs"], s["offsets"], strict=True):
                    try:
                        row, _ = plan.chunk(data, at - s["start"])
                        if row["part_no"] != no:
                            raise InvalidData(f"a chunk of part {row['part_no']} in the table of part {no}; a walk by headers (recover) does not need the table")
                        row = {"path": s["path"], "part": texts[no], "chunk_idx": idx} | row
                        if not s["walked"] and mode != FAILFAST:
                            planning.check_places(plan, range_reader(f), s["length"], [row], wanted)
                        rows.append(row)
                    except InvalidData as e:
                        if mode == FAILFAST:
                            raise
                        if mode == PERMISSIVE:
                            rows.append({"path": s["path"], "part": texts[no], "part_no": no, "chunk_idx": idx, "error": f"InvalidData: {e}"})
                if not s["walked"] and mode == FAILFAST:  # all at once, since any is an error of the job
                    planning.check_places(plan, range_reader(f), s["length"], rows, wanted)
            yield rows


def range_batches(batches: Iterator[pa.RecordBatch], entry: str, wanted: Wanted = Wanted(), mode: str = FAILFAST) -> Iterator[pa.RecordBatch]:  # noqa: B008  not changed
    """Batches of SPLITS to batches of CHUNKS."""
    schema = arrow_schema(CHUNKS)
    for rows in range_rows(batches, entry, wanted, mode):
        yield pa.RecordBatch.from_pylist(rows, schema=schema)


def _mode(mode: str) -> str:
    if mode.upper() not in MODES:
        raise ValueError(f"mode must be one of {', '.join(MODES)}")
    return mode.upper()


def read_chunks(
    spark: SparkSession, path: str, entry: str = "any", split_bytes: int = 4 << 20, tasks: int | None = None, wanted: Wanted = Wanted(), recover: bool = False, mode: str = FAILFAST,  # noqa: B008  not changed
) -> DataFrame:
    """Rows as chunks() gives them, for the files under path, each file in many tasks.

    wanted: read no more than the chunks that hold these parts, levels, rows or this window. recover: find chunks by their
    headers, one after another, instead of by the offset tables (done in any case where a file of many parts has
    tables that are not filled in). mode: what damage does (see MODES); error tells it in rows of PERMISSIVE.
    No file gives no rows.
    """
    mode = _mode(mode)
    if entry == "single":
        wanted = wanted.narrowed("lvl_x", 0, 0).narrowed("lvl_y", 0, 0)
    dealt = _dealt(spark, path, entry, split_bytes, tasks, wanted, recover, mode)
    return dealt.mapInArrow(lambda batches: range_batches(batches, entry, wanted, mode), CHUNKS)


def _dealt(spark: SparkSession, path: str, entry: str, split_bytes: int, tasks: int | None, wanted: Wanted, recover: bool, mode: str) -> DataFrame:
    """Rows of SPLITS dealt to tasks: so many by number, since by their bytes, which tell nothing of the work, few tasks would get all."""
    found = splits(spark, path, split_bytes, entry, wanted, recover, mode)
    return found.repartition(tasks or work_tasks(spark), "path", "start")


def read_lines(
    spark: SparkSession, path: str, entry: str = "any", only: list[str] | None = None, split_bytes: int = 4 << 20, tasks: int | None = None, wanted: Wanted = Wanted(), recover: bool = False, mode: str = FAILFAST,  # noqa: B008  not changed
) -> DataFrame:
    """Rows as lines(read_chunks(...)) gives them; the chunks are decoded where they are read, and are no rows between."""
    mode = _mode(mode)
    cropped_to = wanted
    if entry == "single":
        wanted = wanted.narrowed("lvl_x", 0, 0).narrowed("lvl_y", 0, 0)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _decoded((r for rows in range_rows(batches, entry, wanted, mode) for r in rows), only, cropped_to, mode)

    return _dealt(spark, path, entry, split_bytes, tasks, wanted, recover, mode).mapInArrow(work, _lines_schema(mode))


def _lines_schema(mode: str) -> str:
    return LINES + (", error string" if mode == PERMISSIVE else "")


def incomplete(packed: DataFrame) -> DataFrame:
    """path, part_no, chunks, places, expected of the parts whose chunks do not cover each place once."""
    expected = F.udf(lambda text: _part(text).count, "long")
    place = F.struct("lvl_x", "lvl_y", "tx", "ty")
    found = packed.groupBy("path", "part_no", "part").agg(F.count(F.lit(1)).alias("chunks"), F.count_distinct(place).alias("places"))
    return found.withColumn("expected", expected("part")).where("chunks <> expected OR places <> expected").drop("part")


def _lists(values: list[np.ndarray | None], kind: pa.DataType) -> pa.Array:
    """Arrays as a list column, by their buffers; None is null."""
    ends = np.concatenate([[0], np.cumsum([0 if v is None else len(v) for v in values])]).astype(np.int32)
    some = [v for v in values if v is not None]
    flat = pa.array(np.concatenate(some) if some else np.zeros(0), kind)
    mask = pa.array([v is None for v in values]) if len(some) < len(values) else None
    return pa.ListArray.from_arrays(pa.array(ends), flat, mask=mask)


def _line_batch(heads: list[tuple], found: list[list[tuple]], errors: bool) -> pa.RecordBatch:
    """A batch of LINES from (path, part_no, lvl_x, lvl_y, error) of each chunk and its lines (channel, y, x0, counts, samples)."""
    owner = pa.array(np.repeat(np.arange(len(heads)), [len(f) for f in found]))
    path, no, lx, ly, error = (pa.array(v, k).take(owner) for v, k in zip(zip(*heads, strict=True), (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string()), strict=True))
    channel, y, x0, counts, samples = zip(*[line for f in found for line in f], strict=True)
    counted = _lists(list(counts), pa.int32())
    n, ends = counted.values.to_numpy(), counted.offsets.to_numpy()
    before = np.concatenate([[0], np.cumsum(n, dtype=np.int64)])  # samples of the batch before each pixel, then of its line
    starts = pa.ListArray.from_arrays(counted.offsets, pa.array(before[:-1] - np.repeat(before[ends[:-1]], np.diff(ends)), pa.int32()), mask=counted.is_null() if counted.null_count else None)
    columns = [path, no, lx, ly, *[pa.array(v, k) for v, k in ((channel, pa.string()), (y, pa.int32()), (x0, pa.int32()))], counted, starts, _lists(list(samples), pa.float32())]
    names = _names(LINES)
    return pa.RecordBatch.from_arrays([*columns, error] if errors else columns, names=[*names, "error"] if errors else names)


def cropped(found: tuple, part: Part, box: tuple[int, int, int, int]) -> tuple | None:
    """(channel, y, x0, counts, samples) of a line within a box of its level, in pixels; None where nothing is left.

    Sample i of a channel of x sampling s lies on pixel i s.
    """
    channel, y, x, counts, samples = found
    if not box[1] <= y <= box[3]:
        return None
    xs = next(c.xs for c in part.channels if c.name == channel)
    n = len(samples) if counts is None else len(counts)
    a, b = max(-(-box[0] // xs) - x, 0), min(box[2] // xs - x + 1, n)
    if a >= b:
        return None
    if counts is None:
        return channel, y, x + a, None, samples[a:b]
    ends = np.cumsum(counts)
    return channel, y, x + a, counts[a:b], samples[ends[a] - counts[a] : ends[b - 1]]


def line_batches(batches: Iterator[pa.RecordBatch], only: list[str] | None = None, wanted: Wanted = Wanted(), mode: str = FAILFAST, batch_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:  # noqa: B008  not changed
    """Batches of CHUNKS to batches of LINES of about batch_bytes, or one chunk; with PERMISSIVE they have error, too."""
    keys = ("path", "part", "part_no", "chunk_idx", "tx", "ty", "lvl_x", "lvl_y", "table_size", "unpacked_size", "payload", "error")
    rows = (dict(zip(keys, values, strict=True)) for batch in batches for i in range(0, batch.num_rows, 256) for values in zip(*(batch.column(k).slice(i, 256).to_pylist() for k in keys), strict=True))
    return _decoded(rows, only, wanted, mode, batch_bytes)


def _decoded(rows: Iterator[dict], only: list[str] | None, wanted: Wanted, mode: str, batch_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    known, errors = _Parts(), mode == PERMISSIVE
    heads, out, size = [], [], 0
    for r in rows:
        error = r.get("error")
        if error is None:
            part = known[r["part"]]
            try:
                found = layout.decode_chunk(part, r)
            except InvalidData as e:
                if mode == FAILFAST:
                    raise
                error = f"InvalidData: {e}"
        if error is not None:
            if errors:
                heads.append((r["path"], r.get("part_no"), r.get("lvl_x"), r.get("lvl_y"), error))
                out.append([(None, None, None, None, None)])
            continue
        box = None if wanted.window is None and wanted.y is None else wanted.box(part, r["lvl_x"], r["lvl_y"])
        if only is not None:
            found = [line for line in found if line[0] in only]
        if box is not None:
            found = [line for line in (cropped(line, part, box) for line in found) if line is not None]
        if not found:
            continue
        heads.append((r["path"], r["part_no"], r["lvl_x"], r["lvl_y"], None))
        out.append(found)
        size += sum(300 + 4 * len(line[4]) + (0 if line[3] is None else 16 * len(line[3])) for line in found)
        if size > batch_bytes:
            yield _line_batch(heads, out, errors)
            heads, out, size = [], [], 0
    if out:
        yield _line_batch(heads, out, errors)


def lines(packed: DataFrame, only: list[str] | None = None, wanted: Wanted = Wanted(), mode: str = FAILFAST) -> DataFrame:  # noqa: B008  not changed
    """A row for each channel and row of each chunk: samples from x0 on, and for deep parts the counts of its pixels.

    Choose levels, parts or rows with read_chunks(wanted=...), or with a filter on packed before this; only: channels to
    keep. wanted: cut lines to its rows and window. mode PERMISSIVE gives chunks that cannot be decoded as a row
    with error, and adds that column to all.
    """
    mode = _mode(mode)
    return packed.mapInArrow(lambda batches: line_batches(batches, only, wanted, mode), _lines_schema(mode))


def region(spark: SparkSession, path: str, window: tuple[int, int, int, int], levels: tuple[tuple[int, int], tuple[int, int]] | None = None, only: list[str] | None = None, entry: str = "any", **more) -> DataFrame:
    """Lines of a window (x0, y0, x1, y1 of the first level, inclusive) on all levels, or on ranges of lvl_x and of lvl_y.

    Only chunks that the window touches are read, and lines are cut to it. A window outside of the image gives no rows.
    """
    wanted = Wanted(window=window)
    for name, (low, high) in zip(("lvl_x", "lvl_y"), levels or (), strict=False):
        wanted = wanted.narrowed(name, low, high)
    return read_lines(spark, path, entry, only, wanted=wanted, **more)


def pixels(rows: DataFrame) -> DataFrame:
    """path, part_no, lvl_x, lvl_y, channel, y, x, value of the flat rows of lines(); sampled grids count in samples.

    The canonical long form: the set of channels differs from part to part.
    """
    flat = rows.where("counts is null").select("path", "part_no", "lvl_x", "lvl_y", "channel", "y", "x0", F.posexplode("samples").alias("i", "value"))
    return flat.select("path", "part_no", "lvl_x", "lvl_y", "channel", "y", (F.col("x0") + F.col("i")).alias("x"), "value")


def deep_samples(rows: DataFrame) -> DataFrame:
    """path, part_no, lvl_x, lvl_y, channel, y, x, sample_idx, value of the deep rows of lines()."""
    keys = ("path", "part_no", "lvl_x", "lvl_y", "channel", "y")
    deep = rows.where("counts is not null").select(*keys, "x0", "starts", "samples", F.posexplode("counts").alias("i", "n")).where("n > 0")
    return deep.select(*keys, (F.col("x0") + F.col("i")).alias("x"), F.posexplode(F.slice("samples", F.get("starts", F.col("i")) + 1, F.col("n"))).alias("sample_idx", "value"))


def preview(long: DataFrame) -> DataFrame:
    """path, part_no, y, x and 16-bit r, g, b, a of the first level; missing colours are 0, a missing alpha is 1."""
    wide = long.where("lvl_x = 0 AND lvl_y = 0").groupBy("path", "part_no", "y", "x").pivot("channel", ["R", "G", "B", "A"]).agg(F.first("value"))
    none = lambda c, v: preview_quantise(F.coalesce(F.col(c), F.lit(v).cast("float")))
    return wide.select("path", "part_no", "y", "x", *[none(c, 1.0 if c == "A" else 0.0).alias(c.lower()) for c in "RGBA"])


def _tile_columns(spec: list[Part], name: str) -> Column:
    """A value of a row's part, by part_no."""
    value = {"tile_x": lambda p: p.tile[0] if p.tiled else p.width, "tile_y": lambda p: p.tile[1] if p.tiled else p.rows}[name]
    return F.get(F.array(*[F.lit(value(p)) for p in spec]), F.col("part_no"))


def rgba_planes(rows: DataFrame) -> DataFrame:
    """Rows for encode() from rows with interleaved samples r, g, b, a, r, ...: one for each of the channels A, B, G, R.

    A row whose samples are no whole number of pixels is an error. Other columns are kept; missing keys of levels and parts are 0.
    """
    pixels = F.floor(F.size("samples") / 4).cast("int")
    checked = rows.withColumn("samples", F.when(F.assert_true(F.size("samples") % 4 == 0, "samples that are no whole pixels").isNull(), F.col("samples")))
    plane = lambda k: F.transform(F.slice(F.sequence(F.lit(0), pixels), F.lit(1), pixels), lambda i: F.get("samples", 4 * i + k))
    named = F.explode(F.array(*[F.struct(F.lit(c).alias("channel"), plane(k).alias("samples")) for k, c in ((3, "A"), (2, "B"), (1, "G"), (0, "R"))])).alias("_p")
    keys = ("part_no", "lvl_x", "lvl_y")
    rest = [c for c in rows.columns if c not in ("samples", *keys)]
    own = [F.col(c) if c in rows.columns else F.lit(0).alias(c) for c in keys]
    return checked.select(*rest, *own, named).select(*rest, *keys, "_p.channel", "_p.samples", F.lit(None).cast("array<int>").alias("counts"))


#: Bytes of chunks that a batch of BODIES holds at least, but for a task's last.
PACKED = 4 << 20


def _blocks(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[tuple[tuple, dict[tuple[str, int], tuple[np.ndarray, np.ndarray | None]]]]:
    """(keys, lines) of each run of rows with the same keys: samples and counts by channel and row, none of which may be there twice."""
    now, have = None, {}
    for batch in batches:
        told = zip(*(batch.column(k).to_pylist() for k in keys), strict=True)
        names, ys = batch.column("channel").to_pylist(), batch.column("y").to_pylist()
        for key, channel, y, samples, counts in zip(told, names, ys, *_views(batch), strict=True):
            if key != now:
                if have:
                    yield now, have
                now, have = key, {}
            if (channel, y) in have:
                raise InvalidData("two rows of a channel have the same y")
            have[channel, y] = samples, counts
    if have:
        yield now, have


def _views(batch: pa.RecordBatch) -> tuple[list[np.ndarray], list[np.ndarray | None]]:
    """Samples and counts of each row as views of the Arrow buffers."""
    samples, counts = batch.column("samples"), batch.column("counts")
    values, n = samples.values.to_numpy(zero_copy_only=False).astype(np.float32, copy=False), counts.values.to_numpy(zero_copy_only=False)
    at, n_at, flat = samples.offsets.to_pylist(), counts.offsets.to_pylist(), counts.is_null().to_pylist()
    return [values[a:b] for a, b in zip(at[:-1], at[1:], strict=True)], [None if none else n[a:b] for none, a, b in zip(flat, n_at[:-1], n_at[1:], strict=True)]


def line_values(batch: pa.RecordBatch) -> Iterator[tuple]:
    """(path, part_no, lvl_x, lvl_y, channel, y, samples, counts) of each row, samples and counts as views of the buffers."""
    keys = zip(*(batch.column(k).to_pylist() for k in ("path", "part_no", "lvl_x", "lvl_y", "channel", "y")), strict=True)
    for key, samples, counts in zip(keys, *_views(batch), strict=True):
        yield (*key, samples, counts)


BODIES = "path string, part_no int, at int, place int, body binary, most int"


def encode_chunks(rows: DataFrame, spec: list[Part]) -> DataFrame:
    """Rows of BODIES: the chunks of a file for each path of rows, with the parts of spec.

    rows has path, part_no, lvl_x, lvl_y, channel, y, samples, counts: a whole row of a channel, and for deep parts the
    number of samples of each pixel (null for flat ones). Missing rows are an error. Rows are cut at tile borders, and a chunk,
    which has a bounded size, is encoded in one task. place: the chunk's number in the order in which chunks lie in the part.
    """
    layout.check_parts(spec)
    text = parts_json(spec)
    told = F.assert_true(F.col("part_no").between(0, len(spec) - 1), F.concat(F.lit("rows of part "), F.col("part_no").cast("string")))
    rows = rows.withColumn("part_no", F.when(told.isNull(), F.col("part_no")))
    tx, ty = _tile_columns(spec, "tile_x"), _tile_columns(spec, "tile_y")
    length = F.when(F.col("counts").isNull(), F.size("samples")).otherwise(F.size("counts"))
    sampled = F.element_at(F.create_map(*[F.lit(x) for no, p in enumerate(spec) for c in p.channels for x in (f"{no} {c.name}", c.xs)]), F.concat_ws(" ", "part_no", "channel"))
    step = F.floor((tx + sampled - 1) / sampled)
    cut = rows.withColumn("_step", step.cast("int")).withColumn("tx", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), (F.ceil(length / F.col("_step")) - 1).cast("int")))))
    first = F.col("tx") * F.col("_step")
    total = lambda a: F.aggregate(a, F.lit(0), lambda n, x: n + x)
    own = F.slice("counts", first + 1, F.col("_step"))
    start = F.when(F.col("counts").isNull(), first).otherwise(total(F.slice("counts", F.lit(1), first)))
    n = F.when(F.col("counts").isNull(), F.col("_step")).otherwise(total(own))
    keys = ("path", "part_no", "lvl_x", "lvl_y", "tx", "ty")
    pieces = cut.select("path", "part_no", "lvl_x", "lvl_y", "tx", F.floor(F.col("y") / ty).cast("int").alias("ty"), "channel", "y", F.slice("samples", start + 1, n).alias("samples"), own.alias("counts"))
    dealt = pieces.repartition(work_tasks(rows.sparkSession), *keys).sortWithinPartitions(*keys)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told, schema = parts_of_json(text), arrow_schema(BODIES)
        out: dict[str, list] = {k: [] for k in _names(BODIES)}
        size = 0
        for (path, no, lx, ly, tx, ty), have in _blocks(batches, keys):
            if not 0 <= no < len(told):
                raise InvalidData(f"rows of part {no}")
            across, down = told[no].grids.get((lx, ly), (0, 0))
            if not (0 <= tx < across and 0 <= ty < down):
                raise InvalidData(f"rows outside part {no}: {(tx, ty, lx, ly)}")
            layout.check_lines(told[no], tx, ty, lx, ly, have)
            body, most = layout.encode_chunk(told[no], tx, ty, lx, ly, have)
            at = told[no].place(tx, ty, lx, ly)
            for k, v in zip(out, (path, no, at, layout.laid(told[no], at), body, most), strict=True):
                out[k].append(v)
            size += 256 + len(body)
            if size > PACKED:
                yield pa.RecordBatch.from_pydict(out, schema=schema)
                out, size = {k: [] for k in out}, 0
        if size:
            yield pa.RecordBatch.from_pydict(out, schema=schema)

    return dealt.mapInArrow(pack, BODIES)


def shape_faults(rows: DataFrame, spec: list[Part]) -> DataFrame:
    """What is wrong with the shape of rows before they are written: path, part_no, lvl_x, lvl_y, channel, expected, found, wrong.

    rows as for encode_chunks(). A row for each channel of a level of a file that has not each of its lines once (expected and found
    tell their numbers, found of distinct ones in place) or has lines of another length, repeated or out of place (wrong); also for
    channels, levels and parts that the spec does not have (expected 0). No rows: all files can be written.
    """
    cells = []
    for no, p in enumerate(spec):
        for lx, ly in p.grids:
            w, h = geometry.level_extent(p.width, lx, p.up), geometry.level_extent(p.height, ly, p.up)
            cells += [(no, lx, ly, c.name, -(-h // c.ys), -(-w // c.xs), c.ys) for c in p.channels]
    names = ("_no", "_lx", "_ly", "_channel", "expected", "_width", "_step")
    # as a column of the paths: the spec is small, and each file meets all of it
    told = F.explode(F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in zip(names, c, strict=True)]) for c in cells])).alias("_c")
    want = rows.select(F.col("path").alias("_path")).distinct().select("_path", told).select("_path", "_c.*")
    length = F.when(F.col("counts").isNull(), F.size("samples")).otherwise(F.size("counts"))
    same = (F.col("path") == F.col("_path")) & (F.col("part_no") == F.col("_no")) & (F.col("lvl_x") == F.col("_lx")) & (F.col("lvl_y") == F.col("_ly")) & (F.col("channel") == F.col("_channel"))
    keys = ("path", "part_no", "lvl_x", "lvl_y", "channel")
    have = rows.select(*keys, "y", length.alias("_length")).groupBy(*keys, "y", "_length").agg(F.count(F.lit(1)).alias("_n"))
    have = have.groupBy(*keys).agg(F.collect_list(F.struct("y", "_length", "_n")).alias("_lines"))  # at most the lines of a plane, by y
    fits = lambda x: (x["y"] >= 0) & (F.pmod(x["y"], F.col("_step")) == 0) & (F.floor(x["y"] / F.col("_step")) < F.col("expected")) & (x["_length"] == F.col("_width")) & (x["_n"] == 1)
    met = have.join(want, same, "full_outer")
    lines = F.coalesce("_lines", F.array().cast(have.schema["_lines"].dataType))
    good = F.coalesce(F.size(F.filter(lines, fits)), F.lit(0))
    out = met.select(
        *[F.coalesce(a, b).alias(a) for a, b in zip(keys, ("_path", "_no", "_lx", "_ly", "_channel"), strict=True)], F.coalesce("expected", F.lit(0)).alias("expected"),
        F.when(F.col("expected").isNull(), 0).otherwise(good).alias("found"), (F.size(lines) - F.when(F.col("expected").isNull(), 0).otherwise(good)).alias("wrong"),
    )
    return out.where("found <> expected OR wrong > 0")


def encode(rows: DataFrame, spec: list[Part]) -> DataFrame:
    """Rows (path, content): small files (under 2 GB, each made in one task) from rows as encode_chunks() takes them."""
    text, done = parts_json(spec), encode_chunks(rows, spec)
    # files by number of tasks: by their bytes, which tell nothing of the work, few tasks would get all
    whole = done.repartition(work_tasks(rows.sparkSession), "path").groupBy("path").agg(F.sort_array(F.collect_list(F.struct("part_no", "at", "body", "most"))).alias("chunks"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told, schema = parts_of_json(text), arrow_schema("path string, content binary")
        paths, contents, size = [], [], 0
        for batch in batches:
            for path, chunks in zip(batch.column("path"), batch.column("chunks"), strict=True):  # one by one: the chunks of all files of a batch are many objects
                found = chunks.as_py()
                most = [max((c["most"] for c in found if c["part_no"] == no), default=0) for no in range(len(told))]
                paths.append(path.as_py())
                contents.append(layout.encode_file(told, [(c["part_no"], c["body"]) for c in found], most))
                size += 256 + len(contents[-1])
                if size > PACKED:
                    yield pa.RecordBatch.from_pydict({"path": paths, "content": contents}, schema=schema)
                    paths, contents, size = [], [], 0
        if paths:
            yield pa.RecordBatch.from_pydict({"path": paths, "content": contents}, schema=schema)

    return whole.mapInArrow(join, "path string, content binary")


PIECES = "path string, step int, nth long, part_no int, n long, tops array<int>, body binary"
WRITTEN = "path string, file string, bytes long"
#: Chunks of a file that a running sum adds up in one go.
BAND = 1024


def prepared(rows: DataFrame, spec: list[Part]) -> DataFrame:
    """Rows of PIECES: all that the files of rows consist of, a file in one task, in order. rows as for encode_chunks().

    The chunks are encoded by many tasks and written down once, and a running sum of their sizes places them. step: 0 the headers,
    1 an offset of the table, 2 a chunk. A file with chunks missing or twice is an error.
    """
    many = len(spec) > 1 or bool(spec[0].name)
    base = len(layout.encode_headers(spec, [0] * len(spec))) + 8 * sum(p.count for p in spec)
    counts = [p.count for p in spec]
    first = F.element_at(F.array(*[F.lit(sum(counts[:no])) for no in range(len(spec))]), F.col("part_no") + 1)
    # the size is a column of its own, so that the steps that place the chunks need not read them
    bodies = cut(encode_chunks(rows, spec).withColumn("size", (F.octet_length("body") + F.lit(4 * many)).cast("long")))
    sized = bodies.select("path", "part_no", (first + F.col("at")).alias("number"), (first + F.col("place")).alias("nth"), "size", "most")
    if sum(counts) <= BAND:  # the chunks of a file are few
        before = Window.partitionBy("path").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
        placed = sized.withColumn("offset", F.coalesce(F.sum("size").over(before), F.lit(0)))
    else:
        placed = running_offsets(sized, ["path"], "nth", "size", BAND)
    placed = placed.select("path", "part_no", "number", (F.col("offset") + base).alias("offset"), "most")
    most = F.greatest(F.col("most"), F.lit(0))
    tops = placed.groupBy("path").agg(F.array(*[F.coalesce(F.max(F.when(F.col("part_no") == no, most)), F.lit(0)) for no in range(len(spec))]).alias("tops"), F.count(F.lit(1)).alias("n"))
    whole = F.assert_true(F.col("n") == sum(counts), F.concat(F.col("n").cast("string"), F.lit(" chunks for "), F.col("path")))
    tops = tops.select("path", F.when(whole.isNull(), F.col("n")).alias("n"), "tops")
    none = lambda kind: F.lit(None).cast(kind)
    pieces = (
        tops.select("path", F.lit(0).alias("step"), F.lit(0).cast("long").alias("nth"), none("int").alias("part_no"), "n", "tops", none("binary").alias("body"))
        .union(placed.select("path", F.lit(1), "number", none("int"), F.col("offset"), none("array<int>"), none("binary")))
        .union(bodies.select("path", F.lit(2), first + F.col("place"), "part_no", none("long"), none("array<int>"), "body"))
    )
    return pieces.repartition(work_tasks(rows.sparkSession), "path").sortWithinPartitions("path", "step", "nth")


class Stitching:
    """Files from batches of PIECES, streamed under draft names of their own. done: (path, draft, bytes) of each finished one."""

    def __init__(self, spec: list[Part], folder: str):
        from pyarrow import fs

        self.spec, self.many = spec, len(spec) > 1 or bool(spec[0].name)
        self.system, self.root = fs.FileSystem.from_uri(folder)
        self.path, self.out, self.draft, self.done = None, None, "", []

    def _begin(self, path: str) -> None:
        self.close()
        self.path, self.draft = path, f"{self.root}/_draft-{uuid.uuid4().hex}"
        self.out = self.system.open_output_stream(self.draft)

    def close(self) -> None:
        if self.out is not None:
            size = self.out.tell()
            self.out.close()
            self.done.append((self.path, self.draft, size))
            self.out = None

    def add(self, batch: pa.RecordBatch) -> None:
        paths, steps = batch.column("path").to_pylist(), batch.column("step").to_pylist()
        cuts = [i for i in range(len(paths)) if not i or paths[i] != paths[i - 1] or steps[i] != steps[i - 1]] + [len(paths)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if steps[a] == 0:
                self._begin(paths[a])
                self.out.write(layout.encode_headers(self.spec, batch.column("tops")[a].as_py()))
            elif self.out is None or paths[a] != self.path:
                raise InvalidData(f"pieces of {paths[a]} before its headers: its rows are not in one task, or not in order")
            elif steps[a] == 1:
                self.out.write(batch.column("n").slice(a, b - a).to_numpy(zero_copy_only=False).astype("<u8").tobytes())
            else:
                for no, body in zip(batch.column("part_no").slice(a, b - a).to_pylist(), batch.column("body").slice(a, b - a).to_pylist(), strict=True):
                    self.out.write((no.to_bytes(4, "little") if self.many else b"") + body)

    def abandon(self) -> None:
        """Delete all drafts."""
        if self.out is not None:
            self.out.close()
            self.done.append((self.path, self.draft, 0))
            self.out = None
        for _, draft, _ in self.done:
            if self.system.get_file_info(draft).is_file:
                self.system.delete_file(draft)

    def name(self, path: str) -> str:
        return f"{self.root}/{path}.{EXTENSION}"


def make_folder(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)


def save(made: DataFrame, folder: str) -> DataFrame:
    """Write each row (path, content) of made, as encode() gives them, as folder/path.exr, and give rows (path, file, bytes)."""
    make_folder(made.sparkSession, folder)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                draft, name = f"{root}/_draft-{uuid.uuid4().hex}", f"{root}/{path}.{EXTENSION}"
                with system.open_output_stream(draft) as out:
                    out.write(content)
                system.move(draft, name)
                yield pa.RecordBatch.from_pydict({"path": [path], "file": [name], "bytes": [len(content)]}, schema=arrow_schema(WRITTEN))

    return made.select("path", "content").mapInArrow(work, WRITTEN)


def write(rows: DataFrame, spec: list[Part], folder: str) -> DataFrame:
    """Write a file folder/path.exr for each path of rows, and give rows (path, file, bytes). rows as for encode_chunks().

    One task a file streams headers, offset table and chunks (see prepared()), a batch at a time, under a name of its
    own that is then moved over, so a task that is run again does no harm. No rows make an empty folder.
    """
    layout.check_parts(spec)
    text = parts_json(spec)
    make_folder(rows.sparkSession, folder)

    def stitch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Stitching(parts_of_json(text), folder)
        try:
            for batch in batches:
                own.add(batch)
            own.close()
        except BaseException:
            own.abandon()
            raise
        for path, draft, size in own.done:
            own.system.move(draft, own.name(path))
            yield pa.RecordBatch.from_pydict({"path": [path], "file": [own.name(path)], "bytes": [size]}, schema=arrow_schema(WRITTEN))

    return prepared(rows, spec).mapInArrow(stitch, WRITTEN)
