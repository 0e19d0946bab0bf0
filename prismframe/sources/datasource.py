"""`spark.read`, `spark.readStream` and `df.write` with format("exr") after register(spark).

Reading. Options: entry (a reader's name, see exr.ENTRIES), rows (lines, chunks or attributes), mode (FAILFAST, PERMISSIVE or
DROPMALFORMED, see exr.MODES; PERMISSIVE adds the column error), recover (true: find chunks by their headers), window
("x0,y0,x1,y1" of the first level, inclusive), split_bytes and, for lines, channels (names joined by commas) and level
("x,y"). Comparisons of part_no, lvl_x, lvl_y, y, tx, ty, chunk_idx, x0, channel and path with constants are pushed down: chunks that
they exclude are not read, and Spark does not check them again. A schema of fewer columns (spark.read.schema(...)) gives those alone.

The driver lists files and cuts them into ranges of about split_bytes without opening any; small files are put together, and
so are ranges where there are more than TASKS of less than 32 MB. A task reads the headers and the offset table of its files and takes the chunks that begin in its range.

Writing. df has rows as exr.encode_chunks() takes them, all rows of a file in one task (df.repartition("path")), or with
option rows = pieces those of exr.prepared(), whose chunks many tasks have encoded. parts: exr.parts_json() of the spec.
Files appear when all tasks have ended; a job that fails leaves none. Modes append and overwrite (which empties the folder of exr files).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage,
)

from . import exr, layout
from .layout import InvalidData, Unsupported
from .planning import Wanted

SCHEMAS = {"chunks": exr.CHUNKS, "lines": exr.LINES, "attributes": exr.ATTRIBUTES}
#: Columns whose comparisons are pushed down, by kind of rows.
PUSHED = {"lines": ("path", "part_no", "lvl_x", "lvl_y", "channel", "y", "x0"), "chunks": ("path", "part_no", "lvl_x", "lvl_y", "tx", "ty", "chunk_idx"), "attributes": ("path", "part_no")}


@dataclass
class Ranges(InputPartition):
    """Files or ranges of bytes of files, as (path, length, first byte, byte after the last)."""

    pieces: list[tuple[str, int, int, int]]


def found_files(path: str) -> list[tuple[str, int]]:
    """(path, length) of the files with the extension under a folder, or of one file, in order of path."""
    from pyarrow import fs

    system, place = fs.FileSystem.from_uri(path)
    told = system.get_file_info(place)
    if told.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    infos = [told] if told.is_file else system.get_file_info(fs.FileSelector(place, recursive=True))
    scheme = path.split("://")[0] + "://" if "://" in path else ""
    hidden = lambda p: any(x[:1] in "._" for x in p[len(place) :].split("/") if x)
    return sorted((scheme + x.path, x.size) for x in infos if x.is_file and (told.is_file or x.path.endswith("." + exr.EXTENSION) and not hidden(x.path)))


def planned(files: list[tuple[str, int]], split_bytes: int) -> list[Ranges]:
    """Files in partitions of about split_bytes; none is opened."""
    out, small, size = [], [], 0
    for path, length in files:
        if length > split_bytes:
            cuts = [*range(0, length, split_bytes), length]
            out += [Ranges([(path, length, a, b)]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            continue
        if small and size + length > split_bytes:
            out.append(Ranges(small))
            small, size = [], 0
        small.append((path, length, 0, length))
        size += length
    return together(out + ([Ranges(small)] if small or not out else []), split_bytes)


#: Partitions that may be as small as split_bytes; where there would be more, they take up to TOGETHER bytes each.
TASKS, TOGETHER = 256, 32 << 20


def together(found: list[Ranges], split_bytes: int) -> list[Ranges]:
    """Neighbouring partitions put together where there are many small ones, since each is a task. Ranges stay as they are cut."""
    if len(found) <= TASKS:
        return found
    own = lambda r: sum(stop - first for _, _, first, stop in r.pieces)
    most, out, size = max(split_bytes, min(TOGETHER, -(-sum(map(own, found)) // TASKS))), [], 0
    for r in found:
        if out and size + own(r) <= most:
            out[-1].pieces.extend(r.pieces)
        else:
            out.append(Ranges(list(r.pieces)))
            size = 0
        size += own(r)
    return out


class ExrSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "exr"

    def _option(self, name: str, default: str = "") -> str:
        return {k.lower(): v for k, v in self.options.items()}.get(name, default)  # option names come in any case

    @property
    def kind(self) -> str:
        kind = self._option("rows", "lines")
        if kind not in SCHEMAS:
            raise ValueError(f"rows must be one of {', '.join(SCHEMAS)}")
        return kind

    def schema(self) -> str:
        permissive = self.kind == "lines" and self._option("mode").upper() == exr.PERMISSIVE
        return SCHEMAS[self.kind] + (", error string" if permissive else "")

    def reader(self, schema) -> DataSourceReader:
        return ExrReader(self.kind, dict(self.options), schema.names)

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802  Spark's name
        return ExrStreamReader(self.kind, dict(self.options), schema.names)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        out = ExrWriter(dict(self.options), schema.names, overwrite)
        out.begin()
        return out


def _mask(batch: pa.RecordBatch, f: Filter) -> pa.Array:
    """Where a filter holds; null counts as no."""
    column = batch.column(f.attribute[0])
    if isinstance(f, In):
        return pc.is_in(column, pa.array([v for v in f.value if v is not None], column.type))
    compare = {EqualTo: pc.equal, GreaterThan: pc.greater, GreaterThanOrEqual: pc.greater_equal, LessThan: pc.less, LessThanOrEqual: pc.less_equal}[type(f)]
    return pc.fill_null(compare(column, pa.scalar(f.value, column.type)), False)


class _Reading:
    def __init__(self, kind: str, options: dict, columns: list[str]):
        self.kind, self.columns, self.filters = kind, columns, []
        o = {k.lower(): v for k, v in options.items()}
        self.path, self.entry, self.split_bytes = o["path"], o.get("entry", "any"), int(o.get("split_bytes", 32 << 20))
        self.channels = [c.strip() for c in o["channels"].split(",")] if "channels" in o else None
        self.recover, self.mode = o.get("recover", "false").lower() == "true", exr._mode(o.get("mode", exr.FAILFAST))
        self.wanted = Wanted(window=tuple(int(x) for x in o["window"].split(",")) if "window" in o else None)
        level = tuple(int(x) for x in o["level"].split(",")) if "level" in o else (0, 0) if self.entry == "single" else None
        if level is not None:
            self.wanted = self.wanted.narrowed("lvl_x", level[0], level[0]).narrowed("lvl_y", level[1], level[1])

    def take(self, f: Filter) -> bool:
        """Whether a filter is handled here; it then narrows what is wanted."""
        if not isinstance(f, (EqualTo, In, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) or len(f.attribute) != 1 or f.attribute[0] not in PUSHED[self.kind]:
            return False
        name, value = f.attribute[0], f.value
        if isinstance(f, EqualTo) and value is None:
            return False
        self.filters.append(f)
        if name in ("part_no", "lvl_x", "lvl_y") or name == "y" and self.kind == "lines":
            values = [v for v in value if v is not None] if isinstance(f, In) else [value]
            low, high = (min(values), max(values)) if values else (0, -1)
            low = None if isinstance(f, (LessThan, LessThanOrEqual)) else low + isinstance(f, GreaterThan)
            high = None if isinstance(f, (GreaterThan, GreaterThanOrEqual)) else high - isinstance(f, LessThan)
            self.wanted = self.wanted.narrowed(name, low, high)
        elif name == "channel" and isinstance(f, (EqualTo, In)):
            named = [value] if isinstance(f, EqualTo) else [v for v in value if v is not None]
            self.channels = named if self.channels is None else [c for c in self.channels if c in named]
        return True

    def _kept(self, path: str) -> bool:
        one = pa.RecordBatch.from_pydict({"path": [path]})
        return all(_mask(one, f)[0].as_py() for f in self.filters if f.attribute == ("path",))

    def _batches(self, piece: tuple[str, int, int, int]) -> Iterator[pa.RecordBatch]:
        path, length, first, stop = piece
        with exr.open_file(path) as f:
            if self.kind == "attributes":
                if first == 0:
                    try:
                        yield from exr.attribute_batches(path, f.read_at(layout.plan_by_ranges(exr.range_reader(f), length).at, 0))
                    except (InvalidData, Unsupported):
                        if self.mode == exr.FAILFAST:
                            raise
                return
            cut = exr.file_splits(f, path, length, self.split_bytes, self.entry, self.wanted, self.recover, self.mode, (first, stop))
        if cut:
            chunks = exr.range_batches(iter([pa.RecordBatch.from_pylist(cut, schema=exr.arrow_schema(exr.SPLITS))]), self.entry, self.wanted, self.mode)
            yield from chunks if self.kind == "chunks" else exr.line_batches(chunks, self.channels, self.wanted, self.mode)

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        for piece in partition.pieces:
            if self._kept(piece[0]):
                for batch in self._batches(piece):
                    for f in self.filters:
                        batch = batch.filter(_mask(batch, f))
                    yield batch.select(self.columns)


class ExrReader(_Reading, DataSourceReader):
    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802  Spark's name
        return [f for f in filters if not self.take(f)]

    def partitions(self) -> list[Ranges]:
        files = [x for x in found_files(self.path) if self._kept(x[0])]
        return planned(files, 1 << 62 if self.kind == "attributes" else self.split_bytes)


class FileLog:
    """Files by the batch that has them, in a folder: one small file a batch, and all names together now and then.

    A batch is written under a draft name and moved, so it is whole or not there. The last KEPT batches stay readable by number.
    """

    COMPACT, KEPT = 10, 100

    def __init__(self, folder: str):
        from pyarrow import fs

        self.system, self.root = fs.FileSystem.from_uri(folder)
        self.system.create_dir(self.root, recursive=True)

    def _numbers(self, end: str) -> list[int]:
        from pyarrow import fs

        infos = self.system.get_file_info(fs.FileSelector(self.root))
        return sorted(int(x.base_name.removesuffix(end)) for x in infos if x.is_file and x.base_name.endswith(end) and x.base_name.removesuffix(end).isdigit())

    def _write(self, name: str, rows: list) -> None:
        draft = f"{self.root}/_draft-{uuid.uuid4().hex}"
        with self.system.open_output_stream(draft) as out:
            out.write(json.dumps(rows).encode())
        self.system.move(draft, f"{self.root}/{name}")

    def _read(self, name: str) -> list[tuple[str, int]]:
        with self.system.open_input_stream(f"{self.root}/{name}") as f:
            return [tuple(x) for x in json.loads(f.read())]

    def last(self) -> int:
        return max([0, *self._numbers(".batch"), *self._numbers(".all")])

    def seen(self) -> set[tuple[str, int]]:
        whole = max(self._numbers(".all"), default=0)
        out = set(self._read(f"{whole}.all")) if whole else set()
        for n in self._numbers(".batch"):
            if n > whole:
                out.update(self._read(f"{n}.batch"))
        return out

    def add(self, files: list[tuple[str, int]]) -> int:
        """The number of a new batch of these files."""
        n = self.last() + 1
        self._write(f"{n}.batch", files)
        if n % self.COMPACT == 0:
            self._write(f"{n}.all", sorted(self.seen()))
            for old in self._numbers(".all"):
                if old < n:
                    self.system.delete_file(f"{self.root}/{old}.all")
            for old in self._numbers(".batch"):
                if old <= n - self.KEPT:
                    self.system.delete_file(f"{self.root}/{old}.batch")
        return n

    def files(self, first: int, last: int) -> list[tuple[str, int]]:
        """Of the batches after first, up to last; all of them for a stream that begins now."""
        whole = max((n for n in self._numbers(".all") if n <= last), default=0) if first == 0 else 0
        out = self._read(f"{whole}.all") if whole else []
        return out + [x for n in range(max(first, whole) + 1, last + 1) for x in self._read(f"{n}.batch")]


class ExrStreamReader(_Reading, DataSourceStreamReader):
    """Files that are added under the path. The offset is the number of a batch in a log of files.

    The log lies in the option log, or in the folder _exr_log of the path; streams with logs of their own do not disturb each other.
    A file counts by path and length, once.
    """

    def __init__(self, kind: str, options: dict, columns: list[str]):
        super().__init__(kind, options, columns)
        o = {k.lower(): v for k, v in options.items()}
        self.log = o.get("log") or (self.path + "_log" if self.path.endswith("." + exr.EXTENSION) else self.path.rstrip("/") + "/_exr_log")

    def initialOffset(self) -> dict:  # noqa: N802
        return {"batch": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        log = FileLog(self.log)
        seen = log.seen()
        new = [x for x in found_files(self.path) if x not in seen]
        return {"batch": log.add(new) if new else log.last()}

    def partitions(self, start: dict, end: dict) -> list[Ranges]:
        return planned(FileLog(self.log).files(start["batch"], end["batch"]), self.split_bytes)

    def commit(self, end: dict) -> None:
        pass


@dataclass
class Drafts(WriterCommitMessage):
    """Finished files of a task: (path, draft, bytes)."""

    files: list[tuple[str, str, int]]


class _Collected:
    """Chunks of one file from its rows, in any order: each is encoded when all its rows are there."""

    def __init__(self, spec: list[layout.Part]):
        self.spec, self.waiting, self.bodies, self.most = spec, {}, {}, [0] * len(spec)

    def add(self, no: int, lx: int, ly: int, channel: str, y: int, samples: np.ndarray, counts: np.ndarray | None) -> None:
        if not 0 <= no < len(self.spec):
            raise InvalidData(f"rows of part {no}")
        part = self.spec[no]
        across, down = part.grids.get((lx, ly), (0, 0))
        ty = y // (part.tile[1] if part.tiled else part.rows)
        if not 0 <= ty < down:
            raise InvalidData(f"rows that part {no} has no place for: {(channel, y, lx, ly)}")
        layout.check_lines(part, 0, ty, lx, ly, [(channel, y)])
        _, y0, _, h = part.box(0, ty, lx, ly)
        encoded = (no, part.place(0, ty, lx, ly)) in self.bodies
        have = self.waiting.setdefault((no, lx, ly, ty), {})
        if encoded or (channel, y) in have:
            raise InvalidData(f"two rows of channel {channel} have y {y}")
        have[channel, y] = (samples, counts)
        if len(have) == sum(r % c.ys == 0 for r in range(y0, y0 + h) for c in part.channels):
            self._encode(no, lx, ly, ty, across)

    def _encode(self, no: int, lx: int, ly: int, ty: int, across: int) -> None:
        part, have = self.spec[no], self.waiting.pop((no, lx, ly, ty))
        starts = {k: None if n is None else np.concatenate([[0], np.cumsum(n)]) for k, (_, n) in have.items()}
        xs = {c.name: c.xs for c in part.channels}
        for tx in range(across):
            x, _, w, _ = part.box(tx, ty, lx, ly)
            own = {}
            for k, (v, n) in have.items():
                a, b = (x, x + w) if n is not None else (-(-x // xs[k[0]]), -(-(x + w) // xs[k[0]]))
                if tx + 1 == across and len(v if n is None else n) != b:
                    raise InvalidData(f"a row of another length: {k}")
                own[k] = (v[a:b], None) if n is None else (v[starts[k][a] : starts[k][b]], n[a:b])
            body, most = layout.encode_chunk(part, tx, ty, lx, ly, own)
            self.bodies[no, part.place(tx, ty, lx, ly)] = body
            self.most[no] = max(self.most[no], most)

    def pieces(self, path: str) -> Iterator[pa.RecordBatch]:
        """The file as batches of exr.PIECES."""
        if self.waiting or len(self.bodies) != sum(p.count for p in self.spec):
            raise InvalidData(f"{len(self.bodies)} chunks for {path}: rows are missing, or lie in another task")
        many = len(self.spec) > 1 or bool(self.spec[0].name)
        order = sorted(self.bodies, key=lambda k: (k[0], layout.laid(self.spec[k[0]], k[1])))
        at = len(layout.encode_headers(self.spec, self.most)) + 8 * len(order)
        offsets = {}
        for k in order:
            offsets[k] = at
            at += len(self.bodies[k]) + 4 * many
        schema = exr.arrow_schema(exr.PIECES)
        yield pa.RecordBatch.from_pylist([{"path": path, "step": 0, "tops": self.most}], schema=schema)
        yield pa.RecordBatch.from_pylist([{"path": path, "step": 1, "n": offsets[k]} for k in sorted(offsets)], schema=schema)
        for k in order:
            yield pa.RecordBatch.from_pylist([{"path": path, "step": 2, "part_no": k[0], "body": self.bodies.pop(k)}], schema=schema)


class ExrWriter(DataSourceArrowWriter):
    """Tasks finish whole files under draft names; the commit moves them, and an abort deletes them.

    The drafts' folder is made before any task, and by none, so a task that still runs after an abort cannot leave a draft.
    """

    def __init__(self, options: dict, columns: list[str], overwrite: bool):
        o = {k.lower(): v for k, v in options.items()}
        if "parts" not in o:
            raise ValueError("the option parts must tell what the files consist of: exr.parts_json(spec)")
        self.folder, self.rows, self.spec, self.overwrite = o["path"], o.get("rows", "lines"), exr.parts_of_json(o["parts"]), overwrite
        layout.check_parts(self.spec)
        need = exr._names(exr.PIECES) if self.rows == "pieces" else ["path", "part_no", "lvl_x", "lvl_y", "channel", "y", "samples", "counts"]
        if self.rows not in ("lines", "pieces") or set(need) - set(columns):
            raise ValueError(f"rows must be lines or pieces, with the columns {', '.join(need)}")
        self.job = uuid.uuid4().hex

    @property
    def drafts(self) -> str:
        return f"{self.folder.rstrip('/')}/_exr-{self.job}"

    def begin(self) -> None:
        from pyarrow import fs

        system, place = fs.FileSystem.from_uri(self.drafts)
        system.create_dir(place, recursive=True)

    def _whole(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: dict[str, _Collected] = {}
        for batch in batches:
            for path, *rest in exr.line_values(batch):
                if path not in now:
                    now[path] = _Collected(self.spec)
                now[path].add(*rest)
        for path in sorted(now):
            yield from now.pop(path).pieces(path)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Drafts:
        own = exr.Stitching(self.spec, self.drafts)
        try:
            for batch in iterator if self.rows == "pieces" else self._whole(iterator):
                own.add(batch)
            own.close()
        except BaseException:
            own.abandon()
            raise
        return Drafts(own.done)

    def commit(self, messages: list[Drafts | None]) -> None:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(self.folder)
        system.create_dir(root, recursive=True)
        files = [x for m in messages if m is not None for x in m.files]
        names = [path for path, _, _ in files]
        if len(set(names)) < len(names):
            self.abort(messages)
            raise InvalidData("rows of a file lie in several tasks: repartition by path first")
        if self.overwrite:
            for x in system.get_file_info(fs.FileSelector(root)):
                if x.is_file and x.path.endswith("." + exr.EXTENSION):
                    system.delete_file(x.path)
        for path, draft, _ in files:
            system.move(draft, f"{root}/{path}.{exr.EXTENSION}")
        self._clear()

    def abort(self, messages: list[Drafts | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        from pyarrow import fs

        system, place = fs.FileSystem.from_uri(self.drafts)
        if system.get_file_info(place).type == fs.FileType.Directory:
            system.delete_dir(place)


class ExrLines:
    """The table function exr_lines(TABLE(...)) for SQL: rows as exr.lines() gives them, of a table with the columns path and content.

    A null content gives no rows.
    """

    def eval(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for name, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
            if data is None:
                continue
            told = [exr._part_json(p) for p in layout.plan_of(data, len(data)).parts]
            rows = [{"path": name, "part": told[r["part_no"]]} | r for r in layout.walk_chunks(data)]
            yield from exr.line_batches(iter([pa.RecordBatch.from_pylist(rows, schema=exr.arrow_schema(exr.CHUNKS))]))


def register(spark: SparkSession) -> None:
    """Make the source, the sink and the table function known to a session, and let it push filters into Python sources."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ExrSource)
    spark.udtf.register("exr_lines", F.arrow_udtf(ExrLines, returnType=exr.LINES))
