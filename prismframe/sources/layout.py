"""The file layout: headers, attributes, chunk tables and chunk bodies, as small functions of bytes."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import cached_property
from itertools import accumulate

import numpy as np

from ..functions import codecs, geometry
from ..functions.codecs import InvalidData, Unsupported

MAGIC = 0x01312F76
SINGLE_TILE, LONG_NAMES, NON_IMAGE, MULTIPART = 0x200, 0x400, 0x800, 0x1000
PIXEL_TYPES = ("UINT", "HALF", "FLOAT")
#: Payload formats of attribute types; integers first, then floats.
INTEGERS = {"box2i": "<4i", "int": "<i", "v2i": "<2i", "v3i": "<3i", "tiledesc": "<IIB", "rational": "<iI", "timecode": "<II", "keycode": "<7i", "compression": "<B", "lineOrder": "<B"}
FLOATS = {"box2f": "<4f", "float": "<f", "v2f": "<2f", "v3f": "<3f", "m33f": "<9f", "m44f": "<16f", "chromaticities": "<8f", "double": "<d", "v2d": "<2d", "v3d": "<3d", "m33d": "<9d", "m44d": "<16d"}
#: Part types and the size of a chunk's header without the part number.
KINDS = {"scanlineimage": 8, "tiledimage": 20, "deepscanline": 28, "deeptile": 40}

_ROWS = dict(geometry.COMPRESSIONS.values())


def decode_value(kind: str, data: bytes) -> dict:
    """ints, floats, string or strings of an attribute, by its type; other types have raw bytes only."""
    fixed = INTEGERS.get(kind) or FLOATS.get(kind)
    if fixed:
        if len(data) != struct.calcsize(fixed):
            raise InvalidData(f"{kind} of {len(data)} bytes")
        return {"ints" if kind in INTEGERS else "floats": list(struct.unpack(fixed, data))}
    try:
        if kind == "string":
            return {"string": data.decode()}
        if kind == "stringvector":
            out, at = [], 0
            while at < len(data):
                n = struct.unpack_from("<i", data, at)[0] if at + 4 <= len(data) else -1
                if n < 0 or at + 4 + n > len(data):
                    raise InvalidData("a string of the vector is cut off")
                out.append(data[at + 4 : at + 4 + n].decode())
                at += 4 + n
            return {"strings": out}
    except UnicodeDecodeError as e:
        raise InvalidData(f"{kind}: {e}") from None
    return {}


def encode_value(kind: str, value: object) -> bytes:
    """The payload of a value as decode_value tells it (a single number need not be a list)."""
    fixed = INTEGERS.get(kind) or FLOATS.get(kind)
    if fixed:
        return struct.pack(fixed, *(value if isinstance(value, (list, tuple)) else [value]))
    if kind == "string":
        return str(value).encode()
    if kind == "stringvector":
        return b"".join(struct.pack("<i", len(s.encode())) + s.encode() for s in value)
    if kind == "chlist":
        return b"".join(c.name.encode() + struct.pack("<xiB3xii", PIXEL_TYPES.index(c.kind), c.linear, c.xs, c.ys) for c in value) + b"\0"
    return bytes(value)


@dataclass
class Channel:
    name: str
    kind: str
    linear: bool = False
    xs: int = 1
    ys: int = 1


def _name(data: bytes, at: int, most: int) -> tuple[str, int]:
    end = data.find(b"\0", at, at + most + 1)
    if end < 0:
        raise InvalidData(f"no name of at most {most} bytes at {at}")
    try:
        return data[at:end].decode(), end + 1
    except UnicodeDecodeError as e:
        raise InvalidData(str(e)) from None


def decode_channels(data: bytes) -> list[Channel]:
    out, at = [], 0
    while data[at : at + 1] not in (b"\0", b""):
        name, at = _name(data, at, 255)
        if at + 16 > len(data):
            raise InvalidData("a channel is cut off")
        kind, linear, xs, ys = struct.unpack_from("<iB3xii", data, at)
        if not 0 <= kind < 3:
            raise InvalidData(f"pixel type {kind}")
        out.append(Channel(name, PIXEL_TYPES[kind], linear != 0, xs, ys))
        at += 16
    if at + 1 != len(data):
        raise InvalidData("the channel list does not end where it should")
    return out


@dataclass
class Part:
    """A part of a file. kind is a key of KINDS; tile and mode count for tiled kinds; y0 and x0 are the window's origin.

    display: the display window (x0, y0, x1, y1), or else the data window, or in a file of many parts the one around all of them.
    line_order 1 lays the chunks of a part without tiles down from the last to the first. extra: more attributes (name, type,
    value), which replace those of the same name.
    """

    width: int
    height: int
    channels: list[Channel]
    kind: str = "scanlineimage"
    codec: str = "ZIP"
    name: str = ""
    tile: tuple[int, int] = (64, 64)
    mode: int = geometry.ONE_LEVEL
    up: bool = False
    x0: int = 0
    y0: int = 0
    display: tuple[int, int, int, int] | None = None
    line_order: int = 0
    aspect: float = 1.0
    center: tuple[float, float] = (0.0, 0.0)
    screen_width: float = 1.0
    extra: list[tuple[str, str, object]] = field(default_factory=list)

    @property
    def tiled(self) -> bool:
        return self.kind in ("tiledimage", "deeptile")

    @property
    def deep(self) -> bool:
        return self.kind in ("deepscanline", "deeptile")

    @property
    def rows(self) -> int:
        return _ROWS[self.codec]

    def chunks(self) -> list[tuple[int, int, int, int]]:
        """(tx, ty, lvl_x, lvl_y) in order; a scanline block counts as a tile as wide as the image."""
        if self.tiled:
            return geometry.tiles(self.width, self.height, *self.tile, self.mode, self.up)
        return [(0, ty, 0, 0) for ty in range(-(-self.height // self.rows))]

    @cached_property
    def grids(self) -> dict[tuple[int, int], tuple[int, int]]:
        """Chunks across and down of each level."""
        tw, th = self.tile if self.tiled else (self.width, self.rows)
        found = geometry.levels(self.width, self.height, self.mode, self.up) if self.tiled else [(0, 0)]
        extent = geometry.level_extent
        return {(lx, ly): (-(-extent(self.width, lx, self.up) // tw), -(-extent(self.height, ly, self.up) // th)) for lx, ly in found}

    @property
    def count(self) -> int:
        return sum(w * h for w, h in self.grids.values())

    @cached_property
    def firsts(self) -> dict[tuple[int, int], int]:
        """The number of the first chunk of each level in the part's offset table."""
        sizes = [w * h for w, h in self.grids.values()]
        return dict(zip(self.grids, np.concatenate([[0], np.cumsum(sizes)[:-1]]).tolist(), strict=True))

    def place(self, tx: int, ty: int, lx: int, ly: int) -> int:
        """The number of a chunk in a table that is in order."""
        return self.firsts[lx, ly] + ty * self.grids[lx, ly][0] + tx

    def box(self, tx: int, ty: int, lx: int, ly: int) -> tuple[int, int, int, int]:
        """(x, y, width, height) of a chunk within its level."""
        w, h = geometry.level_extent(self.width, lx, self.up), geometry.level_extent(self.height, ly, self.up)
        tw, th = self.tile if self.tiled else (self.width, self.rows)
        return tx * tw, ty * th, min(tw, w - tx * tw), min(th, h - ty * th)


def decode_header(data: bytes) -> tuple[int, list[list[tuple[str, str, bytes]]], int]:
    """(version field, attributes (name, type, payload) of each part in order, offset after the headers)."""
    if len(data) < 8 or struct.unpack_from("<I", data)[0] != MAGIC:
        raise InvalidData("no magic number")
    version = struct.unpack_from("<I", data, 4)[0]
    if version & 0xFF != 2:
        raise Unsupported(f"format version {version & 0xFF}")
    most, at, parts = 255 if version & LONG_NAMES else 31, 8, []
    while True:
        own: list[tuple[str, str, bytes]] = []
        while data[at : at + 1] != b"\0":
            name, at = _name(data, at, most)
            kind, at = _name(data, at, most)
            size = struct.unpack_from("<i", data, at)[0] if at + 4 <= len(data) else -1
            if size < 0 or at + 4 + size > len(data):
                raise InvalidData(f"attribute {name} is cut off")
            own.append((name, kind, data[at + 4 : at + 4 + size]))
            at += 4 + size
        at += 1
        if not own and version & MULTIPART:
            break
        parts.append(own)
        if not version & MULTIPART:
            break
    if not parts:
        raise InvalidData("no parts")
    return version, parts, at


def part_of(version: int, attributes: list[tuple[str, str, bytes]]) -> tuple[Part, int | None]:
    """The part that the attributes tell of, and its chunkCount. The first attribute of a name counts."""
    first: dict[str, tuple[str, bytes]] = {}
    for name, kind, data in attributes:
        first.setdefault(name, (kind, data))

    def get(name: str, kind: str, default: object = None) -> list:
        if name not in first or first[name][0] != kind:
            if default is None:
                raise InvalidData(f"no attribute {name} of type {kind}")
            return default  # type: ignore[return-value]
        found = decode_value(kind, first[name][1])
        return found.get("ints") or found.get("floats")  # type: ignore[return-value]

    if first.get("channels", ("",))[0] != "chlist":
        raise InvalidData("no channels")
    kind = first["type"][1].rstrip(b"\0").decode(errors="replace") if "type" in first else "tiledimage" if version & SINGLE_TILE else "scanlineimage"
    if kind not in KINDS:
        raise Unsupported(f"part type {kind}")
    code = get("compression", "compression")[0]
    if code not in geometry.COMPRESSIONS:
        raise InvalidData(f"compression {code}")
    codec = geometry.COMPRESSIONS[code][0]
    x0, y0, x1, y1 = get("dataWindow", "box2i")
    if not kind.startswith("deep"):
        get("displayWindow", "box2i")
        get("lineOrder", "lineOrder")
    if x1 < x0 or y1 < y0:
        raise InvalidData("the data window is empty")
    part = Part(x1 - x0 + 1, y1 - y0 + 1, sorted(decode_channels(first["channels"][1]), key=lambda c: c.name.encode()), kind, codec, x0=x0, y0=y0)
    if "name" in first:
        part.name = first["name"][1].decode(errors="replace")
    if codec in geometry.UNSUPPORTED or part.deep and codec not in ("NONE", "RLE", "ZIPS"):
        raise Unsupported(f"compression {codec} of a part of type {kind}")
    if any(c.xs < 1 or c.ys < 1 for c in part.channels):
        raise InvalidData("a sampling rate under 1")
    if part.tiled:
        tx, ty, mode = get("tiles", "tiledesc")
        if not tx or not ty or mode & 15 > 2 or mode >> 4 > 1:
            raise InvalidData("a tile description that cannot be")
        part.tile, part.mode, part.up = (tx, ty), mode & 15, bool(mode >> 4)
    if (part.tiled or part.deep) and any((c.xs, c.ys) != (1, 1) for c in part.channels):
        raise Unsupported("subsampled channels of a tiled or deep part")
    count = get("chunkCount", "int", [-1])[0]
    return part, count if count >= 0 else None


@dataclass
class Plan:
    """What the headers of a file tell: version, parts, chunks of each part, and where the offset tables begin."""

    version: int
    parts: list[Part]
    counts: list[int]
    at: int

    @property
    def many(self) -> bool:
        return bool(self.version & MULTIPART)

    @property
    def body(self) -> int:
        """Where the first chunk may begin."""
        return self.at + 8 * sum(self.counts)

    def head(self, data: bytes, at: int) -> tuple[dict, int, int]:
        """A chunk's row without chunk_idx and payload, the size of its header and that of its payload."""
        no, extra = (struct.unpack_from("<i", data, at)[0], 4) if self.many and at + 4 <= len(data) else (0, 4 * self.many)
        if not 0 <= no < len(self.parts):
            raise InvalidData(f"chunk of part {no}")
        part = self.parts[no]
        if at + extra + KINDS[part.kind] > len(data):
            raise InvalidData("a chunk header is cut off")
        row = {"part_no": no, "y": 0, "tx": 0, "ty": 0, "lvl_x": 0, "lvl_y": 0, "table_size": 0, "unpacked_size": 0}
        p = at + extra
        if part.tiled:
            row["tx"], row["ty"], row["lvl_x"], row["lvl_y"] = struct.unpack_from("<4i", data, p)
            p += 16
        else:
            row["y"] = struct.unpack_from("<i", data, p)[0]
            row["ty"], rest = divmod(row["y"] - part.y0, part.rows)
            p += 4
            if rest:
                raise InvalidData(f"a chunk at row {row['y']}")
        if part.deep:
            row["table_size"], size, row["unpacked_size"] = struct.unpack_from("<3Q", data, p)
            size += row["table_size"]
        else:
            size = struct.unpack_from("<i", data, p)[0]
        across, down = part.grids.get((row["lvl_x"], row["lvl_y"]), (0, 0))
        if not (0 <= row["tx"] < across and 0 <= row["ty"] < down):
            raise InvalidData(f"a chunk outside its part: {row}")
        if size < 0:
            raise InvalidData("a chunk of a negative size")
        return row, extra + KINDS[part.kind], size

    def chunk(self, data: bytes, at: int) -> tuple[dict, int]:
        """A chunk's row without chunk_idx, and the place after it."""
        row, head, size = self.head(data, at)
        if at + head + size > len(data):
            raise InvalidData("a chunk is cut off")
        return row | {"payload": data[at + head : at + head + size]}, at + head + size


def plan_of(head: bytes, length: int) -> Plan:
    """The plan of a file of so many bytes from its first ones, which hold all headers."""
    version, headers, at = decode_header(head)
    told = [part_of(version, h) for h in headers]
    counts = []
    for part, count in told:
        n = part.count if part.width * part.height <= 4 * length * 65536 else -1
        if n < 0 and (part.deep or part.tiled):
            raise InvalidData("a data window that no file of this size can fill")
        if count is not None and count != n and (part.deep or part.tiled):
            raise InvalidData(f"chunkCount {count} where there are {n} chunks")
        counts.append(n if count is None else count)
        if counts[-1] < 0 or at + 8 * counts[-1] > length:
            raise InvalidData("the offset table is cut off")
    if at + 8 * sum(counts) > length:
        raise InvalidData("the offset tables are cut off")
    return Plan(version, [p for p, _ in told], counts, at)


def plan_by_ranges(read: Callable[[int, int], bytes], length: int, first: int = 65536) -> Plan:
    """The plan of a file from reads (place, bytes) of no more than its headers take, doubled until they are whole."""
    n = min(first, length)
    while True:
        try:
            return plan_of(read(0, n), length)
        except InvalidData:
            if n >= length:
                raise
            n = min(2 * n, length)


def walk_chunks(data: bytes) -> list[dict]:
    """The chunks of a file: part_no, chunk_idx, y, tx, ty, lvl_x, lvl_y, table_size, unpacked_size and payload.

    A file of one part is read by its offset table, one of many parts from chunk to chunk.
    """
    plan = plan_of(data, len(data))
    offsets = None if plan.many else struct.unpack_from(f"<{plan.counts[0]}Q", data, plan.at)
    at, out, seen = plan.at + 8 * sum(plan.counts), [], [0] * len(plan.parts)
    for i in range(sum(plan.counts)):
        row, at = plan.chunk(data, at if offsets is None else offsets[i])
        out.append(row | {"chunk_idx": seen[row["part_no"]]})
        seen[row["part_no"]] += 1
    places: list[list] = [[] for _ in plan.parts]
    for r in out:
        places[r["part_no"]].append((r["tx"], r["ty"], r["lvl_x"], r["lvl_y"]))
    for part, own in zip(plan.parts, places, strict=True):
        if part.deep and (len(set(own)) < len(own) or len(own) < part.count):
            raise InvalidData("a deep chunk twice or missing")
    return out


def _present(part: Part, x: int, y: int, w: int, h: int) -> list[tuple[int, Channel, int]]:
    """(row, channel, samples) of a flat chunk in native order; a row has the channels whose sampling it meets."""
    return [(r, c, -(-w // c.xs)) for r in range(y, y + h) for c in part.channels if r % c.ys == 0]


def decode_chunk(part: Part, row: dict) -> list[tuple[str, int, int, np.ndarray | None, np.ndarray]]:
    """(channel, row, first x, counts of a deep row, samples) of a chunk; rows and x count from 0 in the level."""
    x, y, w, h = part.box(row["tx"], row["ty"], row["lvl_x"], row["lvl_y"])
    data = row["payload"]
    if part.deep:
        return _decode_deep(part, row, x, y, w, h)
    lines = _present(part, x, y, w, h)
    size = sum(n * codecs.NATIVE[c.kind] for _, c, n in lines)
    out = []
    if part.codec == "PXR24":
        return [(c.name, r, x, None, v) for (r, c, _), v in zip(lines, codecs.pxr24_unpack(data, [(n, c.kind) for _, c, n in lines]), strict=True)]
    if part.codec in ("B44", "B44A") and len(data) < size:
        at = 0
        for c in part.channels:
            own, n = [r for r, d, _ in lines if d is c], -(-w // c.xs)
            if c.kind == "HALF":
                plane, used = codecs.b44_unpack(data[at:], len(own), n, c.linear)
            else:
                used = len(own) * n * 4
                plane = codecs.from_native(data[at : at + used], c.kind).reshape(len(own), n) if at + used <= len(data) else None
            if plane is None:
                raise InvalidData("a plane is cut off")
            at += used
            out += [(c.name, r, x, None, v) for r, v in zip(own, plane, strict=True)]
        if at != len(data):
            raise InvalidData("bytes after the last plane")
        return out
    raw = codecs.unpack(data, size, "NONE" if part.codec in ("B44", "B44A") else part.codec)
    at = 0
    for r, c, n in lines:
        end = at + n * codecs.NATIVE[c.kind]
        out.append((c.name, r, x, None, codecs.from_native(raw[at:end], c.kind)))
        at = end
    return out


def _decode_deep(part: Part, row: dict, x: int, y: int, w: int, h: int) -> list[tuple[str, int, int, np.ndarray | None, np.ndarray]]:
    data, size, stride = row["payload"], row["table_size"], w
    if part.tiled and part.codec == "NONE" and size == 4 * part.tile[0] * part.tile[1]:
        stride = part.tile[0]  # a table of the whole tile
    rows = size // (4 * stride) if part.codec == "NONE" and stride != w else h
    table = np.frombuffer(codecs.unpack(data[:size], 4 * stride * rows, part.codec), "<i4").reshape(rows, stride)[:h, :w].astype(np.int64)
    counts = table.copy()
    counts[:, 1:] -= table[:, :-1]
    if counts.min() < 0:
        raise InvalidData("cumulative counts that fall")
    tops = table[:, -1].tolist()  # samples of each row
    total = sum(tops)
    width = sum(codecs.NATIVE[c.kind] for c in part.channels)
    if total * width != row["unpacked_size"]:
        raise InvalidData(f"the samples take {total * width} bytes, not the {row['unpacked_size']} that are told")
    raw = codecs.unpack(data[size:], total * width, part.codec) if total else b""
    told = list(zip(range(y, y + h), counts, accumulate(tops, initial=0), accumulate(tops), strict=False))
    out, at = [], 0
    for c in part.channels:
        values = codecs.from_native(raw[at : at + total * codecs.NATIVE[c.kind]], c.kind)
        at += total * codecs.NATIVE[c.kind]
        out += [(c.name, r, x, own, values[a:b]) for r, own, a, b in told]
    return out


def encode_chunk(part: Part, tx: int, ty: int, lx: int, ly: int, lines: dict[tuple[str, int], tuple[np.ndarray, np.ndarray | None]]) -> tuple[bytes, int]:
    """(bytes of a chunk without the part number, most samples of a pixel) from samples by channel and row."""
    x, y, w, h = part.box(tx, ty, lx, ly)
    head = struct.pack("<4i", tx, ty, lx, ly) if part.tiled else struct.pack("<i", part.y0 + y)
    try:
        if part.deep:
            counts = np.array([lines[part.channels[0].name, r][1] for r in range(y, y + h)], dtype=np.int64).reshape(h, w)
            sums = counts.cumsum(axis=1)
            if sums.max() >= 2**31:
                raise InvalidData("a row of more than 2^31 - 1 samples")
            raw = b"".join(codecs.to_native(np.concatenate([lines[c.name, r][0] for r in range(y, y + h)]), c.kind) for c in part.channels)
            table, packed = codecs.pack(sums.astype("<i4").tobytes(), part.codec), codecs.pack(raw, part.codec)
            return head + struct.pack("<3Q", len(table), len(packed), len(raw)) + table + packed, int(counts.max())
        present = [(c, lines[c.name, r][0]) for r, c, _ in _present(part, x, y, w, h)]
        if any(len(v) != -(-w // c.xs) for c, v in present):
            raise InvalidData(f"a row of another length in tile {tx}, {ty}")
    except KeyError as e:
        raise InvalidData(f"no samples of {e}") from None
    raw = b"".join(codecs.to_native(v, c.kind) for c, v in present)
    if part.codec == "PXR24":
        body = codecs.pxr24_pack([(v, c.kind) for c, v in present])
    elif part.codec in ("B44", "B44A"):
        body = b""
        for c in part.channels:
            plane = np.stack([v for d, v in present if d is c]) if any(d is c for d, _ in present) else None
            if plane is not None:
                body += codecs.b44_pack(plane, part.codec == "B44A", c.linear) if c.kind == "HALF" else codecs.to_native(plane.ravel(), c.kind)
        body = body if len(body) < len(raw) else raw
    else:
        body = codecs.pack(raw, part.codec)
    return head + struct.pack("<i", len(body)) + body, 0


def check_lines(part: Part, tx: int, ty: int, lx: int, ly: int, lines: Iterable[tuple[str, int]]) -> None:
    """Lines (channel, row) that are told for a chunk belong to it."""
    _, y, _, h = part.box(tx, ty, lx, ly)
    if stray := set(lines) - {(c.name, r) for r in range(y, y + h) for c in part.channels if r % c.ys == 0}:
        raise InvalidData(f"rows that the part has no place for: {sorted(stray)[:3]}")


def check_parts(parts: list[Part]) -> None:
    many = len(parts) > 1 or bool(parts[0].name)
    names = [p.name for p in parts]
    if many and (len(set(names)) < len(names) or not all(names)):
        raise InvalidData("part names must be unique and not empty")
    if any(c.name >= d.name for p in parts for c, d in zip(p.channels, p.channels[1:])):
        raise InvalidData("channels must be in order of name, without repeats")


def encode_headers(parts: list[Part], most_samples: list[int]) -> bytes:
    """All that comes before the offset tables."""
    check_parts(parts)
    many = len(parts) > 1 or bool(parts[0].name)
    version = 2 | (MULTIPART if many else 0) | (NON_IMAGE if any(p.deep for p in parts) else 0) | (SINGLE_TILE if not many and parts[0].kind == "tiledimage" else 0)
    around = (0, 0, max(p.width for p in parts) - 1, max(p.height for p in parts) - 1)
    out = struct.pack("<II", MAGIC, version)
    for no, p in enumerate(parts):
        code = next(k for k, (name, _) in geometry.COMPRESSIONS.items() if name == p.codec)
        window = (p.x0, p.y0, p.x0 + p.width - 1, p.y0 + p.height - 1)
        a = [("channels", "chlist", p.channels), ("compression", "compression", code), ("dataWindow", "box2i", window), ("displayWindow", "box2i", p.display or (around if many else window))]
        a += [("lineOrder", "lineOrder", p.line_order), ("pixelAspectRatio", "float", p.aspect), ("screenWindowCenter", "v2f", p.center), ("screenWindowWidth", "float", p.screen_width)]
        if many or p.deep:
            a += [("chunkCount", "int", p.count), ("type", "string", p.kind)]
        if many:
            a.append(("name", "string", p.name))
        if p.deep:
            a += [("maxSamplesPerPixel", "int", most_samples[no]), ("version", "int", 1)]
        if p.tiled:
            a.append(("tiles", "tiledesc", (*p.tile, p.mode | p.up << 4)))
        named = {x[0]: x for x in [*a, *p.extra]}
        for name, kind, value in (named[k] for k in sorted(named)):
            data = encode_value(kind, value)
            out += name.encode() + b"\0" + kind.encode() + b"\0" + struct.pack("<i", len(data)) + data
        out += b"\0"
    return out + b"\0" * many


def laid(part: Part, at: int) -> int:
    """Where chunk number at lies among the chunks of its part in the file."""
    return part.count - 1 - at if part.line_order == 1 and not part.tiled else at


def encode_file(parts: list[Part], chunks: list[tuple[int, bytes]], most_samples: list[int]) -> bytes:
    """A whole file from all its chunks (part, bytes) in order of part and number."""
    many, head = len(parts) > 1 or bool(parts[0].name), encode_headers(parts, most_samples)
    if [sum(no == n for n, _ in chunks) for no in range(len(parts))] != [p.count for p in parts]:
        raise InvalidData("chunks missing or too many")
    whole = [struct.pack("<i", no) * many + body for no, body in chunks]
    first = np.cumsum([0, *[p.count for p in parts]])
    order = [first[no] + i for no, p in enumerate(parts) for i in sorted(range(p.count), key=lambda i: laid(p, i))]  # noqa: B023  used at once
    at, place = np.zeros(len(whole), np.int64), len(head) + 8 * len(whole)
    for i in order:
        at[i], place = place, place + len(whole[i])
    return head + at.astype("<u8").tobytes() + b"".join(whole[i] for i in order)
