"""Which chunks to read, and where they lie: closed-form places in the offset table, and a walk where there is no usable table.

A reader tells what it wants (parts, levels, rows, a window). From the headers alone follow the places of those chunks in the
offset tables, and from the tables their bytes, so chunks that are not wanted are never read. Files of many parts
may have tables that are not filled in: then chunk headers are read one after another, and payloads are skipped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace

import numpy as np

from ..functions import geometry
from .layout import KINDS, InvalidData, Part, Plan

Read = Callable[[int, int], bytes]
#: Neighbouring chunks with at most so many unwanted bytes between them are read in one go.
GAP = 16_384
#: Bytes that a walk reads ahead at a chunk header.
AHEAD = 4096


@dataclass(frozen=True)
class Wanted:
    """Inclusive ranges, null for all: parts, levels and rows (counted within the level), and a window of the first level.

    window: (x0, y0, x1, y1) in pixels from the upper left corner of the data window, inclusive. On level (lx, ly) it
    is the pixels that cover it, each standing for 2 ** lx by 2 ** ly of the first level.
    """

    part_no: tuple[int, int] | None = None
    lvl_x: tuple[int, int] | None = None
    lvl_y: tuple[int, int] | None = None
    y: tuple[int, int] | None = None
    window: tuple[int, int, int, int] | None = None

    @property
    def all(self) -> bool:
        return self == Wanted()

    def narrowed(self, name: str, low: int | None, high: int | None) -> Wanted:
        """With one range cut to [low, high]."""
        a, b = getattr(self, name) or (-(1 << 62), 1 << 62)
        return replace(self, **{name: (a if low is None else max(a, low), b if high is None else min(b, high))})

    def has_part(self, no: int) -> bool:
        return self.part_no is None or self.part_no[0] <= no <= self.part_no[1]

    def has_level(self, lx: int, ly: int) -> bool:
        return all(r is None or r[0] <= v <= r[1] for r, v in ((self.lvl_x, lx), (self.lvl_y, ly)))

    def box(self, part: Part, lx: int, ly: int) -> tuple[int, int, int, int]:
        """The wanted pixels of a level: (x0, y0, x1, y1), inclusive; empty if x1 < x0 or y1 < y0."""
        x0, y0, x1, y1 = 0, 0, geometry.level_extent(part.width, lx, part.up) - 1, geometry.level_extent(part.height, ly, part.up) - 1
        if self.window is not None:
            a, b, c, d = self.window
            if a > c or b > d or c < 0 or d < 0 or a >= part.width or b >= part.height:
                return 0, 0, -1, -1
            x0, y0, x1, y1 = max(x0, min(max(a, 0) >> lx, x1)), max(y0, min(max(b, 0) >> ly, y1)), min(x1, c >> lx), min(y1, d >> ly)
        if self.y is not None:
            y0, y1 = max(y0, self.y[0]), min(y1, self.y[1])
        return x0, y0, x1, y1


def numbers(part: Part, no: int, wanted: Wanted) -> np.ndarray:
    """Places in the part's offset table of the chunks that hold wanted pixels, in order."""
    if not wanted.has_part(no):
        return np.zeros(0, np.int64)
    tw, th = part.tile if part.tiled else (part.width, part.rows)
    out = [np.zeros(0, np.int64)]
    for (lx, ly), (across, _) in part.grids.items():
        x0, y0, x1, y1 = wanted.box(part, lx, ly)
        if wanted.has_level(lx, ly) and x0 <= x1 and y0 <= y1:
            tx, ty = np.arange(x0 // tw, x1 // tw + 1), np.arange(y0 // th, y1 // th + 1)
            out.append((part.firsts[lx, ly] + ty[:, None] * across + tx).ravel())
    return np.concatenate(out)


@dataclass
class Index:
    """Chunks in the order of the file: part, number in the part, first byte and the byte after. walked: told by their headers.

    bad: (part, number, what is wrong) of chunks that have no place, where the caller does not want an error.
    """

    part: np.ndarray
    number: np.ndarray
    start: np.ndarray
    stop: np.ndarray
    walked: bool = False
    bad: list[tuple[int | None, int | None, str]] = field(default_factory=list)

    def take(self, some: np.ndarray) -> Index:
        return Index(self.part[some], self.number[some], self.start[some], self.stop[some], self.walked, self.bad)


def check_complete(plan: Plan, no: int, places: Iterable[int]) -> None:
    """A deep part has each place once."""
    found = np.fromiter(places, np.int64)
    if len(found) != plan.parts[no].count or len(np.unique(found)) != len(found):
        raise InvalidData(f"a deep chunk twice or missing in part {no}")


def heads_at(plan: Plan, read: Read, offsets: Iterable[int], length: int) -> list[dict]:
    """The rows of the chunk headers at these offsets."""
    most = 4 + max(KINDS.values())
    return [plan.head(read(int(at), min(most, length - int(at))), 0)[0] for at in offsets]


def walked(plan: Plan, read: Read, length: int, wanted: Wanted, strict: bool = True) -> Index:
    """The index by chunk headers alone, one after another; payloads are skipped. Without strict it ends at a bad header."""
    at, data, base = plan.body, b"", 0
    seen, places = [0] * len(plan.parts), [set() for _ in plan.parts]
    keep = [set(numbers(p, no, wanted).tolist()) if not wanted.all else None for no, p in enumerate(plan.parts)]
    rows, bad = [], []
    for _ in range(sum(plan.counts)):
        if not base <= at <= base + len(data) - 4 - max(KINDS.values()):
            base, data = at, read(at, min(AHEAD, max(0, length - at)))
        try:
            row, head, size = plan.head(data, at - base)
            if at + head + size > length:
                raise InvalidData("a chunk is cut off")
        except InvalidData as e:
            if strict:
                raise
            return Index(*np.array(rows, dtype=np.int64).reshape(-1, 4).T, True, [*bad, (None, None, f"{e}: the walk ends here")])
        no = row["part_no"]
        place = plan.parts[no].place(row["tx"], row["ty"], row["lvl_x"], row["lvl_y"])
        twice = False
        if plan.parts[no].deep:
            twice = place in places[no]
            places[no].add(place)
            if twice:
                if strict:
                    raise InvalidData(f"a deep chunk twice in part {no}")
                bad.append((no, seen[no], "a deep chunk twice"))
        if not twice and (keep[no] is None or place in keep[no]):
            rows.append((no, seen[no], at, at + head + size))
        seen[no] += 1
        at += head + size
    for no, part in enumerate(plan.parts):
        if part.deep and strict:
            check_complete(plan, no, places[no])
    return Index(*np.array(rows, dtype=np.int64).reshape(-1, 4).T, True, bad)


def index_of(plan: Plan, read: Read, length: int, wanted: Wanted = Wanted(), recover: bool = False, strict: bool = True) -> Index:  # noqa: B008  not changed
    """The wanted chunks of a file of so many bytes, in their order in the file.

    recover: do not look at the offset tables. Without it, the tables of a file of many parts are passed over only if an
    offset is none (zero, outside the file, or twice), as some writers leave them; a file of one part is refused then, or
    without strict those chunks are listed as bad.
    """
    if recover:
        return walked(plan, read, length, wanted, strict)
    total = sum(plan.counts)
    table = np.frombuffer(read(plan.at, 8 * total), "<u8")
    if len(table) < total:
        raise InvalidData("the offset tables are cut off")
    outside = (table < plan.body) | (table >= length)
    table = np.where(outside, -1, table).astype(np.int64)
    distinct, first = np.unique(table[~outside], return_index=True)
    first = np.nonzero(~outside)[0][first]
    bases = np.concatenate([[0], np.cumsum(plan.counts)])
    part_of = lambda some: np.searchsorted(bases, some, side="right") - 1
    if plan.many and len(distinct) < total:
        return walked(plan, read, length, wanted, strict)
    twice = np.setdiff1d(np.nonzero(~outside)[0], first)  # flat chunks are read once, whatever the table tells
    twice = twice[[plan.parts[no].deep for no in part_of(twice)]] if len(twice) else twice
    bad = [(int(part_of(i)), int(i - bases[part_of(i)]), what) for some, what in ((np.nonzero(outside)[0], "an offset outside the file"), (twice, "a deep chunk twice")) for i in some.tolist()]
    if bad and strict:
        raise InvalidData(f"{bad[0][2]}: chunk {bad[0][1]} of part {bad[0][0]}")
    part = part_of(first)
    index = Index(part, first - bases[part], distinct, np.append(distinct[1:], length)[: len(distinct)], False, bad)
    if wanted.all:
        return index
    keep = np.zeros(total, bool)
    for no, p in enumerate(plan.parts):
        own = numbers(p, no, wanted)
        keep[bases[no] + own[own < plan.counts[no]]] = True
    return index.take(np.nonzero(keep[first])[0])


def runs(index: Index, most: int, gap: int = GAP) -> list[tuple[int, int]]:
    """(first, last + 1) of runs of neighbouring chunks of about `most` bytes, or one chunk."""
    n, out, a = len(index.start), [], 0
    broken = np.append(np.nonzero(index.start[1:] - index.stop[:-1] > gap)[0] + 1, n)
    while a < n:
        end = int(broken[np.searchsorted(broken, a, side="right")])
        b = int(np.searchsorted(index.stop[a:end], index.start[a] + most, side="right")) + a
        out.append((a, max(a + 1, b)))
        a = out[-1][1]
    return out


def check_places(plan: Plan, read: Read, length: int, rows: list[dict], wanted: Wanted) -> None:
    """Rows of chunks read by the table lie where the table's order tells, or else their part is looked through.

    Deep parts must then still have each place once. Of flat parts only a selection relies on the order.
    """
    off = {r["part_no"] for r in rows if plan.parts[r["part_no"]].place(r["tx"], r["ty"], r["lvl_x"], r["lvl_y"]) != r["chunk_idx"]}
    if off and not wanted.all:
        raise InvalidData("an offset table in another order: read all chunks, or with recover")
    for no in off:
        if plan.parts[no].deep:
            base = sum(plan.counts[:no])
            offsets = np.frombuffer(read(plan.at + 8 * base, 8 * plan.counts[no]), "<u8")
            found = heads_at(plan, read, offsets, length)
            check_complete(plan, no, [plan.parts[no].place(r["tx"], r["ty"], r["lvl_x"], r["lvl_y"]) for r in found])
