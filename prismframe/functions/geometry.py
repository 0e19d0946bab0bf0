"""Level, tile and chunk geometry, as plain numbers for readers and as Columns for tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Compression codes, names and rows in a chunk.
COMPRESSIONS = {0: ("NONE", 1), 1: ("RLE", 1), 2: ("ZIPS", 1), 3: ("ZIP", 16), 4: ("PIZ", 32), 5: ("PXR24", 16), 6: ("B44", 32), 7: ("B44A", 32), 8: ("DWAA", 32), 9: ("DWAB", 256)}
UNSUPPORTED = ("PIZ", "DWAA", "DWAB")
ONE_LEVEL, MIPMAP, RIPMAP = 0, 1, 2


def level_count(extent: int, up: bool = False) -> int:
    """Levels until the extent is 1, the first included."""
    n = 1
    while extent > 1:
        extent, n = (extent + up) // 2, n + 1
    return n


def level_extent(extent: int, level: int, up: bool = False) -> int:
    return max(1, -(-extent // (1 << level)) if up else extent >> level)


def levels(width: int, height: int, mode: int, up: bool = False) -> list[tuple[int, int]]:
    """(lvl_x, lvl_y) in the order of chunks."""
    if mode == ONE_LEVEL:
        return [(0, 0)]
    if mode == MIPMAP:
        return [(i, i) for i in range(level_count(max(width, height), up))]
    return [(x, y) for y in range(level_count(height, up)) for x in range(level_count(width, up))]


def tiles(width: int, height: int, tile_x: int, tile_y: int, mode: int = ONE_LEVEL, up: bool = False) -> list[tuple[int, int, int, int]]:
    """(tx, ty, lvl_x, lvl_y) of all tiles in the order of chunks."""
    out = []
    for lx, ly in levels(width, height, mode, up):
        w, h = level_extent(width, lx, up), level_extent(height, ly, up)
        out += [(tx, ty, lx, ly) for ty in range(-(-h // tile_y)) for tx in range(-(-w // tile_x))]
    return out


def level_count_of(extent: Column, up: bool = False) -> Column:
    """level_count of a positive BIGINT below 2^31, from the length of its binary form."""
    if up:
        return F.length(F.bin(F.greatest(extent - 1, F.lit(0)))) + F.when(extent > 1, 1).otherwise(0)
    return F.length(F.bin(extent))


def level_extent_of(extent: Column, level: Column, up: bool = False) -> Column:
    unit = F.pow(F.lit(2.0), level).cast("long")
    return F.greatest(F.lit(1), F.floor((extent + (unit - 1 if up else 0)) / unit).cast("long"))


def parts_of(extent: Column, size: Column | int) -> Column:
    """Blocks or tiles along an axis: extent / size, rounded up."""
    size = F.lit(size) if isinstance(size, int) else size
    return F.floor((extent + size - 1) / size).cast("long")
