"""Pyramids of planes in rows (keys, y, samples array<float>): a shuffle of whole rows for several levels, none along x.

All arithmetic is in FLOAT and in a fixed order, since sums and averages in DOUBLE give other bits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, FloatType, IntegerType, StructField, StructType

from ..functions.geometry import level_count, level_extent
from ..plans.lineage import cut, work_tasks
from .tables import bound


def _taps(samples: Column, x: Column, width: int) -> tuple[Column, Column]:
    """Samples 2 x and 2 x + 1, the latter clamped to the row."""
    return F.get(samples, 2 * x), F.get(samples, F.least(2 * x + 1, F.lit(width - 1)))


def _f(x: float) -> Column:
    return F.lit(x).cast("float")


def _pairs(rows: DataFrame, keys: list[str], height: int) -> DataFrame:
    """Rows with up and low, the two rows of a row of the next level; an odd last row goes, an only row counts twice."""
    kept = rows.where(F.col("y") < 2 * level_extent(height, 1))
    both = kept.groupBy(*keys, F.floor(F.col("y") / 2).cast("int").alias("_y")).agg(F.sort_array(F.collect_list(F.struct("y", "samples"))).alias("r"))
    return both.select(*keys, F.col("_y").alias("y"), F.col("r")[0]["samples"].alias("up"), F.element_at("r", -1)["samples"].alias("low"))


def mip_level(rows: DataFrame, keys: list[str], width: int, height: int) -> DataFrame:
    """The next level by the box filter: a quarter of ((v00 + v01) + v10) + v11."""

    def value(x: Column) -> Column:
        (v00, v01), (v10, v11) = _taps(F.col("up"), x, width), _taps(F.col("low"), x, width)
        return _f(0.25) * (((v00 + v01) + v10) + v11)

    columns = F.sequence(F.lit(0), F.lit(level_extent(width, 1) - 1))
    return _pairs(rows, keys, height).select(*keys, "y", F.transform(columns, value).alias("samples"))


#: Levels made in one shuffle: strips of 2 ** STRIP rows meet in a task, which holds one strip at a time.
STRIP = 6
Halve = Callable[[np.ndarray, np.ndarray, int], np.ndarray]


def strips(rows: DataFrame, keys: list[str], height: int, first: int, halve: Halve, levels: int = STRIP) -> DataFrame:
    """Rows (keys, lvl, y, samples) of `levels` levels above level `first`, whose rows (keys, y, samples) are given.

    halve(up, low, lvl) makes a row from two rows of level lvl. height: of level 0.
    """
    own = rows.select(*keys, F.col("y").cast("int").alias("y"), "samples")
    strip = F.floor(F.col("y") / (1 << levels)).cast("int").alias("_strip")
    dealt = own.select("*", strip).repartition(work_tasks(rows.sparkSession), *keys, "_strip").sortWithinPartitions(*keys, "_strip", "y")
    made = StructType([*[own.schema[k] for k in keys], *_LEVEL_FIELDS])
    arrow = to_arrow_schema(made)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            samples = batch.column("samples")
            at, values = samples.offsets.to_numpy(), samples.values.to_numpy(zero_copy_only=False).astype(np.float32, copy=False)
            for i, (*key, y) in enumerate(zip(*(batch.column(k).to_pylist() for k in (*keys, "_strip", "y")), strict=True)):
                if key != now:
                    yield from finished(now, held)
                    now, held = key, []
                held.append((y, values[at[i] : at[i + 1]].copy()))
        yield from finished(now, held)

    def finished(key: list | None, held: list[tuple[int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        out = []
        for lvl in range(first, first + levels):
            pairs: dict[int, list[np.ndarray]] = {}
            for y, v in held:
                if y < 2 * level_extent(height, lvl + 1):  # an odd last row goes, an only row counts twice
                    pairs.setdefault(y // 2, []).append(v)
            held = [(y, halve(p[0], p[-1], lvl)) for y, p in sorted(pairs.items())]
            out += [(lvl + 1, y, v) for y, v in held]
        if out:
            lvl, y, v = zip(*out, strict=True)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in v])]), pa.int32()), pa.array(np.concatenate(v), pa.float32()))
            columns = [*[pa.array([k] * len(out), arrow.field(i).type) for i, k in enumerate(key[:-1])], pa.array(lvl, pa.int32()), pa.array(y, pa.int32()), lists]
            yield pa.RecordBatch.from_arrays(columns, names=arrow.names)

    return dealt.mapInArrow(work, made)


_LEVEL_FIELDS = [StructField("lvl", IntegerType()), StructField("y", IntegerType()), StructField("samples", ArrayType(FloatType()))]


def _levels_above(rows: DataFrame, keys: list[str], height: int, count: int, halve: Halve) -> DataFrame | None:
    """Rows (keys, lvl, y, samples) of levels 1 to count - 1; one written table for STRIP levels."""
    out, first = None, 0
    while first < count - 1:
        n = min(STRIP, count - 1 - first)
        made = cut(strips(rows, keys, height, first, halve, n))
        out = made if out is None else out.union(made)
        rows, first = made.where(F.col("lvl") == first + n), first + n
    return out


def mip_pyramid(rows: DataFrame, keys: list[str], width: int, height: int) -> DataFrame:
    """All levels from 0, with lvl_x = lvl_y, by the box filter: a quarter of ((v00 + v01) + v10) + v11."""

    def halve(up: np.ndarray, low: np.ndarray, lvl: int) -> np.ndarray:
        n = level_extent(width, lvl)
        x = 2 * np.arange(level_extent(width, lvl + 1))
        beside = np.minimum(x + 1, n - 1)
        return np.float32(0.25) * (((up[x] + up[beside]) + low[x]) + low[beside])

    now = rows.select(*keys, F.lit(0).alias("lvl"), F.col("y").cast("int").alias("y"), F.col("samples").cast("array<float>").alias("samples"))
    above = _levels_above(now, keys, height, level_count(max(width, height)), halve)
    out = now if above is None else now.union(above)
    return out.select(*keys, "y", "samples", F.col("lvl").alias("lvl_x"), F.col("lvl").alias("lvl_y"))


def rip_pyramid(rows: DataFrame, keys: list[str], width: int, height: int) -> DataFrame:
    """All cells (lvl_x, lvl_y): halves along x at full height, which is no shuffle, then along y for all lvl_x at once."""
    own = rows.select(*keys, F.col("y").cast("int").alias("y"), F.col("samples").cast("array<float>").alias("samples"))
    across = own.withColumn("lvl_x", F.lit(0))
    for level in range(1, level_count(width)):
        own = own.withColumn("samples", _halved(level_extent(width, level - 1)))
        across = across.union(own.withColumn("lvl_x", F.lit(level)))
    across = across.select(*keys, "lvl_x", "y", "samples")
    above = _levels_above(across, [*keys, "lvl_x"], height, level_count(height), lambda up, low, _: np.float32(0.5) * (up + low))
    out = across.select(*keys, "lvl_x", F.lit(0).alias("lvl"), "y", "samples")
    out = out if above is None else out.union(above)
    return out.select(*keys, "lvl_x", "y", "samples", F.col("lvl").alias("lvl_y"))


def _halved(width: int) -> Column:
    columns = F.sequence(F.lit(0), F.lit(level_extent(width, 1) - 1))

    def halves(samples: Column) -> Column:
        return F.transform(columns, lambda x: _f(0.5) * (F.get(samples, 2 * x) + F.get(samples, F.least(2 * x + 1, F.lit(width - 1)))))

    return bound(F.col("samples"), halves)  # the levels before are worked out once, though Catalyst merges the projections


def _beside(extent: int, after: int) -> tuple[np.ndarray, np.ndarray]:
    """Places 2 i and 2 i + 1 of a level for each i of the next one, the latter clamped to the level."""
    first = 2 * np.arange(after)
    return first, np.minimum(first + 1, extent - 1)


def mip_planes(planes: np.ndarray) -> list[np.ndarray]:
    """The levels of mip_pyramid() of many planes (n, height, width) float32 at once."""
    _, height, width = planes.shape
    out = [planes]
    for lvl in range(1, level_count(max(width, height))):
        above, (x, right), (y, low) = out[-1], _beside(level_extent(width, lvl - 1), level_extent(width, lvl)), _beside(level_extent(height, lvl - 1), level_extent(height, lvl))
        up, down = above[:, y], above[:, low]
        out.append(np.float32(0.25) * (((up[:, :, x] + up[:, :, right]) + down[:, :, x]) + down[:, :, right]))
    return out


def rip_planes(planes: np.ndarray) -> dict[tuple[int, int], np.ndarray]:
    """The cells (lvl_x, lvl_y) of rip_pyramid() of many planes (n, height, width) float32 at once."""
    _, height, width = planes.shape
    out = {}
    for lx in range(level_count(width)):
        if lx:
            x, right = _beside(level_extent(width, lx - 1), level_extent(width, lx))
            planes = np.float32(0.5) * (planes[:, :, x] + planes[:, :, right])
        out[lx, 0] = planes
        for ly in range(1, level_count(height)):
            y, low = _beside(level_extent(height, ly - 1), level_extent(height, ly))
            above = out[lx, ly - 1]
            out[lx, ly] = np.float32(0.5) * (above[:, y] + above[:, low])
    return out


def as_pixels(rows: DataFrame) -> DataFrame:
    """Rows of samples as (..., y, x, value)."""
    rest = [c for c in rows.columns if c != "samples"]
    return rows.select(*rest, F.posexplode("samples").alias("x", "value"))
