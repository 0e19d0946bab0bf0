"""Window and grouping operators of the file layout on tables: offsets, deep counts, blocks and names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WRAP = 4_294_967_296


def running_offsets(rows: DataFrame, keys: list[str], order: str, value: str, band: int = 1024, depth: int = 3) -> DataFrame:
    """Adds offset: the sum of value over the rows before in order (whole numbers from 0) within keys, null keys included.

    A group is cut into bands of the order, the bands' sums into bands again, and so on to depth. So no task holds more
    than band rows of a group up to band ** depth rows; beyond that the last sums grow.
    """
    at, total, base = f"_band{depth}", f"_sum{depth}", f"_base{depth}"
    banded = rows.withColumn(at, F.floor(F.col(order) / band))
    sums = banded.groupBy(*keys, at).agg(F.sum(value).alias(total))
    if depth > 1:
        sums = running_offsets(sums, keys, at, total, band, depth - 1).withColumnRenamed("offset", base)
    else:
        before = Window.partitionBy(*keys).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.withColumn(base, F.coalesce(F.sum(total).over(before), F.lit(0)))
    inside = Window.partitionBy(*keys, at).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    own = banded.withColumn("_own", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    a, b = own.alias("a"), sums.alias("b")
    same = F.lit(True)
    for k in [*keys, at]:
        same &= F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    return a.join(b, same).select(*[f"a.{c}" for c in rows.columns], (F.col(f"b.{base}") + F.col("a._own")).alias("offset"))


def inclusive_counts(pixels: DataFrame, row: list[str], x: str = "x", n: str = "n") -> DataFrame:
    """Adds cumulative: counts up to and with each pixel, from the start of its row."""
    w = Window.partitionBy(*row).orderBy(x).rowsBetween(Window.unboundedPreceding, 0)
    return pixels.withColumn("cumulative", F.sum(n).over(w))


def counts_of(pixels: DataFrame, row: list[str], x: str = "x") -> DataFrame:
    """Adds n, the inverse of inclusive_counts; a cumulative count that falls is an error."""
    step = F.col("cumulative") - F.coalesce(F.lag("cumulative").over(Window.partitionBy(*row).orderBy(x)), F.lit(0))
    return pixels.withColumn("n", F.when(F.assert_true(step >= 0).isNull(), step))


def deltas(rows: DataFrame, line: list[str], x: str, code: str) -> DataFrame:
    """Adds delta: the difference to the code before in the line, modulo 2^32."""
    before = F.coalesce(F.lag(code).over(Window.partitionBy(*line).orderBy(x)), F.lit(0))
    return rows.withColumn("delta", F.pmod(F.col(code) - before, F.lit(WRAP)))


def prefix_codes(rows: DataFrame, line: list[str], x: str, delta: str = "delta") -> DataFrame:
    """Adds restored, the inverse of deltas."""
    w = Window.partitionBy(*line).orderBy(x).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("restored", F.pmod(F.sum(delta).over(w), F.lit(WRAP)))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once a row even where use names it inside a lambda."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def blocks(pixels: DataFrame, keys: list[str], value: str, size: int = 4) -> DataFrame:
    """keys, by, bx, low, high, flat of each block of size x size pixels (y, x)."""
    at = [F.floor(F.col(c) / size).cast("int").alias(f"b{c}") for c in "yx"]
    found = pixels.groupBy(*keys, *at).agg(F.min(value).alias("low"), F.max(value).alias("high"))
    return found.withColumn("flat", F.col("low") == F.col("high"))


def repeated_names(parts: DataFrame, name: str) -> DataFrame:
    """Names of parts that are empty or not unique, with their number."""
    return parts.groupBy(name).agg(F.count(F.lit(1)).alias("parts")).where((F.col("parts") > 1) | (F.coalesce(F.col(name), F.lit("")) == ""))


def timecode(hours: Column, minutes: Column, seconds: Column, frames: Column) -> Column:
    """The packed binary-coded decimal word of a time."""
    pair = lambda v: F.floor(v / 10) * 16 + F.pmod(v, F.lit(10))
    return (pair(hours) * 16777216 + pair(minutes) * 65536 + pair(seconds) * 256 + pair(frames)).cast("long")


def timecode_field(word: Column, shift: int, tens: int) -> Column:
    """A two-digit field of a time word: shift 0 frames, 8 seconds, 16 minutes, 24 hours; tens masks its first digit."""
    return (F.shiftright(word, shift + 4).bitwiseAND(tens) * 10 + F.shiftright(word, shift).bitwiseAND(15)).cast("int")
