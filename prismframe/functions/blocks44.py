"""The 4 x 4 blocks of B44 as Column expressions: the search for a block's shift along the tree of differences, and its result.

A block is an array of 16 monotone keys, row by row. With shift s each key lies d steps of 2 ** s under the largest, to the
nearest, ties to even; the least s is taken whose 15 differences of d along the tree lie between -32 and 31.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.tables import bound
from .codecs import EDGES

MOST_SHIFT = 16


def steps(keys: Column, top: Column, shift: Column) -> Column:
    """d of each key: (top - key) / 2 ** shift, to the nearest, ties to even."""
    unit = F.pow(F.lit(2.0), shift).cast("long")

    def step(key: Column) -> Column:
        x = top - key
        down = F.floor(x / unit).cast("long")
        rest = 2 * (x - down * unit)
        return down + F.when((rest > unit) | ((rest == unit) & (F.pmod(down, F.lit(2)) == 1)), 1).otherwise(0)

    return F.transform(keys, step)


def fits(d: Column) -> Column:
    """Whether all differences along the tree take 6 bits."""
    edges = F.array(*[F.array(F.lit(a), F.lit(b)) for a, b in EDGES])
    return F.forall(edges, lambda e: (F.get(d, e[0]) - F.get(d, e[1])).between(-32, 31))


def shift_of(keys: Column, top: Column) -> Column:
    return F.get(F.filter(F.sequence(F.lit(0), F.lit(MOST_SHIFT)), lambda s: bound(steps(keys, top, s), fits)), F.lit(0))


def restored(keys: Column, top: Column, shift: Column) -> Column:
    """The keys that a block gives back."""
    unit = F.pow(F.lit(2.0), shift).cast("long")
    return F.transform(steps(keys, top, shift), lambda d: (top - d * unit).bitwiseAND(0xFFFF))
