"""Sample arithmetic: half, 24-bit float, unsigned and preview codes, as Column expressions on codes and bits.

Spark cannot reinterpret a FLOAT's bits in SQL, so float_bits and bits_float do that with Arrow batches; every rule on the
bits themselves is a Column expression. Wrapping arithmetic is done in BIGINT, since ANSI mode raises on overflow.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TWO_32 = 4_294_967_296


def _view(x: pa.Array, kind: type) -> np.ndarray:
    return x.fill_null(0).to_numpy(zero_copy_only=False).view(kind)


def _masked(values: np.ndarray, kind: pa.DataType, like: pa.Array) -> pa.Array:
    return pa.array(values, kind, mask=like.is_null().to_numpy(zero_copy_only=False))


@F.arrow_udf(T.LongType())
def float_bits(x: pa.Array) -> pa.Array:
    """The 32 bits of a FLOAT as a number from 0 to 2^32 - 1."""
    return _masked(_view(x.cast(pa.float32()), np.uint32).astype(np.int64), pa.int64(), x)


@F.arrow_udf(T.FloatType())
def bits_float(x: pa.Array) -> pa.Array:
    """The FLOAT with the low 32 bits of a BIGINT."""
    return _masked(_view(x, np.int64).astype(np.uint32).view(np.float32), pa.float32(), x)


def shr(x: Column, n: int) -> Column:
    return F.shiftright(x, n)


def round_shift(x: Column, shift: Column) -> Column:
    """x / 2^shift for x >= 0, to the nearest integer, ties to even; shift 0 leaves x."""
    unit = F.pow(F.lit(2.0), shift).cast("long")
    half, rest = (unit / 2).cast("long"), F.pmod(x, unit)
    down = ((x - rest) / unit).cast("long")
    up = (rest > half) | ((rest == half) & (F.pmod(down, F.lit(2)) == 1))
    return F.when(shift == 0, x).otherwise(down + F.when(up, 1).otherwise(0))


def half_code(bits: Column) -> Column:
    """The binary16 code of float bits: nearest, ties to even; too large gives infinity; under 2^-24 a signed zero."""
    sign = shr(bits, 16).bitwiseAND(0x8000)
    mantissa, exponent = bits.bitwiseAND(0x7FFFFF), shr(bits, 23).bitwiseAND(0xFF) - 127
    special = F.when(mantissa == 0, F.lit(0x7C00)).otherwise(F.greatest(shr(mantissa, 13), F.lit(1)) + 0x7C00)
    normal = round_shift((exponent + 15) * 0x800000 + mantissa, F.lit(13))  # a carry goes into the exponent
    small = round_shift(mantissa + 0x800000, F.lit(-1) - exponent)
    code = F.when(exponent == 128, special).when(exponent < -24, 0).when(exponent < -14, small).otherwise(F.least(normal, F.lit(0x7C00)))
    return sign + code


def half_bits(code: Column) -> Column:
    """Float bits of a binary16 code, exactly; a NaN keeps its payload."""
    sign, exponent, mantissa = shr(code, 15).bitwiseAND(1) * 0x80000000, shr(code, 10).bitwiseAND(31), code.bitwiseAND(0x3FF)
    top = F.floor(F.log2(F.greatest(mantissa, F.lit(1)).cast("double"))).cast("long")  # exact for the powers of two up to 512
    small = (top + 103) * 0x800000 + (mantissa * F.pow(F.lit(2.0), 23 - top)).cast("long") - 0x800000
    value = F.when(exponent == 31, 0x7F800000 + mantissa * 8192).when(exponent > 0, (exponent + 112) * 0x800000 + mantissa * 8192).when(mantissa > 0, small)
    return sign + F.coalesce(value, F.lit(0))


def pxr24_code(bits: Column) -> Column:
    """24-bit float code: finite values round up at the first dropped bit, or are cut where that would overflow.

    Infinity and NaN lose their sign; a NaN keeps at least one mantissa bit.
    """
    sign, rest, mantissa = bits.bitwiseAND(0x80000000), bits.bitwiseAND(0x7FFFFFFF), bits.bitwiseAND(0x7FFFFF)
    rounded = shr(rest + bits.bitwiseAND(0x80), 8)
    finite = shr(sign, 8) + F.when(rounded >= 0x7F8000, shr(rest, 8)).otherwise(rounded)
    special = F.when(mantissa == 0, F.lit(0x7F8000)).otherwise(0x7F8000 + F.greatest(shr(mantissa, 8), F.lit(1)))
    return F.when(bits.bitwiseAND(0x7F800000) == 0x7F800000, special).otherwise(finite)


def pxr24_bits(code: Column) -> Column:
    return code.bitwiseAND(0xFFFFFF) * 256


def uint_quantise(v: Column) -> Column:
    """A FLOAT as an unsigned 32-bit number in BIGINT: NaN and negatives are 0, too large is the most, else v + 0.5 cut."""
    v = v.cast("float")
    return F.when(F.isnan(v) | (v < 0), F.lit(0)).when(v >= float(TWO_32), F.lit(TWO_32 - 1)).otherwise((v + F.lit(0.5).cast("float")).cast("long"))


def uint_widen(u: Column) -> Column:
    return u.cast("float")


def preview_quantise(v: Column) -> Column:
    """A FLOAT clamped to 0 to 1 as a 16-bit number; NaN is 0."""
    f = lambda x: F.lit(x).cast("float")
    v = F.nanvl(v.cast("float"), f(0.0))
    return (F.least(F.greatest(v, f(0.0)), f(1.0)) * f(65535.0) + f(0.5)).cast("int")


def preview_dequantise(u: Column) -> Column:
    return (u.cast("float") / F.lit(65535.0).cast("float")).cast("float")


def monotone_key(code: Column) -> Column:
    """A half code as a 16-bit number in the order of values; infinity and NaN count as +0."""
    special = code.bitwiseAND(0x7C00) == 0x7C00
    return F.when(special, F.lit(0x8000)).when(code.bitwiseAND(0x8000) != 0, 0xFFFF - code).otherwise(code + 0x8000)


def key_code(key: Column) -> Column:
    return F.when(key >= 0x8000, key - 0x8000).otherwise(0xFFFF - key)


def subsampled(extent: Column, sampling: Column) -> Column:
    """Samples along an axis: extent / sampling, rounded up."""
    s = F.greatest(sampling, F.lit(1))
    return F.floor((extent + s - 1) / s).cast("long")


def box_extent(low: Column, high: Column) -> Column:
    """Pixels between inclusive bounds, from 0 to 2^32 - 1."""
    return F.least(F.greatest(high.cast("long") - low.cast("long") + 1, F.lit(0)), F.lit(TWO_32 - 1))


# the same rules on numpy arrays, for chunk bodies


def to_half(x: np.ndarray) -> np.ndarray:
    """Codes of float32 values; see half_code."""
    bits = x.astype(np.float32).view(np.uint32)
    with np.errstate(over="ignore"):
        code = x.astype(np.float32).astype(np.float16).view(np.uint16)
    small = (bits & 0x7FFFFFFF) < 0x33800000
    nan = np.isnan(x)
    out = np.where(small, (bits >> 16) & 0x8000, code)
    return np.where(nan, ((bits >> 16) & 0x8000) | 0x7C00 | np.maximum((bits >> 13) & 0x3FF, 1), out).astype(np.uint16)


def from_half(code: np.ndarray) -> np.ndarray:
    code = code.astype(np.uint32)
    value = code.astype(np.uint16).view(np.float16).astype(np.float32)
    payload = ((code & 0x8000) << 16 | 0x7F800000 | (code & 0x3FF) << 13).astype(np.uint32)
    return np.where((code & 0x7C00 == 0x7C00), payload, value.view(np.uint32)).astype(np.uint32).view(np.float32)


def to_uint(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float32)
    safe = np.where(np.isnan(x) | (x < 0), np.float32(0), np.minimum(x, np.float32(2**31)))
    big = np.where((x >= 2**31) & (x < TWO_32), x, 0).astype(np.float64)
    out = np.where(big > 0, big, (safe + np.float32(0.5)).astype(np.float64)).astype(np.int64)
    return np.where(x >= TWO_32, TWO_32 - 1, out).astype(np.uint32)


def to_pxr24(x: np.ndarray) -> np.ndarray:
    bits = x.astype(np.float32).view(np.uint32).astype(np.int64)
    rest, mantissa = bits & 0x7FFFFFFF, bits & 0x7FFFFF
    rounded = (rest + (bits & 0x80)) >> 8
    finite = ((bits & 0x80000000) >> 8) | np.where(rounded >= 0x7F8000, rest >> 8, rounded)
    special = 0x7F8000 | np.where(mantissa == 0, 0, np.maximum(mantissa >> 8, 1))
    return np.where(bits & 0x7F800000 == 0x7F800000, special, finite).astype(np.uint32)


def from_pxr24(code: np.ndarray) -> np.ndarray:
    return ((code.astype(np.uint32) & 0xFFFFFF) << 8).astype(np.uint32).view(np.float32)


def linear_relation(spark: SparkSession) -> DataFrame:
    """The tables of linear_tables() as 65,536 rows (code, forward, back), to be broadcast to codes that are looked up."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forward, back = linear_tables()
        for batch in batches:
            code = batch.column(0).to_numpy()
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(t[code].astype(np.int64)) for t in (forward, back)]], names=["code", "forward", "back"])

    return spark.range(65_536).mapInArrow(rows, "code long, forward long, back long")


def linear_tables() -> tuple[np.ndarray, np.ndarray]:
    """For each half code, half(exp(x / 8)) and half(8 ln x): the tables of perceptually linear channels.

    Infinity and NaN map to 0. Going forward, codes 0x558c to 0x7bff clamp to the largest half; going back, negative
    values map to 0 and both zeros to minus infinity.
    """
    code = np.arange(65536, dtype=np.uint32)
    x, special = from_half(code), code & 0x7C00 == 0x7C00
    with np.errstate(all="ignore"):
        forward = to_half(np.exp(x / np.float32(8)))
        back = to_half(np.where(x == 0, np.float32(-np.inf), np.float32(8) * np.log(np.where(x > 0, x, np.float32(1)))))
    forward = np.where((code >= 0x558C) & (code < 0x8000), 0x7BFF, forward)
    back = np.where(code > 0x8000, 0, back)
    return np.where(special, 0, forward).astype(np.uint16), np.where(special, 0, back).astype(np.uint16)


@F.arrow_udf(T.LongType())
def half_kernel_code(x: pa.Array) -> pa.Array:
    """to_half as a Column function."""
    return _masked(to_half(_view(x.cast(pa.float32()), np.float32)).astype(np.int64), pa.int64(), x)


@F.arrow_udf(T.FloatType())
def half_kernel_value(x: pa.Array) -> pa.Array:
    """from_half as a Column function."""
    return _masked(from_half(_view(x, np.int64)), pa.float32(), x)
