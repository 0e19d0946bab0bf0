"""What several operators share: lineage cuts, tables, splits and batch slicing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Code points that separate words: space and 0x09 to 0x0D. Everything else belongs to a word.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir; a local one only on a local master without it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='checkpoints-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


#: Paths of settled tables by open scratch block, innermost last.
_SCRATCH: list[list[str]] = []
_DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _path(spark: SparkSession, place: str) -> tuple:
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def settle(df: DataFrame, level: int = 0) -> DataFrame:
    """Write df to the shared folder and read it back, which cuts its lineage.

    The shuffles of the write go with it. The files go with the scratch block (the one `level` further out), or else when
    the JVM ends.
    """
    spark = df.sparkSession
    place = f"{shared_dir(spark)}/settled/{uuid.uuid4().hex}"
    schema, before = df.schema, spark.conf.get(_DROP_SHUFFLES, "false")
    spark.conf.set(_DROP_SHUFFLES, "true")
    try:
        df.write.parquet(place)
    finally:
        spark.conf.set(_DROP_SHUFFLES, before)
    if len(_SCRATCH) > level:
        _SCRATCH[-1 - level].append(place)
    else:
        system, path = _path(spark, place)
        system.deleteOnExit(path)
    return spark.read.schema(schema).parquet(place)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """A block whose settled tables are deleted at its end. It gives a settle() for results that outlive it."""
    _SCRATCH.append([])
    try:
        yield lambda df: settle(df, 1)
    finally:
        for place in _SCRATCH.pop():
            system, path = _path(spark, place)
            system.delete(path, True)


#: Bitmaps of row keys are broadcast up to this many bytes together.
MOST_BITMAP_BYTES = 32 << 20
_BITMAP_BYTES = 4096  # of Spark's bitmap functions


def counted(rows: DataFrame, key: str, counts: DataFrame, most: int = 1, name: str = "_count") -> DataFrame:
    """Rows whose key (a long, unique) is in counts (key, n) with n from 1 to most; n is added as column `name`.

    Wide rows stay where they are: counts travels as bitmaps, a bit a key and count, broadcast if they take at most
    MOST_BITMAP_BYTES (about 250 million keys), and joined by key beyond that.
    """
    position = F.bitmap_bit_position("_of")
    own = counts.toDF("_of", "_n")
    layers = [F.bitmap_construct_agg(F.when(F.col("_n") >= i, position)).alias(f"_bits{i}") for i in range(1, most + 1)]
    bitmaps = settle(own.groupBy(F.bitmap_bucket_number("_of").alias("_bucket")).agg(*layers))
    if bitmaps.count() * most * _BITMAP_BYTES > MOST_BITMAP_BYTES:
        return rows.join(own.withColumnRenamed("_n", name), F.col(key) == F.col("_of")).drop("_of")
    at = F.bitmap_bit_position(key)
    byte, bit = (F.floor(at / 8) + 1).cast("int"), F.pmod(at, F.lit(8)).cast("int")
    read = lambda bits: F.getbit(F.conv(F.hex(F.substring(bits, byte, F.lit(1))), 16, 10).cast("int"), bit).cast("int")
    n = sum((read(f"_bits{i}") for i in range(2, most + 1)), read("_bits1"))
    met = rows.join(F.broadcast(bitmaps), F.bitmap_bucket_number(key) == F.col("_bucket"))
    return met.select(*rows.columns, n.alias(name)).where(F.col(name) > 0)


def marked(rows: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """Rows whose key is among the longs of keys, its only column; see counted."""
    return counted(rows, key, keys.select(keys.columns[0], F.lit(1))).drop("_count")


#: At most this many keys of a skewed join are broadcast: those with more than 1 / MOST_HOT of the rows, and HOT_ROWS.
MOST_HOT, HOT_ROWS = 20_000, 4_000


def join_skewed(rows: DataFrame, table: DataFrame, keys: dict[str, str], size: str, total: int) -> DataFrame:
    """Inner join of rows with table, which has one row for each key; keys maps columns of rows to those of table.

    size: the column of table that tells how many of the total rows have the key. Keys with more than total / MOST_HOT
    of them, at most MOST_HOT keys, are broadcast, so that no task holds their rows; the others meet in a shuffle.
    """
    same = [F.col(a) == F.col(b) for a, b in keys.items()]
    most = max(HOT_ROWS, total // MOST_HOT)
    if total <= most:
        return rows.join(table, same)
    hot, cold = table.where(F.col(size) > most), table.where(F.col(size) <= most)
    rest = rows.join(F.broadcast(hot.select(*keys.values())), same, "left_anti")
    return rows.join(F.broadcast(hot), same).union(rest.join(cold, same))


_HELD: dict[object, object] = {}


def held(key: object, make: Callable[[], object]) -> object:
    """A worker process's table of words or the like. It holds one at a time, so operators do not pile theirs up."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make()
    return _HELD[key]


def held_out(doc_id: Column, divisor: int, remainder: int) -> Column:
    """Whether crc32 of doc_id as text leaves this remainder; a null doc_id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % divisor == remainder


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Cut record batches into runs of rows whose text has about limit bytes (a longer single row stays whole)."""
    for batch in batches:
        sizes = batch.column(column)
        sizes = pc.fill_null(pc.binary_length(sizes), 0).to_pylist()
        start = total = 0
        for i, n in enumerate(sizes):
            if total and total + n > limit:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        if start < len(sizes):
            yield batch.slice(start)
