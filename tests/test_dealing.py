"""Small files make work that their bytes do not tell, so they are dealt to tasks by number."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from prismframe.functions import codecs
from prismframe.operators import pyramid
from prismframe.sources import datasource, exr
from prismframe.sources.layout import Channel, Part


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    samples = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (F.col("id") + i).cast("float"))
    rows = spark.range(64).select(
        F.col("id").cast("string").alias("path"), F.lit(0).alias("part_no"), F.lit(0).alias("lvl_x"), F.lit(0).alias("lvl_y"), F.lit("Y").alias("channel"), F.lit(0).alias("y"), samples.alias("samples"), F.lit(None).cast("array<int>").alias("counts"),
    )
    folder = f"file://{tmp_path_factory.mktemp('dealt')}"
    exr.write(rows, [Part(4, 1, [Channel("Y", "FLOAT")], codec="NONE")], folder).collect()
    return folder


def test_small_files_are_read_by_many_tasks(spark, folder):
    lines = exr.lines(exr.read_chunks(spark, folder))
    assert lines.select(F.spark_partition_id()).distinct().count() > 4


def test_lines_decoded_where_they_are_read_are_the_same(spark, folder):
    plain, fused = (sorted(df.select("path", "y", "samples").collect()) for df in (exr.lines(exr.read_chunks(spark, folder)), exr.read_lines(spark, folder)))
    assert len(plain) == 64 and plain == fused


def test_many_small_ranges_make_few_partitions():
    files = [(f"f{i}", 40_000) for i in range(2_000)]
    found = datasource.planned(files, 4_000)
    assert len(found) <= 2 * datasource.TASKS
    pieces = [p for r in found for p in r.pieces]
    assert pieces == [(f, n, a, a + 4_000) for f, n in files for a in range(0, n, 4_000)]


def test_few_small_ranges_stay_apart():
    assert [len(r.pieces) for r in datasource.planned([("f", 40_000)], 4_000)] == [1] * 10


def test_pyramids_are_made_by_many_tasks(spark):
    rows = spark.range(32).select(F.col("id").alias("k"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("y"), F.array(*[F.lit(1.0).cast("float")] * 4).alias("samples"))
    made = pyramid.strips(rows, ["k"], 4, 0, lambda up, low, _: (up + low) / 2)
    assert made.select(F.spark_partition_id()).distinct().count() > 4


def test_small_files_are_put_together_and_cut_by_many_tasks(spark):
    samples = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (F.col("id") + i).cast("float"))
    rows = spark.range(64).select(
        F.col("id").cast("string").alias("path"), F.lit(0).alias("part_no"), F.lit(0).alias("lvl_x"), F.lit(0).alias("lvl_y"), F.lit("Y").alias("channel"), F.lit(0).alias("y"), samples.alias("samples"), F.lit(None).cast("array<int>").alias("counts"),
    )
    made = exr.encode(rows, [Part(4, 1, [Channel("Y", "FLOAT")], codec="NONE")])
    assert made.select(F.spark_partition_id()).distinct().count() > 4
    plain, fused = (sorted(df.select("path", "y", "samples").collect()) for df in (exr.lines(exr.chunks(made)), exr.lines_of(made)))
    assert len(plain) == 64 and plain == fused


def test_values_of_bytes_are_made_one_at_a_time():
    x = pa.array([b"abc", None, b"", b"aab" * 50], pa.binary())[0:]
    seen = []
    got = codecs.mapped(lambda v: seen.append(v) or codecs.predict(v), x)
    assert got.to_pylist() == [codecs.predict(b"abc"), None, b"", codecs.predict(b"aab" * 50)] and len(seen) == 3
    assert codecs.mapped(codecs.unpredict, got[1:]).to_pylist() == [None, b"", b"aab" * 50]
    assert codecs.mapped(codecs.predict, pa.array([], pa.binary())).to_pylist() == []
