import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from prismframe.functions.geometry import level_count, level_extent
from prismframe.operators import pyramid
from prismframe.sources import datasource, exr
from prismframe.sources.layout import Part
from tests.test_exr import _file, ch


def naive_mip(plane):
    """Levels by the definition, pixel by pixel, in single precision."""
    height, width = plane.shape
    out = [plane]
    for lvl in range(1, level_count(max(width, height))):
        below, h, w = out[-1], level_extent(height, lvl), level_extent(width, lvl)
        at = lambda y, x: below[min(y, below.shape[0] - 1), min(x, below.shape[1] - 1)]  # noqa: B023, E731  used at once
        out.append(np.array([[np.float32(0.25) * (((at(2 * y, 2 * x) + at(2 * y, 2 * x + 1)) + at(2 * y + 1, 2 * x)) + at(2 * y + 1, 2 * x + 1)) for x in range(w)] for y in range(h)], np.float32))
    return out


def plane_rows(spark, planes):
    rows = [(key, y, row.tolist()) for key, plane in planes.items() for y, row in enumerate(plane)]
    return spark.createDataFrame(rows, "k string, y int, samples array<float>").repartition(4)


@pytest.mark.parametrize("strip", [1, 2, 6])
@pytest.mark.parametrize("height, width", [(1, 1), (1, 9), (7, 1), (13, 6), (64, 3), (65, 5), (130, 4)])
def test_strips_match_the_box_filter(spark, monkeypatch, strip, height, width):
    monkeypatch.setattr(pyramid, "STRIP", strip)
    r = np.random.default_rng(height + width)
    planes = {k: r.normal(size=(height, width)).astype(np.float32) for k in ("a", None)}
    made = pyramid.mip_pyramid(plane_rows(spark, planes), ["k"], width, height).collect()
    for k, plane in planes.items():
        levels = naive_mip(plane)
        got = {(x["lvl_x"], x["lvl_y"], x["y"]): x["samples"] for x in made if x["k"] == k}
        assert got == {(i, i, y): row.tolist() for i, level in enumerate(levels) for y, row in enumerate(level)}


def test_rip_levels_are_averages_of_pairs(spark, monkeypatch):
    monkeypatch.setattr(pyramid, "STRIP", 2)
    plane = np.random.default_rng(1).normal(size=(11, 6)).astype(np.float32)
    got = {(x["lvl_x"], x["lvl_y"], x["y"]): x["samples"] for x in pyramid.rip_pyramid(plane_rows(spark, {"a": plane}), ["k"], 6, 11).collect()}
    half = lambda v: np.stack([np.float32(0.5) * (v[2 * i] + v[min(2 * i + 1, len(v) - 1)]) for i in range(level_extent(len(v), 1))])
    across = [plane, half(plane.T).T, half(half(plane.T)).T]
    want = {}
    for lx, own in enumerate(across):
        for ly in range(level_count(11)):
            want |= {(lx, ly, y): row.tolist() for y, row in enumerate(own)}
            own = half(own)
    assert got == want


def test_one_written_table_and_one_shuffle_for_a_strip_of_levels(spark, monkeypatch):
    tables, plans = [], []
    real = pyramid.cut

    def counted(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString().count("Exchange"))
        tables.append(1)
        return real(df)

    monkeypatch.setattr(pyramid, "cut", counted)
    plane = np.zeros((256, 4), np.float32)
    rows = plane_rows(spark, {"a": plane}).coalesce(1)
    base = rows._jdf.queryExecution().executedPlan().toString().count("Exchange")
    made = pyramid.mip_pyramid(rows, ["k"], 4, 256)
    assert made.count() == sum(level_extent(256, k) for k in range(9))
    assert len(tables) == 2 and plans == [base + 1, 1]  # eight levels above the first: six, then two


# the file stream


def test_offsets_stay_small_and_batches_stay_readable(tmp_path):
    log = datasource.FileLog(str(tmp_path / "log"))
    files = [(f"file:///x/{i:04d}.exr", i) for i in range(1000)]
    for i in range(0, 1000, 8):
        assert log.add(files[i : i + 8]) == i // 8 + 1
    assert log.last() == 125 and log.seen() == set(files)
    assert log.files(120, 125) == files[960:] and sorted(log.files(0, 125)) == files
    assert len(json.dumps({"batch": log.last()})) < 20
    assert len(list((tmp_path / "log").iterdir())) < datasource.FileLog.KEPT + datasource.FileLog.COMPACT + 2
    assert datasource.FileLog(str(tmp_path / "log")).seen() == set(files)


def test_a_stream_that_is_started_again_reads_new_files_only(spark, tmp_path):
    datasource.register(spark)
    spec = [Part(6, 5, ch("Y"), codec="NONE")]
    (tmp_path / "in").mkdir()

    def run():
        lines = spark.readStream.format("exr").load(str(tmp_path / "in"))
        q = lines.writeStream.format("parquet").option("path", str(tmp_path / "rows")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        found = spark.read.schema(exr.LINES).parquet(str(tmp_path / "rows"))
        return sorted(r["name"] for r in found.select(F.regexp_extract("path", r"(\w+)\.exr", 1).alias("name")).collect())

    sizes = []
    for i, names in enumerate((["a"], ["b", "c"], [])):
        for n in names:
            (tmp_path / f"in/{n}.exr").write_bytes(_file(spec))
        assert run() == sorted(["a", "b", "c"][: 1 + 2 * (i > 0)] * 5)
        sizes += [p.stat().st_size for p in (tmp_path / "state/offsets").iterdir() if p.name.isdigit()]
    assert max(sizes) - min(sizes) < 20


# the table function


def test_table_function_of_files_and_nulls(spark):
    datasource.register(spark)
    rows = spark.createDataFrame([("a", _file([Part(6, 5, ch("Y"), codec="NONE")])), ("b", None)], "path string, content binary")
    got = spark.sql("SELECT * FROM exr_lines(TABLE(SELECT path, content FROM {rows}))", rows=rows).collect()
    assert [(r["path"], r["y"], len(r["samples"])) for r in sorted(got, key=lambda r: r["y"])] == [("a", y, 6) for y in range(5)]
