import numpy as np
import pytest
from pyspark.sql import functions as F

from prismframe import catalog_files
from prismframe.functions import codecs, geometry
from prismframe.functions.codecs import InvalidData, Unsupported
from prismframe.sources import datasource, exr, layout, planning
from prismframe.sources.layout import Part
from tests.test_exr import ROWS, SPECS, _file, ch, sample_rows

#: A file for each reader, and what it refuses: readers by the specs that they take.
TAKES = {
    "single": ("scan_ZIP", "subsampled", "tiled_RLE", "mip", "rip_up"), "tiled_multilevel": ("tiled_RLE", "mip", "rip_up"), "multipart": ("parts",), "multipart_tiled": ("tile_parts",),
    "multipart_tiled_multilevel": ("tile_parts", "level_parts"), "deep_scanline": ("deep_scan",), "deep_multipart": ("deep_parts",), "deep_tiled": ("deep_tile",), "multipart_deep_tiled": ("deep_tile_parts",),
    "deep_tiled_mipmap": ("deep_mip",), "deep_tiled_ripmap": ("deep_rip",), "multipart_deep_tiled_mipmap": ("deep_mip_parts",), "multipart_deep_tiled_ripmap": ("deep_rip_parts",),
    "mixed": ("mixed", "parts", "tile_parts", "level_parts", "deep_parts", "deep_tile_parts", "deep_mip_parts", "deep_rip_parts"),
}


def _deep(mode=0, up=False, name="", kind="deeptile", codec="RLE"):
    return Part(9, 6, ch("A", "Z"), kind=kind, tile=(4, 4), mode=mode, up=up, codec=codec, name=name)


MORE = {
    "parts": [Part(8, 20, ch("R"), name="a"), Part(5, 3, ch("Y", kind="UINT"), codec="NONE", name="b")],
    "tile_parts": [Part(9, 6, ch("Y"), kind="tiledimage", tile=(4, 4), name=n) for n in "ab"],
    "level_parts": [Part(9, 6, ch("Y"), kind="tiledimage", tile=(4, 4), mode=m, up=m == 2, name=n) for m, n in ((1, "a"), (2, "b"))],
    "deep_parts": [_deep(name=n, kind="deepscanline") for n in "ab"], "deep_tile_parts": [_deep(name=n) for n in "ab"], "deep_mip": [_deep(1)], "deep_rip": [_deep(2, codec="NONE")],
    "deep_mip_parts": [_deep(1, name=n) for n in "ab"], "deep_rip_parts": [_deep(2, name=n) for n in "ab"], "deep_up": [_deep(0, True)], "deep_mip_up": [_deep(1, True)], "deep_rip_up_parts": [_deep(2, True, "a")],
}
ALL = {k: v for k, v in SPECS.items() if k in ("scan_ZIP", "subsampled", "tiled_RLE", "mip", "rip_up", "deep_scan", "deep_tile", "mixed")} | MORE


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("files")
    for name, spec in ALL.items():
        (root / f"{name}.exr").write_bytes(_file(spec))
    return root


@pytest.mark.parametrize("entry", exr.ENTRIES)
def test_each_reader_takes_its_kinds_and_refuses_others(entry):
    for name, spec in ALL.items():
        version, headers, _ = layout.decode_header(_file(spec))
        told = [layout.part_of(version, h)[0] for h in headers]
        if entry == "any" or name in TAKES[entry]:
            exr._guard(version, told, entry)
        elif entry != "mixed" or name != "deep_rip_up_parts":  # the mixed reader takes levels that are rounded up
            with pytest.raises(Unsupported):
                exr._guard(version, told, entry)


def test_ranges_read_what_whole_files_give(spark, folder):
    whole = exr.chunks(exr.files(spark, str(folder)))
    keys = ("part_no", "y", "tx", "ty", "lvl_x", "lvl_y", "table_size", "unpacked_size", "payload")
    name = F.regexp_extract("path", r"(\w+)\.exr", 1).alias("name")
    want = sorted(tuple(x) for x in whole.select(name, *keys).collect())
    for split_bytes in (1, 300, 1 << 20):
        got = exr.read_chunks(spark, str(folder), split_bytes=split_bytes)
        assert sorted(tuple(x) for x in got.select(name, *keys).collect()) == want
    assert sorted(tuple(x) for x in exr.chunks(exr.files(spark, str(folder)), spread=5).select(name, *keys).collect()) == want


def test_one_file_is_read_by_many_tasks(spark, tmp_path):
    spec = [Part(64, 400, ch("Y", kind="FLOAT"), codec="NONE")]
    (tmp_path / "x.exr").write_bytes(_file(spec))
    packed = exr.read_chunks(spark, str(tmp_path / "x.exr"), split_bytes=2000, tasks=6)
    tasks = packed.groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert len(tasks) > 3 and sum(x["count"] for x in tasks) == 400
    datasource.register(spark)
    assert spark.read.format("exr").option("split_bytes", "2000").load(str(tmp_path)).rdd.getNumPartitions() > 20


def test_format_options(spark, folder):
    datasource.register(spark)
    read = lambda **o: spark.read.format("exr").options(**o).load(str(folder / "mixed.exr"))
    assert {x["channel"] for x in read(channels="Z, none").collect()} == {"Z"}
    assert {(x["lvl_x"], x["lvl_y"]) for x in read(level="1,1", rows="chunks").collect()} == {(1, 1)}
    assert read(rows="attributes").where("name = 'name'").count() == 5
    every = spark.read.format("exr").load(str(folder))
    assert every.count() == exr.lines(exr.read_chunks(spark, str(folder))).count()
    single = spark.read.format("exr").option("entry", "single").load(str(folder / "mip.exr"))
    assert {(x["lvl_x"], x["lvl_y"]) for x in single.collect()} == {(0, 0)}
    for options in ({"entry": "deep_tiled"}, {"rows": "nothing"}):
        with pytest.raises(Exception, match="does not read|rows must be"):
            read(**options).count()


def test_format_stream(spark, folder, tmp_path):
    datasource.register(spark)
    run = spark.readStream.format("exr").load(str(folder / "scan_ZIP.exr")).writeStream.format("parquet").option("path", str(tmp_path / "rows")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "rows")).count() == exr.lines(exr.read_chunks(spark, str(folder / "scan_ZIP.exr"))).count()


def test_headers_are_read_without_pixels(spark, folder):
    assert exr.heads(spark, str(folder)).select(F.max(F.octet_length("content"))).first()[0] < 4000
    assert exr.parts(exr.heads(spark, str(folder))).count() == sum(len(s) for s in ALL.values())


@pytest.mark.parametrize("name", ["subsampled", "mixed", "deep_tile"])
def test_written_files_are_those_of_encode(spark, tmp_path, name):
    spec = ALL[name]
    rows = spark.createDataFrame(sample_rows(spec) + sample_rows(spec, "b"), ROWS)
    told = exr.write(rows, spec, str(tmp_path)).collect()
    assert {x["path"]: x["bytes"] for x in told} == {p: (tmp_path / f"{p}.exr").stat().st_size for p in "ab"}
    want = {x["path"]: bytes(x["content"]) for x in exr.encode(rows, spec).collect()}
    assert {p: (tmp_path / f"{p}.exr").read_bytes() for p in "ab"} == want
    with pytest.raises(Exception, match="chunks for|no samples"):
        exr.write(rows.where("y > 0 OR part_no > 0"), [Part(p.width, p.height, p.channels, p.kind, "NONE", p.name, p.tile, p.mode) for p in spec], str(tmp_path / "cut")).collect()


def test_rows_of_a_decreasing_file_lie_from_last_to_first():
    spec = [Part(4, 5, ch("Y"), codec="NONE", line_order=1)]
    data = _file(spec)
    plan = layout.plan_of(data, len(data))
    read = lambda at, n: data[at : at + n]
    assert planning.index_of(plan, read, len(data)).number.tolist() == [4, 3, 2, 1, 0]
    assert [r["y"] for r in layout.walk_chunks(data)] == [0, 1, 2, 3, 4]


def test_extra_attributes_replace_and_windows(spark):
    part = Part(2, 1, ch("Y"), aspect=2.0, extra=[("pixelAspectRatio", "float", 3.0), ("owner", "string", "me")])
    made = exr.encode(spark.createDataFrame(sample_rows([part]), ROWS), [part])
    got = [(x["name"], x["floats"]) for x in exr.attributes(made).collect()]
    assert [v for k, v in got if k == "pixelAspectRatio"] == [[3.0]] and len({k for k, _ in got}) == len(got)


def test_damaged_offset_tables_are_refused(spark, tmp_path):
    data = bytearray(_file(ALL["scan_ZIP"]))
    at = layout.plan_of(bytes(data), len(data)).at
    for value in (0, 2**63, len(data) - 3):
        data[at : at + 8] = value.to_bytes(8, "little")
        (tmp_path / "x.exr").write_bytes(data)
        with pytest.raises(Exception, match="InvalidData|outside|cut off|chunk"):
            exr.read_chunks(spark, str(tmp_path)).count()


def test_interleaved_pixels_must_be_whole(spark):
    rows = spark.createDataFrame([("a", 0, [float(i) for i in range(8)]), ("a", 1, [])], "path string, y int, samples array<float>")
    got = {(x["channel"], x["y"]): x["samples"] for x in exr.rgba_planes(rows).collect()}
    assert got["R", 0] == [0.0, 4.0] and got["A", 0] == [3.0, 7.0] and got["G", 1] == []
    with pytest.raises(Exception, match="whole pixels"):
        exr.rgba_planes(rows.withColumn("samples", F.slice("samples", 1, 7))).collect()


def test_b44_block_with_a_shift():
    # keys 64 apart need a shift of 2: differences in units of 4 round to the nearest, ties to even
    code = np.array([0x3C00 + d for d in (0, 100, 3, 97, 50, 6, 2, 1, 64, 65, 66, 67, 31, 32, 33, 99)], np.uint16).reshape(4, 4)
    from prismframe.functions import numeric

    data = codecs.b44_pack(numeric.from_half(code))
    bits = int.from_bytes(data, "big")
    shift = bits >> (112 - 22) & 63
    top = 0x3C00 + 100
    d = [round((top - int(c)) / (1 << shift)) for c in code.ravel()]
    want = [top - (x << shift) for x in d]
    assert shift == 2 and bits >> 96 == 0x8000 + want[0]
    got, used = codecs.b44_unpack(data, 4, 4)
    assert used == 14 and numeric.to_half(got).ravel().tolist() == want


def test_runs_of_bytes():
    start, length, byte = codecs.runs(b"aabcccd", 2)
    assert (start.tolist(), length.tolist(), byte.tolist()) == ([0, 3], [2, 3], [97, 99])
    assert len(codecs.runs(b"")[0]) == 0 and len(codecs.runs(b"x")[0]) == 0


@pytest.mark.parametrize("mode", [geometry.MIPMAP, geometry.RIPMAP])
def test_planes_of_no_rows_have_no_levels(spark, mode):
    rows = catalog_files.flat_rows(spark, "/root/testdata/sf0.001", files=0)
    assert catalog_files._pyramid(rows, mode).count() == 0


def test_pyramid_of_another_shape_is_refused(spark):
    part = Part(8, 8, ch("Y"), kind="tiledimage", tile=(4, 4), mode=1)
    rows = sample_rows([part])
    lost = [r for r in rows if r[2] != 2]
    with pytest.raises(Exception, match="missing|too many"):
        exr.encode(spark.createDataFrame(lost, ROWS), [part]).collect()
    with pytest.raises(Exception, match="outside part|another length"):
        exr.encode(spark.createDataFrame([(*r[:2], 5, 5, *r[4:]) for r in rows], ROWS), [part]).collect()


def test_header_bytes_of_a_cut_file():
    data = _file(ALL["mixed"])
    reads = []

    def read(at, n):
        reads.append(n)
        return data[at : at + n]

    assert layout.plan_by_ranges(read, len(data), 16).counts == layout.plan_of(data, len(data)).counts
    assert len(reads) > 3
    with pytest.raises(InvalidData):
        layout.plan_by_ranges(lambda at, n: data[at : at + n][:40], 40, 16)
