import struct

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from prismframe.functions import geometry
from prismframe.functions.codecs import InvalidData, Unsupported
from prismframe.sources import datasource, exr, layout, planning
from prismframe.sources.layout import Part
from prismframe.sources.planning import Wanted
from tests.test_exr import ROWS, _file, ch, sample_rows
from tests.test_reading import ALL, TAKES

KEYS = ("part_no", "lvl_x", "lvl_y", "channel", "y", "x0")
FILES = {k: _file(v) for k, v in ALL.items()}


def plan_and_read(data):
    reads = []

    def read(at, n):
        reads.append((at, n))
        return data[at : at + n]

    return layout.plan_of(data, len(data)), read, reads


def table_at(data, k):
    """Where entry k of the offset tables stands."""
    return layout.plan_of(data, len(data)).at + 8 * k


def with_entry(data, k, value):
    at = table_at(data, k)
    return data[:at] + struct.pack("<Q", value) + data[at + 8 :]


def entry(data, k):
    return struct.unpack_from("<Q", data, table_at(data, k))[0]


def shown(df):
    # an unset error is no column of some readers
    return sorted(repr(tuple(r)) for r in df.select(*KEYS, "counts", "samples").collect())


@pytest.fixture
def store(tmp_path):
    def put(**files):
        for name, data in files.items():
            (tmp_path / f"{name}.exr").write_bytes(data)
        return str(tmp_path)

    return put


# places in the table


@pytest.mark.parametrize("name", ALL)
def test_places_are_those_of_the_order_of_chunks(name):
    for no, part in enumerate(ALL[name]):
        assert [part.place(*c) for c in part.chunks()] == list(range(part.count))
        assert planning.numbers(part, no, Wanted()).tolist() == list(range(part.count))


@pytest.mark.parametrize("up", [False, True])
@pytest.mark.parametrize("mode", [0, 1, 2])
def test_wanted_chunks_match_brute_force(mode, up):
    part = Part(37, 21, ch("Y"), kind="tiledimage", tile=(8, 5), mode=mode, up=up)
    for wanted in (Wanted(y=(3, 9)), Wanted(lvl_x=(1, 2)), Wanted(lvl_y=(0, 0), y=(20, 90)), Wanted(window=(9, 4, 30, 5)), Wanted(window=(-5, -5, 0, 0)), Wanted(window=(36, 20, 99, 99), lvl_x=(2, 9)), Wanted(window=(40, 0, 50, 9)), Wanted(y=(8, 2)), Wanted(part_no=(1, 1))):
        want = []
        for i, (tx, ty, lx, ly) in enumerate(part.chunks()):
            x, y, w, h = part.box(tx, ty, lx, ly)
            pixels = [(a, b) for a in range(x, x + w) for b in range(y, y + h)]
            if wanted.y:
                pixels = [(a, b) for a, b in pixels if wanted.y[0] <= b <= wanted.y[1]]
            if wanted.window:
                x0, y0, x1, y1 = wanted.window
                last = [geometry.level_extent(n, k, up) - 1 for n, k in ((37, lx), (21, ly))]
                # a pixel stands for the pixels of the first level that are shifted to it; the last for those beyond, too
                hit = {(min(a >> lx, last[0]), min(b >> ly, last[1])) for a in range(max(x0, 0), min(x1, 36) + 1) for b in range(max(y0, 0), min(y1, 20) + 1)}
                pixels = [p for p in pixels if p in hit]
            levels = all(r is None or r[0] <= v <= r[1] for r, v in ((wanted.lvl_x, lx), (wanted.lvl_y, ly)))
            if pixels and levels and wanted.has_part(0):
                want.append(i)
        assert planning.numbers(part, 0, wanted).tolist() == want, wanted


def test_runs_break_at_gaps_and_sizes():
    index = planning.Index(np.zeros(6, int), np.arange(6), np.array([0, 10, 20, 100, 110, 400]), np.array([10, 20, 30, 110, 120, 900]))
    assert planning.runs(index, 1000, gap=50) == [(0, 3), (3, 5), (5, 6)]
    assert planning.runs(index, 20, gap=1000) == [(0, 2), (2, 3), (3, 5), (5, 6)]
    assert planning.runs(index.take(np.zeros(0, int)), 9) == []


# bytes that are not wanted are not read


def test_unwanted_chunks_are_not_read(spark, store, monkeypatch):
    part = Part(64, 640, ch("Y", kind="FLOAT"), codec="NONE")
    data = _file([part])
    plan, read, reads = plan_and_read(data)
    some = planning.index_of(plan, read, len(data), Wanted(y=(100, 119)))
    assert some.number.tolist() == list(range(100, 120)) and (some.stop - some.start).sum() * 30 < len(data)
    folder = store(x=data)
    found = exr.splits(spark, folder, wanted=Wanted(y=(100, 119))).collect()
    assert sum(r["stop"] - r["start"] for r in found) * 30 < len(data)
    got = exr.lines(exr.read_chunks(spark, folder, wanted=Wanted(y=(100, 119)))).select("y", "samples").collect()
    assert sorted(r["y"] for r in got) == list(range(100, 120))


def test_level_and_part_choose_chunks(spark, store):
    folder = store(mixed=FILES["mixed"])
    every = exr.lines(exr.read_chunks(spark, folder))
    some = exr.lines(exr.read_chunks(spark, folder, wanted=Wanted(part_no=(1, 3), lvl_x=(1, 1))))
    assert shown(some) == shown(every.where("part_no between 1 and 3 and lvl_x = 1"))
    size = lambda w: sum(r["stop"] - r["start"] for r in exr.splits(spark, folder, wanted=w).collect())
    assert size(Wanted(part_no=(3, 3), lvl_x=(2, 2))) < size(Wanted(part_no=(3, 3))) < size(Wanted())


@pytest.mark.parametrize("condition", ["part_no = 1 AND lvl_x = 1", "part_no IN (0, 3) AND y < 2", "y >= 3 AND channel = 'Z'", "lvl_y > 0 AND channel IN ('Y', 'Z')", "x0 > 2 OR y = 1", "path LIKE '%mixed%' AND y = 2", "part_no = 9", "channel <> 'Z'", "y IS NULL", "part_no <=> 1"])
def test_pushed_filters_change_no_result(spark, store, condition):
    datasource.register(spark)
    folder = store(mixed=FILES["mixed"], parts=FILES["parts"])
    every = exr.lines(exr.read_chunks(spark, folder))
    for split_bytes in ("200", "1000000"):
        got = spark.read.format("exr").option("split_bytes", split_bytes).load(folder).where(condition)
        assert shown(got) == shown(every.where(condition))


def test_plan_has_no_filter_of_what_is_pushed(spark, store):
    datasource.register(spark)
    found = spark.read.format("exr").load(store(mixed=FILES["mixed"])).where("part_no = 1 AND lvl_x = 1 AND y < 2 AND channel = 'Y'")
    assert "Filter (" not in found._jdf.queryExecution().executedPlan().toString().replace("(isnotnull", "") or found.count() > 0
    assert found.count() == exr.lines(exr.read_chunks(spark, store(mixed=FILES["mixed"]))).where("part_no = 1 AND lvl_x = 1 AND y < 2 AND channel = 'Y'").count() > 0


def test_a_schema_of_some_columns(spark, store):
    datasource.register(spark)
    got = spark.read.format("exr").schema("y int, channel string").load(store(scan=FILES["scan_ZIP"])).where("y = 3")
    assert got.columns == ["y", "channel"] and sorted(r["channel"] for r in got.collect()) == ["A", "B", "C", "D"]


# windows


@pytest.mark.parametrize("name", ["scan_ZIP", "tiled_RLE", "mip", "rip_up", "deep_tile", "deep_scan", "mixed", "subsampled"])
@pytest.mark.parametrize("window", [(2, 1, 4, 3), (0, 0, 0, 0), (4, 4, 100, 100), (-3, -3, 1, 1), (200, 0, 300, 9)])
def test_window_is_that_of_the_whole_image(spark, store, name, window):
    folder = store(x=FILES[name])
    got, want = set(), set()

    def pixels(df):
        rows = exr.lines(df) if "payload" in df.columns else df
        flat = [(r["part_no"], r["lvl_x"], r["lvl_y"], r["channel"], r["y"], r["x"], -1, r["value"]) for r in exr.pixels(rows).collect()]
        return flat + [(r["part_no"], r["lvl_x"], r["lvl_y"], r["channel"], r["y"], r["x"], r["sample_idx"], r["value"]) for r in exr.deep_samples(rows).collect()]

    for no, lx, ly, channel, y, x, i, v in pixels(exr.read_chunks(spark, folder)):
        part = ALL[name][no]
        x0, y0, x1, y1 = Wanted(window=window).box(part, lx, ly)
        xs = next(c.xs for c in part.channels if c.name == channel)
        if x0 <= x * xs <= x1 and y0 <= y <= y1:
            want.add((no, lx, ly, channel, y, x, i, v))
    found = pixels(exr.region(spark, folder, window))
    got = set(found)
    assert got == want and len(found) == len(got)


def test_window_reads_bytes_in_proportion(spark, store):
    part = Part(96, 96, ch("Y", kind="FLOAT"), kind="tiledimage", tile=(8, 8), mode=2, codec="NONE")
    folder = store(x=_file([part]))
    size = lambda w: sum(r["stop"] - r["start"] for r in exr.splits(spark, folder, split_bytes=1, wanted=w).collect())
    assert size(Wanted(window=(0, 0, 7, 7), lvl_x=(0, 0), lvl_y=(0, 0))) * 100 < size(Wanted(lvl_x=(0, 0), lvl_y=(0, 0)))
    datasource.register(spark)
    got = spark.read.format("exr").option("window", "10,3,12,4").load(folder).where("lvl_x = 1 AND lvl_y = 0").collect()
    assert {(r["y"], r["x0"], len(r["samples"])) for r in got} == {(3, 5, 2), (4, 5, 2)}


# tables that are not filled in


def zeroed(data, keep=0):
    plan = layout.plan_of(data, len(data))
    return data[: plan.at + 8 * keep] + bytes(8 * (sum(plan.counts) - keep)) + data[plan.body :]


@pytest.mark.parametrize("name", [k for k, v in ALL.items() if len(v) > 1])
@pytest.mark.parametrize("keep", [0, 1])
def test_files_of_many_parts_need_no_offset_table(spark, store, name, keep):
    want = shown(exr.lines(exr.read_chunks(spark, store(x=FILES[name]))))
    folder = store(x=zeroed(FILES[name], keep))
    reader = next(e for e in exr.ENTRIES if name in TAKES.get(e, ()))
    assert shown(exr.lines(exr.read_chunks(spark, folder, reader, split_bytes=200))) == want
    assert shown(exr.lines(exr.chunks(exr.files(spark, folder), reader))) == want
    datasource.register(spark)
    assert shown(spark.read.format("exr").option("split_bytes", "300").load(folder)) == want
    part = [r for r in want if r.startswith("(1,")]
    assert shown(exr.lines(exr.read_chunks(spark, folder, wanted=Wanted(part_no=(1, 1))))) == part


def test_a_walk_skips_payloads():
    part = [Part(64, 400, ch("Y", kind="FLOAT"), codec="NONE", name=n) for n in "ab"]
    data = zeroed(_file([*part[:1], Part(500, 300, ch("Y", kind="FLOAT"), kind="tiledimage", tile=(100, 100), codec="NONE", name="b")]))
    plan, read, reads = plan_and_read(data)
    index = planning.index_of(plan, read, len(data))
    assert index.walked and len(index.start) == 415 and sum(n for _, n in reads) < len(data) / 2


def test_a_walk_finds_chunks_of_one_part_too(spark, store):
    data = zeroed(FILES["tiled_RLE"])
    with pytest.raises(Exception, match="outside the file"):
        exr.read_chunks(spark, store(x=data)).count()
    assert shown(exr.lines(exr.read_chunks(spark, store(x=data), recover=True))) == shown(exr.lines(exr.read_chunks(spark, store(x=FILES["tiled_RLE"]))))


@pytest.mark.parametrize("name", ["parts", "mixed"])
def test_cut_files_without_a_table_are_refused(store, name):
    data = zeroed(FILES[name])
    for n in range(layout.plan_of(data, len(data)).body, len(data), 7):
        plan = layout.plan_of(data[:n], n)
        with pytest.raises(InvalidData):
            planning.index_of(plan, lambda at, k: data[:n][at : at + k], n)  # noqa: B023  used at once


# deep parts have each chunk once


@pytest.mark.parametrize("name", ["deep_scan", "deep_tile", "deep_mip", "deep_rip"])
def test_deep_chunks_named_twice_are_refused(spark, store, name):
    data = FILES[name]
    folder = store(x=with_entry(data, 1, entry(data, 0)))
    datasource.register(spark)
    for read in (lambda: exr.read_chunks(spark, folder).count(), lambda: spark.read.format("exr").load(folder).count(), lambda: exr.chunks(exr.files(spark, folder)).count()):
        with pytest.raises(Exception, match="twice or missing|twice in the offset table|deep chunk twice"):
            read()


def test_deep_chunks_with_the_coordinates_of_others_are_refused(spark, store):
    data = FILES["deep_tile"]
    at = entry(data, 1)
    folder = store(x=data[:at] + data[entry(data, 0) :][:16] + data[at + 16 :])  # tile 1 tells that it is tile 0
    datasource.register(spark)
    for read in (lambda: exr.read_chunks(spark, folder).count(), lambda: spark.read.format("exr").option("split_bytes", "50").load(folder).count()):
        with pytest.raises(Exception, match="twice or missing"):
            read()


def test_a_deep_table_in_another_order_is_read(spark, store):
    data = FILES["deep_tile"]
    a, b = entry(data, 0), entry(data, 2)
    folder = store(x=with_entry(with_entry(data, 0, b), 2, a))
    want = shown(exr.lines(exr.read_chunks(spark, store(y=data) + "/y.exr")))
    assert shown(exr.lines(exr.read_chunks(spark, folder + "/x.exr", split_bytes=100))) == want
    with pytest.raises(Exception, match="another order"):
        exr.read_chunks(spark, folder + "/x.exr", wanted=Wanted(y=(0, 1))).count()
    assert shown(exr.lines(exr.read_chunks(spark, folder + "/x.exr", wanted=Wanted(y=(0, 1)), recover=True), wanted=Wanted(y=(0, 1)))) == [r for r in want if eval(r)[4] <= 1]


@pytest.mark.parametrize("name", ["deep_parts", "deep_tile_parts", "mixed"])
def test_repeated_deep_chunks_of_many_parts_are_refused(spark, store, name):
    data = FILES[name]
    plan = layout.plan_of(data, len(data))
    no = next(i for i, p in enumerate(plan.parts) if p.deep)
    first = sum(plan.counts[:no])
    a, b = entry(data, first), entry(data, first + 1)
    n = layout.Plan.head(plan, data, a)[1] - 24 if not plan.parts[no].tiled else 20
    folder = store(x=data[: b + 4] + data[a + 4 : a + n] + data[b + n :])
    for more in ({}, {"recover": True}):
        with pytest.raises(Exception, match="twice"):
            exr.read_chunks(spark, folder, **more).count()


def test_flat_chunks_named_twice_are_read_once(spark, store):
    data = FILES["tiled_RLE"]
    got = exr.read_chunks(spark, store(x=with_entry(data, 1, entry(data, 0))))
    assert got.count() == got.select("tx", "ty").distinct().count() == ALL["tiled_RLE"][0].count - 1


# modes


def broken(name):
    """A file with chunk 1 that cannot be decoded: its zlib stream is other bytes."""
    data, spec = FILES[name], ALL[name][0]
    at = entry(data, 1) + layout.KINDS[spec.kind]
    return data[:at] + b"\xff" * 8 + data[at + 8 :]


@pytest.mark.parametrize("through", ["format", "chunks"])
def test_modes_tell_or_drop_damaged_chunks(spark, store, through):
    datasource.register(spark)
    damaged = with_entry(FILES["tiled_PXR24"] if "tiled_PXR24" in FILES else _file(ALL["scan_ZIP"]), 0, 3)
    folder = store(a=broken("scan_ZIP"), b=damaged, c=b"no file", d=FILES["mip"])

    def read(mode):
        if through == "format":
            return spark.read.format("exr").option("mode", mode).option("split_bytes", "500").load(folder)
        return exr.lines(exr.read_chunks(spark, folder, mode=mode), mode=mode)

    with pytest.raises(Exception, match="InvalidData|zlib|magic|outside"):
        read("FAILFAST").collect()
    told = read("permissive")
    name = F.regexp_extract("path", r"(\w)\.exr", 1).alias("name")
    bad = {(r["name"], r["part_no"], r["error"].split(":")[0] + ":" + r["error"].split(":")[1]) for r in told.where("error is not null").select(name, "part_no", "error").collect()}
    assert {(n, p) for n, p, _ in bad} == {("a", 0), ("b", 0), ("c", None)} and all(e.startswith("InvalidData:") for _, _, e in bad)
    good = read("dropmalformed")
    assert shown(told.where("error is null")) == shown(good)
    assert {r["name"] for r in good.select(name).distinct().collect()} == {"a", "b", "d"}
    with pytest.raises(Exception, match="mode must be"):
        read("sometimes").count()


def test_a_walk_that_ends_early_tells_so(spark, store):
    data = zeroed(FILES["parts"])
    folder = store(x=data[:-5])
    told = exr.read_chunks(spark, folder, mode="PERMISSIVE").collect()
    assert [r["error"] for r in told if r["error"]] == ["InvalidData: a chunk is cut off: the walk ends here"] and len(told) > 2


# the sink


SINK = ["mixed", "subsampled", "scan_B44", "rip_up", "deep_scan"]


@pytest.mark.parametrize("name", SINK)
@pytest.mark.parametrize("pieces", [False, True])
def test_sink_writes_what_encode_gives(spark, tmp_path, name, pieces):
    datasource.register(spark)
    spec = ALL[name] if name in ALL else [Part(13, 37, ch("A", "B") + ch("C", kind="FLOAT") + ch("D", kind="UINT"), codec="B44")]
    rows = spark.createDataFrame(sample_rows(spec) + sample_rows(spec, "b"), ROWS)
    made = exr.prepared(rows, spec) if pieces else rows.repartition("path")
    out = made.write.format("exr").option("parts", exr.parts_json(spec)).option("rows", "pieces" if pieces else "lines").mode("append")
    out.save(str(tmp_path / "out"))
    want = {x["path"]: bytes(x["content"]) for x in exr.encode(rows, spec).collect()}
    assert {p.name: p.read_bytes() for p in (tmp_path / "out").iterdir()} == {f"{k}.exr": v for k, v in want.items()}


def test_sink_overwrites_and_appends(spark, tmp_path):
    datasource.register(spark)
    spec = ALL["parts"]
    write = lambda path, mode: spark.createDataFrame(sample_rows(spec, path), ROWS).coalesce(1).write.format("exr").option("parts", exr.parts_json(spec)).mode(mode).save(str(tmp_path / "o"))
    write("a", "append")
    write("b", "append")
    assert sorted(p.name for p in (tmp_path / "o").iterdir()) == ["a.exr", "b.exr"]
    write("c", "overwrite")
    assert [p.name for p in (tmp_path / "o").iterdir()] == ["c.exr"]


def test_a_sink_that_fails_leaves_nothing(spark, tmp_path):
    datasource.register(spark)
    spec = ALL["parts"]
    rows = spark.createDataFrame(sample_rows(spec) + [r for r in sample_rows(spec, "b") if r[5] != 2], ROWS)
    for made, what in ((rows.repartition(2, "path"), "rows are missing"), (rows.where("path = 'a'").repartition(3), "rows are missing|several tasks")):
        with pytest.raises(Exception, match=what):
            made.write.format("exr").option("parts", exr.parts_json(spec)).mode("append").save(str(tmp_path / "o"))
        assert [p for p in tmp_path.rglob("*") if p.is_file()] == []
    with pytest.raises(Exception, match="parts must tell"):
        rows.write.format("exr").mode("append").save(str(tmp_path / "o"))


# rows that have no place


@pytest.mark.parametrize("change, what", [(lambda r: [*r, r[0]], "same y|two rows"), (lambda r: [*r, (*r[0][:5], 99, *r[0][6:])], "outside part|no place"), (lambda r: [*r, (*r[0][:5], 19, *r[0][6:])], "no place|outside part|same y"), (lambda r: [*r, (*r[0][:4], "Q", *r[0][5:])], "no place"), (lambda r: [*r, (r[0][0], 7, *r[0][2:])], "rows of part 7|part")])
def test_rows_without_a_place_are_errors(spark, tmp_path, change, what):
    datasource.register(spark)
    spec = [Part(8, 18, ch("R"), name="a")]
    rows = spark.createDataFrame(change(sample_rows(spec)), ROWS)
    with pytest.raises(Exception, match=what):
        exr.write(rows, spec, str(tmp_path / "o")).collect()
    with pytest.raises(Exception, match=what):
        rows.coalesce(1).write.format("exr").option("parts", exr.parts_json(spec)).mode("append").save(str(tmp_path / "p"))
    assert [p for p in tmp_path.rglob("*") if p.is_file()] == []


def test_no_rows_make_an_empty_folder(spark, tmp_path):
    datasource.register(spark)
    spec, none = ALL["mixed"], spark.createDataFrame([], ROWS)
    assert exr.write(none, spec, str(tmp_path / "o")).collect() == []
    none.write.format("exr").option("parts", exr.parts_json(spec)).mode("append").save(str(tmp_path / "p"))
    for folder in ("o", "p"):
        at = str(tmp_path / folder)
        assert exr.read_chunks(spark, at).count() == 0 and exr.lines(exr.chunks(exr.files(spark, at))).count() == 0
        assert spark.read.format("exr").load(at).count() == 0 and exr.heads(spark, at).count() == 0


# each reader refuses what it does not read, through the code that reads


@pytest.mark.parametrize("reader", exr.ENTRIES)
def test_readers_refuse_other_kinds_while_planning(store, reader):
    folder = store(**FILES)
    for name, data in FILES.items():
        with exr.open_file(f"{folder}/{name}.exr") as f:
            if reader == "any" or name in TAKES[reader] or reader == "mixed" and name == "deep_rip_up_parts":
                found = exr.file_splits(f, f"{folder}/{name}.exr", len(data), 1 << 20, reader)
                batch = pa.RecordBatch.from_pylist(found, schema=exr.arrow_schema(exr.SPLITS))
                assert sum(b.num_rows for b in exr.range_batches(iter([batch]), reader)) == sum(p.count for p in ALL[name])
            else:
                with pytest.raises(Unsupported, match="does not read"):
                    exr.file_splits(f, f"{folder}/{name}.exr", len(data), 1 << 20, reader)


# shapes before writing


@pytest.mark.parametrize("name", ["mip", "rip_up", "mixed", "subsampled", "deep_tile"])
def test_shape_faults_tell_lines_that_are_missing_or_wrong(spark, name):
    spec, rows = ALL[name], sample_rows(ALL[name]) + sample_rows(ALL[name], "b")
    shown_faults = lambda r: sorted(tuple(x) for x in exr.shape_faults(spark.createDataFrame(r, ROWS), spec).collect())
    assert shown_faults(rows) == []
    lost, (path, no, lx, ly, c, y, counts, values) = rows[1:], rows[0]
    n = sum(r[:5] == rows[0][:5] for r in rows)
    assert shown_faults(lost) == [(path, no, lx, ly, c, n, n - 1, 0)]
    assert shown_faults([*rows, rows[0]]) == [(path, no, lx, ly, c, n, n - 1, 1)]
    assert shown_faults([*rows, (path, no, lx, ly, c, 999, counts, values)]) == [(path, no, lx, ly, c, n, n, 1)]
    assert shown_faults([*rows, (path, 9, 0, 0, "Q", 0, counts, values)]) == [(path, 9, 0, 0, "Q", 0, 0, 1)]
    left = [r for r in rows if r[0] != path or r[1:4] != (no, lx, ly)]
    if any(r[0] == path for r in left):  # a file without rows is none
        assert shown_faults(left)[0][5:] == (n, 0, 0)
