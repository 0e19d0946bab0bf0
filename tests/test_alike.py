"""Files that are written and read many at a time are those of the general writer and reader."""

import os

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from prismframe import catalog_files as files
from prismframe.functions.codecs import InvalidData
from prismframe.operators import pyramid
from prismframe.plans.lineage import shared_dir
from prismframe.sources import alike, exr, layout

from tests.test_exr import SPECS, _file, ch, sample_rows
from tests.test_reading import ALL

MORE = SPECS | {
    "mixed_kinds": [layout.Part(9, 5, ch("A", kind="FLOAT") + ch("B") + ch("C", kind="UINT"), kind="deeptile", tile=(4, 4), mode=1, codec="ZIPS"), layout.Part(9, 20, ch("A", kind="FLOAT") + ch("B") + ch("C", kind="UINT"), codec="ZIP", line_order=1, x0=3, y0=-7)],
    "from_below": [layout.Part(13, 9, ch("A", kind="FLOAT"), codec="RLE", line_order=1, y0=4)],
}
for _no, _p in enumerate(MORE["mixed_kinds"]):
    _p.name = f"part {_no}"


def images_of(spec, n=3):
    """Images of n files, the first as sample_rows() has it; in the others flat values are 0 or twice as large and deep pixels turned."""
    told = {}
    for _, no, lx, ly, c, y, counts, values in sample_rows(spec):
        told.setdefault((no, lx, ly), {})[c, y] = (counts, values)
    images = {}
    for key, own in told.items():
        part = spec[key[0]]
        ys = {c.name: sorted(y for d, y in own if d == c.name) for c in part.channels}
        if not part.deep:
            planes = [np.array([own[c.name, y][1] for y in ys[c.name]], np.float32) for c in part.channels]
            images[key] = alike.Flat([np.stack([p * k for k in (1, 0, 2)][:n]) for p in planes])
            continue
        counts = np.array([own[part.channels[0].name, y][0] for y in ys[part.channels[0].name]])
        counts = np.stack([counts, counts[::-1], counts[:, ::-1]][:n])
        values = [np.concatenate([own[c.name, y][1] for y in ys[c.name]]).astype(np.float32) for c in part.channels]
        images[key] = alike.Deep(counts, (counts.cumsum() - counts.ravel()).reshape(counts.shape), [np.concatenate([v, v + 1, v + 2][:n]) for v in values])
    return images


def reference(spec, images, i):
    """File i by the functions of single chunks."""
    chunks, most = [], [0] * len(spec)
    for no, part in enumerate(spec):
        for tx, ty, lx, ly in part.chunks():
            x, y, w, h = part.box(tx, ty, lx, ly)
            image, own = images[no, lx, ly], {}
            for k, c in enumerate(part.channels):
                for r in range(y, y + h, 1):
                    if part.deep:
                        n, at = image.counts[i, r, x : x + w], image.starts[i, r, x : x + w]
                        own[c.name, r] = np.concatenate([image.values[k][a : a + m] for a, m in zip(at, n, strict=True)]), n
                    elif r % c.ys == 0:
                        own[c.name, r] = image.planes[k][i, r // c.ys, -(-x // c.xs) : -(-(x + w) // c.xs)], None
            body, top = layout.encode_chunk(part, tx, ty, lx, ly, own)
            most[no] = max(most[no], top)
            chunks.append((no, body))
    return layout.encode_file(spec, chunks, most)


@pytest.mark.parametrize("name", MORE)
def test_files_made_together_are_those_made_alone(name):
    images = images_of(MORE[name])
    made = [b"".join(pieces) for pieces in alike.files_of(MORE[name], images)]
    assert made == [reference(MORE[name], images, i) for i in range(3)]


def test_large_files_do_not_stay_in_memory(monkeypatch):
    images = images_of(SPECS["mixed"])
    whole = [b"".join(pieces) for pieces in alike.files_of(SPECS["mixed"], images)]
    monkeypatch.setattr(alike, "HELD", 16)
    assert [b"".join(pieces) for pieces in alike.files_of(SPECS["mixed"], images)] == whole


def chunks_in(data, entry="any", path="a"):
    return alike.file_chunks(path, data, entry, alike.Heads())


def rows_in(data, path="a"):
    """The chunks by their headers, one after another."""
    told = [exr._part_json(p) for p in layout.plan_of(data, len(data)).parts]
    return [{"path": path, "part": told[r["part_no"]]} | r for r in layout.walk_chunks(data)]


def values_of(batches):
    out = []
    for batch in batches:
        for r in batch.to_pylist():
            for i, v in enumerate(r["samples"]):
                at = i if r["pixels"] is None else r["pixels"][i]
                out.append((r["path"], r["part_no"], r["lvl_x"], r["lvl_y"], r["channel"], r["y0"] + at // r["w"], r["x0"] + at % r["w"], -1 if r["nth"] is None else r["nth"][i], v))
    return sorted(out)


def lines_in(rows):
    out = []
    for r in rows:
        for channel, y, x0, counts, samples in layout.decode_chunk(exr._part(r["part"]), r):
            places = [(i, -1) for i in range(len(samples))] if counts is None else [(i, k) for i, n in enumerate(counts) for k in range(n)]
            out += [(r["path"], r["part_no"], r["lvl_x"], r["lvl_y"], channel, y, x0 + i, k, v) for (i, k), v in zip(places, samples.tolist(), strict=True)]
    return sorted(out)


@pytest.mark.parametrize("name", MORE)
@pytest.mark.parametrize("together", [1, 1 << 20])
def test_chunks_decoded_together_are_those_decoded_alone(name, together, monkeypatch):
    monkeypatch.setattr(alike, "DECODED", together)
    made = [b"".join(pieces) for pieces in alike.files_of(MORE[name], images_of(MORE[name]))]
    rows = [r for i, data in enumerate(made) for r in rows_in(data, f"f{i}")]
    want = lines_in(rows)
    assert values_of(alike.decoded(c for i, data in enumerate(made) for c in chunks_in(data, path=f"f{i}"))) == want and want
    assert values_of(alike.decoded(iter(rows))) == want


@pytest.mark.parametrize("split_bytes", [300, 1 << 20])
def test_small_and_large_files_are_read_alike(spark, tmp_path, split_bytes):
    for name in ("scan_ZIP", "subsampled", "mip", "rip_up", "deep_scan", "deep_tile", "mixed"):
        (tmp_path / f"{name}.exr").write_bytes(_file(ALL[name]))
    keys = ("path", "part_no", "lvl_x", "lvl_y", "channel", "y", "x", "sample_idx", "value")
    got = alike.samples(alike.read(spark, f"file://{tmp_path}", split_bytes=split_bytes)).select(*keys)
    lines = exr.read_lines(spark, f"file://{tmp_path}").cache()
    want = exr.pixels(lines).withColumn("sample_idx", F.lit(-1)).select(*keys).union(exr.deep_samples(lines).select(*keys))
    assert got.dtypes == want.dtypes and sorted(got.collect()) == sorted(want.collect())


def test_no_files_give_no_rows(spark, tmp_path):
    assert alike.samples(alike.read(spark, f"file://{tmp_path}", "mixed")).collect() == []


def test_damage_is_an_error():
    data = [b"".join(pieces) for pieces in alike.files_of(SPECS["deep_tile"], images_of(SPECS["deep_tile"]))][0]
    first, *rest = chunks_in(data)
    packed = first[-1]
    for unpacked, payload in ((first[-2] + 4, packed), (first[-2], packed[:-1]), (first[-2], b"\xff" * len(packed))):
        with pytest.raises(InvalidData):
            list(alike.decoded(iter([(*first[:-2], unpacked, payload), *rest])))
    with pytest.raises(InvalidData):
        chunks_in(data[:-1])
    with pytest.raises(exr.Unsupported):
        chunks_in(data, "deep_scanline")


@pytest.mark.parametrize("name", ["tiled_NONE", "deep_tile", "mixed"])
def test_any_byte_changed_does_what_it_does_to_the_general_reader(name):
    """Tables, headers of chunks and what follows: the same values, or an error where that has one."""
    data = [b"".join(pieces) for pieces in alike.files_of(MORE[name], images_of(MORE[name]))][0]
    plan, split = layout.plan_of(data, len(data)), exr.arrow_schema(exr.SPLITS)

    class File:
        def __init__(self, data):
            self.data = data

        __enter__, __exit__ = lambda self: self, lambda self, *_: None
        read_at = lambda self, n, at: self.data[at : at + n]

    def general(data):
        rows = exr.file_splits(File(data), "a", len(data), 1 << 20)
        with pytest.MonkeyPatch.context() as m:
            m.setattr(exr, "open_file", lambda _: File(data))
            return lines_in([r for own in exr.range_rows(iter([pa.RecordBatch.from_pylist(rows, schema=split)]), "any") for r in own])

    def outcome(read, data):
        try:
            return read(data)
        except (InvalidData, exr.Unsupported) as e:
            return type(e)

    together = lambda data: values_of(alike.decoded(iter(chunks_in(data))))
    some = [*range(plan.at, plan.at + 16), *range(plan.body, len(data), max(1, (len(data) - plan.body) // 150))]
    seen = set()
    for i in some:
        for v in (0, 255, data[i] ^ 1):
            changed = data[:i] + bytes([v]) + data[i + 1 :]
            want = outcome(general, changed)
            got = outcome(together, changed)
            assert repr(got) == repr(want), (i, v)
            seen.add(want if isinstance(want, type) else list)
    swapped = data[: plan.at] + data[plan.at + 8 : plan.at + 16] + data[plan.at : plan.at + 8] + data[plan.at + 16 :]
    assert seen >= {list, InvalidData} and repr(outcome(together, swapped)) == repr(outcome(general, swapped))


def test_headers_that_are_alike_are_read_once():
    spec, heads = SPECS["mixed"], alike.Heads()
    made = [b"".join(pieces) for pieces in alike.files_of(spec, images_of(spec))]
    found = [heads.of(data) for data in made]
    assert found[0] is found[1] is found[2] and found[0].plan == layout.plan_of(made[0], len(made[0])) and all(isinstance(c, tuple) for c in chunks_in(made[0]))
    with pytest.raises(InvalidData):
        heads.of(made[0][: found[0].plan.at + 4])  # the known headers, but no room for the tables


def test_a_window_of_more_chunks_than_the_table_has_makes_no_list_of_them():
    spec = [layout.Part(1, 1 << 26, ch("Y", kind="FLOAT"), codec="NONE", extra=[("chunkCount", "int", 1)])]
    head, body = layout.encode_headers(spec, [0]), layout.encode_chunk(spec[0], 0, 0, 0, 0, {("Y", 0): (np.ones(1, np.float32), None)})[0]
    data = head + (len(head) + 8).to_bytes(8, "little") + body
    heads = alike.Heads()
    assert heads.of(data).chunks == [] and values_of(alike.decoded(iter(alike.file_chunks("a", data, "any", heads)))) == [("a", 0, 0, 0, "Y", 0, 0, -1, 1.0)]


def table_of(counts):
    return pa.RecordBatch.from_pydict({"file": np.repeat(np.arange(len(counts)), counts), "n": np.arange(sum(counts))})


@pytest.mark.parametrize("rows", [1, 7, 1 << 16])
def test_whole_files_are_gathered(rows, monkeypatch):
    monkeypatch.setattr(alike, "ROWS", rows)
    monkeypatch.setattr(alike, "FILES", 3)
    batch = table_of([1, 5, 2, 1, 1, 40, 1, 3, 3, 1])
    found = list(alike.whole_files(batch.slice(a, 4) for a in range(0, batch.num_rows + 4, 4)))
    assert pa.concat_tables(found).column("n").to_pylist() == list(range(batch.num_rows))
    told = [set(t.column("file").to_pylist()) for t in found]
    assert all(1 <= len(t) <= 3 for t in told) and sum(map(len, told)) == 10


@pytest.mark.parametrize("width,height", [(24, 20), (7, 1), (1, 6), (13, 9), (1, 1), (64, 37)])
def test_pyramids_of_many_planes(spark, width, height):
    planes = np.random.default_rng(width).normal(size=(2, height, width)).astype(np.float32)
    rows = spark.createDataFrame([(i, y, planes[i, y].tolist()) for i in range(2) for y in range(height)], "k int, y int, samples array<float>")
    mip = {(k, k): p for k, p in enumerate(pyramid.mip_planes(planes))}
    for made, found in ((pyramid.mip_pyramid, mip), (pyramid.rip_pyramid, pyramid.rip_planes(planes))):
        got = {(r["k"], r["lvl_x"], r["lvl_y"], r["y"]): r["samples"] for r in made(rows, ["k"], width, height).collect()}
        assert got == {(i, *level, y): p[i, y].tolist() for level, p in found.items() for i in range(2) for y in range(p.shape[1])}


@pytest.fixture
def tables(tmp_path):
    """Orders of four images (two of them without any, one with a pixel of many), and vectors of the first and the last but one."""
    rng = np.random.default_rng(1)
    keys = np.concatenate([rng.integers(0, 140, 300), rng.integers(420, 560, 200), np.full(5000, 430), [-3]])
    prices = np.concatenate([rng.integers(0, 99, len(keys) - 3) / 4, [np.nan, np.inf, 7]])
    pq.write_table(pa.table({"l_orderkey": pa.array(keys), "l_extendedprice": pa.array(prices)}), tmp_path / "lineitem.parquet")
    ids = [*range(0, 30), *range(80, 90)]
    vectors = pa.array(rng.normal(size=(len(ids), 64)).astype(np.float32).tolist(), pa.list_(pa.float32()))
    pq.write_table(pa.table({"vec_id": pa.array(ids, pa.int64()), "embedding": vectors}), tmp_path / "embeddings.parquet")
    return str(tmp_path)


def general_rows(spark, sf_dir, n):
    """Rows for the general writer of the images of exr_mixed."""
    flat, pixels = files.flat_rows(spark, sf_dir, n), files.deep_pixels(spark, sf_dir, n)
    small = files.crop(flat, 24, 20)
    out = files.as_part(flat).union(files.as_part(flat, 1))
    for no, mode in ((2, files.MIP), (3, files.RIP)):
        out = out.union(files.as_part(files._pyramid(small, mode, 24, 20), no))
    for no, mode in ((4, 0), (5, 0), (6, files.MIP), (7, files.RIP)):
        out = out.union(files.deep_rows(spark, sf_dir, files._mode_levels(mode), no, pixels))
    return out


def test_mixed_files_are_those_of_the_general_writer(spark, tables, tmp_path):
    folder = f"file://{tmp_path}/made"
    told = alike.write(files.mixed_rows(spark, tables, 4), files.mixed_parts(), folder, files.mixed_images, 4).collect()
    assert sorted(os.listdir(tmp_path / "made")) == [f"{i}.exr" for i in range(4)]
    assert {r["path"]: r["bytes"] for r in told} == {str(i): (tmp_path / "made" / f"{i}.exr").stat().st_size for i in range(4)}
    want = exr.encode(general_rows(spark, tables, 4), files.mixed_parts()).collect()
    assert len(want) == 4 and all((tmp_path / "made" / f"{r['path']}.exr").read_bytes() == r["content"] for r in want)


def test_a_vector_twice_is_an_error(spark, tables, tmp_path):
    rows = files.mixed_rows(spark, tables, 4)
    with pytest.raises(Exception, match="the same y"):
        alike.write(rows.union(rows.where("at < -1")), files.mixed_parts(), f"file://{tmp_path}/made", files.mixed_images, 4).collect()


def test_exr_mixed_writes_its_files_and_nothing_between(spark, tables):
    """Chunks, prices, levels and lines were each written as a table of their own, and these took most of the time and disk."""
    place = shared_dir(spark).removeprefix("file://")
    told = lambda kind: set(os.listdir(f"{place}/{kind}")) if os.path.isdir(f"{place}/{kind}") else set()
    cuts, made = told("cuts"), told("files")
    n = files.exr_mixed(spark, tables).count()
    assert told("cuts") == cuts and len(told("files") - made) == 1
    assert n == 4 * (2 * 37 * 64 + sum(w * h for w, h in ((24, 20), (12, 10), (6, 5), (3, 2), (1, 1))) + (24 + 12 + 6 + 3 + 1) * (20 + 10 + 5 + 2 + 1)) + files.alike.samples(files.alike.read(spark, f"{shared_dir(spark)}/files/{(told('files') - made).pop()}")).where("sample_idx >= 0").count()


def test_exr_mixed_of_empty_tables(spark, tmp_path):
    pq.write_table(pa.table({"l_orderkey": pa.array([], pa.int64()), "l_extendedprice": pa.array([], pa.float64())}), tmp_path / "lineitem.parquet")
    pq.write_table(pa.table({"vec_id": pa.array([], pa.int64()), "embedding": pa.array([], pa.list_(pa.float32()))}), tmp_path / "embeddings.parquet")
    got = files.exr_mixed(spark, str(tmp_path))
    assert got.columns == ["file", "part_no", "lvl_x", "lvl_y", "channel", "y", "x", "sample_idx", "value"] and got.collect() == []
