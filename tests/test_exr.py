import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from prismframe.functions import codecs, geometry, numeric
from prismframe.functions.codecs import InvalidData, Unsupported
from prismframe.sources import exr, layout
from prismframe.sources.layout import Channel, Part

ROWS = "path string, part_no int, lvl_x int, lvl_y int, channel string, y int, counts array<int>, samples array<float>"


def sample_rows(spec, path="a"):
    """Whole rows for every channel and level of every part, with values that all pixel types hold exactly."""
    out = []
    for no, p in enumerate(spec):
        for lx, ly in geometry.levels(p.width, p.height, p.mode, p.up) if p.tiled else [(0, 0)]:
            w, h = geometry.level_extent(p.width, lx, p.up), geometry.level_extent(p.height, ly, p.up)
            for ci, c in enumerate(p.channels):
                for y in range(0, h, c.ys):
                    if p.deep:
                        counts = [(x + y + lx) % 4 for x in range(w)]
                        values = [float(7 * ci + k + y + 100 * ly) for k in range(sum(counts))]
                    else:
                        flat = p.codec.startswith("B44")  # equal samples in a block survive this codec
                        counts, values = None, [2.0 * ((x // 4 + 7 * (y // 4)) % 5) + ci if flat else float((3 * x + 5 * y + 11 * ci + lx) % 64) for x in range(-(-w // c.xs))]
                    out.append((path, no, lx, ly, c.name, y, counts, values))
    return out


def ch(*names, kind="HALF", **more):
    return [Channel(n, kind, **more) for n in names]


SPECS = {
    **{f"scan_{c}": [Part(13, 37, ch("A", "B") + ch("C", kind="FLOAT") + ch("D", kind="UINT"), codec=c)] for c in ("NONE", "RLE", "ZIPS", "ZIP", "PXR24", "B44", "B44A")},
    "subsampled": [Part(16, 18, [Channel("U", "FLOAT", xs=2, ys=2), Channel("V", "HALF", xs=2, ys=2), Channel("Y", "FLOAT")], codec="ZIP", x0=5, y0=-3)],
    **{f"tiled_{c}": [Part(13, 9, ch("G", "Y"), kind="tiledimage", tile=(4, 4), codec=c)] for c in ("NONE", "RLE", "PXR24", "B44A")},
    "mip": [Part(13, 9, ch("Y", kind="FLOAT"), kind="tiledimage", tile=(4, 4), mode=1)],
    "rip_up": [Part(9, 5, ch("Y"), kind="tiledimage", tile=(4, 4), mode=2, up=True, codec="ZIPS")],
    "deep_scan": [Part(6, 5, ch("A", "Z"), kind="deepscanline", codec="ZIPS")],
    "deep_tile": [Part(6, 5, ch("A", "Z", kind="FLOAT"), kind="deeptile", tile=(4, 4), codec="RLE")],
    "mixed": [
        Part(8, 8, ch("R"), name="flat"), Part(8, 6, ch("Y"), kind="tiledimage", tile=(4, 4), mode=2, name="rip", codec="RLE"), Part(7, 5, ch("Z"), kind="deepscanline", codec="NONE", name="d"),
        Part(9, 7, ch("Z", kind="UINT"), kind="deeptile", tile=(4, 4), mode=1, codec="ZIPS", name="dm"), Part(6, 6, ch("Z"), kind="deeptile", tile=(4, 4), mode=2, codec="NONE", name="dr"),
    ],
}


@pytest.mark.parametrize("name", SPECS)
def test_files_round_trip(spark, name):
    spec = SPECS[name]
    rows = sample_rows(spec) + sample_rows(spec, "b")
    made = exr.encode(spark.createDataFrame(rows, ROWS), spec).cache()
    assert sorted(x["path"] for x in made.collect()) == ["a", "b"]
    lines = exr.lines(exr.chunks(made)).cache()
    got = {}
    for r in lines.collect():
        key = tuple(r[k] for k in ("path", "part_no", "lvl_x", "lvl_y", "channel", "y"))
        got.setdefault(key, []).append((r["x0"], r["counts"], r["samples"]))
    assert len(got) == len(rows)
    for path, no, lx, ly, c, y, counts, values in rows:
        own = sorted(got[path, no, lx, ly, c, y], key=lambda x: x[0])
        assert [v for _, _, s in own for v in s] == values
        if counts is not None:
            assert [n for _, k, _ in own for n in k] == counts
    parts = exr.parts(made).where("path = 'a'").orderBy("part_no").collect()
    assert [(p["kind"], p["codec"], p["width"], p["height"], p["x0"], p["y0"], p["mode"], p["chunks"]) for p in parts] == [(p.kind, p.codec, p.width, p.height, p.x0, p.y0, p.mode, len(p.chunks())) for p in spec]
    assert exr.channels(made).where("path = 'a'").count() == sum(len(p.channels) for p in spec)
    flat = sum(len(v) for *_, counts, v in rows if counts is None)
    assert exr.pixels(lines).count() == flat
    assert exr.deep_samples(lines).count() == sum(len(v) for *_, v in rows) - flat
    assert exr.lines(exr.chunks(made).where("lvl_x = 0 AND lvl_y = 0"), ["Z"]).where("channel <> 'Z' OR lvl_x > 0").count() == 0


def test_reading_files_and_preview(spark, tmp_path):
    spec = [Part(4, 2, [Channel(n, "FLOAT") for n in "ABGR"])]
    rows = [("a", 0, 0, 0, n, y, None, [-1.0, 0.25, 2.0, float("nan")]) for n in "ABGR" for y in range(2)]
    content = exr.encode(spark.createDataFrame(rows, ROWS), spec).first()["content"]
    (tmp_path / "x.exr").write_bytes(content)
    got = exr.preview(exr.pixels(exr.lines(exr.chunks(exr.files(spark, str(tmp_path)), "single")))).where("y = 1").orderBy("x").collect()
    assert [x["r"] for x in got] == [0, 16384, 65535, 0]
    with pytest.raises(Exception, match="does not read"):
        exr.chunks(exr.files(spark, str(tmp_path)), "mixed").count()


def test_attributes_of_every_type_round_trip(spark):
    values = {
        "box2f": [0.5, 1.0, 2.0, 3.0], "v2i": [1, -2], "v3i": [1, 2, 3], "v3f": [0.5, 1.5, -2.0], "m33f": [float(i) for i in range(9)], "m44f": [float(i) for i in range(16)], "m33d": [i / 3 for i in range(9)],
        "m44d": [i / 7 for i in range(16)], "chromaticities": [0.125 * i for i in range(8)], "double": [1e300], "v2d": [0.1, 0.2], "v3d": [0.1, 0.2, 0.3], "rational": [-24000, 4_000_000_000], "timecode": [0x01020304, 7],
        "keycode": [10, 5, 123456, 1000, 30, 4, 60], "int": [-5], "float": [1.5], "tiledesc": [32, 16, 0x12], "string": "héllo", "stringvector": ["", "a", "é"],
    }
    spec = [Part(2, 1, ch("Y"), extra=[*[(f"my_{k}", k, v) for k, v in values.items()], ("odd", "unknownType", b"\1\2")])]
    made = exr.encode(spark.createDataFrame(sample_rows(spec), ROWS), spec)
    got = {x["name"]: x for x in exr.attributes(made).collect()}
    for k, v in values.items():
        row = got[f"my_{k}"]
        assert (row["ints"] or row["floats"] or row["string"] or row["strings"]) == v and row["type_name"] == k
    assert bytes(got["odd"]["raw"]) == b"\1\2"
    for k in layout.INTEGERS | layout.FLOATS:
        with pytest.raises(InvalidData):
            layout.decode_value(k, b"")


def _file(spec):
    rows = {}
    for _, no, lx, ly, c, y, counts, values in sample_rows(spec):
        rows.setdefault((no, lx, ly), {})[c, y] = (np.array(values, np.float32), counts)
    out, most = [], [3] * len(spec)
    for no, p in enumerate(spec):
        for tx, ty, lx, ly in p.chunks():
            x, _, w, _ = p.box(tx, ty, lx, ly)
            cut = {}
            for k, (v, n) in rows[no, lx, ly].items():
                a = sum(n[:x]) if n else x
                cut[k] = (v[a : a + (sum(n[x : x + w]) if n else w)], n[x : x + w] if n else None)
            out.append((no, layout.encode_chunk(p, tx, ty, lx, ly, cut)[0]))
    return layout.encode_file(spec, out, most)


def _read(data):
    version, headers, _ = layout.decode_header(data)
    told = [layout.part_of(version, h)[0] for h in headers]
    return [layout.decode_chunk(told[r["part_no"]], r) for r in layout.walk_chunks(data)]


@pytest.mark.parametrize("name", ["scan_ZIP", "tiled_RLE", "deep_scan", "deep_tile", "mixed"])
def test_damaged_files_are_refused_or_read(name):
    data = _file(SPECS[name])
    assert _read(data)
    damaged = [data[:n] for n in range(0, len(data), 3)]
    for i in range(0, len(data), 2):
        damaged += [data[:i] + bytes([b]) + data[i + 1 :] for b in (0, 255)]
        damaged += [data[:i] + bytes([b]) * 8 + data[i + 8 :] for b in (0, 255)]
    for d in damaged:
        try:
            _read(d)
        except (InvalidData, Unsupported):
            pass


def test_refused_compressions_and_names():
    for codec in geometry.UNSUPPORTED:
        with pytest.raises(Unsupported):
            _read(_file([Part(4, 4, ch("Y"), codec="NONE")]).replace(b"compression\0compression\0\1\0\0\0\0", b"compression\0compression\0\1\0\0\0" + bytes([next(k for k, v in geometry.COMPRESSIONS.items() if v[0] == codec)])))
    with pytest.raises(InvalidData):
        layout.encode_file([Part(1, 1, ch("Y"), name="a"), Part(1, 1, ch("Y"), name="a")], [], [0, 0])
    with pytest.raises(InvalidData):
        layout.encode_file([Part(1, 1, ch("Z", "Y"))], [], [0])


def test_half_rules_on_all_codes_and_edges():
    code = np.arange(65536, dtype=np.uint16)
    back = numeric.to_half(numeric.from_half(code))
    nan = (code & 0x7C00 == 0x7C00) & (code & 0x3FF > 0)
    assert (back[~nan] == code[~nan]).all() and (back[nan] & 0x7C00 == 0x7C00).all()
    x = np.array([2.0**-24, 1.5 * 2.0**-25, 65519.0, 65520.0, -(2.0**-26), 2049.0, 2051.0], np.float32)
    assert numeric.to_half(x).tolist() == [1, 0, 0x7BFF, 0x7C00, 0x8000, 0x6800, 0x6802]


def test_pxr24_worked_values_and_linear_tables():
    x = np.array([1.0, 0.5, np.pi, 65504, 1e30, np.inf, -1.0, -np.inf], np.float32)
    assert [f"{c:06x}" for c in numeric.to_pxr24(x)] == ["3f8000", "3f0000", "404910", "477fe0", "7149f3", "7f8000", "bf8000", "7f8000"]
    forward, back = numeric.linear_tables()
    assert (forward[0], forward[0x558C], forward[0x7C00], back[0], back[0x8000], back[0x8001], back[0x3C00]) == (0x3C00, 0x7BFF, 0, 0xFC00, 0xFC00, 0, 0)


def test_codecs_on_bytes():
    r = np.random.default_rng(0)
    for n in (0, 1, 2, 3, 127, 128, 129, 1000):
        for raw in (r.integers(0, 256, n).astype(np.uint8).tobytes(), bytes(n), r.integers(0, 2, n).astype(np.uint8).tobytes()):
            assert codecs.unpredict(codecs.predict(raw)) == raw and codecs.uninterleave(codecs.interleave(raw)) == raw
            assert codecs.rle_unpack(codecs.rle_pack(raw), n) == raw
            for codec in ("NONE", "RLE", "ZIPS", "ZIP"):
                assert codecs.unpack(codecs.pack(raw, codec), n, codec) == raw
    assert codecs.rle_pack(b"aaab") == b"\x02a\xffb" and codecs.rle_unpack(b"\x80" + bytes(128), 128) == bytes(128)
    assert codecs.interleave(b"abcde") == b"acebd" and codecs.predict(b"\x05\x06") == b"\x05\x81"


@pytest.mark.parametrize("linear", [False, True])
def test_b44_blocks(linear):
    r = np.random.default_rng(1)
    for shape in ((4, 4), (13, 37), (1, 1), (20, 6)):
        plane = (np.cumsum(r.random(shape), axis=1) * 0.05).astype(np.float32)
        data = codecs.b44_pack(plane, linear=linear)
        assert len(data) == 14 * -(-shape[0] // 4) * -(-shape[1] // 4)
        got, used = codecs.b44_unpack(data, *shape, linear)
        assert used == len(data) and np.abs(got - plane).max() < 0.1
        if not linear:
            again, _ = codecs.b44_unpack(codecs.b44_pack(got), *shape)
            assert np.array_equal(again, codecs.b44_unpack(codecs.b44_pack(again), *shape)[0])
    flat = np.full((8, 8), 2.5, np.float32)
    assert len(codecs.b44_pack(flat, flat=True)) == 12 and (codecs.b44_unpack(codecs.b44_pack(flat, flat=True), 8, 8)[0] == 2.5).all()


def test_geometry():
    assert [geometry.level_count(n) for n in (1, 2, 4, 32, 33)] == [1, 2, 3, 6, 6]
    assert [geometry.level_count(n, True) for n in (1, 2, 4, 32, 33)] == [1, 2, 3, 6, 7]
    assert [geometry.level_extent(*x) for x in ((32, 1), (32, 5), (33, 1), (33, 1, True))] == [16, 1, 16, 17]
    assert [len(geometry.levels(w, h, 1)) for w, h in ((32, 32), (16, 8), (1, 1), (7, 7))] == [6, 5, 1, 3]
    assert len(geometry.tiles(13, 9, 4, 4)) == 12


def test_columns_agree_with_kernels(spark):
    r = np.random.default_rng(2)
    bits = np.concatenate([r.integers(0, 2**32, 20_000), r.integers(0x33000000, 0x34800000, 2000), r.integers(0x38000000, 0x39000000, 2000), [0, 0x80000000, 0x7F800000, 0xFF800000, 0x7F800001, 0x7FFFFFFF, 0x477FEFFF, 0x477FF000, 0x4F800000, 0x4F7FFFFF]]).astype(np.uint32)
    x = bits.view(np.float32)
    df = spark.createDataFrame([(int(b),) for b in bits], "b long").withColumn("v", numeric.bits_float("b"))
    b = F.col("b")
    got = df.select(numeric.float_bits("v").alias("same"), numeric.half_code(b).alias("h"), numeric.pxr24_code(b).alias("p"), numeric.uint_quantise(F.col("v")).alias("u"), numeric.pxr24_bits(numeric.pxr24_code(b)).alias("q"), "b").collect()
    assert [g["same"] for g in got] == bits.tolist()
    assert [g["h"] for g in got] == numeric.to_half(x).tolist()
    assert [g["p"] for g in got] == numeric.to_pxr24(x).tolist()
    assert [g["u"] for g in got] == numeric.to_uint(x).tolist()
    codes = spark.range(65536).select(numeric.half_bits(F.col("id")).alias("b"), numeric.key_code(numeric.monotone_key(F.col("id"))).alias("k"), "id").orderBy("id").collect()
    assert [c["b"] for c in codes] == numeric.from_half(np.arange(65536)).view(np.uint32).tolist()
    assert all(c["k"] == (0 if c["id"] & 0x7C00 == 0x7C00 else c["id"]) for c in codes)


def test_header_errors():
    for data in (b"", b"\0" * 20, struct.pack("<II", layout.MAGIC, 1) + b"\0"):
        with pytest.raises((InvalidData, Unsupported)):
            layout.decode_header(data)
