"""The registered queries on reading in part, on damaged and unfilled files, on the sink, and on lossy blocks, each beside its SQL."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import _CODES, _IDENTITY, _SIDE, _bits_sql, _image, _image_rows, _read_back
from .catalog_files import (
    _DEEP, _FLAT_FILES, _OWN_LEVELS, HIGH, KEYS, MIP, RIP, WIDE, _deep_pair, _flat_blocks, _levels_of, _mode_levels, _multi_levels, _multi_sql, _pair_sql, _twice, _two_parts, _two_rows, _TWO_SQL,
    as_part, deep_part, deep_rows, deep_sql, deep_values, file_no, flat_part, flat_rows, flat_values, img_sql, part_sql, pyramid_sql, stored, whole,
)
from .functions import blocks44, codecs, geometry, numeric
from .plans.lineage import new_folder
from .registry import query
from .sources import datasource, exr, layout
from .sources.layout import Channel, Part


def _saved(made: DataFrame) -> str:
    """The folder of the files that rows (path, content) tell."""
    folder = new_folder(made.sparkSession, "files")
    exr.save(made, folder).collect()
    return folder


# reading in part


@query(f"SELECT * FROM ({_multi_sql(MIP)}) AS t WHERE part_no = 1 AND lvl_x IN (1, 2) AND y < 3")
def exr_pushed_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filters on part, level and row, which reach the source: other chunks are not read."""
    datasource.register(spark)
    folder = stored(_multi_levels(spark, sf_dir, MIP), _two_parts("ZIP", "tiledimage", (MIP, MIP)))
    got = spark.read.format("exr").option("split_bytes", "8000").load(folder).where("part_no = 1 AND lvl_x IN (1, 2) AND y < 3")
    return flat_values(got)


_WINDOW = (21, 13, 50, 33)


@query(
    f"WITH {img_sql()}, {pyramid_sql('r', RIP)}, w AS ({part_sql('r', levels=_OWN_LEVELS)}) SELECT * FROM w WHERE lvl_x <= 3 AND lvl_y <= 2"
    f" AND x BETWEEN {_WINDOW[0]} >> lvl_x AND {_WINDOW[2]} >> lvl_x AND y BETWEEN {_WINDOW[1]} >> lvl_y AND {_WINDOW[3]} >> lvl_y"
)
def exr_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A window across cut tiles on twelve levels of a rip pyramid."""
    folder = stored(_levels_of(spark, sf_dir, RIP), [flat_part("ZIP", "tiledimage", mode=RIP)])
    return flat_values(exr.region(spark, folder, _WINDOW, ((0, 3), (0, 2))))


@query(f"WITH {_DEEP}, d AS ({deep_sql(0, MIP)}) SELECT * FROM d WHERE lvl_x = 1 AND channel = 'Z' AND x BETWEEN 2 AND 7 AND y BETWEEN 1 AND 2")
def exr_deep_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A window of deep tiles, with one of two channels."""
    folder = stored(deep_rows(spark, sf_dir, _mode_levels(MIP)), [deep_part("ZIPS", "deeptile", mode=MIP)])
    return deep_values(exr.region(spark, folder, (4, 3, 15, 5), ((1, 1), (1, 1)), ["Z"]))


# the sink


@query(_TWO_SQL)
def exr_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """df.write.format("exr") of rows of samples, all of a file in one task, and back."""
    datasource.register(spark)
    folder, spec = new_folder(spark, "files"), _two_parts("PXR24", "scanlineimage")
    spec = [Part(p.width, p.height, p.channels, p.kind, "ZIP", p.name) for p in spec]
    _two_rows(spark, sf_dir).repartition("path").write.format("exr").option("parts", exr.parts_json(spec)).mode("append").save(folder)
    return flat_values(spark.read.format("exr").option("entry", "multipart").load(folder))


@query(_pair_sql(RIP))
def exr_sink_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sink of pieces: chunks of deep tiles and levels that many tasks have encoded."""
    datasource.register(spark)
    folder, spec = new_folder(spark, "files"), _deep_pair("deeptile", RIP)
    exr.prepared(_twice(spark, sf_dir, RIP), spec).write.format("exr").option("rows", "pieces").option("parts", exr.parts_json(spec)).mode("overwrite").save(folder)
    return deep_values(spark.read.format("exr").option("entry", "multipart_deep_tiled_ripmap").load(folder))


# tables that are not filled in


def _unfilled_parts() -> list[Part]:
    return [flat_part("ZIP", "tiledimage", 24, 20, name="levels", mode=MIP), flat_part("RLE", width=24, height=20, name="lines")]


_SMALL = "x < 24 AND y < 20"


@query(f"WITH {img_sql()}, {pyramid_sql('m', MIP, 24, 20)}, a AS ({part_sql('m', levels=_OWN_LEVELS)} UNION ALL {part_sql(part_no=1, where=_SMALL)}) SELECT reader, a.* FROM a, (VALUES ('format'), ('ranges'), ('whole')) AS r(reader)")
def exr_unfilled_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offset tables that are zero (even files) or zero from the middle on (odd ones), through all three readers."""
    datasource.register(spark)
    rows, spec = flat_rows(spark, sf_dir), _unfilled_parts()
    from .catalog_files import _pyramid, crop

    small = crop(rows, 24, 20)
    made = exr.encode(as_part(_pyramid(small, MIP, 24, 20)).union(as_part(small, 1)), spec)
    base, n = len(layout.encode_headers(spec, [0, 0])), sum(p.count for p in spec)
    kept = F.when(F.pmod(F.col("path").cast("long"), F.lit(2)) == 0, 0).otherwise(n // 2)
    zeros = F.substring(F.lit(bytes(8 * n)), F.lit(1), 8 * (n - kept))
    content = F.concat(F.substring("content", F.lit(1), base + 8 * kept), zeros, F.substring("content", F.lit(base + 8 * n + 1), F.octet_length("content")))
    folder = _saved(made.select("path", content.alias("content")))
    readers = {"format": spark.read.format("exr").load(folder), "ranges": exr.lines(exr.read_chunks(spark, folder, split_bytes=4000)), "whole": exr.lines(exr.chunks(exr.files(spark, folder)))}
    found = [exr.pixels(df).select(F.lit(name).alias("reader"), file_no(), *KEYS, "value") for name, df in readers.items()]
    return found[0].union(found[1]).union(found[2])


# damage


def _damage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Files by number modulo 4: as they are, a chunk that is no zlib stream, an offset of a chunk inside the header, no magic number."""
    for batch in batches:
        out = []
        for path, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
            plan, kind = layout.plan_of(data, len(data)), int(path) % 4
            at = plan.at + 8 * kind
            if kind == 1:
                at = struct.unpack_from("<Q", data, at)[0] + layout.KINDS[plan.parts[0].kind]
                data = data[:at] + b"\xff" * 8 + data[at + 8 :]
            elif kind == 2:
                data = data[:at] + struct.pack("<Q", 3) + data[at + 8 :]
            elif kind == 3:
                data = b"\0" + data[1:]
            out.append(data)
        yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(out, pa.binary())], names=["path", "content"])


_LINES_OF_FILE = f"""f AS (SELECT unnest(range(0, {_FLAT_FILES})) AS file),
bad AS (SELECT file, CASE file % 4 WHEN 1 THEN 'zlib' WHEN 2 THEN 'an offset outside the file' WHEN 3 THEN 'no magic number' END AS what, 1 AS n FROM f WHERE file % 4 > 0),
good AS (SELECT file, '' AS what, {HIGH} - CASE file % 4 WHEN 1 THEN 16 WHEN 2 THEN {HIGH - 32} ELSE 0 END AS n FROM f WHERE file % 4 < 3)"""


def _told(lines: DataFrame, mode: str) -> DataFrame:
    what = F.regexp_extract("error", r"^InvalidData: ([^:]+)", 1) if "error" in lines.columns else F.lit("")
    return lines.groupBy(file_no(), F.coalesce(what, F.lit("")).alias("what")).agg(F.count(F.lit(1)).alias("lines")).select(F.lit(mode).alias("mode"), "file", "what", "lines")


@query(
    f"WITH {_LINES_OF_FILE} SELECT 'PERMISSIVE' AS mode, file, what, CAST(n AS BIGINT) AS lines FROM (SELECT * FROM bad UNION ALL SELECT * FROM good) AS t"
    " UNION ALL SELECT 'DROPMALFORMED', file, what, CAST(n AS BIGINT) FROM good"
)
def exr_damaged_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with each damaged chunk or file, and how many lines the sound chunks give, by the mode of reading."""
    datasource.register(spark)
    made = exr.encode(as_part(flat_rows(spark, sf_dir), channels={"Y": whole("samples")}), [flat_part("ZIP")])  # whole numbers are packed
    folder = _saved(made.mapInArrow(_damage, "path string, content binary"))
    told = exr.lines(exr.read_chunks(spark, folder, mode=exr.PERMISSIVE), mode=exr.PERMISSIVE)
    return _told(told, exr.PERMISSIVE).union(_told(spark.read.format("exr").option("mode", "dropmalformed").load(folder), exr.DROPMALFORMED))


# levels that are rounded up


def _up_levels(rows: DataFrame, mode: int) -> DataFrame:
    """Levels rounded up: pixel (x, y) of level (lx, ly) is pixel (x 2 ** lx, y 2 ** ly) of the first."""
    cells = F.explode(F.array(*[F.struct(F.lit(1 << lx).alias("sx"), F.lit(1 << ly).alias("sy"), F.lit(lx).alias("lvl_x"), F.lit(ly).alias("lvl_y")) for lx, ly in geometry.levels(WIDE, HIGH, mode, True)]))
    made = rows.select("*", cells.alias("c")).select("path", "y", "samples", "c.*").where("y % sy = 0")
    return made.select("path", "lvl_x", "lvl_y", F.floor(F.col("y") / F.col("sy")).cast("int").alias("y"), F.filter("samples", lambda _, i: F.pmod(i, F.col("sx")) == 0).alias("samples"))


def _up_sql(part_no: int, mode: int) -> str:
    cells = ", ".join(str(c) for c in geometry.levels(WIDE, HIGH, mode, True))
    return f"SELECT file, {part_no} AS part_no, lvl_x, lvl_y, 'Y' AS channel, y >> lvl_y AS y, x >> lvl_x AS x, v AS value FROM img, (VALUES {cells}) AS c(lvl_x, lvl_y) WHERE x % (1 << lvl_x) = 0 AND y % (1 << lvl_y) = 0"


@query(f"WITH {img_sql()} {_up_sql(0, MIP)} UNION ALL {_up_sql(1, RIP)}")
def exr_rounded_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mip and rip levels whose sizes are rounded up, with their values."""
    rows = flat_rows(spark, sf_dir)
    made = as_part(_up_levels(rows, MIP)).union(as_part(_up_levels(rows, RIP), 1))
    spec = [flat_part("ZIP", "tiledimage", name=n, mode=m, up=True) for n, m in (("mip", MIP), ("rip", RIP))]
    return flat_values(exr.read_lines(spark, stored(made, spec), "multipart_tiled_multilevel"))


# headers


def _first_window(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Two more data windows before all attributes: one as many pixels wide as the file's number, and another."""
    for batch in batches:
        out = []
        for path, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
            more = b"".join(b"dataWindow\0box2i\0" + struct.pack("<i4i", 16, 0, 0, w, 5) for w in (int(path), 7))
            out.append(data[:8] + more + data[8:])
        yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(out, pa.binary())], names=["path", "content"])


@query(f"SELECT f AS file, CAST(f + 1 AS BIGINT) AS width, CAST(6 AS BIGINT) AS height, CAST(3 AS BIGINT) AS windows FROM (SELECT unnest(range(0, {_FLAT_FILES})) AS f)")
def exr_repeated_attribute(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first attribute of a name counts, and all are listed."""
    made = exr.encode(as_part(flat_rows(spark, sf_dir)), [flat_part()]).mapInArrow(_first_window, "path string, content binary")
    windows = exr.attributes(made).where("name = 'dataWindow'").groupBy(file_no()).agg(F.count(F.lit(1)).alias("windows"))
    return exr.parts(made).select(file_no(), "width", "height").join(windows, "file")


# lossy blocks


_EDGE_LIST = "[" + ", ".join(f"[{a}, {b}]" for a, b in codecs.EDGES) + "]"
_KEY = "CASE WHEN code & 31744 = 31744 THEN 32768 WHEN code & 32768 <> 0 THEN 65535 - code ELSE code + 32768 END"
_BACK_VALUE = "CAST(CASE WHEN back & 31744 = 0 THEN (back & 1023) * power(2.0, -24) ELSE ((back & 1023) + 1024) * power(2.0, (back >> 10 & 31) - 25) END * CASE WHEN back & 32768 = 0 THEN 1 ELSE -1 END AS FLOAT)"


def _b44_sql(pixels: str, width: int, height: str) -> str:
    """CTEs that end in `kept`: id, y, x, shift and back, the code that a block gives back, of pixels (id, y, x, b). Blocks repeat edge samples."""
    return f"""p AS ({pixels}), {_CODES}, k AS MATERIALIZED (SELECT id, y, x, {_KEY} AS key FROM h),
cells AS (SELECT id, row4, col4, i FROM (SELECT DISTINCT id, y // 4 AS row4 FROM k) AS q, range(0, {-(-width // 4)}) AS c(col4), range(0, 16) AS r(i)),
blk AS (
  SELECT c.id, row4, col4, list(key ORDER BY i) AS t FROM cells c JOIN k ON k.id = c.id AND k.y = least(4 * row4 + i // 4, {height} - 1) AND k.x = least(4 * col4 + i % 4, {width - 1}) GROUP BY c.id, row4, col4),
cand AS (SELECT id, row4, col4, s, list_max(t) AS top, list_transform(t, lambda v: (2 * (list_max(t) - v) + (1 << s) - 1 + ((2 * (list_max(t) - v) >> (s + 1)) & 1)) >> (s + 1)) AS d FROM blk, range(0, 17) AS r(s)),
fit AS (SELECT *, row_number() OVER (PARTITION BY id, row4, col4 ORDER BY s) AS nth FROM cand WHERE len(list_filter({_EDGE_LIST}, lambda e: d[e[1] + 1] - d[e[2] + 1] NOT BETWEEN -32 AND 31)) = 0),
back AS (SELECT id, CAST(4 * row4 + i // 4 AS INTEGER) AS y, CAST(4 * col4 + i % 4 AS INTEGER) AS x, s AS shift, (top - (d[i + 1] << s)) & 65535 AS key FROM fit, range(0, 16) AS r(i) WHERE nth = 1),
kept AS (SELECT id, y, x, shift, CASE WHEN key >= 32768 THEN key - 32768 ELSE 65535 - key END AS back FROM back WHERE x < {width} AND y < {height})"""


_VECTOR_PIXELS = f"SELECT vec_id AS id, y, x, {_bits_sql('value')} AS b FROM ({_IDENTITY.format(value='embedding[i + 1]')})"


@query(f"WITH {_b44_sql(_VECTOR_PIXELS, _SIDE, str(_SIDE))} SELECT id AS vec_id, y, x, {_BACK_VALUE} AS value FROM kept")
def exr_roundtrip_tiled_b44(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lossy blocks of any values: SQL searches each block's shift, too."""
    return _read_back(_image_rows(spark, sf_dir), _image("B44", "tiledimage", "HALF"))


@query(f"WITH {_b44_sql(_VECTOR_PIXELS, _SIDE, str(_SIDE))} SELECT id AS vec_id, y, x, CAST(shift AS INTEGER) AS shift, CAST(back AS BIGINT) AS code FROM kept")
def b44_block_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search for a block's shift as Column expressions: the shift and the code of each pixel."""
    cells = F.posexplode(F.transform("embedding", lambda v: v.cast("float"))).alias("i", "v")
    pixels = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", cells).withColumn("key", numeric.monotone_key(numeric.half_code(numeric.float_bits("v"))))
    y, x = F.floor(F.col("i") / _SIDE).cast("int"), F.pmod("i", F.lit(_SIDE))
    inside = F.pmod(y, F.lit(4)) * 4 + F.pmod(x, F.lit(4))
    blocks = pixels.groupBy("vec_id", F.floor(y / 4).cast("int").alias("by"), F.floor(x / 4).cast("int").alias("bx")).agg(F.sort_array(F.collect_list(F.struct(inside.alias("at"), "key"))).alias("k"))
    blocks = blocks.withColumn("keys", F.col("k.key")).withColumn("top", F.array_max("keys"))
    blocks = blocks.withColumn("shift", blocks44.shift_of(F.col("keys"), F.col("top")))
    back = blocks.select("vec_id", "by", "bx", "shift", F.posexplode(blocks44.restored(F.col("keys"), F.col("top"), F.col("shift"))).alias("at", "key"))
    return back.select("vec_id", (F.col("by") * 4 + F.floor(F.col("at") / 4)).cast("int").alias("y"), (F.col("bx") * 4 + F.pmod("at", F.lit(4))).cast("int").alias("x"), "shift", numeric.key_code(F.col("key")).alias("code"))


_IMG_PIXELS = f"SELECT file AS id, y, x, {_bits_sql('v')} AS b FROM img"


@query(f"WITH {img_sql()}, {_b44_sql(_IMG_PIXELS, WIDE, str(HIGH))} SELECT id AS file, 0 AS part_no, 0 AS lvl_x, 0 AS lvl_y, 'Y' AS channel, y, x, {_BACK_VALUE} AS value FROM kept")
def exr_b44_any_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of any values in blocks of 32 rows, the last of them cut, where edge samples are repeated."""
    folder = stored(as_part(flat_rows(spark, sf_dir)), [flat_part("B44", pixel="HALF")])
    return flat_values(exr.read_lines(spark, folder, "single"))


@query(f"WITH {img_sql()}, t AS (SELECT file, y, CAST(floor(64 * CAST(v AS DOUBLE)) AS FLOAT) AS value FROM img WHERE x = 0) SELECT file, y, value, CAST(2 * CASE WHEN y < 32 THEN 32 ELSE {HIGH - 32} END AS BIGINT) AS payload FROM t")
def exr_b44_raw_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where blocks would take more bytes than samples (one pixel wide), chunks hold the samples as they are."""
    rows = flat_rows(spark, sf_dir).withColumn("samples", F.slice(whole("samples"), 1, 1))
    packed = exr.read_chunks(spark, stored(as_part(rows), [flat_part("B44", width=1, pixel="HALF")]), "single")
    sizes = packed.select(file_no(), F.col("ty").alias("_ty"), F.octet_length("payload").cast("long").alias("payload"))
    values = exr.pixels(exr.lines(packed)).select(file_no(), "y", "value", F.floor(F.col("y") / 32).cast("int").alias("_ty"))
    return values.join(sizes, ["file", "_ty"]).select("file", "y", "value", "payload")


# perceptually linear channels


def _half_sql(name: str, source: str, value: str, keep: str) -> str:
    """CTEs that end in {name}: columns `keep` of source and code, the half of a value."""
    codes = _CODES.replace("f AS", f"{name}_f AS").replace("FROM p)", f"FROM {name}_p)").replace("h AS", f"{name} AS").replace("FROM f)", f"FROM {name}_f)")
    return f"{name}_p AS (SELECT {keep}, {_bits_sql(value)} AS b FROM {source}), {codes}"


_VALUE_OF = _BACK_VALUE.replace("back", "{code}")
_EXP, _LN = "CAST(exp(CAST({v} AS DOUBLE) / 8) AS FLOAT)", "CASE WHEN {v} > 0 THEN CAST(8 * ln(CAST({v} AS DOUBLE)) AS FLOAT) END"


@query(
    f"WITH p0 AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity / 4 - 3 AS FLOAT) AS v FROM lineitem), {_half_sql('c', 'p0', 'v', 'l_orderkey, l_linenumber')},"
    f" x AS (SELECT l_orderkey, l_linenumber, code AS own, {_VALUE_OF.format(code='code')} AS v FROM c), {_half_sql('f', 'x', _EXP.format(v='v'), 'l_orderkey, l_linenumber, own, v')},"
    f" y AS (SELECT l_orderkey, l_linenumber, own, v, code AS forward FROM f), {_half_sql('g', 'y', 'coalesce(' + _LN.format(v='v') + ', 0)', 'l_orderkey, l_linenumber, own, v, forward')}"
    " SELECT l_orderkey, l_linenumber, CAST(own AS BIGINT) AS code, CAST(forward AS BIGINT) AS forward, CAST(CASE WHEN v = 0 THEN 64512 WHEN v < 0 THEN 0 ELSE code END AS BIGINT) AS back FROM g"
)
def linear_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half codes looked up in the tables of perceptually linear channels, a relation of 65,536 rows that is broadcast."""
    value = (F.col("l_quantity") / 4 - 3).cast("float")
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", numeric.float_bits(value).alias("b")).select("l_orderkey", "l_linenumber", numeric.half_code(F.col("b")).alias("code"))
    return rows.join(F.broadcast(numeric.linear_relation(spark)), "code").select("l_orderkey", "l_linenumber", "code", "forward", "back")


_BLOCK_VALUE = "CAST((x // 4 + 7 * (y // 4) + file) % 5 * 2 AS FLOAT)"


@query(
    f"WITH {img_sql()}, p0 AS (SELECT file, y, x, {_BLOCK_VALUE} AS v FROM img), {_half_sql('f', 'p0', _EXP.format(v='v'), 'file, y, x')}, e AS (SELECT file, y, x, {_VALUE_OF.format(code='code')} AS v FROM f),"
    f" {_half_sql('g', 'e', 'coalesce(' + _LN.format(v='v') + ', 0)', 'file, y, x')} SELECT file, 0 AS part_no, 0 AS lvl_x, 0 AS lvl_y, 'Y' AS channel, y, x, {_VALUE_OF.format(code='code')} AS value FROM g"
)
def exr_linear_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A perceptually linear channel through B44: its samples go through the tables and back."""
    rows = flat_rows(spark, sf_dir).withColumn("samples", _flat_blocks())
    folder = stored(as_part(rows), [Part(WIDE, HIGH, [Channel("Y", "HALF", linear=True)], codec="B44A")])
    return flat_values(exr.read_lines(spark, folder, "single"))


# the table function


@query(f"WITH {img_sql()} {part_sql()}")
def exr_table_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files in a binary column, decoded by a table function in SQL."""
    datasource.register(spark)
    made = exr.encode(as_part(flat_rows(spark, sf_dir)), [flat_part("RLE")])
    lines = spark.sql("SELECT * FROM exr_lines(TABLE(SELECT path, content FROM {made}))", made=made)
    return flat_values(lines)


# refusals, by planted damage to deep files


def _deep_damage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Files by number modulo 10; see _REFUSED."""
    for batch in batches:
        out = []
        for path, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
            plan, kind = layout.plan_of(data, len(data)), int(path) % 10
            entry = lambda k: struct.unpack_from("<Q", data, plan.at + 8 * k)[0]  # noqa: B023, E731  used at once
            value = lambda name, type_name: data.index(f"{name}\0{type_name}\0".encode()) + len(name) + len(type_name) + 6  # noqa: B023, E731
            at, new = {
                1: lambda: (value("compression", "compression"), b"\4"), 2: lambda: (value("compression", "compression"), b"\3"), 3: lambda: (value("chunkCount", "int"), struct.pack("<i", 7)),
                4: lambda: (entry(1), struct.pack("<i", 99)), 5: lambda: (entry(1) + 32, struct.pack("<Q", 1 << 40)), 6: lambda: (entry(1) + 24, struct.pack("<Q", 1 << 40)),
                7: lambda: (value("dataWindow", "box2i") + 8, struct.pack("<i", 2**31 - 1)), 8: lambda: (plan.at + 8, data[plan.at : plan.at + 8]), 9: lambda: (entry(1), struct.pack("<i", 0)),
            }.get(kind, lambda: (0, b""))()
            out.append(data[:at] + new + data[at + len(new) :])
        yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(out, pa.binary())], names=["path", "content"])


#: What is told of each kind of damage, and how many lines of 42 can still be read.
_REFUSED = {
    0: ("", 42), 1: ("Unsupported: compression PIZ of a part of type deeptile", 0), 2: ("Unsupported: compression ZIP of a part of type deeptile", 0), 3: ("InvalidData: chunkCount", 0), 4: ("InvalidData: a chunk outside its part", 34),
    5: ("InvalidData: the samples take", 34), 6: ("InvalidData: a chunk is cut off", 34), 7: ("InvalidData: a data window that no file of this size can fill", 0), 8: ("InvalidData: a deep chunk twice", 34), 9: ("InvalidData: a deep chunk twice or missing in part", 34),
}
_DEEP_FILES_SQL = "(SELECT coalesce(max(l_orderkey) // 140 + 1, 0) FROM lineitem)"


@query(
    f"WITH f AS (SELECT unnest(range(0, {_DEEP_FILES_SQL})) AS file), k(kind, what, n) AS (VALUES {', '.join(str((k, *v)) for k, v in _REFUSED.items())})"
    " SELECT file, what, CAST(1 AS BIGINT) AS lines FROM f JOIN k ON kind = file % 10 WHERE kind > 0 UNION ALL SELECT file, '', CAST(n AS BIGINT) FROM f JOIN k ON kind = file % 10 WHERE n > 0"
)
def exr_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is told of unsupported codecs, counts, tiles, sizes and windows that cannot be, and of tiles twice, a chunk at a time."""
    made = exr.encode(deep_rows(spark, sf_dir), [deep_part("RLE", "deeptile")])
    folder = _saved(made.mapInArrow(_deep_damage, "path string, content binary"))
    told = exr.lines(exr.read_chunks(spark, folder, mode=exr.PERMISSIVE), mode=exr.PERMISSIVE)
    what = F.regexp_extract("error", r"^([A-Za-z]+: [^0-9:{]*[a-z])", 1)
    return told.groupBy(file_no(), F.coalesce(what, F.lit("")).alias("what")).agg(F.count(F.lit(1)).alias("lines"))


@query(
    f"WITH f AS (SELECT unnest(range(0, {_FLAT_FILES})) AS file), l(lvl) AS (SELECT unnest(range(0, 7))), x AS (SELECT file, CAST(lvl AS INTEGER) AS lvl, CAST(greatest(1, {HIGH} >> lvl) AS INTEGER) AS h FROM f, l)"
    " SELECT file, 0 AS part_no, lvl AS lvl_x, lvl AS lvl_y, 'Y' AS channel, h AS expected, h - CASE file % 4 WHEN 1 THEN 1 WHEN 2 THEN 1 ELSE 0 END AS found, CASE file % 4 WHEN 2 THEN 1 WHEN 3 THEN 1 ELSE 0 END AS wrong FROM x WHERE file % 4 > 0 AND lvl = 1"
)
def exr_shape_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pyramids are looked at before they are written: level 1 lacks a line, has a shorter one, or one too many, by the file."""
    kind, hit = F.pmod(F.col("path").cast("long"), F.lit(4)), (F.col("lvl_x") == 1) & (F.col("y") == 2)
    rows = _levels_of(spark, sf_dir, MIP).where(~(hit & (kind == 1)))
    rows = rows.withColumn("samples", F.when(hit & (kind == 2), F.slice("samples", 1, 5)).otherwise(F.col("samples")))
    more = rows.where(hit & (kind == 3)).withColumn("y", F.lit(1000))
    found = exr.shape_faults(rows.union(more), [flat_part("ZIP", "tiledimage", mode=MIP)])
    return found.select(file_no(), "part_no", "lvl_x", "lvl_y", "channel", "expected", "found", "wrong")


@query(f"WITH f AS (SELECT unnest(range(0, {_DEEP_FILES_SQL})) AS file) SELECT file, count(l_orderkey) AS samples, CAST(coalesce(max(n), 0) AS BIGINT) AS most FROM f LEFT JOIN (SELECT l_orderkey, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem) ON l_orderkey // 140 = file GROUP BY file")
def exr_total_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The samples of a deep file and the most of a pixel, from its tables of counts."""
    lines = exr.read_lines(spark, stored(deep_rows(spark, sf_dir), [deep_part("RLE", "deeptile")]), "deep_tiled", ["Z"])
    own = F.aggregate("counts", F.lit(0).cast("long"), lambda n, x: n + x)
    return lines.groupBy(file_no()).agg(F.sum(own).alias("samples"), F.max(F.array_max("counts")).cast("long").alias("most"))
