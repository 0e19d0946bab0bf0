"""The registered queries on files: tables written as images of several blocks and cut tiles, and read back, values and all.

Flat images have 64 x 37 pixels: a row is an embedding, and 37 vectors make a file. Deep images have
20 x 7 pixels: a pixel is an order, its samples are the prices of its line items. Rows and pixels that the tables do not fill
are 0 and without samples.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import geometry
from .operators import pyramid
from .plans.lineage import new_folder
from .registry import query
from .sources import alike, datasource, exr
from .sources.layout import Channel, Part
from .streaming.frames import stream_lines

WIDE, HIGH = 64, 37
DEEP_WIDE, DEEP_HIGH = 20, 7
DEEP_PIXELS = DEEP_WIDE * DEEP_HIGH
TILE, DEEP_TILE = (24, 16), (8, 4)
MIP, RIP = geometry.MIPMAP, geometry.RIPMAP


# fixtures


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _files(df: DataFrame, key: str, per_file: int) -> int:
    most = df.agg(F.max(key)).first()[0]
    return 0 if most is None else most // per_file + 1


def flat_rows(spark: SparkSession, sf_dir: str, files: int | None = None) -> DataFrame:
    """Rows (path, y, samples) of the flat images."""
    e = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    n = _files(e, "vec_id", HIGH) if files is None else files
    zeros = F.array_repeat(F.lit(0.0).cast("float"), WIDE)
    rows = spark.range(n * HIGH).join(e, F.col("id") == F.col("vec_id"), "left")
    return rows.select(F.floor(F.col("id") / HIGH).cast("string").alias("path"), F.pmod("id", F.lit(HIGH)).cast("int").alias("y"), F.coalesce("embedding", zeros).alias("samples"))


def crop(rows: DataFrame, width: int, height: int) -> DataFrame:
    return rows.where(F.col("y") < height).withColumn("samples", F.slice("samples", 1, width))


def as_part(rows: DataFrame, part_no: int = 0, channels: dict[str, Column] | None = None) -> DataFrame:
    """Rows for the writer; channels maps names to samples, Y to the rows' own if it is left out."""
    levels = [F.col(c) if c in rows.columns else F.lit(0).alias(c) for c in ("lvl_x", "lvl_y")]
    named = F.explode(F.array(*[F.struct(F.lit(k).alias("channel"), v.alias("samples")) for k, v in (channels or {"Y": F.col("samples")}).items()])).alias("_c")
    return rows.select("path", F.lit(part_no).alias("part_no"), *levels, "y", named).select("path", "part_no", "lvl_x", "lvl_y", "_c.channel", "y", "_c.samples", F.lit(None).cast("array<int>").alias("counts"))


def whole(samples: Column | str) -> Column:
    """64 x as whole numbers, which all pixel types hold but for the sign of UINT."""
    return F.transform(samples, lambda x: F.floor(x.cast("double") * 64).cast("float"))


def deep_pixels(spark: SparkSession, sf_dir: str, files: int | None = None) -> DataFrame:
    """Rows (path, y0, x0, s) of the pixels of deep images: s are the prices of an order's line items."""
    items = _table(spark, sf_dir, "lineitem")
    n = _files(items, "l_orderkey", DEEP_PIXELS) if files is None else files
    prices = items.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.col("l_extendedprice").cast("float"))).alias("s"))
    pixels = spark.range(n * DEEP_PIXELS).join(prices, F.col("id") == F.col("l_orderkey"), "left")
    own = F.pmod("id", F.lit(DEEP_PIXELS))
    return pixels.select(F.floor(F.col("id") / DEEP_PIXELS).cast("string").alias("path"), F.floor(own / DEEP_WIDE).cast("int").alias("y0"), F.pmod(own, F.lit(DEEP_WIDE)).cast("int").alias("x0"), F.coalesce("s", F.array().cast("array<float>")).alias("s"))


def deep_rows(spark: SparkSession, sf_dir: str, levels: list[tuple[int, int]] = [(0, 0)], part_no: int = 0, pixels: DataFrame | None = None) -> DataFrame:  # noqa: B006  not changed
    """Rows for the writer of the deep images; pixel (x, y) of a level is pixel (x 2^lvl_x, y 2^lvl_y) of the first."""
    pixels = deep_pixels(spark, sf_dir) if pixels is None else pixels
    cells = F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in (("lvl_x", lx), ("lvl_y", ly), ("sx", 1 << lx), ("sy", 1 << ly), ("w", geometry.level_extent(DEEP_WIDE, lx)), ("h", geometry.level_extent(DEEP_HIGH, ly)))]) for lx, ly in levels])
    own = pixels.groupBy("path", "y0").agg(F.sort_array(F.collect_list(F.struct("x0", "s"))).alias("p"))  # levels are taken from whole rows, which are gathered once
    here = F.filter(cells, lambda c: (F.pmod(F.col("y0"), c["sy"]) == 0) & (F.floor(F.col("y0") / c["sy"]) < c["h"]))
    rows = own.select("path", "y0", "p", F.explode(here).alias("l")).select("path", "y0", "p", "l.*")
    met = F.filter("p", lambda p: (F.pmod(p["x0"], F.col("sx")) == 0) & (F.floor(p["x0"] / F.col("sx")) < F.col("w")))
    rows = rows.select("path", "lvl_x", "lvl_y", F.floor(F.col("y0") / F.col("sy")).cast("int").alias("y"), met.alias("p")).withColumn("samples", F.flatten("p.s"))
    minus = F.transform("samples", lambda x: -x)
    named = F.explode(F.array(*[F.struct(F.lit(k).alias("channel"), v.alias("samples")) for k, v in (("A", minus), ("Z", F.col("samples")))])).alias("_c")
    counts = F.transform("p", lambda p: F.size(p["s"]))
    return rows.select("path", "lvl_x", "lvl_y", "y", counts.alias("counts"), named).select("path", F.lit(part_no).alias("part_no"), "lvl_x", "lvl_y", "_c.channel", "y", "_c.samples", "counts")


def flat_part(codec: str = "ZIP", kind: str = "scanlineimage", width: int = WIDE, height: int = HIGH, channels: tuple[str, ...] = ("Y",), pixel: str = "FLOAT", **more) -> Part:
    return Part(width, height, [Channel(c, pixel) for c in channels], kind=kind, codec=codec, tile=TILE, **more)


def deep_part(codec: str = "ZIPS", kind: str = "deepscanline", **more) -> Part:
    return Part(DEEP_WIDE, DEEP_HIGH, [Channel("A", "FLOAT"), Channel("Z", "FLOAT")], kind=kind, codec=codec, tile=DEEP_TILE, **more)


def stored(rows: DataFrame, spec: list[Part]) -> str:
    """The shared folder that the files of rows are written to."""
    folder = new_folder(rows.sparkSession, "files")
    exr.write(rows, spec, folder).agg(F.sum("bytes")).collect()
    return folder


def file_no() -> Column:
    return F.regexp_extract("path", r"(\d+)(\.exr)?$", 1).cast("long").alias("file")


KEYS = ("part_no", "lvl_x", "lvl_y", "channel", "y", "x")


def flat_values(lines: DataFrame) -> DataFrame:
    """file, KEYS, value of the flat lines; the number is taken from the path once a line, not once a sample."""
    return exr.pixels(lines.withColumn("path", file_no())).select(F.col("path").alias("file"), *KEYS, "value")


def deep_values(lines: DataFrame) -> DataFrame:
    """file, KEYS, sample_idx, value of the deep lines."""
    return exr.deep_samples(lines.withColumn("path", file_no())).select(F.col("path").alias("file"), *KEYS, "sample_idx", "value")


def flat_back(rows: DataFrame, spec: list[Part], entry: str) -> DataFrame:
    """file, part_no, lvl_x, lvl_y, channel, y, x, value of files that were written and read in ranges."""
    return flat_values(exr.read_lines(rows.sparkSession, stored(rows, spec), entry))


def deep_back(rows: DataFrame, spec: list[Part], entry: str) -> DataFrame:
    return deep_values(exr.read_lines(rows.sparkSession, stored(rows, spec), entry))


# the same in SQL

_FLAT_FILES = f"(SELECT coalesce(max(vec_id) // {HIGH} + 1, 0) FROM embeddings)"
_DEEP_FILES = f"(SELECT coalesce(max(l_orderkey) // {DEEP_PIXELS} + 1, 0) FROM lineitem)"


def img_sql(files: str = _FLAT_FILES) -> str:
    return f"""img AS MATERIALIZED (
  SELECT f AS file, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, coalesce(embedding[x + 1], CAST(0 AS FLOAT)) AS v
  FROM (SELECT unnest(range(0, {files})) AS f) CROSS JOIN range(0, {HIGH}) AS ys(y) CROSS JOIN range(0, {WIDE}) AS xs(x) LEFT JOIN embeddings ON vec_id = f * {HIGH} + y)"""


def part_sql(source: str = "img", part_no: int = 0, channel: str = "Y", value: str = "v", where: str = "true", levels: str = "0 AS lvl_x, 0 AS lvl_y") -> str:
    return f"SELECT file, {part_no} AS part_no, {levels}, '{channel}' AS channel, y, x, {value} AS value FROM {source} WHERE {where}"


_WHOLE = "CAST(CAST(floor(64 * CAST(v AS DOUBLE)) AS BIGINT) AS FLOAT)"


def pyramid_sql(name: str, mode: int, width: int = WIDE, height: int = HIGH) -> str:
    """CTEs that end in {name}: file, lvl_x, lvl_y, y, x, v of the pyramid of img's first width x height pixels."""
    out, level, extent = [f"{name}_0 AS MATERIALIZED (SELECT file, y, x, v FROM img WHERE x < {width} AND y < {height})"], geometry.level_count, geometry.level_extent
    if mode == MIP:
        n, parts = level(max(width, height)), []
        for k in range(n - 1):
            w, h, nw, nh = extent(width, k), extent(height, k), extent(width, k + 1), extent(height, k + 1)
            out.append(f"""{name}_{k + 1} AS MATERIALIZED (
  SELECT a.file, a.y // 2 AS y, a.x // 2 AS x, CAST(0.25 AS FLOAT) * (((a.v + b.v) + c.v) + d.v) AS v FROM {name}_{k} a
  JOIN {name}_{k} b ON b.file = a.file AND b.y = a.y AND b.x = least(a.x + 1, {w - 1}) JOIN {name}_{k} c ON c.file = a.file AND c.y = least(a.y + 1, {h - 1}) AND c.x = a.x
  JOIN {name}_{k} d ON d.file = a.file AND d.y = c.y AND d.x = b.x WHERE a.y % 2 = 0 AND a.x % 2 = 0 AND a.x < {2 * nw} AND a.y < {2 * nh})""")
        parts = [f"SELECT file, {k} AS lvl_x, {k} AS lvl_y, y, x, v FROM {name}_{k}" for k in range(n)]
        return ",\n".join([*out, f"{name} AS (" + " UNION ALL ".join(parts) + ")"])
    half = lambda axis, k, size, source, target, more: f"""{target} AS MATERIALIZED (
  SELECT a.file, {'a.y, a.x // 2 AS x' if axis == 'x' else 'a.y // 2 AS y, a.x'}, CAST(0.5 AS FLOAT) * (a.v + b.v) AS v FROM {source} a
  JOIN {source} b ON b.file = a.file AND b.{more} = a.{more} AND b.{axis} = least(a.{axis} + 1, {extent(size, k) - 1}) WHERE a.{axis} % 2 = 0 AND a.{axis} < {2 * extent(size, k + 1)})"""  # noqa: E731
    parts = []
    for lx in range(level(width)):
        if lx:
            out.append(half("x", lx - 1, width, f"{name}_{lx - 1}", f"{name}_{lx}", "y"))
        for ly in range(level(height)):
            own = f"{name}_{lx}" if ly == 0 else f"{name}_{lx}_{ly}"
            if ly:
                out.append(half("y", ly - 1, height, f"{name}_{lx}" if ly == 1 else f"{name}_{lx}_{ly - 1}", own, "x"))
            parts.append(f"SELECT file, {lx} AS lvl_x, {ly} AS lvl_y, y, x, v FROM {own}")
    return ",\n".join([*out, f"{name} AS (" + " UNION ALL ".join(parts) + ")"])


_OWN_LEVELS = "lvl_x, lvl_y"
_DEEP = f"""deep AS MATERIALIZED (
  SELECT l_orderkey // {DEEP_PIXELS} AS file, CAST(l_orderkey % {DEEP_PIXELS} // {DEEP_WIDE} AS INTEGER) AS y, CAST(l_orderkey % {DEEP_WIDE} AS INTEGER) AS x,
    CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY CAST(l_extendedprice AS FLOAT)) - 1 AS INTEGER) AS sample_idx, CAST(l_extendedprice AS FLOAT) AS v FROM lineitem)"""


def deep_sql(part_no: int = 0, mode: int = geometry.ONE_LEVEL) -> str:
    """The samples of all levels of a deep part."""
    found = []
    for lx, ly in geometry.levels(DEEP_WIDE, DEEP_HIGH, mode):
        w, h = geometry.level_extent(DEEP_WIDE, lx), geometry.level_extent(DEEP_HIGH, ly)
        for channel, sign in (("A", "-"), ("Z", "")):
            found.append(f"SELECT file, {part_no} AS part_no, {lx} AS lvl_x, {ly} AS lvl_y, '{channel}' AS channel, y >> {ly} AS y, x >> {lx} AS x, sample_idx, {sign}v AS value FROM deep WHERE x % {1 << lx} = 0 AND y % {1 << ly} = 0 AND x >> {lx} < {w} AND y >> {ly} < {h}")
    return " UNION ALL ".join(found)


def _mode_levels(mode: int) -> list[tuple[int, int]]:
    return geometry.levels(DEEP_WIDE, DEEP_HIGH, mode)


def _pyramid(rows: DataFrame, mode: int, width: int = WIDE, height: int = HIGH) -> DataFrame:
    make = pyramid.mip_pyramid if mode == MIP else pyramid.rip_pyramid
    return make(rows, ["path"], width, height)


# flat images


def _three_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_part(flat_rows(spark, sf_dir), channels={"A": F.col("samples"), "B": whole("samples"), "C": F.transform(whole("samples"), lambda x: F.abs(x))})


_THREE_SQL = " UNION ALL ".join([part_sql(channel="A"), part_sql(channel="B", value=_WHOLE), part_sql(channel="C", value=f"abs({_WHOLE})")])
_THREE_CHANNELS = [Channel("A", "FLOAT"), Channel("B", "HALF"), Channel("C", "UINT")]


def _three(codec: str, kind: str = "scanlineimage", **more) -> list[Part]:
    return [Part(WIDE, HIGH, _THREE_CHANNELS, kind=kind, codec=codec, tile=TILE, **more)]


@query(f"WITH {img_sql()} {_THREE_SQL}")
def exr_scanline_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Channels of all three pixel types in blocks of 16 rows, the last one cut; read as one part."""
    return flat_back(_three_rows(spark, sf_dir), _three("ZIP"), "single")


@query(f"WITH {img_sql()} {_THREE_SQL}")
def exr_scanline_rle_origin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A data window that does not begin at 0, and chunks laid down from the last row to the first."""
    return flat_back(_three_rows(spark, sf_dir), _three("RLE", x0=5, y0=-3, line_order=1), "single")


@query(f"WITH {img_sql()} {_THREE_SQL}")
def exr_tiled_zips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles of 24 x 16, cut at the right and lower edge."""
    return flat_back(_three_rows(spark, sf_dir), _three("ZIPS", "tiledimage"), "single")


@query(f"WITH {img_sql()} {_THREE_SQL}")
def exr_format_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files through spark.read.format("exr"), cut at chunks of a few hundred bytes."""
    datasource.register(spark)
    folder = stored(_three_rows(spark, sf_dir), _three("ZIP", "tiledimage"))
    got = spark.read.format("exr").option("split_bytes", "4000").option("entry", "single").load(folder)
    return flat_values(got)


_FEW = "CAST(1024 + (CAST(floor(64 * CAST(v AS DOUBLE)) AS BIGINT) % 16 + 16) % 16 AS FLOAT)"
_FLAT_BLOCKS = "CAST((x // 4 + 7 * (y // 4) + file) % 5 * 2 AS FLOAT)"


def _few(samples: str) -> Column:
    """Whole numbers from 1024 to 1039: neighbouring half codes, which differences of 6 bits hold."""
    return F.transform(samples, lambda x: (F.pmod(F.floor(x.cast("double") * 64), F.lit(16)) + 1024).cast("float"))


def _flat_blocks() -> Column:
    """Values that are equal in each block of 4 x 4."""
    return F.transform("samples", lambda x, i: (F.pmod(F.floor(i / 4) + 7 * F.floor(F.col("y") / 4) + F.col("path").cast("long"), F.lit(5)) * 2).cast("float"))


_B44_SQL = f"WITH {img_sql()} {part_sql(channel='A', value=_FEW)} UNION ALL {part_sql(channel='B', value=_FLAT_BLOCKS)} UNION ALL {part_sql(channel='C')}"
_B44_CHANNELS = [Channel("A", "HALF"), Channel("B", "HALF"), Channel("C", "FLOAT")]


@query(_B44_SQL)
def exr_scanline_b44(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks whose codes fit the 6-bit differences survive as they are; a FLOAT channel is stored whole."""
    rows = as_part(flat_rows(spark, sf_dir), channels={"A": _few("samples"), "B": _flat_blocks(), "C": F.col("samples")})
    return flat_back(rows, [Part(WIDE, HIGH, _B44_CHANNELS, codec="B44")], "single")


@query(_B44_SQL)
def exr_tiled_b44a(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with 3-byte flat blocks, in tiles."""
    rows = as_part(flat_rows(spark, sf_dir), channels={"A": _few("samples"), "B": _flat_blocks(), "C": F.col("samples")})
    return flat_back(rows, [Part(WIDE, HIGH, _B44_CHANNELS, kind="tiledimage", tile=TILE, codec="B44A")], "single")


@query(f"WITH {img_sql()} SELECT file, CAST(2 AS BIGINT) AS chunks, CAST((8 + 2) * 16 * 3 AS BIGINT) AS payload FROM img GROUP BY file")
def exr_b44a_flat_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat blocks take 3 bytes each: 8 and 2 rows of 16 blocks in blocks of 32 rows."""
    rows = as_part(flat_rows(spark, sf_dir).withColumn("samples", _flat_blocks()))
    got = exr.read_chunks(spark, stored(rows, [flat_part("B44A", pixel="HALF")]), "single")
    return got.groupBy(file_no()).agg(F.count(F.lit(1)).alias("chunks"), F.sum(F.octet_length("payload")).cast("long").alias("payload"))


@query(f"WITH {img_sql()} {part_sql(channel='U', where='x % 2 = 0 AND y % 2 = 0').replace(' y, x,', ' y, x // 2 AS x,')} UNION ALL {part_sql()}")
def exr_subsampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A channel of every second sample of every second row beside a full one."""
    rows = flat_rows(spark, sf_dir)
    half = as_part(rows.where(F.pmod("y", F.lit(2)) == 0), channels={"U": F.filter("samples", lambda _, i: F.pmod(i, F.lit(2)) == 0)})
    return flat_back(half.union(as_part(rows)), [Part(WIDE, HIGH, [Channel("U", "FLOAT", xs=2, ys=2), Channel("Y", "FLOAT")], codec="ZIP")], "single")


_RGBA_SQL = " UNION ALL ".join(part_sql(channel=c, where=f"x % 4 = {k}").replace(" y, x,", " y, x // 4 AS x,") for k, c in ((3, "A"), (2, "B"), (1, "G"), (0, "R")))


@query(f"WITH {img_sql()} {_RGBA_SQL}")
def exr_scanline_rgba(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interleaved red, green, blue and alpha, taken apart and written as four channels."""
    rows = exr.rgba_planes(flat_rows(spark, sf_dir))
    return flat_back(rows, [flat_part("ZIP", width=WIDE // 4, channels=tuple("ABGR"))], "single")


@query(f"WITH {img_sql()} {_RGBA_SQL}")
def exr_tiled_rgba(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = exr.rgba_planes(flat_rows(spark, sf_dir))
    return flat_back(rows, [flat_part("NONE", "tiledimage", width=WIDE // 4, channels=tuple("ABGR"))], "single")


def _two_parts(codec: str, kind: str, modes: tuple[int, int] = (0, 0)) -> list[Part]:
    return [flat_part(codec, kind, name="first", mode=modes[0]), flat_part(codec, kind, 24, 20, name="second", mode=modes[1], display=(0, 0, 23, 19))]


_TWO_SQL = f"WITH {img_sql()} {part_sql()} UNION ALL {part_sql(part_no=1, where='x < 24 AND y < 20')}"


def _two_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = flat_rows(spark, sf_dir)
    return as_part(rows).union(as_part(crop(rows, 24, 20), 1))


@query(_TWO_SQL)
def exr_multipart_scanline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two parts of different size in a file."""
    return flat_back(_two_rows(spark, sf_dir), _two_parts("ZIP", "scanlineimage"), "multipart")


@query(_TWO_SQL)
def exr_multipart_tiled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat_back(_two_rows(spark, sf_dir), _two_parts("RLE", "tiledimage"), "multipart_tiled")


@query(f"WITH {img_sql()} " + " UNION ALL ".join([_RGBA_SQL, _RGBA_SQL.replace("0 AS part_no", "1 AS part_no")]))
def exr_multipart_rgba(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = exr.rgba_planes(flat_rows(spark, sf_dir))
    spec = [flat_part("ZIPS", width=WIDE // 4, channels=tuple("ABGR"), name=n) for n in ("left", "right")]
    return flat_back(rows.unionByName(rows.withColumn("part_no", F.lit(1))), spec, "multipart")


# pyramids


def _levels_of(spark: SparkSession, sf_dir: str, mode: int) -> DataFrame:
    return as_part(_pyramid(flat_rows(spark, sf_dir), mode))


@query(f"WITH {img_sql()}, {pyramid_sql('m', MIP)} {part_sql('m', levels=_OWN_LEVELS)}")
def exr_tiled_mipmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Box-filtered mip levels, written as tiles and read back with their values."""
    return flat_back(_levels_of(spark, sf_dir, MIP), [flat_part("ZIP", "tiledimage", mode=MIP)], "tiled_multilevel")


@query(f"WITH {img_sql()}, {pyramid_sql('r', RIP)} {part_sql('r', levels=_OWN_LEVELS)}")
def exr_tiled_ripmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat_back(_levels_of(spark, sf_dir, RIP), [flat_part("ZIPS", "tiledimage", mode=RIP)], "tiled_multilevel")


@query(f"WITH {img_sql()} {part_sql()}")
def exr_first_level_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reader of single parts gives level (0, 0) of a file with levels, without decoding the others."""
    return flat_back(_levels_of(spark, sf_dir, MIP), [flat_part("ZIP", "tiledimage", mode=MIP)], "single")


_RGBA_IMG = "rgba AS (" + " UNION ALL ".join(f"SELECT file * 4 + {n} AS file, y, x // 4 AS x, v FROM flat WHERE x % 4 = {k}" for n, k in enumerate((3, 2, 1, 0))) + ")"


def _rgba_pyramid_sql(mode: int) -> str:
    """The channels A, B, G, R stand in a file number 4 file + 0 to 3 while the levels are made."""
    made = pyramid_sql("m", mode, WIDE // 4, HIGH).replace("FROM img WHERE", "FROM rgba WHERE")
    return f"WITH {img_sql().replace('img AS', 'flat AS', 1)}, {_RGBA_IMG}, {made} SELECT file // 4 AS file, 0 AS part_no, lvl_x, lvl_y, ['A', 'B', 'G', 'R'][file % 4 + 1] AS channel, y, x, v AS value FROM m"


def _rgba_levels(spark: SparkSession, sf_dir: str, mode: int) -> DataFrame:
    planes = exr.rgba_planes(flat_rows(spark, sf_dir)).select("path", "channel", "y", "samples")
    make = pyramid.mip_pyramid if mode == MIP else pyramid.rip_pyramid
    levels = make(planes, ["path", "channel"], WIDE // 4, HIGH)
    return levels.select("path", F.lit(0).alias("part_no"), "lvl_x", "lvl_y", "channel", "y", "samples", F.lit(None).cast("array<int>").alias("counts"))


@query(_rgba_pyramid_sql(MIP))
def exr_rgba_mipmap_box_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = [flat_part("RLE", "tiledimage", width=WIDE // 4, channels=tuple("ABGR"), mode=MIP)]
    return flat_back(_rgba_levels(spark, sf_dir, MIP), spec, "tiled_multilevel")


@query(_rgba_pyramid_sql(RIP))
def exr_rgba_ripmap_box_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = [flat_part("ZIP", "tiledimage", width=WIDE // 4, channels=tuple("ABGR"), mode=RIP)]
    return flat_back(_rgba_levels(spark, sf_dir, RIP), spec, "tiled_multilevel")


def _multi_sql(mode: int) -> str:
    return f"WITH {img_sql()}, {pyramid_sql('m', mode)}, {pyramid_sql('n', mode, 24, 20)} {part_sql('m', levels=_OWN_LEVELS)} UNION ALL {part_sql('n', 1, levels=_OWN_LEVELS)}"


def _multi_levels(spark: SparkSession, sf_dir: str, mode: int) -> DataFrame:
    rows = flat_rows(spark, sf_dir)
    return as_part(_pyramid(rows, mode)).union(as_part(_pyramid(crop(rows, 24, 20), mode, 24, 20), 1))


@query(_multi_sql(MIP))
def exr_multipart_tiled_mipmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat_back(_multi_levels(spark, sf_dir, MIP), _two_parts("ZIP", "tiledimage", (MIP, MIP)), "multipart_tiled_multilevel")


@query(_multi_sql(RIP))
def exr_multipart_tiled_ripmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat_back(_multi_levels(spark, sf_dir, RIP), _two_parts("NONE", "tiledimage", (RIP, RIP)), "multipart_tiled_multilevel")


def _order_sql(mode: int) -> str:
    cells = [(lx, ly, tx, ty) for tx, ty, lx, ly in geometry.tiles(WIDE, HIGH, *TILE, mode)]
    values = ", ".join(str((lx, ly, tx, ty)) for lx, ly, tx, ty in sorted(cells, key=lambda c: c[::-1]))
    # the order is told by SQL, not by the order of the values
    return f"WITH f AS (SELECT unnest(range(0, {_FLAT_FILES})) AS file), c(lvl_x, lvl_y, tx, ty) AS (VALUES {values}) SELECT file, CAST(row_number() OVER (PARTITION BY file ORDER BY lvl_y, lvl_x, ty, tx) - 1 AS INTEGER) AS chunk_idx, lvl_x, lvl_y, tx, ty FROM f, c"


@query(_order_sql(RIP))
def exr_chunk_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks by number in the file: levels down, levels across, tiles down, tiles across."""
    got = exr.read_chunks(spark, stored(_levels_of(spark, sf_dir, RIP), [flat_part("ZIP", "tiledimage", mode=RIP)]), "tiled_multilevel")
    return got.select(file_no(), "chunk_idx", "lvl_x", "lvl_y", "tx", "ty")


# deep images


@query(f"WITH {_DEEP} {deep_sql()}")
def exr_deep_scanline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deep_back(deep_rows(spark, sf_dir), [deep_part()], "deep_scanline")


@query(f"WITH {_DEEP} {deep_sql()}")
def exr_deep_tiled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles of 8 x 4 on 20 x 7 pixels."""
    return deep_back(deep_rows(spark, sf_dir), [deep_part("RLE", "deeptile")], "deep_tiled")


@query(f"WITH {_DEEP} {deep_sql(0, MIP)}")
def exr_deep_tiled_mipmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels that the caller supplies: deep pixels are never averaged."""
    return deep_back(deep_rows(spark, sf_dir, _mode_levels(MIP)), [deep_part("ZIPS", "deeptile", mode=MIP)], "deep_tiled_mipmap")


@query(f"WITH {_DEEP} {deep_sql(0, RIP)}")
def exr_deep_tiled_ripmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deep_back(deep_rows(spark, sf_dir, _mode_levels(RIP)), [deep_part("NONE", "deeptile", mode=RIP)], "deep_tiled_ripmap")


def _twice(spark: SparkSession, sf_dir: str, mode: int = geometry.ONE_LEVEL) -> DataFrame:
    rows = deep_rows(spark, sf_dir, _mode_levels(mode))
    return rows.union(rows.withColumn("part_no", F.lit(1)))


def _deep_pair(kind: str, mode: int = geometry.ONE_LEVEL) -> list[Part]:
    return [deep_part("ZIPS", kind, name="near", mode=mode), deep_part("NONE", kind, name="far", mode=mode)]


def _pair_sql(mode: int = geometry.ONE_LEVEL) -> str:
    return f"WITH {_DEEP} {deep_sql(0, mode)} UNION ALL {deep_sql(1, mode)}"


@query(_pair_sql())
def exr_multipart_deep_scanline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deep_back(_twice(spark, sf_dir), _deep_pair("deepscanline"), "deep_multipart")


@query(_pair_sql())
def exr_multipart_deep_tiled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deep_back(_twice(spark, sf_dir), _deep_pair("deeptile"), "multipart_deep_tiled")


@query(_pair_sql(MIP))
def exr_multipart_deep_tiled_mipmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deep_back(_twice(spark, sf_dir, MIP), _deep_pair("deeptile", MIP), "multipart_deep_tiled_mipmap")


@query(_pair_sql(RIP))
def exr_multipart_deep_tiled_ripmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deep_back(_twice(spark, sf_dir, RIP), _deep_pair("deeptile", RIP), "multipart_deep_tiled_ripmap")


_MIXED_FILES = f"greatest({_FLAT_FILES}, {_DEEP_FILES})"


def mixed_parts() -> list[Part]:
    """All eight kinds of part in a file."""
    return [
        flat_part("ZIP", name="scanline"), flat_part("RLE", "tiledimage", name="tiles"), flat_part("ZIPS", "tiledimage", 24, 20, name="mip", mode=MIP), flat_part("NONE", "tiledimage", 24, 20, name="rip", mode=RIP),
        deep_part(name="deep"), deep_part("RLE", "deeptile", name="deep tiles"), deep_part("ZIPS", "deeptile", name="deep mip", mode=MIP), deep_part("NONE", "deeptile", name="deep rip", mode=RIP),
    ]


def mixed_rows(spark: SparkSession, sf_dir: str, files: int) -> DataFrame:
    """Rows (file, at, price, samples) of three kinds: prices, with their pixel in at; vectors, with -2 - row; and -1 for each file."""
    items, vectors = _table(spark, sf_dir, "lineitem"), _table(spark, sf_dir, "embeddings")
    price, no_price = F.col("l_extendedprice").cast("float"), F.lit(0.0).cast("float")
    none = F.array().cast("array<float>")  # no null: Spark's writer of Arrow lists goes over a run of nulls again with each row
    of = lambda key, per: F.expr(f"{key} DIV {per}")
    rest = lambda key, per: F.expr(f"CAST({key} % {per} AS INT)")
    return (
        spark.range(files).select(F.col("id").alias("file"), F.lit(-1).alias("at"), no_price.alias("price"), none.alias("samples"))
        .union(vectors.where(F.col("embedding").isNotNull() & F.col("vec_id").between(0, files * HIGH - 1)).select(of("vec_id", HIGH), -2 - rest("vec_id", HIGH), no_price, F.col("embedding").cast("array<float>")))
        .union(items.where(price.isNotNull() & F.col("l_orderkey").between(0, files * DEEP_PIXELS - 1)).select(of("l_orderkey", DEEP_PIXELS), rest("l_orderkey", DEEP_PIXELS), price, none))
    )


def mixed_images(table: pa.Table) -> tuple[list[int], alike.Images]:
    """Numbers and images, by mixed_parts(), of the files of rows as mixed_rows() gives them."""
    numbers, of = np.unique(table.column("file").to_numpy(), return_inverse=True)
    n, at = len(numbers), table.column("at").to_numpy()
    flat, some = np.zeros((n * HIGH, WIDE), np.float32), at < -1
    place = (of * HIGH - 2 - at)[some]
    if len(np.unique(place)) < len(place):
        raise exr.InvalidData("two rows of a channel have the same y")
    vectors = table.column("samples").combine_chunks().filter(pa.array(some))
    ends, values = vectors.offsets.to_numpy(), vectors.values.fill_null(0).to_numpy()
    if np.all(np.diff(ends) == WIDE):
        flat[place] = values[ends[0] : ends[-1]].reshape(-1, WIDE)
    else:
        for i, a, b in zip(place.tolist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            flat[i, : min(b - a, WIDE)] = values[a : min(b, a + WIDE)]
    flat = flat.reshape(n, HIGH, WIDE)
    own = at >= 0
    price, pixel = table.column("price").to_numpy()[own], (of * DEEP_PIXELS + at)[own]
    values = price[np.lexsort((price, pixel))]
    counts = np.bincount(pixel, minlength=n * DEEP_PIXELS)
    counts, starts = (a.reshape(n, DEEP_HIGH, DEEP_WIDE) for a in (counts, counts.cumsum() - counts))
    small = flat[:, :20, :24]
    images = {(no, 0, 0): alike.Flat([flat]) for no in (0, 1)}
    images |= {(2, k, k): alike.Flat([p]) for k, p in enumerate(pyramid.mip_planes(small))} | {(3, *k): alike.Flat([p]) for k, p in pyramid.rip_planes(small).items()}
    for no, mode in ((4, 0), (5, 0), (6, MIP), (7, RIP)):
        for lx, ly in _mode_levels(mode):
            w, h = geometry.level_extent(DEEP_WIDE, lx), geometry.level_extent(DEEP_HIGH, ly)
            images[no, lx, ly] = alike.Deep(*(a[:, :: 1 << ly, :: 1 << lx][:, :h, :w] for a in (counts, starts)), [-values, values])
    return numbers.tolist(), images


@query(
    f"WITH {img_sql(_MIXED_FILES)}, {pyramid_sql('m', MIP, 24, 20)}, {pyramid_sql('r', RIP, 24, 20)}, {_DEEP}, a AS ("
    + " UNION ALL ".join([part_sql(), part_sql(part_no=1), part_sql("m", 2, levels=_OWN_LEVELS), part_sql("r", 3, levels=_OWN_LEVELS)])
    + "), d AS (" + " UNION ALL ".join(deep_sql(no, mode) for no, mode in ((4, 0), (5, 0), (6, MIP), (7, RIP)))
    + ") SELECT file, part_no, lvl_x, lvl_y, channel, y, x, -1 AS sample_idx, value FROM a UNION ALL SELECT file, part_no, lvl_x, lvl_y, channel, y, x, sample_idx, value FROM d"
)
def exr_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All eight kinds of part in each file; flat samples have sample_idx -1."""
    files = max(_files(_table(spark, sf_dir, "embeddings"), "vec_id", HIGH), _files(_table(spark, sf_dir, "lineitem"), "l_orderkey", DEEP_PIXELS))
    folder = new_folder(spark, "files")
    alike.write(mixed_rows(spark, sf_dir, files), mixed_parts(), folder, mixed_images, files).agg(F.sum("bytes")).collect()
    blocks = alike.read(spark, folder, "mixed", files).withColumn("path", file_no())
    return alike.samples(blocks).withColumnRenamed("path", "file")


@query(f"WITH n AS (SELECT l_orderkey // {DEEP_PIXELS} AS file, count(*) AS n FROM lineitem GROUP BY l_orderkey) SELECT f AS file, name, CAST(coalesce(max(n.n), 0) AS BIGINT) AS most FROM (SELECT unnest(range(0, {_DEEP_FILES})) AS f) LEFT JOIN n ON file = f CROSS JOIN (VALUES ('maxSamplesPerPixel')) AS t(name) GROUP BY f, name")
def exr_max_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The attribute that tells the most samples of a pixel, from files."""
    found = exr.attributes(exr.heads(spark, stored(deep_rows(spark, sf_dir), [deep_part()]))).where("name = 'maxSamplesPerPixel'")
    return found.select(file_no(), "name", F.col("ints")[0].alias("most"))


@query(f"SELECT f AS file, CAST(p AS INTEGER) AS part_no, CAST(6 - (f + p) % 2 AS BIGINT) AS chunks, CAST(6 - (f + p) % 2 AS BIGINT) AS places, CAST(6 AS BIGINT) AS expected FROM (SELECT unnest(range(0, {_DEEP_FILES})) AS f), range(0, 2) AS r(p) WHERE (f + p) % 2 = 1 UNION ALL SELECT f, 2, CAST(12 AS BIGINT), CAST(6 AS BIGINT), CAST(6 AS BIGINT) FROM (SELECT unnest(range(0, {_DEEP_FILES})) AS f)")
def exr_incomplete_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts with a chunk missing (every second one of the first two) or with all chunks twice (the third)."""
    rows = deep_rows(spark, sf_dir)
    rows = rows.union(rows.withColumn("part_no", F.lit(1))).union(rows.withColumn("part_no", F.lit(2))).union(rows.withColumn("part_no", F.lit(3)))
    spec = [deep_part("RLE", "deeptile", name=n) for n in "abcd"]
    packed = exr.read_chunks(spark, stored(rows, spec), "any")
    lost = (F.col("part_no") < 2) & (F.pmod(file_no() + F.col("part_no"), F.lit(2)) == 1) & (F.col("chunk_idx") == 3)
    packed = packed.where(~lost)
    return exr.incomplete(packed.union(packed.where("part_no = 2"))).select(file_no(), "part_no", "chunks", "places", "expected")


# headers


def header_specs(n: int) -> dict[str, list[Part]]:
    """Specs whose headers the query of headers reads, by a letter; sizes, windows and tiles go by n."""
    w, h, tile = WIDE + 7 * n, HIGH + n, (16 + n % 9, 8 + n % 5)
    part = lambda codec, kind="scanlineimage", **more: Part(w, h, [Channel("Y", more.pop("pixel", "FLOAT"))], kind=kind, codec=codec, tile=tile, **more)
    return {
        "a": [part("PXR24", x0=n - 5, y0=-3 * n)], "b": [part("B44", "tiledimage", pixel="HALF")], "c": [part("ZIP", "tiledimage", mode=MIP, up=True)], "d": [part("NONE", "tiledimage", mode=RIP)],
        "e": [part("ZIPS", "deepscanline")], "f": [part("NONE", "deeptile", mode=RIP)], "g": [part("ZIPS", name="left"), part("RLE", "deeptile", name=f"right {n}")],
    }


_TILES_ACROSS, _TILES_DOWN = "(greatest(1, {w}) + tx - 1) // tx", "(greatest(1, {h}) + ty - 1) // ty"
# levels by doubling: rounded up while 2 ** k is short of the extent, rounded down while it is no larger
_CHUNKS_SQL = f"""CASE path WHEN 'a' THEN (h + 15) // 16 WHEN 'e' THEN h WHEN 'b' THEN {_TILES_ACROSS.format(w='w')} * ({_TILES_DOWN.format(h='h')})
  WHEN 'c' THEN list_sum([({_TILES_ACROSS.format(w='(w + (1 << k) - 1) >> k')}) * ({_TILES_DOWN.format(h='(h + (1 << k) - 1) >> k')}) FOR k IN range(0, 12) IF k = 0 OR (1 << greatest(k - 1, 0)) < greatest(w, h)])
  WHEN 'g' THEN CASE part_no WHEN 0 THEN h ELSE {_TILES_ACROSS.format(w='w')} * ({_TILES_DOWN.format(h='h')}) END
  ELSE list_sum([{_TILES_ACROSS.format(w='w >> k')} FOR k IN range(0, 12) IF (1 << k) <= w]) * list_sum([{_TILES_DOWN.format(h='h >> k')} FOR k IN range(0, 12) IF (1 << k) <= h]) END"""
_HEADER_ROWS = """('a', 2, 0, '', 'scanlineimage', 'PXR24', 0, false), ('b', 514, 0, '', 'tiledimage', 'B44', 0, false), ('c', 514, 0, '', 'tiledimage', 'ZIP', 1, true), ('d', 514, 0, '', 'tiledimage', 'NONE', 2, false),
('e', 2050, 0, '', 'deepscanline', 'ZIPS', 0, false), ('f', 2050, 0, '', 'deeptile', 'NONE', 2, false), ('g', 6146, 0, 'left', 'scanlineimage', 'ZIPS', 0, false), ('g', 6146, 1, 'right ', 'deeptile', 'RLE', 0, false)"""


@query(
    f"WITH n AS (SELECT n_nationkey, n_nationkey AS n, CAST({WIDE} + 7 * n_nationkey AS BIGINT) AS w, CAST({HIGH} + n_nationkey AS BIGINT) AS h, CAST(16 + n_nationkey % 9 AS BIGINT) AS tx, CAST(8 + n_nationkey % 5 AS BIGINT) AS ty FROM nation),"
    f" k(path, version, part_no, name, kind, codec, mode, up) AS (VALUES {_HEADER_ROWS})"
    f" SELECT n_nationkey, path, CAST(version AS BIGINT) AS version, part_no, CASE WHEN name = 'right ' THEN name || n ELSE name END AS name, kind, codec, w AS width, h AS height, CAST(CASE path WHEN 'a' THEN n - 5 ELSE 0 END AS INTEGER) AS x0,"
    f" CAST(CASE path WHEN 'a' THEN -3 * n ELSE 0 END AS INTEGER) AS y0, CASE WHEN kind IN ('tiledimage', 'deeptile') THEN tx END AS tile_x, CASE WHEN kind IN ('tiledimage', 'deeptile') THEN ty END AS tile_y, mode, up, CAST({_CHUNKS_SQL} AS BIGINT) AS chunks FROM n, k"
)
def exr_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Version words, part types, tile descriptions, windows and chunk counts, from header bytes made by the key of each nation."""
    from .sources import layout

    def headers(batches):
        import pyarrow as pa

        for batch in batches:
            rows = [(f"{n}:{k}", layout.encode_headers(spec, [0] * len(spec))) for n in batch.column(0).to_pylist() for k, spec in header_specs(n).items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary())], names=["path", "content"])

    found = exr.parts(_table(spark, sf_dir, "nation").select("n_nationkey").mapInArrow(headers, "path string, content binary"))
    return found.select(F.split_part("path", F.lit(":"), F.lit(1)).cast("int").alias("n_nationkey"), F.split_part("path", F.lit(":"), F.lit(2)).alias("path"), *[c for c in found.columns if c != "path"])


_EXTRA = {
    "aBox": ("box2f", [0.5, 1.0, 2.0, 3.0]), "aPair": ("v2i", [1, -2]), "aTriple": ("v3f", [0.5, 1.5, -2.0]), "aMatrix": ("m33f", [float(i) for i in range(9)]), "bMatrix": ("m44d", [i / 4 for i in range(16)]), "aRatio": ("rational", [-24000, 4_000_000_000]),
    "aTime": ("timecode", [0x23592924, 7]), "aKey": ("keycode", [10, 5, 123456, 1000, 30, 4, 60]), "aNumber": ("int", [-5]), "aDouble": ("double", [1e300]), "aColour": ("chromaticities", [0.125 * i for i in range(8)]), "owner": ("string", "héllo"), "views": ("stringvector", ["", "a", "é"]),
}
_FIXED = {
    "compression": ("compression", [2]), "dataWindow": ("box2i", [0, 0, WIDE - 1, HIGH - 1]), "displayWindow": ("box2i", [-1, -1, 99, 88]), "lineOrder": ("lineOrder", [1]), "pixelAspectRatio": ("float", [1.25]),
    "screenWindowCenter": ("v2f", [0.5, -0.5]), "screenWindowWidth": ("float", [2.0]), "type": ("string", "scanlineimage"), "chunkCount": ("int", [HIGH]), "name": ("string", "only"),
}


def _shown(value: object) -> str:
    return value if isinstance(value, str) else " ".join(str(v) for v in value)


_ATTRIBUTE_VALUES = ", ".join("('{}', '{}', '{}')".format(k, t, _shown([float(x) for x in v] if t in ("box2f", "v3f", "m33f", "m44d", "double", "chromaticities", "float", "v2f") else v)) for k, (t, v) in {**_EXTRA, **_FIXED}.items())


@query(f"WITH a(name, type_name, value) AS (VALUES {_ATTRIBUTE_VALUES}), f AS (SELECT unnest(range(0, {_FLAT_FILES})) AS file) SELECT file, CAST(row_number() OVER (PARTITION BY file ORDER BY name) - 1 + CASE WHEN name > 'channels' THEN 1 ELSE 0 END AS INTEGER) AS attr_idx, name, type_name, value FROM a, f")
def exr_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attributes of every type, in order of name, from the headers of written files."""
    part = flat_part("ZIPS", name="only", display=(-1, -1, 99, 88), line_order=1, aspect=1.25, center=(0.5, -0.5), screen_width=2.0, extra=[(k, t, v) for k, (t, v) in _EXTRA.items()])
    found = exr.attributes(exr.heads(spark, stored(as_part(flat_rows(spark, sf_dir)), [part]))).where("name <> 'channels'")
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), " ")
    floats = F.array_join(F.transform("floats", lambda x: F.when(x == 1e300, F.lit("1e+300")).otherwise(x.cast("string"))), " ")
    return found.select(file_no(), "attr_idx", "name", "type_name", F.coalesce(text("ints"), floats, "string", text("strings")).alias("value"))


@query(f"WITH f AS (SELECT unnest(range(0, {_FLAT_FILES})) AS file) SELECT file, part_no, CAST(0 AS BIGINT) AS a, CAST(0 AS BIGINT) AS b, CAST({WIDE - 1} AS BIGINT) AS c, CAST({HIGH - 1} AS BIGINT) AS d FROM f, (VALUES (0), (1)) AS p(part_no)")
def exr_shared_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The display window around all parts, which parts without their own share."""
    spec = [flat_part(name="first"), flat_part(width=24, height=20, name="second")]
    found = exr.attributes(exr.heads(spark, stored(_two_rows(spark, sf_dir), spec))).where("name = 'displayWindow'")
    return found.select(file_no(), "part_no", *[F.col("ints")[i].alias(c) for i, c in enumerate("abcd")])


@query(f"WITH {img_sql()} {part_sql()}")
def exr_file_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that a stream finds, decoded as they come."""
    folder, at, name = stored(as_part(flat_rows(spark, sf_dir)), [flat_part()]), new_folder(spark, "files"), f"lines_{uuid.uuid4().hex}"
    run = stream_lines(spark, folder).writeStream.format("parquet").queryName(name).option("path", f"{at}/rows").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return flat_values(spark.read.schema(exr.LINES).parquet(f"{at}/rows"))
