"""The registered queries of the raster engine, with their DuckDB equivalents.

The driver's tables stand in for rasters: a row of `embeddings` is a row of a FLOAT plane 64 wide, or an image of 8 x 8; an
order is a deep pixel (100 a row) and its line items are the samples; texts and pages are byte streams.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import codecs, geometry, numeric
from .operators import pyramid, tables
from .registry import Query, known_oracles, known_queries, query
from .sources import exr
from .sources.layout import Channel, Part

WIDTH, DEEP_WIDTH = 64, 100
#: Levels that the SQL of the pyramids is written for: planes of up to 2 ** SQL_LEVELS - 1 rows, past which SQL would lack levels.
SQL_LEVELS = 24

def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _float(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("float")


# pyramids


def _plane(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    """Rows (y, samples) and their number, 0 for an empty table."""
    rows = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("int").alias("y"), F.col("embedding").alias("samples"))
    most = rows.agg(F.max("y")).first()[0]
    return rows, 0 if most is None else most + 1


_PIXELS = f"""
px AS MATERIALIZED (SELECT CAST(vec_id AS INTEGER) AS y, CAST(i AS INTEGER) AS x, embedding[i + 1] AS v FROM embeddings, range(0, {WIDTH}) AS r(i)),
dims AS MATERIALIZED (SELECT CAST(max(y) + 1 AS INTEGER) AS h FROM px)"""


def _mip_sql(levels: int) -> str:
    out, parts = _PIXELS + ", m0 AS MATERIALIZED (SELECT * FROM px)", ["SELECT 0 AS lvl_x, * FROM m0"]
    for k in range(levels):
        w, h = max(1, WIDTH >> k), f"greatest(1, h >> {k})"
        out += f""",
m{k + 1} AS MATERIALIZED (
  SELECT a.y // 2 AS y, a.x // 2 AS x, CAST(0.25 AS FLOAT) * (((a.v + b.v) + c.v) + d.v) AS v FROM m{k} a JOIN dims ON greatest({WIDTH}, h) >> {k + 1} >= 1
  JOIN m{k} b ON b.y = a.y AND b.x = least(a.x + 1, {w - 1}) JOIN m{k} c ON c.y = least(a.y + 1, {h} - 1) AND c.x = a.x JOIN m{k} d ON d.y = c.y AND d.x = b.x
  WHERE a.y % 2 = 0 AND a.x % 2 = 0 AND a.x < 2 * {max(1, w // 2)} AND a.y < 2 * greatest(1, {h} // 2))"""
        parts.append(f"SELECT {k + 1}, * FROM m{k + 1}")
    return f"WITH {out}\nSELECT lvl_x, lvl_x AS lvl_y, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, v AS value FROM ({' UNION ALL '.join(parts)})"


def _rip_sql(levels: int) -> str:
    out, parts = _PIXELS + ", r0 AS MATERIALIZED (SELECT * FROM px)", ["SELECT 0 AS lvl_x, * FROM r0"]
    for k in range(geometry.level_count(WIDTH) - 1):
        w = WIDTH >> k
        out += f""",
r{k + 1} AS MATERIALIZED (SELECT a.y, a.x // 2 AS x, CAST(0.5 AS FLOAT) * (a.v + b.v) AS v FROM r{k} a JOIN r{k} b ON b.y = a.y AND b.x = least(a.x + 1, {w - 1}) WHERE a.x % 2 = 0 AND a.x < {2 * (w // 2)})"""
        parts.append(f"SELECT {k + 1}, * FROM r{k + 1}")
    out += f",\nc0 AS MATERIALIZED (SELECT * FROM ({' UNION ALL '.join(parts)}))"
    cells = ["SELECT 0 AS lvl_y, * FROM c0"]
    for k in range(levels):
        h = f"greatest(1, h >> {k})"
        out += f""",
c{k + 1} AS MATERIALIZED (
  SELECT a.lvl_x, a.y // 2 AS y, a.x, CAST(0.5 AS FLOAT) * (a.v + b.v) AS v FROM c{k} a JOIN dims ON h >> {k + 1} >= 1
  JOIN c{k} b ON b.lvl_x = a.lvl_x AND b.x = a.x AND b.y = least(a.y + 1, {h} - 1) WHERE a.y % 2 = 0 AND a.y < 2 * greatest(1, {h} // 2))"""
        cells.append(f"SELECT {k + 1}, * FROM c{k + 1}")
    return f"WITH {out}\nSELECT lvl_x, lvl_y, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, v AS value FROM ({' UNION ALL '.join(cells)})"


@query("SELECT y, x, value FROM (" + _mip_sql(1) + ") WHERE lvl_x = 1")
def mip_level1(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, height = _plane(spark, sf_dir)
    return pyramid.as_pixels(pyramid.mip_level(rows, [], WIDTH, height))


@query(_mip_sql(SQL_LEVELS))
def mip_pyramid(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, height = _plane(spark, sf_dir)
    return pyramid.as_pixels(pyramid.mip_pyramid(rows, [], WIDTH, height)).select("lvl_x", "lvl_y", "y", "x", "value")


@query(_rip_sql(SQL_LEVELS))
def ripmap_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, height = _plane(spark, sf_dir)
    return pyramid.as_pixels(pyramid.rip_pyramid(rows, [], WIDTH, height)).select("lvl_x", "lvl_y", "y", "x", "value")


# sample codes


def _bits_sql(v: str) -> str:
    return f"(CAST(CAST(CAST({v} AS FLOAT) AS BIT) AS INTEGER)::BIGINT & 4294967295)"


_PXR24 = """((b & 2147483648) >> 8) + CASE WHEN ((b & 2147483647) + (b & 128)) >> 8 >= 8355840 THEN (b & 2147483647) >> 8 ELSE ((b & 2147483647) + (b & 128)) >> 8 END"""
# round to nearest, ties to even: half a unit less one, and one more if the kept part is odd
_HALF = """((b >> 16) & 32768) + CASE WHEN e < -24 THEN 0
  WHEN e < -14 THEN (m + 8388608 + (1 << CAST(-2 - e AS INTEGER)) - 1 + (((m + 8388608) >> CAST(-1 - e AS INTEGER)) & 1)) >> CAST(-1 - e AS INTEGER)
  ELSE least(31744, ((e + 15) * 8388608 + m + 4095 + ((((e + 15) * 8388608 + m) >> 13) & 1)) >> 13) END"""
_CODES = f"f AS (SELECT *, (b >> 23 & 255) - 127 AS e, b & 8388607 AS m FROM p), h AS (SELECT *, {_HALF} AS code FROM f)"


@query(f"WITH p AS (SELECT l_orderkey, l_linenumber, {_bits_sql('l_extendedprice')} AS b FROM lineitem) SELECT l_orderkey, l_linenumber, {_PXR24} AS code FROM p")
def pxr24_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    bits = numeric.float_bits(_float("l_extendedprice"))
    return _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", bits.alias("b")).select("l_orderkey", "l_linenumber", numeric.pxr24_code(F.col("b")).alias("code"))


def _plane_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows (y, x, code): the 24-bit codes of the plane."""
    rows = pyramid.as_pixels(_plane(spark, sf_dir)[0]).withColumn("b", numeric.float_bits("value"))
    return rows.select("y", "x", numeric.pxr24_code(F.col("b")).alias("code"))


_PLANE_CODES = f"WITH {_PIXELS}, p AS (SELECT y, x, {_bits_sql('v')} AS b FROM px), c AS (SELECT y, x, {_PXR24} AS code FROM p)"


@query(f"{_PLANE_CODES} SELECT y, x, code, (code - coalesce(lag(code) OVER (PARTITION BY y ORDER BY x), 0) + 4294967296) % 4294967296 AS delta FROM c")
def pxr24_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.deltas(_plane_codes(spark, sf_dir), ["y"], "x", "code")


@query(f"{_PLANE_CODES} SELECT y, x, code AS restored FROM c")
def pxr24_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.prefix_codes(tables.deltas(_plane_codes(spark, sf_dir), ["y"], "x", "code"), ["y"], "x").select("y", "x", "restored")


@query(
    f"WITH p AS (SELECT l_orderkey, l_linenumber, {_bits_sql('l_tax / 1000')} AS b, {_bits_sql('l_extendedprice')} AS b2 FROM lineitem), {_CODES},"
    f" g AS (SELECT l_orderkey, l_linenumber, code, b2 AS b FROM h), f2 AS (SELECT *, (b >> 23 & 255) - 127 AS e, b & 8388607 AS m FROM g), h2 AS (SELECT *, {_HALF} AS wide FROM f2)"
    " SELECT l_orderkey, l_linenumber, code, wide, CAST(CASE WHEN code & 31744 = 0 THEN (code & 1023) * power(2.0, -24) ELSE ((code & 1023) + 1024) * power(2.0, (code >> 10 & 31) - 25) END * CASE WHEN code & 32768 = 0 THEN 1 ELSE -1 END AS FLOAT) + CAST(0 AS FLOAT) AS value FROM h2"
)
def half_quantise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half codes of small values (some of them subnormal) and of large ones (some of them infinite)."""
    rows = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", numeric.float_bits(_float(F.col("l_tax") / 1000)).alias("b"), numeric.float_bits(_float("l_extendedprice")).alias("b2"))
    rows = rows.select("l_orderkey", "l_linenumber", numeric.half_code(F.col("b")).alias("code"), numeric.half_code(F.col("b2")).alias("wide"))
    return rows.withColumn("value", (numeric.bits_float(numeric.half_bits(F.col("code"))) + F.lit(0.0).cast("float")).cast("float"))


@query(
    "WITH p AS (SELECT c_custkey, CAST(c_acctbal AS FLOAT) AS v FROM customer), q AS (SELECT c_custkey, CASE WHEN isnan(v) OR v < 0 THEN 0 WHEN v >= 4294967296 THEN 4294967295 ELSE CAST(trunc(v + CAST(0.5 AS FLOAT)) AS BIGINT) END AS code FROM p)"
    " SELECT c_custkey, code, CAST(code AS FLOAT) AS value FROM q"
)
def uint_quantise(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "customer").select("c_custkey", numeric.uint_quantise(F.col("c_acctbal")).cast("long").alias("code"))
    return rows.withColumn("value", numeric.uint_widen(F.col("code")))


@query(
    "WITH p AS (SELECT p_partkey // 100 AS y, p_partkey % 100 AS x, CAST(p_retailprice / 1500 AS FLOAT) AS r, CAST(p_size / 50.0 - 0.1 AS FLOAT) AS g FROM part),"
    " q AS (SELECT y, x, least(greatest(r, CAST(0 AS FLOAT)), CAST(1 AS FLOAT)) AS r, least(greatest(g, CAST(0 AS FLOAT)), CAST(1 AS FLOAT)) AS g FROM p)"
    " SELECT CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, CAST(trunc(r * CAST(65535 AS FLOAT) + CAST(0.5 AS FLOAT)) AS INTEGER) AS r, CAST(trunc(g * CAST(65535 AS FLOAT) + CAST(0.5 AS FLOAT)) AS INTEGER) AS g, 0 AS b, 65535 AS a FROM q"
)
def preview_rgba16(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Red and green are there, blue and alpha are not."""
    key, values = F.col("p_partkey"), F.array(F.struct(F.lit("R").alias("channel"), _float(F.col("p_retailprice") / 1500).alias("value")), F.struct(F.lit("G").alias("channel"), _float(F.col("p_size") / F.lit(50.0) - F.lit(0.1)).alias("value")))
    long = _table(spark, sf_dir, "part").select(F.lit("part").alias("path"), F.lit(0).alias("part_no"), F.lit(0).alias("lvl_x"), F.lit(0).alias("lvl_y"), F.floor(key / 100).cast("int").alias("y"), F.pmod(key, F.lit(100)).cast("int").alias("x"), F.explode(values).alias("p"))
    return exr.preview(long.select("path", "part_no", "lvl_x", "lvl_y", "y", "x", "p.channel", "p.value")).drop("path", "part_no")


@query(
    f"WITH p AS (SELECT c_custkey, {_bits_sql('c_acctbal')} AS b FROM customer), {_CODES}, k AS (SELECT c_custkey, code, CASE WHEN code & 31744 = 31744 THEN 32768 WHEN code & 32768 <> 0 THEN 65535 - code ELSE code + 32768 END AS key FROM h)"
    " SELECT c_custkey, code, key, CASE WHEN key >= 32768 THEN key - 32768 ELSE 65535 - key END AS back FROM k"
)
def b44_monotone_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "customer").select("c_custkey", numeric.float_bits(_float("c_acctbal")).alias("b")).select("c_custkey", numeric.half_code(F.col("b")).alias("code"))
    return rows.withColumn("key", numeric.monotone_key(F.col("code"))).withColumn("back", numeric.key_code(F.col("key")))


_BLOCK_PLANE = f"WITH {_PIXELS}, p AS (SELECT y, x, {_bits_sql('v')} AS b FROM px), {_CODES}, c AS (SELECT y, x, CASE WHEN x < 32 THEN y // 8 WHEN code & 32768 <> 0 THEN 65535 - code ELSE code + 32768 END AS key FROM h)"


def _block_plane(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monotone keys on the right half of the plane, and equal values in runs of eight rows on the left."""
    rows = pyramid.as_pixels(_plane(spark, sf_dir)[0]).withColumn("b", numeric.float_bits("value"))
    code = numeric.monotone_key(numeric.half_code(F.col("b")))
    return rows.select("y", "x", F.when(F.col("x") < 32, F.floor(F.col("y") / 8)).otherwise(code).cast("long").alias("key"))


@query(f"{_BLOCK_PLANE} SELECT CAST(y // 4 AS INTEGER) AS by, CAST(x // 4 AS INTEGER) AS bx, CAST(min(key) AS BIGINT) AS low, CAST(max(key) AS BIGINT) AS high, min(key) = max(key) AS flat FROM c GROUP BY ALL")
def b44_flat_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.blocks(_block_plane(spark, sf_dir), [], "key")


@query("SELECT p_partkey, CAST(p_size * 1000 AS INTEGER) AS code, CAST(CAST(p_size * 1000 AS FLOAT) / CAST(65535 AS FLOAT) AS FLOAT) AS value, CAST(trunc(CAST(p_size * 1000 AS FLOAT) / CAST(65535 AS FLOAT) * CAST(65535 AS FLOAT) + CAST(0.5 AS FLOAT)) AS INTEGER) AS again FROM part")
def preview_dequantise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """16-bit codes as numbers from 0 to 1, and back."""
    rows = _table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 1000).cast("int").alias("code"))
    return rows.withColumn("value", numeric.preview_dequantise(F.col("code"))).withColumn("again", numeric.preview_quantise(F.col("value")))


@query(
    "SELECT l_orderkey, l_linenumber, least(greatest(CAST(l_suppkey AS BIGINT) - CAST(l_partkey AS BIGINT) + 1, 0), 4294967295) AS pixels,"
    " least(greatest(CAST(l_suppkey AS BIGINT) * 2147483 - CAST(-2147483648 AS BIGINT) + 1, 0), 4294967295) AS wide FROM lineitem"
)
def box_extents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels between inclusive bounds: none where they cross, and no overflow where they are far apart."""
    rows = _table(spark, sf_dir, "lineitem")
    wide = numeric.box_extent(F.lit(-2_147_483_648), F.col("l_suppkey") * 2_147_483)
    return rows.select("l_orderkey", "l_linenumber", numeric.box_extent(F.col("l_partkey"), F.col("l_suppkey")).alias("pixels"), wide.alias("wide"))


@query(f"WITH p AS (SELECT c_custkey, {_bits_sql('c_acctbal')} AS b FROM customer), {_CODES} SELECT c_custkey, code, CAST(CASE WHEN code & 31744 = 0 THEN (code & 1023) * power(2.0, -24) ELSE ((code & 1023) + 1024) * power(2.0, (code >> 10 & 31) - 25) END * CASE WHEN code & 32768 = 0 THEN 1 ELSE -1 END AS FLOAT) + CAST(0 AS FLOAT) AS value FROM h")
def half_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The numpy kernels that chunk bodies use, on the same rule as the Column expressions."""
    rows = _table(spark, sf_dir, "customer").select("c_custkey", numeric.half_kernel_code(_float("c_acctbal")).alias("code"))
    return rows.withColumn("value", (numeric.half_kernel_value("code") + F.lit(0.0).cast("float")).cast("float"))


# deep pixels


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows (o_orderkey, y, x, n) of the deep image; an order without line items is a pixel without samples."""
    n = _table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n"))
    key = F.col("o_orderkey")
    rows = _table(spark, sf_dir, "orders").select("o_orderkey").join(n, "o_orderkey", "left")
    return rows.select("o_orderkey", F.floor(key / DEEP_WIDTH).cast("int").alias("y"), F.pmod(key, F.lit(DEEP_WIDTH)).cast("int").alias("x"), F.coalesce("n", F.lit(0)).alias("n"))


_DEEP = f"""WITH n AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1),
d AS (SELECT o_orderkey, CAST(o_orderkey // {DEEP_WIDTH} AS INTEGER) AS y, CAST(o_orderkey % {DEEP_WIDTH} AS INTEGER) AS x, coalesce(n, 0) AS n FROM orders LEFT JOIN n ON l_orderkey = o_orderkey)"""


@query(f"{_DEEP} SELECT y, x, n FROM d")
def deep_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counts(spark, sf_dir).select("y", "x", "n")


@query(f"{_DEEP} SELECT y, x, n, CAST(sum(n) OVER (PARTITION BY y ORDER BY x) AS BIGINT) AS cumulative FROM d")
def deep_cumulative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.inclusive_counts(deep_counts(spark, sf_dir), ["y"])


@query(f"{_DEEP} SELECT y, x, n FROM d")
def deep_counts_from_cumulative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.counts_of(deep_cumulative(spark, sf_dir).drop("n"), ["y"]).select("y", "x", "n")


@query(f"{_DEEP} SELECT y, x, CAST(x // 16 AS INTEGER) AS tx, n, CAST(sum(n) OVER (PARTITION BY y, x // 16 ORDER BY x) AS BIGINT) AS cumulative FROM d")
def deep_tile_cumulative(spark: SparkSession, sf_dir: str) -> DataFrame:
    tiled = deep_counts(spark, sf_dir).select("y", "x", F.floor(F.col("x") / 16).cast("int").alias("tx"), "n")
    return tables.inclusive_counts(tiled, ["y", "tx"])


@query(f"{_DEEP} SELECT o_orderkey, n, CAST(coalesce(sum(n) OVER (ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS offset FROM d".replace("AS offset", 'AS "offset"'))
def deep_sample_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.running_offsets(_counts(spark, sf_dir).select("o_orderkey", "n"), [], "o_orderkey", "n")


@query(f"{_DEEP} SELECT y, CAST(max(n) AS BIGINT) AS most, CAST(sum(n) AS BIGINT) AS total FROM d GROUP BY y")
def deep_max_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most samples of a pixel and the number of samples, for each row."""
    return _counts(spark, sf_dir).groupBy("y").agg(F.coalesce(F.max("n"), F.lit(0)).alias("most"), F.sum("n").alias("total"))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def missing_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of the expected grid that no chunk covers."""
    return _table(spark, sf_dir, "orders").select("o_orderkey").join(_table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti")


@query("SELECT l_orderkey, l_linenumber, count(*) AS chunks FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def repeated_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("chunks")).where("chunks > 1")


# geometry


_SIZES = "WITH s AS (SELECT p_partkey, p_partkey % 500 + 1 AS w, CAST(p_size AS BIGINT) * 10 AS h FROM part)"


def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "part").select("p_partkey", (F.pmod("p_partkey", F.lit(500)) + 1).alias("w"), (F.col("p_size").cast("long") * 10).alias("h"))


@query(f"{_SIZES} SELECT p_partkey, (w + 31) // 32 AS tiles_x, (h + 15) // 16 AS tiles_y, ((w + 31) // 32) * ((h + 15) // 16) AS tiles, h AS rows1, (h + 15) // 16 AS rows16, (h + 31) // 32 AS rows32, (h + 255) // 256 AS rows256 FROM s")
def chunk_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of an image in tiles of 32 x 16, and in blocks of 1, 16, 32 and 256 rows."""
    w, h, n = F.col("w"), F.col("h"), geometry.parts_of
    blocks = [n(h, rows).alias(f"rows{rows}") for rows in sorted({rows for _, rows in geometry.COMPRESSIONS.values()})]
    return _sizes(spark, sf_dir).select("p_partkey", n(w, 32).alias("tiles_x"), n(h, 16).alias("tiles_y"), (n(w, 32) * n(h, 16)).alias("tiles"), *blocks)


def _level_sql(up: bool) -> str:
    add = "+ 1" if up else ""
    return f"""l{int(up)} AS (
  SELECT p_partkey, 0 AS lvl, w, h FROM s UNION ALL
  SELECT p_partkey, lvl + 1, greatest(1, (w {add}) // 2), greatest(1, (h {add}) // 2) FROM l{int(up)} WHERE greatest(w, h) > 1)"""


@query(f"{_SIZES.replace('WITH', 'WITH RECURSIVE')}, {_level_sql(False)}, {_level_sql(True)} SELECT p_partkey, false AS up, CAST(lvl AS BIGINT) AS lvl, w, h FROM l0 UNION ALL SELECT p_partkey, true, lvl, w, h FROM l1")
def level_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The extents of every mip level, rounded down and up."""
    sizes, out = _sizes(spark, sf_dir), []
    for up in (False, True):
        n = geometry.level_count_of(F.greatest("w", "h"), up)
        levels = sizes.select("*", F.lit(up).alias("up"), F.explode(F.sequence(F.lit(0).cast("long"), n.cast("long") - 1)).alias("lvl"))
        out.append(levels.select("p_partkey", "up", "lvl", *[geometry.level_extent_of(F.col(c), F.col("lvl"), up).alias(c) for c in "wh"]))
    return out[0].unionByName(out[1])


_TILED_SUM = "CAST(sum(((greatest(1, w >> CAST({x} AS INTEGER)) + 31) // 32) * ((greatest(1, h >> CAST({y} AS INTEGER)) + 15) // 16)) AS BIGINT)"


@query(
    f"{_SIZES}, m AS (SELECT p_partkey, {_TILED_SUM.format(x='l', y='l')} AS mip_tiles FROM s, range(0, 20) AS r(l) WHERE greatest(w, h) >> CAST(l AS INTEGER) >= 1 GROUP BY 1),"
    f" r AS (SELECT p_partkey, {_TILED_SUM.format(x='a', y='b')} AS rip_tiles FROM s, range(0, 20) AS x(a), range(0, 20) AS y(b) WHERE w >> CAST(a AS INTEGER) >= 1 AND h >> CAST(b AS INTEGER) >= 1 GROUP BY 1)"
    " SELECT p_partkey, mip_tiles, rip_tiles FROM m JOIN r USING (p_partkey)"
)
def tile_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles of 32 x 16 over all mip levels, and over all rip cells, of each image. Sums over short arrays, no shuffle."""
    w, h = F.col("w"), F.col("h")
    count = lambda e: F.sequence(F.lit(0).cast("long"), geometry.level_count_of(e).cast("long") - 1)
    across = lambda l: geometry.parts_of(geometry.level_extent_of(w, l), 32)  # noqa: E731, E741
    down = lambda l: geometry.parts_of(geometry.level_extent_of(h, l), 16)  # noqa: E731, E741
    total = lambda levels, f: F.aggregate(levels, F.lit(0).cast("long"), lambda n, l: n + f(l))  # noqa: E731, E741
    return _sizes(spark, sf_dir).select("p_partkey", total(count(F.greatest(w, h)), lambda l: across(l) * down(l)).alias("mip_tiles"), (total(count(w), across) * total(count(h), down)).alias("rip_tiles"))  # noqa: E741


@query(f"WITH {_PIXELS} SELECT CAST(y // 24 AS INTEGER) AS ty, CAST(x // 24 AS INTEGER) AS tx, CAST(count(DISTINCT y) AS BIGINT) AS rows, CAST(count(DISTINCT x) AS BIGINT) AS columns, count(*) AS pixels FROM px GROUP BY 1, 2".replace("AS rows", 'AS "rows"').replace("AS columns", 'AS "columns"'))
def tile_extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels dealt to tiles of 24 x 24; tiles at the right and lower edge are cut."""
    rows = pyramid.as_pixels(_plane(spark, sf_dir)[0])
    tiles = rows.groupBy(F.floor(F.col("y") / 24).cast("int").alias("ty"), F.floor(F.col("x") / 24).cast("int").alias("tx"))
    span = lambda c: (F.max(c) - F.min(c) + 1).cast("long")
    return tiles.agg(span("y").alias("rows"), span("x").alias("columns"), F.count(F.lit(1)).alias("pixels"))


@query(f"WITH {_PIXELS} SELECT CAST(y // 2 AS INTEGER) AS y, CAST(x // 2 AS INTEGER) AS x, v AS value FROM px WHERE y % 2 = 0 AND x % 2 = 0")
def subsample_plane(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every second sample of every second row; rows are filtered before they are spread."""
    rows = _plane(spark, sf_dir)[0].where(F.pmod("y", F.lit(2)) == 0)
    kept = rows.select(F.floor(F.col("y") / 2).cast("int").alias("y"), F.filter("samples", lambda _, i: F.pmod(i, F.lit(2)) == 0).alias("samples"))
    return pyramid.as_pixels(kept)


@query(f"{_SIZES} SELECT p_partkey, (w + 1) // 2 AS half_w, (h + 2) // 3 AS third_h FROM s")
def subsampled_extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = _sizes(spark, sf_dir)
    return sizes.select("p_partkey", numeric.subsampled(F.col("w"), F.lit(2)).alias("half_w"), numeric.subsampled(F.col("h"), F.lit(3)).alias("third_h"))


@query(f"WITH {_PIXELS} SELECT y, CAST(x // 4 AS INTEGER) AS x, max(CASE WHEN x % 4 = 3 THEN v END) AS a, max(CASE WHEN x % 4 = 2 THEN v END) AS b, max(CASE WHEN x % 4 = 1 THEN v END) AS g, max(CASE WHEN x % 4 = 0 THEN v END) AS r FROM px GROUP BY y, x // 4")
def rgba_deinterleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interleaved red, green, blue and alpha as four columns, within each row's array."""
    quads = F.transform(F.sequence(F.lit(0), (F.size("samples") / 4).cast("int") - 1), lambda i: F.struct(*[F.get("samples", 4 * i + k).alias(c) for k, c in ((3, "a"), (2, "b"), (1, "g"), (0, "r"))]))
    return _plane(spark, sf_dir)[0].select("y", F.posexplode(quads).alias("x", "p")).select("y", "x", "p.a", "p.b", "p.g", "p.r")


# byte streams


_BYTES = "WITH t AS ({source}), u AS (SELECT k, regexp_extract_all(hex(encode(t)), '..') AS v FROM t), c AS (SELECT k, unnest(v) AS h, generate_subscripts(v, 1) - 1 AS i, len(v) AS n FROM u), b AS (SELECT k, CAST('0x' || h AS INTEGER) AS b, i, n FROM c)"
_DOC_BYTES = _BYTES.format(source="SELECT doc_id AS k, text AS t FROM documents")
_PAGE_BYTES = _BYTES.format(source="SELECT page_id AS k, html AS t FROM pages")
#: The bytes of each row of a table, null for null and nothing for an empty text.
_HEX = "SELECT {key}, CASE WHEN {text} IS NOT NULL THEN coalesce(h.bytes, '') END AS bytes FROM {table} LEFT JOIN (SELECT k, string_agg(printf('%02X', {value}), '' ORDER BY {order}) AS bytes FROM {rows} GROUP BY k) h ON k = {key}"


def _doc_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("b"))


@query(_DOC_BYTES + ", d AS (SELECT k, i, CASE WHEN i = 0 THEN b ELSE (b - lag(b) OVER (PARTITION BY k ORDER BY i) + 384) % 256 END AS d FROM b) " + _HEX.format(key="doc_id", text="text", table="documents", value="d", order="i", rows="d"))
def zip_predictor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _doc_bytes(spark, sf_dir).select("doc_id", F.hex(codecs.on_bytes(codecs.predict)("b")).alias("bytes"))


@query(_DOC_BYTES + " " + _HEX.format(key="doc_id", text="text", table="documents", value="b", order="i % 2, i", rows="b"))
def zip_interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _doc_bytes(spark, sf_dir).select("doc_id", F.hex(codecs.on_bytes(codecs.interleave)("b")).alias("bytes"))


@query("SELECT doc_id, hex(encode(text)) AS bytes FROM documents")
def zip_uninterleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = _doc_bytes(spark, sf_dir).select("doc_id", codecs.on_bytes(codecs.interleave)("b").alias("b"))
    return mixed.select("doc_id", F.hex(codecs.on_bytes(codecs.uninterleave)("b")).alias("bytes"))


@query("SELECT page_id, hex(encode(html)) AS bytes FROM pages")
def zip_unpredictor(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", codecs.on_bytes(codecs.predict)(F.col("html").cast("binary")).alias("d"))
    return pages.select("page_id", F.hex(codecs.on_bytes(codecs.unpredict)("d")).alias("bytes"))


@query(
    _PAGE_BYTES + ", m AS (SELECT k, i, b, CASE WHEN b = lag(b) OVER (PARTITION BY k ORDER BY i) THEN 0 ELSE 1 END AS begins FROM b), r AS (SELECT *, sum(begins) OVER (PARTITION BY k ORDER BY i) AS run FROM m)"
    " SELECT k AS page_id, CAST(min(i) AS INTEGER) AS start, count(*) AS length, b AS byte FROM r GROUP BY k, run, b HAVING count(*) >= 2"
)
def rle_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _table(spark, sf_dir, "pages").select("page_id", F.explode(codecs.run_column()(F.col("html").cast("binary"))).alias("r"))
    return found.select("page_id", "r.start", "r.length", "r.byte")


def _coded(codec: str):
    """Whether bytes survive a codec, and the bytes it takes, as a Column function."""

    @F.arrow_udf("struct<same:boolean,shorter:boolean>")
    def apply(x):
        import pyarrow as pa

        packed = [None if v is None else codecs.pack(v, codec) for v in x.to_pylist()]
        same = [None if p is None else codecs.unpack(p, len(v), codec) == v for p, v in zip(packed, x.to_pylist(), strict=True)]
        return pa.StructArray.from_arrays([pa.array(same, pa.bool_()), pa.array([None if p is None else len(p) <= len(v) for p, v in zip(packed, x.to_pylist(), strict=True)], pa.bool_())], names=["same", "shorter"])

    return apply


@query("SELECT page_id, codec, CASE WHEN html IS NOT NULL THEN true END AS same, CASE WHEN html IS NOT NULL THEN true END AS shorter FROM pages, (VALUES ('NONE'), ('RLE'), ('ZIP'), ('ZIPS')) AS c(codec)")
def codec_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page under every lossless byte codec: it comes back, and never takes more bytes than it has."""
    pages = _table(spark, sf_dir, "pages").select("page_id", F.col("html").cast("binary").alias("b"))
    out = None
    for codec in ("NONE", "RLE", "ZIP", "ZIPS"):
        own = pages.withColumn("r", _coded(codec)("b")).select("page_id", F.lit(codec).alias("codec"), "r.same", "r.shorter")
        out = own if out is None else out.union(own)
    return out


@query('SELECT source, doc_id, CAST(octet_length(encode(text)) AS BIGINT) AS size, CAST(coalesce(sum(octet_length(encode(text))) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM documents')
def chunk_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each text would start in a file of all texts of its source."""
    rows = _table(spark, sf_dir, "documents").select("source", "doc_id", F.octet_length("text").cast("long").alias("size"))
    return tables.running_offsets(rows, ["source"], "doc_id", "size")


# headers


@query(
    "WITH t AS (SELECT event_id, CAST(hour(ts) AS BIGINT) AS h, CAST(minute(ts) AS BIGINT) AS m, CAST(second(ts) AS BIGINT) AS s, event_id % 24 AS f FROM events)"
    " SELECT event_id, ((h // 10 * 16 + h % 10) << 24) + ((m // 10 * 16 + m % 10) << 16) + ((s // 10 * 16 + s % 10) << 8) + f // 10 * 16 + f % 10 AS word,"
    " CAST(h AS INTEGER) AS hours, CAST(m AS INTEGER) AS minutes, CAST(s AS INTEGER) AS seconds, CAST(f AS INTEGER) AS frames FROM t"
)
def timecode_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    word = tables.timecode(F.hour("ts"), F.minute("ts"), F.second("ts"), F.pmod("event_id", F.lit(24)))
    rows = _table(spark, sf_dir, "events").select("event_id", word.alias("word"))
    fields = {"hours": (24, 3), "minutes": (16, 7), "seconds": (8, 7), "frames": (0, 3)}
    return rows.select("event_id", "word", *[tables.timecode_field(F.col("word"), shift, tens).alias(k) for k, (shift, tens) in fields.items()])


@query(f"{_SIZES} SELECT p_brand, CAST(max(w) AS BIGINT) AS w, CAST(max(h) AS BIGINT) AS h FROM s JOIN part USING (p_partkey) GROUP BY 1")
def display_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The window that all parts of a file share: the largest width and height."""
    part = _table(spark, sf_dir, "part").select("p_brand", (F.pmod("p_partkey", F.lit(500)) + 1).alias("w"), (F.col("p_size").cast("long") * 10).alias("h"))
    return part.groupBy("p_brand").agg(F.max("w").alias("w"), F.max("h").alias("h"))


@query("SELECT p_name, count(*) AS parts FROM part GROUP BY 1 HAVING count(*) > 1 OR coalesce(p_name, '') = ''")
def part_name_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.repeated_names(_table(spark, sf_dir, "part"), "p_name")


@query(
    "SELECT user_id, arg_min(value, event_id) FILTER (event_type = 'view') AS required, coalesce(arg_min(value, event_id) FILTER (event_type = 'error'), 1.0) AS aspect, CAST(count(*) AS BIGINT) AS attributes FROM events GROUP BY 1"
)
def required_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first attribute of a name in each header, and one with a default; user_id stands for the file."""
    first = lambda name: F.min_by(F.when(F.col("event_type") == name, F.col("value")), F.when(F.col("event_type") == name, F.col("event_id")))
    rows = _table(spark, sf_dir, "events").groupBy("user_id")
    return rows.agg(first("view").alias("required"), F.coalesce(first("error"), F.lit(1.0)).alias("aspect"), F.count(F.lit(1)).alias("attributes"))


@query(
    "SELECT l_orderkey, l_linenumber, CAST(l_quantity AS INTEGER) AS mode, CAST(l_quantity AS INTEGER) & 15 AS level_mode, CAST(l_quantity AS INTEGER) >> 4 AS round_mode, (2 | CASE WHEN l_returnflag = 'R' THEN 4096 ELSE 0 END) & 4096 <> 0 AS multipart FROM lineitem"
)
def header_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nibbles of a tile description's mode byte, and the multi-part bit of a version word."""
    mode, version = F.col("l_quantity").cast("int"), F.lit(2).bitwiseOR(F.when(F.col("l_returnflag") == "R", 4096).otherwise(0))
    return _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", mode.alias("mode"), mode.bitwiseAND(15).alias("level_mode"), F.shiftright(mode, 4).alias("round_mode"), (version.bitwiseAND(4096) != 0).alias("multipart"))


# files: tables written as images and read back

_SIDE = 8


def _image_rows(spark: SparkSession, sf_dir: str, channels: tuple[str, ...] = ("Y",)) -> DataFrame:
    """A file of 8 x 8 pixels for each vector; every channel has the vector's values."""
    rows = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("path"), F.lit(0).alias("part_no"), F.lit(0).alias("lvl_x"), F.lit(0).alias("lvl_y"), "embedding", F.explode(F.sequence(F.lit(0), F.lit(_SIDE - 1))).alias("y"))
    rows = rows.withColumn("channel", F.explode(F.array(*[F.lit(c) for c in channels])))
    return rows.select("path", "part_no", "lvl_x", "lvl_y", "channel", "y", F.slice("embedding", F.col("y") * _SIDE + 1, F.lit(_SIDE)).alias("samples"), F.lit(None).cast("array<int>").alias("counts"))


def _image(codec: str, kind: str = "scanlineimage", pixel: str = "FLOAT", channels: tuple[str, ...] = ("Y",), **more) -> list[Part]:
    return [Part(_SIDE, _SIDE, [Channel(c, pixel) for c in channels], kind=kind, codec=codec, tile=(4, 4), **more)]


def _read_back(rows: DataFrame, spec: list[Part]) -> DataFrame:
    got = exr.pixels(exr.lines_of(exr.encode(rows, spec)))
    return got.select(F.col("path").cast("long").alias("vec_id"), "y", "x", "value")


_IDENTITY = f"SELECT vec_id, CAST(i // {_SIDE} AS INTEGER) AS y, CAST(i % {_SIDE} AS INTEGER) AS x, {{value}} AS value FROM embeddings, range(0, {WIDTH}) AS r(i)"
_SAME = _IDENTITY.format(value="embedding[i + 1]")


@query(_SAME)
def exr_roundtrip_scanline_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read_back(_image_rows(spark, sf_dir), _image("ZIP"))


@query(_SAME)
def exr_roundtrip_scanline_zips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read_back(_image_rows(spark, sf_dir), _image("ZIPS"))


@query(_SAME)
def exr_roundtrip_tiled_rle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read_back(_image_rows(spark, sf_dir), _image("RLE", "tiledimage"))


@query(_SAME)
def exr_roundtrip_tiled_none(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read_back(_image_rows(spark, sf_dir), _image("NONE", "tiledimage"))


@query(f"WITH p AS (SELECT vec_id, y, x, {_bits_sql('value')} AS b FROM ({_SAME})) SELECT vec_id, y, x, CAST(CAST(CAST((({_PXR24}) & 8388607) << 8 AS INTEGER) AS BIT) AS FLOAT) * CASE WHEN b >= 2147483648 THEN -1 ELSE 1 END AS value FROM p")
def exr_roundtrip_scanline_pxr24(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read_back(_image_rows(spark, sf_dir), _image("PXR24"))


@query(f"SELECT vec_id AS vec_id, CAST(lvl AS INTEGER) AS lvl_x, 'Y' AS channel, CAST({_SIDE} >> CAST(lvl AS INTEGER) AS INTEGER) AS side, CAST(({_SIDE} >> CAST(lvl AS INTEGER)) * ({_SIDE} >> CAST(lvl AS INTEGER)) AS BIGINT) AS pixels FROM embeddings, range(0, 4) AS r(lvl)")
def exr_roundtrip_mipmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pyramids made, written as mip levels and read back: the extents and pixels of each level."""
    base = _image_rows(spark, sf_dir)
    levels = pyramid.mip_pyramid(base.select("path", "y", "samples"), ["path"], _SIDE, _SIDE)
    rows = levels.select("path", F.lit(0).alias("part_no"), "lvl_x", "lvl_y", F.lit("Y").alias("channel"), "y", "samples", F.lit(None).cast("array<int>").alias("counts"))
    got = exr.pixels(exr.lines_of(exr.encode(rows, _image("ZIP", "tiledimage", mode=geometry.MIPMAP)), "tiled_multilevel"))
    return got.groupBy(F.col("path").cast("long").alias("vec_id"), "lvl_x", "channel").agg((F.max("x") + 1).alias("side"), F.count(F.lit(1)).alias("pixels"))


def _deep_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A deep file of one row of 100 pixels for each hundred orders: prices of the line items, in order."""
    prices = _table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sort_array(F.collect_list("l_extendedprice")).cast("array<float>").alias("s"))
    pixel = _table(spark, sf_dir, "orders").select("o_orderkey").join(prices, "o_orderkey", "left")
    pixel = pixel.select(F.floor(F.col("o_orderkey") / DEEP_WIDTH).cast("string").alias("path"), F.struct("o_orderkey", F.coalesce("s", F.array().cast("array<float>")).alias("s")).alias("p"))
    row = pixel.groupBy("path").agg(F.sort_array(F.collect_list("p")).alias("p"))
    return row.select("path", *[F.lit(0).alias(c) for c in ("part_no", "lvl_x", "lvl_y")], F.lit("Z").alias("channel"), F.lit(0).alias("y"), F.flatten("p.s").alias("samples"), F.transform("p", lambda p: F.size(p["s"])).alias("counts"))


_SAMPLES = f"SELECT CAST(l_orderkey // {DEEP_WIDTH} AS BIGINT) AS file, CAST(l_orderkey % {DEEP_WIDTH} AS INTEGER) AS x, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice) - 1 AS INTEGER) AS sample_idx, CAST(l_extendedprice AS FLOAT) AS value FROM lineitem"


def _deep_back(spark: SparkSession, sf_dir: str, part: Part) -> DataFrame:
    got = exr.deep_samples(exr.lines_of(exr.encode(_deep_rows(spark, sf_dir), [part])))
    return got.select(F.col("path").cast("long").alias("file"), "x", "sample_idx", "value")


@query(_SAMPLES)
def exr_roundtrip_deep_scanline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _deep_back(spark, sf_dir, Part(DEEP_WIDTH, 1, [Channel("Z", "FLOAT")], kind="deepscanline", codec="ZIPS"))


@query(_SAMPLES)
def exr_roundtrip_deep_tiled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _deep_back(spark, sf_dir, Part(DEEP_WIDTH, 1, [Channel("Z", "FLOAT")], kind="deeptile", codec="RLE", tile=(16, 16)))


@query(f"SELECT vec_id, part_no, 'tiledimage' AS kind, 'RLE' AS codec, CAST({_SIDE} AS BIGINT) AS width, CAST({_SIDE} AS BIGINT) AS height, CAST(4 AS BIGINT) AS chunks FROM embeddings, (SELECT 0 AS part_no)")
def exr_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = exr.parts(exr.encode(_image_rows(spark, sf_dir), _image("RLE", "tiledimage")))
    return made.select(F.col("path").cast("long").alias("vec_id"), "part_no", "kind", "codec", "width", "height", "chunks")


@query("SELECT vec_id, CAST(i AS INTEGER) AS ch_idx, ['A', 'B', 'G', 'R'][i + 1] AS name, 'HALF' AS pixel_type, 1 AS x_sampling, 1 AS y_sampling FROM embeddings, range(0, 4) AS r(i)")
def exr_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("A", "B", "G", "R")
    made = exr.channels(exr.encode(_image_rows(spark, sf_dir, names), _image("ZIP", pixel="HALF", channels=names)))
    return made.select(F.col("path").cast("long").alias("vec_id"), "ch_idx", "name", "pixel_type", "x_sampling", "y_sampling")


def queries() -> dict[str, Query]:
    return known_queries()


def oracle_sql() -> dict[str, str]:
    return known_oracles()


from . import catalog_files, catalog_reading  # noqa: E402, F401  registers the queries on files
