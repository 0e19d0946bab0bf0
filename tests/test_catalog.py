from collections import Counter
from datetime import date, datetime

import duckdb
import pytest

import __spark_entry__ as entry_module
from prismframe import catalog
from prismframe.operators import tables
from prismframe.sources import exr
from prismframe.sources.layout import Channel, Part
from prismframe.streaming.frames import stream_lines

TABLES = "/root/testdata/sf0.001"
NAMES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in NAMES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{TABLES}/{t}.parquet'")
    return con


def plain(v):
    return str(v) if isinstance(v, (date, datetime)) else v


@pytest.mark.parametrize("name", catalog.queries())
def test_query_matches_its_sql(spark, duck, name):
    got = catalog.queries()[name](spark, TABLES)
    rows = got.collect()
    if name not in catalog.oracle_sql():
        assert rows
        return
    found = duck.execute(catalog.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(got.columns)
    at = [columns.index(c) for c in got.columns]
    want = Counter(tuple(plain(r[i]) for i in at) for r in found.fetchall())
    assert Counter(tuple(plain(v) for v in r) for r in rows) == want


def test_entry_has_a_schema(spark):
    assert entry_module.entry(spark).columns == ["y", "x", "value"]


@pytest.mark.parametrize("band", [2, 3, 1024])
def test_running_offsets_with_null_keys_and_few_rows_in_a_band(spark, band):
    rows = [(k, i, i % 5) for k in ("a", None) for i in range(37)]
    got = tables.running_offsets(spark.createDataFrame(rows, "k string, i long, n long"), ["k"], "i", "n", band).collect()
    assert {(x["k"], x["i"]): x["offset"] for x in got} == {(k, i): sum(j % 5 for j in range(i)) for k, i, _ in rows}


def test_stream_of_files(spark, tmp_path):
    spec = [Part(4, 2, [Channel("Y", "FLOAT")])]
    schema = "path string, part_no int, lvl_x int, lvl_y int, channel string, y int, counts array<int>, samples array<float>"
    rows = [("a", 0, 0, 0, "Y", y, None, [float(4 * y + x) for x in range(4)]) for y in range(2)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in/x.exr").write_bytes(exr.encode(spark.createDataFrame(rows, schema), spec).first()["content"])
    run = stream_lines(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("lines_seen").option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert [x["samples"] for x in spark.table("lines_seen").orderBy("y").collect()] == [r[-1] for r in rows]
