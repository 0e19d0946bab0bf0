"""Files that arrive over time: the same stateless decoding on a file stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources import exr


def stream_lines(spark: SparkSession, path: str, entry: str = "any") -> DataFrame:
    """Rows as exr.lines() gives them, for files under path as they come."""
    found = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", f"*.{exr.EXTENSION}").load(path)
    return exr.lines(exr.chunks(found.select("path", "content"), entry))
