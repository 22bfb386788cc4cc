"""Incremental analysis: new source files are parsed as they come.

An extension to the analysis of whole repositories. A file stream of
(service, path, language, text) JSON rows is parsed in micro-batches and appended to a
node table; the checkpoint remembers which files were read.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from graphloom.sources import parse

FILES = "service string, path string, language string, text string"


def parse_stream(spark: SparkSession, source: str, target: str, checkpoint: str):
    """Start a query that parses all files that are there, and ends."""
    files = spark.readStream.schema(FILES).json(source)
    return parse.parse(files).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append").start()
