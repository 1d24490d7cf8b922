"""Media catalogue: paths and sizes, no bytes read. Spark doesn't list files of no bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from captionforge.functions.text import EXT, basename, extension, output_path


def scan_media(spark: SparkSession, root: str, exts: tuple[str, ...] | None = None) -> DataFrame:
    """Recordings below ``root``; with ``exts`` only those extensions, in either case."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    rows = files.select("path", "length", F.col("modificationTime").alias("modification_time"))
    return with_output_path(rows if exts is None else rows.filter(extension(F.col("path")).isin([e.lower() for e in exts])))


def with_output_path(rows: DataFrame) -> DataFrame:
    """Adds recording_id (the path), stem, ext and srt_path."""
    path = F.col("path")
    return rows.withColumns({"recording_id": path, "stem": F.regexp_replace(basename(path), EXT, ""), "ext": extension(path), "srt_path": output_path(path)})


def duplicate_outputs(rows: DataFrame) -> DataFrame:
    """Output paths that several recordings share."""
    return rows.groupBy("srt_path").agg(F.count("*").alias("recordings")).filter("recordings > 1")
