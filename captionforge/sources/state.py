"""Stored results and segments, and state files of the older kind."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from captionforge.operators.runs import latest, merge_outcomes
from captionforge.schemas import CUTS, MANIFEST, RESULTS, STATE
from captionforge.sources.log_table import LogTable


def read_state(spark: SparkSession, path: str) -> DataFrame:
    """State files, one JSON object each; a corrupt file is no state."""
    rows = spark.read.schema(STATE).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return rows.filter("_corrupt is null").drop("_corrupt")


def state_results(state: DataFrame, run_key: str) -> DataFrame:
    """A state file's results as rows of the results table, first attempt."""
    rows = state.select(F.col("input_file").alias("recording_id"), F.col("detected_language").alias("language"), F.explode("processed_results").alias("k", "r"))
    status = F.when(F.col("r").isNull() | F.col("r.error").isNotNull(), "error").otherwise("ok")
    words = F.transform("r.word_segments", lambda w: w)
    return rows.select(
        "recording_id", F.lit(run_key).alias("run_key"), F.col("k").cast("int").alias("segment_idx"), F.lit(0).alias("attempt"), status.alias("status"),
        F.when(F.col("r").isNull(), "No result returned").otherwise(F.col("r.error")).alias("error"), F.col("r.unexpected").alias("unexpected"), "language", F.col("r.segments").alias("segments"), words.alias("word_segments"),
    )


def results_table(spark: SparkSession, path: str) -> LogTable:
    """Results of segments; the latest attempt counts."""
    return LogTable(spark, path, RESULTS, merge=merge_outcomes)


def segments_table(spark: SparkSession, path: str) -> LogTable:
    """Cuts of recordings; a later row of a segment has its language."""
    return LogTable(spark, path, CUTS, merge=merge_outcomes)


def manifest_table(spark: SparkSession, path: str) -> LogTable:
    """What became of each recording."""
    return LogTable(spark, path, MANIFEST, merge=lambda rows: latest(rows, "recording_id", "run_key"))


def write_results(results: DataFrame, path: str, batch: str | None = None) -> None:
    """Appends results; a batch that is written again under its name replaces itself."""
    results_table(results.sparkSession, path).append(results, batch)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """The latest outcome of each segment of each run."""
    return results_table(spark, path).read()


def write_segments(segments: DataFrame, path: str) -> None:
    """Appends the cuts of runs, with the language if it is known (``detected_language``)."""
    rows = segments
    for name, value in (("attempt", F.lit(0)), ("detected_language", F.lit(None).cast("string"))):
        rows = rows if name in rows.columns else rows.withColumn(name, value)
    segments_table(segments.sparkSession, path).append(rows)


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    return segments_table(spark, path).read()
