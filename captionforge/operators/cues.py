"""From recognition results to numbered cues and subtitle documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from captionforge.functions.text import render_cue, strip_text


def classify_result(results: DataFrame) -> DataFrame:
    """``status``: ok if there is a result without an error; no result at all becomes an error of its own."""
    none = F.col("error").isNull() & F.col("segments").isNull() & F.col("word_segments").isNull()
    return results.withColumns({"error": F.when(none, F.lit("No result returned")).otherwise(F.col("error")), "status": F.when(none | F.col("error").isNotNull(), "error").otherwise("ok")})


def successful(results: DataFrame) -> DataFrame:
    return results.filter("status = 'ok'")


def attach_offsets(results: DataFrame, segments: DataFrame) -> DataFrame:
    """Each result with its segment's ``start_ms``."""
    return results.join(segments.select("recording_id", "segment_idx", "start_ms"), ["recording_id", "segment_idx"])


def rebase_times(results: DataFrame) -> DataFrame:
    """Times on the recording's clock: the segment's start is added; null times and absent lists stay null."""
    offset = F.col("start_ms") / F.lit(1000.0)

    def moved(name: str):
        return F.transform(name, lambda x: x.withField("start", x["start"] + offset).withField("end", x["end"] + offset))

    return results.withColumns({"segments": moved("segments"), "word_segments": moved("word_segments")})


def select_granularity(results: DataFrame, word_level: bool = False) -> DataFrame:
    """``items`` (start, end, text): the words if asked for and there are any, else the sentences, else null."""
    words = F.transform("word_segments", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["word"].alias("text")))
    sentences = F.transform("segments", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["text"].alias("text")))
    choice = F.when(F.lit(word_level) & (F.size("word_segments") > 0), words).when(F.size("segments") > 0, sentences)
    return results.withColumn("items", choice)


def explode_cues(results: DataFrame, *keys: str) -> DataFrame:
    """One row for each item, with its place ``pos``; results without items give none."""
    keys = keys or ("recording_id", "segment_idx")
    rows = results.select(*keys, F.posexplode("items").alias("pos", "item"))
    return rows.select(*keys, "pos", F.col("item.start").alias("start"), F.col("item.end").alias("end"), strip_text(F.col("item.text")).alias("text"))


def valid_cues(cues: DataFrame) -> DataFrame:
    """Both times there and finite, the end after the start, and some text."""
    return cues.filter("start is not null and end is not null and text <> '' and end > start and not isnan(end) and end < double('inf')")


def number_cues(cues: DataFrame) -> DataFrame:
    """``cue_no`` from 1 without gaps in each recording, by segment and place in it."""
    order = Window.partitionBy("recording_id").orderBy("segment_idx", "pos")
    return cues.withColumn("cue_no", F.row_number().over(order).cast("long"))


def assemble_srt(cues: DataFrame) -> DataFrame:
    """recording_id, srt and cue_count from numbered cues; recordings without cues have no row."""
    block = render_cue(F.col("cue_no"), F.col("start"), F.col("end"), F.col("text"))
    rows = cues.select("recording_id", F.struct("cue_no", block.alias("block")).alias("cue"))
    rows = rows.groupBy("recording_id").agg(F.array_sort(F.collect_list("cue")).alias("cues"))
    return rows.select("recording_id", F.array_join(F.transform("cues", lambda x: x["block"]), "\n").alias("srt"), F.size("cues").cast("long").alias("cue_count"))


def documents(results: DataFrame, segments: DataFrame, word_level: bool = False) -> DataFrame:
    """Subtitle documents from classified results of one run."""
    placed = rebase_times(attach_offsets(successful(results), segments))
    return assemble_srt(number_cues(valid_cues(explode_cues(select_granularity(placed, word_level)))))
