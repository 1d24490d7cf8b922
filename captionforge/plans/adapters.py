"""Tables of the pipeline made from general tables: conversations, embeddings, events, documents and labels."""

from __future__ import annotations

import wave
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from captionforge.config import Cutting
from captionforge.sources.files import located

TURN_MS = 60_000
#: A timeline of events is cut by days, at a quiet moment of the last four hours.
TIMELINE = Cutting(segment_ms=86_400_000, search_ms=14_400_000, min_silence_ms=600_000)
#: Windows of ten frames of a millisecond.
HUM = Cutting(min_silence_ms=10, threshold_db=-18.0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _word(w: Column, k: Column) -> Column:
    """The k-th word: every so often without a start or without length, so that validity matters."""
    n, at = F.length(w), k.cast("double") * F.lit(0.4)
    return F.struct(w.alias("word"), F.when(n % 7 != 0, at).alias("start"), F.when(n % 5 == 0, at).otherwise(at + F.lit(0.3005)).alias("end"), F.lit(None).cast("double").alias("score"))


def _line(x: Column, k: Column) -> Column:
    at = k.cast("double") * F.lit(3.0)
    return F.struct(at.alias("start"), (at + F.lit(2.5)).alias("end"), x.alias("text"))


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recognition results: a conversation is a recording, a turn a segment; one turn in nine has no words."""
    rows = table(spark, sf_dir, "conversations")
    words = F.transform(F.split("text", "[ \n]"), _word)
    return rows.select(
        F.col("conv_id").alias("recording_id"),
        F.col("turn").alias("segment_idx"),
        F.lit("ok").alias("status"),
        F.transform(F.split("text", "\n"), _line).alias("segments"),
        F.when(F.length("text") % 9 != 0, words).otherwise(F.slice(words, 1, 0)).alias("word_segments"),
    )


def transcript_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return rows.select(F.col("conv_id").alias("recording_id"), F.col("turn").alias("segment_idx"), (F.col("turn") * TURN_MS).alias("start_ms"))


def pcm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A label's vectors in order are a recording: 64 samples, four milliseconds each."""
    rows = table(spark, sf_dir, "embeddings")
    at = F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1
    samples = F.transform("embedding", lambda x: F.floor(x.cast("double") * 32768).cast("int"))
    return rows.select(F.col("label").alias("recording_id"), at.alias("block_no"), (at * 4).cast("long").alias("start_ms"), samples.alias("samples"))


def recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """stem and samples of recordings of bounded length: at most a thousand vectors of a label, in order."""
    rows = table(spark, sf_dir, "embeddings").select("label", F.expr("vec_id div 1000").alias("part"), "vec_id", "embedding")
    packed = rows.groupBy("label", "part").agg(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))).alias("vectors"))
    whole = lambda x: F.greatest(F.lit(-32768), F.least(F.lit(32767), F.floor(x.cast("double") * 32768).cast("int"))).cast("short")
    return packed.select(F.concat_ws("-", "label", "part").alias("stem"), F.transform(F.flatten("vectors.embedding"), whole).alias("samples"))


def write_wavs(rows: DataFrame, root: str) -> None:
    """Each row's samples as a WAV file below ``root``, which is made."""
    rows.sparkSession.range(1).write.parquet(root)

    def write(part: Iterator[Row]) -> None:
        for r in part:
            fs, own = located(f"{root}/{r.stem}.wav")
            with fs.open_output_stream(own) as f, wave.open(f, "wb") as w:
                w.setnchannels(1)
                w.setframerate(16_000)
                w.setsampwidth(2)
                w.setnframes(len(r.samples))
                w.writeframesraw(np.asarray(r.samples, "<i2").tobytes())

    rows.foreachPartition(write)


def listening():
    """A stand-in for a recogniser of lists: hears a language by the text's length, and nothing in some texts."""

    def model(rows: list[dict]) -> list[dict | None]:
        return [None if len(r["text"]) % 5 == 0 else {"language": ("en", "de", "fr")[len(r["text"]) % 3], "segments": []} for r in rows]

    return model


def stretching(ref: str):
    """A stand-in for an alignment model: one word, twice as long as the sentence; fails on some."""

    def model(row: dict) -> dict:
        end = row["segments"][0]["end"]
        if end % 10 == 0:
            raise ValueError("no sound")
        return {"word_segments": [{"word": ref, "start": 0.0, "end": 2 * end, "score": 1.0}]}

    return model


def places(rows: DataFrame) -> DataFrame:
    """``place`` from 1 in each recording, by the order that ``place`` has."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("recording_id").orderBy("place")).cast("long"))


def timelines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """recording_id, ms since the user's first event, and value."""
    rows = table(spark, sf_dir, "events").select("user_id", "value", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    first = F.min("us").over(Window.partitionBy("user_id"))
    return rows.select(F.col("user_id").alias("recording_id"), F.expr("us").alias("us"), first.alias("first"), "value").select("recording_id", F.expr("(us - first) div 1000").alias("ms"), "value")


def outcomes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Segments (a source is a recording, a document a segment) and stored outcomes (quality 1 ok, 0 an error)."""
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("recording_id"), F.col("doc_id").alias("segment_idx"), F.col("lang").alias("language"), F.col("n_chars").alias("dur_ms"))
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("segment_idx"), F.when(F.col("quality") == 1, "ok").otherwise("error").alias("status"))
    return docs, docs.join(labels, "segment_idx").select("recording_id", "segment_idx", "status", "language")
