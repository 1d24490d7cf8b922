"""Whole runs: from a folder of normalised audio to subtitle documents, fresh or resumed."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from captionforge.config import Cutting, Recognition, Rendering
from captionforge.operators import audio, cues, runs
from captionforge.operators.recognise import align, resources, transcribe
from captionforge.schemas import CUTS, MANIFEST, RESULTS
from captionforge.sources.log_table import LogTable
from captionforge.sources.media import scan_media, with_output_path
from captionforge.sources.pcm import lengths, scan_pcm_wav
from captionforge.sources.shared import kept
from captionforge.sources.state import manifest_table, results_table, segments_table

KEY = ["recording_id", "run_key"]


@dataclass(frozen=True)
class Store:
    """Folders of the tables that runs share. One run at a time."""

    segments: str
    results: str
    manifest: str = ""  # beside the segments, if not named

    def tables(self, spark: SparkSession) -> tuple[LogTable, LogTable, LogTable]:
        return segments_table(spark, self.segments), results_table(spark, self.results), manifest_table(spark, self.manifest or f"{self.segments.rstrip('/')}-manifest")

    def compact(self, spark: SparkSession) -> None:
        """Makes what later runs read independent of how many there were."""
        for table in self.tables(spark):
            table.compact()


@dataclass(frozen=True)
class Alignment:
    """``registry``: language and model_ref; ``make_aligner(model_ref)`` gives a function of a result's row."""

    registry: DataFrame
    make_aligner: Callable[[str], Callable]


def segments_of(spark: SparkSession, recordings: DataFrame | str, cutting: Cutting = Cutting()) -> DataFrame:
    """Segments of every readable recording of a catalogue or a folder."""
    return cut_all(spark, recordings, cutting)[0]


def cut_all(spark: SparkSession, recordings: DataFrame | str, cutting: Cutting) -> tuple[DataFrame, DataFrame]:
    """Segments, and the outcome of each recording that was opened: recording_id, length_ms and error.

    The audio is read once; frames and failures part from what that gave.
    """
    frames = kept(audio.frame_energy(scan_pcm_wav(spark, recordings)), "frames")
    failed = frames.filter("error is not null").groupBy("recording_id").agg(F.min("error").alias("error"))
    good = frames.filter("error is null").join(failed, "recording_id", "left_anti")
    length = lengths(good)
    cut = audio.cut_segments(length, audio.silence_runs(audio.silent_windows(good, cutting)), cutting)
    opened = length.select("recording_id", "length_ms", F.lit(None).cast("string").alias("error")).unionByName(failed.select("recording_id", F.lit(None).cast("long").alias("length_ms"), "error"))
    return cut, opened


def whole_cuts(manifest: DataFrame, segments: DataFrame) -> DataFrame:
    """Keys of the recordings whose stored cuts are just those that their manifest counts."""
    good = manifest.filter("status = 'ok'")
    counted = good.filter("n_segments > 0").select(*KEY, F.explode(F.sequence(F.lit(0), F.col("n_segments") - 1)).alias("segment_idx"))
    return good.join(runs.manifest_check(counted, segments).filter("not reusable"), "recording_id", "left_anti").select(*KEY)


def cut_missing(spark: SparkSession, recordings: DataFrame, store: Store, cutting: Cutting, resume: bool) -> None:
    """Cuts the recordings that have no whole cuts yet and opens no others; notes what became of each."""
    segments, results, manifest = store.tables(spark)
    keys = recordings.select(*KEY)
    known = manifest.read_for(keys)
    fresh = recordings.join(whole_cuts(known, segments.read_for(keys)), KEY, "left_anti") if resume else recordings
    fresh = kept(fresh.select(*KEY, "path", "length"), "fresh")
    if fresh.isEmpty():
        return
    cut, opened = (kept(x, "cut") for x in cut_all(spark, fresh, cutting))
    segments.append(cut.join(fresh.select(*KEY), "recording_id").withColumns({"attempt": F.lit(0), "detected_language": F.lit(None).cast("string")}))
    counts = cut.groupBy("recording_id").agg(F.count("*").cast("int").alias("n_segments"))
    rows = fresh.select(*KEY).join(opened, "recording_id", "left").join(counts, "recording_id", "left").join(known.select(*KEY, F.col("attempt").alias("before")), KEY, "left")
    rows = rows.withColumns({"attempt": (F.coalesce("before", F.lit(0)) + 1).cast("int"), "status": F.when(F.col("error").isNull(), "ok").otherwise("error"), "n_segments": F.coalesce("n_segments", F.lit(0)), "length_ms": F.when(F.col("error").isNull(), F.coalesce("length_ms", F.lit(0)))})
    rows = kept(rows.select(*MANIFEST.fieldNames()), "opened")
    results.append(failures(rows.filter("status = 'error'")))
    manifest.append(rows)  # last, as it makes the cuts count


def failures(rows: DataFrame) -> DataFrame:
    """Outcomes of recordings (with run_key, attempt, error) as results of their first segment."""
    absent = {f.name: F.lit(None).cast(f.dataType) for f in RESULTS.fields if f.name not in rows.columns}
    return rows.withColumns(absent | {"segment_idx": F.lit(0), "status": F.lit("error"), "unexpected": F.lit(False)}).select(*RESULTS.fieldNames())


def recognised(work: DataFrame, make_model: Callable, recognition: Recognition, alignment: Alignment | None) -> DataFrame:
    """Results of ``work``, whose detected_language is what the model is told; languages by the rule of precedence."""
    key, profile = f"{recognition.model}-{recognition.compute_type}", resources(work.sparkSession, recognition)
    done = transcribe(work, make_model, key, batch_size=recognition.batch_size, batched=recognition.batched, profile=profile)
    told = done.withColumnsRenamed({"detected_language": "seg_language", "language": "model_language"}).withColumn("rec_language", F.lit(None).cast("string"))
    done = runs.effective_language(told).withColumnRenamed("effective_language", "language").select(*RESULTS.fieldNames())
    if alignment is None:
        return done
    done = kept(done, "recognised")  # recognised once, however often alignment looks at it
    return align(done, alignment.registry, alignment.make_aligner, key, profile=profile)


def cuts(segments: DataFrame, manifest: DataFrame) -> DataFrame:
    """Segments of the recordings that could be read when last opened."""
    good = manifest.filter("status = 'ok'").select(*KEY, "n_segments")
    return segments.join(good, KEY).filter("segment_idx < n_segments").drop("n_segments")


def states(spark: SparkSession, store: Store, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Segments of the runs ``keys``, one for each recording that couldn't be read or found, and the latest outcomes."""
    segments, results, manifest = store.tables(spark)
    cut, known = cuts(segments.read_for(keys), manifest.read_for(keys)), results.read_for(keys)
    none = known.filter("segment_idx = 0").select(*KEY, "segment_idx").join(cut, KEY, "left_anti")
    return cut.unionByName(none.select(*(c if c in none.columns else F.lit(None).cast(CUTS[c].dataType).alias(c) for c in cut.columns))), known


def run_counts(spark: SparkSession, store: Store, keys: DataFrame) -> DataFrame:
    """recording_id, total, successful and failed segments; what couldn't be read or found counts as a failed one."""
    return runs.completion_counts(*states(spark, store, keys))


def subtitles(
    spark: SparkSession, root: str, make_model: Callable, store: Store, cutting: Cutting = Cutting(), recognition: Recognition = Recognition(), rendering: Rendering = Rendering(),
    resume: bool = True, requested: DataFrame | None = None, alignment: Alignment | None = None,
) -> DataFrame:
    """recording_id, srt, cue_count and srt_path of every recording that passes the gate.

    Only recordings without whole cuts of the same run are opened; only segments without a stored success are
    recognised; a change of rendering does neither. First segments are recognised first: the language that one
    has is told to the model for the rest of its recording. ``requested`` (path): the recordings to take; those that
    aren't there get the outcome "File not found".
    """
    own = lambda rows: rows.withColumn("run_key", runs.run_key(cutting, recognition))
    recordings, absent = own(scan_media(spark, root, (".wav",))), None
    if requested is not None:
        wanted = requested.select("path").distinct()
        absent = runs.valid_inputs(wanted, recordings)[1]
        recordings = recordings.join(wanted, "path", "left_semi")
        absent = own(with_output_path(absent.withColumns({"length": F.lit(None).cast("long"), "modification_time": F.lit(None).cast("timestamp")})))
    cut_missing(spark, recordings, store, cutting, resume)
    segments, results, manifest = store.tables(spark)
    if absent is not None:
        known = results.read_for(absent.select("run_key"))
        slots = absent.select(*KEY, F.lit(0).alias("segment_idx"))
        planned = runs.plan_work(slots, known, absent)
        last = known.select(*KEY, F.col("attempt").alias("before"))
        gone = runs.missing_outcomes(planned).join(slots, runs.SEGMENT).join(last, KEY, "left").withColumn("attempt", (F.coalesce("before", F.lit(0)) + 1).cast("int"))
        results.append(failures(gone.drop("segment_idx", "status")))
    keys = kept(recordings.select(*KEY), "keys")
    cut, known = cuts(segments.read_for(keys), manifest.read_for(keys)), results.read_for(keys)
    planned = runs.plan_work(cut, known.select(*runs.SEGMENT, "status"))
    work = planned.filter("plan <> 'reuse'") if resume else planned
    work = work.drop("attempt").join(known.select(*runs.SEGMENT, "attempt"), runs.SEGMENT, "left")
    work = kept(work.select(*KEY, "segment_idx", "start_ms", "end_ms", "detected_language", (F.coalesce("attempt", F.lit(0)) + 1).cast("int").alias("attempt")), "work")
    results.append(recognised(work.filter("segment_idx = 0"), make_model, recognition, alignment))
    spoken = kept(runs.recording_language(results.read_for(keys)).filter("language is not null"), "languages")
    heard = segments.read_for(keys).filter("detected_language is null").drop("detected_language").join(spoken.withColumnRenamed("language", "detected_language"), "recording_id")
    segments.append(heard.withColumn("attempt", F.lit(1)))
    rest = work.filter("segment_idx > 0").join(spoken, "recording_id", "left").withColumn("detected_language", F.coalesce("detected_language", "language")).drop("language")
    results.append(recognised(rest, make_model, recognition, alignment))
    every = keys if absent is None else keys.unionByName(absent.select(*KEY))
    cut, known = states(spark, store, every)
    gate = runs.completion_gate(runs.completion_counts(cut, known), rendering.allow_partial)
    ready = known.join(gate, "recording_id", "left_semi")
    return cues.documents(ready, cut, rendering.word_level).join(recordings.select("recording_id", "srt_path"), "recording_id")
