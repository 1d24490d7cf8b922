"""Run keys, work plans, merged outcomes, counts, languages and progress."""

from __future__ import annotations

from dataclasses import astuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from captionforge.config import Cutting, Recognition

SEGMENT = ["recording_id", "segment_idx"]


def run_key(cutting: Cutting = Cutting(), recognition: Recognition = Recognition()) -> Column:
    """Of a recording's path, length and modification time and all settings that change its results."""
    settings = [F.lit(str(x)) for x in (recognition.model, recognition.compute_type, *astuple(cutting))]
    own = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("path", "length", "modification_time")]
    return F.sha2(F.concat_ws("\x1f", *own, *settings), 256)


def compatible_runs(recordings: DataFrame, runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Recordings with a stored run of the same key, and those without."""
    keys = runs.select("run_key").distinct()
    return recordings.join(keys, "run_key", "left_semi"), recordings.join(keys, "run_key", "left_anti")


def valid_inputs(requested: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requested recordings that exist, and those that don't."""
    return requested.join(found.select("path"), "path", "left_semi"), requested.join(found.select("path"), "path", "left_anti")


def manifest_check(segments: DataFrame, stored: DataFrame) -> DataFrame:
    """recording_id and reusable: the stored cuts are just the segments' cuts."""
    both = segments.select(*SEGMENT, F.lit(True).alias("own")).join(stored.select(*SEGMENT, F.lit(True).alias("old")), SEGMENT, "full_outer")
    return both.groupBy("recording_id").agg(F.bool_and(F.col("own").isNotNull() & F.col("old").isNotNull()).alias("reusable"))


def latest(rows: DataFrame, *keys: str, by: tuple[str, ...] = ("attempt",)) -> DataFrame:
    """The row of each key that is the highest by ``by``."""
    names = [c for c in rows.columns if c not in keys]
    best = F.max_by(F.struct(*names), F.struct(*by)).alias("last")
    return rows.groupBy(*keys).agg(best).select(*keys, "last.*")


def merge_outcomes(*parts: DataFrame) -> DataFrame:
    """The latest outcome of each segment of a run: the highest attempt, later parts winning ties."""
    rows = None
    for seq, part in enumerate(parts):
        part = part.withColumn("seq", F.lit(seq))
        rows = part if rows is None else rows.unionByName(part)
    return latest(rows, "recording_id", "run_key", "segment_idx", by=("attempt", "seq")).drop("seq")


def plan_work(segments: DataFrame, results: DataFrame, missing: DataFrame | None = None) -> DataFrame:
    """``segments`` with ``plan``: missing (no audio), reuse (a success is stored), retry (an error is), or new."""
    stored = results.groupBy(*SEGMENT).agg(F.bool_or(F.col("status") == "ok").alias("ok"))
    rows = segments.join(stored, SEGMENT, "left")
    plan = F.when(F.col("ok"), "reuse").when(~F.col("ok"), "retry").otherwise("new")
    if missing is not None:
        rows = rows.join(missing.select("recording_id").distinct().withColumn("absent", F.lit(True)), "recording_id", "left")
        plan = F.when(F.col("absent") & ~F.coalesce("ok", F.lit(False)), "missing").otherwise(plan)
    return rows.withColumn("plan", plan).select(*segments.columns, "plan")


def missing_outcomes(planned: DataFrame) -> DataFrame:
    """Error rows for segments without audio."""
    return planned.filter("plan = 'missing'").select(*SEGMENT, F.lit("error").alias("status"), F.lit("File not found").alias("error"))


def completion_counts(segments: DataFrame, results: DataFrame) -> DataFrame:
    """recording_id, total, successful and failed; a segment without a result has failed."""
    ok = results.filter("status = 'ok'").select(*SEGMENT).distinct().withColumn("ok", F.lit(True))
    rows = segments.select(*SEGMENT).join(ok, SEGMENT, "left").groupBy("recording_id").agg(F.count("*").alias("total"), F.count("ok").alias("successful"))
    return rows.withColumn("failed", F.col("total") - F.col("successful"))


def completion_gate(counts: DataFrame, allow_partial: bool = False) -> DataFrame:
    """Recordings to render: all segments done, or some if partial output is allowed."""
    return counts.filter((F.col("successful") > 0) & (F.lit(allow_partial) | (F.col("successful") == F.col("total"))))


def recording_language(results: DataFrame) -> DataFrame:
    """recording_id and language: that of the first segment, null if it failed or is absent there."""
    first = F.min_by(F.when(F.col("status") == "ok", F.col("language")), "segment_idx").alias("language")
    return results.filter("segment_idx = 0").groupBy("recording_id").agg(first)


def propagate_language(segments: DataFrame) -> DataFrame:
    """``detected_language``, where absent, from the recording's first segment's ``language``."""
    first = F.first_value("language").over(Window.partitionBy("recording_id").orderBy("segment_idx"))
    return segments.withColumn("detected_language", F.coalesce("detected_language", first))


def effective_language(rows: DataFrame) -> DataFrame:
    """The segment's own language, else the recording's, else the model's answer."""
    return rows.withColumn("effective_language", F.coalesce("seg_language", "rec_language", "model_language"))


def lookup_align_model(work: DataFrame, registry: DataFrame, small: bool = False) -> DataFrame:
    """``work`` with its language's ``model_ref``; a language without one makes an error of that segment alone.

    ``small``: the registry (a row for each language) is known to be small enough to broadcast; else Spark decides.
    """
    models = registry.select("language", "model_ref")
    rows = work.join(F.broadcast(models) if small else models, "language", "left")
    return rows.withColumn("error", F.when(F.col("model_ref").isNull(), F.concat(F.lit("No alignment model for "), F.coalesce("language", F.lit("unknown language")))))


def progress(segments: DataFrame) -> DataFrame:
    """``done_ms`` and ``share`` of the recording up to and with each segment (column ``dur_ms``)."""
    whole = Window.partitionBy("recording_id")
    done = F.sum("dur_ms").over(whole.orderBy("segment_idx").rowsBetween(Window.unboundedPreceding, 0))
    return segments.withColumns({"done_ms": done, "share": F.try_divide(done.cast("double"), F.sum("dur_ms").over(whole).cast("double"))})


def ordered_results(results: DataFrame) -> DataFrame:
    """For display; no other operator needs a total order."""
    return results.orderBy(*SEGMENT)
