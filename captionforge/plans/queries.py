"""Queries over the given tables, one or more for each operator, and their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from captionforge.functions.text import output_path, srt_timestamp
from captionforge.operators import audio, cues, runs
from captionforge.config import Recognition
from captionforge.operators.recognise import align, transcribe
from captionforge.plans import adapters as A
from captionforge.plans.pipeline import recognised
from captionforge.schemas import RESULTS
from captionforge.sources.media import scan_media
from captionforge.sources.pcm import scan_pcm_wav
from captionforge.sources.shared import kept, scratch
from captionforge.sources.srt import read_srt_folders, write_srt_files, write_srt_folders
from captionforge.sources.state import read_results, read_segments, read_state, results_table, state_results, write_results, write_segments
from captionforge.streaming.incremental import incremental_results


def placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cues.rebase_times(cues.attach_offsets(cues.successful(A.transcripts(spark, sf_dir)), A.transcript_segments(spark, sf_dir)))


def all_cues(spark: SparkSession, sf_dir: str, word_level: bool = True) -> DataFrame:
    return cues.valid_cues(cues.explode_cues(cues.select_granularity(placed(spark, sf_dir), word_level)))


def srt_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cues.assemble_srt(cues.number_cues(all_cues(spark, sf_dir)))


def srt_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.table(spark, sf_dir, "events").select("event_id", srt_timestamp(F.col("value")).alias("stamp"), srt_timestamp(F.col("value") * 1000).alias("long_stamp"))


def cue_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return all_cues(spark, sf_dir).withColumn("pos", F.col("pos").cast("long"))


def cue_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cues.number_cues(all_cues(spark, sf_dir)).select("recording_id", "segment_idx", F.col("pos").cast("long").alias("pos"), "cue_no")


def granularity_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = A.transcripts(spark, sf_dir)
    picked = cues.select_granularity(both, True).select("recording_id", "segment_idx", F.size("items").cast("long").alias("with_words"), F.get("items", 0)["text"].alias("first_word"))
    return picked.join(cues.select_granularity(both, False).select("recording_id", "segment_idx", F.size("items").cast("long").alias("with_sentences")), ["recording_id", "segment_idx"])


def rebased(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = placed(spark, sf_dir).select("recording_id", "segment_idx", F.posexplode("word_segments").alias("pos", "w"))
    return rows.select("recording_id", "segment_idx", F.col("pos").cast("long").alias("pos"), F.col("w.start").alias("start"), F.col("w.end").alias("end"))


def energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio.frame_energy(A.pcm(spark, sf_dir)).select("recording_id", "ms", "e", F.col("n").cast("long").alias("n"))


def quiet_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio.silence_runs(audio.silent_windows(audio.frame_energy(A.pcm(spark, sf_dir)), A.HUM, block_ms=100))


def segment_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.timelines(spark, sf_dir)
    length = rows.groupBy("recording_id").agg((F.max("ms") + 1).alias("length_ms"))
    quiet = rows.filter("value <= 5").select("recording_id", F.col("ms").alias("a"), F.col("ms").alias("b")).distinct()
    return audio.cut_segments(length, quiet, A.TIMELINE).withColumn("segment_idx", F.col("segment_idx").cast("long"))


def resume_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments, results = A.outcomes(spark, sf_dir)
    absent = segments.filter("recording_id = 'src3'").select("recording_id")
    return runs.plan_work(segments.select("recording_id", "segment_idx"), results, absent)


def latest_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.table(spark, sf_dir, "events").select(F.col("user_id").alias("recording_id"), F.lit("run").alias("run_key"), F.col("event_type").alias("segment_idx"), F.col("event_id").alias("attempt"), "value")
    old, new = rows.filter("attempt % 2 = 0"), rows.filter("attempt % 2 = 1")
    merged = runs.merge_outcomes(old, new)
    marked = merged.withColumns({"error": F.when(F.col("value") > 100, F.lit("loud")), "segments": F.when(F.col("value") > 10, F.lit(1)), "word_segments": F.lit(None).cast("int")})
    return cues.classify_result(marked).select("recording_id", F.col("segment_idx").alias("kind"), "attempt", "value", "status", "error")


def completion_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.completion_counts(*A.outcomes(spark, sf_dir))


def completion_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = completion_counts(spark, sf_dir)
    full = runs.completion_gate(counts).select("recording_id", F.lit(True).alias("full"))
    return runs.completion_gate(counts, True).join(full, "recording_id", "left").select("recording_id", "total", F.coalesce("full", F.lit(False)).alias("full"))


def recording_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, _ = A.outcomes(spark, sf_dir)
    first = docs.groupBy("recording_id").agg(F.min("segment_idx").alias("first"))
    rows = docs.join(first, "recording_id").select("recording_id", (F.col("segment_idx") - F.col("first")).alias("segment_idx"), F.when(F.col("dur_ms") % 3 > 0, "ok").otherwise("error").alias("status"), "language")
    return runs.recording_language(rows)


def language_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, _ = A.outcomes(spark, sf_dir)
    rows = runs.propagate_language(docs.withColumn("detected_language", F.when(F.col("dur_ms") % 4 == 0, F.col("language"))))
    rows = runs.effective_language(rows.withColumns({"seg_language": F.when(F.col("dur_ms") % 5 == 0, F.lit("xx")), "rec_language": F.when(F.col("dur_ms") % 2 == 0, F.col("detected_language")), "model_language": F.col("language")}))
    return rows.select("recording_id", "segment_idx", "detected_language", "effective_language")


def align_model_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, _ = A.outcomes(spark, sf_dir)
    registry = docs.groupBy("language").agg(F.min("segment_idx").alias("n")).filter("language <> 'de'").select("language", F.concat(F.lit("align-"), "language").alias("model_ref"))
    return runs.lookup_align_model(docs, registry).select("segment_idx", "language", "model_ref", "error")


def manifest_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments, results = A.outcomes(spark, sf_dir)
    few = segments.filter("dur_ms > 5000")
    return runs.manifest_check(few, results.join(few.select("segment_idx"), "segment_idx", "left_semi"))


def compatible_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = A.table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("path"), F.length("html").alias("length"), F.lit(0).alias("modification_time"))
    keyed = pages.withColumn("run_key", runs.run_key())
    found, fresh = runs.valid_inputs(keyed, pages.filter("page_id % 4 > 0"))
    same, new = runs.compatible_runs(found, keyed.filter("page_id % 3 = 0"))
    states = ((same, "stored"), (new, "new"), (fresh, "absent"))
    parts = [d.select("page_id", F.lit(s).alias("state")) for d, s in states]
    return parts[0].union(parts[1]).union(parts[2])


def output_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.table(spark, sf_dir, "pages").select("page_id", output_path(F.col("url")).alias("srt_path"))


def progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("recording_id"), F.col("turn").alias("segment_idx"), F.length("text").cast("long").alias("dur_ms"))
    return runs.progress(rows)


def murmuring():
    """A stand-in for a recogniser: the text in small letters; fails on some, has nothing for others."""

    def model(row: dict) -> dict | None:
        text = row["text"]
        if len(text) % 13 == 0:
            raise ValueError("unreadable")
        return None if len(text) % 11 == 0 else {"language": "en", "segments": [{"start": 0.0, "end": 1.0, "text": text.lower()}]}

    return model


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.table(spark, sf_dir, "conversations")
    return rows.select(F.col("conv_id").cast("string").alias("recording_id"), F.lit("run").alias("run_key"), F.col("turn").cast("int").alias("segment_idx"), F.lit(0).alias("attempt"), "text")


def _answers(rows: DataFrame) -> DataFrame:
    return rows.select("recording_id", F.col("segment_idx").cast("long").alias("segment_idx"), "status", "error", F.get("segments", 0)["text"].alias("said"))


def transcribe_fake(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _answers(transcribe(_turns(spark, sf_dir), murmuring, "murmuring"))


def incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments arrive as files of a folder in two parts, each a run of the stream; the stored results are the answer."""
    arrivals, out, checkpoint = (scratch(spark, x) for x in ("arrivals", "results", "progress"))
    turns = _turns(spark, sf_dir)
    for part in (0, 1):
        turns.filter(F.col("segment_idx") % 2 == part).write.mode("append").parquet(arrivals)
        stream = spark.readStream.schema(turns.schema).parquet(arrivals)
        incremental_results(stream, murmuring, out, checkpoint, "murmuring").awaitTermination()
    return _answers(read_results(spark, out))


def sounds(spark: SparkSession, sf_dir: str) -> str:
    """A folder of WAV files made from the vectors: up to a thousand in a row of one label are a recording."""
    root = scratch(spark, "sounds")
    A.write_wavs(A.recordings(spark, sf_dir), root)
    return root


def media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue of the vectors' recordings."""
    return scan_media(spark, sounds(spark, sf_dir), (".WAV",)).select("stem", "ext", "length", F.regexp_extract("srt_path", "[^/]*$", 0).alias("srt_name"))


def pcm_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The recordings' blocks of 100 ms, read in ranges of a few blocks; ``weighed`` tells their order too."""
    pcm = scan_pcm_wav(spark, scan_media(spark, sounds(spark, sf_dir), (".wav",)), block_ms=100, range_bytes=10_000)
    weighed = F.aggregate(F.transform("samples", lambda x, i: x.cast("long") * (i + 1)), F.lit(0).cast("long"), lambda s, x: s + x)
    stem = F.regexp_extract("recording_id", r"([^/]*)\.wav$", 1)
    return pcm.select(stem.alias("stem"), F.col("block_no").cast("long").alias("block_no"), "start_ms", F.size("samples").cast("long").alias("n"), weighed.alias("weighed"), "error")


def state_reload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes written as a results table in two appends, read again and merged."""
    _, results = A.outcomes(spark, sf_dir)
    rows = results.select("recording_id", F.lit("run").alias("run_key"), F.col("segment_idx").cast("int").alias("segment_idx"), F.lit(0).alias("attempt"), "status")
    path = scratch(spark, "state")
    for part in (rows, rows.filter("segment_idx % 5 = 0").withColumns({"attempt": F.lit(1), "status": F.lit("ok")})):
        part.write.mode("append").partitionBy("run_key").parquet(path)
    kept = spark.read.schema(T.StructType([f for f in rows.schema.fields])).parquet(path)
    return runs.merge_outcomes(kept).select("recording_id", F.col("segment_idx").cast("long").alias("segment_idx"), F.col("attempt").cast("long").alias("attempt"), "status")


def state_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A state file for each conversation, read as one, stored as results in two batches, compacted between them, and
    read back; the second batch has later successes of what failed."""
    turns = A.table(spark, sf_dir, "conversations")
    sentence = F.struct(F.lit(0.0).alias("start"), F.lit(1.0).alias("end"), F.col("text").alias("text"))
    fails = F.length("text") % 7 == 0
    result = F.when(fails, F.struct(F.lit(None).cast("array<struct<start:double,end:double,text:string>>").alias("segments"), F.lit("bad").alias("error"))).otherwise(F.struct(F.array(sentence).alias("segments"), F.lit(None).cast("string").alias("error")))
    files = turns.select("conv_id", F.struct(F.col("turn").cast("string").alias("key"), result.alias("value")).alias("entry")).groupBy("conv_id").agg(F.map_from_entries(F.collect_list("entry")).alias("processed_results"))
    whole = F.to_json(F.struct(F.concat(F.col("conv_id").cast("string"), F.lit(".mp4")).alias("input_file"), F.lit("en").alias("detected_language"), "processed_results"))
    states, out = scratch(spark, "states"), scratch(spark, "state-results")
    files.select("conv_id", whole.alias("value")).repartition("conv_id").write.partitionBy("conv_id").text(states)
    results = state_results(read_state(spark, states), "run")
    write_results(results, out, "first")
    write_results(results, out, "first")  # a batch that runs again replaces itself
    results_table(spark, out).compact()
    write_results(results.filter("status = 'error'").withColumns({"attempt": F.lit(1), "status": F.lit("ok"), "error": F.lit(None).cast("string")}), out)
    rows = read_results(spark, out)
    return rows.select("recording_id", F.col("segment_idx").cast("long").alias("segment_idx"), F.col("attempt").cast("long").alias("attempt"), "status", "language", F.get("segments", 0)["text"].alias("said"))


def stored_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cuts of the events' timelines, stored for two runs and read back."""
    cut, path = segment_bounds(spark, sf_dir), scratch(spark, "segments")
    cut = kept(cut.select(F.col("recording_id").cast("string").alias("recording_id"), F.col("segment_idx").cast("int").alias("segment_idx"), "start_ms", "end_ms"), "cut")
    for run in ("one", "two"):
        write_segments(cut.withColumn("run_key", F.lit(run)), path)
    return read_segments(spark, path).select("recording_id", "run_key", F.col("segment_idx").cast("long").alias("segment_idx"), "start_ms", "end_ms")


def successful(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' stored outcomes without the failed ones."""
    return cues.successful(A.outcomes(spark, sf_dir)[1]).select("recording_id", "segment_idx", "language")


def ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The answers to all turns in order, each with its place in its recording."""
    rows = runs.ordered_results(transcribe(_turns(spark, sf_dir), murmuring, "murmuring"))
    return _answers(rows).withColumn("place", F.monotonically_increasing_id()).transform(A.places)


def language_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First turns are recognised first; what is heard in one is told to the model for the rest of its conversation."""
    turns = _turns(spark, sf_dir).withColumn("detected_language", F.when(F.length("text") % 6 == 0, F.lit("xx")))
    told = lambda rows: recognised(rows, A.listening, Recognition(batch_size=8, batched=True), None)
    first = kept(told(turns.filter("segment_idx = 0")), "first")
    heard = runs.recording_language(first).withColumnRenamed("language", "heard")
    rest = turns.filter("segment_idx > 0").join(heard, "recording_id", "left").withColumn("detected_language", F.coalesce("detected_language", "heard")).drop("heard")
    rows = first.unionByName(told(rest))
    return rows.select("recording_id", F.col("segment_idx").cast("long").alias("segment_idx"), "status", "language")


def aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document through its language's alignment model; German has none."""
    docs, _ = A.outcomes(spark, sf_dir)
    sentence = F.struct(F.lit(0.0).alias("start"), F.col("dur_ms").cast("double").alias("end"), F.col("language").alias("text"))
    rows = docs.select(F.col("recording_id"), F.lit("run").alias("run_key"), F.col("segment_idx").cast("int").alias("segment_idx"), F.lit(0).alias("attempt"), F.lit("ok").alias("status"), F.lit(None).cast("string").alias("error"), F.lit(None).cast("boolean").alias("unexpected"), "language", F.array(sentence).alias("segments"))
    rows = rows.withColumn("word_segments", F.lit(None).cast(RESULTS["word_segments"].dataType))
    registry = docs.select("language").distinct().filter("language <> 'de'").select("language", F.concat(F.lit("align-"), "language").alias("model_ref"))
    out = align(rows, registry, A.stretching, rows_per_task=500)
    return out.select("recording_id", F.col("segment_idx").cast("long").alias("segment_idx"), "status", "error", F.get("word_segments", 0)["word"].alias("word"), F.get("word_segments", 0)["end"].alias("end"))


def srt_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "srt")
    write_srt_folders(srt_document(spark, sf_dir), path)
    return read_srt_folders(spark, path)


def srt_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written to files of exact names, and read back."""
    root = scratch(spark, "srt-files")
    spark.range(1).write.parquet(root)  # makes the folder
    write_srt_files(srt_document(spark, sf_dir).select(F.concat(F.lit(f"{root}/"), F.col("recording_id").cast("string"), F.lit(".srt")).alias("srt_path"), "srt"))
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.srt").load(root)
    return files.select(F.regexp_extract("path", "[^/]*$", 0).alias("name"), F.decode("content", "UTF-8").alias("srt"))


QUERIES = {
    "srt_document": srt_document, "srt_timestamp": srt_timestamps, "cue_filter": cue_filter, "cue_numbering": cue_numbering, "granularity_select": granularity_select,
    "rebase_times": rebased, "frame_energy": energy, "silence_runs": quiet_runs, "segment_bounds": segment_bounds, "resume_split": resume_split, "latest_outcome": latest_outcome,
    "completion_counts": completion_counts, "completion_gate": completion_gate, "recording_language": recording_language, "language_propagation": language_propagation,
    "align_model_lookup": align_model_lookup, "manifest_check": manifest_check, "compatible_runs": compatible_runs, "output_path": output_paths, "progress": progress,
    "transcribe_fake": transcribe_fake, "incremental_results": incremental, "scan_media": media, "state_reload": state_reload, "srt_roundtrip": srt_roundtrip,
    "scan_pcm_wav": pcm_blocks, "state_files": state_files, "stored_segments": stored_segments, "successful_results": successful, "ordered_results": ordered, "language_flow": language_flow,
    "aligned_results": aligned, "srt_files": srt_files,
}

#: The 29 code points that count as white space.
SPACES = [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_SPACES = " || ".join(f"chr({c})" for c in SPACES)


def _stamp(x: str) -> str:
    v = f"(CASE WHEN {x} IS NULL OR {x} < 0 THEN 0 ELSE {x} END)"
    t = f"(CAST(floor({v}) AS BIGINT) * 1000 + CAST(round_even(({v} - floor({v})) * 1000, 0) AS BIGINT))"
    return f"printf('%02d:%02d:%02d,%03d', {t} // 3600000, {t} // 60000 % 60, {t} // 1000 % 60, {t} % 1000)"


_WORDS = f"""
lists AS (SELECT conv_id, turn, text, CASE WHEN length(text) % 9 <> 0 THEN string_split_regex(text, '[ \n]') ELSE [] END AS ws FROM conversations),
raw AS (SELECT conv_id, turn, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS pos FROM lists),
timed AS (SELECT conv_id, turn, pos, w, CASE WHEN length(w) % 7 <> 0 THEN pos * 0.4::DOUBLE END AS s0,
  CASE WHEN length(w) % 5 = 0 THEN pos * 0.4::DOUBLE ELSE pos * 0.4::DOUBLE + 0.3005::DOUBLE END AS e0 FROM raw),
words AS (SELECT conv_id AS recording_id, turn AS segment_idx, pos, s0 + turn * 60.0::DOUBLE AS "start", e0 + turn * 60.0::DOUBLE AS "end", trim(w, {_SPACES}) AS text FROM timed),
plain AS (SELECT conv_id, turn, string_split(text, chr(10)) AS ls FROM lists WHERE len(ws) = 0),
sentences AS (SELECT conv_id AS recording_id, turn AS segment_idx, pos, pos * 3.0::DOUBLE + turn * 60.0::DOUBLE AS "start", pos * 3.0::DOUBLE + 2.5::DOUBLE + turn * 60.0::DOUBLE AS "end", trim(l, {_SPACES}) AS text
  FROM (SELECT conv_id, turn, unnest(ls) AS l, generate_subscripts(ls, 1) - 1 AS pos FROM plain)),
cues AS (SELECT * FROM (SELECT * FROM words UNION ALL SELECT * FROM sentences) WHERE "start" IS NOT NULL AND "end" IS NOT NULL AND text <> '' AND "end" > "start"),
numbered AS (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY segment_idx, pos) AS cue_no FROM cues)"""

_BLOCK = f"""cue_no || chr(10) || {_stamp('"start"')} || ' --> ' || {_stamp('"end"')} || chr(10) || text || chr(10)"""
_DOCUMENT = f"SELECT recording_id, string_agg({_BLOCK}, chr(10) ORDER BY cue_no) AS srt, count(*) AS cue_count FROM numbered GROUP BY recording_id"

_FRAMES = """
flat AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS j, (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1) * 4 AS start_ms FROM embeddings),
frames AS (SELECT label AS recording_id, start_ms + j // 16 AS ms, sum((floor(x * 32768))::BIGINT * (floor(x * 32768))::BIGINT)::BIGINT AS e, count(*) AS n FROM flat GROUP BY ALL)"""

_SOUNDS = """
vecs AS (SELECT *, row_number() OVER (PARTITION BY label, vec_id // 1000 ORDER BY vec_id) AS r FROM embeddings),
raw AS (SELECT label || '-' || vec_id // 1000 AS stem, r, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS j FROM vecs),
sound AS (SELECT stem, row_number() OVER (PARTITION BY stem ORDER BY r, j) AS k, greatest(-32768, least(32767, floor(x * 32768)))::BIGINT AS p FROM raw)"""

_OUTCOMES = """
segs AS (SELECT source AS recording_id, doc_id AS segment_idx, lang AS language, n_chars AS dur_ms FROM documents),
res AS (SELECT s.recording_id, s.segment_idx, CASE WHEN l.quality = 1 THEN 'ok' ELSE 'error' END AS status FROM segs s JOIN labels l ON l.doc_id = s.segment_idx)"""
_COUNTS = """counts AS (SELECT s.recording_id, count(*) AS total, count(*) FILTER (r.status = 'ok') AS successful, count(*) FILTER (r.status IS DISTINCT FROM 'ok') AS failed
  FROM segs s LEFT JOIN res r USING (segment_idx) GROUP BY s.recording_id)"""
_SAID = "CASE WHEN length(text) % 13 = 0 OR length(text) % 11 = 0 THEN 'error' ELSE 'ok' END AS status, CASE WHEN length(text) % 13 = 0 THEN 'ValueError: unreadable' WHEN length(text) % 11 = 0 THEN 'No result returned' END AS error, CASE WHEN length(text) % 13 <> 0 AND length(text) % 11 <> 0 THEN lower(text) END AS said"
_ANSWERS = f"SELECT conv_id::VARCHAR AS recording_id, turn AS segment_idx, {_SAID} FROM conversations"

ORACLES = {
    "srt_document": f"WITH {_WORDS} {_DOCUMENT}",
    "srt_timestamp": f"SELECT event_id, {_stamp('value')} AS stamp, {_stamp('(value * 1000)')} AS long_stamp FROM events",
    "cue_filter": f'WITH {_WORDS} SELECT recording_id, segment_idx, pos, "start", "end", text FROM cues',
    "cue_numbering": f"WITH {_WORDS} SELECT recording_id, segment_idx, pos, cue_no FROM numbered",
    "granularity_select": f"""WITH {_WORDS} SELECT conv_id AS recording_id, turn AS segment_idx, CASE WHEN len(ws) > 0 THEN len(ws) ELSE len(string_split(text, chr(10))) END AS with_words,
  CASE WHEN len(ws) > 0 THEN ws[1] ELSE string_split(text, chr(10))[1] END AS first_word, len(string_split(text, chr(10))) AS with_sentences FROM lists""",
    "rebase_times": f'WITH {_WORDS} SELECT recording_id, segment_idx, pos, "start", "end" FROM words',
    "frame_energy": f"WITH {_FRAMES} SELECT * FROM frames",
    "silence_runs": f"""WITH {_FRAMES}, sums AS (SELECT recording_id, ms, sum(e) OVER w AS s, lead(ms, 9) OVER (PARTITION BY recording_id ORDER BY ms) AS last FROM frames WHERE n = 16
  WINDOW w AS (PARTITION BY recording_id ORDER BY ms ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING)),
quiet AS (SELECT recording_id, ms, ms - row_number() OVER (PARTITION BY recording_id ORDER BY ms) AS g FROM sums WHERE last = ms + 9 AND s < {audio.energy_limit(-18.0, 160)})
SELECT recording_id, min(ms) AS a, max(ms) AS b FROM quiet GROUP BY recording_id, g""",
    "segment_bounds": """WITH RECURSIVE lines AS (SELECT user_id, (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) // 1000 AS ms, value FROM events),
recs AS (SELECT user_id, max(ms) + 1 AS len, list_sort(list(ms) FILTER (value <= 5)) AS q FROM lines GROUP BY user_id),
cuts AS (SELECT user_id, len, q, 0::BIGINT AS i, 0::BIGINT AS s, least(86400000, len) AS e0 FROM recs),
step AS (
  SELECT user_id, len, q, i, s, CASE WHEN e0 < len AND e0 - s > 14400000 AND list_filter(q, lambda x: x >= greatest(s, e0 - 14400000) AND x <= e0 - 600000)[1] > s + 600000
    THEN list_filter(q, lambda x: x >= greatest(s, e0 - 14400000) AND x <= e0 - 600000)[1] ELSE e0 END AS e FROM cuts
  UNION ALL
  SELECT user_id, len, q, i + 1, e, CASE WHEN least(e + 86400000, len) < len AND least(e + 86400000, len) - e > 14400000 AND list_filter(q, lambda x: x >= greatest(e, least(e + 86400000, len) - 14400000) AND x <= least(e + 86400000, len) - 600000)[1] > e + 600000
    THEN list_filter(q, lambda x: x >= greatest(e, least(e + 86400000, len) - 14400000) AND x <= least(e + 86400000, len) - 600000)[1] ELSE least(e + 86400000, len) END FROM step WHERE e < len)
SELECT user_id AS recording_id, i AS segment_idx, s AS start_ms, e AS end_ms FROM step""",
    "resume_split": f"""WITH {_OUTCOMES} SELECT s.recording_id, s.segment_idx, CASE WHEN s.recording_id = 'src3' AND r.status IS DISTINCT FROM 'ok' THEN 'missing' WHEN r.status = 'ok' THEN 'reuse' WHEN r.status = 'error' THEN 'retry' ELSE 'new' END AS plan
FROM segs s LEFT JOIN res r USING (segment_idx)""",
    "latest_outcome": """WITH last AS (SELECT user_id AS recording_id, event_type AS kind, max(event_id) AS attempt, arg_max(value, event_id) AS value FROM events GROUP BY ALL)
SELECT *, CASE WHEN value > 10 AND value <= 100 THEN 'ok' ELSE 'error' END AS status, CASE WHEN value > 100 THEN 'loud' WHEN value <= 10 THEN 'No result returned' END AS error FROM last""",
    "completion_counts": f"WITH {_OUTCOMES}, {_COUNTS} SELECT * FROM counts",
    "completion_gate": f'WITH {_OUTCOMES}, {_COUNTS} SELECT recording_id, total, successful = total AS "full" FROM counts WHERE successful > 0',
    "recording_language": f"WITH {_OUTCOMES} SELECT recording_id, CASE WHEN arg_min(dur_ms, segment_idx) % 3 > 0 THEN arg_min(language, segment_idx) END AS language FROM segs GROUP BY recording_id",
    "language_propagation": f"""WITH {_OUTCOMES}, d AS (SELECT *, coalesce(CASE WHEN dur_ms % 4 = 0 THEN language END, first_value(language) OVER (PARTITION BY recording_id ORDER BY segment_idx)) AS detected_language FROM segs)
SELECT recording_id, segment_idx, detected_language, CASE WHEN dur_ms % 5 = 0 THEN 'xx' WHEN dur_ms % 2 = 0 THEN detected_language ELSE language END AS effective_language FROM d""",
    "align_model_lookup": f"""WITH {_OUTCOMES} SELECT segment_idx, language, CASE WHEN language <> 'de' THEN 'align-' || language END AS model_ref, CASE WHEN language = 'de' THEN 'No alignment model for de' END AS error FROM segs""",
    "manifest_check": f"WITH {_OUTCOMES} SELECT s.recording_id, bool_and(r.segment_idx IS NOT NULL) AS reusable FROM segs s LEFT JOIN res r USING (segment_idx) WHERE s.dur_ms > 5000 GROUP BY s.recording_id",
    "compatible_runs": """WITH k AS (SELECT page_id, url || chr(31) || length(html) AS key FROM pages),
f AS (SELECT DISTINCT url FROM pages WHERE page_id % 4 > 0), o AS (SELECT DISTINCT key FROM k WHERE page_id % 3 = 0)
SELECT page_id, CASE WHEN url NOT IN (SELECT url FROM f) THEN 'absent' WHEN key IN (SELECT key FROM o) THEN 'stored' ELSE 'new' END AS state FROM pages JOIN k USING (page_id)""",
    "output_path": "SELECT page_id, CASE WHEN regexp_matches(url, '[^/.][^/]*\\.[^./]*$') THEN regexp_replace(url, '\\.[^./]*$', '') ELSE url END || '.srt' AS srt_path FROM pages",
    "progress": """WITH c AS (SELECT conv_id AS recording_id, turn AS segment_idx, length(text)::BIGINT AS dur_ms FROM conversations),
r AS (SELECT *, (sum(dur_ms) OVER (PARTITION BY recording_id ORDER BY segment_idx))::BIGINT AS done_ms, sum(dur_ms) OVER (PARTITION BY recording_id) AS whole FROM c)
SELECT recording_id, segment_idx, dur_ms, done_ms, done_ms::DOUBLE / whole::DOUBLE AS share FROM r""",
    "transcribe_fake": _ANSWERS,
    "incremental_results": _ANSWERS,
    "state_reload": f"WITH {_OUTCOMES} SELECT recording_id, segment_idx, CASE WHEN segment_idx % 5 = 0 THEN 1 ELSE 0 END AS attempt, CASE WHEN segment_idx % 5 = 0 THEN 'ok' ELSE status END AS status FROM res",
    "scan_media": f"WITH {_SOUNDS} SELECT stem, '.wav' AS ext, 44 + 2 * count(*) AS length, stem || '.srt' AS srt_name FROM sound GROUP BY stem",
    "scan_pcm_wav": f"""WITH {_SOUNDS} SELECT stem, (k - 1) // 1600 AS block_no, (k - 1) // 1600 * 100 AS start_ms, count(*) AS n, sum(p * ((k - 1) % 1600 + 1))::BIGINT AS weighed, NULL::VARCHAR AS error FROM sound GROUP BY ALL""",
    "state_files": "SELECT conv_id || '.mp4' AS recording_id, turn AS segment_idx, CASE WHEN length(text) % 7 = 0 THEN 1 ELSE 0 END AS attempt, 'ok' AS status, 'en' AS language, CASE WHEN length(text) % 7 <> 0 THEN text END AS said FROM conversations",
    "successful_results": f"WITH {_OUTCOMES} SELECT s.recording_id, segment_idx, s.language FROM segs s JOIN res r USING (segment_idx) WHERE r.status = 'ok'",
    "ordered_results": f"SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY segment_idx) AS place FROM ({_ANSWERS})",
    "language_flow": f"""WITH t AS (SELECT conv_id, turn, length(text) AS n, CASE WHEN length(text) % 6 = 0 THEN 'xx' END AS seg, length(text) % 5 = 0 AS bad, ['en', 'de', 'fr'][length(text) % 3 + 1] AS own FROM conversations),
f AS (SELECT conv_id, CASE WHEN NOT bad THEN coalesce(seg, own) END AS heard FROM t WHERE turn = 0)
SELECT conv_id::VARCHAR AS recording_id, turn AS segment_idx, CASE WHEN bad THEN 'error' ELSE 'ok' END AS status, CASE WHEN turn = 0 THEN coalesce(seg, CASE WHEN NOT bad THEN own END) ELSE coalesce(seg, heard, CASE WHEN NOT bad THEN own END) END AS language FROM t LEFT JOIN f USING (conv_id)""",
    "aligned_results": f"""WITH {_OUTCOMES} SELECT recording_id, segment_idx, CASE WHEN language = 'de' OR dur_ms % 10 = 0 THEN 'error' ELSE 'ok' END AS status,
  CASE WHEN language = 'de' THEN 'No alignment model for de' WHEN dur_ms % 10 = 0 THEN 'ValueError: no sound' END AS error, CASE WHEN language <> 'de' AND dur_ms % 10 <> 0 THEN 'align-' || language END AS word, CASE WHEN language <> 'de' AND dur_ms % 10 <> 0 THEN dur_ms * 2.0::DOUBLE END AS "end" FROM segs""",
    "srt_files": f"WITH {_WORDS} SELECT recording_id || '.srt' AS name, srt FROM ({_DOCUMENT})",
    "srt_roundtrip": f"WITH {_WORDS} SELECT recording_id::VARCHAR AS recording_id, srt FROM ({_DOCUMENT})",
}
ORACLES["stored_segments"] = f"SELECT recording_id::VARCHAR AS recording_id, run_key, segment_idx, start_ms, end_ms FROM ({ORACLES['segment_bounds']}), (SELECT unnest(['one', 'two']) AS run_key)"
