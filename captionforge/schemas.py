"""The tables of the pipeline."""

from __future__ import annotations

from pyspark.sql import types as T

SENTENCE = T.StructType([T.StructField("start", T.DoubleType()), T.StructField("end", T.DoubleType()), T.StructField("text", T.StringType())])
WORD = T.StructType([T.StructField("word", T.StringType()), T.StructField("start", T.DoubleType()), T.StructField("end", T.DoubleType()), T.StructField("score", T.DoubleType())])

RECORDINGS = "recording_id string, path string, length bigint, modification_time timestamp, stem string, ext string, srt_path string"
PCM_BLOCKS = "recording_id string, block_no int, start_ms bigint, samples array<smallint>, error string"
FRAMES = "recording_id string, block_no int, ms bigint, e bigint, n int"
SEGMENTS = "recording_id string, segment_idx int, start_ms bigint, end_ms bigint"
CUES = "recording_id string, segment_idx int, pos int, start double, end double, text string"

#: What a recogniser gives for one segment.
ANSWER = T.StructType(
    [
        T.StructField("status", T.StringType()),
        T.StructField("error", T.StringType()),
        T.StructField("unexpected", T.BooleanType()),
        T.StructField("language", T.StringType()),
        T.StructField("segments", T.ArrayType(SENTENCE)),
        T.StructField("word_segments", T.ArrayType(WORD)),
    ]
)
RESULTS = T.StructType(
    [
        T.StructField("recording_id", T.StringType()),
        T.StructField("run_key", T.StringType()),
        T.StructField("segment_idx", T.IntegerType()),
        T.StructField("attempt", T.IntegerType()),
        *ANSWER.fields,
    ]
)
_KINDS = {"string": T.StringType(), "int": T.IntegerType(), "long": T.LongType()}


def _flat(columns: str) -> T.StructType:
    return T.StructType([T.StructField(name, _KINDS[kind]) for name, kind in (c.split() for c in columns.split(","))])


#: Cuts of a run; attempt 1 adds the recording's language to what was cut without one.
CUTS = _flat("recording_id string, run_key string, segment_idx int, attempt int, start_ms long, end_ms long, detected_language string")
#: What became of a recording of a run: how often it was opened, why it can't be read, its length and number of cuts.
MANIFEST = _flat("recording_id string, run_key string, attempt int, status string, error string, length_ms long, n_segments int")
#: A state file of the older kind: one JSON object for one recording.
STATE = T.StructType(
    [
        T.StructField("input_file", T.StringType()),
        T.StructField("model_used", T.StringType()),
        T.StructField("compute_type_used", T.StringType()),
        T.StructField("detected_language", T.StringType()),
        T.StructField("segments_info", T.ArrayType(T.StructType([T.StructField("file", T.StringType()), T.StructField("start_ms", T.LongType()), T.StructField("detected_language", T.StringType())]))),
        T.StructField(
            "processed_results",
            T.MapType(
                T.StringType(),
                T.StructType([T.StructField("segments", T.ArrayType(SENTENCE)), T.StructField("word_segments", T.ArrayType(WORD)), T.StructField("error", T.StringType()), T.StructField("segment_basename", T.StringType()), T.StructField("unexpected", T.BooleanType())]),
            ),
        ),
        T.StructField("_corrupt", T.StringType()),
    ]
)
