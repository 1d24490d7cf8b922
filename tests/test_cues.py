from captionforge.operators import cues, runs
from captionforge.schemas import RESULTS


def results(spark, rows):
    return spark.createDataFrame([(r.get("rec", "a"), "k", r["idx"], r.get("attempt", 1), r.get("status", "ok"), r.get("error"), None, r.get("language"), r.get("segments"), r.get("words")) for r in rows], RESULTS)


def sent(*cues_):
    return [{"start": a, "end": b, "text": t} for a, b, t in cues_]


def test_document(spark):
    rows = results(spark, [{"idx": 0, "segments": sent((0.0, 1.5, " Hi "), (2.0, 2.0, "x"), (3.0, 4.25, "Bye"))}])
    starts = spark.createDataFrame([("a", 0, 0)], "recording_id string, segment_idx int, start_ms long")
    row = cues.documents(rows, starts).first()
    assert row.srt == "1\n00:00:00,000 --> 00:00:01,500\nHi\n\n2\n00:00:03,000 --> 00:00:04,250\nBye\n" and row.cue_count == 2


def test_numbers_run_over_segments_and_failures_leave_no_gap(spark):
    rows = results(spark, [{"idx": 2, "segments": sent((0.0, 1.0, "c"))}, {"idx": 0, "segments": sent((0.0, 1.0, "a"))}, {"idx": 1, "status": "error", "error": "x", "segments": sent((0.0, 1.0, "b"))}])
    starts = spark.createDataFrame([("a", i, i * 60000) for i in range(3)], "recording_id string, segment_idx int, start_ms long")
    assert cues.documents(rows, starts).first().srt == "1\n00:00:00,000 --> 00:00:01,000\na\n\n2\n00:02:00,000 --> 00:02:01,000\nc\n"


def test_granularity(spark):
    word = [{"word": "w", "start": 0.0, "end": 1.0, "score": None}]
    bad = [{"word": "w", "start": None, "end": 1.0, "score": None}]
    s = sent((0.0, 1.0, "s"))
    rows = results(spark, [{"idx": 0, "segments": s, "words": word}, {"idx": 1, "segments": s, "words": []}, {"idx": 2, "segments": s}, {"idx": 3, "segments": s, "words": bad}, {"idx": 4, "segments": []}])
    got = {r.segment_idx: r.text for r in cues.valid_cues(cues.explode_cues(cues.select_granularity(rows, True))).collect()}
    assert got == {0: "w", 1: "s", 2: "s"}


def test_rebase_keeps_nulls_and_absence(spark):
    rows = results(spark, [{"idx": 1, "segments": sent((None, 1.0, "s"))}])
    starts = spark.createDataFrame([("a", 1, 1500)], "recording_id string, segment_idx int, start_ms long")
    row = cues.rebase_times(cues.attach_offsets(rows, starts)).first()
    assert (row.segments[0].start, row.segments[0].end, row.word_segments) == (None, 2.5, None)


def test_invalid_times(spark):
    rows = spark.createDataFrame([(0.0, 1.0, "a"), (0.0, float("nan"), "a"), (0.0, float("inf"), "a"), (float("nan"), 1.0, "a"), (-1.0, 0.0, "a"), (None, 1.0, "a"), (1.0, 0.5, "a"), (0.0, 1.0, "")], "start double, end double, text string")
    assert sorted(r.start for r in cues.valid_cues(rows).collect()) == [-1.0, 0.0]


def test_plan_and_missing(spark):
    segments = spark.createDataFrame([("a", i) for i in range(3)] + [("b", 0)], "recording_id string, segment_idx int")
    stored = spark.createDataFrame([("a", 0, "ok"), ("a", 1, "error")], "recording_id string, segment_idx int, status string")
    planned = runs.plan_work(segments, stored, spark.createDataFrame([("b",)], "recording_id string"))
    assert {(r.recording_id, r.segment_idx): r.plan for r in planned.collect()} == {("a", 0): "reuse", ("a", 1): "retry", ("a", 2): "new", ("b", 0): "missing"}
    assert [r.error for r in runs.missing_outcomes(planned).collect()] == ["File not found"]


def test_gate(spark):
    counts = spark.createDataFrame([("none", 3, 0), ("some", 3, 2), ("all", 3, 3)], "recording_id string, total long, successful long")
    assert {r.recording_id for r in runs.completion_gate(counts).collect()} == {"all"}
    assert {r.recording_id for r in runs.completion_gate(counts, True).collect()} == {"some", "all"}


def test_languages(spark):
    rows = results(spark, [{"rec": "a", "idx": 0, "language": "en"}, {"rec": "a", "idx": 1, "language": "fr"}, {"rec": "b", "idx": 0, "status": "error", "error": "x", "language": "de"}, {"rec": "c", "idx": 1, "language": "es"}])
    assert {r.recording_id: r.language for r in runs.recording_language(rows).collect()} == {"a": "en", "b": None}


def test_latest_outcome_wins(spark):
    old = results(spark, [{"idx": 0, "attempt": 1, "language": "old"}, {"idx": 1, "attempt": 2, "language": "kept"}])
    new = results(spark, [{"idx": 0, "attempt": 1, "language": "new"}, {"idx": 1, "attempt": 1, "language": "late"}])
    assert {r.segment_idx: r.language for r in runs.merge_outcomes(old, new).collect()} == {0: "new", 1: "kept"}


def test_no_answer_is_an_error(spark):
    rows = cues.classify_result(results(spark, [{"idx": 0, "status": None}, {"idx": 1, "status": None, "segments": []}]))
    assert {r.segment_idx: (r.status, r.error) for r in rows.collect()} == {0: ("error", "No result returned"), 1: ("ok", None)}


def test_align_models(spark):
    work = spark.createDataFrame([(0, "en"), (1, "xx"), (2, None)], "segment_idx int, language string")
    models = spark.createDataFrame([("en", "m")], "language string, model_ref string")
    got = {r.segment_idx: (r.model_ref, r.error) for r in runs.lookup_align_model(work, models).collect()}
    assert got == {0: ("m", None), 1: (None, "No alignment model for xx"), 2: (None, "No alignment model for unknown language")}
