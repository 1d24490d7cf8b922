import json
import os
import re
import struct
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from captionforge.config import Rendering
from captionforge.operators.audio import frame_energy
from captionforge.operators.recognise import Models, align, transcribe
from captionforge.plans.pipeline import Store, run_counts, segments_of, subtitles, whole_cuts
from captionforge.schemas import RESULTS
from captionforge.sources import pcm
from captionforge.sources.media import duplicate_outputs, scan_media
from captionforge.sources.pcm import lengths, scan_pcm_wav
from captionforge.sources.shared import kept
from captionforge.sources.srt import write_srt_files
from captionforge.sources.state import read_state, results_table, state_results
from captionforge.streaming import incremental
from captionforge.streaming.incremental import incremental_results


def wav(path, samples, channels=1, rate=16000, width=2):
    with wave.open(str(path), "wb") as w:
        w.setnchannels(channels)
        w.setframerate(rate)
        w.setsampwidth(width)
        w.writeframes(np.asarray(samples, "<i2" if width == 2 else "u1").tobytes())


@pytest.fixture
def media(tmp_path):
    root = tmp_path / "media"
    root.mkdir()
    loud = np.resize([2000, -2000], 16000 * 61)
    loud[16000 * 58 + 1600 : 16000 * 58 + 9600] = 0
    wav(root / "a.wav", loud)
    wav(root / "b.wav", np.zeros(16008))
    wav(root / "stereo.wav", np.zeros(100), channels=2)
    wav(root / "bytes.wav", np.zeros(100), width=1)
    wav(root / "fast.wav", np.zeros(100), rate=44100)
    (root / "cut.wav").write_bytes((root / "b.wav").read_bytes()[:20])
    (root / "none.wav").write_bytes(b"")
    (root / "a.MKV").write_bytes(b"x")
    return root


def test_catalogue(spark, media):
    rows = scan_media(spark, str(media), (".mkv", ".wav"))
    assert rows.count() == 7  # Spark doesn't list files of no bytes
    assert [os.path.basename(r.srt_path) for r in duplicate_outputs(rows).collect()] == ["a.srt"]
    assert "content" not in scan_media(spark, str(media)).columns


def test_wav_blocks_and_errors(spark, media):
    blocks = scan_pcm_wav(spark, str(media), 1000)
    bad = {os.path.basename(r.recording_id) for r in blocks.filter("error is not null").collect()}
    assert bad == {"a.MKV", "stereo.wav", "bytes.wav", "fast.wav", "cut.wav"}
    assert {os.path.basename(r.recording_id): r.length_ms for r in lengths(blocks).collect()} == {"a.wav": 61000, "b.wav": 1000}
    energy = [frame_energy(scan_pcm_wav(spark, str(media), b).filter("error is null")).groupBy("recording_id").sum("e").collect() for b in (700, 10_000)]
    assert sorted(energy[0]) == sorted(energy[1])


def test_segments(spark, media):
    rows = segments_of(spark, str(media)).orderBy("recording_id", "segment_idx").collect()
    assert [(os.path.basename(r.recording_id), r.start_ms, r.end_ms) for r in rows] == [("a.wav", 0, 59000 - 908), ("a.wav", 58092, 61000), ("b.wav", 0, 1000)]


def fake(log, fail=()):
    def make():
        def model(row):
            with open(log, "a") as f:
                f.write(f"{os.path.basename(row['recording_id'])} {row['segment_idx']}\n")
            if row["segment_idx"] in fail:
                raise ValueError("no")
            return {"language": "en", "segments": [{"start": 0.0, "end": 1.0, "text": f"s{row['segment_idx']}"}], "word_segments": [{"word": "w", "start": 0.0, "end": 0.5, "score": 1.0}]}

        return model

    return make


def names(rows):
    return {os.path.basename(r.recording_id): r for r in rows}


def test_fresh_run_resume_and_rerender(spark, media, tmp_path):
    store, log = Store(str(tmp_path / "segments"), str(tmp_path / "results")), tmp_path / "log"
    first = names(subtitles(spark, str(media), fake(log, {1}), store).collect())
    assert set(first) == {"b.wav"} and log.read_text().count("\n") == 3
    second = subtitles(spark, str(media), fake(log), store).cache()
    assert log.read_text().count("\n") == 4 and log.read_text().splitlines()[-1] == "a.wav 1"
    assert set(names(second.collect())) == {"a.wav", "b.wav"}
    third = subtitles(spark, str(media), fake(log, {1}), store, rendering=Rendering(word_level=True, allow_partial=True)).collect()
    assert {k: r.srt.splitlines()[2] for k, r in names(third).items()} == {"a.wav": "w", "b.wav": "w"}
    assert log.read_text().count("\n") == 4


def test_a_second_run_opens_no_audio(spark, media, tmp_path):
    """Files whose content is spoilt, but not their length or time, would be told if they were read."""
    store, log = Store(str(tmp_path / "segments"), str(tmp_path / "results")), tmp_path / "log"
    first = {k: r.srt for k, r in names(subtitles(spark, str(media), fake(log), store).collect()).items()}
    for name in ("a.wav", "b.wav"):
        at = os.stat(media / name)
        (media / name).write_bytes(b"?" * at.st_size)
        os.utime(media / name, ns=(at.st_atime_ns, at.st_mtime_ns))
    store.compact(spark)
    again = {k: r.srt for k, r in names(subtitles(spark, str(media), fake(log), store).collect()).items()}
    assert again == first and set(first) == {"a.wav", "b.wav"} and log.read_text().count("\n") == 3
    fresh = names(subtitles(spark, str(media), fake(log), store, resume=False).collect())
    assert not fresh  # now they are read


def test_cuts_that_are_not_whole_are_made_again(spark, media, tmp_path):
    store, log = Store(str(tmp_path / "segments"), str(tmp_path / "results")), tmp_path / "log"
    first = names(subtitles(spark, str(media), fake(log), store).collect())
    segments, _, manifest = store.tables(spark)
    rows = kept(segments.read().filter("not (recording_id like '%a.wav' and segment_idx = 1)"), "fewer")
    cut_store = Store(str(tmp_path / "segments2"), str(tmp_path / "results"), str(tmp_path / "manifest2"))
    fewer, _, counted = cut_store.tables(spark)
    fewer.append(rows)
    counted.append(manifest.read())
    assert [os.path.basename(r.recording_id) for r in whole_cuts(counted.read(), fewer.read()).collect()] == ["b.wav"]
    again = names(subtitles(spark, str(media), fake(log), cut_store).collect())
    assert {k: r.srt for k, r in again.items()} == {k: r.srt for k, r in first.items()}
    assert {(os.path.basename(r.recording_id), r.attempt) for r in counted.read().filter("status = 'ok'").collect()} == {("a.wav", 2), ("b.wav", 1)}


def test_failures_are_outcomes(spark, media, tmp_path):
    store, log = Store(str(tmp_path / "segments"), str(tmp_path / "results")), tmp_path / "log"
    absent = f"file:{tmp_path}/gone.wav"
    paths = [r.path for r in scan_media(spark, str(media), (".wav",)).collect() if "fast" not in r.path] + [absent]
    requested = spark.createDataFrame([(p,) for p in [*paths, absent]], "path string")
    for attempt in (1, 2):
        docs = names(subtitles(spark, str(media), fake(log), store, requested=requested).collect())
        assert set(docs) == {"a.wav", "b.wav"} and log.read_text().count("\n") == 3
        results = store.tables(spark)[1].read()
        errors = {os.path.basename(r.recording_id): (r.error, r.attempt) for r in results.filter("status = 'error'").collect()}
        assert errors.keys() == {"stereo.wav", "bytes.wav", "cut.wav", "gone.wav"}
        assert errors["gone.wav"] == ("File not found", attempt) and errors["stereo.wav"][0].startswith("not mono") and errors["cut.wav"] == ("the file ends in its header", attempt)
        keys = results.select("recording_id", "run_key").distinct()
        counts = {k: (r.total, r.successful, r.failed) for k, r in names(run_counts(spark, store, keys).collect()).items()}
        assert counts == {"a.wav": (2, 2, 0), "b.wav": (1, 1, 0)} | dict.fromkeys(("stereo.wav", "bytes.wav", "cut.wav", "gone.wav"), (1, 0, 1))


def test_language_of_the_first_segment_is_told_to_the_rest(spark, tmp_path):
    root, log = tmp_path / "media", tmp_path / "log"
    root.mkdir()
    for name in ("a", "b"):
        wav(root / f"{name}.wav", np.resize([2000, -2000], 16000 * 130))
    store = Store(str(tmp_path / "segments"), str(tmp_path / "results"))

    def make():
        def model(row):
            with open(log, "a") as f:
                f.write(f"{os.path.basename(row['recording_id'])[0]} {row['segment_idx']} {row['detected_language']}\n")
            if row["recording_id"].endswith("b.wav") and row["segment_idx"] == 0:
                raise ValueError("deaf")
            return {"language": "it" if row["segment_idx"] else "fr", "segments": [{"start": 0.0, "end": 1.0, "text": "x"}]}

        return model

    subtitles(spark, str(root), make, store).collect()
    calls = log.read_text().splitlines()
    assert len(calls) == len({c.rsplit(" ", 1)[0] for c in calls}) == 6  # no segment twice
    assert {c for c in calls if c[0] == "a"} == {"a 0 None", "a 1 fr", "a 2 fr"} and {c for c in calls if c[0] == "b"} == {"b 0 None", "b 1 None", "b 2 None"}
    segments, results, _ = store.tables(spark)
    assert {(os.path.basename(r.recording_id)[0], r.segment_idx): r.language for r in results.read().collect()} == {("a", 0): "fr", ("a", 1): "fr", ("a", 2): "fr", ("b", 0): None, ("b", 1): "it", ("b", 2): "it"}
    assert {(os.path.basename(r.recording_id)[0], r.detected_language) for r in segments.read().collect()} == {("a", "fr"), ("b", None)}


def work(spark, n, **columns):
    rows = spark.range(n).select(F.lit("r").alias("recording_id"), F.lit("k").alias("run_key"), F.col("id").cast("int").alias("segment_idx"), F.lit(1).alias("attempt"))
    return rows.withColumns(columns)


def test_models_get_bounded_batches(spark, tmp_path):
    log = str(tmp_path / "log")

    def make():
        with open(log, "a") as f:
            f.write(f"load {os.getpid()}\n")

        def model(rows):
            with open(log, "a") as f:
                f.write(f"{len(rows)}\n")
            if any(r["segment_idx"] == 13 for r in rows):
                raise ValueError("bad")
            return [None if r["segment_idx"] == 20 else {"language": "en", "segments": []} for r in rows]

        return model

    rows = transcribe(work(spark, 100), make, "batches", partitions=3, batch_size=8, batched=True).collect()
    assert {r.segment_idx: r.error for r in rows if r.status != "ok"} == {13: "ValueError: bad", 20: "No result returned"} and len(rows) == 100
    lines = open(log).read().split("\n")[:-1]
    sizes, loads = [int(x) for x in lines if x.isdigit()], [x for x in lines if not x.isdigit()]
    assert max(sizes) == 8 and sum(x > 1 for x in sizes) <= 16 and len(loads) == len(set(loads))
    short = transcribe(work(spark, 2), lambda: lambda rows: [], "short", partitions=1, batched=True).collect()
    assert {r.error for r in short} == {"ValueError: 0 answers to 1 segments"}


def test_models_are_evicted():
    made, held = [], Models()
    for key in ("a", "b", "a", "c", "a", "b"):
        held.get(key, lambda: made.append(key), 2)  # noqa: B023
    assert made == ["a", "b", "c", "b"] and len(held.held) == 2


def test_alignment_loads_few_models_and_splits_a_hot_language(spark, tmp_path):
    log = str(tmp_path / "log")

    def make(ref):
        with open(log, "a") as f:
            f.write(f"{ref} {os.getpid()}\n")
        return lambda row: {"word_segments": [{"word": ref, "start": 0.0, "end": 1.0, "score": 1.0}]}

    n = F.col("segment_idx")
    language = F.when(n < 600, "en").when(n < 700, "fr").when(n < 750, "xx").otherwise(F.lit(None).cast("string"))
    good = work(spark, 800, status=F.when(n % 10 == 0, "error").otherwise("ok"), error=F.when(n % 10 == 0, "deaf"), unexpected=F.lit(False), language=language, segments=F.lit(None).cast(RESULTS["segments"].dataType), word_segments=F.lit(None).cast(RESULTS["word_segments"].dataType))
    registry = spark.createDataFrame([("en", "m-en"), ("fr", "m-fr")], "language string, model_ref string")
    spread = align(good, registry, make, "t", rows_per_task=100, models=1)
    rows = {r.segment_idx: r for r in spread.withColumn("task", F.spark_partition_id()).collect()}
    assert len(rows) == 800
    for k, r in rows.items():
        if k % 10 == 0:
            assert (r.status, r.error) == ("error", "deaf")
        elif k < 700:
            assert r.status == "ok" and r.word_segments[0].word == ("m-en" if k < 600 else "m-fr")
        else:
            assert r.status == "error" and r.error == f"No alignment model for {'xx' if k < 750 else 'unknown language'}"
    tasks = {ref: {r.task for k, r in rows.items() if r.word_segments and r.word_segments[0].word == ref} for ref in ("m-en", "m-fr")}
    assert len(tasks["m-en"]) > 2  # six tasks' worth, dealt by hash
    loads = open(log).read().splitlines()
    assert len(loads) <= len(tasks["m-en"]) + len(tasks["m-fr"])  # no task loads a model twice


def test_files_appear_whole_or_not_at_all(spark, tmp_path):
    old, folder = tmp_path / "x.srt", tmp_path
    old.write_text("old")
    write_srt_files(spark.createDataFrame([(f"file:{folder}/a b.srt", "1\nä\n"), (f"{folder}/y.srt", "2\n")], "srt_path string, srt string"))
    assert (folder / "a b.srt").read_bytes() == "1\nä\n".encode() and (folder / "y.srt").read_text() == "2\n"
    rows = spark.createDataFrame([(f"{folder}/x.srt", "new"), (f"{folder}/z.srt", "new"), (f"{folder}/missing/z.srt", "new")], "srt_path string, srt string")
    broken = rows.unionByName(spark.createDataFrame([(f"{folder}/w.srt", None)], "srt_path string, srt string"))
    with pytest.raises(Exception, match="exception was thrown|aborted"):
        write_srt_files(broken.coalesce(1))
    with pytest.raises(Exception, match="exception was thrown|aborted"):
        write_srt_files(broken.filter("srt_path not like '%missing%'").repartition(4))
    assert old.read_text() == "old" and {x.name for x in folder.iterdir()} >= {"x.srt", "y.srt", "a b.srt"}
    assert not [x.name for x in folder.iterdir() if x.name.endswith(".part") or x.name in ("z.srt", "w.srt")]
    write_srt_files(rows.filter("srt_path like '%x.srt'"))
    assert old.read_text() == "new"


def form(tag=b"RIFF", fmt=None, extra=b"", data=b"", size=None):
    fmt = fmt if fmt is not None else struct.pack("<HHIIHH", 1, 1, 16000, 32000, 2, 16)
    chunks = extra + b"fmt " + struct.pack("<I", len(fmt)) + fmt + b"data" + struct.pack("<I", len(data) if size is None else size) + data
    return tag + struct.pack("<I", 4 + len(chunks)) + b"WAVE" + chunks


def test_headers(tmp_path):
    data = bytes(range(64))
    cases = {
        "plain": (form(data=data), (44, 64)),
        "odd chunk before": (form(extra=b"LIST" + struct.pack("<I", 3) + b"abc\0", data=data), (56, 64)),
        "extended": (form(fmt=struct.pack("<HHIIHH", 0xFFFE, 1, 16000, 32000, 2, 16) + b"\0" * 24, data=data), (68, 64)),
        "open size": (form(data=data, size=0xFFFFFFFF), (44, 64)),
        "64 bits": (form(b"RF64", extra=b"ds64" + struct.pack("<IQQQI", 28, 0, 64, 32, 0), data=data, size=0xFFFFFFFF), (80, 64)),
        "cut short": (form(data=data, size=1000), (44, 64)),
        "odd byte": (form(data=data[:63]), (44, 62)),
        "empty": (form(), (44, 0)),
    }
    for name, (raw, want) in cases.items():
        (tmp_path / name).write_bytes(raw)
        assert pcm.header(f"file:{tmp_path}/{name}") == (*want, None), name
    for name, raw in {"not": b"x" * 100, "no format": b"RIFF\0\0\0\0WAVEdata\0\0\0\0", "float": form(fmt=struct.pack("<HHIIHH", 3, 1, 16000, 64000, 4, 32)), "short": b"RIFF"}.items():
        (tmp_path / name).write_bytes(raw)
        assert pcm.header(str(tmp_path / name))[2], name
    assert pcm.header(f"{tmp_path}/nowhere") == (None, None, "File not found")


@pytest.mark.parametrize(("block_ms", "range_bytes"), [(100, 1), (100, 3200 * 3), (70, 10_000), (1000, 32 << 20)])
def test_ranges(spark, tmp_path, block_ms, range_bytes):
    """Lengths at, before and after the edges of blocks and ranges."""
    root = tmp_path / "sounds"
    root.mkdir()
    rng = np.random.default_rng(6)
    sounds = {f"s{n}.wav": rng.integers(-32768, 32768, n) for n in (0, 1, 1599, 1600, 1601, 4800, 4801, 16000 * 3 + 5)}
    for name, x in sounds.items():
        wav(root / name, x)
    (root / "bad.wav").write_bytes(b"RIFF")
    spark.dataSource.register(pcm.WavSource)
    rows = scan_pcm_wav(spark, str(root), block_ms, range_bytes)
    for got in (rows, spark.read.format("wav").option("blockMs", block_ms).option("rangeBytes", range_bytes).load(str(root))):
        found = sorted(got.collect(), key=lambda r: (r.recording_id, r.block_no or 0))
        assert [os.path.basename(r.recording_id) for r in found if r.error] == ["bad.wav"]
        for name, x in sounds.items():
            own = [r for r in found if os.path.basename(r.recording_id) == name]
            assert [(r.block_no, r.start_ms) for r in own] == [(k, k * block_ms) for k in range(-(-len(x) // (16 * block_ms)))]
            assert [s for r in own for s in r.samples] == x.tolist()
    if range_bytes == 1:
        long = rows.filter(F.col("recording_id").endswith("48005.wav")).select(F.spark_partition_id().alias("p")).distinct()
        assert long.count() > 3  # one file, many tasks


def test_state_files(spark, tmp_path):
    good = {"input_file": "a.mp4", "detected_language": "en", "processed_results": {"0": {"segments": [{"start": 0.0, "end": 1.0, "text": "t"}]}, "1": {"error": "bad", "segment_basename": "x"}, "2": None}}
    (tmp_path / "a.json").write_text(json.dumps(good))
    (tmp_path / "b.json").write_text("{not json")
    state = read_state(spark, str(tmp_path))
    assert [r.input_file for r in state.collect()] == ["a.mp4"]
    assert {r.segment_idx: (r.status, r.error) for r in state_results(state, "k").collect()} == {0: ("ok", None), 1: ("error", "bad"), 2: ("error", "No result returned")}


def test_stream_restarts_where_it_ended(spark, tmp_path):
    schema = "recording_id string, run_key string, segment_idx int, attempt int"
    arrivals, out, marks, log = (str(tmp_path / x) for x in ("arrivals", "out", "marks", "log"))
    for part in ([("a", "k", 0, 0), ("a", "k", 0, 0)], [("a", "k", 1, 0)]):
        spark.createDataFrame(part, schema).write.mode("append").parquet(arrivals)
        incremental_results(spark.readStream.schema(schema).parquet(arrivals), fake(log), out, marks, "stream").awaitTermination()
    assert sorted((r.segment_idx, r.status) for r in results_table(spark, out).log().collect()) == [(0, "ok"), (1, "ok")]
    assert open(log).read().count("\n") == 2


def test_stream_that_dies_after_writing_stores_each_row_once(spark, tmp_path, monkeypatch):
    schema = "recording_id string, run_key string, segment_idx int, attempt int"
    arrivals, out, marks, log = (str(tmp_path / x) for x in ("arrivals", "out", "marks", "log"))
    spark.createDataFrame([("a", "k", i, 0) for i in range(5)], schema).write.parquet(arrivals)
    whole = incremental.write_results

    def dying(*args):
        whole(*args)
        raise RuntimeError("killed before the commit")

    monkeypatch.setattr(incremental, "write_results", dying)
    with pytest.raises(Exception, match="killed before the commit"):
        incremental_results(spark.readStream.schema(schema).parquet(arrivals), fake(log), out, marks, "stream").awaitTermination()
    assert results_table(spark, out).log().count() == 5
    monkeypatch.setattr(incremental, "write_results", whole)
    incremental_results(spark.readStream.schema(schema).parquet(arrivals), fake(log), out, marks, "stream").awaitTermination()
    assert sorted(r.segment_idx for r in results_table(spark, out).log().collect()) == [0, 1, 2, 3, 4]


def outcome(spark, rows):
    return spark.createDataFrame([(rec, key, idx, attempt, "ok", None, None, lang, None, None) for rec, key, idx, attempt, lang in rows], RESULTS)


def test_log_table(spark, tmp_path):
    table = results_table(spark, str(tmp_path / "t"))
    assert table.read().count() == 0 and table.version() == 0
    read = lambda: {(r.recording_id, r.segment_idx): (r.attempt, r.language) for r in table.read().collect()}
    for k in range(6):
        table.append(outcome(spark, [(f"r{k % 2}", f"k{k % 2}", 0, k, f"v{k}"), (f"only{k}", "k9", 1, 0, "x")]).coalesce(1))
    table.append(outcome(spark, [("r0", "k0", 0, 1, "late")]), "named")
    table.append(outcome(spark, [("r0", "k0", 0, 2, "late")]), "named")
    want = {("r0", 0): (4, "v4"), ("r1", 0): (5, "v5")} | {(f"only{k}", 1): (0, "x") for k in range(6)}
    assert read() == want and table.log().filter("batch = 'named'").count() == 1
    many = len(table.all().inputFiles())
    assert table.compact() == 1 and read() == want and table.log().count() == 0
    assert len(table.all().inputFiles()) < many
    for _ in range(3):
        few = len(table.all().inputFiles())
        table.append(outcome(spark, [("r0", "k0", 0, 9, "new")]).coalesce(1))
        assert len(table.all().inputFiles()) == few + 1
        table.compact()
        assert len(table.all().inputFiles()) <= few  # not more, however many appends there were
    assert read() == want | {("r0", 0): (9, "new")} and table.version() == 4


def test_a_compaction_that_dies_changes_nothing(spark, tmp_path, monkeypatch):
    table = results_table(spark, str(tmp_path / "t"))
    table.append(outcome(spark, [("r", "k", 0, 1, "one")]))
    monkeypatch.setattr(spark, "range", lambda *_: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        table.compact()
    monkeypatch.undo()
    table.append(outcome(spark, [("r", "k", 0, 2, "two")]))
    assert table.version() == 0 and [r.language for r in table.read().collect()] == ["two"]
    assert table.compact() == 1 and [r.language for r in table.read().collect()] == ["two"]


def test_keys_prune_shards(spark, tmp_path):
    table = results_table(spark, str(tmp_path / "t"))
    table.append(outcome(spark, [(f"r{k}", f"k{k}", 0, 1, f"v{k}") for k in range(200)]))
    table.compact()
    table.append(outcome(spark, [("r7", "k7", 0, 2, "new"), ("r8", "k8", 0, 2, "new")]))
    got = table.read_for(spark.createDataFrame([("k7",), ("k50",), ("none",)], "run_key string"))
    assert {(r.recording_id, r.language) for r in got.collect()} == {("r7", "new"), ("r50", "v50")}
    plan = got._jdf.queryExecution().toString()
    assert re.search(r"PartitionFilters: \[[^]]*shard#\d+ IN \(", plan)
