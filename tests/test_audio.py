import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from captionforge.config import Cutting
from captionforge.operators import audio

#: length, silences [from, to), cut points
GOLDEN = [
    (0, [], []),
    (1, [], [1]),
    (60000, [], [60000]),
    (60001, [], [60000, 60001]),
    (150000, [(59000, 59500)], [58992, 118992, 150000]),
    (150000, [(58500, 58700)], [60000, 120000, 150000]),
    (130000, [(57000, 59000)], [58000, 118000, 130000]),
    (130000, [(59600, 62000)], [59592, 119592, 130000]),
    (130000, [(59800, 61000)], [60000, 120000, 130000]),
    (121000, [(58100, 58600), (59500, 59900)], [58092, 118092, 121000]),
]


def frames(spark, cases):
    rows = spark.createDataFrame([(f"r{i}", n, s) for i, (n, s, _) in enumerate(cases) if n], "recording_id string, n long, quiet array<struct<a:long,b:long>>")
    rows = rows.select("recording_id", "quiet", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("ms"))
    silent = F.exists("quiet", lambda q: (F.col("ms") >= q["a"]) & (F.col("ms") < q["b"]))
    return rows.select("recording_id", "ms", F.when(silent, 0).otherwise(16 * 2000 * 2000).cast("long").alias("e"), F.lit(16).alias("n"))


@pytest.mark.parametrize("block_ms", [10_000, 3_777])
def test_cuts(spark, block_ms):
    lengths = spark.createDataFrame([(f"r{i}", n) for i, (n, _, _) in enumerate(GOLDEN)], "recording_id string, length_ms long")
    runs = audio.silence_runs(audio.silent_windows(frames(spark, GOLDEN), block_ms=block_ms))
    rows = audio.cut_segments(lengths, runs).orderBy("recording_id", "segment_idx").collect()
    for i, (_, _, want) in enumerate(GOLDEN):
        own = [r for r in rows if r.recording_id == f"r{i}"]
        assert [r.end_ms for r in own] == want
        assert [r.start_ms for r in own] == [0, *want[:-1]][: len(want)]
        assert [r.segment_idx for r in own] == list(range(len(want)))


def test_cuts_tile_and_lie_in_the_tail():
    rng = random.Random(3)
    for _ in range(200):
        length = rng.randrange(0, 400_000)
        starts = sorted(rng.sample(range(400_000), 2 * rng.randrange(0, 40)))
        runs = list(zip(starts[::2], starts[1::2], strict=True))
        at = 0
        for a, b in audio.cut_points(length, runs, Cutting()):
            assert a == at and a < b <= a + 60_000
            assert b == length or b == a + 60_000 or a + 58_000 <= b <= a + 59_700
            at = b
        assert at == length


def test_energy_is_exact_and_keeps_the_partial_frame(spark):
    pcm = spark.createDataFrame([("r", 0, 0, [3] * 20), ("r", 1, 10, [-2] * 16)], "recording_id string, block_no int, start_ms long, samples array<int>")
    assert {(r.ms, r.e, r.n) for r in audio.frame_energy(pcm).collect()} == {(0, 144, 16), (1, 36, 4), (10, 64, 16)}


def plan_of(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))


def test_energy_is_one_pass_over_batches(spark):
    rng = np.random.default_rng(1)
    rows = [(f"r{k % 3}", k // 3, k // 3 * 10, rng.integers(-32768, 32768, n).tolist()) for k, n in enumerate([160, 0, 160, 1, 17, 160, 16, 15, 33])]
    pcm = spark.createDataFrame(rows, "recording_id string, block_no int, start_ms long, samples array<smallint>")
    want = {(r, b, at + k // 16): (sum(x * x for x in s[k : k + 16]), len(s[k : k + 16])) for r, b, at, s in rows for k in range(0, len(s), 16)}
    energy = audio.frame_energy(pcm)
    assert {(r.recording_id, r.block_no, r.ms): (r.e, r.n) for r in energy.collect()} == want
    assert "Exchange" not in plan_of(energy) and "Generate" not in plan_of(energy)
    failing = spark.createDataFrame([("a", 0, 0, [1] * 16, None), ("b", None, None, None, "bad"), ("c", 0, 0, None, None)], "recording_id string, block_no int, start_ms long, samples array<int>, error string")
    assert {(r.recording_id, r.ms, r.e, r.error) for r in audio.frame_energy(failing).collect()} == {("a", 0, 16, None), ("b", None, None, "bad")}


@pytest.mark.parametrize("fanout", [3, 20, 1_000_000])
def test_runs_over_blocks(spark, fanout):
    """A silence over more than five blocks, one that ends at a block's edge, neighbours, and single frames."""
    starts = {"a": [*range(37, 96), 100, *range(110, 120), *range(120, 121), 200], "b": [*range(9, 11), 19, 20, 29], "c": [0, *range(1_000_000, 1_000_500)]}
    windows = spark.createDataFrame([(r, m) for r, ms in starts.items() for m in ms], "recording_id string, ms long").repartition(5)
    want = {("a", 37, 95), ("a", 100, 100), ("a", 110, 120), ("a", 200, 200), ("b", 9, 10), ("b", 19, 20), ("b", 29, 29), ("c", 0, 0), ("c", 1_000_000, 1_000_499)}
    got = audio.silence_runs(windows, block_ms=10, fanout=fanout)
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(want) and set(rows) == want


def test_no_window_holds_a_recording(spark):
    windows = spark.createDataFrame([("a", 1)], "recording_id string, ms long")
    specs = re.findall(r"Window \[.*?\], \[(.*?)\]", plan_of(audio.silence_runs(windows)))
    assert specs and all("block" in x for x in specs)


def test_folds_read_runs_as_a_stream():
    rng = random.Random(9)
    for _ in range(100):
        cutting = Cutting(segment_ms=rng.choice([50, 400]), search_ms=rng.choice([10, 60, 500]), min_silence_ms=rng.choice([1, 5, 30]))
        starts = sorted(rng.sample(range(5000), 2 * rng.randrange(0, 200)))
        runs, length, at, want = list(zip(starts[::2], starts[1::2], strict=True)), rng.randrange(0, 5200), 0, []
        while at < length:  # the rule itself, over all runs at once
            end = min(at + cutting.segment_ms, length)
            if end < length and end - at > cutting.search_ms:
                quiet = [x for a, b in runs for x in range(max(a, at, end - cutting.search_ms), min(b, end - cutting.min_silence_ms) + 1)]
                if quiet and quiet[0] > at + cutting.min_silence_ms:
                    end = quiet[0]
            want.append((at, end))
            at = end
        assert audio.cut_points(length, runs, cutting) == want
