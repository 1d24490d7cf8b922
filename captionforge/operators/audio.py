"""Energy of frames, silent windows, runs of them, and cuts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from captionforge.config import Cutting

SAMPLES_PER_MS = 16
FULL_SCALE = 32_768
BLOCK_MS = 10_000
FANOUT = 1_000_000  # blocks of one level that make one of the next
WIDEST = 10**16  # milliseconds; no recording is as long


def energy_limit(threshold_db: float, samples: int) -> int:
    """A window is silent if its sum of squares is less: its root mean square, rounded down, is at most the threshold."""
    level = int(10 ** (threshold_db / 20) * FULL_SCALE) + 1
    return level * level * samples


def frame_energy(pcm: DataFrame, samples_per_frame: int = SAMPLES_PER_MS) -> DataFrame:
    """recording_id, block_no, ms, e (sum of squares) and n (samples) of every millisecond of the blocks.

    Each batch of blocks is one segmented sum over its samples, the last frame of a block with what is left. A block
    with an error (column ``error``, if there) becomes one row with that error and no frame.
    """
    kind = pcm.schema["recording_id"].dataType.simpleString()
    failing = "error" in pcm.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("samples").fill_null([]) if batch.column("samples").null_count else batch.column("samples")
            x = lists.flatten().to_numpy(zero_copy_only=False).astype("i8")
            sizes = np.diff(np.asarray(lists.offsets)).astype("i8")
            frames = -(-sizes // samples_per_frame)
            block = np.repeat(np.arange(len(sizes)), frames)
            place = np.arange(frames.sum()) - np.repeat(np.cumsum(frames) - frames, frames)
            first = (np.cumsum(sizes) - sizes)[block] + place * samples_per_frame
            e = np.add.reduceat(x * x, first) if len(first) else np.zeros(0, "i8")
            n = np.minimum(samples_per_frame, sizes[block] - place * samples_per_frame)
            at = pa.array(block)
            columns = [batch.column("recording_id").take(at), batch.column("block_no").take(at).cast(pa.int32()), pa.array(batch.column("start_ms").fill_null(0).to_numpy()[block] + place), pa.array(e), pa.array(n, pa.int32())]
            names = ["recording_id", "block_no", "ms", "e", "n"]
            if not failing:
                yield pa.RecordBatch.from_arrays(columns, names=names)
                continue
            yield pa.RecordBatch.from_arrays([*columns, pa.nulls(len(block), pa.string())], names=[*names, "error"])
            bad = batch.filter(batch.column("error").is_valid())
            if bad.num_rows:
                none = [pa.nulls(bad.num_rows, t) for t in (pa.int32(), pa.int64(), pa.int64(), pa.int32())]
                yield pa.RecordBatch.from_arrays([bad.column("recording_id"), *none, bad.column("error")], names=[*names, "error"])

    own = pcm.select("recording_id", "block_no", F.col("start_ms").cast("long").alias("start_ms"), "samples", *(["error"] if failing else []))
    return own.mapInArrow(run, f"recording_id {kind}, block_no int, ms long, e long, n int" + (", error string" if failing else ""))


def silent_windows(frames: DataFrame, cutting: Cutting = Cutting(), block_ms: int = BLOCK_MS, samples_per_frame: int = SAMPLES_PER_MS) -> DataFrame:
    """recording_id and ms of every start of a complete silent window.

    Sums come from prefix sums inside blocks of ``block_ms`` that overlap by a window, so that neither a long
    recording nor a long window makes a large task.
    """
    k = cutting.min_silence_ms
    full = frames.filter(F.col("n") == samples_per_frame).select("recording_id", "ms", "e")
    block = F.floor(F.col("ms") / block_ms)
    reach = F.floor((F.col("ms") - (k - 1)) / block_ms)
    rows = full.select("*", F.explode(F.sequence(F.greatest(reach, F.lit(0)), block)).alias("block"))
    order = Window.partitionBy("recording_id", "block").orderBy("ms")
    rows = rows.withColumn("c", F.sum("e").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumns({"sum": F.lead("c", k - 1).over(order) - F.col("c") + F.col("e"), "last": F.lead("ms", k - 1).over(order)})
    own = (F.floor(F.col("ms") / block_ms) == F.col("block")) & (F.col("last") == F.col("ms") + k - 1)
    return rows.filter(own & (F.col("sum") < energy_limit(cutting.threshold_db, samples_per_frame * k))).select("recording_id", "ms")


def islands(rows: DataFrame, block: Column) -> DataFrame:
    """Ranges (recording_id, a, b) with those that touch each other made one, inside blocks."""
    order = Window.partitionBy("recording_id", "block").orderBy("a")
    rows = rows.withColumn("block", block)
    rows = rows.withColumn("fresh", F.when(F.col("a") == F.lag("b").over(order) + 1, 0).otherwise(1))
    rows = rows.withColumn("island", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("recording_id", "block", "island").agg(F.min("a").alias("a"), F.max("b").alias("b")).select("recording_id", "a", "b")


def silence_runs(windows: DataFrame, block_ms: int = BLOCK_MS, fanout: int = FANOUT) -> DataFrame:
    """recording_id, a and b: first and last start of each run of adjacent silent windows.

    Runs are found inside blocks; those that touch a block's edge are then joined inside blocks of ``fanout``
    blocks, and so on, while the others stay in their own. So no partition holds more than a block's frames or
    ``2 * fanout`` edges, however long a recording or a silence is.
    """
    place = lambda wide, edge: F.struct(edge.alias("edge"), F.when(edge, F.expr(f"a div {wide}")).otherwise(F.expr(f"a div {block_ms}")).alias("n"))
    rows, width = windows.select("recording_id", F.col("ms").alias("a"), F.col("ms").alias("b")), block_ms
    rows = islands(rows, place(width, F.lit(True)))
    while width < WIDEST:
        edge = (F.col("a") % width == 0) | ((F.col("b") + 1) % width == 0)
        width *= fanout
        rows = islands(rows, place(width, edge))
    return rows


class Fold:
    """Cuts one recording as its stretches of silence come in, in order; holds only those that a cut may still meet."""

    def __init__(self, length: int, cutting: Cutting) -> None:
        self.length, self.c, self.at, self.ahead = length, cutting, 0, []

    def target(self) -> int:
        return min(self.at + self.c.segment_ms, self.length)

    def add(self, a: int, b: int) -> Iterator[tuple[int, int]]:
        """A run of silent window starts; yields the segments that no later run can change."""
        while self.at < self.length and a > self.target() - self.c.min_silence_ms:
            yield self.cut()
        self.ahead.append((a, b))

    def cut(self) -> tuple[int, int]:
        start, end = self.at, self.target()
        if end < self.length and end - start > self.c.search_ms:
            low, high = max(start, end - self.c.search_ms), end - self.c.min_silence_ms
            self.ahead = [r for r in self.ahead if r[1] >= low]
            if self.ahead and (quiet := max(low, self.ahead[0][0])) <= high and quiet > start + self.c.min_silence_ms:
                end = quiet
        self.at = end
        return start, end

    def rest(self) -> Iterator[tuple[int, int]]:
        while self.at < self.length:
            yield self.cut()


def cut_points(length: int, runs: list[tuple[int, int]], cutting: Cutting) -> list[tuple[int, int]]:
    """Segments of one recording: each ends at the first silent window in its tail, or at full length."""
    fold = Fold(length, cutting)
    return [s for a, b in runs for s in fold.add(a, b)] + list(fold.rest())


def cut_segments(lengths: DataFrame, runs: DataFrame, cutting: Cutting = Cutting()) -> DataFrame:
    """segments (recording_id, segment_idx, start_ms, end_ms) that tile each recording.

    Lengths and runs are dealt by recording and sorted; the fold reads them as a stream, so a recording with very many
    silences needs no more memory than another. Runs of recordings without a length are left out.
    """
    kind = lengths.schema["recording_id"].dataType.simpleString()
    none = F.lit(None).cast("long")
    rows = lengths.select("recording_id", F.col("length_ms").cast("long").alias("length_ms"), none.alias("a"), none.alias("b")).filter("length_ms is not null")
    rows = rows.unionByName(runs.select("recording_id", none.alias("length_ms"), F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")))
    rows = rows.repartition("recording_id").sortWithinPartitions("recording_id", F.asc_nulls_first("a"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, fold, k = None, None, 0
        for batch in batches:
            out = []

            def told(segments: Iterator[tuple[int, int]]) -> None:
                nonlocal k
                for a, b in segments:
                    out.append((held, k, a, b))  # noqa: B023  used in this turn of the loop only
                    k += 1

            for rec, length, a, b in zip(*(batch.column(c).to_pylist() for c in ("recording_id", "length_ms", "a", "b")), strict=True):
                if length is not None:
                    if fold:
                        told(fold.rest())
                    held, fold, k = rec, Fold(length, cutting), 0
                elif fold and rec == held:
                    told(fold.add(a, b))
            yield packed(out, batch.schema.field("recording_id").type)
        if fold:
            yield packed([(held, k + j, a, b) for j, (a, b) in enumerate(fold.rest())], batch.schema.field("recording_id").type)

    def packed(rows: list[tuple], key: pa.DataType) -> pa.RecordBatch:
        kinds = zip(("recording_id", "segment_idx", "start_ms", "end_ms"), (key, pa.int32(), pa.int64(), pa.int64()), strict=True)
        return pa.RecordBatch.from_pydict({n: pa.array([r[i] for r in rows], t) for i, (n, t) in enumerate(kinds)})

    return rows.mapInArrow(run, f"recording_id {kind}, segment_idx int, start_ms long, end_ms long")
