"""Normalised audio (mono, 16 kHz, signed 16 bits) as blocks of samples, read by byte ranges.

A file's header is read once, by one ranged read; its samples are then split into ranges of whole blocks, dealt over all
tasks, so that one long file is read by many of them and none holds more than a range. Files may be of any size: sizes
beyond 32 bits are taken from an RF64 header or, where a writer left the size open, from the file's length.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from captionforge.schemas import PCM_BLOCKS
from captionforge.sources.files import located

RATE = 16_000
WIDTH = 2  # bytes of a sample
BLOCK_MS = 10_000
RANGE_BYTES = 32 << 20
#: Fixed values of the format: integer samples, and the extended form that may hold them.
PCM, EXTENSIBLE = 1, 0xFFFE
OPEN_SIZE = 0xFFFFFFFF
NAMES = ["recording_id", "block_no", "start_ms", "samples", "error"]
KINDS = [pa.string(), pa.int32(), pa.int64(), pa.list_(pa.int16()), pa.string()]


def data_of(file: BinaryIO, size: int) -> tuple[int, int]:
    """Where a file's samples start, and their bytes; ValueError if it isn't normalised audio."""

    def taken(n: int) -> bytes:
        if len(got := file.read(n)) < n:
            raise ValueError("the file ends in its header")
        return got

    kind, _, form = struct.unpack("<4sI4s", taken(12))
    if kind not in (b"RIFF", b"RF64") or form != b"WAVE":
        raise ValueError("not a WAV file")
    at, known, long = 12, False, None
    while True:
        name, n = struct.unpack("<4sI", taken(8))
        at += 8
        if name == b"data":
            if not known:
                raise ValueError("samples before their format")
            n = long if kind == b"RF64" and n == OPEN_SIZE and long is not None else size - at if n == OPEN_SIZE else n
            return at, max(0, min(n, size - at)) // WIDTH * WIDTH
        if name == b"ds64":
            long = struct.unpack("<QQ", taken(16))[1]
        elif name == b"fmt ":
            code, channels, rate, _, _, bits = struct.unpack("<HHIIHH", taken(16))
            if code not in (PCM, EXTENSIBLE) or (channels, rate, bits) != (1, RATE, 8 * WIDTH):
                raise ValueError(f"not mono, 16 kHz, 16 bits: {(code, channels, rate, bits)}")
            known = True
        at += n + n % 2
        file.seek(at)


def header(path: str) -> tuple[int | None, int | None, str | None]:
    """Start and bytes of a file's samples, or why there are none."""
    try:
        fs, own = located(path)
        info = fs.get_file_info(own)
        if not info.is_file:
            raise FileNotFoundError("File not found")
        with fs.open_input_file(own) as f:
            return *data_of(f, info.size), None
    except FileNotFoundError:
        return None, None, "File not found"
    except (ValueError, OSError) as e:
        return None, None, str(e) or type(e).__name__


def blocks(path: str, start: int, size: int, first: int, last: int, block_ms: int) -> Iterator[tuple]:
    """Rows of the blocks from ``first`` to before ``last`` of a file, whose samples are ``size`` bytes from ``start``."""
    step = block_ms * RATE // 1000 * WIDTH
    try:
        fs, own = located(path)
        with fs.open_input_file(own) as f:
            f.seek(start + first * step)
            for k in range(first, last):
                raw = f.read(min(step, size - k * step))
                if len(raw) < min(step, size - k * step):
                    raise ValueError("the file became shorter")
                yield path, k, k * block_ms, np.frombuffer(raw, "<i2"), None
    except (ValueError, OSError) as e:
        yield path, None, None, None, str(e) or type(e).__name__


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(KINDS)], names=NAMES)


def scan_pcm_wav(spark: SparkSession, recordings: DataFrame | str | list[str], block_ms: int = BLOCK_MS, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """One row for each block of each recording; a file that can't be read gives one row with an error.

    ``recordings`` (path, length) say which files are opened; a folder or several stand for all files below.
    """
    if not isinstance(recordings, DataFrame):
        recordings = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(recordings).select("path", "length")
    files, size = recordings.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()  # of the catalogue; no file is opened
    step = block_ms * RATE // 1000 * WIDTH
    per = max(1, range_bytes // step)
    tasks = max(1, min(files, spark.sparkContext.defaultParallelism * 4, 10_000))

    def headers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = batch.column("path")
            found = [header(p) for p in paths.to_pylist()]
            yield pa.RecordBatch.from_arrays([paths, *(pa.array([x[k] for x in found], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string())))], names=["path", "start", "size", "error"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start, n, error, first, last in zip(*(batch.column(c).to_pylist() for c in ("path", "start", "size", "error", "first", "last")), strict=True):
                if error is not None:
                    yield batch_of([(path, None, None, None, error)])
                else:
                    for row in blocks(path, start, n, first, last, block_ms):
                        yield batch_of([row])

    opened = recordings.select("path").repartition(tasks, "path").mapInArrow(headers, "path string, start long, size long, error string")
    count = F.ceil(F.col("size") / step)
    firsts = F.when(F.col("error").isNotNull(), F.array(F.lit(0).cast("long"))).when(count > 0, F.sequence(F.lit(0).cast("long"), count - 1, F.lit(per).cast("long")))
    ranges = opened.select("*", count.alias("count"), F.explode(firsts).alias("first")).withColumn("last", F.least(F.col("first") + per, "count"))
    parts = max(tasks, min(100_000, -(-size // (per * step))))
    return ranges.repartition(parts, "path", "first").mapInArrow(read, PCM_BLOCKS)


def lengths(pcm: DataFrame) -> DataFrame:
    """recording_id and length_ms, to the nearest millisecond, of blocks (``samples``) or frames (``n``)."""
    n = F.size("samples") if "samples" in pcm.columns else F.col("n")
    return pcm.filter("error is null").groupBy("recording_id").agg(F.rint(F.sum(n) / (RATE / 1000)).cast("long").alias("length_ms"))


class Slices(InputPartition):
    def __init__(self, slices: list[tuple[str, int, int, int, int]]) -> None:
        self.slices = slices


class WavSource(DataSource):
    """``spark.read.format("wav").load(folder)``: the blocks of all files below a folder, without a catalogue.

    A partition is a list of slices (path, samples' start and bytes, first and last block) of at most ``rangeBytes``:
    part of a long file, or several short ones. Headers are read once, at planning, by ``threads`` at a time.
    Options: blockMs, rangeBytes, threads. For very many files, ``scan_pcm_wav`` reads the headers in tasks instead.
    """

    @classmethod
    def name(cls) -> str:
        return "wav"

    def schema(self) -> str:
        return PCM_BLOCKS

    def reader(self, schema) -> WavReader:  # noqa: ANN001
        return WavReader(self.options)


class WavReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        if not options.get("path"):
            raise ValueError("a folder is needed: load(folder)")
        self.path = options["path"]
        self.block_ms, self.range_bytes, self.threads = (int(options.get(k, v)) for k, v in (("blockMs", BLOCK_MS), ("rangeBytes", RANGE_BYTES), ("threads", 16)))

    def partitions(self) -> list[Slices]:
        from concurrent.futures import ThreadPoolExecutor

        from pyarrow.fs import FileSelector

        fs, own = located(self.path)
        files = sorted(x.path for x in fs.get_file_info(FileSelector(own, recursive=True)) if x.is_file)
        scheme = self.path.partition(":")[0] + "://" if "://" in self.path and not self.path.startswith("file:") else ""
        step = self.block_ms * RATE // 1000 * WIDTH
        per = max(1, self.range_bytes // step)
        out, held = [], 0
        with ThreadPoolExecutor(self.threads) as pool:
            for path, (start, size, _) in zip(files, pool.map(header, [scheme + p for p in files]), strict=True):
                count = -(-(size or 0) // step)
                for first in range(0, count if start is not None else 1, per):
                    last = min(first + per, count)
                    if not out or held + last - first > per:
                        out.append([])
                        held = 0
                    out[-1].append((scheme + path, start if start is not None else -1, size or 0, first, last))
                    held += last - first
        return [Slices(x) for x in out] or [Slices([])]

    def read(self, partition: Slices) -> Iterator[pa.RecordBatch]:
        for path, start, size, first, last in partition.slices:
            if start < 0:
                yield batch_of([(path, None, None, None, header(path)[2] or "unreadable when planned")])
            else:
                for row in blocks(path, start, size, first, last, self.block_ms):
                    yield batch_of([row])
