"""Subtitle sinks: a folder for each recording, or files of exact names."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from captionforge.sources.files import located


def write_srt_folders(subtitles: DataFrame, path: str) -> None:
    """A folder for each recording below ``path``, by Spark's writer, on any store; other recordings' folders stay."""
    subtitles.select("recording_id", F.regexp_replace("srt", r"\n$", "").alias("value")).repartition("recording_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("recording_id").option("lineSep", "\n").text(path)


def read_srt_folders(spark: SparkSession, path: str) -> DataFrame:
    """recording_id and srt of what ``write_srt_folders`` wrote."""
    return spark.read.text(path, wholetext=True).select(F.col("recording_id").cast("string").alias("recording_id"), F.col("value").alias("srt"))


@dataclass
class Staged(WriterCommitMessage):
    """Files of a task: where each is staged, and its name."""

    files: list[tuple[str, str]]


class SrtSink(DataSource):
    """``write.format("srt")``: each row's ``srt`` to the file of its ``srt_path``, UTF-8, line feeds, no mark.

    Tasks write files of other names beside the final ones; a job that succeeds renames them, one that fails
    removes them and leaves what was there. A document over an older file replaces it; recordings without cues have no
    row, so an older file of theirs stays. Of several rows with one path, one is kept.
    """

    @classmethod
    def name(cls) -> str:
        return "srt"

    def writer(self, schema, overwrite: bool) -> SrtWriter:  # noqa: ANN001
        return SrtWriter()


def forget(files: list[tuple[str, str]]) -> None:
    for staged, _ in files:
        with contextlib.suppress(OSError):
            fs, own = located(staged)
            fs.delete_file(own)


class SrtWriter(DataSourceArrowWriter):
    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        files: list[tuple[str, str]] = []
        try:
            for batch in iterator:
                for path, text in zip(batch.column("srt_path").to_pylist(), batch.column("srt").to_pylist(), strict=True):
                    folder, slash, name = path.rpartition("/")
                    staged = f"{folder}{slash}.{name}.{uuid.uuid4().hex}.part"
                    files.append((staged, path))
                    fs, own = located(staged)
                    with fs.open_output_stream(own) as f:
                        f.write(text.encode())
        except BaseException:
            forget(files)  # what other tasks have staged is for abort
            raise
        return Staged(files)

    def commit(self, messages: list[Staged | None]) -> None:
        def move(x: tuple[str, str]) -> None:
            fs, own = located(x[0])
            fs.move(own, located(x[1])[1])

        with ThreadPoolExecutor(16) as pool:
            list(pool.map(move, [x for m in messages if m for x in m.files]))

    def abort(self, messages: list[Staged | None]) -> None:
        for m in messages:
            if m:
                forget(m.files)


def write_srt_files(subtitles: DataFrame) -> None:
    """Each document to its ``srt_path``; all of them or, if the job fails, none."""
    subtitles.sparkSession.dataSource.register(SrtSink)
    subtitles.select("srt_path", "srt").write.format("srt").mode("append").save()
