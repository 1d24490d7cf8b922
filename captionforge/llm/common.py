"""What the operators of this subpackage share: table access, shared storage, word and row-key expressions."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as in the word pattern ``[^\x20\x09-\x0D]+``.
WHITE = " \t\n\x0b\x0c\r"
NO_SPACES = r"[^\x20\x09-\x0D]"
MASK60 = (1 << 60) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share (``spark.checkpoint.dir``); a temporary one only in local runs without it."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = f"file://{tempfile.mkdtemp(prefix='spark-', dir='/tmp')}"
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def keep(df: DataFrame, label: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it again: lineage ends here, a lost executor costs nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(df: DataFrame, rows: int = 1000) -> None:
    """Sends Python workers fewer rows at a time (never more than the session says), to bound their memory."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name, "10000")) <= rows:
        conf.set(name, str(rows))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once for the row, however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def words_of(text: Column) -> Column:
    """Array of words ``[^\x20\x09-\x0D]+``; empty for a text without any.

    White space becomes blanks first, as a text is split at one plain character without the regex engine.
    """
    for c in WHITE[1:]:
        text = F.replace(text, F.lit(c), F.lit(" "))
    return F.array_remove(F.split(text, " "), "")


def text_key(text: Column) -> Column:
    """Tells rows of one doc_id with different texts apart; rows equal in both are interchangeable."""
    return F.xxhash64(text)
