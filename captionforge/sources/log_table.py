"""Log-structured tables: appends go to a log, compaction swaps in a snapshot of what counts.

Below the table's folder, ``versions`` has a row for each snapshot, ``snapshot-N`` the rows of snapshot N, ``log-N`` what
was appended since, a folder for each batch. A reader takes the latest version's snapshot and its log, so what it reads
and lists doesn't grow with the appends before. A compaction writes the next snapshot first and its row in ``versions``
last; if it dies between, nothing has changed, and the next one writes over what it left. A batch that is written again
under its name replaces itself. All steps are Spark's own reads and writes, so any store that Spark writes to will do.

One writer at a time; readers may come at any time, as what a version names is never changed. ``snapshot-N`` is dealt
into ``shards`` folders by the key's hash, in column ``shard``: for given keys, only their folders are listed and read.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

VERSION = "version long, at timestamp"


def stored(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """The rows of a folder; none if there is no such folder."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


class LogTable:
    """``schema`` of its rows; ``shard_key``, the column that deals snapshots; ``merge``, what compaction keeps of all rows."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, shard_key: str = "run_key", merge: Callable[[DataFrame], DataFrame] | None = None, shards: int = 64) -> None:
        self.spark, self.path, self.schema, self.shard_key, self.shards = spark, path.rstrip("/"), schema, shard_key, shards
        self.merge = merge or (lambda rows: rows)

    def shard_of(self) -> Column:
        return F.pmod(F.xxhash64(self.shard_key), F.lit(self.shards)).cast("int")

    def version(self) -> int:
        """Of the latest snapshot; 0 before the first."""
        return stored(self.spark, f"{self.path}/versions", VERSION).agg(F.max("version")).first()[0] or 0

    def append(self, rows: DataFrame, batch: str | None = None) -> None:
        """Adds rows as one batch; a batch of the same name that hasn't been compacted yet is replaced."""
        log = f"{self.path}/log-{self.version()}"
        own = rows.select(*self.schema.fieldNames()).withColumn("batch", F.lit(batch or uuid.uuid4().hex))
        own.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(log)

    def log(self) -> DataFrame:
        """What was appended since the snapshot, with its batch."""
        fields = [*self.schema.fields, T.StructField("batch", T.StringType())]
        return stored(self.spark, f"{self.path}/log-{self.version()}", T.StructType(fields))

    def snapshot(self) -> DataFrame:
        fields = [*self.schema.fields, T.StructField("shard", T.IntegerType())]
        n = self.version()
        return stored(self.spark, f"{self.path}/snapshot-{n}", T.StructType(fields)) if n else self.spark.createDataFrame([], T.StructType(fields))

    def all(self) -> DataFrame:
        """All rows of the snapshot and the log, with their shard."""
        return self.snapshot().unionByName(self.log().drop("batch").withColumn("shard", self.shard_of()))

    def read(self) -> DataFrame:
        """The rows that count."""
        return self.merge(self.all().drop("shard")).select(*self.schema.fieldNames())

    def read_for(self, keys: DataFrame) -> DataFrame:
        """The rows that count of the shard keys in ``keys``; only their shards' folders are read."""
        wanted = keys.select(self.shard_key).distinct()
        found = [r.shard for r in wanted.select(self.shard_of().alias("shard")).distinct().collect()]  # at most ``shards``
        rows = self.snapshot().filter(F.col("shard").isin(found)).drop("shard").unionByName(self.log().drop("batch"))
        return self.merge(rows.join(wanted, self.shard_key, "left_semi")).select(*self.schema.fieldNames())

    def compact(self) -> int:
        """Swaps in a snapshot of the rows that count; the number of the new version."""
        n = self.version() + 1
        rows = self.read().withColumn("shard", self.shard_of())
        rows.repartition("shard").write.mode("overwrite").partitionBy("shard").parquet(f"{self.path}/snapshot-{n}")
        self.spark.range(1).select(F.lit(n).cast("long").alias("version"), F.current_timestamp().alias("at")).write.mode("append").parquet(f"{self.path}/versions")
        return n
