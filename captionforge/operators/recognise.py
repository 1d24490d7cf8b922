"""Recognition and alignment as batch inference with any callable; a failure is a row, not a failed task."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Iterator
from hashlib import sha256

import pandas as pd
from pyspark import cloudpickle
from pyspark.resource import ResourceProfile, ResourceProfileBuilder, TaskResourceRequests
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from captionforge.config import Recognition
from captionforge.operators.runs import SEGMENT, lookup_align_model
from captionforge.schemas import ANSWER

NAMES = ANSWER.fieldNames()


class Models:
    """Models of one worker by key, loaded at first use; the one used longest ago goes when there are too many."""

    def __init__(self) -> None:
        self.held: OrderedDict[str, Callable] = OrderedDict()

    def get(self, key: str, make: Callable[[], Callable], most: int) -> Callable:
        if key in self.held:
            self.held.move_to_end(key)
            return self.held[key]
        while len(self.held) >= max(1, most):
            self.held.popitem(last=False)  # before loading, so that never more than ``most`` are in memory
        self.held[key] = make()
        return self.held[key]


_recognisers, _aligners = Models(), Models()


def key_of(key: str, make: Callable) -> str:
    """Another maker has a model of its own."""
    return f"{key}-{sha256(cloudpickle.dumps(make)).hexdigest()}"


def resources(spark: SparkSession, recognition: Recognition) -> ResourceProfile | None:
    """What a recognition task asks for, on a cluster; local runs and those that ask for nothing have no profile."""
    if spark.sparkContext.master.startswith("local") or not (recognition.task_cpus or recognition.task_gpus):
        return None
    asks = TaskResourceRequests()
    if recognition.task_cpus:
        asks = asks.cpus(recognition.task_cpus)
    if recognition.task_gpus:
        asks = asks.resource("gpu", recognition.task_gpus)
    return ResourceProfileBuilder().require(asks).build


def failure(error: Exception) -> dict:
    return {"status": "error", "error": f"{type(error).__name__}: {error}", "unexpected": True}


def judged(got: dict | None) -> dict:
    """An answer as a row of the answer schema; none is an error."""
    if got is None:
        return {"status": "error", "error": "No result returned"}
    return {"status": "error" if got.get("error") is not None else "ok", **got}


def answered(model: Callable, rows: list[dict], batched: bool) -> list[dict]:
    """The model's answers. If a batch fails, its rows are tried one by one, so that one bad row spoils no other."""
    if batched:
        try:
            got = list(model(rows))
            if len(got) != len(rows):
                raise ValueError(f"{len(got)} answers to {len(rows)} segments")
            return [judged(x) for x in got]
        except Exception as e:  # noqa: BLE001  one bad segment must not stop the others
            if len(rows) == 1:
                return [failure(e)]
            return [x for r in rows for x in answered(model, [r], True)]
    out = []
    for r in rows:
        try:
            out.append(judged(model(r)))
        except Exception as e:  # noqa: BLE001
            out.append(failure(e))
    return out


def with_answers(batch: pd.DataFrame, rows: list[dict], columns: list[str]) -> pd.DataFrame:
    out = batch[[c for c in batch.columns if c not in NAMES]].copy()
    for name in NAMES:
        out[name] = pd.Series([r.get(name) for r in rows], index=out.index, dtype=object)
    return out[columns]


def records(batch: pd.DataFrame) -> list[dict]:
    return [dict(zip(batch.columns, r, strict=True)) for r in batch.itertuples(index=False, name=None)]


def transcribe(work: DataFrame, make_model: Callable[[], Callable], key: str = "default", partitions: int | None = None, batch_size: int = 16, batched: bool = False, models: int = 1, profile: ResourceProfile | None = None) -> DataFrame:
    """``work`` with the columns of an answer: ``make_model()`` once for each Python worker, its result for each row.

    The model takes a row (a dict) or, ``batched``, a list of at most ``batch_size`` rows, and gives an answer or a list
    of as many. A worker holds at most ``models`` models. ``profile``: what the stage's tasks ask of the cluster.
    """
    schema = T.StructType([*(f for f in work.schema.fields if f.name not in NAMES), *ANSWER.fields])
    columns, own = schema.fieldNames(), key_of(key, make_model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = _recognisers.get(own, make_model, models)
        for batch in batches:
            for k in range(0, len(batch), batch_size):
                part = batch.iloc[k : k + batch_size]
                yield with_answers(part, answered(model, records(part), batched), columns)

    dealt = work.repartition(partitions, *SEGMENT) if partitions else work.repartition(*SEGMENT)
    return dealt.mapInPandas(run, schema, profile=profile)


def align(results: DataFrame, registry: DataFrame, make_aligner: Callable[[str], Callable], key: str = "align", rows_per_task: int = 1000, models: int = 2, profile: ResourceProfile | None = None) -> DataFrame:
    """Successful ``results`` through their language's alignment model: ``make_aligner(model_ref)(row)`` gives new
    ``segments`` and ``word_segments``. A language without a model, or a failing one, makes an error of that segment alone.

    Rows are dealt by model, a model with many rows over as many tasks as it needs, and sorted by it, so that a task
    loads few models; a worker holds at most ``models``, the one used longest ago goes first.
    """
    good, bad = results.filter("status = 'ok'"), results.filter("status <> 'ok' or status is null")
    found = lookup_align_model(good, registry)
    found = found.withColumn("status", F.when(F.col("error").isNotNull(), "error").otherwise(F.col("status")))
    known = found.filter("model_ref is not null")
    shares = known.groupBy("model_ref").agg(F.ceil(F.count("*") / rows_per_task).cast("int").alias("__salts"))
    tasks = shares.agg(F.sum("__salts")).first()[0] or 1
    salt = F.pmod(F.xxhash64(*SEGMENT), F.col("__salts"))
    dealt = known.join(shares, "model_ref").withColumn("__salt", salt).repartition(tasks, "model_ref", "__salt").drop("__salts", "__salt").sortWithinPartitions("model_ref")
    columns = results.columns
    schema = T.StructType([T.StructField(c, results.schema[c].dataType) for c in columns])  # what fails has nulls

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in records(batch):
                ref = row.pop("model_ref")
                try:
                    row |= _aligners.get(f"{own}-{ref}", lambda: make_aligner(ref), models)(row)  # noqa: B023  called at once
                except Exception as e:  # noqa: BLE001
                    row |= {"segments": None, "word_segments": None, **failure(e)}
                out.append(row)
            yield pd.DataFrame({c: pd.Series([r.get(c) for r in out], dtype=object) for c in columns})

    own = key_of(key, make_aligner)
    done = dealt.select(*columns, "model_ref").mapInPandas(run, schema, profile=profile)
    none = found.filter("model_ref is null").withColumns({c: F.lit(None).cast(results.schema[c].dataType) for c in ("segments", "word_segments")})
    return done.unionByName(none.select(*columns)).unionByName(bad)
