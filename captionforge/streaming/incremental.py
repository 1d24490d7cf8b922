"""Results as segments arrive; a restart goes on where the last run ended."""

from __future__ import annotations

from collections.abc import Callable
from hashlib import sha256

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from captionforge.operators.recognise import transcribe
from captionforge.schemas import RESULTS
from captionforge.sources.state import write_results

KEY = ["recording_id", "run_key", "segment_idx", "attempt"]


def incremental_results(arrivals: DataFrame, make_model: Callable, out: str, checkpoint: str, key: str = "default", batch_size: int = 16, batched: bool = False) -> StreamingQuery:
    """Transcribes each arriving segment once and adds its result to the results table ``out``; ends when all that is
    there is done.

    What a micro-batch writes is named by the stream (its checkpoint) and the batch's number. A batch that runs again,
    as the last run died after writing and before the stream noted it, writes under the same name and so replaces
    what is there: each row is stored once.
    """
    stream = sha256(checkpoint.encode()).hexdigest()[:16]

    def write(batch: DataFrame, number: int) -> None:
        done = transcribe(batch.dropDuplicates(KEY), make_model, key, batch_size=batch_size, batched=batched)
        write_results(done.select(*RESULTS.fieldNames()), out, f"stream-{stream}-{number}")

    return arrivals.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
