"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

A pre-token's bytes form a linked list. Each pair that is a token waits in the bucket of its merge rank; a two-level
bitmap of non-empty buckets gives the next rank by find-first-set. A position whose pair has changed since is stale
and skipped. A merge costs the same however long the pre-token is.

Null and empty texts have no ids and decode to no bytes. Null ids decode to null, and so does a list with an id that
the vocabulary lacks. Whole texts are encoded, very long ones in runs of pre-tokens. Repeated rows each get a row; an
empty table gives an empty result; columns of the input are kept (a column named as the output is replaced).
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from captionforge.llm.common import small_batches, table

BLOCK = 8  # bits of a rank below the top bitmap
CACHED = 400_000  # pre-tokens in each of two generations that a worker remembers
CACHED_CHARS = 32 << 20  # and characters of them
RUN = 50_000  # pre-tokens of a very long text at a time
LONG = 1 << 20
SLICE = 1 << 20  # characters of text worked on at once


BITS = [1 << k for k in range(1 << BLOCK)]


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one pre-token.

    ``buckets`` has the positions that wait for each rank, ``low`` a bitmap of the non-empty buckets of each block of
    256 ranks, ``top`` one of the blocks. The queue is written out here, as calls would take half of the time.
    """
    if piece in ranks:
        return [ranks[piece]]
    n, rank_of = len(piece), ranks.get
    after, before = list(range(1, n + 1)), list(range(-1, n))
    pair = [rank_of(piece[i : i + 2], -1) for i in range(n - 1)]
    pair.append(-1)
    buckets: dict[int, list[int]] = {}
    low: dict[int, int] = {}
    top = 0
    fresh = enumerate(pair)
    while True:
        for i, rank in fresh:
            if rank >= 0:
                if (bucket := buckets.get(rank)) is not None:
                    heappush(bucket, i)
                else:
                    buckets[rank] = [i]
                    block = rank >> BLOCK
                    low[block] = low.get(block, 0) | BITS[rank & 255]
                    top |= BITS[block] if block < 256 else 1 << block
        while top:
            block = (top & -top).bit_length() - 1
            bits = low[block]
            rank = block << BLOCK | (bits & -bits).bit_length() - 1
            bucket = buckets[rank]
            i = heappop(bucket)
            if not bucket:
                del buckets[rank]
                low[block] = bits = bits & bits - 1
                if not bits:
                    top ^= 1 << block
            if pair[i] == rank:
                break
        else:
            break
        j = after[i]
        after[i] = k = after[j]
        pair[j] = -1
        if k < n:
            before[k] = i
            pair[i] = new = rank_of(piece[i : after[k]], -1)
        else:
            pair[i] = new = -1
        h = before[i]
        if h >= 0:
            pair[h] = left = rank_of(piece[h:k], -1)
            fresh = ((h, left), (i, new))
        else:
            fresh = ((i, new),)
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : after[i]]])
        i = after[i]
    return ids


@lru_cache(maxsize=2)
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class Encoded(dict):
    """Pre-token to its ids as little-endian 32-bit bytes; what the last generation didn't use is forgotten."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.old: dict[str, bytes] = {}
        self.chars = 0

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece) or array("i", merge(piece.encode(), self.ranks)).tobytes()
        if len(piece) > CACHED_CHARS:
            return ids
        if len(self) >= CACHED or self.chars + len(piece) > CACHED_CHARS:
            self.old = dict(self)
            self.clear()
            self.chars = 0
        self.chars += len(piece)
        self[piece] = ids
        return ids


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str):
    import regex

    return regex.compile(pattern), Encoded(load_ranks(path))


def encode_text(text: str, path: str, pattern: str) -> bytes:
    splitter, known = encoder(path, pattern)
    if len(text) < LONG:
        return b"".join(map(known.__getitem__, splitter.findall(text)))
    matches = splitter.finditer(text)
    runs = []
    while run := [known[m.group()] for m in islice(matches, RUN)]:
        runs.append(b"".join(run))
    return b"".join(runs)


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids", drop_text: bool = False) -> DataFrame:
    """``docs`` with the ids of each text."""
    kept = [f for f in docs.schema.fields if f.name != ids and not (drop_text and f.name == text)]
    schema = T.StructType([*kept, T.StructField(ids, T.ArrayType(T.IntegerType(), False), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in sliced(whole, text):
                parts = [encode_text(t or "", path, pattern) for t in batch.column(text).to_pylist()]
                yield with_list(batch, [f.name for f in kept], ids, parts)

    small_batches(docs)
    return docs.mapInArrow(run, schema)


def sliced(batch: pa.RecordBatch, text: str, size: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``size`` bytes of text each."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < batch.num_rows:
        end = max(start + 1, int(np.searchsorted(sizes, (sizes[start - 1] if start else 0) + size, "right")))
        yield batch.slice(start, end - start)
        start = end


def with_list(batch: pa.RecordBatch, names: list[str], ids: str, parts: list[bytes]) -> pa.RecordBatch:
    offsets = np.zeros(len(parts) + 1, "<i4")
    np.cumsum([len(p) // 4 for p in parts], out=offsets[1:])
    values = pa.Array.from_buffers(pa.int32(), int(offsets[-1]), [None, pa.py_buffer(b"".join(parts))])
    lists = pa.ListArray.from_arrays(pa.array(offsets), values)
    return pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), lists], names=[*names, ids])


@lru_cache(maxsize=2)
def vocabulary(path: str) -> pa.Array:
    """Each id's bytes, null where there is no such id."""
    ranks = load_ranks(path)
    tokens: list[bytes | None] = [None] * (max(ranks.values(), default=-1) + 1)
    for token, i in ranks.items():
        tokens[i] = token
    return pa.array(tokens, pa.binary())


def joined(lists: pa.ListArray, tokens: pa.Array) -> pa.Array:
    """The bytes of each list of ids, all looked up at once: what is taken lies end to end already."""
    values = lists.flatten()
    raw = values.cast(pa.int64()).fill_null(-1).to_numpy(zero_copy_only=False)
    inside = (raw >= 0) & (raw < len(tokens))
    taken = tokens.take(pa.array(np.where(inside, raw, 0), mask=~inside))
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    ends = np.append(0, np.cumsum(sizes, dtype="i8"))
    missing = np.append(0, np.cumsum(taken.is_null().to_numpy(zero_copy_only=False), dtype="i8"))[ends]
    null = lists.is_null().to_numpy(zero_copy_only=False) | (np.diff(missing) > 0)
    at = np.append(0, np.cumsum(pc.fill_null(pc.binary_length(taken), 0).to_numpy(zero_copy_only=False), dtype="i8"))[ends]
    data = pa.Array.from_buffers(pa.large_binary(), len(lists), [None, pa.py_buffer(at), taken.buffers()[2]])
    return pc.if_else(pa.array(null), pa.scalar(None, pa.large_binary()), data).cast(pa.binary())


def decode(rows: DataFrame, path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``rows`` with the bytes of each list of ids."""
    kept = [f for f in rows.schema.fields if f.name != decoded]
    schema = T.StructType([*kept, T.StructField(decoded, T.BinaryType(), True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.name for f in kept]
        tokens = vocabulary(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), joined(batch.column(ids), tokens)], names=[*names, decoded])

    small_batches(rows)
    return rows.mapInArrow(run, schema)


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each row of ``documents``."""
    import public_tokenizers as public

    path = public.path("byte_bpe_50k.tiktoken")
    rows = encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path, public.PATTERN, drop_text=True)
    rows = decode(rows, path)
    return rows.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


QUERIES = {"op6_byte_bpe": op6_byte_bpe}
