"""Packing: concatenate all documents' tokens and cut the stream into sequences of a fixed length.

Texts are tokenised once, into a table in the shared folder that also holds each document's place within its task's
rows. Prefix sums over the tasks' totals (one number each) turn that place into a global offset; fixed windows over
the offsets then cut each document into pieces. A piece whose document goes on in the next sequence is a boundary
record. Only the last sequence can be short, so all the padding is in it.

Strings of special tokens in a text become those tokens, as the tokenizer does by itself, unless ``plain`` is set.
Null text counts as empty; an empty text is its end token alone. A text longer than a sequence is cut as often as
needed. Repeated rows are packed as often as they occur; an empty table gives no piece. Of the input only doc_id and
text are read, so other columns, whatever their names, don't matter.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from captionforge.llm.byte_bpe import sliced
from captionforge.llm.common import keep, small_batches, table

LENGTH = 2048
END = 1
CACHED = 48 << 20  # bytes in each of two generations of words that a worker remembers
ENTRY = 150  # bytes of an entry besides its word and ids
SLICE = 4 << 20  # bytes of text worked on at once
POINTS = ".,;:!?"  # what mostly follows a word
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
#: Letters that neither normalising nor lower-casing joins with or splits from their neighbours, then ASCII that
#: doesn't go on with a letter.
SIMPLE = re.compile("([A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f]+)((?:[\x00-\x40\x5b-\x60\x7b-\x7f][\x00-\x7f]*)?)")
WORD_END = b"\n"


class Words:
    """Ids of words without ASCII white space, as little-endian 32-bit bytes.

    This tokenizer drops white space and never merges across it, nor across the edge between a word's first letters
    and ASCII that follows. Letters alone are one pre-token; its merges, which were learned in the order of their ids,
    are those of rank-ordered byte pairs with an end-of-word byte, so the faster library does them, all new words of a
    batch at once. Everything else goes through the tokenizer itself. What the last generation of words didn't use is
    forgotten.
    """

    def __init__(self, path: str, plain: bool = False) -> None:
        import json

        import tiktoken
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.known: dict[str, bytes] = {"": b""}
        self.old: dict[str, bytes] = {}
        self.size = 0
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain
        with open(path) as f:
            model = json.load(f)["model"]
        vocabulary, ending = model["vocab"], model["end_of_word_suffix"]
        # the printed form of a byte: printable Latin-1 as it is, the rest from code point 256 on
        printed = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        byte = {chr(b): b for b in printed} | {chr(256 + k): b for k, b in enumerate(sorted(set(range(256)) - set(printed)))}
        assert set(byte) == set(ByteLevel.alphabet())
        raw = lambda t: bytes(byte[c] for c in t.removesuffix(ending)) + WORD_END * t.endswith(ending)
        ranks = {raw(t): i for t, i in vocabulary.items() if WORD_END not in bytes(byte[c] for c in t.removesuffix(ending))} | {WORD_END: vocabulary[chr(256 + WORD_END[0])]}
        merged = [vocabulary["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
        assert merged == sorted(merged) and merged[0] == 512  # ids follow the merges
        self.pairs = tiktoken.Encoding("words", pat_str="[^\n]*\n", mergeable_ranks=ranks, special_tokens={})
        self.closes = np.zeros(max(ranks.values()) + 1, bool)
        self.closes[[i for t, i in ranks.items() if t.endswith(WORD_END)]] = True

    def letters(self, words: list[str]) -> list[bytes]:
        """Ids of words of lower-case letters."""
        ids = self.pairs.encode_to_numpy("\n".join(words) + "\n", disallowed_special=()).astype("<u4")
        ends = np.flatnonzero(self.closes[ids]) + 1
        assert len(ends) == len(words)
        data, ends = ids.tobytes(), (4 * ends).tolist()
        return [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def slow(self, text: str) -> bytes:
        return array("i", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def learn(self, words: list[str]) -> None:
        """Makes new words known: letters in lower case in bulk, the others one by one."""
        known = self.known
        simple = [w for w in words if w.isalpha() and w.isascii()]
        made = self.letters(simple) if simple else []
        known.update(zip(simple, made, strict=True))
        self.size += ENTRY * len(words) + sum(map(len, words)) + sum(map(len, made))
        if len(simple) == len(words):
            return
        edges = [(m[1].lower(), m[2], w) if (m := SIMPLE.fullmatch(w)) else ("", w, w) for w in words if not (w.isalpha() and w.isascii())]
        plain = list({a for a, _, _ in edges if a not in known})
        known.update(zip(plain, self.letters(plain) if plain else (), strict=True))
        for first, rest, word in edges:
            if rest not in known:
                known[rest] = self.slow(rest)
            known[word] = known[first] + known[rest]
            self.size += ENTRY + len(known[word])

    def ids_of(self, distinct: list[str]) -> list[bytes]:
        parts = list(map(self.known.get, distinct))
        if None in parts:
            absent = [w for w, x in zip(distinct, parts, strict=True) if x is None]
            held = list(map(self.old.get, absent))
            if new := [w for w, x in zip(absent, held, strict=True) if x is None]:
                self.learn(new)
            again = {w: x for w, x in zip(absent, held, strict=True) if x is not None}
            self.known.update(again)
            self.size += (ENTRY + 16) * len(again)
            parts = list(map(self.known.__getitem__, distinct))
        return parts

    def encode(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text. Words of ASCII letters are looked up in lower case, points after them apart."""
        if self.size > CACHED:
            self.old, self.known, self.size = self.known, {"": b""}, 0
        lists = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
        words = lists.flatten()
        first, rest = pc.ascii_rtrim(words, POINTS), pc.ascii_ltrim(words, LETTERS)
        apart = pc.equal(pc.add(pc.binary_length(first), pc.binary_length(rest)), pc.binary_length(words))
        firsts = pc.if_else(apart, pc.ascii_lower(first), words).dictionary_encode()
        rests = pc.if_else(apart, rest, "").dictionary_encode()
        distinct = firsts.dictionary.to_numpy(zero_copy_only=False).tolist()
        parts = self.ids_of([*distinct, *rests.dictionary.to_pylist()])
        at = np.empty(2 * len(words), "i4")
        at[::2], at[1::2] = firsts.indices.to_numpy(), rests.indices.to_numpy()
        at[1::2] += len(distinct)
        size = np.fromiter(map(len, parts), "i8", len(parts)) // 4
        flat, n = np.frombuffer(b"".join(parts), "<u4"), size[at]
        before = np.append(0, np.cumsum(n))
        ids = flat[np.repeat((np.cumsum(size) - size)[at] - before[:-1], n) + np.arange(before[-1])].tobytes()
        ends = (4 * before[np.append(0, np.cumsum(2 * pc.list_value_length(lists).to_numpy()))]).tolist()
        return [ids[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


@lru_cache(maxsize=1)
def known_words(path: str, plain: bool = False) -> Words:
    return Words(path, plain)


def tokenize(docs: DataFrame, path: str, end: int = END, plain: bool = False) -> DataFrame:
    """doc_id, ids (little-endian 32-bit) with the end token, their number, task and the tokens before them in it.

    ``plain``: strings of special tokens in a text are ordinary text, not those tokens.
    """
    close = np.array([end], "<i4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, task, at = known_words(path, plain), TaskContext.get().partitionId(), 0
        for whole in batches:
            for batch in sliced(whole, "text", SLICE):
                parts = [x + close for x in known.encode(batch.column("text"))]
                n = np.array([len(x) // 4 for x in parts], "i8")
                starts = at + np.cumsum(n) - n
                at += int(n.sum())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.full(len(parts), task, "i4")), pa.array(starts), pa.array(n), pa.array(parts, pa.binary())], names=["doc_id", "task", "at", "n", "ids"])

    small_batches(docs)
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, task int, at long, n long, ids binary")


_PIECE = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, boundary boolean"


def pack(docs: DataFrame, path: str, length: int = LENGTH, end: int = END, plain: bool = False, digests: bool = False) -> DataFrame:
    """Pieces: doc_id, start, length, doc_tokens, sequence_id, offset, boundary (the document goes on after it) and ids.

    ``digests``: ids_crc32, the CRC-32 of the little-endian 32-bit ids, in place of ids.
    """
    tokens = keep(tokenize(docs.withColumn("doc_id", F.col("doc_id").cast("long")), path, end, plain), "packing-tokens")
    totals = tokens.groupBy("task").agg(F.sum("n").alias("n"))  # one row for each task
    bases = totals.select("task", (F.sum("n").over(Window.orderBy("task").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("base"))
    placed = tokens.join(F.broadcast(bases), "task").select("doc_id", (F.col("base") + F.col("at")).alias("at"), "n", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, n = batch.column("at").to_numpy(), batch.column("n").to_numpy()
            first, pieces = at // length, (at + n - 1) // length - at // length + 1
            row = np.repeat(np.arange(len(n)), pieces)
            sequence = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start = np.maximum(sequence * length - at[row], 0)
            stop = np.minimum((sequence + 1) * length - at[row], n[row])
            data = [memoryview(x.as_buffer()) for x in batch.column("ids")]
            cuts = [data[k][4 * a : 4 * b] for k, a, b in zip(row.tolist(), start.tolist(), stop.tolist(), strict=True)]
            if digests:
                made = pa.array(np.array(list(map(zlib.crc32, cuts)), "i8"))
            else:
                ends = np.append(0, np.cumsum(stop - start)).astype("i4")
                made = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(cuts), "<i4")))
            columns = [batch.column("doc_id").take(pa.array(row)), *map(pa.array, (start, stop - start, n[row], sequence, at[row] + start - sequence * length, stop < n[row])), made]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "boundary", "ids_crc32" if digests else "ids"])

    return placed.mapInArrow(run, f"{_PIECE}, ids_crc32 long" if digests else f"{_PIECE}, ids array<int>")


def sequences(pieces: DataFrame) -> DataFrame:
    """sequence_id, its ids and the documents in it; at most the sequence's length of rows meet in a group."""
    part = F.array_sort(F.collect_list(F.struct("offset", "ids", "doc_id"))).alias("parts")
    return pieces.groupBy("sequence_id").agg(part).select("sequence_id", F.flatten("parts.ids").alias("ids"), F.col("parts.doc_id").alias("doc_ids"))


def packed_digests(docs: DataFrame) -> DataFrame:
    import public_tokenizers as public

    return pack(docs, public.path("word_bpe_49k.json"), digests=True).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "boundary")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each piece of each row of ``documents``."""
    return packed_digests(table(spark, sf_dir, "documents"))


QUERIES = {"op1_packing": op1_packing}
