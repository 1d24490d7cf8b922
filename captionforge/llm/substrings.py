"""Substring dedup: every word inside a window of 20 words whose word sequence starts earlier in the corpus goes.

Earlier means a smaller doc_id, or the same document and an earlier start; windows are judged on the input.

1. Anchors. Each window's smallest hash among its 6-word runs is its anchor, so equal windows have equal anchors. About
   every eighth run is an anchor; the windows that share one are neighbours, and their words are its context.
2. Classes. Anchor occurrences with equal contexts hold equal windows: all but the first of a class are repeats. Each
   task settles what it can among its own rows, so a passage of every document crosses once for each task.
3. Reference shards. First occurrences whose anchor has other contexts too may share some of their windows. They are
   dealt by anchor into shards; a suffix automaton of a shard's earlier contexts gives the matching statistics of each
   further one, and spans of 20 words or more are repeats. Automata go where their anchors are, not to every task: the
   corpus is its own reference, and all automata for all documents would be quadratic. An anchor with more than
   ``most`` contexts would need an unbounded automaton: its windows are compared by hash aggregation instead.
4. The repeated spans go back to their documents.

Null text has no words; texts of fewer words than a window stay as they are (their words joined by one space). A null
doc_id comes before all others. Rows of one doc_id with different texts count in the order of their texts' hashes; rows
equal in both are one document, so neither removes the other's words. Texts of any length are handled whole. Words and
windows are compared by 64-bit hashes. An empty table gives an empty result; other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from captionforge.llm.byte_bpe import sliced
from captionforge.llm.common import keep, small_batches, table, text_key
from captionforge.llm.jaccard import packed_texts
from captionforge.llm.shingles import BASE, mixed, runs, word_hashes


@dataclass(frozen=True)
class Repeats:
    window: int = 20
    run: int = 6
    most: int = 2000  # contexts of an anchor in one automaton


FIRST = -(1 << 63)  # stands for a null doc_id
BUFFER = 1_000_000  # anchors of a task that are settled together
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE and its inverse to the powers 0 to n, modulo 2**64."""
    up, down = np.full(n + 1, BASE), np.full(n + 1, INVERSE)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def anchors_of(h: np.ndarray, p: Repeats) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of one text's word hashes: each anchor's hash, its context's hash, its first window and how many windows."""
    if len(h) < p.window:
        return (np.zeros(0, "u8"),) * 2 + (np.zeros(0, "i8"),) * 2
    grams = runs(h, p.run)
    reach = p.window - p.run + 1
    at = np.arange(len(h) - p.window + 1) + sliding_window_view(grams, reach).argmin(1)
    first = np.append(0, np.flatnonzero(np.diff(at)) + 1)
    many = np.diff(np.append(first, len(at)))
    anchor = at[first]
    up, down = powers(len(h))
    sums = np.append(np.zeros(1, "u8"), np.cumsum(h * down[:-1]))
    context = (sums[first + many - 1 + p.window] - sums[first]) * up[first]
    return grams[anchor], mixed(context + many.astype("u8") * np.uint64(0xD6E8FEB86659FD93) + (anchor - first).astype("u8") * np.uint64(0xA5A3564E27F88691)), first, many


def anchors(docs: DataFrame, p: Repeats) -> DataFrame:
    """place (what rows are dealt by), context, did, key, start, many and again (a repeat within the task's rows)."""
    names = ("place", "context", "did", "key", "start", "many", "again")

    def settled(held: list[tuple]) -> pa.RecordBatch:
        g, c, did, key, start, many = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((start, key, did, c, g))
        g, c, did, key, start, many = (x[order] for x in (g, c, did, key, start, many))
        new = np.append(True, (g[1:] != g[:-1]) | (c[1:] != c[:-1])) if len(g) else np.zeros(0, bool)
        head = np.flatnonzero(new)[np.cumsum(new) - 1] if len(g) else np.zeros(0, "i8")
        again = (did != did[head]) | (key != key[head]) | (start != start[head])
        # repeats are settled: they are dealt at random, others by their anchor
        place = np.where(again, mixed(did.astype("u8") * BASE + start.astype("u8")), g)
        return pa.RecordBatch.from_arrays([pa.array(place.view("i8")), pa.array(np.where(again, 0, c).astype("u8").view("i8")), pa.array(did), pa.array(key), pa.array(start.astype("i4")), pa.array(many.astype("i4")), pa.array(again)], names=list(names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for whole in batches:
            for batch in sliced(whole, "text"):
                hashes, ends = word_hashes(batch.column("text").to_pylist(), lower=False)
                for k, (did, key) in enumerate(zip(batch.column("did").to_numpy(), batch.column("key").to_numpy(), strict=True)):
                    g, c, start, many = anchors_of(hashes[ends[k] : ends[k + 1]], p)
                    if len(g):
                        held.append((g, c, np.full(len(g), did), np.full(len(g), key), start, many))
                        size += len(g)
                if size > BUFFER:
                    yield settled(held)
                    held, size = [], 0
        if held:
            yield settled(held)

    return docs.mapInArrow(run, "place long, context long, did long, key long, start int, many int, again boolean")


class Automaton:
    """Suffix automaton of several word sequences."""

    def __init__(self) -> None:
        self.after: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]

    def _state(self, after: dict[int, int], link: int, length: int) -> int:
        self.after.append(after)
        self.link.append(link)
        self.length.append(length)
        return len(self.link) - 1

    def _split(self, p: int, w: int, q: int) -> int:
        """The state for the words of p and then w, where q holds longer ones too."""
        clone = self._state(dict(self.after[q]), self.link[q], self.length[p] + 1)
        while p >= 0 and self.after[p].get(w) == q:
            self.after[p][w] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def add(self, words: list[int]) -> None:
        last = 0
        for w in words:
            q = self.after[last].get(w)
            if q is not None:
                last = q if self.length[q] == self.length[last] + 1 else self._split(last, w, q)
                continue
            new = self._state({}, 0, self.length[last] + 1)
            p = last
            while p >= 0 and w not in self.after[p]:
                self.after[p][w] = new
                p = self.link[p]
            if p >= 0:
                q = self.after[p][w]
                self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, w, q)
            last = new

    def matches(self, words: list[int]) -> list[int]:
        """Matching statistics: the longest match that ends at each word."""
        out, state, n = [], 0, 0
        for w in words:
            while state and w not in self.after[state]:
                state = self.link[state]
                n = self.length[state]
            if w in self.after[state]:
                state = self.after[state][w]
                n += 1
            out.append(n)
        return out


def contexts(rows: DataFrame, p: Repeats) -> DataFrame:
    """From packed texts with their open anchors (``open``: start, many, place, big): the words around each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdDecompressor()
        for whole in batches:
            for s in range(0, whole.num_rows, 100):
                batch = whole.slice(s, 100)
                texts = [press.decompress(x).decode() for x in batch.column("packed").to_pylist()]
                hashes, ends = word_hashes(texts, lower=False)
                signed = hashes.view("i8")
                out: list[tuple] = []
                for k, open_ in enumerate(batch.column("open").to_pylist()):
                    did, key = batch.column("did")[k].as_py(), batch.column("key")[k].as_py()
                    out += [(x["place"], x["big"], did, key, x["start"], signed[ends[k] + x["start"] : ends[k] + x["start"] + x["many"] - 1 + p.window]) for x in open_]
                if out:
                    place, big, did, key, start, words = zip(*out, strict=True)
                    edges = pa.array(np.append(0, np.cumsum([len(w) for w in words])).astype("i4"))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(place, pa.int64()), pa.array(big, pa.bool_()), pa.array(did, pa.int64()), pa.array(key, pa.int64()), pa.array(start, pa.int32()), pa.ListArray.from_arrays(edges, pa.array(np.concatenate(words)))],
                        names=["place", "big", "did", "key", "start", "words"],
                    )

    return rows.mapInArrow(run, "place long, big boolean, did long, key long, start int, words array<long>")


def streamed(around: DataFrame, p: Repeats) -> DataFrame:
    """did, key, start, many: windows of contexts that an earlier context of the same anchor holds."""
    dealt = around.repartition("place").sortWithinPartitions("place", "did", "key", "start")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, automaton, before = None, Automaton(), None
        for batch in batches:
            found: list[tuple[int, int, int]] = []
            columns = [batch.column(c).to_pylist() for c in ("place", "did", "key", "start", "words")]
            for at, did, key, start, words in zip(*columns, strict=True):
                if at != place:
                    place, automaton, before = at, Automaton(), None
                if before == (did, key, start):
                    continue
                before = (did, key, start)
                found += [(did, key, start + e - p.window + 1) for e, n in enumerate(automaton.matches(words)) if n >= p.window]
                automaton.add(words)
            did, key, start = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(did, pa.int64()), pa.array(key, pa.int64()), pa.array(start, pa.int32()), pa.array([1] * len(found), pa.int32())], names=["did", "key", "start", "many"])

    return dealt.select("place", "did", "key", "start", "words").mapInArrow(run, "did long, key long, start int, many int")


def aggregated(around: DataFrame, p: Repeats) -> DataFrame:
    """The same for anchors with very many contexts, by aggregating window hashes, whatever their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends, values = batch.column("words").offsets.to_numpy(), batch.column("words").values.to_numpy().view("u8")
            hashes = [runs(values[a:b], p.window) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            row = np.repeat(np.arange(len(hashes)), [len(x) for x in hashes])
            within = np.concatenate([np.arange(len(x)) for x in hashes]) if hashes else np.zeros(0, "i8")
            made = np.concatenate(hashes).view("i8") if hashes else np.zeros(0, "i8")
            start = batch.column("start").to_numpy()[row] + within
            yield pa.RecordBatch.from_arrays([pa.array(made), batch.column("did").take(pa.array(row)), batch.column("key").take(pa.array(row)), pa.array(start.astype("i4"))], names=["h", "did", "key", "start"])

    windows = keep(around.select("did", "key", "start", "words").mapInArrow(run, "h long, did long, key long, start int"), "substrings-windows")
    place = F.struct("did", "key", "start")
    first = windows.groupBy("h").agg(F.min(place).alias("first"), F.max(place).alias("last")).filter("first <> last").select("h", "first")
    return windows.join(first, "h").filter(place > F.col("first")).select("did", "key", "start", F.lit(1).alias("many"))


def repeats(docs: DataFrame, p: Repeats) -> DataFrame:
    """did, key, start and many: runs of repeated windows; ``docs`` has did, key, doc_id and text."""
    rows = anchors(docs.select("did", "key", "text"), p).repartition("place")
    own, all_ = Window.partitionBy("place", "context"), Window.partitionBy("place")
    who = F.struct("did", "key", "start")
    rows = rows.withColumn("first", F.min(who).over(own)).withColumns({"lo": F.min("context").over(all_), "hi": F.max("context").over(all_), "n": F.count("*").over(all_)})
    sure = F.col("again") | (who > F.col("first"))
    state = F.when(sure, 1).when(F.col("lo") < F.col("hi"), F.when(F.col("n") <= p.most, 2).otherwise(3))
    known = keep(rows.select("did", "key", "start", "many", "place", state.alias("state")).filter("state is not null"), "substrings-anchors")
    open_ = known.filter("state > 1").groupBy("did", "key").agg(F.collect_set(F.struct("start", "many", "place", (F.col("state") == 3).alias("big"))).alias("open"))
    packed = packed_texts(docs.select(F.col("did").alias("doc_id"), "key", "text")).withColumnRenamed("doc_id", "did").dropDuplicates(["did", "key"])
    around = keep(contexts(packed.join(open_, ["did", "key"]), p), "substrings-contexts")
    more = keep(streamed(around.filter("not big"), p).unionByName(aggregated(around.filter("big"), p)), "substrings-found")
    return known.filter("state = 1").select("did", "key", "start", "many").unionByName(more)


def remove(docs: DataFrame, p: Repeats = Repeats()) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the words that stay, joined by one space) of each row."""
    small_batches(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumns({"did": F.coalesce("doc_id", F.lit(FIRST)), "key": text_key(F.col("text"))})
    spans = repeats(rows, p).groupBy("did", "key").agg(F.collect_set(F.struct("start", "many")).alias("spans"))
    packed = packed_texts(rows.select(F.col("did").alias("doc_id"), "key", "text")).withColumnRenamed("doc_id", "did")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdDecompressor()
        for whole in batches:
            for s in range(0, whole.num_rows, 200):
                batch = whole.slice(s, 200)
                n, gone, kept = [], [], []
                for packed_text, found in zip(batch.column("packed").to_pylist(), batch.column("spans"), strict=True):
                    words = press.decompress(packed_text).split()
                    edges = np.zeros(len(words) + 1, "i4")
                    if found.is_valid:
                        start, many = (found.values.field(f).to_numpy() for f in ("start", "many"))
                        np.add.at(edges, start, 1)
                        np.add.at(edges, start + many - 1 + p.window, -1)
                    stays = np.cumsum(edges[:-1]) == 0
                    left = words if stays.all() else [words[i] for i in np.flatnonzero(stays).tolist()]
                    n.append(len(words))
                    gone.append(len(words) - len(left))
                    kept.append(b" ".join(left).decode())
                did = batch.column("did").to_pylist()
                yield pa.RecordBatch.from_arrays([pa.array([None if d == FIRST else d for d in did], pa.int64()), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    return packed.join(spans, ["did", "key"], "left").select("did", "packed", "spans").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each row of ``documents``."""
    return remove(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op7_substring_dedup": op7_substring_dedup}
