"""A hidden Markov language model: Baum-Welch over the whole corpus, exact scoring by scaled forward recursion.

Words are lower-cased (A to Z only) runs of ``[^\x20\x09-\x0D]``; each text ends with an end token. The states emit
symbols of a bounded alphabet: the most common words, the end, and classes of all other words by shape. Within its
class a word has probability (count + 1) / (class tokens + class words + 1), counts being exact over all training
texts, so a text's probability covers each of its words and sums to one over texts (an unseen word stands for any
other of its class).

The corpus is read twice: once to count words, once to write each text as symbols plus the counts of its other words.
Training and scoring run on that table. Each Baum-Welch round adds the expected counts of every task; only the
alphabet's and states' totals (a bounded number) reach the driver. Counts of other words are joined by word.

Null text counts as empty: its one token is the end. A null doc_id counts as an empty string for the fold, so it is
in training. Texts of any length are scored whole. Repeated rows each get a row and each count. Without training rows
every word is unknown and the states stay as they began. An empty table gives an empty result. Only doc_id and text
are read, so other columns, whatever their names, don't matter.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from captionforge.llm.byte_bpe import sliced
from captionforge.llm.common import keep, table

END = ""  # no word is empty
LONGEST = 64  # bytes of a word in the alphabet
FLUSH = 150_000  # distinct words that a counting task holds
GROUP = 300_000  # tokens worked on at once, unless one text has more
CLASSES = 3 * 2 * 3 + 1


@dataclass(frozen=True)
class Shape:
    states: int = 8
    words: int = 4096  # of the alphabet
    rounds: int = 3
    folds: int = 7
    held_out: int = 2
    seed: int = 7


def shape_class(word: bytes) -> int:
    """Class of a word outside the alphabet: with a digit, or by last byte, ASCII or not, and length."""
    if any(48 <= b <= 57 for b in word):
        return CLASSES - 1
    last = {44: 0, 46: 1}.get(word[-1], 2)
    size = 0 if len(word) <= 6 else 1 if len(word) <= 11 else 2
    return (last * 2 + (not word.isascii())) * 3 + size


def split(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def count_words(training: DataFrame) -> DataFrame:
    """word and c, its tokens in the training texts; the end token is the empty word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array([w.decode() for w in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])
            counts.clear()
            return made

        for whole in batches:
            for batch in sliced(whole, "text"):
                for text in batch.column("text").to_pylist():
                    counts.update(split(text))
                counts[b""] += batch.num_rows
                if len(counts) > FLUSH:
                    yield out()
        yield out()

    return training.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("c"))


def as_symbols(docs: DataFrame, alphabet: list[str]) -> DataFrame:
    """doc_id, held_out, row (unique), symbols, and the words outside the alphabet with their counts."""
    shared = docs.sparkSession.sparkContext.broadcast({w.encode(): i for i, w in enumerate(alphabet)})
    size = len(alphabet)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, row = shared.value, TaskContext.get().partitionId() << 40
        look = lambda w: known.get(w, -1)
        for whole in batches:
            for batch in sliced(whole, "text"):
                symbols, words, counts, ends, rare_ends = [], [], [], [0], [0]
                for text in batch.column("text").to_pylist():
                    tokens = split(text)
                    ids = np.fromiter(map(look, tokens), "<i2", len(tokens))
                    rare: dict[bytes, int] = {}
                    for i in np.flatnonzero(ids < 0).tolist():
                        w = tokens[i]
                        ids[i] = size + 1 + shape_class(w)
                        rare[w] = rare.get(w, 0) + 1
                    symbols += [ids, np.array([size], "<i2")]
                    ends.append(ends[-1] + len(tokens) + 1)
                    words += [w.decode() for w in rare]
                    counts += rare.values()
                    rare_ends.append(len(words))
                edges = pa.array(rare_ends, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id"),
                        batch.column("held_out"),
                        pa.array(np.arange(row, row + batch.num_rows)),
                        pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(symbols))),
                        pa.ListArray.from_arrays(edges, pa.array(words, pa.string())),
                        pa.ListArray.from_arrays(edges, pa.array(counts, pa.int32())),
                    ],
                    names=["doc_id", "held_out", "row", "symbols", "words", "counts"],
                )
                row += batch.num_rows

    return docs.mapInArrow(run, "doc_id long, held_out boolean, row long, symbols array<short>, words array<string>, counts array<int>")


class Group:
    """Texts of like length laid out by time: at time t the first ``active[t]`` of them (longest first) have a token."""

    def __init__(self, texts: list[np.ndarray]) -> None:
        lengths = np.array([len(x) for x in texts])
        self.active = np.cumsum(np.bincount(lengths - 1)[::-1])[::-1]
        self.at = np.cumsum(self.active) - self.active
        self.symbols = np.empty(lengths.sum(), "i4")
        self.text = np.empty(lengths.sum(), "i4")
        for k, x in enumerate(texts):
            place = self.at[: len(x)] + k
            self.symbols[place] = x
            self.text[place] = k

    def forward(self, model: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scaled state probabilities, scales, and emissions of every token."""
        start, move, emit = model
        emitted = emit[self.symbols]
        state, scale = np.empty_like(emitted), np.empty(len(emitted), emitted.dtype)
        before = None
        for a, b in zip(self.at.tolist(), self.active.tolist(), strict=True):
            now, s = state[a : a + b], scale[a : a + b]
            if before is None:
                now[:] = start
            else:
                np.dot(before[:b], move, out=now)
            now *= emitted[a : a + b]
            now.sum(1, out=s)
            now /= s[:, None]
            before = now
        return state, scale, emitted

    def expected(self, model: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """Expected starts, moves and emissions (by symbol), and the log likelihood."""
        start, move, emit = model
        state, scale, emitted = self.forward(model)
        moves = np.zeros_like(move, "f8")
        later = np.ones((self.active[-1], len(move)), emitted.dtype)
        back = np.ascontiguousarray(move.T)
        for t in range(len(self.at) - 2, -1, -1):
            a, b = self.at[t], self.active[t]
            a1, b1 = self.at[t + 1], self.active[t + 1]
            flow = emitted[a1 : a1 + b1] * later
            flow /= scale[a1 : a1 + b1, None]
            moves += state[a : a + b1].T @ flow
            state[a1 : a1 + b1] *= later
            later = np.ones((b, len(move)), emitted.dtype)
            np.dot(flow, back, out=later[:b1])
        state[: self.active[0]] *= later
        seen = np.stack([np.bincount(self.symbols, state[:, k], len(emit)) for k in range(len(move))], 1)
        return state[: self.active[0]].sum(0, dtype="f8"), moves * move, seen, float(np.log(scale, dtype="f8").sum())


def groups(lists: pa.ListArray) -> Iterator[tuple[np.ndarray, Group]]:
    """The batch's texts by length, in groups of about ``GROUP`` tokens, with their places in the batch."""
    ends, values = lists.offsets.to_numpy(), lists.values.to_numpy()
    order = np.argsort(ends[:-1] - ends[1:], kind="stable")
    room = np.cumsum(np.diff(ends)[order]) // GROUP
    for part in np.split(order, np.flatnonzero(np.diff(room)) + 1):
        if len(part):
            yield part, Group([values[ends[i] : ends[i + 1]] for i in part])


def expectations(rows: DataFrame, model: tuple) -> DataFrame:
    """Sums of expected counts: kind (0 start, 1 move, 2 emission), index, and one column for each state."""
    states = len(model[0])
    shared = rows.sparkSession.sparkContext.broadcast(tuple(x.astype("f4") for x in model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, total = shared.value, None
        for batch in batches:
            for _, group in groups(batch.column("symbols")):
                got = group.expected(own)
                total = got[:3] if total is None else tuple(a + b for a, b in zip(total, got[:3], strict=True))
        if total is not None:
            start, moves, seen = total
            used = np.flatnonzero(seen.any(1))
            kinds = np.repeat(np.array([0, 1, 2], "i4"), [1, states, len(used)])
            index = np.concatenate([[0], np.arange(states), used]).astype("i4")
            values = np.concatenate([start[None], moves, seen[used]])
            yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(index), *(pa.array(np.ascontiguousarray(values[:, k])) for k in range(states))], names=["kind", "index", *(f"s{k}" for k in range(states))])

    made = rows.select("symbols").mapInArrow(run, "kind int, index int, " + ", ".join(f"s{k} double" for k in range(states)))
    return made.groupBy("kind", "index").agg(*(F.sum(f"s{k}").alias(f"s{k}") for k in range(states)))


def begin(prior: np.ndarray, shape: Shape) -> tuple:
    """Sticky states with emissions strewn around the symbols' own shares."""
    rng = np.random.default_rng(shape.seed)
    emit = prior[:, None] * rng.gamma(0.5, 2.0, (len(prior), shape.states)) + 1e-2 * prior[:, None]
    move = np.full((shape.states, shape.states), 0.02 / max(1, shape.states - 1)) + np.eye(shape.states) * (0.98 - 0.02 / max(1, shape.states - 1))
    return np.full(shape.states, 1 / shape.states), move / move.sum(1, keepdims=True), emit / emit.sum(0)


def improved(counts: list, prior: np.ndarray, states: int) -> tuple:
    """The next model from summed expectations; a little of the prior keeps every probability above zero."""
    start, moves, seen = np.zeros(states), np.zeros((states, states)), np.zeros((len(prior), states))
    for r in counts:
        (start if r[0] == 0 else moves[r[1]] if r[0] == 1 else seen[r[1]])[:] = r[2:]
    start, moves, seen = start + 0.1, moves + 0.1, seen + prior[:, None]
    return start / start.sum(), moves / moves.sum(1, keepdims=True), seen / seen.sum(0)


@dataclass
class Trained:
    alphabet: list[str]
    symbol_counts: np.ndarray  # by symbol: tokens of the word, or of the class
    class_weights: np.ndarray  # by symbol: what a token's probability is divided by, 1 for words of the alphabet
    model: tuple
    tokens: int
    vocabulary: int


def prepare(docs: DataFrame, shape: Shape) -> tuple[DataFrame, DataFrame, Trained]:
    """Word counts, the corpus as symbols, and a model that is not trained yet."""
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % shape.folds
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), (fold == shape.held_out).alias("held_out"))
    counts = keep(count_words(rows.filter(~F.col("held_out"))), "hmm-counts")
    tokens, vocabulary = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    top = counts.filter((F.col("word") != END) & (F.octet_length("word") <= LONGEST)).orderBy(F.desc("c"), "word").limit(shape.words).collect()  # bounded
    alphabet = [r.word for r in top]
    encoded = keep(as_symbols(rows, alphabet), "hmm-symbols")

    known = docs.sparkSession.sparkContext.broadcast(set(alphabet) | {END})

    def shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, v = np.zeros(CLASSES, "i8"), np.zeros(CLASSES, "i8")
        for batch in batches:
            for w, c in zip(batch.column("word").to_pylist(), batch.column("c").to_pylist(), strict=True):
                if w not in known.value:
                    k = shape_class(w.encode())
                    n[k] += c
                    v[k] += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(CLASSES)), pa.array(n), pa.array(v)], names=["k", "n", "v"])

    by_class = {r.k: (r.n, r.v) for r in counts.mapInArrow(shapes, "k long, n long, v long").groupBy("k").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect()}
    ended = counts.filter(F.col("word") == END).first()
    totals = [by_class.get(k, (0, 0)) for k in range(CLASSES)]
    symbol_counts = np.array([*(r.c for r in top), ended.c if ended else 0, *(n for n, _ in totals)], "f8")
    weights = np.array([*(1 for _ in top), 1, *(n + v + 1 for n, v in totals)], "f8")
    prior = (symbol_counts + 1) / (symbol_counts + 1).sum()
    return counts, encoded, Trained(alphabet, symbol_counts, weights, begin(prior, shape), tokens, vocabulary)


def train(encoded: DataFrame, trained: Trained, shape: Shape) -> Trained:
    prior = (trained.symbol_counts + 1) / (trained.symbol_counts + 1).sum()
    for _ in range(shape.rounds):
        counts = expectations(encoded.filter(~F.col("held_out")), trained.model).collect()  # at most symbols + states + 1 rows
        trained.model = improved([tuple(r) for r in counts], prior, shape.states)
    return trained


def score(docs: DataFrame, shape: Shape = Shape()) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row."""
    counts, encoded, trained = prepare(docs, shape)
    trained = train(encoded, trained, shape)
    start, move, emit = trained.model
    shared = docs.sparkSession.sparkContext.broadcast((start, move, emit / trained.class_weights[:, None]))
    words = len(trained.alphabet)
    base = np.log10((trained.symbol_counts[: words + 1] + 1) / (trained.tokens + trained.vocabulary + 1))
    base = np.concatenate([base, np.full(CLASSES, -np.log10(trained.tokens + trained.vocabulary + 1))])
    seen = np.concatenate([trained.symbol_counts[: words + 1] > 0, np.zeros(CLASSES, bool)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            own, plain, known, size = np.zeros(n), np.zeros(n), np.zeros(n, "i8"), np.zeros(n, "i8")
            for part, group in groups(batch.column("symbols")):
                _, scale, _ = group.forward(shared.value)
                m = len(part)
                own[part] = np.bincount(group.text, np.log10(scale), m)
                plain[part] = np.bincount(group.text, base[group.symbols], m)
                known[part] = np.bincount(group.text, seen[group.symbols], m).astype("i8")
                size[part] = np.bincount(group.text, minlength=m)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "held_out", "row")), *map(pa.array, (size, known, plain, own))], names=["doc_id", "held_out", "row", "n_tokens", "known", "plain", "own"])

    scored = encoded.select("doc_id", "held_out", "row", "symbols").mapInArrow(run, "doc_id long, held_out boolean, row long, n_tokens long, known long, plain double, own double")
    rare = encoded.select("row", F.explode(F.arrays_zip("words", "counts")).alias("x")).select("row", F.col("x.words").alias("word"), F.col("x.counts").alias("n"))
    rare = rare.join(counts, "word").groupBy("row").agg(F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("more"), F.sum("n").alias("more_known"))
    out = scored.join(rare, "row", "left")
    more = F.coalesce("more", F.lit(0.0))
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(trained.tokens).cast("long").alias("train_tokens"),
        (F.col("plain") + more).alias("base_score"),
        (F.col("own") + more).alias("score"),
    )


def op8_hmm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each row of ``documents``."""
    return score(table(spark, sf_dir, "documents"))


QUERIES = {"op8_hmm_score": op8_hmm_score}
