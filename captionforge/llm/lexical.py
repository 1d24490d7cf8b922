"""Ranked lexical search by dual trees: exact best documents of many items.

Terms are runs of ASCII letters and digits and of all characters beyond ASCII, A-Z in lower case. A document's
coordinate of a term is its impact, which grows with the term's occurrences and shrinks with the document's length; an
item's is the term's weight times its occurrences. The score is their inner product, in whole numbers.

Items are read in blocks of bounded size. One pass over all documents keeps their lengths and the occurrences of the
block's terms; counts over that table give the weights. Documents are then taken in chunks. A chunk's documents are
halved again and again at the median between two that are far apart, which makes a binary tree, and so are the items. A node
holds the maximum of each coordinate below it. The product of two nodes' maxima bounds every score between them: if it
is less than the weakest kth score of the node's items, all the pairs are pruned. Otherwise both nodes are split, down
to leaves, which are scored. A small part of the documents, dealt by hash, goes first, and what it finds bounds the rest;
each document is searched in one of the two waves.

Null text has no term. A document's row counts as a document, also if it repeats another; rows without a term aren't
counted. Items are the distinct rows of id and text; an id with several texts has a list for each, and items without
terms have none. Equal scores are ranked by doc_id, null first. Very long texts are counted slice by slice. Empty tables
give an empty result. Only the named columns are read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from captionforge.llm.common import keep, table


@dataclass(frozen=True)
class Ranking:
    k: int = 10
    block_items: int = 512  # about, as items are dealt to blocks by hash
    block_bytes: int = 1 << 20  # of the items' texts
    chunk: int = 2048  # documents of a tree
    leaf: int = 4
    item_leaf: int = 1
    node_bytes: int = 64 << 20  # of the maxima of a chunk's nodes
    first_wave: int = 64  # one of so many documents


#: Letters and digits, in lower case, and everything beyond ASCII; the rest is a blank.
FOLD = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256)).lower()
SLICE = 4 << 20
AXES = 64  # parts that terms are hashed to, to tell documents apart
IMPACT = 1_000_000  # no impact is greater
NULL = np.iinfo("i8").min


def counts(text: bytes, places: dict[bytes, int] | None = None) -> tuple[int, Counter]:
    """Terms of a text, and how often each occurs; with ``places`` by place, all others under None."""
    raw, n, found, at = text.translate(FOLD), 0, Counter(), 0
    while at < len(raw):
        end = raw.find(b" ", at + SLICE) if at + SLICE < len(raw) else -1
        words = (raw[at:end] if end >= 0 else raw[at:] if at else raw).split()
        n += len(words)
        found.update(words if places is None else map(places.get, words))
        at = end if end >= 0 else len(raw)
    return n, found


def vectors(docs: DataFrame, places: dict[bytes, int]) -> DataFrame:
    """doc_id, n (terms), terms (places of those that items have) and tfs of every document with a term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lengths, sizes, terms, tfs = [], [], [0], [], []
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text").cast(pa.binary()), strict=True):
                n, found = counts(text.as_py() or b"", places)
                if n:
                    found.pop(None, None)
                    ids.append(doc_id.as_py())
                    lengths.append(n)
                    terms += found.keys()
                    tfs += found.values()
                    sizes.append(len(terms))
            offsets = pa.array(sizes, pa.int32())
            lists = (pa.ListArray.from_arrays(offsets, pa.array(x, pa.int32())) for x in (terms, tfs))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(lengths, pa.int64()), *lists], names=["doc_id", "n", "terms", "tfs"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<int>")


class Tree:
    """A binary tree over the rows of a sparse matrix: nodes' rows, children and coordinate maxima; the root is node 0."""

    def __init__(self, row: np.ndarray, term: np.ndarray, value: np.ndarray, rows: int, width: int, leaf: int, scale: np.ndarray) -> None:
        spread = np.bincount(row * AXES + term % AXES, value * scale[term], rows * AXES).reshape(rows, AXES)
        self.order, self.range, self.children = np.arange(rows), [(0, rows)], [()]
        k = 0
        while k < len(self.range):
            a, b = self.range[k]
            if b - a > leaf:
                own = self.order[a:b]
                x = spread[own]
                one = x[((x - x.mean(axis=0)) ** 2).sum(axis=1).argmax()]
                other = x[((x - one) ** 2).sum(axis=1).argmax()]
                half = (b - a) // 2
                self.order[a:b] = own[np.argpartition(x @ (one - other), half)]
                self.children[k] = (len(self.range), len(self.range) + 1)
                self.range += [(a, a + half), (a + half, b)]
                self.children += [(), ()]
            k += 1
        place = np.empty(rows, "i8")
        place[self.order] = np.arange(rows)
        by_place = np.argsort(place[row], kind="stable")
        self.term, self.value = term[by_place], value[by_place]
        self.first = np.searchsorted(place[row][by_place], np.arange(rows + 1))
        self.most = np.zeros((len(self.range), width))
        for k in range(len(self.range) - 1, -1, -1):
            if self.children[k]:
                np.maximum(*self.most[list(self.children[k])], out=self.most[k])
            else:
                a, b = (self.first[x] for x in self.range[k])
                np.maximum.at(self.most[k], self.term[a:b], self.value[a:b])

    def rows(self, node: int, terms: np.ndarray) -> np.ndarray:
        """The node's rows as a matrix over some terms, which hold all of the rows'."""
        a, b = self.range[node]
        lo, hi = self.first[a], self.first[b]
        out = np.zeros((b - a, len(terms)), self.value.dtype)
        out[np.repeat(np.arange(b - a), np.diff(self.first[a : b + 1])), np.searchsorted(terms, self.term[lo:hi])] = self.value[lo:hi]
        return out


class Items:
    """A block of items: ids, terms with their places, and, once weights are known, their tree and best documents."""

    def __init__(self, rows: list[tuple[int | None, str | None]]) -> None:
        found = [(i, c) for i, t in rows if (c := counts((t or "").encode("utf-8", "surrogatepass"))[1])]
        self.ids = [i for i, _ in found]
        self.places: dict[bytes, int] = {}
        entries = [(k, self.places.setdefault(t, len(self.places)), n) for k, (_, c) in enumerate(found) for t, n in c.items()]
        self.item, self.term, self.times = np.array(entries, "i8").reshape(-1, 3).T

    def weighted(self, documents: int, df: dict[int, int]) -> None:
        ratio = np.array([(2 * documents + 2) / (2 * df.get(k, 0) + 1) for k in range(len(self.places))])
        self.weight = np.array([math.floor(1000 * math.log(x)) for x in ratio], "i8")


class Search:
    """Chunks of documents against a block of items; holds the best documents so far of each item."""

    def __init__(self, items: Items, kth: np.ndarray, p: Ranking) -> None:
        self.p, self.items, self.width = p, items, len(items.places)
        value = items.times * items.weight[items.term]
        n = len(items.ids)
        self.exact = np.bincount(items.item, value, n).max(initial=0) * IMPACT < 1 << 53  # then doubles hold every sum
        self.tree = Tree(items.item, items.term, value if not self.exact else value.astype("f8"), n, self.width, p.item_leaf, np.ones(self.width))
        self.scale = self.tree.most[0]
        edges = np.array(self.tree.range)
        self.edges = edges.ravel()
        self.kth = kth[self.tree.order]  # in the tree's order
        self.weakest()
        self.i, self.d, self.s = (np.zeros(0, "i8") for _ in range(3))
        self.pairs = self.scored = 0

    def weakest(self) -> None:
        """The least kth score below each node of the items' tree."""
        self.bar = np.minimum.reduceat(np.append(self.kth, np.iinfo("i8").max), self.edges)[::2]

    def bounds(self, nodes: np.ndarray, terms: np.ndarray, most: np.ndarray) -> np.ndarray:
        return self.tree.most[np.ix_(nodes, terms)] @ most * (1 + 1e-9)

    def kept(self, nodes: np.ndarray, terms: np.ndarray, most: np.ndarray) -> np.ndarray:
        b = self.bounds(nodes, terms, most)
        return nodes[(b >= self.bar[nodes]) & (b > 0)]

    def split(self, nodes: np.ndarray) -> np.ndarray:
        return np.array([x for k in nodes.tolist() for x in (self.tree.children[k] or (k,))], "i8")

    def chunk(self, ids: np.ndarray, row: np.ndarray, term: np.ndarray, impact: np.ndarray) -> None:
        docs = Tree(row, term, impact.astype("f8") if self.exact else impact, len(ids), self.width, self.p.leaf, self.scale)
        self.pairs += len(ids) * len(self.kth)
        stack = [(0, np.array([0]))]
        while stack:
            node, nodes = stack.pop()
            terms = np.flatnonzero(docs.most[node])
            most = docs.most[node, terms]
            nodes = self.kept(nodes, terms, most)
            if not len(nodes):
                continue
            if docs.children[node]:
                nodes = self.split(nodes)
                # the more promising child is popped first
                stack += sorted(((c, nodes) for c in docs.children[node]), key=lambda x: docs.most[x[0]] @ self.scale)
                continue
            while any(self.tree.children[k] for k in nodes.tolist()):
                nodes = self.kept(self.split(nodes), terms, most)
            if len(nodes):
                self.leaf(ids[docs.order[slice(*docs.range[node])]], docs.rows(node, terms), terms, nodes)

    def leaf(self, ids: np.ndarray, docs: np.ndarray, terms: np.ndarray, nodes: np.ndarray) -> None:
        """Scores of a leaf's documents and the items of the leaves ``nodes``."""
        items = np.concatenate([np.arange(*self.tree.range[k]) for k in nodes.tolist()])
        weights = np.zeros((len(items), self.width), docs.dtype)
        at = np.concatenate([np.arange(self.tree.first[i], self.tree.first[i + 1]) for i in items.tolist()])
        weights[np.repeat(np.arange(len(items)), self.tree.first[items + 1] - self.tree.first[items]), self.tree.term[at]] = self.tree.value[at]
        scores = (weights[:, terms] @ docs.T).astype("i8")
        self.scored += scores.size
        i, j = np.nonzero((scores >= self.kth[items][:, None]) & (scores > 0))
        if len(i):
            self.add(items[i], ids[j], scores[i, j])

    def add(self, i: np.ndarray, d: np.ndarray, s: np.ndarray) -> None:
        i, d, s = np.append(self.i, i), np.append(self.d, d), np.append(self.s, s)
        order = np.lexsort((d, -s, i))
        i, d, s = i[order], d[order], s[order]
        rank = np.arange(len(i)) - np.searchsorted(i, i)
        on = rank < self.p.k
        self.i, self.d, self.s = i[on], d[on], s[on]
        last = rank == self.p.k - 1
        self.kth[i[last]] = np.maximum(self.kth[i[last]], s[last])
        self.weakest()

    def found(self) -> pa.RecordBatch:
        item = self.tree.order[self.i]
        columns = [pa.array(item, pa.int64()), pa.array([self.items.ids[k] for k in item.tolist()], pa.int64()), pa.array(self.d, pa.int64(), mask=self.d == NULL), pa.array(self.s, pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=["item", "item_id", "doc_id", "score"])


def impacts(tf: np.ndarray, n: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """Of terms that occur ``tf`` times in documents of ``n`` terms, among so many documents and terms."""
    if int(n.max(initial=0)) * 75 * documents >= 1 << 63:
        m = np.array([25 + 75 * x * documents // terms for x in n.tolist()], "i8")
    else:
        m = 25 + 75 * n * documents // terms
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def searched(rows: DataFrame, items: Items, kth: np.ndarray, documents: int, terms: int, p: Ranking) -> DataFrame:
    """Each task's best documents of every item."""
    size = max(p.leaf, min(p.chunk, p.node_bytes // (8 * max(1, len(items.places))) * p.leaf // 2))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(items, kth.copy(), p)
        for batch in batches:
            for k in range(0, batch.num_rows, size):
                part = batch.slice(k, size)
                ids = part.column("doc_id").fill_null(NULL).to_numpy()
                lists, tfs = part.column("terms"), part.column("tfs").flatten().to_numpy().astype("i8")
                row = np.repeat(np.arange(len(ids)), np.diff(np.asarray(lists.offsets)))
                search.chunk(ids, row, lists.flatten().to_numpy().astype("i8"), impacts(tfs, part.column("n").to_numpy()[row], documents, terms))
        yield search.found()

    return rows.mapInArrow(run, "item long, item_id long, doc_id long, score long")


def first_k(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def ranked(items: DataFrame, docs: DataFrame, p: Ranking = Ranking()) -> DataFrame:
    """item_id, rank, doc_id and score of the best documents (doc_id, text) of each item (item_id, text)."""
    out = docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    asked = items.select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    n, size = asked.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(-(-n // p.block_items), -(-size // p.block_bytes))
    for block in range(blocks):
        rows = asked.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()  # a block is bounded
        own = Items(sorted(((r.item_id, r.text) for r in rows), key=lambda r: (r[0] is not None, r[0], r[1] or "")))
        if not own.ids:
            continue
        counted = keep(vectors(docs, own.places), "lexical-vectors")
        documents, terms = counted.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        held = counted.filter(F.size("terms") > 0)
        own.weighted(documents, {r.term: r.df for r in held.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).collect()})  # at most the block's terms
        early = F.pmod(F.xxhash64("doc_id", "n"), F.lit(p.first_wave)) == 0
        kth = np.ones(len(own.ids), "i8")  # only scores above 0 count
        best = keep(first_k(searched(held.filter(early), own, kth, documents, terms, p), p.k), "lexical-early")
        for r in best.filter(F.col("rank") == p.k).select("item", "score").collect():  # at most the block's items
            kth[r["item"]] = max(kth[r["item"]], r["score"])
        rest = searched(held.filter(~early), own, kth, documents, terms, p)
        out = out.unionByName(first_k(best.drop("rank").unionByName(rest), p.k).select("item_id", "rank", "doc_id", "score"))
    return out


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best of all ``documents`` for each item of ``benchmark``."""
    return ranked(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"))


QUERIES = {"op12_lexical_search": op12_lexical_search}

_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLES = {
    "op12_lexical_search": f"""
WITH i AS (SELECT row_number() OVER () AS item, * FROM (SELECT DISTINCT item_id, text FROM benchmark)),
it AS (SELECT item, item_id, t, count(*) AS q FROM (SELECT item, item_id, unnest({_TERMS}) AS t FROM i) GROUP BY ALL),
d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS ts FROM documents),
dn AS (SELECT r, doc_id, len(ts) AS n FROM d WHERE len(ts) > 0),
g AS (SELECT count(*)::BIGINT AS big_n, sum(n)::BIGINT AS l FROM dn),
tf AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(ts) AS t FROM d) WHERE t IN (SELECT t FROM it) GROUP BY ALL),
w AS (SELECT t, floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, g GROUP BY t, big_n),
s AS (SELECT item, item_id, r, doc_id, sum(q * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * big_n) // l))))::BIGINT AS score FROM tf JOIN w USING (t) JOIN it USING (t) JOIN dn USING (r), g GROUP BY ALL)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS FIRST) AS rank FROM s WHERE score > 0) WHERE rank <= 10"""
}
