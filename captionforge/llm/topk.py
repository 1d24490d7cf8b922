"""Exact top-k search by inner product over norm-sorted vectors.

A vector's components become whole numbers, floor(scale * x). Candidates are dealt by range of their length, longest
first, and packed into blocks; queries are packed likewise, in groups whose bytes are bounded, so that a group may be
broadcast. Ranges of candidates are searched in waves, each with four times as many as the last: the weakest kth score
of a wave's results bounds the next. A pair of blocks whose longest vectors can't reach that score is not formed.

Inside a pair, candidates come by descending length, and a query stops at the first that Cauchy-Schwarz rules out. For
the others both sides are rotated to the axes of an SVD, most of the length first: the product of the first
coordinates plus the product of what remains of both lengths bounds the score from above. More coordinates are taken
until the bound fails or the score itself is computed, in whole numbers. A bound prunes only if it is less than the
kth score by more than rounding can explain, so that the result is exact whatever the axes are; they are fitted on
``fit_rows`` rows at most, picked by hash.

Rows without an id, and vectors that are null or hold null or non-finite components, take no part. A query's own id is no
candidate for it. Vectors meet only those of their own number of components. Repeated rows are candidates as often as
they occur; a repeated query counts once, and an id with several vectors has a list for each. Equal scores are ranked
by id. An empty table gives an empty result. Scores beyond 64 bits are an error. Only the two columns named are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from captionforge.llm.common import keep, table


@dataclass(frozen=True)
class Search:
    k: int = 5
    scale: int = 256
    block: int = 4096  # candidates in a row
    queries: int = 1024  # in a row
    step: int = 512  # candidates between two looks at the kth scores
    stages: tuple[int, ...] = (8, 24, 40, 52)  # coordinates of the partial sums
    fit_rows: int = 4096
    group_bytes: int = 16 << 20  # of the queries that meet all candidates at a time


GROWTH = 4  # of the waves
FOUND = "qno long, query_id long, vec_id long, score long"


def vectors(rows: DataFrame, id_: str, vector: str, scale: int = Search.scale) -> DataFrame:
    """id, v (whole numbers), dim and norm of every row that takes part."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * scale))
    out = rows.filter(F.col(id_).isNotNull() & F.col(vector).isNotNull() & finite).select(F.col(id_).cast("long").alias("id"), whole.alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return out.select("id", "v", F.size("v").alias("dim"), norm.alias("norm"))


def axes(candidates: DataFrame, p: Search) -> dict[int, np.ndarray]:
    """By number of components, the rotation to the axes of a bounded sample's SVD."""
    rows = candidates.orderBy(F.xxhash64("id", "v")).limit(p.fit_rows).select("v").toPandas()["v"]  # bounded
    out = {}
    for dim in {len(v) for v in rows} - {0}:
        x = np.array([v for v in rows if len(v) == dim], "f8")
        out[dim] = np.linalg.svd(x.T @ x)[0]  # the right singular vectors of x
    return out


def packed(rows: DataFrame, size: int) -> DataFrame:
    """Rows (dim, norm, id, v and further longs) packed by ``size``, longest first: part, dim, top, the bytes of each column and the least ``kth``."""
    longs = [c for c in rows.columns if c not in ("dim", "norm", "v")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = TaskContext.get().partitionId(), []

        def block(t: pa.Table, dim: int) -> pa.RecordBatch:
            flat = t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype("<i8")
            narrow = flat.astype("<i4") if len(flat) and np.abs(flat).max() < 1 << 31 and flat.min() > -(1 << 31) else flat
            weakest = min(t.column("kth").to_pylist()) if "kth" in longs else None
            cells = [part, dim, float(t.column("norm")[0].as_py()), narrow.tobytes(), narrow.itemsize, weakest, *(t.column(c).to_numpy().astype("<i8").tobytes() for c in longs)]
            kinds = [pa.int32(), pa.int32(), pa.float64(), pa.binary(), pa.int32(), pa.int64(), *[pa.binary()] * len(longs)]
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(cells, kinds, strict=True)], names=["part", "dim", "top", "values", "width", "weakest", *longs])

        def full(least: int) -> Iterator[pa.RecordBatch]:
            nonlocal held
            whole = pa.Table.from_batches(held)
            dims = whole.column("dim").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(dims)) + 1).tolist(), len(dims)]  # sorted by dim, then length
            held = []
            for a, b in zip(edges, edges[1:], strict=False):
                stop = b if b < len(dims) or least == 1 else a + (b - a) // size * size
                for k in range(a, stop, size):
                    yield block(whole.slice(k, min(size, stop - k)), int(dims[a]))
                if stop < b:
                    held = whole.slice(stop, b - stop).combine_chunks().to_batches()

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(x.num_rows for x in held) >= size:
                yield from full(size)
        if held:
            yield from full(1)

    schema = "part int, dim int, top double, values binary, width int, weakest long" + "".join(f", {c} binary" for c in longs)
    return rows.repartitionByRange(F.desc("norm")).sortWithinPartitions("dim", F.desc("norm")).mapInArrow(run, schema)


def unpacked(row: dict, side: str) -> np.ndarray:
    flat = np.frombuffer(row[f"{side}_values"], f"<i{row[f'{side}_width']}")
    return flat.astype("i8").reshape(-1, row["dim"]) if row["dim"] else np.zeros((len(row[f"{side}_id"]) // 8, 0), "i8")


def under(scores: np.ndarray) -> np.ndarray:
    """As doubles that aren't above the whole numbers."""
    return scores.astype("f8") - (np.abs(scores) >> 52)


class Rotated:
    """Vectors with their rotated coordinates and the lengths that remain after the first of them."""

    def __init__(self, v: np.ndarray, turn: np.ndarray, stages: tuple[int, ...]) -> None:
        self.v, self.f = v, v.astype("f8")
        self.norm = np.sqrt((self.f * self.f).sum(axis=1))
        self.r = self.f @ turn
        total = np.cumsum(self.r * self.r, axis=1)
        left = lambda h: np.sqrt(np.maximum(self.norm**2 - total[:, h - 1], 0))
        self.left = {h: left(h) for h in stages}


class Best:
    """The k best candidates so far of each query of a block."""

    def __init__(self, row: dict, turn: np.ndarray, p: Search) -> None:
        self.p = p
        self.q_id, self.qno = np.frombuffer(row["q_id"], "<i8"), np.frombuffer(row["qno"], "<i8")
        self.stages = tuple(h for h in p.stages if h < row["dim"])
        self.q = Rotated(unpacked(row, "q"), turn, self.stages)
        known = np.frombuffer(row["kth"], "<i8")
        self.kth = np.where(known == np.iinfo("i8").min, -np.inf, under(known))
        self.i, self.c, self.s = np.zeros(0, "i8"), np.zeros(0, "i8"), np.zeros(0, "i8")
        self.compared = self.scored = 0

    def meet(self, ids: np.ndarray, c: Rotated) -> None:
        """Candidates by descending length."""
        p, q = self.p, self.q
        most = q.norm.max(initial=0) * c.norm.max(initial=0) * (1 + 1e-9)  # of any sum of their products
        if most >= 1 << 63:
            raise OverflowError("scores beyond 64 bits")
        slack = 0.5 + 1e-9 * q.norm * (c.norm.max(initial=0) + 1)
        for a in range(0, len(ids), p.step):
            part = slice(a, min(a + p.step, len(ids)))
            alive = np.flatnonzero(q.norm * c.norm[part].max() + slack >= self.kth)
            if not len(alive):
                return
            bar = (self.kth - slack)[alive]
            hit = self.q_id[alive][:, None] != ids[part][None, :]
            self.compared += hit.size
            done, partial = 0, np.zeros(hit.shape)
            for h in self.stages:
                own = slice(done, h)
                if hit.mean() > 0.1:
                    partial += q.r[alive, own] @ c.r[part, own].T
                    hit &= partial + q.left[h][alive][:, None] * c.left[h][part][None, :] >= bar[:, None]
                else:
                    i, j = np.nonzero(hit)
                    partial[i, j] += np.einsum("ij,ij->i", q.r[alive[i], own], c.r[a + j, own])
                    hit[i, j] = partial[i, j] + q.left[h][alive[i]] * c.left[h][a + j] >= bar[i]
                done = h
            i, j = np.nonzero(hit)
            self.scored += len(i)
            exact = most < 1 << 53  # then doubles hold every sum
            if len(i) > 0.1 * hit.size:
                scores = (q.f[alive] @ c.f[part].T).astype("i8")[i, j] if exact else (q.v[alive] @ c.v[part].T)[i, j]
            else:
                scores = np.einsum("ij,ij->i", q.v[alive[i]], c.v[a + j])
            on = scores >= self.kth[alive[i]]
            self.add(alive[i[on]], ids[a + j[on]], scores[on])

    def add(self, i: np.ndarray, c: np.ndarray, s: np.ndarray) -> None:
        i, c, s = np.append(self.i, i), np.append(self.c, c), np.append(self.s, s)
        order = np.lexsort((c, -s, i))
        i, c, s = i[order], c[order], s[order]
        rank = np.arange(len(i)) - np.searchsorted(i, i)
        on = rank < self.p.k
        self.i, self.c, self.s = i[on], c[on], s[on]
        last = rank == self.p.k - 1
        self.kth[i[last]] = np.maximum(self.kth[i[last]], under(s[last]))

    def found(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (self.qno[self.i], self.q_id[self.i], self.c, self.s)], names=["qno", "query_id", "vec_id", "score"])


def searched(pairs: DataFrame, turns: dict[int, np.ndarray], p: Search) -> DataFrame:
    """Each task's best candidates of the queries that it meets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[bytes, Best] = {}
        held: tuple[bytes, np.ndarray, Rotated] | None = None
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k].as_py() for c in batch.schema.names}
                turn = turns.get(row["dim"], np.eye(row["dim"]))
                if row["qno"] not in best:
                    best[row["qno"]] = Best(row, turn, p)
                if held is None or held[0] != row["c_id"]:
                    held = row["c_id"], np.frombuffer(row["c_id"], "<i8"), Rotated(unpacked(row, "c"), turn, best[row["qno"]].stages)
                best[row["qno"]].meet(*held[1:])
        for x in best.values():
            yield x.found()

    return pairs.mapInArrow(run, FOUND)


def first_k(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("qno").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def top_k(queries: DataFrame, candidates: DataFrame, p: Search = Search()) -> DataFrame:
    """query_id, rank, vec_id and score of the best candidates of each query; both sides are ``vectors``."""
    spark = candidates.sparkSession
    turns = axes(candidates, p)
    blocks = keep(packed(candidates, p.block), "topk-candidates")
    parts = (blocks.agg(F.max("part")).first()[0] or 0) + 1
    asked = queries.dropDuplicates(["id", "v"]).withColumn("qno", F.monotonically_increasing_id())
    asked = keep(asked, "topk-queries")
    size = asked.agg(F.sum(F.col("dim") * 8 + 64)).first()[0] or 0
    groups = -(-size // p.group_bytes)
    best = spark.createDataFrame([], f"{FOUND}, rank int")
    for g in range(groups):
        own = asked.filter(F.pmod(F.xxhash64("qno"), F.lit(groups)) == g)
        found = spark.createDataFrame([], f"{FOUND}, rank int")
        low, wide = 0, 1
        while low < parts:
            kth = found.filter(F.col("rank") == p.k).select("qno", F.col("score").alias("kth"))
            rows = own.join(kth, "qno", "left").select("dim", "norm", "id", "v", "qno", F.coalesce("kth", F.lit(np.iinfo("i8").min)).alias("kth"))
            asking = keep(packed(rows, p.queries), "topk-asking")  # at most group_bytes or so, as groups are dealt by hash
            side = asking.select("dim", F.col("top").alias("q_top"), F.col("values").alias("q_values"), F.col("width").alias("q_width"), F.col("id").alias("q_id"), "qno", "kth", "weakest")
            wave = blocks.filter((F.col("part") >= low) & (F.col("part") < low + wide)).select("dim", F.col("top").alias("c_top"), F.col("values").alias("c_values"), F.col("width").alias("c_width"), F.col("id").alias("c_id"))
            within = F.col("q_top") * F.col("c_top") * (1 + 1e-9) + 1 >= F.col("weakest")
            new = searched(wave.join(F.broadcast(side), "dim").filter(within), turns, p)
            found = keep(first_k(found.drop("rank").unionByName(new), p.k), "topk-found")
            low, wide = low + wide, wide * GROWTH
        best = best.unionByName(found)
    return best.select("query_id", "rank", "vec_id", "score")


def op13_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best of all other rows of ``embeddings`` for each row whose vec_id is divisible by 50."""
    rows = vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return top_k(rows.filter("id % 50 = 0"), rows)


QUERIES = {"op13_topk_search": op13_topk_search}
ORACLES = {
    "op13_topk_search": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
q AS (SELECT DISTINCT vec_id AS query_id, v AS w FROM v WHERE vec_id % 50 = 0),
s AS (SELECT query_id, w, vec_id, list_inner_product(v, w)::BIGINT AS score FROM q JOIN v ON vec_id <> query_id AND len(v) = len(w))
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id, w ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5"""
}
