"""N-gram Jaccard join in a metric space: every link between documents' shingle sets, exactly.

Documents with equal sets form a class; classes stand for their documents. A class's prefix is its rarest shingles, as
many as any linked class must share ``overlap`` of: sets that link at threshold t differ in so few elements that
their prefixes of n - ceil(t n) + overlap elements share at least ``overlap``. Rare first means: a bounded list of the
corpus's most frequent shingles comes last, the rest in order of their hashes. Each prefix shingle is a block.

A block's least class is its first pivot. Links to pivots make components; only blocks with several components are
joined further. Small ones are joined in full. Linked classes that only meet in larger ones share ``overlap`` of these,
two at least, so pairs of a class's larger blocks are its new blocks, of which the small ones are joined in full again.
What is still large is real nearness, not a common phrase in texts that are otherwise unlike: such blocks form families,
and pivots divide a family's metric space (Jaccard distance is a metric) into Voronoi regions, these into cells of
bounded size; triangle-inequality windows bring to each cell the boundary classes from elsewhere that could link into
it. No pair within the threshold is lost, and pairs inside a component are never built.

Null and empty texts have no shingle and link with nothing; each is its own component. Repeated rows, and ties, belong
to one class. A text of any length has one set of all its shingles. Sets and classes are held by 64-bit hashes, equal
hashes counting as equal. A null doc_id never names a component unless all in it are null. An empty table gives an
empty result; other columns of the input don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from captionforge.llm.byte_bpe import sliced
from captionforge.llm.common import keep, small_batches, table, text_key
from captionforge.llm.components import components
from captionforge.llm.shingles import shingle_sets


@dataclass(frozen=True)
class Join:
    words: int = 5
    percent: int = 80  # link if 100 * intersection >= percent * union
    frequent: int = 1 << 17  # shingles in the list of those that come last (1.2 MB)
    local: int = 4  # documents of one task's run that hold a shingle, for it to be counted
    small_block: int = 32
    new_block: int = 8  # the same for pairs of large blocks; near copies share many of those, so less is joined in full
    pivots: int = 8
    wide: int = 64  # large blocks of a class of which all pairs are new blocks; with more, each stands alone
    cell: int = 4096  # classes of a region that are joined together
    part: int = 16384  # and with so many others
    cell_shingles: int = 1 << 19  # that the cell's classes hold
    part_shingles: int = 1 << 20  # and the others

    @property
    def distance(self) -> float:
        return 1 - self.percent / 100


RUN = 4_000_000  # shingles of a task that are counted together


def class_id(tokens: np.ndarray) -> int:
    return int.from_bytes(blake2b(tokens.tobytes(), digest_size=8).digest(), "little", signed=True)


def profiles(docs: DataFrame, p: Join) -> DataFrame:
    """Two kinds of rows: (0) doc_id, key, cid and n of a document; (1) a shingle h held by n documents of a run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size, seen = 0, set()

        def frequent() -> pa.RecordBatch:
            tokens, n = np.unique(np.concatenate(held), return_counts=True)
            tokens, n = tokens[n >= p.local], n[n >= p.local]
            nothing = pa.nulls(len(n), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(np.ones(len(n), "i4")), nothing, nothing, pa.array(tokens.view("i8")), pa.array(n)], names=["kind", "doc_id", "key", "cid", "n"])

        for whole in batches:
            for batch in sliced(whole, "text"):
                sets = shingle_sets(batch.column("text").to_pylist(), p.words)
                ids = [class_id(x) if len(x) else None for x in sets]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.zeros(len(sets), "i4")), batch.column("doc_id"), batch.column("key"), pa.array(ids, pa.int64()), pa.array([len(x) for x in sets], pa.int64())],
                    names=["kind", "doc_id", "key", "cid", "n"],
                )
                for i, x in zip(ids, sets, strict=True):
                    if i not in seen and len(x):
                        seen.add(i)
                        held.append(x)
                        size += len(x)
                if size > RUN:
                    yield frequent()
                    size, held, seen = 0, [], set()
        if held:
            yield frequent()

    return docs.mapInArrow(run, "kind int, doc_id long, key long, cid long, n long")


def must_share(n, p: Join):
    """Shingles that a set of n shares with any that it links with, and so their least size (int or Column)."""
    return -(-p.percent * n // 100) if not isinstance(n, Column) else F.floor((n * p.percent + 99) / 100)


def needed_overlap(n, p: Join):
    """Prefix shingles that two linked sets must share; n: size of the smaller (int or Column)."""
    if isinstance(n, Column):
        return F.least(must_share(n, p), F.greatest(F.lit(2), F.floor(n / 32) + 1))
    return min(must_share(n, p), max(2, n // 32 + 1))


def prefixes(docs: DataFrame, frequent: np.ndarray, weights: np.ndarray, p: Join) -> DataFrame:
    """block (a prefix shingle), cid and n of each class, once or more for each task that meets the class."""
    shared = docs.sparkSession.sparkContext.broadcast((frequent, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, weight = shared.value
        seen: set[int] = set()
        for whole in batches:
            for batch in sliced(whole, "text"):
                blocks, ids, sizes, counts = [], [], [], []
                for x in shingle_sets(batch.column("text").to_pylist(), p.words):
                    if not len(x) or (c := class_id(x)) in seen:
                        continue
                    if len(seen) < 1_000_000:
                        seen.add(c)
                    n = len(x)
                    length = n - must_share(n, p) + needed_overlap(n, p)
                    if len(common):
                        at = np.minimum(np.searchsorted(common, x), len(common) - 1)
                        w = np.where(common[at] == x, weight[at], 0)
                        x = x[np.lexsort((x, w))]
                    blocks.append(x[:length])
                    ids.append(c)
                    sizes.append(n)
                    counts.append(length)
                made = np.concatenate(blocks).view("i8") if blocks else np.zeros(0, "i8")
                yield pa.RecordBatch.from_arrays([pa.array(made), pa.array(np.repeat(np.array(ids, "i8"), counts)), pa.array(np.repeat(np.array(sizes, "i4"), counts))], names=["block", "cid", "n"])

    return docs.select("text").mapInArrow(run, "block long, cid long, n int")


def packed_texts(docs: DataFrame) -> DataFrame:
    """doc_id, key and the compressed text, which is smaller to shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for whole in batches:
            for batch in sliced(whole, "text"):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array([press.compress((t or "").encode()) for t in batch.column("text").to_pylist()], pa.binary())], names=["doc_id", "key", "packed"])

    return docs.mapInArrow(run, "doc_id long, key long, packed binary")


def compared(pairs: DataFrame, texts: DataFrame, p: Join) -> DataFrame:
    """a, b, both (size of the intersection) and either (of the union) of each pair of classes."""
    both = pairs.join(texts.select(F.col("cid").alias("a"), F.col("packed").alias("x")), "a").join(texts.select(F.col("cid").alias("b"), F.col("packed").alias("y")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = zstandard.ZstdDecompressor()
        known: dict[int, np.ndarray] = {}

        def of(ids: list[int], packed: pa.Array) -> list[np.ndarray]:
            new = {i: k for k, i in enumerate(ids) if i not in known}
            made = shingle_sets([open_.decompress(packed[k].as_py()).decode() for k in new.values()], p.words)
            known.update(zip(new, made, strict=True))
            return [known[i] for i in ids]

        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                if sum(map(len, known.values())) > RUN:
                    known.clear()
                left, right = (of(batch.column(i).to_pylist(), batch.column(x)) for i, x in (("a", "x"), ("b", "y")))
                common = np.array([len(np.intersect1d(u, v, assume_unique=True)) for u, v in zip(left, right, strict=True)], "i8")
                total = np.array([len(u) + len(v) for u, v in zip(left, right, strict=True)], "i8") - common
                yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(common), pa.array(total)], names=["a", "b", "both", "either"])

    return both.mapInArrow(run, "a long, b long, both long, either long")


def pairs_in(blocks: DataFrame, p: Join) -> DataFrame:
    """a, b and n (of the smaller) of classes in one block, of two components and of sizes that permit a link."""
    side = lambda x: blocks.select("block", F.col("cid").alias(x), F.col("n").alias(f"n{x}"), F.col("comp").alias(f"c{x}"))
    n = F.least("na", "nb")
    return side("a").join(side("b"), "block").filter("a < b and ca <> cb").filter(n * 100 >= F.greatest("na", "nb") * p.percent).select("a", "b", n.alias("n"))


def large_blocks(large: DataFrame, p: Join) -> DataFrame:
    """size (large blocks of a class), and of these, rarest first, the ``first``.

    Classes that share ``least`` of their large blocks share two of the first, and one of the first without the last;
    with ``least`` 1, ``first`` is all of them. With fewer than ``least`` there is none.
    """
    each = large.groupBy("cid", "n", "comp").agg(F.array_sort(F.collect_list(F.struct("m", "block"))).alias("at")).withColumn("size", F.size("at"))  # of a prefix at most
    least = needed_overlap(must_share(F.col("n"), p), p).cast("int")
    some = F.when(F.col("size") >= least, F.slice("at", F.lit(1), F.col("size") - least + 2)).otherwise(F.slice("at", F.lit(1), F.lit(0)))
    return each.select("cid", "n", "comp", "size", least.alias("least"), F.transform(some, lambda x: x["block"]).alias("first"), (F.size(some) > p.wide).alias("wide"))


def new_blocks(common: DataFrame) -> DataFrame:
    """block, cid, n, comp, pivot (the block's least class) and m (its classes) of new blocks with several components.

    A block is a pair of a class's first large blocks. Where a class has too many for that, and where one shared block
    is all that a link needs, it is a large block itself.
    """
    row = ["cid", "n", "comp"]
    narrow = common.filter(~F.col("wide"))
    rest = lambda x, i: F.transform(F.slice("first", i + 2, F.size("first")), lambda y: F.xxhash64(x, y))
    made = narrow.select(*row, F.explode(F.flatten(F.transform("first", rest))).alias("block"))
    alone = F.when(F.col("least") > 1, F.slice("first", F.lit(1), F.greatest(F.size("first") - 1, F.lit(0)))).otherwise(F.col("first"))
    each = common.select(*row, "least", "wide", F.explode(alone).alias("at"))
    broad = each.join(each.filter("wide").select("at").distinct(), "at", "left_semi").select(*row, F.xxhash64("at", F.lit("wide")).alias("block"))
    single = each.filter("least = 1").select(*row, F.xxhash64("at", F.lit("single")).alias("block"))
    whole = Window.partitionBy("block")
    found = made.unionByName(broad).unionByName(single).select("block", *row, F.min("comp").over(whole).alias("lo"), F.max("comp").over(whole).alias("hi"), F.min("cid").over(whole).alias("pivot"), F.count("*").over(whole).alias("m"))
    return found.filter("lo < hi").drop("lo", "hi")


def link_classes(members: DataFrame, texts: DataFrame, p: Join) -> DataFrame:
    """cid and comp of every class that links with another, from blocks (block, cid, n)."""
    close = F.col("both") * 100 >= F.col("either") * p.percent
    ends = members.groupBy("block").agg(F.min("cid").alias("pivot"), F.max("cid").alias("last")).filter("pivot < last").select("block", "pivot")
    open_ = keep(members.join(ends, "block"), "jaccard-blocks")
    votes = open_.filter("cid <> pivot").groupBy("cid", "n", "pivot").agg(F.count("*").alias("votes")).filter(F.col("votes") >= needed_overlap(F.col("n"), p))
    stars = votes.groupBy("cid").agg(F.max(F.struct("votes", "pivot")).alias("best")).select(F.col("best.pivot").alias("a"), F.col("cid").alias("b"))
    links = keep(compared(stars, texts, p).filter(close).select("a", "b"), "jaccard-links")
    comps = components(links, "jaccard")
    labelled = open_.select("block", "cid", "n").join(comps.withColumnRenamed("node", "cid"), "cid", "left").select("block", "cid", "n", F.coalesce("comp", "cid").alias("comp"))
    mixed = labelled.groupBy("block").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("m")).filter("lo < hi").select("block", "m")
    open_ = keep(labelled.join(mixed, "block"), "jaccard-open")
    small, large = open_.filter(F.col("m") <= p.small_block), open_.filter(F.col("m") > p.small_block)
    common = keep(large_blocks(large, p), "jaccard-large")
    again = keep(new_blocks(common), "jaccard-again")
    few, many = again.filter(F.col("m") <= p.new_block), again.filter(F.col("m") > p.new_block)
    votes = pairs_in(small, p).groupBy("a", "b", "n").agg(F.count("*").alias("votes"))
    size = lambda x: common.select(F.col("cid").alias(x), F.col("size").alias(f"s{x}"))
    more = F.least(F.coalesce("sa", F.lit(0)), F.coalesce("sb", F.lit(0)))  # a pair may share so many large blocks besides
    pairs = votes.join(size("a"), "a", "left").join(size("b"), "b", "left").filter(F.col("votes") + more >= needed_overlap(F.col("n"), p))
    pairs = pairs.select("a", "b").unionByName(pairs_in(few, p).select("a", "b")).distinct()
    found = compared(pairs, texts, p).filter(close).select("a", "b").unionByName(in_regions(many, texts, p))
    links = keep(links.unionByName(found), "jaccard-links")
    return components(links, "jaccard").withColumnRenamed("node", "cid")


def in_regions(large: DataFrame, texts: DataFrame, p: Join) -> DataFrame:
    """Links (a, b) between components in large blocks, enough of them to join all that any link joins.

    Blocks that share classes form a family. A family's classes have their distances from its pivots. Those outside
    its largest component are dealt to the Voronoi regions of their nearest pivots, in cells of a bounded number. By
    the triangle inequality a class can only link into a cell if it is, for every pivot, within the threshold distance
    of the cell's own range of distances: to those cells it goes, in bounded parts. Every cell and part is one join.
    """
    by_family = components(large.select(F.col("pivot").alias("a"), F.col("cid").alias("b")).distinct(), "jaccard-families")
    members = large.select("cid", "n", "comp").distinct().join(by_family.select(F.col("node").alias("cid"), F.col("comp").alias("family")), "cid")
    members = keep(members, "jaccard-family")
    sizes = members.groupBy("family", "comp").agg(F.count("*").alias("m"))
    major = sizes.groupBy("family").agg(F.max(F.struct("m", "comp")).alias("major")).select("family", F.col("major.comp").alias("major"))
    rank = F.row_number().over(Window.partitionBy("family").orderBy("cid"))
    pivots = keep(members.select("family", "cid").withColumn("k", rank).filter(F.col("k") <= p.pivots).select("family", F.col("cid").alias("pivot"), "k"), "jaccard-pivots")
    met = members.join(pivots, "family").filter("cid <> pivot").select(F.least("cid", "pivot").alias("a"), F.greatest("cid", "pivot").alias("b")).distinct()
    known = compared(met, texts, p).select("a", "b", (1 - F.col("both") / F.col("either")).alias("d"))
    known = keep(known.unionByName(pivots.select(F.col("pivot").alias("a"), F.col("pivot").alias("b"), F.lit(0.0).alias("d"))), "jaccard-distances")
    away = members.join(pivots, "family").withColumns({"a": F.least("cid", "pivot"), "b": F.greatest("cid", "pivot")}).join(known, ["a", "b"])
    away = away.groupBy("family", "cid", "n", "comp").agg(F.array_sort(F.collect_list(F.struct("k", "d"))).alias("at"))  # of at most ``pivots``
    away = keep(away.withColumn("at", F.transform("at", lambda x: x["d"])), "jaccard-away")

    home = F.array_position("at", F.array_min("at"))
    others = away.join(major, "family").filter("comp <> major").withColumn("home", home)
    share = lambda rows, shingles: F.greatest(F.lit(1 / rows), F.col("n") / shingles)  # noqa: E731  what a class takes of a cell or part
    order = Window.partitionBy("family", "home").orderBy("cid").rowsBetween(Window.unboundedPreceding, -1)
    others = keep(others.withColumn("cell", F.floor(F.coalesce(F.sum(share(p.cell, p.cell_shingles)).over(order), F.lit(0.0)) + 1e-9)).select("family", "home", "cell", "cid", "comp", "at"), "jaccard-cells")
    each = others.select("family", "home", "cell", F.posexplode("at").alias("k", "d")).groupBy("family", "home", "cell", "k").agg(F.min("d").alias("lo"), F.max("d").alias("hi"))
    boxes = each.groupBy("family", "home", "cell").agg(F.array_sort(F.collect_list(F.struct("k", "lo", "hi"))).alias("box"))
    part = F.pmod(F.xxhash64("cid"), F.greatest(F.ceil(F.col("size")), F.lit(1)))
    sized = away.join(members.groupBy("family").agg(F.sum(share(p.part, p.part_shingles)).alias("size")), "family").withColumn("part", part)
    fits = F.forall(F.arrays_zip("at", "box"), lambda x: (x["at"] >= x["box"]["lo"] - p.distance - 1e-9) & (x["at"] <= x["box"]["hi"] + p.distance + 1e-9))
    asked = keep(sized.join(boxes, "family").filter(fits).select("family", "home", "cell", "part", "cid", "comp"), "jaccard-asked")
    parts = asked.select("family", "home", "cell", "part").distinct()
    rows = asked.withColumn("own", F.lit(False)).unionByName(others.join(parts, ["family", "home", "cell"]).select("family", "home", "cell", "part", "cid", "comp").withColumn("own", F.lit(True)))
    rows = rows.join(texts, "cid")

    def join(table: pa.Table) -> pa.Table:
        press = zstandard.ZstdDecompressor()
        groups: dict[int, int] = {}

        def group(x: int) -> int:
            while (y := groups.get(x, x)) != x:
                x = y
            return x

        out: list[tuple[int, int]] = []
        own = table.filter(table["own"])
        ids, comps = own["cid"].to_pylist(), own["comp"].to_pylist()
        sets = shingle_sets([press.decompress(x).decode() for x in own["packed"].to_pylist()], p.words)
        size = np.array([len(x) for x in sets], "i8")
        tokens, owner = np.concatenate([*sets, np.zeros(0, "u8")]), np.repeat(np.arange(len(sets)), size)
        order = np.argsort(tokens, kind="stable")
        tokens, owner = tokens[order], owner[order]
        others = table.filter(pc.invert(table["own"]))
        for start in range(0, others.num_rows, 200):
            some = others.slice(start, 200)
            asked = shingle_sets([press.decompress(x).decode() for x in some["packed"].to_pylist()], p.words)
            for cid, comp, x in zip(some["cid"].to_pylist(), some["comp"].to_pylist(), asked, strict=True):
                lo, hi = np.searchsorted(tokens, x), np.searchsorted(tokens, x, "right")
                n = hi - lo
                hits = owner[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())]
                both = np.bincount(hits, minlength=len(sets))
                for k in np.flatnonzero((both > 0) & (both * 100 >= (size + len(x) - both) * p.percent)).tolist():
                    a, b = group(comp), group(comps[k])
                    if a != b:
                        groups[a] = b
                        out.append((cid, ids[k]))
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    return rows.groupBy("family", "home", "cell", "part").applyInArrow(join, "a long, b long")


def labels_of(docs: DataFrame, p: Join = Join()) -> DataFrame:
    """doc_id, key (of the text), n (shingles) and label (of the text's component; null without shingles) of each row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("key", text_key(F.col("text")))
    small_batches(docs)
    found = keep(profiles(rows, p), "jaccard-profiles")
    own = found.filter("kind = 0").select("doc_id", "key", "cid", "n")
    top = found.filter("kind = 1").groupBy("cid").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "cid").limit(p.frequent).toPandas()  # bounded
    tokens = top["cid"].to_numpy("i8").view("u8")
    order = np.argsort(tokens)
    weights = (np.log2(np.maximum(top["n"].to_numpy("f8"), 1)) + 1).astype("u1")
    members = keep(prefixes(rows, tokens[order], weights[order], p), "jaccard-members")
    block = Window.partitionBy("block")
    ends = members.select("block", "cid", "n", F.min("cid").over(block).alias("lo"), F.max("cid").over(block).alias("hi"))
    shared = keep(ends.filter("lo < hi").select("block", "cid", "n").distinct(), "jaccard-shared")  # rows are dealt once
    live = shared.groupBy("cid", "n").agg(F.count("*").alias("c")).filter(F.col("c") >= needed_overlap(F.col("n"), p)).select("cid")
    live = keep(live, "jaccard-live")
    members = shared.join(live, "cid", "left_semi")
    place = own.join(live, "cid", "left_semi").groupBy("cid").agg(F.min(F.struct("doc_id", "key")).alias("at")).select("cid", F.col("at.doc_id").alias("d"), F.col("at.key").alias("k"))
    place = keep(place, "jaccard-places")
    place = F.broadcast(place) if place.count() * 24 <= 32 << 20 else place  # checked: else all texts are shuffled
    packed = packed_texts(rows.select("doc_id", "key", "text"))
    texts = packed.join(place, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("k"))).select("cid", "packed").dropDuplicates(["cid"])
    comps = link_classes(members, keep(texts, "jaccard-texts"), p)
    return own.join(comps, "cid", "left").select("doc_id", "key", "n", F.coalesce("comp", "cid").alias("label"))


def components_of(docs: DataFrame, p: Join = Join()) -> DataFrame:
    """doc_id, key (of the text), n_shingles and component_id of each row; components by the links of the join."""
    labelled = labels_of(docs, p)
    least = labelled.filter("label is not null").groupBy("label").agg(F.min("doc_id").alias("least"))
    return labelled.join(least, "label", "left").select("doc_id", "key", F.col("n").alias("n_shingles"), F.when(F.col("label").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"))


def keep_one(docs: DataFrame, p: Join = Join()) -> DataFrame:
    """``docs`` with one row of each component of texts: the least by doc_id (null last) and text key.

    Texts that don't link stay, also under one doc_id. Rows equal in doc_id and text are repeats, of which one stays;
    only rows with neither a doc_id nor a shingle all stay, as nothing tells what they repeat.
    """
    each = keep(labels_of(docs, p), "jaccard-labels")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    first = each.filter("label is not null").groupBy("label").agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1").select("label", "first")
    out = each.join(first, "label").filter(~place.eqNullSafe(F.col("first"))).select(F.col("doc_id").alias("__j_d"), F.col("key").alias("__j_k")).distinct()
    out = keep(out, "jaccard-out")
    out = F.broadcast(out) if out.count() * 24 <= 32 << 20 else out  # checked: else the join shuffles
    rows = docs.withColumn("__j_key", text_key(F.coalesce("text", F.lit(""))))
    same = F.col("doc_id").eqNullSafe(F.col("__j_d")) & (F.col("__j_key") == F.col("__j_k"))
    rows = rows.join(out, same, "left_anti")
    again = each.filter("doc_id is not null or label is not null").groupBy(F.col("doc_id").alias("__j_d"), F.col("key").alias("__j_k")).agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    again = keep(again, "jaccard-again")
    if again.isEmpty():
        return rows.select(*docs.columns)
    first = F.row_number().over(Window.partitionBy("doc_id", "__j_key").orderBy("text"))
    once = rows.join(again, same, "left_semi").withColumn("__j_n", first).filter("__j_n = 1")
    return rows.join(again, same, "left_anti").select(*docs.columns).unionByName(once.select(*docs.columns))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each row of ``documents``."""
    return components_of(table(spark, sf_dir, "documents"), Join(words=4, percent=85)).select("doc_id", "n_shingles", "component_id")


QUERIES = {"op10_jaccard_join": op10_jaccard_join}
