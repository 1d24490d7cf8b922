"""Conversation prefix trie by vertical bitmaps.

Every distinct sequence of first d turns (role and text) is a node of depth d; the root has no turn. Conversations go
through the trie as hashes: an item is a turn at its place, 128 bits, and a node's key is the exclusive or of the items
on its path. Rows of at most ``TURNS`` turns are dealt by range of their first items, then by conversation, so that
conversations which begin alike meet in one shard and a hot beginning fills many shards. A shard of at most ``SHARD``
rows holds an index from (position, turn) to the bitset of its rows. The trie is walked depth first: a node's bitset
meets the posting of its first row's next turn, which gives a child; what is left gives the next one. Popcounts, least
members and the ids of conversations that end at a node are added up over shards by the node's key.

Sums over subtrees take a second walk. A conversation that is a node's least member owns the node, and all below it on
its own path; so ``owned_from``, one depth for each conversation, tells all that it owns. A node's leaves are its
members that own a childless node; its saved tokens are, for each member, the characters of its turns from the node's
depth to just above ``owned_from``. Both are popcounts.

Null role or text counts as empty. Turns are ordered by ``turn``, null first, then by their hash; a repeated row is a
turn of its own. Rows with a null conv_id take no part. Conversations without turns (``convs``) end at the root. An
empty table has no node, not even the root. Only the named columns are read, so others don't matter. A conversation may
have any number of turns: long ones go on in further rows, from the node that the last one reached. Ids that end at one
node are hashed in order, in one task that reads them as a stream, as a running hash can't be split.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from captionforge.llm.common import keep, table, text_or_empty

TURNS = 256  # of a conversation in one row
SHARD = 4096  # rows of one index
WIDE = 1000  # children of a node whose rows are joined apart
SMALL = 32 << 20  # bytes that a broadcast side may have
HEAD = 5  # most turns that a rebuilt conversation takes from another
NODE = ["depth", "x", "y"]
NO_ENDS = hashlib.sha256(b"").hexdigest()


def hashed(turns: DataFrame) -> DataFrame:
    """conv_id, turn, a and b (the turn's hash) and chars of every turn of a conversation."""
    role, text = text_or_empty("role"), text_or_empty("text")
    lane = lambda k: F.xxhash64(F.lit(k), role, text)
    return turns.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), lane(1).alias("a"), lane(2).alias("b"), F.char_length(text).cast("long").alias("chars"))


def numbered(turns: DataFrame) -> DataFrame:
    """Adds ``pos``, from 1 in each conversation."""
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "a", "b")
    return turns.withColumn("pos", F.row_number().over(order).cast("long"))


def rows_of(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """conv_id, start, sx and sy (depth and key of the node that the row goes on from), items, bx, by and last."""
    items = numbered(turns).select("conv_id", "pos", F.xxhash64("pos", "a", "b").alias("x"), F.xxhash64("b", "pos", "a").alias("y"), "chars")
    rows = items.groupBy("conv_id", F.expr(f"(pos - 1) div {TURNS}").alias("block"))
    rows = rows.agg(F.sort_array(F.collect_list(F.struct("pos", "x", "y", "chars"))).alias("items"), F.bit_xor("x").alias("bx"), F.bit_xor("y").alias("by"))
    order = Window.partitionBy("conv_id").orderBy("block")
    before = lambda c: F.coalesce(F.bit_xor(c).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")
    rows = rows.select("conv_id", (F.col("block") * TURNS).alias("start"), before("bx").alias("sx"), before("by").alias("sy"), "items", "bx", "by", F.lead("block").over(order).isNull().alias("last"))
    none = convs.select(F.col("conv_id").cast("long").alias("conv_id")).filter("conv_id is not null").distinct().join(rows.select("conv_id"), "conv_id", "left_anti")
    zero = F.lit(0).cast("long")
    empty = F.slice(F.array(F.struct(*(zero.alias(c) for c in ("pos", "x", "y", "chars")))), 1, 0)
    none = none.select("conv_id", zero.alias("start"), zero.alias("sx"), zero.alias("sy"), empty.alias("items"), zero.alias("bx"), zero.alias("by"), F.lit(True).alias("last"))
    return rows.unionByName(none)


def dealt(rows: DataFrame) -> DataFrame:
    """Rows that begin alike side by side; of equal ones, the lesser conversations first."""
    by = [*(F.get("items", k)["x"] for k in range(3)), F.col("bx"), F.col("conv_id")]
    return rows.repartitionByRange(*by).sortWithinPartitions(*by)


class Shard:
    """Rows in the order of their conversations, and their postings as bitsets (whole numbers, a bit for each row)."""

    def __init__(self, batch: pa.RecordBatch) -> None:
        batch = batch.sort_by("conv_id")
        self.ids, self.start, self.sx, self.sy = (batch.column(c).to_pylist() for c in ("conv_id", "start", "sx", "sy"))
        lists = batch.column("items")
        self.first = np.asarray(lists.offsets).tolist()
        whole = lists.values
        self.x, self.y, self.chars = (whole.field(c).to_pylist() for c in ("x", "y", "chars"))
        self.index: dict[tuple[int, int, int], int] = defaultdict(int)
        self.stops: dict[int, int] = defaultdict(int)  # rows by the depth where they stop
        self.last = self.bits(batch.column("last").to_pylist())
        for r, at in enumerate(self.start):
            bit, a, b = 1 << r, self.first[r], self.first[r + 1]
            for i in range(a, b):
                self.index[at + i - a + 1, self.x[i], self.y[i]] |= bit
            self.stops[at + b - a] |= bit

    @staticmethod
    def bits(flags: list) -> int:
        return sum(1 << r for r, f in enumerate(flags) if f)

    @staticmethod
    def members(bits: int) -> Iterator[int]:
        while bits:
            yield (bits & -bits).bit_length() - 1
            bits &= bits - 1

    def walk(self) -> list[tuple]:
        """(place of the parent, depth, x, y, chars, bitset) of each node, parents first."""
        roots: dict[tuple[int, int, int], int] = defaultdict(int)
        for r, key in enumerate(zip(self.start, self.sx, self.sy, strict=True)):
            roots[key] |= 1 << r
        out = [(-1, *key, 0, bits) for key, bits in roots.items()]
        stack = list(range(len(out)))
        while stack:
            k = stack.pop()
            _, depth, x, y, _, bits = out[k]
            rest = bits & ~self.stops[depth]
            while rest:
                r = (rest & -rest).bit_length() - 1
                i = self.first[r] + depth - self.start[r]
                child = rest & self.index[depth + 1, self.x[i], self.y[i]]
                rest ^= child
                stack.append(len(out))
                out.append((k, depth + 1, x ^ self.x[i], y ^ self.y[i], self.chars[i], child))
        return out


def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Shard, pa.RecordBatch]]:
    for batch in batches:
        for k in range(0, batch.num_rows, SHARD):
            part = pa.RecordBatch.from_struct_array(pa.concat_arrays([batch.slice(k, SHARD).to_struct_array()]))
            yield Shard(part), part.sort_by("conv_id")


def counted(rows: DataFrame) -> DataFrame:
    """Each shard's nodes: key, the parent's key, chars, least member, popcount and the ids that end there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["depth", "x", "y", "px", "py", "chars", "conv_id", "n_convs", "ends"]
        kinds = [*[pa.int64()] * 8, pa.binary()]
        for shard, _ in shards(batches):
            out, nodes = [], shard.walk()
            for parent, depth, x, y, chars, bits in nodes:
                if parent >= 0 or depth == 0:
                    px, py = nodes[parent][2:4] if parent >= 0 else (None, None)
                    ended = bits & shard.stops[depth] & shard.last
                    ends = np.array([shard.ids[r] for r in shard.members(ended)], "<i8").tobytes() if ended else None
                    out.append((depth, x, y, px, py, chars, shard.ids[(bits & -bits).bit_length() - 1], bits.bit_count(), ends))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=names)

    return rows.mapInArrow(run, "depth long, x long, y long, px long, py long, chars long, conv_id long, n_convs long, ends binary")


def summed(rows: DataFrame) -> DataFrame:
    """Each shard's nodes with the leaves and saved characters of their subtrees; rows also hold owned_from, leaf and rest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, batch in shards(batches):
            owned, leaf, rest = (batch.column(c).to_pylist() for c in ("owned_from", "leaf", "rest"))
            leaves, nodes = shard.bits(leaf), shard.walk()
            later: dict[int, int] = {}  # by depth: rows that own nothing down to it
            by_depth: dict[int, int] = defaultdict(int)
            for r, d in enumerate(owned):
                by_depth[d] |= 1 << r
            found, above = 0, sorted(by_depth, reverse=True)
            for depth in sorted({n[1] for n in nodes}, reverse=True):
                while above and above[0] > depth:
                    found |= by_depth[above.pop(0)]
                later[depth] = found
            saved = [0] * len(nodes)
            for k in range(len(nodes) - 1, -1, -1):
                parent, depth, _, _, chars, bits = nodes[k]
                saved[k] += chars * (bits & later[depth]).bit_count() + sum(rest[r] for r in shard.members(bits & shard.stops[depth] & ~shard.last))
                if parent >= 0:
                    saved[parent] += saved[k]
            own = [k for k, n in enumerate(nodes) if n[0] >= 0 or n[1] == 0]
            columns = [[nodes[k][1] for k in own], [nodes[k][2] for k in own], [nodes[k][3] for k in own], [(nodes[k][5] & leaves).bit_count() for k in own], [saved[k] for k in own]]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["depth", "x", "y", "n_leaves", "saved_tokens"])

    return rows.mapInArrow(run, "depth long, x long, y long, n_leaves long, saved_tokens long")


def digests(parts: DataFrame) -> DataFrame:
    """ends_sha256 of each node where conversations end; ids are hashed as they come, a shard's after another's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, hashlib.sha256()
        names = [*NODE, "ends_sha256"]
        pack = lambda rows: pa.RecordBatch.from_arrays([*(pa.array([r[0][k] for r in rows], pa.int64()) for k in range(3)), pa.array([r[1] for r in rows], pa.string())], names=names)
        for batch in batches:
            done = []
            for *now, ends in zip(*(batch.column(c).to_pylist() for c in (*NODE, "ends")), strict=True):
                fresh = now != key
                if fresh:
                    if key is not None:
                        done.append((key, state.hexdigest()))
                    key, state = now, hashlib.sha256()
                state.update(("" if fresh else ",").encode() + ",".join(map(str, np.frombuffer(ends, "<i8").tolist())).encode())
            yield pack(done)
        if key is not None:
            yield pack([(key, state.hexdigest())])

    first = F.conv(F.hex(F.reverse(F.substring("ends", 1, 8))), 16, -10).cast("long")
    rows = parts.filter("ends is not null").select(*NODE, "ends", first.alias("first"))
    return rows.repartition(*NODE).sortWithinPartitions(*NODE, "first").mapInArrow(run, "depth long, x long, y long, ends_sha256 string")


def with_parents(nodes: DataFrame) -> DataFrame:
    """``nodes`` with the parent's least member; the children of wide nodes are joined apart, so that none fills a task."""
    up = lambda side: side.select((F.col("depth") + 1).alias("depth"), F.col("x").alias("px"), F.col("y").alias("py"), F.col("conv_id").alias("parent_conv_id"))
    wide = up(nodes.filter(F.col("n_children") > WIDE))
    wide = F.broadcast(wide) if wide.count() * 64 <= SMALL else wide  # checked; at most a node in WIDE
    key = ["depth", "px", "py"]
    few = nodes.join(wide, key, "left_anti").join(up(nodes.filter(F.col("n_children") <= WIDE)), key, "left")
    return few.unionByName(nodes.join(wide, key))


def trie(turns: DataFrame, convs: DataFrame | None = None) -> DataFrame:
    """One row for each node of the trie of ``turns`` (of ``hashed``): conv_id (its least member), depth, parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens (characters that sharing saves below) and ends_sha256. The node's last
    turn is turn ``depth`` of conversation ``conv_id``. ``convs``: all conversations, if some have no turn."""
    rows = keep(rows_of(turns, turns.select("conv_id") if convs is None else convs), "trie-rows")
    parts = keep(counted(dealt(rows)), "trie-parts")
    merged = parts.groupBy(*NODE).agg(F.min("px").alias("px"), F.min("py").alias("py"), F.max("chars").alias("chars"), F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"))
    merged = keep(merged, "trie-merged")
    below = merged.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("px").alias("x"), F.col("py").alias("y")).agg(F.count("*").alias("n_children"))
    nodes = keep(merged.join(below, NODE, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long")), "trie-nodes")
    owners = nodes.groupBy("conv_id").agg(F.min("depth").alias("owned_from"), F.bool_or(F.col("n_children") == 0).alias("leaf"))
    known = rows.join(owners, "conv_id", "left").withColumns({"owned_from": F.coalesce("owned_from", F.lit((1 << 62))), "leaf": F.coalesce("leaf", F.lit(False))})
    others = F.aggregate(F.filter("items", lambda t: t["pos"] < F.col("owned_from")), F.lit(0).cast("long"), lambda s, t: s + t["chars"])
    after = Window.partitionBy("conv_id").orderBy("start").rowsBetween(1, Window.unboundedFollowing)
    known = known.withColumn("others", others).withColumn("rest", F.coalesce(F.sum("others").over(after), F.lit(0)).cast("long")).drop("others")
    sums = summed(dealt(known)).groupBy(*NODE).agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    out = with_parents(nodes).join(sums, NODE).join(digests(parts), NODE, "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"))


def borrowed(conv_id: str = "conv_id") -> Column:
    """Turns that a conversation takes from the first of its hundred."""
    return F.pmod(F.crc32(F.col(conv_id).cast("string")), F.lit(HEAD + 1)).cast("int")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Hashed turns of conversations that share beginnings, and the conversations: each has the first turns of the first
    conversation of its hundred, then its own after as many."""
    own = keep(numbered(turns), "trie-own")
    heads = own.filter((F.col("conv_id") % 100 == 0) & (F.col("pos") <= HEAD)).groupBy(F.col("conv_id").alias("base")).agg(F.sort_array(F.collect_list(F.struct("pos", "a", "b", "chars"))).alias("head"))
    convs = own.select("conv_id").distinct()
    taken = convs.withColumn("base", F.col("conv_id") - F.col("conv_id") % 100).join(heads, "base").select("conv_id", F.explode(F.slice("head", F.lit(1), borrowed())).alias("t"))
    taken = taken.select("conv_id", (F.col("t.pos") - HEAD - 1).alias("turn"), "t.a", "t.b", "t.chars")
    return taken.unionByName(own.filter(F.col("pos") > borrowed()).select("conv_id", F.col("pos").alias("turn"), "a", "b", "chars")), convs


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each node of the trie of rebuilt ``conversations``."""
    return trie(*rebuilt(hashed(table(spark, sf_dir, "conversations"))))


QUERIES = {"op11_prefix_trie": op11_prefix_trie}

_CRC = "xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(c, ''), lambda d: ascii(d)::BIGINT), lambda s, b: list_reduce([xor(s, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, _: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END)), 4294967295)"
ORACLES = {
    "op11_prefix_trie": f"""
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos, {{'r': coalesce(role, ''), 't': coalesce(text, '')}} AS t FROM conversations WHERE conv_id IS NOT NULL),
l AS (SELECT conv_id, list(t ORDER BY pos) AS ts FROM t GROUP BY conv_id),
h AS (SELECT conv_id, ts, (({_CRC}) % 6)::BIGINT AS h FROM (SELECT *, conv_id::VARCHAR AS c FROM l)),
n AS (SELECT h.conv_id, coalesce(b.ts[:h.h], []) || h.ts[h.h + 1:] AS ts FROM h LEFT JOIN l b ON b.conv_id = h.conv_id - h.conv_id % 100),
p AS (SELECT conv_id, unnest(range(0, len(ts) + 1)) AS depth, ts FROM n),
m AS (SELECT conv_id, depth, depth = len(ts) AS ended, CASE WHEN depth > 0 THEN length(ts[depth].t) ELSE 0 END AS chars, sha256(to_json(ts[:depth])::VARCHAR) AS k, CASE WHEN depth > 0 THEN sha256(to_json(ts[:depth - 1])::VARCHAR) END AS pk FROM p),
v AS (SELECT k, any_value(pk) AS pk, any_value(depth) AS depth, any_value(chars) AS chars, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ended), '') AS ends FROM m GROUP BY k),
c AS (SELECT pk AS k, count(*) AS n_children FROM v WHERE pk IS NOT NULL GROUP BY pk),
s AS (SELECT m.k, count(*) FILTER (c.k IS NULL) AS n_leaves, sum((v.n_convs - 1) * v.chars)::BIGINT AS saved_tokens FROM v LEFT JOIN c USING (k) JOIN m ON m.conv_id = v.conv_id AND m.depth <= v.depth GROUP BY m.k)
SELECT v.conv_id, v.depth, u.conv_id AS parent_conv_id, v.n_convs, coalesce(c.n_children, 0) AS n_children, s.n_leaves, s.saved_tokens, sha256(v.ends) AS ends_sha256
FROM v JOIN s USING (k) LEFT JOIN c USING (k) LEFT JOIN v u ON u.k = v.pk"""
}
