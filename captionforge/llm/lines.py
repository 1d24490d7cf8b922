"""Fuzzy line dedup: sketches of normalised lines, blocks, edit similarity, one occurrence per group.

A line is what stands between ``\n``. Normalising lower-cases it and takes its words, runs of letters and digits; a line
without any stands for itself, trimmed. Lines with equal words form a class, however short they are; blank lines are
never removed. Lines of ``min_chars`` characters or more have sketches: the hashes of their distinct words, the longest
first and then in the order of the hashes, and those of their character 6-grams if the line is short or unspaced. Three
neighbours among the first hashes make a block. Classes that share two blocks are candidates, and link when their edit
similarity, 1 - distance / longer length, is at least ``similarity``. So a link is missed if fewer blocks survive the
edits; the README gives the measured recall. Of each connected group the first occurrence by doc_id and line number
stays.

Two blocks of a class make a key, so classes meet in a key only if they share two blocks, and only if their lengths
permit a link. In each round every class outside a key's largest group meets one class of that group, the one that it
shares most keys with; a round costs at most one comparison for each class. Then all pairs that still meet in a key and
are of different groups are listed, each once, where its first two common blocks are; one pair of each two groups goes
first if that leaves out half of them or more, then those that are still apart. So no link is lost, and a group of near
copies costs a few comparisons for each; unlike lines of like lengths with the same two blocks are compared in all pairs.
No pair is compared twice. A round joins what it finds to the groups there are, without looking at older links.

Null text has no lines. Rows equal in doc_id and text share one decision, so an exact repeat of a row keeps what the row
keeps. A null doc_id comes first. Lines of any length are compared whole. An empty table gives an empty result; other
columns pass through ``dedup`` whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from captionforge.llm.common import keep, let, table, text_key, text_or_empty
from captionforge.llm.components import components


@dataclass(frozen=True)
class Fuzzy:
    min_chars: int = 20  # for links between different classes; equal lines need no minimum
    similarity: float = 0.8
    short_line: int = 64
    word_blocks: int = 8
    gram_blocks: int = 14
    ahead: int = 8  # words that an insertion or deletion may have to be found at once
    shared_blocks: int = 2
    pivots: int = 2  # rounds in which classes meet one of their key's largest group, at least
    growth: int = 4  # another such round follows one in which more than one in so many pairs was a link


GRAM = 6
SMALL = 32 << 20  # bytes that a broadcast side may have
_AT = ("doc_id", "key", "line_no")


def words_in(line: Column) -> Column:
    """Runs of letters and digits in lower case."""
    parts = F.split(F.lower(line), r"[^\p{L}\p{N}]+")

    def trimmed(p: Column) -> Column:
        first, last = F.when(F.get(p, F.lit(0)) == "", 1).otherwise(0), F.when(F.element_at(p, -1) == "", 1).otherwise(0)
        return F.slice(p, first + 1, F.greatest(F.size(p) - first - last, F.lit(0)))

    return let(parts, trimmed)


def bare(line: Column) -> Column:
    return F.trim(F.regexp_replace(line, r"\s+", " "))


def numbered(docs: DataFrame) -> DataFrame:
    """doc_id, key (of the text), line_no, line and words of every line that isn't blank."""
    lines = docs.select("doc_id", text_key(text_or_empty()).alias("key"), F.posexplode(F.split(text_or_empty(), "\n")).alias("line_no", "line"))
    return lines.filter(F.col("line").rlike(r"\S")).withColumn("words", words_in(F.col("line")))


def neighbours(least: Column) -> Column:
    """Hashes of three neighbours each."""
    return F.transform(F.slice(least, F.lit(1), F.greatest(F.size(least) - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(least, i + 1), F.get(least, i + 2)))


def sketched(lines: DataFrame, p: Fuzzy) -> DataFrame:
    """doc_id, key, line_no, id (of the class) and its blocks, step by step, as plain numbers sort fast only outside of functions."""
    # the longest words first, as they are the rarest: the top bits hold the missing length
    place = lambda w: F.shiftleft((12 - F.least(F.char_length(w), F.lit(12))).cast("long"), 59).bitwiseOR(F.shiftrightunsigned(F.xxhash64(w), 5))
    grams = lambda chars: F.transform(chars, lambda x, i: F.xxhash64(x, *(F.coalesce(F.get(chars, i + j), F.lit("")) for j in range(1, GRAM))))
    n = F.char_length("line")
    none = F.array().cast("array<bigint>")
    short = (n >= p.min_chars) & ((n <= p.short_line) | (n > 12 * F.size("words")))
    out = lines.withColumn("id", F.when(F.size("words") > 0, F.xxhash64("words")).otherwise(F.xxhash64(bare(F.col("line")))))
    out = out.withColumn("places", F.transform("words", place)).withColumn("grams", F.when(short, let(F.split(F.array_join("words", " "), ""), grams)).otherwise(none))
    out = out.withColumn("long", n >= p.min_chars).select(*_AT, "id", "places", "grams", "long")
    out = out.withColumn("places", F.sort_array(F.array_distinct("places"))).withColumn("grams", F.sort_array(F.array_distinct("grams")))
    out = out.withColumn("places", F.slice("places", 1, p.word_blocks + 2)).withColumn("grams", F.slice("grams", 1, p.gram_blocks + 2))
    blocks = F.when(F.col("long"), F.concat(neighbours(F.col("places")), neighbours(F.col("grams")))).otherwise(none)
    return out.select(*_AT, "id", blocks.alias("blocks"))


def edits(x: Column, y: Column, ahead: int) -> Column:
    """What one way to turn the words ``x`` into the words ``y`` costs in characters, so never less than the edit distance.

    One walk over both. Where they differ and the next words don't, a word is replaced; else words of ``y`` are inserted
    or one is deleted if the word and its neighbour follow among the next ``ahead`` of the other side; else it is replaced.
    """
    size = lambda w: F.coalesce(F.char_length(w), F.lit(0)) + 1  # noqa: E731  with the blank beside it

    def follows(words: Column, at: Column, w: Column, after: Column) -> Column:
        found = F.lit(0)
        for k in range(ahead, 0, -1):
            found = F.when((F.get(words, at + k) == w) & F.get(words, at + k + 1).eqNullSafe(after), k).otherwise(found)
        return found

    def step(s: Column, w: Column) -> Column:
        i, j, cost, other = s["i"], s["j"], s["cost"], F.get(y, s["j"])
        state = lambda to, more: F.struct((i + 1).alias("i"), to.alias("j"), (cost + more).alias("cost"))
        replaced = state(j + 1, F.greatest(size(w), size(other)) - 1)

        def differ(f: Column) -> Column:
            inserted = sum((F.when(f["new"] > k, size(F.get(y, j + k))).otherwise(0) for k in range(ahead)), F.lit(0))
            insert = (f["new"] > 0) & ((f["old"] == 0) | (f["new"] <= f["old"]))
            return F.when(insert, state(j + f["new"] + 1, inserted)).when(f["old"] > 0, state(j, size(w))).otherwise(replaced)

        after, other_after = F.get(x, i + 1), F.get(y, j + 1)
        out = F.when(other == w, state(j + 1, F.lit(0))).when(other.isNull(), state(j, size(w))).when(after == other_after, replaced)
        return out.otherwise(let(F.struct(follows(y, j, w, after).alias("new"), follows(x, i, other, other_after).alias("old")), differ))

    start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("cost"))
    rest = lambda s: F.aggregate(F.slice(y, s["j"] + 1, F.size(y)), s["cost"], lambda n, w: n + size(w))
    return F.aggregate(x, start, step, rest)


def linked(pairs: DataFrame, texts: DataFrame, p: Fuzzy) -> DataFrame:
    """The pairs (a, b, further columns) whose lines are similar enough.

    Lengths come first, then the cost of one way to edit, linear in the words, which settles nearly all links; the edit
    distance itself is for the others.
    """
    side = lambda id_, x: texts.select(F.col("id").alias(id_), F.col("norm").alias(x), F.char_length("norm").alias(f"n{x}"))
    both = pairs.join(side("a", "x"), "a").join(side("b", "y"), "b").select(*pairs.columns, "x", "y", "nx", "ny", F.floor(F.greatest("nx", "ny") * (1 - p.similarity) + 1e-9).cast("int").alias("room"))
    both = both.filter((F.abs(F.col("nx") - F.col("ny")) <= F.col("room")) & (F.least("nx", "ny") >= p.min_chars))
    cost = let(F.struct(F.split("x", " ").alias("x"), F.split("y", " ").alias("y")), lambda w: edits(w["x"], w["y"], p.ahead))
    within = F.call_function("levenshtein", F.col("x"), F.col("y"), F.col("room")) >= 0
    return both.filter((cost <= F.col("room")) | within).select(*pairs.columns)


def doubles(blocks: Column) -> Column:
    """A hash for each two of the blocks, which are in order."""
    return F.flatten(F.transform(blocks, lambda x, i: F.transform(F.slice(blocks, i + 2, F.size(blocks)), lambda y: F.xxhash64(x, y))))


def alike(n: Column, m: Column, p: Fuzzy) -> Column:
    """Whether lines of these lengths can link."""
    return F.abs(n - m) <= F.floor(F.greatest(n, m) * (1 - p.similarity) + 1e-9)


def meetings(rows: DataFrame, turn: int) -> DataFrame:
    """rows (key, id, n, comp) of the keys with more than one group, beside one class of the key's largest group, another each turn."""
    groups = rows.groupBy("key", "comp").agg(F.count("*").alias("size"), F.min(F.struct(F.xxhash64("id", F.lit(turn)).alias("h"), "id", "n")).alias("one"))
    most = groups.groupBy("key").agg(F.max(F.struct("size", "comp", F.col("one.id").alias("id"), F.col("one.n").alias("n"))).alias("most"), F.count("*").alias("groups"))
    most = most.filter("groups > 1").select("key", F.col("most.comp").alias("major"), F.col("most.id").alias("pivot"), F.col("most.n").alias("pivot_n"))
    return rows.join(most, "key")


def stars(rows: DataFrame, p: Fuzzy) -> DataFrame:
    """For each class outside of a key's largest group the pivot that it shares most keys with: a, b and their groups."""
    votes = rows.filter((F.col("comp") != F.col("major")) & alike(F.col("n"), F.col("pivot_n"), p)).groupBy("id", "pivot").agg(F.count("*").alias("votes"), F.first("comp").alias("comp"), F.first("major").alias("major"))
    best = votes.groupBy("id").agg(F.max(F.struct("votes", "pivot", "comp", "major")).alias("best"))
    return ordered(best.select(F.struct("id", F.col("best.comp").alias("comp")).alias("x"), F.struct(F.col("best.pivot").alias("id"), F.col("best.major").alias("comp")).alias("y"))).distinct()


def ordered(pairs: DataFrame) -> DataFrame:
    """a, b, comp_a and comp_b of pairs of structs x and y."""
    first, last = F.least("x", "y"), F.greatest("x", "y")
    return pairs.select(first["id"].alias("a"), last["id"].alias("b"), first["comp"].alias("comp_a"), last["comp"].alias("comp_b"))


def remainder(rows: DataFrame, sketches: DataFrame, p: Fuzzy) -> DataFrame:
    """All pairs of classes of different groups that meet in a key and can link, each once: where its first two common blocks are."""
    rows = rows.join(sketches.select("id", "blocks"), "id")
    side = lambda d, name: d.select("key", F.struct("id", "comp").alias(name), F.col("n").alias(f"n{name}"), F.col("blocks").alias(f"b{name}"), F.col("major").alias(f"m{name}"))
    once = (F.col("y.comp") == F.col("my")) | (F.col("x.id") < F.col("y.id"))
    here = let(F.array_intersect("bx", "by"), lambda b: F.xxhash64(F.get(b, F.lit(0)), F.get(b, F.lit(1)))) == F.col("key")
    left, right = side(rows.filter("comp <> major"), "x"), side(rows, "y")
    met = left.withColumnRenamed("key", "k").join(right, (F.col("k") == F.col("key")) & (F.col("x.comp") != F.col("y.comp")) & once & alike(F.col("nx"), F.col("ny"), p) & here)
    return ordered(met)


def relabelled(rows: DataFrame, moved: DataFrame, *names: str) -> DataFrame:
    """``rows`` with the groups in ``names`` as ``moved`` (node, comp) has them now."""
    for name in names:
        to = moved.select(F.col("node").alias(name), F.col("comp").alias("__to"))
        rows = rows.join(to, name, "left").withColumn(name, F.coalesce("__to", name)).drop("__to")
    return rows


def link_classes(members: DataFrame, texts: DataFrame, p: Fuzzy) -> DataFrame:
    """node and comp of every class that is linked with another, from shared blocks (block, id)."""
    lengths = texts.select("id", F.char_length("norm").alias("n")).filter(F.col("n") >= p.min_chars)
    sketches = members.groupBy("id").agg(F.sort_array(F.collect_list("block")).alias("blocks")).filter(F.size("blocks") >= p.shared_blocks)
    sketches = keep(sketches.join(lengths, "id"), "lines-sketches")
    rows = sketches.select(F.explode(doubles(F.col("blocks"))).alias("key"), "id", "n", F.col("id").alias("comp"))

    def joined(pairs: DataFrame, comps: DataFrame | None) -> tuple[int, DataFrame | None, DataFrame]:
        """How many links were found, what they move to another group, and all groups."""
        links = keep(linked(pairs, texts, p).select(F.col("comp_a").alias("a"), F.col("comp_b").alias("b")).distinct(), "lines-links")
        found = links.count()
        if comps is None:
            moved = comps = components(links, "lines")
        elif found:
            moved = components(links, "lines")
            comps = keep(relabelled(comps, moved, "comp").select("node", "comp").unionByName(moved.join(comps, "node", "left_anti")), "lines-groups")
        else:
            moved = None
        return found, moved, comps

    tested, comps, turn = None, None, 0
    while True:
        rows = keep(meetings(rows, turn), "lines-open")
        pairs = stars(rows, p)
        pairs = keep(pairs.join(tested, ["a", "b"], "left_anti") if tested else pairs, "lines-pairs")
        tested = tested.unionByName(pairs.select("a", "b")) if tested else pairs.select("a", "b")
        found, moved, comps = joined(pairs, comps)
        rows = rows.select("key", "id", "n", "comp")
        rows = relabelled(rows, moved, "comp") if moved else rows
        turn += 1
        if turn >= p.pivots and found * p.growth <= pairs.count():
            break
    pairs = remainder(keep(meetings(rows, turn), "lines-open"), sketches, p).join(tested, ["a", "b"], "left_anti")
    pairs = keep(pairs, "lines-pairs")
    groups = F.least("comp_a", "comp_b"), F.greatest("comp_a", "comp_b")
    first = keep(pairs.groupBy(*groups).agg(F.min_by(F.struct("a", "b", "comp_a", "comp_b"), F.xxhash64("a", "b")).alias("one")).select("one.*"), "lines-first")
    if 2 * first.count() <= pairs.count():  # else the round saves little
        _, moved, comps = joined(first, comps)
        pairs = pairs.join(first.select("a", "b"), ["a", "b"], "left_anti")
        pairs = keep(relabelled(pairs, moved, "comp_a", "comp_b").filter("comp_a <> comp_b") if moved else pairs, "lines-pairs")
    return joined(pairs, comps)[2]


def decisions(docs: DataFrame, p: Fuzzy = Fuzzy()) -> DataFrame:
    """doc_id, key and line_no of every line that goes: it is not the first occurrence of its group."""
    seen = keep(sketched(numbered(docs), p), "lines-seen")
    members = seen.select("id", F.explode("blocks").alias("block"))
    ends = members.groupBy("block").agg(F.min("id").alias("first"), F.max("id").alias("last")).filter("first < last").select("block")
    ends = keep(ends, "lines-ends")
    side = F.broadcast(ends) if ends.count() * 40 <= SMALL else ends  # checked: else the join shuffles
    members = keep(members.join(side, "block").distinct(), "lines-members")
    classes = seen.groupBy("id").agg(F.min(F.struct(*_AT)).alias("at"), F.count("*").alias("n"))
    classes = keep(classes.join(members.select("id").distinct().withColumn("shares", F.lit(True)), "id", "left").filter("n > 1 or shares"), "lines-classes")
    place = classes.filter("shares")
    by_doc = place.groupBy(F.col("at.doc_id").alias("d"), F.col("at.key").alias("k")).agg(F.collect_list(F.struct(F.col("at.line_no").alias("line_no"), "id")).alias("wanted"))
    by_doc = F.broadcast(by_doc) if place.count() * 80 <= SMALL else by_doc  # checked: else the join shuffles
    whole = docs.select("doc_id", text_key(text_or_empty()).alias("key"), text_or_empty().alias("text")).join(by_doc, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("k")))
    texts = whole.select(F.explode(let(F.split("text", "\n"), lambda t: F.transform("wanted", lambda x: F.struct(x["id"].alias("id"), F.get(t, x["line_no"]).alias("line"))))).alias("x"))
    texts = texts.select("x.id", "x.line").dropDuplicates(["id"]).select("id", F.array_join(words_in(F.col("line")), " ").alias("norm"))
    comps = keep(link_classes(members, keep(texts, "lines-texts"), p).withColumnRenamed("node", "id"), "lines-groups")
    grouped = place.join(comps, "id").select("id", "comp", "at")
    firsts = grouped.join(grouped.groupBy("comp").agg(F.min("at").alias("first")), "comp").select("id", "first")
    firsts = keep(classes.join(firsts, "id", "left").filter("n > 1 or first is not null").select("id", F.coalesce("first", "at").alias("first")), "lines-firsts")
    firsts = F.broadcast(firsts) if firsts.count() * 60 <= SMALL else firsts  # checked: else the join shuffles
    again = seen.select(*_AT, "id").join(firsts, "id").filter(~F.struct(*_AT).eqNullSafe(F.col("first")))
    return again.select(*_AT)


def marked(docs: DataFrame, p: Fuzzy = Fuzzy()) -> DataFrame:
    """``docs`` with ``__l_gone``, the numbers of the lines that go, null if none does."""
    each = keep(decisions(docs, p), "lines-gone")
    gone = each.groupBy(F.col("doc_id").alias("__l_d"), F.col("key").alias("__l_k")).agg(F.collect_set("line_no").alias("__l_gone"))
    gone = F.broadcast(gone) if each.count() * 60 <= SMALL else gone  # checked: else the join shuffles
    out = docs.withColumn("__l_key", text_key(text_or_empty())).join(gone, F.col("doc_id").eqNullSafe(F.col("__l_d")) & (F.col("__l_key") == F.col("__l_k")), "left")
    return out.select(*docs.columns, "__l_gone")


def left_text() -> Column:
    """The text without the lines in ``__l_gone``."""

    def left(t: Column) -> Column:
        return F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(t) - 1), "__l_gone"), lambda i: F.get(t, i)), "\n")

    return F.when(F.col("__l_gone").isNotNull(), let(F.split("text", "\n"), left)).otherwise(F.col("text"))


def dedup(docs: DataFrame, p: Fuzzy = Fuzzy(), drop_emptied: bool = False) -> DataFrame:
    """``docs`` without repeated lines, and ``n_chars``, if there, of what is left.

    ``drop_emptied``: rows that lose all their lines with a word go.
    """
    out = marked(docs, p).withColumn("text", left_text())
    touched = F.col("__l_gone").isNotNull()
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(touched, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    if drop_emptied:
        out = out.filter(~touched | F.col("text").rlike(r"[^\s]"))
    return out.select(*docs.columns)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each row of ``documents``: its lines (an empty text has none), those that go, and the text that stays."""
    out = marked(table(spark, sf_dir, "documents").select("doc_id", "text"))
    n = F.when(text_or_empty() == "", 0).otherwise(F.size(F.split("text", "\n")))
    removed = F.coalesce(F.size("__l_gone"), F.lit(0))
    return out.select("doc_id", n.cast("long").alias("n_lines"), F.when(F.col("__l_gone").isNull(), 0).otherwise(removed).cast("long").alias("n_removed"), F.sha2(F.coalesce(left_text(), F.lit("")), 256).alias("kept_sha256"))


QUERIES = {"op4_line_dedup": op4_line_dedup}
