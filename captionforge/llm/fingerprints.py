"""Document fingerprints: a homomorphic multiset hash of paragraphs.

A paragraph is a line between ``\n``. Its vector has four numbers modulo 2**60 and 4096 lanes modulo 2**40. The four
come from its SHA-256, so that two documents agree in them only if they hold the same paragraphs as often. Each
sentence of the paragraph (a part between ``. ! ?``) adds one to the lane that its SHA-256 names. A document's
fingerprint is the sum of its paragraphs' vectors, so the order of paragraphs doesn't matter, and ``insert`` and
``delete`` update it without the rest of the text. Only lanes that aren't 0 are stored, sorted, each as one number with
its count in the low 40 bits.

Lanes 2b and 2b + 1 are the two signs of bucket b, so their difference is a count sketch. Two documents' likeness is the
Tanimoto coefficient of these differences, an estimate of that of the sentences' counts (README: its error); equal
fingerprints have likeness 1.

Null text counts as empty; an empty text has one empty paragraph and no sentence, so its likeness to other texts is 0.
Rows are ordered by doc_id (null first), then text; repeated rows each get a row, and follow one another. An only row is
its own next document. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from captionforge.llm.common import MASK60, keep, let, table

STRONG, LANES, BITS = 4, 4096, 40  # numbers, lanes, bits of a lane
MASK = (1 << BITS) - 1
#: Rows in a range of doc_id, and the ranges' first cut.
RANGE_ROWS, COARSE = 8192, 256


def _number(digest: Column, k: int) -> Column:
    """The k-th run of 60 bits of a hexadecimal digest."""
    return F.conv(F.substring(digest, 15 * k + 1, 15), 16, 10).cast("long")


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda s, x: (s + x).bitwiseAND(F.lit(MASK60)))


def _parts(digests: Column, k: int) -> Column:
    return F.transform(digests, lambda x: _number(x, k))


def _lane(x: Column) -> Column:
    return F.shiftright(x, BITS)


def _count(x: Column) -> Column:
    return x.bitwiseAND(F.lit(MASK))


def _signed(x: Column) -> Column:
    """The count, with the upper half of its range below 0, as a deletion before the insertion leaves it."""
    return _count(x).bitwiseXOR(F.lit(1 << (BITS - 1))) - F.lit(1 << (BITS - 1))


def _at(lane: Column, count: Column) -> Column:
    return F.shiftleft(lane, BITS).bitwiseOR(count.bitwiseAND(F.lit(MASK)))


def counted(lanes: Column) -> Column:
    """The lanes that occur in an array of lane numbers, with how often they do."""

    def runs(c: Column) -> Column:
        starts = F.filter(F.transform(c, lambda x, i: F.when(~x.eqNullSafe(F.get(c, i - 1)), i)), lambda i: i.isNotNull())
        return let(starts, lambda s: F.transform(s, lambda i, k: _at(F.get(c, i), (F.coalesce(F.get(s, k + 1), F.size(c)) - i).cast("long"))))

    return let(F.sort_array(lanes), runs)


def vector(text: Column) -> Column:
    """The fingerprint of a text: ``strong`` numbers and the ``lanes`` that aren't 0."""
    digests = F.transform(F.split(text, "\n"), lambda p: F.sha2(p, 256))
    strong = let(digests, lambda d: F.array(*(_sum(_parts(d, k)) for k in range(STRONG))))
    parts = F.array_remove(F.split(text, r"[.!?\n]+"), "")
    lanes = F.transform(parts, lambda s: F.conv(F.substring(F.sha2(s, 256), 1, 3), 16, 10).cast("long"))
    return F.struct(strong.alias("strong"), counted(lanes).alias("lanes"))


def _changed(v: Column, w: Column, sign: int) -> Column:
    strong = F.zip_with(v["strong"], w["strong"], lambda a, b: (a + sign * b).bitwiseAND(F.lit(MASK60)))
    other = F.transform(w["lanes"], lambda x: _at(_lane(x), sign * _count(x)))

    def merged(c: Column) -> Column:  # a lane stands there once or twice
        near = lambda x, i: _lane(F.get(c, i)).eqNullSafe(_lane(x))
        both = lambda x, i: F.when(near(x, i - 1), _at(_lane(x), _count(x) + _count(F.get(c, i - 1)))).otherwise(x)
        return F.filter(F.transform(c, lambda x, i: F.when(~near(x, i + 1), both(x, i))), lambda x: _count(x) > 0)

    return F.struct(strong.alias("strong"), let(F.sort_array(F.concat(v["lanes"], other)), merged).alias("lanes"))


def insert(fingerprint: Column, paragraphs: Column) -> Column:
    """The vector with further paragraphs, given as their own vector (``vector`` of the lines alone)."""
    return _changed(fingerprint, paragraphs, 1)


def delete(fingerprint: Column, paragraphs: Column) -> Column:
    return _changed(fingerprint, paragraphs, -1)


def printed(v: Column) -> Column:
    """Hexadecimal digits: the strong numbers, then each lane that isn't 0 (three digits) with its count."""
    digits = lambda x, n: F.lpad(F.lower(F.hex(x)), n, "0")
    lanes = F.transform(v["lanes"], lambda x: F.concat(digits(_lane(x), 3), F.lower(F.hex(_count(x)))))
    return F.concat(F.array_join(F.transform(v["strong"], lambda x: digits(x, 15)), ""), F.lit(":"), F.array_join(lanes, "."))


def squares(lanes: Column) -> Column:
    """Sum of the squared differences of lanes 2b and 2b + 1, from sorted lanes, each there any number of times."""
    zero = F.lit(0).cast("long")
    state = F.struct(F.lit(-1).cast("long").alias("bucket"), zero.alias("sum"), zero.alias("total"))

    def step(s: Column, x: Column) -> Column:
        bucket, value = F.shiftright(x, BITS + 1), F.when(_lane(x).bitwiseAND(F.lit(1)) == 1, _signed(x)).otherwise(-_signed(x))
        more = bucket == s["bucket"]
        return F.struct(bucket.alias("bucket"), F.when(more, s["sum"] + value).otherwise(value).alias("sum"), F.when(more, s["total"]).otherwise(s["total"] + s["sum"] * s["sum"]).alias("total"))

    return F.aggregate(lanes, state, step, lambda s: s["total"] + s["sum"] * s["sum"])


def likeness(v: Column, w: Column) -> Column:
    """Of two vectors: 0 to 1, to six decimals."""
    terms = F.struct((squares(v["lanes"]) + squares(w["lanes"])).alias("apart"), squares(F.sort_array(F.concat(v["lanes"], w["lanes"]))).alias("together"))

    def of(x: Column) -> Column:  # the product of both, doubled, is together - apart
        double = x["together"] - x["apart"]
        return F.coalesce(F.try_divide(double.cast("double"), (2 * x["apart"] - double).cast("double")), F.lit(0.0))

    return F.when(v == w, F.lit(1.0)).otherwise(F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), let(terms, of))), 6))


def with_next(rows: DataFrame) -> DataFrame:
    """Adds ``next_text`` and ``next_v`` of the row that follows by doc_id; after the last comes the first.

    Rows are dealt by ranges of doc_id of some thousand rows, found from quantiles, so no task sees all of them; only
    each range's first row crosses to the range before it.
    """
    count, low, high = rows.agg(F.count("*"), F.min("doc_id"), F.max("doc_id")).first()
    bounds = sorted({int(x) for x in rows.approxQuantile("doc_id", [k / COARSE for k in range(1, COARSE)], 1 / (4 * COARSE))} | {low}) if low is not None else [0]
    fine = max(1, -(-count // (RANGE_ROWS * len(bounds))))
    edges = F.array(*(F.lit(b).cast("long") for b in [*bounds, (high or 0) + 1]))
    coarse = F.when(F.col("doc_id").isNull(), 0).otherwise(F.size(F.filter(F.array(*(F.lit(b).cast("long") for b in bounds)), lambda b: b <= F.col("doc_id"))))
    rows = rows.withColumn("coarse", coarse)
    start, end = F.element_at(edges, F.greatest(F.col("coarse"), F.lit(1))), F.element_at(edges, F.col("coarse") + 1)
    within = F.floor((F.col("doc_id") - start).cast("double") / F.greatest(F.lit(1.0), (end - start).cast("double")) * fine)
    rows = rows.withColumn("range", F.col("coarse").cast("long") * fine + F.coalesce(F.least(F.greatest(within, F.lit(0)), F.lit(fine - 1)), F.lit(0)))

    heads = keep(rows.groupBy("coarse", "range").agg(F.min("doc_id").alias("head")), "fingerprints-heads")
    tops = heads.groupBy("coarse").agg(F.min("range").alias("top"))  # at most COARSE + 1 rows
    whole = Window.orderBy("coarse")
    tops = tops.withColumn("top", F.coalesce(F.lead("top").over(whole), F.first("top").over(whole))).withColumnRenamed("coarse", "of")
    after = heads.withColumn("after", F.lead("range").over(Window.partitionBy("coarse").orderBy("range"))).join(F.broadcast(tops), F.col("coarse") == F.col("of"), "left")
    after = after.select("range", F.coalesce("after", "top").alias("after"))
    small = heads.count() * 24 <= 32 << 20  # checked: else the join shuffles
    keys = heads.select(F.col("range").alias("r"), "head")
    first = rows.join(F.broadcast(keys) if small else keys, (F.col("range") == F.col("r")) & F.col("doc_id").eqNullSafe(F.col("head")))
    first = first.groupBy("range").agg(F.min(F.struct("text", "v")).alias("f"))
    following = keep(after.join(first.withColumnRenamed("range", "fr"), F.col("after") == F.col("fr")).select(F.col("range").alias("of"), "f"), "fingerprints-first")
    order = Window.partitionBy("range").orderBy(F.asc_nulls_first("doc_id"), "text")
    out = rows.withColumn("n", F.lead(F.struct("text", "v")).over(order))
    out = out.join(following, F.col("range") == F.col("of"), "left").withColumn("n", F.coalesce("n", "f"))
    return out.select("doc_id", "text", "v", F.col("n.text").alias("next_text"), F.col("n.v").alias("next_v"))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each row of ``documents``: its fingerprint, that of its edited text, and likeness of both kinds."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = with_next(docs.withColumn("v", vector(F.col("text"))))
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half)))
    rows = rows.withColumn("edited_v", vector(F.col("edited")))
    return rows.select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        printed(F.col("v")).alias("fingerprint"),
        printed(F.col("edited_v")).alias("edited_fingerprint"),
        likeness(F.col("v"), F.col("edited_v")).alias("near_edited"),
        likeness(F.col("v"), F.col("next_v")).alias("near_next"),
    )


QUERIES = {"op3_fingerprints": op3_fingerprints}
