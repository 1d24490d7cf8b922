"""Secret scans with corpus-wide ownership frequency.

Three base patterns find assigned values, access keys and hexadecimal digests. Mixed tokens (20 or more characters
with letters and digits) are further candidates. Every candidate value is counted over the corpus by distinct
documents (repositories) and sources (owners). A value is a copied example if more than ``max_owners`` owners hold it in
``MIN_REPOS`` repositories or more, or if more than ``MANY_REPOS`` repositories do, of whatever owners; the others look
live. Live mixed tokens become spans of kind ``owned``; base spans stay whatever their count.

Null text counts as empty; a null source and the empty one are one owner. Positions are in code points, end exclusive. Rows
equal in doc_id and text share one set of spans, so repeated rows get equal results. An empty table gives an empty
result. ``redact`` returns the columns it is given, whatever they are named.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from captionforge.llm.common import keep, let, table, text_key, text_or_empty

MAX_OWNERS, MIN_REPOS, MANY_REPOS = 2, 5, 100
MARK = "[secret]"
#: The kinds in their order, their patterns (group 1: the value) and least lengths.
KINDS = ("assign", "access", "hex", "owned")
ASSIGN = (
    r"(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
PATTERNS = (ASSIGN, r"(AKIA[A-Z0-9]{16,})", r"([0-9a-f]{24,})", r"([A-Za-z0-9+/_=-]{20,})")
MIN_ASSIGNED, MIN_DISTINCT = 6, 10


def spans(text: Column, kind: int) -> Column:
    """Leftmost non-overlapping matches as an array of (start, kind, end, value)."""
    pattern = PATTERNS[kind]
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    empty = F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>")

    def located(matches: Column, gaps: Column) -> Column:
        pairs = F.zip_with(F.slice(gaps, F.lit(1), F.size(matches)), matches, lambda g, m: F.struct(F.char_length(g).alias("skip"), m.alias("m")))
        zero = F.struct(F.lit(0).alias("at"), empty.alias("out"))

        def step(s: Column, x: Column) -> Column:
            start = s["at"] + x["skip"]
            end = start + F.char_length(x["m"])
            one = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), F.regexp_extract(x["m"], pattern, 1).alias("value"))
            return F.struct(end.alias("at"), F.concat(s["out"], F.array(one)).alias("out"))

        return F.aggregate(pairs, zero, step, lambda s: s["out"])

    every = let(found, lambda m: let(F.split(text, pattern), lambda g: located(m, g)))
    if kind == 0:
        every = F.filter(every, lambda x: F.char_length(x["value"]) >= MIN_ASSIGNED)
    if kind == 3:
        every = F.filter(every, lambda x: x["value"].rlike("[0-9].*[0-9]") & x["value"].rlike("[A-Za-z].*[A-Za-z]") & (F.size(F.array_distinct(F.split(x["value"], ""))) >= MIN_DISTINCT))
    return F.when(text.rlike(pattern), every).otherwise(empty)


def find(docs: DataFrame) -> DataFrame:
    """For each row: doc_id, the text's key, the source, base spans by start and kind, and mixed tokens beside them."""
    text = text_or_empty()
    rows = docs.select("doc_id", text_key(text).alias("key"), F.coalesce("source", F.lit("")).alias("source"), *(spans(text, k).alias(KINDS[k]) for k in range(4)))
    rows = rows.withColumn("base", F.sort_array(F.concat("assign", "access", "hex")))
    beside = F.filter("owned", lambda x: ~F.exists("base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))
    return rows.select("doc_id", "key", "source", "base", beside.alias("mixed"))


def ownership(found: DataFrame) -> DataFrame:
    """For each candidate value's SHA-256: distinct repositories (documents of an owner) and owners."""
    each = found.select("doc_id", "source", F.explode(F.array_distinct(F.transform(F.concat("base", "mixed"), lambda x: F.sha2(x["value"], 256)))).alias("hash"))
    by_repo = each.groupBy("hash", "source", "doc_id").agg(F.lit(1).alias("one"))
    by_owner = by_repo.groupBy("hash", "source").agg(F.count("*").alias("repos"))
    return by_owner.groupBy("hash").agg(F.sum("repos").alias("n_repos"), F.count("*").alias("n_owners"))


def live_spans(found: DataFrame, which: Column, max_owners: int = MAX_OWNERS) -> DataFrame:
    """Spans of live values among ``which``, as one array for each document and text that has any."""
    example = ((F.col("n_owners") > max_owners) & (F.col("n_repos") >= MIN_REPOS)) | (F.col("n_repos") > MANY_REPOS)
    live = ownership(found).filter(~example).select("hash")
    each = found.select("doc_id", "key", F.explode(which).alias("span")).withColumn("hash", F.sha2("span.value", 256))
    return each.join(live, "hash", "left_semi").groupBy("doc_id", "key").agg(F.sort_array(F.collect_set("span")).alias("live"))


def scan(docs: DataFrame, max_owners: int = MAX_OWNERS) -> DataFrame:
    """For each row: doc_id, ``base`` spans and all ``spans`` (base ones and live mixed tokens) by start and kind."""
    found = keep(find(docs), "secrets-found")
    live = live_spans(found, F.col("mixed"), max_owners).select(F.col("doc_id").alias("d"), F.col("key").alias("k"), "live")
    out = found.join(live, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("k")), "left")
    return out.select("doc_id", "base", F.when(F.col("live").isNull(), F.col("base")).otherwise(F.sort_array(F.concat("base", "live"))).alias("spans"))


def redact(docs: DataFrame, max_owners: int = MAX_OWNERS) -> DataFrame:
    """``docs`` with every live value replaced by a mark; rows without candidates pass by untouched and unshuffled."""
    candidate = text_or_empty().rlike("|".join(PATTERNS))
    with_any, others = docs.filter(candidate), docs.filter(~candidate)
    found = keep(find(with_any), "secrets-found")
    live = live_spans(found, F.concat("base", "mixed"), max_owners).select(F.col("doc_id").alias("__s_d"), F.col("key").alias("__s_k"), F.col("live").alias("__s_live"))
    text = F.col("text")

    def cut(s: Column, x: Column) -> Column:
        start = x["end"] - F.char_length(x["value"])
        piece = F.concat(s["out"], F.substring(text, s["at"] + 1, start - s["at"]), F.lit(MARK))
        return F.when(start >= s["at"], F.struct(x["end"].alias("at"), piece.alias("out"))).otherwise(s)

    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    cleaned = F.aggregate("__s_live", zero, cut, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.char_length(text))))
    out = with_any.withColumn("__s_key", text_key(text_or_empty())).join(live, F.col("doc_id").eqNullSafe(F.col("__s_d")) & (F.col("__s_key") == F.col("__s_k")), "left")
    out = out.withColumn("text", F.when(F.col("__s_live").isNull(), text).otherwise(cleaned))
    return out.select(*docs.columns).unionByName(others)


def listed(spans_: Column) -> Column:
    """``kind:start:end`` by start and kind, joined with commas."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans_, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each row of ``documents``."""
    out = scan(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return out.select("doc_id", *(count(k) for k in range(3)), F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


QUERIES = {"op9_secrets": op9_secrets}
