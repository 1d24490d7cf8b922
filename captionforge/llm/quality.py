"""Quality rules by distribution divergence.

Each document's histogram of character classes and of its language's most common words is compared with the
language's own histogram over the whole corpus by Jensen-Shannon distance (base 2, 0 to 1).

Null text counts as empty. An empty text, or one under ``min_words``, fails the base rule. Divergence is judged only
from ``min_judged_words`` words on. A null language and the empty one are one language. Every language with
``min_language_words`` words in the corpus has its own histogram; a smaller one has too little text for any, so its
documents have the base verdict alone and no distances. Repeated rows each get their row; ties among common words go to
the smaller word. Words and word windows are compared by 64-bit hashes. An empty table gives an empty result. Other
columns pass through ``assess`` untouched.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from captionforge.llm.common import NO_SPACES, WHITE, keep, let, table, text_or_empty, words_of


@dataclass(frozen=True)
class Rules:
    min_words: int = 50
    max_repeat_percent: int = 50
    common_words: int = 32  # at most 62: each gets one character as its mark
    max_class_distance: float = 0.30
    max_word_distance: float = 0.42
    min_judged_words: int = 50
    min_language_words: int = 2000


#: Name and pattern of what is *not* in the class; lower case is the rest.
CLASSES = (
    ("upper", r"[^A-Z]+"),
    ("digit", r"[^0-9]+"),
    ("point", r"[^.,;:!?'\"()-]+"),
    ("symbol", r"[^#*$%&|<>]+"),
    ("wide", r"[\x00-\x7F]+"),
    ("odd", r"[A-Za-z0-9.,;:!?'\"()#*$%&|<>\x09-\x0D\x20\x80-\x{10FFFF}-]+"),
)
SMALL = 4096  # references that may be broadcast, of about nine kilobytes each
SLOTS = 1024  # of a language's table of common words
PARTS = 8  # in which a language's words are ranked before the best of all parts are
_Q = "__q_"
_call = F.call_function


def removed(text: Column, pattern: str) -> Column:
    return F.regexp_replace(text, pattern, "")


def class_counts(text: Column) -> list[tuple[Column, str]]:
    """Steps (value, name) that end in one count for each class, spaces and the rest.

    What most characters are, ASCII letters in lower case and spaces, is taken out first, so the other classes are
    looked for in a small remnant. Spaces are counted by taking out each kind, without the regex engine.
    """
    count = lambda c: F.char_length(c).cast("long")
    left, size = F.col(f"{_Q}left"), F.octet_length(text).cast("long")
    spaces = sum((size - F.octet_length(F.replace(text, F.lit(c), F.lit(""))) for c in WHITE), F.lit(0))
    steps = [(count(text), "n_chars"), (spaces.cast("long"), "space"), (removed(text, r"[a-z\x20\x09-\x0D]+"), "left")]
    steps += [(count(removed(left, others)), name) for name, others in CLASSES]
    rest = F.col(f"{_Q}n_chars") - F.col(f"{_Q}space") - sum((F.col(f"{_Q}{name}") for name, _ in CLASSES), F.lit(0))
    return [*steps, (rest, "rest")]


def with_steps(df: DataFrame, steps: list[tuple[Column, str]]) -> DataFrame:
    """One column after the other, so that none is computed twice."""
    for value, name in steps:
        df = df.withColumn(_Q + name, value)
    return df


ALL_CLASSES = ("rest", "space", *(name for name, _ in CLASSES))


def repeat_steps(hashes: Column) -> list[tuple[Column, str]]:
    """Steps that end in ``n_repeat_words``: words inside 3-word windows that occur twice or more in the text.

    Only texts with a repeated window are looked at further: their windows are sorted by hash, each with its place in
    the low bits, which sorts plain numbers. Those that agree with a neighbour in the other bits are few; they are then
    compared by their whole hashes.
    """
    col = lambda n: F.col(_Q + n)
    windows = F.transform(F.slice(hashes, F.lit(1), F.greatest(F.size(hashes) - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(hashes, i + 1), F.get(hashes, i + 2)))
    bits, low = F.length(F.bin(F.size(col("windows")).cast("long"))), _call("shiftleft", F.lit(1).cast("long"), col("bits")) - 1
    placed = F.transform(col("windows"), lambda x, i: x.bitwiseAND(col("high")).bitwiseOR(i.cast("long")))
    alike = lambda x, i: F.get(col("placed"), i).bitwiseAND(col("high")) == x.bitwiseAND(col("high"))
    near = F.filter(col("placed"), lambda x, i: F.coalesce(alike(x, i + 1), F.lit(False)) | alike(x, i - 1))
    hash_at = F.transform(col("near"), lambda x: F.get(col("windows"), x.bitwiseAND(col("low")).cast("int")))
    again = lambda i: (F.get(col("hash_at"), i) == F.get(col("hash_at"), i - 1)) | (F.get(col("hash_at"), i) == F.get(col("hash_at"), i + 1))
    twice = F.filter(F.transform(col("near"), lambda x, i: F.when(again(i), x.bitwiseAND(col("low")))), lambda x: x.isNotNull())
    reach = F.transform(col("twice"), lambda x, i: F.least(F.lit(3).cast("long"), F.get(col("twice"), i + 1) - x))
    return [
        (windows, "windows"),
        (bits, "bits"),
        (low, "low"),
        (F.bitwise_not(col("low")), "high"),
        (F.when(F.size(F.array_distinct(col("windows"))) < F.size(col("windows")), F.sort_array(placed)), "placed"),
        (near, "near"),
        (hash_at, "hash_at"),
        (F.sort_array(twice), "twice"),
        (F.coalesce(F.aggregate(reach, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0).cast("long")), "n_repeat_words"),
    ]


def js_distance(p: Column, q: Column) -> Column:
    """Of two arrays of shares that each sum to 1, to six decimals."""

    def half(a: Column, b: Column) -> Column:
        return F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x > 0, x * F.log2(2 * x / (x + y))).otherwise(0.0)), F.lit(0.0), lambda s, x: s + x)

    return F.round(F.sqrt(F.greatest(F.lit(0.0), (half(p, q) + half(q, p)) / 2)), 6)


def shares(counts: Column) -> Column:
    def of(c: Column) -> Column:
        total = F.array(F.aggregate(c, F.lit(0).cast("long"), lambda s, x: s + x).cast("double"))
        return F.flatten(F.transform(total, lambda t: F.transform(c, lambda x: F.coalesce(F.try_divide(x.cast("double"), t), F.lit(0.0)))))

    return let(counts, of)


def measured(docs: DataFrame) -> DataFrame:
    """``docs`` with the base counts, the class counts and the words' hashes, in columns that start with ``__q_``."""
    text = text_or_empty()
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(NO_SPACES))
    hashes = F.transform(words_of(text), lambda w: F.xxhash64(w))
    steps = [
        (F.coalesce(F.col("lang"), F.lit("")), "lang"), *class_counts(text), (lines, "lines"), (hashes, "hashes"),
        (F.size(f"{_Q}hashes").cast("long"), "n_words"), (F.col(f"{_Q}n_chars") - F.col(f"{_Q}space"), "word_chars"),
        ((F.size(f"{_Q}lines") - F.size(F.array_distinct(f"{_Q}lines"))).cast("long"), "n_dup_lines"), *repeat_steps(F.col(f"{_Q}hashes")),
    ]
    done = with_steps(docs, steps)
    return done.drop(*(_Q + n for n in ("left", "lines", "windows", "bits", "low", "high", "placed", "near", "hash_at", "twice")))


def _place(h: Column, shift: Column) -> Column:
    return _call("shiftrightunsigned", h, shift).bitwiseAND(F.lit(SLOTS - 1)).cast("int")


def table_of(hashes: Column) -> Column:
    """A table of ``SLOTS`` places that holds the hashes: at some shift all of them fall on different places.

    shift is null if no shift does (then the hashes are compared one by one).
    """
    fits = F.filter(F.sequence(F.lit(0), F.lit(50)), lambda s: F.size(F.array_distinct(F.transform(hashes, lambda h: _place(h, s)))) == F.size(hashes))
    at = lambda s: let(F.transform(hashes, lambda h: _place(h, s)), lambda p: F.transform(F.sequence(F.lit(0), F.lit(SLOTS - 1)), lambda k: F.get(hashes, F.array_position(p, k).cast("int") - 1)))
    return let(F.get(fits, F.lit(0)), lambda s: F.struct(s.alias("shift"), at(s).alias("held")))


def references(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """One row for each language with enough words: class shares, its common words' hashes, their table and shares."""
    text = text_or_empty()
    lang = F.coalesce(F.col("lang"), F.lit("")).alias("lang")
    counted = with_steps(docs.select(lang, text.alias("text")), class_counts(F.col("text")))
    by_lang = counted.groupBy("lang").agg(*(F.sum(_Q + c).alias(c) for c in ALL_CLASSES))
    classes = by_lang.select("lang", shares(F.array(*ALL_CLASSES)).alias("class_share"))

    words = keep(docs.select(lang, F.explode(words_of(text)).alias("word")).groupBy("lang", "word").agg(F.count("*").alias("n")), "quality-words")
    enough = words.groupBy("lang").agg(F.sum("n").alias("n_words")).filter(F.col("n_words") >= rules.min_language_words)
    best = lambda *by: F.row_number().over(Window.partitionBy("lang", *by).orderBy(F.desc("n"), "word"))
    top = words.withColumn("part", F.pmod(F.xxhash64("word"), F.lit(PARTS))).withColumn("k", best("part")).filter(F.col("k") <= rules.common_words)
    top = top.withColumn("k", best()).filter(F.col("k") <= rules.common_words)  # of few rows for each language
    lists = top.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("k", "word", "n"))).alias("list"))
    n = F.transform("list", lambda x: x["n"])
    common = lists.withColumn("common", F.transform("list", lambda x: F.xxhash64(x["word"]))).withColumn("table", table_of(F.col("common")))
    full = lambda n: F.concat(F.array(F.col("n_words") - F.aggregate(n, F.lit(0).cast("long"), lambda s, x: s + x)), n, F.array_repeat(F.lit(0).cast("long"), rules.common_words - F.size(n)))
    return classes.join(enough, "lang").join(common, "lang").select("lang", "class_share", "common", "table", shares(full(n)).alias("common_share"))


def assess(docs: DataFrame, rules: Rules = Rules(), refs: DataFrame | None = None) -> DataFrame:
    """``docs`` plus the columns ``__q_*``: counts, both distances, ``__q_base_failed`` and ``__q_kept``."""
    refs = keep(references(docs, rules) if refs is None else refs, "quality-references")
    own = refs.select(F.col("lang").alias(f"{_Q}lang"), F.struct("class_share", "common", "table", "common_share").alias(f"{_Q}ref"))
    own = F.broadcast(own) if refs.count() <= SMALL else own  # checked: else the join shuffles
    col = lambda n: F.col(_Q + n)
    common, shift, held = col("ref.common"), col("ref.table.shift"), col("ref.table.held")
    sure = F.filter(f"{_Q}hashes", lambda h: F.get(held, _place(h, shift)) == h)
    slow = F.filter(f"{_Q}hashes", lambda h: F.array_contains(common, h))
    hits = F.when(shift.isNotNull(), sure).otherwise(slow)
    # each common word becomes one ASCII mark
    marks = F.array_join(F.transform(hits, lambda h: F.chr(64 + F.array_position(common, h))), "")
    of = lambda k: (F.length(col("marks")) - F.length(F.replace(col("marks"), F.lit(chr(64 + k)), F.lit("")))).cast("long")
    seen = F.array(col("n_words") - F.length(col("marks")), *(of(k) for k in range(1, rules.common_words + 1)))
    n = col("n_words")
    failed = (n < rules.min_words) | (100 * col("n_repeat_words") > rules.max_repeat_percent * n)
    odd = col("ref").isNotNull() & (n >= rules.min_judged_words) & ((col("class_distance") > rules.max_class_distance) | (col("word_distance") > rules.max_word_distance))
    steps = [
        (marks, "marks"), (shares(F.array(*(col(c) for c in ALL_CLASSES))), "class_share"), (shares(seen), "word_share"),
        (F.when(col("ref").isNotNull(), js_distance(col("class_share"), col("ref.class_share"))), "class_distance"), (F.when(col("ref").isNotNull(), js_distance(col("word_share"), col("ref.common_share"))), "word_distance"),
        (failed, "base_failed"), (~failed & ~odd, "kept"),
    ]
    out = with_steps(measured(docs).join(own, f"{_Q}lang", "left"), steps).drop(f"{_Q}hashes", f"{_Q}marks")
    # a generator, as filters on the results would be pushed into the steps and repeat them
    made = F.struct(*(F.col(c) for c in out.columns if c not in docs.columns))
    return out.select(*docs.columns, F.explode(F.array(made)).alias(f"{_Q}all")).select(*docs.columns, f"{_Q}all.*")


def keep_good(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with the columns of ``docs``."""
    out = assess(docs, rules)
    # a filter would be pushed below the measurements and repeat them; a generator stays above
    return out.select(*docs.columns, F.explode(F.when(F.col(f"{_Q}kept"), F.array(F.lit(1)))).alias(f"{_Q}go")).drop(f"{_Q}go")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each row of ``documents``."""
    out = assess(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    names = ("n_words", "word_chars", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "class_distance", "word_distance")
    return out.select("doc_id", F.col(f"{_Q}symbol").alias("n_symbols"), *(F.col(f"{_Q}{n}").alias(n) for n in names))


QUERIES = {"op5_quality_rules": op5_quality_rules}
