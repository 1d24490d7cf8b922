"""Line dedup, substring dedup, Jaccard join, language model, URL lists and the pipeline against brute force."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from captionforge.llm import hmm, jaccard, lines, substrings, url_lists
from captionforge.llm.common import let
from captionforge.llm.components import components
from tests.llm.conftest import prose


class Groups(dict):
    def __missing__(self, x):
        self[x] = x
        return x

    def find(self, x):
        while self[x] != x:
            x = self[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self[max(a, b)] = min(a, b)


def test_components(spark):
    rng = random.Random(4)
    pairs = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(1000, 1400), rng.randrange(1000, 1400)) for _ in range(250)] + [(7, k) for k in range(2000, 2300)]
    groups = Groups()
    for a, b in pairs:
        groups.join(a, b)
    got = {r.node: r.comp for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: groups.find(x) for p in pairs for x in p}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def near_corpus(rng, copies=60):
    """Chains of near copies, two large groups, and boilerplate that many documents share."""
    plate = prose(rng, 25)
    texts = [prose(rng, 90) for _ in range(30)]
    for base in (texts[0], texts[1]):
        for _ in range(copies):
            w = base.split(" ")
            for _ in range(rng.randrange(0, 5)):
                w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
            texts.append(" ".join(w))
    w = texts[2].split(" ")
    for k in range(15):
        w = list(w)
        w[k * 5] = f"step{k}"
        texts.append(" ".join(w))
    return [t + " " + plate if k % 2 else plate + " " + t for k, t in enumerate(texts)] + texts[:3]


def jaccard_groups(rows, words, percent):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set()))
    groups = Groups()
    for a, b in combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            groups.join(a, b)
    return sets, groups


@pytest.mark.parametrize("small_block,pivots", [(32, 8), (2, 2)])
def test_jaccard(spark, small_block, pivots):
    rows = list(enumerate(near_corpus(random.Random(8))))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.components_of(docs, jaccard.Join(words=4, percent=85, local=2, frequent=50, small_block=small_block, pivots=pivots, cell=5, part=20)).collect()}
    sets, groups = jaccard_groups(rows, 4, 85)
    assert got == {i: (len(sets[i]), groups.find(i)) for i, _ in rows}


@pytest.mark.parametrize("wide", [64, 3])
def test_jaccard_large_blocks(spark, wide):
    """Blocks of any size, classes with many large blocks, cells bounded by shingles."""
    rows = list(enumerate(near_corpus(random.Random(21), copies=40)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    p = jaccard.Join(words=4, percent=85, local=10**9, small_block=3, new_block=4, pivots=3, wide=wide, cell_shingles=500, part_shingles=1500)
    sets, groups = jaccard_groups(rows, 4, 85)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.components_of(docs, p).collect()} == {i: (len(sets[i]), groups.find(i)) for i, _ in rows}


def test_jaccard_low_threshold(spark):
    """Sets of a few words that link by one shared word alone."""
    rng = random.Random(22)
    rows = [(i, " ".join(f"w{rng.randrange(150)}" for _ in range(rng.randrange(1, 7)))) for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    p = jaccard.Join(words=1, percent=45, local=10**9, small_block=2, pivots=2)
    sets, groups = jaccard_groups(rows, 1, 45)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.components_of(docs, p).collect()} == {i: (len(sets[i]), groups.find(i)) for i, _ in rows}


def test_common_phrases_are_no_family(spark, monkeypatch):
    """Unlike texts with a common phrase or two, which chains of phrases join into one family, aren't dealt to its cells."""
    rng = random.Random(23)
    phrases = [" ".join(f"p{k}x{j}" for j in range(4)) for k in range(10)]
    texts = [" ".join([*(f"u{rng.randrange(10**9)}" for _ in range(20)), *rng.sample(phrases, 2)]) for _ in range(300)]
    rows = list(enumerate([*texts, *(f"{t} end" for t in texts[:20])]))
    dealt, inner = [], jaccard.in_regions
    monkeypatch.setattr(jaccard, "in_regions", lambda large, *a: dealt.append(large.count()) or inner(large, *a))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in jaccard.components_of(docs, jaccard.Join(words=4, percent=85, local=10**9, small_block=16, new_block=16)).collect()}
    assert got == {i: i if i < 300 else i - 300 for i, _ in rows}
    assert dealt == [0]


def test_jaccard_odd_rows(spark, docs, odd_rows, empty):
    got = jaccard.components_of(docs).collect()
    assert len(got) == len(odd_rows)
    rows = [(i, t) for i, t, *_ in odd_rows]
    sets, groups = jaccard_groups(rows, 5, 80)
    least = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        least[groups.find(k)].append(i)
    want = Counter((i, len(sets[k]), min((x for x in least[groups.find(k)] if x is not None), default=None)) for k, (i, _) in enumerate(rows))
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == want
    kept = jaccard.keep_one(docs)
    assert set(kept.columns) == set(docs.columns)
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted({c for i, _, c in want if i is not None})
    assert jaccard.components_of(empty).count() == 0 and jaccard.keep_one(empty).count() == 0


def test_keep_one_counts_texts_not_ids(spark):
    rng = random.Random(3)
    a, b = prose(rng, 60), "B " + prose(rng, 60)
    near = a + " more"
    rows = [(5, a), (5, b), (7, near), (8, b), (8, b), (None, "n " * 9), (None, "n " * 9), (None, ""), (None, "")]
    kept = jaccard.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter(map(tuple, kept)) == Counter([(5, a), (5, b), (None, "n " * 9), (None, ""), (None, "")])


def removed(rows, window):
    seen, out = {}, []
    for i, t in rows:
        w = (t or "").encode().split()
        gone = set()
        for k in range(len(w) - window + 1):
            if seen.setdefault(tuple(w[k : k + window]), (i, k)) != (i, k):
                gone.update(range(k, k + window))
        out.append((i, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    return out


@pytest.mark.parametrize("most", [2000, 2])
def test_substrings(spark, most):
    rng = random.Random(9)
    shared = [prose(rng, n) for n in (19, 20, 21, 45, 80)]
    rows = []
    for i in range(60):
        parts = [prose(rng, rng.randrange(0, 60)) for _ in range(3)]
        rows.append((i, " ".join([parts[0], rng.choice(shared), parts[1], rng.choice(shared), parts[2]])))
    rows += [(100, "a b " * 50), (101, "x a b " * 40), (102, rows[3][1]), (103, "one two")]
    got = substrings.remove(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), substrings.Repeats(most=most)).collect()
    assert sorted(map(tuple, got)) == sorted(removed(rows, 20))


def test_substrings_odd_rows(docs, odd_rows, empty):
    got = substrings.remove(docs).collect()
    order = sorted({((-1 if i is None else i), t or "") for i, t, *_ in odd_rows})
    want = {i: tuple(x) for i, *x in removed(order, 20)}
    assert len(got) == len(odd_rows)
    assert all((r.n_words, r.n_removed, r.kept) == want[-1 if r.doc_id is None else r.doc_id] for r in got)
    assert substrings.remove(empty).count() == 0


def test_automaton():
    rng = random.Random(6)
    seqs = [[rng.randrange(3) for _ in range(rng.randrange(1, 30))] for _ in range(30)]
    automaton = substrings.Automaton()
    for k, s in enumerate(seqs):
        before = [tuple(x[i:j]) for x in seqs[:k] for i in range(len(x)) for j in range(i + 1, len(x) + 1)]
        have = set(before)
        want = [max((n for n in range(e + 2) if n == 0 or tuple(s[e + 1 - n : e + 1]) in have)) for e in range(len(s))]
        assert automaton.matches(s) == want
        automaton.add(s)


def levenshtein(a, b, room):
    """The edit distance, or more than ``room``."""
    y, at = np.frombuffer(b.encode("utf-32-le"), "u4"), np.arange(len(b) + 1)
    row = at
    for i, x in enumerate(a, 1):
        row = np.append(i, np.minimum(row[1:] + 1, row[:-1] + (y != ord(x))))
        row = np.minimum.accumulate(row - at) + at
        if row.min() > room:
            break
    return row.min() if row.min() > room else row[-1]


def near(a, b):
    """Edit similarity of 0.8 or more."""
    room = int(0.2 * max(len(a), len(b)) + 1e-9)
    return abs(len(a) - len(b)) <= room and levenshtein(a, b, room) <= room


def normal(line):
    return " ".join(x for x in regex.split(r"[^\p{L}\p{N}]+", line.lower()) if x) or re.sub(r"\s+", " ", line).strip()


def repeated_lines(rows):
    """(doc_id, line number) of all but the first line of each group, by edit similarity of all pairs alone."""
    seen = [(i, k, normal(x)) for i, t in rows for k, x in enumerate((t or "").split("\n"))]
    groups, first, gone = Groups(), set(), set()
    for a, b in combinations(sorted({n for *_, n in seen if len(n) >= 20}), 2):
        if near(a, b):
            groups.join(a, b)
    for i, k, n in seen:
        if n:
            (gone if groups.find(n) in first else first).add((i, k) if groups.find(n) in first else groups.find(n))
    return gone


@pytest.mark.parametrize("pivots,growth", [(2, 4), (1, 2)])
def test_lines(spark, pivots, growth):
    rng = random.Random(11)
    base = [" ".join(prose(rng, 14).split()) for _ in range(12)]
    rows = []
    for i in range(30):
        own = []
        for _ in range(6):
            w = rng.choice(base).split()
            if rng.random() < 0.5:
                w[rng.randrange(len(w))] = rng.choice(["changed", "W", "Öl"])
            own.append(" ".join(w).upper() if rng.random() < 0.1 else " ".join(w) + rng.choice(["", " !!"]))
        rows.append((i, "\n".join([*own, "short line", "", "short line"])))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    gone, p = repeated_lines(rows), lines.Fuzzy(pivots=pivots, growth=growth)
    assert {(r.doc_id, r.line_no) for r in lines.decisions(docs, p).collect()} == gone
    for r in lines.dedup(docs, p).collect():
        assert r.text == "\n".join(x for k, x in enumerate(rows[r.doc_id][1].split("\n")) if (r.doc_id, k) not in gone)


def test_recall_of_line_links(spark):
    """All pairs of the table's lines by edit similarity, against the groups found."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, k, normal(x)) for r in docs.orderBy("doc_id").collect() for k, x in enumerate((r.text or "").split("\n"))]
    texts = sorted({n for *_, n in rows if len(n) >= 20}, key=len)
    grams = [Counter(n[k : k + 3] for k in range(len(n) - 2)) for n in texts]
    index = defaultdict(list)
    pairs = []
    for j, own in enumerate(grams):
        # lines within d edits share all but 3 d of their 3-grams
        met = Counter()
        for g, n in own.items():
            for i, m in index[g]:
                met[i] += min(n, m)
            index[g].append((j, n))
        long = len(texts[j])
        pairs += [(texts[i], texts[j]) for i, n in met.items() if len(texts[i]) >= 0.8 * long - 1e-9 and n >= long - 2 - 3 * int(0.2 * long + 1e-9)]
    links = [(a, b) for a, b in pairs if near(a, b)]
    place = {n: (i, k) for i, k, n in reversed(rows)}
    first = {min(place[a], place[b]): max(place[a], place[b]) for a, b in links}
    gone = {(r.doc_id, r.line_no) for r in lines.decisions(docs).collect()}
    assert len(links) > 30 and sum(b in gone for b in first.values()) >= 0.95 * len(first)


def test_lines_that_leave_blanks(spark):
    rows = [(1, "alpha bravo charlie delta\necho foxtrot"), (2, "echo foxtrot\n"), (3, ""), (4, None), (5, "\n")]
    out = lines.marked(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "__l_gone", lines.left_text().alias("left")).collect()
    assert {r.doc_id: (r["__l_gone"], r.left) for r in out} == {1: (None, rows[0][1]), 2: ([0], ""), 3: (None, ""), 4: (None, None), 5: (None, "\n")}


def test_lines_long_and_repeated(spark):
    """A text of very many lines, most of them repeats, and very long lines with words left out."""
    rng = random.Random(1)
    long = prose(rng, 4000).replace("\n", " ")
    w = long.split(" ")
    rows = [(1, "\n".join(f"line {k % 50}" for k in range(5000))), (2, long), (3, " ".join(w[:1000] + w[1003:2500] + ["extra"] + w[2500:]))]
    gone = Counter(r.doc_id for r in lines.decisions(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert gone == {1: 4950, 3: 1}


def test_edits_bound_the_distance(spark):
    """The walk over words never costs less than the edit distance, and is exact for one inserted, deleted or replaced word."""
    dice = random.Random(5)
    words = ["".join(dice.choice("abcdef") for _ in range(dice.randint(1, 7))) for _ in range(40)]
    rows = []
    for _ in range(400):
        x = [dice.choice(words) for _ in range(dice.randint(1, 25))]
        y = list(x)
        for _ in range(dice.randint(0, 8)):
            at, n = dice.randint(0, len(y)), dice.randint(1, 3)
            y[at : at + n * dice.randint(0, 1)] = [dice.choice(words) for _ in range(n * dice.randint(0, 1))]
        rows.append((" ".join(x), " ".join(y), False))
    plain = [f"word{i}" for i in range(12)]
    for at in range(12):
        rows += [(" ".join(plain), " ".join(plain[:at] + new + plain[at + gone :]), True) for new, gone in ((["other"], 0), ([], 1), (["strange"], 1))]
    cost = let(F.struct(F.split("x", " ").alias("x"), F.split("y", " ").alias("y")), lambda w: lines.edits(w["x"], w["y"], 8))
    for r in spark.createDataFrame(rows, "x string, y string, one boolean").select("*", cost.alias("cost"), F.levenshtein("x", "y").alias("d")).collect():
        assert r.cost >= r.d
        assert not r.one or r.cost <= 8


def test_pairs_are_compared_once(spark, monkeypatch):
    """Unlike lines with the same rare words meet, each pair once."""
    dice = random.Random(3)
    rare = " ".join(f"extraordinarily{c}" for c in "abcde")
    rows = [(i, rare + " " + " ".join("".join(dice.choice("etaoinshr") for _ in range(7)) for _ in range(14))) for i in range(60)]
    seen, linked = [], lines.linked
    monkeypatch.setattr(lines, "linked", lambda pairs, texts, p: (seen.extend(map(tuple, pairs.select("a", "b").collect())), linked(pairs, texts, p))[1])
    assert lines.decisions(spark.createDataFrame(rows, "doc_id long, text string")).count() == 0
    assert len(seen) == len(set(seen)) == 60 * 59 // 2


def test_rounds_are_few(spark, monkeypatch):
    """Groups are made anew only when a round has found links, and the last few pairs take one round."""
    dice = random.Random(3)
    rare = " ".join(f"extraordinarily{c}" for c in "abcde")
    rows = [(i, rare + " " + " ".join("".join(dice.choice("etaoinshr") for _ in range(7)) for _ in range(14))) for i in range(60)]
    rows += [(100 + i, variant(dice, rows[0][1])) for i in range(5)]
    made, compared, groups, linked = [], [], lines.components, lines.linked
    monkeypatch.setattr(lines, "components", lambda links, label: (made.append(1), groups(links, label))[1])
    monkeypatch.setattr(lines, "linked", lambda pairs, texts, p: (compared.append(1), linked(pairs, texts, p))[1])
    gone = {r.doc_id for r in lines.decisions(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert gone == {100, 101, 102, 103, 104}
    assert len(compared) <= 3 and len(made) <= 2


def test_lines_of_unlike_lengths_never_meet(spark, monkeypatch):
    """Lines with the same rare words, each a third longer than the one before, make no pair."""
    dice = random.Random(4)
    rare = " ".join(f"extraordinarily{c}" for c in "abcde")
    rows = [(i, rare + " " + " ".join("".join(dice.choice("etaoinshr") for _ in range(7)) for _ in range(int(6 * 1.6**i)))) for i in range(8)]
    seen, linked = [], lines.linked
    monkeypatch.setattr(lines, "linked", lambda pairs, texts, p: (seen.extend(map(tuple, pairs.select("a", "b").collect())), linked(pairs, texts, p))[1])
    assert lines.decisions(spark.createDataFrame(rows, "doc_id long, text string")).count() == 0
    assert seen == []


def test_lines_odd_rows(docs, odd_rows, empty):
    out = lines.dedup(docs)
    assert out.columns == docs.columns and out.count() == len(odd_rows)
    got = {r.doc_id: r.text for r in out.collect()}
    assert got[1] is None and got[2] == "" and got[3] == " \t\n " and got[9] == "one word"
    assert got[4].strip() and not got[6].strip() == dict((i, t) for i, t, *_ in odd_rows)[6].strip()
    assert lines.dedup(docs, drop_emptied=True).filter("doc_id in (1, 2, 3)").count() == 3
    assert lines.dedup(empty).count() == 0


def variant(rng, line):
    """One word replaced by another of like length, left out, or with a typing error."""
    w = line.split(" ")
    k, how = rng.randrange(len(w)), rng.randrange(4)
    new = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in w[k])
    return " ".join(w[:k] + [[new], [new], [], [w[k][:1] + "x" + w[k][1:]]][how] + w[k + 1 :])


@pytest.mark.parametrize("words", [7, 15, 31])
def test_lines_with_one_word_changed(spark, words):
    rng = random.Random(words)
    rows = []
    for i in range(300):
        line = " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(3, 10))) for _ in range(words))
        rows += [(2 * i, line), (2 * i + 1, variant(rng, line))]
    # all pairs by edit similarity alone; random lines of different origin are far apart
    want = {b[0] for a, b in zip(rows[::2], rows[1::2], strict=True) if near(a[1], b[1])}
    assert len(want) > 280 and not any(near(rows[i][1], rows[j][1]) for i, j in zip(range(0, 600, 2), range(2, 600, 2), strict=False))
    got = {r.doc_id for r in lines.decisions(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got <= want and len(got) >= 0.95 * len(want)


def test_short_and_unspaced_lines(spark):
    wide = "今天天气很好我们一起去公园散步然后回家吃晚饭看电视睡觉明天再见"
    changed = wide.replace("公园", "商店")
    rows = [(1, "Read more\n\n----"), (2, "read more!\n\n----"), (3, wide), (4, wide), (5, changed), (6, "Read mode")]
    got = {(r.doc_id, r.line_no) for r in lines.decisions(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(2, 0), (2, 2), (4, 0), (5, 0)}


def test_language_model(spark, docs, odd_rows, empty):
    shape = hmm.Shape(states=3, words=20, rounds=2)
    rows = docs.filter("doc_id <> 15 or doc_id is null")
    counts, encoded, trained = hmm.prepare(rows, shape)
    trained = hmm.train(encoded, trained, shape)
    start, move, emit = trained.model
    out = {(r.doc_id, r.n_tokens): r for r in hmm.score(rows, shape).collect()}
    kept = [(i, t or "") for i, t, *_ in odd_rows if i != 15]
    split = lambda t: [*t.encode().lower().split(), b""]
    fold = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2
    c = Counter(w for i, t in kept if not fold(i) for w in split(t))
    total, distinct = sum(c.values()), len(c)
    alphabet = {w.encode(): k for k, w in enumerate(trained.alphabet)}
    inside = Counter(hmm.shape_class(w) for w, n in c.items() if w and w not in alphabet for _ in range(n))
    kinds = Counter(hmm.shape_class(w) for w in c if w and w not in alphabet)
    for i, t in kept:
        words, state, log = split(t), None, 0.0
        for w in words:
            if w == b"":
                e = emit[len(alphabet)]
            elif w in alphabet:
                e = emit[alphabet[w]]
            else:
                k = hmm.shape_class(w)
                e = emit[len(alphabet) + 1 + k] * (c[w] + 1) / (inside[k] + kinds[k] + 1)
            state = (start if state is None else state @ move) * e
            log += math.log10(state.sum())
            state = state / state.sum()
        r = out[i, len(words)]
        assert r.held_out == fold(i) and r.train_tokens == total and r.n_known == sum(c[w] > 0 for w in words)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 1) / (total + distinct + 1)) for w in words))
        assert r.score == pytest.approx(log, rel=1e-5)
    assert hmm.score(empty, shape).count() == 0


def test_baum_welch_raises_the_likelihood_and_counts_add_up():
    rng = np.random.default_rng(1)
    texts = [rng.integers(0, 6, rng.integers(1, 40)) for _ in range(30)]
    prior = np.full(6, 1 / 6)
    model, last = hmm.begin(prior, hmm.Shape(states=3)), -np.inf
    for _ in range(5):
        start, moves, seen, likelihood = hmm.Group(sorted(texts, key=len, reverse=True)).expected(model)
        assert start.sum() == pytest.approx(30) and seen.sum() == pytest.approx(sum(map(len, texts))) and moves.sum() == pytest.approx(sum(map(len, texts)) - 30)
        assert likelihood > last - 1e-6
        last = likelihood
        model = (start / start.sum(), moves / moves.sum(1, keepdims=True), seen / seen.sum(0))


def test_held_out_texts_score_better_than_by_counts(spark):
    r = hmm.op8_hmm_score(spark, "/root/testdata/sf0.01").filter("held_out").agg(F.sum("score").alias("own"), F.sum("base_score").alias("base")).first()
    assert r.own > r.base * 0.98


def test_url_lists(spark):
    day = lambda d: f"2024-01-{d:02d} 00:00:00"
    changes = [("bad.com", "add", day(2)), ("bad.com", "remove", day(5)), ("bad.com", "add", day(9)), ("x.bad.com", "add", day(3)), ("x.bad.com", "remove", day(3)), (None, "add", day(1)), ("late.org", "add", day(20)), ("bad.com", "add", day(2))]
    changes = spark.createDataFrame(changes, "pattern string, action string, at string").withColumn("at", F.to_timestamp("at"))
    tries = [("http://bad.com/", 1), ("http://BAD.com:80/a", 2), ("https://u@www.bad.com?q", 4), ("http://bad.com", 5), ("http://bad.com", 9), ("http://x.bad.com/", 3), ("http://notbad.com/", 3), ("http://late.org/", 19), (None, 3), ("nothing", 3), ("http://bad.com/", 2), ("http://bad.com/", 2)]
    rows = spark.createDataFrame([(k, u, day(d)) for k, (u, d) in enumerate(tries)], "k int, url string, fetched string").withColumn("fetched", F.to_timestamp("fetched")).withColumn("pattern", F.lit("clash"))
    got = {r.k: (r.blocked, r.pattern) for r in url_lists.judged(rows, changes).collect()}
    hit = {1: "bad.com", 2: "bad.com", 4: "bad.com", 5: "x.bad.com", 10: "bad.com", 11: "bad.com"}
    assert got == {k: (k in hit, hit.get(k)) for k in range(len(tries))}
    assert url_lists.judged(rows.filter("false"), changes).count() == 0
    assert url_lists.judged(rows, changes.filter("false")).filter("blocked").count() == 0


def test_pipeline(spark, docs, empty):
    import corpus_pipeline

    for start in (docs, empty):
        rows = start
        for _, stage in corpus_pipeline.STAGES[:-1]:
            rows = stage(spark, rows, "")
            assert rows.columns == docs.columns
        packed = corpus_pipeline.STAGES[-1][1](spark, rows, "")
        assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in rows.select("doc_id").distinct().collect()}
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 100


def test_url_lists_with_clashing_names_and_odd_hosts(spark):
    urls = ["http://[::1]/x", "http://Bad.com./", "http://u@[fe80::2]:80/", "http://a.bad.com:80/", "http://./", "http://good.com"]
    rows = spark.createDataFrame([(k, u) for k, u in enumerate(urls)], "k long, url string").withColumn("fetched", F.lit(5))
    rows = rows.withColumns({c: F.lit("x") for c in ("h", "t", "v", "pattern", "since", "until", "action", "at")})
    changes = spark.createDataFrame([(p, "add", 1) for p in ("bad.com", "[::1]", "[fe80::2]")], "pattern string, action string, at int")
    got = {r.k: (r.host, r.blocked, r.pattern, r.h) for r in url_lists.judged(rows, changes).collect()}
    assert got == {0: ("[::1]", True, "[::1]", "x"), 1: ("bad.com", True, "bad.com", "x"), 2: ("[fe80::2]", True, "[fe80::2]", "x"), 3: ("a.bad.com", True, "bad.com", "x"), 4: (None, False, None, "x"), 5: ("good.com", False, None, "x")}
