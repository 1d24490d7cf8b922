"""The whole pipeline on a small table against its five stages in plain Python."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

from captionforge.llm import secrets
from tests.llm.conftest import SCHEMA
from tests.llm.test_corpus_operators import jaccard_groups, repeated_lines, variant

WORD = re.compile("[^\x20\x09-\x0d]+")
ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def line(rng, words):
    return " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(3, 10))) for _ in range(words))


def corpus(rng):
    """Some 60 documents: good, short and repetitive ones, shared and near lines, near copies, live and copied secrets."""
    plate, notice = line(rng, 14), line(rng, 9)
    bodies = [[line(rng, rng.randrange(9, 16)) for _ in range(6)] for _ in range(24)]
    texts = [list(b) for b in bodies]
    texts += [[*b[:2], plate, *b[2:]] for b in bodies[:3]] + [[variant(rng, plate), *(line(rng, 12) for _ in range(5))] for _ in range(3)]
    texts += [[notice, *(line(rng, 13) for _ in range(5))] for _ in range(4)]
    for _ in range(2):  # near copies whose lines break elsewhere, so that they are alike by shingles alone
        words = line(rng, 150).split(" ")
        for k, wide in enumerate((11, 17, 26)):
            words[20 * k] = "changed"
            texts.append([" ".join(words[a : a + wide]) for a in range(0, 150, wide)])
    texts += [[line(rng, 10)], ["spam spam eggs " * 40], [""]]
    copied = "Xy9Kd03jfLs82hGq1ZpW"
    for k in range(6):
        texts.append([*(line(rng, 12) for _ in range(5)), f"set {copied} now {line(rng, 3)}", f'{line(rng, 3)} password = "hunter{k}22"', f"{line(rng, 2)} own{k}A7bQ9zK3mW5xT1vR8 {'0123456789abcdef' * 2}{k}"])
    rows = [(3 * i, "\n".join(t), f"l{i % 5}", f"s{i % 6}", None) for i, t in enumerate(texts)]
    return [*rows, (1000, None, "l0", None, None)]


def good(rows):
    for r in rows:
        words = WORD.findall(r[1] or "")
        grams = Counter(zip(words, words[1:], words[2:], strict=False))
        twice = {i + j for i, g in enumerate(zip(words, words[1:], words[2:], strict=False)) if grams[g] > 1 for j in range(3)}
        if not (len(words) < 50 or 100 * len(twice) > 50 * len(words)):
            yield r


def fresh(rows):
    gone = repeated_lines([r[:2] for r in rows])
    for i, text, *rest in rows:
        left = "\n".join(x for k, x in enumerate(text.split("\n")) if (i, k) not in gone)
        if left == text or left.strip():
            yield (i, left, *rest)


def distinct(rows):
    _, groups = jaccard_groups([r[:2] for r in rows], 5, 80)
    return [r for k, r in enumerate(rows) if groups.find(k) == k]


def candidates(text):
    base = [(m.start(), 0, m.end(), m[1]) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    base += [(m.start(), 1, m.end(), m[0]) for m in re.finditer("AKIA[A-Z0-9]{16,}", text)] + [(m.start(), 2, m.end(), m[0]) for m in re.finditer("[0-9a-f]{24,}", text)]
    for m in re.finditer("[A-Za-z0-9+/_=-]{20,}", text):
        if len(re.findall("[0-9]", m[0])) > 1 and len(re.findall("[A-Za-z]", m[0])) > 1 and len(set(m[0])) >= 10 and not any(a < m.end() and m.start() < b for a, k, b, _ in base if k < 3):
            base.append((m.start(), 3, m.end(), m[0]))
    return sorted(base)


def safe(rows):
    holders = defaultdict(set)
    for i, text, _, source, _ in rows:
        for *_, value in candidates(text):
            holders[value].add((source or "", i))
    example = {v for v, h in holders.items() if len({s for s, _ in h}) > 2 and len(h) >= 5 or len(h) > 100}
    for i, text, *rest in rows:
        out, at = "", 0
        for _, _, end, value in candidates(text):
            if value not in example and end - len(value) >= at:
                out += text[at : end - len(value)] + secrets.MARK
                at = end
        yield (i, out + text[at:], *rest)


def test_whole_pipeline(spark, tmp_path):
    import corpus_pipeline

    rows = corpus(random.Random(21))
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    want, steps = rows, []
    for stage in (good, fresh, distinct, safe):
        want = list(stage(want))
        steps.append(len(want))
    assert len(rows) > steps[0] > steps[1] > steps[2] and len({t for _, t, *_ in want if secrets.MARK in t}) >= 6  # each stage has something to do
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for (name, stage), reference in zip(corpus_pipeline.STAGES[:-1], (good, fresh, distinct, safe), strict=True):
        rows = list(reference(rows))
        docs = stage(spark, docs, str(tmp_path))
        assert {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()} == {r[0]: r[1] for r in rows}, name
    tokenizer = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    ids = {i: np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 1], "<u4") for i, t, *_ in want}
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    held = defaultdict(list)
    for p in pieces:
        held[p.doc_id].append((p.start, p.length))
        assert p.doc_tokens == len(ids[p.doc_id]) and p.ids_crc32 == zlib.crc32(ids[p.doc_id][p.start : p.start + p.length].tobytes())
    assert held.keys() == ids.keys()
    assert all(sum(n for _, n in sorted(own)) == len(ids[i]) and [a for a, _ in sorted(own)] == [sum(n for _, n in sorted(own)[:k]) for k in range(len(own))] for i, own in held.items())
    filled = Counter()
    for p in pieces:
        filled[p.sequence_id] += p.length
    assert max(filled.values()) <= 2048 and sum(n < 2048 for n in filled.values()) <= 1
