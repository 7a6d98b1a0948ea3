"""Spelling variants against all pairs of words, letter by letter."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from llm_brute import LOWER, texts
from llm_fixtures import none, odd, plain  # noqa: F401
from pyspark.sql import functions as F

from vigil.llm import spelling as S

DOCS = "doc_id bigint, text string"


def counted(rows):
    held = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{doc}:{run}".encode())
            if doc is not None and h % 97 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
            held[run] += 1
    return {w: n for w, n in held.items() if len(w) >= 5 and n >= 3}


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def plainly(words):
    by_length, out = {}, {}
    for w in words:
        by_length.setdefault(len(w), []).append(w)
    for w, n in words.items():
        others = [v for k in (-1, 0, 1) for v in by_length.get(len(w) + k, []) if near(w, v)]
        best = min(others, key=lambda v: (-words[v], v), default=None)
        out[w] = [best if best and words[best] >= 2 * n else None, n, len(others)]
    for w, row in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        row += [root, words[row[0]] if row[0] else None]
    return sorted((w, form or "", root, n, n_near, form_n or 0) for w, (form, n, n_near, root, form_n) in out.items())


def check(docs, want=None):
    got = sorted((r.word, r.form or "", r.root, r.n, r.n_near, r.form_n or 0) for r in S.variants(docs).collect())
    assert got == plainly(counted(texts(docs)))
    return got


def test_tables(plain, odd, none):
    assert len(check(plain)) > 500
    check(odd)
    check(none)


def made_up(seed, words=400, rows=60):
    """Documents of words with edits of all kinds, chains of forms, anagrams and letters beyond a-z."""
    rnd = random.Random(seed)
    letters = "abcdeéßÿ×"
    base = ["".join(rnd.choice(letters) for _ in range(rnd.randrange(3, 12))) for _ in range(words // 4)]
    for w in list(base):
        for _ in range(3):
            k = rnd.randrange(len(w))
            w = rnd.choice([w[:k] + w[k + 1:], w[:k] + rnd.choice(letters) + w[k:], w[:k] + rnd.choice(letters) + w[k + 1:], "".join(rnd.sample(w, len(w)))])
            base.append(w or "a")
    weights = [2.0 ** -rnd.randrange(8) for _ in base]
    text = [" ".join(w.upper() if rnd.random() < 0.1 else w for w in rnd.choices(base, weights, k=200)) for _ in range(rows)]
    return [(rnd.randrange(1 << 40), t) for t in text]


def test_edits(spark):
    got = check(spark.createDataFrame(made_up(1), DOCS))
    assert any(r[1] for r in got) and any(r[1] and r[2] != r[1] for r in got)


@pytest.mark.parametrize("block, fit", [(20, 1000), (20, 3), (5, 50)])
def test_cut_into_blocks(spark, monkeypatch, block, fit):
    """Lengths cut by a fitted tree, trees fitted on almost nothing, and blocks cut into slices."""
    monkeypatch.setattr(S, "BLOCK", block)
    monkeypatch.setattr(S, "FIT_WORDS", fit)
    check(spark.createDataFrame(made_up(2), DOCS))


def test_anagrams_fill_a_block(spark, monkeypatch):
    """Words with the same letter counts cannot be cut by them: slices take them."""
    monkeypatch.setattr(S, "BLOCK", 10)
    rnd = random.Random(3)
    words = {"".join(rnd.sample("aabbccd", 7)) for _ in range(150)}
    check(spark.createDataFrame([(1, " ".join(w for w in words for _ in range(rnd.randrange(3, 9))))], DOCS))


def test_a_run_that_loses_a_letter(spark):
    doc = next(d for d in range(1000) if zlib.crc32(f"{d}:éclair".encode()) % 97 == 0)
    at = zlib.crc32(f"{doc}:éclair".encode()) % 6
    less = "éclair"[:at] + "éclair"[at + 1:]
    docs = spark.createDataFrame([(doc, "éCLAIR éclair éclair")] + [(doc + 1, "éclair " * 9)], DOCS)
    got = {r.word: r for r in S.variants(docs).collect()}
    assert got[less].n == 3 and got[less].form == "éclair" and got["éclair"].n == 9


def test_ties_and_chains(spark):
    text = "aaaab " * 4 + "aaaac " * 8 + "aaaad " * 8 + "aaaade " * 16 + "xaaaade " * 40
    got = {r.word: (r.form, r.root, r.n_near, r.form_n) for r in S.variants(spark.createDataFrame([(None, text)], DOCS)).collect()}
    assert got == {"aaaab": ("aaaac", "aaaac", 2, 8), "aaaac": (None, "aaaac", 2, None), "aaaad": ("aaaade", "xaaaade", 3, 16),
                   "aaaade": ("xaaaade", "xaaaade", 2, 40), "xaaaade": (None, "xaaaade", 1, None)}


def test_very_long_words(spark, monkeypatch):
    monkeypatch.setattr(S, "BLOCK_CHARACTERS", 9_000)
    long = "ab" * 2000
    text = f"{long} " * 3 + f"{long}a " * 6 + f"{long[1:]} " * 9 + f"{long}ac " * 3
    check(spark.createDataFrame([(1, text), (2, "z" * 3000 + " zzzzzz" * 5)], DOCS))


def test_boxes_keep_all_within_reach():
    rng = np.random.default_rng(4)
    counts = rng.integers(0, 4, (3000, S.DIMENSIONS)).astype(np.uint8) * (rng.random((3000, S.DIMENSIONS)) < 0.15).astype(np.uint8)
    loose = S.Tree(counts[:200], leaf=1, tight=False, levels=5)
    tight = S.Tree(counts)
    for tree in (tight, loose):
        home = tree.home(counts) if tree is loose else None
        query, leaf = tree.within(counts[:300], 2)
        seen = set()
        for q, n in zip(query, leaf):
            rows = tree.order[slice(*tree.rows[n])] if tree is tight else np.flatnonzero(home == n)
            seen |= {(int(q), int(m)) for m in rows}
        for q in range(300):
            distance = np.abs(counts.astype(int) - counts[q].astype(int)).sum(1)
            assert {(q, int(m)) for m in np.flatnonzero(distance <= 2)} <= seen
    assert len(seen) and len(tight.within(counts[:300], 2)[0]) < 300 * len(tight.leaves) / 3


def test_clashing_columns(spark):
    docs = spark.createDataFrame(made_up(5, 80, 10), DOCS)
    more = docs.select("*", *[F.lit(1).alias(c) for c in ("word", "n", "length", "leaf", "role", "slice", "root", "form")])
    assert sorted(map(tuple, S.variants(more).collect()), key=repr) == sorted(map(tuple, S.variants(docs).collect()), key=repr)
