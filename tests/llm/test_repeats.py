"""Substring dedup: every window against a plain table of windows."""

import random

import numpy as np
import pytest
from llm_fixtures import none, odd, plain  # noqa: F401
from llm_brute import texts

from vigil.llm import recompression as R


def replay(rows, window):
    first = {}
    split = [(doc, text.encode().split()) for doc, text in rows]
    for doc, words in split:
        for p in range(len(words) - window + 1):
            if doc is not None:
                key = tuple(words[p:p + window])
                first[key] = min(doc, first.get(key, doc))
    out = []
    for doc, words in split:
        gone = set()
        for p in range(len(words) - window + 1):
            if doc is not None and first[tuple(words[p:p + window])] < doc:
                gone.update(range(p, p + window))
        out.append((doc, len(words), len(gone), b" ".join(w for i, w in enumerate(words) if i not in gone).decode()))
    return sorted(out, key=repr)


def found(docs, window):
    out = []
    whole = {}
    for doc, text in texts(docs):
        whole.setdefault(doc, " ".join(text.encode().decode().split(" ")))
    for r in R.repeats(docs, window).collect():
        kept = r.kept if r.kept is not None else "" if r.n_removed else None
        out.append((r.doc_id, r.n_words, r.n_removed, kept, bytes(r.digest)))
    return sorted(out, key=repr)


def check(docs, window=R.WINDOW):
    import hashlib
    want = replay(texts(docs), window)
    got = found(docs, window)
    assert [(r[0], r[1], r[2]) for r in got] == [(r[0], r[1], r[2]) for r in want]
    for g, w in zip(got, want):
        if g[2] == 0:
            assert g[4] == hashlib.sha256(w[3].encode()).digest()
        else:
            assert g[3] == w[3]


def test_whole_table(plain):
    check(plain)


def test_odd_rows(odd):
    check(odd)


def test_empty(none):
    assert R.repeats(none).count() == 0


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_short_alphabet(spark, seed):
    """Runs, periods and shared passages at every offset."""
    rnd = random.Random(seed)
    passages = [[rnd.choice("ab") for _ in range(rnd.randrange(20, 60))] for _ in range(3)] + [["a"] * 40, ["a", "b"] * 30]
    rows = []
    for i in range(60):
        words = []
        while len(words) < rnd.randrange(10, 200):
            words += rnd.choice(passages) if rnd.random() < 0.5 else [rnd.choice("abcdefgh") for _ in range(rnd.randrange(1, 40))]
        rows.append((i, " ".join(words)))
    check(spark.createDataFrame(rows, "doc_id bigint, text string"), 12)
    check(spark.createDataFrame(rows, "doc_id bigint, text string"), 50)


def test_symbols_follow_from_their_words():
    """A symbol stands wherever the words that decide it stand, whatever is around them."""
    rng = np.random.default_rng(7)
    for _ in range(30):
        words = rng.integers(0, 6, 120).astype(np.uint64)
        a = R.Parse(words, np.array([120]))
        around = [rng.integers(0, 6, 30).astype(np.uint64) for _ in range(2)]
        other = np.concatenate([around[0], words[20:90], around[1]])
        b = R.Parse(other, np.array([len(other)]))
        for (n1, l1, h1), (n2, l2, h2) in zip(a.levels, b.levels):
            inside = {(int(n), int(l) - 20 + 30, int(h) - 20 + 30) for n, l, h in zip(n1, l1, h1) if l >= 20 and h <= 90}
            assert inside <= {(int(n), int(l), int(h)) for n, l, h in zip(n2, l2, h2)}


def test_every_window_holds_a_symbol():
    rng = np.random.default_rng(3)
    lengths = np.array([0, 49, 50, 51, 400, 1, 3000])
    words = rng.zipf(1.3, lengths.sum()).astype(np.uint64)
    words[120:260] = 9
    cover = np.zeros(len(words) + 1, int)
    levels = R.Parse(words, lengths).reveal(lengths)
    for _, begin, end, _ in levels:
        np.add.at(cover, begin, 1)
        np.add.at(cover, end, -1)
    assert (np.cumsum(cover)[:-1][levels[0][3]] > 0).all()
    assert levels[0][3].sum() == sum(max(0, n - 49) for n in lengths)
