import math
import zlib
from collections import Counter
from itertools import combinations

import pytest
from llm_brute import LOWER, WORD
from llm_fixtures import none, odd, plain  # noqa: F401

from pyspark.sql import functions as F

from vigil.llm import lattice as A
from vigil.llm.queries import tokenizer_file

PATH = tokenizer_file(A.VOCABULARY)


def tokens(docs):
    return [(r.doc_id, WORD.findall((r.text or "").translate(LOWER)) + [A.END]) for r in docs.collect()]


def held(doc):
    return doc is not None and zlib.crc32(str(doc).encode()) % 7 == 2


def check(docs):
    rows = tokens(docs)
    counts = Counter(w for d, ws in rows if not held(d) for w in ws)
    total, distinct = sum(counts.values()), len(counts)
    got = sorted(((repr(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score)
                  for r in A.score(docs, PATH).collect()))
    want = sorted((repr(d), held(d), len(ws), sum(counts[w] > 0 for w in ws), total,
                   sum(math.log10((counts[w] + 1) / (total + 1 * (distinct + 1))) for w in ws)) for d, ws in rows)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want):
        assert g[5] == pytest.approx(w[5], rel=1e-9)
        assert math.isfinite(g[6]) and g[6] < 0


def test_whole_table(plain, odd):
    check(plain)
    check(odd)


def test_no_documents(none):
    assert A.score(none, PATH).count() == 0


def test_nothing_to_learn_from(spark):
    rows = [(d, "some words") for d in range(200) if held(d)]
    got = A.score(spark.createDataFrame(rows, "doc_id bigint, text string"), PATH).collect()
    assert all(r.held_out and r.n_known == 0 and r.train_tokens == 0 and math.isfinite(r.score) for r in got)


def logs():
    out = {p: math.log(w) for p, w in (("▁a", .1), ("▁ab", .05), ("a", .1), ("b", .2), ("ab", .02), ("ba", .07), ("▁", .1))}
    return out | {f"<0x{b:02X}>": math.log(0.001) for b in range(256)}


def all_ways(word, known):
    text = A.MARK + word
    total = 0.0
    for n in range(len(text)):
        for cuts in combinations(range(1, len(text)), n):
            parts = [text[i:j] for i, j in zip((0, *cuts), (*cuts, len(text)))]
            weight = 1.0
            for p in parts:
                if p in known:
                    weight *= math.exp(known[p])
                elif len(p) == 1:
                    weight *= math.prod(math.exp(known[f"<0x{b:02X}>"]) for b in p.encode())
                else:
                    weight = 0.0
            total += weight
    return total


def test_forward_sum_is_the_sum_over_all_segmentations():
    words = ["a", "ab", "abab", "abba", "bé", "aab", "b", "abc", "ababab"]
    for word, got in zip(words, A.Lattice(logs()).all(words)):
        assert got == pytest.approx(math.log(all_ways(word, logs())))


def test_long_words_do_not_underflow():
    value = A.Lattice(logs()).all(["ab" * 5000])[0]
    assert math.isfinite(value) and value < -1000


def test_known_text_is_likelier_than_shuffled_letters(spark, plain):
    texts = [r.text for r in plain.limit(60).collect() if r.text]
    rows = [(i, t) for i, t in enumerate(texts)] + [(1000 + i, " ".join(w[::-1] for w in t.split())) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r.score for r in A.score(docs, PATH, F.col("doc_id") >= 1000).collect()}
    assert all(got[i] > got[1000 + i] for i, t in enumerate(texts) if len(t) > 200)
