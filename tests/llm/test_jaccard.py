"""The n-gram join against all pairs, and its filters one by one."""

import random

import numpy as np
import pytest
from llm_brute import LOWER, WORD, texts
from llm_fixtures import none, odd, plain  # noqa: F401
from pyspark.sql import functions as F

from vigil.llm import jaccard as J


def shingles(text, size):
    words = WORD.findall(text.translate(LOWER))
    return {tuple(words[k:k + size]) for k in range(max(1, len(words) - size + 1))} if words else set()


def plainly(rows, size, least):
    """(doc_id, set size, smallest doc_id reachable) over all pairs."""
    sets, parent = [shingles(t, size) for _, t in rows], list(range(len(rows)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and least[1] * len(sets[i] & sets[j]) >= least[0] * len(sets[i] | sets[j]):
                parent[top(i)] = top(j)
    first = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            first[top(i)] = min(doc, first.get(top(i), doc))
    return [(doc, len(sets[i]), first.get(top(i))) for i, (doc, _) in enumerate(rows)]


def check(docs, size=3, least=(9, 10)):
    got = J.join(docs, size, least).select("doc_id", "n_shingles", "component_id").collect()
    want = plainly(texts(docs), size, least)
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    return want


def test_tables(plain, odd, none):
    assert len({c for _, _, c in check(plain)}) < plain.count()
    check(odd)
    check(none)


def changed_copies(seed, groups=40):
    rnd, rows = random.Random(seed), []
    passage = [f"p{i}" for i in range(40)]
    for _ in range(groups):
        text = [f"w{rnd.randrange(5000)}" for _ in range(rnd.randrange(5, 400))] + passage[:rnd.choice([0, 40])]
        for _ in range(rnd.randrange(1, 5)):
            rows.append((rnd.randrange(1 << 40), " ".join(text)))
            for _ in range(rnd.choice([0, 1, 2, 3, 5, 7, 10])):
                text[rnd.randrange(len(text))] = f"x{rnd.random()}"
    return rows


@pytest.mark.parametrize("size, least", [(3, (9, 10)), (1, (1, 2)), (5, (4, 5))])
def test_changed_copies(spark, size, least):
    want = check(spark.createDataFrame(changed_copies(size), "doc_id bigint, text string"), size, least)
    assert 40 <= len({c for _, _, c in want}) < len(want)


def test_at_the_limit(spark):
    """Sets of 9 and 10 n-grams that share 9 reach nine tenths; of 19 and 19 that share 18 they do (18/20); 8 of 9 do not."""
    words = [f"w{i}" for i in range(40)]
    rows = [(5, " ".join(words[:11])), (4, " ".join(words[:12])), (3, "a " + " ".join(words[20:30])), (2, " ".join(words[20:30])),
            (1, "one two"), (0, "One TWO"), (9, "two one")]
    got = {r.doc_id: r.component_id for r in J.join(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {5: 4, 4: 4, 3: 3, 2: 2, 1: 0, 0: 0, 9: 9}


def test_group_without_its_pairs(spark):
    """A group of similar texts is joined through its ends: far fewer pairs are compared than it has."""
    rnd, base = random.Random(1), [f"w{i}" for i in range(300)]
    rows = []
    for k in range(400):
        text = list(base)
        text[rnd.randrange(300)] = f"x{k}"
        rows.append((k, " ".join(text)))
    seen, whole = [], J._similar

    def counted(pairs, *rest):
        seen.append(pairs.count())
        return whole(pairs, *rest)
    J._similar = counted
    try:
        got = J.join(spark.createDataFrame(rows, "doc_id bigint, text string")).select("component_id").distinct().collect()
    finally:
        J._similar = whole
    assert [r.component_id for r in got] == [0] and sum(seen) < 400 * 399 / 2 / 5


def copies_around_one(n=500, words=150):
    """A text in the middle of copies of it; the first and last of them are changed most and like no other."""
    rnd, base = random.Random(4), [f"w{i}" for i in range(words)]
    rows = []
    for k in range(n):
        text = list(base)
        for m in rnd.sample(range(words), 0 if k == n // 2 else rnd.randrange(1, 4) if 60 <= k < n - 60 else 4):
            text[m] = f"x{k}y{m}"
        rows.append((k, " ".join(text)))
    return rows


def test_copies_meet_through_the_most_alike(spark, monkeypatch):
    seen, whole = [], J._similar

    def counted(pairs, *rest):
        seen.append(pairs.count())
        return whole(pairs, *rest)
    monkeypatch.setattr(J, "_similar", counted)
    rows = copies_around_one()
    got = J.join(spark.createDataFrame(rows, "doc_id bigint, text string"), 5, (4, 5)).collect()
    assert sorted(map(tuple, got)) == sorted(plainly(rows, 5, (4, 5)))
    assert sum(seen) < 20 * len(rows)


def test_positional_filter_counts_shared_members(spark):
    """No similar pair is dropped; one whose shared members leave too little behind them is, however early they begin."""
    rnd, rows = random.Random(5), []
    for k in range(300):
        x = sorted(rnd.sample(range(10_000), rnd.randrange(2, 60)))
        y = sorted({*rnd.sample(x, rnd.randrange(len(x) * 7 // 10, len(x) + 1)), *rnd.sample(range(10_000), rnd.randrange(4))})
        if y:
            rows.append((k, x, y))
    first = lambda s: s[:J.prefix_length(len(s), (4, 5))]
    table = spark.createDataFrame([(k, first(x), first(y), len(x), len(y)) for k, x, y in rows],
                                  "k int, prefix_a array<bigint>, prefix_b array<bigint>, n_a int, n_b int")
    kept = {r.k for r in table.where(J._positional((4, 5))).collect()}
    alike = {k for k, x, y in rows if 5 * len({*x} & {*y}) >= 4 * len({*x} | {*y})}
    assert alike <= kept and 10 < len(alike) and len(kept) < len(rows)
    # the first members agree, but the next shared one leaves five: 2 + 5 of 10 and 10 are too few
    one = spark.createDataFrame([([1, 5, 9], [1, 2, 3, 4, 9], 10, 10)], "prefix_a array<bigint>, prefix_b array<bigint>, n_a int, n_b int")
    assert one.where(J._positional((4, 5))).count() == 0


def test_filters_keep_every_similar_pair():
    rnd = random.Random(2)
    for _ in range(200):
        x = {rnd.getrandbits(64) for _ in range(rnd.randrange(1, 60))}
        y = set(rnd.sample(sorted(x), rnd.randrange(max(1, len(x) * 8 // 10), len(x) + 1))) | {rnd.getrandbits(64) for _ in range(rnd.randrange(3))}
        if 10 * len(x & y) >= 9 * len(x | y):
            a, b = (np.array(sorted(s), np.uint64) for s in (x, y))
            assert 19 * int(np.minimum(J.ranges_of(a), J.ranges_of(b)).sum()) >= 9 * (len(x) + len(y))
            first = [set(sorted(s)[:J.prefix_length(len(s), (9, 10))]) for s in (x, y)]
            assert first[0] & first[1]


def test_ranges_of_large_sets(spark):
    """Bounds over ranges hold between sets with different numbers of ranges, and are close for large sets."""
    rnd, rows = random.Random(6), []
    for n in (40, 900, 1100, 2000, 2100, 5000):
        for m, share in ((n, 0.0), (n, 0.95), (n + n // 9, 0.9), (3 * n, 0.2)):
            x = [rnd.getrandbits(64) for _ in range(n)]
            y = {*x[:int(share * n)], *(rnd.getrandbits(64) for _ in range(m - int(share * n)))}
            a, b = (np.array(sorted(s), np.uint64) for s in (x, y))
            rows.append((len({*x} & y), n, len(y), share, J.ranges_of(a).tolist(), J.ranges_of(b).tolist()))
    assert any(len(r[4]) != len(r[5]) for r in rows)
    table = spark.createDataFrame(rows, "shared int, n int, m int, share double, r_a array<int>, r_b array<int>")
    got = table.select("*", J._most_shared().alias("most")).collect()
    assert len(got) == len(rows) and all(r.shared <= r.most <= r.n for r in got)
    assert all(5 * r.most < 4 * (r.n + r.m - r.most) for r in got if not r.share)


def test_unlike_long_texts_are_not_made(spark, monkeypatch):
    """Long texts that meet but share three tenths are told apart by their ranges."""
    rnd, made, keyed = random.Random(7), [], J.keyed_sets
    common = [f"c{i}" for i in range(900)]
    rows = [(k, " ".join([*common, *(f"w{k}x{rnd.getrandbits(40)}" for _ in range(2100))])) for k in range(6)]
    rows += [(6, f"{rows[0][1]} more"), (7, f"{rows[0][1]} and more")]

    def counted(docs, shingle):
        made.append(docs.count())
        return keyed(docs, shingle)
    monkeypatch.setattr(J, "keyed_sets", counted)
    counts = np.ones(J.BUCKETS, np.int64)
    counts[(J.shingle_set(" ".join(common), 5) & np.uint64(J.BUCKETS - 1)).astype(np.int64)] = 0       # what they share stands first
    monkeypatch.setattr(J, "bucket_counts", lambda *rest: counts)
    got = J.join(spark.createDataFrame(rows, "doc_id bigint, text string"), 5, (4, 5)).collect()
    assert {r.doc_id: r.component_id for r in got} == {k: 0 if k > 5 else k for k in range(8)}
    assert sum(made) <= 3


def test_hashes_of_pieces(monkeypatch):
    text = " ".join(f"W{i} \x0b\x1cé\x85" for i in range(500)) + "x" * 300
    whole = J.shingle_set(text)
    assert len(whole) == len(shingles(text, 3))
    monkeypatch.setattr(J, "PIECE", 50)
    assert (J.shingle_set(text) == whole).all()


def test_counts_are_of_all_documents(spark, plain):
    counts = J.bucket_counts(plain.repartition(5), 3, 1 << 12)
    assert counts.sum() == sum(len(shingles(t, 3)) for _, t in texts(plain))


def test_keep_one(spark, odd):
    kept = J.keep_one(odd)
    assert kept.columns == odd.columns
    want = {d for d, _, c in plainly(texts(odd), 3, (9, 10)) if d == c}
    assert sorted(map(repr, [r.doc_id for r in kept.select("doc_id").collect()])) == sorted(map(repr, want))


def test_clashing_columns(spark, odd):
    names = ["row", "digest", "n", "prefix", "node", "key", "_shown", "component_id"]
    docs = odd.select("doc_id", "text", *[F.lit(1).alias(c) for c in names])
    assert sorted(map(repr, J.join(docs).collect())) == sorted(map(repr, J.join(odd).collect()))
