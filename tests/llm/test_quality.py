import random

from llm_fixtures import none, odd, plain  # noqa: F401
from llm_brute import base_counts, texts
from pyspark.sql import functions as F

from vigil.llm import quality as Q

BASE = [*Q.BASE, "base_failed"]


def check(docs):
    want = sorted((repr(d), *base_counts(t)) for d, t in texts(docs))
    got = sorted((repr(r["doc_id"]), *(r[c] for c in BASE)) for r in Q.judge(docs, []).select("doc_id", *BASE).collect())
    assert got == want


def test_counts(plain, odd, none):
    check(plain)
    check(odd)
    check(none)


def test_repeats_of_a_small_alphabet(spark):
    rnd = random.Random(5)
    rows = [(i, " ".join(rnd.choice("abc") for _ in range(rnd.randrange(0, 60)))) for i in range(200)]
    check(spark.createDataFrame(rows, "doc_id bigint, text string"))


def sample(n, seed):
    rnd, rows = random.Random(seed), []
    for _ in range(n):
        row = {f: rnd.random() for f in Q.FEATURES}
        row["bad"] = int(row["symbol_share"] > 0.7 or (row["upper_share"] > 0.6 and row["line_words"] <= 0.3))
        rows.append(row)
    return rows


def test_rules_find_what_made_the_labels():
    rules = Q.learn(sample(3000, 1))
    assert 1 <= len(rules) <= Q.MOST_RULES

    def bad(row):
        return any(all(c.holds(row) for c in rule) for rule in rules)
    fresh = sample(2000, 2)
    assert sum(bad(r) == bool(r["bad"]) for r in fresh) > 0.95 * len(fresh)
    assert Q.learn([]) == [] and Q.learn([dict(r, bad=0) for r in sample(50, 3)]) == []


def test_expression_is_the_rules(spark):
    rules = Q.learn(sample(1000, 1))
    rows = sample(300, 4)
    frame = spark.createDataFrame([(i, *(r[f] for f in Q.FEATURES)) for i, r in enumerate(rows)],
                                  "i int, " + ", ".join(f"{f} double" for f in Q.FEATURES))
    got = {r.i: r.kept for r in frame.select("i", Q.verdict(rules).alias("kept")).collect()}
    assert got == {i: not any(all(c.holds(r) for c in rule) for rule in rules) for i, r in enumerate(rows)}


def test_held_out_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    teach, ask = (labels.where(F.col("doc_id") % 2 == k) for k in (0, 1))
    judged = Q.judge(docs, Q.fit(docs, teach)).where(~F.col("base_failed")).join(ask.select("doc_id", "quality"), "doc_id")
    right, n = judged.agg(F.count(F.when(F.col("kept") == (F.col("quality") == 1), 1)), F.count("*")).first()
    assert right > 0.95 * n


def test_no_labels_and_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, None), (None, 1), (2, 0), (2, 0)], "doc_id bigint, quality int")
    assert Q.fit(odd, labels) == [] and Q.fit(none, labels.limit(0)) == []
    assert Q.kept_rows(odd, []).columns == odd.columns
