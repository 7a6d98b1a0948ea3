import math
import random

import pytest
from pyspark.sql import functions as F

from vigil.llm import topk as T

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def replay(rows, every, k):
    whole = []
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            whole.append((i, [math.floor(256 * x) for x in v]))
    out = []
    for q in sorted({i for i, _ in whole if i % every == 0}):
        vector = min(v for i, v in whole if i == q)
        best = sorted((-sum(a * b for a, b in zip(vector, v)), i) for i, v in whole if i != q)[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return out


def check(spark, rows, every=50, k=5, **options):
    frame = spark.createDataFrame([(i, v, 1) for i, v in rows], SCHEMA).withColumn("score", F.lit("x")).withColumn("v", F.lit(1))
    got = T.search(frame, F.col("vec_id") % every == 0, k, **options).orderBy("query_id", "rank")
    assert [tuple(r) for r in got.collect()] == replay([(r.vec_id, r.embedding) for r in frame.collect()], every, k)


@pytest.mark.parametrize("size", [(512, 64, 4), (7, 3, 1), (20, 5, 2)])
def test_against_all_pairs(spark, size):
    rnd = random.Random(size[0])
    rows = [(i, [rnd.gauss(0, 1) + (i % 5) for _ in range(8)]) for i in range(300)]
    rows += [(i, [1.0] * 8) for i in range(300, 340)]                     # ties
    check(spark, rows, 10, 5, block_rows=size[0], query_rows=size[1], first_blocks=size[2])


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (50, [0.5]), (100, []), (1, [None, 1.0]), (2, [nan, 1.0]), (3, [inf, 1.0]), (4, None),
            (None, [1.0, 1.0]), (5, [-3.0, 4.0, 9.0]), (6, [1e9, -1e9]), (7, [1.0, 2.0]), (7, [1.0, 2.0])]
    check(spark, rows)
    check(spark, rows[:1])
    check(spark, [])
    check(spark, [(1, [1.0])])


def test_blocks_that_cannot_win_are_left_out(spark):
    rows = [(i, [float(i // 100 == 9), 0.01]) for i in range(1000)]
    check(spark, rows, 901, 5, block_rows=100, first_blocks=1)
