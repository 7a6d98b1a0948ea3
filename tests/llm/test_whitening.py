"""Whitening against numpy over all rows at once."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from vigil.llm import whitening as W

ROWS = "vec_id bigint, embedding array<float>, label int"


def plainly(rows):
    """{(vec_id, component): (n, deviation, whitened, explained)}; rows of equal ids as a list."""
    used = [(i, [math.floor(256 * float(np.float32(c))) for c in v]) for i, v in rows
            if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in used})
    n, x = len(fit), np.array(fit, float)
    sums = [sum(c) for c in zip(*fit)]
    values, vectors = np.linalg.eigh(np.cov(x.T, bias=True))
    values, vectors = values[::-1], vectors[:, ::-1]
    out = []
    for i, v in used:
        deviation = sum((n * a - s) ** 2 for a, s in zip(v, sums))
        centred = np.array([a - s / n for a, s in zip(v, sums)])
        for c in range(4):
            out.append((i, c + 1, n, deviation, float(centred @ vectors[:, c] / math.sqrt(values[c])), float(values[c] / values.sum())))
    return out


def check(frame):
    got = [tuple(r) for r in W.whiten(frame).collect()]
    want = plainly([(r.vec_id, r.embedding) for r in frame.collect()])
    assert len(got) == len(want)
    order = lambda r: (r[0] is None, r[0] or 0, r[1], r[3])          # noqa: E731
    got, want = sorted(got, key=order), sorted(want, key=order)
    for c in range(1, 5):
        a, b = [r for r in got if r[1] == c], [r for r in want if r[1] == c]
        assert [(r[0], r[2], int(r[3])) for r in a] == [r[:1] + r[2:4] for r in b]
        x, y = np.array([r[4] for r in a]), np.array([r[4] for r in b])
        assert min(np.abs(x - y).max(), np.abs(x + y).max()) < 1e-6
        assert np.allclose([r[5] for r in a], [r[5] for r in b], rtol=1e-9)
    assert {r[6] for r in got} == {got[0][6]} and 0 <= got[0][6] < 1e-9
    return got


@pytest.fixture
def vectors(spark):
    return spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")


def test_whole_table(vectors):
    check(vectors)


@pytest.mark.parametrize("rows, blocks", [(7, 3), (64, 1)])
def test_many_blocks(vectors, monkeypatch, rows, blocks):
    """Partial scatters over a grid of several block columns, with blocks that are not full."""
    monkeypatch.setattr(W, "ROWS", rows)
    monkeypatch.setattr(W, "BLOCKS", blocks)
    check(vectors.repartition(5))


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rng = np.random.default_rng(0)
    rows = [(i, [float(c) for c in rng.normal(size=6)], 0) for i in range(40)]
    rows += [(3, rows[3][1], 1), (None, rows[4][1], 1), (None, rows[5][1], None)] + [(77, rows[6][1], 1)] * 30
    rows += [(50, None, 1), (51, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (52, [nan] * 6, 1), (53, [inf] + [0.0] * 5, 1), (54, [0.0, -inf] + [0.0] * 4, 1)]
    rows += [(60, [-0.0, 0.0, -1e-9, 90.0, -70.0, 0.5], 1)]
    frame = spark.createDataFrame(rows, ROWS).select("*", *[F.lit(1).alias(c) for c in ("x", "id", "i", "block", "component", "n")])
    got = check(frame)
    assert not {50, 51, 52, 53, 54} & {r[0] for r in got}
    assert sum(r[0] == 77 for r in got) == 30 * 4 and sum(r[0] is None for r in got) == 2 * 4


def test_nothing_to_whiten(spark):
    for rows in ([], [(1, None, 1)], [(1, [1.0, 2.0], 1)] * 3, [(1, [], 1)]):
        out = W.whiten(spark.createDataFrame(rows, ROWS))
        assert out.count() == 0 and out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    two = W.whiten(spark.createDataFrame([(1, [1.0, 2.0], 1), (2, [3.0, 2.0], 1)], ROWS)).collect()
    assert [(r.vec_id, r.component, abs(round(r.whitened, 9)), r.explained) for r in sorted(two)] == [(1, 1, 1.0, 1.0), (2, 1, 1.0, 1.0)]


def test_deviation_beyond_a_long(spark):
    rows = [(i, [float(1 << 40) * i, 1.0], 0) for i in range(5)]
    got = {r.vec_id: int(r.deviation) for r in W.whiten(spark.createDataFrame(rows, ROWS)).collect()}
    assert got == {i: ((5 * i - 10) * 256 << 40) ** 2 for i in range(5)}


def test_errors(spark):
    with pytest.raises(ValueError):
        W.whiten(spark.createDataFrame([(1, [1.0], 1), (2, [1.0, 2.0], 1)], ROWS))
    with pytest.raises(Exception, match="long"):
        W.whiten(spark.createDataFrame([(1, [1e30, 2.0], 1), (2, [1.0, 2.0], 1)], ROWS))
