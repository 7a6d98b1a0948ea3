import random

import pytest
from llm_brute import components, fingerprint, texts
from llm_fixtures import none, odd, plain  # noqa: F401
from pyspark.sql import functions as F

from vigil.llm import simhash as S


def check(docs, **options):
    rows = [(d, fingerprint(t, options.get("shingle", 3))) for d, t in texts(docs)]
    want = sorted(map(repr, zip([d for d, _ in rows], [f"{b:016x}" for _, b in rows], components(rows))))
    got = S.near_duplicates(docs, **options).select("doc_id", S.hex_of(F.col("bits")), "component_id").collect()
    assert sorted(repr(tuple(r)) for r in got) == want


def test_whole_table(plain):
    check(plain)
    check(plain, shingle=5)


def test_odd_rows(odd, none):
    check(odd)
    assert S.near_duplicates(none).count() == 0


@pytest.mark.parametrize("group_rows", [20_000, 3, 1])
def test_links_of_planted_neighbours(spark, group_rows):
    """Chains and dense groups of fingerprints, also with groups cut into slices."""
    rnd = random.Random(group_rows)
    bits = [0, (1 << 64) - 1]
    for _ in range(30):
        at = rnd.getrandbits(64)
        for _ in range(rnd.randrange(1, 12)):
            bits.append(at)
            for b in rnd.sample(range(64), rnd.randrange(1, 5)):
                at ^= 1 << b
    bits = sorted(set(bits))
    frame = spark.createDataFrame([(b - (1 << 64) if b >> 63 else b,) for b in bits], "bits bigint")
    tree = {r.node: r.root for r in S.components(S.links(frame, 3, group_rows)).collect()}
    got = {}
    for b in bits:
        signed = b - (1 << 64) if b >> 63 else b
        got.setdefault(tree.get(signed, signed), set()).add(b)
    want = {}
    for b, c in zip(bits, components([(b, b) for b in bits])):
        want.setdefault(c, set()).add(b)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_gray_rank_orders_codes(spark):
    codes = [i ^ i >> 1 for i in range(64)]
    rows = spark.createDataFrame([(c,) for c in codes], "bits bigint").orderBy(S.gray_rank(F.col("bits"))).collect()
    assert [r.bits for r in rows] == codes


def test_one_of_each_group_stays(odd, none):
    kept = S.keep_one(odd)
    assert kept.columns == odd.columns
    ids = [r.doc_id for r in kept.collect()]
    rows = [(d, fingerprint(t)) for d, t in texts(odd)]
    assert sorted(map(repr, ids)) == sorted({repr(d) for (d, _), c in zip(rows, components(rows)) if d == c})
    assert S.keep_one(none).count() == 0


def test_kept_rows_with_clashing_columns(spark, odd):
    docs = odd.select("*", *[F.lit(1).alias(c) for c in ("_kept", "_row", "_order", "component_id", "node")])
    kept = S.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(map(repr, kept.select("doc_id").collect())) == sorted(map(repr, S.keep_one(odd).select("doc_id").collect()))
    assert kept.count() == kept.select("doc_id").distinct().count()
