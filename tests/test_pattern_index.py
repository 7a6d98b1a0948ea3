"""Long pattern tables: required letters, and first matches found through them against a try of all patterns."""

import random
import re

import pytest
from pyspark.sql import functions as F

from compare import compare, oracle
from conftest import SF
from vigil.operators import patternindex, rules

SIGNS = "seq int, sid int, name string, protocol string, dst_port array<int>, pattern string, severity string, action string, category string, mitre string"
PACKET = "packet_id int, protocol string, dst_port int, payload string"


@pytest.mark.parametrize("pattern, letters", [
    ("union\\s+all", ["union"]), ("(?i)ab|cde", ["ab", "cde"]), ("a|[0-9]+", None), ("[abc]+", None), ("colou?r", ["colo"]), ("x{2}yz", ["yz"]),
    ("a(bc)?d", ["a"]), ("ab+c", ["ab"]), ("\\.\\./passwd", ["../passwd"]), ("[]x]ab[^]y]", ["ab"]), ("[a[b]c]de", ["de"]), ("\\x41BC", None), ("\\QaB\\E", None),
    ("(?x)a b", None), ("(?iu)sk", None), ("", None), ("^GET$", ["get"]), ("é", None), ("abécde", ["cde"]), ("a*bc*", ["b"]), ("\\[a\\]", ["[a]"]), ("(a|b)c|d", ["c", "d"])])
def test_required_letters(pattern, letters):
    assert patternindex.required_letters(pattern) == letters


def test_required_letters_are_required():
    """Random texts built from the pieces of patterns: what matches holds the letters."""
    rng, pieces = random.Random(1), ["ab", "b?", "c+", "(d|e)", "[fg]", ".", "\\d", "h{2}", "i*", "\\.", "|", "jk", "^", "L"]
    for _ in range(3000):
        pattern = "".join(rng.choice(pieces) for _ in range(rng.randrange(1, 6)))
        letters = patternindex.required_letters(pattern)
        text = "".join(rng.choice(["ab", "c", "cc", "d", "e", "f", "hh", "h", ".", "1", "jk", "l", "L", "A"]) for _ in range(rng.randrange(8)))
        if letters and re.search(pattern, text, re.I):
            assert any(x in text.lower() for x in letters), (pattern, text, letters)


def packets(spark, n=300):
    rng = random.Random(2)
    words = ["alpha", "Beta", "ga.mma", "x9", "é", "İab", "GET /", "zq77q4", "ZQ1200QQ5", "q", "", "  ", "a|b", "zq3q"]
    data = [(k, rng.choice(["tcp", "udp"]), rng.choice([80, 81]), " ".join(rng.choice(words) for _ in range(rng.randrange(6)))) for k in range(n)]
    return spark.createDataFrame([*data, (n, "tcp", 80, None), (n + 1, "tcp", 80, "long " * 3000 + "zq19999q1")], PACKET)


def signs(n):
    rng = random.Random(3)
    special = ["beta", "ga\\.mma|nothing", "^get /$", "x[0-9]$", "[é]", "al(pha|la)", "iab", "q{2}[0-9]", "zq[0-9]+q"]
    pattern = lambda k: special[k // 97 % len(special)] if k % 97 == 5 else f"zq{k}q+[0-9]"
    return [((k * 7919) % n, k, f"s{k}", rng.choice(["ANY", "tcp", "udp"]), [81] if k % 5 == 0 else [], pattern(k), "high", "alert", "c", "") for k in range(n)]


def test_twenty_thousand_signatures(spark):
    frame, table = packets(spark), signs(20_000)
    out = rules.match_signatures(frame, spark.createDataFrame(table, SIGNS))
    assert out.columns == [*frame.columns, "signature"]
    ordered = [(r, re.compile(r[5], re.I | re.A)) for r in sorted(table)]
    for r in out.collect():
        want = next((s for s, p in ordered if s[3] in ("ANY", r.protocol) and (not s[4] or r.dst_port in s[4]) and p.search(r.payload or "")), None)
        assert (r.signature and (r.signature.sid, r.signature.name)) == (want and want[1:3]), r.payload[:80]
        assert not r.signature or r.signature.details == "Matched: " + r.payload[:80]


def test_many_contents(spark):
    texts = ["Beta", "beta", "", "ga.mma", "é", "İa", "x", "zq77q4"]
    table = [((k * 7) % 3000, "alert", "udp" if k % 2 else "tcp", texts[k % 400 % len(texts)] if k % 400 < 8 else f"zq{k}q", f"m{k}") for k in range(3000)]
    frame = packets(spark)
    contents = spark.createDataFrame(table, "id int, action string, protocol string, content string, msg string")
    for r in rules.match_content(frame, contents).collect():
        want = next(((i, a, m) for i, a, p, c, m in sorted(table) if p == r.protocol and r.payload is not None and c in r.payload), (None, None, None))
        assert (r.content_id, r.content_action, r.content_message) == want


def test_empty_tables_match_nothing(spark):
    frame = packets(spark, 5)
    assert rules.match_signatures(frame, spark.createDataFrame([], SIGNS)).where("signature IS NOT NULL").count() == 0
    out = rules.match_content(frame, spark.createDataFrame([], "id int, action string, protocol string, content string, msg string"))
    assert out.where("content_id IS NOT NULL").count() == 0 and out.count() == frame.count()


@pytest.mark.parametrize("limit", [500, 20])
def test_registered(spark, monkeypatch, limit):
    monkeypatch.setattr(rules, "MAX_PATTERNS", limit)
    ok, message, _, _ = compare("d9_many_signatures", spark, oracle(SF), SF)
    assert ok, message


def test_copies_of_patterns_are_tried_once(spark):
    """A thousand patterns that ask for the same are one, with the rank of the first."""
    tried = []
    frame = spark.createDataFrame([(1, "tcp", 80, "1=1"), (2, "tcp", 80, "1=1"), (3, "udp", 80, None)], PACKET)
    table = [(k, k, f"s{k}", "ANY", [], "[0-9]+", "high", "alert", "c", "") for k in range(1000, 0, -1)]
    holds = lambda payload: F.lit(True)

    def literal(row):
        tried.append(row["rank"])
        return F.coalesce(F.col("payload"), F.lit("")).rlike(row["pattern"])
    found, ranked = patternindex.first_hits(frame, spark.createDataFrame(table, SIGNS), "pattern", ["seq"], True, holds, literal)
    assert tried == [1] and [r.sid for r in ranked.collect()] == [1]
    assert sorted((r.packet_id, r._best) for r in found.collect()) == [(1, 1), (2, 1), (3, None)]
