"""Pattern tables above the size of one expression give the same first match."""

import pytest
from pyspark.sql import functions as F

from vigil.operators import rules

PACKETS = [(i, "tcp" if i % 3 else "udp", 80 + i, f"say A{i % 7} and B{i % 5} or nothing") for i in range(60)]


@pytest.fixture
def packets(spark):
    return spark.createDataFrame(PACKETS, "packet_id int, protocol string, dst_port int, payload string")


@pytest.mark.parametrize("limit", [1, 2, 4])
def test_signatures_in_chunks(spark, packets, monkeypatch, limit):
    listed = [(9 - n, 100 + n, f"s{n}", "tcp" if n % 2 else "ANY", [81, 84, 88] if n == 4 else [], p)
              for n, p in enumerate(["B4", "a[12]", "B[02]", "A3", "say", "b1", "A[45]"])]
    table = spark.createDataFrame(listed, "seq int, sid int, name string, protocol string, dst_port array<int>, pattern string").select(
        "*", *[F.lit(x).alias(x) for x in ("severity", "action", "category", "mitre")])
    read = lambda: {r.packet_id: r.signature and r.signature.sid for r in rules.match_signatures(packets, table).collect()}
    whole = read()
    monkeypatch.setattr(rules, "MAX_PATTERNS", limit)
    assert read() == whole and len(set(whole.values())) > 4 and None in whole.values()


@pytest.mark.parametrize("limit", [1, 3, 2000])
def test_contents_in_chunks(spark, packets, monkeypatch, limit):
    monkeypatch.setattr(rules, "MAX_PATTERNS", limit)
    listed = [(n, "alert", "udp" if n % 4 == 0 else "tcp", c, f"m{n}") for n, c in enumerate(["B4", "A2", "A1 and B", "B0", "A", "B3"])]
    table = spark.createDataFrame(listed, "id int, action string, protocol string, content string, msg string")
    for r in rules.match_content(packets, table).collect():
        want = next(((n, a, m) for n, a, p, c, m in listed if p == r.protocol and c in r.payload), (None, None, None))
        assert (r.content_id, r.content_action, r.content_message) == want
