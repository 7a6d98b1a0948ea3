"""Long rule tables: what the index finds against a look through all rules, packet by packet."""

import ipaddress
import random

import pytest
from pyspark.sql import functions as F

from compare import compare, oracle
from conftest import SF
from vigil.operators import ruleindex, rules

RULE = ("rule_id int, name string, priority int, action string, protocol string, src_ip string, dst_ip string, src_port int, dst_port int, "
        "direction string, tcp_flags array<string>, zone_src string, zone_dst string, enabled boolean, seq int")
PACKET = "packet_id int, direction string, protocol string, src_ip string, dst_ip string, src_port int, dst_port int, tcp_flags array<string>, zone_src string, zone_dst string"


def network(rng):
    kind = rng.random()
    if kind < 0.15:
        return rng.choice(["any", "0.0.0.0/0"])
    if kind < 0.2:
        return rng.choice(["bad", "300.1.1.1", "10.0.0.0/40", "10.0.0.0/8"])
    address = f"10.{rng.randrange(3)}.{rng.randrange(4)}.{rng.randrange(256)}"
    return address if kind < 0.5 else f"{address}/{rng.randrange(5, 33)}"


def many_rules(rng, n):
    return [(k, f"r{k}", rng.randrange(n // 3 + 1), rng.choice(["ALLOW", "DENY", "DROP"]), rng.choice(["ANY", "TCP", "UDP"]), network(rng), network(rng),
             rng.choice([0, 0, 1, 2]), rng.choice([0, 80, 443, 22]), rng.choice(["ANY", "INBOUND", "OUTBOUND"]), rng.choice([[], [], ["SYN"], ["ACK", "FIN"]]),
             rng.choice(["", "", "dmz"]), rng.choice(["", "", "lan"]), rng.random() < 0.9, k) for k in range(n)]


def some_packets(rng, n):
    address = lambda: rng.choice(["bad", "300.1.1.1", "10.0.0.0/8", "9.9.9.9"]) if rng.random() < 0.1 else f"10.{rng.randrange(3)}.{rng.randrange(4)}.{rng.randrange(256)}"
    return [(k, rng.choice(["INBOUND", "OUTBOUND"]), rng.choice(["TCP", "UDP", "ICMP"]), address(), address(), rng.randrange(3), rng.choice([80, 443, 22, 9]),
             rng.choice([[], ["SYN"], ["SYN", "ACK"], ["ACK", "FIN"]]), rng.choice(["", None, "dmz", "wan"]), rng.choice(["", "lan", "wan"])) for k in range(n)]


def parsed(text):
    try:
        return ipaddress.ip_network(text, strict=False)
    except ValueError:
        return None


def plainly(packets, table):
    ordered = sorted((r for r in table if r[13]), key=lambda r: (r[2], r[14]))
    nets = [(parsed(r[5]), parsed(r[6])) for r in ordered]
    ranges = [tuple((int(n.network_address), int(n.broadcast_address)) if n else None for n in pair) for pair in nets]

    def inside(text, number, wanted, span):
        return wanted in ("any", "0.0.0.0/0") or text == wanted or (span is not None and number is not None and span[0] <= number <= span[1])
    out = []
    for p in packets:
        numbers = [int(ipaddress.ip_address(x)) if parsed(x) and "/" not in x else None for x in (p[3], p[4])]
        found = next((r for r, (a, b) in zip(ordered, ranges) if r[9] in ("ANY", p[1]) and r[4] in ("ANY", p[2]) and r[7] in (0, p[5]) and r[8] in (0, p[6])
                      and inside(p[3], numbers[0], r[5], a) and inside(p[4], numbers[1], r[6], b) and set(r[10]) <= set(p[7])
                      and (not r[11] or not p[8] or r[11] == p[8]) and (not r[12] or not p[9] or r[12] == p[9])), None)
        out.append((p[0], *(found[0], found[1], found[3])) if found else (p[0], -1, "", "DENY"))
    return sorted(out)


def got(spark, packets, table):
    frame = spark.createDataFrame(packets, PACKET)
    out = rules.apply_rules(frame, spark.createDataFrame(table, RULE))
    assert out.columns == [*frame.columns, "rule_id", "rule_name", "rule_action"]
    return sorted(map(tuple, out.select("packet_id", "rule_id", "rule_name", "rule_action").collect()))


def test_five_thousand_rules(spark):
    rng = random.Random(1)
    table, packets = many_rules(rng, 5000), some_packets(rng, 800)
    assert got(spark, packets, table) == plainly(packets, table)


def test_equals_the_short_plan(spark, monkeypatch):
    """The same few rules through both plans, sparse enough that many packets meet none or a late one."""
    rng = random.Random(2)
    table = [r for r in many_rules(rng, 150) if r[5] not in ("any", "0.0.0.0/0") and r[6] not in ("any", "0.0.0.0/0")]
    packets = some_packets(rng, 600)
    short = got(spark, packets, table)
    monkeypatch.setattr(rules, "COMPILED_RULES", 5)
    assert got(spark, packets, table) == short == plainly(packets, table) and len({r[1] for r in short}) > 15


def test_a_hundred_thousand_rules(spark, monkeypatch):
    """Joined by shuffle, as rules of this number are not shown to be few; no join is without a key."""
    from vigil import tables
    rng = random.Random(3)
    base, packets = many_rules(rng, 1000), some_packets(rng, 60)
    # a hundred copies of each rule with other priorities: the same rules are asked for often, and the least wins
    table = [(k * 1000 + r[0], r[1], r[2] + rng.randrange(500), *r[3:14], k * 1000 + r[14]) for k in range(100) for r in base]
    least = {}
    for r in table:
        least[r[14] % 1000] = min(least.get(r[14] % 1000, r), r, key=lambda x: (x[2], x[14]))
    monkeypatch.setattr(tables.bounded_broadcast, "__defaults__", (100, 1 << 20))
    spread = spark.createDataFrame(base, RULE).withColumnRenamed("rule_id", "_id").join(
        spark.createDataFrame([(r[0] % 1000, r[0], r[2]) for r in table], "_id int, rule_id int, _p int"), "_id")
    rules_frame = spread.drop("priority", "seq", "_id").withColumnRenamed("_p", "priority").withColumn("seq", F.col("rule_id"))
    out = rules.apply_rules(spark.createDataFrame(packets, PACKET), rules_frame)
    assert sorted(map(tuple, out.select("packet_id", "rule_id", "rule_name", "rule_action").collect())) == plainly(packets, list(least.values()))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_repeated_packets_and_shadowed_rules(spark, monkeypatch):
    monkeypatch.setattr(rules, "COMPILED_RULES", 0)
    rng = random.Random(4)
    table = many_rules(rng, 40)
    table += [(1000 + r[0], "late", r[2] + 9, *r[3:14], 1000 + r[14]) for r in table]
    packets = some_packets(rng, 40) * 3
    assert got(spark, packets, table) == plainly(packets, table)
    assert got(spark, packets, [(*r[:13], False, r[14]) for r in table]) == sorted((p[0], -1, "", "DENY") for p in packets)
    assert got(spark, [], table) == []


@pytest.mark.parametrize("limit", [500, 50])
def test_registered(spark, monkeypatch, limit):
    monkeypatch.setattr(rules, "COMPILED_RULES", limit)
    ok, message, rows, _ = compare("d8_many_rules", spark, oracle(SF), SF)
    assert ok, message
    for name in ("d8_first_match_rule", "j2_firewall_decisions"):
        monkeypatch.setattr(rules, "COMPILED_RULES", 0)
        ok, message, rows, _ = compare(name, spark, oracle(SF), SF)
        assert ok, message


def test_rules_behind_one_for_every_packet(spark, monkeypatch):
    """They never decide and are left out, in both plans; packets without flags meet rules that ask for none."""
    rng = random.Random(5)
    table = [r for r in many_rules(rng, 200) if r[5] not in ("any", "0.0.0.0/0")]
    table.append((900, "all", 20, "DENY", "ANY", "any", "0.0.0.0/0", 0, 0, "ANY", [], "", "", True, 900))
    table.append((901, "off", 1, "DENY", "ANY", "any", "any", 0, 0, "ANY", [], "", "", False, 901))
    packets = some_packets(rng, 300)
    expected = plainly(packets, table)
    assert all(r[1] != -1 for r in expected) and any(r[2] > 20 for r in table)
    kept = ruleindex.reachable(spark.createDataFrame(table, RULE)).collect()
    assert sorted(r.rule_id for r in kept) == sorted(r[0] for r in table if r[13] and (r[2], r[14]) <= (20, 900))
    bare = [(*p[:7], None, *p[8:]) for p in packets]
    bare_expected = plainly([(*p[:7], [], *p[8:]) for p in packets], table)
    for compiled in (500, 5, 0):
        monkeypatch.setattr(rules, "COMPILED_RULES", compiled)
        assert got(spark, packets, table) == expected
        assert got(spark, bare, table) == bare_expected


@pytest.mark.parametrize("step", ["apply_index", "_apply_case"])
def test_equal_packets_are_decided_once(spark, monkeypatch, step):
    """Ports and flags that no rule names do not tell packets apart; every packet keeps its answer."""
    rng = random.Random(6)
    table = [(*r[:7], 0, *r[8:11], "", "", *r[13:]) for r in many_rules(rng, 150) if r[5] not in ("any", "0.0.0.0/0") and not r[10]]
    ends = [p[1:5] for p in some_packets(rng, 25)]
    packets = [(k, *ends[k % 25], 5000 + k, rng.choice([443, 7000 + k]), rng.choice([["SYN"], ["URG", "ACK"], []]), "lan", None) for k in range(1500)]
    seen, plain = [], getattr(rules, step)

    def watched(kinds, *rest):
        seen.append(kinds.count())
        return plain(kinds, *rest)
    monkeypatch.setattr(rules, step, watched)
    monkeypatch.setattr(rules, "COMPILED_RULES", 5 if step == "apply_index" else 500)
    assert got(spark, packets, table) == plainly(packets, table)
    assert len(seen) == 1 and seen[0] <= 50


def test_case_of_many_rules_is_flat(spark):
    """Nested in each other, the branches of a few hundred rules took minutes to analyse."""
    rng = random.Random(7)
    table = [r for r in many_rules(rng, 400) if r[5] not in ("any", "0.0.0.0/0")]
    few = ruleindex.reachable(spark.createDataFrame(table, RULE)).orderBy("priority", "seq").collect()
    packets = spark.createDataFrame(some_packets(rng, 100), PACKET)
    plan = rules._apply_case(packets, few, "DENY")._jdf.queryExecution().analyzed().toString()
    assert len(few) > 100 and plan.count("CASE WHEN") < 20
