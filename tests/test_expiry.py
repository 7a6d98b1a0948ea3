"""Connections that expire while they are tracked: batch against replay, stream and SQL."""

import random

import pytest
from pyspark.sql import functions as F

from compare import compare, oracle
from conftest import SF
from test_large_keys import PACKET, packets
from test_streaming import rows, run, stream
from vigil.operators import conntrack, expiry
from vigil.streaming.twins import Connections


class Row:
    pass


def replay(data):
    """(conn_key, packet_id, state) packet by packet, silent connections forgotten."""
    machine, states, out = Connections(expire=True), {}, []
    for p in sorted(data, key=lambda p: (p[1], p[0])):
        row = Row()
        row.row_id, row.us, row.src_ip, row.dst_ip, row.src_port, row.dst_port, row.protocol, row.tcp_flags, _ = p
        key = "-".join(f"{ip}:{port}" for ip, port in sorted([(p[2], p[4]), (p[3], p[5])])) + "-" + p[6]
        states[key], found = machine.step(states.get(key), row)
        out.append((key, p[0], found[0][2]))
    return sorted(out)


def slow(seed, n=600):
    """Packets with silences from none to hours, often exactly at a limit."""
    rng, at, out = random.Random(seed), 0, []
    for p in sorted(packets(seed, n), key=lambda p: (p[1], p[0])):
        at += rng.choice([0, 0, 1, 5, 5, 10, 29, 30, 31, 60, 61, 180, 181, 3600, 3601][:rng.choice([3, 6, 6, 9, 15])]) * 1_000_000
        out.append((p[0], at + 10**12, *p[2:]))
    return out


def got(df):
    return sorted(map(tuple, conntrack.track(df, expire=True).select("conn_key", "packet_id", "conn_state").collect()))


@pytest.mark.parametrize("limit", [None, "200", "9"])
@pytest.mark.parametrize("seed", [1, 2])
def test_equals_replay(spark, seed, limit):
    data = slow(seed)
    if limit:
        spark.conf.set("spark.vigil.rowsPerTask", limit)
    try:
        assert got(spark.createDataFrame(data, PACKET).repartition(7)) == replay(data)
    finally:
        spark.conf.unset("spark.vigil.rowsPerTask")


def test_one_key_over_many_pieces(spark, hot):
    """One busy connection, cut into pieces of a few packets, that opens and expires many times."""
    rng, at, data = random.Random(3), 10**12, []
    for i in range(300):
        at += rng.choice([0, 1, 2, 31, 59, 61, 3601]) * 1_000_000
        ends = ("1.1.1.1", "2.2.2.2", 10, 20) if rng.random() < 0.6 else ("2.2.2.2", "1.1.1.1", 20, 10)
        data.append((i, at, *ends, "TCP", rng.choice([["SYN"], ["SYN", "ACK"], ["ACK"], ["ACK"], ["ACK", "FIN"], ["RST"]]), 1))
    df = spark.createDataFrame(data, PACKET)
    assert got(df) == replay(data)
    table = expiry.connections(conntrack.track(df, expire=True)).collect()
    assert len(table) > 20 and len({(r.opened_us, r.opened_id) for r in table}) == len(table)


def test_equals_stream(spark, tmp_path):
    data = slow(4, 300)
    df = spark.createDataFrame(data, PACKET).withColumn("event_time", F.timestamp_micros("us")).coalesce(1)
    from vigil.streaming import twins
    out = run(spark, twins.connection_stream(stream(spark, df, tmp_path, files=1), expire=True), tmp_path, "expire_batch")
    assert rows(out, "row_id", "conn_state") == sorted((p, s) for _, p, s in got(df))


def test_a_reused_key_opens_again(spark):
    data = [(1, 0, "a", "b", 1, 2, "TCP", ["SYN"], 5), (2, 1_000_000, "b", "a", 2, 1, "TCP", ["RST"], 6), (3, 2_000_000, "a", "b", 1, 2, "TCP", ["SYN"], 7),
            (4, 2_000_000, "a", "b", 1, 2, "TCP", ["SYN"], 8), (5, 40_000_000, "b", "a", 2, 1, "TCP", ["SYN", "ACK"], 9)]
    df = spark.createDataFrame(data, PACKET)
    out = conntrack.track(df, expire=True).orderBy("packet_id").select("conn_state", "stored_state", "tracked", "is_reply", "opened_id").collect()
    assert [tuple(r) for r in out] == [("NEW", "SYN_SENT", True, False, 1), ("CLOSED", "CLOSED", True, True, 1), ("NEW", "SYN_SENT", True, False, 3),
                                       ("SYN_SENT", "SYN_SENT", True, False, 3), ("INVALID", None, False, False, None)]
    assert [r.conn_state for r in conntrack.track(df).orderBy("packet_id").collect()] == ["NEW", "CLOSED", "CLOSED", "CLOSED", "CLOSED"]


def test_empty(spark):
    out = conntrack.track(spark.createDataFrame([], PACKET), expire=True)
    assert out.count() == 0 and {"conn_key", "opened_us"} <= set(out.columns)


def test_the_table_follows_the_machine():
    """Every state and silence of every packet: the table against one step of the replay machine."""
    machine, ends = Connections(expire=True), (("a", 1), ("b", 2))
    for n, move in enumerate(expiry.table()):
        code, silence = divmod(n, len(expiry.LIMITS) + 1)
        bits = [bool(code >> k & 1) for k in range(6, -1, -1)]
        if code >> 7 == 2 or bits[4] == bits[5] or bits[4] != bits[6]:        # answers the other end, and only that one
            continue
        row = Row()
        row.tcp_flags = [f for f, on in zip(expiry.FLAGS, bits) if on]
        row.protocol, row.row_id, row.us = ("TCP", "UDP")[code >> 7], 1, (expiry.LIMITS[silence - 1] + 1 if silence else 0)
        (row.src_ip, row.src_port), (row.dst_ip, row.dst_port) = ends if not bits[6] else ends[::-1]
        for state, (after, answer, _, _) in zip(expiry.STATES, move):
            held = state and (state[0], *ends[1 - state[1]], row.protocol, 0)
            value, found = machine.step(held, row)
            assert found[0][2] == answer and (value[0] if value else None) == (expiry.STATES[after] or (None,))[0]


@pytest.mark.parametrize("limit", ["200", "5000000"])
@pytest.mark.parametrize("name", ["g2_states_with_expiry", "g2_connections_with_expiry"])
def test_registered(spark, name, limit):
    spark.conf.set("spark.vigil.rowsPerTask", limit)
    try:
        ok, message, _, _ = compare(name, spark, oracle(SF), SF)
    finally:
        spark.conf.unset("spark.vigil.rowsPerTask")
    assert ok, message


def test_packets_are_made_once(spark):
    """What packets are made of is worked out once a row, and keys of ordinary size are not cut into pieces."""
    made, data = spark.sparkContext.accumulator(0), slow(5, 200)

    def count(size):
        made.add(1)
        return size
    df = spark.createDataFrame(data, PACKET).withColumn("size", F.udf(count, "int")("size"))
    out = conntrack.track(df, expire=True)
    assert got(df) == replay(data) and out.count() == len(data)
    made.value = 0
    out = conntrack.track(df, expire=True)
    out.collect()
    assert made.value == len(data)
    assert "_piece" not in out.columns and "rangepartitioning" not in out._jdf.queryExecution().executedPlan().toString()
