"""Connection states when silent connections expire while they are tracked.

A packet maps the state of its connection to the next one.  There are few states, and how long a
connection was silent is the distance of two neighbouring packets, whatever the state; so packets are maps over a
fixed set of states, and maps compose.  Ordinary keys lie whole in one task.  The packets of large keys are cut by
(key, time) into pieces of even size; every piece that one key fills hands on its composed map, the maps are chained
piece by piece, and then each piece is read from the state it is entered with.  A key of any size is so many pieces.
"""

from __future__ import annotations

from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from vigil import fixed
from vigil.operators.skew import hot_keys, rows_per_task
from vigil.session import durable

SECOND = 1_000_000
#: What is stored of a connection: its state, and which end opened it (0: the end that comes first in its key).
NAMES = ("NEW", "SYN_SENT", "SYN_RECV", "ESTABLISHED", "FIN_WAIT", "CLOSE_WAIT", "CLOSED")
STATES = [None, *[(name, side) for name in NAMES for side in (0, 1)]]
PLACE = {state: n for n, state in enumerate(STATES)}
#: Silences at which some state ends, in microseconds.
LIMITS = sorted({n * SECOND for n in (0, fixed.TCP_SYN_TIMEOUT, fixed.TCP_FIN_TIMEOUT, fixed.TCP_ESTABLISHED_TIMEOUT, fixed.UDP_TIMEOUT)})
FLAGS = ("SYN", "ACK", "FIN", "RST")


def idle_limit(name: str, tcp: bool) -> int:
    """Microseconds a connection may be silent; a closed one ends with the first packet of a later moment."""
    if not tcp:
        return fixed.UDP_TIMEOUT * SECOND
    silent = {"CLOSED": 0, "SYN_SENT": fixed.TCP_SYN_TIMEOUT, "SYN_RECV": fixed.TCP_SYN_TIMEOUT,
              "FIN_WAIT": fixed.TCP_FIN_TIMEOUT, "CLOSE_WAIT": fixed.TCP_FIN_TIMEOUT}
    return silent.get(name, fixed.TCP_ESTABLISHED_TIMEOUT) * SECOND


def packet_code() -> Column:
    """All that matters of a packet but its time, as a number: protocol, flags, who sent it, whom it would answer."""
    a_is_source = (F.col("src_ip") < F.col("dst_ip")) | ((F.col("src_ip") == F.col("dst_ip")) & (F.col("src_port") <= F.col("dst_port")))
    bare = F.col("protocol") == "ICMP"                   # an ICMP connection is stored with port 0

    def answers(ip, port):
        return (F.col("src_ip") == ip) & (F.col("src_port") == F.when(bare, F.lit(0)).otherwise(port))
    first = [F.when(a_is_source, F.col(f"src_{c}")).otherwise(F.col(f"dst_{c}")) for c in ("ip", "port")]
    second = [F.when(a_is_source, F.col(f"dst_{c}")).otherwise(F.col(f"src_{c}")) for c in ("ip", "port")]
    kind = F.when(F.col("protocol") == "TCP", 0).when(F.col("protocol").isin("UDP", "ICMP"), 1).otherwise(2)
    bits = [*[F.array_contains("tcp_flags", f) for f in FLAGS], answers(*second), answers(*first), ~a_is_source]
    code = kind
    for bit in bits:
        code = 2 * code + F.coalesce(bit, F.lit(False)).cast("int")
    return code.cast("int")


def _step(state, kind: int, flags: set, answers: tuple, side: int):
    """(state, answer, reply, opens) after one packet of a connection that has not expired."""
    from vigil.streaming.twins import next_tcp_state
    tcp = kind == 0
    if state is None:
        if tcp and not ("SYN" in flags and "ACK" not in flags):
            return None, "INVALID", False, False
        if kind == 2:
            return None, "NEW", False, False
        return ("SYN_SENT" if tcp else "NEW", side), "NEW", False, True
    name, opener = state
    reply = answers[opener]
    name = next_tcp_state(name, reply, flags) if tcp else "ESTABLISHED" if reply else name
    return (name, opener), name, reply, False


@lru_cache(1)
def table() -> list[list[tuple]]:
    """[code * silences + silence][state] -> (state, answer, reply, opens) over all packets there can be."""
    out = []
    for code in range(3 << 7):
        bits = [bool(code >> k & 1) for k in range(6, -1, -1)]
        flags = {f for f, on in zip(FLAGS, bits) if on}
        kind, answers, side = code >> 7, (bits[4], bits[5]), int(bits[6])
        moved = [_step(s, kind, flags, answers, side) for s in STATES]
        moved = [(PLACE[s], *rest) for s, *rest in moved]
        for silence in range(len(LIMITS) + 1):          # so many limits are exceeded
            out.append([moved[0] if s is not None and LIMITS.index(idle_limit(s[0], kind == 0)) < silence else moved[n]
                        for n, s in enumerate(STATES)])
    return out


def _silences(us: np.ndarray, before: int | None) -> np.ndarray:
    """How many limits the silence before each row exceeds; none for the first row if nothing is known before it."""
    gap = np.diff(us, prepend=us[0] if before is None else before)
    return np.searchsorted(LIMITS, gap, side="left")


def _runs(keys: list, previous):
    """(first, last, whether it goes on from the row before the batch) of runs of equal keys."""
    first = 0
    for k in range(1, len(keys) + 1):
        if k == len(keys) or keys[k] != keys[first]:
            yield first, k, first == 0 and previous is not None and previous[0] == keys[0]
            first = k


def _summaries(batches):
    """A row per piece: its ends, and what becomes of a connection from its first row to its last.

    ``state`` and ``opened`` hold one entry per state before the first row if one key fills the piece, otherwise
    the entry of the last key alone, which starts inside.
    """
    moves, width = table(), len(LIMITS) + 1
    piece = first = last = None
    alone, states, opened = True, [], []

    def done():
        return pa.RecordBatch.from_pylist([{
            "piece": piece, "first_key": first[0], "first_us": first[1], "last_key": last[0], "last_us": last[1], "alone": alone,
            "state": states, "opened_us": [o and o[0] for o in opened], "opened_id": [o and o[1] for o in opened]}],
            pa.schema([("piece", pa.int32()), ("first_key", pa.string()), ("first_us", pa.int64()), ("last_key", pa.string()),
                       ("last_us", pa.int64()), ("alone", pa.bool_()), ("state", pa.list_(pa.int32())),
                       ("opened_us", pa.list_(pa.int64())), ("opened_id", pa.list_(pa.int64()))]))
    for batch in batches:
        pieces, keys, us, ids, codes = (c.to_pylist() for c in batch.columns)
        both = list(zip(pieces, keys))
        if not both:
            continue
        times = np.array(us, np.int64)
        for a, b, on in _runs(both, None if piece is None else (both[0] if (piece, last[0]) == both[0] else None,)):
            if pieces[a] != piece:
                if piece is not None:
                    yield done()
                piece, first, alone = pieces[a], (keys[a], us[a]), True
                states, opened = list(range(len(STATES))), [None] * len(STATES)
            elif not on:
                alone, states, opened = False, [0], [None]
            for k, silence in zip(range(a, b), _silences(times[a:b], last[1] if on else None)):
                move = moves[codes[k] * width + silence]
                for n, s in enumerate(states):
                    s, _, _, opens = move[s]
                    states[n] = s
                    if opens:
                        opened[n] = (us[k], ids[k])
            last = (keys[b - 1], us[b - 1])
    if piece is not None:
        yield done()


SUMMARY = ("piece int, first_key string, first_us bigint, last_key string, last_us bigint, alone boolean, state array<int>, "
           "opened_us array<bigint>, opened_id array<bigint>")


def _chained(summaries) -> dict[int, tuple]:
    """piece -> (key, last time, state, opened) of the connection that reaches into it; a row per piece is looked at."""
    entered, before = {}, None
    for r in sorted(summaries):
        goes_on = before is not None and before[0] == r.first_key
        if goes_on:
            entered[r.piece] = before
        n, opened = 0, None
        if r.alone and goes_on:
            n, opened = before[2], before[3]
            if STATES[n] is not None and r.first_us - before[1] > idle_limit(STATES[n][0], r.first_key.endswith("-TCP")):
                n, opened = 0, None
        if r.opened_us[n] is not None:
            opened = (r.opened_us[n], r.opened_id[n])
        before = (r.last_key, r.last_us, r.state[n], opened)
    return entered


def track(packets: DataFrame, us: str = "us", packet_id: str = "packet_id") -> DataFrame:
    """Add ``conn_key``, ``conn_state``, ``tracked``, ``is_reply``, ``stored_state``, ``opened_us`` and ``opened_id``.

    As :func:`vigil.operators.conntrack.track`, but a connection that has been silent for longer than its state
    allows is gone when the next packet comes, which may then open a new one.  ``opened_us`` and ``opened_id``
    name the packet that opened the connection, so that one key may hold many.  All columns of ``packets`` are
    written once and shuffled once by key.  Keys of more rows than a task should sort are cut into range pieces
    instead, and only these are read twice; the driver sees one row per such piece.
    """
    from vigil.operators.conntrack import connection_key
    spark, order = packets.sparkSession, ["conn_key", "_us", "_id"]
    # written before the key and the code are worked out: with what the packets are made of they would become one
    # generated method too long for the JVM to compile
    keyed = durable(packets).withColumns({"conn_key": connection_key(), "_code": packet_code(), "_us": F.col(us).cast("bigint"),
                                          "_id": F.col(packet_id).cast("bigint")})
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-keyed.count() // rows_per_task(spark)))
    hot = hot_keys(keyed.select("conn_key"), "conn_key")
    is_hot = F.coalesce(F.col("conn_key").isin(list(hot)), F.lit(False)) if hot else F.lit(False)
    whole = keyed.where(~is_hot).withColumn("_piece", F.lit(-1)).repartition(tasks, "conn_key").sortWithinPartitions(*order)
    parts, entered = [whole], {}
    if hot:
        pieces = max(2, -(-2 * sum(hot.values()) // rows_per_task(spark)))
        cut = durable(keyed.where(is_hot).repartitionByRange(pieces, *order).withColumn("_piece", F.spark_partition_id()))

        def in_order(rows):
            return rows.repartition(pieces, "_piece").sortWithinPartitions("_piece", *order)
        entered = _chained(in_order(cut.select("_piece", *order, "_code")).mapInArrow(_summaries, SUMMARY).collect())
        parts.append(in_order(cut))
    entered = spark.sparkContext.broadcast(entered)
    columns = whole.columns
    fresh = [("conn_state", T.StringType()), ("tracked", T.BooleanType()), ("is_reply", T.BooleanType()),
             ("stored_state", T.StringType()), ("opened_us", T.LongType()), ("opened_id", T.LongType())]
    used = [columns.index(c) for c in ("_piece", *order, "_code")]
    kept = [n for n, c in enumerate(columns) if c not in ("_piece", "_us", "_id", "_code")]

    def follow(batches):
        moves, width, nothing = table(), len(LIMITS) + 1, (None, None)
        names = pa.array([s and s[0] for s in STATES], pa.string())
        here = before = None                    # (piece, key); (key, last time, state, opened)
        for batch in batches:
            answers, replies, states, opens = [], [], [], []
            pieces, keys, times, ids, codes = (batch.column(n).to_pylist() for n in used)
            both = list(zip(pieces, keys))
            if not both:
                continue
            # the silence before the first row of a run is looked at with the run
            silences = (np.array(codes, np.int64) * width + _silences(np.array(times, np.int64), None)).tolist()
            for a, b, on in _runs(both, None if here is None else (here,)):
                if not on:
                    start = entered.value.get(pieces[a]) if here is None or here[0] != pieces[a] else None
                    before = start if start is not None and start[0] == keys[a] else (keys[a], None, 0, None)
                _, last, s, opened = before
                silences[a] = codes[a] * width + int(_silences(np.array(times[a:a + 1], np.int64), last)[0])
                for k in range(a, b):
                    s, answer, reply, new = moves[silences[k]][s]
                    if new:
                        opened = (times[k], ids[k])
                    elif not s:
                        opened = None
                    answers.append(answer)
                    replies.append(reply)
                    states.append(s)
                    opens.append(opened or nothing)
                here, before = both[a], (keys[a], times[b - 1], s, opened)
            new = [pa.array(answers, pa.string()), pa.array([s > 0 for s in states], pa.bool_()), pa.array(replies, pa.bool_()),
                   names.take(pa.array(states, pa.int32())), *[pa.array([o[n] for o in opens], pa.int64()) for n in (0, 1)]]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in kept], *new],
                                             names=[*[batch.schema.names[n] for n in kept], *[n for n, _ in fresh]])
    schema = T.StructType([whole.schema.fields[n] for n in kept] + [T.StructField(n, kind) for n, kind in fresh])
    return reduce(DataFrame.unionByName, [rows.select(*columns).mapInArrow(follow, schema) for rows in parts])


def connections(tracked: DataFrame, us: str = "us", packet_id: str = "packet_id") -> DataFrame:
    """One row per connection, several for a key whose connections expired: ends of life, state and traffic."""
    out, back, at = ~F.col("is_reply"), F.col("is_reply"), F.struct(us, packet_id)
    size = lambda side: F.sum(F.when(side, F.col("size")).otherwise(0))
    return (tracked.where("tracked").groupBy("conn_key", "protocol", "opened_us", "opened_id")
            .agg(F.max_by("stored_state", at).alias("state"), F.max(us).alias("last_seen_us"), F.count_if(back).alias("packets_in"),
                 F.count_if(out).alias("packets_out"), size(back).alias("bytes_in"), size(out).alias("bytes_out")))
