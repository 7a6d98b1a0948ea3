"""Structured Streaming forms of the stateful operators.

Rows of a micro-batch are put in time order per key; what a key remembers between batches is a
few values.  Every twin but the connections that never expire has a watermark on event time: rows later than
it are dropped by Spark and counted in the progress of the query (:func:`late_rows`), and what a key remembers ends with
a timer once it can tell nothing about rows to come.
"""

from __future__ import annotations

import uuid
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor

from vigil import fixed
from vigil.operators import baseline, correlate, enrich, normalize
from vigil.operators.conntrack import connection_key
from vigil.session import checkpoint_dir

SECOND = 1_000_000


#: How much later than the newest row a row may come.
DELAY = "10 minutes"


def on_event_time(rows: DataFrame, delay: str = DELAY) -> DataFrame:
    """Rows with a watermark on ``us``.  Event time is a second ahead, as a row at the epoch would be late from the start."""
    return rows.withColumn("event_time", F.timestamp_micros(F.col("us") + SECOND)).withWatermark("event_time", delay)


def late_rows(query) -> int:
    """Rows that a query has dropped because they came after the watermark."""
    return sum(o["numRowsDroppedByWatermark"] for p in query.recentProgress for o in p["stateOperators"])


class InOrder(StatefulProcessor):
    """Runs ``step`` over the rows of a key in time order and keeps one value between batches.

    A key has one timer at most.  When it fires and the value still matters, it is set anew, otherwise the key is
    forgotten.
    """

    schema = ""             # of the value kept
    columns: list[str] = []  # of the output

    def init(self, handle) -> None:
        self.handle = handle
        self.value = handle.getValueState("value", self.schema)

    def step(self, value, row):
        """(value, outputs) after one row; ``value`` is None if there is nothing to remember."""
        raise NotImplementedError

    def ends(self, value) -> int | None:
        """The moment from which the value tells nothing any more; None if it always does."""
        return None

    def _timer(self, value) -> None:
        end = self.ends(value)
        if end is not None:
            self.handle.registerTimer((end + SECOND) // 1000 + 1)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self.value.exists()
        value = self.value.get() if known else None
        out = []
        pdf = pd.concat(list(rows)).sort_values(["us", "row_id"])
        for row in pdf.itertuples(index=False):
            value, found = self.step(value, row)
            out += [(key[0], *f) for f in found]
        if value is not None:
            self.value.update(value)
            self.after(value, known)
        elif known:
            self.value.clear()
        yield pd.DataFrame(out, columns=self.columns)

    def after(self, value, known: bool) -> None:
        if not known:
            self._timer(value)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.value.exists():
            value = self.value.get()
            if self.ends(value) + SECOND > timerValues.getCurrentWatermarkInMs() * 1000:
                self._timer(value)
            else:
                self.value.clear()
        yield pd.DataFrame([], columns=self.columns)

    def close(self) -> None:
        pass


def run_available(out: DataFrame, mode: str = "append", folder: str | None = None) -> DataFrame:
    """Run a stream over everything that is there and return what it wrote.

    Result, offsets and state go to a folder of their own below the checkpoint folder; with ``folder`` an earlier run
    goes on.
    """
    spark = out.sparkSession
    folder = folder or f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        query = (out.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{folder}/state")
                 .trigger(availableNow=True).start(f"{folder}/rows"))
        query.awaitTermination()
    finally:
        spark.conf.set(provider, before)
    return spark.read.schema(out.schema).parquet(f"{folder}/rows")


#: Event time of the row that ends an input; nothing else happens so late.
END = "9999-01-01 00:00:00"


def before_end(rows: DataFrame, time: str) -> DataFrame:
    """Without the row that ends the input, which has moved the watermark by then."""
    return rows.where(F.col(time) < F.lit(END).cast("timestamp"))


def run_to_end(events: DataFrame, time: str, build) -> DataFrame:
    """Run ``build(events)`` over everything that is there, then end the input so that nothing stays open.

    The rows come with a second source, a folder that holds nothing until all rows are read.  Then one row of the
    time ``END`` is put there and the stream goes on from its checkpoint: the watermark passes everything, and
    every window and timer fires.  A stream that goes on for ever needs no end; a replay or a test does.
    """
    spark = events.sparkSession
    folder = f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    marks = spark.range(1).select(F.lit(END).cast("timestamp").alias(time))
    marks.limit(0).write.parquet(f"{folder}/end")
    ends = spark.readStream.schema(marks.schema).parquet(f"{folder}/end")
    out = build(events.unionByName(ends, allowMissingColumns=True))
    run_available(out, folder=folder)
    marks.write.mode("append").parquet(f"{folder}/end")
    return run_available(out, folder=folder)


# ------------------------------------------------------------------ thresholds

class Threshold(InOrder):
    """N rows within W; the window is emptied by a fire."""

    schema = "times array<bigint>"
    columns = ["key", "us", "row_id", "event_count"]

    def __init__(self, n: int, window_us: int):
        self.n, self.window = n, window_us

    def step(self, value, row):
        times = [t for t in (value[0] if value else []) if row.us - t <= self.window] + [int(row.us)]
        if len(times) >= self.n:
            return None, [(int(row.us), int(row.row_id), self.n)]
        return (times,), []

    def ends(self, value):
        return value[0][-1] + self.window


def threshold_stream(events: DataFrame, key: str, n: int, seconds: float, row_id: str = "event_id", delay: str = DELAY) -> DataFrame:
    """Streaming twin of :func:`vigil.operators.thresholds.all_fires`; remembers at most N-1 times per key."""
    rows = on_event_time(events.select(F.col(key).alias("key"), "us", F.col(row_id).cast("bigint").alias("row_id")), delay)
    return rows.groupBy("key").transformWithStateInPandas(
        Threshold(n, int(seconds * SECOND)), "key string, us bigint, row_id bigint, event_count int", "Append", "EventTime")


class DistinctThreshold(InOrder):
    """N different values within W; the window is emptied by a fire."""

    schema = "times array<bigint>, items array<int>"
    columns = ["key", "us", "row_id", "distinct_values"]

    def __init__(self, n: int, window_us: int):
        self.n, self.window = n, window_us

    def step(self, value, row):
        last = dict(zip(value[1], value[0])) if value else {}
        last = {v: t for v, t in last.items() if row.us - t <= self.window}
        last[int(row.item)] = int(row.us)       # only the last time of a value matters
        if len(last) >= self.n:
            return None, [(int(row.us), int(row.row_id), len(last))]
        return (list(last.values()), list(last)), []

    def ends(self, value):
        return max(value[0]) + self.window


def distinct_threshold_stream(events: DataFrame, key: str, item: str, n: int, seconds: float,
                              row_id: str = "packet_id", delay: str = DELAY) -> DataFrame:
    """N different values within W seconds; remembers the last time of each value in the window."""
    rows = on_event_time(events.select(F.col(key).alias("key"), "us", F.col(row_id).cast("bigint").alias("row_id"), F.col(item).alias("item")), delay)
    return rows.groupBy("key").transformWithStateInPandas(
        DistinctThreshold(n, int(seconds * SECOND)), "key string, us bigint, row_id bigint, distinct_values int", "Append", "EventTime")


def _answered(window: int):
    """For batches of lists of (us, row_id): how many rows of the list stand in the ``window`` up to each row of the second half.

    All lists of a batch are answered together, as one ascending row of numbers in which no list reaches into another.
    """
    def run(batches):
        for batch in batches:
            names = [*batch.schema.names[:-2], "us", "row_id", "n"]
            lists = batch.column(batch.num_columns - 1)
            of, items = pc.list_parent_indices(lists).to_numpy(), pc.list_flatten(lists)
            us, row_id = (pc.struct_field(items, k).to_numpy(zero_copy_only=False) for k in (0, 1))
            start = batch.column(batch.num_columns - 2).to_numpy()[of]
            order = np.lexsort((row_id, us, of))
            place = (of * (4 * window) + us - start)[order]
            n = np.arange(len(place)) - np.searchsorted(place, place - window) + 1
            own = (us - start)[order] >= window
            at = order[own]
            keys = batch.select(batch.schema.names[:-2]).take(pa.array(of[at]))
            yield pa.RecordBatch.from_arrays([*keys.columns, pa.array(us[at]), pa.array(row_id[at]), pa.array(n[own], pa.int32())], names=names)
    return run


def trailing_counts(events: DataFrame, keys=("src_ip", "action"), seconds: int = 300, time: str = "event_time", delay: str = "5 minutes",
                    row_id: str = "event_id") -> DataFrame:
    """(keys, us, row_id, n): at every row, the rows of its key in the ``seconds`` up to it, the row itself included.

    Time is cut into cells of that length, and a sliding window of two cells holds what the rows of the second one look
    back on.  State is the rows by key and window, so that it ends with its cell and a busy source is as many states as it
    has cells.  A cell is answered when the watermark passes it, whatever batches its rows came in and in
    whatever order; rows of a cell that was answered are dropped and counted in the progress of the query.  Closed lists are
    answered many at a time, so that a key with few rows costs no call of its own.
    """
    window = seconds * SECOND
    rows = before_end(events.withWatermark(time, delay), time)
    group = [f"k{n}" for n in range(len(keys))]
    rows = rows.select(*[F.col(k).cast("string").alias(g) for g, k in zip(group, keys)], time, F.struct("us", F.col(row_id).cast("bigint").alias("row_id")).alias("_row"))
    lists = rows.groupBy(*group, F.window(time, f"{2 * seconds} seconds", f"{seconds} seconds")).agg(F.collect_list("_row").alias("rows"))
    found = lists.select(*group, F.unix_micros("window.start").alias("start"), "rows").mapInArrow(
        _answered(window), ", ".join([*[f"{g} string" for g in group], "us bigint, row_id bigint, n int"]))
    return found.select(*[F.col(g).alias(k) for g, k in zip(group, keys)], "us", "row_id", "n")


# ------------------------------------------------------------------ connections

# seconds a TCP connection may stay silent by state (fixed values); other states take the long limit
_IDLE = {"SYN_SENT": fixed.TCP_SYN_TIMEOUT, "SYN_RECV": fixed.TCP_SYN_TIMEOUT,
         "FIN_WAIT": fixed.TCP_FIN_TIMEOUT, "CLOSE_WAIT": fixed.TCP_FIN_TIMEOUT}


#: (state, from the answering side or not or either, flags that must be set, flags that must not, next state).
#: The first row that fits holds; a state without a fitting row stays.
TCP_STEPS = [
    (None, None, {"RST"}, set(), "CLOSED"),
    ("SYN_SENT", True, {"SYN", "ACK"}, set(), "SYN_RECV"),
    ("SYN_RECV", False, {"ACK"}, set(), "ESTABLISHED"),
    ("ESTABLISHED", None, {"FIN"}, set(), "FIN_WAIT"),
    ("FIN_WAIT", None, {"ACK", "FIN"}, set(), "CLOSED"),
    ("FIN_WAIT", None, {"ACK"}, {"FIN"}, "CLOSE_WAIT"),
    ("CLOSE_WAIT", None, {"FIN"}, set(), "CLOSED"),
]


def next_tcp_state(state: str, reply: bool, flags: set) -> str:
    fits = (after for before, side, needed, barred, after in TCP_STEPS
            if before in (None, state) and side in (None, reply) and needed <= flags and not barred & flags)
    return next(fits, state)


class Connections(InOrder):
    """State of one connection.  With ``expire`` a silent connection is forgotten."""

    schema = "state string, peer string, peer_port int, protocol string, last_us bigint"
    columns = ["conn_key", "row_id", "us", "conn_state"]

    def __init__(self, expire: bool = False):
        self.expire = expire

    def limit(self, state: str, protocol: str) -> int:
        if protocol != "TCP":
            return fixed.UDP_TIMEOUT
        return 0 if state == "CLOSED" else _IDLE.get(state, fixed.TCP_ESTABLISHED_TIMEOUT)

    def step(self, value, row):
        flags = set(row.tcp_flags) if row.tcp_flags is not None else set()
        answer = lambda state: [(int(row.row_id), int(row.us), state)]
        if value and self.expire and row.us - value[4] > self.limit(value[0], value[3]) * SECOND:
            value = None
        if value is None:
            tcp = row.protocol == "TCP"
            if tcp and not ("SYN" in flags and "ACK" not in flags):
                return None, answer("INVALID")
            if row.protocol not in ("TCP", "UDP", "ICMP"):
                return None, answer("NEW")
            port = 0 if row.protocol == "ICMP" else int(row.dst_port)
            return ("SYN_SENT" if tcp else "NEW", row.dst_ip, port, row.protocol, int(row.us)), answer("NEW")
        state, peer, port, protocol, last = value
        reply = row.src_ip == peer and row.src_port == port
        if protocol == "TCP":
            state = next_tcp_state(state, reply, flags)
        elif reply:
            state = "ESTABLISHED"
        return (state, peer, port, protocol, max(int(row.us), last)), answer(state)

    def ends(self, value):
        return value[4] + self.limit(value[0], value[3]) * SECOND if self.expire else None


def connection_stream(packets: DataFrame, expire: bool = False, time: str = "event_time", delay: str = "10 seconds") -> DataFrame:
    """Streaming twin of :func:`vigil.operators.conntrack.track`."""
    if expire:
        packets = packets.withWatermark(time, delay)
    kept = ["us", "src_ip", "src_port", "dst_ip", "dst_port", "protocol", "tcp_flags"] + ([time] if expire else [])
    rows = packets.select(connection_key().alias("conn_key"), F.col("packet_id").alias("row_id"), *kept)
    return rows.groupBy("conn_key").transformWithStateInPandas(
        Connections(expire), "conn_key string, row_id bigint, us bigint, conn_state string", "Append",
        "EventTime" if expire else "None")


# ------------------------------------------------------------------ blocks

class Verdicts(InOrder):
    """Rate verdicts of one source: flood and scan windows, and the end of the block."""

    schema = "until bigint, kind string, syn array<bigint>, port_times array<bigint>, ports array<int>"
    columns = ["src_ip", "row_id", "us", "rule_name"]

    def step(self, value, row):
        until, kind, syn, times, ports = value or (0, "", [], [], [])
        now = int(row.us)
        name = ""
        if now < until:
            name = "IP Blocked"
        elif row.signature_name:
            name = row.signature_name
        elif row.flags == "SYN":
            syn = [t for t in syn if now - t <= fixed.SYN_FLOOD[1] * SECOND] + [now]
            whole = -(-now // SECOND) * SECOND
            if len(syn) >= fixed.SYN_FLOOD[0]:
                name, until, syn = "SYN Flood Detected", whole + fixed.SYN_FLOOD_BLOCK * SECOND, []
            elif row.dst_port:
                last = {p: t for p, t in zip(ports, times) if now - t <= fixed.IDS_PORT_SCAN[1] * SECOND}
                last[int(row.dst_port)] = now
                if len(last) >= fixed.IDS_PORT_SCAN[0]:
                    name, until, last = "Port Scan Detected", whole + fixed.IDS_PORT_SCAN_BLOCK * SECOND, {}
                times, ports = list(last.values()), list(last)
        return (until, kind, syn, times, ports), [(int(row.row_id), now, name)]

    def ends(self, value):
        until, _, syn, times, _ = value
        return max([until] + [t + fixed.SYN_FLOOD[1] * SECOND for t in syn[-1:]] + [t + fixed.IDS_PORT_SCAN[1] * SECOND for t in times])


def verdict_stream(packets: DataFrame, delay: str = DELAY) -> DataFrame:
    """Streaming twin of :func:`vigil.operators.ids.verdicts`: the rule that decided every packet."""
    from vigil.operators.rules import match_signatures
    signed = match_signatures(packets)
    rows = on_event_time(signed.select("src_ip", F.col("packet_id").alias("row_id"), "us", "flags", "dst_port",
                                       F.coalesce(F.col("signature.name"), F.lit("")).alias("signature_name")), delay)
    return rows.groupBy("src_ip").transformWithStateInPandas(
        Verdicts(), "src_ip string, row_id bigint, us bigint, rule_name string", "Append", "EventTime")


class BlockList(InOrder):
    """A detection blocks its source for a while; later rows are marked."""

    schema = "until bigint"
    columns = ["src_ip", "row_id", "us", "blocked"]

    def __init__(self, ttl_seconds: int):
        self.ttl = ttl_seconds * SECOND

    def step(self, value, row):
        until = value[0] if value else 0
        if row.detected:
            until = int(row.us) + self.ttl
        return (until,) if until > row.us else None, [(int(row.row_id), int(row.us), bool(row.us < until))]

    def ends(self, value):
        return value[0]


def block_list_stream(packets: DataFrame, ttl_seconds: int = fixed.STANDALONE_BLOCK, delay: str = DELAY) -> DataFrame:
    """Streaming twin of :func:`vigil.operators.ids.apply_block_list`; input has a ``detected`` flag."""
    rows = on_event_time(packets.select("src_ip", F.col("packet_id").alias("row_id"), "us", "detected"), delay)
    return rows.groupBy("src_ip").transformWithStateInPandas(
        BlockList(ttl_seconds), "src_ip string, row_id bigint, us bigint, blocked boolean", "Append", "EventTime")


# ------------------------------------------------------------------ registers

class RegisterHistory(InOrder):
    """Last accepted value of a register and whether there were two.

    A register's last value holds until the next one, so nothing ends; there are as many states as known registers.
    """

    schema = "last bigint, seen int"
    columns = ["address", "row_id", "us", "change_percent"]

    def step(self, value, row):
        last, seen = value or (0, 0)
        out = []
        if seen >= 2 and row.span > 0:
            change = abs(int(row.value) - last) * 100.0 / row.span
            if change > fixed.MAX_CHANGE_PERCENT:
                out = [(int(row.row_id), int(row.us), change)]
        return (int(row.value), min(seen + 1, 2)), out


def rate_of_change_stream(commands: DataFrame, delay: str = DELAY) -> DataFrame:
    """Rapid changes among accepted writes (streaming twin of the rate check)."""
    from vigil.operators.ot import with_register, writes
    rows = with_register(writes(commands).where(F.col("source_ip").isin(fixed.OT_WRITERS)))
    rows = (rows.where(~F.col("readonly") & F.col("value").between(F.col("min_value"), F.col("max_value")) & F.col("known"))
            .select("address", F.col("command_id").alias("row_id"), "us", "value",
                    (F.col("max_value") - F.col("min_value")).alias("span")))
    return on_event_time(rows, delay).groupBy("address").transformWithStateInPandas(
        RegisterHistory(), "address int, row_id bigint, us bigint, change_percent double", "Append", "EventTime")


# ------------------------------------------------------------------ metrics, incidents, stateless part

def minute_metrics_stream(events: DataFrame, time: str = "event_time", delay: str = "2 minutes") -> DataFrame:
    """Metrics of closed minutes (streaming twin of :func:`vigil.operators.baseline.minute_metrics`).

    Two aggregations in a row: per minute and source first, whose rows then make the minute, so that distinct
    sources are exact and no task counts a whole minute.  Both keep open minutes only.
    """
    count = lambda c: F.count_if(c)
    per_source = before_end(events.withWatermark(time, delay), time).groupBy(F.window(time, "1 minute"), "src_ip").agg(
        F.count(F.lit(1)).alias("n"), count(F.col("event_type").isin("failed_logon", "successful_logon")).alias("logins"),
        count(F.col("action").isin(fixed.BLOCK_ACTIONS)).alias("denies"), count(F.col("status_code") >= 500).alias("errors"))
    out = per_source.groupBy(F.window(F.window_time("window"), "1 minute").alias("minute")).agg(
        F.sum("n").alias("events_per_minute"), F.sum("logins").alias("logins_per_minute"), F.sum("denies").alias("denies_per_minute"),
        count(F.col("src_ip") != "").alias("unique_src_ips"), F.sum("errors").alias("error_rate"))
    return out.select(F.unix_micros(F.col("minute.start")).alias("bucket"), *baseline.METRICS)


class Baseline(StatefulProcessor):
    """The last values of one metric, which every new one is compared with before it joins them."""

    columns = ["metric", "bucket", "value", "baseline_mean", "baseline_std", "baseline_rows"]

    def __init__(self, window: int):
        self.window = window

    def init(self, handle) -> None:
        self.last = handle.getValueState("last", "values array<double>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = deque(self.last.get()[0] if self.last.exists() else [], maxlen=self.window)
        out = []
        pdf = pd.concat(list(rows))
        for bucket, value in sorted(zip(pdf["bucket"].tolist(), pdf["value"].tolist())):
            apart = [x - last[0] for x in last]                  # exact for counts, as in baseline.spread
            n, total, squares = len(last), sum(apart), sum(x * x for x in apart)
            spread = (max(n * squares - total * total, 0.0) / (n * (n - 1))) ** 0.5 if n > 1 else 0.0
            out.append((key[0], bucket, value, sum(last) / len(last) if last else None, spread, len(last)))
            last.append(value)
        self.last.update((list(last),))
        yield pd.DataFrame(out, columns=self.columns)

    def close(self) -> None:
        pass


def scored_minutes_stream(events: DataFrame, window: int = 60, time: str = "event_time", delay: str = "2 minutes", **options) -> DataFrame:
    """Streaming twin of :func:`vigil.operators.baseline.score_baseline` over closed minutes.

    Minutes go from the aggregation straight to the baseline of their metric, whose last ``window`` values are carried as
    state from batch to batch; no table is read again, and a repeated batch starts from the state before it.
    """
    minutes = baseline.long_metrics(minute_metrics_stream(events, time, delay))
    scored = minutes.groupBy("metric").transformWithStateInPandas(
        Baseline(window), "metric string, bucket bigint, value double, baseline_mean double, baseline_std double, baseline_rows bigint", "Append", "None")
    return baseline.judged(scored, **options)


def baseline_stream(events: DataFrame, table: str, checkpoint: str, on_anomalies, window: int = 60, **options):
    """Append scored minutes to a table and hand over the anomalous ones; a repeated batch overwrites its own part."""
    def batch(scored: DataFrame, batch_id: int) -> None:
        path = f"{table}/batch={batch_id}"
        scored.write.mode("overwrite").parquet(path)
        on_anomalies(baseline.described(scored.sparkSession.read.schema(scored.schema).parquet(path)))

    return (scored_minutes_stream(events, window, **options).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def distinct_incidents(incidents: DataFrame, time: str = "event_time", quiet: str = "1 hour") -> DataFrame:
    """First incident per attack type and source; repeats within the quiet time are dropped."""
    return incidents.withWatermark(time, quiet).dropDuplicatesWithinWatermark(["attack_type", "src_ip"])


def normalized_stream(raw_logs: DataFrame) -> DataFrame:
    """Parsed and enriched events; no state."""
    return enrich.ip_reputation(normalize.normalize_logs(raw_logs))


def single_event_incidents(events: DataFrame) -> DataFrame:
    """Incidents that one event is enough for: listed sources and suspect names."""
    return correlate.malicious_ip_events(events).unionByName(correlate.dns_tunnel_events(events))


# ------------------------------------------------------------------ retraining

def retraining_due(rows: int, last_fit_seconds: float, now_seconds: float, needed: int = 50, every: float = 300) -> bool:
    """Enough new rows and long enough since the last fit."""
    return rows >= needed and now_seconds - last_fit_seconds > every


def feature_stream(features: DataFrame, table: str, checkpoint: str):
    """Append feature rows to a table for the next fit."""
    def batch(rows: DataFrame, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(f"{table}/batch={batch_id}")

    return (features.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def stored_features(spark, table: str, order: str | None = None, n: int | None = None) -> DataFrame:
    """Feature rows to fit on: all of them, or the newest ``n`` by ``order``."""
    rows = spark.read.parquet(table).drop("batch")
    return rows if n is None else rows.orderBy(F.desc(order)).limit(n)
