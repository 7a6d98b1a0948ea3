"""Connection states of packets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from vigil import fixed
from vigil.operators.skew import per_key


def connection_key() -> Column:
    """Key shared by both directions: the smaller (address, port) pair first, addresses as text."""
    a = F.concat("src_ip", F.lit(":"), F.col("src_port").cast("string"))
    b = F.concat("dst_ip", F.lit(":"), F.col("dst_port").cast("string"))
    forward = (F.col("src_ip") < F.col("dst_ip")) | ((F.col("src_ip") == F.col("dst_ip"))
                                                     & (F.col("src_port") <= F.col("dst_port")))
    return F.concat_ws("-", F.when(forward, a).otherwise(b), F.when(forward, b).otherwise(a), F.col("protocol"))


def forward_key() -> Column:
    return F.concat("src_ip", F.lit(":"), F.col("src_port").cast("string"), F.lit("->"), "dst_ip", F.lit(":"),
                    F.col("dst_port").cast("string"), F.lit("-"), "protocol")


def track(packets: DataFrame, us: str = "us", packet_id: str = "packet_id", expire: bool = False) -> DataFrame:
    """Add ``conn_key``, ``conn_state`` (answer for the packet), ``tracked`` and ``is_reply``.

    With ``expire`` a connection that was silent for too long is gone when the next packet comes; see
    :func:`vigil.operators.expiry.track`.  Otherwise a connection lasts for ever.

    The states of a connection only ever move forward, so a connection is described by the moments
    at which it reaches each of them, and a moment is the earliest packet that fits after the one
    before: a chain of per-key minima.  No packet sequence has to be replayed, and a connection of
    any size is handled by aggregation (see :func:`vigil.operators.skew.per_key`).
    """
    if expire:
        from vigil.operators import expiry
        return expiry.track(packets, us, packet_id)
    flag = {f: F.array_contains("tcp_flags", f) for f in ("SYN", "ACK", "FIN", "RST")}
    at = F.col("_at")
    tcp = F.col("protocol") == "TCP"
    reply = F.col("is_reply")

    def moments(rows: DataFrame, least) -> DataFrame:
        opens = F.when(tcp, flag["SYN"] & ~flag["ACK"]).otherwise(F.col("protocol").isin("UDP", "ICMP"))
        rows = least(rows, "_t0", F.when(opens, at))
        ends = F.struct("src_ip", "src_port", "dst_ip", "dst_port")
        rows = least(rows, "_open", F.when(at == F.col("_t0"), ends))
        # an ICMP connection is stored with port 0
        port = F.when(F.col("protocol") == "ICMP", F.lit(0)).otherwise(F.col("_open.dst_port"))
        rows = rows.withColumn("is_reply", F.coalesce(
            (F.col("src_ip") == F.col("_open.dst_ip")) & (F.col("src_port") == port), F.lit(False)))
        rows = least(rows, "_reset", F.when(tcp & flag["RST"] & (at > F.col("_t0")), at))
        rows = least(rows, "_t1", F.when(tcp & reply & flag["SYN"] & flag["ACK"] & (at > F.col("_t0")), at))
        rows = least(rows, "_t2", F.when(F.when(tcp, ~reply & flag["ACK"] & (at > F.col("_t1")))
                                         .otherwise(reply & (at > F.col("_t0"))), at))
        rows = least(rows, "_t3", F.when(tcp & flag["FIN"] & (at > F.col("_t2")), at))
        rows = least(rows, "_t4", F.when(tcp & flag["ACK"] & (at > F.col("_t3")),
                                         F.struct(F.col("_at").alias("at"), flag["FIN"].alias("fin"))))
        return least(rows, "_t5", F.when(tcp & flag["FIN"] & (at > F.col("_t4.at")), at))

    keyed = packets.withColumns({"conn_key": connection_key(), "_at": F.struct(us, packet_id)})
    rows = per_key(keyed, "conn_key", moments)
    past = lambda name: F.coalesce(at >= F.col(name), F.lit(False))
    tracked = past("_t0")
    tcp_state = (F.when(past("_reset"), "CLOSED")
                 .when(past("_t5"), "CLOSED")
                 .when(past("_t4.at"), F.when(F.col("_t4.fin"), "CLOSED").otherwise("CLOSE_WAIT"))
                 .when(past("_t3"), "FIN_WAIT").when(past("_t2"), "ESTABLISHED")
                 .when(past("_t1"), "SYN_RECV").otherwise("SYN_SENT"))
    stored = F.when(tcp, tcp_state).otherwise(F.when(past("_t2"), "ESTABLISHED").otherwise("NEW"))
    answer = (F.when(~tracked & tcp, "INVALID").when(~tracked, "NEW")
              .when(at == F.col("_t0"), "NEW").otherwise(F.col("_stored")))
    return (rows.withColumns({"tracked": tracked, "_stored": stored})
            .withColumns({"conn_state": answer, "is_reply": F.col("is_reply") & F.col("tracked")
                          & (at != F.coalesce(F.col("_t0"), at))})
            .withColumn("stored_state", F.when(F.col("tracked"), F.col("_stored")))
            .drop("_at", "_t0", "_open", "_reset", "_t1", "_t2", "_t3", "_t4", "_t5", "_stored"))


def connection_table(tracked: DataFrame, us: str = "us", packet_id: str = "packet_id") -> DataFrame:
    """One row per stored connection: ends, state, first and last packet, traffic per direction."""
    at = F.struct(us, packet_id)
    out, back = ~F.col("is_reply"), F.col("is_reply")
    port = lambda name: F.when(F.col("protocol") == "ICMP", 0).otherwise(F.col(name))
    return (tracked.where("tracked").groupBy("conn_key", "protocol")
            .agg(F.min_by(F.struct("src_ip", port("src_port").alias("src_port"), "dst_ip",
                                   port("dst_port").alias("dst_port")), at).alias("_o"),
                 F.max_by("stored_state", at).alias("state"),
                 F.min(us).alias("created_us"), F.max(us).alias("last_seen_us"),
                 F.count_if(back).alias("packets_in"), F.count_if(out).alias("packets_out"),
                 F.sum(F.when(back, F.col("size")).otherwise(0)).alias("bytes_in"),
                 F.sum(F.when(out, F.col("size")).otherwise(0)).alias("bytes_out"))
            .select("conn_key", "protocol", "_o.*", "state", "created_us", "last_seen_us", "packets_in",
                    "packets_out", "bytes_in", "bytes_out"))


def idle_limit() -> Column:
    """Seconds a stored connection may stay silent in its state; closed ones go at once."""
    state = F.col("state")
    tcp = (F.when(state == "CLOSED", -1).when(state.isin("SYN_SENT", "SYN_RECV"), fixed.TCP_SYN_TIMEOUT)
           .when(state.isin("FIN_WAIT", "CLOSE_WAIT"), fixed.TCP_FIN_TIMEOUT)
           .otherwise(fixed.TCP_ESTABLISHED_TIMEOUT))
    return F.when(F.col("protocol") == "TCP", tcp).otherwise(fixed.UDP_TIMEOUT)


def with_age(table: DataFrame, as_of: Column) -> DataFrame:
    """Add age and silence in seconds (1 digit) and ``expired`` at the moment ``as_of`` (microseconds)."""
    seconds = lambda name: (as_of - F.col(name)) / 1e6
    return table.withColumns({"age_seconds": F.round(seconds("created_us"), 1),
                              "last_seen_ago": F.round(seconds("last_seen_us"), 1),
                              "expired": seconds("last_seen_us") > idle_limit()})


def state_distribution(table: DataFrame) -> DataFrame:
    return table.groupBy("state").agg(F.count(F.lit(1)).alias("connections"))


def established_packets(packets: DataFrame, table: DataFrame) -> DataFrame:
    """Packets of connections whose stored state is ESTABLISHED."""
    keys = table.where(F.col("state") == "ESTABLISHED").select("conn_key")
    return packets.withColumn("conn_key", connection_key()).join(keys, "conn_key", "left_semi")
