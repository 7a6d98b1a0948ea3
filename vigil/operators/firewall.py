"""Firewall decisions and their reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from vigil import fixed, tables
from vigil.operators.conntrack import track
from vigil.operators.netjoin import match_networks
from vigil.operators.rules import apply_rules


def with_zone(df: DataFrame, ip: str, name: str, zones: DataFrame | None = None) -> DataFrame:
    """Add the zone of an address: highest trust first, ``untrusted`` when no network fits."""
    zones = tables.zones(df.sparkSession) if zones is None else zones
    inner = zones.where(F.col("zone") != "untrusted").select(F.col("zone").alias(name), "trust", "cidr")
    return match_networks(df, ip, inner, [name], "trust").withColumn(name, F.coalesce(name, F.lit("untrusted")))


def with_zone_policy(df: DataFrame, policies: DataFrame | None = None) -> DataFrame:
    """Add ``zone_policy`` of the zone pair: same zone ALLOW, listed pair, else DENY."""
    policies = tables.zone_policies(df.sparkSession) if policies is None else policies
    listed = tables.bounded_broadcast(policies.select(F.col("src_zone").alias("_s"), F.col("dst_zone").alias("_d"),
                                                      F.col("default_action").alias("_a")))
    return (df.join(listed, (F.col("zone_src") == F.col("_s")) & (F.col("zone_dst") == F.col("_d")), "left")
            .withColumn("zone_policy", F.when(F.col("zone_src") == F.col("zone_dst"), "ALLOW")
                        .otherwise(F.coalesce("_a", F.lit("DENY")))).drop("_s", "_d", "_a"))


def zone_matrix(traffic: DataFrame, zones: DataFrame | None = None) -> DataFrame:
    """All zone pairs as a matrix of policies (SELF on the diagonal) with the packets seen per source."""
    spark = traffic.sparkSession
    zones = tables.zones(spark) if zones is None else zones
    names = sorted({r["zone"] for r in zones.select("zone").collect()})
    pairs = (zones.select(F.col("zone").alias("zone_src")).distinct()
             .withColumn("zone_dst", F.explode(F.array(*[F.lit(n) for n in names]))))
    cells = with_zone_policy(pairs).withColumn(
        "cell", F.when(F.col("zone_src") == F.col("zone_dst"), "SELF").otherwise(F.col("zone_policy")))
    seen = traffic.groupBy("zone_src").agg(F.count(F.lit(1)).alias("packets"))
    matrix = cells.groupBy("zone_src").pivot("zone_dst", names).agg(F.first("cell"))
    return matrix.join(seen, "zone_src", "left").fillna(0, ["packets"])


def reason_text(default_policy: str = fixed.DEFAULT_POLICY) -> Column:
    """Why a packet was decided as it was."""
    rule = F.col("rule_id")
    return (F.when(F.col("conn_state") == "ESTABLISHED", "Stateful: ESTABLISHED connection")
            .when(F.col("conn_state") == "INVALID", "Stateful: INVALID packet (no matching connection)")
            .when(rule > 0, F.concat(F.lit("Rule #"), rule.cast("string"), F.lit(": "), "rule_name"))
            .when((F.col("zone_policy") == "DENY") & (F.col("rule_action") == "DENY"),
                  F.concat(F.lit("Zone policy: "), "zone_src", F.lit(" -> "), "zone_dst", F.lit(" = DENY")))
            .otherwise(F.lit(f"Default policy: {default_policy}")))


def decide(packets: DataFrame, rules: DataFrame | None = None, default_policy: str = fixed.DEFAULT_POLICY,
           stateful: bool = True) -> DataFrame:
    """Zones, zone policy, connection state, rules, default: the action and reason of every packet.

    The zone policy only words the reason.  One shuffle on the connection key; zones, policies and
    rules are expressions or small broadcast tables.
    """
    seen = track(packets) if stateful else packets.withColumn("conn_state", F.lit(None).cast("string"))
    zoned = with_zone_policy(with_zone(with_zone(seen, "src_ip", "zone_src"), "dst_ip", "zone_dst"))
    ruled = apply_rules(zoned, rules, default_policy)
    state = F.coalesce(F.col("conn_state"), F.lit(""))
    by_state = state.isin("ESTABLISHED", "INVALID")
    return ruled.withColumns({
        "action": F.when(state == "ESTABLISHED", "ALLOW").when(state == "INVALID", "DROP")
        .otherwise(F.col("rule_action")),
        "reason": reason_text(default_policy),
        "rule_id": F.when(by_state, F.lit(None).cast("int")).otherwise(F.col("rule_id")),
        "rule_name": F.when(by_state, F.lit("")).otherwise(F.col("rule_name"))})


def totals(decided: DataFrame, us: str = "us") -> DataFrame:
    """Packet totals and rates; LOG counts as allowed.  Up-time is the time the packets span."""
    action, n = F.col("action"), F.col("total_packets")
    rate = lambda name: F.round(F.col(name) / F.greatest(n, F.lit(1)) * 100, 1)
    return (decided.agg(F.count(F.lit(1)).alias("total_packets"),
                        F.count_if(action.isin("ALLOW", "LOG")).alias("allowed"),
                        F.count_if(action == "DENY").alias("denied"),
                        F.count_if(action == "DROP").alias("dropped"),
                        F.count_if(action == "LOG").alias("logged"),
                        F.count_if(F.col("conn_state") == "INVALID").alias("invalid_state"),
                        ((F.max(us) - F.min(us)) / 1e6).alias("_up"))
            .withColumns({"packets_per_second": F.round(n / F.greatest(F.col("_up"), F.lit(1.0)), 4),
                          "allow_rate": rate("allowed"), "deny_rate": rate("denied"), "drop_rate": rate("dropped")})
            .drop("_up"))


def newest(df: DataFrame, n: int, us: str = "us", row_id: str = "packet_id") -> DataFrame:
    """The ``n`` newest rows; each task keeps its own ``n`` before they are merged."""
    return df.orderBy(F.desc(us), F.desc(row_id)).limit(n)


def _recent(decided: DataFrame, rows: int | None) -> DataFrame:
    return decided if rows is None else newest(decided, rows)


def log_summary(decided: DataFrame, rows: int | None = None) -> DataFrame:
    """Counts by action, by protocol and by zone pair over all or the newest ``rows`` rows, in one pass."""
    recent = _recent(decided, rows).select(
        "action", "protocol", F.concat("zone_src", F.lit(" -> "), "zone_dst").alias("zone_pair"))
    sets = [["action"], ["protocol"], ["zone_pair"]]
    grouped = recent.groupingSets([[F.col(c) for c in s] for s in sets], "action", "protocol", "zone_pair")
    return grouped.agg(F.count(F.lit(1)).alias("packets")).select(
        F.when(F.col("action").isNotNull(), "action").when(F.col("protocol").isNotNull(), "protocol")
        .otherwise("zone_pair").alias("grouping"),
        F.coalesce("action", "protocol", "zone_pair").alias("value"), "packets")


def top_talkers(decided: DataFrame, rows: int | None = None, n: int = 10) -> DataFrame:
    """Ten busiest sources and ten busiest ``port/protocol`` targets of all or the newest ``rows`` rows.

    Sources and targets carry no verdict, so the decision columns are never computed for them.
    """
    recent = _recent(decided, rows)

    def top(kind, value):
        return (recent.groupBy(value.alias("value")).agg(F.count(F.lit(1)).alias("packets"))
                .orderBy(F.desc("packets"), "value").limit(n).select(F.lit(kind).alias("kind"), "value", "packets"))

    port = F.concat(F.col("dst_port").cast("string"), F.lit("/"), "protocol")
    return top("src_ip", F.col("src_ip")).unionByName(top("dst_port", port))


def recent_denies(decided: DataFrame, rows: int | None = None, n: int = 20) -> DataFrame:
    """Last blocked packets among all or the newest ``rows`` rows."""
    blocked = _recent(decided, rows).where(F.col("action").isin("DENY", "DROP"))
    end = lambda a, b: F.concat(F.col(a), F.lit(":"), F.col(b).cast("string"))
    return newest(blocked, n).select("packet_id", "us", end("src_ip", "src_port").alias("src"),
                                     end("dst_ip", "dst_port").alias("dst"), "protocol", "reason")


def log_lines(decided: DataFrame) -> DataFrame:
    """Fixed-width log line of every decision."""
    line = F.format_string("%s %5s %4s %15s:%-5s -> %15s:%-5s zone=%s->%s state=%s rule=%s | %s",
                           "timestamp", "action", "protocol", "src_ip", F.col("src_port").cast("string"),
                           "dst_ip", F.col("dst_port").cast("string"), "zone_src", "zone_dst",
                           F.coalesce("conn_state", F.lit("None")),
                           F.coalesce(F.col("rule_id").cast("string"), F.lit("None")), "reason")
    return decided.select("packet_id", line.alias("line"))
