"""Incidents over normalised events: threshold layers, single-event layers, several vectors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from vigil import fixed, tables
from vigil.operators.enrich import ip_reputation, with_mitre
from vigil.operators.skew import lag_columns, running
from vigil.operators.thresholds import SECOND, first_fire
from vigil.session import durable

INCIDENT = ["attack_type", "severity", "src_ip", "target", "source", "country", "us", "event_id",
            "hits", "description"]


def is_denied():
    return (F.col("source_type") == "firewall") & F.col("action").isin(fixed.BLOCK_ACTIONS)


def is_web_attack():
    return F.col("event_type").isin("injection_attempt", "recon_attempt")


def _details(attack: str, severity, target, source, text, hits="event_count", country="UNKNOWN"):
    """What an incident says besides its source and moment, as a struct."""
    as_col = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(F.lit(attack).alias("attack_type"), as_col(severity).alias("severity"),
                    as_col(target).alias("target"), as_col(source).alias("source"),
                    as_col(country).alias("country"), F.col(hits).cast("int").alias("hits"),
                    text.alias("description"))


def _incident(fires: DataFrame, details) -> DataFrame:
    return fires.select("src_ip", "us", "event_id", details.alias("_i")) \
        .select("src_ip", "us", "event_id", "_i.*").select(*INCIDENT)


def _brute_force():
    text = F.concat(F.lit("Brute Force Attack: "), F.col("event_count").cast("string"),
                    F.lit(" failed logins from "), "src_ip", F.lit(" targeting '"), "username", F.lit("'"))
    return _details("brute_force", "Critical", F.col("username"), "active_directory", text)


def _port_scan():
    ports = F.col("distinct_values")
    severity = F.when(ports > 15, "Critical").when(ports > 8, "High").otherwise("Medium")
    text = F.concat(F.lit("Port Scan Detected: "), F.col("event_count").cast("string"),
                    F.lit(" blocked connections from "), "src_ip", F.lit(" ("), ports.cast("string"),
                    F.lit(" unique ports)"))
    return _details("port_scan", severity, F.col("dst_ip"), "firewall", text)


def _vpn_brute_force():
    text = F.concat(F.lit("VPN Brute Force: "), F.col("event_count").cast("string"),
                    F.lit(" failed attempts from "), "src_ip")
    return _details("vpn_brute_force", "High", "VPN Gateway", "vpn", text)


def _web_attack():
    text = F.concat(F.lit("Web Application Attack: "), F.col("event_count").cast("string"),
                    F.lit(" malicious requests from "), "src_ip", F.lit(" (last: "),
                    F.substring("uri", 1, 60), F.lit(")"))
    return _details("sql_injection", "Critical", F.col("dst_ip"), "web_server", text)


def brute_force(events: DataFrame, threshold: int = fixed.BRUTE_FORCE[0],
                window_us: int = fixed.BRUTE_FORCE[1] * SECOND) -> DataFrame:
    """Failed logons of one source."""
    return _incident(first_fire(events.where(F.col("event_type") == "failed_logon"), "src_ip",
                                threshold, window_us, keep=["username"]), _brute_force())


def port_scan(events: DataFrame, threshold: int = fixed.PORT_SCAN[0],
              window_us: int = fixed.PORT_SCAN[1] * SECOND) -> DataFrame:
    """Blocked connections of one source; the severity follows the number of different ports."""
    return _incident(first_fire(events.where(is_denied()), "src_ip", threshold, window_us,
                                keep=["dst_ip"], distinct="dst_port"), _port_scan())


def vpn_brute_force(events: DataFrame, threshold: int = fixed.VPN_FAIL[0],
                    window_us: int = fixed.VPN_FAIL[1] * SECOND) -> DataFrame:
    return _incident(first_fire(events.where(F.col("event_type") == "vpn_auth_fail"), "src_ip",
                                threshold, window_us), _vpn_brute_force())


def web_attack(events: DataFrame, threshold: int = fixed.WEB_ATTACK[0],
               window_us: int = fixed.WEB_ATTACK[1] * SECOND) -> DataFrame:
    return _incident(first_fire(events.where(is_web_attack()), "src_ip", threshold, window_us,
                                keep=["uri", "dst_ip"]), _web_attack())


def dns_tunnel_events(events: DataFrame) -> DataFrame:
    """Every suspect query as an incident."""
    rows = events.where(F.col("event_type") == "dns_tunnel_suspect").withColumn("event_count", F.lit(1))
    text = F.concat(F.lit("Potential DNS Tunneling: Unusually long domain query from "), "src_ip",
                    F.lit(" ("), F.substring("domain", 1, 40), F.lit("...)"))
    return _incident(rows, _details("dns_tunnel", "High", "DNS Server", "dns", text))


def malicious_ip_events(events: DataFrame) -> DataFrame:
    """Every event of a listed source as an incident."""
    rows = ip_reputation(events).where(~F.col("safe")).withColumn("event_count", F.lit(1))
    text = F.concat(F.lit("Traffic from known malicious IP: "), "src_ip", F.lit(" ("), "threat_type", F.lit(")"))
    return _incident(rows, _details("malicious_ip", "High", F.col("dst_ip"), F.col("source_type"), text,
                                    country=F.col("country")))


def first_per_source(incidents: DataFrame) -> DataFrame:
    """One incident per attack type and source: the earliest."""
    rest = [c for c in incidents.columns if c not in ("attack_type", "src_ip")]
    return (incidents.groupBy("attack_type", "src_ip")
            .agg(F.min_by(F.struct(*rest), F.struct("us", "event_id")).alias("_i"))
            .select("attack_type", "src_ip", "_i.*").select(*incidents.columns))


# layer, rows that make a vector suspicious
VECTOR_ROWS = {"login": 2, "deny": 3, "web": 1, "vpn": 1}
# layer -> rows that fire, window in seconds
LAYERS = {"login": fixed.BRUTE_FORCE, "deny": fixed.PORT_SCAN, "web": fixed.WEB_ATTACK, "vpn": fixed.VPN_FAIL}


def _by_layer(values: dict):
    column = None
    for name, value in values.items():
        test = F.col("layer") == name
        column = F.when(test, value) if column is None else column.when(test, value)
    return column


def layer_rows(events: DataFrame, layers=None) -> tuple[DataFrame, DataFrame]:
    """First and last rows of every (layer, source, window-long cell), for all four layers at once.

    Nothing else can complete a threshold or open or prolong an active span, see
    :func:`vigil.operators.thresholds.first_fire`.  Both limits are applied by every task to its
    own rows before the shuffle, so a busy source never gathers.
    """
    layers = layers or LAYERS
    layer = (F.when(F.col("event_type") == "failed_logon", "login").when(is_denied(), "deny")
             .when(is_web_attack(), "web").when(F.col("event_type") == "vpn_auth_fail", "vpn"))
    width = _by_layer({n: int(w * SECOND) for n, (_, w) in layers.items()})
    depth = max([n for n, _ in layers.values()] + list(VECTOR_ROWS.values()))
    rows = (events.withColumn("layer", layer).where("layer IS NOT NULL AND src_ip <> ''")
            .select("layer", "src_ip", "us", "event_id", "username", "dst_ip", "dst_port", "uri")
            .withColumn("_cell", F.floor(F.col("us") / width)))
    cell = Window.partitionBy("layer", "src_ip", "_cell")
    up, down = cell.orderBy("us", "event_id"), cell.orderBy(F.desc("us"), F.desc("event_id"))
    head = rows.withColumn("_n", F.row_number().over(up)).where(F.col("_n") <= depth).drop("_n")
    tail = rows.withColumn("_n", F.row_number().over(down)).where(F.col("_n") <= 2 * depth - 1).drop("_n")
    return head, tail


def layer_fires(events: DataFrame, layers=None) -> DataFrame:
    """First fire per layer and source: what :func:`first_fire` gives, for all layers in one pass."""
    layers = layers or LAYERS
    head, tail = layer_rows(events, layers)
    both = (head.withColumn("_own", F.lit(True))
            .unionByName(tail.withColumn("_cell", F.col("_cell") + 1).withColumn("_own", F.lit(False))))
    order = Window.partitionBy("layer", "src_ip", "_cell").orderBy("us", "event_id")
    since = _by_layer({n: F.lag("us", k - 1).over(order) if k > 1 else F.col("us") for n, (k, _) in layers.items()})
    width = _by_layer({n: int(w * SECOND) for n, (_, w) in layers.items()})
    ports = F.size(F.collect_set("dst_port").over(order.rowsBetween(-(layers["deny"][0] - 1), 0)))
    fired = (both.withColumns({"_since": since, "distinct_values": ports})
             .where(F.col("_own") & (F.col("us") - F.col("_since") <= width)))
    values = ["us", "event_id", "username", "dst_ip", "uri", "distinct_values"]
    return (fired.groupBy("layer", "src_ip")
            .agg(F.min_by(F.struct(*values), F.struct("us", "event_id")).alias("_f"))
            .select("layer", "src_ip", "_f.*")
            .withColumn("event_count", _by_layer({n: F.lit(k) for n, (k, _) in layers.items()})))


def multi_vector(events: DataFrame, needed: int = 3, layers=None) -> DataFrame:
    """First moment at which a source is suspicious in ``needed`` of the four vectors.

    A vector is active from the row that completes its count until the oldest of those rows leaves
    the window; the moments that matter are the starts of such spans.
    """
    layers = layers or LAYERS
    head, tail = layer_rows(events, layers)
    columns = ["layer", "src_ip", "us", "event_id"]
    kept = durable(head.select(*columns).unionByName(tail.select(*columns)).distinct().withColumn("_key", F.concat_ws("|", "layer", "src_ip")))
    back = lag_columns(kept, "_key", ["us", "event_id"], {f"_back{k}": ("us", k - 1) for k in set(VECTOR_ROWS.values()) if k > 1})
    since = _by_layer({n: F.col(f"_back{k}") if k > 1 else F.col("us") for n, k in VECTOR_ROWS.items()})
    width = _by_layer({n: int(w * SECOND) for n, (_, w) in layers.items()})
    spans = (back.withColumn("_since", since).where(F.col("us") - F.col("_since") <= width)
             .select(*columns, (F.col("_since") + width).alias("_until")))
    # spans of a layer end in the order in which they start, so the last end so far is the largest
    ends = running(spans, "src_ip", ["us", "event_id", "layer"], F.max, {f"_{n}": F.when(F.col("layer") == n, F.col("_until")) for n in layers})
    moments = ends.groupBy("src_ip", "us").agg(F.min("event_id").alias("event_id"), *[F.max(f"_{n}").alias(f"_{n}") for n in layers])
    active = sum((F.coalesce((F.col(f"_{n}") >= F.col("us")).cast("int"), F.lit(0)) for n in layers), F.lit(0))
    hits = moments.withColumn("vectors", active).where(F.col("vectors") >= needed)
    return (hits.groupBy("src_ip").agg(F.min_by(F.struct("us", "event_id", "vectors"),
                                                F.struct("us", "event_id")).alias("_f"))
            .select("src_ip", "_f.*"))


def multi_vector_incidents(events: DataFrame, **options) -> DataFrame:
    fires = multi_vector(events, **options).withColumn("event_count", F.col("vectors"))
    text = F.concat(F.lit("Multi-Vector Attack: IP "), "src_ip", F.lit(" flagged across "),
                    F.col("vectors").cast("string"), F.lit(" different attack vectors"))
    return _incident(fires, _details("lateral_movement", "Critical", "Enterprise Network",
                                     "cross_correlation", text))


def without_first_listed(events: DataFrame) -> DataFrame:
    """Drop the first event of every listed source: it ends at the intelligence layer."""
    first = (ip_reputation(events.select("src_ip", "us", "event_id")).where(~F.col("safe"))
             .groupBy(F.col("src_ip").alias("_ip")).agg(F.min(F.struct("us", "event_id")).alias("_first")))
    return (events.join(tables.bounded_broadcast(first), F.col("src_ip") == F.col("_ip"), "left")
            .where("_first IS NULL OR _first <> struct(us, event_id)").drop("_ip", "_first"))


def incidents(events: DataFrame, layers=None) -> DataFrame:
    """All layers, one incident per attack type and source, with its technique.

    ``layers`` maps login, deny, web and vpn to ``(rows, seconds)``.  The four thresholds and the
    vectors read the same reduced rows, so their shuffles are shared.
    """
    seen = without_first_listed(events)
    thresholds = (layer_fires(seen, layers).withColumn("_i", _by_layer(
        {"login": _brute_force(), "deny": _port_scan(), "web": _web_attack(), "vpn": _vpn_brute_force()}))
        .select("src_ip", "us", "event_id", "_i.*").select(*INCIDENT))
    single = first_per_source(malicious_ip_events(events).unionByName(dns_tunnel_events(seen)))
    return with_mitre(reduce(DataFrame.unionByName, [
        thresholds, multi_vector_incidents(seen, layers=layers), single]))


def tactic_summary(found: DataFrame) -> DataFrame:
    return (found.groupBy(F.coalesce("mitre_tactic", F.lit("Unknown")).alias("tactic"))
            .agg(F.count(F.lit(1)).alias("detections")))


def technique_summary(found: DataFrame) -> DataFrame:
    return (found.where("mitre_technique IS NOT NULL")
            .groupBy(F.col("mitre_technique").alias("technique"), F.col("mitre_tactic").alias("tactic"),
                     F.col("mitre_name").alias("name"))
            .agg(F.count(F.lit(1)).alias("count")))


def severity_counts(found: DataFrame) -> DataFrame:
    return found.agg(F.count(F.lit(1)).alias("alerts"),
                     F.count_if(F.col("severity") == "Critical").alias("critical"),
                     F.count_if(F.col("severity") == "High").alias("high"))
