"""Threshold, incident and baseline queries."""

from pyspark.sql import functions as F

from vigil import fixed
from vigil.catalog.registry import query, quote, rows
from vigil.operators import baseline as B
from vigil.operators import correlate as C
from vigil.operators import thresholds as H
from vigil.operators.enrich import with_mitre

DAY = 86_400
# The driver events are spread over thirty days, so the windows are counted in days here.
BRUTE, SCAN, VPN, WEB = (5, 4 * DAY), (8, 12 * DAY), (3, 2 * DAY), (3, 2 * DAY)
LAYERS = {"login": BRUTE, "deny": SCAN, "web": WEB, "vpn": VPN}
VECTORS = [(name, C.VECTOR_ROWS[name], seconds) for name, (_, seconds) in LAYERS.items()]
DENIED = "source_type = 'firewall' AND action IN ('DENY', 'DROP', 'REJECT')"
WEBBED = "event_type IN ('injection_attempt', 'recon_attempt')"


def first(where, n, seconds, extra="", source="@events"):
    """First row per source whose (n-1)-th predecessor lies in the window."""
    w = "PARTITION BY src_ip ORDER BY us, event_id"
    return f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src_ip ORDER BY us, event_id) AS nth FROM (
  SELECT *, lag(us, {n - 1}) OVER ({w}) AS since{extra.replace('{w}', w)} FROM {source} e WHERE {where}) a WHERE us - since <= {int(seconds * 1000000)}) b WHERE nth = 1"""


def incident(attack, severity, target, source, text, hits, frm, country="'UNKNOWN'"):
    return (f"SELECT '{attack}' AS attack_type, {severity} AS severity, src_ip, {target} AS target, {source} AS source, {country} AS country, "
            f"us, event_id, CAST({hits} AS INTEGER) AS hits, {text} AS description FROM ({frm}) f")


def brute(source="@events"):
    return incident("brute_force", "'Critical'", "username", "'active_directory'",
                    "'Brute Force Attack: 5 failed logins from ' || src_ip || ' targeting ''' || username || ''''", 5,
                    first("event_type = 'failed_logon'", *BRUTE, source=source))


def scan(source="@events"):
    ports = ", len(list_distinct(list(dst_port) OVER ({w} ROWS BETWEEN 7 PRECEDING AND CURRENT ROW))) AS ports"
    return incident("port_scan", "CASE WHEN ports > 15 THEN 'Critical' WHEN ports > 8 THEN 'High' ELSE 'Medium' END", "dst_ip", "'firewall'",
                    "'Port Scan Detected: 8 blocked connections from ' || src_ip || ' (' || ports || ' unique ports)'", 8,
                    first(DENIED, *SCAN, extra=ports, source=source))


def vpn(source="@events"):
    return incident("vpn_brute_force", "'High'", "'VPN Gateway'", "'vpn'", "'VPN Brute Force: 3 failed attempts from ' || src_ip", 3,
                    first("event_type = 'vpn_auth_fail'", *VPN, source=source))


def web(source="@events"):
    return incident("sql_injection", "'Critical'", "dst_ip", "'web_server'",
                    "'Web Application Attack: 3 malicious requests from ' || src_ip || ' (last: ' || substr(uri, 1, 60) || ')'", 3,
                    first(WEBBED, *WEB, source=source))


def dns(source="@events"):
    return incident("dns_tunnel", "'High'", "'DNS Server'", "'dns'",
                    "'Potential DNS Tunneling: Unusually long domain query from ' || src_ip || ' (' || substr(domain, 1, 40) || '...)'", 1,
                    f"SELECT * FROM {source} e WHERE event_type = 'dns_tunnel_suspect'")


THREATS = rows([(r[0], r[2], r[3]) for r in fixed.THREAT_IPS])


def malicious(source="@events"):
    return incident("malicious_ip", "'High'", "dst_ip", "source_type", "'Traffic from known malicious IP: ' || src_ip || ' (' || kind || ')'", 1,
                    f"SELECT e.*, t.kind, t.country FROM {source} e JOIN (VALUES {THREATS}) t(ip, kind, country) ON t.ip = e.src_ip", "country")


def vectors(source="@events"):
    parts = {"login": "event_type = 'failed_logon'", "deny": DENIED, "web": WEBBED, "vpn": "event_type = 'vpn_auth_fail'"}
    counts = " + ".join(f"CAST(count(*) FILTER (WHERE {parts[n]}) OVER (PARTITION BY src_ip ORDER BY us RANGE BETWEEN {int(s * 1000000)} PRECEDING AND CURRENT ROW) >= {k} AS INTEGER)"
                        for n, k, s in VECTORS)
    return f"""SELECT src_ip, us, event_id, CAST(vectors AS INTEGER) AS vectors FROM (SELECT *, row_number() OVER (PARTITION BY src_ip ORDER BY us, event_id) AS nth FROM (
 SELECT *, {counts} AS vectors FROM {source} e) a WHERE vectors >= 3 AND ({' OR '.join(parts.values())})) b WHERE nth = 1"""


def multi(source="@events"):
    return incident("lateral_movement", "'Critical'", "'Enterprise Network'", "'cross_correlation'",
                    "'Multi-Vector Attack: IP ' || src_ip || ' flagged across ' || vectors || ' different attack vectors'", "vectors", vectors(source))


def micros(pair):
    return pair[0], int(pair[1] * 1_000_000)


MITRE = rows(fixed.MITRE)


@query("f1_brute_force", f"""SELECT i.*, m.tactic AS mitre_tactic, m.technique AS mitre_technique, m.name AS mitre_name FROM ({brute()}) i
 LEFT JOIN (VALUES {MITRE}) m(attack, tactic, technique, name) ON m.attack = i.attack_type""")
def _(view):
    return with_mitre(C.brute_force(view("events"), *micros(BRUTE)))


@query("f2_port_scan", scan())
def _(view):
    return C.port_scan(view("events"), *micros(SCAN))


@query("f3_vpn_brute_force", vpn())
def _(view):
    return C.vpn_brute_force(view("events"), *micros(VPN))


@query("f4_web_attack", web())
def _(view):
    return C.web_attack(view("events"), *micros(WEB))


@query("f5_dns_tunnel", dns())
def _(view):
    return C.dns_tunnel_events(view("events"))


@query("f6_malicious_ip", malicious())
def _(view):
    return C.malicious_ip_events(view("events"))


@query("f7_first_incidents", f"""SELECT * EXCLUDE (nth) FROM (SELECT *, row_number() OVER (PARTITION BY attack_type, src_ip ORDER BY us, event_id) AS nth
 FROM ({malicious()} UNION ALL {dns()}) u) x WHERE nth = 1""")
def _(view):
    e = view("events")
    return C.first_per_source(C.malicious_ip_events(e).unionByName(C.dns_tunnel_events(e)))


@query("f8_multi_vector", vectors())
def _(view):
    return C.multi_vector(view("events"), layers=LAYERS)


@query("d20_suspicious_vectors", multi())
def _(view):
    return C.multi_vector_incidents(view("events"), layers=LAYERS)


_ALL = f"""WITH listed AS (SELECT e.src_ip, min((e.us, e.event_id)) AS f FROM @events e JOIN (VALUES {THREATS}) t(ip, kind, country) ON t.ip = e.src_ip GROUP BY 1),
 seen AS (SELECT e.* FROM @events e LEFT JOIN listed l ON l.src_ip = e.src_ip WHERE l.f IS NULL OR l.f <> (e.us, e.event_id)),
 layers AS ({' UNION ALL '.join([malicious(), brute('seen'), scan('seen'), vpn('seen'), web('seen'), dns('seen'), multi('seen')])}),
 kept AS (SELECT * EXCLUDE (nth) FROM (SELECT *, row_number() OVER (PARTITION BY attack_type, src_ip ORDER BY us, event_id) AS nth FROM layers) x WHERE nth = 1),
 incidents AS (SELECT k.*, m.tactic AS mitre_tactic, m.technique AS mitre_technique, m.name AS mitre_name FROM kept k LEFT JOIN (VALUES {MITRE}) m(attack, tactic, technique, name) ON m.attack = k.attack_type)"""


def all_incidents(view):
    return C.incidents(view("events"), LAYERS)


@query("j3_siem_incidents", _ALL + " SELECT * FROM incidents")
def _(view):
    return all_incidents(view)


@query("e1_tactics", _ALL + " SELECT coalesce(mitre_tactic, 'Unknown') AS tactic, count(*) AS detections FROM incidents GROUP BY 1")
def _(view):
    return C.tactic_summary(all_incidents(view))


_TECH = " SELECT mitre_technique AS technique, mitre_tactic AS tactic, mitre_name AS name, count(*) AS count FROM incidents WHERE mitre_technique IS NOT NULL GROUP BY 1, 2, 3"


@query("e2_techniques", _ALL + _TECH)
def _(view):
    return C.technique_summary(all_incidents(view))


@query("s6_techniques_by_count", _ALL + _TECH + " ORDER BY count DESC, technique")
def _(view):
    return C.technique_summary(all_incidents(view)).orderBy(F.desc("count"), "technique")


@query("e3_severity_counts", _ALL + """ SELECT count(*) AS alerts, count(*) FILTER (WHERE severity = 'Critical') AS critical,
 count(*) FILTER (WHERE severity = 'High') AS high FROM incidents""")
def _(view):
    return C.severity_counts(all_incidents(view))


_LINES = " || '|' || ".join(f"coalesce({c}, '')" for c in ("attack_type", "severity", "src_ip", "description"))


@query("x19_descriptions", _ALL + f" SELECT event_id, {_LINES} AS line FROM incidents")
def _(view):
    return all_incidents(view).select("event_id", F.concat_ws("|", "attack_type", "severity", "src_ip", "description").alias("line"))


RULES = [("R001", "Brute Force Attack", "action", "LOGIN_FAILED", "src_ip", 5, 4 * DAY, "CRITICAL",
          "Multiple failed login attempts from a single source."),
         ("R002", "Port Scan Detected", "action", "DENY", "src_ip", 10, 20 * DAY, "HIGH",
          "High number of blocked connections from a single IP.")]


def fired(where, n, seconds):
    ids = ", list(event_id) OVER ({w} ROWS BETWEEN %d PRECEDING AND CURRENT ROW) AS ids" % (n - 1)
    return first(where, n, seconds, ids, "@simple_records")


@query("f9_threshold_rules", " UNION ALL ".join(
    f"SELECT '{r[0]}' AS rule_id, '{r[1]}' AS rule_name, '{r[7]}' AS severity, src_ip AS group_key, us, event_id, CAST({r[5]} AS INTEGER) AS event_count, array_to_string(ids, ',') AS source_event_ids "
    f"FROM ({fired(f'action = {quote(r[3])}', r[5], r[6])}) q{n}" for n, r in enumerate(RULES)))
def _(view):
    out = H.threshold_rules(view("simple_records"), RULES)
    return out.withColumn("source_event_ids", F.array_join(F.col("source_event_ids").cast("array<string>"), ",")).drop("description")


@query("f10_fallback_alerts", " UNION ALL ".join(
    f"SELECT '{name}' AS rule_name, '{severity}' AS severity, src_ip, '{text}' || src_ip AS description, us, event_id, CAST({n} AS INTEGER) AS event_count, array_to_string(ids, ',') AS source_event_ids "
    f"FROM ({fired(where, n, 12 * DAY)}) q{n}" for where, n, name, severity, text in (
        ("action = 'LOGIN_FAILED'", 5, "Brute Force Attack", "CRITICAL", "Multiple failed logins detected from "),
        ("action = 'DENY'", 10, "Port Scan Detected", "HIGH", "High frequency of blocked connections from "))))
def _(view):
    out = H.fallback_alerts(view("simple_records"), window_us=12 * DAY * 1_000_000)
    return out.withColumn("source_event_ids", F.array_join(F.col("source_event_ids").cast("array<string>"), ","))


@query("e18_alert_payload", f"""SELECT src_ip, CAST(least(3, len(ids)) AS INTEGER) AS event_count, array_to_string(ids[greatest(1, len(ids) - 2):], ',') AS source_event_ids
 FROM ({fired("action = 'LOGIN_FAILED'", 5, 12 * DAY)}) q""")
def _(view):
    fire = H.first_fire(view("simple_records").where(F.col("action") == "LOGIN_FAILED"), "src_ip", 5, 12 * DAY * 1_000_000, ids=True)
    ids = H.last_ids("source_event_ids", 3)
    return fire.select("src_ip", F.size(ids).alias("event_count"), F.array_join(ids.cast("array<string>"), ",").alias("source_event_ids"))


def all_fires(n, seconds, where, source="@events"):
    """Every fire when the window empties after each: from a fire on to the first candidate n rows later."""
    return f"""WITH RECURSIVE numbered AS (SELECT src_ip, us, event_id, row_number() OVER w AS i, lag(us, {n - 1}) OVER w AS since
   FROM {source} WHERE {where} AND src_ip <> '' WINDOW w AS (PARTITION BY src_ip ORDER BY us, event_id)),
  candidates AS (SELECT * FROM numbered WHERE us - since <= {int(seconds * 1000000)}),
  steps AS (SELECT a.src_ip, a.i, min(b.i) AS after FROM candidates a JOIN candidates b ON b.src_ip = a.src_ip AND b.i >= a.i + {n} GROUP BY 1, 2),
  fires AS (SELECT src_ip, min(i) AS i FROM candidates GROUP BY 1 UNION ALL SELECT f.src_ip, s.after FROM fires f JOIN steps s ON s.src_ip = f.src_ip AND s.i = f.i)
 SELECT c.src_ip, c.us, c.event_id, CAST({n} AS INTEGER) AS event_count FROM candidates c JOIN fires f ON f.src_ip = c.src_ip AND f.i = c.i"""


@query("f1_all_fires", all_fires(*BRUTE, "event_type = 'failed_logon'"))
def _(view):
    return H.all_fires(view("events").where(F.col("event_type") == "failed_logon"), "src_ip", BRUTE[0], int(BRUTE[1] * 1_000_000))


# ------------------------------------------------------------------ baselines

_METRICS = """SELECT us - us % {w} AS bucket, count(*) AS events_per_minute, count(*) FILTER (WHERE event_type IN ('failed_logon', 'successful_logon')) AS logins_per_minute,
 count(*) FILTER (WHERE action IN ('DENY', 'DROP', 'REJECT')) AS denies_per_minute, count(DISTINCT src_ip) FILTER (WHERE src_ip <> '') AS unique_src_ips,
 count(*) FILTER (WHERE status_code >= 500) AS error_rate FROM @events GROUP BY 1"""


def long_sql(width):
    return "SELECT bucket, metric, CAST(value AS DOUBLE) AS value FROM (UNPIVOT (" + _METRICS.format(w=width) + \
        ") ON events_per_minute, logins_per_minute, denies_per_minute, unique_src_ips, error_rate INTO NAME metric VALUE value) u"


_LONG = long_sql(3_600_000_000)


@query("e15_minute_metrics", _METRICS.format(w=60_000_000))
def _(view):
    return B.minute_metrics(view("events"))


def hourly(view):
    return B.long_metrics(B.minute_metrics(view("events"), 3600))


def scored_sql(series):
    return f"""WITH s AS ({series}), b AS (SELECT *, avg(value) OVER w AS m, coalesce(stddev_samp(value) OVER w, 0) AS sd, count(*) OVER w AS n FROM s
  WINDOW w AS (PARTITION BY metric ORDER BY bucket ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)),
 z AS (SELECT *, CASE WHEN n >= 10 AND sd > 0 THEN abs(value - m) / sd END AS raw FROM b)
 SELECT bucket, metric, value, round(m, 6) AS baseline_mean, round(sd, 6) AS baseline_std, n AS baseline_rows, coalesce(round(raw, 2), 0) AS z_score,
  n >= 10 AND (CASE WHEN sd = 0 THEN value <> m ELSE raw > 2.0 END) AS is_anomaly,
  CASE WHEN coalesce(round(raw, 2), 0) > 3.5 THEN 'Critical' WHEN coalesce(round(raw, 2), 0) > 2.5 THEN 'High' ELSE 'Medium' END AS severity FROM z"""


_SCORED = scored_sql(_LONG)


@query("f14_rolling_baseline", _SCORED)
def _(view):
    return B.score_baseline(hourly(view)).withColumns({"baseline_mean": F.round("baseline_mean", 6), "baseline_std": F.round("baseline_std", 6)})


@query("f14_anomalies", f"SELECT bucket, metric, value, z_score, severity FROM ({_SCORED}) a WHERE is_anomaly")
def _(view):
    return B.anomalies(hourly(view)).select("bucket", "metric", "value", "z_score", "severity")


@query("f16_baseline_status", f"""SELECT metric, round(avg(value), 2) AS mean, round(coalesce(stddev_samp(value), 0), 2) AS std_dev, count(*) AS window_size, max(total) AS total_observations
 FROM (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY bucket DESC) AS nth, count(*) OVER (PARTITION BY metric) AS total FROM ({_LONG}) s) x WHERE nth <= 60 GROUP BY 1""")
def _(view):
    return B.baseline_status(hourly(view))


_PACKET = """SELECT direction AS sensor, us - us % 60000000 AS bucket, count(*) / 60.0::DOUBLE AS packet_rate, avg(size) AS avg_packet_size, avg(CASE WHEN flags = 'SYN' THEN 1.0::DOUBLE ELSE 0 END) AS syn_ratio,
 avg(least(dst_port / 65535.0::DOUBLE, 1.0)) AS unique_dst_ports, avg(CASE WHEN protocol = 'ICMP' THEN 1.0::DOUBLE ELSE 0 END) AS icmp_ratio,
 avg(CASE WHEN flags = 'SYN' AND dst_port > 1024 THEN 0.8::DOUBLE WHEN flags = 'SYN' THEN 0.2 ELSE 0 END) AS port_scan_score FROM @packets GROUP BY 1, 2"""
_PLONG = f"""SELECT sensor, bucket, metric, CAST(value AS DOUBLE) AS value FROM (UNPIVOT ({_PACKET}) ON packet_rate, avg_packet_size, syn_ratio, unique_dst_ports, icmp_ratio, port_scan_score INTO NAME metric VALUE value) u"""


@query("f15_packet_baseline", f"""WITH s AS ({_PLONG}), k AS (SELECT *, row_number() OVER (PARTITION BY sensor, metric ORDER BY bucket) AS k, avg(value) OVER w AS m, stddev_pop(value) OVER w AS sd FROM s
  WINDOW w AS (PARTITION BY sensor, metric ORDER BY bucket ROWS BETWEEN 199 PRECEDING AND CURRENT ROW)),
 j AS (SELECT a.*, coalesce(b.m, 0) AS bm, coalesce(CASE WHEN b.sd = 0 THEN 1 ELSE b.sd END, 1) AS bs FROM k a LEFT JOIN k b ON b.sensor = a.sensor AND b.metric = a.metric AND b.k = 10 * ((a.k - 1) // 10))
 SELECT sensor, bucket, metric, round(value, 4) AS value, round(abs((value - bm) / bs), 3) AS z_score, abs((value - bm) / bs) > 3.0 AS is_anomaly FROM j""")
def _(view):
    out = B.score_packet_metrics(B.packet_metrics(view("packets"), "direction"))
    return out.select("sensor", "bucket", "metric", F.round("value", 4).alias("value"), F.round("z_score", 3).alias("z_score"), "is_anomaly")


@query("f16_packet_baseline_status", f"""SELECT sensor, metric, round(avg(value), 4) AS mean, round(stddev_pop(value), 4) AS std, count(*) AS window_size FROM (
 SELECT *, row_number() OVER (PARTITION BY sensor, metric ORDER BY bucket DESC) AS nth FROM ({_PLONG}) s) x WHERE nth <= 200 GROUP BY 1, 2""")
def _(view):
    out = B.packet_baseline_status(B.packet_metrics(view("packets"), "direction"))
    return out.withColumns({"mean": F.round("mean", 4), "std": F.round("std", 4)})
