"""Intrusion detection, model and combined queries."""

from pyspark.sql import functions as F

from vigil import fixed
from vigil.catalog.q_detect import DENIED, first, hourly, all_incidents, _ALL as INCIDENTS, _LONG
from vigil.catalog.q_firewall import decided, signed
from vigil.catalog.q_ot import STAGED, judged as ot_judged
from vigil.catalog.q_vuln import ISO, iso
from vigil.catalog.q_normalize import _STATUS
from vigil.catalog.registry import query, rows
from vigil.operators import enrich as E
from vigil.operators import ids as I
from vigil.operators import ml as M
from vigil.operators import normalize as N
from vigil.operators import rules as R
from vigil.plans import pipelines as P

RATE = f"SELECT packet_id AS event_id, us, src_ip, dst_port FROM ({signed('@ids_packets')}) s WHERE flags = 'SYN' AND sid IS NULL"


def rate_rows(view):
    return I.rate_rows(R.match_signatures(view("ids_packets")))


@query("f11_syn_flood", f"SELECT src_ip, us, event_id AS packet_id, CAST(20 AS INTEGER) AS event_count FROM ({first('true', 20, 10, source=f'({RATE})')}) q")
def _(view):
    return I.syn_floods(rate_rows(view))


@query("f12_ids_port_scan", f"""SELECT src_ip, us, event_id AS packet_id, CAST(n AS INTEGER) AS distinct_values FROM (SELECT *, row_number() OVER (PARTITION BY src_ip ORDER BY us, event_id) AS nth FROM (
 SELECT *, len(list_distinct(list(dst_port) OVER (PARTITION BY src_ip ORDER BY us RANGE BETWEEN 30000000 PRECEDING AND CURRENT ROW))) AS n FROM ({RATE}) r WHERE dst_port <> 0) a WHERE n >= 10) b WHERE nth = 1""")
def _(view):
    return I.port_scans(rate_rows(view))


def verdicts(view):
    return I.verdicts(view("ids_packets"))


@query("j1_packet_verdicts")
def _(view):
    return verdicts(view).select("packet_id", "src_ip", "us", "matched", "action", "severity", "rule_name", "rule_sid", "details")


@query("j1a_alert_records")
def _(view):
    return I.alert_records(verdicts(view))


@query("e16_ids_counters")
def _(view):
    return I.counters(verdicts(view))


@query("g5_blocks")
def _(view):
    return I.blocks(R.match_signatures(view("ids_packets")))


@query("g5_block_list", f"""WITH d AS (SELECT src_ip, us FROM ({signed('@ids_packets')}) s WHERE sid IS NOT NULL)
 SELECT p.packet_id, EXISTS (SELECT 1 FROM d WHERE d.src_ip = p.src_ip AND p.us >= d.us AND p.us < d.us + 15000000) AS blocked FROM @ids_packets p""")
def _(view):
    found = R.match_signatures(view("ids_packets")).where("signature IS NOT NULL").select("src_ip", "us")
    return I.apply_block_list(view("ids_packets"), found).select("packet_id", "blocked")


# ------------------------------------------------------------------ models

def timed(view, name):
    return view(name).withColumn("event_time", F.timestamp_micros("us"))


def _codes(column, codes):
    return "CASE " + column + " " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in codes.items()) + " ELSE 0 END"


_D = lambda e: f"CAST({e} AS DOUBLE)"
_T = "make_timestamp(us)"
_TIMES = {"hour": f"hour({_T})", "weekday": f"(isodow({_T}) - 1)", "day": f"day({_T})", "month": f"month({_T})"}


_BUCKET = "CAST('0x' || substr(md5({0}), 1, 8) AS BIGINT) % 1000 / 1000.0::DOUBLE"
_EVENT_FEATURES = "SELECT event_id, " + ", ".join(f"{_D(e)} AS {n}" for n, e in {
    "severity": "severity", "has_src_ip": "src_ip <> ''", "has_dst_ip": "dst_ip <> ''", "src_port": "src_port", "dst_port": "dst_port",
    "protocol": _codes("protocol", fixed.PROTOCOL_CODES), "action": _codes("action", fixed.ACTION_CODES), "has_username": "username NOT IN ('', '-')",
    "metadata_length": "length(concat_ws(',', uri, domain, status_code, bytes))", "status_code": "status_code", "bytes": "bytes",
    "event_type_hash": _BUCKET.format("event_type"), "source_type_hash": _BUCKET.format("source_type"), **_TIMES}.items()) + " FROM @events"


@query("m1_event_features", _EVENT_FEATURES)
def _(view):
    return M.event_features(timed(view, "events"))


_INT = "regexp_matches({0}, '^(10\\.|192\\.168\\.|172\\.(1[6-9]|2[0-9]|3[01])\\.)')"


@query("m2_packet_features", "SELECT packet_id, " + ", ".join(f"{_D(e)} AS {n}" for n, e in {
    "packet_size": "size", "src_port": "src_port", "dst_port": "dst_port", **{f"is_{p.lower()}": f"upper(protocol) = '{p}'" for p in ("TCP", "UDP", "ICMP", "ARP")},
    "has_payload": "payload <> ''", "payload_length": "length(payload)", "src_ip_internal": _INT.format("src_ip"), "dst_ip_internal": _INT.format("dst_ip"),
    "hour_of_day": _TIMES["hour"], "day_of_week": _TIMES["weekday"]}.items()) + " FROM @ids_packets")
def _(view):
    return M.packet_features(timed(view, "ids_packets"))


def forest_scores(view):
    features = M.packet_features(timed(view, "ids_packets"))
    return M.fit_and_score(features, fixed.PACKET_FEATURES, "packet_id", ["packet_id"])[1]


@query("m3_isolation_forest")
def _(view):
    return forest_scores(view)


@query("e19_training_summary")
def _(view):
    return M.training_summary(forest_scores(view))


def event_matrix(view):
    return M.event_features(timed(view, "events"))


@query("m4_scaled_features", f"""WITH f AS ({_EVENT_FEATURES}) SELECT event_id, {', '.join(
    f"round(({n} - avg({n}) OVER ()) / CASE WHEN stddev_pop({n}) OVER () = 0 THEN 1 ELSE stddev_pop({n}) OVER () END, 6) + 0.0 AS {n}" for n in fixed.EVENT_FEATURES)} FROM f""")
def _(view):
    rows_ = event_matrix(view)
    scaled = M.scale(rows_, M.scaling(rows_, fixed.EVENT_FEATURES))
    return scaled.select("event_id", *[(F.round(n, 6) + 0.0).alias(n) for n in fixed.EVENT_FEATURES])


@query("m5_boundary")
def _(view):
    rows_ = event_matrix(view)
    scaled = M.scale(rows_, M.scaling(rows_, fixed.EVENT_FEATURES))
    return M.score_boundary(scaled, M.fit_boundary(scaled, fixed.EVENT_FEATURES)).select("event_id", "distance", "outside")


@query("m6_reconstruction")
def _(view):
    rows_ = event_matrix(view)
    scaled = M.scale(rows_, M.scaling(rows_, fixed.EVENT_FEATURES))
    parts = M.fit_components(scaled, fixed.EVENT_FEATURES)
    return M.reconstruction_error(scaled, fixed.EVENT_FEATURES, parts).select("event_id", "error", "badly_rebuilt")


@query("m7_ensemble")
def _(view):
    return M.ensemble(event_matrix(view), fixed.EVENT_FEATURES, "event_id").select(
        "event_id", "votes", "is_anomaly", "confidence", "ensemble_vote", "mean_score")


@query("m7_vote", """SELECT event_id, CAST(a::INT + b::INT + c::INT AS INTEGER) AS votes, a::INT + b::INT + c::INT > 1 AS is_anomaly, round((a::INT + b::INT + c::INT) / 3.0::DOUBLE, 6) AS confidence,
 (a::INT + b::INT + c::INT) || '/3' AS ensemble_vote FROM (SELECT event_id, severity >= 7 AS a, status_code >= 400 AS b, dst_port < 500 AS c FROM @events) e""")
def _(view):
    e = view("events").select("event_id", (F.col("severity") >= 7).alias("a"), (F.col("status_code") >= 400).alias("b"),
                              (F.col("dst_port") < 500).alias("c"), F.lit(0.5).alias("s"))
    out = M.vote(e, ["a", "b", "c"], ["s"])
    return out.select("event_id", "votes", "is_anomaly", F.round("confidence", 6).alias("confidence"), "ensemble_vote")


@query("m8_without_model", "SELECT packet_id, false AS is_anomaly, CAST(0 AS DOUBLE) AS score FROM @ids_packets")
def _(view):
    return M.default_scores(view("ids_packets").select("packet_id"), None, "packet_id").select("packet_id", "is_anomaly", "score")


# ------------------------------------------------------------------ combined

@query("j4_enriched_packets")
def _(view):
    return P.enrich_packets(timed(view, "ids_packets")).select(
        "packet_id", "action", "rule_name", "ml_anomaly", "ml_score", "stats_anomalies", "threat_detected")


@query("j7_scan_enrichment")
def _(view):
    return P.enrich_scan(view("services"))


@query("j8_unified_alerts", INCIDENTS + f""", {STAGED} SELECT 'siem' AS source, us, severity, src_ip, description AS text FROM incidents UNION ALL
 SELECT 'ot', us, severity, source_ip, message FROM verdicts WHERE is_alert UNION ALL SELECT 'compliance', NULL, risk, CAST(asset_id AS VARCHAR), finding FROM ({ISO}) k WHERE status = 'FAIL'""")
def _(view):
    return P.unified_alerts(incidents=all_incidents(view), ot=ot_judged(view), findings=iso(view))


@query("e24_system_summary", INCIDENTS + f""", s AS ({_LONG}) SELECT 'ingestion' AS section, parse_status AS "key", CAST(count(*) AS DOUBLE) AS value FROM (SELECT {_STATUS} AS parse_status FROM @raw_logs) x GROUP BY 2
 UNION ALL SELECT 'alerts', severity, CAST(count(*) AS DOUBLE) FROM incidents GROUP BY 2
 UNION ALL SELECT 'baseline', metric, round(avg(value), 2) FROM (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY bucket DESC) AS nth FROM s) y WHERE nth <= 60 GROUP BY 2
 UNION ALL SELECT 'intel', 'total_lookups', CAST(count(*) AS DOUBLE) FROM @events UNION ALL SELECT 'intel', 'cache_size', CAST(count(DISTINCT src_ip) AS DOUBLE) FROM @events""")
def _(view):
    return P.system_summary(view("raw_logs"), all_incidents(view), hourly(view), view("events"))
