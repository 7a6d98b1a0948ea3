"""Streaming twins, run over everything there is; most share the oracle of their batch operator."""

import uuid

from pyspark.sql import functions as F

from vigil import fixed
from vigil.catalog.q_detect import _METRICS, BRUTE, DENIED, SCAN, VPN, WEB, WEBBED, all_fires, long_sql, scored_sql
from vigil.catalog.q_enrich import THREATS
from vigil.catalog.q_firewall import signed, tracked
from vigil.catalog.q_ot import STAGED
from vigil.catalog.q_ids import RATE
from vigil.catalog.registry import query
from vigil.operators import correlate
from vigil.operators import ids as I
from vigil.operators import ml
from vigil.operators import ot as O
from vigil.operators.rules import match_signatures
from vigil.session import checkpoint_dir
from vigil.streaming import refit
from vigil.streaming import twins as S


@query("g1_stream_connections", f"WITH {tracked('@packets')} SELECT conn_key, packet_id AS row_id, us, conn_state FROM states")
def _(view):
    return S.run_available(S.connection_stream(view("stream:packets")))


@query("g4_stream_thresholds", "SELECT src_ip AS key, us, event_id AS row_id, event_count FROM (" + all_fires(*BRUTE, "event_type = 'failed_logon'") + ") f")
def _(view):
    failed = view("stream:events").where(F.col("event_type") == "failed_logon")
    return S.run_available(S.threshold_stream(failed, "src_ip", BRUTE[0], BRUTE[1]))


def _fires(name, condition, where, n, seconds):
    sql = all_fires(n, seconds, where)

    @query(f"g4_stream_{name}", f"SELECT src_ip AS key, us, event_id AS row_id, event_count FROM ({sql}) f")
    def _(view):
        return S.run_available(S.threshold_stream(view("stream:events").where(condition()), "src_ip", n, seconds))


_fires("port_scan", correlate.is_denied, DENIED, *SCAN)
_fires("vpn_brute_force", lambda: F.col("event_type") == "vpn_auth_fail", "event_type = 'vpn_auth_fail'", *VPN)
_fires("web_attack", correlate.is_web_attack, WEBBED, *WEB)


def rates(view):
    return I.rate_rows(match_signatures(view("stream:ids_packets")))


@query("g4_stream_syn_flood", f"SELECT src_ip AS key, us, event_id AS row_id, event_count FROM ({all_fires(*fixed.SYN_FLOOD, 'true', source=f'({RATE})')}) f")
def _(view):
    return S.run_available(S.threshold_stream(rates(view), "src_ip", *fixed.SYN_FLOOD, row_id="packet_id"))


# the first fire of a source; the window empties after it
@query("g4_stream_ids_port_scan", f"""SELECT src_ip AS key, us, event_id AS row_id FROM (SELECT *, row_number() OVER (PARTITION BY src_ip ORDER BY us, event_id) AS nth FROM (
 SELECT *, len(list_distinct(list(dst_port) OVER (PARTITION BY src_ip ORDER BY us RANGE BETWEEN 30000000 PRECEDING AND CURRENT ROW))) AS n FROM ({RATE}) r WHERE dst_port <> 0) a WHERE n >= 10) b WHERE nth = 1""")
def _(view):
    found = S.run_available(S.distinct_threshold_stream(rates(view).where("dst_port <> 0"), "src_ip", "dst_port", *fixed.IDS_PORT_SCAN))
    return found.groupBy("key").agg(F.min(F.struct("us", "row_id")).alias("f")).select("key", "f.*")


@query("g4_stream_write_frequency", f"WITH {STAGED} SELECT CAST(address AS VARCHAR) AS address, command_id AS row_id, writes AS n FROM counted WHERE writes > 10")
def _(view):
    passed = O.validate_writes(O.writes(timed(view, "commands")).where(F.col("source_ip").isin(fixed.OT_WRITERS)))
    passed = passed.where(F.col("success") | ~F.col("known") & F.col("value").between(0, 65535)).select("address", "us", "command_id", "event_time")
    counts = S.run_to_end(passed, "event_time", lambda rows: S.trailing_counts(rows, ("address",), 60, row_id="command_id"))
    return counts.where("n > 10").select("address", "row_id", F.col("n").cast("bigint").alias("n"))


@query("g5_stream_block_list", f"""WITH d AS (SELECT src_ip, us FROM ({signed('@ids_packets')}) s WHERE sid IS NOT NULL)
 SELECT p.src_ip, p.packet_id AS row_id, p.us, EXISTS (SELECT 1 FROM d WHERE d.src_ip = p.src_ip AND p.us >= d.us AND p.us < d.us + 15000000) AS blocked FROM @ids_packets p""")
def _(view):
    marked = match_signatures(view("stream:ids_packets")).withColumn("detected", F.col("signature").isNotNull())
    return S.run_available(S.block_list_stream(marked))


def timed(view, name="events"):
    return view(f"stream:{name}").withColumn("event_time", F.timestamp_micros("us"))


@query("g6_stream_minutes", _METRICS.format(w=60_000_000))
def _(view):
    return S.run_to_end(timed(view), "event_time", S.minute_metrics_stream)


@query("g7_stream_baseline", scored_sql(long_sql(60_000_000)))
def _(view):
    scored = S.run_to_end(timed(view), "event_time", S.scored_minutes_stream)
    return scored.withColumns({"baseline_mean": F.round("baseline_mean", 6), "baseline_std": F.round("baseline_std", 6)})


@query("g8_stream_first_incidents", f"""SELECT attack_type, src_ip FROM (SELECT 'malicious_ip' AS attack_type, src_ip FROM @events WHERE src_ip IN (SELECT ip FROM (VALUES {THREATS}) t(ip, score, kind, country, region, isp, actor, a, b, c, d))
 UNION SELECT 'dns_tunnel', src_ip FROM @events WHERE event_type = 'dns_tunnel_suspect') u""")
def _(view):
    found = S.single_event_incidents(view("stream:events")).withColumn("event_time", F.timestamp_micros("us"))
    return S.run_available(S.distinct_incidents(found, quiet="60 days")).select("attack_type", "src_ip")


@query("g9_stream_trailing_counts", """SELECT src_ip, action, us, event_id AS row_id, CAST(count(*) OVER (PARTITION BY src_ip, action ORDER BY us RANGE BETWEEN 300000000 PRECEDING AND CURRENT ROW)
 - (count(*) OVER (PARTITION BY src_ip, action, us) - row_number() OVER (PARTITION BY src_ip, action, us ORDER BY event_id)) AS INTEGER) AS n FROM @events""")
def _(view):
    return S.run_to_end(timed(view), "event_time", S.trailing_counts)


@query("g10_stream_normalized")
def _(view):
    return S.run_available(S.normalized_stream(view("stream:raw_logs"))).select("line_id", "event_type", "severity", "src_ip", "safe", "threat_type")


@query("g11_stream_rapid_changes", f"WITH {STAGED} SELECT address, command_id AS row_id, us, round(change, 6) AS change_percent FROM verdicts WHERE kind = 'rate_of_change' AND name IS NOT NULL")
def _(view):
    return S.run_available(S.rate_of_change_stream(view("stream:commands"))).withColumn("change_percent", F.round("change_percent", 6))


# all rows come in one batch: nothing scores it, and the newest thousand rows make the first model
@query("g12_refit", "SELECT CAST(1 AS INTEGER) AS version, CAST(least(1000, count(*)) AS BIGINT) AS fitted_rows, count(*) AS scored_without FROM @ids_packets")
def _(view):
    rows = view("stream:ids_packets").withColumn("event_time", F.timestamp_micros("us"))
    features = ml.packet_features(rows)
    folder = f"{checkpoint_dir(features.sparkSession)}/refit-{uuid.uuid4().hex}"
    refit.scored_and_refitted(features, fixed.PACKET_FEATURES, "packet_id", "packet_id", folder).awaitTermination()
    scored = features.sparkSession.read.parquet(f"{folder}/scored").where("model_version = 0 AND NOT is_anomaly")
    return refit.versions(features.sparkSession, f"{folder}/models").select("version", F.col("rows").alias("fitted_rows")).join(
        scored.agg(F.count(F.lit(1)).alias("scored_without")), F.lit(True))


@query("j1_stream_verdicts")
def _(view):
    return S.run_available(S.verdict_stream(view("stream:ids_packets")))
