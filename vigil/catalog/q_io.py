"""Sources and sinks: what is written from a view and read back equals the view."""

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil import fixed
from vigil.catalog.q_ids import timed
from vigil.catalog.q_vuln import _ASSESS, as_of
from vigil.catalog.registry import query
from vigil.operators import ml as M
from vigil.plans import pipelines as P
from vigil.session import checkpoint_dir
from vigil.sources import readers, writers


def _folder(df) -> str:
    return f"{checkpoint_dir(df.sparkSession).rstrip('/')}/vigil-io-{uuid.uuid4().hex}"


@query("a1_read_logs", "SELECT log_type, raw FROM @raw_logs")
def _(view):
    lines = view("raw_logs")
    path = _folder(lines)
    lines.select("log_type", "raw").write.partitionBy("log_type").text(path)
    kinds = sorted(r.log_type for r in lines.select("log_type").distinct().collect())       # as many as there are formats
    return reduce(DataFrame.unionByName, [readers.read_raw_logs(lines.sparkSession, f"{path}/log_type={kind}", kind) for kind in kinds])


@query("a2_rule_file", """SELECT CAST(row_id + 1 AS INTEGER) AS rule_id, 'rule ' || row_id AS name, CAST(row_id % 7 AS INTEGER) AS priority, 'DENY' AS action, 'TCP' AS protocol,
 ip AS src_ip, 'any' AS dst_ip, CAST(0 AS INTEGER) AS src_port, CAST(row_id % 1000 AS INTEGER) AS dst_port, 'ANY' AS direction, true AS enabled,
 CAST(row_number() OVER (ORDER BY row_id % 7, row_id) - 1 AS INTEGER) AS seq, 'DROP' AS default_policy FROM @networks""")
def _(view):
    rules = view("networks").select(
        (F.col("row_id") + 1).cast("int").alias("rule_id"), F.concat(F.lit("rule "), "row_id").alias("name"),
        (F.col("row_id") % 7).cast("int").alias("priority"), F.lit("deny").alias("action"), F.lit("tcp").alias("protocol"),
        F.col("ip").alias("src_ip"), (F.col("row_id") % 1000).cast("int").alias("dst_port"), F.col("row_id").alias("seq"))
    path = _folder(rules)
    writers.write_rules(rules, path, "DROP")
    return readers.read_firewall_rules(rules.sparkSession, path).select(
        "rule_id", "name", "priority", "action", "protocol", "src_ip", "dst_ip", "src_port", "dst_port", "direction", "enabled",
        "seq", "default_policy")


@query("a3_detection_rules", """SELECT 'R' || row_id AS id, 'ip' AS field, ip AS value, CAST(row_id % 9 + 1 AS INTEGER) AS threshold,
 CAST(60 AS INTEGER) AS time_window_seconds FROM @networks""")
def _(view):
    rules = view("networks").select(
        F.concat(F.lit("R"), "row_id").alias("id"), F.lit("threshold").alias("type"), F.create_map(F.lit("ip"), "ip").alias("condition"),
        F.lit("src_ip").alias("group_by"), (F.col("row_id") % 9 + 1).alias("threshold"), F.lit(60).alias("time_window_seconds"))
    path = _folder(rules)
    writers.write_list(rules, path, ["id"])
    read = readers.read_detection_rules(rules.sparkSession, path)
    return read.select("id", F.explode("condition").alias("field", "value"), "threshold", "time_window_seconds")


@query("a4_cve_file", """SELECT 'CVE-' || service_id AS cve_id, lower(service) AS service, version AS first_version, round(service_id % 100 / 10, 1) AS cvss_score FROM @services""")
def _(view):
    listed = view("services").select(
        F.concat(F.lit("CVE-"), "service_id").alias("cve_id"), "service",
        F.array("version").alias("vulnerable_versions"), F.round(F.col("service_id") % 100 / 10, 1).alias("cvss_score"))
    path = _folder(listed)
    writers.write_list(listed, path, ["cve_id"])
    return readers.read_cve_db(listed.sparkSession, path).select(
        "cve_id", "service", F.col("vulnerable_versions")[0].alias("first_version"), "cvss_score")


@query("a5_content_file", "SELECT CAST(row_id AS INTEGER) AS id, 'alert' AS action, 'tcp' AS protocol, ip AS content, cidr AS msg FROM @networks")
def _(view):
    listed = view("networks").select(F.col("row_id").cast("int").alias("id"), F.lit("alert").alias("action"),
                                     F.lit("tcp").alias("protocol"), F.col("ip").alias("content"), F.col("cidr").alias("msg"))
    path = _folder(listed)
    writers.write_list(listed, path, ["id"])
    return readers.read_content_signatures(listed.sparkSession, path)


@query("a6_scan_reports", "SELECT host AS target, CAST(port AS INTEGER) AS port, count(*) AS services FROM @services GROUP BY 1, 2")
def _(view):
    found = view("services").groupBy(F.col("host").alias("target")).agg(
        F.collect_list(F.struct("port", F.lit("open").alias("state"))).alias("open_ports"))
    path = _folder(found)
    writers.write_scan_json(found, path, "scan", "2026-01-01T00:00:00")
    spark = found.sparkSession
    ports = spark.read.schema(readers.SCAN).json(path).select("scan_results.target", F.explode("scan_results.open_ports").alias("p"))
    return ports.groupBy("target", "p.port").agg(F.count(F.lit(1)).alias("services"))


@query("a7_stored_events", "SELECT event_id, us, event_type, src_ip FROM @events")
def _(view):
    events = view("events").withColumn("event_time", F.timestamp_micros("us"))
    path = _folder(events)
    writers.write_events(events.where(F.col("event_id") % 3 > 0), path)
    writers.write_events(events, path)                       # two thirds are there already
    return events.sparkSession.read.parquet(path).select("event_id", "us", "event_type", "src_ip")


@query("a9_scan_report", """SELECT host AS target, 'scan' AS tool, '2026-01-01T00:00:00' AS generated_at, 'Network Scan Report' AS report_type, CAST(count(*) AS INTEGER) AS ports,
 CAST(min(port) AS INTEGER) AS first_port FROM @services GROUP BY 1""")
def _(view):
    found = view("services").groupBy(F.col("host").alias("target")).agg(
        F.collect_list(F.struct(F.col("port"), F.lit("open").alias("state"))).alias("open_ports"))
    path = _folder(found)
    writers.write_scan_json(found, path, "scan", "2026-01-01T00:00:00")
    schema = ("report_metadata struct<tool: string, generated_at: string, report_type: string>, "
              "scan_results struct<target: string, open_ports: array<struct<port: int, state: string>>>")
    read = found.sparkSession.read.schema(schema).json(path)
    return read.select("scan_results.target", "report_metadata.*", F.size("scan_results.open_ports").alias("ports"),
                       F.array_min("scan_results.open_ports.port").alias("first_port"))


@query("a11_rule_set", """SELECT document, count(*) AS rules, min(row_id) AS first_rule, 'DROP' AS default_policy FROM (
 SELECT row_id, (row_number() OVER (ORDER BY row_id % 7, row_id) - 1) // 1000 AS document FROM @networks) d GROUP BY 1""")
def _(view):
    rules = view("networks").select((F.col("row_id") % 7).cast("int").alias("priority"), "row_id", F.col("row_id").alias("seq"))
    path = _folder(rules)
    writers.write_rules(rules, path, "DROP")
    read = rules.sparkSession.read.schema("default_policy string, rules array<struct<row_id: bigint>>, document bigint").json(path)
    return read.select("document", F.size("rules").cast("bigint").alias("rules"), F.array_min("rules.row_id").alias("first_rule"), "default_policy")


@query("a12_saved_model", "SELECT count(*) AS packets, CAST(0 AS BIGINT) AS differing FROM @ids_packets")
def _(view):
    features = fixed.PACKET_FEATURES
    rows = M.packet_features(timed(view, "ids_packets"))
    forest, scored = M.fit_and_score(rows, features, "packet_id")
    path = _folder(rows)
    M.save_forest(rows.sparkSession, forest, path)
    again = M.load_forest(rows.sparkSession, path)
    both = scored.withColumnsRenamed({"score": "a", "is_anomaly": "x"})
    both = M.score_forest(both, again)
    return both.agg(F.count(F.lit(1)).alias("packets"), F.count_if(
        (F.col("a") != F.col("score")) | (F.col("x") != F.col("is_anomaly"))).alias("differing"))


@query("j6_assessment", _ASSESS + " SELECT * FROM assessed")
def _(view):
    return P.assess(view("assets"), view("services"), as_of())[0]
