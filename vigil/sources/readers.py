"""Readers of log lines, rule files, vulnerability lists and scan reports.

Schemas are always given, never inferred.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from vigil.operators.skew import positions

RULE = ("rule_id int, name string, priority int, action string, protocol string, src_ip string, dst_ip string, "
        "src_port int, dst_port int, direction string, tcp_flags array<string>, zone_src string, zone_dst string, "
        "log boolean, enabled boolean, description string")
DETECTION_RULE = ("id string, name string, type string, condition map<string,string>, group_by string, threshold int, "
                  "time_window_seconds int, severity string, description string")
LOCAL_CVE = ("cve_id string, service string, vulnerable_versions array<string>, description string, cvss_score double, "
             "severity string, remediation string")
CONTENT = "id int, action string, protocol string, content string, msg string"
_PORT = ("port int, state string, service string, description string, rtt_ms double, is_ot_port boolean, "
         "ot_protocol string")
_SERVICE = ("ip string, port int, protocol string, banner string, service string, version string, os_hint string, "
            "ssl boolean, security_notes array<string>, timestamp string")
SCAN = (f"report_metadata struct<tool:string,generated_at:string,report_type:string>, scan_results struct<target:string,"
        f"scan_time:string,duration_seconds:double,ports_scanned:int,open_ports:array<struct<{_PORT.replace(' ', ':').replace(',:', ',')}>>,"
        f"open_count:int,closed_count:int,filtered_count:int,profile:string,scan_type:string,"
        f"services:array<struct<{_SERVICE.replace(' ', ':').replace(',:', ',')}>>>")


def read_raw_logs(spark: SparkSession, path: str, log_type: str, stream: bool = False) -> DataFrame:
    """Lines of one source, one row per line."""
    reader = spark.readStream if stream else spark.read
    return reader.format("text").load(path).select(F.lit(log_type).alias("log_type"), F.col("value").alias("raw"))


def _documents(spark: SparkSession, path: str) -> DataFrame:
    """One row per document with its text and place: a file that somebody wrote by hand, or the documents of a list."""
    texts = spark.read.text(path, wholetext=True)
    number = F.col("document").cast("bigint") if "document" in texts.columns else F.lit(0).cast("bigint")
    return texts.select("value", number.alias("document"), F.col("_metadata.file_path").alias("file"))


def _rows(text: Column, schema: str, member: str | None = None) -> Column:
    """Array of rows of a document that is a list or an object with a list in ``member``."""
    flat = f"array<struct<{_struct(schema)}>>"
    as_list = F.from_json(text, flat)
    if member is None:
        return as_list
    as_object = F.from_json(text, f"struct<{member}:{flat}>")[member]
    return F.when(F.trim(text).startswith("["), as_list).otherwise(as_object)


def _struct(schema: str) -> str:
    parts, depth, word = [], 0, ""
    for c in schema:
        depth += (c == "<") - (c == ">")
        if c == "," and depth == 0:
            parts.append(word.strip())
            word = ""
        else:
            word += c
    parts.append(word.strip())
    return ",".join(p.replace(" ", ":", 1) for p in parts)


def read_firewall_rules(spark: SparkSession, path: str) -> DataFrame:
    """Rules of a JSON file, a bare list or ``{default_policy, rules}``, with defaults filled in.

    ``seq`` is the place in the file, over all documents if the set is written in several, and ``default_policy`` the
    policy of the document (DENY).  Rules without a number take the next free ones in that order.
    """
    text = F.col("value")
    policy = F.coalesce(F.upper(F.get_json_object(text, "$.default_policy")), F.lit("DENY"))
    rows = (_documents(spark, path)
            .select(policy.alias("default_policy"), "document", "file", F.posexplode(_rows(text, RULE, "rules")).alias("_pos", "_r"))
            .select("default_policy", "document", "file", "_pos", "_r.*"))
    defaults = {"rule_id": 0, "name": "", "priority": 1000, "src_ip": "any", "dst_ip": "any", "src_port": 0,
                "dst_port": 0, "zone_src": "", "zone_dst": "", "log": False, "enabled": True, "description": ""}
    rows = rows.withColumns({n: F.coalesce(F.col(n), F.lit(v)) for n, v in defaults.items()})
    upper = {"action": "DENY", "protocol": "ANY", "direction": "ANY"}
    rows = rows.withColumns({n: F.upper(F.coalesce(F.col(n), F.lit(v))) for n, v in upper.items()})
    rows = rows.withColumn("tcp_flags", F.coalesce("tcp_flags", F.array().cast("array<string>")))
    rows = positions(rows, ["document", "file", "_pos"], "_at").withColumn("seq", (F.col("_at") - 1).cast("int"))
    nameless = F.col("rule_id") == 0
    top = rows.agg(F.max("rule_id")).first()[0] or 0
    fresh = positions(rows.where(nameless), ["_at"], "_free").withColumn("rule_id", (F.col("_free") + top).cast("int")).drop("_free")
    columns = ["default_policy", "seq", *[c for c in rows.columns if c not in ("default_policy", "seq", "document", "file", "_pos", "_at")]]
    return rows.where(~nameless).select(columns).unionByName(fresh.select(columns))


def read_detection_rules(spark: SparkSession, path: str) -> DataFrame:
    """Threshold rules of a JSON list."""
    return _documents(spark, path).select(F.explode(_rows(F.col("value"), DETECTION_RULE)).alias("r")).select("r.*")


def detection_rule_rows(rules: DataFrame) -> list[tuple]:
    """Threshold rules in the form :func:`vigil.operators.thresholds.threshold_rules` takes."""
    out = []
    for r in rules.where(F.col("type") == "threshold").orderBy("id").collect():
        column, value = next(iter(r["condition"].items()))
        out.append((r["id"], r["name"], column, value, r["group_by"], r["threshold"], r["time_window_seconds"],
                    r["severity"], r["description"]))
    return out


def read_cve_db(spark: SparkSession, path: str) -> DataFrame:
    """Local vulnerability list with lower-case service names."""
    rows = _documents(spark, path).select(F.explode(_rows(F.col("value"), LOCAL_CVE)).alias("r")).select("r.*")
    return rows.withColumn("service", F.lower("service"))


def read_content_signatures(spark: SparkSession, path: str) -> DataFrame:
    """Signatures that look for a fixed text."""
    return _documents(spark, path).select(F.explode(_rows(F.col("value"), CONTENT)).alias("r")).select("r.*")


def read_scan_reports(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Port rows and service rows of scan reports (one JSON document per file)."""
    reports = spark.read.schema(SCAN).json(path, multiLine=True).select("report_metadata.generated_at", "scan_results.*")
    kept = ["target", "scan_time", "profile", "scan_type"]
    ports = reports.select(*kept, F.explode("open_ports").alias("p")).select(*kept, "p.*")
    services = reports.select("target", "scan_time", F.explode("services").alias("s")).select("target", "scan_time", "s.*")
    return ports, services
