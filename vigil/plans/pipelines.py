"""Whole pipelines put together from operators."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from vigil import fixed
from vigil.functions.text import os_guess, parse_banner
from vigil.operators import baseline, compliance, correlate, enrich, ids, ml, normalize, vuln
from vigil.session import durable


def hot_columns(events: DataFrame) -> DataFrame:
    """Typed columns of normalised events that detection reads: uri, domain, status, bytes, micros."""
    get = lambda name: F.coalesce(F.try_element_at("metadata", F.lit(name)), F.lit(""))
    return events.withColumns({"uri": get("uri"), "domain": get("domain"),
                               "status_code": F.coalesce(get("status_code").try_cast("int"), F.lit(0)),
                               "bytes": F.coalesce(get("bytes").try_cast("bigint"), F.lit(0)),
                               "us": F.unix_micros("event_time")})


def siem(raw_logs: DataFrame, layers=None) -> DataFrame:
    """Raw lines to incidents: normalise, enrich, detect, map to techniques.

    Further columns of the input (arrival time, line number) tell equal lines apart.
    """
    extra = [c for c in raw_logs.columns if c not in ("log_type", "raw")]
    events = normalize.with_event_id(normalize.normalize_logs(raw_logs), *extra)
    return correlate.incidents(hot_columns(events).where("us IS NOT NULL"), layers)


def enrich_packets(packets: DataFrame, sensor: str = "direction", forest: ml.Forest | None = None) -> DataFrame:
    """Verdict, model score, statistics of the minute and threat networks of every packet in one row."""
    judged = ids.verdicts(packets)
    if forest is None:
        forest = ml.grow_forest(ml.packet_features(packets), fixed.PACKET_FEATURES, "packet_id")
        limit = None
    else:
        limit = forest.threshold
    # scores ride along as a column, there is no join back
    columns = judged.columns
    wide = judged.select(*columns, *[c.alias(f"_{n}") for c, n in zip(_feature_columns(judged), fixed.PACKET_FEATURES)])
    scored = ml.with_score(wide, replace(forest, features=[f"_{n}" for n in fixed.PACKET_FEATURES]))
    scored = scored.select(*columns, F.col("score").alias("ml_score"))
    if limit is None:
        # every row is scored once: the limit is taken from the scores as they are written
        scored = durable(scored)
        limit = ml.limit(scored, "ml_score")
    scored = scored.select(*columns, (F.col("ml_score") > F.lit(limit)).alias("ml_anomaly"), "ml_score")
    stats = (baseline.score_packet_metrics(baseline.packet_metrics(packets, sensor)).where("is_anomaly")
             .groupBy("sensor", "bucket").agg(F.array_join(F.sort_array(F.collect_list("metric")), ",").alias("_stats")))
    minute = F.col("us") - F.pmod(F.col("us"), F.lit(60_000_000))
    out = scored.join(stats, (F.col(sensor) == F.col("sensor")) & (minute == F.col("bucket")), "left")
    out = out.withColumn("stats_anomalies", F.coalesce("_stats", F.lit(""))).drop("_stats", "sensor", "bucket")
    return enrich.threat_networks(out)


def _feature_columns(packets: DataFrame) -> list[Column]:
    protocol, payload = F.upper("protocol"), F.coalesce(F.col("payload"), F.lit(""))
    from vigil.functions.network import is_internal
    t = F.timestamp_micros("us")
    values = [F.col("size"), F.col("src_port"), F.col("dst_port"),
              *[protocol == p for p in ("TCP", "UDP", "ICMP", "ARP")], payload != "", F.length(payload),
              is_internal("src_ip"), is_internal("dst_ip"), F.hour(t), F.weekday(t)]
    return [v.cast("double").alias(n) for v, n in zip(values, fixed.PACKET_FEATURES)]


def enrich_scan(services: DataFrame) -> DataFrame:
    """Open ports with service names, banner facts, vulnerabilities and findings per port."""
    rows = enrich.ot_protocol(enrich.port_service(services.where(F.col("state") == "open")))
    rows = (rows.withColumn("_b", parse_banner("banner", "port"))
            .withColumn("os_hint", F.coalesce(F.nullif(F.col("_b.os_hint"), F.lit("")),
                                              os_guess("service", "banner", "service_text", "version", "port"))))
    rows = vuln.enrich_services(rows)
    notes = enrich.port_findings(services.select("host", "port").distinct()).groupBy("host", "port").agg(
        F.count(F.lit(1)).alias("findings"))
    return (rows.join(notes, ["host", "port"], "left").fillna(0, ["findings"])
            .select("service_id", "host", "port", "service_name", "is_ot_port", "ot_protocol",
                    F.col("_b.service").alias("banner_service"), F.col("_b.version").alias("banner_version"), "os_hint",
                    F.array_join(F.col("cves.cve_id"), ",").alias("cve_ids"), "total", "critical", "findings"))


def assess(assets: DataFrame, services: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """Assessment of every asset and the executive summary over them."""
    assessed = compliance.assess_assets(assets, services, as_of)
    return assessed, compliance.executive_summary(assessed)


def unified_alerts(incidents: DataFrame | None = None, detections: DataFrame | None = None,
                   ot: DataFrame | None = None, findings: DataFrame | None = None) -> DataFrame:
    """One list of alerts over whichever parts are given: source, time, severity, address, text."""
    no_time = F.lit(None).cast("bigint")
    parts = []
    if incidents is not None:
        parts.append(incidents.select(F.lit("siem").alias("source"), "us", "severity", "src_ip", F.col("description").alias("text")))
    if detections is not None:
        parts.append(ids.alert_records(detections).select(F.lit("ids").alias("source"), "us", "severity", "src_ip",
                                                          F.col("details").alias("text")))
    if ot is not None:
        parts.append(ot.where("is_alert").select(F.lit("ot").alias("source"), "us", "severity", F.col("source_ip").alias("src_ip"),
                                                 F.col("message").alias("text")))
    if findings is not None:
        parts.append(findings.where(F.col("status") == "FAIL").select(
            F.lit("compliance").alias("source"), no_time.alias("us"), F.col("risk").alias("severity"),
            F.col("asset_id").cast("string").alias("src_ip"), F.col("finding").alias("text")))
    return reduce(DataFrame.unionByName, parts)


def system_summary(raw_logs: DataFrame, incidents: DataFrame, series: DataFrame, events: DataFrame) -> DataFrame:
    """Ingestion, alerts, baselines and look-ups as ``(section, key, value)`` rows."""
    row = lambda section, key, value: [F.lit(section).alias("section"), key.alias("key"), value.cast("double").alias("value")]
    parts = [normalize.ingestion_stats(raw_logs).select(*row("ingestion", F.col("parse_status"), F.col("lines"))),
             incidents.groupBy("severity").count().select(*row("alerts", F.col("severity"), F.col("count"))),
             baseline.baseline_status(series).select(*row("baseline", F.col("metric"), F.col("mean"))),
             enrich.lookup_stats(events).select("total_lookups", "cache_size")
             .unpivot([], ["total_lookups", "cache_size"], "key", "value")
             .select(*row("intel", F.col("key"), F.col("value")))]
    return reduce(DataFrame.unionByName, parts)
