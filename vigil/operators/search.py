"""Filters, searches and newest-first views."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from vigil.functions.network import ip_to_num
from vigil.operators.skew import positions


def newest(df: DataFrame, n: int, us: str = "us", row_id: str = "event_id") -> DataFrame:
    """The ``n`` newest rows, newest first; every task keeps only its own ``n`` before the merge."""
    return df.orderBy(F.desc(us), F.desc(row_id)).limit(n)


def equal_to(df: DataFrame, column: str, value) -> DataFrame:
    return df.where(F.col(column) == value)


def alerts_by_severity(alerts: DataFrame, severity: str | None = None, n: int = 20) -> DataFrame:
    """Newest alerts, of one severity (any case) or of all."""
    rows = alerts if not severity else alerts.where(F.lower("severity") == severity.lower())
    return newest(rows, n)


def logs_by_source(events: DataFrame, source: str | None = None, n: int = 100) -> DataFrame:
    """The ``n`` newest events, of one source or of all."""
    rows = events if not source else equal_to(events, "source_type", source)
    return newest(rows, n)


def search_logs(events: DataFrame, text: str = "", source: str = "", severity_min: int = 0,
                n: int = 50) -> DataFrame:
    """Newest ``n`` events whose row contains ``text`` in any case, with the number of all hits.

    Source and severity are plain predicates that reach the scan; the text is compared with all
    values of the row.
    """
    rows = events
    if source:
        rows = equal_to(rows, "source_type", source)
    if severity_min:
        rows = rows.where(F.col("severity") >= severity_min)
    if text:
        values = [F.col(c).cast("string") for c in events.columns]
        rows = rows.where(F.lower(F.concat_ws(" ", *values)).contains(text.lower()))
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    return newest(rows, n).withColumn("total", total.scalar())


def distinct_targets(df: DataFrame, target: str = "target") -> DataFrame:
    """Distinct entries of comma lists."""
    return df.select(F.explode(F.transform(F.split(target, ","), lambda x: F.trim(x))).alias(target)).distinct()


def hosts_in_order(df: DataFrame, n: int | None = None, ip: str = "ip", row_id: str = "row_id") -> DataFrame:
    """All hosts, or the first ``n``, with their position in numeric address order."""
    rows = df.withColumn("_number", ip_to_num(ip))
    if n is not None:
        rows = rows.orderBy("_number", row_id).limit(n)
    return positions(rows, ["_number", row_id]).drop("_number")


def ports_in_order(services: DataFrame) -> DataFrame:
    """Ports per asset in order, with the number of services on them and the first one."""
    return (services.groupBy("asset_id", "port")
            .agg(F.count(F.lit(1)).alias("services"), F.min("service_id").alias("first_service"))
            .orderBy("asset_id", "port"))
