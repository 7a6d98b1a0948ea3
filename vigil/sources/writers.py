"""Sinks for events, alerts, reports, decision logs and rule sets."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, functions as F

from vigil.operators.firewall import log_lines
from vigil.operators.skew import positions

#: Rows of one JSON document of a list.
DOCUMENT_ROWS = 1_000

MAX_DAYS = 1_000


def _existing(df: DataFrame, path: str, key: str) -> DataFrame | None:
    try:
        return df.sparkSession.read.parquet(path).select(key, "event_date")
    except AnalysisException:       # nothing written yet
        return None


def append_unique(df: DataFrame, path: str, key: str, time: str = "event_time") -> None:
    """Append rows whose key is not there yet, partitioned by day.

    Only the days that occur in the batch are read back, as a filter on the partition column, unless
    the batch spans more than ``MAX_DAYS`` days.  Rows without a time form a day of their own.
    """
    rows = df.withColumn("event_date", F.to_date(time)).dropDuplicates([key])
    old = _existing(df, path, key)
    if old is not None:
        days = [r[0] for r in rows.select("event_date").distinct().limit(MAX_DAYS + 1).collect()]
        if len(days) <= MAX_DAYS:
            known = [d for d in days if d is not None]
            wanted = F.col("event_date").isin(known) if known else F.lit(False)
            old = old.where(wanted | F.col("event_date").isNull() if None in days else wanted)
        old = old.select(F.col(key).alias("_key"), F.col("event_date").alias("_day"))
        rows = rows.join(old, F.col(key).eqNullSafe(F.col("_key")) & F.col("event_date").eqNullSafe(F.col("_day")), "left_anti")
    (rows.sortWithinPartitions("event_date", time).write.mode("append").partitionBy("event_date").parquet(path))


def write_events(df: DataFrame, path: str) -> None:
    append_unique(df, path, "event_id")


def write_alerts(df: DataFrame, path: str, key: str = "alert_id") -> None:
    append_unique(df, path, key)


def write_stream(df: DataFrame, path: str, checkpoint: str, key: str = "event_id"):
    """Start a query that appends every micro-batch once (a repeated batch finds its own rows)."""
    return (df.writeStream.foreachBatch(lambda batch, _: append_unique(batch, path, key))
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def write_scan_json(results: DataFrame, path: str, tool: str, generated_at: str, report_type: str = "Network Scan Report") -> None:
    """Reports as JSON lines, each with its metadata header."""
    header = F.struct(F.lit(tool).alias("tool"), F.lit(generated_at).alias("generated_at"),
                      F.lit(report_type).alias("report_type"))
    results.select(header.alias("report_metadata"), F.struct("*").alias("scan_results")).write.mode("overwrite").json(path)


def write_decision_log(decided: DataFrame, path: str) -> None:
    """Fixed-width decision lines as text."""
    log_lines(decided).select("line").write.mode("overwrite").text(path)


def write_list(rows: DataFrame, path: str, order: list[str], record: Column | None = None, head: str = "[", tail: str = "]") -> None:
    """A list of any length as JSON documents of at most ``DOCUMENT_ROWS`` rows, one file each, in the given order.

    Rows are numbered by a range sort, so no task and no value ever holds more than one document.  ``record`` is the
    JSON text of a row, by default of all its columns; ``head`` and ``tail`` go around the rows of each document.
    """
    record = F.to_json(F.struct(*rows.columns)) if record is None else record
    placed = positions(rows.select(*order, record.alias("_record")), order, "_at")
    listed = F.transform(F.sort_array(F.collect_list(F.struct("_at", "_record"))), lambda x: x["_record"])
    documents = placed.groupBy(F.floor((F.col("_at") - 1) / DOCUMENT_ROWS).alias("document")).agg(
        F.concat(F.lit(head), F.array_join(listed, ","), F.lit(tail)).alias("value"))
    documents.write.mode("overwrite").partitionBy("document").text(path)


def write_rules(rules: DataFrame, path: str, default_policy: str = "DENY") -> None:
    """Rule set as JSON documents in rule order, each with the policy and its share of the rules."""
    record = F.to_json(F.struct(*[c for c in rules.columns if c not in ("seq", "default_policy")]))
    write_list(rules, path, ["priority", "seq"], record, f'{{"default_policy": {json.dumps(default_policy)}, "rules": [', "]}")
