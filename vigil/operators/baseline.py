"""Minute metrics, rolling baselines and their status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from vigil import fixed
from vigil.operators.skew import hot_keys, ordered_pieces, running, with_carry
from vigil.session import durable

METRICS = ["events_per_minute", "logins_per_minute", "denies_per_minute", "unique_src_ips", "error_rate"]


def minute_metrics(events: DataFrame, bucket_seconds: int = 60, us: str = "us") -> DataFrame:
    """Counts per closed time bucket; ``bucket`` is its start in microseconds.

    A bucket without events gives no row.  ``error_rate`` is the number of 5xx answers.
    """
    width = bucket_seconds * 1_000_000
    bucket = (F.col(us) - F.pmod(F.col(us), F.lit(width))).cast("bigint")
    # one row per (bucket, source) first: the distinct count then needs no second pass over events
    per_source = events.groupBy(bucket.alias("bucket"), "src_ip").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("event_type").isin("failed_logon", "successful_logon")).alias("logins"),
        F.count_if(F.col("action").isin(fixed.BLOCK_ACTIONS)).alias("denies"),
        F.count_if(F.col("status_code") >= 500).alias("errors"))
    return per_source.groupBy("bucket").agg(
        F.sum("n").alias("events_per_minute"), F.sum("logins").alias("logins_per_minute"),
        F.sum("denies").alias("denies_per_minute"),
        F.count_if(F.col("src_ip") != "").alias("unique_src_ips"), F.sum("errors").alias("error_rate"))


def long_metrics(metrics: DataFrame) -> DataFrame:
    """``(bucket, metric, value)`` rows of a wide metrics table."""
    return (metrics.unpivot("bucket", METRICS, "metric", "value")
            .withColumn("value", F.col("value").cast("double")))


def judged(series: DataFrame, sensitivity: float = 2.0, minimum: int = 10) -> DataFrame:
    """Verdicts on rows that hold ``value``, ``baseline_mean``, ``baseline_std`` and ``baseline_rows``.

    Fewer than ``minimum`` earlier values are never anomalous.  Without spread any other value
    is, with z = 0.  ``z_score`` is rounded to 2 digits and the severity reads the rounded one.
    """
    mean, std = F.col("baseline_mean"), F.col("baseline_std")
    flat, ready = std == 0, F.col("baseline_rows") >= minimum
    distance = F.when(~flat, F.abs(F.col("value") - mean) / std)
    z = F.when(ready & ~flat, F.round(distance, 2)).otherwise(F.lit(0.0))
    anomalous = ready & F.when(flat, F.col("value") != mean).otherwise(distance > sensitivity)
    return (series.withColumns({"z_score": z, "is_anomaly": F.coalesce(anomalous, F.lit(False))})
            .withColumn("severity", F.when(F.col("z_score") > 3.5, "Critical")
                        .when(F.col("z_score") > 2.5, "High").otherwise("Medium")))


def look_back(series: DataFrame, key: str, rows: int, columns, hot: dict) -> DataFrame:
    """``columns(rows, window)`` per key in the order of ``bucket``, for expressions that look back on at most ``rows`` rows.

    A series in ``hot`` is cut into range pieces, and each gets the ``rows`` rows before it.
    """
    if not hot:
        return columns(series, Window.partitionBy(key).orderBy("bucket"))
    pieces = with_carry(ordered_pieces(series, key, ["bucket"], hot), key, ["bucket"], rows)
    return columns(pieces, Window.partitionBy(key, "piece").orderBy("bucket")).where(~F.col("carried")).drop("carried", "piece")


def spread(values: Column) -> Column:
    """Sample deviation of an array of doubles, 0 below two values.

    Sums of the distances from the first value are exact for counts, so that a value at the limit itself is not taken for one
    beyond it, as happens where moments are updated row by row.
    """
    apart = F.transform(values, lambda x: x - F.get(values, F.lit(0)))
    sums = F.aggregate(apart, F.struct(F.lit(0.0).alias("total"), F.lit(0.0).alias("squares")),
                       lambda s, x: F.struct((s["total"] + x).alias("total"), (s["squares"] + x * x).alias("squares")))
    n = F.size(values)
    return F.transform(F.array(sums), lambda s: F.when(n > 1, F.sqrt(F.greatest(n * s["squares"] - s["total"] * s["total"], F.lit(0.0)) / (n * (n - 1))))
                       .otherwise(0.0))[0]


def score_baseline(series: DataFrame, window: int = 60, sensitivity: float = 2.0, minimum: int = 10) -> DataFrame:
    """Compare every value with the ``window`` values before it; see :func:`judged`."""
    def compared(rows, order):
        before = order.rowsBetween(-window, -1)
        return rows.withColumns({"baseline_mean": F.avg("value").over(before),
                                 "baseline_std": spread(F.collect_list("value").over(before)),
                                 "baseline_rows": F.count("value").over(before)})
    series = durable(series)
    return judged(look_back(series, "metric", window, compared, hot_keys(series, "metric")), sensitivity, minimum)


def described(scored: DataFrame) -> DataFrame:
    """Anomalous values of scored rows, with their description."""
    text = F.format_string("Anomaly detected in %s: %.1f (baseline: %.1f ± %.1f, Z=%s)", "metric", "value",
                           "baseline_mean", "baseline_std", F.col("z_score").cast("string"))
    return scored.where("is_anomaly").withColumn("description", text)


def anomalies(series: DataFrame, **options) -> DataFrame:
    """Anomalous values only, with their description."""
    return described(score_baseline(series, **options))


def baseline_status(series: DataFrame, window: int = 60) -> DataFrame:
    """Mean, spread and size of the newest ``window`` values per metric, and all values seen."""
    newest = Window.partitionBy("metric").orderBy(F.desc("bucket"))
    totals = series.groupBy("metric").agg(F.count(F.lit(1)).alias("total_observations"))
    return (series.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= window)
            .groupBy("metric")
            .agg(F.round(F.avg("value"), 2).alias("mean"),
                 F.round(F.coalesce(F.stddev_samp("value"), F.lit(0.0)), 2).alias("std_dev"),
                 F.count(F.lit(1)).alias("window_size"))
            .join(F.broadcast(totals), "metric"))


PACKET_METRICS = ["packet_rate", "avg_packet_size", "syn_ratio", "unique_dst_ports", "icmp_ratio",
                  "port_scan_score"]


def packet_metrics(packets: DataFrame, sensor: str, bucket_seconds: int = 60, us: str = "us") -> DataFrame:
    """Traffic measures per sensor and time bucket.

    Rolling statistics then run over a few rows per bucket instead of over raw packets.
    """
    width = bucket_seconds * 1_000_000
    syn = F.col("flags") == "SYN"
    score = F.when(syn & (F.col("dst_port") > 1024), 0.8).when(syn, 0.2).otherwise(0.0)
    return (packets.groupBy(F.col(sensor).alias("sensor"),
                            (F.col(us) - F.pmod(F.col(us), F.lit(width))).cast("bigint").alias("bucket"))
            .agg((F.count(F.lit(1)) / F.lit(float(bucket_seconds))).alias("packet_rate"),
                 F.avg("size").alias("avg_packet_size"),
                 F.avg(syn.cast("double")).alias("syn_ratio"),
                 F.avg(F.least(F.col("dst_port") / 65535.0, F.lit(1.0))).alias("unique_dst_ports"),
                 F.avg((F.col("protocol") == "ICMP").cast("double")).alias("icmp_ratio"),
                 F.avg(score).alias("port_scan_score")))


def score_packet_metrics(metrics: DataFrame, history: int = 200, refresh: int = 10,
                         threshold: float = 3.0) -> DataFrame:
    """z-score of every measure against a baseline that is refreshed every ``refresh`` samples.

    The baseline is mean and population spread of up to ``history`` samples, taken at the last
    refresh before the sample; it starts as (0, 1), and a spread of 0 counts as 1.
    """
    series = durable(metrics.unpivot(["sensor", "bucket"], PACKET_METRICS, "metric", "value").withColumn("_key", F.concat_ws("|", "sensor", "metric")))
    hot = hot_keys(series, "_key")
    numbered = running(series, "_key", ["bucket"], F.sum, {"_k": F.lit(1)}) if hot else \
        series.withColumn("_k", F.row_number().over(Window.partitionBy("_key").orderBy("bucket")))

    def compared(rows, order):
        recent = order.rowsBetween(-(history - 1), 0)
        spread = F.stddev_pop("value").over(recent)
        at_refresh = F.when(F.col("_k") % refresh == 0, F.struct(F.col("_mean").alias("mean"), F.col("_std").alias("std")))
        return (rows.withColumns({"_mean": F.avg("value").over(recent), "_std": F.when(spread == 0, 1.0).otherwise(spread)})
                .withColumn("_base", F.last(at_refresh, ignorenulls=True).over(order.rowsBetween(-refresh, -1))))
    # the refresh before a sample lies at most ``refresh`` rows back, and its samples ``history`` rows before that
    return (look_back(numbered, "_key", history + refresh, compared, hot)
            .withColumns({"baseline_mean": F.coalesce("_base.mean", F.lit(0.0)),
                          "baseline_std": F.coalesce("_base.std", F.lit(1.0))})
            .withColumn("z_score", F.abs((F.col("value") - F.col("baseline_mean")) / F.col("baseline_std")))
            .withColumn("is_anomaly", F.col("z_score") > threshold)
            .drop("_k", "_mean", "_std", "_base", "_key"))


def packet_baseline_status(metrics: DataFrame, history: int = 200) -> DataFrame:
    """Newest mean and spread per sensor and measure."""
    series = metrics.unpivot(["sensor", "bucket"], PACKET_METRICS, "metric", "value")
    newest = Window.partitionBy("sensor", "metric").orderBy(F.desc("bucket"))
    return (series.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= history)
            .groupBy("sensor", "metric")
            .agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"),
                 F.count(F.lit(1)).alias("window_size")))
