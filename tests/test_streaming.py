"""Streaming twins against their batch operators."""

import os
import random
import time

import pandas as pd
import pytest
from pyspark.sql import Window, functions as F

from vigil.operators import baseline, conntrack, ids, ot, thresholds
from vigil.streaming import twins
from test_large_keys import PACKET, events, frame, packets


def stream(spark, df, folder, files=4, order="us"):
    """The rows of ``df`` as a file stream of several batches in time order."""
    path = str(folder / "in")
    (df.withColumn("_part", F.ntile(files).over(Window.orderBy(order)))
     .repartitionByRange(files, "_part").sortWithinPartitions(order).drop("_part").write.parquet(path))
    # the file source takes the oldest file first
    for n, part in enumerate(sorted((folder / "in").glob("part-*.parquet"))):
        os.utime(part, (1_700_000_000 + n, 1_700_000_000 + n))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def run(spark, df, folder, name):
    query = (df.writeStream.format("memory").queryName(name).outputMode("append")
             .option("checkpointLocation", str(folder / "check")).trigger(availableNow=True).start())
    assert query.awaitTermination(240) is not False
    return spark.table(name)


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()))


def test_threshold(spark, tmp_path):
    df = frame(spark, events(11)).withColumnRenamed("event_id", "row")
    one = df.select("src_ip", "us", F.col("row").alias("event_id")).coalesce(1)
    out = run(spark, twins.threshold_stream(stream(spark, one, tmp_path, files=1), "src_ip", 4, 6), tmp_path, "thresholds")
    want = thresholds.all_fires(one, "src_ip", 4, 6_000_000)
    assert rows(out, "key", "us", "row_id") == rows(want, "src_ip", "us", "event_id")


def test_distinct_threshold(spark, tmp_path):
    df = frame(spark, events(12)).withColumnRenamed("event_id", "packet_id").coalesce(1)
    out = run(spark, twins.distinct_threshold_stream(stream(spark, df, tmp_path, files=1), "src_ip", "dst_port", 7, 5), tmp_path, "distincts")
    first = out.groupBy("key").agg(F.min(F.struct("us", "row_id")).alias("f")).select("key", "f.*")
    want = thresholds.first_distinct_fire(df, "src_ip", "dst_port", 7, 5_000_000, event_id="packet_id")
    assert rows(first, "key", "us", "row_id") == rows(want, "src_ip", "us", "packet_id")


def test_connections(spark, tmp_path):
    df = spark.createDataFrame(packets(21, 300), PACKET).coalesce(1)
    out = run(spark, twins.connection_stream(stream(spark, df, tmp_path, files=1)), tmp_path, "connections")
    assert rows(out, "row_id", "conn_state") == rows(conntrack.track(df), "packet_id", "conn_state")


def test_connections_expire(spark, tmp_path):
    tcp = [(1, 0, "a", "b", 1, 2, "TCP", ["SYN"], 40), (2, 31_000_000, "b", "a", 2, 1, "TCP", ["SYN", "ACK"], 40),
           (3, 100_000_000, "c", "d", 1, 2, "UDP", [], 40), (4, 200_000_000, "d", "c", 2, 1, "UDP", [], 40),
           (5, 500_000_000, "d", "c", 2, 1, "UDP", [], 40)]
    # the watermark starts at the epoch, so the packets lie after it
    df = (spark.createDataFrame(tcp, PACKET).withColumn("us", F.col("us") + 10**12)
          .withColumn("event_time", F.timestamp_micros("us")).coalesce(1))
    out = run(spark, twins.connection_stream(stream(spark, df, tmp_path, files=1), expire=True), tmp_path, "expiring")
    # the handshake answer comes too late, the third UDP packet starts anew
    assert rows(out, "row_id", "conn_state") == [(1, "NEW"), (2, "INVALID"), (3, "NEW"), (4, "ESTABLISHED"), (5, "NEW")]


def test_verdicts(spark, tmp_path):
    rng = random.Random(31)
    data = [("1.1.1.1" if rng.random() < 0.6 else "2.2.2.2", rng.randrange(1200) * 500_000, i, rng.randrange(12), "SYN", "TCP", "x") for i in range(1500)]
    df = spark.createDataFrame(data, "src_ip string, us bigint, packet_id bigint, dst_port int, flags string, protocol string, payload string").coalesce(1)
    out = run(spark, twins.verdict_stream(stream(spark, df, tmp_path, files=1)), tmp_path, "verdicts")
    assert rows(out, "row_id", "rule_name") == rows(ids.verdicts(df), "packet_id", "rule_name")


def test_block_list(spark, tmp_path):
    rng = random.Random(32)
    data = [(f"1.1.1.{rng.randrange(3)}", rng.randrange(600) * 500_000, i, rng.random() < 0.05) for i in range(500)]
    df = spark.createDataFrame(data, "src_ip string, us bigint, packet_id bigint, detected boolean").dropDuplicates(["src_ip", "us"]).coalesce(1)
    out = run(spark, twins.block_list_stream(stream(spark, df, tmp_path, files=1)), tmp_path, "blocks")
    want = ids.apply_block_list(df, df.where("detected"))
    assert rows(out, "row_id", "blocked") == rows(want, "packet_id", "blocked")


def test_rate_of_change(spark, tmp_path):
    rng = random.Random(33)
    data = [(i, i * 1_000_000, 6, rng.choice([100, 102, 201]), rng.randrange(0, 601), "HMI") for i in range(300)]
    df = spark.createDataFrame(data, "command_id bigint, us bigint, function_code int, address int, value bigint, source_ip string").coalesce(1)
    out = run(spark, twins.rate_of_change_stream(stream(spark, df, tmp_path, files=1)), tmp_path, "changes")
    want = ot.verdicts(df).where(F.col("check") == "rate_of_change")
    assert rows(out, "row_id") == rows(want, "command_id")


def minute_events(spark, minutes=40):
    rng = random.Random(41)
    data = []
    for m in range(minutes):
        for _ in range(30 if m == 35 else rng.randrange(2, 6)):
            data.append((len(data), (m + 1) * 60_000_000 + rng.randrange(60_000_000), f"1.1.1.{rng.randrange(9)}", "failed_logon", "DENY", 200))
    schema = "event_id bigint, us bigint, src_ip string, event_type string, action string, status_code int"
    return spark.createDataFrame(data, schema).withColumn("event_time", F.timestamp_micros("us"))


@pytest.mark.parametrize("files", [1, 10])
def test_minute_metrics(spark, tmp_path, files):
    """All metrics of all minutes, the last ones too, however many batches the rows come in."""
    df = minute_events(spark)
    out = twins.run_to_end(stream(spark, df, tmp_path, files=files), "event_time", twins.minute_metrics_stream)
    want = baseline.minute_metrics(df)
    assert rows(out, "bucket", *baseline.METRICS) == rows(want, "bucket", *baseline.METRICS) and out.count() == 40


def test_baseline(spark, tmp_path):
    df, found = minute_events(spark), []
    query = twins.baseline_stream(stream(spark, df, tmp_path), str(tmp_path / "table"), str(tmp_path / "check"),
                                  lambda rows_: found.extend(rows_.collect()))
    query.awaitTermination(240)
    assert query.exception() is None
    assert any(r["metric"] == "events_per_minute" and r["bucket"] == 36 * 60_000_000 for r in found)


@pytest.mark.parametrize("files", [1, 7])
def test_scored_minutes(spark, tmp_path, files):
    """Every minute once, with the baseline of the batch operator, whatever the batches."""
    df = minute_events(spark, 100)
    out = twins.run_to_end(stream(spark, df, tmp_path, files=files), "event_time", lambda e: twins.scored_minutes_stream(e, 20))
    want = baseline.score_baseline(baseline.long_metrics(baseline.minute_metrics(df)), window=20)
    names = ("metric", "bucket", "value", "baseline_rows", "z_score", "is_anomaly", "severity")
    assert rows(out, *names) == rows(want, *names) and out.count() == 500 and out.where("is_anomaly").count() > 3


def test_incident_quiet_time(spark, tmp_path):
    data = [("scan", "1.1.1.1", 0), ("scan", "1.1.1.1", 60), ("scan", "2.2.2.2", 70), ("brute", "1.1.1.1", 80)]
    df = spark.createDataFrame(data, "attack_type string, src_ip string, s bigint").withColumn("event_time", F.timestamp_seconds("s")).coalesce(1)
    out = run(spark, twins.distinct_incidents(stream(spark, df, tmp_path, files=1, order="s")), tmp_path, "quiet")
    assert rows(out, "attack_type", "src_ip") == [("brute", "1.1.1.1"), ("scan", "1.1.1.1"), ("scan", "2.2.2.2")]


def test_normalized(spark, tmp_path):
    lines = [("vpn", "2026-04-05 10:00:01 [VPN] AUTH_FAIL USER=hacker IP=45.2.3.11"), ("vpn", "nonsense")]
    df = spark.createDataFrame(lines, "log_type string, raw string").coalesce(1)
    out = run(spark, twins.normalized_stream(stream(spark, df, tmp_path, files=1, order="raw")), tmp_path, "normal")
    assert rows(out, "event_type", "severity", "threat_type") == [("vpn_auth_fail", 7, "brute_force")]


@pytest.mark.parametrize("files", [1, 10])
def test_trailing_counts(spark, tmp_path, files):
    """Every row with the rows of the five minutes up to it, also across cells, batches and equal moments."""
    df = minute_events(spark).withColumn("us", F.col("us") - F.col("us") % 500_000).withColumn("event_time", F.timestamp_micros("us"))
    found = twins.run_to_end(stream(spark, df, tmp_path, files=files), "event_time", lambda e: twins.trailing_counts(e, ("src_ip",)))
    data = sorted((r.us, r.event_id, r.src_ip) for r in df.collect())
    want = [(ip, us, i, sum(o[2] == ip and us - 300_000_000 <= o[0] for o in data[:n + 1])) for n, (us, i, ip) in enumerate(data)]
    assert rows(found, "src_ip", "us", "row_id", "n") == sorted(want)


def test_trailing_counts_in_any_order(spark, tmp_path):
    """Rows that come late, but not later than the watermark allows, count as if they had come in time."""
    df = minute_events(spark).withColumn("arrival", F.col("us") + F.pmod(F.xxhash64("event_id"), F.lit(200)) * 1_000_000)
    found = twins.run_to_end(stream(spark, df, tmp_path, files=8, order="arrival"), "event_time", lambda e: twins.trailing_counts(e, ("src_ip",), delay="10 minutes"))
    whole = twins.run_to_end(stream(spark, df, tmp_path / "whole", files=1), "event_time", lambda e: twins.trailing_counts(e, ("src_ip",)))
    assert rows(found, "src_ip", "us", "row_id", "n") == rows(whole, "src_ip", "us", "row_id", "n") and found.count() == df.count()


def test_retraining(spark, tmp_path):
    assert twins.retraining_due(50, 0, 301) and not twins.retraining_due(49, 0, 999) and not twins.retraining_due(80, 0, 300)
    df = minute_events(spark).select("event_id", "status_code")
    twins.feature_stream(stream(spark, df, tmp_path, order="event_id"), str(tmp_path / "features"), str(tmp_path / "check")).awaitTermination(240)
    assert twins.stored_features(spark, str(tmp_path / "features")).count() == df.count()
    newest = twins.stored_features(spark, str(tmp_path / "features"), "event_id", 10)
    assert sorted(r[0] for r in newest.select("event_id").collect()) == sorted(r[0] for r in df.orderBy(F.desc("event_id")).limit(10).select("event_id").collect())


def test_state_ends_and_late_rows_are_counted(spark, tmp_path):
    """Sources come and go for hours: only those of the last window are remembered, and a row from long ago is dropped."""
    data = [(f"s{i // 3}", (i + 1) * 60_000_000, i) for i in range(360)] + [("late", 60_000_000, 999), ("s119", 361 * 60_000_000, 1000)]
    df = spark.createDataFrame(data, "src_ip string, us bigint, event_id bigint").withColumn("arrival", F.when(F.col("event_id") > 900, 1 << 40).otherwise(F.col("us")))
    rows_in = stream(spark, df, tmp_path, files=12, order="arrival").drop("arrival")
    query = (twins.threshold_stream(rows_in, "src_ip", 3, 150).writeStream.format("memory").queryName("bounded").outputMode("append")
             .option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start())
    assert query.awaitTermination(240) is not False
    assert {r.key for r in spark.table("bounded").collect()} == {f"s{k}" for k in range(120)}
    totals = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert max(totals) < 2 * 60 and totals[-1] < 60
    assert twins.late_rows(query) == 1


def test_blocks_end(spark, tmp_path):
    """A source that is not blocked any more is not remembered."""
    data = [(f"b{i}", i * 60_000_000, i, True) for i in range(1, 200)]
    df = spark.createDataFrame(data, "src_ip string, us bigint, packet_id bigint, detected boolean")
    query = (twins.block_list_stream(stream(spark, df, tmp_path, files=10), delay="1 minute").writeStream.format("memory").queryName("blocks_end")
             .outputMode("append").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start())
    assert query.awaitTermination(240) is not False
    assert spark.table("blocks_end").where("blocked").count() == 199
    assert query.recentProgress[-1]["stateOperators"][0]["numRowsTotal"] < 40


def test_trailing_counts_of_many_sparse_keys(spark, tmp_path):
    """Keys with one or two rows are answered many at a time; a call and a state of its own for each took minutes."""
    df = spark.range(12_000).select(F.concat(F.lit("s"), F.floor(F.col("id") / 2).cast("string")).alias("src_ip"), (F.col("id") * 100_000_000).alias("us"),
                                    F.col("id").alias("event_id")).withColumn("event_time", F.timestamp_micros("us"))
    started = time.monotonic()
    found = twins.run_to_end(stream(spark, df, tmp_path, files=1), "event_time", lambda e: twins.trailing_counts(e, ("src_ip",)))
    assert rows(found, "row_id", "n") == [(k, 1 + k % 2) for k in range(12_000)]
    assert time.monotonic() - started < 90


def test_value_at_the_limit_is_no_anomaly(spark):
    """Sixty counts of mean 20 and deviation 20, then 60: exactly two deviations away, which is not more than two."""
    counts = [0] * 23 + [10] * 5 + [20] * 10 + [30] * 4 + [40] * 10 + [50] * 6 + [60, 70]
    random.Random(0).shuffle(counts)
    assert (sum(counts), sum(x * x for x in counts)) == (1200, 47600)
    series = spark.createDataFrame([("m", k, float(x)) for k, x in enumerate([*counts, 60])], "metric string, bucket bigint, value double")
    batch = baseline.score_baseline(series).orderBy(F.desc("bucket")).first()
    assert (batch.baseline_std, batch.z_score, batch.is_anomaly) == (20.0, 2.0, False)
    last = twins.Baseline(60)
    last.last = type("State", (), {"exists": lambda self: True, "get": lambda self: ([float(x) for x in counts],), "update": lambda self, value: None})()
    [one] = last.handleInputRows(("m",), iter([pd.DataFrame({"bucket": [60], "value": [60.0]})]), None)
    assert one["baseline_std"].tolist() == [20.0]
