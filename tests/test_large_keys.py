"""Keys that are cut into pieces must give what plain replay gives."""

import random
from collections import defaultdict, deque

import pytest
from pyspark.sql import functions as F

from compare import compare, oracle
from conftest import SF
from vigil.operators import conntrack, correlate, ids, ot, skew, thresholds


def events(seed, n=400, keys=3, span=300, ports=14):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        key = "a" if rng.random() < 0.5 else f"k{rng.randrange(keys)}"
        out.append((key, rng.randrange(span) * 500_000, i, rng.randrange(ports), rng.randrange(100)))
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "src_ip string, us bigint, event_id bigint, dst_port int, value int").repartition(5)


def by_key(rows):
    groups = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r[1], r[2])):
        groups[r[0]].append(r)
    return groups


def replay(rows, n, window, clear):
    fires = []
    for key, group in by_key(rows).items():
        times = deque()
        for r in group:
            times.append(r[1])
            while r[1] - times[0] > window:
                times.popleft()
            if len(times) >= n:
                fires.append((key, r[1], r[2]))
                if not clear:
                    break
                times.clear()
    return sorted(fires)


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("n,window", [(1, 1_000_000), (3, 4_000_000), (6, 9_000_000)])
def test_first_fire(spark, seed, n, window):
    rows = events(seed)
    got = thresholds.first_fire(frame(spark, rows), "src_ip", n, window).select("src_ip", "us", "event_id").collect()
    assert sorted(map(tuple, got)) == replay(rows, n, window, clear=False)


@pytest.mark.parametrize("n,window", [(1, 1_000_000), (3, 4_000_000), (6, 9_000_000)])
def test_all_fires_cut(spark, hot, n, window):
    rows = events(3)
    got = thresholds.all_fires(frame(spark, rows), "src_ip", n, window).select("src_ip", "us", "event_id").collect()
    assert sorted(map(tuple, got)) == replay(rows, n, window, clear=True)


def test_all_fires_whole(spark):
    rows = events(4)
    got = thresholds.all_fires(frame(spark, rows), "src_ip", 4, 6_000_000).select("src_ip", "us", "event_id").collect()
    assert sorted(map(tuple, got)) == replay(rows, 4, 6_000_000, clear=True)


@pytest.mark.parametrize("seed", [5, 6])
def test_first_distinct_fire(spark, seed):
    rows, n, window = events(seed), 6, 5_000_000
    want = []
    for key, group in by_key(rows).items():
        for i, r in enumerate(group):
            if len({p[3] for p in group[:i + 1] if r[1] - p[1] <= window}) >= n:
                want.append((key, r[1], r[2]))
                break
    got = thresholds.first_distinct_fire(frame(spark, rows), "src_ip", "dst_port", n, window)
    assert sorted(map(tuple, got.select("src_ip", "us", "event_id").collect())) == sorted(want)


def test_lags_cut(spark, hot):
    rows = events(7)
    got = skew.lag_columns(frame(spark, rows), "src_ip", ["us", "event_id"], {"one": ("value", 1), "ten": ("us", 10)})
    want = []
    for group in by_key(rows).values():
        for i, r in enumerate(group):
            want.append((r[2], group[i - 1][4] if i else None, group[i - 10][1] if i >= 10 else None))
    assert sorted(map(tuple, got.select("event_id", "one", "ten").collect())) == sorted(want)


def test_running_and_counts_cut(spark, hot):
    rows, window = events(8), 5_000_000
    df = frame(spark, rows)
    top = skew.running(df, "src_ip", ["us", "event_id"], F.max, {"top": F.col("value")}).select("event_id", "top")
    counts = skew.rows_in_window(df, "src_ip", window, "n").select("event_id", "n")
    want_top, want_n = [], []
    for group in by_key(rows).values():
        for i, r in enumerate(group):
            want_top.append((r[2], max(p[4] for p in group[:i + 1])))
            want_n.append((r[2], sum(r[1] - p[1] <= window for p in group[:i + 1])))
    assert sorted(map(tuple, top.collect())) == sorted(want_top)
    assert sorted(map(tuple, counts.collect())) == sorted(want_n)


def packets(seed, n=500):
    rng = random.Random(seed)
    flags = [["SYN"], ["SYN", "ACK"], ["ACK"], ["ACK", "FIN"], ["FIN"], ["RST"], ["PSH", "ACK"], []]
    weights = [3, 3, 6, 2, 2, 0.3, 2, 1]
    out = []
    for i in range(n):
        a, b = ("10.0.0.1", 1000), ("10.0.0.2", 80 + (0 if rng.random() < 0.5 else rng.randrange(6)))
        if rng.random() < 0.5:
            a, b = b, a
        protocol = rng.choice(["TCP"] * 4 + ["UDP", "ICMP", "OTHER"])
        if protocol == "ICMP":
            a, b = (a[0], 0), (b[0], 0)
        out.append((i, rng.randrange(300) * 100_000, a[0], b[0], a[1], b[1], protocol, rng.choices(flags, weights)[0], 10 + i % 5))
    return out


PACKET = "packet_id bigint, us bigint, src_ip string, dst_ip string, src_port int, dst_port int, protocol string, tcp_flags array<string>, size int"


def replay_connections(rows):
    from vigil.streaming.twins import Connections
    machine, states, out = Connections(), {}, []

    class Row:
        pass

    for p in sorted(rows, key=lambda p: (p[1], p[0])):
        row = Row()
        row.row_id, row.us, row.src_ip, row.dst_ip, row.src_port, row.dst_port, row.protocol, row.tcp_flags, _ = p
        key = "-".join(f"{ip}:{port}" for ip, port in sorted([(p[2], p[4]), (p[3], p[5])])) + "-" + p[6]
        states[key], found = machine.step(states.get(key), row)
        out += [(key, p[0], found[0][2])]
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_connection_states(spark, seed):
    rows = packets(seed)
    got = conntrack.track(spark.createDataFrame(rows, PACKET)).select("conn_key", "packet_id", "conn_state")
    assert sorted(map(tuple, got.collect())) == replay_connections(rows)


def test_connection_states_cut(spark, hot):
    rows = packets(4)
    got = conntrack.track(spark.createDataFrame(rows, PACKET)).select("conn_key", "packet_id", "conn_state")
    assert sorted(map(tuple, got.collect())) == replay_connections(rows)


def replay_verdicts(rows):
    """Packet by packet, blocks ending on whole seconds."""
    syn, ports, until, out = defaultdict(deque), defaultdict(deque), {}, []
    for ip, us, pid, port, flags, payload in sorted(rows, key=lambda r: (r[1], r[2])):
        if us < until.get(ip, 0):
            out.append((pid, "IP Blocked"))
            continue
        if "<script>" in payload:
            out.append((pid, "XSS — Script Tag Injection"))
            continue
        name = ""
        if flags == "SYN":
            syn[ip].append(us)
            while us - syn[ip][0] > 10_000_000:
                syn[ip].popleft()
            whole = -(-us // 1_000_000) * 1_000_000
            if len(syn[ip]) >= 20:
                syn[ip].clear()
                until[ip], name = whole + 300_000_000, "SYN Flood Detected"
            elif port:
                ports[ip].append((us, port))
                while us - ports[ip][0][0] > 30_000_000:
                    ports[ip].popleft()
                if len({p for _, p in ports[ip]}) >= 10:
                    ports[ip].clear()
                    until[ip], name = whole + 120_000_000, "Port Scan Detected"
        out.append((pid, name))
    return sorted(out)


@pytest.mark.parametrize("seed,span,ports", [(1, 1500, 30), (2, 9000, 30), (3, 9000, 6), (4, 4000, 400), (5, 40000, 12)])
def test_verdicts(spark, seed, span, ports):
    rng = random.Random(seed)
    rows = []
    for i in range(4000):
        ip = "1.1.1.1" if rng.random() < 0.6 else f"2.2.2.{rng.randrange(5)}"
        start = rng.choice([0, 0, span // 2, span - 40])
        second = start + int(rng.expovariate(1 / 60)) if rng.random() < 0.6 else rng.randrange(span)
        # moments on a grid of half seconds give many ties and rows exactly at block ends
        rows.append((ip, second * 1_000_000 + rng.choice([0, 0, 500_000]), i, rng.randrange(ports),
                     rng.choice(["SYN", "SYN", "SYN", "ACK"]), "<script>" if rng.random() < 0.05 else ""))
    df = spark.createDataFrame(rows, "src_ip string, us bigint, packet_id bigint, dst_port int, flags string, payload string")
    df = df.withColumns({"protocol": F.lit("TCP")}).withColumn(
        "dst_port", F.when(F.col("payload") != "", 80).otherwise(F.col("dst_port")))
    want = replay_verdicts([(r[0], r[1], r[2], 80 if r[5] else r[3], r[4], r[5]) for r in rows])
    got = ids.verdicts(df).select("packet_id", "rule_name").collect()
    assert sorted(map(tuple, got)) == want
    assert {"SYN Flood Detected"} & {w[1] for w in want} or {"Port Scan Detected"} & {w[1] for w in want}


def test_layers_equal_single_thresholds(spark):
    rng = random.Random(9)
    kinds = [("active_directory", "failed_logon", "FAILURE"), ("firewall", "network_traffic", "DENY"),
             ("web_server", "injection_attempt", "GET"), ("vpn", "vpn_auth_fail", "AUTH_FAIL")]
    rows = []
    for i in range(600):
        source, kind, action = rng.choice(kinds)
        ip = "9.9.9.9" if rng.random() < 0.4 else f"8.8.8.{rng.randrange(6)}"
        rows.append((i, rng.randrange(2000) * 1_000_000, source, kind, action, ip, "10.0.0.1", rng.randrange(40), "bob", "/x"))
    df = spark.createDataFrame(rows, "event_id bigint, us bigint, source_type string, event_type string, action string, "
                                     "src_ip string, dst_ip string, dst_port int, username string, uri string")
    fires = {(r["layer"], r["src_ip"], r["us"], r["event_id"]) for r in correlate.layer_fires(df).collect()}
    single = set()
    for layer, build in (("login", correlate.brute_force), ("deny", correlate.port_scan),
                         ("web", correlate.web_attack), ("vpn", correlate.vpn_brute_force)):
        single |= {(layer, r["src_ip"], r["us"], r["event_id"]) for r in build(df).collect()}
    assert fires == single and fires
    windows = {n: w * 1_000_000 for n, (_, w) in correlate.LAYERS.items()}
    of = {"failed_logon": "login", "network_traffic": "deny", "injection_attempt": "web", "vpn_auth_fail": "vpn"}
    want = {}
    for r in sorted(rows, key=lambda r: (r[1], r[0])):
        active = sum(sum(1 for o in rows if o[5] == r[5] and of[o[3]] == n and r[1] - windows[n] <= o[1] <= r[1]) >= k
                     for n, k in correlate.VECTOR_ROWS.items())
        if active >= 3 and r[5] not in want:
            want[r[5]] = (r[1], r[0], active)
    got = {r["src_ip"]: (r["us"], r["event_id"], r["vectors"]) for r in correlate.multi_vector(df).collect()}
    assert got == want and got


def test_ot_verdicts_cut(spark, hot):
    rng = random.Random(5)
    rows = [(i, rng.randrange(120) * 1_000_000, 6, rng.choice([100, 100, 100, 102, 999]), rng.randrange(200, 601), "HMI") for i in range(300)]
    schema = "command_id bigint, us bigint, function_code int, address int, value bigint, source_ip string"
    df = spark.createDataFrame(rows, schema)
    cut = sorted(map(tuple, ot.verdicts(df).select("command_id", "check", "message").collect()))
    spark.conf.unset("spark.vigil.rowsPerTask")
    whole = sorted(map(tuple, ot.verdicts(df).select("command_id", "check", "message").collect()))
    assert cut == whole and {"rate_of_change", "write_frequency", "range_violation"} <= {c[1] for c in cut}


# ------------------------------------------------------------------ registered queries with hot keys

SKEWED = ["e17_ot_counters", "f13_write_frequency", "h1_unauthorized_writers", "h2_readonly_writes", "h3_range_violations",
          "h4_accepted_history", "h5_rapid_changes", "h6_frequent_writes", "h8_shutdown_latch", "h8_trip_counts", "h10_change_log",
          "h12_event_list", "h13_alert_records", "j5_command_verdicts", "j8_unified_alerts",
          "d20_suspicious_vectors", "f8_multi_vector", "f14_rolling_baseline", "f15_packet_baseline", "j3_siem_incidents"]


@pytest.mark.parametrize("limit", ["200", "2000"])
@pytest.mark.parametrize("name", SKEWED)
def test_registered_queries_with_hot_keys(spark, name, limit):
    """The rows equal the oracle's whichever keys are cut into pieces."""
    spark.conf.set("spark.vigil.rowsPerTask", limit)
    try:
        ok, message, _, _ = compare(name, spark, oracle(SF), SF)
    finally:
        spark.conf.unset("spark.vigil.rowsPerTask")
    assert ok, message


def test_repeated_ids_keep_their_rows(spark, hot):
    """A hot key whose ids repeat keeps one row per row, with the counts of a plain replay."""
    rows = [("a", i // 2, 1_000_000 * (i // 3)) for i in range(60)] + [("b", 0, 5)]
    df = spark.createDataFrame(rows, "k string, event_id long, us long")
    got = sorted((r.k, r.event_id, r.us, r.n) for r in skew.rows_in_window(df, "k", 4_000_000, "n").collect())
    ordered, want = sorted(rows, key=lambda r: (r[0], r[2], r[1])), []
    for i, (k, e, us) in enumerate(ordered):
        want.append((k, e, us, sum(x[0] == k and us - 4_000_000 <= x[2] for x in ordered[:i + 1])))
    assert got == sorted(want)


def test_positions_count_all_rows(spark):
    df = spark.createDataFrame([(i * 7 % 101,) for i in range(101)], "v int")
    assert [tuple(r) for r in skew.positions(df, ["v"]).orderBy("v").collect()] == [(v, v + 1) for v in range(101)]


def test_baselines_of_long_series(spark):
    """Two measures over many seconds, cut into pieces shorter than the window, against one task per measure."""
    from vigil.operators import baseline
    rng = random.Random(6)
    rows = [("m" if rng.random() < 0.7 else "n", k, float(rng.choice([1, 1, 2, 3, 50]))) for k in range(900)]
    series = spark.createDataFrame(rows, "metric string, bucket bigint, value double")
    packets = spark.createDataFrame([("s", k, *[float(rng.randrange(9)) for _ in baseline.PACKET_METRICS]) for k in range(700)],
                                    "sensor string, bucket bigint, " + ", ".join(f"{m} double" for m in baseline.PACKET_METRICS))

    def read():
        a = baseline.score_baseline(series, window=60).select("metric", "bucket", "baseline_rows", "z_score", "is_anomaly", F.round("baseline_mean", 9))
        b = baseline.score_packet_metrics(packets).select("sensor", "metric", "bucket", F.round("baseline_mean", 9), F.round("z_score", 6), "is_anomaly")
        return sorted(map(tuple, a.collect())), sorted(map(tuple, b.collect()))
    whole = read()
    spark.conf.set("spark.vigil.rowsPerTask", "45")
    try:
        assert read() == whole
    finally:
        spark.conf.unset("spark.vigil.rowsPerTask")


def test_running_up_to_the_row_before(spark, hot):
    """Maxima over the rows in front of each row, in one pass and over the cuts of a hot key."""
    data = [("a" if k % 4 else "b", k, (k * 37) % 101 if k % 3 else None) for k in range(60)]
    df = spark.createDataFrame(data, "key string, us bigint, value int")
    found = skew.running(df, "key", ["us"], F.max, {"upto": F.col("value")}, {"before": F.col("value")})
    most = lambda key, until: max((v for k, t, v in data if k == key and t < until and v is not None), default=None)
    assert sorted((r.key, r.us, r.upto, r.before) for r in found.collect()) == sorted((k, t, most(k, t + 1), most(k, t)) for k, t, _ in data)
