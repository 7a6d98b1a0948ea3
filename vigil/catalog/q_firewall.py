"""Firewall, zone, rule and connection queries."""

from pyspark.sql import functions as F

from vigil import fixed, tables
from vigil.catalog.q_enrich import NUM
from vigil.catalog.registry import query, quote, rows
from vigil.functions.network import literal_range
from vigil.operators import conntrack as K
from vigil.operators import expiry as X
from vigil.operators import firewall as W
from vigil.operators import rules as R

_ORDER = sorted(((t, z, c) for z, t, cs in fixed.ZONES if z != "untrusted" for c in cs), reverse=True)


def zone(ip):
    cases = " ".join("WHEN {n} BETWEEN {a} AND {b} THEN '{z}'".format(n=NUM.format(ip), a=literal_range(c)[0], b=literal_range(c)[1], z=z)
                     for _, z, c in _ORDER)
    return f"CASE {cases} ELSE 'untrusted' END"


ZONED = f"SELECT p.*, {zone('src_ip')} AS zone_src, {zone('dst_ip')} AS zone_dst FROM @packets p"
POLICIES = rows(fixed.ZONE_POLICIES)
POLICY = f"""SELECT z.*, CASE WHEN zone_src = zone_dst THEN 'ALLOW' ELSE coalesce(a, 'DENY') END AS zone_policy FROM ({ZONED}) z
 LEFT JOIN (VALUES {POLICIES}) p(s, d, a) ON p.s = z.zone_src AND p.d = z.zone_dst"""


def _inside(ip, cidr):
    if cidr == "any":
        return None
    lo, hi = literal_range(cidr)
    return f"{NUM.format(ip)} BETWEEN {lo} AND {hi}"


def rule_sql(r):
    tests = [f"direction = '{r[9]}'" if r[9] != "ANY" else None, f"protocol = '{r[4]}'" if r[4] != "ANY" else None,
             _inside("src_ip", r[5]), _inside("dst_ip", r[6]), f"src_port = {r[7]}" if r[7] else None,
             f"dst_port = {r[8]}" if r[8] else None, f"zone_src = '{r[10]}'" if r[10] else None, f"zone_dst = '{r[11]}'" if r[11] else None]
    return " AND ".join(t for t in tests if t) or "true"


_BY_PRIORITY = sorted(fixed.FIREWALL_RULES, key=lambda r: r[2])
RULE = "CASE " + " ".join(f"WHEN {rule_sql(r)} THEN {r[0]}" for r in _BY_PRIORITY) + " ELSE -1 END"
NAMES = rows([(r[0], r[1], r[3]) for r in fixed.FIREWALL_RULES])
RULED = f"""SELECT q.*, coalesce(n.name, '') AS rule_name, coalesce(n.action, 'DENY') AS rule_action FROM (SELECT z.*, CAST({RULE} AS INTEGER) AS rule_id FROM ({POLICY}) z) q
 LEFT JOIN (VALUES {NAMES}) n(id, name, action) ON n.id = q.rule_id"""

has = lambda f: f"list_contains(tcp_flags, '{f}')"
KEY = """CASE WHEN (src_ip, src_port) <= (dst_ip, dst_port) THEN src_ip || ':' || src_port || '-' || dst_ip || ':' || dst_port ELSE dst_ip || ':' || dst_port || '-' || src_ip || ':' || src_port END || '-' || protocol"""
KEYED = f"SELECT p.*, {KEY} AS conn_key FROM {{src}} p"


def tracked(src):
    """The connection chain as one CTE list ending in ``states``."""
    w = "PARTITION BY conn_key"
    return f"""k AS ({KEYED.format(src=src)}), pos AS (SELECT *, row_number() OVER ({w} ORDER BY us, packet_id) AS n FROM k),
 c0 AS (SELECT *, min(CASE WHEN (protocol = 'TCP' AND {has('SYN')} AND NOT {has('ACK')}) OR protocol IN ('UDP', 'ICMP') THEN n END) OVER ({w}) AS t0 FROM pos),
 c1 AS (SELECT *, max(CASE WHEN n = t0 THEN dst_ip END) OVER ({w}) AS odst, max(CASE WHEN n = t0 THEN (CASE WHEN protocol = 'ICMP' THEN 0 ELSE dst_port END) END) OVER ({w}) AS oport FROM c0),
 c2 AS (SELECT *, coalesce(n > t0 AND src_ip = odst AND src_port = oport, false) AS is_reply FROM c1),
 c3 AS (SELECT *, min(CASE WHEN protocol = 'TCP' AND n > t0 AND {has('RST')} THEN n END) OVER ({w}) AS rst, min(CASE WHEN protocol = 'TCP' AND is_reply AND {has('SYN')} AND {has('ACK')} THEN n END) OVER ({w}) AS t1 FROM c2),
 c4 AS (SELECT *, min(CASE WHEN protocol = 'TCP' THEN (CASE WHEN n > t1 AND NOT is_reply AND {has('ACK')} THEN n END) WHEN is_reply THEN n END) OVER ({w}) AS t2 FROM c3),
 c5 AS (SELECT *, min(CASE WHEN protocol = 'TCP' AND n > t2 AND {has('FIN')} THEN n END) OVER ({w}) AS t3 FROM c4),
 c6 AS (SELECT *, min(CASE WHEN protocol = 'TCP' AND n > t3 AND {has('ACK')} THEN n END) OVER ({w}) AS t4 FROM c5),
 c7 AS (SELECT *, bool_or(n = t4 AND {has('FIN')}) OVER ({w}) AS fin4, min(CASE WHEN protocol = 'TCP' AND n > t4 AND {has('FIN')} THEN n END) OVER ({w}) AS t5 FROM c6),
 states AS (SELECT * EXCLUDE (stored), coalesce(n >= t0, false) AS tracked, CASE WHEN n >= t0 THEN stored END AS stored_state,
  CASE WHEN t0 IS NULL OR n < t0 THEN (CASE WHEN protocol = 'TCP' THEN 'INVALID' ELSE 'NEW' END) WHEN n = t0 THEN 'NEW' ELSE stored END AS conn_state FROM (
  SELECT *, CASE WHEN protocol <> 'TCP' THEN (CASE WHEN n >= t2 THEN 'ESTABLISHED' ELSE 'NEW' END) WHEN n >= rst OR n >= t5 THEN 'CLOSED' WHEN n >= t4 THEN (CASE WHEN fin4 THEN 'CLOSED' ELSE 'CLOSE_WAIT' END)
   WHEN n >= t3 THEN 'FIN_WAIT' WHEN n >= t2 THEN 'ESTABLISHED' WHEN n >= t1 THEN 'SYN_RECV' ELSE 'SYN_SENT' END AS stored FROM c7) s)"""


CONNECTIONS = """SELECT conn_key, protocol, arg_min(src_ip, n) AS src_ip, CAST(arg_min(CASE WHEN protocol = 'ICMP' THEN 0 ELSE src_port END, n) AS INTEGER) AS src_port, arg_min(dst_ip, n) AS dst_ip,
 CAST(arg_min(CASE WHEN protocol = 'ICMP' THEN 0 ELSE dst_port END, n) AS INTEGER) AS dst_port, arg_max(stored_state, n) AS state, min(us) AS created_us, max(us) AS last_seen_us,
 count(*) FILTER (WHERE is_reply) AS packets_in, count(*) FILTER (WHERE NOT is_reply) AS packets_out, CAST(coalesce(sum(size) FILTER (WHERE is_reply), 0) AS BIGINT) AS bytes_in,
 CAST(coalesce(sum(size) FILTER (WHERE NOT is_reply), 0) AS BIGINT) AS bytes_out FROM states WHERE tracked GROUP BY 1, 2"""
DECIDED = f"""WITH ruled AS ({RULED}), {tracked('ruled')}, decided AS (SELECT * REPLACE (CASE WHEN conn_state IN ('ESTABLISHED', 'INVALID') THEN NULL ELSE rule_id END AS rule_id, CASE WHEN conn_state IN ('ESTABLISHED', 'INVALID') THEN '' ELSE rule_name END AS rule_name),
 CASE conn_state WHEN 'ESTABLISHED' THEN 'ALLOW' WHEN 'INVALID' THEN 'DROP' ELSE rule_action END AS action,
 CASE WHEN conn_state = 'ESTABLISHED' THEN 'Stateful: ESTABLISHED connection' WHEN conn_state = 'INVALID' THEN 'Stateful: INVALID packet (no matching connection)'
  WHEN rule_id > 0 THEN 'Rule #' || rule_id || ': ' || rule_name WHEN zone_policy = 'DENY' AND rule_action = 'DENY' THEN 'Zone policy: ' || zone_src || ' -> ' || zone_dst || ' = DENY' ELSE 'Default policy: DENY' END AS reason FROM states)"""


def decided(view):
    return W.decide(view("packets"))


@query("d5_zone_of_ip", f"SELECT packet_id, zone_src, zone_dst FROM ({ZONED}) z")
def _(view):
    return W.with_zone(W.with_zone(view("packets"), "src_ip", "zone_src"), "dst_ip", "zone_dst").select("packet_id", "zone_src", "zone_dst")


@query("d6_zone_policy", f"SELECT packet_id, zone_src, zone_dst, zone_policy FROM ({POLICY}) z")
def _(view):
    zoned = W.with_zone(W.with_zone(view("packets"), "src_ip", "zone_src"), "dst_ip", "zone_dst")
    return W.with_zone_policy(zoned).select("packet_id", "zone_src", "zone_dst", "zone_policy")


_ZONES = rows([(z[0],) for z in fixed.ZONES])


@query("d7_zone_matrix", f"""WITH z(name) AS (VALUES {_ZONES}), cells AS (SELECT a.name AS zone_src, b.name AS zone_dst, CASE WHEN a.name = b.name THEN 'SELF' ELSE coalesce(p.a, 'DENY') END AS cell
  FROM z a CROSS JOIN z b LEFT JOIN (VALUES {POLICIES}) p(s, d, a) ON p.s = a.name AND p.d = b.name)
 SELECT c.zone_src, {', '.join(f"max(cell) FILTER (WHERE zone_dst = '{z[0]}') AS {z[0]}" for z in fixed.ZONES)}, coalesce(max(t.n), 0) AS packets
 FROM cells c LEFT JOIN (SELECT zone_src, count(*) AS n FROM ({ZONED}) q GROUP BY 1) t ON t.zone_src = c.zone_src GROUP BY 1""")
def _(view):
    return W.zone_matrix(W.with_zone(view("packets"), "src_ip", "zone_src"))


@query("d8_first_match_rule", f"SELECT packet_id, rule_id, rule_name, rule_action FROM ({RULED}) r")
def _(view):
    zoned = W.with_zone(W.with_zone(view("packets"), "src_ip", "zone_src"), "dst_ip", "zone_dst")
    return R.apply_rules(zoned).select("packet_id", "rule_id", "rule_name", "rule_action")


# a rule per customer, over the addresses and ports that the packets have; both engines read the expressions alike
_MANY = {
    "rule_id": "CAST(row_id AS INTEGER)", "name": "'rule ' || row_id", "priority": "CAST((row_id * 37) % 1009 AS INTEGER)",
    "action": "CASE row_id % 3 WHEN 0 THEN 'ALLOW' WHEN 1 THEN 'DENY' ELSE 'DROP' END",
    "protocol": "CASE row_id % 4 WHEN 0 THEN 'ANY' WHEN 1 THEN 'UDP' ELSE 'TCP' END",
    "src_ip": """CASE WHEN row_id % 11 = 0 THEN 'any' WHEN row_id % 5 = 0 THEN '203.0.113.' || (row_id % 250) || '/' || (21 + row_id % 12)
 WHEN row_id % 5 = 1 THEN '172.16.0.' || (row_id % 250 + 1) WHEN row_id % 5 = 2 THEN '192.168.1.' || (row_id % 250) || '/' || (24 + row_id % 9)
 WHEN row_id % 5 = 3 THEN '10.10.' || (row_id % 16) || '.0/' || (17 + row_id % 8) ELSE '10.0.0.' || (row_id % 250 + 1) END""",
    "dst_ip": """CASE WHEN row_id % 2 = 0 THEN 'any' WHEN row_id % 7 = 1 THEN '8.8.8.0/24' WHEN row_id % 7 = 2 THEN '198.51.100.' || (row_id % 200 + 1)
 WHEN row_id % 7 = 3 THEN '10.10.2.0/' || (20 + row_id % 10) WHEN row_id % 7 = 4 THEN 'nowhere' ELSE '192.168.0.0/16' END""",
    "src_port": "CAST(0 AS INTEGER)",
    "dst_port": "CAST(CASE row_id % 6 WHEN 0 THEN 0 WHEN 1 THEN 80 WHEN 2 THEN 443 WHEN 3 THEN 22 WHEN 4 THEN 53 ELSE 8080 END AS INTEGER)",
    "direction": "CASE row_id % 3 WHEN 0 THEN 'ANY' WHEN 1 THEN 'INBOUND' ELSE 'OUTBOUND' END",
    "zone_src": "''", "zone_dst": "''", "enabled": "row_id % 13 <> 0", "seq": "CAST(row_id AS INTEGER)", "syn": "row_id % 10 = 9"}
MANY_RULES = "SELECT " + ", ".join(f"{e} AS {n}" for n, e in _MANY.items()) + " FROM @networks"
_NUMBER = lambda ip: NUM.format(f"split_part({ip}, '/', 1)")
_RANGE = lambda ip: (f"CASE WHEN contains({ip}, '.') THEN CAST(power(2, 32 - CAST(CASE WHEN contains({ip}, '/') THEN split_part({ip}, '/', 2) ELSE '32' END AS INTEGER)) AS BIGINT) END AS {ip}_size, "
                     f"CASE WHEN contains({ip}, '.') THEN {_NUMBER(ip)} END AS {ip}_n")
_WITHIN = lambda ip: f"(r.{ip} = 'any' OR p.{ip} = r.{ip} OR coalesce({NUM.format('p.' + ip)} // r.{ip}_size = r.{ip}_n // r.{ip}_size, false))"


@query("d8_many_rules", f"""WITH r0 AS ({MANY_RULES}), r AS (SELECT *, {_RANGE('src_ip')}, {_RANGE('dst_ip')} FROM r0 WHERE enabled),
 m AS (SELECT p.packet_id, arg_min(r.rule_id, r.priority * 1000000000::BIGINT + r.seq) AS rule_id FROM @packets p JOIN r ON (r.direction = 'ANY' OR r.direction = p.direction) AND (r.protocol = 'ANY' OR r.protocol = p.protocol)
  AND (r.dst_port = 0 OR r.dst_port = p.dst_port) AND {_WITHIN('src_ip')} AND {_WITHIN('dst_ip')} AND (NOT r.syn OR list_contains(p.tcp_flags, 'SYN')) GROUP BY 1)
 SELECT p.packet_id, coalesce(m.rule_id, -1) AS rule_id, coalesce(r0.name, '') AS rule_name, coalesce(r0.action, 'DENY') AS rule_action FROM @packets p LEFT JOIN m USING (packet_id) LEFT JOIN r0 ON r0.rule_id = m.rule_id""")
def _(view):
    rules = view("networks").selectExpr(*[f"{e} AS {n}" for n, e in _MANY.items()]).withColumn(
        "tcp_flags", F.when(F.col("syn"), F.array(F.lit("SYN"))).otherwise(F.array().cast("array<string>")))
    packets = view("packets").select("packet_id", "direction", "protocol", "src_ip", "dst_ip", "src_port", "dst_port", "tcp_flags")
    return R.apply_rules(packets, rules).select("packet_id", "rule_id", "rule_name", "rule_action")


@query("c4_rule_predicate", f"SELECT packet_id, ({rule_sql(fixed.FIREWALL_RULES[1])} AND {has('SYN')}) AS allow_https_syn FROM @packets")
def _(view):
    rule = {**tables.firewall_rules(view("packets").sparkSession).where("rule_id = 3").collect()[0].asDict(), "tcp_flags": ["SYN"]}
    packets = view("packets").withColumns({"zone_src": F.lit(""), "zone_dst": F.lit("")})
    return packets.select("packet_id", R.rule_condition(rule).alias("allow_https_syn"))


@query("x15_connection_key", f"SELECT packet_id, {KEY} AS conn_key FROM @packets")
def _(view):
    return view("packets").select("packet_id", K.connection_key().alias("conn_key"))


@query("x16_forward_key", "SELECT packet_id, src_ip || ':' || src_port || '->' || dst_ip || ':' || dst_port || '-' || protocol AS forward_key FROM @packets")
def _(view):
    return view("packets").select("packet_id", K.forward_key().alias("forward_key"))


@query("g1_connection_states", f"WITH {tracked('@packets')} SELECT packet_id, conn_key, conn_state, is_reply, tracked FROM states")
def _(view):
    return K.track(view("packets")).select("packet_id", "conn_key", "conn_state", "is_reply", "tracked")


@query("g1_connection_table", f"WITH {tracked('@packets')} {CONNECTIONS}")
def _(view):
    return K.connection_table(K.track(view("packets")))


AS_OF = "(SELECT max(us) FROM @packets)"
_IDLE = """CASE WHEN protocol = 'TCP' THEN (CASE WHEN state = 'CLOSED' THEN -1 WHEN state IN ('SYN_SENT', 'SYN_RECV') THEN 30 WHEN state IN ('FIN_WAIT', 'CLOSE_WAIT') THEN 60 ELSE 3600 END) ELSE 180 END"""


def aged(view):
    packets = view("packets")
    now = packets.agg(F.max("us").alias("now")).scalar()
    table = K.connection_table(K.track(packets)).withColumn("_now", now)
    return K.with_age(table, F.col("_now")).drop("_now")


_AGED = f"WITH {tracked('@packets')}, t AS ({CONNECTIONS}) SELECT *, ({AS_OF} - created_us) / 1e6::DOUBLE AS age, ({AS_OF} - last_seen_us) / 1e6::DOUBLE AS silent FROM t"


@query("g2_expired_connections", f"SELECT conn_key, state, protocol FROM ({_AGED}) a WHERE silent > {_IDLE}")
def _(view):
    return aged(view).where("expired").select("conn_key", "state", "protocol")


# packets seven hundred times as far apart, so that silences of all lengths occur
SLOW = "SELECT * REPLACE (1704067200000000 + (us - 1704067200000000) * 700 AS us) FROM @packets"
_FLAGS = ", ".join(f"{has(f)} AS {f.lower()}" for f in X.FLAGS)
#: Packet by packet: what a connection is after the one before decides what the next one does.
REPLAY = f"""RECURSIVE slow AS ({SLOW}), p AS (SELECT *, row_number() OVER (PARTITION BY conn_key ORDER BY us, packet_id) AS n FROM (
   SELECT packet_id, us, {KEY} AS conn_key, protocol, src_ip, src_port, dst_ip, dst_port, size, {_FLAGS} FROM slow) k),
 walk AS (
  SELECT conn_key, 0::BIGINT AS n, NULL::BIGINT AS packet_id, 0::BIGINT AS us, NULL::VARCHAR AS protocol, NULL::VARCHAR AS stored_state, NULL::VARCHAR AS peer, NULL::INTEGER AS peer_port,
   NULL::VARCHAR AS conn_state, false AS is_reply, NULL::BIGINT AS opened_us, NULL::BIGINT AS opened_id, 0::INTEGER AS size FROM p WHERE n = 1
  UNION ALL
  SELECT conn_key, n, packet_id, us, protocol, CASE WHEN alive THEN after WHEN opens THEN (CASE WHEN protocol = 'TCP' THEN 'SYN_SENT' ELSE 'NEW' END) END,
   CASE WHEN alive THEN peer WHEN opens THEN dst_ip END, CASE WHEN alive THEN peer_port WHEN opens AND protocol = 'ICMP' THEN 0 WHEN opens THEN dst_port END::INTEGER,
   CASE WHEN alive THEN after WHEN opens OR protocol <> 'TCP' THEN 'NEW' ELSE 'INVALID' END, alive AND reply,
   CASE WHEN alive THEN opened_us WHEN opens THEN us END, CASE WHEN alive THEN opened_id WHEN opens THEN packet_id END, size
  FROM (SELECT *, CASE WHEN protocol <> 'TCP' THEN (CASE WHEN reply THEN 'ESTABLISHED' ELSE state END) WHEN rst THEN 'CLOSED' WHEN state = 'SYN_SENT' AND reply AND syn AND ack THEN 'SYN_RECV'
    WHEN state = 'SYN_RECV' AND NOT reply AND ack THEN 'ESTABLISHED' WHEN state = 'ESTABLISHED' AND fin THEN 'FIN_WAIT' WHEN state = 'FIN_WAIT' AND ack AND fin THEN 'CLOSED'
    WHEN state = 'FIN_WAIT' AND ack THEN 'CLOSE_WAIT' WHEN state = 'CLOSE_WAIT' AND fin THEN 'CLOSED' ELSE state END AS after
   FROM (SELECT p.*, w.stored_state AS state, w.peer, w.peer_port, w.opened_us, w.opened_id, coalesce(p.src_ip = w.peer AND p.src_port = w.peer_port, false) AS reply,
     CASE p.protocol WHEN 'TCP' THEN syn AND NOT ack WHEN 'UDP' THEN true WHEN 'ICMP' THEN true ELSE false END AS opens,
     w.stored_state IS NOT NULL AND p.us - w.us <= 1000000::BIGINT * (CASE WHEN p.protocol <> 'TCP' THEN 180 WHEN w.stored_state = 'CLOSED' THEN 0 WHEN w.stored_state IN ('SYN_SENT', 'SYN_RECV') THEN 30
       WHEN w.stored_state IN ('FIN_WAIT', 'CLOSE_WAIT') THEN 60 ELSE 3600 END) AS alive
    FROM walk w JOIN p ON p.conn_key = w.conn_key AND p.n = w.n + 1) s) t)"""


def expiring(view):
    base = 1704067200000000
    packets = view("packets").select("packet_id", "us", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "tcp_flags", "size")
    return K.track(packets.withColumn("us", base + (F.col("us") - base) * 700), expire=True)


@query("g2_states_with_expiry", f"WITH {REPLAY} SELECT packet_id, conn_key, conn_state, stored_state, is_reply, opened_us, opened_id FROM walk WHERE n > 0")
def _(view):
    return expiring(view).select("packet_id", "conn_key", "conn_state", "stored_state", "is_reply", "opened_us", "opened_id")


@query("g2_connections_with_expiry", f"""WITH {REPLAY} SELECT conn_key, protocol, opened_us, opened_id, arg_max(stored_state, n) AS state, max(us) AS last_seen_us, count(*) FILTER (WHERE is_reply) AS packets_in,
 count(*) FILTER (WHERE NOT is_reply) AS packets_out, CAST(sum(CASE WHEN is_reply THEN size ELSE 0 END) AS BIGINT) AS bytes_in, CAST(sum(CASE WHEN is_reply THEN 0 ELSE size END) AS BIGINT) AS bytes_out
 FROM walk WHERE stored_state IS NOT NULL GROUP BY 1, 2, 3, 4""")
def _(view):
    return X.connections(expiring(view))


@query("g3_connection_ages", f"SELECT conn_key, state, round(age, 1) AS age_seconds, round(silent, 1) AS last_seen_ago, packets_in, packets_out FROM ({_AGED}) a")
def _(view):
    return aged(view).select("conn_key", "state", "age_seconds", "last_seen_ago", "packets_in", "packets_out")


@query("e8_state_distribution", f"WITH {tracked('@packets')}, t AS ({CONNECTIONS}) SELECT state, count(*) AS connections FROM t GROUP BY 1")
def _(view):
    return K.state_distribution(K.connection_table(K.track(view("packets"))))


@query("c12_established_packets", f"WITH {tracked('@packets')}, t AS ({CONNECTIONS}) SELECT packet_id, conn_key FROM states WHERE conn_key IN (SELECT conn_key FROM t WHERE state = 'ESTABLISHED')")
def _(view):
    packets = view("packets")
    return K.established_packets(packets, K.connection_table(K.track(packets))).select("packet_id", "conn_key")


@query("j2_firewall_decisions", DECIDED + " SELECT packet_id, action, reason, rule_id, conn_state, zone_src, zone_dst, zone_policy FROM decided")
def _(view):
    return decided(view).select("packet_id", "action", "reason", "rule_id", "conn_state", "zone_src", "zone_dst", "zone_policy")


@query("x17_decision_reason", DECIDED + " SELECT action, reason, count(*) AS packets FROM decided GROUP BY 1, 2")
def _(view):
    return decided(view).groupBy("action", "reason").agg(F.count(F.lit(1)).alias("packets"))


@query("e4_firewall_totals", DECIDED + """, t AS (SELECT count(*) AS n, count(*) FILTER (WHERE action IN ('ALLOW', 'LOG')) AS a, count(*) FILTER (WHERE action = 'DENY') AS d,
  count(*) FILTER (WHERE action = 'DROP') AS x, count(*) FILTER (WHERE action = 'LOG') AS l, count(*) FILTER (WHERE conn_state = 'INVALID') AS i, (max(us) - min(us)) / 1e6::DOUBLE AS up FROM decided)
 SELECT n AS total_packets, a AS allowed, d AS denied, x AS dropped, l AS logged, i AS invalid_state, round(n / greatest(up, 1.0), 4) AS packets_per_second, round(a / greatest(n, 1)::DOUBLE * 100, 1) AS allow_rate,
  round(d / greatest(n, 1)::DOUBLE * 100, 1) AS deny_rate, round(x / greatest(n, 1)::DOUBLE * 100, 1) AS drop_rate FROM t""")
def _(view):
    return W.totals(decided(view))


_NEWEST = DECIDED + ", recent AS (SELECT * FROM decided)"


@query("e5_log_summary", _NEWEST + """ SELECT 'action' AS grouping, action AS value, count(*) AS packets FROM recent GROUP BY 2 UNION ALL SELECT 'protocol', protocol, count(*) FROM recent GROUP BY 2
 UNION ALL SELECT 'zone_pair', zone_src || ' -> ' || zone_dst, count(*) FROM recent GROUP BY 2""")
def _(view):
    return W.log_summary(decided(view))


@query("e6_rule_hits", DECIDED + " SELECT rule_id, rule_name, rule_action, count(*) AS hits FROM decided WHERE rule_id > 0 GROUP BY 1, 2, 3")
def _(view):
    return R.rule_hits(decided(view))


@query("e7_rule_use", DECIDED + f""", r AS (SELECT id, id IN (SELECT rule_id FROM decided WHERE rule_id > 0) AS used FROM (VALUES {NAMES}) n(id, name, action))
 SELECT count(*) AS total_rules, count(*) AS enabled_rules, CAST(0 AS BIGINT) AS disabled_rules, count(*) FILTER (WHERE used) AS rules_hit FROM r""")
def _(view):
    packets = decided(view)
    stats = R.rule_set_stats(tables.firewall_rules(packets.sparkSession))
    return stats.withColumn("rules_hit", R.rule_hits(packets).agg(F.count(F.lit(1)).alias("n")).scalar())


@query("s1_top_talkers", _NEWEST + """ SELECT * FROM (SELECT 'src_ip' AS kind, src_ip AS value, count(*) AS packets FROM recent GROUP BY 2 ORDER BY packets DESC, value LIMIT 10)
 UNION ALL SELECT * FROM (SELECT 'dst_port' AS kind, dst_port || '/' || protocol AS value, count(*) AS packets FROM recent GROUP BY 2 ORDER BY packets DESC, value LIMIT 10)""")
def _(view):
    return W.top_talkers(decided(view))


@query("s1_recent_denies", _NEWEST + """ SELECT packet_id, us, src_ip || ':' || src_port AS src, dst_ip || ':' || dst_port AS dst, protocol, reason FROM recent WHERE action IN ('DENY', 'DROP') ORDER BY us DESC, packet_id DESC LIMIT 20""")
def _(view):
    return W.recent_denies(decided(view))


@query("s2_top_rules", DECIDED + " SELECT rule_id, rule_name, rule_action, count(*) AS hits FROM decided WHERE rule_id > 0 GROUP BY 1, 2, 3 ORDER BY hits DESC, rule_id LIMIT 10")
def _(view):
    return R.top_rules(decided(view))


@query("s7_recent_decisions", DECIDED + " SELECT packet_id, us, action FROM decided ORDER BY us DESC, packet_id DESC LIMIT 50")
def _(view):
    return W.newest(decided(view), 50).select("packet_id", "us", "action")


@query("a10_decision_log", DECIDED + """ SELECT packet_id, strftime(make_timestamp(us), '%Y-%m-%dT%H:%M:%S') || ' ' || lpad(action, CAST(greatest(5, length(action)) AS INTEGER), ' ') || ' ' || lpad(protocol, CAST(greatest(4, length(protocol)) AS INTEGER), ' ') || ' ' ||
  lpad(src_ip, 15, ' ') || ':' || rpad(CAST(src_port AS VARCHAR), 5, ' ') || ' -> ' || lpad(dst_ip, 15, ' ') || ':' || rpad(CAST(dst_port AS VARCHAR), 5, ' ') || ' zone=' || zone_src || '->' || zone_dst ||
  ' state=' || conn_state || ' rule=' || coalesce(CAST(rule_id AS VARCHAR), 'None') || ' | ' || reason AS line FROM decided""")
def _(view):
    stamped = decided(view).withColumn("timestamp", F.date_format(F.timestamp_micros("us"), "yyyy-MM-dd'T'HH:mm:ss"))
    return W.log_lines(stamped)


# ------------------------------------------------------------------ payload signatures

def signature_sql(column):
    cases = []
    for s in fixed.SIGNATURES:
        ports = f" AND dst_port IN ({', '.join(map(str, s[4]))})" if s[4] else ""
        value = s[column] if isinstance(s[column], int) else quote(s[column])
        cases.append(f"WHEN protocol = '{s[3]}'{ports} AND regexp_matches(payload, {quote(s[2])}, 'i') THEN {value}")
    return "CASE " + " ".join(cases) + " END"


def signed(src):
    return f"""SELECT p.*, CAST({signature_sql(0)} AS INTEGER) AS sid, {signature_sql(1)} AS signature_name, {signature_sql(5)} AS severity, {signature_sql(6)} AS signature_action,
 {signature_sql(7)} AS category, {signature_sql(8)} AS mitre FROM {src} p"""


@query("d9_signatures", f"SELECT packet_id, sid, signature_name, severity, category, mitre, CASE WHEN sid IS NOT NULL THEN 'Matched: ' || substr(payload, 1, 80) END AS details FROM ({signed('@ids_packets')}) s")
def _(view):
    return R.match_signatures(view("ids_packets")).select(
        "packet_id", "signature.sid", F.col("signature.name").alias("signature_name"), "signature.severity", "signature.category",
        "signature.mitre", "signature.details")


# a signature per service: most stand for nothing that occurs, some for what the payloads hold
_SIGNS = {
    "sid": "CAST(service_id AS INTEGER)", "name": "'sign ' || service_id", "seq": "CAST((service_id * 37) % 1009 * 100000 + service_id AS BIGINT)",
    "protocol": "CASE service_id % 3 WHEN 0 THEN 'ANY' WHEN 1 THEN 'TCP' ELSE 'UDP' END",
    "pattern": """CASE service_id % 40 WHEN 0 THEN '[0-9]=[0-9]' WHEN 7 THEN 'union[ ]+all' WHEN 11 THEN 'etc/(passwd|shadow)' WHEN 13 THEN 'on[a-z]+ ?= ?x' WHEN 17 THEN 'SSH-2.0|telnet-' WHEN 19 THEN '^beacon to .*-c2'
 WHEN 23 THEN 'http/1[.][01]$' WHEN 29 THEN 'reply (10|11)[.]' WHEN 31 THEN 'tunnel[.]tk' ELSE 'zq' || service_id || 'q+[0-9]' END""",
    "severity": "'high'", "action": "'alert'", "category": "'made'", "mitre": "''"}
_SIGNED = "SELECT " + ", ".join(f"{e} AS {n}" for n, e in _SIGNS.items()) + " FROM @services"


@query("d9_many_signatures", f"""WITH s AS ({_SIGNED}), kinds AS (SELECT DISTINCT protocol, payload FROM @ids_packets),
 m AS (SELECT k.protocol, k.payload, arg_min(s.sid, s.seq) AS sid FROM kinds k JOIN s ON s.protocol IN ('ANY', k.protocol) AND regexp_matches(k.payload, s.pattern, 'i') GROUP BY 1, 2)
 SELECT packet_id, m.sid FROM @ids_packets p LEFT JOIN m ON m.protocol = p.protocol AND m.payload = p.payload""")
def _(view):
    table = view("services").selectExpr(*[f"{e} AS {n}" for n, e in _SIGNS.items()], "CAST(array() AS ARRAY<INT>) AS dst_port")
    return R.match_signatures(view("ids_packets"), table).select("packet_id", "signature.sid")


@query("d9_page_signatures", f"SELECT packet_id, sid, severity FROM ({signed('@pages')}) s")
def _(view):
    return R.match_signatures(view("pages")).select("packet_id", "signature.sid", "signature.severity")


_CONTENT = lambda col: "CASE " + " ".join(f"WHEN protocol = '{c[2]}' AND contains(payload, {quote(c[3])}) THEN {quote(c[col]) if isinstance(c[col], str) else c[col]}"
                                          for c in fixed.CONTENT_SIGNATURES) + " END"


@query("d10_content_signatures", f"SELECT packet_id, CAST({_CONTENT(0)} AS INTEGER) AS content_id, {_CONTENT(1)} AS content_action, {_CONTENT(4)} AS content_message FROM @ids_packets")
def _(view):
    return R.match_content(view("ids_packets")).select("packet_id", "content_id", "content_action", "content_message")


@query("e21_signature_categories", f"SELECT category, severity, count(*) AS matches, count(DISTINCT sid) AS signatures FROM ({signed('@ids_packets')}) s WHERE sid IS NOT NULL GROUP BY 1, 2")
def _(view):
    return R.signature_catalogue(R.match_signatures(view("ids_packets")))
