"""Look-up, address and search queries."""

from pyspark.sql import functions as F

from vigil import fixed, tables
from vigil.catalog.registry import query, quote, rows
from vigil.functions import network as X
from vigil.functions import text as T
from vigil.operators import enrich as E
from vigil.operators import search as S
from vigil.operators.netjoin import in_networks, match_networks

THREATS = rows([r[:9] + (list(r[9]), list(r[10])) for r in fixed.THREAT_IPS])
GEO = rows(fixed.GEO_IPS)
NUM = ("(CAST(split_part({0}, '.', 1) AS BIGINT) * 16777216 + CAST(split_part({0}, '.', 2) AS BIGINT) * 65536 + "
       "CAST(split_part({0}, '.', 3) AS BIGINT) * 256 + CAST(split_part({0}, '.', 4) AS BIGINT))")
VALID = r"regexp_full_match({0}, '((25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\.){{3}}(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])')"
VALID_CIDR = r"regexp_full_match({0}, '((25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\.){{3}}(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(/(3[0-2]|[12]?[0-9]))?')"
DOTTED = "concat_ws('.', ({0}) // 16777216, ({0}) // 65536 % 256, ({0}) // 256 % 256, ({0}) % 256)"


@query("d1_ip_reputation", f"""SELECT event_id, e.src_ip, t.ip IS NULL AS safe, coalesce(t.score, 0) AS threat_score, coalesce(t.kind, 'clean') AS threat_type,
 coalesce(t.country, g.country, 'UNKNOWN') AS country, coalesce(t.region, g.region, 'Unknown') AS region, coalesce(t.isp, g.isp, 'Unknown') AS isp,
 coalesce(t.actor, '') AS actor, coalesce(array_to_string(t.tags, ','), '') AS tags, coalesce(array_to_string(t.refs, ','), '') AS refs, coalesce(t.last_seen, '') AS last_seen
 FROM @events e LEFT JOIN (VALUES {THREATS}) t(ip, score, kind, country, region, isp, actor, first_seen, last_seen, tags, refs) ON t.ip = e.src_ip
 LEFT JOIN (VALUES {GEO}) g(ip, country, region, isp) ON g.ip = e.src_ip""")
def _(view):
    return E.ip_reputation(view("events").select("event_id", "src_ip")).select(
        "event_id", "src_ip", "safe", "threat_score", "threat_type", "country", "region", "isp", "actor",
        F.array_join("tags", ",").alias("tags"), F.array_join("references", ",").alias("refs"), "last_seen")


_NETS = rows([(c,) for c in fixed.THREAT_NETWORKS])
_HIT = "EXISTS (SELECT 1 FROM (VALUES {nets}) n(cidr) WHERE split_part(n.cidr, '/', 1) = {ip})"


@query("d2_threat_networks", f"""SELECT packet_id, (s OR d) AS threat_detected, CASE WHEN s THEN src_ip WHEN d THEN dst_ip END AS threat_ip,
 CASE WHEN s OR d THEN 'Known malicious IP address' END AS threat_text FROM (SELECT packet_id, src_ip, dst_ip,
 {_HIT.format(nets=_NETS, ip='src_ip')} AS s, {_HIT.format(nets=_NETS, ip='dst_ip')} AS d FROM @packets) h""")
def _(view):
    return E.threat_networks(view("packets")).select("packet_id", "threat_detected", "threat_ip", "threat_text")


_ALL_NETS = "SELECT cidr, CAST(row_id AS INTEGER) AS rank FROM @networks WHERE " + VALID_CIDR.format("cidr") + \
    " AND CAST(split_part(cidr, '/', 2) AS INT) BETWEEN 0 AND 32"


@query("d2_many_networks", f"""WITH nets AS (SELECT n - n % size AS lo, n - n % size + size - 1 AS hi, length, rank FROM (
   SELECT {NUM.format("split_part(cidr, '/', 1)")} AS n, CAST(power(2, 32 - CAST(split_part(cidr, '/', 2) AS INT)) AS BIGINT) AS size,
    CAST(split_part(cidr, '/', 2) AS INT) AS length, rank FROM ({_ALL_NETS}) a) b),
 addr AS (SELECT row_id, {NUM.format('ip')} AS n FROM @networks)
 SELECT row_id, (SELECT max(rank) FROM nets WHERE addr.n BETWEEN lo AND hi) AS rank FROM addr""")
def _(view):
    nets = view("networks").where(X.is_valid_cidr("cidr") & X.prefix_length("cidr").between(0, 32)) \
        .select("cidr", F.col("row_id").cast("int").alias("rank"))
    return match_networks(view("networks").select("row_id", "ip"), "ip", nets, ["rank"], "rank").select("row_id", "rank")


_DOMAIN_CASE = lambda col: "CASE " + " ".join(f"WHEN contains(domain, {quote(r[0])}) THEN {quote(r[col]) if isinstance(r[col], str) else r[col]}"
                                              for r in fixed.THREAT_DOMAINS)
_TLD = " OR ".join(f"ends_with(domain, '{t}')" for t in fixed.REPUTATION_TLDS)


@query("d3_domain_reputation", f"""SELECT event_id, score = 0 AS domain_safe, CAST(score AS INTEGER) AS domain_score, kind AS domain_type, actor AS domain_actor FROM (
 SELECT event_id, {_DOMAIN_CASE(1)} WHEN {_TLD} THEN 40 ELSE 0 END AS score, {_DOMAIN_CASE(2)} WHEN {_TLD} THEN 'suspicious_tld' ELSE 'clean' END AS kind,
 {_DOMAIN_CASE(3)} WHEN {_TLD} THEN 'Unknown' ELSE '' END AS actor FROM @events) x""")
def _(view):
    return E.domain_reputation(view("events")).select("event_id", "domain_safe", "domain_score", "domain_type", "domain_actor")


_BLOCK = " OR ".join(f"contains(regexp_replace(trim(lower(domain)), '^www\\.', ''), '{d}')" for d in fixed.BLOCKED_DOMAINS)


@query("d4_blocked_domain", f"SELECT event_id, domain, ({_BLOCK}) AS domain_blocked FROM @events")
def _(view):
    return E.blocked_domain(view("events")).select("event_id", "domain", "domain_blocked")


@query("d11_mitre_mapping", f"""SELECT event_id, kind AS attack_type, m.tactic AS mitre_tactic, m.technique AS mitre_technique, m.name AS mitre_name FROM (
 SELECT event_id, CASE event_type WHEN 'failed_logon' THEN 'brute_force' WHEN 'network_traffic' THEN 'port_scan' WHEN 'vpn_auth_fail' THEN 'vpn_brute_force'
  WHEN 'injection_attempt' THEN 'sql_injection' WHEN 'recon_attempt' THEN 'recon_web' WHEN 'dns_tunnel_suspect' THEN 'dns_tunnel' ELSE event_type END AS kind FROM @events) e
 LEFT JOIN (VALUES {rows(fixed.MITRE)}) m(attack, tactic, technique, name) ON m.attack = e.kind""")
def _(view):
    kind = F.expr("""CASE event_type WHEN 'failed_logon' THEN 'brute_force' WHEN 'network_traffic' THEN 'port_scan' WHEN 'vpn_auth_fail' THEN 'vpn_brute_force'
        WHEN 'injection_attempt' THEN 'sql_injection' WHEN 'recon_attempt' THEN 'recon_web' WHEN 'dns_tunnel_suspect' THEN 'dns_tunnel' ELSE event_type END""")
    return E.with_mitre(view("events").select("event_id", kind.alias("attack_type")))


@query("d16_port_service", f"""SELECT service_id, s.port, coalesce(k.service, 'Unknown') AS service_name, coalesce(k.text, 'Unknown service on port ' || s.port) AS service_text
 FROM @services s LEFT JOIN (VALUES {rows(fixed.WELL_KNOWN_PORTS)}) k(port, service, text) ON k.port = s.port""")
def _(view):
    return E.port_service(view("services").select("service_id", "port"))


@query("d17_ot_protocol", f"""SELECT packet_id, dst_port, o.p IS NOT NULL AS is_ot_port, coalesce(o.protocol, '') AS ot_protocol
 FROM @packets k LEFT JOIN (VALUES {rows(fixed.OT_PORTS)}) o(p, protocol) ON o.p = k.dst_port""")
def _(view):
    return E.ot_protocol(view("packets").select("packet_id", "dst_port"), "dst_port")


@query("d19_default_credentials", f"""SELECT service_id, s.service, c.username, c.password FROM (SELECT service_id, CASE WHEN service = 'OpenSSH' THEN 'SSH' WHEN service IN ('nginx', 'Apache') THEN 'HTTP' ELSE service END AS service FROM @services) s
 JOIN (VALUES {rows(fixed.DEFAULT_CREDENTIALS)}) c(service, username, password) ON c.service = s.service""")
def _(view):
    kind = F.expr("CASE WHEN service = 'OpenSSH' THEN 'SSH' WHEN service IN ('nginx', 'Apache') THEN 'HTTP' ELSE service END")
    return E.default_credentials(view("services").select("service_id", kind.alias("service")))


@query("c11_port_findings", f"""WITH p AS (SELECT host, port FROM @services WHERE state = 'open')
 SELECT host, p.port, 'warning' AS kind, 'WARNING' AS severity, m AS message FROM p JOIN (VALUES {rows(fixed.PORT_WARNINGS)}) w(port, m) ON w.port = p.port
 UNION ALL SELECT host, p.port, 'ot_port', 'CRITICAL', 'OT/ICS Port ' || p.port || ' (' || o || ') is accessible!' FROM p JOIN (VALUES {rows(fixed.OT_PORTS)}) w(port, o) ON w.port = p.port
 UNION ALL SELECT host, p.port, 'report', s, m FROM p JOIN (VALUES {rows(fixed.REPORT_RISKS)}) w(port, s, m) ON w.port = p.port""")
def _(view):
    return E.port_findings(view("services").where(F.col("state") == "open"))


@query("e23_lookup_stats", f"""SELECT count(*) AS total_lookups, count(DISTINCT src_ip) AS cache_size, count(*) - count(DISTINCT src_ip) AS cache_hits,
 count(DISTINCT src_ip) FILTER (WHERE src_ip IN ({', '.join(quote(r[0]) for r in fixed.THREAT_IPS)})) AS listed_ips FROM @events""")
def _(view):
    return E.lookup_stats(view("events"))


@query("e26_intel_counters", f"""SELECT CAST(count(*) + count(*) FILTER (WHERE NOT s) AS BIGINT) AS ips_checked, count(*) FILTER (WHERE s OR d) AS threats_detected,
 count(*) FILTER (WHERE {_BLOCK}) AS domain_threats FROM (SELECT domain, {_HIT.format(nets=_NETS, ip='src_ip')} AS s, {_HIT.format(nets=_NETS, ip='dst_ip')} AS d FROM @events) x""")
def _(view):
    return E.intel_counters(view("events"))


# ------------------------------------------------------------------ addresses

@query("x1_ip_numbers", f"SELECT row_id, {NUM.format('ip')} AS number, ip AS back FROM @networks")
def _(view):
    return view("networks").select("row_id", X.ip_to_num("ip").alias("number"), X.num_to_ip(X.ip_to_num("ip")).alias("back"))


_SUB = f"""SELECT row_id, prefix_length, total, n - n % total AS lo, n - n % total + total - 1 AS hi FROM (SELECT row_id,
  {NUM.format("split_part(cidr, '/', 1)")} AS n, CAST(split_part(cidr, '/', 2) AS INTEGER) AS prefix_length,
  CAST(power(2, 32 - CAST(split_part(cidr, '/', 2) AS INT)) AS BIGINT) AS total FROM @networks WHERE {VALID_CIDR.format('cidr')}) a"""
_PRIVATE = " OR ".join(f"(lo >= {lo} AND hi <= {hi})" for lo, hi in map(X.literal_range, fixed.PRIVATE_NETWORKS))


@query("x2_subnet_columns", f"""SELECT row_id, prefix_length, total AS total_hosts, {DOTTED.format('lo')} AS network_address, {DOTTED.format('hi')} AS broadcast_address,
 {DOTTED.format('(4294967296 - total)')} AS subnet_mask, {DOTTED.format('(total - 1)')} AS wildcard_mask, greatest(0, total - 2) AS usable_hosts,
 CASE WHEN total > 2 THEN {DOTTED.format('(lo + 1)')} ELSE {DOTTED.format('lo')} END AS first_host, CASE WHEN total > 2 THEN {DOTTED.format('(hi - 1)')} ELSE {DOTTED.format('hi')} END AS last_host,
 CASE WHEN lo // 16777216 < 128 THEN 'A' WHEN lo // 16777216 < 192 THEN 'B' WHEN lo // 16777216 < 224 THEN 'C' WHEN lo // 16777216 < 240 THEN 'D' ELSE 'E' END AS network_class
 FROM ({_SUB}) s""")
def _(view):
    return X.subnet_columns(view("networks").where(X.is_valid_cidr("cidr")).select("row_id", "cidr")).drop("cidr", "is_private")


@query("x3_private_networks", f"SELECT row_id, ({_PRIVATE}) AS is_private FROM ({_SUB}) s")
def _(view):
    return X.subnet_columns(view("networks").where(X.is_valid_cidr("cidr")).select("row_id", "cidr")).select("row_id", "is_private")


@query("c5_valid_ip", f"SELECT row_id, maybe_ip, {VALID.format('maybe_ip')} AS valid FROM @networks")
def _(view):
    return view("networks").select("row_id", "maybe_ip", X.is_valid_ip("maybe_ip").alias("valid"))


@query("c6_valid_cidr", f"SELECT row_id, cidr, {VALID_CIDR.format('cidr')} AS valid FROM @networks")
def _(view):
    return view("networks").select("row_id", "cidr", X.is_valid_cidr("cidr").alias("valid"))


@query("c7_ip_in_cidr", f"""SELECT row_id, CASE WHEN row_id % 10 = 0 THEN true WHEN {VALID.format('maybe_ip')} AND {VALID_CIDR.format('cidr')}
 THEN {NUM.format("CASE WHEN " + VALID.format('maybe_ip') + " THEN maybe_ip ELSE '0.0.0.0' END")} BETWEEN lo AND hi ELSE maybe_ip = cidr END AS inside FROM (SELECT k.row_id, k.maybe_ip, k.cidr, s.lo, s.hi FROM @networks k LEFT JOIN ({_SUB}) s ON s.row_id = k.row_id) j""")
def _(view):
    cidr = F.when(F.col("row_id") % 10 == 0, "any").otherwise(F.col("cidr"))
    return view("networks").select("row_id", X.ip_in_cidr("maybe_ip", cidr).alias("inside"))


@query("c10_internal_address", "SELECT event_id, regexp_matches(src_ip, '^(10\\.|192\\.168\\.|172\\.(1[6-9]|2[0-9]|3[01])\\.)') AS internal FROM @events")
def _(view):
    return view("events").select("event_id", X.is_internal("src_ip").alias("internal"))


_TARGET = f"""WITH pieces AS (SELECT DISTINCT row_id, target, trim(unnest(CASE WHEN contains(target, ',') AND NOT contains(target, '/') THEN string_split(target, ',') ELSE [target] END)) AS piece FROM @networks),
 spans AS (SELECT row_id, target, CASE WHEN {VALID_CIDR.format('piece')} AND contains(piece, '/') THEN (CASE WHEN size > 2 THEN lo + 1 ELSE lo END)
   WHEN {VALID.format('piece')} THEN n WHEN r <> '' THEN {NUM.format("(regexp_extract(piece, '^([0-9]+[.][0-9]+[.][0-9]+[.])([0-9]+)-([0-9]+)$', 1) || regexp_extract(piece, '^([0-9]+[.][0-9]+[.][0-9]+[.])([0-9]+)-([0-9]+)$', 2))")} END AS a,
  CASE WHEN {VALID_CIDR.format('piece')} AND contains(piece, '/') THEN (CASE WHEN size > 2 THEN lo + size - 2 ELSE lo + size - 1 END)
   WHEN {VALID.format('piece')} THEN n WHEN r <> '' THEN {NUM.format("(regexp_extract(piece, '^([0-9]+[.][0-9]+[.][0-9]+[.])([0-9]+)-([0-9]+)$', 1) || least(255, CAST(regexp_extract(piece, '^([0-9]+[.][0-9]+[.][0-9]+[.])([0-9]+)-([0-9]+)$', 3) AS INT)))")} END AS b
  FROM (SELECT *, n - n % size AS lo FROM (SELECT *, regexp_extract(piece, '^([0-9]+[.][0-9]+[.][0-9]+[.])([0-9]+)-([0-9]+)$', 1) AS r,
   CASE WHEN {VALID_CIDR.format('piece')} THEN {NUM.format("split_part(CASE WHEN " + VALID_CIDR.format('piece') + " THEN piece ELSE '0.0.0.0' END, '/', 1)")} END AS n,
   CAST(power(2, 32 - coalesce(TRY_CAST(nullif(split_part(piece, '/', 2), '') AS INT), 32)) AS BIGINT) AS size FROM pieces) q1) q2)
 SELECT row_id, target, {DOTTED.format('num')} AS ip FROM (SELECT DISTINCT row_id, target, unnest(generate_series(a, b)) AS num FROM spans WHERE a IS NOT NULL) g"""


@query("t1_expand_targets", _TARGET)
def _(view):
    return X.expand_targets(view("networks").select("row_id", "target"))


@query("u2_distinct_targets", "SELECT DISTINCT trim(unnest(string_split(target, ','))) AS target FROM @networks")
def _(view):
    return S.distinct_targets(view("networks"))


@query("s4_hosts_in_order", f"SELECT row_id, ip, row_number() OVER (ORDER BY {NUM.format('ip')}, row_id) AS position FROM @networks")
def _(view):
    return S.hosts_in_order(view("networks").select("row_id", "ip"))


# ------------------------------------------------------------------ search and newest rows

@query("c1_alerts_by_severity", """SELECT event_id, us, level AS severity FROM (SELECT event_id, us, CASE WHEN severity >= 8 THEN 'Critical' WHEN severity >= 7 THEN 'High' ELSE 'Medium' END AS level FROM @events) a
 WHERE lower(level) = 'critical' ORDER BY us DESC, event_id DESC LIMIT 20""")
def _(view):
    level = F.when(F.col("severity") >= 8, "Critical").when(F.col("severity") >= 7, "High").otherwise("Medium")
    return S.alerts_by_severity(view("events").select("event_id", "us", level.alias("severity")), "CRITICAL")


@query("c2_logs_by_source", "SELECT event_id, us, source_type, event_type FROM @events WHERE source_type = 'dns' ORDER BY us DESC, event_id DESC LIMIT 100")
def _(view):
    return S.logs_by_source(view("events"), "dns").select("event_id", "us", "source_type", "event_type")


_ROW = "lower(concat_ws(' ', event_id, us, timestamp, source_type, event_type, severity, src_ip, dst_ip, src_port, dst_port, protocol, action, username, uri, domain, status_code, bytes))"


@query("c3_search_logs", f"""WITH hits AS (SELECT * FROM @events WHERE source_type = 'web_server' AND severity >= 5 AND contains({_ROW}, 'wp-admin'))
 SELECT event_id, uri, (SELECT count(*) FROM hits) AS total FROM hits ORDER BY us DESC, event_id DESC LIMIT 50""")
def _(view):
    return S.search_logs(view("events"), "WP-Admin", "web_server", 5).select("event_id", "uri", "total")


@query("a8_recent_events", "SELECT event_id, us, event_type, src_ip FROM @events ORDER BY us DESC, event_id DESC LIMIT 100")
def _(view):
    return S.newest(view("events"), 100).select("event_id", "us", "event_type", "src_ip")


@query("s7_newest_commands", "SELECT command_id, us, address, value FROM @commands ORDER BY us DESC, command_id DESC LIMIT 15")
def _(view):
    return S.newest(view("commands"), 15, row_id="command_id").select("command_id", "us", "address", "value")


@query("s5_ports_in_order", "SELECT asset_id, port, count(*) AS services, min(service_id) AS first_service FROM @services GROUP BY 1, 2 ORDER BY 1, 2")
def _(view):
    return S.ports_in_order(view("services"))


@query("c9_assets_by_status", "SELECT asset_id, hostname, ssl_version FROM @assets WHERE ssl_version = 'TLS 1.0'")
def _(view):
    return S.equal_to(view("assets"), "ssl_version", "TLS 1.0").select("asset_id", "hostname", "ssl_version")
