"""Log normalisation queries."""

from pyspark.sql import functions as F

from vigil import fixed
from vigil.catalog.registry import query, quote, rows
from vigil.functions.text import display_time, event_time
from vigil.operators import normalize as N


def _re(pattern, group):
    if group == 10:  # the oracle numbers groups up to 9: make the ninth a plain part
        pattern, group = pattern.replace('"([^"]*)"\\s+"', '"[^"]*"\\s+"'), 9
    return f"regexp_extract(raw, {quote(pattern)}, {group})"


def _event_columns(source, *extra):
    def run(view):
        events = N.normalize_logs(view("raw_logs"), [source])
        meta = [F.coalesce(F.try_element_at("metadata", F.lit(k)), F.lit("")).alias(k) for k in extra]
        return events.select("line_id", "timestamp", "event_type", "severity", "src_ip", "dst_ip", "src_port",
                             "dst_port", "protocol", "action", "username", "hostname", "description", *meta)
    return run


def _oracle(source, test, **values):
    defaults = {"timestamp": "''", "event_type": "''", "severity": "4", "src_ip": "''", "dst_ip": "''",
                "src_port": "0", "dst_port": "0", "protocol": "''", "action": "''", "username": "''",
                "hostname": "''", "description": "''"}
    columns = ", ".join(f"CAST({values.get(n, d)} AS {'INTEGER' if n in ('severity', 'src_port', 'dst_port') else 'VARCHAR'}) AS {n}"
                        for n, d in defaults.items())
    extra = "".join(f", CAST({v} AS VARCHAR) AS {n}" for n, v in values.items() if n not in defaults)
    return f"SELECT line_id, {columns}{extra} FROM @raw_logs WHERE log_type = '{source}' AND {test}"


def _matches(pattern):
    return f"regexp_matches(raw, {quote(pattern)})"


_FW = [_re(fixed.FIREWALL_LINE, n) for n in range(8)]
query("b1_firewall_log", _oracle(
    "firewall", _matches(fixed.FIREWALL_LINE), timestamp=_FW[1], event_type="'network_traffic'",
    severity=f"CASE WHEN {_FW[2]} IN ('DENY','DROP','REJECT') THEN 7 ELSE 4 END", src_ip=_FW[3], dst_ip=_FW[4],
    src_port=f"coalesce(nullif({_FW[5]}, ''), '0')", dst_port=_FW[6],
    protocol=f"coalesce(nullif({_FW[7]}, ''), 'TCP')", action=_FW[2],
    description=f"'Firewall ' || {_FW[2]} || ': ' || {_FW[3]} || ' -> ' || {_FW[4]} || ':' || {_FW[6]}"))(
    _event_columns("firewall"))

_AD = f"""SELECT line_id, coalesce(raw ->> 'TimeCreated', '') AS timestamp, coalesce(m.event_type, 'ad_generic') AS event_type,
 CAST(coalesce(m.severity, 4) AS INTEGER) AS severity, coalesce(raw ->> 'IpAddress', '') AS src_ip, '' AS dst_ip, 0 AS src_port, 0 AS dst_port,
 '' AS protocol, coalesce(m.action, 'INFO') AS action, coalesce(raw ->> 'TargetUserName', '') AS username, '' AS hostname,
 coalesce(m.text, 'AD event') || ' - User: ' || coalesce(raw ->> 'TargetUserName', 'N/A') AS description,
 raw ->> 'EventID' AS windows_event_id, raw ->> 'LogonType' AS logon_type
 FROM (SELECT * FROM @raw_logs WHERE log_type = 'active_directory' AND starts_with(raw, '{{')) r
 LEFT JOIN (VALUES {rows(fixed.WINDOWS_EVENTS)}) m(id, event_type, action, severity, text) ON m.id = CAST(r.raw ->> 'EventID' AS INTEGER)"""
query("b2_directory_log", _AD)(_event_columns("active_directory", "windows_event_id", "logon_type"))

_W = [_re(fixed.WEB_LINE, n) for n in range(11)]
_inj = " OR ".join(f"contains(lower({_W[5]}), {quote(m.lower())})" for m in fixed.INJECTION_MARKS)
_rec = f"({_W[7]} = '404' AND (" + " OR ".join(f"contains({_W[5]}, '{p}')" for p in fixed.RECON_PATHS) + "))"
query("b3_web_log", _oracle(
    "web_server", _matches(fixed.WEB_LINE), timestamp=_W[3],
    event_type=f"CASE WHEN {_inj} THEN 'injection_attempt' WHEN CAST({_W[7]} AS INT) >= 500 THEN 'server_error' WHEN {_W[7]} IN ('401','403') THEN 'access_denied' WHEN {_rec} THEN 'recon_attempt' ELSE 'web_request' END",
    severity=f"CASE WHEN {_inj} THEN 8 WHEN CAST({_W[7]} AS INT) >= 500 THEN 7 WHEN {_W[7]} IN ('401','403') OR {_rec} THEN 6 ELSE 4 END",
    src_ip=_W[1], action=_W[4], username=f"CASE WHEN {_W[2]} = '-' THEN '' ELSE {_W[2]} END",
    description=f"{_W[4]} || ' ' || {_W[5]} || ' -> ' || {_W[7]}", method=_W[4], uri=_W[5], status_code=_W[7],
    bytes=_W[8], user_agent=_W[10]))(_event_columns("web_server", "method", "uri", "status_code", "bytes", "user_agent"))

_D = [_re(fixed.DNS_LINE, n) for n in range(6)]
_tld = " OR ".join(f"ends_with({_D[3]}, '{x}')" for x in fixed.DNS_SUSPICIOUS_TLDS)
query("b4_dns_log", _oracle(
    "dns", _matches(fixed.DNS_LINE), timestamp=_D[1],
    event_type=f"CASE WHEN length({_D[3]}) > 60 THEN 'dns_tunnel_suspect' WHEN {_tld} THEN 'suspicious_dns' ELSE 'dns_query' END",
    severity=f"CASE WHEN length({_D[3]}) > 60 THEN 7 WHEN {_tld} THEN 6 ELSE 4 END", src_ip=_D[2], action="'QUERY'",
    description=f"'DNS ' || {_D[4]} || ' query: ' || {_D[3]}", domain=_D[3], query_type=_D[4]))(
    _event_columns("dns", "domain", "query_type"))

_V = [_re(fixed.VPN_LINE, n) for n in range(6)]
query("b5_vpn_log", _oracle(
    "vpn", _matches(fixed.VPN_LINE), timestamp=_V[1], event_type=f"'vpn_' || lower({_V[2]})",
    severity=f"CASE WHEN {_V[2]} = 'AUTH_FAIL' THEN 7 ELSE 4 END", src_ip=_V[4], action=_V[2], username=_V[3],
    description=f"'VPN ' || {_V[2]} || ' - User: ' || {_V[3]} || ' from ' || {_V[4]}",
    tunnel=f"coalesce(nullif({_V[5]}, ''), 'default')"))(_event_columns("vpn", "tunnel"))

_S = [_re(fixed.SYSLOG_LINE, n) for n in range(9)]
_is = _matches(fixed.SYSLOG_LINE)
_if = lambda a, b: f"CASE WHEN {_is} THEN {a} ELSE {b} END"
query("b6_syslog", _oracle(
    "syslog", "true", timestamp=_if(_S[3], "''"), event_type=_if("'syslog_message'", "'generic_syslog'"),
    severity=_if(f"greatest(0, 10 - TRY_CAST({_S[1]} AS INT) % 8)", "4"), hostname=_if(_S[4], "''"),
    description=_if(f"trim({_S[8]})", "substr(raw, 1, 200)"),
    facility=_if(f"CAST(TRY_CAST({_S[1]} AS INT) // 8 AS VARCHAR)", "''"), appname=_if(_S[5], "''"),
    procid=_if(_S[6], "''")))(_event_columns("syslog", "facility", "appname", "procid"))


@query("b7_simple_records", """SELECT event_id, us, source AS source_type,
 CASE WHEN source = 'syslog' THEN host WHEN source IN ('auth_event', 'firewall') THEN src_ip END AS src_ip,
 CASE WHEN source = 'firewall' THEN dst_ip END AS dst_ip, CASE WHEN source IN ('auth_event', 'firewall') THEN action END AS action,
 CASE WHEN source = 'syslog' THEN coalesce(severity, 'INFO') WHEN source = 'auth_event' AND action = 'LOGIN_FAILED' THEN 'WARNING'
  WHEN source = 'firewall' AND action = 'DENY' THEN 'WARNING' ELSE 'INFO' END AS severity,
 CASE WHEN source = 'auth_event' THEN "user" END AS "user", coalesce(msg, description, '') AS msg FROM @simple_records""")
def _(view):
    return N.normalize_simple(view("simple_records"))


_STATUS = f"""CASE WHEN log_type = 'firewall' THEN CASE WHEN {_matches(fixed.FIREWALL_LINE)} THEN log_type ELSE 'parse_errors' END
 WHEN log_type = 'active_directory' THEN CASE WHEN starts_with(raw, '{{') THEN log_type ELSE 'parse_errors' END
 WHEN log_type = 'web_server' THEN CASE WHEN {_matches(fixed.WEB_LINE)} THEN log_type ELSE 'parse_errors' END
 WHEN log_type = 'dns' THEN CASE WHEN {_matches(fixed.DNS_LINE)} THEN log_type ELSE 'parse_errors' END
 WHEN log_type = 'vpn' THEN CASE WHEN {_matches(fixed.VPN_LINE)} THEN log_type ELSE 'parse_errors' END
 WHEN log_type = 'syslog' THEN log_type ELSE 'unknown' END"""


@query("b8_ingestion_stats", f"SELECT {_STATUS} AS parse_status, count(*) AS lines FROM @raw_logs GROUP BY 1")
def _(view):
    return N.ingestion_stats(view("raw_logs"))


@query("b9_event_time", """SELECT line_id, epoch_us(coalesce(
   try_strptime(regexp_extract(raw, '(\\d{4}-\\d{2}-\\d{2} \\d{2}:\\d{2}:\\d{2})', 1), '%Y-%m-%d %H:%M:%S'),
   try_strptime(regexp_extract(raw, '(\\d{4}-\\d{2}-\\d{2}T\\d{2}:\\d{2}:\\d{2})', 1), '%Y-%m-%dT%H:%M:%S'),
   try_strptime(regexp_extract(raw, '(\\d{2}/\\w{3}/\\d{4}:\\d{2}:\\d{2}:\\d{2})', 1), '%d/%b/%Y:%H:%M:%S'))) AS us
  FROM @raw_logs""")
def _(view):
    raw = F.col("raw")
    text = F.coalesce(*[F.nullif(F.regexp_extract(raw, p, 1), F.lit("")) for p in (
        r"(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2})", r"(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2})",
        r"(\d{2}/\w{3}/\d{4}:\d{2}:\d{2}:\d{2} \+\d{4})")])
    return view("raw_logs").select("line_id", F.unix_micros(event_time(text)).alias("us"))


@query("b10_packet_defaults", """SELECT packet_id, src_ip, dst_ip, src_port, dst_port, CASE WHEN upper(protocol) IN ('TCP', 'UDP', 'ICMP')
 THEN upper(protocol) ELSE 'OTHER' END AS protocol, direction, CAST(64 AS INTEGER) AS ttl, 'eth0' AS interface, size FROM @ids_packets""")
def _(view):
    return N.normalize_packets(view("ids_packets")).select(
        "packet_id", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "direction", "ttl", "interface", "size")


@query("b11_flag_names", """SELECT event_id, array_to_string(list_filter([CASE WHEN contains(f, 'S') THEN 'SYN' END, CASE WHEN contains(f, 'A') THEN 'ACK' END,
 CASE WHEN contains(f, 'F') THEN 'FIN' END, CASE WHEN contains(f, 'R') THEN 'RST' END, CASE WHEN contains(f, 'P') THEN 'PSH' END,
 CASE WHEN contains(f, 'U') THEN 'URG' END], lambda x: x IS NOT NULL), ',') AS flags
 FROM (SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'S' WHEN 1 THEN 'AS' WHEN 2 THEN 'PA' WHEN 3 THEN 'FPU' WHEN 4 THEN 'RA' ELSE '' END AS f FROM events) letters""")
def _(view):
    letters = F.expr("CASE event_id % 6 WHEN 0 THEN 'S' WHEN 1 THEN 'AS' WHEN 2 THEN 'PA' WHEN 3 THEN 'FPU' WHEN 4 THEN 'RA' ELSE '' END")
    return view("table:events").select("event_id", F.array_join(N.tcp_flag_names(letters), ",").alias("flags"))


@query("b12_cef_severity", f"""SELECT o_orderkey, CAST(m.n AS INTEGER) AS severity FROM orders
 LEFT JOIN (VALUES {rows(fixed.CEF_SEVERITY)}) m(label, n) ON m.label = CASE o_orderkey % 9 WHEN 0 THEN 'EMERGENCY' WHEN 1 THEN 'ALERT'
 WHEN 2 THEN 'CRITICAL' WHEN 3 THEN 'ERROR' WHEN 4 THEN 'WARNING' WHEN 5 THEN 'NOTICE' WHEN 6 THEN 'INFO' WHEN 7 THEN 'DEBUG' ELSE 'OTHER' END""")
def _(view):
    label = F.expr("element_at(array('emergency', 'alert', 'Critical', 'ERROR', 'warning', 'notice', 'info', 'debug', 'other'), int(o_orderkey % 9) + 1)")
    return view("table:orders").select("o_orderkey", N.cef_severity(label).alias("severity"))


@query("x18_display_time", """SELECT line_id, substr(CASE WHEN contains(ts, 'T') THEN split_part(ts, 'T', -1) ELSE split_part(ts, ' ', -1) END, 1, 8) AS shown
 FROM (SELECT line_id, CASE WHEN line_id % 2 = 0 THEN regexp_extract(raw, '(\\d{4}-\\d{2}-\\d{2}.\\d{2}:\\d{2}:\\d{2})', 1) ELSE replace(
  regexp_extract(raw, '(\\d{4}-\\d{2}-\\d{2}.\\d{2}:\\d{2}:\\d{2})', 1), ' ', 'T') END AS ts FROM @raw_logs) t""")
def _(view):
    ts = F.regexp_extract("raw", r"(\d{4}-\d{2}-\d{2}.\d{2}:\d{2}:\d{2})", 1)
    text = F.when(F.col("line_id") % 2 == 0, ts).otherwise(F.replace(ts, F.lit(" "), F.lit("T")))
    return view("raw_logs").select("line_id", display_time(text).alias("shown"))
