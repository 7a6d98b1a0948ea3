"""Security views of the driver tables.

The driver tables hold no security data, so every operator reads a view that gives the rows of a
whole table a security meaning.  A view is one SELECT, written once with place holders for the
few functions whose names differ, and used both as Spark SQL and as text for the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vigil import fixed

_SPARK = {"micros": lambda c: f"unix_micros(CAST({c} AS TIMESTAMP))",
          "clock": lambda c, f: "date_format(CAST(%s AS TIMESTAMP), '%s')" % (c, f),
          "div": lambda a, b: f"(({a}) div ({b}))",
          "text": lambda a: f"CAST({a} AS STRING)",
          "array": lambda *a: f"array({', '.join(a)})",
          "hex": lambda a: f"CAST(conv({a}, 16, 10) AS BIGINT)",
          "quote": lambda s: "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"}
_DUCK = {"micros": lambda c: f"epoch_us({c})",
         "clock": lambda c, f: "strftime(%s, '%s')" % (c, _strftime(f)),
         "div": lambda a, b: f"(({a}) // ({b}))",
         "text": lambda a: f"CAST({a} AS VARCHAR)",
         "array": lambda *a: f"[{', '.join(a)}]",
         "hex": lambda a: f"CAST('0x' || {a} AS BIGINT)",
         "quote": lambda s: "'" + s.replace("'", "''") + "'"}


def line_id(d) -> str:
    """Number of a row of ``lineitem`` from all that tells its rows apart: 60 bits of their digest."""
    t = d["text"]
    parts = [t(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]
    parts += [t(f"CAST(round({c} * 100) AS BIGINT)") for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")]
    parts += ["l_returnflag", "l_linestatus", t(d["micros"]("l_shipdate"))]
    return d["hex"](f"substr(md5(concat_ws('|', {', '.join(parts)})), 1, 15)")


def _strftime(pattern: str) -> str:
    for spark, c in (("yyyy", "%Y"), ("MMM", "%b"), ("MM", "%m"), ("dd", "%d"), ("HH", "%H"), ("mm", "%M"),
                     ("ss", "%S"), ("''", "")):
        pattern = pattern.replace(spark, c)
    return pattern


def choose(index: str, values, q) -> str:
    """Constant picked by a number from 0; a list look-up keeps the generated code small."""
    items = ", ".join(q(v) if isinstance(v, str) else str(v) for v in values)
    if q is _SPARK["quote"]:
        return f"element_at(array({items}), CAST({index} AS INT) + 1)"
    return f"list_extract([{items}], {index} + 1)"


DOMAINS = ["example.com", "www.evil-c2.tk", "phishing-bank.ml", "cdn.crypto-miner.xyz", "data-exfil.top",
           "shop.buzz", "news.pw", "Update.Malware.xyz", "intranet.local", "free.cf"]
LONG_DOMAIN = "a1b2c3d4e5f6g7h8i9j0k1l2m3n4o5p6q7r8s9t0u1v2w3x4y5z6.tunnel.tk"
URIS = ["/index.html", "/login?user=1' OR 1=1--", "/.env", "/wp-admin/setup.php", "/search?q=<script>",
        "/api/v1/items", "/../../etc/passwd", "/phpmyadmin/"]
STATUSES = [200, 200, 404, 404, 200, 500, 403, 401]


def events(d) -> str:
    """Normalised events with typed hot columns, one per row of ``events``."""
    q, t = d["quote"], d["text"]
    n = "event_id"
    listed = [r[0] for r in fixed.THREAT_IPS]
    geo = [r[0] for r in fixed.GEO_IPS]
    own = (f"'10.' || {t('(' + d['div']('user_id', 62500) + ') % 256')} || '.' || "
           f"{t('(' + d['div']('user_id', 250) + ') % 250')} || '.' || {t('user_id % 250 + 1')}")
    src = (f"CASE WHEN user_id % 25 = 3 THEN {choose('(' + d['div']('user_id', 25) + ') % 7', listed, q)} "
           f"WHEN user_id % 25 = 4 THEN {choose('(' + d['div']('user_id', 25) + ') % 6', geo, q)} ELSE {own} END")
    pick = lambda error, buy, sign, view, click: (
        f"CASE event_type WHEN 'error' THEN {error} WHEN 'purchase' THEN {buy} WHEN 'signup' THEN {sign} "
        f"WHEN 'view' THEN {view} ELSE {click} END")
    status = choose(f"{n} % 8", STATUSES, q)
    web = (f"CASE WHEN {n} % 8 IN (1, 4, 6) THEN 'injection_attempt' WHEN {n} % 8 = 5 THEN 'server_error' "
           f"WHEN {n} % 8 = 7 THEN 'access_denied' WHEN {n} % 8 IN (2, 3) THEN 'recon_attempt' ELSE 'web_request' END")
    click = choose(f"{n} % 3", ["successful_logon", "dns_query", "dns_tunnel_suspect"], q)
    return f"""SELECT event_id, {d['micros']('ts')} AS us, {d['clock']('ts', 'yyyy-MM-dd HH:mm:ss')} AS timestamp,
  {pick("'active_directory'", "'firewall'", "'vpn'", "'web_server'", choose(f"{n} % 3", ["active_directory", "dns", "dns"], q))} AS source_type,
  {pick("'failed_logon'", "'network_traffic'", "'vpn_auth_fail'", web, click)} AS event_type,
  CAST({pick('7', '7', '7', f"CASE WHEN {n} % 8 IN (1, 4, 6) THEN 8 WHEN {n} % 8 = 5 THEN 7 WHEN {n} % 8 = 0 THEN 4 ELSE 6 END", choose(f"{n} % 3", [4, 4, 7], q))} AS INT) AS severity,
  {src} AS src_ip, '192.168.' || {t(f"{n} % 3")} || '.' || {t(f"{n} % 200 + 1")} AS dst_ip,
  CAST(1024 + {n} % 50000 AS INT) AS src_port, CAST(1 + ({n} * 7919) % 1024 AS INT) AS dst_port,
  {pick("''", choose(f"{n} % 3", ["TCP", "UDP", "ICMP"], q), "''", "''", "''")} AS protocol,
  {pick("'FAILURE'", choose(f"{n} % 5", ["DENY", "DROP", "REJECT", "DENY", "ALLOW"], q), "'AUTH_FAIL'", "'GET'", choose(f"{n} % 3", ["SUCCESS", "QUERY", "QUERY"], q))} AS action,
  'user' || {t('user_id')} AS username,
  {pick("''", "''", "''", choose(f"{n} % 8", URIS, q), "''")} AS uri,
  {pick("''", "''", "''", "''", f"CASE {n} % 3 WHEN 1 THEN {choose(f'{n} % 10', DOMAINS, q)} WHEN 2 THEN {q(LONG_DOMAIN)} ELSE '' END")} AS domain,
  CAST({pick('0', '0', '0', status, '0')} AS INT) AS status_code, CAST(floor(value) AS BIGINT) AS bytes
FROM {{events}}"""


def raw_logs(d) -> str:
    """Log lines of six sources, one per row of ``events``; some do not parse, some are of no known source."""
    q, t, n = d["quote"], d["text"], "event_id"
    iso = d["clock"]("ts", "yyyy-MM-dd''T''HH:mm:ss") if d is _SPARK else "strftime(ts, '%Y-%m-%dT%H:%M:%S')"
    iso = iso.replace("''T''", "\\'T\\'")
    plain = d["clock"]("ts", "yyyy-MM-dd HH:mm:ss")
    apache = d["clock"]("ts", "dd/MMM/yyyy:HH:mm:ss")
    ip = f"'10.1.' || {t(d['div']('user_id', 250) + ' % 250')} || '.' || {t('user_id % 250 + 1')}"
    windows = choose(f"{n} % 10", [r[0] for r in fixed.WINDOWS_EVENTS] + [4999, 0], q)
    fw = (f"{plain} || ' [FIREWALL] ' || {choose(f'{n} % 4', ['ALLOW', 'DENY', 'DROP', 'REJECT'], q)} || ' SRC=' || {ip} "
          f"|| ' DST=10.0.0.10 ' || CASE WHEN {n} % 2 = 0 THEN 'SPORT=' || {t(f'1024 + {n} % 60000')} || ' ' ELSE '' END "
          f"|| 'DPORT=' || {t(f'{n} % 1024')} || CASE WHEN {n} % 3 = 0 THEN ' PROTO=UDP' ELSE '' END")
    ad = (f"'{{{{\"EventID\": ' || {t(windows)} || ', \"TimeCreated\": \"' || {plain} || '\"' || CASE WHEN {n} % 6 = 0 THEN '' "
          f"ELSE ', \"TargetUserName\": \"user' || {t('user_id')} || '\"' END || ', \"IpAddress\": \"' || {ip} || '\", \"LogonType\": 3}}}}'")
    web = (f"{ip} || ' - ' || CASE WHEN {n} % 3 = 0 THEN '-' ELSE 'user' || {t('user_id')} END || ' [' || {apache} || "
           f"' +0000] \"GET ' || {choose(f'{n} % 7', [u for u in URIS if ' ' not in u], q)} || ' HTTP/1.1\" ' || "
           f"{choose(f'{n} % 5', ['200', '404', '500', '403', '302'], q)} || ' ' || {t(f'{n} % 5000')} || "
           f"CASE WHEN {n} % 2 = 0 THEN ' \"-\" \"Mozilla/5.0\"' ELSE '' END")
    dns = (f"{iso} || ' ' || {ip} || '#' || {t(f'1024 + {n} % 60000')} || ' query: ' || CASE WHEN {n} % 9 = 0 THEN {q(LONG_DOMAIN)} "
           f"ELSE {choose(f'{n} % 10', DOMAINS, q)} END || ' A IN'")
    vpn = (f"{plain} || ' [VPN] ' || {choose(f'{n} % 3', ['CONNECT', 'DISCONNECT', 'AUTH_FAIL'], q)} || ' USER=user' || "
           f"{t('user_id')} || ' IP=' || {ip} || CASE WHEN {n} % 2 = 0 THEN ' TUNNEL=corp' ELSE '' END")
    syslog = (f"CASE WHEN {n} % 5 = 0 THEN 'plain text line number ' || {t(n)} ELSE '<' || {t(f'{n} % 192')} || '>1 ' || {iso} || "
              f"'Z host' || {t('user_id % 40')} || ' sshd ' || {t(n)} || ' - Connection closed by ' || {ip} END")
    kind = (f"CASE WHEN {n} % 23 = 0 THEN 'netflow' ELSE {choose(f'{n} % 6', fixed.LOG_SOURCES, q)} END")
    line = f"CASE {n} % 6 WHEN 0 THEN {fw} WHEN 1 THEN {ad} WHEN 2 THEN {web} WHEN 3 THEN {dns} WHEN 4 THEN {vpn} ELSE {syslog} END"
    return (f"SELECT event_id AS line_id, {kind} AS log_type, CASE WHEN {n} % 31 = 0 AND {n} % 6 <> 5 THEN 'garbled ' || {t(n)} "
            f"ELSE {line} END AS raw FROM {{events}}")


def simple_records(d) -> str:
    q, t, n = d["quote"], d["text"], "event_id"
    ip = f"'10.2.' || {t(d['div']('user_id', 250) + ' % 250')} || '.' || {t('user_id % 250 + 1')}"
    return f"""SELECT event_id, {d['micros']('ts')} AS us,
  CASE event_type WHEN 'error' THEN 'auth_event' WHEN 'purchase' THEN 'firewall' WHEN 'signup' THEN 'syslog' WHEN 'view' THEN 'auth_event' ELSE 'other' END AS source,
  'host' || {t('user_id % 20')} AS host, {ip} AS src_ip, '10.0.0.10' AS dst_ip,
  CASE event_type WHEN 'error' THEN 'LOGIN_FAILED' WHEN 'purchase' THEN {choose(f'{n} % 3', ['DENY', 'DENY', 'ALLOW'], q)} WHEN 'view' THEN 'LOGIN_SUCCESS' END AS action,
  'user' || {t('user_id')} AS "user", CASE WHEN event_type = 'signup' AND {n} % 2 = 0 THEN 'ERROR' END AS severity,
  CASE WHEN {n} % 3 = 0 THEN 'message ' || {t(n)} END AS msg, CASE WHEN {n} % 3 < 2 THEN 'text ' || {t(n)} END AS description
FROM {{events}}"""


PAYLOADS = ["id=1' OR 1=1--", "a=1 UNION ALL SELECT name", "q=<script>alert(1)</script>", "<img onerror = x>",
            "GET /../../../../x", "GET /etc/passwd", "run cmd.exe /c dir", "<?php system('id');",
            "SSH-2.0 AUTH password guess", "QUERY " + "abcdefghij" * 5 + ".tunnel.tk", "beacon to evil-c2.tk now",
            "ARP Reply 10.0.0.1 unsolicited", "Echo Request (flood)", "GET / HTTP/1.1", "", "nmap -sS ../passwd"]
PORTS = [80, 443, 22, 53, 502, 23, 8080, 3389, 25, 123, 514, 445]
FLAGS = {1: ["SYN"], 2: ["SYN", "ACK"], 3: ["ACK"], 4: ["ACK", "PSH"], 5: ["ACK", "FIN"], 6: ["ACK"]}


def packets(d, name_other: bool = True) -> str:
    """Packets, one per row of ``lineitem``: four orders form a connection, the line number its progress.

    ``name_other`` gives protocols outside TCP, UDP and ICMP the name OTHER.
    """
    q, t = d["quote"], d["text"]
    c = d["div"]("l_orderkey", 4)
    s = d["div"](c, 50)
    net = lambda z: choose(f"{z} % 5", ["203.0.113.", "172.16.0.", "192.168.1.", "10.10.7.", "10.0.0."], q)
    out = lambda z: choose(f"{z} % 5", ["198.51.100.", "10.10.2.", "172.16.0.", "192.168.2.", "8.8.8."], q)
    a = f"{net(s)} || {t(f'{s} % 250 + 1')}"
    b = f"{out(c)} || {t(f'{c} % 200 + 1')}"
    aport, bport = f"(1024 + {c} % 50000)", choose(f"{c} % 12", PORTS, q)
    reply = "l_linenumber IN (2, 6)"
    arrays = {k: d["array"](*[q(f) for f in v]) for k, v in FLAGS.items()}
    last = f"CASE WHEN {c} % 3 = 0 THEN {d['array'](q('RST'))} ELSE {d['array'](q('ACK'), q('FIN'))} END"
    proto = (f"CASE WHEN {c} % 29 = 0 THEN {q('OTHER' if name_other else 'ARP')} WHEN {c} % 10 < 7 THEN 'TCP' "
             f"WHEN {c} % 10 < 9 THEN 'UDP' ELSE 'ICMP' END")
    flags = f"CASE l_linenumber {' '.join(f'WHEN {k} THEN {v}' for k, v in arrays.items())} ELSE {last} END"
    none = "CAST(array() AS ARRAY<STRING>)" if d is _SPARK else "CAST([] AS VARCHAR[])"
    return f"""SELECT *, CASE WHEN src_zone_no = 4 THEN 'FORWARD' WHEN src_zone_no = 0 THEN 'INBOUND' ELSE 'OUTBOUND' END AS direction,
  {'array_join(tcp_flags, ' + "'-'" + ')' if d is _SPARK else "array_to_string(tcp_flags, '-')"} AS flags FROM (
 SELECT {line_id(d)} AS packet_id,
  1704067200000000 + {c} * 1000000 + l_linenumber * 100000 + l_partkey % 50000 AS us,
  CASE WHEN {reply} THEN {b} ELSE {a} END AS src_ip, CASE WHEN {reply} THEN {a} ELSE {b} END AS dst_ip,
  CAST(CASE WHEN {reply} THEN {bport} ELSE {aport} END AS INT) AS src_port,
  CAST(CASE WHEN {reply} THEN {aport} ELSE {bport} END AS INT) AS dst_port,
  CAST({s} % 5 AS INT) AS src_zone_no, {proto} AS protocol,
  CASE WHEN {proto} = 'TCP' THEN {flags} ELSE {none} END AS tcp_flags,
  CAST(40 + l_quantity * 10 AS INT) AS size, {choose('l_partkey % 16', PAYLOADS, q)} AS payload
 FROM {{lineitem}}) packet_rows"""


def commands(d) -> str:
    """Register commands, one per row of ``lineitem``; register 100 receives a third of them."""
    q = d["quote"]
    order = [100, 101, 102, 103, 200, 201, 202, 203, 300, 301, 302, 303, 400, 401, 402, 999]
    return f"""SELECT command_id, us, function_code, address, source_ip,
  CASE WHEN address IN (100, 201) THEN amount * 12 WHEN address IN (400, 402) THEN amount % 3 ELSE amount * 2 END AS value FROM (
 SELECT {line_id(d)} AS command_id,
  1704067200000000 + l_orderkey * 2000000 + l_linenumber * 250000 AS us,
  CAST(CASE WHEN l_linenumber <= 3 THEN 6 WHEN l_linenumber = 4 THEN 16 ELSE 3 END AS INT) AS function_code,
  CAST(CASE WHEN l_partkey % 3 = 0 THEN 100 ELSE {choose('l_partkey % 16', order, q)} END AS INT) AS address,
  CAST(l_quantity AS BIGINT) AS amount,
  {choose('l_suppkey % 5', ['10.0.0.5', '10.0.0.10', '192.168.1.100', 'HMI', '10.9.9.9'], q)} AS source_ip
 FROM {{lineitem}}) command_rows"""


SOFTWARE = ["Apache 2.4.49", "OpenSSH 7.2p2", "nginx 1.14.0", "Windows Server 2012 R2", "MySQL 5.7.38", "vsftpd 3.0.3",
            "Apache Tomcat/9.0.46", "OpenSSL 1.0.1f", "Log4j 2.14.1", "PostgreSQL 13.2", "Samba 4.5.1", "IIS",
            "Apache Tomcat 8.5.1"]


def assets(d) -> str:
    """Assets with configuration, one per row of ``supplier``."""
    q, k = d["quote"], "s_suppkey"
    three = lambda n, at: f"CASE {at} WHEN 0 THEN {n} WHEN 1 THEN NOT ({n}) END"
    return f"""SELECT s_suppkey AS asset_id, s_name AS hostname, {choose(f'{k} % 13', SOFTWARE, q)} AS software,
  {choose(f'{k} % 7', ['TLS 1.2', 'TLS 1.3', 'TLS 1.1', 'TLS 1.0', 'SSLv3', '', 'TLS 1.4'], q)} AS ssl_version,
  {k} % 4 = 0 AS default_creds_active, {k} % 3 = 0 AS is_industrial_device, {k} % 6 = 0 AS isolated_segment,
  CASE {k} % 3 WHEN 0 THEN true WHEN 1 THEN false END AS mfa_enabled,
  CASE {k} % 5 WHEN 0 THEN false WHEN 1 THEN true WHEN 2 THEN true END AS logging_enabled,
  CASE WHEN {k} % 4 = 1 THEN '' WHEN {k} % 4 = 2 THEN NULL ELSE s_name END AS asset_tag,
  {choose(f'{k} % 5', ['2026-06-20', '2026-04-20', '2025-01-05', 'not a date', ''], q)} AS last_patch_date FROM {{supplier}}"""


SERVICES = [("OpenSSH", "7.1p2", "SSH"), ("nginx", "1.14.0", "HTTP"), ("Apache", "2.4.50", "HTTPS"), ("MySQL", "5.7.30", "MySQL"),
            ("Unknown", "", "TCP"), ("OpenSSL", "1.0.1f", "HTTPS"), ("Apache Log4j", "2.14.1", "TCP"), ("Sudo", "1.8.27", "TCP"),
            ("OpenSSH", "9.2", "SSH"), ("Samba", "4.6.1-beta", "SMB"), ("", "1.0", "TCP")]
BANNERS = ["SSH-2.0-OpenSSH_8.9p1 Ubuntu-3ubuntu0.4", "HTTP/1.1 200 OK\nServer: Apache/2.4.49 (Unix)\nDate: x", "220 ProFTPD 1.3.5 Server ready.",
           "220 mail.example.com ESMTP Postfix", "5.7.38-log", "Server: nginx/1.14.0", "SSH-1.99-OpenSSH_6.6", "Microsoft-IIS\nServer: Microsoft-IIS/10.0",
           "", "version 4.2b ready", "SSH-2.0-OpenSSH_6.7 Debian-5", "CentOS Linux login:", "SSH-1.5-old"]
BANNER_PORTS = [22, 80, 21, 25, 3306, 8080, 22, 443, 445, 9000, 22, 23, 2222]


def services(d) -> str:
    """Open services of the assets, one per row of ``part`` (twenty per asset)."""
    q, t, k = d["quote"], d["text"], "p_partkey"
    kind = f"({d['div'](k, 20)} + {k} % 2) % 11"       # two kinds of service per asset
    banners = "(CASE %s %s END)" % (f"{k} % 13", " ".join(
        f"WHEN {n} THEN " + " || chr(10) || ".join(q(part) for part in b.split("\n")) for n, b in enumerate(BANNERS)))
    return f"""SELECT p_partkey AS service_id, {d['div'](k, 20)} AS asset_id, '10.3.' || {t(d['div'](k, 5000) + ' % 250')} || '.' || {t(d['div'](k, 20) + ' % 250 + 1')} AS host,
  CAST({choose(f'{k} % 13', BANNER_PORTS, q)} AS INT) AS port, {choose(kind, [s[0] for s in SERVICES], q)} AS service,
  {choose(kind, [s[1] for s in SERVICES], q)} AS version, {choose(kind, [s[2] for s in SERVICES], q)} AS protocol,
  {banners} AS banner, {choose(f'{k} % 4', ['DENY', 'missing', '', 'SAMEORIGIN'], q)} AS x_frame_options, {k} % 3 = 0 AS supports_tls10,
  {choose(f'{k} % 5', ['TLSv1.0', 'TLSv1.1 ECDHE', 'TLS 1.2', 'TLSv1.3', 'SSLv3'], q)} AS tls_info, CAST({choose(f'{k} % 4', [56, 112, 128, 256], q)} AS INT) AS cipher_bits,
  {choose(f'{k} % 3', ['open', 'closed', 'filtered'], q)} AS state FROM {{part}}"""


def networks(d) -> str:
    """Texts that may be networks or addresses, one per row of ``customer``."""
    q, t, k = d["quote"], d["text"], "c_custkey"
    octet = lambda e: t(f"({e}) % 256")
    base = f"{octet(f'{k} * 7')} || '.' || {octet(f'{k} * 13')} || '.' || {octet(f'{k} * 31')} || '.' || {octet(k)}"
    return f"""SELECT c_custkey AS row_id, {base} AS ip, CASE {k} % 9 WHEN 0 THEN 'not a network' WHEN 1 THEN {base} || '/33' ELSE {base} || '/' || {t(f'{k} % 33')} END AS cidr,
  CASE {k} % 8 WHEN 0 THEN '300.1.1.1' WHEN 1 THEN '1.2.3' WHEN 2 THEN '01.2.3.4' ELSE {base} END AS maybe_ip,
  CASE {k} % 6 WHEN 0 THEN {base} || '/30' WHEN 1 THEN {base} || ',10.0.0.1, 10.0.0.1' WHEN 2 THEN '10.5.' || {octet(k)} || '.3-9' WHEN 3 THEN 'nonsense' WHEN 4 THEN {base} || '/31' ELSE {base} END AS target
 FROM {{customer}}"""


def pages(d) -> str:
    """Web requests with the whole page as payload, one per row of ``pages``."""
    return "SELECT page_id AS packet_id, 'TCP' AS protocol, 80 AS dst_port, url, html AS payload FROM {pages}"


VIEWS = {"events": events, "raw_logs": raw_logs, "simple_records": simple_records, "packets": packets,
         "ids_packets": lambda d: packets(d, name_other=False), "commands": commands, "assets": assets,
         "services": services, "networks": networks, "pages": pages}
TABLES = ["events", "lineitem", "supplier", "part", "customer", "pages"]


def oracle_view(name: str) -> str:
    """Oracle text of a view."""
    return VIEWS[name](_DUCK).replace("{{", "\0").replace("}}", "\1").format(**{t: t for t in TABLES}) \
        .replace("\0", "{").replace("\1", "}")


# A table that Spark reads in fewer pieces than there are cores is spread out when it is larger
# than this.  Large tables come in many pieces and are left alone.
SPREAD_BYTES = 4_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if size > SPREAD_BYTES and df.rdd.getNumPartitions() < cores:
        return df.repartition(cores, df.columns[0])
    return df


def feed(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view as a DataFrame."""
    text = VIEWS[name](_SPARK)
    used = [t for t in TABLES if f"FROM {{{t}}}" in text]
    return spark.sql(text.replace('AS "user"', "AS `user`"), **{t: table(spark, sf_dir, t) for t in used})


def stream_feed(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view as a stream over the same file."""
    text = VIEWS[name](_SPARK)
    used = [t for t in TABLES if f"FROM {{{t}}}" in text]
    read = {t: spark.readStream.schema(spark.read.parquet(f"{sf_dir}/{t}.parquet").schema).parquet(f"{sf_dir}/{t}.parquet*")
            for t in used}
    return spark.sql(text.replace('AS "user"', "AS `user`"), **read)
