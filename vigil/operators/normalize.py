"""Raw log lines to one event schema, and the smaller normalisers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from vigil import fixed
from vigil.functions.text import event_time

EVENT_FIELDS = ["timestamp", "event_type", "severity", "src_ip", "dst_ip", "src_port", "dst_port",
                "protocol", "action", "username", "hostname", "description", "metadata"]

_DIRECTORY = T.StructType([T.StructField(n, T.StringType()) for n in (
    "EventID", "TimeCreated", "TargetUserName", "IpAddress", "WorkstationName", "LogonType",
    "_corrupt")])


def _text(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def _event(**values) -> Column:
    """Event struct; a field that is not given is empty text or 0."""
    numbers = {"severity": 4, "src_port": 0, "dst_port": 0}
    empty_map = F.create_map().cast("map<string,string>")
    fields = []
    for name in EVENT_FIELDS:
        value = values.get(name, empty_map if name == "metadata" else numbers.get(name, ""))
        kind = "int" if name in numbers else "map<string,string>" if name == "metadata" else "string"
        fields.append(_text(value).cast(kind).alias(name))
    return F.struct(*fields)


# source -> line format and its number of groups
_LINES = {"firewall": (fixed.FIREWALL_LINE, 7), "web_server": (fixed.WEB_LINE, 10),
          "dns": (fixed.DNS_LINE, 5), "vpn": (fixed.VPN_LINE, 5), "syslog": (fixed.SYSLOG_LINE, 8)}
_MARK = "\x01"


def _split_line(raw_logs: DataFrame, sources) -> DataFrame:
    """Add ``_parts``, the groups of a line, and ``_json``, the object of a directory line.

    One replacement turns a line into its marked-off groups, so the pattern runs once per line
    and not once per group.  A line that does not fit stays one part.
    """
    raw, parts = F.col("raw"), None
    for source, (pattern, count) in _LINES.items():
        if source not in sources:
            continue
        marked = F.regexp_replace(raw, f"(?s:^.*?){pattern}(?s:.*$)",
                                  _MARK.join(f"${n}" for n in range(1, count + 1)))
        test, value = F.col("log_type") == source, F.split(marked, _MARK, -1)
        parts = F.when(test, value) if parts is None else parts.when(test, value)
    json = F.from_json(raw, _DIRECTORY, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    parts = F.lit(None).cast("array<string>") if parts is None else parts
    return raw_logs.withColumns({"_parts": parts,
                                 "_json": F.when(F.col("log_type") == "active_directory", json)})


def _groups(source: str) -> list[Column]:
    return [F.col("_parts")[n] for n in range(_LINES[source][1])]


def _fits(source: str) -> Column:
    return F.size("_parts") == _LINES[source][1]


def _or(text: Column, other) -> Column:
    return F.when(text != "", text).otherwise(_text(other))


def _firewall() -> Column:
    ts, action, src, dst, sport, dport, proto = _groups("firewall")
    return _event(timestamp=ts, event_type="network_traffic",
                  severity=F.when(action.isin(fixed.BLOCK_ACTIONS), 7).otherwise(4),
                  src_ip=src, dst_ip=dst, src_port=_or(sport, "0"), dst_port=dport,
                  protocol=_or(proto, "TCP"), action=action,
                  description=F.concat(F.lit("Firewall "), action, F.lit(": "), src, F.lit(" -> "),
                                       dst, F.lit(":"), dport))


def _pick(key: Column, rows, column: int, default) -> Column:
    """Constant look-up of ``rows`` by their first entry."""
    table = F.create_map(*[F.lit(v) for row in rows for v in (row[0], row[column])])
    return F.coalesce(F.try_element_at(table, key), F.lit(default))


def _directory() -> Column:
    data = F.col("_json")
    number = F.coalesce(data["EventID"].try_cast("int"), F.lit(0))
    get = lambda name, other="": F.coalesce(data[name], F.lit(other))
    rows = fixed.WINDOWS_EVENTS
    return _event(timestamp=get("TimeCreated"), event_type=_pick(number, rows, 1, "ad_generic"),
                  action=_pick(number, rows, 2, "INFO"), severity=_pick(number, rows, 3, 4),
                  src_ip=get("IpAddress"), username=get("TargetUserName"),
                  hostname=get("WorkstationName"),
                  description=F.concat(_pick(number, rows, 4, "AD event"), F.lit(" - User: "),
                                       get("TargetUserName", "N/A")),
                  metadata=F.create_map(F.lit("windows_event_id"), number.cast("string"),
                                        F.lit("logon_type"), get("LogonType")))


def _any(text: Column, words) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def web_class(status: Column, uri: Column) -> tuple[Column, Column]:
    """(event_type, severity) of a request; an injection mark beats every status."""
    injection = _any(F.lower(uri), [m.lower() for m in fixed.INJECTION_MARKS])
    recon = (status == 404) & _any(uri, fixed.RECON_PATHS)
    denied = status.isin(401, 403)
    kind = (F.when(injection, "injection_attempt").when(status >= 500, "server_error")
            .when(denied, "access_denied").when(recon, "recon_attempt").otherwise("web_request"))
    severity = (F.when(injection, 8).when(status >= 500, 7).when(denied | recon, 6).otherwise(4))
    return kind, severity


def _web() -> Column:
    src, user, ts, method, uri, _, status, size, _, agent = _groups("web_server")
    kind, severity = web_class(status.try_cast("int"), uri)
    return _event(timestamp=ts, event_type=kind, severity=severity, src_ip=src, action=method,
                  username=F.when(user != "-", user).otherwise(""),
                  description=F.concat(method, F.lit(" "), uri, F.lit(" -> "), status),
                  metadata=F.create_map(F.lit("method"), method, F.lit("uri"), uri,
                                        F.lit("status_code"), status, F.lit("bytes"), size,
                                        F.lit("user_agent"), agent))


def dns_class(domain: Column) -> tuple[Column, Column]:
    """(event_type, severity) of a queried name; the length test comes last and wins."""
    tld = reduce(lambda a, b: a | b, [domain.endswith(t) for t in fixed.DNS_SUSPICIOUS_TLDS])
    long_name = F.length(domain) > fixed.DNS_TUNNEL_LENGTH
    return (F.when(long_name, "dns_tunnel_suspect").when(tld, "suspicious_dns").otherwise("dns_query"),
            F.when(long_name, 7).when(tld, 6).otherwise(4))


def _dns() -> Column:
    ts, client, domain, qtype, _ = _groups("dns")
    kind, severity = dns_class(domain)
    return _event(timestamp=ts, event_type=kind, severity=severity, src_ip=client, action="QUERY",
                  description=F.concat(F.lit("DNS "), qtype, F.lit(" query: "), domain),
                  metadata=F.create_map(F.lit("domain"), domain, F.lit("query_type"), qtype))


def _vpn() -> Column:
    ts, action, user, src, tunnel = _groups("vpn")
    return _event(timestamp=ts, event_type=F.concat(F.lit("vpn_"), F.lower(action)),
                  severity=F.when(action == "AUTH_FAIL", 7).otherwise(4), src_ip=src, action=action,
                  username=user,
                  description=F.concat(F.lit("VPN "), action, F.lit(" - User: "), user,
                                       F.lit(" from "), src),
                  metadata=F.create_map(F.lit("tunnel"), _or(tunnel, "default")))


def _syslog() -> Column:
    raw = F.col("raw")
    pri, _, ts, host, app, process, _, message = _groups("syslog")
    number = pri.try_cast("int")
    parsed = _event(timestamp=ts, event_type="syslog_message",
                    severity=F.greatest(F.lit(0), F.lit(10) - number % 8), hostname=host,
                    description=F.trim(message),
                    metadata=F.create_map(F.lit("facility"), F.shiftright(number, 3).cast("string"),
                                          F.lit("appname"), app, F.lit("procid"), process))
    plain = _event(event_type="generic_syslog", severity=4, description=F.substring(raw, 1, 200))
    return F.when(_fits("syslog"), parsed).otherwise(plain)


_PARSERS = {"firewall": _firewall, "active_directory": _directory, "web_server": _web,
            "dns": _dns, "vpn": _vpn, "syslog": _syslog}


def _status() -> Column:
    kind = F.col("log_type")
    count = F.create_map(*[F.lit(v) for source, (_, n) in _LINES.items() for v in (source, n)])
    parsed = (F.when(kind == "active_directory", F.col("_json").isNotNull() & F.col("_json._corrupt").isNull())
              .when(kind == "syslog", F.lit(True))
              .otherwise(F.size("_parts") == F.try_element_at(count, kind)))
    return F.when(~kind.isin(fixed.LOG_SOURCES), "unknown").when(parsed, kind).otherwise("parse_errors")


def normalize_logs(raw_logs: DataFrame, sources=tuple(fixed.LOG_SOURCES)) -> DataFrame:
    """Parsed events of ``(log_type, raw, ...)`` rows; other input columns are kept.

    One pass: each line is parsed by the branch of its log type.  Lines that do not parse are left
    out, see :func:`ingestion_stats`; so are log types that are not among ``sources``.
    """
    event = None
    for source in sources:
        test = F.col("log_type") == source
        event = F.when(test, _PARSERS[source]()) if event is None else event.when(test, _PARSERS[source]())
    lines = raw_logs.where(F.col("raw").isNotNull() & F.col("log_type").isin(list(sources)))
    parsed = (_split_line(lines, sources).where(_status() == F.col("log_type"))
              .withColumn("_event", event))
    kept = [c for c in raw_logs.columns if c not in ("log_type", "raw")]
    return (parsed.select(*kept, F.col("log_type").alias("source_type"), F.col("raw").alias("raw_log"), "_event.*")
            .withColumn("event_time", event_time("timestamp")))


def with_event_id(events: DataFrame, *columns: str) -> DataFrame:
    """Reproducible 16-character id from the source, the line and the given columns."""
    parts = ["source_type", "raw_log", *columns]
    return events.withColumn("event_id", F.substring(
        F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in parts]), 256), 1, 16))


def ingestion_stats(raw_logs: DataFrame) -> DataFrame:
    """Lines per outcome: one row per source, ``parse_errors`` and ``unknown``."""
    return (_split_line(raw_logs, fixed.LOG_SOURCES).groupBy(_status().alias("parse_status"))
            .agg(F.count(F.lit(1)).alias("lines")))


def normalize_simple(records: DataFrame) -> DataFrame:
    """Small normaliser for ``syslog``, ``auth_event`` and ``firewall`` records; missing is NULL."""
    source, action = F.col("source"), F.col("action")
    network = source.isin("auth_event", "firewall")
    act = F.when(network, action)
    severity = (F.when(source == "syslog", F.coalesce(F.col("severity"), F.lit("INFO")))
                .when((source == "auth_event") & (action == "LOGIN_FAILED"), "WARNING")
                .when((source == "firewall") & (action == "DENY"), "WARNING")
                .otherwise("INFO"))
    kept = [c for c in records.columns if c not in (
        "source", "host", "src_ip", "dst_ip", "action", "user", "severity", "msg", "description")]
    return records.select(
        *kept, F.coalesce(source, F.lit("unknown")).alias("source_type"),
        F.when(source == "syslog", F.col("host")).when(network, F.col("src_ip")).alias("src_ip"),
        F.when(source == "firewall", F.col("dst_ip")).alias("dst_ip"),
        act.alias("action"), severity.alias("severity"),
        F.when(source == "auth_event", F.col("user")).alias("user"),
        F.coalesce(F.col("msg"), F.col("description"), F.lit("")).alias("msg"))


def normalize_packets(packets: DataFrame) -> DataFrame:
    """Packet defaults: upper-case protocol, unknown ones are OTHER."""
    protocol = F.upper(F.coalesce(F.col("protocol"), F.lit("TCP")))
    defaults = {"src_ip": "0.0.0.0", "dst_ip": "0.0.0.0", "src_port": 0, "dst_port": 0, "ttl": 64,
                "size": 0, "payload": "", "direction": "INBOUND", "interface": "eth0"}
    filled = {n: F.coalesce(F.col(n), F.lit(v)) for n, v in defaults.items() if n in packets.columns}
    missing = {n: F.lit(v) for n, v in defaults.items() if n not in packets.columns}
    return packets.withColumns({**filled, **missing,
                                "protocol": F.when(protocol.isin("TCP", "UDP", "ICMP"), protocol)
                                .otherwise("OTHER")})


def tcp_flag_names(letters) -> Column:
    """Flag letters of a capture to names, always in the order SYN ACK FIN RST PSH URG."""
    text = F.col(letters) if isinstance(letters, str) else letters
    names = ["SYN", "ACK", "FIN", "RST", "PSH", "URG"]
    return F.array_compact(F.array(*[F.when(text.contains(n[0]), n) for n in names]))


def cef_severity(label) -> Column:
    """Number of a severity label, NULL for an unknown one."""
    text = F.upper(F.col(label) if isinstance(label, str) else label)
    table = F.create_map(*[F.lit(v) for row in fixed.CEF_SEVERITY for v in row])
    return F.try_element_at(table, text)
