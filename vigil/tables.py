"""Dimension tables built from the fixed values, and a bounded broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from vigil import fixed

# A dimension passed in by the user is broadcast only up to this many rows.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 << 20

_TYPES = {"s": T.StringType(), "i": T.IntegerType(), "l": T.LongType(), "d": T.DoubleType(),
          "b": T.BooleanType(), "as": T.ArrayType(T.StringType()), "ai": T.ArrayType(T.IntegerType())}


def literal(value) -> str:
    """SQL text of one Python value (numbers, booleans, strings, lists of these)."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (list, tuple)):
        return "array(" + ", ".join(literal(v) for v in value) + ")"
    if isinstance(value, float):
        return f"CAST({value!r} AS DOUBLE)"
    if isinstance(value, int):
        return str(value)
    return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


def dimension(spark: SparkSession, columns: str, rows, numbered: bool = False) -> DataFrame:
    """A table of constants; ``columns`` reads ``"name:type name:type"``.

    Types are ``s i l d b as ai``.  ``numbered`` adds ``seq``, the position of the row.  The
    rows become a local relation, so the optimizer knows their exact size.
    """
    fields = [c.split(":") for c in columns.split()]
    if numbered:
        fields = fields + [["seq", "i"]]
        rows = [tuple(r) + (n,) for n, r in enumerate(rows)]
    body = ", ".join("(" + ", ".join(literal(v) for v in row) + ")" for row in rows)
    names = ", ".join(f"`{name}`" for name, _ in fields)
    table = spark.sql(f"SELECT * FROM VALUES {body} AS t({names})")
    return table.select([F.col(name).cast(_TYPES[kind]).alias(name) for name, kind in fields])


def bounded_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Mark ``df`` for broadcast when it is shown to hold at most ``max_rows`` rows and ``max_bytes`` bytes.

    A larger table is returned unchanged and joins by shuffle.
    """
    size = F.sum(F.octet_length(F.to_json(F.struct(*df.columns))))
    rows, held = df.limit(max_rows + 1).agg(F.count(F.lit(1)), F.coalesce(size, F.lit(0))).first()
    return F.broadcast(df) if rows <= max_rows and held <= max_bytes else df


def threat_ips(spark):
    return dimension(spark, "ip:s threat_score:i threat_type:s country:s region:s isp:s actor:s "
                            "first_seen:s last_seen:s tags:as references:as", fixed.THREAT_IPS)


def geo_ips(spark):
    return dimension(spark, "ip:s country:s region:s isp:s", fixed.GEO_IPS)


def threat_domains(spark):
    return dimension(spark, "domain:s threat_score:i threat_type:s actor:s",
                     fixed.THREAT_DOMAINS, numbered=True)


def mitre(spark):
    return dimension(spark, "attack_type:s tactic:s technique:s name:s", fixed.MITRE)


def windows_events(spark):
    return dimension(spark, "windows_event_id:l event_type:s action:s severity:i text:s",
                     fixed.WINDOWS_EVENTS)


def zones(spark):
    """One row per zone network."""
    rows = [(name, trust, cidr) for name, trust, cidrs in fixed.ZONES for cidr in cidrs]
    return dimension(spark, "zone:s trust:i cidr:s", rows)


def zone_policies(spark):
    return dimension(spark, "src_zone:s dst_zone:s default_action:s", fixed.ZONE_POLICIES)


def firewall_rules(spark):
    rows = [r[:10] + ([],) + r[10:12] + (r[12], True) for r in fixed.FIREWALL_RULES]
    table = dimension(spark, "rule_id:i name:s priority:i action:s protocol:s src_ip:s dst_ip:s "
                             "src_port:i dst_port:i direction:s tcp_flags:as zone_src:s zone_dst:s "
                             "log:b enabled:b", rows, numbered=True)
    return table


def signatures(spark):
    return dimension(spark, "sid:i name:s pattern:s protocol:s dst_port:ai severity:s action:s "
                            "category:s mitre:s", fixed.SIGNATURES, numbered=True)


def contents(spark):
    return dimension(spark, "id:i action:s protocol:s content:s msg:s", fixed.CONTENT_SIGNATURES)


def cves(spark):
    return dimension(spark, "software:s cve_id:s cvss:d severity:s description:s "
                            "affected_versions:as fixed_version:s exploit_available:b published:s",
                     fixed.CVES, numbered=True)


def local_cves(spark):
    return dimension(spark, "cve_id:s service:s vulnerable_versions:as cvss_score:d severity:s "
                            "remediation:s", fixed.LOCAL_CVES, numbered=True)


def default_credentials(spark):
    return dimension(spark, "service:s username:s password:s", fixed.DEFAULT_CREDENTIALS)


def well_known_ports(spark):
    return dimension(spark, "port:i service:s description:s", fixed.WELL_KNOWN_PORTS)


def ot_ports(spark):
    return dimension(spark, "port:i ot_protocol:s", fixed.OT_PORTS)


def port_warnings(spark):
    return dimension(spark, "port:i message:s", fixed.PORT_WARNINGS)


def report_risks(spark):
    return dimension(spark, "port:i severity:s message:s", fixed.REPORT_RISKS)


def registers(spark):
    return dimension(spark, "address:i name:s unit:s default_value:l min_value:l max_value:l "
                            "readonly:b", fixed.REGISTERS)


def alarms(spark):
    return dimension(spark, "alarm:s address:i limit_value:l severity:s unit:s", fixed.ALARMS)
