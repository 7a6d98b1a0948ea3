"""Look-ups that add reputation, names and techniques to rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from vigil import fixed, tables
from vigil.operators.netjoin import in_networks
from vigil.tables import bounded_broadcast


def ip_reputation(df: DataFrame, ip: str = "src_ip", threats: DataFrame | None = None,
                  geo: DataFrame | None = None) -> DataFrame:
    """Add threat score, type, place, actor, tags and ``safe`` of an address."""
    spark = df.sparkSession
    threats = tables.threat_ips(spark) if threats is None else threats
    geo = tables.geo_ips(spark) if geo is None else geo
    t = bounded_broadcast(threats.select(F.struct("*").alias("_t")))
    g = bounded_broadcast(geo.select(F.struct("*").alias("_g")))
    out = (df.join(t, F.col(ip) == F.col("_t.ip"), "left").join(g, F.col(ip) == F.col("_g.ip"), "left"))
    none = F.array().cast("array<string>")
    return out.withColumns({
        "safe": F.col("_t").isNull(),
        "threat_score": F.coalesce("_t.threat_score", F.lit(0)),
        "threat_type": F.coalesce("_t.threat_type", F.lit("clean")),
        "country": F.coalesce("_t.country", "_g.country", F.lit("UNKNOWN")),
        "region": F.coalesce("_t.region", "_g.region", F.lit("Unknown")),
        "isp": F.coalesce("_t.isp", "_g.isp", F.lit("Unknown")),
        "actor": F.coalesce("_t.actor", F.lit("")),
        "tags": F.coalesce("_t.tags", none),
        "references": F.coalesce("_t.references", none),
        "first_seen": F.coalesce("_t.first_seen", F.lit("")),
        "last_seen": F.coalesce("_t.last_seen", F.lit("")),
    }).drop("_t", "_g")


def threat_networks(df: DataFrame, src: str = "src_ip", dst: str = "dst_ip",
                    networks: DataFrame | None = None) -> DataFrame:
    """Add ``threat_detected`` and ``threat_ip``: the source if listed, else a listed destination."""
    if networks is None:
        networks = tables.dimension(df.sparkSession, "cidr:s", [(c,) for c in fixed.THREAT_NETWORKS])
    out = in_networks(df, src, networks, "_src_hit")
    out = in_networks(out, dst, networks, "_dst_hit")
    hit = F.when(F.col("_src_hit"), F.col(src)).when(F.col("_dst_hit"), F.col(dst))
    return (out.withColumns({"threat_detected": F.col("_src_hit") | F.col("_dst_hit"), "threat_ip": hit,
                             "threat_text": F.when(F.col("_src_hit") | F.col("_dst_hit"),
                                                   "Known malicious IP address")})
            .drop("_src_hit", "_dst_hit"))


def domain_reputation(df: DataFrame, domain: str = "domain") -> DataFrame:
    """Add ``domain_safe``, score, type and actor: listed name, then suspicious ending, then clean."""
    text = F.col(domain)
    tld = reduce(lambda a, b: a | b, [text.endswith(t) for t in fixed.REPUTATION_TLDS])

    def ladder(position, at_tld, clean):
        column = None
        for row in fixed.THREAT_DOMAINS:
            test = text.contains(row[0])
            column = F.when(test, row[position]) if column is None else column.when(test, row[position])
        return column.when(tld, at_tld).otherwise(clean)

    score = ladder(1, fixed.REPUTATION_TLD_SCORE, 0)
    return df.withColumns({"domain_safe": F.coalesce(score == 0, F.lit(True)), "domain_score": score,
                           "domain_type": ladder(2, "suspicious_tld", "clean"),
                           "domain_actor": ladder(3, "Unknown", "")})


def clean_domain(name):
    """Lower case, no outer blanks, no leading ``www.``."""
    text = F.trim(F.lower(F.col(name) if isinstance(name, str) else name))
    return F.regexp_replace(text, r"^www\.", "")


def blocked_domain(df: DataFrame, domain: str = "domain") -> DataFrame:
    """Add ``domain_blocked``: the cleaned name contains a blocked one."""
    test = reduce(lambda a, b: a | b, [F.col("_name").contains(d) for d in fixed.BLOCKED_DOMAINS])
    return (df.withColumn("_name", clean_domain(domain))
            .withColumn("domain_blocked", F.coalesce(test, F.lit(False))).drop("_name"))


def with_mitre(df: DataFrame, attack_type: str = "attack_type") -> DataFrame:
    """Add tactic, technique and technique name; NULL for an unmapped attack type."""
    names = tables.mitre(df.sparkSession).select(
        F.col("attack_type").alias("_attack"), F.col("tactic").alias("mitre_tactic"),
        F.col("technique").alias("mitre_technique"), F.col("name").alias("mitre_name"))
    return df.join(F.broadcast(names), F.col(attack_type) == F.col("_attack"), "left").drop("_attack")


def port_service(df: DataFrame, port: str = "port") -> DataFrame:
    """Add ``service_name`` and ``service_text`` of a port, Unknown when it is not listed."""
    known = tables.well_known_ports(df.sparkSession).select(
        F.col("port").alias("_port"), F.col("service").alias("_s"), F.col("description").alias("_d"))
    unknown = F.concat(F.lit("Unknown service on port "), F.col(port).cast("string"))
    return (df.join(F.broadcast(known), F.col(port) == F.col("_port"), "left")
            .withColumns({"service_name": F.coalesce("_s", F.lit("Unknown")),
                          "service_text": F.coalesce("_d", unknown)}).drop("_port", "_s", "_d"))


def ot_protocol(df: DataFrame, port: str = "port") -> DataFrame:
    """Add ``is_ot_port`` and ``ot_protocol`` ('' when it is no industrial port)."""
    listed = tables.ot_ports(df.sparkSession).select(
        F.col("port").alias("_port"), F.col("ot_protocol").alias("_o"))
    return (df.join(F.broadcast(listed), F.col(port) == F.col("_port"), "left")
            .withColumns({"is_ot_port": F.col("_o").isNotNull(),
                          "ot_protocol": F.coalesce("_o", F.lit(""))}).drop("_port", "_o"))


def port_findings(ports: DataFrame) -> DataFrame:
    """Findings of open ports: scan warnings, industrial ports and report risks.

    Input ``host, port``; output ``host, port, kind, severity, message``.
    """
    spark = ports.sparkSession
    base = ports.select("host", "port")
    warnings = base.join(F.broadcast(tables.port_warnings(spark)), "port").select(
        "host", "port", F.lit("warning").alias("kind"), F.lit("WARNING").alias("severity"), "message")
    industrial = base.join(F.broadcast(tables.ot_ports(spark)), "port").select(
        "host", "port", F.lit("ot_port").alias("kind"), F.lit("CRITICAL").alias("severity"),
        F.concat(F.lit("OT/ICS Port "), F.col("port").cast("string"), F.lit(" ("), "ot_protocol",
                 F.lit(") is accessible!")).alias("message"))
    risks = base.join(F.broadcast(tables.report_risks(spark)), "port").select(
        "host", "port", F.lit("report").alias("kind"), "severity", "message")
    return warnings.unionByName(industrial).unionByName(risks)


def default_credentials(services: DataFrame, service: str = "service") -> DataFrame:
    """Known default accounts of each service type (exposure listing)."""
    known = tables.default_credentials(services.sparkSession).withColumnRenamed("service", "_service")
    return services.join(F.broadcast(known), F.col(service) == F.col("_service")).drop("_service")


def lookup_stats(df: DataFrame, ip: str = "src_ip") -> DataFrame:
    """Reputation look-ups, distinct addresses, repeated look-ups and listed addresses seen."""
    per_ip = ip_reputation(df.groupBy(ip).agg(F.count(F.lit(1)).alias("_n")), ip)
    return per_ip.agg(F.sum("_n").alias("total_lookups"), F.count(F.lit(1)).alias("cache_size"),
                      (F.sum("_n") - F.count(F.lit(1))).alias("cache_hits"),
                      F.count_if(~F.col("safe")).alias("listed_ips"))


def intel_counters(df: DataFrame, domain: str = "domain") -> DataFrame:
    """Addresses checked, rows with a threat and rows with a blocked domain."""
    out = blocked_domain(threat_networks(df), domain)
    src_clean = ~F.col("threat_detected") | (F.col("threat_ip") != F.col("src_ip"))
    return out.agg((F.count(F.lit(1)) + F.count_if(src_clean)).alias("ips_checked"),
                   F.count_if("threat_detected").alias("threats_detected"),
                   F.count_if("domain_blocked").alias("domain_threats"))
