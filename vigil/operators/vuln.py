"""Known vulnerabilities of software, services and assets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from vigil import tables
from vigil.functions.scoring import cvss_severity
from vigil.tables import bounded_broadcast


def _product(text: Column) -> tuple[Column, Column]:
    """(product, version) of a text like ``OpenSSH 7.2p2``; two products have names of two words."""
    t = F.trim(text)
    first = F.split_part(t, F.lit(" "), F.lit(1))
    rest = F.substring(t, F.length(first) + 2, F.length(t))
    windows, tomcat = t.startswith("Windows Server"), t.startswith("Apache Tomcat")
    bare = lambda s, word: F.replace(s, F.lit(word), F.lit(""))
    name = F.when(windows, "Windows Server").when(tomcat, "Apache Tomcat").otherwise(first)
    version = (F.when(windows, bare(t, "Windows Server "))
               .when(tomcat, bare(bare(t, "Apache Tomcat/"), "Apache Tomcat ")).otherwise(rest))
    return F.when(t.contains(" "), name), version


def _affected(version: Column, listed: Column, strict: bool) -> Column:
    """A listed version equals the version or its base, or begins it.

    ``strict`` lets a listed version begin another only where a new part begins: 7.1 covers 7.1p2
    and 7.1.3 but not 7.10.
    """
    base = F.split_part(F.split_part(version, F.lit("p"), F.lit(1)), F.lit("-"), F.lit(1))

    def test(v: Column) -> Column:
        begins = version.startswith(v)
        if strict:
            begins = begins & ~F.substring(version, F.length(v) + 1, F.lit(1)).rlike(r"^\d")
        return (v == version) | (v == base) | begins

    return F.exists(listed, test)


def software_cves(texts: DataFrame, column: str = "software", cves: DataFrame | None = None,
                  strict: bool = False) -> DataFrame:
    """One row per distinct software text and vulnerability that affects it.

    Texts repeat far more often than they differ, so they are reduced to the distinct ones before
    the versions are compared.
    """
    cves = tables.cves(texts.sparkSession) if cves is None else cves
    name, version = _product(F.col(column))
    distinct = (texts.select(column).where(F.col(column).isNotNull()).distinct()
                .withColumns({"_name": name, "_version": version}).where("_name IS NOT NULL"))
    hit = (F.col("_name") == F.col("_product")) & _affected(F.col("_version"), F.col("affected_versions"), strict)
    side = bounded_broadcast(cves.withColumnRenamed("software", "_product"))
    return distinct.join(side, hit).drop("_name", "_version", "_product")


def service_text(service: str = "service", version: str = "version") -> Column:
    return F.trim(F.concat_ws(" ", F.trim(F.coalesce(F.col(service), F.lit(""))),
                              F.trim(F.coalesce(F.col(version), F.lit("")))))


def local_cves(services: DataFrame, cves: DataFrame | None = None) -> DataFrame:
    """Vulnerabilities of the local list: same service in any case, a listed version inside the version."""
    cves = tables.local_cves(services.sparkSession) if cves is None else cves
    side = bounded_broadcast(cves.select(F.lower("service").alias("_service"), "cve_id", "vulnerable_versions",
                                         "cvss_score", F.col("severity").alias("cve_severity"), "remediation"))
    given = services.where((F.coalesce("service", F.lit("")) != "") & (F.coalesce("version", F.lit("")) != ""))
    version = F.col("version")
    return (given.join(side, (F.lower("service") == F.col("_service"))
                       & F.exists("vulnerable_versions", lambda v: version.contains(v)))
            .drop("_service", "vulnerable_versions"))


def _list_per_text(hits: DataFrame, column: str) -> DataFrame:
    """Vulnerabilities of each distinct text as an array (bounded by the catalogue) with counts."""
    level = lambda low, high: F.count_if((F.col("cvss") >= low) & (F.col("cvss") < high))
    return hits.groupBy(column).agg(
        F.sort_array(F.collect_list(F.struct("seq", "cve_id", "cvss", "severity", "description", "exploit_available")))
        .alias("cves"),
        F.count(F.lit(1)).alias("total"), level(9.0, 99.0).alias("critical"), level(7.0, 9.0).alias("high"),
        level(4.0, 7.0).alias("medium"), level(-1.0, 4.0).alias("low"))


def enrich_services(services: DataFrame) -> DataFrame:
    """Add the array ``cves`` and its counts by level; unnamed services get an empty array."""
    named = services.withColumn("_text", F.when(~F.trim(F.coalesce("service", F.lit(""))).isin("", "Unknown"),
                                                service_text()))
    found = _list_per_text(software_cves(named, "_text"), "_text")
    kinds = found.schema["cves"].dataType
    out = named.join(found, "_text", "left").drop("_text")
    return (out.withColumn("cves", F.coalesce("cves", F.array().cast(kinds)))
            .fillna(0, ["total", "critical", "high", "medium", "low"]))


def highlights(enriched: DataFrame, n: int | None = None) -> DataFrame:
    """Vulnerabilities of all services, worst first; long descriptions are cut at 100 characters."""
    text = F.col("_c.description")
    rows = (enriched.withColumn("_c", F.explode("cves"))
            .select("service_id", "host", "port", "service", "_c.cve_id", "_c.cvss", "_c.severity",
                    F.when(F.length(text) > 100, F.concat(F.substring(text, 1, 100), F.lit("..."))).otherwise(text)
                    .alias("description"), "_c.exploit_available"))
    ordered = rows.orderBy(F.desc("cvss"), "service_id", "cve_id")
    return ordered if n is None else ordered.limit(n)


def asset_cves(assets: DataFrame, services: DataFrame) -> DataFrame:
    """Distinct vulnerabilities per asset: of its own software and of services with another text."""
    own = assets.select("asset_id", "software")
    named = services.select("asset_id", F.concat_ws(" ", "service", "version").alias("_text"))
    other = (named.join(own, "asset_id").where(F.col("_text") != F.col("software"))
             .select("asset_id", F.col("_text").alias("software")))
    # pairs repeat: reduce them before the join with the catalogue
    pairs = own.unionByName(other).distinct()
    hits = software_cves(pairs).select("software", "cve_id", "cvss", "severity", "exploit_available")
    return (pairs.join(hits, "software").groupBy("asset_id", "cve_id")
            .agg(F.max("cvss").alias("cvss"), F.first("severity").alias("severity"),
                 F.bool_or("exploit_available").alias("exploit_available")))


def asset_stats(assets: DataFrame, found: DataFrame) -> DataFrame:
    """Worst score and counts per asset; zeros without a vulnerability."""
    c = F.col("cvss")
    stats = found.groupBy("asset_id").agg(
        F.max("cvss").alias("max_cvss"), F.count(F.lit(1)).alias("total_vulns"), F.count_if(c >= 9.0).alias("critical_count"),
        F.count_if((c >= 7.0) & (c < 9.0)).alias("high_count"), F.count_if("exploit_available").alias("exploit_count"))
    return (assets.select("asset_id").join(stats, "asset_id", "left")
            .fillna(0.0, ["max_cvss"]).fillna(0, ["total_vulns", "critical_count", "high_count", "exploit_count"]))


def catalogue_stats(texts: DataFrame, column: str = "software") -> DataFrame:
    """Size of the catalogue, texts looked up and vulnerabilities found over all rows."""
    spark = texts.sparkSession
    per_text = software_cves(texts, column).groupBy(column).agg(F.count(F.lit(1)).alias("_hits"))
    counted = texts.groupBy(column).agg(F.count(F.lit(1)).alias("_rows"))
    found = (counted.join(per_text, column, "left")
             .agg(F.sum("_rows").alias("total_lookups"),
                  F.coalesce(F.sum(F.col("_rows") * F.col("_hits")), F.lit(0)).alias("total_vulns_found")))
    catalogue = tables.cves(spark)
    return found.withColumns({"db_entries": catalogue.agg(F.count(F.lit(1)).alias("n")).scalar(),
                              "software_tracked": catalogue.agg(F.count_distinct("software").alias("n")).scalar()})


def host_rollup(services: DataFrame, enriched: DataFrame, findings: DataFrame) -> DataFrame:
    """Vulnerabilities, critical ones and findings per host, with the total of all hosts as ``*``."""
    cves = enriched.groupBy("host").agg(F.sum("total").alias("cves"), F.sum("critical").alias("critical"))
    notes = findings.groupBy("host").agg(F.count(F.lit(1)).alias("findings"))
    hosts = services.select("host").distinct().join(cves, "host", "left").join(notes, "host", "left").fillna(0)
    return (hosts.rollup("host").agg(F.sum("cves").alias("cves"), F.sum("critical").alias("critical"),
                                     F.sum("findings").alias("findings"), F.count(F.lit(1)).alias("hosts"))
            .withColumn("host", F.coalesce("host", F.lit("*"))))


def port_counts(services: DataFrame) -> DataFrame:
    """Open, closed and filtered ports per host."""
    n = lambda s: F.count_if(F.col("state") == s)
    return services.groupBy("host").agg(F.count(F.lit(1)).alias("ports_scanned"), n("open").alias("open_count"),
                                        n("closed").alias("closed_count"), n("filtered").alias("filtered_count"))


def severity_of(found: DataFrame) -> DataFrame:
    return found.withColumn("level", cvss_severity("cvss"))
