"""Compliance checks of assets and their services."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from vigil.functions.scoring import asset_status, compliance_grade, posture, risk_score
from vigil.operators import vuln

STRONG_TLS = ["TLS 1.2", "TLS 1.3"]
OBSOLETE_TLS = ["TLS 1.0", "SSLv3", "SSLv2"]


def _check(framework: str, control: str, status: str, risk: str, finding) -> Column:
    text = F.lit(finding) if isinstance(finding, str) else finding
    return F.struct(F.lit(framework).alias("framework"), F.lit(control).alias("control"),
                    F.lit(status).alias("status"), F.lit(risk).alias("risk"), text.alias("finding"))


def _true(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(False))


def _join(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def iso_asset_checks(as_of: Column) -> list[Column]:
    """Checks of an asset configuration in order; a check that does not apply is NULL."""
    tls = F.coalesce(F.col("ssl_version"), F.lit(""))
    industrial, isolated = _true("is_industrial_device"), _true("isolated_segment")
    age = F.date_diff(as_of, F.try_to_date("last_patch_date", "yyyy-MM-dd"))
    days = age.cast("string")
    return [
        F.when(tls.isin(STRONG_TLS), _check("ISO", "A.10.1.1", "PASS", "Low", _join("Strong encryption in use: ", tls)))
        .when(tls == "TLS 1.1", _check("ISO", "A.10.1.1", "WARNING", "Medium", "TLS 1.1 is deprecated and should be disabled."))
        .when(tls.isin(OBSOLETE_TLS), _check("ISO", "A.10.1.1", "FAIL", "Critical", _join(
            "CRITICAL: Obsolete protocol in use: ", tls, ". Vulnerable to POODLE/BEAST.")))
        .when(tls == "", _check("ISO", "A.10.1.1", "FAIL", "High", "No encryption detected on this service.")),
        F.when(_true("default_creds_active"), _check("ISO", "A.9.4.3", "FAIL", "Critical",
               "DEFAULT CREDENTIALS ARE STILL ACTIVE. This is a critical security violation."))
        .otherwise(_check("ISO", "A.9.4.3", "PASS", "Low", "Default credentials have been changed.")),
        F.when(~F.col("mfa_enabled"), _check("ISO", "A.9.4.2", "WARNING", "Medium",
                                             "Multi-factor authentication is not enabled.")),
        F.when(industrial & ~isolated, _check("ISO", "A.13.1.1", "FAIL", "Critical",
               "Industrial/OT device is NOT properly network-segmented from IT network."))
        .when(industrial, _check("ISO", "A.13.1.1", "PASS", "Low",
                                 "Industrial device is properly segmented in isolated network zone.")),
        F.when(age > 90, _check("ISO", "A.12.6.1", "FAIL", "High", _join("System has not been patched in ", days, " days.")))
        .when(age > 30, _check("ISO", "A.12.6.1", "WARNING", "Medium", _join("Last patch applied ", days, " days ago."))),
        F.when(~F.col("logging_enabled"), _check("ISO", "A.12.4.1", "FAIL", "High",
                                                 "Security event logging is disabled on this system.")),
        F.when(F.coalesce("asset_tag", F.lit("")) == "", _check("ISO", "A.8.1.1", "WARNING", "Low",
                                                                "No asset tag/ID assigned to this device.")),
    ]


def iso_service_checks() -> list[Column]:
    protocol, banner = F.col("protocol"), F.coalesce(F.col("banner"), F.lit(""))
    frame = F.coalesce(F.col("x_frame_options"), F.lit(""))
    return [
        F.when((protocol == "SSH") & banner.contains("SSH-1"), _check("ISO", "A.13.2.1", "FAIL", "Critical", _join(
            "SSH Protocol version 1 supported (port ", F.col("port").cast("string"), ")."))),
        F.when(protocol.isin("HTTP", "HTTPS") & frame.isin("", "missing"), _check(
            "ISO", "A.14.1.2", "WARNING", "Medium", "X-Frame-Options header is missing. Vulnerable to clickjacking.")),
        F.when((protocol == "HTTPS") & _true("supports_tls10"), _check(
            "ISO", "A.10.1.1", "FAIL", "High", "Server still supports TLS 1.0. Vulnerable to BEAST/POODLE attacks.")),
    ]


def iec_checks() -> list[Column]:
    tls = F.coalesce(F.col("ssl_version"), F.lit(""))
    industrial, isolated = _true("is_industrial_device"), _true("isolated_segment")
    return [
        F.when(_true("default_creds_active"), _check("IEC", "62443-3-3 SR 1.1", "FAIL", "Critical",
               "Default credentials active on industrial device.")),
        F.when(industrial & ~isolated, _check("IEC", "62443-3-3 SR 5.1", "FAIL", "Critical",
               "Industrial device is NOT isolated in a separate security zone."))
        .when(industrial, _check("IEC", "62443-3-3 SR 5.1", "PASS", "Low", "Device properly segmented per zone/conduit model.")),
        F.when(~tls.isin(STRONG_TLS), _check("IEC", "62443-3-3 SR 4.1", "FAIL", "High", _join(
            "Encryption standard '", tls, "' does not meet IEC 62443 SL-2 requirements."))),
        _check("IEC", "62443-3-3 SR 7.1", "WARNING", "Medium",
               "DoS protection mechanisms should be verified for industrial endpoints."),
    ]


def nist_scores() -> dict[str, Column]:
    """Score per sub-category; logging counts as enabled unless it is said not to be."""
    return {"ID.AM-1": F.when(F.coalesce("asset_tag", F.lit("")) != "", 100).otherwise(60),
            "PR.AC-1": F.when(_true("default_creds_active"), 20).otherwise(100),
            "PR.DS-2": F.when(F.coalesce("ssl_version", F.lit("")).isin(STRONG_TLS), 100).otherwise(30),
            "DE.AE-3": F.when(F.coalesce(F.col("logging_enabled"), F.lit(True)), 100).otherwise(40)}


def _explode(df: DataFrame, checks: list[Column], first: int) -> DataFrame:
    numbered = [F.when(c.isNotNull(), F.struct(F.lit(first + n).alias("seq"), c.alias("c"))) for n, c in enumerate(checks)]
    return (df.select("asset_id", F.explode(F.array_compact(F.array(*numbered))).alias("_x"))
            .select("asset_id", F.col("_x.seq").alias("seq"), "_x.c.*"))


def iso_findings(assets: DataFrame, services: DataFrame | None, as_of: Column) -> DataFrame:
    """One row per ISO check that applies, ``service_id`` 0 for checks of the asset itself."""
    rows = _explode(assets, iso_asset_checks(as_of), 0).withColumn("service_id", F.lit(0).cast("bigint"))
    if services is None:
        return rows
    checks = [F.when(c.isNotNull(), F.struct(F.lit(100 + n).alias("seq"), c.alias("c")))
              for n, c in enumerate(iso_service_checks())]
    per_service = (services.select("asset_id", "service_id", F.explode(F.array_compact(F.array(*checks))).alias("_x"))
                   .select("asset_id", F.col("_x.seq").alias("seq"), "_x.c.*", "service_id"))
    return rows.unionByName(per_service)


def iec_findings(assets: DataFrame) -> DataFrame:
    return _explode(assets, iec_checks(), 1000).withColumn("service_id", F.lit(0).cast("bigint"))


def nist_findings(assets: DataFrame) -> DataFrame:
    """One row per sub-category with score and status."""
    weak = {"ID.AM-1": "WARNING"}
    entries = [F.struct(F.lit(n).alias("subcategory"), s.alias("score"),
                        F.when(s == 100, "PASS").otherwise(weak.get(n, "FAIL")).alias("status"))
               for n, s in nist_scores().items()]
    return assets.select("asset_id", F.explode(F.array(*entries)).alias("_x")).select("asset_id", "_x.*")


def failures(assets: DataFrame, services: DataFrame | None, as_of: Column) -> DataFrame:
    """Failed ISO and IEC checks as one list of texts."""
    both = iso_findings(assets, services, as_of).unionByName(iec_findings(assets))
    text = F.concat(F.lit("["), "framework", F.lit(" "), "control", F.lit("] "), "finding")
    return both.where(F.col("status") == "FAIL").select("asset_id", "seq", "service_id", text.alias("failure"))


def first_failures(failed: DataFrame, n: int = 3) -> DataFrame:
    """First ``n`` failures of every asset in check order; each task keeps only its own ``n``."""
    order = Window.partitionBy("asset_id").orderBy("seq", "service_id")
    return failed.withColumn("position", F.row_number().over(order)).where(F.col("position") <= n)


def summary(findings: DataFrame) -> DataFrame:
    """Checks by status and the share that passed."""
    n = lambda s: F.count_if(F.col("status") == s)
    return (findings.agg(F.count(F.lit(1)).alias("total_checks"), n("PASS").alias("passed"), n("FAIL").alias("failed"),
                         n("WARNING").alias("warnings"))
            .withColumn("compliance_rate", F.coalesce(F.round(F.try_divide(F.col("passed"), F.col("total_checks")) * 100, 1), F.lit(0.0))))


def host_reports(assets: DataFrame, services: DataFrame | None, as_of: Column) -> DataFrame:
    """Pass flags, number of failures and warnings, NIST score and grade per asset.

    Findings are counted before they meet the asset, never collected.  IEC warnings do not count.
    """
    both = iso_findings(assets, services, as_of).unionByName(iec_findings(assets))
    fail = F.col("status") == "FAIL"
    iso = F.col("framework") == "ISO"
    counts = both.groupBy("asset_id").agg(
        F.count_if(fail & iso).alias("_iso"), F.count_if(fail & ~iso).alias("_iec"),
        F.count_if(iso & (F.col("status") == "WARNING")).alias("warnings"))
    scores = list(nist_scores().values())
    nist = F.bround(sum(scores[1:], scores[0]) / F.lit(len(scores)), 0).cast("int")
    return (assets.select("asset_id", nist.alias("nist_csf_score")).join(counts, "asset_id", "left")
            .fillna(0, ["_iso", "_iec", "warnings"])
            .withColumns({"iso_27001_passed": F.col("_iso") == 0, "iec_62443_passed": F.col("_iec") == 0,
                          "failures": F.col("_iso") + F.col("_iec")})
            .withColumn("overall_grade", compliance_grade("failures", "nist_csf_score")).drop("_iso", "_iec"))


def assess_assets(assets: DataFrame, services: DataFrame, as_of: Column) -> DataFrame:
    """Vulnerability counts, compliance, risk score and status, one row per asset."""
    stats = vuln.asset_stats(assets, vuln.asset_cves(assets, services))
    reports = host_reports(assets, services, as_of)
    return (assets.select("asset_id", "hostname", "software").join(stats, "asset_id").join(reports, "asset_id")
            .withColumns({"risk_score": risk_score("max_cvss", "total_vulns", "exploit_count", "iso_27001_passed", "iec_62443_passed"),
                          "status": asset_status("max_cvss", "critical_count", "iso_27001_passed", "warnings")}))


def executive_summary(assessed: DataFrame) -> DataFrame:
    """Totals over all assets."""
    return (assessed.agg(
        F.count(F.lit(1)).alias("targets_scanned"), F.sum("total_vulns").alias("total_vulnerabilities"),
        F.sum("critical_count").alias("critical_vulnerabilities"), F.sum("exploit_count").alias("exploitable_vulnerabilities"),
        F.coalesce(F.max("max_cvss"), F.lit(0.0)).alias("max_cvss_score"),
        F.bround(F.count_if("iso_27001_passed") * 100.0 / F.count(F.lit(1)), 0).cast("int").alias("iso_compliance_rate"),
        F.count_if(F.col("status").isin("critical", "vulnerable")).alias("assets_at_risk"))
        .withColumn("overall_posture", posture("max_cvss_score")))
