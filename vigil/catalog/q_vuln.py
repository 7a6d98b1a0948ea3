"""Vulnerability, banner and compliance queries."""

from pyspark.sql import functions as F

from vigil import fixed
from vigil.catalog.registry import query, quote, rows
from vigil.functions import scoring as X
from vigil.functions import text as T
from vigil.operators import compliance as C
from vigil.operators import enrich as E
from vigil.operators import vuln as V

AS_OF = "2026-07-01"
CVES = rows([r + (n,) for n, r in enumerate(fixed.CVES)])
_CVE = f"(VALUES {CVES}) c(software, cve_id, cvss, severity, description, affected, fixed_version, exploit, published, seq)"


def cve_join(source, column):
    """Distinct text -> vulnerabilities."""
    return f"""SELECT t.txt, c.* FROM (SELECT txt, CASE WHEN starts_with(txt, 'Windows Server') THEN 'Windows Server' WHEN starts_with(txt, 'Apache Tomcat') THEN 'Apache Tomcat' ELSE split_part(txt, ' ', 1) END AS product,
   CASE WHEN starts_with(txt, 'Windows Server') THEN replace(txt, 'Windows Server ', '') WHEN starts_with(txt, 'Apache Tomcat') THEN replace(replace(txt, 'Apache Tomcat/', ''), 'Apache Tomcat ', '')
    ELSE substr(txt, strpos(txt, ' ') + 1) END AS version FROM (SELECT DISTINCT trim({column}) AS txt FROM {source}) d WHERE contains(txt, ' ')) t
  JOIN {_CVE} ON c.software = t.product AND len(list_filter(c.affected, lambda v: v = t.version OR v = split_part(split_part(t.version, 'p', 1), '-', 1) OR starts_with(t.version, v))) > 0"""


@query("d12_software_cves", f"SELECT a.asset_id, a.software, h.cve_id, h.cvss, h.severity FROM @assets a JOIN ({cve_join('@assets', 'software')}) h ON h.txt = a.software")
def _(view):
    a = view("assets")
    return a.select("asset_id", "software").join(V.software_cves(a).select("software", "cve_id", "cvss", "severity"), "software")


_LOCAL = f"(VALUES {rows(fixed.LOCAL_CVES)}) c(cve_id, service, versions, score, severity, remediation)"


@query("d13_local_cves", f"""SELECT s.service_id, c.cve_id, c.score AS cvss_score, c.severity AS cve_severity, c.remediation FROM @services s JOIN {_LOCAL} ON lower(c.service) = lower(s.service)
 AND s.version <> '' AND len(list_filter(c.versions, lambda v: contains(s.version, v))) > 0""")
def _(view):
    return V.local_cves(view("services")).select("service_id", "cve_id", "cvss_score", "cve_severity", "remediation")


_ST = "trim(trim(service) || ' ' || trim(version))"
_ENRICHED = f"""hits AS ({cve_join("(SELECT " + _ST + " AS st FROM @services WHERE service NOT IN ('', 'Unknown')) g", 'st')}),
 enriched AS (SELECT s.*, coalesce(h.ids, '') AS cve_ids, coalesce(h.total, 0) AS total, coalesce(h.critical, 0) AS critical, coalesce(h.high, 0) AS high, coalesce(h.medium, 0) AS medium, coalesce(h.low, 0) AS low FROM @services s LEFT JOIN (
  SELECT txt, string_agg(cve_id, ',' ORDER BY seq) AS ids, count(*) AS total, count(*) FILTER (WHERE cvss >= 9) AS critical, count(*) FILTER (WHERE cvss >= 7 AND cvss < 9) AS high,
   count(*) FILTER (WHERE cvss >= 4 AND cvss < 7) AS medium, count(*) FILTER (WHERE cvss < 4) AS low FROM hits GROUP BY 1) h ON h.txt = {_ST} AND s.service NOT IN ('', 'Unknown'))"""


@query("d14_services_with_cves", f"WITH {_ENRICHED} SELECT service_id, service, version, cve_ids FROM enriched")
def _(view):
    return V.enrich_services(view("services")).select("service_id", "service", "version", F.array_join(F.col("cves.cve_id"), ",").alias("cve_ids"))


@query("e10_cve_summary", f"WITH {_ENRICHED} SELECT service_id, total, critical, high, medium, low FROM enriched")
def _(view):
    return V.enrich_services(view("services")).select("service_id", "total", "critical", "high", "medium", "low")


@query("s3_highlights", f"""WITH {_ENRICHED} SELECT service_id, host, port, service, h.cve_id, h.cvss, h.severity, CASE WHEN length(h.description) > 100 THEN substr(h.description, 1, 100) || '...' ELSE h.description END AS description, h.exploit AS exploit_available
 FROM @services s JOIN hits h ON h.txt = {_ST} AND s.service NOT IN ('', 'Unknown') ORDER BY h.cvss DESC, service_id, h.cve_id""")
def _(view):
    return V.highlights(V.enrich_services(view("services")))


_ASSET = f"""texts AS (SELECT asset_id, software AS txt FROM @assets UNION SELECT s.asset_id, s.service || ' ' || s.version FROM @services s JOIN @assets a ON a.asset_id = s.asset_id WHERE s.service || ' ' || s.version <> a.software),
 hits AS ({cve_join('texts', 'txt')}), found AS (SELECT DISTINCT t.asset_id, h.cve_id, h.cvss, h.severity, h.exploit FROM texts t JOIN hits h ON h.txt = trim(t.txt)),
 stats AS (SELECT a.asset_id, coalesce(max(cvss), 0)::DOUBLE AS max_cvss, count(cve_id) AS total_vulns, count(*) FILTER (WHERE cvss >= 9) AS critical_count, count(*) FILTER (WHERE cvss >= 7 AND cvss < 9) AS high_count,
  count(*) FILTER (WHERE exploit) AS exploit_count FROM @assets a LEFT JOIN found f ON f.asset_id = a.asset_id GROUP BY 1)"""


@query("d15_asset_cves", f"WITH {_ASSET} SELECT asset_id, cve_id, cvss, severity, exploit AS exploit_available FROM found")
def _(view):
    return V.asset_cves(view("assets"), view("services"))


@query("u1_distinct_cves", f"WITH {_ASSET} SELECT cve_id, count(*) AS assets, max(cvss) AS cvss FROM found GROUP BY 1")
def _(view):
    return V.asset_cves(view("assets"), view("services")).groupBy("cve_id").agg(F.count(F.lit(1)).alias("assets"), F.max("cvss").alias("cvss"))


@query("e11_asset_stats", f"WITH {_ASSET} SELECT * FROM stats")
def _(view):
    return V.asset_stats(view("assets"), V.asset_cves(view("assets"), view("services")))


@query("x4_cvss_severity", f"WITH {_ASSET} SELECT asset_id, cve_id, CASE WHEN cvss >= 9 THEN 'Critical' WHEN cvss >= 7 THEN 'High' WHEN cvss >= 4 THEN 'Medium' WHEN cvss > 0 THEN 'Low' ELSE 'Info' END AS level FROM found")
def _(view):
    return V.severity_of(V.asset_cves(view("assets"), view("services"))).select("asset_id", "cve_id", "level")


@query("e25_catalogue_stats", f"""SELECT count(DISTINCT a.asset_id) AS total_lookups, count(h.cve_id) AS total_vulns_found, CAST({len(fixed.CVES)} AS BIGINT) AS db_entries, CAST({len({c[0] for c in fixed.CVES})} AS BIGINT) AS software_tracked
 FROM @assets a LEFT JOIN ({cve_join('@assets', 'software')}) h ON h.txt = a.software""")
def _(view):
    return V.catalogue_stats(view("assets"))


@query("e9_port_counts", """SELECT host, count(*) AS ports_scanned, count(*) FILTER (WHERE state = 'open') AS open_count, count(*) FILTER (WHERE state = 'closed') AS closed_count, count(*) FILTER (WHERE state = 'filtered') AS filtered_count FROM @services GROUP BY 1""")
def _(view):
    return V.port_counts(view("services"))


_PORTS = f"""findings AS (SELECT host FROM @services s JOIN (VALUES {rows(fixed.PORT_WARNINGS)}) w(p, m) ON p = s.port WHERE state = 'open' UNION ALL SELECT host FROM @services s JOIN (VALUES {rows(fixed.OT_PORTS)}) w(p, m) ON p = s.port WHERE state = 'open'
 UNION ALL SELECT host FROM @services s JOIN (VALUES {rows(fixed.REPORT_RISKS)}) w(p, s2, m) ON p = s.port WHERE state = 'open')"""


@query("e22_host_rollup", f"""WITH {_ENRICHED}, {_PORTS}, per AS (SELECT e.host, sum(total) AS cves, sum(critical) AS critical, any_value(coalesce(f.n, 0)) AS findings FROM enriched e LEFT JOIN (SELECT host, count(*) AS n FROM findings GROUP BY 1) f ON f.host = e.host GROUP BY 1)
 SELECT coalesce(host, '*') AS host, CAST(sum(cves) AS BIGINT) AS cves, CAST(sum(critical) AS BIGINT) AS critical, CAST(sum(findings) AS BIGINT) AS findings, count(*) AS hosts FROM per GROUP BY ROLLUP (host)""")
def _(view):
    s = view("services")
    return V.host_rollup(s, V.enrich_services(s), E.port_findings(s.where(F.col("state") == "open")))


# ------------------------------------------------------------------ banners

@query("x9_banner_version", r"""SELECT service_id, coalesce(nullif(regexp_extract(banner, '(\d+\.\d+\.\d+[a-zA-Z]?\d*)', 1), ''), nullif(regexp_extract(banner, '(\d+\.\d+)', 1), ''), nullif(regexp_extract(banner, '(?i)version\s+(\S+)', 1), '')) AS found FROM @services""")
def _(view):
    return view("services").select("service_id", T.banner_version("banner").alias("found"))


_SRV = r"trim(regexp_extract(banner, '(?im)Server:\s*(.+?)(?:\r?\n|$)', 1))"
_REST = r"regexp_extract(banner, 'SSH-[\d.]+-([^\r\n]*)', 1)"
_SSH = r"regexp_matches(banner, 'SSH-[\d.]+-[\w.]+')"
_HTTP = r"regexp_matches(banner, '(?i)Server:\s*\S')"


@query("x10_parse_banner", rf"""SELECT service_id, CASE WHEN {_SSH} THEN regexp_extract({_REST}, '^([\w.]+?)(?:_|\s|$)', 1) WHEN {_HTTP} THEN {_SRV} WHEN regexp_matches(banner, '220[- ].') AND port = 21 THEN 'FTP'
 WHEN regexp_matches(banner, '220[- ].') AND port IN (25, 465, 587) THEN 'SMTP' WHEN port = 3306 AND banner <> '' THEN (CASE WHEN regexp_matches(banner, '[\d.]+') THEN 'MySQL' ELSE '' END) ELSE substr(trim(split_part(banner, chr(10), 1)), 1, 100) END AS service,
 CASE WHEN {_SSH} THEN (CASE WHEN contains({_REST}, '_') THEN regexp_extract({_REST}, '_([\d.p]+)', 1) ELSE '' END) WHEN {_HTTP} THEN (CASE WHEN contains({_SRV}, 'Apache') THEN regexp_extract({_SRV}, 'Apache/([\d.]+)', 1)
  WHEN contains({_SRV}, 'nginx') THEN regexp_extract({_SRV}, 'nginx/([\d.]+)', 1) WHEN contains({_SRV}, 'IIS') THEN regexp_extract({_SRV}, 'IIS/([\d.]+)', 1) ELSE '' END)
  WHEN regexp_matches(banner, '220[- ].') AND port IN (21, 25, 465, 587) THEN trim(regexp_extract(banner, '220[- ](.+)', 1)) WHEN port = 3306 THEN regexp_extract(banner, '([\d.]+)', 1) ELSE '' END AS version,
 CASE WHEN {_SSH} THEN (CASE WHEN contains({_REST}, 'Ubuntu') THEN 'Linux (Ubuntu)' WHEN contains({_REST}, 'Debian') THEN 'Linux (Debian)' ELSE '' END) WHEN {_HTTP} THEN (CASE WHEN contains({_SRV}, 'Apache') THEN (CASE WHEN contains({_SRV}, 'Unix') OR contains({_SRV}, 'Ubuntu') THEN 'Linux' ELSE '' END)
  WHEN contains({_SRV}, 'nginx') THEN '' WHEN contains({_SRV}, 'IIS') THEN 'Windows Server' ELSE '' END) ELSE '' END AS os_hint FROM @services""")
def _(view):
    return view("services").select("service_id", T.parse_banner("banner", "port").alias("p")).select("service_id", "p.*")


def _any(text, words):
    return "(" + " OR ".join(f"contains({text}, {quote(w)})" for w in words) + ")"


def os_sql():
    """The same table as SQL over s (service), b (banner and text), v (version) and port; there is no description."""
    of = {"service": "s", "banner": "b", "text": "b", "version": "v"}

    def hit(marks):
        tests = [f"port IN ({', '.join(map(str, found))})" if kind == "port" else f"s IN ({', '.join(map(quote, found))})" if kind == "named" else _any(of[kind], found)
                 for kind, found in marks.items() if kind != "description"]
        return "(" + " OR ".join(tests) + ")"
    return "CASE " + " ".join(f"WHEN {' AND '.join(map(hit, row))} THEN {quote(answer)}" for answer, *row in fixed.OS_MARKS) + " ELSE '' END"


@query("x11_os_guess", f"SELECT service_id, {os_sql()} AS os FROM (SELECT service_id, port, lower(service) AS s, lower(banner) || ' ' AS b, lower(version) AS v FROM @services) g")
def _(view):
    return view("services").select("service_id", T.os_guess("service", "banner", F.lit(""), "version", "port").alias("os"))


_TLSV = "CASE " + " ".join(f"WHEN contains(tls_info, 'TLSv1.{n}') OR contains(tls_info, 'TLS 1.{n}') THEN 'TLS 1.{n}'" for n in range(4)) + " WHEN contains(tls_info, 'SSLv3') THEN 'SSLv3' WHEN contains(tls_info, 'SSLv2') THEN 'SSLv2' ELSE '' END"


@query("x12_tls_version", f"SELECT service_id, {_TLSV} AS tls FROM @services")
def _(view):
    return view("services").select("service_id", T.tls_version("tls_info").alias("tls"))


@query("x13_tls_notes", """SELECT service_id, array_to_string(list_filter([CASE WHEN contains(tls_info, 'TLSv1.0') THEN 'CRITICAL: TLS 1.0 is deprecated and insecure!' WHEN contains(tls_info, 'TLSv1.1') THEN 'WARNING: TLS 1.1 is deprecated!' END,
 CASE WHEN cipher_bits < 128 THEN 'WARNING: Weak cipher (' || cipher_bits || ' bits)' END], lambda x: x IS NOT NULL), '; ') AS notes FROM @services""")
def _(view):
    return view("services").select("service_id", F.array_join(T.tls_notes("tls_info", "cipher_bits"), "; ").alias("notes"))


_OLD = "(contains(banner, 'SSH-1.99') OR (contains(banner, 'SSH-1.') AND NOT contains(banner, 'SSH-2.0')))"
_REL = r"TRY_CAST(nullif(regexp_extract(banner, 'OpenSSH_(\d+\.\d+)', 1), '') AS DOUBLE) < 7.0"


@query("x20_ssh_audit", f"SELECT service_id, CASE WHEN {_OLD} OR {_REL} THEN 'FAIL' ELSE 'PASS' END AS status, CASE WHEN {_OLD} THEN 'Critical' WHEN {_REL} THEN 'High' ELSE 'Low' END AS risk FROM @services")
def _(view):
    return view("services").select("service_id", T.ssh_audit("banner").alias("a")).select("service_id", "a.*")


@query("u4_warnings_and_notes", f"""SELECT host, s.port, severity, m AS message FROM @services s JOIN (VALUES {rows(fixed.REPORT_RISKS)}) w(p, severity, m) ON p = s.port WHERE state = 'open'
 UNION ALL SELECT host, port, CASE WHEN contains(n, 'CRITICAL') THEN 'HIGH' ELSE 'MEDIUM' END, n FROM (SELECT host, port, unnest(list_filter([CASE WHEN contains(tls_info, 'TLSv1.0') THEN 'CRITICAL: TLS 1.0 is deprecated and insecure!' WHEN contains(tls_info, 'TLSv1.1') THEN 'WARNING: TLS 1.1 is deprecated!' END,
 CASE WHEN cipher_bits < 128 THEN 'WARNING: Weak cipher (' || cipher_bits || ' bits)' END], lambda x: x IS NOT NULL)) AS n FROM @services) q""")
def _(view):
    s = view("services")
    risks = E.port_findings(s.where(F.col("state") == "open")).where(F.col("kind") == "report").drop("kind")
    notes = s.select("host", "port", F.explode(T.tls_notes("tls_info", "cipher_bits")).alias("message"))
    return risks.unionByName(notes.withColumn("severity", F.when(F.col("message").contains("CRITICAL"), "HIGH").otherwise("MEDIUM")))


# ------------------------------------------------------------------ compliance

def _check(framework, control, cond, status, risk, finding, seq, source="@assets", sid="0"):
    return f"SELECT asset_id, {seq} AS seq, '{framework}' AS framework, '{control}' AS control, '{status}' AS status, '{risk}' AS risk, {finding} AS finding, CAST({sid} AS BIGINT) AS service_id FROM {source} WHERE {cond}"


_TLS = "coalesce(ssl_version, '')"
_DAYS = f"(DATE '{AS_OF}' - try_strptime(nullif(last_patch_date, ''), '%Y-%m-%d')::DATE)"
K1 = [("'Strong encryption in use: ' || " + _TLS, f"{_TLS} IN ('TLS 1.2', 'TLS 1.3')", "PASS", "Low"), ("'TLS 1.1 is deprecated and should be disabled.'", f"{_TLS} = 'TLS 1.1'", "WARNING", "Medium"),
      ("'CRITICAL: Obsolete protocol in use: ' || " + _TLS + " || '. Vulnerable to POODLE/BEAST.'", f"{_TLS} IN ('TLS 1.0', 'SSLv3', 'SSLv2')", "FAIL", "Critical"), ("'No encryption detected on this service.'", f"{_TLS} = ''", "FAIL", "High")]
k1 = [_check("ISO", "A.10.1.1", c, s, r, f, 0) for f, c, s, r in K1]
k2 = [_check("ISO", "A.9.4.3", "default_creds_active", "FAIL", "Critical", "'DEFAULT CREDENTIALS ARE STILL ACTIVE. This is a critical security violation.'", 1),
      _check("ISO", "A.9.4.3", "NOT default_creds_active", "PASS", "Low", "'Default credentials have been changed.'", 1),
      _check("ISO", "A.9.4.2", "NOT mfa_enabled", "WARNING", "Medium", "'Multi-factor authentication is not enabled.'", 2)]
k3 = [_check("ISO", "A.13.1.1", "is_industrial_device AND NOT isolated_segment", "FAIL", "Critical", "'Industrial/OT device is NOT properly network-segmented from IT network.'", 3),
      _check("ISO", "A.13.1.1", "is_industrial_device AND isolated_segment", "PASS", "Low", "'Industrial device is properly segmented in isolated network zone.'", 3)]
k4 = [_check("ISO", "A.12.6.1", f"{_DAYS} > 90", "FAIL", "High", f"'System has not been patched in ' || {_DAYS} || ' days.'", 4),
      _check("ISO", "A.12.6.1", f"{_DAYS} > 30 AND {_DAYS} <= 90", "WARNING", "Medium", f"'Last patch applied ' || {_DAYS} || ' days ago.'", 4)]
k5 = [_check("ISO", "A.12.4.1", "NOT logging_enabled", "FAIL", "High", "'Security event logging is disabled on this system.'", 5)]
k6 = [_check("ISO", "A.8.1.1", "coalesce(asset_tag, '') = ''", "WARNING", "Low", "'No asset tag/ID assigned to this device.'", 6)]
k7 = [_check("ISO", "A.13.2.1", "protocol = 'SSH' AND contains(banner, 'SSH-1')", "FAIL", "Critical", "'SSH Protocol version 1 supported (port ' || port || ').'", 100, "@services", "service_id"),
      _check("ISO", "A.14.1.2", "protocol IN ('HTTP', 'HTTPS') AND coalesce(x_frame_options, '') IN ('', 'missing')", "WARNING", "Medium", "'X-Frame-Options header is missing. Vulnerable to clickjacking.'", 101, "@services", "service_id"),
      _check("ISO", "A.10.1.1", "protocol = 'HTTPS' AND supports_tls10", "FAIL", "High", "'Server still supports TLS 1.0. Vulnerable to BEAST/POODLE attacks.'", 102, "@services", "service_id")]
k8 = [_check("IEC", "62443-3-3 SR 1.1", "default_creds_active", "FAIL", "Critical", "'Default credentials active on industrial device.'", 1000),
      _check("IEC", "62443-3-3 SR 5.1", "is_industrial_device AND NOT isolated_segment", "FAIL", "Critical", "'Industrial device is NOT isolated in a separate security zone.'", 1001),
      _check("IEC", "62443-3-3 SR 5.1", "is_industrial_device AND isolated_segment", "PASS", "Low", "'Device properly segmented per zone/conduit model.'", 1001),
      _check("IEC", "62443-3-3 SR 4.1", f"{_TLS} NOT IN ('TLS 1.2', 'TLS 1.3')", "FAIL", "High", f"'Encryption standard ''' || {_TLS} || ''' does not meet IEC 62443 SL-2 requirements.'", 1002),
      _check("IEC", "62443-3-3 SR 7.1", "true", "WARNING", "Medium", "'DoS protection mechanisms should be verified for industrial endpoints.'", 1003)]
ISO = " UNION ALL ".join(k1 + k2 + k3 + k4 + k5 + k6 + k7)
ALL = ISO + " UNION ALL " + " UNION ALL ".join(k8)
as_of = lambda: F.lit(AS_OF).cast("date")
KEEP = ["asset_id", "control", "status", "risk", "finding"]


def iso(view):
    return C.iso_findings(view("assets"), view("services"), as_of())


def _control(name, parts, controls, services=False):
    sql = " UNION ALL ".join(parts)

    @query(name, f"SELECT {', '.join(KEEP)}, service_id FROM ({sql}) k")
    def _(view):
        found = iso(view).where(F.col("control").isin(controls))
        return found.where(F.col("seq") >= 100 if services else F.col("seq") < 100).select(*KEEP, "service_id")


_control("k1_tls", k1, ["A.10.1.1"])
_control("k2_access", k2, ["A.9.4.3", "A.9.4.2"])
_control("k3_segmentation", k3, ["A.13.1.1"])
_control("k4_patch_age", k4, ["A.12.6.1"])
_control("k5_logging", k5, ["A.12.4.1"])
_control("k6_asset_tag", k6, ["A.8.1.1"])
_control("k7_services", k7, ["A.13.2.1", "A.14.1.2", "A.10.1.1"], services=True)


@query("k8_iec_checks", f"SELECT {', '.join(KEEP)} FROM ({' UNION ALL '.join(k8)}) k")
def _(view):
    return C.iec_findings(view("assets")).select(*KEEP)


_NIST = f"""SELECT asset_id, 'ID.AM-1' AS subcategory, CAST(CASE WHEN coalesce(asset_tag, '') <> '' THEN 100 ELSE 60 END AS INTEGER) AS score, CASE WHEN coalesce(asset_tag, '') <> '' THEN 'PASS' ELSE 'WARNING' END AS status FROM @assets
 UNION ALL SELECT asset_id, 'PR.AC-1', CASE WHEN default_creds_active THEN 20 ELSE 100 END, CASE WHEN default_creds_active THEN 'FAIL' ELSE 'PASS' END FROM @assets
 UNION ALL SELECT asset_id, 'PR.DS-2', CASE WHEN {_TLS} IN ('TLS 1.2', 'TLS 1.3') THEN 100 ELSE 30 END, CASE WHEN {_TLS} IN ('TLS 1.2', 'TLS 1.3') THEN 'PASS' ELSE 'FAIL' END FROM @assets
 UNION ALL SELECT asset_id, 'DE.AE-3', CASE WHEN coalesce(logging_enabled, true) THEN 100 ELSE 40 END, CASE WHEN coalesce(logging_enabled, true) THEN 'PASS' ELSE 'FAIL' END FROM @assets"""


@query("k9_nist_scores", _NIST)
def _(view):
    return C.nist_findings(view("assets"))


@query("k12_iso_audit", f"SELECT status, control, count(*) AS checks FROM ({ISO}) k GROUP BY 1, 2")
def _(view):
    return iso(view).groupBy("status", "control").agg(F.count(F.lit(1)).alias("checks"))


@query("e13_compliance_summary", f"""SELECT count(*) AS total_checks, count(*) FILTER (WHERE status = 'PASS') AS passed, count(*) FILTER (WHERE status = 'FAIL') AS failed, count(*) FILTER (WHERE status = 'WARNING') AS warnings,
 round(count(*) FILTER (WHERE status = 'PASS')::DOUBLE / count(*) * 100, 1) AS compliance_rate FROM ({ISO}) k""")
def _(view):
    return C.summary(iso(view))


_REPORT = f"""allchecks AS ({ALL}), nist AS (SELECT asset_id, CAST(round_even(avg(score), 0) AS INTEGER) AS nist_csf_score FROM ({_NIST}) n GROUP BY 1),
 per AS (SELECT asset_id, count(*) FILTER (WHERE status = 'FAIL' AND framework = 'ISO') AS i, count(*) FILTER (WHERE status = 'FAIL' AND framework = 'IEC') AS c, count(*) FILTER (WHERE status = 'WARNING' AND framework = 'ISO') AS warnings FROM allchecks GROUP BY 1),
 reports AS (SELECT a.asset_id, nist_csf_score, coalesce(warnings, 0) AS warnings, coalesce(i, 0) = 0 AS iso_27001_passed, coalesce(c, 0) = 0 AS iec_62443_passed, coalesce(i, 0) + coalesce(c, 0) AS failures FROM @assets a JOIN nist ON nist.asset_id = a.asset_id LEFT JOIN per ON per.asset_id = a.asset_id),
 graded AS (SELECT *, CASE WHEN failures = 0 AND nist_csf_score >= 90 THEN 'A' WHEN failures <= 1 AND nist_csf_score >= 75 THEN 'B' WHEN failures <= 3 AND nist_csf_score >= 50 THEN 'C' WHEN failures <= 5 THEN 'D' ELSE 'F' END AS overall_grade FROM reports)"""


@query("e14_nist_score", f"WITH {_REPORT} SELECT asset_id, nist_csf_score FROM graded")
def _(view):
    return C.host_reports(view("assets"), view("services"), as_of()).select("asset_id", "nist_csf_score")


@query("x8_grades", f"WITH {_REPORT} SELECT overall_grade, count(*) AS assets FROM graded GROUP BY 1")
def _(view):
    return C.host_reports(view("assets"), view("services"), as_of()).groupBy("overall_grade").agg(F.count(F.lit(1)).alias("assets"))


@query("k10_host_report", f"WITH {_REPORT} SELECT * FROM graded")
def _(view):
    return C.host_reports(view("assets"), view("services"), as_of())


_FAIL = "SELECT asset_id, seq, service_id, '[' || framework || ' ' || control || '] ' || finding AS failure FROM allchecks WHERE status = 'FAIL'"


@query("u3_failures", f"WITH allchecks AS ({ALL}) SELECT asset_id, service_id, failure FROM ({_FAIL}) f")
def _(view):
    return C.failures(view("assets"), view("services"), as_of()).select("asset_id", "service_id", "failure")


@query("s8_first_failures", f"WITH allchecks AS ({ALL}) SELECT asset_id, CAST(position AS INTEGER) AS position, failure FROM (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY seq, service_id) AS position FROM ({_FAIL}) f) q WHERE position <= 3")
def _(view):
    return C.first_failures(C.failures(view("assets"), view("services"), as_of())).select("asset_id", "position", "failure")


_RISK = """CAST(least(100, CAST(trunc(max_cvss / 10.0 * 40 + least(total_vulns * 5, 20) + least(exploit_count * 10, 20) + CASE WHEN iso_27001_passed THEN 0 ELSE 10 END + CASE WHEN iec_62443_passed THEN 0 ELSE 10 END) AS INTEGER)) AS INTEGER)"""
_ASSESS = f"""WITH {_ASSET}, {_REPORT}, assessed AS (SELECT a.asset_id, a.hostname, a.software, s.* EXCLUDE (asset_id), g.* EXCLUDE (asset_id), {_RISK} AS risk_score,
 CASE WHEN max_cvss >= 9 OR critical_count > 0 THEN 'critical' WHEN max_cvss >= 7 OR NOT iso_27001_passed THEN 'vulnerable' WHEN max_cvss > 0 OR warnings > 0 THEN 'warning' ELSE 'safe' END AS status
 FROM @assets a JOIN stats s ON s.asset_id = a.asset_id JOIN graded g ON g.asset_id = a.asset_id)"""


def assessed(view):
    return C.assess_assets(view("assets"), view("services"), as_of())


@query("k11_asset_assessment", _ASSESS + " SELECT * FROM assessed")
def _(view):
    return assessed(view)


@query("x5_risk_score", _ASSESS + " SELECT asset_id, risk_score FROM assessed")
def _(view):
    return assessed(view).select("asset_id", "risk_score")


@query("x6_asset_status", _ASSESS + " SELECT status, count(*) AS assets FROM assessed GROUP BY 1")
def _(view):
    return assessed(view).groupBy("status").agg(F.count(F.lit(1)).alias("assets"))


_EXEC = """ SELECT count(*) AS targets_scanned, CAST(sum(total_vulns) AS BIGINT) AS total_vulnerabilities, CAST(sum(critical_count) AS BIGINT) AS critical_vulnerabilities, CAST(sum(exploit_count) AS BIGINT) AS exploitable_vulnerabilities,
 max(max_cvss) AS max_cvss_score, CAST(round_even(count(*) FILTER (WHERE iso_27001_passed) * 100.0::DOUBLE / count(*), 0) AS INTEGER) AS iso_compliance_rate, count(*) FILTER (WHERE status IN ('critical', 'vulnerable')) AS assets_at_risk,
 CASE WHEN max(max_cvss) >= 9 THEN 'CRITICAL' WHEN max(max_cvss) >= 7 THEN 'HIGH RISK' WHEN max(max_cvss) > 0 THEN 'MODERATE' ELSE 'SECURE' END AS overall_posture FROM assessed"""


@query("e12_executive_summary", _ASSESS + _EXEC)
def _(view):
    return C.executive_summary(assessed(view))


@query("x7_posture", _ASSESS + " SELECT software, max(max_cvss) AS worst, CASE WHEN max(max_cvss) >= 9 THEN 'CRITICAL' WHEN max(max_cvss) >= 7 THEN 'HIGH RISK' WHEN max(max_cvss) > 0 THEN 'MODERATE' ELSE 'SECURE' END AS posture FROM assessed GROUP BY 1")
def _(view):
    return assessed(view).groupBy("software").agg(F.max("max_cvss").alias("worst")).withColumn("posture", X.posture("worst"))
