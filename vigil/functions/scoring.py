"""Severity, risk and grade expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def cvss_severity(cvss) -> Column:
    c = _c(cvss)
    return (F.when(c >= 9.0, "Critical").when(c >= 7.0, "High").when(c >= 4.0, "Medium")
            .when(c > 0, "Low").otherwise("Info"))


def risk_score(max_cvss, total, exploits, iso_passed, iec_passed) -> Column:
    """0..100: forty parts CVSS, twenty each for count, exploits and the two frameworks."""
    ten = lambda passed: F.when(_c(passed), 0).otherwise(10)
    raw = (_c(max_cvss) / 10.0 * 40 + F.least(_c(total) * 5, F.lit(20))
           + F.least(_c(exploits) * 10, F.lit(20)) + ten(iso_passed) + ten(iec_passed))
    return F.least(F.lit(100), raw.cast("int"))


def asset_status(max_cvss, critical, iso_passed, warnings) -> Column:
    m = _c(max_cvss)
    return (F.when((m >= 9.0) | (_c(critical) > 0), "critical")
            .when((m >= 7.0) | ~_c(iso_passed), "vulnerable")
            .when((m > 0) | (_c(warnings) > 0), "warning")
            .otherwise("safe"))


def posture(max_cvss) -> Column:
    m = _c(max_cvss)
    return (F.when(m >= 9.0, "CRITICAL").when(m >= 7.0, "HIGH RISK").when(m > 0, "MODERATE")
            .otherwise("SECURE"))


def compliance_grade(failures, nist_score) -> Column:
    f, s = _c(failures), _c(nist_score)
    return (F.when((f == 0) & (s >= 90), "A").when((f <= 1) & (s >= 75), "B")
            .when((f <= 3) & (s >= 50), "C").when(f <= 5, "D").otherwise("F"))


def percent_of_range(value, low, high) -> Column:
    """Position of a value in its range in percent, 0 for an empty range."""
    v, a, b = _c(value), _c(low), _c(high)
    return F.when(b > a, (v - a) * 100.0 / (b - a)).otherwise(F.lit(0.0))


def gauge_percent(value, low, high) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), percent_of_range(value, low, high)))
