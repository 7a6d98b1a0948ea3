"""Industrial control queries."""

from pyspark.sql import functions as F

from vigil import fixed
from vigil.catalog.registry import query, rows
from vigil.operators import ot as O

REGS = f"(VALUES {rows(fixed.REGISTERS)}) r(addr, name, unit, dflt, lo, hi, ro)"
W = "PARTITION BY address ORDER BY us, command_id"
WRITERS = ", ".join(f"'{w}'" for w in fixed.OT_WRITERS)
STAGED = f"""staged AS (SELECT c.*, r.addr IS NOT NULL AS known, r.name, coalesce(r.lo, 0) AS lo, coalesce(r.hi, 65535) AS hi,
   CASE WHEN function_code NOT IN (6, 16) THEN 'read' WHEN source_ip NOT IN ({WRITERS}) THEN 'unauthorized_source' WHEN coalesce(r.ro, false) THEN 'readonly_violation'
    WHEN value < coalesce(r.lo, 0) OR value > coalesce(r.hi, 65535) THEN 'range_violation' ELSE 'accepted' END AS stage FROM @commands c LEFT JOIN {REGS} ON r.addr = c.address),
 accepted AS (SELECT *, lag(value) OVER ({W}) AS prev, lag(value, 2) OVER ({W}) AS second, row_number() OVER ({W}) AS n FROM staged WHERE stage = 'accepted'),
 counted AS (SELECT a.*, CASE WHEN known AND hi > lo AND second IS NOT NULL THEN abs(value - prev) * 100.0::DOUBLE / (hi - lo) END AS change,
   count(*) OVER (PARTITION BY address ORDER BY us RANGE BETWEEN 60000000 PRECEDING AND CURRENT ROW) - (count(*) OVER (PARTITION BY address, us) - row_number() OVER (PARTITION BY address, us ORDER BY command_id)) AS writes FROM accepted a),
 judged AS (SELECT command_id, us, function_code, address, value, source_ip, name, lo, hi, prev, change, writes, CASE WHEN change > 25 THEN 'rate_of_change' WHEN writes > 10 THEN 'write_frequency' ELSE 'normal' END AS kind FROM counted
  UNION ALL SELECT command_id, us, function_code, address, value, source_ip, name, lo, hi, NULL, NULL, NULL, stage FROM staged WHERE stage <> 'accepted'),
 verdicts AS (SELECT *, kind NOT IN ('read', 'normal') AS is_alert, CASE WHEN kind IN ('unauthorized_source', 'readonly_violation') THEN 'Critical' WHEN kind IN ('range_violation', 'rate_of_change') THEN 'High' WHEN kind = 'write_frequency' THEN 'Medium' ELSE 'info' END AS severity,
  CASE WHEN kind IN ('unauthorized_source', 'readonly_violation', 'range_violation') THEN 'BLOCK' ELSE 'ALLOW' END AS action, CASE WHEN kind IN ('read', 'normal') THEN '' ELSE kind END AS "check",
  CASE kind WHEN 'read' THEN 'Read operation (FC ' || function_code || ') — Allowed' WHEN 'unauthorized_source' THEN 'UNAUTHORIZED WRITE: Source ' || source_ip || ' not in authorized list'
   WHEN 'readonly_violation' THEN 'WRITE TO READ-ONLY REGISTER: ' || coalesce(name, '?') || ' (addr ' || address || ')' WHEN 'range_violation' THEN 'VALUE OUT OF RANGE: Register ' || address || ' (' || coalesce(name, '?') || ') value ' || value || ' outside [' || lo || '-' || hi || ']'
   WHEN 'rate_of_change' THEN 'RAPID VALUE CHANGE: Register ' || address || ' changed by ' || CAST(round_even(change, 0) AS BIGINT) || '% (' || prev || ' → ' || value || ')'
   WHEN 'write_frequency' THEN 'HIGH WRITE FREQUENCY: Register ' || address || ' written ' || writes || ' times in 60s (limit: 10)' ELSE 'Write to register ' || address || ' = ' || value || ' — Normal operation' END AS message FROM judged)"""
COLUMNS = 'command_id, is_alert, severity, action, "check", message'


def judged(view):
    return O.verdicts(view("commands"))


@query("j5_command_verdicts", f"WITH {STAGED} SELECT {COLUMNS} FROM verdicts")
def _(view):
    return judged(view).select("command_id", "is_alert", "severity", "action", "check", "message")


def _kind(name, kinds):
    sql = f"WITH {STAGED} SELECT command_id, address, value, message FROM verdicts WHERE kind IN ({', '.join(repr(k) for k in kinds)})"

    @query(name, sql)
    def _(view):
        return judged(view).where(F.col("check").isin(kinds)).select("command_id", "address", "value", "message")


_kind("h1_unauthorized_writers", ["unauthorized_source"])
_kind("h2_readonly_writes", ["readonly_violation"])
_kind("h3_range_violations", ["range_violation"])
_kind("h5_rapid_changes", ["rate_of_change"])
_kind("h6_frequent_writes", ["write_frequency"])


@query("f13_write_frequency", f"WITH {STAGED} SELECT command_id, address, writes FROM counted WHERE writes > 10")
def _(view):
    from vigil.operators.skew import rows_in_window
    passed = O.validate_writes(O.writes(view("commands")).where(F.col("source_ip").isin(fixed.OT_WRITERS)))
    passed = passed.where(F.col("success") | ~F.col("known") & F.col("value").between(0, 65535))
    counted = rows_in_window(passed, "address", O.WRITE_WINDOW_US, "writes", row_id="command_id")
    return counted.where("writes > 10").select("command_id", "address", "writes")


@query("h4_accepted_history", f"WITH {STAGED} SELECT command_id, address, change FROM counted WHERE change IS NOT NULL")
def _(view):
    return judged(view).where("change_percent IS NOT NULL").select("command_id", "address", F.col("change_percent").alias("change"))


@query("c8_write_filter", "SELECT command_id, function_code, address FROM @commands WHERE function_code IN (6, 16)")
def _(view):
    return O.writes(view("commands")).select("command_id", "function_code", "address")


@query("u5_unlisted_writers", f"SELECT source_ip, count(*) AS writes FROM @commands WHERE function_code IN (6, 16) AND source_ip NOT IN ({WRITERS}) GROUP BY 1")
def _(view):
    return O.unauthorized_writers(view("commands"))


@query("d18_register_lookup", f"""SELECT command_id, r.addr IS NOT NULL AS known, r.name AS register_name, CAST(coalesce(r.lo, 0) AS BIGINT) AS min_value, CAST(coalesce(r.hi, 65535) AS BIGINT) AS max_value, coalesce(r.ro, false) AS readonly
 FROM @commands c LEFT JOIN {REGS} ON r.addr = c.address""")
def _(view):
    return O.with_register(view("commands")).select("command_id", "known", "register_name", "min_value", "max_value", "readonly")


_ALARM_ROWS = f"(VALUES {rows(fixed.ALARMS)}) a(alarm, reg, lim, severity, unit)"
_ALARM = f"""SELECT command_id, us, alarm, address, value, CAST(lim AS BIGINT) AS limit_value, severity, unit, alarm || ': ' || value || unit || ' exceeds limit ' || lim || unit AS message
 FROM @commands c JOIN {_ALARM_ROWS} ON a.reg = c.address AND c.value > a.lim"""


@query("h7_process_alarms", f"SELECT command_id, alarm, value, limit_value, severity, message FROM ({_ALARM}) x")
def _(view):
    return O.process_alarms(view("commands")).select("command_id", "alarm", "value", "limit_value", "severity", "message")


_PLANT = """plant AS (SELECT *, l % 3 AS plant FROM (SELECT *, command_id // 10000000 // 8 AS l FROM @commands) q),
 pos AS (SELECT *, row_number() OVER (PARTITION BY plant ORDER BY us, command_id) AS n, (address = 100 AND value > 550) OR (address = 101 AND value > 90) AS cond, address = 400 AND value = 0 AS reset FROM plant),
 run AS (SELECT *, max(CASE WHEN cond THEN n END) OVER w AS t, max(CASE WHEN reset THEN n END) OVER w AS r FROM pos WINDOW w AS (PARTITION BY plant ORDER BY n)),
 latch AS (SELECT *, t IS NOT NULL AND (r IS NULL OR t > r) AS emergency, cond AND NOT coalesce(pt IS NOT NULL AND (r IS NULL OR pt > r), false) AS trip FROM (SELECT *, lag(t) OVER (PARTITION BY plant ORDER BY n) AS pt FROM run) q2)"""


def latched(view):
    plant = F.expr("CAST((command_id div 10000000 div 8) % 3 AS BIGINT)")
    return O.emergency_latch(view("commands").withColumn("plant", plant))


@query("h8_shutdown_latch", f"WITH {_PLANT} SELECT command_id, plant, emergency, trip FROM latch")
def _(view):
    return latched(view).select("command_id", "plant", "emergency", "trip")


@query("h8_trip_counts", f"WITH {_PLANT} SELECT plant, count(*) FILTER (WHERE trip) AS trips, count(*) FILTER (WHERE emergency) AS rows_in_emergency FROM latch GROUP BY 1")
def _(view):
    return latched(view).groupBy("plant").agg(F.count_if("trip").alias("trips"), F.count_if("emergency").alias("rows_in_emergency"))


_VALID = f"""valid AS (SELECT c.*, r.name, r.dflt, CASE WHEN r.addr IS NULL THEN 'Unknown register address' WHEN r.ro THEN 'Register ' || address || ' is read-only'
  WHEN value < r.lo OR value > r.hi THEN 'Value ' || value || ' out of range [' || r.lo || '-' || r.hi || ']' ELSE '' END AS error FROM @commands c LEFT JOIN {REGS} ON r.addr = c.address)"""


@query("h9_write_validation", f"WITH {_VALID} SELECT command_id, error, error = '' AS success FROM valid WHERE function_code IN (6, 16)")
def _(view):
    return O.validate_writes(O.writes(view("commands"))).select("command_id", "error", "success")


@query("h10_change_log", f"""WITH {_VALID} SELECT command_id, us, address AS register, name AS register_name, CAST(coalesce(lag(value) OVER ({W}), dflt) AS BIGINT) AS old_value, value AS new_value
 FROM valid WHERE function_code IN (6, 16) AND error = ''""")
def _(view):
    return O.change_log(view("commands"))


_SNAP = f"""{_VALID}, last AS (SELECT address, arg_max(value, (us, command_id)) AS v, count(*) AS n FROM valid WHERE function_code IN (6, 16) AND error = '' GROUP BY 1),
 snap AS (SELECT CAST(r.addr AS INTEGER) AS address, r.name, r.unit, CAST(coalesce(v, dflt) AS BIGINT) AS value, CAST(lo AS BIGINT) AS min_value, CAST(hi AS BIGINT) AS max_value, ro AS readonly, coalesce(n, 0) AS writes FROM {REGS} LEFT JOIN last ON last.address = r.addr)"""


@query("h11_register_snapshot", f"WITH {_SNAP} SELECT * FROM snap")
def _(view):
    return O.snapshot(view("commands"))


@query("x14_gauges", f"WITH {_SNAP} SELECT address, value, round(greatest(0, least(100, CASE WHEN max_value > min_value THEN (value - min_value) * 100.0::DOUBLE / (max_value - min_value) ELSE 0 END)), 2) AS percent FROM snap")
def _(view):
    return O.gauges(O.snapshot(view("commands"))).select("address", "value", "percent")


@query("e20_unit_status", f"""WITH {_SNAP} SELECT unit, m AS max_percent, CASE WHEN m > 90 THEN 'CRITICAL' WHEN m > 70 THEN 'WARNING' ELSE 'NORMAL' END AS status FROM (
 SELECT CAST(address // 100 * 100 AS INTEGER) AS unit, round(greatest(0, max(CASE WHEN max_value > min_value THEN (value - min_value) * 100.0::DOUBLE / (max_value - min_value) ELSE 0 END)), 2) AS m FROM snap GROUP BY 1) q""")
def _(view):
    return O.unit_status(O.snapshot(view("commands")))


@query("e17_ot_counters", f"""WITH {STAGED} SELECT count(*) AS commands_analyzed, count(*) FILTER (WHERE is_alert) AS alerts_generated,
 count(*) FILTER (WHERE kind IN ('readonly_violation', 'range_violation')) AS writes_blocked, count(*) FILTER (WHERE kind = 'unauthorized_source') AS unauthorized_access FROM verdicts""")
def _(view):
    return O.counters(O.verdicts(view("commands"), count_writes=False))


@query("h12_event_list", f"""WITH {STAGED} SELECT us, command_id AS row_id, CASE WHEN action = 'BLOCK' THEN 'BLOCKED' ELSE 'WRITE' END AS type, severity, message FROM verdicts WHERE function_code IN (6, 16)
 UNION ALL SELECT us, command_id, 'ALARM', severity, message FROM ({_ALARM}) x""")
def _(view):
    return O.event_list(judged(view), O.process_alarms(view("commands")))


@query("h13_alert_records", f"""WITH {STAGED} SELECT command_id, us, severity, message, action, address AS register, value, source_ip, function_code, "check" AS checks_triggered FROM verdicts WHERE is_alert""")
def _(view):
    return O.alert_records(judged(view)).withColumn("checks_triggered", F.array_join("checks_triggered", ","))
