"""Checks and reports over register commands and readings of industrial controllers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from vigil import fixed, tables
from vigil.functions.scoring import gauge_percent, percent_of_range
from vigil.operators.skew import lag_columns, rows_in_window, running
from vigil.session import durable

WRITE_WINDOW_US = fixed.MAX_WRITES[1] * 1_000_000


def writes(commands: DataFrame) -> DataFrame:
    """Only function codes 6 and 16 write."""
    return commands.where(F.col("function_code").isin(fixed.WRITE_FUNCTION_CODES))


def with_register(commands: DataFrame, registers: DataFrame | None = None) -> DataFrame:
    """Add the register of a command; an unknown address ranges over 0..65535 and may be written."""
    registers = tables.registers(commands.sparkSession) if registers is None else registers
    side = tables.bounded_broadcast(registers.select(F.col("address").alias("_a"), F.struct("*").alias("_r")))
    return (commands.join(side, F.col("address") == F.col("_a"), "left").withColumns({
        "known": F.col("_r").isNotNull(), "register_name": F.col("_r.name"),
        "min_value": F.coalesce("_r.min_value", F.lit(0).cast("bigint")),
        "max_value": F.coalesce("_r.max_value", F.lit(65535).cast("bigint")),
        "readonly": F.coalesce("_r.readonly", F.lit(False))}).drop("_a", "_r"))


def unauthorized_writers(commands: DataFrame) -> DataFrame:
    """Writing sources that are not on the list, with their number of writes."""
    listed = tables.dimension(commands.sparkSession, "source_ip:s", [(w,) for w in fixed.OT_WRITERS])
    return (writes(commands).groupBy("source_ip").agg(F.count(F.lit(1)).alias("writes"))
            .join(F.broadcast(listed), "source_ip", "left_anti"))


def _text(*parts):
    return F.concat(*[F.lit(p[1:]) if isinstance(p, str) and p.startswith("=") else F.col(p).cast("string")
                      if isinstance(p, str) else p for p in parts])


def verdicts(commands: DataFrame, registers: DataFrame | None = None, us: str = "us",
             command_id: str = "command_id", count_writes: bool = True) -> DataFrame:
    """Verdict of every command: ``is_alert, severity, action, message, check``.

    Writer, read-only and range checks look at the command alone and end the analysis.  The rate
    of change and the write frequency look at the earlier accepted writes of the register, which
    takes three look-backs.  The number of writes in the message is counted only for the commands
    that need it.
    """
    rows = with_register(commands, registers)
    write = F.col("function_code").isin(fixed.WRITE_FUNCTION_CODES)
    stage = (F.when(~write, "read").when(~F.col("source_ip").isin(fixed.OT_WRITERS), "unauthorized_source")
             .when(F.col("readonly"), "readonly_violation")
             .when(~F.col("value").between(F.col("min_value"), F.col("max_value")), "range_violation")
             .otherwise("accepted"))
    rows = rows.withColumn("_stage", stage)
    accepted = lag_columns(rows.where(F.col("_stage") == "accepted"), "address", [us, command_id], {
        "_previous": ("value", 1), "_second": ("value", 2), "_eleventh": (us, fixed.MAX_WRITES[0])})
    span = F.col("max_value") - F.col("min_value")
    change = F.when(F.col("known") & (span > 0) & F.col("_second").isNotNull(),
                    F.abs(F.col("value") - F.col("_previous")) * 100.0 / span)
    accepted = accepted.withColumn("_change", change)
    frequent = F.col(us) - F.col("_eleventh") <= WRITE_WINDOW_US
    accepted = accepted.withColumn("_stage", F.when(F.col("_change") > fixed.MAX_CHANGE_PERCENT, "rate_of_change")
                                   .when(frequent, "write_frequency").otherwise("normal"))
    if count_writes:
        accepted = rows_in_window(accepted, "address", WRITE_WINDOW_US, "_writes", us, command_id)
    else:
        accepted = accepted.withColumn("_writes", F.lit(None).cast("bigint"))
    accepted = accepted.drop("_second", "_eleventh")
    rest = rows.where(F.col("_stage") != "accepted").withColumns({
        "_previous": F.lit(None).cast("bigint"), "_change": F.lit(None).cast("double"),
        "_writes": F.lit(None).cast("bigint")})
    out = accepted.unionByName(rest)
    kind = F.col("_stage")
    name = F.coalesce(F.col("register_name"), F.lit("?"))
    message = (
        F.when(kind == "read", _text("=Read operation (FC ", "function_code", "=) — Allowed"))
        .when(kind == "unauthorized_source", _text("=UNAUTHORIZED WRITE: Source ", "source_ip", "= not in authorized list"))
        .when(kind == "readonly_violation", _text("=WRITE TO READ-ONLY REGISTER: ", name, "= (addr ", "address", "=)"))
        .when(kind == "range_violation", _text("=VALUE OUT OF RANGE: Register ", "address", "= (", name, "=) value ", "value",
                                               "= outside [", "min_value", "=-", "max_value", "=]"))
        .when(kind == "rate_of_change", _text("=RAPID VALUE CHANGE: Register ", "address", "= changed by ",
                                              F.bround("_change", 0).cast("bigint").cast("string"), "=% (", "_previous",
                                              "= → ", "value", "=)"))
        .when(kind == "write_frequency", _text("=HIGH WRITE FREQUENCY: Register ", "address", "= written ",
                                               F.coalesce(F.col("_writes").cast("string"), F.lit("more than 10")),
                                               f"= times in 60s (limit: {fixed.MAX_WRITES[0]})"))
        .otherwise(_text("=Write to register ", "address", "= = ", "value", "= — Normal operation")))
    severity = (F.when(kind.isin("unauthorized_source", "readonly_violation"), "Critical")
                .when(kind.isin("range_violation", "rate_of_change"), "High")
                .when(kind == "write_frequency", "Medium").otherwise("info"))
    blocked = kind.isin("unauthorized_source", "readonly_violation", "range_violation")
    return (out.withColumns({"is_alert": ~kind.isin("read", "normal"), "severity": severity,
                             "action": F.when(blocked, "BLOCK").otherwise("ALLOW"), "message": message,
                             "check": F.when(~kind.isin("read", "normal"), kind).otherwise(""),
                             "change_percent": F.col("_change")})
            .drop("_stage", "_previous", "_change", "_writes"))


def alert_records(judged: DataFrame) -> DataFrame:
    """Alerting commands with the list of checks that fired."""
    return judged.where("is_alert").select(
        "command_id", "us", "severity", "message", "action", F.col("address").alias("register"), "value", "source_ip",
        "function_code", F.array_compact(F.array(F.nullif(F.col("check"), F.lit("")))).alias("checks_triggered"))


def counters(judged: DataFrame) -> DataFrame:
    kind = F.col("check")
    return judged.agg(F.count(F.lit(1)).alias("commands_analyzed"), F.count_if("is_alert").alias("alerts_generated"),
                      F.count_if(kind.isin("readonly_violation", "range_violation")).alias("writes_blocked"),
                      F.count_if(kind == "unauthorized_source").alias("unauthorized_access"))


def process_alarms(readings: DataFrame) -> DataFrame:
    """Readings above a limit, one row per alarm."""
    alarms = tables.alarms(readings.sparkSession).withColumnRenamed("address", "_register")
    message = _text("alarm", "=: ", "value", "unit", "= exceeds limit ", "limit_value", "unit")
    return (readings.join(F.broadcast(alarms), (F.col("address") == F.col("_register")) & (F.col("value") > F.col("limit_value")))
            .withColumn("message", message).drop("_register"))


def validate_writes(commands: DataFrame, registers: DataFrame | None = None) -> DataFrame:
    """Add ``success`` and ``error``: unknown address, read-only register, value out of range."""
    rows = with_register(commands, registers)
    error = (F.when(~F.col("known"), "Unknown register address")
             .when(F.col("readonly"), _text("=Register ", "address", "= is read-only"))
             .when(~F.col("value").between(F.col("min_value"), F.col("max_value")),
                   _text("=Value ", "value", "= out of range [", "min_value", "=-", "max_value", "=]"))
             .otherwise(""))
    return rows.withColumn("error", error).withColumn("success", F.col("error") == "")


def change_log(commands: DataFrame, us: str = "us", command_id: str = "command_id") -> DataFrame:
    """Successful writes with the value before; the first one replaces the register default."""
    done = validate_writes(writes(commands)).where("success")
    done = lag_columns(done, "address", [us, command_id], {"_before": ("value", 1)})
    defaults = tables.registers(commands.sparkSession).select(F.col("address").alias("_a"), "default_value")
    return (done.join(F.broadcast(defaults), F.col("address") == F.col("_a"), "left")
            .select(command_id, us, F.col("address").alias("register"), "register_name",
                    F.coalesce("_before", "default_value").alias("old_value"), F.col("value").alias("new_value")))


def snapshot(commands: DataFrame, us: str = "us", command_id: str = "command_id") -> DataFrame:
    """Current value of every register; the default where nothing was written."""
    last = (validate_writes(writes(commands)).where("success").groupBy(F.col("address").alias("_a"))
            .agg(F.max_by("value", F.struct(us, command_id)).alias("_v"), F.count(F.lit(1)).alias("_n")))
    regs = tables.registers(commands.sparkSession)
    return (regs.join(last, F.col("address") == F.col("_a"), "left")
            .select("address", "name", "unit", F.coalesce("_v", "default_value").alias("value"), "min_value", "max_value",
                    "readonly", F.coalesce("_n", F.lit(0)).alias("writes")))


def gauges(state: DataFrame) -> DataFrame:
    """Position of every register in its range, clamped to 0..100."""
    return state.withColumn("percent", F.round(gauge_percent("value", "min_value", "max_value"), 2))


def unit_status(state: DataFrame) -> DataFrame:
    """Highest position among the registers of a unit (same hundred) and its status."""
    pct = F.greatest(F.lit(0.0), F.max(percent_of_range("value", "min_value", "max_value")))
    status = F.when(F.col("max_percent") > 90, "CRITICAL").when(F.col("max_percent") > 70, "WARNING").otherwise("NORMAL")
    return (state.groupBy((F.floor(F.col("address") / 100) * 100).cast("int").alias("unit"))
            .agg(F.round(pct, 2).alias("max_percent")).withColumn("status", status))


def emergency_latch(readings: DataFrame, us: str = "us", row_id: str = "command_id", plant: str = "plant") -> DataFrame:
    """Add ``emergency`` and ``trip``: a trip condition latches until a reset.

    Boiler temperature above 550 or pressure above 90 trips; writing 0 to register 400 resets.
    The latch holds when the last trip condition is younger than the last reset, so three running
    maxima, one of them up to the row before, say everything.
    """
    (hot, hot_limit), (press, press_limit) = fixed.TRIP_LIMITS["temperature"], fixed.TRIP_LIMITS["pressure"]
    condition = (((F.col("address") == hot) & (F.col("value") > hot_limit))
                 | ((F.col("address") == press) & (F.col("value") > press_limit)))
    reset = (F.col("address") == 400) & (F.col("value") == 0)
    at = F.struct(us, row_id)
    rows = durable(readings.withColumns({"_condition": condition, "_reset": reset}))    # read for counts, cuts and rows
    trip = F.when(F.col("_condition"), at)
    seen = running(rows, plant, [us, row_id], F.max, {"_last_trip": trip, "_last_reset": F.when(F.col("_reset"), at)}, {"_trip_before": trip})
    latched = lambda trip: F.col(trip).isNotNull() & (F.col("_last_reset").isNull() | (F.col(trip) > F.col("_last_reset")))
    return (seen.withColumns({"emergency": latched("_last_trip"),
                              "trip": F.col("_condition") & ~F.coalesce(latched("_trip_before"), F.lit(False))})
            .drop("_condition", "_reset", "_last_trip", "_last_reset", "_trip_before"))


def event_list(judged: DataFrame, alarms: DataFrame) -> DataFrame:
    """Writes, blocked writes and alarms as one list with their time."""
    write = F.col("function_code").isin(fixed.WRITE_FUNCTION_CODES)
    done = judged.where(write).select(
        "us", F.col("command_id").alias("row_id"), F.when(F.col("action") == "BLOCK", "BLOCKED").otherwise("WRITE").alias("type"),
        "severity", "message")
    return done.unionByName(alarms.select("us", F.col("command_id").alias("row_id"), F.lit("ALARM").alias("type"),
                                          "severity", "message"))
