"""Sliding thresholds: N rows of a key within W seconds, both ends included."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from vigil.operators.skew import hot_keys, ordered_pieces, with_carry

SECOND = 1_000_000


def _cells(df: DataFrame, us: str, window_us: int) -> DataFrame:
    return df.withColumn("_cell", F.floor(F.col(us) / F.lit(window_us)).cast("bigint"))


def first_fire(df: DataFrame, key: str, threshold: int, window_us: int, us: str = "us",
               event_id: str = "event_id", keep: list[str] = (), distinct: str | None = None,
               ids: bool = False) -> DataFrame:
    """First row per key that is the ``threshold``-th within the window.

    Time is cut into cells as long as the window.  Such a row is always among the first N of its
    cell (the N-th row of a cell fires by itself), and what it looks back on is among those and
    the last N-1 rows of the cell before.  So every (key, cell) shrinks to 2N-1 rows before
    anything is brought together: Spark applies the row limit already before the shuffle, and no
    task ever holds more of a busy key.

    Output: key, ``us``, ``event_id``, ``event_count``, the ``keep`` columns of the firing row, and
    on request ``distinct_values`` of a column and the ``source_event_ids`` of the window.
    """
    columns = list(dict.fromkeys([key, us, event_id, *keep] + ([distinct] if distinct else [])))
    cells = _cells(df.where(F.col(key).isNotNull() & (F.col(key) != "")).select(*columns), us, window_us)
    up = Window.partitionBy(key, "_cell").orderBy(us, event_id)
    down = Window.partitionBy(key, "_cell").orderBy(F.desc(us), F.desc(event_id))
    head = (cells.withColumn("_n", F.row_number().over(up)).where(F.col("_n") <= threshold)
            .drop("_n").withColumn("_own", F.lit(True)))
    if threshold > 1:
        tail = (cells.withColumn("_n", F.row_number().over(down)).where(F.col("_n") <= threshold - 1)
                .drop("_n").withColumn("_cell", F.col("_cell") + 1).withColumn("_own", F.lit(False)))
        head = head.unionByName(tail)
    back = up.rowsBetween(-(threshold - 1), 0)
    extra = {}
    if distinct:
        extra["distinct_values"] = F.size(F.collect_set(distinct).over(back))
    if ids:
        extra["source_event_ids"] = F.collect_list(event_id).over(back)
    fired = (head.withColumns({"_since": F.lag(us, threshold - 1).over(up) if threshold > 1 else F.col(us),
                               **extra})
             .where(F.col("_own") & (F.col(us) - F.col("_since") <= window_us)))
    values = [c for c in columns if c != key] + list(extra)
    return (fired.groupBy(key)
            .agg(F.min_by(F.struct(*dict.fromkeys(values)), F.struct(us, event_id)).alias("_fire"))
            .select(key, "_fire.*").withColumn("event_count", F.lit(threshold)))


def _walk(candidates, length: int, threshold: int, skip: int) -> tuple[list[int], int]:
    """Fires among sorted candidate row numbers when the first ``skip`` rows do not count."""
    fires, allowed = [], skip + 1
    position = 0
    while True:
        position = candidates.searchsorted(allowed) if len(candidates) else 0
        if position >= len(candidates):
            return fires, max(0, allowed - 1 - length)
        fires.append(int(candidates[position]))
        allowed = fires[-1] + threshold


def all_fires(df: DataFrame, key: str, threshold: int, window_us: int, us: str = "us",
              event_id: str = "event_id") -> DataFrame:
    """Every fire when the window is emptied after each one.

    A row is a candidate when the row N-1 back lies in the window.  After a fire at row i the next
    fire is the first candidate at row i+N or later, so what a piece of a busy key hands on is
    only how many of the next rows do not count (0..N-1).  Each piece tabulates that for every
    value it may receive, the tables are chained per key, and the pieces then report their fires.
    """
    rows = df.where(F.col(key).isNotNull() & (F.col(key) != "")).select(key, us, event_id)
    order = [us, event_id]
    hot = hot_keys(rows, key)
    pieces = ordered_pieces(rows, key, order, hot)
    group = Window.partitionBy(key, "piece").orderBy(*order)
    context = with_carry(pieces, key, order, threshold - 1) if hot and threshold > 1 else \
        pieces.withColumn("carried", F.lit(False))
    since = F.lag(us, threshold - 1).over(group) if threshold > 1 else F.col(us)
    marked = (context.withColumns({"_since": since,
                                   "_row": F.sum(F.when(F.col("carried"), 0).otherwise(1)).over(group)})
              .where(~F.col("carried")))
    candidate = F.col(us) - F.col("_since") <= window_us
    found = marked.where(candidate).select(key, "piece", us, event_id, F.col("_row").cast("bigint"))
    if hot:
        lengths = pieces.where(F.col(key).isin(list(hot))).groupBy(key, "piece").agg(F.count(F.lit(1)).alias("_length"))
        entries = _chain(found.where(F.col(key).isin(list(hot))), lengths, key, threshold)
        found = found.join(F.broadcast(entries), [key, "piece"], "left").fillna(0, ["_skip"])
    else:
        found = found.withColumn("_skip", F.lit(0).cast("bigint"))

    def fires(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_row")
        hits, _ = _walk(pdf["_row"].to_numpy(), 0, threshold, int(pdf["_skip"].iloc[0]))
        return pdf[pdf["_row"].isin(hits)].drop(columns=["_row", "_skip", "piece"])

    schema = rows.select(key, us, event_id).schema
    return (found.groupBy(key, "piece")
            .applyInPandas(lambda pdf: fires(pdf)[[key, us, event_id]], schema)
            .withColumn("event_count", F.lit(threshold)))


def _chain(found: DataFrame, lengths: DataFrame, key: str, threshold: int) -> DataFrame:
    """Rows to skip at the start of every piece of the hot keys."""
    kind = found.schema[key].dataType.simpleString()

    def table(pdf: pd.DataFrame) -> pd.DataFrame:
        length = int(pdf["_length"].iloc[0])
        numbers = pdf["_row"].dropna().astype("int64").sort_values().to_numpy()
        exits = [_walk(numbers, length, threshold, skip)[1] for skip in range(threshold)]
        return pd.DataFrame({key: [pdf[key].iloc[0]], "piece": [pdf["piece"].iloc[0]], "_exits": [exits]})

    tables = (lengths.join(found.select(key, "piece", "_row"), [key, "piece"], "left")
              .groupBy(key, "piece").applyInPandas(table, f"{key} {kind}, piece int, _exits array<bigint>"))

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        skips, skip = [], 0
        pdf = pdf.sort_values("piece")
        for exits in pdf["_exits"]:
            skips.append(skip)
            skip = int(exits[skip])
        return pd.DataFrame({key: pdf[key], "piece": pdf["piece"], "_skip": skips})

    # one row per piece: at most as many rows per key as there are pieces
    return tables.groupBy(key).applyInPandas(walk, f"{key} {kind}, piece int, _skip bigint")


def first_distinct_fire(df: DataFrame, key: str, value: str, threshold: int, window_us: int,
                        us: str = "us", event_id: str = "event_id") -> DataFrame:
    """First row per key at which the window holds ``threshold`` different values.

    The count can only rise at the first row of a value in its cell, and only the last row of a
    value in the cell before can still be in the window.  Both are plain minima and maxima per
    (key, cell, value), combined before the shuffle; at most N of each per cell are kept.
    """
    cells = _cells(df.where(F.col(key).isNotNull() & (F.col(key) != "")), us, window_us)
    position = F.struct(F.col(us).alias("us"), F.col(event_id).alias("event_id"))
    spans = cells.groupBy(key, "_cell", F.col(value).alias("_value")).agg(
        F.min(position).alias("_first"), F.max(position).alias("_last"))
    up = Window.partitionBy(key, "_cell").orderBy("_first")
    down = Window.partitionBy(key, "_cell").orderBy(F.desc("_last"))
    own = (spans.withColumn("_n", F.row_number().over(up)).where(F.col("_n") <= threshold)
           .select(key, "_cell", "_value", F.col("_first").alias("_at"), F.lit(True).alias("_own")))
    before = (spans.withColumn("_n", F.row_number().over(down)).where(F.col("_n") <= threshold)
              .select(key, (F.col("_cell") + 1).alias("_cell"), "_value", F.col("_last").alias("_at"),
                      F.lit(False).alias("_own")))
    window = (Window.partitionBy(key, "_cell").orderBy("_us").rangeBetween(-window_us, 0))
    marked = (own.unionByName(before).withColumn("_us", F.col("_at.us"))
              # rows of the same microsecond are told apart by their id
              .withColumn("_seen", F.collect_list(F.struct("_at", "_value")).over(window))
              .where(F.col("_own"))
              .withColumn("distinct_values", F.size(F.array_distinct(F.transform(
                  F.filter("_seen", lambda s: s["_at"] <= F.col("_at")), lambda s: s["_value"]))))
              .where(F.col("distinct_values") >= threshold))
    return (marked.groupBy(key)
            .agg(F.min_by(F.struct(F.col("_at.us").alias("us"), F.col("_at.event_id").alias(event_id),
                                   "distinct_values"), F.col("_at")).alias("_fire"))
            .select(key, "_fire.*"))


def threshold_rules(df: DataFrame, rules, us: str = "us", event_id: str = "event_id") -> DataFrame:
    """First fire of every threshold rule; a rule is a row of ``fixed.THRESHOLD_RULES``.

    Rules are few and known when the plan is built, so each becomes its own filter.
    """
    out = None
    for number, name, column, value, group_by, threshold, seconds, severity, text in rules:
        fire = first_fire(df.where(F.col(column) == value), group_by, threshold, seconds * SECOND,
                          us, event_id, ids=True)
        fire = fire.select(F.lit(number).alias("rule_id"), F.lit(name).alias("rule_name"),
                           F.lit(severity).alias("severity"), F.lit(text).alias("description"),
                           F.col(group_by).alias("group_key"), us, event_id, "event_count", "source_event_ids")
        out = fire if out is None else out.unionByName(fire)
    return out


def fallback_alerts(df: DataFrame, failures: Column | None = None, denies: Column | None = None,
                    window_us: int = 300 * SECOND, us: str = "us", event_id: str = "event_id") -> DataFrame:
    """Alerts used without a rule file: 5 failed logins or 10 denies per address, one per address."""
    failures = F.col("action") == "LOGIN_FAILED" if failures is None else failures
    denies = F.col("action") == "DENY" if denies is None else denies
    plans = [(failures, 5, "Brute Force Attack", "CRITICAL", "Multiple failed logins detected from "),
             (denies, 10, "Port Scan Detected", "HIGH", "High frequency of blocked connections from ")]
    out = None
    for condition, threshold, name, severity, text in plans:
        fire = first_fire(df.where(condition), "src_ip", threshold, window_us, us, event_id, ids=True)
        fire = fire.select(F.lit(name).alias("rule_name"), F.lit(severity).alias("severity"), "src_ip",
                           F.concat(F.lit(text), "src_ip").alias("description"), us, event_id,
                           "event_count", "source_event_ids")
        out = fire if out is None else out.unionByName(fire)
    return out


def last_ids(ids, n: int) -> Column:
    """Last ``n`` entries of an array, all of them when it is shorter."""
    a = F.col(ids) if isinstance(ids, str) else ids
    return F.slice(a, F.greatest(F.lit(1), F.size(a) - n + 1), F.lit(n))
