"""Ordered work on keys of any size.

Window functions and grouped pandas functions put one key into one task.  When a single
source or register holds a large share of the rows that task becomes the job.  The helpers
here find such keys by a map-side combined count, cut their rows into contiguous pieces by a
range shuffle, and carry the few rows that the next piece needs over the cut.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from vigil.session import durable

# Rows of one key that a single task may sort.  Set spark.vigil.rowsPerTask to change it.
ROWS_PER_TASK = 5_000_000
MAX_HOT_KEYS = 10_000


def rows_per_task(spark) -> int:
    return int(spark.conf.get("spark.vigil.rowsPerTask", str(ROWS_PER_TASK)))


def hot_keys(df: DataFrame, key: str) -> dict:
    """Keys holding more rows than one task should sort, with their counts.

    The result holds at most ``MAX_HOT_KEYS`` keys: keys beyond the largest ten thousand each
    hold less than a ten-thousandth of the rows.
    """
    counts = (df.groupBy(key).count()
              .where(F.col("count") > rows_per_task(df.sparkSession))
              .where(F.col(key).isNotNull())
              .orderBy(F.desc("count")).limit(MAX_HOT_KEYS))
    return {r[0]: r[1] for r in counts.collect()}


def ordered_pieces(df: DataFrame, key: str, order: list[str], hot: dict) -> DataFrame:
    """Add ``piece``: 0 for ordinary keys, consecutive range pieces for the hot ones.

    Rows of piece ``p`` all sort before rows of piece ``p + 1`` of the same key.  The pieces are
    written to the checkpoint folder so that every later use sees the same cut.
    """
    if not hot:
        return df.withColumn("piece", F.lit(0))
    is_hot = F.col(key).isin(list(hot))
    pieces = max(2, -(-2 * sum(hot.values()) // rows_per_task(df.sparkSession)))
    split = durable(df.where(is_hot).repartitionByRange(int(pieces), key, *order)
                    .withColumn("piece", F.spark_partition_id()))
    rest = df.where(~is_hot | F.col(key).isNull()).withColumn("piece", F.lit(0))
    return rest.unionByName(split)


def with_carry(pieces: DataFrame, key: str, order: list[str], rows: int) -> DataFrame:
    """Add ``carried``: every piece also gets the last ``rows`` rows before it, marked true."""
    last = Window.partitionBy(key, "piece").orderBy(*[F.desc(c) for c in order])
    columns = [c for c in pieces.columns if c not in (key, "piece")]
    tails = (pieces.withColumn("_back", F.row_number().over(last))
             .where(F.col("_back") <= rows)
             .groupBy(key, "piece")
             .agg(F.sort_array(F.collect_list(F.struct(*order, *[c for c in columns if c not in order])))
                  .alias("_tail")))
    # each piece present holds at least one row, so `rows` pieces back are always enough
    before = Window.partitionBy(key).orderBy("piece").rowsBetween(-rows, -1)
    carried = (tails.withColumn("_rows", F.flatten(F.collect_list("_tail").over(before)))
               .where(F.size("_rows") > 0)
               .select(key, "piece",
                       F.expr(f"explode(slice(_rows, greatest(1, size(_rows) - {rows} + 1), {rows}))")
                       .alias("_row"))
               .select(key, "piece", "_row.*").withColumn("carried", F.lit(True)))
    return pieces.withColumn("carried", F.lit(False)).unionByName(carried)


def lag_columns(df: DataFrame, key: str, order: list[str], lags: dict[str, tuple[str, int]]) -> DataFrame:
    """``lag`` per key without one task per key.

    ``lags`` maps a new column to ``(source column, number of rows back)``.
    """
    hot = hot_keys(df, key)
    if not hot:
        window = Window.partitionBy(key).orderBy(*order)
        return df.withColumns({n: F.lag(c, k).over(window) for n, (c, k) in lags.items()})
    depth = max(k for _, k in lags.values())
    pieces = with_carry(ordered_pieces(df, key, order, hot), key, order, depth)
    window = Window.partitionBy(key, "piece").orderBy(*order)
    return (pieces.withColumns({n: F.lag(c, k).over(window) for n, (c, k) in lags.items()})
            .where(~F.col("carried")).drop("carried", "piece"))


def per_key(df: DataFrame, key: str, compute) -> DataFrame:
    """Run ``compute(rows, least)`` with a per-key minimum that suits the key's size.

    ``least(rows, name, value)`` adds the per-key minimum of the expression ``value``.  Ordinary
    keys use a window over the key, all steps sharing one shuffle.  Hot keys, of which there are
    few, aggregate with map-side combine and broadcast the one row per key back.
    """
    def by_window(rows: DataFrame, name: str, value: Column) -> DataFrame:
        return rows.withColumn(name, F.min(value).over(Window.partitionBy(key)))

    def by_broadcast(rows: DataFrame, name: str, value: Column) -> DataFrame:
        least = rows.groupBy(F.col(key).alias("_key")).agg(F.min(value).alias(name))
        return rows.join(F.broadcast(least), F.col(key) == F.col("_key"), "left").drop("_key")

    hot = hot_keys(df, key)
    if not hot:
        return compute(df, by_window)
    is_hot = F.col(key).isin(list(hot))
    parts = [compute(df.where(~is_hot | F.col(key).isNull()), by_window),
             compute(df.where(is_hot), by_broadcast)]
    return reduce(DataFrame.unionByName, parts)


def _scan_pieces(df: DataFrame, key: str, order: list[str], hot: dict, merge, start, earlier=None) -> DataFrame:
    """Running values per key: within each piece, then combined with what earlier pieces hold.

    ``merge`` is the aggregate (``F.max`` or ``F.sum``); ``start`` maps a new column to the value it
    runs over, and ``earlier`` those that end at the row before.
    """
    pieces = ordered_pieces(df, key, order, hot)
    inside = Window.partitionBy(key, "piece").orderBy(*order)
    ends = {**dict.fromkeys(start, 0), **dict.fromkeys(earlier or {}, -1)}
    start = {**start, **(earlier or {})}
    local = pieces.withColumns({f"_in_{n}": merge(v).over(inside.rowsBetween(Window.unboundedPreceding, ends[n])) for n, v in start.items()})
    # one row per piece of a hot key
    totals = (pieces.where(F.col(key).isin(list(hot))).groupBy(key, "piece")
              .agg(*[merge(v).alias(f"_all_{n}") for n, v in start.items()]))
    before = Window.partitionBy(key).orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(key, "piece", *[merge(f"_all_{n}").over(before).alias(f"_off_{n}") for n in start])
    out = local.join(F.broadcast(offsets), [key, "piece"], "left")
    combine = F.greatest if merge is F.max else (lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)))
    return out.select(*df.columns, *[combine(F.col(f"_in_{n}"), F.col(f"_off_{n}")).alias(n) for n in start])


def running(df: DataFrame, key: str, order: list[str], merge, start: dict[str, Column], earlier: dict[str, Column] | None = None) -> DataFrame:
    """Running ``F.max`` or ``F.sum`` per key without one task per key; those in ``earlier`` end at the row before."""
    hot = hot_keys(df, key)
    if hot:
        return _scan_pieces(df, key, order, hot, merge, start, earlier)
    inside = Window.partitionBy(key).orderBy(*order)
    return df.withColumns({n: merge(v).over(inside.rowsBetween(Window.unboundedPreceding, end))
                           for end, values in ((0, start), (-1, earlier or {})) for n, v in values.items()})


def rows_in_window(df: DataFrame, key: str, window_us: int, name: str, us: str = "us",
                   row_id: str = "event_id") -> DataFrame:
    """Add the number of rows of the key in ``[us - window, us]`` up to the row itself.

    For a hot key the count is the row's place minus the number of rows older than the window.  The
    latter is read off by a probe row placed at the start of the window, so both are running
    counts over evenly cut pieces.
    """
    hot = hot_keys(df, key)
    is_hot = F.col(key).isin(list(hot))
    frame = Window.partitionBy(key).orderBy(us).rangeBetween(-window_us, 0)
    peers = Window.partitionBy(key, us)
    # a range frame includes later rows of the same moment: take those off again
    same = F.count(F.lit(1)).over(peers) - F.row_number().over(peers.orderBy(row_id))
    cold = df.where(~is_hot | F.col(key).isNull()) if hot else df
    cold = cold.withColumn(name, (F.count(F.lit(1)).over(frame) - same).cast("bigint"))
    if not hot:
        return cold
    # a number of its own for each row: ids may repeat
    rows = durable(df.where(is_hot).withColumn("_row", F.monotonically_increasing_id()))
    probes = rows.select(key, (F.col(us) - window_us).alias(us), F.lit(0).alias("_probe_last"),
                         row_id, "_row", F.lit(0).alias("_counts"))
    marks = rows.select(key, us, F.lit(1).alias("_probe_last"), row_id, "_row", F.lit(1).alias("_counts"))
    # probes come before rows of the same moment, so rows exactly at the edge still count
    counted = _scan_pieces(probes.unionByName(marks), key, [us, "_probe_last", row_id, "_row"], hot, F.sum,
                           {"_n": F.col("_counts")})
    # a row's count is its place less the rows before its window: one sum over its two marks
    sign = F.when(F.col("_counts") == 1, F.col("_n")).otherwise(-F.col("_n"))
    both = counted.groupBy("_row").agg(F.sum(sign).cast("bigint").alias(name))
    return cold.unionByName(rows.join(both, "_row").drop("_row"))


def positions(df: DataFrame, order: list[str], name: str = "position") -> DataFrame:
    """Add the place (from 1) of every row in the given order, without gathering the rows in one task.

    The rows are range-partitioned and sorted once and written; one count per range is added up.
    """
    cut = durable(df.repartitionByRange(*order).sortWithinPartitions(*order)
                  .withColumn("_range", F.spark_partition_id())
                  .withColumn("_place", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    counts = cut.groupBy("_range").agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)     # one row per range
    starts = counts.select("_range", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    return (cut.join(F.broadcast(starts), "_range")
            .withColumn(name, F.col("_start") + F.col("_place") + 1).drop("_range", "_place", "_start"))
