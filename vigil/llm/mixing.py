"""Mixing sources to target weights by hash-random order and distributed prefix sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil.llm.common import numbered, stored, text_of, word_count

WEIGHTS = (3, 1, 2)
SHARE = 1.5
LIMIT = 2.0
BUCKET_ROWS = 5_000


def targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, limit: float = LIMIT) -> DataFrame:
    """``sources`` (source, source_size, n_rows) with the target of each.

    Sources in code-point order, null last, take ``weights`` in turn and divide ``share`` times the
    whole size; a target above ``limit`` times its source stops there and the excess goes to the
    others by weight, until none is above.  Each round is one sum over the sources.
    """
    ranked = numbered(sources, F.col("source").asc_nulls_last())
    weighed = stored(ranked.select(
        "source", "source_size", "n_rows", (limit * F.col("source_size")).alias("_most"),
        F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                     (F.col("position") % len(weights) + 1).cast("int")).alias("_weight")))
    total = share * (weighed.agg(F.sum("source_size")).first()[0] or 0)
    level, capped = 0.0, -1
    at_most = F.lit(False)
    while True:
        n, spent, weight = weighed.agg(
            F.count(F.when(at_most, 1)), F.sum(F.when(at_most, F.col("_most"))),
            F.sum(F.when(~at_most, F.col("_weight")))).first()
        if n == capped or not weight:
            break
        capped, level = n, (total - (spent or 0.0)) / weight
        at_most = F.lit(level) * F.col("_weight") > F.col("_most")
    # the last level holds for all that are not capped at it
    target = F.when(F.lit(level) * F.col("_weight") > F.col("_most"), F.col("_most")).otherwise(
        F.lit(level) * F.col("_weight"))
    return weighed.select("source", "source_size", "n_rows", target.alias("target"))


def mix(docs: DataFrame, size: Column | None = None, weights=WEIGHTS, share: float = SHARE,
        limit: float = LIMIT, seed: str = "", keep_rows: bool = False, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """How much of every document the mix takes.

    ``docs`` has doc_id, source and text.  Returns doc_id, size (words of the text, or ``size``),
    source_size, target (of its source) and taken: whole epochs, plus one more for the documents that
    come first by MD5 of (seed, doc_id) up to what is left of the source's budget.  The document at
    the cut is taken if at least half of it lies before the cut, so a source misses its target by
    half a document at most.  With ``keep_rows`` the input row comes along as the struct ``row``.

    Null text has size 0, null doc_id hashes as an empty text, null source is a source of its own;
    repeated rows count and are placed one by one.  Extra columns do not matter.  An empty table
    gives an empty result.  The order of a source is cut into key ranges of about ``bucket_rows``
    rows; only one sum per range is added up, so a source of any size is spread over many tasks.
    """
    words = word_count(text_of()) if size is None else size
    columns = [F.col("doc_id"), F.col("source"), F.coalesce(words.cast("long"), F.lit(0)).alias("size"),
               F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).alias("_key")]
    if keep_rows:
        columns.append(F.struct("*").alias("row"))
    sized = stored(docs.select(*columns))
    per_source = stored(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_rows")))
    goal = stored(targets(per_source, weights, share, limit)
                  .withColumn("_ranges", F.ceil(F.col("n_rows") / bucket_rows)).drop("n_rows")
                  .withColumnRenamed("source", "_source"))
    share_of_keys = F.conv(F.substring("_key", 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))
    placed = (sized.join(goal, F.col("source").eqNullSafe(F.col("_source")))
              .withColumn("_range", F.floor(share_of_keys * F.col("_ranges"))))
    sums = stored(placed.groupBy("_source", "_range").agg(F.sum("size").alias("_sum")))
    before = sums.select(
        F.col("_source").alias("_s"), F.col("_range").alias("_r"),
        F.coalesce(F.sum("_sum").over(Window.partitionBy("_source").orderBy("_range")
                                      .rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_source", "_range").orderBy("_key", "doc_id", "size").rowsBetween(
        Window.unboundedPreceding, -1)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    return (placed.withColumn("_inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
            .join(before, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_range") == F.col("_r")))
            .withColumn("_epochs", epochs)
            .withColumn("_rest", F.col("target") - F.col("_epochs") * F.col("source_size"))
            .withColumn("_middle", F.col("_before") + F.col("_inside") + F.col("size") / 2)
            .select("doc_id", "size", "source_size", "target",
                    (F.col("size") * (F.col("_epochs") + (F.col("_middle") <= F.col("_rest")).cast("int"))).alias("taken"),
                    *(["row"] if keep_rows else [])))


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` as the mix takes them: repeated, once, or not at all.

    A document without words is in no source's budget and is left out.
    """
    plan = mix(docs, keep_rows=True, **options)
    times = F.when(F.col("size") > 0, (F.col("taken") / F.col("size")).cast("int")).otherwise(F.lit(0))
    return (plan.where(times > 0).select("row", F.explode(F.sequence(F.lit(1), times)).alias("_copy"))
            .select("row.*"))


#: The same plan for DuckDB.
ORACLE = """
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '')) AS key
  FROM documents),
sources AS (
  SELECT source, sum(size)::DOUBLE AS s, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3
         WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS w
  FROM sized GROUP BY source),
steps AS (
  SELECT *, row_number() OVER o AS k,
         (1.5::DOUBLE * sum(s) OVER () - coalesce(sum(2 * s) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM sources WINDOW o AS (ORDER BY 2 * s / w, source NULLS LAST)),
lev AS (SELECT level FROM steps WHERE level * w <= 2 * s ORDER BY k LIMIT 1),
goals AS (
  SELECT source, s, CASE WHEN (SELECT level FROM lev) IS NULL OR (SELECT level FROM lev) * w > 2 * s THEN 2 * s
         ELSE (SELECT level FROM lev) * w END AS target FROM sources),
placed AS (
  SELECT d.doc_id, d.size, g.s::BIGINT AS source_size, g.target,
         CASE WHEN g.s > 0 THEN floor(g.target / g.s)::BIGINT ELSE 0 END AS epochs,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM sized d JOIN goals g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
       (size * (epochs + (before + size / 2.0::DOUBLE <= target - epochs * source_size)::INT))::BIGINT AS taken
FROM placed
"""
