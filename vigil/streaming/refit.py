"""Models that are fitted anew while a stream is scored by them."""

from __future__ import annotations

import logging
import time as clock

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, functions as F

from vigil.operators import ml
from vigil.streaming.twins import retraining_due, stored_features

VERSION = "version int, batch bigint, fitted_at double, rows bigint"
LOG = logging.getLogger(__name__)


def versions(spark, models: str) -> DataFrame:
    """All versions of a model table, none if nothing has been published."""
    try:
        return spark.read.schema(VERSION).parquet(f"{models}/versions")
    except AnalysisException:
        return spark.createDataFrame([], VERSION)


def newest(spark, models: str):
    """The row of the version in force, or None."""
    return versions(spark, models).orderBy(F.desc("version")).first()


def publish(spark, models: str, forest: ml.Forest, batch: int, fitted_at: float, rows: int) -> int:
    """Write a version and then point to it.

    The model goes to a folder of its own; what makes it the newest is one row in one file, which appears as a whole or
    not at all.  Readers hold the old version until then.
    """
    last = newest(spark, models)
    number = last["version"] + 1 if last else 1
    ml.save_forest(spark, forest, f"{models}/model={number}")
    spark.createDataFrame([(number, batch, float(fitted_at), rows)], VERSION).coalesce(1).write.mode("append").parquet(f"{models}/versions")
    return number


def in_force(spark, models: str):
    """(version, forest) that rows are scored by now; (0, None) without one."""
    last = newest(spark, models)
    return (last["version"], ml.load_forest(spark, f"{models}/model={last['version']}")) if last else (0, None)


def scored_and_refitted(features: DataFrame, columns: list[str], row_id: str, order: str, folder: str, needed: int = 50, every: float = 300,
                        last: int = 1000, minimum: int = ml.MINIMUM_ROWS, now=clock.time, fit=ml.fit_forest):
    """Start a query that scores every batch by the model in force and fits a new one when it is due.

    Below ``folder`` it keeps ``scored`` (rows with score, flag and ``model_version``), ``features`` and ``models``.  A fit is
    due after ``needed`` rows and more than ``every`` seconds since the last one; it takes the newest ``last`` rows and
    refuses fewer than ``minimum``.  A fit that fails leaves the model in force.  A repeated batch overwrites its own rows
    and does not fit again what it has fitted before.
    """
    models = f"{folder}/models"

    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        version, forest = in_force(spark, models)
        rows.write.mode("overwrite").parquet(f"{folder}/features/batch={number}")
        kept = spark.read.schema(rows.schema).parquet(f"{folder}/features/batch={number}")
        ml.score_forest(kept, forest).withColumn("model_version", F.lit(version)).write.mode("overwrite").parquet(f"{folder}/scored/batch={number}")
        before = newest(spark, models)
        if before and before["batch"] >= number:
            return
        fresh = spark.read.parquet(f"{folder}/features").where(F.col("batch") > (before["batch"] if before else -1)).count()
        if not retraining_due(fresh, before["fitted_at"] if before else 0.0, now(), needed, every):
            return
        try:
            sample = stored_features(spark, f"{folder}/features", order, last)
            forest = fit(sample, columns, row_id, minimum=minimum)
            publish(spark, models, forest, number, now(), sample.count())
        except Exception as error:      # the stream goes on with the model it has
            LOG.warning("no new model after batch %s: %s", number, error)

    return (features.writeStream.foreachBatch(batch).option("checkpointLocation", f"{folder}/state")
            .trigger(availableNow=True).start())
