"""Models fitted while a stream runs."""

import random

from vigil.operators import ml
from vigil.streaming import refit
from test_streaming import stream

COLUMNS = ["a", "b"]


def features(spark, n=300):
    rng = random.Random(1)
    return spark.createDataFrame([(k, rng.gauss(0, 1), rng.gauss(0, 1)) for k in range(n)], "row long, a double, b double")


def run(spark, df, tmp_path, **options):
    started = refit.scored_and_refitted(stream(spark, df, tmp_path, files=5, order="row"), COLUMNS, "row", "row", str(tmp_path / "out"), **options)
    assert started.awaitTermination(240) is not False and started.exception() is None
    scored = spark.read.parquet(str(tmp_path / "out" / "scored"))
    used = {r.batch: r.model_version for r in scored.select("batch", "model_version").distinct().collect()}
    return scored, used, [tuple(r) for r in refit.versions(spark, str(tmp_path / "out" / "models")).orderBy("version").select("version", "batch", "rows").collect()]


def test_next_batch_follows_the_new_version(spark, tmp_path):
    """Sixty rows a batch: the first is due but too small to fit, the second fits, later ones are scored by it."""
    ticks = iter(range(1000, 10_000, 50))
    scored, used, found = run(spark, features(spark), tmp_path, now=lambda: next(ticks), last=100)
    assert scored.count() == 300 and used[0] == used[1] == 0 and used[2] == 1
    assert found[0] == (1, 1, 100) and scored.where("model_version = 0 AND (score <> 0 OR is_anomaly)").count() == 0
    version, forest = refit.in_force(spark, str(tmp_path / "out" / "models"))
    assert version == len(found) and forest.features == COLUMNS
    assert scored.where("model_version > 0 AND score > 0").count() == 60 * sum(v > 0 for v in used.values())


def test_a_failed_fit_leaves_the_old_model(spark, tmp_path):
    calls, ticks = [], iter(range(1000, 100_000, 500))

    def fit(*args, **options):
        calls.append(1)
        if len(calls) == 3:
            raise RuntimeError("broken")
        return ml.fit_forest(*args, trees=5, **options)
    _, used, found = run(spark, features(spark), tmp_path, now=lambda: next(ticks), fit=fit)
    # batch 0 has too few rows, batch 1 fits, batch 2 fails, batch 3 and 4 fit
    assert used == {0: 0, 1: 0, 2: 1, 3: 1, 4: 2} and [v[:2] for v in found] == [(1, 1), (2, 3), (3, 4)]


def test_a_repeated_batch_fits_once(spark, tmp_path):
    models, forest = str(tmp_path / "models"), ml.fit_forest(features(spark, 120), COLUMNS, "row", trees=3)
    assert refit.in_force(spark, models) == (0, None) and refit.newest(spark, models) is None
    assert refit.publish(spark, models, forest, 4, 1.0, 120) == 1 and refit.publish(spark, models, forest, 9, 2.0, 120) == 2
    assert refit.newest(spark, models)["batch"] == 9
