"""Feature tables and outlier models fitted and scored on Spark."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from vigil import fixed
from vigil.functions.network import is_internal
from vigil.session import durable

MINIMUM_ROWS = 100


# ------------------------------------------------------------------ features

def _code(column: str, codes: dict) -> Column:
    table = F.create_map(*[F.lit(v) for pair in codes.items() for v in pair])
    return F.coalesce(F.try_element_at(table, F.col(column)), F.lit(0)).cast("double")


def _given(column: str) -> Column:
    return (F.coalesce(F.col(column), F.lit("")) != "").cast("double")


def _bucket(column: str) -> Column:
    """Stable stand-in for a text: one of a thousand steps in [0, 1)."""
    return F.conv(F.substring(F.md5(F.coalesce(column, F.lit(""))), 1, 8), 16, 10).cast("long") % 1000 / 1000.0


def event_features(events: DataFrame, time: str = "event_time") -> DataFrame:
    """Seventeen numbers per event.  An unreadable time gives zeros."""
    moment = lambda value: F.coalesce(value.cast("double"), F.lit(0.0))
    t = F.col(time)
    number = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("double")
    user = F.coalesce(F.col("username"), F.lit(""))
    values = {
        "severity": number("severity"), "has_src_ip": _given("src_ip"), "has_dst_ip": _given("dst_ip"),
        "src_port": number("src_port"), "dst_port": number("dst_port"), "protocol": _code("protocol", fixed.PROTOCOL_CODES),
        "action": _code("action", fixed.ACTION_CODES), "event_type_hash": _bucket("event_type"),
        "source_type_hash": _bucket("source_type"), "has_username": (~user.isin("", "-")).cast("double"),
        "metadata_length": F.length(F.concat_ws(",", "uri", "domain", F.col("status_code").cast("string"),
                                                F.col("bytes").cast("string"))).cast("double"),
        "status_code": number("status_code"), "bytes": number("bytes"), "hour": moment(F.hour(t)),
        "weekday": moment(F.weekday(t)), "day": moment(F.day(t)), "month": moment(F.month(t))}
    return events.select("event_id", *[values[n].alias(n) for n in fixed.EVENT_FEATURES])


def packet_features(packets: DataFrame, time: str = "event_time") -> DataFrame:
    """Thirteen numbers per packet."""
    protocol = F.upper("protocol")
    payload = F.coalesce(F.col("payload"), F.lit(""))
    t = F.col(time)
    moment = lambda value: F.coalesce(value.cast("double"), F.lit(0.0))
    values = {
        "packet_size": F.col("size").cast("double"), "src_port": F.col("src_port").cast("double"),
        "dst_port": F.col("dst_port").cast("double"),
        **{f"is_{p.lower()}": (protocol == p).cast("double") for p in ("TCP", "UDP", "ICMP", "ARP")},
        "has_payload": (payload != "").cast("double"), "payload_length": F.length(payload).cast("double"),
        "src_ip_internal": is_internal("src_ip").cast("double"), "dst_ip_internal": is_internal("dst_ip").cast("double"),
        "hour_of_day": moment(F.hour(t)), "day_of_week": moment(F.weekday(t))}
    return packets.select("packet_id", *[values[n].alias(n) for n in fixed.PACKET_FEATURES])


def require_rows(df: DataFrame, minimum: int = MINIMUM_ROWS) -> None:
    """Refuse to fit on too little data."""
    if df.limit(minimum).count() < minimum:
        raise ValueError(f"at least {minimum} rows are needed to fit a model")


# ------------------------------------------------------------------ scaling

def scaling(df: DataFrame, features: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and population spread per feature (a spread of 0 counts as 1); one row leaves the cluster."""
    row = df.agg(*[F.avg(f).alias(f"m{n}") for n, f in enumerate(features)],
                 *[F.stddev_pop(f).alias(f"s{n}") for n, f in enumerate(features)]).first()
    return {f: (row[f"m{n}"], row[f"s{n}"] or 1.0) for n, f in enumerate(features)}


def scale(df: DataFrame, stats: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({f: (F.col(f) - F.lit(m)) / F.lit(s) for f, (m, s) in stats.items()})


# ------------------------------------------------------------------ isolation forest

NODES = "tree int, node int, feature int, threshold double, left int, right int, size int"


@dataclass
class Forest:
    """Fitted forest: a small node table, the sample size and the score that flags."""
    nodes: pd.DataFrame
    sample: int
    threshold: float
    features: list[str]


def _average_path(n) -> np.ndarray:
    """Average depth of an unsuccessful search among n rows."""
    n = np.asarray(n, dtype="float64")
    harmonic = np.log(np.maximum(n - 1, 1)) + 0.5772156649015329
    return np.where(n > 2, 2 * harmonic - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


def _grow(tree: int, x: np.ndarray, depth_limit: int) -> pd.DataFrame:
    rng = np.random.default_rng(tree)
    out, todo = [], [(0, np.arange(len(x)), 0)]
    used = 1
    while todo:
        node, rows, depth = todo.pop()
        part = x[rows]
        low, high = part.min(axis=0), part.max(axis=0)
        open_features = np.flatnonzero(high > low)
        if depth >= depth_limit or len(rows) <= 1 or not len(open_features):
            out.append((tree, node, -1, 0.0, -1, -1, len(rows)))
            continue
        f = int(rng.choice(open_features))
        cut = float(rng.uniform(low[f], high[f]))
        below = part[:, f] < cut
        out.append((tree, node, f, cut, used, used + 1, len(rows)))
        todo += [(used, rows[below], depth + 1), (used + 1, rows[~below], depth + 1)]
        used += 2
    return pd.DataFrame(out, columns=["tree", "node", "feature", "threshold", "left", "right", "size"])


def _packed(nodes: pd.DataFrame) -> list[tuple]:
    """(feature, cut, left, path length, depth) of every tree, made once for all rows.

    The right child stands behind the left one.  A leaf compares with NaN, which nothing is below, and names the
    node in front of it as its left child, so that a row that has come there stays.
    """
    out = []
    for _, tree in nodes.groupby("tree"):
        tree = tree.sort_values("node")
        feature, left, right = (tree[c].to_numpy(np.int32) for c in ("feature", "left", "right"))
        leaf, depth = feature < 0, np.zeros(len(tree))
        for k in np.flatnonzero(~leaf):                 # children have larger numbers
            depth[[left[k], right[k]]] = depth[k] + 1
        if (right != left + 1)[~leaf].any():
            raise ValueError("a right child does not stand behind the left one")
        out.append((np.where(leaf, 0, feature).astype(np.int32), np.where(leaf, np.nan, tree["threshold"].to_numpy()),
                    np.where(leaf, np.arange(len(tree)) - 1, left).astype(np.int32),
                    depth + _average_path(tree["size"].to_numpy()), int(depth.max())))
    return out


def _depths(trees: list[tuple], x: np.ndarray) -> np.ndarray:
    """Mean path length of every row over all packed trees, level by level."""
    n = len(x)
    values, row, total = np.ascontiguousarray(x.T).ravel(), np.arange(n), np.zeros(n)
    for feature, cut, left, length, depth in trees:
        first, at = feature.astype(np.int64) * n, np.zeros(n, np.int32)
        for _ in range(depth):
            below = values.take(first.take(at) + row) < cut.take(at)
            at = left.take(at) + ~below
        total += length.take(at)
    return total / max(len(trees), 1)


def grow_forest(df: DataFrame, features: list[str], row_id: str, trees: int = 100, sample: int = 256,
                minimum: int = MINIMUM_ROWS) -> Forest:
    """Isolation forest without a limit yet: every tree is grown in its own task from its own small sample.

    Each tree's sample are the rows with the smallest hashes of (row, tree) among all rows.  A row only
    enters a tree's draw below a cut that leaves about eight times the sample, so few leave their task;
    the same data always gives the same forest.
    """
    require_rows(df, minimum)
    rows = df.count()
    cut = int(-(1 << 63) + min(1.0, 8 * sample / max(rows, 1)) * ((1 << 64) - 1))
    low = F.filter(F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.struct(
        t.alias("tree"), F.xxhash64(F.col(row_id), t).alias("_h"))), lambda x: x["_h"] <= F.lit(min(cut, (1 << 63) - 1)))
    drawn = df.select(row_id, *features, F.inline(low))
    depth = math.ceil(math.log2(sample))

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        few = pdf.nsmallest(sample, ["_h", row_id])
        return _grow(int(pdf["tree"].iloc[0]), few[features].to_numpy("float64"), depth)

    nodes = drawn.groupBy("tree").applyInPandas(grow, NODES).toPandas()     # at most 511 nodes per tree
    return Forest(nodes, sample, 1.0, features)


def limit(scored: DataFrame, score: str, share: float = 0.1) -> float:
    """The score above which ``share`` of the rows lie."""
    return float(scored.agg(F.percentile_approx(score, 1 - share, 10_000)).first()[0])


def fit_forest(df: DataFrame, features: list[str], row_id: str, trees: int = 100, sample: int = 256,
               contamination: float = 0.1, minimum: int = MINIMUM_ROWS) -> Forest:
    """Forest whose limit leaves the share ``contamination`` of the rows above it."""
    forest = grow_forest(df, features, row_id, trees, sample, minimum)
    return replace(forest, threshold=limit(with_score(df, forest), "score", contamination))


def fit_and_score(df: DataFrame, features: list[str], row_id: str, keep: list[str] | None = None, contamination: float = 0.1,
                  **options) -> tuple[Forest, DataFrame]:
    """The forest of :func:`fit_forest` and its :func:`score_forest`, with every row scored once.

    Scores are written with the columns ``keep`` (all if not named), and the limit is taken from them.
    """
    forest = grow_forest(df, features, row_id, **options)
    scored = durable(with_score(df, forest).select(*(keep or df.columns), "score"))
    forest = replace(forest, threshold=limit(scored, "score", contamination))
    return forest, scored.withColumn("is_anomaly", F.col("score") > F.lit(forest.threshold))


def with_score(df: DataFrame, forest: Forest) -> DataFrame:
    """Add ``score`` in 0..1, larger for rows that few cuts set apart."""
    trees = df.sparkSession.sparkContext.broadcast(_packed(forest.nodes))
    norm = float(_average_path(forest.sample))

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for pdf in batches:
            x = pdf.to_numpy("float64")
            yield pd.Series(np.power(2.0, -_depths(trees.value, x) / norm))

    return df.withColumn("score", score(F.struct(*forest.features)))


def score_forest(df: DataFrame, forest: Forest | None) -> DataFrame:
    """Add ``score`` in 0..1 and ``is_anomaly``; without a model nothing is anomalous."""
    if forest is None:
        return df.withColumns({"score": F.lit(0.0), "is_anomaly": F.lit(False)})
    return with_score(df, forest).withColumn("is_anomaly", F.col("score") > F.lit(forest.threshold))


def training_summary(scored: DataFrame) -> DataFrame:
    return scored.agg(F.count(F.lit(1)).alias("samples"), F.avg("score").alias("avg_score"),
                      F.stddev_pop("score").alias("std_score"), F.min("score").alias("min_score"),
                      F.max("score").alias("max_score"), F.count_if("is_anomaly").alias("anomalies"))


def save_forest(spark, forest: Forest, path: str) -> None:
    """Write node table and settings as Parquet tables."""
    spark.createDataFrame(forest.nodes, NODES).coalesce(1).write.mode("overwrite").parquet(f"{path}/nodes")
    meta = [(forest.sample, forest.threshold, forest.features)]
    spark.createDataFrame(meta, "sample int, threshold double, features array<string>") \
        .coalesce(1).write.mode("overwrite").parquet(f"{path}/settings")


def load_forest(spark, path: str) -> Forest:
    meta = spark.read.parquet(f"{path}/settings").first()
    return Forest(spark.read.parquet(f"{path}/nodes").toPandas(), meta["sample"], meta["threshold"], list(meta["features"]))


# ------------------------------------------------------------------ one-class boundary

@dataclass
class Boundary:
    """Mean embedding of the training rows under random Fourier features of an RBF kernel."""
    weights: np.ndarray
    phases: np.ndarray
    centre: np.ndarray
    threshold: float
    features: list[str]


def _embed(x: np.ndarray, weights: np.ndarray, phases: np.ndarray) -> np.ndarray:
    return np.sqrt(2.0 / len(phases)) * np.cos(x @ weights + phases)


def centre_boundary(scaled: DataFrame, features: list[str], size: int = 64) -> Boundary:
    """Boundary around the mean embedding of the rows, without a limit yet."""
    rng = np.random.default_rng(7)
    weights = rng.normal(0.0, math.sqrt(2.0 / len(features)), (len(features), size))
    phases = rng.uniform(0.0, 2 * math.pi, size)

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros(size), 0
        for pdf in batches:
            total += _embed(pdf[features].to_numpy("float64"), weights, phases).sum(axis=0)
            n += len(pdf)
        yield pd.DataFrame({"place": np.arange(size), "total": total, "n": n})

    # one partial sum per task and feature
    rows = (scaled.select(*features).mapInPandas(sums, "place int, total double, n bigint")
            .groupBy("place").agg((F.sum("total") / F.sum("n")).alias("mean")).orderBy("place").collect())
    return Boundary(weights, phases, np.array([r["mean"] for r in rows]), math.inf, features)


def fit_boundary(scaled: DataFrame, features: list[str], size: int = 64, nu: float = 0.1) -> Boundary:
    """Rows far from the mean embedding lie outside; the farthest share ``nu`` sets the limit."""
    model = centre_boundary(scaled, features, size)
    return replace(model, threshold=limit(with_distance(scaled, model), "distance", nu))


def with_distance(scaled: DataFrame, model: Boundary) -> DataFrame:
    """Add ``distance``: 1 minus similarity to the mean."""
    weights, phases, centre = model.weights, model.phases, model.centre

    @F.pandas_udf("double")
    def distance(pdf: pd.DataFrame) -> pd.Series:
        return pd.Series(1.0 - _embed(pdf.to_numpy("float64"), weights, phases) @ centre)

    return scaled.withColumn("distance", distance(F.struct(*model.features)))


def score_boundary(scaled: DataFrame, model: Boundary) -> DataFrame:
    """Add ``distance`` (1 minus similarity to the mean) and ``outside``."""
    return with_distance(scaled, model).withColumn("outside", F.col("distance") > F.lit(model.threshold))


# ------------------------------------------------------------------ reconstruction

def fit_components(scaled: DataFrame, features: list[str], k: int = 2) -> np.ndarray:
    """Principal directions, as a features x k array."""
    from pyspark.ml.feature import PCA, VectorAssembler
    rows = VectorAssembler(inputCols=features, outputCol="_x").transform(scaled).select("_x")
    return PCA(k=k, inputCol="_x", outputCol="_y").fit(rows).pc.toArray()


def reconstruction_error(scaled: DataFrame, features: list[str], components: np.ndarray,
                         threshold: float = 0.1) -> DataFrame:
    """Add the mean squared error of rebuilding a row from its components, and the flag."""
    def dot(weights):
        return sum((F.col(f) * float(w) for f, w in zip(features, weights)), F.lit(0.0))

    length = sum((F.col(f) * F.col(f) for f in features), F.lit(0.0))
    # the directions are orthonormal: what is lost is the length outside of them
    kept = sum((F.pow(dot(components[:, k]), F.lit(2.0)) for k in range(components.shape[1])), F.lit(0.0))
    error = F.greatest(F.lit(0.0), length - kept) / float(len(features))
    return scaled.withColumn("error", error).withColumn("badly_rebuilt", F.col("error") > threshold)


# ------------------------------------------------------------------ ensemble

def vote(df: DataFrame, flags: list[str], scores: list[str]) -> DataFrame:
    """Majority of the flags; ``confidence`` is the share of votes, ``mean_score`` the plain mean."""
    votes = sum((F.col(f).cast("int") for f in flags), F.lit(0))
    total = len(flags)
    return df.withColumns({"votes": votes}).withColumns({
        "is_anomaly": F.col("votes") > total // 2, "confidence": F.col("votes") / float(total),
        "ensemble_vote": F.concat(F.col("votes").cast("string"), F.lit(f"/{total}")),
        "mean_score": sum((F.col(s) for s in scores), F.lit(0.0)) / float(len(scores))})


def default_scores(rows: DataFrame, scores: DataFrame | None, row_id: str) -> DataFrame:
    """Scores joined to rows; a row without one is not anomalous and scores 0."""
    if scores is None:
        return rows.withColumns({"is_anomaly": F.lit(False), "score": F.lit(0.0)})
    return (rows.join(scores.select(row_id, "is_anomaly", "score"), row_id, "left")
            .withColumns({"is_anomaly": F.coalesce("is_anomaly", F.lit(False)), "score": F.coalesce("score", F.lit(0.0))}))


def ensemble(features_df: DataFrame, features: list[str], row_id: str, contamination: float = 0.1) -> DataFrame:
    """Forest, boundary and reconstruction fitted on the rows, and their vote.

    Features are written before the many passes over them.  Rows are scored once; the scores are written, and both
    limits are taken from them.
    """
    require_rows(features_df)
    features_df = durable(features_df)
    scaled = scale(features_df, scaling(features_df, features))
    forest = grow_forest(scaled, features, row_id)
    boundary = centre_boundary(scaled, features)
    out = durable(with_distance(with_score(scaled, forest), boundary))
    limits = out.agg(*[F.percentile_approx(c, 1 - contamination, 10_000).alias(c) for c in ("score", "distance")]).first()
    out = out.withColumns({"isolated": F.col("score") > F.lit(limits["score"]), "outside": F.col("distance") > F.lit(limits["distance"])})
    out = reconstruction_error(out, features, fit_components(scaled, features))
    return vote(out, ["isolated", "outside", "badly_rebuilt"], ["score", "distance", "error"])
