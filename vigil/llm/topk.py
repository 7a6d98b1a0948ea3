"""Exact top-k inner products by block-at-a-time pruning."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil.llm.common import stored

SCALE = 256
BLOCK_ROWS = 512
QUERY_ROWS = 64
FIRST_BLOCKS = 4
EXACT = 1 << 53

BLOCK = "block bigint, n int, dims int, ids binary, kind string, matrix binary, high binary, low binary"


def integers(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): floor(scale * component); null vectors and those with a null or non-finite component go."""
    ok = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return (vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull())
            .where(F.coalesce(ok, F.lit(False)))
            .select(F.col("vec_id").cast("long").alias("vec_id"),
                    F.transform("embedding", lambda x: F.floor(x.cast("double") * scale)).alias("v")))


def _narrow(matrix: np.ndarray) -> np.ndarray:
    most = np.abs(matrix).max(initial=0)
    return matrix.astype("<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<i8")


def blocks(rows: DataFrame, size: int = BLOCK_ROWS) -> DataFrame:
    """Ranges of vec_id as blocks of at most ``size`` vectors: a forward index, and the extremes of every term.

    Shorter vectors of a block are filled with zeros, which add nothing to a product.
    """
    def run(batches):
        from pyspark import TaskContext
        task, count, ids, vectors = TaskContext.get().partitionId(), 0, [], []

        def made():
            dims = max(map(len, vectors))
            matrix = np.zeros((len(vectors), dims), np.int64)
            for i, v in enumerate(vectors):
                matrix[i, :len(v)] = v
            kept = _narrow(matrix)
            values = ([(task << 32) | count], [len(ids)], [dims], [np.array(ids, "<i8").tobytes()], [kept.dtype.str],
                      [kept.tobytes()], [matrix.max(0).astype("<i8").tobytes()], [matrix.min(0).astype("<i8").tobytes()])
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.string(), pa.binary(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds)],
                                              names=["block", "n", "dims", "ids", "kind", "matrix", "high", "low"])
        for batch in batches:
            for vec, v in zip(batch.column(0), batch.column(1)):
                ids.append(vec.as_py())
                vectors.append(v.values.to_numpy(zero_copy_only=False) if len(v) else np.zeros(0, np.int64))
                if len(ids) == size:
                    yield made()
                    count, ids, vectors = count + 1, [], []
        if ids:
            yield made()

    return rows.repartitionByRange("vec_id").sortWithinPartitions("vec_id").mapInArrow(run, BLOCK)


def _matrix(row, prefix=""):
    kind, n, dims = row[prefix + "kind"], row[prefix + "n"], row[prefix + "dims"]
    return np.frombuffer(row[prefix + "matrix"], kind).reshape(n, dims).astype(np.int64)


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T in whole numbers: in doubles while those are exact."""
    d = min(a.shape[1], b.shape[1])
    a, b = a[:, :d], b[:, :d]
    if int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * max(d, 1) < EXACT:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


def _bounds(batches):
    for batch in batches:
        out = ([], [], [], [])
        for row in batch.to_pylist():
            q, d = _matrix(row, "q_"), min(row["q_dims"], row["dims"])
            high, low = (np.frombuffer(row[c], "<i8")[None, :] for c in ("high", "low"))
            most = (_product(np.maximum(q, 0)[:, :d], high[:, :d]) + _product(np.minimum(q, 0)[:, :d], low[:, :d]))[:, 0]
            for column, value in zip(out, (row["qblock"], row["block"], int(most.sum()), most.astype("<i8").tobytes())):
                column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()),
                                          pa.array(out[3], pa.binary())], names=["qblock", "block", "bound", "bounds"])


def _scores(k: int):
    """Arrow function over (query block, block) pairs: each query's best k of the block."""
    def run(batches):
        for batch in batches:
            out = ([], [], [])
            for row in batch.to_pylist():
                queries = np.frombuffer(row["q_ids"], "<i8")
                ids = np.frombuffer(row["ids"], "<i8")
                scores = _product(_matrix(row, "q_"), _matrix(row))
                if row["floors"] is not None:
                    floors, bounds = np.frombuffer(row["floors"], "<i8"), np.frombuffer(row["bounds"], "<i8")
                    wanted = np.flatnonzero(bounds >= floors)
                else:
                    wanted = range(len(queries))
                for i in wanted:
                    line = np.flatnonzero(ids != queries[i])
                    best = line[np.lexsort((ids[line], -scores[i][line]))[:k]]
                    out[0].append(np.full(len(best), queries[i]))
                    out[1].append(ids[best])
                    out[2].append(scores[i][best])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(c) if c else np.zeros(0, np.int64), pa.int64()) for c in out],
                names=["query_id", "vec_id", "score"])
    return run


def _best(rows: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(vectors: DataFrame, queries: Column, k: int = 5, scale: int = SCALE, block_rows: int = BLOCK_ROWS,
           query_rows: int = QUERY_ROWS, first_blocks: int = FIRST_BLOCKS) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` best rows by integer inner product, ties to smaller vec_id.

    ``queries`` is a condition on vec_id.  Blocks are ranges of vec_id with the largest and smallest value of
    every term; a query's bound for a block is the sum of its components times the extreme of their
    sign.  Every block of queries scores the blocks of highest summed bound first; what the k-th score of a
    query then is decides which other blocks it must still see, and only those are scored.  All is moved by
    keyed joins of blocks, so no task holds more than a few blocks at once.

    Null vectors and vectors with null or non-finite components take no part.  Rows that share the query's
    vec_id are its own; a query id that is repeated is asked once, by the vector that sorts first.
    Scores must fit in a long.  Empty input gives no rows; extra columns are ignored.
    """
    rows = stored(integers(vectors, scale))
    asked = rows.where(queries).groupBy("vec_id").agg(F.min("v").alias("v"))
    index = stored(blocks(rows, block_rows))
    asking = stored(blocks(asked, query_rows)).select(
        F.col("block").alias("qblock"), *[F.col(c).alias(f"q_{c}") for c in ("n", "dims", "ids", "kind", "matrix")])
    lanes = max(1, asking.count() // 8)
    lane = F.pmod(F.xxhash64("qblock"), F.lit(lanes)).alias("lane")
    spread = index.select("block", "dims", "high", "low", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(lanes - 1).cast("long"))).alias("lane"))
    met = spread.join(asking.select("*", lane), "lane")
    pairs = stored(met.select("qblock", "block", "dims", "high", "low", "q_n", "q_dims", "q_kind", "q_matrix").mapInArrow(
        _bounds, "qblock bigint, block bigint, bound bigint, bounds binary"))
    placed = pairs.withColumn("_place", F.row_number().over(
        Window.partitionBy("qblock").orderBy(F.col("bound").desc(), "block")))
    placed = stored(placed)

    def scored(chosen):
        return stored(chosen.join(index.drop("high", "low"), "block").join(asking, "qblock").select(
            "ids", "kind", "n", "dims", "matrix", "q_ids", "q_kind", "q_n", "q_dims", "q_matrix", "bounds", "floors").mapInArrow(
                _scores(k), "query_id bigint, vec_id bigint, score bigint"))

    early = _best(scored(placed.where(F.col("_place") <= first_blocks).withColumn("floors", F.lit(None).cast("binary"))), k)
    early = stored(early.drop("rank"))
    floors = early.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).select(
        "query_id", F.when(F.col("n") >= k, F.col("least")).alias("floor"))
    late = scored(placed.where(F.col("_place") > first_blocks)
                  .join(_floors(asking, floors), "qblock"))
    return _best(early.unionByName(late), k).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _floors(asking: DataFrame, floors: DataFrame) -> DataFrame:
    """(qblock, floors): the k-th scores of a block's queries in its order; the least long where there are fewer."""
    def listed(batches):
        for batch in batches:
            block, place, query = [], [], []
            for row in batch.to_pylist():
                ids = np.frombuffer(row["q_ids"], "<i8")
                block += [row["qblock"]] * len(ids)
                place += range(len(ids))
                query += ids.tolist()
            yield pa.RecordBatch.from_arrays([pa.array(block, pa.int64()), pa.array(place, pa.int32()), pa.array(query, pa.int64())],
                                             names=["qblock", "place", "query_id"])

    def joined(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([np.array(x, "<i8").tobytes() for x in batch.column(1).to_pylist()], pa.binary())],
                names=["qblock", "floors"])

    rows = asking.select("qblock", "q_ids").mapInArrow(listed, "qblock bigint, place int, query_id bigint")
    lists = rows.join(floors, "query_id", "left").groupBy("qblock").agg(F.transform(
        F.sort_array(F.collect_list(F.struct("place", F.coalesce("floor", F.lit(-(1 << 63))).alias("floor")))),
        lambda x: x["floor"]).alias("floors"))
    return lists.mapInArrow(joined, "qblock bigint, floors binary")
