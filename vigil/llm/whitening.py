"""Whitening of embeddings with distributed block matrices."""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import numbered, stored

COMPONENTS = 4
#: Rows of a block, and blocks a task multiplies.
ROWS = 1000
BLOCKS = 64
WHOLE = "decimal(38,0)"
#: Entries from here on do not fit in a long.
LIMIT = float(1 << 63)


def integers(rows: DataFrame, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """(id, x): floor(256 * c) of every entry c as a long, of the rows whose vector is whole and finite."""
    entry = F.col(vector)
    finite = F.coalesce(F.forall(entry, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf"))), F.lit(False))
    scaled = F.transform(entry, lambda c: F.floor(256 * c.cast("double")))
    fits = F.forall(entry, lambda c: F.abs(256 * c.cast("double")) < LIMIT)
    checked = F.when(fits, scaled).otherwise(F.raise_error(F.lit("256 times an entry does not fit in a long")).cast("array<bigint>"))
    return rows.where(finite).select(F.col(key).alias("id"), checked.alias("x"))


def _packed(rows: DataFrame, d: int) -> DataFrame:
    """Blocks (i, x, and a list of every other column) of at most ``ROWS`` rows, numbered from 0 without gaps."""
    others = [c for c in rows.columns if c != "x"]
    schema = ", ".join(["x binary", *[f"{c} array<{rows.schema[c].dataType.simpleString()}>" for c in others]])

    def pack(batches):
        for batch in batches:
            values = batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, d)
            starts = list(range(0, batch.num_rows, ROWS))
            if starts:
                ends = pa.array([*starts, batch.num_rows], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([values[s:s + ROWS].tobytes() for s in starts], pa.binary()),
                     *[pa.ListArray.from_arrays(ends, c) for c in batch.columns[1:]]], names=["x", *others])
    blocks = stored(rows.select("x", *others).mapInArrow(pack, schema).withColumn("block", F.monotonically_increasing_id()))
    order = numbered(blocks.select("block"), F.col("block"), name="i")
    return stored(blocks.join(order, "block").drop("block"))


class Blocks:
    """Centred rows as row blocks that lie in a matrix of ``side`` block columns.

    Block i stands in block column ``column(i)``; all other places are empty.  With the columns i // side and
    i % side the transposed matrix times the matrix is a grid of side x side partial scatters, each over its own
    share of the rows, so that no task multiplies more than its share whatever the number of rows.
    """

    def __init__(self, packed: DataFrame, d: int, mean: np.ndarray):
        self.count = packed.count()
        self.side = max(1, int(np.ceil(np.sqrt(self.count / BLOCKS))))
        self.d, self.mean = d, mean
        self.rows = packed.select("i", "x").repartition(max(1, -(-self.count // BLOCKS)), "i")

    def matrix(self, column) -> BlockMatrix:
        d, mean = self.d, self.mean

        def block(row):
            x = np.zeros((ROWS, d))
            held = np.frombuffer(row.x, np.int64).reshape(-1, d) - mean
            x[:len(held)] = held
            return (row.i, column(row.i)), DenseMatrix(ROWS, d, x.reshape(-1), isTransposed=True)
        return BlockMatrix(self.rows.rdd.map(block), ROWS, d, self.count * ROWS, self.side * d)

    def scatter(self) -> np.ndarray:
        """Sum of the outer products of all rows."""
        side = self.side
        left, right = self.matrix(lambda i: i // side % side), self.matrix(lambda i: i % side)
        return left.transpose().multiply(right).blocks.map(lambda b: b[1].toArray()).treeReduce(np.add)

    def times(self, projection: np.ndarray):
        """RDD of (i, rows of block i times ``projection``)."""
        side, (d, k) = self.side, projection.shape
        context = self.rows.sparkSession.sparkContext
        cell = DenseMatrix(d, k, projection.reshape(-1, order="F"))
        diagonal = BlockMatrix(context.parallelize([((s, s), cell) for s in range(side)]), d, k, side * d, side * k)
        return self.matrix(lambda i: i % side).multiply(diagonal).blocks.map(lambda b: (b[0][0], b[1].toArray()))


def principal(scatter: np.ndarray, n: int, components: int) -> tuple[np.ndarray, np.ndarray, float]:
    """(eigenvalues, unit eigenvectors as columns, trace) of the covariance, largest first, zero ones left out."""
    covariance = scatter / n
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    used = values > max(values.max(initial=0.0), 0.0) * len(covariance) * np.finfo(float).eps
    return values[used], vectors[:, used], float(np.trace(covariance))


def _deviation(n: int, sums: list[int]) -> Column:
    """Sum over the dimensions of (n * x - S)^2, exact."""
    far = F.zip_with("x", F.array(*[F.lit(Decimal(s)).cast(WHOLE) for s in sums]),
                     lambda x, s: (x.cast("decimal(19,0)") * F.lit(Decimal(n)).cast("decimal(18,0)")).cast(WHOLE) - s)
    return F.aggregate(far, F.lit(Decimal(0)).cast(WHOLE), lambda total, v: (total + v.cast(WHOLE) * v.cast(WHOLE)).cast(WHOLE))


def whiten(rows: DataFrame, vector: str = "embedding", key: str = "vec_id", components: int = COMPONENTS) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error) for each usable row and component.

    Entries c become x = floor(256 * c); the fit list is each distinct x vector once, n vectors with sums S.
    Centred rows are indexed into blocks; a transposed block matrix times itself gives the scatter, its
    eigenvectors are found on the driver (dimensions x dimensions), and all rows are projected block by block.
    ``whitened`` is x - S/n on the unit eigenvector of the covariance (divisor n) over the root of its
    eigenvalue; ``explained`` that eigenvalue over the trace; ``deviation`` (decimal) the exact sum of (n*x - S)^2;
    ``identity_error`` the largest entry of the covariance of the projected fit list minus the identity.

    Rows whose vector is null or holds a null or non-finite entry take no part; empty vectors and empty
    tables give no rows.  Repeated rows, equal vectors and null keys appear as often as in the input, but count
    once in the fit.  Components without variance cannot be whitened and are left out, so a fit list of
    one vector gives no rows.  Extra columns are ignored.  Vectors of unequal length, and entries that
    do not fit in a long, raise an error.
    """
    spark = rows.sparkSession
    kind = rows.schema[key].dataType.simpleString()
    nothing = spark.createDataFrame([], f"`{key}` {kind}, component int, n bigint, deviation {WHOLE}, whitened double, explained double, identity_error double")
    whole = stored(integers(rows, vector, key))
    fit = stored(whole.select("x").distinct())
    size = F.size("x")
    n, d, longest = fit.agg(F.count(F.lit(1)), F.min(size), F.max(size)).first()
    if d != longest:
        raise ValueError(f"vectors of {d} and of {longest} entries")
    if not n or not d:
        return nothing
    entries = fit.select(F.posexplode("x").alias("dimension", "x")).groupBy("dimension").agg(F.sum(F.col("x").cast("decimal(20,0)")).alias("s"))
    sums = [int(r.s) for r in entries.orderBy("dimension").collect()]       # one row per dimension
    mean = np.array([s / n for s in sums])

    fitted = Blocks(_packed(fit, d), d, mean)
    values, vectors, trace = principal(fitted.scatter(), n, components)
    k = len(values)
    if not k:
        return nothing
    projection = vectors / np.sqrt(values)
    moments = fitted.times(projection).map(lambda b: np.vstack([b[1].T @ b[1], b[1].sum(0)])).treeReduce(np.add) / n
    error = float(np.abs(moments[:-1] - np.outer(moments[-1], moments[-1]) - np.eye(k)).max())

    packed = _packed(whole.select("x", "id", _deviation(n, sums).alias("deviation")), d)
    projected = Blocks(packed, d, mean).times(projection).map(lambda b: (b[0], b[1].tobytes()))
    placed = packed.drop("x").join(spark.createDataFrame(projected, "i bigint, w binary"), "i")
    columns = [c.name for c in nothing.schema]

    def unpack(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                ids, deviations = (batch.column(c).slice(r, 1).flatten() for c in (0, 1))
                w = np.frombuffer(batch.column(2)[r].as_py()).reshape(ROWS, k)[:len(ids)]
                for c in range(k):
                    same = [pa.repeat(v, len(ids)) for v in (pa.scalar(c + 1, pa.int32()), pa.scalar(n, pa.int64()))]
                    last = [pa.repeat(float(v), len(ids)) for v in (values[c] / trace, error)]
                    yield pa.RecordBatch.from_arrays([ids, *same, deviations, pa.array(w[:, c]), *last], names=columns)
    return placed.select("id", "deviation", "w").mapInArrow(unpack, nothing.schema)
