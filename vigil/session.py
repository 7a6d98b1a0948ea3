"""Session helpers: where durable intermediate data may go."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints, as named by the session (``spark.checkpoint.dir``).

    A machine-local folder is chosen only when nothing is configured and the session itself
    runs on this machine alone.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        path = tempfile.mkdtemp(prefix="vigil-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", path)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path


def durable(df):
    """Write ``df`` as Parquet to the checkpoint folder and return a DataFrame that reads it back.

    Nothing of the old plan is carried along, neither lineage nor constraints on columns that later
    steps leave out.
    """
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/vigil-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
