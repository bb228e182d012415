"""What a session gives the library: how Python workers find it, and how lineage is cut."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark import SparkContext
from pyspark.sql import DataFrame

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def ship() -> None:
    context = SparkContext._active_spark_context
    if context is not None and ROOT not in context.environment.get("PYTHONPATH", "").split(":"):
        context.environment["PYTHONPATH"] = ":".join(x for x in (ROOT, context.environment.get("PYTHONPATH", "")) if x)


def land(df: DataFrame) -> DataFrame:
    """Computed once, with its lineage cut, as a table in the shared checkpoint folder.

    A table is read with the size that it has; a checkpoint would hand on the
    size that the optimiser guessed, which joins multiply round after round. A
    session on one machine that has no such folder gets a temporary one; on a
    cluster ``spark.checkpoint.dir`` must name it.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if not context.getCheckpointDir():
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tellurion-"))
    path = f"{context.getCheckpointDir()}/landed-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt over the cluster if the plan reads too little to come in a partition for each core; the plan's own estimate decides, nothing runs."""
    n = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(n) if size < n * (128 << 20) else df
