"""What the training-data operators share: the shared folder, landing and text reading."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
#: Rows of a few dozen bytes that may be broadcast once they have been counted.
BROADCAST_ROWS = 100_000
#: Bytes after which a batch for Python workers is full, whatever its rows: buffers on both sides double as they grow.
BATCH_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that all machines share: ``spark.checkpoint.dir``, or what the session set as its checkpoint folder.

    Only a local session may go without either; it gets a temporary folder then.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        # The setting itself can't be changed in a running session; the context keeps the folder.
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tellurion-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


_made: list[tuple[str, str]] = []


def run_dir(spark: SparkSession, name: str) -> str:
    """A new folder for one run's tables; ``scratch`` removes those made within it."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _made.append((spark.sparkContext.applicationId, path))
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Remove the folders of the runs made in the block, whose results must have been written by its end.

    Results are lazy and read those folders, so operators can't remove them on their own.
    """
    before = len(_made)
    try:
        yield
    finally:
        jvm, own = spark.sparkContext._jvm, [p for app, p in _made[before:] if app == spark.sparkContext.applicationId]
        del _made[before:]
        for p in own:
            at = jvm.org.apache.hadoop.fs.Path(p)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def give_back() -> None:
    """Memory that a worker, which lives on, took and needs no more."""
    import ctypes
    import gc

    import pyarrow

    gc.collect()
    pyarrow.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


_stores: dict[str, dict] = {}


def store(module: str) -> dict:
    """What a module's tasks keep in a worker for its later ones, until ``bounded`` work of another module comes."""
    return _stores.setdefault(module, {})


def let_go(module: str) -> None:
    """Empty what other modules than this keep in this worker."""
    for other, held in _stores.items():
        if other != module:
            held.clear()


def bounded(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """The same over batches, without what other modules left in the worker; then it gives back the memory that it took."""
    module = run.__module__

    def wrapped(batches: Iterator) -> Iterator:
        let_go(module)
        yield from run(batches)
        give_back()

    return wrapped


def land(df: DataFrame, path: str) -> DataFrame:
    """Write and reread: computed once, lineage cut, safe against lost executors."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package where they share the driver's disk, and bound what they are sent at once."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    env = spark.sparkContext.environment
    if REPO not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(x for x in (REPO, env.get("PYTHONPATH", "")) if x)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(col: str) -> Column:
    """A text column with null read as the empty text."""
    return F.coalesce(F.col(col), F.lit(""))


def without(docs: DataFrame, gone: DataFrame, id_col: str) -> DataFrame:
    """The rows of ``docs`` whose id isn't in ``gone`` (one column of ids), which is broadcast if it is small.

    Rows with a null id stay, as do all rows where ``gone`` is empty; columns may have any names.
    """
    ids = land(gone.toDF("gone"), f"{run_dir(docs.sparkSession, 'gone')}/ids")
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids
    return docs.join(ids, docs[id_col] == ids["gone"], "left_anti")
