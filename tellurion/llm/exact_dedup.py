"""Exact deduplication through stateful streaming with disk-backed keyed state.

Every row's digest is landed once, with its row locator. A stream reads the
landed rows into RocksDB state that never expires: digest -> smallest id, that
row's locator, and the number of rows. Digests that were hit more than once are
then checked on full bytes. Should two texts share a digest, their rows leave
the digest path and are grouped by the text itself.

Only DataFrame operations run on executors.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tellurion.llm.common import BROADCAST_ROWS, land, run_dir, text_of, without

LAST = 9223372036854775807
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # Else each state partition reserves megabytes of disk before it holds a row.
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "64",
    # Else every partition's store stays open on its executor, beside the work that follows.
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


def normalised(col: str) -> Column:
    return F.regexp_replace(text_of(col), r"[\x20\x09-\x0D]+", " ")


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _first() -> list[Column]:
    """Of equal texts: the smallest id, a row that has it, and the number of rows."""
    return [F.min("ord").alias("first"), F.min_by("rid", "ord").alias("rep"), F.count(F.lit(1)).alias("n")]


def keyed_state(landed: DataFrame, path: str, files_per_batch: int | None = None) -> DataFrame:
    """Stream the landed rows into keyed state and return its last contents.

    Each micro-batch writes the keys that it changed; of a key's versions the
    last batch's holds. A rerun of a batch overwrites what it wrote before.
    """
    spark = landed.sparkSession
    before = {k: spark.conf.get(k, None) for k in STATE}
    for k, v in STATE.items():
        spark.conf.set(k, v)
    batches: set[int] = set()

    def put(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{path}/state/batch={batch}")
        batches.add(batch)

    try:
        source = spark.readStream.schema(landed.schema)
        if files_per_batch:
            source = source.option("maxFilesPerTrigger", files_per_batch)
        rows = source.parquet(f"{path}/digests").withColumn("key", F.unhex("digest"))
        query = (
            rows.groupBy("key").agg(*_first()).writeStream.outputMode("update")
            .option("checkpointLocation", f"{path}/stream").trigger(availableNow=True).foreachBatch(put).start()
        )
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    schema = "key binary, first long, rep long, n long, batch int"
    if not batches:
        return spark.createDataFrame([], schema).drop("batch")
    state = spark.read.schema(schema).parquet(f"{path}/state")
    if len(batches) == 1:
        return state.drop("batch")
    last = state.groupBy("key").agg(F.max_by(F.struct("first", "rep", "n"), "batch").alias("s"))
    return last.select("key", "s.*")


def collided(docs: DataFrame, hits: DataFrame, n_hits: int, text_col: str, digest: Callable[[Column], Column], salts: int) -> DataFrame:
    """Of the digests hit more than once, those under which full bytes differ (none, as a rule)."""
    rows = docs.select(normalised(text_col).alias("norm")).withColumn("key", F.unhex(digest(F.col("norm"))))
    ends = [F.min("norm").alias("lo"), F.max("norm").alias("hi")]
    if n_hits <= BROADCAST_ROWS:
        rows = rows.join(F.broadcast(hits), "key", "left_semi")
    else:
        # A digest may hold a third of the rows: its rows are dealt over salts.
        rows = rows.withColumn("salt", F.pmod(F.hash(F.monotonically_increasing_id()), F.lit(salts)))
        every = hits.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        rows = rows.join(every, ["key", "salt"], "left_semi").groupBy("key", "salt").agg(*ends)
        ends = [F.min("lo").alias("lo"), F.max("hi").alias("hi")]
    return rows.groupBy("key").agg(*ends).filter("lo != hi").select("key")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256, files_per_batch: int | None = None, salts: int = 64) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after each ``[\\x20\\x09-\\x0D]+`` became one
    space; the row with the smallest id stays. Null text is the empty text. A
    null id comes after all others; in a group of null ids only, keep_id is
    null and one row is kept. Of rows that repeat id and text one is kept. An
    empty table gives an empty result. Other columns, whatever their names,
    play no part. ``digest`` gives hex text; any will do, as bytes are checked.
    """
    spark, path = docs.sparkSession, run_dir(docs.sparkSession, "exact-dedup")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), normalised(text_col).alias("norm"))
    rows = rows.select("doc_id", digest(F.col("norm")).alias("digest"), sha256(F.col("norm")).alias("text_sha256") if digest is not sha256 else F.lit(None).cast("string").alias("text_sha256"))
    rows = rows.select(F.monotonically_increasing_id().alias("rid"), "doc_id", F.coalesce("doc_id", F.lit(LAST)).alias("ord"), "digest", "text_sha256")
    landed = land(rows, f"{path}/digests")
    state = keyed_state(landed, path, files_per_batch)

    hits = state.filter("n > 1").select("key")
    n_hits = hits.count()
    bad, n_bad = None, 0
    if n_hits:
        bad = land(collided(docs, hits, n_hits, text_col, digest, salts), f"{path}/collided")
        n_bad = bad.count()

    def told(x: DataFrame, sha: str) -> DataFrame:
        return x.select("doc_id", F.when(F.col("first") != LAST, F.col("first")).alias("keep_id"), F.col("n").alias("group_size"), (F.col("rid") == F.col("rep")).alias("kept"), F.col(sha).alias("text_sha256"))

    keyed = landed.withColumn("key", F.unhex("digest"))
    sha = "digest" if digest is sha256 else "text_sha256"
    if not n_bad:
        return told(keyed.join(state, "key"), sha)
    bad = F.broadcast(bad) if n_bad <= BROADCAST_ROWS else bad
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), normalised(text_col).alias("norm"))
    texts = texts.withColumn("key", F.unhex(digest(F.col("norm")))).join(bad, "key", "left_semi").drop("key")
    texts = land(texts.select(F.monotonically_increasing_id().alias("rid"), F.coalesce("doc_id", F.lit(LAST)).alias("ord"), "doc_id", "norm"), f"{path}/exact")
    by_text = texts.join(texts.groupBy("norm").agg(*_first()), "norm").withColumn("text_sha256", sha256(F.col("norm")))
    return told(keyed.join(bad, "key", "left_anti").join(state, "key"), sha).unionByName(told(by_text, "text_sha256"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Rows with a null id all stay. Of rows that repeat an id each is judged by its
    own text, and of those that repeat text too, white space apart, one stays.
    Null texts are empty ones and stay null. An empty table stays empty; columns
    may have any names.
    """
    out = land(exact_dedup(docs, id_col, text_col), f"{run_dir(docs.sparkSession, 'kept')}/rows")
    gone = out.filter("not kept and doc_id is not null").select("doc_id", "keep_id", "text_sha256").distinct()
    gone = land(gone, f"{run_dir(docs.sparkSession, 'gone')}/pairs")
    left = without(docs, gone.select("doc_id").distinct(), id_col)
    # An id that is in question may have other rows: those whose text isn't gone, and one of those that repeat it.
    ids = gone.select(F.col("doc_id").alias("_gone")).distinct()
    ids = F.broadcast(ids) if gone.count() <= BROADCAST_ROWS else ids
    names = [f"c{i}" for i in range(len(docs.columns))]
    own, text = docs.toDF(*names), names[docs.columns.index(text_col)]
    key = F.col(names[docs.columns.index(id_col)]).cast("long")
    some = own.withColumn("_id", key).join(ids, F.col("_id") == F.col("_gone"), "left_semi").withColumn("_sha", sha256(normalised(text)))
    pairs = gone.select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha"), (F.col("keep_id") == F.col("doc_id")).alias("_same"))
    some = some.join(pairs, ["_id", "_sha"], "left").filter("_same is null or _same")
    once = some.filter("_same").dropDuplicates(["_id", "_sha"])
    return left.unionByName(some.filter("_same is null").unionByName(once).select(*names).toDF(*docs.columns))


def op8_exact_dedup(spark, sf_dir: str) -> DataFrame:
    from tellurion.llm.common import table

    return exact_dedup(table(spark, sf_dir, "documents"))


SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM n WINDOW w AS (PARTITION BY norm)
"""
