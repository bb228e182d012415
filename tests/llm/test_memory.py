"""What operators leave in executors and workers, and how much they are sent at once."""

import glob

import public_tokenizers
import pyarrow as pa
from pyspark.sql import functions as F

from tellurion.llm import common, exact_dedup, packing


def test_batches_are_bounded_by_bytes(spark):
    common.ship(spark)
    docs = spark.range(0, 64, 1, 1).select(F.repeat(F.lit("x"), 1 << 20).alias("text"))

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"])

    found = [r["n"] for r in docs.mapInArrow(run, "n long").collect()]
    assert sum(found) >= 64 << 20 and max(found) <= common.BATCH_BYTES + (2 << 20)


def test_state_is_closed_after_its_stream(spark):
    jvm = spark.sparkContext._jvm
    local = jvm.org.apache.spark.util.Utils.getLocalDir(jvm.org.apache.spark.SparkEnv.get().conf())
    there = lambda: {x for x in glob.glob(f"{local}/**/*StateStoreId*", recursive=True)}
    before = there()
    docs = spark.createDataFrame([(i, f"text {i % 5}") for i in range(50)], "doc_id long, text string").repartition(4)
    for files in (None, 1):
        rows = exact_dedup.exact_dedup(docs, files_per_batch=files).collect()
        assert sorted(r["doc_id"] for r in rows if r["kept"]) == [0, 1, 2, 3, 4] and {r["group_size"] for r in rows} == {10}
        assert there() <= before


def test_tokeniser_goes_when_other_work_comes():
    packing.tokeniser(public_tokenizers.path("word_bpe_49k.json"))
    assert packing._made

    def run(batches):
        yield from batches

    run.__module__ = packing.__name__
    assert list(common.bounded(run)(iter([1]))) == [1] and packing._made
    run.__module__ = exact_dedup.__name__
    assert list(common.bounded(run)(iter([1]))) == [1] and not packing._made
