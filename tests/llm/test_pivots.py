"""What near-dedup moves: members of open buckets once for each pivot, full sets where they are made, bands once."""

import numpy as np

from tellurion.llm import minhash_dedup


def test_members_meet_once_under_a_pivot(spark):
    """Buckets of a family overlap without being equal; each class comes once for their pivot, and closed buckets don't come."""
    buckets = {1: (5, [5, 6]), 2: (5, [5, 6, 7]), 3: (5, [5, 7]), 4: (5, [5, 8]), 5: (9, [9, 6])}
    root = {5: 5, 6: 6, 7: 7, 8: 5, 9: 9}
    rooted = spark.createDataFrame([(k, p, i, root[i]) for k, (p, ids) in buckets.items() for i in ids], "key long, pivot long, id long, root long")
    assert sorted(map(tuple, minhash_dedup.by_pivot(rooted).select("pivot", "id", "root", "n").collect())) == [(5, 5, 5, 3), (5, 6, 6, 3), (5, 7, 7, 3), (9, 6, 6, 2), (9, 9, 9, 2)]


def test_full_sets_stay_where_they_are_made(spark, tmp_path):
    """Without repeated ids no set is shuffled; with them, the class's text is told by its digest and comes once."""
    texts = ["one two three four five six seven", "a b c d e f g", "one two three four five six seven", "x y"]
    docs = spark.createDataFrame([(1, texts[0]), (2, texts[1]), (2, texts[0]), (2, texts[1]), (4, texts[3]), (5, None)], "doc_id long, text string").repartition(3)
    digests = {i: minhash_dedup.digest_of(minhash_dedup.shingles(texts[k])) for i, k in ((1, 0), (2, 1), (4, 3))}
    classes = spark.createDataFrame([(i, bytearray(d)) for i, d in digests.items()], "id long, digest binary")
    needed = spark.createDataFrame([(1,), (2,)], "id long")
    sets = minhash_dedup.full_sets(docs, "doc_id", "text", classes, needed, f"{tmp_path}/all", repeats=True)
    got = {r["id"]: np.frombuffer(r["items"], np.uint64).tolist() for r in sets.collect()}
    assert sets.count() == 2 and got == {i: minhash_dedup.shingles(texts[k]).tolist() for i, k in ((1, 0), (2, 1))}
    once = spark.createDataFrame([(1, texts[0]), (4, texts[3])], "doc_id long, text string").coalesce(1)
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("sets", "sets")
    sets = minhash_dedup.full_sets(once, "doc_id", "text", classes, needed, f"{tmp_path}/once", repeats=False)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert [r["id"] for r in sets.collect()] == [1]
    last = tracker.getJobInfo(max(tracker.getJobIdsForGroup("sets")))
    assert len(last.stageIds) == 1 and len(sets.inputFiles()) == 1
