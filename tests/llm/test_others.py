"""Vectors, archives and the pipeline."""

import base64
import hashlib

import numpy as np
import pytest

from tellurion.llm import hnsw, warc


def brute(ids, x, k=10):
    out = {}
    for i in ids:
        if i % 100 == 0:
            d = np.sqrt(((x - x[ids.index(i)]) ** 2).sum(1))
            out[i] = [j for _, j in sorted((d[n], j) for n, j in enumerate(ids) if j != i)[:k]]
    return out


def test_recall(spark):
    rng = np.random.default_rng(0)
    centres = rng.standard_normal((20, 16))
    x = (centres[rng.integers(20, size=3000)] + 0.3 * rng.standard_normal((3000, 16))).astype("float32")
    x[500:900] = x[500]  # many copies of one vector
    ids = list(range(3000))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<float>")
    got = {}
    for r in hnsw.nearest(df, shard=800).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    want = brute(ids, x.astype(float))
    assert set(got) == set(want) and all(sorted(g) == list(range(1, 11)) for g in got.values())
    recall = np.mean([len({v for v, _ in got[q].values()} & set(want[q])) / 10 for q in want])
    assert recall >= 0.9
    assert [got[500][k][0] for k in range(1, 11)] == list(range(501, 511))  # ties go to the smaller id


def test_vector_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [1.0, None]), (7, [1.0, 1.0, 1.0]), (None, [1.0, 2.0]), (100, None), (200, [])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, rank int")
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in hnsw.nearest(df).collect()] == [(0, 1, 1)]
    assert hnsw.nearest(df.limit(0)).collect() == []


def test_routing_recall(spark):
    """Shards far smaller than the table, so that queries visit some of many cells: recall on the embeddings table."""
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding")
    rows = df.collect()
    ids, x = [r["vec_id"] for r in rows], np.array([r["embedding"] for r in rows], float)
    want = brute(ids, x)
    got = {}
    for r in hnsw.nearest(df, shard=len(rows) // 25).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    assert set(got) == set(want) and all(len(v) == 10 for v in got.values())
    assert np.mean([len(got[q] & set(want[q])) / 10 for q in want]) >= 0.9


def test_clustered_vectors_visit_few_cells():
    rng = np.random.default_rng(8)
    x = (10 * rng.standard_normal((40, 16))[rng.integers(40, size=4000)] + 0.1 * rng.standard_normal((4000, 16))).astype(np.float32)
    c = hnsw.fit_centres(x, 40)
    assert hnsw.probes_needed(hnsw.scaled(x)[0], c) <= 4
    flat = rng.standard_normal((4000, 64)).astype(np.float32)
    assert hnsw.probes_needed(hnsw.scaled(flat)[0], hnsw.fit_centres(flat, 40)) > 20


def test_repeated_vector_rows(spark):
    """Rows that repeat an id never crowd out others, and an id may come with several vectors."""
    rows = [(100, [1.0, 0.0])] + [(1, [2.0, 0.0])] * 20 + [(i, [2.0, 0.0]) for i in range(2, 12)] + [(50, [9.0, 9.0]), (50, [1.5, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r["rank"], r["vec_id"], r["score"]) for r in hnsw.nearest(df).collect())
    assert got == [(1, 50, 0.5)] + [(k + 1, k, 1.0) for k in range(1, 10)]
    two = spark.createDataFrame([(0, [5.0, 5.0]), (0, [0.0, 1.0]), (1, [0.0, 2.0]), (2, [5.0, 7.0])], "vec_id long, embedding array<double>")
    assert [(r["vec_id"], r["score"]) for r in sorted(hnsw.nearest(two).collect(), key=lambda r: r["rank"])] == [(1, 1.0), (2, float(np.hypot(5, 6)))]


@pytest.mark.parametrize("chunk", [7, 262144])
def test_warc(spark, chunk):
    rows = [(1, "u", "abc"), (2, "u", "abc"), (3, None, "é" * 50), (4, "u\nv", None), (5, "w", ""), (6, "x", "x" * 1000), (None, "y", "abc"), (7, "z", "only")]
    df = spark.createDataFrame([(*r, "k") for r in rows], "page_id long, url string, html string, key string").repartition(3)
    out = {r["page_id"]: r for r in warc.round_trip(df, chunk=chunk).collect()}
    assert len(out) == len(rows)
    for i, _, t in rows:
        raw = (t or "").encode()
        assert out[i]["payload_bytes"] == len(raw)
        assert out[i]["payload_digest"] == base64.b32encode(hashlib.sha1(raw).digest()).decode()
    assert (out[1]["record_type"], out[1]["refers_to"]) == ("revisit", 2) and out[2]["record_type"] == "response"
    assert out[4]["refers_to"] == 5 and out[None]["record_type"] == "response"
    assert warc.round_trip(df.limit(0)).collect() == []


def test_warc_chunks(spark):
    df = spark.createDataFrame([(1, "u", "abcdefghij" * 10)], "page_id long, url string, html string")
    manifest = warc.write(warc.chunk_rows(df, chunk=16), warc.run_dir(spark, "t"))
    rows = sorted(warc.read(manifest, chunk=16).collect(), key=lambda r: r["chunk"])
    assert b"".join(bytes(r["data"]) for r in rows) == b"abcdefghij" * 10 and max(len(r["data"]) for r in rows) <= 16
    assert [r["last"] for r in rows].count(True) == 1
    # Digests are kept up chunk by chunk.
    for k, r in enumerate(rows):
        so_far = (b"abcdefghij" * 10)[: 16 * (k + 1)]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(so_far), base64.b32encode(hashlib.sha1(so_far).digest()).decode())


def test_pipeline(spark):
    import corpus_pipeline as cp

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    at, seen = docs, {}
    for name, stage in cp.STAGES[:-1]:
        new = stage(spark, at, sf)
        assert new.columns == docs.columns
        seen[name] = {r["doc_id"]: r["text"] for r in new.collect()}
        at = spark.createDataFrame(new.collect(), docs.schema)
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    good = [i for i, q in labels.items() if q == 1]
    assert np.mean([i in seen["quality classifier"] for i in good]) > 0.95
    assert len({" ".join(t.split()) for t in seen["exact dedup"].values()}) == len(seen["exact dedup"])
    assert set(seen["secret scans"]) == set(seen["minhash near-dedup"]) <= set(seen["exact dedup"])
    assert not any("AKIA" in t and len(t.split("AKIA")[1].split()[0]) >= 12 for t in seen["secret scans"].values())
    pieces = cp.STAGES[-1][1](spark, at, sf).collect()
    assert {r["doc_id"] for r in pieces} == set(seen["secret scans"])


COLUMNS = "doc_id long, text string, lang string, source string, n_chars int"
GOOD = "the river runs past the old mill and nobody in the town remembers who built it or why it was left there so long ago"


def edge_rows():
    words = GOOD.split()
    long = " ".join(f"{w}{i % 50}" for i in range(300) for w in words)
    texts = [
        (10, GOOD), (11, GOOD + " "), (12, GOOD.replace("mill", "barn")), (13, None), (14, ""), (None, GOOD), (None, "only here"), (15, long), (16, long + " tail"),
        (17, "short word"), (17, "short word"), (17, "short \t word"), (18, "one text of an id"), (18, GOOD), (2**62 + 1, GOOD + " twice"), (2**62 + 2, GOOD + " twice"), (9007199254740993, "an id beyond a float's digits"),
        (19, "password=hunter2hunter2 and more words to stand beside it"),
    ]
    return [(i, t, None, "s", None if t is None else len(t)) for i, t in texts]


def test_pipeline_stages_on_edge_rows(spark):
    """Nulls, repeats, empty and very long texts and large ids through every stage; and an empty table."""
    import corpus_pipeline as cp

    sf = "/root/testdata/sf0.001"
    docs = spark.createDataFrame(edge_rows(), COLUMNS).repartition(3)
    key = lambda rows: sorted((str(r["doc_id"]), str(r["text"])) for r in rows)
    stages = dict(cp.STAGES)
    first = stages["exact dedup"](spark, docs, sf)
    assert first.columns == docs.columns
    got = key(first.collect())
    ids = [i for i, _ in got]
    # Each text once, by its smallest id; rows with a null id stay; an id keeps its text that is no copy.
    assert ids.count("None") == 2 and ids.count("17") == 1 and ("18", "one text of an id") in got and ("18", GOOD) not in got
    assert ("10", GOOD) in got and "11" in ids and str(2**62 + 1) in ids and str(2**62 + 2) not in ids and "13" in ids and "14" not in ids
    near = key(stages["minhash near-dedup"](spark, docs, sf).collect())
    assert {"10", "13", "14", "15", "17", "18", "None"} <= {i for i, _ in near} and "16" not in {i for i, _ in near} and str(2**62 + 2) not in {i for i, _ in near}
    safe = {r["doc_id"]: r for r in stages["secret scans"](spark, docs, sf).collect()}
    assert safe[19]["text"].startswith("[SECRET]") and safe[13]["text"] is None and safe[13]["n_chars"] is None and safe[19]["n_chars"] == len(safe[19]["text"])
    kept = stages["quality classifier"](spark, docs, sf)
    assert kept.columns == docs.columns and set(key(kept.collect())) <= set(key(docs.collect()))
    pieces = stages["best-fit packing"](spark, docs, sf).collect()
    assert {r["doc_id"] for r in pieces} == {r[0] for r in edge_rows()}
    for name, stage in cp.STAGES:
        assert stage(spark, docs.limit(0), sf).collect() == [], name


def test_pipeline_run(spark, tmp_path):
    """run() on tables of its own: what it packs is what the stages keep."""
    import corpus_pipeline as cp

    spark.createDataFrame(edge_rows(), COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(10, 1, 0), (12, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
    out = cp.run(spark, str(tmp_path)).collect()
    assert sorted({str(r["doc_id"]) for r in out}) == sorted({str(r["doc_id"]) for r in docs.collect()})


def test_packing_with_capacities(spark):
    """Document and cost capacities that bind, whole ids beside nulls, and a piece too long for the cost."""
    import public_tokenizers as P

    from tellurion.llm import packing

    rng = np.random.default_rng(6)
    rows = [(None if i % 9 == 0 else 2**53 + 1 + 2 * i, " ".join("word" for _ in range(int(rng.integers(1, 400))))) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for most, cost in ((3, None), (None, 90_000), (4, 150_000)):
        seqs = {}
        out = packing.packed(docs, P.path("word_bpe_49k.json"), max_docs=most, max_cost=cost).collect()
        for r in out:
            seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        for own in seqs.values():
            at = 0
            for o, n in sorted(own):
                assert o == at
                at += n
            assert at <= 2048 and len(own) <= (most or 2048) and sum(n * n for _, n in own) <= (cost or 2048**2)
        assert {r["doc_id"] for r in out} == {i for i, _ in rows}
    free = packing.packed(docs, P.path("word_bpe_49k.json"))
    total = free.groupBy().sum("length").first()[0]
    assert free.select("sequence_id").distinct().count() <= -(-total // 2048) + 1
    with pytest.raises(ValueError, match="capacity"):
        packing.best_fit(np.array([2049]))
