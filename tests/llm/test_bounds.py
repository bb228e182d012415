"""Cases that earlier bounds of the operators left out."""

import base64
import random

import numpy as np

from tellurion.llm import minhash_dedup, secret_scan


def test_near_dedup_bound_of_the_pipeline(spark):
    """Pairs between 0.80 and 0.85 are near copies for the pipeline's stage, though not for op6."""
    import corpus_pipeline as cp

    rows = []
    for k in range(20):
        words = [f"w{k}x{i}" for i in range(200)]
        rows.append((2 * k, " ".join(words)))
        for at in (30, 80, 120, 170):
            words[at] = f"n{k}x{at}"
        rows.append((2 * k + 1, " ".join(words)))
    a, b = (minhash_dedup.shingles(t) for _, t in rows[:2])
    assert 0.80 <= len(np.intersect1d(a, b)) / len(np.union1d(a, b)) < 0.85
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in cp.unlike(spark, docs, "").collect()) == list(range(0, 40, 2))
    assert minhash_dedup.near_dedup(docs).filter("kept").count() == 40


def test_secrets_after_a_name():
    random.seed(5)
    for name in ("AWS_ACCESS=", "KEY=", "https://example.org/x?sig=", "AWS_SECRET_ACCESS_KEY="):
        hits = 0
        for _ in range(100):
            value = base64.b64encode(random.randbytes(30)).decode()
            text = f"see {name}{value} end"
            hits += value not in secret_scan.redacted(text) and name in secret_scan.redacted(text)
        assert hits >= 90, name
    short = ["".join(random.choices("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", k=19)) for _ in range(200)]
    assert sum(bool(secret_scan.random_spans(f"key {x} end", [])) for x in short) >= 50


def test_unlike_buckets_stay_apart(spark):
    """Buckets of the same size, roots and sum of ids, with other members; and one with the same members as another."""
    root = dict.fromkeys((1, 5, 6, 7, 8), 1) | dict.fromkeys((100, 107), 100)
    buckets = {11: (5, 8, 107), 12: (6, 7, 107), 13: (5, 8, 107), 14: (5, 6, 7)}
    rooted = spark.createDataFrame([(k, i, root[i]) for k, ids in buckets.items() for i in ids], "key long, id long, root long")
    assert sorted(map(tuple, minhash_dedup.open_buckets(rooted).collect())) == [(11, 3), (12, 3)]
    large = spark.createDataFrame([(k, 2**62 + i, 2**62 + i) for k in (1, 2) for i in range(4)], "key long, id long, root long")
    assert minhash_dedup.open_buckets(large).count() == 1


def test_wrapped_notices(spark):
    """Notices over several lines, behind comment marks, and beside a long line."""
    from tellurion.llm import license_scan

    notice = license_scan.TEMPLATES["apache-notice"].split()
    wrapped = "\n".join("// " + " ".join(notice[i : i + 4]) + "\n//" for i in range(0, len(notice), 4))
    grant = license_scan.TEMPLATES["mit-grant"].split()
    cut = " ".join(grant[:10]) + "\n" + " ".join(grant[10:20]) + "\n\n" + " ".join(grant[20:])
    apart = "\n".join([" ".join(grant[:10]), "word " * 200, " ".join(grant[10:20]), "word " * 200, " ".join(grant[20:])])
    docs = spark.createDataFrame([(1, wrapped), (2, "x = 1\n" + cut), (3, apart), (4, "plain words\nof no interest")], "doc_id long, text string")
    out = {r["doc_id"]: r for r in license_scan.scan(docs).collect()}
    assert out[1]["labels"] == "apache,apache-notice" and out[1]["score"] == 1.0
    assert out[2]["labels"] == "mit-grant" and out[2]["score"] == 1.0
    assert out[3]["labels"] == "" and out[4]["labels"] == "" and out[4]["score"] == 0.0


def test_long_lines_and_long_templates(spark):
    """A line's words far apart make no notice; a long template wrapped over lines is found whole."""
    from tellurion.llm import license_scan

    far = " ".join(" ".join(["plain"] * 300 + [w]) for w in ["released", "under", "the", "mit", "license"]) + " filler" * 900
    text = " ".join(f"clause{i}" if i % 3 else "the" for i in range(400))
    wrapped = "\n".join(" ".join(text.split()[i : i + 7]) for i in range(0, 400, 7))
    docs = spark.createDataFrame([(1, far), (2, "x " * 900 + wrapped + " y" * 900), (3, " ".join(text.split()[:250]))], "doc_id long, text string")
    out = {r["doc_id"]: r for r in license_scan.scan(docs, templates={**license_scan.TEMPLATES, "long": text}).collect()}
    assert (out[1]["labels"], out[1]["score"]) == ("", 0.0)
    assert (out[2]["labels"], out[2]["score"]) == ("long", 1.0)
    assert (out[3]["labels"], out[3]["score"]) == ("", 0.0)


def test_near_copy_under_a_repeated_id(spark):
    """A row goes as a near copy although its id has another, unlike row; that row stays."""
    words = [f"w{i}" for i in range(100)]
    near = " ".join([*words[:99], "other"])
    rows = [(1, " ".join(words), "a"), (2, near, "b"), (2, " ".join(f"u{i}" for i in range(50)), "c"), (3, near, "d"), (None, near, "e"), (4, "", "f"), (4, "", "g")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, at string").repartition(3)
    assert sorted(r["at"] for r in minhash_dedup.keep_one(docs).collect()) == ["a", "c", "e", "f", "g"]
