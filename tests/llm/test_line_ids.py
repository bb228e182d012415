"""Line dedup where ids repeat or are missing, against the SQL on the same rows."""

import random

import duckdb

from tellurion.llm import line_dedup


def compared(spark, tmp_path, rows):
    import pyarrow as pa
    import pyarrow.parquet as pq

    pq.write_table(pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": pa.array([r[1] for r in rows], pa.string())}), f"{tmp_path}/documents.parquet")
    got = line_dedup.op1_line_dedup(spark, str(tmp_path))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'")
    want = db.execute(line_dedup.SQL)
    names = [d[0] for d in want.description]
    found = sorted(map(str, map(tuple, got.select(*names).collect())))
    assert found == sorted(map(str, want.fetchall()))
    return got


def test_repeated_and_null_ids(spark, tmp_path):
    line = "a b c d e f g h i"
    rows = [(1, f"{line} jj"), (1, f"{line} kk"), (2, f"{line} ll"), (None, "one two three"), (None, "one two three"), (None, "other words here"), (None, "one two three four five"), (3, None), (3, ""), (3, "x\nx")]
    got = {(r["doc_id"], r["n_lines"], r["n_exact"], r["n_near"], r["dropped"]) for r in compared(spark, tmp_path, rows).collect()}
    assert (2, 1, 0, 1, "0") in got and (None, 1, 1, 0, "0") in got


def test_random_ids(spark, tmp_path):
    rng = random.Random(6)
    vocab = ["red", "blue", "green", "stone", "river", "hill", "a", "b"]
    lines = [" ".join(rng.choices(vocab, k=rng.choice([1, 2, 9, 10, 11]))) for _ in range(25)]
    rows = []
    for _ in range(60):
        own = []
        for _ in range(rng.randint(0, 6)):
            ws = rng.choice(lines).split()
            if rng.random() < 0.4:
                ws[rng.randrange(len(ws))] = rng.choice(vocab)
            own.append("  ".join(ws))
        rows.append((rng.choice([None, 1, 2, 3, -5, 2**62, rng.randint(10, 99)]), "\n".join(own)))
    compared(spark, tmp_path, rows)
