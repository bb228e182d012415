"""Repairs against a search over all edits, in blocks of any size."""

import hashlib
import heapq
import random
import re

import pytest

from tellurion.llm import conversation_repair as cr

SPACE = " \t\n\x0b\x0c\r"


def plain(rows):
    """gaps .. audit and digest of one conversation's rows (turn, role, text), by least-cost search over edit strings."""
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
    seen, faults = set(), []
    for _, role, text in rows:
        bare = text.strip(SPACE)
        faults.append("b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    turns = {t for t, _, _ in rows if t is not None}
    ini = [r[:1] for _, r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(ini, ini[1:], strict=False))
    # Cheapest first, then least string: the first to reach the end is the answer.
    queue, done = [(0, "", 0, "", ())], set()
    while queue:
        cost, audit, i, roles, out = heapq.heappop(queue)
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", roles):
            break
        key = (i, roles[-1:] or "-")
        if key in done:
            continue
        done.add(key)
        may = lambda x: re.match("s?(ua)*u?$", roles + x)
        for x, name in (("u", "user"), ("a", "assistant")):
            if may(x):
                heapq.heappush(queue, (cost + 5, audit + "I", i, roles + x, (*out, f"{name}:")))
        if i < len(rows):
            heapq.heappush(queue, (cost + 2, audit + "D", i + 1, roles, out))
            if faults[i] not in ("b", "d"):
                more = 5 if faults[i] == "t" else 0
                if ini[i] in ("s", "u", "a") and may(ini[i]):
                    heapq.heappush(queue, (cost + more, audit + "K", i + 1, roles + ini[i], (*out, f"{rows[i][1]}:{rows[i][2]}")))
                for x, name in (("u", "user"), ("a", "assistant")):
                    if may(x):
                        heapq.heappush(queue, (cost + more + 1, audit + "R", i + 1, roles + x, (*out, f"{name}:{rows[i][2]}")))
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    counts = [faults.count(f) for f in "bdt"]
    return (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


def conversations(seed, n=60):
    rng = random.Random(seed)
    out = {}
    for c in range(n):
        rows = []
        for k in range(rng.randint(1, 14)):
            turn = rng.choice([k, k, k, k + 2, None])
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "unknown", None])
            rows.append((turn, role, rng.choice(["Well.", "Yes!", f"No {k}.", "open", "so ", "", " \t", "end?\n", None, "é…"])))
        rows += rng.sample(rows, min(len(rows), rng.randint(0, 2)))
        out[c if c else None] = rows
    return out


def found(out):
    sha = {r["key"]: r["repaired_sha256"] for r in cr.digests(out.turns).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    key = lambda c: "n" if c is None else f"v{c}"
    return {r["conv_id"]: (r["gaps"], r["blank"], r["duplicate"], r["truncated"], r["illegal"], r["cost"], r["audit"], sha.get(key(r["conv_id"]), empty)) for r in out.conversations.collect()}


@pytest.mark.parametrize("bits", [8, 1, 0])
def test_same_as_search(spark, monkeypatch, bits):
    """In one block, and in blocks of a row or two."""
    monkeypatch.setattr(cr, "LEAST_BITS", bits)
    monkeypatch.setattr(cr, "TEXT_BITS", bits)
    if bits < 8:
        monkeypatch.setattr(cr.math, "sqrt", lambda n: 2**bits)
    convs = conversations(bits)
    rows = [(c, t, r, x, "clash", "b") for c, own in convs.items() for t, r, x in own]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, key string, block string").repartition(5)
    assert found(cr.repair(df)) == {c: plain(own) for c, own in convs.items()}


def test_long_conversation(spark):
    """One conversation of thousands of rows goes through many blocks and tasks; another through one."""
    rng = random.Random(4)
    long = [(k, rng.choice(["user", "assistant", "assistant", "system"]), rng.choice([f"Row {k}.", f"Row {k}", "Again.", ""])) for k in range(3000)]
    rows = [(1, *r) for r in long] + [(2, 0, "user", "Hi."), (2, 1, "assistant", "Yes.")]
    out = found(cr.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    assert out == {1: plain(long), 2: plain([r[1:] for r in rows[-2:]])}


def test_names_as_ids_and_empty_tables(spark):
    df = spark.createDataFrame([("n", 0, "user", "A."), (None, 0, "assistant", "B."), ("", 1, "", "C.")], "conv_id string, turn long, role string, text string")
    out = found(cr.repair(df))
    assert out["n"] == plain([(0, "user", "A.")]) and out[None] == plain([(0, "assistant", "B.")])
    assert out[""][5] == plain([(1, "tool", "C.")])[5]
    none = cr.repair(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))
    assert none.conversations.count() == 0 and none.turns.count() == 0 and cr.digests(none.turns).count() == 0


def test_damage(spark):
    import zlib

    ids = [(c, t) for c in range(40) for t in (0, 1, None)]
    rows = [(c, t, "system", "Well. Yes! x?") for c, t in ids]
    got = cr.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    want = []
    for c, t in ids:
        k = zlib.crc32(f"{c}:{' ' if t is None else t}".encode()) % 20
        row = (c, t, "user" if k == 4 else "system", "" if k == 1 else "Well Yes x" if k == 2 else "Well. Yes! x?")
        want += [row] * (0 if k == 0 else 2 if k == 3 else 1)
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_every_conversation_is_told(spark, tmp_path):
    """Those that lose all their rows, and rows with nulls everywhere, through the query and its SQL."""
    import duckdb

    rng = random.Random(8)
    rows = [(c, t, rng.choice(["user", "assistant", "system", None]), rng.choice(["Well.", "open", None, "", "Yes!"])) for c in [*range(120), None] for t in rng.sample([0, 1, 2, 4, None], rng.randint(1, 5))]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = cr.op11_conversation_repair(spark, str(tmp_path))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = db.execute(cr.SQL)
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(str, map(tuple, got.select(*names).collect()))) == sorted(map(str, want.fetchall()))
    assert got.count() == 121
