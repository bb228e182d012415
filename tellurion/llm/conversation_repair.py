"""Conversation structure repair: the cheapest edits that make roles alternate, by a checkpointed dynamic programme.

The roles' initials of a repaired conversation read ``(s?(ua)+)?``, an automaton of
four states. Backward from a conversation's end, each row turns the vector of the
four states' least costs into that of the place before it. Those vectors are
stored at checkpoints only, every square root of the longest conversation's rows;
the blocks between are gone through again while edits are walked forward.

Blocks lie in many tasks. A block's rows are first made one 4 x 4 table of least
costs between the state before and the state after it; a conversation's tables, as
many as it has blocks, give the vectors at its checkpoints. Then each block walks
from every state that it may be entered in, and a conversation's walks are chained.
So no task holds more of a conversation than a block's rows or a row for each block.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tellurion.llm.common import bounded, land, run_dir, table, text_of

#: What edits cost; a truncated row that stays costs as much as it says.
RENAME, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Rows of a block of texts, and of the smallest block of costs.
TEXT_BITS, LEAST_BITS = 8, 8
#: Places within a partition of ordered rows, in bits.
PLACE_BITS = 33
SPACE = " \t\n\x0b\x0c\r"

# The automaton: nothing yet, after system, after user, after assistant.
STATES, ENDS = range(4), (0, 3)
AFTER = {"u": (2, 2, None, 2), "a": (None, None, 3, None), "s": (1, None, None, None)}
#: Where an inserted or renamed turn leads: the one that may come next.
NEXT = (2, 2, 3, 2)
ROLE = {2: "user", 3: "assistant"}
FAR = 1 << 60


def closed(w: list[int]) -> list[int]:
    """Least costs where turns may be inserted first."""
    two, three = min(w[2], INSERT + w[3]), min(w[3], INSERT + w[2])
    return [min(w[0], INSERT + two), min(w[1], INSERT + two), two, three]


#: Least costs at a conversation's end.
END = closed([0 if q in ENDS else FAR for q in STATES])


def before(code: str, v: list[int]) -> list[int]:
    """Least costs before a row, from those after it.

    ``code`` is ``x`` for a row that must go, or else its role's initial (``o`` for
    any but s, u and a), upper-case if the row is truncated.
    """
    if code == "x":
        return closed([DELETE + c for c in v])
    own = AFTER.get(code.lower(), (None,) * 4)
    more = TRUNCATED if code.isupper() else 0
    w = []
    for q in STATES:
        least = min(DELETE + v[q], RENAME + more + v[NEXT[q]])
        if own[q] is not None:
            least = min(least, more + v[own[q]])
        w.append(least)
    return closed(w)


def block_costs(codes: str) -> list[int]:
    """Least costs from each state before the block to each state after it, row by row of the table."""
    ends = []
    for end in STATES:
        v = [0 if q == end else FAR for q in STATES]
        for code in reversed(codes):
            v = before(code, v)
        ends.append(v)
    return [min(ends[end][q], FAR) for q in STATES for end in STATES]


def walk(codes: str, after: list[int], state: int, last: bool) -> tuple[str, int]:
    """The ASCII-least of the cheapest edits through a block that is entered in ``state``, and the state after it.

    ``after`` are the least costs behind the block; the last block also inserts what is missing at the end.
    """
    vs = [after]
    for code in reversed(codes):
        vs.append(before(code, vs[-1]))
    vs.reverse()
    out, i, q = [], 0, state
    while i < len(codes) or (last and q not in ENDS):
        here = vs[i][q]
        if i < len(codes) and here == DELETE + vs[i + 1][q]:
            out.append("D")
            i += 1
            continue
        if here == INSERT + vs[i][NEXT[q]]:
            out.append("I")
            q = NEXT[q]
            continue
        code = codes[i]
        more = TRUNCATED if code.isupper() else 0
        own = AFTER.get(code.lower(), (None,) * 4)[q]
        if own is not None and here == more + vs[i + 1][own]:
            out.append("K")
            q = own
        else:
            out.append("R")
            q = NEXT[q]
        i += 1
    return "".join(out), q


def actions(codes: str, edits: str, state: int) -> list[tuple[int, list[str], str, str | None, list[str]]]:
    """Row, roles inserted before it, its edit, its new role and roles inserted after it, but for rows that just stay."""
    out, i, q, new = [], 0, state, []
    for e in edits:
        if e == "I":
            q = NEXT[q]
            new.append(ROLE[q])
            continue
        role = None
        if e != "D":
            q = NEXT[q] if e == "R" else AFTER[codes[i].lower()][q]
            role = ROLE[q] if e == "R" else None
        if e != "K" or new:
            out.append((i, new, e, role, []))
        i, new = i + 1, []
    if new:
        if out and out[-1][0] == i - 1:
            out[-1][4].extend(new)
        else:
            out.append((i - 1, [], "K", None, new))
    return out


def runs(batches: Iterator[pa.RecordBatch], by: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Rows that agree in their first ``by`` columns; sorted batches come in, one run is held at a time."""
    key, rows = None, []
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if row[:by] != key:
                if rows:
                    yield key, rows
                key, rows = row[:by], []
            rows.append(row)
    if rows:
        yield key, rows


def records(rows: Iterator[tuple], schema: pa.Schema, most: int = 512) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= most:
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


class Repaired(NamedTuple):
    """What ``repair`` gives.

    ``conversations``: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit.
    ``turns``: conv_id, ord, at, role, text; repaired turns in order of ord and at.
    """

    conversations: DataFrame
    turns: DataFrame


def conv_key(conv: Column) -> Column:
    """A string that is never null and tells null from all values."""
    return F.when(conv.isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), conv.cast("string")))


def ordered(rows: DataFrame, path: str) -> DataFrame:
    """Landed rows with ``ord``, increasing over each conversation: by turn (nulls first), role, and the text's SHA-256.

    Rows are dealt by ranges of that order, so a long conversation lies in many tasks;
    texts take no part in finding the ranges. Equal rows may change places.
    """
    own = rows.withColumns({"key": conv_key(F.col("conv_id")), "sha": F.sha2("text", 256), "rid": F.monotonically_increasing_id()})
    order = [F.col("key"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("sha"), F.col("rid")]
    n = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    dealt = own.repartitionByRange(n, *order).sortWithinPartitions(*order)
    return land(dealt.withColumn("ord", F.monotonically_increasing_id()).select("key", "conv_id", "turn", "role", "text", "sha", "ord"), path)


def repair(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> Repaired:
    """The cheapest edits of every conversation, and what they make of it.

    A row's first fault counts: blank, duplicate (role and text came before) or
    truncated (its last character but white space isn't ``.``, ``!`` or ``?``). Blank
    and duplicate rows must go. Null roles and texts count as one space; a null
    turn comes first and makes no gap; null conversations are one conversation. An
    empty role may not stay as it is. Rows of one turn go by role, then by the
    text's SHA-256. An empty table gives empty results; other columns play no part.
    """
    spark, path = turns.sparkSession, run_dir(turns.sparkSession, "conversations")
    role, text = F.coalesce(F.col(role_col), F.lit(" ")), F.coalesce(F.col(text_col), F.lit(" "))
    rows = ordered(turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), role.alias("role"), text.alias("text")), f"{path}/rows")

    trimmed = F.rtrim("text", F.lit(SPACE))
    light = rows.select("key", "role", "sha", "ord", F.substring("role", 1, 1).alias("initial"), (F.length(trimmed) == 0).alias("blank"), F.substring(trimmed, -1, 1).isin(".", "!", "?").alias("ended"))
    # Of equal rows the first is new; the join is by ``ord``, of which each row has its own.
    first = light.filter(~F.col("blank")).groupBy("key", "role", "sha").agg(F.min("ord").alias("ord")).select("ord", F.lit(True).alias("new"))
    fault = F.when(F.col("blank"), "b").when(F.col("new").isNull(), "d").when(~F.col("ended"), "t").otherwise("k")
    kind = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("o")
    longest = rows.groupBy("key").count().agg(F.max("count")).first()[0] or 1
    bits = min(max(LEAST_BITS, math.ceil(math.log2(math.sqrt(longest)))), PLACE_BITS - 1)
    coded = light.join(first, "ord", "left").select("key", F.shiftright("ord", bits).alias("block"), "ord", fault.alias("fault"), kind.alias("kind"))
    summary = land(_summaries(coded), f"{path}/blocks")
    ends = land(_checkpoints(summary), f"{path}/checkpoints")
    walks = land(_walks(summary, ends), f"{path}/walks")
    chosen = land(_chained(walks), f"{path}/edits")

    gaps = rows.groupBy("key").agg(F.min("conv_id").alias("conv_id"), F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).alias("gaps"))
    whole = ends.filter("cost is not null").select("key", "blank", "duplicate", "truncated", "illegal", "cost")
    audit = chosen.groupBy("key").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "edits"))), lambda b: b["edits"]), "").alias("audit"))
    conversations = gaps.join(whole, "key").join(audit, "key").select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")

    changed = chosen.select(F.explode("actions").alias("c")).select("c.*")
    made = lambda roles: F.transform(roles, lambda r: F.struct(r.alias("role"), F.lit("").alias("text")))
    none = F.array().cast("array<struct<role:string,text:string>>")
    own = F.when(F.col("edit") == "D", none).otherwise(F.array(F.struct(F.coalesce("new_role", "role").alias("role"), F.col("text").alias("text"))))
    lines = F.concat(F.coalesce(made(F.col("roles_before")), none), F.coalesce(own, none), F.coalesce(made(F.col("roles_after")), none))
    repaired = rows.select("key", "conv_id", "role", "text", "ord").join(changed, "ord", "left").select("conv_id", "ord", F.posexplode(lines).alias("at", "line")).select("conv_id", "ord", "at", "line.role", "line.text")
    return Repaired(conversations, repaired)


def _dealt(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    return df.repartition(n, *keys).sortWithinPartitions(*order)


def _summaries(coded: DataFrame) -> DataFrame:
    """key, block, start (its first ord), codes, costs between states, counts of faults and of illegal pairs, first and last initials."""
    schema = pa.schema([
        ("key", pa.string()), ("block", pa.int64()), ("start", pa.int64()), ("codes", pa.string()), ("costs", pa.list_(pa.int64())),
        ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()), ("first", pa.string()), ("last", pa.string()),
    ])

    def one(key: tuple, rows: list[tuple]) -> tuple:
        faults, kinds = "".join(r[3] for r in rows), "".join(r[4] for r in rows)
        codes = "".join("x" if f in "bd" else k.upper() if f == "t" else k for f, k in zip(faults, kinds, strict=True))
        illegal = sum(kinds[i : i + 2] not in LEGAL for i in range(len(kinds) - 1))
        return (*key, rows[0][2], codes, block_costs(codes), faults.count("b"), faults.count("d"), faults.count("t"), illegal, kinds[0], kinds[-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from records((one(k, rows) for k, rows in runs(batches, 2)), schema)

    ddl = "key string, block long, start long, codes string, costs array<long>, blank long, duplicate long, truncated long, illegal long, first string, last string"
    return _dealt(coded, ["key", "block"], ["key", "block", "ord"]).mapInArrow(bounded(run), ddl)


LEGAL = ("su", "ua", "au")


def _checkpoints(summary: DataFrame) -> DataFrame:
    """key, block, least costs behind it, whether it is the first and the last; the conversation's sums stand in its first block's row."""
    schema = pa.schema([
        ("key", pa.string()), ("block", pa.int64()), ("after", pa.list_(pa.int64())), ("is_first", pa.bool_()), ("is_last", pa.bool_()), ("cost", pa.int64()),
        ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()),
    ])

    def of(rows: list[tuple]) -> Iterator[tuple]:
        v, out = END, []
        for r in reversed(rows):
            out.append(v)
            v = closed([min(r[2][4 * q + end] + v[end] for end in STATES) for q in STATES])
        out.reverse()
        pairs = sum(a[8] + b[7] not in LEGAL for a, b in zip(rows, rows[1:], strict=False))
        sums = [sum(r[k] for r in rows) for k in (3, 4, 5, 6)]
        for k, r in enumerate(rows):
            own = (v[0], *sums[:3], sums[3] + pairs) if k == 0 else (None,) * 5
            yield (*r[:2], out[k], k == 0, k == len(rows) - 1, *own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from records((row for _, rows in runs(batches, 1) for row in of(rows)), schema)

    own = summary.select("key", "block", "costs", "blank", "duplicate", "truncated", "illegal", "first", "last")
    ddl = "key string, block long, after array<long>, is_first boolean, is_last boolean, cost long, blank long, duplicate long, truncated long, illegal long"
    return _dealt(own, ["key"], ["key", "block"]).mapInArrow(bounded(run), ddl)


def _walks(summary: DataFrame, ends: DataFrame) -> DataFrame:
    """key, block, start, codes, and the edits and the state after them for each state that the block may be entered in."""
    schema = pa.schema([("key", pa.string()), ("block", pa.int64()), ("start", pa.int64()), ("codes", pa.string()), ("edits", pa.list_(pa.string())), ("states", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for b in batches:
                for key, block, start, codes, after, is_first, is_last in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    found = [walk(codes, after, q, is_last) for q in ((0,) if is_first else STATES)]
                    yield key, block, start, codes, [f[0] for f in found], [f[1] for f in found]

        yield from records(rows(), schema)

    both = summary.select("key", "block", "start", "codes").join(ends.select("key", "block", "after", "is_first", "is_last"), ["key", "block"])
    return both.mapInArrow(bounded(run), "key string, block long, start long, codes string, edits array<string>, states array<int>")


ACTION = "struct<ord:long,roles_before:array<string>,edit:string,new_role:string,roles_after:array<string>>"


def _chained(walks: DataFrame) -> DataFrame:
    """key, block, its edits and its actions on rows: a conversation's blocks each start in the state that the one before ends in."""
    action = pa.struct([("ord", pa.int64()), ("roles_before", pa.list_(pa.string())), ("edit", pa.string()), ("new_role", pa.string()), ("roles_after", pa.list_(pa.string()))])
    schema = pa.schema([("key", pa.string()), ("block", pa.int64()), ("edits", pa.string()), ("actions", pa.list_(action))])
    names = [f.name for f in action]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            of, state = None, 0
            for b in batches:
                for key, block, start, codes, edits, states in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    if key != of:
                        of, state = key, 0
                    own = edits[state]
                    yield key, block, own, [dict(zip(names, (start + a[0], *a[1:]), strict=True)) for a in actions(codes, own, state)]
                    state = states[state]

        yield from records(rows(), schema, 64)

    return _dealt(walks, ["key"], ["key", "block"]).mapInArrow(bounded(run), f"key string, block long, edits string, actions array<{ACTION}>")


def digests(turns: DataFrame) -> DataFrame:
    """conv_key, repaired_sha256 of ``role:text`` lines, for each conversation with a repaired turn.

    Lines are joined in blocks of rows first, so the task that a conversation's
    digest needs, as SHA-256 runs from front to end, reads few rows and holds one block.
    """
    line = F.concat("role", F.lit(":"), "text")
    blocks = turns.select(conv_key(F.col("conv_id")).alias("key"), F.shiftright("ord", TEXT_BITS).alias("block"), F.struct("ord", "at", line.alias("line")).alias("l"))
    blocks = blocks.groupBy("key", "block").agg(F.array_join(F.transform(F.sort_array(F.collect_list("l")), lambda x: x["line"]), "\n").alias("lines"))
    schema = pa.schema([("key", pa.string()), ("repaired_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            of, sha = None, None
            for b in batches:
                for key, lines in zip(b.column(0).to_pylist(), b.column(2), strict=True):
                    if key != of:
                        if sha is not None:
                            yield of, sha.hexdigest()
                        of, sha = key, hashlib.sha256()
                    else:
                        sha.update(b"\n")
                    sha.update(lines.as_py().encode())
            if sha is not None:
                yield of, sha.hexdigest()

        yield from records(rows(), schema)

    return _dealt(blocks, ["key"], ["key", "block"]).mapInArrow(bounded(run), "key string, repaired_sha256 string")


def damaged(rows: DataFrame) -> DataFrame:
    """The rows after the faults that their ids' CRC-32 names, modulo 20."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn"))) % 20
    own = rows.select("conv_id", "turn", blank("role").alias("role"), text_of_space("text").alias("text"), fault.alias("fault")).filter("fault != 0")
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return own.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("copy")).drop("copy")


def text_of_space(col: str) -> Column:
    return F.coalesce(F.col(col), F.lit(" "))


def op11_conversation_repair(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    out = repair(damaged(rows))
    every = rows.select("conv_id").distinct().withColumn("key", conv_key(F.col("conv_id")))
    found = out.conversations.withColumn("key", conv_key(F.col("conv_id"))).drop("conv_id")
    zero = {c: F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    done = every.join(found, "key", "left").join(digests(out.turns), "key", "left")
    return done.select("conv_id", *zero.values(), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


SQL = r"""
WITH RECURSIVE src AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS id FROM conversations),
crc AS (SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, len(id) + 1), lambda i: ascii(id[i])::BIGINT)),
  lambda c, b: list_reduce(list_prepend(xor(c, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda d, z: xor(d >> 1, (d & 1) * 3988292384::BIGINT))), 4294967295::BIGINT) % 20 AS fault FROM src),
dam AS (SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role, CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN fault = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM crc WHERE fault <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i FROM dam),
f AS (SELECT *, left(role, 1) AS ini, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
  coalesce(right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) NOT IN ('.', '!', '?'), true) AS cut, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS prev FROM o),
r AS (SELECT conv_id, turn, role, text, i, ini, blank, NOT blank AND again AS dup, NOT blank AND NOT again AND cut AS trunc, blank OR again AS gone, CASE WHEN NOT blank AND NOT again AND cut THEN 5 ELSE 0 END AS more,
  prev IS NOT NULL AND prev || ini NOT IN ('su', 'ua', 'au') AS bad, count(*) OVER (PARTITION BY conv_id) AS n FROM f),
back AS (
  SELECT conv_id, n + 1 AS i, 0::BIGINT AS v0, 10::BIGINT AS v1, 5::BIGINT AS v2, 0::BIGINT AS v3 FROM (SELECT DISTINCT conv_id, n FROM r)
  UNION ALL
  SELECT conv_id, i, least(w0, 5 + w2, 10 + w3), least(w1, 5 + w2, 10 + w3), least(w2, 5 + w3), least(w3, 5 + w2) FROM (
    SELECT r.conv_id, r.i,
      CASE WHEN gone THEN 2 + v0 ELSE least(2 + v0, 1 + more + v2, CASE WHEN ini = 'u' THEN more + v2 WHEN ini = 's' THEN more + v1 ELSE 1000000000 END) END AS w0,
      CASE WHEN gone THEN 2 + v1 ELSE least(2 + v1, 1 + more + v2, CASE WHEN ini = 'u' THEN more + v2 ELSE 1000000000 END) END AS w1,
      CASE WHEN gone THEN 2 + v2 ELSE least(2 + v2, 1 + more + v3, CASE WHEN ini = 'a' THEN more + v3 ELSE 1000000000 END) END AS w2,
      CASE WHEN gone THEN 2 + v3 ELSE least(2 + v3, 1 + more + v2, CASE WHEN ini = 'u' THEN more + v2 ELSE 1000000000 END) END AS w3
    FROM back JOIN r ON r.conv_id IS NOT DISTINCT FROM back.conv_id AND r.i = back.i - 1)),
v AS (SELECT b.conv_id, b.i, [v0, v1, v2, v3] AS v, [a0, a1, a2, a3] AS nv, r.role, r.text, r.ini, r.gone, r.more FROM back b
  LEFT JOIN (SELECT conv_id, i - 1 AS i, v0 AS a0, v1 AS a1, v2 AS a2, v3 AS a3 FROM back) a ON a.conv_id IS NOT DISTINCT FROM b.conv_id AND a.i = b.i
  LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM b.conv_id AND r.i = b.i),
fwd AS (
  SELECT conv_id, 1::BIGINT AS i, 0 AS q, '' AS audit, []::VARCHAR[] AS lines, n, false AS done FROM (SELECT DISTINCT conv_id, n FROM r)
  UNION ALL
  SELECT conv_id, CASE WHEN e = 'I' OR e IS NULL THEN i ELSE i + 1 END, CASE e WHEN 'D' THEN q WHEN 'K' THEN kq WHEN 'I' THEN nx WHEN 'R' THEN nx ELSE q END, audit || coalesce(e, ''),
    CASE e WHEN 'K' THEN list_append(lines, role || ':' || text) WHEN 'R' THEN list_append(lines, CASE nx WHEN 2 THEN 'user:' ELSE 'assistant:' END || text) WHEN 'I' THEN list_append(lines, CASE nx WHEN 2 THEN 'user:' ELSE 'assistant:' END) ELSE lines END, n, e IS NULL
  FROM (SELECT *, CASE WHEN role IS NOT NULL AND v[q + 1] = 2 + nv[q + 1] THEN 'D' WHEN v[q + 1] = 5 + v[nx + 1] THEN 'I' WHEN role IS NOT NULL AND kq IS NOT NULL AND NOT gone AND v[q + 1] = more + nv[kq + 1] THEN 'K' WHEN role IS NOT NULL THEN 'R' END AS e
    FROM (SELECT f.*, v.v, v.nv, v.role, v.text, v.gone, v.more, CASE q WHEN 2 THEN 3 ELSE 2 END AS nx, CASE WHEN ini = 'u' AND q <> 2 THEN 2 WHEN ini = 'a' AND q = 2 THEN 3 WHEN ini = 's' AND q = 0 THEN 1 END AS kq
      FROM fwd f JOIN v ON v.conv_id IS NOT DISTINCT FROM f.conv_id AND v.i = f.i WHERE NOT f.done))),
fin AS (SELECT conv_id, audit, sha256(array_to_string(lines, chr(10))) AS h FROM fwd WHERE done),
s AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (dup) AS duplicate, count(*) FILTER (trunc) AS truncated, count(*) FILTER (bad) AS illegal FROM r GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(s.blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
  coalesce(b.v0, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, coalesce(h, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN fin ON fin.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN back b ON b.conv_id IS NOT DISTINCT FROM c.conv_id AND b.i = 1
"""
