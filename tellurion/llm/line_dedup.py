"""Line deduplication by a deletion-neighbourhood join.

A line is dropped when an earlier line of the corpus is equal to it or within one
edit. The unit of editing is the word for pairs whose longer line has
``WORD_EDITS`` words or more, and the character for pairs of shorter lines, of
which a word would be a large part. White space counts as one space.

A line's variants are the line with one unit left out and the line with one gap,
as hashed keys that name length and place. Lines that share a key are all within
one edit of each other, so the earliest line of a key answers for all its
lines: groups are aggregated, and pairs are never listed. Each answer is verified
on the lines themselves.

A variant is emitted only where another line may have it. A line with a whole
block of units left out says so cheaply: one edit lies in one block, and the lines
agree in all others. Lines are first held against each other with one of two
blocks left out, those that are left with one of ``BLOCKS``, and only the blocks
that agree with another line's are taken apart. None of this loses a pair.

Only DataFrame operations are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tellurion.llm.common import BROADCAST_ROWS, land, run_dir, table, text_of

#: Words of the longer line from which a pair is edited by words.
WORD_EDITS = 10
BLOCKS = 8
LAST = 9223372036854775807
#: A line's place in the corpus as one number that compares as (id, line) does.
PLACE = "decimal(38,0)"


def numbered(rows: DataFrame) -> DataFrame:
    """Rows (rid, doc_id, text) with ``row``, a number that compares as (id, rid) does, with null ids last.

    Rows whose id is their own need nothing but the id. Those that share one, null
    ids among them, are put in order over ranges and counted; they are told apart by
    that count. The rows are landed then, as ``rid`` must be what it was.
    """
    rows = rows.withColumn("ord", F.coalesce("doc_id", F.lit(LAST)))
    number = lambda sub: (F.col("ord").cast("decimal(20,0)") * F.lit(1 << 31).cast("decimal(10,0)") + sub).cast(PLACE)
    again = rows.groupBy("ord").agg(F.count(F.lit(1)).alias("times")).filter("times > 1").select("ord")
    path = run_dir(rows.sparkSession, "rows")
    again = land(again, f"{path}/again")
    if not again.limit(1).count():
        return rows.withColumn("row", number(F.lit(0))).drop("ord")
    rows = land(rows, f"{path}/rows")
    n = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    shared = rows.select("rid", "ord").join(again, "ord", "left_semi").repartitionByRange(n, "ord", "rid").sortWithinPartitions("ord", "rid")
    shared = land(shared.select(F.col("rid").alias("shared"), F.monotonically_increasing_id().alias("at")), f"{path}/shared")
    # A row for each partition says how many come before it.
    sizes = {r["p"]: r["c"] for r in shared.groupBy(F.shiftright("at", 33).alias("p")).agg(F.count(F.lit(1)).alias("c")).collect()}
    if sum(sizes.values()) >= 1 << 31:
        raise ValueError("more than 2^31 rows share their ids")
    before = [sum(c for q, c in sizes.items() if q < p) for p in range(max(sizes) + 1)]
    sub = F.element_at(F.array(*map(F.lit, before)), (F.shiftright("at", 33) + 1).cast("int")) + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    shared = shared.select("shared", sub.alias("sub"))
    return rows.join(shared, F.col("rid") == F.col("shared"), "left").withColumn("row", number(F.coalesce("sub", F.lit(0)).cast("decimal(10,0)"))).select("rid", "doc_id", "text", "row")


def normalised(raw: Column) -> Column:
    """Words with one space between; single spaces, which are most, are left as they stand."""
    return F.trim(F.regexp_replace(raw, r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " "))


def keyed(rows: DataFrame) -> DataFrame:
    """norm replaced or joined by n (words) and key (128 bits)."""
    rows = rows.withColumn("n", F.when(F.col("norm") == "", 0).otherwise(F.octet_length("norm") - F.octet_length(F.replace("norm", F.lit(" "), F.lit(""))) + 1).cast("int"))
    return rows.withColumn("key", F.substring(F.unhex(F.sha2(F.col("norm").cast("binary"), 256)), 1, 16))


class Unit:
    """Words or characters of the normalised line: how many, and the first or last few of them."""

    def __init__(self, name: str):
        self.name = name

    def length(self) -> Column:
        return F.col("n") if self.name == "word" else F.length("norm")

    def ahead(self, k: Column) -> Column:
        return F.call_function("substring_index", F.col("norm"), F.lit(" "), k) if self.name == "word" else F.substring("norm", F.lit(1), k)

    def behind(self, k: Column) -> Column:
        if self.name == "word":
            return F.call_function("substring_index", F.col("norm"), F.lit(" "), -k)
        return F.substring("norm", F.length("norm") - k + 1, k)

    def key(self, seed: int, m: Column, at: Column, a: Column, b: Column) -> Column:
        """What stays of a line of ``m`` units, or of ``m + 1`` with one left out, without those from a to b."""
        return F.xxhash64(F.lit(seed), F.lit(self.name), m, at, self.ahead(a), self.behind(m - b))


WORD, CHAR = Unit("word"), Unit("char")
#: (unit, whether the line is the longer one or of equal length, what lines take part): lengths are those that stay.
SLOTS = [
    (WORD, True, lambda n: n >= WORD_EDITS),
    (WORD, False, lambda n: n >= WORD_EDITS - 1),
    (CHAR, True, lambda n: (n > 0) & (n < WORD_EDITS)),
    (CHAR, False, lambda n: (n > 0) & (n < WORD_EDITS)),
]


def bounds(m: Column, block, blocks: int) -> tuple[Column, Column]:
    """Where a block of a line of m units begins and ends."""
    i = block if isinstance(block, Column) else F.lit(block)
    return F.floor(i * m / blocks).cast("int"), F.floor((i + 1) * m / blocks).cast("int")


def block_keys(blocks: int) -> Column:
    """An array of (slot, block, k) for each block left out under each slot that the line takes part in."""
    out = []
    for s, (unit, longer, part) in enumerate(SLOTS):
        m = unit.length() - (1 if longer else 0)
        for i in range(blocks):
            k = unit.key(blocks, m, F.lit(i), *bounds(m, i, blocks))
            out.append(F.when(part(F.col("n")), F.struct(F.lit(s).alias("slot"), F.lit(i).alias("block"), k.alias("k"))))
    return F.array_compact(F.array(*out))


def halves() -> list[Column]:
    """The keys with one of two blocks left out: four for the unit that all of a line's pairs share, two for its other."""
    n = F.col("n")
    own = []
    for longer in (True, False):
        for i in (0, 1):
            w, c = (F.when(p(n), u.key(2, (m := u.length() - (1 if longer else 0)), F.lit(i), *bounds(m, i, 2))) for u, x, p in SLOTS if x == longer)
            own.append((w, c))
    # A line takes part by words, by characters, or, one word short of the bound, by both.
    columns = [F.coalesce(w, c) for w, c in own]
    both = [F.when(n == WORD_EDITS - 1, c) for _, c in own[2:]]
    return columns + both


def variants(lines: DataFrame) -> DataFrame:
    """k, k2 for each place in the blocks that ``lines`` (key, at, n, norm, slot, block) name."""
    out = None
    for s, (unit, longer, _) in enumerate(SLOTS):
        m = unit.length() - (1 if longer else 0)
        a, b = bounds(m, F.col("block"), BLOCKS)
        rows = lines.filter(F.col("slot") == s).select("key", "at", "n", "norm", F.explode(F.sequence(a, b)).alias("j"))
        j = F.col("j")
        rows = rows.select("key", "at", unit.key(1, m, j, j, j).alias("k"), unit.key(2, m, j, j, j).alias("k2"))
        out = rows if out is None else out.unionByName(rows)
    # Neighbouring blocks share a place.
    return out.distinct()


def within_one(a: Column, b: Column) -> Column:
    """Whether two arrays of words are one edit apart at most."""
    p = F.array_position(F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False))), F.lit(False)).cast("int")
    most = F.greatest(F.size(a), F.size(b))

    def rest(x: Column, at: Column) -> Column:
        return F.slice(x, at, most)

    return F.when(p == 0, True).when(F.size(a) == F.size(b), rest(a, p + 1) == rest(b, p + 1)).when(F.size(a) == F.size(b) + 1, rest(a, p + 1) == rest(b, p)).when(F.size(b) == F.size(a) + 1, rest(b, p + 1) == rest(a, p)).otherwise(False)


def small(df: DataFrame) -> DataFrame:
    """A landed table marked for broadcasting if it was counted and is small."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def near_lines(rows: DataFrame, first: DataFrame, path: str) -> DataFrame:
    """key, near: distinct lines with a neighbour, and the place of the earliest one; ``rows`` are the documents."""
    ids = first.filter("n > 0").select(F.xxhash64("key").alias("id"), F.explode(F.array_compact(F.array("h0", "h1", "h2", "h3", "h4", "h5"))).alias("half"))
    shared = ids.groupBy("half").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("half")
    some = land(ids.join(shared, "half", "left_semi").select("id").distinct(), f"{path}/hopeful")
    some = first.withColumn("id", F.xxhash64("key")).join(small(some), "id", "left_semi").select("key", "at")
    # Their words come from where each stands first: a document is taken apart for the lines that it is asked for.
    width = F.lit(1 << 31).cast("decimal(10,0)")
    line = F.pmod("at", width)
    some = some.select("key", "at", ((F.col("at") - line) / width).cast(PLACE).alias("of"), line.cast("int").alias("line"))
    asked = land(some.groupBy("of").agg(F.collect_list(F.struct("key", "at", "line")).alias("own")), f"{path}/asked")
    # Broadcast by the lines that it holds, not by its rows.
    held = asked.agg(F.sum(F.size("own"))).first()[0] or 0
    few = F.broadcast(asked) if held <= BROADCAST_ROWS else asked
    lines = rows.join(few, rows["row"] == few["of"]).select(F.split("text", "\n").alias("raw"), "own").select("raw", F.explode("own").alias("o"))
    lines = lines.select(F.col("o.key").alias("of"), F.col("o.at").alias("at"), normalised(F.get("raw", F.col("o.line"))).alias("norm"))
    lines = keyed(lines.filter("norm is not null")).filter("key = of").dropDuplicates(["key"]).select("key", "at", "n", "norm")
    lines = land(lines, f"{path}/words")

    blocks = lines.select("key", F.explode(block_keys(BLOCKS)).alias("b")).select("key", "b.slot", "b.block", "b.k")
    blocks = land(blocks, f"{path}/blocks")
    shared = blocks.groupBy("k").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("k")
    taken = blocks.join(shared, "k", "left_semi").select("key", "slot", "block")
    every = land(variants(taken.join(lines, "key")), f"{path}/variants")
    top = every.groupBy("k", "k2").agg(F.min("at").alias("near"), F.count(F.lit(1)).alias("c")).filter("c > 1").select("k", "k2", "near")
    found = every.join(top, ["k", "k2"]).filter("at != near").groupBy("key").agg(F.min("near").alias("near"))
    pairs = found.join(lines.select("key", "n", "norm"), "key").join(lines.select(F.col("at").alias("near"), F.col("n").alias("m"), F.col("norm").alias("other")), "near")
    same = F.when(F.greatest("n", "m") < WORD_EDITS, F.levenshtein("norm", "other", 1) >= 0).otherwise(within_one(F.split("norm", " "), F.split("other", " ")))
    return land(pairs.filter(same).select("key", "near"), f"{path}/near")


def marked(rows: DataFrame) -> DataFrame:
    """rid, doc_id, n_lines, n_exact, n_near, dropped for rows of (rid, doc_id, text)."""
    path = run_dir(rows.sparkSession, "line-dedup")
    rows = numbered(rows)
    lines = rows.select("rid", "doc_id", "row", F.posexplode(F.split("text", "\n")).alias("line", "raw")).withColumn("norm", normalised(F.col("raw"))).drop("raw")
    at = (F.col("row").cast("decimal(29,0)") * F.lit(1 << 31).cast("decimal(10,0)") + F.col("line").cast("decimal(10,0)")).cast(PLACE)
    lines = keyed(lines).select("rid", "doc_id", at.alias("at"), "line", "n", "key", *[h.alias(f"h{i}") for i, h in enumerate(halves())])
    lines = land(lines, f"{path}/lines")
    # Numbers only, so that groups are hashed and never sorted.
    first = lines.filter("n > 0").groupBy("key").agg(F.min("at").alias("at"), F.count(F.lit(1)).alias("times"), F.max("n").alias("n"), *[F.max(f"h{i}").alias(f"h{i}") for i in range(6)])
    first = land(first, f"{path}/first")
    near = near_lines(rows, first, path)
    told = first.select("key", F.col("at").alias("first"), "times").join(near, "key", "left").withColumn("near", F.coalesce(F.col("near") < F.col("first"), F.lit(False)))
    told = land(told.filter("times > 1 or near").drop("times"), f"{path}/told")
    out = lines.filter("n > 0").select("rid", "line", "at", "key").join(small(told), "key")
    out = out.select("rid", "line", (F.col("at") != F.col("first")).alias("exact"), "near").filter("exact or near")
    out = out.groupBy("rid").agg(F.count_if("exact").alias("n_exact"), F.count_if(~F.col("exact")).alias("n_near"), F.sort_array(F.collect_list("line")).alias("dropped"))
    whole = lines.groupBy("rid", "doc_id").agg(F.count(F.lit(1)).alias("n_lines"))
    zero, none = F.lit(0).cast("long"), F.array().cast("array<int>")
    return whole.join(out, "rid", "left").select("rid", "doc_id", "n_lines", F.coalesce("n_exact", zero).alias("n_exact"), F.coalesce("n_near", zero).alias("n_near"), F.coalesce("dropped", none).alias("dropped"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_lines, n_exact, n_near, dropped (line numbers from 0, ascending).

    Earlier means a smaller id, then a smaller line number. Lines without words
    are never dropped, and a null text is one such line. Null ids come last. Rows
    that repeat an id, or have none, come in their own order and are documents of
    their own. An empty table gives an empty result; other columns play no part.
    """
    return marked(docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))).drop("rid")


def without_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows with dropped lines taken out of their texts; all columns stay, whatever their names.

    Rows are told apart by a number of their own, so rows that repeat an id keep
    what is theirs. Null texts stay null.
    """
    path = run_dir(docs.sparkSession, "without-lines")
    names = [f"c{i}" for i in range(len(docs.columns))]
    own = land(docs.toDF(*names).withColumn("rid", F.monotonically_increasing_id()), f"{path}/rows")
    text = names[docs.columns.index(text_col)]
    rows = own.select("rid", F.col(names[docs.columns.index(id_col)]).cast("long").alias("doc_id"), text_of(text).alias("text"))
    gone = marked(rows).filter(F.size("dropped") > 0).select("rid", "dropped")
    out = own.join(gone, "rid", "left")
    kept = F.array_join(F.filter(F.split(text, "\n"), lambda x, i: ~F.array_contains("dropped", i)), "\n")
    out = out.withColumn(text, F.when(F.col("dropped").isNull(), F.col(text)).otherwise(kept))
    return out.select(*names).toDF(*docs.columns)


def op1_line_dedup(spark, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents")).withColumn("dropped", F.array_join("dropped", ","))


# Every line with a wildcard for each unit and in each gap; lines that share such a string are within one edit.
SQL = rf"""
WITH src AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
d AS (SELECT rid, doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM src),
l AS MATERIALIZED (SELECT rid, doc_id, (coalesce(doc_id, {LAST}), rid, line) AS place, line, regexp_extract_all(raw, '[^\x20\x09-\x0D]+') AS w FROM d),
f AS MATERIALIZED (SELECT w, min(place) AS loc, array_to_string(w, ' ') AS s FROM l WHERE len(w) > 0 GROUP BY w),
v AS MATERIALIZED (SELECT DISTINCT w, loc, unnest(list_concat(
    CASE WHEN len(w) >= {WORD_EDITS} THEN list_transform(range(1, len(w) + 1), lambda i: md5('w' || array_to_string(list_concat(w[1 : i - 1], [chr(9)], w[i + 1 :]), ' '))) ELSE [] END,
    CASE WHEN len(w) >= {WORD_EDITS} - 1 THEN list_transform(range(1, len(w) + 2), lambda i: md5('w' || array_to_string(list_concat(w[1 : i - 1], [chr(9)], w[i :]), ' '))) ELSE [] END,
    CASE WHEN len(w) < {WORD_EDITS} THEN list_transform(range(1, length(s) + 1), lambda i: md5('c' || substr(s, 1, i - 1) || chr(9) || substr(s, i + 1))) ELSE [] END,
    CASE WHEN len(w) < {WORD_EDITS} THEN list_transform(range(1, length(s) + 2), lambda i: md5('c' || substr(s, 1, i - 1) || chr(9) || substr(s, i))) ELSE [] END)) AS k
  FROM f),
g AS (SELECT k, min(loc) AS top FROM v GROUP BY k),
near AS (SELECT w, min(top) AS top FROM v JOIN g USING (k) GROUP BY w),
t AS (SELECT l.rid, l.doc_id, l.line, f.loc IS NOT NULL AND l.place <> f.loc AS exact, coalesce(near.top < f.loc, false) AS near
  FROM l LEFT JOIN f ON f.w = l.w LEFT JOIN near ON near.w = l.w)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (exact) AS n_exact, count(*) FILTER (near AND NOT exact) AS n_near,
  coalesce(array_to_string(list_sort(list(line) FILTER (exact OR near)), ','), '') AS dropped FROM t GROUP BY rid, doc_id
"""
