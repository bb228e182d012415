"""Near-duplicate documents by HyperMinHash.

A document's set of word shingles is hashed once; the hash's first bits name
one of ``BUCKETS`` buckets, and each bucket keeps its least hash as a register: the number
of leading zeros and some mantissa bits after the first one. Empty buckets
borrow the register of another, chosen by a fixed sequence for each bucket, so small
sets have full sketches too. Runs of registers are band keys.

1. Documents with the same set become one class, whose smallest id stands for it.
2. In each band bucket every class is paired with one pivot. A pair goes on when its Jaccard estimate, corrected for
   chance collisions of registers, may reach the bound, and is then verified
   on the full sets. Verified links give components.
3. Buckets whose classes all lie in one component can add nothing. The classes of
   the others meet under their bucket's pivot, which most buckets of a family share,
   and are dealt in blocks there; the block pairs are compared in place:
   estimates first, then full sets, keeping only links that join what isn't
   joined yet. Nothing is capped; all links found give the final components.

No step emits all pairs of a bucket, and no step brings a whole bucket to one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tellurion.llm.common import BROADCAST_ROWS, bounded, give_back, land, run_dir, table, text_of, without

SHINGLE, BUCKETS, BAND = 5, 128, 4
MANTISSA = 10
#: Links: 100 * intersection >= percent * union; this is op6's bound.
PERCENT = 85
#: Classes in a block of an open bucket.
BLOCK = 256
#: Bytes of a group after which a worker gives its memory back.
LARGE = 16 << 20

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_WORD = _rng.integers(1, 2**63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: For each bucket, the buckets that it borrows from, in turn.
_BORROW = np.stack([_rng.permutation(BUCKETS) for _ in range(BUCKETS)])
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_UPPER = np.arange(256, dtype=np.uint8)
_UPPER[65:91] += 32


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers["up"]) < n:
        for k, b in (("up", _BASE), ("down", _INVERSE)):
            x = np.full(max(n, 1 << 16), b, np.uint64)
            x[0] = 1
            _powers[k] = np.multiply.accumulate(x)
    return _powers["up"], _powers["down"]


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of each word, A-Z lower-cased, words parted by ASCII white space.

    Sums of bytes times powers give every word's polynomial from one running
    sum; pieces of a long text are hashed apart, cut between words.
    """
    raw = _UPPER[np.frombuffer(text.encode(), np.uint8)]
    out, at, step = [], 0, 1 << 16
    space = np.flatnonzero(_SPACE[raw])
    while at < len(raw):
        end = len(raw)
        if end - at > step:
            k = np.searchsorted(space, at + step)
            end = int(space[k]) if k < len(space) else end
        out.append(_hash_part(raw[at:end]))
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _hash_part(raw: np.ndarray) -> np.ndarray:
    gap = _SPACE[raw]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], gap, [True])).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    up, down = _power(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * up[: len(raw)], out=total[1:])
    return mixed((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def shingles(text: str) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles; of the whole sequence where words are fewer."""
    w = word_hashes(text)
    if not len(w):
        return w
    k = min(SHINGLE, len(w))
    x = np.full(len(w) - k + 1, np.uint64(k), np.uint64)
    for i in range(k):
        x = mixed(x * _BASE + w[i : len(w) - k + 1 + i] * _WORD[i])
    return np.unique(x)


_EDGES = np.arange(BUCKETS, dtype=np.uint64) << np.uint64(64 - 7)


def registers(own: np.ndarray) -> np.ndarray:
    """Leading zeros and mantissa of each bucket's least hash, 16 bits; the set is sorted and not empty."""
    at = np.searchsorted(own, _EDGES)
    up = np.append(at[1:], len(own))
    full = at < up
    low = own[np.minimum(at, len(own) - 1)] << np.uint64(7) | np.uint64(1 << 6)
    zeros = 63 - np.floor(np.log2(low.astype(np.float64))).astype(np.int64)
    zeros = np.maximum(zeros, 0)
    fixed = low << zeros.astype(np.uint64)
    # A float rounds up at the very top of its binade; the first bit tells.
    short = (fixed >> np.uint64(63)) == 0
    zeros[short] += 1
    fixed[short] <<= np.uint64(1)
    reg = (zeros.astype(np.uint64) << np.uint64(MANTISSA) | (fixed >> np.uint64(63 - MANTISSA)) & np.uint64((1 << MANTISSA) - 1)).astype(np.uint16)
    if not full.all():
        lent = _BORROW[np.arange(BUCKETS), np.argmax(full[_BORROW], axis=1)]
        reg = np.where(full, reg, reg[lent])
    return reg


def band_keys(reg: np.ndarray) -> np.ndarray:
    x = reg.reshape(-1, BAND).astype(np.uint64)
    key = np.arange(len(x), dtype=np.uint64) + np.uint64(1)
    for i in range(BAND):
        key = mixed(key * _BASE + x[:, i])
    return key.view(np.int64)


#: Chance that registers of two unlike sets agree: least hashes of about equal scale share exponent and mantissa.
CHANCE = 1 / (3 * (1 << MANTISSA))


def estimate(same: np.ndarray) -> np.ndarray:
    """Jaccard from the share of registers that agree, less what agrees by chance."""
    return np.clip((same - CHANCE) / (1 - CHANCE), 0, 1)


def least_estimate(n_a: np.ndarray, n_b: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """What a pair at the bound stays above: six standard deviations of as many registers as are independent."""
    j = percent / 100
    own = np.minimum(BUCKETS, np.minimum(n_a, n_b)) / 2
    return j - 6 * np.sqrt(j * (1 - j) / own)


def linked(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    """Whether two sorted sets reach the bound."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= percent * (len(a) + len(b) - common)


def sketches(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n (set size), digest of the set, and its registers, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                x = b.slice(at, 512)
                own = [shingles(t.as_py()) for t in x.column(1)]
                yield pa.RecordBatch.from_arrays(
                    [x.column(0), pa.array([len(s) for s in own], pa.int64()), pa.array([digest_of(s) if len(s) else None for s in own], pa.binary()), pa.array([registers(s).tobytes() if len(s) else b"" for s in own], pa.binary())],
                    ["doc_id", "n", "digest", "reg"],
                )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(bounded(run), "doc_id long, n long, digest binary, reg binary")


def digest_of(own: np.ndarray) -> bytes:
    """The digest by which equal sets are told."""
    return hashlib.blake2b(own.tobytes(), digest_size=16).digest()


def full_sets(docs: DataFrame, id_col: str, text_col: str, classes: DataFrame, needed: DataFrame, path: str, repeats: bool = True) -> DataFrame:
    """id, items: the full sets of the classes in ``needed``, hashed anew from their texts.

    Sets are larger than their texts, so only those that a pair asks for are ever
    stored, where they are made; they are shuffled only if ids may come again (``repeats``).
    """
    own = land(classes.join(needed, "id", "left_semi").select("id", "digest"), f"{path}-of")
    asked = F.broadcast(own) if own.count() <= BROADCAST_ROWS else own

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                x = b.slice(at, 512)
                # An id may come with several texts: the class's has its digest.
                found = [(i, s.tobytes()) for i, t, d in zip(*x.columns, strict=True) if digest_of(s := shingles(t.as_py())) == d.as_py()]
                yield pa.RecordBatch.from_arrays([pa.array([i.as_py() for i, _ in found], pa.int64()), pa.array([s for _, s in found], pa.binary())], ["id", "items"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text")).join(asked, "id").select("id", "text", "digest").mapInArrow(bounded(run), "id long, items binary")
    return land(rows.dropDuplicates(["id"]) if repeats else rows, path)


def bands(classes: DataFrame) -> DataFrame:
    """key, id: a row for each band of each class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                keys = np.concatenate([band_keys(np.frombuffer(r.as_py(), np.uint16)) for r in b.column(1)])
                ids = np.repeat(b.column(0).to_numpy(zero_copy_only=False), BUCKETS // BAND)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(ids)], ["key", "id"])

    return classes.select("id", "reg").mapInArrow(bounded(run), "key long, id long")


def near(pairs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Of pairs with set sizes and registers, those whose estimate may reach the bound."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            na, nb = (b.column(i).to_numpy(zero_copy_only=False) for i in (2, 3))
            ra, rb = (np.frombuffer(b"".join(x.as_py() for x in b.column(i)), np.uint16).reshape(-1, BUCKETS) for i in (4, 5))
            ok = (100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)) & (estimate((ra == rb).mean(axis=1)) >= least_estimate(na, nb, percent))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(ok))

    return pairs.select("a", "b", "na", "nb", "ra", "rb").mapInArrow(bounded(run), "a long, b long")


def verify(pairs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Of pairs with full sets, those that are linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = [linked(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), percent) for x, y in zip(b.column(2), b.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return pairs.select("a", "b", "sa", "sb").mapInArrow(bounded(run), "a long, b long")


def components(links: DataFrame, path: str) -> DataFrame:
    """id, root: each linked id with the smallest id that it reaches.

    Large-star and small-star rounds, each landed, until nothing changes; the
    number of rounds grows with the logarithm of the longest chain.
    """
    spark = links.sparkSession
    edges = land(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct(), f"{path}/0")
    before, k = None, 0
    while True:
        k += 1
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select("u", F.col("m").alias("v")).unionByName(small.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()
        edges = land(small, f"{path}/{k}")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    roots = edges.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(roots)


def _joined(ids: np.ndarray, roots: np.ndarray, sizes: np.ndarray, regs: np.ndarray, items: list, left: int, percent: int = PERCENT) -> list[tuple[int, int]]:
    """Links of a block pair between what isn't joined yet; rows before ``left`` are compared with the rest, or all when 0."""
    parent = {r: r for r in roots.tolist()}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out, n = [], len(ids)
    for i in range(left or n):
        at = np.arange(max(left, i + 1), n)
        at = at[roots[at] != roots[i]]
        if len(at):
            at = at[100 * np.minimum(sizes[at], sizes[i]) >= percent * np.maximum(sizes[at], sizes[i])]
        if len(at):
            at = at[estimate((regs[at] == regs[i]).mean(axis=1)) >= least_estimate(sizes[at], sizes[i], percent)]
        for j in at.tolist():
            a, b = find(int(roots[i])), find(int(roots[j]))
            if a != b and linked(items[i], items[j], percent):
                parent[a] = b
                out.append((int(ids[i]), int(ids[j])))
    return out


def open_buckets(rooted: DataFrame) -> DataFrame:
    """key, n: the buckets that hold several components; of those with the same members one, as they are compared once.

    Members are told by their number and two digests of hashed ids, which dense ids can't make agree.
    """
    digests = [F.sum(F.xxhash64("id").cast("decimal(20,0)")).alias("all"), F.bit_xor(F.xxhash64(F.lit(1), "id")).alias("bits")]
    counts = rooted.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("n"), *digests).filter("lo != hi")
    return counts.groupBy("lo", "hi", "n", "all", "bits").agg(F.min("key").alias("key")).select("key", "n")


def by_pivot(rooted: DataFrame) -> DataFrame:
    """pivot, id, root, n: the members of open buckets, once for each pivot, and the pivot's number of them.

    Two classes of one bucket still meet, under its pivot; those that meet in many buckets meet once there.
    """
    met = rooted.join(open_buckets(rooted), "key", "left_semi").select("pivot", "id", "root").distinct()
    return met.join(met.groupBy("pivot").agg(F.count(F.lit(1)).alias("n")), "pivot")


def open_links(member: DataFrame, classes: DataFrame, roots: DataFrame, sets_of: Callable[[DataFrame, str], DataFrame], path: str, percent: int = PERCENT) -> DataFrame:
    """Links inside buckets that hold several components, by block pairs."""
    rooted = member.join(roots, "id", "left").select("key", "pivot", "id", F.coalesce("root", "id").alias("root"))
    rooted = land(rooted, f"{path}/rooted")
    open_ = land(by_pivot(rooted), f"{path}/open")
    sets = sets_of(open_.select("id").distinct(), f"{path}/open-sets")
    open_ = open_.withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")).withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks").cast("long")).cast("int"))
    open_ = open_.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    open_ = open_.select("pivot", "id", "root", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own")
    full = open_.join(classes.select("id", "n", "reg").join(sets, "id"), "id")

    def run(t: pa.Table) -> pa.Table:
        # Sets stay where Arrow has them; only their order is sorted.
        ids, own = t.column("id").to_numpy(), t.column("own").to_numpy()
        i, j = t.column("i")[0].as_py(), t.column("j")[0].as_py()
        left = 0 if i == j else int((own == i).sum())
        out: list[tuple[int, int]] = []
        if (i == j or left) and left < len(ids):
            order = np.lexsort((ids, own))
            regs = np.frombuffer(b"".join(t.column("reg").to_pylist()), np.uint16).reshape(-1, BUCKETS)[order]
            items = [np.frombuffer(t.column("items")[k].as_buffer(), np.uint64) for k in order.tolist()]
            out = _joined(ids[order], t.column("root").to_numpy()[order], t.column("n").to_numpy()[order], regs, items, left, percent)
            if t.nbytes > LARGE:
                del items
                give_back()
        return pa.table({"a": pa.array([x[0] for x in out], pa.int64()), "b": pa.array([x[1] for x in out], pa.int64())})

    return full.groupBy("pivot", "i", "j").applyInArrow(run, "a long, b long")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    Null text counts as empty: no shingles, linked with nothing, kept. Rows with
    a null id take no links, keep a null component_id and are kept. Rows that
    repeat an id count as one document where their sets are equal. An empty
    table gives an empty result; other columns play no part.
    """
    spark = docs.sparkSession
    path = run_dir(spark, "near-dedup")
    sk = land(sketches(docs, id_col, text_col), f"{path}/sketches")
    keyed = sk.filter("n > 0 and doc_id is not null")
    rep = keyed.groupBy("digest").agg(F.min("doc_id").alias("id"))
    rep = land(rep, f"{path}/classes-of")
    # The smallest id of a digest stands for its class; that row's set and registers are the class's.
    classes = keyed.join(rep.select(F.col("id").alias("doc_id"), "digest"), ["doc_id", "digest"], "left_semi").dropDuplicates(["doc_id", "digest"])
    classes = land(classes.withColumnRenamed("doc_id", "id"), f"{path}/classes")

    def sets_of(needed: DataFrame, to: str) -> DataFrame:
        return full_sets(docs, id_col, text_col, classes, needed, to, repeats)

    repeats = keyed.groupBy("doc_id").count().filter("count > 1").limit(1).count() > 0
    # Dealt by key once, for the pivots and for the members that they are joined to.
    every = bands(classes).repartition("key")
    # One pivot for each bucket: the member whose id a hash puts first, so that
    # the buckets of a family mostly share their pivot.
    chosen = every.groupBy("key").agg(F.min_by("id", F.xxhash64("id")).alias("pivot"), F.count(F.lit(1)).alias("size")).filter("size > 1")
    member = land(every.join(chosen, "key").select("key", "id", "pivot"), f"{path}/members")
    pairs = member.filter("id != pivot").select(F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b")).distinct()
    light = classes.select("id", "n", "reg")
    pairs = pairs.join(light.toDF("a", "na", "ra"), "a").join(light.toDF("b", "nb", "rb"), "b")
    pairs = land(near(pairs, percent), f"{path}/pairs")
    sets = sets_of(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), f"{path}/sets")
    links = land(verify(pairs.join(sets.toDF("a", "sa"), "a").join(sets.toDF("b", "sb"), "b"), percent), f"{path}/links")
    roots = land(components(links, f"{path}/rounds"), f"{path}/roots")
    more = land(open_links(member, classes, roots, sets_of, path, percent), f"{path}/more")
    if more.count():
        roots = land(components(links.unionByName(more), f"{path}/rounds-2"), f"{path}/roots-2")

    named = rep.join(roots, "id", "left").select("digest", F.coalesce("root", "id").alias("component_id"))
    # Documents without words have no digest; a key of their own keeps them from meeting in one task.
    named = named.withColumnRenamed("digest", "of")
    own_key = F.coalesce("digest", F.lpad(F.xxhash64("doc_id").cast("string"), 24, " ").cast("binary")).alias("of")
    out = sk.select("doc_id", "n", own_key).join(named, "of", "left")
    own = F.when(F.col("doc_id").isNull(), F.col("doc_id")).otherwise(F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"), F.coalesce(F.col("doc_id") == own, F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` that stay, one document of each component, with all their columns.

    Rows with a null id or without words all stay. Rows that repeat an id are
    documents of their own, in the order in which they come. An empty table stays
    empty; columns may have any names.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]
    key, text = names[docs.columns.index(id_col)], names[docs.columns.index(text_col)]
    again = docs.select(F.col(id_col).alias("i")).filter("i is not null").groupBy("i").count().filter("count > 1")
    if not again.limit(1).count():
        found = near_dedup(docs, id_col, text_col, percent).filter("doc_id is not null and not kept")
        return without(docs, found.select("doc_id"), id_col)
    # Ids that repeat give way to numbers in the same order, by which rows are told apart.
    own = docs.toDF(*names).withColumn("at", F.monotonically_increasing_id())
    order, n = [F.col(key), F.col("at")], max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    own = own.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("at", F.when(F.col(key).isNotNull(), F.monotonically_increasing_id()))
    own = land(own, f"{run_dir(docs.sparkSession, 'numbered')}/rows")
    found = near_dedup(own.select("at", text), "at", text, percent).filter("doc_id is not null and not kept")
    return without(own, found.select("doc_id"), "at").select(*names).toDF(*docs.columns)


def op6_minhash_dedup(spark, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"))


# Brute force: all shingle sets that share a shingle are intersected, then components by recursion.
SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) END) AS s FROM w),
sets AS MATERIALIZED (SELECT s, min(doc_id) AS id FROM (SELECT doc_id, list_sort(s) AS s FROM s) WHERE len(s) > 0 GROUP BY s),
items AS MATERIALIZED (SELECT id, len(s) AS n, unnest(s) AS x FROM sets),
common AS (SELECT a.id AS a, b.id AS b, a.n AS na, b.n AS nb, count(*) AS c FROM items a JOIN items b ON a.x = b.x AND a.id < b.id GROUP BY ALL),
links AS MATERIALIZED (SELECT a, b FROM common WHERE 100 * c >= 85 * (na + nb - c)),
both_ways AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(id, root) AS (SELECT id, id FROM sets UNION SELECT e.b, r.root FROM reach r JOIN both_ways e ON e.a = r.id WHERE r.root < e.b),
comp AS (SELECT id, min(root) AS root FROM reach GROUP BY id)
SELECT d.doc_id, len(d.s)::BIGINT AS n_shingles, coalesce(c.root, d.doc_id) AS component_id, coalesce(c.root, d.doc_id) = d.doc_id AS kept
FROM (SELECT doc_id, list_sort(s) AS s FROM s) d LEFT JOIN sets USING (s) LEFT JOIN comp c ON c.id = sets.id
"""
