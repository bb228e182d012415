"""Phrase collocations by stripes.

A stripe is a prefix (a language and the first words of a phrase) with a counter
of the words that follow it. Merged over all tasks, stripes of empty prefixes are the
vocabulary, with each language's number of words as their totals; those of one to
four words are the longer phrases, whose largest entries say which phrases are
subsumed.

Lengths come one after another, as a phrase isn't more frequent than those in it:
a phrase is counted where both phrases that are a word shorter are frequent. Tasks
ask that of a bitmap of hashed phrases, which is of bounded size and may let through a
rare phrase but never keeps out a frequent one; counts settle what passes.

A task reads its texts as bytes, finds all words of a batch at once and knows them by
64-bit hashes; its stripes are merged within bounded memory before they are shuffled.
A stripe goes to the slot of its prefix, that of a very frequent prefix is split
over all slots by its next words. No slot holds more than a bounded share.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tellurion.llm.common import bounded, land, run_dir, table, text_of

LONGEST, LEAST, TOP = 5, 100, 2000
#: Bytes of text whose words are found at once, entries of stripes that a task holds, and occurrences for each slot.
CHUNK, HELD, SLOT = 1 << 20, 1 << 20, 1 << 22
SLOTS_LEAST = 32
#: Bits of the bitmap: sixteen for each frequent phrase, so many at most (16 MB).
BITS_LEAST, BITS_MOST = 1 << 16, 1 << 27
U = np.uint64

_ENDS = np.zeros(256, np.uint8)
_ENDS[[0x20, 0x09]] = 1
_ENDS[[ord(c) for c in ".,;:!?"] + [0x0A, 0x0B, 0x0C, 0x0D]] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Weights:
    """Random odd 64-bit weights for the places of bytes in words, as many as are asked for."""

    def __init__(self, seed: int):
        self.seed, self.own = seed, np.zeros(0, U)

    def __call__(self, n: int) -> np.ndarray:
        if n > len(self.own):
            self.own = np.random.PCG64(self.seed).random_raw(max(256, 2 * n)) | U(1)
        return self.own


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(32))) * U(0x9E3779B97F4A7C15)
    return h ^ (h >> U(29))


class Words:
    """The words of a batch of texts in order: hash, language and number of the piece that each stands in."""

    def __init__(self, texts: pa.Array, langs: np.ndarray, weights: list[Weights]):
        self.offsets = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, 4 * texts.offset).astype(np.int64)
        lo, hi = int(self.offsets[0]), int(self.offsets[-1])
        self.data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        hashes, pieces, starts, ends, before = [[] for _ in weights], [], [], [], 0
        while lo < hi:
            cut = self._cut(min(lo + CHUNK, hi), hi)
            before = self._chunk(lo, cut, weights, hashes, pieces, starts, ends, before)
            lo = cut
        whole = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
        self.hashes = [whole(h, U) for h in hashes]
        self.piece, self.start, self.end = whole(pieces, np.int64), whole(starts, np.int64), whole(ends, np.int64)
        self.lang = langs[np.searchsorted(self.offsets, self.start, "right") - 1] if len(self.start) else np.zeros(0, U)

    def _cut(self, at: int, hi: int) -> int:
        """The first place from ``at`` on that no word reaches over."""
        row = int(self.offsets[np.searchsorted(self.offsets, at)])
        while at < row:
            there = _ENDS[self.data[at : min(at + 4096, row)]] > 0
            if there.any():
                return at + int(there.argmax())
            at = min(at + 4096, row)
        return at

    def _chunk(self, lo: int, hi: int, weights, hashes, pieces, starts, ends, before: int) -> int:
        b = _LOWER[self.data[lo:hi]]
        kind = _ENDS[b]
        word = kind == 0
        rows = np.unique(self.offsets[np.searchsorted(self.offsets, lo) : np.searchsorted(self.offsets, hi)]) - lo
        first, last = word.copy(), word.copy()
        first[1:] &= ~word[:-1]
        last[:-1] &= ~word[1:]
        first[rows] = word[rows]
        last[rows[rows > 0] - 1] = word[rows[rows > 0] - 1]
        s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
        breaks = np.sort(np.concatenate([np.flatnonzero(kind == 2), rows]))
        if len(s):
            sizes = e - s
            at = np.cumsum(sizes) - sizes
            place = np.arange(int(sizes.sum())) - np.repeat(at, sizes)
            letters = b[word].astype(U) + U(1)
            for w, own in zip(weights, hashes, strict=True):
                own.append(mixed(np.add.reduceat(letters * w(int(sizes.max()))[place], at)))
            pieces.append(before + np.searchsorted(breaks, s, "right"))
            starts.append(s + lo)
            ends.append(e + lo)
        return before + len(breaks)

    def text(self, k: int) -> str:
        return _LOWER[self.data[self.start[k] : self.end[k]]].tobytes().decode()


def gram(lang: np.ndarray, words: list[np.ndarray]) -> np.ndarray:
    """A phrase's hash."""
    h = lang * U(0xD6E8FEB86659FD93)
    for k, w in enumerate(words):
        h = h + w * U((0xA0761D6478BD642F + 2 * k * 0xE7037ED1A0B428DB) % 2**64)
    return mixed(h)


def summed(g: np.ndarray, cols: list[np.ndarray], counts: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Equal rows of ``cols`` as one, with their counts added; ``g`` is their hash."""
    if not len(g):
        return g, cols, counts
    order = np.argsort(g, kind="stable")
    gs = g[order]
    new = np.concatenate([[True], gs[1:] != gs[:-1]])
    # Unlike rows of one hash: all columns decide.
    if any(((c[order][1:] != c[order][:-1]) & ~new[1:]).any() for c in cols):
        order = np.lexsort([*cols, g])
        gs = g[order]
        new = np.concatenate([[True], (gs[1:] != gs[:-1]) | np.any([c[order][1:] != c[order][:-1] for c in cols], axis=0)])
    at = np.flatnonzero(new)
    own = order[at]
    return g[own], [c[own] for c in cols], np.add.reduceat(counts[order], at)


class Filter:
    """A bitmap of the frequent phrases of one length, and the hashes of those prefixes that are split over slots."""

    def __init__(self, bits: bytes, split: list[int]):
        self.bits, self.mask = np.frombuffer(bits, np.uint8), U(8 * len(bits) - 1)
        self.split = np.sort(np.array(split, np.int64).view(U))

    def has(self, g: np.ndarray) -> np.ndarray:
        at = g & self.mask
        return (self.bits[at >> U(3)] >> (at & U(7)).astype(np.uint8) & 1).astype(bool)


STRIPES = "slot int, prefixes binary, sizes binary, nexts binary, counts binary"


def striped(g: np.ndarray, cols: list[np.ndarray], counts: np.ndarray, slots: int, split: np.ndarray | None) -> Iterator[dict]:
    """Entries as blocks of stripes, one for each slot: prefixes, sizes of their counters, next words and counts."""
    lang, *words = cols
    prefix = gram(lang, words[:-1])
    spread = np.ones(len(g), bool) if split is None else np.isin(prefix, split)
    slot = np.where(spread, g, prefix) % U(slots)
    order = np.lexsort([words[-1], prefix, slot])
    slot, prefix = slot[order], prefix[order]
    head = np.column_stack([lang, *words[:-1]])[order]
    new = np.concatenate([[True], (slot[1:] != slot[:-1]) | (head[1:] != head[:-1]).any(axis=1)])
    edges = np.concatenate([[0], np.flatnonzero(slot[1:] != slot[:-1]) + 1, [len(slot)]])
    nexts, counts, at = words[-1][order], counts[order], np.flatnonzero(new)
    for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        own = at[np.searchsorted(at, lo) : np.searchsorted(at, hi)]
        sizes = np.diff(np.append(own, hi))
        yield {"slot": int(slot[lo]), "prefixes": head[own].tobytes(), "sizes": sizes.astype("<u4").tobytes(), "nexts": nexts[lo:hi].tobytes(), "counts": counts[lo:hi].astype("<i8").tobytes()}


def batches_of(batches: Iterator[pa.RecordBatch], weights: list[Weights]) -> Iterator[Words]:
    for b in batches:
        yield Words(b.column(1).cast(pa.string()), b.column(0).to_numpy(zero_copy_only=False).view(U), weights)


def stripes(rows: DataFrame, length: int, slots: int, seed: int, filters) -> DataFrame:
    """Blocks of stripes of phrases of ``length`` words, merged within tasks; ``filters`` is a broadcast Filter of phrases a word shorter."""
    schema = pa.schema([("slot", pa.int32()), *((c, pa.binary()) for c in ("prefixes", "sizes", "nexts", "counts"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = filters.value if filters is not None else None
        held: list[tuple] = []
        size = 0

        def merge() -> tuple:
            return summed(np.concatenate([h[0] for h in held]), [np.concatenate(c) for c in zip(*(h[1] for h in held), strict=True)], np.concatenate([h[2] for h in held]))

        def out(entries: tuple) -> Iterator[pa.RecordBatch]:
            for row in striped(*entries, slots, known.split if known else None):
                yield pa.RecordBatch.from_pylist([row], schema)

        for w in batches_of(batches, [Weights(seed)]):
            h, n = w.hashes[0], len(w.hashes[0]) - length + 1
            if n <= 0:
                continue
            inside = w.piece[:n] == w.piece[length - 1 :]
            if known:
                # A phrase a word shorter at each place; where pieces end within it, ``inside`` says no.
                there = known.has(gram(w.lang[: n + 1], [h[k : n + 1 + k] for k in range(length - 1)]))
                inside &= there[:-1] & there[1:]
            at = np.flatnonzero(inside)
            if not len(at):
                continue
            cols = [w.lang[at], *(h[at + k] for k in range(length))]
            held.append(summed(gram(cols[0], cols[1:]), cols, np.ones(len(at), np.int64)))
            size += len(held[-1][0])
            if size > HELD:
                held = [merge()]
                size = len(held[0][0])
                if size > HELD // 2:
                    yield from out(held[0])
                    held, size = [], 0
        if held:
            yield from out(merge())

    return rows.mapInArrow(bounded(run), STRIPES)


def merged(blocks: DataFrame, length: int, least: int, totals: bool) -> DataFrame:
    """lang, words (hashes), f and gram of each phrase with ``f >= least``; with ``totals`` also each prefix's, with no gram.

    A slot's stripes are merged entry by entry.
    """
    schema = pa.schema([("lang", pa.int64()), ("words", pa.list_(pa.int64())), ("f", pa.int64()), ("gram", pa.int64())])

    def run(t: pa.Table) -> pa.Table:
        flat = lambda c, kind: np.frombuffer(b"".join(t.column(c).to_pylist()), kind)
        head = np.repeat(flat("prefixes", "<u8").reshape(-1, length), flat("sizes", "<u4"), axis=0)
        cols = [*(np.ascontiguousarray(head[:, k]) for k in range(length)), flat("nexts", "<u8")]
        g, cols, f = summed(gram(cols[0], cols[1:]), cols, flat("counts", "<i8"))
        sums = []
        if totals:
            own, place = np.unique(cols[0], return_inverse=True)
            every = np.zeros(len(own), np.int64)
            np.add.at(every, place, f)
            sums = [pa.table({"lang": own.view(np.int64), "words": [[]] * len(own), "f": every, "gram": pa.nulls(len(own), pa.int64())}).cast(schema)]
        ok = f >= least
        words = np.column_stack([c[ok] for c in cols[1:]]).view(np.int64).ravel()
        lists = pa.ListArray.from_arrays(pa.array(np.arange(int(ok.sum()) + 1, dtype=np.int32) * length), pa.array(words))
        found = pa.table([pa.array(cols[0][ok].view(np.int64)), lists, pa.array(f[ok]), pa.array(g[ok].view(np.int64))], schema=schema)
        return pa.concat_tables([found, *sums])

    return blocks.groupBy("slot").applyInArrow(run, "lang long, words array<long>, f long, gram long")


def filter_of(phrases: DataFrame, n: int, split_over: float):
    """The broadcast Filter of landed phrases, ``n`` in number; prefixes that occur more than ``split_over`` times are split.

    Bitmaps are built where the phrases lie, so the driver sees 16 MB at most;
    prefixes above a share of all occurrences are few.
    """
    bits = BITS_LEAST
    while bits < min(16 * n, BITS_MOST):
        bits *= 2
    at = (F.col("gram").bitwiseAND(F.lit(bits - 1)) + 1).alias("at")
    parts = phrases.select(at).groupBy(F.bitmap_bucket_number("at").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("m")).collect()
    every = bytearray(bits // 8)
    for r in parts:
        every[(r["b"] - 1) * 4096 : r["b"] * 4096] = r["m"]
    split = [r["gram"] for r in phrases.filter(F.col("f") > split_over).select("gram").collect()]
    return phrases.sparkSession.sparkContext.broadcast(Filter(bytes(every), split))


def dictionary(rows: DataFrame, seed: int, filters) -> DataFrame:
    """lang, hash, word of the words that the filter knows. Two words of one hash fail: another seed tells them apart."""
    schema = pa.schema([("lang", pa.int64()), ("hash", pa.int64()), ("check", pa.int64()), ("word", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, done = filters.value, np.zeros(0, U)
        for w in batches_of(batches, [Weights(seed), Weights(seed + 1)]):
            h, check = w.hashes
            g = gram(w.lang, [h])
            at = np.flatnonzero(known.has(g))
            _, first = np.unique(mixed(g[at]) ^ check[at], return_index=True)
            at = at[first]
            key = g[at] ^ check[at]
            at = at[~np.isin(key, done)]
            done = np.union1d(done, key) if len(done) < HELD else key
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(w.lang[at].view(np.int64)), pa.array(h[at].view(np.int64)), pa.array(check[at].view(np.int64)), pa.array([w.text(int(k)) for k in at])], schema=schema)

    seen = rows.mapInArrow(bounded(run), "lang long, hash long, check long, word string")
    clash = F.raise_error(F.lit("two words have one hash; another seed tells them apart")).cast("string")
    return seen.groupBy("lang", "hash").agg(F.when(F.min("word") != F.max("word"), clash).otherwise(F.min("word")).alias("word"))


def phrases(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", longest: int = LONGEST, least: int = LEAST, percent: int = 100, top: int | None = TOP, seed: int = 17) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's ``top`` phrases; all of them if ``top`` is None.

    Candidates are phrases of 2 to ``longest`` words that occur ``least`` times or
    more; those whose words lie in a longer candidate with ``percent`` of their
    occurrences or more are dropped. Null texts count as empty ones, a null
    language as ``und``. Repeated rows count each time. An empty table gives an
    empty result; ids and other columns play no part. Equal scores go by a, then by
    the phrase's bytes.
    """
    spark, path = docs.sparkSession, run_dir(docs.sparkSession, "collocations")
    lang = F.coalesce(F.col(lang_col), F.lit("und"))
    rows = docs.select(F.xxhash64(lang).alias("lang"), text_of(text_col).alias("text"))
    names = docs.select(lang.alias("name")).distinct().select(F.xxhash64("name").alias("lang"), "name")

    levels: list[DataFrame] = []
    occurrences, filters, words = None, None, None
    for m in range(1, longest + 1):
        # Empty prefixes are few and hold the vocabulary: they are always split, over slots for the bytes there are.
        slots = max(SLOTS_LEAST, -(-(occurrences if m > 1 else _bytes(docs, text_col) // 6) // SLOT))
        found = land(merged(stripes(rows, m, slots, seed, filters), m, least, m == 1), f"{path}/phrases{m}")
        if m == 1:
            totals = found.filter(F.col("gram").isNull()).groupBy("lang").agg(F.sum("f").alias("n"))
            found = found.filter(F.col("gram").isNotNull())
        levels.append(found)
        size = found.agg(F.count(F.lit(1)).alias("n"), F.sum("f").alias("f")).first()
        occurrences = size["f"] or 0
        if not size["n"]:
            break
        filters = filter_of(found, size["n"], occurrences / (4 * max(SLOTS_LEAST, occurrences // SLOT)))
        words = words or filters
    counts = levels[0]
    for level in levels[1:]:
        counts = counts.unionByName(level)
    counts = counts.select("lang", "words", "f")
    known = counts.withColumn("size", F.size("words"))
    cand = known.filter("size >= 2").withColumnRenamed("f", "a")

    # A phrase in a longer candidate as frequent lies in one that is a word longer and as frequent.
    longer = known.filter("size >= 3")
    after = longer.select("lang", F.slice("words", F.lit(1), F.col("size") - 1).alias("words"), "f")
    before = longer.select("lang", F.slice("words", F.lit(2), F.col("size") - 1).alias("words"), "f")
    most = after.unionByName(before).groupBy("lang", "words").agg(F.max("f").alias("most"))
    kept = cand.join(most, ["lang", "words"], "left").filter(F.col("most").isNull() | (100 * F.col("most") < percent * F.col("a"))).drop("most")

    cuts = kept.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.withColumn("lw", F.slice("words", F.lit(1), F.col("k"))).withColumn("rw", F.slice("words", F.col("k") + 1, F.col("size") - F.col("k")))
    cuts = cuts.join(counts.toDF("lang", "lw", "l"), ["lang", "lw"]).join(counts.toDF("lang", "rw", "r"), ["lang", "rw"]).join(totals, "lang")
    cuts = cuts.withColumn("score", score("a", "n", "l", "r"))
    best = cuts.groupBy("lang", "words").agg(F.min(F.struct("score", "k", "l", "r", "a", "n")).alias("b")).select("lang", "words", "b.*")

    if words is None:
        return spark.createDataFrame([], RESULT)
    texts = land(dictionary(rows, seed, words), f"{path}/words")
    each = best.select("lang", "words", "score", "l", "r", "a", "n", F.posexplode("words").alias("at", "hash")).join(texts, ["lang", "hash"])
    own = each.groupBy("lang", "words", "score", "l", "r", "a", "n").agg(F.sort_array(F.collect_list(F.struct("at", "word"))).alias("ws"))
    own = own.select("lang", F.array_join(F.transform("ws", lambda w: w["word"]), " ").alias("phrase"), "a", "l", "r", "n", "score")
    by = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = own.withColumn("rank", F.row_number().over(by))
    ranked = ranked if top is None else ranked.filter(F.col("rank") <= top)
    return ranked.join(names, "lang").select(F.col("name").alias("lang"), F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


RESULT = "lang string, rank long, phrase string, a long, l long, r long, n long, score long"


def _bytes(docs: DataFrame, text_col: str) -> int:
    return docs.agg(F.sum(F.octet_length(F.col(text_col)))).first()[0] or 0


def score(a: str, n: str, l: str, r: str) -> Column:  # noqa: E741
    """floor(1000 a n / (l r)) without rounding; products have up to 38 digits."""
    return F.expr(f"(cast({a} as decimal(19,0)) * cast({n} as decimal(15,0)) * cast(1000 as decimal(4,0))) div (cast({l} as decimal(19,0)) * cast({r} as decimal(19,0)))")


SQL = """
WITH d AS (SELECT row_number() OVER () AS doc, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, doc, unnest(regexp_split_to_array(t, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM d),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS ws FROM p),
n AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY lang),
g AS (SELECT lang, m, ws[i : i + m - 1] AS ph FROM (SELECT lang, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM w, (SELECT unnest([1, 2, 3, 4, 5]) AS m) WHERE len(ws) >= m)),
f AS (SELECT lang, m, ph, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT lang, m, ph, f AS a FROM f WHERE m >= 2),
sub AS (SELECT lang, ph[s : s + m2 - 1] AS ph, max(a) AS most FROM (SELECT lang, ph, a, m, m2, unnest(range(1, m - m2 + 2)) AS s FROM (SELECT *, unnest(range(2, m)) AS m2 FROM c)) GROUP BY ALL),
kept AS (SELECT c.* FROM c LEFT JOIN sub USING (lang, ph) WHERE most IS NULL OR 100 * most < 100 * a),
cut AS (SELECT lang, m, ph, a, unnest(range(1, m)) AS k FROM kept),
sc AS (SELECT cut.lang, cut.ph, cut.a, cut.k, lf.f AS l, rf.f AS r, n.n, ((1000::HUGEINT * cut.a * n.n) // (lf.f::HUGEINT * rf.f))::BIGINT AS score
  FROM cut JOIN f lf ON lf.lang = cut.lang AND lf.ph = cut.ph[1 : cut.k] JOIN f rf ON rf.lang = cut.lang AND rf.ph = cut.ph[cut.k + 1 : cut.m] JOIN n ON n.lang = cut.lang),
b AS (SELECT *, row_number() OVER (PARTITION BY lang, ph ORDER BY score, k) AS o FROM sc),
ranked AS (SELECT lang, array_to_string(ph, ' ') AS phrase, a, l, r, n, score FROM b WHERE o = 1)
SELECT lang, rank, phrase, a, l, r, n, score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase COLLATE C) AS rank FROM ranked) WHERE rank <= 2000
"""


def op12_collocations(spark, sf_dir: str) -> DataFrame:
    return phrases(table(spark, sf_dir, "documents"))
