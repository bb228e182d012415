"""Phrases against counting in plain Python, across every bound of the operator's memory."""

import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from tellurion.llm import collocations as co

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def pieces(text):
    return [[w for w in re.split(r"[\x20\x09]+", p) if w] for p in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(UPPER))]


def plain(rows, least, top=None, longest=5):
    n, f = Counter(), defaultdict(Counter)
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for ws in pieces(text):
            n[lang] += len(ws)
            for m in range(1, longest + 1):
                f[lang].update(tuple(ws[i : i + m]) for i in range(len(ws) - m + 1))
    out = []
    for lang, counts in f.items():
        cand = {p: a for p, a in counts.items() if len(p) >= 2 and a >= least}
        kept = []
        for p, a in cand.items():
            if any(len(q) > len(p) and b >= a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in cand.items()):
                continue
            score, k = min((Fraction(1000 * a * n[lang], counts[p[:k]] * counts[p[k:]]).__floor__(), k) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


def corpus(seed=3, docs=60):
    rng = random.Random(seed)
    vocab = ["a", "The", "the", "cat", "sät", "on", "mat", "-", "中文", "x1", "of", "course"]
    rows = []
    for _ in range(docs):
        words = []
        while len(words) < rng.randint(0, 120):
            words += rng.choice([["of", "course"], ["the", "cat", "sät", "on", "mat"], [rng.choice(vocab)], [rng.choice(vocab) + rng.choice(".,;:!?")]])
        rows.append((rng.choice([" ", "  ", "\t", " \n", "\r"]).join(words), rng.choice(["en", "en", "fr", None])))
    return rows + [(None, "en"), ("", "fr"), ("of course", "en"), ("of course", "en"), (" \t ", None), ("A" * 5000, "fr"), ("the cat " * 2000, "de")]


def got(df):
    return sorted((r["lang"], r["rank"], r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in df.collect())


def frame(spark, rows):
    return spark.createDataFrame([(t, g, "z", i) for i, (t, g) in enumerate(rows)], "text string, lang string, words string, f long").repartition(3)


@pytest.mark.parametrize("least,top", [(5, None), (12, 4), (2, 30)])
def test_same_as_counting(spark, least, top):
    rows = corpus()
    assert got(co.phrases(frame(spark, rows), least=least, top=top)) == plain(rows, least, top)


def test_nothing_to_find(spark):
    none = spark.createDataFrame([], "text string, lang string")
    assert co.phrases(none).count() == 0
    assert co.phrases(spark.createDataFrame([("a b", None), (None, "x")], "text string, lang string")).columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def test_words_over_every_cut(monkeypatch):
    """Texts that are cut in chunks of any size give the same words and pieces."""
    texts = [t or "" for t, _ in corpus(5, 20)]
    langs = np.arange(len(texts), dtype=np.uint64)
    whole = co.Words(pa.array(texts), langs, [co.Weights(1)])
    want = [w for t in texts for ws in pieces(t) for w in ws]
    assert [whole.text(k) for k in range(len(whole.start))] == want
    assert len(set(whole.hashes[0].tolist())) == len(set(want))
    for chunk in (1, 7, 64):
        monkeypatch.setattr(co, "CHUNK", chunk)
        cut = co.Words(pa.array(texts), langs, [co.Weights(1)])
        assert (cut.hashes[0] == whole.hashes[0]).all() and (cut.lang == whole.lang).all() and (cut.start == whole.start).all()
        assert ((np.diff(cut.piece) > 0) == (np.diff(whole.piece) > 0)).all()


def test_rows_of_one_hash_stay_apart():
    g = np.array([5, 5, 5, 5], np.uint64)
    cols = [np.array([1, 2, 1, 2], np.uint64), np.array([7, 7, 7, 8], np.uint64)]
    g, cols, n = co.summed(g, cols, np.array([1, 10, 100, 1000]))
    assert sorted(zip(cols[0].tolist(), cols[1].tolist(), n.tolist(), strict=True)) == [(1, 7, 101), (2, 7, 10), (2, 8, 1000)]


def test_small_memory(monkeypatch):
    """A task that holds a few entries at a time hands on the same counts."""
    rows = corpus(9, 40)
    langs = np.array([hash(g) % 99 for _, g in rows], dtype=np.uint64)
    w = co.Words(pa.array([t or "" for t, _ in rows]), langs, [co.Weights(1)])
    h = w.hashes[0]
    at = np.flatnonzero(w.piece[:-1] == w.piece[1:])
    cols = [w.lang[at], h[at], h[at + 1]]
    entries = co.summed(co.gram(cols[0], cols[1:]), cols, np.ones(len(at), np.int64))
    for split in (None, np.sort(co.gram(cols[0], cols[1:2]))[:5], np.zeros(0, np.uint64)):
        blocks = list(co.striped(*entries, 7, split))
        assert len({b["slot"] for b in blocks}) == len(blocks)
        back = Counter()
        for b in blocks:
            head = np.repeat(np.frombuffer(b["prefixes"], "<u8").reshape(-1, 2), np.frombuffer(b["sizes"], "<u4"), axis=0)
            for p, x, c in zip(head.tolist(), np.frombuffer(b["nexts"], "<u8").tolist(), np.frombuffer(b["counts"], "<i8").tolist(), strict=True):
                back[*p, x] += c
        assert back == Counter(zip(*(c.tolist() for c in cols), strict=True))


def test_scores_beyond_64_bits(spark):
    one = spark.createDataFrame([(10**12, 10**14, 10**13, 3)], "a long, n long, l long, r long")
    assert one.select(co.score("a", "n", "l", "r").alias("s")).first()["s"] == 1000 * 10**26 // (3 * 10**13)
