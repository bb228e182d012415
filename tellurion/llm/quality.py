"""Quality classifier by gated attention over passages (multiple-instance learning).

A document is a bag of passages of 64 words. Each passage is encoded from its
words (hashed into ``LEXICAL`` counts), the shapes of its words, its punctuation
and a few ratios; gated attention, learned from document labels, weighs the
passages, and the weighted mean representation gives the document's score. Every
passage of a text takes part, in training and in scoring.

The model is fitted on labelled documents chosen by a hash of their ids, at most
``TRAIN_DOCS`` and no more than hold ``TRAIN_WORDS`` words in all; only those
documents' features come to the driver. Labels whose crc32(id as text) mod 5 is 0
are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tellurion.llm.common import bounded, table, text_of
from tellurion.llm.minhash_dedup import word_hashes

PASSAGE, FOLDS = 64, 5
TRAIN_DOCS, TRAIN_WORDS = 3000, 2_500_000
#: A score at least so high predicts label 1.
THRESHOLD = 0.3
HIDDEN, GATE, EPOCHS, RATE, DECAY, SEED = 24, 12, 120, 0.02, 1e-4, 7

SHAPES, LEXICAL = 3 * 4 * 2 * 4, 256
#: Words are many and rare, so they weigh less than shapes: held-out log loss is least about here.
LEXICAL_WEIGHT = 0.25
_PUNCT = np.full(256, -1)
_MARKS = [b for b in range(33, 127) if not chr(b).isalnum()]
_PUNCT[_MARKS] = np.arange(len(_MARKS))
RATIOS = 9
WIDTH = LEXICAL + SHAPES + len(_MARKS) + RATIOS
_CLASS = np.zeros((256, 5), np.int32)  # space, upper, digit, punctuation, beyond ASCII
_CLASS[[32, 9, 10, 11, 12, 13], 0] = 1
_CLASS[65:91, 1] = 1
_CLASS[48:58, 2] = 1
_CLASS[_MARKS, 3] = 1
_CLASS[128:, 4] = 1


def passages(text: str) -> np.ndarray:
    """A row of features for each passage; the empty text is one passage of zeros."""
    raw = np.frombuffer(text.encode(), np.uint8)
    gap = _CLASS[raw, 0].astype(bool)
    edge = np.flatnonzero(np.diff(np.concatenate(([True], gap, [True])).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    n = len(starts)
    if not n:
        return np.zeros((1, WIDTH), np.float32)
    sums = np.zeros((len(raw) + 1, 4), np.int32)
    np.cumsum(_CLASS[raw, 1:], axis=0, out=sums[1:])
    up, digit, punct, beyond = (sums[ends] - sums[starts]).T
    size = ends - starts
    upper = np.where(up == 0, 0, np.where((up == 1) & (_CLASS[raw[starts], 1] == 1), 1, 2))
    shape = ((upper * 4 + np.minimum(punct, 3)) * 2 + (digit > 0)) * 4 + np.searchsorted([2, 4, 8], size, side="right")
    at = np.arange(n) // PASSAGE
    m = int(at[-1]) + 1
    words = np.bincount(at, minlength=m).astype(float)
    hist = np.bincount(at * SHAPES + shape, minlength=m * SHAPES).reshape(m, SHAPES) / words[:, None]
    marks = np.flatnonzero(_PUNCT[raw] >= 0)
    own = at[np.clip(np.searchsorted(starts, marks, side="right") - 1, 0, n - 1)]
    signs = np.bincount(own * len(_MARKS) + _PUNCT[raw[marks]], minlength=m * len(_MARKS)).reshape(m, -1) / words[:, None]
    hashed = word_hashes(text)
    lexical = np.bincount(at * LEXICAL + (hashed % np.uint64(LEXICAL)).astype(np.int64), minlength=m * LEXICAL).reshape(m, LEXICAL) / words[:, None]
    order = np.lexsort((hashed, at))
    fresh = np.append(True, (hashed[order][1:] != hashed[order][:-1]) | (at[1:] != at[:-1]))
    distinct = np.bincount(at[fresh], minlength=m) / words
    again = np.bincount(at[1:][hashed[1:] == hashed[:-1]], minlength=m) / words
    chars = np.bincount(at, size, m)
    lines = np.bincount(at[np.clip(np.searchsorted(starts, np.flatnonzero(raw == 10), side="right") - 1, 0, n - 1)], minlength=m) / words
    ratios = [distinct, again, chars / words / 10, np.bincount(at, up, m) / chars, np.bincount(at, digit, m) / chars, np.bincount(at, punct, m) / chars, np.bincount(at, beyond, m) / chars, lines, words]
    return np.concatenate([lexical, hist, signs, np.stack(ratios, 1)], axis=1).astype(np.float32)


class Model:
    """Gated attention over encoded passages; plain arrays, so that it travels in a closure."""

    def __init__(self, mean, scale, weights: dict[str, np.ndarray]):
        self.mean, self.scale, self.w = mean, scale, weights

    def prepared(self, x: np.ndarray) -> np.ndarray:
        # The last column is the passage's words: the fewer, the closer its features are drawn to the mean.
        x = np.clip((x - self.mean) / self.scale, -5, 5) * (x[:, -1:] / (x[:, -1:] + 6))
        x[:, -1] = 0
        x[:, :LEXICAL] *= LEXICAL_WEIGHT
        return x

    def forward(self, x: np.ndarray, first: np.ndarray):
        """From prepared features; first: where each document's passages begin."""
        w = self.w
        h = np.tanh(x @ w["enc"] + w["enc_b"])
        v, u = np.tanh(h @ w["v"]), 1 / (1 + np.exp(-(h @ w["u"])))
        e = (v * u) @ w["att"]
        of = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(x))))
        e = np.exp(e - np.maximum.reduceat(e, first)[of])
        a = e / np.add.reduceat(e, first)[of]
        z = np.add.reduceat(a[:, None] * h, first)
        p = 1 / (1 + np.exp(-np.clip(z @ w["out"] + w["out_b"], -30, 30)))
        return h, v, u, a, of, z, p

    def score(self, bags: list[np.ndarray]) -> np.ndarray:
        first = np.concatenate([[0], np.cumsum([len(b) for b in bags])[:-1]]).astype(np.int64)
        return self.forward(self.prepared(np.concatenate(bags)), first)[-1]


def fit(bags: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS) -> Model:
    """Full-batch Adam from a fixed seed."""
    x = np.concatenate(bags)
    first = np.concatenate([[0], np.cumsum([len(b) for b in bags])[:-1]]).astype(np.int64)
    rng = np.random.Generator(np.random.PCG64(SEED))
    shapes = {"enc": (WIDTH, HIDDEN), "enc_b": (HIDDEN,), "v": (HIDDEN, GATE), "u": (HIDDEN, GATE), "att": (GATE,), "out": (HIDDEN,), "out_b": ()}
    w = {k: np.zeros(s, np.float32) if k.endswith("_b") else (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32) for k, s in shapes.items()}
    model = Model(x.mean(0), x.std(0) + 1e-2, w)
    m, s, y = {k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()}, labels.astype(np.float32)
    xs = model.prepared(x)
    for t in range(1, epochs + 1):
        h, v, u, a, of, z, p = model.forward(xs, first)
        d = (p - y) / len(y)
        g = {"out": z.T @ d, "out_b": d.sum()}
        dz = d[:, None] * w["out"]
        da = (dz[of] * h).sum(1)
        de = a * (da - np.add.reduceat(a * da, first)[of])
        g["att"] = (v * u).T @ de
        dg = de[:, None] * w["att"]
        dv, du = dg * u * (1 - v * v), dg * v * u * (1 - u)
        g["v"], g["u"] = h.T @ dv, h.T @ du
        dh = (a[:, None] * dz[of] + dv @ w["v"].T + du @ w["u"].T) * (1 - h * h)
        g["enc"], g["enc_b"] = xs.T @ dh, dh.sum(0)
        for k in w:
            grad = g[k] + DECAY * w[k]
            m[k] = 0.9 * m[k] + 0.1 * grad
            s[k] = 0.999 * s[k] + 0.001 * grad * grad
            w[k] = (w[k] - RATE * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    return model


def held_out(id_col: str = "doc_id"):
    """Whether a row's label must not be learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_docs: int = TRAIN_DOCS, max_words: int = TRAIN_WORDS) -> Model | float:
    """The model, or the share of label 1 (0.5 without labels) where the labels have not both values.

    Of several labels of one id the greatest counts; every row that repeats a
    labelled id is an example of its own. Null ids and labels are left out, and
    null texts are empty ones. A document with more words than are left of
    ``max_words`` is passed over; ValueError if that leaves one label of two.
    """
    own = labels.select(F.col(id_col).cast("long").alias("_label_id"), F.col(label_col).cast("int").alias("_label")).filter(F.col("_label").isin(0, 1) & F.col("_label_id").isNotNull() & ~held_out("_label_id"))
    # One label for each id, and at most max_docs ids: this side's size is bounded.
    own = own.groupBy("_label_id").agg(F.max("_label").alias("_label")).orderBy(F.xxhash64("_label_id"), "_label_id").limit(max_docs)
    rows = docs.select(F.col(id_col).cast("long").alias("_label_id"), text_of(text_col).alias("text")).join(F.broadcast(own), "_label_id")
    # Documents in the hash's order that still fit; rows that repeat an id go together.
    sizes = rows.groupBy("_label_id").agg(F.sum(F.size(F.split("text", r"[\x20\x09-\x0D]+")) + PASSAGE).alias("n"), F.max("_label").alias("y")).orderBy(F.xxhash64("_label_id"), "_label_id").collect()
    kept, total = [], 0
    for r in sizes:
        if total + r["n"] <= max_words:
            kept.append(r["_label_id"])
            total += r["n"]
    kept_ids = set(kept)
    if len({r["y"] for r in sizes}) == 2 > len({r["y"] for r in sizes if r["_label_id"] in kept_ids}):
        raise ValueError(f"no documents of both labels fit within {max_words} words")
    rows = rows.filter(F.col("_label_id").isin(kept)) if len(kept) < len(sizes) else rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([passages(t.as_py()).astype(np.float16).tobytes() for t in b.column(2)], pa.binary())], ["id", "label", "x"])

    found = sorted((r["id"], r["label"], bytes(r["x"])) for r in rows.select("_label_id", "_label", "text").mapInArrow(bounded(run), "id long, label int, x binary").collect())
    y = np.array([r[1] for r in found])
    if len(set(y.tolist())) < 2:
        return float(y.mean()) if len(y) else 0.5
    return fit([np.frombuffer(r[2], np.float16).astype(np.float32).reshape(-1, WIDTH) for r in found], y)


def _scores(model: Model | float, texts: list[str]) -> np.ndarray:
    return np.full(len(texts), model) if isinstance(model, float) else model.score([passages(t) for t in texts]) if texts else np.zeros(0)


def score(docs: DataFrame, model: Model | float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted.

    Null text is the empty text, which has a score too. A null id stays null and
    is not held out; repeated rows each give a row; an empty table gives an empty
    result; other columns play no part.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                x = b.slice(at, 256)
                s = _scores(model, x.column(2).to_pylist()).astype(np.float64)
                yield pa.RecordBatch.from_arrays([x.column(0), x.column(1), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), text_of(text_col).alias("text")).mapInArrow(bounded(run), "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, model: Model | float, text_col: str = "text") -> DataFrame:
    """The rows that the model predicts 1, with all their columns.

    Null texts are scored as empty ones and stay null. Rows are judged one by one,
    so null ids, repeated rows and columns of any name change nothing; an empty
    table stays empty.
    """
    k = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                x = b.slice(at, 256)
                yield x.filter(pa.array(_scores(model, [t or "" for t in x.column(k).to_pylist()]) >= THRESHOLD))

    return docs.mapInArrow(bounded(run), docs.schema)


def op10_quality(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))
