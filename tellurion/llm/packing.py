"""Vector best-fit packing of token sequences.

Documents are tokenised whole; only those longer than a sequence are cut. A
piece weighs on three capacities of its sequence: tokens, documents and
attention cost (the squares of the pieces' lengths). Pieces come longest first,
and each goes to the open sequence that leaves the least weighted norm of
residual capacity among those that take it under every capacity.

Tokens come from a table of distinct words in each worker: the tokeniser's
normaliser and splitter never look across ASCII white space, so a text's ids are
its words' ids, in order, and a word is tokenised once when it first comes.

Pieces are dealt over shards by hash and packed shard by shard; a shard's packing
depends on nothing but its pieces, so a lost executor repeats only its shards.
"""

from __future__ import annotations

import binascii
import json
import math
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tellurion.llm.common import bounded, land, run_dir, store, table, text_of

CAPACITY = 2048
#: Documents in a sequence, and its attention cost. These bind nothing that tokens don't, so that sequences are few.
MAX_DOCS, MAX_COST = CAPACITY, CAPACITY * CAPACITY
#: What each capacity's residual weighs in the norm.
WEIGHTS = (1.0, 0.05, 0.05)
#: Pieces in a shard, about; each shard closes with one part-filled sequence or a few.
SHARD = 20_000
TABLE_WORDS = 300_000
ROWS = 256


class Words:
    """A worker's tokeniser with its word table; a full table starts afresh."""

    def __init__(self, path: str, table_words: int = TABLE_WORDS):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok, self.table_words = Tokenizer.from_file(path), table_words
        #: Ids of words and of their parts, both in UTF-8 and as bytes of little-endian ids.
        self.words: dict[bytes, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.by_word, self.latin = separable(path)
        self.model = self.tok.model

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        if not self.by_word:
            return [np.array(e.ids, "<u4") for e in self.tok.encode_batch(texts, add_special_tokens=False)]
        # Bytes split at ASCII white space alone; other white space stays in its word, for the tokeniser.
        split, known = [t.encode().split() for t in texts], self.words
        seen = set().union(*split)
        new = seen.difference(known)
        if len(known) + len(new) > self.table_words:
            known.clear()
            new = seen
        if new:
            self.learn(new)
        get = known.__getitem__
        return [np.frombuffer(b"".join(map(get, ws)), "<u4") for ws in split]

    def learn(self, new: set[bytes]) -> None:
        known, parts, others = self.words, self.parts, []
        for raw in new:
            w = raw.decode()
            if not self.latin or not PLAIN.fullmatch(w) or "<|" in w:
                others.append(w)
                continue
            # Words of common Latin letters change only in case, so their parts go straight to the model.
            out = []
            for p in PARTS.findall(w.lower()):
                if (ids := parts.get(p)) is None:
                    if len(parts) >= self.table_words:
                        parts.clear()
                    ids = parts[p] = b"".join([_BYTES(t.id) for t in self.model.tokenize(p if p.isascii() else p.encode().decode("latin-1").translate(_SHOWN))])
                out.append(ids)
            known[raw] = out[0] if len(out) == 1 else b"".join(out)
        if others:
            for w, e in zip(others, self.tok.encode_batch_fast(others, add_special_tokens=False), strict=True):
                known[w.encode()] = np.array(e.ids, "<u4").tobytes()


_BYTES = struct.Struct("<I").pack
#: Printable ASCII and the letters of Latin-1, whose normal form is themselves.
PLAIN = re.compile("[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
# The tokeniser's own splitting pattern, for such characters.
PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^a-z0-9\u00df-\u00f6\u00f8-\u00ff]+")
#: Bytes that byte-level vocabularies show as characters above 255: those that don't print.
_SHOWN = {b: 256 + i for i, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255))}

# Fixed value: the splitting pattern that PARTS stands for.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def separable(path: str) -> tuple[bool, bool]:
    """Whether the tokeniser drops white space and never joins across it; whether PARTS splits as it does."""
    with open(path) as f:
        spec = json.load(f)
    kinds = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
    steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}, {}])
    split, pattern = steps[0], steps[0].get("pattern", {}).get("Regex", "")
    plain = not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] or " " in t["content"] for t in spec["added_tokens"])
    by_word = kinds == ["NFC", "Replace", "Lowercase"] and split.get("type") == "Split" and split.get("invert") is True and "[^\\s" in pattern and plain
    latin = by_word and pattern == PATTERN and len(steps) == 2 and steps[1]["type"] == "ByteLevel" and not steps[1]["add_prefix_space"] and not steps[1]["use_regex"] and all("<|" in t["content"] for t in spec["added_tokens"])
    return by_word, latin


_made: dict[tuple, Words] = store(__name__)


def tokeniser(path: str) -> Words:
    if path not in _made:
        _made[path] = Words(path)
    return _made[path]


def pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked for, ids, for each piece of each document."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<long>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, end = tokeniser(path), np.array([end_id], "<u4")
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                x = b.slice(at, ROWS)
                out: list[tuple] = []
                for doc_id, ids in zip(x.column(0).to_pylist(), words.ids(x.column(1).to_pylist()), strict=True):
                    ids = np.concatenate([ids, end])
                    for k, start in enumerate(range(0, len(ids), capacity)):
                        own = ids[start : start + capacity]
                        out.append((doc_id, k, start, len(own), binascii.crc32(own.tobytes()), *([own.tolist()] if with_ids else [])))
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*out, strict=True), kinds, strict=False)], ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(out[0])])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(bounded(run), schema)


def best_fit(lengths: np.ndarray, capacity: int = CAPACITY, max_docs: int = MAX_DOCS, max_cost: int = MAX_COST, weights: tuple[float, float, float] = WEIGHTS) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece; lengths come in any order, none above the capacity.

    A piece is held against all open bins of its shard in one array operation; a bin
    leaves when it has no token, document or cost left. Raises ValueError for a
    piece that no empty bin takes.
    """
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    longest = int(lengths.max()) if len(lengths) else 0
    if longest > capacity or longest * longest > max_cost or max_docs < 1:
        raise ValueError("a piece is beyond an empty sequence's capacity")
    caps = np.array([capacity, max_docs, max_cost], float)
    size = 1024
    left, number, used = np.zeros((size, 3)), np.zeros(size, np.int64), 0
    made = 0
    w = np.array(weights)
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        need = np.array([n, 1, n * n], float)
        best = -1
        if used:
            after = left[:used] - need
            fits = np.flatnonzero((after >= 0).all(axis=1))
            if len(fits):
                norm = (w * (after[fits] / caps) ** 2).sum(axis=1)
                best = int(fits[np.argmin(norm)])
        if best < 0:
            if used == size:
                left, number, size = np.vstack([left, np.zeros_like(left)]), np.concatenate([number, np.zeros_like(number)]), 2 * size
            best, used = used, used + 1
            left[best], number[best] = caps, made
            made += 1
        bins[i], offsets[i] = number[best], capacity - left[best, 0]
        left[best] -= need
        if left[best, 0] < 1 or left[best, 1] < 1 or left[best, 2] < 1:
            used -= 1
            left[best], number[best] = left[used], number[used]
    return bins, offsets


def pack(rows: DataFrame, capacity: int = CAPACITY, max_docs: int = MAX_DOCS, max_cost: int = MAX_COST, weights: tuple[float, float, float] = WEIGHTS, shard: int = SHARD) -> DataFrame:
    """Landed pieces with sequence_id and offset added; other columns of the pieces stay.

    A piece that is above ``max_cost`` by itself would fit nowhere: that is an error.
    """
    rows_in = rows.count()
    n = max(1, -(-rows_in // shard))
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(n)).cast("int"))

    def run(t: pa.Table) -> pa.Table:
        # Arrow keeps ids whole beside nulls, which pandas would turn into floats.
        t = t.sort_by([(c, "ascending") for c in ("doc_id", "piece", "ids_crc32")])
        bins, offsets = best_fit(t.column("length").to_numpy(), capacity, max_docs, max_cost, weights)
        place = np.int64(t.column("shard")[0].as_py()) * (1 << 32) + bins
        return t.drop_columns(["shard"]).append_column("sequence_id", pa.array(place)).append_column("offset", pa.array(offsets))

    return dealt.groupBy("shard").applyInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", sequence_id long, offset long")


def packed(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, max_docs: int | None = None, max_cost: int | None = None) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    ``max_docs`` and ``max_cost`` (the sum of squared lengths) bound a sequence
    beside its tokens; left out, tokens alone bind, for the fewest sequences.
    Pieces are cut so that each is within the cost by itself. Null and empty
    texts hold the end id alone. A null doc_id stays null; rows that repeat an id
    are documents of their own. An empty table gives an empty result; other
    columns play no part.
    """
    piece = min(capacity, math.isqrt(max_cost)) if max_cost else capacity
    own = land(pieces(docs, path, id_col, text_col, capacity=piece), f"{run_dir(docs.sparkSession, 'packing')}/pieces")
    return pack(own, capacity, max_docs or capacity, max_cost or capacity * capacity)


def op7_vector_best_fit(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packed(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
