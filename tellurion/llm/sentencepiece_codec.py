"""SentencePiece encoding and decoding through a table of distinct marked words.

In a model whose pieces never reach over a white-space marker, and whose
normaliser changes nothing but the markers, each marked word is segmented by
itself: a text's ids are its words' ids, in order.

Texts are read in blocks of ``BLOCK_BYTES``, about. A block lists its distinct marked
words once and keeps its texts as places in that list. The words are segmented in
one of two tables, and the places pick their ids up in order:

* the block's own, where it lies: nothing is shuffled, and a word is segmented once
  for each block that holds it;
* the corpus's (``corpus_table``): blocks are landed, their lists are joined by word
  with a table in which every word of the corpus stands once, and the ids go back
  to their blocks. That moves each block's list twice and its places once, which
  pays for models slower than this one, or where words are few and often repeated.

Models for which the two conditions don't hold are applied to whole texts.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tellurion.llm.common import bounded, land, run_dir, table, text_of

#: Bytes of text in a block, about; a longer text is a block of its own.
BLOCK_BYTES = 8 << 20
MARK = "▁"
ROWS = 256


class Codec:
    """One worker's model."""

    def __init__(self, model: str):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model)
        #: A lone marker, which the library would take for no text at all.
        self.lone = [self.sp.piece_to_id(MARK)]
        self.by_word = separable(self.sp, model)

    def segment(self, words: list[str]) -> list[list[int]]:
        """The ids of marked words, each given without its first marker."""
        return [ids or self.lone for ids in self.sp.encode(words, num_threads=1)]


def split_marked(text: str) -> list[str]:
    """The marked words, each without its first marker.

    A run of markers belongs to the word after it, so a single split at single
    markers does unless two stand together.
    """
    if MARK in text:
        text = text.replace(MARK, " ")
    if "  " not in text and text[0] != " " and text[-1] != " ":
        return text.split(" ")
    return [x[1:] for x in re.findall(r" +[^ ]*", " " + text)]


def separable(sp, model: str) -> bool:
    """Whether the marked words of a text can be segmented one by one."""
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    with open(model, "rb") as f:
        proto.ParseFromString(f.read())
    n, t = proto.normalizer_spec, proto.trainer_spec
    plain = not n.precompiled_charsmap and n.add_dummy_prefix and not n.remove_extra_whitespaces and n.escape_whitespaces
    inside = any(MARK in p.piece.lstrip(MARK) for p in proto.pieces)
    own = any(p.type == p.USER_DEFINED for p in proto.pieces)
    alone = any(p.piece == MARK for p in proto.pieces)
    return alone and plain and not inside and not own and not t.treat_whitespace_as_suffix and t.model_type == t.BPE


_codecs: dict[str, Codec] = {}


def codec(model: str) -> Codec:
    if model not in _codecs:
        _codecs[model] = Codec(model)
    return _codecs[model]


def in_blocks(batches: Iterator[pa.RecordBatch], block_bytes: int) -> Iterator[tuple[list, list[np.ndarray], list[str]]]:
    """Ids of the rows of each block, the places of each text's marked words, and the block's distinct words."""
    ids, places, known, n = [], [], {}, 0
    for b in batches:
        for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            text = text.as_py()
            marked = split_marked(text) if text else []
            places.append(np.fromiter([known.setdefault(w, len(known)) for w in marked], np.int64, len(marked)))
            ids.append(doc_id)
            n += len(text) + 64
            if n >= block_bytes:
                yield ids, places, list(known)
                ids, places, known, n = [], [], {}, 0
    if ids:
        yield ids, places, list(known)


def blocks_of(rows: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """block, doc_ids, sizes (words of each text), places (of the texts' words in the list, one after another) and words."""
    schema = pa.schema([("block", pa.binary()), ("doc_ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("wide", pa.bool_()), ("places", pa.binary()), ("words", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, places, words in in_blocks(batches, block_bytes):
            wide = len(words) > 1 << 16
            flat = np.concatenate([*places, np.zeros(0, np.int64)]).astype("<u4" if wide else "<u2")
            yield pa.RecordBatch.from_pylist([{"block": uuid.uuid4().bytes, "doc_ids": ids, "sizes": [len(p) for p in places], "wide": wide, "places": flat.tobytes(), "words": words}], schema)

    return rows.mapInArrow(bounded(run), "block binary, doc_ids array<long>, sizes array<int>, wide boolean, places binary, words array<string>")


def word_table(words: DataFrame, model: str) -> DataFrame:
    """word, ids of each distinct marked word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(c.segment(b.column(0).to_pylist()), pa.list_(pa.int32()))], ["word", "ids"])

    return words.select("word").distinct().mapInArrow(bounded(run), "word string, ids array<int>")


def through_table(df: DataFrame, model: str, id_col: str, text_col: str, result: Callable, schema: pa.Schema, ddl: str, block_bytes: int, corpus_table: bool) -> DataFrame:
    """``result(codec, ids, told)`` for each text: its ids as a list and as decimal text; gives the columns after doc_id."""
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    own = [f.name for f in schema]

    def made(docs: list, every: Iterator[tuple[list[int], str]]) -> pa.Table:
        c = codec(model)
        out = [(d, *result(c, ids, told)) for d, (ids, told) in zip(docs, every, strict=True)]
        return pa.Table.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*out, strict=True) if out else [[]] * len(own), schema, strict=True)], schema=schema)

    if not codec(model).by_word:
        def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            c = codec(model)
            for b in batches:
                for at in range(0, b.num_rows, ROWS):
                    x = b.slice(at, ROWS)
                    found = c.sp.encode(x.column(1).to_pylist(), num_threads=1)
                    yield from made(x.column(0).to_pylist(), ((ids, ",".join(map(str, ids))) for ids in found)).to_batches()

        return rows.mapInArrow(bounded(whole), ddl)

    def picked(docs: list, cut, ids: list[list[int]]) -> pa.Table:
        told = [",".join(map(str, x)) for x in ids]
        return made(docs, (([i for p in own for i in ids[p]], ",".join([told[p] for p in own])) for own in cut))

    if not corpus_table:
        def here(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            c = codec(model)
            for docs, places, words in in_blocks(batches, block_bytes):
                yield from picked(docs, (p.tolist() for p in places), c.segment(words) if words else []).to_batches()

        return rows.mapInArrow(bounded(here), ddl)

    blocks = land(blocks_of(rows, block_bytes), f"{run_dir(df.sparkSession, 'sentencepiece')}/blocks")
    words = blocks.select("block", F.posexplode("words").alias("place", "word"))
    table = word_table(words, model)
    found = words.join(table, "word").select(F.col("block").alias("of"), "place", "ids")

    def back(left: pa.Table, right: pa.Table) -> pa.Table:
        ids: list = [None] * right.num_rows
        for at, own in zip(right.column("place").to_pylist(), right.column("ids").to_pylist(), strict=True):
            ids[at] = own
        tables = []
        for row in left.select(["doc_ids", "sizes", "wide", "places"]).to_pylist():
            places, ends = np.frombuffer(row["places"], "<u4" if row["wide"] else "<u2").tolist(), np.cumsum(row["sizes"]).tolist()
            cut = (places[lo:hi] for lo, hi in zip([0, *ends], ends, strict=False))
            tables.append(picked(row["doc_ids"], cut, ids))
        return pa.concat_tables(tables) if tables else schema.empty_table()

    light = blocks.select("block", "doc_ids", "sizes", "wide", "places")
    return light.groupBy("block").cogroup(found.groupBy("of")).applyInArrow(back, ddl)


def encode(df: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, corpus_table: bool = False) -> DataFrame:
    """doc_id and ids (array of int) for each row; null text is the empty text, which has no ids."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])
    return through_table(df, model, id_col, text_col, lambda c, ids, told: (ids,), schema, "doc_id long, ids array<int>", block_bytes, corpus_table)


def decode(df: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and text for each row of ids; null ids give the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([c.sp.decode(ids or []) for ids in b.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids")).mapInArrow(bounded(run), "doc_id long, text string")


def digests(df: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, corpus_table: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for each row: encoded whole, then decoded from the ids.

    Null text is the empty text (no ids, decoded to the empty text); a null id
    stays null; repeated rows each give a row; an empty table gives an empty
    result; other columns play no part.
    """

    def result(c: Codec, ids: list[int], told: str) -> tuple:
        back = c.sp.decode(ids) if ids else ""
        return len(ids), hashlib.sha256(told.encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()

    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
    return through_table(df, model, id_col, text_col, result, schema, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", block_bytes, corpus_table)


def op2_sentencepiece(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
