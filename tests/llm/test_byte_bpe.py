"""The transducer against the library, and the UTF-8 machine against the interpreter's own decoder."""

import codecs
import hashlib
import struct

import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tellurion.llm import byte_bpe

PATHS = [P.path("byte_bpe_50k.tiktoken"), P.path("byte_bpe_multi_50k.tiktoken")]
PATH = PATHS[0]


def library(path):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.read_ranks(path), special_tokens={})


def ids_of(codec, text):
    raw = codec.ids(text)
    return list(struct.unpack(f"<{len(raw) // 4}I", raw))


@pytest.mark.parametrize("path", PATHS)
def test_vocabularies_are_proper(path):
    assert byte_bpe.proper(byte_bpe.read_ranks(path))


def test_improper_ranks_are_refused(tmp_path):
    import base64

    ranks = {bytes([b]): b for b in range(256)} | {b"abc": 256}
    path = tmp_path / "ranks"
    path.write_bytes(b"\n".join(base64.b64encode(t) + b" " + str(r).encode() for t, r in ranks.items()))
    with pytest.raises(ValueError):
        byte_bpe.checked(str(path))


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(max_size=60), st.lists(st.sampled_from(["a", "aa", "th", "he", " the", "  ", "\n", "é", "中", "😀", "1", "''", "'s", "--", "er", "ing", "\x85", "\x1c"]), max_size=40).map("".join)))
def test_same_as_the_library(text):
    codec = byte_bpe.codec(PATH, P.PATTERN)
    assert ids_of(codec, text) == library(PATH).encode_ordinary(text)


def test_every_code_point():
    codec, lib = byte_bpe.codec(PATH, P.PATTERN), library(PATH)
    for lo in range(0, 0x110000, 0x400):
        text = "".join(f"a{chr(c)}1{chr(c)} x" for c in range(lo, lo + 0x400) if not 0xD800 <= c < 0xE000)
        assert ids_of(codec, text) == lib.encode_ordinary(text)


def test_long_matches_and_full_tables():
    """Runs longer than any table, through a transducer that starts afresh every few states."""
    ranks = byte_bpe.read_ranks(PATH)
    small, lib = byte_bpe.Transducer(ranks, table_states=5), library(PATH)
    for text in (" " * 5000, "a" * 5000, "ab" * 3000, "antidisestablishmentarianism" * 50, "=-" * 999):
        assert small.ids(text.encode()) == lib._core_bpe.encode_single_piece(text.encode())
        assert len(small.places) <= 6


def test_look_ahead_is_bounded():
    """What isn't emitted yet never has more bytes than the longest token twice over."""
    fst = byte_bpe.Transducer(byte_bpe.read_ranks(PATH))
    fst.ids(b"the theatre thereof is therefore threatened " * 20)
    longest = max(map(len, fst.bytes_of.values()))
    assert max(sum(len(fst.bytes_of[t]) for t in kept) for place in fst.places for kept, _, _ in place) <= 2 * longest


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.binary(max_size=30), st.text(max_size=12).map(str.encode)), st.lists(st.integers(1, 5), min_size=1, max_size=30))
def test_utf8_in_chunks(data, sizes):
    machine, want, got, at = byte_bpe.Utf8(), codecs.getincrementaldecoder("utf-8")("replace"), [], 0
    for n in [*sizes, len(data)]:
        got.append(machine.feed(data[at : at + n]))
        at += n
    assert "".join(got) + machine.end() == want.decode(data, True)


def test_digests_of_edge_rows(spark, edge_docs, no_docs):
    out = {(r["doc_id"], r["ids_sha256"]): r for r in byte_bpe.digests(edge_docs, PATH, P.PATTERN).collect()}
    lib, empty = library(PATH), hashlib.sha256(b"").hexdigest()
    rows = edge_docs.collect()
    for r in rows:
        text = r["text"] or ""
        ids = lib.encode_ordinary(text)
        own = out[r["doc_id"], hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()]
        assert own["n_tokens"] == len(ids) and own["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert byte_bpe.digests(edge_docs, PATH, P.PATTERN).count() == len(rows)
    assert {r["decoded_sha256"] for k, r in out.items() if k[0] in (4, 6)} == {empty}
    assert byte_bpe.digests(no_docs, PATH, P.PATTERN).count() == 0


def test_round_trip_of_columns(spark, edge_docs):
    ids = byte_bpe.encode(edge_docs, PATH, P.PATTERN)
    back = byte_bpe.decode(ids, PATH, P.PATTERN)
    assert sorted((r["doc_id"] or 0, r["text"]) for r in back.collect()) == sorted((r["doc_id"] or 0, r["text"] or "") for r in edge_docs.collect())
    cut = spark.createDataFrame([(1, [byte_bpe.read_ranks(PATH)[b"\xe4"]]), (2, None)], "doc_id long, ids array<long>")
    assert {r["doc_id"]: r["text"] for r in byte_bpe.decode(cut, PATH, P.PATTERN).collect()} == {1: "�", 2: ""}


def test_whole_table(spark):
    import __spark_entry__ as e

    sf = "/root/testdata/sf0.01"
    lib = library(PATH)
    got = {r["doc_id"]: r for r in e.queries()["op13_byte_bpe"](spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(docs) == len(got)
    for r in docs:
        text = r["text"] or ""
        ids = lib.encode_ordinary(text)
        g = got[r["doc_id"]]
        assert (g["n_tokens"], g["ids_sha256"], g["decoded_sha256"]) == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
