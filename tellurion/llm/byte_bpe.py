"""Byte-level BPE encoding and decoding through a lazily determinised transducer.

A rank file is *proper* when each token is built from two tokens of lower rank.
Then a sequence of tokens is what the merges make of its bytes exactly if every
two neighbours are what the merges make of theirs. That is a property of a finite
automaton: it reads bytes, its places are (last token, way into the next one in
the vocabulary's trie), and a token may follow another only where the two stay
apart. The automaton guesses where tokens end. ``Transducer`` determinises it by
subsets as bytes come: a state holds all live places, each with the tokens that
it has beyond what all have in common; what they have in common is emitted. No
token is longer than the vocabulary's longest, so a place dies, and a token is
emitted, after that many bytes at most. States and their steps are kept in a table
which starts afresh when it is full, so memory is bounded for texts of any kind.

Text is first cut by the splitting pattern; matches that were seen before come from a
bounded table in each worker. Decoding streams: bytes of ids come in chunks,
and ``Utf8`` carries a character that a chunk's end cuts into the next one.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tellurion.llm.common import bounded, table, text_of

#: Bounds of a worker's tables: matches with their ids, automaton states, and pairs of tokens.
TABLE_PIECES, TABLE_STATES, TABLE_PAIRS = 250_000, 300_000, 500_000
#: Tokens that are tried before a place is taken to be alive.
TRIED = 4
#: Longer matches aren't kept.
KEEP_BYTES = 64
#: Ids that are decoded at once.
DECODE_IDS = 65_536
ROWS = 256
_ID = struct.Struct("<I").pack
_NEVER = 1 << 62


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def merged(piece: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """What the merges make of some bytes: the pair of least rank first, the leftmost of equals. For short pieces only."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        rank, at = min((ranks.get(parts[i] + parts[i + 1], _NEVER), i) for i in range(len(parts) - 1))
        if rank == _NEVER:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


class Merges:
    """A vocabulary's tokens as what merges build: halves of a token, and which tokens stay apart side by side."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self._halves: dict[bytes, tuple[bytes, bytes] | None] = {}
        self._ends: dict[bytes, list[tuple[bytes, int]]] = {}
        self._begins: dict[bytes, list[tuple[bytes, int]]] = {}

    def halves(self, token: bytes) -> tuple[bytes, bytes] | None:
        """The two tokens of its last merge; None for a byte, and for a token that the merges don't reach."""
        if token not in self._halves:
            found = None
            if len(token) > 1:
                # Without its own rank a token stops one merge short.
                rank, ranks = self.ranks[token], self.ranks
                parts = [token[i : i + 1] for i in range(len(token))]
                while len(parts) > 2:
                    best, at = min((ranks.get(parts[i] + parts[i + 1], _NEVER), i) for i in range(len(parts) - 1))
                    if best >= rank:
                        break
                    parts[at : at + 2] = [parts[at] + parts[at + 1]]
                if len(parts) == 2 and max(self.ranks.get(p, _NEVER) if len(p) > 1 else -1 for p in parts) < rank:
                    found = (parts[0], parts[1])
            self._halves[token] = found
        return self._halves[token]

    def reached(self, token: bytes) -> bool:
        return len(token) == 1 or self.halves(token) is not None

    def edge(self, token: bytes, side: int) -> list[tuple[bytes, int]]:
        """The parts that lie at one edge while a token is built, each with the rank of the merge that ends it."""
        kept = self._ends if side else self._begins
        if token not in kept:
            out, end = [], _NEVER
            part = token
            while True:
                out.append((part, end))
                pair = self.halves(part)
                if pair is None:
                    break
                end, part = self.ranks[part], pair[side]
            kept[token] = out
        return kept[token]

    def apart(self, a: bytes, b: bytes) -> bool:
        """Whether the merges leave ``a`` and ``b`` as they are where one follows the other.

        They don't if two parts that lie against each other join before either is
        merged into its own token; of merges of equal rank the left one is first.
        """
        ranks, begins = self.ranks, self.edge(b, 0)
        for x, x_end in self.edge(a, 1):
            for y, y_end in begins:
                rank = ranks.get(x + y)
                if rank is not None and rank < x_end and rank <= y_end:
                    return False
        return True


def proper(ranks: dict[bytes, int]) -> bool:
    """Whether every byte is a token and every token is merged from two of lower rank."""
    m = Merges(ranks)
    return all(bytes([b]) in ranks for b in range(256)) and all(m.reached(t) for t in ranks)


class Transducer:
    """Bytes in, token ids out, one state at a time.

    A state is a tuple of places ``(ids not yet emitted, last id, trie node)``.
    Exactly one place of a state stands at the trie's root: that of the tokens which
    the bytes so far would give if they ended here.
    """

    def __init__(self, ranks: dict[bytes, int], table_states: int = TABLE_STATES):
        self.table_states, self.merges = table_states, Merges(ranks)
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        #: The trie: (node, byte) to node, and the id that ends at a node.
        self.child: dict[int, int] = {}
        self.token: dict[int, int] = {}
        self.ways: dict[int, list[int]] = {}
        nodes = 1
        for token, rank in ranks.items():
            at = 0
            for b in token:
                after = self.child.get(at << 8 | b)
                if after is None:
                    after = self.child[at << 8 | b] = nodes
                    self.ways.setdefault(at, []).append(after)
                    nodes += 1
                at = after
            self.token[at] = rank
        self._open: dict[tuple[int, int], bool] = {}
        self._apart: dict[tuple[int, int], bool] = {}
        self._below: dict[int, list[int]] = {}
        self.forget()

    def forget(self) -> None:
        """An empty table of states; numbers of states from before mean nothing after."""
        self.places: list[tuple] = []
        self.steps: dict[int, tuple[int, tuple[int, ...]]] = {}
        self.number: dict[tuple, int] = {}
        self.first = self._state((((), -1, 0),))

    def _state(self, places: tuple) -> int:
        number = self.number.get(places)
        if number is None:
            number = self.number[places] = len(self.places)
            self.places.append(places)
        return number

    def apart(self, last: int, token: int) -> bool:
        known = self._apart.get((last, token))
        if known is None:
            if len(self._apart) >= TABLE_PAIRS:
                self._apart.clear()
            known = self._apart[last, token] = self.merges.apart(self.bytes_of[last], self.bytes_of[token])
        return known

    def open(self, last: int, node: int) -> bool:
        """Whether a token that lies deeper in the trie may follow ``last``; a place that has none is dead.

        After a few tokens that may not, the place is left alive; that costs time at most.
        """
        known = self._open.get((last, node))
        if known is None:
            below = self._below.get(node)
            if below is None:
                below, level = [], self.ways[node]
                while level and len(below) < TRIED:
                    below += [self.token[n] for n in level if n in self.token]
                    level = [m for n in level for m in self.ways.get(n, ())]
                self._below[node] = below
            if len(self._open) >= TABLE_PAIRS:
                self._open.clear()
            known = self._open[last, node] = len(below) >= TRIED or any(self.apart(last, t) for t in below)
        return known

    def _step(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        out, whole = [], None
        child, token, ways = self.child, self.token, self.ways
        for kept, last, node in self.places[state]:
            after = child.get(node << 8 | byte)
            if after is None:
                continue
            if after in ways and (last < 0 or self.open(last, after)):
                out.append((kept, last, after))
            if whole is None and (t := token.get(after)) is not None and (last < 0 or self.apart(last, t)):
                whole = ((*kept, t), t, 0)
        out.append(whole)
        shared, shortest = 0, min([p[0] for p in out], key=len)
        for k, t in enumerate(shortest):
            if any([p[0][k] != t for p in out]):
                break
            shared = k + 1
        if shared:
            out = [(kept[shared:], last, node) for kept, last, node in out]
        step = self.steps[state << 8 | byte] = (self._state(tuple(out)), shortest[:shared])
        return step

    def ids(self, piece: bytes) -> list[int]:
        out: list[int] = []
        state, steps = self.first, self.steps
        for b in piece:
            step = steps.get(state << 8 | b)
            if step is None:
                if len(self.places) >= self.table_states:
                    # The table is full: the state that is at hand moves to a new one.
                    here = self.places[state]
                    self.forget()
                    state, steps = self._state(here), self.steps
                step = self._step(state, b)
            state, emitted = step
            if emitted:
                out += emitted
        out += self.places[state][-1][0]
        return out


# The well-formed sequences of UTF-8, as ranges of the bytes after each range of first bytes.
WELL_FORMED = [
    ((0x00, 0x7F), []),
    ((0xC2, 0xDF), [(0x80, 0xBF)]),
    ((0xE0, 0xE0), [(0xA0, 0xBF), (0x80, 0xBF)]),
    ((0xE1, 0xEC), [(0x80, 0xBF), (0x80, 0xBF)]),
    ((0xED, 0xED), [(0x80, 0x9F), (0x80, 0xBF)]),
    ((0xEE, 0xEF), [(0x80, 0xBF), (0x80, 0xBF)]),
    ((0xF0, 0xF0), [(0x90, 0xBF), (0x80, 0xBF), (0x80, 0xBF)]),
    ((0xF1, 0xF3), [(0x80, 0xBF), (0x80, 0xBF), (0x80, 0xBF)]),
    ((0xF4, 0xF4), [(0x80, 0x8F), (0x80, 0xBF), (0x80, 0xBF)]),
]


def _machine() -> dict[tuple, dict[int, tuple]]:
    """Steps between states; a state is the ranges of bytes that its character still needs."""
    steps: dict[tuple, dict[int, tuple]] = {(): {}}
    for (lo, hi), rest in WELL_FORMED:
        states = [tuple(rest[k:]) for k in range(len(rest) + 1)]
        steps[()] |= dict.fromkeys(range(lo, hi + 1), states[0])
        for state, after in zip(states, states[1:], strict=False):
            steps[state] = dict.fromkeys(range(state[0][0], state[0][1] + 1), after)
    return steps


class Utf8:
    """Bytes in, text out; a character that isn't whole waits for the next chunk.

    Bytes that are no UTF-8 become replacement characters, one for each longest
    beginning of a character.
    """

    STEPS = _machine()

    def __init__(self) -> None:
        self.state: tuple = ()
        self.kept = b""

    def feed(self, chunk: bytes) -> str:
        data = self.kept + chunk
        # A character has four bytes at most, so its first byte is one of the last three if it isn't whole.
        cut = len(data)
        for back in range(1, min(3, len(data)) + 1):
            state: tuple | None = ()
            for b in data[len(data) - back :]:
                state = self.STEPS[state].get(b) if state is not None else None
                if state == ():
                    state = None
            if state:
                cut, self.state = len(data) - back, state
                break
        else:
            self.state = ()
        self.kept = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def end(self) -> str:
        out, self.kept, self.state = self.kept.decode("utf-8", "replace"), b"", ()
        return out


class Codec:
    """One worker's vocabulary, automaton and table of matches."""

    def __init__(self, path: str, pattern: str):
        import regex

        ranks = read_ranks(path)
        # The pattern's white space is Unicode's own property, which not all engines mean by \s.
        self.split = regex.compile(pattern).findall
        self.ranks, self.fst = ranks, Transducer(ranks)
        #: Matches that were seen, and those of the table before: a full one steps back and the older one goes.
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def piece(self, match: str) -> bytes:
        raw = match.encode()
        rank = self.ranks.get(raw)
        return _ID(rank) if rank is not None else b"".join(map(_ID, self.fst.ids(raw)))

    def ids(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        known, matches = self.known, self.split(text)
        try:
            return b"".join([known[m] for m in matches])
        except KeyError:
            pass
        out = []
        for m in matches:
            own = known.get(m)
            if own is None:
                own = self.older.get(m) or self.piece(m)
                if len(m) <= KEEP_BYTES:
                    if len(known) >= TABLE_PIECES:
                        self.older, self.known = known, {}
                        known = self.known
                    known[m] = own
            out.append(own)
        return b"".join(out)

    def bytes(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.fst.bytes_of.__getitem__, ids))


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(path, pattern)
    return _codecs[path, pattern]


def _unpacked(ids: bytes) -> Iterator[tuple[int, ...]]:
    for at in range(0, len(ids), 4 * DECODE_IDS):
        own = ids[at : at + 4 * DECODE_IDS]
        yield struct.unpack(f"<{len(own) // 4}I", own)


def checked(path: str) -> None:
    """Raises ValueError for ranks that the automaton can't follow; once, on the driver."""
    if path not in _checked:
        if not proper(read_ranks(path)):
            raise ValueError(f"{path}: a token isn't merged from two tokens of lower rank")
        _checked.add(path)


_checked: set[str] = set()


def encode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (array of long) for each row; null text is the empty text, which has no ids."""
    checked(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                x = b.slice(at, ROWS)
                ids = [[i for part in _unpacked(c.ids(t)) for i in part] for t in x.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([x.column(0), pa.array(ids, pa.list_(pa.int64()))], ["doc_id", "ids"])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(bounded(run), "doc_id long, ids array<long>")


def decode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and text for each row of ids; null ids give the empty text.

    Ids that don't make whole characters give replacement characters; an id that
    the vocabulary lacks fails.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)

        def text(ids: list[int]) -> str:
            u = Utf8()
            return "".join([u.feed(c.bytes(ids[at : at + DECODE_IDS])) for at in range(0, len(ids), DECODE_IDS)]) + u.end()

        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([text(ids or []) for ids in b.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<long>").alias("ids")).mapInArrow(bounded(run), "doc_id long, text string")


def digests(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for each row: encoded whole, then decoded from the ids in chunks.

    Null text is the empty text (no ids, decoded to nothing); a null id stays null;
    repeated rows each give a row; an empty table gives an empty result; other
    columns play no part. A text and its ids are in a worker's memory at once.
    """
    checked(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                x = b.slice(at, ROWS)
                n, ids_sha, back_sha = [], [], []
                for text in x.column(1).to_pylist():
                    ids, u, back = c.ids(text), Utf8(), hashlib.sha256()
                    for part in _unpacked(ids):
                        back.update(u.feed(c.bytes(part)).encode())
                    back.update(u.end().encode())
                    n.append(len(ids) // 4)
                    ids_sha.append(hashlib.sha256(ids).hexdigest())
                    back_sha.append(back.hexdigest())
                yield pa.RecordBatch.from_arrays([x.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(back_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    return rows.mapInArrow(bounded(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op13_byte_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
