"""Secret scans: known forms, and a battery of randomness tests for the rest.

Known forms are found by pattern. Every other long token is tested: its
encoding is inferred, then

* chi-squared uniformity over the encoding's alphabet, a runs test about the
  median and a lag-1 serial correlation must all be in keeping with a uniform
  random string, and
* an e-value compares the uniform string with ordinary text of three styles
  (lower case, upper case, numeric): the likelihood ratio against the style
  that fits best. Its mean under ordinary text is 1 at most, at any length.

Tokens are reported by e-BH over a document's tested tokens, weighted by length
(a long token can show more), so the share of false finds is held at ``FDR``.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tellurion.llm.common import bounded, table, text_of

# The known forms, in the order in which kinds are listed.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "random")

#: "=" stands as padding only, so a value is parted from the name before it.
TOKEN = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
#: Share of false finds, and the least p-value at which a test still calls a token uniform.
FDR, UNIFORM_P = 1e-3, 1e-3
# Alphabets in the order in which they are tried.
ALPHABETS = {
    "hex": "0123456789abcdef",
    "hex-upper": "0123456789ABCDEF",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "base62": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "base64-url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
}
SETS = {k: frozenset(v) for k, v in ALPHABETS.items()}
# Letter frequencies in per cent, a to z, of European text.
LETTERS = [8.2, 1.5, 2.8, 4.3, 12.7, 2.2, 2.0, 6.1, 7.0, 0.2, 0.8, 4.0, 2.4, 6.7, 7.5, 1.9, 0.1, 6.0, 6.3, 9.1, 2.8, 1.0, 2.4, 0.2, 2.0, 0.1]


def _style(lower: float, upper: float, digit: float) -> dict[str, float]:
    """Log likelihood of a character; letters of either case follow LETTERS when that case prevails."""
    out = {}
    for i, c in enumerate("abcdefghijklmnopqrstuvwxyz"):
        own = LETTERS[i] / sum(LETTERS)
        out[c] = math.log(lower * (own if lower > 0.5 else 1 / 26))
        out[c.upper()] = math.log(upper * (own if upper > 0.5 else 1 / 26))
    out |= dict.fromkeys("0123456789", math.log(digit / 10))
    return out | dict.fromkeys("+/-_=", math.log((1 - lower - upper - digit) / 5))


STYLES = [_style(0.85, 0.05, 0.05), _style(0.05, 0.85, 0.05), _style(0.06, 0.06, 0.8)]


def _two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def uniformity_p(codes: list[int], size: int) -> float:
    """Chi-squared over as many equal parts of the alphabet as leave five expected in each."""
    parts = min(size, len(codes) // 5)
    if parts < 2:
        return 1.0
    seen, wide = [0] * parts, [0] * parts
    for c in range(size):
        wide[c * parts // size] += 1
    for c in codes:
        seen[c * parts // size] += 1
    x = sum((s - (e := len(codes) * w / size)) ** 2 / e for s, w in zip(seen, wide, strict=True))
    k = parts - 1
    z = ((x / k) ** (1 / 3) - (1 - 2 / (9 * k))) / math.sqrt(2 / (9 * k))
    return math.erfc(z / math.sqrt(2)) / 2


def runs_p(codes: list[int], size: int) -> float:
    """Wald-Wolfowitz runs about the middle of the alphabet."""
    up = [2 * c >= size for c in codes]
    a = sum(up)
    b, n = len(up) - a, len(up)
    if not a or not b:
        return 2.0 ** (1 - n)
    runs = 1 + sum(x != y for x, y in zip(up, up[1:], strict=False))
    mean = 1 + 2 * a * b / n
    var = (mean - 1) * (mean - 2) / (n - 1)
    return _two_sided((runs - mean) / math.sqrt(var)) if var > 0 else 1.0


def serial_p(codes: list[int]) -> float:
    """Lag-1 serial correlation."""
    n = len(codes)
    m = sum(codes) / n
    var = sum((c - m) ** 2 for c in codes)
    if not var:
        return 0.0
    r = sum((x - m) * (y - m) for x, y in zip(codes, codes[1:], strict=False)) / var
    return _two_sided((r + 1 / n) * math.sqrt(n))


def encoding(token: str) -> str | None:
    """The first alphabet that holds the token; None for decimal digits, which tell nothing, and mixed ones."""
    if token.isdigit():
        return None
    own = set(token)
    return next((k for k, v in SETS.items() if own <= v), None)


def evidence(token: str) -> float:
    """Log of the e-value that the token is a uniform random string rather than text; -inf if a test denies it."""
    token = token.strip("=")
    name = encoding(token)
    if name is None or len(token) < 16:
        return -math.inf
    alphabet = ALPHABETS[name]
    codes = [alphabet.index(c) for c in token]
    if min(uniformity_p(codes, len(alphabet)), runs_p(codes, len(alphabet)), serial_p(codes)) < UNIFORM_P:
        return -math.inf
    # Alphabets are tried in turn, which costs the uniform side their number.
    return -len(token) * math.log(len(alphabet)) - math.log(len(ALPHABETS)) - max(sum(s[c] for c in token) for s in STYLES)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Known forms: kind, start and end in code points, by start and then kind."""
    out = [("assign", *m.span()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text)]
    out += [("hex", *m.span()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0])))


def random_spans(text: str, known: list[tuple[str, int, int]], fdr: float = FDR) -> list[tuple[str, int, int]]:
    """Tokens outside the known spans that the battery calls random, under false-discovery control."""
    tested = [(m.start(), m.end()) for m in TOKEN.finditer(text)]
    at, free = 0, []
    for s, e in tested:  # both are in order of their starts
        while at < len(known) and known[at][2] <= s:
            at += 1
        if not any(k[1] < e and s < k[2] for k in known[at : at + 4]):
            free.append((s, e))
    if not free:
        return []
    mean = sum(e - s for s, e in free) / len(free)
    logs = sorted(((evidence(text[s:e]) + math.log((e - s) / mean), s, e) for s, e in free), reverse=True)
    found = max((k for k, (x, _, _) in enumerate(logs, 1) if x >= math.log(len(logs) / (k * fdr))), default=0)
    return sorted(("random", s, e) for _, s, e in logs[:found])


def spans(text: str) -> tuple[list, list]:
    base = base_spans(text)
    extra = random_spans(text, base)
    return base, sorted(base + extra, key=lambda x: (x[1], KINDS.index(x[0]))) if extra else base


def told(found: list[tuple[str, int, int]]) -> str:
    return ",".join([f"{k}:{s}:{e}" for k, s, e in found])


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    Null text is the empty text, which has no spans; a null id stays null;
    repeated rows each give a row; an empty table gives an empty result; other
    columns play no part. Texts are scanned whole.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[] for _ in schema]
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                base, every = spans(text.as_py())
                kinds = [x[0] for x in base]
                for col, v in zip(out, (doc_id, *(kinds.count(k) for k in KINDS[:3]), hashlib.sha256(told(base).encode()).hexdigest(), told(every)), strict=True):
                    col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, schema, strict=True)], schema=schema)

    return df.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(bounded(run), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redacted(text: str, by: str = "[SECRET]") -> str:
    """The text with every span, or run of overlapping spans, replaced."""
    out, at = [], 0
    for _, s, e in spans(text)[1]:
        if s >= at:
            out += [text[at:s], by]
        at = max(at, e)
    return "".join(out) + text[at:]


def redact(df: DataFrame, text_col: str = "text", by: str = "[SECRET]") -> DataFrame:
    """The rows with secrets in ``text_col`` replaced; all columns stay, null texts stay null."""
    schema, k = df.schema, df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            new = pa.array([None if x is None else redacted(x, by) for x in (v.as_py() for v in b.column(k))], pa.string())
            yield pa.RecordBatch.from_arrays([new if i == k else b.column(i) for i in range(b.num_columns)], b.schema.names)

    return df.mapInArrow(bounded(run), schema)


def op4_secret_scan(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
