"""Secret scans: fixed patterns plus sliding-window Shannon entropy."""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

KINDS = ("assign", "access", "hex", "entropy")
# The base patterns. A run that is matched greedily and then found too
# short holds no longer match of its own kind, so access and hex carry the length.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")

CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
#: Class name, its members, and the entropy in bits a character that a window must reach.
CLASSES = (("hex", re.compile(r"[0-9A-Fa-f]+\Z"), 3.0), ("base64", re.compile(r"[A-Za-z0-9+/_=-]+\Z"), 3.8))
#: Candidates that look random but are public: UUIDs; paths and slugs of plain words,
#: numbers and words with a number, at least three; placeholders, runs of one alphabet in order.
#: No separator can be part of a word, so a string of any length is matched in one pass.
UUID = re.compile(r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}")
SLUG = re.compile(r"/?(?:[A-Za-z]{2,}[0-9]{0,2}|[0-9]{1,8})(?:[/_-](?:[A-Za-z]{2,}[0-9]{0,2}|[0-9]{1,8})){2,}/?")
PLACEHOLDER = re.compile(r"example|placeholder|changeme|xxxx|abcdefgh|01234567|12345678", re.I)


def allowed(s: str) -> bool:
    """Whether the allow-list suppresses a candidate."""
    return bool(UUID.fullmatch(s) or SLUG.fullmatch(s) or PLACEHOLDER.search(s))


def max_window_entropy(s: str, width: int) -> float:
    """The largest Shannon entropy (bits a character) of any window of ``width``
    characters; a shorter string is one window. The sum of c*log2(c) is kept by the
    two counts that change when the window moves, so a string costs O(its length)."""
    width = min(width, len(s))
    if not width:
        return 0.0
    clog = [0.0] + [c * math.log2(c) for c in range(1, width + 1)]
    counts: dict[str, int] = {}
    total = 0.0
    least = math.inf
    for i, ch in enumerate(s):
        c = counts.get(ch, 0)
        if i >= width:
            old = s[i - width]
            if old != ch:
                o = counts[old]
                counts[old] = o - 1
                total += clog[o - 1] - clog[o] + clog[c + 1] - clog[c]
                counts[ch] = c + 1
        else:
            total += clog[c + 1] - clog[c]
            counts[ch] = c + 1
        if i >= width - 1 and total < least:
            least = total
    return math.log2(width) - least / width


def random_looking(s: str, width: int = 20) -> bool:
    """Whether a candidate string is a secret by the entropy of its character class.
    Needs a digit and a letter; a base64 candidate also both cases. Allow-listed
    strings never are."""
    if not (any("0" <= c <= "9" for c in s) and any(c.isalpha() for c in s)):
        return False
    for name, members, bits in CLASSES:
        if members.match(s):
            if name == "base64" and (s.lower() == s or s.upper() == s):
                return False
            return max_window_entropy(s, width) >= bits and not allowed(s)
    return False


def find_spans(text: str, width: int = 20) -> list[tuple[int, int, int]]:
    """(start, kind number, end) in code points, sorted: all base spans, and entropy
    spans that no base span overlaps."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    more = [m for m in CANDIDATE.finditer(text) if random_looking(m[0], width)]
    if more:
        base = sorted((s, e) for s, _, e in out)
        starts, reach, far = [s for s, _ in base], [], 0
        for _, e in base:
            reach.append(far := max(far, e))
        for m in more:
            k = bisect_right(starts, m.end() - 1)
            if not k or reach[k - 1] <= m.start():
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def _written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, n_entropy long, base_sha256 string, spans string"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 20) -> DataFrame:
    """One row per input row: counts by kind, the digest of the base spans, all spans.

    Map only: whole texts stream through Arrow batches, nothing is shuffled.
    Null text: as empty (no spans, digest of the empty string). Null id: kept as null.
    Repeated rows: one result each. Spans that start together: by kind as listed. Very
    long texts: time in proportion to the length. Empty table: no rows. Other columns
    are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, digests, written = [[0] * b.num_rows for _ in KINDS], [], []
            for i, t in enumerate(b.column(1)):
                spans = find_spans(t.as_py() or "", width)
                for _, k, _ in spans:
                    n[k][i] += 1
                digests.append(hashlib.sha256(_written([x for x in spans if x[1] < 3]).encode()).hexdigest())
                written.append(_written(spans))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, pa.int64()) for x in n), pa.array(digests, pa.string()), pa.array(written, pa.string())], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, SCHEMA)
