"""Scalar functions as Column expressions; Python UDFs only where none exists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

EPOCH = "2000-01-01"
_MASK32 = (1 << 32) - 1


# -- dates: days since 2000-01-01 --------------------------------------------
def date_to_days(day: Column) -> Column:
    """Signed days since the epoch (earlier dates are negative)."""
    return F.datediff(day, F.lit(EPOCH).cast("date")).cast("bigint")


def days_to_date(days: Column) -> Column:
    return F.date_add(F.lit(EPOCH).cast("date"), days.cast("int"))


# -- entity ids: [peer:32][local:32] ------------------------------------------
def make_eid(peer: Column, local: Column) -> Column:
    return F.shiftleft(peer.cast("bigint"), 32).bitwiseOR(local.cast("bigint").bitwiseAND(F.lit(_MASK32)))


def eid_peer(eid: Column) -> Column:
    return F.shiftrightunsigned(eid.cast("bigint"), 32)


def eid_local(eid: Column) -> Column:
    return eid.cast("bigint").bitwiseAND(F.lit(_MASK32))


# -- grams -----------------------------------------------------------------------
def check_n(n: int) -> int:
    if n not in (2, 3, 4):
        raise ValueError("n must be 2, 3 or 4")
    return n


def grams(text: Column, n: int = 2) -> Column:
    """All n-character strings of a text, in order (empty for shorter or null texts)."""
    # Each match takes one character and looks ahead at the n that begin there.
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"(?s)(?=(.{{{check_n(n)}}}))."), 1)


# Characters that separate tokens.
SEPARATORS = " \t\n\x0c\r" + ".,!?;:()[]{}\"'/\\|-_~`" + "。、！？「」『』"


def tokens(text: Column) -> Column:
    """Lower-cased tokens between separators. Separators become spaces first: a table of
    characters is looked up faster than a pattern of them is matched."""
    spaced = F.translate(F.lower(F.coalesce(text, F.lit(""))), SEPARATORS, " " * len(SEPARATORS))
    return F.array_remove(F.split(spaced, " "), "")


def once(value: Column, use) -> Column:
    """``use(value)`` with the value computed once a row: a lambda's variable is bound,
    while an expression that stands in several places is copied to each."""
    return F.get(F.transform(F.array(value), use), 0)


# -- vectors (array<float>), computed in double ------------------------------------
def _pairwise(a: Column, b: Column, f) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: f(x.cast("double"), y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return _pairwise(a, b, lambda x, y: x * y)


def l2(a: Column, b: Column) -> Column:
    """Squared Euclidean distance."""
    return _pairwise(a, b, lambda x, y: (x - y) * (x - y))


def cosine_sim(a: Column, b: Column) -> Column:
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(n == 0, 0.0).otherwise(dot(a, b) / F.when(n == 0, 1.0).otherwise(n))


def normalize(v: Column) -> Column:
    n = F.sqrt(dot(v, v))
    return F.when(n == 0, v.cast("array<double>")).otherwise(F.transform(v, lambda x: x.cast("double") / F.when(n == 0, 1.0).otherwise(n)))


def distance(metric: str, a: Column, b: Column) -> Column:
    """Smaller is closer: cosine is 1 - similarity and not negative, l2 is squared, dot is negated."""
    if metric == "cosine":
        return F.greatest(F.lit(0.0), F.lit(1.0) - cosine_sim(a, b))
    if metric == "l2":
        return l2(a, b)
    if metric == "dot":
        return -dot(a, b)
    raise ValueError(f"unknown metric {metric}")


# -- hashes ------------------------------------------------------------------------
def _fnv(data: bytes, start: int, prime: int, bits: int) -> int:
    return reduce(lambda h, b: ((h ^ b) * prime) & ((1 << bits) - 1), data, start)


def fnv1a_32(data: bytes) -> int:
    return _fnv(data, 0x811C9DC5, 0x01000193, 32)


def fnv1a_64(data: bytes) -> int:
    return _fnv(data, 0xCBF29CE484222325, 0x100000001B3, 64)


def fnv1a_32_col(value: Column) -> Column:
    """The same of a text's UTF-8 bytes as a Column; products stay under 2**63."""
    digits = F.regexp_extract_all(F.hex(value.cast("binary")), F.lit("(..)"), 1)
    step = lambda h, b: (h.bitwiseXOR(F.conv(b, 16, 10).cast("bigint")) * 0x01000193).bitwiseAND(F.lit(_MASK32))
    return F.when(value.isNotNull(), F.aggregate(digits, F.lit(0x811C9DC5).cast("bigint"), step))


def blob_id(data: Column) -> Column:
    return F.sha2(data.cast("binary"), 256)


# -- hybrid logical clock ------------------------------------------------------------
def hlc(wall: Column, logical: Column, peer: Column) -> Column:
    """A struct that orders as the clock does."""
    return F.struct(wall.cast("bigint").alias("wall"), logical.cast("bigint").alias("logical"), peer.cast("bigint").alias("peer"))


def hlc_receive(local: tuple[int, int, int], received: tuple[int, int, int], now: int) -> tuple[int, int, int]:
    """The next clock of ``local`` after a message: the latest wall time, and a
    counter that goes on from whichever clock had that wall time already."""
    wall = max(local[0], received[0], now)
    had = [c[1] for c in (local, received) if c[0] == wall]
    return wall, (max(had) + 1 if had else 0), local[2]


def hlc_receive_col(local: Column, received: Column, now: Column) -> Column:
    """``hlc_receive`` of clock structs as a Column."""
    wall = F.greatest(local["wall"], received["wall"], now)
    had = F.greatest(*(F.when(c["wall"] == wall, c["logical"]) for c in (local, received)))
    return hlc(wall, F.coalesce(had + 1, F.lit(0)), local["peer"])
