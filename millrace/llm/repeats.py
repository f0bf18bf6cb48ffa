"""Removal of long repeated byte strings by suffix arrays of repeated contexts."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .shared import bitmap_of, cut, in_bitmap, spread_join, utf8

_B = 0x9E3779B97F4A7C15 | 1
_POS = 20
_BLOCK = (1 << _POS) - (1 << 12)


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """A mixed 64-bit hash of each k-byte gram, k a power of two, by doubling."""
    h = data.astype(np.uint64) + np.uint64(1)
    m, power = 1, _B
    while m < k:
        h = h[:-m] + h[m:] * np.uint64(power)
        power = power * power % (1 << 64)
        m *= 2
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def anchors(data: bytes, length: int = 200, k: int = 64) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(gram, at, first, last): every window of ``length`` bytes has one anchor, the
    least gram hash in it, of equals the leftmost; windows ``first`` to ``last``, in
    a row, have theirs at ``at``. Equal windows have their anchors at equal places.
    Works through blocks of a megabyte."""
    n = len(data)
    parts = []
    raw = np.frombuffer(data, np.uint8)
    width = length - k + 1
    for at in range(0, max(n - length + 1, 0), _BLOCK):
        h = gram_hashes(raw[at : at + _BLOCK + length - 1], k)
        key = (h >> np.uint64(_POS) << np.uint64(_POS)) | np.arange(len(h), dtype=np.uint64)
        m, size = key, 1
        while 2 * size <= width:
            m = np.minimum(m[:-size], m[size:])
            size *= 2
        if size < width:
            m = np.minimum(m[: len(m) - (width - size)], m[width - size :])
        place = (m & np.uint64((1 << _POS) - 1)).astype(np.int64)
        start = np.concatenate(([0], np.flatnonzero(place[1:] != place[:-1]) + 1))
        end = np.concatenate((start[1:], [len(place)])) - 1
        parts.append((h[place[start]], place[start] + at, start + at, end + at))
    if not parts:
        return np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3))
    gram, place, start, end = (np.concatenate(x) for x in zip(*parts))
    return gram, place, start, end


def _text_id(data: bytes) -> tuple[int, int]:
    h = xxhash.xxh3_128_intdigest(data)
    return (h >> 64) - (1 << 63), (h & ((1 << 64) - 1)) - (1 << 63)


def _signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x, np.uint64).view(np.int64)


def _contexts(data: bytes, length: int, k: int, bitmap: np.ndarray | None):
    """Of each anchor, with a bitmap only of those whose gram is in it: gram, context
    hash, first and last window, all as arrays."""
    gram, at, first, last = anchors(data, length, k)
    if bitmap is not None:
        use = in_bitmap(bitmap, gram)
        gram, first, last = gram[use], first[use], last[use]
    view = memoryview(data)
    ctx = np.array([xxhash.xxh3_64_intdigest(view[a : b + length]) for a, b in zip(first.tolist(), last.tolist())], np.uint64)
    return gram, ctx, first, last


_OCCUR = "gram long, ctx long, t1 long, t2 long, first int, last int"


def _occurrences(length: int, k: int, shared=None):
    """mapInArrow from text: an anchor's hashes and place, for each anchor, with
    ``shared`` for those whose gram is in that bitmap. The same text is given at most
    twice by a task, which is enough to tell it is repeated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[int, int], int] = {}
        bitmap = shared.value if shared else None
        for b in batches:
            cols: list[list[np.ndarray]] = [[] for _ in range(6)]
            for t in b.column(0):
                data = t.as_py()
                if len(data) < length:
                    continue
                tid = _text_id(data)
                if len(seen) > 500_000:
                    seen.clear()
                seen[tid] = n = seen.get(tid, 0) + 1
                if n > 2:
                    continue
                gram, ctx, first, last = _contexts(data, length, k, bitmap)
                for c, v in zip(cols, (_signed(gram), _signed(ctx), np.full(len(gram), tid[0]), np.full(len(gram), tid[1]), first.astype(np.int32), last.astype(np.int32))):
                    c.append(v)
            if cols[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], names=["gram", "ctx", "t1", "t2", "first", "last"])

    return run


def _flagged_contexts(length: int, k: int, shared):
    """mapInArrow from text: the bytes around each anchor whose gram is flagged, to
    the left (reversed) and to the right of the gram. A context once for a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        bitmap = shared.value
        for b in batches:
            cols: list[list] = [[] for _ in range(6)]
            for t in b.column(0):
                data = t.as_py()
                gram, at, first, last = anchors(data, length, k)
                for i in np.flatnonzero(in_bitmap(bitmap, gram)).tolist() if len(gram) else ():
                    g, p, f, e = int(gram[i]), int(at[i]), int(first[i]), int(last[i])
                    h = xxhash.xxh3_64_intdigest(data[f : e + length])
                    if (g, h) in seen:
                        continue
                    if len(seen) > 400_000:
                        seen.clear()
                    seen.add((g, h))
                    for c, v in zip(cols, (g, h, p - e, p - f, data[f:p][::-1], data[p + k : e + length])):
                        c.append(v)
            if cols[0]:
                hashes = [pa.array(_signed(np.array(c, np.uint64))) for c in cols[:2]]
                yield pa.RecordBatch.from_arrays([*hashes, pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int32()), pa.array(cols[4], pa.binary()), pa.array(cols[5], pa.binary())], names=["gram", "ctx", "lo", "hi", "left", "right"])

    return run


def _packed(s: bytes) -> list[int]:
    """Numbers that sort and compare as the string does: seven bytes and their count."""
    return [int.from_bytes(s[i : i + 7].ljust(7, b"\0"), "big") << 8 | min(7, len(s) - i) for i in range(0, len(s), 7)]


def sort_sides(owner: np.ndarray, sides: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, lcp, of): the distinct (owner, string) pairs in order by the linear
    grouping suffix sort, common leading bytes with the pair before (-1: another
    owner), and for each input its place in that order.

    All pairs stand in one sequence, each behind a symbol of its owner, seven bytes
    to a symbol; the suffixes that begin at owners' symbols are read off the array."""
    from .gsaca import suffix_array

    known: dict[tuple[int, bytes], int] = {}
    index = np.array([known.setdefault(x, len(known)) for x in zip(owner.tolist(), sides)], np.int64)
    pairs = list(known)
    text: list[int] = []
    at: list[int] = []
    for o, s in pairs:
        at.append(len(text))
        text.append((o + 1) << 64)
        text += _packed(s)
    rank = {v: i + 1 for i, v in enumerate(sorted(set(text)))}
    which = {p: i for i, p in enumerate(at)}
    order = [which[p] for p in suffix_array([rank[v] for v in text]) if p in which]
    lcp = np.full(len(order), -1, np.int64)
    for r in range(1, len(order)):
        (o, s), (q, t) = pairs[order[r - 1]], pairs[order[r]]
        if o == q:
            n = min(len(s), len(t))
            x = int.from_bytes(s[:n], "big") ^ int.from_bytes(t[:n], "big")
            lcp[r] = n - (x.bit_length() + 7) // 8
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return np.array(order), lcp, place[index]


def shared_windows(owner: np.ndarray, lo: np.ndarray, hi: np.ndarray, left: list[bytes], right: list[bytes], around: int) -> list[list[tuple[int, int]]]:
    """For each of some distinct contexts the ranges of a, within lo to hi, for which
    its window, a bytes to the left of the gram and around - a to the right, is also
    one of another context of the same owner.

    Where a common-prefix length in the sorted order drops under a number, a new
    class of strings that agree on that many bytes begins; windows are equal where
    both sides' classes are. Cost: around + 1 sorts of class numbers, no pairs."""
    _, lcp_l, at_l = sort_sides(owner, left)
    _, lcp_r, at_r = sort_sides(owner, right)
    m = len(left)
    ok = np.zeros((m, around + 1), bool)
    for a in range(int(lo.min()), int(hi.max()) + 1):
        use = np.flatnonzero((lo <= a) & (a <= hi))
        if len(use) < 2:
            continue
        x = np.cumsum(lcp_l < a)[at_l[use]]
        y = np.cumsum(lcp_r < around - a)[at_r[use]]
        key = x * (len(lcp_r) + 1) + y
        order = np.argsort(key, kind="stable")
        k = key[order]
        same = np.concatenate(([False], k[1:] == k[:-1]))
        dup = same | np.concatenate((same[1:], [False]))
        ok[use[order[dup]], a] = True
    out: list[list[tuple[int, int]]] = []
    for i in range(m):
        d = np.diff(np.concatenate(([0], ok[i].astype(np.int8), [0])))
        out.append(list(zip(np.flatnonzero(d > 0).tolist(), (np.flatnonzero(d < 0) - 1).tolist())))
    return out


def _hot_windows(length: int, k: int, shared):
    """mapInArrow from text: each window of each anchor whose gram is in the bitmap, as
    gram, context and window hash and its offset in the context. A context once for a
    task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        bitmap = shared.value
        for b in batches:
            for t in b.column(0):
                data = t.as_py()
                gram, _, first, last = anchors(data, length, k)
                view, cols = memoryview(data), [[], [], [], []]
                for i in np.flatnonzero(in_bitmap(bitmap, gram)).tolist() if len(gram) else ():
                    g, f, e = int(gram[i]), int(first[i]), int(last[i])
                    h = xxhash.xxh3_64_intdigest(view[f : e + length])
                    if (g, h) in seen:
                        continue
                    if len(seen) > 400_000:
                        seen.clear()
                    seen.add((g, h))
                    for c, v in zip(cols, ([g] * (e - f + 1), [h] * (e - f + 1), [xxhash.xxh3_64_intdigest(view[w : w + length]) for w in range(f, e + 1)], range(e - f + 1))):
                        c.extend(v)
                    if len(cols[0]) > 100_000:
                        yield _window_batch(cols)
                        cols = [[], [], [], []]
                if cols[0]:
                    yield _window_batch(cols)

    return run


def _window_batch(cols: list[list[int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*(pa.array(_signed(np.array(c, np.uint64))) for c in cols[:3]), pa.array(cols[3], pa.int32())], names=["gram", "ctx", "win", "off"])


def _hot_shared(texts: DataFrame, length: int, gram: int, hot: np.ndarray) -> DataFrame:
    """What ``_shared`` finds, for grams in the bitmap ``hot``, whose contexts are too many
    for one task: their windows are rows, counted by hash with map-side combining, so
    no gram is gathered anywhere."""
    spark = texts.sparkSession
    rows = cut(texts.mapInArrow(_hot_windows(length, gram, spark.sparkContext.broadcast(hot)), "gram long, ctx long, win long, off int"), "repeats-hot")
    found = cut(rows.groupBy("gram", "win").agg(F.count("*").alias("n"), (F.min("ctx") != F.max("ctx")).alias("multi")).where("multi").drop("multi"), "repeats-hot-windows")
    hits = spread_join(rows, found.select("gram", "win"), ["gram", "win"], found, rows.count())
    each = hits.groupBy("gram", "ctx").agg(F.array_sort(F.collect_set("off")).alias("o"))  # an offset is under ``length``
    runs = F.expr("explode(zip_with(filter(o, x -> not array_contains(o, x - 1)), filter(o, x -> not array_contains(o, x + 1)), (x, y) -> struct(x as from_, y as to_)))")
    return each.select("gram", "ctx", runs.alias("r")).select("gram", "ctx", "r.from_", "r.to_")


_SHARED = "gram long, ctx long, from_ int, to_ int"


def _shared(length: int, k: int, batch: int):
    """mapInArrow over contexts sorted by gram: of each context, the windows (offsets
    from its first) that another context of its gram has, too. Takes whole grams up
    to about ``batch`` contexts at a time."""

    def solve(rows: list[list]):
        gram, ctx = rows[0], rows[1]
        keep = [i for i in range(len(gram)) if not i or (gram[i], ctx[i]) != (gram[i - 1], ctx[i - 1])]
        owner = np.cumsum([0] + [gram[x] != gram[y] for x, y in zip(keep, keep[1:])])
        lo, hi = (np.array([rows[j][i] for i in keep], np.int64) for j in (2, 3))
        found = shared_windows(owner, lo, hi, [rows[4][i] for i in keep], [rows[5][i] for i in keep], length - k)
        out = [(gram[i], ctx[i], int(hi[n]) - b, int(hi[n]) - a) for n, i in enumerate(keep) for a, b in found[n]]
        if out:
            g, c, f, t = zip(*out)
            yield pa.RecordBatch.from_arrays([pa.array(g, pa.int64()), pa.array(c, pa.int64()), pa.array(f, pa.int32()), pa.array(t, pa.int32())], names=["gram", "ctx", "from_", "to_"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[list] = [[] for _ in range(6)]
        for b in batches:
            for r, c in zip(rows, b.columns):
                r += c.to_pylist()
            if len(rows[0]) >= batch and rows[0][0] != rows[0][-1]:
                n = len(rows[0])
                while rows[0][n - 1] == rows[0][-1]:
                    n -= 1
                yield from solve([r[:n] for r in rows])
                rows = [r[n:] for r in rows]
        if rows[0]:
            yield from solve(rows)

    return run


def _runs(spans: list[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return out


def _named(shared):
    """mapInArrow from (doc_id, text): identity, size and digest of each text, and
    whether its hash is flagged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t1, t2, size, sha = [], [], [], []
            for t in b.column(1):
                x = t.as_py()
                u, v = _text_id(x)
                t1.append(u), t2.append(v), size.append(len(x)), sha.append(hashlib.sha256(x).hexdigest())
            flag = in_bitmap(shared.value, np.array(t2, np.int64).view(np.uint64))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(t1, pa.int64()), pa.array(t2, pa.int64()), pa.array(size, pa.int64()), pa.array(sha, pa.string()), pa.array(flag, pa.bool_())], names=["doc_id", "t1", "t2", "n_bytes", "sha", "flag"])

    return run


def _flagged_texts(shared):
    """mapInArrow from (doc_id, text): each text whose hash is flagged, once for a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for b in batches:
            t1, t2, data = [], [], []
            for t in b.column(1):
                x = t.as_py()
                key = _text_id(x)
                if key not in seen and in_bitmap(shared.value, np.array(key[1:], np.int64).view(np.uint64))[0]:
                    if len(seen) > 500_000:
                        seen.clear()
                    seen.add(key), t1.append(key[0]), t2.append(key[1]), data.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(t1, pa.int64()), pa.array(t2, pa.int64()), pa.array(data, pa.binary())], names=["t1", "t2", "text"])

    return run


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
_KEPT = "t1 long, t2 long, n_removed long, n_spans long, kept_sha256 string"


def _removed(with_text: bool):
    """mapInArrow from (t1, t2, text, spans): what is left of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], [], []]
            for text, spans in zip(b.column(2), b.column(3).to_pylist()):
                runs = _runs([(s["lo"], s["hi"]) for s in spans or ()])
                data, at, parts = text.as_py(), 0, []
                for lo, hi in runs:
                    parts.append(data[at:lo])
                    at = hi
                kept = b"".join([*parts, data[at:]])
                for c, v in zip(out, (sum(hi - lo for lo, hi in runs), len(runs), hashlib.sha256(kept).hexdigest(), kept if runs else None)):
                    c.append(v)
            cols = [b.column(0), b.column(1), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(out[3], pa.binary())] if with_text else cols, names=[*(x.split()[0] for x in _KEPT.split(", ")), *["kept"] * with_text])

    return run


def repeated_spans(texts: DataFrame, length: int = 200, gram: int = 64, batch: int = 4000) -> DataFrame:
    """(t1, t2, spans): for each text (column text: binary) with repeats, by its
    128-bit identity, byte spans that together are all that is covered by strings of
    ``length`` bytes that start anywhere else, too.

    1. Every window of ``length`` bytes has an anchor that only its own bytes decide,
       so equal windows meet under their anchor's gram; where the whole context of an
       anchor is found twice, all its windows are.
    2. In groups with different contexts, suffix arrays (linear grouping) sort the
       sides of the contexts, and common prefixes show which windows are shared.
       Grams with over ``batch`` different contexts, such as at the edges of a very
       common passage, have their windows counted by hash instead, over all tasks.

    Grams are counted with map-side combining; a bitmap of those found twice keeps
    most unrepeated anchors where they are, an exact join removes the bitmap's errors.
    Anchors are joined to what is known of grams and contexts, so that a passage of
    very many documents is spread over tasks; contexts are moved once for a task."""
    spark = texts.sparkSession
    grams = texts.mapInArrow(_occurrences(length, gram), _OCCUR).groupBy("gram").agg(F.count("*").alias("n"), (F.min("ctx") != F.max("ctx")).alias("multi")).where("n > 1")
    grams = cut(grams, "repeats-grams")
    again = spark.sparkContext.broadcast(bitmap_of(grams, "gram"))
    near = cut(texts.mapInArrow(_occurrences(length, gram, again), _OCCUR), "repeats-near")
    occ = cut(spread_join(near, grams.select("gram", "multi"), ["gram"], grams.select("gram", "n"), near.count()), "repeats-found")
    whole = occ.where("not multi").select("t1", "t2", F.col("first").alias("lo"), (F.col("last") + length).alias("hi"))
    mixed = occ.where("multi").select("gram", "ctx", "t1", "t2", "first", "last")
    counts = cut(mixed.groupBy("gram", "ctx").agg(F.count("*").alias("n")), "repeats-contexts")
    # Either way is exact, so a gram that only shares its bit with a hot one may go that way.
    hot = bitmap_of(counts.groupBy("gram").agg(F.count("*").alias("n")).where(F.col("n") > batch), "gram", 26)
    flagged = spark.sparkContext.broadcast(bitmap_of(grams.where("multi"), "gram", 26) & ~hot)
    contexts = texts.mapInArrow(_flagged_contexts(length, gram, flagged), "gram long, ctx long, lo int, hi int, left binary, right binary")
    shared = contexts.repartition("gram").sortWithinPartitions("gram", "ctx").mapInArrow(_shared(length, gram, batch), _SHARED)
    if hot.any():
        shared = shared.union(_hot_shared(texts, length, gram, hot))
    full = counts.where("n > 1").select("gram", "ctx", F.lit(0).alias("from_"), F.lit(None).cast("int").alias("to_"))
    windows = cut(shared.join(full, ["gram", "ctx"], "left_anti").union(full), "repeats-windows")
    part = spread_join(mixed, windows, ["gram", "ctx"], counts, mixed.count())
    part = part.select("t1", "t2", (F.col("first") + F.col("from_")).alias("lo"), (F.coalesce(F.col("first") + F.col("to_"), F.col("last")) + length).alias("hi"))
    return whole.union(part).groupBy("t1", "t2").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200, gram: int = 64, with_text: bool = False, batch: int = 4000) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and
    with ``with_text`` kept (the remaining bytes, null where all remain).

    Null text: as empty. Texts under ``length`` bytes keep all. Null id: kept as
    null. Repeated rows: each other's repeats, so longer ones lose all. Very long texts:
    anchors are found a megabyte at a time. Empty table: no rows. Other columns are not
    read."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), utf8(text_col).alias("text"))
    spans = cut(repeated_spans(rows.select("text"), length, gram, batch), "repeats-spans")
    # Only texts with repeats move, each once for a task, however many rows have it; rows
    # move as names, those of a very common text dealt over many tasks.
    flags = spark.sparkContext.broadcast(bitmap_of(spans, "t2"))
    each = cut(rows.mapInArrow(_named(flags), "doc_id long, t1 long, t2 long, n_bytes long, sha string, flag boolean"), "repeats-rows")
    texts = rows.mapInArrow(_flagged_texts(flags), "t1 long, t2 long, text binary").join(spans, ["t1", "t2"], "left").select("t1", "t2", "text", "spans")
    extra = ["kept"] * with_text
    found = cut(texts.mapInArrow(_removed(with_text), _KEPT + (", kept binary" if with_text else "")).dropDuplicates(["t1", "t2"]), "repeats-kept")
    none = each.where("not flag").select("doc_id", "n_bytes", F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.col("sha").alias("kept_sha256"), *(F.lit(None).cast("binary").alias(x) for x in extra))
    some = each.where("flag")
    counts = cut(some.groupBy("t1", "t2").agg(F.count("*").alias("n")), "repeats-texts")
    done = spread_join(some.select("doc_id", "n_bytes", "t1", "t2"), found, ["t1", "t2"], counts, some.count())
    return none.union(done.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *extra))
