"""SimHash near-duplicate detection by a segment-popcount embedding."""

from __future__ import annotations

import math
import random
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .shared import bitmap_of, components, cut, in_bitmap, released, spread_join, utf8

LOW = 0x5555555555555555
_BITS = np.arange(64, dtype=np.uint64)


def fingerprint(text: bytes, shingle: int = 4, seed: int = 42, block: int = 1 << 16) -> int:
    """The unsigned 64-bit SimHash of a UTF-8 text: A-Z lower-cased, words split at
    ASCII white space, a bit set where over half of the shingles' XXH64 have it.
    Fewer words than a shingle: the whole sequence is one; no word: zero. Shingles
    are hashed a block at a time, so a long text needs no list of all hashes."""
    words = text.lower().split()
    if not words:
        return 0
    joined = memoryview(b" ".join(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle, len(words))
    n = len(words) - k + 1
    h64 = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for at in range(0, n, block):
        a, b = starts[at : min(at + block, n)].tolist(), ends[at + k - 1 : min(at + block, n) + k - 1].tolist()
        h = np.array([h64(joined[x:y], seed) for x, y in zip(a, b)], np.uint64)
        counts += np.unpackbits(h.view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return int(((counts * 2 > n).astype(np.uint64) << _BITS).sum(dtype=np.uint64))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): fp is the fingerprint's 64 bits as a signed long."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t.as_py()) for t in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), utf8(text_col).alias("text")).mapInArrow(run, "doc_id long, fp long")


def popcounts(fp: F.Column) -> F.Column:
    """The embedding: 32 counts (0 to 2) of set bits, one for each 2-bit segment,
    packed in a long of which segment i has bits 2i and 2i+1."""
    low, high = fp.bitwiseAND(F.lit(LOW)), F.shiftrightunsigned(fp, 1).bitwiseAND(F.lit(LOW))
    return low.bitwiseXOR(high).bitwiseOR(F.shiftleft(low.bitwiseAND(high), 1))


def _np_popcounts(fp: np.ndarray) -> np.ndarray:
    return fp - ((fp >> np.uint64(1)) & np.uint64(LOW))


def manhattan(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """L1 distance of packed counts. Fields 0 to 2 differ by 1 where their XOR is 01
    or 11, by 2 where it is 10. Never more than the fingerprints' Hamming distance."""
    z = a ^ b
    lo, hi = z & np.uint64(LOW), (z >> np.uint64(1)) & np.uint64(LOW)
    return np.bitwise_count(lo) + 2 * np.bitwise_count(hi & ~lo)


def band_masks(bands: int, distance: int) -> list[int]:
    """Masks over the packed counts, one for each way to leave ``distance`` of the
    ``bands`` bands of segments out. Two points within that Manhattan distance differ
    in no more bands than that, so they share a grid cell under one mask at least."""
    of = [0] * bands
    for seg in range(32):
        of[seg % bands] |= 3 << (2 * seg)
    return [sum(of[i] for i in keep) for keep in combinations(range(bands), bands - distance)]


def _bfs_forest(fp: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among distinct fingerprints: breadth first, each
    point compared once with the points not reached yet."""
    counts = _np_popcounts(fp)
    left = np.arange(len(fp))
    a, b = [], []
    queue: list[int] = []
    while len(left) or queue:
        if not queue:
            queue, left = [int(left[0])], left[1:]
            continue
        i = queue.pop()
        if not len(left):
            break
        near = np.flatnonzero(_l1(counts[left], counts[i]) <= distance)
        if len(near):
            ok = _hamming(fp[left[near]], fp[i]) <= distance
            found = left[near[ok]]
            a.append(np.full(len(found), i)), b.append(found)
            queue += found.tolist()
            left = np.delete(left, near[ok])
    none = np.zeros(0, np.int64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def _nearest_forest(fp: np.ndarray, size: np.ndarray, distance: int, ratio: float) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the pairs within ``distance`` whose set sizes allow the
    similarity ``ratio``, of the shortest links: each point is tied to the nearest of
    those before it, which is the likeliest to be verified."""
    left = np.arange(len(fp))
    best, by = np.full(len(fp), 1 << 20), np.full(len(fp), -1)
    a, b = [], []
    while len(left):
        k = int(np.argmin(best))
        j = int(left[k])
        if best[k] <= distance:
            a.append(int(by[k])), b.append(j)
        left[k], best[k], by[k] = left[-1], best[-1], by[-1]
        left, best, by = left[:-1], best[:-1], by[:-1]
        far = _hamming(fp[left], fp[j])
        nearer = (far < best) & (np.minimum(size[left], size[j]) >= ratio * np.maximum(size[left], size[j]))
        best[nearer], by[nearer] = far[nearer], j
    return np.array(a, np.int64), np.array(b, np.int64)


def _l1(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return manhattan(a, b).sum(-1, dtype=np.int64)


def _hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(-1, dtype=np.int64)


class _Cells:
    """mapInArrow over rows sorted by cell: links (a, b) among a cell's points. Cells of
    up to ``small`` points are taken in one vectorized sweep over the whole batch, larger
    ones by a forest; a cell of more than ``block`` points leaves as blocks of that many,
    whose pairs other tasks compare. Memory: one batch and one block.

    Rows are (mask, cell, words of the fingerprint), the point being its only word, or
    with a ``ratio`` (mask, cell, point, size of its set, words). With a ratio, links are
    yet to be verified, and a forest may have chosen links that fail: its cells are told
    (a: the mask, b: the cell, k: -1), for ``_OpenCells``."""

    SCHEMA = "a long, b long, cell binary, k int, block binary"

    def __init__(self, distance: int, small: int, block: int, ratio: float | None = None):
        self.distance, self.small, self.block, self.ratio = distance, small, block, ratio

    def _points(self, data: np.ndarray):
        """Names, fingerprints and set sizes of rows of numbers."""
        if self.ratio is None:
            return data[:, 0], data.view(np.uint64), None
        return data[:, 0], np.ascontiguousarray(data[:, 2:]).view(np.uint64), data[:, 1]

    def _forest(self, fp: np.ndarray, size: np.ndarray | None):
        return _bfs_forest(fp, self.distance) if size is None else _nearest_forest(fp, size, self.distance, self.ratio)

    def _whole(self, key: np.ndarray, data: np.ndarray):
        """Links of complete cells."""
        start = np.concatenate(([0], np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1))
        length = np.diff(np.concatenate((start, [len(key)])))
        many = np.repeat(length, length)
        place = np.arange(len(key)) - np.repeat(start, length)
        name, fp, size = self._points(data)
        counts = _np_popcounts(fp)
        pairs = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        at = np.flatnonzero(many <= self.small)
        for d in range(1, self.small):
            at = at[place[at] + d < many[at]]
            if not len(at):
                break
            i = at[_l1(counts[at], counts[at + d]) <= self.distance]
            i = i[_hamming(fp[i], fp[i + d]) <= self.distance]
            if size is not None:
                i = i[np.minimum(size[i], size[i + d]) >= self.ratio * np.maximum(size[i], size[i + d])]
            if len(i):
                pairs.append((i, i + d))
        i, j = (np.concatenate(x) for x in zip(*pairs))
        cell_of = np.repeat(np.arange(len(start)), length)
        crowded = np.bincount(cell_of[i], minlength=len(start)) > 4 * length
        keep = ~crowded[cell_of[i]]
        yield self._links(name[i[keep]], name[j[keep]])
        dense = np.flatnonzero(crowded | (length > self.small))
        for c in dense.tolist():
            part = slice(start[c], start[c] + length[c])
            x, y = self._forest(fp[part], None if size is None else size[part])
            yield self._links(name[part][x], name[part][y])
        if size is not None and len(dense):
            yield self._links(*key[start[dense]].T, -1)

    @staticmethod
    def _links(a: np.ndarray, b: np.ndarray, k: int | None = None) -> pa.RecordBatch:
        n = len(a)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.nulls(n, pa.binary()), pa.array([k] * n, pa.int32()), pa.nulls(n, pa.binary())], names=["a", "b", "cell", "k", "block"])

    @staticmethod
    def _block(key: np.ndarray, k: int, data: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(key[:1]), pa.array(key[1:]), pa.array([key.tobytes()], pa.binary()), pa.array([k], pa.int32()), pa.array([np.ascontiguousarray(data).tobytes()], pa.binary())], names=["a", "b", "cell", "k", "block"])

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, data, hot, k = None, None, None, 0
        for b in batches:
            new = np.stack([c.to_numpy().astype(np.int64) for c in b.columns], 1)
            key = new[:, :2] if key is None else np.concatenate((key, new[:, :2]))
            data = new[:, 2:] if data is None else np.concatenate((data, new[:, 2:]))
            if not len(key):
                continue
            if hot is not None:  # goes on with a cell that is given out in blocks
                other = np.flatnonzero((key != hot).any(1))
                if len(other):
                    end = int(other[0])
                    yield self._block(hot, k, data[:end])
                    key, data, hot = key[end:], data[end:], None
            other = np.flatnonzero((key != key[-1]).any(1))
            last = int(other[-1]) + 1 if len(other) else 0
            if last:
                yield from self._whole(key[:last], np.ascontiguousarray(data[:last]))
                key, data = key[last:], data[last:]
            while len(key) > self.block:
                if hot is None:
                    hot, k = key[0].copy(), 0
                yield self._block(hot, k, data[: self.block])
                key, data, k = key[self.block :], data[self.block :], k + 1
        if key is not None and len(key):
            if hot is not None:
                yield self._block(hot, k, data)
            else:
                yield from self._whole(key, np.ascontiguousarray(data))

    def pair(self, words: int):
        """mapInArrow over two blocks of one cell each row: the links among them."""

        @released
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for blocks in b.column(0).to_pylist():
                    for x, y in self._met(np.frombuffer(b"".join(blocks), np.int64).reshape(-1, words)):
                        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], names=["a", "b"])

        return run

    def _met(self, data: np.ndarray):
        """Links among the points of two blocks."""
        name, fp, size = self._points(data)
        x, y = self._forest(fp, size)
        yield name[x], name[y]


class _OpenCells(_Cells):
    """Cells once more, for links that a forest left out: rows (mask, cell, point, size
    of its set, its component so far, words of the fingerprint, words of the sketch). Each
    point is tied to the ``most`` nearest points of other components whose sketch allows
    the similarity ``ratio`` (None: to all); cells where some had more are told."""

    def __init__(self, distance: int, block: int, ratio: float, most: int | None):
        super().__init__(distance, 0, block, ratio)
        self.most = most

    def _open(self, data: np.ndarray):
        """(a, b, whether there are more) for points with links, some at a time."""
        name, size, label = data[:, 0], data[:, 1], data[:, 2]
        words = np.ascontiguousarray(data[:, 3:]).view(np.uint64)
        fp, sketch = words[:, :WORDS], words[:, WORDS:]
        a, b, held = [], [], 0
        for i in range(len(name)):
            j = np.flatnonzero((label != label[i]) & (_hamming(fp, fp[i]) <= self.distance))
            j = j[np.minimum(size[j], size[i]) >= self.ratio * np.maximum(size[j], size[i])]
            if not len(j):
                continue
            both = size[j] + size[i]
            apart = _hamming(sketch[j], sketch[i])
            ok = apart <= both * (1 - self.ratio) / (1 + self.ratio) + 1e-6
            j, apart = j[ok], apart[ok] / both[ok]
            more = self.most is not None and len(j) > self.most
            if more:
                j = j[np.argpartition(apart, self.most)[: self.most]]
            a.append(np.full(len(j), name[i])), b.append(name[j])
            held += len(j)
            if more or held > 100_000:
                yield np.concatenate(a), np.concatenate(b), more
                a, b, held = [], [], 0
        if a:
            yield np.concatenate(a), np.concatenate(b), False

    def _whole(self, key: np.ndarray, data: np.ndarray):
        start = np.concatenate(([0], np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1, [len(key)]))
        for c, d in zip(start[:-1].tolist(), start[1:].tolist()):
            some = False
            for x, y, more in self._open(data[c:d]):
                some |= more
                yield self._links(x, y)
            if some:
                yield self._links(*key[c : c + 1].T, -1)

    def _met(self, data: np.ndarray):
        return ((x, y) for x, y, _ in self._open(data))


def _compared(cells: DataFrame, find: _Cells) -> tuple[DataFrame, DataFrame]:
    """(a, b) from rows of cells, each pair once, and the cells (mask, cell) that may have
    other links. Two blocks of a dense cell meet in a task of their own, each block dealt
    once for every other block of its cell."""
    words = len(cells.columns) - 2
    dealt = cells.repartition("mask", "cell").sortWithinPartitions("mask", "cell", cells.columns[2])
    found = cut(dealt.mapInArrow(released(find.__call__), _Cells.SCHEMA), "simhash-cells")
    blocks = found.where("block is not null").select("cell", "k", "block")
    number = blocks.groupBy("cell").agg((F.max("k") + 1).alias("n"))
    other = F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("o")
    met = blocks.join(number, "cell").select("cell", "k", "block", other).where("o <> k").groupBy("cell", F.least("k", "o").alias("i"), F.greatest("k", "o").alias("j")).agg(F.collect_list("block").alias("blocks"))
    more = met.select("blocks").mapInArrow(find.pair(words), "a long, b long")
    both = found.where("k is null").select("a", "b").union(more)
    links = both.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return links, found.where("k is not null").select(F.col("a").alias("mask").cast("int"), F.col("b").alias("cell")).distinct()


def bands_for(points: int) -> int:
    """So many bands that a cell has tens of unrelated points, not thousands."""
    return 7 if points < 1 << 24 else 8 if points < 1 << 29 else 10


def links(fps: DataFrame, distance: int = 4, bands: int = 7, small: int = 24, block: int = 8192) -> DataFrame:
    """(a, b): links among the distinct fingerprints ``fps.fp`` that connect exactly
    those within ``distance`` bits, directly or over others.

    A grid range-join: each point goes to one cell under each band mask (35 with the
    defaults), cells are compared under Manhattan distance of the counts, what is
    left is verified on all 64 bits. ``bands`` trades cells for candidates and does
    not change the result; more rows call for more bands (``bands_for``). Copies are one
    point, and a cell gives a forest, so dense groups give no square number of links."""
    masks = band_masks(bands, distance)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    at = F.explode(F.array(*(F.struct(F.lit(i).alias("mask"), popcounts(F.col("fp")).bitwiseAND(F.lit(m)).alias("cell")) for i, m in enumerate(signed))))
    cells = fps.select("fp", at.alias("x")).select("x.mask", "x.cell", "fp")
    return _compared(cells, _Cells(distance, small, block))[0]


def _classes(rows: DataFrame, groups: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """``rows`` with component_id, the smallest doc_id of those reachable over the links
    ``found``, and root, the name of the component. ``groups`` (written): key, least, n
    for each distinct key. Keys and components of very many rows are dealt over tasks."""
    total = groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count("*").alias("keys")).first()
    named = cut(groups.join(components(found).withColumnRenamed("node", "_node"), F.col(key) == F.col("_node"), "left").select(key, "least", F.coalesce("root", key).alias("root")), "simhash-roots")
    least = cut(named.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n")), "simhash-least")
    named = spread_join(named.select(key, "root"), least.select("root", "component_id"), ["root"], least.select("root", "n"), total["keys"])
    return spread_join(rows, cut(named, "simhash-named"), [key], groups.select(key, "n"), total["rows"])


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = 4, bands: int | None = None) -> DataFrame:
    """One row per input row: doc_id, fp (signed), component_id, the smallest doc_id
    reachable over fingerprints at ``distance`` or fewer differing bits, component_fp,
    a fingerprint that names the component.

    Null text: as empty; texts without a word have fingerprint zero and are linked
    like any other. Null id: the row takes part, but its id is nobody's component_id
    unless all ids of the component are null. Repeated rows: one result each. Very long
    texts: hashed in blocks. Empty table: no rows. Other columns are not read."""
    fps = cut(fingerprints(docs, id_col, text_col), "simhash-fp")
    groups = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "simhash-groups")
    found = links(groups.select("fp"), distance, bands or bands_for(groups.count()))
    return _classes(fps, groups, found, "fp").select("doc_id", "fp", "component_id", F.col("root").alias("component_fp"))


# -- documents of similar shingle sets ------------------------------------------------
WORDS = 2
SKETCH = 16
#: So many links a point are tried in the first rounds over cells that a forest left open.
MOST = (8, 128)


def shingle_set(text: bytes, shingle: int = 5, with_bits: bool = True) -> tuple[int, np.ndarray, np.ndarray]:
    """(name, set, fingerprint) of a UTF-8 text: a 64-bit hash of its set, the sorted
    hashes of its distinct word shingles (A-Z lower-cased; fewer words: the whole
    sequence; none: empty), and its SimHash of 128 bits, if asked for."""
    words = text.lower().split()
    if not words:
        return 0, np.zeros(0, np.int64), np.zeros(WORDS, np.uint64)
    joined = memoryview(b" ".join(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle, len(words))
    digest = xxhash.xxh3_128_digest
    h = np.frombuffer(b"".join([digest(joined[x:y]) for x, y in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist())]), np.uint64).reshape(-1, WORDS)
    own, at = np.unique(h[:, 0].view(np.int64), return_index=True)
    h = np.ascontiguousarray(h[at]) if with_bits else h[:0]
    counts = np.zeros(64 * WORDS, np.int64)
    for i in range(0, len(h), 1 << 14):
        counts += np.unpackbits(h[i : i + (1 << 14)].view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    fp = np.packbits(counts * 2 > len(h), bitorder="little").view(np.uint64)
    return xxhash.xxh3_64_intdigest(own.tobytes()) - (1 << 63), own, fp


def _sets(docs: DataFrame, shingle: int, shared) -> DataFrame:
    """(node, set) of the texts whose set's name is in the bitmap ``shared``, each once."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            names, sets = [], []
            for t in b.column(0):
                name, own, _ = shingle_set(t.as_py(), shingle, False)
                if name not in seen and in_bitmap(shared.value, np.array([name]).view(np.uint64))[0]:
                    if len(seen) > 500_000:
                        seen.clear()
                    seen.add(name), names.append(name), sets.append(own)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["node", "set"])

    return docs.select("text").mapInArrow(run, "node long, set array<long>").groupBy("node").agg(F.first("set").alias("set"))


def _sketches(sets: DataFrame) -> DataFrame:
    """(node, s0, s1, ...): for each of 1,024 classes of hashes whether the set has an odd
    number of them. Two sketches differ in no more bits than their sets do in elements."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            odd = np.zeros((b.num_rows, 64 * SKETCH), np.uint8)
            for i, own in enumerate(b.column(1)):
                odd[i] = np.bincount(own.values.to_numpy() & (64 * SKETCH - 1), minlength=64 * SKETCH) & 1
            bits = np.packbits(odd, axis=1).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(bits[:, i].copy()) for i in range(SKETCH))], names=["node", *names])

    names = [f"s{i}" for i in range(SKETCH)]
    return sets.select("node", "set").mapInArrow(run, ", ".join(["node long", *(f"{n} long" for n in names)]))


def grid_for(points: int, similarity: float, recall: float, full: float = 12.0) -> tuple[int, int, int]:
    """(segments a mask, masks, distance) for shingle sets of ``similarity``.

    A SimHash bit of two sets differs with probability q, an angle's share; a segment's
    counts agree with (1-q)^2 + q^2 / 2, of unrelated texts with 3/8. As many segments
    as leave about ``full`` unrelated points beside one in its cell; as many masks as
    find a pair at the threshold with probability ``recall``, a more similar one more
    surely. The distance lies three standard deviations above such a pair's."""
    q = math.acos(2 * similarity / (1 + similarity)) / math.pi
    same = (1 - q) ** 2 + q * q / 2
    kept = min(max(math.ceil(math.log(max(points, 1) / full) / math.log(8 / 3)), 4), 32 * WORDS)
    bits = 64 * WORDS
    return kept, math.ceil(math.log(1 - recall) / math.log(1 - same**kept)), round(bits * q + 3 * math.sqrt(bits * q * (1 - q)))


def similar_sets(docs: DataFrame, nodes: DataFrame, shingle: int, similarity: float, recall: float, small: int, block: int) -> DataFrame:
    """(a, b): pairs of ``nodes`` (node, size, f0, f1) of a Jaccard similarity of
    ``similarity`` or more, enough of those found to connect what they connect.

    The same grid with masks drawn at random over the segments of 128 bits; what the
    cells leave is verified on the shingle sets themselves, which are made again from
    the texts for candidates only. Exact against false links; ``recall`` is the share
    of pairs at the threshold that a mask is to bring together.

    A crowded cell gives a forest first. Where links of it fail, points of the cell that
    are not connected yet are tried with those of other components, the likeliest first
    and at last all of them, so that no pair of a cell is left out for a worse one."""
    kept, masks, distance = grid_for(nodes.count(), similarity, recall)
    rng = random.Random(5)
    drawn = []
    for i in range(masks):
        full = sum(3 << 2 * s for s in rng.sample(range(32 * WORDS), kept))
        drawn.append((i, *((full >> 64 * w & (1 << 64) - 1) - ((full >> 64 * w + 63 & 1) << 64) for w in range(WORDS))))
    spark = docs.sparkSession
    grid = F.explode(F.array(*(F.struct(F.lit(i).alias("mask"), F.lit(x).alias("m0"), F.lit(y).alias("m1")) for i, x, y in drawn))).alias("g")
    counted = nodes.where("size > 0").select("node", "size", "f0", "f1", popcounts(F.col("f0")).alias("p0"), popcounts(F.col("f1")).alias("p1"), grid)
    cells = counted.select(F.col("g.mask").alias("mask"), F.xxhash64(F.col("p0").bitwiseAND(F.col("g.m0")), F.col("p1").bitwiseAND(F.col("g.m1"))).alias("cell"), "node", "size", "f0", "f1")
    first, dense = _compared(cells, _Cells(distance, small, block, similarity))
    pairs = cut(first, "similar-pairs")
    ends = cut(pairs.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n")), "similar-ends")
    sets = cut(_sets(docs, shingle, spark.sparkContext.broadcast(bitmap_of(ends, "node"))).join(ends.select("node"), "node", "left_semi"), "similar-sets")
    links = cut(_verified(pairs, sets, similarity), "similar-links")
    for most in (*MOST, None):
        dense = cut(dense, "similar-dense")
        if dense.isEmpty():
            break
        # A point that a forest tied to none has no candidate; the others have sets.
        named = ends.select("node").join(components(links), "node", "left").select("node", F.coalesce("root", "node").alias("label"))
        again = cut(cells.join(dense, ["mask", "cell"]).join(named, "node"), "similar-again")
        parted = again.groupBy("mask", "cell").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("mask", "cell")
        rows = again.join(parted, ["mask", "cell"]).join(_sketches(sets.join(again.select("node").distinct(), "node", "left_semi")), "node")
        more, dense = _compared(rows.select("mask", "cell", "node", "size", "label", "f0", "f1", *(f"s{i}" for i in range(SKETCH))), _OpenCells(distance, block, similarity, most))
        links = links.union(cut(_verified(cut(more, "similar-pairs"), sets, similarity), "similar-links"))
    return links


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of ``pairs`` (a, b; written) whose sets are of ``similarity`` or more."""
    total = pairs.count()
    left = spread_join(pairs, sets.select(F.col("node").alias("a"), F.col("set").alias("x")), ["a"], pairs.groupBy("a").agg(F.count("*").alias("n")), total)
    left = cut(left, "similar-left")
    both = spread_join(left, sets.select(F.col("node").alias("b"), F.col("set").alias("y")), ["b"], pairs.groupBy("b").agg(F.count("*").alias("n")), total)
    common = F.size(F.array_intersect("x", "y"))
    return both.select("a", "b", common.alias("c"), (F.size("x") + F.size("y")).alias("s")).where(F.col("c") >= similarity * (F.col("s") - F.col("c")) - 1e-9).select("a", "b")


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, recall: float = 0.95, carry: tuple[str, ...] = (), small: int = 512, block: int = 8192) -> DataFrame:
    """One row per input row: doc_id, node (the name of its shingle set), component_id,
    the smallest doc_id reachable over sets of ``similarity`` or more, component, the
    name of that component, and the columns ``carry``.

    Null text: as empty; texts without a word are one set. Null id: the row takes part,
    but its id is nobody's component_id unless all ids of the component are null. Ties:
    a similarity at the threshold links. Repeated rows: one result each. Very long texts:
    eight bytes a shingle while a text is looked at. Empty table: no rows. Other columns
    are not read. Names of sets are 64-bit hashes."""
    carried = [f"_carried_{i}" for i in range(len(carry))]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), utf8(text_col).alias("text"), *(F.col(c).alias(x) for c, x in zip(carry, carried)))
    names = ["doc_id", "node", "size", "f0", "f1", *carried]

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node, size, fps = [], [], []
            for t in b.column(1):
                name, own, fp = shingle_set(t.as_py(), shingle)
                node.append(name), size.append(len(own)), fps.append(fp.view(np.int64))
            f = np.stack(fps) if fps else np.zeros((0, WORDS), np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(node, pa.int64()), pa.array(size, pa.int64()), pa.array(f[:, 0].copy()), pa.array(f[:, 1].copy()), *b.columns[2:]], names=names)

    schema = ", ".join(["doc_id long, node long, size long, f0 long, f1 long", *(f"{c} {rows.schema[c].dataType.simpleString()}" for c in carried)])
    own = cut(rows.mapInArrow(run, schema), "similar-rows")
    groups = cut(own.groupBy("node", "size", "f0", "f1").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "similar-groups")
    found = cut(similar_sets(rows, groups.select("node", "size", "f0", "f1"), shingle, similarity, recall, small, block), "similar-links")
    return _classes(own, groups, found, "node").select("doc_id", "node", "component_id", F.col("root").alias("component"), *(F.col(x).alias(c) for c, x in zip(carry, carried)))
