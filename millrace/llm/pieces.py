"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies."""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, functions as F

from .shared import released

MARK = "▁"
_BYTES = re.compile("[\udc00-\udcff]+")
_loaded: dict[str, PieceCoder] = {}


class Units(dict):
    """Unit to its ids, comma-joined; a missing unit is coded when asked for."""

    def __init__(self, agenda):
        self.agenda, self.fresh = agenda, []

    def __missing__(self, unit: str) -> str:
        ids = self.agenda(unit)
        self[unit] = out = ",".join(map(str, ids))
        self.fresh.append((unit, ids))
        return out


class Words(dict):
    """What stands between two spaces to its ids, its units' ids joined."""

    def __init__(self, unit: re.Pattern, units: Units):
        self.find, self.ids = unit.findall, units.__getitem__

    def __missing__(self, word: str) -> str:
        self[word] = out = ",".join(map(self.ids, self.find(MARK + word)))
        return out


class PieceCoder:
    """Encodes and decodes as the sentencepiece library does for a BPE model with
    identity normalization, a dummy prefix, kept white space and byte fallback.

    A text falls into units that no merge can cross: a run of marks (spaces) with the
    letters or other characters after it. That no piece crosses a unit's end is
    verified when the model is loaded. Units are coded by the agenda and remembered;
    the memory is bounded, and emptied when full and at the end of each task."""

    def __init__(self, path: str, remember: int = 300_000):
        self.sp = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.remember = remember
        self.pieces: dict[str, int] = {}
        self.byte_id: dict[int, int] = {}
        self.text_of: list[str | int] = []
        for i in range(sp.get_piece_size()):
            p = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_id[int(p[3:5], 16)] = i
                self.text_of.append(int(p[3:5], 16))
            elif sp.is_control(i) or sp.is_unknown(i):
                self.text_of.append("" if sp.is_control(i) else " ⁇ ")
            else:
                self.pieces[p] = i
                self.text_of.append(p.replace(MARK, " "))
        self.score = {p: sp.get_score(i) for p, i in self.pieces.items()}
        # By an id in decimal: its text; a byte is a lone surrogate until its run is complete.
        self.shown = {str(i): chr(0xDC00 + t) if isinstance(t, int) else t for i, t in enumerate(self.text_of)}
        numeric = "\u00b2\u00b3\u00b9\u00bc-\u00be\u2070-\u209f"  # not letters, though Python's \\w has them and \\d has not
        self.unit = re.compile(rf"{MARK}*[^\W\d_{numeric}]+|{MARK}*\d|{MARK}*(?:[^\w{MARK}\n]|[_{numeric}])+|{MARK}+|\n")
        crossing = [p for p in self.pieces if len(self.unit.findall(p)) > 1]
        if crossing or len(self.byte_id) != 256 or sp.encode(" ｆ", out_type=str)[0] != MARK * 2 or sp.encode("ｆ") == sp.encode("f"):
            raise ValueError(f"{path}: only merge-type models with identity normalization, a dummy prefix and byte fallback, and without pieces such as {crossing[:3]}, are supported")
        self.units = Units(self.agenda)
        self.words = Words(self.unit, self.units)

    def agenda(self, text: str) -> list[int]:
        """Ids of a normalized unit. Adjacent symbols whose join is a piece are on the
        agenda with that piece's score; the best, of equals the leftmost, is merged,
        and what it now forms with its neighbours joins the agenda. A list serves
        short units, a heap long ones."""
        sym = list(text)
        if len(sym) > 40:
            sym = self._long(sym)
        elif len(sym) > 1:
            score, none = self.score.get, -1e30
            waiting = [score(x + y, none) for x, y in zip(sym, sym[1:])]
            while waiting and (best := max(waiting)) > none:
                i = waiting.index(best)
                sym[i] += sym.pop(i + 1)
                del waiting[i]
                if i:
                    waiting[i - 1] = score(sym[i - 1] + sym[i], none)
                if i < len(waiting):
                    waiting[i] = score(sym[i] + sym[i + 1], none)
        ids: list[int] = []
        for s in sym:
            if (k := self.pieces.get(s)) is not None:
                ids.append(k)
            else:
                ids += [self.byte_id[b] for b in s.encode()]
        return ids

    def _long(self, sym: list[str]) -> list[str]:
        """The same by a heap: n log n for a unit of n characters. Entries of symbols
        that have merged since are stale."""
        n = len(sym)
        prev, nxt = list(range(-1, n - 1)), [*range(1, n), -1]
        heap: list[tuple[float, int, int, str]] = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j >= 0 and (s := self.score.get(p := sym[i] + sym[j])) is not None:
                heapq.heappush(heap, (-s, i, j, p))

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            _, i, j, p = heapq.heappop(heap)
            if nxt[i] != j or not sym[i] or not sym[j] or sym[i] + sym[j] != p:
                continue
            sym[i], sym[j] = p, ""
            nxt[i] = k = nxt[j]
            if k >= 0:
                prev[k] = i
            offer(prev[i], i), offer(i, k)
        return [s for s in sym if s]

    def decode(self, ids: str) -> str:
        """The text of comma-joined ids, the dummy prefix's space still in front: pieces
        with spaces for marks, runs of byte ids as the UTF-8 they are."""
        if not ids:
            return ""
        text = "".join(map(self.shown.__getitem__, ids.split(",")))
        return _BYTES.sub(lambda m: bytes(ord(c) - 0xDC00 for c in m[0]).decode("utf-8", "replace"), text)

    def check(self) -> None:
        """Compare what was coded since the last check with the library, in one batch
        call."""
        fresh, self.units.fresh = self.units.fresh, []
        lead = self.agenda(MARK) + self.agenda("\n")
        marked = [u[0] == MARK and len(u) > 1 for u, _ in fresh]
        theirs = self.sp.encode([u[1:].replace(MARK, " ") if m else "\n" + u.replace(MARK, " ") for (u, _), m in zip(fresh, marked)], num_threads=1)
        for (u, own), m, ids in zip(fresh, marked, theirs):
            if ids != (own if m else lead + own):
                raise AssertionError(f"the agenda and the library differ on {u[:80]!r}")

    def forget(self) -> None:
        """Empty the memory, as a worker outlives the stage."""
        self.units.clear()
        self.units.fresh.clear()
        self.words.clear()

    def coded(self, texts: list[str]) -> list[tuple[str, str]]:
        """For each text its ids, comma-joined, and the text that those ids decode to."""
        if len(self.units) > self.remember:
            self.units.clear()
        if len(self.words) > self.remember:
            self.words.clear()
        ids = self.words.__getitem__
        out = []
        for t in texts:
            if not t:
                coded = ""
            elif "  " in t or MARK in t or t[0] == " " or t[-1] == " ":  # a mark may join with the next
                coded = ",".join(map(self.units.__getitem__, self.unit.findall(MARK + t.replace(" ", MARK))))
            else:
                coded = ",".join(map(ids, t.split(" ")))
            out.append((coded, self.decode(coded)[1:]))
        self.check()
        return out

    def encode(self, text: str) -> list[int]:
        return [int(i) for i in self.coded([text])[0][0].split(",") if i]


def coder(path: str) -> PieceCoder:
    """The coder of a model file, one for each Python worker."""
    if path not in _loaded:
        _loaded[path] = PieceCoder(path)
    return _loaded[path]


SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode_decode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, slice_chars: int = 4_000_000) -> DataFrame:
    """One row per input row: the number of ids, the digests of the ids and of the
    decoded text, and with ``with_ids`` also ids and decoded themselves.

    Map only. Every distinct unit of a batch is checked against the library when
    first coded, and one whole text a batch besides. The decoded text of every document
    is made from its ids. A batch is taken in slices of
    ``slice_chars`` characters (one longer text is a slice of its own). Equal scores:
    the leftmost pair is merged. Null text: as empty (no ids). Null id: kept as null.
    Repeated rows: one result each. Empty table: no rows. Other columns are not read. ``model`` is a path on every host."""
    schema = SCHEMA + (", ids array<int>, decoded string" if with_ids else "")

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(model)
        for b in batches:
            at = 0
            sizes = [len(x.as_buffer()) if x.is_valid else 0 for x in b.column(1)]
            while at < b.num_rows:
                end, total = at + 1, sizes[at]
                while end < b.num_rows and total + sizes[end] <= slice_chars:
                    total += sizes[end]
                    end += 1
                part = b.slice(at, end - at)
                texts = [t or "" for t in part.column(1).to_pylist()]
                out = [[], [], [], [], []]
                for k, (ids, decoded) in enumerate(c.coded(texts)):
                    out[0].append(ids.count(",") + 1 if ids else 0)
                    out[1].append(hashlib.sha256(ids.encode()).hexdigest())
                    out[2].append(hashlib.sha256(decoded.encode()).hexdigest())
                    if with_ids or k == at == 0 and sizes[0] < 20_000:
                        listed = [int(i) for i in ids.split(",") if i]
                    if with_ids:
                        out[3].append(listed)
                        out[4].append(decoded)
                    if k == at == 0 and sizes[0] < 20_000 and (c.sp.encode(texts[0]) != listed or c.sp.decode(listed) != decoded):
                        raise AssertionError("the units' ids and the library's differ over a whole text")
                cols = [part.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.string())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    cols += [pa.array(out[3], pa.list_(pa.int32())), pa.array(out[4], pa.string())]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(cols, names=names)
                at = end
        c.forget()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)
