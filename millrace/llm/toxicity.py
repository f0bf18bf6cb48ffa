"""Toxicity by a factorization machine over hashed terms."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .shared import cut, released

#: At most so many labelled documents are used for the fit, so many megabytes of their
#: hashed terms, and so many terms.
FIT_ROWS = 12_000
FIT_MB = 256
FIT_TERMS = 200_000
THRESHOLD = 0.3
_WORD = re.compile(r"[^\W_]+")


def term_hash(term: str) -> int:
    """A term's 26-bit hash."""
    return zlib.crc32(term.encode()) & ((1 << 26) - 1)


def terms_of(word: str) -> tuple[int, ...]:
    """Hashed terms of a lower-cased word: the word, and for longer words the first
    four and five letters, as stems of inflected words."""
    out = (term_hash("w" + word),)
    if len(word) > 5:
        return (*out, term_hash("p" + word[:4]), term_hash("p" + word[:5]))
    return (*out, term_hash("p" + word[:4])) if len(word) > 4 else out


def text_terms(text: str, known: dict[str, tuple[int, ...]]) -> list[int]:
    """The distinct hashed terms of a whole text, sorted."""
    if len(known) > 400_000:
        known.clear()
    found: set[int] = set()
    for w in set(_WORD.findall(text.lower())):
        t = known.get(w)
        if t is None:
            t = known[w] = terms_of(w)
        found.update(t)
    return sorted(found)


@dataclass
class FactorizationMachine:
    """score = sigmoid(w0 + sum w_i + sum over pairs <v_i, v_j>) over a text's terms
    that the fit kept, each present or absent. The pairwise part learns, for example,
    that an insult weighs more beside a mention of a group."""

    terms: np.ndarray  # sorted hashes
    w0: float
    w: np.ndarray
    v: np.ndarray

    def score(self, rows: np.ndarray) -> float:
        v = self.v[rows]
        s = v.sum(0)
        z = self.w0 + self.w[rows].sum() + 0.5 * float((s * s - (v * v).sum(0)).sum())
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))

    def rows(self, found: list[int]) -> np.ndarray:
        if not len(self.terms):
            return np.zeros(0, np.int64)
        h = np.asarray(found, np.int64)
        at = np.minimum(np.searchsorted(self.terms, h), len(self.terms) - 1)
        return at[self.terms[at] == h]


def fit(samples: Iterable[tuple[int, np.ndarray]], factors: int = 4, epochs: int = 12, least_docs: int = 3, step: float = 0.1, decay: float = 2e-4, pair_decay: float = 2e-3, sure_z: float = 3.5, inertia: float = 300.0, seed: int = 7, max_terms: int = FIT_TERMS) -> FactorizationMachine:
    """Fit by AdaGrad on (label, sorted term hashes), in the order of the hashes'
    digest, so that a fit does not depend on the order rows came in. Terms of under
    ``least_docs`` samples are left out, beyond ``max_terms`` the rarest. No
    term goes for its own share among toxic samples, as it can matter beside another
    only; one whose share is not ``sure_z`` standard errors from that among the others
    learns slowly (AdaGrad starts at ``inertia``), so that rare terms are not learnt by
    heart. Memory: the samples as 32-bit numbers, and as much again twice."""
    samples = [(y, t.astype(np.int32, copy=False)) for y, t in samples]
    samples.sort(key=lambda s: (zlib.crc32(s[1].astype(np.int64).tobytes()), len(s[1]), s[0]))
    if not samples or len({y for y, _ in samples}) < 2:
        p = float(np.mean([y for y, _ in samples])) if samples else 0.0
        return FactorizationMachine(np.zeros(0, np.int64), 30.0 if p else -30.0, np.zeros(0), np.zeros((0, factors)))
    every = np.concatenate([t for _, t in samples])
    every.sort()
    at = np.flatnonzero(np.concatenate(([True], every[1:] != every[:-1]))) if len(every) else np.zeros(0, np.int64)
    terms, n = every[at].astype(np.int64), np.diff(np.concatenate((at, [len(every)])))
    del every, at
    in_toxic, total, ones = np.zeros(len(terms)), len(samples), 0
    for y, t in samples:
        if y:
            ones += 1
            in_toxic[np.searchsorted(terms, t)] += 1
    rate = n / total
    spread = np.sqrt(np.maximum(rate * (1 - rate), 1e-12) * (1 / ones + 1 / (total - ones)))
    z = (in_toxic / ones - (n - in_toxic) / (total - ones)) / spread
    keep = np.flatnonzero(n >= least_docs)
    keep = np.sort(keep[np.argsort(-n[keep], kind="stable")[:max_terms]])
    terms = terms[keep]
    slow = np.where(np.abs(z[keep]) >= sure_z, 1e-3, inertia)
    rng = np.random.default_rng(seed)
    w, v = np.zeros(len(terms)), rng.normal(0, 0.01, (len(terms), factors))
    gw, gv, w0, g0 = slow.copy(), np.repeat(slow[:, None], factors, 1), 0.0, 1e-3
    fm = FactorizationMachine(terms, 0.0, w, v)
    data = []
    samples.reverse()
    while samples:  # a sample goes when its rows are there
        y, t = samples.pop()
        data.append((y, fm.rows(t).astype(np.int32)))
    for _ in range(epochs):
        for at in rng.permutation(len(data)):
            y, i = data[at]
            x = v[i]
            s = x.sum(0)
            z = w0 + w[i].sum() + 0.5 * float((s * s - (x * x).sum(0)).sum())
            g = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
            if abs(g) < 1e-3:
                continue
            g0 += g * g
            w0 -= step * g / np.sqrt(g0)
            d = g + decay * w[i]
            gw[i] += d * d
            w[i] -= step * d / np.sqrt(gw[i])
            d = g * (s - x) + pair_decay * x
            gv[i] += d * d
            v[i] -= 0.3 * step * d / np.sqrt(gv[i])
    fm.w0 = w0
    return fm


def _terms(docs: DataFrame) -> DataFrame:
    """(id, label, terms) of (id, label, text); terms are sorted 32-bit numbers."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[int, ...]] = {}
        for b in batches:
            terms = [np.array(text_terms(t.as_py() or "", known), np.int32).tobytes() for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array(terms, pa.binary())], names=["id", "label", "terms"])

    return docs.select("id", "label", "text").mapInArrow(run, "id long, label int, terms binary")


def held_out(doc_id: F.Column) -> F.Column:
    """The fold that no fit sees: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, megabytes: int = FIT_MB) -> FactorizationMachine:
    """Fit on up to ``rows`` labelled documents by hash order, none of them held out,
    as far as their terms go into ``megabytes``. The sample is bounded, so its ids are
    broadcast and its terms collected, a written part at a time, as a driver has little
    room for rows; an unlabelled document is only read. Nulls among
    labels are left out; a document labelled more than once is toxic if any label says
    so; of rows with one id the least text counts."""
    own = labels.where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))
    own = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).select(F.col("doc_id").alias("_id"), "label")
    texts = docs.select(F.col("doc_id").cast("long").alias("_doc"), F.coalesce("text", F.lit("")).alias("text"))
    picked = texts.join(F.broadcast(own), F.col("_doc") == F.col("_id")).groupBy("_id", "label").agg(F.min("text").alias("text"))
    found = cut(_terms(picked.withColumnRenamed("_id", "id")), "toxicity-terms").withColumn("h", F.xxhash64("id"))
    left, last = megabytes << 20, None
    for h, i, n in sorted(zip(*(c.to_pylist() for c in found.select("h", "id", F.length("terms")).toArrow().columns))):
        left -= n
        if left < 0:
            found = found.where(F.struct("h", "id") <= F.struct(F.lit(last[0]), F.lit(last[1]))) if last else found.limit(0)
            break
        last = h, i
    return fit((int(r.label > 0), np.frombuffer(r.terms, np.int32)) for r in found.select("label", "terms").toLocalIterator())


def scorer(docs: DataFrame, fm: FactorizationMachine):
    """A pandas UDF from a text to its score; the bounded model is broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(fm)

    @F.pandas_udf("double")
    @released
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        fm = shared.value
        row_of = {int(h): i for i, h in enumerate(fm.terms)}
        known: dict[str, tuple[int, ...]] = {}
        for texts in parts:
            out = []
            for t in texts:
                found: set[int] = set()
                if len(known) > 400_000:
                    known.clear()
                for w in set(_WORD.findall((t or "").lower())):
                    r = known.get(w)
                    if r is None:
                        r = known[w] = tuple(row_of[h] for h in terms_of(w) if h in row_of)
                    found.update(r)
                out.append(fm.score(np.array(sorted(found), np.int64)))
            yield pd.Series(out, dtype="float64")

    return score


def toxicity(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: doc_id, held_out, score (0 to 1), predicted.

    Map only after the fit. Only the text is an input of the score. Null text: as
    empty, which scores by the bias alone. Null id: not held out. No usable label,
    or labels of one kind: every score is that kind's. Repeated rows: one result
    each. Ties: a score at the threshold is predicted toxic. Very long texts: their
    distinct words, once each. Empty table: no rows. Other columns, such as one named
    label, are not read."""
    score = scorer(docs, train(docs, labels, rows))
    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.round(score("text"), 6).alias("score"))
    return scored.select("*", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))
