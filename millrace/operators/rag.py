"""Retrieval: filtered vector search, BM25, rank fusion, chunks, embeddings."""

from __future__ import annotations

import collections
from bisect import bisect_right
from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import distance, fnv1a_64, once, tokens
from ..sources.store import cut
from .predicates import All, Filter


def topk(df: DataFrame, query: list[float], k: int, metric: str = "cosine", vector: str = "embedding", where: Filter = All()) -> DataFrame:
    """(eid, score): the k nearest rows of a filter, ties by eid. One scan; each task
    keeps k rows (TakeOrderedAndProject)."""
    q = F.array(*(F.lit(float(x)) for x in query))
    return df.where(where.column()).select("eid", F.round(distance(metric, F.col(vector), q), 6).alias("score")).orderBy("score", "eid").limit(k)


def bm25_terms(df: DataFrame, text: str = "text") -> DataFrame:
    """(eid, term, tf, dl). Documents without a token have no row."""
    t = df.select("eid", tokens(F.col(text)).alias("t")).where(F.size("t") > 0)
    return t.select("eid", F.size("t").alias("dl"), F.explode("t").alias("term")).groupBy("eid", "dl", "term").agg(F.count("*").alias("tf"))


def bm25(df: DataFrame, query: str, text: str = "text", candidates: DataFrame | None = None, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(eid, score) of documents with any query term. Corpus numbers are over all
    documents, also when candidates restrict the result; a repeated query term counts
    as often as it stands. Texts are read and split once, into a small written table of
    a document's length and its counts of the query's terms."""
    spark = df.sparkSession
    parts = spark.range(1).select(tokens(F.lit(query)).alias("t")).first().t
    if not parts:
        return spark.createDataFrame([], "eid bigint, score double")
    terms = list(dict.fromkeys(parts))
    counted = lambda t: F.struct(F.size(t).alias("dl"), *((F.size(t) - F.size(F.array_remove(t, w))).alias(f"tf{i}") for i, w in enumerate(terms)))
    # Written as one column: a filter on its parts would split the text again.
    rows = cut(df.select("eid", once(tokens(F.col(text)), counted).alias("c")), "bm25").select("eid", "c.*").where("dl > 0")
    stats = rows.agg(F.count("*").alias("n"), F.avg("dl").alias("avg"), *(F.sum((F.col(f"tf{i}") > 0).cast("int")).alias(f"df{i}") for i in range(len(terms)))).first()
    norm = k1 * (1 - b + b * F.col("dl") / max(stats["avg"] or 0.0, 1.0))
    score = F.lit(0.0)
    for i, w in enumerate(terms):
        n = stats[f"df{i}"] or 0
        idf = F.log(F.lit((stats["n"] - n + 0.5) / (n + 0.5) + 1.0))
        score = score + F.lit(parts.count(w)) * idf * F.col(f"tf{i}") * (k1 + 1) / (F.col(f"tf{i}") + norm)
    hit = F.greatest(*(F.col(f"tf{i}") for i in range(len(terms))), F.lit(0)) > 0
    found = rows.where(hit).select("eid", F.round(score, 6).alias("score"))
    return found.join(candidates.select("eid"), "eid", "left_semi") if candidates is not None else found


def bm25_postings(postings: DataFrame, query: str, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(eid, score) as ``bm25`` finds, from the written table of ``bm25_terms``: only
    postings of the query's terms and each document's length are looked at."""
    spark = postings.sparkSession
    parts = spark.range(1).select(tokens(F.lit(query)).alias("t")).first().t
    sizes = postings.groupBy("eid").agg(F.first("dl").alias("dl")).agg(F.count("*").alias("n"), F.avg("dl").alias("avg"))
    weights = spark.createDataFrame(list(collections.Counter(parts).items()) or [("", 0)], "term string, times long")
    hits = postings.join(F.broadcast(weights), "term")  # as many rows as the query has terms
    df_ = hits.groupBy("term").agg(F.count("*").alias("df"))
    each = hits.join(F.broadcast(df_), "term").join(F.broadcast(sizes))
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1.0)
    norm = k1 * (1 - b + b * F.col("dl") / F.greatest("avg", F.lit(1.0)))
    part = F.col("times") * idf * F.col("tf") * (k1 + 1) / (F.col("tf") + norm)
    return each.groupBy("eid").agg(F.round(F.sum(part), 6).alias("score"))


def ranked(df: DataFrame, k: int, ascending: bool) -> DataFrame:
    """(eid, rank) of the best k rows. Only k rows are numbered."""
    best = df.orderBy(F.col("score").asc() if ascending else F.col("score").desc(), "eid").limit(k)
    order = "score, eid" if ascending else "score desc, eid"
    return best.selectExpr("eid", f"row_number() over (order by {order}) as rank")


def rrf(a: DataFrame, b: DataFrame, k: int = 60) -> DataFrame:
    """(eid, score) of two rankings (eid, rank): the sum of 1 / (k + rank)."""
    both = a.select("eid", "rank").union(b.select("eid", "rank"))
    return both.groupBy("eid").agg(F.round(F.sum(F.lit(1.0) / (k + F.col("rank"))), 9).alias("score"))


def hybrid(df: DataFrame, query_vector: list[float], query_text: str, k: int, metric: str = "cosine", vector: str = "embedding", text: str = "text", where: Filter = All(), rrf_k: int = 60) -> DataFrame:
    """(eid, score): vector and BM25 rankings of 4 k rows each, fused, the best k."""
    near = ranked(topk(df, query_vector, 4 * k, metric, vector, where), 4 * k, True)
    words = ranked(bm25(df, query_text, text, df.where(where.column())), 4 * k, False)
    return rrf(near, words, rrf_k).orderBy(F.col("score").desc(), "eid").limit(k)


# Separators from coarse to fine.
SEPARATORS = ("\n\n", "\n", "。", "．", ". ", "、", ", ", " ", "")
MARKDOWN = ("\n# ", "\n## ", "\n### ", "\n\n", "\n", "。", ". ", " ", "")


def _runs(parts: list[str], sep: str, most: int) -> Iterator[str]:
    """Parts joined to the longest runs that fit, found by bisection over the parts' end
    offsets. Empty parts begin no run; a part that fits nowhere is cut by length."""
    ends = list(accumulate(len(p) + len(sep) for p in parts))
    i = 0
    while i < len(parts):
        if not parts[i]:
            i += 1
        elif len(parts[i]) > most:
            yield from by_length(parts[i], most)
            i += 1
        else:
            begin = ends[i] - len(parts[i]) - len(sep)
            j = bisect_right(ends, begin + most + len(sep), i)
            yield sep.join(parts[i:j])
            i = j


def by_length(text: str, most: int) -> list[str]:
    return [text[i : i + most] for i in range(0, len(text), most)]


def split_text(text: str, most: int, overlap: int = 0, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Chunks of up to ``most`` characters, packed greedily at the coarsest separator
    that serves, finer ones inside parts that are too long, single characters last.
    Each chunk but a level's first is preceded by the ``overlap`` last characters of
    the one before, at every level a part passes through."""
    if not 0 <= overlap < most:
        raise ValueError("overlap must be less than the size")
    coarse, *finer = [s for s in separators if s] or [""]
    if len(text) <= most or not coarse:
        return by_length(text, most) or [""]
    parts = [c for p in text.split(coarse) for c in split_text(p, most, overlap, tuple(finer))]
    chunks = list(_runs(parts, coarse, most))
    return [before[-overlap:] + c for before, c in zip(["", *chunks], chunks)] if overlap else chunks


def chunk(df: DataFrame, most: int, overlap: int = 0, text: str = "text", separators: tuple[str, ...] = SEPARATORS, splitter: Callable[[str], list[str]] | None = None) -> DataFrame:
    """(eid, position, chunk). ``splitter`` replaces the built-in one."""
    cut_up = splitter or (lambda t: split_text(t, most, overlap, separators))

    @F.pandas_udf("array<string>")
    def parts(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: cut_up(t or ""))

    return df.select("eid", F.posexplode(parts(text)).alias("position", "chunk"))


#: A worker's table of token vectors is emptied beyond so many numbers.
KNOWN_NUMBERS = 4_000_000
#: So many texts, or as many as have so many characters, are embedded at a time.
EMBED_TEXTS, EMBED_CHARS = 1000, 500_000


def token_vectors(words: list[str], dim: int) -> np.ndarray:
    """A row of ``dim`` numbers in [-1, 1) for each word: its 64-bit hash drives a
    xorshift64* generator, all words' a step at a time."""
    h = np.array([fnv1a_64(w.encode()) for w in words], np.uint64)
    out = np.empty((len(words), dim), np.float32)
    for i in range(dim):
        h ^= h >> np.uint64(12)
        h ^= h << np.uint64(25)
        h ^= h >> np.uint64(27)
        top = (h * np.uint64(0x2545F4914F6CDD1D)) >> np.uint64(11)
        out[:, i] = (top / float(1 << 53)).astype(np.float32) * np.float32(2) - np.float32(1)
    return out


def hash_vectors(texts: list[str], dim: int, known: dict[str, np.ndarray] | None = None) -> list[list[float]]:
    """A deterministic unit vector for each text: its tokens' numbers, added up in the
    text's order. ``known`` keeps tokens' numbers from call to call."""
    known = {} if known is None else known
    split = [t.split() for t in texts]
    if len(known) * dim > KNOWN_NUMBERS:
        known.clear()
    fresh = list(dict.fromkeys(w for words in split for w in words if w not in known))
    known.update(zip(fresh, token_vectors(fresh, dim)))
    out = []
    for words in split:
        v = np.add.reduce([known[w] for w in words], axis=0, dtype=np.float32) if words else np.eye(1, dim, dtype=np.float32)[0]
        n = float(np.sqrt((v.astype(np.float64) ** 2).sum()))
        out.append((v / n if n else v).tolist())
    return out


def hash_vector(text: str, dim: int) -> list[float]:
    return hash_vectors([text], dim)[0]


def embed_batches(batches: Iterator[pa.RecordBatch], make: Callable[[list[str]], list]) -> Iterator[pa.RecordBatch]:
    """(eid, embedding) of (eid, text): a batch's texts become Python objects a few at a time."""
    for b in batches:
        texts, chars = [], 0
        for i, t in enumerate(b.column(1), 1):
            texts.append(t.as_py() or "")
            chars += len(texts[-1])
            if len(texts) == EMBED_TEXTS or chars >= EMBED_CHARS or i == b.num_rows:
                vectors = [None if v is None else np.asarray(v, np.float32) for v in make(texts)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i - len(texts), len(texts)), pa.array(vectors, pa.list_(pa.float32()))], names=["eid", "embedding"])
                texts, chars = [], 0


def embed(df: DataFrame, dim: int, text: str = "text", embedder: Callable[[str], list[float]] | None = None) -> DataFrame:
    """(eid, embedding) by the hash embedder or any function from text to vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, np.ndarray] = {}
        return embed_batches(batches, (lambda texts: [embedder(t) for t in texts]) if embedder else lambda texts: hash_vectors(texts, dim, known))

    return df.select("eid", F.col(text).alias("text")).mapInArrow(run, f"eid {df.schema['eid'].dataType.simpleString()}, embedding array<float>")


def rerank_by_length(found: DataFrame, text: str = "text") -> DataFrame:
    """Longer texts (in bytes) first, equals as they were ranked."""
    return found.orderBy(F.octet_length(text).desc(), "score", "eid")


def rerank(found: DataFrame, score: Column | Callable[[str], float], text: str = "text") -> DataFrame:
    """Rows by another score, the greatest first, equals as they were ranked: a Column,
    or a function of the text, which is called batch by batch."""
    if not isinstance(score, Column):
        call = score

        @F.pandas_udf("double")
        def scored(texts: pd.Series) -> pd.Series:
            return pd.Series([float(call(t or "")) for t in texts], dtype="float64")

        score = scored(text)
    return found.withColumn("rerank", score).orderBy(F.col("rerank").desc(), "score", "eid")
