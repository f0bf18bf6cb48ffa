"""A training corpus from raw documents, in five stages.

Each stage is (spark, docs, sf_dir) -> DataFrame over all that the one before kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from millrace.llm import exact, mixing, pieces, simhash, toxicity
from millrace.llm.queries import MIXTURE
from millrace.llm.shared import SPACE, cut

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _key(sha: F.Column, doc_id: F.Column | None = None) -> F.Column:
    """A row's identity where ids can be null or repeat: its id and its text's digest."""
    return F.concat_ws(":", F.coalesce((F.col("doc_id") if doc_id is None else doc_id).cast("string"), F.lit("null")), sha)


def _rows_of(docs: DataFrame, keys: DataFrame, sha: F.Column) -> DataFrame:
    """The rows of docs with a key of ``keys`` (_key, n: how many rows have it), one,
    the least, where several have it. Texts are moved once, for the join; only rows of
    such keys are compared."""
    hit = docs.select(*COLUMNS, _key(sha).alias("_key")).join(keys, "_key")
    again = hit.where("n > 1").groupBy("_key").agg(F.min(F.struct(*COLUMNS)).alias("r"))
    return hit.where("n = 1").select(*COLUMNS).union(again.select("r.*"))


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine does not predict to be toxic. Null text:
    scored as empty. Null ids and repeated rows: each row by its own score. Empty table,
    or no labels: all rows."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = toxicity.scorer(docs, model)
    return docs.where(F.round(score("text"), 6) < toxicity.THRESHOLD).select(*COLUMNS)


def exact_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the one with the smallest doc_id. Rows without id lose to others
    and, where a text has no other, leave one row."""
    keys = exact.exact_duplicates(docs).where("kept").groupBy(_key(F.col("text_sha256")).alias("_key")).agg(F.count("*").alias("n"))
    squeezed = F.regexp_replace(F.coalesce("text", F.lit("")), f"[{SPACE}]+", " ")
    return _rows_of(docs, cut(keys, "exact-keys"), F.sha2(squeezed, 256))


def near_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents whose sets of five-word shingles are similar by 0.8 or
    more, directly or over others, the one with the smallest doc_id, of several with that
    id the one whose text has the least digest. Null ids lose to others; rows of one id
    and text are one. Texts without a word are one group."""
    sha = F.sha2(F.coalesce("text", F.lit("")), 256)
    near = cut(simhash.similar_documents(docs.select("doc_id", "text", sha.alias("_sha")), carry=("_sha",)), "near-classes")
    first = near.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "_sha")).alias("r"))
    number = near.groupBy(_key(F.col("_sha")).alias("_key")).agg(F.count("*").alias("n"))
    keys = number.join(first.select(_key(F.col("r._sha"), F.col("r.doc_id")).alias("_key")), "_key", "left_semi")
    return _rows_of(docs, cut(keys, "near-keys"), sha)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to the sources' target weights and shuffled. Null id: drawn as
    the word null. Null source: a source of its own. Rows of one id: drawn alike."""
    return mixing.mix(docs, MIXTURE).select(*COLUMNS)


def tokenized(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text, one row per copy. Null text: as
    empty. Null id: kept as null."""
    return pieces.encode_decode(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [("toxicity", toxic_out), ("exact dedup", exact_out), ("simhash near-dedup", near_out), ("mixing", mixed), ("sentencepiece", tokenized)]

#: SQL has neither the toxicity stage's machine nor the tokenizer; a test compares run()
#: with a version in plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs, f"stage-{k}")
    return docs
