"""Quality rules: base rules and a hashed n-gram log-likelihood ratio, all in
DataFrame functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .shared import SPACE, cut

BUCKETS = 1 << 15
#: Micronats a n-gram: texts below are rejected. Fixed, so a verdict depends on the
#: text and on the corpus counts alone.
THRESHOLD = -0.08
#: At most so many trusted documents are counted for the target multinomial.
TRUSTED_ROWS = 20_000


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, f"[{SPACE}]+"), "")


def _buckets(words: str, size: str, buckets: int) -> Column:
    """The buckets of each word, then of each word with the one before it."""
    return F.expr(
        f"if({size} = 0, cast(array() as array<int>), concat("
        f"transform({words}, x -> cast(pmod(xxhash64(x), {buckets}) as int)), "
        f"transform(sequence(0, {size} - 1), i -> cast(pmod(xxhash64(coalesce(get({words}, i - 1), '<s>'), {words}[i]), {buckets}) as int))))"
    )


def ratios(docs: DataFrame, trusted_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """(bucket, weight): micronats of log p(bucket | trusted) - log p(bucket | all),
    add-one smoothed, for every bucket. ``trusted_ids`` (id) must be bounded: it is
    broadcast. n-grams are combined into ``buckets`` counts before the shuffle."""
    flagged = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(trusted_ids.select("id", F.lit(1).alias("t")).distinct()), "id", "left")
    words = flagged.select(F.coalesce("t", F.lit(0)).alias("t"), words_of(F.col("text")).alias("w")).select("t", "w", F.size("w").alias("n"))
    grams = words.select("t", F.explode(_buckets("w", "n", buckets)).alias("bucket"))
    counts = cut(grams.groupBy("bucket").agg(F.count("*").alias("r"), F.sum("t").alias("t")), "ngram-counts")
    spark = docs.sparkSession
    full = spark.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(counts, "bucket", "left").select("bucket", F.coalesce("r", F.lit(0)).alias("r"), F.coalesce("t", F.lit(0)).alias("t"))
    total = full.agg(F.sum("r").alias("rs"), F.sum("t").alias("ts"))
    ratio = F.log((F.col("t") + 1) / (F.col("ts") + buckets)) - F.log((F.col("r") + 1) / (F.col("rs") + buckets))
    return full.join(F.broadcast(total)).select("bucket", F.when(F.col("ts") > 0, F.round(ratio * 1e6)).otherwise(0).cast("int").alias("weight"))


def base_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, and w (the words). No shuffle.

    A line counts in n_dup_lines when it has a word and an earlier line is equal.
    A word counts in n_repeat_words when any 3-word window over it is found twice or
    more in the text. Windows are compared by 64-bit hash; only texts that have equal
    windows sort them to find which positions those cover."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    a = docs.select(F.col(id_col).alias("doc_id"), text.alias("x")).select("doc_id", "x", words_of(F.col("x")).alias("w"))
    a = a.select("*", F.size("w").cast("long").alias("n_words"))
    a = a.select("*", F.expr("if(n_words < 3, cast(array() as array<bigint>), transform(sequence(0, cast(n_words as int) - 3), i -> xxhash64(w[i], w[i + 1], w[i + 2])))").alias("h"))
    a = a.select("*", F.expr("size(array_distinct(h)) < size(h)").alias("again"))
    a = a.select("*", F.expr("if(again, array_sort(transform(h, (v, i) -> struct(v, i))), cast(array() as array<struct<v:bigint,i:int>>))").alias("s"))
    a = a.select("*", F.expr("array_sort(transform(filter(s, (e, k) -> e.v = get(s, k - 1).v or e.v = get(s, k + 1).v), e -> e.i))").alias("p"))
    repeat = F.expr("aggregate(p, struct(0L as n, -3 as last), (acc, i) -> struct(acc.n + least(3, i - acc.last) as n, i as last), acc -> acc.n)")
    # Columns, not SQL text: a SQL string would take the pattern's backslashes away.
    lines = F.filter(F.split("x", "\n"), lambda line: line.rlike(f"[^{SPACE}]"))
    a = a.select("*", lines.alias("lines"), repeat.alias("n_repeat_words"))
    return a.select(
        "doc_id", "n_words", F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("x", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), "n_repeat_words",
        ((F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).alias("base_failed"), "w",
    )


def trusted_sample(labels: DataFrame, rows: int = TRUSTED_ROWS) -> DataFrame:
    """(id): up to ``rows`` documents labelled of good quality, by hash order."""
    good = labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").alias("id")).distinct()
    return good.orderBy(F.xxhash64("id"), "id").limit(rows)


def quality(docs: DataFrame, trusted_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, buckets: int = BUCKETS) -> DataFrame:
    """One row per input row: the base features, llr (mean log-likelihood ratio over
    the text's words and word pairs) and kept.

    One pass counts hashed n-grams of all documents, the other scores every document;
    the weights between them (``buckets`` integers, whatever the corpus) are a
    literal of the second plan. Sums of integers: scores do not depend on order.
    Null text: as empty, which fails the base rules. Null id: kept as null. Repeated
    rows: one result each. No trusted row: all ratios are 0 and only the base rules
    decide. Ties: a text at the threshold is kept. Very long texts: arrays of a few
    numbers a word in one row. Empty table: no rows. Other columns are not read."""
    table = ratios(docs, trusted_ids, id_col, text_col, buckets).orderBy("bucket").collect()  # ``buckets`` rows
    weights = F.split(F.lit(",".join(str(r.weight) for r in table)), ",").cast("array<int>")  # folded to one literal
    a = base_features(docs, id_col, text_col).select("*", F.size("w").alias("n"))
    a = a.select("*", _buckets("w", "n", buckets).alias("g"))
    score = F.aggregate("g", F.lit(0).cast("long"), lambda acc, b: acc + F.get(weights, b))
    a = a.select("*", F.when(F.col("n") > 0, score / (F.col("n") * 2e6)).otherwise(0.0).alias("llr"))
    return a.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.col("llr") >= threshold)).alias("kept"), F.round("llr", 6).alias("llr"))
