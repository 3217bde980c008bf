"""Tokens, vocabulary, term statistics, bag-of-words and BM25 weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import BLANKS

from ..session import join_hot, materialise


def canonical_token(word: Column) -> Column:
    """Lower case, without ``##`` and without signs at both ends."""
    bare = F.trim(F.regexp_replace(F.lower(word), "^##", ""))
    return F.regexp_replace(F.regexp_replace(bare, r"^[^\p{L}\p{N}]+", ""), r"[^\p{L}\p{N}]+$", "")


def tokens(df: DataFrame, key: str, text: str, min_length: int = 2) -> DataFrame:
    """``key, pos, token`` in reading order; tokens shorter than min_length characters are dropped.
    Null texts have none."""
    words = df.where(F.col(text).isNotNull()).select(key, F.posexplode(F.split(text, BLANKS)).alias("pos", "word"))
    return words.select(key, (F.col("pos") + 1).alias("pos"), canonical_token(F.col("word")).alias("token")).where(F.length("token") >= min_length)


def numbered(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """``key, chunk_no`` from 0 in the given order.

    Rows are sorted by range partitions and counted a partition, so no task holds all of them.
    """
    from .ordering import global_row_number

    return global_row_number(df.select(*dict.fromkeys([key, *order])), order, "chunk_no").select(key, "chunk_no")


def vocabulary(token_rows: DataFrame, numbers: DataFrame, key: str) -> DataFrame:
    """``token, token_id``: ids from 0 by first appearance over (chunk number, position)."""
    from .ordering import global_row_number

    first = token_rows.join(numbers, key).groupBy("token").agg(F.min(F.struct("chunk_no", "pos")).alias("at"))
    return global_row_number(first.select("token", "at.chunk_no", "at.pos"), ["chunk_no", "pos"], "token_id").select("token", F.col("token_id").cast("bigint").alias("token_id"))


def term_frequencies(token_rows: DataFrame, key: str) -> DataFrame:
    return token_rows.groupBy(key, "token").agg(F.count("*").alias("tf"))


def term_frequencies_and_lengths(token_rows: DataFrame, key: str) -> DataFrame:
    """``key, token, tf, dl``: frequencies and the document's length by one shuffle on the key."""
    tf = token_rows.repartition(key).groupBy(key, "token").agg(F.count("*").alias("tf"))
    return tf.withColumn("dl", F.sum("tf").over(Window.partitionBy(key)))


def term_stats(tf: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Document frequency by token; and one row with documents and mean length (documents without a
    retained token don't count)."""
    lengths = tf.groupBy(key).agg(F.sum("tf").alias("dl"))
    return tf.groupBy("token").agg(F.count("*").alias("df")), lengths.agg(F.count("*").alias("documents"), F.avg("dl").alias("avgdl"))


def okapi_idf(df: DataFrame, corpus: DataFrame, epsilon: float = 0.25) -> DataFrame:
    """``token, idf`` = ln(N - df + .5) - ln(df + .5); a negative one becomes epsilon times the mean."""
    raw = df.crossJoin(F.broadcast(corpus.select("documents"))).select("token", (F.log(F.col("documents") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw"))
    mean = raw.agg(F.avg("raw").alias("mean"))
    return raw.crossJoin(F.broadcast(mean)).select("token", F.when(F.col("raw") < 0, epsilon * F.col("mean")).otherwise(F.col("raw")).alias("idf"))


def bm25_document_weights(token_rows: DataFrame, key: str, k1: float = 1.2, b: float = 0.75, epsilon: float = 0.25) -> DataFrame:
    """``key, token, weight`` = idf * tf (k1 + 1) / (tf + k1 (1 - b + b dl / avgdl)) of the tokens.

    The vocabulary's idf is broadcast after a count; a larger one is joined with the rows of a token
    spread over several keys, as a token may be in every document.
    """
    tf = materialise(term_frequencies_and_lengths(token_rows, key), "tf")
    corpus = tf.groupBy(key).agg(F.first("dl").alias("dl")).agg(F.count("*").alias("documents"), F.avg("dl").alias("avgdl"))
    idf = materialise(okapi_idf(tf.groupBy("token").agg(F.count("*").alias("df")), corpus, epsilon), "idf")
    rows = join_hot(tf, idf, "token").crossJoin(F.broadcast(corpus.select("avgdl")))
    norm = 1 - b + b * F.col("dl") / F.col("avgdl")
    return rows.select(key, "token", (F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * norm)).alias("weight"))


def bm25_query_weights(query_tokens: DataFrame, tf: DataFrame, key: str) -> DataFrame:
    """``query_id, token, weight`` with idf = ln(1 + (N - df + .5) / (df + .5)); unknown tokens drop."""
    tf = materialise(tf, "tf")
    df, corpus = term_stats(tf, key)
    rows = query_tokens.join(df, "token").crossJoin(F.broadcast(corpus.select("documents")))
    return rows.select("query_id", "token", F.log(1 + (F.col("documents") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("weight"))


def sparse_vector(weights: DataFrame, key: str) -> DataFrame:
    """``key, indices, values``: aligned arrays in ascending token id."""
    pairs = weights.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("token_id", "weight"))).alias("v"))
    return pairs.select(key, F.col("v.token_id").alias("indices"), F.col("v.weight").alias("values"))


def last_rows(df: DataFrame, key: str, order: Column) -> DataFrame:
    w = Window.partitionBy(key).orderBy(order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
