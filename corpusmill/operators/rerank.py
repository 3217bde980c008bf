"""Reranking of retrieved candidates: pass-through, heuristic, and merging of scored batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import BLANKS


def min_max(score: Column, group: str) -> Column:
    """Score between the group's least and greatest; 1 where they are equal."""
    w = Window.partitionBy(group)
    low, high = F.min(score).over(w), F.max(score).over(w)
    return F.when(high > low, (score - low) / (high - low)).otherwise(F.lit(1.0))


def query_terms(query: Column) -> Column:
    """White-space tokens of more than one byte, lower case, in order; signs stay on."""
    return F.filter(F.split(F.lower(F.trim(query)), BLANKS), lambda t: F.octet_length(t) > 1)


def coverage(terms: Column, words: Column) -> Column:
    """Share of the different terms that are among the words; 0 without terms."""
    unique = F.array_distinct(terms)
    return F.when(F.size(unique) > 0, F.size(F.array_intersect(unique, words)) / F.size(unique)).otherwise(F.lit(0.0))


def phrase_bonus(query: Column, terms: Column, body: Column) -> Column:
    """1 if the body contains the query, 0.5 if it contains two neighbouring terms, else 0."""
    pairs = F.transform(F.sequence(F.lit(0), F.size(terms) - 2), lambda i: F.concat(F.get(terms, i), F.lit(" "), F.get(terms, i + 1)))
    near = F.when(F.size(terms) > 1, F.exists(pairs, lambda p: F.contains(body, p))).otherwise(F.lit(False))
    return F.when(F.size(terms) == 0, 0.0).when(F.contains(body, query), 1.0).when(near, 0.5).otherwise(0.0)


def heuristic_rerank(candidates: DataFrame, weights: dict[str, float], digits: int = 6) -> DataFrame:
    """Weighted sum of normalised retrieval score, term coverage, phrase bonus and title match.

    candidates: query_id, query, item_id, body, head (title and section), score, rank.  Order: score
    descending, ties by the earlier rank.  Null bodies and heads count as empty.  Texts become three
    numbers before anything is shuffled by query; query, body and head aren't in the result.
    """
    # texts are taken apart once, in a projection of their own that the optimiser doesn't inline
    parts = candidates.withColumns({"_query": F.trim(F.regexp_replace(F.lower("query"), BLANKS, " ")), "_body": F.lower(F.coalesce("body", F.lit(""))), "_head": F.lower(F.coalesce("head", F.lit("")))})
    parts = parts.withColumns({"_terms": query_terms(F.col("_query")), "_words": F.split("_body", BLANKS), "_titles": F.split("_head", BLANKS)})
    terms = F.col("_terms")
    texts = weights["query_term_coverage"] * coverage(terms, F.col("_words")) + weights["phrase_match_bonus"] * phrase_bonus(F.col("_query"), terms, F.col("_body")) + weights["title_section_match_bonus"] * coverage(terms, F.col("_titles"))
    kept = [c for c in candidates.columns if c not in ("query", "body", "head")]
    reduced = parts.select(*kept, texts.alias("_texts"))
    total = weights["retrieval_score"] * min_max(F.col("score"), "query_id") + F.col("_texts")
    scored = reduced.withColumn("score", F.round(total, digits))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "rank")
    return scored.withColumn("rank", F.row_number().over(order)).drop("_texts")


def merge_batches(scored: DataFrame, group: str, batch_size: int, global_sort: bool) -> DataFrame:
    """Candidates scored in batches of their original order: sorted over all batches, or the sorted
    batches one after the other."""
    batch = F.floor((F.col("original") - 1) / batch_size)
    order = [F.desc("score"), F.col("original")]
    w = Window.partitionBy(group).orderBy(*([] if global_sort else [batch]), *order)
    return scored.withColumn("rank", F.row_number().over(w))


def select_final(ranked: DataFrame, final_k: int) -> DataFrame:
    """Mark the first final_k ranks as selected; nothing is cut off."""
    return ranked.withColumn("selected", F.col("rank") <= final_k)
