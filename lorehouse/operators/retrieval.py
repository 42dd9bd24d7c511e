"""Retrieval: BM25 over phrases, exhaustive cosine search, and their reciprocal-rank fusion with provenance.

A query reads the chunk table in projections: phrase counts are taken inside each row, so a query shuffles only its
corpus statistics (one row) and the top rows of each task.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..functions.vectors import cosine_distance

#: Fixed values of the ranking.
K1, B, LEAST_IDF, RRF, DEFAULT_LIMIT, MOST = 1.2, 0.75, 1e-6, 60, 10, 50


def phrases(query: str) -> list[list[str]]:
    """Blank-separated terms, first occurrences of equal ones, each as its tokens; terms without a token match nothing."""
    out = []
    for term in dict.fromkeys(query.split()):
        plain = "".join(c for c in unicodedata.normalize("NFD", term) if unicodedata.category(c) != "Mn")
        found = re.findall(r"[^\W_]+", unicodedata.normalize("NFC", plain).lower())
        if found:
            out.append(found)
    return out


def check_request(query: str, limit: int | None = None) -> tuple[str, int]:
    """Trimmed query of 1 to 16384 bytes and a limit of 1 to 50, 10 if none is given."""
    query, limit = query.strip(), DEFAULT_LIMIT if limit is None else limit
    if not 1 <= len(query.encode()) <= 16384 or not 1 <= limit <= MOST:
        raise ValueError("invalid retrieval request")
    return query, limit


def phrase_count(words: Column, phrase: Sequence[str]) -> Column:
    """Starts of the phrase in an array of tokens."""
    if len(phrase) == 1:
        return F.size(F.filter(words, lambda w: w == phrase[0]))
    at = lambda i: [F.get(words, i + k) == w for k, w in enumerate(phrase)]

    def starts(w: Column, i: Column) -> Column:
        test = w == phrase[0]
        for other in at(i)[1:]:
            test = test & F.coalesce(other, F.lit(False))
        return test

    return F.size(F.filter(words, starts))


def counted(chunks: DataFrame, wanted: list[list[str]], id_col: str, text_col: str) -> DataFrame:
    """(chunk_id, n_tokens, tf): each chunk's length and its phrases' counts."""
    words = chunks.select(F.col(id_col).alias("chunk_id"), F.explode(F.array(tokens(F.col(text_col)))).alias("w"))
    return words.select("chunk_id", F.size("w").alias("n_tokens"), F.array(*[phrase_count(F.col("w"), p) for p in wanted]).alias("tf"))


def corpus_statistics(chunks: DataFrame, id_col: str = "chunk_id", text_col: str = "text") -> DataFrame:
    """(term, n_docs_with, n_occurrences) for every term."""
    words = chunks.select(F.col(id_col).alias("chunk_id"), F.explode(tokens(F.col(text_col))).alias("term"))
    per_chunk = words.groupBy("term", "chunk_id").agg(F.count("*").alias("n"))
    return per_chunk.groupBy("term").agg(F.count("*").alias("n_docs_with"), F.sum("n").alias("n_occurrences"))


def lexical(chunks: DataFrame, query: str, limit: int = MOST, id_col: str = "chunk_id", text_col: str = "text") -> DataFrame:
    """(chunk_id, score, rank): BM25, smaller is better, ties by id."""
    wanted = phrases(query)
    if not wanted:
        return chunks.select(F.col(id_col).alias("chunk_id"), F.lit(0.0).alias("score"), F.lit(0).alias("rank")).limit(0)
    rows = counted(chunks, wanted, id_col, text_col)
    stats = rows.agg(F.count("*").alias("n"), F.avg("n_tokens").alias("mean"), *[F.sum((F.get("tf", F.lit(k)) > 0).cast("bigint")).alias(f"df{k}") for k in range(len(wanted))]).first()
    score = bm25(F.col("tf"), F.col("n_tokens"), [stats[f"df{k}"] for k in range(len(wanted))], stats["n"], stats["mean"] or 1.0)
    hits = rows.where(F.exists("tf", lambda x: x > 0)).select("chunk_id", F.round(score, 9).alias("score")).orderBy("score", "chunk_id").limit(limit)
    return ranked(hits, F.col("score"))


def bm25(tf: Column, n_tokens: Column, df: Sequence[int], n: int, mean: float) -> Column:
    """Smaller is better; ``tf`` is an array of the phrases' counts in a chunk, ``df`` the chunks that have each."""
    score = F.lit(0.0)
    for k, with_it in enumerate(df):
        idf = F.greatest(F.lit(LEAST_IDF), F.log((F.lit(float(n)) - (with_it or 0) + 0.5) / ((with_it or 0) + 0.5)))
        count = F.get(tf, F.lit(k)).cast("double")
        score = score - idf * count * (K1 + 1) / (count + K1 * (1 - B + B * n_tokens / mean))
    return score


def ranked(hits: DataFrame, by: Column) -> DataFrame:
    """At most ``MOST`` rows with their rank; the window holds no more than a query's top rows."""
    return hits.withColumn("rank", F.row_number().over(Window.orderBy(by, "chunk_id")))


def nearest(vectors: DataFrame, query: Sequence[float], limit: int = MOST, id_col: str = "chunk_id", vector_col: str = "embedding") -> DataFrame:
    """(chunk_id, distance, rank): exhaustive cosine search, ties by id."""
    distance = F.round(cosine_distance(F.col(vector_col), query), 6)
    found = vectors.select(F.col(id_col).alias("chunk_id"), distance.alias("distance")).where("distance is not null")
    return ranked(found.orderBy("distance", "chunk_id").limit(limit), F.col("distance"))


def fetch(limit: int) -> int:
    """Candidates taken from each channel."""
    return min(MOST, max(4 * limit, limit))


def fuse(by_text: DataFrame, by_vector: DataFrame, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """Reciprocal-rank fusion of both channels; a hit of one channel has nulls for the other."""
    a = by_text.select("chunk_id", F.col("rank").alias("lexical_rank"), F.col("score").alias("lexical_score"))
    b = by_vector.select("chunk_id", F.col("rank").alias("semantic_rank"), F.col("distance").alias("semantic_distance"))
    part = lambda c: F.coalesce(1.0 / (RRF + F.col(c)), F.lit(0.0))
    fused = a.join(b, "chunk_id", "full_outer").withColumn("score", F.round(part("lexical_rank") + part("semantic_rank"), 9))
    return fused.orderBy(F.desc("score"), "chunk_id").limit(limit).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "chunk_id")))


def search(chunks: DataFrame, query: str, limit: int | None = None, vectors: DataFrame | None = None, query_vector: Sequence[float] | None = None) -> DataFrame:
    """Fused hits with the chunks' own columns. Without vectors the search is lexical alone."""
    query, limit = check_request(query, limit)
    by_text = lexical(chunks, query, fetch(limit))
    if vectors is not None and query_vector is not None:
        by_vector = nearest(vectors, query_vector, fetch(limit))
    else:
        by_vector = by_text.limit(0).select("chunk_id", F.lit(0.0).alias("distance"), "rank")
    hits = fuse(by_text, by_vector, limit)  # at most 50 rows
    return chunks.join(F.broadcast(hits), "chunk_id")


def missing_embeddings(chunks: DataFrame, embedded: DataFrame) -> DataFrame:
    return chunks.join(embedded.select("chunk_id"), "chunk_id", "left_anti")
