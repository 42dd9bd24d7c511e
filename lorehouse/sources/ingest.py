"""Originals through the whole chain: outcome by metadata and bytes, parser, fragments of what is ready."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .dispatch import outcome, parser_of
from .parsers import parse


def outcomes(originals: DataFrame) -> DataFrame:
    """Originals (original_id, title, mime, content) with ``parser``, ``state`` and ``reason``; a null content is empty."""
    content = F.coalesce("content", F.lit(b"").cast("binary"))
    told = originals.withColumn("content", content).withColumn("parser", parser_of(F.col("title"), F.col("mime")))
    return told.withColumn("_o", outcome(F.col("title"), F.col("mime"), F.octet_length("content"), F.col("content"))).select("*", "_o.state", "_o.reason").drop("_o")


def fragments(originals: DataFrame) -> DataFrame:
    """Fragments of the originals that are ready; skipped and failed ones have none."""
    return parse(outcomes(originals).where("state = 'ready'"))


def ingested(originals: DataFrame) -> DataFrame:
    """(original_id, state, reason, n_fragments): an empty original is ready and has none."""
    counts = fragments(originals).groupBy("original_id").agg(F.count("*").alias("n"))
    return outcomes(originals).select("original_id", "state", "reason").join(counts, "original_id", "left").select("original_id", "state", "reason", F.coalesce("n", F.lit(0)).alias("n_fragments"))
