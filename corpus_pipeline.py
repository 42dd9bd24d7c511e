"""The corpus pipeline: stages over ``documents``, each written as Parquet and reread as the next one's input.

A stage's working tables are deleted when the next stage begins, so its result has to be written before, as ``run`` does.

Stages are language ID, quality classifier, n-gram Jaccard join, mixing and packing. All but the last return the columns
of the documents they were given. Defined results: documents without a letter, null and empty texts among them, go at the
first stage, in which repeated rows are judged each on their own and a null language is filled in; the second scores each
row by its text alone and keeps rows of any id; of a group of near duplicates the row with the smallest id stays, a row
without id only where no row has one, one row of several with that id; rows that share an id but not a text are documents of
their own; the last packs every row it gets, a null text as an empty one. An empty table gives no rows at any stage. No
stage is expressible in SQL as a whole, so ``ORACLE_SQL`` is None and the stages are tested on small tables.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorehouse.llm import jaccard_join, language_id, mixing, packing, quality_classifier
from lorehouse.llm.common import owned, release, scratch_path, table
from lorehouse.llm.queries import TOKENIZER, marks

_left: list[str] = []  # folders of the working tables of the stage before


def stage(f: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    @wraps(f)
    def of(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(spark, _left)
        with owned() as folders:
            out = f(spark, docs, sf_dir)
        _left.extend(folders)
        return out

    return of


@stage
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language, by text; those predicted ``und`` go. A missing ``lang`` is filled in."""
    model = language_id.train(language_id.training_rows(table(spark, sf_dir, "documents")))
    judged = language_id.predict(docs, model, pred_col="__lang_pred", score_col="__lang_score")
    kept = judged.where(F.col("__lang_pred") != language_id.UNKNOWN)
    return kept.withColumn("lang", F.coalesce("lang", "__lang_pred")).select(*docs.columns)


@stage
def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score at least the threshold's quantile."""
    model = quality_classifier.train(table(spark, sf_dir, "documents"), marks(spark, sf_dir, "quality", 4, 2))
    return quality_classifier.score(docs, model, score_col="__score").where(F.col("__score") >= quality_classifier.CUT).select(*docs.columns)


@stage
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: shingles of five words, similarity 0.8 or more."""
    return jaccard_join.survivors(docs, n=5, percent=80)


@stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their rate asks. The declared source counts as evidence that is wrong once in ten times:
    text alone may not tell sources apart, and then no rate would ever differ from 1. A source is repeated at most four
    times on average."""
    return mixing.taken(mixing.mix_sources(docs, doubt=0.1, repeat=4.0), docs.columns)


@stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences."""
    return packing.digest(packing.pack(docs, public_tokenizers.path(TOKENIZER)))


STAGES = [
    ("language_id", identify_language),
    ("quality_classifier", keep_quality),
    ("ngram_jaccard", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, apply) in enumerate(STAGES):
        path = scratch_path(spark, f"{k}-{name}")
        apply(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
