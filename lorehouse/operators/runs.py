"""Knowledge runs with checkpoints: a model is asked batch by batch, and what it answered is kept as each wave ends.

A run is a set of jobs (job, and the fragments of one original). Its batches are cut as ``knowledge.batched`` does, each
with a digest of its fragments. A checkpoint is one row keyed by (job, batch, digest) in a table of the store that is only
added to; a wave asks for the next ``WAVE`` open batches of every job and commits their checkpoints. A run that is killed
goes on with the batches that have no checkpoint of the same digest, so no answer is paid for twice and none that was given
for other fragments is used.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import stable_id
from ..sources.store import Store
from . import knowledge as K
from . import publication as P

WAVE = 4
CHECKPOINT = "job string, original_id string, batch int, digest string, n_semantic bigint, n_completed bigint, answers array<struct<evidence_id:string,answer:string>>"


def planned(fragments: DataFrame, target: int = 4096, most_bytes: int | None = None) -> DataFrame:
    """``fragments`` (job, and the columns of ``knowledge.batched``) with ``batch``, ``digest`` and ``evidence_id``."""
    cut = K.batched(fragments, target, most_bytes)
    told = P.batch_digests(cut).select("original_id", "batch", "digest")
    evidence = stable_id("evidence", F.to_json(F.struct(F.col("original_id").cast("string").alias("source"), F.col("selector"))))
    return cut.join(told, ["original_id", "batch"]).withColumn("evidence_id", evidence)


def open_batches(batches: DataFrame, store: Store) -> DataFrame:
    """(job, original_id, batch, digest) without a checkpoint of their own."""
    return batches.join(store.read("checkpoints").select("job", "batch", "digest"), ["job", "batch", "digest"], "left_anti")


def run(store: Store, fragments: DataFrame, extractor: K.Extractor, target: int = 4096, most_bytes: int | None = None, after_wave: Callable[[int], None] | None = None) -> int:
    """Ask for every open batch of the jobs of ``fragments``, wave by wave; the number of waves. ``after_wave`` is told of each."""
    part = store.stage("batches", planned(fragments, target, most_bytes))
    cut = store.staged("batches", part).drop("_version")
    store.add({"batches": [part]})
    batches = cut.select("job", "original_id", "batch", "digest").distinct()
    waves = 0
    while not (left := open_batches(batches, store)).isEmpty():
        order = F.row_number().over(Window.partitionBy("job").orderBy("batch"))  # a job has the batches of one original
        asked = left.withColumn("_n", order).where(F.col("_n") <= WAVE).drop("_n")
        rows = cut.join(asked.select("job", "batch"), ["job", "batch"], "left_semi")
        answers = K.extracted(rows, extractor).withColumn("ordinal", F.col("fragment_id").cast("int"))
        named = answers.join(rows.select("original_id", "ordinal", "evidence_id"), ["original_id", "ordinal"]).groupBy("original_id", "batch").agg(
            F.count("*").alias("n_semantic"), F.count("answer").alias("n_completed"), F.array_sort(F.collect_list(F.struct("evidence_id", "answer"))).alias("answers")  # a batch has a bounded size
        )
        none = F.array().cast("array<struct<evidence_id:string,answer:string>>")
        told = asked.join(named, ["original_id", "batch"], "left").withColumns({"n_semantic": F.coalesce("n_semantic", F.lit(0)), "n_completed": F.coalesce("n_completed", F.lit(0)), "answers": F.coalesce("answers", none)})
        store.add({"checkpoints": [store.stage("checkpoints", told)]})  # answers hold whatever others wrote
        waves += 1
        if after_wave:
            after_wave(waves)
    return waves


def finished(store: Store, batches: DataFrame) -> DataFrame:
    """(job, n_semantic, n_completed, reason, state) of jobs (job, batch, digest) by the checkpoints of their own batches;
    ``missing_checkpoints`` where one is not there."""
    good = store.read("checkpoints").join(batches.select("job", "batch", "digest"), ["job", "batch", "digest"], "left_semi").dropDuplicates(["job", "batch"])
    reason = F.when(F.col("n_completed") < F.col("n_semantic"), "fragment_exceeds_model_limit")
    told = good.select("job", "n_semantic", "n_completed", reason.alias("skip_reason"))
    return P.knowledge_state(told, batches.groupBy("job").agg(F.count("*").alias("n_batches")))


def observations(store: Store, batches: DataFrame, producer: str) -> DataFrame:
    """(original_id, observation columns) of the answers in the jobs' checkpoints."""
    good = store.read("checkpoints").join(batches.select("job", "batch", "digest"), ["job", "batch", "digest"], "left_semi").dropDuplicates(["job", "batch"])
    answers = good.select("original_id", F.explode("answers").alias("a")).select("original_id", "a.*")
    evidence = answers.select("evidence_id").distinct()
    return K.candidate_observations(answers, evidence, producer).join(answers.select("evidence_id", "original_id").distinct(), "evidence_id")
