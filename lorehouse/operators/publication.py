"""Publication: which sources are live, their records and id lists, checkpoints and the state that they give."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .jobs import EXTRACTION

SAME = ("id", "hash", "title", "mime")


def live_sources(published: DataFrame, manifest: DataFrame) -> DataFrame:
    """Published sources whose item is still there, not deleted, and the same."""
    return published.join(manifest.where(~F.col("deleted")).select(*SAME), list(SAME), "left_semi")


def latest_records(records: DataFrame) -> DataFrame:
    """(kind, id, value, n_sources): one row for each record id, from the last source that has it."""
    return records.groupBy("kind", "id").agg(F.max_by("value", "original_id").alias("value"), F.count("*").alias("n_sources"))


def deterministic(records: DataFrame) -> DataFrame:
    """Records that the extraction alone produced."""
    return records.where(F.col("producer") == EXTRACTION)


def with_ids(sources: DataFrame, records: DataFrame, kinds: list[str]) -> DataFrame:
    """``sources`` (id) with an ordered array of record ids for each of ``kinds``, null where there are none.

    A source is one original of at most 8 MiB, which bounds its records.
    """
    order = lambda k: F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.struct("pos", F.col("record_id").alias("id")))))
    named = records.withColumnsRenamed({"id": "record_id", "original_id": "id"})
    lists = named.groupBy("id").agg(*[order(k).alias(f"_{k}") for k in kinds])
    ids = lambda k: F.when(F.size(f"_{k}") > 0, F.transform(f"_{k}", lambda x: x["id"])).alias(f"{k}_ids")
    return sources.join(lists.select("id", *[ids(k) for k in kinds]), "id", "left")


def of_source(source: DataFrame, records: DataFrame, ids_col: str) -> DataFrame:
    """(original_id, record columns): records whose id is in a source's id array. A source may come in several rows, each
    with a part of its ids; neither side is broadcast, since both grow with the archive."""
    wanted = source.select(F.col("id").alias("original_id"), F.explode(ids_col).alias("id")).distinct()
    return wanted.join(records.hint("merge"), "id")


def resumable(stored: DataFrame, batches: DataFrame) -> DataFrame:
    """Stored checkpoints made for the batches of now, the first of each (job, batch_index)."""
    good = stored.join(batches.select("job", "batch_index", "batch_sha256"), ["job", "batch_index", "batch_sha256"], "left_semi")
    return good.dropDuplicates(["job", "batch_index"])


def open_batches(batches: DataFrame, stored: DataFrame) -> DataFrame:
    """Batches without a checkpoint of their own bytes."""
    return batches.join(stored.select("job", "batch_index", "batch_sha256"), ["job", "batch_index", "batch_sha256"], "left_anti")


def knowledge_state(checkpoints: DataFrame, totals: DataFrame) -> DataFrame:
    """(job, n_semantic, n_completed, reason, state) of each job (job, n_batches) that has a checkpoint.

    The state is ready when every fragment is done, skipped when none is, else partial; a job with fewer checkpoints
    than batches must not be published and is ``missing_checkpoints``.
    """
    per = checkpoints.groupBy("job").agg(
        F.sum("n_semantic").alias("n_semantic"), F.sum("n_completed").alias("n_completed"), F.count("*").alias("_n"), F.array_join(F.array_sort(F.collect_set("skip_reason")), ",").alias("reason")
    )
    state = F.when(F.col("_n") < F.col("n_batches"), "missing_checkpoints").when(F.col("n_completed") == F.col("n_semantic"), "ready").when(F.col("n_completed") == 0, "skipped").otherwise("partial")
    return per.join(totals, "job").select("job", "n_semantic", "n_completed", "reason", state.alias("state"))


def batch_digests(fragments: DataFrame) -> DataFrame:
    """(original_id, batch, n_fragments, digest): SHA-256 of a batch's fragment identities in order; a batch has a bounded size."""
    identity = F.to_json(F.struct("kind", "selector", "payload", "context", "structural_only"))
    ordered = F.array_sort(F.collect_list(F.struct("ordinal", identity.alias("identity"))))
    per = fragments.groupBy("original_id", "batch").agg(F.count("*").alias("n_fragments"), ordered.alias("f"))
    return per.select("original_id", "batch", "n_fragments", F.sha2(F.array_join(F.transform("f", lambda x: x["identity"]), "\n"), 256).alias("digest"))


def first_of(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where("_n = 1").drop("_n")
