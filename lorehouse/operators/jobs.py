"""Processor jobs: what a manifest asks for, how jobs change state, and what is shown of them.

A job is (job_id, seq, original_id, hash, title, mime, representation, producer, input, state, attempts, retryable, retry_at,
n_checkpoints, n_batches). A published source is (id, hash, title, mime, det_state, det_producer, det_input, know_state,
know_producer, know_input). ``input`` is the identity of what a representation was made from.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ordering import numbered
from ..functions.text import stable_id
from .sync import retry_delay

#: Representations, states that need no more work, states that a changed original cancels.
DETERMINISTIC, KNOWLEDGE = "deterministic", "knowledge"
COMPLETE, ACTIVE, ENDED = ("ready", "partial", "skipped"), ("queued", "running", "failed"), ("completed", "cancelled")
EXTRACTION = "format-extraction/1"


def deterministic_input(source: Column, hash_: Column, title: Column, mime: Column) -> Column:
    return stable_id("deterministic-input", F.to_json(F.struct(hash_.alias("hash"), mime.alias("mime"), source.alias("source"), title.alias("title"))))


def knowledge_input(deterministic: Column, most_bytes: int) -> Column:
    return stable_id("knowledge-input", F.to_json(F.struct(deterministic.alias("deterministic"), F.lit(most_bytes).alias("limit"))))


def complete(state: Column) -> Column:
    return F.coalesce(state.isin(*COMPLETE), F.lit(False))


def _wanted(manifest: DataFrame, model: str | None, most_bytes: int) -> DataFrame:
    """The manifest with the producer and input that each representation has to come from now."""
    det = deterministic_input(F.col("id"), F.col("hash"), F.col("title"), F.col("mime"))
    named = manifest.select("id", "deleted", "hash", "title", "mime", det.alias("want_det"))
    return named.withColumns({"want_know": knowledge_input(F.col("want_det"), most_bytes), "want_producer": F.lit(model)})


def currency(manifest: DataFrame, published: DataFrame, model: str | None = None, most_bytes: int = 0) -> DataFrame:
    """Manifest items with ``det_current``, ``know_current`` and ``is_published``.

    Without a model any finished knowledge is current, and so is an item marked as unavailable for this very input. Of an
    item whose deterministic representation was skipped only a skipped knowledge is.
    """
    names = ("hash", "title", "mime", "det_state", "det_producer", "det_input", "know_state", "know_producer", "know_input")
    done = published.select("id", *[F.col(c).alias(f"has_{c}") for c in names], F.lit(True).alias("_there"))
    both = _wanted(manifest, model, most_bytes).join(done, "id", "left")
    same = (F.col("has_hash") == F.col("hash")) & (F.col("has_title") == F.col("title")) & (F.col("has_mime") == F.col("mime"))
    det = same & complete(F.col("has_det_state")) & (F.col("has_det_producer") == EXTRACTION) & (F.col("has_det_input") == F.col("want_det"))
    own = F.col("has_know_producer").eqNullSafe(F.col("want_producer")) & F.col("has_know_input").eqNullSafe(F.col("want_know"))
    state = F.col("has_know_state")
    know = complete(state) | (state == "unavailable") & own if model is None else complete(state) & own
    know = F.when(F.col("has_det_state") == "skipped", state == "skipped").otherwise(know)
    sure = lambda c: F.coalesce(c, F.lit(False))
    out = both.withColumns({"is_published": sure(F.col("_there")), "det_current": sure(det)})
    return out.withColumn("know_current", F.col("det_current") & sure(know)).drop("_there", *[f"has_{c}" for c in names if c != "know_state"])


def needed(manifest: DataFrame, published: DataFrame, model: str | None = None, most_bytes: int = 0) -> DataFrame:
    """``currency`` with ``representation``: what each live item still needs, null for nothing."""
    rows = currency(manifest, published, model, most_bytes)
    want = F.when(F.col("deleted") | F.col("know_current"), F.lit(None).cast("string")).when(~F.col("det_current"), DETERMINISTIC)
    return rows.withColumn("representation", want.when(F.lit(model is not None), KNOWLEDGE))


def matched(jobs: DataFrame, manifest: DataFrame, model: str | None = None, most_bytes: int = 0) -> DataFrame:
    """Jobs with ``known`` (their item is in the manifest), ``deleted`` and ``matches``: made for the item as it is now."""
    now = _wanted(manifest, model, most_bytes).select(F.col("id").alias("original_id"), "deleted", *[F.col(c).alias(f"now_{c}") for c in ("hash", "title", "mime")], "want_det", "want_know", "want_producer")
    both = jobs.join(now, "original_id", "left")
    same = (F.col("hash") == F.col("now_hash")) & (F.col("title") == F.col("now_title")) & (F.col("mime") == F.col("now_mime"))
    det = (F.col("producer") == EXTRACTION) & (F.col("input") == F.col("want_det"))
    know = F.col("producer").eqNullSafe(F.col("want_producer")) & (F.col("input") == F.col("want_know"))
    fits = F.coalesce(same & F.when(F.col("representation") == DETERMINISTIC, det).otherwise(know), F.lit(False))
    return both.select(*jobs.columns, F.col("now_hash").isNotNull().alias("known"), F.coalesce("deleted", F.lit(False)).alias("deleted"), fits.alias("matches"))


def planned(manifest: DataFrame, published: DataFrame, jobs: DataFrame, model: str | None = None, most_bytes: int = 0, last_number: int = 0) -> DataFrame:
    """(job_id, original_id, representation, state, change): jobs after a manifest was taken in.

    Jobs of deleted items go (``removed``). Active jobs made for an item as it no longer is are ``cancelled``. An item
    that needs a representation gets one new job, unless a job that is not cancelled was made for just that; new jobs are
    numbered on from ``last_number`` in the order of their items.
    """
    placed = matched(jobs, manifest, model, most_bytes)
    gone = F.col("known") & F.col("deleted")
    change = F.when(gone, "removed").when(F.col("known") & ~F.col("matches") & F.col("state").isin(*ACTIVE), "cancelled").otherwise("kept")
    old = placed.select("job_id", "original_id", "representation", F.when(change == "cancelled", "cancelled").otherwise(F.col("state")).alias("state"), change.alias("change"))
    there = placed.where("matches and state <> 'cancelled'").select(F.col("original_id").alias("id"), "representation").distinct()
    new = needed(manifest, published, model, most_bytes).where("representation is not null").join(there, ["id", "representation"], "left_anti")
    new = numbered(new.select("id", "representation"), "id", "number", last_number)
    added = new.select(F.concat(F.lit("job-"), F.col("number").cast("string")).alias("job_id"), F.col("id").alias("original_id"), "representation", F.lit("queued").alias("state"), F.lit("new").alias("change"))
    return old.unionByName(added)


def publication_changes(manifest: DataFrame, published: DataFrame, model: str | None = None, most_bytes: int = 0) -> DataFrame:
    """(id, change) of published sources: removed with their item, ``unavailable`` where knowledge has no model, else kept."""
    rows = currency(manifest, published, model, most_bytes).where("is_published")
    missing = F.col("det_current") & ~F.col("know_current") & F.lit(model is None) & ~complete(F.col("has_know_state"))
    return rows.select("id", F.when(F.col("deleted"), "removed").when(missing, "unavailable").otherwise("kept").alias("change"))


def next_job(jobs: DataFrame) -> DataFrame:
    """The queued job that was accepted first."""
    return jobs.where("state = 'queued'").orderBy("seq").limit(1)


def dispatched(jobs: DataFrame, manifest: DataFrame, model: str | None = None, most_bytes: int = 0) -> DataFrame:
    """(job_id, action) of running jobs: process, cancel because the item changed, or fail for good because it is gone."""
    rows = matched(jobs.where("state = 'running'"), manifest, model, most_bytes)
    knows = F.col("representation") == KNOWLEDGE
    action = F.when(~F.col("known") | F.col("deleted"), "fail").when(~F.col("matches") | knows & F.lit(model is None), "cancel").when(F.col("representation").isin(DETERMINISTIC, KNOWLEDGE), "process").otherwise("fail")
    return rows.select("job_id", action.alias("action"))


def failed(jobs: DataFrame, errors: DataFrame, now: Column) -> DataFrame:
    """Jobs after their ``errors`` (job_id, error, permanent): another attempt is due later unless the error is permanent."""
    rows = jobs.join(errors.select("job_id", "error", "permanent"), "job_id", "left")
    hit = F.col("error").isNotNull() & (F.col("state") == "running")
    attempts = F.col("attempts") + F.when(hit, 1).otherwise(0)
    again = ~F.coalesce("permanent", F.lit(False))
    at = F.when(again, now + retry_delay(F.greatest(attempts, F.lit(1)))).otherwise(F.lit(0))
    return rows.select(
        "job_id", "original_id", F.when(hit, "failed").otherwise(F.col("state")).alias("state"), F.when(hit, F.col("error")).alias("error"),
        F.when(hit, again).otherwise(F.col("retryable")).alias("retryable"), attempts.cast("int").alias("attempts"), F.when(hit, at).otherwise(F.col("retry_at")).cast("bigint").alias("retry_at"),
    )


def requeued(jobs: DataFrame, now: Column) -> DataFrame:
    """Jobs with those whose next attempt is due queued again."""
    due = (F.col("state") == "failed") & F.col("retryable") & (F.col("retry_at") > 0) & (F.col("retry_at") <= now)
    return jobs.withColumn("state", F.when(F.coalesce(due, F.lit(False)), "queued").otherwise(F.col("state")))


def recovered(jobs: DataFrame) -> DataFrame:
    """Jobs as they are taken up after a restart: what was running is queued again."""
    return jobs.withColumn("state", F.when(F.col("state") == "running", "queued").otherwise(F.col("state")))


def processing(jobs: DataFrame) -> DataFrame:
    """Unfinished jobs with their progress, by source."""
    return jobs.where(~F.col("state").isin(*ENDED)).select("original_id", "representation", "state", F.col("n_checkpoints").alias("completed_batches"), F.col("n_batches").alias("total_batches"), "retryable").orderBy("original_id", "representation")


def status(sync_jobs: DataFrame, processor_jobs: DataFrame, sync_revision: int, processor_revision: int, shown: int = 5) -> DataFrame:
    """One row: the revisions' sum, full counts by state, and the newest completed keys; jobs are (key, state, completed_at)."""
    view = F.when(F.col("state") == "completed", "completed").otherwise("queued")
    rows = sync_jobs.unionByName(processor_jobs).where("state <> 'cancelled'").withColumn("state", view)
    counts = rows.agg(F.count_if(F.col("state") == "queued").alias("n_queued"), F.count_if(F.col("state") == "completed").alias("n_completed"))
    newest = rows.where("state = 'completed'").orderBy(F.desc("completed_at"), F.desc("key")).limit(shown)
    order = F.array_sort(F.collect_list(F.struct((-F.col("completed_at")).alias("at"), "key")), lambda a, b: F.when(a["at"] != b["at"], F.when(a["at"] < b["at"], -1).otherwise(1)).when(a["key"] > b["key"], -1).when(a["key"] < b["key"], 1).otherwise(0))
    names = newest.agg(F.array_join(F.transform(order, lambda j: j["key"]), ",").alias("latest"))
    one = F.lit(sync_revision + processor_revision).cast("bigint").alias("revision")
    return counts.select("*", one).join(names.select("*", one), "revision")


#: Fixed value: the shape of an original's id.
ITEM_ID = r"^[0-9a-f-]{36}$"


def key_source(key: Column) -> Column:
    """The original's id before the first colon of a synchronisation key; empty if there is none."""
    head = F.substring_index(key, ":", 1)
    return F.when(F.contains(key, F.lit(":")) & head.rlike(ITEM_ID), head).otherwise("")


def sync_snapshot(jobs: DataFrame) -> DataFrame:
    """Synchronisation jobs as shown: a missing source id comes from the key, and the key itself is blank."""
    source = F.when(F.coalesce("original_id", F.lit("")) == "", key_source(F.col("key"))).otherwise(F.col("original_id"))
    return jobs.withColumns({"original_id": source, "key": F.lit(""), "state": F.when(F.col("state") == "completed", "completed").otherwise("queued")})


def completed_once(jobs: DataFrame, job_ids: DataFrame, now: Column) -> DataFrame:
    """Jobs after completion of ``job_ids`` (job_id); those completed before keep their time."""
    rows = jobs.join(job_ids.select("job_id", F.lit(True).alias("_done")).distinct(), "job_id", "left")
    hit = F.col("_done").isNotNull() & (F.col("state") != "completed")
    return rows.withColumns({"completed_at": F.when(hit, now).otherwise(F.col("completed_at")), "state": F.when(hit, "completed").otherwise(F.col("state"))}).drop("_done")


def background_work(paired: bool, foreground: bool, pending: int) -> bool:
    """Whether a client without a screen should synchronise."""
    return paired and not foreground and pending > 0


def backoff(attempt: Column, first: int = 30_000) -> Column:
    """Milliseconds before a client's background work is tried again."""
    return (F.lit(first) * F.pow(F.lit(2), attempt - 1)).cast("bigint")
