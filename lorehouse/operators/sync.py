"""Reconciliation, job state and synchronisation plans as full-outer diffs with an action per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ITEM = ("hash", "title", "mime")
FIRST_DELAY, LAST_DELAY, DOUBLINGS = 1000, 300_000, 8
SHOWN = 5


def sync_plan(local: DataFrame, remote: DataFrame) -> DataFrame:
    """(id, direction): upload what only or more newly exists here, download the other way, conflict at equal revisions."""
    a = local.select("id", F.col("revision").alias("here"), F.col("hash").alias("hash_here"))
    b = remote.select("id", F.col("revision").alias("there"), F.col("hash").alias("hash_there"))
    both = a.join(b, "id", "full_outer")
    same = (F.col("here") == F.col("there")) & (F.col("hash_here") == F.col("hash_there"))
    direction = (
        F.when(F.col("there").isNull(), "upload")
        .when(F.col("here").isNull(), "download")
        .when(same, "none")
        .when(F.col("here") > F.col("there"), "upload")
        .when(F.col("here") < F.col("there"), "download")
        .otherwise("conflict")
    )
    return both.select("id", direction.alias("direction"))


def sync_key(item_id: Column, revision: Column, direction: Column) -> Column:
    return F.concat_ws(":", item_id, revision.cast("string"), direction)


def invalid_plan_rows(plan: DataFrame) -> DataFrame:
    """Rows (key, original_id, title, direction) that break the rules, and all rows of a key that occurs twice."""
    ok = (F.length("key").between(1, 256)) & ~F.col("key").rlike(r"[\r\n]") & F.col("direction").isin("upload", "download")
    ok = ok & (F.col("original_id").isNull() | F.startswith("key", F.concat("original_id", F.lit(":"))))
    twice = plan.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    wrong = plan.where(~F.coalesce(ok, F.lit(False)))
    return wrong.unionByName(plan.where(F.coalesce(ok, F.lit(False))).join(twice, "key", "left_semi"))


def upsert_jobs(queued: DataFrame, plan: DataFrame, now: Column) -> DataFrame:
    """Queued jobs after a plan: known keys stay, new ones are queued, keys that the plan lacks are completed."""
    wanted = plan.select("key", F.col("title").alias("wanted_title"))
    both = queued.select("key", "title", "queued_at").join(wanted, "key", "full_outer")
    state = F.when(F.col("wanted_title").isNull(), "completed").otherwise("queued")
    return both.select("key", F.coalesce("wanted_title", "title").alias("title"), F.coalesce("queued_at", now).alias("queued_at"), state.alias("state"), F.when(state == "completed", now).alias("completed_at"))


def job_view(jobs: DataFrame) -> DataFrame:
    """Jobs as shown: cancelled ones are hidden, running and failed ones count as queued."""
    return jobs.where("state <> 'cancelled'").withColumn("state", F.when(F.col("state") == "completed", "completed").otherwise("queued"))


def merged_jobs(*lists: DataFrame) -> DataFrame:
    out = lists[0]
    for more in lists[1:]:
        out = out.unionByName(more)
    return job_view(out)


def job_status(jobs: DataFrame) -> DataFrame:
    """(state, n): full counts."""
    return job_view(jobs).groupBy("state").agg(F.count("*").alias("n"))


def latest_completed(jobs: DataFrame, shown: int = SHOWN) -> DataFrame:
    """The newest completed jobs with their rank."""
    order = [F.desc("completed_at"), F.desc("key")]
    done = job_view(jobs).where("state = 'completed'").orderBy(*order).limit(shown)
    return done.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def job_items(jobs: DataFrame, items: DataFrame) -> DataFrame:
    """(key, item_id): the item named by the job's source id, else the only item of its title."""
    by_title = items.groupBy("title").agg(F.count("*").alias("n"), F.min("id").alias("title_id")).where("n = 1").select("title", "title_id")
    by_id = items.select(F.col("id").alias("original_id"), F.col("id").alias("found_id"))
    return jobs.join(by_id, "original_id", "left").join(by_title, "title", "left").select("key", F.coalesce("found_id", "title_id").alias("item_id"))


def reconcile(manifest: DataFrame, published: DataFrame, jobs: DataFrame) -> DataFrame:
    """(id, action): delete, process, wait or keep for each item of the manifest or the published set."""
    names = [F.col(c).alias(f"done_{c}") for c in ITEM]
    done = published.select("id", *names, F.lit(True).alias("is_done"))
    work = jobs.select("id", F.col("hash").alias("job_hash"), F.lit(True).alias("has_job"))
    both = manifest.select("id", "deleted", *ITEM).join(done, "id", "full_outer").join(work, "id", "left")
    current = F.col("is_done").isNotNull()
    for c in ITEM:
        current = current & F.col(c).eqNullSafe(F.col(f"done_{c}"))
    gone = F.coalesce("deleted", F.lit(True))
    action = (
        F.when(gone & F.col("is_done").isNotNull(), "delete")
        .when(gone, "keep")
        .when(current, "keep")
        .when(F.col("has_job").isNotNull() & F.col("job_hash").eqNullSafe(F.col("hash")), "wait")
        .otherwise("process")
    )
    return both.select("id", action.alias("action"))


def stale_sources(manifest: DataFrame, published: DataFrame) -> DataFrame:
    """Published sources with ``stale``: their item is gone, deleted or differs."""
    same = manifest.where(~F.col("deleted")).select("id", *ITEM, F.lit(True).alias("_same"))
    return published.join(same, ["id", *ITEM], "left").select("id", F.col("_same").isNull().alias("stale"))


def retry_delay(retries: Column) -> Column:
    """Milliseconds before the next attempt: doubling from a second, by at most eight doublings."""
    return F.least(F.lit(FIRST_DELAY) * F.pow(F.lit(2), F.least(retries - 1, F.lit(DOUBLINGS))), F.lit(LAST_DELAY)).cast("bigint")


def due(jobs: DataFrame, now: Column) -> DataFrame:
    return jobs.where((F.col("state") == "failed") & F.col("retryable") & (F.col("retry_at") > 0) & (F.col("retry_at") <= now))


def checkpoints_after(old: DataFrame, new: DataFrame) -> DataFrame:
    """Checkpoints with those of ``new`` in place of equal (job, batch_index)."""
    return old.join(new, ["job", "batch_index"], "left_anti").unionByName(new)


def reindexed(items: DataFrame, order_col: str = "position", by: str = "desktop") -> DataFrame:
    """Positions 0..n-1 again, in their order within each desktop."""
    return items.withColumn(order_col, F.row_number().over(Window.partitionBy(by).orderBy(order_col)) - 1)
