"""Queries on jobs, publication, checkpoints and snapshots, with their SQL.

The driver's ``documents`` play the manifest: their numbers decide, by remainders, which items are deleted, published,
stale or queued, and the SQL says the same remainders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import archive as A
from ..operators import jobs as J
from ..operators import publication as P
from . import tables as D
from .registry import query

MODEL, LIMIT, NOW = "knowledge/1 m r", 4096, 1_800_000_000_000


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.bronze(spark, sf_dir).withColumn("deleted", F.col("doc_id") % 9 == 0)


def published(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = D.bronze(spark, sf_dir).where("doc_id % 3 > 0").withColumn("title", F.when(F.col("doc_id") % 4 == 0, "old").otherwise(F.col("title")))
    det = J.deterministic_input(F.col("id"), F.col("hash"), F.col("title"), F.col("mime"))
    five = F.col("doc_id") % 5
    state = F.when(five == 0, "ready").when(five == 1, "processing").when(five == 2, "partial").when(five == 3, "failed").otherwise("unavailable")
    skipped = F.col("doc_id") % 10 == 7
    return b.select(
        "id", "hash", "title", "mime", F.when(skipped, "skipped").otherwise("ready").alias("det_state"), F.lit(J.EXTRACTION).alias("det_producer"), det.alias("det_input"),
        F.when(skipped, F.when(F.col("doc_id") % 20 == 7, "skipped").otherwise("ready")).otherwise(state).alias("know_state"),
        F.when(five == 2, "knowledge/0").otherwise(MODEL).alias("know_producer"), J.knowledge_input(det, LIMIT).alias("know_input"), "doc_id",
    )


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One job for each item whose number is 0, 1, 3 or 5 modulo 6; those with 3 were made for other bytes."""
    b = D.bronze(spark, sf_dir).withColumn("six", F.col("doc_id") % 6).where("six in (0, 1, 3, 5)")
    hash_ = F.when(F.col("six") == 3, F.sha2("hash", 256)).otherwise(F.col("hash"))
    det = J.deterministic_input(F.col("id"), hash_, F.col("title"), F.col("mime"))
    knows = F.col("six") == 1
    return b.select(
        F.format_string("job-%d", "doc_id").alias("job_id"), F.col("doc_id").alias("seq"), F.col("id").alias("original_id"), hash_.alias("hash"), "title", "mime",
        F.when(knows, J.KNOWLEDGE).otherwise(J.DETERMINISTIC).alias("representation"), F.when(knows, MODEL).otherwise(J.EXTRACTION).alias("producer"),
        F.when(knows, J.knowledge_input(det, LIMIT)).otherwise(det).alias("input"),
        F.when(F.col("six") == 0, "queued").when(F.col("six") == 1, "failed").when(F.col("six") == 3, "running").otherwise("completed").alias("state"),
        (F.col("doc_id") % 4).cast("int").alias("attempts"), (F.col("doc_id") % 8 > 3).alias("retryable"), (F.lit(NOW - 500) + F.col("doc_id") % 1000).alias("retry_at"),
        (F.col("doc_id") % 5).cast("int").alias("n_checkpoints"), (F.col("doc_id") % 5 + F.col("doc_id") % 3).cast("int").alias("n_batches"),
    )


STATE_SQL = f"""{D.BRONZE_SQL}, m AS (SELECT * REPLACE (doc_id % 9 = 0 AS deleted) FROM bronze),
p AS (SELECT doc_id, id, doc_id % 4 > 0 AND NOT m.deleted IS NULL AS same, doc_id % 10 = 7 AS skipped, doc_id % 5 AS five FROM m WHERE doc_id % 3 > 0),
c AS (SELECT m.doc_id, m.id, m.deleted, p.id IS NOT NULL AS is_published, coalesce(p.same, false) AS det_current,
        coalesce(p.same AND CASE WHEN skipped THEN doc_id % 20 = 7 ELSE five = 0 END, false) AS know_model,
        coalesce(p.same AND CASE WHEN skipped THEN doc_id % 20 = 7 ELSE five IN (0, 2) END, false) AS know_none,
        CASE WHEN skipped THEN true ELSE five IN (0, 2) END AS know_complete
      FROM m LEFT JOIN p USING (doc_id)),
j AS (SELECT 'job-' || doc_id AS job_id, doc_id, id AS original_id, deleted, doc_id % 6 AS six, CASE WHEN doc_id % 6 = 1 THEN 'knowledge' ELSE 'deterministic' END AS representation,
        CASE doc_id % 6 WHEN 0 THEN 'queued' WHEN 1 THEN 'failed' WHEN 3 THEN 'running' ELSE 'completed' END AS state, doc_id % 6 <> 3 AS matches FROM m WHERE doc_id % 6 IN (0, 1, 3, 5))"""


@query(f"WITH {STATE_SQL} SELECT id, det_current, know_model AS know_current, is_published, CASE WHEN deleted OR know_model THEN NULL WHEN NOT det_current THEN 'deterministic' ELSE 'knowledge' END AS representation FROM c")
def needed_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each item still needs, given what is published."""
    return J.needed(manifest(spark, sf_dir), published(spark, sf_dir), MODEL, LIMIT).select("id", "det_current", "know_current", "is_published", "representation")


@query(
    f"""WITH {STATE_SQL}, need AS (SELECT id, CASE WHEN deleted OR know_model THEN NULL WHEN NOT det_current THEN 'deterministic' ELSE 'knowledge' END AS representation FROM c),
new AS (SELECT id, representation FROM need WHERE representation IS NOT NULL AND NOT EXISTS (SELECT 1 FROM j WHERE j.original_id = need.id AND j.representation = need.representation AND matches))
SELECT job_id, original_id, representation, CASE WHEN NOT deleted AND NOT matches THEN 'cancelled' ELSE state END AS state, CASE WHEN deleted THEN 'removed' WHEN NOT matches THEN 'cancelled' ELSE 'kept' END AS change FROM j
UNION ALL SELECT 'job-' || (1000000 + row_number() OVER (ORDER BY id)), id, representation, 'queued', 'new' FROM new"""
)
def job_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs after the manifest was taken in."""
    return J.planned(manifest(spark, sf_dir), published(spark, sf_dir), jobs(spark, sf_dir), MODEL, LIMIT, 1_000_000)


@query(f"WITH {STATE_SQL} SELECT id, CASE WHEN deleted THEN 'removed' WHEN det_current AND NOT know_none AND NOT know_complete AND five <> 4 THEN 'unavailable' WHEN det_current AND NOT know_none AND NOT know_complete THEN 'unavailable' ELSE 'kept' END AS change FROM c JOIN p USING (doc_id, id)")
def publication_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a manifest changes in the published sources of an archive without a model."""
    return J.publication_changes(manifest(spark, sf_dir), published(spark, sf_dir))


@query(f"WITH {STATE_SQL} SELECT job_id, original_id FROM j WHERE state = 'queued' ORDER BY doc_id LIMIT 1")
def next_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.next_job(jobs(spark, sf_dir)).select("job_id", "original_id")


@query(f"WITH {STATE_SQL} SELECT 'run-' || job_id AS job_id, CASE WHEN deleted THEN 'fail' WHEN NOT matches THEN 'cancel' ELSE 'process' END AS action FROM j UNION ALL SELECT 'lost-' || job_id, 'fail' FROM j WHERE doc_id % 50 = 0")
def job_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running jobs against the manifest as it is now; some of them are of items that the manifest never had."""
    j = jobs(spark, sf_dir).withColumn("state", F.lit("running"))
    lost = j.where("seq % 50 = 0").withColumns({"job_id": F.concat(F.lit("lost-"), "job_id"), "original_id": F.lit("none")})
    return J.dispatched(j.withColumn("job_id", F.concat(F.lit("run-"), "job_id")).unionByName(lost), manifest(spark, sf_dir), MODEL, LIMIT)


@query(
    f"""WITH {STATE_SQL} SELECT job_id, CASE WHEN six = 3 AND doc_id % 2 = 1 THEN 'failed' ELSE state END AS state, CASE WHEN six = 3 THEN 'error ' || doc_id END AS error,
CASE WHEN six = 3 THEN doc_id % 5 <> 0 ELSE doc_id % 8 > 3 END AS retryable, CAST(doc_id % 4 + CASE WHEN six = 3 THEN 1 ELSE 0 END AS INTEGER) AS attempts,
CASE WHEN six <> 3 THEN {NOW} - 500 + doc_id % 1000 WHEN doc_id % 5 = 0 THEN 0 ELSE {NOW} + CAST(1000 * pow(2, doc_id % 4) AS BIGINT) END AS retry_at FROM j"""
)
def job_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running jobs meet errors, every fifth number's for good."""
    j = jobs(spark, sf_dir)
    errors = j.where("seq % 3 = 0").select("job_id", F.concat(F.lit("error "), F.col("seq").cast("string")).alias("error"), (F.col("seq") % 5 == 0).alias("permanent"))
    return J.failed(j, errors, F.lit(NOW)).drop("original_id")


@query(f"WITH {STATE_SQL} SELECT job_id, CASE WHEN six = 3 THEN 'queued' WHEN six = 1 AND doc_id % 8 > 3 AND doc_id % 1000 <= 500 THEN 'queued' ELSE state END AS state FROM j")
def job_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """After a restart running jobs are queued, and so are failed ones whose next attempt is due."""
    return J.requeued(J.recovered(jobs(spark, sf_dir)), F.lit(NOW)).select("job_id", "state")


@query(f"WITH {STATE_SQL} SELECT original_id, representation, state, CAST(doc_id % 5 AS INTEGER) AS completed_batches, CAST(doc_id % 5 + doc_id % 3 AS INTEGER) AS total_batches, doc_id % 8 > 3 AS retryable FROM j WHERE state <> 'completed'")
def processing_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.processing(jobs(spark, sf_dir))


@query(
    f"""WITH {D.JOB_SQL}, a AS (SELECT * FROM shown UNION ALL SELECT 's' || key, state, queued_at, completed_at FROM shown WHERE key LIKE '%1')
SELECT count(*) FILTER (state = 'queued') AS n_queued, count(*) FILTER (state = 'completed') AS n_completed, CAST(12 AS BIGINT) AS revision,
  (SELECT string_agg(key, ',' ORDER BY completed_at DESC, key DESC) FROM (SELECT key, completed_at FROM a WHERE state = 'completed' ORDER BY completed_at DESC, key DESC LIMIT 5)) AS latest FROM a"""
)
def status_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The archive's status in one row: both job lists, their revisions added."""
    j = D.jobs(spark, sf_dir).select("key", "state", "completed_at")
    return J.status(j, j.where("key like '%1'").withColumn("key", F.concat(F.lit("s"), "key")), 5, 7)


@query(
    f"""WITH {D.BRONZE_SQL} SELECT 'sync-' || doc_id AS job_id, CASE doc_id % 4 WHEN 0 THEN id WHEN 1 THEN id WHEN 2 THEN '' ELSE 'given' END AS original_id, '' AS key, CASE WHEN doc_id % 3 = 0 THEN 'completed' ELSE 'queued' END AS state FROM bronze"""
)
def sync_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    four = F.col("doc_id") % 4
    key = F.when(four < 2, F.concat("id", F.lit(":1:upload"))).when(four == 2, F.concat(F.lit("x:"), "id")).otherwise(F.col("id"))
    j = D.bronze(spark, sf_dir).select(F.format_string("sync-%d", "doc_id").alias("job_id"), F.when(four == 3, "given").when(four == 0, "").alias("original_id"), key.alias("key"), F.when(F.col("doc_id") % 3 == 0, "completed").otherwise("running").alias("state"))
    return J.sync_snapshot(j)


@query("SELECT CAST(o_orderkey AS VARCHAR) AS job_id, CASE WHEN o_orderkey % 3 = 0 OR o_orderkey % 2 = 0 THEN 'completed' ELSE 'queued' END AS state, CASE WHEN o_orderkey % 3 = 0 THEN 1 WHEN o_orderkey % 2 = 0 THEN 9 ELSE 0 END AS completed_at FROM orders")
def sync_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completing jobs twice, or ones that were completed before, changes nothing more."""
    o = D.table(spark, sf_dir, "orders")
    done = F.col("o_orderkey") % 3 == 0
    j = o.select(F.col("o_orderkey").cast("string").alias("job_id"), F.when(done, "completed").otherwise("queued").alias("state"), F.when(done, 1).cast("int").alias("completed_at"))
    ids = o.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").cast("string").alias("job_id"))
    return J.completed_once(j, ids.unionByName(ids), F.lit(9)).withColumn("completed_at", F.coalesce("completed_at", F.lit(0)))


# Snapshots ------------------------------------------------------------------------------------------------------------


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(original_id, kind, id, pos, value): two observations an item and one entity that many share; the entity's value differs."""
    b = D.bronze(spark, sf_dir)
    row = lambda kind, pos, id_: F.struct(F.lit(kind).alias("kind"), F.lit(pos).alias("pos"), id_.alias("id"))
    three = F.array(row("observation", 1, F.concat(F.lit("b"), "id")), row("observation", 0, F.concat(F.lit("a"), "id")), row("entity", 0, F.format_string("e%03d", F.col("doc_id") % 50)))
    return b.select(F.col("id").alias("original_id"), "doc_id", F.explode(three).alias("r")).select("original_id", "r.*", F.concat(F.lit("v"), F.col("doc_id").cast("string")).alias("value"))


RECORD_SQL = f"""{STATE_SQL}, rec AS (SELECT id AS original_id, k.kind, k.pos, CASE k.n WHEN 0 THEN 'b' || id WHEN 1 THEN 'a' || id ELSE format('e{{:03d}}', doc_id % 50) END AS rid, 'v' || doc_id AS value
  FROM bronze, (VALUES (0, 'observation', 1), (1, 'observation', 0), (2, 'entity', 0)) k(n, kind, pos)), live AS (SELECT c.id FROM c WHERE is_published AND NOT deleted AND det_current)"""


@query(f"WITH {RECORD_SQL} SELECT kind, rid AS id, arg_max(value, original_id) AS value, count(*) AS n_sources FROM rec JOIN live ON live.id = original_id GROUP BY kind, rid")
def snapshot_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of the live sources, each id once: the last source that has it tells its value."""
    live = P.live_sources(published(spark, sf_dir), manifest(spark, sf_dir)).select("id")
    return P.latest_records(records(spark, sf_dir).join(live.withColumnRenamed("id", "original_id"), "original_id", "left_semi"))


@query(
    f"""WITH {RECORD_SQL} SELECT live.id, NOT coalesce(det_current, false) AS stale, string_agg(rid, ',' ORDER BY pos, rid) FILTER (kind = 'observation') AS observation_ids, string_agg(rid, ',' ORDER BY pos, rid) FILTER (kind = 'entity') AS entity_ids
FROM live JOIN c USING (id) JOIN rec ON rec.original_id = live.id GROUP BY ALL"""
)
def snapshot_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live sources with the ids of their records in order and whether they are stale."""
    m = manifest(spark, sf_dir)
    stale = J.currency(m, published(spark, sf_dir), MODEL, LIMIT).select("id", (~F.col("det_current")).alias("stale"))
    found = P.with_ids(P.live_sources(published(spark, sf_dir), m).select("id").join(stale, "id"), records(spark, sf_dir), ["observation", "entity"])
    return found.withColumns({c: F.array_join(c, ",") for c in ("observation_ids", "entity_ids")})


@query(f"WITH {RECORD_SQL} SELECT live.id, string_agg(rid, ',' ORDER BY pos, rid) AS observation_ids FROM live JOIN rec ON rec.original_id = live.id WHERE kind = 'observation' AND pos = 0 GROUP BY ALL")
def deterministic_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The snapshot that later representations read: records of the extraction alone."""
    r = records(spark, sf_dir).withColumn("producer", F.when(F.col("pos") == 0, J.EXTRACTION).otherwise(MODEL))
    live = P.live_sources(published(spark, sf_dir), manifest(spark, sf_dir)).select("id")
    return P.with_ids(live, P.deterministic(r), ["observation"]).withColumn("observation_ids", F.array_join("observation_ids", ","))


# Checkpoints and publication ------------------------------------------------------------------------------------------


def checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(job, batch_index, batch_sha256, n_semantic, n_completed, skip_reason): order lines as batches of their order."""
    li = D.table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("job"), (F.col("l_linenumber") - 1).cast("int").alias("batch_index"), F.sha2(F.concat_ws("|", F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")), 256).alias("batch_sha256"),
        F.col("l_quantity").cast("bigint").alias("n_semantic"), F.when(F.col("l_suppkey") % 3 == 0, F.lit(0)).otherwise(F.col("l_quantity")).cast("bigint").alias("n_completed"),
        F.when(F.col("l_suppkey") % 3 == 0, F.when(F.col("l_partkey") % 2 == 0, "model_contract").otherwise("too_large")).alias("skip_reason"),
    )


CHECKPOINT_SQL = """cp AS (SELECT l_orderkey AS job, CAST(l_linenumber - 1 AS INTEGER) AS batch_index, sha256(l_partkey || '|' || l_suppkey) AS batch_sha256, CAST(l_quantity AS BIGINT) AS n_semantic,
  CAST(CASE WHEN l_suppkey % 3 = 0 THEN 0 ELSE l_quantity END AS BIGINT) AS n_completed, CASE WHEN l_suppkey % 3 = 0 THEN CASE WHEN l_partkey % 2 = 0 THEN 'model_contract' ELSE 'too_large' END END AS skip_reason FROM lineitem)"""


@query(f"WITH {CHECKPOINT_SQL} SELECT DISTINCT job, batch_index FROM cp WHERE NOT (batch_index % 4 = 1) AND batch_index < 5")
def checkpoint_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checkpoints still good for the batches of now: one in four batches changed, and none has a sixth batch; each is stored twice."""
    cp = checkpoints(spark, sf_dir)
    now = cp.where("batch_index < 5").select("job", "batch_index", F.when(F.col("batch_index") % 4 == 1, "other").otherwise(F.col("batch_sha256")).alias("batch_sha256"))
    return P.resumable(cp.unionByName(cp), now).select("job", "batch_index")


@query(f"WITH {CHECKPOINT_SQL} SELECT job, batch_index FROM cp WHERE batch_index % 4 = 1")
def checkpoint_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches that a resumed job still has to extract."""
    cp = checkpoints(spark, sf_dir)
    stored = cp.where("batch_index % 4 <> 1")
    return P.open_batches(cp.select("job", "batch_index", "batch_sha256"), stored).select("job", "batch_index")


@query(
    f"""WITH {CHECKPOINT_SQL}, n AS (SELECT l_orderkey AS job, max(l_linenumber) AS total FROM lineitem GROUP BY 1), ok AS (SELECT * FROM cp WHERE batch_index % 7 <> 6 OR job % 2 = 0)
SELECT job, CAST(sum(n_semantic) AS BIGINT) AS n_semantic, CAST(sum(n_completed) AS BIGINT) AS n_completed, coalesce(array_to_string(list_sort(list_distinct(list(skip_reason) FILTER (skip_reason IS NOT NULL))), ','), '') AS reason,
 CASE WHEN count(*) < any_value(total) THEN 'missing_checkpoints' WHEN sum(n_completed) = sum(n_semantic) THEN 'ready' WHEN sum(n_completed) = 0 THEN 'skipped' ELSE 'partial' END AS state FROM ok JOIN n USING (job) GROUP BY job"""
)
def publish_knowledge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The knowledge representation that a job's checkpoints give; jobs without all of them are refused."""
    cp = checkpoints(spark, sf_dir)
    totals = cp.groupBy("job").agg((F.max("batch_index") + 1).alias("n_batches"))
    return P.knowledge_state(cp.where("batch_index % 7 <> 6 or job % 2 = 0"), totals)


# Client ---------------------------------------------------------------------------------------------------------------


@query("SELECT id, CAST(CASE WHEN k IN (0, 1) THEN revision ELSE 0 END AS BIGINT) AS acked_revision, k <> 0 AND k <> 1 AS pending FROM (SELECT format('{:08x}-0000-4000-8000-{:012x}', doc_id, doc_id) AS id, doc_id % 4 AS k, CASE WHEN doc_id % 4 = 1 THEN 2 ELSE 1 END AS revision FROM documents)")
def client_acknowledge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Client items after acknowledgements: those of another revision or other bytes change nothing."""
    b = D.bronze(spark, sf_dir).withColumns({"k": F.col("doc_id") % 4, "acked_revision": F.lit(0).cast("bigint")}).withColumn("revision", F.when(F.col("k") == 1, 2).otherwise(1).cast("bigint")).withColumn("deleted", F.col("k") == 1)
    acks = b.where("k < 3").select("id", F.when(F.col("k") == 2, 9).otherwise(F.col("revision")).cast("bigint").alias("revision"), "hash", "deleted")
    return A.acknowledged(b, acks).select("id", "acked_revision", A.pending().alias("pending"))


@query("SELECT format('{:08x}-0000-4000-8000-{:012x}', doc_id, doc_id) AS id, CAST(CASE WHEN doc_id % 3 = 0 THEN 3 ELSE 2 END AS BIGINT) AS revision, true AS deleted, CASE WHEN doc_id % 3 = 0 THEN doc_id ELSE greatest(500, doc_id + 1) END AS modified FROM documents WHERE doc_id % 2 = 0")
def client_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tombstones of live items a client deletes; those deleted before stay as they are."""
    b = D.bronze(spark, sf_dir).where("doc_id % 2 = 0").withColumns({"modified": F.col("doc_id"), "deleted": F.col("doc_id") % 3 == 0, "revision": F.when(F.col("doc_id") % 3 == 0, 3).otherwise(1).cast("bigint")})
    return A.deleted(b, b.select("id"), F.lit(500)).select("id", "revision", "deleted", "modified")


@query("SELECT doc_id, 'note-' || left(format('{:08x}-0000-4000-8000-{:012x}', doc_id, doc_id), 12) || '.txt' AS title, sha256(coalesce(text, '')) AS hash, CAST(strlen(coalesce(text, '')) AS BIGINT) AS size FROM documents")
def client_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes written on a client as new originals."""
    d = D.table(spark, sf_dir, "documents").select("doc_id", D.item_id(F.col("doc_id")).alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    return A.notes(d, F.lit(7).cast("bigint")).select("doc_id", "title", "hash", "size")


@query("SELECT event_id, CAST(event_id % 7 > event_id % 5 OR (event_id % 7 = event_id % 5 AND event_id % 3 >= 1) AS BOOLEAN) AS installed, event_id % 7 <> event_id % 5 AS fetch FROM events")
def mirror_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a client's mirror fetches a snapshot, and whether it installs one: revisions never go back."""
    e = D.table(spark, sf_dir, "events")
    pair = e.select("event_id", (F.col("event_id") % 7).alias("new_revision"), (F.col("event_id") % 5).alias("revision"), (F.col("event_id") % 3).alias("new_jobs"), F.lit(1).alias("jobs"))
    return pair.select("event_id", A.installs(F.col("new_revision"), F.col("new_jobs"), F.col("revision"), F.col("jobs")).alias("installed"), A.needs_snapshot(F.col("revision"), F.col("new_revision")).alias("fetch"))


@query(
    """SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 0 ELSE 2 END AS schema_version, CASE WHEN event_id % 5 > 0 THEN event_id ELSE 0 END AS revision, CASE WHEN event_id % 5 > 0 THEN CAST(event_id % 3 AS INTEGER) ELSE 0 END AS n_sources,
CASE WHEN event_id % 5 > 0 AND event_id % 3 > 0 THEN 'ready' END AS first_state FROM events"""
)
def snapshot_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots from their JSON: a wrong version or broken text gives the empty snapshot."""
    n = (F.col("event_id") % 3).cast("int")
    source = F.struct(F.lit("i").alias("id"), F.struct(F.struct(F.lit("ready").alias("state"), F.lit("").alias("error")).alias("deterministic")).alias("representations"))
    made = F.to_json(F.struct(F.when(F.col("event_id") % 10 == 5, 1).otherwise(2).alias("schema_version"), F.col("event_id").alias("revision"), F.array_repeat(source, n).alias("sources")))
    rows = D.table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 10 == 0, "{broken").otherwise(made).alias("json"))
    return A.snapshots(rows, "json").select("event_id", F.coalesce("snapshot.schema_version", F.lit(0)).alias("schema_version"), F.coalesce("snapshot.revision", F.lit(0)).alias("revision"), F.coalesce(F.size("snapshot.sources"), F.lit(0)).alias("n_sources"), F.try_element_at("snapshot.sources", F.lit(1))["representations"]["deterministic"]["state"].alias("first_state"))
