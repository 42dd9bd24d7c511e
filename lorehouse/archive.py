"""The archive as an object: originals in, fragments, knowledge and search out, synchronisation and its state, on stored tables.

Originals, blobs, published states, fragments, knowledge and its checkpoints lie in one ``Store``: a change is one commit of
what it adds, and of two writers that start from the same version one fails and decides anew. ``process`` drives the jobs
that the changes ask for as a stream (``streaming.jobs``).
"""

from __future__ import annotations

import time
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .functions.ordering import numbered
from .operators import bronze, jobs, runs, sync
from .operators.index import SearchIndex
from .operators.knowledge import Extractor
from .sources import ingest
from .sources.store import Conflict, Store, latest
from .sources.versioned import VersionedTable
from .streaming import jobs as machine

JOB = "job_id string, key string, original_id string, title string, direction string, state string, queued_at bigint, completed_at bigint"
PARSED = "original_id string, ordinal int, kind string, selector string, excerpt string, payload string, text string, context string, structural_only boolean"
TABLES = {
    "items": bronze.SCHEMA,
    "blobs": "hash string, content binary",
    "acts": f"{bronze.SCHEMA}, action string",
    "jobs": machine.TRANSITION,
    "published": "original_id string, hash string, title string, mime string, det_state string, know_state string, know_producer string, reason string, live boolean",
    "fragments": f"job string, {PARSED}",
    "observations": "job string, original_id string, observation_id string, kind string, payload string, evidence_id string, confidence double, producer string",
    "batches": f"job string, title string, mime string, {PARSED}, batch int, digest string, evidence_id string",
    "checkpoints": runs.CHECKPOINT,
}
#: Attempts of a commit that other writers overtake.
ATTEMPTS = 5


class Archive:
    """Originals, their blobs, jobs and the search index under one shared folder.

    ``on_commit`` is called with the actions of every batch of commits, ``on_publish`` with the index's actions.
    """

    def __init__(self, spark: SparkSession, path: str, on_commit: Callable[[DataFrame], None] | None = None, on_publish: Callable[[DataFrame], None] | None = None):
        self.spark, self.on_commit, self.on_publish = spark, on_commit, on_publish
        self.path = path.rstrip("/")
        self.store = Store(spark, f"{self.path}/store", TABLES)
        self.sync_jobs = VersionedTable(spark, f"{self.path}/jobs", JOB)
        self.index = SearchIndex(spark, f"{self.path}/index")

    def items(self, upto: int | None = None) -> DataFrame:
        return latest(self.store.read("items", upto=upto), "id").drop("_version")

    def blobs(self) -> DataFrame:
        return self.store.read("blobs").drop("_version")

    def manifest(self) -> DataFrame:
        return bronze.manifest(self.items())

    def get(self, item_id: str) -> DataFrame:
        return bronze.item(self.items(), item_id)

    def content(self, item_id: str) -> DataFrame:
        """The bytes of a live original; no row for a tombstone."""
        return bronze.readable(self.get(item_id), self.blobs()).select("id", "content")

    def put(self, uploads: DataFrame) -> DataFrame:
        """Commit originals (item columns, content): (id, action) with ``rejected`` for bytes that are not as declared.

        Items and blobs are one commit, of what is new alone. A commit that another writer overtook is decided anew.
        """
        for _ in range(ATTEMPTS):
            try:
                told = self._put(uploads, self.store.version())
                break
            except Conflict:
                continue
        else:
            raise Conflict(f"{self.path}: other writers were faster {ATTEMPTS} times")
        if self.on_commit:
            self.on_commit(told)
        return told

    def _put(self, uploads: DataFrame, after: int) -> DataFrame:
        store, v = self.store, after + 1
        names = [c.split()[0] for c in bronze.SCHEMA.split(", ")]
        live = uploads.where(~F.col("deleted"))
        good = bronze.verified(live)
        bad = live.join(good.select("id"), "id", "left_anti").select(*names, F.lit("rejected").alias("action"))
        incoming = good.select(*names).unionByName(uploads.where("deleted").select(*names))
        decided = store.stage("acts", bronze.commit_actions(self.items(after), incoming).unionByName(bad))
        acts = store.staged("acts", decided, v)
        added = acts.where("action in ('insert', 'tombstone')").select(*names)
        inserted = good.join(acts.where("action = 'insert'").select("id"), "id", "left_semi").select("hash", "content")
        fresh = bronze.new_blobs(inserted, store.read("blobs", upto=after).select("hash"))
        if added.isEmpty():
            store.commit({"acts": [decided]}, after, reads=("items",))
        else:
            store.commit({"acts": [decided], "items": [store.stage("items", added)], "blobs": [store.stage("blobs", fresh)]}, after, reads=("items", "blobs"))
        return acts.select("id", "action")

    def prune(self) -> None:
        """Drop blobs that no live original has, and the files of versions that are gone."""
        after = self.store.version()
        blobs = self.store.read("blobs", upto=after)
        unused = bronze.unused_blobs(blobs, self.items(after)).select("hash")
        self.store.append({"blobs": blobs.join(unused, "hash", "left_anti")}, after, replaced=["blobs"])
        self.store.vacuum()

    def originals(self) -> DataFrame:
        """Live originals as the ingest chain takes them."""
        return bronze.readable(self.items(), self.blobs()).select(F.col("id").alias("original_id"), "title", "mime", "content")

    def fragments(self) -> DataFrame:
        return ingest.fragments(self.originals())

    # Jobs.

    def feed(self) -> int:
        """Tell the job stream of the items that changed since it was last told; how many commits that were. A folder is
        named by the commits it tells of, so telling twice writes the same events."""
        now, told = self.store.version(), int(self.store.facts().get("fed", 0))
        if self.store.folders("items", told):
            kind = F.when(F.col("deleted"), "deleted").otherwise("item")
            events = self._events(self.store.read("items", told), F.col("id"), kind, F.col("modified"), F.col("_version"))
            events.write.mode("overwrite").parquet(f"{self.path}/events/items-{told}")
            self.store.add({}, {"fed": now})
            return now - told
        return 0

    @staticmethod
    def _events(rows: DataFrame, original: Column, kind: Column, at: Column, seq: Column) -> DataFrame:
        there = set(rows.columns)
        column = lambda name, kind_: F.col(name) if name in there else F.lit(None).cast(kind_)
        named = [(n, k) for n, k in (c.split() for c in machine.EVENT.split(", ")) if n not in ("original_id", "at", "seq", "kind")]
        return rows.select(original.alias("original_id"), at.cast("bigint").alias("at"), seq.cast("bigint").alias("seq"), kind.alias("kind"), *[column(n, k).cast(k).alias(n) for n, k in named])

    def restart(self) -> None:
        """Queue again what was running when the process ended."""
        running = self.jobs().where("state = 'running'").select("original_id").distinct()
        now = int(time.time() * 1000)
        self._events(running, F.col("original_id"), F.lit("restart"), F.lit(now), F.lit(0)).write.parquet(f"{self.path}/events/restart-{now}")

    def jobs(self) -> DataFrame:
        """Every job as its last change left it."""
        return latest(self.store.read("jobs").drop("_version").withColumn("_version", F.col("step")), "job_id").drop("_version")

    def published(self) -> DataFrame:
        """(original_id, hash, title, mime, det_state, know_state, reason) of originals whose item is live and still the same."""
        last = latest(self.store.read("published"), "original_id").where("live").drop("_version", "live")
        live = self.items().where("not deleted").select(F.col("id").alias("original_id"), "hash", "title", "mime")
        return last.join(live, ["original_id", "hash", "title", "mime"], "left_semi")

    def process(self, extractor: Extractor | None = None, model: str | None = None, every: str = "1 second", target: int = 4096, after_wave: Callable[[int], None] | None = None) -> StreamingQuery:
        """Start the stream that runs the jobs: extraction of originals that changed, then knowledge of those that are ready,
        if ``extractor`` and the ``model``'s name are given. Attempts that failed are due again by timers.

        The session keeps the state in RocksDB. A batch that is replayed does nothing twice: it is known by its number, its
        results by their jobs, and the events that it sends on by their folder.
        """
        self.spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        self.feed()
        self._events(self.items().limit(0), F.col("id"), F.lit("item"), F.lit(0), F.lit(0)).write.mode("overwrite").parquet(f"{self.path}/events/none")
        changes = machine.transitions(self.spark.readStream.schema(machine.EVENT).option("recursiveFileLookup", "true").parquet(f"{self.path}/events"), model)

        def sink(batch: DataFrame, number: int) -> None:
            # All of a batch has to be computed, or the state takes no step; a replay's rows are there already.
            held = batch.persist()
            if held.count() and int(self.store.facts().get("job_batch", -1)) < number:
                self.store.add({"jobs": [self.store.stage("jobs", held)]}, {"job_batch": number})
            held.unpersist()
            self._work(number, extractor, model, target, after_wave)
            self.feed()

        return changes.writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", f"{self.path}/jobs-checkpoint").trigger(processingTime=every).start()

    def _commit(self, write: Callable[[int], int]) -> None:
        for k in range(ATTEMPTS):
            try:
                write(self.store.version())
                return
            except Conflict:
                if k + 1 == ATTEMPTS:
                    raise

    def _work(self, number: int, extractor: Extractor | None, model: str | None, target: int, after_wave: Callable[[int], None] | None) -> None:
        """Run what is queued and not yet told to have ended; send the outcomes on as events."""
        queued = self.jobs().where("state = 'queued'").select("job_id", "original_id", "representation", "hash", "title", "mime", "attempts")
        mine = queued.where(F.col("representation") == jobs.DETERMINISTIC)
        if not mine.isEmpty():
            self._extract(mine)
        told = []
        if extractor is not None and not (mine := queued.where(F.col("representation") == jobs.KNOWLEDGE)).isEmpty():
            told = [self._know(mine, extractor, model or "", target, after_wave)]
        done = self.store.read("published").where("live").select(F.col("original_id"), "hash", "title", "mime", "det_state").join(queued.where(F.col("representation") == jobs.DETERMINISTIC), ["original_id", "hash", "title", "mime"])
        now = int(time.time() * 1000)
        events = self._events(done.dropDuplicates(["job_id"]).withColumn("state", F.col("det_state")), F.col("original_id"), F.lit("done"), F.lit(now), F.lit(number))
        for more in told:
            events = events.unionByName(self._events(more, F.col("original_id"), F.col("kind"), F.lit(now), F.lit(number)))
        if not events.isEmpty():
            events.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/events/batch-{number}")  # one row a job of the batch

    def _extract(self, mine: DataFrame) -> None:
        """Parse queued originals and publish outcome and fragments in one commit, of those that are still as they were."""

        def write(after: int) -> int:
            live = self.items(after).where("not deleted").select(F.col("id").alias("original_id"), "hash", "title", "mime")
            known = self.store.read("published", upto=after).where("live").select("original_id", "hash", "title", "mime")
            at = ["original_id", "hash", "title", "mime"]
            todo = mine.join(live, at, "left_semi").join(known, at, "left_anti").join(self.blobs(), "hash")
            told = ingest.outcomes(todo)
            states = told.select("original_id", "hash", "title", "mime", F.col("state").alias("det_state"), F.when(F.col("state") == "ready", "unavailable").otherwise("skipped").alias("know_state"), F.lit(None).cast("string").alias("know_producer"), "reason", F.lit(True).alias("live"))
            parts = {"published": [self.store.stage("published", states)], "fragments": [self.store.stage("fragments", ingest.fragments(todo).join(todo.select("original_id", F.col("job_id").alias("job")), "original_id"))]}
            return self.store.commit(parts, after, reads=("items", "published"))

        self._commit(write)

    def _know(self, mine: DataFrame, extractor: Extractor, model: str, target: int, after_wave: Callable[[int], None] | None) -> DataFrame:
        """Run knowledge jobs from their checkpoints and publish those that are whole; (original_id, job_id, kind, error)."""
        at = ["original_id", "hash", "title", "mime"]
        wanted = mine.select(F.col("job_id").alias("job"), *at, "attempts")
        made = self.jobs().where(F.col("representation") == jobs.DETERMINISTIC).select(F.col("job_id").alias("_made"), *at)
        rows = self.store.read("fragments").withColumnRenamed("job", "_made").join(wanted.join(made, at), ["original_id", "_made"]).drop("_made", "_version", "hash", "attempts")
        try:
            runs.run(self.store, rows, extractor, target, after_wave=after_wave)
        except (PySparkException, Py4JJavaError) as wrong:  # what a model does must not end the stream: the attempt failed
            return wanted.select("original_id", F.col("job").alias("job_id"), F.lit("failed").alias("kind"), F.lit(f"{type(wrong).__name__}: {wrong}"[:300]).alias("error"), F.lit(False).alias("permanent"))
        batches = runs.planned(rows, target).select("job", "original_id", "batch", "digest").distinct()
        state = runs.finished(self.store, batches)

        def write(after: int) -> int:
            live = self.items(after).where("not deleted").select(F.col("id").alias("original_id"), "hash", "title", "mime")
            now = latest(self.store.read("published", upto=after), "original_id").drop("_version", "know_state", "know_producer", "reason").where("live")
            whole = wanted.join(live, at, "left_semi").join(state.where("state <> 'missing_checkpoints'"), "job", "left")
            rows_ = now.join(whole.select("original_id", "job", F.coalesce("state", F.lit("ready")).alias("know_state"), "reason"), "original_id").withColumn("know_producer", F.lit(model))
            found = runs.observations(self.store, batches, model).join(whole.select("original_id", "job"), "original_id")
            return self.store.commit({"published": [self.store.stage("published", rows_)], "observations": [self.store.stage("observations", found)]}, after, reads=("items", "published"))

        self._commit(write)
        return wanted.select("original_id", F.col("job").alias("job_id"), F.lit("done").alias("kind"), F.lit("ready").alias("state"))

    def observations(self) -> DataFrame:
        """Knowledge in force: of the last finished knowledge job of each published original."""
        done = self.jobs().where((F.col("representation") == jobs.KNOWLEDGE) & (F.col("state") == "completed")).select("original_id", "job_id", "step")
        last = done.groupBy("original_id").agg(F.max_by("job_id", "step").alias("job"))
        return self.store.read("observations").drop("_version").dropDuplicates(["job", "observation_id"]).join(last, ["original_id", "job"], "left_semi").join(self.published().select("original_id"), "original_id", "left_semi")

    # Search.

    def publish(self, chunks: DataFrame) -> DataFrame:
        """Bring the search index to these chunks."""
        actions = self.index.sync(chunks)
        if self.on_publish:
            self.on_publish(actions)
        return actions

    def search(self, query: str, limit: int | None = None, embed: Callable[[str], list[float]] | None = None) -> DataFrame:
        return self.index.search(query, limit, embed)

    # Synchronisation.

    def plan_sync(self, plan: DataFrame, now: int) -> DataFrame:
        """(key, job_id) for a whole plan (key, original_id, title, direction). Queued jobs that it lacks are completed."""
        if sync.invalid_plan_rows(plan).limit(1).count():
            raise ValueError("invalid synchronisation plan")
        old = self.sync_jobs.read()
        queued = old.where("state = 'queued'")
        last = old.agg(F.max(F.substring_index("job_id", "-", -1).cast("bigint"))).first()[0] or 0
        new = numbered(plan.join(queued.select("key"), "key", "left_anti"), "key", "n", last)
        added = new.select(F.concat(F.lit("sync-"), F.col("n").cast("string")).alias("job_id"), "key", "original_id", "title", "direction", F.lit("queued").alias("state"), F.lit(now).cast("bigint").alias("queued_at"), F.lit(None).cast("bigint").alias("completed_at"))
        told = plan.select("key", F.col("original_id").alias("_source"), F.lit(True).alias("_there"))
        kept = old.join(told, "key", "left")
        open_ = F.col("state") == "queued"
        closed = open_ & F.col("_there").isNull()
        kept = kept.withColumns(
            {"completed_at": F.when(closed, F.lit(now)).otherwise(F.col("completed_at")), "original_id": F.when(open_, F.coalesce("original_id", "_source")).otherwise(F.col("original_id")), "state": F.when(closed, "completed").otherwise(F.col("state"))}
        )
        self.sync_jobs.write(kept.select(*old.columns).unionByName(added))
        return self.sync_jobs.read().where("state = 'queued'").select("key", "job_id")

    def complete_sync(self, job_ids: DataFrame, now: int) -> None:
        """Complete jobs (job_id); an id that was never given fails, one completed before changes nothing."""
        old = self.sync_jobs.read()
        if job_ids.join(old.select("job_id"), "job_id", "left_anti").limit(1).count():
            raise KeyError("unknown synchronisation job")
        self.sync_jobs.write(jobs.completed_once(old, job_ids, F.lit(now).cast("bigint")))

    def status(self) -> DataFrame:
        """One row: revisions, synchronisation and processor jobs by state, and the index's counts."""
        one = F.lit(1).alias("_one")
        own = self.jobs().where("state <> 'removed'").select(F.col("job_id").alias("key"), "state", F.when(F.col("state") == "completed", F.col("at")).alias("completed_at"))
        told = jobs.status(self.sync_jobs.read().select("key", "state", "completed_at"), own, self.sync_jobs.revision(), self.store.version())
        return told.select("*", one).join(self.index.counts().select("*", one), "_one").drop("_one")

    def processing(self) -> DataFrame:
        """Unfinished processor jobs with their progress: batches that have a checkpoint, and all of them."""
        count = lambda table, name: self.store.read(table).groupBy(F.col("job").alias("job_id")).agg(F.count_distinct("batch", "digest").alias(name))
        open_ = self.jobs().where("state <> 'removed'").join(count("checkpoints", "n_checkpoints"), "job_id", "left").join(count("batches", "n_batches"), "job_id", "left")
        return jobs.processing(open_)
