"""The archive object on stored tables."""

import hashlib
import time
from collections import Counter

import pytest
from lorehouse.archive import Archive
from lorehouse.operators import jobs, knowledge, runs
from lorehouse.sources.store import Conflict
from lorehouse.sources.versioned import VersionedTable
from lorehouse.streaming import jobs as machine
from pyspark.sql import functions as F

SCHEMA = "id string, revision bigint, hash string, deleted boolean, title string, mime string, size bigint, created bigint, modified bigint, content binary"


def upload(spark, *rows):
    def one(n, text, **change):
        item = {"id": f"{n:08x}-0000-4000-8000-000000000000", "revision": 1, "hash": hashlib.sha256(text).hexdigest(), "deleted": False, "title": f"n{n}.txt", "mime": "text/plain", "size": len(text), "created": 5, "modified": 5, "content": bytearray(text)}
        return tuple((item | change).values())

    return spark.createDataFrame([one(n, t, **c) for n, t, c in rows], SCHEMA)


def test_versions_replace_each_other(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"), "a int")
    assert t.read().count() == 0 and t.revision() == 0
    for n in (1, 2, 3):
        t.write(spark.range(n).select(F.col("id").cast("int").alias("a")))
    assert t.read().count() == 3 and t.versions() == [2, 3]
    (tmp_path / "t" / "schema=1" / "version=4").mkdir()
    assert t.read().count() == 3 and t.write(t.read()) == 4 and t.read().count() == 3
    assert VersionedTable(spark, str(tmp_path / "t"), "a int", schema=2).read().count() == 0
    VersionedTable(spark, str(tmp_path / "t"), "a int", schema=2).write(spark.range(1).select(F.lit(1).alias("a")))
    with pytest.raises(ValueError, match="schema 2"):
        VersionedTable(spark, str(tmp_path / "t"), "a int")


def test_originals_come_and_go(spark, tmp_path):
    seen = []
    a = Archive(spark, str(tmp_path / "a"), on_commit=lambda df: seen.append({r.id[:8]: r.action for r in df.collect()}))
    a.put(upload(spark, (1, b"one\n\ntwo", {}), (2, b'{"k": 1}', {"title": "n.json", "mime": "application/json"}), (3, b"x", {"size": 9})))
    assert seen[-1] == {"00000001": "insert", "00000002": "insert", "00000003": "rejected"}
    assert a.manifest().count() == 2 and bytes(a.content("00000001-0000-4000-8000-000000000000").first().content) == b"one\n\ntwo"
    assert sorted(r.kind for r in a.fragments().collect()) == ["parsed-json-value", "text-block", "text-block"]
    a.put(upload(spark, (1, b"one\n\ntwo", {"deleted": True, "revision": 2, "modified": 6}), (2, b"other", {})))
    assert seen[-1] == {"00000001": "tombstone", "00000002": "conflict"}
    a.prune()
    assert a.content("00000001-0000-4000-8000-000000000000").count() == 0 and a.blobs().count() == 1 and a.get("00000001-0000-4000-8000-000000000000").first().deleted


def test_plans_and_completions(spark, tmp_path):
    a = Archive(spark, str(tmp_path / "a"))
    plan = lambda *keys: spark.createDataFrame([(k, None, "t", "upload") for k in keys], "key string, original_id string, title string, direction string")
    first = {r.key: r.job_id for r in a.plan_sync(plan("k1", "k2"), 10).collect()}
    assert first == {"k1": "sync-1", "k2": "sync-2"}
    second = {r.key: r.job_id for r in a.plan_sync(plan("k2", "k3"), 20).collect()}
    assert second == {"k2": "sync-2", "k3": "sync-3"}
    for now in (30, 40):
        a.complete_sync(spark.createDataFrame([("sync-2",)], "job_id string"), now)
    assert {r.job_id: (r.state, r.completed_at) for r in a.sync_jobs.read().collect()} == {"sync-1": ("completed", 20), "sync-2": ("completed", 30), "sync-3": ("queued", None)}
    with pytest.raises(KeyError):
        a.complete_sync(spark.createDataFrame([("sync-9",)], "job_id string"), 50)
    with pytest.raises(ValueError):
        a.plan_sync(plan("k", "k"), 60)
    row = a.status().first()
    assert (row.n_queued, row.n_completed, row.latest, row.n_chunks) == (1, 2, "k2,k1", 0)


def test_a_put_costs_what_it_adds_and_is_one_commit(spark, tmp_path):
    a = Archive(spark, str(tmp_path / "a"))
    a.put(upload(spark, *[(n, b"text %d" % n, {}) for n in range(1, 6)]))
    before = a.store.version()
    a.put(upload(spark, (6, b"text 1", {}), (7, b"seven", {})))
    assert a.store.version() == before + 1 and a.manifest().count() == 7
    assert a.store.read("items", since=before).count() == 2 and a.store.read("blobs", since=before).count() == 1  # the bytes of 6 are there
    stale = a.store.version()
    a.put(upload(spark, (8, b"eight", {})))
    with pytest.raises(Conflict):
        a._put(upload(spark, (9, b"nine", {})), stale)
    assert a.manifest().count() == 8 and a.content("00000009-0000-4000-8000-000000000000").count() == 0
    assert {r.action for r in a.put(upload(spark, (9, b"nine", {}))).collect()} == {"insert"}


def waited(query, done, seconds=90):
    end = time.time() + seconds
    while not done():
        assert time.time() < end and query.exception() is None, query.exception()
        time.sleep(0.5)


def test_jobs_run_fail_and_go_on_where_they_were_killed(spark, tmp_path):
    calls = str(tmp_path / "calls")

    class Model:
        """Answers each list; writes down what it was asked, and fails while a file says so."""

        def extract(self, fragments):
            import os

            if os.path.exists(f"{calls}-broken"):
                raise RuntimeError("the model is away")
            with open(calls, "a") as out:
                out.write(",".join(i for i, _ in fragments) + "\n")
            return {i: {"entities": [{"ref": "r", "label": t, "type": "", "confidence": 0.9}]} for i, t in fragments}

    a = Archive(spark, str(tmp_path / "a"))
    text = "\n\n".join(f"block {k} of a text" for k in range(12))
    a.put(upload(spark, (1, text.encode(), {}), (2, b"\x89PNG", {"title": "p.png", "mime": "image/png"}), (3, b"short", {})))

    def killed(wave):
        if wave == 1:
            raise RuntimeError("killed between waves")

    first = a.process(Model(), "m/1", "300 milliseconds", 500, killed)
    with pytest.raises(Exception, match="killed between waves"):
        first.awaitTermination(120)
    asked = open(calls).read().split()
    state = {(r.original_id[:8], r.representation): r.state for r in a.jobs().collect()}
    assert state[("00000002", "deterministic")] == "completed" and state[("00000001", "knowledge")] == "queued"
    assert a.processing().where("representation = 'knowledge' and completed_batches < total_batches").count() == 1
    again = a.process(Model(), "m/1", "300 milliseconds", 500)
    waited(again, lambda: a.jobs().where("state <> 'completed'").count() == 0)
    told = {r.original_id[:8]: (r.det_state, r.know_state, r.reason) for r in a.published().collect()}
    assert told["00000001"][:2] == told["00000003"][:2] == ("ready", "ready") and told["00000002"] == ("skipped", "skipped", "unsupported_content")
    assert max(Counter(open(calls).read().split()).values()) == 1 and len(open(calls).read().split()) > len(asked)  # nothing is asked twice
    assert a.observations().count() == 13 and a.status().first().n_queued == 0
    (tmp_path / "calls-broken").touch()
    a.put(upload(spark, (4, b"a later text", {}), (3, b"short", {"deleted": True, "revision": 2, "modified": 6})))
    a.feed()
    waited(again, lambda: a.jobs().where("attempts >= 1 and retryable").count() == 1)
    (tmp_path / "calls-broken").unlink()
    waited(again, lambda: a.published().where("original_id like '00000004%' and know_state = 'ready'").count() == 1)
    waited(again, lambda: a.jobs().where("state not in ('completed', 'removed')").count() == 0)
    again.stop()
    assert a.published().where("original_id like '00000003%'").count() == 0 and {r.state for r in a.jobs().where("original_id like '00000003%'").collect()} == {"removed"}
    assert a.observations().count() == 13


def test_the_machine_agrees_with_the_set_functions(spark):
    """Cancelled, new, failed and recovered jobs, event by event and as tables."""
    item = lambda h, at: {"kind": "item", "original_id": "o", "hash": h, "title": "t", "mime": "m", "at": at, "job_id": None}
    state = {}
    assert [c["state"] for c in machine.advance(state, item("h1", 1), "m")] == ["queued"] and not machine.advance(state, item("h1", 2), "m")
    changed = machine.advance(state, item("h2", 3), "m")
    schema = "job_id string, original_id string, hash string, title string, mime string, representation string, producer string, input string, state string"
    old = spark.createDataFrame([("o/1", "o", "h1", "t", "m", "deterministic", jobs.EXTRACTION, "x", "queued")], schema)
    manifest = spark.createDataFrame([("o", False, "h2", "t", "m")], "id string, deleted boolean, hash string, title string, mime string")
    none = spark.createDataFrame([], "id string, hash string, title string, mime string, det_state string, det_producer string, det_input string, know_state string, know_producer string, know_input string")
    want = {(r.representation, r.state) for r in jobs.planned(manifest, none, old).collect()}
    assert {(c["representation"], c["state"]) for c in changed} == want == {("deterministic", "cancelled"), ("deterministic", "queued")}
    end = lambda kind, **x: machine.advance(state, {"kind": kind, "original_id": "o", "at": 10, "job_id": "o/2", "state": None, "error": "e", "permanent": False} | x, "m")
    end("started")
    rows = "job_id string, original_id string, state string, retryable boolean, attempts int, retry_at bigint"
    running = spark.createDataFrame([("o/2", "o", "running", False, 0, 0)], rows)
    failed = jobs.failed(running, spark.createDataFrame([("o/2", "e", False)], "job_id string, error string, permanent boolean"), F.lit(10)).first()
    mine = end("failed")[0]
    assert (mine["state"], mine["attempts"], mine["retry_at"], mine["retryable"]) == (failed.state, failed.attempts, failed.retry_at, failed.retryable)
    assert not end("due", at=mine["retry_at"] - 1) and end("due", at=mine["retry_at"])[0]["state"] == "queued"
    end("started")
    assert end("restart")[0]["state"] == jobs.recovered(running).first().state == "queued"
    assert [c["representation"] for c in end("done", state="ready")] == ["deterministic", "knowledge"] and not end("done", state="ready")
    assert end("deleted")[0]["state"] == "removed" and state["jobs"] == []
    assert [machine.delay(n) for n in (1, 2, 9, 40)] == [1000, 2000, 256_000, 256_000]


def test_a_changed_batch_is_asked_again(spark, tmp_path):
    a = Archive(spark, str(tmp_path / "a"))
    rows = lambda last: spark.createDataFrame([("j", "o", k, "t", "m", "text-block", f'{{"n":{k}}}', "", '{"text":"x"}', t, None, False) for k, t in enumerate(["one", "two", last])], "job string, original_id string, ordinal int, title string, mime string, kind string, selector string, excerpt string, payload string, text string, context string, structural_only boolean")

    class Model:
        def extract(self, fragments):
            return {i: {} for i, _ in fragments}

    assert runs.run(a.store, rows("three"), Model(), 10) == 1 and a.store.read("checkpoints").count() == 3
    assert runs.run(a.store, rows("three"), Model(), 10) == 0
    changed = rows("three").withColumn("payload", F.when(F.col("ordinal") == 2, '{"text":"y"}').otherwise(F.col("payload")))
    assert runs.run(a.store, changed, Model(), 10) == 1 and a.store.read("checkpoints").count() == 4
    batches = runs.planned(changed, 10).select("job", "original_id", "batch", "digest").distinct()
    assert runs.finished(a.store, batches).first().state == "ready" and runs.open_batches(batches, a.store).count() == 0
    assert isinstance(knowledge.Budget(), knowledge.Budget)
