import pandas as pd

from lorehouse.functions import text
from lorehouse.operators import bronze, graph, knowledge, retrieval, sync
from lorehouse.sources import dispatch
from lorehouse.streaming import reconcile
from pyspark.sql import functions as F

ID = "00000001-0000-4000-8000-000000000001"


def item(spark, **change):
    row = {"id": ID, "revision": 1, "hash": "0" * 64, "deleted": False, "title": "t", "mime": "text/plain", "size": 1, "created": 1, "modified": 1} | change
    return spark.createDataFrame([tuple(row.values())], bronze.SCHEMA)


def test_commit_transitions(spark):
    now, none = item(spark), item(spark).limit(0)
    act = lambda cur, **c: bronze.commit_actions(cur, item(spark, **c)).first()["action"]
    assert act(none) == "insert" and act(none, revision=2) == "conflict"
    assert act(none, revision=2, deleted=True) == "tombstone" and act(none, deleted=True) == "conflict"
    assert act(now) == "noop" and act(now, revision=2, deleted=True, modified=2) == "tombstone"
    assert act(now, revision=2, deleted=True) == "conflict" and act(now, revision=2, hash="1" * 64, modified=2) == "conflict"
    assert act(now, id="bad") == "conflict"
    assert bronze.committed(now, item(spark, revision=2, deleted=True, modified=2)).first()["deleted"]


def test_sniff(spark):
    rows = [(0, b"\0\1"), (1, b"\xff\xfe"), (2, "plain å".encode()), (3, b""), (4, b"\x01" * 3 + b"a" * 50), (5, ("a" * 8191 + "å").encode())]
    found = {r.k: r.b for r in spark.createDataFrame(rows, "k int, c binary").select("k", dispatch.looks_binary(F.col("c")).alias("b")).collect()}
    assert found == {0: True, 1: True, 2: False, 3: False, 4: True, 5: False}


def test_bm25_phrases_and_ties(spark):
    docs = [("a", "Café kettle"), ("b", "kettle copper foo-bar"), ("c", "bar foo"), ("d", None), ("e", "kettle copper foo-bar")]
    df = spark.createDataFrame(docs, "chunk_id string, text string")
    assert [r.chunk_id for r in retrieval.lexical(df, "foo-bar").orderBy("rank").collect()] == ["b", "e"]
    assert [r.chunk_id for r in retrieval.lexical(df, "cafe").collect()] == ["a"]
    assert retrieval.lexical(df, "!!!").count() == 0
    assert retrieval.phrases("Kettle kettle Kettle foo_bar") == [["kettle"], ["kettle"], ["foo", "bar"]]


def test_vectors_and_fusion(spark):
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 0.0]), ("c", None), ("d", [0.6, 0.8]), ("e", [1.0])], "chunk_id string, embedding array<float>")
    assert [(r.chunk_id, r.distance) for r in retrieval.nearest(v, [1.0, 0.0]).orderBy("rank").collect()] == [("a", 0.0), ("d", 0.4)]
    chunks = spark.createDataFrame([("a", "x"), ("z", "kettle")], "chunk_id string, text string")
    hits = retrieval.search(chunks, "kettle", 5, v, [1.0, 0.0]).orderBy("rank").collect()
    assert [h.chunk_id for h in hits] == ["a", "z"] and hits[0].lexical_rank is None


def test_batches_and_recovery():
    assert knowledge.batches_of([20, 20, 600, 20], [None] * 4, [False] * 4, 41) == [0, 0, 1, 2]
    calls = {}

    def short(asked):
        calls[len(asked)] = calls.get(len(asked), 0) + 1
        if len(asked) > 1:
            raise knowledge.ContractError("short")
        return {asked[0][0]: {}}

    assert len(knowledge.recovered([(str(i), "t") for i in range(4)], short)) == 4
    assert calls == {4: 3, 2: 6, 1: 4}


def test_entities_collide_by_label_and_type(spark):
    rows = [("  Fjord \t", "ship"), ("fjord", "ship"), ("FJORD", "harbour"), ("Fjord", None)]
    df = spark.createDataFrame(rows, "label string, type string").withColumn("confidence", F.lit(0.9))
    assert knowledge.resolve_entities(df).select("entity_id").distinct().count() == 3
    assert knowledge.resolve_entities(df.withColumn("confidence", F.lit(0.4))).count() == 0


def test_coverage_of_nothing_is_ready(spark):
    df = spark.createDataFrame([("s", 0, 0, None)], "original_id string, n_semantic bigint, n_completed bigint, skip_reason string")
    assert knowledge.coverage(df).first()["state"] == "ready"


def test_claim_groups_prefer_confidence(spark):
    schema = "claim_id string, subject_entity_id string, predicate string, value string, object_entity_id string, state string, confidence double"
    rows = [(f"name-{i}", "e", "name", "Svan", None, "active", c) for i, c in ((1, 0.84), (2, 0.96), (3, None))] + [("role-1", "e", "role", "x", None, "superseded", 0.99)]
    group = graph.claim_groups(spark.createDataFrame(rows, schema)).collect()
    assert [(g.primary_claim_id, g.confidence, g.n_claims) for g in group] == [("name-2", 0.96, 3)]


def test_omni_relevance(spark):
    rows = [("SILVER", "1", "Oda Lund", ["Oda Lund", "trade cooper"]), ("BRONZE", "2", "Oda.txt", ["Oda.txt"]), ("SILVER", "3", "Per", ["Per"])]
    df = spark.createDataFrame(rows, "tier string, id string, title string, search_terms array<string>")
    assert [r.id for r in graph.omni_search(df, "oda").orderBy("rank").collect()] == ["2", "1"]
    assert graph.omni_search(df, "  ").count() == 0 and graph.omni_search(df, "cooper").first()["id"] == "1"


def test_sync_rules(spark):
    plan = spark.createDataFrame([("a:1", "a", "t", "upload"), ("a:1", "a", "t", "upload"), ("x", "b", "t", "upload"), ("c", None, "t", "sideways"), ("d", None, "t", "download")], "key string, original_id string, title string, direction string")
    assert sorted(r.key for r in sync.invalid_plan_rows(plan).collect()) == ["a:1", "a:1", "c", "x"]
    items = spark.createDataFrame([("i1", "one"), ("i2", "two"), ("i3", "two")], "id string, title string")
    jobs = spark.createDataFrame([("k1", "i2", "x"), ("k2", None, "one"), ("k3", None, "two")], "key string, original_id string, title string")
    assert {r.key: r.item_id for r in sync.job_items(jobs, items).collect()} == {"k1": "i2", "k2": "i1", "k3": None}


def test_stream_equals_batch(spark, tmp_path):
    rows = [("s1", "a.json", "application/json", bytearray(b'{"a": 1}')), ("s2", "n.md", "text/markdown", bytearray(b"# H\n\nbody"))]
    originals = spark.createDataFrame(rows, reconcile.ORIGINAL)
    originals.write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        reconcile.publish(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    pick = lambda df: sorted((r.original_id, r.ordinal, r.kind, r.text) for r in df.collect())
    assert pick(reconcile.published(spark, str(tmp_path / "out"))) == pick(reconcile.fragments(originals))


def test_embedder_rows_are_checked(spark):
    chunks = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "chunk_id int, text string")
    vectors = {"a": [1.0, 0.0], "b": [0.0, 0.0], "c": [1.0]}
    found = knowledge.embedded(chunks, lambda t: pd.Series([vectors[x] for x in t]), 2)
    assert [r.chunk_id for r in found.collect()] == [1]


def test_fold_skips_marks_of_ascii_alone(spark):
    """ASCII texts are lowered and not searched for marks; tokens are the same as with the search."""
    texts = ["", None, "Foo_BAR 12-ab\tX", "Ünï CAFÉ", "éa İ ǅ", "\x00A\x7f", "Straße Ⅳ ½", "Á"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    long = F.lower(F.regexp_replace(F.translate("t", text.ACCENTED, text.BASE), r"\p{M}+", ""))
    plain = F.regexp_extract_all(F.coalesce(long, F.lit("")), F.lit(r"([\p{L}\p{N}\p{Co}]+)"), F.lit(1))
    assert all(r[0] == r[1] and r[2] == r[3] for r in df.select(text.fold(F.col("t")), long, text.tokens(F.col("t")), plain).collect())
    assert "octet_length(" in df.select(text.tokens(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()
