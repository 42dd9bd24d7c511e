"""Jobs, clients and desktops: the cases that tables of many rows don't show."""

import pytest
from lorehouse.functions import labels
from lorehouse.functions.ordering import numbered, ranked_within, top_within
from lorehouse.functions.text import file_size
from lorehouse.operators import archive, desktop, graph, jobs
from pyspark.sql import Window
from pyspark.sql import functions as F


def test_numbered_equals_sorted_order(spark):
    df = spark.range(500).select(F.sha2(F.col("id").cast("string"), 256).alias("k"))
    found = sorted((r.k, r.n) for r in numbered(df, "k", "n", 7, parts=9).collect())
    assert [n for _, n in found] == list(range(8, 508))
    assert numbered(df.limit(0), "k", "n").count() == 0


def test_settings_are_checked():
    assert archive.Settings.read("X", {"X_BATCH_BYTES": " 100 ", "X_MODEL_URL": "http://127.0.0.1:1"}).batch_bytes == 100
    for bad in ({"X_BATCH_BYTES": "0"}, {"X_BATCH_BYTES": "ten"}, {"X_MODEL_URL": "http://example.org"}, {"X_EMBEDDING_URL": "ftp://localhost"}):
        with pytest.raises(ValueError):
            archive.Settings.read("X", bad)
    assert archive.model_input_bytes(8192, 2048, 1000) == 4888
    with pytest.raises(ValueError):
        archive.model_input_bytes(4096, 2048, 1000)


def test_model_manifest(spark, tmp_path):
    good = '{"models":[{"repository":"r","revision":"1","file":"f","bytes":3,"sha256":"%s","parts":[{"file":"p","bytes":1},{"file":"q","bytes":2}]}]}' % ("a" * 64)
    (tmp_path / "m.json").write_text(good)
    assert archive.model_manifest(spark, str(tmp_path / "m.json")).count() == 1
    (tmp_path / "n.json").write_text(good.replace('"bytes":3', '"bytes":4'))
    with pytest.raises(Exception, match="invalid model manifest"):
        archive.model_manifest(spark, str(tmp_path / "n.json")).collect()


def test_imports_and_headers(spark):
    rows = spark.createDataFrame([("i", " ", None, bytearray(b"x")), ("j", "n.txt", "text/plain", bytearray(b""))], "id string, title string, mime string, content binary")
    found = {r.id: (r.title, r.mime, r["size"]) for r in archive.imported(rows, F.lit(1)).collect()}
    assert found == {"i": ("File", "application/octet-stream", 1), "j": ("n.txt", "text/plain", 0)}
    assert archive.metrics(spark, spark.createDataFrame([("abc",)], "text string"), rows, 1.5).first().asDict() == {"n_chunks": 1, "largest_chunk": 3, "n_vectors": 2, "latency_ms": 1.5}


def test_background_work():
    assert jobs.background_work(True, False, 1) and not any((jobs.background_work(False, False, 1), jobs.background_work(True, True, 1), jobs.background_work(True, False, 0)))


def test_sizes_and_durations(spark):
    row = spark.range(1).select(*[file_size(F.lit(n)).alias(f"n{n}") for n in (0, 1023, 1024, 10 * 1024, 1536 * 1024, 5 << 40, 5 << 50)], labels.duration_text(F.lit(-5)).alias("none"), labels.duration_text(F.lit(86_400_000)).alias("day")).first()
    assert list(row) == ["0 B", "1023 B", "1.0 KB", "10 KB", "1.5 MB", "5.0 TB", "5120 TB", "less than a minute", "1 day"]


def test_moves_stay_within_bounds(spark):
    items = spark.createDataFrame([("d", "t", x, i) for i, x in enumerate("abcd")], "desktop string, object_type string, object_id string, position int")
    place = lambda to, x: "".join(r.object_id for r in desktop.moved(items, spark.createDataFrame([("d", "t", x, to)], "desktop string, object_type string, object_id string, to int")).orderBy("position").collect())
    assert (place(99, "a"), place(-3, "d"), place(1, "b"), place(0, "missing")) == ("bcda", "dabc", "abcd", "abcd")


def test_ambiguous_refs_name_nothing(spark):
    rows = [("o1", "entity-candidate", '{"ref":"r","label":"Ida"}', ["e1"], 0.9), ("o2", "entity-candidate", '{"ref":"r","label":"Per"}', ["e2"], 0.9), ("o3", "attribute-candidate", '{"subject_ref":"r","predicate":"born_in","value":1931}', ["e1", "e2"], None), ("o4", "attribute-candidate", '{"subject_ref":"r","predicate":"born_in","value":{"x":1}}', ["e1"], 0.5)]
    o = spark.createDataFrame(rows, "observation_id string, kind string, payload string, evidence_ids array<string>, confidence double")
    none = spark.createDataFrame([], "supporting_observation_ids array<string>, state string")
    found = {(r.predicate, r.value, r.confidence) for r in graph.candidate_findings(o, spark.createDataFrame([("e1", "x")], "evidence_id string, excerpt string"), none).collect()}
    assert found == {("Possible entity", "Ida", 0.9), ("Possible entity", "Per", 0.9), ("born in", "1931", None)}


def test_a_hub_is_ranked_in_many_tasks(spark):
    """Half of all rows are one value's: ranks equal the window's, and no range has more than twice the mean."""
    df = spark.range(20_000).select(F.when(F.col("id") % 2 == 0, "hub").when(F.col("id") % 7 == 0, None).otherwise((F.col("id") % 50).cast("string")).alias("k"), F.pmod(F.xxhash64("id"), F.lit(1000)).alias("v"), "id")
    order = [F.desc("v"), F.col("id")]
    want = df.withColumn("n", F.row_number().over(Window.partitionBy("k").orderBy(*order)))
    rows = lambda x: sorted((r.id, r.n) for r in x.select("id", "n").collect())
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = ranked_within(df, "k", order, "n")
        sizes = [r["count"] for r in df.repartitionByRange(F.col("k").asc(), *order).groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert rows(found) == rows(want) and len(sizes) == 4 and max(sizes) <= 2 * sum(sizes) / len(sizes)
    assert rows(top_within(df, "k", order, 3, "n")) == rows(want.where("n <= 3"))
    assert ranked_within(df.limit(0), "k", order, "n").count() == 0


def test_terms_as_rows_answer_as_lists_do(spark):
    entities = spark.createDataFrame([("e1",), ("e2",), ("hub",)], "entity_id string")
    rows = [(f"c{k:03d}", "hub", "knows", f"person {k}", None, "active") for k in range(60)] + [("n1", "e1", "name", "Ida Lund", None, "active"), ("n2", "hub", "name", "Hub", None, "active"), ("r1", "e1", "member_of", None, "hub", "active")]
    claims = spark.createDataFrame(rows, "claim_id string, subject_entity_id string, predicate string, value string, object_entity_id string, state string")
    lists = graph.search_terms(entities, claims).select(F.lit("SILVER").alias("tier"), F.col("entity_id").alias("id"), "title", "search_terms")
    terms = graph.search_term_rows(entities, claims).select(F.lit("SILVER").alias("tier"), F.col("entity_id").alias("id"), "title", "pos", "term")
    gathered = terms.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "term"))), lambda x: x["term"]).alias("t"))
    assert {r.id: r.t for r in gathered.collect()} == {r.id: r.search_terms for r in lists.collect()}
    for q in ("person 59", "hub", "ida", "lund member", "nothing", " "):
        assert graph.omni_search_rows(terms, q).collect() == graph.omni_search(lists, q).collect()


def test_any_number_of_desktops_takes_a_manifest(spark):
    none = spark.createDataFrame([], "desktop string, object_type string, object_id string")
    known = spark.range(1500).select(F.format_string("d%04d", "id").alias("desktop"), F.lit("silver-entity").alias("object_type"), F.lit("e").alias("object_id"))
    manifest = spark.createDataFrame([("a", False), ("b", True)], "id string, deleted boolean")
    after = desktop.known_after(none.withColumn("position", F.lit(0)), known, manifest)
    assert after.count() == 4500 and after.where("object_id = 'b'").select("desktop").distinct().count() == 1500
