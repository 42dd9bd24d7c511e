"""The persisted index: what a synchronisation does, and that its search equals a scan."""

import random

import pandas as pd
import pytest
from lorehouse.operators import index, retrieval
from lorehouse.sources import store
from pyspark.sql import functions as F


def chunks(spark, rows):
    df = spark.createDataFrame(rows, "original_id string, chunk_id string, text string")
    return df.select("original_id", "chunk_id", F.lit("o").alias("observation_id"), F.lit("e").alias("evidence_id"), F.lit("{}").alias("selector"), "text", F.lit("p").alias("producer"))


FIRST = [("s1", "a", "copper kettle on the copper shelf"), ("s1", "b", "tin kettle"), ("s2", "c", "glass foo-bar kettle"), ("s3", "d", None), ("s4", "e", "bar foo")]
QUERIES = ("kettle copper", "foo-bar", "!!!", "kettle kettle tin shelf")


def same_as_scan(found, df, queries=QUERIES):
    for q in queries:
        pick = lambda x: [(r.chunk_id, r.score, r.rank) for r in x.orderBy("rank").collect()]
        assert pick(found.lexical(q)) == pick(retrieval.lexical(df, q)), q


def test_sync_writes_only_what_changed(spark, tmp_path):
    found, df = index.SearchIndex(spark, str(tmp_path / "i")), chunks(spark, FIRST)
    assert found.lexical("kettle").count() == 0 and found.counts().first().n_sources == 0
    assert {r.action for r in found.sync(df).collect()} == {"insert"}
    same_as_scan(found, df)
    assert {r.action for r in found.sync(df).collect()} == {"keep"} and found.store.version() == 1
    now = chunks(spark, [r for r in FIRST if r[0] != "s4"][:-2] + [("s2", "c", "glass kettle, other words"), ("s3", "d", None), ("s5", "f", "new copper")])
    assert {r.original_id: r.action for r in found.sync(now).collect()} == {"s1": "keep", "s2": "replace", "s3": "keep", "s4": "delete", "s5": "insert"}
    same_as_scan(found, now, QUERIES[:2])
    assert found.store.read("chunks", since=1).count() == 2 and found.store.read("dead").count() == 2
    assert {r.chunk_id for r in found.chunks().collect()} == {"a", "b", "c", "d", "f"}
    found.delete(spark.createDataFrame([("s1",)], "original_id string"))
    same_as_scan(found, now.where("original_id <> 's1'"), QUERIES[1:2])


def test_what_is_not_committed_does_not_count(spark, tmp_path):
    found, df = index.SearchIndex(spark, str(tmp_path / "i")), chunks(spark, FIRST)
    found.sync(df)
    staged = found.store.stage("chunks", found.store.read("chunks"))
    same_as_scan(index.SearchIndex(spark, str(tmp_path / "i")), df, QUERIES[:1])
    assert found.store.version() == 1 and found.chunks().count() == 5 and found.store.vacuum() == 0  # it may be a running writer's
    found.delete(spark.createDataFrame([("none",)], "original_id string"))
    assert found.store.vacuum(grace=0) >= 1 and staged["folder"] not in str(found.store.commits())
    same_as_scan(found, df, QUERIES[:1])


def test_vectors_follow_the_model(spark, tmp_path):
    found = index.SearchIndex(spark, str(tmp_path / "i"))
    found.sync(chunks(spark, FIRST[:3]))
    embed = lambda t: [[float(len(x)), 1.0] for x in t]
    assert found.sync_embeddings(None, None) == "unavailable" and found.vectors().count() == 0
    one, two = index.Model("m", "1", 2), index.Model("m", "2", 2)
    assert found.sync_embeddings(one, embed) == "ready" and found.vectors().count() == 3
    found.sync(chunks(spark, [*FIRST[:3], FIRST[4]]))
    assert found.vectors().count() == 3
    assert found.sync_embeddings(one, embed) == "ready" and found.vectors().count() == 4
    assert found.sync_embeddings(two, lambda t: [[0.0, 0.0] for _ in t]) == "failed" and found.vectors().count() == 0
    assert found.sync_embeddings(two, embed) == "ready" and found.model() == two
    hits = found.search("kettle", 5, lambda q: [10.0, 1.0]).orderBy("rank").collect()
    assert len(hits) == 4 and hits[0].lexical_rank is not None
    broken = found.search("kettle", 5, lambda q: 1 / 0).collect()
    assert {h.chunk_id for h in broken} == {"a", "b", "c"} and all(h.semantic_rank is None for h in broken)
    with pytest.raises(ValueError):
        found.search(" ", 5)
    assert isinstance(pd.Series([1]), pd.Series)


def statistics(df):
    return sorted(map(tuple, df.where("n_docs_with <> 0").collect()))


def test_changes_and_statistics_equal_a_rebuild(spark, tmp_path):
    """Rounds of replacing, deleting and adding: statistics, hits, totals and vectors as if the index were made anew."""
    rnd, words = random.Random(6), "kettle copper tin glass foo bar shelf river moon".split()
    text = lambda: " ".join(rnd.choice(words) for _ in range(rnd.randrange(0, 12)))
    now = {f"s{k}": [text() for _ in range(rnd.randrange(1, 4))] for k in range(9)}
    frame = lambda: chunks(spark, [(s, f"{s}-{k}", t) for s, ts in now.items() for k, t in enumerate(ts)])
    found, model, embed = index.SearchIndex(spark, str(tmp_path / "i")), index.Model("m", "1", 2), lambda t: [[1.0 + len(x), 1.0] for x in t]
    found.sync(frame())
    for turn in range(3):
        before = found.store.version()
        gone, changed = f"s{turn}", f"s{turn + 4}"
        del now[gone]
        now[changed] = [text() for _ in range(2)]
        now[f"n{turn}"] = [text()]
        if turn % 2:
            found.put(frame(), spark.createDataFrame([(gone,), (changed,), (f"n{turn}",)], "original_id string"))
        else:
            found.sync(frame())
        assert {r.original_id: r.action for r in found.changes(before).collect()} == {gone: "delete", changed: "replace", f"n{turn}": "insert"}
        if turn == 1:
            found.compact()
            assert len(found.store.folders("postings")) == 1 and found.store.read("dead").count() == 0
        assert found.sync_embeddings(model, embed) == "ready"
        assert {r.chunk_id: r.embedding[0] for r in found.vectors().collect()} == {r.chunk_id: 1.0 + len(r.text) for r in frame().collect()}
        assert statistics(found.term_statistics()) == statistics(retrieval.corpus_statistics(frame()))
        same_as_scan(found, frame(), ["copper river foo-bar"])
        total = frame().agg(F.count_distinct("original_id"), F.count("*")).first()
        assert tuple(found.counts().first())[:2] == tuple(total)
    assert sum(1 for r in found.sync(frame()).collect() if r.action != "keep") == 0


def test_blocks_that_cannot_hold_a_hit_are_not_scored(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(index, "PER_BLOCK", 4)
    monkeypatch.setattr(index, "PER_FILE", 32)
    rnd, words = random.Random(7), [f"w{k}" for k in range(40)]
    rows = [(f"s{k}", f"c{k:04d}", " ".join(rnd.choice(words) for _ in range(rnd.randrange(1, 60))) + (" comet tail" if k % 97 == 0 else "")) for k in range(400)]
    found, df = index.SearchIndex(spark, str(tmp_path / "i")), chunks(spark, rows)
    found.sync(df)
    total = found.store.read("postings").select("block").distinct().count()
    for query, limit, most in (("comet", 3, 0.2), ("comet-tail w1", 3, 0.6), ("w1 w2", 5, 0.7), ("w3", 50, 1.0)):
        hits, read = found.lexical_search(query, limit)
        assert [tuple(r) for r in hits.orderBy("rank").collect()] == [tuple(r) for r in retrieval.lexical(df, query, limit).orderBy("rank").select("chunk_id", "score", "rank").collect()]
        assert read <= most * total, (query, read, total)


def test_a_known_state_of_the_input_is_not_read_again(spark, tmp_path):
    found = index.SearchIndex(spark, str(tmp_path / "i"))
    found.sync(chunks(spark, FIRST), "one")
    unreadable = chunks(spark, FIRST).withColumn("text", F.raise_error(F.lit("the text was read")).cast("string"))
    assert {r.action for r in found.sync(unreadable, "one").collect()} == {"keep"}
    with pytest.raises(Exception, match="the text was read"):
        found.sync(unreadable, "two")


def test_a_damaged_file_leads_to_a_rebuild(spark, tmp_path):
    df = chunks(spark, FIRST)
    found = index.SearchIndex(spark, str(tmp_path / "i"), lambda: df)
    found.sync(df)
    file = max((tmp_path / "i").rglob("postings/**/*.parquet"), key=lambda p: p.stat().st_size)
    whole = file.read_bytes()
    file.write_bytes(whole[: len(whole) // 2])  # another size: seen without reading
    assert found.store.damaged() and found.recover() and not found.store.damaged()
    same_as_scan(found, df, QUERIES[:1])
    for file in (tmp_path / "i").rglob("format=2/data/postings/**/*.parquet"):
        file.write_bytes(bytes(len(file.read_bytes())))  # the same size: seen when read
    assert not found.store.damaged() and {h.chunk_id for h in found.search("tin", 5).collect()} == {"b"}
    same_as_scan(found, df, QUERIES[:1])
    index.SearchIndex(spark, str(tmp_path / "i")).store.append({"dead": spark.createDataFrame([], "of bigint, block bigint, ord int")})
    next((tmp_path / "i").rglob("format=2/data/chunks/**/*.parquet")).unlink()
    assert {r.action for r in index.SearchIndex(spark, str(tmp_path / "i")).sync(df).collect()} == {"insert"}
    assert len(list((tmp_path / "i").glob("quarantine-*"))) == 3


def test_two_writers_do_not_overwrite_each_other(spark, tmp_path):
    one, two = (index.SearchIndex(spark, str(tmp_path / "i")) for _ in range(2))
    part = two.store.stage("vectors", spark.createDataFrame([("a", [1.0])], "chunk_id string, embedding array<float>"))
    one.sync(chunks(spark, FIRST))
    with pytest.raises(store.Conflict):
        two.store.commit({"vectors": [part]}, 0)
    assert two.chunks().count() == 5 and two.store.read("vectors").count() == 0
    assert two.store.add({"vectors": [part]}) == 2 and two.store.read("vectors").count() == 1


def test_postings_are_made_where_a_block_is_read(spark, tmp_path, monkeypatch):
    """No shuffle of words; a block that two tasks read, and one with a text of more words than 16 bits count, give the hits of a scan."""
    df = chunks(spark, [*FIRST, ("s6", "g", "word " * 70_000 + "foo bar copper kettle")])
    plan = index.postings(index.located(index.sized(df)).localCheckpoint())._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "MapInArrow" in plan
    whole = index.postings
    monkeypatch.setattr(index, "PER_BLOCK", 1000)
    monkeypatch.setattr(index, "postings", lambda c: whole(c.repartition(5)))
    found = index.SearchIndex(spark, str(tmp_path / "i"))
    found.sync(df)
    same_as_scan(found, df, ("kettle copper", "foo-bar copper-kettle"))
    assert found.counts().first().n_tokens == df.select(F.sum(F.size(index.tokens(F.coalesce("text", F.lit("")))))).first()[0]
    found.store.commit({}, found.store.version(), {"layout": index.LAYOUT - 1})
    with pytest.raises(store.Corrupt):
        found.delete(spark.createDataFrame([("s1",)], "original_id string"))
    assert {r.action for r in found.sync(df).collect()} == {"insert"} and not found.outdated()
