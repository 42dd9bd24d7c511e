"""Every registered query against its SQL."""

from collections import Counter
from pathlib import Path

import duckdb
import pytest

from lorehouse.functions.text import canonical_json
from lorehouse.plans import catalogue, tables
from lorehouse.sources import ingest, parsers
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.01"


def rows(frame, columns):
    norm = lambda v: None if v is None else repr(round(v, 6)) if isinstance(v, float) else str(v)
    return Counter(tuple(norm(v) for v in r) for r in frame[columns].astype(object).where(frame[columns].notna(), None).itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    ours, theirs = catalogue.queries()[name](spark, DATA).toPandas(), duck.execute(catalogue.oracle_sql()[name]).df()
    columns = sorted(theirs.columns)
    assert sorted(ours.columns) == columns
    assert rows(ours, columns) == rows(theirs, columns)


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_query_runs(spark, name):
    assert catalogue.queries()[name](spark, DATA).count() > 0


def test_document_fragments_equal_the_grammar(spark):
    """The query without SQL, against the parsers of single documents on every original that is ready."""
    found = catalogue.document_fragments(spark, DATA).select("original_id", "ordinal", "kind", "selector", "structural_only").collect()
    ready = ingest.outcomes(catalogue.originals(spark, DATA)).where("state = 'ready'").select("original_id", "parser", "content").collect()
    want = Counter()
    for r in ready:
        for i, f in enumerate(parsers.fragments_of(r.parser, bytes(r.content))):
            want[(r.original_id, i, f["kind"], canonical_json(f["selector"]), f["structural_only"])] += 1
    assert Counter(map(tuple, found)) == want


def test_file_sizes_past_64_bits(spark, tmp_path):
    """Keys of tables 60 and more times as large; their product has no 64-bit number."""
    keys = [(0, 5), (3, 10), (8_999_999, 899_999), (2**62, 2**62), (None, 1)]
    spark.createDataFrame(keys, "o_orderkey bigint, o_custkey bigint").write.parquet(f"{tmp_path}/orders.parquet")
    told = {r["o_orderkey"]: r["text"] for r in catalogue.queries()["file_sizes"](spark, str(tmp_path)).collect()}
    assert told[0] == "0 B" and told[3] == "99 B" and told[None] is None
    assert told[8_999_999] == f"{(8_999_999**2 * 900_000 + 2**39) // 2**40} TB" and told[2**62].endswith(" TB")


def test_millions_of_small_rows_are_spread(spark, tmp_path):
    """A file of few bytes may have many rows: records are made of them in many tasks, and nothing that grows is broadcast."""
    c = spark.range(150_000).select(F.col("id").alias("c_custkey"), F.lit("Customer#1").alias("c_name"), (F.col("id") % 25).cast("int").alias("c_nationkey"), F.lit(0.0).alias("c_acctbal"), F.lit("BUILDING").alias("c_mktsegment"))
    c.coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    for t in ("nation", "region"):
        (tmp_path / f"{t}.parquet").symlink_to(f"{DATA}/{t}.parquet")
    for made in (tables.claims, tables.observations, tables.evidence, tables.entities):
        assert made(spark, str(tmp_path)).rdd.getNumPartitions() >= 3
    for name in ("provenance_walk", "claim_groups", "source_knowledge"):
        plan = catalogue.queries()[name](spark, str(tmp_path))._jdf.queryExecution().sparkPlan().toString()
        assert "SortMergeJoin" in plan and all("nationkey" in x for x in plan.splitlines() if "BroadcastHashJoin" in x)
        assert "collect_list" not in plan
    assert catalogue.queries()["provenance_walk"](spark, str(tmp_path)).count() == 450_000


def test_routes_are_tested_once(spark):
    """The tests of an original's bytes are not copied into the uses of what they tell."""
    o = spark.createDataFrame([(1, "csv", "a,b\n1,2")], "original_id int, parser string, content string")
    plan = parsers.parse(o)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("(?:^|[,") == 2
