"""The driver's tables seen as an archive: originals, graph records and jobs made of whole tables by expressions."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import stable_id
from ..operators.index import SearchIndex, fingerprint
from ..operators.knowledge import entity_id
from ..sources.store import Conflict, shared_folder


def index(spark: SparkSession, sf_dir: str) -> SearchIndex:
    """The search index over the documents, one chunk each, in the shared folder. It is brought up to date when the table's
    files are others than it was last made from; a query over the same files reads no text."""
    path = f"{shared_folder(spark)}/lorehouse-index-{hashlib.sha256(sf_dir.encode()).hexdigest()[:32]}"
    docs, name, none = table(spark, sf_dir, "documents"), F.lpad(F.col("doc_id").cast("string"), 20, "0"), F.lit("")
    found = SearchIndex(spark, path)
    try:
        found.sync(docs.select(name.alias("original_id"), name.alias("chunk_id"), none.alias("observation_id"), none.alias("evidence_id"), none.alias("selector"), "text", none.alias("producer")), fingerprint(spark, docs))
    except Conflict:  # another query has just done it
        pass
    return found


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a table that one task makes records of.
PER_TASK = 65_536


def spread(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` in parts of about ``PER_TASK``, whatever the bytes of the files: repeated values compress so well that a task
    would read millions of rows, and hold all that is made of them. The count comes from the files' footers."""
    parts = -(-rows.count() // PER_TASK)
    return rows.repartition(parts, key) if parts > 1 else rows


def item_id(n: Column) -> Column:
    return F.format_string("%08x-0000-4000-8000-%012x", n, n)


def bronze(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    made = F.lit(1_700_000_000_000) + F.col("doc_id")
    return d.select(
        item_id(F.col("doc_id")).alias("id"), F.lit(1).cast("bigint").alias("revision"), F.sha2("text", 256).alias("hash"), F.lit(False).alias("deleted"),
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("title"), F.lit("text/plain").alias("mime"),
        F.octet_length("text").cast("bigint").alias("size"), made.alias("created"), made.alias("modified"), F.col("doc_id"),
    )


BRONZE_SQL = """
bronze AS (
  SELECT format('{:08x}-0000-4000-8000-{:012x}', doc_id, doc_id) AS id, CAST(1 AS BIGINT) AS revision, sha256(text) AS hash, false AS deleted,
         'doc-' || doc_id || '.txt' AS title, 'text/plain' AS mime, CAST(strlen(text) AS BIGINT) AS size,
         1700000000000 + doc_id AS created, 1700000000000 + doc_id AS modified, doc_id
  FROM documents
)"""


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entity candidates of customers, nations and regions; regions are named with noise in case and blanks as well."""
    kinds = (("customer", "c_custkey", "c_name"), ("nation", "n_nationkey", "n_name"), ("region", "r_regionkey", "r_name"))
    found = None
    for name, key, label in kinds:
        rows = spread(table(spark, sf_dir, name), key).select(F.lit(name).alias("type"), F.col(key).cast("bigint").alias("key"), F.col(label).alias("label"))
        found = rows if found is None else found.unionByName(rows)
    noisy = table(spark, sf_dir, "region").select(F.lit("region").alias("type"), F.col("r_regionkey").cast("bigint").alias("key"), F.concat(F.lit("  "), F.lower("r_name"), F.lit(" \t")).alias("label"))
    return found.unionByName(noisy).withColumn("confidence", F.lit(0.9)).withColumn("entity_id", entity_id(F.col("label"), F.col("type")))


ENTITY_SQL = r"""
named AS (
  SELECT 'customer' AS type, c_custkey AS key, c_name AS label FROM customer
  UNION ALL SELECT 'nation', n_nationkey, n_name FROM nation
  UNION ALL SELECT 'region', r_regionkey, r_name FROM region
  UNION ALL SELECT 'region', r_regionkey, '  ' || lower(r_name) || ' ' || chr(9) FROM region
), entity AS (
  SELECT *, sha256('entity' || chr(0) || '{"label":"' || regexp_replace(regexp_replace(lower(label), '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g') || '","type":"' || type || '","resolver":"label-type-v1"}') AS entity_id
  FROM named
)"""


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims of the customer graph: a name and a segment each, and the nation each lives in; one in eleven is superseded."""
    c = spread(table(spark, sf_dir, "customer"), "c_custkey")
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    who, where = entity_id(F.col("c_name"), F.lit("customer")), entity_id(F.col("n_name"), F.lit("nation"))
    none = F.lit(None).cast("string")
    both = c.join(nation, "c_nationkey")
    row = lambda k, predicate, value, target: F.struct(F.lit(k).alias("k"), F.lit(predicate).alias("predicate"), value.alias("value"), target.alias("object_entity_id"))
    three = F.explode(F.array(row(0, "name", F.col("c_name"), none), row(1, "market_segment", F.col("c_mktsegment"), none), row(2, "located_in", none, where)))
    rows = both.select("c_custkey", "c_acctbal", who.alias("subject_entity_id"), three.alias("r")).select("c_custkey", "c_acctbal", "subject_entity_id", "r.*")
    return rows.select(
        F.format_string("c-%d-%d", "c_custkey", "k").alias("claim_id"), "subject_entity_id", "predicate", "value", "object_entity_id",
        F.array(F.format_string("o-%d-%d", "c_custkey", "k"), F.format_string("o-%d-9", "c_custkey")).alias("supporting_observation_ids"),
        F.when((F.col("c_custkey") % 11 == 0) & (F.col("k") == 1), "superseded").otherwise("active").alias("state"),
    )


CLAIM_SQL = (
    ENTITY_SQL
    + r""", claim AS (
  SELECT format('c-{}-{}', c_custkey, k) AS claim_id, s.entity_id AS subject_entity_id, predicate,
         CASE k WHEN 0 THEN c_name WHEN 1 THEN c_mktsegment END AS value, CASE WHEN k = 2 THEN o.entity_id END AS object_entity_id,
         [format('o-{}-{}', c_custkey, k), format('o-{}-9', c_custkey)] AS supports,
         CASE WHEN c_custkey % 11 = 0 AND k = 1 THEN 'superseded' ELSE 'active' END AS state, c_custkey, k
  FROM customer JOIN nation ON c_nationkey = n_nationkey
  JOIN entity s ON s.type = 'customer' AND s.key = c_custkey JOIN entity o ON o.type = 'nation' AND o.key = n_nationkey,
  (VALUES (0, 'name'), (1, 'market_segment'), (2, 'located_in')) p(k, predicate)
), observation AS (
  SELECT format('o-{}-{}', c_custkey, k) AS observation_id, format('e-{}', c_custkey) AS evidence_id,
         CASE WHEN c_custkey % 5 > 0 OR k = 9 THEN round(0.5 + (c_custkey % 50) / 100.0, 2) END AS confidence, c_custkey, k
  FROM customer, (VALUES (0), (1), (2), (9), (10)) p(k)
)"""
)


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spread(table(spark, sf_dir, "customer"), "c_custkey")
    rows = c.select("c_custkey", F.explode(F.array(*map(F.lit, (0, 1, 2, 9, 10)))).alias("k"))
    confidence = F.when((F.col("c_custkey") % 5 > 0) | (F.col("k") == 9), F.round(0.5 + (F.col("c_custkey") % 50) / 100.0, 2))
    return rows.select(F.format_string("o-%d-%d", "c_custkey", "k").alias("observation_id"), F.array(F.format_string("e-%d", "c_custkey")).alias("evidence_ids"), confidence.alias("confidence"), "c_custkey", "k")


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "customer"), "c_custkey").select(F.format_string("e-%d", "c_custkey").alias("evidence_id"), item_id(F.col("c_custkey") % 100).alias("original_id"))


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    at = F.unix_millis(F.col("o_orderdate").cast("timestamp"))
    state = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderkey") % 13 == 0, "cancelled").when(F.col("o_orderkey") % 3 == 0, "running").when(F.col("o_orderkey") % 7 == 0, "failed").otherwise("queued")
    return o.select(F.col("o_orderkey").cast("string").alias("key"), state.alias("state"), at.alias("queued_at"), F.when(F.col("o_orderstatus") == "F", at + F.col("o_orderkey") % 1000).alias("completed_at"))


JOB_SQL = """
job AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS key, CASE WHEN o_orderstatus = 'F' THEN 'completed' WHEN o_orderkey % 13 = 0 THEN 'cancelled'
         WHEN o_orderkey % 3 = 0 THEN 'running' WHEN o_orderkey % 7 = 0 THEN 'failed' ELSE 'queued' END AS state,
         epoch_ms(o_orderdate) AS queued_at, CASE WHEN o_orderstatus = 'F' THEN epoch_ms(o_orderdate) + o_orderkey % 1000 END AS completed_at
  FROM orders
), shown AS (SELECT key, CASE WHEN state = 'completed' THEN 'completed' ELSE 'queued' END AS state, queued_at, completed_at FROM job WHERE state <> 'cancelled')"""


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, text): the turns of each conversation with a blank line between them."""
    c = table(spark, sf_dir, "conversations")
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", F.coalesce("text", F.lit("")).alias("said"))))
    return c.groupBy("conv_id").agg(turns.alias("t")).select("conv_id", F.array_join(F.transform("t", lambda x: x["said"]), "\n\n").alias("text"))


CONVERSATION_SQL = """
conversation AS (
  SELECT conv_id, string_agg(coalesce(text, ''), chr(10) || chr(10) ORDER BY turn, role, coalesce(text, '')) AS text FROM conversations GROUP BY conv_id
), parts AS (
  SELECT conv_id, unnest(range(0, len(string_split(text, chr(10) || chr(10))))) AS pos, unnest(string_split(text, chr(10) || chr(10))) AS raw FROM conversation
), placed AS (
  SELECT *, coalesce(sum(strlen(raw) + 2) OVER (PARTITION BY conv_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM parts
), block AS (
  SELECT conv_id, pos, CAST(base + strlen(raw) - strlen(ltrim(raw, E' \\t\\n\\r')) AS BIGINT) AS "start", trim(raw, E' \\t\\n\\r') AS text FROM placed WHERE trim(raw, E' \\t\\n\\r') <> ''
), blocks AS (SELECT conv_id, CAST(pos AS INTEGER) AS pos, "start", "start" + strlen(text) AS "end", text FROM block)"""


def evidence_id(source: Column, start: Column, end: Column) -> Column:
    span = F.struct(source.cast("string").alias("source"), F.struct(end.alias("end"), F.lit("utf8-byte-range").alias("kind"), start.alias("start")).alias("selector"))
    return stable_id("evidence", F.to_json(span))
