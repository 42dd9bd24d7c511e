"""Queries on chunks and the search index that is built from them, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import index as I
from ..operators import knowledge as K
from ..operators import publication as P
from ..operators.jobs import EXTRACTION
from ..sources import parsers
from . import tables as D
from .registry import query


def observed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Observations and evidence of the blocks of conversations."""
    b = parsers.text_blocks(D.conversations(spark, sf_dir), "conv_id").withColumn("evidence_id", D.evidence_id(F.col("conv_id"), F.col("start"), F.col("end")))
    observation = T.stable_id("observation", F.to_json(F.struct(F.lit("text-block").alias("kind"), F.array("evidence_id").alias("evidence"))))
    selector = F.to_json(F.struct(F.col("end"), F.lit("utf8-byte-range").alias("kind"), F.col("start")))
    producer = F.when(F.col("pos") % 5 == 4, "knowledge/1").otherwise(EXTRACTION)
    payload = F.to_json(F.struct("text"))
    observations = b.select(observation.alias("observation_id"), F.lit("text-block").alias("kind"), payload.alias("payload"), F.array("evidence_id").alias("evidence_ids"), producer.alias("producer"))
    return observations, b.select("evidence_id", F.col("conv_id").cast("string").alias("original_id"), selector.alias("selector"))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsers.chunks(*observed(spark, sf_dir))


CHUNK_SQL = f"""{D.CONVERSATION_SQL}, ev AS (SELECT CAST(conv_id AS VARCHAR) AS original_id, pos, text, '{{"end":' || "end" || ',"kind":"utf8-byte-range","start":' || "start" || '}}' AS selector,
  sha256('evidence' || chr(0) || '{{"source":"' || conv_id || '","selector":{{"end":' || "end" || ',"kind":"utf8-byte-range","start":' || "start" || '}}}}') AS evidence_id FROM blocks),
ob AS (SELECT *, sha256('observation' || chr(0) || '{{"kind":"text-block","evidence":["' || evidence_id || '"]}}') AS observation_id FROM ev WHERE pos % 5 <> 4),
chunk AS (SELECT *, sha256('chunk' || chr(0) || '{{"evidence":"' || evidence_id || '","observation":"' || observation_id || '","part":0,"processor":"{I.CHUNKER}","version":"{I.CHUNKER_VERSION}"}}') AS chunk_id FROM ob),
digests AS (SELECT original_id, count(*) AS n_chunks, sha256(string_agg(sha256('{{"chunk_id":"' || chunk_id || '","observation_id":"' || observation_id || '","evidence_id":"' || evidence_id || '","selector":' || to_json(selector) || ',"text":' || to_json(text) || ',"producer":"{EXTRACTION}"}}'), chr(10) ORDER BY chunk_id)) AS digest FROM chunk GROUP BY original_id)"""


@query(f"WITH {CHUNK_SQL} SELECT original_id, chunk_id, observation_id, evidence_id, selector, sha256(text) AS text_hash FROM chunk")
def chunk_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of what the extraction observed, with their evidence."""
    return chunks(spark, sf_dir).withColumn("text_hash", F.sha2("text", 256)).drop("text", "producer")


@query(f"WITH {CHUNK_SQL} SELECT * FROM digests")
def chunk_set_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.source_digests(chunks(spark, sf_dir))


@query(
    f"""WITH {CHUNK_SQL}, k AS (SELECT original_id, length(digest) AS x, CAST(original_id AS BIGINT) % 5 AS five FROM digests)
SELECT original_id, CASE five WHEN 0 THEN 'replace' WHEN 1 THEN 'insert' WHEN 2 THEN 'delete' WHEN 3 THEN 'replace' ELSE 'keep' END AS action FROM k"""
)
def chunk_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an index does with each source: other text, a new source, one that went, one chunk more, and no change."""
    now, five = I.source_digests(chunks(spark, sf_dir)), F.col("original_id").cast("bigint") % 5
    stored = now.where(five != 1).withColumns({"digest": F.when(five == 0, F.sha2("digest", 256)).otherwise(F.col("digest")), "n_chunks": F.when(five == 3, F.col("n_chunks") + 1).otherwise(F.col("n_chunks"))})
    return I.chunk_actions(stored, now.where(five != 2))


@query(f"WITH {CHUNK_SQL} SELECT chunk_id, 'rebuilding' AS state FROM chunk WHERE ascii(chunk_id) % 3 = 0")
def embedding_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks that still need a vector of the same model."""
    c, model = chunks(spark, sf_dir).select("chunk_id", "text"), I.Model("m", "1", 2)
    state, missing = I.embedding_plan(c, c.where(F.ascii("chunk_id") % 3 != 0), model, model)
    return missing.select("chunk_id", F.lit(state).alias("state"))


@query(f"WITH {CHUNK_SQL} SELECT chunk_id, 'rebuilding' AS state FROM chunk")
def embedding_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Another revision of the model makes every vector again."""
    c = chunks(spark, sf_dir).select("chunk_id", "text")
    state, missing = I.embedding_plan(c, c, I.Model("m", "1", 2), I.Model("m", "2", 2))
    return missing.select("chunk_id", F.lit(state).alias("state"))


@query(f"WITH {CHUNK_SQL} SELECT original_id, chunk_id FROM chunk WHERE CAST(original_id AS BIGINT) % 3 <> 0")
def source_cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = chunks(spark, sf_dir).select("original_id", "chunk_id")
    return I.without_sources(c, c.where(F.col("original_id").cast("bigint") % 3 == 0))


@query(f"WITH {CHUNK_SQL} SELECT count(DISTINCT original_id) AS n_sources, count(*) AS n_chunks, CAST(max(strlen(text)) AS INTEGER) AS largest FROM chunk")
def index_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(spark, sf_dir).agg(F.count_distinct("original_id").alias("n_sources"), F.count("*").alias("n_chunks"), F.max(F.octet_length("text")).alias("largest"))


@query(
    f"""WITH {D.CONVERSATION_SQL}, i AS (SELECT CAST(conv_id AS VARCHAR) AS original_id, pos, pos // 4 AS batch, '{{"kind":"text-block","selector":"' || "start" || '","payload":"' || "end" || '","structural_only":false}}' AS identity FROM blocks)
SELECT original_id, CAST(batch AS INTEGER) AS batch, count(*) AS n_fragments, sha256(string_agg(identity, chr(10) ORDER BY pos)) AS digest FROM i GROUP BY ALL"""
)
def batch_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A digest of each batch of fragments; here four blocks make a batch."""
    b = parsers.text_blocks(D.conversations(spark, sf_dir), "conv_id")
    f = b.select(
        F.col("conv_id").cast("string").alias("original_id"), F.col("pos").alias("ordinal"), F.floor(F.col("pos") / 4).cast("int").alias("batch"), F.lit("text-block").alias("kind"), F.col("start").cast("string").alias("selector"),
        F.col("end").cast("string").alias("payload"), F.lit(None).cast("string").alias("context"), F.lit(False).alias("structural_only"),
    )
    return P.batch_digests(f)


@query(f"WITH {CHUNK_SQL} SELECT original_id, observation_id, 'text-block' AS kind, selector, sha256(text) AS text_hash, evidence_id FROM ob")
def rehydrated_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fragments again from stored observations and their evidence."""
    f = parsers.rehydrated(*observed(spark, sf_dir))
    return f.select("original_id", "observation_id", "kind", "selector", F.sha2("text", 256).alias("text_hash"), "evidence_id")


@query(
    """WITH s AS (SELECT s_suppkey AS k, 'e' || s_suppkey AS evidence_id, s_name, CAST(trunc(s_acctbal) AS BIGINT) AS bal FROM supplier WHERE s_suppkey % 5 > 0)
SELECT evidence_id, 'entity-candidate' AS kind, '{"label":"' || s_name || '","ref":"a","type":"partner"}' AS payload, 0.75 AS confidence FROM s
UNION ALL SELECT evidence_id, 'entity-candidate', '{"label":"place","ref":"b","type":""}', 0.5 FROM s
UNION ALL SELECT evidence_id, 'attribute-candidate', '{"predicate":"balance","subject_ref":"a","value":' || bal || '}', 0.25 FROM s
UNION ALL SELECT evidence_id, 'relationship-candidate', '{"object_ref":"b","predicate":"in","subject_ref":"a"}', 1.0 FROM s WHERE k % 2 = 0"""
)
def semantic_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations of model answers; every fifth fragment was skipped."""
    s = D.table(spark, sf_dir, "supplier")
    entity = lambda ref, label, kind, sure: F.struct(F.lit(ref).alias("ref"), label.alias("label"), F.lit(kind).alias("type"), F.lit(sure).alias("confidence"))
    attribute = F.struct(F.lit("a").alias("subject_ref"), F.lit("balance").alias("predicate"), F.col("s_acctbal").cast("bigint").alias("value"), F.lit(0.25).alias("confidence"))
    relation = F.struct(F.lit("a").alias("subject_ref"), F.lit("in").alias("predicate"), F.lit("b").alias("object_ref"), F.lit(1.0).alias("confidence"))
    answer = F.to_json(
        F.struct(
            F.array(entity("a", F.concat(F.lit("  "), "s_name"), "partner", 0.75), entity("b", F.lit("place"), " ", 0.5)).alias("entities"), F.array(attribute).alias("attributes"),
            F.when(F.col("s_suppkey") % 2 == 0, F.array(relation)).alias("relationships"),
        )
    )
    rows = s.select(F.format_string("e%d", "s_suppkey").alias("evidence_id"), F.when(F.col("s_suppkey") % 5 > 0, answer).alias("answer"))
    return K.candidate_observations(rows, rows, "knowledge/1").select("evidence_id", "kind", "payload", "confidence")
