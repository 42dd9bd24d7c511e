"""The registered queries over the driver's tables, each with its DuckDB equivalent."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import bronze as B
from ..operators import graph as G
from ..operators import knowledge as K
from ..operators import retrieval as R
from ..operators import sync as S
from ..sources import dispatch, ingest, parsers
from . import lifecycle, navigation, presentation, search_index  # noqa: F401  their queries register themselves
from . import tables as D
from .registry import oracle_sql, queries, query  # noqa: F401

TEXT_QUERY, PHRASE_QUERY, OMNI_QUERY = "the and license", "of-the is-the", "customer#00000001"


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text", "source", "lang")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hybrid_rrf(spark, sf_dir)


# Bronze ---------------------------------------------------------------------------------------------------------------

ITEM = ["id", "revision", "hash", "deleted", "title", "mime", "size", "created", "modified"]


@query(f"WITH {D.BRONZE_SQL} SELECT {', '.join(ITEM)} FROM bronze")
def bronze_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.manifest(D.bronze(spark, sf_dir)).select(*ITEM)


def successors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each item, by its number: itself, its tombstone, a tombstone too far ahead, a replacement, or a new item."""
    k = F.col("doc_id") % 5
    return D.bronze(spark, sf_dir).select(
        F.when(k == 4, D.item_id(F.col("doc_id") + 16_000_000)).otherwise(F.col("id")).alias("id"),
        F.when(k.isin(1, 3), 2).when(k == 2, 3).otherwise(1).cast("bigint").alias("revision"),
        F.when(k == 3, F.sha2("hash", 256)).otherwise(F.col("hash")).alias("hash"), k.isin(1, 2).alias("deleted"), "title", "mime", "size", "created",
        (F.col("modified") + F.when(k.isin(0, 4), 0).otherwise(1)).alias("modified"),
    )


@query(
    f"""WITH {D.BRONZE_SQL}
SELECT CASE WHEN doc_id % 5 = 4 THEN format('{{:08x}}-0000-4000-8000-{{:012x}}', doc_id + 16000000, doc_id + 16000000) ELSE id END AS id,
       CASE doc_id % 5 WHEN 0 THEN 'noop' WHEN 1 THEN 'tombstone' WHEN 4 THEN 'insert' ELSE 'conflict' END AS action FROM bronze"""
)
def bronze_commit_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.commit_actions(D.bronze(spark, sf_dir).select(*ITEM), successors(spark, sf_dir)).select("id", "action")


@query(f"WITH {D.BRONZE_SQL}, b AS (SELECT * REPLACE (doc_id % 7 = 0 AS deleted) FROM bronze) SELECT DISTINCT hash, size FROM b WHERE hash NOT IN (SELECT hash FROM b WHERE NOT deleted)")
def bronze_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = D.bronze(spark, sf_dir).withColumn("deleted", F.col("doc_id") % 7 == 0)
    return B.unused_blobs(items.select("hash", "size").distinct(), items)


@query(f"WITH {D.BRONZE_SQL} SELECT hash, any_value(size) AS size, count(*) AS n_items FROM bronze GROUP BY hash")
def bronze_blob_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = D.bronze(spark, sf_dir)
    new = B.new_blobs(items.select("hash", "size"), items.select("hash").limit(0))
    return new.join(items.groupBy("hash").agg(F.count("*").alias("n_items")), "hash")


@query("SELECT doc_id, strlen(text) AS size FROM documents WHERE doc_id % 7 <> 0 AND text IS NOT NULL")
def bronze_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = D.bronze(spark, sf_dir).withColumn("deleted", F.col("doc_id") % 7 == 0)
    blobs = D.table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("hash"), F.encode("text", "UTF-8").alias("content")).dropDuplicates(["hash"])
    return B.verified(B.readable(items, blobs)).select("doc_id", F.octet_length("content").cast("bigint").alias("size"))


# Formats and parsers --------------------------------------------------------------------------------------------------


def originals(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = lambda t, key, title, mime, text: D.table(spark, sf_dir, t).select(F.concat(F.lit(f"{t}-"), F.col(key).cast("string")).alias("original_id"), title.alias("title"), F.lit(mime).alias("mime"), F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8").alias("content"))
    kinds = F.element_at(F.array(*map(F.lit, (".txt", ".md", ".csv", ".PNG"))), (F.col("doc_id") % 4 + 1).cast("int"))
    docs = row("documents", "doc_id", F.concat(F.lit("doc"), kinds), "text/plain; charset=utf-8", "text")
    pages = row("pages", "page_id", F.lit("page.html"), " TEXT/HTML", "html")
    return docs.unionByName(pages).unionByName(row("events", "event_id", F.lit("event"), "application/json", "props"))


@query(
    """SELECT 'documents-' || doc_id AS original_id, CASE doc_id % 4 WHEN 1 THEN 'markdown' WHEN 2 THEN 'csv' ELSE 'text' END AS parser,
       CASE WHEN doc_id % 4 = 3 THEN 'skipped' ELSE 'ready' END AS state, CASE WHEN doc_id % 4 = 3 THEN 'unsupported_content' END AS reason FROM documents
UNION ALL SELECT 'pages-' || page_id, 'text', 'ready', NULL FROM pages UNION ALL SELECT 'events-' || event_id, 'json', 'ready', NULL FROM events"""
)
def format_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = originals(spark, sf_dir)
    how = dispatch.outcome(F.col("title"), F.col("mime"), F.octet_length("content"), F.col("content"))
    return o.select("original_id", dispatch.parser_of(F.col("title"), F.col("mime")).alias("parser"), how.alias("o")).select("original_id", "parser", "o.state", "o.reason")


@query(f'WITH {D.CONVERSATION_SQL} SELECT conv_id, pos, "start", "end", text FROM blocks')
def text_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsers.text_blocks(D.conversations(spark, sf_dir), "conv_id")


@query("SELECT event_id AS original_id, '/' || j.key AS path, j.value AS value, '/' || j.key || ': ' || j.value AS retrieval_text FROM events, json_each(props) j WHERE props IS NOT NULL")
def json_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = D.table(spark, sf_dir, "events").select(F.col("event_id").alias("original_id"), F.lit("json").alias("parser"), F.col("props").alias("content"))
    found = parsers.parse(e).where("kind = 'parsed-json-value'")
    shown = parsers.retrieval_text(F.col("kind"), F.col("payload"))
    return found.select("original_id", F.get_json_object("payload", "$.path").alias("path"), F.col("text").alias("value"), shown.alias("retrieval_text"))


CSV_COLUMNS = ["o_orderkey", "o_orderstatus", "o_orderpriority"]


@query(
    """WITH r AS (SELECT o_custkey AS original_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) + 1 AS BIGINT) AS row, CAST(o_orderkey AS VARCHAR) AS o_orderkey, o_orderstatus, o_orderpriority FROM orders)
SELECT original_id, row, name AS column, value FROM (UNPIVOT r ON o_orderkey, o_orderstatus, o_orderpriority INTO NAME name VALUE value) WHERE trim(value) <> ''"""
)
def csv_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = D.table(spark, sf_dir, "orders")
    line = F.struct("o_orderkey", F.concat_ws(",", *[F.col(c).cast("string") for c in CSV_COLUMNS]).alias("line"))
    files = o.groupBy("o_custkey").agg(F.array_sort(F.collect_list(line)).alias("l"))
    content = F.concat(F.lit(",".join(CSV_COLUMNS) + "\n"), F.array_join(F.transform("l", lambda x: x["line"]), "\n"))
    found = parsers.parse(files.select(F.col("o_custkey").alias("original_id"), F.lit("csv").alias("parser"), content.alias("content"))).where("kind = 'parsed-table-cell'")
    cell = F.from_json("payload", "row bigint, column string")  # read once for both
    return found.select("original_id", F.explode(F.array(cell)).alias("c"), F.col("text").alias("value")).select("original_id", "c.row", "c.column", "value")


@query(
    """SELECT c_custkey AS original_id, p.key AS key, p.value AS value, p.key || ': ' || p.value AS text FROM customer,
LATERAL (VALUES ('Name', c_name), ('Market segment', c_mktsegment), ('Nation', CAST(c_nationkey AS VARCHAR))) p(key, value)"""
)
def key_value_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = D.table(spark, sf_dir, "customer")
    text = F.concat(F.lit(" Name: "), "c_name", F.lit("\nMarket segment:"), "c_mktsegment", F.lit("  \n\nNation : ").substr(F.lit(1), F.lit(3)), F.lit("Nation: "), F.col("c_nationkey").cast("string"))
    found = parsers.parse(c.select(F.col("c_custkey").alias("original_id"), F.lit("text").alias("parser"), F.regexp_replace(text, "\n+", "\n").alias("content"))).where("kind = 'parsed-key-value'")
    at = lambda p: F.get_json_object("payload", p)
    return found.select("original_id", at("$.key").alias("key"), at("$.value").alias("value"), F.concat(at("$.key"), F.lit(": "), at("$.value")).alias("text"))


@query(
    f"""WITH {D.CONVERSATION_SQL}, e AS (SELECT conv_id, pos, sha256('evidence' || chr(0) || '{{"source":"' || conv_id || '","selector":{{"end":' || "end" || ',"kind":"utf8-byte-range","start":' || "start" || '}}}}') AS evidence_id FROM blocks)
SELECT conv_id, pos, evidence_id, sha256('observation' || chr(0) || '{{"kind":"text-block","evidence":["' || evidence_id || '"]}}') AS observation_id FROM e"""
)
def evidence_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = text_blocks(spark, sf_dir).withColumn("evidence_id", D.evidence_id(F.col("conv_id"), F.col("start"), F.col("end")))
    return b.select("conv_id", "pos", "evidence_id", T.stable_id("observation", F.to_json(F.struct(F.lit("text-block").alias("kind"), F.array("evidence_id").alias("evidence")))).alias("observation_id"))


@query()
def document_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every original that is ready through its own parser, with the text that search sees."""
    found = ingest.fragments(originals(spark, sf_dir))
    return found.withColumn("retrieval_text", parsers.retrieval_text(F.col("kind"), F.col("payload"))).select("original_id", "ordinal", "kind", "selector", "structural_only", F.sha2(F.coalesce("retrieval_text", F.lit("")), 256).alias("text_hash"))


@query(
    """SELECT 'events-' || event_id AS original_id, 'ready' AS state, NULL AS reason, CASE WHEN props IS NULL THEN 0 ELSE len(json_keys(props)) END AS n_fragments FROM events
UNION ALL SELECT 'png-' || doc_id, 'skipped', 'unsupported_content', 0 FROM documents UNION ALL SELECT 'bad-' || doc_id, 'failed', 'invalid_utf8', 0 FROM documents"""
)
def ingested_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States of originals: events, documents under a picture's name, and documents behind a byte that is no text."""
    row = lambda t, key, prefix, title, mime, content: D.table(spark, sf_dir, t).select(F.concat(F.lit(prefix), F.col(key).cast("string")).alias("original_id"), F.lit(title).alias("title"), F.lit(mime).alias("mime"), content.alias("content"))
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    kinds = (row("events", "event_id", "events-", "event", "application/json", F.encode("props", "UTF-8")), row("documents", "doc_id", "png-", "a.PNG", "", text), row("documents", "doc_id", "bad-", "a.txt", "text/plain", F.concat(F.unhex(F.lit("FF")), text)))
    return ingest.ingested(kinds[0].unionByName(kinds[1]).unionByName(kinds[2]))


_STRIP = "E' \\t\\n\\r\\x0b\\x0c'"


@query(
    f"""WITH RECURSIVE c AS (SELECT doc_id, 0 AS part, CAST(NULL AS VARCHAR) AS chunk, trim(coalesce(text, ''), {_STRIP}) AS rest FROM documents
UNION ALL SELECT doc_id, part + 1, trim(left(rest, cut), {_STRIP}), trim(substr(rest, cut + 1), {_STRIP}) FROM (
  SELECT doc_id, part, rest, CASE WHEN strlen(rest) <= 3072 THEN length(rest) WHEN blank > 0 AND strlen(left(head, blank - 1)) >= 1536 THEN blank - 1 ELSE length(head) END AS cut FROM (
    SELECT *, length(head) - length(regexp_extract(head, '[^ \\t\\r\\n]*$')) AS blank FROM (
      SELECT doc_id, part, rest, coalesce(TRY(decode(array_slice(encode(rest), 1, 3072))), TRY(decode(array_slice(encode(rest), 1, 3071))), TRY(decode(array_slice(encode(rest), 1, 3070))), decode(array_slice(encode(rest), 1, 3069))) AS head FROM c WHERE rest <> ''))))
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY part) - 1 AS INTEGER) AS part, CAST(strlen(chunk) AS INTEGER) AS n_bytes, sha256(chunk) AS chunk_hash FROM c WHERE chunk <> ''"""
)
def chunk_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retrieval parts of at most 3072 bytes of every document."""
    d = D.table(spark, sf_dir, "documents").select("doc_id", F.posexplode(parsers.parts_for_retrieval(F.col("text"))).alias("part", "chunk"))
    return d.select("doc_id", "part", F.octet_length("chunk").alias("n_bytes"), F.sha2("chunk", 256).alias("chunk_hash"))


_ESCAPED = "replace(replace(replace(replace(replace(CAST(to_json(text) AS VARCHAR), '<', '_u003c'), '>', '_u003e'), '&', '_u0026'), chr(8232), '_u2028'), chr(8233), '_u2029')"


@query(
    f"""WITH RECURSIVE {D.CONVERSATION_SQL}, e AS (SELECT CAST(conv_id AS VARCHAR) AS original_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY pos) - 1 AS BIGINT) AS n,
  strlen('{{"fragment_id":"","kind":"text-block","selector":{{"end":' || "end" || ',"kind":"utf8-byte-range","start":' || "start" || '}},"payload":{{"text":' || {_ESCAPED} || '}}}}') + 64 AS size,
  strlen('{{"title":"t","mime":"text/plain","fragments":[]}}') AS head FROM blocks),
g AS (SELECT original_id, n, 0 AS batch, head + size AS used FROM e WHERE n = 0
  UNION ALL SELECT e.original_id, e.n, CASE WHEN used + 1 + size > 700 THEN batch + 1 ELSE batch END, CASE WHEN used + 1 + size > 700 THEN head + size ELSE used + 1 + size END FROM g JOIN e ON e.original_id = g.original_id AND e.n = g.n + 1)
SELECT original_id, CAST(batch AS INTEGER) AS batch, count(*) AS n_fragments, CAST(min(n) AS INTEGER) AS first FROM g GROUP BY ALL"""
)
def fragment_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy batches, of at most 700 bytes of model input, of the blocks of each conversation."""
    b = parsers.text_blocks(D.conversations(spark, sf_dir), "conv_id")
    ordinal = F.row_number().over(Window.partitionBy("conv_id").orderBy("pos")) - 1
    selector = F.to_json(F.struct(F.col("end"), F.lit("utf8-byte-range").alias("kind"), F.col("start")))
    f = b.select(
        F.col("conv_id").cast("string").alias("original_id"), ordinal.alias("ordinal"), F.lit("t").alias("title"), F.lit("text/plain").alias("mime"), F.lit("text-block").alias("kind"), selector.alias("selector"),
        F.to_json(F.struct("text")).alias("payload"), "text", F.lit(None).cast("string").alias("context"), F.lit(False).alias("structural_only"),
    )
    return K.batched(f, 700).groupBy("original_id", "batch").agg(F.count("*").alias("n_fragments"), F.min("ordinal").alias("first"))


# Retrieval ------------------------------------------------------------------------------------------------------------

WORDS = r"regexp_extract_all(lower(strip_accents(coalesce(text, ''))), '[\p{L}\p{N}\p{Co}]+')"


@query(f"WITH w AS (SELECT doc_id, unnest({WORDS}) AS term FROM documents) SELECT term, count(DISTINCT doc_id) AS n_docs_with, count(*) AS n_occurrences FROM w GROUP BY term")
def bm25_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.index(spark, sf_dir).term_statistics()


def _bm25_sql(phrases: list[list[str]], limit: int) -> str:
    def count(p: list[str]) -> str:
        test = " AND ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(p))
        return f"len(list_filter(range(1, len(w) + 1), lambda i: {test}))"

    tf = ", ".join(f"{count(p)} AS tf{k}" for k, p in enumerate(phrases))
    df = ", ".join(f"sum(CASE WHEN tf{k} > 0 THEN 1 ELSE 0 END) AS df{k}" for k in range(len(phrases)))
    score = " + ".join(f"greatest(1e-6, ln((n - df{k} + 0.5) / (df{k} + 0.5))) * tf{k} * 2.2 / (tf{k} + 1.2 * (0.25 + 0.75 * len / mean))" for k in range(len(phrases)))
    hit = " OR ".join(f"tf{k} > 0" for k in range(len(phrases)))
    return f"""lexical AS (
  SELECT chunk_id, score, CAST(row_number() OVER (ORDER BY score, chunk_id) AS INTEGER) AS rank FROM (
    SELECT doc_id AS chunk_id, round(-({score}), 9) AS score
    FROM (SELECT doc_id, len(w) AS len, {tf} FROM (SELECT doc_id, {WORDS} AS w FROM documents)) c,
         (SELECT count(*) AS n, avg(len) AS mean, {df} FROM (SELECT len(w) AS len, {tf} FROM (SELECT {WORDS} AS w FROM documents))) s
    WHERE {hit}) ORDER BY score, chunk_id LIMIT {limit})"""


def _lexical(spark: SparkSession, sf_dir: str, text: str, limit: int) -> DataFrame:
    return D.index(spark, sf_dir).lexical(text, limit).withColumn("chunk_id", F.col("chunk_id").cast("bigint"))


@query(f"WITH {_bm25_sql(R.phrases(TEXT_QUERY), 10)} SELECT * FROM lexical")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lexical(spark, sf_dir, TEXT_QUERY, 10)


@query(f"WITH {_bm25_sql(R.phrases(PHRASE_QUERY), 10)} SELECT * FROM lexical")
def bm25_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lexical(spark, sf_dir, PHRASE_QUERY, 10)


VECTOR_SQL = """q AS (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 0), nearest AS (
  SELECT chunk_id, distance, CAST(row_number() OVER (ORDER BY distance, chunk_id) AS INTEGER) AS rank FROM (
    SELECT vec_id AS chunk_id, round(list_cosine_distance(CAST(embedding AS DOUBLE[]), q), 6) + 0.0 AS distance FROM embeddings, q) ORDER BY distance, chunk_id LIMIT {k})"""


def vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[float]]:
    v = D.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    first = v.where("chunk_id = 0").first()
    return v, list(first["embedding"]) if first else [0.0]


@query(f"WITH {VECTOR_SQL.format(k=10)} SELECT * FROM nearest")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.nearest(*vectors(spark, sf_dir), 10)


@query(
    f"""WITH {_bm25_sql(R.phrases(TEXT_QUERY), 40)}, {VECTOR_SQL.format(k=40)}, fused AS (
  SELECT chunk_id, CAST(l.rank AS DOUBLE) AS lexical_rank, l.score AS lexical_score, CAST(s.rank AS DOUBLE) AS semantic_rank, s.distance AS semantic_distance,
         round(coalesce(1.0 / (60 + l.rank), 0) + coalesce(1.0 / (60 + s.rank), 0), 9) AS score
  FROM lexical l FULL JOIN nearest s USING (chunk_id))
, top AS (SELECT *, CAST(row_number() OVER (ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM fused ORDER BY score DESC, chunk_id LIMIT 10)
SELECT top.*, source, lang, sha256(text) AS text_hash FROM top JOIN documents ON doc_id = chunk_id"""
)
def hybrid_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, q = vectors(spark, sf_dir)
    hits = R.fuse(_lexical(spark, sf_dir, TEXT_QUERY, R.fetch(10)), R.nearest(v, q, R.fetch(10)), 10)
    hits = chunks(spark, sf_dir).join(F.broadcast(hits), "chunk_id").withColumn("text_hash", F.sha2("text", 256)).drop("text")
    return hits.withColumns({c: F.col(c).cast("double") for c in ("lexical_rank", "semantic_rank")})


@query("SELECT doc_id AS chunk_id FROM documents ANTI JOIN embeddings ON doc_id = vec_id")
def missing_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.missing_embeddings(chunks(spark, sf_dir), vectors(spark, sf_dir)[0]).select("chunk_id")


# Knowledge ------------------------------------------------------------------------------------------------------------


@query("WITH c AS (SELECT p_partkey, p_name, p_type, p_size FROM part) SELECT p_partkey AS batch, 'r' || (p_partkey % 3) AS ref, p_name AS label FROM c WHERE p_size <= 45 AND length(trim(p_name)) BETWEEN 1 AND 200 AND p_partkey % 10 <> 0")
def candidate_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of parts: sizes over 45 have a confidence over 1, every tenth has a bad type; each comes twice."""
    p = D.table(spark, sf_dir, "part")
    rows = p.select(
        F.col("p_partkey").alias("batch"), F.lit("f").alias("fragment_id"), F.explode(F.array(F.lit(0), F.lit(1))).alias("pos"), F.concat(F.lit("r"), (F.col("p_partkey") % 3).cast("string")).alias("ref"),
        F.col("p_name").alias("label"), F.when(F.col("p_partkey") % 10 == 0, "Not A Type").otherwise("part").alias("type"), (F.col("p_size") / 45.0).alias("confidence"),
    )
    return K.valid_entities(rows).select("batch", "ref", "label")


@query(f"WITH {D.ENTITY_SQL} SELECT entity_id, type, count(*) AS n_candidates FROM entity GROUP BY ALL")
def resolve_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = D.entities(spark, sf_dir).drop("entity_id")
    return K.resolve_entities(e).groupBy("entity_id", "type").agg(F.count("*").alias("n_candidates"))


@query(f"WITH {D.ENTITY_SQL} SELECT DISTINCT s.entity_id AS subject_entity_id, 'part_of' AS predicate, o.entity_id AS object_entity_id FROM nation JOIN entity s ON s.type = 'nation' AND s.key = n_nationkey JOIN entity o ON o.type = 'region' AND o.key = n_regionkey")
def resolve_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = D.entities(spark, sf_dir).select(F.lit(0).alias("batch"), F.concat_ws("-", "type", "key").alias("ref"), "entity_id").distinct()
    n = D.table(spark, sf_dir, "nation")
    r = n.select(F.lit(0).alias("batch"), F.concat(F.lit("nation-"), F.col("n_nationkey").cast("string")).alias("subject_ref"), F.concat(F.lit("region-"), F.col("n_regionkey").cast("string")).alias("object_ref"), F.lit("part_of").alias("predicate"), F.lit(0.9).alias("confidence"))
    return K.resolve_relationships(r, e, ["batch"]).select("subject_entity_id", "predicate", "object_entity_id")


@query(
    """SELECT source AS original_id, CAST(sum(2) AS BIGINT) AS n_semantic, CAST(sum(quality + toxic) AS BIGINT) AS n_completed,
       coalesce(array_to_string(list_sort(list_distinct(list(CASE WHEN quality = 0 THEN 'quality' WHEN toxic = 0 THEN 'toxic' END))), ','), '') AS reason,
       CASE WHEN sum(quality + toxic) >= sum(2) THEN 'ready' WHEN sum(quality + toxic) = 0 THEN 'skipped' ELSE 'partial' END AS state
FROM labels JOIN documents USING (doc_id) GROUP BY source"""
)
def coverage_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = D.table(spark, sf_dir, "labels").join(D.table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    reason = F.when(F.col("quality") == 0, "quality").when(F.col("toxic") == 0, "toxic")
    return K.coverage(rows.select(F.col("source").alias("original_id"), F.lit(2).cast("bigint").alias("n_semantic"), (F.col("quality") + F.col("toxic")).cast("bigint").alias("n_completed"), reason.alias("skip_reason")))


# Graph ----------------------------------------------------------------------------------------------------------------


def _entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.entities(spark, sf_dir).select("entity_id").distinct()


LABEL_SQL = f"{D.CLAIM_SQL}, names AS (SELECT e.entity_id, coalesce(arg_min(value, claim_id), 'Unnamed entity') AS label FROM (SELECT DISTINCT entity_id FROM entity) e LEFT JOIN claim c ON c.subject_entity_id = e.entity_id AND predicate = 'name' AND state = 'active' GROUP BY e.entity_id)"
ATTACHED_SQL = "attached AS (SELECT subject_entity_id AS entity_id, claim_id FROM claim WHERE state = 'active' UNION SELECT object_entity_id, claim_id FROM claim WHERE state = 'active' AND object_entity_id IS NOT NULL)"


@query(f"WITH {LABEL_SQL} SELECT * FROM names")
def entity_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.labels(_entities(spark, sf_dir), D.claims(spark, sf_dir))


@query(f"WITH {LABEL_SQL}, {ATTACHED_SQL} SELECT entity_id, label, count(claim_id) AS n_claims FROM names LEFT JOIN attached USING (entity_id) GROUP BY ALL")
def claim_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.claim_counts(_entities(spark, sf_dir), D.claims(spark, sf_dir))


@query(f"WITH {LABEL_SQL} SELECT claim_id, CASE WHEN object_entity_id IS NULL THEN replace(predicate, '_', ' ') || ' · ' || value ELSE s.label || ' — located in → ' || o.label END AS description FROM claim JOIN names s ON s.entity_id = subject_entity_id LEFT JOIN names o ON o.entity_id = object_entity_id")
def claim_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = D.claims(spark, sf_dir)
    return G.described(c, G.labels(_entities(spark, sf_dir), c)).select("claim_id", "description")


@query(
    f"""WITH {D.CLAIM_SQL}, c AS (SELECT claim.*, coalesce(o1.confidence, NULL) AS confidence FROM claim LEFT JOIN observation o1 ON o1.observation_id = supports[1] WHERE state = 'active')
SELECT subject_entity_id, predicate, value, object_entity_id, arg_min(claim_id, {{'none': confidence IS NULL, 'less': -confidence, 'id': claim_id}}) AS primary_claim_id, max(confidence) AS confidence, count(*) AS n_claims FROM c GROUP BY ALL"""
)
def claim_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.claim_groups(G.claim_confidence(D.claims(spark, sf_dir), D.observations(spark, sf_dir)))


@query(f"WITH {D.CLAIM_SQL} SELECT claim_id, format('{{:08x}}-0000-4000-8000-{{:012x}}', c_custkey % 100, c_custkey % 100) AS original_id FROM claim")
def provenance_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.provenance(D.claims(spark, sf_dir), D.observations(spark, sf_dir), D.evidence(spark, sf_dir))


@query(f"WITH {D.CLAIM_SQL} SELECT observation_id, confidence FROM observation WHERE observation_id NOT IN (SELECT unnest(supports) FROM claim WHERE state = 'active')")
def unresolved_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.unresolved(D.observations(spark, sf_dir), D.claims(spark, sf_dir)).select("observation_id", "confidence")


@query("SELECT event_type AS predicate, json_extract_string(props, '$.k') AS value, count(*) AS n, max(value) AS confidence, arg_min(CAST(user_id AS VARCHAR), event_id) AS excerpt FROM events GROUP BY 1, 2")
def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = D.table(spark, sf_dir, "events")
    rows = e.select(F.col("event_type").alias("predicate"), F.get_json_object("props", "$.k").alias("value"), F.col("value").alias("confidence"), F.col("user_id").cast("string").alias("excerpt"), F.col("event_id").alias("observation_id"))
    return G.findings(rows)


@query(
    f"""WITH n AS (SELECT 'SILVER' AS tier, 'c' || c_custkey AS id, c_name AS title FROM customer UNION ALL SELECT 'BRONZE', 'p' || p_partkey, p_name FROM part),
t AS (SELECT *, trim(regexp_replace(lower(strip_accents(title)), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) AS term, 'customer 00000001' AS q FROM n),
r AS (SELECT tier, id, title, least(500, greatest(0, length(term) - length(q))) AS pen, term, q FROM t),
s AS (SELECT tier, id, title, CASE WHEN term = '' THEN NULL WHEN term = q THEN 10000 WHEN starts_with(term, q) THEN 9000 - pen
  WHEN len(list_filter(string_split(term, ' '), lambda x: starts_with(x, 'customer'))) > 0 AND len(list_filter(string_split(term, ' '), lambda x: starts_with(x, '00000001'))) > 0 THEN 7500 - pen
  WHEN contains(term, q) THEN 7000 - least(500, instr(term, q) - 1) - pen END AS relevance FROM r)
SELECT tier, id, title, CAST(relevance AS INTEGER) AS relevance, CAST(row_number() OVER (ORDER BY relevance DESC, CASE tier WHEN 'SILVER' THEN 1 ELSE 0 END DESC, length(title), lower(title), id) AS INTEGER) AS rank
FROM s WHERE relevance IS NOT NULL ORDER BY rank LIMIT 8"""
)
def omni_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = D.table(spark, sf_dir, "customer").select(F.lit("SILVER").alias("tier"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"), F.col("c_name").alias("title"))
    p = D.table(spark, sf_dir, "part").select(F.lit("BRONZE").alias("tier"), F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_name").alias("title"))
    return G.omni_search(c.unionByName(p).withColumn("search_terms", F.array("title")), OMNI_QUERY)


# Jobs and synchronisation ---------------------------------------------------------------------------------------------


@query(
    f"""WITH {D.BRONZE_SQL}, l AS (SELECT id, CASE WHEN doc_id % 4 = 1 THEN 2 ELSE 1 END AS r FROM bronze WHERE doc_id % 5 <> 0),
r AS (SELECT id, CASE WHEN doc_id % 4 = 2 THEN 2 ELSE 1 END AS r FROM bronze WHERE doc_id % 7 <> 0)
SELECT id, CASE WHEN r.r IS NULL THEN 'upload' WHEN l.r IS NULL THEN 'download' WHEN l.r = r.r THEN 'none' WHEN l.r > r.r THEN 'upload' ELSE 'download' END AS direction FROM l FULL JOIN r USING (id)"""
)
def sync_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = D.bronze(spark, sf_dir)
    side = lambda missing, ahead: b.where(F.col("doc_id") % missing != 0).withColumn("revision", F.when(F.col("doc_id") % 4 == ahead, 2).otherwise(1))
    return S.sync_plan(side(5, 1), side(7, 2))


@query(f"WITH {D.JOB_SQL} SELECT key, state, queued_at, coalesce(completed_at, 0) AS completed_at FROM shown UNION ALL SELECT 's' || key, state, queued_at, coalesce(completed_at, 0) FROM shown")
def job_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = D.jobs(spark, sf_dir)
    merged = S.merged_jobs(j, j.withColumn("key", F.concat(F.lit("s"), "key")))
    return merged.withColumn("completed_at", F.coalesce("completed_at", F.lit(0)))


@query(f"WITH {D.JOB_SQL} SELECT state, count(*) AS n FROM shown GROUP BY state")
def job_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.job_status(D.jobs(spark, sf_dir))


@query(f"WITH {D.JOB_SQL} SELECT key, completed_at, CAST(row_number() OVER (ORDER BY completed_at DESC, key DESC) AS INTEGER) AS rank FROM shown WHERE state = 'completed' ORDER BY rank LIMIT 5")
def job_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.latest_completed(D.jobs(spark, sf_dir)).select("key", "completed_at", "rank")


@query("SELECT coalesce(CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderkey AS VARCHAR) END, CAST(o_orderkey AS VARCHAR)) AS key, CASE WHEN o_orderkey % 3 = 0 THEN 'queued' ELSE 'completed' END AS state FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 = 0")
def sync_job_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = D.table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("key"), F.col("o_orderkey").alias("n"), F.lit("t").alias("title"), F.lit(1).cast("bigint").alias("queued_at"))
    return S.upsert_jobs(o.where("n % 2 = 0"), o.where("n % 3 = 0"), F.lit(2).cast("bigint")).select("key", "state")


RECONCILE_SQL = f"""WITH {D.BRONZE_SQL}, m AS (SELECT *  REPLACE (doc_id % 9 = 0 AS deleted) FROM bronze),
p AS (SELECT id, hash, CASE WHEN doc_id % 4 = 0 THEN 'old' ELSE title END AS title, mime FROM bronze WHERE doc_id % 3 > 0), j AS (SELECT id FROM bronze WHERE doc_id % 6 = 0)"""


def _published(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    b = D.bronze(spark, sf_dir)
    return b.withColumn("deleted", F.col("doc_id") % 9 == 0), b.where("doc_id % 3 > 0").withColumn("title", F.when(F.col("doc_id") % 4 == 0, "old").otherwise(F.col("title")))


@query(
    f"""{RECONCILE_SQL} SELECT m.id, CASE WHEN deleted AND p.id IS NOT NULL THEN 'delete' WHEN deleted THEN 'keep' WHEN p.title = m.title THEN 'keep'
WHEN j.id IS NOT NULL THEN 'wait' ELSE 'process' END AS action FROM m LEFT JOIN p USING (id) LEFT JOIN j USING (id)"""
)
def reconcile_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, p = _published(spark, sf_dir)
    return S.reconcile(m, p, m.where("doc_id % 6 = 0"))


@query(f"{RECONCILE_SQL} SELECT p.id, (m.deleted OR m.title <> p.title) AS stale FROM p JOIN m USING (id)")
def stale_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.stale_sources(*_published(spark, sf_dir))


@query("SELECT CAST(l_linenumber + 7 * (l_orderkey % 2) AS INTEGER) AS retries, CAST(least(1000 * pow(2, least(l_linenumber + 7 * (l_orderkey % 2) - 1, 8)), 300000) AS BIGINT) AS delay, count(*) AS n FROM lineitem GROUP BY 1, 2")
def retry_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    retries = (F.col("l_linenumber") + 7 * (F.col("l_orderkey") % 2)).cast("int")
    rows = D.table(spark, sf_dir, "lineitem").select(retries.alias("retries"))
    return rows.select("retries", S.retry_delay(F.col("retries")).alias("delay")).groupBy("retries", "delay").agg(F.count("*").alias("n"))


@query(r"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda x: x <> '') AS w FROM documents)
SELECT doc_id, array_to_string(w[1:8], ' ') || CASE WHEN len(w) > 8 THEN '…' ELSE '' END AS title FROM w""")
def display_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.table(spark, sf_dir, "documents").select("doc_id", T.excerpt_words(F.col("text"), 8).alias("title"))


@query(r"WITH c AS (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS t FROM documents) SELECT doc_id, CASE WHEN length(t) > 160 THEN rtrim(left(t, 160)) || '…' ELSE t END AS excerpt FROM c")
def excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.table(spark, sf_dir, "documents").select("doc_id", T.compact(F.coalesce("text", F.lit(""))).alias("excerpt"))


@query(f"WITH {D.ENTITY_SQL} SELECT DISTINCT entity_id FROM entity")
def snapshot_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.entities(spark, sf_dir).select("entity_id").dropDuplicates(["entity_id"])
