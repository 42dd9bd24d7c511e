"""Queries on texts made for people and on small rules, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions import text as T
from ..operators import archive as A
from ..operators import knowledge as K
from . import tables as D
from .registry import query


@query(
    """SELECT event_id, CASE WHEN k <> 3 THEN 'Reading' || CASE WHEN total > 0 THEN ' · ' || done || '/' || total ELSE '' END
  WHEN event_id % 2 = 0 THEN 'Processing failed; retry scheduled · ' || err ELSE 'Processing stopped · ' || err END AS text
FROM (SELECT event_id, event_id % 4 AS k, event_id % 5 AS total, event_id % 3 AS done, CASE WHEN event_id % 8 = 3 THEN 'Unknown processing error' ELSE event_type END AS err FROM events)"""
)
def processing_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = D.table(spark, sf_dir, "events")
    n = F.col("event_id")
    error = F.when(n % 8 == 3, "  ").otherwise(F.concat(F.lit(" "), F.col("event_type")))
    return e.select("event_id", L.processing_text(F.when(n % 4 == 3, "failed").otherwise("running"), n % 3, n % 5, n % 2 == 0, error, "Reading").alias("text"))


@query(
    """WITH s AS (SELECT event_id, ['ready', 'skipped'][event_id % 2 + 1] AS det, ['ready', 'partial', 'skipped', 'unavailable', 'processing'][event_id % 5 + 1] AS know,
  [['unsupported_content', 'This content type is not supported for knowledge extraction.'], ['source_too_large', 'This source is too large for the current extractor.'], ['semantic model is not configured', 'The semantic model was unavailable.'],
   ['fragment_exceeds_model_limit', 'Some content exceeds the semantic model''s current input limit.'], ['x', 'Some semantic work was not completed.']][event_id % 7 % 5 + 1] AS r FROM events)
SELECT event_id, CASE WHEN det = 'ready' AND know = 'ready' THEN NULL WHEN know = 'partial' THEN 'Semantic processing is partial. ' || r[2]
  WHEN know = 'skipped' AND det = 'skipped' THEN 'Deterministic extraction and semantic processing were skipped. ' || r[2] WHEN know = 'skipped' THEN 'Semantic processing was skipped. ' || r[2]
  WHEN know = 'unavailable' THEN r[2] WHEN det = 'skipped' THEN 'Deterministic extraction was skipped. ' || r[2] END AS text FROM s"""
)
def status_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    pick = lambda m, *x: F.element_at(F.array(*map(F.lit, x)), (m + 1).cast("int"))
    reason = pick(n % 7 % 5, "unsupported_content", "source_too_large", "semantic model is not configured", "fragment_exceeds_model_limit", "x")
    text = L.status_text(pick(n % 2, "ready", "skipped"), pick(n % 5, "ready", "partial", "skipped", "unavailable", "processing"), F.when(n % 3 == 0, reason).otherwise(""), reason)
    return D.table(spark, sf_dir, "events").select("event_id", text.alias("text"))


@query(
    """WITH m AS (SELECT o_orderkey, greatest(o_orderkey * 37 - 500, 0) // 1 AS t FROM orders)
SELECT o_orderkey, CASE WHEN t < 1 THEN 'less than a minute' WHEN t < 60 THEN t || CASE WHEN t = 1 THEN ' minute' ELSE ' minutes' END
  WHEN t // 60 < 24 THEN t // 60 || CASE WHEN t // 60 = 1 THEN ' hour' ELSE ' hours' END || CASE WHEN t % 60 > 0 THEN ' ' || t % 60 || ' min' ELSE '' END
  ELSE t // 1440 || CASE WHEN t // 1440 = 1 THEN ' day' ELSE ' days' END || CASE WHEN t // 60 % 24 > 0 THEN ' ' || t // 60 % 24 || ' h' ELSE '' END END AS text FROM m"""
)
def duration_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = D.table(spark, sf_dir, "orders")
    return o.select("o_orderkey", L.duration_text((F.col("o_orderkey") * 37 - 500) * 60_000 + 59_999).alias("text"))


@query("SELECT doc_id, ['IMG', 'NOTE', 'CSV', 'CSV', 'TXT', 'PDF', 'FILE'][doc_id % 7 + 1] AS badge FROM documents")
def kind_badges(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda *x: F.element_at(F.array(*map(F.lit, x)), (F.col("doc_id") % 7 + 1).cast("int"))
    mime = pick("image/png", "text/plain", "application/csv", "text/plain", "text/x", "application/pdf", "model/x")
    return D.table(spark, sf_dir, "documents").select("doc_id", L.kind_badge(mime, pick("a", "note-1", "b", "C.CSV", "note-2", "d", "e")).alias("badge"))


@query(
    r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), l AS (SELECT doc_id, t, list_filter(string_split(replace(replace(left(t, 4096), chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)), lambda x: regexp_matches(x, '[^\s]')) AS lines,
  list_filter(regexp_split_to_array(left(t, 240), '\s+'), lambda x: x <> '') AS w FROM d)
SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'file' WHEN len(lines) = 0 THEN 'file' ELSE left(regexp_replace(lines[1], '^\s+|\s+$', '', 'g'), 120) END AS list_title,
 CASE WHEN doc_id % 3 = 0 OR len(w) = 0 THEN 'file' ELSE array_to_string(w[1:10], ' ') || CASE WHEN len(w) > 10 THEN '…' ELSE '' END END AS search_title FROM l"""
)
def note_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles of notes by their text, in lists and in search; other files keep their own."""
    text = F.when(F.col("doc_id") % 3 > 0, F.coalesce("text", F.lit("")))
    return D.table(spark, sf_dir, "documents").select("doc_id", L.list_title(F.lit("file"), text).alias("list_title"), L.search_title(F.lit("file"), text).alias("search_title"))


@query(
    """WITH v AS (SELECT o_orderkey, CAST(o_orderkey * o_orderkey * (o_custkey + 1) AS DOUBLE) AS b FROM orders), u AS (SELECT *, CASE WHEN b < 1024 THEN 0 WHEN b < 1048576 THEN 1 WHEN b < 1073741824 THEN 2 WHEN b < 1099511627776 THEN 3 ELSE 4 END AS u FROM v)
SELECT o_orderkey, CASE WHEN u = 0 THEN CAST(b AS BIGINT) || ' B' WHEN b / pow(1024, u) >= 10 THEN format('{:.0f}', floor(b / pow(1024, u) + 0.5)) || ['', ' KB', ' MB', ' GB', ' TB'][u + 1] ELSE format('{:.1f}', floor(b / pow(1024, u) * 10 + 0.5) / 10) || ['', ' KB', ' MB', ' GB', ' TB'][u + 1] END AS text
FROM u"""
)
def file_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes as text; halves are rounded up, and dividing by a power of two keeps them exact. Products past 64 bits are decimal
    numbers, those past 38 digits doubles."""
    key, more = F.col("o_orderkey").cast("decimal(20,0)"), F.col("o_custkey").cast("decimal(20,0)") + 1
    exact = F.try_multiply(F.try_multiply(key, key), more)
    size = F.coalesce(exact.cast("double"), key.cast("double") * key.cast("double") * more.cast("double"))
    return D.table(spark, sf_dir, "orders").select("o_orderkey", T.file_size(size).alias("text"))


@query("SELECT doc_id, CASE WHEN length(coalesce(text, '')) > 500 THEN left(text, 500) || chr(10) || '…' ELSE coalesce(text, '') END AS preview, length(coalesce(text, '')) <= 128 AS fits FROM documents")
def text_previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.coalesce("text", F.lit(""))
    return D.table(spark, sf_dir, "documents").select("doc_id", T.text_preview(t, 500).alias("preview"), T.fits(t).alias("fits"))


@query("SELECT doc_id, [' text ', '12', 'true', NULL, NULL, NULL][doc_id % 6 + 1].trim() AS value FROM documents")
def human_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.graph import human_value

    made = F.element_at(F.array(*map(F.lit, ('"  text "', "12", "true", '"  "', "null", '{"a":1}'))), (F.col("doc_id") % 6 + 1).cast("int"))
    return D.table(spark, sf_dir, "documents").select("doc_id", human_value(made).alias("value"))


@query(
    rf"""WITH w AS (SELECT doc_id, list_filter(regexp_extract_all(lower(coalesce(text, '')), '\p{{L}}{{5,}}'), lambda x: NOT list_contains([{", ".join(f"'{w}'" for w in L.COMMON)}], x)) AS w FROM documents)
SELECT CAST(doc_id AS VARCHAR) AS original_id, w[1] AS word FROM w WHERE len(w) > 0 ORDER BY lpad(CAST(doc_id AS VARCHAR), 12, '0') LIMIT 1"""
)
def private_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A word that only this archive's texts would be asked for."""
    d = D.table(spark, sf_dir, "documents").select(F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("order"), F.col("doc_id").cast("string").alias("original_id"), "text")
    return L.private_word(d).select("original_id", "word")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN '{"row":' || o_orderkey || ',"columns":{"a":"1"}}' ELSE '{"row":' || o_orderkey || ',"values":["1"]}' END AS payload FROM orders""")
def compact_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row payloads as a model gets them: the values go where named columns tell the same."""
    o = D.table(spark, sf_dir, "orders")
    n = F.col("o_orderkey").cast("string")
    made = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit('{"columns":{"a":"1"},"row":'), n, F.lit(',"values":["1"]}'))).otherwise(F.concat(F.lit('{"row":'), n, F.lit(',"values":["1"]}')))
    return o.select("o_orderkey", K.compact_payload(F.lit("parsed-table-row"), made).alias("payload"))


@query(
    """WITH p AS (SELECT l_orderkey AS batch, list(CAST(l_partkey AS VARCHAR) ORDER BY l_partkey) AS e, list(CAST(l_partkey AS VARCHAR) ORDER BY l_partkey) FILTER (l_linenumber <> 2) AS r FROM lineitem GROUP BY 1)
SELECT batch, len(list_filter(list_distinct(e), lambda x: NOT list_contains(coalesce(r, []), x))) AS n_missing, len(list_distinct(e)) = len(e) AND len(list_filter(list_distinct(e), lambda x: NOT list_contains(coalesce(r, []), x))) = 0 AND len(coalesce(r, [])) = len(e) AS valid FROM p"""
)
def answer_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether answers name each fragment asked for exactly once; one in some lists is lost."""
    li = D.table(spark, sf_dir, "lineitem")
    key = F.col("l_partkey").cast("string")
    p = li.groupBy(F.col("l_orderkey").alias("batch")).agg(F.collect_list(key).alias("e"), F.collect_list(F.when(F.col("l_linenumber") != 2, key)).alias("r"))
    return p.select("batch", F.size(F.array_except("e", "r")).cast("bigint").alias("n_missing"), K.valid_mapping(F.col("e"), F.col("r")).alias("valid"))


@query("SELECT l_orderkey AS batch, 'expected 2 ids, got ' || count(*) AS error, sha256(string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_linenumber, l_partkey)) AS answer_hash, left(string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_linenumber, l_partkey), 160) || CASE WHEN length(string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_linenumber, l_partkey)) > 160 THEN '…' ELSE '' END AS returned FROM lineitem GROUP BY 1")
def answer_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is logged of an answer that does not keep the contract: ids cut short, never the answer itself."""
    li = D.table(spark, sf_dir, "lineitem")
    lists = li.groupBy(F.col("l_orderkey").alias("batch")).agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: x["l_partkey"].cast("string")).alias("r"))
    return K.diagnostics(lists, F.array(F.lit("a"), F.lit("b")), F.col("r"), F.array_join("r", ",")).select("batch", "error", "answer_hash", "returned")


@query("SELECT event_id, NOT (event_id % 3 = event_id % 2 AND (event_id % 5 = 0) = (event_id % 4 = 0)) AS changed FROM events")
def presentation_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    error = lambda m: F.when(n % m == 0, "e")
    return D.table(spark, sf_dir, "events").select("event_id", A.presentation_changed((n % 3).cast("string"), error(5), (n % 2).cast("string"), error(4)).alias("changed"))
