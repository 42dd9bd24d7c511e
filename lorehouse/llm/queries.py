"""The registered queries opN_<name> and, where SQL can say it, their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from . import embedding_dedup, jaccard_join, language_id, merkle, mixing, packing, periodic_runs, quality_classifier, quality_rules, secret_scan, token_counts, toxicity, url_filters
from .common import bucket_of, cut, scratch_path, table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.apply_rules(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP1_SQL = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), m AS (
  SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, n_symbols,
         len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
         len(list_filter(w, lambda x: list_contains([{", ".join(f"'{x}'" for x in dict.fromkeys(quality_rules.STOP_WORDS))}], lower(x)))) AS n_stop
  FROM d
), tri AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS n
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)
), rep AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM tri, (VALUES (0), (1), (2)) AS o(k) WHERE n > 1 GROUP BY doc_id
), j AS (
  SELECT m.*, coalesce(n_repeat_words, 0) AS n_repeat_words,
         n_words < 50 OR 100 * coalesce(n_repeat_words, 0) > 50 * n_words AS base_failed
  FROM m LEFT JOIN rep USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND {" AND ".join(
    f"{ {'mean_word_chars': 'word_chars / greatest(n_words, 1)', 'symbols_per_word': 'n_symbols / greatest(n_words, 1)', 'stop_word_share': 'n_stop / greatest(n_words, 1)', 'dup_line_share': 'n_dup_lines / greatest(n_lines, 1)'}[r.metric]} {op} {v}"
    for r in quality_rules.RULES for op, v in ((">=", r.low), ("<=", r.high)) if v is not None)} AS kept
FROM j
"""


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.decide(table(spark, sf_dir, "pages"), url_filters.rule_table(spark))


OP2_SQL = f"""
WITH r(verdict, rhost, rpath) AS (VALUES {", ".join(str(x) for x in url_filters.RULES)}),
p AS (
  SELECT page_id, CASE WHEN contains(coalesce(url, ''), '://') THEN substring(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), h AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM p
), b AS (
  SELECT page_id, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(verdict, length(rhost || rpath)) AS verdict
  FROM h JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM h LEFT JOIN b USING (page_id)
"""


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.train(language_id.training_rows(docs))
    judged = language_id.predict(docs.select("doc_id", "text"), model)
    return judged.select("doc_id", (bucket_of(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Membership by text alone: the source is the classifier's label."""
    return mixing.mix_sources(table(spark, sf_dir, "documents"), keep=("doc_id", "source")).select("doc_id", "source", "domain", "n_words", "rate", "copies", "domain_target", "domain_expected")


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def marks(spark: SparkSession, sf_dir: str, label: str, modulus: int, held_out: int) -> DataFrame:
    """The marks of all ids but the held-out ones."""
    return table(spark, sf_dir, "labels").where(bucket_of(F.col("doc_id"), modulus) != held_out).select("doc_id", label)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity.train(docs, marks(spark, sf_dir, "toxic", 5, 0)))
    return scored.select("doc_id", (bucket_of(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality_classifier.score(docs, quality_classifier.train(docs, marks(spark, sf_dir, "quality", 4, 2)))
    return scored.select("doc_id", (bucket_of(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= quality_classifier.CUT).cast("int").alias("predicted"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three batches over all documents: inserts with words as a first count, revisions to pieces, deletes of wordless ones."""
    docs = table(spark, sf_dir, "documents")
    # Texts are read once; the batches are made of their numbers.
    counted = cut(docs.select("source", "lang", token_counts.word_count(F.col("text")).alias("words"), token_counts.piece_count(F.col("text")).alias("pieces")))
    as_state = lambda name, n: token_counts.state(F.col("source"), F.col("lang"), name, n)
    nothing = F.lit(None).cast(token_counts.STATE)
    versions = F.explode(F.array(as_state("words/1", F.col("words")), as_state("pieces/1", F.col("words"))))
    inserted = counted.select(nothing.alias("before"), versions.alias("after"))
    revised = counted.select(as_state("pieces/1", F.col("words")).alias("before"), as_state("pieces/1", F.col("pieces")).alias("after"))
    gone = counted.where("words = 0").select(F.explode(F.array(as_state("words/1", F.col("words")), as_state("pieces/1", F.col("pieces")))).alias("before"), nothing.alias("after"))
    ledger = token_counts.Ledger(spark, scratch_path(spark, "token-counts"))
    return token_counts.apply_all(ledger, [("insert", inserted), ("revise", revised), ("revise", revised), ("delete", gone)])


OP9_SQL = rf"""
WITH d AS (
  SELECT source, lang, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words,
         len(regexp_extract_all(coalesce(text, ''), '{token_counts.PIECES}')) AS pieces
  FROM documents
), v AS (
  SELECT source, lang, 'words/1' AS tokenizer, words AS n FROM d WHERE words > 0
  UNION ALL SELECT source, lang, 'pieces/1', pieces FROM d WHERE words > 0
)
SELECT source, lang, tokenizer, count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_tokens FROM v GROUP BY ALL
"""

TOKENIZER = "byte_bpe_50k.json"


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digest(packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER)))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest by source, checked against documents of which some are tampered with."""
    fields = ("doc_id", "source", "lang", "n_chars", "text")
    told = merkle.manifest(table(spark, sf_dir, "documents"), fields, "source", "doc_id", {"text": merkle.lowered_sometimes(F.col("doc_id"), F.col("text"))})
    return merkle.verified(told).withColumnRenamed("key", "doc_id")


def _merkle_sql(levels: int = 8) -> str:
    """Levels that a tree doesn't have pass its root on, with null siblings; 16 ** 8 leaves are more than any table here has."""

    def nodes(name: str, below: str, tree: str) -> str:
        run = f"PARTITION BY {tree}, pos // 16 ORDER BY pos ROWS BETWEEN"
        return f"""{name}s AS (SELECT *, CASE WHEN n > 1 THEN coalesce(string_agg(h, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') END AS lft,
  CASE WHEN n > 1 THEN coalesce(string_agg(h, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') END AS rgt FROM {below}),
{name} AS (SELECT {tree}, pos // 16 AS pos, (n + 15) // 16 AS n, CASE WHEN max(n) > 1 THEN sha256(string_agg(h, '' ORDER BY pos)) ELSE max(h) END AS h FROM {below} GROUP BY {tree}, pos // 16, (n + 15) // 16)"""

    own, last = ["leaf", *[f"s{k}" for k in range(1, levels + 1)]], ["sub", *[f"r{k}" for k in range(1, levels + 1)]]
    parts = [nodes(own[k + 1], own[k], "src") for k in range(levels)] + [f"sub AS (SELECT 0 AS one, src, h, row_number() OVER (ORDER BY src NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM {own[-1]})"]
    parts += [nodes(last[k + 1], last[k], "one") for k in range(levels)]
    at = [f"s{k}s" for k in range(1, levels + 1)]
    joins = " ".join(f"JOIN {a} ON {a}.src IS NOT DISTINCT FROM l.src AND {a}.pos = l.pos // {16**k}" for k, a in enumerate(at))
    joins += " JOIN sub ON sub.src IS NOT DISTINCT FROM l.src " + " ".join(f"JOIN r{k}s ON r{k}s.pos = sub.pos // {16 ** (k - 1)}" for k in range(1, levels + 1))
    both = [*at, *[f"r{k}s" for k in range(1, levels + 1)]]
    fold = "l.chk"
    steps = []
    for k, a in enumerate(both):
        before = fold if k == 0 else f"f{k - 1}"
        steps.append(f"CASE WHEN {a}_l IS NULL THEN {before} ELSE sha256({a}_l || {before} || {a}_r) END AS f{k}")
    told = ", ".join(f"{a}.lft AS {a}_l, {a}.rgt AS {a}_r" for a in both)
    nested, columns = f"(SELECT l.doc_id, l.h, l.chk, sub.h AS subroot, r{levels}.h AS root, {told} FROM leaf l {joins} JOIN r{levels} ON true)", ""
    for k, step in enumerate(steps):
        nested = f"(SELECT *, {step.replace('l.chk', 'chk')} FROM {nested})"
    proof = " || ".join(f"coalesce({a}_l || {a}_r, '')" for a in both)
    value = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || {c}, '-')"
    fields = " || ".join(map(value, ("doc_id", "source", "lang", "n_chars")))
    table_ = "list_transform(range(0, 256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END))"
    crc = "xor(list_reduce(list_concat([4294967295], list_transform(range(1, length(k) + 1), lambda i: ascii(k[i]))), lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1])), 4294967295)"
    return f"""WITH tampered AS (SELECT *, CASE WHEN coalesce({crc} % 5 = 0, false) THEN translate(text, '{merkle.UPPER}', '{merkle.LOWER}') ELSE text END AS other
  FROM (SELECT *, CAST(doc_id AS VARCHAR) AS k, {table_} AS t FROM documents)),
leaf AS (SELECT doc_id, source AS src, h, chk, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, h) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n
  FROM (SELECT doc_id, source, sha256({fields} || {value("text")}) AS h, sha256({fields} || {value("other")}) AS chk FROM tampered)),
{", ".join(parts)}
SELECT doc_id, h AS leaf, subroot, root, sha256({proof}) AS proof_sha256, f{len(both) - 1} AS folded_root, f{len(both) - 1} = root AS verified FROM {nested}"""


OP11_SQL = _merkle_sql()


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents")).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.periodic_runs(table(spark, sf_dir, "documents")).drop("n_words")


OPERATORS = (
    op1_quality_rules, op2_url_filters, op3_ngram_jaccard, op4_language_id, op5_mixing,
    op6_embedding_dedup, op7_toxicity, op8_quality_classifier, op9_token_counts, op10_packing, op11_merkle_manifest, op12_secret_scan, op13_periodic_runs,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in OPERATORS}


def oracle_sql() -> dict[str, str]:
    return {"op1_quality_rules": OP1_SQL, "op2_url_filters": OP2_SQL, "op9_token_counts": OP9_SQL, "op11_merkle_manifest": OP11_SQL}
