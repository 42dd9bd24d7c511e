"""Queries on what a client shows of the claim graph and of its desktop, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bronze as B
from ..operators import desktop as K
from ..operators import graph as G
from ..operators import publication as P
from . import tables as D
from .registry import query

NAMES_SQL = f"{D.CLAIM_SQL}, names AS (SELECT e.entity_id, coalesce(arg_min(value, claim_id), 'Unnamed entity') AS label FROM (SELECT DISTINCT entity_id FROM entity) e LEFT JOIN claim c ON c.subject_entity_id = e.entity_id AND predicate = 'name' AND state = 'active' GROUP BY e.entity_id)"
ATTACHED_SQL = """told AS (SELECT claim.*, s.label AS s_label, o.label AS o_label FROM claim JOIN names s ON s.entity_id = subject_entity_id LEFT JOIN names o ON o.entity_id = object_entity_id),
attached AS (SELECT subject_entity_id AS entity_id, * FROM told WHERE state = 'active' UNION ALL SELECT object_entity_id, * FROM told WHERE state = 'active' AND object_entity_id IS NOT NULL AND object_entity_id <> subject_entity_id)"""


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.entities(spark, sf_dir).select("entity_id").distinct()


@query(f"WITH {NAMES_SQL}, {ATTACHED_SQL}, n AS (SELECT entity_id, label, count(claim_id) AS n_claims FROM names LEFT JOIN attached USING (entity_id) GROUP BY ALL) SELECT *, CAST(row_number() OVER (ORDER BY n_claims DESC, lower(label), entity_id) AS INTEGER) AS rank FROM n ORDER BY rank LIMIT 50")
def entity_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.entity_page(entities(spark, sf_dir), D.claims(spark, sf_dir))


@query(
    f"""WITH {NAMES_SQL}, {ATTACHED_SQL}, g AS (
  SELECT a.entity_id, a.subject_entity_id, predicate, CASE WHEN object_entity_id IS NULL THEN value ELSE s_label || ' → ' || o_label END AS value, object_entity_id, max(o1.confidence) AS confidence, count(*) AS n_claims,
         arg_min(claim_id, {{'none': o1.confidence IS NULL, 'less': -o1.confidence, 'id': claim_id}}) AS primary_claim_id
  FROM attached a LEFT JOIN observation o1 ON o1.observation_id = supports[1] GROUP BY ALL)
SELECT entity_id, predicate, value, confidence, n_claims, primary_claim_id, CASE WHEN entity_id = subject_entity_id THEN object_entity_id ELSE subject_entity_id END AS linked_entity_id,
       CAST(row_number() OVER (PARTITION BY entity_id ORDER BY confidence DESC NULLS LAST, predicate, value, primary_claim_id) AS INTEGER) AS rank FROM g"""
)
def claim_group_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The groups of claims that each entity shows, in their order, with the entity at the other end."""
    return G.groups_of_entities(D.claims(spark, sf_dir), D.observations(spark, sf_dir), entities(spark, sf_dir))


@query(
    f"""WITH {NAMES_SQL}, {ATTACHED_SQL}, t AS (SELECT entity_id, claim_id, CASE WHEN object_entity_id IS NULL THEN replace(predicate, '_', ' ') || ' ' || value ELSE s_label || ' ' || replace(predicate, '_', ' ') || ' ' || o_label END AS term FROM attached),
d AS (SELECT entity_id, term, min(claim_id) AS first FROM t GROUP BY ALL), l AS (SELECT entity_id, list(term ORDER BY first, term) AS terms FROM d GROUP BY entity_id)
SELECT entity_id, label AS title, array_to_string(list_filter(list_concat([label], coalesce(terms, [])), lambda x, i: i = 1 OR x <> label), '|') AS search_terms FROM names LEFT JOIN l USING (entity_id)"""
)
def entity_search_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.search_terms(entities(spark, sf_dir), D.claims(spark, sf_dir)).withColumn("search_terms", F.array_join("search_terms", "|"))


_GROUP_SQL = f"""WITH {NAMES_SQL}, {ATTACHED_SQL}, g AS (
  SELECT a.entity_id, a.subject_entity_id, predicate, CASE WHEN object_entity_id IS NULL THEN value ELSE s_label || ' → ' || o_label END AS value, object_entity_id, max(o1.confidence) AS confidence, count(*) AS n_claims,
         arg_min(claim_id, {{'none': o1.confidence IS NULL, 'less': -o1.confidence, 'id': claim_id}}) AS primary_claim_id
  FROM attached a LEFT JOIN observation o1 ON o1.observation_id = supports[1] GROUP BY ALL)
SELECT * FROM (SELECT entity_id, predicate, value, confidence, primary_claim_id, CAST(row_number() OVER (PARTITION BY entity_id ORDER BY confidence DESC NULLS LAST, predicate, value, primary_claim_id) AS INTEGER) AS rank FROM g) WHERE rank <= 5"""


@query(_GROUP_SQL)
def claim_group_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five groups of each entity; a nation's are as many as its customers."""
    told = G.groups_of_entities(D.claims(spark, sf_dir), D.observations(spark, sf_dir), entities(spark, sf_dir), 5)
    return told.select("entity_id", "predicate", "value", "confidence", "primary_claim_id", "rank")


_TERM_SQL = f"""WITH {NAMES_SQL}, {ATTACHED_SQL}, t AS (SELECT entity_id, claim_id, CASE WHEN object_entity_id IS NULL THEN replace(predicate, '_', ' ') || ' ' || value ELSE s_label || ' ' || replace(predicate, '_', ' ') || ' ' || o_label END AS term FROM attached),
d AS (SELECT entity_id, term, min(claim_id) AS first FROM t GROUP BY ALL),
terms AS (SELECT entity_id, label AS title, 0 AS pos, label AS term FROM names UNION ALL
  SELECT entity_id, label, CAST(row_number() OVER (PARTITION BY entity_id ORDER BY first, term) AS INTEGER), term FROM d JOIN names USING (entity_id) WHERE term <> label)"""


@query(f"{_TERM_SQL} SELECT * FROM terms")
def entity_term_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The terms that an entity is found by, one row each in their order."""
    return G.search_term_rows(entities(spark, sf_dir), D.claims(spark, sf_dir))


@query(
    f"""WITH {NAMES_SQL}, {ATTACHED_SQL}, r AS (SELECT claim_id, CASE WHEN object_entity_id IS NULL THEN replace(predicate, '_', ' ') || ' · ' || value ELSE s_label || ' — located in → ' || o_label END AS description, s_label, object_entity_id FROM told),
p AS (SELECT claim_id, description, CASE WHEN object_entity_id IS NULL THEN s_label || ' — ' || description ELSE description END AS "row" FROM r)
SELECT *, CAST(row_number() OVER (ORDER BY description, claim_id) AS INTEGER) AS rank FROM p ORDER BY rank LIMIT 50"""
)
def claim_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first claims of a list by their description."""
    c = D.claims(spark, sf_dir)
    rows = G.claim_rows(c, G.labels(entities(spark, sf_dir), c)).select("claim_id", "description", "row")
    return G.first_page(rows, [F.col("description"), F.col("claim_id")], 50)


@query(
    f"""WITH {D.CLAIM_SQL}, a AS (SELECT subject_entity_id AS entity_id, c_custkey FROM claim WHERE state = 'active' UNION SELECT object_entity_id, c_custkey FROM claim WHERE object_entity_id IS NOT NULL AND state = 'active')
SELECT DISTINCT entity_id, format('{{:08x}}-0000-4000-8000-{{:012x}}', c_custkey % 100, c_custkey % 100) AS original_id, CASE WHEN c_custkey % 100 % 2 = 0 THEN 'silver ' || c_custkey % 100 WHEN c_custkey % 100 % 3 = 0 THEN 'doc-' || c_custkey % 100 || '.txt' END AS title FROM a"""
)
def supporting_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Originals behind each entity; a third of them are known to neither side."""
    numbers = D.table(spark, sf_dir, "customer").select((F.col("c_custkey") % 100).alias("n")).distinct()
    sources = numbers.where("n % 2 = 0").select(D.item_id(F.col("n")).alias("id"), F.concat(F.lit("silver "), F.col("n").cast("string")).alias("title"))
    items = numbers.where("n % 3 = 0").select(D.item_id(F.col("n")).alias("id"), F.concat(F.lit("doc-"), F.col("n").cast("string"), F.lit(".txt")).alias("title"))
    return G.supporting_titles(D.claims(spark, sf_dir), D.observations(spark, sf_dir), D.evidence(spark, sf_dir), sources, items)


@query(
    f"""WITH {D.CLAIM_SQL}, s AS (SELECT format('{{:08x}}-0000-4000-8000-{{:012x}}', c_custkey % 100, c_custkey % 100) AS original_id, claim_id, predicate, c_custkey FROM claim)
SELECT DISTINCT original_id, claim_id AS id, predicate FROM s WHERE c_custkey % 4 > 0"""
)
def source_knowledge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The claims of each source by the ids that the source lists. Every customer's claims rest on one of a hundred sources,
    so the lists grow with the table: they come in rows of one id."""
    listed = G.provenance(D.claims(spark, sf_dir), D.observations(spark, sf_dir), D.evidence(spark, sf_dir))
    listed = listed.where(F.split("claim_id", "-")[1].cast("bigint") % 4 > 0)
    source = listed.select(F.col("original_id").alias("id"), F.array("claim_id").alias("claim_ids"))
    return P.of_source(source, D.claims(spark, sf_dir).select(F.col("claim_id").alias("id"), "predicate"), "claim_ids")


# Findings -------------------------------------------------------------------------------------------------------------


def candidate_observations(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Observations, evidence and claims on suppliers: names, nations, balances and where they are based.

    Every seventh supplier's ref is named again; some payloads lack a value or point at a ref that nobody named; of every
    third supplier the first candidate is behind an active claim.
    """
    s = D.table(spark, sf_dir, "supplier").join(D.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name"), "s_nationkey")
    k, balance = F.col("s_suppkey"), F.col("s_acctbal").cast("bigint")
    entity = lambda ref, label, kind: F.to_json(F.struct(F.lit(ref).alias("ref"), label.alias("label"), F.lit(kind).alias("type")))
    attribute = lambda v: F.to_json(F.struct(F.lit("a").alias("subject_ref"), F.lit("account_balance").alias("predicate"), v.alias("value")))
    relation = lambda ref: F.to_json(F.struct(F.lit("a").alias("subject_ref"), F.lit("based-in").alias("predicate"), F.lit(ref).alias("object_ref")))
    row = lambda n, kind, payload: F.struct(F.lit(n).alias("n"), F.lit(f"{kind}-candidate").alias("kind"), payload.alias("payload"))
    made = F.array(
        row(0, "entity", entity("a", F.col("s_name"), "trade_partner")), row(1, "entity", entity("b", F.col("n_name"), "")), row(2, "attribute", attribute(balance)), row(3, "relationship", relation("b")),
        row(4, "relationship", relation("z")), row(5, "attribute", attribute(F.lit("  "))), row(6, "entity", F.when(k % 7 == 0, entity("a", F.concat(F.lit("again "), "s_name"), ""))),
    )
    rows = s.select("s_suppkey", F.explode(made).alias("r")).where("r.payload is not null")
    confidence = F.when(k % 4 > 0, F.round(0.5 + (k % 50) / 100.0, 2))
    observations = rows.select(F.format_string("o%08d-%d", "s_suppkey", "r.n").alias("observation_id"), "r.kind", "r.payload", F.array(F.format_string("e%d", "s_suppkey")).alias("evidence_ids"), confidence.alias("confidence"))
    quote = F.when(k % 2 == 0, F.concat(F.lit("  quoted  "), F.col("s_name"))).otherwise(F.lit(" "))
    evidence = s.select(F.format_string("e%d", "s_suppkey").alias("evidence_id"), quote.alias("excerpt"))
    claims = s.where("s_suppkey % 3 = 0").select(F.array(F.format_string("o%08d-0", "s_suppkey")).alias("supporting_observation_ids"), F.lit("active").alias("state"))
    return observations, evidence, claims


@query(
    """WITH s AS (SELECT s_suppkey AS k, s_name, n_name, CAST(trunc(s_acctbal) AS BIGINT) AS bal, CASE WHEN s_suppkey % 7 = 0 THEN 'again ' || s_name ELSE s_name END AS a FROM supplier JOIN nation ON n_nationkey = s_nationkey),
o AS (SELECT k, 0 AS n, 'Possible trade partner' AS predicate, s_name AS value FROM s WHERE k % 3 > 0 UNION ALL SELECT k, 1, 'Possible entity', n_name FROM s
  UNION ALL SELECT k, 2, 'account balance', a || ' → ' || bal FROM s UNION ALL SELECT k, 3, 'based in', a || ' → ' || n_name FROM s UNION ALL SELECT k, 6, 'Possible entity', a FROM s WHERE k % 7 = 0),
f AS (SELECT predicate, value, CASE WHEN k % 4 > 0 THEN round(0.5 + (k % 50) / 100.0, 2) END AS confidence, CASE WHEN k % 2 = 0 THEN 'quoted ' || s.s_name END AS excerpt, format('{:08d}-{}', k, n) AS id FROM o JOIN s USING (k)),
g AS (SELECT predicate, value, count(*) AS n, max(confidence) AS confidence, arg_min(excerpt, id) FILTER (excerpt IS NOT NULL) AS excerpt FROM f GROUP BY ALL)
SELECT *, CAST(row_number() OVER (ORDER BY confidence DESC NULLS LAST, predicate, value) AS INTEGER) AS rank FROM g ORDER BY rank LIMIT 100"""
)
def finding_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first findings from candidates that nothing rests on."""
    return G.first_page(G.candidate_findings(*candidate_observations(spark, sf_dir)), G.by_confidence("predicate", "value"), 100)


# Originals and the desktop --------------------------------------------------------------------------------------------


@query(f"WITH {D.BRONZE_SQL} SELECT id, title, revision FROM bronze WHERE id = '00000007-0000-4000-8000-000000000007'")
def bronze_item(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.item(D.bronze(spark, sf_dir), "00000007-0000-4000-8000-000000000007").select("id", "title", "revision")


@query(f"WITH {D.BRONZE_SQL} SELECT id, modified, CAST(row_number() OVER (ORDER BY modified DESC, id) AS INTEGER) AS rank FROM (SELECT id, modified - doc_id % 3 AS modified FROM bronze) ORDER BY rank LIMIT 50")
def bronze_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The originals changed last."""
    b = D.bronze(spark, sf_dir).select("id", (F.col("modified") - F.col("doc_id") % 3).alias("modified"))
    return G.first_page(b, [F.desc("modified"), F.col("id")], 50)


def desktop(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Shortcuts, known objects and manifest of two desktops over the first of every seven documents."""
    b = D.bronze(spark, sf_dir).where("doc_id % 7 = 0").withColumn("deleted", F.col("doc_id") % 21 == 0)
    both = b.withColumn("desktop", F.explode(F.array(F.lit("home"), F.lit("work"))))
    known = both.where("doc_id % 2 = 0").select("desktop", F.lit(K.ORIGINAL).alias("object_type"), F.col("id").alias("object_id"))
    items = both.where("doc_id % 4 = 0").select("desktop", F.lit(K.ORIGINAL).alias("object_type"), F.col("id").alias("object_id"), (100_000_000 - F.col("doc_id")).cast("int").alias("position"))
    people = D.table(spark, sf_dir, "nation").select(F.lit("home").alias("desktop"), F.lit(K.ENTITY).alias("object_type"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("object_id"), F.col("n_nationkey").cast("int").alias("position"))
    return items.unionByName(people), known, b


DESKTOP_SQL = f"""{D.BRONZE_SQL}, b AS (SELECT * REPLACE (doc_id % 21 = 0 AS deleted) FROM bronze WHERE doc_id % 7 = 0),
item AS (SELECT d.desktop, 'bronze' AS object_type, id AS object_id, 100000000 - doc_id AS position FROM b, (VALUES ('home'), ('work')) d(desktop) WHERE doc_id % 4 = 0
  UNION ALL SELECT 'home', 'silver-entity', 'n' || n_nationkey, n_nationkey FROM nation),
fresh AS (SELECT d.desktop, 'bronze' AS object_type, id AS object_id, 1 << 30 AS position FROM b, (VALUES ('home'), ('work')) d(desktop) WHERE doc_id % 2 = 1 AND NOT deleted),
kept AS (SELECT * FROM item WHERE object_type <> 'bronze' OR object_id IN (SELECT id FROM b WHERE NOT deleted))"""
_PLACED = "CAST(row_number() OVER (PARTITION BY desktop ORDER BY position, object_type, object_id) - 1 AS INTEGER) AS position"


@query(f"WITH {DESKTOP_SQL} SELECT desktop, object_type, object_id, {_PLACED} FROM (SELECT * FROM kept UNION ALL SELECT * FROM fresh)")
def desktop_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.with_originals(*desktop(spark, sf_dir))


@query(f"WITH {DESKTOP_SQL} SELECT DISTINCT desktop, 'bronze' AS object_type, id AS object_id FROM b, (VALUES ('home'), ('work')) d(desktop)")
def desktop_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.known_after(*desktop(spark, sf_dir))


@query(f"WITH {DESKTOP_SQL} SELECT desktop, object_type, object_id, {_PLACED} FROM (SELECT * FROM item WHERE NOT (object_type = 'silver-entity' AND object_id IN ('n3', 'n7')) UNION ALL SELECT 'work', 'silver-entity', 'n9', 1 << 30)")
def desktop_pins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pin that is there already and one that is new; an entity that is gone and a shortcut that is taken off."""
    items, _, _ = desktop(spark, sf_dir)
    one = lambda d, o: spark.range(1).select(F.lit(d).alias("desktop"), F.lit(K.ENTITY).alias("object_type"), F.lit(o).alias("object_id"))
    there = D.table(spark, sf_dir, "nation").where("n_nationkey <> 7").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("entity_id"))
    return K.unpinned(K.without_lost_entities(K.pinned(items, one("home", "n5").unionByName(one("work", "n9"))), there), one("home", "n3"))


@query(
    f"""WITH {DESKTOP_SQL}, p AS (SELECT desktop, object_type, object_id, {_PLACED} FROM item)
SELECT desktop, object_type, object_id, CAST(CASE WHEN desktop <> 'home' THEN position WHEN object_id = 'n4' THEN 20 WHEN position BETWEEN 5 AND 20 THEN position - 1 ELSE position END AS INTEGER) AS position FROM p"""
)
def desktop_move(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, _, _ = desktop(spark, sf_dir)
    return K.moved(items, spark.range(1).select(F.lit("home").alias("desktop"), F.lit(K.ENTITY).alias("object_type"), F.lit("n4").alias("object_id"), F.lit(20).alias("to")))


@query(f"WITH {DESKTOP_SQL} SELECT desktop, object_type, object_id, coalesce(n_name, title) AS title FROM item LEFT JOIN nation ON object_type = 'silver-entity' AND object_id = 'n' || n_nationkey AND n_nationkey <> 7 LEFT JOIN b ON object_type = 'bronze' AND object_id = id AND NOT deleted")
def desktop_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the shortcuts stand for; deleted originals and a lost entity have no title."""
    items, _, b = desktop(spark, sf_dir)
    names = D.table(spark, sf_dir, "nation").where("n_nationkey <> 7").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("entity_id"), F.col("n_name").alias("label"))
    return K.resolved(items, b, names).select("desktop", "object_type", "object_id", "title")


@query(f"WITH {DESKTOP_SQL} SELECT desktop, object_type, object_id, {_PLACED} FROM item")
def desktop_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Desktop documents written as JSON and read back."""
    items, known, _ = desktop(spark, sf_dir)
    return K.from_documents(K.to_documents(items, known))
