"""The claim graph: labels, groups, provenance and what search and navigation show of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordering import ranked_within, top_within
from ..functions.text import compact, humanize, search_text, trimmed

UNNAMED, UNKNOWN = "Unnamed entity", "Unknown"
#: Relevance of each kind of match, and the tiers' preference.
EXACT, PREFIX, WORD, WORD_PREFIX, ALL_PREFIX, INSIDE, MOST_PENALTY = 10_000, 9_000, 8_500, 8_000, 7_500, 7_000, 500
TIERS = {"BRONZE": 0, "SILVER": 1, "GOLD": 2}


def dealt(rows: DataFrame) -> DataFrame:
    """``rows`` for a join that deals both sides out by its key. The planner goes by the bytes of files, which say nothing of
    the rows that are made of them, and would broadcast what grows with the archive."""
    return rows.hint("merge")


def object_key() -> Column:
    """The object of a claim as a key of a left join; attributes, which have none, are spread by their subjects."""
    return F.coalesce("object_entity_id", F.concat(F.lit("none of "), "subject_entity_id"))


def active(claims: DataFrame) -> DataFrame:
    return claims.where("state = 'active'")


def labels(entities: DataFrame, claims: DataFrame) -> DataFrame:
    """(entity_id, label): the value of the first active name claim."""
    names = active(claims).where("predicate = 'name' and value is not null").groupBy(F.col("subject_entity_id").alias("entity_id")).agg(F.min_by("value", "claim_id").alias("label"))
    return entities.select("entity_id").join(dealt(names), "entity_id", "left").withColumn("label", F.coalesce("label", F.lit(UNNAMED)))


def attached(claims: DataFrame) -> DataFrame:
    """(entity_id, claim columns): each claim at its subject, and at its object if that is another entity."""
    ends = F.array_distinct(F.array_compact(F.array("subject_entity_id", "object_entity_id")))
    return claims.select(F.explode(ends).alias("entity_id"), "*")


def claims_of(claims: DataFrame, entity_id: str) -> DataFrame:
    return claims.where((F.col("subject_entity_id") == entity_id) | (F.col("object_entity_id") == entity_id))


def claim_counts(entities: DataFrame, claims: DataFrame) -> DataFrame:
    """(entity_id, label, n_claims): numbers of active claims."""
    counts = attached(active(claims)).groupBy("entity_id").agg(F.count("*").alias("n_claims"))
    return labels(entities, claims).join(dealt(counts), "entity_id", "left").withColumn("n_claims", F.coalesce("n_claims", F.lit(0)))


def claim_confidence(claims: DataFrame, observations: DataFrame) -> DataFrame:
    """Claims with the confidence of their first supporting observation that exists."""
    supports = claims.select("claim_id", F.posexplode("supporting_observation_ids").alias("pos", "observation_id"))
    first = supports.join(dealt(observations.select("observation_id", "confidence")), "observation_id").groupBy("claim_id").agg(F.min_by("confidence", "pos").alias("confidence"))
    return claims.join(dealt(first), "claim_id", "left")


def claim_groups(claims: DataFrame) -> DataFrame:
    """Active claims of equal meaning as one, led by the most confident."""
    best = F.struct(F.col("confidence").isNull().alias("none"), (-F.col("confidence")).alias("less"), F.col("claim_id").alias("id"))
    keys = ["subject_entity_id", "predicate", "value", "object_entity_id"]
    groups = active(claims).groupBy(*keys).agg(F.min(best).alias("b"), F.count("*").alias("n_claims"), F.max("confidence").alias("confidence"))
    return groups.select(*keys, F.col("b.id").alias("primary_claim_id"), "confidence", "n_claims")


def provenance(claims: DataFrame, observations: DataFrame, evidence: DataFrame) -> DataFrame:
    """(claim_id, original_id): the originals behind each claim."""
    supports = claims.select("claim_id", F.explode("supporting_observation_ids").alias("observation_id"))
    found = observations.select("observation_id", F.explode("evidence_ids").alias("evidence_id"))
    return supports.join(dealt(found), "observation_id").join(dealt(evidence.select("evidence_id", "original_id")), "evidence_id").select("claim_id", "original_id").distinct()


def unresolved(observations: DataFrame, claims: DataFrame) -> DataFrame:
    """Observations that no active claim rests on."""
    used = active(claims).select(F.explode("supporting_observation_ids").alias("observation_id"))
    return observations.join(dealt(used), "observation_id", "left_anti")


def findings(open_observations: DataFrame) -> DataFrame:
    """(predicate, value, n, confidence, excerpt): open observations of equal meaning."""
    return open_observations.groupBy("predicate", "value").agg(F.count("*").alias("n"), F.max("confidence").alias("confidence"), F.min_by("excerpt", F.when(F.col("excerpt").isNotNull(), F.col("observation_id"))).alias("excerpt"))


def with_labels(claims: DataFrame, names: DataFrame) -> DataFrame:
    """Claims with the labels of both ends, ``_subject`` and ``_object``."""
    subject = names.select(F.col("entity_id").alias("subject_entity_id"), F.col("label").alias("_subject"))
    target = names.select(F.col("entity_id").alias("_key"), F.col("label").alias("_object"))
    return claims.join(dealt(subject), "subject_entity_id", "left").withColumn("_key", object_key()).join(dealt(target), "_key", "left").drop("_key")


def described(claims: DataFrame, names: DataFrame) -> DataFrame:
    """Claims with their text: ``subject — predicate → object`` for relations, ``predicate · value`` for attributes."""
    both = with_labels(claims, names)
    said = humanize(F.col("predicate"))
    text = F.when(F.col("object_entity_id").isNotNull(), F.concat(F.coalesce("_subject", F.lit(UNKNOWN)), F.lit(" — "), said, F.lit(" → "), F.coalesce("_object", F.lit(UNKNOWN)))).otherwise(F.concat(said, F.lit(" · "), F.coalesce("value", F.lit(UNKNOWN))))
    return both.withColumn("description", text).drop("_subject", "_object")


def relevance(query: str, term: Column) -> Column:
    """How well a normalised term answers a normalised query; null if it does not."""
    words, q = query.split(" "), F.lit(query)
    penalty = F.least(F.lit(MOST_PENALTY), F.greatest(F.lit(0), F.length(term) - len(query)))
    parts = F.split(term, " ")
    begins = lambda w: F.exists(parts, lambda p: p.startswith(w))
    every = F.lit(len(words) > 1)
    for w in words:
        every = every & begins(w)
    at = F.instr(term, query) - 1
    return (
        F.when(term == "", F.lit(None).cast("int"))
        .when(term == q, EXACT)
        .when(term.startswith(q), PREFIX - penalty)
        .when(F.exists(parts, lambda p: p == q), WORD - penalty)
        .when(begins(q), WORD_PREFIX - penalty)
        .when(every, ALL_PREFIX - penalty)
        .when(at >= 0, INSIDE - F.least(F.lit(MOST_PENALTY), at) - penalty)
    )


def omni_search(candidates: DataFrame, query: str, limit: int = 8) -> DataFrame:
    """(tier, id, title, relevance, rank) of the best candidates (tier, id, title, search_terms)."""
    wanted = candidates.sparkSession.range(1).select(search_text(F.lit(query)).alias("q")).first()["q"]
    if not wanted or limit <= 0:
        return candidates.select("tier", "id", "title", F.lit(0).alias("relevance"), F.lit(0).alias("rank")).limit(0)
    scored = F.array_max(F.transform("search_terms", lambda t, i: relevance(wanted, search_text(t)) - i * 10))
    return _best(candidates.select("tier", "id", "title", scored.alias("relevance")).where("relevance is not null"), limit)


def _best(scored: DataFrame, limit: int) -> DataFrame:
    tier = F.coalesce(*[F.when(F.col("tier") == name, rank) for name, rank in TIERS.items()], F.lit(-1))
    order = [F.desc("relevance"), F.desc("_tier"), F.length("title"), F.lower("title"), F.col("id")]
    hits = scored.withColumn("_tier", tier).orderBy(*order).limit(limit)
    return hits.withColumn("rank", F.row_number().over(Window.orderBy(*order))).drop("_tier")


def claim_rows(claims: DataFrame, names: DataFrame) -> DataFrame:
    """Claims as rows of a list: their description, an attribute's after its subject's label if that is known."""
    told = described(claims, names).join(dealt(names.select(F.col("entity_id").alias("subject_entity_id"), F.col("label").alias("_label"))), "subject_entity_id", "left")
    own = F.col("object_entity_id").isNull() & F.col("_label").isNotNull()
    return told.withColumn("row", F.when(own, F.concat("_label", F.lit(" — "), "description")).otherwise(F.col("description"))).drop("_label")


def first_page(rows: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows in an order, with their rank."""
    return rows.orderBy(*order).limit(n).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def by_confidence(*then: str) -> list[Column]:
    """The order of groups and findings: those with a confidence first, the surest first."""
    return [F.desc_nulls_last("confidence"), *map(F.col, then)]


def entity_page(entities: DataFrame, claims: DataFrame, n: int = 50) -> DataFrame:
    """Entities with most active claims first, then by label and id."""
    return first_page(claim_counts(entities, claims), [F.desc("n_claims"), F.lower("label"), F.col("entity_id")], n)


def groups_of_entities(claims: DataFrame, observations: DataFrame, entities: DataFrame, most: int | None = None) -> DataFrame:
    """(entity_id, predicate, value, confidence, n_claims, primary_claim_id, linked_entity_id, rank) for every entity; the first
    ``most`` groups of each, if a number is given.

    ``value`` is what the group says of the entity, ``linked_entity_id`` the other end of a relation if it is known. An entity
    that half of all claims are about is ranked in many tasks.
    """
    names = labels(entities, claims)
    groups = claim_groups(claim_confidence(claims, observations))
    told = with_labels(groups, names)
    relation = F.concat(F.coalesce("_subject", F.lit(UNKNOWN)), F.lit(" → "), F.coalesce("_object", F.lit(UNKNOWN)))
    told = told.withColumn("value", F.when(F.col("object_entity_id").isNotNull(), relation).otherwise(F.coalesce("value", F.lit(UNKNOWN))))
    seen = attached(told).withColumn("_other", F.when(F.col("entity_id") == F.col("subject_entity_id"), F.col("object_entity_id")).otherwise(F.col("subject_entity_id")))
    known = entities.select(F.col("entity_id").alias("_other"), F.col("entity_id").alias("linked_entity_id")).distinct()
    seen = seen.withColumn("_other", F.coalesce("_other", F.concat(F.lit("none of "), "entity_id")))
    rows = seen.join(dealt(known), "_other", "left").select("entity_id", "predicate", "value", "confidence", "n_claims", "primary_claim_id", "linked_entity_id")
    order = by_confidence("predicate", "value", "primary_claim_id")
    return ranked_within(rows, "entity_id", order, "rank") if most is None else top_within(rows, "entity_id", order, most, "rank")


def search_terms(entities: DataFrame, claims: DataFrame) -> DataFrame:
    """(entity_id, title, search_terms): an entity's label, then what its active claims say, each text once.

    A hub's terms are as many as its different claims' texts; equal texts are summed to one before they are gathered.
    """
    terms, names = _terms(entities, claims)
    lists = terms.groupBy("entity_id").agg(F.array_sort(F.collect_list(F.struct("first", "term"))).alias("t"))
    rest = F.coalesce(F.transform("t", lambda x: x["term"]), F.array().cast("array<string>"))
    return names.join(dealt(lists), "entity_id", "left").select("entity_id", F.col("label").alias("title"), F.array_distinct(F.concat(F.array("label"), rest)).alias("search_terms"))


def _terms(entities: DataFrame, claims: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entity_id, term, first) of what active claims say, each text once with its first claim, and the entities' labels."""
    names = labels(entities, claims)
    told = with_labels(active(claims), names)
    said, nothing = humanize(F.col("predicate")), F.lit("")
    relation = F.concat_ws(" ", F.coalesce("_subject", nothing), said, F.coalesce("_object", nothing))
    text = F.trim(F.when(F.col("object_entity_id").isNull(), F.concat_ws(" ", said, F.coalesce("value", nothing))).otherwise(relation))
    return attached(told.withColumn("term", text)).where("term <> ''").groupBy("entity_id", "term").agg(F.min("claim_id").alias("first")), names


def search_term_rows(entities: DataFrame, claims: DataFrame) -> DataFrame:
    """(entity_id, title, pos, term): the terms of ``search_terms``, one row each from 0, so that no task holds a hub's."""
    terms, names = _terms(entities, claims)
    label = names.select("entity_id", F.col("label").alias("title"))
    others = terms.join(dealt(label), "entity_id").where("term <> title")
    placed = ranked_within(others, "entity_id", [F.col("first"), F.col("term")], "pos").select("entity_id", "title", "pos", "term")
    return label.select("entity_id", "title", F.lit(0).alias("pos"), F.col("title").alias("term")).unionByName(placed)


def omni_search_rows(terms: DataFrame, query: str, limit: int = 8) -> DataFrame:
    """``omni_search`` over candidates whose terms are rows (tier, id, title, pos, term): the best of each is a maximum."""
    wanted = terms.sparkSession.range(1).select(search_text(F.lit(query)).alias("q")).first()["q"]
    if not wanted or limit <= 0:
        return terms.select("tier", "id", "title", F.lit(0).alias("relevance"), F.lit(0).alias("rank")).limit(0)
    scored = terms.withColumn("relevance", relevance(wanted, search_text(F.col("term"))) - F.col("pos") * 10).where("relevance is not null")
    return _best(scored.groupBy("tier", "id", "title").agg(F.max("relevance").alias("relevance")), limit)


def supporting_titles(claims: DataFrame, observations: DataFrame, evidence: DataFrame, sources: DataFrame, items: DataFrame) -> DataFrame:
    """(entity_id, original_id, title): originals behind an entity's active claims, titled by the published source, else the item."""
    behind = attached(active(claims)).select("entity_id", "claim_id").join(dealt(provenance(active(claims), observations, evidence)), "claim_id").select("entity_id", "original_id").distinct()
    named = behind.join(sources.select(F.col("id").alias("original_id"), F.col("title").alias("_published")), "original_id", "left")
    named = named.join(items.select(F.col("id").alias("original_id"), F.col("title").alias("_item")), "original_id", "left")
    return named.select("entity_id", "original_id", F.coalesce("_published", "_item").alias("title"))


def human_value(json_value: Column) -> Column:
    """A JSON scalar as text: a string trimmed, a number or truth value as written; null for anything else and for blanks."""
    kind = F.schema_of_variant(F.try_parse_json(json_value))
    text = trimmed(F.get_json_object(F.concat(F.lit('{"v":'), json_value, F.lit("}")), "$.v"))
    return F.when(kind == "STRING", F.when(text != "", text)).when(kind.isin("BOOLEAN", "BIGINT", "DOUBLE") | kind.startswith("DECIMAL"), trimmed(json_value))


def candidate_findings(observations: DataFrame, evidence: DataFrame, claims: DataFrame) -> DataFrame:
    """Findings from candidates that no active claim rests on.

    Observations are (observation_id, kind, payload, evidence_ids, confidence), evidence is (evidence_id, excerpt). A ref
    stands for the last label given to it in a piece of evidence, and only if an observation's evidence agrees on one.
    """
    at = lambda p: F.trim(F.coalesce(F.get_json_object("payload", p), F.lit("")))
    spread = observations.where("kind = 'entity-candidate'").select("observation_id", at("$.ref").alias("ref"), at("$.label").alias("label"), F.explode("evidence_ids").alias("evidence_id"))
    named = spread.where("ref <> '' and label <> ''").groupBy("evidence_id", "ref").agg(F.max_by("label", "observation_id").alias("label"))
    rest = unresolved(observations, claims).where("kind in ('entity-candidate', 'attribute-candidate', 'relationship-candidate')")
    uses = rest.select("observation_id", F.explode("evidence_ids").alias("evidence_id"), F.explode(F.array(F.struct(F.lit("subject").alias("end"), at("$.subject_ref").alias("ref")), F.struct(F.lit("object").alias("end"), at("$.object_ref").alias("ref")))).alias("u"))
    only = lambda end: F.when(F.size(F.collect_set(F.when(F.col("end") == end, F.col("label")))) == 1, F.max(F.when(F.col("end") == end, F.col("label")))).alias(f"_{end}")
    ends = uses.select("observation_id", "evidence_id", "u.*").join(named, ["evidence_id", "ref"]).groupBy("observation_id").agg(only("subject"), only("object"))
    told = rest.join(ends, "observation_id", "left")
    predicate, type_ = humanize(at("$.predicate")), at("$.type")
    value = human_value(F.to_json(F.variant_get(F.parse_json("payload"), "$.value", "variant")))
    shown = (
        F.when(F.col("kind") == "entity-candidate", F.when(at("$.label") != "", at("$.label")))
        .when(at("$.predicate") == "", F.lit(None).cast("string"))
        .when(F.col("kind") == "attribute-candidate", F.when(value.isNotNull(), F.concat_ws(" → ", "_subject", value)))
        .otherwise(F.concat(F.col("_subject"), F.lit(" → "), F.col("_object")))
    )
    said = F.when(F.col("kind") == "entity-candidate", F.concat(F.lit("Possible "), F.when(type_ != "", humanize(type_)).otherwise("entity"))).otherwise(predicate)
    rows = told.select("observation_id", "confidence", said.alias("predicate"), shown.alias("value"), F.posexplode("evidence_ids").alias("pos", "evidence_id")).where("value is not null")
    quoted = rows.join(evidence.select("evidence_id", trimmed(F.col("excerpt")).alias("quote")), "evidence_id", "left")
    first = quoted.groupBy("observation_id", "confidence", "predicate", "value").agg(F.min_by("quote", F.when(F.col("quote") != "", F.col("pos"))).alias("quote"))
    excerpt = compact(F.col("quote"), 160)
    return findings(first.withColumn("excerpt", F.when((F.col("quote") != "") & (excerpt != F.col("value")), excerpt)))
