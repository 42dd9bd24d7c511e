"""Knowledge: validation of model candidates, batching of fragments, recovery from bad answers, entities and claims."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import canonical_json, normalize_label, stable_id, trimmed, truncate

#: Bounds of the contract and the confidence from which candidates count.
REF, PREDICATE = r"^[A-Za-z0-9_-]{1,64}$", r"^[a-z][a-z0-9_-]{0,63}$"
MOST_FRAGMENTS, MOST_CANDIDATES, ATTEMPTS, LABEL_CHARS, CONFIDENT = 512, 128, 3, 200, 0.70
RESOLVER, MOST_INPUTS = "label-type-v1", 128


def valid_confidence(c: Column) -> Column:
    return F.coalesce(c.between(0.0, 1.0) & ~F.isnan(c), F.lit(False))


def valid_entity(ref: Column, label: Column, kind: Column, confidence: Column) -> Column:
    ok = ref.rlike(REF) & (trimmed(label) != "") & (F.length(label) <= LABEL_CHARS) & ((F.coalesce(kind, F.lit("")) == "") | kind.rlike(PREDICATE))
    return F.coalesce(ok, F.lit(False)) & valid_confidence(confidence)


def valid_entities(candidates: DataFrame) -> DataFrame:
    """Of (batch, fragment_id, pos, ref, label, type, confidence): valid rows, the first of each ref."""
    good = candidates.where(valid_entity(F.col("ref"), F.col("label"), F.col("type"), F.col("confidence")))
    first = Window.partitionBy("batch", "fragment_id", "ref").orderBy("pos")
    return good.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def valid_attributes(candidates: DataFrame, entities: DataFrame) -> DataFrame:
    ok = F.col("predicate").rlike(PREDICATE) & valid_confidence(F.col("confidence")) & F.col("value").isNotNull() & (F.col("value") != "null") & ~F.substring("value", 1, 1).isin("{", "[")
    refs = entities.select("batch", "fragment_id", F.col("ref").alias("subject_ref"))
    return candidates.where(ok).join(refs, ["batch", "fragment_id", "subject_ref"], "left_semi")


def valid_relationships(candidates: DataFrame, entities: DataFrame) -> DataFrame:
    ok = F.col("predicate").rlike(PREDICATE) & valid_confidence(F.col("confidence")) & (F.col("subject_ref") != F.col("object_ref"))
    refs = entities.select("batch", "fragment_id", "ref")
    for end in ("subject_ref", "object_ref"):
        candidates = candidates.join(refs.withColumnRenamed("ref", end), ["batch", "fragment_id", end], "left_semi")
    return candidates.where(ok)


def entity_id(label: Column, kind: Column) -> Column:
    """One id for equal normalised labels of one type."""
    return stable_id("entity", F.to_json(F.struct(normalize_label(label).alias("label"), F.coalesce(kind, F.lit("")).alias("type"), F.lit(RESOLVER).alias("resolver"))))


def resolve_entities(candidates: DataFrame, least: float = CONFIDENT) -> DataFrame:
    """Candidates from ``least`` confidence on with their ``entity_id``."""
    return candidates.where(F.col("confidence") >= least).withColumn("entity_id", entity_id(F.col("label"), F.col("type")))


def claim_id(subject: Column, predicate: Column, value: Column, target: Column, supports: Column) -> Column:
    return stable_id("claim", F.to_json(F.struct(subject.alias("subject"), predicate.alias("predicate"), value.alias("value"), target.alias("object"), F.array_sort(supports).alias("supports"))))


def resolve_relationships(relations: DataFrame, entities: DataFrame, keys: list[str], least: float = CONFIDENT) -> DataFrame:
    """Relationship candidates with both ends resolved to entities, self-edges dropped."""
    ends = entities.select(*keys, "ref", "entity_id")
    subject = ends.withColumnsRenamed({"ref": "subject_ref", "entity_id": "subject_entity_id"})
    target = ends.withColumnsRenamed({"ref": "object_ref", "entity_id": "object_entity_id"})
    return relations.where(F.col("confidence") >= least).join(subject, [*keys, "subject_ref"]).join(target, [*keys, "object_ref"]).where("subject_entity_id <> object_entity_id")


def coverage(batches: DataFrame) -> DataFrame:
    """(original_id, n_semantic, n_completed, state, reason): ready when all is done, skipped when nothing is, else partial."""
    per = batches.groupBy("original_id").agg(F.sum("n_semantic").alias("n_semantic"), F.sum("n_completed").alias("n_completed"), F.array_join(F.array_sort(F.collect_set("skip_reason")), ",").alias("reason"))
    state = F.when(F.col("n_completed") >= F.col("n_semantic"), "ready").when(F.col("n_completed") == 0, "skipped").otherwise("partial")
    return per.withColumn("state", state)


#: Bytes of the contexts' member, ``,"contexts":[]``, of an encoded input that has any.
CONTEXTS = 14


def batches_of(sizes: list[int], contexts: list[tuple[str, int] | None], structural: list[bool], target: int, base: int = 0) -> list[int]:
    """Batch number of each fragment: a batch, of ``base`` bytes when empty, is cut before the fragment that would pass
    ``target`` bytes. Entries of a list have commas between them, a context counts once a batch; structural fragments count
    nothing and never cut."""
    out, batch, used, seen, begun, entries = [], 0, base, set(), False, 0

    def grown(size: int, context: tuple[str, int] | None) -> int:
        own = size + (1 if entries else 0)
        if context and context[0] not in seen:
            own += context[1] + (1 if seen else CONTEXTS)
        return own

    for size, context, alone in zip(sizes, contexts, structural, strict=True):
        if begun and not alone and used + grown(size, context) > target:
            batch, used, seen, entries = batch + 1, base, set(), 0
        if not alone:
            used += grown(size, context)
            entries += 1
            if context:
                seen.add(context[0])
        begun = True
        out.append(batch)
    return out


def encoded_bytes(text: Column) -> Column:
    """Bytes of JSON text once ``<``, ``>``, ``&`` and the two line separators are written as escapes."""
    times = lambda marks: F.length(text) - F.length(F.translate(text, marks, ""))
    return F.octet_length(text) + 5 * times("<>&") + 3 * times("\u2028\u2029")


def model_input(fragments: DataFrame) -> DataFrame:
    """``fragments`` with the parts of the JSON that a model gets of a batch: ``_head`` without any entry, ``_entry``, and
    ``_about`` of its context, whose id is ``_context``."""
    evidence = stable_id("evidence", F.to_json(F.struct(F.col("original_id").cast("string").alias("source"), F.col("selector"))))
    context_id = F.when(F.col("context").isNotNull(), stable_id("context", F.col("context")))
    parent = F.coalesce(F.concat(F.lit(',"parent_context_id":"'), context_id, F.lit('"')), F.lit(""))
    kind = F.to_json(F.struct("kind"))
    entry = F.concat(F.lit('{"fragment_id":"'), evidence, F.lit('",'), F.substring(kind, F.lit(2), F.length(kind) - 2), F.lit(',"selector":'), "selector", parent, F.lit(',"payload":'), compact_payload(F.col("kind"), F.col("payload")), F.lit("}"))
    about = F.concat(F.lit('{"context_id":"'), context_id, F.lit('",'), F.substring("context", 2, 1 << 30))
    named = F.to_json(F.struct(F.coalesce("title", F.lit("")).alias("title"), F.coalesce("mime", F.lit("")).alias("mime")))
    head = F.concat(F.substring(named, F.lit(1), F.length(named) - 1), F.lit(',"fragments":[]}'))
    return fragments.select("*", head.alias("_head"), entry.alias("_entry"), context_id.alias("_context"), about.alias("_about"))


def batched(fragments: DataFrame, target: int = 4096, most_bytes: int | None = None) -> DataFrame:
    """``fragments`` (original_id, ordinal, title, mime, kind, selector, payload, text, context, structural_only) with
    ``batch``: ordered greedy batches per source, by the bytes of the encoded input that a model would get of each.

    Sizes are made by expressions; only they meet in one task, and a source has at most 8 MiB.
    """
    target = min(target, most_bytes or target)
    silent = F.col("structural_only") | (trimmed(F.coalesce("text", F.lit(""))) == "")
    sized = model_input(fragments).select(
        "original_id", "ordinal", encoded_bytes(F.col("_entry")).alias("_size"), "_context", encoded_bytes(F.col("_about")).alias("_about"), encoded_bytes(F.col("_head")).alias("_head"), silent.alias("_silent")
    )

    def of(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("ordinal", kind="stable")
        contexts = [None if c is None else (c, int(n)) for c, n in zip(group["_context"], group["_about"], strict=True)]
        return group[["original_id", "ordinal"]].assign(batch=batches_of(group["_size"].tolist(), contexts, group["_silent"].tolist(), target, int(group["_head"].iloc[0])))

    kinds = {c: fragments.schema[c].dataType.simpleString() for c in ("original_id", "ordinal")}
    dealt = sized.groupBy("original_id").applyInPandas(of, f"original_id {kinds['original_id']}, ordinal {kinds['ordinal']}, batch int")
    return fragments.join(dealt, ["original_id", "ordinal"])


ANSWER = (
    "struct<entities:array<struct<ref:string,label:string,type:string,confidence:double>>,"
    "attributes:array<struct<subject_ref:string,predicate:string,value:variant,confidence:double>>,"
    "relationships:array<struct<subject_ref:string,predicate:string,object_ref:string,confidence:double>>>"
)


def semantic(fragments: DataFrame) -> DataFrame:
    """Fragments that a model is asked about: not structural alone, and with a text."""
    return fragments.where(~F.col("structural_only") & (trimmed(F.coalesce("text", F.lit(""))) != ""))


def candidate_observations(answers: DataFrame, evidence: DataFrame, producer: str) -> DataFrame:
    """(observation_id, kind, payload, evidence_id, confidence, producer) of model answers (evidence_id, answer).

    A null answer is a fragment that was skipped. An answer on evidence that is not there fails the query.
    """
    told = answers.where("answer is not null").join(evidence.select("evidence_id", F.lit(True).alias("_there")), "evidence_id", "left")
    told = told.where(F.assert_true(F.col("_there").isNotNull(), F.lit("an answer refers to missing evidence")).isNull())
    a = F.from_json("answer", ANSWER)
    row = lambda kind, payload, x: F.struct(F.lit(f"{kind}-candidate").alias("kind"), F.to_json(payload).alias("payload"), x["confidence"].alias("confidence"))
    entity = lambda x: row("entity", F.struct(trimmed(x["label"]).alias("label"), x["ref"].alias("ref"), trimmed(F.coalesce(x["type"], F.lit(""))).alias("type")), x)
    attribute = lambda x: row("attribute", F.struct(x["predicate"].alias("predicate"), x["subject_ref"].alias("subject_ref"), x["value"].alias("value")), x)
    relation = lambda x: row("relationship", F.struct(x["object_ref"].alias("object_ref"), x["predicate"].alias("predicate"), x["subject_ref"].alias("subject_ref")), x)
    rows = told.select("evidence_id", a.alias("a")).select("evidence_id", F.explode(F.concat(*[F.coalesce(F.transform(f"a.{k}", f), F.array()) for k, f in (("entities", entity), ("attributes", attribute), ("relationships", relation))])).alias("r"))
    identity = F.to_json(F.struct(F.col("r.kind").alias("kind"), F.array("evidence_id").alias("evidence"), F.col("r.payload").alias("payload"), F.col("r.confidence").alias("confidence"), F.lit(producer).alias("producer")))
    return rows.select(stable_id("observation", identity).alias("observation_id"), "r.kind", "r.payload", "evidence_id", "r.confidence", F.lit(producer).alias("producer"))


def compact_payload(kind: Column, payload: Column) -> Column:
    """A payload as a model gets it: a table row with named columns goes without its bare values."""
    columns = F.get_json_object(payload, "$.columns")
    short = F.concat(F.lit('{"row":'), F.get_json_object(payload, "$.row"), F.lit(',"columns":'), columns, F.lit("}"))
    return F.when((kind == "parsed-table-row") & columns.isNotNull(), short).otherwise(payload)


def valid_mapping(expected: Column, returned: Column) -> Column:
    """Every id asked for exactly once, and no other."""
    return (F.size(returned) == F.size(expected)) & (F.size(F.array_distinct(returned)) == F.size(returned)) & (F.size(F.array_except(expected, returned)) == 0)


def diagnostics(rows: DataFrame, expected: Column, returned: Column, answer: Column, most: int = 160) -> DataFrame:
    """``rows`` with what may be logged of a bad answer: numbers of ids, the ids cut short, and the answer's hash."""
    error = F.concat(F.lit("expected "), F.size(expected).cast("string"), F.lit(" ids, got "), F.size(returned).cast("string"))
    short = lambda ids: truncate(F.array_join(ids, ","), most)
    return rows.withColumns({"error": error, "expected": short(expected), "returned": short(returned), "answer_hash": F.sha2(answer, 256)})


class ContractError(Exception):
    """An answer that does not keep the contract."""


class Extractor(Protocol):
    """A model: fragments (id, text) to one answer per fragment id, or a ``ContractError``."""

    def extract(self, fragments: list[tuple[str, str]]) -> dict[str, dict]: ...


def candidates_in(answer: dict[str, dict]) -> int:
    return sum(len(a.get(k, ())) for a in answer.values() for k in ("entities", "attributes", "relationships"))


class Budget:
    """Fragments and candidates that all answers of one batch may have together."""

    def __init__(self, fragments: int = MOST_FRAGMENTS, candidates: int = MOST_CANDIDATES):
        self.fragments, self.candidates = fragments, candidates

    def reserve(self, answer: dict[str, dict]) -> None:
        if len(answer) > self.fragments:
            raise ContractError(f"{len(answer)} fragments; {self.fragments} remain")
        if (n := candidates_in(answer)) > self.candidates:
            raise ContractError(f"{n} candidates; {self.candidates} remain")
        self.fragments -= len(answer)
        self.candidates -= n


def check_answer(asked: list[tuple[str, str]], answer: dict[str, dict]) -> dict[str, dict]:
    if len(asked) > MOST_FRAGMENTS or set(answer) != {i for i, _ in asked}:
        raise ContractError("fragment ids differ")
    if any(set(a) - {"entities", "attributes", "relationships"} or any(not isinstance(v, list) for v in a.values()) for a in answer.values()):
        raise ContractError("unknown fields")
    if candidates_in(answer) > MOST_CANDIDATES:
        raise ContractError("too many candidates")
    return answer


def recovered(
    fragments: list[tuple[str, str]], extract: Callable[[list[tuple[str, str]]], dict[str, dict]], attempts: int = ATTEMPTS, budget: Budget | None = None
) -> dict[str, dict | None]:
    """Answers by fragment: after ``attempts`` refusals a list is halved, and a single fragment is skipped (None). What a
    half uses of the batch's budget is gone for the other; an answer that needs more than is left ends the batch."""
    budget = budget or Budget()
    for _ in range(attempts):
        try:
            answer = dict(check_answer(fragments, extract(fragments)))
        except ContractError:
            continue
        budget.reserve(answer)
        return answer
    if len(fragments) == 1:
        return {fragments[0][0]: None}
    half = len(fragments) // 2
    return recovered(fragments[:half], extract, attempts, budget) | recovered(fragments[half:], extract, attempts, budget)


def extracted(fragments: DataFrame, extractor: Extractor) -> DataFrame:
    """(original_id, batch, fragment_id, answer): the model's answers as JSON, null where a fragment was skipped."""

    def of(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("ordinal", kind="stable")
        asked = [(str(i), t) for i, t in zip(group["ordinal"], group["text"], strict=True) if t.strip()]
        answers = recovered(asked, extractor.extract) if asked else {}
        rows = [(group["original_id"].iloc[0], group["batch"].iloc[0], k, None if a is None else canonical_json(a)) for k, a in answers.items()]
        return pd.DataFrame(rows, columns=["original_id", "batch", "fragment_id", "answer"])

    kind = fragments.schema["original_id"].dataType.simpleString()
    return fragments.where(~F.col("structural_only")).groupBy("original_id", "batch").applyInPandas(of, f"original_id {kind}, batch int, fragment_id string, answer string")


def embedded(chunks: DataFrame, embed: Callable[[pd.Series], list[list[float]]], dimensions: int) -> DataFrame:
    """(chunk_id, embedding) for chunks whose vector has the model's length and is finite and not zero."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = []
            for a in range(0, len(b), MOST_INPUTS):
                part = b["text"].iloc[a : a + MOST_INPUTS].reset_index(drop=True)
                vectors = list(embed(part))
                if len(vectors) != len(part):
                    raise ContractError("the embedder returned another number of vectors")
                found += vectors
            yield pd.DataFrame({"chunk_id": b["chunk_id"], "embedding": found})

    kind = chunks.schema["chunk_id"].dataType.simpleString()
    rows = chunks.select("chunk_id", "text").mapInPandas(of, f"chunk_id {kind}, embedding array<float>")
    good = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    return rows.where((F.size("embedding") == dimensions) & good)
