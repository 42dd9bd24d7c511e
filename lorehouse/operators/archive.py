"""A client's side of the archive: notes, acknowledgements, tombstones, mirrored snapshots, and settings."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields
from urllib.parse import urlparse

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The snapshot's version, and the note's type.
SNAPSHOT_VERSION, NOTE_TYPE = 2, "text/plain"
REPRESENTATION = "struct<state:string,producer:struct<processor_id:string,processor_version:string,model_id:string,model_revision:string>,input_identity:string,error:string>"
SNAPSHOT = (
    f"schema_version int, revision bigint, sources array<struct<id:string,hash:string,title:string,mime:string,representations:struct<deterministic:{REPRESENTATION},knowledge:{REPRESENTATION}>,"
    "evidence_ids:array<string>,observation_ids:array<string>,entity_ids:array<string>,claim_ids:array<string>,stale:boolean>>, error string"
)


def note_title(item_id: Column) -> Column:
    return F.concat(F.lit("note-"), F.left(item_id, F.lit(12)), F.lit(".txt"))


def notes(texts: DataFrame, now: Column) -> DataFrame:
    """``texts`` (id, text) as new originals."""
    return texts.withColumns(
        {
            "revision": F.lit(1).cast("bigint"), "hash": F.sha2("text", 256), "deleted": F.lit(False), "title": note_title(F.col("id")), "mime": F.lit(NOTE_TYPE),
            "size": F.octet_length("text").cast("bigint"), "created": now, "modified": now, "acked_revision": F.lit(0).cast("bigint"),
        }
    )


def imported(files: DataFrame, now: Column) -> DataFrame:
    """Files (id, title, mime, content) as new originals; a blank name becomes ``File``, an unknown type the generic one."""
    title = F.when(F.trim(F.coalesce("title", F.lit(""))) == "", "File").otherwise(F.left("title", F.lit(512)))
    return files.withColumns(
        {
            "title": title, "mime": F.coalesce("mime", F.lit("application/octet-stream")), "revision": F.lit(1).cast("bigint"), "hash": F.sha2("content", 256), "deleted": F.lit(False),
            "size": F.octet_length("content").cast("bigint"), "created": now, "modified": now, "acked_revision": F.lit(0).cast("bigint"),
        }
    )


def deleted(items: DataFrame, ids: DataFrame, now: Column) -> DataFrame:
    """``items`` with the live ones of ``ids`` (id) as tombstones: next revision, no bytes, a later time."""
    rows = items.join(ids.select("id", F.lit(True).alias("_gone")).distinct(), "id", "left")
    hit = F.col("_gone").isNotNull() & ~F.col("deleted")
    change = {"revision": F.col("revision") + 1, "hash": F.lit(""), "size": F.lit(0).cast("bigint"), "deleted": F.lit(True), "modified": F.greatest(now, F.col("modified") + 1)}
    return rows.select(*[F.when(hit, change[c]).otherwise(F.col(c)).alias(c) if c in change else F.col(c) for c in items.columns])


def acknowledged(items: DataFrame, acks: DataFrame) -> DataFrame:
    """``items`` with ``acked_revision`` where an acknowledgement (id, revision, hash, deleted) names their very state."""
    told = acks.select("id", *[F.col(c).alias(f"_{c}") for c in ("revision", "hash", "deleted")]).distinct()
    same = (F.col("revision") == F.col("_revision")) & (F.col("hash") == F.col("_hash")) & (F.col("deleted") == F.col("_deleted"))
    rows = items.join(told, "id", "left").withColumn("acked_revision", F.when(F.coalesce(same, F.lit(False)), F.col("revision")).otherwise(F.col("acked_revision")))
    return rows.select(*items.columns)


def pending() -> Column:
    """Items that the other side has not acknowledged as they are."""
    return F.col("acked_revision") < F.col("revision")


def same_item(a: str, b: str) -> Column:
    """Two prefixes' items agree in everything but the acknowledgement."""
    same = F.lit(True)
    for c in ("id", "revision", "hash", "deleted", "title", "mime", "size", "created", "modified"):
        same = same & F.col(f"{a}{c}").eqNullSafe(F.col(f"{b}{c}"))
    return same


def needs_snapshot(revision: Column, told: Column) -> Column:
    """Whether a mirror at ``revision`` fetches again: the status tells another revision or none."""
    return told.isNull() | (revision != told)


def installs(new_revision: Column, new_jobs: Column, revision: Column, jobs: Column) -> Column:
    """Whether a mirror takes a snapshot: its revision, then that of its jobs, never goes back."""
    return (new_revision > revision) | ((new_revision == revision) & (new_jobs >= jobs))


def takes_status(revision: Column, told: Column, jobs: Column, told_jobs: Column, jobs_in_status: Column) -> Column:
    """Whether a status may be laid over a mirror: it is about the same data and jobs that are not older."""
    return (told == revision) & (told_jobs == jobs_in_status) & (jobs_in_status >= jobs)


def presentation_changed(a_state: Column, a_error: Column, b_state: Column, b_error: Column) -> Column:
    return ~(a_state.eqNullSafe(b_state) & a_error.eqNullSafe(b_error))


def snapshots(rows: DataFrame, json_col: str) -> DataFrame:
    """``rows`` with ``snapshot`` from its JSON; null, the empty snapshot, for broken text or another version."""
    read = F.from_json(F.col(json_col), SNAPSHOT)
    return rows.withColumn("snapshot", F.when(read["schema_version"] == SNAPSHOT_VERSION, read))


def snapshot_rows(text: DataFrame, column: str = "snapshot") -> DataFrame:
    """Sources of read snapshots, one row each, with the nested representations flattened to their states."""
    one = text.select(F.col(f"{column}.revision").alias("revision"), F.explode(f"{column}.sources").alias("s"))
    return one.select("revision", "s.id", "s.hash", "s.title", "s.mime", F.col("s.representations.deterministic.state").alias("det_state"), F.col("s.representations.knowledge.state").alias("know_state"), "s.observation_ids", "s.stale")


def remaining(items: DataFrame, submitted: DataFrame) -> DataFrame:
    """What is left of a draft (position, more) after some of its parts (position) went through."""
    return items.join(submitted.select("position").distinct(), "position", "left_anti")


def status_text(rows: DataFrame) -> DataFrame:
    """Each row as one JSON text, the form in which a status travels."""
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("json"))


def status_rows(texts: DataFrame, schema: str) -> DataFrame:
    return texts.select(F.from_json("json", schema).alias("s")).select("s.*")


@dataclass(frozen=True)
class Settings:
    """Bounds and addresses from the environment; every number is positive, every address stays on this machine."""

    batch_bytes: int = 4096
    context_tokens: int = 8192
    output_tokens: int = 2048
    model_url: str = ""
    embedding_url: str = ""

    @classmethod
    def read(cls, prefix: str, env: Mapping[str, str] | None = None) -> Settings:
        env, found = os.environ if env is None else env, {}
        for f in fields(cls):
            text = env.get(f"{prefix}_{f.name.upper()}", "").strip()
            if not text:
                continue
            if f.name.endswith("_url"):
                if urlparse(text).scheme not in ("http", "https") or urlparse(text).hostname not in ("127.0.0.1", "localhost", "::1"):
                    raise ValueError(f"{f.name} must be a local address")
                found[f.name] = text
            elif not text.isdigit() or int(text) <= 0:
                raise ValueError(f"{f.name} must be a positive number")
            else:
                found[f.name] = int(text)
        return cls(**found)


def model_input_bytes(context_tokens: int, output_tokens: int, prompt_bytes: int, reserve: int = 256, least: int = 1024) -> int:
    """Bytes that a model's input may have: a byte is at most one token."""
    left = context_tokens - output_tokens - prompt_bytes - reserve
    if left < least:
        raise ValueError("the model's context is too small")
    return left


def model_manifest(spark, path: str) -> DataFrame:
    """Models of a manifest file (JSON: models with repository, revision, file, bytes, sha256, parts), one row each.

    A row without an identity, size or hash, or whose parts do not add up to its bytes, fails the read.
    """
    part = "struct<file:string,bytes:bigint,sha256:string>"
    rows = spark.read.schema(f"models array<struct<repository:string,revision:string,file:string,bytes:bigint,sha256:string,parts:array<{part}>>>").json(path, multiLine=True).select(F.explode("models").alias("m")).select("m.*")
    total = F.aggregate(F.coalesce("parts", F.array().cast(f"array<{part}>")), F.lit(0).cast("bigint"), lambda a, p: a + p["bytes"])
    ok = (F.col("repository") != "") & (F.col("revision") != "") & (F.col("file") != "") & (F.col("bytes") > 0) & F.col("sha256").rlike("^[0-9a-f]{64}$") & (F.coalesce(F.size("parts"), F.lit(0)).isin(0, -1) | (total == F.col("bytes")))
    return rows.where(F.assert_true(F.coalesce(ok, F.lit(False)), F.lit("invalid model manifest")).isNull())


def metrics(spark, chunks: DataFrame, vectors: DataFrame, latency_ms: float) -> DataFrame:
    """One row for a deployment's record: counts of the index and a query's latency."""
    counts = chunks.agg(F.count("*").alias("n_chunks"), F.max(F.octet_length("text")).alias("largest_chunk"))
    one = F.lit(1).alias("_one")
    return counts.select("*", one).join(vectors.agg(F.count("*").alias("n_vectors")).select("*", one), "_one").drop("_one").withColumn("latency_ms", F.lit(float(latency_ms)))
