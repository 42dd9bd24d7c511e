"""The archive as a stream: new manifest files are parsed and published batch by batch, each batch at most once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.ingest import fragments, outcomes

ORIGINAL = "original_id string, title string, mime string, content binary"


def publish(spark: SparkSession, inbox: str, out: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Stream parquet originals from ``inbox`` to fragments and outcomes under ``out``, one folder of each a micro-batch.

    A batch that is replayed after a failure overwrites its own folders, so nothing is published twice. Outcomes are
    written last: a source counts from the batch that has its outcome on. Without ``every`` all waiting files are read and
    the query ends.
    """

    def sink(batch: DataFrame, number: int) -> None:
        fragments(batch).write.mode("overwrite").parquet(f"{out}/fragments/batch={number}")
        outcomes(batch).select("original_id", F.sha2("content", 256).alias("hash"), "title", "mime", "state", "reason").write.mode("overwrite").parquet(f"{out}/outcomes/batch={number}")

    writer = spark.readStream.schema(ORIGINAL).parquet(inbox).writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def latest(spark: SparkSession, out: str, manifest: DataFrame | None = None) -> DataFrame:
    """(original_id, hash, title, mime, state, reason, batch): the last outcome of each source. With a manifest (id, hash,
    title, mime, deleted) only of sources whose item is live and still the same."""
    told = spark.read.parquet(f"{out}/outcomes")
    last = told.groupBy("original_id").agg(F.max("batch").alias("batch"))
    told = told.join(last, ["original_id", "batch"], "left_semi")
    if manifest is None:
        return told
    live = manifest.where(~F.col("deleted")).select(F.col("id").alias("original_id"), "hash", "title", "mime")
    return told.join(live, ["original_id", "hash", "title", "mime"], "left_semi")


def published(spark: SparkSession, out: str, manifest: DataFrame | None = None) -> DataFrame:
    """The fragments of each source's last batch."""
    return spark.read.parquet(f"{out}/fragments").join(latest(spark, out, manifest), ["original_id", "batch"], "left_semi")


def contained(step: Callable[[], object]) -> str:
    """Run one reconciliation; what goes wrong is returned as text, so the next one still comes. Empty if all went well."""
    try:
        step()
    except Exception as wrong:  # noqa: BLE001  a step that fails must not end the loop
        return f"{type(wrong).__name__}: {wrong}"[:1000]
    return ""
