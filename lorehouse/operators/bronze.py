"""Bronze: immutable, content-addressed originals, their guarded commits and the blobs behind them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCHEMA = "id string, revision bigint, hash string, deleted boolean, title string, mime string, size bigint, created bigint, modified bigint"


def valid(prefix: str = "") -> Column:
    """Shape of an item; a tombstone carries neither bytes nor a hash of its own to check."""
    c = lambda name: F.col(f"{prefix}{name}")
    ok = (
        c("id").rlike("^[0-9a-f-]{36}$")
        & c("hash").rlike("^[0-9a-f]{64}$")
        & (c("revision") > 0)
        & F.octet_length(c("title")).between(1, 512)
        & F.octet_length(c("mime")).between(1, 255)
        & (c("size") >= 0)
        & (c("created") > 0)
        & (c("modified") >= c("created"))
    )
    return F.coalesce(ok, F.lit(False))


def manifest(items: DataFrame) -> DataFrame:
    """All items by id; one invalid item fails the scan."""
    checked = F.assert_true(valid(), F.concat(F.lit("invalid bronze item "), F.coalesce("id", F.lit("?"))))
    return items.where(checked.isNull()).orderBy("id")


def item(items: DataFrame, item_id: str) -> DataFrame:
    """The item of an id, if there is one."""
    return items.where(F.col("id") == item_id)


def verified(uploads: DataFrame) -> DataFrame:
    """Uploads (item columns, content) whose bytes have the declared size and hash."""
    return uploads.where((F.octet_length("content") == F.col("size")) & (F.sha2("content", 256) == F.col("hash")))


def commit_actions(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Action of each incoming item against the current one of its id: noop, insert, tombstone or conflict.

    New live items start at revision 1, new tombstones at 2. Of a current item only the tombstone with the next revision,
    the same title, type and creation and a later change follows.
    """
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    old = current.select(*[F.col(n).alias(f"old_{n}") for n in names])
    both = incoming.join(old, F.col("id") == F.col("old_id"), "left")
    fields = [n for n in names if n != "id"]
    same = F.lit(True)
    for n in fields:
        same = same & F.col(n).eqNullSafe(F.col(f"old_{n}"))
    follows = (
        ~F.col("old_deleted") & F.col("deleted") & (F.col("revision") == F.col("old_revision") + 1)
        & (F.col("title") == F.col("old_title")) & (F.col("mime") == F.col("old_mime"))
        & (F.col("created") == F.col("old_created")) & (F.col("modified") > F.col("old_modified"))
    )
    new = F.col("revision") == F.when(F.col("deleted"), 2).otherwise(1)
    action = (
        F.when(~valid(), "conflict")
        .when(F.col("old_id").isNull(), F.when(new, F.when(F.col("deleted"), "tombstone").otherwise("insert")).otherwise("conflict"))
        .when(same, "noop")
        .when(follows, "tombstone")
        .otherwise("conflict")
    )
    return both.select(*names, action.alias("action"))


def committed(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """The table after a batch of commits, of at most one item per id; conflicts leave their current item."""
    accepted = commit_actions(current, incoming).where("action in ('insert', 'tombstone')").drop("action")
    return current.join(accepted, "id", "left_anti").unionByName(accepted)


def new_blobs(blobs: DataFrame, stored: DataFrame) -> DataFrame:
    """One row per hash that is not stored yet."""
    return blobs.dropDuplicates(["hash"]).join(stored, "hash", "left_anti")


def unused_blobs(blobs: DataFrame, items: DataFrame) -> DataFrame:
    """Blobs that no live item has."""
    return blobs.join(items.where(~F.col("deleted")).select("hash"), "hash", "left_anti")


def readable(items: DataFrame, blobs: DataFrame) -> DataFrame:
    """Live items with their content."""
    return items.where(~F.col("deleted")).join(blobs, "hash")


def header_of(encoded: Column) -> Column:
    """Item metadata from its base64url header of at most 4096 bytes."""
    plain = F.when(F.octet_length(encoded) <= 4096, F.unbase64(F.translate(encoded, "-_", "+/")).cast("string"))
    return F.from_json(plain, SCHEMA)
