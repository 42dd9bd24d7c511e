"""A client's desktop: ordered shortcuts to originals and entities, and the objects it has ever known.

Shortcuts are (desktop, object_type, object_id, position), known objects (desktop, object_type, object_id). Every change
gives positions 0 to n - 1 again; a desktop is one person's, so its shortcuts fit a window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ORIGINAL, ENTITY = "bronze", "silver-entity"
KEY, DEALT = ["desktop", "object_type", "object_id"], 16
DOCUMENT = "version int, items array<struct<object_type:string,object_id:string,`order`:int>>, known_objects array<string>"


def ordered(items: DataFrame) -> DataFrame:
    """Positions from 0 on, in the order they have."""
    place = F.row_number().over(Window.partitionBy("desktop").orderBy("position", "object_type", "object_id")) - 1
    return items.withColumn("position", place)


def with_originals(items: DataFrame, known: DataFrame, manifest: DataFrame) -> DataFrame:
    """Shortcuts after a manifest: those of vanished originals go, live ones never known are added behind, by id."""
    live = manifest.where(~F.col("deleted")).select(F.col("id").alias("object_id"))
    rest = items.where(F.col("object_type") != ORIGINAL).unionByName(items.where(F.col("object_type") == ORIGINAL).join(live, "object_id", "left_semi").select(*items.columns))
    desktops = known.unionByName(items.select(*KEY)).select("desktop").distinct()
    fresh = _each(live, desktops).withColumn("object_type", F.lit(ORIGINAL))
    fresh = fresh.join(known, KEY, "left_anti").select("desktop", "object_type", "object_id", F.lit(1 << 30).alias("position"))
    return ordered(rest.unionByName(fresh))


def _each(live: DataFrame, desktops: DataFrame) -> DataFrame:
    """Every live original for each desktop. Desktops lie in ``DEALT`` groups and each original meets every group, so the pairs,
    all of which are wanted, are made in many tasks."""
    group = F.pmod(F.xxhash64("desktop"), F.lit(DEALT)).cast("int")
    return live.withColumn("_group", F.explode(F.sequence(F.lit(0), F.lit(DEALT - 1)))).join(desktops.withColumn("_group", group), "_group").drop("_group")


def known_after(items: DataFrame, known: DataFrame, manifest: DataFrame) -> DataFrame:
    """Known objects after a manifest: whatever it lists, deleted or not, is known from now on."""
    desktops = known.unionByName(items.select(*KEY)).select("desktop").distinct()
    seen = _each(manifest.select(F.col("id").alias("object_id")), desktops).select("desktop", F.lit(ORIGINAL).alias("object_type"), "object_id")
    return known.unionByName(seen).distinct()


def without_lost_entities(items: DataFrame, entities: DataFrame) -> DataFrame:
    """Shortcuts to entities that are no longer there go."""
    there = entities.select(F.col("entity_id").alias("object_id")).distinct()
    lost = items.where(F.col("object_type") == ENTITY).join(there, "object_id", "left_anti").select(*KEY)
    return ordered(items.join(lost, KEY, "left_anti"))


def pinned(items: DataFrame, pins: DataFrame) -> DataFrame:
    """``items`` with ``pins`` behind them, those that are there already staying in place."""
    new = pins.join(items, KEY, "left_anti").select(*KEY, F.lit(1 << 30).alias("position"))
    return ordered(items.unionByName(new))


def unpinned(items: DataFrame, pins: DataFrame) -> DataFrame:
    return ordered(items.join(pins, KEY, "left_anti"))


def moved(items: DataFrame, moves: DataFrame) -> DataFrame:
    """``items`` with one shortcut of each desktop at another place (KEY, to), held within the bounds."""
    at = ordered(items).join(moves.select(*KEY, "to"), KEY, "left")
    of = Window.partitionBy("desktop")
    at = at.withColumns({"_from": F.max(F.when(F.col("to").isNotNull(), F.col("position"))).over(of), "_n": F.count("*").over(of)})
    at = at.withColumn("_to", F.max(F.when(F.col("to").isNotNull(), F.greatest(F.lit(0), F.least("to", F.col("_n") - 1)))).over(of))
    shift = F.when(F.col("to").isNotNull(), F.col("_to")).when((F.col("position") > F.col("_from")) & (F.col("position") <= F.col("_to")), F.col("position") - 1)
    shift = shift.when((F.col("position") < F.col("_from")) & (F.col("position") >= F.col("_to")), F.col("position") + 1).otherwise(F.col("position"))
    return at.select(*KEY, shift.cast("int").alias("position"))


def resolved(items: DataFrame, manifest: DataFrame, names: DataFrame) -> DataFrame:
    """Shortcuts with the title of what they stand for, null where it is gone."""
    originals = manifest.where(~F.col("deleted")).select(F.lit(ORIGINAL).alias("object_type"), F.col("id").alias("object_id"), "title")
    entities = names.select(F.lit(ENTITY).alias("object_type"), F.col("entity_id").alias("object_id"), F.col("label").alias("title"))
    return items.join(originals.unionByName(entities), ["object_type", "object_id"], "left")


def from_documents(rows: DataFrame, json_col: str = "document") -> DataFrame:
    """Shortcuts of desktop documents (desktop, json), in their order and numbered again."""
    read = rows.select("desktop", F.posexplode(F.from_json(json_col, DOCUMENT)["items"]).alias("i", "x"))
    return ordered(read.select("desktop", "x.object_type", "x.object_id", F.coalesce("x.order", "i").alias("position")))


def to_documents(items: DataFrame, known: DataFrame) -> DataFrame:
    """(desktop, document): the JSON of each desktop, known objects sorted."""
    listed = items.groupBy("desktop").agg(F.array_sort(F.collect_list(F.struct("position", "object_type", "object_id"))).alias("i"))
    names = known.groupBy("desktop").agg(F.array_sort(F.collect_set(F.concat_ws(":", "object_type", "object_id"))).alias("known_objects"))
    entry = F.transform("i", lambda x: F.struct(x["object_type"].alias("object_type"), x["object_id"].alias("object_id"), x["position"].alias("order")))
    return listed.join(names, "desktop", "full_outer").select("desktop", F.to_json(F.struct(F.lit(1).alias("version"), F.coalesce(entry, F.array()).alias("items"), F.coalesce("known_objects", F.array().cast("array<string>")).alias("known_objects"))).alias("document"))
