"""Running numbers over a whole table, or within its groups, without one task that holds it or a whole group."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import shared_folder


def numbered(df: DataFrame, key: str, name: str, start: int = 0, parts: int = 64, sample: int = 10_000) -> DataFrame:
    """``df`` with ``name``: ``start`` + 1, + 2 and so on in the order of ``key``, whose values are unique and not null.

    Bounds between at most ``parts`` ranges come from a sample of keys of bounded size; each range is numbered on its own,
    from the number of rows before it. Bounds are literals, so a range holds the same rows whenever it is computed.
    """
    n = df.count()
    drawn = df.select(key) if n <= sample else df.select(key).where(F.pmod(F.xxhash64(key), F.lit(n // sample + 1)) == 0)
    keys = sorted(r[0] for r in drawn.limit(4 * sample).collect())
    bounds = [keys[k * len(keys) // parts] for k in range(1, parts)] if len(keys) > parts else []
    part = F.lit(0)
    if bounds:
        part = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= F.col(key)))
    ranged = df.withColumn("_part", part)
    sizes = {r["_part"]: r["n"] for r in ranged.groupBy("_part").agg(F.count("*").alias("n")).collect()}  # one per range
    before = [start, *accumulate((sizes.get(p, 0) for p in range(len(bounds) + 1)), initial=start)][1:]
    offset = F.element_at(F.array(*[F.lit(b) for b in before]), F.col("_part") + 1)
    return ranged.withColumn(name, F.row_number().over(Window.partitionBy("_part").orderBy(key)) + offset).drop("_part")


def ranked_within(df: DataFrame, by: str, order: Sequence[Column], name: str) -> DataFrame:
    """``df`` with ``name``: 1, 2 and so on in an order within each value of ``by``, which may be null. Rows that tie have any
    order among themselves.

    Rows are sorted by range, so a value that has half of them lies in many ranges. Each range numbers its own; what earlier
    ranges have of the same value is added, one row for each range and value. The sorted rows are checkpointed: they are
    read twice, and a second sort could cut them elsewhere.
    """
    shared_folder(df.sparkSession)
    keys = [F.col(by).asc(), *order]
    sorted_ = df.repartitionByRange(*keys, F.xxhash64(*df.columns)).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()).checkpoint()
    part = F.shiftright("_at", 33)
    runs = sorted_.groupBy(F.col(by).alias("_by"), part.alias("_part")).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    earlier = F.coalesce(F.sum("_n").over(Window.partitionBy("_by").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row a range
    runs = runs.select("_by", "_part", (earlier - F.col("_first") + 1).alias("_shift"))
    met = sorted_.join(runs, F.col(by).eqNullSafe(F.col("_by")) & (part == F.col("_part")))
    return met.select(*df.columns, (F.col("_at") + F.col("_shift")).cast("int").alias(name))


def top_within(df: DataFrame, by: str, order: Sequence[Column], n: int, name: str, salts: int = 64) -> DataFrame:
    """The first ``n`` rows of each value of ``by`` in an order, with their rank ``name``: of each salted part of a value first,
    so that no task sees more than ``salts`` * ``n`` rows of one in the end."""
    salt = F.pmod(F.xxhash64(*df.columns), F.lit(salts))
    of_part = F.row_number().over(Window.partitionBy(by, "_salt").orderBy(*order))
    few = df.withColumn("_salt", salt).withColumn("_n", of_part).where(F.col("_n") <= n).drop("_salt", "_n")
    return few.withColumn(name, F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col(name) <= n)
