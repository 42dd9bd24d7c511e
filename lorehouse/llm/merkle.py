"""A Merkle manifest of a dataset: one digest for all rows, one for each source, and for each row the proof that it is in.

Rows of a source ascend by key and are the leaves of a tree whose inner nodes hash up to ``FANOUT`` nodes; the sources'
roots, in order, are the leaves of a last tree. Leaves are numbered within their source by a range sort and one running
sum over partitions. Aligned blocks of ``FANOUT ** HEIGHT`` nodes are then walked, each in its task: the recursion returns
a subtree's digest and, while it unwinds, appends the siblings it met to every leaf inside. The blocks' roots are the nodes
of the next such pass, 1/256 of the size, until each source has one, and so on over the sources. What the passes above
found is joined downwards by block, so no join meets more than ``FANOUT ** HEIGHT`` rows of a key, whatever a source holds.

Defined results: null fields hash as ``-``, so a null is not an empty text; a null source is a source, the first one;
rows of one source and key are ordered by their leaf, and equal rows each have a place; a null key comes first. A lone leaf
is its source's root, and a lone source's root is the dataset's. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import UPPER, LOWER, cut, discard

#: Nodes under one node, levels that one block has, and rows of run lengths that may be broadcast.
FANOUT, HEIGHT, FEW = 16, 2, 100_000
BLOCK = FANOUT**HEIGHT
SIBLINGS = "array<struct<left:binary,right:binary>>"


def leaf(*fields: Column) -> Column:
    """The hash of a row: each field as its length in bytes, a colon and its value, or ``-``."""
    value = lambda c: F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-"))
    return F.unhex(F.sha2(F.concat(*map(value, fields)), 256))


def _hex(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def folded(digest: Column, siblings: Column) -> Column:
    """The root, in hex, that a leaf and its siblings give."""
    return F.aggregate(siblings, _hex(digest), lambda at, s: F.sha2(F.concat(_hex(s["left"]), at, _hex(s["right"])), 256))


def proof_digest(siblings: Column) -> Column:
    """SHA-256 of the siblings in hex, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(siblings, lambda s: F.concat(_hex(s["left"]), _hex(s["right"]))), ""), 256)


def placed(rows: DataFrame, tree: str, order: Sequence[str]) -> DataFrame:
    """``rows`` with ``pos``, their number from 0 within their tree. Rows that tie have any order among themselves.

    A tree may lie in many ranges; each range numbers its own, and the rows of the same tree in ranges before are added.
    """
    by = [tree, *order, "_tie"]
    ranged = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*map(F.col, by)).sortWithinPartitions(*by)
    written = cut(ranged.withColumn("_at", F.monotonically_increasing_id()).drop("_tie"))
    part = F.shiftright("_at", 33)
    runs = written.groupBy(F.col(tree).alias("_tree"), part.alias("_part")).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_tree").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a tree has one run in a range
    runs = cut(runs.select("_tree", "_part", (before - F.col("_first")).alias("_shift")))
    side = F.broadcast(runs) if runs.count() <= FEW else runs
    met = written.join(side, F.col(tree).eqNullSafe(F.col("_tree")) & (part == F.col("_part")))
    out = met.select(*rows.columns, (F.col("_at") + F.col("_shift")).alias("pos"))
    out._working = [written, runs]
    return out


def _walked(table: pa.Table) -> pa.Table:
    """One block: its rows with ``siblings``, within the block, and ``top``, the block's digest."""
    table = table.combine_chunks().sort_by("pos")
    digests, n = table["digest"].to_pylist(), table.num_rows
    left: list[list[bytes]] = [[] for _ in range(n)]
    right: list[list[bytes]] = [[] for _ in range(n)]

    def walk(first: int, last: int, height: int) -> bytes:
        if not height:
            return digests[first]
        step = FANOUT ** (height - 1)
        starts = range(first, last, step)
        under = [walk(s, min(s + step, last), height - 1) for s in starts]
        for k, s in enumerate(starts):
            before, after = b"".join(under[:k]), b"".join(under[k + 1 :])
            for i in range(s, min(s + step, last)):
                left[i].append(before)
                right[i].append(after)
        return hashlib.sha256(b"".join(under).hex().encode()).digest()

    height = HEIGHT
    if table["block"][0].as_py() == 0:  # the only block of its tree where it isn't full
        height = next(h for h in range(HEIGHT + 1) if FANOUT**h >= n)
    top = walk(0, n, height)
    offsets = pa.array(np.arange(n + 1, dtype=np.int32) * height)
    pairs = pa.StructArray.from_arrays([pa.array([x for row in side for x in row], pa.binary()) for side in (left, right)], ["left", "right"])
    return table.append_column("siblings", pa.ListArray.from_arrays(offsets, pairs)).append_column("top", pa.array([top] * n, pa.binary()))


def climb(nodes: DataFrame, crown: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Nodes (tree, pos, digest, ...) with ``siblings`` up to ``top``; ``crown`` takes the trees' roots further."""
    blocks = nodes.withColumn("block", F.floor(F.col("pos") / BLOCK).cast("bigint"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in blocks.schema)
    walked = cut(blocks.groupBy("tree", "block").applyInArrow(_walked, f"{fields}, siblings {SIBLINGS}, top binary"))
    discard(nodes.sparkSession, *getattr(nodes, "_working", []))
    tops = walked.where(F.col("pos") % BLOCK == 0).select("tree", F.col("block").alias("pos"), F.col("top").alias("digest"))
    if not tops.where("pos > 0").isEmpty():
        above = climb(tops, crown)
    elif crown is not None:
        above = crown(tops)
    else:
        return walked.withColumn("subroot", F.lit(None).cast("binary")).drop("block")
    above = above.select(F.col("tree").alias("_tree"), F.col("pos").alias("_block"), F.col("siblings").alias("_more"), F.col("top").alias("_top"), F.col("subroot").alias("_sub"))
    met = walked.join(above, F.col("tree").eqNullSafe(F.col("_tree")) & (F.col("block") == F.col("_block")))
    return met.select(*[c for c in nodes.columns], F.concat("siblings", "_more").alias("siblings"), F.col("_top").alias("top"), F.col("_sub").alias("subroot"))


def _sources(tops: DataFrame) -> DataFrame:
    """The sources' roots as leaves of the last tree."""
    leaves = placed(tops.select(F.lit(0).alias("tree"), F.col("tree").alias("name"), "digest"), "tree", ["name"])
    told = climb(leaves)
    return told.select(F.col("name").alias("tree"), F.lit(0).cast("bigint").alias("pos"), "siblings", "top", F.col("digest").alias("subroot"))


def manifest(docs: DataFrame, fields: Sequence[str], source: str, key: str, tampered: dict[str, Column] | None = None) -> DataFrame:
    """(key, source, leaf, check, siblings, subroot, root), digests binary: every row's leaf and its proof.

    ``tampered`` gives other values of some fields; ``check`` is the leaf that they make, read in the same scan.
    """
    other = tampered or {}
    own = leaf(*[F.col(c) for c in fields])
    check = leaf(*[other.get(c, F.col(c)) for c in fields]) if other else own
    scanned = cut(docs.select(F.col(key).alias("key"), F.col(source).cast("string").alias("tree"), own.alias("digest"), check.alias("check")))
    leaves = placed(scanned, "tree", ["key", "digest"])
    leaves._working.append(scanned)
    return climb(leaves, _sources).select("key", F.col("tree").alias("source"), F.col("digest").alias("leaf"), "check", "siblings", "subroot", F.col("top").alias("root"))


def verified(told: DataFrame) -> DataFrame:
    """(key, leaf, subroot, root, proof_sha256, folded_root, verified), digests in hex: whether ``check`` and the row's siblings still give the root."""
    fold = told.select("*", F.explode(F.array(folded(F.col("check"), F.col("siblings")))).alias("folded_root"))
    root = _hex(F.col("root"))
    return fold.select(
        "key", _hex(F.col("leaf")).alias("leaf"), _hex(F.col("subroot")).alias("subroot"), root.alias("root"), proof_digest(F.col("siblings")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == root).alias("verified")
    )


def lowered_sometimes(key: Column, text: Column) -> Column:
    """The text, its A-Z lower-cased where 5 divides the crc32 of the key: the tampering of the registered query."""
    hit = F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return F.when(hit, F.translate(text, UPPER, LOWER)).otherwise(text)
