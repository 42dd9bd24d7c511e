"""Embedding near-dedup by Euclidean p-stable hashing, with exact cosine checks in the buckets.

1. ``classed``: equal vectors of one label are one class, by a 128-bit digest of label and unit vector. Everything below
   works on one vector a class, so copies cost nothing but their count.
2. ``bucketed``: tables of quantised Gaussian projections put the classes in buckets; only class, bucket and a 128-bit
   sketch move. The number of hashes a table grows with the logarithm of the largest label, so buckets of unlike vectors
   stay short, and the number of tables follows from them, so that a pair at the threshold meets with ``RECALL``.
3. ``kept_in``: a class stays in a bucket if another's sketch there differs in at most ``NEAR`` bits, which a pair at the
   threshold exceeds once in 10^8. Vectors are fetched for what is left.
4. ``linked``: exact cosines in double precision between vectors of one label, in blocks. A pair counts only in the first
   table where it meets: blocks give counts per class and a spanning forest, never lists of pairs.

A bucket of more than ``block`` classes is cut into blocks by a hash of the class, and each pair of blocks is compared on
its own, so no task holds a bucket. Joins on a class with many rows broadcast it, the number of such classes being bounded.

Defined results: a vector that is null, empty, zero or has null or non-finite components, or a null label or id, links
with nothing (``n_links`` 0, its own component, kept). Labels of any type are equal if their texts are. Vectors of
different lengths do not link. Each row gets its vector's result; equal rows of one id are one vector, an id that comes
with different vectors counts as that many.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, hub_join, small_batches
from .components import components
from .words import mix

#: Chance for a pair at the threshold to meet in a bucket; quantile width; least hashes a table; bits of a near sketch.
RECALL, WIDTH, LEAST_HASHES, NEAR, SKETCH = 0.998, 1.0, 6, 28, 128


def meeting(distance: float, width: float = WIDTH) -> float:
    """Probability that one quantised projection agrees on two points at a distance."""
    from math import erf, exp, pi, sqrt

    r = width / distance
    return erf(r / sqrt(2)) - 2 / (sqrt(2 * pi) * r) * (1 - exp(-r * r / 2))


def plan(n: int, threshold: float) -> tuple[int, int]:
    """Tables and hashes a table for ``n`` vectors of one label: about four unlike ones share a bucket with a vector."""
    far, near = meeting(2**0.5), meeting(max(1e-6, (2 - 2 * threshold) ** 0.5))
    hashes = max(LEAST_HASHES, ceil(log(max(n, 4) / 4) / -log(far)))
    return max(1, ceil(log(1 - RECALL) / log(1 - near**hashes))), hashes


def _projections(dim: int, tables: int, hashes: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng([seed, dim])
    return rng.standard_normal((dim, SKETCH)), rng.standard_normal((dim, tables * hashes)), rng.uniform(0, WIDTH, tables * hashes)


def _keys(x: np.ndarray, label: np.ndarray, tables: int, hashes: int, seed: int) -> np.ndarray:
    """Bucket of each row in each table; its id holds label, length and table."""
    _, a, b = _projections(x.shape[1], tables, hashes, seed)
    q = np.floor((x @ a + b) / WIDTH).astype(np.int64).astype(np.uint64).reshape(len(x), tables, hashes)
    key = mix(label)[:, None] + mix(np.arange(tables, dtype=np.uint64) + np.uint64(x.shape[1] << 16))
    for k in range(hashes):
        key = mix(key + q[:, :, k] * np.uint64(0x9E3779B97F4A7C15))
    return key


def _numbers(labels: list[str]) -> np.ndarray:
    return np.array([int.from_bytes(blake2b(s.encode(), digest_size=8).digest(), "little") for s in labels], np.uint64)


def _rows(units: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and matrix of the vectors of each length."""
    length = np.array([len(u) for u in units])
    for size in np.unique(length):
        at = np.flatnonzero(length == size)
        yield at, np.frombuffer(b"".join(units[k] for k in at), np.float64).reshape(len(at), -1)


def classed(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(vec_id, label, cls, unit) of every row; ``cls`` and ``unit`` are null where the row links with nothing."""
    v = F.col("v")
    rows = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    good = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & v.isNotNull() & finite, F.lit(False))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels, lists = batch.column(1).to_pylist(), batch.column(2)
            units: list[bytes | None] = [None] * len(labels)
            valid = np.flatnonzero(lists.is_valid().to_numpy(zero_copy_only=False))
            length = lists.value_lengths().to_numpy(zero_copy_only=False)[valid].astype(np.int64)
            flat, ends = lists.flatten().to_numpy(zero_copy_only=False), np.cumsum(length)
            for dim in np.unique(length):
                at = np.flatnonzero(length == dim)
                x = flat[(ends[at] - dim)[:, None] + np.arange(dim)]
                x = x / np.abs(x).max(axis=1, keepdims=True)
                x = x / np.sqrt((x * x).sum(axis=1, keepdims=True)) + 0.0
                for k, unit in zip(valid[at].tolist(), x, strict=True):
                    units[k] = unit.tobytes()
            digests = [None if u is None else blake2b(s.encode() + b"\0" + u, digest_size=16).digest() for s, u in zip(labels, units, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(digests, pa.binary()), pa.array(units, pa.binary())], names=["vec_id", "label", "cls", "unit"])

    return rows.select("vec_id", "label", F.when(good, v).alias("v")).mapInArrow(of, "vec_id bigint, label string, cls binary, unit binary")


def bucketed(units: DataFrame, tables: int, hashes: int, seed: int) -> DataFrame:
    """(bucket, cls, sketch): a row for each class and table."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label, cls = _numbers(batch.column(1).to_pylist()), batch.column(0)
            for at, x in _rows(batch.column(2).to_pylist()):
                signs = np.packbits(x @ _projections(x.shape[1], tables, hashes, seed)[0] > 0, axis=1)
                key, rows = _keys(x, label[at], tables, hashes, seed), np.repeat(np.arange(len(x)), tables)
                sketch = pa.array([s.tobytes() for s in signs], pa.binary()).take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([pa.array(key.reshape(-1).view(np.int64)), cls.take(pa.array(at[rows])), sketch], names=["bucket", "cls", "sketch"])

    return units.select("cls", "label", "unit").mapInArrow(of, "bucket bigint, cls binary, sketch binary")


def blocked(rows: DataFrame, block: int, per_task: int = 4000) -> DataFrame:
    """Rows (bucket, cls, more) of buckets with two rows or more, with their block ``mine``, the pair of blocks ``bi`` and
    ``bj`` and the ``task`` that compares it; a row of a bucket of many blocks once for each pair."""
    n = rows.count()
    count = rows.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    met = hub_join(rows, count, "bucket", F.col("size") > max(block, n // 1000))  # at most 1000 buckets
    blocks = F.ceil(F.col("size") / block).cast("int")
    met = met.withColumn("mine", F.pmod(F.xxhash64("cls"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    tasks = max(1, n // per_task)
    task = F.when(F.col("size") <= block, F.pmod("bucket", F.lit(tasks))).otherwise(F.xxhash64("bucket", F.least("mine", "other"), F.greatest("mine", "other")))
    return met.withColumns({"bi": F.least("mine", "other"), "bj": F.greatest("mine", "other"), "task": task}).drop("other", "size")


def _pairs(group: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """Rows of both blocks of each pair of blocks in a task, and whether they are one block."""
    bucket, bi, bj, mine = (group.column(c).to_numpy() for c in ("bucket", "bi", "bj", "mine"))
    order = np.lexsort((bj, bi, bucket))
    changes = np.flatnonzero(np.concatenate([[True], (np.diff(bucket[order]) != 0) | (np.diff(bi[order]) != 0) | (np.diff(bj[order]) != 0)]))
    for a, b in zip(changes, np.append(changes[1:], len(order)), strict=True):
        rows = order[a:b]
        same = bi[rows[0]] == bj[rows[0]]
        left, right = (rows, rows) if same else (rows[mine[rows] == bi[rows[0]]], rows[mine[rows] == bj[rows[0]]])
        if len(rows) > 1 and len(left) and len(right):
            yield left, right, same


def _near(group: pa.Table) -> pa.Table:
    """(bucket, cls) with another of a like sketch in their bucket."""
    sketch = np.frombuffer(b"".join(group.column("sketch").to_pylist()), np.uint64).reshape(-1, SKETCH // 64)
    kept = np.zeros(len(sketch), bool)
    bucket = group.column("bucket").to_numpy()
    _, place, count = np.unique(bucket, return_inverse=True, return_counts=True)
    short = (count <= 64)[place] & (group.column("bi").to_numpy() == group.column("bj").to_numpy())
    rows = np.argsort(bucket, kind="stable")
    rows = rows[short[rows]]
    of, told = bucket[rows], sketch[rows]
    for step in range(1, 64):  # every row of a short bucket with the next, the one after, and so on
        at = np.flatnonzero(of[step:] == of[:-step])
        if not len(at):
            break
        near = at[np.bitwise_count(told[at] ^ told[at + step]).sum(axis=1, dtype=np.int16) <= NEAR]
        kept[rows[near]] = True
        kept[rows[near + step]] = True
    long = np.flatnonzero(~short)
    for left, right, same in _pairs(group.take(pa.array(long))) if len(long) else ():
        left, right = long[left], long[right]
        for s in range(0, len(left), 1000):
            part = left[s : s + 1000]
            near = np.bitwise_count(sketch[part][:, None, :] ^ sketch[right][None, :, :]).sum(axis=2, dtype=np.int16) <= NEAR
            if same:
                near[np.arange(len(part)), s + np.arange(len(part))] = False
            kept[part[near.any(axis=1)]] = True
            kept[right[near.any(axis=0)]] = True
    return group.select(["bucket", "cls"]).filter(pa.array(kept))


def _forest(x: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
    """Smallest index reachable from each of ``n`` by the pairs."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _compare(threshold: float, tables: int, hashes: int, seed: int):
    def of(group: pa.Table) -> pa.Table:
        bucket, cls, labels, sizes = group.column("bucket").to_numpy(), group.column("cls").to_pylist(), group.column("label").to_pylist(), group.column("size").to_numpy()
        units, label = group.column("unit").to_pylist(), np.unique(np.array(labels, object), return_inverse=True)[1]
        out: list[list] = [[], [], []]
        for left, right, same in _pairs(group):
            dims = {len(units[k]) for k in (*left.tolist(), *right.tolist())}
            for dim in dims:  # one, unless buckets of two lengths share their id
                l, r = (np.array([k for k in side.tolist() if len(units[k]) == dim], np.int64) for side in (left, right))
                load = lambda rows: np.frombuffer(b"".join(units[k] for k in rows.tolist()), np.float64).reshape(len(rows), -1)
                xl, xr = load(l), load(r)
                kl, kr = (_keys(x, _numbers([labels[k] for k in rows.tolist()]), tables, hashes, seed) for x, rows in ((xl, l), (xr, r)))
                t = int(np.argmax(kl[0] == bucket[l[0]].view(np.uint64))) if len(l) else 0
                for s in range(0, len(l), 1000):
                    near = (xl[s : s + 1000] @ xr.T >= threshold) & (label[l[s : s + 1000]][:, None] == label[r][None, :])
                    if same:
                        near &= np.arange(len(r))[None, :] > np.arange(s, min(s + 1000, len(l)))[:, None]
                    i, j = np.nonzero(near)
                    i = i + s
                    met = (kl[i, :t] == kr[j, :t]).any(axis=1)  # counted in that table
                    i, j = l[i[~met]], r[j[~met]]
                    if len(i):
                        both, back = np.unique(np.concatenate([i, j]), return_inverse=True)
                        a, b = back[: len(i)], back[len(i) :]
                        out[0] += [cls[k] for k in both.tolist()]
                        out[1].append(np.bincount(back, np.concatenate([sizes[j], sizes[i]]), len(both)).astype(np.int64))
                        out[2] += [cls[both[k]] for k in _forest(a, b, len(both)).tolist()]
        links = np.concatenate(out[1]) if out[1] else np.empty(0, np.int64)
        return pa.table({"cls": pa.array(out[0], pa.binary()), "links": pa.array(links), "root": pa.array(out[2], pa.binary())})

    return of


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.98, block: int = 1000, seed: int = 42) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of ``vectors``."""
    small_batches(vectors.sparkSession)
    told = cut(classed(vectors, id_col, vector_col, label_col).withColumn("row", F.monotonically_increasing_id()))
    good = told.where("cls is not null")
    # One row for each class: its smallest id, the row that has it, and its number of ids.
    once = good.groupBy("cls", "vec_id").agg(F.min("row").alias("row"))
    reps = cut(once.groupBy("cls").agg(F.min("vec_id").alias("least"), F.count("*").alias("size"), F.min("row").alias("row")))
    units = cut(good.select("row", "label", "unit").join(reps, "row").select("cls", "label", "unit", "size"))
    tables, hashes = plan(units.groupBy("label").count().agg(F.max("count")).first()[0] or 0, threshold)
    hashed = cut(bucketed(units, tables, hashes, seed))
    kept = cut(blocked(hashed, block).groupBy("task").applyInArrow(_near, "bucket bigint, cls binary").distinct())
    met = blocked(kept, block).join(units, "cls")
    found = cut(met.groupBy("task").applyInArrow(_compare(threshold, tables, hashes, seed), "cls binary, links bigint, root binary"))
    links = found.groupBy("cls").agg(F.sum("links").alias("links"))
    label = components(found.select(F.col("cls").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "cls")
    per = reps.select("cls", "least", "size").join(links, "cls", "left").join(label, "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    component = per.groupBy("label").agg(F.min("least").alias("component_id"), F.count("*").alias("many"))
    per = hub_join(per, component, "label", F.col("many") > max(64, units.count() // 1000)).select("cls", "size", (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    n = max(1000, told.count() // 1000)
    rows = hub_join(good.select("vec_id", "cls"), per, "cls", F.col("size") > n).select("vec_id", "n_links", "component_id")
    alone = told.where("cls is null").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return rows.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
