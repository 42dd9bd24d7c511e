"""N-gram Jaccard join by vertical partitioning: the global n-gram order is cut into fragments.

1. ``classes``: documents with the same set of n-grams share a class ``v``. A second 64-bit hash of the set is compared in
   every class; should two sets ever share a class, all are hashed again with another salt.
2. ``fragments``: every document's distinct n-grams are cut by hash range, into as many fragments as hold ``FRAGMENT``
   n-grams each. Documents come in batches, a class once in each; a fragment of a batch is one row of bytes, where an
   n-gram is its hash and the gap from the last one's document to its own in the batch. Classes and set sizes go once a
   document into a directory, dealt by class, so that an n-gram takes the same bytes whatever the number of fragments.
3. ``active_sets``: each fragment counts in how many documents its n-grams occur. N-grams of one alone cannot overlap
   with anything and end here; the others return to their batch. The directory tells the batch its documents' classes,
   how often each class was sent, and which of its documents stands for it. N-grams found no more often than their
   class was sent are in that class alone and end here; the others are its sorted list, rarest first. A class keeps its
   list only if at least the threshold's share of its n-grams is left. N-grams so frequent that they would fill a
   fragment (``heavy``, found in a sample of the batches) skip the count: they are shared and come last in the order.
4. ``prefix_index``: two sets of the wanted similarity share an n-gram in their prefixes of that order.
5. ``link``: a bucket of the index compares all its classes with a few pivots, and in later waves with many times as
   many, but only across components: a group of near copies that has grown together costs no more pairs. When the last
   wave ends, every two classes of a bucket are in one component or were compared, so no link is lost.
6. ``overlaps``: candidate pairs are joined with the fragments of both sets, overlaps are counted in each fragment
   separately and summed per pair.

N-grams are 48-bit hashes within a document: two of one pair of documents collide with probability |A| |B| / 2^48, 1 in
10^8 for two documents of 1600 n-grams, and then count as one; on all 256410 documents of the larger check table the set
sizes equal those by 64-bit hashes. Words and sets have 64 and 128 bits.

Defined results: null and empty texts, and texts of blanks, have no n-gram, are linked with nothing and are their own
component. Rows with equal sets are one class; repeated rows of one document each get its result. A null id is never a
component's id unless all ids of the component are null. Only the id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, discard, free_name, give_back, hub_join, small_batches, tidied
from .components import components
from .words import mix, runs_of_words

#: Documents' n-grams carry 48 bits of hash; the 16 bits above hold the number of documents, at most TOP.
BITS, TOP = 48, 32_000
#: N-grams of a fragment, and at most of a batch of documents; one in so many runs is looked through for heavy n-grams.
FRAGMENT, BATCH, SAMPLED = 600_000, 2_000_000, 16
#: Bytes of a gap between documents, a batch having fewer than 2^24; a hash; an n-gram's key; a class, a set size, a count.
GAP, HASH, KEY, CLASS, SIZE, COUNT = 3, BITS // 8, 8, 8, 4, 2
_LOW = np.uint64((1 << BITS) - 1)
_STEPS = mix(np.arange(1, 65, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)


def shingle_sets(texts: pa.Array, n: int, salt: int = 0) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Per run of documents: its first row, set sizes, class ids ``v`` and the distinct hashes, ordered by document."""
    for run in runs_of_words(texts):
        words = np.bincount(run.doc, minlength=run.n_docs)
        ends = np.cumsum(words)
        total = len(run.hash) - n + 1
        h = np.zeros(max(total, 0), np.uint64)
        for k in range(n):
            h += run.hash[k : k + len(h)] * _STEPS[k]
        inside = run.doc[: len(h)] == run.doc[n - 1 : n - 1 + len(h)] if len(h) else np.empty(0, bool)
        short = np.flatnonzero((words > 0) & (words < n))
        whole = np.zeros(len(short), np.uint64)
        for k in range(n - 1):  # a short document's words as one
            has = words[short] > k
            whole[has] += run.hash[(ends - words)[short[has]] + k] * _STEPS[k]
        whole += words[short].astype(np.uint64) * _STEPS[63]
        key = np.concatenate([run.doc[: len(h)][inside].astype(np.uint64), short.astype(np.uint64)]) << np.uint64(BITS)
        key = np.sort(key | (mix(np.concatenate([h[inside], whole])) & _LOW))
        key = key[np.concatenate([[True], key[1:] != key[:-1]])] if len(key) else key
        sizes = np.bincount((key >> np.uint64(BITS)).astype(np.int64), minlength=run.n_docs)
        hashes = key & _LOW
        yield run.first, sizes, set_hash(hashes, sizes, salt), hashes


def set_hash(hashes: np.ndarray, sizes: np.ndarray, salt: int) -> np.ndarray:
    """64 bits of each set, whatever the order of its n-grams; 0 for an empty set."""
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(mix(hashes * _STEPS[0] + _STEPS[3 + salt]), out=sums[1:])
    at = np.concatenate([[0], np.cumsum(sizes)])
    return np.where(sizes > 0, mix(sums[at[1:]] - sums[at[:-1]] + sizes.astype(np.uint64) * _STEPS[2]), np.uint64(0))


def _frequent(v: np.ndarray, sizes: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """N-grams in a twentieth of a run's classes, and in how many."""
    first = np.unique(v[v != 0], return_index=True)[1]
    once = np.zeros(len(v), bool)
    once[np.flatnonzero(v != 0)[first]] = True
    h, count = np.unique(hashes[np.repeat(once, sizes)], return_counts=True)
    often = count >= max(8, once.sum() // 20)
    return h[often], count[often]


def _classed(rows: DataFrame, kept: str, n: int, salt: int) -> DataFrame:
    """``rows``, their text last, with v, w and n in place of the text; and a row (v: an n-gram, n: minus its classes,
    else null) for each frequent n-gram of a sampled run."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = 0
        for batch in batches:
            names = [*batch.schema.names[:-1], "v", "w", "n"]
            for first, sizes, v, hashes in shingle_sets(batch.column(batch.num_columns - 1), n, salt):
                part = batch.slice(first, len(sizes))
                w = set_hash(hashes, sizes, 30 + salt)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(v.view(np.int64)), pa.array(w.view(np.int64)), pa.array(sizes.astype(np.int64))], names=names)
                if turn % SAMPLED == 0 and len(hashes):
                    h, count = _frequent(v, sizes, hashes)
                    none = [pa.nulls(len(h), c.type) for c in part.columns[:-1]]
                    yield pa.RecordBatch.from_arrays([*none, pa.array(h.view(np.int64)), pa.nulls(len(h), pa.int64()), pa.array(-count.astype(np.int64))], names=names)
                turn += 1

    return rows.mapInArrow(tidied(of), f"{kept}, v bigint, w bigint, n bigint")


def classes(rows: DataFrame, kept: str, n: int) -> tuple[DataFrame, np.ndarray, int, int]:
    """Rows (the columns ``kept``, v, w, n) of each document, the heavy n-grams, the number of n-grams, and the salt of v."""
    for salt in range(3):
        told = cut(_classed(rows, kept, n, salt))
        found = told.where("n >= 0")
        if not found.where("n > 0").groupBy("v").agg(F.min("w").alias("a"), F.max("w").alias("b")).where("a <> b").limit(1).count():
            break
    total = found.agg(F.sum("n")).first()[0] or 0
    # At most 100000 n-grams: each stands for that share of all of them, or for a quarter of a fragment.
    often = told.where("n < 0").groupBy("v").agg((-SAMPLED * F.sum("n")).alias("n")).where(F.col("n") > max(FRAGMENT // 4, total // 100_000))
    heavy = np.sort(np.array([r["v"] for r in often.select("v").collect()], np.int64).view(np.uint64))
    return found, heavy, total, salt


def sizes_of(total: int) -> tuple[int, int]:
    """Numbers of fragments for so many n-grams, and of those for heavy n-grams and of the directory's parts."""
    parts = max(1, -(-total // FRAGMENT))
    return parts, max(1, parts // 4)


def packed(starts: np.ndarray, place: np.ndarray, *columns: tuple[np.ndarray, int]) -> pa.Array:
    """Rows of bytes, one from each of ``starts`` to the next: the gaps between the ascending ``place``, then the columns in
    so many bytes a value; of each the lowest bytes of all the row's values first, so that equal bytes lie together."""
    count = np.diff(np.append(starts, len(place)))
    gap = np.diff(place, prepend=0)
    gap[starts] = place[starts]
    columns = ((gap, GAP), *columns)
    width = sum(w for _, w in columns)
    at, step = np.arange(len(place)) + np.repeat((width - 1) * starts, count), np.repeat(count, count)
    out = np.empty(width * len(place), np.uint8)
    for values, w in columns:
        split = np.ascontiguousarray(values.astype("<u8")).view(np.uint8).reshape(-1, 8)
        for byte in range(w):
            out[at] = split[:, byte]
            at += step
    offsets = (np.append(starts, len(place)) * width).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(out)])


def unpacked(data: pa.ChunkedArray, *widths: int) -> tuple[np.ndarray, ...]:
    """Of rows from ``packed``: each value's row, its place, and the columns as uint64."""
    widths = (GAP, *widths)
    raw = np.frombuffer(b"".join(data.to_pylist()), np.uint8)
    count = pc.binary_length(data).to_numpy().astype(np.int64) // sum(widths)
    starts = np.cumsum(count) - count
    row = np.repeat(np.arange(len(count)), count)
    at, step, found = np.arange(len(row)) + (sum(widths) - 1) * starts[row], count[row], []
    for w in widths:
        split = np.zeros((len(row), 8), np.uint8)
        for byte in range(w):
            split[:, byte] = raw[at]
            at += step
        found.append(split.view("<u8")[:, 0])
    sums = np.cumsum(gap := found[0].astype(np.int64))
    return row, sums - (sums - gap)[starts][row], *found[1:]


def _starts(x: np.ndarray) -> np.ndarray:
    """Where the values of ``x`` change, the first included."""
    return np.flatnonzero(np.concatenate([np.ones(min(1, len(x)), bool), x[1:] != x[:-1]]))


def fragments(docs: DataFrame, text_col: str, n: int, parts: int, spread: int, salt: int = 0, heavy: np.ndarray | None = None) -> DataFrame:
    """(f, run, data): for each batch ``run`` of documents with n-grams, packed by their place in it, a row for each
    fragment: its hashes below ``parts``; heavy ones, in one of the next ``spread``; classes ``v`` and set sizes in the
    ``spread`` after these, dealt by class."""
    heavy = np.empty(0, np.uint64) if heavy is None else heavy

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Runs together until they have ``most`` n-grams, so that a fragment's row is not too short."""
        held, size, most = [], 0, min(BATCH, max(300_000, 64 * parts))
        for batch in batches:
            for _, sizes, v, hashes in shingle_sets(batch.column(0), n, salt):
                if not len(hashes):
                    continue
                if held and size + len(hashes) > most:
                    yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
                    held, size = [], 0
                held.append((sizes[sizes > 0], v[sizes > 0], hashes))
                size += len(hashes)
        if held:
            yield tuple(np.concatenate(x) for x in zip(*held, strict=True))

    def rows(f: np.ndarray, run: int, place: np.ndarray, *columns: tuple[np.ndarray, int]) -> pa.RecordBatch:
        order = np.argsort(f.astype(np.min_scalar_type(parts + 2 * spread)), kind="stable")
        starts = _starts(f := f[order])
        data = packed(starts, place[order], *[(x[order], w) for x, w in columns])
        return pa.RecordBatch.from_arrays([pa.array(f[starts].astype(np.int32)), pa.array(np.full(len(starts), run, np.int64)), data], names=["f", "run", "data"])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for turn, (sizes, v, hashes) in enumerate(runs(batches)):
            once = np.zeros(len(v), bool)
            once[np.unique(v, return_index=True)[1]] = True
            hashes, sizes, v = hashes[np.repeat(once, sizes)], sizes[once], v[once]
            # Its number tells a batch from all others, and from itself with other documents should a task be repeated.
            run = int(mix(np.array([TaskContext.get().partitionId() << 32 | turn], np.uint64) ^ np.bitwise_xor.reduce(mix(v + np.arange(len(v), dtype=np.uint64)))).view(np.int64)[0])
            f = ((hashes >> np.uint64(16)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
            if len(heavy):
                at = np.minimum(np.searchsorted(heavy, hashes), len(heavy) - 1)
                f = np.where(heavy[at] == hashes, parts + run % spread, f)
            yield rows(f, run, np.repeat(np.arange(len(v)), sizes), (hashes, HASH))
            yield rows(parts + spread + (v % np.uint64(spread)).astype(np.int64), run, np.arange(len(v)), (v, CLASS), (sizes, SIZE))

    return docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(tidied(of), "f int, run bigint, data binary")


def _shared(parts: int, spread: int):
    """Of one fragment: the n-grams found in two documents or more, under their number of documents, to their batches; of
    one part of the directory: its documents, with how often their class was sent at the first, 0 at the others."""

    def of(key: tuple, group: pa.Table) -> pa.Table:
        f = key[0].as_py()
        found = _told(group) if f >= parts + spread else _shared_of(group, f >= parts)
        give_back()
        return found

    return of


def _shared_of(group: pa.Table, heavy: bool) -> pa.Table:
    row, place, h = unpacked(group.column("data"), HASH)
    if heavy:
        seen = np.full(len(h), TOP, np.uint64)
    else:
        order = np.argsort(h, kind="stable")
        lengths = np.diff(np.append(_starts(h[order]), len(h)))
        seen = np.empty(len(h), np.uint64)
        seen[order] = np.repeat(lengths, lengths).astype(np.uint64)
    keep = seen > 1
    keys = (np.minimum(seen, np.uint64(TOP)) << np.uint64(BITS) | h)[keep]
    row, place = row[keep], place[keep]
    starts = _starts(row)
    return _to_runs(group, row[starts], False, packed(starts, place, (keys, KEY)))


def _told(group: pa.Table) -> pa.Table:
    row, place, v, n = unpacked(group.column("data"), CLASS, SIZE)
    run = group.column("run").to_numpy()[row]
    order = np.lexsort((place, run, v))
    first = _starts(v[order])
    sent = np.zeros(len(v), np.int64)
    sent[order[first]] = np.minimum(np.diff(np.append(first, len(v))), TOP)
    starts = _starts(row)
    return _to_runs(group, row[starts], True, packed(starts, place, (v, CLASS), (n, SIZE), (sent, COUNT)))


def _to_runs(group: pa.Table, rows: np.ndarray, told: bool, data: pa.Array) -> pa.Table:
    return pa.table([pa.array(group.column("run").to_numpy()[rows]), pa.array(np.full(len(rows), told)), data], names=["run", "told", "data"])


def _whole(percent: int):
    """One batch: the classes that its documents stand for, and their shared n-grams from all fragments, rarest first,
    where enough are left."""

    def of(group: pa.Table) -> pa.Table:
        told = group.column("told")
        _, place, v, n, sent = unpacked(group.filter(told).column("data"), CLASS, SIZE, COUNT)
        _, owner, keys = unpacked(group.filter(pc.invert(told)).column("data"), KEY)
        order = np.argsort(place)
        if not np.array_equal(place[order], np.arange(len(place))) or owner.max(initial=-1) >= len(place):
            raise ValueError("a repeated task had its documents in another order; write them to a table first")
        v, n, sent = v[order].view(np.int64), n[order].astype(np.int64), sent[order]
        seen = keys >> np.uint64(BITS)
        elsewhere = (sent[owner] > 0) & ((seen > sent[owner]) | (seen == TOP))
        owner, keys = owner[elsewhere], keys[elsewhere]
        count = np.bincount(owner, minlength=len(v))
        good = (count > 0) & (count * 100 >= n * percent)
        use = good[owner]
        owner, keys = owner[use], keys[use].view(np.int64)
        keys = keys[np.lexsort((keys, owner))]
        offsets = pa.array(np.concatenate([[0], np.cumsum(count[good])]).astype(np.int32))
        found = pa.table({"v": pa.array(v[good]), "n": pa.array(n[good]), "keys": pa.ListArray.from_arrays(offsets, pa.array(keys))})
        give_back()
        return found

    return of


def active_sets(cut_sets: DataFrame, percent: int, parts: int, spread: int) -> DataFrame:
    """(v, n, keys): each class's shared n-grams, rarest first, if they are at least ``percent`` of its set."""
    shared = cut_sets.groupBy("f").applyInArrow(_shared(parts, spread), "run bigint, told boolean, data binary")
    return shared.groupBy("run").applyInArrow(_whole(percent), "v bigint, n bigint, keys array<bigint>")


def prefix_index(sets: DataFrame, percent: int) -> DataFrame:
    """(key, v, n, pos, r): the shared n-grams of each class's prefix, their positions, and a fixed number in [0, 1)."""
    alone = F.col("n") - F.size("keys")
    prefix = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    r = F.shiftrightunsigned(F.xxhash64("v"), 11) / F.lit(float(1 << 53))
    found = sets.select("v", "n", r.alias("r"), alone.alias("alone"), F.posexplode(F.slice("keys", F.lit(1), F.greatest(F.lit(0), prefix - alone).cast("int"))).alias("i", "key"))
    return found.select("key", "v", "n", (F.col("alone") + F.col("i")).alias("pos"), "r")


def _possible(n1: Column, pos1: Column, n2: Column, pos2: Column, percent: int) -> Column:
    """Sizes and positions allow the similarity if this is the first n-gram that two prefixes share."""
    sizes = 100 * F.least(n1, n2) >= percent * F.greatest(n1, n2)
    return sizes & ((100 + percent) * F.least(n1 - pos1, n2 - pos2) >= percent * (n1 + n2))


def overlaps(pairs: DataFrame, sets: DataFrame, cuts: int) -> DataFrame:
    """(a, b, na, nb, common): partial overlaps of each fragment of the n-gram order, summed per pair."""
    part = F.explode(F.sequence(F.lit(0), F.lit(cuts - 1))).alias("part")
    width = (1 << BITS) // cuts + 1
    of_key = lambda x: F.floor(x.bitwiseAND(F.lit((1 << BITS) - 1)) / F.lit(width)).cast("int")
    segments = sets.select("v", "n", "keys", part).select("v", "n", "part", F.filter("keys", lambda x: of_key(x) == F.col("part")).alias("seg"))
    at_b = segments.select(F.col("v").alias("b"), F.col("n").alias("nb"), "part", F.col("seg").alias("seg_b"))
    at_a = segments.select(F.col("v").alias("a"), F.col("n").alias("na"), "part", F.col("seg").alias("seg_a"))
    joined = pairs.select("a", "b", part).join(at_b, ["b", "part"]).join(at_a, ["a", "part"])
    return joined.groupBy("a", "b").agg(F.first("na").alias("na"), F.first("nb").alias("nb"), F.sum(F.size(F.array_intersect("seg_a", "seg_b"))).alias("common"))


def link(sets: DataFrame, percent: int, cuts: int = 4, pivots: int = 8) -> DataFrame:
    """(node, label): components of the classes under the exact similarity; classes without a link are left out."""
    index = prefix_index(sets, percent)
    size = index.groupBy("key").agg(F.count("*").alias("size"), F.min(F.struct("pos", "v", "n")).alias("p")).where("size > 1")
    index = first_index = cut(index.join(size, "key"))

    def verified(pairs: DataFrame) -> DataFrame:
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        return overlaps(pairs, sets, cuts).where(100 * F.col("common") >= percent * (F.col("na") + F.col("nb") - F.col("common"))).select("a", "b")

    first = index.where(F.col("v") != F.col("p.v")).where(_possible(F.col("n"), F.col("pos"), F.col("p.n"), F.col("p.pos"), percent))
    links = cut(verified(first.select(F.col("p.v").alias("a"), F.col("v").alias("b"))))
    index, label = index.drop("p"), None
    low, high = 0, pivots
    while True:
        if label is None:
            label = components(links)
            placed = index.join(label, index.v == label.node, "left").select("key", "v", "n", "pos", "r", "size", F.coalesce("label", "v").alias("c"))
            split = placed.groupBy("key").agg(F.min("c").alias("least"), F.max("c").alias("most")).where("least <> most").select("key")
            placed = cut(placed.join(split, "key"))
        most = placed.agg(F.max("size")).first()[0]
        if most is None or most <= low:
            discard(sets.sparkSession, first_index, placed)
            return label
        rank = F.col("r") * F.col("size")
        x = placed.where((rank >= low) & (rank < high)).select("key", *[F.col(c).alias(f"x_{c}") for c in ("v", "n", "pos", "r", "c")])
        found = x.join(placed.where(F.col("size") > low), "key").where((F.col("c") != F.col("x_c")) & ((F.col("r") > F.col("x_r")) | (F.col("r") == F.col("x_r")) & (F.col("v") > F.col("x_v"))))
        found = found.where(_possible(F.col("n"), F.col("pos"), F.col("x_n"), F.col("x_pos"), percent))
        more = cut(verified(found.select(F.col("x_v").alias("a"), F.col("v").alias("b"))))
        if more.limit(1).count():
            links, label = links.union(more), None
        low, high = high, high * 64


def _labels(docs: DataFrame, text_col: str, n: int, percent: int, total: int, salt: int, heavy: np.ndarray) -> DataFrame:
    parts, spread = sizes_of(total)
    sets = cut(active_sets(fragments(docs, text_col, n, parts, spread, salt, heavy), percent, parts, spread))
    label = link(sets, percent)
    discard(docs.sparkSession, sets)
    return label


def survivors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 4, percent: int = 85) -> DataFrame:
    """One row of each component, chosen by class and not by id: the least id, null ids last, equal ids by a hash of the
    row. A row without n-grams is linked with nothing and stays; of several with its id and text (null like any other) one."""
    small_batches(docs.sparkSession)
    row, name = free_name(docs, "__row"), free_name(docs, "__kept")
    # One durable copy of the rows, so that the numbers given to them hold.
    numbered = cut(docs.withColumn(row, F.monotonically_increasing_id()))
    text = F.col(text_col)
    keyed = numbered.select(F.col(row).alias("row"), F.col(id_col).alias("id"), F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]).alias("h"), F.xxhash64(text.isNull(), text).alias("t"), text.cast("string").alias("text"))
    keyed, heavy, total, salt = classes(keyed, f"row bigint, id {keyed.schema['id'].dataType.simpleString()}, h bigint, t bigint", n)
    label = _labels(numbered, text_col, n, percent, total, salt, heavy)
    order = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "h", "row")).alias("m")
    of_class = keyed.where("n > 0").groupBy("v").agg(order)
    linked = of_class.join(label, F.col("v") == F.col("node"), "left").groupBy(F.coalesce("label", "v").alias("c")).agg(F.min("m").alias("m"))
    bare = keyed.where("n = 0").groupBy("id", "t").agg(F.min("row").alias(name))
    kept = linked.select(F.col("m.row").alias(name)).unionByName(bare.select(name))
    return numbered.join(kept, F.col(row) == F.col(name), "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 4, percent: int = 85) -> DataFrame:
    """(id, n_shingles, component_id) of every row: n-word shingles, sets linked from ``percent`` similarity on."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    rows, heavy, total, salt = classes(rows, f"id {rows.schema['id'].dataType.simpleString()}", n)
    label = _labels(docs, text_col, n, percent, total, salt, heavy)
    named = rows.where("n > 0").groupBy("v").agg(F.min("id").alias("least"), F.count("*").alias("size"))
    named = cut(named.join(label, named.v == label.node, "left").select("v", "least", "size", F.coalesce("label", "v").alias("c")))
    n_classes, n_rows = named.agg(F.count("*"), F.sum("size")).first()
    component = named.groupBy("c").agg(F.min("least").alias("component_id"), F.count("*").alias("many"))
    named = hub_join(named, component, "c", F.col("many") > max(64, n_classes // 1000)).select("v", "component_id", "size")
    empty = rows.where("n = 0").select("id", F.col("n").alias("n_shingles"), F.col("id").alias("component_id"))
    return hub_join(rows.where("n > 0"), named, "v", F.col("size") > max(1000, (n_rows or 0) // 1000)).select("id", F.col("n").alias("n_shingles"), "component_id").unionByName(empty)
