"""The persisted search index: chunks, block-max postings, term statistics and vectors, brought up to date from changes.

All tables lie in one ``Store``, so what a synchronisation adds counts as a whole or not at all. A commit adds the chunks of
the originals that changed, and for what they replace only marks (``dead``) and negative statistics: nothing is rewritten
until ``compact``.

Chunks are dealt into blocks of about ``PER_BLOCK``, chunks of similar length together, and numbered inside. The files of chunks
have whole blocks one after the other, so a block is inverted where it is read. A posting row is one term in one block, with
the highest count and the least length in it: an upper bound of what the term can add to any chunk there. Its entries are
packed; a text is moved once, its postings once, in parts whose number grows with the text and not with a setting. A query reads these bounds first, scores the ``FIRST`` best blocks, and then only those whose bound reaches the
last of the hits so far; the others cannot hold a better one. Postings and statistics are filed by a hash of the term, so
only the files of the query's terms are opened; frequent terms are spread over several files.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import asdict, dataclass
from functools import reduce
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import stable_id, tokens
from ..sources.store import Corrupt, Store, latest
from . import retrieval as R
from .knowledge import embedded

#: The store's format and how postings lie in it, chunks in a block and for a term file, blocks scored first, bytes of text in
#: a block and in a part that chunks are dealt to, blocks and ties that the driver may hold, and the processor that cuts chunks.
VERSION, LAYOUT, PER_BLOCK, PER_FILE, FIRST = 2, 2, 512, 1024, 8
BLOCK_BYTES, PART_BYTES = 16 << 20, 32 << 20
BLOCKS, TIES = 1000, 200
CHUNKER, CHUNKER_VERSION = "retrieval-chunks", "1"
IDENTITY = ("chunk_id", "observation_id", "evidence_id", "selector", "text", "producer")
CHUNK = "original_id string, chunk_id string, observation_id string, evidence_id string, selector string, text string, producer string"
TABLES = {
    "chunks": f"{CHUNK}, block bigint, ord int",
    "originals": "original_id string, n_chunks bigint, digest string, live boolean",
    "postings": "term string, block bigint, max_tf int, min_len int, n_docs bigint, n_occurrences bigint, entries binary",
    "terms": "term string, n_docs bigint, n_occurrences bigint",
    "dead": "of bigint, block bigint, ord int",
    "vectors": "chunk_id string, embedding array<float>",
    "plan": "original_id string, n_chunks bigint, digest string, action string",
}
HIT = "chunk_id string, score double, rank int"


def chunk_id(observation: Column, evidence: Column, part: Column) -> Column:
    return stable_id("chunk", F.to_json(F.struct(evidence.alias("evidence"), observation.alias("observation"), part.alias("part"), F.lit(CHUNKER).alias("processor"), F.lit(CHUNKER_VERSION).alias("version"))))


def source_digests(chunks: DataFrame) -> DataFrame:
    """(original_id, n_chunks, digest): SHA-256 of the hashes of the original's chunk identities, by id. Texts are hashed before
    the shuffle; an original has at most 8 MiB, which bounds its chunks."""
    ordered = F.array_sort(F.collect_list(F.struct("chunk_id", F.sha2(F.to_json(F.struct(*IDENTITY)), 256).alias("identity"))))
    per = chunks.groupBy("original_id").agg(F.count("*").alias("n_chunks"), ordered.alias("c"))
    return per.select("original_id", "n_chunks", F.sha2(F.array_join(F.transform("c", lambda x: x["identity"]), "\n"), 256).alias("digest"))


def chunk_actions(stored: DataFrame, wanted: DataFrame) -> DataFrame:
    """(original_id, action): keep, replace, insert or delete, from both sides' (original_id, n_chunks, digest)."""
    return _planned(stored, wanted).select("original_id", "action")


def _planned(stored: DataFrame, wanted: DataFrame) -> DataFrame:
    a = stored.select("original_id", F.col("n_chunks").alias("_n"), F.col("digest").alias("_digest"))
    same = (F.col("_n") == F.col("n_chunks")) & (F.col("_digest") == F.col("digest"))
    action = F.when(F.col("digest").isNull(), "delete").when(F.col("_digest").isNull(), "insert").when(same, "keep").otherwise("replace")
    return a.join(wanted, "original_id", "full_outer").select("original_id", "n_chunks", "digest", action.alias("action"))


def without_sources(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """Chunks, postings or vectors that are left once their originals (original_id) are deleted."""
    return rows.join(gone.select("original_id").distinct(), "original_id", "left_anti")


@dataclass(frozen=True)
class Model:
    """What vectors were made by."""

    model_id: str
    revision: str
    dimensions: int


def embedding_plan(chunks: DataFrame, vectors: DataFrame, stored: Model | None, model: Model | None) -> tuple[str, DataFrame]:
    """State and the chunks to embed: none without a model, all after a change of model, else those without a vector."""
    if model is None:
        return "unavailable", chunks.limit(0)
    if stored != model:
        return "rebuilding", chunks
    return "rebuilding", R.missing_embeddings(chunks, vectors)


def sized(chunks: DataFrame) -> DataFrame:
    """Chunks with ``n_bytes`` of their text, told before a join so that lengths alone can be counted behind it."""
    return chunks.withColumn("n_bytes", F.octet_length(F.coalesce("text", F.lit(""))))


def located(chunks: DataFrame) -> DataFrame:
    """Sized chunks with ``block`` and ``ord``, their number in the block by id; whole blocks one after the other."""
    length = F.floor(4 * F.log2(F.col("n_bytes") + 1)).cast("int")  # four for each doubling
    sizes = {r["c"]: r for r in chunks.groupBy(length.alias("c")).agg(F.count("*").alias("n"), F.sum("n_bytes").alias("bytes")).collect()}
    if not sizes:
        return chunks.withColumns({"block": F.lit(0).cast("bigint"), "ord": F.lit(0)})
    blocks = F.element_at(F.create_map(*[F.lit(x) for c, r in sizes.items() for x in (c, math.ceil(max(r["n"] / PER_BLOCK, r["bytes"] / BLOCK_BYTES)))]), length)
    block = F.shiftleft(length.cast("bigint"), 40) + F.pmod(F.xxhash64("chunk_id"), blocks)
    parts = math.ceil(sum(r["bytes"] for r in sizes.values()) / PART_BYTES)
    dealt = chunks.withColumn("block", block).repartition(max(1, parts), "block")
    return dealt.withColumn("ord", F.row_number().over(Window.partitionBy("block").orderBy("chunk_id")))


def postings(chunks: DataFrame) -> DataFrame:
    """Posting rows of located chunks as they were written. Each task inverts the blocks that it reads, one at a time; should a
    block lie in two tasks, its terms have a row from either."""
    return chunks.select("block", "ord", tokens(F.coalesce("text", F.lit(""))).alias("w")).mapInArrow(_by_block, TABLES["postings"])


def _by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, now = [], None
    for batch in batches:
        block = batch.column("block").to_numpy()
        for a, b in pairwise([0, *(np.flatnonzero(np.diff(block)) + 1), len(block)] if len(block) else []):
            if held and block[a] != now:
                yield _inverted(pa.Table.from_batches(held))
                held = []
            held.append(batch.slice(a, b - a))
            now = block[a]
    if held:
        yield _inverted(pa.Table.from_batches(held))


def _inverted(table: pa.Table) -> pa.RecordBatch:
    """The posting rows of one block. ``entries`` of a row are (ord, n, tf) of each chunk, then all its places: numbers of 16
    bits if the block's fit, else of 32."""
    table = table.combine_chunks()
    words = table["w"].combine_chunks()
    length = np.diff(words.offsets.to_numpy())
    coded = words.flatten().dictionary_encode()
    chunk = np.repeat(np.arange(len(length)), length)
    place = np.arange(len(chunk)) - np.repeat(np.cumsum(length) - length, length)
    code = coded.indices.to_numpy()
    order = np.argsort(code, kind="stable")  # by term, then chunk, then place
    code, chunk = code[order], chunk[order]
    new = np.ones(len(code), bool)
    new[1:] = (code[1:] != code[:-1]) | (chunk[1:] != chunk[:-1])
    entry = np.flatnonzero(new)
    code, chunk, times = code[entry], chunk[entry], np.diff(np.append(entry, len(order)))
    first = np.flatnonzero(np.append(True, code[1:] != code[:-1])[: len(code)])
    each = lambda f, x: f.reduceat(x, first) if len(first) else x[:0]
    n_docs, n_occurrences, number = np.diff(np.append(first, len(code))), each(np.add, times), table["ord"].to_numpy()
    kind = np.uint16 if max(length.max(initial=0), number.max(initial=0)) < 1 << 16 else np.uint32
    packed = np.empty(3 * len(code) + len(order), kind)
    before = np.cumsum(n_occurrences) - n_occurrences  # places of the rows above
    at = 3 * np.arange(len(code)) + np.repeat(before, n_docs)
    packed[at], packed[at + 1], packed[at + 2] = number[chunk], length[chunk], times
    packed[np.arange(len(order)) + 3 * np.repeat(np.cumsum(n_docs), n_occurrences)] = place[order]
    ends = kind().itemsize * np.cumsum(3 * n_docs + n_occurrences)
    entries = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(np.append(0, ends).astype(np.int32)), pa.py_buffer(packed)])
    columns = {
        "term": coded.dictionary.take(pa.array(code[first])), "block": pa.array([table["block"][0].as_py()] * len(first), pa.int64()), "max_tf": pa.array(each(np.maximum, times), pa.int32()),
        "min_len": pa.array(each(np.minimum, length[chunk]), pa.int32()), "n_docs": pa.array(n_docs, pa.int64()), "n_occurrences": pa.array(n_occurrences, pa.int64()), "entries": entries,
    }
    return pa.RecordBatch.from_pydict(columns)


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(of, block, term, ord, n, at) of posting rows (of, block, term, n_docs, n_occurrences, entries)."""
    for batch in batches:
        for of, block, term, docs, occurrences, packed in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            x = np.frombuffer(packed, np.uint16 if len(packed) == 2 * (3 * docs + occurrences) else np.uint32).astype(np.int32)
            number, length, times = x[: 3 * docs].reshape(docs, 3).T
            at = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(times)), pa.int32()), pa.array(x[3 * docs :]))
            same = [pa.array([of] * docs, pa.int64()), pa.array([block] * docs, pa.int64()), pa.array([term] * docs)]
            yield pa.RecordBatch.from_arrays([*same, pa.array(number), pa.array(length), at], names=["of", "block", "term", "ord", "n", "at"])


def term_counts(chunks: DataFrame) -> DataFrame:
    """(term, n_docs, n_occurrences) of stored chunks with their text."""
    at = ["_version", "block", "ord"]
    words = chunks.select(*at, F.explode(tokens(F.coalesce("text", F.lit("")))).alias("term"))
    return words.groupBy("term", *at).agg(F.count("*").alias("n")).groupBy("term").agg(F.count("*").alias("n_docs"), F.sum("n").alias("n_occurrences"))


class SearchIndex:
    """An index under ``path``, a folder that driver and executors share. ``chunks`` gives all chunks for a rebuild, should
    a file of the index be found damaged."""

    CHUNK = CHUNK

    def __init__(self, spark: SparkSession, path: str, chunks: Callable[[], DataFrame] | None = None):
        self.spark, self.path, self.all_chunks = spark, path.rstrip("/"), chunks
        self.store = Store(spark, path, TABLES, VERSION)

    # What is in force.

    def outdated(self) -> bool:
        """Whether the postings were written in another layout than this code reads; ``sync`` and ``recover`` build anew."""
        return bool(self.store.folders("postings")) and self.store.facts().get("layout") != LAYOUT

    def originals(self, upto: int | None = None) -> DataFrame:
        """(original_id, n_chunks, digest, of): the originals in force, and the commit that has their chunks."""
        now = latest(self.store.read("originals", upto=upto), "original_id")
        return now.where("live").select("original_id", "n_chunks", "digest", F.col("_version").alias("of"))

    def _live(self) -> DataFrame:
        """Chunk rows in force, with their place and commit."""
        now = self.originals().select("original_id", F.col("of").alias("_version"))
        return self.store.read("chunks").join(now, ["original_id", "_version"], "left_semi")

    def chunks(self) -> DataFrame:
        return self._live().select(*[c.split()[0] for c in CHUNK.split(", ")])

    def changes(self, since: int = 0) -> DataFrame:
        """(original_id, action): what all commits after ``since`` did together; reads no text."""
        now = latest(self.store.read("originals", since), "original_id").select("original_id", "live")
        before = self.originals(upto=since).select("original_id", F.lit(True).alias("_was")) if since else now.select("original_id", F.lit(None).cast("boolean").alias("_was")).limit(0)
        action = F.when(F.col("live"), F.when(F.col("_was"), "replace").otherwise("insert")).when(F.col("_was"), "delete")
        return now.join(before, "original_id", "left").select("original_id", action.alias("action")).where("action is not null")

    def counts(self) -> DataFrame:
        """One row: originals, chunks and tokens in force, kept additively by the commits."""
        facts = self.store.facts()
        return self.spark.range(1).select(*[F.lit(int(facts.get(n, 0))).cast("bigint").alias(n) for n in ("n_sources", "n_chunks", "n_tokens")])

    # Changes.

    def sync(self, chunks: DataFrame, version: str | None = None) -> DataFrame:
        """Bring the index to ``chunks``, all there are (the columns of ``CHUNK``); returns the action for each original.

        ``version`` names the state of the input: if the index was last brought to the same one, no text is read. Without it
        every original costs its digest, written once; only changed ones are cut into terms.
        """
        if self.store.damaged() or self.outdated():
            self.store.quarantine()
        if version is not None and self.store.facts().get("input") == version:
            return self.originals().select("original_id", F.lit("keep").alias("action"))
        after = self.store.version()
        told = _planned(self.originals(), source_digests(chunks))
        plan = self.store.staged("plan", self.store.stage("plan", told))
        facts = {} if version is None else {"input": version}
        changed = plan.where("action <> 'keep'")
        if not changed.isEmpty():
            fresh = sized(chunks)
            if not plan.where("action = 'keep'").isEmpty():  # else all there are
                fresh = fresh.join(changed.where("action <> 'delete'").select("original_id"), "original_id", "left_semi")
            self._commit(after, fresh, changed.select("original_id"), changed.where("action <> 'delete'").select("original_id", "digest"), facts)
        elif facts:
            self.store.commit({}, after, facts)
        return plan.select("original_id", "action")

    def put(self, chunks: DataFrame, original_ids: DataFrame) -> None:
        """The chunks of some originals (original_id) in place of what the index has of them; no other text is read."""
        ids = original_ids.select("original_id").distinct()
        self._commit(self.store.version(), sized(chunks).join(ids, "original_id", "left_semi"), ids, None, {"input": None})

    def delete(self, original_ids: DataFrame) -> None:
        """Drop originals (original_id) with all their chunks, postings and vectors."""
        none = sized(self.spark.createDataFrame([], CHUNK))
        self._commit(self.store.version(), none, original_ids.select("original_id").distinct(), None, {"input": None})

    def _commit(self, after: int, fresh: DataFrame, touched: DataFrame, digests: DataFrame | None, facts: dict, anew: bool = False) -> None:
        """One commit: new chunks, sized, and what the originals touched had until now no longer counts."""
        if self.outdated():
            raise Corrupt(f"{self.path} is of another layout; synchronise it to build it anew")
        store, v = self.store, after + 1
        parts = {"chunks": [store.stage("chunks", located(fresh))]}
        added = store.staged("chunks", parts["chunks"][0], v)
        if digests is None:
            digests = source_digests(added).select("original_id", "digest")
        new = added.groupBy("original_id").agg(F.count("*").alias("n_chunks")).join(digests, "original_id").withColumn("live", F.lit(True))
        old = self.originals() if not anew else self.originals().limit(0)
        gone = old.join(touched, "original_id", "left_semi")
        ended = gone.select("original_id").join(new.select("original_id"), "original_id", "left_anti")
        ended = ended.select("original_id", F.lit(0).cast("bigint").alias("n_chunks"), F.lit("").alias("digest"), F.lit(False).alias("live"))
        parts["originals"] = [store.stage("originals", new.unionByName(ended))]
        sums = lambda df: df.agg(*[F.coalesce(x, F.lit(0)).cast("bigint").alias(n) for n, x in (("n_sources", F.count("*")), ("n_chunks", F.sum("n_chunks")))]).first().asDict()
        plus, minus = sums(store.staged("originals", parts["originals"][0], v).where("live")), sums(gone)
        facts_now = store.facts()
        before = {} if anew else facts_now
        totals = {n: int(before.get(n, 0)) + plus[n] - minus[n] for n in plus}
        parts["postings"] = [self._by_term("postings", postings(added), plus["n_chunks"])]
        # The same postings in sum, so no text is cut twice.
        counts = store.staged("postings", parts["postings"][0], v).groupBy("term").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_occurrences").alias("n_occurrences"))
        if minus["n_chunks"]:
            left = store.read("chunks").join(gone.select("original_id", F.col("of").alias("_version")), ["original_id", "_version"], "left_semi")
            parts["dead"] = [store.stage("dead", left.select(F.col("_version").alias("of"), "block", "ord"))]
            less = term_counts(left).select("term", (-F.col("n_docs")).alias("n_docs"), (-F.col("n_occurrences")).alias("n_occurrences"))
            both = counts.unionByName(less).groupBy("term").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_occurrences").alias("n_occurrences"))
            counts = both.where("n_docs <> 0 or n_occurrences <> 0")
        parts["terms"] = [self._by_term("terms", counts, plus["n_chunks"])]
        more = store.staged("terms", parts["terms"][0], v).agg(F.coalesce(F.sum("n_occurrences"), F.lit(0))).first()[0]
        totals["n_tokens"] = int(before.get("n_tokens", 0)) + int(more)
        if anew and (model := self.model()) is not None:
            parts["vectors"] = [store.stage("vectors", self.vectors())]
            whole = R.missing_embeddings(self._live(), self.vectors()).isEmpty()
            facts = facts | {"embedded": v if whole else 0, "model": asdict(model)}
        store.commit(parts, after, totals | {"layout": LAYOUT} | facts, [t for t in TABLES if t != "plan"] if anew else [])

    def _by_term(self, table: str, rows: DataFrame, n_chunks: int) -> dict:
        """Stage rows in files by a hash of their term; posting rows of one term also by block."""
        files = max(1, math.ceil(n_chunks / PER_FILE))
        spread = math.ceil(math.sqrt(files)) if table == "postings" else 1
        buckets = math.ceil(files / spread)
        slot = F.pmod(F.xxhash64("term"), F.lit(buckets)) * spread
        if spread > 1:
            slot = slot + F.pmod(F.xxhash64("block"), F.lit(spread))
        dealt = rows.repartitionById(buckets * spread, slot.cast("int")).sortWithinPartitions("term")
        return self.store.stage(table, dealt, {"parquet.block.size": str(8 << 20), "parquet.page.size": str(64 << 10)}) | {"buckets": buckets, "spread": spread}

    def compact(self) -> None:
        """Write what lives as one commit without the marks and negative statistics of the past, and delete what went."""
        if self.store.version():
            self._commit(self.store.version(), sized(self.chunks()), self.originals().select("original_id"), self.originals().select("original_id", "digest"), {}, anew=True)
            self.store.vacuum(1)

    # Reading terms.

    def _of_terms(self, table: str, terms: Sequence[str]) -> DataFrame:
        """A table's rows of some terms, from the files that can have them."""
        hashes = [xxhash.xxh64_intdigest(t.encode(), 42) for t in terms]  # as Spark's, but unsigned
        folders = []
        for f in self.store.folders(table):
            slots = {(h - (1 << 64) if h >> 63 else h) % f["buckets"] for h in hashes}
            keep = {n: s for n, s in f["files"].items() if int(re.match(r"part-(\d+)", n)[1]) // f["spread"] in slots}
            folders.append(f | {"files": keep})
        return self.store.read(table, of=folders).where(F.col("term").isin(*terms))

    def term_statistics(self) -> DataFrame:
        """(term, n_docs_with, n_occurrences) for every term in force: the sum of what commits added and took."""
        found = self.store.read("terms").groupBy("term").agg(F.sum("n_docs").alias("n_docs_with"), F.sum("n_occurrences").alias("n_occurrences"))
        return found.where("n_docs_with > 0")

    def _scored(self, blocks: DataFrame, wanted: list[list[str]]) -> DataFrame:
        """(of, block, ord, n, tf): chunks in force of these blocks (of, block) that have one of the phrases' words."""
        terms = sorted({w for p in wanted for w in p})
        rows = self._of_terms("postings", terms).withColumnRenamed("_version", "of").join(blocks, ["of", "block"], "left_semi")
        rows = rows.select("of", "block", "term", "n_docs", "n_occurrences", "entries").mapInArrow(_entries, "of bigint, block bigint, term string, ord int, n int, at array<int>")
        if self.store.folders("dead"):
            rows = rows.join(self.store.read("dead").select("of", "block", "ord"), ["of", "block", "ord"], "left_anti")
        by_term = F.map_from_entries(F.collect_list(F.struct("term", "at")))  # at most as many as the query has terms
        per = rows.groupBy("of", "block", "ord", "n").agg(by_term.alias("at"))
        return per.select("of", "block", "ord", "n", F.explode(F.array(F.array(*[_starts(F.col("at"), p) for p in wanted]))).alias("tf"))

    def bounds(self, wanted: list[list[str]], idf: Sequence[float], mean: float) -> DataFrame:
        """(of, block, bound): the most that any chunk of a block can score. Only the bounds' columns are read."""
        terms = sorted({w for p in wanted for w in p})
        heads = self._of_terms("postings", terms).groupBy(F.col("_version").alias("of"), "block", "term").agg(F.max("max_tf").alias("max_tf"), F.min("min_len").alias("min_len"))
        per = heads.select("of", "block", "term", F.struct("max_tf", "min_len").alias("m")).groupBy("of", "block").agg(F.map_from_entries(F.collect_list(F.struct("term", "m"))).alias("m"))
        most = F.lit(0.0)
        for p, weight in zip(wanted, idf, strict=True):
            at = [F.try_element_at("m", F.lit(w)) for w in dict.fromkeys(p)]
            tf, length = reduce(F.least, [a["max_tf"] for a in at]) if len(at) > 1 else at[0]["max_tf"], reduce(F.greatest, [a["min_len"] for a in at]) if len(at) > 1 else at[0]["min_len"]
            every = reduce(lambda x, y: x & y, [a.isNotNull() for a in at])
            most = most + F.when(every, weight * tf * (R.K1 + 1) / (tf + R.K1 * (1 - R.B + R.B * length / mean))).otherwise(0.0)
        return per.select("of", "block", most.alias("bound")).where("bound > 0")

    def lexical(self, query: str, limit: int = R.MOST) -> DataFrame:
        """(chunk_id, score, rank) by BM25, from the blocks that can hold a hit."""
        return self.lexical_search(query, limit)[0]

    def lexical_search(self, query: str, limit: int = R.MOST) -> tuple[DataFrame, int]:
        """The hits, and how many blocks were scored for them."""
        wanted, facts = R.phrases(query), self.store.facts()
        n = int(facts.get("n_chunks", 0))
        if not wanted or not n:
            return self.spark.createDataFrame([], HIT), 0
        mean = facts["n_tokens"] / n or 1.0
        df = self._document_counts(wanted)
        if not any(df):
            return self.spark.createDataFrame([], HIT), 0
        idf = [max(R.LEAST_IDF, math.log((n - d + 0.5) / (d + 0.5))) for d in df]
        bounds = self.bounds(wanted, idf, mean)
        heads = bounds.orderBy(F.desc("bound"), "of", "block").limit(BLOCKS + 1).collect()
        first = self._listed(heads[:FIRST])
        best = self._top(first, wanted, df, n, mean, limit)
        reach = -best[limit - 1][0] - 1e-8 if len(best) >= limit else 0.0  # an equal score may win by its id
        if len(heads) <= BLOCKS:
            chosen = [r for r in heads[FIRST:] if r["bound"] >= reach]
            rest, more = self._listed(chosen), len(chosen)
        else:
            rest = bounds.where(F.col("bound") >= reach).select("of", "block").join(first, ["of", "block"], "left_anti")
            more = rest.count()
        if more:
            best = sorted(best + self._top(rest, wanted, df, n, mean, limit))
        return self.spark.createDataFrame([(c, x, k) for k, (x, c) in enumerate(best[:limit], 1)], HIT), len(heads[:FIRST]) + more

    def _listed(self, blocks: list) -> DataFrame:
        return F.broadcast(self.spark.createDataFrame([(r["of"], r["block"]) for r in blocks], "of bigint, block bigint"))

    def _document_counts(self, wanted: list[list[str]]) -> list[int]:
        """Chunks that have each phrase: of single words from the statistics, of others from the blocks that have all its words."""
        single = sorted({p[0] for p in wanted if len(p) == 1})
        told = {}
        if single:
            sums = self._of_terms("terms", single).groupBy("term").agg(F.sum("n_docs").alias("n")).collect()
            told = {(r["term"],): int(r["n"]) for r in sums}
        for p in {tuple(p) for p in wanted if len(p) > 1}:
            blocks = self.bounds([list(p)], [1.0], 1.0).select("of", "block")
            told[p] = self._scored(blocks, [list(p)]).where(F.get("tf", F.lit(0)) > 0).count()
        return [told.get(tuple(p), 0) for p in wanted]

    def _top(self, blocks: DataFrame, wanted: list[list[str]], df: Sequence[int], n: int, mean: float, limit: int) -> list[tuple[float, str]]:
        """(score, chunk_id) of the best hits of some blocks, ties by id."""
        score = F.round(R.bm25(F.col("tf"), F.col("n"), df, n, mean), 9)
        rows = self._scored(blocks, wanted).where(F.exists("tf", lambda x: x > 0)).select("of", "block", "ord", score.alias("score"))
        got = rows.orderBy("score").limit(limit + TIES).collect()
        if not got:
            return []
        last = got[min(limit, len(got)) - 1]["score"]  # the ids decide among equals
        named = self.store.read("chunks").select(F.col("_version").alias("of"), "block", "ord", "chunk_id")
        if len(got) < limit + TIES or got[-1]["score"] > last:
            kept = [r for r in got if r["score"] <= last]
            hits = F.broadcast(self.spark.createDataFrame(kept, "of bigint, block bigint, ord int, score double"))
            named = named.where(F.col("block").isin(*{r["block"] for r in kept}))
        else:
            hits = rows.where(F.col("score") <= last)
        top = named.join(hits, ["of", "block", "ord"]).orderBy("score", "chunk_id").limit(limit).collect()
        return [(r["score"], r["chunk_id"]) for r in top]

    # Vectors.

    def model(self) -> Model | None:
        told = self.store.facts().get("model")
        return Model(**told) if told else None

    def vectors(self) -> DataFrame:
        """(chunk_id, embedding) of the model that the index last used, of chunks in force: a vector that is older than its
        chunk doesn't count."""
        if self.model() is None:
            return self.spark.createDataFrame([], "chunk_id string, embedding array<float>")
        now = self._live().select("chunk_id", F.col("_version").alias("of"))
        return latest(self.store.read("vectors"), "chunk_id").join(now, "chunk_id").where("_version >= of").select("chunk_id", "embedding")

    def sync_embeddings(self, model: Model | None, embed: Callable[[pd.Series], list[list[float]]] | None) -> str:
        """Add the vectors that are missing, all of them under a new model; the state afterwards.

        Chunks are those of the commits since the vectors were last complete, so a change costs what it changed. A batch is a
        commit of its own and never overwrites another.
        """
        if model is None or embed is None:
            return "unavailable"
        same, after = self.model() == model, self.store.version()
        since = int(self.store.facts().get("embedded", 0)) if same else 0
        wanted = self._live().where(F.col("_version") > since).select("chunk_id", "text")
        if same:
            wanted = embedding_plan(wanted, self.vectors(), model, model)[1]
        n = wanted.count()
        if not n and same:
            if since < after:
                self.store.add({}, {"embedded": after})
            return "ready"
        part = self.store.stage("vectors", embedded(wanted, embed, model.dimensions))
        done = self.store.staged("vectors", part).count() == n
        facts = {"model": asdict(model), "embedded": after if done else since}
        if same:
            self.store.add({"vectors": [part]}, facts)
        else:
            self.store.commit({"vectors": [part]}, after, facts, ["vectors"])
        return "ready" if done else "failed"

    # Search.

    def search(self, query: str, limit: int | None = None, embed: Callable[[str], list[float]] | None = None) -> DataFrame:
        """Fused hits with the chunks' own columns; lexical alone where there are no vectors or the query cannot be embedded.
        An index that is found damaged is put aside and built anew, never answered from in part."""
        query, limit = R.check_request(query, limit)
        try:
            return self._found(query, limit, embed)
        except (PySparkException, Py4JJavaError):
            if not self.recover():
                raise
            return self._found(query, limit, embed)

    def recover(self) -> bool:
        """Put a damaged index aside and build it anew from all chunks; whether it was damaged."""
        if not self.store.damaged() and not self.outdated() and not self.store.unreadable():
            return False
        if self.all_chunks is None:
            raise Corrupt(f"{self.path} is damaged; synchronise it to build it anew")
        self.store.quarantine()
        self.sync(self.all_chunks())
        return True

    def _found(self, query: str, limit: int, embed: Callable[[str], list[float]] | None) -> DataFrame:
        by_text, vector = self.lexical(query, R.fetch(limit)), None
        if embed is not None and self.model() is not None:
            try:
                vector = embed(query)
            except Exception:  # noqa: BLE001  a model that fails leaves the search lexical
                vector = None
        by_vector = by_text.limit(0).select("chunk_id", F.lit(0.0).alias("distance"), "rank") if vector is None else R.nearest(self.vectors(), vector, R.fetch(limit))
        hits = R.fuse(by_text, by_vector, limit).collect()  # at most 50
        fused = self.spark.createDataFrame(hits, "chunk_id string, lexical_rank int, lexical_score double, semantic_rank int, semantic_distance double, score double, rank int")
        return self.chunks().where(F.col("chunk_id").isin(*[h["chunk_id"] for h in hits])).join(F.broadcast(fused), "chunk_id")


def fingerprint(spark: SparkSession, df: DataFrame) -> str:
    """The state of a table's files: their names, sizes and times of change. Asks the file system, reads nothing."""
    told = []
    for name in sorted(df.inputFiles()):
        p = spark._jvm.org.apache.hadoop.fs.Path(name)
        s = p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p)
        told.append((name, int(s.getLen()), int(s.getModificationTime())))
    return hashlib.sha256(json.dumps(told).encode()).hexdigest()


def _starts(at: Column, phrase: list[str]) -> Column:
    """Places where a phrase starts, from the places of its words."""
    empty = F.array().cast("array<int>")
    places = [F.coalesce(F.try_element_at(at, F.lit(w)), empty) for w in phrase]
    found = places[0]
    for k, more in enumerate(places[1:], 1):
        found = F.array_intersect(found, _minus(more, k))
    return F.size(found)


def _minus(places: Column, k: int) -> Column:
    return F.transform(places, lambda p: p - k)
