"""Packing by lexical retrieval: a sharded BM25 inverted index fills each seed document's window with its neighbours.

1. ``tokenize``: ids of every whole text by a public tokenizer, then the end id; each task counts its documents with
   each id on the way.
2. ``term_statistics``: documents with each id, over all documents. There are as many numbers as the vocabulary has ids.
3. ``content_order``: a document's BM25 weights are projected to ``SKETCH`` numbers. A tree of median cuts along the main
   direction of a bounded sample's sketches puts like texts in like leaves; every document of the corpus is sent down it.
4. ``pack``: runs of leaves are dealt into shards, their number from the corpus's documents and tokens, wherever the
   documents are stored; a leaf larger than a shard is spread over several. A shard has at most ``shard_docs`` documents
   and about ``shard_tokens`` tokens. It has its own inverted index, with BM25 weights from the corpus statistics. Full windows
   of a long document come first; then the next unused piece is the seed, its neighbours are taken in order of their
   scores until the window is full, and the last is cut: its rest is the next seed. Only a shard's last window can stay
   open; it is cut at powers of two. So no sequence needs padding.

Defined results: a null or empty text has the end id alone. Repeated rows are packed each. A table without rows gives
no pieces. Sequence ids are unique, not consecutive. Other columns are ignored.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import cut, small_batches, tidied
from .words import in_runs

WINDOW, END = 2048, 1
#: Fixed value: where a byte-level vocabulary cuts a text before its merges, in a form that never looks back.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
_coders: dict[str, Coder] = {}
#: Numbers of a document's sketch, documents of the tree's sample, and those of a leaf. Shards are dealt to this share of
#: their bounds, so that a sample's error seldom cuts a small rest off.
SKETCH, SAMPLE, LEAF, FILL = 64, 1 << 14, 16, 0.8


def _byte_ranks(spec: dict) -> dict[bytes, int] | None:
    """Bytes of each id of a tokenizer file whose ids are the order of its byte merges; None for any other file."""
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    plain = model.get("type") == "BPE" and spec.get("normalizer") is None and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    if not plain or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
        return None
    # The byte-level alphabet: printable bytes stand for themselves, the others for the characters from 256 on.
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    byte_of = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}
    special = {t["content"] for t in spec.get("added_tokens", [])}
    ranks = {bytes(byte_of[c] for c in token): k for token, k in model["vocab"].items() if token not in special}
    merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    single = sum(len(token) == 1 for token in ranks)
    in_order = single == 256 and all(model["vocab"].get(a + b) == single + k for k, (a, b) in enumerate(merges))
    return ranks if in_order and len(ranks) == single + len(merges) else None


class Coder:
    """Ids of texts by a tokenizer file, exactly as its own library gives them, strings of added tokens included.

    A byte-level vocabulary in the order of its merges is applied by the library that is faster for those; its ids are
    the same. Any other file is applied by its own library.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        spec = json.loads(Path(path).read_text(encoding="utf-8"))
        ranks = _byte_ranks(spec)
        added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        if ranks is not None and not any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in spec.get("added_tokens", [])):
            self.fast, self.slow = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=added), None
            size = self.fast.n_vocab
        else:
            self.fast, self.slow = None, Tokenizer.from_file(path)
            size = self.slow.get_vocab_size()
        self.kind = np.uint16 if size <= 1 << 16 else np.uint32

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text, then the end id."""
        try:
            plain = texts.to_pylist()
        except UnicodeDecodeError:  # bytes that are no UTF-8, as a cast from binary can leave them
            plain = [None if t is None else t.decode("utf-8", "replace") for t in texts.cast(pa.binary()).to_pylist()]
        out = []
        for text in plain:
            if not text:
                ids = ()
            elif self.fast is not None:
                ids = self.fast.encode_to_numpy(text, allowed_special="all")
            else:
                ids = self.slow.encode(text, add_special_tokens=False).ids
            row = np.empty(len(ids) + 1, self.kind)
            row[:-1], row[-1] = ids, END
            out.append(row)
        return out


def tokenize(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", counted: bool = False) -> DataFrame:
    """(doc_id, n, ids): ids packed as unsigned 16- or 32-bit numbers, as the vocabulary asks.

    With ``counted`` each task adds one row of ``n`` -1 whose ``ids`` are its numbers of documents with each id, packed as
    64-bit numbers: as many as the vocabulary has ids.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer not in _coders:
            _coders[tokenizer] = Coder(tokenizer)
        coder, kind, seen, mark = _coders[tokenizer], None, np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        for batch in batches:
            kind = batch.column(0).type
            for first, texts in in_runs(batch.column(1)):
                found = coder.encode(texts)
                for ids in found if counted else ():
                    if (top := int(ids.max()) + 1) > len(seen):
                        seen, mark = np.append(seen, np.zeros(top, np.int64)), np.zeros(len(seen) + top, np.int64)
                    turn = np.arange(len(ids))
                    mark[ids] = turn  # the last place of each id stays, whatever was there
                    seen[ids[mark[ids] == turn]] += 1
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), pa.array([len(x) for x in found], pa.int64()), pa.array([x.tobytes() for x in found], pa.binary())], names=["doc_id", "n", "ids"])
        if counted and kind is not None:
            yield pa.RecordBatch.from_arrays([pa.nulls(1, kind), pa.array([-1], pa.int64()), pa.array([np.trim_zeros(seen, "b").tobytes()], pa.binary())], names=["doc_id", "n", "ids"])

    return rows.mapInArrow(tidied(of), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n bigint, ids binary")


def _ids(row: bytes, n: int) -> np.ndarray:
    return np.frombuffer(row, np.uint16 if len(row) == 2 * n else np.uint32).astype(np.uint32)


def term_statistics(counts: DataFrame, tokens: DataFrame) -> tuple[np.ndarray, int, float]:
    """Documents with each id, number of documents, mean length, from the tasks' counts: bounded by the vocabulary."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(0, np.int64)
        for batch in batches:
            for row in batch.column(0):
                part = np.frombuffer(row.as_buffer(), np.int64)
                df = np.append(df, np.zeros(max(0, len(part) - len(df)), np.int64))
                df[: len(part)] += part
        term = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(term), pa.array(df[term])], names=["term", "docs"])

    summed = counts.select("ids").mapInArrow(tidied(of), "term bigint, docs bigint").groupBy("term").agg(F.sum("docs").alias("docs")).collect()
    docs, mean = tokens.agg(F.count("*"), F.avg("n")).first()
    df = np.zeros(max((r["term"] for r in summed), default=0) + 1, np.int64)
    for r in summed:
        df[r["term"]] = r["docs"]
    return df, docs, float(mean or 1.0)


def sketches(tokens: list[np.ndarray], idf: np.ndarray, mean: float, k1: float = 1.2, b: float = 0.75) -> np.ndarray:
    """Unit vectors: the BM25 weights of each document's terms by fixed random signs."""
    key = (len(idf), SKETCH)
    if key not in _signs:
        _signs[key] = np.random.default_rng(7).choice(np.array([-1, 1], np.float32), key)
    out = np.zeros((len(tokens), SKETCH), np.float32)
    for i, ids in enumerate(tokens):
        term, tf = np.unique(ids, return_counts=True)
        weight = idf[term] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len(ids) / mean))
        out[i] = weight.astype(np.float32) @ _signs[key][term]
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


_signs: dict[tuple[int, int], np.ndarray] = {}


class Tree:
    """Median cuts along the main direction of a sample's sketches, to one depth; leaves are numbered in their order."""

    def __init__(self, sample: np.ndarray, leaf: int = LEAF):
        self.depth = max(0, int(np.ceil(np.log2(max(len(sample), 1) / leaf))))
        self.direction, self.bound = np.zeros(((1 << self.depth) - 1, SKETCH), np.float32), np.zeros((1 << self.depth) - 1, np.float32)
        rows = [np.arange(len(sample))]
        for level in range(self.depth):
            below = []
            for k, at in enumerate(rows):
                node, right = (1 << level) - 1 + k, np.zeros(len(at), bool)
                if len(at) > 1:
                    x = sample[at] - sample[at].mean(axis=0)
                    main = x[np.argmax((x**2).sum(axis=1))]
                    for _ in range(6):
                        main = x.T @ (x @ main)
                        main = main / max(float(np.linalg.norm(main)), 1e-12)
                    self.direction[node] = main
                    along = self._along(sample[at], np.full(len(at), node))
                    self.bound[node] = np.median(along)
                    right = along > self.bound[node]
                below += [at[~right], at[right]]
            rows = below

    def _along(self, x: np.ndarray, node: np.ndarray) -> np.ndarray:
        return (x * self.direction[node]).sum(axis=1)

    def leaves(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + (self._along(x, node) > self.bound[node])
        return node - ((1 << self.depth) - 1)


def content_order(tokens: DataFrame, idf: np.ndarray, n_docs: int, mean: float, shards: int) -> DataFrame:
    """``tokens`` with their leaf and the shard, of about ``shards``, that its run of leaves belongs to."""
    spark = tokens.sparkSession
    shared = spark.sparkContext.broadcast(idf)  # one number per id of the vocabulary
    of_rows = lambda batch: [_ids(row, n) for n, row in zip(batch.column("n").to_pylist(), batch.column("ids").to_pylist(), strict=True)]

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = sketches(of_rows(batch), shared.value, mean)
            yield pa.RecordBatch.from_arrays([batch.column("n"), pa.array([r.tobytes() for r in x], pa.binary())], names=["n", "x"])

    u = F.shiftrightunsigned(F.xxhash64("doc_id", "ids"), 11) / F.lit(float(1 << 53))
    # At most 2 * SAMPLE sketches come to the driver: they only place the cuts, every document is dealt by them.
    sample = tokens.where(u < SAMPLE / max(n_docs, 1)).select("n", "ids").mapInArrow(tidied(sampled), "n bigint, x binary").limit(2 * SAMPLE).collect()
    x = np.frombuffer(b"".join(r["x"] for r in sample), np.float32).reshape(-1, SKETCH)
    tree = Tree(x[np.lexsort(x.T)])
    # A leaf's size in shards, by documents or tokens, whichever fill a shard first; leaves in order, one after the other.
    leaf, n = tree.leaves(x), np.array([r["n"] for r in sample], float)
    size = np.maximum(np.bincount(leaf, minlength=1 << tree.depth) / max(len(n), 1), np.bincount(leaf, n, 1 << tree.depth) / max(n.sum(), 1.0))
    size = size / max(size.sum(), 1e-9) * shards
    at = np.cumsum(size) - size
    plan = spark.sparkContext.broadcast((tree, at, size))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, at, size = plan.value
        for batch in batches:
            leaf = tree.leaves(sketches(of_rows(batch), shared.value, mean))
            by = batch.column("u").to_numpy(zero_copy_only=False)
            shard = np.where(size[leaf] >= 1, at[leaf] + by * size[leaf], at[leaf] + size[leaf] / 2).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("doc_id", "n", "ids", "u")], pa.array(leaf), pa.array(shard)], names=["doc_id", "n", "ids", "u", "leaf", "shard"])

    kind = tokens.schema["doc_id"].dataType.simpleString()
    return tokens.withColumn("u", u).mapInArrow(tidied(dealt), f"doc_id {kind}, n bigint, ids binary, u double, leaf bigint, shard bigint")


def _ranked(score: np.ndarray, count: int, first: int = 64) -> Iterator[int]:
    """The ``count`` places of the greatest scores, greatest first and equal ones in their order; most are never asked for."""
    done = 0
    if count > first:
        least = np.partition(score, len(score) - first)[len(score) - first]
        top = np.flatnonzero(score >= least)
        top = top[np.argsort(-score[top], kind="stable")]
        done = min(len(top), count)
        yield from top[:done].tolist()
    yield from np.argsort(-score, kind="stable")[done:count].tolist()


class Shard:
    """An inverted index over the documents of a shard and the greedy filling of windows from it."""

    def __init__(self, tokens: list[np.ndarray], idf: np.ndarray, mean: float, k1: float = 1.2, b: float = 0.75):
        self.tokens, self.n = tokens, np.array([len(t) for t in tokens])
        # One number for each token, (term, document), as narrow as it can be and sorted in place: it is the largest array here.
        many = len(tokens)
        key = np.empty(int(self.n.sum()), np.uint32 if len(idf) * many < 1 << 32 else np.uint64)
        at = 0
        for d, ids in enumerate(tokens):
            np.multiply(ids, many, out=key[at : at + len(ids)], dtype=key.dtype, casting="unsafe")
            key[at : at + len(ids)] += key.dtype.type(d)
            at += len(ids)
        key.sort()
        new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])).astype(np.int32)
        tf, key = np.diff(np.append(new, np.int32(len(key)))), key[new]
        term = (key // key.dtype.type(many)).astype(np.int32)
        use = idf[term] > 0
        term, tf, self.doc = term[use], tf[use], (key[use] % key.dtype.type(many)).astype(np.int32)
        del key, new, use
        self.weight = idf[term] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * self.n[self.doc] / mean))
        new = np.concatenate([[True], term[1:] != term[:-1]]) if len(term) else np.empty(0, bool)
        self.list_of = np.cumsum(new, dtype=np.int32) - np.int32(1)
        order = np.argsort(self.doc, kind="stable")
        self.terms = np.split(self.list_of[order], np.cumsum(np.bincount(self.doc, minlength=many))[:-1])
        self.left = many
        self._bound(int(new.sum()))

    def _bound(self, lists: int) -> None:
        ends = np.cumsum(np.bincount(self.list_of, minlength=lists))
        self.bounds = np.concatenate([[0], ends]).tolist()

    def forget(self, unused: np.ndarray) -> None:
        """Drop the postings of used documents once a fifth of those that are left have been used: no score is asked of them."""
        now = int(unused.sum())
        if now <= 0.8 * self.left:
            keep = unused[self.doc]
            self.doc, self.weight, self.list_of, self.left = self.doc[keep], self.weight[keep], self.list_of[keep], now
            self._bound(len(self.bounds) - 1)

    def scores(self, doc: int) -> np.ndarray:
        """BM25 of every document that was not dropped for the terms of ``doc``."""
        b = self.bounds
        parts = [slice(b[k], b[k + 1]) for k in self.terms[doc].tolist()]
        if not parts:
            return np.zeros(len(self.tokens))
        return np.bincount(np.concatenate([self.doc[p] for p in parts]), np.concatenate([self.weight[p] for p in parts]), minlength=len(self.tokens))

    def windows(self, window: int) -> Iterator[list[tuple[int, int, int]]]:
        """Pieces (document, start, length) of each sequence."""
        at = np.zeros(len(self.n), np.int64)
        for d in np.flatnonzero(self.n >= window).tolist():
            while self.n[d] - at[d] >= window:
                yield [(d, int(at[d]), window)]
                at[d] += window
        unused = at < self.n
        seed, first = -1, 0
        while True:
            if seed < 0:
                while first < len(self.n) and not unused[first]:
                    first += 1
                if first == len(self.n):
                    return
                seed = first
            pieces, room, take, turn = [], window, seed, None
            seed = -1
            score_of = take
            while True:
                length = int(min(self.n[take] - at[take], room))
                pieces.append((take, int(at[take]), length))
                at[take] += length
                room -= length
                if at[take] == self.n[take]:
                    unused[take] = False
                if room == 0:
                    if unused[take]:
                        seed = take
                    break
                if turn is None:
                    self.forget(unused)
                    s = np.where(unused, self.scores(score_of), -1.0)
                    turn = _ranked(s, int(unused.sum()))
                take = next(turn, -1)
                if take < 0:
                    break
            if room == 0:
                yield pieces
                continue
            yield from _cut_open(pieces, window - room)
            return


def _cut_open(pieces: list[tuple[int, int, int]], filled: int) -> Iterator[list[tuple[int, int, int]]]:
    """The last, open window as sequences of powers of two."""
    left, size = list(pieces), 1 << (filled.bit_length() - 1)
    while left:
        while size > sum(p[2] for p in left):
            size >>= 1
        out, room = [], size
        while room:
            d, at, length = left.pop(0)
            out.append((d, at, min(length, room)))
            if length > room:
                left.insert(0, (d, at + room, length - room))
            room -= min(length, room)
        yield out


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, shard_docs: int = 4096, shard_tokens: int = 1 << 22) -> DataFrame:
    """(doc_id, start, length, doc_tokens, sequence_id, offset, ids): every piece with its ids, packed little-endian
    unsigned 32-bit numbers."""
    written = cut(tokenize(docs, tokenizer, id_col, text_col, counted=True))
    tokens = written.where("n >= 0")
    df, n_docs, mean = term_statistics(written.where("n < 0"), tokens)
    idf = np.maximum(0.0, np.log((n_docs - df + 0.5) / (df + 0.5)))
    shared = docs.sparkSession.sparkContext.broadcast(idf)  # one number per id of the vocabulary

    def packed(ids: list, tokens_of: list[np.ndarray], kind: pa.DataType, number: int) -> tuple[pa.RecordBatch, int]:
        shard, rows = Shard(tokens_of, shared.value, mean), []
        for pieces in shard.windows(window):
            offset = 0
            for d, start, length in pieces:
                rows.append((d, start, length, len(tokens_of[d]), number, offset, tokens_of[d][start : start + length].tobytes()))
                offset += length
            number += 1
        d, *rest, raw = zip(*rows, strict=True)
        arrays = [pa.array([ids[k] for k in d], kind), *[pa.array(c, pa.int64()) for c in rest], pa.array(raw, pa.binary())]
        return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]), number

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, ids, held, size, now = TaskContext.get().partitionId() << 40, [], [], 0, None
        kind = pa.null()
        for batch in batches:
            kind = batch.column(0).type
            for doc_id, n, row, shard in zip(*[batch.column(k).to_pylist() for k in range(4)], strict=True):
                if ids and (shard != now or len(ids) >= shard_docs or size >= shard_tokens):
                    out, number = packed(ids, held, kind, number)
                    yield out
                    ids, held, size = [], [], 0
                ids.append(doc_id)
                held.append(_ids(row, n))
                size, now = size + n, shard
        if ids:
            yield packed(ids, held, kind, number)[0]

    kind = tokens.schema["doc_id"].dataType.simpleString()
    shards = max(1, int(np.ceil(max(n_docs / shard_docs, n_docs * mean / shard_tokens) / FILL)))
    ordered = content_order(tokens, idf, n_docs, mean, shards).repartition(shards, "shard").sortWithinPartitions("shard", "leaf", "u")
    return ordered.select("doc_id", "n", "ids", "shard").mapInArrow(tidied(of), f"doc_id {kind}, start bigint, length bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary")


def digest(pieces: DataFrame) -> DataFrame:
    """Pieces with the crc32 of their ids in place of the ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
