"""Periodic runs of words: every maximal stretch that repeats itself, with its smallest period.

A run of period q has at least max(12 - q, q) places in a row whose word equals the one q places on. So the number of equal
pairs at each lag is counted first, exactly: words that are frequent in the document by FFT autocorrelation of their
indicators (their power spectra are summed, one inverse transform gives all), rare ones by the differences of their places.
Only a lag with enough pairs gets a scan for islands of equal pairs, and each island that is long enough is a run.

Two rules keep a lag from a needless scan without losing a run. Pairs that lie inside a run whose period divides the lag
don't count for it: a run of period q that shares q words with one of a period dividing q has that smaller period itself, so
no pair is in both, and two such runs share fewer than q words. And an island holds a multiple of its least length, so a lag
without matches around such places has none.

Defined results: a null or empty text has no words and no runs. Every row is judged on its own, repeated ids too. A row
without an id is never extended. Only the id and the text are read. Memory follows the longest text.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import small_batches

#: The least length of a run in words, and places on each side that are tried before a lag is scanned.
LEAST, NEAR = 12, 32
SCHEMA = "doc_id bigint, n_words bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string"


def matches_by_lag(ids: np.ndarray) -> np.ndarray:
    """How many places i have ids[i] == ids[i + q], for q from 0 to len(ids) // 2."""
    n = len(ids)
    most, sizes = n // 2, np.bincount(ids)
    limit = int(np.sqrt(n * np.log2(n)))  # pairs of a rare word cost its square, a frequent one a transform
    total = np.zeros(most + 1, np.int64)
    heavy = np.flatnonzero(sizes > limit)
    if len(heavy):
        size = 1 << int(n + most).bit_length()
        power = np.zeros(size // 2 + 1)
        for w in heavy:
            spectrum = np.fft.rfft((ids == w).astype(np.float64), size)
            power += spectrum.real**2 + spectrum.imag**2
        total += np.rint(np.fft.irfft(power, size)[: most + 1]).astype(np.int64)
    light = np.flatnonzero((sizes[ids] <= limit) & (sizes[ids] > 1))
    if len(light):
        place = light[np.lexsort((light, ids[light], -sizes[ids[light]]))]  # by word, most frequent first
        word, left = ids[place], np.cumsum(np.bincount(sizes[ids[light]])[::-1])[::-1]
        waiting: list[np.ndarray] = []
        for k in range(1, len(left) - 1):
            m = int(left[k + 1])  # rows of words that occur more than k times
            waiting.append((place[k:m] - place[: m - k])[word[k:m] == word[: m - k]])
            if k == len(left) - 2 or sum(map(len, waiting)) > 1 << 20:
                far = np.concatenate(waiting)
                total += np.bincount(far[far <= most], minlength=most + 1)
                waiting = []
    return total


def _may_hold(ids: np.ndarray, lag: int, least: int) -> bool:
    """Whether some multiple of ``least`` has matches around it, as far as ``NEAR`` places tell."""
    pairs = len(ids) - lag
    at = np.arange(0, pairs, least)
    at = at[ids[at] == ids[at + lag]]
    if not len(at):
        return False
    need, reach = min(least, NEAR), np.ones(len(at), np.int64)
    for step in (1, -1):
        live = np.arange(len(at))
        for k in range(1, NEAR):
            to = at[live] + step * k
            inside = (to >= 0) & (to < pairs)
            live, to = live[inside], to[inside]
            equal = ids[to] == ids[to + lag]
            live = live[equal]
            if not len(live):
                break
            reach[live] += 1
    return bool((reach >= need).any())


def runs(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start, then period."""
    n = len(ids)
    if n < LEAST:
        return []
    counts = matches_by_lag(ids)
    lags = np.arange(len(counts))
    needs = np.maximum(LEAST - lags, lags)
    found: list[tuple[int, int, int]] = []
    seen: set[tuple[int, int]] = set()
    for q in np.flatnonzero(counts >= needs).tolist():
        need = int(needs[q])
        if not q or counts[q] < need or n - q < need or not _may_hold(ids, q, need):  # a longer run may have taken its pairs
            continue
        equal = np.zeros(n - q + 2, np.int8)
        equal[1:-1] = ids[q:] == ids[:-q]
        edges = np.diff(equal)
        starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        long = ends - starts >= need
        for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True):
            if (a, b + q) in seen:  # of a smaller period
                continue
            seen.add((a, b + q))
            length = b + q - a
            found.append((a, length, q))
            multiples = np.arange(2 * q, min(length, len(counts)), q)
            counts[multiples] -= length - multiples
    return sorted(found, key=lambda r: (r[0], r[2]))


def extended(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The document's words, their end made periodic for one id in ten."""
    n, h = len(words), 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    unit = words[a : a + p]
    return words[:a] + (unit * ((n - a) // p + 1))[: n - a]


def described(doc_id: int | None, text: str | None) -> tuple:
    """One row of ``SCHEMA``; words are split at blank, tab, \\n, \\v, \\f and \\r, as ``bytes.split`` does."""
    words = extended((text or "").encode().split(), doc_id)
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int32, len(words))
    found = runs(ids)
    dropped = bytearray(len(words))
    for start, length, period in found:
        dropped[start + period : start + length] = b"\1" * (length - period)
    kept = b" ".join([w for w, gone in zip(words, dropped, strict=True) if not gone]) if found else b" ".join(words)
    listed = "".join(f"{a},{b},{c}\n" for a, b, c in found).encode()
    start, length, period = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None, None, None)
    milli = 1000 * length // period if found else None
    return doc_id, len(words), len(found), start, length, period, milli, hashlib.sha256(listed).hexdigest(), hashlib.sha256(kept).hexdigest()


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``SCHEMA`` a document, from one scan without a shuffle."""
    small_batches(docs.sparkSession)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [described(i, t.as_py()) for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True)]
            kinds = [pa.int64()] * 7 + [pa.string()] * 2
            names = [c.split()[0] for c in SCHEMA.split(", ")]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return docs.select(docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(of, SCHEMA)
