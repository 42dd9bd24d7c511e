"""Words of Arrow text batches as arrays: 64-bit hashes from prefix sums over the bytes, with no loop over words.

A word is a run of bytes other than blank, tab, \\n, \\v, \\f and \\r; A-Z count as a-z. Texts are taken whole, in runs of
documents of about ``RUN`` bytes; a longer text is hashed in pieces cut at blanks, so memory follows its words.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

RUN = 1 << 18
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[[32, 9, 10, 11, 12, 13]] = False


@dataclass
class Words:
    """Words of ``n_docs`` documents from row ``first`` of the batch on."""

    first: int
    n_docs: int
    doc: np.ndarray  # each word's document, counted from ``first``
    hash: np.ndarray  # uint64
    prefix: dict[int, np.ndarray]  # by length in bytes: the hash of that prefix, 0 for shorter words


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: A random number for each place in a word and byte there; places beyond the table make theirs when they occur.
_PLACES = 64
_TABLE = mix(np.arange(1, _PLACES * 256 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _numbers(place: np.ndarray, byte: np.ndarray) -> np.ndarray:
    """The random number of each (place, byte): words hash to their sum, so two words agree with probability 2^-64."""
    out = _TABLE[(np.minimum(place, _PLACES - 1) << 8) | byte]
    far = np.flatnonzero(place >= _PLACES)
    if len(far):
        out[far] = mix(((place[far].astype(np.uint64) << np.uint64(8) | byte[far]) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    return out


def _hashed(data: np.ndarray, cuts: np.ndarray, prefixes: Sequence[int]) -> tuple[np.ndarray, np.ndarray, dict[int, np.ndarray]]:
    """Start and hash of each word of ``data``; no word crosses a position of ``cuts``."""
    is_word = _IS_WORD[data]
    new = np.empty(len(data), bool)
    new[0] = True
    np.logical_not(is_word[:-1], out=new[1:])
    new[cuts] = True
    ends_here = np.empty(len(data), bool)
    ends_here[-1] = True
    ends_here[:-1] = new[1:] | ~is_word[1:]
    starts, ends = np.flatnonzero(is_word & new), np.flatnonzero(is_word & ends_here) + 1
    size = ends - starts
    if not len(starts):
        none = np.empty(0, np.uint64)
        return np.empty(0, np.int64), none, {k: none for k in prefixes}
    first = np.cumsum(size) - size
    place = np.arange(int(size.sum()), dtype=np.int32) - np.repeat(first.astype(np.int32), size)
    sums = np.zeros(len(place) + 1, np.uint64)
    np.cumsum(_numbers(place, _LOWER[data[is_word]]), out=sums[1:])
    at_start = sums[first]
    upto = lambda n: mix(sums[first + n] - at_start + n.astype(np.uint64))
    found = {k: np.where(size >= k, upto(np.minimum(size, k)), np.uint64(0)) for k in prefixes}
    return starts, upto(size), found


def in_runs(texts: pa.Array, run: int = RUN) -> Iterator[tuple[int, pa.Array]]:
    """Slices of a text column of about ``run`` bytes, with their first row; a longer text is a slice of its own."""
    ends, first = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)), 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + run, "right")))
        yield first, texts.slice(first, last - first)
        first = last


def runs_of_words(texts: pa.Array, prefixes: Sequence[int] = ()) -> Iterator[Words]:
    """The words of every text of the batch, null texts having none, in runs of whole documents."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None and texts.buffers()[2].size else np.empty(0, np.uint8)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + RUN, "right")) - 1)
        last = min(last, first + 65_000)
        low, high = int(offsets[first]), int(offsets[last])
        ends = offsets[first + 1 : last + 1] - low
        parts, at = [], low
        while at < high:
            to = high
            if high - at > 2 * RUN:  # one long text: cut at the last blank of the piece, or after its one word
                blanks = np.flatnonzero(~_IS_WORD[data[at : at + RUN]])
                to = at + int(blanks[-1]) + 1 if len(blanks) else at + RUN
                while not len(blanks) and to < high and _IS_WORD[data[to - 1]]:
                    to += 1
            inner = ends[:-1] + low
            parts.append((at - low, *_hashed(data[at:to], inner[(inner > at) & (inner < to)] - at, prefixes)))
            at = to
        starts = np.concatenate([s + at for at, s, _, _ in parts]) if parts else np.empty(0, np.int64)
        hashes = np.concatenate([h for _, _, h, _ in parts]) if parts else np.empty(0, np.uint64)
        found = {k: np.concatenate([p[k] for *_, p in parts]) if parts else np.empty(0, np.uint64) for k in prefixes}
        yield Words(first, last - first, np.searchsorted(ends, starts, "right"), hashes, found)
        first = last
