"""Secrets in texts: fixed patterns, and values in a credential's place that would be hard to guess.

The base kinds are patterns (``assign``, ``access``, ``hex``). The method looks at every value that follows a credential's
name and a colon or an equals sign, of any length and with any marks, and finds by dynamic programming the cheapest way to
put it together from words, dates, repeats, keyboard walks and single characters tried by force. The cost is in bits: the
logarithm of the guesses that this way takes. A value that costs ``BITS`` or more is a secret (kind ``guess``), ``changeme``
or ``2024-01-01`` is not. A value that overlaps a base span is not told again.

Words are those of the texts themselves, values in a credential's place left out: a word of frequency f costs -log2 f bits,
if f is at least 2 ** -``RARE``. At most 2 ** ``RARE`` words can be that frequent, which bounds what is broadcast, whatever
the corpus holds. Segments are: one character; a word, also with capitals or digits and marks for letters; a date of 6 or 8
digits, or of three numbers with separators; a unit of at most ``UNIT`` characters as often as it goes on from its place
(three characters or more); a walk over at least three keys, each beside the one before, as far as it goes. A value that is
one plain word (letters alone, not of mixed case) is prose as likely as a secret and is left to the base kinds.

Defined results: a null or empty text has no spans. Places are code points, ends exclusive. Rows are judged on their own,
repeated ids too; an empty table gives no rows. Texts and values are taken whole, in time linear in their length. Only the
id and the text are read.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, small_batches

#: The base patterns, with their least lengths, in the order of kinds.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
KINDS = ("assign", "access", "hex", "guess")
#: The places where a credential's value stands: more names, and any value without blanks or quotes.
NAMES = r"password|passwd|passphrase|passcode|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credentials?"
CONTEXT = rf"""({NAMES})["']?\x20*[:=]\x20*["']?([^\x00-\x20"'`,;<>(){{}}\[\]|]+)"""
_ASSIGN, _CONTEXT = (re.compile(p, re.IGNORECASE | re.ASCII) for p in (ASSIGN, CONTEXT))
_ACCESS, _HEX = re.compile(r"AKIA[A-Z0-9]{14,}"), re.compile(r"[0-9a-f]{16,}")
#: For whole batches: texts in which one of the patterns may match.
MAY_HOLD = rf"(?i)({NAMES})[\"']?\x20*[:=]|AKIA[A-Z0-9]{{14}}|[0-9a-f]{{16}}"

#: Bits from which a value is hard to guess, the least frequency of a word, the longest word and unit of a repeat.
BITS, RARE, WORD, UNIT = 40.0, 18, 24, 16
#: Rows of keys on a keyboard with the shifted marks, and digits or marks that stand for letters.
ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
SHIFTED = ("~!@#$%^&*()_+", "QWERTYUIOP{}|", 'ASDFGHJKL:"', "ZXCVBNM<>?")
LETTER_FOR = str.maketrans("@4301!$57", "aaeoiisst")
_PLACE = {c: (x + y / 2, y) for rows in (ROWS, SHIFTED) for y, row in enumerate(rows) for x, c in enumerate(row)}
_DATE = re.compile(r"\d{1,4}([-/._])\d{1,2}\1\d{1,4}", re.ASCII)


def spans_of(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base kinds, leftmost and without overlaps within a kind."""
    found = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


def single(c: str) -> float:
    """Bits of one character tried by force."""
    if c.isascii():
        return math.log2(10 if c.isdigit() else 26 if c.isalpha() else 33) + c.isupper()
    return 8.0


def word_bits(word: str, bits: dict[str, float]) -> float | None:
    """Bits of a word as written: its own, one for any capitals, one for any letter written as a digit or mark."""
    small = word.lower()
    best = bits.get(small)
    plain = small.translate(LETTER_FOR)
    if plain != small and (other := bits.get(plain)) is not None and (best is None or other + 1 < best):
        best = other + 1
    return None if best is None else best + (word != small)


def beside(a: str, b: str) -> bool:
    p, q = _PLACE.get(a), _PLACE.get(b)
    return p is not None and q is not None and p != q and abs(p[0] - q[0]) <= 1 and abs(p[1] - q[1]) <= 1


def is_date(s: str) -> bool:
    """Whether the numbers can be a day, a month and a year in some order that is in use."""
    parts = [s[:4], s[4:6], s[6:]] if len(s) == 8 and s.isdigit() else None
    orders = [parts] if parts else []
    if len(s) == 8 and s.isdigit():
        orders.append([s[4:], s[2:4], s[:2]])
        orders.append([s[4:], s[:2], s[2:4]])
    elif len(s) == 6 and s.isdigit():
        orders += [[s[:2], s[2:4], s[4:]], [s[4:], s[2:4], s[:2]], [s[4:], s[:2], s[2:4]]]
    else:
        a, b, c = re.split(r"\D", s)
        orders += [[a, b, c], [c, b, a], [c, a, b]]
    return any((len(y) == 2 or 1900 <= int(y) <= 2099) and 1 <= int(m) <= 12 and 1 <= int(d) <= 31 for y, m, d in orders)


def words_and_dates(value: str, i: int, bits: dict[str, float]) -> Iterator[tuple[int, float]]:
    """(end, bits) of the words and dates that start at ``i``."""
    for j in range(i + 3, min(len(value), i + WORD) + 1):
        if (cost := word_bits(value[i:j], bits)) is not None:
            yield j, cost
    for size in (6, 8):
        part = value[i : i + size]
        if len(part) == size and part.isascii() and part.isdigit() and is_date(part):
            yield i + size, math.log2(365 * 100)
    if (m := _DATE.match(value, i)) and is_date(m[0]):
        yield m.end(), math.log2(365 * 100) + 2


def walks(value: str) -> list[tuple[int, int]]:
    """(keys, turns) of the walk that starts at each place; the first step is a turn."""
    out, way = [(1, 0)] * len(value), None
    for i in range(len(value) - 2, -1, -1):
        if not beside(value[i], value[i + 1]):
            way = None
            continue
        (ax, ay), (bx, by) = _PLACE[value[i]], _PLACE[value[i + 1]]
        step, (keys, turns) = (bx - ax, by - ay), out[i + 1]
        out[i], way = (keys + 1, turns + (step != way)), step
    return out


def repeats(value: str) -> list[list[int]]:
    """For each unit's size, how often the unit at each place goes on."""
    n, out = len(value), [[]]
    for size in range(1, min(UNIT, n // 2) + 1):
        same, times = 0, [1] * n
        for i in range(n - size - 1, -1, -1):
            same = same + 1 if value[i] == value[i + size] else 0
            times[i] = 1 + same // size
        out.append(times)
    return out


def guess_bits(value: str, bits: dict[str, float], units: dict[str, float] | None = None) -> float:
    """The least sum of bits over all ways to cut the value into segments, from left to right; ``units`` has what repeated
    units cost, once each."""
    n, walk, times, units = len(value), walks(value), repeats(value), {} if units is None else units
    best = [0.0] + [math.inf] * n
    for i in range(n):
        best[i + 1] = min(best[i + 1], best[i] + single(value[i]))
        for j, cost in words_and_dates(value, i, bits):
            best[j] = min(best[j], best[i] + cost)
        keys, turns = walk[i]
        if keys >= 3:
            best[i + keys] = min(best[i + keys], best[i] + math.log2(len(_PLACE)) + math.log2(keys) + 2.5 * turns)
        for size in range(1, len(times)):
            if (k := times[size][i]) > 1 and k * size >= 3:
                unit = value[i : i + size]
                if unit not in units:
                    units[unit] = guess_bits(unit, bits, units) if size > 1 else single(unit)
                best[i + k * size] = min(best[i + k * size], best[i] + units[unit] + math.log2(k))
    return best[n]


def is_plain_word(value: str) -> bool:
    return value.isalpha() and value in (value.lower(), value.upper(), value.capitalize())


def word_frequencies(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, bits) of every word of three letters or more that is frequent enough, from all texts.

    Words are counted in the tasks before they are shuffled; values in a credential's place are no text. The least share of a
    word is taken of all words, short ones included, so the number of rows has its bound.
    """
    plain = F.regexp_replace(F.coalesce(docs[text_col].cast("string"), F.lit("")), f"(?i){CONTEXT}", " ")
    words = docs.select(F.explode(F.split(F.lower(plain), r"\P{L}+")).alias("word")).where("word <> ''")
    counts = cut(words.groupBy(F.when(F.length("word").between(3, WORD), F.col("word")).alias("word")).agg(F.count("*").alias("n")))
    total = counts.agg(F.sum("n")).first()[0] or 1
    share = F.col("n") / F.lit(float(total))
    return counts.where(F.col("word").isNotNull() & (share >= 2.0**-RARE)).select("word", (-F.log2(share)).alias("bits"))


def found_in(text: str, bits: dict[str, float], least: float = BITS) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all spans of a text, base ones and values that are hard to guess."""
    base = spans_of(text)
    more = []
    for m in _CONTEXT.finditer(text):
        start, end = m.span(2)
        if not is_plain_word(m[2]) and all(b <= start or end <= a for a, _, b in base) and guess_bits(m[2], bits) >= least:
            more.append((start, 3, end))
    return sorted(base + more)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = BITS) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_guess, base_sha256, spans): one row a document, spans as kind:start:end."""
    spark = docs.sparkSession
    small_batches(spark)
    known = spark.sparkContext.broadcast({r["word"]: r["bits"] for r in word_frequencies(docs, text_col).collect()})  # at most 2 ** RARE words
    schema = "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, n_guess bigint, base_sha256 string, spans string"
    told = lambda spans: ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)

    def row(text: str) -> tuple:
        spans = found_in(text, known.value, least)
        of = [sum(1 for s in spans if s[1] == k) for k in range(len(KINDS))]
        return *of, hashlib.sha256(told([s for s in spans if s[1] < 3]).encode()).hexdigest(), told(spans)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in schema.split(", ")]
        kinds = [pa.int64()] * 5 + [pa.string()] * 2
        none = row("")
        for b in batches:
            texts = b.column(1)
            rows = [none] * len(b)
            may = pc.fill_null(pc.match_substring_regex(texts, MAY_HOLD), False)
            for k in pc.indices_nonzero(may).to_pylist():
                rows[k] = row(texts[k].as_py())
            columns = list(zip(*rows, strict=True)) if rows else [[]] * (len(names) - 1)
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds[1:], strict=True)]], names)

    return docs.select(docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(of, schema)
