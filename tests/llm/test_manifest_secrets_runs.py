"""The Merkle manifest, the secret scan and the periodic runs against plain versions, and their awkward rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from functools import cache

import numpy as np
import pytest
from lorehouse.llm import merkle, periodic_runs, queries, secret_scan
from lorehouse.llm.common import table
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, pos string, tree int, block int, digest string, word string, bits string"
LONG = "tick tock " * 30_000
AWKWARD = [
    (1, None, None, None, None), (2, "", "en", "s", 0), (3, " \t\n", "en", "s", 3), (4, "One TWO", "en", None, 7), (4, "One TWO", "en", None, 7), (4, "ONE", "en", None, 7),
    (None, "password = 'Xk9$fQz!Lw'", "de", "t", 11), (6, LONG, "en", "s", 1), (7, "é pwd: tr0ub4dor&3 AKIA" + "A" * 14, None, "t", 8), (9, "a b " * 9, "de", "t", 11),
]
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
H = lambda s: hashlib.sha256(s.encode()).hexdigest()


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2, "d", "w", "b") for r in rows], SCHEMA)


def plain_manifest(rows):
    """(doc_id, leaf, subroot, root, proof, folded, verified) of (doc_id, text, lang, source, n_chars), level by level."""
    value = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda i, t, lang, s, n: H("".join(map(value, (i, s, lang, n, t))))

    def grow(digests):
        paths, at = [[] for _ in digests], list(range(len(digests)))
        while len(digests) > 1:
            runs = [digests[k : k + 16] for k in range(0, len(digests), 16)]
            for i, k in enumerate(at):
                paths[i].append(("".join(runs[k // 16][: k % 16]), "".join(runs[k // 16][k % 16 + 1 :])))
            digests, at = [H("".join(r)) for r in runs], [k // 16 for k in at]
        return digests[0], paths

    by = {}
    for r in rows:
        by.setdefault(r[3], []).append(r)
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        own = sorted(by[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))
        trees[s] = own, *grow([leaf(*r) for r in own])
    root, tops = grow([trees[s][1] for s in order])
    out = Counter()
    for k, s in enumerate(order):
        own, sub, paths = trees[s]
        for r, path in zip(own, paths, strict=True):
            hit = r[0] is not None and r[1] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            text = "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1]) if hit else r[1]
            at = leaf(r[0], text, *r[2:])
            for a, b in path + tops[k]:
                at = H(a + at + b)
            out[(r[0], leaf(*r), sub, root, H("".join(a + b for a, b in path + tops[k])), at, at == root)] += 1
    return out


def manifest_rows(df):
    told = merkle.manifest(df, FIELDS, "source", "doc_id", {"text": merkle.lowered_sometimes(F.col("doc_id"), F.col("text"))})
    return Counter(map(tuple, merkle.verified(told).collect()))


@pytest.mark.parametrize("sizes", [[1], [2], [16, 17], [1, 256, 257, 5], [4400, 15, 1]])
def test_manifest_equals_level_by_level(spark, sizes):
    rows, names = [], [None, "b", "é", "a"]
    for s, n in zip(names, sizes, strict=False):
        rows += [(1000 * len(rows) + k * 7 % n, f"Text {k}" if k % 11 else None, "en", s, k) for k in range(n)]
    random.Random(1).shuffle(rows)
    assert manifest_rows(frame(spark, rows)) == plain_manifest(rows)


def test_manifest_of_many_sources(spark):
    rows = [(k, "X", None, f"s{k}", 1) for k in range(600)]
    assert manifest_rows(frame(spark, rows)) == plain_manifest(rows)


def test_manifest_awkward(spark):
    assert manifest_rows(frame(spark, AWKWARD)) == plain_manifest(AWKWARD)
    assert manifest_rows(frame(spark, AWKWARD).limit(0)) == Counter()
    siblings = merkle.manifest(frame(spark, AWKWARD[:1]), FIELDS, "source", "doc_id").first()
    assert siblings.siblings == [] and siblings.leaf == siblings.subroot == siblings.root


def plain_spans(text):
    """Base spans, character by character."""
    found, low = [], "".join(c.lower() if c.isascii() else c for c in text)
    value = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")

    def run(i, chars):
        j = i
        while j < len(text) and text[j] in chars:
            j += 1
        return j

    i = 0
    while i < len(text):
        hit = None
        for name in ("password", "passwd", "secret", "token", "apikey", "api_key"):
            if low.startswith(name, i):
                j = i + len(name)
                j += text[j : j + 1] in ("'", '"') and j < len(text)
                j = run(j, " ")
                if text[j : j + 1] in (":", "=") and j < len(text):
                    j = run(j + 1, " ")
                    j += text[j : j + 1] in ("'", '"') and j < len(text)
                    if (end := run(j, value)) > j:
                        hit = (j, end)
        if hit:
            if hit[1] - hit[0] >= 12:
                found.append((i, 0, hit[1]))
            i = hit[1]
        else:
            i += 1
    for kind, head, chars, least in ((1, "AKIA", set("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"), 18), (2, "", set("0123456789abcdef"), 16)):
        i = 0
        while i < len(text):
            end = run(i + len(head), chars) if text.startswith(head, i) else i
            if end > i + len(head):
                if end - i >= least:
                    found.append((i, kind, end))
                i = end
            else:
                i += 1
    return sorted(found)


def plain_bits(value, bits):
    """The least cost over all cuttings, by recursion over the same kinds of segments."""
    n = len(value)

    def costs(i):
        out = [(i + 1, secret_scan.single(value[i])), *secret_scan.words_and_dates(value, i, bits)]
        for size in range(1, min(secret_scan.UNIT, (n - i) // 2) + 1):
            k = len(re.match(f"(?s:({re.escape(value[i : i + size])})+)", value[i:])[0]) // size
            if k > 1 and k * size >= 3:
                out.append((i + k * size, (plain_bits(value[i : i + size], bits) if size > 1 else secret_scan.single(value[i])) + math.log2(k)))
        j, turns, last = i + 1, 0, None
        while j < n and secret_scan.beside(value[j - 1], value[j]):
            a, b = secret_scan._PLACE[value[j - 1]], secret_scan._PLACE[value[j]]
            step = (b[0] - a[0], b[1] - a[1])
            turns, last, j = turns + (step != last), step, j + 1
        if j - i >= 3:
            out.append((j, math.log2(len(secret_scan._PLACE)) + math.log2(j - i) + 2.5 * turns))
        return out

    @cache
    def least(i):
        return 0.0 if i == n else min(c + least(j) for j, c in costs(i))

    return least(0)


def test_base_spans_equal_a_scan_by_character(spark):
    rnd = random.Random(2)
    parts = ["password", "Passwd", "SECRET", "toKen", "api_key", "apikey", "ſecret", "toKen", "=", ":", " ", '"', "'", "abc/", "AKIA", "AKIAABCDEFGHIJKLMN", "Z9", "deadbeef", "0123456789abcdef", "G", "é", "\n"]
    for _ in range(3000):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randrange(14)))
        assert secret_scan.spans_of(text) == plain_spans(text), text
    found = {r.doc_id: r for r in queries.op12_secret_scan(spark, DATA).collect()}
    for r in table(spark, DATA, "documents").collect():
        spans = plain_spans(r.text or "")
        told = ",".join(f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b in spans)
        mine = found.pop(r.doc_id)
        assert (mine.n_assign, mine.n_access, mine.n_hex) == tuple(sum(s[1] == k for s in spans) for k in range(3)) and mine.base_sha256 == H(told)
        assert set(filter(None, told.split(","))) <= set(mine.spans.split(","))
    assert not found


def test_guess_bits_is_the_least_over_all_cuttings():
    rnd, bits = random.Random(3), {"pass": 8.0, "word": 9.0, "sword": 12.0, "moon": 10.0}
    parts = ["pass", "word", "P@55", "m00n", "qwe", "ytr", "1234", "20240131", "31.12.99", "aaa", "abab", "x", "Z", "#", "é", "7"]
    for _ in range(300):
        value = "".join(rnd.choice(parts) for _ in range(rnd.randrange(1, 4)))[:11]
        assert math.isclose(secret_scan.guess_bits(value, bits), plain_bits(value, bits)), value
    assert secret_scan.guess_bits("a" * 20_000, bits) < 30
    assert secret_scan.guess_bits("password", bits) < 20 < 45 < secret_scan.guess_bits("Xk9$fQz!Lw", bits)


def test_secrets_awkward(spark):
    rows = [*AWKWARD, (10, "token: Wandering, secret = 2024-01-31; pwd=qwertyuiop token=aaaaaaaaaaaa", "en", "s", 1)]
    found = {(r.doc_id, r.n_assign): r for r in secret_scan.scan(frame(spark, rows)).collect()}
    text = AWKWARD[6][1]
    assert found[(None, 0)].spans == f"guess:{text.index('Xk')}:{len(text) - 1}"
    assert found[(7, 0)].spans == "guess:7:18,access:19:37" and found[(7, 0)].n_guess == 1
    assert found[(10, 1)].spans == f"assign:{rows[-1][1].index('token=aaa')}:{len(rows[-1][1])}" and found[(1, 0)].base_sha256 == H("") and found[(6, 0)].spans == ""
    assert secret_scan.scan(frame(spark, rows)).count() == len(rows) and secret_scan.scan(frame(spark, rows).limit(0)).count() == 0


def test_word_frequencies_leave_values_out(spark):
    df = frame(spark, [(k, "moon river password=zebrazebra an", "en", "s", 1) for k in range(50)])
    found = {r.word: r.bits for r in secret_scan.word_frequencies(df).collect()}
    assert set(found) == {"moon", "river"} and math.isclose(found["moon"], math.log2(3))


def plain_runs(ids):
    found, n = set(), len(ids)
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and ids[j] == ids[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(12, 2 * q):
                part = ids[i : i + length]
                if q == next(p for p in range(1, length + 1) if part[p:] == part[:-p]):
                    found.add((i, length, q))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def test_runs_equal_every_lag_scanned():
    rnd = random.Random(4)
    for _ in range(1500):
        n, k, ids = rnd.randrange(90), rnd.choice([1, 2, 2, 3, 6]), []
        while len(ids) < n:
            unit = [rnd.randrange(k) for _ in range(rnd.randrange(1, 14))]
            ids += unit * rnd.choice([1, 1, 2, 3, 9])
        if ids and rnd.random() < 0.5:
            ids[rnd.randrange(len(ids))] = 7
        array = np.array(ids, np.int32)
        assert periodic_runs.runs(array) == plain_runs(ids), ids
        if len(ids) > 1:
            assert periodic_runs.matches_by_lag(array)[1:].tolist() == [sum(map(int.__eq__, ids, ids[q:])) for q in range(1, len(ids) // 2 + 1)]


def test_runs_query_equals_brute_force(spark):
    found = {r.doc_id: r for r in queries.op13_periodic_runs(spark, DATA).collect()}
    checked = 0
    for r in table(spark, DATA, "documents").collect():
        words, h, mine = re.findall(r"[^\x20\x09-\x0D]+", r.text or ""), zlib.crc32(str(r.doc_id).encode()), found.pop(r.doc_id)
        n = len(words)
        if h % 10 == 0 and n:
            a = (h // 10) % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        if n > 700:
            continue
        runs = plain_runs(words)
        checked += len(runs)
        dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=(None,) * 3)
        assert (mine.n_runs, mine.start, mine.length, mine.period) == (len(runs), *best)
        assert mine.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert mine.runs_sha256 == H("".join(f"{a},{b},{c}\n" for a, b, c in runs))
        assert mine.collapsed_sha256 == H(" ".join(w for i, w in enumerate(words) if i not in dropped))
    assert not found and checked


def test_runs_awkward(spark):
    found = {(r.doc_id, r.n_words): r for r in periodic_runs.periodic_runs(frame(spark, AWKWARD)).collect()}
    assert (found[(1, 0)].n_runs, found[(1, 0)].start, found[(1, 0)].collapsed_sha256) == (0, None, H(""))
    assert (found[(6, 60_000)].length, found[(6, 60_000)].period) == (60_000, 2) or found[(6, 60_000)].n_runs == 1
    assert (found[(9, 18)].n_runs, found[(9, 18)].exponent_milli) == (1, 9000)
    assert periodic_runs.periodic_runs(frame(spark, AWKWARD)).count() == len(AWKWARD) and periodic_runs.periodic_runs(frame(spark, AWKWARD).limit(0)).count() == 0
