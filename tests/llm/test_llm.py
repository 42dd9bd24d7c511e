"""The training-data operators: brute force, round trips, held-out accuracy, and the awkward rows."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import corpus_pipeline
import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from lorehouse.llm import components, embedding_dedup, jaccard_join, language_id, mixing, packing, quality_classifier, quality_rules, queries, token_counts, toxicity, url_filters, words
from lorehouse.llm.common import table
from pyspark.sql import functions as F
from tokenizers import Tokenizer

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, id string, v int, x double"
LONG = "word " * 60_000
AWKWARD = [
    (1, None, None, None, None, "a", 1, 1.0), (2, "", "en", "s", 0, "b", 1, 1.0), (3, " \t\n", "en", "s", 3, "b", 1, 1.0), (4, "One two", "en", None, 7, None, None, None),
    (4, "One two", "en", None, 7, None, None, None), (None, "a b c d e f", "de", "t", 11, "c", 2, 0.0), (6, LONG, "en", "s", 1, "d", 1, 1.0), (7, "12 34 !!", None, "t", 8, "e", 1, 1.0),
    (8, "é\u00a0ü\u2003x \x1c y", "fr", "t", 9, "f", 1, 1.0), (9, "A B C D E F", "de", "t", 11, "g", 1, 1.0),
]


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame(AWKWARD, SCHEMA)


@pytest.fixture(scope="module")
def empty(awkward):
    return awkward.limit(0)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    c = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    theirs, ours = c.execute(queries.oracle_sql()[name]).df(), queries.queries()[name](spark, DATA).toPandas()
    columns = sorted(theirs.columns)
    rows = lambda f: Counter(tuple(map(str, r)) for r in f[columns].astype(object).where(f[columns].notna(), None).itertuples(index=False))
    assert sorted(ours.columns) == columns and rows(ours) == rows(theirs)


def test_quality_rules_awkward(awkward, empty):
    found = quality_rules.apply_rules(awkward)
    assert found.count() == len(AWKWARD) and found.where("kept").count() == 0 and quality_rules.apply_rules(empty).count() == 0
    row = found.where("doc_id = 6").first()
    assert (row.n_words, row.n_repeat_words, row.base_failed) == (60_000, 60_000, True)
    assert {(r.n_words, r.word_chars) for r in found.where("doc_id in (1, 2, 3)").collect()} == {(0, 0)}


def test_url_filters_nested_and_odd(spark):
    urls = [(1, None), (2, "no scheme"), (3, "http://EXAMPLE.com/en/7?x"), (4, "http://a.example.com/en/8#f"), (5, "https://community/en/"), (6, "x://com"), (6, "x://com"), (7, "http://com./en/")]
    pages = spark.createDataFrame(urls, "page_id int, url string").withColumn("host", F.lit("clash")).withColumn("rule", F.lit(1))
    found = {(r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filters.decide(pages, url_filters.rule_table(spark)).collect()}
    assert found == {(1, "", "", None, "allow"), (2, "", "", None, "allow"), (3, "example.com", "/en/7", "example.com/en/7", "allow"), (4, "a.example.com", "/en/8", "com/en/", "block"), (5, "community", "/en/", None, "allow"), (6, "com", "", None, "allow"), (7, "com.", "/en/", None, "allow")}
    bare = url_filters.rule_table(spark, [("block", "com", "")])
    assert {r.page_id: r.verdict for r in url_filters.decide(pages, bare).collect()} == {1: "allow", 2: "allow", 3: "block", 4: "block", 5: "allow", 6: "block", 7: "allow"}
    assert url_filters.decide(pages, url_filters.rule_table(spark).limit(0)).where("verdict = 'block'").count() == 0


def brute_components(rows, n, percent):
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append(frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset())
    label = list(range(len(rows)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                label[root(i)] = root(j)
    least = defaultdict(list)
    for i, (doc_id, _) in enumerate(rows):
        least[root(i)].append(doc_id)
    return Counter((doc_id, len(sets[i]), min((x for x in least[root(i)] if x is not None), default=None)) for i, (doc_id, _) in enumerate(rows))


def near_copies(seed, n):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(400)}" for _ in range(90)]
    out = []
    for _ in range(n):
        words = list(base) if rng.random() < 0.7 else [f"w{rng.randrange(400)}" for _ in range(rng.randrange(1, 120))] + base[:30]
        for _ in range(rng.choice((0, 0, 1, 1, 2, 3, 6))):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10_000)}"
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize(("seed", "n", "percent"), [(1, 4, 85), (2, 5, 80), (3, 4, 85)])
def test_jaccard_components_equal_brute_force(spark, seed, n, percent):
    rows = [(i, t) for i, t in enumerate(near_copies(seed, 160))] + [(5, "again and again"), (None, "a b c d e f"), (901, "A b C d e F"), (902, ""), (903, None), (904, "x y"), (905, "X\ty ")]
    found = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id bigint, text string"), n=n, percent=percent)
    ours = Counter((r.id, r.n_shingles, r.component_id) for r in found.collect())
    brute = brute_components(rows, n, percent)
    assert {k: v for k, v in ours.items() if k[1]} == {k: v for k, v in brute.items() if k[1]}
    assert all(k[0] == k[2] for k in ours if not k[1])


def test_jaccard_awkward(awkward, empty):
    assert jaccard_join.jaccard_components(empty).count() == 0
    found = {r.id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(awkward).collect()}
    assert found[1] == (0, 1) and found[3] == (0, 3) and found[4] == (1, 4) and found[6] == (1, 6) and found[None] == (3, 9) and found[9] == (3, 9)


def test_language_accuracy_and_awkward(spark, awkward, empty):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    model = language_id.train(language_id.training_rows(docs))
    rows = queries.op4_language_id(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.98 and all(0 <= r.score <= 1 for r in rows)
    odd = {r.doc_id: (r.lang_pred, r.score) for r in language_id.predict(awkward, model).collect()}
    assert all(odd[k] == ("und", 0.0) for k in (1, 2, 3, 7)) and odd[4][0] in model.languages
    assert language_id.train(empty) is None and language_id.predict(awkward, None).where("lang_pred <> 'und'").count() == 0


def test_presence_kernel_equals_sets():
    x = language_id.presence(["abca", "", "bc"], 1 << 14, 3)
    sets = [{t[i : i + k] for k in (1, 2, 3) for i in range(len(t) - k + 1)} for t in ("abca", "", "bc")]
    assert x.sum(axis=1).tolist() == [len(s) for s in sets] and (x @ x.T)[0, 2] == len(sets[0] & sets[2])


def test_mixing_meets_targets(spark, awkward, empty):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    rows = mixing.mix_sources(docs, doubt=0.01).collect()
    words, got = Counter(), Counter()
    for r in rows:
        words[r.source] += r.n_words
        got[r.source] += r.n_words * r.rate
    wish = {s: w**0.5 for s, w in words.items()}
    share = {s: got[s] / sum(got.values()) for s in got}
    assert all(abs(share[s] - wish[s] / sum(wish.values())) < 0.01 for s in share) and min(r.rate for r in rows) >= 0
    odd = mixing.mix_sources(awkward, {"s": 1.0, "t": 1.0})
    assert odd.count() == len(AWKWARD) and set(awkward.columns) <= set(odd.columns) and mixing.mix_sources(empty).count() == 0
    assert mixing.taken(odd, awkward.columns).columns == awkward.columns


def test_mixing_small_source_keeps_the_rest(spark, monkeypatch):
    rows = [(i, f"some words number {i} of the one source " * 20, "en", "ab"[i % 2]) for i in range(400)] + [(900, "few words", "en", "c")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    found = {r.domain: r for r in mixing.kept_words(mixing.mix_sources(docs, doubt=0.01)).collect()}
    assert all(found[s].kept_words > 0.95 * found[s].n_words for s in "ab")
    assert mixing.targets([1e6, 1e6, 1.0], [1e3, 1e3, 1.0], None, 4.0)[2] == 4.0 and mixing.targets([1e6, 1e6, 1.0], [1e3, 1e3, 1.0], None)[2] > 900 and sum(mixing.targets([9.0, 1.0], [3.0, 1.0], None)) == 10.0
    assert mixing.targets([9.0, 1.0], [1.0, 1.0], 20.0) == [10.0, 10.0]
    monkeypatch.setattr(mixing, "MAX_DOMAINS", 2)
    found = {r.domain: r.n_docs for r in mixing.kept_words(mixing.mix_sources(docs, doubt=0.01)).collect()}
    assert found == {"a": 200, mixing.OTHERS: 201}


def topical(n, seed=4):
    """Documents of three sources with words of their own and some common ones; a tenth has no source."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        k = rng.randrange(3)
        words = [f"{'abc'[k]}{rng.randrange(30)}" if rng.random() < 0.6 else f"w{rng.randrange(50)}" for _ in range(rng.randrange(5, 60))]
        rows.append((i, " ".join(words), "en", None if rng.random() < 0.1 else f"s{k}", k))
    return rows


def test_mixing_membership_by_text_is_held_out_and_solves_least_squares(spark):
    docs = spark.createDataFrame(topical(900), "doc_id bigint, text string, lang string, source string, k int")
    told = mixing.described(docs, docs.columns, "doc_id", "text", "source", "lang")
    member = mixing.memberships(told)
    assert member.weight > 0 and member.held_out["accuracy"] > 0.8 and member.held_out["loss"] < member.held_out["prior_loss"]
    rows = member.table.select("k", "source", F.col(told.n).alias("n"), F.col(member.p).alias("p"), mixing.fitted(member, told.n, {"s0": 3.0, "s1": 1.0}, None, 0.5, 0.02, 400, 1e-9, None)[0].alias("rate")).collect()
    assert np.mean([np.argmax(r.p) == r.k for r in rows if r.source is None]) > 0.8  # the label is no input
    p, n, rate = np.array([r.p for r in rows]), np.array([r.n for r in rows], float), np.array([r.rate for r in rows])
    mass = p.T @ n
    goal = np.array(mixing.targets(mass.tolist(), [3.0, 1.0, 0.0], None))
    r = np.ones(len(n))  # the same least squares by plain projected gradient steps on every rate
    for _ in range(20_000):
        r = np.maximum(0, r - 0.5 * (p @ ((p.T @ (n * r) - goal) / mass) + 0.02 * (r - 1)))
    assert np.abs(r - rate).max() < 1e-3 and rate.min() >= 0


def test_mixing_keeps_columns_with_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a b", "en", "s", 7, 8, 9, 1), (None, None, None, None, None, None, None, None)], "doc_id bigint, text string, lang string, source string, rate int, copies int, `__n` int, `__p` int")
    mixed = mixing.mix_sources(docs)
    assert sorted(mixed.columns) == sorted([*docs.columns, "n_words", "domain", "domain_target", "domain_expected"])
    assert {(r["doc_id"], r["__n"], r["__p"], r["n_words"], r["domain"], r["copies"]) for r in mixed.collect()} == {(1, 9, 1, 2, "s", 1), (None, None, None, 0, "s", 1)}


def brute_links(rows, threshold):
    valid = {r[0]: (np.array(r[1], float), r[2]) for r in rows if r[0] is not None and r[1] and r[2] is not None and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])}
    links = defaultdict(set)
    for a, (x, la) in valid.items():
        for b, (y, lb) in valid.items():
            if a != b and la == lb and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= threshold:
                links[a].add(b)
    return links


def test_embedding_recall_and_awkward(spark):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((12, 16))
    rows = [(i, (base[i % 12] + rng.standard_normal(16) * rng.choice([0.02, 0.1, 0.14])).tolist(), int(i % 12 % 3)) for i in range(600)]
    rows += [(900, None, 1), (901, [0.0] * 16, 1), (902, [1.0, None], 1), (903, [float("nan"), 1.0], 1), (904, [1.0, 0.0], None), (905, [1.0, 0.0], 1), (906, [2.0, 0.0], 1), (905, [1.0, 0.0], 1), (None, [1.0, 0.0], 1), (907, [], 1)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    found = embedding_dedup.near_duplicates(df, block=64).collect()
    links = brute_links(rows, 0.98)
    want, got = sum(map(len, links.values())), sum({r.vec_id: r.n_links for r in found}.values())
    assert len(found) == len(rows) and 0.99 * want <= got <= want and all(r.n_links <= len(links[r.vec_id]) for r in found)
    odd = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in found}
    assert all(odd[k] == (0, k, True) for k in (900, 901, 902, 903, 904, 907, None)) and odd[905] == (1, 905, True) and odd[906] == (1, 905, False)
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def held_out_errors(spark, name, label, data="/root/testdata/sf0.1"):
    scored = queries.queries()[name](spark, data).join(table(spark, data, "labels").select("doc_id", label), "doc_id").where("held_out").collect()
    assert all(0 <= r.score <= 1 for r in scored)
    return np.mean([r.predicted != r[label] for r in scored])


def test_toxicity_held_out_and_awkward(spark, awkward, empty):
    assert held_out_errors(spark, "op7_toxicity", "toxic") < 0.08
    rows = [{"text": f"you {random.Random(i).choice(['idiot', 'moron'])} n{i} m{i}", "label": 1} for i in range(60)] + [{"text": f"fine words n{i} p{i}", "label": 0} for i in range(60)]
    model = toxicity.fit([{"label": r["label"], "features": f} for r, f in zip(rows, toxicity.packed_features(pa.array([r["text"] for r in rows])).to_pylist(), strict=True)])
    odd = {r.doc_id: r.score for r in toxicity.score(awkward, model).collect()}
    assert len(odd) == 9 and all(odd[k] < 0.5 for k in (1, 2, 3, 6))
    assert toxicity.train(empty, empty.withColumn("toxic", F.lit(1))) is None and toxicity.score(awkward, None).where("score > 0").count() == 0


def test_label_model_finds_accuracy_and_copies():
    rng = np.random.default_rng(0)
    truth = rng.random(4000) < 0.3
    good = (rng.random((4000, 3)) < np.where(truth[:, None], 0.8, 0.02)).astype(float)
    votes = np.hstack([good, good[:, :1]])  # the last copies the first
    post, yes, no, copies = toxicity.label_model(votes, good[:, 1])
    assert np.mean((post > 0.5) == truth) > 0.9 and np.allclose(yes[:3], 0.8, atol=0.1) and (no[:3] < 0.1).all()
    assert copies[0] > 1.5 and copies[3] > 1.5 and copies[1] < 1.5


def test_quality_held_out_and_awkward(spark, awkward, empty):
    assert held_out_errors(spark, "op8_quality_classifier", "quality") < 0.02
    x = np.random.default_rng(1).random((200, len(quality_classifier.FEATURES)))
    model = quality_classifier.fit(x, (x[:, 2] < 0.5).astype(int))
    fitted = quality_classifier.train(table(spark, "/root/testdata/sf0.01", "documents"), queries.marks(spark, "/root/testdata/sf0.01", "quality", 4, 2))
    clash = awkward.withColumns({"__w": F.lit(1), "__text": F.lit(2), "__x": F.lit(3)})
    rated = quality_classifier.score(clash, fitted)
    assert rated.columns == [*clash.columns, "score"] and rated.where("`__w` = 1 and `__text` = 2 and `__x` = 3").count() == len(AWKWARD)
    assert {r.score for r in rated.where("doc_id in (1, 2, 3)").collect()} == {0.0}
    assert model.weights[2] < 0 and len(quality_classifier.score(awkward, model).collect()) == len(AWKWARD)
    assert quality_classifier.train(empty, empty.withColumn("quality", F.lit(1))) is None and quality_classifier.score(awkward, None).where("score < 1").count() == 0


def test_token_ledger(spark, awkward, tmp_path):
    ledger = token_counts.Ledger(spark, str(tmp_path / "ledger"))
    assert ledger.totals().count() == 0
    state = token_counts.state(F.col("source"), F.col("lang"), "words/1", token_counts.word_count(F.col("text")))
    nothing = F.lit(None).cast(token_counts.STATE)
    insert, delete = awkward.select(nothing.alias("before"), state.alias("after")), awkward.where("doc_id = 6").select(state.alias("before"), nothing.alias("after"))
    assert ledger.commit("1", insert) and not ledger.commit("1", insert) and ledger.commit("2", delete)
    totals = lambda: {(r.source, r.lang): (r.n_docs, r.n_tokens) for r in ledger.totals().collect()}
    before = totals()
    assert before[("s", "en")] == (2, 0) and before[(None, None)] == (1, 0) and before[(None, "en")] == (2, 4)
    ledger.compact()
    assert totals() == before and not ledger.commit("2", delete) and totals() == before
    assert ledger.commit("3", insert.limit(0)) and totals() == before


def unpacked(rows):
    sequences, docs = defaultdict(list), defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
        docs[r.doc_id].append(r)
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at == 2048 or at & (at - 1) == 0 and at < 2048
    return docs


def test_packing_round_trip(spark):
    path = public_tokenizers.path(queries.TOKENIZER)
    t = Tokenizer.from_file(path)
    docs = table(spark, DATA, "documents")
    found = unpacked(packing.pack(docs, path, shard_docs=64).collect())
    for d in docs.collect():
        ids = np.array([*t.encode(d.text or "", add_special_tokens=False).ids, 1], np.uint32)
        pieces = sorted(found[d.doc_id], key=lambda r: r.start)
        assert b"".join(p.ids for p in pieces) == ids.tobytes() and {p.doc_tokens for p in pieces} == {len(ids)}
    one = packing.digest(packing.pack(docs, path)).first()
    assert one.ids_crc32 == zlib.crc32(next(p.ids for p in packing.pack(docs.where(docs.doc_id == one.doc_id), path).where(f"start = {one.start}").collect())[: 4 * one.length])


def test_packing_awkward(spark, awkward, empty):
    path = public_tokenizers.path(queries.TOKENIZER)
    t = Tokenizer.from_file(path)
    texts = ["a  b", " lead", "trail ", "x\n\n y", "tab\t z", "\n word", "nb\u00a0 sp", "\x1c q", "don't  stop", "<|endoftext|> x", "é" * 50]
    more = spark.createDataFrame([(100 + i, s) for i, s in enumerate(texts)], "doc_id bigint, text string")
    rows = awkward.where("doc_id is null or doc_id <> 4").select("doc_id", "text").union(more)
    found = unpacked(packing.pack(rows, path, shard_docs=4).collect())
    for r in rows.collect():
        ids = np.array([*t.encode(r.text or "", add_special_tokens=False).ids, 1], np.uint32)
        assert b"".join(p.ids for p in sorted(found[r.doc_id], key=lambda p: p.start)) == ids.tobytes()
    assert packing.pack(empty, path).count() == 0


def test_bm25_scores_equal_formula():
    docs = [np.array(x, np.uint32) for x in ([5, 5, 6, 1], [6, 7, 1], [5, 8, 8, 8, 1])]
    idf = np.array([0, 0, 0, 0, 0, 1.5, 0.5, 2.0, 0.7])
    s = packing.Shard(docs, idf, 4.0).scores(0)
    want = [sum(idf[w] * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * len(d) / 4)) for w, c in Counter(d.tolist()).items() if w in (5, 6)) for d in docs]
    assert np.allclose(s, want)


def test_packing_shards_hold_true_neighbours_wherever_stored(spark):
    rng = np.random.default_rng(11)
    words = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 3)) for _ in range(16 * 30)]
    texts = [" ".join(rng.choice(words[i % 16 :: 16], 80)) for i in range(640)]  # like texts are never side by side
    path = public_tokenizers.path(queries.TOKENIZER)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(5)
    rows = packing.tokenize(docs, path).collect()
    tokens = [packing._ids(r.ids, r.n) for r in sorted(rows, key=lambda r: r.doc_id)]
    df = np.bincount(np.concatenate([np.unique(t) for t in tokens]))
    brute = packing.Shard(tokens, np.maximum(0.0, np.log((640 - df + 0.5) / (df + 0.5))), np.mean([len(t) for t in tokens]))
    pieces = defaultdict(set)
    for r in packing.pack(docs, path, shard_docs=64).collect():
        pieces[r.sequence_id].add(r.doc_id)
    beside = [(a, b) for s in pieces.values() for a in s for b in s if a != b]
    top = {a: set(np.argsort(-brute.scores(a))[:40].tolist()) for a in {a for a, _ in beside}}
    assert np.mean([b in top[a] for a, b in beside]) > 0.7  # 40 of 640 by chance


def test_ranked_equals_stable_sort():
    score = np.random.default_rng(2).integers(-1, 9, 500).astype(float)
    for count in (0, 3, 64, 65, 200, 500):
        assert list(packing._ranked(score, count)) == np.argsort(-score, kind="stable")[:count].tolist()


def test_pipeline_stages(spark, tmp_path):
    docs = table(spark, DATA, "documents")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, DATA)
        if name != "packing":
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / str(k)))
        kept, before = spark.read.parquet(str(tmp_path / str(k))), docs
        if name == "ngram_jaccard":
            pairs = [(r.doc_id, r.text) for r in before.collect()]
            assert {r.doc_id for r in kept.collect()} == {c for _, n, c in brute_components(pairs, 5, 80) if n} | {r.doc_id for r in before.collect() if not (r.text or "").split()}
        if name == "packing":
            unpacked(kept.collect())
            assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in before.collect()}
        elif name != "mixing":
            assert 0 < kept.count() <= before.count()
        docs = kept


def test_pipeline_stages_take_awkward_rows(spark, awkward, empty, tmp_path):
    told = {}
    for start in (awkward, empty):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, start, DATA)
            assert name == "packing" or out.columns == start.columns
            rows = out.collect()
            if start is empty:
                assert rows == []
            told.setdefault(name, rows)
    ids = lambda name: sorted((r.doc_id for r in told[name]), key=str)
    texts = Counter((r[0], r[1]) for r in AWKWARD)
    assert ids("language_id") == [4, 4, 6, 8, 9, None] and all(r.lang for r in told["language_id"])
    assert not Counter((r.doc_id, r.text) for r in told["quality_classifier"]) - texts and not {1, 2, 3} & set(ids("quality_classifier"))
    assert ids("ngram_jaccard") == [1, 2, 3, 4, 6, 7, 8, 9]
    assert {(r.doc_id, r.text) for r in told["mixing"]} <= set(texts)
    whole = Counter()
    for r in told["packing"]:
        whole[r.doc_id] += r.length
    tokens = {(r.doc_id, r.doc_tokens) for r in told["packing"]}
    assert set(whole) == {r[0] for r in AWKWARD} and all(whole[i] == n * (2 if i == 4 else 1) for i, n in tokens)


def test_near_duplicates_keep_a_row_of_each_text(spark, awkward):
    kept = lambda df: Counter((r.doc_id, r.text) for r in corpus_pipeline.drop_near_duplicates(spark, df, DATA).collect())
    assert kept(awkward) == Counter({(r[0], r[1]) for r in AWKWARD} - {(None, "a b c d e f")})  # one of the repeated rows with id 4; 9 before null
    rows = [(None, "only rows without id hold this text"), (None, "only rows without id hold this text"), (None, "and another such text it is"), (5, "one text under this id"), (5, "quite another under the same id")]
    assert kept(spark.createDataFrame([*rows, (None, None), (None, "")], "doc_id bigint, text string")) == Counter({*rows, (None, None), (None, "")})


def test_coder_equals_tokenizer_on_awkward_texts():
    rng = random.Random(3)
    odd = [" ", "  ", "\n", "\t", "a", "B", "é", "ß", "1", "²", "½", "'s", "'S", "<|endoftext|>", "_", "!", "…", "日", "\u00a0", "\u2003", "\u200b", "́", "😀", "\x1c", "\x85"]
    texts = ["", None, " ", "\n", "a\n\nb", "  x  y ", "it's  'tis\t\nwe'll don't", "\r\n x\r\n", "hello <|endoftext|> there", "x\x0by \x0c z\x1cq", THUE["a"]]
    texts += [" ".join(f"w{k}-{k * 7919}" for k in range(2000))] + ["".join(rng.choice(odd) for _ in range(rng.randrange(1, 14))) for _ in range(500)]
    for name, fast in ((queries.TOKENIZER, True), ("word_bpe_49k.json", False)):
        plain, coder = Tokenizer.from_file(public_tokenizers.path(name)), packing.Coder(public_tokenizers.path(name))
        assert (coder.fast is not None) == fast
        want = [plain.encode(t or "", add_special_tokens=False).ids + [packing.END] for t in texts]
        assert [ids.tolist() for ids in coder.encode(pa.array(texts))] == want
    assert packing.Coder(public_tokenizers.path(queries.TOKENIZER)).encode(pa.array([b"a\xff"], pa.binary()).view(pa.string()))[0].tolist() == Tokenizer.from_file(public_tokenizers.path(queries.TOKENIZER)).encode("a\ufffd", add_special_tokens=False).ids + [1]


def thue(a, b, n=2048):
    bits = [0]
    while len(bits) < n:
        bits += [1 - x for x in bits]
    return "".join((a, b)[x] for x in bits)


#: Words of 2048 letters that a polynomial modulo a power of two cannot tell apart.
THUE = {"a": thue("a", "b"), "b": thue("b", "a")}


def test_words_that_defeat_polynomials_stay_apart(spark):
    (run,) = words.runs_of_words(pa.array([THUE["a"], THUE["b"], THUE["a"].upper()]))
    assert run.hash[0] != run.hash[1] and run.hash[0] == run.hash[2]
    docs = spark.createDataFrame([(1, THUE["a"] + " p q r"), (2, THUE["b"] + " p q r"), (3, THUE["a"] + " P q r")], "doc_id bigint, text string")
    assert {r.id: r.component_id for r in jaccard_join.jaccard_components(docs).collect()} == {1: 1, 2: 2, 3: 1}


def test_jaccard_with_many_fragments_and_heavy_shingles_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "FRAGMENT", 400)
    monkeypatch.setattr(jaccard_join, "SAMPLED", 1)
    rows = [(i, t) for i, t in enumerate(near_copies(4, 200))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(2)
    _, heavy, total, _ = jaccard_join.classes(docs.select(F.col("doc_id").alias("id"), "text"), "id bigint", 4)
    assert len(heavy) > 20 and jaccard_join.sizes_of(total)[0] > 20
    found = jaccard_join.jaccard_components(docs)
    assert Counter((r.id, r.n_shingles, r.component_id) for r in found.collect()) == brute_components(rows, 4, 85)


def test_bytes_of_an_ngram_do_not_grow_with_the_fragments(spark, monkeypatch):
    rng = random.Random(12)
    rows = [(i, " ".join(f"u{rng.randrange(10**9)}" for _ in range(200))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)
    total = sum(len(set(t.split())) - 3 for _, t in rows)
    sent = {}
    for each in (total, 200):  # one fragment, and as many as leave most documents one n-gram or none in each
        monkeypatch.setattr(jaccard_join, "FRAGMENT", each)
        sent[each] = jaccard_join.fragments(docs, "text", 4, *jaccard_join.sizes_of(total)).toArrow().nbytes
    assert sent[200] < 1.25 * sent[total] and sent[200] < 12 * total


def test_jaccard_copies_in_many_batches(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "FRAGMENT", 400)
    texts = near_copies(6, 60) + [" ".join(f"c{i}x{j}" for j in range(40)) for i in range(5)]
    rows = [(i, t) for i, t in enumerate(texts * 3)]
    random.Random(1).shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7)
    found = jaccard_join.jaccard_components(docs)
    assert Counter((r.id, r.n_shingles, r.component_id) for r in found.collect()) == brute_components(rows, 4, 85)
    parts, spread = jaccard_join.sizes_of(12_000)
    sets = jaccard_join.active_sets(jaccard_join.fragments(docs, "text", 4, parts, spread), 85, parts, spread).collect()
    alone = jaccard_join.shingle_sets(pa.array([t for t in texts if t.startswith("c0x") or t.startswith("c4x")]), 4)
    # A class is told once, and not at all if its n-grams are in its own copies alone.
    assert len({r.v for r in sets}) == len(sets) > 5 and not {r.v for r in sets} & {int(x) for _, _, v, _ in alone for x in v.view(np.int64)}


def test_packed_rows_come_back():
    place, starts = np.array([0, 0, 70_000, 3, 1_000_000, 5]), np.array([0, 3, 5])
    values = np.array([2**48 - 1, 0, 1, 2**40, 77, 256], np.uint64)
    data = pa.chunked_array([jaccard_join.packed(starts, place, (values, 6), (values, 2))])
    row, at, all_of, low = jaccard_join.unpacked(data, 6, 2)
    assert row.tolist() == [0, 0, 0, 1, 1, 2] and at.tolist() == place.tolist() and all_of.tolist() == values.tolist() and low.tolist() == (values % 65536).tolist()
    assert all(len(x) == 0 for x in jaccard_join.unpacked(pa.chunked_array([], pa.binary()), 6))


def test_components_with_hubs(spark, monkeypatch):
    monkeypatch.setattr(components, "LEAST_HUB", 3)
    monkeypatch.setattr(components, "SHARE", 1e-9)
    rng = random.Random(9)
    edges = [(0, i) for i in range(1, 40)] + [(500, i) for i in range(400, 440)] + [(i, i + 1) for i in range(100, 130)] + [(rng.randrange(600, 640), rng.randrange(600, 640)) for _ in range(30)] + [(7, 7)]
    label = {x: x for e in edges if e[0] != e[1] for x in e}
    for _ in range(len(label)):
        for a, b in edges:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    assert {r.node: r.label for r in components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()} == label


def test_embedding_classes_labels_and_lengths(spark):
    rows = [(i, [1.0, 2.0, 3.0], "a") for i in range(20_000)] + [(20_000 + i, [1.0, 2.0, 3.001], "a") for i in range(5)] + [(30_000, [1.0, 2.0, 3.0], "1.2"), (30_001, [1.0, 2.0, 3.0], "1.7"), (30_002, [1.0, 2.0], "a")]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label string")
    found = {r.vec_id: r for r in embedding_dedup.near_duplicates(df).collect()}
    assert len(found) == len(rows) and found[7].n_links == 20_004 and found[20_003].n_links == 20_004 and found[20_003].component_id == 0
    assert all(found[k].n_links == 0 and found[k].kept for k in (30_000, 30_001, 30_002))


def test_embedding_plan_grows_with_the_largest_label():
    small, large = embedding_dedup.plan(5_000, 0.98), embedding_dedup.plan(10**8, 0.98)
    assert small[1] == 6 and 10 <= small[0] <= 20 and large[1] > 10 and large[0] < 80
    near = embedding_dedup.meeting(0.2)
    for tables, hashes in (small, large):
        assert 1 - (1 - near**hashes) ** tables >= embedding_dedup.RECALL


def test_embedding_recall_on_planted_pairs(spark):
    docs = table(spark, "/root/testdata/sf0.1", "embeddings").orderBy("vec_id").collect()
    rng = np.random.default_rng(3)
    rows = [(r.vec_id, list(r.embedding), r.label) for r in docs]
    for k in range(300):  # near the threshold, on both sides
        x = np.array(rows[k][1])
        y = rng.standard_normal(len(x))
        y -= x * (x @ y) / (x @ x)
        cos = rng.uniform(0.975, 0.995)
        rows.append((100_000 + k, (cos * x / np.linalg.norm(x) + np.sqrt(1 - cos**2) * y / np.linalg.norm(y)).tolist(), rows[k][2]))
    found = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")).collect()
    links = brute_links(rows, 0.98)
    want, got = sum(map(len, links.values())), sum(r.n_links for r in found)
    assert want > 400 and 0.99 * want <= got <= want and all(r.n_links <= len(links[r.vec_id]) for r in found)


def test_toxicity_catches_toxic_rows_and_leaves_clean_ones(spark):
    rows = queries.op7_toxicity(spark, "/root/testdata/sf0.1").join(table(spark, "/root/testdata/sf0.1", "labels"), "doc_id").where("held_out").collect()
    caught = np.mean([r.predicted == 1 for r in rows if r.toxic == 1])
    left = np.mean([r.predicted == 0 for r in rows if r.toxic == 0])
    assert caught > 0.85 and left > 0.95


def test_toxicity_posteriors_do_not_follow_the_marks():
    votes = np.zeros((40, 3))
    votes[:20, :2], votes[20:, 2] = 1, 1
    assert toxicity.majority(votes).tolist() == [1.0] * 20 + [0.0] * 20
    assert not toxicity.majority(np.array([[0.0, 0.0, 1.0], [0.0, 0.0, 0.0]])).any()


def test_language_regression_is_the_closed_form():
    rng = np.random.default_rng(5)
    rows = [{"text": " ".join(rng.choice(["oui", "non", "merci"] if k else ["yes", "no", "thanks"], 6)) + f" {i}", "label": "fr" if k else "en"} for i in range(120) for k in (i % 3 == 0,)]
    ridge, model = 1e-3, language_id.fit(rows, landmarks=16)
    x = language_id.presence([r["text"] for r in rows], model.buckets, model.longest).astype(float)
    x /= np.sqrt(x.sum(axis=1, keepdims=True))
    label = np.array([model.languages.index(r["label"]) for r in rows])
    y = np.where(label[:, None] == np.arange(2), 1.0, -1.0)
    weight = (1 / np.bincount(label))[label] * len(label) / 2
    kernel, inner = x @ model.landmarks.T, (model.landmarks @ model.landmarks.T).astype(float)

    def loss(w):  # the penalty is the norm of the function, not of the landmark weights
        return (weight[:, None] * (kernel @ w - y) ** 2).sum() + ridge * len(rows) * np.einsum("ik,ij,jk->", w, inner, w)

    best = loss(model.weights.astype(float))
    values, vectors = np.linalg.eigh(inner)
    span = vectors[:, values > 1e-6 * values[-1]]
    assert all(loss(model.weights + 0.02 * span @ rng.standard_normal((span.shape[1], 2))) > best for _ in range(50))
    assert np.allclose(model.scores([r["text"] for r in rows]), kernel @ model.weights, atol=1e-4)


def test_language_of_very_long_texts(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    model = language_id.train(language_id.training_rows(docs))
    long = {k: " ".join(r.text for r in docs.where(F.col("lang") == k).limit(60).collect()) for k in model.languages}
    rows = spark.createDataFrame([(k, t * 3) for k, t in long.items()], "lang string, text string")
    assert all(r.lang == r.lang_pred for r in language_id.predict(rows, model).collect())


def test_quality_fit_is_the_pairwise_minimum_and_cuts_at_the_quantile():
    rng = np.random.default_rng(4)
    x = rng.standard_normal((300, len(quality_classifier.FEATURES)))
    mark = (x[:, 0] - 0.5 * x[:, 3] + rng.standard_normal(300) > 0.3).astype(int)
    model = quality_classifier.fit(x, mark, epochs=3000)
    w, s = np.array(model.weights), x @ np.array(model.weights)
    good, bad = x[mark == 1], x[mark == 0]
    all_pairs = lambda w: np.log1p(np.exp(-((good @ w)[:, None] - (bad @ w)[None, :]))).mean()
    assert all(all_pairs(w + d) > all_pairs(w) - 1e-3 for d in 0.2 * rng.standard_normal((40, len(w))))
    assert abs(np.mean(s < model.threshold) - np.mean(mark == 0)) <= 1 / 300
    scaled = 1 / (1 + np.exp(-(s - model.threshold) * model.scale - np.log(0.7 / 0.3)))
    assert ((scaled >= quality_classifier.CUT) == (s >= model.threshold)).all()


def test_quality_uses_every_marked_row(spark):
    """The weights are the least loss over all pairs and the cut is the exact quantile; a row outside any sample counts."""
    rng = np.random.default_rng(4)
    x = rng.standard_normal((5000, len(quality_classifier.FEATURES))).round(6)
    mark = (x[:, 0] - 0.5 * x[:, 3] + rng.standard_normal(5000) > 0.3).astype(int)
    rows = spark.createDataFrame([(int(m), v.tolist()) for m, v in zip(mark, x, strict=True)], "label int, x array<double>")
    model = quality_classifier.fit_all(rows)
    w, good, bad = np.array(model.weights), x[mark == 1], x[mark == 0]
    d = (good @ w)[:, None] - (bad @ w)[None, :]
    miss = 1 / (1 + np.exp(d))
    slope = -(miss.sum(1) @ good - miss.sum(0) @ bad) / d.size + quality_classifier.SHRINK * w
    assert np.abs(slope).max() < 1e-4
    s = np.sort(x @ w)
    assert abs(model.threshold - (s[len(bad) - 1] + s[len(bad)]) / 2) < 1e-12
    assert quality_classifier.fit_all(rows.unionByName(rows.where("label = 0"))).threshold > model.threshold + 0.1
    docs = spark.createDataFrame([(i, f"w{i} x") for i in range(5000)], "doc_id bigint, text string")
    marks = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    assert {r[0]: r[1] for r in quality_classifier.marked(docs, marks).groupBy("label").count().collect()} == {0: 2500, 1: 2500}


def greedy(tokens, idf, mean, window):
    """Full windows by the rule alone: seeds in order, unused neighbours by score, a cut document seeds the next."""
    left = {d: [0, len(t)] for d, t in enumerate(tokens)}
    out = []
    for d, t in enumerate(tokens):
        while len(t) - left[d][0] >= window:
            out.append([(d, left[d][0], window)])
            left[d][0] += window
    left = {d: at for d, (at, n) in left.items() if at < n}
    tf = [Counter(t.tolist()) for t in tokens]

    def score(seed, d):
        return sum(idf[w] * tf[d][w] * 2.2 / (tf[d][w] + 1.2 * (0.25 + 0.75 * len(tokens[d]) / mean)) for w in tf[seed] if w in tf[d] and idf[w] > 0)

    seed = None
    while left:
        seed = min(left) if seed is None else seed
        pieces, room, take, order, first, seed = [], window, seed, None, seed, None
        while take is not None:
            n = min(len(tokens[take]) - left[take], room)
            pieces.append((take, left[take], n))
            left[take] += n
            room -= n
            if left[take] == len(tokens[take]):
                del left[take]
            if not room:
                seed = take if take in left else None
                break
            order = iter(sorted(left, key=lambda d: (-round(score(first, d), 9), d))) if order is None else order
            take = next(order, None)
        if room:
            break
        out.append(pieces)
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_packing_fills_greedily(seed):
    rng = np.random.default_rng(seed)
    tokens = [rng.integers(0, 40, rng.integers(1, 90)).astype(np.uint32) for _ in range(50)]
    idf = np.concatenate([np.zeros(4), rng.uniform(0.1, 3, 36)])
    found = [p for p in packing.Shard(tokens, idf, 45.0).windows(64) if sum(x[2] for x in p) == 64]
    want = greedy(tokens, idf, 45.0, 64)
    assert found[: len(want)] == want and sum(x[2] for p in want for x in p) > 0.9 * sum(map(len, tokens)) - 64


def test_token_counts_of_an_empty_table(spark, tmp_path):
    table(spark, DATA, "documents").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert queries.op9_token_counts(spark, str(tmp_path)).count() == 0


def test_url_filters_spread_repeated_rows(spark):
    pages = spark.range(2000).select(F.lit(1).alias("page_id"), F.lit("http://a.com/en/").alias("url"))
    found = url_filters.decide(pages, url_filters.rule_table(spark), salts=16)
    assert found.count() == 2000 and found.where("rule = 'com/en/' and verdict = 'block'").count() == 2000


def test_label_model_and_regression_equal_plain_loops():
    """Expectation-maximisation and the logistic steps, number by number."""
    rng = np.random.default_rng(8)
    truth = rng.random(120) < 0.3
    votes = (rng.random((120, 6)) < np.where(truth[:, None], [0.7, 0.6, 0.6, 0.5, 0.4, 0.1], [0.05, 0.1, 0.1, 0.02, 0.05, 0.8])).astype(float)
    votes[:, 2] = votes[:, 1]  # a copy of a voter
    post, yes, no, copies = toxicity.label_model(votes, toxicity.majority(votes), 6)
    rows, voters = range(120), range(6)
    p, many = [min(max(x, 0.05), 0.95) for x in toxicity.majority(votes)], [1.0] * 6
    for step in range(6):
        a = [(sum(votes[i, j] * p[i] for i in rows) + 0.5) / (sum(p) + 1) for j in voters]
        b = [(sum(votes[i, j] * (1 - p[i]) for i in rows) + 0.05) / (sum(1 - x for x in p) + 1) for j in voters]
        if step == 2:
            rest = [[votes[i, j] - p[i] * a[j] - (1 - p[i]) * b[j] for j in voters] for i in rows]
            size = [math.sqrt(sum(rest[i][j] ** 2 for i in rows)) + 1e-9 for j in voters]
            linked = [[sum(rest[i][j] * rest[i][k] for i in rows) / size[j] / size[k] for k in voters] for j in voters]
            many = [max(1.0, sum(linked[j][k] for j in voters if linked[j][k] > 0.2)) for k in voters]
        prior = min(max(sum(p) / 120, 0.01), 0.99)
        odds = [math.log(prior / (1 - prior)) + sum(math.log(a[j] / b[j]) / many[j] for j in voters if votes[i, j]) + max(sum(math.log((1 - a[j]) / (1 - b[j])) / many[j] for j in voters if not votes[i, j]), -6) for i in rows]
        p = [1 / (1 + math.exp(-min(max(x, -30), 30))) for x in odds]
    assert np.allclose(post, p) and np.allclose(yes, a) and np.allclose(no, b) and np.allclose(copies, many) and copies[1] > 1.5
    assert ((post > 0.5) == truth).mean() > 0.9
    doc, col = np.nonzero(votes[:, :5])
    w = toxicity.regression(doc, col, post, 5, 30, 0.1, 1e-4)
    own, bias, gw, gb = [0.0] * 5, 0.0, [1e-8] * 5, 1e-8
    high = sum(x > 0.5 for x in post)
    each = [0.5 / max(1, high) if x > 0.5 else 0.5 / max(1, 120 - high) for x in post]
    for _ in range(30):
        miss = [(1 / (1 + math.exp(-(sum(own[j] for j in range(5) if votes[i, j]) + bias))) - post[i]) * each[i] for i in rows]
        grad = [sum(miss[i] for i in rows if votes[i, j]) + 1e-4 * own[j] / 120 for j in range(5)]
        gw, gb = [g + x * x for g, x in zip(gw, grad, strict=True)], gb + sum(miss) ** 2
        own = [max(0.0, x - 0.1 * g / math.sqrt(s)) for x, g, s in zip(own, grad, gw, strict=True)]
        bias -= 0.1 * sum(miss) / math.sqrt(gb)
    assert np.allclose(w, own)


def test_toxicity_replaces_a_column_of_the_scores_name(spark, awkward):
    found = toxicity.score(awkward.withColumn("score", F.lit("x")), None)
    assert found.columns == [*awkward.columns, "score"] and {r.score for r in found.collect()} == {0.0}


def test_the_language_sample_is_bounded_whatever_the_tags(spark, monkeypatch):
    monkeypatch.setattr(language_id, "SAMPLE", 40)
    monkeypatch.setattr(language_id, "LANGUAGES", 3)
    docs = spark.range(600).select(F.col("id").alias("doc_id"), F.concat(F.lit("words of "), F.col("id").cast("string")).alias("text"), F.when(F.col("id") < 300, F.concat(F.lit("l"), (F.col("id") % 3).cast("string"))).otherwise(F.concat(F.lit("junk"), F.col("id").cast("string"))).alias("lang"))
    twice = docs.unionByName(docs.withColumn("text", F.concat("text", F.lit("~"))))
    rows = language_id.sample(twice, "doc_id", "text", "lang", 400)
    assert len(rows) <= 39 and {r["label"] for r in rows} == {"l0", "l1", "l2"} and not any(r["text"].endswith("~") for r in rows)
    assert language_id.sample(docs.limit(0), "doc_id", "text", "lang", 400) == []
