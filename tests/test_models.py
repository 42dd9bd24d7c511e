"""Connectors against deterministic transports, and recovery within a budget."""

import json
import random

import pytest
from lorehouse.operators import archive, knowledge, models
from lorehouse.streaming import reconcile

FULL = {"entities": [], "attributes": [], "relationships": []}


def answering(*contents, refuse=False):
    asked = []

    def transport(path, request):
        asked.append((path, request))
        if refuse and request.get("response_format", {}).get("type") == "json_schema":
            raise LookupError("response_format")
        return {"choices": [{"message": {"content": contents[min(len(asked), len(contents)) - 1]}, "finish_reason": "stop"}]}

    return transport, asked


def test_extractor_asks_for_a_schema_then_for_json():
    good = json.dumps({"fragments": [{"id": "1"} | FULL]})
    transport, asked = answering(good, refuse=True)
    m = models.ChatExtractor(transport, "m", "1", "system", 1000)
    assert m.extract([("1", "text")]) == {"1": FULL} and [r["response_format"]["type"] for _, r in asked] == ["json_schema", "json_object"]
    with pytest.raises(knowledge.ContractError):
        m.extract([("1", "x" * 2000)])
    for bad in ("{", "[]", good + " x", json.dumps({"fragments": [{"id": "1"} | FULL] * 2}), json.dumps({"fragments": [], "more": 1}), json.dumps({"fragments": [{"id": "1"}]})):
        with pytest.raises(knowledge.ContractError):
            models.decoded(bad)
    with pytest.raises(ValueError):
        models.ChatExtractor(transport, "", "1", "s", 10)
    cut = models.ChatExtractor(lambda p, r: {"choices": [{"message": {"content": "x"}, "finish_reason": "length"}]}, "m", "1", "s", 99)
    with pytest.raises(knowledge.ContractError):
        cut.complete("s", "t")


def test_embedder_orders_and_checks():
    data = [{"index": 1, "embedding": [0.0, 2.0]}, {"index": 0, "embedding": [1.0, 0.0]}]
    assert models.Embedder(lambda p, r: {"data": data}, "m", 2)(["a", "b"]) == [[1.0, 0.0], [0.0, 2.0]]
    for rows in (data[:1], [data[0], data[0]], [data[0], {"index": 0, "embedding": [0.0, 0.0]}], [data[0], {"index": 0, "embedding": [1.0]}], [data[0], {"index": 0, "embedding": [float("nan"), 1.0]}]):
        with pytest.raises(knowledge.ContractError):
            models.Embedder(lambda p, r, rows=rows: {"data": rows}, "m", 2)(["a", "b"])
    with pytest.raises(knowledge.ContractError):
        models.Embedder(lambda p, r: {}, "m", 2)(["a"] * 129)


def test_addresses_stay_here():
    assert models.local("http://localhost:1/") == "http://localhost:1"
    for url in ("http://example.org", "ftp://localhost", "localhost"):
        with pytest.raises(ValueError):
            models.local(url)


def test_halves_share_one_budget():
    entity = {"ref": "r", "label": "l", "type": "", "confidence": 1.0}

    def model(asked):
        if len(asked) > 1:
            raise knowledge.ContractError("too long")
        return {asked[0][0]: FULL | {"entities": [entity] * 70}}

    with pytest.raises(knowledge.ContractError, match="70 candidates; 58 remain"):
        knowledge.recovered([("1", "a"), ("2", "b")], model)
    assert knowledge.recovered([("1", "a"), ("2", "b")], model, budget=knowledge.Budget(candidates=140))["2"]["entities"]
    with pytest.raises(knowledge.ContractError):
        knowledge.check_answer([("1", "a")], {"1": {"other": []}})


def test_batches_count_contexts_once_and_structure_never():
    context = [("c", 30)] * 4
    assert knowledge.batches_of([10, 10, 10, 10], context, [False] * 4, 5 + 30 + knowledge.CONTEXTS + 10 + 1 + 10, 5) == [0, 0, 1, 1]
    assert knowledge.batches_of([10, 99, 10], [None] * 3, [False, True, False], 25, 0) == [0, 0, 0]
    assert knowledge.batches_of([99, 1], [None] * 2, [False] * 2, 25, 0) == [0, 1]


def test_batches_are_cut_by_the_encoded_input(spark):
    """Batches as if each candidate's input were assembled and encoded whole."""
    rnd = random.Random(5)
    rows = []
    for k in range(60):
        text = rnd.choice(["plain", "a < b & c > d", "é\u2028\u2029", "  ", 'quote " back \\', "tab\t"]) * rnd.randrange(1, 6)
        context = json.dumps({"kind": "heading", "payload": {"text": f"<{k // 7}>"}, "selector": {"n": k // 7}}, separators=(",", ":")) if k % 5 else None
        rows.append((f"s{k % 2}", k, "A & <B>", "text/x", "text-block", json.dumps({"n": k}, separators=(",", ":")), json.dumps({"text": text}, ensure_ascii=False, separators=(",", ":")), text, context, k % 11 == 0))
    df = spark.createDataFrame(rows, "original_id string, ordinal int, title string, mime string, kind string, selector string, payload string, text string, context string, structural_only boolean")
    ids = {(r.original_id, r.ordinal): (r._entry[16:80], r._context) for r in knowledge.model_input(df).collect()}

    def encoded(group):
        out = {"title": "A & <B>", "mime": "text/x"}
        told = {ids[r[:2]][1]: r[8] for r in group if r[8]}
        if told:
            out["contexts"] = [{"context_id": i} | json.loads(c) for i, c in told.items()]
        out["fragments"] = [{"fragment_id": ids[r[:2]][0], "kind": r[4], "selector": json.loads(r[5])} | ({"parent_context_id": ids[r[:2]][1]} if r[8] else {}) | {"payload": json.loads(r[6])} for r in group]
        text = json.dumps(out, ensure_ascii=False, separators=(",", ":"))
        for mark in "<>&\u2028\u2029":
            text = text.replace(mark, f"\\u{ord(mark):04x}")
        return len(text.encode())

    want = {}
    for source in ("s0", "s1"):
        batch, now, begun = 0, [], False
        for r in (r for r in rows if r[0] == source):
            silent = r[9] or not r[7].strip()
            if not silent and begun and encoded([*now, r]) > 900:
                batch, now = batch + 1, []
            now, begun = now if silent else [*now, r], True
            want[r[:2]] = batch
    assert {(r.original_id, r.ordinal): r.batch for r in knowledge.batched(df, 900).collect()} == want and max(want.values()) > 3


def test_small_rules(spark):
    assert reconcile.contained(lambda: 1 / 0).startswith("ZeroDivisionError") and reconcile.contained(lambda: 1) == ""
    draft = spark.createDataFrame([(0, "a"), (1, "b")], "position int, name string")
    assert [r.name for r in archive.remaining(draft, spark.createDataFrame([(0,)], "position int")).collect()] == ["b"]
    assert archive.status_rows(archive.status_text(draft), "position int, name string").count() == 2


def test_stream_forgets_deleted_originals(spark, tmp_path):
    rows = [("s1", "a.json", "application/json", bytearray(b'{"a": 1}')), ("s2", "p.png", "image/png", bytearray(b"\x89PNG")), ("s3", "n.txt", "text/plain", bytearray(b"\xff"))]
    spark.createDataFrame(rows, reconcile.ORIGINAL).write.parquet(str(tmp_path / "in"))
    reconcile.publish(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    told = {r.original_id: (r.state, r.reason) for r in reconcile.latest(spark, str(tmp_path / "out")).collect()}
    assert told == {"s1": ("ready", None), "s2": ("skipped", "unsupported_content"), "s3": ("failed", "invalid_utf8")}
    one = reconcile.latest(spark, str(tmp_path / "out")).where("original_id = 's1'").first()
    manifest = lambda deleted: spark.createDataFrame([("s1", one["hash"], "a.json", "application/json", deleted)], "id string, hash string, title string, mime string, deleted boolean")
    count = lambda *a: reconcile.published(spark, str(tmp_path / "out"), *a).count()
    assert (count(), count(manifest(False)), count(manifest(True))) == (1, 1, 0)
