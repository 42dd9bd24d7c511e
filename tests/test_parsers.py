import json

import pytest

from lorehouse.sources import dispatch
from lorehouse.sources import parsers as P
from pyspark.sql import functions as F


def kinds(parser, content):
    return [f["kind"] for f in P.fragments_of(parser, content)]


def test_kinds():
    assert kinds("json", b'{"boat":{"mast":"pine","oars":[2,null]}}') == ["parsed-json-value"] * 3
    assert kinds("csv", b"harbour,depth\nMolde,11\nBergen,\n") == ["parsed-table-header", "parsed-table-row", "parsed-table-cell", "parsed-table-cell", "parsed-table-row", "parsed-table-cell"]
    assert kinds("markdown", b"Intro line\n## Tides\nhigh at noon\n\n#no heading") == ["text-block", "markdown-heading", "text-block", "text-block"]
    assert kinds("csv", b'depth\n"eleven') == ["text-block"] and kinds("json", b"[1, 2") == ["text-block"]
    assert kinds("text", b"") == [] and kinds("text", b" \n\n\t") == []


def test_csv_quotes():
    assert [v for v, _, _ in P.csv_records('k,v\n"rope, 4 m","""tarred"", old"\n')[1][1]] == ["rope, 4 m", '"tarred", old']
    record = P.csv_records('p,q,r\n"wind\r\nand rain",,z\r\n')[1]
    assert record[0] == 2 and [v for v, _, _ in record[1]] == ["wind\nand rain", "", "z"]
    assert P.csv_records("p,q\n7\n") is None and P.csv_records('p\nm"n\n') is None


def test_cell_with_lines_is_split():
    cell = "\n".join(f"k{i}: v{i}" for i in range(6))
    found = P.fragments_of("csv", f'Ship,Log\nSvan,"{cell}"\n'.encode())
    lines = [f for f in found if f["kind"] == "parsed-key-value"]
    assert [f["payload"]["key"] for f in lines] == [f"k{i}" for i in range(6)]
    assert all(f["selector"]["row"] == 2 and f["selector"]["column"] == "Log" and f["context"] for f in lines)


def test_json_structure_and_refusals():
    found = P.json_fragments('{"log":"wind: 4\\nsea: 2","nested":"{\\"Port\\": \\"Vardo\\"}","prose":"x","n":1.10,"none":null}')
    assert [f["structural_only"] for f in found if f["kind"] == "parsed-json-value"] == [True, False, True, False, False]
    assert next(f["text"] for f in found if f["selector"].get("pointer") == "/n") == "1.10"
    assert P.json_fragments("{} x") is None and P.json_fragments("NaN") is None and P.json_fragments('{"a":[]}') == []


@pytest.mark.parametrize(("name", "text"), [("text", "\ufeff\n\n" + "ø" * 5000 + " end\t"), ("markdown", "\n ### Log \n first line\nsecond\n\n last"), ("text", "\n Port: Vardo\n\tMaster: unknown\n Tons: 40 \n\nafter")])
def test_ranges_slice_back(name, text):
    data = text.encode()
    for f in P.fragments_of(name, data):
        cut = data[f["selector"]["start"] : f["selector"]["end"]].decode()
        assert cut == f["text"] and len(cut.encode()) <= P.TEXT_BYTES


def test_large_structured_value_is_one_child():
    found = P.fragments_of("text", json.dumps({"value": "å" * 4096}, ensure_ascii=False).encode())
    children = [f for f in found if not f["structural_only"]]
    assert len(children) == 1 and children[0]["selector"]["kind"] == "text-block-child" and children[0]["text"] == "å" * 4096


def test_retrieval_parts():
    parts = P.retrieval_parts("å" * 6144)
    assert len(parts) >= 2 and "".join(parts) == "å" * 6144 and max(len(p.encode()) for p in parts) <= P.CHUNK_BYTES
    words = P.retrieval_parts("word " * 2000)
    assert all(not p.startswith(" ") and p.split()[-1] == "word" for p in words)


def test_native_blocks_equal_parser(spark):
    texts = ["a\n\nb\n\n\nc", "  x  \n\n \n\n å y ", "", "one"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    native = sorted((r.id, r.start, r.end, r.text) for r in P.text_blocks(df, "id").collect())
    plain = sorted((i, f["selector"]["start"], f["selector"]["end"], f["text"]) for i, t in enumerate(texts) for f in P.text_fragments(t))
    assert native == plain


def test_expressions_equal_the_grammar(spark):
    texts = [
        ("json", '{"b": 12, "a": "x y", "c/~d": null, "e": true}'), ("json", '{"n": 1.10}'), ("json", '{"a": "{1}"}'), ("json", ' {"only" : -3 }\n'), ("json", '{"a": 1, "a": 2}'), ("json", "{}"), ("json", '{"a": [1]}'), ("json", '{"a": "q\\"z"}'),
        ("json", "{" + ", ".join(f'"k{i:02}": "{"v" * (i * 9)}"' for i in range(40)) + "}"), ("json", '{"a": 01}'), ("json", '{"a": -0}'), ("json", "12"),
        ("csv", "p,q,r\n1, ,three\n\n4,ø,\\back\n"), ("csv", "p,q\n1\n"), ("csv", 'p,q\n"1",2\n'), ("csv", "p,p\n1,2\n"), ("csv", "p,\n1,2\n"), ("csv", "p,q\r\n1,2\r\n"), ("csv", "p,q\n[1],2\n"), ("csv", "p"), ("csv", ""), ("csv", "\n\np,q\n\n7,8"),
        ("csv", ",".join(f"c{i}" for i in range(40)) + "\n" + ",".join("w" * i for i in range(40)) + "\n"), ("csv", "p,q\nkey: v,w\n"), ("csv", "p,q\n" + "x" * 300 + ",\u00a0\n"),
        ("text", "one\n\n  two lines\nhere \n\n\n\u00a0\n\nthree ø"), ("text", "k: v\nl: w"), ("text", "k: v\nno pair"), ("text", "k: v"), ("text", '{"a": 1}'), ("text", "[no json"), ("text", "x" * 5000), ("text", 'q"uo\\te\ttab'), ("text", "a\x01b"), ("text", "\ufeffmark"), ("text", ""),
        ("text", "a:b\nc:d\n\nplain"), ("text", ": v\n: w"), ("text", "k:\nl: w"), ("markdown", "# h\n\nbody"),
    ]
    rows = spark.createDataFrame([(i, p, bytearray(t.encode())) for i, (p, t) in enumerate(texts)], "original_id int, parser string, content binary")
    told, plain = P.parse(rows), P.by_grammar(rows)
    key = lambda df: sorted(tuple(map(str, r)) for r in df.select(*plain.columns).collect())
    assert key(told) == key(plain)
    routed = rows.select("original_id", P.native.route(rows.parser, rows.content).alias("r")).where("r is not null")
    assert {texts[r.original_id][0] for r in routed.collect()} == {"json", "csv", "text"} and 12 < routed.count() < len(texts) - 12


def test_parts_stay_in_the_jvm_where_they_fit(spark):
    texts = [None, "", " \t\n", "short", "  a b ", "x" * 3072, "é" * 1536, "é" * 1537, "word " * 2000, "\u2003" * 1200 + "end", "y" * 9000]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    found = {r.k: r.p for r in df.select("k", P.parts_for_retrieval(F.col("t")).alias("p")).collect()}
    assert found == {k: P.retrieval_parts(t or "") for k, t in enumerate(texts)}


def test_chunks_rest_on_the_bytes_that_are_there(spark):
    o = spark.createDataFrame([(f"o{k}", "text-block", '{"text":"said"}', [f"e{k}"], "format-extraction/1") for k in range(3)], "observation_id string, kind string, payload string, evidence_ids array<string>, producer string")
    e = spark.createDataFrame([("e0", "s", "{}", "h1"), ("e1", "s", "{}", "h0"), ("e2", "gone", "{}", "h1")], "evidence_id string, original_id string, selector string, hash string")
    now = spark.createDataFrame([("s", "h1")], "original_id string, hash string")
    assert {r.observation_id for r in P.chunks(o, e, now).collect()} == {"o0"} and P.chunks(o, e).count() == 3


def test_bytes_that_are_no_text_fail(spark):
    with pytest.raises(UnicodeDecodeError):
        P.fragments_of("text", b"a\xff")
    mimes = spark.createDataFrame([(" Text/Plain\t\n; charset=x",), ("\u00a0application/json",)], "m string")
    assert [r.m for r in mimes.select(dispatch.plain_mime(F.col("m")).alias("m")).collect()] == ["text/plain", "application/json"]
