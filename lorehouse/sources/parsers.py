"""Originals into fragments: JSON, CSV, Markdown and plain text, with the selectors that point back into the bytes.

The common originals are read by expressions (``native``). Those that need a real grammar go through one Arrow-batched
function per document, ``fragments_of``, which is a dispatch over small helpers; Spark deals out the documents and
everything after the fragments is native again.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import canonical_json, trimmed
from . import native

#: Bounds in bytes, except where named otherwise.
TEXT_BYTES, CHUNK_BYTES, EXCERPT_CHARS, DEEPEST = 4096, 3072, 240, 4
CONTEXT_FIELDS, CONTEXT_LOOKS, CONTEXT_CHARS = 8, 32, 128
FRAGMENT = "kind string, selector string, excerpt string, payload string, text string, context string, structural_only boolean"
KEY = re.compile(r"^(?=.*[^\W_])[\w \t\-./()#]{1,120}$")


def _cut(text: str, most: int = EXCERPT_CHARS) -> str:
    return text if len(text) <= most else text[:most] + "…"


class Raw(str):
    """A JSON number in its own digits."""


def load_json(text: str) -> Any:
    """One JSON value and nothing after it; numbers keep their text, the last of equal keys counts."""

    def refuse(word: str) -> None:
        raise ValueError(word)

    return json.loads(text, parse_int=Raw, parse_float=Raw, parse_constant=refuse)


def _plain(value: Any) -> Any:
    if isinstance(value, Raw):
        return json.loads(value)
    if isinstance(value, dict):
        return {k: _plain(v) for k, v in value.items()}
    return [_plain(v) for v in value] if isinstance(value, list) else value


def scalar_text(value: Any) -> str:
    return {True: "true", False: "false", None: ""}[value] if value is None or isinstance(value, bool) else str(value)


def _encoded(value: Any) -> str:
    return str(value) if isinstance(value, Raw) else json.dumps(value, ensure_ascii=False)


def leaves(value: Any, path: str = "", around: dict | None = None) -> Iterator[tuple[str, Any, dict | None]]:
    """(pointer, scalar, its object) in the order of sorted keys."""
    if isinstance(value, dict):
        for key in sorted(value):
            yield from leaves(value[key], f"{path}/{key.replace('~', '~0').replace('/', '~1')}", {"path": path, "object": value, "key": key})
    elif isinstance(value, list):
        for i, item in enumerate(value):
            yield from leaves(item, f"{path}/{i}", around)
    else:
        yield path, value, around


def _unit(kind: str, selector: dict, payload: Any, text: str, excerpt: str, span: tuple[int, int] | None = None) -> dict:
    return {"kind": kind, "selector": selector, "payload": payload, "text": text, "excerpt": excerpt, "span": span}


def structure(value: str, depth: int = 0) -> list[dict]:
    """Units of a string that is itself JSON, or lines of ``key: value``; none if it is neither."""
    if depth >= DEEPEST:
        return []
    inner = value.strip()
    if len(inner) > 1 and inner[0] in "{[":
        try:
            found = [u for path, leaf, _ in leaves(load_json(inner)) for u in _json_units(path, leaf, depth + 1)]
        except (ValueError, RecursionError):
            found = []
        if found:
            return found
    return _line_units(value, depth)


def _json_units(path: str, leaf: Any, depth: int) -> list[dict]:
    nested = structure(leaf, depth) if isinstance(leaf, str) and not isinstance(leaf, Raw) else []
    if nested:
        return [u | {"selector": {"kind": "json-value-child", "pointer": path, "structure": u["selector"]}, "payload": {"path": path, "value": u["payload"]}} for u in nested]
    return [_unit("parsed-embedded-json-value", {"kind": "json-pointer", "pointer": path}, {"path": path, "value": _plain(leaf)}, scalar_text(leaf), f"{path}: {_encoded(leaf)}")]


def _line_units(value: str, depth: int) -> list[dict]:
    lines, at = [], 0
    for whole in value.split("\n"):
        line = whole.strip()
        if line:
            key, colon, item = (part.strip() for part in line.partition(":"))
            if not colon or not KEY.match(key) or not item:
                return []
            start = at + len(whole[: whole.index(line)].encode())
            lines.append((key, item, line, (start, start + len(line.encode()))))
        at += len(whole.encode()) + 1
    if len(lines) < 2:
        return []
    out = []
    for key, item, line, span in lines:
        for u in structure(item, depth + 1) or [None]:
            if u is None:
                out.append(_unit("parsed-key-value", {"kind": "key-value", "key": key}, {"key": key, "value": item}, line, line, span))
            else:
                out.append(_unit(u["kind"], {"kind": "key-value-child", "key": key, "structure": u["selector"]}, {"key": key, "value": u["payload"]}, f"{key}: {u['text']}", f"{key}: {u['excerpt']}", span))
    return out


def _fragment(kind: str, selector: dict, excerpt: str, payload: Any, text: str = "", context: dict | None = None, structural: bool = False) -> dict:
    return {"kind": kind, "selector": selector, "excerpt": excerpt, "payload": payload, "text": text, "context": context, "structural_only": structural}


def _children(units: list[dict], base: dict, context: dict | None) -> list[dict]:
    kind = {"table-cell": "table-cell-child"}.get(base["kind"], base["kind"])
    return [_fragment(u["kind"], base | {"kind": kind, "child": i, "structure": u["selector"]}, _cut(u["excerpt"]), u["payload"], u["text"], context) for i, u in enumerate(units, 1)]


def _siblings(fields: list[tuple[str, Any]]) -> dict:
    """The first few short, plain scalars beside a value."""
    fits = {k: _plain(v) for k, v in fields[:CONTEXT_LOOKS] if not isinstance(v, (dict, list)) and len(scalar_text(v)) <= CONTEXT_CHARS and not (isinstance(v, str) and not isinstance(v, Raw) and structure(v))}
    return dict(list(fits.items())[:CONTEXT_FIELDS])


def json_fragments(text: str) -> list[dict] | None:
    try:
        value = load_json(text)
    except (ValueError, RecursionError):
        return None
    out = []
    for path, leaf, around in leaves(value):
        context = None
        if around:
            fields = _siblings([(k, around["object"][k]) for k in sorted(around["object"]) if k != around["key"]])
            context = {"kind": "json-object-context", "pointer": around["path"], "fields": fields} if fields else None
        units = structure(leaf) if isinstance(leaf, str) and not isinstance(leaf, Raw) else []
        out.append(_fragment("parsed-json-value", {"kind": "json-pointer", "pointer": path}, f"{path}: {_encoded(leaf)}", {"path": path, "value": _plain(leaf)}, scalar_text(leaf), context, bool(units)))
        out += _children(units, {"kind": "json-string-child", "pointer": path}, context)
    return out


FIELD = re.compile(r'"((?:[^"]|"")*)"(?=,|\r?\n|\Z)|([^",\r\n]*)(?=,|\r?\n|\Z)')


def csv_records(text: str) -> list[tuple[int, list[tuple[str, int, int]]]] | None:
    """(line, [(value, line, column)]) of each record by RFC 4180; None if a quote or a record's width is wrong."""
    out, record, at, line, begin, first = [], [], 0, 1, 0, 1
    while at <= len(text):
        if not record and at < len(text) and text[at] in "\r\n":  # a blank line is no record
            at += 2 if text.startswith("\r\n", at) else 1
            line, begin, first = line + 1, at, line + 1
            continue
        if not record and at == len(text):
            break
        m = FIELD.match(text, at)
        if not m:
            return None
        value = m[1].replace('""', '"').replace("\r\n", "\n") if m[1] is not None else m[2]
        record.append((value, line, len(text[begin:at].encode()) + 1))
        line += m[0].count("\n")
        if "\n" in m[0]:
            begin = m.start() + m[0].rindex("\n") + 1
        at = m.end()
        if text.startswith(",", at):
            at += 1
            continue
        out.append((first, record))
        at += 2 if text.startswith("\r\n", at) else 1
        record, line, begin = [], line + 1, at
        first = line
    return out if out and len({len(r) for _, r in out}) == 1 else None


def csv_fragments(text: str) -> list[dict] | None:
    records = csv_records(text)
    if not records:
        return None
    names = [v for v, _, _ in records[0][1]]
    named = "" not in names and len(set(names)) == len(names)
    out = [_fragment("parsed-table-header", {"kind": "table-row", "row": 1, "source_line": records[0][0]}, ", ".join(names), {"row": 1, "values": names})]
    for row, (first, record) in enumerate(records[1:], 2):
        values = [v for v, _, _ in record]
        payload = {"row": row, "values": values} | ({"columns": dict(zip(names, values, strict=True))} if named else {})
        out.append(_fragment("parsed-table-row", {"kind": "table-row", "row": row, "source_line": first}, ", ".join(values), payload, " ".join(values), None, True))
        for k, (value, at_line, at_column) in enumerate(record):
            if not value.strip():
                continue
            selector = {"kind": "table-cell", "row": row, "column_index": k + 1, "source_line": at_line, "source_column": at_column} | ({"column": names[k]} if names[k] else {})
            fields = _siblings([(names[j] or str(j + 1), v) for j, v in enumerate(values) if j != k and v.strip()])
            context = {"kind": "table-record-context", "row": row, "fields": fields} if fields else None
            units = structure(value)
            if units:
                out += _children(units, selector, context)
            else:
                label = names[k] or f"column {k + 1}"
                out.append(_fragment("parsed-table-cell", selector, _cut(f"{label}: {value}"), {"row": row, "column": names[k], "column_index": k + 1, "value": value}, value, context))
    return out


def _block(kind: str, raw: str, start: int) -> list[dict]:
    """A trimmed block at its bytes, with the units of its structure, cut where it is over the bound."""
    inner = raw.strip()
    if not inner:
        return []
    start += len(raw[: raw.index(inner)].encode())
    units = structure(inner) if kind == "text-block" else []
    span = lambda a, b: {"kind": "utf8-byte-range", "start": a, "end": b}
    out, data, at = [], inner.encode(), 0
    while at < len(data):
        end = min(at + TEXT_BYTES, len(data))
        while end < len(data) and data[end] & 0xC0 == 0x80:
            end -= 1
        piece = data[at:end].decode()
        out.append(_fragment(kind, span(start + at, start + end), _cut(piece), {"text": piece}, piece, None, bool(units)))
        at = end
    for i, u in enumerate(units, 1):
        a, b = u["span"] or (0, len(data))
        out.append(_fragment(u["kind"], {"kind": "text-block-child", "child": i, "start": start + a, "end": start + b, "structure": u["selector"]}, _cut(u["excerpt"]), u["payload"], u["text"]))
    return out


def text_fragments(text: str, start: int = 0) -> list[dict]:
    out = []
    for raw in text.split("\n\n"):
        out += _block("text-block", raw, start)
        start += len(raw.encode()) + 2
    return out


HEADING = re.compile(r"^(\s*#{1,6}\s+)(.*\S)\s*$")


def markdown_fragments(text: str) -> list[dict]:
    out, held, begin, at = [], "", 0, 0
    for line in [*text.split("\n"), ""]:
        heading = HEADING.match(line)
        if heading or not line.strip():
            out += _block("text-block", held, begin)
            held = ""
            if heading:
                out += _block("markdown-heading", heading[2], at + len(heading[1].encode()))
        else:
            begin = begin if held else at
            held += line + "\n"
        at += len(line.encode()) + 1
    return out


def fragments_of(parser: str, content: bytes) -> list[dict]:
    """Fragments of one original. Content that its own parser refuses is read as plain text; bytes that are no UTF-8 fail."""
    mark = content.startswith(b"\xef\xbb\xbf")
    text = content.decode("utf-8-sig")
    found = {"json": json_fragments, "csv": csv_fragments, "markdown": markdown_fragments}.get(parser, lambda t: None)(text)
    out = text_fragments(text) if found is None else found
    for f in out if mark else ():
        for end in ("start", "end"):
            if end in f["selector"]:
                f["selector"][end] += 3
    return out


def parse(originals: DataFrame, id_col: str = "original_id", parser_col: str = "parser", content_col: str = "content") -> DataFrame:
    """(id, ordinal, fragment columns): all fragments of each original, in order. Selectors and payloads are canonical JSON.

    Flat JSON, plain CSV and plain text are read by expressions; only the other originals go through Python.
    """
    rows = originals.select(F.col(id_col).alias("original_id"), F.col(parser_col).alias("parser"), F.col(content_col).cast("binary").alias("content"))
    # A generator, so that the optimiser cannot copy the route's tests into each of its uses.
    routed = rows.select("*", F.explode(F.array(native.route(F.col("parser"), F.col("content")))).alias("route"))
    told = routed.where("route is not null").select("original_id", F.posexplode(native.fragments(F.col("route"), F.col("content"))).alias("ordinal", "f"))
    return told.select("original_id", "ordinal", "f.*").unionByName(by_grammar(routed.where("route is null")))


def by_grammar(rows: DataFrame) -> DataFrame:
    """Fragments of originals (original_id, parser, content) by the parsers of this module, in Arrow batches."""
    as_json = lambda x: None if x is None else canonical_json(x)
    names = ["original_id", "ordinal", *(c.split()[0] for c in FRAGMENT.split(", "))]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind, held = batch.column(0).type, []
            arrays = lambda rows, kind=kind: [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (kind, pa.int32(), *[pa.string()] * 6, pa.bool_()), strict=True)]
            for source, parser, content in zip(*[batch.column(k).to_pylist() for k in range(3)], strict=True):
                for i, f in enumerate(fragments_of(parser, content or b"")):
                    held.append((source, i, f["kind"], as_json(f["selector"]), f["excerpt"], as_json(f["payload"]), f["text"], as_json(f["context"]), f["structural_only"]))
                if len(held) >= 5000:
                    yield pa.RecordBatch.from_arrays(arrays(held), names=names)
                    held = []
            if held:
                yield pa.RecordBatch.from_arrays(arrays(held), names=names)

    return rows.select("original_id", "parser", "content").mapInArrow(of, f"original_id {rows.schema['original_id'].dataType.simpleString()}, ordinal int, {FRAGMENT}")


def text_blocks(texts: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """(id, pos, start, end, text): non-empty trimmed blocks between blank lines, at their bytes, natively.

    The running byte offset is inside the row: blocks of one text are an array, so nothing is shuffled.
    """
    parts = F.split(F.coalesce(F.col(text_col), F.lit("")), "\n\n")
    starts = F.aggregate("parts", F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<bigint>").alias("all")), lambda s, p: F.struct((s["at"] + F.octet_length(p) + 2).alias("at"), F.concat(s["all"], F.array(s["at"])).alias("all")))
    held = texts.select(F.col(id_col), F.explode(F.array(parts)).alias("parts")).select(id_col, F.explode(F.array(F.arrays_zip("parts", starts["all"].alias("starts")))).alias("z"))
    rows = held.select(id_col, F.posexplode("z").alias("pos", "b")).select(id_col, "pos", F.col("b.parts").alias("raw"), F.col("b.starts").alias("at"))
    inner = rows.withColumn("text", trimmed(F.col("raw"))).where("text <> ''")
    start = F.col("at") + F.octet_length(F.regexp_extract("raw", r"(?U)^(\s*)", 1))
    return inner.select(id_col, "pos", start.alias("start"), (start + F.octet_length("text")).alias("end"), "text")


def retrieval_parts(text: str) -> list[str]:
    """Parts of at most ``CHUNK_BYTES`` bytes, cut at the last blank of the second half where there is one."""
    rest, out = text.strip(), []
    while len(data := rest.encode()) > CHUNK_BYTES:
        head = data[:CHUNK_BYTES].decode("utf-8", "ignore")
        blank = max(head.rfind(c) for c in " \t\r\n")
        end = blank if blank >= 0 and len(head[:blank].encode()) >= CHUNK_BYTES // 2 else len(head)
        if part := rest[:end].strip():
            out.append(part)
        rest = rest[end:].strip()
    return [*out, rest] if rest else out


@F.pandas_udf(T.ArrayType(T.StringType()))
def split_for_retrieval(texts: pd.Series) -> pd.Series:
    return texts.fillna("").map(retrieval_parts)


def parts_for_retrieval(text: Column) -> Column:
    """The parts of a text as an array. Texts that fit into one part stay in the JVM; Python gets null in their place."""
    plain = trimmed(F.coalesce(text, F.lit("")))
    short = F.octet_length(plain) <= CHUNK_BYTES
    return F.when(short, F.filter(F.array(plain), lambda x: x != "")).otherwise(split_for_retrieval(F.when(~short, plain)))


def retrieval_text(kind: Column, payload: Column, number_text: bool = True) -> Column:
    """The text that a fragment contributes to search; null for kinds that contribute none."""
    value = F.get_json_object(payload, "$.value")
    path = F.get_json_object(payload, "$.path")
    columns = F.from_json(F.get_json_object(payload, "$.columns"), "map<string,string>")
    values = F.from_json(F.get_json_object(payload, "$.values"), "array<string>")
    pairs = F.transform(F.array_sort(F.map_entries(columns)), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    shown = F.coalesce(value, F.lit("")) if number_text else F.when(F.schema_of_variant(F.try_parse_json(payload)).contains("STRING"), value).otherwise("")
    return (
        F.when(kind.isin("text-block", "markdown-heading"), F.get_json_object(payload, "$.text"))
        .when(kind == "parsed-json-value", F.when(path != "", F.concat(path, F.lit(": "), shown)).otherwise(shown))
        .when(kind.isin("parsed-table-header", "parsed-table-row"), F.when(F.size(columns) > 0, F.array_join(pairs, "; ")).otherwise(F.array_join(values, ", ")))
    )




def fragment_text(kind: Column, payload: Column) -> Column:
    """The text that a stored fragment had, from its payload."""
    at = lambda p: F.get_json_object(payload, p)
    values = F.from_json(at("$.values"), "array<string>")
    return (
        F.when(kind.isin("text-block", "markdown-heading"), at("$.text"))
        .when(kind == "parsed-table-row", F.array_join(values, " "))
        .when(kind == "parsed-table-header", "")
        .when(kind == "parsed-key-value", F.concat(at("$.key"), F.lit(": "), at("$.value")))
        .otherwise(F.coalesce(at("$.value"), F.lit("")))
    )


def rehydrated(observations: DataFrame, evidence: DataFrame) -> DataFrame:
    """(original_id, observation_id, kind, selector, payload, text, evidence_id): fragments again, from what the extraction
    stored. Observations of other producers, or with several pieces of evidence, are none; missing evidence fails."""
    from ..operators.jobs import EXTRACTION

    own = observations.where((F.col("producer") == EXTRACTION) & (F.size("evidence_ids") == 1)).withColumn("evidence_id", F.col("evidence_ids")[0])
    found = own.join(evidence.select("evidence_id", "original_id", "selector", F.lit(True).alias("_there")), "evidence_id", "left")
    found = found.where(F.assert_true(F.col("_there").isNotNull(), F.lit("an observation refers to missing evidence")).isNull())
    return found.select("original_id", "observation_id", "kind", "selector", "payload", fragment_text(F.col("kind"), F.col("payload")).alias("text"), "evidence_id")


def chunks(observations: DataFrame, evidence: DataFrame, originals: DataFrame | None = None) -> DataFrame:
    """(original_id, chunk_id, observation_id, evidence_id, selector, text, producer): what search sees of observations.

    Observations are (observation_id, kind, payload, evidence_ids, producer), evidence is (evidence_id, original_id, selector).
    Only those of the extraction with one piece of evidence count; evidence that is missing fails the query. With the
    published ``originals`` (original_id, hash) evidence has a ``hash`` too, and what rests on other bytes than the original has
    now is left out.
    """
    from ..operators.index import chunk_id
    from ..operators.jobs import EXTRACTION

    told = observations.where((F.col("producer") == EXTRACTION) & (F.size("evidence_ids") == 1))
    told = told.select("observation_id", "producer", F.col("evidence_ids")[0].alias("evidence_id"), retrieval_text(F.col("kind"), F.col("payload")).alias("text")).where(trimmed(F.col("text")) != "")
    hash_ = F.lit(None).cast("string") if originals is None else F.col("hash")
    found = told.join(evidence.select("evidence_id", "original_id", "selector", hash_.alias("_hash"), F.lit(True).alias("_there")), "evidence_id", "left")
    found = found.where(F.assert_true(F.col("_there").isNotNull(), F.lit("an observation refers to missing evidence")).isNull()).drop("_there")
    if originals is not None:
        found = found.join(originals.select("original_id", F.col("hash").alias("_hash")), ["original_id", "_hash"], "left_semi")
    parts = found.withColumn("parts", parts_for_retrieval(F.col("text")))
    spread = parts.select("original_id", "observation_id", "evidence_id", "selector", "producer", F.posexplode("parts").alias("part", "text"))
    return spread.select("original_id", chunk_id(F.col("observation_id"), F.col("evidence_id"), F.col("part")).alias("chunk_id"), "observation_id", "evidence_id", "selector", "text", "producer")
