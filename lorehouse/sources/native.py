"""Common originals into fragments by expressions alone: flat JSON objects, plain CSV and plain text.

``route`` tells which originals these are; nested JSON, quoted CSV, Markdown and values with a structure of their own go to
the parsers that know their grammar, with the same fragments for the same bytes.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import pointer_escape, trimmed, truncate

#: Bounds in bytes of a text block, characters of an excerpt and of a neighbour's value, and its neighbours.
TEXT_BYTES, EXCERPT_CHARS, CONTEXT_CHARS, CONTEXT_LOOKS, CONTEXT_FIELDS = 4096, 240, 128, 32, 8
FRAGMENTS = "array<struct<kind:string,selector:string,excerpt:string,payload:string,text:string,context:string,structural_only:boolean>>"
#: Characters whose JSON escapes differ between writers, and a flat object of plain strings, whole numbers and words.
_ODD = "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F-\\x9F\u2028\u2029\ufeff\ufffd]"
_SCALAR = r'"[^"\\\{\}\[\]\x00-\x1F]*"|0|-?[1-9][0-9]{0,17}|true|false|null'
_MEMBER = rf'[ \t\r\n]*"([^"\\\x00-\x1F]*)"[ \t\r\n]*:[ \t\r\n]*({_SCALAR})[ \t\r\n]*'
_FLAT = rf"^[ \t\r\n]*\{{{_MEMBER}(?:,{_MEMBER})*+\}}[ \t\r\n]*$"
#: A line of ``key: value``; blocks of such lines have a structure.
_PAIR = r"^(?=[^:]*[\p{L}\p{N}])[\p{L}\p{N}\p{M}_ \t\-./()#]{1,124}:(?U)\s*\S"


def _fragment(kind: str, selector: Column, excerpt: Column, payload: Column, text: Column, context: Column, structural: bool) -> Column:
    return F.struct(F.lit(kind).alias("kind"), selector.alias("selector"), excerpt.alias("excerpt"), payload.alias("payload"), text.alias("text"), context.alias("context"), F.lit(structural).alias("structural_only"))


def route(parser: Column, content: Column) -> Column:
    """json, csv or text for originals that the expressions here read, else null."""
    text = content.cast("string")
    clean = F.is_valid_utf8(text) & ~text.rlike(_ODD)
    keys = F.regexp_extract_all(text, F.lit(_MEMBER), F.lit(1))
    json = text.rlike(_FLAT) & (F.size(keys) == F.size(F.array_distinct(keys)))
    lines = F.filter(F.split(text, "\n"), lambda x: x != "")
    width = F.size(F.split(F.get(lines, F.lit(0)), ",", -1))
    names = F.split(F.get(lines, F.lit(0)), ",", -1)
    even = (F.size(lines) > 0) & F.forall(lines, lambda x: F.size(F.split(x, ",", -1)) == width)
    csv = even & ~text.rlike("[\"\\r]") & ~text.rlike(r"(?:^|[,\n])(?U)\s*[\{\[]") & (F.size(names) == F.size(F.array_distinct(names))) & ~F.array_contains(names, "")
    blocks = F.filter(F.transform(F.split(text, "\n\n"), trimmed), lambda b: b != "")
    structured = lambda b: b.rlike(r"^[\{\[]") | (F.contains(b, F.lit("\n")) & F.forall(F.filter(F.transform(F.split(b, "\n"), trimmed), lambda x: x != ""), lambda x: x.rlike(_PAIR)))
    plain = F.forall(blocks, lambda b: (F.octet_length(b) <= TEXT_BYTES) & ~structured(b))
    own = F.when(parser == "json", json).when(parser == "csv", csv).when(parser == "text", plain)
    return F.when(F.coalesce(clean & own, F.lit(False)), parser)


def _as_json(text: Column) -> Column:
    """A clean string as a JSON string."""
    escaped = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    for raw, short in (("\n", "\\n"), ("\t", "\\t"), ("\r", "\\r")):
        escaped = F.replace(escaped, F.lit(raw), F.lit(short))
    return F.concat(F.lit('"'), escaped, F.lit('"'))


def _join(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _context(fields: Column, head: str, tail: Column | str) -> Column:
    """Of the first of the ``fields`` (name, raw, chars) that are short; null if none is."""
    fit = F.slice(F.filter(F.slice(fields, 1, CONTEXT_LOOKS), lambda x: x["chars"] <= CONTEXT_CHARS), 1, CONTEXT_FIELDS)
    listed = F.array_join(F.transform(F.array_sort(fit), lambda x: _join(_as_json(x["name"]), ":", x["raw"])), ",")
    return F.when(F.size(fit) > 0, _join('{"fields":{', listed, head, tail, "}"))


def json_fragments(content: Column) -> Column:
    """Of a flat object, one fragment for each member by key."""
    text = content.cast("string")
    keys, raws = (F.regexp_extract_all(text, F.lit(_MEMBER), F.lit(k)) for k in (1, 2))
    plain = lambda raw: F.when(raw.startswith('"'), F.substring(raw, F.lit(2), F.length(raw) - 2)).when(raw == "null", "").otherwise(raw)
    members = F.array_sort(F.transform(F.arrays_zip(keys.alias("name"), raws.alias("raw")), lambda m: F.struct(m["name"].alias("name"), m["raw"].alias("raw"), F.length(plain(m["raw"])).alias("chars"))))

    def of(all_members: Column) -> Column:
        def one(m: Column) -> Column:
            path = F.concat(F.lit("/"), pointer_escape(m["name"]))
            others = F.filter(all_members, lambda x: x["name"] != m["name"])
            return _fragment(
                "parsed-json-value", _join('{"kind":"json-pointer","pointer":', _as_json(path), "}"), _join(path, ": ", m["raw"]),
                _join('{"path":', _as_json(path), ',"value":', m["raw"], "}"), plain(m["raw"]), _context(others, '},"kind":"json-object-context","pointer":""', ""), False,
            )

        return F.transform(all_members, one)

    return F.get(F.transform(F.array(members), of), F.lit(0))


def csv_fragments(content: Column) -> Column:
    """Of plain CSV, the header, then each row and its cells that are not blank."""
    text = content.cast("string")
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x, i: F.struct((i + 1).alias("line"), x.alias("text"))), lambda x: x["text"] != "")
    number = lambda n: n.cast("string")

    def of(rows: Column) -> Column:
        names = F.split(F.get(rows, F.lit(0))["text"], ",", -1)
        head = F.get(rows, F.lit(0))
        listed = lambda v: _join("[", F.array_join(F.transform(v, _as_json), ","), "]")
        header = _fragment(
            "parsed-table-header", _join('{"kind":"table-row","row":1,"source_line":', number(head["line"]), "}"), F.array_join(names, ", "),
            _join('{"row":1,"values":', listed(names), "}"), F.lit(""), F.lit(None).cast("string"), False,
        )

        def record(r: Column, i: Column) -> Column:
            row, values = number(i + 2), F.split(r["text"], ",", -1)

            def entry(z: Column, k: Column) -> Column:
                return F.struct(z["name"].alias("name"), z["value"].alias("value"), k.alias("k"), _as_json(z["name"]).alias("said"), _as_json(z["value"]).alias("raw"), F.length(z["value"]).alias("chars"), (trimmed(z["value"]) != "").alias("full"))

            def of_entries(named: Column) -> Column:  # each made once for all cells of the row
                columns = F.array_join(F.transform(F.array_sort(named), lambda z: _join(z["said"], ":", z["raw"])), ",")
                whole = _fragment(
                    "parsed-table-row", _join('{"kind":"table-row","row":', row, ',"source_line":', number(r["line"]), "}"), F.array_join(values, ", "),
                    _join('{"columns":{', columns, '},"row":', row, ',"values":[', F.array_join(F.transform(named, lambda z: z["raw"]), ","), "]}"), F.array_join(values, " "), F.lit(None).cast("string"), True,
                )
                near = F.transform(F.slice(F.filter(named, lambda x: x["full"]), 1, CONTEXT_LOOKS + 1), lambda x: F.struct(x["name"].alias("name"), x["raw"].alias("raw"), x["chars"].alias("chars"), x["k"].alias("k")))

                def cells(around: Column) -> Column:  # a neighbour is one of the first cells, so a row's cost is linear in its cells
                    def cell(z: Column) -> Column:
                        others, at = F.filter(around, lambda x: x["k"] != z["k"]), number(z["k"] + 1)
                        place = F.when(z["k"] > 0, F.octet_length(F.call_function("substring_index", r["text"], F.lit(","), z["k"])) + 2).otherwise(1)
                        return _fragment(
                            "parsed-table-cell",
                            _join('{"column":', z["said"], ',"column_index":', at, ',"kind":"table-cell","row":', row, ',"source_column":', number(place), ',"source_line":', number(r["line"]), "}"),
                            truncate(_join(z["name"], ": ", z["value"]), EXCERPT_CHARS), _join('{"column":', z["said"], ',"column_index":', at, ',"row":', row, ',"value":', z["raw"], "}"), z["value"],
                            _context(others, '},"kind":"table-record-context","row":', row), False,
                        )

                    return F.transform(F.filter(named, lambda z: z["full"]), cell)

                return F.concat(F.array(whole), F.get(F.transform(F.array(near), cells), F.lit(0)))

            entries = F.transform(F.arrays_zip(names.alias("name"), values.alias("value")), entry)
            return F.get(F.transform(F.array(entries), of_entries), F.lit(0))

        return F.concat(F.array(header), F.flatten(F.transform(F.slice(rows, F.lit(2), F.size(rows)), record)))

    return F.get(F.transform(F.array(lines), of), F.lit(0))


def text_fragments(content: Column) -> Column:
    """Of plain text, each block between blank lines at its bytes."""
    text = content.cast("string")

    def of(parts: Column) -> Column:
        start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<struct<raw:string,at:bigint>>").alias("all"))
        placed = F.aggregate(parts, start, lambda s, p: F.struct((s["at"] + F.octet_length(p) + 2).alias("at"), F.concat(s["all"], F.array(F.struct(p.alias("raw"), s["at"].alias("at")))).alias("all")))["all"]

        def block(b: Column) -> Column:
            inner = trimmed(b["raw"])
            first = b["at"] + F.octet_length(F.regexp_extract(b["raw"], r"(?U)^(\s*)", 1))
            selector = _join('{"end":', (first + F.octet_length(inner)).cast("string"), ',"kind":"utf8-byte-range","start":', first.cast("string"), "}")
            return _fragment("text-block", selector, truncate(inner, EXCERPT_CHARS), _join('{"text":', _as_json(inner), "}"), inner, F.lit(None).cast("string"), False)

        return F.transform(F.filter(placed, lambda b: trimmed(b["raw"]) != ""), block)

    return F.get(F.transform(F.array(F.split(text, "\n\n")), of), F.lit(0))


def fragments(how: Column, content: Column) -> Column:
    """The fragments of an original that ``route`` sends here, in order."""
    return F.when(how == "json", json_fragments(content)).when(how == "csv", csv_fragments(content)).when(how == "text", text_fragments(content)).cast(FRAGMENTS)
