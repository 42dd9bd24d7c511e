"""Which parser reads an original: declared type, known binary formats, and a sniff of the first bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import trimmed

#: Formats that are never read as text, and the bounds on input.
BINARY_KINDS = ("image/", "audio/", "video/", "font/")
BINARY_TYPES = ("application/pdf", "application/zip", "application/gzip", "application/x-gzip", "application/x-7z-compressed", "application/x-rar-compressed")
BINARY_ENDINGS = (".png", ".jpg", ".jpeg", ".gif", ".webp", ".heic", ".pdf", ".zip", ".gz", ".7z", ".rar", ".mp3", ".wav", ".flac", ".mp4", ".mov", ".avi", ".mkv")
SNIFF_BYTES, MOST_BYTES = 8192, 8 * 1024 * 1024


def plain_mime(mime: Column) -> Column:
    return F.lower(trimmed(F.substring_index(mime, ";", 1)))


def declared_text(mime: Column) -> Column:
    m = plain_mime(mime)
    return m.startswith("text/") | m.isin("application/json", "application/csv")


def known_binary(title: Column, mime: Column) -> Column:
    m, name = plain_mime(mime), F.lower(title)
    found = m.isin(*BINARY_TYPES)
    for kind in BINARY_KINDS:
        found = found | m.startswith(kind)
    for ending in BINARY_ENDINGS:
        found = found | name.endswith(ending)
    return found


def looks_binary(content: Column) -> Column:
    """A zero byte, bytes that are not UTF-8 (but for a character cut by the window), or over 1 % control characters."""
    head = F.substring(content, 1, SNIFF_BYTES)
    text = head.cast("string")
    whole = F.is_valid_utf8(text)
    for cut in (1, 2, 3):
        whole = whole | F.is_valid_utf8(F.substring(content, 1, SNIFF_BYTES - cut).cast("string"))
    control = F.length(F.regexp_replace(F.make_valid_utf8(text), r"[^\x01-\x08\x0B\x0C\x0E-\x1F]+", ""))
    return (F.instr(F.hex(head), "00") > 0) & F.hex(head).rlike("^(..)*00") | ~whole | (control * 100 > F.octet_length(head))


def parser_of(title: Column, mime: Column) -> Column:
    """json, csv, markdown or text, by type first and by the name's ending else."""
    m, name = plain_mime(mime), F.lower(title)
    return (
        F.when((m == "application/json") | name.endswith(".json"), "json")
        .when(m.isin("text/csv", "application/csv") | name.endswith(".csv"), "csv")
        .when((m == "text/markdown") | name.endswith(".md") | name.endswith(".markdown"), "markdown")
        .otherwise("text")
    )


def outcome(title: Column, mime: Column, size: Column, content: Column) -> Column:
    """state and reason of an original before parsing: ready, skipped or failed."""
    state = lambda s, r: F.struct(F.lit(s).alias("state"), F.lit(r).cast("string").alias("reason"))
    return (
        F.when(known_binary(title, mime), state("skipped", "unsupported_content"))
        .when(~declared_text(mime) & looks_binary(content), state("skipped", "unsupported_content"))
        .when(size > MOST_BYTES, state("skipped", "source_too_large"))
        .when(~F.is_valid_utf8(content.cast("string")), F.when(declared_text(mime), state("failed", "invalid_utf8")).otherwise(state("skipped", "unsupported_content")))
        .otherwise(state("ready", None))
    )
