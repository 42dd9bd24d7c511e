"""Scalar functions on text as Column expressions: identity, trimming, folding, labels, excerpts."""

from __future__ import annotations

import json
import unicodedata
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


def stable_id(prefix: str, canonical_json: Column) -> Column:
    """Identity of a derived record: SHA-256 of the prefix, a zero character and the record's canonical JSON."""
    return F.sha2(F.concat(F.lit(prefix), F.lit("\0"), canonical_json), 256)


def canonical_json(value: Any) -> str:
    """The one JSON form that identities are made of: sorted keys, no blanks, text unescaped."""
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def trimmed(text: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def truncate(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit("…"))).otherwise(text)


def pointer_escape(key: Column) -> Column:
    return F.replace(F.replace(key, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))


def normalize_label(label: Column) -> Column:
    """Entity labels: trimmed, inner white space as one blank, lower case."""
    return F.lower(F.regexp_replace(trimmed(label), r"(?U)\s+", " "))


def _accented() -> tuple[str, str]:
    """Latin letters with marks and their base letters, by Unicode's own decomposition."""
    pairs = {}
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        base = "".join(c for c in unicodedata.normalize("NFD", chr(code)) if not unicodedata.combining(c))
        if len(base) == 1 and base != chr(code):
            pairs[chr(code)] = base
    return "".join(pairs), "".join(pairs.values())


ACCENTED, BASE = _accented()


def fold(text: Column) -> Column:
    """Lower case without marks on Latin letters, precomposed or combining; a text of ASCII alone has none to look for."""
    plain = F.lower(F.regexp_replace(F.translate(text, ACCENTED, BASE), r"\p{M}+", ""))
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(plain)


def tokens(text: Column) -> Column:
    """Runs of letters, numbers and private-use characters of the folded text."""
    return F.regexp_extract_all(fold(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}\p{Co}]+"), F.lit(0))


def search_text(text: Column) -> Column:
    """Folded words with one blank between them, for the omnibox."""
    return F.trim(F.regexp_replace(fold(text), r"[^\p{L}\p{N}]+", " "))


def humanize(value: Column) -> Column:
    return F.translate(value, "_-", "  ")


def excerpt_words(text: Column, words: int) -> Column:
    """The first words of a text, with an ellipsis if more follow."""
    parts = F.array_remove(F.split(F.coalesce(text, F.lit("")), r"\s+"), "")
    short = F.array_join(F.slice(parts, 1, words), " ")
    return F.when(F.size(parts) > words, F.concat(short, F.lit("…"))).otherwise(short)


def compact(text: Column, most: int = 160) -> Column:
    """White space as single blanks, cut to ``most`` characters without a blank before the ellipsis."""
    plain = F.trim(F.regexp_replace(text, r"(?U)\s+", " "))
    return F.when(F.length(plain) > most, F.concat(F.rtrim(F.left(plain, F.lit(most))), F.lit("…"))).otherwise(plain)


def confidence_text(confidence: Column) -> Column:
    return F.when(confidence.isNotNull(), F.format_string("%d%%", F.round(confidence * 100).cast("int")))


def file_size(size: Column) -> Column:
    """Bytes, or the largest unit of 1024 that fits, with one decimal below ten."""
    value, text = size.cast("double"), F.concat(size.try_cast("bigint").cast("string"), F.lit(" B"))
    for power, unit in enumerate(("KB", "MB", "GB", "TB"), 1):
        scaled = value / F.lit(float(1024**power))
        text = F.when(value >= float(1024**power), F.when(scaled >= 10, F.format_string(f"%.0f {unit}", scaled)).otherwise(F.format_string(f"%.1f {unit}", scaled))).otherwise(text)
    return text


def text_preview(text: Column, most: int = 4096) -> Column:
    """The first characters of a text; a line with an ellipsis follows if there are more."""
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit("\n…"))).otherwise(text)


def fits(text: Column, most: int = 128) -> Column:
    return F.length(text) <= most


def valid_key(key: Column) -> Column:
    """Keys of ``key: value`` lines: at most 120 letters, digits and a few marks, a letter or digit among them."""
    return key.rlike(r"^[\p{L}\p{Nd} \t\-_./()#]{1,120}$") & key.rlike(r"[\p{L}\p{Nd}]")
