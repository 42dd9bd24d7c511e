"""Texts for people: processing states, durations, kinds, titles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import excerpt_words, trimmed

#: What is said of each reason, and words that no private query is made of.
REASONS = {
    "unsupported_content": "This content type is not supported for knowledge extraction.",
    "source_too_large": "This source is too large for the current extractor.",
    "semantic model is not configured": "The semantic model was unavailable.",
    "fragment_exceeds_model_limit": "Some content exceeds the semantic model's current input limit.",
}
OTHER_REASON = "Some semantic work was not completed."
COMMON = (
    "about after again also because before could detta eller finns från have inte med more och som that the their there this till var with would"
).split()


def processing_text(state: Column, done: Column, total: Column, retryable: Column, error: Column, default: str = "Processing") -> Column:
    progress = F.when(total > 0, F.concat(F.lit(" · "), done.cast("string"), F.lit("/"), total.cast("string"))).otherwise("")
    detail = F.when(trimmed(error) != "", trimmed(error)).otherwise("Unknown processing error")
    failed = F.when(retryable, F.concat(F.lit("Processing failed; retry scheduled · "), detail)).otherwise(F.concat(F.lit("Processing stopped · "), detail))
    return F.when(state == "failed", failed).otherwise(F.concat(F.lit(default), progress))


def status_text(det_state: Column, know_state: Column, know_error: Column, det_error: Column) -> Column:
    """What a source's two representations leave to say; null where both are ready."""
    key = F.when(F.coalesce(know_error, F.lit("")) != "", know_error).otherwise(F.coalesce(det_error, F.lit("")))
    reason = F.lit(OTHER_REASON)
    for name, said in REASONS.items():
        reason = F.when(key == name, said).otherwise(reason)
    both_skipped, skipped = "Deterministic extraction and semantic processing were skipped. ", "Semantic processing was skipped. "
    return (
        F.when((det_state == "ready") & (know_state == "ready"), F.lit(None).cast("string"))
        .when(know_state == "partial", F.concat(F.lit("Semantic processing is partial. "), reason))
        .when(know_state == "skipped", F.concat(F.when(det_state == "skipped", both_skipped).otherwise(skipped), reason))
        .when(know_state.isin("unavailable", "failed"), reason)
        .when(det_state == "skipped", F.concat(F.lit("Deterministic extraction was skipped. "), reason))
    )


def duration_text(millis: Column) -> Column:
    minutes = F.floor(F.greatest(millis, F.lit(0)) / 60_000)
    hours, days = F.floor(minutes / 60), F.floor(minutes / 1440)
    many = lambda n, one: F.concat(n.cast("string"), F.when(n == 1, f" {one}").otherwise(f" {one}s"))
    rest = lambda n, unit: F.when(n > 0, F.concat(F.lit(" "), n.cast("string"), F.lit(f" {unit}"))).otherwise("")
    return (
        F.when(minutes < 1, "less than a minute")
        .when(minutes < 60, many(minutes, "minute"))
        .when(hours < 24, F.concat(many(hours, "hour"), rest(minutes % 60, "min")))
        .otherwise(F.concat(many(days, "day"), rest(hours % 24, "h")))
    )


def kind_badge(mime: Column, title: Column) -> Column:
    return (
        F.when(mime.startswith("image/"), "IMG")
        .when((mime == "text/plain") & title.startswith("note-"), "NOTE")
        .when(mime.contains("csv") | F.lower(title).endswith(".csv"), "CSV")
        .when(mime.startswith("text/"), "TXT")
        .when(mime.contains("pdf"), "PDF")
        .otherwise("FILE")
    )


def list_title(title: Column, text: Column, shown: int = 4096) -> Column:
    """The first line of a text that is not blank, to 120 characters; the title where there is no text."""
    lines = F.filter(F.split(F.left(text, F.lit(shown)), "\r\n|\n|\r"), lambda x: trimmed(x) != "")
    first = F.left(trimmed(F.get(lines, F.lit(0))), F.lit(120))
    return F.coalesce(F.when(first != "", first), title)


def search_title(title: Column, text: Column) -> Column:
    """The first ten words of a text's first 240 characters; the title where there are none."""
    words = excerpt_words(F.left(text, F.lit(240)), 10)
    return F.when(F.coalesce(words, F.lit("")) != "", words).otherwise(title)


def private_word(texts: DataFrame) -> DataFrame:
    """(original_id, word): of texts (order, original_id, text) the first word of five letters or more that is not common."""
    found = F.filter(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"(\p{L}{5,})"), F.lit(1)), lambda w: ~w.isin(*COMMON))
    words = texts.select("order", "original_id", F.get(found, F.lit(0)).alias("word")).where("word is not null")
    return words.orderBy("order").limit(1).select("original_id", "word")
