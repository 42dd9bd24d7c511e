"""Quality rules: a threshold table compiled into one projection of native expressions.

``measure`` adds per-document counts, ``RULES`` is the threshold table over their ratios, and ``compile_rules``
turns the table into one boolean expression. No shuffle, no user function: a document never leaves its task.

Repeated windows are found exactly: the windows of a text are sorted by their words, so equal ones are neighbours.

Defined results: a null or empty text has no word, so every count is 0 and ``base_failed`` is true. Repeated rows
are judged each on their own. Columns of the input are kept out of the way: only ``id_col`` and ``text_col`` are read.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import held, words_of

#: Common function words of English, German, French and Spanish.
STOP_WORDS = (
    "the be to of and that have with for is was are on as by at this it from in or not "
    "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden "
    "le la les de des et en un une du que qui dans pour par sur au avec est pas plus ce il "
    "el los las del y a se por con para una su al lo como más pero sus o"
).split()


@dataclass(frozen=True)
class Rule:
    """Keep a document while ``low <= metric <= high``."""

    name: str
    metric: str
    low: float | None = None
    high: float | None = None


#: The threshold table. Ratios are per word or per line with a word.
RULES: tuple[Rule, ...] = (
    Rule("word_length", "mean_word_chars", 2.0, 25.0),
    Rule("symbols", "symbols_per_word", None, 0.25),
    Rule("stop_words", "stop_word_share", 0.03, None),
    Rule("repeated_lines", "dup_line_share", None, 0.30),
)


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts of every whole text: n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_stop_words.

    Repeated words: sorting the 3-word windows with their places puts equal ones side by side, so the cost is n log n in the
    text's length.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    base = held(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "w", words_of(F.col("text"))).select(
        "doc_id",
        "w",
        F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
    )
    counted = base.select(
        "doc_id",
        "w",
        "n_symbols",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("w", lambda x: F.lower(x).isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
    )
    keyed = held(
        counted,
        "keys",
        F.expr("sort_array(slice(transform(w, (x, i) -> struct(x as a, get(w, i + 1) as b, get(w, i + 2) as c, i as i)), 1, greatest(0, size(w) - 2)))"),
    ).drop("w")
    same = "x.a = get(keys, i {0}).a and x.b = get(keys, i {0}).b and x.c = get(keys, i {0}).c"
    found = held(keyed, "at", F.expr(f"sort_array(transform(filter(keys, (x, i) -> {same.format('- 1')} or {same.format('+ 1')}), x -> x.i))")).drop("keys")
    return found.withColumn("n_repeat_words", F.expr("aggregate(transform(at, (x, i) -> least(3, coalesce(get(at, i + 1) - x, 3))), 0L, (a, b) -> a + b)")).drop("at")


def ratios(measured: DataFrame) -> DataFrame:
    per_word = lambda c: F.col(c) / F.greatest(F.col("n_words"), F.lit(1))
    return measured.withColumns(
        {
            "mean_word_chars": per_word("word_chars"),
            "symbols_per_word": per_word("n_symbols"),
            "stop_word_share": per_word("n_stop_words"),
            "dup_line_share": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        }
    )


def compile_rules(rules: Sequence[Rule] = RULES) -> Column:
    """One boolean expression: true where every rule of the table holds."""
    kept = F.lit(True)
    for rule in rules:
        if rule.low is not None:
            kept = kept & (F.col(rule.metric) >= F.lit(float(rule.low)))
        if rule.high is not None:
            kept = kept & (F.col(rule.metric) <= F.lit(float(rule.high)))
    return kept


def apply_rules(docs: DataFrame, rules: Sequence[Rule] = RULES, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50, max_repeat_percent: int = 50) -> DataFrame:
    """Every document's counts, ratios, ``base_failed`` and ``kept``."""
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    return ratios(measure(docs, id_col, text_col)).withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & compile_rules(rules))
