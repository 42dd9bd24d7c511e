"""Token counts as delta-maintained rollups by source, language and tokenizer version.

A change has the state of a document before and after it: an insert has no before, a delete no after, a revision both.
``deltas`` turns a batch of changes into signed, additive rows per key, summed before the shuffle, so a hot source is
no hot group. ``Ledger`` keeps each batch's deltas in a folder of its own, named by the batch id and complete once its
``_SUCCESS`` mark is there: a batch that failed half-way is written again, one that is complete is never applied twice.
``totals`` adds up the complete batches; ``compact`` folds them into one table and remembers which it holds.

Defined results: null sources and languages are keys of their own; null and empty texts count as documents with 0
tokens; repeated rows count each; an empty table gives no rows. A ledger has one writer at a time and needs a classic
session, whose file system it asks for complete batches. Keys whose documents and tokens are back at 0 are left out of the totals.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import words_of

KEYS = ("source", "lang", "tokenizer")
#: A mark of its own, or a run of letters, digits and characters beyond ASCII.
PIECES = r"[\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]|[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
STATE = "struct<source:string,lang:string,tokenizer:string,n_tokens:bigint>"


def word_count(text: Column) -> Column:
    return F.size(words_of(text)).cast("bigint")


def piece_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(PIECES)), F.lit(0)).cast("bigint")


def state(source: Column, lang: Column, tokenizer: str, n_tokens: Column) -> Column:
    return F.struct(source.cast("string").alias("source"), lang.cast("string").alias("lang"), F.lit(tokenizer).alias("tokenizer"), n_tokens.cast("bigint").alias("n_tokens"))


def deltas(changes: DataFrame) -> DataFrame:
    """Signed rows per key of ``changes`` (before, after)."""
    signed = changes.select(F.explode(F.array(F.struct(F.lit(1).alias("sign"), F.col("after").alias("s")), F.struct(F.lit(-1).alias("sign"), F.col("before").alias("s")))).alias("c")).where("c.s is not null")
    return signed.groupBy(*[F.col(f"c.s.{k}").alias(k) for k in KEYS]).agg(F.sum("c.sign").alias("n_docs"), F.sum(F.col("c.sign") * F.coalesce("c.s.n_tokens", F.lit(0))).alias("n_tokens"))


class Ledger:
    """Batches of deltas under ``path``, a folder that driver and executors share."""

    SCHEMA = "source string, lang string, tokenizer string, n_docs bigint, n_tokens bigint"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _complete(self) -> list[str]:
        """Folders with a mark, by the file system that Spark itself uses for the path."""
        jvm = self.spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(root)]
        return [n for n in names if fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}/_SUCCESS"))]

    def _live(self) -> list[str]:
        """Complete batches and the newest compaction, without the batches that it holds."""
        done = self._complete()
        bases = sorted((n for n in done if n.startswith("base-")), key=lambda n: int(n.split("-")[1]))
        if not bases:
            return [n for n in done if n.startswith("batch-")]
        held = {r["batch"] for r in self.spark.read.parquet(f"{self.path}/{bases[-1].replace('base-', 'held-')}").collect()}
        return [bases[-1], *(n for n in done if n.startswith("batch-") and n not in held)]

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Apply ``changes`` under this batch id; False if it was applied before."""
        name = f"batch-{batch}"
        done = self._complete()
        if name in done:
            return False
        deltas(changes).write.mode("overwrite").parquet(f"{self.path}/{name}")
        return True

    def totals(self) -> DataFrame:
        live = self._live()
        rows = self.spark.read.schema(self.SCHEMA).parquet(*[f"{self.path}/{n}" for n in live]) if live else self.spark.createDataFrame([], self.SCHEMA)
        summed = rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return summed.where("n_docs <> 0 or n_tokens <> 0")

    def compact(self) -> None:
        """Fold all complete batches into one table: first the list of what it holds, then the table itself."""
        done = self._complete()
        number = 1 + max((int(n.split("-")[1]) for n in done if n.startswith("base-")), default=0)
        held = [(n,) for n in done if n.startswith("batch-")]
        self.spark.createDataFrame(held, "batch string").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/held-{number}")
        self.totals().write.mode("overwrite").parquet(f"{self.path}/base-{number}")


def apply_all(ledger: Ledger, batches: Iterable[tuple[str, DataFrame]]) -> DataFrame:
    for name, changes in batches:
        ledger.commit(name, changes)
    return ledger.totals()
