"""What several training-data operators share: table access, durable cuts, the word pattern."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than blank, tab, \n, \v, \f and \r.
BLANKS = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: Column) -> Column:
    """Words of a text; null and empty texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANKS), "")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def shared_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``. Where it is unset, a local session gets a
    temporary one, since its driver and executors are one process; a cluster is refused."""
    set_to = spark.conf.get("spark.checkpoint.dir", None)
    if set_to is None:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and the executors share")
        set_to = tempfile.mkdtemp(prefix="spark-lorehouse-")
        spark.conf.set("spark.checkpoint.dir", set_to)
        spark.sparkContext.setCheckpointDir(set_to)
    return set_to


def small_batches(spark: SparkSession, most: int = 4 << 20) -> None:
    """Bound the bytes of the batches that go to Python functions in this session, whole texts being of any length; a
    smaller bound that is set stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name, None)
    digits = "".join(c for c in now or "" if c.isdigit())
    if not (digits and now.rstrip("bB") == digits and 0 < int(digits) <= most):
        spark.conf.set(name, str(most))


def hub_join(rows: DataFrame, table: DataFrame, key: str, hub: Column) -> DataFrame:
    """Inner join of ``rows`` with ``table``, which has each key once. Rows of the keys that are ``hub``, a condition on the
    table that bounds their number, stay where they are and meet a broadcast; only the others are dealt out by key."""
    hubs = F.broadcast(table.where(hub))
    plain = rows.join(hubs.select(key), key, "left_anti").join(table.where(~hub), key)
    return rows.join(hubs, key).unionByName(plain)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to a table in the shared folder and read it back: its lineage ends, and lost executors cost nothing."""
    spark, schema = df.sparkSession, df.schema
    path = scratch_path(spark, "cut")
    df.write.parquet(path)
    written = spark.read.schema(schema).parquet(path)
    written._folder = path.rsplit("/", 1)[0]
    return written


def scratch_path(spark: SparkSession, name: str) -> str:
    folder = f"{shared_dir(spark).rstrip('/')}/lorehouse-{uuid.uuid4().hex}"
    if _owned:
        _owned[-1].append(folder)
    return f"{folder}/{name}"


_owned: list[list[str]] = []


@contextmanager
def owned() -> Iterator[list[str]]:
    """Collects the folders of the working tables that are written inside the block, for ``release``."""
    _owned.append([])
    try:
        yield _owned[-1]
    finally:
        _owned.pop()


def release(spark: SparkSession, folders: list[str]) -> None:
    """Delete working tables that nothing reads any more, and let Spark drop the shuffles that nothing refers to."""
    jvm = spark._jvm  # the file system that Spark itself uses for the path
    for folder in folders:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    folders.clear()
    gc.collect()
    jvm.System.gc()


def discard(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete the folders of tables from ``cut`` that nothing reads any more."""
    jvm = spark._jvm
    for table_ in tables:
        if folder := getattr(table_, "_folder", None):
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def give_back() -> None:
    """Return to the machine what this Python worker no longer uses. Workers are kept from stage to stage, and so is what
    their allocators hold back, until an executor's memory is full of it."""
    pa.default_memory_pool().release_unused()
    with suppress(AttributeError, OSError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def tidied(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for ``mapInArrow`` that gives memory back when its task ends."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from f(batches)
        give_back()

    return of


def bucket_of(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id's text, modulo ``modulus``: the train / held-out split of every trained operator."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(modulus))


def text_column(docs: DataFrame, name: str = "text") -> Column:
    """The text of each row, empty where it is null."""
    return F.coalesce(docs[name].cast("string"), F.lit(""))


def held(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with a column that the optimiser computes once: a later filter on what is made of it cannot copy it into
    each of its uses, as it could through a projection."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def marked_sample(docs: DataFrame, marks: DataFrame, label_col: str, per_label: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(label, h, text): at most ``per_label`` marked documents for each of the labels 0 and 1.

    Ids are dealt into ``per_label`` slots by their hash, and each slot keeps its least; only the marks are shuffled,
    summed first. The chosen ids, at most 2 * ``per_label``, are broadcast to one scan of the documents.
    """
    h = F.xxhash64(F.col(id_col).cast("string"))
    slots = marks.where(F.col(label_col).isin(0, 1)).select(F.col(label_col).cast("int").alias("label"), F.col(id_col).alias("id"), h.alias("h"))
    chosen = slots.groupBy("label", F.pmod("h", F.lit(per_label)).alias("slot")).agg(F.min(F.struct("h", "id")).alias("m")).select("label", "m.*")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return texts.join(F.broadcast(chosen), "id").groupBy("label", "h").agg(F.min("text").alias("text"))
