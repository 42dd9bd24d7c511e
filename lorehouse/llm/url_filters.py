"""URL filters: longest matching (host, path prefix) rule by a sorted sweep over reversed-host keys.

A host is written label by label from the right, ``com.example.blog``, followed by the path. For each depth that
some rule's host has (its number of labels), a url gets one canonical key: its host's last labels at that depth, a
slash, and its path. A rule's own key is such a prefix, so it covers one interval of the sorted keys, and the intervals of one
depth are nested or apart. One sort merges rules and urls; the last rule passed carries the stack of rules that were
open at its start, and the deepest of them that is still open at the url's key is the answer for that depth.

The sweep runs inside salts: urls are dealt to ``salts`` parts by the number of their row, the rules go to each part. All
depths share this one shuffle. A hot host, url or repeated row therefore never meets in one task, and a part holds
rows / salts urls plus the rules, so the rules must be few against a part's urls.

Defined results: a url that is null or has no ``://`` has an empty host and path and fits no rule; repeated rows are
each judged; equally long rules give the one with the longer host; identical rules that disagree give ``block``.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ascii_lower

#: (verdict, host, path prefix)
RULES: tuple[tuple[str, str, str], ...] = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (ASCII lower case) and path of a url; both empty without ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_table(spark: SparkSession, rules: Iterable[tuple[str, str, str]] = RULES) -> DataFrame:
    """The rules as literals: no Python worker takes part."""
    kind = "array<struct<verdict:string,host:string,path:string>>"
    rows = F.array(*[F.struct(F.lit(v).alias("verdict"), F.lit(h).alias("host"), F.lit(p).alias("path")) for v, h, p in rules])
    return spark.range(1).select(F.inline(rows.cast(kind)))


def key_at(host: Column, path: Column, depth: int) -> Column:
    """Canonical key of the host's last ``depth`` labels and the path; null for hosts with fewer labels."""
    labels = F.reverse(F.split(host, r"\."))
    return F.when(F.size(labels) >= depth, F.concat(F.array_join(F.slice(labels, 1, depth), "."), F.lit("/"), path))


def with_stacks(rules: DataFrame) -> DataFrame:
    """Rules with their canonical key and the stack of rules open at their start, outermost first.

    The stack of a rule is every rule of its depth whose key is a prefix of its own: an equi-join on the prefixes of
    the keys, so it stays linear in rules times key length.
    """
    own = (
        rules.where(F.col("host").isNotNull() & F.col("path").isNotNull())
        .withColumn("host", ascii_lower(F.col("host")))
        .withColumn("depth", F.size(F.split("host", r"\.")))
        .withColumn("key", F.concat(F.array_join(F.reverse(F.split("host", r"\.")), "."), F.lit("/"), "path"))
        .groupBy("depth", "key")
        .agg(F.max("verdict").alias("verdict"), F.first(F.concat("host", "path")).alias("rule"), F.first(F.length("host")).alias("host_chars"))
    )
    entry = F.struct(F.length("key").alias("chars"), F.col("key").alias("open"), "rule", "verdict", "host_chars")
    prefixes = own.select("depth", "key", F.explode(F.expr("transform(sequence(1, length(key)), n -> left(key, n))")).alias("open"))
    nested = prefixes.join(own.select("depth", F.col("key").alias("open"), entry.alias("e")), ["depth", "open"])
    return nested.groupBy("depth", "key").agg(F.sort_array(F.collect_list("e")).alias("stack"))


def decide(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", salts: int | None = None, default: str = "allow") -> DataFrame:
    """One row per page: page_id, host, path, rule (null if none fits), verdict (the rule's, else ``default``)."""
    spark = pages.sparkSession
    rules = with_stacks(rules)
    depths = [r["depth"] for r in rules.select("depth").distinct().orderBy("depth").collect()]  # at most 127: labels of a host name
    host, path = url_parts(F.col(url_col))
    parsed = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    if not depths:
        return parsed.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    salts = salts or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    urls = parsed.select(
        F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(salts)).cast("int").alias("salt"),
        F.lit(1).alias("kind"), "page_id", "host", "path",
        *[key_at(F.col("host"), F.col("path"), d).alias(f"key{d}") for d in depths],
        *[F.lit(None).cast(rules.schema["stack"].dataType).alias(f"stack{d}") for d in depths],
    )
    marks = rules.select(
        F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"),
        F.lit(0).alias("kind"), F.lit(None).cast(urls.schema["page_id"].dataType).alias("page_id"), F.lit(None).cast("string").alias("host"), F.lit(None).cast("string").alias("path"),
        *[F.when(F.col("depth") == d, F.col("key")).alias(f"key{d}") for d in depths],
        *[F.when(F.col("depth") == d, F.col("stack")).alias(f"stack{d}") for d in depths],
    )
    swept = urls.unionByName(marks)
    for d in depths:
        passed = Window.partitionBy("salt").orderBy(f"key{d}", "kind").rowsBetween(Window.unboundedPreceding, 0)
        swept = swept.withColumn(f"stack{d}", F.last(f"stack{d}", ignorenulls=True).over(passed))
    still_open = lambda d: F.filter(f"stack{d}", lambda e: F.col(f"key{d}").startswith(e["open"]))
    best = F.array_max(F.flatten(F.array_compact(F.array(*[F.transform(still_open(d), lambda e: F.struct(F.length(e["rule"]).alias("chars"), e["host_chars"].alias("host_chars"), e["rule"].alias("rule"), e["verdict"].alias("verdict"))) for d in depths]))))
    return swept.where("kind = 1").withColumn("best", best).select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
