"""Replicated counters and registers as semilattice aggregates.

Merges are maxima, which Spark takes partly before the shuffle: that is the merge
law at work, whatever order replicas' rows come in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

U64_MAX = "18446744073709551615"
MAX_DOCUMENT = 1 << 20
PART = MAX_DOCUMENT >> 4


def _bounded(total, what: str):
    over = total > F.lit(U64_MAX).cast("decimal(38,0)")
    return F.when(over, F.raise_error(F.lit(f"{what} overflow")).cast("decimal(38,0)")).otherwise(total)


def checked_replica(df: DataFrame) -> DataFrame:
    """Fails on an empty replica id."""
    return df.withColumn("replica", F.when(F.length("replica") == 0, F.raise_error(F.lit("replica id is empty")).cast("string")).otherwise(F.col("replica")))


def increments(rows: DataFrame, *keys: str) -> DataFrame:
    """Components (keys, replica, amount) from increments: sums that must fit 64 bits."""
    total = F.sum(F.col("amount").cast("decimal(20,0)")).cast("decimal(38,0)")
    return checked_replica(rows).groupBy(*keys, "replica").agg(total.alias("amount")).withColumn("amount", _bounded(F.col("amount"), "component"))


def merge(components: DataFrame, *keys: str) -> DataFrame:
    """The join of any number of states: each component's maximum."""
    return components.groupBy(*keys, "replica").agg(F.max("amount").alias("amount"))


def changed_by_merge(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
    """Whether each key's left state grows by the right one; components of nothing change nothing."""
    both = left.withColumnRenamed("amount", "a").join(right.withColumnRenamed("amount", "b"), [*keys, "replica"], "full_outer")
    grown = F.coalesce("b", F.lit(0)) > F.coalesce("a", F.lit(0))
    return both.groupBy(*keys).agg(F.bool_or(grown).alias("changed"))


def value(components: DataFrame, *keys: str) -> DataFrame:
    """A counter's value: the sum of its components, which must fit 64 bits."""
    total = F.sum(F.col("amount").cast("decimal(20,0)")).cast("decimal(38,0)")
    return components.groupBy(*keys).agg(total.alias("value")).withColumn("value", _bounded(F.col("value"), "value"))


def pn_value(components: DataFrame, *keys: str) -> DataFrame:
    """Positive less negative components (column side), a signed number."""
    part = lambda side: F.sum(F.when(F.col("side") == side, F.col("amount").cast("decimal(38,0)")).otherwise(F.lit(0).cast("decimal(38,0)")))
    return components.groupBy(*keys).agg((part("positive") - part("negative")).cast("decimal(38,0)").alias("value"))


def lww(writes: DataFrame, *keys: str) -> DataFrame:
    """The write of the greatest (ts, replica) of each register."""
    return writes.groupBy(*keys).agg(F.max_by("value", F.struct("ts", "replica")).alias("value"), F.max(F.struct("ts", "replica")).alias("m")).select(*keys, "value", F.col("m.ts").alias("ts"), F.col("m.replica").alias("replica"))


def _documents(entries: DataFrame, keys, *groups) -> DataFrame:
    rows = entries.groupBy(*keys, *groups).agg(F.array_sort(F.collect_list(F.struct("replica", "j"))).alias("e"))
    return rows.select(*keys, F.concat(F.lit('{"components":{'), F.array_join(F.transform("e", lambda x: x["j"]), ","), F.lit("}}")).alias("document"))


def _entries(components: DataFrame) -> DataFrame:
    return components.withColumn("j", F.concat(F.lit('"'), "replica", F.lit('":'), F.col("amount").cast("string")))


def encode(components: DataFrame, *keys: str) -> DataFrame:
    """A counter as JSON with its replicas in order."""
    return _documents(_entries(components), keys)


def encode_parts(components: DataFrame, *keys: str, size: int = PART) -> DataFrame:
    """A counter as JSON documents of fewer than 2 * size + 17 bytes, each the state of some replicas, in order.

    Every component with a replica and an amount is in one of them, so their merge is the counter, however many
    replicas it has. An entry longer than ``size`` has a document of its own. As in ``encode``, replicas aren't escaped.
    """
    length = F.coalesce(F.octet_length("j") + 1, F.lit(0))
    before = F.sum(length).over(Window.partitionBy(*keys).orderBy("replica").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - length
    alone = F.when(length > size, F.col("replica"))
    return _documents(_entries(components).select(*keys, "replica", "j", F.floor(before / size).alias("part"), alone.alias("alone")), keys, "part", "alone")


def decode(documents: DataFrame, *keys: str, cap: int = MAX_DOCUMENT) -> DataFrame:
    """Components of counters' JSON; documents over the cap fail before they are parsed."""
    small = F.when(F.octet_length("document") > cap, F.raise_error(F.lit("document over the size cap")).cast("string")).otherwise(F.col("document"))
    parsed = F.from_json(small, "components map<string,decimal(20,0)>")["components"]
    return documents.select(*keys, F.explode(parsed).alias("replica", "amount"))
