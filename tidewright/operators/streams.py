"""Tables as ordered state streams: stream_id, seq from 1, and the state."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewright.functions.expressions import json_fields, quoted

EVENT_TYPES = ("click", "error", "purchase", "signup", "view")
#: Fields of a user's profile, in the order of its JSON.
PROFILE = ("cents", "click", "error", "events", "last_k", "last_type", "purchase", "signup", "view")


def profile_states(events: DataFrame) -> DataFrame:
    """Each event's user's profile so far: stream_id, seq, the fields of PROFILE.

    One shuffle on the user; running windows over its events.
    """
    keyed = events.withColumnRenamed("user_id", "stream_id")  # named before the windows, so later ones share their partitioning
    w = W.partitionBy("stream_id").orderBy("event_id").rowsBetween(W.unboundedPreceding, 0)
    cents = F.round(F.coalesce("value", F.lit(0.0)) * 100).cast("long")
    return keyed.select(
        "stream_id",
        F.row_number().over(W.partitionBy("stream_id").orderBy("event_id")).cast("long").alias("seq"),
        F.sum(cents).over(w).alias("cents"),
        *(F.count(F.when(F.col("event_type") == t, 1)).over(w).alias(t) for t in EVENT_TYPES),
        F.count("*").over(w).alias("events"),
        F.last(F.get_json_object("props", "$.k").cast("long"), ignorenulls=True).over(w).alias("last_k"),
        F.last("event_type", ignorenulls=True).over(w).alias("last_type"),
    ).select("stream_id", "seq", *PROFILE)


def as_json(name: str):
    """A profile field as JSON text."""
    c = F.col(name)
    return F.coalesce(quoted(c) if name == "last_type" else c.cast("string"), F.lit("null"))


def with_text(states: DataFrame) -> DataFrame:
    """The canonical text of each profile, as ``state``."""
    return states.withColumn("state", json_fields([(f, as_json(f)) for f in PROFILE]))


def transcripts(conversations: DataFrame) -> DataFrame:
    """Each conversation's text up to each turn, as bytes: stream_id, seq, state."""
    keyed = conversations.withColumnRenamed("conv_id", "stream_id")
    w = W.partitionBy("stream_id").orderBy("turn")
    so_far = F.collect_list(F.coalesce("text", F.lit(""))).over(w.rowsBetween(W.unboundedPreceding, 0))
    return keyed.select("stream_id", F.row_number().over(w).cast("long").alias("seq"), F.concat_ws("", so_far).cast("binary").alias("state"))


def order_records(orders: DataFrame) -> DataFrame:
    """Each customer's orders as a record stream: stream_id, seq, status, priority, cents, day."""
    w = W.partitionBy("stream_id").orderBy("o_orderkey")
    return orders.withColumnRenamed("o_custkey", "stream_id").select(
        "stream_id", F.row_number().over(w).cast("long").alias("seq"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"),
        F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"), F.datediff(F.col("o_orderdate").cast("date"), F.lit("1970-01-01").cast("date")).cast("long").alias("day"),
    )


def order_lines(orders: DataFrame) -> DataFrame:
    """Order records as byte states of one length: status, priority, cents and day in fixed columns."""
    return order_records(orders).select("stream_id", "seq", F.concat(F.rpad("status", 2, " "), F.rpad("priority", 16, " "), F.lpad(F.col("cents").cast("string"), 12, "0"), F.lpad(F.col("day").cast("string"), 6, "0")).cast("binary").alias("state"))


def with_previous(states: DataFrame, *columns: str) -> DataFrame:
    """Each state beside its stream's one before: ``prev_`` columns, null at the first."""
    w = W.partitionBy("stream_id").orderBy("seq")
    return states.select("*", *(F.lag(c).over(w).alias(f"prev_{c}") for c in columns or ("state",)))


def ordered_fold(rows: DataFrame, keys: list[str], order: str, start: Callable, step: Callable, schema: str) -> DataFrame:
    """Rows that ``step`` (state, pandas rows) gives for each key's rows in order, from the state that ``start`` makes.

    A key's rows pass batch by batch, so a stream of any length takes the memory of one batch and one state.
    """
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        at, state = None, None
        for pdf in batches:
            out: list[tuple] = []
            for key, part in pdf.groupby(keys, sort=False, dropna=False):
                if str(key) != at:  # as text, for a null key is not equal to itself
                    at, state = str(key), start()
                out += step(state, part)
            yield pd.DataFrame(out, columns=names)

    return rows.repartition(*keys).sortWithinPartitions(*keys, order).mapInPandas(run, schema)
