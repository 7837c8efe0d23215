"""Differences of consecutive states: record masks, JSON fields, byte deltas and change profiles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.functions import udfs
from tidewright.functions.expressions import json_fields, signed_len, string_len, varint_len
from tidewright.operators.streams import PROFILE, as_json, with_previous

RECORD_FIELDS = (("status", "s"), ("priority", "s"), ("cents", "n"), ("day", "n"))


def record_deltas(records: DataFrame, fields=RECORD_FIELDS) -> DataFrame:
    """The mask of changed fields, new texts and signed differences of numbers; null at a stream's first record."""
    both = with_previous(records, *(f for f, _ in fields))
    first = F.col("seq") == 1
    bits = [F.when(~F.col(f).eqNullSafe(F.col(f"prev_{f}")), F.lit(1 << i)).otherwise(F.lit(0)) for i, (f, _) in enumerate(fields)]
    out = both.withColumn("mask", F.when(~first, reduce(Column.__add__, bits)))
    for i, (f, kind) in enumerate(fields):
        changed = F.col("mask").bitwiseAND(F.lit(1 << i)) != 0
        out = out.withColumn(f"d_{f}", F.when(changed, F.col(f) if kind == "s" else F.col(f) - F.col(f"prev_{f}")))
    return out.select("stream_id", "seq", *(f for f, _ in fields), "mask", *(f"d_{f}" for f, _ in fields))


def record_lengths(deltas: DataFrame, fields=RECORD_FIELDS) -> DataFrame:
    """Encoded bytes of each record and of its delta (two mask bytes and the changed fields)."""
    full = reduce(Column.__add__, [string_len(F.col(f)) if k == "s" else varint_len(F.col(f)) for f, k in fields])
    parts = [F.coalesce(string_len(F.col(f"d_{f}")) if k == "s" else F.when(F.col(f"d_{f}").isNotNull(), signed_len(F.col(f"d_{f}"))), F.lit(0)) for f, k in fields]
    return deltas.select("stream_id", "seq", full.cast("long").alias("record_len"), F.when(F.col("mask").isNotNull(), reduce(Column.__add__, parts) + 2).cast("long").alias("delta_len"))


def record_reconstruct(deltas: DataFrame, fields=RECORD_FIELDS) -> DataFrame:
    """Fold a stream's first record and its deltas: last text, running sum of differences."""
    from pyspark.sql import Window as W

    w = W.partitionBy("stream_id").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    out = []
    for f, kind in fields:
        step = F.when(F.col("seq") == 1, F.col(f)).otherwise(F.col(f"d_{f}"))
        out.append((F.last(step, ignorenulls=True) if kind == "s" else F.sum(step)).over(w).alias(f"r_{f}"))
    return deltas.select("*", *out)


def json_deltas(profiles: DataFrame) -> DataFrame:
    """Changed top-level fields of each profile against the one before, as compact JSON; null at the first. Fields never go, so removed is empty."""
    both = with_previous(profiles, *PROFILE)
    changed = json_fields([(f, F.when(~F.col(f).eqNullSafe(F.col(f"prev_{f}")), as_json(f))) for f in PROFILE])
    return both.withColumn("delta", F.when(F.col("seq") > 1, F.concat(F.lit('{"changed":'), changed, F.lit(',"removed":[]}')))).drop(*(f"prev_{f}" for f in PROFILE))


def map_delta(old: Column, new: Column) -> tuple[Column, Column]:
    """Of two string maps the changed or new entries, and the keys that went. A null value is a value."""
    changed = F.map_filter(new, lambda k, v: ~F.array_contains(F.map_keys(old), k) | ~v.eqNullSafe(old[k]))
    return changed, F.array_sort(F.array_except(F.map_keys(old), F.map_keys(new)))


def map_apply(base: Column, changed: Column, removed: Column) -> Column:
    """Take the removed keys out, then put the changed entries in."""
    kept = F.map_filter(base, lambda k, v: ~F.array_contains(removed, k) & ~F.array_contains(F.map_keys(changed), k))
    return F.map_concat(kept, changed)


def byte_candidates(states: DataFrame, chunk: int = 1024, max_gap: int = 0) -> DataFrame:
    """A row for each update and delta candidate: stream_id, seq, state_len, kind, rank, payload_len."""
    both = with_previous(states)
    kinds = udfs.candidate_lengths(chunk, max_gap)("prev_state", "state")
    rows = both.select("stream_id", "seq", F.octet_length("state").cast("long").alias("state_len"), F.explode(kinds).alias("c"))
    return rows.select("stream_id", "seq", "state_len", F.col("c.kind").alias("kind"), F.col("c.rank").alias("rank"), F.col("c.len").alias("payload_len"))


def single_candidate(states: DataFrame, kind: str) -> DataFrame:
    """The candidates of one kind; an update whose lengths don't allow it fails the query."""
    both = with_previous(states).where("prev_state is not null")
    if kind in ("sparse", "ranges", "xor"):
        fits = F.octet_length("state") == F.octet_length("prev_state")
        both = both.withColumn("prev_state", F.when(fits, F.col("prev_state")).otherwise(F.raise_error(F.lit(f"{kind} delta needs equal lengths")).cast("binary")))
    return both.select("stream_id", "seq", udfs.delta_bytes(kind)("prev_state", "state").alias("payload"))


def profiles_of_change(states: DataFrame) -> DataFrame:
    """What changed between each state and the one before, with ratio and whether the length did."""
    both = with_previous(states).where("prev_state is not null")
    out = both.select("stream_id", "seq", udfs.change_profile("prev_state", "state").alias("p")).select("stream_id", "seq", "p.*")
    top = F.greatest("previous_len", "current_len", F.lit(1))
    return out.withColumn("change_ratio", F.round(F.col("changed_bytes") / top, 6)).withColumn("resized", F.col("previous_len") != F.col("current_len"))


def reconstructed(states: DataFrame, kind: str = "splice") -> DataFrame:
    """Encode and apply each update's delta: whether the state comes back, and the error if not."""
    both = with_previous(states).where("prev_state is not null")
    made = both.withColumn("payload", udfs.delta_bytes(kind)("prev_state", "state"))
    return made.select("stream_id", "seq", "state", udfs.apply_delta("prev_state", "payload").alias("a")).select("stream_id", "seq", (F.col("a.state") == F.col("state")).alias("same"), F.col("a.error").alias("error"))
