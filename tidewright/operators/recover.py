"""Recovery: how much history is kept, whether to replay, repair or snapshot, and chunk repair."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewright.functions.udfs import fnv1a64_hex


def retained(packets: DataFrame, max_packets: int = 256, max_bytes: int = 8 << 20) -> DataFrame:
    """The longest run of each stream's last packets (stream_id, seq, encoded_len) within both bounds."""
    back = W.partitionBy("stream_id").orderBy(F.desc("seq"))
    sums = packets.withColumn("back", F.row_number().over(back)).withColumn("held", F.sum("encoded_len").over(back.rowsBetween(W.unboundedPreceding, 0)))
    return sums.where((F.col("back") <= max_packets) & (F.col("held") <= max_bytes)).drop("back", "held")


def replay_plans(history: DataFrame, requests: DataFrame) -> DataFrame:
    """Replay or snapshot for each request (client_id, stream_id, local_seq, target_seq, snapshot_bytes).

    Every packet of (local, target] must be there on the one before it, and all
    together must be smaller than the snapshot. Running counts over each
    stream's history turn that range into two look-ups, at local + 1 and at
    target, so a request never meets the packets in between.
    """
    w = W.partitionBy("stream_id").orderBy("seq")
    run = w.rowsBetween(W.unboundedPreceding, 0)
    broken = F.when(F.col("base_seq") == F.col("seq") - 1, 0).otherwise(1)
    sums = history.select("stream_id", "seq", F.row_number().over(w).alias("n"), F.sum(broken).over(run).alias("broken"), broken.alias("here"), F.sum("encoded_len").over(run).alias("bytes"), "encoded_len")
    first = sums.select("stream_id", (F.col("seq") - 1).alias("local_seq"), F.struct("n", F.expr("broken - here").alias("broken"), F.expr("bytes - encoded_len").alias("bytes")).alias("a"))
    last = sums.select("stream_id", F.col("seq").alias("target_seq"), F.struct("n", "broken", "bytes").alias("b"))
    out = requests.join(first, ["stream_id", "local_seq"], "left").join(last, ["stream_id", "target_seq"], "left")
    size = F.col("b.bytes") - F.col("a.bytes")
    whole = (F.col("b.n") - F.col("a.n") + 1 == F.col("target_seq") - F.col("local_seq")) & (F.col("b.broken") == F.col("a.broken"))
    replay = F.coalesce((F.col("local_seq") < F.col("target_seq")) & whole & (size < F.col("snapshot_bytes")), F.lit(False))
    return out.select(*requests.columns, F.when(replay, "replay").otherwise("snapshot").alias("strategy"), F.when(replay, size).otherwise(F.col("snapshot_bytes")).cast("long").alias("cost_bytes"))


def chunks(states: DataFrame, key: str, size: int = 1024) -> DataFrame:
    """Chunks of byte states: ``key``, idx, bytes. An empty or null state has none."""
    n = F.ceil(F.octet_length("state") / size).cast("int")
    at = states.where("octet_length(state) > 0").select(key, "state", F.explode(F.sequence(F.lit(0), n - 1)).alias("idx"))
    return at.select(key, "idx", F.substring("state", F.col("idx") * size + 1, F.lit(size)).alias("bytes"))


def manifest(states: DataFrame, key: str, size: int = 1024) -> DataFrame:
    """Hash of every chunk."""
    return chunks(states, key, size).select(key, "idx", fnv1a64_hex("bytes").alias("hash"))


def differing(receiver: DataFrame, authoritative: DataFrame, key: str, size: int = 1024) -> DataFrame:
    """Chunks (``key``, idx) that differ or stand on one side only.

    Both sides are known by a strong digest of each chunk, which is all that is shuffled.
    """
    digests = lambda states, name: chunks(states, key, size).select(key, "idx", F.unhex(F.sha2("bytes", 256)).alias(name))
    both = digests(receiver, "old").join(digests(authoritative, "new"), [key, "idx"], "full_outer")
    return both.where(~F.col("old").eqNullSafe(F.col("new"))).select(key, "idx")


def repair(receiver: DataFrame, authoritative: DataFrame, key: str, size: int = 1024) -> DataFrame:
    """Patches ``key``, idx, bytes; empty ones beyond the authoritative state's end. Bytes are taken of differing chunks alone."""
    wanted = differing(receiver, authoritative, key, size).groupBy(key).agg(F.collect_list("idx").alias("idxs"))
    state = F.coalesce("state", F.lit(b""))
    rows = wanted.join(authoritative.select(key, "state"), key, "left").select(key, state.alias("state"), F.explode("idxs").alias("idx"))
    return rows.select(key, "idx", F.substring("state", F.col("idx") * size + 1, F.lit(size)).alias("bytes"))


def repair_costs(receiver: DataFrame, authoritative: DataFrame, key: str, size: int = 1024) -> DataFrame:
    """Patches and their bytes for each state; a state that needs none costs 0."""
    patches = repair(receiver, authoritative, key, size).groupBy(key).agg(F.count("*").alias("patches"), F.sum(F.octet_length("bytes")).alias("bytes"))
    return authoritative.select(key).join(patches, key, "left").select(key, F.coalesce("patches", F.lit(0)).alias("patches"), F.coalesce("bytes", F.lit(0)).cast("long").alias("repair_bytes"))


def apply_repair(receiver: DataFrame, patches: DataFrame, lengths: DataFrame, key: str, size: int = 1024) -> DataFrame:
    """The receiver's chunks with the patches' in their place, cut to the target's length, in order: ``key``, state.

    ``lengths`` has ``key`` and target_len. With a column target_hash too, the
    whole state's hash is held against it: the column error is InvalidState and
    the state null where they differ.
    """
    old = chunks(receiver, key, size)
    new = patches.select(key, "idx", F.col("bytes").alias("patch"))
    picked = old.join(new, [key, "idx"], "full_outer").select(key, F.struct("idx", F.hex(F.coalesce("patch", "bytes")).alias("h")).alias("c"))
    joined = picked.groupBy(key).agg(F.array_sort(F.collect_list("c")).alias("cs"))
    state = F.unhex(F.array_join(F.transform("cs", lambda c: c["h"]), ""))
    checked = "target_hash" in lengths.columns
    out = lengths.join(joined, key, "left").select(key, *(["target_hash"] if checked else []), F.coalesce(F.substring(state, F.lit(1), F.col("target_len").cast("int")), F.lit(b"")).alias("state"))
    if not checked:
        return out
    right = F.coalesce(fnv1a64_hex("state") == F.col("target_hash"), F.lit(False))
    return out.withColumn("right", right).select(key, F.when(F.col("right"), F.col("state")).alias("state"), F.when(~F.col("right"), F.lit("InvalidState")).alias("error"))


def three_way(plans: DataFrame, costs: DataFrame) -> DataFrame:
    """Partial repair in place of a plan that costs more; ``costs`` has client_id, repair_bytes (null: the receiver has no state)."""
    out = plans.join(costs, "client_id", "left")
    partial = F.coalesce(F.col("repair_bytes") < F.col("cost_bytes"), F.lit(False))
    return out.withColumn("strategy", F.when(partial, "partial").otherwise(F.col("strategy"))).withColumn("cost_bytes", F.when(partial, F.col("repair_bytes")).otherwise(F.col("cost_bytes"))).drop("repair_bytes")


def shared_snapshot(clients: DataFrame, packets: DataFrame) -> DataFrame:
    """Each stream's last snapshot, built once and given to all of its waiting clients."""
    last = packets.groupBy("stream_id").agg(F.max("seq").alias("snapshot_seq"), F.max_by("state_bytes", "seq").alias("snapshot_bytes"))
    return clients.join(last, "stream_id")
