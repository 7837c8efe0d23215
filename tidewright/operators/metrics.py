"""Traffic accounting over chosen packets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewright.functions.expressions import ratio, reduction_percent, saving_percent


def encoder_metrics(chosen: DataFrame, *keys: str) -> DataFrame:
    """Packets, snapshots, deltas, bytes in and out, ratio and saving. ``chosen`` has mode, state_bytes, selected_bytes; where it has considered, candidates too."""
    snap = F.col("mode").startswith("snapshot")
    tried = [F.sum("considered").cast("long").alias("candidates")] if "considered" in chosen.columns else []
    out = chosen.groupBy(*keys).agg(
        F.count("*").alias("packets"), F.count_if(snap).alias("snapshots"), F.count_if(~snap).alias("deltas"), F.count_if(F.col("mode").endswith("zstd")).alias("compressed"),
        F.sum("state_bytes").alias("input_bytes"), F.sum("selected_bytes").cast("long").alias("output_bytes"), *tried,
    )
    return out.withColumn("ratio", F.round(ratio(F.col("output_bytes"), F.col("input_bytes")), 6)).withColumn("saving_percent", saving_percent(F.col("output_bytes"), F.col("input_bytes")))


def traffic(chosen: DataFrame, *keys: str) -> DataFrame:
    """Updates, full and wire bytes, bytes avoided update by update (never less than none), and the reduction."""
    out = chosen.groupBy(*keys).agg(
        F.count("*").alias("updates"), F.sum("state_bytes").alias("full_bytes"), F.sum("selected_bytes").cast("long").alias("wire_bytes"),
        F.sum(F.greatest(F.col("state_bytes") - F.col("selected_bytes"), F.lit(0))).cast("long").alias("bytes_avoided"), F.count_if(F.col("mode").startswith("snapshot")).alias("snapshot_packets"), F.count_if(~F.col("mode").startswith("snapshot")).alias("delta_packets"),
    )
    return out.withColumn("reduction_percent", reduction_percent(F.col("wire_bytes"), F.col("full_bytes")))


def mode_histogram(chosen: DataFrame) -> DataFrame:
    return chosen.groupBy("mode").agg(F.count("*").alias("packets"), F.sum("selected_bytes").cast("long").alias("bytes"))


def strategy_totals(candidates: DataFrame, header: int = 46) -> DataFrame:
    """Total bytes of each kind over all updates, least first. ``candidates`` has kind and payload_len."""
    return candidates.groupBy("kind").agg(F.count("*").alias("updates"), F.sum(F.col("payload_len") + header).cast("long").alias("total_bytes")).orderBy("total_bytes", "kind")


def method_totals(messages: DataFrame) -> DataFrame:
    """Each method's messages, bytes, bytes a message and saving on the raw states, ranked by bytes. ``messages`` has method, state_bytes and bytes."""
    out = messages.groupBy("method").agg(F.count("*").alias("messages"), F.sum("bytes").cast("long").alias("total_bytes"), F.sum("state_bytes").alias("raw"))
    per, place = F.round(F.col("total_bytes") / F.col("messages"), 4), F.row_number().over(W.orderBy("total_bytes", "method"))  # one row for each method
    return out.select("method", "messages", "total_bytes", per.alias("bytes_per_message"), saving_percent(F.col("total_bytes"), F.col("raw")).alias("saving_percent"), place.alias("place"))


def converged(replicas: DataFrame, final: DataFrame, key: str = "stream_id") -> DataFrame:
    """How many replicas hold their stream's final state."""
    return replicas.join(final.withColumnRenamed("state", "final_state"), key).agg(F.count("*").alias("replicas"), F.count_if(F.col("state").eqNullSafe(F.col("final_state"))).alias("converged"))


def all_pass(checks: DataFrame) -> DataFrame:
    """Whether every check (name, ok) passed; none at all is a pass."""
    return checks.agg(F.coalesce(F.bool_and("ok"), F.lit(True)).alias("all_pass"), F.count("*").alias("checks"))
