"""Sessions as Structured Streaming: topics, a packet log, live subscribers and the control loop.

A message is a row (topic string, payload binary). The packet log is a table
that ``publish`` appends to by micro-batch; requests are answered from it.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.operators.recover import replay_plans
from tidewright.operators.subscribe import Chain

MESSAGE = "topic string, payload binary"
CONTROL = "type string, client_id string, min_version int, max_version int, selected_version int, sequence bigint, local_sequence bigint, required_sequence bigint, reply_channel string"
OWN_VERSION = 3
#: Bounds of a subscriber's waiting packets.
MAX_PENDING, MAX_GAP = 64, 8


def topics(name: str, client: str | None = None) -> dict[str, str]:
    """A stream's topics: data, control and, for a client, reply."""
    out = {"data": name, "control": f"{name}.control"}
    return out | ({"reply": f"{name}.reply.{client}"} if client is not None else {})


def subscribed(messages: DataFrame, wanted: list[str]) -> DataFrame:
    return messages.where(F.col("topic").isin(wanted))


def parse_control(messages: DataFrame) -> DataFrame:
    """Control messages of a control topic; what doesn't parse is left out."""
    return messages.select("topic", F.from_json(F.decode("payload", "UTF-8"), CONTROL).alias("c")).where("c.type is not null").select("topic", "c.*")


def hello_acks(control: DataFrame) -> DataFrame:
    """Answers to hellos whose version range holds the publisher's version."""
    fits = (F.col("type") == "hello") & (F.col("min_version") <= OWN_VERSION) & (F.col("max_version") >= OWN_VERSION)
    ack = F.to_json(F.struct(F.lit("hello_ack").alias("type"), "client_id", F.lit(OWN_VERSION).alias("selected_version")))
    return control.where(fits).select(F.col("reply_channel").alias("topic"), ack.cast("binary").alias("payload"))


def answers(control: DataFrame, history: DataFrame, current: DataFrame) -> DataFrame:
    """Plans for resync requests: a stream-static join of requests to the history and to each stream's current snapshot (stream_id, target_seq, snapshot_bytes)."""
    asked = control.where("type = 'resync_request'").select("client_id", F.element_at(F.split("topic", r"\.control$"), 1).alias("stream_id"), F.col("local_sequence").alias("local_seq"), "reply_channel")
    return replay_plans(history, asked.join(current, "stream_id"))


def replies(plans: DataFrame, log: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Packets on reply topics for plans (reply_channel, stream_id, local_seq, target_seq, strategy): topic, seq, kind, payload.

    A replay is each packet of ``log`` (stream_id, seq, wire) after the client's;
    otherwise the stream's snapshot (stream_id, wire) at the target.
    """
    missing = plans.where("strategy = 'replay'").select("reply_channel", "stream_id", F.explode(F.sequence(F.col("local_seq") + 1, F.col("target_seq"))).alias("seq"))
    replayed = missing.join(log, ["stream_id", "seq"]).select(F.col("reply_channel").alias("topic"), "seq", F.lit("replay").alias("kind"), F.col("wire").alias("payload"))
    whole = plans.where("strategy = 'snapshot'").join(snapshots, "stream_id")
    return replayed.unionByName(whole.select(F.col("reply_channel").alias("topic"), F.col("target_seq").alias("seq"), F.lit("snapshot").alias("kind"), F.col("wire").alias("payload")))


def shared_place(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which all nodes share; a temporary one only where executors are the driver's threads."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all nodes of {spark.sparkContext.master} share")
        base = "file://" + tempfile.mkdtemp(prefix="tidewright-")
    return f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}"


def publish(states: DataFrame, log: str, checkpoint: str, available_now: bool = True):
    """Append each micro-batch of packets to the log; a batch that is run again replaces its own rows."""

    def append(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{log}/batch={batch_id}")

    writer = states.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


OUTCOME = "client_id string, epoch long, seq long, arrival long, outcome string, local_seq long, drained int, request boolean"
STATE = "local long, asked boolean, seqs array<long>, bases array<long>"


def follow(packets: DataFrame, reorder: int = MAX_PENDING, gap: int = MAX_GAP, idle_ms: int | None = None) -> DataFrame:
    """A live subscriber for each (client_id, epoch) over streaming packets (client_id, epoch, seq, kind, base_seq, arrival).

    A new epoch is a publisher's restart: its state begins anew. One resync
    request is out at a time, until something is applied. State is bounded by
    ``reorder`` waiting packets for each key, and goes after ``idle_ms`` without
    a packet, if that is given: the client then begins as one that has nothing.
    A micro-batch's packets of a key are put in order of arrival as a whole,
    however Spark cuts them into batches.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def run(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        chain, asked = Chain(None, reorder, gap), False
        if state.hasTimedOut:
            state.remove()
            return
        if state.exists:
            local, asked, seqs, bases = state.get
            chain.local, chain.pending = local if local >= 0 else None, dict(zip(map(int, seqs), map(int, bases), strict=True))
        rows = []
        every = pd.concat([pdf[["seq", "arrival", "kind", "base_seq"]] for pdf in pdfs]).sort_values("arrival", kind="stable")
        for seq, arrival, kind, base in every.itertuples(index=False):
            outcome, drained = chain.step(kind, int(seq), int(base))
            request = outcome.startswith("need") and not asked
            asked = False if outcome == "applied" else asked or request
            rows.append((*key, int(seq), int(arrival), outcome, chain.local, len(drained), request))
        state.update((-1 if chain.local is None else chain.local, asked, list(chain.pending), list(chain.pending.values())))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(rows, columns=["client_id", "epoch", "seq", "arrival", "outcome", "local_seq", "drained", "request"]).astype({"local_seq": "Int64"})

    return packets.groupBy("client_id", "epoch").applyInPandasWithState(run, OUTCOME, STATE, "append", GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout)


def first_of_each(packets: DataFrame, column: str = "ts", delay: str = "10 minutes") -> DataFrame:
    """Repeats of a stream's sequence dropped while within the watermark."""
    return packets.withWatermark(column, delay).dropDuplicatesWithinWatermark(["stream_id", "seq"])


def run_to_table(spark: SparkSession, stream: DataFrame, place: str, mode: str = "append") -> DataFrame:
    """Run a streaming query over what is available and read what it put out."""
    q = stream.writeStream.format("parquet").option("path", f"{place}/out").option("checkpointLocation", f"{place}/progress").outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    return spark.read.schema(stream.schema).parquet(f"{place}/out")
