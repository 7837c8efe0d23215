"""Validation of packet chains: what a subscriber does with each delivery.

Deliveries in order of arrival are classified by windows alone. Any other order
needs a fold of each client's deliveries, in ``fold``.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewright.functions import codec
from tidewright.operators.streams import ordered_fold

OUTCOMES = "client_id long, arrival long, seq long, outcome string, local_seq long"


def classify(deliveries: DataFrame) -> DataFrame:
    """Outcome of each delivery (client_id, arrival, seq, kind) when sequences never fall but by repetition.

    Deliveries above all before form islands of consecutive sequences; a packet
    is applied if its island has a snapshot at or before it, else a snapshot is
    needed. A snapshot begins an island. A repeat is a duplicate if something as
    high was applied, and needs a snapshot as its first delivery did if not.
    """
    w = W.partitionBy("client_id").orderBy("arrival")
    seen = deliveries.withColumn("top", F.max("seq").over(w.rowsBetween(W.unboundedPreceding, -1)))
    fresh = seen.withColumn("fresh", F.col("top").isNull() | (F.col("seq") > F.col("top")))
    new = fresh.where("fresh").withColumn("starts", ((F.col("kind") == "snapshot") | ~F.coalesce(F.col("seq") == F.lag("seq").over(w) + 1, F.lit(False))).cast("int"))
    island = new.withColumn("island", F.sum("starts").over(w))
    good = F.max(F.when(F.col("kind") == "snapshot", 1).otherwise(0)).over(W.partitionBy("client_id", "island").orderBy("arrival"))
    judged = island.withColumn("outcome", F.when(good == 1, "applied").otherwise("need_snapshot"))
    again = fresh.where("not fresh").withColumn("outcome", F.lit(None).cast("string"))
    columns = ["client_id", "arrival", "seq", "kind", "outcome"]
    every = judged.select(*columns).unionByName(again.select(*columns))
    local = F.max(F.when(F.col("outcome") == "applied", F.col("seq"))).over(w.rowsBetween(W.unboundedPreceding, -1))
    repeat = F.when(F.coalesce(F.col("seq") <= F.col("local"), F.lit(False)), "duplicate").otherwise("need_snapshot")
    return every.withColumn("local", local).select("client_id", "arrival", "seq", "kind", F.coalesce("outcome", repeat).alias("outcome"))


class Chain:
    """One subscriber: local sequence, and deltas that wait for their base.

    ``reorder`` is the number of waiting packets (0: none wait) and ``gap`` how far
    ahead a base may be. ``step`` gives outcomes of one delivery, drained ones too.
    """

    def __init__(self, local: int | None = None, reorder: int = 0, gap: int = 8) -> None:
        self.local, self.reorder, self.gap, self.pending = local, reorder, gap, {}

    def step(self, kind: str, seq: int, base: int) -> tuple[str, list[int]]:
        if kind == "delta" and self.reorder and self.local is not None and base > self.local:
            if base - self.local <= self.gap and len(self.pending) < self.reorder:
                self.pending.setdefault(seq, base)
                return "buffered", []
            return "need_recovery", []
        if self.local is not None and seq <= self.local:
            return "duplicate", []
        if kind == "delta" and base != self.local:
            return "need_recovery" if self.reorder else "need_snapshot", []
        self.local = seq
        drained = []
        while self.local + 1 in self.pending:
            if self.pending.pop(self.local + 1) != self.local:
                return "need_recovery", drained
            self.local += 1
            drained.append(self.local)
        return "applied", drained


def fold(deliveries: DataFrame, reorder: int = 0, gap: int = 8) -> DataFrame:
    """Outcome of each delivery (client_id, arrival, seq, kind, base_seq) in whatever order it came."""

    def step(chain: Chain, pdf: pd.DataFrame) -> list[tuple]:
        rows = []
        for c, a, s, k, b in pdf[["client_id", "arrival", "seq", "kind", "base_seq"]].itertuples(index=False):
            outcome, _ = chain.step(k, int(s), int(b))
            rows.append((c, a, s, outcome, chain.local))
        return rows

    return ordered_fold(deliveries, ["client_id"], "arrival", lambda: Chain(None, reorder, gap), step, OUTCOMES)


class Receiver:
    """One subscriber with its state: packets on the wire in, outcomes out.

    Each packet is decoded (under ``cap``), its schema checked or, with
    ``routes`` from (schema, schema) to a function of bytes, migrated; a repeat
    is told by its sequence; a delta is applied if the state here has the hash of
    its base, after decompression. Outcomes are applied, buffered, duplicate,
    need_snapshot (need_recovery where packets may wait) or the kind of an error,
    which changes nothing here.
    """

    def __init__(self, schema: int, reorder: int = 0, gap: int = 8, cap: int = codec.MAX_PAYLOAD, routes: dict | None = None) -> None:
        self.schema, self.cap, self.routes = schema, cap, routes
        self.chain, self.state, self.hash = Chain(None, reorder, gap), None, None
        self.waiting: dict[int, codec.Packet] = {}

    @property
    def need(self) -> str:
        return "need_recovery" if self.chain.reorder else "need_snapshot"

    def reset(self) -> None:
        """As new: a publisher has begun anew."""
        self.chain.local, self.state, self.hash = None, None, None
        self.forget()

    def forget(self) -> None:
        """Drop the packets that wait."""
        self.chain.pending.clear()
        self.waiting.clear()

    def receive(self, wire: bytes) -> tuple[str, list[int]]:
        """The packet's outcome, and the sequences that waited for it and were applied after it."""
        try:
            p = codec.decode_packet(wire, self.cap)
            if p.schema_hash != self.schema and (self.routes is None or p.kind == "delta"):
                return ("SchemaMismatch" if self.routes is None else self.need), []
            return self._take(p)
        except codec.CodecError as e:
            return e.kind, []

    def _take(self, p: codec.Packet) -> tuple[str, list[int]]:
        chain = self.chain
        fresh = chain.local is None or p.sequence > chain.local
        if fresh and p.kind == "snapshot":
            state = codec.logical_payload(p, self.cap)
            if codec.fnv1a64(state) != p.base_hash:
                raise codec.CodecError("InvalidState", "snapshot hash")
            if p.schema_hash != self.schema:
                if (p.schema_hash, self.schema) not in self.routes:
                    raise codec.CodecError("SchemaMigrationMissing", "no route")
                state = self.routes[p.schema_hash, self.schema](state)
            self._set(state)
        elif fresh and p.base_sequence == chain.local:
            if p.base_hash != self.hash:
                return self.need, []
            self._set(codec.apply_delta(self.state, codec.logical_payload(p, self.cap)))
        outcome, drained = chain.step(p.kind, p.sequence, p.base_sequence)
        if outcome == "buffered":
            self.waiting.setdefault(p.sequence, p)
        for i, seq in enumerate(drained):
            q = self.waiting.pop(seq)
            if q.base_hash != self.hash:
                chain.local = seq - 1
                return self.need, drained[:i]
            self._set(codec.apply_delta(self.state, codec.logical_payload(q, self.cap)))
        return outcome, drained

    def _set(self, state: bytes) -> None:
        self.state, self.hash = state, codec.fnv1a64(state)


RECEIVED = "client_id long, epoch long, arrival long, outcome string, local_seq long, state_hash string"


def receive(deliveries: DataFrame, schema: int, reorder: int = 0, gap: int = 8, cap: int = codec.MAX_PAYLOAD, routes: dict | None = None) -> DataFrame:
    """RECEIVED: each client's deliveries (client_id, epoch, arrival, wire) through a receiver, which a new epoch resets; the state's hash after each."""

    def step(held: list, pdf: pd.DataFrame) -> list[tuple]:
        rows = []
        for client, epoch, arrival, wire in pdf[["client_id", "epoch", "arrival", "wire"]].itertuples(index=False):
            receiver, before = held
            if epoch != before:
                receiver.reset()
                held[1] = epoch
            outcome, _ = receiver.receive(bytes(wire))
            rows.append((client, epoch, arrival, outcome, receiver.chain.local, None if receiver.hash is None else f"{receiver.hash:016x}"))
        return rows

    return ordered_fold(deliveries, ["client_id"], "arrival", lambda: [Receiver(schema, reorder, gap, cap, routes), None], step, RECEIVED)


def check_schema(deliveries: DataFrame, schema_hash: str) -> DataFrame:
    """Deliveries with the column error: SchemaMismatch for those of another schema, before anything else is looked at."""
    return deliveries.withColumn("error", F.when(F.col("schema_hash") != schema_hash, F.lit("SchemaMismatch")))


def without_repeats(deliveries: DataFrame, *keys: str) -> DataFrame:
    """Each client's deliveries whose sequence is above all before: what suppression lets through. With ``epoch`` among ``keys`` it begins anew in each."""
    w = W.partitionBy(*(keys or ("client_id",))).orderBy("arrival").rowsBetween(W.unboundedPreceding, -1)
    return deliveries.withColumn("top", F.max("seq").over(w)).where("top is null or seq > top").drop("top")


def migrate(states: DataFrame, registry: DataFrame) -> DataFrame:
    """Snapshots (schema, target, value) brought to their target schema by the one-hop routes of ``registry`` (from_schema, to_schema, add).

    Without a route the error is SchemaMigrationMissing; a delta across schemas needs a snapshot. The registry is
    a table of routes, as small as a program's list of versions.
    """
    same = F.col("schema") == F.col("target")
    routed = states.join(registry, (F.col("schema") == F.col("from_schema")) & (F.col("target") == F.col("to_schema")), "left")
    outcome = F.when(same, "applied").when(F.col("kind") == "delta", "need_snapshot").when(F.col("add").isNull(), "SchemaMigrationMissing").otherwise("migrated")
    value = F.when(same, F.col("value")).when((F.col("kind") == "snapshot") & F.col("add").isNotNull(), F.concat(F.expr("substring(value, 1, length(value) - 1)"), F.lit(","), F.col("add"), F.lit("}")))
    return routed.withColumn("outcome", outcome).withColumn("migrated", value).drop("from_schema", "to_schema", "add")
