"""Choice of the cheapest representation. Ranks decide among equals: the one that is tried first wins."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.functions import codec, udfs
from tidewright.functions.expressions import encoded_len
from tidewright.operators.diff import json_deltas, profiles_of_change
from tidewright.operators.streams import ordered_fold, with_previous, with_text


@dataclass(frozen=True)
class Policy:
    """When a delta may stand for a snapshot, and whether zstd is tried."""

    min_delta_savings: int = 1
    max_delta_ratio: float = 0.98
    zstd: bool = False
    zstd_level: int = 1
    min_compression_savings: int = 8
    cpu_penalty: int = 0


@dataclass(frozen=True)
class SelectorPolicy:
    sparse_percent: int = 8
    range_runs: int = 64
    xor_percent: float = 45.0
    explore_every: int = 64
    window: int = 64


def choose(snapshot: Column, delta: Column, snapshot_zstd: Column | None = None, delta_zstd: Column | None = None, policy: Policy = Policy()) -> Column:
    """struct(bytes, mode) of the cheapest of up to four packets, by encoded lengths.

    Raw lengths say whether a delta is allowed, also for the compressed one. Null lengths are candidates that aren't there.
    """
    allowed = F.coalesce((delta / snapshot <= policy.max_delta_ratio) & (delta + policy.min_delta_savings <= snapshot), F.lit(False))
    rows = [(F.lit(True), snapshot, "snapshot", 0, 0)]
    if policy.zstd and snapshot_zstd is not None:
        rows.append((snapshot_zstd.isNotNull(), snapshot_zstd, "snapshot_zstd", 1, policy.cpu_penalty))
    rows.append((allowed, delta, "delta", 2, 0))
    if policy.zstd and delta_zstd is not None:
        rows.append((allowed & delta_zstd.isNotNull(), delta_zstd, "delta_zstd", 3, policy.cpu_penalty))
    best = F.array_min(F.filter(F.array(*(F.when(ok, F.struct((n + penalty).cast("long").alias("score"), F.lit(rank).alias("rank"), n.cast("long").alias("bytes"), F.lit(mode).alias("mode"))) for ok, n, mode, rank, penalty in rows)), lambda x: x.isNotNull()))
    return F.struct(best["bytes"].alias("bytes"), best["mode"].alias("mode"))


def four_way(profiles: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """The audited choice for each profile: lengths of all candidates, mode and bytes."""
    both = json_deltas(with_text(profiles))
    size = lambda c: encoded_len(F.octet_length(c)).cast("long")
    small = [size(udfs.zstd_payload_at(policy.zstd_level, policy.min_compression_savings)(F.col(c).cast("binary"))).alias(f"{name}_zstd_bytes") for c, name in (("state", "snapshot"), ("delta", "delta"))] if policy.zstd else []
    sized = both.select("stream_id", "seq", F.octet_length("state").cast("long").alias("state_bytes"), size("state").alias("snapshot_bytes"), size("delta").alias("delta_bytes"), *small)
    zstd = [F.col("snapshot_zstd_bytes"), F.col("delta_zstd_bytes")] if policy.zstd else []
    chosen = choose(F.col("snapshot_bytes"), F.col("delta_bytes"), *zstd, policy=policy)
    return sized.withColumn("c", chosen).select("*", F.col("c.mode").alias("mode"), F.col("c.bytes").alias("selected_bytes")).drop("c")


def _best(snapshot_len: Column, rest: Column) -> Column:
    """struct(payload_len, rank, kind) of the least of a snapshot and an array of candidates, and how many were looked at."""
    first = F.struct(snapshot_len.cast("long").alias("payload_len"), F.lit(0).alias("rank"), F.lit("snapshot").alias("kind"))
    every = F.concat(F.array(first), F.transform(rest, lambda c: F.struct(c["len"].alias("payload_len"), c["rank"].alias("rank"), c["kind"].alias("kind"))))
    return F.struct(F.array_min(every).alias("best"), F.size(every).cast("long").alias("considered"))


def exhaustive(states: DataFrame, chunk: int = 1024) -> DataFrame:
    """For each byte state the cheapest of snapshot and all delta candidates, without compression: mode and bytes.

    Candidates are weighed inside their row, so the one shuffle on the stream is the only one.
    """
    both = with_previous(states).withColumn("c", _best(F.octet_length("state"), udfs.candidate_lengths(chunk)("prev_state", "state")))
    return both.select("stream_id", "seq", F.octet_length("state").cast("long").alias("state_bytes"), F.col("c.considered").alias("considered"), F.col("c.best.kind").alias("mode"), encoded_len(F.col("c.best.payload_len")).alias("selected_bytes"))


def shortlist(changed_percent: Column, runs: Column, resized: Column, p: SelectorPolicy = SelectorPolicy()) -> Column:
    """The one or two kinds worth encoding, without memory of earlier winners."""
    pair = lambda a, b: F.array(F.lit(a), F.lit(b))
    return (
        F.when(resized, pair("splice", "chunks")).when(changed_percent <= p.sparse_percent, pair("sparse", "ranges")).when(runs <= p.range_runs, pair("ranges", "sparse"))
        .when(changed_percent >= p.xor_percent, pair("xor", "ranges")).otherwise(pair("ranges", "sparse"))
    )


def shortlisted(states: DataFrame) -> DataFrame:
    """The shortlist of each update of a byte stream."""
    p = profiles_of_change(states)
    top = F.greatest("previous_len", "current_len", F.lit(1))
    percent = F.col("changed_bytes") / top * 100
    return p.select("stream_id", "seq", "changed_bytes", "changed_runs", "resized", F.array_join(shortlist(percent, F.col("changed_runs"), F.col("resized")), ",").alias("shortlist"))


def fast(states: DataFrame) -> DataFrame:
    """Snapshot against the shortlisted candidates alone, without memory or compression. Only those are encoded."""
    both = with_previous(states).withColumn("p", udfs.change_profile("prev_state", "state"))
    top = F.greatest("p.previous_len", "p.current_len", F.lit(1))
    listed = F.when(F.col("prev_state").isNotNull(), shortlist(F.col("p.changed_bytes") / top * 100, F.col("p.changed_runs"), F.col("p.previous_len") != F.col("p.current_len")))
    both = both.withColumn("c", _best(F.octet_length("state"), udfs.listed_lengths("prev_state", "state", listed)))
    return both.select("stream_id", "seq", F.col("c.considered").alias("considered"), F.col("c.best.kind").alias("mode"), encoded_len(F.col("c.best.payload_len")).alias("selected_bytes"))


# ---- policies with memory: an ordered fold for each stream -------------------------


class Tuner:
    """The length from which compression is tried: doubled or halved after each 32 attempts by how many of them won."""

    def __init__(self) -> None:
        self.least, self.attempts, self.wins = 256, 0, 0

    def tries(self, n: int) -> bool:
        return n >= max(self.least, 64)

    def saw(self, before: int, after: int) -> None:
        self.attempts += 1
        self.wins += after < before
        if self.attempts == 32:
            if self.wins < 3.2:
                self.least = min(max(self.least * 2, 64), 64 << 10)
            elif self.wins > 19.2:
                self.least = max(self.least // 2, 64)
            self.attempts = self.wins = 0


class Advisor:
    """Remembers recent winners; a dominant one is tried alone but for an update now and then."""

    def __init__(self, policy: SelectorPolicy = SelectorPolicy()) -> None:
        self.policy, self.winners, self.updates, self.attempts, self.wins = policy, [], 0, 0, 0

    def exploring(self) -> bool:
        return self.policy.explore_every > 0 and self.updates > 0 and self.updates % self.policy.explore_every == 0

    def dominant(self) -> str | None:
        if len(self.winners) < 8:
            return None
        counts = {k: self.winners.count(k) for k in codec.CODES}
        best = max(codec.CODES, key=lambda k: (counts[k], codec.CODES[k]))
        return best if 4 * counts[best] >= 3 * len(self.winners) else None

    def list(self, old: bytes, new: bytes) -> tuple[str, ...]:
        if len(old) != len(new):
            return ("splice", "chunks")
        top = self.dominant()
        if top and not self.exploring():
            return (top,)
        starts, ends = codec.changed_ranges(old, new)
        percent = 100.0 * int((ends - starts).sum()) / max(len(new), 1)
        if percent <= self.policy.sparse_percent:
            return ("sparse", "ranges")
        if len(starts) > self.policy.range_runs and percent >= self.policy.xor_percent:
            return ("xor", "ranges")
        return ("ranges", "sparse")

    def compresses(self, n: int, least: int) -> bool:
        return n >= least and (self.attempts < 16 or self.wins / self.attempts >= 0.15 or self.exploring())

    def saw(self, mode: str) -> None:
        self.updates += 1
        if mode in codec.CODES:
            self.winners = [*self.winners, mode][-max(self.policy.window, 1) :]


FAST = "stream_id long, seq long, mode string, considered long, selected_bytes long"


class FastEncoder:
    """One stream's fast encoder: winner memory, compression gate, and the state before."""

    def __init__(self, zstd: bool = True, min_zstd: int = 256, min_savings: int = 8) -> None:
        self.advisor, self.old, self.zstd, self.min_zstd, self.min_savings = Advisor(), None, zstd, min_zstd, min_savings

    def encode(self, seq: int, new: bytes) -> tuple[str, int, int]:
        """Mode, candidates considered and encoded bytes of the next state."""
        snap, advisor = codec.Packet("snapshot", seq, 0, 0, 0, new), self.advisor
        best, mode, seen = snap.encoded_len, "snapshot", 1
        if self.old is None:
            if self.zstd and len(new) >= self.min_zstd:
                small = codec.zstd_candidate(snap, 1, self.min_savings)
                seen += 1
                if small.compressed and small.encoded_len < best:
                    best, mode = small.encoded_len, "snapshot_zstd"
        else:
            for kind in advisor.list(self.old, new):
                p = codec.Packet("delta", seq, seq - 1, 0, 0, codec.encode_delta(kind, self.old, new))
                seen += 1
                if p.encoded_len < best:
                    best, mode = p.encoded_len, kind
                if self.zstd and advisor.compresses(len(p.payload), self.min_zstd):
                    small = codec.zstd_candidate(p, 1, self.min_savings)
                    seen += 1
                    advisor.attempts += 1
                    advisor.wins += small.compressed and small.encoded_len < p.encoded_len
                    if small.compressed and small.encoded_len < best:
                        best, mode = small.encoded_len, f"{kind}_zstd"
            advisor.saw(mode.removesuffix("_zstd"))
        self.old = new
        return mode, seen, best


def _fast_rows(encoder: FastEncoder, pdf: pd.DataFrame) -> list[tuple]:
    return [(stream, seq, *encoder.encode(int(seq), new)) for stream, seq, new in zip(pdf["stream_id"], pdf["seq"], pdf["state"], strict=True)]


def fast_with_memory(states: DataFrame, **options) -> DataFrame:
    """The fast encoder with its winner memory and compression gate: stream_id, seq, mode, considered, selected_bytes.

    What is chosen at one update depends on the choices before it, so each
    stream is folded in order, batch by batch.
    """
    return ordered_fold(states, ["stream_id"], "seq", lambda: FastEncoder(**options), _fast_rows, FAST)


def fast_in_place(states: DataFrame, **options) -> DataFrame:
    """As fast_with_memory, without a shuffle, for states that stand in order already, each stream as a whole in one partition.

    Batches pass one by one, so a stream of any length takes the memory of one batch and one state.
    """

    def fold(batches):
        at, encoder = None, None
        for pdf in batches:
            rows = []
            for stream, part in pdf.groupby("stream_id", sort=False):
                if stream != at:
                    at, encoder = stream, FastEncoder(**options)
                rows += _fast_rows(encoder, part)
            yield pd.DataFrame(rows, columns=["stream_id", "seq", "mode", "considered", "selected_bytes"])

    return states.mapInPandas(fold, FAST)


def exhaustive_with_tuner(states: DataFrame, min_savings: int = 8) -> DataFrame:
    """The exhaustive encoder with its compression tuner: stream_id, seq, mode, considered, selected_bytes, least (length from which zstd is tried next)."""

    def step(held: list, pdf: pd.DataFrame) -> list[tuple]:
        tuner, old = held
        rows = []
        for stream, seq, new in pdf[["stream_id", "seq", "state"]].itertuples(index=False):
            packets = [("snapshot", codec.snapshot(int(seq), new, 0))]
            if old is not None:
                packets += [(k, codec.Packet("delta", int(seq), int(seq) - 1, 0, 0, p)) for k, p in codec.candidates(old, new).items()]
            best, mode, seen = packets[0][1].encoded_len, "snapshot", 0
            for kind, p in packets:
                seen += 1
                if p.encoded_len < best:
                    best, mode = p.encoded_len, kind
                if tuner.tries(len(p.payload)):
                    small = codec.zstd_candidate(p, 1, min_savings)
                    seen += 1
                    tuner.saw(p.encoded_len, small.encoded_len)
                    if small.compressed and small.encoded_len < best:
                        best, mode = small.encoded_len, f"{kind}_zstd"
            rows.append((stream, seq, mode, seen, best, tuner.least))
            old = held[1] = new
        return rows

    return ordered_fold(states, ["stream_id"], "seq", lambda: [Tuner(), None], step, "stream_id long, seq long, mode string, considered long, selected_bytes long, least long")
