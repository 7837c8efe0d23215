"""Receivers that hold states, workloads over real packets, verified repair, ordered folds and the entry without its optional part."""

from __future__ import annotations

import importlib
import sys

import pytest

from tests.conftest import SF
from tidewright.functions import codec
from tidewright.operators import recover, select, simulate, streams
from tidewright.operators.subscribe import Receiver
from tidewright.plans import registry
from tidewright.streaming import session


def chain_of(*states, schema=7, zstd=False):
    out = [codec.snapshot(1, states[0], schema)]
    for i, (a, b) in enumerate(zip(states, states[1:], strict=False), 2):
        out.append(codec.delta(i, a, schema, codec.encode_delta("splice", a, b)))
    return [codec.encode_packet(codec.zstd_candidate(p) if zstd else p) for p in out]


def test_receiver_follows_a_chain():
    states = [b"a" * 300, b"a" * 299 + b"b", b"c" + b"a" * 298 + b"b", b"c" * 400]
    for zstd in (False, True):
        r = Receiver(7)
        for wire, state in zip(chain_of(*states, zstd=zstd), states, strict=True):
            assert r.receive(wire)[0] == "applied" and r.state == state
        assert r.receive(chain_of(*states)[1])[0] == "duplicate" and r.state == states[-1]


def test_receiver_refuses_what_does_not_fit():
    one, two, three = chain_of(b"one", b"two", b"three")
    assert Receiver(8).receive(one)[0] == "SchemaMismatch" and Receiver(7, cap=2).receive(one)[0] == "PacketTooLarge"
    r = Receiver(7)
    assert r.receive(two)[0] == "need_snapshot" and r.receive(one)[0] == "applied" and r.receive(three)[0] == "need_snapshot"
    other = chain_of(b"uno", b"dos")[1]
    assert r.receive(other)[0] == "need_snapshot" and r.state == b"one"  # the base's hash is another's
    assert r.receive(two[:-1] + b"?")[0] == "ChecksumMismatch" and r.receive(two)[0] == "applied"
    wrong = codec.encode_packet(codec.Packet("snapshot", 9, 0, 1, 7, b"state"))
    assert r.receive(wrong)[0] == "InvalidState" and r.state == b"two"
    r.reset()
    assert r.state is None and r.receive(two)[0] == "need_snapshot" and r.receive(one)[0] == "applied"


def test_receiver_lets_packets_wait():
    one, two, three, four = chain_of(b"1", b"12", b"123", b"1234")
    r = Receiver(7, reorder=8)
    assert [r.receive(w) for w in (one, four, three)] == [("applied", []), ("buffered", []), ("buffered", [])]
    assert r.receive(two) == ("applied", [3, 4]) and r.state == b"1234"


def test_receiver_migrates_snapshots():
    old = codec.encode_packet(codec.snapshot(1, b"{}", 5))
    r = Receiver(7, routes={(5, 7): lambda state: state[:-1] + b'"label":"m"}'})
    assert r.receive(old)[0] == "applied" and r.state == b'{"label":"m"}'
    assert Receiver(7, routes={}).receive(old)[0] == "SchemaMigrationMissing"
    bad = codec.encode_packet(codec.Packet("snapshot", 1, 0, 1, 5, b"{}"))
    assert Receiver(7, routes={(5, 7): bytes}).receive(bad)[0] == "InvalidState"
    assert r.receive(codec.encode_packet(codec.delta(2, b"{}", 5, b"")))[0] == "need_snapshot"


def test_states_decide_on_convergence(spark):
    log = spark.createDataFrame([(0, 0, 0, "packet", 1), (0, 1, 0, "packet", 2), (1, 0, 0, "packet", 1), (2, 1, 0, "damaged", 2)], "client_id long, update long, turn int, action string, seq long")
    ends = {r["client_id"]: (r["outcome"], r["drained"]) for r in simulate.received(log, 2).where("action = 'end'").collect()}
    assert ends == {0: ("converged", 1), 1: ("converged", 0), 2: ("converged", 0)}
    told = {(r["client_id"], r["update"]): r["outcome"] for r in simulate.received(log, 2).where("action != 'end'").collect()}
    assert told == {(0, 0): "applied", (0, 1): "applied", (1, 0): "applied", (2, 1): "ChecksumMismatch"}


def test_workloads_leave_some_clients_behind(spark):
    r = simulate.simulate(spark, "torture", 40, 600).first()
    assert r["converged"] == 40 and 0 < r["in_step"] <= 40 and r["corruptions"] and r["late_joins"] and r["storm"] and r["shared_snapshots"]


def test_repairs_are_held_against_the_whole(spark):
    old = spark.createDataFrame([(1, bytearray(b"a" * 100)), (2, bytearray(b"b" * 100))], "k long, state binary")
    new = spark.createDataFrame([(1, bytearray(b"a" * 64 + b"z" * 80)), (2, bytearray(b""))], "k long, state binary")
    goal = spark.createDataFrame([(1, 144, f"{codec.fnv1a64(b'a' * 64 + b'z' * 80):016x}"), (2, 0, f"{codec.fnv1a64(b''):016x}")], "k long, target_len long, target_hash string")
    patches = recover.repair(old, new, "k", 32)
    got = {r["k"]: (bytes(r["state"]), r["error"]) for r in recover.apply_repair(old, patches, goal, "k", 32).collect()}
    assert got == {1: (b"a" * 64 + b"z" * 80, None), 2: (b"", None)}
    hurt = patches.selectExpr("k", "idx", "CASE WHEN k = 1 AND idx = 3 THEN X'00' ELSE bytes END AS bytes")
    assert {r["k"]: r["error"] for r in recover.apply_repair(old, hurt, goal, "k", 32).collect()} == {1: "InvalidState", 2: None}


@pytest.mark.parametrize("rows", [7, 10_000])
def test_batches_change_no_result(spark, same_as_sql, rows):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, rows)
    try:
        for name in ("streaming_subscriber", "subscriber_fold", "receiver_states"):
            same_as_sql(registry.queries()[name], registry.oracle_sql()[name])
        assert spark.conf.get(key) == str(rows)
    finally:
        spark.conf.set(key, before)


def test_compressed_packets_are_chosen_where_smaller(spark):
    p = streams.profile_states(spark.read.parquet(f"{SF}/events.parquet"))
    with_zstd, plain = select.four_way(p, select.Policy(zstd=True)), select.four_way(p)
    assert with_zstd.where("mode like '%zstd'").count() > 0
    both = with_zstd.alias("z").join(plain.alias("p"), ["stream_id", "seq"])
    assert both.where("z.selected_bytes > p.selected_bytes").count() == 0
    assert with_zstd.where("mode = 'snapshot_zstd' and snapshot_zstd_bytes + 8 >= snapshot_bytes").count() == 0


def test_replies_are_packets(spark):
    log = spark.createDataFrame([("s", i, bytearray(b"p%d" % i)) for i in (1, 2, 3)], "stream_id string, seq long, wire binary")
    plans = spark.createDataFrame([("r1", "s", 1, 3, "replay"), ("r2", "s", None, 3, "snapshot")], "reply_channel string, stream_id string, local_seq long, target_seq long, strategy string")
    whole = spark.createDataFrame([("s", bytearray(b"all"))], "stream_id string, wire binary")
    got = sorted((r["topic"], r["seq"], r["kind"], bytes(r["payload"])) for r in session.replies(plans, log, whole).collect())
    assert got == [("r1", 2, "replay", b"p2"), ("r1", 3, "replay", b"p3"), ("r2", 3, "snapshot", b"all")]


def test_entry_works_without_the_optional_part(monkeypatch):
    import __spark_entry__ as e

    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    try:
        importlib.reload(e)
        assert "pipeline" not in e.queries() and "adaptive_sync_report" in e.queries() and set(e.oracle_sql()) <= set(e.queries())
    finally:
        monkeypatch.undo()
        importlib.reload(e)
