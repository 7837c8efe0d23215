"""Operators on small inputs: chains, recovery, replicas, sessions, policies."""

from __future__ import annotations

import random

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewright.operators import crdt, diff, recover, select, simulate, subscribe
from tidewright.sources import transports
from tidewright.streaming import session


def test_chain_needs_its_base():
    c = subscribe.Chain()
    assert c.step("delta", 2, 1)[0] == "need_snapshot"
    assert c.step("snapshot", 1, 0)[0] == "applied" and c.step("delta", 3, 2)[0] == "need_snapshot"
    assert c.step("delta", 9, 1)[0] == "applied"  # the base alone decides
    assert c.step("delta", 5, 4)[0] == "duplicate" and c.local == 9


def test_chain_drains_what_waited():
    c = subscribe.Chain(1, 64)
    assert c.step("delta", 4, 3) == ("buffered", []) and c.step("delta", 3, 2) == ("buffered", [])
    assert c.step("delta", 2, 1) == ("applied", [3, 4]) and c.local == 4
    assert c.step("delta", 20, 19)[0] == "need_recovery"


@given(st.permutations(range(2, 9)))
def test_any_order_within_the_gap_converges(order):
    c = subscribe.Chain(1, 64)
    for s in order:
        c.step("delta", s, s - 1)
    assert c.local == 8 and not c.pending


def test_classify_is_the_fold_for_deliveries_in_order(spark):
    rng, rows = random.Random(3), []
    for client in range(20):
        at = 0
        for seq in range(1, 60):
            kind = "snapshot" if seq == 1 or rng.random() < 0.05 else "delta"
            for _ in range(rng.choice((0, 1, 1, 1, 2))):
                rows.append((client, at, seq, kind, 0 if kind == "snapshot" else seq - 1))
                at += 1
    d = spark.createDataFrame(rows, "client_id long, arrival long, seq long, kind string, base_seq long")
    key = ["client_id", "arrival", "seq", "outcome"]
    assert sorted(subscribe.classify(d).select(*key).collect()) == sorted(subscribe.fold(d).select(*key).collect())


def test_live_subscribers_ask_once(spark, tmp_path):
    rows = [("a", 0, s, "snapshot" if s == 1 else "delta", s - 1, i) for i, s in enumerate((1, 2, 4, 12, 13, 3))] + [("a", 1, 1, "snapshot", 0, 9)]
    spark.createDataFrame(rows, session_schema := "client_id string, epoch long, seq long, kind string, base_seq long, arrival long").coalesce(1).write.parquet(str(tmp_path / "in"))
    for reorder, want in ((0, ["applied", "applied", "applied", "applied", "need_snapshot", "need_snapshot", "need_snapshot"]),):
        out = session.run_to_table(spark, session.follow(spark.readStream.schema(session_schema).parquet(str(tmp_path / "in")), reorder), str(tmp_path / f"r{reorder}"))
        got = out.collect()
        assert sorted(r["outcome"] for r in got) == want and sum(r["request"] for r in got) == 1


def test_control_loop(spark):
    msgs = [("s.control", b'{"type":"resync_request","client_id":"c","local_sequence":1,"required_sequence":3,"reply_channel":"s.reply.c"}'), ("s.control", b"junk"), ("s.control", b'{"type":"hello","client_id":"c","min_version":4,"max_version":5,"reply_channel":"r"}')]
    control = session.parse_control(spark.createDataFrame([(t, bytearray(p)) for t, p in msgs], session.MESSAGE))
    assert control.count() == 2 and session.hello_acks(control).count() == 0
    history = spark.createDataFrame([("s", 2, 1, 60), ("s", 3, 2, 60)], "stream_id string, seq long, base_seq long, encoded_len long")
    current = spark.createDataFrame([("s", 3, 500)], "stream_id string, target_seq long, snapshot_bytes long")
    assert session.answers(control, history, current).first()["strategy"] == "replay"


def test_publishing_twice_keeps_one_batch(spark, tmp_path):
    spark.range(5).write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        q = session.publish(spark.readStream.schema("id long").parquet(str(tmp_path / "in")), str(tmp_path / "log"), str(tmp_path / "progress"))
        q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "log")).count() == 5


def test_missing_client_is_named():
    with pytest.raises(RuntimeError, match="mqtt"):
        transports.client("mqtt")


def test_repair_grows_and_shrinks(spark):
    blob = bytes(range(256)) * 8
    cases = [(1, blob, blob + b"more"), (2, blob, blob[:700]), (3, blob, blob), (4, b"", blob), (5, blob, b""), (6, blob, blob[:1100] + b"x" + blob[1101:])]
    old = spark.createDataFrame([(k, bytearray(a)) for k, a, _ in cases], "k int, state binary")
    new = spark.createDataFrame([(k, bytearray(b)) for k, _, b in cases], "k int, state binary")
    patches = recover.repair(old, new, "k", 256)
    lengths = new.select("k", F.octet_length("state").alias("target_len"))
    got = {r["k"]: bytes(r["state"]) for r in recover.apply_repair(old, patches, lengths, "k", 256).collect()}
    assert got == {k: b for k, _, b in cases}
    costs = {r["k"]: r["repair_bytes"] for r in recover.repair_costs(old, new, "k", 256).collect()}
    assert costs[3] == 0 and costs[6] == 256 and costs[5] == 0


def test_counters_overflow(spark):
    top = crdt.U64_MAX
    rows = lambda *a: spark.createDataFrame([(c, r, x) for c, r, x in a], "counter string, replica string, amount string").withColumn("amount", F.col("amount").cast("decimal(20,0)"))
    assert crdt.value(rows(("a", "r", top)), "counter").first()["value"] == int(top)
    for bad in (lambda: crdt.increments(rows(("a", "r", top), ("a", "r", "1")), "counter"), lambda: crdt.value(rows(("a", "r", top), ("a", "s", "1")), "counter"), lambda: crdt.increments(rows(("a", "", "1")), "counter")):
        with pytest.raises(Exception, match="overflow|empty"):
            bad().collect()


def test_counters_over_the_cap_are_decoded(spark, tmp_path):
    from tidewright.plans import registry

    first, n = 10**18, 48_000
    kind = F.when(F.col("id") % 50 == 0, F.lit(None).cast("string")).otherwise("view")
    events = spark.range(2 * n).select(F.col("id").alias("event_id"), (F.lit(first) + F.col("id") % n).alias("user_id"), kind.alias("event_type"), F.format_string('{"k": %d}', F.col("id") % 7).alias("props"))
    events.write.parquet(str(tmp_path / "events.parquet"))
    whole = registry.queries()["crdt_documents"](spark, str(tmp_path))
    assert whole.agg(F.max(F.octet_length("document"))).first()[0] > crdt.MAX_DOCUMENT
    want = {}
    for i in range(2 * n):
        key = (None if i % 50 == 0 else "view", str(first + i % n))
        want[key] = want.get(key, 0) + i % 7
    got = registry.queries()["crdt_decoded"](spark, str(tmp_path)).collect()
    assert len(got) == len(want) and {(r["counter"], r["replica"]): r["amount"] for r in got} == want


def test_parts_of_counters(spark):
    rng = random.Random(3)
    rows = [(c, "r" * rng.choice((1, 2, 9, 40, 300)) + str(i), rng.randint(0, 9)) for c in ("a", "b", None) for i in range(200)] + [("one", "x", 5)]
    components = spark.createDataFrame(rows, "counter string, replica string, amount long")
    parts = crdt.encode_parts(components, "counter", size=100).collect()
    documents = [(r["counter"], r["document"]) for r in parts]
    entries = lambda d: d[len('{"components":{') : -2].split(",")
    assert all(len(d) < 2 * 100 + 17 or len(entries(d)) == 1 for _, d in documents)
    assert [d for c, d in documents if c == "one"] == ['{"components":{"x":5}}']
    assert len(documents) < len(rows) / 2
    assert all(entries(d) == sorted(entries(d), key=lambda e: e.split('"')[1]) for _, d in documents)
    back = crdt.decode(spark.createDataFrame(parts), "counter", cap=400).collect()
    assert sorted(map(str, ((r["counter"], r["replica"], int(r["amount"])) for r in back))) == sorted(map(str, rows))
    with pytest.raises(Exception, match="size cap"):
        crdt.decode(spark.createDataFrame(parts), "counter", cap=300).collect()


def test_merge_laws(spark):
    rng = random.Random(1)
    parts = [spark.createDataFrame([("c", f"r{i}", rng.randint(0, 9)) for i in range(4)], "counter string, replica string, amount long") for _ in range(3)]
    a, b, c = parts
    rows = lambda *dfs: sorted(map(tuple, crdt.merge(dfs[0] if len(dfs) == 1 else dfs[0].unionByName(dfs[1]), "counter").collect()))
    assert rows(a, b) == rows(b, a) and rows(crdt.merge(a.unionByName(b), "counter"), c) == rows(a, crdt.merge(b.unionByName(c), "counter")) and rows(a, a) == rows(a)


def test_map_deltas_keep_null_apart_from_missing(spark):
    df = spark.sql("select map('a', '1', 'b', null) as old, map('b', '2', 'c', null) as new")
    changed, removed = diff.map_delta(F.col("old"), F.col("new"))
    r = df.select(changed.alias("c"), removed.alias("r"), diff.map_apply(F.col("old"), changed, removed).alias("n")).first()
    assert r["c"] == {"b": "2", "c": None} and r["r"] == ["a"] and r["n"] == {"b": "2", "c": None}


def test_single_candidate_refuses_other_lengths(spark):
    df = spark.createDataFrame([(1, 1, bytearray(b"a")), (1, 2, bytearray(b"bc"))], "stream_id long, seq long, state binary")
    with pytest.raises(Exception, match="equal lengths"):
        diff.single_candidate(df, "xor").collect()


def test_advisor_and_tuner():
    a = select.Advisor()
    for _ in range(8):
        a.saw("ranges")
    assert a.list(b"abc", b"abd") == ("ranges",) and a.list(b"abc", b"abcd") == ("splice", "chunks")
    t = select.Tuner()
    for _ in range(32):
        t.saw(10, 10)
    assert t.least == 512
    for _ in range(32):
        t.saw(10, 5)
    assert t.least == 256


def test_choice_prefers_the_earlier_of_equals(spark):
    df = spark.createDataFrame([(100, 99), (100, 98), (1000, 990), (100, None), (100, 50)], "s long, d long")
    got = [r["c"]["mode"] for r in df.select(select.choose(F.col("s"), F.col("d")).alias("c")).collect()]
    assert got == ["snapshot", "delta", "snapshot", "snapshot", "delta"]
    z = df.select(select.choose(F.col("s"), F.col("d"), F.lit(40), F.lit(40), select.Policy(zstd=True)).alias("c")).collect()
    assert [r["c"]["mode"] for r in z] == ["snapshot_zstd"] * 5


def test_generators_are_deterministic():
    s = simulate.entropy_bytes(64)
    assert s == simulate.entropy_bytes(64) != simulate.entropy_bytes(64, (7, 9, 8))
    assert simulate.scattered(s, 3, 5) != s and len(simulate.scattered(b"", 1, 2)) == 0
    assert abs(simulate.cpu_percent(3)[1] - 36.1) < 1e-4


def test_encoding_in_place_is_the_fold(spark):
    states = simulate.byte_workload(spark, 5, 700, 40, 3.0)
    a, b = (sorted(map(tuple, f(states).collect())) for f in (select.fast_with_memory, select.fast_in_place))
    assert a == b and len(a) == 200


def test_scenarios_in_blocks_are_those_in_one(spark):
    sizes, percents = [250, 300], [1, 40, 100]
    got = [sorted(map(tuple, simulate.sparse_scenarios(spark, sizes, percents, 700, block).collect())) for block in (64, 1000)]
    assert got[0] == got[1] and len(got[0]) == 6


def test_entropy_scenarios_change_what_they_say(spark):
    rows = simulate.entropy_scenarios(spark, [256, 1024], [0.1, 100.0], 3, batch=512).collect()
    assert len(rows) == 12 and {len(r["state"]) for r in rows if r["stream_id"] < 2} == {256}
    by = {(r["stream_id"], r["seq"]): bytes(r["state"]) for r in rows}
    assert all(1 <= sum(a != b for a, b in zip(by[s, q], by[s, q + 1], strict=True)) <= 2 for s in (0, 2) for q in (1, 2))
