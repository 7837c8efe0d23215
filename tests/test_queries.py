"""Every query with SQL against that SQL, and every other one for rows."""

from __future__ import annotations

import pytest

from tests.conftest import SF
from tidewright.plans import registry


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_as_sql(name, same_as_sql):
    same_as_sql(registry.queries()[name], registry.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_has_rows(name, spark):
    assert registry.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_zstd_comes_back(spark):
    assert registry.queries()["zstd_candidates"](spark, SF).where("not same").count() == 0


def test_simulations_converge_and_every_fault_fires(spark):
    for w, faults in {"multi_client": ("drops", "duplicates", "resyncs", "reorders", "disconnects"), "torture": ("drops", "duplicates", "resyncs", "reorders", "corruptions", "late_joins", "storm", "buffered"), "fast_torture": ("drops", "duplicates", "corruptions", "resyncs", "reorders", "late_joins")}.items():
        r = registry.queries()[f"simulate_{w}"](spark, SF).first()
        assert r["converged"] == r["clients"] and all(r[f] for f in faults), (w, r)


def test_reorder_of_whole_streams(spark):
    from tidewright.operators.subscribe import Chain

    streams: dict = {}
    for r in spark.read.parquet(f"{SF}/events.parquet").select("user_id").collect():
        streams[r["user_id"]] = streams.get(r["user_id"], 0) + 1
    want = []
    for client, n in streams.items():
        order = sorted(range(1, n + 1), key=lambda s: s + 1 if s % 10 == 5 else s - 1 if s % 10 == 6 else s)
        chain = Chain(None, 64, 8)
        want += [(client, s, chain.step("snapshot" if s == 1 else "delta", s, s - 1)[0]) for s in order]
    got = registry.queries()["bounded_reorder_whole"](spark, SF).select("client_id", "seq", "outcome").collect()
    assert sorted(map(tuple, got)) == sorted(want) and len(got) == sum(streams.values())


def test_manifest_of_all_items(spark):
    want = []
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        b = (r["text"] or "").encode()
        for i in range(0, len(b), 64):
            h = 14695981039346656037
            for x in b[i : i + 64]:
                h = (h ^ x) * 1099511628211 % (1 << 64)
            want.append((r["item_id"], i // 64, f"{h:016x}"))
    got = registry.queries()["chunk_manifest_whole"](spark, SF).select("item_id", "idx", "hash").collect()
    assert sorted(map(tuple, got)) == sorted(want)
