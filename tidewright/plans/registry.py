"""Named queries and, for each that SQL can express, its SQL."""

from __future__ import annotations

from tidewright import shipping
from tidewright.plans.chain_queries import QUERIES as CHAINS
from tidewright.plans.sync_queries import QUERIES as SYNC

EVERY = {**SYNC, **CHAINS}


def queries() -> dict:
    return {name: shipping(f) for name, (f, _) in EVERY.items()}


def oracle_sql() -> dict:
    return {name: sql for name, (_, sql) in EVERY.items() if sql}
