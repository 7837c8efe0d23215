"""``python -m tidewright``: list the queries, or run one over a folder of tables and show rows."""

from __future__ import annotations

import argparse


def main() -> None:
    from tidewright.plans import registry

    p = argparse.ArgumentParser(prog="tidewright", description=main.__module__)
    p.add_argument("query", nargs="?", help="name of a query; without one all names are listed")
    p.add_argument("tables", nargs="?", help="folder of the parquet tables")
    p.add_argument("--rows", type=int, default=20, help="rows to show")
    p.add_argument("--explain", action="store_true", help="show the plan instead")
    a = p.parse_args()
    if not a.query or not a.tables:
        print("\n".join(sorted(registry.queries())))
        return
    from pyspark.sql import SparkSession

    df = registry.queries()[a.query](SparkSession.builder.appName(a.query).getOrCreate(), a.tables)
    if a.explain:
        df.explain("formatted")
    else:
        df.show(a.rows, truncate=False)


if __name__ == "__main__":
    main()
