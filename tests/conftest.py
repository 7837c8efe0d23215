from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    place = tmp_path_factory.mktemp("shared")
    session = (
        SparkSession.builder.master("local[8]").appName("tests").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"file://{place}").config("spark.driver.memory", "4g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.fixture(scope="session")
def same_as_sql(spark, duck):
    """Whether a query's rows are those of its SQL."""
    import decimal
    import math

    def plain(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return None
        if isinstance(v, (decimal.Decimal, float)) and v == int(v):
            return int(v)
        return float(v) if isinstance(v, decimal.Decimal) else v

    def compare(query, sql):
        df = query(spark, SF)
        names = sorted(df.columns)
        got = [tuple(map(plain, r)) for r in df.select(*names).collect()]
        rel = duck.execute(sql)
        columns = [c[0] for c in rel.description]
        assert sorted(columns) == names
        want = [tuple(plain(r[columns.index(n)]) for n in names) for r in rel.fetchall()]
        key = lambda r: tuple((v is None, str(v)) for v in r)
        assert sorted(got, key=key) == sorted(want, key=key)

    return compare
