"""Message transports as streaming sources and sinks of rows (topic, payload).

``FileBus`` works wherever Spark's file systems do. Brokers are reached by
Spark's own connectors or by a client library in ``foreachBatch``; both are
optional and named only when asked for.
"""

from __future__ import annotations

import importlib
import sys

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from tidewright.streaming.session import MESSAGE


class FileBus:
    """Publish by appending files under a folder; subscribe by streaming them, filtered by topic."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def publish(self, messages: DataFrame) -> None:
        messages.select("topic", "payload").write.mode("append").parquet(self.path)

    def subscribe(self, wanted: list[str], files_at_once: int = 1000) -> DataFrame:
        stream = self.spark.readStream.schema(MESSAGE).option("maxFilesPerTrigger", files_at_once).parquet(self.path)
        return stream.where(F.col("topic").isin(wanted))


class _Range(InputPartition):
    def __init__(self, start: int, end: int) -> None:
        self.start, self.end = start, end


class _Ticks(DataSourceStreamReader):
    """Numbered messages of one topic, ``batch`` more at each look, up to ``total``."""

    def __init__(self, options: dict) -> None:
        self.topic, self.batch, self.total = options.get("topic", "ticks"), int(options.get("batch", 100)), int(options.get("total", 1000))
        self.seen = 0

    def initialOffset(self) -> dict:  # noqa: N802
        return {"n": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        self.seen = min(self.seen + self.batch, self.total)
        return {"n": self.seen}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [_Range(start["n"], end["n"])]

    def read(self, partition: _Range):
        for i in range(partition.start, partition.end):
            yield self.topic, str(i).encode()


class LocalBusSource(DataSource):
    """``spark.readStream.format("local_bus")``: a deterministic in-process bus for tests and demonstrations."""

    @classmethod
    def name(cls) -> str:
        return "local_bus"

    def schema(self) -> str:
        return MESSAGE

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return _Ticks(self.options)


def register(spark: SparkSession) -> None:
    """Make ``local_bus`` known to the session. The class travels by value: the processes that plan a source don't get shipped code."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.dataSource.register(LocalBusSource)


#: Client library that each broker's sink needs.
CLIENTS = {"mqtt": "paho.mqtt.client", "nats": "nats", "websocket": "websockets", "pubnub": "pubnub"}


def client(kind: str):
    """The client library of a broker, or a clear error where it isn't installed."""
    try:
        return importlib.import_module(CLIENTS[kind])
    except ImportError as e:
        raise RuntimeError(f"the {kind} transport needs the Python package of {CLIENTS[kind]}") from e


def send_each(messages: DataFrame, connect, checkpoint: str):
    """Publish a stream through any client: ``connect()`` gives, on an executor, a function of (topic, payload); delivery is at least once."""

    def batch(df: DataFrame, _: int) -> None:
        def run(rows):
            send = connect()
            for r in rows:
                send(r["topic"], bytes(r["payload"]))

        df.foreachPartition(run)

    return messages.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
