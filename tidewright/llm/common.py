"""Shared helpers: tables in the cluster's shared folder, text batches, hashing."""

from __future__ import annotations

import re
import sys
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text handled at once by vectorised code; bounds temporary arrays.
SLICE_BYTES = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that every node of the cluster sees: spark.checkpoint.dir.

    Where the session names none, a temporary folder is made and set for a
    session whose executors are the driver's own threads; on a cluster, where
    other machines wouldn't see it, that is an error.
    """
    place = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not place:
        master = spark.sparkContext.master
        if not re.match(r"local(\[|$)", master):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all nodes of {master} share")
        place = "file://" + tempfile.mkdtemp(prefix="tidewright-")
        spark.conf.set("spark.checkpoint.dir", place)
    return place.rstrip("/")


def stored(df: DataFrame, name: str, per_core: int = 0) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts lineage: a lost executor costs no recomputation of what is written.
    With ``per_core`` there are at most so many files for each core of the
    cluster, for tables of short rows that would else be very many small files.
    """
    spark = df.sparkSession
    if per_core:
        df = df.coalesce(per_core * spark.sparkContext.defaultParallelism)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame | None) -> None:
    """Delete the files behind a table made by ``stored``, once nothing reads it any more."""
    if df is None:
        return
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for parent in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(parent)
        path.getFileSystem(conf).delete(path, True)


def load(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    """A test or production table, with only the columns asked for."""
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return df.select(*columns) if columns else df


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column, nulls as empty texts, without copies per row."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("") if column.null_count else column
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(offsets):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def sliced(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES):
    """Cut a batch into runs of rows of about ``limit`` text bytes; a longer text stays whole, alone."""
    if not batch.num_rows:
        return
    _, offsets = utf8(batch.column(column))
    start, last = 0, batch.num_rows
    while start < last:
        end = int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1
        end = min(max(end, start + 1), last)
        yield batch.slice(start, end - start)
        start = end


_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def powers(base: np.uint64, n: int) -> np.ndarray:
    """1, base, base^2, ... modulo 2^64."""
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def release() -> None:
    """Drop what an operator of an earlier stage keeps in this worker process between its tasks."""
    packing = sys.modules.get("tidewright.llm.packing")
    if packing and packing._encoders:
        packing._encoders.clear()


class SpanHasher:
    """64-bit hashes of any spans of a buffer, from one running sum.

    sum(x[i] * B^i) over a span, times B^-start, depends on the span's content
    alone; a final mix spreads the bits.
    """

    def __init__(self) -> None:
        release()
        self.n = 0

    def _grow(self, n: int) -> None:
        if n > self.n:
            self.n = max(n, min(2 * self.n, SLICE_BYTES + 1), 1 << 12)
            self.up, self.down = powers(_BASE, self.n), powers(_INVERSE, self.n)

    def load(self, data: np.ndarray) -> None:
        self._grow(len(data) + 1)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.add(data, np.uint64(1), out=sums[1:], dtype=np.uint64)
        sums[1:] *= self.up[: len(data)]
        self.sums = np.cumsum(sums, out=sums)

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((self.sums[ends] - self.sums[starts]) * self.down[starts] + (ends - starts).astype(np.uint64))


def mixed(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def held_out(column: str, modulus: int, remainder: int):
    """crc32 of the id as text, modulo ``modulus``, is ``remainder``; a null id is held out."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % modulus == remainder, F.lit(True))


def sample_below(column: str, share: float):
    """A fixed pseudo-random share of the rows, by id."""
    return F.pmod(F.xxhash64(F.col(column)), F.lit(1 << 30)) < int(share * (1 << 30))
