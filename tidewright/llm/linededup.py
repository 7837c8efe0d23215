"""Removal of repeated line chunks with content-defined boundaries.

A rolling hash over the hashes of two lines says where the text is cut, so an
insertion moves no cut but those beside it. Chunks are the two lines of each cut
and the runs of lines from one cut to the next, both included: a passage shared
by texts goes from its first cut to its last. Chunks that stand more than once
in the corpus are compared byte by byte; all occurrences but the first go.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewright.llm.common import dropped, load, release, sliced, stored

#: So many pairs of lines out of so many are cuts: the more, the nearer a shared passage's ends its first and last cut.
CUTS, OUT_OF = 2, 3
#: A line of so many words is a paragraph, several lines of prose without line ends: a cut and a chunk of its own.
PARAGRAPH_WORDS = 50
_M = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def chunks(text: bytes, paragraph_words: int = PARAGRAPH_WORDS) -> list[tuple[int, int]]:
    """Offset and length of the chunks that may be removed: of two non-blank lines or more, or one paragraph. They may overlap.

    Lines end at \\n alone; blank ones only stand between others. A chunk's length leaves its last line's end out.
    """
    lines: list[tuple[int, int]] = []
    cuts: list[tuple[int, int]] = []
    at, before = 0, None
    for line in text.split(b"\n"):
        if line.strip():
            h = xxhash.xxh3_64_intdigest(line)
            if len(line) >= 2 * paragraph_words - 1 and len(line.split()) >= paragraph_words:
                cuts.append((len(lines), len(lines)))
                before = None
            else:
                if before is not None and (((before * _M + h) * _M & _MASK) >> 32) * OUT_OF >> 32 < CUTS:
                    cuts.append((len(lines) - 1, len(lines)))
                before = h
            lines.append((at, at + len(line)))
        at += len(line) + 1
    last = len(lines) - 1
    runs = set(cuts)
    if cuts:
        runs |= {(a, d) for (a, b), (c, d) in zip(cuts, cuts[1:], strict=False) if c - b > 1}
        runs |= {(0, cuts[0][1])} if cuts[0][0] else set()
        runs |= {(cuts[-1][0], last)} if cuts[-1][1] < last else set()
    elif last > 0:
        runs.add((0, last))
    return [(lines[a][0], lines[b][1] - lines[a][0]) for a, b in sorted(runs)]


def without(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the spans of lines, which may overlap, and one line end for each."""
    apart: list[tuple[int, int]] = []
    for off, n in sorted(spans):
        if apart and off <= sum(apart[-1]) + 1:
            apart[-1] = (apart[-1][0], max(sum(apart[-1]), off + n) - apart[-1][0])
        else:
            apart.append((off, n))
    out, at = [], 0
    for off, n in apart:
        out.append(text[at:off])
        at = min(off + n + 1, len(text))
        if off + n >= len(text) and (out[-1].endswith(b"\n") or not out[-1]):
            # nothing follows: the line end before goes instead
            k = len(out) - 1
            while k >= 0 and not out[k]:
                k -= 1
            if k >= 0:
                out[k] = out[k][:-1]
    out.append(text[at:])
    return b"".join(out)


def _digests(docs: DataFrame, paragraph_words: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        schema = pa.schema([(c, pa.int64()) for c in ("doc_id", "mark", "off", "len", "h1", "h2")])
        for batch in (b for whole in batches for b in sliced(whole, "text")):
            rows: tuple[list, ...] = ([], [], [], [], [], [])
            for doc, mark, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                for off, n in chunks(text or b"", paragraph_words):
                    h = xxhash.xxh3_128_intdigest(text[off : off + n])
                    for column, x in zip(rows, (doc, mark, off, n, (h >> 64) - (1 << 63), (h & _MASK) - (1 << 63)), strict=True):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(r, pa.int64()) for r in rows], schema=schema)

    some = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("mark"), F.col("text").cast("binary").alias("text"))
    return some.mapInArrow(run, "doc_id long, mark long, off long, len long, h1 long, h2 long")


def line_dedup(docs: DataFrame, paragraph_words: int = PARAGRAPH_WORDS) -> DataFrame:
    """``docs`` (doc_id, text and any other columns) with repeated chunks taken out of text, and the column removed_chunks.

    The occurrence of the smallest (doc_id, hash of the text, offset) stays. No
    row goes: a text of which nothing is left is empty. Null and empty texts stay
    as they are. Rows without doc_id pass unchanged. Rows of one doc_id with
    different texts are different texts; with the same text they are one, and
    lose the same. A digest that stands for different bytes is never removed.
    No rows give no rows. A column removed_chunks of the input is replaced.

    A text is read whole and split nowhere by its length: ``paragraph_words``
    says which lines are chunks by themselves, as a passage often is one line.

    Texts pass one shuffle, to meet their documents' spans; the comparison of
    bytes groups by the bytes themselves, so a chunk of a third of all documents
    leaves each task once.
    """
    docs = docs.drop("removed_chunks")
    extra, d, m = (f"{x}_{uuid.uuid4().hex}" for x in ("spans", "d", "m"))  # no column of the input has these names
    key = ["h1", "h2", "len"]
    found = stored(_digests(docs, paragraph_words), "chunks")
    place = F.struct("doc_id", "mark", "off")
    repeated = found.groupBy(*key).agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1")
    spots = found.join(repeated.drop("n"), key).select("doc_id", "mark", F.struct("off", *key, (place == F.col("first")).alias("stays")).alias("span"))

    def met(spots: DataFrame) -> DataFrame:
        spans = spots.groupBy(F.col("doc_id").alias(d), F.col("mark").alias(m)).agg(F.collect_set("span").alias(extra))
        return docs.join(spans, (F.col("doc_id") == F.col(d)) & (F.xxhash64("text") == F.col(m)), "left").select(*docs.columns, extra)

    marked = stored(met(spots), "marked")
    place = marked.where(F.col(extra).isNotNull()).select(F.col("text").cast("binary").alias("b"), F.explode(extra).alias("s"))
    pieces = place.select("s.h1", "s.h2", "s.len", F.substring("b", F.col("s.off").cast("int") + 1, F.col("s.len").cast("int")).alias("bytes"))
    variants = pieces.groupBy(*key, "bytes").agg(F.lit(1).alias("one"))
    wrong = stored(variants.groupBy(*key).agg(F.count("*").alias("v")).where("v > 1").drop("v"), "collisions", 2)
    if not wrong.isEmpty():  # a 128-bit digest of different bytes: its spans go before texts and spans meet
        wide = spots.select("doc_id", "mark", "span", *(F.col(f"span.{c}").alias(c) for c in key))
        old, marked = marked, stored(met(wide.join(wrong, key, "left_anti")), "marked")
        dropped(old)
    dropped(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in sliced(whole, "text"):
                texts, counts = batch.column("text").to_pylist(), []
                for i, spans in enumerate(batch.column(extra).to_pylist()):
                    go = [(s["off"], s["len"]) for s in spans or () if not s["stays"]]
                    counts.append(len(go))
                    if go:
                        texts[i] = without(texts[i].encode(), go).decode()
                columns = [pa.array(texts, pa.string()) if f.name == "text" else batch.column(f.name) for f in batch.schema if f.name != extra]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int64())], [*(f.name for f in batch.schema if f.name != extra), "removed_chunks"])

    return marked.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("removed_chunks", T.LongType())]))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text, n_bytes and removed_chunks of every row of documents, repeated chunks of lines taken out; a null text stays null."""
    docs = load(spark, sf_dir, "documents", "doc_id", "text")
    return line_dedup(docs).select("doc_id", "text", F.octet_length("text").cast("long").alias("n_bytes"), "removed_chunks")
