"""Benchmark decontamination by pigeonhole edit matching.

An item may stand in a text with up to k edits. Cut into k + 1 pieces, it then
has at least one piece there unchanged. One automaton finds all pieces of all
items in a single reading of each text; around each hit Myers' bit-parallel
algorithm measures the distance.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm.common import load, release

#: Edits allowed, as a share of the item's characters.
ERROR_SHARE = 0.05
#: Items that one automaton holds; more are matched block after block.
BLOCK_ITEMS = 20_000
MATCH = "doc_id long, item_id long, distance int, begin int, end int"


def normal(text: str) -> str:
    """Lower case, white space as single spaces."""
    return " ".join(text.lower().split())


def budget(item: str) -> int:
    """Edits that an item may have."""
    return int(len(item) * ERROR_SHARE)


def pieces(item: str) -> list[tuple[int, str]]:
    """The item cut into budget + 1 pieces as even as can be: (offset, piece)."""
    n = budget(item) + 1
    cuts = [len(item) * i // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def myers(pattern: str, text: str, limit: int) -> tuple[int, int] | None:
    """The least edit distance of ``pattern`` to any substring of ``text`` and its first end, if at most ``limit``."""
    m = len(pattern)
    peq: dict[str, int] = {}
    for i, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | 1 << i
    mask, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best = mask, 0, m, None
    for j, c in enumerate(text):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & mask
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = ph << 1 & mask
        mh = mh << 1 & mask
        pv = mh | ~(xv | ph) & mask
        mv = ph & xv
        if score <= limit:
            best, limit = (score, j + 1), score - 1
            if score == 0:
                break
    return best


def match_length(pattern: str, text: str, distance: int) -> int:
    """Length of the shortest suffix of ``text`` that has that distance to ``pattern``: both read backwards, from the end on."""
    m = len(pattern)
    peq: dict[str, int] = {}
    for i, c in enumerate(reversed(pattern)):
        peq[c] = peq.get(c, 0) | 1 << i
    mask, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = mask, 0, m
    if score == distance:
        return 0
    for j, c in enumerate(reversed(text), 1):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & mask
        mh = pv & xh
        score += bool(ph & top) - bool(mh & top)
        if score == distance:
            return j
        # a character of the text before the pattern's first costs one: the match begins at the end
        ph = (ph << 1 | 1) & mask
        mh = mh << 1 & mask
        pv = mh | ~(xv | ph) & mask
        mv = ph & xv
    raise ValueError("no such match")


def matches(text: str, automaton, items: list[tuple[int, str]]) -> list[tuple[int, int, int, int]]:
    """item_id, distance, begin and end (of the normalised text) of each item's best match in a normalised text."""
    starts: dict[int, set[int]] = {}
    for end, found in automaton.iter(text):
        for item, offset, n in found:
            starts.setdefault(item, set()).add(end + 1 - n - offset)
    out = []
    for item, at in starts.items():
        number, pattern = items[item]
        k, m = budget(pattern), len(pattern)
        exact = next((a for a in sorted(at) if a >= 0 and text.startswith(pattern, a)), None)
        if exact is not None:
            out.append((number, 0, exact, exact + m))
            continue
        best = None
        # hits near each other are looked at together
        runs: list[list[int]] = []
        for a in sorted(at):
            if runs and a - k <= runs[-1][1]:
                runs[-1][1] = a + m + k
            else:
                runs.append([a - k, a + m + k])
        for a, b in runs:
            a = max(a, 0)
            hit = myers(pattern, text[a:b], k if best is None else best[0] - 1)
            if hit:
                end = a + hit[1]
                best = (hit[0], end - match_length(pattern, text[max(a, end - m - hit[0]) : end], hit[0]), end)
        if best:
            out.append((number, *best))
    return out


def leaks(docs: DataFrame, benchmark: DataFrame, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """One row for each document (doc_id, text) and item (item_id, text) that stands in it within the item's budget.

    begin and end are of the normalised text: the first end of the least distance, and the latest begin for it.
    Texts of any length are searched whole. Null and empty texts match nothing; so do items that are empty after
    normalising. Rows that repeat a doc_id or item_id match each for itself and
    give one row for the pair: the least distance, then the first place. Rows
    without id are left out. Further columns are ignored.

    Items are the stated query set. They are taken in blocks of ``block_items``,
    so one automaton's size is bounded; documents are read once a block and
    never shuffled, only matches are.
    """
    spark = docs.sparkSession
    wanted = benchmark.where("item_id is not null and text is not null").select("item_id", "text")
    texts = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long"), "text")
    # blank items are left out before blocks are cut, so only the last block is short
    kept = ((r["item_id"], p) for r in wanted.toLocalIterator(prefetchPartitions=True) if (p := normal(r["text"])))
    found = None
    while (block := list(islice(kept, block_items))) or found is None:
        part = _block(texts, spark.sparkContext.broadcast(block))
        found = part if found is None else found.unionByName(part)
    best = F.min(F.struct("distance", "begin", "end")).alias("m")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "m.distance", "m.begin", "m.end")


def _block(texts: DataFrame, shared) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        release()
        items = shared.value
        if not items:
            return
        automaton = ahocorasick.Automaton()
        for number, (_, pattern) in enumerate(items):
            for offset, piece in pieces(pattern):
                automaton.get(piece, None) or automaton.add_word(piece, [])
                automaton.get(piece).append((number, offset, len(piece)))
        automaton.make_automaton()
        schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("distance", pa.int32()), ("begin", pa.int32()), ("end", pa.int32())])
        for batch in batches:
            rows: tuple[list, ...] = ([], [], [], [], [])
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for row in matches(normal(text), automaton, items):
                    for column, x in zip(rows, (doc, *row), strict=True):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(r, f.type) for r, f in zip(rows, schema, strict=True)], schema=schema)

    return texts.mapInArrow(run, MATCH)


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item; columns and other rows as they are.

    Rows without doc_id, null and empty texts stay. Of rows that repeat a doc_id all go if one holds an item.
    """
    gone = leaks(docs, benchmark).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def op8_pigeonhole_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, item_id, distance, begin and end of every item of benchmark that stands in a row of documents."""
    return leaks(load(spark, sf_dir, "documents", "doc_id", "text"), load(spark, sf_dir, "benchmark", "item_id", "text"))
