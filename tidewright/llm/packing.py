"""Best-fit packing of token sequences after Martello-Toth dominance reduction.

Piece lengths are whole numbers from 1 to the capacity, so any corpus is, for
the packer, a histogram of at most ``capacity`` counts. The driver plans on that
histogram alone: its cost doesn't grow with the corpus. The plan says, for each
length and each range of ranks among pieces of that length, which sequences and
offsets they take; executors look their pieces' places up in it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewright.llm.common import load, sliced, stored

CAPACITY = 2048
#: Entries of each worker's cache from chunk to token ids; emptied when full.
CACHE_ENTRIES = 600_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, local long"


# ---- planning on the histogram -------------------------------------------------


def reduce_by_dominance(counts: np.ndarray) -> list[tuple[list[tuple[int, int]], int]]:
    """Martello-Toth reduction: take from ``counts`` (by length; changed in place) the sets that are part of some optimal packing.

    For a length j among those left, with the sets that can share its bin:
    - none fits beside it: {j} alone;
    - a partner fills the bin exactly, or no two others fit beside j: {j, largest partner that fits};
    - at most two others fit: {j, p} if the largest partner p is at least the best pair's sum; else {j, p, q}
      with q the largest beside both, if no other feasible pair has both members over q.
    Each such set dominates every other set that holds j. Returns (pattern, copies),
    a pattern being a list of (length, times).
    """
    capacity = len(counts) - 1
    fixed: list[tuple[list[tuple[int, int]], int]] = []

    def largest(limit: int, spare: dict[int, int]) -> int:
        """The largest length up to ``limit`` of which a piece beyond ``spare`` is left, or 0."""
        left = np.flatnonzero(counts[1 : max(limit, 0) + 1]) + 1
        for x in left[::-1]:
            if counts[x] > spare.get(int(x), 0):
                return int(x)
        return 0

    def smallest(n: int, spare: dict[int, int], over: int = 0) -> list[int]:
        out: list[int] = []
        for x in np.flatnonzero(counts[over + 1 :]) + over + 1:
            out += [int(x)] * min(n - len(out), int(counts[x]) - spare.get(int(x), 0))
            if len(out) >= n:
                break
        return out

    def take(items: list[int]) -> None:
        need = {x: items.count(x) for x in items}
        copies = min(int(counts[x]) // n for x, n in need.items())
        for x, n in need.items():
            counts[x] -= n * copies
        fixed.append((sorted(need.items(), reverse=True), copies))

    changed = True
    while changed:
        changed = False
        for j in range(capacity, 0, -1):
            while counts[j]:
                own = {j: 1}
                room = capacity - j
                p = largest(room, own)
                if not p:
                    take([j])
                elif p == room or sum(smallest(2, own)) > room or len(smallest(2, own)) < 2:
                    take([j, p])
                else:
                    three = smallest(3, own)
                    if len(three) == 3 and sum(three) <= room:
                        break
                    # at most two fit beside j
                    present = [int(x) for x in np.flatnonzero(counts[1 : room + 1]) + 1]
                    best = max((a + b for a in present if (b := largest(min(a, room - a), {j: 1, a: 1} if a != j else {j: 2}))), default=0)
                    if p >= best:
                        take([j, p])
                    else:
                        q = largest(room - p, {j: 1, p: 1} if p != j else {j: 2})
                        over = smallest(2, own, over=q)
                        if not q or len(over) == 2 and sum(over) <= room:
                            break
                        take([j, p, q])
                changed = True
    return fixed


def best_fit(counts: np.ndarray) -> list[tuple[list[tuple[int, int]], int]]:
    """Best-fit decreasing on a histogram: bins alike are handled together.

    The tightest bins that a length fits get as many of it as they hold before
    any looser one does, as when pieces come one by one.
    """
    capacity = len(counts) - 1
    bins: dict[int, list[tuple[list[tuple[int, int]], int]]] = {capacity: []}
    for size in range(capacity, 0, -1):
        n = int(counts[size])
        while n:
            room = min((r for r, b in bins.items() if r >= size and b), default=0)
            pattern, copies = bins[room].pop() if room else ([], n)
            room = room or capacity
            times = min(room // size, n)
            used = min(copies, n // times)
            if copies > used and pattern:
                bins[room].append((pattern, copies - used))
            bins.setdefault(room - times * size, []).append(([*pattern, (size, times)], used))
            n -= used * times
    return [b for group in bins.values() for b in group]


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> dict[str, np.ndarray]:
    """Where the pieces of each length go: arrays of length, lo, hi (ranks), sequence, width and offset.

    The piece of rank r, lo <= r < hi, goes to sequence + (r - lo) % width at
    offset + (r - lo) // width * length.
    """
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        counts[length] = n
    packed = reduce_by_dominance(counts)
    packed += best_fit(counts)
    given = np.zeros(capacity + 1, np.int64)
    rows, sequence = [], 0
    for pattern, copies in packed:
        offset = 0
        for size, times in pattern:
            rows.append((size, given[size], given[size] + times * copies, sequence, copies, offset))
            given[size] += times * copies
            offset += size * times
        sequence += copies
    table = np.array(sorted(rows), np.int64).reshape(-1, 6)
    return dict(zip(("length", "lo", "hi", "sequence", "width", "offset"), table.T, strict=True))


# ---- tokens --------------------------------------------------------------------


#: The tokenizer's words within a chunk, a fixed value of the vocabulary.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class Encoder:
    """Token ids of texts, through caches of white-space separated chunks and of the words in them.

    The tokenizer drops white space and its words never span it, so a text's ids
    are those of its chunks in order; those of a chunk are those of its words.
    Chunks beyond Latin letters go to the tokenizer whole, and so do texts where
    Python's white space is not the tokenizer's or that hold a special token's string.
    """

    def __init__(self, path: str) -> None:
        import regex
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        # the same merges for words that are normal and cut already
        self.bare = Tokenizer.from_file(path)
        self.bare.normalizer = normalizers.Sequence([])
        self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.chunks: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.split = regex.compile(WORDS).findall
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.mark = "\x01"
        self.mark_id = self._whole([self.mark])[0]

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _each(self, parts: list[str], tokenizer) -> list[bytes]:
        """Ids of many short strings: some hundreds at a time as one text, with a marking word between."""
        if len(self.mark_id) != 4 or any(self.mark in p for p in parts):
            return self._whole(parts)
        mark = int(np.frombuffer(self.mark_id, "<u4")[0])
        out: list[bytes] = []
        for e in tokenizer.encode_batch_fast([f" {self.mark} ".join(parts[i : i + 256]) for i in range(0, len(parts), 256)], add_special_tokens=False):
            ids = np.array(e.ids, "<u4")
            data, at = ids.tobytes(), 0
            for cut in (4 * np.flatnonzero(ids == mark)).tolist():
                out.append(data[at:cut])
                at = cut + 4
            out.append(data[at:])
        return out

    def _learn(self, new: set[str]) -> None:
        words, plain, other = self.words, [], []
        for c in new:
            (plain if c.isascii() or max(c) < "\u0250" else other).append(c)
        split = [[w] if (w := c.lower()).isalpha() else self.split(w) for c in plain]
        unknown = list({w for ws in split for w in ws if w not in words})
        words.update(zip(unknown, self._each(unknown, self.bare), strict=True))
        self.chunks.update((c, b"".join([words[w] for w in ws])) for c, ws in zip(plain, split, strict=True))
        self.chunks.update(zip(other, self._each(other, self.tokenizer), strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        chunks, out = self.chunks, []
        odd = [any(c in t for c in "\x1c\x1d\x1e\x1f") or any(s in t for s in self.special) for t in texts]
        split = [[] if o else t.split() for t, o in zip(texts, odd, strict=True)]
        every = set().union(*split)
        new = every.difference(chunks)
        if len(chunks) + len(new) > CACHE_ENTRIES:  # the caches are emptied, so what they hold of these texts is learned again
            chunks.clear()
            self.words.clear()
            new = every
        self._learn(new)
        for t, o, ws in zip(texts, odd, split, strict=True):
            out.append(self._whole([t])[0] if o else b"".join(map(chunks.__getitem__, ws)))
        return out


_encoders: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """Token pieces of documents: PIECES, with the rank among the task's pieces of that length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import gc
        import os

        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder, task, ranks = _encoder(tokenizer_path), TaskContext.get().partitionId(), {}
        schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("task", pa.int32()), ("local", pa.int64())])
        step = 4 * capacity
        gc.disable()  # millions of strings and no cycles
        try:
            for batch in (b for whole in batches for b in sliced(whole, "text")):
                rows = []
                for doc, ids in zip(batch.column(0).to_pylist(), encoder.encode([t or "" for t in batch.column(1).to_pylist()]), strict=True):
                    ids += b"\0\0\0\0"
                    for k, at in enumerate(range(0, len(ids), step)):
                        part = ids[at : at + step]
                        n = len(part) // 4
                        rank = ranks.get(n, 0)
                        ranks[n] = rank + 1
                        rows.append((doc, k, at // 4, n, zlib.crc32(part), task, rank))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
        finally:
            gc.enable()

    return docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(run, PIECES)


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """Pack all documents (doc_id, text; further columns are ignored) into sequences of at most ``capacity`` tokens.

    A document's tokens are its text's ids and an end id 0; null and empty texts
    have the end id alone. Only longer documents are cut, into ``capacity``-token
    pieces. Repeated rows and null doc_ids are packed like any others. No rows
    give no rows. Returns doc_id, piece, start, length, ids_crc32, sequence_id,
    offset: one row a piece.

    What passes between tasks is a row of numbers a piece, never texts or ids.
    """
    spark = docs.sparkSession
    parts = stored(pieces(docs, tokenizer_path, capacity), "pieces")
    counts = stored(parts.groupBy("length", "task").agg(F.count("*").alias("n")), "piece-counts")
    before = F.sum("n").over(W.partitionBy("length").orderBy("task").rowsBetween(W.unboundedPreceding, -1))
    first = counts.select("length", "task", F.coalesce(before, F.lit(0)).alias("first"))
    # at most ``capacity`` rows, whatever the corpus
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    if not histogram:
        return spark.createDataFrame([], "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    at = spark.sparkContext.broadcast(plan(histogram, capacity))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = at.value
        span = int(p["hi"].max()) + 1
        keys = p["length"] * span + p["lo"]
        for b in batches:
            length, rank = (b.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            k = np.searchsorted(keys, length * span + rank, "right") - 1
            r = rank - p["lo"][k]
            sequence, offset = p["sequence"][k] + r % p["width"][k], p["offset"][k] + r // p["width"][k] * length
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    # the table of first ranks has a row for each length of each task: it grows with the corpus, so it is never broadcast
    ranked = parts.join(first.hint("merge"), ["length", "task"]).withColumn("rank", F.col("first") + F.col("local")).drop("first", "local", "task")
    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each piece of every row of documents: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    import public_tokenizers

    return pack(load(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))
