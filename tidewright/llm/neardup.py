"""Near duplicates by one-permutation MinHash with optimal densification.

One pass over the texts gives, for every document, the size and a 128-bit
fingerprint of its shingle set and its band keys. Documents with equal sets are
one class, and only each class's representative goes on. The buckets of the
first few bands are compared along stars, so candidate edges are as many as
bucket rows; what they join needs no comparing in the other bands. A star's
centre may be like none of two members that are like each other; so in every
bucket whose members are still in several components, all pairs of different
components are compared, in blocks. All comparing is on the full sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm.common import SpanHasher, dropped, load, mixed, sliced, stored, utf8

BINS = 128
ROWS = 4
BANDS = BINS // ROWS
#: Bands compared first; what they link needs no comparing in the others.
FIRST_BANDS = 6
#: Most members beside the centre in one confirming group, about.
GROUP = 64
#: Most members of one block where all pairs are compared, about; a task has two blocks.
BLOCK = 256
#: Shingles that a group or block has, about, if its texts are long.
SHINGLES = 1 << 18

_rng = np.random.default_rng(20240607)
#: Where an empty bin looks for a value: for each bin a permutation of all bins.
PROBES = np.argsort(_rng.random((BINS, BINS)), axis=1)
_MULT = np.uint64(0xD6E8FEB86659FD93)


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words [^\\x20\\x09-\\x0D]+, and the first word of each text, then their number."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = (data != 32) & ((data < 9) | (data > 13))
    begins = inside[1:-1] & ~inside[:-2]
    cuts = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(data))]
    begins[cuts] = inside[cuts + 1]
    starts = np.flatnonzero(begins)
    ending = inside[1:-1] & ~inside[2:]
    ending[cuts - 1] = inside[cuts]
    return starts, np.flatnonzero(ending) + 1, np.searchsorted(starts, offsets)


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


def shingle_sets(column: pa.Array, k: int, hasher: SpanHasher) -> list[np.ndarray]:
    """For each text its sorted distinct shingles of k words, as 64-bit hashes; fewer words are one shingle."""
    data, offsets = utf8(column)
    data = lower_ascii(data)
    hasher.load(data)
    starts, ends, first = word_spans(data, offsets)
    words = hasher.spans(starts, ends)
    n = max(len(words) - k + 1, 0)
    rolled = np.zeros(n, np.uint64)
    for j in range(k):
        rolled = rolled * _MULT + words[j : j + n]
    rolled = mixed(rolled)
    out = []
    for i in range(len(offsets) - 1):
        a, b = first[i], first[i + 1]
        if b - a >= k:
            h = np.sort(rolled[a : b - k + 1])
            out.append(h[np.concatenate(([True], h[1:] != h[:-1]))])
        elif b > a:
            x = np.uint64(0)
            with np.errstate(over="ignore"):
                for w in words[a:b]:
                    x = x * _MULT + w
                x = x ^ np.uint64(b - a)
            out.append(mixed(np.array([x], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def one_permutation(shingles: np.ndarray) -> np.ndarray:
    """The least shingle of each bin; an empty bin takes that of the first filled bin along its own probe order."""
    bins = (shingles >> np.uint64(57)).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], bins[1:] != bins[:-1])))
    signature, filled = np.zeros(BINS, np.uint64), np.zeros(BINS, bool)
    signature[bins[first]] = shingles[first]
    filled[bins[first]] = True
    if len(first) < BINS:
        empty = np.flatnonzero(~filled)
        probes = PROBES[empty]
        signature[empty] = signature[probes[np.arange(len(empty)), filled[probes].argmax(axis=1)]]
    return signature


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """Keys of all bands, of an array of signatures; equal keys of different bands are as unlikely as any collision."""
    parts = signatures.reshape(-1, BANDS, ROWS)
    keys = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), parts.shape[:2])
    for j in range(ROWS):
        keys = mixed(keys * _MULT + parts[:, :, j])
    return keys


def sketches(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n (set size), f1 and f2 (fingerprint), bands (array of keys; empty for an empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = SpanHasher()
        for whole in batches:
            for batch in sliced(whole, "text"):
                sets = shingle_sets(batch.column(1), k, hasher)
                n = np.array([len(s) for s in sets], np.int64)
                f1 = np.array([s.sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
                f2 = np.array([mixed(s + np.uint64(1)).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
                some = np.flatnonzero(n)
                keys = band_keys(np.array([one_permutation(sets[i]) for i in some], np.uint64).reshape(-1, BINS)).view(np.int64)
                at = np.concatenate(([0], np.cumsum(np.where(n > 0, BANDS, 0)))).astype(np.int32)
                bands = pa.ListArray.from_arrays(pa.array(at), pa.array(keys.reshape(-1)))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(f1), pa.array(f2), bands], ["doc_id", "n", "f1", "f2", "bands"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n long, f1 long, f2 long, bands array<long>")


def confirmed(edges: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The edges (a, b) whose sets have 100 * intersection >= percent * union; ``n`` is the size of b's set.

    Edges of one centre ``a`` go in groups of about GROUP others or SHINGLES
    shingles, each with the centre's text, so a hot centre is spread over many
    tasks and each text travels about once for each centre that it stands against.
    """
    # a table by itself, so that Spark can split a hot centre's side of the join
    sizes = stored(edges.groupBy("a").agg(F.ceil(F.greatest(F.count("*") / GROUP, F.sum("n") / SHINGLES)).alias("m")), "sizes", 2)
    dealt = edges.join(sizes, "a").select("a", "b", F.pmod(F.xxhash64("b", "a"), F.col("m")).cast("int").alias("part"))
    seats = dealt.select(F.col("b").alias("doc_id"), "a", "part").unionByName(dealt.select(F.col("a").alias("doc_id"), "a", "part").distinct())
    rows = seats.join(texts, "doc_id")

    def check(pdf: pd.DataFrame) -> pd.DataFrame:
        hasher = SpanHasher()
        out = []
        centre = int(pdf["a"].iloc[0])
        own = pdf["doc_id"].to_numpy() == centre
        base = shingle_sets(pa.array(pdf.loc[own, "text"].iloc[:1], pa.string()), k, hasher)[0]
        batch = pa.RecordBatch.from_arrays([pa.array(pdf.loc[~own, "doc_id"]), pa.array(pdf.loc[~own, "text"], pa.string())], ["doc_id", "text"])
        for part in sliced(batch, "text"):
            for doc, other in zip(part.column(0).to_pylist(), shingle_sets(part.column(1), k, hasher), strict=True):
                if 100 * min(len(base), len(other)) >= percent * max(len(base), len(other)):
                    both = np.concatenate((base, other))
                    both.sort()
                    shared = int((both[1:] == both[:-1]).sum())
                    if 100 * shared >= percent * (len(both) - shared):
                        out.append(doc)
        return pd.DataFrame({"a": np.full(len(out), centre, np.int64), "b": np.array(out, np.int64)})

    return rows.groupBy("a", "part").applyInPandas(check, "a long, b long")


def links_within(sets: list[np.ndarray], c: list[int], percent: int) -> list[tuple[int, int]]:
    """Pairs of positions that link the parts ``c`` of some sets as far as any similar pair of two parts does; no more than a forest."""
    sizes = np.array([len(x) for x in sets], np.int64)
    _, at = np.unique(np.concatenate(sets), return_inverse=True)
    begins = np.concatenate(([0], np.cumsum(sizes)))
    marks = np.zeros(int(at.max()) + 1, bool)
    _, part = np.unique(np.array(c, np.int64), return_inverse=True)
    rest = np.bincount(part).argmax()
    out = []
    # pairs within the largest part need no comparing, so each pair has one end outside
    for i in np.flatnonzero(part != rest).tolist():
        own = at[begins[i] : begins[i + 1]]
        marks[own] = True
        shared = np.add.reduceat(marks[at], begins[:-1], dtype=np.int64)
        marks[own] = False
        for j in np.flatnonzero((100 * shared >= percent * (sizes + sizes[i] - shared)) & (part != part[i])).tolist():
            if part[j] != part[i]:
                out.append((i, j))
                part[part == part[j]] = part[i]
    return out


def links_in_buckets(left: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Edges (a, b) that join the parts ``c`` of each bucket (key, doc_id, n, c) as far as its similar pairs do.

    A bucket's largest part needs comparing with the others alone. Both are dealt
    in blocks of about BLOCK members or SHINGLES shingles, and a task has two
    blocks, so no bucket is a single task. Buckets of the same members are one.
    """
    same = [F.bit_xor(F.xxhash64("doc_id")).alias("x1"), F.bit_xor(F.xxhash64(F.lit(1), F.col("doc_id"))).alias("x2")]
    parts = left.groupBy("key", "c").agg(F.count("*").alias("m"), F.sum("n").alias("n"), *same)
    buckets = parts.groupBy("key").agg(F.count("*").alias("parts"), F.sum("m").alias("m"), F.sum("n").alias("n"), F.bit_xor("x1").alias("x1"), F.bit_xor("x2").alias("x2"), F.min(F.struct((-F.col("m")).alias("l"), "c", F.col("n").alias("n"))).alias("most"))
    buckets = buckets.where("parts > 1").dropDuplicates(["m", "x1", "x2"])
    blocks = lambda m, n: F.ceil(F.greatest(m / BLOCK, n / SHINGLES)).cast("int")
    few, many = blocks(F.col("m") + F.col("most.l"), F.col("n") - F.col("most.n")), blocks(-F.col("most.l"), F.col("most.n"))
    one = (F.col("m") <= BLOCK) & (F.col("n") <= SHINGLES)
    buckets = stored(buckets.select("key", F.col("most.c").alias("large"), F.when(one, 1).otherwise(few).alias("few"), F.when(one, 0).otherwise(many).alias("many")), "unsettled", 2)
    outside = (F.col("many") == 0) | (F.col("c") != F.col("large"))
    dealt = F.when(outside, F.pmod(F.xxhash64("doc_id", "key"), F.col("few"))).otherwise(F.col("few") + F.pmod(F.xxhash64("doc_id", "key"), F.greatest("many", F.lit(1)))).cast("int")
    members = left.join(buckets, "key").select("key", "doc_id", "c", "few", "many", dealt.alias("block"))
    others = F.when(F.col("block") < F.col("few"), F.col("few") + F.col("many")).otherwise(F.col("few"))
    seats = members.select("key", "doc_id", "c", "block", F.explode(F.sequence(F.lit(0), others - 1)).alias("other"))
    rows = seats.select("key", "doc_id", "c", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")).join(texts, "doc_id")

    def check(pdf: pd.DataFrame) -> pd.DataFrame:
        hasher, sets = SpanHasher(), []
        batch = pa.RecordBatch.from_arrays([pa.array(pdf["text"], pa.string())], ["text"])
        for part in sliced(batch, "text"):
            sets += shingle_sets(part.column(0), k, hasher)
        docs = pdf["doc_id"].to_numpy()
        pairs = np.array(links_within(sets, pdf["c"].tolist(), percent), np.int64).reshape(-1, 2)
        return pd.DataFrame({"a": docs[pairs[:, 0]], "b": docs[pairs[:, 1]]})

    return rows.groupBy("key", "i", "j").applyInPandas(check, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """doc_id and the least id reachable, for every end of ``edges`` (a, b): alternating large-star and small-star."""
    now = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "edges", 4)
    before = None
    while True:
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        old, now = now, stored(small, "edges", 4)
        dropped(old)
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before:
            return now.select(F.col("u").alias("doc_id"), F.col("v").alias("component_id"))
        before = mark


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """Components of documents linked by Jaccard similarity of word shingles.

    ``docs`` has doc_id and text; further columns are ignored. Words are
    [^\\x20\\x09-\\x0D]+ after lower-casing A-Z; texts are read whole. Null, empty and blank texts have
    empty sets and are linked with nothing; a text of fewer than k words is one
    shingle. Rows that repeat a doc_id come back as often; rows without doc_id
    are not linked. No rows give no rows. Rows of one doc_id with different texts
    are each in the component of their own text; that of a doc_id's class
    counts one of them.

    Returns doc_id, n_shingles, component_id (least doc_id reachable, its own
    included; null for a null doc_id) and kept (doc_id = component_id).

    A link at the threshold shares a bucket but for a chance of (1 - 0.8^4)^32 < 1e-7.
    """
    spark = docs.sparkSession
    sketch = stored(sketches(docs, k), "sketches")
    keyed = sketch.where("n > 0 and doc_id is not null")
    classes = stored(keyed.groupBy("n", "f1", "f2").agg(F.min("doc_id").alias("rep")), "classes", 8)
    reps = keyed.join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    rows = reps.select("doc_id", "n", F.posexplode("bands").alias("band", "key"))
    shared = rows.groupBy("key").agg(F.count("*").alias("m")).where("m > 1").drop("m")
    every = stored(rows.join(shared, "key", "left_semi").withColumn("c", F.col("doc_id")), "buckets")
    texts = stored(docs.select(F.col("doc_id").cast("long"), "text").join(every.select("doc_id").distinct(), "doc_id", "left_semi").dropDuplicates(["doc_id"]), "candidates")

    # the least ids are centres, which most buckets of a group share
    first = every.where(F.col("band") < FIRST_BANDS)
    most = stored(first.groupBy("key").agg(F.min(F.struct("doc_id", "n")).alias("s")).select("key", F.col("s.doc_id").alias("a"), F.col("s.n").alias("an")), "centres", 4)
    rest = stored(first.join(most, "key").where("doc_id != a").select("key", "doc_id", "n", "a", "an"), "stars", 8)
    edges = rest.where(f"100 * least(n, an) >= {percent} * greatest(n, an)").select("a", F.col("doc_id").alias("b"), "n").distinct()
    starred = stored(confirmed(edges, texts, k, percent), "links", 16)
    joined = components(starred)
    # a centre has met all others of its bucket and is done with there
    left = rest.select("key", "doc_id", "n").unionByName(every.where(F.col("band") >= FIRST_BANDS).select("key", "doc_id", "n"))
    left = left.join(joined, "doc_id", "left").select("key", "doc_id", "n", F.coalesce("component_id", "doc_id").alias("c"))
    several = stored(left.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo != hi").select("key"), "several", 4)
    left = stored(left.join(several, "key", "left_semi"), "buckets", 8)
    dropped(every)
    dropped(rest)
    within = stored(links_in_buckets(left, texts, k, percent), "links", 16)
    dropped(left)
    known, joined = joined, components(within.unionByName(joined.select(F.col("doc_id").alias("a"), F.col("component_id").alias("b"))))
    for gone in (starred, known, within):
        dropped(gone)
    dropped(texts)
    name = classes.join(joined, classes.rep == joined.doc_id, "left").select("n", "f1", "f2", F.coalesce("component_id", "rep").alias("component_id"))
    out = sketch.join(name, ["n", "f1", "f2"], "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), component)
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of documents: shingles of two words, links from 80 per cent on."""
    return near_duplicates(load(spark, sf_dir, "documents", "doc_id", "text"), k=2, percent=80)


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` without the documents whose component has a smaller doc_id; columns and other rows as they are.

    Rows without doc_id and rows that repeat a kept doc_id stay.
    """
    gone = near_duplicates(docs, k, percent).where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
