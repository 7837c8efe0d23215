"""Quality classifier: supervised subword embeddings.

Words and character n-grams are hashed to learned vectors, a document is the
mean of its vectors, and a softmax layer gives the classes; all is trained by
stochastic gradient descent in numpy. Once trained, a document's logit is the
mean of one number a feature, so whole texts of any length are scored in one
pass over their features.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm.common import SpanHasher, held_out, load, mixed, sample_below, sliced, utf8
from tidewright.llm.neardup import word_spans

BITS = 18
DIM = 12
GRAMS = (3, 4)
#: The feature of a word that follows itself.
TWICE = 7
#: At most about so many labelled documents are fitted on.
FIT_DOCS = 4000
EPOCHS, RATE = 8, 0.5
THRESHOLD = 0.3


def features(column: pa.Array, hasher: SpanHasher) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Hashed features of texts, one array for words and one for each n-gram length, and how many of each a text has.

    Every word gives itself and the pair with the next; every byte gives the byte
    n-grams that start there and stay in the text. Case and marks are kept: they
    tell good from bad.
    """
    data, offsets = utf8(column)
    hasher.load(data)
    starts, ends, first = word_spans(data, offsets)
    shift = np.uint64(64 - BITS)
    whole = hasher.spans(starts, ends)
    words = (whole >> shift).astype(np.int32)
    n = len(data)
    codes = data.astype(np.uint32)
    # pairs of neighbouring words; a word twice is one pair, whatever the word
    pairs = (mixed(whole[:-1] * np.uint64(3) + whole[1:]) >> shift).astype(np.int32)
    pairs[whole[:-1] == whole[1:]] = TWICE
    within = np.ones(len(pairs), bool)
    within[first[1:-1][(first[1:-1] > 0) & (first[1:-1] < len(words))] - 1] = False
    parts, sizes = [words, pairs[within]], [np.diff(first), np.maximum(np.diff(first) - 1, 0)]
    for g in GRAMS:
        m = max(n - g + 1, 0)
        h = np.full(m, g, np.uint32)
        for j in range(g):
            h = (h ^ codes[j : m + j]) * np.uint32(2654435761)
            h ^= h >> np.uint32(15)
        inside = np.maximum(np.diff(offsets) - g + 1, 0)
        at = np.arange(m)
        text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:m]
        keep = at + g <= offsets[1:][text]
        parts.append((h[keep] >> np.uint32(32 - BITS)).astype(np.int32))
        sizes.append(inside)
    return parts, sizes


def _per_text(column: pa.Array, hasher: SpanHasher):
    parts, sizes = features(column, hasher)
    ends = [np.concatenate(([0], np.cumsum(s))) for s in sizes]
    for i in range(len(sizes[0])):
        yield np.concatenate([p[e[i] : e[i + 1]] for p, e in zip(parts, ends, strict=True)])


def fit(texts: list[str], labels: list[int]) -> dict:
    """Learn vectors and the softmax layer; returns for each feature the number that it adds to the logit of class 1."""
    hasher = SpanHasher()
    rows = []
    for text, label in zip(texts, labels, strict=True):
        ids, counts = np.unique(next(_per_text(pa.array([text]), hasher)), return_counts=True)
        rows.append((ids, (counts / max(1, counts.sum())).astype(np.float32), int(label)))
    rng = np.random.default_rng(11)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (1 << BITS, DIM)).astype(np.float32)
    out, bias = np.zeros((DIM, 2), np.float32), np.zeros(2, np.float32)
    steps, total = 0, EPOCHS * len(rows)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(rows)):
            ids, share, y = rows[i]
            rate = np.float32(RATE * (1 - steps / total))
            steps += 1
            own = vectors[ids]
            hidden = share @ own
            logits = hidden @ out + bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[y] -= 1
            back = out @ p
            out -= rate * np.outer(hidden, p)
            bias -= rate * p
            # a feature's gradient is its share of the text; lengthening by the mean share keeps long texts learning
            vectors[ids] = own - (rate / max(float(share @ share), 1e-3) ** 0.5) * share[:, None] * back
    return {"numbers": (vectors @ (out[:, 1] - out[:, 0])).astype(np.float32), "bias": float(bias[1] - bias[0])}


def train(docs: DataFrame, labels: DataFrame, target: str, fit_docs: int = FIT_DOCS) -> dict | None:
    """Learn ``target`` (0 or 1) of ``labels`` (doc_id, target) from ``docs`` (doc_id, text).

    Null labels and ids are left out; of several labels of a document the
    largest counts. About ``fit_docs`` labelled documents, chosen by a hash of
    doc_id, are fitted on, in one executor task; of rows that repeat a doc_id the
    least text, a null one being empty. Texts are read whole. None if there are none.
    """
    known = labels.where(F.col(target).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(target).cast("int").alias("y"))
    n = known.count()
    chosen = known.where(sample_below("doc_id", fit_docs / n)) if n > fit_docs else known
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen) if n else chosen, "doc_id")  # about fit_docs rows of two numbers
    rows = rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = sorted(r for b in batches for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True))
        if got:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit([r[1] for r in got], [r[2] for r in got]))], pa.binary())], ["model"])

    models = rows.repartition(1).mapInArrow(run, "model binary").collect()
    return pickle.loads(models[0]["model"]) if models else None


def score(docs: DataFrame, model: dict | None) -> DataFrame:
    """doc_id and score (0 to 1) of every document (doc_id, text; further columns are ignored).

    Null and empty texts get the bias alone, and 0.5 stands where nothing was learned. A text of any length is
    read whole. Every row is scored by itself, so repeated rows and rows without doc_id come back as often, and
    equal texts score the same. No rows give no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model or {"numbers": np.zeros(1 << BITS, np.float32), "bias": 0.0})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, hasher = shared.value, SpanHasher()
        for whole in batches:
            for batch in sliced(whole, "text"):
                parts, sizes = features(batch.column(1), hasher)
                total = np.zeros(batch.num_rows)
                for ids, size in zip(parts, sizes, strict=True):
                    sums = np.concatenate(([0.0], np.cumsum(m["numbers"][ids], dtype=np.float64)))
                    ends = np.concatenate(([0], np.cumsum(size)))
                    total += sums[ends[1:]] - sums[ends[:-1]]
                logit = total / np.maximum(sum(sizes), 1) + m["bias"]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-logit)))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")


def op6_quality_subword_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of documents, learned from labels of rows not held out."""
    docs = load(spark, sf_dir, "documents", "doc_id", "text")
    model = train(docs, load(spark, sf_dir, "labels", "doc_id", "quality").where(~held_out("doc_id", 5, 0)), "quality")
    return score(docs, model).select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
