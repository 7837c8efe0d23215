"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Trained with follow-the-regularised-leader and elastic-net penalties, then
calibrated by one temperature on rows kept out of the fit.

Features are hashed n-grams of 1 to 3 lower-cased characters. A text's value of
an n-gram is its share of the text's n-grams times the inverse document
frequency. Scores are therefore sums over all n-grams of a text, whatever its
length, and texts are scored whole.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm.common import held_out, load, sample_below, sliced

BITS = 16
ORDERS = 3
#: At most about so many documents are fitted on; document frequencies are taken from all that may be learned from.
FIT_DOCS = 4000
#: TF-IDF values are small shares; this brings them to the scale that the step size is meant for.
SCALE = 30.0
ALPHA, BETA, L1, L2, EPOCHS = 0.5, 1.0, 0.02, 0.001, 3
MODEL = "model binary"


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of all texts, and where each text's begin (and the last end). A mark stands before, between and after."""
    texts = [t.lower() for t in texts]
    joined = "\n".join(["", *texts, ""])
    codes = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
    codes = np.where((codes >= 48) & (codes < 58), np.uint32(48), codes)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    begin = np.concatenate(([0], np.cumsum(lengths + 1)))
    m1, m2, m3 = np.uint32(2654435761), np.uint32(2246822519), np.uint32(3266489917)
    one = (codes * m1) ^ (codes >> np.uint32(7))
    two = one[:-1] * m2 + codes[1:] * m3
    two = two ^ (two >> np.uint32(15))
    three = two[:-1] * m1 + codes[2:] * m2
    three = three ^ (three >> np.uint32(13))
    out = np.empty((len(codes) - 2, ORDERS), np.uint32)
    shift = np.uint32(32 - BITS)
    out[:, 0] = (one[:-2] * m3) >> shift
    out[:, 1] = (two[:-1] * m2) >> shift
    out[:, 2] = (three * m3) >> shift
    return out.reshape(-1), begin * ORDERS


def _per_text(texts: list[str]):
    ids, begin = grams(texts)
    for a, b in zip(begin[:-1], begin[1:], strict=True):
        yield ids[a:b]


def document_frequencies(docs: DataFrame) -> tuple[int, np.ndarray]:
    """Number of documents and, for each feature, of those that have it: partial sums by task, then one vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n, flags = np.zeros(1 << BITS, np.int64), 0, np.zeros(1 << BITS, bool)
        for whole in batches:
            for batch in sliced(whole, "text"):
                for ids in _per_text(batch.column(0).to_pylist()):
                    flags[ids] = True
                    total += flags
                    flags[:] = False
                    n += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(total[at], n))], ["feature", "n"])

    found = docs.select("text").mapInArrow(run, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(1 << BITS, np.int64)
    some = found["feature"].to_numpy() >= 0
    df[found["feature"].to_numpy()[some]] = found["n"].to_numpy()[some]
    return int(found["n"].to_numpy()[~some].sum()), df


def fit(texts: list[str], labels: list[str], idf: np.ndarray) -> dict:
    """The model: classes, bias, weights (features x classes, with idf and scale in them) and temperature."""
    classes = sorted(set(labels))
    c = len(classes)
    index = {x: i for i, x in enumerate(classes)}
    rows = []
    for text, label in zip(texts, labels, strict=True):
        ids, counts = np.unique(next(_per_text([text])), return_counts=True)
        rows.append((ids, (SCALE * counts / max(1, counts.sum())) * idf[ids], index[label]))
    z, n = np.zeros((1 << BITS, c)), np.zeros((1 << BITS, c))
    zb, nb = np.zeros(c), np.zeros(c)

    def weights(z, n):
        w = -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2)
        return np.where(np.abs(z) <= L1, 0.0, w)

    rng = np.random.default_rng(7)
    order = rng.permutation(len(rows))
    apart = order[: len(rows) // 8] if len(rows) >= 40 else order
    used = order[len(rows) // 8 :] if len(rows) >= 40 else order
    for _ in range(EPOCHS):
        for i in rng.permutation(used):
            ids, x, y = rows[i]
            w, b = weights(z[ids], n[ids]), weights(zb, nb)
            p = _softmax(x @ w + b)
            p[y] -= 1
            g = x[:, None] * p
            s = (np.sqrt(n[ids] + g * g) - np.sqrt(n[ids])) / ALPHA
            z[ids] += g - s * w
            n[ids] += g * g
            s = (np.sqrt(nb + p * p) - np.sqrt(nb)) / ALPHA
            zb += p - s * b
            nb += p * p
    w, b = weights(z, n), weights(zb, nb)
    logits = np.array([x @ w[ids] + b for ids, x, _ in rows])[apart]
    truth = np.array([y for _, _, y in rows])[apart]

    def loss(t: float) -> float:
        p = np.array([_softmax(v / t) for v in logits])
        return float(-np.log(np.maximum(p[np.arange(len(truth)), truth], 1e-12)).mean())

    temperature = min(np.geomspace(0.2, 5, 41), key=loss)
    return {"classes": classes, "bias": b, "weights": (w * idf[:, None] * SCALE).astype(np.float32), "temperature": float(temperature)}


def _softmax(v: np.ndarray) -> np.ndarray:
    e = np.exp(v - v.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(docs: DataFrame, fit_docs: int = FIT_DOCS) -> dict | None:
    """Learn from documents (doc_id, text, lang): rows with null or empty text or null lang are left out; None if no row is left.

    About ``fit_docs`` documents, chosen by a hash of doc_id, are fitted on, in one executor task. Of rows
    that repeat a doc_id the least (text, lang) is fitted on, so no doc_id fills that task; document
    frequencies count all of them. Rows without doc_id count in the frequencies alone. Texts are read whole.
    """
    known = docs.where("lang is not null and text is not null and text != ''").select("doc_id", "text", "lang")
    n, df = document_frequencies(known)
    if not n:
        return None
    idf = np.log((1 + n) / (1 + df)) + 1
    idf[df == 0] = 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(r for b in batches for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit([r[1] for r in rows], [r[2] for r in rows], idf))], pa.binary())], ["model"])

    some = known.where(F.col("doc_id").isNotNull())
    chosen = some.where(sample_below("doc_id", fit_docs / n)) if n > fit_docs else some
    once = chosen.groupBy("doc_id").agg(F.min(F.struct("text", "lang")).alias("r")).select("doc_id", "r.*")
    got = once.repartition(1).mapInArrow(run, MODEL).collect()
    return pickle.loads(got[0]["model"]) if got else None


def predict(docs: DataFrame, model: dict | None) -> DataFrame:
    """doc_id, lang_pred and score of every document (doc_id, text; further columns are ignored).

    ``und`` with score 0 if the text is null or has no letter, or if there is no model. Of languages that tie
    the first by name is taken. A text of any length is read whole. Every row is predicted by itself, so repeated
    rows and rows without doc_id come back as often, and equal texts get the same. No rows give no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for whole in batches:
            for batch in sliced(whole, "text"):
                texts = [t or "" for t in batch.column(1).to_pylist()]
                names, scores = ["und"] * len(texts), np.zeros(len(texts))
                lettered = [i for i, t in enumerate(texts) if m and any(map(str.isalpha, t))]
                if lettered:
                    ids, begin = grams([texts[i] for i in lettered])
                    sums = np.array([np.add.reduceat(m["weights"][:, k][ids], begin[:-1]) for k in range(len(m["classes"]))], float).T
                    p = _softmax((sums / np.diff(begin)[:, None] + m["bias"]) / m["temperature"])
                    best = p.argmax(axis=1)
                    for i, k, row in zip(lettered, best, p, strict=True):
                        names[i], scores[i] = m["classes"][k], row[k]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names), pa.array(scores)], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row of documents, learned from text and lang of rows not held out."""
    docs = load(spark, sf_dir, "documents", "doc_id", "text", "lang")
    model = train(docs.where(~held_out("doc_id", 5, 0)))
    return predict(docs, model).select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "lang_pred", "score")
