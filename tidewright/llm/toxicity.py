"""Toxicity by a weighted finite-state pattern grammar.

A lexicon, learned from labelled rows, turns the words of a clause into symbols:
insult, threat, target, negation, report or any other word. Five small weighted
transducers read the symbols; their composition is one deterministic transducer
over their joint states, built once. A clause's weight is that of its path, so
"you are a moron" weighs more than a lone "moron", and "he said ..." or "you
are not a ..." less. A document is scored on its matched clauses alone, by a
logistic curve fitted on labelled rows.
"""

from __future__ import annotations

import math
import pickle
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm.common import SpanHasher, held_out, load, sample_below, sliced

THRESHOLD = 0.3
#: At most about so many labelled documents of each class are learned from.
FIT_DOCS = {1: 3000, 0: 6000}
PRIOR = 10
#: Least share of toxic ones among the documents of a lexicon word, and the log odds ratio from which its strength is 1.
LEAST_SHARE, FULL_ODDS = 0.3, 6.0
#: Texts that share so many least hashes of words and stems count as copies.
COPY_MARK = 3
#: Insults are learned as whole words and as stems of these lengths.
STEMS = (4, 5, 6, 7, 8)
CLAUSE = re.compile(r"[.!?;\n|]+")
BITMAP = 22

# Closed word classes of the four languages.
TARGETS = frozenset("you your yours they them he she him her u du dich dir ihr euch sie er tu te toi vous il elle ils eux tú ti usted ustedes vosotros él ella ellos".split())
NEGATIONS = frozenset("not no never cannot neither nor without isn aren don nicht kein keine nie pas jamais ne nunca ni sin".split())
REPORTS = frozenset("said says say wrote called quoted claimed reported sagte sagt schrieb nannte dit disait écrit appelé dijo dice escribió llamó".split())
THREATS = frozenset("kill killing hurt destroy burn shoot stab töten umbringen schlagen tuer frapper brûler matar golpear quemar".split())

#: What stands before the t of isn't, can't and so on: such a t is a negation.
APOSTROPHES = "'\u2019"

SYMBOLS = ("other", "insult", "threat", "target", "negation", "report")
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)


class Transducer:
    """A deterministic weighted transducer: (state, symbol) -> (state, symbol put out, weight). Missing steps stay, copy and weigh 0."""

    def __init__(self, steps: dict[tuple[object, int], tuple[object, int, float]], start: object = 0) -> None:
        self.steps, self.start = steps, start

    def step(self, state: object, symbol: int) -> tuple[object, int, float]:
        return self.steps.get((state, symbol), (state, symbol, 0.0))

    def compose(self, after: Transducer) -> Transducer:
        """What this one puts out is read by ``after``; weights add. Only joint states that can be reached are built."""
        start = (self.start, after.start)
        steps, todo, seen = {}, [start], {start}
        while todo:
            state = todo.pop()
            for symbol in range(len(SYMBOLS)):
                a, out, w = self.step(state[0], symbol)
                b, out, v = after.step(state[1], out)
                steps[state, symbol] = ((a, b), out, w + v)
                if (a, b) not in seen:
                    seen.add((a, b))
                    todo.append((a, b))
        return Transducer(steps, start)

    def weight(self, symbols: list[int]) -> float:
        state, total = self.start, 0.0
        for s in symbols:
            state, _, w = self.step(state, s)
            total += w
        return total


def negation() -> Transducer:
    """A negation spends itself on the next insult or threat within three words: it is put out as another word, at a small weight."""
    steps = {}
    for left in range(4):
        steps[left, NEGATION] = (3, NEGATION, 0.0)
        for s in (OTHER, TARGET, REPORT):
            steps[left, s] = (max(left - 1, 0), s, 0.0)
        for s in (INSULT, THREAT):
            steps[left, s] = (0, OTHER, 0.25) if left else (0, s, 0.0)
    return Transducer(steps)


def reported() -> Transducer:
    """After a verb of reporting the clause's insults and threats weigh less."""
    return Transducer({(0, REPORT): (1, REPORT, 0.0), (1, INSULT): (1, INSULT, -0.4), (1, THREAT): (1, THREAT, -0.4)})


def insults() -> Transducer:
    """The first insult of a clause weighs most, each further one less."""
    return Transducer({(0, INSULT): (1, INSULT, 1.0), (1, INSULT): (2, INSULT, 0.5), (2, INSULT): (2, INSULT, 0.25)})


def threats() -> Transducer:
    """A threat counts once a target is near, whichever comes first."""
    return Transducer({(0, THREAT): (1, THREAT, 0.0), (0, TARGET): (2, TARGET, 0.0), (1, TARGET): (3, TARGET, 0.5), (2, THREAT): (3, THREAT, 0.5)})


def targets() -> Transducer:
    """An insult in a clause with a target weighs a little more, once."""
    return Transducer({(0, TARGET): (1, TARGET, 0.0), (0, INSULT): (2, INSULT, 0.0), (1, INSULT): (3, INSULT, 0.25), (2, TARGET): (3, TARGET, 0.25)})


@lru_cache(maxsize=1)
def grammar() -> Transducer:
    return negation().compose(reported()).compose(insults()).compose(threats()).compose(targets())


# ---- words as hashes -----------------------------------------------------------


class Words:
    """The words of many texts, lower-cased: where they stand, whose they are and the hashes of wholes and stems."""

    def __init__(self, texts: list[str], hasher: SpanHasher) -> None:
        self.texts = [t.lower() for t in texts]
        codes = np.frombuffer("\n".join(self.texts).encode("utf-32-le", "replace"), np.uint32)
        self.begins = np.concatenate(([0], np.cumsum(np.fromiter(map(len, self.texts), np.int64, len(texts)) + 1)))
        letter = np.zeros(len(codes) + 2, bool)
        letter[1:-1] = (codes >= 97) & (codes <= 122)
        beyond = np.flatnonzero(codes >= 128)
        if len(beyond):
            kinds, back = np.unique(codes[beyond], return_inverse=True)
            letter[1 + beyond] = np.array([chr(c).isalpha() for c in kinds])[back]
        self.starts = np.flatnonzero(letter[1:-1] & ~letter[:-2])
        self.ends = np.flatnonzero(letter[1:-1] & ~letter[2:]) + 1
        self.first = np.searchsorted(self.starts, self.begins)
        hasher.load(codes)
        self.wholes = ~hasher.spans(self.starts, self.ends)
        self.hasher = hasher

    def stems(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each stem length the words that are longer, and their stems' hashes."""
        for k in STEMS:
            long = np.flatnonzero(self.ends - self.starts > k)
            yield long, self.hasher.spans(self.starts[long], self.starts[long] + k)

    def hashes(self) -> np.ndarray:
        return np.concatenate([self.wholes, *(h for _, h in self.stems())])


def whole_hashes(words: list[str]) -> np.ndarray:
    return Words(words, SpanHasher()).wholes


class Lexicon:
    """Hashes of insults and their strengths (0 to 1), behind a bitmap that most words don't pass."""

    def __init__(self, hashes: np.ndarray, strengths: np.ndarray | None = None) -> None:
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        self.strengths = np.ones(len(hashes)) if strengths is None else strengths[order]
        self.bits = np.zeros(1 << BITMAP, bool)
        self.bits[self.hashes >> np.uint64(64 - BITMAP)] = True

    def of(self, hashes: np.ndarray) -> np.ndarray:
        """Each hash's strength, 0 for those that aren't here."""
        out = np.zeros(len(hashes))
        at = np.flatnonzero(self.bits[hashes >> np.uint64(64 - BITMAP)])
        if len(at):
            k = np.minimum(np.searchsorted(self.hashes, hashes[at]), len(self.hashes) - 1)
            out[at] = np.where(self.hashes[k] == hashes[at], self.strengths[k], 0.0)
        return out

    def marks(self, words: Words) -> np.ndarray:
        """Each word's strength as an insult: the largest of the whole word's and its stems'."""
        out = self.of(words.wholes)
        for long, stems in words.stems():
            out[long] = np.maximum(out[long], self.of(stems))
        return out


CLOSED = {**dict.fromkeys(TARGETS, TARGET), **dict.fromkeys(NEGATIONS, NEGATION), **dict.fromkeys(REPORTS, REPORT), **dict.fromkeys(THREATS, THREAT)}
_THREATS = Lexicon(whole_hashes(sorted(THREATS)))


def symbol(text: str, start: int, end: int) -> int:
    """The closed class of a word, or OTHER."""
    if end - start == 1 and text[start] == "t" and start and text[start - 1] in APOSTROPHES:
        return NEGATION
    return CLOSED.get(text[start:end], OTHER)


class Matcher:
    """Finds and weighs the clauses of texts that have an insult or a threat."""

    def __init__(self, lexicon: tuple[np.ndarray, np.ndarray]) -> None:
        self.lexicon, self.hasher, self.machine = Lexicon(*lexicon), SpanHasher(), grammar()

    def clauses(self, texts: list[str]) -> Iterator[tuple[int, list[tuple[int, int, float]], int]]:
        """For each text that has any: its number, its matched clauses' begin, end (in the lower-cased text) and weight, and its words."""
        words = Words(texts, self.hasher)
        insult = self.lexicon.marks(words)
        marked = np.flatnonzero((insult > 0) | (_THREATS.of(words.wholes) > 0))
        for i in np.unique(np.searchsorted(words.begins, words.starts[marked], "right") - 1):
            text, a = words.texts[i], words.begins[i]
            starts = words.starts[words.first[i] : words.first[i + 1]] - a
            ends = words.ends[words.first[i] : words.first[i + 1]] - a
            flags = insult[words.first[i] : words.first[i + 1]]
            bounds = [m.span() for m in CLAUSE.finditer(text)]
            lo = np.array([0, *(e for _, e in bounds)])
            hi = np.array([*(s for s, _ in bounds), len(text)])
            own = marked[(marked >= words.first[i]) & (marked < words.first[i + 1])] - words.first[i]
            out = []
            for c in np.unique(np.searchsorted(lo, starts[own], "right") - 1):
                w0, w1 = np.searchsorted(starts, (lo[c], hi[c]))
                read = [INSULT if f else symbol(text, s, e) for s, e, f in zip(starts[w0:w1].tolist(), ends[w0:w1].tolist(), flags[w0:w1].tolist(), strict=True)]
                out.append((int(lo[c]), int(hi[c]), self.weight(read, max(flags[w0:w1].tolist()))))
            yield int(i), out, len(starts)

    def weight(self, read: list[int], strength: float) -> float:
        """A clause's weight: what its threats weigh, and what its insults add, by the strength of the strongest."""
        alone = self.machine.weight([OTHER if s == INSULT else s for s in read])
        return alone + strength * (self.machine.weight(read) - alone) if strength else alone

    def evidence(self, texts: list[str]) -> np.ndarray:
        """For each text 1, the heaviest clause's weight, and the logs of one more than all weights' sum and than their sum for 100 words."""
        x = np.zeros((len(texts), 4))
        x[:, 0] = 1
        for i, found, words in self.clauses(texts):
            weights = [max(0.0, w) for _, _, w in found]
            x[i, 1:] = max(weights), math.log1p(sum(weights)), math.log1p(100 * sum(weights) / words)
        return x


# ---- learning ------------------------------------------------------------------


def learn_lexicon(toxic: list[str], clean: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and strengths of the words and stems that toxic documents have far more often than chance explains.

    A word in k toxic of m documents stays if k/m is over 0.3 and so large a
    share, at the classes' base rate, is less likely than 1 in e^4 for all
    candidate words together (by the Chernoff bound). Copies are no independent
    evidence: of texts with the same least hashes one counts.
    """
    if not toxic:
        return np.zeros(0, np.uint64), np.zeros(0)
    hasher = SpanHasher()

    def seen(texts: list[str]) -> Iterator[np.ndarray]:
        before = set()
        for t in texts:
            h = np.unique(Words([t], hasher).hashes())
            if (mark := tuple(h[:COPY_MARK].tolist())) not in before:
                before.add(mark)
                yield h

    runs, parts = [], []
    for h in seen(toxic):
        parts.append(h)
        if sum(map(len, parts)) > 2_000_000:
            runs.append(np.unique(np.concatenate(parts), return_counts=True))
            parts = []
    runs.append(np.unique(np.concatenate(parts), return_counts=True) if parts else (np.zeros(0, np.uint64), np.zeros(0, np.int64)))
    every, back = np.unique(np.concatenate([r[0] for r in runs]), return_inverse=True)
    k = np.bincount(back, np.concatenate([r[1] for r in runs]), len(every))
    often = k >= 3
    every, k = every[often], k[often]
    n = np.zeros(len(every))
    for h in seen(clean):
        at = np.searchsorted(every, h)
        at[at == len(every)] = 0
        if len(every):
            n[at[every[at] == h]] += 1
    base = (len(toxic) + 1) / (len(toxic) + len(clean) + 2)
    m = k + n
    share = k / np.maximum(m, 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = k * np.log(share / base) + np.where(n > 0, n * np.log((1 - share) / (1 - base)), 0.0)
    good = (share > max(LEAST_SHARE, 2 * base)) & (gain > math.log(max(len(every), 1)) + 4)
    odds = np.log((k[good] + 0.5) / (n[good] + 0.5)) - math.log(base / (1 - base))
    return every[good], np.minimum(1.0, odds / FULL_ODDS)


def fit(texts: list[str], labels: list[int]) -> dict:
    """The lexicon and the logistic curve over a document's evidence."""
    toxic = [t for t, y in zip(texts, labels, strict=True) if y]
    lexicon = learn_lexicon(toxic, [t for t, y in zip(texts, labels, strict=True) if not y])
    matcher = Matcher(lexicon)
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])
    x = np.concatenate([matcher.evidence(part.column(0).to_pylist()) for part in sliced(batch, "text")])
    # a few clean rows of no evidence: with hardly a label a text that matches nothing still isn't toxic
    x = np.concatenate((x, np.tile([1.0, 0.0, 0.0, 0.0], (PRIOR, 1))))
    y = np.array([*labels, *[0] * PRIOR], float)
    b = np.zeros(4)
    for _ in range(50):  # Newton steps with a small ridge
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(4)
        b += np.linalg.solve(h, x.T @ (y - p) - 0.05 * b)
    return {"lexicon": lexicon, "curve": b}


def train(docs: DataFrame, labels: DataFrame, fit_docs: dict[int, int] = FIT_DOCS) -> dict | None:
    """Learn from ``labels`` (doc_id, toxic) of ``docs`` (doc_id, text); null labels and ids are left out.

    Of several labels of a document the largest counts. About ``fit_docs``
    documents of each class, chosen by a hash of doc_id, are learned from, in one
    executor task; of rows that repeat a doc_id the least text, a null one being
    empty. Texts are read whole. None if there are none.
    """
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y"))
    n = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not n:
        return None
    chosen = known.where(F.when(F.col("y") == 1, sample_below("doc_id", min(1.0, fit_docs[1] / n.get(1, 1)))).otherwise(sample_below("doc_id", min(1.0, fit_docs[0] / n.get(0, 1)))))
    share = {y: min(1.0, fit_docs[y] / n[y]) for y in n}
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")  # a bounded number of rows of two numbers
    rows = rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = sorted(r for b in batches for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True))
        if got:
            model = fit([r[1] for r in got], [r[2] for r in got])
            # the classes were sampled at different rates; the curve's constant takes that back
            model["curve"][0] += math.log(share.get(0, 1.0) / share.get(1, 1.0))
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    models = rows.repartition(1).mapInArrow(run, "model binary").collect()
    return pickle.loads(models[0]["model"]) if models else None


class Scorer:
    """A model at work in one task."""

    def __init__(self, model: dict) -> None:
        self.curve, self.matcher = model["curve"], Matcher(model["lexicon"])

    def scores(self, texts: list[str | None]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.matcher.evidence([t or "" for t in texts]) @ self.curve, -30, 30)))


def score(docs: DataFrame, model: dict | None) -> DataFrame:
    """doc_id and score (0 to 1) of every document (doc_id, text; further columns are ignored).

    Null and empty texts have no matched clause: the curve's foot. Where nothing was learned that is 0.
    A text of any length is read whole. Every row is scored by itself, so repeated rows and rows without
    doc_id come back as often, and equal texts score the same. No rows give no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model or {"lexicon": (np.zeros(0, np.uint64), np.zeros(0)), "curve": np.array([-30.0, 0.0, 0.0, 0.0])})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for whole in batches:
            for batch in sliced(whole, "text"):
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scorer.scores(batch.column(1).to_pylist()))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")


def op7_toxicity_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of documents, learned from labels of rows not held out."""
    docs = load(spark, sf_dir, "documents", "doc_id", "text")
    model = train(docs, load(spark, sf_dir, "labels", "doc_id", "toxic").where(~held_out("doc_id", 4, 2)))
    return score(docs, model).select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def clean(docs: DataFrame, model: dict | None, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the documents that score ``threshold`` or more; columns and other rows as they are.

    Null and empty texts stay, unless the threshold is no higher than the curve's foot. Rows are judged one by
    one, repeated ones and those without doc_id too. Texts are read whole. No rows give no rows.
    Scoring and choosing are one pass over the rows: nothing is shuffled.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model or {"lexicon": (np.zeros(0, np.uint64), np.zeros(0)), "curve": np.array([-30.0, 0.0, 0.0, 0.0])})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for whole in batches:
            for batch in sliced(whole, "text"):
                yield batch.filter(pa.array(scorer.scores(batch.column("text").to_pylist()) < threshold))

    return docs.mapInArrow(run, docs.schema)
