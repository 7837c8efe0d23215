"""Cases beyond the test tables: norms, page neighbours, passages of short lines, clauses, edited items, damaged archives."""

from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tests.conftest import SF
from tidewright.llm import ann, decontam, html_text, langid, linededup, quality, toxicity, warc
from tidewright.llm.common import SpanHasher

# ---- vectors ----


def found_share(spark, x, step=50, k=20):
    x = x.astype(np.float32)
    v = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "vec_id long, embedding array<float>")
    got = ann.nearest(v, v.where(f"vec_id % {step} = 0"), k).toPandas()
    by, exact, hits, total = {q: set(g.vec_id) for q, g in got.groupby("query_id")}, x.astype(float), 0, 0
    for q in range(0, len(x), step):
        s = exact @ exact[q]
        s[q] = -np.inf
        best = np.lexsort((np.arange(len(x)), -s))[: min(k, len(x) - 1)]
        hits += len(set(best) & by.get(q, set()))
        total += len(best)
    return hits / total


@pytest.mark.parametrize("kind", ["log-normal norms", "clusters of two norms", "huge"])
def test_norms_cost_no_recall(spark, kind):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(2600, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if kind == "log-normal norms":
        x *= np.exp(rng.normal(size=(2600, 1)))
    elif kind == "huge":
        x *= 1e20
    else:
        x = x[rng.integers(0, 30, 2600)] + rng.normal(size=(2600, 24)) * 0.05
        x[::2] *= 30
    assert found_share(spark, x) >= 0.9


def test_few_candidates_all_come_back(spark):
    rng = np.random.default_rng(4)
    assert found_share(spark, rng.normal(size=(21, 6)) * 10.0 ** rng.integers(-6, 7, (21, 1)), step=1) == 1.0


def test_other_lengths_take_no_part(spark):
    v = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(5)], "vec_id long, embedding array<float>")
    q = spark.createDataFrame([(100, [1.0]), (101, [1.0, 0.0, 0.0]), (102, [0.0, 1.0])], "vec_id long, embedding array<float>")
    got = ann.nearest(v, q, 2).collect()
    assert [(r["query_id"], r["vec_id"]) for r in sorted(got, key=lambda r: r["rank"])] == [(102, 4), (102, 3)]


def test_bands_are_dealt_whole():
    assert ann.shards_of({3: 5, 2: 10, 1: 5000, 0: 1, -7: 2}, 2000, 100) == [(3, 0, 1), (2, 0, 1), (1, 1, 3), (0, 4, 1), (-7, 4, 1)]
    shards = {}
    for band, first, parts in ann.shards_of({b: 40 + b for b in range(50)}, 2000, 100):
        shards.setdefault(first, []).append(40 + band)
        assert parts == 1
    assert all(sum(s) <= 100 for s in shards.values()) and sum(map(len, shards.values())) == 50


# ---- pages ----


def by_hand(pages):
    """Main texts by comparing every page with the four before and after it on its host."""
    host = lambda u: re.match(r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", u or "")
    path = lambda u: re.sub(r"[?#].*$", "", re.sub(r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*", "", u or ""), flags=re.S)
    rows = sorted(((m[1].lower() if (m := host(u)) else ""), path(u), p, h) for p, u, h in pages)
    parsed = [html_text.marked_lines(h or "") for *_, h in rows]
    keys = [[(x, k == html_text.MARKED) for x, k in lines] for lines in parsed]
    content = [[x for x, k in lines if k != html_text.MARKED] for lines in parsed]
    out, deleted = {}, 0
    for i, row in enumerate(rows):
        near = []
        for j in range(max(0, i - 4), min(len(rows), i + 5)):
            if j != i and rows[j][0] == row[0] and content[i] != content[j]:
                a, b = min(i, j), max(i, j)
                both = html_text.common(keys[a], keys[b])
                near.append((j - i, [x if a == i else y for x, y in both]))
        gone = set(html_text.decided([k for _, k in parsed[i]], near))
        deleted += len(gone)
        out[row[2]] = "\n\n".join(x for n, (x, k) in enumerate(parsed[i]) if n not in gone and k != html_text.MARKED)
    return out, deleted


def test_op3_is_differencing_by_hand(spark):
    rows = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html").collect()
    want, deleted = by_hand([tuple(r) for r in rows])
    pages = spark.read.parquet(f"{SF}/pages.parquet").repartition(7)
    assert {r["page_id"]: r["text"] for r in html_text.main_text(pages).collect()} == want
    shared = html_text.shared_lines(pages).collect()
    assert sum(len(r["shared"]) for r in shared) == deleted > 0


def test_content_goes_by_evidence(spark):
    note = "<p>Printed from our archive</p>"
    quote = "<p>a passage that one other page quotes</p>"
    rows = [(i, f"http://h/a/{i:03d}", f"<article><p>story {i}</p>{note}{quote if i in (10, 11) else ''}</article><div>below {i}</div><div>legal</div>") for i in range(40)]
    rows += [(100 + i, f"http://copies/{i}", "<p>the same page</p><p>at three places</p>") for i in range(3)]
    got = {r["page_id"]: r["text"] for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(9)).collect()}
    want = {i: f"story {i}" + ("\n\na passage that one other page quotes" if i in (10, 11) else "") + f"\n\nbelow {i}" for i in range(40)}
    assert got == want | {100 + i: "the same page\n\nat three places" for i in range(3)}


# ---- lines ----


def test_rows_of_one_id_are_apart(spark):
    text = "\n".join(f"line {i} of a text that stands in three rows" for i in range(9))
    rows = [(1, text), (2, text), (3, text), (3, "something else\nthat is not repeated"), (4, text), (4, text), (None, text)]
    got = linededup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in got) == sorted([("1", text), ("2", ""), ("3", ""), ("3", rows[3][1]), ("4", ""), ("4", ""), ("None", text)])


def test_passages_of_short_lines_are_caught(spark):
    rng = random.Random(12)
    words = lambda k: " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(k))
    passages = [[words(8) for _ in range(n)] for n in (7, 9, 12, 20) for _ in range(5)]
    rows = [(i, "\n".join([*(words(8) for _ in range(4)), *passages[i % 20], *(words(8) for _ in range(4))])) for i in range(60)]
    got = {r["doc_id"]: r["text"] for r in linededup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    left = [sum(line in got[i].split("\n") for line in passages[i % 20]) / len(passages[i % 20]) for i in range(20, 60)]
    assert all(got[i] == t for i, t in rows[:20]) and np.mean(left) <= 0.3 and max(left) < 1


# ---- clauses ----


def test_reports_negations_and_threats():
    m = toxicity.Matcher((np.concatenate((toxicity.whole_hashes(["moron"]), toxicity.whole_hashes(["dull"]))), np.array([1.0, 0.1])))
    weight = lambda t: max(w for _, found, _ in m.clauses([t]) for _, _, w in found)
    assert weight("he said: you are a moron") == weight("he said you are a moron") < weight("you are a moron")
    assert weight("he wasn't a moron") == weight("you can’t be a moron") == weight("he was not a moron") < weight("he was a moron")
    assert weight("i will kill you") <= weight("i will kill you, dull") <= weight("i will kill you, moron")


# ---- benchmark ----


def test_op8_finds_edited_items_on_the_whole_table(spark):
    docs = [(r["doc_id"], decontam.normal(r["text"] or "")) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r["item_id"], decontam.normal(r["text"])) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = {(d, i): hit[0] for d, t in docs for i, p in items if p and (hit := (0,) if p in t else decontam.myers(p, t, decontam.budget(p)))}
    got = {(r["doc_id"], r["item_id"]): r["distance"] for r in decontam.op8_pigeonhole_decontamination(spark, SF).collect()}
    assert got == want and want


def test_places_of_matches():
    item = "the quick brown fox jumps over it"
    for text, d, place in ((f"so {item} now", 0, item), ("so the quick brwn fox jumps over it now", 1, "the quick brwn fox jumps over it"), ("so the quick brown fox jumpss over it now", 1, "the quick brown fox jumpss over it")):
        (found,) = decontam.matches(text, _automaton([(5, item)]), [(5, item)])
        assert found[:2] == (5, d) and text[found[2] : found[3]] == place
    short = "abcdefghij klmnopqrst"
    assert decontam.budget(short) == 1 and decontam.matches("x abcdefghij klmnopqrsX y", _automaton([(1, short)]), [(1, short)])[0][1] == 1


def _automaton(items):
    import ahocorasick

    a = ahocorasick.Automaton()
    for number, (_, pattern) in enumerate(items):
        for offset, piece in decontam.pieces(pattern):
            a.get(piece, None) or a.add_word(piece, [])
            a.get(piece).append((number, offset, len(piece)))
    a.make_automaton()
    return a


# ---- archive ----


def test_damaged_payloads_are_told(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a\r\nX-Page-ID: 9", "x" * 200), (2, "u", "x" * 200), (3, "u", "y" * 150), (4, None, None)], "page_id long, url string, html string")
    path = str(tmp_path / "w")
    warc.write_archive(pages, path)
    whole = {r["page_id"]: r for r in warc.read_archive(spark, path).collect()}
    assert sorted(whole) == [1, 2, 3, 4] and all(r["verified"] for r in whole.values()) and whole[2]["refers_to"] == 1 and whole[2]["kind"] == "revisit" and whole[2]["payload_bytes"] == 200
    assert bytes(whole[1]["record"]).endswith(b"\r\n\r\n" + b"x" * 200 + b"\r\n\r\n") and bytes(whole[2]["record"]).endswith(b"\r\n\r\n\r\n\r\n")
    hurt = str(tmp_path / "hurt")
    spark.read.parquet(f"{path}/headers").write.parquet(f"{hurt}/headers")
    spark.read.parquet(f"{path}/payloads").selectExpr("digest", "CASE WHEN length(payload) = 150 THEN concat(payload, X'7A') ELSE payload END AS payload").write.parquet(f"{hurt}/payloads")
    assert {r["page_id"]: r["verified"] for r in warc.read_archive(spark, hurt).collect()} == {1: True, 2: True, 3: False, 4: True}


# ---- learning, ties and repeated rows ----


def test_a_repeated_doc_id_is_one_document_to_learn_from(spark):
    rows = [(i, f"the cat and the dog number {i} are here" if i % 2 else f"der hund und die katze nummer {i} sind hier", "en" if i % 2 else "de") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    more = docs.unionByName(spark.createDataFrame([(1, "the cat and the dog number 1 are here", "en"), (1, "zz zz", "fr")] * 200, docs.schema))
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(60)], "doc_id long, quality int, toxic int")
    one, two = quality.train(docs, labels, "quality"), quality.train(more, labels, "quality")
    assert (one["numbers"] == two["numbers"]).all() and one["bias"] == two["bias"]
    one, two = toxicity.train(docs, labels), toxicity.train(more, labels)
    assert (one["curve"] == two["curve"]).all() and (one["lexicon"][0] == two["lexicon"][0]).all()
    assert langid.train(more)["classes"] == ["de", "en"]


def test_equal_texts_get_the_same_in_any_batch(spark):
    text = "the cat and the dog " * 50_000
    rows = [(i, t) for i, t in enumerate([text, "a dog", None, "", "a dog", "7 7", text, "a dog"])] + [(1, "a dog"), (None, "a dog")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame([(i, "the cat and a dog" if i % 2 else "le chat et un chien", "en" if i % 2 else "fr") for i in range(50)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(50)], "doc_id long, quality int, toxic int")
    models = [(langid.predict, langid.train(known)), (quality.score, quality.train(known, labels, "quality")), (toxicity.score, toxicity.train(known, labels))]
    for f, model in models:
        got = [[tuple(r) for r in f(docs.repartition(n), model).collect()] for n in (1, 5)]
        assert len(got[0]) == len(rows) and sorted(got[0], key=str) == sorted(got[1], key=str)
        assert len({r[1:] for r in got[0] if r[0] in (1, 4, 7, None)}) == 1 and len({r[1:] for r in got[0] if r[0] in (0, 6)}) == 1


def test_languages_that_tie_go_by_name(spark):
    model = {"classes": ["aa", "bb"], "bias": np.zeros(2), "weights": np.zeros((1 << langid.BITS, 2), np.float32), "temperature": 1.0}
    assert [tuple(r) for r in langid.predict(spark.createDataFrame([(1, "abc")], "doc_id long, text string"), model).collect()] == [(1, "aa", 0.5)]


def test_scores_are_sums_over_features_by_hand(spark):
    """The batched scores of languages and quality against each text's features counted alone."""
    docs = [(r["doc_id"], r["text"] or "", r["lang"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    model = langid.train(frame)
    got = {r["doc_id"]: r for r in langid.predict(frame, model).collect()}
    for d, t, _ in docs:
        if any(map(str.isalpha, t)):
            ids = langid.grams([t])[0]
            v = (model["weights"][ids].astype(float).sum(axis=0) / len(ids) + model["bias"]) / model["temperature"]
            p = np.exp(v - v.max()) / np.exp(v - v.max()).sum()
            assert got[d]["lang_pred"] == model["classes"][p.argmax()] and abs(got[d]["score"] - p.max()) < 1e-3
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality")
    model = quality.train(frame, labels, "quality")
    got = {r["doc_id"]: r["score"] for r in quality.score(frame, model).collect()}
    for d, t, _ in docs:
        ids = np.concatenate(quality.features(pa.array([t]), SpanHasher())[0])
        logit = model["numbers"][ids].astype(float).sum() / max(len(ids), 1) + model["bias"]
        assert abs(got[d] - 1 / (1 + np.exp(-logit))) < 1e-6
