"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing column names, for every operator and stage."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidewright.llm import ann, decontam, html_text, langid, linededup, neardup, packing, quality, toxicity, warc

LONG = "lorem ipsum dolor " * 60_000
PARA = "\n".join(f"line {i} of a passage that stands in more than one text" for i in range(12))
ROWS = [
    (1, "You are a moron. " * 3, "en", "a", 51), (2, None, None, None, None), (3, "", "en", None, 0), (4, "   \n\t ", "de", "b", 6), (5, LONG, "en", "a", len(LONG)),
    (6, PARA, "en", "a", 1), (7, PARA, "en", "a", 1), (7, PARA, "en", "a", 1), (None, "no id here at all", None, "c", 3), (8, "übergrößen ßtraße naïve", "de", "b", 2), (9, "12 34 !!", "fr", "b", 2), (10, "😀".encode("utf-16", "surrogatepass").decode("utf-16") + " x\x1cy", "fr", "b", 2),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ["n", "key", "c", "a", "b", "bands", "f1", "score", "y", "span", "off", "len", "spans", "task", "local", "length", "first", "rank", "html", "shared", "host", "path", "lines", "component_id", "kept", "ids", "shard", "block", "item_id", "digest", "payload", "kind"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def clashing(docs):
    return docs.select("*", *(F.lit("z").alias(c) for c in CLASH))


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 0, 1), (1, 0, 1), (6, 1, 0), (7, None, 0), (None, 1, 1), (8, 1, None)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, "line 3 of a passage that stands in more than one text"), (2, None), (3, ""), (None, "x"), (4, "zz"), (1, "line 3 of a passage that stands in more than one text")], "item_id long, text string")


def n(df):
    return len(df.collect())


def tokens():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def test_packing(docs, clashing, none):
    got = packing.pack(clashing, tokens()).collect()
    assert {r["doc_id"] for r in got} == {r[0] for r in ROWS} and len(got) > len(ROWS)
    assert [r["length"] for r in got if r["doc_id"] in (2, 3, 4)] == [1, 1, 1]
    assert packing.pack(none, tokens()).schema == packing.pack(docs, tokens()).schema and n(packing.pack(none, tokens())) == 0


def test_near_duplicates(docs, clashing, none):
    got = neardup.near_duplicates(clashing, 2).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == len(ROWS) and by[7]["component_id"] == 6 and not by[7]["kept"]
    assert by[2]["n_shingles"] == 0 and by[2]["component_id"] == 2 and by[3]["kept"] and by[4]["kept"] and by[None]["kept"] and by[None]["component_id"] is None
    assert n(neardup.near_duplicates(none)) == 0
    kept = neardup.one_of_each(clashing)
    assert kept.columns == clashing.columns and sorted(r["doc_id"] for r in kept.collect() if r["doc_id"]) == [1, 2, 3, 4, 5, 6, 8, 9, 10]
    assert n(neardup.one_of_each(none)) == 0


def test_line_dedup(docs, clashing, none):
    got = {r["doc_id"]: r for r in linededup.line_dedup(clashing).collect()}
    assert set(got) == {r[0] for r in ROWS} and got[6]["text"] == PARA and len(got[7]["text"]) < len(PARA) and got[7]["removed_chunks"] > 0
    assert got[2]["text"] is None and got[5]["text"] == LONG and got[None]["text"] == "no id here at all"
    again = linededup.line_dedup(docs.withColumn("removed_chunks", F.lit("old")))
    assert again.columns == [*docs.columns, "removed_chunks"] and n(again) == len(ROWS) and n(linededup.line_dedup(none)) == 0


def test_decontamination(docs, clashing, none, items):
    got = decontam.leaks(clashing, items).collect()
    assert sorted((r["doc_id"], r["item_id"], r["distance"]) for r in got) == [(6, 1, 0), (7, 1, 0)]
    kept = decontam.decontaminated(clashing, items.withColumn("doc_id", F.lit(5)))
    assert kept.columns == clashing.columns and n(kept) == len(ROWS) - 3
    assert n(decontam.leaks(none, items)) == 0 and n(decontam.leaks(docs, items.limit(0))) == 0 and n(decontam.decontaminated(docs, items.limit(0))) == len(ROWS)


def test_language(docs, clashing, none):
    model = langid.train(clashing)
    got = {r["doc_id"]: r for r in langid.predict(clashing, model).collect()}
    assert len(got) == 11 and got[2]["lang_pred"] == got[9]["lang_pred"] == got[4]["lang_pred"] == "und" and got[2]["score"] == 0 and all(0 <= r["score"] <= 1 for r in got.values())
    assert langid.train(none) is None and {r["lang_pred"] for r in langid.predict(docs, None).collect()} == {"und"} and n(langid.predict(none, model)) == 0


def test_quality(docs, clashing, none, labels):
    model = quality.train(clashing, labels, "quality")
    got = quality.score(clashing, model).collect()
    assert len(got) == len(ROWS) and all(0 <= r["score"] <= 1 for r in got)
    assert quality.train(docs, labels.limit(0), "quality") is None and {r["score"] for r in quality.score(docs, None).collect()} == {0.5} and n(quality.score(none, model)) == 0


def test_toxicity(docs, clashing, none, labels):
    model = toxicity.train(clashing, labels)
    got = toxicity.score(clashing, model).collect()
    assert len(got) == len(ROWS) and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.train(docs, labels.limit(0)) is None and n(toxicity.score(none, model)) == 0
    kept = toxicity.clean(clashing, None)
    assert kept.columns == clashing.columns and n(kept) == len(ROWS) and n(toxicity.clean(none, model)) == 0


PAGES = [(1, "http://a.b/x", "<p>hi</p>" * 20), (2, None, None), (3, "http://a.b/y", ""), (4, "nonsense", "<p>hi</p>" * 20), (5, "http://a.b/x", "<p>small</p>"), (6, "http://a.b/z", "<p>small</p>"), (None, "http://a.b/x", "<p>hi</p>" * 20), (7, "http://a.b/q", "<div " * 3000), (7, "http://a.b/q", "<div " * 3000)]
PAGE = "page_id long, url string, html string"


def test_html(spark):
    pages = spark.createDataFrame(PAGES, PAGE)
    wide = pages.select("*", *(F.lit("z").alias(c) for c in CLASH if c != "html"), F.lit("t").alias("text"))
    got = {r["page_id"]: r for r in html_text.main_text(wide).collect()}
    assert len(got) == 8 and got[2]["text"] == "" and got[3]["n_chars"] == 0 and got[4]["text"].startswith("hi\n\nhi")
    assert n(html_text.main_text(pages)) == len(PAGES) and n(html_text.main_text(pages.limit(0))) == 0


def test_archive(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, PAGE)
    wide = pages.select("*", *(F.lit("z").alias(c) for c in CLASH if c != "html"))
    warc.write_archive(wide, str(tmp_path / "w"))
    got = warc.read_archive(spark, str(tmp_path / "w")).collect()
    assert len(got) == len(PAGES) and all(r["verified"] for r in got)
    kinds = {r["page_id"]: (r["kind"], r["refers_to"]) for r in got}
    assert kinds[4] == ("revisit", 1) and kinds[1] == ("response", None) and kinds[6] == kinds[5] == ("response", None) and kinds[None][0] == "response"
    assert spark.read.parquet(str(tmp_path / "w/payloads")).groupBy("digest").count().where("count > 1").count() == 0
    warc.write_archive(pages.limit(0), str(tmp_path / "e"))
    assert n(warc.read_archive(spark, str(tmp_path / "e"))) == 0


def test_vectors(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [1.0, 0.0], "x"), (0, [1.0, 0.0], "x"), (20, [0.0, 1.0], "x"), (1, None, "x"), (2, [0.0, 0.0], "x"), (3, [nan, 1.0], "x"), (4, [inf, 1.0], "x"), (5, [None, 1.0], "x"), (6, [1.0], "x"), (7, [], "x"), (8, [1.0, 1.0], "x"), (9, [1.0, 1.0], "x"), (None, [1.0, 1.0], "x")]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>, ids string").select("*", *(F.lit("z").alias(c) for c in CLASH if c != "ids"))
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in ann.nearest(v, v.where("vec_id % 20 = 0")).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 8, 1.0), (0, 2, 9, 1.0), (0, 3, 20, 0.0), (20, 1, 8, 1.0), (20, 2, 9, 1.0), (20, 3, 0, 0.0)]
    assert n(ann.nearest(v.limit(0), v)) == 0 and n(ann.nearest(v, v.limit(0))) == 0


@pytest.mark.parametrize("name", [s for s, _ in corpus_pipeline.STAGES])
def test_stages(spark, docs, none, labels, items, tmp_path, name):
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    items.write.parquet(str(tmp_path / "benchmark.parquet"))
    stage = dict(corpus_pipeline.STAGES)[name]
    out = stage(spark, docs, str(tmp_path))
    rows = out.collect()
    assert rows and n(stage(spark, none, str(tmp_path))) == 0
    if name != "packing":
        assert out.columns == docs.columns and {2, 3, 8, 9, None} <= {r["doc_id"] for r in rows}


@pytest.mark.parametrize("name", [s for s, _ in corpus_pipeline.STAGES])
def test_stages_keep_clashing_columns(spark, docs, clashing, labels, items, tmp_path, name):
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    items.write.parquet(str(tmp_path / "benchmark.parquet"))
    stage = dict(corpus_pipeline.STAGES)[name]
    plain, wide = stage(spark, docs, str(tmp_path)), stage(spark, clashing, str(tmp_path))
    if name == "packing":
        assert wide.columns == plain.columns and n(wide) == n(plain)
    else:
        assert wide.columns == clashing.columns and {r[c] for r in wide.collect() for c in CLASH} == {"z"}
        assert sorted(map(str, wide.select(docs.columns).collect())) == sorted(map(str, plain.collect()))


def test_stages_take_effect_on_repeated_rows(spark, docs, labels, items, tmp_path):
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    items.write.parquet(str(tmp_path / "benchmark.parquet"))
    stage = dict(corpus_pipeline.STAGES)
    ids = lambda name: sorted(str(r["doc_id"]) for r in stage[name](spark, docs, str(tmp_path)).collect())
    every = sorted(str(r[0]) for r in ROWS)
    assert ids("near_dedup") == [i for i in every if i != "7"] and ids("decontamination") == [i for i in every if i not in ("6", "7")] and ids("line_dedup") == every
    by = [(r["doc_id"], r["text"], r["n_chars"]) for r in stage["line_dedup"](spark, docs, str(tmp_path)).collect()]
    assert len({x for x in by if x[0] == 7}) == 1 and all(t is None or k == len(t) for _, t, k in by if k is not None) and (2, None, None) in by
