"""Each operator's method against brute force, an exact round trip or held-out accuracy."""

from __future__ import annotations

import itertools
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.conftest import SF
from tidewright.llm import ann, decontam, html_text, langid, linededup, neardup, packing, quality, toxicity, warc
from tidewright.llm import queries as registered


def test_all_ten_are_registered():
    names = list(registered.queries())
    assert [int(re.match(r"op(\d+)_", x)[1]) for x in names] == list(range(1, 11))


# ---- packing ----


def bins_of(plan):
    bins, seen = {}, {}
    for length, lo, hi, seq, width, off in zip(*plan.values(), strict=True):
        for r in range(lo, hi):
            bins.setdefault(seq + (r - lo) % width, []).append((off + (r - lo) // width * length, length))
            seen[length] = seen.get(length, 0) + 1
    return bins, seen


@settings(max_examples=150)
@given(st.integers(3, 40).flatmap(lambda c: st.tuples(st.just(c), st.lists(st.integers(1, c), min_size=1, max_size=60))))
def test_plans_place_all_without_gaps(case):
    capacity, lengths = case
    h = {x: lengths.count(x) for x in set(lengths)}
    bins, seen = bins_of(packing.plan(h, capacity))
    assert seen == h
    for b in bins.values():
        at = 0
        for off, length in sorted(b):
            assert off == at
            at += length
        assert at <= capacity


def fewest(lengths, capacity):
    """The least number of bins, by search."""
    best = len(lengths)
    lengths = sorted(lengths, reverse=True)

    def place(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(lengths):
            best = len(rooms)
            return
        for k in {r: j for j, r in enumerate(rooms)}.values():
            if rooms[k] >= lengths[i]:
                rooms[k] -= lengths[i]
                place(i + 1, rooms)
                rooms[k] += lengths[i]
        place(i + 1, [*rooms, capacity - lengths[i]])

    place(0, [])
    return best


def test_reduction_keeps_an_optimum():
    rng = random.Random(4)
    for _ in range(150):
        capacity = rng.randint(6, 16)
        lengths = [rng.randint(1, capacity) for _ in range(rng.randint(2, 9))]
        counts = np.bincount(lengths, minlength=capacity + 1)
        fixed = packing.reduce_by_dominance(counts)
        rest = [x for x in range(capacity + 1) for _ in range(counts[x])]
        assert sum(c for _, c in fixed) + (fewest(rest, capacity) if rest else 0) == fewest(lengths, capacity)


def test_op1_is_the_tokenizer_and_near_the_bound(spark):
    import zlib

    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = packing.op1_best_fit_packing(spark, SF).toPandas()
    at = {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got.itertuples()}
    seen = 0
    for d in spark.read.parquet(f"{SF}/documents.parquet").collect():
        ids = np.array([*t.encode(d["text"] or "", add_special_tokens=False).ids, 0], "<u4")
        for i in range(0, len(ids), 2048):
            part = ids[i : i + 2048]
            assert at[d["doc_id"], i // 2048] == (i, len(part), zlib.crc32(part.tobytes()))
            seen += 1
    assert seen == len(got) and got.sequence_id.nunique() <= -(-got.length.sum() // 2048) + 2
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert (g.offset.to_numpy() == np.concatenate(([0], g.length.cumsum().to_numpy()[:-1]))).all() and g.length.sum() <= 2048


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=5))
def test_cached_encoding_is_whole_encoding(texts):
    import public_tokenizers

    e = packing._encoder(public_tokenizers.path("word_bpe_49k.json"))
    assert e.encode(texts) == [np.array(x.ids, "<u4").tobytes() for x in e.tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_more_chunks_than_the_cache_holds(monkeypatch):
    import public_tokenizers

    monkeypatch.setattr(packing, "CACHE_ENTRIES", 8)
    e = packing.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    for texts in (["one two three four five"], [" ".join(f"word{i}" for i in range(20)) + " one two three"], ["one \u4e2d\u6587 six"]):
        assert e.encode(texts) == [np.array(x.ids, "<u4").tobytes() for x in e.tokenizer.encode_batch(texts, add_special_tokens=False)]


# ---- neighbours ----


def test_op2_recall_and_scores(spark):
    got = ann.op2_robust_pruned_graph(spark, SF).toPandas()
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()
    x, ids = np.array([r["embedding"] for r in rows], float), np.array([r["vec_id"] for r in rows])
    hits = total = 0
    for q, g in got.groupby("query_id"):
        g = g.sort_values("rank")
        s = x @ x[ids == q][0]
        s[ids == q] = -np.inf
        best = ids[np.lexsort((ids, -s))[:20]]
        hits += len(set(best) & set(g.vec_id))
        total += 20
        assert list(g["rank"]) == list(range(1, 21)) and np.allclose([s[ids == v][0] for v in g.vec_id], g.score, rtol=0, atol=1e-12)
        assert list(zip(-g.score, g.vec_id, strict=True)) == sorted(zip(-g.score, g.vec_id, strict=True))
    assert set(got.query_id) == {i for i in ids if i % 20 == 0} and hits / total >= 0.9


def test_many_shards_and_equal_vectors(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, 8)).astype(np.float32)
    x[100:300] = x[100]
    v = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "vec_id long, embedding array<float>")
    got = ann.nearest(v, v.where("vec_id % 50 = 0"), 20, shard_vectors=120).toPandas()
    hits = 0
    for q in range(0, 600, 50):
        s = x.astype(float) @ x[q].astype(float)
        s[q] = -np.inf
        hits += len(set(np.lexsort((np.arange(600), -s))[:20]) & set(got[got.query_id == q].vec_id))
    assert hits / 240 >= 0.9


# ---- pages ----


def longest(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, j in itertools.product(range(len(a)), range(len(b))):
        t[i + 1][j + 1] = t[i][j] + 1 if a[i] == b[j] else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


@settings(max_examples=300)
@given(st.lists(st.integers(0, 4), max_size=14), st.lists(st.integers(0, 4), max_size=14))
def test_common_lines_are_a_longest_subsequence(a, b):
    c = html_text.common(a, b)
    assert len(c) == longest(a, b) and all(a[i] == b[j] for i, j in c) and all(x[0] < y[0] and x[1] < y[1] for x, y in itertools.pairwise(c))


def test_neighbours_lines_go_where_no_article_is(spark):
    page = lambda i: f"<html><body><div>Site name</div><div>Own story {i} &amp; more<br>text</div><div class='x'>All rights</div><p>Second {i}</p></body></html>"
    rows = [(i, f"http://h{i % 2}.example/p/{i:03d}", page(i)) for i in range(60)]
    got = html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)).collect()
    assert {r["page_id"]: r["text"] for r in got} == {i: f"Own story {i} & more text\n\nSecond {i}" for i in range(60)}


def test_chrome_is_no_line():
    inner, outer = html_text.lines(
        "<head><title>t</title></head><nav>menu<ul><li>x</li></ul></nav><header>top</header><!-- c --><script>var a='</p>'</script><article><h1>A&nbsp;B</h1><p>one <b>tw</b>o<p>three"
        "<aside>side</aside><div class='comments'>rude<div>ruder</div></div><form>f</form></article><div class='ad'>buy</div><footer>f</footer><div role=navigation>n</div><p>left</p>"
    )
    assert inner == ["A B", "one two", "three"] and outer == ["left"]


def test_op3_articles_whole(spark):
    got = html_text.op3_nearest_url_differencing(spark, SF).collect()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    whole = 0
    for r in got:
        assert r["n_chars"] == len(r["text"])
        doc = docs.get(int(re.search(r"/(\d+)(?:\.html)?/?(?:[?#].*)?$", r["url"])[1]))
        lines = [" ".join(x.split()) for x in (doc or "").split("\n") if x.strip()]
        whole += r["text"].split("\n\n")[1:] == lines
    assert whole >= 0.9 * len(got)


# ---- learned models ----


def held(df, labels, column):
    got = {r["doc_id"]: r for r in df.collect()}
    return [(r[column], got[r["doc_id"]]) for r in labels.collect() if got[r["doc_id"]]["held_out"]]


def test_op4_language_of_rows_held_out(spark):
    sf = "/root/testdata/sf0.01"
    pairs = held(langid.op4_language_id(spark, sf), spark.read.parquet(f"{sf}/documents.parquet"), "lang")
    assert len(pairs) > 100 and sum(y == r["lang_pred"] for y, r in pairs) / len(pairs) >= 0.95


def test_op6_quality_of_rows_held_out(spark):
    sf = "/root/testdata/sf0.01"
    pairs = held(quality.op6_quality_subword_embeddings(spark, sf), spark.read.parquet(f"{sf}/labels.parquet"), "quality")
    assert sum(y == r["predicted"] for y, r in pairs) / len(pairs) >= 0.9


def test_op7_toxicity_of_rows_held_out(spark):
    sf = "/root/testdata/sf0.01"
    pairs = held(toxicity.op7_toxicity_grammar(spark, sf), spark.read.parquet(f"{sf}/labels.parquet"), "toxic")
    assert sum(y == r["predicted"] for y, r in pairs) / len(pairs) >= 0.9 and sum(r["predicted"] and not y for y, r in pairs) <= 1


def test_grammar_weighs_clauses():
    g, t = toxicity.grammar(), toxicity
    w = lambda *s: g.weight(list(s))
    assert w(t.INSULT) == 1 and w(t.TARGET, t.INSULT) == 1.25 == w(t.INSULT, t.OTHER, t.TARGET) and w(t.INSULT, t.INSULT) == 1.5
    assert w(t.NEGATION, t.INSULT) < w(t.REPORT, t.INSULT) < w(t.INSULT) and w(t.THREAT) == 0 < w(t.THREAT, t.TARGET)
    assert w(t.NEGATION, t.OTHER, t.OTHER, t.OTHER, t.INSULT) == 1 and w() == 0


@settings(max_examples=200)
@given(st.lists(st.integers(0, 5), max_size=8))
def test_composition_is_one_machine_after_the_other(symbols):
    parts = [toxicity.negation(), toxicity.reported(), toxicity.insults(), toxicity.threats(), toxicity.targets()]
    total = 0.0
    states = [p.start for p in parts]
    for s in symbols:
        for i, p in enumerate(parts):
            states[i], s, v = p.step(states[i], s)
            total += v
    assert abs(toxicity.grammar().weight(symbols) - total) < 1e-9


def test_lexicon_learns_words_and_stems():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeghi") for _ in range(5))
    toxic = [" ".join(word() for _ in range(30)) + f" zorkel{word()} " + "snarg" for _ in range(60)]
    clean = [" ".join(word() for _ in range(30)) for _ in range(300)]
    m = toxicity.Matcher(toxicity.learn_lexicon(toxic, clean))
    assert [i for i, *_ in m.clauses(["a zorkelish thing", "Snarg!", "nothing here", "snow"])] == [0, 1]


# ---- lines ----


@settings(max_examples=300)
@given(st.lists(st.sampled_from(["a b", "c", "", "w " * 60, "zz zz", "é"]), max_size=12), st.integers(0, 5))
def test_chunks_go_as_whole_lines(lines, keep):
    text = "\n".join(lines).encode()
    spans = [c for i, c in enumerate(linededup.chunks(text)) if i != keep]
    left, at = [], 0
    for line in text.split(b"\n"):
        if not any(o <= at and at + len(line) <= o + n for o, n in spans):
            left.append(line)
        at += len(line) + 1
    assert linededup.without(text, spans) == b"\n".join(left)


def test_boundaries_resist_shifts():
    rng = random.Random(1)
    lines = [f"line {rng.random()}" for _ in range(300)]
    parts = lambda ls: {b[o : o + n] for b in ["\n".join(ls).encode()] for o, n in linededup.chunks(b)}
    a, b = parts(lines), parts(["new one", *lines])
    assert len(a & b) >= len(a) - 2


def test_op5_is_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    seen, gone = {}, {}
    for r in sorted(rows, key=lambda r: r["doc_id"]):
        b = (r["text"] or "").encode()
        for off, size in linededup.chunks(b):
            if seen.setdefault(b[off : off + size], (r["doc_id"], off)) != (r["doc_id"], off):
                gone.setdefault(r["doc_id"], []).append((off, size))
    want = {r["doc_id"]: linededup.without((r["text"] or "").encode(), gone.get(r["doc_id"], [])).decode() for r in rows}
    got = linededup.op5_line_dedup(spark, SF).collect()
    assert {r["doc_id"]: r["text"] or "" for r in got} == want and sum(r["removed_chunks"] for r in got) == sum(map(len, gone.values())) > 0


def test_shared_paragraphs_are_caught(spark):
    rng = random.Random(8)
    words = lambda k: " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(k))
    passage = words(70)
    rows = [(i, "\n".join([words(20), *([passage] if i % 3 == 0 else []), words(15)])) for i in range(30)]
    got = {r["doc_id"]: r["text"] for r in linededup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [i for i, t in got.items() if passage in t] == [0] and all(got[i] == t for i, t in rows if i % 3)


# ---- benchmark ----


def least_distance(p, t):
    row = [0] * (len(t) + 1)
    for i, c in enumerate(p, 1):
        new = [i]
        for j, d in enumerate(t, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


@settings(max_examples=300)
@given(st.text("abc", min_size=1, max_size=80), st.text("abcd", max_size=90), st.integers(0, 9))
def test_myers_is_dynamic_programming(p, t, k):
    d, m = least_distance(p, t), decontam.myers(p, t, k)
    if t and d < len(p):
        assert (m[0] if m else None) == (d if d <= k else None)


def test_op8_is_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    items = [(r["item_id"], decontam.normal(r["text"])) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    whole = {(d["doc_id"], i) for d in docs for i, p in items if p in decontam.normal(d["text"] or "")}
    got = {(r["doc_id"], r["item_id"]) for r in decontam.op8_pigeonhole_decontamination(spark, SF).collect()}
    assert whole and whole <= got


def test_edited_items_are_found_up_to_the_budget(spark):
    rng = random.Random(6)
    text = lambda k: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(k))
    item = text(30)
    k = decontam.budget(decontam.normal(item))
    rows = []
    for edits in range(0, 3 * k):
        s = list(item)
        for at in rng.sample(range(len(s)), edits):
            s[at] = "Z"
        rows.append((edits, text(40) + " " + "".join(s) + "\n" + text(40)))
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string")
    want = {i: d for i, t in rows if (d := least_distance(decontam.normal(item), decontam.normal(t))) <= k}
    for block in (1, 100):
        assert {r["doc_id"]: r["distance"] for r in decontam.leaks(docs, bench.union(spark.createDataFrame([(2, text(20))], bench.schema)), block).collect() if r["item_id"] == 1} == want


def test_blank_items_end_no_block(spark):
    items = ["the first item stands here unchanged", " \n", "a second item that stands in a text", "", "\t", "and a third item behind all blank ones"]
    docs = spark.createDataFrame([(i, f"before {t} after") for i, t in enumerate(items) if t.strip()], "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string").coalesce(1)
    for block in (1, 2, 3, 6, 100):
        assert {(r["doc_id"], r["item_id"]) for r in decontam.leaks(docs, bench, block).collect()} == {(0, 0), (2, 2), (5, 5)}
    assert decontam.leaks(docs, bench.where("trim(text) = ''")).count() == 0


# ---- near duplicates ----


def brute_components(rows, k):
    sets = {}
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[d] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())
    parent = {d: d for d in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= 80 * len(x | y):
            p, q = sorted((top(a), top(b)))
            parent[q] = p
    return {d: (len(sets[d]), top(d)) for d in sets}


def test_op9_is_brute_force(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.op9_minhash_near_dedup(spark, SF).collect()}
    assert got == brute_components(rows, 2)


@pytest.mark.parametrize("k", [2, 5])
def test_chains_of_near_copies(spark, k):
    """Drifting copies: each is like the next, the ends are not alike; short sets and many that share one line."""
    rng = random.Random(k)
    words = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(60):
        words[rng.randrange(len(words))] = f"x{i}"
        rows.append((i, " ".join(words)))
    common = "the line that stands in very many of the short texts here"
    rows += [(100 + i, f"{common} " + " ".join(f"u{rng.randint(0, 60)}" for _ in range(rng.randint(1, 4)))) for i in range(60)]
    rows += [(200 + i, " ".join(rng.choice("abc") for _ in range(rng.randint(1, 4)))) for i in range(40)]
    rng.shuffle(rows)
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_components(rows, k)


@pytest.mark.parametrize("block", [256, 64])
def test_links_in_buckets_of_many_components(spark, monkeypatch, block):
    """Variants of one text share buckets and are not alike, but for a few pairs that no centre is like."""
    monkeypatch.setattr(neardup, "BLOCK", block)
    rng = random.Random(3)
    rows, want = [], {}
    for g in range(5):
        base, group = [f"w{g}x{i}" for i in range(100)], []
        for d in range(400 * g, 400 * g + 400):
            own = base[:70] + [f"p{d}x{j}" for j in range(18)] + base[70:] if d % 400 < 398 else base[:]
            if d % 400 >= 398:
                for j in rng.sample(range(1, 99), 2):
                    own[j] = f"d{d}x{j}"
            group.append((d, " ".join(own)))
        want |= brute_components(group, 2)
        rows += group
    rng.shuffle(rows)
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()
    assert sum(c != d for d, (_, c) in want.items()) == 5
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want


# ---- archive ----


def test_records_come_back_byte_for_byte(spark, tmp_path):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    both = pages.unionByName(pages.selectExpr("page_id + 100000 as page_id", "url", "html"))
    warc.write_archive(both, str(tmp_path / "w"))
    got = {r["page_id"]: r for r in warc.read_archive(spark, str(tmp_path / "w")).collect()}
    for p in both.collect():
        r = got[p["page_id"]]
        head, body = bytes(r["record"]).split(b"\r\n\r\n", 1)
        first = p["page_id"] < 100000
        assert r["verified"] and r["kind"] == ("response" if first else "revisit") and body == (p["html"].encode() if first else b"") + b"\r\n\r\n"
        assert f"WARC-Target-URI: {p['url']}".encode() in head and f"Content-Length: {len(p['html'].encode()) if first else 0}".encode() in head
    stored = spark.read.parquet(str(tmp_path / "w/payloads"))
    assert stored.count() == pages.select("html").distinct().count()


def test_op10_same_as_sql(same_as_sql):
    same_as_sql(registered.queries()["op10_warc_content_addressed"], registered.oracle_sql()["op10_warc_content_addressed"])
