"""Main text of web pages by nearest-URL page differencing.

Pages of one host stand in the order of their URL paths, and each is aligned
with its nearest neighbours on both sides, with all of its lines: those in a
longest common subsequence are the site's own. A line goes if the nearest
neighbour of either side has it too; a line inside an article or main element,
which may be a passage that some pages quote, goes once three quarters of the
neighbours, and three at least, have it. A neighbour with the same lines of content is a copy and tells nothing.

What differencing leaves of elements that are menus, headers, footers, notices,
adverts, forms, scripts or reader comments by name, role, class or id goes too:
a page alone on its host, or an advert shown once, has no neighbour to tell.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewright.llm.common import load, sliced, stored

# Element names of HTML and usual class names.
RAW = frozenset("script style template noscript textarea iframe svg math title select button object canvas audio video".split())
CHROME = frozenset("nav footer aside form menu dialog head".split())
CHROME_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
CHROME_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion sidebar nav navbar navigation menu footer masthead breadcrumb breadcrumbs "
    "cookie cookies consent gdpr notice notices banner popup modal newsletter subscribe subscription comment comments disqus share sharing social related login signup".split()
)
CONTENT = frozenset("article main".split())
BLOCKS = frozenset(
    "address article blockquote body center dd details div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 header hgroup hr html li main ol p pre section summary table tbody tfoot thead tr ul caption".split()
)
BARE, INNER, MARKED = range(3)
#: Neighbours on each side that a page is aligned with.
NEIGHBOURS = 4
#: Places among all pages that one task of seams has.
SEAM_BLOCK = 256
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())

TAG = re.compile(r"<(?:!--|([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|/([a-zA-Z][^\s/>]*)[^>]*>|[!?][^>]*>)")
NAMED = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
SPACE = re.compile(r"\s+")
WORDS = re.compile(r"[a-z]+")


def is_chrome(name: str, attributes: str, inside_content: bool) -> bool:
    if name in CHROME or name == "header" and not inside_content:
        return True
    if attributes and "=" in attributes:
        for kind, a, b, c in NAMED.findall(attributes):
            words = WORDS.findall((a or b or c).lower())
            if kind.lower() == "role" and any(w in CHROME_ROLES for w in words) or kind.lower() != "role" and name not in ("body", "html", "article", "main") and any(w in CHROME_WORDS for w in words):
                return True
    return False


def marked_lines(page: str) -> list[tuple[str, int]]:
    """The page's lines in order and where each stands: BARE, INNER (inside article or main) or MARKED (inside an element that is chrome by name)."""
    out: list[tuple[str, int]] = []
    buffer: list[str] = []
    content = 0
    skip, depth = "", 0

    def flush() -> None:
        if buffer:
            text = SPACE.sub(" ", html.unescape("".join(buffer))).strip()
            buffer.clear()
            if text:
                out.append((text, MARKED if skip else INNER if content else BARE))

    at, n = 0, len(page)
    while at < n:
        m = TAG.search(page, at)
        if not m:
            buffer.append(page[at:])
            break
        if m.start() > at:
            buffer.append(page[at : m.start()])
        at = m.end()
        if m[0] == "<!--":
            end = page.find("-->", at)
            at = n if end < 0 else end + 3
            continue
        opened, closed = (m[1] or "").lower(), (m[3] or "").lower()
        if opened in RAW:
            close = re.compile(rf"</{re.escape(opened)}\b[^>]*>", re.I).search(page, at)
            at = close.end() if close else n
            continue
        name = opened or closed
        if name in BLOCKS or name == "hr":
            flush()
        elif name in ("br", "td", "th"):
            buffer.append(" ")
        if skip:
            if opened == skip and not m[2].endswith("/"):
                depth += 1
            elif closed == skip:
                depth -= 1
                if not depth:
                    flush()
                    skip = ""
            elif opened in CONTENT and not content:  # an element that was never closed hides no article
                flush()
                skip, depth, content = "", 0, 1
            elif closed in CONTENT and content and skip != closed:
                flush()
                skip, depth = "", 0
                content -= 1
            continue
        if opened and opened not in VOID:
            if is_chrome(opened, m[2], content > 0):
                flush()
                if not m[2].endswith("/"):
                    skip, depth = opened, 1
            elif opened in CONTENT:
                content += 1
        elif closed in CONTENT and content:
            content -= 1
    flush()
    return out


def lines(page: str) -> tuple[list[str], list[str]]:
    """The page's lines inside article or main elements, and those outside of any, without those that are chrome by name."""
    every = marked_lines(page)
    return [x for x, kind in every if kind == INNER], [x for x, kind in every if kind == BARE]


def common(a: list, b: list) -> list[tuple[int, int]]:
    """A longest common subsequence as pairs of indices: the longest rising run of matches (Hunt and Szymanski)."""
    head = 0
    while head < len(a) and head < len(b) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < len(a) - head and tail < len(b) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    places: dict = {}
    for j in range(head, len(b) - tail):
        places.setdefault(b[j], []).append(j)
    ends: list[int] = []
    links: list = []
    for i in range(head, len(a) - tail):
        for j in reversed(places.get(a[i], ())):
            k = bisect_left(ends, j)
            link = (i, j, links[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                links.append(link)
            else:
                ends[k], links[k] = j, link
    middle, link = [], links[-1] if links else None
    while link:
        middle.append(link[:2])
        link = link[2]
    end = [(len(a) - t, len(b) - t) for t in range(tail, 0, -1)]
    return [*((h, h) for h in range(head)), *reversed(middle), *end]


def _path(url):
    rest = F.regexp_replace(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*", "")
    return F.regexp_replace(rest, r"[?#].*$", "")


Page = tuple[int, str, list[int], list[int]]
PAIRED = "page_id long, distance int, same array<int>, place int, at int, host string, lines array<long>, kinds array<int>"
_PAIRED = pa.schema([("page_id", pa.int64()), ("distance", pa.int32()), ("same", pa.list_(pa.int32())), ("place", pa.int32()), ("at", pa.int32()), ("host", pa.string()), ("lines", pa.list_(pa.int64())), ("kinds", pa.list_(pa.int32()))])


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def compared(before: Page, after: Page, distance: int) -> list[tuple[int, int, list[int]]]:
    """page_id, distance (negative: the neighbour comes before) and the common lines of two pages of a host, or nothing if one is the other's copy."""
    content = [[x for x, kind in zip(p[2], p[3], strict=True) if kind != MARKED] for p in (before, after)]
    if content[0] == content[1]:
        return []
    both = common(before[2], after[2])
    return [(before[0], distance, [i for i, _ in both]), (after[0], -distance, [j for _, j in both])]


def decided(kinds: list[int], neighbours: list[tuple[int, list[int]]]) -> list[int]:
    """The lines that go, by the neighbours' distances and common lines."""
    seen: dict[int, int] = {}
    for _, same in neighbours:
        for i in same:
            seen[i] = seen.get(i, 0) + 1
    nearest = {max((d for d, _ in neighbours if d < 0), default=0), min((d for d, _ in neighbours if d > 0), default=0)}
    close = {i for d, same in neighbours if d in nearest for i in same}
    most = max(NEIGHBOURS - 1, -(-3 * len(neighbours) // 4))
    return sorted(i for i, n in seen.items() if (n >= most if kinds[i] == INNER else i in close or kinds[i] == MARKED))


def fingerprint(every: list[tuple[str, int]]) -> tuple[list[int], int]:
    """Hashes of lines (a line of chrome is never the same as one of content), and one of all of them."""
    hashes = [xxhash.xxh3_64_intdigest(x, seed=int(kind == MARKED)) - (1 << 63) for x, kind in every]
    return hashes, xxhash.xxh3_64_intdigest(repr(hashes)) - (1 << 63)


def _seams(ends: DataFrame) -> DataFrame:
    """Pairs of pages on both sides of partitions' ends: page_id, distance, same.

    ``ends`` has the first and last NEIGHBOURS pages of each partition. Their
    places among all pages are dealt in blocks, so no task has all of them.
    """
    sizes = ends.groupBy("place").agg((F.max("at") + 1).cast("long").alias("size"))
    before = F.sum("size").over(W.orderBy("place").rowsBetween(W.unboundedPreceding, -1))  # one row a partition
    placed = ends.join(sizes.select("place", F.coalesce(before, F.lit(0)).alias("begin")), "place").withColumn("g", F.col("begin") + F.col("at"))
    blocks = F.array_distinct(F.array(*(F.floor((F.col("g") + n) / SEAM_BLOCK) for n in (0, NEIGHBOURS))))
    seats = placed.select("page_id", "host", "lines", "kinds", "place", "g", F.explode(blocks).alias("block"))

    def check(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, out = pdf.sort_values("g"), []
        rows = [(p, h, list(x), list(k), at, g) for p, h, x, k, at, g in pdf[["page_id", "host", "lines", "kinds", "place", "g"]].itertuples(index=False)]
        for i, y in enumerate(rows):
            if y[5] // SEAM_BLOCK == pdf["block"].iloc[0]:
                for x in rows[max(i - NEIGHBOURS, 0) : i]:
                    if x[1] == y[1] and x[4] != y[4] and y[5] - x[5] <= NEIGHBOURS:
                        out += compared(x[:4], y[:4], int(y[5] - x[5]))
        return pd.DataFrame(out, columns=["page_id", "distance", "same"])

    return seats.groupBy("block").applyInPandas(check, "page_id long, distance int, same array<int>")


def shared_lines(pages: DataFrame) -> DataFrame:
    """page_id, mark (a hash of the page's lines), shared (numbers of the lines that differencing deletes) and content
    (those of them that are not chrome by name), for pages that have such lines.

    Line hashes are sorted by host and path over range partitions, so a host of a
    third of all pages is many partitions. Pages pass one by one, each against
    the few before it; those at the ends of partitions, a few rows each, meet
    those of the next ones in blocks. Of rows that repeat a page_id one counts.
    """

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("host", pa.string()), ("path", pa.string()), ("lines", pa.list_(pa.int64())), ("kinds", pa.list_(pa.int32())), ("mark", pa.int64())])
        for whole in batches:
            for batch in sliced(whole, "html"):
                rows = []
                for page, host, path, text in zip(*(batch.column(c).to_pylist() for c in ("page_id", "host", "path", "html")), strict=True):
                    every = marked_lines(text or "")
                    hashes, mark = fingerprint(every)
                    rows.append((page, host, path, hashes, [kind for _, kind in every], mark))
                yield _table(rows, schema)

    host = F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    named = pages.where("page_id is not null").select(F.col("page_id").cast("long"), F.coalesce(host, F.lit("")).alias("host"), F.coalesce(_path(F.col("url")), F.lit("")).alias("path"), "html")
    hashes = named.mapInArrow(hashed, "page_id long, host string, path string, lines array<long>, kinds array<int>, mark long")
    every = stored(hashes.dropDuplicates(["page_id"]), "page-lines")
    ranged = every.repartitionByRange("host", "path", "page_id").sortWithinPartitions("host", "path", "page_id")

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from collections import deque

        from pyspark import TaskContext

        place, at = TaskContext.get().partitionId(), 0
        back: deque[Page] = deque(maxlen=NEIGHBOURS)
        blank = (None,) * 5
        for batch in batches:
            out = []
            for here in zip(*(batch.column(c).to_pylist() for c in ("page_id", "host", "lines", "kinds")), strict=True):
                for d, other in enumerate(reversed(back), 1):
                    if other[1] == here[1]:
                        out += [(*row, *blank) for row in compared(other, here, d)]
                if at < NEIGHBOURS:
                    out.append((here[0], None, None, place, at, *here[1:]))
                back.append(here)
                at += 1
            yield _table(out, _PAIRED)
        # those of the last ones that were not among the first
        yield _table([(p[0], None, None, place, i, *p[1:]) for i, p in enumerate(back, at - len(back)) if i >= NEIGHBOURS], _PAIRED)

    paired = stored(ranged.mapInArrow(pair, PAIRED), "paired")
    seams = _seams(paired.where("place is not null").drop("distance", "same"))
    pairs = paired.where("distance is not null").select("page_id", "distance", "same").unionByName(seams)
    near = pairs.groupBy("page_id").agg(F.collect_list(F.struct("distance", "same")).alias("near"))

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("mark", pa.int64()), ("shared", pa.list_(pa.int32())), ("content", pa.list_(pa.int32()))])
        for batch in batches:
            rows = []
            for page, mark, kinds, neighbours in zip(*(batch.column(c).to_pylist() for c in ("page_id", "mark", "kinds", "near")), strict=True):
                if gone := decided(kinds, [(x["distance"], x["same"]) for x in neighbours]):
                    rows.append((page, mark, gone, [i for i in gone if kinds[i] != MARKED]))
            yield _table(rows, schema)

    return every.select("page_id", "mark", "kinds").join(near, "page_id").mapInArrow(decide, "page_id long, mark long, shared array<int>, content array<int>")


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page (page_id, url, html; further columns are ignored).

    Null or empty html gives an empty text; so does a page all of whose lines
    are its site's. A null url is a host of its own, shared by all such pages.
    Of rows that repeat a page_id one stands in the order of pages; the others
    are read like it if they have the same lines, else without neighbours, as
    rows without page_id are. No rows give no rows.
    """
    # lines of chrome go by name in any case: only pages that lose others need the table
    shared = stored(shared_lines(pages), "shared-lines").where("size(content) > 0").select("page_id", "mark", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in sliced(whole, "html"):
                texts = []
                for page, mark, content in zip(*(batch.column(c).to_pylist() for c in ("html", "mark", "content")), strict=True):
                    every = marked_lines(page or "")
                    gone = set(content) if content and fingerprint(every)[1] == mark else ()
                    texts.append("\n\n".join(x for i, (x, kind) in enumerate(every) if kind != MARKED and i not in gone))
                yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long"), "url", "html").join(shared, "page_id", "left")
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op3_nearest_url_differencing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every row of pages: page_id, url, text (empty if none, as for null html) and n_chars."""
    return main_text(load(spark, sf_dir, "pages", "page_id", "url", "html"))
