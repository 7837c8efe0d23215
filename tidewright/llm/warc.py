"""Content-addressed web archive.

Two tables make an archive. ``payloads`` holds every distinct payload once,
under its SHA-256 digest. ``headers`` holds, for every record, its exact header
block and the digest. A join of both gives the original records, byte for byte;
what a record says about itself is read from its header.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm.common import dropped, load, shared_dir, stored

#: Smaller payloads are stored as full records of their own, never as revisits.
MIN_REVISIT_BYTES = 100
CRLF = "\r\n"
#: Header fields of our own: the ids of the page and of the page that a revisit refers to.
PAGE, REFERS = "X-Page-ID", "X-Refers-To-Page-ID"


def _record_id(page_id):
    h = F.sha2(page_id.cast("string").cast("binary"), 256)
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def write_archive(pages: DataFrame, path: str, min_revisit_bytes: int = MIN_REVISIT_BYTES) -> None:
    """Archive ``pages`` (page_id, url, html; further columns are ignored) under ``path``.

    Null html is an empty payload and a null url an empty target. Of records
    with equal payloads of at least ``min_revisit_bytes`` the one with the
    smallest page_id is the response; the rest are revisits that refer to it.
    Repeated rows of one page_id give repeated records: one of them is the response
    and the payload is stored once. Rows with a null page_id become responses of
    their own. Empty tables give empty archives.

    Only (digest, page_id) pass through the shuffle that chooses responses,
    with partial minima first. Texts are read once for digests and once more for
    the payloads; those whose digest has a smaller page_id are left out by a
    table of their ids, so bytes are shuffled only where those are many.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long"), F.coalesce(F.col("url"), F.lit("")).alias("url"), payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    small = stored(rows.select("page_id", "url", "digest", F.octet_length("payload").cast("long").alias("n")), "digests")
    first = small.groupBy(F.col("digest").alias("d")).agg(F.min("page_id").alias("first_id"))
    placed = small.join(first, F.col("digest") == F.col("d"), "left").drop("d")
    later = F.coalesce(F.col("page_id") > F.col("first_id"), F.lit(False))
    kind = F.when((F.col("n") >= min_revisit_bytes) & later, F.lit("revisit")).otherwise(F.lit("response"))
    placed = placed.withColumn("kind", kind)
    line = lambda name, value: F.coalesce(F.concat(F.lit(f"{CRLF}{name}: "), value), F.lit(""))
    revisit = F.col("kind") == "revisit"
    header = F.concat(
        F.lit("WARC/1.1" + CRLF + "WARC-Type: "), "kind", line("WARC-Record-ID", F.coalesce(_record_id(F.col("page_id")), F.lit("<urn:uuid:none>"))),
        line(PAGE, F.col("page_id").cast("string")), line("WARC-Target-URI", F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))), line("WARC-Date", F.lit("1970-01-01T00:00:00Z")), line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "digest")),
        line("WARC-Refers-To", F.when(revisit, _record_id(F.col("first_id")))), line(REFERS, F.when(revisit, F.col("first_id").cast("string"))),
        line("WARC-Profile", F.when(revisit, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))), line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("n").cast("string"))), F.lit(CRLF + CRLF),
    )
    placed.select("digest", header.cast("binary").alias("header")).write.parquet(f"{path}/headers")
    other = F.col("page_id").isNull() & F.col("first_id").isNotNull()
    gone = stored(placed.where(later | other).select(F.col("page_id").alias("p"), F.col("digest").alias("d")), "later", 2)
    bring = rows.select("page_id", "digest", "payload").join(gone, F.col("page_id").eqNullSafe(F.col("p")) & (F.col("digest") == F.col("d")), "left_anti")
    bring = bring.select("digest", "payload")
    (bring.dropDuplicates(["digest"]) if _repeats(small) else bring).write.parquet(f"{path}/payloads")
    dropped(small)
    dropped(gone)


def _repeats(small: DataFrame) -> bool:
    """Whether some page_id, null or not, stands in more than one row."""
    return bool(small.groupBy("page_id").count().where("count > 1").limit(1).collect())


def read_archive(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """The archive's records: page_id, kind, refers_to, digest, payload_bytes, found, verified and,
    if asked for, ``header`` and ``record``: the original bytes of header, payload and end mark.

    page_id, kind, refers_to and digest are what the header says. payload_bytes
    and found, its digest, are taken from the payload bytes read back, of a
    revisit from those of the record that it refers to. A payload that is missing
    or has another digest gives verified = false. Without ``payload`` only
    lengths and digests pass through the join.
    """
    headers = spark.read.parquet(f"{path}/headers")
    bodies = spark.read.parquet(f"{path}/payloads").select(
        F.col("digest").alias("d"), F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("found"), *(["payload"] if payload else [])
    )
    out = headers.join(bodies, F.col("digest") == F.col("d"), "left")
    text = F.decode("header", "UTF-8")
    said = lambda name, what: F.nullif(F.regexp_extract(text, rf"(?m)^{name}: {what}", 1), F.lit(""))
    digest = said("WARC-Payload-Digest", "sha256:([0-9a-f]{64})")
    columns = [said(PAGE, r"(-?\d+)").cast("long").alias("page_id"), said("WARC-Type", r"(\w+)").alias("kind"), said(REFERS, r"(-?\d+)").cast("long").alias("refers_to"), digest.alias("digest"), "payload_bytes", "found"]
    columns.append(F.coalesce(F.col("found") == digest, F.lit(False)).alias("verified"))
    if payload:
        body = F.when(said("WARC-Type", r"(\w+)") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
        columns += ["header", F.concat("header", body, F.lit(b"\r\n\r\n")).alias("record")]
    return out.select(*columns)


def op10_warc_content_addressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of a record for every row of pages, archived and read back.

    Every record is rebuilt; length and digest are those of the payload inside
    it, of a revisit those of the payload it refers to. Null if that is not the
    payload of the header's digest.
    """
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archive(load(spark, sf_dir, "pages", "page_id", "url", "html"), path)
    records = read_archive(spark, path)
    own = F.octet_length("record") - F.octet_length("header") - 4
    inside = F.substring(F.col("record"), F.octet_length("header") + 1, own)
    whole = F.col("kind") == "response"
    n = F.when(whole, own.cast("long")).otherwise(F.col("payload_bytes"))
    digest = F.when(whole, F.sha2(inside, 256)).otherwise(F.col("found"))
    right = digest == F.col("digest")
    return records.select("page_id", F.when(right, n).alias("payload_bytes"), F.when(right, digest).alias("payload_digest"), F.col("kind").alias("record_type"), "refers_to")


OP10_SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (SELECT payload_digest, min(page_id) AS first_id FROM p GROUP BY 1)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id > first_id THEN first_id END AS refers_to
FROM p JOIN f USING (payload_digest)
"""
