"""Queries over state streams, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.functions import codec, udfs
from tidewright.functions import expressions as X
from tidewright.operators import diff, metrics, select, streams

QUERIES: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = (f, sql)
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.profile_states(table(spark, sf_dir, "events"))


def vlen(x: str) -> str:
    """SQL of an unsigned number's varint length."""
    return "CASE " + " ".join(f"WHEN {x} < {1 << 7 * n} THEN {n}" for n in range(1, 9)) + " ELSE 9 END"


def slen(x: str) -> str:
    return vlen(f"(CASE WHEN ({x}) >= 0 THEN ({x}) * 2 ELSE -({x}) * 2 - 1 END)")


def tlen(x: str) -> str:
    return f"({vlen(f'strlen({x})')} + strlen({x}))"


PROFILE_SQL = (
    "profile AS (SELECT user_id AS stream_id, CAST(row_number() OVER o AS BIGINT) AS seq, CAST(sum(CAST(round(coalesce(value, 0) * 100) AS BIGINT)) OVER w AS BIGINT) AS cents, "
    + ", ".join(f"count(*) FILTER (WHERE event_type = '{t}') OVER w AS {t}" for t in streams.EVENT_TYPES)
    + r""", count(*) OVER w AS events, last_value(CAST(nullif(regexp_extract(props, '"k":\s*(-?[0-9]+)', 1), '') AS BIGINT) IGNORE NULLS) OVER w AS last_k, last_value(event_type IGNORE NULLS) OVER w AS last_type
 FROM events WINDOW o AS (PARTITION BY user_id ORDER BY event_id), w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING))"""
)


def _json(f: str) -> str:
    return f"""coalesce('"' || {f} || '"', 'null')""" if f == "last_type" else f"coalesce(CAST({f} AS VARCHAR), 'null')"


STATE_SQL = "'{' || " + " || ',' || ".join(f"""'"{f}":' || {_json(f)}""" for f in streams.PROFILE) + " || '}'"
DELTA_SQL = (
    """CASE WHEN seq > 1 THEN '{"changed":{' || concat_ws(',', """
    + ", ".join(f"""CASE WHEN {f} IS DISTINCT FROM p_{f} THEN '"{f}":' || {_json(f)} END""" for f in streams.PROFILE)
    + """) || '},"removed":[]}' END"""
)
TEXT_SQL = (
    PROFILE_SQL
    + ", prev AS (SELECT *, "
    + ", ".join(f"lag({f}) OVER (PARTITION BY stream_id ORDER BY seq) AS p_{f}" for f in streams.PROFILE)
    + f" FROM profile), texts AS (SELECT stream_id, seq, {STATE_SQL} AS state, {DELTA_SQL} AS delta FROM prev)"
)
CHOICE_SQL = (
    TEXT_SQL
    + """, sized AS (SELECT stream_id, seq, state, strlen(state) AS state_bytes, 46 + strlen(state) AS snapshot_bytes, 46 + strlen(delta) AS delta_bytes FROM texts),
 choice AS (SELECT *, CASE WHEN delta_bytes IS NOT NULL AND delta_bytes / CAST(snapshot_bytes AS DOUBLE) <= 0.98 AND delta_bytes + 1 <= snapshot_bytes AND delta_bytes < snapshot_bytes THEN 'delta' ELSE 'snapshot' END AS mode FROM sized),
 chosen AS (SELECT *, CASE WHEN mode = 'delta' THEN delta_bytes ELSE snapshot_bytes END AS selected_bytes FROM choice)"""
)


@query(
    "adaptive_sync_report",
    f"""WITH {CHOICE_SQL} SELECT stream_id, count(*) AS packets, count(*) FILTER (WHERE mode = 'snapshot') AS snapshots, count(*) FILTER (WHERE mode = 'delta') AS deltas, CAST(0 AS BIGINT) AS compressed,
 CAST(sum(state_bytes) AS BIGINT) AS input_bytes, CAST(sum(selected_bytes) AS BIGINT) AS output_bytes, round(sum(selected_bytes) / CAST(sum(state_bytes) AS DOUBLE), 6) AS ratio,
 round((1.0 - sum(selected_bytes) / CAST(sum(state_bytes) AS DOUBLE)) * 100, 4) AS saving_percent FROM chosen GROUP BY stream_id""",
)
def adaptive_sync_report(spark, sf_dir):
    return metrics.encoder_metrics(select.four_way(profiles(spark, sf_dir)), "stream_id")


@query("four_way_decisions", f"WITH {CHOICE_SQL} SELECT stream_id, seq, CAST(state_bytes AS BIGINT) AS state_bytes, CAST(snapshot_bytes AS BIGINT) AS snapshot_bytes, CAST(delta_bytes AS BIGINT) AS delta_bytes, mode, CAST(selected_bytes AS BIGINT) AS selected_bytes FROM chosen")
def four_way_decisions(spark, sf_dir):
    return select.four_way(profiles(spark, sf_dir))


@query("initial_select", f"WITH {TEXT_SQL} SELECT stream_id, 'snapshot' AS mode, CAST(46 + strlen(state) AS BIGINT) AS selected_bytes FROM texts WHERE seq = 1")
def initial_select(spark, sf_dir):
    """The first update of every stream has a snapshot alone to choose."""
    return select.four_way(profiles(spark, sf_dir)).where("seq = 1").select("stream_id", "mode", "selected_bytes")


@query(
    "traffic_metrics",
    f"""WITH {CHOICE_SQL} SELECT count(*) AS updates, CAST(sum(state_bytes) AS BIGINT) AS full_bytes, CAST(sum(selected_bytes) AS BIGINT) AS wire_bytes, CAST(sum(greatest(state_bytes - selected_bytes, 0)) AS BIGINT) AS bytes_avoided,
 count(*) FILTER (WHERE mode = 'snapshot') AS snapshot_packets, count(*) FILTER (WHERE mode = 'delta') AS delta_packets, round((1.0 - sum(selected_bytes) / CAST(sum(state_bytes) AS DOUBLE)) * 100, 4) AS reduction_percent FROM chosen""",
)
def traffic_metrics(spark, sf_dir):
    return metrics.traffic(select.four_way(profiles(spark, sf_dir)))


@query("mode_histogram", f"WITH {CHOICE_SQL} SELECT mode, count(*) AS packets, CAST(sum(selected_bytes) AS BIGINT) AS bytes FROM chosen GROUP BY mode")
def mode_histogram(spark, sf_dir):
    return metrics.mode_histogram(select.four_way(profiles(spark, sf_dir)))


@query("four_way_compressed")
def four_way_compressed(spark, sf_dir):
    """The choice among all four packets, compressed ones too: lengths depend on the zstd build, so there is no SQL."""
    return select.four_way(profiles(spark, sf_dir), select.Policy(zstd=True))


@query("json_snapshots", f"WITH {TEXT_SQL} SELECT stream_id, seq, state, CAST(46 + strlen(state) AS BIGINT) AS encoded_len FROM texts")
def json_snapshots(spark, sf_dir):
    return streams.with_text(profiles(spark, sf_dir)).select("stream_id", "seq", "state", X.encoded_len(X.octets(F.col("state"))).cast("long").alias("encoded_len"))


@query("json_field_deltas", f"WITH {TEXT_SQL} SELECT stream_id, seq, delta, CAST(strlen(delta) AS BIGINT) AS delta_len FROM texts")
def json_field_deltas(spark, sf_dir):
    return diff.json_deltas(profiles(spark, sf_dir)).select("stream_id", "seq", "delta", F.octet_length("delta").cast("long").alias("delta_len"))


@query(
    "json_map_apply",
    f"""WITH {PROFILE_SQL}, m AS (SELECT * FROM profile)
 SELECT stream_id, seq, CAST(len(list_filter([cents, click, error, events, last_k, purchase, signup, view], lambda x: x <> 0)) AS BIGINT) AS entries FROM m""",
)
def json_map_apply(spark, sf_dir):
    """Zero fields are left out of the map, so keys come and go; each state is the one before with its delta applied."""
    names = [f for f in streams.PROFILE if f != "last_type"]
    entries = F.array(*(F.struct(F.lit(f).alias("key"), F.col(f).cast("string").alias("value")) for f in names))
    maps = profiles(spark, sf_dir).select("stream_id", "seq", F.map_from_entries(F.filter(entries, lambda e: e["value"] != "0")).alias("state"))
    both = streams.with_previous(maps).withColumn("base", F.coalesce("prev_state", F.map_filter("state", lambda k, v: F.lit(False))))
    changed, removed = diff.map_delta(F.col("base"), F.col("state"))
    again = both.withColumn("again", diff.map_apply(F.col("base"), changed, removed))
    same = F.array_sort(F.map_entries("again")) == F.array_sort(F.map_entries("state"))
    return again.where(same).select("stream_id", "seq", F.size("again").cast("long").alias("entries"))


RECORDS_SQL = """records AS (SELECT o_custkey AS stream_id, CAST(row_number() OVER w AS BIGINT) AS seq, o_orderstatus AS status, o_orderpriority AS priority, CAST(round(o_totalprice * 100) AS BIGINT) AS cents,
 CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS day FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)),
 rp AS (SELECT *, lag(status) OVER w AS p_status, lag(priority) OVER w AS p_priority, lag(cents) OVER w AS p_cents, lag(day) OVER w AS p_day FROM records WINDOW w AS (PARTITION BY stream_id ORDER BY seq)),
 rd AS (SELECT stream_id, seq, status, priority, cents, day, CASE WHEN seq > 1 THEN (status IS DISTINCT FROM p_status)::INT + 2 * (priority IS DISTINCT FROM p_priority)::INT + 4 * (cents IS DISTINCT FROM p_cents)::INT + 8 * (day IS DISTINCT FROM p_day)::INT END AS mask,
 CASE WHEN seq > 1 AND status IS DISTINCT FROM p_status THEN status END AS d_status, CASE WHEN seq > 1 AND priority IS DISTINCT FROM p_priority THEN priority END AS d_priority,
 CASE WHEN seq > 1 AND cents IS DISTINCT FROM p_cents THEN cents - p_cents END AS d_cents, CASE WHEN seq > 1 AND day IS DISTINCT FROM p_day THEN day - p_day END AS d_day FROM rp)"""


def order_deltas(spark, sf_dir):
    return diff.record_deltas(streams.order_records(table(spark, sf_dir, "orders")))


@query("record_deltas", f"WITH {RECORDS_SQL} SELECT * FROM rd")
def record_deltas(spark, sf_dir):
    return order_deltas(spark, sf_dir)


@query(
    "record_lengths",
    f"""WITH {RECORDS_SQL} SELECT stream_id, seq, CAST({tlen("status")} + {tlen("priority")} + {vlen("cents")} + {vlen("day")} AS BIGINT) AS record_len,
 CASE WHEN mask IS NOT NULL THEN CAST(2 + coalesce({tlen("d_status")}, 0) + coalesce({tlen("d_priority")}, 0) + CASE WHEN d_cents IS NULL THEN 0 ELSE {slen("d_cents")} END + CASE WHEN d_day IS NULL THEN 0 ELSE {slen("d_day")} END AS BIGINT) END AS delta_len FROM rd""".replace(
        f"coalesce({tlen('d_status')}, 0)", f"CASE WHEN d_status IS NULL THEN 0 ELSE {tlen('d_status')} END"
    ).replace(f"coalesce({tlen('d_priority')}, 0)", f"CASE WHEN d_priority IS NULL THEN 0 ELSE {tlen('d_priority')} END"),
)
def record_lengths(spark, sf_dir):
    return diff.record_lengths(order_deltas(spark, sf_dir))


@query("record_reconstruct", f"WITH {RECORDS_SQL} SELECT stream_id, seq, status AS r_status, priority AS r_priority, cents AS r_cents, day AS r_day FROM records")
def record_reconstruct(spark, sf_dir):
    return diff.record_reconstruct(order_deltas(spark, sf_dir)).select("stream_id", "seq", *(f"r_{f}" for f, _ in diff.RECORD_FIELDS))


def vhex(x: str) -> str:
    """SQL of an unsigned number's varint in hexadecimal, up to 42 bits."""
    byte = lambda i, more: f"lpad(to_hex((({x}) >> {7 * i}) & 127{' | 128' if more else ''}), 2, '0')"
    return "CASE " + " ".join(f"WHEN ({x}) < {1 << 7 * n} THEN " + " || ".join(byte(i, i < n - 1) for i in range(n)) for n in range(1, 7)) + " END"


def shex(x: str) -> str:
    return f"(lpad(to_hex(strlen({x})), 2, '0') || hex(encode({x})))"


AGENTS_SQL = """agents AS (SELECT o_custkey AS stream_id, CAST(row_number() OVER w AS BIGINT) AS seq, 'agent-' || o_custkey AS agent_id, o_orderpriority AS model, o_orderstatus AS status, 'order' AS task, o_orderkey % 101 AS progress, o_orderkey AS tokens,
 CAST(round(o_totalprice * 100) AS BIGINT) AS memory_mb, o_orderkey // 3 AS files_processed, 'f/' || o_orderkey % 7 AS current_file FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)),
 ap AS (SELECT *, """ + ", ".join(f"lag({c}) OVER w AS p_{c}" for c in ("model", "status", "progress", "tokens", "memory_mb", "files_processed", "current_file")) + " FROM agents WINDOW w AS (PARTITION BY stream_id ORDER BY seq))"


def agents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as agent records, all ten fields: stream_id, seq, record (a struct)."""
    from pyspark.sql import Window as W

    k = F.col("o_orderkey")
    number = lambda c: c.cast("decimal(20,0)")
    fields = F.struct(
        F.concat(F.lit("agent-"), F.col("o_custkey").cast("string")).alias("agent_id"), F.col("o_orderpriority").alias("model"), F.col("o_orderstatus").alias("status"), F.lit("order").alias("task"), (k % 101).cast("int").alias("progress"), number(k).alias("tokens"),
        number(F.round(F.col("o_totalprice") * 100)).alias("memory_mb"), F.lit(1.5).cast("float").alias("cpu_percent"), number(F.expr("o_orderkey div 3")).alias("files_processed"), F.concat(F.lit("f/"), (k % 7).cast("string")).alias("current_file"),
    )
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("stream_id"), "o_orderkey", fields.alias("record"))
    return rows.select("stream_id", F.row_number().over(W.partitionBy("stream_id").orderBy("o_orderkey")).cast("long").alias("seq"), "record")


@query("record_bytes", f"""WITH {AGENTS_SQL} SELECT stream_id, seq, upper({shex("agent_id")} || {shex("model")} || {shex("status")} || {shex("task")} || lpad(to_hex(progress), 2, '0') || {vhex("tokens")} || {vhex("memory_mb")} || '0000C03F' || {vhex("files_processed")} || {shex("current_file")}) AS bytes,
 agent_id, progress, tokens, memory_mb, current_file, CAST(NULL AS VARCHAR) AS error FROM agents""")
def record_bytes(spark, sf_dir):
    """Records as their bytes, and read back."""
    r = agents(spark, sf_dir).select("stream_id", "seq", udfs.record_bytes("record").alias("b"))
    back = r.select("stream_id", "seq", F.hex("b").alias("bytes"), udfs.read_record("b").alias("r"))
    return back.select("stream_id", "seq", "bytes", F.col("r.agent_id").alias("agent_id"), F.col("r.progress").cast("long").alias("progress"), F.col("r.tokens").cast("long").alias("tokens"), F.col("r.memory_mb").cast("long").alias("memory_mb"), F.col("r.current_file").alias("current_file"), F.col("r.error").alias("error"))


_CHANGED = (("model", 1, "s"), ("status", 2, "s"), ("progress", 4, "u"), ("tokens", 5, "u"), ("memory_mb", 6, "u"), ("files_processed", 8, "u"), ("current_file", 9, "s"))
_MASK = " + ".join(f"{1 << bit} * ({c} IS DISTINCT FROM p_{c})::INT" for c, bit, _ in _CHANGED)
_DELTAS = " || ".join(f"CASE WHEN {c} IS DISTINCT FROM p_{c} THEN " + (shex(c) if kind == "s" else vhex(f"CASE WHEN {c} >= p_{c} THEN ({c} - p_{c}) * 2 ELSE (p_{c} - {c}) * 2 - 1 END")) + " ELSE '' END" for c, _, kind in _CHANGED)


@query("record_delta_bytes", f"""WITH {AGENTS_SQL} SELECT stream_id, seq, CASE WHEN seq > 1 THEN upper(lpad(to_hex(({_MASK}) % 256), 2, '0') || lpad(to_hex(({_MASK}) // 256), 2, '0') || {_DELTAS}) END AS delta, CASE WHEN seq > 1 THEN TRUE END AS same FROM ap""")
def record_delta_bytes(spark, sf_dir):
    """Each record's delta on the one before as bytes, and whether the record comes back from it."""
    both = streams.with_previous(agents(spark, sf_dir), "record")
    made = both.select("stream_id", "seq", udfs.record_bytes("record").alias("new"), F.when(F.col("prev_record").isNotNull(), udfs.record_delta_bytes(F.coalesce("prev_record", F.col("record")), "record")).alias("delta"), F.when(F.col("prev_record").isNotNull(), udfs.record_bytes(F.coalesce("prev_record", F.col("record")))).alias("old"))
    return made.select("stream_id", "seq", F.hex("delta").alias("delta"), (udfs.applied_record_delta("old", "delta") == F.col("new")).alias("same"))


@query("varint_lengths", f"SELECT o_orderkey, {vlen('o_orderkey')} AS key_len, {slen('o_orderkey - 7000')} AS signed_len, {vlen('o_orderkey * 1000003')} AS large_len FROM orders")
def varint_lengths(spark, sf_dir):
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", X.varint_len(k).alias("key_len"), X.signed_len(k - 7000).alias("signed_len"), X.varint_len(k * 1000003).alias("large_len"))


# ---- byte streams ------------------------------------------------------------------

LINES_SQL = RECORDS_SQL.split(",\n rp AS")[0] + """,
 lines AS (SELECT stream_id, seq, rpad(status, 2, ' ') || rpad(priority, 16, ' ') || lpad(CAST(cents AS VARCHAR), 12, '0') || lpad(CAST(day AS VARCHAR), 6, '0') AS state FROM records),
 pairs AS (SELECT stream_id, seq, state, lag(state) OVER (PARTITION BY stream_id ORDER BY seq) AS old FROM lines),
 spots AS (SELECT stream_id, seq, i FROM (SELECT stream_id, seq, state, old, unnest(range(36)) AS i FROM pairs WHERE old IS NOT NULL) WHERE substr(state, i + 1, 1) <> substr(old, i + 1, 1)),
 gaps AS (SELECT *, lag(i) OVER (PARTITION BY stream_id, seq ORDER BY i) AS before FROM spots),
 per AS (SELECT p.stream_id, p.seq, count(i) AS changed, count(i) FILTER (WHERE before IS NULL OR i - before > 1) AS runs, min(i) AS lo, max(i) AS hi, count(DISTINCT i // 16) AS chunks, count(DISTINCT i // 16) FILTER (WHERE i >= 32) AS tails
  FROM pairs p LEFT JOIN gaps g ON p.stream_id = g.stream_id AND p.seq = g.seq WHERE p.old IS NOT NULL GROUP BY ALL)"""


@query("change_profiles", f"""WITH {LINES_SQL} SELECT stream_id, seq, CAST(36 AS BIGINT) AS previous_len, CAST(36 AS BIGINT) AS current_len, changed AS changed_bytes, runs AS changed_runs, CAST(coalesce(lo, 36) AS BIGINT) AS common_prefix, CAST(coalesce(35 - hi, 0) AS BIGINT) AS common_suffix,
 round(changed / 36.0, 6) AS change_ratio, FALSE AS resized FROM per""")
def change_profiles(spark, sf_dir):
    return diff.profiles_of_change(streams.order_lines(table(spark, sf_dir, "orders")))


CANDIDATES_SQL = f"""{LINES_SQL}, lens AS (SELECT stream_id, seq, 3 + 2 * changed AS sparse, 3 + 2 * runs + changed AS ranges, 2 + 36 AS xor,
 5 + coalesce(hi - lo + 1, 0) AS splice, 4 + 2 * chunks + 16 * (chunks - tails) + 4 * tails AS chunks FROM per),
 cand AS (SELECT stream_id, seq, unnest(['sparse', 'ranges', 'xor', 'splice', 'chunks']) AS kind, unnest([1, 2, 3, 4, 5]) AS rank, unnest([sparse, ranges, xor, splice, chunks]) AS payload_len FROM lens)"""


@query("byte_delta_lengths", f"WITH {CANDIDATES_SQL} SELECT stream_id, seq, CAST(36 AS BIGINT) AS state_len, kind, CAST(rank AS INTEGER) AS rank, CAST(payload_len AS BIGINT) AS payload_len FROM cand")
def byte_delta_lengths(spark, sf_dir):
    """Every delta candidate of fixed-length states, in chunks of 16 bytes."""
    return diff.byte_candidates(streams.order_lines(table(spark, sf_dir, "orders")), chunk=16)


@query("single_candidate", f"WITH {CANDIDATES_SQL} SELECT stream_id, seq, CAST(payload_len AS BIGINT) AS payload_len FROM cand WHERE kind = 'ranges'")
def single_candidate(spark, sf_dir):
    return diff.single_candidate(streams.order_lines(table(spark, sf_dir, "orders")), "ranges").select("stream_id", "seq", F.octet_length("payload").cast("long").alias("payload_len"))


@query("legacy_sparse", f"WITH {CANDIDATES_SQL} SELECT stream_id, seq, CAST(payload_len - 2 AS BIGINT) AS payload_len FROM cand WHERE kind = 'sparse'")
def legacy_sparse(spark, sf_dir):
    """The old sparse form has neither tag nor length."""
    c = diff.byte_candidates(streams.order_lines(table(spark, sf_dir, "orders"))).where("kind = 'sparse'")
    return c.select("stream_id", "seq", (F.col("payload_len") - 1 - X.varint_len(F.col("state_len"))).alias("payload_len"))


@query("legacy_sparse_applied", f"WITH {CANDIDATES_SQL} SELECT l.stream_id, l.seq, CAST(payload_len - 2 AS BIGINT) AS payload_len, l.state, CAST(NULL AS VARCHAR) AS error FROM lines l JOIN cand c ON l.stream_id = c.stream_id AND l.seq = c.seq WHERE kind = 'sparse'")
def legacy_sparse_applied(spark, sf_dir):
    """Payloads of the old sparse form, made and applied to the state before."""
    both = streams.with_previous(streams.order_lines(table(spark, sf_dir, "orders"))).where("prev_state is not null")
    made = both.select("stream_id", "seq", "prev_state", udfs.legacy_sparse("prev_state", "state").alias("payload"))
    out = made.select("stream_id", "seq", F.octet_length("payload").cast("long").alias("payload_len"), udfs.apply_legacy_sparse("prev_state", "payload").alias("r"))
    return out.select("stream_id", "seq", "payload_len", F.decode("r.state", "UTF-8").alias("state"), "r.error")


@query("strategy_totals", f"WITH {CANDIDATES_SQL} SELECT kind, count(*) AS updates, CAST(sum(payload_len + 46) AS BIGINT) AS total_bytes FROM cand GROUP BY kind")
def strategy_totals(spark, sf_dir):
    return metrics.strategy_totals(diff.byte_candidates(streams.order_lines(table(spark, sf_dir, "orders")), chunk=16))


@query(
    "exhaustive_select",
    f"""WITH {CANDIDATES_SQL}, every AS (SELECT stream_id, seq, kind, rank, payload_len FROM cand UNION ALL SELECT stream_id, seq, 'snapshot', 0, 36 FROM lines)
 SELECT stream_id, seq, CAST(36 AS BIGINT) AS state_bytes, count(*) AS considered, arg_min(kind, payload_len * 10 + rank) AS mode, CAST(46 + min(payload_len) AS BIGINT) AS selected_bytes FROM every GROUP BY stream_id, seq""",
)
def exhaustive_select(spark, sf_dir):
    return select.exhaustive(streams.order_lines(table(spark, sf_dir, "orders")), chunk=16)


SHORTLIST_SQL = "CASE WHEN changed / 36.0 * 100 <= 8 THEN 'sparse,ranges' WHEN runs <= 64 THEN 'ranges,sparse' ELSE 'xor,ranges' END"


@query("shortlists", f"WITH {LINES_SQL} SELECT stream_id, seq, changed AS changed_bytes, runs AS changed_runs, FALSE AS resized, {SHORTLIST_SQL} AS shortlist FROM per")
def shortlists(spark, sf_dir):
    return select.shortlisted(streams.order_lines(table(spark, sf_dir, "orders")))


@query(
    "fast_select",
    f"""WITH {CANDIDATES_SQL}, listed AS (SELECT stream_id, seq, {SHORTLIST_SQL} AS s FROM per),
 every AS (SELECT c.stream_id, c.seq, kind, CASE WHEN starts_with(s, kind) THEN 1 ELSE 2 END AS rank, payload_len FROM cand c JOIN listed l ON c.stream_id = l.stream_id AND c.seq = l.seq WHERE kind IN ('sparse', 'ranges') UNION ALL SELECT stream_id, seq, 'snapshot', 0, 36 FROM lines)
 SELECT stream_id, seq, count(*) AS considered, arg_min(kind, payload_len * 10 + rank) AS mode, CAST(46 + min(payload_len) AS BIGINT) AS selected_bytes FROM every GROUP BY stream_id, seq""",
)
def fast_select(spark, sf_dir):
    return select.fast(streams.order_lines(table(spark, sf_dir, "orders")))


TURNS_SQL = """turns AS (SELECT conv_id AS stream_id, CAST(row_number() OVER w AS BIGINT) AS seq, CAST(sum(strlen(coalesce(text, ''))) OVER w AS BIGINT) AS n FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
 grown AS (SELECT *, lag(n) OVER (PARTITION BY stream_id ORDER BY seq) AS p FROM turns)"""


@query("transcript_states", f"WITH {TURNS_SQL} SELECT stream_id, seq, n AS state_bytes FROM turns")
def transcript_states(spark, sf_dir):
    return streams.transcripts(table(spark, sf_dir, "conversations")).select("stream_id", "seq", F.octet_length("state").cast("long").alias("state_bytes"))


@query(
    "transcript_exhaustive",
    f"""WITH {TURNS_SQL}, c AS (SELECT stream_id, seq, n, p, (n + 1023) // 1024 AS k, p // 1024 AS same FROM grown),
 l AS (SELECT stream_id, seq, n, p, CASE WHEN n > p THEN 1 + {vlen("n")} + {vlen("p")} + 1 + {vlen("(n - p)")} + n - p END AS splice,
  CASE WHEN n > p THEN 1 + {vlen("n")} + 2 + {vlen("(k - same)")} + {vlen("same")} + (k - same - 1) * 3 + {vlen("(n - (k - 1) * 1024)")} + n - same * 1024 END AS chunks, CASE WHEN n = p THEN 2 + {vlen("n")} END AS sparse FROM c),
 b AS (SELECT stream_id, seq, n AS state_bytes, CASE WHEN p IS NULL THEN 1 WHEN n = p THEN 6 ELSE 3 END AS considered, least(n, splice, chunks, sparse) AS best, n, splice, chunks, sparse FROM l)
 SELECT stream_id, seq, state_bytes, CAST(considered AS BIGINT) AS considered, CASE WHEN best = n THEN 'snapshot' WHEN best = sparse THEN 'sparse' WHEN best = splice THEN 'splice' ELSE 'chunks' END AS mode, CAST(46 + best AS BIGINT) AS selected_bytes FROM b""",
)
def transcript_exhaustive(spark, sf_dir):
    """Growing states: each turn is appended, so splice and chunks stand against the snapshot."""
    return select.exhaustive(streams.transcripts(table(spark, sf_dir, "conversations")))


@query(
    "reconstruction",
    f"WITH {TURNS_SQL} SELECT k AS kind, count(*) AS updates, count(*) AS same, CAST(0 AS BIGINT) AS errors FROM grown CROSS JOIN (SELECT unnest(['splice', 'chunks']) AS k) WHERE p IS NOT NULL GROUP BY k",
)
def reconstruction(spark, sf_dir):
    """Every transcript comes back from its delta."""
    t = streams.transcripts(table(spark, sf_dir, "conversations"))
    every = [diff.reconstructed(t, k).withColumn("kind", F.lit(k)) for k in ("splice", "chunks")]
    return every[0].unionByName(every[1]).groupBy("kind").agg(F.count("*").alias("updates"), F.count_if("same").alias("same"), F.count("error").alias("errors"))


@query("codec_comparison", f"""WITH {CHOICE_SQL}, t AS (SELECT 'json' AS method, state_bytes AS bytes FROM chosen UNION ALL SELECT 'snapshot', snapshot_bytes FROM chosen UNION ALL SELECT 'adaptive', selected_bytes FROM chosen UNION ALL SELECT 'delta', coalesce(delta_bytes, snapshot_bytes) FROM chosen)
 SELECT method, count(*) AS messages, CAST(sum(bytes) AS BIGINT) AS total_bytes, round(sum(bytes) / CAST(count(*) AS DOUBLE), 4) AS bytes_per_message FROM t GROUP BY method""")
def codec_comparison(spark, sf_dir):
    d = select.four_way(profiles(spark, sf_dir))
    rows = F.array(*(F.struct(F.lit(m).alias("method"), c.alias("bytes")) for m, c in (("json", F.col("state_bytes")), ("snapshot", F.col("snapshot_bytes")), ("adaptive", F.col("selected_bytes")), ("delta", F.coalesce("delta_bytes", "snapshot_bytes")))))
    return d.select(F.explode(rows).alias("r")).groupBy("r.method").agg(F.count("*").alias("messages"), F.sum("r.bytes").alias("total_bytes"), F.round(F.sum("r.bytes") / F.count("*"), 4).alias("bytes_per_message"))


@query(
    "encoder_candidates",
    f"""SELECT stream_id, count(*) AS packets, count(*) FILTER (WHERE mode = 'snapshot') AS snapshots, count(*) FILTER (WHERE mode <> 'snapshot') AS deltas, CAST(0 AS BIGINT) AS compressed, CAST(sum(state_bytes) AS BIGINT) AS input_bytes, CAST(sum(selected_bytes) AS BIGINT) AS output_bytes,
 CAST(sum(considered) AS BIGINT) AS candidates, round(sum(selected_bytes) / CAST(sum(state_bytes) AS DOUBLE), 6) AS ratio, round((1.0 - sum(selected_bytes) / CAST(sum(state_bytes) AS DOUBLE)) * 100, 4) AS saving_percent FROM ({QUERIES["exhaustive_select"][1]}) GROUP BY stream_id""",
)
def encoder_candidates(spark, sf_dir):
    """Each stream's encoder metrics under the exhaustive choice, with the candidates it considered."""
    return metrics.encoder_metrics(exhaustive_select(spark, sf_dir), "stream_id")


@query(
    "method_totals",
    f"""WITH r AS ({QUERIES["record_lengths"][1]}), x AS ({QUERIES["exhaustive_select"][1]}), b AS ({QUERIES["byte_delta_lengths"][1]}),
 t AS (SELECT 'raw' AS method, state_bytes AS bytes FROM x UNION ALL SELECT 'snapshot', 46 + state_bytes FROM x UNION ALL SELECT 'exhaustive', selected_bytes FROM x UNION ALL SELECT 'record', 46 + record_len FROM r UNION ALL SELECT 'record_delta', 46 + coalesce(delta_len, record_len) FROM r
 UNION ALL SELECT kind, 46 + payload_len FROM b UNION ALL SELECT unnest(['sparse', 'ranges', 'xor', 'splice', 'chunks']), 46 + state_bytes FROM x WHERE seq = 1),
 g AS (SELECT method, count(*) AS messages, CAST(sum(bytes) AS BIGINT) AS total_bytes FROM t GROUP BY method)
 SELECT method, messages, total_bytes, round(total_bytes / CAST(messages AS DOUBLE), 4) AS bytes_per_message, round((1.0 - total_bytes / CAST(messages * 36 AS DOUBLE)) * 100, 4) AS saving_percent, CAST(row_number() OVER (ORDER BY total_bytes, method) AS INTEGER) AS place FROM g""",
)
def method_totals(spark, sf_dir):
    """Orders' records and lines by every method: raw, snapshots, records, record deltas, each byte delta, and the best of them."""
    every, kinds = exhaustive_select(spark, sf_dir), F.array(*map(F.lit, ("sparse", "ranges", "xor", "splice", "chunks")))
    of = lambda df, method, size: df.select(method.alias("method"), "state_bytes", size.cast("long").alias("bytes"))
    whole = F.col("state_bytes") + X.HEADER_LEN
    pairs = F.array(*(F.struct(F.lit(m).alias("m"), c.cast("long").alias("b")) for m, c in (("raw", F.col("state_bytes")), ("snapshot", whole), ("exhaustive", F.col("selected_bytes")))))
    rows = of(every.select("state_bytes", F.explode(pairs).alias("p")), F.col("p.m"), F.col("p.b"))
    rows = rows.unionByName(of(every.where("seq = 1").select("state_bytes", F.explode(kinds).alias("k")), F.col("k"), whole))
    rows = rows.unionByName(of(byte_delta_lengths(spark, sf_dir).withColumnRenamed("state_len", "state_bytes"), F.col("kind"), F.col("payload_len") + X.HEADER_LEN))
    lines = streams.order_lines(table(spark, sf_dir, "orders")).select("stream_id", "seq", F.octet_length("state").cast("long").alias("state_bytes"))
    records = record_lengths(spark, sf_dir).join(lines, ["stream_id", "seq"])
    both = F.array(*(F.struct(F.lit(m).alias("m"), c.alias("b")) for m, c in (("record", F.col("record_len")), ("record_delta", F.coalesce("delta_len", "record_len")))))
    rows = rows.unionByName(of(records.select("state_bytes", F.explode(both).alias("p")), F.col("p.m"), F.col("p.b") + X.HEADER_LEN))
    return metrics.method_totals(rows)


# ---- hashes, wire, formats ---------------------------------------------------------

HASH_SQL = "lpad(lower(hex(CAST(list_reduce(list_prepend(CAST(14695981039346656037 AS UHUGEINT), list_transform(range(1, strlen({x}) + 1), lambda i: CAST('0x' || substr(hex(encode({x})), 2 * i - 1, 2) AS UHUGEINT))), lambda h, b: xor(h, b) * 1099511628211 % 18446744073709551616) AS UBIGINT))), 16, '0')"


@query("fnv_hashes", f"SELECT item_id, {HASH_SQL.format(x='text')} AS hash FROM benchmark")
def fnv_hashes(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", udfs.fnv1a64_hex(F.col("text").cast("binary")).alias("hash"))


@query("schema_hashes", f"SELECT t AS schema_name, {HASH_SQL.format(x='t')} AS schema_hash FROM (SELECT unnest(['AgentState', 'PublicState', 'GameState', 'conversation', 'profile']) AS t)")
def schema_hashes(spark, sf_dir):
    """A schema is known by the hash of its name."""
    names = ["AgentState", "PublicState", "GameState", "conversation", "profile"]
    return spark.createDataFrame([(n, f"{codec.fnv1a64(n.encode()):016x}") for n in names], "schema_name string, schema_hash string")


@query("state_hashes", f"WITH {TEXT_SQL}, last AS (SELECT stream_id, arg_max(state, seq) AS state FROM texts GROUP BY stream_id) SELECT stream_id, {HASH_SQL.format(x='state')} AS state_hash FROM last")
def state_hashes(spark, sf_dir):
    last = streams.with_text(profiles(spark, sf_dir)).groupBy("stream_id").agg(F.max_by("state", "seq").alias("state"))
    return last.select("stream_id", udfs.fnv1a64_hex(F.col("state").cast("binary")).alias("state_hash"))


CRC_SQL = """tab AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda h, k: CASE WHEN h % 2 = 1 THEN xor(h // 2, 3988292384) ELSE h // 2 END) AS v FROM range(256) r(i)))"""


@query("payload_checksums", f"""WITH {CRC_SQL}, p AS (SELECT page_id, hex(encode(coalesce(html, ''))) AS h FROM pages), b AS (SELECT page_id, list_transform(range(1, length(h) // 2 + 1), lambda i: CAST('0x' || substr(h, 2 * i - 1, 2) AS BIGINT)) AS bytes FROM p)
 SELECT page_id, xor(list_reduce(list_prepend(4294967295, bytes), lambda c, x: xor(c // 256, t[xor(c % 256, x) + 1])), 4294967295) AS crc32 FROM b, tab""")
def payload_checksums(spark, sf_dir):
    """CRC32 of every page as a payload, by the built-in function."""
    return table(spark, sf_dir, "pages").select("page_id", F.crc32(F.coalesce("html", F.lit("")).cast("binary")).alias("crc32"))


def _le(x: str, n: int) -> str:
    """SQL of an unsigned number's ``n`` little-endian bytes in hexadecimal."""
    return " || ".join(f"lpad(lower(to_hex({x} // {1 << 8 * i} % 256)), 2, '0')" for i in range(n))


@query("packet_headers", f"WITH {CHOICE_SQL} SELECT stream_id, seq, '445303' || CASE WHEN mode = 'snapshot' THEN '01' ELSE '02' END || '0000' || {_le('seq', 8)} || {_le('(CASE WHEN mode = ' + chr(39) + 'snapshot' + chr(39) + ' THEN 0 ELSE seq - 1 END)', 8)} AS header FROM chosen")
def packet_headers(spark, sf_dir):
    """The first 22 bytes of every chosen packet on the wire."""
    d = select.four_way(profiles(spark, sf_dir))
    base = F.when(F.col("mode") == "snapshot", F.lit(0)).otherwise(F.col("seq") - 1)
    zero = F.lit("0" * 16)
    wire = udfs.encode_packet("mode", "seq", base, zero, zero, F.lit(b""))
    return d.select("stream_id", "seq", F.lower(F.hex(F.substring(wire, 1, 22))).alias("header"))


@query("packet_roundtrip", f"WITH {TEXT_SQL} SELECT stream_id, seq, 'snapshot' AS kind, CAST(strlen(state) AS BIGINT) AS payload_len, CAST(NULL AS VARCHAR) AS error FROM texts")
def packet_roundtrip(spark, sf_dir):
    """Every state as a snapshot packet, encoded and decoded again."""
    t = streams.with_text(profiles(spark, sf_dir)).select("stream_id", "seq", F.col("state").cast("binary").alias("state"))
    zero = F.lit("0" * 16)
    p = t.select("stream_id", "seq", udfs.decode_packet(udfs.encode_packet(F.lit("snapshot"), "seq", F.lit(0), udfs.fnv1a64_hex("state"), zero, "state")).alias("p"))
    return p.select("stream_id", "seq", F.col("p.kind").alias("kind"), F.octet_length("p.payload").cast("long").alias("payload_len"), F.col("p.error").alias("error"))


@query("zstd_candidates")
def zstd_candidates(spark, sf_dir):
    """Transcripts compressed where that pays, and back again."""
    t = streams.transcripts(table(spark, sf_dir, "conversations"))
    z = t.select("stream_id", "seq", "state", udfs.zstd_payload("state").alias("small"))
    return z.select("stream_id", "seq", F.octet_length("state").alias("raw"), F.octet_length("small").alias("compressed"), F.coalesce(udfs.unzstd_payload("small") == F.col("state"), F.lit(True)).alias("same"))


@query("hex_roundtrip", "SELECT item_id, lower(hex(encode(text))) AS hex, text AS again FROM benchmark")
def hex_roundtrip(spark, sf_dir):
    h = F.lower(F.hex(F.col("text").cast("binary")))
    return table(spark, sf_dir, "benchmark").select("item_id", h.alias("hex"), F.decode(F.unhex(h), "UTF-8").alias("again"))


PROTOCOL = "state-transport/1"


@query("transport_envelopes", f"""SELECT item_id, '{{"protocol":"{PROTOCOL}","encoding":"hex","payload":"' || lower(hex(encode(text))) || '"}}' AS envelope, text AS payload FROM benchmark""")
def transport_envelopes(spark, sf_dir):
    """JSON envelopes made and opened again; another protocol fails."""
    e = F.concat(F.lit(f'{{"protocol":"{PROTOCOL}","encoding":"hex","payload":"'), F.lower(F.hex(F.col("text").cast("binary"))), F.lit('"}'))
    parsed = F.from_json("envelope", "protocol string, encoding string, payload string")
    rows = table(spark, sf_dir, "benchmark").select("item_id", e.alias("envelope")).withColumn("p", parsed)
    payload = F.when(F.col("p.protocol") == PROTOCOL, F.decode(F.unhex("p.payload"), "UTF-8")).otherwise(F.raise_error(F.lit("unsupported envelope")).cast("string"))
    return rows.select("item_id", "envelope", payload.alias("payload"))


@query("formatted_sizes", "SELECT page_id, CASE WHEN n >= 1024 THEN printf('%.1f KiB', n / 1024.0) ELSE printf('%d B', n) END AS size, CASE WHEN n >= 1024 THEN printf('%.1fKiB', n / 1024.0) ELSE printf('%dB', n) END AS narrow FROM (SELECT page_id, strlen(html) AS n FROM pages)")
def formatted_sizes(spark, sf_dir):
    n = F.octet_length("html")
    return table(spark, sf_dir, "pages").select("page_id", X.format_size(n).alias("size"), X.format_size(n, "").alias("narrow"))


@query("reconstruction_fixed", f"WITH {LINES_SQL} SELECT k AS kind, count(*) AS updates, count(*) AS same, CAST(0 AS BIGINT) AS errors FROM pairs CROSS JOIN (SELECT unnest(['sparse', 'ranges', 'xor', 'splice', 'chunks']) AS k) WHERE old IS NOT NULL GROUP BY k")
def reconstruction_fixed(spark, sf_dir):
    """Every fixed-length state comes back from its delta of each kind."""
    lines = streams.order_lines(table(spark, sf_dir, "orders"))
    out = None
    for kind in codec.CODES:
        part = diff.reconstructed(lines, kind).agg(F.lit(kind).alias("kind"), F.count("*").alias("updates"), F.count_if("same").alias("same"), F.count("error").alias("errors"))
        out = part if out is None else out.unionByName(part)
    return out


def _malformed() -> list[tuple[str, bytes]]:
    wire = codec.encode_packet(codec.snapshot(1, b"state", 0))
    return [
        ("whole", wire), ("empty", b""), ("short", wire[:45]), ("magic", b"XX" + wire[2:]), ("version", wire[:2] + b"\x09" + wire[3:]), ("kind", wire[:3] + b"\x09" + wire[4:]), ("flags", wire[:4] + b"\xff\xff" + wire[6:]),
        ("truncated", wire[:-1]), ("trailing", wire + b"x"), ("checksum", wire[:-1] + b"X"), ("older", wire[:2] + b"\x02" + wire[3:]),
    ]


@query(
    "packet_errors",
    """SELECT unnest(['whole', 'empty', 'short', 'magic', 'version', 'kind', 'flags', 'truncated', 'trailing', 'checksum', 'older']) AS name,
 unnest([NULL, 'InvalidPacket', 'InvalidPacket', 'InvalidPacket', 'ProtocolVersionRange', 'InvalidPacket', 'InvalidPacket', 'InvalidPacket', 'InvalidPacket', 'ChecksumMismatch', NULL]) AS error""",
)
def packet_errors(spark, sf_dir):
    """Which error each kind of broken packet gives; versions 2 and 3 are read."""
    rows = spark.createDataFrame([(n, bytearray(w)) for n, w in _malformed()], "name string, wire binary")
    return rows.select("name", udfs.decode_packet("wire")["error"].alias("error"))
