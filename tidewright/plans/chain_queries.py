"""Queries over packet chains, recovery, replicas and fault workloads, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.functions import udfs
from tidewright.functions import expressions as X
from tidewright.operators import crdt, metrics, recover, select, simulate, streams, subscribe
from tidewright.plans.sync_queries import CHOICE_SQL, HASH_SQL, PROFILE_SQL, TEXT_SQL, profiles, table
from tidewright.sources import brokers, transports
from tidewright.streaming import session

QUERIES: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = (f, sql)
        return f

    return add


# ---- subscribers -------------------------------------------------------------------

DELIVERIES_SQL = """sent AS (SELECT stream_id AS client_id, seq, CASE WHEN seq = 1 OR seq % 11 = 0 THEN 'snapshot' ELSE 'delta' END AS kind FROM profile),
 deliveries AS (SELECT client_id, seq * 2 AS arrival, seq, kind FROM sent WHERE seq % 7 <> 0 UNION ALL SELECT client_id, seq * 2 + 1, seq, kind FROM sent WHERE seq % 7 <> 0 AND seq % 5 = 0),
 judged AS (SELECT *, max(seq) OVER (PARTITION BY client_id ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top, max(CASE WHEN kind = 'snapshot' THEN seq END) OVER (PARTITION BY client_id ORDER BY arrival) AS snap FROM deliveries),
 fresh AS (SELECT *, top IS NULL OR seq > top AS new, (top IS NULL OR seq > top) AND snap IS NOT NULL AND seq // 7 = snap // 7 AS good FROM judged),
 local AS (SELECT *, max(CASE WHEN good THEN seq END) OVER (PARTITION BY client_id ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS local FROM fresh),
 outcomes AS (SELECT client_id, arrival, seq, kind, new, CASE WHEN good THEN 'applied' WHEN NOT new AND coalesce(seq <= local, FALSE) THEN 'duplicate' ELSE 'need_snapshot' END AS outcome FROM local)"""


def deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh packet of each stream is lost and every fifth comes twice."""
    kind = F.when((F.col("seq") == 1) | (F.col("seq") % 11 == 0), "snapshot").otherwise("delta")
    sent = profiles(spark, sf_dir).select(F.col("stream_id").alias("client_id"), "seq", kind.alias("kind")).where("seq % 7 != 0")
    base = F.when(F.col("kind") == "snapshot", F.lit(0)).otherwise(F.col("seq") - 1)
    first = sent.select("client_id", (F.col("seq") * 2).alias("arrival"), "seq", "kind", base.alias("base_seq"))
    return first.unionByName(first.where("seq % 5 = 0").withColumn("arrival", F.col("arrival") + 1))


def _profile_only(sql: str) -> str:
    from tidewright.plans.sync_queries import PROFILE_SQL

    return f"WITH {PROFILE_SQL}, {DELIVERIES_SQL} {sql}"


@query("subscriber_outcomes", _profile_only("SELECT client_id, arrival, seq, kind, outcome FROM outcomes"))
def subscriber_outcomes(spark, sf_dir):
    return subscribe.classify(deliveries(spark, sf_dir))


@query("subscriber_fold", _profile_only("SELECT client_id, arrival, seq, outcome FROM outcomes"))
def subscriber_fold(spark, sf_dir):
    """The same outcomes by the ordered fold that any order of arrival needs."""
    return subscribe.fold(deliveries(spark, sf_dir)).select("client_id", "arrival", "seq", "outcome")


@query("duplicate_suppression", _profile_only("SELECT client_id, arrival, seq, kind FROM outcomes WHERE new"))
def duplicate_suppression(spark, sf_dir):
    return subscribe.without_repeats(deliveries(spark, sf_dir)).select("client_id", "arrival", "seq", "kind")


@query("epoch_reset", _profile_only("SELECT client_id, seq // 20 AS epoch, count(*) AS packets, min(seq) AS first_seq FROM outcomes WHERE new GROUP BY ALL"))
def epoch_reset(spark, sf_dir):
    """A restart of the publisher begins a new epoch; suppression works within it."""
    d = subscribe.without_repeats(deliveries(spark, sf_dir)).withColumn("epoch", F.floor(F.col("seq") / 20))
    return d.groupBy("client_id", "epoch").agg(F.count("*").alias("packets"), F.min("seq").alias("first_seq"))


@query("bounded_reorder", "WITH p AS (SELECT user_id AS client_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS seq FROM events) SELECT client_id, seq, CASE WHEN seq % 10 = 6 THEN 'buffered' ELSE 'applied' END AS outcome FROM p WHERE seq <= (SELECT 10 * (min(m) // 10) FROM (SELECT max(seq) AS m FROM p GROUP BY client_id))")
def bounded_reorder(spark, sf_dir):
    """Packets 5 and 6 of every ten come swapped: 6 waits for 5 and is then drained. As many whole tens as the shortest stream has."""
    p = profiles(spark, sf_dir).select(F.col("stream_id").alias("client_id"), "seq")
    least = p.groupBy("client_id").agg(F.max("seq").alias("m")).agg((F.floor(F.min("m") / 10) * 10).alias("n"))
    return swapped(p.join(F.broadcast(least), F.col("seq") <= F.col("n")).drop("n"))  # one row


@query("bounded_reorder_whole")
def bounded_reorder_whole(spark, sf_dir):
    """The same over whole streams: one that ends at 5 of ten ends with a packet that no other waits for."""
    return swapped(profiles(spark, sf_dir).select(F.col("stream_id").alias("client_id"), "seq"))


def swapped(p: DataFrame) -> DataFrame:
    swap = F.when(F.col("seq") % 10 == 5, F.col("seq") + 1).when(F.col("seq") % 10 == 6, F.col("seq") - 1).otherwise(F.col("seq"))
    d = p.select("client_id", swap.alias("arrival"), "seq", F.when(F.col("seq") == 1, "snapshot").otherwise("delta").alias("kind"), (F.col("seq") - 1).alias("base_seq"))
    return subscribe.fold(d, reorder=64, gap=8).select("client_id", "seq", "outcome")


ROUTES = [("v1", "v2", '"label":"migrated"'), ("v2", "v3", '"tags":[]')]


@query(
    "schema_migration",
    f"""WITH {TEXT_SQL}, s AS (SELECT stream_id, seq, state AS value, 'v' || (1 + seq % 3) AS schema, 'v' || (1 + (seq + stream_id) % 3) AS target, CASE WHEN seq % 4 = 0 THEN 'delta' ELSE 'snapshot' END AS kind FROM texts),
 r AS (SELECT unnest(['v1', 'v2']) AS f, unnest(['v2', 'v3']) AS t, unnest(['"label":"migrated"', '"tags":[]']) AS a)
 SELECT stream_id, seq, kind, CASE WHEN schema = target THEN 'applied' WHEN kind = 'delta' THEN 'need_snapshot' WHEN a IS NULL THEN 'SchemaMigrationMissing' ELSE 'migrated' END AS outcome,
 CASE WHEN schema = target THEN value WHEN kind = 'snapshot' AND a IS NOT NULL THEN substr(value, 1, length(value) - 1) || ',' || a || '}}' END AS migrated FROM s LEFT JOIN r ON schema = f AND target = t""",
)
def schema_migration(spark, sf_dir):
    s = streams.with_text(profiles(spark, sf_dir))
    name = lambda n: F.concat(F.lit("v"), (F.lit(1) + n % 3).cast("string"))
    states = s.select("stream_id", "seq", F.col("state").alias("value"), name(F.col("seq")).alias("schema"), name(F.col("seq") + F.col("stream_id")).alias("target"), F.when(F.col("seq") % 4 == 0, "delta").otherwise("snapshot").alias("kind"))
    routes = spark.createDataFrame(ROUTES, "from_schema string, to_schema string, add string")
    return subscribe.migrate(states, routes).select("stream_id", "seq", "kind", "outcome", "migrated")


@query("decode_limits", f"WITH {TEXT_SQL} SELECT stream_id, seq, CASE WHEN strlen(state) > 110 THEN 'PacketTooLarge' END AS error FROM texts")
def decode_limits(spark, sf_dir):
    """A subscriber's own cap on payloads."""
    t = streams.with_text(profiles(spark, sf_dir))
    return t.select("stream_id", "seq", F.when(F.octet_length("state") > 110, F.lit("PacketTooLarge")).alias("error"))


@query(
    "epoch_restart",
    f"""WITH {PROFILE_SQL}, sent AS (SELECT stream_id AS client_id, (seq - 1) // 20 AS epoch, (seq - 1) % 20 + 1 AS n, seq FROM profile WHERE seq % 7 <> 0),
 d AS (SELECT client_id, epoch, n, seq * 2 AS arrival FROM sent UNION ALL SELECT client_id, epoch, greatest(n - 3, 1), seq * 2 + 1 FROM sent WHERE seq % 5 = 0),
 t AS (SELECT *, max(n) OVER (PARTITION BY client_id, epoch ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM d)
 SELECT client_id, epoch, n AS seq, arrival FROM t WHERE top IS NULL OR n > top""",
)
def epoch_restart(spark, sf_dir):
    """A publisher that begins anew every 20 packets, at sequence 1, and repeats older packets: each epoch is suppressed by itself."""
    p = profiles(spark, sf_dir).where("seq % 7 != 0").select(F.col("stream_id").alias("client_id"), F.expr("(seq - 1) div 20").alias("epoch"), ((F.col("seq") - 1) % 20 + 1).alias("n"), "seq")
    first = p.select("client_id", "epoch", F.col("n").alias("seq"), (F.col("seq") * 2).alias("arrival"))
    again = p.where("seq % 5 = 0").select("client_id", "epoch", F.greatest(F.col("n") - 3, F.lit(1)).alias("seq"), (F.col("seq") * 2 + 1).alias("arrival"))
    return subscribe.without_repeats(first.unionByName(again), "client_id", "epoch").select("client_id", "epoch", "seq", "arrival")


def wires(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each profile's packet on the wire: a snapshot at 1 and every eleventh, else a splice delta on the state before: stream_id, seq, wire."""
    t = streams.with_text(profiles(spark, sf_dir)).select("stream_id", "seq", F.col("state").cast("binary").alias("state"))
    both = streams.with_previous(t)
    whole = (F.col("seq") == 1) | (F.col("seq") % 11 == 0)
    payload = F.when(whole, F.col("state")).otherwise(udfs.delta_bytes("splice")("prev_state", "state"))
    made = both.select("stream_id", "seq", F.when(whole, "snapshot").otherwise("delta").alias("kind"), payload.alias("payload"), udfs.fnv1a64_hex(F.when(whole, F.col("state")).otherwise(F.col("prev_state"))).alias("hash"))
    wire = udfs.encode_packet("kind", "seq", F.when(F.col("kind") == "snapshot", F.lit(0)).otherwise(F.col("seq") - 1), "hash", F.lit("0" * 16), "payload")
    return made.select("stream_id", "seq", wire.alias("wire"))


@query(
    "receiver_states",
    f"""WITH {TEXT_SQL}, {DELIVERIES_SQL}, per AS (SELECT client_id, count(*) FILTER (WHERE outcome = 'applied') AS applied, count(*) FILTER (WHERE outcome = 'duplicate') AS duplicates, count(*) FILTER (WHERE outcome = 'need_snapshot') AS refused, max(seq) FILTER (WHERE outcome = 'applied') AS local_seq FROM outcomes GROUP BY client_id)
 SELECT client_id, applied, duplicates, refused, local_seq, {HASH_SQL.format(x='state')} AS state_hash FROM per JOIN texts ON stream_id = client_id AND seq = local_seq""",
)
def receiver_states(spark, sf_dir):
    """Real packets, lost and repeated as in the delivery log, through receivers that hold states: what each ends with."""
    w = wires(spark, sf_dir).where("seq % 7 != 0").select(F.col("stream_id").alias("client_id"), F.lit(0).cast("long").alias("epoch"), "seq", (F.col("seq") * 2).alias("arrival"), "wire")
    log = w.unionByName(w.where("seq % 5 = 0").withColumn("arrival", F.col("arrival") + 1))
    got = subscribe.receive(log, 0)
    n = lambda x: F.count_if(F.col("outcome") == x)
    return got.groupBy("client_id").agg(n("applied").alias("applied"), n("duplicate").alias("duplicates"), n("need_snapshot").alias("refused"), F.max_by("local_seq", "arrival").alias("local_seq"), F.max_by("state_hash", "arrival").alias("state_hash"))


@query("decode_limits_wire", f"WITH {TEXT_SQL} SELECT stream_id, seq, CASE WHEN strlen(state) > 110 THEN 'PacketTooLarge' END AS error FROM texts")
def decode_limits_wire(spark, sf_dir):
    """Every state as a snapshot packet through a decoder with a cap of 110 bytes on payloads."""
    t = streams.with_text(profiles(spark, sf_dir)).select("stream_id", "seq", F.col("state").cast("binary").alias("state"))
    zero = F.lit("0" * 16)
    return t.select("stream_id", "seq", udfs.packet_error(110)(udfs.encode_packet(F.lit("snapshot"), "seq", F.lit(0), zero, zero, "state")).alias("error"))


# ---- recovery ----------------------------------------------------------------------

PACKETS_SQL = CHOICE_SQL + ", packets AS (SELECT stream_id, seq, CASE WHEN mode = 'snapshot' THEN 0 ELSE seq - 1 END AS base_seq, selected_bytes AS encoded_len, snapshot_bytes FROM chosen)"
HISTORY_SQL = PACKETS_SQL + """, held AS (SELECT *, row_number() OVER w AS back, sum(encoded_len) OVER (PARTITION BY stream_id ORDER BY seq DESC ROWS UNBOUNDED PRECEDING) AS bytes FROM packets WINDOW w AS (PARTITION BY stream_id ORDER BY seq DESC)),
 history AS (SELECT stream_id, seq, base_seq, encoded_len FROM held WHERE back <= 32 AND bytes <= 4096)"""
PLANS_SQL = HISTORY_SQL + """, last AS (SELECT stream_id, max(seq) AS target_seq, arg_max(snapshot_bytes, seq) AS snapshot_bytes FROM packets GROUP BY stream_id),
 asked AS (SELECT stream_id * 1000 + gap AS client_id, stream_id, CASE WHEN gap < 100 THEN target_seq - gap END AS local_seq, target_seq, snapshot_bytes, gap FROM last CROSS JOIN (SELECT unnest([0, 1, 2, 5, 10, 25, 50, 100]) AS gap)),
 found AS (SELECT a.client_id, count(*) AS n, bool_and(h.base_seq = h.seq - 1) AS chained, sum(h.encoded_len) AS bytes FROM asked a JOIN history h ON a.stream_id = h.stream_id AND h.seq > a.local_seq AND h.seq <= a.target_seq GROUP BY a.client_id),
 plans AS (SELECT a.*, CASE WHEN coalesce(a.local_seq < a.target_seq AND n = a.target_seq - a.local_seq AND chained AND bytes < snapshot_bytes, FALSE) THEN bytes END AS replay FROM asked a LEFT JOIN found f ON a.client_id = f.client_id)"""


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = select.four_way(profiles(spark, sf_dir))
    base = F.when(F.col("mode") == "snapshot", F.lit(0)).otherwise(F.col("seq") - 1)
    return d.select("stream_id", "seq", base.alias("base_seq"), F.col("selected_bytes").alias("encoded_len"), F.col("snapshot_bytes").alias("state_bytes"))


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recover.retained(packets(spark, sf_dir), 32, 4096)


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clients some packets behind each stream's last, and one that has nothing."""
    last = packets(spark, sf_dir).groupBy("stream_id").agg(F.max("seq").alias("target_seq"), F.max_by("state_bytes", "seq").alias("snapshot_bytes"))
    gaps = F.explode(F.array(*map(F.lit, (0, 1, 2, 5, 10, 25, 50, 100)))).alias("gap")
    rows = last.select("stream_id", "target_seq", "snapshot_bytes", gaps)
    return rows.select((F.col("stream_id") * 1000 + F.col("gap")).alias("client_id"), "stream_id", F.when(F.col("gap") < 100, F.col("target_seq") - F.col("gap")).alias("local_seq"), "target_seq", "snapshot_bytes")


@query("history_retention", f"WITH {HISTORY_SQL} SELECT stream_id, seq, CAST(base_seq AS BIGINT) AS base_seq, CAST(encoded_len AS BIGINT) AS encoded_len FROM history")
def history_retention(spark, sf_dir):
    return history(spark, sf_dir).select("stream_id", "seq", F.col("base_seq").cast("long").alias("base_seq"), "encoded_len")


@query("replay_plans", f"WITH {PLANS_SQL} SELECT client_id, stream_id, local_seq, target_seq, CASE WHEN replay IS NULL THEN 'snapshot' ELSE 'replay' END AS strategy, CAST(coalesce(replay, snapshot_bytes) AS BIGINT) AS cost_bytes FROM plans")
def replay_plans(spark, sf_dir):
    return recover.replay_plans(history(spark, sf_dir), requests(spark, sf_dir)).drop("snapshot_bytes")


@query("recovery_matrix", f"WITH {PLANS_SQL} SELECT CAST(gap AS INTEGER) AS gap, CASE WHEN replay IS NULL THEN 'snapshot' ELSE 'replay' END AS strategy, count(*) AS clients, CAST(sum(coalesce(replay, snapshot_bytes)) AS BIGINT) AS bytes FROM plans GROUP BY ALL")
def recovery_matrix(spark, sf_dir):
    p = recover.replay_plans(history(spark, sf_dir), requests(spark, sf_dir))
    return p.groupBy((F.col("client_id") % 1000).cast("int").alias("gap"), "strategy").agg(F.count("*").alias("clients"), F.sum("cost_bytes").alias("bytes"))


@query("three_way_plans", f"""WITH {PLANS_SQL}, c AS (SELECT client_id, CASE WHEN gap < 100 THEN (client_id * 37) % 300 END AS repair_bytes FROM asked)
 SELECT p.client_id, CASE WHEN coalesce(repair_bytes < coalesce(replay, snapshot_bytes), FALSE) THEN 'partial' WHEN replay IS NULL THEN 'snapshot' ELSE 'replay' END AS strategy,
 CAST(CASE WHEN coalesce(repair_bytes < coalesce(replay, snapshot_bytes), FALSE) THEN repair_bytes ELSE coalesce(replay, snapshot_bytes) END AS BIGINT) AS cost_bytes FROM plans p JOIN c ON p.client_id = c.client_id""")
def three_way_plans(spark, sf_dir):
    """Replay, snapshot or chunk repair, whichever is least; repair costs are a made-up function of the client."""
    p = recover.replay_plans(history(spark, sf_dir), requests(spark, sf_dir))
    costs = p.select("client_id", F.when(F.col("local_seq").isNotNull(), F.col("client_id") * 37 % 300).alias("repair_bytes"))
    return recover.three_way(p, costs).select("client_id", "strategy", F.col("cost_bytes").cast("long").alias("cost_bytes"))


@query(
    "three_way_repair",
    f"""WITH {PLANS_SQL}, both_texts AS (SELECT a.client_id, o.state AS old, n.state AS new FROM asked a JOIN texts o ON o.stream_id = a.stream_id AND o.seq = a.local_seq JOIN texts n ON n.stream_id = a.stream_id AND n.seq = a.target_seq),
 parts AS (SELECT client_id, i, nullif(substr(old, i * 32 + 1, 32), '') AS o, nullif(substr(new, i * 32 + 1, 32), '') AS n FROM (SELECT client_id, old, new, unnest(range(CAST(ceil(greatest(length(old), length(new)) / 32.0) AS BIGINT))) AS i FROM both_texts)),
 c AS (SELECT client_id, coalesce(sum(length(n)) FILTER (WHERE o IS DISTINCT FROM n), 0) AS repair_bytes FROM parts GROUP BY client_id)
 SELECT p.client_id, CASE WHEN coalesce(repair_bytes < coalesce(replay, snapshot_bytes), FALSE) THEN 'partial' WHEN replay IS NULL THEN 'snapshot' ELSE 'replay' END AS strategy,
 CAST(CASE WHEN coalesce(repair_bytes < coalesce(replay, snapshot_bytes), FALSE) THEN repair_bytes ELSE coalesce(replay, snapshot_bytes) END AS BIGINT) AS cost_bytes FROM plans p LEFT JOIN c ON p.client_id = c.client_id""",
)
def three_way_repair(spark, sf_dir):
    """Replay, snapshot or the repair of 32-byte chunks between the state a client has and its stream's last, whichever is least."""
    p = recover.replay_plans(history(spark, sf_dir), requests(spark, sf_dir))
    t = streams.with_text(profiles(spark, sf_dir)).select("stream_id", "seq", F.col("state").cast("binary").alias("state"))
    at = lambda c: p.select("client_id", "stream_id", F.col(c).alias("seq")).join(t, ["stream_id", "seq"]).select("client_id", "state")
    has = at("local_seq")
    costs = recover.repair_costs(has, at("target_seq").join(has.select("client_id"), "client_id", "left_semi"), "client_id", 32).drop("patches")
    return recover.three_way(p, costs).select("client_id", "strategy", F.col("cost_bytes").cast("long").alias("cost_bytes"))


@query("session_replies", f"WITH {PLANS_SQL} SELECT 'states.reply.' || p.client_id AS topic, h.seq, 'replay' AS kind FROM plans p JOIN history h ON h.stream_id = p.stream_id AND h.seq > p.local_seq AND h.seq <= p.target_seq WHERE replay IS NOT NULL UNION ALL SELECT 'states.reply.' || client_id, target_seq, 'snapshot' FROM plans WHERE replay IS NULL")
def session_replies(spark, sf_dir):
    """The packets that go out on each asking client's reply topic."""
    plans = recover.replay_plans(history(spark, sf_dir), requests(spark, sf_dir)).withColumn("reply_channel", F.concat(F.lit("states.reply."), F.col("client_id").cast("string")))
    log = wires(spark, sf_dir)
    last = log.groupBy("stream_id").agg(F.max_by("wire", "seq").alias("wire"))
    return session.replies(plans, log, last).select("topic", "seq", "kind")


@query("repair_verified", f"WITH s AS (SELECT a.item_id // 2 AS pair, b.text AS new FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id + 1 WHERE a.item_id % 2 = 0) SELECT pair, {HASH_SQL.format(x='new')} AS state_hash, CAST(NULL AS VARCHAR) AS error FROM s")
def repair_verified(spark, sf_dir):
    """Items repaired into the next ones by 64-byte chunks, each whole held against the authority's hash."""
    t = table(spark, sf_dir, "benchmark").select(F.floor(F.col("item_id") / 2).alias("pair"), (F.col("item_id") % 2).alias("side"), F.coalesce("text", F.lit("")).cast("binary").alias("state"))
    old, new = (t.where(F.col("side") == i).drop("side") for i in (0, 1))
    old, new = old.join(new.select("pair"), "pair", "left_semi"), new.join(old.select("pair"), "pair", "left_semi")
    goal = new.select("pair", F.octet_length("state").alias("target_len"), udfs.fnv1a64_hex("state").alias("target_hash"))
    out = recover.apply_repair(old, recover.repair(old, new, "pair", 64), goal, "pair", 64)
    return out.select("pair", udfs.fnv1a64_hex("state").alias("state_hash"), "error")


SIDES_SQL = """sides AS (SELECT a.doc_id // 2 AS pair, coalesce(a.text, '') AS old, coalesce(b.text, '') AS new FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1 WHERE a.doc_id % 2 = 0),
 hexed AS (SELECT pair, hex(encode(old)) AS old, hex(encode(new)) AS new FROM sides),
 idx AS (SELECT pair, old, new, unnest(range(CAST(ceil(greatest(length(old), length(new)) / 2048.0) AS BIGINT))) AS i FROM hexed),
 parts AS (SELECT pair, i, nullif(substr(old, i * 2048 + 1, 2048), '') AS o, nullif(substr(new, i * 2048 + 1, 2048), '') AS n FROM idx),
 differ AS (SELECT * FROM parts WHERE o IS DISTINCT FROM n)"""


def sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Documents of even number as receivers, the next ones as the authority."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("state"))
    even = d.where("doc_id % 2 = 0").select(F.floor(F.col("doc_id") / 2).alias("pair"), "state")
    odd = d.where("doc_id % 2 = 1").select(F.floor(F.col("doc_id") / 2).alias("pair"), "state")
    return even.join(odd.select("pair"), "pair", "left_semi"), odd.join(even.select("pair"), "pair", "left_semi")


@query("chunk_manifest", f"WITH t AS (SELECT item_id, text, unnest(range(CAST(ceil(strlen(text) / 64.0) AS BIGINT))) AS idx FROM benchmark), h AS (SELECT item_id, idx, decode(unhex(substr(hex(encode(text)), idx * 128 + 1, 128))) AS part FROM t WHERE strlen(text) = length(text)) SELECT item_id, CAST(idx AS INTEGER) AS idx, {HASH_SQL.format(x='part')} AS hash FROM h")
def chunk_manifest(spark, sf_dir):
    """Hashes of 64-byte chunks of the items of one byte a character (a chunk of others may end inside one, which the SQL can't cut)."""
    b = table(spark, sf_dir, "benchmark").where("octet_length(text) = length(text)").select("item_id", F.col("text").cast("binary").alias("state"))
    return recover.manifest(b, "item_id", 64)


@query("chunk_manifest_whole")
def chunk_manifest_whole(spark, sf_dir):
    """The same of all items, whatever their characters; a chunk may end inside one. A null or empty text has no chunks."""
    return recover.manifest(table(spark, sf_dir, "benchmark").select("item_id", F.col("text").cast("binary").alias("state")), "item_id", 64)


@query("manifest_diff", f"WITH {SIDES_SQL} SELECT pair, CAST(i AS INTEGER) AS idx FROM differ")
def manifest_diff(spark, sf_dir):
    return recover.differing(*sides(spark, sf_dir), "pair").select("pair", "idx")


@query("repair_patches", f"WITH {SIDES_SQL} SELECT pair, CAST(i AS INTEGER) AS idx, lower(coalesce(n, '')) AS patch FROM differ")
def repair_patches(spark, sf_dir):
    return recover.repair(*sides(spark, sf_dir), "pair").select("pair", "idx", F.lower(F.hex("bytes")).alias("patch"))


@query("repair_costs", f"WITH {SIDES_SQL} SELECT pair, count(i) AS patches, CAST(coalesce(sum(length(n) // 2), 0) AS BIGINT) AS repair_bytes FROM sides LEFT JOIN differ USING (pair) GROUP BY pair")
def repair_costs(spark, sf_dir):
    return recover.repair_costs(*sides(spark, sf_dir), "pair")


@query("repair_applied", f"WITH {SIDES_SQL} SELECT pair, new AS state FROM sides")
def repair_applied(spark, sf_dir):
    """Every receiver holds the authority's state after repair."""
    old, new = sides(spark, sf_dir)
    lengths = new.select("pair", F.octet_length("state").alias("target_len"))
    return recover.apply_repair(old, recover.repair(old, new, "pair"), lengths, "pair").select("pair", F.decode("state", "UTF-8").alias("state"))


@query("backpressure", "SELECT o_orderkey AS client_id, CASE WHEN o_orderkey % 13 = 0 THEN 'snapshot_and_catch_up' WHEN greatest(200000 - o_custkey * 130, 0) <= 10000 THEN 'accept' WHEN greatest(200000 - o_custkey * 130, 0) <= 100000 THEN 'snapshot_and_catch_up' ELSE 'drop_client' END AS decision FROM orders")
def backpressure(spark, sf_dir):
    local = F.when(F.col("o_orderkey") % 13 != 0, F.col("o_custkey") * 130)
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("client_id"), X.backpressure(local, F.lit(200000)).alias("decision"))


@query("shared_snapshots", f"WITH {PLANS_SQL} SELECT client_id, p.stream_id, l.target_seq AS snapshot_seq, CAST(l.snapshot_bytes AS BIGINT) AS snapshot_bytes FROM plans p JOIN last l ON p.stream_id = l.stream_id WHERE replay IS NULL")
def shared_snapshots(spark, sf_dir):
    """One snapshot for each stream, given to all of its clients that need one."""
    p = recover.replay_plans(history(spark, sf_dir), requests(spark, sf_dir)).where("strategy = 'snapshot'").select("client_id", "stream_id")
    return recover.shared_snapshot(p, packets(spark, sf_dir)).select("client_id", "stream_id", "snapshot_seq", "snapshot_bytes")


@query("recovery_snapshots", f"WITH {PACKETS_SQL} SELECT stream_id, max(seq) AS sequence, CAST(arg_max(snapshot_bytes, seq) AS BIGINT) AS bytes FROM packets GROUP BY stream_id")
def recovery_snapshots(spark, sf_dir):
    """Each stream's state as a snapshot at its current sequence, which doesn't move."""
    return packets(spark, sf_dir).groupBy("stream_id").agg(F.max("seq").alias("sequence"), F.max_by("state_bytes", "seq").alias("bytes"))


@query("forced_snapshots", f"WITH {PACKETS_SQL} SELECT stream_id, CAST(max(seq) + 1 AS BIGINT) AS sequence, 'snapshot' AS kind, CAST(arg_max(snapshot_bytes, seq) AS BIGINT) AS bytes FROM packets GROUP BY stream_id")
def forced_snapshots(spark, sf_dir):
    """One more packet for each stream: its state again as a snapshot, at the next sequence."""
    return packets(spark, sf_dir).groupBy("stream_id").agg((F.max("seq") + 1).alias("sequence"), F.lit("snapshot").alias("kind"), F.max_by("state_bytes", "seq").alias("bytes"))


# ---- replicas ----------------------------------------------------------------------

K_SQL = r"CAST(regexp_extract(props, '\"k\":\s*(-?[0-9]+)', 1) AS BIGINT)".replace('\\"', '"')


def increments(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("decimal(20,0)")
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("counter"), F.col("user_id").cast("string").alias("replica"), k.alias("amount"), "event_id")


@query("gcounter_components", f"SELECT event_type AS counter, CAST(user_id AS VARCHAR) AS replica, CAST(sum({K_SQL}) AS BIGINT) AS amount FROM events GROUP BY ALL")
def gcounter_components(spark, sf_dir):
    return crdt.increments(increments(spark, sf_dir), "counter").select("counter", "replica", F.col("amount").cast("long").alias("amount"))


def _states(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Two replicas' views: after all events, and after those of even number."""
    rows = increments(spark, sf_dir)
    return crdt.increments(rows, "counter"), crdt.increments(rows.where("event_id % 2 = 0"), "counter")


@query("gcounter_merge", f"SELECT event_type AS counter, CAST(user_id AS VARCHAR) AS replica, CAST(sum({K_SQL}) AS BIGINT) AS amount FROM events GROUP BY ALL")
def gcounter_merge(spark, sf_dir):
    """Merging an older view changes nothing."""
    a, b = _states(spark, sf_dir)
    return crdt.merge(a.unionByName(b), "counter").select("counter", "replica", F.col("amount").cast("long").alias("amount"))


@query("gcounter_changed", f"WITH a AS (SELECT event_type AS counter, user_id, sum({K_SQL}) AS x, coalesce(sum({K_SQL}) FILTER (WHERE event_id % 2 = 0), 0) AS y FROM events GROUP BY ALL) SELECT counter, bool_or(x > y) AS changed FROM a GROUP BY counter")
def gcounter_changed(spark, sf_dir):
    a, b = _states(spark, sf_dir)
    return crdt.changed_by_merge(b, a, "counter")


@query("gcounter_value", f"SELECT event_type AS counter, CAST(sum({K_SQL}) AS BIGINT) AS value FROM events GROUP BY ALL")
def gcounter_value(spark, sf_dir):
    return crdt.value(crdt.increments(increments(spark, sf_dir), "counter"), "counter").select("counter", F.col("value").cast("long").alias("value"))


@query("pncounter_value", f"SELECT user_id, CAST(sum(CASE WHEN event_type IN ('purchase', 'signup') THEN {K_SQL} ELSE -{K_SQL} END) AS BIGINT) AS value FROM events GROUP BY user_id")
def pncounter_value(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", F.when(F.col("event_type").isin("purchase", "signup"), "positive").otherwise("negative").alias("side"), F.col("event_type").alias("replica"), F.get_json_object("props", "$.k").cast("decimal(20,0)").alias("amount"))
    return crdt.pn_value(crdt.increments(rows, "user_id", "side"), "user_id").select("user_id", F.col("value").cast("long").alias("value"))


@query("lww_registers", "SELECT user_id, arg_max(event_type, event_id // 10 * 100000000 + event_id % 10 * 1000000 + event_id) AS value, max(event_id // 10) AS ts FROM events GROUP BY user_id")
def lww_registers(spark, sf_dir):
    """Writes in logical time, ten at a tick; among those of a tick the replica decides."""
    rows = table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("value"), F.floor(F.col("event_id") / 10).alias("ts"), F.concat(F.lit("r"), (F.col("event_id") % 10).cast("string")).alias("replica"))
    return crdt.lww(rows, "user_id").select("user_id", "value", "ts")


@query("crdt_documents", f"""WITH c AS (SELECT event_type AS counter, CAST(user_id AS VARCHAR) AS replica, sum({K_SQL}) AS amount FROM events GROUP BY ALL) SELECT counter, '{{"components":{{' || string_agg('"' || replica || '":' || CAST(amount AS VARCHAR), ',' ORDER BY replica) || '}}}}' AS document FROM c GROUP BY counter""")
def crdt_documents(spark, sf_dir):
    return crdt.encode(crdt.increments(increments(spark, sf_dir), "counter"), "counter")


@query("crdt_decoded", f"SELECT event_type AS counter, CAST(user_id AS VARCHAR) AS replica, CAST(sum({K_SQL}) AS BIGINT) AS amount FROM events GROUP BY ALL")
def crdt_decoded(spark, sf_dir):
    """Counters travel in parts: a whole one of some 87,000 replicas or more is over the decoder's cap."""
    c = crdt.encode_parts(crdt.increments(increments(spark, sf_dir), "counter"), "counter")
    return crdt.decode(c, "counter").select("counter", "replica", F.col("amount").cast("long").alias("amount"))


# ---- workloads ---------------------------------------------------------------------


@query("demo_records", "SELECT i AS step, least(42 + i, 100) AS progress, 18492 + 128 * i AS tokens, CAST(4812 AS BIGINT) AS memory_mb, 173 + i AS files_processed, 'agent-17' AS agent_id, 'qwen3-coder' AS model, 'running' AS status, 'analyze repository' AS task, 'src/engine/parser.rs' AS current_file FROM range(1000) t(i)")
def demo_records(spark, sf_dir):
    return simulate.demo_records(spark, 1000)


@query("demo_cpu", "WITH RECURSIVE r AS (SELECT CAST(0 AS BIGINT) AS step, CAST(34.2 AS FLOAT) AS x UNION ALL SELECT step + 1, CAST((x + CAST(1.9 AS FLOAT)) % CAST(100 AS FLOAT) AS FLOAT) FROM r WHERE step < 999) SELECT step, CAST(x AS DOUBLE) AS cpu_percent FROM r")
def demo_cpu(spark, sf_dir):
    """The demonstration record's float field, a recurrence in single precision."""
    return spark.createDataFrame(list(enumerate(simulate.cpu_percent(1000))), "step long, cpu_percent double")


@query("fault_events", """WITH x AS (SELECT c, u FROM range(100) a(c), range(1000) b(u) WHERE u > 0)
 SELECT count(*) FILTER (WHERE (u + 13 * c) % 997 = 0) AS disconnects, count(*) FILTER (WHERE (u + 17 * c) % 211 = 0) AS drops, count(*) FILTER (WHERE (u + 19 * c) % 389 = 0) AS holds, count(*) FILTER (WHERE (u + 23 * c) % 307 = 0) AS repeats, count(*) FILTER (WHERE (u + 31 * c) % 1237 = 0) AS corruptions, count(*) FILTER (WHERE (u + 29 * c) % 10007 = 0) AS long_outages FROM x""")
def fault_events(spark, sf_dir):
    e = simulate.fault_events(spark, 100, 1000)
    names = (("disconnect", "disconnects"), ("drop", "drops"), ("hold", "holds"), ("repeat", "repeats"), ("corrupt", "corruptions"), ("long_outage", "long_outages"))
    return e.agg(*(F.count_if(c).alias(n) for c, n in names))


@query("chaos", """WITH u AS (SELECT i, i > 0 AND i % 97 = 0 AS lost FROM range(10000) t(i)) SELECT count(*) AS generated, count(*) FILTER (WHERE lost) AS dropped, count(*) FILTER (WHERE NOT lost) AS delivered, count(*) FILTER (WHERE NOT lost AND i > 0 AND i % 131 = 0) AS duplicates,
 count(*) FILTER (WHERE NOT lost AND i > 1 AND (i - 1) % 97 = 0) AS resyncs, max(i + 1) AS final_sequence FROM u""")
def chaos(spark, sf_dir):
    return simulate.chaos(spark, 10_000)


MULTI_CLIENT_SQL = """WITH x AS (SELECT c, u FROM range(100) a(c), range(2000) b(u)),
 e AS (SELECT *, u > 0 AND (u + 13 * c) % 997 = 0 AS cut, max(CASE WHEN u > 0 AND (u + 13 * c) % 997 = 0 THEN u END) OVER (PARTITION BY c ORDER BY u) AS cut_at FROM x),
 l AS (SELECT *, coalesce(u < cut_at + 5, FALSE) OR u > 0 AND (u + 17 * c) % 211 = 0 AS lost FROM e),
 came AS (SELECT *, u > 0 AND (u + 19 * c) % 389 = 0 AS held FROM l WHERE NOT lost),
 d AS (SELECT *, lag(held) OVER w AS after_held FROM came WINDOW w AS (PARTITION BY c ORDER BY u)),
 g AS (SELECT *, u > 0 AND lag(u) OVER (PARTITION BY c ORDER BY u) IS DISTINCT FROM u - 1 AS gap, u > 0 AND (u + 23 * c) % 307 = 0 AS twice FROM d WHERE NOT held),
 f AS (SELECT c, max(u) AS last FROM g GROUP BY c)
 SELECT CAST(100 AS BIGINT) AS clients, (SELECT count(*) FROM g) AS deliveries, (SELECT count(*) FROM l WHERE lost) AS drops, (SELECT count(*) FILTER (WHERE twice) + count(*) FILTER (WHERE after_held) FROM g) AS duplicates, (SELECT count(*) FROM g WHERE gap) AS resyncs,
 (SELECT count(*) FROM came WHERE held) AS reorders, (SELECT count(*) FROM l WHERE cut) AS disconnects, CAST(0 AS BIGINT) AS buffered, CAST(0 AS BIGINT) AS corruptions, CAST(0 AS BIGINT) AS late_joins, CAST(0 AS BIGINT) AS long_disconnects, CAST(0 AS BIGINT) AS storm,
 (SELECT count(DISTINCT u) FROM g WHERE gap) AS shared_snapshots, (SELECT count(*) FROM f WHERE last = 1999) AS in_step, CAST(100 AS BIGINT) AS converged"""
FAST_COUNTS_SQL = """WITH x AS (SELECT c, u, 1 + c % 97 AS j FROM range(100) a(c), range(1, 2001) b(u)),
 e AS (SELECT *, (u + 17 * c) % 211 = 0 AS lost FROM x WHERE u > j OR (u = j AND j = 1)),
 h AS (SELECT *, (u + 13 * c) % 509 = 0 AS held, (u + 13 * c) % 509 <> 0 AND (u + 19 * c) % 997 = 0 AS hurt FROM e WHERE NOT lost),
 settled AS (SELECT c, u, NOT hurt AS came FROM h WHERE NOT held UNION ALL SELECT c, u, FALSE FROM x WHERE u = j AND j > 1),
 g AS (SELECT *, came AND u > 1 AND lag(u) OVER (PARTITION BY c ORDER BY u) IS DISTINCT FROM u - 1 AS gap FROM settled)
 SELECT (SELECT count(*) FROM e WHERE lost) AS drops, (SELECT count(*) FROM g WHERE came AND (u + 23 * c) % 701 = 0) AS duplicates, (SELECT count(*) FROM g WHERE gap) AS resyncs, (SELECT count(*) FROM h WHERE held) AS reorders,
 (SELECT count(*) FROM h WHERE hurt) AS corruptions, (SELECT count(*) FROM x WHERE u = j AND j > 1) AS late_joins, CAST(100 AS BIGINT) AS converged"""


@query("simulate_multi_client", MULTI_CLIENT_SQL)
def simulate_multi_client(spark, sf_dir):
    """100 clients and 2,000 updates: outages, drops, held and repeated packets, real ones through receivers that hold states."""
    return simulate.simulate(spark, "multi_client", 100, 2000)


@query("simulate_torture")
def simulate_torture(spark, sf_dir):
    """The same with late joins, long outages, damaged packets, waiting packets and one outage of all."""
    return simulate.simulate(spark, "torture", 100, 2000)


@query("simulate_fast_torture")
def simulate_fast_torture(spark, sf_dir):
    """The byte-state workload, with late joins and damaged packets."""
    return simulate.simulate(spark, "fast_torture", 100, 2000)


@query("fast_torture_counts", FAST_COUNTS_SQL)
def fast_torture_counts(spark, sf_dir):
    """Those of its counts that follow from the faults alone."""
    return simulate_fast_torture(spark, sf_dir).select("drops", "duplicates", "resyncs", "reorders", "corruptions", "late_joins", "converged")


@query("fast_encoder_matrix")
def fast_encoder_matrix(spark, sf_dir):
    """Sizes by change rates: bytes and saving of the fast encoder over high-entropy states."""
    parts = []
    for size in (256, 4096, 16384):
        for percent in (0.1, 1.0, 10.0):
            chosen = select.fast_with_memory(simulate.byte_workload(spark, 4, size, 16, percent))
            parts.append(chosen.agg(F.lit(size).alias("size"), F.lit(percent).alias("percent"), F.count("*").alias("updates"), F.sum("selected_bytes").alias("wire_bytes"), F.round(F.avg("considered"), 4).alias("considered")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


SPARSE_SIZES, SPARSE_RATES = [250, 500, 1024, 1800, 2048, 4096, 8192, 16384, 30000], [1, 5, 10, 25, 50, 100]
ENTROPY_SIZES, ENTROPY_RATES = [256, 1024, 16_384, 102_400], [0.1, 1.0, 5.0, 25.0, 100.0]


def _varint_sql(x: str) -> str:
    return f"CASE WHEN {x} < 128 THEN 1 WHEN {x} < 16384 THEN 2 ELSE 3 END"


@query(
    "sparse_matrix",
    f"""WITH s AS (SELECT size, pct, greatest((size * pct + 99) // 100, 1) AS c FROM (SELECT unnest({SPARSE_SIZES}) AS size) CROSS JOIN (SELECT unnest({SPARSE_RATES}) AS pct)),
 u AS (SELECT size, pct, c, i, i % size AS p, greatest(i % size + c - size, 0) AS e FROM s CROSS JOIN range(10000) t(i)),
 d AS (SELECT *, 46 + {_varint_sql("c")} + CASE WHEN e = 0 THEN {_varint_sql("p")} + 1 + 2 * (c - 1) ELSE 2 * e + {_varint_sql("(p - e + 1)")} + 1 + 2 * (size - p - 1) END AS delta FROM u),
 w AS (SELECT *, i > 0 AND delta < 46 + size AS smaller FROM d)
 SELECT CAST(size AS BIGINT) AS size, CAST(pct AS BIGINT) AS percent, CAST(sum(size) AS BIGINT) AS full_bytes, CAST(sum(CASE WHEN smaller THEN delta ELSE 46 + size END) AS BIGINT) AS wire_bytes, count(*) FILTER (WHERE smaller) AS deltas, count(*) FILTER (WHERE NOT smaller) AS snapshots FROM w GROUP BY size, pct""",
)
def sparse_matrix(spark, sf_dir):
    """Nine sizes by six change rates, 10,000 updates each, all encoded: the smaller of old sparse delta and snapshot."""
    return simulate.sparse_scenarios(spark, SPARSE_SIZES, SPARSE_RATES, 10_000)


@query("entropy_matrix")
def entropy_matrix(spark, sf_dir):
    """Four sizes by five change rates of high-entropy states, 100 updates each, by the exhaustive encoder with its compression tuner."""
    chosen = select.exhaustive_with_tuner(simulate.entropy_scenarios(spark, ENTROPY_SIZES, ENTROPY_RATES, 100))
    size, percent = (F.element_at(F.array(*map(F.lit, v)), (i + 1).cast("int")) for v, i in ((ENTROPY_SIZES, F.floor(F.col("stream_id") / len(ENTROPY_RATES))), (ENTROPY_RATES, F.col("stream_id") % len(ENTROPY_RATES))))
    whole = F.col("mode").startswith("snapshot")
    rows = chosen.select(size.cast("long").alias("size"), percent.alias("percent"), "selected_bytes", whole.alias("whole"))
    return rows.groupBy("size", "percent").agg((F.first("size") * F.count("*")).alias("raw_bytes"), F.sum("selected_bytes").alias("wire_bytes"), F.count_if(~F.col("whole")).alias("deltas"), F.count_if("whole").alias("snapshots"))


@query("size_rate_matrix", "SELECT CAST(size AS BIGINT) AS size, CAST(pct AS INTEGER) AS percent, CAST(46 + size AS BIGINT) AS snapshot_bytes, CAST(greatest(size * pct // 100, 1) AS BIGINT) AS changed FROM (SELECT unnest([256, 1024, 4096, 16384, 65536, 102400, 262144, 524288, 1048576]) AS size) CROSS JOIN (SELECT unnest([0, 1, 5, 10, 25, 50]) AS pct)")
def size_rate_matrix(spark, sf_dir):
    """The parameter table of the codec matrix in closed form."""
    sizes = spark.createDataFrame([(s,) for s in (256, 1024, 4096, 16384, 65536, 102400, 262144, 524288, 1048576)], "size long")
    rows = sizes.select("size", F.explode(F.array(*map(F.lit, (0, 1, 5, 10, 25, 50)))).alias("percent"))
    return rows.select("size", "percent", (F.col("size") + 46).alias("snapshot_bytes"), F.greatest(F.floor(F.col("size") * F.col("percent") / 100), F.lit(1)).cast("long").alias("changed"))


@query("fast_select_with_memory")
def fast_select_with_memory(spark, sf_dir):
    return select.fast_with_memory(streams.transcripts(table(spark, sf_dir, "conversations")))


@query("exhaustive_with_tuner")
def exhaustive_with_tuner(spark, sf_dir):
    return select.exhaustive_with_tuner(streams.transcripts(table(spark, sf_dir, "conversations")))


@query("convergence", f"WITH {TEXT_SQL}, last AS (SELECT stream_id, arg_max(state, seq) AS f FROM texts GROUP BY 1) SELECT count(*) AS replicas, count(*) FILTER (WHERE state = f) AS converged FROM texts JOIN last USING (stream_id)")
def convergence(spark, sf_dir):
    """Replicas stopped at each sequence against their stream's final state."""
    t = streams.with_text(profiles(spark, sf_dir)).select("stream_id", "seq", "state")
    return metrics.converged(t, t.groupBy("stream_id").agg(F.max_by("state", "seq").alias("state")))


@query("check_report", f"WITH {CHOICE_SQL}, c AS (SELECT stream_id, bool_and(selected_bytes <= snapshot_bytes) AS ok FROM chosen GROUP BY stream_id) SELECT bool_and(ok) AS all_pass, count(*) AS checks FROM c")
def check_report(spark, sf_dir):
    """No stream's choice is ever larger than its snapshot."""
    d = select.four_way(profiles(spark, sf_dir))
    return metrics.all_pass(d.groupBy("stream_id").agg(F.bool_and(F.col("selected_bytes") <= F.col("snapshot_bytes")).alias("ok")))


# ---- sessions ----------------------------------------------------------------------


@query("capabilities", "SELECT 2 AS protocol_min, 3 AS protocol_max, TRUE AS adaptive_delta_snapshot, TRUE AS crc32, TRUE AS schema_hash, TRUE AS zstd, 67108864 AS max_wire_payload, 67108864 AS max_logical_payload, TRUE AS bounded_reorder_buffer, TRUE AS recovery_replay_planner")
def capabilities(spark, sf_dir):
    return spark.range(1).select(
        F.lit(2).alias("protocol_min"), F.lit(3).alias("protocol_max"), *(F.lit(True).alias(c) for c in ("adaptive_delta_snapshot", "crc32", "schema_hash", "zstd")),
        F.lit(64 << 20).alias("max_wire_payload"), F.lit(64 << 20).alias("max_logical_payload"), F.lit(True).alias("bounded_reorder_buffer"), F.lit(True).alias("recovery_replay_planner"),
    )


@query("session_topics", "SELECT c_custkey, 'states' AS data, 'states.control' AS control, 'states.reply.' || c_name AS reply FROM customer")
def session_topics(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", F.lit("states").alias("data"), F.lit("states.control").alias("control"), F.concat(F.lit("states.reply."), "c_name").alias("reply"))


@query("version_negotiation", "SELECT c_custkey, CASE WHEN c_custkey % 5 <= 3 AND c_custkey % 5 + c_custkey % 3 >= 3 THEN 3 END AS selected FROM customer")
def version_negotiation(spark, sf_dir):
    low = F.col("c_custkey") % 5
    return table(spark, sf_dir, "customer").select("c_custkey", X.negotiated(low, low + F.col("c_custkey") % 3).alias("selected"))


@query("control_messages", """SELECT client_id, selected_version FROM (SELECT c_name AS client_id, 3 AS selected_version, c_custkey % 5 AS lo, c_custkey % 5 + c_custkey % 3 AS hi FROM customer) WHERE lo <= 3 AND hi >= 3""")
def control_messages(spark, sf_dir):
    """Hellos as JSON over the control topic, and the publisher's answers to those it can serve."""
    low = F.col("c_custkey") % 5
    hello = F.to_json(F.struct(F.lit("hello").alias("type"), F.col("c_name").alias("client_id"), low.alias("min_version"), (low + F.col("c_custkey") % 3).alias("max_version"), F.concat(F.lit("states.reply."), "c_name").alias("reply_channel")))
    bus = table(spark, sf_dir, "customer").select(F.lit("states.control").alias("topic"), hello.cast("binary").alias("payload"))
    acks = session.hello_acks(session.parse_control(session.subscribed(bus, ["states.control"])))
    return session.parse_control(acks).select("client_id", "selected_version")


_place = session.shared_place


@query("streaming_subscriber", _profile_only("SELECT CAST(client_id AS VARCHAR) AS client_id, seq, arrival, outcome FROM outcomes"))
def streaming_subscriber(spark, sf_dir):
    """The delivery log as a stream through live subscribers, none of whose packets may wait."""
    place = _place(spark)
    rows = deliveries(spark, sf_dir).select(F.col("client_id").cast("string").alias("client_id"), F.lit(0).cast("long").alias("epoch"), "seq", "kind", F.col("base_seq").cast("long").alias("base_seq"), "arrival")
    rows.write.parquet(f"{place}/in")
    out = session.run_to_table(spark, session.follow(spark.readStream.schema(rows.schema).parquet(f"{place}/in"), reorder=0), place)
    return out.select("client_id", "seq", "arrival", "outcome")


@query("published_packets", f"WITH {TEXT_SQL} SELECT stream_id, seq, CAST(46 + strlen(state) AS BIGINT) AS encoded_len FROM texts WHERE seq = 1 OR seq % 11 = 0")
def published_packets(spark, sf_dir):
    """Packets published to the log by micro-batches and read back: the lengths of its snapshots."""
    place = _place(spark)
    w = wires(spark, sf_dir)
    w.write.parquet(f"{place}/in")
    session.publish(spark.readStream.schema(w.schema).parquet(f"{place}/in"), f"{place}/log", f"{place}/progress").awaitTermination()
    log = spark.read.parquet(f"{place}/log").where("seq = 1 or seq % 11 = 0")
    return log.select("stream_id", "seq", F.octet_length("wire").cast("long").alias("encoded_len"))


@query("streaming_dedup", "SELECT event_id AS seq, user_id AS stream_id FROM events")
def streaming_dedup(spark, sf_dir):
    """Every event sent twice; repeats within the watermark are dropped."""
    place = _place(spark)
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("stream_id"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"))
    e.unionByName(e).write.parquet(f"{place}/in")
    out = session.run_to_table(spark, session.first_of_each(spark.readStream.schema(e.schema).parquet(f"{place}/in"), "ts", "3650 days"), place)
    return out.select("seq", "stream_id")


@query("local_bus", "SELECT 'ticks' AS topic, CAST(i AS VARCHAR) AS payload FROM range(1000) t(i)")
def local_bus(spark, sf_dir):
    """Messages of the in-process source, through the file bus."""
    transports.register(spark)
    place = _place(spark)
    got = session.run_to_table(spark, spark.readStream.format("local_bus").option("total", 1000).option("batch", 1000).load(), f"{place}/ticks")
    bus = transports.FileBus(spark, f"{place}/bus")
    bus.publish(got)
    bus.publish(got.withColumn("topic", F.lit("other")))
    out = session.run_to_table(spark, bus.subscribe(["ticks"]), f"{place}/got")
    return out.select("topic", F.decode("payload", "UTF-8").alias("payload"))


def _own_host(spark: SparkSession) -> str:
    """Where executors reach the driver."""
    return "127.0.0.1" if spark.sparkContext.master.startswith("local") else spark.conf.get("spark.driver.host")


@query("websocket_relay", "SELECT 'nations.' || n_regionkey AS topic, n_name AS payload FROM nation WHERE n_regionkey <> 0")
def websocket_relay(spark, sf_dir):
    """Nations published by tasks through a WebSocket relay on the driver; a subscriber to four of the five regions' topics lands them as files."""
    place = _place(spark)
    table(spark, sf_dir, "nation").select(F.concat(F.lit("nations."), F.col("n_regionkey").cast("string")).alias("topic"), F.col("n_name").cast("binary").alias("payload")).write.parquet(f"{place}/in")
    bus = transports.FileBus(spark, f"{place}/bus")
    with brokers.Relay(_own_host(spark)) as relay:
        link = brokers.WebSocketLink(relay.url)
        landing = brokers.Landing(bus, link, [f"nations.{i}" for i in range(1, 5)])
        transports.send_each(spark.readStream.schema(session.MESSAGE).parquet(f"{place}/in"), link.connect, f"{place}/progress").awaitTermination()
    landing.stop()
    return spark.read.schema(session.MESSAGE).parquet(f"{place}/bus").select("topic", F.decode("payload", "UTF-8").alias("payload"))


@query("generated_states")
def generated_states(spark, sf_dir):
    """High-entropy states of both register forms and their scattered mutations, by hash and changed bytes."""
    from tidewright.functions.udfs import change_profile, fnv1a64_hex

    rows = []
    for name, shifts in (("wide", (13, 7, 17)), ("narrow", (7, 9, 8))):
        old = simulate.entropy_bytes(4096, shifts)
        rows += [(name, u, bytearray(old), bytearray(old := simulate.scattered(old, u, 41))) for u in range(8)]
    df = spark.createDataFrame(rows, "form string, step int, old binary, state binary")
    return df.select("form", "step", fnv1a64_hex("state").alias("hash"), change_profile("old", "state")["changed_bytes"].alias("changed_bytes"))
