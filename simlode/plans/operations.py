"""Sharding, mutation log, registry, cache and metrics, with the SQL each is checked against."""

from __future__ import annotations

from pyspark.sql import functions as F

from simlode import observe
from simlode.engine import PAYLOAD, VectorEngine, register_sql
from simlode.functions import vector as V
from simlode.operators import cache, evaluate, exact, mutation_log, registry
from simlode.operators.change_table import ChangeTable
from simlode.operators.ring import HashRing, distribution, moved
from simlode.session import settle, stream, table, work_path
from simlode.sources import dataset, files, results, synthetic, wal
from simlode.streaming import ingest

NODES = [f"worker_{i}" for i in range(1, 5)]
DIMENSION = 64


def _keys(spark, sf):
    return table(spark, sf, "stored_ids").where("id IS NOT NULL").select(F.col("id").alias("key")).distinct()


def _golden(spark):
    return spark.range(10_000).select(F.concat(F.lit("vec_"), F.col("id").cast("string")).alias("key"))


def ring_assign(spark, sf):
    return HashRing(NODES).assign(_keys(spark, sf), "key")


def ring_distribution(spark, sf):
    return distribution(HashRing(NODES).assign(_keys(spark, sf), "key"))


def ring_balance(spark, sf):
    return distribution(HashRing(NODES).assign(_keys(spark, sf), "key")).agg(F.round(F.stddev_pop("keys"), 6).alias("std"))


def ring_movement(spark, sf):
    both = HashRing(NODES[:3]).assign(HashRing(NODES).assign(_keys(spark, sf), "key", "a"), "key", "b")
    return moved(both, F.col("a"), F.col("b"))


def modulo_movement(spark, sf):
    keys = _keys(spark, sf).select(V.modulo_shard(F.col("key"), 4).alias("a"), V.modulo_shard(F.col("key"), 3).alias("b"))
    return moved(keys, F.col("a"), F.col("b"))


def ring_golden(spark, sf):
    """The published 10,000 keys: nodes before and after worker_4 leaves, ring and modulo."""
    keys = HashRing(NODES[:3]).assign(HashRing(NODES).assign(_golden(spark), "key", "before"), "key", "after")
    return keys.groupBy("before", "after").agg(F.count(F.lit(1)).alias("keys"))


def key_digests(spark, sf):
    k = F.col("key")
    return _keys(spark, sf).select("key", V.key_hash(k).alias("digest"), V.encode_key(k).alias("encoded"), V.decode_key(V.encode_key(k)).alias("decoded"), V.modulo_shard(k, 7).alias("shard"))


def _log(spark, sf):
    return table(spark, sf, "active_wal").select("seq", "shard", "op", "id", "vector")


def log_replay(spark, sf):
    return mutation_log.replay(_log(spark, sf), group=["shard"]).select("shard", "id", "seq")


def log_replay_whole(spark, sf):
    return mutation_log.replay(_log(spark, sf)).select("id", "seq")


def log_replay_bad_dim(spark, sf):
    cut = F.when(F.col("seq") % 11 == 0, F.slice("vector", 1, 7)).otherwise(F.col("vector"))
    return mutation_log.replay(_log(spark, sf).withColumn("vector", cut), group=["shard"]).select("shard", "id", "seq")


def snapshot_plus_log(spark, sf):
    """A snapshot of the first half, written and read again, and the log after it."""
    log = _log(spark, sf)
    half = (log.agg(F.max("seq")).first()[0] or 0) // 2
    snapshot = settle(mutation_log.replay(log.where(F.col("seq") <= half), group=["shard"]).drop("seq"), "snapshot")
    return mutation_log.replay(log.where(F.col("seq") > half), snapshot, ["shard"]).select("shard", "id")


def log_operations(spark, sf):
    return _log(spark, sf).groupBy("shard", "op").agg(F.count(F.lit(1)).alias("n"))


def insert_checked(spark, sf):
    batch = table(spark, sf, "insert_requests").select("request_no", "id", "vector")
    checked = mutation_log.accepted(batch, table(spark, sf, "stored_ids").select("id"), order="request_no")
    return checked.groupBy("reject").agg(F.count(F.lit(1)).alias("n"))


def metadata_fields(spark, sf):
    r = table(spark, sf, "insert_requests").select(F.get_json_object("metadata", "$.source").alias("source"), F.get_json_object("metadata", "$.n").cast("bigint").alias("n"))
    return r.groupBy("source").agg(F.count(F.lit(1)).alias("requests"), F.max("n").alias("max_n"))


def heartbeat_active(spark, sf):
    return registry.active_workers(table(spark, sf, "worker_heartbeats")).select("worker_id", "last_seen", "ttl")


def heartbeat_replicas(spark, sf):
    """Replicas alive at the time of the last replica's beat."""
    beats = table(spark, sf, "worker_heartbeats")
    now = beats.where("role = 'replica'").agg(F.max("last_seen")).first()[0] or 0.0
    return registry.replicas_of(registry.active_workers(beats.where(F.col("last_seen") <= now), now=now))


def worker_sessions(spark, sf):
    s = ingest.worker_sessions(table(spark, sf, "worker_heartbeats"), gap="600 seconds")
    return s.groupBy("worker_id").agg(F.count(F.lit(1)).alias("sessions"), F.max("beats").alias("most_beats"))


def cache_key_dedupe(spark, sf):
    distinct = cache.distinct_requests(table(spark, sf, "search_requests"))
    return distinct.groupBy("requests").agg(F.count(F.lit(1)).alias("keys"))


def latency_percentiles(spark, sf):
    return evaluate.latency_percentiles(table(spark, sf, "events"), "value", ["event_type"])


def request_rate_1m(spark, sf):
    rate = evaluate.rate_by_window(table(spark, sf, "events"), "ts", "1 minute", ["event_type"], "value")
    return rate.select(F.unix_timestamp("window_start").alias("minute"), "event_type", "requests", F.round("mean_value", 6).alias("mean_value"))


def cache_hit_ratio(spark, sf):
    hits, misses = (F.sum(F.when(F.col("event_type") == x, 1).otherwise(0)) for x in ("view", "error"))
    e = table(spark, sf, "events").groupBy("user_id").agg(hits.alias("h"), misses.alias("m"))
    return e.select("user_id", F.round(evaluate.hit_ratio(F.col("h"), F.col("m")), 6).alias("ratio"))


def metrics_long(spark, sf):
    wide = evaluate.latency_percentiles(table(spark, sf, "events"), "value", ["event_type"]).select("event_type", "n", "p50", "p95")
    long = evaluate.long_metrics(wide, "event_type", "ms")
    return long.withColumn("value", F.round(F.col("value").cast("double"), 6))


def stream_ingest(spark, sf):
    """The log as a stream of files into a bucketed table, by sequence."""
    lines = stream(spark, sf, "active_wal")
    store = ChangeTable(spark, work_path(spark, "stream"), int(spark.conf.get("spark.sql.shuffle.partitions")), PAYLOAD)
    ingest.ingest(lines, store, work_path(spark, "stream-checkpoint"), "shard").awaitTermination()
    return store.rows().select(F.col("grp").alias("shard"), F.col("key").alias("id"), "seq")


def stream_rates(spark, sf):
    """Requests per hour of the event stream: windows that the watermark has closed, without events later than it allows.

    The events come in three deliveries: those of the first half of the time and
    of the next quarter, then the rest with some that are late. The query is
    started anew for each and goes on from its checkpoint.
    """
    events = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    first, last = events.agg(F.min("ts"), F.max("ts")).first()
    path = work_path(spark, "rates")
    rates = lambda rows: ingest.request_rates(rows, width="1 hour", by=["event_type"])
    schema = rates(events).schema
    if first is not None:
        cut = lambda share: F.lit(first + (last - first) * share)
        late = F.col("event_id") % 50 == 0
        for part in (~late & (F.col("ts") < cut(0.5)), ~late & (F.col("ts") >= cut(0.5)) & (F.col("ts") < cut(0.75)), late | (F.col("ts") >= cut(0.75))):
            events.where(part).write.mode("append").parquet(f"{path}/in")
            writer = rates(spark.readStream.schema(events.schema).parquet(f"{path}/in")).writeStream.outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{path}/checkpoint")
            writer.format("parquet").start(f"{path}/out").awaitTermination()
    done = spark.read.schema(schema).parquet(f"{path}/out") if first is not None else spark.createDataFrame([], schema)
    return done.select(F.unix_timestamp("window_start").alias("hour"), "event_type", "requests")


def _collection(spark, sf):
    e = table(spark, sf, "embeddings")
    return e.select(F.concat(F.lit("vec_"), F.col("vec_id").cast("string")).alias("id"), F.col("embedding").alias("vector"), F.to_json(F.struct("label")).alias("metadata"))


def _engine(spark, sf):
    """A collection without the vectors of label 3, which were removed, and with every tenth of them inserted again."""
    engine, rows = VectorEngine(spark, work_path(spark, "engine"), int(spark.conf.get("spark.sql.shuffle.partitions"))), _collection(spark, sf)
    three = F.get_json_object("metadata", "$.label") == "3"
    engine.insert(rows)
    return engine, rows.where(three)


def _changed(engine, three):
    engine.remove(three.select("id"))
    engine.insert(three.where(F.substring("id", -1, 1) == "0"))
    return engine


def _asked(spark, sf):
    return table(spark, sf, "embeddings").orderBy("vec_id").first()["embedding"]


def dataset_round_trip(spark, sf):
    """A collection saved, loaded and verified."""
    path = work_path(spark, "saved")
    dataset.save(_collection(spark, sf), path)
    return dataset.load(spark, path).select("id", "metadata", F.round(V.l2_norm(F.col("vector")), 6).alias("norm"))


def dataset_migrated(spark, sf):
    """A collection of the older schema, brought to the current one."""
    path = work_path(spark, "older")
    dataset.save(_collection(spark, sf).select(F.col("id").alias("key"), F.col("vector").alias("embedding")), path, vector_col="embedding")
    m = dataset.manifest(spark, path)
    files.commit_json(spark, f"{path}/manifests/0000000002.json", {**m, "schema_version": "0.9.0", "version": 2})
    dataset.migrate(spark, path)
    return dataset.load(spark, path).select("id", "metadata")


def log_rotated(spark, sf):
    """The log in files: half, a snapshot that cuts it, the rest; the state after reading both again."""
    lines = table(spark, sf, "active_wal").select("seq", "op", "id", "vector", "metadata", "timestamp").where("op IN ('clear', 'delete') OR (op = 'insert' AND vector IS NOT NULL)").where("op = 'clear' OR id IS NOT NULL")
    half = (lines.agg(F.max("seq")).first()[0] or 0) // 2
    kept = wal.DurableCollection(spark, work_path(spark, "durable"))
    kept.append(lines.where(F.col("seq") <= half))
    kept.rotate()
    kept.append(lines.where(F.col("seq") > half))
    return wal.DurableCollection(spark, kept.path).state().select("id")


def removed_ids(spark, sf):
    rows = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "label")
    return mutation_log.removed(rows, rows.where("id % 3 = 0").select("id"))


def cache_ttl(spark, sf):
    """Requests of the last hour that answers of the last minute, of this and of an older version, could serve."""
    r = table(spark, sf, "search_requests").where("vector IS NOT NULL AND top_k IS NOT NULL AND received_at IS NOT NULL").withColumn("received_at", F.col("received_at").cast("timestamp"))
    now = r.agg(F.max("received_at")).first()[0]
    made = cache.keyed(r).select("cache_key", F.col("received_at").alias("cached_at"), F.pmod(F.length("query_id") + F.unix_timestamp("received_at"), F.lit(2)).cast("int").alias("version"), F.col("query_id").alias("result"))
    hits, misses = cache.split(r, made.withColumn("cached_at", F.col("cached_at") + F.expr("INTERVAL 59 SECONDS")), F.lit(now), 1)
    return hits.select(F.lit("hit").alias("kind"), "query_id").unionByName(misses.select(F.lit("miss").alias("kind"), "query_id")).groupBy("kind").agg(F.count(F.lit(1)).alias("requests"))


def engine_search(spark, sf):
    engine = _changed(*_engine(spark, sf))
    return engine.search(_asked(spark, sf), 10)


def engine_stats(spark, sf):
    engine, three = _engine(spark, sf)
    before = engine.stats()
    _changed(engine, three)
    after = engine.stats()
    engine.clear()
    rows = [(n, s["size"], s["dimension"] or 0) for n, s in (("inserted", before), ("changed", after), ("cleared", engine.stats()))]
    return spark.createDataFrame(rows, "at string, size long, dimension int")


def engine_ivf_current(spark, sf):
    """An inverted file of before the changes, all cells probed: what is gone is not found, what came is."""
    engine, three = _engine(spark, sf)
    path = work_path(spark, "engine-ivf")
    engine.build_ivf(path, 8)
    return _changed(engine, three).search_ivf(path, _asked(spark, sf), 10, 8)


def engine_hnsw_current(spark, sf):
    """The same with graphs, searched so widely that each row is a candidate."""
    engine, three = _engine(spark, sf)
    path = work_path(spark, "engine-hnsw")
    engine.build_hnsw(path)
    return _changed(engine, three).search_hnsw(path, _asked(spark, sf), 10, 100_000)


def sql_knn(spark, sf):
    register_sql(spark, _collection(spark, sf))
    listed = ", ".join(f"{x!r}D" for x in _asked(spark, sf))
    return spark.sql(f"SELECT rank, id, score, metadata FROM knn(array({listed}), 10)")


def metrics_csv(spark, sf):
    """Long-form metrics through a CSV file."""
    path = work_path(spark, "metrics")
    wide = evaluate.latency_percentiles(table(spark, sf, "events"), "value", ["event_type"]).select("event_type", "n", "p50", "p95")
    results.write_metrics(wide, "event_type", path, "ms")
    return spark.read.schema("benchmark_name string, metric_name string, value double, unit string").option("header", True).csv(path).withColumn("value", F.round("value", 6))


def synthetic_norms(spark, sf):
    v = synthetic.vectors(spark, 1000, DIMENSION)
    return v.select(F.size("vector").alias("dimension"), F.round(V.l2_norm(F.col("vector")), 4).alias("norm")).groupBy("dimension", "norm").agg(F.count(F.lit(1)).alias("n"))


def observed_rows(spark, sf):
    """Counts taken while a query runs."""
    metrics = observe.Registry()
    seen = observe.Observed(table(spark, sf, "events"), "events", metrics, {"largest": F.max("event_id")})
    seen.rows.write.format("noop").mode("overwrite").save()
    got = seen.record()
    return spark.createDataFrame([(got["rows"], got["largest"], float(metrics.value("events_rows_total")))], "rows long, largest long, counted double")


def sharded_measures(spark, sf):
    """Inserts and batch searches over 1, 2 and 4 shards: rows kept, answers given, recall against one search, and that each was timed."""
    rows = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")).withColumn("key", F.concat(F.lit("vec_"), F.col("id").cast("string")))
    asked = rows.where("id % 20 = 0").select(F.col("id").alias("query_id"), "vector")
    metrics, out = observe.Registry(), []
    truth = exact.topk_batch(rows, asked, 10, dimension=DIMENSION)
    for n in (1, 2, 4):
        path = work_path(spark, "shards")
        with metrics.timed("ingest", shards=n):
            HashRing(NODES[:n]).assign(rows, "key").write.partitionBy("node").parquet(path)
        shards = spark.read.parquet(path)
        with metrics.timed("search", shards=n):
            found = settle(exact.scatter_gather_batch(shards, "node", asked, 10, dimension=DIMENSION), "found")
        timed = metrics.value("ingest_seconds", shards=n) == metrics.value("search_seconds", shards=n) == 1
        out.append((n, shards.count(), found.count(), evaluate.recall_at_k(truth, found, 10).first().recall, timed))
    return spark.createDataFrame(out, "shards int, stored long, answers long, recall double, timed boolean")


QUERIES = {
    "ring_assign": ring_assign, "ring_distribution": ring_distribution, "ring_balance": ring_balance, "ring_movement": ring_movement, "modulo_movement": modulo_movement, "ring_golden": ring_golden, "key_digests": key_digests,
    "log_replay": log_replay, "log_replay_whole": log_replay_whole, "log_replay_bad_dim": log_replay_bad_dim, "snapshot_plus_log": snapshot_plus_log, "log_operations": log_operations, "insert_checked": insert_checked,
    "metadata_fields": metadata_fields, "heartbeat_active": heartbeat_active, "heartbeat_replicas": heartbeat_replicas, "worker_sessions": worker_sessions, "cache_key_dedupe": cache_key_dedupe,
    "latency_percentiles": latency_percentiles, "request_rate_1m": request_rate_1m, "cache_hit_ratio": cache_hit_ratio, "metrics_long": metrics_long, "stream_ingest": stream_ingest, "stream_rates": stream_rates,
    "dataset_round_trip": dataset_round_trip, "dataset_migrated": dataset_migrated, "log_rotated": log_rotated, "removed_ids": removed_ids, "cache_ttl": cache_ttl,
    "engine_search": engine_search, "engine_stats": engine_stats, "engine_ivf_current": engine_ivf_current, "engine_hnsw_current": engine_hnsw_current, "sql_knn": sql_knn,
    "metrics_csv": metrics_csv, "synthetic_norms": synthetic_norms, "observed_rows": observed_rows, "sharded_measures": sharded_measures,
}

_KEYS = "WITH k AS (SELECT DISTINCT id AS key, sha256(id) AS h FROM stored_ids WHERE id IS NOT NULL)"
_GOLDEN = "WITH k AS (SELECT 'vec_' || range AS key, sha256('vec_' || range) AS h FROM range(10000))"


def _ring(nodes: list[str], name: str) -> str:
    listed = ", ".join(f"'{n}'" for n in nodes)
    return f""", r{name} AS (SELECT sha256(n || '#vnode_' || i) AS vh, n AS node FROM (SELECT unnest([{listed}]) AS n), (SELECT range AS i FROM range(100))),
        {name} AS (SELECT k.key, coalesce(r.node, (SELECT node FROM r{name} ORDER BY vh LIMIT 1)) AS node FROM k ASOF LEFT JOIN r{name} r ON k.h < r.vh)"""


_MOD = "list_reduce(list_prepend(0::BIGINT, list_transform(string_split(h, ''), lambda c: instr('0123456789abcdef', c) - 1)), lambda a, d: (a * 16 + d) % {0})"
_MOVED = "SELECT count(*) AS keys, count(*) FILTER (a IS DISTINCT FROM b) AS moved, round(100.0 * count(*) FILTER (a IS DISTINCT FROM b) / count(*), 4)::DOUBLE AS moved_pct"


def _replay(source: str = "active_wal", group: str = "shard", columns: str = "shard, id, seq") -> str:
    return f"""WITH l AS (SELECT seq, shard, op, id, vector, {group} AS g FROM {source} WHERE op IN ('insert', 'delete', 'clear')),
        c AS (SELECT g, max(seq) AS cleared FROM l WHERE op = 'clear' GROUP BY g),
        a AS (SELECT l.* FROM l LEFT JOIN c ON c.g IS NOT DISTINCT FROM l.g WHERE op <> 'clear' AND (cleared IS NULL OR seq > cleared)),
        d AS (SELECT g, arg_min(len(vector), seq) AS dim FROM a WHERE op = 'insert' AND id IS NOT NULL AND len(vector) > 0 GROUP BY g),
        r AS (SELECT *, row_number() OVER (PARTITION BY g, id ORDER BY seq DESC) AS rn FROM a WHERE id IS NOT NULL)
        SELECT {columns} FROM r JOIN d ON d.g IS NOT DISTINCT FROM r.g WHERE rn = 1 AND op = 'insert' AND len(vector) = dim"""


_LATENCY = """SELECT event_type, count(value) AS n, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95,
    round(quantile_cont(value, 0.99), 6) AS p99, round(avg(value), 6) AS mean, round(1000 / avg(value), 6) AS qps FROM events GROUP BY event_type"""
_LAST = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY worker_id ORDER BY last_seen DESC, ttl DESC NULLS LAST, role DESC NULLS LAST, host DESC NULLS LAST, port DESC NULLS LAST, primary_addr DESC NULLS LAST) AS rn FROM worker_heartbeats WHERE worker_id IS NOT NULL AND last_seen IS NOT NULL) WHERE rn = 1"

_MADE = "SELECT 'vec_' || vec_id AS id, embedding::DOUBLE[] AS v, '{\"label\":' || label || '}' AS metadata, label, vec_id FROM embeddings"
_LEFT = f"SELECT * FROM ({_MADE}) WHERE label <> 3 OR vec_id % 10 = 0"
_NORM = "sqrt(list_dot_product({0}, {0}))"


def _nearest(source: str) -> str:
    q = "(SELECT embedding::DOUBLE[] FROM embeddings ORDER BY vec_id LIMIT 1)"
    return f"""SELECT (row_number() OVER (ORDER BY s DESC, id))::INT AS rank, id, round(s, 6) AS score, metadata
        FROM (SELECT *, greatest(-1.0, least(1.0, list_dot_product(v, {q}) / ({_NORM.format('v')} * {_NORM.format(q)}))) AS s FROM ({source})) QUALIFY rank <= 10"""


SQL = {
    "dataset_round_trip": f"SELECT id, metadata, round({_NORM.format('v')}, 6) AS norm FROM ({_MADE})",
    "dataset_migrated": f"SELECT id, '{{}}' AS metadata FROM ({_MADE})",
    "log_rotated": _replay(group="1", columns="id"),
    "removed_ids": "SELECT vec_id AS id, label FROM embeddings WHERE vec_id % 3 <> 0",
    "cache_ttl": """
        WITH r AS (SELECT * FROM search_requests WHERE vector IS NOT NULL AND top_k IS NOT NULL AND received_at IS NOT NULL),
        n AS (SELECT max(received_at) AS now FROM r),
        c AS (SELECT DISTINCT vector, top_k FROM r, n WHERE received_at + INTERVAL 119 SECONDS > now AND (length(query_id) + epoch(date_trunc('second', received_at))::BIGINT) % 2 = 1)
        SELECT CASE WHEN c.top_k IS NULL THEN 'miss' ELSE 'hit' END AS kind, count(*) AS requests FROM r LEFT JOIN c ON c.vector = r.vector AND c.top_k = r.top_k GROUP BY 1""",
    "engine_search": _nearest(_LEFT),
    "engine_stats": f"SELECT 'inserted' AS at, (SELECT count(*) FROM embeddings) AS size, {DIMENSION}::INT AS dimension UNION ALL SELECT 'changed', (SELECT count(*) FROM ({_LEFT})), {DIMENSION}::INT UNION ALL SELECT 'cleared', 0, 0",
    "engine_ivf_current": _nearest(_LEFT),
    "engine_hnsw_current": _nearest(_LEFT),
    "sql_knn": _nearest(_MADE),
    "metrics_csv": f"WITH w AS ({_LATENCY}) SELECT event_type AS benchmark_name, metric_name, value, 'ms' AS unit FROM (SELECT event_type, n::DOUBLE AS n, p50, p95 FROM w) UNPIVOT (value FOR metric_name IN (n, p50, p95))",
    "synthetic_norms": f"SELECT {DIMENSION}::INT AS dimension, 1.0::DOUBLE AS norm, 1000::BIGINT AS n",
    "observed_rows": "SELECT count(*) AS rows, max(event_id) AS largest, count(*)::DOUBLE AS counted FROM events",
    "sharded_measures": "SELECT unnest([1, 2, 4])::INT AS shards, (SELECT count(*) FROM embeddings) AS stored, (SELECT 10 * count(*) FROM embeddings WHERE vec_id % 20 = 0) AS answers, 1.0::DOUBLE AS recall, TRUE AS timed",
    "ring_assign": _KEYS + _ring(NODES, "a") + " SELECT key, node FROM a",
    "ring_distribution": _KEYS + _ring(NODES, "a") + " SELECT node, count(*) AS keys, round(100.0 * count(*) / sum(count(*)) OVER (), 4)::DOUBLE AS share_pct FROM a GROUP BY node",
    "ring_balance": _KEYS + _ring(NODES, "a") + " SELECT round(stddev_pop(n), 6) AS std FROM (SELECT count(*) AS n FROM a GROUP BY node)",
    "ring_movement": _KEYS + _ring(NODES, "x") + _ring(NODES[:3], "y") + f" {_MOVED} FROM (SELECT x.node AS a, y.node AS b FROM x JOIN y USING (key))",
    "modulo_movement": _KEYS + f" {_MOVED} FROM (SELECT {_MOD.format(4)} AS a, {_MOD.format(3)} AS b FROM k)",
    "ring_golden": _GOLDEN + _ring(NODES, "x") + _ring(NODES[:3], "y") + " SELECT x.node AS before, y.node AS after, count(*) AS keys FROM x JOIN y USING (key) GROUP BY ALL",
    "key_digests": _KEYS + f" SELECT key, h AS digest, to_base64(encode(key)) AS encoded, key AS decoded, ({_MOD.format(7)})::INT AS shard FROM k",
    "log_replay": _replay(),
    "log_replay_whole": _replay(group="1", columns="id, seq"),
    "log_replay_bad_dim": _replay("(SELECT * REPLACE (CASE WHEN seq % 11 = 0 THEN vector[1:7] ELSE vector END AS vector) FROM active_wal)"),
    "snapshot_plus_log": _replay(columns="shard, id"),
    "log_operations": "SELECT shard, op, count(*) AS n FROM active_wal GROUP BY ALL",
    "insert_checked": """
        WITH s AS (SELECT request_no, id, vector, coalesce(len(vector) > 0 AND len(list_filter(vector, lambda x: x IS NULL OR NOT isfinite(x))) = 0, FALSE) AS ok FROM insert_requests),
        d AS (SELECT arg_min(len(vector), request_no) AS dim FROM s WHERE ok),
        f AS (SELECT id, min(request_no) AS first FROM s WHERE ok AND id <> '' GROUP BY id),
        k AS (SELECT DISTINCT id FROM stored_ids WHERE id IS NOT NULL)
        SELECT reject, count(*) AS n FROM (SELECT CASE WHEN s.id IS NULL OR s.id = '' THEN 'missing id' WHEN NOT ok THEN 'unsound vector' WHEN len(vector) <> dim THEN 'dimension'
            WHEN k.id IS NOT NULL THEN 'already stored' WHEN request_no <> first THEN 'repeated in the batch' END AS reject
            FROM s LEFT JOIN f ON f.id = s.id LEFT JOIN k ON k.id = s.id, d) GROUP BY reject""",
    "metadata_fields": "SELECT json_extract_string(metadata, '$.source') AS source, count(*) AS requests, max(json_extract_string(metadata, '$.n')::BIGINT) AS max_n FROM insert_requests GROUP BY 1",
    "heartbeat_active": f"SELECT worker_id, last_seen, ttl FROM ({_LAST}) WHERE (SELECT max(last_seen) FROM worker_heartbeats WHERE worker_id IS NOT NULL) - last_seen <= ttl",
    "heartbeat_replicas": f"""SELECT primary_addr, count(*) AS replicas, string_agg(a, ',' ORDER BY a) AS addresses FROM (SELECT DISTINCT primary_addr, host || ':' || port AS a
        FROM ({_LAST.replace("last_seen IS NOT NULL)", "last_seen <= (SELECT max(last_seen) FROM worker_heartbeats WHERE role = 'replica'))")})
        WHERE role = 'replica' AND primary_addr <> '' AND (SELECT max(last_seen) FROM worker_heartbeats WHERE role = 'replica') - last_seen <= ttl) GROUP BY primary_addr""",
    "worker_sessions": """
        WITH b AS (SELECT worker_id, make_timestamp((floor(last_seen * 1000000))::BIGINT) AS t FROM worker_heartbeats WHERE worker_id IS NOT NULL AND last_seen IS NOT NULL),
        g AS (SELECT *, CASE WHEN t - lag(t) OVER w < INTERVAL 600 SECONDS THEN 0 ELSE 1 END AS new FROM b WINDOW w AS (PARTITION BY worker_id ORDER BY t)),
        s AS (SELECT worker_id, sum(new) OVER (PARTITION BY worker_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS s FROM g)
        SELECT worker_id, count(*) AS sessions, max(n) AS most_beats FROM (SELECT worker_id, s, count(*) AS n FROM s GROUP BY ALL) GROUP BY worker_id""",
    "cache_key_dedupe": "SELECT requests, count(*) AS keys FROM (SELECT count(*) AS requests FROM search_requests WHERE vector IS NOT NULL AND top_k IS NOT NULL GROUP BY vector, top_k) GROUP BY requests",
    "latency_percentiles": _LATENCY,
    "request_rate_1m": "SELECT epoch(date_trunc('minute', ts))::BIGINT AS minute, event_type, count(*) AS requests, round(avg(value), 6) AS mean_value FROM events GROUP BY ALL",
    "cache_hit_ratio": "SELECT user_id, round(h / (h + m + 0.0001::DOUBLE), 6) AS ratio FROM (SELECT user_id, count(*) FILTER (event_type = 'view') AS h, count(*) FILTER (event_type = 'error') AS m FROM events GROUP BY user_id)",
    "metrics_long": f"WITH w AS ({_LATENCY}) SELECT event_type AS benchmark_name, metric_name, value, 'ms' AS unit FROM (SELECT event_type, n::DOUBLE AS n, p50, p95 FROM w) UNPIVOT (value FOR metric_name IN (n, p50, p95))",
    "stream_ingest": _replay(),
    "stream_rates": """
        WITH s AS (SELECT min(ts) AS a, max(ts) AS z FROM events),
        e AS (SELECT ts, event_type, date_trunc('hour', ts) AS h, event_id % 50 = 0 AS late FROM events),
        w AS (SELECT max(ts) - INTERVAL 10 MINUTES AS w FROM e, s WHERE NOT late AND ts < a + (z - a) * 0.75)
        SELECT epoch(h)::BIGINT AS hour, event_type, count(*) AS requests FROM e, s, w
        WHERE h + INTERVAL 1 HOUR <= z - INTERVAL 10 MINUTES AND NOT (late AND h + INTERVAL 1 HOUR <= w) GROUP BY ALL""",
}
