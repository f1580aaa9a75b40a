"""Ring, log replay, storage, cache, registry, streaming and the facade."""

import io
import json
import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from simlode import observe
from simlode.engine import PAYLOAD, VectorEngine, register_sql
from simlode.functions import vector as V
from simlode.operators import cache, mutation_log, registry
from simlode.operators.change_table import ChangeTable
from simlode.operators.ring import HashRing, distribution, moved, movement
from simlode.plans import operations
from simlode.session import work_path
from simlode.sources import dataset, files, results, synthetic, wal
from simlode.streaming import ingest


def test_ring_golden_counts(spark):
    got = {(r.before, r.after): r["keys"] for r in operations.ring_golden(spark, "").collect()}
    before = {n: sum(v for (a, _), v in got.items() if a == n) for n in operations.NODES}
    assert before == {"worker_1": 2636, "worker_2": 2319, "worker_3": 2723, "worker_4": 2322}
    assert sum(v for (a, b), v in got.items() if a != b) == 2322 and all(a == "worker_4" for a, b in got if a != b)


def test_modulo_golden_counts(spark):
    keys = operations._golden(spark).select(V.modulo_shard(F.col("key"), 4).alias("a"), V.modulo_shard(F.col("key"), 3).alias("b"))
    assert sorted(r["count"] for r in keys.groupBy("a").count().collect()) == [2480, 2492, 2506, 2522]
    assert moved(keys, F.col("a"), F.col("b")).first().moved == 7460


def test_ring_against_a_walk(spark):
    ring = HashRing(["a", "b", "b", "c"], replicas=7)
    keys = spark.createDataFrame([(f"key_{i}", 1) for i in range(300)] + [(None, 1), ("", 1)], "key string, lead int")
    got = {r.key: r.n for r in ring.assign(keys, "key", "n").collect()}
    assert all(got[k] == ring.get_node(k) for k in got if k is not None) and got[None] is None
    ring.remove_node("b")
    ring.remove_node("zz")
    assert ring.nodes == ["a", "c"] and HashRing().get_node("x") is None
    assert {r.node for r in HashRing().assign(keys, "key").collect()} == {None}
    assert {r.node for r in HashRing(["one"], 10).assign(keys.where("key <> ''"), "key").collect()} == {"one"}
    with pytest.raises(ValueError):
        HashRing(replicas=0)


def test_ring_balance_and_movement(spark):
    keys = spark.range(10_000).select(F.concat(F.lit("key_"), F.col("id").cast("string")).alias("key"))
    four = HashRing([f"node_{i}" for i in range(1, 5)], 200).assign(keys, "key")
    assert all(abs(r["keys"] - 2500) < 750 for r in distribution(four).collect())
    assert movement(four, HashRing([f"node_{i}" for i in range(1, 4)], 200).assign(keys, "key"), "key").first().moved_pct < 30


def log(spark, rows):
    return spark.createDataFrame([(*r, v and [float(x) for x in v]) for *r, v in rows], "seq long, op string, id string, vector array<float>")


def fold(rows, dim=None):
    """One line at a time."""
    state, given_dim = {}, dim
    for seq, op, key, v in sorted(rows, key=lambda r: r[0]):
        if op == "clear":
            state, given_dim = {}, None
        elif op == "delete" and key is not None:
            state.pop(key, None)
        elif op == "insert" and key is not None:
            state.pop(key, None)
            if v:
                given_dim = given_dim or len(v)
                if len(v) == given_dim:
                    state[key] = seq
    return state


@pytest.mark.parametrize(
    "rows, want",
    [
        ([(1, "insert", "a", [1, 2]), (2, "insert", "b", [1, 2]), (3, "delete", "a", None), (4, "delete", "zz", None)], {"b": 2}),
        ([(1, "insert", "a", [1, 2]), (2, "insert", "a", [1, 2, 3])], {}),
        ([(1, "insert", "a", [1, 2]), (2, "clear", None, None), (3, "insert", "b", [1, 2, 3])], {"b": 3}),
        ([(1, "insert", "a", [1, 2]), (2, "noop", "a", None), (3, None, None, None)], {"a": 1}),
        ([], {}),
    ],
)
def test_replay_fixtures(spark, rows, want):
    assert {r.id: r.seq for r in mutation_log.replay(log(spark, rows)).collect()} == want == fold(rows)


LINES = st.lists(st.tuples(st.sampled_from(["insert", "insert", "insert", "delete", "clear", "x"]), st.sampled_from(["a", "b", "c", None]), st.sampled_from([[1.0], [1.0, 2.0], [3.0, 4.0], None])), max_size=20)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(LINES, st.integers(0, 20))
def test_replay_is_the_fold_and_snapshots_change_nothing(spark, made, cut):
    rows = [(i + 1, *r) for i, r in enumerate(made)]
    whole = mutation_log.replay(log(spark, rows))
    assert {r.id: r.seq for r in whole.collect()} == fold(rows)
    snapshot = mutation_log.replay(log(spark, rows[:cut]))
    if snapshot.count():  # an empty snapshot carries no dimension
        again = mutation_log.replay(log(spark, rows), snapshot)
        rest = mutation_log.replay(log(spark, rows[cut:]), snapshot)
        assert {r.id for r in rest.collect()} == set(fold(rows))
        if not any(r[1] == "clear" for r in rows):
            assert {r.id for r in again.collect()} == set(fold(rows))


def test_durable_collection_rotates(spark):
    c = wal.DurableCollection(spark, work_path(spark, "c"))
    line = "op string, id string, vector array<float>, metadata string, timestamp double, seq long"
    c.append(spark.createDataFrame([("insert", "v1", [1.0, 2.0], '{"a": 1}', 1.0, 1)], line))
    assert c.rotate() == 1 and c._segments() == [] and c.last_seq() == 1
    c.append(spark.createDataFrame([("insert", "v2", [1.0, 2.0], None, 2.0, 2), ("insert", "v1", [5.0, 6.0], None, 2.0, 3)], line))
    assert {r.id: r.vector for r in c.state().collect()} == {"v1": [5.0, 6.0], "v2": [1.0, 2.0]}
    assert c.last_seq() == 3


def test_foreign_log_quarantines(spark, tmp_path):
    good = '{"op": "insert", "id": "%s", "vector": [1.0, 2.0], "metadata": {"k": [1]}, "timestamp": 1.5}'
    (tmp_path / "active.wal").write_text("\n".join([good % "v1", '{"op": "insert", "id": "v2", "vec', "not json", "5", "[]", "", good % "v3", '{"op": "insert", "id": "v4"}', '{"op": "clear"}', good % "v5"]))
    got = wal.read_foreign(spark, str(tmp_path / "active.wal"))
    assert got.where("bad IS NOT NULL").count() == 5
    fine = got.where("bad IS NULL")
    assert {r.id for r in mutation_log.replay(fine).collect()} == {"v5"}
    assert fine.where("id = 'v1'").first().metadata == '{"k":[1]}'


def test_dataset_detects_what_differs(spark):
    path = work_path(spark, "d")
    df = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [3.0, 4.0])], "id string, vector array<float>")
    with pytest.raises(ValueError):
        dataset.load(spark, path)
    assert dataset.save(df, path) == 1 and dataset.save(df.limit(1), path) == 2
    assert dataset.load(spark, path).count() == 1 and dataset.load(spark, path, 1).count() == 2
    with pytest.raises(ValueError):
        dataset.load(spark, path, kind="ivf")
    m = dataset.manifest(spark, path, 2)
    files.commit_json(spark, f"{path}/manifests/0000000003.json", {**m, "checksum": "0" * 32, "version": 3})
    with pytest.raises(ValueError):
        dataset.load(spark, path)
    old = spark.createDataFrame([("a", [1.0, 2.0])], "key string, embedding array<float>")
    dataset.save(old, f"{path}/old", vector_col="embedding")
    m = dataset.manifest(spark, f"{path}/old")
    files.commit_json(spark, f"{path}/old/manifests/0000000002.json", {**m, "schema_version": "0.9.0", "version": 2})
    with pytest.raises(ValueError):
        dataset.load(spark, f"{path}/old")
    assert dataset.migrate(spark, f"{path}/old") == 3 and dataset.migrate(spark, f"{path}/old") == 3
    assert [tuple(r) for r in dataset.load(spark, f"{path}/old").select("id", "vector", "metadata").collect()] == [("a", [1.0, 2.0], "{}")]
    files.commit_json(spark, f"{path}/old/manifests/0000000004.json", {**m, "schema_version": "0.1.0", "version": 4})
    with pytest.raises(ValueError):
        dataset.migrate(spark, f"{path}/old")
    with pytest.raises(ValueError):
        dataset.save(df.unionByName(spark.createDataFrame([("c", [1.0])], df.schema)), path)


def test_engine(spark):
    e = VectorEngine(spark, work_path(spark, "e"), 4)
    batch = lambda *rows: spark.createDataFrame([(i, v and [float(x) for x in v], m) for i, v, m in rows], "id string, vector array<float>, metadata string")
    with pytest.raises(ValueError):
        e.search([1.0], 1)
    e.insert(batch(("v1", [1, 0, 0], '{"c": 1}'), ("v2", [0, 1, 0], None), ("v3", [0.8, 0.6, 0], '{"c": 1}')))
    assert [r.id for r in e.search([0.9, 0.1, 0.0], 2).collect()] == ["v1", "v3"]
    assert [r.id for r in e.search([0, 1.0, 0], 2, where=F.get_json_object("metadata", "$.c") == "1").collect()] == ["v3", "v1"]
    assert e.rows().where("id = 'v2'").first().metadata == "{}"
    for bad in [("v1", [1, 0, 0], None)], [("n", [1, 0], None)], [("n", None, None)], [("", [1, 0, 0], None)], [("n", [1, 0, 0], None)] * 2, [("n", [float("nan"), 0, 0], None)]:
        with pytest.raises(ValueError):
            e.insert(batch(*bad))
    assert e.stats() == {"status": "healthy", "size": 3, "dimension": 3, "version": 1}
    assert f'collection_size{{collection="{e.path}"}} 3' in e.metrics()
    for query, k in (([1.0], 1), ([1.0, 0, 0], 0)):
        with pytest.raises(ValueError):
            e.search(query, k)
    with pytest.raises(KeyError):
        e.remove(spark.createDataFrame([("zz",)], "id string"))
    e.remove(spark.createDataFrame([("v2",)], "id string"))
    path = work_path(spark, "i")
    e.build_ivf(path, 2)
    assert [r.id for r in e.search_ivf(path, [1.0, 0, 0], 5, 2).collect()] == ["v1", "v3"]
    e.build_pq(path, 3, 2)
    assert [r.id for r in e.search_pq(path, [1.0, 0, 0], 1).collect()] == ["v1"] and len(e.search_pq(path, [1.0, 0, 0], 5, True).collect()) == 2
    # Indexes of an earlier version give nothing that is gone and all that is new.
    graphs = work_path(spark, "h")
    assert e.build_hnsw(graphs, 10) == 1 and [r.id for r in e.search_hnsw(graphs, [1.0, 0, 0], 5).collect()] == ["v1", "v3"]
    e.insert(batch(("v4", [0.9, 0.1, 0], None)))
    e.add_to_ivf(path)
    found = lambda: [[r.id for r in x.collect()] for x in (e.search_ivf(path, [1.0, 0, 0], 5, 2), e.search_hnsw(graphs, [1.0, 0, 0], 5), e.search(query=[1.0, 0, 0]))]
    assert found() == [["v1", "v4", "v3"]] * 3
    e.remove(spark.createDataFrame([("v1",)], "id string"))
    assert found() == [["v4", "v3"]] * 3 and {r.id for r in e.search_pq(f"{path}", [1.0, 0, 0], 5).collect()} == {"v3", "v4"}
    with pytest.raises(ValueError):
        e.add_to_ivf(path)
    e.insert(batch(("v1", [0, 0, 1.0], None)))
    assert found() == [["v4", "v3", "v1"]] * 3
    e.clear()
    assert e.size() == 0
    e.insert(batch(("v9", [1.0, 0, 0], None)))
    assert found() == [["v9"]] * 3
    e.clear()
    e.insert(batch(("v1", [1, 2], None)))
    assert e.stats()["dimension"] == 2


def test_knn_in_sql(spark):
    rows = spark.createDataFrame([("a", [1.0, 0.0], "{}"), ("b", [0.8, 0.6], None), ("c", [0.0, 1.0], "{}"), ("d", None, None)], "id string, vector array<float>, metadata string")
    register_sql(spark, rows)
    assert [(r["rank"], r.id, r.score) for r in spark.sql("SELECT * FROM knn(array(2.0, 0.1), 2) ORDER BY rank").collect()] == [(1, "a", 0.998752), (2, "b", 0.828964)]
    assert spark.sql("SELECT * FROM knn(array(1D, 0D), 0)").collect() == [] and spark.sql("SELECT count(*) AS n FROM knn(array(1D, 0D), 99)").first().n == 3
    with pytest.raises(Exception):
        spark.sql("SELECT * FROM knn(array(1D), 1)").collect()


def test_stream_refuses_unsound_vectors_as_replay_does(spark, tmp_path):
    schema = "seq long, op string, id string, vector array<float>, metadata string"
    lines = [(1, "insert", "a", [1.0, 2.0], None), (2, "insert", "a", [1.0, 2.0, 3.0], None), (3, "insert", "b", None, None), (4, "insert", "c", [3.0, 4.0], None), (5, "insert", None, [1.0], None), (6, "insert", "d", [1.0], None)]
    log = spark.createDataFrame(lines, schema)
    for part in (log.where("seq > 3"), log.where("seq <= 3")):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    table = ChangeTable(spark, work_path(spark, "s"), 2, PAYLOAD)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    ingest.ingest(stream, table, str(tmp_path / "ck")).awaitTermination()
    assert {r.key: r.seq for r in table.rows().collect()} == {r.id: r.seq for r in mutation_log.replay(log).collect()} == {"c": 4}


def test_clear_of_the_same_time(spark):
    changes = spark.createDataFrame([("g", "a", "put", 1.0, 5), ("g", None, "clear", 1.0, 3), ("g", "b", "put", 2.0, 4)], "grp string, key string, kind string, ts double, seq long")
    table = ChangeTable(spark, work_path(spark, "c"), 2)
    table.apply(changes)
    assert [r.key for r in table.rows().collect()] == ["b"]


def test_foreign_log_is_numbered_across_splits(spark, tmp_path):
    text = ['{"op": "insert", "id": "v%d", "vector": [1.0, %d.0], "metadata": {}, "timestamp": 1.0}' % (i, i) for i in range(5000)]
    text[7] = ""
    for name in ("one", "two"):
        (tmp_path / f"{name}.wal").write_text("\n".join(text))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = wal.read_foreign(spark, f"{tmp_path}/*.wal").select("source", "seq", "id").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(got) == 2 * 4999 and {(r.source[-7:], r.id, r.seq) for r in got} == {(n, f"v{i}", i + 1) for n in ("one.wal", "two.wal") for i in range(5000) if i != 7}


def test_results_as_files(spark, tmp_path):
    rows = spark.createDataFrame([("exact", 1.5, 10, None), ("ivf, trained", 2.5, 20, [1, 2])], "index string, p50 double, n int, more array<int>")
    results.write_csv(rows, f"{tmp_path}/csv")
    back = spark.read.option("header", True).csv(f"{tmp_path}/csv")
    assert {tuple(r) for r in back.collect()} == {("exact", "1.5", "10", None), ("ivf, trained", "2.5", "20", "[1,2]")}
    results.write_json(rows, f"{tmp_path}/json")
    assert {(r["index"], r.n) for r in spark.read.json(f"{tmp_path}/json").collect()} == {("exact", 10), ("ivf, trained", 20)}
    results.write_metrics(rows.drop("more"), "index", f"{tmp_path}/metrics", "ms")
    assert ("exact", "p50", "1.5", "ms") in {tuple(r) for r in spark.read.option("header", True).csv(f"{tmp_path}/metrics").collect()}
    results.one_file(rows.drop("more").orderBy("n"), f"{tmp_path}/all.csv")
    assert (tmp_path / "all.csv").read_text() == 'index,p50,n\nexact,1.5,10\n"ivf, trained",2.5,20\n'
    results.one_file(rows.orderBy("n"), f"{tmp_path}/all.json")
    assert json.loads((tmp_path / "all.json").read_text())[0] == {"index": "exact", "p50": 1.5, "n": 10}
    results.one_file(rows.limit(0), f"{tmp_path}/none.json")
    assert json.loads((tmp_path / "none.json").read_text()) == []


def test_synthetic_rows_repeat_and_are_normal(spark):
    a, b = (synthetic.vectors(spark, 400, 16, partitions=p).orderBy("id").collect() for p in (1, 5))
    assert a == b and len({r.id for r in a}) == 400
    x = np.array([r.vector for r in a])
    assert np.allclose(np.linalg.norm(x, axis=1), 1, atol=1e-6) and abs(x.mean()) < 0.02 and abs(x.std() * 4 - 1) < 0.05
    assert synthetic.requests(spark, 3, 4).columns == ["query_id", "vector", "top_k"]
    with pytest.raises(ValueError):
        synthetic.vectors(spark, 1, 0)
    stream = synthetic.load(spark, 100, 4)
    assert stream.isStreaming and stream.columns == ["at", "kind", "id", "vector"]


def test_observed_rows_and_metrics(spark):
    registry = observe.Registry()
    seen = observe.Observed(spark.range(10), "scan", registry, {"largest": F.max("id")})
    assert seen.rows.count() == 10 and seen.record() == {"rows": 10, "largest": 9}
    with registry.timed("search", index="ivf"):
        pass
    with pytest.raises(KeyError), registry.timed("search", index="ivf"):
        raise KeyError("x")
    assert registry.value("scan_rows_total") == 10 and registry.value("search_seconds", index="ivf") == 2
    assert registry.value("search_total", index="ivf", status="error") == 1 and registry.value("scan_largest") == 9
    text = registry.text()
    assert "# TYPE search_seconds histogram" in text and 'search_seconds_bucket{index="ivf",le="+Inf"} 2' in text and "scan_rows_total 10" in text
    with pytest.raises(ValueError):
        registry.gauge("scan_rows_total", 1)


def test_stages_tell_what_they_cost(spark):
    spark.range(1000).repartition(3).count()
    seen = observe.stages(spark)
    assert len(seen) >= 2 and {"cpu_s", "peak_memory", "shuffle_write", "spilled"} <= set(seen[0]) and any(s["shuffle_write"] for s in seen)


def test_logs_are_json_lines():
    out = io.StringIO()
    logger = observe.json_logger("simlode.test", out)
    logger.info("searched %d", 5, extra={"fields": {"top_k": 3}})
    try:
        raise ValueError("no")
    except ValueError:
        logger.exception("failed")
    first, second = map(json.loads, out.getvalue().splitlines())
    assert first["message"] == "searched 5" and first["top_k"] == 3 and first["level"] == "INFO" and first["logger"] == "simlode.test"
    assert "ValueError: no" in second["exception"]
    assert len(observe.json_logger("simlode.test", out).handlers) == 1


def test_cell_pruning_reaches_the_scan(spark):
    from simlode.operators import ivf
    import numpy as np

    path = work_path(spark, "p")
    rows = spark.createDataFrame([(f"v{i}", [float(i % 3), 1.0], None) for i in range(9)], "id string, vector array<float>, metadata string")
    c = ivf.Centroids([0, 1, 2], np.array([[0.0, 1], [1, 1], [2, 1]]))
    index = ivf.Index.create(rows, c, path)
    asked = spark.createDataFrame([("q", [2.0, 1.0])], "query_id string, vector array<float>")
    batch = index.search_batch(asked, 2)._jdf.queryExecution().executedPlan().toString()
    assert "cluster_id" in batch.split("PartitionFilters: [")[1].split("]")[0]
    assert ivf.Index(spark, path, verify=True).sizes == {0: 3, 1: 3, 2: 3}
    plan = index.search([2.0, 1.0], 2)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "cluster_id" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_cache(spark):
    r = spark.createDataFrame([("q1", [1.0, 2.0], 5), ("q2", [1.0, 2.0], 5), ("q3", [1.0, 2.0], 6)], "q string, vector array<float>, top_k int")
    keys = {x.q: x.cache_key for x in cache.keyed(r).collect()}
    assert keys["q1"] == keys["q2"] != keys["q3"]
    now = F.lit("2026-01-01 00:01:00").cast("timestamp")
    made = lambda at, version: spark.createDataFrame([(keys["q1"], at, version, "r")], "cache_key string, cached_at string, version int, result string").withColumn("cached_at", F.col("cached_at").cast("timestamp"))
    for at, version, hits in (("2026-01-01 00:00:30", 3, 2), ("2026-01-01 00:00:00", 3, 0), ("2026-01-01 00:00:30", 2, 0)):
        hit, miss = cache.split(r, made(at, version), now, 3)
        assert (hit.count(), miss.count()) == (hits, 3 - hits)


def test_heartbeats(spark):
    beats = spark.createDataFrame([("w1", "h", 1, "primary", "", 3, 0.0), ("w2", "h", 2, "replica", "h:1", 3, 0.0), ("w1", "h", 1, "primary", "", 3, 1.5), (None, "h", 3, None, "", 3, 9.0)], "worker_id string, host string, port int, role string, primary_addr string, ttl int, last_seen double")
    assert [r.worker_id for r in registry.active_workers(beats, 3.1).collect()] == ["w1"]
    assert [(r.primary_addr, r.addresses) for r in registry.replicas_of(registry.active_workers(beats, 3.0)).collect()] == [("h:1", "h:2")]
    assert [(r.worker_id, r.beats) for r in ingest.worker_sessions(beats, gap="1 second").orderBy("worker_id", "session_start").collect()] == [("w1", 1), ("w1", 1), ("w2", 1)]


def test_stream_equals_batch(spark, tmp_path):
    r = random.Random(0)
    rows = [(i, r.choice(["insert", "insert", "delete", "clear"] if i % 50 == 0 else ["insert", "delete"]), r.choice("abcdef"), [float(i)], None) for i in range(1, 200)]
    schema = "seq long, op string, id string, vector array<float>, metadata string"
    sent = rows + rows[:40]
    r.shuffle(sent)
    for b in range(3):
        spark.createDataFrame(sent[b::3], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    table = ChangeTable(spark, work_path(spark, "s"), 3, PAYLOAD)
    lines = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for _ in range(2):  # the second run finds nothing new
        ingest.ingest(lines, table, str(tmp_path / "ck")).awaitTermination()
    assert {r.key: r.seq for r in table.rows().collect()} == fold([(s, o, k, v) for s, o, k, v, _ in rows])
