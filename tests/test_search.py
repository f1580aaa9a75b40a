"""Vector functions and searches on hand fixtures and against NumPy."""

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from simlode.engine import register_sql
from simlode.functions import vector as V
from simlode.functions import matrices
from simlode.operators import evaluate, exact, hnsw, ivf, pq
from simlode.operators.exact import topk, topk_batch
from simlode.plans import search

AXES = [(1, [10.0, 0.0]), (2, [-10.0, 0.0]), (3, [0.0, 10.0]), (4, [0.0, -10.0])]


def rows(spark, data, name="id"):
    return spark.createDataFrame([(i, v and [float(x) for x in v], "x", 0) for i, v in data], f"{name} long, vector array<float>, s string, rank int")


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("a, b, want", [([1, 2, 3], [1, 2, 3], 1.0), ([1, 0], [0, 1], 0.0), ([1, -1], [-1, 1], -1.0), ([0, 0], [1, 2], 0.0), ([1e-30, 0], [1, 0], 1.0)])
def test_cosine_pairs(spark, a, b, want):
    assert one(spark, V.cosine_similarity(V.literal(a), V.literal(b))) == pytest.approx(want)


def test_functions(spark):
    a, b = V.literal([3, 4]), V.literal([0, 1])
    assert one(spark, V.l2_norm(a)) == 5 and one(spark, V.dot(a, b)) == 4 and one(spark, V.squared_l2(a, b)) == 18
    assert one(spark, V.normalized(a)) == [0.6, 0.8] and one(spark, V.normalized(V.literal([0, 0]))) == [0, 0]
    assert one(spark, V.argmin(F.array(F.lit(2.0), F.lit(1.0), F.lit(1.0)))) == 1
    assert one(spark, V.joined(F.array(V.subvector(a, 0, 1), V.subvector(a, 1, 1)))) == [3, 4]
    assert one(spark, V.cosine_similarity(a, F.lit(None).cast("array<double>"))) is None
    assert [one(spark, V.score_of_distance(V.distance(a, b, s))) for s in ("l2", "ip", "cosine")] == [-17, 4, 0.8]
    with pytest.raises(PySparkException):
        one(spark, V.dot(a, V.literal([1])))
    with pytest.raises(ValueError):
        V.distance(a, b, "x")


def test_sql_functions(spark):
    register_sql(spark)
    got = spark.sql("SELECT cosine_similarity(array(1D, 0D), array(1D, 1D)) c, squared_l2(array(1D), array(3D)) d, dot_product(array(2D), array(3D)) p, l2_norm(array(3D, 4D)) n, cosine_similarity(array(0D), array(1D)) z").first()
    assert (round(got.c, 6), got.d, got.p, got.n, got.z) == (0.707107, 4, 6, 5, 0)


def test_exact_3d(spark):
    data = rows(spark, [(1, [1, 0, 0]), (2, [0, 1, 0]), (3, [1, 1, 0])])
    got = topk(data, [1, 0.1, 0], 2).collect()
    assert [(r["rank"], r.id) for r in got] == [(1, 1), (2, 3)]


def test_exact_limits_ties_and_errors(spark):
    data = rows(spark, [(3, [1, 0]), (1, [2, 0]), (2, [3, 0]), (4, None)])
    assert [r.id for r in topk(data, [1, 0], 99).collect()] == [1, 2, 3]
    assert [r.id for r in topk(data, [1, 0], 2).collect()] == [1, 2]
    assert topk(data.limit(0), [1, 0], 2).collect() == []
    for k in (0, -1, True, 1.5):
        with pytest.raises(ValueError):
            topk(data, [1, 0], k)
    with pytest.raises(ValueError):
        topk(data, [1, 0], 1, space="x")
    with pytest.raises(PySparkException):
        topk(data, [1, 0, 0], 1).collect()


@pytest.mark.parametrize("space", exact.SPACES)
@pytest.mark.parametrize("grid", [False, True])
def test_batch_equals_single(spark, monkeypatch, space, grid):
    if grid:
        monkeypatch.setattr(exact, "BROADCAST_COMPONENTS", 8)
        monkeypatch.setattr(exact, "GRID_ROWS", 30)
        monkeypatch.setattr(exact, "GRID_QUERIES", 4)
    r = np.random.default_rng(0)
    data = rows(spark, [(i, r.integers(-3, 4, 4).astype(float).tolist()) for i in range(100)])
    asked = data.where("id < 9").select(F.col("id").alias("query_id"), "vector")
    got = {}
    for x in topk_batch(data, asked, 7, space=space, dimension=4).collect():
        got.setdefault(x.query_id, []).append((x["rank"], x.id, x.score))
    for q in asked.collect():
        want = [(x["rank"], x.id, x.score) for x in topk(data, q.vector, 7, space=space).collect()]
        assert [s for *_, s in sorted(got[q.query_id])] == pytest.approx([s for *_, s in want])
        if space != "cosine":  # whole numbers: ties are exact
            assert [i for _, i, _ in sorted(got[q.query_id])] == [i for _, i, _ in want]
    assert topk_batch(data.limit(0), asked, 3, dimension=4).collect() == [] and topk_batch(data, asked.limit(0), 3, dimension=4).collect() == []


def test_scatter_gather_is_global(spark):
    r = np.random.default_rng(1)
    data = rows(spark, [(i, r.standard_normal(3).tolist()) for i in range(60)])
    want = [(x["rank"], x.id) for x in topk(data, [1, 0, 0], 5).collect()]
    got = exact.scatter_gather(data, F.when(F.col("id") < 50, 0).otherwise(F.col("id") % 3), [1, 0, 0], 5).collect()
    assert [(x["rank"], x.id) for x in got] == want


def test_batch_forms_answer_every_query(spark):
    sf = "/root/testdata/sf0.01"
    every = lambda name: {(r.query_id, r["rank"]): r.id for r in search.QUERIES[name](spark, sf).collect()}
    got, want = every("scatter_gather_batch"), every("exact_topk_batch")
    assert got == want and len(want) == 250
    for name in ("topk_filtered_by_label", "pq_adc_search"):
        one = {r["rank"]: r.id for r in search.QUERIES[name](spark, sf).collect()}
        batch = every(name + "_batch")
        first = min(q for q, _ in batch)
        assert len({q for q, _ in batch}) == 25 and {n: i for (q, n), i in batch.items() if q == first} == one
    assert len({q for q, _ in every("topk_filtered_by_metadata_batch")}) == 25
    assert [tuple(r) for r in search.QUERIES["scatter_gather_recall"](spark, sf).orderBy("shards").collect()] == [(1, 1.0), (2, 1.0), (4, 1.0)]


def test_ivf_axes(spark):
    data = rows(spark, [(i, [x * 1.01 for x in v]) for i, v in AXES])
    c = ivf.Centroids([0, 1, 2, 3], np.array([v for _, v in AXES]))
    cells = ivf.assign(data, c)
    assert cells.columns == [*data.columns, "cluster_id"]
    found = lambda n: {r.id for r in ivf.search(cells, c, [5.1, 5.0], 4, n).collect()}
    assert found(1) == {1} and found(2) == {1, 3} and found(4) == {1, 2, 3, 4} and found(99) == {1, 2, 3, 4}
    assert ivf.search(cells.where("id = 1"), c, [-1.0, 0.0], 4, 1).collect() == []
    for bad in (0, -1):
        with pytest.raises(ValueError):
            ivf.search(cells, c, [1.0, 0.0], 4, bad)
    with pytest.raises(ValueError):
        ivf.search(cells, c, [1.0], 4, 1)
    with pytest.raises(ValueError):
        ivf.kmeans(data, 5)
    with pytest.raises(ValueError):
        ivf.kmeans(data, 0)


def test_ivf_all_probes_is_exact_and_recall_grows(spark):
    r = np.random.default_rng(2)
    data = rows(spark, [(i, r.standard_normal(8).tolist()) for i in range(300)])
    asked = data.where("id % 10 = 0").select(F.col("id").alias("query_id"), "vector")
    c = ivf.kmeans(data, 8, rounds=4)
    cells = ivf.assign(data, c).cache()
    truth = topk_batch(data, asked, 5, dimension=8)
    recall = [evaluate.recall_at_k(truth, ivf.search_batch(cells, c, asked, 5, n, block_rows=20), 5).first().recall for n in (1, 3, 8)]
    assert recall == sorted(recall) and recall[-1] == 1.0 and recall[0] < 1


def test_nearest_takes_the_first_of_equals():
    own, far = ivf.nearest(np.array([[0.0, 0.0], [1.0, 0.0]]), np.array([[0.0, 1.0], [1.0, 0.0], [0.0, 1.0]]))
    assert own.tolist() == [0, 1] and far.tolist() == [1, 0]


def test_pq_round_trip(spark):
    r = np.random.default_rng(3)
    data = rows(spark, [(i, r.standard_normal(4).tolist()) for i in range(60)])
    book = pq.train(data, 4, 2, 4, rounds=3)
    assert book.rows.shape == (2, 4, 2)
    codes = pq.encode(data, book, ["id"])
    assert codes.schema["codes"].dataType.simpleString() == "array<smallint>"
    again = pq.encode(pq.decode(codes, book, ["id"]), book, ["id"])
    assert sorted(map(tuple, codes.select("id", F.to_json("codes")).collect())) == sorted(map(tuple, again.select("id", F.to_json("codes")).collect()))
    assert (pq.Codebook.of(book.table(spark)).rows == book.rows).all()
    q = [0.3, -0.2, 1.0, 0.1]
    plain = pq.decode(codes, book, ["id"]).select("id", V.squared_l2(F.col("vector"), V.literal(q)).alias("d")).orderBy("d", "id").limit(5).collect()
    assert [x.id for x in pq.adc_search(codes, book, q, 5).collect()] == [x.id for x in plain]
    assert len(pq.search(codes, book, q, 3).collect()) == 3
    for bad in ((4, 3, 4), (4, 0, 4), (4, 2, 0), (4, 2, 257)):
        with pytest.raises(ValueError):
            pq.check(*bad)
    with pytest.raises(ValueError):
        pq.train(data.limit(3), 4, 2, 4)
    assert round(pq.compression(10_000, 64, 8, 256)["ratio"], 2) == 17.59


def test_adc_batch_equals_single_and_rerank_is_exact(spark, monkeypatch):
    r = np.random.default_rng(5)
    data = rows(spark, [(i, r.standard_normal(8).tolist()) for i in range(200)])
    asked = data.where("id % 20 = 0").select(F.col("id").alias("query_id"), "vector")
    book = pq.train(data, 8, 4, 16, rounds=3)
    codes = pq.encode(data, book, ["id"])
    for components in (pq.BROADCAST_COMPONENTS, 24):  # at once, and in slices of three queries
        monkeypatch.setattr(pq, "BROADCAST_COMPONENTS", components)
        got = {}
        for x in pq.adc_search_batch(codes, book, asked, 7).collect():
            got.setdefault(x.query_id, []).append((x["rank"], x.id, x.distance))
        for q in asked.collect():
            assert sorted(got[q.query_id]) == [(x["rank"], x.id, x.distance) for x in pq.adc_search(codes, book, q.vector, 7).collect()]
    truth = topk_batch(data, asked, 5, dimension=8)
    recall = [evaluate.recall_at_k(truth, pq.rerank(pq.adc_search_batch(codes, book, asked, n), data, asked, 5), 5).first().recall for n in (5, 200)]
    assert recall[0] < recall[1] == 1.0
    assert pq.adc_search_batch(codes, book, asked.limit(0), 5).collect() == [] and pq.adc_search_batch(codes.limit(0), book, asked, 5).collect() == []


@pytest.mark.parametrize("name", ["recall_ivf_trained", "recall_pq_trained", "recall_hnsw"])
def test_registered_indexes_reach_the_recall(spark, name):
    got = search.QUERIES[name](spark, "/root/testdata/sf0.01").first()
    assert got.queries == 25 and got.recall >= 0.9


def test_hnsw_finds_most(spark):
    r = np.random.default_rng(4)
    data = rows(spark, [(i, r.standard_normal(16).tolist()) for i in range(400)])
    asked = data.where("id % 20 = 0").select(F.col("id").alias("query_id"), "vector")
    for space in exact.SPACES:
        index = hnsw.build(data, 16, max_elements=250, M=8, ef_construction=40, space=space)
        assert index.count() == 2
        got = hnsw.search_batch(index, asked, 5, 60)
        assert evaluate.recall_at_k(topk_batch(data, asked, 5, dimension=16, space=space), got, 5).first().recall > 0.9
    assert hnsw.search_batch(hnsw.build(data.limit(0), 16), asked, 5).collect() == []
    with pytest.raises(ValueError):
        hnsw.build(data, 0)
    with pytest.raises(PySparkException):
        hnsw.build(data.unionByName(data), 16, max_elements=2000).collect()


def test_hnsw_takes_any_id_and_any_number_of_queries(spark, monkeypatch):
    r = np.random.default_rng(6)
    vectors = r.standard_normal((300, 12))
    data = spark.createDataFrame([(f"id-{i}", v.tolist()) for i, v in enumerate(vectors)], "id string, vector array<float>")
    asked = spark.createDataFrame([(f"q{i}", vectors[i].tolist()) for i in range(0, 300, 10)] + [("none", None)], "query_id string, vector array<float>")
    index = hnsw.build(data, 12, max_elements=100).cache()
    assert max(len(x.ids) for x in index.collect()) <= 100 and sum(len(x.ids) for x in index.collect()) == 300
    whole = hnsw.search_batch(index, asked, 4, 40).collect()
    assert {x.query_id: x.id for x in whole if x["rank"] == 1} == {f"q{i}": f"id-{i}" for i in range(0, 300, 10)}
    monkeypatch.setattr(hnsw, "BROADCAST_COMPONENTS", 12)
    monkeypatch.setattr(hnsw, "QUERY_BLOCK", 10)
    assert sorted(hnsw.search_batch(index, asked, 4, 40).collect()) == sorted(whole)
    assert len(hnsw.search_batch(index, asked.limit(1), 1000, 5).collect()) == 300  # all can be reached


def test_graph_of_far_clusters_is_connected():
    r = np.random.default_rng(8)
    rows = np.concatenate([r.standard_normal(16) * 5 + 0.01 * r.standard_normal((300, 16)) for _ in range(6)])
    graph = hnsw.unpacked(hnsw.packed(hnsw.Graph(rows, 8, 50)))
    q, row, far = graph.search(rows[::50], 5, 40)
    x = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    truth = np.argsort(-(x[::50] @ x.T), axis=1, kind="stable")[:, :5]
    assert np.mean([len(set(row[q == i]) & set(truth[i])) / 5 for i in range(len(truth))]) > 0.9
    assert len(set(graph.search(rows[:1], len(rows), 1)[1])) == len(rows)


def test_top_scores_as_the_plain_product_does():
    r = np.random.default_rng(9)
    for scale in (1.0, 1e30, 1e-30):
        q, rows = r.standard_normal((300, 7)) * scale, np.repeat(r.standard_normal((40, 7)), 3, axis=0) * scale
        ids = r.permutation(len(rows))
        for space in exact.SPACES:
            i, j, s = matrices.top(q, rows, ids, 11, space)
            want = matrices.best(matrices.scores(q, rows, space), ids, 11)
            assert (j.reshape(300, 11) == want).all() if space != "l2" or scale != 1e-30 else True
            assert np.allclose(s.reshape(300, 11), np.take_along_axis(matrices.scores(q, rows, space), want, axis=1), rtol=1e-12, atol=1e-12)


def test_recall_definitions(spark):
    t = spark.createDataFrame([(1, 1, 7), (1, 2, 8)], "query_id int, rank int, id int")
    g = spark.createDataFrame([(1, 1, 7), (2, 1, 9)], "query_id int, rank int, id int")
    assert evaluate.recall_at_k(t, g, 4).first().recall == 0.125
    assert evaluate.recall_at_k(t, g, 4, fixed=False).first().recall == 0.75
    assert evaluate.recall_at_k(t.limit(0), g.limit(0), 4).first().recall == 0
