"""Vector functions, exact search, inverted files, quantization and their evaluation, with the SQL each is checked against.

Searches take as queries the vectors whose id is divisible by 20. Indexes use
deterministic models (cell centroids are the means by label, codebooks the
sub-vectors of the lowest ids), so SQL can follow; they are for that check, and
their recall is low. The ``_trained`` ones are what to search with: all the
cells and codes, enough probes and an exact re-rank for a recall of 0.9.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from simlode.functions import vector as V
from simlode.operators import evaluate, exact, hnsw, ivf, pq
from simlode.operators.ring import HashRing
from simlode.session import settle, spread, table, work_path

K, DIM = 10, 64
M, CODES = 8, 16
#: Of the trained indexes: cells and how many are probed; codes a sub-space, rounds, and candidates that are ranked again.
CELLS, PROBES = 64, 40
TRAINED_CODES, TRAINED_ROUNDS, CANDIDATES = 256, 8, 200
SHARDS = [f"worker_{i}" for i in range(1, 5)]


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def _first(rows: DataFrame) -> list[float]:
    """The query of the single-query plans: the vector of lowest id."""
    return rows.orderBy("id").first()["vector"]


def _queries(rows: DataFrame) -> DataFrame:
    return rows.where("id % 20 = 0").select(F.col("id").alias("query_id"), "vector")


def _pairs(rows: DataFrame) -> DataFrame:
    other = rows.select((F.col("id") - 1).alias("id"), F.col("vector").alias("other"))
    return rows.join(other, "id")


def _long(rows: DataFrame, column: str, key: str = "id") -> DataFrame:
    return rows.select(key, F.posexplode(column).alias("pos", "x")).select(key, "pos", F.round("x", 6).alias("x"))


def cosine_pairs(spark, sf):
    return _pairs(_vectors(spark, sf)).select("id", F.round(V.cosine_similarity(F.col("vector"), F.col("other")), 6).alias("cosine"))


def l2_norms(spark, sf):
    return _vectors(spark, sf).select("id", F.round(V.l2_norm(F.col("vector")), 6).alias("norm"))


def l2_distance_pairs(spark, sf):
    return _pairs(_vectors(spark, sf)).select("id", F.round(V.squared_l2(F.col("vector"), F.col("other")), 6).alias("distance"))


def dot_pairs(spark, sf):
    return _pairs(_vectors(spark, sf)).select("id", F.round(V.dot(F.col("vector"), F.col("other")), 6).alias("dot"))


def normalize_vectors(spark, sf):
    scaled = F.transform(F.col("vector"), lambda x: x * 3)
    return _long(_vectors(spark, sf).select("id", V.normalized(scaled).alias("v")), "v")


def zero_norm_cosine(spark, sf):
    v = F.when(F.col("id") % 7 == 0, F.transform("vector", lambda x: x * 0)).otherwise(F.col("vector"))
    return _pairs(_vectors(spark, sf).withColumn("vector", v)).select("id", F.round(V.cosine_similarity(F.col("vector"), F.col("other")), 6).alias("cosine"))


def subvector_norms(spark, sf):
    parts = F.explode(F.array(*[F.struct(F.lit(m).alias("m"), V.subvector(F.col("vector"), m, DIM // M).alias("s")) for m in range(M)]))
    return _vectors(spark, sf).select("id", parts.alias("p")).select("id", "p.m", F.round(V.l2_norm(F.col("p.s")), 6).alias("norm"))


def exact_topk_single(spark, sf):
    e = _vectors(spark, sf)
    return exact.topk(e, _first(e), K)


def topk_k_exceeds_n(spark, sf):
    e = _vectors(spark, sf)
    return exact.topk(e.where("label = 3"), _first(e), 1_000_000)


def topk_filtered_by_label(spark, sf):
    e = _vectors(spark, sf)
    return exact.topk(e, _first(e), K, where=F.col("label") == 3, payload=["label"])


def topk_filtered_by_metadata(spark, sf):
    r = table(spark, sf, "insert_requests").where(V.is_sound(F.col("vector"), DIM))
    q = table(spark, sf, "embeddings").orderBy("vec_id").first()["embedding"]
    return exact.topk(r.select(F.col("request_no").alias("id"), "vector", "metadata"), q, K, where=F.get_json_object("metadata", "$.source") == "crawl")


def topk_filtered_by_label_batch(spark, sf):
    e = _vectors(spark, sf)
    return exact.topk_batch(e.where("label = 3"), _queries(e), K, dimension=DIM)


def topk_filtered_by_metadata_batch(spark, sf):
    r = table(spark, sf, "insert_requests").where(V.is_sound(F.col("vector"), DIM)).where(F.get_json_object("metadata", "$.source") == "crawl")
    return exact.topk_batch(r.select(F.col("request_no").alias("id"), "vector"), _queries(_vectors(spark, sf)), K, dimension=DIM)


def exact_topk_batch(spark, sf):
    e = _vectors(spark, sf)
    return exact.topk_batch(e, _queries(e), K, dimension=DIM)


def _requests(spark, sf):
    """The sound rows of both request tables; a request repeated under its id counts once."""
    rows = table(spark, sf, "insert_requests").where(V.is_sound(F.col("vector"), DIM)).select(F.col("request_no").alias("id"), "vector")
    asked = table(spark, sf, "search_requests").where(V.is_sound(F.col("vector"), DIM))
    return spread(rows), asked.groupBy("query_id").agg(F.min("vector").alias("vector"))


def exact_search_requests(spark, sf):
    """Every search request against every stored vector."""
    rows, asked = _requests(spark, sf)
    return exact.topk_batch(rows, asked, K, dimension=DIM)


def ivf_search_requests(spark, sf):
    """The same through a trained inverted file, probed widely enough for a recall of 0.9 at every size."""
    rows, asked = _requests(spark, sf)
    rows = settle(rows, "requests")
    return _index(rows, ivf.kmeans(rows, CELLS, rounds=6)).search_batch(asked, K, PROBES)


def recall_ivf_requests(spark, sf):
    """Whether that finds at least nine of ten of each request's ten nearest that are similar (cosine 0.5 or more)."""
    near = exact_search_requests(spark, sf).where("score >= 0.5")
    return evaluate.recall_at_k(near, ivf_search_requests(spark, sf).where("score >= 0.5"), K, fixed=False).select("queries", (F.col("recall") >= 0.9).alias("reached"))


def _index(rows, centroids):
    """Stored cells, as partitions."""
    return ivf.Index.create(rows, centroids, work_path(rows.sparkSession, "ivf"))


def _space(space):
    def run(spark, sf):
        e = _vectors(spark, sf)
        return exact.topk_batch(e, _queries(e), K, dimension=DIM, space=space)

    return run


def scatter_gather_topk(spark, sf):
    e = _vectors(spark, sf).withColumn("key", F.concat(F.lit("vec_"), F.col("id").cast("string")))
    sharded = HashRing(SHARDS).assign(e, "key")
    return exact.scatter_gather(sharded, F.col("node"), _first(e), K)


def scatter_gather_batch(spark, sf):
    e = _vectors(spark, sf).withColumn("key", F.concat(F.lit("vec_"), F.col("id").cast("string")))
    return exact.scatter_gather_batch(HashRing(SHARDS).assign(e, "key"), "node", _queries(e), K, dimension=DIM)


def scatter_gather_recall(spark, sf):
    """Recall of per-shard search against global search for 1, 2 and 4 shards."""
    e = _vectors(spark, sf).withColumn("key", F.concat(F.lit("vec_"), F.col("id").cast("string")))
    out = None
    truth = exact.topk_batch(e, _queries(e), K, dimension=DIM)
    for n in (1, 2, 4):
        got = exact.scatter_gather_batch(HashRing(SHARDS[:n]).assign(e, "key"), "node", _queries(e), K, dimension=DIM)
        row = evaluate.recall_at_k(truth, got, K).select(F.lit(n).alias("shards"), "recall")
        out = row if out is None else out.unionByName(row)
    return out


def _cells(spark, sf):
    e = _vectors(spark, sf)
    return e, ivf.Centroids.of(ivf.mean_by(e, "label", "vector"))


def centroids_by_label(spark, sf):
    return _long(ivf.mean_by(_vectors(spark, sf), "label", "vector"), "centroid", "cluster_id")


def lloyd_step(spark, sf):
    e, c = _cells(spark, sf)
    return _long(ivf.lloyd_step(e, c), "centroid", "cluster_id")


def ivf_assign(spark, sf):
    e, c = _cells(spark, sf)
    return ivf.assign(e, c).select("id", "cluster_id")


def ivf_cell_sizes(spark, sf):
    e, c = _cells(spark, sf)
    return ivf.assign(e, c).groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"))


def ivf_probe(spark, sf):
    e, c = _cells(spark, sf)
    return ivf.probe_table(_queries(e), c, 4).select("query_id", "cluster_id", "probe_rank", F.round("distance", 6).alias("distance"))


def _ivf_search(nprobe):
    def run(spark, sf):
        e, c = _cells(spark, sf)
        return _index(e, c).search_batch(_queries(e), K, nprobe)

    return run


def ivf_search_single(spark, sf):
    e, c = _cells(spark, sf)
    return _index(e, c).search(_first(e), K, 2)


def ivf_search_grown(spark, sf):
    """Cells of the even rows, to which the odd ones are added."""
    e, c = _cells(spark, sf)
    return _index(e.where("id % 2 = 0"), c).add(e.where("id % 2 = 1")).search_batch(_queries(e), K, 4)


def recall_ivf(spark, sf):
    e, c = _cells(spark, sf)
    truth = exact.topk_batch(e, _queries(e), K, dimension=DIM)
    return evaluate.recall_at_k(truth, _index(e, c).search_batch(_queries(e), K, 1), K)


def ivf_search_trained(spark, sf):
    e = _vectors(spark, sf)
    return _index(e, ivf.kmeans(e, CELLS)).search_batch(_queries(e), K, PROBES)


def recall_ivf_trained(spark, sf):
    e = _vectors(spark, sf)
    return evaluate.recall_at_k(exact.topk_batch(e, _queries(e), K, dimension=DIM), ivf_search_trained(spark, sf), K)


def _book(spark, sf):
    e = _vectors(spark, sf)
    return e, pq.lowest_rows(e, DIM, M, CODES, "id", "vector")


def pq_encode(spark, sf):
    e, b = _book(spark, sf)
    return pq.encode(e, b, ["id"]).select("id", F.posexplode("codes").alias("m", "code"))


def pq_decode(spark, sf):
    e, b = _book(spark, sf)
    return _long(pq.decode(pq.encode(e, b, ["id"]), b, ["id"]), "vector")


def pq_search(spark, sf):
    e, b = _book(spark, sf)
    return pq.search(pq.encode(e, b, ["id"]), b, _first(e), K)


def pq_adc_search(spark, sf):
    e, b = _book(spark, sf)
    return pq.adc_search(pq.encode(e, b, ["id"]), b, _first(e), K)


def pq_adc_search_batch(spark, sf):
    e, b = _book(spark, sf)
    return pq.adc_search_batch(pq.encode(e, b, ["id"]), b, _queries(e), K)


def pq_error(spark, sf):
    e, b = _book(spark, sf)
    return pq.errors(e, pq.decode(pq.encode(e, b, ["id"]), b, ["id"]), "id", "vector")


def pq_compression(spark, sf):
    e = _vectors(spark, sf)
    width = DIM // M
    n = F.count(F.lit(1))
    raw, code, book = n * (DIM * 4), n * M, F.lit(M * CODES * width * 4)
    return e.agg(raw.alias("raw_bytes"), code.alias("code_bytes"), F.round(raw / (code + book), 6).alias("ratio"), F.round(raw / code, 6).alias("ratio_codes"), F.round(100 * (1 - code / raw), 6).alias("saved_pct"))


def recall_pq(spark, sf):
    e, b = _book(spark, sf)
    truth = exact.topk_batch(e, _queries(e), K, dimension=DIM)
    decoded = pq.decode(pq.encode(e, b, ["id"]), b, ["id"])
    got = exact.topk_batch(decoded, _queries(e), K, dimension=DIM)
    return evaluate.recall_at_k(truth, got, K, fixed=False).withColumn("recall_loss", F.round(1 - F.col("recall"), 6))


def _trained_book(e):
    return pq.train(e, DIM, M, TRAINED_CODES, rounds=TRAINED_ROUNDS)


def pq_search_trained(spark, sf):
    """Candidates by lookup tables of a trained codebook, ranked again by exact cosine."""
    e = _vectors(spark, sf)
    b = _trained_book(e)
    near = pq.adc_search_batch(pq.encode(e, b, ["id"]), b, _queries(e), CANDIDATES)
    return pq.rerank(near, e, _queries(e), K)


def recall_pq_trained(spark, sf):
    e = _vectors(spark, sf)
    return evaluate.recall_at_k(exact.topk_batch(e, _queries(e), K, dimension=DIM), pq_search_trained(spark, sf), K)


def kmeans_train(spark, sf):
    e = _vectors(spark, sf)
    return ivf.assign(e, ivf.kmeans(e, 10)).groupBy("cluster_id").count()


def pq_train(spark, sf):
    e = _vectors(spark, sf)
    b = _trained_book(e)
    return pq.errors(e, pq.decode(pq.encode(e, b, ["id"]), b, ["id"]), "id", "vector")


def hnsw_search(spark, sf):
    e = _vectors(spark, sf)
    index = settle(hnsw.build(e, DIM), "hnsw")
    return hnsw.search_batch(index, _queries(e), K, 50)


def recall_hnsw(spark, sf):
    e = _vectors(spark, sf)
    return evaluate.recall_at_k(exact.topk_batch(e, _queries(e), K, dimension=DIM), hnsw_search(spark, sf), K)


def recalls_reached(spark, sf):
    """Whether the trained indexes reach a recall of 0.9 of the ten nearest of every query."""
    out = None
    for name, run in (("hnsw", recall_hnsw), ("ivf", recall_ivf_trained), ("pq", recall_pq_trained)):
        row = run(spark, sf).select(F.lit(name).alias("method"), "queries", (F.col("recall") >= 0.9).alias("reached"))
        out = row if out is None else out.unionByName(row)
    return out


QUERIES = {
    "cosine_pairs": cosine_pairs, "l2_norms": l2_norms, "l2_distance_pairs": l2_distance_pairs, "dot_pairs": dot_pairs,
    "normalize_vectors": normalize_vectors, "zero_norm_cosine": zero_norm_cosine, "subvector_norms": subvector_norms,
    "exact_topk_single": exact_topk_single, "exact_topk_batch": exact_topk_batch, "topk_k_exceeds_n": topk_k_exceeds_n, "exact_search_requests": exact_search_requests, "ivf_search_requests": ivf_search_requests, "recall_ivf_requests": recall_ivf_requests, "ivf_search_grown": ivf_search_grown, "recalls_reached": recalls_reached,
    "topk_filtered_by_label": topk_filtered_by_label, "topk_filtered_by_metadata": topk_filtered_by_metadata,
    "topk_space_l2": _space("l2"), "topk_space_ip": _space("ip"), "scatter_gather_topk": scatter_gather_topk, "scatter_gather_recall": scatter_gather_recall,
    "centroids_by_label": centroids_by_label, "lloyd_step": lloyd_step, "ivf_assign": ivf_assign, "ivf_cell_sizes": ivf_cell_sizes, "ivf_probe": ivf_probe,
    "ivf_search_nprobe1": _ivf_search(1), "ivf_search_nprobe4": _ivf_search(4), "ivf_search_all": _ivf_search(1000), "ivf_search_single": ivf_search_single, "recall_ivf": recall_ivf,
    "scatter_gather_batch": scatter_gather_batch, "topk_filtered_by_label_batch": topk_filtered_by_label_batch, "topk_filtered_by_metadata_batch": topk_filtered_by_metadata_batch, "pq_adc_search_batch": pq_adc_search_batch,
    "ivf_search_trained": ivf_search_trained, "recall_ivf_trained": recall_ivf_trained, "pq_search_trained": pq_search_trained, "recall_pq_trained": recall_pq_trained,
    "pq_encode": pq_encode, "pq_decode": pq_decode, "pq_search": pq_search, "pq_adc_search": pq_adc_search, "pq_error": pq_error, "pq_compression": pq_compression, "recall_pq": recall_pq,
    "kmeans_train": kmeans_train, "pq_train": pq_train, "hnsw_search": hnsw_search, "recall_hnsw": recall_hnsw,
}

_COS = """CASE WHEN list_dot_product({0}, {0}) = 0 OR list_dot_product({1}, {1}) = 0 THEN 0.0
    ELSE greatest(-1.0, least(1.0, list_dot_product({0}, {1}) / (sqrt(list_dot_product({0}, {0})) * sqrt(list_dot_product({1}, {1}))))) END"""
_FAR = "list_sum(list_transform(list_zip({0}, {1}), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
_E = "WITH e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label FROM embeddings)"
_Q1 = "(SELECT v FROM e ORDER BY id LIMIT 1)"
_P = _E + ", p AS (SELECT a.id, a.v AS a, b.v AS b FROM e a JOIN e b ON b.id = a.id + 1)"


def _unnested(source: str, key: str, column: str) -> str:
    return f"SELECT {key}, (generate_subscripts({column}, 1) - 1)::INT AS pos, round(unnest({column}), 6) AS x FROM {source}"


def _top(score: str, source: str = "e", columns: str = "", direction: str = "DESC", name: str = "score", k: int = K) -> str:
    return f"SELECT (row_number() OVER (ORDER BY s {direction}, id))::INT AS rank, id, round(s, 6) AS {name}{columns} FROM (SELECT *, {score} AS s FROM {source}) QUALIFY rank <= {k}"


def _batch(score: str, where: str = "TRUE", source: str = "e") -> str:
    return f"""SELECT query_id, rank, id, round(s, 6) AS score FROM (
        SELECT query_id, id, s, (row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id))::INT AS rank FROM (
            SELECT q.id AS query_id, x.id, {score} AS s FROM {source} x, (SELECT id, v FROM e WHERE id % 20 = 0) q WHERE {where})) WHERE rank <= {K}"""


_CELLS = _E + f""", c AS (SELECT cluster_id, list(x ORDER BY pos) AS c FROM (SELECT label AS cluster_id, pos, avg(x) AS x FROM (
        SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM e) GROUP BY ALL) GROUP BY cluster_id),
    a AS (SELECT id, v, cluster_id FROM (SELECT id, v, cluster_id, row_number() OVER (PARTITION BY id ORDER BY {_FAR.format('v', 'c')}, cluster_id) AS r FROM e, c) WHERE r = 1),
    pr AS (SELECT id AS query_id, cluster_id, d, row_number() OVER (PARTITION BY id ORDER BY d, cluster_id) AS r FROM (
        SELECT id, cluster_id, {_FAR.format('v', 'c')} AS d FROM e, c WHERE id % 20 = 0))"""


def _ivf(nprobe: int) -> str:
    return _batch(_COS.format("q.v", "x.v"), f"EXISTS (SELECT 1 FROM pr WHERE pr.query_id = q.id AND pr.cluster_id = x.cluster_id AND pr.r <= {nprobe})", "a")


_RECALL = "SELECT count(*) AS queries, round(avg(h), 6) AS recall FROM (SELECT t.query_id, count(g.id) / {k}.0 AS h FROM t LEFT JOIN g ON g.query_id = t.query_id AND g.id = t.id GROUP BY t.query_id)"
_W = DIM // M
_PQ = _E + f""", b AS (SELECT code::INT AS code, v AS bv FROM (SELECT row_number() OVER (ORDER BY id) - 1 AS code, v FROM e) WHERE code < {CODES}),
    m AS (SELECT range::INT AS m FROM range({M})),
    k AS (SELECT id, m, code FROM (SELECT id, m, code, row_number() OVER (PARTITION BY id, m ORDER BY {_FAR.format(f'v[m * {_W} + 1:m * {_W} + {_W}]', f'bv[m * {_W} + 1:m * {_W} + {_W}]')}, code) AS r FROM e, m, b) WHERE r = 1),
    d AS (SELECT id, flatten(list(bv[m * {_W} + 1:m * {_W} + {_W}] ORDER BY m)) AS v FROM k JOIN b USING (code) GROUP BY id)"""

_RING = """r AS (SELECT sha256(n || '#vnode_' || i) AS vh, n AS node FROM (SELECT unnest([{nodes}]) AS n), (SELECT range AS i FROM range(100))),
    f AS (SELECT node AS first FROM r ORDER BY vh LIMIT 1)"""
_SHARDED = _E + ", " + _RING.format(nodes=", ".join(f"'{n}'" for n in SHARDS)) + """,
    h AS (SELECT *, sha256('vec_' || id) AS h FROM e), s AS (SELECT h.id, h.v, coalesce(r.node, f.first) AS node FROM h ASOF LEFT JOIN r ON h.h < r.vh, f)"""



def _shard_recall(n: int) -> str:
    """For n shards: each query's k best of every shard, the k best of those, and how many of them are the true ones."""
    ring = _RING.format(nodes=", ".join(f"'{x}'" for x in SHARDS[:n]))
    return f"""SELECT {n}::INT AS shards, round(avg(h), 6) AS recall FROM (
        WITH {ring}, h AS (SELECT *, sha256('vec_' || id) AS h FROM e),
        s AS (SELECT h.id, h.v, coalesce(r.node, f.first) AS node FROM h ASOF LEFT JOIN r ON h.h < r.vh, f),
        p AS (SELECT q.id AS query_id, s.id, s.node, {_COS.format('q.v', 's.v')} AS c FROM s, (SELECT id, v FROM e WHERE id % 20 = 0) q),
        l AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY query_id, node ORDER BY c DESC, id) <= {K}),
        g AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY c DESC, id) <= {K}),
        t AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY c DESC, id) <= {K})
        SELECT t.query_id, count(g.id) / {K}.0 AS h FROM t LEFT JOIN g ON g.query_id = t.query_id AND g.id = t.id GROUP BY t.query_id)"""


_SHARD_RECALL = _E + " " + " UNION ALL ".join(_shard_recall(n) for n in (1, 2, 4))

SQL = {
    "cosine_pairs": _P + f" SELECT id, round({_COS.format('a', 'b')}, 6) AS cosine FROM p",
    "l2_norms": _E + " SELECT id, round(sqrt(list_dot_product(v, v)), 6) AS norm FROM e",
    "l2_distance_pairs": _P + f" SELECT id, round({_FAR.format('a', 'b')}, 6) AS distance FROM p",
    "dot_pairs": _P + " SELECT id, round(list_dot_product(a, b), 6) AS dot FROM p",
    "normalize_vectors": _E + ", n AS (SELECT id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM e) " + _unnested("n", "id", "v"),
    "zero_norm_cosine": _E + f", z AS (SELECT id, CASE WHEN id % 7 = 0 THEN list_transform(v, lambda x: x * 0) ELSE v END AS v FROM e), p AS (SELECT a.id, a.v AS a, b.v AS b FROM z a JOIN z b ON b.id = a.id + 1) SELECT id, round({_COS.format('a', 'b')}, 6) AS cosine FROM p",
    "subvector_norms": _E + f", s AS (SELECT id, range::INT AS m, v[range * {_W} + 1:range * {_W} + {_W}] AS s FROM e, range({M})) SELECT id, m, round(sqrt(list_dot_product(s, s)), 6) AS norm FROM s",
    "exact_topk_single": _E + " " + _top(_COS.format("v", _Q1)),
    "topk_k_exceeds_n": _E + " " + _top(_COS.format("v", _Q1), "(SELECT * FROM e WHERE label = 3)", k=1_000_000),
    "topk_filtered_by_label": _E + " " + _top(_COS.format("v", _Q1), "(SELECT * FROM e WHERE label = 3)", ", label"),
    "topk_filtered_by_metadata": _E + ", i AS (SELECT request_no AS id, vector::DOUBLE[] AS v FROM insert_requests WHERE len(vector) = 64 AND len(list_filter(vector, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(vector, lambda x: x <> 0)) > 0 AND json_extract_string(metadata, '$.source') = 'crawl') " + _top(_COS.format("v", _Q1), "i"),
    "exact_topk_batch": _E + " " + _batch(_COS.format("q.v", "x.v")),
    "exact_search_requests": f"""
        WITH e AS (SELECT request_no AS id, vector::DOUBLE[] AS v FROM insert_requests WHERE len(vector) = {DIM} AND len(list_filter(vector, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        q AS (SELECT query_id, min(vector::DOUBLE[]) AS v FROM search_requests WHERE len(vector) = {DIM} AND len(list_filter(vector, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(vector, lambda x: x <> 0)) > 0 GROUP BY query_id)
        SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id))::INT AS rank, id, round(s, 6) AS score
        FROM (SELECT query_id, e.id, {_COS.format('q.v', 'e.v')} AS s FROM q, e WHERE list_dot_product(e.v, e.v) > 0) QUALIFY rank <= {K}""",
    "recall_ivf_requests": """SELECT count(DISTINCT query_id) AS queries, TRUE AS reached FROM (EXACT) WHERE score >= 0.5""",
    "ivf_search_grown": _CELLS + " " + _ivf(4),
    "recalls_reached": "SELECT unnest(['hnsw', 'ivf', 'pq']) AS method, (SELECT count(*) FROM embeddings WHERE vec_id % 20 = 0) AS queries, TRUE AS reached",
    "topk_space_l2": _E + " " + _batch(f"1 - {_FAR.format('q.v', 'x.v')}"),
    "topk_space_ip": _E + " " + _batch("list_dot_product(q.v, x.v)"),
    "scatter_gather_topk": _SHARDED + f", l AS (SELECT * FROM (SELECT id, node, c, row_number() OVER (PARTITION BY node ORDER BY c DESC, id) AS lr FROM (SELECT id, node, {_COS.format('v', _Q1)} AS c FROM s)) WHERE lr <= {K}) " + _top("c", "l", ", node AS shard"),
    "scatter_gather_recall": _SHARD_RECALL,
    "centroids_by_label": _CELLS + " " + _unnested("c", "cluster_id", "c"),
    "lloyd_step": _CELLS + " SELECT cluster_id, (pos - 1)::INT AS pos, round(avg(x), 6) AS x FROM (SELECT cluster_id, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM a) GROUP BY ALL",
    "ivf_assign": _CELLS + " SELECT id, cluster_id FROM a",
    "ivf_cell_sizes": _CELLS + " SELECT cluster_id, count(*) AS n FROM a GROUP BY cluster_id",
    "ivf_probe": _CELLS + " SELECT query_id, cluster_id, r::INT AS probe_rank, round(d, 6) AS distance FROM pr WHERE r <= 4",
    "ivf_search_nprobe1": _CELLS + " " + _ivf(1),
    "ivf_search_nprobe4": _CELLS + " " + _ivf(4),
    "ivf_search_all": _E + " " + _batch(_COS.format("q.v", "x.v")),
    "ivf_search_single": _CELLS + f", o AS (SELECT cluster_id FROM c ORDER BY {_FAR.format('c', _Q1)}, cluster_id LIMIT 2) " + _top(_COS.format("v", _Q1), "(SELECT * FROM a WHERE cluster_id IN (SELECT cluster_id FROM o))"),
    "recall_ivf": _CELLS + f", t AS ({_batch(_COS.format('q.v', 'x.v'))}), g AS ({_ivf(1)}) " + _RECALL.format(k=K),
    "pq_encode": _PQ + " SELECT id, m, code::SMALLINT AS code FROM k",
    "pq_decode": _PQ + " " + _unnested("d", "id", "v"),
    "pq_search": _PQ + " " + _top(_COS.format("v", _Q1), "d"),
    "pq_adc_search": _PQ + " " + _top(_FAR.format("v", _Q1), "d", direction="ASC", name="distance"),
    "pq_error": _PQ + f", x AS (SELECT {_FAR.format('e.v', 'd.v')} AS e FROM e JOIN d USING (id)) SELECT round(avg(e), 6) AS mean_error, round(max(e), 6) AS max_error FROM x",
    "pq_compression": f"SELECT n * {DIM * 4} AS raw_bytes, n * {M} AS code_bytes, round(n * {DIM * 4} / (n * {M} + {M * CODES * _W * 4}), 6) AS ratio, {DIM * 4 / M}::DOUBLE AS ratio_codes, round(100 * (1 - {M / (DIM * 4)}), 6)::DOUBLE AS saved_pct FROM (SELECT count(*) AS n FROM embeddings)",
    "recall_pq": _PQ + f", t AS ({_batch(_COS.format('q.v', 'x.v'))}), g AS ({_batch(_COS.format('q.v', 'x.v'), source='d')}), o AS ({_RECALL.format(k=K)}) SELECT queries, recall, round(1 - recall, 6) AS recall_loss FROM o",
}
SQL["recall_ivf_requests"] = SQL["recall_ivf_requests"].replace("EXACT", SQL["exact_search_requests"])
