"""The facade a user works with: a collection with inserts, deletes, searches and indexes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from simlode.functions import vector as V
from simlode.operators import exact, hnsw, ivf, mutation_log, pq
from simlode.operators.change_table import ChangeTable
from simlode.observe import Registry
from simlode.session import ship
from simlode.sources import dataset

PAYLOAD = T.StructType([T.StructField("vector", T.ArrayType(T.FloatType())), T.StructField("metadata", T.StringType())])


class VectorEngine:
    """One collection below ``path``, kept in a bucketed copy-on-write table.

    Every write is one committed version; a read sees the last one. Inserting
    refuses what :func:`~simlode.operators.mutation_log.accepted` refuses, and
    nothing of a refused batch is written. A search raises on a wrong dimension,
    a non-positive k and an empty collection, in all modes alike.

    Saved indexes keep the version of the table they were built from. A search
    leaves out what was removed or replaced since and scores by itself what came
    since, so no index gives a stale answer; after a clear it is not used.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 16):
        ship(spark)
        self.spark, self.table, self.path = spark, ChangeTable(spark, path, buckets, PAYLOAD), path.rstrip("/")

    def _next(self) -> int:
        return self.table.version() + 1

    def rows(self) -> DataFrame:
        """``id, vector, metadata``."""
        return self.table.rows().select(F.col("key").alias("id"), "vector", "metadata")

    def size(self) -> int:
        return self.rows().count()

    def stats(self) -> dict:
        """Health: status, row count, dimension, version."""
        n = self.size()
        first = self.rows().select(F.size("vector")).first() if n else None
        return {"status": "healthy", "size": n, "dimension": first[0] if first else None, "version": self.table.version()}

    def metrics(self, registry: Registry | None = None) -> str:
        """Size, dimension and version as gauges beside what the registry holds, in the text exposition format."""
        registry, s = registry or Registry(), self.stats()
        for name in ("size", "dimension", "version"):
            registry.gauge(f"collection_{name}", s[name] or 0, collection=self.path)
        return registry.text()

    def insert(self, batch: DataFrame, order: str | None = None) -> int:
        """Add ``id, vector, metadata``; raises ``ValueError`` naming the first refused row."""
        order = order or "id"
        checked = mutation_log.accepted(batch, self.rows(), self.dimension(), order=order)
        bad = checked.where("reject IS NOT NULL").orderBy(order).limit(1).collect()
        if bad:
            raise ValueError(f"{bad[0]['id']}: {bad[0]['reject']}")
        # A row equal to another in id and order passes as its own first; it is refused here.
        if batch.groupBy("id").count().where("count > 1").limit(1).collect():
            raise ValueError("an id is repeated in the batch")
        metadata = F.coalesce(F.col("metadata"), F.lit("{}")) if "metadata" in batch.columns else F.lit("{}")
        at = self._next()
        return self.table.apply(batch.select(F.lit("").alias("grp"), F.col("id").alias("key"), F.lit("put").alias("kind"), F.lit(float(at)).alias("ts"), F.lit(at).cast("long").alias("seq"), V.floats(F.col("vector")).alias("vector"), metadata.alias("metadata")))

    def remove(self, ids: DataFrame) -> int:
        """Delete by ``id``; raises ``KeyError`` for one that is not stored."""
        mutation_log.removed(self.rows(), ids)
        return self._control(ids.select("id").distinct(), "del")

    def clear(self) -> int:
        return self._control(self.spark.range(1).select(F.lit(None).cast("string").alias("id")), "clear")

    def _control(self, ids: DataFrame, kind: str) -> int:
        at = self._next()
        return self.table.apply(ids.select(F.lit("").alias("grp"), F.col("id").alias("key"), F.lit(kind).alias("kind"), F.lit(float(at)).alias("ts"), F.lit(at).cast("long").alias("seq"), F.lit(None).cast("array<float>").alias("vector"), F.lit(None).cast("string").alias("metadata")))

    def dimension(self) -> int | None:
        """Of the first row that is found; all have the same."""
        first = self.rows().select(F.size("vector")).first()
        return first[0] if first else None

    def _ready(self, query: Sequence[float]) -> None:
        dimension = self.dimension()
        if dimension is None:
            raise ValueError("the collection is empty")
        if len(query) != dimension:
            raise ValueError(f"query has {len(query)} components, the collection {dimension}")

    def search(self, query: Sequence[float], top_k: int = 5, where: Column | None = None, space: str = "cosine") -> DataFrame:
        """``rank, id, score, metadata``; ``where`` filters on metadata or id before scoring."""
        exact.check_k(top_k)
        self._ready(query)
        return exact.topk(self.rows(), query, top_k, payload=["metadata"], where=where, space=space)

    def search_batch(self, queries: DataFrame, top_k: int = 5, space: str = "cosine") -> DataFrame:
        return exact.topk_batch(self.rows(), queries, top_k, space=space, dimension=self.dimension() or 1)

    def _since(self, version: int) -> tuple[DataFrame, DataFrame] | None:
        """(ids changed, rows new) since a version of the table; None if nothing of an index of that version holds."""
        if self.table.version() == version:
            none = self.rows().limit(0)
            return none.select("id"), none
        cleared, changed = self.table.since(float(version))
        if cleared:
            return None
        rows = changed.select(F.col("key").alias("id"), "kind", "vector", "metadata")
        return rows.select("id"), rows.where("kind = 'put'").drop("kind")

    def build_ivf(self, path: str, n_clusters: int) -> ivf.Centroids:
        """Train, assign and save cells partitioned for pruning, and the centroids beside them."""
        through = self.table.version()
        centroids = ivf.kmeans(self.rows(), n_clusters)
        ivf.Index.create(self.rows(), centroids, path, extra={"through": through})
        return centroids

    def add_to_ivf(self, path: str) -> None:
        """Bring a saved index up to date by adding what was inserted since; raises ``ValueError`` where something was removed or replaced."""
        index, now = ivf.Index(self.spark, path), self.table.version()
        if index.extra["through"] == now:
            return
        since = self._since(index.extra["through"])
        if since is None or index.cells.join(since[0], "id", "left_semi").limit(1).collect():
            raise ValueError("indexed rows have been removed or replaced; build the index anew")
        index.add(since[1], {"through": now})

    def search_ivf(self, path: str, query: Sequence[float], top_k: int = 5, nprobe: int = 1) -> DataFrame:
        exact.check_k(top_k)
        self._ready(query)
        index = ivf.Index(self.spark, path)
        since = self._since(index.extra["through"])
        if since is None:
            return exact.topk(self.rows(), query, top_k, payload=["metadata"])
        probed = index.cells.where(F.col("cluster_id").isin(index.centroids.probes(query, nprobe))).select("id", "vector", "metadata")
        return exact.topk(probed.join(since[0], "id", "left_anti").unionByName(since[1]), query, top_k, payload=["metadata"])

    def build_pq(self, path: str, subspaces: int = 8, centroids: int = 256) -> pq.Codebook:
        through = self.table.version()
        book = pq.train(self.rows(), self.dimension() or 1, subspaces, centroids)
        dataset.save(pq.encode(self.rows(), book, ["id"]), f"{path}/codes", "codes", vector_col="codes", extra={"through": through})
        dataset.save(book.table(self.spark), f"{path}/codebook", "codebook", vector_col="centroid")
        return book

    def search_pq(self, path: str, query: Sequence[float], top_k: int = 5, adc: bool = False) -> DataFrame:
        book = pq.Codebook.of(dataset.load(self.spark, f"{path}/codebook", kind="codebook"))
        codes = dataset.load(self.spark, f"{path}/codes", kind="codes", verify=False)
        since = self._since(dataset.manifest(self.spark, f"{path}/codes")["extra"]["through"])
        if since is None:
            codes = pq.encode(self.rows(), book, ["id"])
        else:
            codes = codes.join(since[0], "id", "left_anti").unionByName(pq.encode(since[1], book, ["id"]))
        return (pq.adc_search if adc else pq.search)(codes, book, query, top_k)

    def build_hnsw(self, path: str, max_elements: int = 10_000, M: int = 16, ef_construction: int = 200, space: str = "cosine") -> int:
        """Build and save graphs; their number."""
        through = self.table.version()
        graphs = hnsw.build(self.rows(), self.dimension() or 1, max_elements, M, ef_construction, space)
        dataset.save(graphs, path, "hnsw", vector_col=None, extra={"through": through, "space": space})
        return dataset.manifest(self.spark, path)["rows"]

    def search_hnsw(self, path: str, query: Sequence[float], top_k: int = 5, ef_search: int = 50) -> DataFrame:
        """``rank, id, score, metadata`` by the saved graphs."""
        exact.check_k(top_k)
        self._ready(query)
        extra = dataset.manifest(self.spark, path)["extra"]
        since = self._since(extra["through"])
        if since is None:
            return exact.topk(self.rows(), query, top_k, payload=["metadata"], space=extra["space"])
        gone, fresh = since
        # So many more are asked for as may fall away.
        wide = top_k + gone.count()
        one = self.spark.createDataFrame([(0, [float(x) for x in query])], "query_id int, vector array<float>")
        near = hnsw.search_batch(dataset.load(self.spark, path, kind="hnsw", verify=False), one, wide, max(ef_search, wide)).select("id")
        kept = self.rows().join(F.broadcast(near), "id", "left_semi").join(gone, "id", "left_anti")  # at most ``wide`` ids
        return exact.topk(kept.unionByName(fresh), query, top_k, payload=["metadata"], space=extra["space"])


def register_sql(spark: SparkSession, collection: DataFrame | None = None, name: str = "knn") -> None:
    """SQL functions over the built-in expressions: ``cosine_similarity``, ``squared_l2``, ``dot_product``, ``l2_norm``.

    With a collection (``id, vector, metadata``) also a table function,
    ``SELECT * FROM knn(array(0.9, 0.1), 5)``, of ``rank, id, score, metadata``
    of the k most similar rows. A vector of another dimension raises, k below 1
    gives no rows, null vectors are left out.
    """
    dot = "aggregate(zip_with(CAST(a AS ARRAY<DOUBLE>), CAST(b AS ARRAY<DOUBLE>), (x, y) -> x * y), 0D, (s, x) -> s + x)"
    far = "aggregate(zip_with(CAST(a AS ARRAY<DOUBLE>), CAST(b AS ARRAY<DOUBLE>), (x, y) -> (x - y) * (x - y)), 0D, (s, x) -> s + x)"
    norm = "sqrt(aggregate(transform(CAST({0} AS ARRAY<DOUBLE>), x -> x * x), 0D, (s, x) -> s + x))"
    same = "IF(size(a) = size(b), {0}, CAST(raise_error('vectors of unequal dimension') AS DOUBLE))"
    na, nb = norm.format("a"), norm.format("b")
    two = "(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION dot_product{two} RETURN {same.format(dot)}")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION squared_l2{two} RETURN {same.format(far)}")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION l2_norm(a ARRAY<DOUBLE>) RETURNS DOUBLE RETURN {na}")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION cosine_similarity{two} RETURN IF({na} * {nb} = 0, 0D, greatest(-1D, least(1D, {same.format(dot)} / ({na} * {nb}))))")
    if collection is not None:
        view = f"{name}_collection"
        collection.select("id", "vector", "metadata").createOrReplaceTempView(view)
        kind = collection.schema["id"].dataType.simpleString()
        scored = f"SELECT id, metadata, cosine_similarity(CAST(vector AS ARRAY<DOUBLE>), query) AS s FROM {view} WHERE vector IS NOT NULL"
        ranked = f"SELECT CAST(row_number() OVER (ORDER BY s DESC, id) AS INT) AS rank, id, round(s, {exact.PLACES}) AS score, metadata FROM ({scored})"
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(query ARRAY<DOUBLE>, k INT) RETURNS TABLE(rank INT, id {kind}, score DOUBLE, metadata STRING) RETURN SELECT rank, id, score, metadata FROM ({ranked}) WHERE rank <= k")


__all__ = ["VectorEngine", "register_sql"]
