"""Inverted-file search: rows in cells around centroids, of which a query probes a few.

Centroids are a small table (checked against ``MAX_COMPONENTS``) and go to the
tasks by broadcast; rows are assigned in Arrow batches without a shuffle. On
disk (:class:`Index`) the rows are partitioned by ``cluster_id``, so a query or a
batch reads only the cells it probes; the sizes of the cells stand in the
manifest, and rows can be added to an index without training it anew.

Distances to centroids are squared L2, the nearest centroid of equals is the
first. Inside the probed cells the score is the exact cosine.

Defined cases: an untrained index, fewer training rows than cells, and a
non-positive cell count, ``nprobe`` or k raise; ``nprobe`` beyond the number of
cells means all; empty cells give no rows; rows of another dimension raise;
training starts from the rows of lowest hash and runs a fixed number of Lloyd
rounds, so it repeats exactly but for the order in which Spark adds numbers.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from simlode.functions import vector as V
from simlode.functions.matrices import matrix, top
from simlode.operators.exact import PLACES, check_k, topk
from simlode.session import settle
from simlode.sources import files

MAX_COMPONENTS = 1 << 24


def _typed(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def nearest(rows: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and squared distance of each row's nearest centroid, the first of equals."""
    out, far = np.empty(len(rows), np.int32), np.empty(len(rows))
    for at in range(0, len(rows), 1024):
        x = rows[at : at + 1024]
        # The expanded form finds who is close; the plain one decides among those.
        rough = (x * x).sum(1)[:, None] + (centroids * centroids).sum(1) - 2 * x @ centroids.T
        close = rough <= rough.min(1, keepdims=True) + 1e-9 * (1 + np.abs(rough).max(1, keepdims=True))
        i, j = np.nonzero(close)
        d = ((x[i] - centroids[j]) ** 2).sum(1)
        order = np.lexsort((j, d, i))
        first = np.flatnonzero(np.diff(i[order], prepend=-1))
        out[at : at + 1024], far[at : at + 1024] = j[order][first], d[order][first]
    return out, far


class Centroids:
    """Centroids with their ids, in order of the id."""

    def __init__(self, ids: Sequence[int], rows: np.ndarray):
        rows = np.asarray(rows, np.float64)
        if rows.size > MAX_COMPONENTS:
            raise ValueError("too many centroids to broadcast")
        order = np.argsort(ids)
        self.ids, self.rows = np.asarray(ids, np.int32)[order], rows[order]

    @classmethod
    def of(cls, table: DataFrame, id_col: str = "cluster_id", vector_col: str = "centroid") -> Centroids:
        width = table.select(F.max(F.size(vector_col))).first()[0] or 1
        got = table.select(id_col, V.doubles(F.col(vector_col)).alias("c")).limit(MAX_COMPONENTS // width + 1).toPandas()
        return cls(got[id_col].to_list(), np.stack(got["c"].to_list()) if len(got) else np.empty((0, width)))

    @property
    def dimension(self) -> int:
        return self.rows.shape[1]

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(int(i), r.tolist()) for i, r in zip(self.ids, self.rows)], "cluster_id int, centroid array<double>")

    def probes(self, query: Sequence[float], nprobe: int) -> list[int]:
        """The ids of the cells nearest to a query."""
        if nprobe <= 0:
            raise ValueError("nprobe must be positive")
        d = ((self.rows - np.asarray(query, np.float64)) ** 2).sum(1)
        return self.ids[np.lexsort((self.ids, d))[:nprobe]].tolist()


def mean_by(rows: DataFrame, group: str, vector_col: str) -> DataFrame:
    """``cluster_id, centroid``: element-wise means, combined on the map side."""
    flat = rows.where(F.col(group).isNotNull()).select(F.col(group).cast("int").alias("cluster_id"), F.posexplode(V.doubles(F.col(vector_col))).alias("pos", "x"))
    means = flat.groupBy("cluster_id", "pos").agg(F.avg("x").alias("x"))
    # One short row a cell and position.
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"])
    return means.groupBy("cluster_id").agg(ordered.alias("centroid"))


def assign(rows: DataFrame, centroids: Centroids, vector_col: str = "vector", cluster_col: str = "cluster_id") -> DataFrame:
    """The rows with the id of their nearest centroid; all other columns as they are."""
    names = rows.columns
    tmp = rows.toDF(*[f"c{i}" for i in range(len(names))])
    at, dim = names.index(vector_col), centroids.dimension
    shared = rows.sparkSession.sparkContext.broadcast(centroids)

    def run(batches):
        c = shared.value
        for batch in batches:
            own, _ = nearest(matrix(batch.column(at), dim), c.rows)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(c.ids[own])], names=[*batch.schema.names, "cell"])

    schema = ", ".join([*(f"c{i} {_typed(rows, n)}" for i, n in enumerate(names)), "cell int"])
    return tmp.mapInArrow(run, schema).toDF(*names, cluster_col)


def lloyd_step(rows: DataFrame, centroids: Centroids, vector_col: str = "vector") -> DataFrame:
    """One round of k-means: the means of the rows nearest to each centroid, ``cluster_id, centroid``.

    Sums of each task travel, never rows.
    """
    dim = centroids.dimension
    shared = rows.sparkSession.sparkContext.broadcast(centroids)

    def run(batches):
        c = shared.value
        sums, counts = np.zeros(c.rows.shape), np.zeros(len(c.ids))
        for batch in batches:
            x = matrix(batch.column(0), dim)
            own, _ = nearest(x, c.rows)
            np.add.at(sums, own, x)
            counts += np.bincount(own, minlength=len(c.ids))
        some = np.flatnonzero(counts)
        cell, pos = np.repeat(c.ids[some], dim), np.tile(np.arange(dim, dtype=np.int32), len(some))
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(pos), pa.array(sums[some].ravel()), pa.array(np.repeat(counts[some], dim))], names=["cluster_id", "pos", "s", "n"])

    parts = rows.where(F.col(vector_col).isNotNull()).select(V.floats(F.col(vector_col)).alias("v")).mapInArrow(run, "cluster_id int, pos int, s double, n double")
    means = parts.groupBy("cluster_id", "pos").agg((F.sum("s") / F.sum("n")).alias("x"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"])
    return means.groupBy("cluster_id").agg(ordered.alias("centroid"))


def kmeans(rows: DataFrame, n_clusters: int, vector_col: str = "vector", rounds: int = 12, seed: int = 42) -> Centroids:
    """Centroids by Lloyd rounds over all rows; a cell that empties keeps its centroid."""
    return Centroids(range(max(n_clusters, 0)), kmeans_parts(rows, n_clusters, 1, vector_col, rounds, seed)[0])


def kmeans_parts(rows: DataFrame, n_clusters: int, parts: int = 1, vector_col: str = "vector", rounds: int = 12, seed: int = 42) -> np.ndarray:
    """``[part, cluster, component]``: k-means of each of ``parts`` equal stretches of the vectors, all in one pass a round.

    The rows are settled once. Sums of each task travel, never rows.
    """
    if n_clusters <= 0:
        raise ValueError("n_clusters must be positive")
    sound = settle(rows.where(F.col(vector_col).isNotNull()).select(V.floats(F.col(vector_col)).alias("v")), "training")
    start = sound.orderBy(F.xxhash64("v", F.lit(seed)), "v").limit(n_clusters).toPandas()["v"]
    if len(start) < n_clusters:
        raise ValueError("fewer training rows than clusters")
    current = np.stack(start.to_list()).astype(np.float64).reshape(n_clusters, parts, -1).transpose(1, 0, 2).copy()
    width = current.shape[2]
    for _ in range(rounds):
        shared = rows.sparkSession.sparkContext.broadcast(current)

        def run(batches, shared=shared):
            c = shared.value
            sums = np.zeros((parts, n_clusters, width + 1))
            for batch in batches:
                x = matrix(batch.column(0), parts * width)
                for m in range(parts):
                    some = x[:, m * width : (m + 1) * width]
                    own, _ = nearest(some, c[m])
                    order = np.argsort(own, kind="stable")
                    first = np.flatnonzero(np.diff(own[order], prepend=-1)) if len(own) else np.empty(0, np.int64)
                    if len(first):
                        sums[m, own[order][first], :width] += np.add.reduceat(some[order], first, axis=0)
                    sums[m, :, width] += np.bincount(own, minlength=n_clusters)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(sums.size, dtype=np.int32)), pa.array(sums.ravel())], names=["i", "x"])

        got = sound.mapInArrow(run, "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).toPandas()
        shared.destroy()
        total = np.zeros(parts * n_clusters * (width + 1))
        total[got["i"].to_numpy()] = got["x"].to_numpy()
        total = total.reshape(parts, n_clusters, width + 1)
        new = np.where(total[:, :, width:] > 0, total[:, :, :width] / np.maximum(total[:, :, width:], 1), current)
        still = np.allclose(new, current, rtol=0, atol=1e-9)
        current = new
        if still:
            break
    return current


def search(cells: DataFrame, centroids: Centroids, query: Sequence[float], k: int = 5, nprobe: int = 1, id_col: str = "id", vector_col: str = "vector", payload: Sequence[str] = ()) -> DataFrame:
    """Top k of one query within its cells; the literal cell list prunes partitions of the scan."""
    if len(query) != centroids.dimension:
        raise ValueError("query has another dimension than the index")
    probed = F.col("cluster_id").isin(centroids.probes(query, nprobe))
    return topk(cells, query, k, id_col, vector_col, payload=payload, where=probed)


def probe_table(queries: DataFrame, centroids: Centroids, nprobe: int, query_col: str = "query_id", query_vector: str = "vector") -> DataFrame:
    """``query, cluster_id, probe_rank, distance``: the cells each query probes."""
    if nprobe <= 0:
        raise ValueError("nprobe must be positive")
    c = centroids.table(queries.sparkSession)
    pairs = queries.select(F.col(query_col), V.doubles(F.col(query_vector)).alias("_q")).join(F.broadcast(c), F.lit(True))  # centroids: checked size
    d = pairs.select(query_col, "cluster_id", V.squared_l2(F.col("_q"), F.col("centroid")).alias("distance"))
    rank = F.row_number().over(Window.partitionBy(query_col).orderBy("distance", "cluster_id"))
    return d.withColumn("probe_rank", rank.cast("int")).where(F.col("probe_rank") <= nprobe)


def search_batch(cells: DataFrame, centroids: Centroids, queries: DataFrame, k: int = 5, nprobe: int = 1, id_col: str = "id", vector_col: str = "vector", query_col: str = "query_id", query_vector: str = "vector", block_rows: int = 1 << 15, sizes: dict[int, int] | None = None) -> DataFrame:
    """``query, rank, id, score`` for many queries.

    Queries go to the cells they probe, and only those cells are read: their
    list filters ``cluster_id``, which prunes partitions where cells are stored
    so. Each cell is split into blocks by a hash of the id, as many as its size
    asks for, and its queries go to each. ``sizes`` saves counting the cells.
    """
    check_k(k)
    dim = centroids.dimension
    ids, qids = _typed(cells, id_col), _typed(queries, query_col)
    q = queries.where(F.col(query_vector).isNotNull()).select(F.col(query_col).alias("q"), V.floats(F.col(query_vector)).alias("v"))
    probes = min(nprobe, len(centroids.ids)) if nprobe > 0 else nprobe
    shared = cells.sparkSession.sparkContext.broadcast(centroids)
    if probes <= 0:
        raise ValueError("nprobe must be positive")

    def choose(batches):
        c = shared.value
        for batch in batches:
            row, at, _ = top(matrix(batch.column("v"), dim), c.rows, c.ids, probes, "l2")
            offsets = pa.array(np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("q"), batch.column("v"), pa.ListArray.from_arrays(offsets, pa.array(c.ids[at]))], names=["q", "v", "cells"])

    asked = q.mapInArrow(choose, f"q {qids}, v array<float>, cells array<int>").select("q", "v", F.explode("cells").alias("cell"))
    probed = sorted(r["cell"] for r in asked.select("cell").distinct().collect())  # at most one line a cell, as everything here
    if len(probed) < len(centroids.ids):
        cells = cells.where(F.col("cluster_id").isin(probed))
    if sizes is None:
        sizes = {r["cluster_id"]: r["count"] for r in cells.groupBy("cluster_id").count().collect()}
    blocks = F.broadcast(cells.sparkSession.createDataFrame([(c, -(-sizes[c] // block_rows)) for c in probed if sizes.get(c)], "cell int, blocks int"))
    left = asked.join(blocks, "cell").select(F.lit(True).alias("asks"), "q", F.lit(None).cast(ids).alias("n"), "v", "cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    own = cells.where(F.col(vector_col).isNotNull()).select(F.lit(False).alias("asks"), F.lit(None).cast(qids).alias("q"), F.col(id_col).alias("n"), V.floats(F.col(vector_col)).alias("v"), F.col("cluster_id").alias("cell"))
    right = own.join(blocks, "cell").select("asks", "q", "n", "v", "cell", F.pmod(F.xxhash64("n"), F.col("blocks")).cast("int").alias("block"))

    def run(table: pa.Table) -> pa.Table:
        asks = table.column("asks")
        own, others = table.filter(asks).combine_chunks(), table.filter(pa.compute.invert(asks)).combine_chunks()
        if not own.num_rows or not others.num_rows:
            return pa.table({"q": pa.array([], own.schema.field("q").type), "n": pa.array([], own.schema.field("n").type), "s": pa.array([], pa.float64())})
        n = others.column("n").combine_chunks()
        row, at, s = top(matrix(own.column("v"), dim), matrix(others.column("v"), dim), n.to_numpy(zero_copy_only=False), k, "cosine")
        return pa.table({"q": own.column("q").combine_chunks().take(pa.array(row)), "n": n.take(pa.array(at)), "s": pa.array(s)})

    near = left.unionByName(right).groupBy("cell", "block").applyInArrow(run, f"q {qids}, n {ids}, s double")
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("s"), "n"))
    return near.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select(F.col("q").alias(query_col), "rank", F.col("n").alias(id_col), F.round("s", PLACES).alias("score"))


class Index:
    """An inverted file below ``path``: centroids, and cells as partitions, under manifests put in place by rename."""

    def __init__(self, spark: SparkSession, path: str, verify: bool = False):
        self.spark, self.path = spark, path.rstrip("/")
        names = [n for n in files.children(spark, f"{self.path}/manifests") if n.endswith(".json")]
        if not names:
            raise ValueError(f"no index below {path}")
        self.manifest = files.read_json(spark, f"{self.path}/manifests/{names[-1]}")
        self.centroids = Centroids.of(spark.read.schema("cluster_id int, centroid array<double>").parquet(f"{self.path}/{self.manifest['centroids']}"))
        if verify and self._sizes(self.cells) != self.sizes:
            raise ValueError("cells do not match their manifest")

    @classmethod
    def create(cls, rows: DataFrame, centroids: Centroids, path: str, vector_col: str = "vector", extra: dict | None = None) -> Index:
        """Assign rows to cells and save them with the centroids."""
        spark, path = rows.sparkSession, path.rstrip("/")
        place = f"centroids/{uuid.uuid4().hex}"
        centroids.table(spark).coalesce(1).write.parquet(f"{path}/{place}")
        return cls._write(rows, centroids, path, vector_col, {"version": 0, "centroids": place, "places": [], "sizes": {}}, extra)

    @classmethod
    def _write(cls, rows: DataFrame, centroids: Centroids, path: str, vector_col: str, old: dict, extra: dict | None) -> Index:
        spark, version = rows.sparkSession, old["version"] + 1
        place = f"cells/{version:010d}-{uuid.uuid4().hex}"
        assigned = assign(rows.where(F.col(vector_col).isNotNull()), centroids, vector_col)
        # Files of a cell lie together, as even as Spark can make them however uneven cells are.
        assigned.hint("rebalance", "cluster_id").write.partitionBy("cluster_id").parquet(f"{path}/{place}")
        schema = T.StructType([*rows.schema.fields, T.StructField("cluster_id", T.IntegerType())])
        added = cls._sizes(spark.read.schema(schema).parquet(f"{path}/{place}"))
        sizes = {c: old["sizes"].get(str(c), 0) + added.get(c, 0) for c in {*map(int, old["sizes"]), *added}}
        files.commit_json(spark, f"{path}/manifests/{version:010d}.json", {"version": version, "centroids": old["centroids"], "places": [*old["places"], place], "sizes": sizes, "schema": schema.jsonValue(), "vector": vector_col, "extra": extra or {}})
        return cls(spark, path)

    @staticmethod
    def _sizes(cells: DataFrame) -> dict[int, int]:
        return {r["cluster_id"]: r["count"] for r in cells.groupBy("cluster_id").count().collect()}

    @property
    def sizes(self) -> dict[int, int]:
        return {int(c): n for c, n in self.manifest["sizes"].items()}

    @property
    def extra(self) -> dict:
        return self.manifest["extra"]

    @property
    def cells(self) -> DataFrame:
        """The rows with their ``cluster_id``; a filter on it prunes what is read."""
        read = self.spark.read.schema(T.StructType.fromJson(self.manifest["schema"]))
        return reduce(DataFrame.union, (read.parquet(f"{self.path}/{p}") for p in self.manifest["places"]))

    def add(self, rows: DataFrame, extra: dict | None = None) -> Index:
        """The index with further rows of the same columns in the cells it has; the cells that were there stay as they are."""
        names = [n for n in self.cells.columns if n != "cluster_id"]
        return self._write(rows.select(*names), self.centroids, self.path, self.manifest["vector"], self.manifest, {**self.extra, **(extra or {})})

    def search(self, query: Sequence[float], k: int = 5, nprobe: int = 1, id_col: str = "id", payload: Sequence[str] = ()) -> DataFrame:
        return search(self.cells, self.centroids, query, k, nprobe, id_col, self.manifest["vector"], payload)

    def search_batch(self, queries: DataFrame, k: int = 5, nprobe: int = 1, id_col: str = "id", query_col: str = "query_id", query_vector: str = "vector", block_rows: int = 1 << 15) -> DataFrame:
        return search_batch(self.cells, self.centroids, queries, k, nprobe, id_col, self.manifest["vector"], query_col, query_vector, block_rows, self.sizes)
