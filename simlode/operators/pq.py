"""Product quantization: train, encode, decode, and search over the codes.

A codebook has M sub-spaces of K centroids each (K at most 256, so a code is a
byte; stored as ``array<smallint>``). It is small and broadcast after a check.

Defined cases: a dimension not divisible by M, K outside 1..256, M below 1, and
fewer training rows than K raise; the nearest centroid of equals is the first;
codes outside the codebook raise when decoded; an unloaded or untrained codebook
cannot exist, as training makes it.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from simlode.functions import vector as V
from simlode.functions.matrices import best, lists, matrix
from simlode.operators.exact import BROADCAST_COMPONENTS, PLACES, check_k, topk
from simlode.operators.ivf import MAX_COMPONENTS, kmeans_parts, nearest


class Codebook:
    """``rows[m, code]`` is a centroid of sub-space m."""

    def __init__(self, rows: np.ndarray):
        rows = np.asarray(rows, np.float32)
        if rows.ndim != 3 or not 1 <= rows.shape[1] <= 256 or rows.shape[0] < 1:
            raise ValueError("a codebook has M >= 1 sub-spaces of 1 to 256 centroids")
        if rows.size > MAX_COMPONENTS:
            raise ValueError("codebook too large to broadcast")
        self.rows = rows

    @property
    def dimension(self) -> int:
        return self.rows.shape[0] * self.rows.shape[2]

    @classmethod
    def of(cls, table: DataFrame) -> Codebook:
        """From ``m, code, centroid``."""
        got = sorted((r.m, r.code, r.centroid) for r in table.select("m", "code", "centroid").limit(MAX_COMPONENTS).collect())
        m, k = max(r[0] for r in got) + 1, max(r[1] for r in got) + 1
        if len(got) != m * k:
            raise ValueError("codebook has holes")
        return cls(np.array([r[2] for r in got], np.float32).reshape(m, k, -1))

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(m, c, self.rows[m, c].tolist()) for m in range(self.rows.shape[0]) for c in range(self.rows.shape[1])], "m int, code int, centroid array<float>")


def check(dimension: int, subspaces: int, centroids: int) -> int:
    """The width of a sub-vector."""
    if subspaces <= 0 or not 1 <= centroids <= 256:
        raise ValueError("n_subspaces must be positive and n_centroids between 1 and 256")
    if dimension % subspaces:
        raise ValueError("dimension must be divisible by n_subspaces")
    return dimension // subspaces


def train(rows: DataFrame, dimension: int, subspaces: int = 8, centroids: int = 256, vector_col: str = "vector", rounds: int = 8, seed: int = 42) -> Codebook:
    """One k-means a sub-space, over all rows, all sub-spaces in the same passes."""
    check(dimension, subspaces, centroids)
    return Codebook(kmeans_parts(rows, centroids, subspaces, vector_col, rounds, seed))


def lowest_rows(rows: DataFrame, dimension: int, subspaces: int, centroids: int, id_col: str, vector_col: str) -> Codebook:
    """A deterministic codebook: the sub-vectors of the rows of lowest id."""
    width = check(dimension, subspaces, centroids)
    got = rows.orderBy(id_col).limit(centroids).select(V.floats(F.col(vector_col)).alias("v")).collect()
    if len(got) < centroids:
        raise ValueError("fewer training rows than centroids")
    x = np.array([r.v for r in got], np.float32).reshape(centroids, subspaces, width)
    return Codebook(x.transpose(1, 0, 2))


def _map(df: DataFrame, keys: Sequence[str], column: str, book: Codebook, out: str, kind: str, work) -> DataFrame:
    """``keys`` and one list column made from another, batch by batch."""
    shared = df.sparkSession.sparkContext.broadcast(book)
    types = [df.schema[k].dataType.simpleString() for k in keys]
    source = df.select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], F.col(column).alias("x")).where("x IS NOT NULL")

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], work(shared.value, batch.column("x"))], names=[*batch.schema.names[:-1], "y"])

    schema = ", ".join([*(f"k{i} {t}" for i, t in enumerate(types)), f"y {kind}"])
    return source.mapInArrow(run, schema).toDF(*keys, out)


def encode(rows: DataFrame, book: Codebook, keys: Sequence[str], vector_col: str = "vector", out: str = "codes") -> DataFrame:
    """``keys`` and the codes of each vector."""

    def work(b: Codebook, column: pa.Array) -> pa.Array:
        m, _, d = b.rows.shape
        x = matrix(column, b.dimension)
        codes = np.stack([nearest(x[:, i * d : (i + 1) * d], b.rows[i].astype(np.float64))[0] for i in range(m)], axis=1) if len(x) else np.empty((0, m), np.int32)
        return lists(codes.astype(np.int16), pa.int16())

    return _map(rows, keys, vector_col, book, out, "array<smallint>", work)


def decode(codes: DataFrame, book: Codebook, keys: Sequence[str], codes_col: str = "codes", out: str = "vector") -> DataFrame:
    """``keys`` and the vector that the codes stand for."""

    def work(b: Codebook, column: pa.Array) -> pa.Array:
        m, k, _ = b.rows.shape
        c = matrix(column, m).astype(np.int64)
        if c.size and (c.min() < 0 or c.max() >= k):
            raise ValueError("code outside the codebook")
        return lists(b.rows[np.arange(m), c].reshape(len(c), -1), pa.float32())

    return _map(codes, keys, codes_col, book, out, "array<float>", work)


def search(codes: DataFrame, book: Codebook, query: Sequence[float], k: int = 5, id_col: str = "id", codes_col: str = "codes") -> DataFrame:
    """Decode, then exact cosine top k."""
    return topk(decode(codes, book, [id_col], codes_col), query, k, id_col, "vector")


def lookup(book: Codebook, query: Sequence[float]) -> np.ndarray:
    """Squared distance of each sub-vector of the query to each centroid."""
    m, _, d = book.rows.shape
    q = np.asarray(query, np.float64)
    if len(q) != book.dimension:
        raise ValueError("query has another dimension than the codebook")
    return ((book.rows.astype(np.float64) - q.reshape(m, 1, d)) ** 2).sum(2)


def adc_search(codes: DataFrame, book: Codebook, query: Sequence[float], k: int = 5, id_col: str = "id", codes_col: str = "codes") -> DataFrame:
    """``rank, id, distance`` by asymmetric distances: M lookups a row, nothing decoded.

    The lookup table is a literal of M times K numbers; the plan stays on the
    JVM and ends in TakeOrderedAndProject.
    """
    check_k(k)
    tables = lookup(book, query)
    parts = [F.element_at(F.array(*[F.lit(float(x)) for x in t]), F.element_at(F.col(codes_col), i + 1).cast("int") + 1) for i, t in enumerate(tables)]
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    top = codes.select(id_col, total.alias("_d")).orderBy("_d", id_col).limit(k)
    rank = F.row_number().over(Window.orderBy("_d", id_col)).cast("int")
    return top.select(rank.alias("rank"), id_col, F.round("_d", PLACES).alias("distance"))


def adc_search_batch(codes: DataFrame, book: Codebook, queries: DataFrame, k: int = 5, id_col: str = "id", codes_col: str = "codes", query_col: str = "query_id", query_vector: str = "vector") -> DataFrame:
    """``query_id, rank, id, distance`` by asymmetric distances for many queries.

    Queries are broadcast, up to ``BROADCAST_COMPONENTS`` of their components at
    a time; more cost another scan of the codes each. k rows a query and batch
    go on.
    """
    check_k(k)
    q = queries.where(F.col(query_vector).isNotNull()).select(F.col(query_col).alias("q"), V.floats(F.col(query_vector)).alias("v"))
    rows = codes.where(F.col(codes_col).isNotNull()).select(F.col(id_col).alias("n"), F.col(codes_col).alias("c"))
    schema = f"q {q.schema['q'].dataType.simpleString()}, n {rows.schema['n'].dataType.simpleString()}, d double"

    def scanned(part: list) -> DataFrame:
        if any(len(r.v) != book.dimension for r in part):
            raise ValueError("query has another dimension than the codebook")
        qids, vectors = pa.array([r.q for r in part]), np.array([r.v for r in part], np.float64)
        shared = codes.sparkSession.sparkContext.broadcast((book, qids, vectors))

        def run(batches):
            b, ids, x = shared.value
            m = b.rows.shape[0]
            for batch in batches:
                c = matrix(batch.column("c"), m).astype(np.int64)
                order = batch.column("n").to_numpy(zero_copy_only=False)
                for at in range(0, len(x) if len(c) else 0, 64):
                    tables = np.stack([lookup(b, v) for v in x[at : at + 64]])
                    far = sum(tables[:, i, c[:, i]] for i in range(m))
                    pick = best(-far, order, k)
                    row = np.repeat(np.arange(len(far)), pick.shape[1])
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(row + at)), batch.column("n").take(pa.array(pick.ravel())), pa.array(far[row, pick.ravel()])], names=["q", "n", "d"])

        return rows.mapInArrow(run, schema)

    near, part, most = None, [], max(1, BROADCAST_COMPONENTS // book.dimension)
    for r in q.toLocalIterator():
        part.append(r)
        if len(part) == most:
            more = scanned(part)
            near, part = more if near is None else near.unionByName(more), []
    if part or near is None:
        more = scanned(part)
        near = more if near is None else near.unionByName(more)
    rank = F.row_number().over(Window.partitionBy("q").orderBy("d", "n"))
    ranked = near.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k)
    return ranked.select(F.col("q").alias(query_col), "rank", F.col("n").alias(id_col), F.round("d", PLACES).alias("distance"))


def rerank(candidates: DataFrame, rows: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "id", vector_col: str = "vector", query_col: str = "query_id", query_vector: str = "vector") -> DataFrame:
    """``query_id, rank, id, score``: the k candidates of each query that are nearest by exact cosine."""
    check_k(k)
    own = rows.select(id_col, V.doubles(F.col(vector_col)).alias("_v"))
    asked = queries.select(query_col, V.doubles(F.col(query_vector)).alias("_q"))
    scored = candidates.select(query_col, id_col).join(own, id_col).join(asked, query_col).select(query_col, id_col, V.cosine_similarity(F.col("_v"), F.col("_q")).alias("_s"))
    rank = F.row_number().over(Window.partitionBy(query_col).orderBy(F.desc("_s"), id_col))
    return scored.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select(query_col, "rank", id_col, F.round("_s", PLACES).alias("score"))


def errors(rows: DataFrame, decoded: DataFrame, id_col: str, vector_col: str, decoded_col: str = "vector") -> DataFrame:
    """One row: mean and largest squared distance between vectors and what their codes stand for."""
    d = decoded.select(id_col, F.col(decoded_col).alias("_d"))
    e = rows.select(id_col, vector_col).join(d, id_col).select(V.squared_l2(F.col(vector_col), F.col("_d")).alias("e"))
    return e.agg(F.round(F.avg("e"), PLACES).alias("mean_error"), F.round(F.max("e"), PLACES).alias("max_error"))


def compression(rows: int, dimension: int, subspaces: int, centroids: int) -> dict[str, float]:
    """Raw, code and codebook bytes; ratios with and without the codebook; bytes saved in percent."""
    width = check(dimension, subspaces, centroids)
    raw, code, book = rows * dimension * 4, rows * subspaces, subspaces * centroids * width * 4
    return {"raw_bytes": raw, "code_bytes": code, "codebook_bytes": book, "ratio": raw / (code + book), "ratio_codes": raw / code if code else 0.0, "saved_pct": 100 * (1 - code / raw) if raw else 0.0}
