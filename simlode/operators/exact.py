"""Exact top-K search by scoring every row.

Ties order by score descending, then id ascending, always. Published scores are
rounded to ``PLACES``; ranking uses the unrounded ones.

Defined cases: k below 1 and an unknown space raise; k above the number of rows
gives all rows; an empty collection gives no rows; a null vector is not a
candidate; a vector of another dimension than the query's raises.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from simlode.functions import vector as V
from simlode.functions.matrices import matrix, top

PLACES = 6
SPACES = ("cosine", "l2", "ip")
#: Query components (rows times dimension) that are broadcast; more go through the grid.
BROADCAST_COMPONENTS = 1 << 21
GRID_QUERIES, GRID_ROWS = 4096, 1 << 16


def check_k(k: int) -> None:
    if not isinstance(k, int) or isinstance(k, bool) or k <= 0:
        raise ValueError("top_k must be a positive integer")


def check_space(space: str) -> None:
    if space not in SPACES:
        raise ValueError(f"space must be one of {', '.join(SPACES)}")


def score(vector: Column, query: Column, space: str = "cosine") -> Column:
    check_space(space)
    if space == "cosine":
        return V.cosine_similarity(vector, query)
    return V.score_of_distance(V.squared_l2(vector, query)) if space == "l2" else V.dot(vector, query)


def topk(collection: DataFrame, query: Sequence[float], k: int = 5, id_col: str = "id", vector_col: str = "vector", space: str = "cosine", payload: Sequence[str] = (), where: Column | None = None) -> DataFrame:
    """``rank, id, score`` and the payload of the k best rows for one query.

    The plan is scan, project, TakeOrderedAndProject: each task keeps k rows.
    A filter given as ``where`` reaches the scan.
    """
    check_k(k)
    rows = collection.where(where) if where is not None else collection
    scored = rows.where(F.col(vector_col).isNotNull()).select(F.col(id_col), score(F.col(vector_col), V.literal(query), space).alias("_score"), *payload)
    top = scored.orderBy(F.desc("_score"), F.asc(id_col)).limit(k)
    # The rank of at most k rows.
    rank = F.row_number().over(Window.orderBy(F.desc("_score"), F.asc(id_col))).cast("int")
    return top.select(rank.alias("rank"), id_col, F.round("_score", PLACES).alias("score"), *payload)


def _score_block(q: np.ndarray, qid: pa.Array, rows: np.ndarray, ids: pa.Array, group: pa.Array, k: int, space: str) -> list[pa.Array]:
    """The k best of a block for each query and group of rows, as queries, ids, scores, groups."""
    own = group.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
    order, parts = ids.to_numpy(zero_copy_only=False), []
    for g in np.unique(own):
        at = np.flatnonzero(own == g)
        i, j, s = top(q, rows[at], order[at], k, space)
        parts.append((i, at[j], s))
    i, j, s = (np.concatenate(z) for z in zip(*parts))
    return [qid.take(pa.array(i)), ids.take(pa.array(j)), pa.array(s), group.take(pa.array(j))]


def topk_batch(collection: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "id", vector_col: str = "vector", query_col: str = "query_id", query_vector: str = "vector", space: str = "cosine", dimension: int = 64) -> DataFrame:
    """``query_id, rank, id, score``: the k best rows for each of many queries.

    Up to ``BROADCAST_COMPONENTS`` query components are broadcast and scored
    against each Arrow batch, of which k rows a query go on; nothing is shuffled
    but those. More queries meet the rows in a grid of blocks of bounded size.
    """
    ranked = _ranked(collection, queries, k, id_col, vector_col, query_col, query_vector, space, dimension)
    return ranked.select(F.col("q").alias(query_col), "rank", F.col("n").alias(id_col), F.round("s", PLACES).alias("score"))


def _ranked(collection: DataFrame, queries: DataFrame, k: int, id_col: str, vector_col: str, query_col: str, query_vector: str, space: str, dimension: int, group: str | None = None) -> DataFrame:
    """``q, n, s, rank`` with unrounded scores; with a group column also ``g``, and the rank within it."""
    check_k(k)
    check_space(space)
    q = queries.where(F.col(query_vector).isNotNull()).select(F.col(query_col).alias("q"), V.floats(F.col(query_vector)).alias("v"))
    own = F.col(group) if group else F.lit(0)
    rows = collection.where(F.col(vector_col).isNotNull()).select(F.col(id_col).alias("n"), V.floats(F.col(vector_col)).alias("v"), own.alias("g"))
    limit = max(1, BROADCAST_COMPONENTS // max(dimension, 1))
    some = q.limit(limit + 1).toArrow()
    kinds = q.schema["q"].dataType.simpleString(), rows.schema["n"].dataType.simpleString(), rows.schema["g"].dataType.simpleString()
    schema = f"q {kinds[0]}, n {kinds[1]}, s double, g {kinds[2]}"
    if some.num_rows <= limit:
        held = some.combine_chunks()
        shared = collection.sparkSession.sparkContext.broadcast((matrix(held.column("v"), dimension), held.column("q").combine_chunks() if held.num_rows else pa.array([])))

        def run(batches):
            qv, qid = shared.value
            for batch in batches:
                if batch.num_rows and len(qid):
                    yield pa.RecordBatch.from_arrays(_score_block(qv, qid, matrix(batch.column("v"), dimension), batch.column("n"), batch.column("g"), k, space), names=["q", "n", "s", "g"])

        near = rows.mapInArrow(run, schema)
    else:
        near = _grid(q, rows, k, space, dimension, schema)
    rank = F.row_number().over(Window.partitionBy("q", *(["g"] if group else [])).orderBy(F.desc("s"), "n"))
    return near.select("q", "n", "s", *(["g"] if group else []), rank.cast("int").alias("rank")).where(F.col("rank") <= k)


def _grid(q: DataFrame, rows: DataFrame, k: int, space: str, dimension: int, schema: str) -> DataFrame:
    qb, rb = (max(1, -(-d.count() * 10 // (9 * size))) for d, size in ((q, GRID_QUERIES), (rows, GRID_ROWS)))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    left = q.select("q", F.lit(None).cast(rows.schema["n"].dataType).alias("n"), "v", F.lit(None).cast(rows.schema["g"].dataType).alias("g"), F.lit(True).alias("asks"), block("q", qb).alias("a"), every(rb).alias("b"))
    right = rows.select(F.lit(None).cast(q.schema["q"].dataType).alias("q"), "n", "v", "g", F.lit(False).alias("asks"), block("n", rb).alias("b"), every(qb).alias("a")).select(left.columns)

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        asks = table.column("asks")
        own, others = table.filter(asks), table.filter(pa.compute.invert(asks))
        flat = lambda t, c: t.column(c).combine_chunks()
        if not own.num_rows or not others.num_rows:
            return pa.table({"q": pa.array([], table.schema.field("q").type), "n": pa.array([], table.schema.field("n").type), "s": pa.array([], pa.float64()), "g": pa.array([], table.schema.field("g").type)})
        near = _score_block(matrix(own.column("v"), dimension), flat(own, "q"), matrix(others.column("v"), dimension), flat(others, "n"), flat(others, "g"), k, space)
        return pa.table(dict(zip(("q", "n", "s", "g"), near)))

    return left.unionByName(right).groupBy("a", "b").applyInArrow(run, schema)


def scatter_gather(collection: DataFrame, shard: Column, query: Sequence[float], k: int = 5, id_col: str = "id", vector_col: str = "vector", space: str = "cosine") -> DataFrame:
    """``rank, shard, id, score``: each shard's own k best, then the k best of those.

    The ranking within a shard has a limit, so Spark keeps k rows a shard and
    task before it shuffles (WindowGroupLimit), however skewed the shards are.
    """
    check_k(k)
    scored = collection.where(F.col(vector_col).isNotNull()).select(shard.alias("shard"), F.col(id_col), score(F.col(vector_col), V.literal(query), space).alias("_score"))
    local = F.row_number().over(Window.partitionBy("shard").orderBy(F.desc("_score"), F.asc(id_col)))
    gathered = scored.withColumn("_r", local).where(F.col("_r") <= k).orderBy(F.desc("_score"), F.asc(id_col)).limit(k)
    rank = F.row_number().over(Window.orderBy(F.desc("_score"), F.asc(id_col))).cast("int")
    return gathered.select(rank.alias("rank"), "shard", id_col, F.round("_score", PLACES).alias("score"))


def scatter_gather_batch(collection: DataFrame, shard: str, queries: DataFrame, k: int = 5, id_col: str = "id", vector_col: str = "vector", query_col: str = "query_id", query_vector: str = "vector", space: str = "cosine", dimension: int = 64) -> DataFrame:
    """``query_id, rank, shard, id, score``: for each of many queries each shard's own k best, then the k best of those.

    ``shard`` names a column; rows without one are in no shard. All shards are
    searched in one scan: a task keeps k rows a query and shard.
    """
    local = _ranked(collection.where(F.col(shard).isNotNull()), queries, k, id_col, vector_col, query_col, query_vector, space, dimension, shard).drop("rank")
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("s"), "n"))
    return local.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select(F.col("q").alias(query_col), "rank", F.col("g").alias("shard"), F.col("n").alias(id_col), F.round("s", PLACES).alias("score"))
