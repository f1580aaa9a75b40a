"""Hierarchical navigable small-world graphs, one a shard.

Rows are sharded by a hash of the id; each shard builds graphs of at most
``max_elements`` rows in one task and stores each as one row (the graph's arrays,
packed), so search reads a graph and its vectors from Parquet and runs anywhere.
Every query visits every graph and the answers are merged by rank, as in exact
search.

The graph follows Malkov and Yashunin (arXiv:1603.09320): levels drawn from an
exponential law, links to neighbours among earlier rows chosen by the diversity
rule, greedy descent and a beam of ``ef_search`` candidates. It is built and
searched for many rows and queries at once. As a graph is of bounded size, the
``ef_construction`` nearest earlier rows are found exactly, by blocks, where the
paper uses a beam; rows that cannot be reached from the entry get a link from the
nearest row that can.

Spaces: ``cosine`` (1 - cosine), ``l2`` (squared), ``ip`` (1 - dot); the score
is 1 - distance in each, not clipped, in double precision.

Defined cases: ids of any type that can be sorted; a non-positive dimension,
capacity or k raises, as do vectors of another dimension and unknown spaces; k
beyond the collection gives all; an empty collection gives no rows; repeated ids
raise when built; null vectors are not stored and null queries not answered.
"""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from simlode.functions import vector as V
from simlode.functions.matrices import matrix, unit
from simlode.operators.exact import PLACES, SPACES, check_k

#: Query components that are broadcast to where the graphs are; more meet them in blocks of queries.
BROADCAST_COMPONENTS = 1 << 21
QUERY_BLOCK = 4096
_BLOCK, _TILE, _AT_ONCE = 1024, 128, 4


class Graph:
    """The graph of some vectors; ``links[l]`` holds the neighbours of ``nodes[l]`` on level l, -1 where there is none."""

    def __init__(self, rows: np.ndarray, M: int = 16, ef_construction: int = 200, space: str = "cosine", seed: int = 42):
        self.space, self.M = space, M
        self._hold(np.asarray(rows, np.float32))
        n = len(self.raw)
        draws = np.random.default_rng(seed).random(n)
        levels = np.floor(-np.log(np.maximum(draws, 1e-12)) / np.log(max(M, 2))).astype(int)
        self.nodes, self.links = [], []
        for level in range(int(levels.max()) + 1 if n else 0):
            nodes = np.flatnonzero(levels >= level).astype(np.int32)
            self.nodes.append(nodes)
            self.links.append(self._level(nodes, 2 * M if level == 0 else M, ef_construction))
        self.entry = int(self.nodes[-1][0]) if n else -1
        if n:
            self._reach_all()

    def _hold(self, raw: np.ndarray) -> None:
        self.raw = raw
        self.rows = (unit(raw.astype(np.float64)) if self.space == "cosine" and len(raw) else raw).astype(np.float32)

    def _far(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Distances of vectors in the last axis, broadcast."""
        return ((x - y) ** 2).sum(-1) if self.space == "l2" else 1 - (x * y).sum(-1)

    def _table(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Distances of all rows of x to all of y."""
        if self.space == "l2":
            return np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1) - 2 * (x @ y.T), 0)
        return 1 - x @ y.T

    def _diverse(self, of: np.ndarray, found: np.ndarray, far: np.ndarray, most: int) -> np.ndarray:
        """Of each row's candidates, nearest first (-1: none), those nearer to it than to one another, filled up with the nearest left."""
        n, c = found.shape
        kept, count = np.full((n, most), -1, np.int32), np.zeros(n, int)
        taken = np.zeros((n, c), bool)
        for j in range(c):
            open_ = np.flatnonzero((count < most) & (found[:, j] >= 0))
            if not len(open_):
                break
            x = self.rows[found[open_, j]]
            others = kept[open_]
            apart = self._far(x[:, None, :], self.rows[np.maximum(others, 0)])
            fine = open_[(np.where(others >= 0, apart, np.inf) > far[open_, j, None]).all(1)]
            kept[fine, count[fine]] = found[fine, j]
            count[fine] += 1
            taken[fine, j] = True
        # The nearest of those left out fill the row.
        left = np.where(taken | (found < 0), np.inf, far)
        order = np.argsort(left, axis=1, kind="stable")
        for j in range(c):
            open_ = np.flatnonzero((count < most) & np.isfinite(left[np.arange(n), order[:, j]]))
            if not len(open_):
                break
            kept[open_, count[open_]] = found[open_, order[open_, j]]
            count[open_] += 1
        return kept

    def _level(self, nodes: np.ndarray, most: int, ef: int) -> np.ndarray:
        x, n = self.rows[nodes], len(nodes)
        out = np.full((n, self.M), -1, np.int32)
        for at in range(0, n, _BLOCK):
            stop = min(n, at + _BLOCK)
            far = self._table(x[at:stop], x[:stop])
            far[np.arange(stop)[None, :] >= np.arange(at, stop)[:, None]] = np.inf  # earlier rows only
            c = min(ef, stop)
            some = np.argpartition(far, c - 1, axis=1)[:, :c]
            d = np.take_along_axis(far, some, axis=1)
            order = np.argsort(d, axis=1, kind="stable")
            some, d = np.take_along_axis(some, order, axis=1), np.take_along_axis(d, order, axis=1)
            out[at:stop] = self._diverse(nodes[at:stop], np.where(np.isfinite(d), nodes[some], -1), d, self.M)
        # Links go both ways; a row with too many keeps the diverse ones.
        place = np.full(len(self.rows), -1, np.int64)
        place[nodes] = np.arange(n)
        a, col = np.nonzero(out >= 0)
        b = place[out[a, col]]
        pairs = np.unique(np.concatenate([np.stack([a, b]), np.stack([b, a])], axis=1), axis=1) if len(a) else np.empty((2, 0), np.int64)
        degree = np.bincount(pairs[0], minlength=n)
        first = np.cumsum(degree) - degree
        links = np.full((n, most), -1, np.int32)
        for at in range(0, n, _BLOCK):
            rows = np.arange(at, min(n, at + _BLOCK))
            wide = max(1, int(degree[rows].max()))
            slot = np.arange(wide)[None, :]
            near = np.where(slot < degree[rows, None], pairs[1][np.minimum(first[rows, None] + slot, max(0, pairs.shape[1] - 1))] if pairs.shape[1] else 0, -1)
            d = np.where(near >= 0, self._far(x[rows][:, None, :], x[np.maximum(near, 0)]), np.inf) if wide * len(rows) < 1 << 18 else np.concatenate([np.where(near[i : i + 32] >= 0, self._far(x[rows[i : i + 32]][:, None, :], x[np.maximum(near[i : i + 32], 0)]), np.inf) for i in range(0, len(rows), 32)])
            order = np.argsort(d, axis=1, kind="stable")
            near, d = np.take_along_axis(near, order, axis=1), np.take_along_axis(d, order, axis=1)
            found = np.where(near >= 0, nodes[np.maximum(near, 0)], -1).astype(np.int32)
            full = degree[rows] > most
            short = found[:, :most]
            links[rows[~full], : short.shape[1]] = short[~full]
            if full.any():
                links[rows[full]] = self._diverse(nodes[rows[full]], found[full], d[full], most)
        return links

    def _reach_all(self) -> None:
        links, n = self.links[0], len(self.rows)
        extra: list[tuple[int, int]] = []
        seen = np.zeros(n, bool)
        edge = np.array([self.entry])
        while True:
            seen[edge] = True
            while len(edge):
                near = np.unique(links[edge])
                edge = near[(near >= 0) & ~seen[np.maximum(near, 0)]]
                seen[edge] = True
            lost = np.flatnonzero(~seen)
            if not len(lost):
                break
            held = np.flatnonzero(seen)
            d = self._table(self.rows[lost[:1]], self.rows[held])[0]
            extra.append((int(held[d.argmin()]), int(lost[0])))
            edge = lost[:1]
        if extra:
            a, b = np.array(extra).T
            order = np.argsort(a, kind="stable")
            a, b = a[order], b[order]
            slot = np.arange(len(a)) - np.searchsorted(a, a)
            more = np.full((n, int(slot.max()) + 1), -1, np.int32)
            more[a, slot] = b
            self.links[0] = np.concatenate([links, more], axis=1)

    def search(self, queries: np.ndarray, k: int, ef: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, row, distance) of up to k rows of each query, nearest first."""
        parts = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        exact = np.asarray(queries, np.float64)
        exact = unit(exact) if self.space == "cosine" and len(exact) else exact
        for at in range(0, len(exact) if self.entry >= 0 else 0, _TILE):
            q, row = self._beam(exact[at : at + _TILE].astype(np.float32), max(ef, k))
            x = self.raw[row].astype(np.float64)
            d = self._far(exact[at + q], unit(x) if self.space == "cosine" else x)
            order = np.lexsort((row, d, q))
            q, row, d = q[order], row[order], d[order]
            some = np.arange(len(q)) - np.searchsorted(q, q) < k
            parts.append((q[some] + at, row[some], d[some]))
        return tuple(np.concatenate(z) for z in zip(*parts))

    def _beam(self, q: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
        n, every = len(self.rows), np.arange(len(q))
        at = np.full(len(q), self.entry)
        far = self._far(q, self.rows[at])
        for level in range(len(self.links) - 1, 0, -1):
            place = np.full(n, -1, np.int64)
            place[self.nodes[level]] = np.arange(len(self.nodes[level]))
            moving = every
            while len(moving):
                near = self.links[level][place[at[moving]]]
                d = np.where(near >= 0, self._far(q[moving, None, :], self.rows[np.maximum(near, 0)]), np.inf)
                j = d.argmin(1)
                d, near = d[np.arange(len(j)), j], near[np.arange(len(j)), j]
                better = d < far[moving]
                moving = moving[better]
                at[moving], far[moving] = near[better], d[better]
        ef = min(ef, n)
        ids, dist, done = np.full((len(q), ef), -1, np.int64), np.full((len(q), ef), np.inf, np.float32), np.ones((len(q), ef), bool)
        ids[:, 0], dist[:, 0], done[:, 0] = at, far, False
        seen = np.zeros((len(q), n), bool)
        seen[every, at] = True
        active = every
        while True:
            wait = np.where(done[active], np.inf, dist[active])
            some = np.isfinite(wait).any(1)
            active, wait = active[some], wait[some]
            if not len(active):
                break
            c = min(_AT_ONCE, ef)
            j = np.argpartition(wait, c - 1, axis=1)[:, :c]
            real = np.isfinite(np.take_along_axis(wait, j, axis=1))
            done[active[:, None], j] |= real
            near = np.where(real[:, :, None], self.links[0][np.maximum(ids[active[:, None], j], 0)], -1).reshape(len(active), -1)
            row = np.broadcast_to(active[:, None], near.shape)
            new = (near >= 0) & ~seen[row, np.maximum(near, 0)]
            # A row found twice at once counts once.
            order = np.argsort(near, axis=1, kind="stable")
            again = np.zeros(near.shape, bool)
            by = np.take_along_axis(near, order, axis=1)
            np.put_along_axis(again, order[:, 1:], by[:, 1:] == by[:, :-1], axis=1)
            new &= ~again
            seen[row[new], near[new]] = True
            d = np.full(near.shape, np.inf, np.float32)
            r = np.nonzero(new)[0]
            d[new] = self._far(q[active[r]], self.rows[near[new]])
            all_d = np.concatenate([dist[active], d], axis=1)
            all_i = np.concatenate([ids[active], near], axis=1)
            all_done = np.concatenate([done[active], ~new], axis=1)
            keep = np.argpartition(all_d, ef - 1, axis=1)[:, :ef]
            ids[active], dist[active], done[active] = (np.take_along_axis(z, keep, axis=1) for z in (all_i, all_d, all_done))
        x, y = np.nonzero(np.isfinite(dist))
        return x, ids[x, y]


def build(collection: DataFrame, dimension: int, max_elements: int = 10_000, M: int = 16, ef_construction: int = 200, space: str = "cosine", id_col: str = "id", vector_col: str = "vector") -> DataFrame:
    """``shard, part, ids, graph``: one row a graph, none of more than ``max_elements`` rows."""
    if dimension <= 0 or max_elements <= 0:
        raise ValueError("dimension and max_elements must be positive")
    if space not in SPACES:
        raise ValueError(f"space must be one of {', '.join(SPACES)}")
    shards = max(1, -(-collection.count() * 10 // (max_elements * 9)))
    rows = collection.where(F.col(vector_col).isNotNull()).select(F.col(id_col).alias("n"), V.floats(F.col(vector_col)).alias("v"), F.pmod(F.xxhash64(F.col(id_col)), F.lit(shards)).cast("int").alias("shard"))

    def make(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by("n")
        n = table.column("n").combine_chunks()
        if len(n.unique()) < len(n):
            raise ValueError("id already exists")
        ids, graphs = [], []
        for at in range(0, table.num_rows, max_elements):
            v = matrix(table.column("v").slice(at, max_elements), dimension)
            ids.append(n.slice(at, max_elements))
            graphs.append(packed(Graph(v, M, ef_construction, space)))
        offsets = pa.array(np.cumsum([0, *map(len, ids)]).astype(np.int32))
        return pa.table({"shard": pa.array([table.column("shard")[0].as_py()] * len(ids), pa.int32()), "part": pa.array(range(len(ids)), pa.int32()), "ids": pa.ListArray.from_arrays(offsets, n), "graph": pa.array(graphs, pa.binary())})

    return rows.groupBy("shard").applyInArrow(make, f"shard int, part int, ids array<{rows.schema['n'].dataType.simpleString()}>, graph binary")


def packed(graph: Graph) -> bytes:
    """The graph's arrays; read back without executing anything."""
    out = io.BytesIO()
    arrays = {f"{kind}{i}": x for kind, held in (("nodes", graph.nodes), ("links", graph.links)) for i, x in enumerate(held)}
    np.savez(out, space=np.array(SPACES.index(graph.space)), m=np.array(graph.M), entry=np.array(graph.entry), raw=graph.raw, levels=np.array(len(graph.links)), **arrays)
    return out.getvalue()


def unpacked(blob: bytes) -> Graph:
    with np.load(io.BytesIO(blob), allow_pickle=False) as z:
        graph = Graph.__new__(Graph)
        graph.space, graph.M, graph.entry = SPACES[int(z["space"])], int(z["m"]), int(z["entry"])
        graph._hold(z["raw"])
        graph.nodes, graph.links = ([z[f"{kind}{i}"] for i in range(int(z["levels"]))] for kind in ("nodes", "links"))
    return graph


def _answers(ids: pa.Array, blob: bytes, names: pa.Array, queries: np.ndarray, k: int, ef: int) -> tuple[pa.Array, pa.Array, pa.Array]:
    graph = unpacked(blob)
    if len(queries) and len(graph.raw) and queries.shape[1] != graph.raw.shape[1]:
        raise ValueError(f"queries must have {graph.raw.shape[1]} components")
    q, row, far = graph.search(queries, k, ef)
    return names.take(pa.array(q)), ids.take(pa.array(row)), pa.array(1 - far)


def search_batch(index: DataFrame, queries: DataFrame, k: int = 5, ef_search: int = 50, query_col: str = "query_id", query_vector: str = "vector", id_col: str = "id") -> DataFrame:
    """``query_id, rank, id, score``.

    Graphs stay where they are and up to ``BROADCAST_COMPONENTS`` query
    components are broadcast; more queries meet the graphs in blocks.
    """
    check_k(k)
    asked = queries.where(F.col(query_vector).isNotNull()).select(F.col(query_col).alias("q"), V.floats(F.col(query_vector)).alias("v"))
    width = (asked.select(F.max(F.size("v"))).first()[0] or 1) or 1
    some = asked.limit(BROADCAST_COMPONENTS // width + 1).toArrow().combine_chunks()
    kinds = asked.schema["q"].dataType.simpleString(), index.schema["ids"].dataType.elementType.simpleString()
    schema, names = f"q {kinds[0]}, n {kinds[1]}, s double", ["q", "n", "s"]
    if some.num_rows * width <= BROADCAST_COMPONENTS:
        own = pa.concat_arrays(some.column("q").chunks) if some.num_rows else some.schema.field("q").type
        shared = index.sparkSession.sparkContext.broadcast((own, matrix(some.column("v"), width)))

        def run(batches):
            q, v = shared.value
            for batch in batches:
                for i in range(batch.num_rows if len(v) else 0):
                    yield pa.RecordBatch.from_arrays([*_answers(batch.column("ids")[i].values, batch.column("graph")[i].as_py(), q, v, k, ef_search)], names=names)

        near = index.select("ids", "graph").mapInArrow(run, schema)
    else:
        blocks = -(-asked.count() * 10 // (QUERY_BLOCK * 9))
        nothing = lambda d: F.lit(None).cast(d.dataType)
        graphs = F.broadcast(index.select("shard", "part"))  # two numbers to ``max_elements`` rows
        block = F.pmod(F.xxhash64("q"), F.lit(blocks)).cast("int").alias("b")
        left = asked.join(graphs, F.lit(True)).select("q", "v", nothing(index.schema["ids"]).alias("ids"), nothing(index.schema["graph"]).alias("graph"), "shard", "part", block)
        right = index.select(nothing(asked.schema["q"]).alias("q"), nothing(asked.schema["v"]).alias("v"), "ids", "graph", "shard", "part", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"))

        def meet(table: pa.Table) -> pa.Table:
            table = table.combine_chunks()
            graph = table.filter(table.column("graph").is_valid())
            own = table.filter(table.column("v").is_valid())
            if not own.num_rows or not graph.num_rows:
                return pa.table({"q": pa.array([], table.schema.field("q").type), "n": pa.array([], table.schema.field("ids").type.value_type), "s": pa.array([], pa.float64())})
            found = _answers(graph.column("ids")[0].values, graph.column("graph")[0].as_py(), own.column("q").combine_chunks(), matrix(own.column("v"), width), k, ef_search)
            return pa.table(dict(zip(names, found)))

        near = left.unionByName(right).groupBy("shard", "part", "b").applyInArrow(meet, schema)
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("s"), "n"))
    return near.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select(F.col("q").alias(query_col), "rank", F.col("n").alias(id_col), F.round("s", PLACES).alias("score"))
