"""The most similar vectors of a collection for every query vector.

Collision-counting hashing. Each of ``TABLES`` tables keeps the vectors sorted by a
key: the signed axis that is nearest to the vector under each of ``PARTS``
random rotations. A query opens a window of the ``PROBES`` keys nearest to
itself in every table, in order of what its own projections lose by them, which
is how virtual rehashing widens a window without building another table. A
vector collides once for each window it lies in; with ``THRESHOLD`` collisions
it is verified by its exact cosine.

Keys are of two projections, not one. A window over a single sorted projection
that keeps a cosine of 0.85 holds nearly half of all vectors in 64 dimensions,
so it leads to comparing all with all; a window over these keys holds
``PROBES`` / 16,384 of them, so ``TABLES`` windows hold 0.6 % (of clustered data
more, and those vectors are near). A vector at a cosine of exactly 0.85 is
missed with a probability of about 0.3 %, a nearer one less; :func:`recall`
measures it. ``exact=True`` compares all with all, in a grid of blocks.

Rows and queries meet by their key. What travels is a vector of one byte a
component with the length of its rounding error, so every comparison in a
window has a sure upper and lower bound: what cannot reach the floor or the
query's k best of the window ends there, and nothing else does. Keys that hold
many rows or queries, as a sample shows, are split into blocks of both, and each
block meets each; the sample decides on the layout only, never on a result.

Defined cases: null, wrongly sized, zero and non-finite vectors take no part on
either side; a query repeated under its id counts once (the smallest vector and
k in Spark's order, if they differ); k is ``default_k`` where null, and below 1
the query is refused; fewer than k vectors at the floor or above give as many
rows; equal cosines, rounded to six places, rank by the smaller record number;
null query ids are one query id, null record numbers take no part; empty tables
give an empty result; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from simlode.llm.vectors import binary, from_binary, packed, sound, unit

TABLES, PARTS, PROBES, THRESHOLD = 8, 2, 12, 1
FLOOR, DEFAULT_K, PLACES = 0.85, 5, 6
#: Rows and queries of one key that meet in one task; a key with more is split.
ROW_BLOCK, QUERY_BLOCK = 1 << 18, 1 << 15
#: Rows whose keys show which are to be split.
SAMPLE = 1 << 16
#: Query components (queries times dimension) that are broadcast for verification; more are joined.
BROADCAST_COMPONENTS = 1 << 21
#: Of the exact grid.
GRID_QUERIES, GRID_ROWS = 4096, 1 << 16
_ENTRIES, _PAIRS = 1 << 16, 1 << 17


@lru_cache(maxsize=2)
def rotations(dimension: int, seed: int = 7) -> np.ndarray:
    """``TABLES`` times ``PARTS`` random orthogonal matrices."""
    draw = np.random.default_rng(seed).standard_normal
    return np.stack([np.stack([np.linalg.qr(draw((dimension, dimension)))[0] for _ in range(PARTS)]) for _ in range(TABLES)]).astype(np.float32)


def keys(rows: np.ndarray) -> np.ndarray:
    """The key of each unit vector in each table."""
    d = rows.shape[1]
    x, out = rows.astype(np.float32), np.empty((len(rows), TABLES), np.int64)
    for t, parts in enumerate(rotations(d)):
        key = np.full(len(x), t, np.int64)
        for axes in parts:
            p = x @ axes
            i = np.abs(p).argmax(1)
            key = key * 2 * d + 2 * i + (p[np.arange(len(x)), i] < 0)
        out[:, t] = key
    return out


def windows(rows: np.ndarray) -> np.ndarray:
    """The keys in each query's window, by table: those that cost its projections least."""
    d = rows.shape[1]
    wide = min(d, 8)
    x, out = rows.astype(np.float32), []
    for t, parts in enumerate(rotations(d)):
        key, cost = np.full((len(x), 1), t, np.int64), np.zeros((len(x), 1))
        for axes in parts:
            p = x @ axes
            a = np.abs(p)
            i = np.argpartition(-a, wide - 1, axis=1)[:, :wide]
            a = np.take_along_axis(a, i, axis=1)
            own = 2 * i + (np.take_along_axis(p, i, axis=1) < 0)
            key = (key[:, :, None] * 2 * d + own[:, None, :]).reshape(len(x), -1)
            cost = (cost[:, :, None] + ((a.max(1, keepdims=True) - a) ** 2)[:, None, :]).reshape(len(x), -1)
            if key.shape[1] > PROBES:
                near = np.argpartition(cost, PROBES - 1, axis=1)[:, : max(PROBES, wide)] if len(x) else np.empty((0, PROBES), np.int64)
                key, cost = np.take_along_axis(key, near, axis=1), np.take_along_axis(cost, near, axis=1)
        out.append(key[:, :PROBES])
    return np.stack(out, axis=1)


def _packed(rows: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Unit vectors as bytes: one a component, then scale, length of the rounding error and k."""
    scale = np.abs(rows).max(1) / 127
    small = np.rint(rows / scale[:, None])
    scale = scale.astype(np.float32)
    lost = np.sqrt(((rows - small * scale[:, None].astype(np.float64)) ** 2).sum(1)) + 1e-6
    tail = np.zeros((len(rows), 3), np.float32)
    tail[:, 0], tail[:, 1] = scale, lost
    tail[:, 2] = np.minimum(k, 2**31 - 1).astype(np.int32).view(np.float32)
    return np.concatenate([small.astype(np.int8).view(np.uint8), tail.view(np.uint8)], axis=1)


class Layout:
    """Into how many blocks of rows and of queries each key is split."""

    def __init__(self, hot: dict[int, tuple[int, int]], rest: tuple[int, int] = (1, 1)):
        self.keys = np.array(sorted(hot), np.int64)
        self.split = np.array([hot[k] for k in sorted(hot)] or np.empty((0, 2)), np.int64).reshape(-1, 2)
        self.rest = np.array(rest, np.int64)
        self.wide = max([*self.split.max(1, initial=1).tolist(), *rest])

    def blocks(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        out = np.tile(self.rest, (len(key), 1))
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[at] == key
            out[hit] = self.split[at[hit]]
        return out[:, 0], out[:, 1]

    def places(self, key: np.ndarray, salt: np.ndarray, asks: bool) -> tuple[np.ndarray, np.ndarray]:
        """Which entry, and the block it goes to: a row to its own block of rows with every block of queries, a query the other way round."""
        own, other = self.blocks(key)[:: -1 if asks else 1]
        mine = salt % own
        entry = np.repeat(np.arange(len(key)), other)
        each = np.arange(len(entry)) - np.repeat(np.cumsum(other) - other, other)
        r, q = (each, mine[entry]) if asks else (mine[entry], each)
        return entry, (key[entry] * self.wide + r) * self.wide + q


def _entries(rows: DataFrame, dimension: int, asks: bool, layout) -> DataFrame:
    """``w, n, code``: of ``n, v`` (and ``k``) one entry a key; ``w`` is the block, then whether it is a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                v = unit(from_binary(batch.column("v"), dimension, np.float32))
                n = batch.column("n").to_numpy(zero_copy_only=False)
                code = _packed(v, batch.column("k").to_numpy(zero_copy_only=False))
                key = (windows(v) if asks else keys(v)).reshape(len(v), -1)
                row = np.repeat(np.arange(len(v)), key.shape[1])
                entry, place = layout.value.places(key.ravel(), (n[row] * 0x9E3779B1 >> 7) & 0xFFFFFF, asks)
                row = row[entry]
                yield pa.RecordBatch.from_arrays([pa.array(place * 2 + (not asks)), pa.array(n[row]), binary(code[row])], names=["w", "n", "code"])

    return rows.mapInArrow(run, "w long, n long, code binary")


def _layout(rows: DataFrame, queries: DataFrame, dimension: int, row_block: int, query_block: int) -> Layout:
    """From the keys of a sample of each side; without a job where one block holds all."""
    sides = []
    for side, block, of in ((rows, row_block, keys), (queries, query_block, windows)):
        total = side.count()
        if total <= block:
            sides.append(({}, 1))
            continue

        def run(batches: Iterator[pa.RecordBatch], of=of) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([pa.array(of(unit(from_binary(batch.column("v"), dimension, np.float32))).ravel())], names=["key"])

        share = min(1.0, SAMPLE / total)
        some = side.where(F.pmod(F.xxhash64(F.col("n"), F.lit(1)), F.lit(1 << 30)) < int(share * (1 << 30)) + 1).select("v")
        count = some.mapInArrow(run, "key long").groupBy("key").count().where(F.col("count") >= 8).collect()  # an eighth of the sample's keys at most
        sides.append(({r["key"]: -(-int(r["count"] / share) // block) for r in count}, max(1, -(-int(8 / share) // block))))
    (a, a_rest), (b, b_rest) = sides
    hot = {k: (a.get(k, a_rest), b.get(k, b_rest)) for k in a.keys() | b.keys()}
    return Layout({k: s for k, s in hot.items() if s != (a_rest, b_rest)}, (a_rest, b_rest))


def _meet(w: np.ndarray, n: np.ndarray, code: np.ndarray, dimension: int, floor: float) -> tuple[np.ndarray, np.ndarray]:
    """Of entries sorted by ``w``: (query, row) that may be among a query's k best of its block at the floor or above."""
    q, r = np.flatnonzero(w % 2 == 0), np.flatnonzero(w % 2)
    none = np.empty(0, np.int64)
    if not len(q) or not len(r):
        return none, none
    tail = np.ascontiguousarray(code[:, dimension:]).view(np.float32)
    k = tail[q, 2].copy().view(np.int32).astype(np.int64)
    # Equal vectors are compared once; equal bytes, scale and error mean equal vectors.
    _, same = np.unique(np.ascontiguousarray(code[r, : dimension + 8]).view(np.dtype((np.void, dimension + 8)))[:, 0], return_inverse=True)
    order = np.lexsort((n[r], same, w[r]))
    r, same = r[order], same[order]
    first = np.flatnonzero((np.diff(w[r], prepend=-1) != 0) | (np.diff(same, prepend=-1) != 0))
    size, rep = np.diff(np.append(first, len(r))), r[first]
    x = np.ascontiguousarray(code[:, :dimension]).view(np.int8).astype(np.float32) * tail[:, :1]
    lost = tail[:, 1].astype(np.float64)
    edge = floor - float(lost[q].max() + 1.01 * lost[rep].max()) - 1e-5  # single precision included

    # Queries of a block lie together, its rows too.
    start = np.flatnonzero(np.diff(w[q], prepend=-1) != 0)
    stop = np.append(start[1:], len(q))
    lo, hi = np.searchsorted(w[rep], w[q[start]] + 1), np.searchsorted(w[rep], w[q[start]] + 1, side="right")
    work = (stop - start) * (hi - lo)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def keep(a: np.ndarray, b: np.ndarray, cos: np.ndarray) -> None:
        near = cos >= edge
        a, b, cos = a[near], b[near], cos[near].astype(np.float64)
        slack = lost[q[a]] + 1.01 * lost[rep[b]] + 1e-6
        fine = cos + slack >= floor
        out.append((a[fine], b[fine], cos[fine]))

    for g in np.flatnonzero(work >= 4096):
        for a in range(start[g], stop[g], 256):
            for b in range(lo[g], hi[g], 8192):
                i, j = np.arange(a, min(a + 256, stop[g])), np.arange(b, min(b + 8192, hi[g]))
                cos = x[q[i]] @ x[rep[j]].T
                y, z = np.nonzero(cos >= edge)
                keep(i[y], j[z], cos[y, z])
    little = np.flatnonzero((work > 0) & (work < 4096))
    own = np.repeat(little, (stop - start)[little])  # the block of each of its queries
    at = start[own] + np.arange(len(own)) - np.repeat(np.cumsum((stop - start)[little]) - (stop - start)[little], (stop - start)[little])
    many = (hi - lo)[own]
    edges = np.cumsum(many)
    for c in range(0, int(edges[-1]) if len(edges) else 0, _PAIRS):
        p = np.arange(c, min(c + _PAIRS, int(edges[-1])))
        e = np.searchsorted(edges, p, side="right")
        a, b = at[e], lo[own[e]] + p - (edges[e] - many[e])
        keep(a, b, np.einsum("ij,ij->i", x[q[a]], x[rep[b]]))
    if not out:
        return none, none
    a, b, cos = (np.concatenate(z) for z in zip(*out))
    slack = lost[q[a]] + 1.01 * lost[rep[b]] + 1e-6
    # What is surely below k others of the block goes no further.
    order = np.lexsort((slack - cos, a))
    a, b, cos, slack = a[order], b[order], cos[order], slack[order]
    begin = np.searchsorted(a, a, side="left")
    last = begin + k[a] - 1
    has = (last < len(a)) & (a[np.minimum(last, len(a) - 1)] == a)
    kth = np.where(has, (cos - slack)[np.minimum(last, len(a) - 1)], -np.inf)
    good = cos + slack >= kth - 1e-6
    a, b = a[good], b[good]
    # Of equal vectors the k smallest record numbers.
    m = np.minimum(size[b], k[a])
    which = np.repeat(first[b] - (np.cumsum(m) - m), m) + np.arange(int(m.sum()))
    return n[q[np.repeat(a, m)]], n[r[which]]


def _collisions(entries: DataFrame, dimension: int, floor: float) -> DataFrame:
    """``i, n``: once for each window of query ``i`` that row ``n`` collided in and might be near."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        fresh = 0

        def flush() -> pa.RecordBatch:
            w, n, code = (np.concatenate(z) for z in zip(*held))
            i, found = _meet(w, n, code, dimension, floor)
            # The last block may go on: its queries came first and stay.
            stay = (w // 2 == w[-1] // 2) & (w % 2 == 0)
            held[:] = [(w[stay], n[stay], code[stay])]
            return pa.RecordBatch.from_arrays([pa.array(i), pa.array(found)], names=["i", "n"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append((batch.column("w").to_numpy(), batch.column("n").to_numpy(), from_binary(batch.column("code"), dimension + 12, np.uint8)))
            fresh += batch.num_rows
            if fresh >= _ENTRIES:
                yield flush()
                fresh = 0
        if fresh:
            yield flush()

    return entries.mapInArrow(run, "i long, n long")


def asked(requests: DataFrame, query: str, vector: str, top_k: str, dimension: int, default_k: int = DEFAULT_K) -> DataFrame:
    """``q, k, v``: the requests to answer, each id once."""
    k = F.coalesce(F.col(f"`{top_k}`").cast("long"), F.lit(default_k).cast("long"))
    rows = requests.select(F.col(f"`{query}`").cast("string").alias("q"), k.alias("k"), F.col(f"`{vector}`").cast("array<float>").alias("v")).where("k >= 1")
    return sound(rows, F.col("v"), dimension).groupBy("q").agg(F.min(F.struct("v", "k")).alias("x")).select("q", "x.k", "x.v")


def _best(q: np.ndarray, k: np.ndarray, n: np.ndarray, cos: np.ndarray) -> np.ndarray:
    """Positions of each query's k best."""
    order = np.lexsort((n, -cos, q))
    q = q[order]
    return order[np.arange(len(q)) - np.searchsorted(q, q) < k[order]]


def _verified(pairs: DataFrame, queries: DataFrame, dimension: int, floor: float) -> DataFrame:
    """``q, k, n, cosine`` of ``i, n, u`` at the floor or above: exact, and of each batch a query's k best.

    Up to ``BROADCAST_COMPONENTS`` query components are broadcast, more are joined.
    """
    asked = queries.withColumn("i", F.xxhash64("q"))
    limit = max(1, BROADCAST_COMPONENTS // dimension)
    some = asked.limit(limit + 1).toArrow().combine_chunks().sort_by("i")
    held = some.num_rows <= limit
    shared = pairs.sparkSession.sparkContext.broadcast(some if held else None)

    def cosines(u: pa.Array, v: np.ndarray, q: pa.Array, k: np.ndarray, n: np.ndarray, group: np.ndarray) -> pa.RecordBatch:
        cos = (unit(from_binary(u, dimension, np.float32)) * v).sum(1)
        at = np.flatnonzero(cos >= floor)
        cos = np.round(cos, PLACES)
        at = at[_best(group[at], k[at], n[at], cos[at])]
        return pa.RecordBatch.from_arrays([q.take(pa.array(at)), pa.array(k[at]), pa.array(n[at]), pa.array(cos[at])], names=["q", "k", "n", "cosine"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if held:
            own = shared.value
            i, v, ks = own.column("i").to_numpy(), unit(from_binary(own.column("v"), dimension, np.float32)), own.column("k").to_numpy()
            names = pa.concat_arrays(own.column("q").chunks) if own.num_rows else pa.array([], pa.string())
        for batch in batches:
            group, n = batch.column("i").to_numpy(), batch.column("n").to_numpy()
            if held:
                at = np.searchsorted(i, group)
                yield cosines(batch.column("u"), v[at], names.take(pa.array(at)), ks[at], n, group)
            else:
                yield cosines(batch.column("u"), unit(from_binary(batch.column("v"), dimension, np.float32)), batch.column("q"), batch.column("k").to_numpy(), n, group)

    wanted = pairs.select("i", "n", "u") if held else pairs.join(asked, "i").select("i", "n", "u", "q", "k", "v")
    return wanted.mapInArrow(run, "q string, k long, n long, cosine double")


def _all_pairs(rows: DataFrame, queries: DataFrame, dimension: int, floor: float) -> DataFrame:
    """The same by comparing every query with every row, in a grid of blocks of bounded size."""
    qb, rb = (max(1, -(-d.count() * 10 // (9 * size))) for d, size in ((queries, GRID_QUERIES), (rows, GRID_ROWS)))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    nothing = lambda kind: F.lit(None).cast(kind)
    left = queries.select(F.lit(True).alias("asks"), "q", "k", nothing("long").alias("n"), "v", block("q", qb).alias("a"), every(rb).alias("b"))
    right = rows.select(F.lit(False).alias("asks"), nothing("string").alias("q"), nothing("long").alias("k"), "n", "v", block("n", rb).alias("b"), every(qb).alias("a")).select(left.columns)

    def run(table: pa.Table) -> pa.Table:
        asks = table.column("asks").to_numpy()
        own, others = np.flatnonzero(asks), np.flatnonzero(~asks)
        v = unit(from_binary(table.column("v"), dimension, np.float32))
        n, k = table.column("n").take(pa.array(others)).to_numpy(), table.column("k").take(pa.array(own)).to_numpy()
        parts = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        for at in range(0, len(own), 128):
            a, b = np.nonzero(v[own[at : at + 128]] @ v[others].T >= floor - 1e-9)
            a = a + at
            cos = (v[own[a]] * v[others[b]]).sum(1)
            a, b, cos = a[cos >= floor], b[cos >= floor], np.round(cos[cos >= floor], PLACES)
            some = _best(a, k[a], n[b], cos)
            parts.append((a[some], n[b[some]], cos[some]))
        a, found, cos = (np.concatenate(z) for z in zip(*parts))
        return pa.table({"q": table.column("q").take(pa.array(own[a])), "k": pa.array(k[a].astype(np.int64)), "n": pa.array(found), "cosine": pa.array(cos)})

    return left.unionByName(right).repartition(max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), qb * rb), "a", "b").groupBy("a", "b").applyInArrow(run, "q string, k long, n long, cosine double")


def most_similar(
    collection: DataFrame, requests: DataFrame, number: str = "request_no", vector: str = "vector", query: str = "query_id", top_k: str = "top_k",
    dimension: int = 64, floor: float = FLOOR, exact: bool = False, row_block: int = ROW_BLOCK, query_block: int = QUERY_BLOCK,
) -> DataFrame:
    """``query, number, cosine, place``: up to k rows of the collection for each request."""
    spark = collection.sparkSession
    queries = packed(asked(requests, query, vector, top_k, dimension), dimension)
    rows = packed(collection.select(F.col(f"`{number}`").cast("long").alias("n"), F.col(f"`{vector}`").cast("array<float>").alias("v")).where("n IS NOT NULL"), dimension)
    if exact:
        near = _all_pairs(rows, queries, dimension, floor)
    else:
        # A query travels under the 64-bit hash of its id.
        asking = queries.select(F.xxhash64("q").alias("n"), "k", "v")
        layout = spark.sparkContext.broadcast(_layout(rows, asking, dimension, row_block, query_block))
        entries = _entries(rows.select("n", F.lit(0).alias("k"), "v"), dimension, False, layout).unionByName(_entries(asking, dimension, True, layout))
        # Entries of 90 bytes; the counts of the tables (of Parquet: from the footers) bound them.
        much = (collection.count() * TABLES + requests.count() * TABLES * PROBES) * 90
        tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-much // (64 << 20)))
        met = entries.repartition(tasks, F.shiftright("w", 1)).sortWithinPartitions("w")
        counted = _collisions(met, dimension, floor).groupBy("i", "n").agg(F.count(F.lit(1)).alias("collisions")).where(F.col("collisions") >= THRESHOLD)
        near = _verified(counted.join(rows.withColumnRenamed("v", "u"), "n"), queries, dimension, floor)
    order = Window.partitionBy("q").orderBy(F.desc("cosine"), "n")
    ranked = near.withColumn("place", F.row_number().over(order)).where("place <= k")
    return ranked.select(F.col("q").alias(query), F.col("n").alias(number), "cosine", "place")


def recall(found: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    """One row: true pairs, those found among them, and their share."""
    hit = truth.select(*keys).join(found.select(*keys).withColumn("hit", F.lit(1)), keys, "left")
    return hit.agg(F.count(F.lit(1)).alias("pairs"), F.count("hit").alias("found")).withColumn("recall", F.when(F.col("pairs") > 0, F.col("found") / F.col("pairs")).otherwise(1.0))
