"""Consistent hashing of keys to nodes, and the modulo sharder it is compared with.

A node owns ``replicas`` points, SHA-256 of ``node#vnode_i``. A key belongs to
the first point strictly above its own hash, the smallest point if there is none.

The points are few and known on the driver (checked against ``MAX_POINTS``).
They are cut into intervals by the leading hex digits, so a key finds its
interval through an equi-join on those digits and a comparison, in generated
code, instead of walking the ring.

Defined cases: replicas below 1 raise; an empty ring gives every key a null
node; a null key gets a null node; adding a node twice changes nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from simlode.functions.vector import key_hash, modulo_shard

MAX_POINTS = 1 << 20
DIGITS = 3


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8")).hexdigest()


class HashRing:
    def __init__(self, nodes: Iterable[str] = (), replicas: int = 100):
        if replicas <= 0:
            raise ValueError("replicas must be positive")
        self.replicas = replicas
        self.nodes: list[str] = []
        for n in nodes:
            self.add_node(n)

    def add_node(self, node: str) -> None:
        if node not in self.nodes:
            if (len(self.nodes) + 1) * self.replicas > MAX_POINTS:
                raise ValueError("too many points on the ring")
            self.nodes.append(node)

    def remove_node(self, node: str) -> None:
        if node in self.nodes:
            self.nodes.remove(node)

    def points(self) -> list[tuple[str, str]]:
        """(hash, node) in order of the hash."""
        return sorted((_sha(f"{n}#vnode_{i}"), n) for n in self.nodes for i in range(self.replicas))

    def get_node(self, key: str) -> str | None:
        points = self.points()
        h = _sha(key)
        return next((n for p, n in points if p > h), points[0][1] if points else None)

    def table(self, spark: SparkSession) -> DataFrame:
        """``vnode_hash, node``."""
        return spark.createDataFrame(self.points(), "vnode_hash string, node string")

    def intervals(self, spark: SparkSession) -> DataFrame:
        """``lead, lo, hi, node``: keys with ``lo <= hash < hi`` and these leading digits."""
        points = self.points()
        edges = [("", points[0][0], points[0][1])] if points else []
        edges += [(a[0], b[0], b[1]) for a, b in zip(points, points[1:])]
        edges += [(points[-1][0], "g", points[0][1])] if points else []
        rows = [(f"{d:0{DIGITS}x}", lo, hi, n) for lo, hi, n in edges for d in range(int((lo or "0")[:DIGITS].ljust(DIGITS, "0"), 16), (int(hi[:DIGITS], 16) if hi != "g" else 16**DIGITS - 1) + 1)]
        return spark.createDataFrame(rows, "lead string, lo string, hi string, node string")

    def assign(self, keys: DataFrame, key: str, node: str = "node") -> DataFrame:
        """The rows with the node each key belongs to."""
        if not self.nodes:
            return keys.withColumn(node, F.lit(None).cast("string"))
        rest = [F.col(f"row.`{c}`") for c in keys.columns if c != node]
        hashed = keys.select(F.struct(*[F.col(f"`{c}`") for c in keys.columns]).alias("row"), key_hash(F.col(f"`{key}`")).alias("hash"))
        # At most MAX_POINTS + 16**DIGITS rows.
        ring = F.broadcast(self.intervals(keys.sparkSession))
        on = (F.substring("hash", 1, DIGITS) == F.col("lead")) & (F.col("hash") >= F.col("lo")) & (F.col("hash") < F.col("hi"))
        return hashed.join(ring, on, "left").select(*rest, F.col("node").alias(node))


def distribution(assigned: DataFrame, node: str = "node") -> DataFrame:
    """``node, keys, share_pct``."""
    counts = assigned.groupBy(node).agg(F.count(F.lit(1)).alias("keys"))
    total = counts.agg(F.sum("keys").alias("_all"))
    return counts.join(F.broadcast(total), F.lit(True)).select(node, "keys", F.round(100 * F.col("keys") / F.col("_all"), 4).alias("share_pct"))


def movement(before: DataFrame, after: DataFrame, key: str, node: str = "node") -> DataFrame:
    """One row: keys, those whose node changed, and their percentage."""
    a, b = before.select(key, F.col(node).alias("a")), after.select(key, F.col(node).alias("b"))
    joined = a.join(b, key)
    return moved(joined, F.col("a"), F.col("b"))


def moved(rows: DataFrame, before: Column, after: Column) -> DataFrame:
    """The same where both nodes stand in one row, which needs no join."""
    changed = F.sum(F.when(before.eqNullSafe(after), 0).otherwise(1)).cast("bigint")
    return rows.agg(F.count(F.lit(1)).alias("keys"), F.coalesce(changed, F.lit(0).cast("bigint")).alias("moved")).withColumn("moved_pct", F.when(F.col("keys") > 0, F.round(100 * F.col("moved") / F.col("keys"), 4)).otherwise(0.0))


__all__ = ["HashRing", "distribution", "modulo_shard", "moved", "movement"]
