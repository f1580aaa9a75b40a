"""Made-up collections and request streams for benchmarks.

Vectors come from Spark's own generators, seeded by row, so any number of them
is made in parallel and the same seed gives the same rows whatever the layout.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from simlode.functions.vector import normalized


def _gaussian(row: Column, at: Column, seed: int) -> Column:
    """A standard normal number of a row and a position (Box and Muller's transform of two hashes)."""
    part = lambda k: (F.pmod(F.xxhash64(row, at, F.lit(seed), F.lit(k)), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    return F.sqrt(-2 * F.log(part(1))) * F.cos(2 * 3.141592653589793 * part(2))


def vectors(spark: SparkSession, rows: int, dimension: int, seed: int = 42, unit: bool = True, prefix: str = "vec_", partitions: int | None = None) -> DataFrame:
    """``id, vector, metadata`` of Gaussian vectors, of length one if ``unit``."""
    if rows < 0 or dimension <= 0:
        raise ValueError("rows must not be negative and dimension must be positive")
    base = spark.range(0, rows, 1, partitions) if partitions else spark.range(rows)
    v = F.transform(F.sequence(F.lit(1), F.lit(dimension)), lambda i: _gaussian(F.col("id"), i, seed))
    made = base.select("id", v.alias("v"))
    metadata = F.to_json(F.struct(F.col("id").alias("index"), F.pmod("id", F.lit(10)).alias("category")))
    return made.select(F.concat(F.lit(prefix), F.col("id").cast("string")).alias("id"), (normalized(F.col("v")) if unit else F.col("v")).cast("array<float>").alias("vector"), metadata.alias("metadata"))


def requests(spark: SparkSession, rows: int, dimension: int, seed: int = 43, top_k: int = 5) -> DataFrame:
    """``query_id, vector, top_k`` in the form of the search requests."""
    made = vectors(spark, rows, dimension, seed, prefix="q")
    return made.select(F.col("id").alias("query_id"), "vector", F.lit(top_k).alias("top_k"))


def load(spark: SparkSession, per_second: int, dimension: int, writes: float = 0.2, seed: int = 44) -> DataFrame:
    """An endless stream of requests: ``at, kind (insert or search), id, vector``, of which the share ``writes`` inserts."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", per_second).load()
    v = F.transform(F.sequence(F.lit(1), F.lit(dimension)), lambda i: _gaussian(F.col("value"), i, seed).cast("float"))
    kind = F.when(F.pmod(F.xxhash64("value", F.lit(seed)), F.lit(10_000)) < int(writes * 10_000), "insert").otherwise("search")
    return ticks.select(F.col("timestamp").alias("at"), kind.alias("kind"), F.concat(F.lit("load_"), F.col("value").cast("string")).alias("id"), v.alias("vector"))
