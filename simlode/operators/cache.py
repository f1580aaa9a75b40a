"""A result cache as a table: answers keyed by vector and k, valid for a time, void once the data change."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simlode.functions.vector import cache_key

TTL_SECONDS = 60


def keyed(requests: DataFrame, vector_col: str = "vector", k_col: str = "top_k") -> DataFrame:
    """Requests with the key that equal ones share."""
    return requests.withColumn("cache_key", cache_key(F.col(vector_col), F.col(k_col)))


def split(requests: DataFrame, cache: DataFrame, now, version: int) -> tuple[DataFrame, DataFrame]:
    """(hits, misses) against ``cache_key, cached_at, version, result``.

    An entry counts for ``TTL_SECONDS`` and only for the data version it was
    computed on, so a write makes it void at once. Of several the latest counts.
    """
    fresh = cache.where((F.col("cached_at") + F.expr(f"INTERVAL {TTL_SECONDS} SECONDS") > now) & (F.col("version") == version))
    one = fresh.groupBy("cache_key").agg(F.max_by("result", "cached_at").alias("result"))
    rows = keyed(requests)
    return rows.join(one, "cache_key"), rows.join(one, "cache_key", "left_anti")


def distinct_requests(requests: DataFrame, vector_col: str = "vector", k_col: str = "top_k") -> DataFrame:
    """``cache_key, requests``: how often each distinct request was made."""
    return keyed(requests.where(F.col(vector_col).isNotNull() & F.col(k_col).isNotNull()), vector_col, k_col).groupBy("cache_key").agg(F.count(F.lit(1)).alias("requests"))
