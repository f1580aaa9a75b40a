"""Evaluation: recall, latency percentiles, throughput, long-form metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def recall_at_k(exact: DataFrame, approx: DataFrame, k: int, query_col: str = "query_id", id_col: str = "id", fixed: bool = True) -> DataFrame:
    """One row, ``queries, recall``.

    ``fixed`` divides each query's hits by k; else by the smaller of k and the
    size of its exact answer, and a query without an exact answer counts 1.
    Queries are those of either table. No queries give 0.
    """
    truth = exact.where(F.col("rank") <= k).select(query_col, id_col, F.lit(1).alias("_t"))
    guess = approx.where(F.col("rank") <= k).select(query_col, id_col, F.lit(1).alias("_g"))
    both = truth.join(guess, [query_col, id_col], "full_outer")
    each = both.groupBy(query_col).agg(F.count("_t").alias("t"), F.sum(F.when(F.col("_t").isNotNull() & F.col("_g").isNotNull(), 1).otherwise(0)).alias("hit"))
    share = F.col("hit") / F.lit(k) if fixed else F.when(F.col("t") == 0, 1.0).otherwise(F.col("hit") / F.least(F.col("t"), F.lit(k)))
    return each.agg(F.count(F.lit(1)).alias("queries"), F.round(F.coalesce(F.avg(share), F.lit(0.0)), 6).alias("recall"))


def latency_percentiles(samples: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """P50, P95, P99 by linear interpolation, mean, and requests a second at that mean (values in ms)."""
    aggregates = [F.percentile(value, p).alias(n) for n, p in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99))]
    out = samples.groupBy(*(by or [])).agg(F.count(value).alias("n"), *aggregates, F.avg(value).alias("mean"))
    rounded = [F.round(c, 6).alias(c) for c in ("p50", "p95", "p99", "mean")]
    return out.select(*(by or []), "n", *rounded, F.when(F.col("mean") > 0, F.round(1000 / F.col("mean"), 6)).alias("qps"))


def long_metrics(wide: DataFrame, name: str, unit: str = "") -> DataFrame:
    """``benchmark_name, metric_name, value, unit`` from one column a metric."""
    metrics = [c for c in wide.columns if c != name]
    text = wide.select(F.col(name).cast("string").alias("benchmark_name"), *[F.col(c).cast("double").cast("string").alias(c) for c in metrics])
    return text.unpivot(["benchmark_name"], metrics, "metric_name", "value").withColumn("unit", F.lit(unit))


def rate_by_window(events: DataFrame, ts: str, width: str = "1 minute", by: list[str] | None = None, value: str | None = None) -> DataFrame:
    """``window_start``, requests, and their mean value, by tumbling window; the same on a stream."""
    grouped = events.groupBy(F.window(ts, width), *(by or []))
    aggregates = [F.count(F.lit(1)).alias("requests")]
    if value:
        aggregates.append(F.avg(value).alias("mean_value"))
    return grouped.agg(*aggregates).select(F.col("window.start").alias("window_start"), *(by or []), "requests", *(["mean_value"] if value else []))


def hit_ratio(hits, misses):
    """Cache hit ratio with the guard the dashboards use against an empty window."""
    return hits / (hits + misses + F.lit(0.0001))
