"""Heartbeat tables: who is alive, and which replicas stand behind which primary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def active_workers(beats: DataFrame, now: float | None = None, worker: str = "worker_id") -> DataFrame:
    """Each worker's last beat, if it is no older than its time to live at ``now``.

    ``now`` is the last beat of all if not given. Of beats at one time the
    greatest row by (ttl, role, host, port) counts. Null workers and times are
    ignored. One row a worker and task travels, however often one beats.
    """
    sound = beats.where(F.col(worker).isNotNull() & F.col("last_seen").isNotNull())
    row = F.struct("last_seen", "ttl", "role", "host", "port", "primary_addr")
    last = sound.groupBy(worker).agg(F.max(row).alias("r")).select(worker, "r.*")
    if now is None:
        moment = sound.agg(F.max("last_seen").alias("_now"))
        last = last.join(F.broadcast(moment), F.lit(True))  # one row
    else:
        last = last.withColumn("_now", F.lit(float(now)))
    return last.where(F.col("_now") - F.col("last_seen") <= F.col("ttl")).drop("_now")


def replicas_of(workers: DataFrame) -> DataFrame:
    """``primary_addr, replicas``: how many live replicas, and their addresses in order, each primary has."""
    address = F.concat_ws(":", "host", F.col("port").cast("string"))
    replicas = workers.where("role = 'replica' AND primary_addr <> ''").select("primary_addr", address.alias("a")).distinct()
    return replicas.groupBy("primary_addr").agg(F.count(F.lit(1)).alias("replicas"), F.concat_ws(",", F.array_sort(F.collect_list("a"))).alias("addresses"))
