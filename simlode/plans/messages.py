"""Queries p2 and p3 over the mutation log, with the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from simlode.operators.change_table import ChangeTable
from simlode.operators.redelivery import keep_first, later_copies, unseen
from simlode.session import table, work_path

COPY_KEYS = ("shard", "id", "timestamp")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the log that repeat an earlier line."""
    lines = table(spark, sf_dir, "active_wal").select("seq", *COPY_KEYS)
    return later_copies(lines, COPY_KEYS, ["seq"], required=["timestamp"]).select("seq")


def p2_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log with each line once, all columns."""
    lines = table(spark, sf_dir, "active_wal")
    return keep_first(lines, COPY_KEYS, ["seq"], required=["timestamp"]).select("seq", "batch_id", "shard", "op", "id", "timestamp")


def p2_unseen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the second half of the delivery batches, the lines the first half has not stored."""
    lines = table(spark, sf_dir, "active_wal").select("seq", "batch_id", *COPY_KEYS)
    half = lines.agg(F.max("batch_id").alias("last")).select((F.col("last") / 2).alias("half"))
    marked = lines.join(F.broadcast(half), F.lit(True))  # one row
    old, new = marked.where("batch_id <= half"), marked.where("batch_id > half")
    return unseen(new.drop("half"), old, COPY_KEYS, ["seq"], required=["timestamp"]).select("seq")


def log_changes(lines: DataFrame) -> DataFrame:
    """Log lines as changes of a :class:`ChangeTable`; other operations fall away."""
    kind = F.when(F.col("op") == "insert", "put").when(F.col("op") == "delete", "del").when(F.col("op") == "clear", "clear")
    return lines.select(F.col("shard").alias("grp"), F.col("id").alias("key"), kind.alias("kind"), F.col("timestamp").alias("ts"), "seq", "batch_id").where("kind IS NOT NULL")


def p3_found(spark: SparkSession, sf_dir: str, buckets: int | None = None) -> DataFrame:
    """Ids stored after the last change, with the line that gave their state.

    The log is applied as two deliveries, by batch number, so that the second
    merges with buckets the first has written.
    """
    lines = table(spark, sf_dir, "active_wal").select("seq", "batch_id", "shard", "op", "id", "timestamp")
    last = lines.agg(F.max("batch_id")).first()[0]
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    store = ChangeTable(spark, work_path(spark, "p3"), buckets)
    changes = log_changes(lines)
    if last is not None:
        split = last // 2
        store.apply(changes.where(F.col("batch_id") <= split))
        store.apply(changes.where((F.col("batch_id") > split) | F.col("batch_id").isNull()))
    return store.rows().select(F.col("key").alias("id"), "seq")


QUERIES = {"p2_found": p2_found, "p2_kept": p2_kept, "p2_unseen": p2_unseen, "p3_found": p3_found}

_RANKED = "SELECT *, row_number() OVER (PARTITION BY shard, id, timestamp ORDER BY seq) AS rn FROM active_wal"

SQL = {
    "p2_found": f"SELECT seq FROM ({_RANKED}) WHERE timestamp IS NOT NULL AND rn > 1",
    "p2_kept": f"SELECT seq, batch_id, shard, op, id, timestamp FROM ({_RANKED}) WHERE timestamp IS NULL OR rn = 1",
    "p2_unseen": """
        WITH h AS (SELECT max(batch_id) / 2.0 AS half FROM active_wal),
        old AS (SELECT DISTINCT shard, id, timestamp FROM active_wal, h WHERE batch_id <= half AND timestamp IS NOT NULL),
        new AS (SELECT *, row_number() OVER (PARTITION BY shard, id, timestamp ORDER BY seq) AS rn FROM active_wal, h WHERE batch_id > half)
        SELECT seq FROM new WHERE timestamp IS NULL OR (rn = 1 AND NOT EXISTS (
            SELECT 1 FROM old o WHERE o.shard IS NOT DISTINCT FROM new.shard AND o.id IS NOT DISTINCT FROM new.id AND o.timestamp = new.timestamp))
    """,
    "p3_found": """
        WITH l AS (SELECT shard, id, timestamp AS ts, op, seq,
                          row_number() OVER (PARTITION BY shard, id, timestamp ORDER BY seq) AS rn
                   FROM active_wal WHERE timestamp IS NOT NULL AND op IN ('insert', 'delete', 'clear')),
        k AS (SELECT * FROM l WHERE rn = 1),
        c AS (SELECT shard, max(ts) AS ts FROM k WHERE op = 'clear' GROUP BY shard),
        r AS (SELECT *, row_number() OVER (PARTITION BY shard, id ORDER BY ts DESC, seq) AS latest FROM k WHERE op <> 'clear')
        SELECT r.id, r.seq FROM r LEFT JOIN c ON c.shard IS NOT DISTINCT FROM r.shard
        WHERE latest = 1 AND op = 'insert' AND id IS NOT NULL AND (c.ts IS NULL OR r.ts > c.ts)
    """,
}
