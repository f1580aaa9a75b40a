"""Continuous ingest of mutations, and windowed metrics over event streams.

A stream of log lines is applied by ``foreachBatch`` to a bucketed
:class:`~simlode.operators.change_table.ChangeTable`. Order comes from ``seq``,
not from arrival, and the table keeps the order of each key's last change, so a
batch that is delivered again changes nothing and late lines find their place.

Vectors are validated as in replay: an insert without a vector or with one of
another dimension than the collection's stores nothing and ends what was stored
under its id. The dimension is given, or that of the first well-formed insert
by ``seq`` of the first batch that has one; it is written beside the table once
and holds from then on, clears included.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simlode.operators.change_table import ChangeTable
from simlode.sources import files
from simlode.operators.evaluate import rate_by_window


def changes(lines: DataFrame, group: str | None = None, dimension: int | None = None) -> DataFrame:
    """Log lines as changes in order of ``seq``; unsound inserts as deletes. Without a dimension every insert is unsound."""
    sound = F.col("vector").isNotNull() & (F.size("vector") == F.lit(-1 if dimension is None else dimension))
    kind = F.when(F.col("op") == "insert", F.when(sound, "put").otherwise("del")).when(F.col("op") == "delete", "del").when(F.col("op") == "clear", "clear")
    grp = F.col(group) if group else F.lit("")
    return lines.select(grp.cast("string").alias("grp"), F.col("id").alias("key"), kind.alias("kind"), F.col("seq").cast("double").alias("ts"), "seq", "vector", "metadata").where("kind IS NOT NULL")


def _dimension(table: ChangeTable, batch: DataFrame, given: int | None) -> int | None:
    """The dimension kept beside the table; settled by this batch, if by none before."""
    place = f"{table.path}/dimension.json"
    if files.exists(table.spark, place):
        kept = files.read_json(table.spark, place)
        if given not in (None, kept):
            raise ValueError(f"the collection has {kept} components, not {given}")
        return kept
    if given is None:
        fine = batch.where("op = 'insert' AND id IS NOT NULL AND size(vector) > 0")
        given = fine.agg(F.min_by(F.size("vector"), "seq")).first()[0]
    if given is not None:
        files.commit_json(table.spark, place, given)
    return given


def ingest(lines: DataFrame, table: ChangeTable, checkpoint: str, group: str | None = None, available_now: bool = True, dimension: int | None = None):
    """Start applying a stream of lines (``op, id, vector, metadata, seq``) to a table; the running query."""

    def apply(batch: DataFrame, _: int) -> None:
        table.apply(changes(batch, group, _dimension(table, batch, dimension)))

    writer = lines.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def request_rates(events: DataFrame, ts: str = "ts", width: str = "1 minute", late: str = "10 minutes", by: list[str] | None = None) -> DataFrame:
    """Requests per window of a stream; windows close once ``late`` has passed."""
    timed = events.withColumn(ts, F.col(ts).cast("timestamp"))  # times without zone are taken in the session's
    return rate_by_window(timed.withWatermark(ts, late), ts, width, by)


def worker_sessions(beats: DataFrame, worker: str = "worker_id", seen: str = "last_seen", gap: str = "6 seconds", late: str = "1 minute") -> DataFrame:
    """``worker, session_start, session_end, beats``: spans without a silence of ``gap`` or more.

    ``seen`` is in epoch seconds. Works on a stream and on a table.
    """
    timed = beats.select(F.col(worker), F.timestamp_seconds(F.col(seen)).alias("at")).where(F.col(worker).isNotNull() & F.col("at").isNotNull())
    grouped = timed.withWatermark("at", late).groupBy(F.session_window("at", gap).alias("w"), worker).agg(F.count(F.lit(1)).alias("beats"))
    return grouped.select(worker, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "beats")
