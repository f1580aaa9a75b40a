"""Replay of a mutation log: snapshot rows, then log lines in order of ``seq``.

The state after a line depends on the last clear, on each id's last line after
it, and on the dimension, so the fold is three aggregations without order:

* ``clear`` empties the collection and its dimension;
* ``insert`` replaces what is stored under the id; one with a missing vector or
  one of another dimension than the collection's removes it and stores nothing;
* ``delete`` of an absent id, other operations and lines without id do nothing;
* the dimension is that of the first well-formed insert after the last clear;
  without a clear the snapshot's, else the given one, comes before that.

A log line's ``timestamp`` plays no part. The last line of an id is found by a
combining maximum, so an id that fills a third of the log costs a row per task.

``group`` columns split the log into independent collections (one a worker).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def replay(log: DataFrame, snapshot: DataFrame | None = None, group: Sequence[str] = (), id_col: str = "id", vector_col: str = "vector", seq_col: str = "seq", payload: Sequence[str] = (), dimension: int | None = None) -> DataFrame:
    """``group, id, seq, vector`` and the payload of what is stored; snapshot rows have seq 0.

    ``snapshot`` has the group, id, vector and payload columns.
    """
    keep = [*group, id_col, seq_col, vector_col, *payload]
    lines = log.where(F.col("op").isin("insert", "delete", "clear")).select("op", *keep)
    if snapshot is not None:
        base = snapshot.select(F.lit("insert").alias("op"), *group, id_col, F.lit(0).cast(log.schema[seq_col].dataType).alias(seq_col), vector_col, *payload)
        lines = base.unionByName(lines)
    fine = (F.col("op") == "insert") & F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & (F.size(vector_col) > 0)
    # Sizes of groups travel, not lines: the first well-formed insert after the last clear needs both first.
    clears = lines.groupBy(*group).agg(F.max(F.when(F.col("op") == "clear", F.col(seq_col))).alias("_clear"))
    same = lambda a, b: [a[c].eqNullSafe(b[f"_g{i}"]) for i, c in enumerate(group)]
    named = lambda d: d.select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(group)], *[c for c in d.columns if c not in group])
    c = named(clears)
    on = _all(same(lines, c))
    after = lines.where("op <> 'clear'").join(c, on, "inner").where(F.col("_clear").isNull() | (F.col(seq_col) > F.col("_clear"))).drop(*[f"_g{i}" for i in range(len(group))])
    given = F.lit(dimension).cast("int")
    first = F.min(F.when(fine, F.struct(F.col(seq_col).alias("s"), F.size(vector_col).alias("d")))).alias("_first")
    dims = after.groupBy(*group).agg(first, F.max(F.when(F.col(seq_col) == 0, F.size(vector_col))).alias("_snap"), F.max("_clear").alias("_c"))
    dims = named(dims.select(*group, F.coalesce(F.when(F.col("_c").isNull(), F.coalesce(F.col("_snap"), given)), F.col("_first.d")).alias("_dim")))
    last = F.max_by(F.struct("op", vector_col, *payload), F.col(seq_col)).alias("_l")
    state = after.where(F.col(id_col).isNotNull()).groupBy(*group, id_col).agg(F.max(seq_col).alias(seq_col), last)
    joined = state.join(dims, _all(same(state, dims)), "inner")
    stored = joined.where((F.col("_l.op") == "insert") & (F.size(F.col(f"_l.{vector_col}")) == F.col("_dim")) & F.col(f"_l.{vector_col}").isNotNull())
    return stored.select(*group, id_col, seq_col, *[F.col(f"_l.{x}").alias(x) for x in [vector_col, *payload]])


def _all(conditions):
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def accepted(batch: DataFrame, stored: DataFrame, dimension: int | None = None, id_col: str = "id", vector_col: str = "vector", order: str = "seq") -> DataFrame:
    """The batch with ``reject``: why a row may not be inserted, null if it may.

    Inserting is not replay: an id that is stored already, or that came earlier
    in the batch, is refused, as are missing ids and vectors, non-finite
    components and other dimensions than ``dimension`` (or, without one, the
    dimension of the batch's first sound row).
    """
    v = F.col(vector_col)
    sound = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    firsts = batch.where(F.col(id_col).isNotNull() & (F.col(id_col) != "") & sound).groupBy(id_col).agg(F.min(order).alias("_first"))
    dim = batch.where(sound).agg(F.coalesce(F.lit(dimension).cast("int"), F.min_by(F.size(v), F.col(order))).alias("_dim"))
    known = stored.select(F.col(id_col)).where(F.col(id_col).isNotNull()).distinct().withColumn("_known", F.lit(True))
    rows = batch.join(firsts, id_col, "left").join(known, id_col, "left").join(F.broadcast(dim), F.lit(True))
    why = (
        F.when(F.col(id_col).isNull() | (F.col(id_col) == ""), "missing id")
        .when(~F.coalesce(sound, F.lit(False)), "unsound vector")
        .when(F.size(v) != F.col("_dim"), "dimension")
        .when(F.col("_known"), "already stored")
        .when(F.col(order) != F.col("_first"), "repeated in the batch")
    )
    return rows.withColumn("reject", why).select(*batch.columns, "reject")


def removed(collection: DataFrame, ids: DataFrame, id_col: str = "id", strict: bool = True) -> DataFrame:
    """The collection without ``ids``; with ``strict`` an id that is not stored raises KeyError."""
    if strict:
        absent = ids.where(F.col(id_col).isNotNull()).join(collection, id_col, "left_anti").limit(1).collect()
        if absent:
            raise KeyError(absent[0][id_col])
    return collection.join(ids, id_col, "left_anti")
