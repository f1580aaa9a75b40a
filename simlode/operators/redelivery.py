"""Messages delivered more than once: keep exactly one copy of each.

A message is named by key columns. The copy that stays is the first in arrival
order, given by columns that end in a unique one, so the choice never depends
on how the rows are spread. "Rank within the key and keep rank one" is computed
as the minimum of the order columns: a minimum combines on the map side, so a
message that makes up a third of all rows costs each task one row instead of
sending them all to one.

Defined cases (of all functions here)
* null key parts are equal to each other and to nothing else;
* rows with a null in ``required`` are nobody's copy and always stay;
* ties in arrival order cannot occur while the last order column is unique;
* an empty table gives an empty table with the same columns;
* columns beyond those named are carried along under their own names, whatever
  they are called.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _col(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def _complete(required: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, (_col(c).isNotNull() for c in required), F.lit(True))


def first_copies(df: DataFrame, keys: Sequence[str], order: Sequence[str], required: Sequence[str] = ()) -> DataFrame:
    """The order columns of the first copy of each message, named ``o0, o1, ...``."""
    first = F.min(F.struct(*[_col(c).alias(f"o{i}") for i, c in enumerate(order)])).alias("f")
    grouped = df.where(_complete(required)).groupBy(*[_col(c) for c in keys]).agg(first)
    return grouped.select(*[F.col(f"f.o{i}").alias(f"o{i}") for i in range(len(order))])


def _match(df: DataFrame, firsts: DataFrame, order: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, (df["`" + c.replace("`", "``") + "`"].eqNullSafe(firsts[f"o{i}"]) for i, c in enumerate(order)))


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str], required: Sequence[str] = ()) -> DataFrame:
    """One row per message: the first in ``order``; incomplete rows all stay."""
    firsts = first_copies(df, keys, order, required)
    kept = df.where(_complete(required)).join(firsts, _match(df, firsts, order), "left_semi")
    return kept.unionByName(df.where(~_complete(required))) if required else kept


def later_copies(df: DataFrame, keys: Sequence[str], order: Sequence[str], required: Sequence[str] = ()) -> DataFrame:
    """The rows that :func:`keep_first` leaves out.

    Both joins of the two functions run on the order columns, which are unique,
    so no join partition grows with the number of copies.
    """
    firsts = first_copies(df, keys, order, required)
    return df.where(_complete(required)).join(firsts, _match(df, firsts, order), "left_anti")


def unseen(batch: DataFrame, stored: DataFrame, keys: Sequence[str], order: Sequence[str], required: Sequence[str] = ()) -> DataFrame:
    """The rows of a new batch to be stored: first copies whose message is not in ``stored``.

    ``stored`` needs the key columns only. Null key parts match each other.
    Both sides are reduced to one row per message before the anti-join, so no
    message repeated within the batch or among the stored ones can skew it.
    """
    fresh = keep_first(batch, keys, order, required)
    names = [f"k{i}" for i in range(len(keys))]
    known = stored.where(_complete([c for c in required if c in stored.columns])).select(*[_col(c).alias(n) for c, n in zip(keys, names)]).distinct()
    # The equality below is null-safe; Spark still hashes both sides on the keys.
    on = reduce(lambda a, b: a & b, (fresh["`" + c.replace("`", "``") + "`"].eqNullSafe(known[n]) for c, n in zip(keys, names)))
    return fresh.join(known, on & _complete(required), "left_anti")
