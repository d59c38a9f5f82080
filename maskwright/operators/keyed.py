"""Keyed table changes as plain joins; they run on tables of any size.

Each function returns the new content. Only ``new`` can be the broadcast side of
these joins, and only while Spark's own size estimate allows it; otherwise both
sides are shuffled on the key, once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def one_per_key(df: DataFrame, keys: list[str], order: Column, last: bool = True) -> DataFrame:
    """Keep one whole row per key: the last (or first) by ``order``.

    An aggregation rather than a window, so copies of a key are combined before
    the shuffle and a hot key costs one row per task. A row whose order is null
    is kept only if its key has no other.
    """
    row = F.struct(*df.columns)
    ranked = F.struct((order.isNull() if not last else order.isNotNull()).alias("null"), order.alias("order"))
    pick = F.max_by(row, ranked) if last else F.min_by(row, ranked)
    return df.groupBy(*keys).agg(pick.alias("_row")).select("_row.*")


def insert_if_absent(target: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``target`` plus the rows of ``new`` whose key it does not have yet."""
    return target.unionByName(absent_rows(target, new, keys))


def absent_rows(target: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """One row of ``new`` for each key that is not in ``target``: the least, of several.

    Null is a key value like any other."""
    return _without(_unique(new.select(*target.columns), keys), target, keys)


def _unique(df: DataFrame, keys: list[str], last: bool = False) -> DataFrame:
    row = F.struct(*df.columns)
    return df.groupBy(*keys).agg((F.max(row) if last else F.min(row)).alias("_row")).select("_row.*")


def _without(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of ``df`` whose key ``other`` does not have."""
    right = other.select(*[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)])
    same = [df[k].eqNullSafe(right[f"_key{i}"]) for i, k in enumerate(keys)]
    return df.join(right, reduce(lambda a, b: a & b, same), "left_anti")


def upsert(target: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Replace the rows of ``target`` that have a key in ``new``, add the others.

    Of several rows with one key in ``new`` the greatest stays (choose before with
    :func:`one_per_key`). Null is a key value like any other.
    """
    unique = _unique(new.select(*target.columns), keys, last=True)
    return _without(target, unique, keys).unionByName(unique)


def append(target: DataFrame, new: DataFrame) -> DataFrame:
    return target.unionByName(new)


def update_where(target: DataFrame, condition: Column, values: dict[str, Column]) -> DataFrame:
    """Set columns on the rows that meet ``condition``; no join, no shuffle."""
    return target.withColumns(
        {name: F.when(condition, value).otherwise(F.col(name)) for name, value in values.items()}
    )
