"""Joins that stay balanced when a few keys hold a large part of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOT_KEYS = 10_000


def join_lookup(left: DataFrame, lookup: DataFrame, keys: list[str], weight: Column, total: Column | float,
                how: str = "inner", hot_keys: int = HOT_KEYS) -> DataFrame:
    """Join ``left`` with ``lookup`` (one row per key) without a hot shuffle key.

    ``weight`` is the number of left rows of a lookup key, ``total`` their sum.
    Keys with more than ``total / hot_keys`` rows go through a broadcast that
    can hold at most ``hot_keys`` rows by that very condition; all other keys
    are shuffled, none of them with more than that share of the rows.
    Null keys match nothing; with ``how="left"`` unmatched rows keep nulls.
    """
    marked = lookup.withColumn("_hot", weight * F.lit(hot_keys) > total)
    hot = marked.filter("_hot").drop("_hot")
    cold = marked.filter(~F.coalesce("_hot", F.lit(False))).drop("_hot")
    names = hot.select(*keys)
    by_hot = left.join(F.broadcast(hot), keys, "inner")
    rest = left.join(F.broadcast(names), keys, "left_anti")
    return by_hot.unionByName(rest.join(cold, keys, how))
