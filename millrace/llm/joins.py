"""Joins whose hot keys do not meet in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

HOT_KEYS = 10_000  # at most so many keys can have more than a HOT_KEYS-th part of all rows
HOT_ROWS = 1_000  # a key with fewer rows is not hot
HOT_BYTES = 256 << 20  # of the rows broadcast, where the caller tells their size


def spread_join(left: DataFrame, right: DataFrame, key: str, total: int, size: Column | None = None) -> DataFrame:
    """``left`` joined with ``right`` on ``key`` (inner).

    ``right`` has one row per key, with a column ``weight``: the key's rows in ``left``, ``total`` in
    all. Keys with over a HOT_KEYS-th part of them are met by a broadcast of their rows (so there are
    at most HOT_KEYS), all others by a shuffle in which no key stands out. ``size`` is the bytes of a wide
    row of ``right``: keys must then be hotter until the rows fit HOT_BYTES. Both sides are read twice
    if there are hot keys: give stored tables. Null keys match nothing.
    """
    bar = max(HOT_ROWS, total // HOT_KEYS)
    while True:
        hot = F.col("weight") > bar
        keys, wide = right.filter(hot).agg(F.count("*"), F.sum(F.lit(0) if size is None else size)).first()
        if not keys:
            return left.join(right.drop("weight"), key)
        if (wide or 0) <= HOT_BYTES:
            break
        bar *= 4
    many = F.broadcast(right.filter(hot).drop("weight"))
    few = left.join(F.broadcast(right.filter(hot).select(key)), key, "left_anti").join(right.filter(~hot).drop("weight"), key)
    return left.join(many, key).unionByName(few)
