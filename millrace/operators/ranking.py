"""Leaders, places and points within a party, and picks among its members."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window as W


def _party(party: list[str]) -> W:
    return W.partitionBy(*party)


def leaders(df: DataFrame, party: list[str], value: str, best: str = "most") -> DataFrame:
    """Members who hold the party's best value; nobody in a party of one, at a best of zero or less ("most"), or if over half tie."""
    w, top = _party(party), (F.max if best == "most" else F.min)(value).over(_party(party))
    held = df.withColumns({"_top": top, "_size": F.count("*").over(w)}).filter((F.col(value) == F.col("_top")) & (F.col("_size") >= 2))
    held = held.withColumn("_ties", F.count("*").over(w)).filter(2 * F.col("_ties") <= F.col("_size"))
    return (held.filter("_top > 0") if best == "most" else held).drop("_top", "_size", "_ties")


def places(df: DataFrame, party: list[str], value: str, name: str = "place") -> DataFrame:
    """Competition ranks, the largest value first."""
    return df.withColumn(name, F.rank().over(_party(party).orderBy(F.desc(value))))


def rank_points(df: DataFrame, party: list[str], value: str, best: str = "most", name: str = "points") -> DataFrame:
    """One point more than members beaten; for "most" a value of zero scores nothing. A member without a value scores nothing and is not beaten."""
    w = _party(party)
    beaten = F.count(value).over(w) - F.rank().over(w.orderBy(F.asc_nulls_last(value) if best == "fewest" else F.desc_nulls_last(value))) - (F.count("*").over(w.partitionBy(*party, value)) - 1)
    scores = F.col(value) > 0 if best == "most" else F.col(value).isNotNull()
    return df.withColumn(name, F.when(scores, beaten + 1).otherwise(0).cast("long"))


def share_points(df: DataFrame, party: list[str], value: str, most: int, floor: float = 0.0, name: str = "points") -> DataFrame:
    """``most`` times the value's part of the way from ``floor`` to the party's best, rounded half up; nothing at or below the floor."""
    top = F.max(value).over(_party(party))
    part = (F.col(value) - floor) / (top - floor)
    return df.withColumn(name, F.when((F.col(value) > floor) & (top > floor), F.floor(most * part + 0.5)).otherwise(0).cast("long"))


def stepped_points(df: DataFrame, party: list[str], value: str, most: int, step: int, name: str = "points") -> DataFrame:
    """Points by share of the best, but at least ``most`` less a ``step`` per place below the first."""
    shared = share_points(places(df, party, value, "_place"), party, value, most, name="_share")
    return shared.withColumn(name, F.when(F.col(value) > 0, F.greatest(F.col("_share"), most - step * (F.col("_place") - 1), F.lit(0))).otherwise(0).cast("long")).drop("_place", "_share")


def standings(points: DataFrame, party: list[str], member: str, value: str = "points") -> DataFrame:
    """Members by the sum of their points over all categories, ties sharing a place."""
    total = points.groupBy(*party, member).agg(F.sum(value).alias("total"))
    return places(total, party, "total")


def gap_title(df: DataFrame, party: list[str], value: str, times: float, least: float = 0.0, name: str = "runaway") -> DataFrame:
    """Whether a party's leader is so many times (and at least ``least``) ahead of the runner-up."""
    ranked = df.withColumn("_r", F.row_number().over(_party(party).orderBy(F.desc(value))))
    top = ranked.groupBy(*party).agg(F.max(F.when(F.col("_r") == 1, F.col(value))).alias("best"), F.coalesce(F.max(F.when(F.col("_r") == 2, F.col(value))), F.lit(0.0)).alias("second"))
    return top.withColumn(name, (F.col("best") >= least) & (F.col("best") >= times * F.col("second")) & (F.col("best") > 0))


def arg_best(df: DataFrame, keys: list[str], pick: Column, value: Column, order: Column) -> DataFrame:
    """The pick at the greatest value per key, the earliest in order on ties."""
    return df.groupBy(*keys).agg(F.max_by(pick, F.struct(value.alias("v"), (-order).alias("o"))).alias("pick"), F.max(value).alias("best"))


def dominant(df: DataFrame, keys: list[str], value: str, order: str, name: str = "dominant") -> DataFrame:
    """The most frequent value per key; on ties the one seen first."""
    n = df.groupBy(*keys, value).agg(F.count("*").alias("_n"), F.min(order).alias("_first"))
    return n.groupBy(*keys).agg(F.max_by(value, F.struct("_n", -F.col("_first"))).alias(name), F.max("_n").alias("votes"))
