"""As-of look-ups: the latest (or next) known value at a point, by one union and one window pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window as W

from millrace.operators import pieces


def asof_last(probes: DataFrame, samples: DataFrame, keys: list[str], ts: str, values: list[str], *, tie: str = "inclusive", block: int | None = None) -> DataFrame:
    """Probes with the values (and ``at``) of the latest sample at or before (``exclusive``: before) their time.

    Both sides are hashed on the keys once; nothing is joined, so a key's rows are sorted and
    streamed however many probes and samples it has. Where keys are few and long, ``block`` (of time) cuts their
    rows: a task sorts a block, and what was last known before it is carried to it.
    """
    first = 0 if tie == "inclusive" else 1
    s = samples.select(*keys, F.col(ts).alias("_ts"), F.lit(first).alias("_side"), F.struct(F.col(ts).alias("at"), *values).alias("_v"))
    p = probes.select(*keys, F.col(ts).alias("_ts"), F.lit(1 - first).alias("_side"), F.struct(*probes.columns).alias("_p"))
    both = s.unionByName(p, allowMissingColumns=True)
    order = [F.col("_ts"), F.col("_side"), F.col("_v")]
    by = keys
    if block:
        both, by = both.withColumn(pieces.BLOCK, F.floor(F.col("_ts") / block)), [*keys, pieces.BLOCK]
        latest = both.groupBy(*by).agg(F.max(F.when(F.col("_v").isNotNull(), F.struct("_ts", "_v"))).alias("_latest"))
        both = pieces.looked_up(both, pieces.carried(latest, keys, F.col("_latest"), "_carry", running="last"), keys, "_carry")
    seen = F.last("_v", ignorenulls=True).over(W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    return both.withColumn("_seen", F.coalesce(seen, F.col("_carry._v")) if block else seen).filter("_p IS NOT NULL").select("_p.*", "_seen.*")


def interpolate(probes: DataFrame, samples: DataFrame, keys: list[str], ts: str, x: str, y: str, place: str, max_gap: int) -> DataFrame:
    """Probes with px, py: linear between the samples around, if on one place and within ``max_gap``, else held; null before the first."""
    s = samples.select(*keys, F.col(ts).alias("_ts"), F.lit(0).alias("_side"), F.struct(F.col(ts).alias("t"), F.col(x).alias("x"), F.col(y).alias("y"), F.col(place).alias("m")).alias("_v"))
    p = probes.select(*keys, F.col(ts).alias("_ts"), F.lit(1).alias("_side"), F.struct(*probes.columns).alias("_p"))
    both = s.unionByName(p, allowMissingColumns=True)
    seen = F.last("_v", ignorenulls=True)
    there = seen.over(W.partitionBy(*keys).orderBy("_ts", "_side", "_v").rowsBetween(W.unboundedPreceding, 0))
    # the sample after is the last one seen when the order is turned round: a frame to the end would be read anew for each row
    back = seen.over(W.partitionBy(*keys).orderBy(F.desc("_ts"), F.desc("_side"), F.desc("_v")).rowsBetween(W.unboundedPreceding, 0))
    around = both.withColumns({"a": there, "b": back}).filter("_p IS NOT NULL")
    f = (F.col("_ts") - F.col("a.t")) / (F.col("b.t") - F.col("a.t"))
    between = F.col("b").isNotNull() & (F.col("a.m") == F.col("b.m")) & (F.col("b.t") - F.col("a.t") <= max_gap) & (F.col("b.t") > F.col("a.t"))
    at = lambda c: F.when(between, F.col(f"a.{c}") + (F.col(f"b.{c}") - F.col(f"a.{c}")) * f).otherwise(F.col(f"a.{c}"))
    return around.select("_p.*", at("x").alias("px"), at("y").alias("py"))


def running_marks(df: DataFrame, keys: list[str], order: str, delta: Column, name: str = "marks") -> DataFrame:
    """A running sum of +1 and -1 that never falls below zero: the sum less its lowest point so far."""
    w = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    run = df.withColumn("_run", F.sum(delta).over(w))
    return run.withColumn(name, (F.col("_run") - F.least(F.lit(0), F.min("_run").over(w))).cast("long")).drop("_run")


def carried(df: DataFrame, keys: list[str], order: str, value: str, name: str) -> DataFrame:
    """The last non-null value so far."""
    w = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn(name, F.last(value, ignorenulls=True).over(w))
