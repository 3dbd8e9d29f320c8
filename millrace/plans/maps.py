"""Positions on maps: tracks with a home point and deaths, replay look-ups, floors and votes for them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window as W

from millrace.operators import asof, pairing
from millrace.plans import runs as run_plan
from millrace.plans.reports import THIN_MS, Context

LINGER_MS, FRESH_MS = 5_000, 5_000
BLOCK_MS = 3_600_000  # of a unit's samples, for a task


def samples(ctx: Context, of: DataFrame | None = None) -> DataFrame:
    """(run_id, actor, enemy, ts, row, x, y, map, hp_pct): every described position of members and, given ``of`` (run_id, enemy), of engaged enemies."""
    who = ctx.party.select("run_id", F.col("guid").alias("subject"), F.lit(False).alias("enemy"))
    if of is not None:
        who = who.unionByName(of.select("run_id", F.col("enemy").alias("subject"), F.lit(True).alias("enemy")).distinct())
    p = ctx.events.filter("subject IS NOT NULL AND map > 0 AND (x <> 0 OR y <> 0)").join(who, ["run_id", "subject"])
    pct = F.when((F.col("hp_max") > 0) & (F.col("hp") >= 0), F.least(F.lit(100), F.floor(100 * F.col("hp") / F.col("hp_max") + 0.5)))
    return p.select("run_id", F.col("subject").alias("actor"), "enemy", "ts", "row", "x", "y", "map", pct.cast("int").alias("hp_pct"))


def tracks(ctx: Context, of: DataFrame | None = None, least: int = THIN_MS) -> DataFrame:
    """Samples at least ``least`` ms after the last kept one, or on another map."""
    return pairing.kept_apart(samples(ctx, of), ["run_id", "actor"], "ts", "row", least, "map")


def homes(rows: DataFrame) -> DataFrame:
    """(run_id, actor, x, y, map): where each unit stood before anything hurt it: its first sample at full health before any below, else its first."""
    hurt = F.min(F.when(F.col("hp_pct") < 100, F.col("row"))).over(W.partitionBy("run_id", "actor"))
    spot, healthy = F.struct("x", "y", "map"), (F.col("hp_pct") == 100) & (F.col("_hurt").isNull() | (F.col("row") < F.col("_hurt")))
    g = rows.withColumn("_hurt", hurt).groupBy("run_id", "actor").agg(F.min_by(spot, F.when(healthy, F.col("row"))).alias("a"), F.min_by(spot, "row").alias("b"))
    return g.select("run_id", "actor", F.coalesce("a", "b").alias("h")).select("run_id", "actor", "h.*")


def track_deaths(ctx: Context) -> DataFrame:
    """(run_id, actor, died): times at which each unit died or was destroyed, in order."""
    gone = ctx.events.filter("code IN ('UNIT_DIED', 'UNIT_DESTROYED') AND NOT coalesce(feigned, false)")
    return gone.groupBy("run_id", F.col("dst").alias("actor")).agg(F.array_sort(F.collect_list("ts")).alias("died"))


def map_point(x: Column, y: Column, bounds: dict[str, Column]) -> tuple[Column, Column]:
    """(across, down) in 0..1 of the map's image: a quarter turn of the world's axes; 0 on a map without extent."""
    part = lambda v, lo, hi: F.when(hi > lo, (hi - v) / (hi - lo)).otherwise(0.0)
    return part(y, bounds["y0"], bounds["y1"]), part(x, bounds["x0"], bounds["x1"])


def replay(probes: DataFrame, rows: DataFrame, dead: DataFrame) -> DataFrame:
    """``probes`` (run_id, actor, ts) with the last sample (x, y, map, hp_pct, seen), live and dead.

    live: seen within five seconds before. dead: the last death or later sign (a sample with health) is a death.
    """
    keys = ["run_id", "actor"]
    out = asof.asof_last(probes, rows.withColumn("seen", F.col("ts")), keys, "ts", ["x", "y", "map", "hp_pct", "seen"], block=BLOCK_MS).drop("at")
    gone = dead.select("run_id", "actor", F.explode("died").alias("ts")).withColumn("up", F.lit(False))
    signs = rows.filter("hp_pct > 0").select("run_id", "actor", "ts", F.lit(True).alias("up")).unionByName(gone)
    last = asof.asof_last(out, signs, keys, "ts", ["up"], block=BLOCK_MS)
    return last.withColumns({"live": F.coalesce(F.col("ts") - F.col("seen") <= LINGER_MS, F.lit(False)), "dead": F.coalesce(~F.col("up"), F.lit(False))}).drop("up", "at")


def floors(ctx: Context, rows: DataFrame) -> DataFrame:
    """(run_id, map, floor, title, label, x0, x1, y0, y1): maps with samples, by first time, names that come twice numbered; extents from the log, else from the samples."""
    seen = rows.groupBy("run_id", "map").agg(F.min("ts").alias("first"), *(f(c).alias(n) for c, n, f in (("x", "_x0", F.min), ("x", "_x1", F.max), ("y", "_y0", F.min), ("y", "_y1", F.max))))
    told = run_plan.maps(ctx.controls, ctx.runs).drop("first")
    out = seen.join(told, ["run_id", "map"], "left").withColumns({c: F.coalesce(c, f"_{c}") for c in ("x0", "x1", "y0", "y1")})
    out = out.withColumns({"title": F.coalesce("title", F.concat(F.lit("Map "), F.col("map").cast("string"))), "floor": F.row_number().over(W.partitionBy("run_id").orderBy("first", "map"))})
    twin = W.partitionBy("run_id", "title")
    label = F.when(F.count("*").over(twin) > 1, F.concat("title", F.lit(" "), F.row_number().over(twin.orderBy("floor")).cast("string"))).otherwise(F.col("title"))
    return out.select("run_id", "map", "floor", "title", label.alias("label"), "x0", "x1", "y0", "y1")


def segment_floors(home: DataFrame, of: DataFrame, summons: DataFrame | None = None) -> DataFrame:
    """(run_id, segment, map, votes): the map on which most of a segment's enemies stood; summoned ones vote only if there are no others.

    ``summons`` has run_id and enemy.
    """
    at = of.select("run_id", "segment", F.col("enemy").alias("actor")).join(home, ["run_id", "actor"])
    if summons is not None:
        at = at.join(summons.select("run_id", F.col("enemy").alias("actor"), F.lit(True).alias("_s")), ["run_id", "actor"], "left")
        at = at.withColumn("_all", F.bool_and(F.coalesce("_s", F.lit(False))).over(W.partitionBy("run_id", "segment"))).filter("_s IS NULL OR _all")
    n = at.groupBy("run_id", "segment", "map").agg(F.count("*").alias("votes"))
    return n.groupBy("run_id", "segment").agg(F.max_by("map", F.struct("votes", -F.col("map"))).alias("map"), F.max("votes").alias("votes"))


def party_floor(times: DataFrame, ctx: Context, rows: DataFrame) -> DataFrame:
    """``times`` (run_id, ts) with the map that most members were last seen on: samples of the last five seconds count, older ones only if there are none."""
    probes = times.join(ctx.party.select("run_id", F.col("guid").alias("actor")), "run_id")
    seen = asof.asof_last(probes, rows.withColumn("seen", F.col("ts")), ["run_id", "actor"], "ts", ["map", "seen"]).filter("map IS NOT NULL")
    fresh = (F.col("ts") - F.col("seen") <= FRESH_MS).cast("int")
    n = seen.withColumn("_f", fresh).groupBy("run_id", "ts", "_f", "map").agg(F.count("*").alias("n"))
    best = n.groupBy("run_id", "ts").agg(F.max_by("map", F.struct("_f", "n", -F.col("map"))).alias("map"))
    return times.join(best, ["run_id", "ts"], "left")
