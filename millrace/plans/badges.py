"""Badges: each metric's value per member, from the reports, and the rules by which one holds it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from millrace.operators import pairing
from millrace.plans.deaths import Recap
from millrace.plans.reports import LOOKBACK_MS, TANK_SPECS, Context, elapsed

#: Times within which one thing is put down to another, and least amounts.
INEVITABLE_MS, BLOCKED_MS, CORPSE_MS, RIDE_MS, CLIFF_MS, DASHED_MS, SLOW_DEATH_MS = 5_000, 3_000, 10_000, 2_000, 3_000, 1_500, 5_000
ONE_BLOW = 0.9  # of full health
FUMES_MANA, SKITTISH, PARANOID_SHARE, LUCK_EXPECTED, COMMITMENT_BARS, PROTECTION = 5, 0.5, 0.25, 10, 100, 1022
HEALER_SPECS = (65, 105, 256, 257, 264, 270, 1468)
#: Fixed values: (badge, kind, best, field, least value that counts, times the runner-up for a title, least value for a title).
METRICS = (
    ("gravity", "roast", "most", "party", None, 3, 2e12), ("floor", "roast", "most", "party", None, 2, 3), ("magnet", "roast", "most", "party", None, 2, None), ("rng", "roast", "most", "party", None, 1.5, 8),
    ("backpack", "roast", "fewest", "dps", None, 2, None), ("ankh", "roast", "most", "party", None, None, None), ("cheater", "roast", "most", "party", None, 2, 3), ("lockout", "roast", "most", "party", None, None, None),
    ("air", "roast", "most", "party", 3, 2, None), ("rather-die", "roast", "most", "party", None, None, None), ("stam-check", "roast", "most", "party", None, None, None), ("commitment", "roast", "most", "party", 0.1, 2, None),
    ("threat", "roast", "most", "nontank", 10, 2, 30), ("typhoid", "roast", "most", "nontank", None, 1.5, None), ("neglected", "roast", "most", "nonhealer", None, None, None), ("padder", "roast", "most", "party", 0.1, 2, None),
    ("wannabe", "roast", "most", "nontank", None, None, None), ("self-infused", "roast", "most", "party", None, None, None), ("unemployment", "roast", "most", "party", None, None, None), ("route", "roast", "most", "party", None, None, None),
    ("inevitable", "roast", "most", "party", None, None, None), ("block", "roast", "most", "party", None, None, None), ("corpse", "roast", "most", "party", None, None, None), ("cliff", "roast", "most", "party", None, None, None),
    ("dashed", "roast", "most", "party", 2, None, None), ("princess", "roast", "most", "party", None, None, None), ("last-ride", "roast", "most", "party", None, None, None), ("fumes", "roast", "most", "healer", None, None, None),
    ("hold-my-beer", "roast", "most", "party", 1, None, None), ("hot-feet", "roast", "most", "party", 5, 2, 15), ("cookie", "roast", "most", "party", 4, None, None), ("drinking", "roast", "most", "party", 3, None, None),
    ("skittish", "roast", "most", "party", 1, None, None), ("keybind", "roast", "fewest", "forgot", None, None, None), ("paranoid", "roast", "most", "party", 0.45, None, None), ("lust", "glory", "most", "party", None, None, None),
    ("plague", "glory", "most", "party", None, 2, None), ("mirror", "glory", "most", "party", None, None, None), ("procs", "glory", "most", "party", 1.15, None, None), ("necromancer", "glory", "most", "party", None, None, None),
    ("hero", "glory", "most", "party", None, None, None), ("angel", "glory", "most", "nonhealer", None, None, None), ("live", "glory", "most", "nontank", None, None, None), ("favorite", "glory", "most", "party", None, None, None),
    ("uber", "glory", "most", "party", None, None, None), ("flyer", "glory", "most", "party", None, None, None), ("marathon", "glory", "most", "party", None, 1.2, None), ("klepto", "glory", "most", "party", None, None, None),
    ("totems", "glory", "most", "party", None, 2, 5), ("janitor", "glory", "most", "party", None, 2, 6), ("blood", "glory", "most", "party", 6, None, None), ("cc", "glory", "most", "party", None, 2, 8),
    ("apm", "glory", "most", "party", None, 1.5, 60), ("kicks", "glory", "most", "party", None, 2, 10), ("yoink", "glory", "most", "party", 3, 2, 5), ("untouchable", "glory", "fewest", "party", None, None, None),
    ("unkillable", "glory", "fewest", "party", None, None, None), ("oneshot", "glory", "most", "party", None, 3, None), ("comrade", "glory", "most", "party", 1.75, None, None), ("lifeguard", "glory", "most", "dps", None, 2, None),
    ("pumper", "glory", "most", "party", None, 1.5, None),
)


def metrics(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, kind, best, field, None if least is None else float(least), None if t is None else float(t), None if g is None else float(g)) for k, kind, best, field, least, t, g in METRICS], "key string, kind string, best string, field string, least double, times double, gap_min double")


def times_of(rows: DataFrame, actor: str = "actor") -> DataFrame:
    """(run_id, actor, value): how often each member comes."""
    return rows.groupBy("run_id", F.col(actor).alias("actor")).agg(F.count("*").cast("double").alias("value"))


def amount_of(rows: DataFrame, value: Column | str, actor: str = "actor") -> DataFrame:
    return rows.groupBy("run_id", F.col(actor).alias("actor")).agg(F.sum(value).cast("double").alias("value"))


def led_to(before: DataFrame, after: DataFrame, who: str, within: int) -> DataFrame:
    """Rows of ``after`` (run_id, actor, ts, row) preceded by a row of ``before`` (run_id, ``who``, actor, ts, row) of the same member at most ``within`` ms earlier, with the latest such row's ``by``."""
    own = before.select("run_id", F.col(who).alias("actor"), F.col("actor").alias("by"), "ts", "row")
    found = pairing.latest_before(after, own, ["run_id", "actor"], "ts", "row", within)
    return after.join(found, "row").join(own.select(F.col("row").alias("other"), "by").distinct(), "other").drop("other")


def led_somewhere(before: DataFrame, after: DataFrame, who: str, within: int) -> DataFrame:
    """Rows of ``before`` (run_id, ``who``, ts, row) whose member comes in ``after`` (run_id, actor, ts) at most ``within`` ms later."""
    near = pairing.near(before.withColumn("_who", F.col(who)).select("run_id", "_who", "ts", "row"), after.select("run_id", F.col("actor").alias("_who"), "ts"), ["run_id", "_who"], "ts", 0, within)
    return before.join(near.select(F.col("a.row").alias("row")).distinct(), "row", "left_semi")


def values(parts: dict[str, DataFrame], party: DataFrame) -> DataFrame:
    """(run_id, key, actor, value) of every badge in ``parts`` (key: run_id, actor, value), for every member of the badge's field, 0 where a member has none.

    ``party`` has run_id, guid, spec_id and, for the keybind badge, may have forgot.
    """
    known = {m[0]: m for m in METRICS}
    tank, healer = F.coalesce(F.col("spec_id").isin(*TANK_SPECS), F.lit(False)), F.coalesce(F.col("spec_id").isin(*HEALER_SPECS), F.lit(False))
    fields = {"party": F.lit(True), "dps": ~tank & ~healer, "nontank": ~tank, "healer": healer, "nonhealer": ~healer, "forgot": F.col("forgot") if "forgot" in party.columns else F.lit(False)}
    each = [
        party.filter(fields[known[key][3]]).select("run_id", F.col("guid").alias("actor")).join(df.select("run_id", "actor", "value"), ["run_id", "actor"], "left").select("run_id", F.lit(key).alias("key"), "actor", F.coalesce("value", F.lit(0.0)).alias("value"))
        for key, df in parts.items()
    ]
    return reduce(DataFrame.unionByName, each)


def neglected(ctx: Context, dead: DataFrame, told: Recap) -> DataFrame:
    """Rows of ``dead`` who were no healers, took five seconds or more from the first hit of their last ten, and had no heal of a healer in those.

    A party without a healer neglects nobody. ``told`` is the recap of these deaths.
    """
    healers = ctx.party.filter(F.col("spec_id").isin(*HEALER_SPECS)).select("run_id", F.col("guid").alias("healer"))
    late = lambda rows: rows.join(told._died(), ["run_id", "anchor"]).filter(F.col("ts") >= F.col("died") - LOOKBACK_MS)
    slow = late(told.incoming()).groupBy("run_id", "anchor").agg((F.max("died") - F.min("ts")).alias("_took")).filter(F.col("_took") >= SLOW_DEATH_MS)
    helped = late(told.heals()).join(healers.withColumnRenamed("healer", "source"), ["run_id", "source"], "left_semi")
    key = lambda rows: rows.select("run_id", F.col("anchor").alias("row")).distinct()
    left = dead.join(healers.select("run_id").distinct(), "run_id", "left_semi").join(healers.withColumnRenamed("healer", "dst"), ["run_id", "dst"], "left_anti")
    return left.join(key(slow), ["run_id", "row"], "left_semi").join(key(helped), ["run_id", "row"], "left_anti")


def undodgeable(dead: DataFrame, told: Recap, hits: DataFrame, covered: DataFrame) -> DataFrame:
    """Rows of ``dead`` with ``spell_id``, killed by one blow of nine tenths of their full health or more that no rule of the avoidable list names.

    No melee swing and no fall. ``hits`` are the avoidable hits (run_id, actor, ts, spell_id), ``covered`` the runs (run_id) whose
    dungeon the list covers; in others every blow would seem unavoidable.
    """
    blow = told.totals().select("run_id", "anchor", F.col("blow.ts").alias("ts"), F.col("blow.spell_id").alias("spell_id"), F.col("blow.net").alias("_net")).filter("spell_id <> 0")
    full = told.trace().groupBy("run_id", "anchor").agg(F.max_by("hp_max", "row").alias("_full"))
    one = blow.join(full, ["run_id", "anchor"]).filter((F.col("_full") > 0) & (F.col("_net") >= ONE_BLOW * F.col("_full")))
    found = dead.drop("ts", "spell_id").join(one.withColumnRenamed("anchor", "row"), ["run_id", "row"]).join(covered.select("run_id").distinct(), "run_id", "left_semi")
    return found.join(hits.select("run_id", F.col("actor").alias("dst"), "ts", "spell_id").distinct(), ["run_id", "dst", "ts", "spell_id"], "left_anti").drop("_net", "_full")


def with_outcome(ctx: Context, spans: DataFrame) -> DataFrame:
    """Segments with ``success``: of bosses by the control row that ended them (null while there is none), of pulls null."""
    boss = ctx.runs.select("run_id", "file_id", F.posexplode("bosses").alias("n", "b")).select("run_id", "file_id", F.concat(F.lit("boss:"), F.col("n").cast("string")).alias("segment"), F.col("b.encounter_id").alias("encounter_id"), F.col("b.end_ms").alias("wall_ms"))
    ended = ctx.controls.filter("name = 'ENCOUNTER_END'").select("file_id", "encounter_id", "wall_ms", "success")
    known = boss.join(ended, ["file_id", "encounter_id", "wall_ms"]).groupBy("run_id", "segment").agg(F.bool_or("success").alias("success"))
    return spans.drop("success").join(known, ["run_id", "segment"], "left")


def short_routes(ctx: Context, spans: DataFrame, of: DataFrame, worth: DataFrame) -> DataFrame:
    """(run_id, count, total): keys that succeeded, with all of the count in the end, but killed the last boss without it.

    The count at that time is of every segment begun before the last boss that fell, that boss's own, and pulls begun
    during the fight. ``spans`` have ``success``, ``of`` the enemies' segments, ``worth`` mode_id, npc_id, value and total.
    """
    totals = worth.groupBy("mode_id").agg(F.max("total").alias("total")).filter("total > 0")
    timed = ctx.runs.filter("kind = 'key' AND success").select("run_id", "mode_id").join(totals, "mode_id")
    kills = of.filter("defeated").groupBy("run_id", "segment", "npc_id").agg(F.count("*").alias("_n")).join(timed, "run_id")
    each = kills.join(worth.select("mode_id", "npc_id", "value"), ["mode_id", "npc_id"]).groupBy("run_id", "segment").agg(F.sum(F.col("value") * F.col("_n")).alias("_forces"))
    last = spans.filter("boss AND success").groupBy("run_id").agg(F.max_by(F.struct("segment", "start", "end"), F.struct("start", "segment")).alias("_boss"))
    at = spans.select("run_id", "segment", "start", "boss").join(each, ["run_id", "segment"]).join(last, "run_id")
    early = (F.col("segment") == F.col("_boss.segment")) | (F.col("start") < F.col("_boss.start")) | (~F.col("boss") & (F.col("start") < F.col("_boss.end")))
    sums = at.groupBy("run_id").agg(F.sum(F.when(early, F.col("_forces")).otherwise(0)).alias("count"), F.sum("_forces").alias("_all"))
    return timed.join(sums, "run_id").filter((F.col("count") < F.col("total")) & (F.col("_all") >= F.col("total"))).select("run_id", "count", "total")


def measured(ctx: Context, seen: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The metric behind each badge, for as many as ``seen`` has the reports of.

    ``seen`` maps a report's name to its rows: deaths (dst), hits (avoidable), picks, damage and healing (breakdowns), moments (moment, actor,
    target, spell_id), falls, kicks (interrupt summary), stops, control and dispels (rows), totems, biggest, tallies, swings, padding, rush, links, drains,
    uses, procs, distance, casting, lusts, rezzes, infusions, self_infusions, melds, on_others, neglected, undodgeable,
    short_routes and stands (``last_stands``).
    """
    out: dict[str, DataFrame] = {}
    has = lambda *names: all(n in seen for n in names)
    moment = lambda kind: seen["moments"].filter(F.col("moment") == kind)
    deaths = seen["deaths"].withColumn("actor", F.col("dst")) if has("deaths") else None
    if has("deaths"):
        out |= {"floor": times_of(deaths), "unkillable": times_of(deaths)}
    if has("hits"):
        out |= {"magnet": amount_of(seen["hits"], "amount"), "untouchable": amount_of(seen["hits"], "amount")}
    if has("damage"):
        total = amount_of(seen["damage"], "total")
        out |= {"pumper": total, "backpack": total}
    if has("healing"):
        out["lifeguard"] = amount_of(seen["healing"], "total")
    if has("moments"):
        kinds = {"cheat": "cheater", "ankh": "ankh", "lockout": "lockout", "reflect": "mirror", "taunt": "wannabe", "gateway": "flyer", "defensive": "live", "external": "angel", "lift": "uber"}
        out |= {badge: times_of(moment(kind)) for kind, badge in kinds.items()}
        out["princess"] = times_of(moment("lift"), "target")
        tanks = ctx.party.filter(F.col("spec_id").isin(*TANK_SPECS)).select("run_id", F.col("guid").alias("target"))
        out["unemployment"] = times_of(moment("external").filter(F.col("spell_id") == PROTECTION).join(tanks, ["run_id", "target"], "left_semi"))
    if has("moments", "deaths"):
        out["inevitable"] = times_of(led_to(moment("immunity"), deaths, "actor", INEVITABLE_MS))
        out["block"] = times_of(led_to(moment("offensive"), deaths, "actor", BLOCKED_MS))
        out["corpse"] = times_of(led_somewhere(moment("external"), deaths, "target", CORPSE_MS))
        out["last-ride"] = times_of(led_somewhere(moment("lift"), deaths, "target", RIDE_MS), "target")
    if has("moments", "falls"):
        out["cliff"] = times_of(led_to(moment("dash"), seen["falls"], "actor", CLIFF_MS))
    if has("moments", "hits"):
        out["dashed"] = times_of(led_to(moment("dash"), seen["hits"], "actor", DASHED_MS))
    if has("falls"):
        # deadly falls first, then how often, then how hard
        out["gravity"] = seen["falls"].groupBy("run_id", "actor").agg((1e12 * F.count_if("fatal") + 1e12 * F.count("*") + F.sum("amount")).alias("value"))
    if has("picks"):
        out["rng"] = times_of(seen["picks"])
    if has("kicks"):
        out |= {"kicks": amount_of(seen["kicks"], "stops"), "air": amount_of(seen["kicks"], F.col("nothing") + F.col("late") + F.col("early"))}
    if has("attempts", "stops"):
        beaten = seen["attempts"].filter("outcome = 'doubled'").select("run_id", F.col("actor").alias("late"), "target", "ts", "row")
        first = pairing.latest_before(beaten, seen["stops"].select("run_id", "target", "ts", "row"), ["run_id", "target"], "ts", "row", CORPSE_MS)
        out["yoink"] = times_of(first.join(seen["stops"].select("run_id", "actor", F.col("row").alias("other")), "other").join(beaten.select("row", "late"), "row").filter("late <> actor"))
    if has("control"):
        out["cc"] = seen["control"].groupBy("run_id", "actor").agg(F.countDistinct("press").cast("double").alias("value"))
    if has("dispels"):
        out |= {"janitor": times_of(seen["dispels"]), "blood": times_of(seen["dispels"].filter("bleed")), "klepto": times_of(seen["dispels"].filter("stolen"))}
    if has("tallies"):
        out |= {"typhoid": amount_of(seen["tallies"], "debuffs"), "plague": amount_of(seen["tallies"], "debuffs_applied")}
    plain = {"swings": ("threat", "swings"), "rush": ("hot-feet", "bars"), "distance": ("marathon", "yards"), "biggest": ("oneshot", "best")}
    out |= {badge: amount_of(seen[n], col) for n, (badge, col) in plain.items() if has(n)}
    counted = {"totems": "totems", "lusts": "lust", "rezzes": "necromancer", "self_infusions": "self-infused", "melds": "hold-my-beer"}
    out |= {badge: times_of(seen[n]) for n, badge in counted.items() if has(n)}
    if has("infusions"):
        out["favorite"] = times_of(seen["infusions"], "target")
    if has("neglected"):
        out["neglected"] = times_of(seen["neglected"], "dst")
    if has("undodgeable"):
        out["stam-check"] = times_of(seen["undodgeable"], "dst")
    if has("short_routes"):
        led = ctx.party.filter(F.col("spec_id").isin(*TANK_SPECS)).select("run_id", F.col("guid").alias("actor"))
        out["route"] = times_of(led.join(seen["short_routes"], "run_id", "left_semi"))
    if has("stands"):  # in a key that was lost anyway the last one up is no hero
        out["hero"] = times_of(seen["stands"].join(ctx.runs.filter("kind = 'key' AND success"), "run_id", "left_semi"))
    if has("links"):
        out["comrade"] = seen["links"].groupBy("run_id", F.col("src_root").alias("actor")).agg(F.max("bars").cast("double").alias("value"))
    if has("drains"):
        out["fumes"] = times_of(seen["drains"].filter(F.col("mana") < FUMES_MANA))
    if has("uses"):
        u = seen["uses"]
        out |= {"cookie": times_of(u.filter("stone")), "drinking": times_of(u.filter("NOT stone")), "keybind": times_of(u), "skittish": times_of(u.filter((F.col("amount") > 0) & (F.col("overhealing") > SKITTISH * F.col("amount"))))}
    if has("padding", "damage"):
        all_ = amount_of(seen["damage"], "total").withColumnRenamed("value", "_all")
        out["padder"] = seen["padding"].join(all_, ["run_id", "actor"]).select("run_id", "actor", F.when(F.col("_all") > 0, F.col("padding") / F.col("_all")).otherwise(0.0).alias("value"))
    if has("on_others"):
        run = seen["on_others"].groupBy("run_id").agg(F.sum("healing").alias("_all"))
        part = F.when((F.col("healing") > 0) & (F.col("healing") >= PARANOID_SHARE * F.col("_all")), F.col("overhealing") / F.col("healing")).otherwise(0.0)
        out["paranoid"] = seen["on_others"].join(run, "run_id").select("run_id", "actor", part.cast("double").alias("value"))
    if has("procs"):
        g = seen["procs"].groupBy("run_id", "actor").agg(F.sum("procs").alias("n"), F.sum("expected").alias("e"))
        out["procs"] = g.select("run_id", "actor", F.when(F.col("e") >= LUCK_EXPECTED, F.col("n") / F.col("e")).otherwise(0.0).alias("value"))
    if has("casting"):
        c = seen["casting"]
        minutes = elapsed(ctx).select("run_id", F.greatest(F.col("ms") / 60_000, F.lit(1 / 60)).alias("_m"))
        out["apm"] = c.filter("kind = 'press'").groupBy("run_id", "actor").agg(F.count("*").alias("n")).join(minutes, "run_id").select("run_id", "actor", (F.col("n") / F.col("_m")).alias("value"))
        g = c.filter("kind = 'bar'").groupBy("run_id", "actor").agg(F.count("*").alias("n"), F.count_if(F.expr("NOT finished AND NOT kicked AND NOT died")).alias("lost"))
        out["commitment"] = g.select("run_id", "actor", F.when(F.col("n") >= COMMITMENT_BARS, F.col("lost") / F.col("n")).otherwise(0.0).alias("value"))
    if has("casting", "hits", "deaths"):
        died = seen["casting"].filter("died").select("run_id", "actor", "start", "end")
        hit = seen["hits"].filter("fatal").select("run_id", "actor", "ts", "row")
        out["rather-die"] = times_of(hit.join(died, ["run_id", "actor"]).filter("start <= ts AND ts <= end").select("run_id", "actor", "row").distinct())
    return out
