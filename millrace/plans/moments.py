"""Moments of a run (falls, kills, assists, links, infusions), who began a pull, and badges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window as W

from millrace.functions.text import fnv1a32
from millrace.operators import asof, attribution, pairing, ranking, sessions
from millrace.plans.reports import AURA_UP, DAMAGE_CODES, TANK_SPECS, Context, checked_small, elapsed
from millrace.sources import log

TWINS_MS, CONTACT_FROM_MS, CONTACT_TO_MS, PULLED_BY_MS, MAX_CONTACTS, ENCOUNTER_MS, CLOSE_MS = 250, -1_000, 5_000, 300, 8, 10_000, 250
PROC_MS, CONSUMABLE_MS, CONSUMABLE_CAST_MS, LUST_MS, PICK_MS = 500, 30_000, 1_000, 1_000, 1_500
MELD_HELD_MS, MELD_DEATH_MS, CAST_LOOKBACK_MS, STOOD_MS, SUMMONED_MS, MAX_NEAREST = 5_000, 10_000, 5_000, 5_000, 3_000, 3
SHADOWMELD, ANKH = 58984, 21169  # fixed values: spells
MAX_BADGES, MAX_ROASTS = 6, 2


def _in(codes) -> Column:
    return F.col("code").isin(*codes)


def falls(ctx: Context) -> DataFrame:
    """Falls of players; fatal with overkill."""
    return ctx.events.filter("code = 'ENVIRONMENTAL_DAMAGE' AND lower(environment) = 'falling' AND dst_ours AND dst = dst_root").select("run_id", F.col("dst").alias("actor"), "ts", "row", "amount", (F.coalesce("waste", F.lit(-1)) > 0).alias("fatal"))


def totem_kills(ctx: Context) -> DataFrame:
    """Kills by the party of uncontrolled creatures named as totems, each once."""
    kills = ctx.events.filter("code = 'PARTY_KILL' AND src_ours").filter(F.col("dst_name").rlike(" Totem$") & (F.col("dst_flags").bitwiseAND(log.PLAYER_CONTROLLED) == 0))
    return kills.groupBy("run_id", "dst").agg(F.min_by("src_root", "row").alias("actor"), F.min("ts").alias("ts"))


def biggest_hits(ctx: Context) -> DataFrame:
    """Each member's biggest gross hit on an enemy, the first on ties."""
    hits = ctx.events.filter(_in(DAMAGE_CODES) & F.col("src_ours") & ~F.col("dst_ours") & ~F.col("support"))
    return ranking.arg_best(hits, ["run_id", "src_root"], F.struct("row", "spell_id", "dst"), F.col("amount"), F.col("row"))


def listed_moments(ctx: Context, dim: DataFrame) -> DataFrame:
    """Casts of listed abilities by the party. ``dim`` has spell_id and moment (a kind such as taunt, external, immunity)."""
    casts = ctx.events.filter("code = 'SPELL_CAST_SUCCESS' AND src_ours").join(checked_small(dim), "spell_id")
    return casts.select("run_id", F.col("src_root").alias("actor"), F.col("dst").alias("target"), "spell_id", "moment", "ts", "row")


def landed(casts: DataFrame, ctx: Context, within: int) -> DataFrame:
    """Casts whose state lands on someone within ``within`` on either side."""
    auras = ctx.events.filter(_in(AURA_UP)).select("run_id", "spell_id", "ts", F.col("row"))
    return casts.join(pairing.without_near(casts, auras, ["run_id", "spell_id"], "ts", "row", within).select("row"), "row", "left_anti")


def self_only(casts: DataFrame, within: int = TWINS_MS) -> DataFrame:
    """Casts on oneself without a cast of the same spell on another around."""
    own, others = casts.filter("actor = target"), casts.filter("actor <> target")
    return pairing.without_near(own, others, ["run_id", "actor", "spell_id"], "ts", "row", within)


def shared_damage(ctx: Context, spell: int) -> DataFrame:
    """Per owner: what an ability took and gave, in bars of the average health of those it reached."""
    rows = ctx.events.filter((F.col("spell_id") == spell) & _in((*DAMAGE_CODES, *log.HEAL)))
    g = rows.groupBy("run_id", "src_root").agg(F.sum(attribution.effective(F.col("amount"), F.coalesce("waste", F.lit(-1)))).alias("amount"), F.avg("hp_max").alias("bar"))
    return g.withColumn("bars", F.when(F.col("bar") > 0, F.col("amount") / F.col("bar")).otherwise(0.0))


def healing_on_others(ctx: Context) -> DataFrame:
    """Gross healing and overhealing of members on other members."""
    rows = ctx.events.filter(_in(log.HEAL) & F.col("src_ours") & F.col("dst_ours") & (F.col("src_root") != F.col("dst_root")) & ~F.col("support"))
    return rows.groupBy("run_id", F.col("src_root").alias("actor")).agg(F.sum("amount").alias("healing"), F.sum(F.greatest(F.coalesce("waste", F.lit(0)), F.lit(0))).alias("overhealing"))


def consumable_uses(ctx: Context, dim: DataFrame) -> DataFrame:
    """Uses of consumables (spell_id) with what they healed.

    A heal up to thirty seconds after the start of the last use belongs to it; a cast does so only up to a
    second after a use that began by its heal. Which row starts a use depends on the one before: a fold.
    """
    rows = ctx.events.filter((F.col("code") == "SPELL_CAST_SUCCESS") | _in(log.HEAL)).filter("src_ours AND NOT support").join(checked_small(dim), "spell_id", "left_semi")
    healed = F.when(_in(log.HEAL), attribution.effective(F.col("amount"), F.coalesce("waste", F.lit(-1)))).otherwise(0.0)
    over = F.when(_in(log.HEAL), F.greatest(F.coalesce("waste", F.lit(0)), F.lit(0))).otherwise(0)
    rows = rows.select("run_id", F.col("src_root").alias("actor"), "spell_id", "ts", "row", (F.col("code") == "SPELL_CAST_SUCCESS").alias("cast"), healed.cast("double").alias("healed"), over.cast("double").alias("over"))

    def step(now, row):
        since = row["ts"] - now["ts"] if now else None
        if now and ((row["cast"] and not now["cast"] and since <= CONSUMABLE_CAST_MS) or (not row["cast"] and since <= CONSUMABLE_MS)):
            now = now | {"cast": now["cast"] or row["cast"]}
        else:
            now = {"ts": row["ts"], "row": row["row"], "cast": row["cast"]}
        return now, [(row["run_id"], row["actor"], row["spell_id"], now["ts"], now["row"], row["healed"], row["over"])]

    told = pairing.folded(rows, ["run_id", "actor", "spell_id"], "ts", "row", CONSUMABLE_MS + 1, step, dict, "run_id string, actor string, spell_id long, ts long, row long, healed double, over double")
    return told.groupBy("run_id", "actor", "spell_id", "ts", "row").agg(F.sum("healed").alias("amount"), F.sum("over").alias("overhealing"))


def _proc_counts(ctx: Context, e: DataFrame) -> DataFrame:
    """(run_id, actor, spell_id, procs) of the states in ``e``.

    An application counts if it is the first or at least half a second after the one before, counted or
    not; one in the millisecond of a removal is a hand-over: it neither counts nor is measured from.
    """
    w = W.partitionBy("run_id", "src_root", "spell_id").orderBy("row")
    rows = e.filter(_in(("SPELL_AURA_APPLIED", "SPELL_AURA_REFRESH", "SPELL_AURA_APPLIED_DOSE", "SPELL_AURA_REMOVED", "SPELL_AURA_REMOVED_DOSE")) & F.col("src_ours"))
    rows = rows.withColumn("_off", _in(("SPELL_AURA_REMOVED", "SPELL_AURA_REMOVED_DOSE")))
    up_to = w.rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumns({"_removed": F.last(F.when(F.col("_off"), F.col("ts")), ignorenulls=True).over(up_to), "_before": F.max((~F.col("_off")).cast("int")).over(up_to)})
    # a removal before the first application is not known to the count
    on = rows.filter(~F.col("_off") & (F.coalesce("_before", F.lit(0)).eqNullSafe(0) | ~F.col("ts").eqNullSafe(F.col("_removed"))))
    gap = F.col("ts") - F.lag("ts").over(w)
    return on.withColumn("_g", gap).groupBy("run_id", F.col("src_root").alias("actor"), "spell_id").agg(F.sum((F.coalesce("_g", F.lit(PROC_MS)) >= PROC_MS).cast("long")).alias("procs"))


def procs(ctx: Context, spell: int) -> DataFrame:
    """(run_id, actor, procs): procs of one state on members, by whom they come from."""
    return _proc_counts(ctx, ctx.events.filter((F.col("spell_id") == spell) & F.col("dst_ours"))).drop("spell_id")


def procs_expected(ctx: Context, rates: DataFrame) -> DataFrame:
    """(run_id, actor, spell_id, procs, expected) of every member seen to have a listed proc. ``rates`` has run_id, actor, spell_id and per_minute."""
    e = ctx.events.join(rates.select("run_id", F.col("actor").alias("src_root"), "spell_id").distinct(), ["run_id", "src_root", "spell_id"], "left_semi")
    n = _proc_counts(ctx, e).join(rates, ["run_id", "actor", "spell_id"]).join(elapsed(ctx), "run_id")
    return n.withColumn("expected", F.col("per_minute") * F.col("ms") / 60_000).drop("per_minute", "ms")


def lusts(ctx: Context, dim: DataFrame) -> DataFrame:
    """Casts of listed party-wide hastes (spell_id) whose state landed on someone within a second on either side."""
    pressed = ctx.events.filter("code = 'SPELL_CAST_SUCCESS' AND src_ours").join(checked_small(dim), "spell_id", "left_semi").select("run_id", F.col("src_root").alias("actor"), "spell_id", "ts", "row")
    on = ctx.events.filter("code = 'SPELL_AURA_APPLIED' AND src_ours AND dst_ours").join(checked_small(dim), "spell_id", "left_semi").select("run_id", F.col("src_root").alias("actor"), "ts", "row")
    return pressed.join(pairing.without_near(pressed, on, ["run_id", "actor"], "ts", "row", LUST_MS).select("row"), "row", "left_anti")


def random_picks(ctx: Context, avoidable: DataFrame) -> DataFrame:
    """Enemy debuffs that pick a member at random: (run_id, actor, spell_id, ts, row) of each lone application.

    A debuff's applications under 1.5 s apart are one cast. It counts if it was cast three times or more,
    nine in ten casts hit one member alone, these were three members or more, at most two in five of them
    tanks, and its spell is not in ``avoidable`` (spell_id).
    """
    rows = ctx.events.filter("code = 'SPELL_AURA_APPLIED' AND NOT coalesce(buff, false) AND dst_ours AND NOT src_ours AND src IS NOT NULL AND dst = dst_root").join(checked_small(avoidable), "spell_id", "left_anti")
    rows = sessions.press_groups(rows.select("run_id", F.col("dst").alias("actor"), "spell_id", "ts", "row"), ["run_id", "spell_id"], "ts", "row", PICK_MS - 1)
    spec = ctx.party.select("run_id", F.col("guid").alias("actor"), F.coalesce(F.col("spec_id").isin(*TANK_SPECS), F.lit(False)).alias("tank"))
    cast = rows.join(spec, ["run_id", "actor"]).groupBy("run_id", "spell_id", "press").agg(F.countDistinct("actor").alias("n"), F.min_by(F.struct("actor", "tank", "ts", "row"), "row").alias("one"))
    lone = F.col("n") == 1
    fits = cast.groupBy("run_id", "spell_id").agg(F.count("*").alias("casts"), F.count_if(lone).alias("lone"), F.countDistinct(F.when(lone, F.col("one.actor"))).alias("targets"), F.count_if(lone & F.col("one.tank")).alias("tanks"))
    fits = fits.filter("casts >= 3 AND 10 * lone >= 9 * casts AND targets >= 3 AND 5 * tanks <= 2 * lone")
    return cast.filter(lone).join(fits.select("run_id", "spell_id"), ["run_id", "spell_id"], "left_semi").select("run_id", "one.actor", "spell_id", "one.ts", "one.row")


def debuff_tallies(ctx: Context) -> DataFrame:
    """(run_id, actor, debuffs, debuffs_applied): enemy debuffs taken and debuffs put on enemies."""
    rows = ctx.events.filter("code = 'SPELL_AURA_APPLIED' AND NOT coalesce(buff, false) AND src IS NOT NULL AND dst IS NOT NULL")
    took = rows.filter("NOT src_ours AND dst_ours AND dst = dst_root").groupBy("run_id", F.col("dst").alias("actor")).agg(F.count("*").alias("debuffs"))
    gave = rows.filter("src_ours AND NOT dst_ours").groupBy("run_id", F.col("src_root").alias("actor")).agg(F.count("*").alias("debuffs_applied"))
    return took.join(gave, ["run_id", "actor"], "full").na.fill(0, ["debuffs", "debuffs_applied"])


def unmarked_swings(ctx: Context) -> DataFrame:
    """(run_id, actor, swings): landed enemy melee on members by enemies without a live debuff on them: a running count that never falls below zero, by order of rows."""
    foe = ctx.events.filter("src IS NOT NULL AND NOT src_ours AND dst_ours AND dst = dst_root")
    mark = foe.filter(F.col("code").isin("SPELL_AURA_APPLIED", "SPELL_AURA_REMOVED") & ~F.coalesce("buff", F.lit(False))).withColumn("_d", F.when(F.col("code") == "SPELL_AURA_APPLIED", 1).otherwise(-1))
    hit = foe.filter("code = 'SWING_DAMAGE_LANDED'").withColumn("_d", F.lit(0))
    cols = ["run_id", "src", "dst", "row", "code", "_d"]
    count = asof.running_marks(mark.select(*cols).unionByName(hit.select(*cols)), ["run_id", "src", "dst"], "row", F.col("_d"))
    return count.filter("code = 'SWING_DAMAGE_LANDED' AND marks = 0").groupBy("run_id", F.col("dst").alias("actor")).agg(F.count("*").alias("swings"))


def padding(ctx: Context, of: DataFrame, worth: DataFrame) -> DataFrame:
    """(run_id, actor, padding): damage to enemies of pulls (not bosses) whose creature is worth nothing. ``worth`` has mode_id, npc_id, value; runs of other modes have no rows."""
    modes = ctx.runs.select("run_id", "mode_id")
    none = of.filter("segment LIKE 'pull:%'").join(modes, "run_id").join(worth.filter("value = 0").select("mode_id", "npc_id"), ["mode_id", "npc_id"], "left_semi").select("run_id", F.col("enemy").alias("dst"))
    hits = ctx.events.filter(_in(DAMAGE_CODES) & F.col("src_ours") & ~F.col("support")).join(none, ["run_id", "dst"], "left_semi")
    return hits.groupBy("run_id", F.col("src_root").alias("actor")).agg(F.sum(attribution.effective(F.col("amount"), F.coalesce("waste", F.lit(-1)))).alias("padding"))


def self_damage(ctx: Context, spell: int) -> DataFrame:
    """(run_id, actor, amount, bars): what an ability cost its user, absorbed part included, in all and in bars of their health."""
    rows = ctx.events.filter((F.col("spell_id") == spell) & _in(DAMAGE_CODES) & F.col("src_ours") & (F.col("src") == F.col("dst")) & ~F.col("support"))
    all_ = F.col("amount") + F.coalesce("absorbed", F.lit(0))
    return rows.groupBy("run_id", F.col("dst").alias("actor")).agg(F.sum(all_).alias("amount"), F.sum(F.when(F.col("hp_max") > 0, all_ / F.col("hp_max"))).alias("bars"))


def drains(ctx: Context, spans: DataFrame) -> DataFrame:
    """(run_id, segment, actor, mana): each member's last known mana at each segment's end. ``spans`` are the segments."""
    known = ctx.events.filter("mana IS NOT NULL").join(ctx.party.select("run_id", F.col("guid").alias("subject")), ["run_id", "subject"], "left_semi").select("run_id", F.col("subject").alias("actor"), "ts", "mana")
    ends = spans.filter("end IS NOT NULL").select("run_id", "segment", F.col("end").alias("ts")).join(ctx.party.select("run_id", F.col("guid").alias("actor")), "run_id")
    return asof.asof_last(ends, known, ["run_id", "actor"], "ts", ["mana"]).filter("mana IS NOT NULL").select("run_id", "segment", "actor", "mana", "ts")


def last_stands(ctx: Context, spans: DataFrame) -> DataFrame:
    """(run_id, segment, actor, ts): the only member alive when a boss fell, in parties of two or more.

    A member is dead from a death (not feigned) to a resurrection, a reincarnation or, later than that
    millisecond, any row that shows them with health. ``spans`` are the segments with ``success``.
    """
    member = ctx.party.select("run_id", F.col("guid").alias("actor"))
    e = ctx.events
    died = e.filter("code = 'UNIT_DIED' AND NOT feigned").select("run_id", F.col("dst").alias("actor"), "ts", "row", F.lit(True).alias("dead"))
    rose = e.filter("code = 'SPELL_RESURRECT'").select("run_id", F.col("dst").alias("actor"), "ts", "row")
    rose = rose.unionByName(e.filter((F.col("code") == "SPELL_CAST_SUCCESS") & (F.col("spell_id") == ANKH)).select("run_id", F.col("src").alias("actor"), "ts", "row")).withColumn("dead", F.lit(False))
    shown = e.filter("hp > 0 AND subject IS NOT NULL").select("run_id", F.col("subject").alias("actor"), "ts", "row")
    w = W.partitionBy("run_id", "actor").orderBy("row").rowsBetween(W.unboundedPreceding, -1)
    told = died.unionByName(rose).withColumn("_t", F.col("ts")).unionByName(shown, allowMissingColumns=True).join(member, ["run_id", "actor"], "left_semi")
    last = F.last(F.when(F.col("dead"), F.col("ts")), ignorenulls=True).over(w)
    told = told.withColumn("_last", last).filter("dead IS NOT NULL OR ts > _last").withColumn("dead", F.coalesce("dead", F.lit(False))).select("run_id", "actor", "ts", "row", "dead")
    ends = spans.filter("boss AND success").select("run_id", "segment", F.col("end").alias("ts")).join(member, "run_id")
    state = asof.asof_last(ends, told.withColumn("_r", F.col("row")), ["run_id", "actor"], "ts", ["_r", "dead"])
    n = state.groupBy("run_id", "segment", "ts").agg(F.count("*").alias("party"), F.count_if(~F.coalesce("dead", F.lit(False))).alias("alive"), F.max(F.when(~F.coalesce("dead", F.lit(False)), F.col("actor"))).alias("actor"))
    return n.filter("party >= 2 AND alive = 1").select("run_id", "segment", "actor", "ts")


def meld_deaths(ctx: Context, attacks: tuple[str, ...] = (*DAMAGE_CODES, *log.MISS)) -> DataFrame:
    """(run_id, actor, victim, enemy, ts, died): a member vanished, an enemy that had been on them turned on another, who died.

    The enemy's last attack before, at most five seconds old, was on the one who vanished; after that it
    went at the victim and did not come back before the death, within ten seconds. The latest such meld has it.
    """
    e, member = ctx.events, ctx.party.select("run_id", F.col("guid").alias("dst"))
    blow = e.filter(_in(attacks) & F.col("src").isNotNull() & ~F.col("src_ours")).join(member, ["run_id", "dst"], "left_semi").select("run_id", F.col("src").alias("enemy"), "dst", "ts", "row")
    meld = e.filter((F.col("code") == "SPELL_CAST_SUCCESS") & (F.col("spell_id") == SHADOWMELD)).join(member.withColumnRenamed("dst", "src"), ["run_id", "src"], "left_semi").select("run_id", F.col("src").alias("actor"), "ts", "row")
    # each enemy that was on the melder: its latest attack before the meld, of those in the five seconds before
    near = pairing.near(meld, blow, ["run_id"], "ts", MELD_HELD_MS, 0).filter("b.row < a.row")
    held = near.groupBy(F.col("a.run_id").alias("run_id"), F.col("a.actor").alias("actor"), F.col("a.ts").alias("ts"), F.col("a.row").alias("meld"), F.col("b.enemy").alias("enemy")).agg(F.max_by("b.dst", "b.row").alias("on")).filter("on = actor").drop("on")
    after = pairing.near(held.withColumnRenamed("meld", "row"), blow, ["run_id", "enemy"], "ts", 0, MELD_DEATH_MS).filter("b.row > a.row")
    turn = after.select(*(F.col(f"a.{c}").alias(c) for c in ("run_id", "actor", "enemy", "ts")), F.col("a.row").alias("meld"), F.col("b.dst").alias("victim"), F.col("b.ts").alias("at"), F.col("b.row").alias("hit"))
    back = turn.filter("victim = actor").groupBy("run_id", "meld", "enemy").agg(F.min("hit").alias("_back"))
    turn = turn.filter("victim <> actor AND at > ts").join(back, ["run_id", "meld", "enemy"], "left")
    died = e.filter("code = 'UNIT_DIED' AND NOT feigned").select("run_id", F.col("dst").alias("victim"), F.col("ts").alias("died"), F.col("row").alias("death"))
    out = turn.join(died, ["run_id", "victim"]).filter((F.col("hit") < F.col("death")) & (F.col("died") - F.col("ts") <= MELD_DEATH_MS) & (F.col("_back").isNull() | (F.col("_back") > F.col("death"))))
    return out.groupBy("run_id", "victim", "death").agg(F.max_by(F.struct("actor", "enemy", "ts", "died"), F.struct("meld", "hit")).alias("x")).select("run_id", "victim", "x.*")


def listed_by_victim(ctx: Context, dim: DataFrame) -> DataFrame:
    """Moments read off what befell a member: (run_id, actor, spell_id, moment, ts, row). ``dim`` has spell_id and moment.

    cheat and gateway: the state went on them; defensive: they put it on themselves; immunity: their own
    came off; any interrupt by an enemy is a lockout (of the spell that was cast) and any reflected spell a reflect.
    """
    e, member = ctx.events, ctx.party.select("run_id", F.col("guid").alias("dst"))
    on = e.join(member, ["run_id", "dst"], "left_semi")
    told = on.filter(F.col("code").isin("SPELL_AURA_APPLIED", "SPELL_AURA_REMOVED")).join(checked_small(dim.select("spell_id", "moment")), "spell_id")
    own, applied = F.col("src") == F.col("dst"), F.col("code") == "SPELL_AURA_APPLIED"
    fits = F.when(F.col("moment").isin("cheat", "gateway"), applied).when(F.col("moment") == "defensive", applied & own).when(F.col("moment") == "immunity", ~applied & own).otherwise(False)
    cols = ["run_id", F.col("dst").alias("actor"), "spell_id", "moment", "ts", "row"]
    foe = on.filter("src IS NOT NULL AND NOT src_ours")
    locked = foe.filter("code = 'SPELL_INTERRUPT'").withColumns({"moment": F.lit("lockout"), "spell_id": F.col("extra_spell_id")})
    sent_back = foe.filter("code = 'SPELL_MISSED' AND miss = 'REFLECT'").withColumn("moment", F.lit("reflect"))
    return told.filter(fits).select(*cols).unionByName(locked.select(*cols)).unionByName(sent_back.select(*cols))


NO_AGGRO = (257284,)  # fixed value: the hunter's mark, put on before a pull


def who_pulled(ctx: Context, before: DataFrame) -> DataFrame:
    """Raid pulls: each player's first contact with the encounter's enemies around the start, in order, and who began it.

    ``before`` has the events before the pulls (negative ts) with src_root and dst_root. Enemies are
    those that traded blows in the first ten seconds. Support rows double a row and are no contact; nor is
    a buff, or a debuff that is put on before the pull and draws no one.
    """
    raids = ctx.runs.filter("kind = 'raid'").select("run_id")
    own = ctx.events.join(raids, "run_id", "left_semi")
    party = ctx.party.select("run_id", F.col("guid").alias("actor"))
    blow = own.filter(_in(DAMAGE_CODES) & (F.col("src_ours") != F.col("dst_ours")) & (F.col("ts") <= ENCOUNTER_MS))
    enemies = blow.select("run_id", F.when(F.col("src_ours"), F.col("dst")).otherwise(F.col("src")).alias("enemy")).distinct()
    cols = ["run_id", "ts", "row", "code", "support", "buff", "src_root", "dst", "src", "dst_root", "spell_id"]
    rows = own.select(*cols).unionByName(before.select(*cols)).filter(f"ts BETWEEN {CONTACT_FROM_MS} AND {CONTACT_TO_MS} AND NOT support")
    landed = _in((*DAMAGE_CODES, *log.MISS))
    touch = landed | ((F.col("code") == "SPELL_AURA_APPLIED") & ~F.coalesce("buff", F.lit(False)) & ~F.col("spell_id").isin(*NO_AGGRO))
    out = rows.filter(touch).select("run_id", "ts", "row", "spell_id", F.col("src_root").alias("actor"), F.col("dst").alias("enemy"), F.when(F.col("code") == "SPELL_AURA_APPLIED", "debuff").otherwise("hit").alias("kind"))
    body = rows.filter(touch).select("run_id", "ts", "row", "spell_id", F.col("dst_root").alias("actor"), F.col("src").alias("enemy"), F.lit("body").alias("kind"))
    met = out.unionByName(body).join(enemies, ["run_id", "enemy"], "left_semi").join(party, ["run_id", "actor"], "left_semi")
    first = met.withColumn("_n", F.row_number().over(W.partitionBy("run_id", "actor").orderBy("ts", "row"))).filter("_n = 1").drop("_n")
    tanks = ctx.party.select("run_id", F.col("guid").alias("actor"), F.coalesce(F.col("spec_id").isin(*TANK_SPECS), F.lit(False)).alias("tank"))
    first = first.join(tanks, ["run_id", "actor"])
    w = W.partitionBy("run_id").orderBy("ts", "row")
    ranked = first.withColumns({"place": F.row_number().over(w), "_next": F.lead("ts").over(w)}).filter(F.col("place") <= MAX_CONTACTS)
    began = (F.col("place") == 1) & (F.col("ts") <= PULLED_BY_MS)
    return ranked.withColumns({"pulled": began, "sure": began & (F.coalesce("_next", F.lit(2**31)) - F.col("ts") >= CLOSE_MS)}).drop("_next")


def cast_times(contacts: DataFrame, casts: DataFrame) -> DataFrame:
    """``contacts`` (run_id, actor, spell_id, ts, row) with ``pressed``: the latest landing of that spell by the player at most five seconds before, or its start if it had one; null if none.

    ``casts`` has the code, src, spell_id, ts and row of the pull's and the earlier rows.
    """
    rows = casts.filter(F.col("code").isin("SPELL_CAST_START", "SPELL_CAST_SUCCESS")).select("run_id", F.col("src").alias("actor"), "spell_id", "ts", "row", (F.col("code") == "SPELL_CAST_START").alias("begun"))
    near = pairing.near(contacts, rows, ["run_id", "actor", "spell_id"], "ts", CAST_LOOKBACK_MS, 0)
    g = near.groupBy(F.col("a.row").alias("row")).agg(F.max(F.when(F.col("b.begun"), F.col("b.ts"))).alias("_start"), F.max(F.when(~F.col("b.begun"), F.col("b.ts"))).alias("_done"))
    pressed = F.when(F.col("_start") <= F.col("_done"), F.col("_start")).otherwise(F.col("_done"))
    return contacts.join(g, "row", "left").withColumn("pressed", pressed).drop("_start", "_done")


def redirects(pulled: DataFrame, before: DataFrame, dim: DataFrame) -> DataFrame:
    """(run_id, actor, spell_id, onto, ts): the last listed redirect (spell_id) of whoever began the pull, before it."""
    who = pulled.filter("pulled").select("run_id", F.col("actor").alias("src"))
    rows = before.filter("code = 'SPELL_CAST_SUCCESS'").join(checked_small(dim), "spell_id", "left_semi").join(who, ["run_id", "src"], "left_semi")
    return rows.groupBy("run_id", F.col("src").alias("actor")).agg(F.max_by(F.struct("spell_id", F.col("dst").alias("onto"), "ts"), "row").alias("x")).select("run_id", "actor", "x.*")


def standing_nearest(ctx: Context, before: DataFrame, enemies: DataFrame) -> DataFrame:
    """(run_id, actor, enemy, distance, place): the three members who stood nearest the pull's enemies when it began.

    A member's spot is the last one of the five seconds before; an enemy's the one nearest the start on
    either side, up to five seconds after. ``enemies`` has run_id and enemy: a handful a run.
    """
    cols = ["run_id", "subject", "ts", "row", "x", "y", "map"]
    rows = before.filter(f"ts >= -{STOOD_MS}").select(*cols).unionByName(ctx.events.filter(f"ts BETWEEN 0 AND {STOOD_MS}").select(*cols)).filter("map > 0")
    spot = F.struct("x", "y", "map")
    mine = rows.join(ctx.party.select("run_id", F.col("guid").alias("subject")), ["run_id", "subject"], "left_semi").filter("ts <= 0").groupBy("run_id", F.col("subject").alias("actor")).agg(F.max_by(spot, F.struct("ts", "row")).alias("p"))
    foe = rows.join(enemies.select("run_id", F.col("enemy").alias("subject")), ["run_id", "subject"], "left_semi").groupBy("run_id", F.col("subject").alias("enemy")).agg(F.min_by(spot, F.struct(F.abs("ts"), "row")).alias("q"))
    far = F.hypot(F.col("q.x") - F.col("p.x"), F.col("q.y") - F.col("p.y"))
    pair = mine.join(foe, "run_id").filter("p.map = q.map").select("run_id", "actor", "enemy", far.alias("distance"))
    best = pair.groupBy("run_id", "actor").agg(F.min_by(F.struct("enemy", "distance"), F.struct("distance", "enemy")).alias("b")).select("run_id", "actor", "b.*")
    return best.withColumn("place", F.row_number().over(W.partitionBy("run_id").orderBy("distance", "actor"))).filter(F.col("place") <= MAX_NEAREST)


def early_summons(ctx: Context, before: DataFrame, pulled: DataFrame) -> DataFrame:
    """(run_id, actor, spell_id, unit, ts, placed, place): members' summons of the three seconds before a pull that nobody touched first, totems first, then the latest; one a member and spell."""
    untouched = ctx.runs.filter("kind = 'raid'").select("run_id").join(pulled.filter("pulled").select("run_id"), "run_id", "left_anti")
    rows = before.filter((F.col("code") == "SPELL_SUMMON") & (F.col("ts") >= -SUMMONED_MS)).join(untouched, "run_id", "left_semi").join(ctx.party.select("run_id", F.col("guid").alias("src_root")), ["run_id", "src_root"], "left_semi")
    last = rows.groupBy("run_id", F.col("src_root").alias("actor"), "spell_id").agg(F.max_by(F.struct(F.col("dst").alias("unit"), "ts", "row", F.col("dst_name").contains("Totem").alias("placed")), "row").alias("x")).select("run_id", "actor", "spell_id", "x.*")
    return last.withColumn("place", F.row_number().over(W.partitionBy("run_id").orderBy(F.desc("placed"), F.desc("row")))).drop("row")


def badges(values: DataFrame, metrics: DataFrame) -> DataFrame:
    """(run_id, key, kind, actor, value, runaway): holders of each badge.

    ``values`` is long: run_id, key, actor, value. ``metrics`` has key, kind (roast or glory), best
    (most or fewest) and least (smallest value that counts, or null). One window pass ranks all. With
    columns times and gap_min, ``runaway`` tells whether a lone holder is so many times the runner-up.
    """
    v = values.join(checked_small(metrics), "key")
    w = W.partitionBy("run_id", "key")
    most = F.col("best") == "most"
    top = F.when(most, F.max("value").over(w)).otherwise(F.min("value").over(w))
    rank = F.row_number().over(w.orderBy(F.when(most, -F.col("value")).otherwise(F.col("value")), "actor"))
    held = v.withColumns({"_top": top, "_size": F.count("*").over(w), "_r": rank}).withColumn("_next", F.max(F.when(F.col("_r") == 2, F.col("value"))).over(w))
    held = held.filter("value = _top AND _size >= 2 AND (best = 'fewest' OR value > 0) AND (least IS NULL OR value >= least)")
    held = held.withColumn("_ties", F.count("*").over(w)).filter("2 * _ties <= _size")
    ahead = F.lit(False)
    if {"times", "gap_min"} <= set(metrics.columns):
        big, small = F.greatest("value", "_next"), F.least("value", "_next")
        ahead = F.coalesce((F.col("_ties") == 1) & (big >= F.col("times") * small) & (F.col("value") >= F.coalesce("gap_min", F.lit(0.0))), F.lit(False))
    return held.withColumn("runaway", ahead).select("run_id", "key", "kind", "actor", "value", "runaway")


def drawn(held: DataFrame, most: int = MAX_BADGES, roasts: int = MAX_ROASTS) -> DataFrame:
    """At most so many badges of a run, few of them roasts, in a fixed order hashed from run and badge; winners are spread:
    badges whose holders have none yet in that order come before those of members who do."""
    draw = fnv1a32(F.concat_ws(":", "run_id", "key"))
    one = held.groupBy("run_id", "key", "kind").agg(F.array_sort(F.collect_set("actor")).alias("actors")).withColumn("_d", draw)
    rank = lambda *by: F.row_number().over(W.partitionBy("run_id", *by[0]).orderBy(*by[1]))
    again = one.withColumn("_turn", rank(["actors"], ["_d", "key"]))  # a member's first badge, second badge, ...
    order = ["_turn", "_d", "key"]
    some = again.withColumn("_k", rank(["kind"], order)).filter((F.col("kind") != "roast") | (F.col("_k") <= roasts))
    return some.withColumn("place", rank([], order)).filter(F.col("place") <= most).drop("_d", "_k", "_turn")
