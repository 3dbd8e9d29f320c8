"""Reports over the events of runs: segments, breakdowns, interrupts, control, dispels, deaths, auras, positions.

``Context`` holds the tables of a set of runs; every report is a function of it that returns
DataFrames, lazily. Events are hashed by run once, and window functions order by row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window as W

from millrace.functions.text import ability_name
from millrace.operators import asof, attribution, intervals, pairing, pieces, ranking, sessions
from millrace.plans import runs as run_plan
from millrace.session import discard, scratch, stored
from millrace.sources import decoder, log

#: The code sets of the reports.
DAMAGE_CODES = ("SPELL_DAMAGE", "SPELL_PERIODIC_DAMAGE", "SPELL_BUILDING_DAMAGE", "RANGE_DAMAGE", "SWING_DAMAGE", "DAMAGE_SHIELD", "DAMAGE_SPLIT")
AURA_UP = ("SPELL_AURA_APPLIED", "SPELL_AURA_REFRESH", "SPELL_AURA_APPLIED_DOSE", "SPELL_AURA_REMOVED_DOSE")
AURA_DOWN = ("SPELL_AURA_REMOVED", "SPELL_AURA_BROKEN", "SPELL_AURA_BROKEN_SPELL")
ENEMY_KINDS = ("Creature", "Vehicle", "Pet")
ACTIVE_GAP_MS, PULL_GAP_MS, BOSS_GRACE_MS, BOSS_HEALTH, HEALTH_FLOOR = 10_000, 5_000, 30_000, 0.5, 1
SLACK_MS, PAIR_MS, AIM_MS, DUPLICATE_MS, UNENDED_CAST_MS = 100, 1_000, 1_000, 50, 10_000
CONTROL_PRESS_MS, DISPEL_PRESS_MS, LOOKBACK_MS, SCROLLBACK_MS, THIN_MS = 1_000, 100, 10_000, 30_000, 250
FIGHT_MS = 600_000  # a stretch in which fights and enemies meet
POSITION_GAP_MS, TELEPORT_YARDS, TELEPORT_SPEED = 2_000, 50.0, 30.0
SUMMONED_FLAGS, MISS_MS, KNOCKBACK = 0x3000, 200, 0x100
TANK_SPECS = (250, 581, 104, 268, 66, 73)
DEFERRED_ABSORBS = (115069,)
SUPPORT_MS, CARRIER_ROWS, ORPHAN_MS = 2, 8, 100


SMALL_ROWS = 500_000  # of a dimension: up to so many are broadcast


def checked_small(dim: DataFrame) -> DataFrame:
    """``dim`` with a broadcast hint if it has few rows (they are counted), as it is otherwise."""
    return F.broadcast(dim) if dim.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS else dim


@dataclass
class Context:
    """Tables of one set of runs; ``events`` has run_id, ts, src_root, dst_root, src_ours and dst_ours.

    ``row`` orders a file's rows and tells rows apart over all files (see ``decoder.settled``).
    """

    events: DataFrame
    runs: DataFrame
    party: DataFrame
    actors: DataFrame
    spells: DataFrame
    controls: DataFrame


def supported(events: DataFrame) -> DataFrame:
    """Support rows tied to the row they double: plain rows get the supporter, support rows their carrier's spell.

    A support row's twin is the row before, or the one before that if an absorb that is no twin stands
    between: same sides and spell, at most 2 ms earlier, equal amount. Its carrier is the nearest plain
    row of the same sides among the eight before.
    """
    w = W.partitionBy("file_id", pieces.BLOCK).orderBy("row")
    same = ("src", "dst", "spell_id", "amount")
    ahead = F.struct(*same, "wall_ms", "support", "supporter", "code")
    e = pieces.with_halo(events, ["file_id"], "row", CARRIER_ROWS, 2).withColumns({"_1": F.lead(ahead, 1).over(w), "_2": F.lead(ahead, 2).over(w)})

    def doubles(later: str, ms: Column, fields) -> Column:
        """Whether the row ``later`` ahead is the support row of one with these fields."""
        alike = [F.col(f"{later}.{c}") == x for c, x in zip(same, fields, strict=True)]
        out = F.col(f"{later}.support") & (F.col(f"{later}.wall_ms") - ms <= SUPPORT_MS)
        for x in alike:
            out = out & x
        return F.coalesce(out, F.lit(False))

    near = doubles("_1", F.col("wall_ms"), [F.col(c) for c in same])
    between = (F.col("_1.code") == "SPELL_ABSORBED") & ~doubles("_2", F.col("_1.wall_ms"), [F.col(f"_1.{c}") for c in same])
    far = between & doubles("_2", F.col("wall_ms"), [F.col(c) for c in same]) & (F.col("amount") == 0)
    claimed = F.when(~F.col("support") & near, F.col("_1.supporter")).when(~F.col("support") & far, F.col("_2.supporter"))
    plain = F.last(F.when(~F.col("support"), F.struct("src", "dst", "wall_ms", "spell_id")), ignorenulls=True).over(w.rowsBetween(-CARRIER_ROWS, -1))
    e = e.withColumns({"_claimed": claimed, "_c": plain}).filter(~F.col(pieces.HALO)).drop(pieces.HALO, pieces.BLOCK)
    carrier = F.col("support") & (F.col("_c.src") == F.col("src")) & (F.col("_c.dst") == F.col("dst")) & (F.col("wall_ms") - F.col("_c.wall_ms") <= SUPPORT_MS)
    return e.withColumns({"twinned": F.coalesce(F.col("_claimed").isNotNull(), F.lit(False)), "supporter": F.coalesce("_claimed", "supporter"), "extra_spell_id": F.when(carrier, F.col("_c.spell_id")).otherwise(F.col("extra_spell_id"))}).drop("_1", "_2", "_claimed", "_c")


def with_orphan_sources(events: DataFrame) -> DataFrame:
    """Absorbs without a source take that of the first later attack on the same target with the same spell within 100 ms."""
    soaked = events.filter("code = 'SPELL_ABSORBED' AND src IS NULL").select("file_id", F.col("dst").alias("t"), F.col("spell_id").alias("s"), "wall_ms", "row")
    attack = events.filter("src IS NOT NULL AND dst IS NOT NULL").filter(F.col("code").isin(*DAMAGE_CODES, *log.MISS)).select("file_id", F.col("dst").alias("t"), F.col("spell_id").alias("s"), "wall_ms", "row")
    # only attacks soon after such an absorb can tell its source: few rows reach the fold
    hit = pairing.near(soaked, attack, ["file_id", "t", "s"], "wall_ms", ORPHAN_MS, ORPHAN_MS).filter("b.row > a.row").select("b.row").distinct()
    claims = pairing.claimed_fifo(soaked, attack.join(hit, "row", "left_semi"), ["file_id", "t", "s"], "wall_ms", "row", ORPHAN_MS)
    who = claims.join(events.select(F.col("row").alias("offer"), F.col("src").alias("_src")), "offer").select(F.col("waiting").alias("row"), "_src")
    return events.join(who, "row", "left").withColumn("src", F.coalesce("src", "_src")).drop("_src")


def open_log(spark: SparkSession, lines: DataFrame | str | list[str], assumed_year: int = 2024, folder: str | None = None, raids: bool = True) -> Context:
    """Lines (file_id, row, line), or the log files at a path, to the tables of their runs, with or without raid pulls.

    Each stage is written below ``folder`` once, as the reports read it many times.
    """
    at = folder or scratch(spark)
    whole = isinstance(lines, DataFrame)
    source = decoder.lines_from_rows(lines) if whole else decoder.lines_of(spark, lines)
    met = stored(decoder.survey(source), at, "survey")
    places = stored(decoder.settled(met, numbered=whole), at, "places")
    told = stored(decoder.told_lines(met, places, assumed_year), at, "told")
    control, decoded = stored(log.controls(told), at, "controls"), stored(supported(with_orphan_sources(stored(decoder.decoded(source, places, assumed_year), at, "plain"))), at, "decoded")
    discard(spark, f"{at}/plain")
    run = run_plan.runs(control, told.groupBy("file_id").agg(F.max("wall_ms").alias("wall_ms")))
    run = stored(run if raids else run.filter("kind <> 'raid'"), at, "runs")
    actor = stored(log.actors(decoded), at, "actors")
    root = stored(log.owners(decoded, actor), at, "roots")
    member = stored(run_plan.party(control, run), at, "party")
    e = run_plan.in_runs(decoded, run)
    roots, ours = checked_small(root), checked_small(member.select("run_id", "guid"))
    for side in ("src", "dst"):
        e = e.join(roots.select("file_id", F.col("guid").alias(side), F.col("root").alias(f"{side}_root")), ["file_id", side], "left")
        e = e.join(ours.select("run_id", F.col("guid").alias(f"{side}_root"), F.lit(True).alias(f"{side}_ours")), ["run_id", f"{side}_root"], "left").withColumn(f"{side}_ours", F.coalesce(f"{side}_ours", F.lit(False)))
    return Context(stored(e, at, "events"), run, member, actor, stored(log.spells(decoded), at, "spells"), control)


def elapsed(ctx: Context) -> DataFrame:
    """(run_id, ms): the time that rates refer to: the run's length, else its last event's time, else the log's timer, else 0."""
    last = ctx.events.groupBy("run_id").agg(F.max("ts").alias("_last"))
    ms = F.coalesce(F.col("end_ms") - F.col("start_ms"), F.col("_last"), F.col("total_ms"), F.lit(0)).cast("long")
    return ctx.runs.join(last, "run_id", "left").select("run_id", ms.alias("ms"))


def _in(codes: tuple) -> Column:
    return F.col("code").isin(*codes)


def engagements(ctx: Context) -> DataFrame:
    """Damage between the party and enemies, with the enemy's side."""
    kinds = ctx.actors.select("file_id", F.col("guid").alias("enemy"), "kind", "npc_id", F.col("name").alias("enemy_name"))
    hits = ctx.events.filter(_in(DAMAGE_CODES) & (F.col("src_ours") != F.col("dst_ours"))).withColumn("enemy", F.when(F.col("src_ours"), F.col("dst")).otherwise(F.col("src")))
    return hits.join(kinds, ["file_id", "enemy"]).filter(F.col("kind").isin(*ENEMY_KINDS))


def segments(ctx: Context, gap: int = PULL_GAP_MS, grace: int = BOSS_GRACE_MS) -> tuple[DataFrame, DataFrame]:
    """(segments, enemies): overlapping pulls and boss fights, and the segment that each enemy belongs to.

    An enemy belongs to the boss window in which it was first engaged; others chain into pulls by the
    enemy of the trash hit before. Sturdy enemies of a pull engaged within the grace before a boss's
    end go over to the boss.
    """
    at = scratch(ctx.events.sparkSession)
    hits = engagements(ctx).select("run_id", "enemy", "ts", "row", "subject", "hp", "hp_max", "npc_id", "enemy_name", "x", "y")
    hits = stored(hits, at, "engagements")  # read by every step below
    own_hp = F.when(F.col("subject") == F.col("enemy"), F.col("hp_max"))
    enemy = hits.groupBy("run_id", "enemy").agg(
        F.min("ts").alias("first"), F.max(own_hp).alias("peak"), F.max_by("hp", F.when(F.col("subject") == F.col("enemy"), F.col("row"))).alias("last_hp"), F.first("npc_id").alias("npc_id"), F.first("enemy_name").alias("name")
    )
    boss = ctx.runs.select("run_id", "start_ms", F.posexplode("bosses").alias("boss", "b")).select("run_id", "boss", F.col("b.title").alias("title"), (F.col("b.start_ms") - F.col("start_ms")).alias("from"), (F.col("b.end_ms") - F.col("start_ms")).alias("to"))
    boss = boss.withColumn("to", F.coalesce("to", F.lit(2**53)))
    inside = _during(enemy, boss, 0).groupBy("run_id", "enemy").agg(F.min("boss").alias("boss"))
    trash = hits.join(inside, ["run_id", "enemy"], "left_anti")
    pull = attribution.counterpart_segments(trash, "run_id", "enemy", "ts", "row", gap)
    sturdy = _during(enemy, boss, grace)
    own_peak = enemy.join(inside, ["run_id", "enemy"]).groupBy("run_id", "boss").agg(F.max("peak").alias("boss_peak"))
    moved = sturdy.join(own_peak, ["run_id", "boss"]).filter(F.col("peak") >= BOSS_HEALTH * F.col("boss_peak")).groupBy("run_id", "enemy").agg(F.min("boss").alias("moved"))
    of = enemy.join(inside, ["run_id", "enemy"], "left").join(moved, ["run_id", "enemy"], "left").join(pull, ["run_id", "enemy"], "left").withColumn("boss", F.coalesce("boss", "moved"))
    died = ctx.events.filter("code IN ('UNIT_DIED', 'UNIT_DESTROYED') AND NOT coalesce(feigned, false)").select("run_id", F.col("dst").alias("enemy")).distinct().withColumn("died", F.lit(True))
    of = of.withColumn("segment", F.when(F.col("boss").isNotNull(), F.concat(F.lit("boss:"), F.col("boss").cast("string"))).otherwise(F.concat(F.lit("pull:"), F.col("segment"))))
    of = of.join(died, ["run_id", "enemy"], "left").withColumn("defeated", F.coalesce("died", F.lit(False)) | (F.coalesce("last_hp", F.lit(2)) <= HEALTH_FLOOR)).drop("died", "moved")
    of = stored(of, at, "enemies")
    span = hits.join(of.select("run_id", "enemy", "segment"), ["run_id", "enemy"]).groupBy("run_id", "segment").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"), F.avg(F.when(F.col("x") != 0, F.col("x"))).alias("x"), F.avg(F.when(F.col("y") != 0, F.col("y"))).alias("y"))
    named = boss.select("run_id", F.concat(F.lit("boss:"), F.col("boss").cast("string")).alias("segment"), "title", "from", F.when(F.col("to") < 2**53, F.col("to")).alias("to"))
    out = span.join(named, ["run_id", "segment"], "full").select("run_id", "segment", "title", F.least("lo", "from").alias("start"), F.greatest("hi", "to").alias("end"), F.col("segment").startswith("boss:").alias("boss"), "x", "y")
    out = stored(out, at, "segments")
    discard(ctx.events.sparkSession, f"{at}/engagements")  # spent: both results are written
    return out, of


def _during(enemy: DataFrame, boss: DataFrame, before: int) -> DataFrame:
    """Enemies with each boss fight of their run that they were first engaged in, or at most ``before`` earlier: joined on stretches of time, not on runs alone."""
    spans = boss.join(enemy.groupBy("run_id").agg(F.max("first").alias("_last")), "run_id").withColumn("_lo", F.col("from") - before)
    stretch = lambda c: F.floor(c / FIGHT_MS)
    spans = spans.withColumn("_b", F.explode(F.sequence(stretch(F.col("_lo")), stretch(F.greatest("_lo", F.least("to", "_last"))))))
    both = enemy.withColumn("_b", stretch(F.col("first"))).join(spans, ["run_id", "_b"]).filter("first >= _lo AND first <= to")
    return both.drop("_b", "_lo", "_last")


def summoned(ctx: Context) -> DataFrame:
    """(file_id, enemy) of units that were summoned by any sign: a summon of them, their kind, their last flags, an owner."""
    by_row = ctx.events.filter("code IN ('SPELL_SUMMON', 'SPELL_CREATE') AND dst IS NOT NULL").select("file_id", F.col("dst").alias("enemy"))
    by_kind = ctx.actors.filter((F.col("kind") == "Pet") | (F.col("flags").bitwiseAND(SUMMONED_FLAGS) != 0)).select("file_id", F.col("guid").alias("enemy"))
    owned = ctx.events.filter("subject IS NOT NULL AND owner IS NOT NULL").select("file_id", F.col("subject").alias("enemy"))
    return by_row.unionByName(by_kind).unionByName(owned).distinct()


def roster(of: DataFrame, summons: DataFrame | None = None, run: DataFrame | None = None) -> DataFrame:
    """Enemies of a segment pooled by creature id (else name): spawns, kills and health, the weightiest first, with the segment's label.

    With ``summons`` (and ``run``, for the runs' files) summoned creatures come last and name no segment
    unless there is nothing else; they still count in the label's "+n".
    """
    if summons is not None:
        of = of.join(run.select("run_id", "file_id"), "run_id").join(summons.withColumn("_summon", F.lit(True)), ["file_id", "enemy"], "left").drop("file_id")
    else:
        of = of.withColumn("_summon", F.lit(None).cast("boolean"))
    key = F.coalesce(F.concat(F.lit("#"), F.col("npc_id").cast("string")), F.concat(F.lit("@"), F.col("name")))
    g = of.groupBy("run_id", "segment", key.alias("creature")).agg(F.first("name").alias("name"), F.count("*").alias("spawns"), F.count_if("defeated").alias("killed"), F.max("peak").alias("max_hp"), F.coalesce(F.bool_or("_summon"), F.lit(False)).alias("summon"))
    weight = F.col("spawns") * F.greatest(F.coalesce("max_hp", F.lit(1)), F.lit(1))
    w = W.partitionBy("run_id", "segment")
    place = F.row_number().over(w.orderBy("summon", F.desc(weight), F.desc("spawns"), "name"))
    others = F.sum("spawns").over(w) - F.col("spawns")
    label = F.concat("name", F.when(F.col("spawns") > 1, F.concat(F.lit(" ×"), F.col("spawns").cast("string"))).otherwise(""), F.when(others > 0, F.concat(F.lit(" +"), others.cast("string"))).otherwise(""))
    return g.withColumns({"place": place, "label": F.when(place == 1, label)})


def forces(roster_: DataFrame, table_: DataFrame, run: DataFrame) -> DataFrame:
    """Progress per run: value times kills by creature, as a part of the mode's total. ``table_`` has mode_id, npc_id, value, total.

    A creature that the table lacks counts nothing; without a table for the mode the result is null.
    ``incomplete``: the run succeeded and its kills fall short all the same.
    """
    totals = table_.groupBy("mode_id").agg(F.max("total").alias("total"))
    kills = roster_.withColumn("npc_id", F.regexp_extract("creature", r"^#(\d+)", 1).try_cast("long")).join(run.select("run_id", "mode_id", "success"), "run_id")
    worth = kills.join(table_.select("mode_id", "npc_id", "value"), ["mode_id", "npc_id"], "left")
    g = worth.groupBy("run_id", "mode_id").agg(F.sum(F.coalesce("value", F.lit(0)) * F.col("killed")).alias("count"), F.first("success").alias("success"))
    short = F.coalesce(F.col("success") & (F.col("total") > 0) & (F.col("count") < F.col("total")), F.lit(False))
    return g.join(totals, "mode_id", "left").select("run_id", F.when(F.col("total").isNotNull(), F.col("count")).alias("count"), "total", F.when(F.col("total") > 0, F.col("count") / F.col("total")).alias("fraction"), short.alias("incomplete"))


def with_segment(rows: DataFrame, parts: tuple[DataFrame, DataFrame], enemy: Column | None = None, at: str = "ts", width: int = 60_000) -> DataFrame:
    """``rows`` (run_id, row, ``at``) with the segment of their enemy, else the one at their time, else null. ``parts`` is what ``segments`` returns."""
    spans, of = parts
    out = rows.withColumn("_enemy", F.lit(None).cast("string") if enemy is None else enemy)
    side = of.select("run_id", F.col("enemy").alias("_enemy"), F.col("segment").alias("_side"))
    out = out.join(side, ["run_id", "_enemy"], "left").drop("_enemy")
    bounds = spans.filter("start IS NOT NULL AND end IS NOT NULL").select("run_id", "segment", "start", "end", "boss")
    timed = intervals.segment_at(out, bounds, ["run_id"], at, width)
    return timed.withColumn("segment", F.coalesce("_side", "segment")).drop("_side")


def in_segment(rows: DataFrame, segment: str | None) -> DataFrame:
    """A report's rows of one segment, or all: every summary is a function of such rows, so that it counts anew."""
    return rows if segment is None else rows.filter(F.col("segment") == segment)


def _credited(e: DataFrame) -> DataFrame:
    """Rows with the actor credited: a twinned row's supporter, else the attributed source."""
    return e.withColumn("actor", F.when(F.col("twinned") & F.col("supporter").isNotNull(), F.col("supporter")).otherwise(F.col("src_root")))


def counted_rows(ctx: Context, direction: str) -> DataFrame:
    """Rows of a breakdown (``done``, ``taken`` or ``healing``) with actor, value, gross and waste."""
    e = ctx.events.filter(~F.col("support"))
    env = F.col("code") == "ENVIRONMENTAL_DAMAGE"
    soak = (F.col("code") == "SPELL_ABSORBED") & ~F.coalesce(F.col("extra_spell_id").isin(*DEFERRED_ABSORBS), F.lit(False))
    if direction == "done":
        rows = _credited(e.filter((_in(DAMAGE_CODES) | (F.col("code") == "SPELL_ABSORBED")) & F.col("src_ours") & ~F.col("dst_ours")))
    elif direction == "taken":
        rows = e.filter((_in(DAMAGE_CODES) & F.col("dst_ours") & ~F.col("src_ours")) | (env & F.col("dst_ours"))).withColumn("actor", F.col("dst_root"))
    else:
        heal = _in(log.HEAL) & F.col("src_ours")
        shield = soak & F.col("dst_ours") & F.col("caster").isNotNull()
        rows = e.filter(heal | shield).withColumn("actor", F.when(_in(log.HEAL), F.col("src_root")).otherwise(F.col("caster")))
        rows = rows.withColumn("spell_id", F.when(F.col("code") == "SPELL_ABSORBED", F.col("extra_spell_id")).otherwise(F.col("spell_id")))
        rows = rows.join(ctx.party.select("run_id", F.col("guid").alias("actor")), ["run_id", "actor"], "left_semi")
    waste = F.coalesce("waste", F.lit(-1))
    return rows.withColumns({"gross": F.col("amount"), "lost": waste, "value": attribution.effective(F.col("amount"), waste), "spell_id": F.coalesce("spell_id", F.lit(0))})


def breakdown(ctx: Context, direction: str = "done", segment: tuple | None = None, credit: bool = True) -> DataFrame:
    """Per run, actor and spell: totals, hits, rates over the run's elapsed time and the share.

    What supporters added to others' hits is moved to them (``done``, unless ``credit`` is false).
    ``segment`` is (segments, name): only rows of that segment's enemies.
    """
    rows = counted_rows(ctx, direction)
    if segment:
        (_, of), name = segment
        own = of.filter(F.col("segment") == name).select("run_id", F.col("enemy").alias("_e"))
        rows = rows.join(own, (rows["run_id"] == own["run_id"]) & ((rows["dst"] == own["_e"]) | (rows["src"] == own["_e"])), "left_semi")
    g = rows.groupBy("run_id", "actor", "spell_id").agg(
        F.sum("value").alias("total"), F.sum("gross").alias("raw"), F.sum(F.greatest("lost", F.lit(0))).alias("wasted"), F.count("*").alias("hits"), F.count_if("crit").alias("crits"),
        F.sum(F.when(F.col("crit"), F.col("value")).otherwise(0)).alias("crit_total"), F.max("value").alias("biggest"), F.count_if(F.col("code").contains("PERIODIC")).alias("ticks"),
    )
    if direction == "healing":
        dealt = ctx.events.filter(_in(DAMAGE_CODES) & F.col("src_ours") & F.col("dst_ours") & ~F.col("support")).groupBy("run_id", F.col("src_root").alias("actor"), "spell_id").agg(F.sum("amount").alias("dealt"))
        g = attribution.netted(g, dealt, ["run_id", "actor", "spell_id"], "total", "dealt").withColumn("total", F.col("net")).drop("net", "dealt")
    misses = ctx.events.filter(_in(log.MISS) & F.col("avoided") & ~F.col("support")).groupBy("run_id", F.col("src_root" if direction == "done" else "dst_root").alias("actor"), F.coalesce("spell_id", F.lit(0)).alias("spell_id")).agg(F.count("*").alias("misses"))
    casts = ctx.events.filter("code = 'SPELL_CAST_SUCCESS' AND src_ours AND src = src_root").groupBy("run_id", F.col("src").alias("actor"), "spell_id").agg(F.count("*").alias("casts"))
    if direction != "taken":
        g = g.join(casts, ["run_id", "actor", "spell_id"], "left")
    g = g.join(misses, ["run_id", "actor", "spell_id"], "left")
    if credit and direction == "done":
        g = with_credit(ctx, g)
    lasted = elapsed(ctx).select("run_id", (F.col("ms") / 1000).alias("seconds"))
    all_ = F.sum(F.greatest("total", F.lit(0))).over(W.partitionBy("run_id"))
    named = g.join(lasted, "run_id").withColumns({"per_second": F.when(F.col("seconds") > 0, F.col("total") / F.col("seconds")).otherwise(0.0), "share": F.when(all_ > 0, F.col("total") / all_).otherwise(0.0)}).drop("seconds")
    first = ctx.spells.groupBy("spell_id").agg(F.min_by("spell", "first_row").alias("spell"))
    return named.join(first, "spell_id", "left").withColumn("spell", F.when(F.col("spell_id") == 0, "Melee").otherwise(F.coalesce("spell", F.concat(F.lit("Spell "), F.col("spell_id").cast("string")))))


def by_ability(parts: DataFrame) -> DataFrame:
    """A breakdown with the spells of one ability together."""
    p = parts.withColumn("ability", ability_name(F.col("spell"))).withColumn("who", F.struct("run_id", "actor"))
    return attribution.merged_abilities(p, "who", "ability", "spell_id", "spell").select("who.*", "*").drop("who")


def active_time(ctx: Context, direction: str = "done") -> DataFrame:
    """Time between a member's counted rows at most ten seconds apart; for healing a shield that comes off counts as a row of its caster."""
    rows = counted_rows(ctx, direction).select("run_id", "actor", "ts", "row")
    if direction == "healing":
        off = ctx.events.filter(F.col("src_ours") & F.col("buff") & F.col("shield_off") & (F.col("code") == "SPELL_AURA_REMOVED"))
        rows = rows.unionByName(off.select("run_id", F.col("src_root").alias("actor"), "ts", "row"))
    return sessions.active_time(rows, ["run_id", "actor"], "ts", "row", ACTIVE_GAP_MS)


def support_rows(ctx: Context) -> DataFrame:
    """Support rows of damage by the party, each with its dealer and the spell that carried it."""
    rows = ctx.events.filter(F.col("support") & F.col("src_ours") & ~F.col("dst_ours") & F.col("supporter").isNotNull() & (_in(DAMAGE_CODES) | (F.col("code") == "SWING_DAMAGE_LANDED")))
    return rows.withColumns({"dealer": F.col("src_root"), "carrier": F.coalesce("extra_spell_id", F.lit(0)), "net": attribution.effective(F.col("amount"), F.coalesce("waste", F.lit(-1)))})


def support_transfer(ctx: Context) -> DataFrame:
    """What supporters take from the dealers' carrier rows, in order of first sight, up to what each holds."""
    crit = F.when(F.col("crit"), F.col("net")).otherwise(0)
    want = support_rows(ctx).groupBy("run_id", "dealer", "carrier", "supporter", "spell_id").agg(
        F.sum("net").alias("net"), F.sum("amount").alias("raw"), F.count("*").alias("hits"), F.count_if("crit").alias("crits"), F.sum(crit).alias("crit_total"), F.count_if(F.col("code").contains("PERIODIC")).alias("ticks"),
        F.max("net").alias("biggest"), F.min("row").alias("first"),
    )
    held = counted_rows(ctx, "done").groupBy("run_id", F.col("actor").alias("dealer"), F.col("spell_id").alias("carrier")).agg(F.sum("value").alias("cap"))
    return attribution.capped_transfer(want, held, ["run_id", "dealer", "carrier"], ["first"], "net", "cap").filter("moved > 0")


def support_given(ctx: Context) -> DataFrame:
    """(run_id, actor, given, received): support by and for each member, whether or not it could be moved."""
    rows = support_rows(ctx)
    given = rows.groupBy("run_id", F.col("supporter").alias("actor")).agg(F.sum("net").alias("given"))
    got = rows.groupBy("run_id", F.col("dealer").alias("actor")).agg(F.sum("net").alias("received"))
    return given.join(got, ["run_id", "actor"], "full").na.fill(0.0, ["given", "received"])


def with_credit(ctx: Context, parts: DataFrame) -> DataFrame:
    """A breakdown of damage done in which the moved support is the supporters'. Its sum stays; amounts move by their share, counts do not leave the dealer."""
    moved = support_transfer(ctx).withColumn("_share", F.col("moved") / F.col("net"))
    at = ["run_id", "actor", "spell_id"]
    out = moved.groupBy("run_id", F.col("dealer").alias("actor"), F.col("carrier").alias("spell_id")).agg(F.sum("moved").alias("_net"), F.sum(F.col("raw") * F.col("_share")).alias("_raw"))
    less = parts.join(out, at, "left").withColumns({"total": F.col("total") - F.coalesce("_net", F.lit(0)), "raw": F.col("raw") - F.coalesce("_raw", F.lit(0))}).drop("_net", "_raw")
    gain = moved.groupBy("run_id", F.col("supporter").alias("actor"), "spell_id").agg(
        F.sum("moved").alias("total"), F.sum(F.col("raw") * F.col("_share")).alias("raw"), F.sum("hits").alias("hits"), F.sum("crits").alias("crits"),
        F.sum(F.col("crit_total") * F.col("_share")).alias("crit_total"), F.max("biggest").alias("biggest"), F.sum("ticks").alias("ticks"),
    )
    both = less.unionByName(gain, allowMissingColumns=True)
    rest = [c for c in less.columns if c not in at]
    return both.groupBy(*at).agg(*((F.max(c) if c == "biggest" else F.sum(c)).alias(c) for c in rest))


def rates(parts: DataFrame, uptime: DataFrame | None = None) -> DataFrame:
    """A breakdown with averages per cast and hit, shares of crits and misses and, given ``uptime`` (run_id, actor, spell_id, up, seconds), of time."""
    over = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    out = parts.withColumns({"per_hit": over("total", "hits"), "crit_share": over("crits", "hits"), "miss_share": F.when(F.col("misses") + F.col("hits") > 0, F.col("misses") / (F.col("misses") + F.col("hits")))})
    out = out.withColumn("per_cast", over("total", "casts")) if "casts" in parts.columns else out
    if uptime is None:
        return out
    share = F.when(F.col("_s") > 0, F.col("up") / 1000 / F.col("_s"))
    return out.join(uptime.select("run_id", "actor", "spell_id", "up", F.col("seconds").alias("_s")), ["run_id", "actor", "spell_id"], "left").withColumn("up_share", share).drop("_s")


def top_sources(ctx: Context) -> DataFrame:
    """(run_id, actor, spell_id, source, total): who dealt most of each spell's damage taken, the earliest on ties."""
    rows = counted_rows(ctx, "taken").groupBy("run_id", "actor", "spell_id", F.col("src_root").alias("source")).agg(F.sum("value").alias("total"), F.min("row").alias("first"))
    return rows.groupBy("run_id", "actor", "spell_id").agg(F.max_by(F.struct("source", "total"), F.struct("total", -F.col("first"))).alias("top")).select("run_id", "actor", "spell_id", "top.source", "top.total")


def aura_uptime(ctx: Context) -> DataFrame:
    """Per caster and spell: time with the state on any target, to the run's end."""
    ends = ctx.runs.select("run_id", (F.col("end_ms") - F.col("start_ms")).alias("_end"))
    auras = ctx.events.filter((_in(AURA_UP) | _in(AURA_DOWN)) & F.col("src_ours")).join(ends, "run_id")
    edges = intervals.state_edges(auras, ["run_id", "src_root", "spell_id"], "dst", "row", _in(AURA_UP))
    return intervals.union_uptime(edges, ["run_id", "src_root", "spell_id"], "ts", "row", F.col("_end")).withColumnRenamed("src_root", "actor")


def aura_spans(ctx: Context) -> DataFrame:
    """Per wearer and spell: the merged spans of the state over all casters, openings included, open ones to the run's end.

    A removal without a known caster takes the one open copy off; among several it says nothing.
    """
    ends = ctx.runs.select("run_id", (F.col("end_ms") - F.col("start_ms")).alias("_end"))
    opening = run_plan.opening_auras(ctx.party).select("run_id", F.col("guid").alias("wearer"), "spell_id", F.col("caster"), F.lit(0).cast("long").alias("ts"), F.lit(-1).cast("long").alias("row"), F.lit(True).alias("up"))
    seen = ctx.events.filter(_in(AURA_UP) | _in(AURA_DOWN)).select("run_id", F.col("dst").alias("wearer"), "spell_id", F.coalesce("src", F.lit("")).alias("caster"), "ts", "row", _in(AURA_UP).alias("up"), (F.col("code") != "SPELL_AURA_APPLIED").alias("old"))
    first = F.row_number().over(W.partitionBy("run_id", "wearer", "spell_id").orderBy("row"))
    # a state first seen by its refresh or end was up from the start
    ghosts = seen.withColumn("_n", first).filter("_n = 1 AND old").select("run_id", "wearer", "spell_id", "caster", F.lit(0).cast("long").alias("ts"), F.lit(-2).cast("long").alias("row"), F.lit(True).alias("up"))
    every = seen.drop("old").unionByName(opening).unionByName(ghosts).join(ends, "run_id")
    named = intervals.with_sole_copies(every, ["run_id", "wearer", "spell_id"], "caster", "row", F.col("up"))
    edges = intervals.state_edges(named, ["run_id", "wearer", "spell_id"], "caster", "row", F.col("up"))
    return intervals.union_spans(edges, ["run_id", "wearer", "spell_id"], "ts", "row", F.col("_end"))


def without_inert(spans: DataFrame, ctx: Context, inert: DataFrame) -> DataFrame:
    """Aura spans less listed inert debuffs (spell_id) that wearers mostly gave themselves."""
    put = ctx.events.filter(_in(AURA_UP) & ~F.coalesce("buff", F.lit(False))).groupBy("run_id", F.col("dst").alias("wearer"), "spell_id", F.col("src_root").alias("by")).agg(F.count("*").alias("n"), F.min("row").alias("first"))
    most = put.groupBy("run_id", "wearer", "spell_id").agg(F.max_by("by", F.struct("n", -F.col("first"))).alias("by")).filter("by = wearer")
    return spans.join(most.join(inert.select("spell_id").distinct(), "spell_id", "left_semi"), ["run_id", "wearer", "spell_id"], "left_anti")


def auras_in(spans: DataFrame, ctx: Context, lo: int, hi: int) -> DataFrame:
    """(run_id, wearer, aura, up, times): states of one name pooled, cut to [lo, hi] and merged."""
    names = ctx.spells.groupBy("spell_id").agg(F.min_by("spell", "first_row").alias("aura"))
    named = spans.join(names, "spell_id", "left").withColumn("aura", F.coalesce("aura", F.concat(F.lit("Spell "), F.col("spell_id").cast("string"))))
    cut = intervals.clip(named.select("run_id", "wearer", "aura", "start", "end"), F.lit(lo), F.lit(hi))
    return intervals.merge_spans(cut, ["run_id", "wearer", "aura"]).groupBy("run_id", "wearer", "aura").agg(F.sum(F.col("end") - F.col("start")).alias("up"), F.count("*").alias("times"))


def interrupts(ctx: Context, interrupt_ids: DataFrame) -> DataFrame:
    """Every attempt to stop a cast with its outcome. ``interrupt_ids`` has spell_id."""
    presses = ctx.events.filter("code = 'SPELL_CAST_SUCCESS' AND src_ours").join(checked_small(interrupt_ids), "spell_id", "left_semi").select("run_id", F.col("src_root").alias("actor"), F.col("dst").alias("target"), "spell_id", "ts", "row")
    presses = pairing.kept_apart(presses, ["run_id", "actor", "target"], "ts", "row", DUPLICATE_MS + 1)
    stops = ctx.events.filter("code = 'SPELL_INTERRUPT' AND src_ours").select("run_id", F.col("src_root").alias("actor"), F.col("dst").alias("target"), "spell_id", "ts", "row", "extra_spell_id")
    claimed = pairing.claims(presses, stops, ["run_id", "actor"], "ts", "row", SLACK_MS, PAIR_MS)
    hits = claimed.groupBy(F.col("press").alias("row")).agg(F.count("*").alias("stopped"))
    orphan = pairing.orphans(stops, claimed, "row").select("run_id", "actor", "target", "spell_id", "ts", "row", F.lit("interrupted").alias("outcome"), F.lit(1).cast("long").alias("stopped"), F.col("extra_spell_id").alias("stopped_spell"))
    judged = pairing.outcomes(presses, cast_windows(ctx), ["run_id", "target"], "ts", "row", AIM_MS, UNENDED_CAST_MS)
    # a blow that was avoided: the player's own miss near the press, whatever spell id it was logged under
    avoided = ctx.events.filter(_in(log.MISS) & F.col("src_ours")).join(checked_small(interrupt_ids), "spell_id", "left_semi").select("run_id", F.col("src_root").alias("actor"), "ts")
    landed = pairing.without_near(presses, avoided, ["run_id", "actor"], "ts", "row", MISS_MS).select("row", F.lit(True).alias("_landed"))
    out = presses.join(hits, "row", "left").join(judged, "row", "left").join(landed, "row", "left")
    outcome = F.when(F.col("stopped") > 0, "interrupted").when(F.col("_landed").isNull(), "missed").otherwise(F.col("outcome"))
    first = claimed.join(stops.select(F.col("row").alias("stop"), "extra_spell_id"), "stop").groupBy(F.col("press").alias("row")).agg(F.min_by("extra_spell_id", "stop").alias("stopped_spell"))
    out = out.join(first, "row", "left").select("run_id", "actor", "target", "spell_id", "ts", "row", outcome.alias("outcome"), F.coalesce("stopped", F.lit(0)).alias("stopped"), "stopped_spell")
    return out.unionByName(orphan)


def cast_windows(ctx: Context) -> DataFrame:
    """(run_id, target, start, end, ended) of enemy casts: closed by success, failure, interrupt, death or the next start."""
    e = ctx.events
    starts = e.filter("code = 'SPELL_CAST_START' AND NOT src_ours").select("run_id", F.col("src").alias("target"), "ts", "row", F.lit("start").alias("what"), "spell_id")
    ends = e.filter("code IN ('SPELL_CAST_SUCCESS', 'SPELL_CAST_FAILED') AND NOT src_ours").select("run_id", F.col("src").alias("target"), "ts", "row", F.lit("success").alias("what"), "spell_id")
    cut = e.filter("code = 'SPELL_INTERRUPT'").select("run_id", F.col("dst").alias("target"), "ts", "row", F.lit("interrupted").alias("what"), F.col("extra_spell_id").alias("spell_id"))
    dead = e.filter("code IN ('UNIT_DIED', 'UNIT_DESTROYED')").select("run_id", F.col("dst").alias("target"), "ts", "row", F.lit("died").alias("what"), F.lit(None).cast("long").alias("spell_id"))
    edges = starts.unionByName(ends).unionByName(cut).unionByName(dead)
    w = W.partitionBy("run_id", "target").orderBy("row")
    # an end of another spell is no end: keep ends that match the last start
    edges = edges.withColumn("_s", F.last(F.when(F.col("what") == "start", F.col("spell_id")), ignorenulls=True).over(w)).filter("what IN ('start', 'died') OR spell_id = _s")
    nxt = edges.withColumns({"_ts": F.lead("ts").over(w), "_what": F.lead("what").over(w)}).filter("what = 'start'")
    ended = F.when(F.col("_what").isNull(), "open").when(F.col("_what") == "start", "gone").otherwise(F.col("_what"))
    return nxt.select("run_id", "target", F.col("ts").alias("start"), F.least(F.coalesce("_ts", F.col("ts") + UNENDED_CAST_MS), F.col("ts") + UNENDED_CAST_MS).alias("end"), ended.alias("ended"))


def interrupt_summary(attempts: DataFrame) -> DataFrame:
    kinds = ["interrupted", "doubled", "ignored", "late", "early", "nothing", "missed"]
    return attempts.groupBy("run_id", "actor").agg(F.count("*").alias("casts"), F.sum("stopped").alias("stops"), *(F.count_if(F.col("outcome") == k).alias(k) for k in kinds))


def stopped_spells(ctx: Context) -> DataFrame:
    """(run_id, spell_id, stops, actors, target): each stopped spell with how often, by how many members, and on whom most."""
    rows = ctx.events.filter("code = 'SPELL_INTERRUPT' AND src_ours").select("run_id", F.col("extra_spell_id").alias("spell_id"), F.col("src_root").alias("actor"), "dst", "row")
    most = ranking.dominant(rows, ["run_id", "spell_id"], "dst", "row", "target").drop("votes")
    return rows.groupBy("run_id", "spell_id").agg(F.count("*").alias("stops"), F.countDistinct("actor").alias("actors")).join(most, ["run_id", "spell_id"])


def crowd_control(ctx: Context, kinds: DataFrame, press_ms: int = CONTROL_PRESS_MS) -> DataFrame:
    """Controls on enemies with duration and press. ``kinds`` has spell_id and mask.

    A control ends at the next refresh, removal, break or death on its target; one never seen ending
    is bounded by the longest of its spell. A spell that only knocks back has no length: its hits and
    states are grouped into presses, and each target of a press counts once.
    """
    every = ctx.events.join(checked_small(kinds), "spell_id")
    e = every.filter(F.col("mask") != KNOCKBACK)
    on = e.filter("code IN ('SPELL_AURA_APPLIED', 'SPELL_AURA_REFRESH') AND NOT coalesce(buff, false) AND src_ours AND NOT dst_ours").select("run_id", "dst", "spell_id", F.col("src_root").alias("actor"), "mask", "ts", "row", F.lit("on").alias("what"))
    off = e.filter(_in(AURA_DOWN)).select("run_id", "dst", "spell_id", "ts", "row", F.when(F.col("code").startswith("SPELL_AURA_BROKEN"), "broken").otherwise("removed").alias("what"))
    dead = ctx.events.filter("code IN ('UNIT_DIED', 'UNIT_DESTROYED')").select("run_id", "dst", "ts", "row")
    dead = dead.join(on.select("run_id", "dst", "spell_id").distinct(), ["run_id", "dst"]).withColumn("what", F.lit("died"))
    edges = on.unionByName(off, allowMissingColumns=True).unionByName(dead, allowMissingColumns=True)
    w = W.partitionBy("run_id", "dst", "spell_id").orderBy("row")
    spans = edges.withColumns({"_ts": F.lead("ts").over(w), "_what": F.lead("what").over(w)}).filter("what = 'on'").withColumn("ms", F.col("_ts") - F.col("ts"))
    longest = spans.groupBy("run_id", "spell_id").agg(F.max("ms").alias("_longest"))
    last = ctx.events.groupBy("run_id").agg(F.max("ts").alias("_last"))
    spans = spans.join(longest, ["run_id", "spell_id"], "left").join(last, "run_id")
    ms = F.coalesce("ms", F.when(F.col("_longest").isNotNull(), F.least(F.col("_last"), F.col("ts") + F.col("_longest")) - F.col("ts")), F.lit(0))
    ended = F.when(F.col("_what") == "on", "refreshed").otherwise(F.coalesce("_what", F.lit("open")))
    out = spans.select("run_id", "actor", "dst", "spell_id", "mask", "ts", "row", ms.alias("ms"), ended.alias("ended"))
    out = sessions.press_groups(out, ["run_id", "actor", "spell_id"], "ts", "row", press_ms)
    blow = (F.col("code").isin("SPELL_AURA_APPLIED", "SPELL_AURA_REFRESH") & ~F.coalesce("buff", F.lit(False))) | (F.col("code") == "SPELL_DAMAGE")
    thrown = every.filter((F.col("mask") == KNOCKBACK) & blow & F.col("src_ours") & ~F.col("dst_ours")).select("run_id", F.col("src_root").alias("actor"), "dst", "spell_id", "mask", "ts", "row")
    thrown = sessions.press_groups(thrown, ["run_id", "actor", "spell_id"], "ts", "row", press_ms)
    once = F.row_number().over(W.partitionBy("run_id", "press", "dst").orderBy("row"))
    thrown = thrown.withColumn("_n", once).filter("_n = 1").drop("_n").withColumns({"ms": F.lit(0).cast("long"), "ended": F.lit("knocked")})
    return out.unionByName(thrown)


def control_summary(cc: DataFrame) -> DataFrame:
    return cc.groupBy("run_id", "actor").agg(F.countDistinct("press").alias("casts"), F.count("*").alias("targets"), F.sum("ms").alias("ms"), F.count_if(F.col("ended") == "broken").alias("broken"), F.bit_or("mask").alias("kinds"))


def dispels(ctx: Context, enrages: DataFrame, press_ms: int = DISPEL_PRESS_MS, parts: tuple | None = None, bleeds: DataFrame | None = None) -> DataFrame:
    """Dispels by the party as purge, soothe or cleanse, grouped into presses. ``enrages`` and ``bleeds`` have spell_id.

    A debuff taken off an enemy of a segment (given ``parts``, what ``segments`` returns) is no cleanse;
    off any other ally it is. With ``parts`` rows get their segment: by the enemy, a cleanse by its time.
    """
    marks = checked_small(enrages.select(F.col("spell_id").alias("extra_spell_id"), F.lit(True).alias("_enrage")))
    rows = ctx.events.filter("code IN ('SPELL_DISPEL', 'SPELL_STOLEN') AND src_ours AND dst IS NOT NULL").join(marks, "extra_spell_id", "left")
    foe = F.lit(False)
    if parts:
        rows = rows.join(parts[1].select("run_id", F.col("enemy").alias("dst"), F.lit(True).alias("_foe")), ["run_id", "dst"], "left")
        foe = F.coalesce("_foe", F.lit(False))
    if bleeds is not None:
        rows = rows.join(checked_small(bleeds.select(F.col("spell_id").alias("extra_spell_id"), F.lit(True).alias("_bleed"))), "extra_spell_id", "left")
    kind = F.when(F.col("buff"), F.when(~F.col("dst_ours"), F.when(F.col("_enrage"), "soothe").otherwise("purge"))).when(F.col("dst_ours") | ~foe, "cleanse")
    bleed = F.coalesce(F.col("_bleed"), F.lit(False)) if bleeds is not None else F.lit(False)
    out = rows.select("run_id", F.col("src_root").alias("actor"), "dst", "spell_id", "extra_spell_id", "extra_spell", "ts", "row", kind.alias("kind"), bleed.alias("_bleeds"), (F.col("code") == "SPELL_STOLEN").alias("stolen")).filter("kind IS NOT NULL")
    out = out.withColumn("bleed", F.col("_bleeds") & (F.col("kind") == "cleanse")).drop("_bleeds")
    out = sessions.press_groups(out, ["run_id", "actor", "spell_id"], "ts", "row", press_ms)
    return with_segment(out, parts, F.when(F.col("kind") != "cleanse", F.col("dst"))) if parts else out


def dispel_summary(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(per member and spell: casts, removed, kinds; per kind and name of the state: removed, by how many)."""
    own = rows.groupBy("run_id", "actor", "spell_id").agg(F.countDistinct("press").alias("casts"), F.count("*").alias("removed"), *(F.count_if(F.col("kind") == k).alias(f"{k}s") for k in ("purge", "soothe", "cleanse")), F.count_if("stolen").alias("stolen"))
    states = rows.groupBy("run_id", "kind", "extra_spell").agg(F.count("*").alias("removed"), F.countDistinct("actor").alias("actors"))
    return own, states


def _just_off(rows: DataFrame, ctx: Context, aura: str, ms: int) -> DataFrame:
    """The ``row`` of rows (run_id, dst, ts, row, ``aura``) whose victim lost that state in the ``ms`` before, by order of rows."""
    off = ctx.events.filter("code = 'SPELL_AURA_REMOVED'").select("run_id", "dst", F.col("spell_id").alias(aura), "row", F.col("ts").alias("off"))
    seen = asof.asof_last(rows.select("run_id", "dst", aura, "row", F.col("ts").alias("hit")), off, ["run_id", "dst", aura], "row", ["off"])
    return seen.filter(F.col("hit") - F.col("off") <= ms).select("row")


def avoidable(ctx: Context, dim: DataFrame, burst_ms: int = 50) -> DataFrame:
    """Hits of listed abilities on players, with what excuses them taken out.

    ``dim`` has spell_id and, each optional: unless (a state of the victim's own that came off just
    before), unless_marked (a state that the victim has, or just had), after_cast, after_aura, after_from
    and after_ms (the hit's state, or the hit's spell's, last went on so long after that enemy cast began),
    tank (tanks take it), covered (marked in the result).
    """
    types = {"unless": "long", "unless_marked": "long", "after_cast": "long", "after_aura": "long", "after_from": "long", "after_ms": "long", "tank": "boolean", "covered": "boolean"}
    rules = dim.select("spell_id", *((F.col(c) if c in dim.columns else F.lit(None)).cast(t).alias(c) for c, t in types.items()))
    hits = ctx.events.filter(_in(DAMAGE_CODES) & F.col("dst_ours") & ~F.col("src_ours") & (F.col("dst") == F.col("dst_root"))).join(checked_small(rules), "spell_id")
    spec = ctx.party.select("run_id", F.col("guid").alias("dst"), "spec_id")
    hits = hits.join(spec, ["run_id", "dst"], "left").filter(~(F.coalesce("tank", F.lit(False)) & F.coalesce(F.col("spec_id").isin(*TANK_SPECS), F.lit(False))))
    own = _just_off(hits.filter("unless IS NOT NULL"), ctx, "unless", burst_ms)
    marked = hits.filter("unless_marked IS NOT NULL")
    states = ctx.events.filter(F.col("code").isin("SPELL_AURA_APPLIED", "SPELL_AURA_APPLIED_DOSE", "SPELL_AURA_REFRESH", "SPELL_AURA_REMOVED")).select("run_id", "dst", F.col("spell_id").alias("unless_marked"), "row", (F.col("code") != "SPELL_AURA_REMOVED").alias("has"))
    has = asof.asof_last(marked.select("run_id", "dst", "unless_marked", "row"), states, ["run_id", "dst", "unless_marked"], "row", ["has"]).filter("has").select("row")
    lost = _just_off(marked, ctx, "unless_marked", burst_ms)
    part_of = _part_of_mechanic(ctx, rules, hits)
    excused = own.unionByName(has).unionByName(lost).unionByName(part_of).distinct()
    return hits.join(excused, "row", "left_anti").select("run_id", F.col("dst").alias("actor"), "spell_id", "ts", "row", "amount", (F.coalesce("waste", F.lit(-1)) > 0).alias("fatal"), F.coalesce("covered", F.lit(False)).alias("covered"))


def _part_of_mechanic(ctx: Context, rules: DataFrame, hits: DataFrame) -> DataFrame:
    """Rows of hits whose state last went on within the rule's time of the enemy cast: two as-of look-ups, by order of rows."""
    watched = rules.filter("after_cast IS NOT NULL").select(F.coalesce("after_aura", "spell_id").alias("aura"), "after_cast", F.coalesce("after_from", F.lit(0)).alias("after_from"), "after_ms").distinct()
    on = ctx.events.filter(F.col("code").isin("SPELL_AURA_APPLIED", "SPELL_AURA_APPLIED_DOSE", "SPELL_AURA_REFRESH")).select("run_id", "dst", F.col("spell_id").alias("aura"), "row", F.col("ts").alias("on"))
    on = on.join(checked_small(watched), "aura")
    begun = ctx.events.filter("code = 'SPELL_CAST_START'").select("run_id", F.col("spell_id").alias("after_cast"), "row", F.col("ts").alias("cast"))
    since = asof.asof_last(on, begun, ["run_id", "after_cast"], "row", ["cast"])
    since = since.withColumn("ok", F.coalesce((F.col("on") - F.col("cast") >= F.col("after_from")) & (F.col("on") - F.col("cast") <= F.col("after_ms")), F.lit(False)))
    asked = hits.filter("after_cast IS NOT NULL").select("run_id", "dst", F.coalesce("after_aura", "spell_id").alias("aura"), "row")
    return asof.asof_last(asked, since.select("run_id", "dst", "aura", "row", "ok"), ["run_id", "dst", "aura"], "row", ["ok"]).filter("ok").select("row")


def avoidable_summary(ctx: Context, hits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(per member: hits, amount, fatal; per ability name: hits, amount, members hit)."""
    names = ctx.spells.groupBy("spell_id").agg(F.min_by("spell", "first_row").alias("ability"))
    named = hits.join(names, "spell_id", "left").withColumn("ability", F.coalesce("ability", F.concat(F.lit("Spell "), F.col("spell_id").cast("string"))))
    own = hits.groupBy("run_id", "actor").agg(F.count("*").alias("hits"), F.sum("amount").alias("amount"), F.count_if("fatal").alias("fatal"))
    return own, named.groupBy("run_id", "ability").agg(F.count("*").alias("hits"), F.sum("amount").alias("amount"), F.countDistinct("actor").alias("actors"))


def position_tracks(ctx: Context, least: int = THIN_MS) -> DataFrame:
    """Samples of the party's positions at least 250 ms apart (or on another map)."""
    p = ctx.events.filter("subject IS NOT NULL AND map > 0 AND (x <> 0 OR y <> 0)").join(ctx.party.select("run_id", F.col("guid").alias("subject")), ["run_id", "subject"], "left_semi")
    rows = p.select("run_id", F.col("subject").alias("actor"), "ts", "row", "x", "y", "map", F.when(F.col("hp_max") > 0, F.floor(100 * F.col("hp") / F.col("hp_max") + 0.5)).alias("hp_pct"))
    return pairing.kept_apart(rows, ["run_id", "actor"], "ts", "row", least, "map")


def distance(tracks: DataFrame) -> DataFrame:
    """Summed steps on one map without teleports."""
    w = W.partitionBy("run_id", "actor").orderBy("row")
    step, dt = F.hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w)), (F.col("ts") - F.lag("ts").over(w)) / 1000
    ok = (F.lag("map").over(w) == F.col("map")) & ~((step > TELEPORT_YARDS) & (step > TELEPORT_SPEED * dt))
    return tracks.withColumn("_d", F.when(ok, step).otherwise(0.0)).groupBy("run_id", "actor").agg(F.sum("_d").alias("yards"))


def readiness(ctx: Context, clocks: DataFrame) -> DataFrame:
    """Uses of timed abilities with the time at which each is ready again. ``clocks`` has spell_id, recovery_ms and charges."""
    uses = ctx.events.filter("code = 'SPELL_CAST_SUCCESS' AND src_ours AND src = src_root").join(checked_small(clocks.select("spell_id", "recovery_ms", "charges")), "spell_id")
    uses = uses.select("run_id", F.col("src").alias("actor"), "spell_id", "ts", "row", "recovery_ms", "charges")
    return pairing.charge_clock(uses, ["run_id", "actor", "spell_id"], "ts", "row", "recovery_ms", "charges")


def summary(ctx: Context) -> DataFrame:
    """Damage, healing and deaths per member of each run."""
    total = lambda d, name: breakdown(ctx, d).groupBy("run_id", F.col("actor").alias("guid")).agg(F.sum("total").alias(name))
    dead = ctx.events.filter("code = 'UNIT_DIED' AND NOT feigned").groupBy("run_id", F.col("dst").alias("guid")).agg(F.count("*").alias("deaths"))
    out = ctx.party.select("run_id", "guid", "place").join(total("done", "damage"), ["run_id", "guid"], "left").join(total("healing", "healing"), ["run_id", "guid"], "left").join(dead, ["run_id", "guid"], "left")
    return out.na.fill(0, ["damage", "healing", "deaths"])


def swing_check(ctx: Context) -> DataFrame:
    """(run_id, actor, swings, landed): melee by the attacker's rows against the victims' rows."""
    rows = ctx.events.filter("code IN ('SWING_DAMAGE', 'SWING_DAMAGE_LANDED') AND src_ours AND NOT support")
    return rows.groupBy("run_id", F.col("src_root").alias("actor")).agg(F.count_if(F.col("code") == "SWING_DAMAGE").alias("swings"), F.count_if(F.col("code") == "SWING_DAMAGE_LANDED").alias("landed"))


def share_lines(totals: DataFrame, value: str, limit: int = 10) -> DataFrame:
    """The ranked top members of a run as lines of text of bounded width (see ``views``)."""
    from millrace.plans import views

    return views.share_lines(totals, value, limit=limit)
