"""Deaths of party members: what led to each, what was on the victim, and what they had ready.

``deaths`` has a row per death; the detail reports are keyed by that row (``anchor``) and come from
one look-back of the victims' rows, written once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window as W

from millrace.operators import attribution, pairing
from millrace.plans.reports import AURA_DOWN, AURA_UP, DAMAGE_CODES, DEFERRED_ABSORBS, LOOKBACK_MS, SCROLLBACK_MS, Context, _credited, checked_small, with_segment
from millrace.sources import log

REINCARNATION, CREATE_SOULWELL, CREATE_HEALTHSTONE = 21169, 29893, 6201  # fixed values: spells
POTION_MS, STONE_MS, STONE_CHARGES, SAME_PRESS_MS = 300_000, 60_000, 3, 2_000
ONE_SHOT_SHARE, ONE_SHOT_MS, BUCKETS_MS = 0.95, 500, (1000, 500, 250)
WARLOCK_SPECS = (265, 266, 267)
_DEATH = ["run_id", "dst", "ts", "row"]


def deaths(ctx: Context, parts: tuple | None = None) -> DataFrame:
    """(run_id, dst, ts, row, nth, since_previous, dead_at_once[, segment]): deaths of members, feigned ones left out.

    ``since_previous`` is the time since any member's death; ``dead_at_once`` counts members down, who
    rise by a resurrection or by reincarnating. ``parts`` (what ``segments`` returns) adds the segment.
    """
    e, member = ctx.events, ctx.party.select("run_id", F.col("guid").alias("dst"))
    died = e.filter("code = 'UNIT_DIED' AND NOT feigned").select(*_DEATH, "src").join(member, ["run_id", "dst"], "left_semi")
    raised = e.filter("code = 'SPELL_RESURRECT'").select(*_DEATH)
    itself = e.filter((F.col("code") == "SPELL_CAST_SUCCESS") & (F.col("spell_id") == REINCARNATION)).select("run_id", F.col("src").alias("dst"), "ts", "row")
    tally = died.select(*_DEATH, F.lit(1).alias("d")).unionByName(raised.unionByName(itself).join(member, ["run_id", "dst"], "left_semi").withColumn("d", F.lit(-1)))
    was = F.coalesce(F.lag("d").over(W.partitionBy("run_id", "dst").orderBy("row")), F.lit(-1))
    change = tally.withColumn("d", F.when(F.col("d") != was, F.col("d")).otherwise(0))
    down = change.withColumn("dead_at_once", F.sum("d").over(W.partitionBy("run_id").orderBy("row"))).select("run_id", "row", "dead_at_once")
    of_run, of_victim = W.partitionBy("run_id").orderBy("row"), W.partitionBy("run_id", "dst").orderBy("row")
    out = died.join(down, ["run_id", "row"]).withColumns({"nth": F.row_number().over(of_victim), "since_previous": F.col("ts") - F.lag("ts").over(of_run)})
    return with_segment(out, parts, F.col("src")).drop("src") if parts else out.drop("src")


def wipe_cutoff(ctx: Context, dead: DataFrame) -> DataFrame:
    """(run_id, ts): on a failed raid pull, the first death at which a quarter of the party (rounded up) was down."""
    size = ctx.party.groupBy("run_id").agg(F.count("*").alias("members"))
    failed = ctx.runs.filter("kind = 'raid' AND NOT success").select("run_id").join(size, "run_id")
    return dead.join(failed, "run_id").filter(F.col("dead_at_once") >= F.ceil(F.col("members") / 4)).groupBy("run_id").agg(F.min_by("ts", "row").alias("ts"))


@dataclass
class Recap:
    """The detail of a set of deaths; every frame has run_id, anchor (the death's row) and the victim."""

    near: DataFrame
    window: int

    def _hits(self) -> DataFrame:
        rows = self.near.filter(F.col("code").isin(*DAMAGE_CODES, "ENVIRONMENTAL_DAMAGE") & ~F.col("support") & (F.col("dst") == F.col("victim")))
        own = rows.withColumns({"net": attribution.effective(F.col("amount"), F.coalesce("waste", F.lit(-1))), "overkill": F.greatest(F.coalesce("waste", F.lit(0)), F.lit(0))})
        env = F.col("code") == "ENVIRONMENTAL_DAMAGE"
        return own.withColumns({"spell": F.when(env, F.col("environment")).otherwise(F.col("spell")), "spell_id": F.coalesce("spell_id", F.lit(0)), "environmental": env})

    def incoming(self) -> DataFrame:
        """Hits on the victim: who, what, net amount, overkill, absorbed, critical."""
        return self._hits().select("run_id", "anchor", "victim", "ts", "row", F.col("actor").alias("source"), "spell_id", "spell", "net", "overkill", "absorbed", "crit", "environmental")

    def heals(self) -> DataFrame:
        rows = self.near.filter(F.col("code").isin(*log.HEAL) & ~F.col("support") & (F.col("dst") == F.col("victim")))
        return rows.select("run_id", "anchor", "victim", "ts", "row", F.col("actor").alias("source"), "spell_id", "spell", attribution.effective(F.col("amount"), F.coalesce("waste", F.lit(-1))).alias("net"), F.greatest(F.coalesce("waste", F.lit(0)), F.lit(0)).alias("overhealing"))

    def absorbs(self) -> DataFrame:
        """Shields' part, by the shield's spell; a shield that only defers the hit is left out."""
        rows = self.near.filter((F.col("code") == "SPELL_ABSORBED") & (F.col("dst") == F.col("victim")) & ~F.coalesce(F.col("extra_spell_id").isin(*DEFERRED_ABSORBS), F.lit(False)))
        return rows.select("run_id", "anchor", "victim", "ts", "row", F.col("extra_spell_id").alias("spell_id"), F.col("extra_spell").alias("spell"), F.col("caster").alias("source"), "amount")

    def totals(self) -> DataFrame:
        """Per death: damage, healing and absorbs of the last ten seconds, and the killing blow (the last hit with overkill, else the last)."""
        late = F.col("ts") >= F.col("died") - LOOKBACK_MS
        tag = lambda df, name, value: df.join(self._died(), ["run_id", "anchor"]).groupBy("run_id", "anchor").agg(F.sum(F.when(late, F.col(value))).alias(name))
        blow = F.struct("row", "ts", "source", "spell_id", "spell", "net", "overkill")
        killing = self.incoming().groupBy("run_id", "anchor").agg(F.max_by(blow, F.struct((F.col("overkill") > 0).alias("o"), "row")).alias("blow"))
        out = tag(self.incoming(), "taken", "net").join(tag(self.heals(), "healed", "net"), ["run_id", "anchor"], "full").join(tag(self.absorbs(), "soaked", "amount"), ["run_id", "anchor"], "full").join(killing, ["run_id", "anchor"], "full")
        return out.na.fill(0, ["taken", "healed", "soaked"])

    def _died(self) -> DataFrame:
        return self.near.filter("row = anchor").select("run_id", "anchor", F.col("ts").alias("died"))

    def trace(self) -> DataFrame:
        """The victim's health: rows whose block describes them."""
        rows = self.near.filter((F.col("subject") == F.col("victim")) & (F.col("hp") >= 0))
        return rows.select("run_id", "anchor", "victim", "ts", "row", "hp", "hp_max", F.when(F.col("hp_max") > 0, F.col("hp") / F.col("hp_max")).alias("fraction"), "x", "y")

    def by_ability(self) -> DataFrame:
        """(run_id, anchor, spell_id, total, hits, source): the last ten seconds' hits by spell, with the source that dealt most."""
        rows = self.incoming().join(self._died(), ["run_id", "anchor"]).filter(F.col("ts") >= F.col("died") - LOOKBACK_MS)
        part = rows.groupBy("run_id", "anchor", "spell_id", "source").agg(F.sum("net").alias("t"), F.count("*").alias("n"), F.min("row").alias("first"))
        return part.groupBy("run_id", "anchor", "spell_id").agg(F.sum("t").alias("total"), F.sum("n").alias("hits"), F.max_by("source", F.struct("t", -F.col("first"))).alias("source"))

    def own_casts(self, buttons: DataFrame) -> DataFrame:
        """Listed abilities (spell_id) that the victim used in the last ten seconds."""
        rows = self.near.filter("code = 'SPELL_CAST_SUCCESS' AND src = victim").join(checked_small(buttons), "spell_id", "left_semi").join(self._died(), ["run_id", "anchor"])
        return rows.filter(F.col("ts") >= F.col("died") - LOOKBACK_MS).select("run_id", "anchor", "victim", "ts", "row", "spell_id", "spell")

    def states(self, tags: DataFrame | None = None) -> DataFrame:
        """Spans of the states on the victim by spell and caster: start, end, open_start, open_end, buff.

        A removal without an application was up when the window opened; what is up at the end ran to the
        death. ``tags`` (spell_id and flags such as defensive, inert) is joined on.
        """
        aura = self.near.filter((F.col("dst") == F.col("victim")) & F.col("code").isin(*AURA_UP, *AURA_DOWN)).join(self._died(), ["run_id", "anchor"])
        aura = aura.select("run_id", "anchor", "victim", "spell_id", "spell", F.coalesce("src_root", F.lit("")).alias("by"), "ts", "row", "died", F.coalesce("buff", F.lit(False)).alias("buff"), F.col("code").isin(*AURA_UP).alias("up"))
        w = W.partitionBy("run_id", "anchor", "spell_id", "by").orderBy("row")
        prior = F.lag("up").over(w)
        edge = aura.withColumn("_was", prior).filter(F.col("_was").isNull() | (F.col("up") != F.col("_was")) | (~F.col("up") & ~F.col("_was")))
        edge = edge.withColumns({"_next": F.lead("ts").over(w), "_end": F.lead("up").over(w)})
        opened = edge.filter("up").select("run_id", "anchor", "victim", "spell_id", "spell", "by", "buff", F.col("ts").alias("start"), F.coalesce("_next", "died").alias("end"), F.lit(False).alias("open_start"), F.col("_next").isNull().alias("open_end"))
        ghost = edge.filter("NOT up AND (_was IS NULL OR NOT _was)").select("run_id", "anchor", "victim", "spell_id", "spell", "by", "buff", (F.col("died") - self.window).alias("start"), F.col("ts").alias("end"), F.lit(True).alias("open_start"), F.lit(False).alias("open_end"))
        spans = opened.unionByName(ghost)
        return spans.join(checked_small(tags), "spell_id", "left") if tags is not None else spans

    def debuffs_at_death(self, inert: DataFrame) -> DataFrame:
        """(run_id, anchor, spell_id, ts): debuffs up at the death, each once; listed inert ones (spell_id) that victims gave themselves are left out."""
        mark = self.states(inert.select("spell_id").distinct().withColumn("_inert", F.lit(True)))
        up = mark.filter(F.col("open_end") & ~F.col("buff") & ~(F.coalesce("_inert", F.lit(False)) & (F.col("by") == F.col("victim"))))
        return up.groupBy("run_id", "anchor", "spell_id").agg(F.min("start").alias("ts"))

    def one_shots(self) -> DataFrame:
        """(run_id, anchor, fraction): deaths by one ability that took 95 % of full health within half a second, with nothing else landing."""
        killing = self.totals().select("run_id", "anchor", F.col("blow.ts").alias("_at"), F.col("blow.spell_id").alias("_spell"))
        top = self.trace().groupBy("run_id", "anchor").agg(F.max("hp_max").alias("hp_max"))
        late = self.incoming().join(killing, ["run_id", "anchor"]).filter((F.col("ts") <= F.col("_at")) & (F.col("_at") - F.col("ts") <= ONE_SHOT_MS))
        g = late.groupBy("run_id", "anchor").agg(F.sum(F.when(F.col("spell_id") == F.col("_spell"), F.col("net"))).alias("own"), F.count_if((F.col("spell_id") != F.col("_spell")) & (F.col("net") > 0)).alias("others"))
        g = g.join(top, ["run_id", "anchor"]).filter("others = 0 AND hp_max > 0").withColumn("fraction", F.col("own") / F.col("hp_max"))
        return g.filter(F.col("fraction") >= ONE_SHOT_SHARE).select("run_id", "anchor", "fraction")

    def buckets(self, ms: int = BUCKETS_MS[0]) -> DataFrame:
        """(run_id, anchor, bucket, spell_id, net, hp): bars by ability in fixed steps before the death, with the health carried forward."""
        died = self._died()
        at = lambda df: df.join(died, ["run_id", "anchor"]).withColumn("bucket", F.floor((F.col("ts") - (F.col("died") - self.window)) / ms))
        bars = at(self.incoming()).groupBy("run_id", "anchor", "bucket", "spell_id").agg(F.sum("net").alias("net"))
        health = at(self.trace()).groupBy("run_id", "anchor", "bucket").agg(F.max_by("hp", "row").alias("hp"))
        both = bars.join(health, ["run_id", "anchor", "bucket"], "full")
        known = F.last("hp", ignorenulls=True).over(W.partitionBy("run_id", "anchor").orderBy("bucket").rangeBetween(W.unboundedPreceding, 0))
        return both.withColumn("hp", known)


def recap(ctx: Context, dead: DataFrame, window: int = SCROLLBACK_MS) -> Recap:
    """The look-back of ``window`` before each death: rows on the victim, by the victim, or that describe them."""
    e = _credited(ctx.events)
    about = F.array_distinct(F.array_compact(F.array("dst", "src", "subject")))
    rows = e.withColumn("victim", F.explode(about))
    near = attribution.lookback(dead.select("run_id", F.col("dst").alias("victim"), "ts", "row"), rows, ["run_id", "victim"], "ts", "row", window)
    return Recap(near, window)


def uses(ctx: Context, potions: DataFrame, stones: DataFrame, clocks: DataFrame) -> DataFrame:
    """(run_id, actor, what, spell_id, ts, row): potions, healthstones, refills and defensives used.

    ``potions`` and ``stones`` have spell_id; ``clocks`` spell_id, recovery_ms and charges. Potions and
    stones are casts; defensives are read off their states, two within 2 s being one press. A soulwell
    refills everyone.
    """
    e, member = ctx.events, ctx.party.select("run_id", F.col("guid").alias("actor"))
    cast = e.filter("code = 'SPELL_CAST_SUCCESS'").select("run_id", F.col("src").alias("actor"), "spell_id", "ts", "row")
    own = cast.join(member, ["run_id", "actor"], "left_semi")
    listed = lambda dim, what: own.join(checked_small(dim.select("spell_id")), "spell_id", "left_semi").withColumn("what", F.lit(what))
    refill = own.filter(F.col("spell_id") == CREATE_HEALTHSTONE).withColumn("what", F.lit("refill"))
    well = cast.filter(F.col("spell_id") == CREATE_SOULWELL).drop("actor").join(member, "run_id").withColumn("what", F.lit("refill"))
    put = e.filter("code = 'SPELL_AURA_APPLIED' AND src_ours").select("run_id", F.col("src_root").alias("actor"), "spell_id", "ts", "row").join(checked_small(clocks.select("spell_id")), "spell_id", "left_semi")
    put = pairing.kept_apart(put, ["run_id", "actor", "spell_id"], "ts", "row", SAME_PRESS_MS).withColumn("what", F.lit("defensive"))
    return listed(potions, "potion").unionByName(listed(stones, "stone")).unionByName(refill).unionByName(well).unionByName(put)


def _state(last: Column, died: Column, wait: Column, window: int) -> Column:
    return F.when(last.isNull(), "ready").when(last >= died - window, "pressed").when(died - last >= wait, "ready").otherwise("cooldown")


OTHERS_ONLY = (6940, 199448, 53480, 357170)  # fixed values: defensives that cannot be put on oneself


def ready_at_death(ctx: Context, dead: DataFrame, used: DataFrame, clocks: DataFrame, window: int = LOOKBACK_MS) -> DataFrame:
    """(run_id, row, dst, what, name, state, last_used): potion, healthstone and defensives of each victim as they stood.

    A state is ready, pressed (within the window), cooldown or, for a stone, empty. A defensive that helps
    others alone is none; one that the victim never used is not known and has no row; several spells of one name are one button, which is
    pressed or on cooldown if any of them is. A stone is listed where a warlock was about or one was used.
    """
    victim = dead.select("run_id", F.col("dst").alias("actor"), F.col("ts").alias("died"), F.col("row").alias("death"))
    before = victim.join(used, ["run_id", "actor"]).filter("ts <= died")
    last = before.groupBy("run_id", "death", "what").agg(F.max("ts").alias("last_used"))
    base = victim.withColumn("what", F.explode(F.array(F.lit("potion"), F.lit("stone")))).join(last, ["run_id", "death", "what"], "left")
    warlock = ctx.party.filter(F.col("spec_id").isin(*WARLOCK_SPECS)).select("run_id").unionByName(ctx.events.filter((F.col("code") == "SPELL_CAST_SUCCESS") & (F.col("spell_id") == CREATE_SOULWELL)).select("run_id")).distinct().withColumn("_w", F.lit(True))
    has = used.filter("what = 'stone'").select("run_id", "actor").distinct().withColumn("_s", F.lit(True))
    base = base.join(warlock, "run_id", "left").join(has, ["run_id", "actor"], "left").filter("what = 'potion' OR _w OR _s")
    wait = F.when(F.col("what") == "potion", POTION_MS).otherwise(STONE_MS)
    steps = F.array_sort(F.collect_list(F.when(F.col("what").isin("stone", "refill"), F.struct("ts", (F.col("what") == "stone").alias("use")))))
    # charges: a refill fills an empty bag; a use with nothing left means that one was taken unseen
    fold = lambda n, x: F.when(x["use"], F.when(n == 0, STONE_CHARGES - 1).otherwise(n - 1)).otherwise(F.when(n == 0, STONE_CHARGES).otherwise(n))
    left = before.groupBy("run_id", "death").agg(steps.alias("_x")).select("run_id", "death", F.aggregate("_x", F.lit(STONE_CHARGES), fold).alias("_left"))
    base = base.join(left, ["run_id", "death"], "left").withColumn("state", _state(F.col("last_used"), F.col("died"), wait, window))
    base = base.withColumn("state", F.when((F.col("what") == "stone") & (F.col("state") == "ready") & (F.col("_left") == 0), "empty").otherwise(F.col("state")))
    base = base.select("run_id", F.col("death").alias("row"), F.col("actor").alias("dst"), "what", F.col("what").alias("name"), "state", "last_used")
    own = used.filter(F.col("what") == "defensive").filter(~F.col("spell_id").isin(*OTHERS_ONLY))
    clocked = pairing.charge_clock(own.join(checked_small(clocks.select("spell_id", "recovery_ms", "charges")), "spell_id"), ["run_id", "actor", "spell_id"], "ts", "row", "recovery_ms", "charges")
    names = ctx.spells.groupBy("spell_id").agg(F.min_by("spell", "first_row").alias("name"))
    known = victim.join(clocked, ["run_id", "actor"])
    g = known.groupBy("run_id", "death", "actor", "died", "spell_id").agg(F.max(F.when(F.col("ts") <= F.col("died"), F.col("ts"))).alias("last_used"), F.max_by("ready_at", F.when(F.col("ts") <= F.col("died"), F.col("row"))).alias("ready_at"))
    state = F.when(F.col("last_used") >= F.col("died") - window, "pressed").when(F.coalesce("ready_at", F.lit(0)) <= F.col("died"), "ready").otherwise("cooldown")
    g = g.withColumn("state", state).join(names, "spell_id", "left").withColumn("name", F.coalesce("name", F.concat(F.lit("Spell "), F.col("spell_id").cast("string"))))
    rank = F.when(F.col("state") == "pressed", 0).when(F.col("state") == "cooldown", 1).otherwise(2)
    one = g.groupBy("run_id", "death", "actor", "name").agg(F.min_by(F.struct("state", "last_used"), F.struct(rank, "spell_id")).alias("s"))
    return base.unionByName(one.select("run_id", F.col("death").alias("row"), F.col("actor").alias("dst"), F.lit("defensive").alias("what"), "name", "s.state", "s.last_used"))


def forgotten(dead: DataFrame, ready: DataFrame, one_shots: DataFrame) -> DataFrame:
    """``dead`` with ``forgot`` (a potion or stone was ready and it was no one-shot) and ``forgot_before`` (the victim's earlier ones)."""
    some = ready.filter("what IN ('potion', 'stone') AND state = 'ready'").select("run_id", "row").distinct().withColumn("_r", F.lit(True))
    shot = one_shots.select("run_id", F.col("anchor").alias("row"), F.lit(True).alias("_o"))
    out = dead.join(some, ["run_id", "row"], "left").join(shot, ["run_id", "row"], "left").withColumn("forgot", F.coalesce("_r", F.lit(False)) & F.col("_o").isNull()).drop("_r", "_o")
    w = W.partitionBy("run_id", "dst").orderBy("row").rowsBetween(W.unboundedPreceding, -1)
    return out.withColumn("forgot_before", F.coalesce(F.sum(F.col("forgot").cast("int")).over(w), F.lit(0)))


def quips(told: DataFrame, lines: DataFrame) -> DataFrame:
    """(run_id, row, quip): one remark on each death, by what it was (``kind``, the first that holds of one_shot, forgot_again, forgot, plain), drawn by hash.

    ``told`` has forgot, forgot_before and one_shot; ``lines`` has kind, n (from 0) and quip.
    """
    from millrace.functions.text import fnv1a32

    kind = F.when(F.col("one_shot"), "one_shot").when(F.col("forgot") & (F.col("forgot_before") > 0), "forgot_again").when(F.col("forgot"), "forgot").otherwise("plain")
    sizes = lines.groupBy("kind").agg(F.count("*").alias("_size"))
    pick = told.withColumn("kind", kind).join(sizes, "kind").withColumn("n", F.pmod(fnv1a32(F.concat_ws(":", "run_id", "row")), F.col("_size")))
    return pick.join(lines, ["kind", "n"]).select("run_id", "row", "kind", "quip")


def healing_in(r: Recap, before: int) -> DataFrame:
    """(run_id, anchor, spell_id, source, net, overhealing, times): healing on the victim in the last ``before`` ms by spell and healer."""
    rows = r.heals().join(r._died(), ["run_id", "anchor"]).filter(F.col("ts") >= F.col("died") - before)
    return rows.groupBy("run_id", "anchor", "spell_id", "source").agg(F.sum("net").alias("net"), F.sum("overhealing").alias("overhealing"), F.count("*").alias("times"))


