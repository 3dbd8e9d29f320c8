"""Casting: bars, channels and presses as intervals between a player's cast rows.

One light fold per player and run labels each row by what it does: it opens a bar, finishes or fails
the open one, is a press that takes the cooldown, a free press or a proc, or a death. Everything else
is windows over those labels: a bar or channel reaches to the next label that stops it, and no
further than it can have lasted. Lengths, the longest finish of a spell and kicks are joins.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.window import Window as W

from millrace.operators import pairing
from millrace.plans.reports import Context, checked_small

PROC_FRACTION, MAX_BAR_MS, UNCLOSED_BAR_MS, OPEN_CHANNEL_MS, KICK_MS = 0.45, 10_000, 3_000, 8_000, 100
#: What the log's cast rows tell about the player.
TOLD = {
    "SPELL_CAST_START": "start", "SPELL_EMPOWER_START": "empower", "SPELL_EMPOWER_END": "let_go", "SPELL_EMPOWER_INTERRUPT": "cut", "SPELL_CAST_FAILED": "failed", "SPELL_AURA_REMOVED": "faded", "SPELL_CAST_SUCCESS": "landed",
}
#: Row that ends a bar of its own spell: (whether the bar is an empowered one, what it then does).
ENDS = {"landed": (False, "finishes"), "failed": (False, "fails"), "let_go": (True, "finishes"), "cut": (True, "fails")}
OWNER = ["run_id", "actor"]


def cast_rows(ctx: Context, dim: DataFrame) -> DataFrame:
    """(run_id, actor, ts, row, what, spell_id, gcd_ms, channel_ms, button) of the members' own cast rows and deaths."""
    told = F.create_map(*(F.lit(x) for pair in TOLD.items() for x in pair))
    member = ctx.party.select("run_id", F.col("guid").alias("actor"))
    own = ctx.events.select("run_id", F.col("src").alias("actor"), "ts", "row", told[F.col("code")].alias("what"), "spell_id").filter("what IS NOT NULL")
    own = own.join(checked_small(dim), "spell_id", "left").filter("what <> 'faded' OR channel_ms IS NOT NULL")
    dead = ctx.events.filter("code = 'UNIT_DIED' AND NOT feigned").select("run_id", F.col("dst").alias("actor"), "ts", "row", F.lit("death").alias("what"))
    return own.unionByName(dead, allowMissingColumns=True).join(member, OWNER, "left_semi")


def labelled(rows: DataFrame) -> DataFrame:
    """``rows`` with ``effect``: opens, finishes, fails, presses, free, proc, dies or null.

    Which of two presses is the proc depends on what the one before was, so this is a fold; its whole
    state is the spell whose bar is open and the time up to which another press is a proc.
    """
    schema = T.StructType([*rows.schema.fields, T.StructField("effect", T.StringType())])
    names = schema.fieldNames()

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("row", kind="stable")
        running, busy, effects = None, float("-inf"), []
        gcd, button = pd.to_numeric(group["gcd_ms"]).fillna(0), group["button"].eq(True)
        for ts, what, spell, wait, is_button in zip(group["ts"], group["what"], group["spell_id"], gcd, button, strict=True):
            empowered, ending = ENDS.get(what, (None, None))
            effect = None
            if what in ("start", "empower"):
                effect, running = "opens", (spell, what == "empower")
                busy = ts + PROC_FRACTION * wait if wait else busy
            elif what == "death":
                effect, running = "dies", None
            elif ending and running == (spell, empowered):
                effect, running = ending, None
            elif what == "landed" and running != (spell, True):  # an empowered spell lands as it begins
                effect = ("free" if is_button else None) if not wait else "proc" if ts < busy else "presses"
                if effect == "presses":
                    running, busy = None, ts + PROC_FRACTION * wait
            effects.append(effect)
        return group.assign(effect=effects)[names]

    return rows.groupBy(*OWNER).applyInPandas(fold, schema)


def longest_finish(rows: DataFrame) -> DataFrame:
    """(run_id, actor, spell_id, longest): the longest time from a start to its first landing, no other start between."""
    begun = F.last(F.when(F.col("what") == "start", F.struct("row", "spell_id", "ts")), ignorenulls=True).over(W.partitionBy(*OWNER).orderBy("row"))
    landed = rows.withColumn("_b", begun).filter("what = 'landed' AND _b.spell_id = spell_id")
    first = landed.groupBy(*OWNER, "spell_id", F.col("_b.row").alias("_start")).agg(F.min_by(F.col("ts") - F.col("_b.ts"), "row").alias("took"))
    return first.groupBy(*OWNER, "spell_id").agg(F.max("took").alias("longest"))


def _until(stop: Column, limit: Column) -> Column:
    """The end of what began at ts, stopped at ``stop`` (or never) and over by ``limit``."""
    return F.least(F.greatest(F.coalesce(stop, limit), F.col("ts")), limit)


def casting(ctx: Context, dim: DataFrame) -> DataFrame:
    """Bars, channels and presses of every member: start, end, finished, died, kicked.

    ``dim`` has spell_id, gcd_ms, channel_ms (null: no channel; 0: of unknown length) and button.
    """
    rows = cast_rows(ctx, dim)
    done = labelled(rows)
    # the next fading of the same spell, by the order turned round
    back = W.partitionBy(*OWNER, "spell_id").orderBy(F.desc("row")).rowsBetween(W.unboundedPreceding, -1)
    done = done.withColumn("_faded", F.last(F.when(F.col("what") == "faded", F.col("ts")), ignorenulls=True).over(back))
    w = W.partitionBy(*OWNER).orderBy("row")
    edge = done.filter("effect IN ('opens', 'finishes', 'fails', 'presses', 'dies')").withColumns({"_stop": F.lead("ts").over(w), "_by": F.lead("effect").over(w)})
    out = lambda kind, end, finished, died: (*OWNER, F.lit(kind).alias("kind"), "spell_id", "row", F.col("ts").alias("start"), end.alias("end"), finished.alias("finished"), died.alias("died"))
    complete = F.coalesce(F.col("_by") == "finishes", F.lit(False))
    most = F.when(complete, MAX_BAR_MS).otherwise(F.least(F.coalesce("longest", F.lit(UNCLOSED_BAR_MS)), F.lit(MAX_BAR_MS)))
    bars = edge.filter("effect = 'opens'").join(longest_finish(rows), [*OWNER, "spell_id"], "left").withColumn("_limit", F.col("ts") + most)
    dies = F.coalesce((F.col("_by") == "dies") & (F.col("_stop") <= F.col("_limit")), F.lit(False))
    bars = bars.select(*out("bar", _until(F.col("_stop"), F.col("_limit")), complete, dies))
    length = F.when(F.col("channel_ms") > 0, F.col("channel_ms")).otherwise(OPEN_CHANNEL_MS)
    channels = edge.filter("effect = 'presses' AND channel_ms IS NOT NULL").withColumn("_limit", F.col("ts") + length)
    faded = F.coalesce(F.col("_faded") < F.coalesce("_stop", F.col("_faded") + 1), F.lit(False))
    channels = channels.select(*out("channel", _until(F.least("_stop", "_faded"), F.col("_limit")), F.lit(True), dies & ~faded))
    presses = done.filter("effect IN ('finishes', 'presses', 'free')").select(*out("press", F.col("ts"), F.lit(True), F.lit(False)))
    kicks = ctx.events.filter("code = 'SPELL_INTERRUPT'").select("run_id", F.col("dst").alias("actor"), "ts")
    broken = bars.filter("NOT finished").select(*OWNER, F.col("end").alias("ts"), "row")
    unkicked = pairing.without_near(broken, kicks, OWNER, "ts", "row", KICK_MS).select("row", F.lit(False).alias("_kicked"))
    bars = bars.join(unkicked, "row", "left").withColumn("kicked", ~F.col("finished") & F.coalesce("_kicked", F.lit(True))).drop("_kicked")
    rest = channels.unionByName(presses).withColumn("kicked", F.lit(False))
    return bars.unionByName(rest).drop("row")


def casting_report(cast: DataFrame) -> DataFrame:
    """Presses, bars and bars given up (neither kicked nor cut short by death) per member."""
    bar, lost = F.col("kind") == "bar", ~F.col("finished") & ~F.col("kicked") & ~F.col("died")
    return cast.groupBy("run_id", "actor").agg(F.count_if(F.col("kind") == "press").alias("presses"), F.count_if(F.col("kind") != "press").alias("bars"), F.count_if(bar & lost).alias("cancelled"))
