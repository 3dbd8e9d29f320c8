"""What a reader of a run sees: party order, points, merged abilities with uptime, ranked lines of text, overlapping segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window as W

from millrace.functions.text import ability_name, percent, short_name, short_number
from millrace.operators import attribution, intervals, ranking
from millrace.plans.badges import HEALER_SPECS
from millrace.plans.reports import TANK_SPECS

CHAT, LINES = 255, 10
DAMAGE_POINTS, HEALING_POINTS = 10, 5


def role(spec: Column) -> Column:
    """tank, healer or dps by the spec; unknown specs are dps."""
    return F.when(F.coalesce(spec.isin(*TANK_SPECS), F.lit(False)), "tank").when(F.coalesce(spec.isin(*HEALER_SPECS), F.lit(False)), "healer").otherwise("dps")


def party_order(party: DataFrame) -> DataFrame:
    """The party with role and shown_at: tanks, healers, then the rest, each in order of announcement."""
    rank = F.when(F.col("role") == "tank", 0).when(F.col("role") == "healer", 1).otherwise(2)
    return party.withColumn("role", role(F.col("spec_id"))).withColumn("shown_at", F.row_number().over(W.partitionBy("run_id").orderBy(rank, "place")))


def damage_points(party: DataFrame, most: int = DAMAGE_POINTS, value: str = "value") -> DataFrame:
    """``party`` (run_id, guid, role, value) with points.

    Shares run from the last dps up; each place among the dps is worth a step at least. A tank who did
    more than a dps takes at least that dps's points, who then has none. With one dps or none, points are plain shares.
    """
    w = W.partitionBy("run_id")
    dps = F.col("role") == "dps"
    n, floor = F.count_if(dps).over(w), F.coalesce(F.min(F.when(dps, F.col(value))).over(w), F.lit(0.0))
    p = party.withColumns({"_n": n, "_floor": F.when(n >= 2, floor).otherwise(0.0), "_top": F.max(value).over(w)})
    part = F.when((F.col(value) > F.col("_floor")) & (F.col("_top") > F.col("_floor")), F.floor(most * (F.col(value) - F.col("_floor")) / (F.col("_top") - F.col("_floor")) + 0.5)).otherwise(0)
    place = F.rank().over(W.partitionBy("run_id", "role").orderBy(F.desc(value)))
    step = F.when(dps & (F.col("_n") >= 2) & (F.col(value) > 0), F.floor(most * (F.col("_n") + 1 - place) / F.col("_n") + 0.5)).otherwise(0)
    p = p.withColumn("points", F.greatest(part, step).cast("long"))
    tanks, others = p.filter("role = 'tank' AND _n >= 2"), p.filter("role = 'dps' AND _n >= 2")
    pair = tanks.select("run_id", F.col("guid").alias("tank"), F.col(value).alias("_t")).join(others.select("run_id", F.col("guid").alias("dps"), F.col(value).alias("_d"), "points"), "run_id").filter("_d < _t")
    best = pair.groupBy("run_id", F.col("tank").alias("guid")).agg(F.max("points").alias("_taken"))
    gone = pair.select("run_id", F.col("dps").alias("guid")).distinct().withColumn("_outdone", F.lit(True))
    out = p.join(best, ["run_id", "guid"], "left").join(gone, ["run_id", "guid"], "left")
    points = F.when(F.col("_outdone"), 0).otherwise(F.greatest("points", F.coalesce("_taken", F.lit(0))))
    return out.withColumn("points", points.cast("long")).drop("_n", "_floor", "_top", "_taken", "_outdone")


def by_ability(parts: DataFrame, uptime: DataFrame | None = None) -> DataFrame:
    """A breakdown with the spells of one ability together; with ``uptime`` (run_id, actor, spell_id, up), the longest of its spells."""
    p = parts.withColumn("ability", ability_name(F.col("spell"))).withColumn("who", F.struct("run_id", "actor"))
    merged = attribution.merged_abilities(p, "who", "ability", "spell_id", "spell").select("who.*", "*").drop("who")
    if uptime is None:
        return merged
    up = p.join(uptime.select("run_id", "actor", "spell_id", "up"), ["run_id", "actor", "spell_id"]).groupBy("run_id", "actor", "ability").agg(F.max("up").alias("up"))
    return merged.join(up, ["run_id", "actor", "ability"], "left")


def overlapping(spans: DataFrame, width: int = 60_000) -> DataFrame:
    """(run_id, a, b): pairs of a run's segments that touch in time."""
    return intervals.overlaps(spans.filter("start IS NOT NULL AND end IS NOT NULL"), ["run_id"], "segment", width)


def cut(line: Column, limit: int = CHAT) -> Column:
    """A line no longer than the limit: cut at its last space before it (or there, without one), with an ellipsis."""
    head = F.substring(line, 1, limit)
    at = F.length(head) - F.locate(" ", F.reverse(head)) + 1
    kept = F.when(F.locate(" ", F.reverse(head)) > 0, F.substring(line, F.lit(1), (at - 1).cast("int"))).otherwise(F.substring(line, 1, limit - 1))
    return F.when(F.length(line) <= limit, line).otherwise(F.concat(kept, F.lit("…")))


def ranked_line(place: Column, body: Column, details: Column, limit: int = CHAT) -> Column:
    """``place. body: detail, detail``: details are dropped from the first that would pass the limit on."""
    start = F.concat(place.cast("string"), F.lit(". "), body)
    zero = F.struct(start.alias("line"), F.lit(True).alias("room"), F.lit(0).alias("n"))

    def step(now: Column, detail: Column) -> Column:
        longer = F.concat(now["line"], F.when(now["n"] == 0, ": ").otherwise(", "), detail)
        fits = now["room"] & (F.length(longer) <= limit)
        return F.struct(F.when(fits, longer).otherwise(now["line"]).alias("line"), fits.alias("room"), (now["n"] + 1).alias("n"))

    return cut(F.aggregate(F.coalesce(details, F.array().cast("array<string>")), zero, step)["line"], limit)


def share_lines(totals: DataFrame, value: str, details: str | None = None, limit: int = LINES) -> DataFrame:
    """The ranked top members of a run (run_id, guid, name, ``value``, ``details``: an array of texts) as lines of text."""
    w = W.partitionBy("run_id")
    t = totals.filter(F.col(value) > 0).withColumns({"_r": F.row_number().over(w.orderBy(F.desc(value), "guid")), "_all": F.sum(value).over(w)}).filter(F.col("_r") <= limit)
    body = F.concat(short_name(F.col("name")), F.lit(" "), short_number(F.col(value)), F.lit(" ("), percent(F.col(value) / F.col("_all"), 0), F.lit(")"))
    return t.select("run_id", F.col("_r").alias("place"), ranked_line(F.col("_r"), body, F.col(details) if details else F.lit(None).cast("array<string>")).alias("line"))


def standings(points: DataFrame) -> DataFrame:
    """Members of each run (run_id, guid, points by category) by the sum of their points, ties sharing a place."""
    return ranking.standings(points, ["run_id"], "guid")
