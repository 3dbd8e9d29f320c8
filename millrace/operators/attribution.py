"""Owner forests, counterpart-keyed segments, capped transfers, netting and breakdowns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window as W

from millrace.operators import pieces
from millrace.session import scratch, stored


def attribute_owner(actors: DataFrame, ident: str, owner: str, hops: int = 4) -> DataFrame:
    """(id, root): the last owner reached from each actor in at most ``hops`` steps.

    The actor table is a dimension; each hop is one equi-join that Catalyst may broadcast.
    """
    links = actors.select(F.col(ident).alias("_from"), F.col(owner).alias("_to")).filter("_to IS NOT NULL")
    out = actors.select(F.col(ident).alias("id"), F.col(ident).alias("root"))
    for _ in range(hops):
        out = out.join(links, F.col("root") == F.col("_from"), "left").select("id", F.coalesce("_to", "root").alias("root"))
    return out


def counterpart_segments(rows: DataFrame, run: str, enemy: str, ts: str, order: str, gap: int, rounds: int = 64) -> DataFrame:
    """(run, enemy, segment): the segment in which each counterpart was first engaged, named by its root counterpart.

    A counterpart's first row joins the segment of the counterpart of the row before it (in its run)
    if that row is at most ``gap`` earlier, else it opens a segment. So parents form a forest, whose
    roots are found by doubling the steps of a pointer (log of the depth joins) until none moves;
    one that still moves after ``rounds`` (beyond any depth, so a cycle by ties of ``order``) is an error.
    """
    # blocks of a run's rows, each with the row before it: no task sorts a run
    w = W.partitionBy(run, pieces.BLOCK).orderBy(order)
    cut = pieces.with_halo(rows.select(run, enemy, ts, order), [run], order, 1, 0, pieces.BLOCK_ROWS)
    marked = cut.withColumn("_prev", F.when(F.col(ts) - F.lag(ts).over(w) <= gap, F.lag(enemy).over(w))).filter(~F.col(pieces.HALO))
    marked = marked.withColumn("_first", F.row_number().over(W.partitionBy(run, enemy).orderBy(order)))
    up = marked.filter("_first = 1").select(run, F.col(enemy).alias("e"), F.coalesce("_prev", enemy).alias("p"))
    up = stored(up, scratch(rows.sparkSession), "links")  # each round reads it twice, and so does its plan
    held: list[DataFrame] = []
    for _ in range(rounds):
        jump = up.select(run, F.col("e").alias("p"), F.col("p").alias("q"))
        new = up.join(jump, [run, "p"]).select(run, "e", F.col("q").alias("p"), (F.col("q") != F.col("p")).alias("moved"))
        new = new.persist()
        moved = not new.filter("moved").isEmpty()
        up = new.select(run, "e", "p")
        held.append(new)
        for old in held[:-2]:  # spent: the round after next no longer reads it
            old.unpersist()
        if not moved:
            break
    else:
        raise RuntimeError(f"counterpart_segments: roots are not found after {rounds} rounds")
    return up.select(run, F.col("e").alias(enemy), F.col("p").alias("segment"))


def capped_transfer(claims: DataFrame, caps: DataFrame, keys: list[str], order: list[str], amount: str, cap: str) -> DataFrame:
    """Claims with ``moved``: what each takes, in order, of its key's cap until nothing is left. Claims of nothing or less are dropped."""
    w = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    taken = claims.filter(F.col(amount) > 0).withColumn("_before", F.coalesce(F.sum(amount).over(w), F.lit(0)))
    return taken.join(caps, keys).withColumn("moved", F.least(F.col(amount), F.greatest(F.col(cap) - F.col("_before"), F.lit(0)))).drop("_before")


def netted(gains: DataFrame, losses: DataFrame, keys: list[str], gain: str, loss: str) -> DataFrame:
    """Gains less the losses of the same key; a key with losses alone has no row."""
    out = gains.join(losses, keys, "left")
    return out.withColumn("net", F.col(gain) - F.coalesce(F.col(loss), F.lit(0)))


def effective(amount: Column, waste: Column) -> Column:
    """The amount less its waste, where there is waste above zero."""
    return F.when(waste > 0, amount - waste).otherwise(amount)


def breakdown(rows: DataFrame, actor: str, spell: str, amount: Column, waste: Column, crit: Column, seconds: float) -> DataFrame:
    """Per actor and spell: total, raw, wasted, hits, crits, crit_total, biggest, per_second and the share of all (by totals above zero)."""
    eff = effective(amount, waste)
    g = rows.groupBy(actor, spell).agg(
        F.sum(eff).alias("total"), F.sum(amount).alias("raw"), F.sum(F.greatest(waste, F.lit(0))).alias("wasted"), F.count("*").alias("hits"), F.count_if(crit).alias("crits"),
        F.sum(F.when(crit, eff).otherwise(0)).alias("crit_total"), F.max(eff).alias("biggest"),
    )
    all_ = g.agg(F.sum(F.greatest("total", F.lit(0))).alias("_all"))
    return g.join(F.broadcast(all_)).withColumns({"per_second": F.col("total") / seconds, "share": F.when(F.col("_all") > 0, F.col("total") / F.col("_all")).otherwise(0.0)}).drop("_all")


def merged_abilities(parts: DataFrame, actor: str, ability: str, spell: str, name: str) -> DataFrame:
    """Spells of one ability together: sums, the greatest hit, and the representative spell (the part named exactly like the ability, else the biggest)."""
    exact = (F.col(name) == F.col(ability)).cast("int")
    return parts.groupBy(actor, ability).agg(
        F.sum("total").alias("total"), F.sum("hits").alias("hits"), F.sum("crits").alias("crits"), F.max("biggest").alias("biggest"),
        F.max_by(spell, F.struct(exact, F.col("total"), -F.col(spell))).alias("representative"), F.count("*").alias("parts"),
    )


def lookback(anchors: DataFrame, rows: DataFrame, keys: list[str], ts: str, order: str, window: int) -> DataFrame:
    """(anchor, row columns): rows of the anchor's key with ts >= anchor - window and order at or before it.

    There is no upper bound on ts: order decides what came before. Rows and anchors meet in buckets of
    time, up to ``window`` after the anchor. Rows so far ahead of a later row's time (strays of a clock)
    that this could miss them are few; they are joined on the keys alone.
    """
    least = F.min(ts).over(W.partitionBy(*keys).orderBy(F.desc(order)).rowsBetween(W.unboundedPreceding, 0))
    r = rows.withColumn("_stray", F.col(ts) - least > window)
    a = anchors.select(*keys, F.col(ts).alias("_at"), F.col(order).alias("anchor"))
    near = a.withColumn("_b", F.explode(F.sequence(F.floor((F.col("_at") - window) / window), F.floor((F.col("_at") + window) / window))))
    both = near.join(r.filter("NOT _stray").withColumn("_b", F.floor(F.col(ts) / window)), [*keys, "_b"]).drop("_b")
    both = both.unionByName(a.join(r.filter("_stray"), keys))
    return both.filter((F.col(ts) >= F.col("_at") - window) & (F.col(order) <= F.col("anchor"))).drop("_at", "_stray")
