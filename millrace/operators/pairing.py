"""Actions and reactions: claims, orphans, exclusions and "since last kept" folds."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import repeat

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window as W

from millrace.operators import pieces

MAX_CHARGES = 32  # of an ability, where the table tells them


def near(a: DataFrame, b: DataFrame, keys: list[str], ts: str, before: int, after: int) -> DataFrame:
    """Rows (a.*, b.*) of equal keys with b.ts in [a.ts - before, a.ts + after], joined on keys and time buckets."""
    width = max(before + after, 1)
    lo, hi = F.floor((F.col(ts) - before) / width), F.floor((F.col(ts) + after) / width)
    x = a.withColumn("_b", F.explode(F.sequence(lo, hi))).alias("a")
    y = b.withColumn("_b", F.floor(F.col(ts) / width)).alias("b")
    same = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in [*keys, "_b"]]
    return x.join(y, same).filter((F.col(f"b.{ts}") >= F.col(f"a.{ts}") - before) & (F.col(f"b.{ts}") <= F.col(f"a.{ts}") + after))


def claims(presses: DataFrame, stops: DataFrame, keys: list[str], ts: str, order: str, slack: int, reach: int) -> DataFrame:
    """(keys, press, stop): each stop goes to the earliest press with the stop in [press - slack, press + reach].

    Walking the presses in order and giving each all unclaimed stops in reach yields the same claims.
    """
    both = near(presses.select(*keys, ts, order), stops.select(*keys, ts, order), keys, ts, slack, reach)
    return both.groupBy(*(F.col(f"a.{k}").alias(k) for k in keys), F.col(f"b.{order}").alias("stop")).agg(F.min(F.col(f"a.{order}")).alias("press")).select(*keys, "press", "stop")


def orphans(stops: DataFrame, claimed: DataFrame, order: str) -> DataFrame:
    """Stops that no press claimed."""
    return stops.join(claimed.select(F.col("stop").alias(order)), order, "left_anti")


def without_near(rows: DataFrame, others: DataFrame, keys: list[str], ts: str, order: str, within: int) -> DataFrame:
    """Rows with no other row of equal keys within ``within`` on either side."""
    both = near(rows.select(*keys, ts, order), others.select(*keys, ts), keys, ts, within, within).select(F.col(f"a.{order}").alias(order)).distinct()
    return rows.join(both, order, "left_anti")


def latest_before(rows: DataFrame, others: DataFrame, keys: list[str], ts: str, order: str, within: int) -> DataFrame:
    """(order, other): the latest other row of equal keys at most ``within`` before each row that has one."""
    both = near(rows.select(*keys, ts, order), others.select(*keys, ts, order), keys, ts, within, 0)
    return both.groupBy(F.col(f"a.{order}").alias(order)).agg(F.max_by(F.col(f"b.{order}"), F.struct(f"b.{ts}", f"b.{order}")).alias("other"))


def outcomes(presses: DataFrame, windows: DataFrame, keys: list[str], ts: str, order: str, aim: int, longest: int) -> DataFrame:
    """(order, outcome) of presses that stopped nothing, judged by the target's casts (start, end, ended).

    In order: the press lies in a cast (``ignored``; ``doubled`` if that cast was interrupted), a cast
    ended at most ``aim`` before (``doubled`` if interrupted, else ``late``), one starts at most
    ``aim`` after (``early``), else ``nothing``. Casts last at most ``longest``.
    """
    width = longest + 2 * aim
    k = [F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)]
    of, cast = [f"_k{i}" for i in range(len(keys))], F.struct("start", "end", "ended")
    reach = F.explode(F.sequence(F.floor((F.col("start") - aim) / width), F.floor((F.col("end") + aim) / width)))
    c = windows.filter("start <= end").dropna(subset=keys).select(*k, reach.alias("_b"), "start", "end", "ended")
    p = presses.select(*k, F.floor(F.col(ts) / width).alias("_b"), F.col(ts).alias("_t"), F.lit(1).alias("_side"), F.col(order).alias("_row"))
    # at one time: casts that start, presses, casts that end
    starts, ends = (c.select(*of, "_b", F.col(t).alias("_t"), F.lit(side).alias("_side"), cast.alias("_c")) for t, side in (("start", 0), ("end", 2)))
    both = p.unionByName(starts, allowMissingColumns=True).unionByName(ends, allowMissingColumns=True)
    on, off = F.when(F.col("_side") == 0, F.col("_c")), F.when(F.col("_side") == 2, F.col("_c"))
    so_far = W.partitionBy(*of, "_b").orderBy("_t", "_side", "_c").rowsBetween(W.unboundedPreceding, 0)
    to_come = W.partitionBy(*of, "_b").orderBy(F.desc("_t"), F.desc("_side"), F.desc("_c")).rowsBetween(W.unboundedPreceding, 0)
    last = lambda x, w: F.last(x, ignorenulls=True).over(w)
    seen = both.withColumns({"_begun": last(on, so_far), "_most": F.max(on["end"]).over(so_far), "_done": last(off, so_far)}).withColumn("_next", last(on, to_come)).filter("_side = 1")
    # the cast begun last holds the press if any does, unless it lies within an older one that is still open: those presses alone meet all casts around them
    nested = (F.col("_begun.end") < F.col("_t")) & (F.col("_most") >= F.col("_t"))
    odd = seen.filter(nested).select(*of, F.col("_t").alias(ts), "_row")
    older = near(odd, windows.select(*k, F.col("start").alias(ts), "start", "end", "ended"), of, ts, longest, 0).filter(F.col("b.end") >= F.col(f"a.{ts}"))
    older = older.groupBy(F.col("a._row").alias("_row")).agg(F.max(F.struct("b.start", "b.end", "b.ended")).alias("_older"))
    seen = seen.join(older, "_row", "left")
    held = F.coalesce("_older", F.when(F.col("_begun.end") >= F.col("_t"), F.col("_begun")))
    done, then = F.when(F.col("_done.end") >= F.col("_t") - aim, F.col("_done")), F.when(F.col("_next.start") <= F.col("_t") + aim, F.col("_next"))
    name = F.when(held.isNotNull(), F.when(held["ended"] == "interrupted", "doubled").otherwise("ignored")).when(done.isNotNull(), F.when(done["ended"] == "interrupted", "doubled").otherwise("late"))
    return seen.select(F.col("_row").alias(order), name.when(then.isNotNull(), "early").otherwise("nothing").alias("outcome"))


def kept_apart(df: DataFrame, keys: list[str], ts: str, order: str, least: int, change: str | None = None) -> DataFrame:
    """Rows at least ``least`` after the last *kept* row of their key (or where ``change`` differs from it).

    Each decision depends on the one before, which no window expresses. A row that comes ``least`` or more after all
    rows before it is kept whatever was kept before: a key is cut there, and its pieces are folded side by side.
    """
    cols = df.columns
    first = F.row_number().over(W.partitionBy(*keys, pieces.PIECE).orderBy(order)) == 1
    rows = pieces.with_pieces(df, keys, ts, order, least).withColumn("_first", first)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = place = None  # a piece goes on from one batch to the next
        for b in batches:
            marks, keep = b.column(change).to_pylist() if change else repeat(None, b.num_rows), []
            for t, m, new in zip(b.column(ts).to_pylist(), marks, b.column("_first").to_pylist(), strict=True):
                take = new or (t is not None and last is not None and t - last >= least) or m != place
                keep.append(take)
                if take:
                    last, place = t, m
            yield b.filter(pa.array(keep, pa.bool_())).select(cols)

    # the window leaves each piece's rows together and in order, so tasks read them as a stream
    return rows.mapInArrow(fold, df.schema)


def charge_clock(uses: DataFrame, keys: list[str], ts: str, order: str, recovery: int | str, charges: int | str) -> DataFrame:
    """Each use with ``ready_at``, when a charge is next available after it; ``recovery`` and ``charges`` are numbers or columns, one value a key.

    Charges recover one at a time, so the i-th spent one is back at b(i) = max(t(i), b(i - 1)) + recovery, which is
    i * recovery + the greatest t(j) - (j - 1) * recovery of j up to i. After use i a charge is there once the use
    ``charges`` - 1 before it is back. Windows sort and spill; no key's rows are held.
    """
    wait, held = (F.col(c) if isinstance(c, str) else F.lit(c) for c in (recovery, charges))
    w = W.partitionBy(*keys).orderBy(order)
    rows = uses.withColumns({"_i": F.row_number().over(w), "_wait": wait.cast("long"), "_held": F.greatest(held.cast("int"), F.lit(1))})
    rows = rows.withColumn("_back", F.col("_i") * F.col("_wait") + F.max(F.col(ts) - (F.col("_i") - 1) * F.col("_wait")).over(w.rowsBetween(W.unboundedPreceding, 0)))
    most = charges if isinstance(charges, int) else None
    if most:
        due = F.lag("_back", max(most, 1) - 1).over(w)
    else:  # as many charges as the key has: the use that many places before, met by its number
        due = F.element_at(F.collect_list("_back").over(w.rowsBetween(-MAX_CHARGES + 1, 0)), -F.col("_held"))
        due = F.when(F.col("_i") >= F.col("_held"), due)
    ready = F.greatest(F.col(ts), F.coalesce(due, F.col(ts))).cast("long")
    return rows.withColumn("ready_at", ready).drop("_i", "_wait", "_held", "_back")


def folded(df: DataFrame, keys: list[str], ts: str, order: str, gap: int, step: Callable, state: Callable, schema: str) -> DataFrame:
    """A fold whose state means nothing ``gap`` after the last row: ``step(state, row)`` returns (state, rows out) over a key's rows in order.

    A key is cut at rows that lie ``gap`` or more after all rows before them, and its pieces are folded side by side.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        now, out = state(), []
        for row in rows.sort_values(order, kind="stable").to_dict("records"):
            now, more = step(now, row)
            out += more
        return pd.DataFrame(out, columns=[f.strip().split()[0] for f in schema.split(",")])

    return pieces.with_pieces(df, keys, ts, order, gap).groupBy(*keys, pieces.PIECE).applyInPandas(run, schema)


def claimed_fifo(waiting: DataFrame, offers: DataFrame, keys: list[str], ts: str, order: str, within: int) -> DataFrame:
    """(waiting, offer): each waiting row takes the first later offer within ``within``; one claim each, first come first served."""
    rows = waiting.select(*keys, ts, order, F.lit(0).alias("kind")).unionByName(offers.select(*keys, ts, order, F.lit(1).alias("kind")))

    def step(queue: list, row: dict):
        queue = [q for q in queue if row[ts] - q[0] <= within]
        if row["kind"] == 0:
            return [*queue, (row[ts], row[order])], []
        return (queue[1:], [(queue[0][1], row[order])]) if queue else (queue, [])

    return folded(rows, keys, ts, order, within + 1, step, list, "waiting long, offer long")
