"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

A document's seeded hash puts it into one of ``BLOCKS`` blocks of its source, so the blocks in index
order are a random permutation of the source. A source's target is met by whole passes over its
blocks (each pass in an order of its own) and the first blocks of one more pass; the blocks of all
passes, one after the other, are the source's places, and those that the target needs its quota. A
binary tree over the output shards splits all sources' quotas at once, each node by one multivariate
hypergeometric draw. A shard draws a run of each source's places, disjoint from the other shards',
and shuffles what it gets; a place in no shard's run is not taken. Of the blocks around the end of
the last pass single documents are taken, chosen to fill the rest of the target. Where a block holds
many documents that end is searched in parts of the block, ``BLOCKS`` at a time, until a part holds
few: nothing that is sorted or filled in one task grows with the source.

Edge cases: a null text has size 0; a document of size 0 follows its block and adds nothing. Null is a
source of its own, last in order. Rows with equal id, text and source share one decision, and each is
taken. Sources of size 0 have target 0. An empty table gives an empty result. The driver holds a row
per source and the tree's shards x sources counts.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window as W

from millrace.llm.shards import draw
from millrace.llm.store import Workspace
from millrace.session import table

WEIGHTS = (1, 2, 3)  # by source order, repeating
MAX_PASSES = 3  # a target is at most so many times its source
BLOCK_BITS = 12
BLOCKS = 1 << BLOCK_BITS
PART_DOCS = 1024  # a block or part with more documents is searched in parts
TAIL_DOCS = 1024  # documents after the last whole part that may fill the rest (one part at least)
LAST_DOCS = 256  # documents before it that may be exchanged for others
SWAPS = 8
SHARDS = 24
SEED = 5
BROADCAST_SOURCES = 100_000
PART_WORDS = 1 << 26  # words (and documents) of the mix that one task orders, about


def targets(sizes: list[int], weights: tuple[int, ...] = WEIGHTS, most: int = MAX_PASSES) -> list[float]:
    """Targets of the sources (in order): shares of the total by weight, capped, the excess reshared."""
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    out, open_, left = [0.0] * len(sizes), set(range(len(sizes))), float(sum(sizes))
    while open_:
        share = left / sum(w[i] for i in open_)
        full = {i for i in open_ if w[i] * share > most * sizes[i]}
        for i in full or open_:
            out[i] = float(most * sizes[i]) if full else w[i] * share
        open_ -= full or open_
        left -= sum(out[i] for i in full)
    return out


def _words() -> Column:
    return F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _keyed(df: DataFrame, seed: int) -> DataFrame:
    """``df`` with _src, size and _u, the seeded place of the row within its source (63 bits)."""
    df = df.drop("size").withColumns({"_src": F.coalesce(F.concat(F.lit("="), "source"), F.lit("")), "size": _words()})
    return df.withColumn("_u", F.shiftrightunsigned(F.xxhash64("doc_id", "text", "_src", F.lit(seed)), 1))


def _block(u: Column) -> Column:
    return F.shiftright(u, 63 - BLOCK_BITS)


class _End:
    """Where a source's last pass ends: all rows up to ``cut`` are taken (``inside`` words), some of those up to ``last``."""

    def __init__(self, rest: float):
        self.rest, self.low, self.bits, self.inside, self.cut, self.last = rest, 0, 63, 0, -1, -1

    def narrow(self, r) -> bool:
        """Takes in one round's row; True if a part has to be searched in parts of its own."""
        step = self.bits - min(BLOCK_BITS, self.bits)
        if r["at"] and r["at"]["docs"] > PART_DOCS and step:
            self.low, self.bits, self.inside = self.low + (r["at"]["bin"] << step), step, r["before"]
            return True
        self.cut, self.last, self.inside = self.low + ((r["cut"] + 1) << step) - 1, self.low + ((r["last"] + 1) << step) - 1, r["inside"]
        return False


def _ends(keys: DataFrame, bins: DataFrame, rest: dict[str, float]) -> dict[str, _End]:
    """The end of each source's last pass; ``bins`` are the first round's counts, by block."""
    spark, found = keys.sparkSession, {s: _End(r) for s, r in rest.items()}
    todo = [s for s, r in rest.items() if r > 0]
    while todo:
        fields = {"_src": (str, pa.string()), "rest": (float, pa.float64()), "low": (int, pa.int64()), "bits": (int, pa.int32()), "inside": (int, pa.int64())}
        rows = [(s, e.rest, e.low, e.bits, e.inside) for s in todo for e in (found[s],)]
        state = Plan._small(spark.createDataFrame(pa.table({c: pa.array([r[i] for r in rows], t[1]) for i, (c, t) in enumerate(fields.items())})), len(rows))
        if bins is None:
            step = F.expr(f"bits - least({BLOCK_BITS}, bits)")
            offset = F.col("_u") - F.col("low")
            within = keys.join(state, "_src").filter((offset >= 0) & (F.call_function("shiftright", offset, F.col("bits")) == 0))
            bins = within.groupBy("_src", F.call_function("shiftright", offset, step).alias("bin")).agg(F.sum("size").alias("words"), F.count("*").alias("docs"))
        upto = W.partitionBy("_src").orderBy("bin")  # BLOCKS rows at most
        run = bins.join(state, "_src").withColumns({"cum": F.col("inside") + F.sum("words").over(upto), "seen": F.sum("docs").over(upto)})
        fits = F.col("cum") <= F.col("rest")
        run = run.withColumn("fit", F.coalesce(F.max(F.when(fits, F.col("seen"))).over(W.partitionBy("_src")), F.lit(0)))
        whole = fits & (F.col("seen") <= F.col("fit") - LAST_DOCS)
        loose = ~whole & (F.col("seen") - F.col("docs") - F.col("fit") < TAIL_DOCS)
        got = run.groupBy("_src").agg(
            F.coalesce(F.max(F.when(whole, F.col("bin"))), F.lit(-1)).alias("cut"), F.coalesce(F.max(F.when(whole, F.col("cum"))), F.first("inside")).alias("inside"),
            F.coalesce(F.max(F.when(whole | loose, F.col("bin"))), F.lit(-1)).alias("last"), F.coalesce(F.max(F.when(fits, F.col("cum"))), F.first("inside")).alias("before"),
            F.min(F.when(~fits, F.struct("bin", "docs"))).alias("at"),
        )
        todo, bins = [r["_src"] for r in got.collect() if found[r["_src"]].narrow(r)], None
    return found


class Plan:
    """What to take: a row per source, the tree's quotas, and the single documents of each source's last pass."""

    def __init__(self, keys: DataFrame, shards: int = SHARDS, seed: int = SEED):
        spark = keys.sparkSession
        space = Workspace(spark, "mixture")
        self.shards, self.seed = shards, seed
        blocks = space.put(keys.groupBy("_src", _block(F.col("_u")).alias("bin")).agg(F.sum("size").alias("words"), F.count("*").alias("docs")), "blocks")
        size = {r["_src"]: r["w"] for r in blocks.groupBy("_src").agg(F.sum("words").alias("w")).collect()}
        self.order = sorted(size, key=lambda s: (s == "", s))
        docs = blocks.agg(F.coalesce(F.sum("docs"), F.lit(0))).first()[0]
        goal = dict(zip(self.order, targets([size[s] for s in self.order]), strict=True))
        passes = {s: min(MAX_PASSES, int(goal[s] / size[s] + 1e-12)) if size[s] else 0 for s in self.order}
        ends = _ends(keys, blocks, {s: max(0.0, goal[s] - passes[s] * size[s]) if passes[s] < MAX_PASSES else 0.0 for s in self.order})
        #: partitions of one shard; no document is taken more than MAX_PASSES times
        self.parts = max(2, -(-int(sum(goal.values()) + MAX_PASSES * docs) // (shards * PART_WORDS)))
        quota = [passes[s] * BLOCKS + (ends[s].last >> (63 - BLOCK_BITS)) + 1 for s in self.order]
        #: [shard, source]: the end of each shard's run of places, in order of shards
        self.runs = np.cumsum(split_tree(np.array(quota, dtype=np.int64), shards, np.random.default_rng(seed)), axis=0)
        columns = {
            "_src": pa.array(self.order, pa.string()), "source_size": pa.array([size[s] for s in self.order], pa.int64()), "target": pa.array([goal[s] for s in self.order], pa.float64()),
            "_passes": pa.array([passes[s] for s in self.order], pa.int32()), "_gap": pa.array([ends[s].rest - ends[s].inside for s in self.order], pa.float64()),
            "_cut": pa.array([ends[s].cut for s in self.order], pa.int64()), "_last": pa.array([ends[s].last for s in self.order], pa.int64()),
            "_runs": pa.array(list(self.runs.T), pa.list_(pa.int64())),
        }
        self.sources = self._small(spark.createDataFrame(pa.table(columns)), len(self.order))
        near = keys.join(self.sources, "_src").filter("_u > _cut AND _u <= _last AND size > 0 AND _gap > 0")
        near = near.groupBy("_src", "_u", "doc_id", "size").agg(F.count("*").alias("m"), F.first("_gap").alias("gap"))
        self.picks = space.put(near.groupBy("_src").applyInPandas(_fill, "_src string, _u bigint, doc_id bigint"), "picks")
        self.few = self.picks.count() <= BROADCAST_SOURCES

    @staticmethod
    def _small(df: DataFrame, rows: int) -> DataFrame:
        return F.broadcast(df) if rows <= BROADCAST_SOURCES else df

    def drawn(self, keyed: DataFrame) -> DataFrame:
        """A row per taken copy of ``keyed``'s rows, with the sources' columns, _pass and mix_shard: the shard whose run has its place."""
        picks = self.picks.withColumn("_picked", F.lit(1))
        picks = F.broadcast(picks) if self.few else picks
        on = (keyed["_src"] == picks["_src"]) & (keyed["_u"] == picks["_u"]) & keyed["doc_id"].eqNullSafe(picks["doc_id"])
        out = keyed.join(picks, on, "left").select(*(keyed[c] for c in keyed.columns), "_picked").join(self.sources, "_src")
        last = (F.col("_u") <= F.col("_cut")) | F.col("_picked").isNotNull()
        out = out.withColumn("_pass", F.explode(F.expr("sequence(0, _passes)"))).filter((F.col("_pass") < F.col("_passes")) | last)
        # each whole pass goes through the blocks in an order of its own (an odd multiplier permutes a power of two)
        own = F.pmod(_block(F.col("_u")) * (2 * F.col("_pass") + 1) * 1_640_531 + (F.col("_pass") + self.seed) * 977, F.lit(BLOCKS))
        place = F.col("_pass").cast("long") * BLOCKS + F.when(F.col("_pass") < F.col("_passes"), own).otherwise(_block(F.col("_u")))
        out = out.withColumn("_place", place).withColumn("mix_shard", F.expr("size(filter(_runs, e -> e <= _place))"))
        return out.filter(F.col("mix_shard") < self.shards).withColumn("mix_key", F.xxhash64("_u", "_pass", F.lit(self.seed)))


def _fill(rows: pd.DataFrame) -> pd.DataFrame:
    """The documents of one source's last stretch that fill its gap.

    In order, each that still fits is taken; then the best exchanges (one in for one out, or one
    more in) are made while they bring the sum nearer.
    """
    rows = rows.sort_values(["_u", "doc_id"], na_position="first")
    gap, need = float(rows["gap"].iloc[0]), (rows["size"] * rows["m"]).to_numpy()
    taken = np.zeros(len(rows), dtype=bool)
    for i, n in enumerate(need):
        if n <= gap:
            taken[i] = True
            gap -= n
    for _ in range(SWAPS):
        out, into = np.flatnonzero(taken), np.flatnonzero(~taken)
        if not len(into):
            break
        into = into[np.argsort(need[into], kind="stable")]
        lost = np.concatenate([[0], need[out]])  # 0: nothing goes out
        at = np.searchsorted(need[into], lost + gap)
        tries = [(abs(gap + x - need[into[j]]), k, j) for d in (-1, 0) for k, (x, j) in enumerate(zip(lost, np.clip(at + d, 0, len(into) - 1), strict=True))]
        best, k, j = min(tries)
        if best >= abs(gap):
            break
        taken[into[j]] = True
        if k:
            taken[out[k - 1]] = False
        gap += lost[k] - need[into[j]]
    return rows[taken][["_src", "_u", "doc_id"]]


def split_tree(quota: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """Quotas [shard, source]: each node of a binary tree over the shards draws its left side's blocks."""
    if shards == 1:
        return quota[None, :]
    left = shards // 2
    part = draw(rng, quota, int(quota.sum()) * left // shards)
    return np.concatenate([split_tree(part, left, rng), split_tree(quota - part, shards - left, rng)])


def _draws(df: DataFrame, shards: int, seed: int) -> tuple[DataFrame, Plan, DataFrame]:
    """(keys of ``df``'s rows, plan, drawn copies): the copies have ``df``'s columns, the keys, _pass, mix_shard and mix_key."""
    keyed = _keyed(df, seed)
    keys = Workspace(df.sparkSession, "mixture-keys").put(keyed.select("_src", "doc_id", "size", "_u"), "keys")
    plan = Plan(keys, shards, seed)
    return keys, plan, plan.drawn(keyed)


def mixed(df: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """The mix: ``df``'s rows as often as they are taken, with mix_shard and mix_key (the order within the shard).

    Each shard is in partitions of its own, as many as the mix's size asks for; see ``dealt``.
    """
    cols = [c for c in df.columns if c not in ("mix_shard", "mix_key")]
    _, plan, drawn = _draws(df.select(*cols), shards, seed)
    return dealt(drawn.select(*cols, "mix_shard", "mix_key"), shards, plan.parts)


def dealt(mix: DataFrame, shards: int, parts: int) -> DataFrame:
    """The mix in its place: each shard's keys cut into ``parts`` equal ranges, one after the other, each a sorted partition."""
    part = F.shiftright((F.shiftright("mix_key", 32) + (1 << 31)) * parts, 32).cast("int")
    return mix.repartitionById(parts * shards, F.col("mix_shard") * parts + part).sortWithinPartitions("mix_shard", "mix_key")


def digest(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """Every row's size, its source's size and target, the words the mix has of it, and the shards of its copies in the order of passes.

    The mix is made and written whole; sizes are counted on the texts read back from it.
    """
    keys, plan, drawn = _draws(docs, shards, seed)
    mix = Workspace(docs.sparkSession, "mixture-mix").put(dealt(drawn.select("doc_id", "text", "_src", "_u", "_pass", "mix_shard", "mix_key"), shards, plan.parts), "mix")
    # equal rows are taken in the same passes, so a row's copies are the distinct passes of its key
    copies = mix.withColumn("words", _words()).groupBy("_src", "_u", F.col("doc_id").alias("_id")).agg(F.array_sort(F.collect_set(F.struct("_pass", "mix_shard", "words"))).alias("_copies"))
    on = (keys["_src"] == copies["_src"]) & (keys["_u"] == copies["_u"]) & keys["doc_id"].eqNullSafe(copies["_id"])
    out = keys.join(copies, on, "left").select(keys["_src"], "doc_id", "size", F.coalesce("_copies", F.array()).alias("_copies")).join(plan.sources, "_src")
    taken = F.aggregate("_copies", F.lit(0).cast("long"), lambda n, c: n + c["words"])
    return out.select("doc_id", "size", "source_size", "target", taken.alias("taken"), F.transform("_copies", lambda c: c["mix_shard"]).alias("mix_shard"))


def op5_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's size, its source's size and target, and the words that the mix takes of it."""
    return digest(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the mix, each shard's rows together and in shuffled order."""
    return mixed(docs).select(*docs.columns)


QUERIES = {"op5_mixture": op5_mixture}
SQL: dict[str, str] = {}
