"""Sharding by a hypergeometric communication matrix: a uniform shuffle into shards of exact sizes.

Every input partition counts its rows. The driver draws the matrix (partition x shard) of row
counts: one multivariate hypergeometric draw per partition from the shards' remaining room, so that
row sums are the partitions' counts and column sums the shards' sizes (at most one apart). Each
partition then permutes its rows locally and deals them out by its matrix row; one exchange brings
a shard's rows together, and a second permutation within the shard gives each row its slot. A large
shard is permuted in blocks: a row's block comes from its hash, blocks are counted and laid one
after the other, so no task holds a whole shard.

Edge cases: null ids and texts are hashed like other values; an empty table gives an empty result;
identical rows are interchangeable and each gets a slot of its own. Columns named shard or slot
are replaced, others pass through. Reruns over the same files agree.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window as W

from millrace.llm.store import Workspace
from millrace.session import table

SHARDS = 24
SEED = 20_240_229
BLOCK_ROWS = 65_536  # rows of a shard permuted in one task, about
MATRIX_BYTES = 256 << 20  # of the communication matrix, up to which each executor gets it whole
_EXACT = 10**9  # numpy draws hypergeometric counts exactly below this population
SPREAD = 12  # standard deviations either side that a larger draw covers


def draw(rng: np.random.Generator, room: np.ndarray, n: int) -> np.ndarray:
    """How many of n rows go to each shard, uniformly over all ways to fill the room left."""
    if room.sum() < _EXACT:
        return rng.multivariate_hypergeometric(room, n, method="marginals")
    out, left = np.zeros_like(room), int(room.sum())
    for i, r in enumerate(map(int, room)):
        out[i] = _count(rng, r, left - r, n)
        n, left = n - int(out[i]), left - r
    return out


def _count(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """A hypergeometric count for any population: how many of n rows drawn from good + bad are good.

    By inversion. The chances are products of the ratios of neighbours, outward from the mode; they
    are summed as far as ``SPREAD`` standard deviations (beyond, all are below a double's resolution).
    """
    total, low, high = good + bad, max(0, n - bad), min(good, n)
    if low == high:
        return low
    if total < _EXACT:
        return int(rng.hypergeometric(good, bad, n))
    mode = min(max((n + 1) * (good + 1) // (total + 2), low), high)
    sd = (n * good * bad * (total - n) / total**2 / (total - 1)) ** 0.5
    reach = int(SPREAD * sd) + 2 * SPREAD
    up = np.arange(mode, min(high, mode + reach), dtype=float)
    down = np.arange(mode, max(low, mode - reach), -1, dtype=float)
    above = np.cumprod((good - up) / (up + 1) * ((n - up) / (bad - n + up + 1)))
    below = np.cumprod(down / (good - down + 1) * ((bad - n + down) / (n - down + 1)))
    chance = np.cumsum(np.concatenate([below[::-1], [1.0], above]))
    return mode - len(below) + int(np.searchsorted(chance, rng.random() * chance[-1], "right"))


def matrix(counts: list[int], shards: int, seed: int) -> np.ndarray:
    """The communication matrix [partition, shard]; columns sum to sizes at most one apart."""
    total = sum(counts)
    room = np.array([total // shards + (k < total % shards) for k in range(shards)], dtype=np.int64)
    rng, out = np.random.default_rng(seed), np.zeros((len(counts), shards), dtype=np.int64)
    for p, n in enumerate(counts):
        out[p] = draw(rng, room, n)
        room -= out[p]
    return out


def _replays(df: DataFrame) -> bool:
    """Whether each run over ``df`` sees the same rows in the same partitions: a scan, projected or filtered."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return all(re.match(r"[\s:+\-|]*(Project|Filter|Relation|LocalRelation)\b", line) for line in plan.strip().splitlines()) and "rand(" not in plan


def shuffled(df: DataFrame, shards: int = SHARDS, seed: int = SEED, key: tuple[str, ...] = ("doc_id", "text")) -> DataFrame:
    """``df`` with shard (from 0) and slot (gapless from 0 within the shard)."""
    spark, df = df.sparkSession, df.drop("shard", "slot")
    if not _replays(df):
        df = Workspace(spark, "shards").put(df, "input")
    counts = {r["p"]: r["count"] for r in df.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()}  # a row per partition
    parts = sorted(counts)
    m = matrix([counts[p] for p in parts], shards, seed)
    ends = spark.createDataFrame(pa.table({"_p": pa.array(parts, pa.int64()), "_ends": pa.array(list(np.cumsum(m, axis=1)), pa.list_(pa.int64()))}))
    if m.nbytes <= MATRIX_BYTES:  # else a shuffle join: slower, the same result
        ends = F.broadcast(ends)
    keys = [F.xxhash64(*key, F.lit(seed + i)).alias(name) for i, name in enumerate(("_first", "_again"))]
    local = df.select("*", *keys).sortWithinPartitions("_first").withColumn("_id", F.monotonically_increasing_id())
    local = local.withColumns({"_p": F.shiftright("_id", 33), "_rank": F.col("_id").bitwiseAND(2**33 - 1)})
    dealt = local.join(ends, "_p").withColumn("shard", F.expr("size(filter(_ends, e -> e <= _rank))"))
    dealt = dealt.withColumn("shard", F.when(F.col("shard") < shards, F.col("shard")).otherwise(F.raise_error(F.lit("a partition changed between two reads")).cast("int")))
    blocks = max(1, -(-int(m.sum()) // shards // BLOCK_ROWS))
    dealt = dealt.withColumn("_block", F.pmod("_again", F.lit(blocks)).cast("int"))
    slot = (F.row_number().over(W.partitionBy("shard", "_block").orderBy("_again", "_first")) - 1).cast("long")
    out = dealt.drop("_id", "_p", "_rank", "_ends")
    if blocks == 1:
        return out.withColumn("slot", slot).drop("_first", "_again", "_block")
    held = dealt.groupBy("shard", "_block").count()
    before = W.partitionBy("shard").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    starts = held.select("shard", "_block", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    return out.withColumn("slot", slot).join(starts, ["shard", "_block"]).withColumn("slot", F.col("slot") + F.col("_start")).drop("_first", "_again", "_block", "_start")


def op9_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard and slot under the law ``rows``."""
    out = shuffled(table(spark, sf_dir, "documents").select("doc_id", "text"))
    text = F.coalesce("text", F.lit("")).cast("binary")  # as it arrived in its shard
    size, crc = (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32")
    return out.select("doc_id", size, crc, F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every row with its shard and slot."""
    return shuffled(docs)


QUERIES = {"op9_shards": op9_shards}
SQL: dict[str, str] = {}
