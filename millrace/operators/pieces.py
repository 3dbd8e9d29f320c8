"""Order-dependent work cut into pieces that tasks can do side by side.

Rows of a key are cut into blocks by their order. What a block must know of the rows before it is a small summary
of each block (a carry), scanned in order; rows that a frame of fixed size must see beyond the block's edge are
copied to it (a halo). No window is partitioned by the key alone but those over the carries, one row a block.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.window import Window as W

BLOCK_ROWS = 65_536
BLOCK, HALO, PIECE, PART = "_block", "_halo", "_piece", "_part"


def carried(blocks: DataFrame, keys: list[str], value: Column, name: str, *, running: str) -> DataFrame:
    """``blocks`` (one row a key and block) with ``name``: the greatest (``running`` is max) or last value of the blocks before."""
    before = W.partitionBy(*keys).orderBy(BLOCK).rowsBetween(W.unboundedPreceding, -1)
    return blocks.withColumn(name, (F.max(value) if running == "max" else F.last(value, ignorenulls=True)).over(before))


def looked_up(df: DataFrame, small: DataFrame, keys: list[str], name: str) -> DataFrame:
    """``df`` with the column of its key and block; null keys meet null keys."""
    named = small.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate([*keys, BLOCK])), name)
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate([*keys, BLOCK])]
    return df.join(named, same, "left").drop(*(f"_k{i}" for i in range(len(same))))


def with_pieces(df: DataFrame, keys: list[str], ts: str, order: str | list[str], gap: int | Column, *, reach: str | None = None, block_ms: int = 600_000) -> DataFrame:
    """``df`` with ``_piece``: a key's rows cut into stretches, each beginning with a row that lies ``gap`` or more after all rows before it.

    At such a row whatever looks back less than the gap starts anew, so a fold by (keys, piece) equals the fold by keys.
    There are many such rows; a piece has those of one block and all that follows them, so pieces are about as large as blocks.
    With ``reach`` a row counts as lasting until then (spans). Blocks are stretches of ``block_ms`` of ``ts``; ``order`` sorts rows.
    """
    sort, until = [order] if isinstance(order, str) else order, reach or ts
    by_time = [ts, *(c for c in sort if c != ts)] if reach else sort
    # blocks follow the order: of time where rows are sorted by it, of rows otherwise
    rows = df.withColumn(BLOCK, F.floor(F.col(ts) / block_ms) if by_time[0] == ts else F.floor(F.col(by_time[0]) / BLOCK_ROWS))
    inside = W.partitionBy(*keys, BLOCK).orderBy(*by_time)
    most = carried(rows.groupBy(*keys, BLOCK).agg(F.max(until).alias("_most")), keys, F.col("_most"), "_carry", running="max")
    rows = looked_up(rows, most, keys, "_carry")
    before = F.greatest(F.max(until).over(inside.rowsBetween(W.unboundedPreceding, -1)), F.col("_carry"))
    rows = rows.withColumn("_before", before)
    begins = F.col("_before").isNull() | (F.col(ts) - F.col("_before") >= gap)
    rows = rows.withColumn("_begins", F.when(begins, F.col(BLOCK)))
    last = carried(rows.groupBy(*keys, BLOCK).agg(F.max("_begins").alias("_last")), keys, F.col("_last"), "_open", running="last")
    rows = looked_up(rows, last, keys, "_open")
    piece = F.coalesce(F.last("_begins", ignorenulls=True).over(inside.rowsBetween(W.unboundedPreceding, 0)), F.col("_open"))
    return rows.withColumn(PIECE, piece).drop(BLOCK, "_carry", "_before", "_begins", "_open")


def with_halo(df: DataFrame, keys: list[str], order: str, before: int, after: int, size: int = BLOCK_ROWS) -> DataFrame:
    """``df`` with ``_block`` and ``_halo``: each block of a key's rows, with copies (halo rows) of so many rows before and after it.

    A frame of at most ``before`` rows back and ``after`` rows ahead, partitioned by keys and ``_block``, sees what it would see in the whole key;
    rows of the halo are dropped after it.
    """
    rows = df.withColumn(BLOCK, F.floor(F.col(order) / size))
    inside = W.partitionBy(*keys, BLOCK)
    up, down = F.row_number().over(inside.orderBy(order)), F.row_number().over(inside.orderBy(F.desc(order)))
    edge = rows.withColumns({"_up": up, "_down": down}).filter((F.col("_up") <= max(after, 1)) | (F.col("_down") <= max(before, 1)))
    row = F.struct(*(F.col(c) for c in df.columns))
    along = W.partitionBy(*keys).orderBy(order)
    # edges alone: a block's are its first and last rows, so the rows next to a block are the edge rows next to it
    behind = F.when(F.col("_up") == 1, F.collect_list(row).over(along.rowsBetween(-before, -1))) if before else F.lit(None)
    ahead = F.when(F.col("_down") == 1, F.collect_list(row).over(along.rowsBetween(1, after))) if after else F.lit(None)
    none = F.array().cast(f"array<{df.schema.simpleString()}>")
    seen = edge.withColumns({"_behind": F.coalesce(behind, none) if before else none, "_ahead": F.coalesce(ahead, none) if after else none})
    halo = seen.filter((F.size("_behind") > 0) | (F.size("_ahead") > 0)).select(BLOCK, F.explode(F.concat("_behind", "_ahead")).alias("_r")).select("_r.*", BLOCK)
    return rows.withColumn(HALO, F.lit(False)).unionByName(halo.withColumn(HALO, F.lit(True)))


def met(points: DataFrame, spans: DataFrame, keys: list[str], order: list[str], run: Callable, schema: T.StructType) -> DataFrame:
    """``run(points, spans)``, Arrow tables of a key in and out, over blocks of both, so that no task holds more than a block of each.

    Spans are cut in their order (``_part`` numbers a key's blocks from 0), points by their number ``_p``; a point meets each
    block of its key, and one whose key has no spans meets none of them once. The caller merges what a point's blocks tell.
    """
    many = lambda df, name: df.groupBy(*(F.col(c).alias(f"_m{i}") for i, c in enumerate(keys))).agg(F.ceil(F.count("*") / BLOCK_ROWS).alias(name))
    on = [F.col(c).eqNullSafe(F.col(f"_m{i}")) for i, c in enumerate(keys)]
    drop, to = [f"_m{i}" for i in range(len(keys))], lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(n, F.lit(1)) - 1))
    parts, chunks = many(spans, "_parts"), many(points, "_chunks")
    p = points.withColumn("_p", F.monotonically_increasing_id()).join(parts, on, "left").drop(*drop).join(chunks, on, "left").drop(*drop)
    p = p.withColumn(PART, to(F.col("_parts"))).withColumn("_chunk", F.pmod(F.hash("_p"), F.col("_chunks"))).drop("_parts", "_chunks")
    nth = F.row_number().over(W.partitionBy(*keys).orderBy(*order)) - 1
    s = spans.withColumn(PART, F.floor(nth / BLOCK_ROWS)).join(chunks, on).drop(*drop).withColumn("_chunk", to(F.col("_chunks"))).drop("_chunks")
    by = [*keys, PART, "_chunk"]
    return p.groupBy(*by).cogroup(s.groupBy(*by)).applyInArrow(run, schema)
