"""Log timestamps: ``month/day[/year] HH:MM:SS.fff[offset]``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window as W

STAMP = r"^(\d{1,2})/(\d{1,2})(?:/(\d{4}))? (\d{1,2}):(\d{2}):(\d{2})(?:\.(\d{1,3}))?([+-]\d{1,4})?$"


def stamp_parts(raw: Column) -> dict[str, Column]:
    """Month, day, year (null if absent), ms of the day and offset minutes (null if absent); all null for bad stamps."""
    part = lambda i: F.when(F.regexp_extract(raw, STAMP, i) != "", F.regexp_extract(raw, STAMP, i))
    ms = F.rpad(F.coalesce(part(7), F.lit("0")), 3, "0").cast("long")
    off = part(8)
    digits = F.length(F.regexp_replace(off, "[+-]", ""))
    whole = F.abs(off.cast("int"))
    minutes = F.when(digits <= 2, whole * 60).otherwise(F.floor(whole / 100) * 60 + whole % 100)
    return {
        "month": part(1).cast("int"), "day": part(2).cast("int"), "year": part(3).cast("int"),
        "day_ms": ((part(4).cast("long") * 60 + part(5).cast("long")) * 60 + part(6).cast("long")) * 1000 + ms,
        "offset_min": F.when(off.startswith("-"), -minutes).otherwise(minutes).cast("int"),
    }


def with_wall_ms(df: DataFrame, raw: str, keys: list[str], order: str, assumed_year: int, falls: DataFrame | None = None) -> DataFrame:
    """``df`` with wall_ms (local wall clock since 1970) and offset_min.

    A stamp without a year gets the assumed one, plus one for every time the month fell along the order. Where it
    fell is found on keys, order and month of the rows without a year alone, or told by ``falls`` (keys, _falls).
    """
    p = df.withColumns({f"_{k}": c for k, c in stamp_parts(F.col(raw)).items()})
    p = with_few(p, _falls(df, raw, keys, order) if falls is None else falls, keys)
    roll = F.coalesce(F.size(F.filter("_falls", lambda r: r <= F.col(order))), F.lit(0))
    year = F.coalesce("_year", F.lit(assumed_year) + F.when(F.col("_falls").isNull(), 0).otherwise(roll))
    day = F.try_to_date(F.format_string("%04d-%02d-%02d", year, "_month", "_day"))  # null for a day that does not exist
    wall = F.unix_date(day).cast("long") * 86_400_000 + F.col("_day_ms")
    return p.withColumns({"wall_ms": wall, "offset_min": F.col("_offset_min")}).drop(*(f"_{k}" for k in ("month", "day", "year", "day_ms", "offset_min", "falls")))


def _falls(df: DataFrame, raw: str, keys: list[str], order: str) -> DataFrame:
    bare = df.select(*keys, order, stamp_parts(F.col(raw))["month"].alias("_month"), stamp_parts(F.col(raw))["year"].alias("_year")).filter("_year IS NULL AND _month IS NOT NULL")
    w = W.partitionBy(*keys).orderBy(order)
    return bare.withColumn("_last", F.lag("_month").over(w)).filter("_month < _last").groupBy(*keys).agg(F.array_sort(F.collect_list(order)).alias("_falls"))


FEW = 2_000_000  # rows of a look-up that may be broadcast; they are counted


def with_few(df: DataFrame, few: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` left joined with a look-up of mostly few rows, best a stored one: up to FEW are broadcast, more joined by a shuffle."""
    return df.join(F.broadcast(few) if few.limit(FEW + 1).count() <= FEW else few, keys, "left")
