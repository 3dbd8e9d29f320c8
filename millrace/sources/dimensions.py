"""Dimension tables: readers, the rules that build them from raw game tables, and checks of what was built.

Everything is a DataFrame to a DataFrame. The third-party contents themselves are inputs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window as W

# readers


def csv_table(spark: SparkSession, path: str, columns: dict[str, str]) -> DataFrame:
    """The named columns (source name: type) of a CSV file with a header; quotes as in RFC 4180, columns in any order, others not read."""
    raw = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).csv(path)
    missing = [c for c in columns if c not in raw.columns]
    if missing:
        raise ValueError(f"{path}: no column {', '.join(missing)}")
    return raw.select(*(F.col(f"`{c}`").try_cast(t).alias(c) for c, t in columns.items()))


def lua_entries(files: DataFrame) -> DataFrame:
    """(path, key, value) of every leaf of the Lua data tables in ``files`` (path, text): key is the path of keys, list places counted from 1.

    A file that does not parse has no rows, rather than some. One file is read in one task.
    """

    def read(rows):
        import pandas as pd

        from millrace.functions.lua import leaves

        for batch in rows:
            out = [(p, k, v) for p, t in zip(batch["path"], batch["text"], strict=True) for k, v in leaves(t)]
            yield pd.DataFrame(out, columns=["path", "key", "value"])

    return files.select("path", "text").mapInPandas(read, "path string, key array<string>, value string")


def planner_spawns(entries: DataFrame) -> DataFrame:
    """(path, enemy, npc_id, name, count, clone, group, sublevel, x, y): a planner's enemies with their spawns, from leaves ``enemies / n / field`` and ``enemies / n / clones / m / field``."""
    e = entries.withColumn("_n", F.size("key")).filter(F.element_at("key", 1) == "enemies").withColumn("enemy", F.get("key", F.lit(1)).cast("int"))
    pick = lambda field, kind: F.max(F.when(F.element_at("key", -1) == field, F.col("value").try_cast(kind))).alias(field)
    kinds = e.filter("_n = 3").groupBy("path", "enemy").agg(pick("id", "long"), pick("name", "string"), pick("count", "int")).withColumnRenamed("id", "npc_id")
    clones = e.filter((F.col("_n") == 5) & (F.get("key", F.lit(2)) == "clones")).withColumn("clone", F.get("key", F.lit(3)).cast("int"))
    clones = clones.groupBy("path", "enemy", "clone").agg(pick("g", "int"), pick("sublevel", "int"), pick("x", "double"), pick("y", "double")).withColumnRenamed("g", "group")
    return kinds.join(clones, ["path", "enemy"], "left")


# look-ups


def listed(df: DataFrame, ids: DataFrame, on: str, name: str) -> DataFrame:
    """``df`` with a boolean ``name``: whether ``on`` is in ``ids`` (one column)."""
    have = ids.select(F.col(ids.columns[0]).alias(on)).distinct().withColumn(name, F.lit(True))
    return df.join(have, on, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def buttons(df: DataFrame, ids: DataFrame, on: str, frontier: int, name: str = "button") -> DataFrame:
    """Whether ``on`` is a button: as listed, and true for all ids above the frontier, which the list cannot know yet."""
    return listed(df, ids, on, name).withColumn(name, F.col(name) | (F.col(on) > frontier))


def valued(df: DataFrame, dim: DataFrame, on: str, values: dict[str, object]) -> DataFrame:
    """``df`` with the dimension's values by ``on``; unlisted ids get the given defaults."""
    out = df.join(dim.select(on, *values), on, "left")
    return out.withColumns({c: F.coalesce(c, F.lit(d)) if d is not None else F.col(c) for c, d in values.items()})


def procs_per_minute(df: DataFrame, base: DataFrame, factors: DataFrame) -> DataFrame:
    """``df`` (spell_id, class_id, spec_id) with per_minute: the base rate times 1 + factor of every row of the class and of the spec; 0 for other spells.

    ``base`` has spell_id and rate; ``factors`` spell_id, kind (class or spec), id and factor.
    """
    product = F.aggregate(F.collect_list(1 + F.col("factor")), F.lit(1.0), lambda a, x: a * x)
    by = lambda kind, key: factors.filter(F.col("kind") == kind).groupBy("spell_id", F.col("id").alias(key)).agg(product.alias(f"_{kind}"))
    out = df.join(base, "spell_id", "left").join(by("class", "class_id"), ["spell_id", "class_id"], "left").join(by("spec", "spec_id"), ["spell_id", "spec_id"], "left")
    return out.withColumn("per_minute", F.coalesce("rate", F.lit(0.0)) * F.coalesce("_class", F.lit(1.0)) * F.coalesce("_spec", F.lit(1.0))).drop("rate", "_class", "_spec")


def avoidable_rules(nested: DataFrame) -> DataFrame:
    """A dimension of optional rules (unless_own, unless_marked: id; unless_after: struct of cast, aura, from, ms; tank, covered) as the flat columns that the report takes."""
    after = nested.schema["unless_after"].dataType.names if "unless_after" in nested.columns else []
    flat = {"unless": "unless_own", "unless_marked": "unless_marked", "tank": "tank", "covered": "covered"}
    cols = [F.col(c).alias(n) for n, c in flat.items() if c in nested.columns]
    return nested.select("spell_id", *cols, *(F.col(f"unless_after.{c}").alias(f"after_{c}") for c in after))


def on_planner(points: DataFrame, transforms: DataFrame, keys: list[str]) -> DataFrame:
    """``points`` (keys, x, y) with px, py on the planner's map: turned and scaled by (re, im), moved by (dx, dy) of their floor; null without a transform."""
    out = points.join(transforms.select(*keys, "re", "im", "dx", "dy"), keys, "left")
    return out.withColumns({"px": F.col("re") * F.col("x") - F.col("im") * F.col("y") + F.col("dx"), "py": F.col("im") * F.col("x") + F.col("re") * F.col("y") + F.col("dy")}).drop("re", "im", "dx", "dy")


# building


def effect_bits(effects: DataFrame, rules: DataFrame) -> DataFrame:
    """(spell_id, bits): the kinds that a spell's effects amount to, or-ed. ``effects`` has spell_id and effect, ``rules`` effect and bit."""
    return effects.join(rules, "effect").groupBy("spell_id").agg(F.bit_or("bit").alias("bits"))


def dedicated(effects: DataFrame, wanted: DataFrame, ignored: DataFrame) -> DataFrame:
    """(spell_id): spells with a wanted effect whose other effects are all ignored ones. ``wanted`` and ``ignored`` have effect."""
    kind = effects.join(wanted.select("effect", F.lit(True).alias("_w")), "effect", "left").join(ignored.select("effect", F.lit(True).alias("_i")), "effect", "left")
    g = kind.groupBy("spell_id").agg(F.bool_or(F.coalesce("_w", F.lit(False))).alias("_has"), F.bool_or(F.col("_w").isNull() & F.col("_i").isNull()).alias("_other"))
    return g.filter("_has AND NOT _other").select("spell_id")


def inert(effects: DataFrame, nothing: DataFrame) -> DataFrame:
    """(spell_id): spells all of whose effects do nothing. ``nothing`` has effect."""
    some = effects.join(nothing, "effect", "left_anti").select("spell_id")
    return effects.select("spell_id").distinct().join(some, "spell_id", "left_anti")


def proc_rates(passives: DataFrame, auras: DataFrame, rates: DataFrame) -> DataFrame:
    """(spell_id, passive, rate): the rate of each proc state through the passive that triggers it.

    ``passives`` has passive and rate_id, ``auras`` passive and spell_id, ``rates`` rate_id and rate. A
    passive that triggers several states tells of none; of several passives the lowest id counts.
    """
    clear = auras.select("passive", "spell_id").distinct().withColumn("_n", F.count("*").over(W.partitionBy("passive"))).filter("_n = 1").drop("_n")
    found = passives.join(clear, "passive").join(rates, "rate_id")
    return found.groupBy("spell_id").agg(F.min("passive").alias("passive"), F.min_by("rate", "passive").alias("rate"))


def descendants(tree: DataFrame, roots: DataFrame, depth: int) -> DataFrame:
    """(root, id, level, amount): the nodes up to ``depth`` levels below each root. ``tree`` has id, parent and amount; ``roots`` root."""
    step = roots.select("root", F.col("root").alias("id"), F.lit(0).alias("level"))
    parts = []
    for level in range(1, depth + 1):
        step = step.select("root", F.col("id").alias("parent")).join(tree, "parent").select("root", "id", F.lit(level).alias("level"), "amount")
        parts.append(step)
    return reduce(DataFrame.unionByName, parts)


def root_of(tree: DataFrame, hops: int) -> DataFrame:
    """(id, root): the topmost node above each, at most ``hops`` up. A parent of 0, null or an unknown one ends the way."""
    up = tree.filter("parent IS NOT NULL AND parent <> 0").select(F.col("id").alias("_id"), F.col("parent").alias("_parent")).join(tree.select(F.col("id").alias("_parent")), "_parent", "left_semi")
    out = tree.select("id", F.col("id").alias("root"))
    for _ in range(hops):
        out = out.join(up, F.col("root") == F.col("_id"), "left").select("id", F.coalesce("_parent", "root").alias("root"))
    return out


def forces_table(variants: DataFrame, older: DataFrame) -> DataFrame:
    """(mode_id, npc_id, value, total): the union of a mode's faction variants, each creature's greatest value, with rows that the build lost put back.

    ``variants`` has mode_id, npc_id, value, total. A creature of ``older`` (same columns, build) comes
    back where the mode lacks it and the mode's total is still the older build's; the newest such build counts.
    """
    now = variants.groupBy("mode_id", "npc_id").agg(F.max("value").alias("value"))
    total = variants.groupBy("mode_id").agg(F.max("total").alias("total"))
    lost = older.join(total.withColumnRenamed("total", "_now"), "mode_id").filter("total = _now").join(now, ["mode_id", "npc_id"], "left_anti")
    back = lost.groupBy("mode_id", "npc_id").agg(F.max_by("value", "build").alias("value"))
    return now.unionByName(back).join(total, "mode_id")


def unique_assets(rows: DataFrame) -> DataFrame:
    """Rows (dungeon, asset) whose asset belongs to one dungeon alone."""
    return rows.join(rows.groupBy("asset").agg(F.countDistinct("dungeon").alias("_n")).filter("_n = 1").select("asset"), "asset", "left_semi")


def by_difficulty(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key: that of difficulty 0 where there is one, else of the lowest."""
    return rows.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy("difficulty"))).filter("_r = 1").drop("_r")


def cooldowns(spells: DataFrame, categories: DataFrame) -> DataFrame:
    """(spell_id, recovery_ms, charges): a spell's own recovery, or its charge category's (recovery_ms, charges by category_id), whichever is longer."""
    j = spells.join(categories.select("category_id", F.col("recovery_ms").alias("_ms"), F.col("charges").alias("_n")), "category_id", "left")
    pool = F.coalesce(F.col("_ms") > F.coalesce("recovery_ms", F.lit(0)), F.lit(False))
    return j.select("spell_id", F.when(pool, F.col("_ms")).otherwise(F.coalesce("recovery_ms", F.lit(0))).alias("recovery_ms"), F.when(pool, F.greatest("_n", F.lit(1))).otherwise(1).alias("charges"))


def first_wins(tables: list[DataFrame], keys: list[str]) -> DataFrame:
    """Tables of one shape merged: of rows with equal keys that of the earliest table stays; sorted by key."""
    all_ = reduce(DataFrame.unionByName, (t.withColumn("_t", F.lit(i)) for i, t in enumerate(tables)))
    return all_.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy("_t"))).filter("_r = 1").drop("_r", "_t").orderBy(*keys)


# checks


def broken_witnesses(dim: DataFrame, witnesses: DataFrame, on: str) -> DataFrame:
    """Witnesses (``on``, expected: must be in or out) that the dimension contradicts."""
    have = dim.select(on).distinct().withColumn("_in", F.lit(True))
    return witnesses.join(have, on, "left").filter(F.coalesce("_in", F.lit(False)) != F.col("expected")).drop("_in")


def drift(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows that only one side has, with ``side``: lost or gained. Repeats count."""
    cols = old.columns
    return old.select(*cols).exceptAll(new.select(*cols)).withColumn("side", F.lit("lost")).unionByName(new.select(*cols).exceptAll(old.select(*cols)).withColumn("side", F.lit("gained")))


def matched_fights(runs: DataFrame, fights: DataFrame, slack_ms: int = 120_000) -> DataFrame:
    """(run_id, fight): the remote fight of each run: same level, overlapping in time, starts at most ``slack_ms`` apart; the nearest start wins.

    ``runs`` has run_id, level, start_ms, end_ms; ``fights`` fight, level, start_ms, end_ms. They meet in buckets of time.
    """
    bucket = F.floor(F.col("start_ms") / slack_ms)
    a = runs.select("run_id", "level", F.col("start_ms").alias("s"), F.col("end_ms").alias("e"), F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("_b"))
    near = a.join(fights.withColumn("_b", bucket), ["level", "_b"]).filter((F.abs(F.col("start_ms") - F.col("s")) <= slack_ms) & (F.col("start_ms") <= F.col("e")) & (F.col("end_ms") >= F.col("s")))
    return near.groupBy("run_id").agg(F.min_by("fight", F.struct(F.abs(F.col("start_ms") - F.col("s")), "fight")).alias("fight"))


# sinks


def save(df: DataFrame, path: str, form: str = "parquet") -> None:
    """Writes a table as parquet, json, csv (with a header) or text (one string column)."""
    df.write.mode("overwrite").option("header", True).format(form).save(path)


def delta_ids(packed: Column, payload: bool = False) -> Column:
    """Ids from base-36 differences joined by dots; with a payload each is ``difference~value`` and the result is structs (id, value)."""
    parts = F.split(packed, r"\.")
    step = lambda x: F.conv(F.split_part(x, F.lit("~"), F.lit(1)), 36, 10).cast("long")
    ids = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.aggregate(F.slice(parts, F.lit(1), i), F.lit(0).cast("long"), lambda a, x: a + step(x)))
    if not payload:
        return ids
    return F.arrays_zip(ids.alias("id"), F.transform(parts, lambda x: F.conv(F.split_part(x, F.lit("~"), F.lit(2)), 36, 10).cast("long")).alias("value"))
