"""Raw event logs: discovery, lines in file order, and the decoder into a typed event table.

A line is ``<stamp>  EVENT,field,...``. Lines keep their order in ``row`` (from 1 per file), which is
the identity and the order of everything downstream: timestamps tie all the time.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window as W

from millrace.functions.text import field_bool, field_float, field_hex, field_int, field_text, split_fields
from millrace.functions.times import with_few, with_wall_ms

NIL_GUID = "0000000000000000"
MAX_DEPTH, MAX_VISITS = 7, 4000
DEFAULT_WIDTH, MIN_WIDTH, MAX_WIDTH = 19, 12, 48
BASE = 8
GUID = r"^(?:Player|Creature|Pet|Vehicle|GameObject|Vignette|Item|Corpse|BattlePet|ClientActor)-|^0{16}$"
#: Event codes by the suffix that their lines carry.
DAMAGE = ("SPELL_DAMAGE", "SPELL_PERIODIC_DAMAGE", "SPELL_BUILDING_DAMAGE", "RANGE_DAMAGE", "SWING_DAMAGE", "SWING_DAMAGE_LANDED", "DAMAGE_SHIELD", "DAMAGE_SPLIT", "ENVIRONMENTAL_DAMAGE")
HEAL = ("SPELL_HEAL", "SPELL_PERIODIC_HEAL")
ENERGIZE = ("SPELL_ENERGIZE", "SPELL_PERIODIC_ENERGIZE")
ENVIRONMENT = ("DROWNING", "FALLING", "FATIGUE", "FIRE", "LAVA", "SLIME")  # fixed values, numbered from 1
MISS = ("SWING_MISSED", "RANGE_MISSED", "SPELL_MISSED", "SPELL_PERIODIC_MISSED", "DAMAGE_SHIELD_MISSED")
AURA = ("SPELL_AURA_APPLIED", "SPELL_AURA_REFRESH", "SPELL_AURA_APPLIED_DOSE", "SPELL_AURA_REMOVED_DOSE", "SPELL_AURA_REMOVED", "SPELL_AURA_BROKEN")
EXTRA = ("SPELL_INTERRUPT", "SPELL_DISPEL", "SPELL_STOLEN", "SPELL_AURA_BROKEN_SPELL")
CONTROL = ("COMBAT_LOG_VERSION", "CHALLENGE_MODE_START", "CHALLENGE_MODE_END", "ENCOUNTER_START", "ENCOUNTER_END", "ZONE_CHANGE", "MAP_CHANGE", "COMBATANT_INFO")
AVOIDED = ("ABSORB", "BLOCK", "DEFLECT", "DODGE", "EVADE", "IMMUNE", "MISS", "PARRY", "REFLECT", "RESIST")
PLAYER_CONTROLLED = 0x100
FILE_BITS = 40  # rows of a file


def discover(root: str, name: str = "Logs", pattern: str = "*.txt") -> list[str]:
    """Log files below ``root``, newest first: folders called ``name``, breadth first, bounded in depth and visits."""
    queue, found, visits = [(Path(root), 0)], [], 0
    while queue and visits < MAX_VISITS:
        at, depth = queue.pop(0)
        visits += 1
        if at.name == name:
            found += [p for p in at.glob(pattern) if p.is_file()]
            continue
        if depth < MAX_DEPTH:
            queue += [(p, depth + 1) for p in sorted(at.iterdir()) if p.is_dir()] if at.is_dir() else []
    return [str(p) for p in sorted(found, key=lambda p: -p.stat().st_mtime)]


def log_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file_id, row, line) of the non-empty lines of the files at ``path``; files may be split.

    A first pass counts the lines of each split; the splits' counts, summed along each file, give
    every line its number without moving any text.
    """
    raw = spark.read.option("lineSep", "\n").text(path)
    raw = raw.select(F.col("_metadata.file_path").alias("file_id"), F.col("_metadata.file_block_start").alias("_block"), F.regexp_replace("value", "\r$", "").alias("line"), F.monotonically_increasing_id().alias("_n"))
    blocks = raw.groupBy("file_id", "_block").agg(F.count("*").alias("_lines"), F.min("_n").alias("_first"))
    base = F.sum("_lines").over(W.partitionBy("file_id").orderBy("_block")) - F.col("_lines")
    out = with_few(raw, blocks.withColumn("_base", base), ["file_id", "_block"])
    return out.select("file_id", (F.col("_base") + F.col("_n") - F.col("_first") + 1).alias("row"), "line").filter("line <> ''")


def rows_from_lines(spark: SparkSession, lines: list[str], file_id: str = "memory") -> DataFrame:
    """The same shape from lines in memory (tests, small inputs)."""
    return spark.createDataFrame([(file_id, i + 1, x) for i, x in enumerate(lines) if x], "file_id string, row long, line string")


def numbered(lines: DataFrame) -> DataFrame:
    """Lines with ``row`` unique over all files: the file's place in the order of names, from 0, in the bits above 40.

    A single file's rows stay as they are, and rows of a file keep their order. The list of files is small.
    """
    files = lines.select("file_id").distinct()
    place = (F.row_number().over(W.orderBy("file_id")) - 1).cast("long")
    return with_few(lines, files.withColumn("_file", place), ["file_id"]).withColumn("row", F.shiftleft("_file", FILE_BITS) + F.col("row")).drop("_file")


def tokens(lines: DataFrame, assumed_year: int = 2024, falls: DataFrame | None = None) -> DataFrame:
    """(file_id, row, wall_ms, offset_min, name, f): stamp, event name and fields. Lines without a good stamp are left out.

    ``falls`` (file_id, _falls) tells the rows where a file's month fell, where ``lines`` are not all of its lines.
    """
    head = r"^(\S+ \S+)  ([A-Z_0-9]+)(?:,(?s)(.*))?$"
    t = lines.select("file_id", "row", F.regexp_extract("line", head, 1).alias("_stamp"), F.regexp_extract("line", head, 2).alias("name"), F.regexp_extract("line", head, 3).alias("_body")).filter("name <> ''")
    t = with_wall_ms(t, "_stamp", ["file_id"], "row", assumed_year, falls).filter("wall_ms IS NOT NULL")
    return t.withColumn("f", split_fields(F.col("_body"))).drop("_stamp", "_body")


def _at(i: Column | int) -> Column:
    """Field i (from 0), null beyond the end."""
    return F.get("f", i if isinstance(i, Column) else F.lit(i))


def calibrated(t: DataFrame) -> DataFrame:
    """Rows with code, support, prefix, adv (start or null), width, suffix start and the overkill slot.

    The optional block's width is measured on the first line that shows it and holds from there on;
    likewise the slot of the overkill field, which tells whether a base amount precedes it.
    """
    code = F.regexp_replace("name", "_SUPPORT$", "")
    support = F.col("name").endswith("_SUPPORT")
    t = t.filter(~F.col("name").isin(*CONTROL)).withColumns({"code": code, "support": support})
    prefix = F.when(F.col("code").startswith("SWING"), F.when(F.col("support"), 3).otherwise(0)).when(F.col("code").startswith("ENVIRONMENTAL") | F.col("code").startswith("UNIT") | (F.col("code") == "PARTY_KILL"), 0).otherwise(3)
    t = t.withColumn("prefix", prefix).filter(F.size("f") >= BASE + F.col("prefix"))
    start = F.col("prefix") + BASE
    t = t.withColumn("adv", F.when(_at(start).rlike(GUID) & (F.size("f") > start + MIN_WIDTH) & ~F.col("code").isin("SPELL_ABSORBED", "SPELL_HEAL_ABSORBED"), start))
    dotted = F.expr("array_position(transform(slice(f, adv + 1, size(f)), x -> x RLIKE '^-?[0-9]+\\\\.[0-9]+$'), true)")
    seen = F.when(F.col("adv").isNotNull() & (dotted > 0), dotted - 1 + 5)
    good = F.when((seen >= MIN_WIDTH) & (seen <= MAX_WIDTH), seen)
    t = _measured(t, good.cast("int"), "width", DEFAULT_WIDTH)
    body = F.when(F.col("adv").isNotNull(), F.col("adv") + F.col("width")).otherwise(start)
    t = t.withColumn("at", (body + F.when(F.col("code") == "ENVIRONMENTAL_DAMAGE", 1).otherwise(0)).cast("int"))
    n = F.size("f") - F.col("at") - F.col("support").cast("int")
    lock = F.when(F.col("code").isin(*DAMAGE), F.when(n >= 11, 2).when(n <= 9, 1).when(_at(F.col("at") + 1) == "-1", 1).when(_at(F.col("at") + 2) == "-1", 2))
    return _measured(t, lock, "slot", 2)


def _measured(t: DataFrame, value: Column, name: str, default: int) -> DataFrame:
    """``t`` with the file's first value that is not null from its row on, and the default before it.

    The first row of each file is an aggregate, so no file's rows are sorted or kept together.
    """
    first = t.select("file_id", "row", value.alias("_v")).filter("_v IS NOT NULL").groupBy("file_id").agg(F.min(F.struct("row", "_v")).alias("_first"))
    t = with_few(t, first, ["file_id"])
    return t.withColumn(name, F.when(F.col("row") >= F.col("_first.row"), F.col("_first._v")).otherwise(default).cast("int")).drop("_first")


def decode(t: DataFrame) -> DataFrame:
    """The typed event table of all non-control rows of ``tokens``."""
    t = calibrated(t)
    code, at, slot = F.col("code"), F.col("at"), F.col("slot")
    tail = lambda k: F.when(F.col("adv").isNotNull(), _at(F.col("adv") + F.col("width") - k))
    head = lambda k: F.when(F.col("adv").isNotNull(), _at(F.col("adv") + k))
    end = lambda k: _at(F.size("f") - k - F.col("support").cast("int"))
    guid = lambda c: F.when((c != NIL_GUID) & (c != "nil") & (c != ""), c)
    is_ = lambda *names: code.isin(*names)
    dmg, heal, miss, aura, extra, soak = is_(*DAMAGE), is_(*HEAL), is_(*MISS), is_(*AURA), is_(*EXTRA), is_("SPELL_ABSORBED")
    drain, power_ = is_("SPELL_HEAL_ABSORBED"), is_(*ENERGIZE)  # an absorbed heal ends as an absorb does, without the last flag
    waste = F.when(dmg, field_int(_at(at + slot))).when(heal, field_int(_at(at + slot))).when(power_, field_int(_at(at + 1)))
    aura_type = F.when(aura, _at(at)).when(extra, _at(at + 3))
    power = field_int(tail(9))
    mana = F.when((power == 0) & (field_int(tail(7)) > 0), F.greatest(F.lit(0), F.least(F.lit(100), F.floor(100 * field_int(tail(8)) / field_int(tail(7)) + 0.5))))
    return t.select(
        "file_id", "row", "wall_ms", "code", "support", guid(_at(0)).alias("src"), field_text(_at(1)).alias("src_name"), field_hex(_at(2)).alias("src_flags"), guid(_at(4)).alias("dst"), field_text(_at(5)).alias("dst_name"), field_hex(_at(6)).alias("dst_flags"),
        F.when(F.col("prefix") == 3, field_int(_at(BASE))).otherwise(0).alias("spell_id"), F.when(F.col("prefix") == 3, field_text(_at(BASE + 1))).alias("spell"),
        F.when(extra, field_int(_at(at))).when(soak, field_int(end(6))).when(drain, field_int(end(4))).alias("extra_spell_id"), F.when(extra, field_text(_at(at + 1))).when(soak, field_text(end(5))).when(drain, field_text(end(3))).alias("extra_spell"),
        F.when(dmg | heal, field_float(_at(at))).when(soak, field_float(end(3))).when(drain, field_float(end(1))).when(power_, field_float(_at(at))).when(miss, field_float(_at(at + 2))).alias("amount"), waste.alias("waste"),
        F.when(dmg, field_int(_at(at + slot + 4))).when(heal, field_int(_at(at + slot + 1))).alias("absorbed"),
        F.coalesce(F.when(dmg, field_bool(_at(at + slot + 5))).when(heal, field_bool(_at(at + slot + 2))).when(soak, field_bool(end(1))), F.lit(False)).alias("crit"),
        (aura_type == "BUFF").alias("buff"), F.when(aura, field_int(_at(at + 1)).isNotNull()).alias("shield_off"), F.when(miss, _at(at)).alias("miss"), F.when(miss, _at(at).isin(*AVOIDED)).alias("avoided"), F.when(soak, guid(end(10))).when(drain, guid(end(8))).alias("caster"), F.when(soak, field_text(end(9))).when(drain, field_text(end(7))).alias("caster_name"),
        F.when(code == "ENVIRONMENTAL_DAMAGE", _at(at - 1)).alias("environment"), F.when(code == "ENVIRONMENTAL_DAMAGE", F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, ENVIRONMENT)), F.upper(_at(at - 1))), F.lit(0)), F.lit(0))).cast("int").alias("environment_kind"), F.when(code == "UNIT_DIED", F.coalesce(field_bool(_at(BASE)), F.lit(False))).alias("feigned"),
        F.when(F.col("support"), guid(_at(F.size("f") - 1))).alias("supporter"), guid(head(0)).alias("subject"), guid(head(1)).alias("owner"), field_int(head(2)).alias("hp"), field_int(head(3)).alias("hp_max"),
        field_float(tail(5)).alias("x"), field_float(tail(4)).alias("y"), field_int(tail(3)).alias("map"), mana.alias("mana"),
    )


def controls(t: DataFrame, keep: tuple[str, ...] = (), every: bool = False) -> DataFrame:
    """Control rows with the fields that any of them has; the rest are null. ``every`` other row passes too, with null fields."""
    of = lambda *names: F.col("name").isin(*names)
    start, done, boss, left, zone, map_, who = (of(x) for x in ("CHALLENGE_MODE_START", "CHALLENGE_MODE_END", "ENCOUNTER_START", "ENCOUNTER_END", "ZONE_CHANGE", "MAP_CHANGE", "COMBATANT_INFO"))
    body = F.array_join("f", ",")
    affixes = F.transform(F.regexp_extract_all(_at(4), F.lit(r"(\d+)"), F.lit(1)), lambda x: x.cast("int"))
    lo = lambda a, b: F.least(field_float(_at(a)), field_float(_at(b)))
    hi = lambda a, b: F.greatest(field_float(_at(a)), field_float(_at(b)))
    return (t if every else t.filter(F.col("name").isin(*CONTROL))).select(
        "file_id", "row", "wall_ms", "offset_min", "name", *keep,
        F.when(start, field_text(_at(0))).when(zone | map_ | boss | left, field_text(_at(1))).alias("title"), F.when(start, field_int(_at(1))).when(done | zone, field_int(_at(0))).when(boss, field_int(_at(4))).alias("instance_id"),
        F.when(start, field_int(_at(2))).alias("mode_id"), F.when(start, field_int(_at(3))).when(done, field_int(_at(2))).alias("level"), F.when(start, affixes).alias("affixes"),
        F.when(done, field_bool(_at(1))).when(left, field_bool(_at(4))).alias("success"), F.when(done, field_int(_at(3))).when(left, field_int(_at(5))).alias("total_ms"),
        F.when(boss | left, field_int(_at(0))).alias("encounter_id"), F.when(boss | left | zone, field_int(_at(2))).alias("difficulty"), F.when(map_, field_int(_at(0))).alias("map"),
        F.when(map_, lo(2, 3)).alias("x0"), F.when(map_, hi(2, 3)).alias("x1"), F.when(map_, lo(4, 5)).alias("y0"), F.when(map_, hi(4, 5)).alias("y1"), F.when(who, _at(0)).alias("guid"),
        F.when(who, F.regexp_extract(body, r",(-?\d+),\[", 1).cast("int")).alias("spec_id"), F.when(who, F.regexp_extract_all(F.element_at("f", -1), F.lit(r"([A-Z][A-Za-z]+-[0-9A-F-]+,\d+)"), F.lit(1))).alias("opening"),
    )


def actors(events: DataFrame) -> DataFrame:
    """(file_id, guid, name, flags, controlled, kind, npc_id, first_row): first name, last flags, sticky control."""
    side = lambda s: events.filter(F.col(s).isNotNull()).select("file_id", "row", F.col(s).alias("guid"), F.col(f"{s}_name").alias("name"), F.col(f"{s}_flags").alias("flags"))
    both = side("src").unionByName(side("dst"))
    named, flagged = F.when(F.col("name") != "", F.col("row")), F.when(F.col("flags") != 0, F.col("row"))
    g = both.groupBy("file_id", "guid").agg(
        F.min_by("name", named).alias("name"), F.max_by("flags", flagged).alias("flags"), F.bool_or(F.col("flags").bitwiseAND(PLAYER_CONTROLLED) != 0).alias("controlled"), F.min("row").alias("first_row")
    )
    return g.withColumns({"kind": F.substring_index("guid", "-", 1), "npc_id": F.when(F.col("guid").rlike("^(Creature|Vehicle|Pet)-"), F.split_part("guid", F.lit("-"), F.lit(6)).cast("int"))})


def owners(events: DataFrame, actor: DataFrame, hops: int = 4) -> DataFrame:
    """(file_id, guid, root): whom each actor's deeds are credited to.

    The block's owner beats the summoner; an owner counts only if it was seen before, a link to a
    player only if the unit was ever player-controlled.
    """
    known = actor.select("file_id", F.col("guid").alias("_g"), F.col("first_row").alias("_seen"), F.col("controlled").alias("_ctl"))
    owned = events.filter("subject IS NOT NULL AND owner IS NOT NULL").select("file_id", "row", F.col("subject").alias("guid"), F.col("owner").alias("to"), F.lit(1).alias("_rank"))
    summoned = events.filter("code IN ('SPELL_SUMMON', 'SPELL_CREATE')").filter(F.col("src_flags").bitwiseAND(PLAYER_CONTROLLED) != 0).select("file_id", "row", F.col("dst").alias("guid"), F.col("src").alias("to"), F.lit(0).alias("_rank"))
    links = owned.unionByName(summoned).join(known.drop("_ctl"), (F.col("to") == F.col("_g")) & (owned["file_id"] == known["file_id"])).filter("_seen <= row").select(owned["file_id"], "guid", "to", "row", "_rank")
    last = links.groupBy("file_id", "guid").agg(F.max_by("to", F.struct("_rank", "row")).alias("to"))
    last = last.join(known.select("file_id", F.col("_g").alias("guid"), "_ctl"), ["file_id", "guid"]).filter(~F.col("to").startswith("Player-") | F.col("_ctl")).filter("to <> guid").select("file_id", F.col("guid").alias("_from"), F.col("to").alias("_to"))
    out = actor.select("file_id", "guid", F.col("guid").alias("root"))
    for _ in range(hops):
        step = last.withColumnRenamed("file_id", "_file")
        out = out.join(step, (F.col("root") == F.col("_from")) & (F.col("file_id") == F.col("_file")), "left").select("file_id", "guid", F.coalesce("_to", "root").alias("root"))
    return out


def spells(events: DataFrame) -> DataFrame:
    """(file_id, spell_id, spell, first_row): the first name seen of each spell."""
    named = events.filter("spell IS NOT NULL AND spell <> '' AND spell_id <> 0")
    return named.groupBy("file_id", "spell_id").agg(F.min_by("spell", "row").alias("spell"), F.min("row").alias("first_row"))


#: Names that this decoder reads.
KNOWN = (*DAMAGE, *HEAL, *ENERGIZE, *MISS, *AURA, *EXTRA, *CONTROL, "SPELL_ABSORBED", "SPELL_HEAL_ABSORBED", "SPELL_CAST_START", "SPELL_CAST_SUCCESS", "SPELL_CAST_FAILED", "SPELL_SUMMON", "SPELL_CREATE", "SPELL_RESURRECT", "UNIT_DIED", "UNIT_DESTROYED", "PARTY_KILL", "SPELL_EMPOWER_START", "SPELL_EMPOWER_END", "SPELL_EMPOWER_INTERRUPT")


def width_drift(t: DataFrame) -> DataFrame:
    """How often each event name comes with each number of fields, and whether the decoder knows the name."""
    known = F.regexp_replace("name", "_SUPPORT$", "").isin(*KNOWN)
    return t.groupBy("name", F.size("f").alias("width"), known.alias("known")).agg(F.count("*").alias("n"))


def calibration(t: DataFrame) -> DataFrame:
    """(file_id, width, slot, n): the block widths and overkill slots that rows were read with."""
    return calibrated(t).filter("adv IS NOT NULL").groupBy("file_id", "width", "slot").agg(F.count("*").alias("n"))
