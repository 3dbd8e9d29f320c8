"""Runs: top-level sessions opened and closed by control rows, with their parts.

The state machine folds the control rows of a file alone (tens of rows); events are assigned to runs
by their row numbers.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window as W

from millrace.operators import pieces

ABANDON_MS = 60_000
PRE_PULL_MS = 30_000
RAID_DIFFICULTIES = (14, 15, 16, 17)  # fixed values of the log format
_RUN = "file_id string, kind string, n int, title string, instance_id long, mode_id long, encounter_id long, difficulty long, level long, start_row long, end_row long, start_ms long, end_ms long, success boolean, total_ms long, pull int, bosses array<struct<encounter_id:long,title:string,start_ms:long,end_ms:long>>"


def _none(x):
    return None if x is None or x is pd.NA or (isinstance(x, float) and x != x) else x


class Fold:
    """The state machine over a file's control rows. Its ``state`` is plain data (JSON keeps it), so a stream can go on from it.

    ``key`` and ``pull`` are the open ones, ``out`` the row and time at which the party left the key's instance.
    """

    def __init__(self, state: dict | None = None):
        self.state = state or {"key": None, "pull": None, "pulls": {}, "out": None, "zone": {}}

    def _closed(self, run: dict, row: int, ms: int, success: bool, total: int | None) -> dict:
        return run | {"end_row": row, "end_ms": ms, "success": success, "total_ms": total if total is not None else ms - run["start_ms"]}

    def expired(self, ms: int) -> list[dict]:
        """The key that the party left at least ABANDON_MS before ``ms``: it failed where they left."""
        s = self.state
        if not (s["key"] and s["out"] and ms - s["out"][1] >= ABANDON_MS):
            return []
        done = self._closed(s["key"], *s["out"], False, None)
        s["key"] = s["out"] = None
        return [done]

    def take(self, r: dict) -> list[dict]:
        """The runs that a control row closes."""
        s, name, ms = self.state, r["name"], r["wall_ms"]
        out = self.expired(ms)
        key = s["key"]

        def opened(kind, **more):
            return {"file_id": r["file_id"], "kind": kind, "title": r["title"], "instance_id": r["instance_id"], "mode_id": None, "encounter_id": None, "difficulty": None, "level": None, "start_row": r["row"], "start_ms": ms, "pull": None, "bosses": []} | more

        boss = {"encounter_id": r["encounter_id"], "title": r["title"], "start_ms": ms, "end_ms": None}
        if name == "CHALLENGE_MODE_START":
            same = key and all(key[k] == r[k] for k in ("instance_id", "mode_id", "level", "title"))
            if not same:  # another announcement discards the open key
                s |= {"key": opened("key", mode_id=r["mode_id"], level=r["level"]), "pull": None, "out": None}
        elif name == "CHALLENGE_MODE_END" and key:
            out.append(self._closed(key, r["row"], ms, bool(r["success"]), r["total_ms"] or None))
            s["key"] = s["out"] = None
        elif name == "ENCOUNTER_START":
            if key:
                key["bosses"].append(boss)
            elif r["difficulty"] in RAID_DIFFICULTIES:
                at = f"{r['encounter_id']} {r['difficulty']}"
                s["pulls"][at] = s["pulls"].get(at, 0) + 1  # a pull without an end is discarded, but counts
                here = s["zone"].get("title") if s["zone"].get("instance_id") == r["instance_id"] else None
                s["pull"] = opened("raid", encounter_id=r["encounter_id"], difficulty=r["difficulty"], pull=s["pulls"][at], title=f"{r['title']} ({here})" if here else r["title"], bosses=[boss])
        elif name == "ENCOUNTER_END":
            if key:
                mine = [b for b in key["bosses"] if b["encounter_id"] == r["encounter_id"] and b["end_ms"] is None]
                if mine:
                    mine[-1]["end_ms"] = ms
                else:
                    key["bosses"].append(boss | {"end_ms": ms})
            elif s["pull"] and s["pull"]["encounter_id"] == r["encounter_id"]:
                s["pull"]["bosses"][0]["end_ms"] = ms
                out.append(self._closed(s["pull"], r["row"], ms, bool(r["success"]), r["total_ms"] or None))
                s["pull"] = None
        elif name == "ZONE_CHANGE":
            s["zone"] = {"instance_id": r["instance_id"], "title": r["title"]}
            if key:
                s["out"] = None if r["instance_id"] == key["instance_id"] else s["out"] or [r["row"], ms]
        return out


def _fold(rows: pd.DataFrame, ended: dict | None = None) -> list[dict]:
    """Runs of one file from its control rows in order."""
    fold, out = Fold(), []
    for x in rows.sort_values("row").to_dict("records"):
        out += fold.take({k: v if hasattr(v, "__len__") else _none(v) for k, v in x.items()})
    return out + (fold.expired(ended["wall_ms"]) if ended else [])


def runs(control: DataFrame, ends: DataFrame | None = None) -> DataFrame:
    """The closed runs of every file, numbered in order of closing. ``ends`` (file_id, wall_ms) is the last time of each file."""
    names = [f.split()[0] for f in _RUN.replace("array<struct<encounter_id:long,title:string,start_ms:long,end_ms:long>>", "x").split(", ")]

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        last = {"wall_ms": int(rows["_last"].iloc[0])} if "_last" in rows else None
        return pd.DataFrame([r | {"n": i + 1} for i, r in enumerate(_fold(rows, last))], columns=names)

    if ends is not None:
        control = control.join(ends.select("file_id", F.col("wall_ms").alias("_last")), "file_id")
    found = control.groupBy("file_id").applyInPandas(fold, _RUN)
    return found.withColumn("run_id", F.concat_ws("#", "file_id", F.col("n").cast("string")))


def _within(events: DataFrame, spans: DataFrame) -> DataFrame:
    """Events joined with the spans (file_id, first, last, ...) that hold their row, the ends apart: an equi-join on blocks of rows, no file's rows together."""
    block = lambda c: F.floor(F.col(c) / pieces.BLOCK_ROWS)
    cut = spans.withColumn(pieces.BLOCK, F.explode(F.sequence(block("first"), block("last"))))
    both = events.withColumn(pieces.BLOCK, block("row")).join(cut, ["file_id", pieces.BLOCK])
    return both.filter("row > first AND row < last").select(*(events[c] for c in events.columns), *(spans[c] for c in spans.columns if c not in ("file_id", "first", "last")))


def in_runs(events: DataFrame, run: DataFrame) -> DataFrame:
    """Events inside a run, with run_id and ts (ms since its start). Runs of a file do not overlap."""
    spans = run.select("file_id", F.col("start_row").alias("first"), F.col("end_row").alias("last"), F.col("run_id").alias("_run_id"), F.col("start_ms").alias("_start_ms"))
    return _within(events.drop("run_id", "ts"), spans).withColumns({"run_id": F.col("_run_id"), "ts": F.col("wall_ms") - F.col("_start_ms")}).drop("_run_id", "_start_ms")


def _in_raid_zone(events: DataFrame, control: DataFrame) -> DataFrame:
    """Events whose last change of zone was into a raid."""
    zones = control.filter("name = 'ZONE_CHANGE'").select("file_id", F.col("row").alias("first"), F.lead("row").over(W.partitionBy("file_id").orderBy("row")).alias("next"), "difficulty")
    ends = events.groupBy("file_id").agg((F.max("row") + 1).alias("end"))
    spans = zones.filter(F.col("difficulty").isin(*RAID_DIFFICULTIES)).join(ends, "file_id").select("file_id", "first", F.greatest("first", F.coalesce("next", "end")).alias("last"))
    return _within(events, spans)


def before_pulls(events: DataFrame, run: DataFrame, control: DataFrame | None = None) -> DataFrame:
    """Events of the thirty seconds before each raid pull that are in no run and, given ``control``, in a raid's zone, at negative ts."""
    pulls = run.filter("kind = 'raid'").select("file_id", "run_id", "start_row", "start_ms")
    idle = events.join(in_runs(events, run).select("file_id", "row"), ["file_id", "row"], "left_anti")
    if control is not None:
        idle = _in_raid_zone(idle, control)
    near = idle.withColumn("_b", F.floor(F.col("wall_ms") / PRE_PULL_MS)).join(pulls.withColumn("_b", F.explode(F.array(F.floor(F.col("start_ms") / PRE_PULL_MS), F.floor(F.col("start_ms") / PRE_PULL_MS) - 1))), ["file_id", "_b"])
    return near.filter((F.col("row") < F.col("start_row")) & (F.col("wall_ms") >= F.col("start_ms") - PRE_PULL_MS)).withColumn("ts", F.col("wall_ms") - F.col("start_ms")).drop("_b", "start_row", "start_ms")


def party(control: DataFrame, run: DataFrame) -> DataFrame:
    """(run_id, guid, place, spec_id): members by their first announcement inside the run."""
    who = in_runs(control.filter("name = 'COMBATANT_INFO'").select("file_id", "row", "wall_ms", "guid", "spec_id", "opening"), run)
    first = who.groupBy("run_id", "guid").agg(F.min("row").alias("row"), F.min_by("spec_id", "row").alias("spec_id"), F.min_by("opening", "row").alias("opening"))
    return first.withColumn("place", F.row_number().over(W.partitionBy("run_id").orderBy("row")))


def opening_auras(member: DataFrame) -> DataFrame:
    """(run_id, guid, caster, spell_id): states up when the run opened."""
    each = member.select("run_id", "guid", F.explode("opening").alias("o"))
    return each.select("run_id", "guid", F.substring_index("o", ",", 1).alias("caster"), F.substring_index("o", ",", -1).cast("long").alias("spell_id"))


def maps(control: DataFrame, run: DataFrame) -> DataFrame:
    """(run_id, map, ...bounds, first): maps of a run in order of entry, the one entered last before it included."""
    m = control.filter("name = 'MAP_CHANGE'").select("file_id", "row", "wall_ms", "map", "title", "x0", "x1", "y0", "y1")
    inside = in_runs(m, run).select("run_id", "row", "map", "title", "x0", "x1", "y0", "y1")
    r = run.select("file_id", "run_id", "start_row")
    before = m.join(r, "file_id").filter("row < start_row").groupBy("run_id").agg(F.max_by(F.struct("row", "map", "title", "x0", "x1", "y0", "y1"), "row").alias("s")).select("run_id", "s.*")
    return inside.unionByName(before).groupBy("run_id", "map").agg(F.min("row").alias("first"), *(F.min_by(c, "row").alias(c) for c in ("title", "x0", "x1", "y0", "y1")))
