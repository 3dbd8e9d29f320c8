"""The open run of each growing log: progress while it lasts, its end, and abandonment by the wall clock.

``transformWithState`` keeps one small state per log: the run's state machine (``plans.runs.Fold``), its count of lines
and the year's turn. A trigger's work is bound to its new lines: they shrink to control rows and counts before the
shuffle (``beats``), so no text moves and one long log sends few rows to its task. A timer closes the key of a party
that left and went quiet, without another line.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import date

import pandas as pd
from pyspark.sql import DataFrame, Row, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from millrace.functions.text import split_fields
from millrace.functions.times import stamp_parts
from millrace.plans.runs import ABANDON_MS, Fold
from millrace.sources import log

CONTROL = "CHALLENGE_MODE_START", "CHALLENGE_MODE_END", "ENCOUNTER_START", "ENCOUNTER_END", "ZONE_CHANGE"
_FIELDS = "title string, instance_id long, mode_id long, level long, success boolean, total_ms long, encounter_id long, difficulty long"
BEAT = f"file_id string, row long, month int, day int, year int, day_ms long, offset_min int, name string, n long, {_FIELDS}"
STATUS = "file_id string, status string, n int, kind string, title string, instance_id long, mode_id long, encounter_id long, difficulty long, level long, pull int, start_row long, end_row long, start_ms long, end_ms long, success boolean, total_ms long, events long, bosses array<struct<encounter_id:long,title:string,start_ms:long,end_ms:long>>"
COLUMNS = tuple(x.split()[0] for x in STATUS.split(", "))
_RUN_FIELDS = "kind", "title", "instance_id", "mode_id", "encounter_id", "difficulty", "level", "pull", "start_row", "start_ms"


def _merged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Neighbouring rows without a name, of one log and day, become one row: how many, and the last one's place and time."""
    for rows in batches:
        plain = rows["name"].isna()
        same = plain & plain.shift(fill_value=False)
        for c in ("file_id", "month", "day", "year", "offset_min"):
            before = rows[c].shift()
            same &= (rows[c] == before) | (rows[c].isna() & before.isna())
        run = (~same).cumsum()
        out = rows.groupby(run, sort=False).tail(1)
        yield out.assign(n=rows.groupby(run, sort=False)["n"].sum().to_numpy())


def beats(lines: DataFrame) -> DataFrame:
    """(file_id, row, stamp parts, name, n, fields) of lines with a good stamp: control rows as they are, runs of other lines as one row with their number."""
    head = r"^(\S+ \S+)  ([A-Z_0-9]+)(?:,(?s)(.*))?$"
    t = lines.select("file_id", "row", F.regexp_extract("line", head, 1).alias("_stamp"), F.regexp_extract("line", head, 2).alias("name"), F.regexp_extract("line", head, 3).alias("_body")).filter("name <> ''")
    p = stamp_parts(F.col("_stamp"))
    t = t.withColumns(p).filter("month IS NOT NULL")
    t = t.withColumn("f", F.when(F.col("name").isin(*log.CONTROL), split_fields(F.col("_body"))))
    found = log.controls(t.select("file_id", "row", F.lit(0).cast("long").alias("wall_ms"), "offset_min", "name", "f", *("month", "day", "year", "day_ms")), keep=("month", "day", "year", "day_ms"), every=True)
    names = [x.split()[0] for x in _FIELDS.split(", ")]
    name = F.when(F.col("name").isin(*CONTROL), F.col("name"))
    plain = F.when(F.col("name").isin(*log.CONTROL), 0).otherwise(1).cast("long")  # control rows are no events
    slim = found.select("file_id", "row", "month", "day", "year", "day_ms", "offset_min", name.alias("name"), plain.alias("n"), *(F.col(c).cast(_type(c)).alias(c) for c in names))
    return slim.mapInPandas(_merged, BEAT)


def _type(column: str) -> str:
    return dict(x.split() for x in _FIELDS.split(", "))[column]


class RunMonitor(StatefulProcessor):
    """Per log: a ``progress`` row when at least ``every`` more events came, a ``closed`` row per run, ``discarded`` for a key that another one replaced."""

    def __init__(self, every: int, quiet_ms: int, assumed_year: int, offset_min: int):
        self.every, self.quiet, self.year, self.offset = every, quiet_ms, assumed_year, offset_min

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("run", "state string")

    def _load(self) -> dict:
        if self.kept.exists():
            return json.loads(self.kept.get()[0])
        return {"fold": None, "closed": 0, "month": None, "rolls": 0, "offset": None, "last": None, "n": 0, "told": 0, "left": None, "due": None}

    def _wall(self, s: dict, r: Row) -> int | None:
        """Local wall clock; a year that the stamp leaves out turns where the month falls."""
        if r.year is None:
            s["rolls"] += s["month"] is not None and r.month < s["month"]
            s["month"] = r.month
        try:
            day = date(r.year if r.year is not None else self.year + s["rolls"], r.month, r.day)
        except ValueError:  # no such day
            return None
        return (day - date(1970, 1, 1)).days * 86_400_000 + r.day_ms

    def _row(self, file_id: str, status: str, n: int, run: dict, events: int, end: tuple[int, int]) -> Row:
        bosses = [{k: b[k] for k in ("encounter_id", "title", "start_ms", "end_ms")} for b in run["bosses"]]
        named = {k: run[k] for k in _RUN_FIELDS} | {"file_id": file_id, "status": status, "n": n, "events": events, "bosses": bosses, "end_row": run.get("end_row", end[0]), "end_ms": run.get("end_ms", end[1]), "success": run.get("success"), "total_ms": run.get("total_ms")}
        return Row(**{c: named[c] for c in COLUMNS})

    def _closing(self, s: dict, file_id: str, runs: list[dict], last: tuple[int, int]) -> Iterator[Row]:
        for run in runs:
            s["closed"] += 1
            walked_out = s["left"] is not None and run["end_row"] == s["left"][0]
            yield self._row(file_id, "closed", s["closed"], run, s["left"][1] if walked_out else s["n"], last)
            s |= {"n": 0, "told": 0, "left": None}

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802
        s, file_id = self._load(), key[0]
        fold = Fold(s["fold"])
        last = tuple(s["last"] or (0, 0))
        for r in sorted(rows, key=lambda r: r.row):
            ms = self._wall(s, r)
            if ms is None:
                continue
            last = (r.row, ms)
            s["offset"] = r.offset_min if r.offset_min is not None else s["offset"]
            yield from self._closing(s, file_id, fold.expired(ms), last)
            if r.name is None:
                s["n"] += r.n if fold.state["key"] or fold.state["pull"] else 0
                continue
            was = {k: (fold.state[k], fold.state[k] and fold.state[k]["start_row"]) for k in ("key", "pull")}
            done = fold.take(r.asDict() | {"file_id": file_id, "wall_ms": ms})
            for run, first in was.values():  # an open run that is gone without having been closed
                now = [fold.state[k] and fold.state[k]["start_row"] for k in ("key", "pull")]
                if run and first not in now and first not in [d["start_row"] for d in done]:
                    yield self._row(file_id, "discarded", 0, run, s["n"], last)
                    s |= {"n": 0, "told": 0, "left": None}
            yield from self._closing(s, file_id, done, last)
            out = fold.state["out"]
            s["left"] = None if out is None else s["left"] or [out[0], s["n"]]
        s |= {"fold": fold.state, "last": list(last)}
        run = fold.state["key"] or fold.state["pull"]
        if run and s["n"] - s["told"] >= self.every:
            s["told"] = s["n"]
            yield self._row(file_id, "progress", 0, run, s["n"], last)
        self._wait(s, timerValues.getCurrentProcessingTimeInMs())
        self.kept.update((json.dumps(s),))

    def _wait(self, s: dict, now: int) -> None:
        """One timer: a minute after the party left, and not before the log was quiet for a while (a backlog may hold their return)."""
        if s["due"] is not None:
            self.handle.deleteTimer(s["due"])
        out = s["fold"]["out"]
        offset = s["offset"] if s["offset"] is not None else self.offset
        s["due"] = None if out is None else max(out[1] - offset * 60_000 + ABANDON_MS, now + self.quiet)
        if s["due"] is not None:
            self.handle.registerTimer(s["due"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802
        s = self._load()
        if s["fold"] is None or s["due"] is None or expiredTimerInfo.getExpiryTimeInMs() != s["due"]:
            return
        fold = Fold(s["fold"])
        out = fold.state["out"]
        last = tuple(s["last"])
        s["due"] = None
        if out is not None:
            yield from self._closing(s, key[0], fold.expired(out[1] + ABANDON_MS), last)
        s["fold"] = fold.state
        self.kept.update((json.dumps(s),))

    def close(self) -> None:
        pass


def run_status(lines: DataFrame, *, every: int = 50_000, quiet_ms: int = 10_000, assumed_year: int = 2024, offset_min: int = 0) -> DataFrame:
    """A stream of (file_id, status, n, run, events, bosses) over a stream of (file_id, row, line).

    ``progress``: a run is open and ``every`` more events came since it was last told, at most once a trigger; ``n`` is 0,
    ``end_row`` and ``end_ms`` are the last line's. ``closed``: the rows of ``plans.runs.runs``, numbered in order of closing,
    at the control row that closes them, at the first line a minute after the party left, or by a timer when no line
    comes: a minute after they left by the wall clock (``offset_min`` where stamps state no offset) and ``quiet_ms`` after
    the log's last new lines. ``discarded``: a key that another announcement replaced, or a pull without an end. ``events``
    counts a run's lines that are no control lines, up to the exit for a key that was left.

    Lines without a good stamp or with a day that does not exist are passed over; null or empty lines likewise. The
    session must use the RocksDB state store: it is set here, before the query starts.
    """
    spark = lines.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    machine = RunMonitor(every, quiet_ms, assumed_year, offset_min)
    return beats(lines).groupBy("file_id").transformWithState(machine, STATUS, "Append", "ProcessingTime")
