"""Open runs of growing logs: a stream in portions tells the runs of a batch read, progress, and abandonment by a timer."""

import time
from datetime import datetime, timedelta, timezone

import pandas as pd
import pytest

from millrace.plans import runs
from millrace.sources import log
from millrace.streaming import monitor, tail
from tests.test_log import LINES, control

START, END, OUT = 'CHALLENGE_MODE_START,"Hall",1,2,3,[9]', "CHALLENGE_MODE_END,1,1,3,5000", 'ZONE_CHANGE,5,"Town",0'


def follow(spark, tmp_path, portions, **options):
    """The status rows after each portion of lines is appended."""
    (tmp_path / "logs").mkdir()
    f = tmp_path / "logs" / "a.txt"
    f.write_text("")
    name = f"status_{tmp_path.name}".replace("-", "_")
    stream = monitor.run_status(tail.follow(spark, str(tmp_path / "logs"), maxBytesPerPartition="200"), **options)
    query = stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "check")).start()
    seen = []
    try:
        for lines in portions:
            if callable(lines):
                until = time.time() + 90
                while time.time() < until and not lines(spark.table(name).collect()):
                    time.sleep(0.5)
            else:
                with f.open("a") as out:
                    out.write("".join(x + "\n" for x in lines))
                before = query.lastProgress["batchId"] if query.lastProgress else -1
                until = time.time() + 40
                while time.time() < until and (query.exception() is None) and not (query.lastProgress and query.lastProgress["batchId"] > before + 1):
                    time.sleep(0.2)
            assert query.exception() is None
            seen.append(sorted(spark.table(name).collect(), key=lambda r: (r.start_row, r.end_row, r.status)))
    finally:
        query.stop()
    return seen


def test_portions_equal_batch_and_progress(spark, tmp_path):
    seen = follow(spark, tmp_path, [LINES[:9], LINES[9:15], LINES[15:]], every=2)
    closed = [r for r in seen[-1] if r.status == "closed"]
    batch = runs.runs(log.controls(log.tokens(log.rows_from_lines(spark, LINES)))).collect()
    parts = "kind", "title", "instance_id", "mode_id", "level", "start_ms", "end_ms", "success", "total_ms", "n", "bosses"
    assert [tuple(r[c] for c in parts) for r in closed] == [tuple(r[c] for c in parts) for r in batch] and len(batch) == 1
    progress = [r for r in seen[-1] if r.status == "progress"]
    assert progress and all(a.events + 2 <= b.events for a, b in zip(progress, progress[1:])) and all(r.success is None for r in progress)
    assert progress[-1].events < closed[0].events
    inside = [x for x in LINES[LINES.index(next(x for x in LINES if "CHALLENGE_MODE_START" in x)) + 1 : LINES.index(next(x for x in LINES if "CHALLENGE_MODE_END" in x))]]
    assert closed[0].events == sum(x.split("  ", 1)[1].split(",")[0] not in log.CONTROL for x in inside)


def test_wall_clock_closes_a_key_without_another_line(spark, tmp_path):
    now = datetime.now(timezone.utc)
    at = lambda s: (now + timedelta(seconds=s)).strftime("%-m/%-d/%Y %H:%M:%S.000+0")
    lines = [f"{at(-100)}  {START}", f"{at(-80)}  SPELL_X,1", f"{at(-30)}  {OUT}", f"{at(-29)}  SPELL_X,1"]
    seen = follow(spark, tmp_path, [lines, lambda rows: any(r.status == "closed" for r in rows)], quiet_ms=1000)
    assert not [r for r in seen[0] if r.status == "closed"]
    (gone,) = [r for r in seen[1] if r.status == "closed"]
    assert (gone.success, gone.total_ms, gone.events) == (False, 70_000, 1) and gone.end_row == sum(len(x) + 1 for x in lines[:2])


def test_return_cancels_and_another_key_discards(spark, tmp_path):
    back = [control(0, START), control(9000, OUT), control(20_000, 'ZONE_CHANGE,1,"Hall",8'), control(95_000, END)]
    other = [control(100_000, START), control(101_000, START.replace("3,[9]", "4,[9]")), control(102_000, OUT), control(170_000, "NEW_EVENT,1")]
    rows = follow(spark, tmp_path, [back[:2], back[2:], other], quiet_ms=60_000)[-1]
    assert [(r.status, r.level, r.success) for r in rows] == [("closed", 3, True), ("discarded", 3, None), ("closed", 4, False)]


def test_beats_shrink_lines_and_keep_counts(spark):
    lines = [control(i, "SPELL_X,1") for i in range(500)] + [control(600, OUT), "no line", "", control(700, "SPELL_X"), f"13/45 1:2:3.000  {OUT}"]
    found = monitor.beats(log.rows_from_lines(spark, lines).coalesce(1)).toPandas()
    assert found["n"].sum() == 501 + 0 and len(found) <= 4 and list(found["name"].dropna().unique()) == ["ZONE_CHANGE"]
    empty = spark.createDataFrame([], "file_id string, row long, line string")
    assert monitor.beats(empty).count() == 0


@pytest.mark.parametrize("cut", [1, 3, 7])
def test_the_machine_goes_on_from_its_state(cut):
    rows = [
        {"file_id": "f", "row": i, "wall_ms": ms, "name": n, "title": t, "instance_id": inst, "mode_id": 2, "level": 3, "success": True, "total_ms": None, "encounter_id": 8, "difficulty": 16}
        for i, (ms, n, t, inst) in enumerate([(0, "ENCOUNTER_START", "Wyrm", 9), (500, "ENCOUNTER_START", "Wyrm", 9), (900, "ENCOUNTER_END", "Wyrm", 9), (1000, "CHALLENGE_MODE_START", "Hall", 1), (2000, "ENCOUNTER_START", "Lord", 1), (3000, "ZONE_CHANGE", "Town", 5), (4000, "ZONE_CHANGE", "Hall", 1), (5000, "ENCOUNTER_END", "Lord", 1), (6000, "CHALLENGE_MODE_END", None, 1)])
    ]
    import json

    whole, state, got = runs._fold(pd.DataFrame(rows)), None, []
    for i in range(0, len(rows), cut):
        fold = runs.Fold(json.loads(json.dumps(state)) if state else None)
        got += [r for x in rows[i : i + cut] for r in fold.take(x)]
        state = fold.state
    assert [(r["kind"], r["pull"], r["end_ms"], len(r["bosses"])) for r in got] == [(r["kind"], r["pull"], r["end_ms"], len(r["bosses"])) for r in whole] == [("raid", 2, 900, 1), ("key", None, 6000, 1)]
