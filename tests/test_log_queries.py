"""The written log: its lines are lines that a log can hold."""

import datetime as dt
import random
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from millrace.operators import pieces
from millrace.plans import log_queries

NAMES = ["active_time", "aura_spans", "aura_uptime", "avoidable", "avoidable_members", "badge_pumper", "biggest_hits", "boss_claims", "breakdown_done", "breakdown_healing", "breakdown_taken", "conservation"]


def test_dates_run_on_into_the_next_months(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(log_queries, "STEP_MS", 90_000_000)  # 25 hours a row: 60 rows are 62 days
    start = dt.datetime(2024, 1, 1)
    rows = [(i, start + dt.timedelta(minutes=i), 4 * i, "click", 1.0, '{"k": 1}') for i in range(60)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    told = log_queries.lines(spark, str(tmp_path)).filter("line LIKE '%SPELL_DAMAGE%'").orderBy("row").select(F.substring_index("line", "+0  ", 1)).collect()
    first = dt.datetime(2024, 5, 21)
    assert [dt.datetime.strptime(r[0], "%m/%d/%Y %H:%M:%S.%f") for r in told] == [first + dt.timedelta(milliseconds=90_000_000 * (i + 1)) for i in range(60)]


def test_a_file_is_written_by_many_tasks(spark, monkeypatch, tmp_path):
    """Blocks of ids are numbered apart: the lines stand as a fold over each file would put them, and no task holds a file."""
    monkeypatch.setattr(pieces, "BLOCK_ROWS", 64)
    dice = random.Random(3)
    kinds = ["click", "purchase", "view", "signup", "error"]
    rows = [(3 * i, dt.datetime(2024, 1, 1), dice.choice([0, 0, 1, 2, 7]), dice.choice(kinds), 1.0, f'{{"k": {dice.choice([1, 26, 2, 3])}}}') for i in range(4000)]
    spark.createDataFrame(dice.sample(rows, len(rows)), "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    codes = {"click": "SPELL_DAMAGE", "view": "SPELL_DAMAGE", "purchase": "SPELL_HEAL"}
    want = {}
    for f in range(4):
        mine = [r for r in rows if r[2] % 4 == f]
        fights = (len(mine) - 1) // 400
        out = ["ZONE_CHANGE", "MAP_CHANGE", "MAP_CHANGE", "CHALLENGE_MODE_START"] + ["COMBATANT_INFO"] * 5
        for n, r in enumerate(mine, 1):
            k = int(r[5][6:-1])
            out.append(codes.get(r[3]) or ({"signup": "SPELL_AURA_APPLIED", "error": "SPELL_AURA_REMOVED"} if k % 2 == 0 else {"signup": "SPELL_CAST_SUCCESS", "error": "SPELL_CAST_START"})[r[3]])
            out += ["UNIT_DIED"] * (r[3] == "view" and k % 25 == 1)
            out += ["ENCOUNTER_START"] * (n % 400 == 300 and n // 400 < fights) + ["ENCOUNTER_END"] * (n % 400 == 0 and n // 400 <= fights)
        want[f"f{f}"] = [(i, x) for i, x in enumerate([*out, "CHALLENGE_MODE_END"], 1)]
    conf = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "16"}
    before = {c: spark.conf.get(c) for c in conf}
    try:
        for c, v in conf.items():
            spark.conf.set(c, v)
        told = log_queries.lines(spark, str(tmp_path)).withColumn("task", F.spark_partition_id()).collect()
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
    got = {}
    for r in sorted(told, key=lambda r: r.row):
        got.setdefault(r.file_id, []).append((r.row, r.line.split("  ", 1)[1].split(",")[0]))
    assert got == want
    assert max(Counter(r.task for r in told if r.file_id == "f0").values()) < len(want["f0"]) / 4


@pytest.fixture(scope="module")
def long_log(spark, tmp_path_factory):
    """A folder whose log runs from 21 May to 5 June: 1,800 rows, 50 minutes a step; SQL is told the step in place of 700 ms."""
    step, folder, dice = 3_000_000, tmp_path_factory.mktemp("long"), random.Random(7)
    start, kinds = dt.datetime(2024, 1, 1), ["click", "purchase", "view", "signup", "error"]
    rows = [(i, start + dt.timedelta(minutes=i), i % 4 + 4 * dice.randrange(40), dice.choice(kinds), dice.randrange(5000) / 100, f'{{"k": {dice.randrange(100)}}}') for i in range(1800)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(f"{folder}/events.parquet")
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(log_queries, "STEP_MS", step)
        log_queries.opened(spark, str(folder))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS FROM '{folder}/events.parquet/*.parquet'")
    return str(folder), lambda sql: con.execute(sql.replace("* 700", f"* {step}").replace("* 0.7", f"* {step / 1000}")).fetchall()


@pytest.mark.parametrize("name", NAMES)
def test_reports_go_on_past_the_month(spark, long_log, name):
    folder, told = long_log
    got = [tuple(r) for r in log_queries.QUERIES[f"log_{name}"](spark, folder).collect()]
    assert got and sorted(map(str, got)) == sorted(map(str, told(log_queries.SQL[f"log_{name}"])))
