"""Positions, floors and replays on a small key."""

from pyspark.sql import functions as F

from millrace.plans import maps, reports
from tests.test_log import A, B, MOB, base, control, died, heal, hit, key


def at(ms, who_, x, y, map_=7, hp=1000):
    return hit(ms, who_, MOB, 5, hp=hp).replace(",1.50,2.50,7,", f",{x:.2f},{y:.2f},{map_},")


def test_tracks_homes_and_replay(spark):
    ctx = key(spark, at(5000, A, 1, 1, hp=900), at(6000, A, 2, 2, hp=1000), at(6100, A, 9, 9), at(7000, A, 3, 4, hp=1000), at(8000, B, 5, 5, map_=8), at(9000, B, 6, 6, map_=8, hp=1000), died(9500, A), heal(20_000, A, A, 5))
    rows = maps.tracks(ctx)
    assert [(r.ts, r.hp_pct) for r in rows.filter(F.col("actor") == A).orderBy("ts").collect()] == [(5000, 90), (6000, 100), (7000, 100), (20_000, 50)]
    assert {r.actor: (r.x, r.map) for r in maps.homes(rows).collect()} == {A: (1, 7), B: (5, 8)}
    gone = maps.track_deaths(ctx)
    assert [(r.actor, r.died) for r in gone.collect()] == [(A, [9500])]
    probes = spark.createDataFrame([(ctx.runs.first().run_id, A, t) for t in (4000, 7500, 10_000, 15_000, 21_000)], "run_id string, actor string, ts long")
    got = {r.ts: (r.x, r.live, r.dead) for r in maps.replay(probes, rows, gone).collect()}
    assert got == {4000: (None, False, False), 7500: (3, True, False), 10_000: (3, True, True), 15_000: (3, False, True), 21_000: (1.5, True, False)}


def test_floors_and_votes(spark):
    lines = [control(3000, 'MAP_CHANGE,7,"Hall",10.0,-10.0,5.0,-5.0'), at(5000, A, 1, 1), at(5100, B, 2, 2), control(5500, 'MAP_CHANGE,8,"Hall",20.0,-20.0,5.0,-5.0'), at(6000, A, 3, 3, map_=8), at(12_000, A, 4, 4, map_=8)]
    ctx = key(spark, *lines)
    rows = maps.samples(ctx)
    fl = {r.map: (r.floor, r.label, r.x0, r.x1) for r in maps.floors(ctx, rows).collect()}
    assert fl == {7: (1, "Hall 1", -10, 10), 8: (2, "Hall 2", -20, 20)}
    run = ctx.runs.first().run_id
    times = spark.createDataFrame([(run, 5200), (run, 6100), (run, 12_100), (run, 100)], "run_id string, ts long")
    assert {r.ts: r.map for r in maps.party_floor(times, ctx, rows).collect()} == {5200: 7, 6100: 7, 12_100: 8, 100: None}
    home = spark.createDataFrame([(run, f"e{i}", 0.0, 0.0, m) for i, m in enumerate((7, 8, 8, 8))], "run_id string, actor string, x double, y double, map long")
    of = spark.createDataFrame([(run, "s", f"e{i}") for i in range(4)] + [(run, "t", "e1")], "run_id string, segment string, enemy string")
    summons = spark.createDataFrame([(run, "e1"), (run, "e2"), (run, "e3")], "run_id string, enemy string")
    assert {r.segment: r.map for r in maps.segment_floors(home, of).collect()} == {"s": 8, "t": 8}
    assert {r.segment: r.map for r in maps.segment_floors(home, of, summons).collect()} == {"s": 7, "t": 8}
    x, y = maps.map_point(F.lit(0.0), F.lit(5.0), {k: F.lit(v) for k, v in {"x0": -10.0, "x1": 10.0, "y0": -5.0, "y1": 5.0}.items()})
    assert spark.range(1).select(x, y).first()[:] == (0.0, 0.5)


def test_segments_of_moments(spark):
    """A row with an enemy goes to its segment; one without to the segment at its time."""
    ctx = key(spark, at(5000, A, 1, 1), at(7000, A, 1, 1))
    parts = reports.segments(ctx)
    run = ctx.runs.first().run_id
    rows = spark.createDataFrame([(run, 1, 50_000, MOB), (run, 2, 6000, None), (run, 3, 50_000, None), (run, 4, 6000, None)], "run_id string, row long, ts long, enemy string")
    got = {r.row: r.segment for r in reports.with_segment(rows, parts, F.col("enemy")).collect()}
    assert got == {1: f"pull:{MOB}", 2: f"pull:{MOB}", 3: None, 4: f"pull:{MOB}"}
    assert reports.in_segment(reports.with_segment(rows, parts), None).count() == 4 and base(A, B)
