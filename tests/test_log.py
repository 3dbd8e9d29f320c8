"""The log domain on a small log written here."""

import pytest
from pyspark.sql import functions as F

from millrace.functions import text as tx
from millrace.plans import deaths, reports, runs
from millrace.sources import log

A, B, PET, MOB, MOB2, BOSS = "Player-1-0A", "Player-1-0B", "Pet-0-1-2-3-77-0001", "Creature-0-1-2-3-501-0001", "Creature-0-1-2-3-502-0002", "Creature-0-1-2-3-900-0003"
NAMES = {A: '"Ann-Home"', B: '"Bob, the Bold"', PET: '"Rex"', MOB: '"Imp"', MOB2: '"Ogre"', BOSS: '"Lord"', "0000000000000000": "nil"}
FLAGS = {A: "0x511", B: "0x512", PET: "0x1112"}


def stamp(ms):
    s, f = divmod(ms, 1000)
    return f"5/21/2024 {20 + s // 3600:02d}:{s // 60 % 60:02d}:{s % 60:02d}.{f:03d}+2"


def base(src, dst):
    return ",".join(f"{g},{NAMES[g]},{FLAGS.get(g, '0xa48')},0x0" for g in (src, dst))


def adv(who, owner="0000000000000000", hp=500, top=1000, mana=(0, 40, 80), x=1.5, y=2.5):
    return f"{who},{owner},{hp},{top},0,0,0,0,0,0,{mana[0]},{mana[1]},{mana[2]},0,{x:.2f},{y:.2f},7,1.0000,70"


def hit(ms, src, dst, amount, spell=(11, '"Fire (rank 2)"'), over=-1, crit="nil", owner="0000000000000000", who=None, hp=500, name="SPELL_DAMAGE"):
    pre = "" if name.startswith("SWING") else f",{spell[0]},{spell[1]},0x4"
    return f"{stamp(ms)}  {name},{base(src, dst)}{pre},{adv(who or src, owner, hp)},{amount},{amount},{over},4,nil,nil,nil,{crit},nil,nil,ST"


def heal(ms, src, dst, amount, over=0):
    return f"{stamp(ms)}  SPELL_HEAL,{base(src, dst)},21,\"Mend\",0x2,{adv(dst)},{amount},{amount},{over},0,nil"


def aura(ms, src, dst, spell, on=True, kind="DEBUFF"):
    return f"{stamp(ms)}  SPELL_AURA_{'APPLIED' if on else 'REMOVED'},{base(src, dst)},{spell},\"Mark\",0x1,{kind}"


def cast(ms, src, dst, spell, what="SUCCESS"):
    return f"{stamp(ms)}  SPELL_CAST_{what},{base(src, dst)},{spell},\"Kick\",0x1"


def who(ms, guid, spec):
    return f"{stamp(ms)}  COMBATANT_INFO,{guid},1,100,200,{spec},[(1,2,3),(4,5)],[],[{A},31,{B},32]"


def control(ms, line):
    return f"{stamp(ms)}  {line}"


LINES = [
    control(0, "COMBAT_LOG_VERSION,22,ADVANCED_LOG_ENABLED,1,BUILD_VERSION,12.1.0"), control(100, 'ZONE_CHANGE,2000,"Deep Hall",8'), control(200, 'MAP_CHANGE,7,"Hall",10.0,-10.0,5.0,-5.0'), hit(300, A, MOB, 9999),
    control(1000, 'CHALLENGE_MODE_START,"Deep Hall",2000,500,12,[9,10]'), who(1000, A, 64), who(1000, B, 257), who(1001, A, 65),
    hit(11_000, A, MOB, 1000), hit(12_000, A, MOB, 500, crit=1, spell=(12, '"Fire"')), hit(13_000, B, MOB2, 300, over=100, who=B), hit(13_050, PET, MOB, 200, owner=B, name="SWING_DAMAGE"), f"{stamp(13_100)}  UNIT_DIED,{base('0000000000000000', MOB)},0",
    cast(13_200, MOB2, A, 71, "START"), cast(13_900, A, MOB2, 61), f"{stamp(14_000)}  SPELL_INTERRUPT,{base(A, MOB2)},61,\"Kick\",0x1,71,\"Bolt\",0x4", cast(15_000, A, MOB2, 61),
    aura(16_000, A, MOB2, 81), aura(18_000, A, MOB2, 81, on=False), heal(19_000, B, A, 400, over=150),
    control(30_000, 'ENCOUNTER_START,77,"Lord",8,5,2000'), hit(31_000, A, BOSS, 2000, hp=900, who=BOSS), hit(32_000, BOSS, B, 700, spell=(91, '"Slam"'), over=50), f"{stamp(32_001)}  UNIT_DIED,{base('0000000000000000', B)},0",
    f"{stamp(33_000)}  SPELL_DISPEL,{base(A, BOSS)},65,\"Purge\",0x1,95,\"Rage\",0x1,BUFF", f"{stamp(34_000)}  SPELL_DAMAGE_SUPPORT,{base(A, BOSS)},41,\"Might\",0x1,{adv(A)},100,100,-1,4,nil,nil,nil,nil,nil,nil,{B}",
    f"{stamp(35_000)}  SPELL_ABSORBED,{base(BOSS, A)},91,\"Slam\",0x1,{B},{NAMES[B]},0x512,0x0,51,\"Ward\",0x2,250,900,nil", f"{stamp(36_000)}  ENVIRONMENTAL_DAMAGE,{base('0000000000000000', A)},{adv(A)},Falling,120,120,-1,1,0,0,0,nil,nil,nil", f"{stamp(36_500)}  SPELL_MISSED,{base(A, BOSS)},11,\"Fire\",0x4,IMMUNE,nil",
    control(40_000, 'ENCOUNTER_END,77,"Lord",8,5,1,10000'), control(61_000, "CHALLENGE_MODE_END,2000,1,12,59000"), hit(70_000, A, MOB, 9999), "not a line", control(71_000, "NEW_EVENT,1"),
]


@pytest.fixture(scope="module")
def ctx(spark):
    return reports.open_log(spark, log.rows_from_lines(spark, LINES))


def test_fields(spark):
    t = log.tokens(log.rows_from_lines(spark, LINES)).collect()
    by = {r.row: r for r in t}
    assert [x for x in by[5].f] == ['"Deep Hall"', "2000", "500", "12", "[9,10]"]
    assert by[10].f[5] == '"Imp"' and by[8].f[-1] == f"[{A},31,{B},32]" and len(t) == len(LINES) - 1
    assert by[2].wall_ms - by[1].wall_ms == 100 and by[1].offset_min == 120
    assert {r.row: r.wall_ms for r in log.tokens(log.rows_from_lines(spark, ["12/31 23:59:59.500  A,1", "1/1 00:00:00.000  B,2"])).collect()} == {1: 1735689599500, 2: 1735689600000}


def test_plain_and_nested_lines_split_alike(spark):
    """The quick way and the pattern, on lines of all kinds."""
    lines = ["", "a", "a,,b", "a,", ",", '"a,b",c', '"a","b",0x1', "[1,2],3", "(a,(b,c)),d", '"open', 'x,"y', '1,"a b",nil,[],z', "é,漢,1"]
    pattern = F.regexp_extract_all("s", F.lit(tx.FIELD), F.lit(1))
    got = spark.createDataFrame([(x,) for x in lines], "s string").select("s", tx.split_fields(F.col("s")).alias("a"), F.slice(pattern, F.lit(1), F.greatest(F.size(pattern) - 1, F.lit(0))).alias("b")).collect()
    assert all(r.a == r.b for r in got) and {r.s: r.a for r in got}["a,,b"] == ["a", "", "b"]


def test_year_rolls_over_per_file(spark):
    rows = [(f, i + 1, f"{m}/1 00:00:00.000  A,{i}") for f, ms in (("a", (11, 12, 1, 2, 1)), ("b", (3, 2))) for i, m in enumerate(ms)]
    t = log.tokens(spark.createDataFrame(rows, "file_id string, row long, line string"), 2024).withColumn("y", F.year(F.timestamp_millis("wall_ms")))
    assert [(r.file_id, r.y) for r in t.orderBy("file_id", "row").collect()] == [("a", y) for y in (2024, 2024, 2025, 2025, 2026)] + [("b", 2024), ("b", 2025)]


def test_readers(spark):
    row = spark.createDataFrame([("12x", "0x1f", "nil", '"a,b"', "1", "-3.5", "0")], "a string, b string, c string, d string, e string, f string, g string").select(
        tx.field_int("a"), tx.field_hex(F.col("b")), tx.field_text(F.col("c"), "?"), tx.field_text(F.col("d")), tx.field_bool(F.col("e")), tx.field_float("f"), tx.field_bool(F.col("g")), tx.field_bool(F.col("c")), tx.fnv1a32(F.lit("a")), tx.clock(F.lit(61_500)), tx.slug(F.lit("Ann's  Hall!")), tx.short_number(F.lit(1_234_567.0))
    ).first()
    assert list(row) == [12, 31, "?", "a,b", True, -3.5, False, False, 0xE40C292C, "1:01", "anns-hall", "1.2m"]


def test_decode(spark):
    e = {r.row: r for r in log.decode(log.tokens(log.rows_from_lines(spark, LINES))).collect()}
    first = e[9]
    assert (first.code, first.src, first.dst, first.spell_id, first.spell, first.amount, first.waste, first.crit) == ("SPELL_DAMAGE", A, MOB, 11, "Fire (rank 2)", 1000, -1, False)
    assert (first.hp, first.hp_max, first.x, first.y, first.map, first.mana) == (500, 1000, 1.5, 2.5, 7, 50) and e[10].crit and e[11].waste == 100
    soak = next(r for r in e.values() if r.code == "SPELL_ABSORBED")
    assert (soak.caster, soak.caster_name, soak.extra_spell_id, soak.extra_spell, soak.amount) == (B, "Bob, the Bold", 51, "Ward", 250)
    fall = next(r for r in e.values() if r.code == "ENVIRONMENTAL_DAMAGE")
    assert (fall.environment, fall.amount, fall.waste) == ("Falling", 120, -1)
    support = next(r for r in e.values() if r.support)
    assert (support.code, support.supporter, support.amount) == ("SPELL_DAMAGE", B, 100)
    miss = next(r for r in e.values() if r.code == "SPELL_MISSED")
    assert miss.avoided and miss.miss == "IMMUNE"


def test_narrow_block_is_measured(spark):
    line = f"{stamp(1)}  SPELL_DAMAGE,{base(A, MOB)},11,\"Fire\",0x4,{A},0000000000000000,5,10,0,0,0,0,0,1,2,0,3.50,4.50,7,1.0,70,600,-1,4,nil,nil,nil,1,nil,nil"
    r = log.decode(log.tokens(log.rows_from_lines(spark, [line]))).first()
    assert (r.x, r.y, r.map, r.amount, r.waste, r.crit) == (3.5, 4.5, 7, 600, -1, True)


def test_runs_and_party(spark, ctx):
    r = ctx.runs.collect()
    assert len(r) == 1 and (r[0].kind, r[0].title, r[0].level, r[0].success, r[0].total_ms) == ("key", "Deep Hall", 12, True, 59_000)
    assert [(b.title, b.end_ms - b.start_ms) for b in r[0].bosses] == [("Lord", 10_000)]
    assert [(p.guid, p.place, p.spec_id) for p in ctx.party.orderBy("place").collect()] == [(A, 1, 64), (B, 2, 257)]
    assert ctx.events.agg(F.min("ts"), F.max("ts")).first()[:] == (10_000, 35_500)
    assert {(o.guid, o.caster, o.spell_id) for o in runs.opening_auras(ctx.party).collect()} == {(g, c, s) for g in (A, B) for c, s in ((A, 31), (B, 32))}
    m = runs.maps(ctx.controls, ctx.runs).first()
    assert (m.map, m.x0, m.x1, m.y0, m.y1) == (7, -10, 10, -5, 5)


def _runs_of(spark, lines):
    t = log.tokens(log.rows_from_lines(spark, lines))
    return runs.runs(log.controls(t), t.groupBy("file_id").agg(F.max("wall_ms").alias("wall_ms"))).collect()


def test_run_edge_cases(spark):
    start, end = 'CHALLENGE_MODE_START,"Hall",1,2,3,[9]', "CHALLENGE_MODE_END,1,1,3,5000"
    assert [r.start_row for r in _runs_of(spark, [control(0, start), control(10, start), control(5000, end)])] == [1]
    assert [r.start_row for r in _runs_of(spark, [control(0, start), control(10, start.replace("3,[9]", "4,[9]")), control(5000, end)])] == [2]
    assert _runs_of(spark, [control(5, end)]) == []
    gone = _runs_of(spark, [control(0, start), control(9000, 'ZONE_CHANGE,5,"Town",0'), control(90_000, "NEW_EVENT,1")])
    assert [(r.end_row, r.success, r.total_ms) for r in gone] == [(2, False, 9000)]
    back = _runs_of(spark, [control(0, start), control(9000, 'ZONE_CHANGE,5,"Town",0'), control(20_000, 'ZONE_CHANGE,1,"Hall",8'), control(95_000, end)])
    assert [r.success for r in back] == [True]
    raid = [control(0, 'ENCOUNTER_START,8,"Wyrm",16,20,9'), control(500, 'ENCOUNTER_START,8,"Wyrm",16,20,9'), control(900, 'ENCOUNTER_END,9,"Other",16,20,1,1'), control(1500, 'ENCOUNTER_END,8,"Wyrm",16,20,0,1000')]
    assert [(r.kind, r.start_row, r.end_row, r.pull, r.success) for r in _runs_of(spark, raid)] == [("raid", 2, 4, 2, False)]


def test_owner_credit_and_breakdown(ctx):
    done = {(r.actor, r.spell_id): r for r in reports.breakdown(ctx).collect()}
    assert done[(A, 11)].total == 3000 and done[(A, 12)].crits == 1 and done[(B, 0)].total == 200 and done[(B, 0)].spell == "Melee"
    assert done[(B, 11)].total == 200 and done[(B, 11)].wasted == 100 and done[(B, 11)].raw == 300 and done[(A, 11)].misses == 1
    assert sum(r.share for r in done.values()) == pytest.approx(1) and done[(A, 11)].per_second == pytest.approx(3000 / 60)
    merged = {(r.actor, r.ability): r for r in reports.by_ability(reports.breakdown(ctx)).collect()}
    assert merged[(A, "Fire")].total == 3500 and merged[(A, "Fire")].parts == 2
    taken = {(r.actor, r.spell_id): r.total for r in reports.breakdown(ctx, "taken").collect()}
    assert taken == {(B, 91): 650, (A, 0): 120}
    healing = {(r.actor, r.spell_id): r.total for r in reports.breakdown(ctx, "healing").collect()}
    assert healing == {(B, 21): 250, (B, 51): 250}
    assert {r.actor: r.active for r in reports.active_time(ctx).collect()} == {A: 1000, B: 50}


def test_segments(ctx):
    seg, of = reports.segments(ctx)
    got = {r.segment: (r.start, r.end, r.boss) for r in seg.collect()}
    assert got == {f"pull:{MOB}": (10_000, 12_050, False), "boss:0": (29_000, 39_000, True)}
    who_ = {r.enemy: (r.segment, r.defeated) for r in of.collect()}
    assert who_ == {MOB: (f"pull:{MOB}", True), MOB2: (f"pull:{MOB}", False), BOSS: ("boss:0", False)}
    lab = {r.segment: r.label for r in reports.roster(of).collect() if r.label}
    assert lab["boss:0"] == "Lord" and lab[f"pull:{MOB}"].endswith("+1")
    whole = ctx.events.sparkSession.createDataFrame([(500, 501, 4, 100), (500, 502, 8, 100)], "mode_id long, npc_id long, value int, total int")
    f = reports.forces(reports.roster(of), whole, ctx.runs).first()
    assert (f["count"], f["fraction"]) == (4, 0.04)


def test_segments_conserve_damage(ctx):
    _, of = reports.segments(ctx)
    rows = reports.counted_rows(ctx, "done").filter("code <> 'SPELL_ABSORBED'")
    parts = rows.join(of.select("run_id", F.col("enemy").alias("dst"), "segment"), ["run_id", "dst"]).agg(F.sum("value")).first()[0]
    assert parts == rows.agg(F.sum("value")).first()[0]


def test_interrupts(spark, ctx):
    ids = spark.createDataFrame([(61,)], "spell_id long")
    got = {r.ts: (r.actor, r.outcome, r.stopped) for r in reports.interrupts(ctx, ids).collect()}
    assert got == {12_900: (A, "interrupted", 1), 14_000: (A, "doubled", 0)}
    s = reports.interrupt_summary(reports.interrupts(ctx, ids)).first()
    assert (s.casts, s.stops, s.doubled) == (2, 1, 1)


def test_control_dispels_avoidable(spark, ctx):
    cc = reports.crowd_control(ctx, spark.createDataFrame([(81, 4)], "spell_id long, mask int"))
    assert [(r.actor, r.ms, r.ended) for r in cc.collect()] == [(A, 2000, "removed")]
    assert reports.control_summary(cc).first()[1:] == (A, 1, 1, 2000, 0, 4)
    none = spark.createDataFrame([], "spell_id long")
    assert [(r.actor, r.kind) for r in reports.dispels(ctx, none).collect()] == [(A, "purge")]
    assert [r.kind for r in reports.dispels(ctx, spark.createDataFrame([(95,)], "spell_id long")).collect()] == ["soothe"]
    hits = reports.avoidable(ctx, spark.createDataFrame([(91, None)], "spell_id long, unless long")).collect()
    assert [(r.actor, r.amount, r.fatal) for r in hits] == [(B, 700, True)]


def test_deaths(ctx):
    dead = deaths.deaths(ctx, reports.segments(ctx))
    assert [(r.dst, r.ts, r.nth, r.dead_at_once, r.since_previous, r.segment) for r in dead.collect()] == [(B, 31_001, 1, 1, None, "boss:0")]
    r = deaths.recap(ctx, dead)
    t = r.totals().first()
    assert (t.taken, t.healed, t.soaked, t.blow.spell_id, t.blow.overkill) == (650, 0, 0, 91, 50)
    assert [(x.spell_id, x.total, x.hits, x.source) for x in r.by_ability().collect()] == [(91, 650, 1, BOSS)]


def test_auras_positions_summary(spark, ctx):
    up = {(r.actor, r.spell_id): r.up for r in reports.aura_uptime(ctx).collect()}
    assert up == {(A, 81): 2000}
    spans = {(r.wearer, r.spell_id): (r.start, r.end) for r in reports.aura_spans(ctx).collect()}
    assert spans[(MOB2, 81)] == (15_000, 17_000) and spans[(A, 31)] == (0, 60_000)
    tracks = reports.position_tracks(ctx)
    assert tracks.filter(F.col("actor") == A).count() > 0 and reports.distance(tracks).filter(F.col("actor") == A).first().yards == 0
    s = {r.guid: (r.damage, r.healing, r.deaths) for r in reports.summary(ctx).collect()}
    assert s[A][0] == 3500 and s[B] == (400, 500, 1)
    clocks = spark.createDataFrame([(61, 15_000, 1)], "spell_id long, recovery_ms int, charges int")
    assert sorted(r.ready_at for r in reports.readiness(ctx, clocks).collect()) == [27_900, 42_900]


def test_lines_of_split_files(spark, tmp_path):
    body = "".join(f"{i}\r\n\n" for i in range(3000))
    (tmp_path / "a.txt").write_text(body)
    (tmp_path / "b.txt").write_text("x\ny")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = [r.line for r in log.log_lines(spark, str(tmp_path)).filter(F.col("file_id").endswith("a.txt")).orderBy("row").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == [str(i) for i in range(3000)]
    (tmp_path / "game" / "Logs").mkdir(parents=True)
    (tmp_path / "game" / "Logs" / "one.txt").write_text("")
    assert log.discover(str(tmp_path)) == [str(tmp_path / "game" / "Logs" / "one.txt")]


# several files, and the cases that the log above does not have

NONE = "0000000000000000"
START, END = control(0, 'CHALLENGE_MODE_START,"Hall",1,2,3,[9]'), control(60_000, "CHALLENGE_MODE_END,1,1,3,60000")


def key(spark, *lines, files=1):
    """The context of one key with these lines between its start and end, read from so many equal files."""
    body = [START, who(1, A, 64), who(2, B, 250), *lines, END]
    rows = log.rows_from_lines(spark, body, "f0")
    for k in range(1, files):
        rows = rows.unionByName(log.rows_from_lines(spark, body, f"f{k}"))
    return reports.open_log(spark, rows)


def miss(ms, src, dst, spell=61):
    return f"{stamp(ms)}  SPELL_MISSED,{base(src, dst)},{spell},\"Kick\",0x1,PARRY,nil"


def died(ms, guid):
    return f"{stamp(ms)}  UNIT_DIED,{base(NONE, guid)},0"


def test_two_files_give_every_report_twice(spark):
    """Rows of different files never meet, whatever their numbers."""
    one = reports.open_log(spark, log.rows_from_lines(spark, LINES, "a"))
    two = reports.open_log(spark, log.rows_from_lines(spark, LINES, "a").unionByName(log.rows_from_lines(spark, LINES, "b")))
    ids = spark.createDataFrame([(61,)], "spell_id long")
    kinds, dim = spark.createDataFrame([(81, 4)], "spell_id long, mask int"), spark.createDataFrame([(91, 31)], "spell_id long, unless long")
    clocks = spark.createDataFrame([(61, 15_000, 1)], "spell_id long, recovery_ms int, charges int")
    views = {
        "interrupts": lambda c: reports.interrupts(c, ids).select("actor", "ts", "outcome", "stopped"),
        "deaths": lambda c: deaths.recap(c, deaths.deaths(c)).totals().select("taken", "healed"),
        "hits": lambda c: reports.avoidable(c, dim).select("actor", "ts", "amount"),
        "control": lambda c: reports.crowd_control(c, kinds).select("actor", "ts", "ms"),
        "breakdown": lambda c: reports.breakdown(c).select("actor", "spell_id", "total", "hits", "share"),
        "healing": lambda c: reports.breakdown(c, "healing").select("actor", "spell_id", "total"),
        "auras": lambda c: reports.aura_spans(c).select("wearer", "spell_id", "start", "end"),
        "tracks": lambda c: reports.position_tracks(c).select("actor", "ts", "x"),
        "ready": lambda c: reports.readiness(c, clocks).select("actor", "ts", "ready_at"),
        "segments": lambda c: reports.segments(c)[1].select("enemy", "segment", "defeated"),
        "dispels": lambda c: reports.dispels(c, ids, parts=reports.segments(c)).select("actor", "ts", "kind", "segment"),
    }
    for name, view in views.items():
        a, b = (sorted(map(str, view(c).collect())) for c in (one, two))
        assert a and sorted(a * 2) == b, name
    assert two.runs.count() == 2 and one.events.agg(F.max("row")).first()[0] < two.events.agg(F.max("row")).first()[0]


def test_orphan_absorbs_take_the_attackers_source(spark):
    soak = f"{stamp(5000)}  SPELL_ABSORBED,{NONE},nil,0x80000000,0x0,{A},{NAMES[A]},0x511,0x0,91,\"Slam\",0x1,{B},{NAMES[B]},0x512,0x0,51,\"Ward\",0x2,250,900,nil"
    rows = lambda *more: {r.ts: r.src for r in key(spark, soak, *more).events.filter("code = 'SPELL_ABSORBED'").collect()}
    assert rows(hit(5050, BOSS, A, 10, spell=(91, '"Slam"'))) == {5000: BOSS}
    assert rows(hit(5150, BOSS, A, 10, spell=(91, '"Slam"'))) == {5000: None} and rows(hit(5050, BOSS, A, 10, spell=(92, '"Slap"'))) == {5000: None}


def test_support_moves_up_to_what_the_carrier_holds(spark):
    twin = lambda ms, amount, spell=41: f"{stamp(ms)}  SPELL_DAMAGE_SUPPORT,{base(A, BOSS)},{spell},\"Might\",0x1,{adv(A)},{amount},{amount},-1,4,nil,nil,nil,nil,nil,nil,{B}"
    ctx = key(spark, hit(5000, A, BOSS, 300), twin(5001, 100), hit(6000, A, BOSS, 50, spell=(12, '"Fire"')), twin(6000, 80))
    got = {(r.actor, r.spell_id): (r.total, r.hits) for r in reports.breakdown(ctx).collect()}
    assert got == {(A, 11): (200, 1), (A, 12): (0, 1), (B, 41): (150, 2)}
    plain = {(r.actor, r.spell_id): r.total for r in reports.breakdown(ctx, credit=False).collect()}
    assert plain == {(A, 11): 300, (A, 12): 50}
    assert {r.actor: (r.given, r.received) for r in reports.support_given(ctx).collect()} == {A: (0, 180), B: (180, 0)}


def test_support_twin_across_an_absorb(spark):
    """The row two before is the twin only if an absorb stands between; a claimed row is not claimed again."""
    soak = f"{stamp(5000)}  SPELL_ABSORBED,{base(A, BOSS)},11,\"Fire\",0x1,{B},{NAMES[B]},0x512,0x0,51,\"Ward\",0x2,250,900,nil"
    support = f"{stamp(5001)}  SPELL_DAMAGE_SUPPORT,{base(A, BOSS)},11,\"Fire\",0x4,{adv(A)},0,0,-1,4,nil,nil,nil,nil,nil,nil,{B}"
    marks = lambda *mid: [(r.code, r.twinned) for r in key(spark, hit(5000, A, BOSS, 0), *mid, support).events.filter("NOT support").orderBy("row").collect()]
    assert marks(soak) == [("SPELL_DAMAGE", True), ("SPELL_ABSORBED", False)]
    assert marks() == [("SPELL_DAMAGE", True)] and marks(heal(5000, B, A, 5)) == [("SPELL_DAMAGE", False), ("SPELL_HEAL", False)]


def test_missed_interrupts(spark):
    ctx = key(spark, cast(5000, A, BOSS, 61), miss(5150, A, BOSS), cast(9000, A, BOSS, 61), miss(9300, A, BOSS))
    assert {r.ts: r.outcome for r in reports.interrupts(ctx, spark.createDataFrame([(61,)], "spell_id long")).collect()} == {5000: "missed", 9000: "nothing"}


def test_knockbacks_count_a_target_once(spark):
    push = lambda ms, dst: hit(ms, A, dst, 5, spell=(77, '"Push"'))
    ctx = key(spark, push(5000, MOB), aura(5010, A, MOB, 77), push(5020, MOB2), push(5900, MOB), push(9000, MOB))
    cc = reports.crowd_control(ctx, spark.createDataFrame([(77, reports.KNOCKBACK)], "spell_id long, mask int"))
    assert sorted((r.ts, r.dst, r.ms, r.ended) for r in cc.collect()) == [(5000, MOB, 0, "knocked"), (5020, MOB2, 0, "knocked"), (9000, MOB, 0, "knocked")]
    s = reports.control_summary(cc).first()
    assert (s.casts, s.targets) == (2, 3)


def test_avoidable_rules(spark):
    dim = spark.createDataFrame(
        [(91, 71, None, None, None, None, None, False), (92, None, 72, None, None, None, None, False), (93, None, None, 55, 73, 100, 900, False), (94, None, None, None, None, None, None, True)],
        "spell_id long, unless long, unless_marked long, after_cast long, after_aura long, after_from long, after_ms long, tank boolean",
    )
    slam = lambda ms, dst, spell: hit(ms, BOSS, dst, 10, spell=(spell, '"Slam"'))
    lines = [
        aura(1000, BOSS, A, 71), aura(2000, BOSS, A, 71, on=False), slam(2040, A, 91), slam(2051, A, 91),
        aura(3000, BOSS, A, 72), slam(3500, A, 92), slam(3500, B, 92), aura(4000, BOSS, A, 72, on=False), slam(4050, A, 92), slam(4051, A, 92),
        cast(5000, BOSS, A, 55, "START"), aura(5050, BOSS, A, 73), slam(5060, A, 93), aura(5500, BOSS, A, 73), slam(5510, A, 93), aura(6000, BOSS, A, 73), slam(6010, A, 93), slam(6020, B, 93),
        slam(7000, A, 94), slam(7001, B, 94),
    ]
    hits = reports.avoidable(key(spark, *lines), dim)
    assert sorted((r.ts, r.actor) for r in hits.collect()) == [(2051, A), (3500, B), (4051, A), (5060, A), (6010, A), (6020, B), (7000, A)]
    own, named = reports.avoidable_summary(key(spark, *lines), hits)
    assert {r.actor: r.hits for r in own.collect()} == {A: 5, B: 2} and [(r.ability, r.hits, r.actors) for r in named.collect()] == [("Slam", 7, 2)]


def test_cleanse_of_enemies_is_none(spark):
    off = lambda ms, dst, kind: f"{stamp(ms)}  SPELL_DISPEL,{base(A, dst)},65,\"Purge\",0x1,95,\"Rage\",0x1,{kind}"
    ctx = key(spark, hit(5000, A, MOB, 5), off(5100, MOB, "DEBUFF"), off(6000, MOB2, "DEBUFF"), off(7000, B, "DEBUFF"), off(8000, MOB, "BUFF"), off(9000, B, "BUFF"))
    parts = reports.segments(ctx)
    rows = reports.dispels(ctx, spark.createDataFrame([], "spell_id long"), parts=parts, bleeds=spark.createDataFrame([(95,)], "spell_id long"))
    assert sorted((r.ts, r.kind, r.bleed, r.segment) for r in rows.collect()) == [(6000, "cleanse", True, None), (7000, "cleanse", True, None), (8000, "purge", False, f"pull:{MOB}")]
    own, states = reports.dispel_summary(rows)
    assert [(r.casts, r.removed, r.purges, r.cleanses) for r in own.collect()] == [(3, 3, 1, 2)] and {(r.kind, r.removed) for r in states.collect()} == {("purge", 1), ("cleanse", 2)}


def test_summons_come_last(spark):
    totem = "Creature-0-1-2-3-777-0009"
    NAMES[totem] = '"Totem"'
    made = f"{stamp(4000)}  SPELL_SUMMON,{base(MOB, totem)},7,\"Call\",0x1"
    ctx = key(spark, hit(4500, A, MOB, 5, who=MOB), made, hit(5000, A, totem, 5, who=totem, hp=900))
    _, of = reports.segments(ctx)
    r = {x.name: (x.summon, x.place, x.label) for x in reports.roster(of, reports.summoned(ctx), ctx.runs).collect()}
    assert r == {"Imp": (False, 1, "Imp +1"), "Totem": (True, 2, None)}


def test_death_recap(spark):
    ctx = key(
        spark, hit(2000, BOSS, B, 9999), aura(3000, A, B, 81, kind="BUFF"), aura(20_500, BOSS, B, 84), aura(21_000, BOSS, B, 82), aura(21_500, BOSS, B, 83, on=False), heal(22_000, A, B, 100, over=40), cast(22_500, B, B, 65),
        hit(23_000, BOSS, B, 300, who=B, hp=700), hit(23_500, MOB, B, 200, spell=(12, '"Fire"'), who=B, hp=500), aura(23_600, BOSS, B, 84, on=False), hit(24_000, BOSS, B, 600, over=100, who=B, hp=0), died(24_000, B),
        f"{stamp(30_000)}  SPELL_RESURRECT,{base(A, B)},8,\"Rise\",0x2", died(40_000, A), died(50_000, B),
    )
    dead = deaths.deaths(ctx)
    assert [(r.dst, r.dead_at_once, r.nth, r.since_previous) for r in dead.orderBy("row").collect()] == [(B, 1, 1, None), (A, 1, 1, 16_000), (B, 2, 2, 10_000)]
    r = deaths.recap(ctx, dead.filter("nth = 1 AND ts = 24000"))
    t = r.totals().first()
    assert (t.taken, t.healed, t.blow.net, t.blow.overkill) == (1000, 60, 500, 100)
    assert [x.hp for x in r.trace().orderBy("row").collect()] == [500, 700, 500, 0]
    assert {(x.spell_id, x.total, x.hits) for x in r.by_ability().collect()} == {(11, 800, 2), (12, 200, 1)}
    spans = {x.spell_id: (x.start, x.end, x.open_start, x.open_end) for x in r.states().collect()}
    assert spans == {81: (3000, 24_000, False, True), 82: (21_000, 24_000, False, True), 83: (-6000, 21_500, True, False), 84: (20_500, 23_600, False, False)}
    assert [x.spell_id for x in r.debuffs_at_death(spark.createDataFrame([], "spell_id long")).collect()] == [82]
    assert [x.spell_id for x in r.own_casts(spark.createDataFrame([(65,)], "spell_id long")).collect()] == [65]
    assert r.one_shots().count() == 0
    assert {(x.spell_id, x.net) for x in deaths.healing_in(r, 5000).collect()} == {(21, 60)}
    bars = {(x.bucket, x.spell_id): (x.net, x.hp) for x in r.buckets(1000).collect() if x.spell_id}
    assert bars[(29, 11)] == (300, 500) and bars[(30, 11)] == (500, 0)


def test_one_shot_and_readiness(spark):
    ctx = key(
        spark, cast(1000, A, A, 31), cast(1200, A, A, 900), cast(1300, A, A, 900), cast(1400, A, A, 900), aura(2000, A, B, 500, kind="BUFF"), aura(2500, A, A, 500, kind="BUFF"), cast(6000, B, B, 31),
        hit(9000, BOSS, B, 960, who=B, hp=0, over=1), hit(9400, BOSS, B, 30, who=B, hp=0, over=20), died(9500, B), died(50_000, A),
    )
    dead = deaths.deaths(ctx)
    r = deaths.recap(ctx, dead)
    assert [x.fraction for x in r.one_shots().collect()] == [pytest.approx(0.969)]
    clocks = spark.createDataFrame([(500, 20_000, 1)], "spell_id long, recovery_ms int, charges int")
    used = deaths.uses(ctx, spark.createDataFrame([(31,)], "spell_id long"), spark.createDataFrame([(900,)], "spell_id long"), clocks)
    assert used.filter("what = 'defensive'").count() == 1  # two states, one press
    ready = deaths.ready_at_death(ctx, dead, used, clocks)
    got = {(x.dst, x.what): x.state for x in ready.collect()}
    assert got == {(B, "potion"): "pressed", (A, "potion"): "cooldown", (A, "stone"): "cooldown", (A, "defensive"): "ready"}
    out = {x.dst: (x.forgot, x.forgot_before) for x in deaths.forgotten(dead, ready, r.one_shots()).collect()}
    assert out == {B: (False, 0), A: (False, 0)}


def opened(spark, lines):
    head = [control(0, 'CHALLENGE_MODE_START,"Deep Hall",2000,500,12,[9,10]'), who(0, A, 64), who(0, B, 257)]
    return reports.open_log(spark, log.rows_from_lines(spark, [*head, *lines, control(90_000, "CHALLENGE_MODE_END,2000,1,12,90000")]))


def test_a_shield_coming_off_is_healing_activity(spark):
    """Between heals 14 seconds apart a shield comes off; a plain buff that ends says nothing."""
    off = f"{aura(16_000, B, A, 17, on=False, kind='BUFF')},0"
    told = opened(spark, [heal(10_000, B, A, 100), off, aura(20_000, B, A, 774, on=False, kind="BUFF"), heal(24_000, B, A, 100)])
    assert {r.actor: r.active for r in reports.active_time(told, "healing").collect()} == {B: 14_000}
    bare = opened(spark, [heal(10_000, B, A, 100), aura(16_000, B, A, 17, on=False, kind="BUFF"), heal(24_000, B, A, 100)])
    assert {r.actor: r.active for r in reports.active_time(bare, "healing").collect()} == {B: 0}


def test_unnamed_removals_close_a_sole_copy(spark):
    nobody = "0000000000000000"
    got = reports.aura_spans(opened(spark, [
        aura(1_000, A, MOB, 81), aura(5_000, nobody, MOB, 81, on=False), hit(9_000, A, MOB, 1),
        aura(1_000, A, MOB, 82), aura(2_000, B, MOB, 82), aura(5_000, nobody, MOB, 82, on=False), aura(6_000, B, MOB, 82, on=False), aura(8_000, nobody, MOB, 82, on=False),
        aura(3_000, A, MOB2, 81), aura(4_000, A, MOB2, 81, on=False), aura(5_000, nobody, MOB2, 81, on=False), aura(7_000, A, MOB2, 81), aura(8_000, A, MOB2, 81, on=False),
    ])).collect()
    assert sorted((r.wearer, r.spell_id, r.start, r.end) for r in got if r.spell_id > 80) == [(MOB, 81, 1_000, 5_000), (MOB, 82, 1_000, 8_000), (MOB2, 81, 3_000, 4_000), (MOB2, 81, 7_000, 8_000)]
