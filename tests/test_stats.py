"""Moment statistics, who pulled, and badges, on small runs."""

import pytest
from pyspark.sql import functions as F

from millrace.plans import badges, moments, reports, runs as run_plan
from millrace.sources import log
from tests.test_log import A, B, BOSS, MOB, MOB2, NAMES, NONE, adv, aura, base, cast, control, died, heal, hit, key, stamp, who


def state(ms, src, dst, spell, what, kind="BUFF"):
    return aura(ms, src, dst, spell, kind=kind).replace("SPELL_AURA_APPLIED", f"SPELL_AURA_{what}")


def ids(spark, *spells):
    return spark.createDataFrame([(s,) for s in spells], "spell_id long")


def test_procs(spark):
    """Half a second apart; not in the millisecond of a removal; the last application moves on even if it does not count."""
    up = lambda ms, what="REFRESH": state(ms, A, A, 88, what)
    ctx = key(spark, up(1000, "APPLIED"), up(1400), up(1800), up(2300), up(5000, "REMOVED"), up(5000, "APPLIED"), up(6000), up(9000, "REMOVED"), up(9500, "APPLIED"))
    run = ctx.runs.first().run_id
    rates = spark.createDataFrame([(run, A, 88, 2.0), (run, B, 88, 2.0)], "run_id string, actor string, spell_id long, per_minute double")
    assert [(r.actor, r.procs, r.expected) for r in moments.procs_expected(ctx, rates).collect()] == [(A, 4, 2.0)]


def test_consumables(spark):
    drink = lambda ms: cast(ms, A, A, 21)
    ctx = key(spark, heal(1000, A, A, 50, over=10), drink(1500), heal(30_000, A, A, 70), heal(31_001, A, A, 5), drink(32_500), heal(33_000, A, A, 5, over=4))
    got = sorted((r.ts, r.amount, r.overhealing) for r in moments.consumable_uses(ctx, ids(spark, 21)).collect())
    assert got == [(1000, 110, 10), (31_001, 5, 0), (32_500, 1, 4)]


def test_lusts_and_picks(spark):
    ctx = key(spark, cast(1000, A, A, 5), state(1800, A, B, 5, "APPLIED"), cast(9000, A, A, 5))
    assert [r.ts for r in moments.lusts(ctx, ids(spark, 5)).collect()] == [1000]
    third = "Player-1-0C"
    NAMES[third] = '"Cy"'
    from tests.test_log import FLAGS

    FLAGS[third] = "0x512"
    on = lambda ms, dst, spell=70: aura(ms, BOSS, dst, spell)
    lone = [on(2000, A), on(5000, B), on(8000, third), on(9499, third), on(12_000, A)]
    both = [on(2000, A, 71), on(2100, B, 71), on(5000, B, 71), on(8000, third, 71)]
    ctx = key(spark, who(3, third, 64), *lone, *both)
    assert sorted((r.ts, r.actor) for r in moments.random_picks(ctx, ids(spark, 99)).collect()) == [(2000, A), (5000, B), (8000, third), (12_000, A)]
    assert moments.random_picks(ctx, ids(spark, 70)).count() == 0


def test_tallies_and_swings(spark):
    swing = lambda ms: hit(ms, BOSS, A, 5, name="SWING_DAMAGE_LANDED")
    ctx = key(spark, swing(1000), aura(2000, BOSS, A, 5), swing(2500), aura(3000, BOSS, A, 5, on=False), aura(3100, BOSS, A, 5, on=False), aura(3200, BOSS, A, 6), swing(3500), aura(3600, BOSS, A, 6, on=False), swing(4000), aura(5000, A, BOSS, 7))
    assert [(r.actor, r.swings) for r in moments.unmarked_swings(ctx).collect()] == [(A, 2)]
    assert [(r.actor, r.debuffs, r.debuffs_applied) for r in moments.debuff_tallies(ctx).collect()] == [(A, 2, 1)]


def test_stands_and_drains(spark):
    parts = spark.createDataFrame([("x", "boss:0", "Lord", 0, 20_000, True, True), ("x", "boss:1", "Lord", 0, 40_000, True, True)], "run_id string, segment string, title string, start long, end long, boss boolean, success boolean")
    mana = lambda ms, left: f"{stamp(ms)}  SPELL_HEAL,{base(A, A)},21,\"Mend\",0x2,{adv(A, mana=(0, left, 80))},5,5,0,0,nil"
    ctx = key(spark, mana(1000, 40), died(15_000, B), mana(18_000, 4), died(30_000, A), f"{stamp(31_000)}  SPELL_RESURRECT,{base(B, A)},8,\"Rise\",0x2", heal(35_000, A, B, 5))
    parts = parts.withColumn("run_id", F.lit(ctx.runs.first().run_id))
    assert [(r.segment, r.actor) for r in moments.last_stands(ctx, parts).collect()] == [("boss:0", A)]
    assert {(r.segment, r.mana) for r in moments.drains(ctx, parts).filter(F.col("actor") == A).collect()} == {("boss:0", 5), ("boss:1", 5)}


def test_melds(spark):
    go = lambda ms: cast(ms, A, A, moments.SHADOWMELD)
    seen = lambda *lines: [(r.actor, r.victim, r.enemy) for r in moments.meld_deaths(key(spark, *lines)).collect()]
    assert seen(hit(1000, MOB, A, 5), go(3000), hit(4000, MOB, B, 5), died(6000, B)) == [(A, B, MOB)]
    assert seen(hit(1000, MOB, A, 5), go(3000), hit(4000, MOB, B, 5), hit(5000, MOB, A, 5), died(6000, B)) == []
    assert seen(hit(1000, MOB, A, 5), hit(1500, MOB, B, 5), go(3000), hit(4000, MOB, B, 5), died(6000, B)) == []
    assert seen(hit(1000, MOB, A, 5), go(7000), hit(8000, MOB, B, 5), died(9000, B)) == [] and seen(hit(1000, MOB, A, 5), go(3000), hit(4000, MOB, B, 5), died(14_000, B)) == []


def test_padding_and_self_damage(spark):
    burn = hit(3000, A, A, 100, spell=(44, '"Burn"'))
    ctx = key(spark, hit(1000, A, MOB, 50), hit(2000, A, MOB2, 70), burn)
    of = reports.segments(ctx)[1]
    worth = spark.createDataFrame([(2, 501, 0), (2, 502, 4)], "mode_id long, npc_id long, value int")
    assert [(r.actor, r.padding) for r in moments.padding(ctx, of, worth).collect()] == [(A, 50)]
    assert [(r.actor, r.amount, r.bars) for r in moments.self_damage(ctx, 44).collect()] == [(A, 100, pytest.approx(0.1))]


def test_moments_of_victims(spark):
    dim = spark.createDataFrame([(1, "cheat"), (2, "defensive"), (3, "immunity")], "spell_id long, moment string")
    lock = f"{stamp(5000)}  SPELL_INTERRUPT,{base(MOB, A)},9,\"Bash\",0x1,71,\"Bolt\",0x4"
    back = f"{stamp(6000)}  SPELL_MISSED,{base(MOB, A)},55,\"Ray\",0x4,REFLECT,nil"
    ctx = key(spark, state(1000, B, A, 1, "APPLIED"), state(2000, A, A, 2, "APPLIED"), state(2100, B, A, 2, "APPLIED"), state(3000, A, A, 3, "REMOVED"), state(3100, B, A, 3, "REMOVED"), lock, back)
    got = sorted((r.ts, r.moment, r.spell_id) for r in moments.listed_by_victim(ctx, dim).collect())
    assert got == [(1000, "cheat", 1), (2000, "defensive", 2), (3000, "immunity", 3), (5000, "lockout", 71), (6000, "reflect", 55)]


def test_who_pulled(spark):
    place = lambda ms, g, x: hit(ms, g, BOSS, 5).replace(",1.50,2.50,7,", f",{x:.2f},0.00,7,")
    lines = [
        control(0, 'ZONE_CHANGE,9,"Keep",16'), heal(18_000, A, A, 5).replace(",1.50,2.50,7,", ",30.00,0.00,7,"), heal(18_500, B, B, 5).replace(",1.50,2.50,7,", ",10.00,0.00,7,"), cast(18_900, A, B, 34), cast(19_000, A, BOSS, 11, "START"), cast(19_800, A, BOSS, 11),
        control(20_000, 'ENCOUNTER_START,8,"Wyrm",16,20,9'), who(20_000, A, 64), who(20_000, B, 250), place(20_100, A, 1), place(20_300, B, 2), hit(21_000, BOSS, A, 5, who=BOSS), control(50_000, 'ENCOUNTER_END,8,"Wyrm",16,20,0,30000'),
    ]
    t = log.rows_from_lines(spark, lines)
    ctx = reports.open_log(spark, t)
    assert ctx.runs.first().kind == "raid"
    early = run_plan.before_pulls(log.decode(log.tokens(log.numbered(t))), ctx.runs, ctx.controls).withColumns({"src_root": F.col("src"), "dst_root": F.col("dst")})
    assert early.count() == 5
    got = moments.who_pulled(ctx, early)
    assert [(r.actor, r.kind, r.pulled, r.sure, r.tank) for r in got.orderBy("place").collect()] == [(A, "hit", True, False, False), (B, "hit", False, False, True)]
    both = early.select("run_id", "code", "src", "spell_id", "ts", "row").unionByName(ctx.events.select("run_id", "code", "src", "spell_id", "ts", "row"))
    assert [r.pressed for r in moments.cast_times(got, both).orderBy("place").collect()] == [-1000, None]
    assert [(r.actor, r.onto, r.spell_id) for r in moments.redirects(got, early, ids(spark, 34)).collect()] == [(A, B, 34)]
    foes = ctx.runs.select("run_id", F.lit(BOSS).alias("enemy"))
    assert [(r.actor, r.distance, r.place) for r in moments.standing_nearest(ctx, early, foes).orderBy("place").collect()] == [(B, pytest.approx(8.86, abs=0.01), 1), (A, pytest.approx(28.6, abs=0.1), 2)]
    raid_less = reports.open_log(spark, t, raids=False)
    assert raid_less.runs.count() == 0
    # outside a raid zone nothing is kept from before a pull
    town = reports.open_log(spark, log.rows_from_lines(spark, [lines[0].replace(",16", ",0"), *lines[1:]]))
    assert run_plan.before_pulls(log.decode(log.tokens(log.rows_from_lines(spark, lines))), town.runs, town.controls).count() == 0


def test_badges(spark):
    ctx = key(spark, hit(1000, A, MOB, 900), hit(2000, B, MOB, 100), cast(3000, A, A, 3), died(5000, B), died(6000, A))
    run = ctx.runs.first().run_id
    frame = lambda rows: spark.createDataFrame([(run, *r) for r in rows], "run_id string, moment string, actor string, target string, spell_id long, ts long, row long")
    told = frame([("immunity", B, B, 1, 2000, 900), ("offensive", A, A, 2, 1000, 901), ("external", A, B, badges.PROTECTION, 4000, 902), ("lift", A, B, 4, 4900, 903), ("taunt", A, MOB, 5, 1, 904)])
    from millrace.plans import deaths

    seen = {"deaths": deaths.deaths(ctx), "damage": reports.breakdown(ctx), "moments": told}
    out = badges.measured(ctx, seen)
    got = {k: {r.actor: r.value for r in v.collect()} for k, v in out.items()}
    assert got["inevitable"] == {B: 1} and got["block"] == {} and got["corpse"] == {A: 1} and got["last-ride"] == {B: 1} and got["princess"] == {B: 1} and got["unemployment"] == {A: 1}
    assert got["pumper"] == {A: 900, B: 100} and got["floor"] == {A: 1, B: 1}
    values = badges.values({k: out[k] for k in ("pumper", "floor", "unkillable", "wannabe")}, ctx.party)
    held = {(r.key, r.actor): r.runaway for r in moments.badges(values, badges.metrics(spark)).collect()}
    assert held == {("pumper", A): True}
    assert len({m[0] for m in badges.METRICS}) == 61 and moments.drawn(moments.badges(values, badges.metrics(spark))).first().actors == [A] and NONE
