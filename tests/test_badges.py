"""Badges that join several reports, each on a small log of its own."""

from millrace.plans import badges, deaths, moments, reports
from tests.test_log import A, B, BOSS, MOB, MOB2, control, died, heal, hit, key, who

C = "Player-1-0C"


def named():
    from tests.test_log import FLAGS, NAMES

    NAMES[C] = '"Cy"'
    FLAGS[C] = "0x512"


def told(ctx):
    dead = deaths.deaths(ctx)
    return dead, deaths.recap(ctx, dead)


def test_neglected(spark):
    named()
    slam = lambda ms, dst=A: hit(ms, MOB, dst, 50, spell=(91, '"Slam"'), who=dst)

    def found(*lines, healer=True):
        ctx = key(spark, *([who(1, C, 257)] if healer else []), *lines)
        rows = badges.neglected(ctx, *told(ctx))
        return [r.dst for r in rows.collect()], {r.actor: r.value for r in badges.measured(ctx, {"neglected": rows})["neglected"].collect()}

    assert found(slam(1000), slam(4000), died(7000, A)) == ([A], {A: 1})
    assert found(slam(1000), slam(4000), died(7000, A), healer=False) == ([], {})
    assert found(slam(1000), heal(3000, C, A, 5), slam(4000), died(7000, A)) == ([], {})
    assert found(slam(1000), heal(2000, A, A, 5), slam(4000), died(7000, A)) == ([A], {A: 1})  # no healer's heal
    assert found(slam(1000), heal(3000, C, A, 5), slam(12_000), died(13_500, A)) == ([], {})  # what was hit before the last ten seconds does not count
    assert found(slam(1000), slam(4000), died(5900, A)) == ([], {})
    assert found(slam(1000, C), died(7000, C)) == ([], {})


def test_stam_check(spark):
    blow = lambda ms, amount, spell=91, name="SPELL_DAMAGE": hit(ms, MOB, A, amount, spell=(spell, '"Slam"'), who=A, over=5, name=name)
    none = spark.createDataFrame([], "run_id string, actor string, ts long, spell_id long")
    found = lambda *lines, covered=True, hits=None: _shots(spark, lines, covered, none if hits is None else hits)
    assert found(blow(2000, 905), died(2100, A)) == [(A, 91)]  # 905 less 5 over of 1000
    assert found(blow(2000, 904), died(2100, A)) == []
    assert found(blow(2000, 950), died(2100, A), covered=False) == []
    assert found(blow(2000, 950, name="SWING_DAMAGE"), died(2100, A)) == []
    listed = lambda run: spark.createDataFrame([(run, A, 2000, 91)], none.schema)
    assert found(blow(2000, 950), died(2100, A), hits=listed) == []


def _shots(spark, lines, covered, hits):
    ctx = key(spark, *lines)
    dead, r = told(ctx)
    run = ctx.runs.first().run_id
    known = ctx.runs.select("run_id") if covered else ctx.runs.select("run_id").limit(0)
    rows = badges.undodgeable(dead, r, hits(run) if callable(hits) else hits, known)
    return [(x.dst, x.spell_id) for x in rows.collect()]


def test_route_and_hero(spark):
    start, end = (lambda ms: control(ms, 'ENCOUNTER_START,77,"Lord",8,5,2000')), (lambda ms, ok=1: control(ms, f'ENCOUNTER_END,77,"Lord",8,5,{ok},1000'))
    kill = lambda ms, mob: [hit(ms, A, mob, 50), died(ms + 500, mob)]
    worth = spark.createDataFrame([(2, 501, 6, 10), (2, 502, 4, 10)], "mode_id long, npc_id int, value long, total long")

    def of(*lines):
        ctx = key(spark, *lines)
        spans, enemies = reports.segments(ctx)
        spans = badges.with_outcome(ctx, spans)
        seen = {"short_routes": badges.short_routes(ctx, spans, enemies, worth), "stands": moments.last_stands(ctx, spans)}
        return ctx, spans, seen, {k: {r.actor: r.value for r in v.collect()} for k, v in badges.measured(ctx, seen).items()}

    fight = [start(20_000), hit(21_000, A, BOSS, 50), died(22_000, A), died(29_000, BOSS), end(30_000)]
    ctx, spans, seen, got = of(*kill(1000, MOB), *fight, *kill(50_000, MOB2))
    assert {r.segment: r.success for r in spans.collect() if r.boss} == {"boss:0": True}
    assert [(r["count"], r.total) for r in seen["short_routes"].collect()] == [(6, 10)]
    assert got["route"] == {B: 1} and got["hero"] == {B: 1}
    _, _, seen, _ = of(*kill(1000, MOB), *fight[:2], *kill(25_000, MOB2), *fight[3:])  # dragged in during the fight
    assert seen["short_routes"].count() == 0
    _, _, seen, _ = of(*kill(1000, MOB), *fight)  # never had the count
    assert seen["short_routes"].count() == 0
    _, _, _, got = of(*kill(1000, MOB), *fight[:4], end(30_000, 0), *kill(50_000, MOB2))  # the boss did not fall
    assert got == {"route": {}, "hero": {}}


def test_route_text():
    from millrace.functions import codec

    pulls = [{"enemies": [{"enemy": 3, "clones": [1, 2]}], "color": "red"}]
    text = codec.route_text("run-1", "Hall +12", 12, 9, 2, pulls)
    assert text.startswith("!~MDT2~") and text == codec.route_text("run-1", "Hall +12", 12, 9, 2, pulls) != codec.route_text("run-2", "Hall +12", 12, 9, 2, pulls)
    one = codec.uid("run-1")
    assert len(one) == 11 and set(one) <= set(codec.ALPHABET) and len({codec.uid(f"r{i}") for i in range(5000)}) == 5000
