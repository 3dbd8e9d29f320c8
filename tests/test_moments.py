from pyspark.sql import functions as F

from millrace.plans import moments, reports, runs
from millrace.sources import log
from tests.test_log import A, B, BOSS, LINES, aura, cast, control, hit, who


def test_moments(spark):
    ctx = reports.open_log(spark, log.rows_from_lines(spark, LINES))
    assert [(r.actor, r.amount, r.fatal) for r in moments.falls(ctx).collect()] == [(A, 120, False)]
    best = {r.src_root: (r.best, r.pick.dst) for r in moments.biggest_hits(ctx).collect()}
    assert best[A] == (2000, BOSS) and best[B][0] == 300
    healed = moments.healing_on_others(ctx).first()
    assert (healed.actor, healed.healing, healed.overhealing) == (B, 400, 150)
    dim = spark.createDataFrame([(61, "kick")], "spell_id long, moment string")
    assert moments.listed_moments(ctx, dim).count() == 2 and moments.landed(moments.listed_moments(ctx, dim), ctx, 1000).count() == 0
    assert moments.totem_kills(ctx).count() == 0 and moments.procs(ctx, 81).count() == 0


def test_who_pulled(spark):
    lines = [control(0, 'ENCOUNTER_START,8,"Wyrm",16,20,9'), who(1, A, 64), who(1, B, 257), hit(250, B, BOSS, 10, who=B), hit(900, A, BOSS, 10), hit(1000, BOSS, A, 5), control(5000, 'ENCOUNTER_END,8,"Wyrm",16,20,1,5000')]
    ctx = reports.open_log(spark, log.rows_from_lines(spark, lines))
    none = ctx.events.limit(0)
    got = moments.who_pulled(ctx, none).orderBy("place").collect()
    assert [(r.actor, r.kind, r.pulled, r.sure) for r in got] == [(B, "hit", True, True), (A, "hit", False, False)]


def test_marks_buffs_and_support_rows_are_no_contact(spark):
    """The hunter's mark, a buff and a support row come first; the hit after them is the first contact."""
    plain = hit(900, A, BOSS, 10)
    support = plain.replace("SPELL_DAMAGE", "SPELL_DAMAGE_SUPPORT").replace("20:00:00.900", "20:00:00.300") + f",{B}"
    lines = [control(0, 'ENCOUNTER_START,8,"Wyrm",16,20,9'), who(1, A, 64), who(1, B, 257), aura(100, B, BOSS, 257284), aura(150, B, BOSS, 7, kind="BUFF"), support, plain, aura(1_200, BOSS, B, 8), control(5000, 'ENCOUNTER_END,8,"Wyrm",16,20,1,5000')]
    ctx = reports.open_log(spark, log.rows_from_lines(spark, lines))
    got = moments.who_pulled(ctx, ctx.events.limit(0)).orderBy("place").collect()
    assert [(r.actor, r.kind, r.ts) for r in got] == [(A, "hit", 900), (B, "body", 1_200)]


def test_self_casts_and_before_pulls(spark):
    lines = [control(0, 'ZONE_CHANGE,9,"Den",16'), hit(1_000, A, BOSS, 1), cast(35_000, A, A, 10), control(40_000, 'ENCOUNTER_START,8,"Wyrm",16,20,9'), who(40_001, A, 64), aura(41_000, A, BOSS, 5), cast(42_000, A, A, 10), cast(42_100, A, B, 10), cast(44_000, A, A, 10), control(50_000, 'ENCOUNTER_END,8,"Wyrm",16,20,0,10000')]
    rows = log.rows_from_lines(spark, lines)
    ctx = reports.open_log(spark, rows)
    casts = moments.listed_moments(ctx, spark.createDataFrame([(10, "gift")], "spell_id long, moment string"))
    assert [r.ts for r in moments.self_only(casts).collect()] == [4_000]
    early = runs.before_pulls(log.decode(log.tokens(rows)), ctx.runs)
    assert [(r.ts, r.code) for r in early.collect()] == [(-5_000, "SPELL_CAST_SUCCESS")]


def test_badges(spark):
    values = [("r", "kicks", p, v) for p, v in zip("abcd", (5.0, 3.0, 0.0, 1.0))] + [("r", "deaths", p, v) for p, v in zip("abcd", (0.0, 0.0, 0.0, 2.0))] + [("r", "falls", p, 0.0) for p in "abcd"]
    metrics = spark.createDataFrame([("kicks", "glory", "most", None), ("deaths", "roast", "most", 2.0), ("falls", "roast", "most", None)], "key string, kind string, best string, least double")
    held = moments.badges(spark.createDataFrame(values, "run_id string, key string, actor string, value double"), metrics)
    assert {(r.key, r.actor) for r in held.collect()} == {("kicks", "a"), ("deaths", "d")}
    assert moments.drawn(held, 1).count() == 1 and moments.drawn(held).agg(F.max("place")).first()[0] == 2
