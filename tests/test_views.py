"""Points, lines of text and merged abilities."""

from pyspark.sql import functions as F

from millrace.plans import reports, views
from tests.test_log import A, B, BOSS, MOB, hit, key


def test_damage_points(spark):
    def points(rows):
        df = spark.createDataFrame([("r", *x) for x in rows], "run_id string, guid string, role string, value double")
        return {r.guid: r.points for r in views.damage_points(df).collect()}

    assert points([("a", "dps", 100.0), ("b", "dps", 60.0), ("c", "dps", 20.0), ("h", "healer", 5.0)]) == {"a": 10, "b": 7, "c": 3, "h": 0}
    assert points([("a", "dps", 100.0), ("b", "dps", 60.0), ("c", "dps", 20.0), ("t", "tank", 70.0)]) == {"a": 10, "b": 0, "c": 0, "t": 7}
    assert points([("a", "dps", 100.0), ("t", "tank", 50.0)]) == {"a": 10, "t": 5} and points([("a", "dps", 0.0), ("b", "dps", 0.0)]) == {"a": 0, "b": 0}


def test_lines_of_text(spark):
    long = "word " * 60
    df = spark.createDataFrame([(1, "Ann 5", ["a" * 100, "b" * 100, "c" * 100, "d"]), (2, long, None), (3, "x" * 300, []), (4, "Bob", [])], "n int, body string, d array<string>")
    got = {r.n: r.line for r in df.select("n", views.ranked_line(F.col("n"), F.col("body"), F.col("d")).alias("line")).collect()}
    assert got[1] == f"1. Ann 5: {'a' * 100}, {'b' * 100}" and got[4] == "4. Bob"
    assert len(got[2]) <= 255 and got[2].endswith("word…") and got[3] == "3. " .rstrip() + "…"
    totals = spark.createDataFrame([("r", "a", "Ann-Home", 900.0), ("r", "b", "Bob-Home", 100.0), ("r", "c", "Cy-Home", 0.0)], "run_id string, guid string, name string, value double")
    assert [r.line for r in views.share_lines(totals, "value").orderBy("place").collect()] == ["1. Ann 900 (90%)", "2. Bob 100 (10%)"]


def test_party_order_and_abilities(spark):
    ctx = key(spark, hit(1000, A, MOB, 30), hit(2000, A, MOB, 70, spell=(12, '"Fire"')), hit(30_000, B, BOSS, 5))
    assert [(r.guid, r.role) for r in views.party_order(ctx.party).orderBy("shown_at").collect()] == [(B, "tank"), (A, "dps")]
    run = ctx.runs.first().run_id
    up = spark.createDataFrame([(run, A, 11, 500), (run, A, 12, 900)], "run_id string, actor string, spell_id long, up long")
    got = {(r.actor, r.ability): (r.total, r.parts, r.up, r.representative) for r in views.by_ability(reports.breakdown(ctx), up).collect()}
    assert got[(A, "Fire")] == (100, 2, 900, 12)
    rated = {r.spell_id: (r.per_hit, r.crit_share) for r in reports.rates(reports.breakdown(ctx)).filter(F.col("actor") == A).collect()}
    assert rated == {11: (30, 0), 12: (70, 0)}
    assert views.overlapping(reports.segments(ctx)[0]).count() == 0
