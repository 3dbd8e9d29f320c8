from millrace.plans import casting, reports
from millrace.sources import log
from tests.test_log import A, BOSS, base, cast, control, stamp, who


def test_casting(spark):
    none = "0000000000000000"
    lines = [
        control(0, 'CHALLENGE_MODE_START,"Hall",1,2,3,[9]'), who(1, A, 64), cast(1_000, A, BOSS, 1, "START"), cast(3_000, A, BOSS, 1), cast(4_000, A, BOSS, 2), cast(4_100, A, BOSS, 2), cast(6_000, A, BOSS, 1, "START"), cast(7_000, A, BOSS, 2),
        cast(9_000, A, BOSS, 1, "START"), f"{stamp(9_950)}  SPELL_INTERRUPT,{base(BOSS, A)},9,\"Bash\",0x1,1,\"Bolt\",0x4", cast(10_000, A, BOSS, 1, "FAILED"), cast(12_000, A, BOSS, 3), cast(12_500, A, BOSS, 4), cast(20_000, A, BOSS, 1, "START"),
        f"{stamp(20_500)}  UNIT_DIED,{base(none, A)},0", control(60_000, "CHALLENGE_MODE_END,1,1,3,60000"),
    ]
    ctx = reports.open_log(spark, log.rows_from_lines(spark, lines))
    dim = spark.createDataFrame([(1, 1500, None, True), (2, 1500, None, True), (3, 1500, 2000, True), (4, 0, None, True)], "spell_id long, gcd_ms long, channel_ms long, button boolean")
    out = casting.casting(ctx, dim)
    bars = sorted((r.start, r.end, r.spell_id, r.kind, r.finished, r.kicked, r.died) for r in out.filter("kind <> 'press'").collect())
    assert bars == [
        (1_000, 3_000, 1, "bar", True, False, False), (6_000, 7_000, 1, "bar", False, False, False), (9_000, 10_000, 1, "bar", False, True, False), (12_000, 14_000, 3, "channel", True, False, False), (20_000, 20_500, 1, "bar", False, False, True),
    ]
    assert sorted(r.start for r in out.filter("kind = 'press'").collect()) == [3_000, 4_000, 7_000, 12_000, 12_500]
    r = casting.casting_report(out).first()
    assert (r.presses, r.bars, r.cancelled) == (5, 5, 1)


GCD, OFF, LONG, CHANNEL, EMPOWER = 1, 2, 3, 4, 5


def bars_of(spark, *rows):
    """(bars, presses, cancelled) of one player in a minute's run with these lines."""
    lines = [control(0, 'CHALLENGE_MODE_START,"Hall",1,2,3,[9]'), who(1, A, 64), *rows, control(60_000, "CHALLENGE_MODE_END,1,1,3,60000")]
    dim = spark.createDataFrame([(GCD, 1500, None, True), (OFF, 0, None, True), (LONG, 1500, None, True), (CHANNEL, 1500, 4500, True), (EMPOWER, 1500, None, True), (6, 0, None, False)], "spell_id long, gcd_ms long, channel_ms long, button boolean")
    out = casting.casting(reports.open_log(spark, log.rows_from_lines(spark, lines)), dim)
    bars = sorted((r.start, r.end, r.kind, r.finished, r.kicked, r.died) for r in out.filter("kind <> 'press'").collect())
    r = casting.casting_report(out).first()
    return bars, r.presses if r else 0, r.cancelled if r else 0


def empower(ms, what):
    return cast(ms, A, BOSS, EMPOWER).replace("SPELL_CAST_SUCCESS", f"SPELL_EMPOWER_{what}")


def test_presses_and_procs(spark):
    assert bars_of(spark, *(cast(1000 * k, A, BOSS, GCD) for k in range(1, 6))) == ([], 5, 0)
    # 675 ms are the least between presses of 1500; an unlisted effect is no press
    assert bars_of(spark, cast(5000, A, BOSS, GCD), cast(5674, A, BOSS, LONG), cast(5675, A, BOSS, LONG), cast(9000, A, BOSS, OFF), cast(9001, A, BOSS, OFF), cast(9500, A, BOSS, 6)) == ([], 4, 0)


def test_hard_and_instant_casts(spark):
    bars, presses, cancelled = bars_of(spark, cast(5000, A, BOSS, LONG, "START"), cast(7200, A, BOSS, LONG), cast(9000, A, BOSS, LONG, "START"), cast(9000, A, BOSS, LONG))
    assert bars == [(5000, 7200, "bar", True, False, False), (9000, 9000, "bar", True, False, False)] and (presses, cancelled) == (2, 0)


def test_given_up_kicked_and_refused(spark):
    kick = f"{stamp(21_250)}  SPELL_INTERRUPT,{base(BOSS, A)},9,\"Bash\",0x1,3,\"Bolt\",0x4"
    bars, presses, cancelled = bars_of(
        spark, cast(4000, A, BOSS, LONG, "FAILED"), cast(10_000, A, BOSS, LONG, "START"), cast(10_500, A, BOSS, OFF, "FAILED"), cast(10_800, A, BOSS, LONG, "FAILED"), cast(20_000, A, BOSS, LONG, "START"), kick, cast(21_200, A, BOSS, LONG, "FAILED")
    )
    assert bars == [(10_000, 10_800, "bar", False, False, False), (20_000, 21_200, "bar", False, True, False)] and (presses, cancelled) == (0, 1)


def test_channels(spark):
    gone = f"{stamp(12_500)}  SPELL_AURA_REMOVED,{base(A, BOSS)},{CHANNEL},\"Ray\",0x1,DEBUFF"
    assert bars_of(spark, cast(10_000, A, BOSS, CHANNEL), gone)[0] == [(10_000, 12_500, "channel", True, False, False)]
    assert bars_of(spark, cast(10_000, A, BOSS, CHANNEL), cast(30_000, A, BOSS, GCD))[0] == [(10_000, 14_500, "channel", True, False, False)]
    assert bars_of(spark, cast(10_000, A, BOSS, CHANNEL), cast(10_400, A, BOSS, GCD), cast(12_000, A, BOSS, GCD))[0] == [(10_000, 12_000, "channel", True, False, False)]
    died = f"{stamp(11_000)}  UNIT_DIED,{base('0000000000000000', A)},0"
    assert bars_of(spark, cast(10_000, A, BOSS, CHANNEL), died)[0] == [(10_000, 11_000, "channel", True, False, True)]


def test_empowered_casts(spark):
    bars, presses, cancelled = bars_of(spark, empower(10_000, "START"), cast(10_000, A, BOSS, EMPOWER), empower(12_000, "END"), empower(20_000, "START"), cast(20_000, A, BOSS, EMPOWER), empower(21_000, "INTERRUPT"))
    assert bars == [(10_000, 12_000, "bar", True, False, False), (20_000, 21_000, "bar", False, False, False)] and (presses, cancelled) == (1, 1)


def test_deaths_cut_bars(spark):
    died = lambda ms: f"{stamp(ms)}  UNIT_DIED,{base('0000000000000000', A)},0"
    assert bars_of(spark, cast(10_000, A, BOSS, LONG, "START"), died(11_000)) == ([(10_000, 11_000, "bar", False, False, True)], 0, 0)
    assert bars_of(spark, cast(10_000, A, BOSS, LONG, "START"), died(40_000)) == ([(10_000, 13_000, "bar", False, False, False)], 0, 1)


def test_open_bars_last_as_long_as_a_finish(spark):
    """A later instant landing of the spell is no finish of the old start."""
    bars, presses, cancelled = bars_of(spark, cast(1000, A, BOSS, LONG, "START"), cast(3000, A, BOSS, LONG), cast(30_000, A, BOSS, LONG), cast(50_000, A, BOSS, LONG, "START"))
    assert bars == [(1000, 3000, "bar", True, False, False), (50_000, 52_000, "bar", False, False, False)] and (presses, cancelled) == (2, 1)
