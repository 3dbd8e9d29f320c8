"""Pieces and halos: order-dependent work in many tasks equals the work on whole keys."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from millrace import session
from millrace.operators import asof, attribution, pairing, pieces
from millrace.plans import maps


def stream(seed, n=120):
    rng, t, out = random.Random(seed), 0, []
    for row in range(n):
        t += rng.choice([0, 1, 1, 3, 40])
        out.append((row * 3, t - rng.choice([0, 0, 0, 5]), rng.choice(["hot", "hot", "hot", "b", None]), rng.randrange(3)))
    return out


@pytest.mark.parametrize("size", [20, 1 << 16])
def test_pieces_begin_where_nothing_before_reaches(spark, monkeypatch, size):
    monkeypatch.setattr(pieces, "BLOCK_ROWS", size)
    rows = stream(size)
    df = spark.createDataFrame(rows, "row long, ts long, k string, v int").repartition(5)
    got = {r.row: r[pieces.PIECE] for r in pieces.with_pieces(df, ["k"], "ts", "row", 30).collect()}
    most, piece, want = {}, {}, {}
    for row, ts, k, _ in rows:
        if k not in most or ts - most[k] >= 30:
            piece[k] = row // size
        most[k] = max(most.get(k, ts), ts)
        want[row] = piece[k]
    assert got == want and (size > 1000 or len(set(want.values())) > 5)


@pytest.mark.parametrize("size", [20, 1 << 16])
@pytest.mark.parametrize("change", [None, "v"])
def test_kept_rows_equal_the_plain_fold(spark, monkeypatch, size, change):
    monkeypatch.setattr(pieces, "BLOCK_ROWS", size)
    rows, last, want = stream(3), {}, []
    for row, ts, k, v in rows:
        if k not in last or ts - last[k][0] >= 20 or (change and v != last[k][1]):
            last[k] = (ts, v)
            want.append(row)
    df = spark.createDataFrame(rows, "row long, ts long, k string, v int").repartition(5)
    assert sorted(r.row for r in pairing.kept_apart(df, ["k"], "ts", "row", 20, change).collect()) == want


@pytest.mark.parametrize("size", [20, 1 << 16])
def test_halo_gives_frames_as_in_whole_keys(spark, size):
    df = spark.createDataFrame(stream(8), "row long, ts long, k string, v int").repartition(5)
    frame = lambda w: F.concat_ws(",", F.collect_list("row").over(w.orderBy("row").rowsBetween(-4, 2)))
    want = {r.row: r.f for r in df.withColumn("f", frame(W.partitionBy("k"))).collect()}
    cut = pieces.with_halo(df, ["k"], "row", 4, 2, size).withColumn("f", frame(W.partitionBy("k", pieces.BLOCK))).filter(~F.col(pieces.HALO))
    assert {r.row: r.f for r in cut.collect()} == want


@pytest.mark.parametrize("held", [1, 2, 3])
def test_charges_equal_the_plain_clock(spark, held):
    rng, t, uses = random.Random(held), 0, []
    for i in range(80):
        t += rng.choice([0, 1, 5, 30, 100])
        uses.append((rng.choice("ab"), i, t, 20, held))
    want, back = {}, {}
    for k, i, t, wait, _ in uses:
        own = [b for b in back.get(k, []) if b > t]
        own.append(max([t, *own[-1:]]) + wait)
        back[k] = own
        want[i] = t if len(own) < held else own[len(own) - held]
    df = spark.createDataFrame(uses, "k string, row long, ts long, wait long, held int")
    for recovery, charges in ((20, held), ("wait", "held")):
        assert {r.row: r.ready_at for r in pairing.charge_clock(df, ["k"], "ts", "row", recovery, charges).collect()} == want


def windows(df, function):
    """The plan's windows of a function, as text."""
    return [x for x in df._jdf.queryExecution().executedPlan().toString().splitlines() if f"Window [{function}(" in x]


@pytest.mark.parametrize("size", [16, 1 << 16])
def test_pulls_of_a_run_are_chained_by_blocks(spark, monkeypatch, size):
    monkeypatch.setattr(pieces, "BLOCK_ROWS", size)
    rng, t, rows, pull, last = random.Random(5), 0, [], {}, {}
    for row in range(0, 400, 2):
        t += rng.choice([0, 1, 5, 30])
        run, enemy = rng.choice(["a", "a", "a", "b"]), rng.randrange(60)
        rows.append((row, t, run, enemy))
        if (run, enemy) not in pull:
            pull[run, enemy] = pull[run, last[run][1]] if run in last and t - last[run][0] <= 6 else enemy
        last[run] = (t, enemy)
    links = []
    monkeypatch.setattr(attribution, "stored", lambda df, *at: links.append(df) or session.stored(df, *at))
    got = attribution.counterpart_segments(spark.createDataFrame(rows, "row long, ts long, run string, enemy int").repartition(5), "run", "enemy", "ts", "row", 6)
    assert {(r.run, r.enemy): r.segment for r in got.collect()} == pull
    assert windows(links[0], "lag") and all(pieces.BLOCK in x for x in windows(links[0], "lag"))


@pytest.mark.parametrize("tie", ["inclusive", "exclusive"])
def test_blocks_carry_what_was_known_before(spark, tie):
    rng = random.Random(9)
    key = lambda: rng.choice(["hot", "hot", None, "b"])
    samples = spark.createDataFrame([(key(), rng.randrange(-50, 300), rng.choice([None, 1, 2, 3])) for _ in range(80)], "k string, ts long, v int")
    probes = spark.createDataFrame([(i, key(), rng.randrange(-80, 400)) for i in range(300)], "i int, k string, ts long")
    cut = asof.asof_last(probes, samples, ["k"], "ts", ["v"], tie=tie, block=20)
    whole = asof.asof_last(probes, samples, ["k"], "ts", ["v"], tie=tie)
    assert cut.dtypes == whole.dtypes and sorted(map(str, cut.collect())) == sorted(map(str, whole.collect()))


def test_replay_sorts_blocks_of_a_unit(spark):
    rows = spark.createDataFrame([(1, "a", i * 1000, float(i), 0.0, 1, 100 - i % 3 * 50) for i in range(0, 9000, 7)], "run_id int, actor string, ts long, x double, y double, map int, hp_pct int")
    probes = spark.createDataFrame([(1, "a", t) for t in (0, 3_599_999, 3_600_001, 8_999_000)] + [(1, "b", 5)], "run_id int, actor string, ts long")
    got = maps.replay(probes, rows, spark.createDataFrame([(1, "a", [3_590_000])], "run_id int, actor string, died array<long>"))
    at = {(r.actor, r.ts): (r.x, r.dead) for r in got.collect()}
    assert at == {("a", 0): (0.0, False), ("a", 3_599_999): (3598.0, False), ("a", 3_600_001): (3598.0, False), ("a", 8_999_000): (8995.0, False), ("b", 5): (None, False)}
    assert windows(got, "last") and all(pieces.BLOCK in x for x in windows(got, "last"))
