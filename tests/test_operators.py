"""The event operators against plain Python folds, and every query against its oracle."""

import os
import random
from collections import defaultdict

import duckdb
import pytest

from millrace.operators import asof, attribution, intervals, pairing, sessions
from millrace.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


def shape(rows):
    text = lambda v: "null" if v is None or v != v else f"{float(v):.6f}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted(tuple(map(text, r)) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_oracle(spark, oracle, name):
    got = registry.queries()[name](spark, SF)
    want = oracle.sql(registry.oracle_sql()[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    assert shape(got.select(*cols).collect()) == shape(want.select(", ".join(f'"{c}"' for c in cols)).fetchall())


def stream(seed, n=120, step=30):
    rng, t, out = random.Random(seed), 0, []
    for row in range(n):
        t += rng.choice([0, 0, 1, 5, step])
        out.append((row, t, rng.randrange(3), rng.randrange(6), rng.random() < 0.5))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_pull_forest_equals_fold(spark, seed):
    rows, gap = stream(seed), 6
    pull, last, want = {}, {}, {}
    for _, t, run, enemy, _ in rows:
        if (run, enemy) not in pull:
            prev = last.get(run)
            pull[run, enemy] = pull[run, prev[1]] if prev and t - prev[0] <= gap else enemy
        last[run] = (t, enemy)
    got = attribution.counterpart_segments(spark.createDataFrame(rows, "row long, ts long, run int, enemy int, up boolean"), "run", "enemy", "ts", "row", gap)
    want = pull
    assert {(r.run, r.enemy): r.segment for r in got.collect()} == want


def test_pull_forest_is_never_cut(spark):
    chain = spark.createDataFrame([(i, i, 0, i) for i in range(20)], "row long, ts long, run int, enemy int")
    assert {r.segment for r in attribution.counterpart_segments(chain, "run", "enemy", "ts", "row", 5).collect()} == {0}
    with pytest.raises(RuntimeError):
        attribution.counterpart_segments(chain, "run", "enemy", "ts", "row", 5, rounds=2)


@pytest.mark.parametrize("seed", range(4))
def test_uptime_equals_fold(spark, seed):
    rows, end = stream(seed), 5000
    up, since, total = defaultdict(set), {}, defaultdict(int)
    for _, t, key, target, on in rows:
        was = bool(up[key])
        (up[key].add if on else up[key].discard)(target)
        if up[key] and not was:
            since[key] = t
        if was and not up[key]:
            total[key] += t - since[key]
    for key in up:
        if up[key]:
            total[key] += end - since[key]
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "row long, ts long, key int, target int, up boolean")
    edges = intervals.state_edges(df, ["key"], "target", "row", F.col("up"))
    got = {r.key: r.up for r in intervals.union_uptime(edges, ["key"], "ts", "row", F.lit(end)).collect()}
    assert {k: v for k, v in got.items() if v} == {k: v for k, v in total.items() if v}
    spans = intervals.union_spans(edges, ["key"], "ts", "row", F.lit(end)).collect()
    assert {k: sum(s.end - s.start for s in spans if s.key == k) for k in total} == dict(total)


@pytest.mark.parametrize("seed", range(4))
def test_claims_equal_fold(spark, seed):
    rows = stream(seed)
    taken, want = set(), set()
    for row, t, key, _, press in rows:
        if press:
            for r2, t2, k2, _, p2 in rows:
                if not p2 and k2 == key and r2 not in taken and t - 2 <= t2 <= t + 9:
                    taken.add(r2)
                    want.add((row, r2))
    df = spark.createDataFrame(rows, "row long, ts long, key int, target int, press boolean")
    got = pairing.claims(df.filter("press"), df.filter("NOT press"), ["key"], "ts", "row", 2, 9)
    assert {(r.press, r.stop) for r in got.collect()} == want


@pytest.mark.parametrize("seed", range(3))
def test_lookback_follows_order_not_time(spark, seed):
    rng = random.Random(seed)
    rows = [(i, rng.randrange(200), rng.randrange(2)) for i in range(80)]
    df = spark.createDataFrame(rows, "row long, ts long, key int")
    anchors = df.filter("row % 7 = 3")
    got = {(r.anchor, r.row) for r in attribution.lookback(anchors, df, ["key"], "ts", "row", 30).collect()}
    assert got == {(a, r) for a, ta, ka in rows if a % 7 == 3 for r, t, k in rows if k == ka and r <= a and t >= ta - 30}


def test_charges_and_fifo(spark):
    uses = spark.createDataFrame([("a", t, i) for i, t in enumerate((0, 5, 30, 45))], "who string, ts long, row long")
    assert [r.ready_at for r in pairing.charge_clock(uses, ["who"], "ts", "row", 20, 2).orderBy("row").collect()] == [0, 20, 40, 60]
    wait = spark.createDataFrame([("a", 0, 0), ("a", 1, 1), ("a", 500, 9)], "k string, ts long, row long")
    offer = spark.createDataFrame([("a", 50, 5), ("a", 60, 6), ("b", 1, 7)], "k string, ts long, row long")
    assert {(r.waiting, r.offer) for r in pairing.claimed_fifo(wait, offer, ["k"], "ts", "row", 100).collect()} == {(0, 5), (1, 6)}


def test_sessions_and_asof_on_no_rows(spark):
    none = spark.createDataFrame([], "row long, ts long, key int, v int")
    assert sessions.sessionize_gap(none, ["key"], "ts", "row", 5).count() == 0
    assert asof.asof_last(none.select("row", "ts", "key"), none, ["key"], "ts", ["v"]).count() == 0


def test_claims_of_one_hot_key_equal_a_plain_queue(spark):
    """One key with all rows, with ties and rows out of time's order, cut into pieces at gaps."""
    import random

    from millrace.operators import pairing

    rng, at, rows = random.Random(5), 0, []
    for i in range(3000):
        at += rng.choice([0, 1, 5, 40, 99, 100, 101, 102, 400, -3])
        rows.append(("k", at, i, rng.random() < 0.5))
    queue, want = [], set()
    for _, ts, row, waits in rows:
        queue = [q for q in queue if ts - q[0] <= 100]
        if waits:
            queue.append((ts, row))
        elif queue:
            want.add((queue.pop(0)[1], row))
    df = spark.createDataFrame(rows, "k string, ts long, row long, waits boolean")
    part = lambda w: df.filter(w).drop("waits")
    assert {(r.waiting, r.offer) for r in pairing.claimed_fifo(part("waits"), part("NOT waits"), ["k"], "ts", "row", 100).collect()} == want and len(want) > 200
    none = df.limit(0).drop("waits")
    assert pairing.claimed_fifo(none, none, ["k"], "ts", "row", 100).count() == 0
