"""Presses among many casts, and folds of many small keys."""

import random

import pytest

from millrace.operators import pairing

AIM, LONGEST = 3, 20


def outcome(casts, t):
    held = [(s, e, x) for s, e, x in casts if s <= t <= e]
    done = [(e, s, x) for s, e, x in casts if t - AIM <= e < t]
    if held or done:
        first = max(held) if held else max(done)
        return "doubled" if first[2] == "interrupted" else "ignored" if held else "late"
    return "early" if any(t < s <= t + AIM for s, _, _ in casts) else "nothing"


@pytest.mark.parametrize("nested", [False, True])
def test_outcomes_pair_only_presses_in_older_casts(spark, monkeypatch, nested):
    rng, met = random.Random(7), []
    near = pairing.near
    monkeypatch.setattr(pairing, "near", lambda a, *rest: met.append(a.count()) or near(a, *rest))
    casts = [(k, s, s + (rng.choice([0, 2, 9, 20]) if nested else 6), rng.choice(["interrupted", "success"])) for k in ("x", "y", None) for s in rng.sample(range(300), 40)]
    presses = [(n, rng.choice(["x", "y", "z", None]), rng.randrange(-5, 340)) for n in range(300)]
    c = spark.createDataFrame(casts, "k string, start long, end long, ended string")
    p = spark.createDataFrame(presses, "row long, k string, ts long").repartition(3)
    got = {r.row: r.outcome for r in pairing.outcomes(p, c, ["k"], "ts", "row", AIM, LONGEST).collect()}
    assert got == {n: outcome([x[1:] for x in casts if x[0] == k and k], t) for n, k, t in presses}
    assert len(set(got.values())) == 5 and (met[0] > 0) == nested and met[0] < 100


def test_kept_rows_are_read_as_a_stream(spark):
    rng, rows, last, want = random.Random(5), [], {}, []
    for i in range(400):
        k, t = rng.choice(["hot", "hot", "b", None]), i // 2
        rows.append((i, t, k))
        if k not in last or t - last[k] >= 6:
            last[k] = t
            want.append(i)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        kept = pairing.kept_apart(spark.createDataFrame(rows, "row long, ts long, k string").repartition(3), ["k"], "ts", "row", 6)
        assert sorted(r.row for r in kept.collect()) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert "FlatMapGroups" not in kept._jdf.queryExecution().toString()
