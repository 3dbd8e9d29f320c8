"""Event-stream queries over the driver's ``events`` table, each with its oracle SQL.

The table is read as an action stream: row = event_id, actor = user_id, amount = value, and from
props.k a spell (k % 10), a target (k % 7) and a run (k % 5). Times are microseconds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window as W

from millrace.operators import asof, attribution, intervals, pairing, ranking, sessions
from millrace.session import table

HOUR = 3_600_000_000
QUERIES, SQL = {}, {}
EV = """ev AS (SELECT event_id AS row, epoch_us(ts) AS ts, user_id AS actor, event_type AS action, value AS amount, k, k % 10 AS spell, k % 7 AS target, k % 5 AS run
        FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events))"""
END = "(SELECT max(ts) FROM ev)"


def stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long").alias("k")
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("row"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"), F.col("user_id").alias("actor"), F.col("event_type").alias("action"), F.col("value").alias("amount"), k)
    return e.withColumns({"spell": F.col("k") % 10, "target": F.col("k") % 7, "run": F.col("k") % 5})


def query(sql: str | None = None):
    """Registers a function of the stream under its name, with its oracle."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(stream(spark, sf_dir))
        if sql:
            SQL[f.__name__] = "WITH RECURSIVE " + EV + sql if sql.lstrip().startswith(",") else "WITH " + EV + sql
        return f

    return add


def _end(e: DataFrame) -> int:
    """The stream's last time, one value."""
    return e.agg(F.coalesce(F.max("ts"), F.lit(0))).first()[0]


@query(f"""
SELECT actor, CAST(coalesce(sum(CASE WHEN gap <= {6 * HOUR} THEN gap ELSE 0 END), 0) AS BIGINT) AS active_us, round(sum(amount), 2) AS total
FROM (SELECT actor, amount, ts - lag(ts) OVER (PARTITION BY actor ORDER BY row) AS gap FROM ev) GROUP BY actor""")
def active_time(e):
    """Time between consecutive rows at most six hours apart, with the total."""
    total = e.groupBy("actor").agg(F.round(F.sum("amount"), 2).alias("total"))
    return sessions.active_time(e, ["actor"], "ts", "row", 6 * HOUR).withColumnRenamed("active", "active_us").join(total, "actor")


_WASTE = "CASE WHEN k % 3 = 0 THEN amount * 0.2 ELSE -1 END"
_EFF = f"CASE WHEN {_WASTE} > 0 THEN amount - {_WASTE} ELSE amount END"


def _hits(e):
    return e.filter("action IN ('click', 'purchase')").withColumn("waste", F.expr(_WASTE))


_BREAKDOWN = f"""
hits AS (SELECT *, {_EFF} AS eff, {_WASTE} AS waste FROM ev WHERE action IN ('click', 'purchase')),
agg AS (SELECT actor, spell, sum(eff) AS total, sum(amount) AS raw, sum(greatest(waste, 0)) AS wasted, count(*) AS hits, count(*) FILTER (k % 4 = 0) AS crits,
               coalesce(sum(eff) FILTER (k % 4 = 0), 0) AS crit_total, max(eff) AS biggest FROM hits GROUP BY actor, spell)"""


@query(f""",{_BREAKDOWN}
SELECT actor, spell, round(total, 2) AS total, round(raw, 2) AS raw, round(wasted, 2) AS wasted, hits, crits, round(crit_total, 2) AS crit_total, round(biggest, 2) AS biggest,
       round(total / 3571.0, 4) AS per_second, round(total / sum(greatest(total, 0)) OVER (), 8) AS share FROM agg""")
def damage_breakdown(e):
    """Totals, hits and shares per actor and spell."""
    out = attribution.breakdown(_hits(e), "actor", "spell", F.col("amount"), F.col("waste"), F.col("k") % 4 == 0, 3571.0)
    return out.select("actor", "spell", *(F.round(c, 2).alias(c) for c in ("total", "raw", "wasted", "crit_total", "biggest")), "hits", "crits", F.round("per_second", 4).alias("per_second"), F.round("share", 8).alias("share"))


@query(f""",{_BREAKDOWN},
named AS (SELECT *, 'Spell ' || (spell % 4) || CASE WHEN spell < 4 THEN '' ELSE ' (rank ' || spell || ')' END AS name FROM agg),
able AS (SELECT *, 'Spell ' || (spell % 4) AS ability FROM named)
SELECT actor, ability, round(sum(total), 2) AS total, sum(hits)::BIGINT AS hits, sum(crits)::BIGINT AS crits, round(max(biggest), 2) AS biggest, count(*) AS parts,
       arg_max(spell, (CASE WHEN name = ability THEN 1 ELSE 0 END, total, -spell)) AS representative FROM able GROUP BY actor, ability""")
def ability_breakdown(e):
    """Spells of one ability merged by name, the exact-name part as representative."""
    from millrace.functions.text import ability_name

    parts = attribution.breakdown(_hits(e), "actor", "spell", F.col("amount"), F.col("waste"), F.col("k") % 4 == 0, 3571.0)
    name = F.concat(F.lit("Spell "), (F.col("spell") % 4).cast("string"), F.when(F.col("spell") < 4, "").otherwise(F.concat(F.lit(" (rank "), F.col("spell").cast("string"), F.lit(")"))))
    parts = parts.withColumn("name", name).withColumn("ability", ability_name(F.col("name")))
    return attribution.merged_abilities(parts, "actor", "ability", "spell", "name").withColumns({"total": F.round("total", 2), "biggest": F.round("biggest", 2)})


@query(f"""
SELECT actor, CAST(session AS BIGINT) AS session, min(ts) AS start, max(ts) AS "end", count(*) AS n FROM (
  SELECT *, sum(CASE WHEN gap > {6 * HOUR} OR gap IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY actor ORDER BY row) AS session
  FROM (SELECT *, ts - lag(ts) OVER (PARTITION BY actor ORDER BY row) AS gap FROM ev)) GROUP BY actor, session""")
def gap_sessions(e):
    """Sessions split at gaps of over six hours."""
    return sessions.session_bounds(sessions.sessionize_gap(e, ["actor"], "ts", "row", 6 * HOUR), ["actor"], "ts")


@query(f"""
SELECT actor, spell, press, count(*) AS targets, count(DISTINCT target) AS distinct_targets FROM (
  SELECT *, min(row) OVER (PARTITION BY actor, spell, n) AS press FROM (
    SELECT *, sum(CASE WHEN gap > {24 * HOUR} OR gap IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY actor, spell ORDER BY row) AS n
    FROM (SELECT *, ts - lag(ts) OVER (PARTITION BY actor, spell ORDER BY row) AS gap FROM ev))) GROUP BY actor, spell, press""")
def press_groups(e):
    """Rolling-gap presses per actor and spell with their targets."""
    p = sessions.press_groups(e, ["actor", "spell"], "ts", "row", 24 * HOUR)
    return p.groupBy("actor", "spell", "press").agg(F.count("*").alias("targets"), F.countDistinct("target").alias("distinct_targets"))


@query(""", marks AS (SELECT *, lead(action) OVER w AS nxt, lead(row) OVER w AS nrow FROM ev WHERE action IN ('signup', 'error') WINDOW w AS (PARTITION BY run ORDER BY row))
SELECT run, row AS start_row, nrow AS end_row FROM marks WHERE action = 'signup' AND nxt = 'error'""")
def marker_runs(e):
    """Runs opened and closed by marker rows; a re-opening discards the open one."""
    return sessions.marker_sessions(e, ["run"], "row", F.col("action") == "signup", F.col("action") == "error")


@query("""SELECT row, run, spell, CAST(row_number() OVER (PARTITION BY run, spell ORDER BY row) AS INT) AS pull FROM ev WHERE action = 'signup'""")
def pull_numbers(e):
    """Attempts numbered per key."""
    return sessions.pull_numbers(e.filter("action = 'signup'"), ["run", "spell"], "row").select("row", "run", "spell", "pull")


_EDGES = """, st AS (SELECT *, action = 'signup' AS up, coalesce(lag(action = 'signup') OVER (PARTITION BY actor, target ORDER BY row), false) AS was FROM ev WHERE action IN ('signup', 'error')),
ed AS (SELECT *, CASE WHEN up THEN 1 ELSE -1 END AS d FROM st WHERE up <> was),
lv AS (SELECT *, sum(d) OVER (PARTITION BY actor ORDER BY row) AS n, lead(ts) OVER (PARTITION BY actor ORDER BY row) AS nx FROM ed)"""


def _edges(e):
    return intervals.state_edges(e.filter("action IN ('signup', 'error')"), ["actor"], "target", "row", F.col("action") == "signup")


@query(f"""{_EDGES} SELECT actor, CAST(sum(CASE WHEN n > 0 THEN coalesce(nx, {END}) - ts ELSE 0 END) AS BIGINT) AS up FROM lv GROUP BY actor""")
def aura_uptime(e):
    """Time with a state on any target."""
    return intervals.union_uptime(_edges(e), ["actor"], "ts", "row", F.lit(_end(e)))


_SPANS = f"""{_EDGES}, sp AS (SELECT actor, ts AS "start", coalesce(nx, {END}) AS "end" FROM lv WHERE n > 0),
mg AS (SELECT actor, min("start") AS "start", max("end") AS "end" FROM (
  SELECT *, sum(new) OVER (PARTITION BY actor ORDER BY "start", "end") AS g FROM (
    SELECT *, CASE WHEN "start" > max("end") OVER (PARTITION BY actor ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1
                   WHEN row_number() OVER (PARTITION BY actor ORDER BY "start", "end") = 1 THEN 1 ELSE 0 END AS new FROM sp)) GROUP BY actor, g)"""


@query(f"""{_SPANS} SELECT * FROM mg""")
def aura_spans(e):
    """Merged spans of a state over all targets."""
    return intervals.union_spans(_edges(e), ["actor"], "ts", "row", F.lit(_end(e)))


@query(f"""{_SPANS}, b AS (SELECT min(ts) AS lo, max(ts) AS hi FROM ev)
SELECT actor, CAST(sum(least("end", hi - (hi - lo) // 4) - greatest("start", lo + (hi - lo) // 4)) AS BIGINT) AS up, count(*) AS spans FROM mg, b
WHERE least("end", hi - (hi - lo) // 4) > greatest("start", lo + (hi - lo) // 4) GROUP BY actor""")
def interval_clip(e):
    """Spans clipped to the middle half of the stream, with their sum."""
    lo, hi = e.agg(F.min("ts"), F.max("ts")).first()
    lo, hi = lo or 0, hi or 0
    q = (hi - lo) // 4
    cut = intervals.clip(intervals.union_spans(_edges(e), ["actor"], "ts", "row", F.lit(hi)), F.lit(lo + q), F.lit(hi - q))
    return cut.groupBy("actor").agg(F.sum(F.col("end") - F.col("start")).alias("up"), F.count("*").alias("spans"))


_SEG = f"""seg AS (SELECT actor % 3 AS grp, min(row) AS id, min(ts) AS "start", max(ts) AS "end" FROM (
  SELECT *, sum(CASE WHEN gap > {12 * HOUR} OR gap IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY actor ORDER BY row) AS s
  FROM (SELECT *, ts - lag(ts) OVER (PARTITION BY actor ORDER BY row) AS gap FROM ev)) GROUP BY actor, s)"""


def _segments(e):
    s = sessions.sessionize_gap(e, ["actor"], "ts", "row", 12 * HOUR)
    return s.groupBy("actor", "session").agg(F.min("row").alias("id"), F.min("ts").alias("start"), F.max("ts").alias("end")).select((F.col("actor") % 3).alias("grp"), "id", "start", "end")


@query(f""",{_SEG} SELECT x.grp, x.id AS a, y.id AS b FROM seg x JOIN seg y ON x.grp = y.grp AND x.id < y.id AND x."start" <= y."end" AND y."start" <= x."end" """)
def overlap_segments(e):
    """Pairs of overlapping segments of one group."""
    return intervals.overlaps(_segments(e), ["grp"], "id", 12 * HOUR)


@query(f""",{_SEG}, pt AS (SELECT row, actor % 3 AS grp, ts FROM ev WHERE action = 'purchase'),
ls AS (SELECT p.row, p.grp, p.ts, list({{'segment': s.id, 'span': s."end" - s."start", 'boss': s.id % 5 = 0}} ORDER BY s.id) AS l FROM pt p LEFT JOIN seg s ON s.grp = p.grp AND p.ts BETWEEN s."start" AND s."end" GROUP BY ALL)
SELECT row, grp, ts, list_reduce(l, lambda b, x: CASE WHEN (x.boss AND NOT b.boss) OR x.span < b.span THEN x ELSE b END).segment AS segment FROM ls""")
def narrowest_segment(e):
    """The segment at a time, with the reference's preference order."""
    seg = _segments(e).withColumnRenamed("id", "segment").withColumn("boss", F.col("segment") % 5 == 0)
    points = e.filter("action = 'purchase'").select("row", (F.col("actor") % 3).alias("grp"), "ts")
    return intervals.segment_at(points, seg, ["grp"], "ts", 12 * HOUR)


_CLAIM = f"""cl AS (SELECT p.actor, min(p.row) AS press, s.row AS stop FROM ev p JOIN ev s ON p.actor = s.actor AND p.action = 'click' AND s.action = 'purchase'
  AND s.ts BETWEEN p.ts - {HOUR} AND p.ts + {12 * HOUR} GROUP BY p.actor, s.row)"""


def _claims(e):
    return pairing.claims(e.filter("action = 'click'"), e.filter("action = 'purchase'"), ["actor"], "ts", "row", HOUR, 12 * HOUR)


@query(f""",{_CLAIM} SELECT actor, press, stop FROM cl""")
def pair_actions(e):
    """I4: stops claimed by the earliest press in reach."""
    return _claims(e)


@query(f""",{_CLAIM} SELECT row, actor, ts FROM ev WHERE action = 'purchase' AND row NOT IN (SELECT stop FROM cl)""")
def orphan_actions(e):
    """Stops that no press claimed."""
    return pairing.orphans(e.filter("action = 'purchase'").select("row", "actor", "ts"), _claims(e), "row")


@query(f"""SELECT row, actor, ts FROM ev a WHERE action = 'click' AND NOT EXISTS (SELECT 1 FROM ev b WHERE b.action = 'view' AND b.actor = a.actor AND abs(a.ts - b.ts) <= {6 * HOUR})""")
def self_only(e):
    """Rows without a row of the other kind within six hours on either side."""
    return pairing.without_near(e.filter("action = 'click'").select("row", "actor", "ts"), e.filter("action = 'view'"), ["actor"], "ts", "row", 6 * HOUR)


@query(f"""SELECT a.row, arg_max(b.row, (b.ts, b.row)) AS other FROM ev a JOIN ev b ON a.actor = b.actor AND a.action = 'error' AND b.action = 'view' AND b.ts BETWEEN a.ts - {24 * HOUR} AND a.ts GROUP BY a.row""")
def latest_before(e):
    """The latest other row shortly before."""
    return pairing.latest_before(e.filter("action = 'error'"), e.filter("action = 'view'"), ["actor"], "ts", "row", 24 * HOUR)


@query(f""", win AS (SELECT target, ts AS "start", ts + {2 * HOUR} AS "end", CASE WHEN k % 2 = 0 THEN 'interrupted' ELSE 'success' END AS ended FROM ev WHERE action = 'view'),
c AS (SELECT p.row, CASE WHEN p.ts BETWEEN w."start" AND w."end" THEN 1 WHEN w."end" < p.ts AND w."end" >= p.ts - {HOUR} THEN 2 WHEN w."start" > p.ts AND w."start" <= p.ts + {HOUR} THEN 3 END AS stage, w.*
      FROM ev p JOIN win w ON p.target = w.target AND p.action = 'click' AND w."start" BETWEEN p.ts - {3 * HOUR} AND p.ts + {HOUR}),
best AS (SELECT row, arg_min({{'stage': stage, 'ended': ended}}, (stage, CASE stage WHEN 1 THEN -"start" WHEN 2 THEN -"end" ELSE "start" END)) AS x FROM c WHERE stage IS NOT NULL GROUP BY row)
SELECT ev.row, CASE WHEN x IS NULL THEN 'nothing' WHEN x.stage = 3 THEN 'early' WHEN x.ended = 'interrupted' THEN 'doubled' WHEN x.stage = 1 THEN 'ignored' ELSE 'late' END AS outcome
FROM ev LEFT JOIN best USING (row) WHERE action = 'click'""")
def press_outcomes(e):
    """What became of presses that stopped nothing."""
    win = e.filter("action = 'view'").select("target", F.col("ts").alias("start"), (F.col("ts") + 2 * HOUR).alias("end"), F.when(F.col("k") % 2 == 0, "interrupted").otherwise("success").alias("ended"))
    return pairing.outcomes(e.filter("action = 'click'"), win, ["target"], "ts", "row", HOUR, 2 * HOUR)


@query("""SELECT p.row, p.actor, p.ts, s.ts AS at, s.k FROM (SELECT row, actor, ts FROM ev WHERE action = 'purchase') p ASOF LEFT JOIN (SELECT actor, ts, max(k) AS k FROM ev WHERE action = 'view' GROUP BY actor, ts) s ON p.actor = s.actor AND p.ts >= s.ts""")
def asof_state(e):
    """V2, Q3: the latest state at or before each row."""
    return asof.asof_last(e.filter("action = 'purchase'").select("row", "actor", "ts"), e.filter("action = 'view'").groupBy("actor", "ts").agg(F.max("k").alias("k")), ["actor"], "ts", ["k"])


@query(f""", s AS (SELECT actor, min(row) AS id, max(ts) AS ts FROM (
  SELECT *, sum(CASE WHEN gap > {12 * HOUR} OR gap IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY actor ORDER BY row) AS s
  FROM (SELECT *, ts - lag(ts) OVER (PARTITION BY actor ORDER BY row) AS gap FROM ev)) GROUP BY actor, s)
SELECT s.actor, s.id, s.ts, v.k % 101 AS mana FROM s ASOF LEFT JOIN (SELECT actor, ts, max(k) AS k FROM ev WHERE action = 'purchase' GROUP BY actor, ts) v ON s.actor = v.actor AND s.ts >= v.ts""")
def drains_at_session_end(e):
    """The last known level at each segment's end."""
    s = sessions.sessionize_gap(e, ["actor"], "ts", "row", 12 * HOUR).groupBy("actor", "session").agg(F.min("row").alias("id"), F.max("ts").alias("ts")).select("actor", "id", "ts")
    v = e.filter("action = 'purchase'").groupBy("actor", "ts").agg((F.max("k") % 101).alias("mana"))
    return asof.asof_last(s, v, ["actor"], "ts", ["mana"]).select("actor", "id", "ts", "mana")


@query(f""", smp AS (SELECT actor, ts, amount AS x, amount * 2 AS y, run AS m FROM ev WHERE action = 'view'), pr AS (SELECT row, actor, ts FROM ev WHERE action = 'click'),
ab AS (SELECT pr.row, pr.ts, (SELECT arg_max(s, s.ts) FROM smp s WHERE s.actor = pr.actor AND s.ts <= pr.ts) AS a, (SELECT arg_min(s, s.ts) FROM smp s WHERE s.actor = pr.actor AND s.ts >= pr.ts) AS b FROM pr)
SELECT row, round(CASE WHEN a.m = b.m AND b.ts - a.ts <= {72 * HOUR} AND b.ts > a.ts THEN a.x + (b.x - a.x) * ((ts - a.ts)::DOUBLE / (b.ts - a.ts)) ELSE a.x END, 4) AS px,
       round(CASE WHEN a.m = b.m AND b.ts - a.ts <= {72 * HOUR} AND b.ts > a.ts THEN a.y + (b.y - a.y) * ((ts - a.ts)::DOUBLE / (b.ts - a.ts)) ELSE a.y END, 4) AS py FROM ab""")
def position_at(e):
    """Interpolated positions."""
    s = e.filter("action = 'view'").select("actor", "ts", F.col("amount").alias("x"), (F.col("amount") * 2).alias("y"), F.col("run").alias("m"))
    return asof.interpolate(e.filter("action = 'click'").select("row", "actor", "ts"), s, ["actor"], "ts", "x", "y", "m", 72 * HOUR).select("row", F.round("px", 4).alias("px"), F.round("py", 4).alias("py"))


@query("""SELECT row, CAST(run_ - least(0, min(run_) OVER w2) AS BIGINT) AS marks FROM (SELECT *, sum(CASE WHEN action = 'signup' THEN 1 ELSE -1 END) OVER w AS run_ FROM ev WHERE action IN ('signup', 'error')
  WINDOW w AS (PARTITION BY actor, target ORDER BY row)) WINDOW w2 AS (PARTITION BY actor, target ORDER BY row)""")
def running_marks(e):
    """Live marks per actor and target, never below zero."""
    m = e.filter("action IN ('signup', 'error')")
    return asof.running_marks(m, ["actor", "target"], "row", F.when(F.col("action") == "signup", 1).otherwise(-1)).select("row", "marks")


_FOREST = f""", ro AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY run ORDER BY row) <= {HOUR // 2} THEN lag(enemy) OVER (PARTITION BY run ORDER BY row) END AS prev,
  row_number() OVER (PARTITION BY run, enemy ORDER BY row) AS nth FROM (SELECT *, k % 400 AS enemy FROM ev)),
par AS (SELECT run, enemy, coalesce(prev, enemy) AS parent FROM ro WHERE nth = 1),
up AS (SELECT run, enemy, enemy AS segment FROM par WHERE parent = enemy UNION ALL SELECT p.run, p.enemy, u.segment FROM par p JOIN up u ON p.run = u.run AND p.parent = u.enemy WHERE p.parent <> p.enemy)"""


def _pulls(e):
    return attribution.counterpart_segments(e.withColumn("enemy", F.col("k") % 400), "run", "enemy", "ts", "row", HOUR // 2)


@query(f"{_FOREST} SELECT run, enemy, segment FROM up")
def counterpart_segments(e):
    """Pulls as roots of the counterpart forest."""
    return _pulls(e)


@query(f"""{_FOREST} SELECT e.run, u.segment, min(e.ts) AS "start", max(e.ts) AS "end", count(*) AS hits, count(DISTINCT e.enemy) AS enemies, round(sum(CASE WHEN amount > 0 THEN amount END), 2) AS centre_sum, count(*) FILTER (amount > 0) AS centre_n
FROM (SELECT *, k % 400 AS enemy FROM ev) e JOIN up u ON e.run = u.run AND e.enemy = u.enemy GROUP BY e.run, u.segment""")
def segment_bounds(e):
    """Bounds, size and centre of each pull."""
    rows = e.withColumn("enemy", F.col("k") % 400).join(_pulls(e), ["run", "enemy"])
    return rows.groupBy("run", "segment").agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.count("*").alias("hits"), F.countDistinct("enemy").alias("enemies"), F.round(F.sum(F.when(F.col("amount") > 0, F.col("amount"))), 2).alias("centre_sum"), F.count_if(F.col("amount") > 0).alias("centre_n"))


@query("""SELECT run, target, min(ts) AS first_ts, round(max(amount), 4) AS peak, round(arg_max(amount, row), 4) AS last_hp, count(*) FILTER (action = 'error') > 0 OR arg_max(amount, row) <= 1 AS defeated FROM ev GROUP BY run, target""")
def first_engagement(e):
    """First engagement, peak and last health, and the defeated rule."""
    last = F.max_by("amount", "row")
    return e.groupBy("run", "target").agg(F.min("ts").alias("first_ts"), F.round(F.max("amount"), 4).alias("peak"), F.round(last, 4).alias("last_hp"), ((F.count_if(F.col("action") == "error") > 0) | (last <= 1)).alias("defeated"))


@query(f"""SELECT a.row AS anchor, count(*) AS rows, count(*) FILTER (r.action = 'click') AS hits, round(sum(r.amount) FILTER (r.action = 'click'), 2) AS taken, round(sum(r.amount) FILTER (r.action = 'purchase'), 2) AS healed,
  max(r.row) FILTER (r.action = 'click') AS blow FROM ev a JOIN ev r ON a.actor = r.actor AND a.action = 'error' AND r.ts >= a.ts - {24 * HOUR} AND r.row <= a.row GROUP BY a.row""")
def lookback_before_anchor(e):
    """M2, M4, M6: what reached an anchor's actor in the window before it, and the last blow."""
    got = attribution.lookback(e.filter("action = 'error'"), e, ["actor"], "ts", "row", 24 * HOUR)
    hit, heal = F.col("action") == "click", F.col("action") == "purchase"
    return got.groupBy("anchor").agg(F.count("*").alias("rows"), F.count_if(hit).alias("hits"), F.round(F.sum(F.when(hit, F.col("amount"))), 2).alias("taken"), F.round(F.sum(F.when(heal, F.col("amount"))), 2).alias("healed"), F.max(F.when(hit, F.col("row"))).alias("blow"))


@query(f"""SELECT spell, count(*) AS casts, round(avg(single), 6) AS single_share, count(DISTINCT target) AS targets FROM (
  SELECT spell, press, CASE WHEN count(DISTINCT target) = 1 THEN 1 ELSE 0 END AS single, min(target) AS target FROM (
    SELECT *, sum(CASE WHEN gap > {2 * HOUR} OR gap IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY spell ORDER BY row) AS press
    FROM (SELECT *, ts - lag(ts) OVER (PARTITION BY spell ORDER BY row) AS gap FROM ev WHERE action = 'view')) GROUP BY spell, press)
GROUP BY spell HAVING count(*) >= 3 AND avg(single) >= 0.5 AND count(DISTINCT target) >= 3""")
def random_picks(e):
    """T5: spells whose casts mostly pick one target, over several targets."""
    s = sessions.sessionize_gap(e.filter("action = 'view'"), ["spell"], "ts", "row", 2 * HOUR, "press")
    casts = s.groupBy("spell", "press").agg((F.countDistinct("target") == 1).cast("int").alias("single"), F.min("target").alias("target"))
    return casts.groupBy("spell").agg(F.count("*").alias("casts"), F.round(F.avg("single"), 6).alias("single_share"), F.countDistinct("target").alias("targets")).filter("casts >= 3 AND single_share >= 0.5 AND targets >= 3")


@query("""SELECT actor, row AS pick, round(amount, 4) AS best FROM (SELECT *, row_number() OVER (PARTITION BY actor ORDER BY amount DESC, row) AS n FROM ev WHERE action = 'click') WHERE n = 1""")
def biggest_hit(e):
    """T4: each actor's biggest hit, the first on ties."""
    return ranking.arg_best(e.filter("action = 'click'"), ["actor"], F.col("row"), F.col("amount"), F.col("row")).withColumn("best", F.round("best", 4))


@query("""SELECT target, arg_max(actor, (total, -actor)) AS source, round(max(total), 2) AS total FROM (SELECT target, actor, sum(amount) AS total FROM ev GROUP BY target, actor) GROUP BY target""")
def top_source(e):
    """The source that did most to each target."""
    g = e.groupBy("target", "actor").agg(F.sum("amount").alias("total"))
    return g.groupBy("target").agg(F.max_by("actor", F.struct("total", (-F.col("actor")).alias("o"))).alias("source"), F.round(F.max("total"), 2).alias("total"))


@query("""SELECT run, actor, action AS dominant, n AS votes FROM (SELECT *, row_number() OVER (PARTITION BY run, actor ORDER BY n DESC, f) AS r FROM (SELECT run, actor, action, count(*) AS n, min(row) AS f FROM ev GROUP BY ALL)) WHERE r = 1""")
def dominant_action(e):
    """The most frequent value, the first seen on ties."""
    return ranking.dominant(e, ["run", "actor"], "action", "row")


@query("""SELECT actor, count(*) FILTER (action = 'click') AS click, count(*) FILTER (action = 'purchase') AS purchase, count(*) FILTER (action = 'error') AS error, count(*) FILTER (action = 'signup') AS signup, count(*) FILTER (action = 'view') AS "view" FROM ev GROUP BY actor""")
def outcome_histogram(e):
    """Outcomes per actor, pivoted."""
    names = ["click", "purchase", "error", "signup", "view"]
    return e.groupBy("actor").pivot("action", names).count().na.fill(0, names)


_KEPT = """seq AS (SELECT actor, ts, row, row_number() OVER (PARTITION BY actor ORDER BY row) AS n FROM ev{where}),
fold AS (SELECT actor, n, row, ts AS last, true AS kept FROM seq WHERE n = 1
  UNION ALL SELECT s.actor, s.n, s.row, CASE WHEN s.ts - f.last >= {gap} THEN s.ts ELSE f.last END, s.ts - f.last >= {gap} FROM fold f JOIN seq s ON s.actor = f.actor AND s.n = f.n + 1)"""


@query("," + _KEPT.format(where="", gap=12 * HOUR) + " SELECT actor, row FROM fold WHERE kept")
def thin_samples(e):
    """Samples at least twelve hours after the last one kept."""
    return pairing.kept_apart(e.select("actor", "ts", "row"), ["actor"], "ts", "row", 12 * HOUR).select("actor", "row")


@query("," + _KEPT.format(where=" WHERE action = 'click'", gap=24 * HOUR) + " SELECT actor, count(*) AS presses FROM fold WHERE kept GROUP BY actor")
def press_dedupe(e):
    """Presses counted once until a day after the last counted one."""
    return pairing.kept_apart(e.filter("action = 'click'").select("actor", "ts", "row"), ["actor"], "ts", "row", 24 * HOUR).groupBy("actor").agg(F.count("*").alias("presses"))


@query(f""", seq AS (SELECT actor, ts, row, row_number() OVER (PARTITION BY actor ORDER BY row) AS n FROM ev WHERE action = 'purchase'),
fold AS (SELECT actor, n, row, ts, [ts + {24 * HOUR}] AS back FROM seq WHERE n = 1
  UNION ALL SELECT s.actor, s.n, s.row, s.ts, list_append(list_filter(f.back, lambda b: b > s.ts), greatest(s.ts, coalesce(list_max(list_filter(f.back, lambda b: b > s.ts)), s.ts)) + {24 * HOUR})
  FROM fold f JOIN seq s ON s.actor = f.actor AND s.n = f.n + 1)
SELECT actor, row, CASE WHEN len(back) < 2 THEN ts ELSE back[len(back) - 1] END AS ready_at FROM fold""")
def cooldown_state(e):
    """When a two-charge clock is next ready after each use."""
    return pairing.charge_clock(e.filter("action = 'purchase'").select("actor", "ts", "row"), ["actor"], "ts", "row", 24 * HOUR, 2).select("actor", "row", "ready_at")


@query("""SELECT run, actor, round(sum(amount), 2) AS total, count(*) AS rows, CAST(GROUPING(run) * 2 + GROUPING(actor) AS BIGINT) AS level FROM ev GROUP BY ROLLUP (run, actor)""")
def run_and_actor_rollup(e):
    """One report at run, actor and whole level in a single pass."""
    return e.rollup("run", "actor").agg(F.round(F.sum("amount"), 2).alias("total"), F.count("*").alias("rows"), F.grouping_id().alias("level"))


@query(f"""SELECT actor, bucket, hits, round(total, 2) AS total, round(last_value(hp IGNORE NULLS) OVER (PARTITION BY actor ORDER BY bucket), 4) AS hp FROM (
  SELECT actor, ts // {24 * HOUR} AS bucket, count(*) FILTER (action = 'click') AS hits, coalesce(sum(amount) FILTER (action = 'click'), 0) AS total, arg_max(amount, row) FILTER (action = 'view') AS hp FROM ev GROUP BY ALL)""")
def event_buckets(e):
    """Fixed buckets with health carried forward."""
    b = e.withColumn("bucket", F.floor(F.col("ts") / (24 * HOUR)).cast("long"))
    hit = F.col("action") == "click"
    g = b.groupBy("actor", "bucket").agg(F.count_if(hit).alias("hits"), F.round(F.coalesce(F.sum(F.when(hit, F.col("amount"))), F.lit(0.0)), 2).alias("total"), F.max_by("amount", F.when(F.col("action") == "view", F.col("row"))).alias("hp0"))
    g = g.withColumn("hp0", F.round("hp0", 4))
    return asof.carried(g, ["actor"], "bucket", "hp0", "hp").drop("hp0")


@query(f"""SELECT actor, CAST(sum(CASE WHEN ok THEN 1 ELSE 0 END) AS BIGINT) AS counted, round(count(*) / 30.0, 6) AS expected FROM (
  SELECT *, coalesce(ts - lag(ts) OVER (PARTITION BY actor ORDER BY row) >= {4 * HOUR}, true) AS ok FROM ev WHERE action = 'view') GROUP BY actor""")
def procs_expected(e):
    """Procs counted where the last one (counted or not) is long enough ago, against expectation."""
    ok = F.coalesce(F.col("ts") - F.lag("ts").over(W.partitionBy("actor").orderBy("row")) >= 4 * HOUR, F.lit(True))
    return e.filter("action = 'view'").withColumn("ok", ok).groupBy("actor").agg(F.sum(F.col("ok").cast("long")).alias("counted"), F.round(F.count("*") / 30.0, 6).alias("expected"))


@query(f""", st AS (SELECT *, lag(CASE WHEN action = 'error' THEN ts END IGNORE NULLS) OVER (PARTITION BY actor ORDER BY row) AS off FROM ev)
SELECT row, actor FROM st WHERE action = 'click' AND (off IS NULL OR ts - off > {24 * HOUR})""")
def avoidable_hits(e):
    """V1, V2: hits not excused by a state that came off shortly before."""
    w = W.partitionBy("actor").orderBy("row").rowsBetween(W.unboundedPreceding, -1)
    off = F.last(F.when(F.col("action") == "error", F.col("ts")), ignorenulls=True).over(w)
    return e.withColumn("off", off).filter((F.col("action") == "click") & (F.col("off").isNull() | (F.col("ts") - F.col("off") > 24 * HOUR))).select("row", "actor")


@query("""SELECT run, target, row AS row, CAST(row_number() OVER (PARTITION BY run, target ORDER BY row) AS INT) AS nth, coalesce(ts - lag(ts) OVER (PARTITION BY run, target ORDER BY row), -1) AS since FROM ev WHERE action = 'error'""")
def death_anchors(e):
    """Anchors with their number so far and the time since the one before."""
    w = W.partitionBy("run", "target").orderBy("row")
    return e.filter("action = 'error'").select("run", "target", "row", F.row_number().over(w).alias("nth"), F.coalesce(F.col("ts") - F.lag("ts").over(w), F.lit(-1)).alias("since"))


@query("""SELECT row, actor, party FROM (SELECT *, row_number() OVER (PARTITION BY run, actor ORDER BY row) AS first, dense_rank() OVER (PARTITION BY run ORDER BY f) AS party
  FROM (SELECT *, min(row) OVER (PARTITION BY run, actor) AS f FROM ev)) WHERE first = 1""")
def party_roster(e):
    """Each run's members in the order in which they were first seen."""
    first = e.groupBy("run", "actor").agg(F.min("row").alias("row"))
    return first.select("row", "actor", F.row_number().over(W.partitionBy("run").orderBy("row")).cast("long").alias("party"))


@query("""SELECT run, count(*) FILTER (NOT same) AS differing FROM (SELECT t.run, abs(t.total - s.total) < 0.01 AS same FROM (SELECT run, sum(amount) AS total FROM ev GROUP BY run) t JOIN (SELECT run, sum(total) AS total FROM (SELECT run, actor, sum(amount) AS total FROM ev GROUP BY ALL) GROUP BY run) s USING (run)) GROUP BY run""")
def conservation(e):
    """The parts of each run sum to the whole."""
    whole = e.groupBy("run").agg(F.sum("amount").alias("t"))
    parts = e.groupBy("run", "actor").agg(F.sum("amount").alias("p")).groupBy("run").agg(F.sum("p").alias("p"))
    return whole.join(parts, "run").groupBy("run").agg(F.count_if(F.abs(F.col("t") - F.col("p")) >= 0.01).alias("differing"))
