"""Queries that start from log lines: the driver's ``events`` written as log lines, decoded, and reported on.

Each of four files holds one run: the events of the users with user_id % 4 = file, in order of
event_id, one second apart in four steps a row, between the control lines of a timed run with five
members. A row's kind follows from its event type and k (see ``LINES``); the oracle SQL computes each
report from ``events`` alone. The log is opened once per session and state of the table's files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window as W

from millrace.functions.times import FEW
from millrace.operators import pieces
from millrace.plans import badges, casting, deaths as death_plan, maps as map_plan, moments, reports, runs as run_plan, views
from millrace.session import discard, fingerprint, scratch, stored, table
from millrace.sources import log

FILES, MEMBERS, STEP_MS, HEAD = 4, 5, 700, 9
BOSS_EVERY = 400  # rows between the starts of two boss fights
BOSS_ROWS = 100  # rows of a boss fight
QUERIES, SQL = {}, {}
_OPEN: dict[tuple[str, str], tuple[str, str, reports.Context]] = {}  # of one application and folder: the log of its files as they are now

#: The events as the lines tell them: n numbers a file's rows from 1, ts is the run's time, whole amounts.
EV = f"""ev AS (
SELECT f, n, {HEAD} + n AS row, n * {STEP_MS} AS ts, event_type AS action, k, CAST(round(value * 10) AS BIGINT) AS amount, k % 3 = 0 AS wasteful, k % 4 = 0 AS crit,
       'Player-1-' || lpad(CAST(user_id // {FILES} % {MEMBERS} AS VARCHAR), 4, '0') AS member, 'Player-1-' || lpad(CAST(k % {MEMBERS} AS VARCHAR), 4, '0') AS other,
       'Creature-0-1-2-3-' || CAST(500 + k % 7 AS VARCHAR) || '-' || lpad(CAST(k % 7 + 10 * (n // 50) AS VARCHAR), 10, '0') AS enemy, 500 + k % 7 AS npc, 100 + k % 10 AS spell
FROM (SELECT *, user_id % {FILES} AS f, row_number() OVER (PARTITION BY user_id % {FILES} ORDER BY event_id) AS n FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events))),
hit AS (SELECT *, CASE WHEN wasteful AND amount > 10 THEN amount // 5 ELSE -1 END AS waste FROM ev),
eff AS (SELECT *, CASE WHEN waste > 0 THEN amount - waste ELSE amount END AS net FROM hit)"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_id, row, line). click: damage by the member; purchase: a heal; view: an enemy's spell on the member, the
    last blow of a death where k % 25 = 1; signup: a debuff put on the enemy, error: taken off, where k is even - else
    a kick (signup) and an enemy's cast that it may stop (error)."""
    k = F.get_json_object("props", "$.k").cast("long").alias("k")
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.col("event_type").alias("action"), "value", k)
    e, files = _numbered(e.withColumn("f", (F.col("user_id") % FILES).cast("int")))
    e = e.withColumns({"amount": F.floor(F.col("value") * 10 + 0.5).cast("long")})
    member, other = (F.concat(F.lit("Player-1-"), F.lpad(x.cast("string"), 4, "0")) for x in (F.floor(F.col("user_id") / FILES) % MEMBERS, F.col("k") % MEMBERS))
    npc = F.col("k") % 7
    enemy = F.concat(F.lit("Creature-0-1-2-3-"), (500 + npc).cast("string"), F.lit("-"), F.lpad((npc + 10 * F.floor(F.col("n") / 50)).cast("string"), 10, "0"))
    named = lambda g, flags: F.concat(g, F.lit(',"'), F.substring_index(g, "-", -1), F.lit(f'",{flags},0x0'))
    us, them, also = named(member, "0x511"), named(enemy, "0xa48"), named(other, "0x511")
    spell = F.concat(F.lit(","), (100 + F.col("k") % 10).cast("string"), F.lit(',"Spell '), (F.col("k") % 4).cast("string"), F.when(F.col("k") % 10 < 4, "").otherwise(" (rank)"), F.lit('",0x4'))
    block = lambda g: F.concat(F.lit(","), g, F.lit(",0000000000000000,"), (F.col("k") + 1).cast("string"), F.lit(",100,0,0,0,0,0,0,0,"), (F.col("k") % 50).cast("string"), F.lit(",50,0,"), F.format_string("%.2f,%.2f,%d,1.0,70", F.col("k") + 0.5, F.col("n") % 40 + 0.25, F.col("k") % 2 + 1))
    waste = F.when((F.col("k") % 3 == 0) & (F.col("amount") > 10), F.floor(F.col("amount") / 5)).otherwise(-1).cast("string")
    blow = F.concat(F.lit(","), F.col("amount").cast("string"), F.lit(","), F.col("amount").cast("string"), F.lit(","), waste, F.lit(",4,nil,nil,nil,"), F.when(F.col("k") % 4 == 0, "1").otherwise("nil"), F.lit(",nil,nil,ST"))
    mend = F.concat(F.lit(","), F.col("amount").cast("string"), F.lit(","), F.col("amount").cast("string"), F.lit(","), F.greatest(waste.cast("long"), F.lit(0)).cast("string"), F.lit(",0,"), F.when(F.col("k") % 4 == 0, "1").otherwise("nil"))
    even, act = F.col("k") % 2 == 0, F.col("action")
    at = lambda name, *parts: F.concat(F.lit(f"{name},"), *parts)
    body = (
        F.when(act == "click", at("SPELL_DAMAGE", us, F.lit(","), them, spell, block(member), blow)).when(act == "purchase", at("SPELL_HEAL", us, F.lit(","), also, spell, block(other), mend))
        .when(act == "view", at("SPELL_DAMAGE", them, F.lit(","), us, spell, block(enemy), blow)).when((act == "signup") & even, at("SPELL_AURA_APPLIED", us, F.lit(","), them, spell, F.lit(",DEBUFF")))
        .when((act == "error") & even, at("SPELL_AURA_REMOVED", us, F.lit(","), them, spell, F.lit(",DEBUFF"))).when(act == "signup", at("SPELL_CAST_SUCCESS", us, F.lit(","), them, F.lit(',61,"Kick",0x1')))
        .otherwise(at("SPELL_CAST_START", them, F.lit(",0000000000000000,nil,0x80000000,0x0"), spell))
    )
    stamp = lambda ms: F.concat(F.date_format(F.date_add(F.lit("2024-05-21").cast("date"), F.floor(ms / 86_400_000).cast("int")), "M/d/yyyy "), F.date_format(F.timestamp_millis(ms % 86_400_000), "HH:mm:ss.SSS"), F.lit("+0  "))
    stands = lambda n: F.least("fights", F.floor((n + BOSS_ROWS) / BOSS_EVERY)) + F.least("fights", F.floor(n / BOSS_EVERY))  # noqa: E731  edges of boss fights up to n
    row, when = HEAD + F.col("n") + F.col("deaths") + stands(F.col("n") - 1), stamp(F.col("n") * STEP_MS)
    nth = lambda n: F.when((n % BOSS_EVERY == 0) & (n / BOSS_EVERY).between(1, F.col("fights")), F.floor(n / BOSS_EVERY).cast("string"))
    opens, closes = nth(F.col("n") + BOSS_ROWS), nth(F.col("n"))
    edge = F.when(opens.isNotNull(), F.concat(F.lit("ENCOUNTER_START,"), opens, F.lit(',"Lord",8,5,2000'))).when(closes.isNotNull(), F.concat(F.lit("ENCOUNTER_END,"), closes, F.lit(',"Lord",8,5,1,70000')))
    told = lambda at, text: F.struct(at.cast("long").alias("row"), F.concat(when, text).alias("line"))
    dies = F.when(F.col("dead"), told(row + 1, at("UNIT_DIED", F.lit("0000000000000000,nil,0x80000000,0x0,"), us, F.lit(",0"))))
    each = F.array_compact(F.array(told(row, body), dies, F.when(edge.isNotNull(), told(row + 1 + F.col("dead").cast("int"), edge))))
    rows = e.select("f", F.inline(each))
    head = ['ZONE_CHANGE,2000,"Hall",8', 'MAP_CHANGE,1,"Hall",10.0,-10.0,5.0,-5.0', 'MAP_CHANGE,2,"Loft",20.0,-20.0,9.0,-9.0', 'CHALLENGE_MODE_START,"Hall",2000,500,12,[9,10]'] + [f"COMBATANT_INFO,Player-1-{m:04d},1,100,{(64, 257, 250, 71, 265)[m]},[(1,2,3),(4,5)],[],[Player-1-{m:04d},31]" for m in range(MEMBERS)]
    first = files.select("f", F.posexplode(F.array(*map(F.lit, head))).alias("i", "h")).select("f", (F.col("i") + 1).cast("long").alias("row"), F.concat(stamp(F.lit(0).cast("long")), "h").alias("line"))
    end = files.select("f", (HEAD + F.col("last") + F.col("deaths") + 2 * F.col("fights") + 1).alias("row"), F.concat(stamp((F.col("last") + 1) * STEP_MS), F.lit("CHALLENGE_MODE_END,2000,1,12,59000")).alias("line"))
    return rows.unionByName(first).unionByName(end).select(F.format_string("f%d", "f").alias("file_id"), "row", "line")


def _numbered(e: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events, files): events with n, their number in their file from 1 in order of event_id, deaths, how many died before,
    and fights, the boss fights of the file; files (f, last, deaths, fights) with the totals.

    A block of ids is numbered by one task, whatever the file's size; the blocks' counts, summed along each file, tell what
    stands before a block. They are one row in about BLOCK_ROWS events, and broadcast up to a checked size.
    """
    ids = F.coalesce(F.floor(F.col("event_id") / (FILES * pieces.BLOCK_ROWS)), F.lit(-(2**62)))  # no id comes first
    e = e.withColumns({"dead": F.coalesce(F.expr("action = 'view' AND k % 25 = 1"), F.lit(False)), pieces.BLOCK: ids})
    blocks = e.groupBy("f", pieces.BLOCK).agg(F.count("*").alias("_rows"), F.count_if("dead").alias("_dead"))
    fights = F.floor((F.col("last") - 1) / BOSS_EVERY)
    files = blocks.groupBy("f").agg(F.sum("_rows").alias("last"), F.sum("_dead").alias("deaths")).withColumn("fights", fights)
    file, inside = W.partitionBy("_f"), W.partitionBy("f", pieces.BLOCK).orderBy("event_id")
    before = lambda c: F.coalesce(F.sum(c).over(file.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    known = blocks.withColumnsRenamed({"f": "_f", pieces.BLOCK: "_b"}).withColumns({"_n": before("_rows"), "_d": before("_dead"), "last": F.sum("_rows").over(file)})
    known = known.select("_f", "_b", "_n", "_d", fights.alias("fights"))
    known = F.broadcast(known) if known.limit(FEW + 1).count() <= FEW else known
    e = e.join(known, F.col("f").eqNullSafe(F.col("_f")) & (F.col(pieces.BLOCK) == F.col("_b")))
    died = F.coalesce(F.sum(F.col("dead").cast("long")).over(inside.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return e.withColumns({"n": F.col("_n") + F.row_number().over(inside), "deaths": F.col("_d") + died}), files


def opened(spark: SparkSession, sf_dir: str) -> reports.Context:
    """The opened log; opened anew, and the old one's tables deleted, once the files of ``events`` differ."""
    key, now = (spark.sparkContext.applicationId, sf_dir), fingerprint(spark, f"{sf_dir.rstrip('/')}/events.parquet")
    known = _OPEN.get(key)
    if known is None or known[0] != now:
        if known:
            discard(spark, known[1])
        at = scratch(spark)
        _OPEN[key] = (now, at, reports.open_log(spark, stored(lines(spark, sf_dir), at, "lines"), folder=at))
    return _OPEN[key][2]


def query(sql: str | None = None):
    """Registers a report over the opened log under ``log_`` and its name. The file's number stands for the run."""

    def add(f):
        name = f"log_{f.__name__}"
        QUERIES[name] = lambda spark, sf_dir: _named(f(opened(spark, sf_dir)))
        if sql:
            SQL[name] = "WITH RECURSIVE " + EV + ("\n" + sql if sql.lstrip().startswith(",") else "\n" + sql)
        return f

    return add


def _named(df: DataFrame) -> DataFrame:
    """run_id as the file's number; rounded doubles."""
    if "run_id" in df.columns:
        df = df.withColumn("run_id", F.regexp_extract("run_id", r"^f(\d+)#", 1).cast("int"))
    return df.select(*(F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def _dim(ctx: reports.Context, rows: list[tuple], schema: str) -> DataFrame:
    return ctx.events.sparkSession.createDataFrame(rows, schema)


@query("SELECT CAST(f AS INT) AS run_id, 'Hall' AS title, 12 AS level, CAST(max(n) + 1 AS BIGINT) * 700 AS ms, true AS success, 59000 AS total_ms, CAST(count(*) AS BIGINT) AS events FROM ev GROUP BY f")
def runs(ctx):
    """Lines to runs, with the rows of each that tell of units (deaths left out)."""
    n = ctx.events.filter("code <> 'UNIT_DIED'").groupBy("run_id").agg(F.count("*").alias("events"))
    return ctx.runs.join(n, "run_id").join(reports.elapsed(ctx), "run_id").select("run_id", "title", F.col("level").cast("int").alias("level"), "ms", "success", F.col("total_ms").cast("int").alias("total_ms"), "events")


@query("SELECT CAST(f AS INT) AS run_id, 'Player-1-' || lpad(CAST(m AS VARCHAR), 4, '0') AS guid, CAST(m + 1 AS INT) AS place, [64, 257, 250, 71, 265][m + 1] AS spec_id FROM (SELECT DISTINCT f FROM ev), range(5) t(m)")
def party(ctx):
    """Members by their first announcement, with their specs."""
    return ctx.party.select("run_id", "guid", F.col("place").cast("int").alias("place"), F.col("spec_id").cast("int").alias("spec_id"))


@query("SELECT CAST(f AS INT) AS run_id, 'Player-1-' || lpad(CAST(m AS VARCHAR), 4, '0') AS guid, 'Player-1-' || lpad(CAST(m AS VARCHAR), 4, '0') AS caster, 31 AS spell_id FROM (SELECT DISTINCT f FROM ev), range(5) t(m)")
def opening_auras(ctx):
    """States up when the run opened."""
    return run_plan.opening_auras(ctx.party).select("run_id", "guid", "caster", F.col("spell_id").cast("int").alias("spell_id"))


@query("""SELECT CAST(f AS INT) AS run_id, map, title, x0, x1, y0, y1 FROM (SELECT DISTINCT f FROM ev), (VALUES (2, 'Loft', -20.0, 20.0, -9.0, 9.0)) t(map, title, x0, x1, y0, y1)""")
def maps(ctx):
    """Maps of the run, the one entered last before it included."""
    return run_plan.maps(ctx.controls, ctx.runs).select("run_id", F.col("map").cast("int").alias("map"), "title", *(F.col(c).cast("decimal(3,1)").alias(c) for c in ("x0", "x1", "y0", "y1")))


@query("""SELECT CAST(f AS INT) AS run_id, ts, CASE action WHEN 'view' THEN enemy ELSE member END AS src, CASE action WHEN 'click' THEN enemy WHEN 'purchase' THEN other ELSE member END AS dst, CAST(spell AS BIGINT) AS spell_id,
CAST(amount AS DOUBLE) AS amount, CASE WHEN action = 'purchase' THEN greatest(waste, 0) ELSE waste END AS waste, crit, k + 1 AS hp, CAST(k + 0.5 AS DOUBLE) AS x, CAST(k % 2 + 1 AS BIGINT) AS map, CAST(floor(100 * (k % 50) / 50 + 0.5) AS BIGINT) AS mana
FROM hit WHERE action IN ('click', 'purchase', 'view')""")
def decoded(ctx):
    """Typed fields of every hit and heal."""
    rows = ctx.events.filter("code IN ('SPELL_DAMAGE', 'SPELL_HEAL')")
    return rows.select("run_id", "ts", "src", "dst", "spell_id", "amount", "waste", "crit", "hp", "x", "map", "mana").withColumn("x", F.col("x").cast("decimal(10,1)").cast("double"))


_DONE = """, done AS (SELECT f, member AS actor, spell, sum(net) AS total, sum(amount) AS raw, sum(greatest(waste, 0)) AS wasted, count(*) AS hits, count(*) FILTER (crit) AS crits, coalesce(sum(net) FILTER (crit), 0) AS crit_total, max(net) AS biggest FROM eff WHERE action = 'click' GROUP BY ALL)"""


@query(f"""{_DONE} SELECT CAST(f AS INT) AS run_id, actor, CAST(spell AS BIGINT) AS spell_id, CAST(total AS DOUBLE) AS total, CAST(raw AS DOUBLE) AS raw, CAST(wasted AS BIGINT) AS wasted, hits, crits, CAST(crit_total AS DOUBLE) AS crit_total, CAST(biggest AS DOUBLE) AS biggest,
round(total / ((SELECT max(n) + 1 FROM ev e WHERE e.f = d.f) * 0.7), 6) AS per_second, round(total / sum(total) OVER (PARTITION BY f), 6) AS share FROM done d""")
def breakdown_done(ctx):
    """Damage done per member and spell."""
    return reports.breakdown(ctx).select("run_id", "actor", "spell_id", "total", "raw", F.col("wasted").cast("long").alias("wasted"), "hits", "crits", F.col("crit_total").cast("double").alias("crit_total"), "biggest", "per_second", "share")


@query("""SELECT CAST(f AS INT) AS run_id, member AS actor, CAST(spell AS BIGINT) AS spell_id, CAST(sum(net) AS DOUBLE) AS total, count(*) AS hits FROM eff WHERE action = 'view' GROUP BY ALL""")
def breakdown_taken(ctx):
    """Damage taken."""
    return reports.breakdown(ctx, "taken").select("run_id", "actor", "spell_id", "total", "hits")


@query("""SELECT CAST(f AS INT) AS run_id, member AS actor, CAST(spell AS BIGINT) AS spell_id, CAST(sum(net) AS DOUBLE) AS total, CAST(sum(greatest(waste, 0)) AS BIGINT) AS wasted, count(*) AS hits FROM eff WHERE action = 'purchase' GROUP BY ALL""")
def breakdown_healing(ctx):
    """Healing."""
    return reports.breakdown(ctx, "healing").select("run_id", "actor", "spell_id", "total", F.col("wasted").cast("long").alias("wasted"), "hits")


@query("""SELECT DISTINCT ON (f, member, spell) CAST(f AS INT) AS run_id, member AS actor, CAST(spell AS BIGINT) AS spell_id, enemy AS source, CAST(total AS DOUBLE) AS total
FROM (SELECT f, member, spell, enemy, sum(net) AS total, min(row) AS first FROM eff WHERE action = 'view' GROUP BY ALL) ORDER BY f, member, spell, total DESC, first""")
def top_source(ctx):
    """Who dealt most of each spell's damage taken."""
    return reports.top_sources(ctx)


@query("""SELECT CAST(f AS INT) AS run_id, member AS actor, CAST(coalesce(sum(gap) FILTER (gap <= 10000), 0) AS BIGINT) AS active FROM (SELECT *, ts - lag(ts) OVER (PARTITION BY f, member ORDER BY n) AS gap FROM ev WHERE action = 'click') GROUP BY ALL""")
def active_time(ctx):
    """Time between hits at most ten seconds apart."""
    return reports.active_time(ctx)


_AURA = """, st AS (SELECT *, action = 'signup' AS up, coalesce(lag(action = 'signup') OVER (PARTITION BY f, member, spell, enemy ORDER BY n), false) AS was FROM ev WHERE action IN ('signup', 'error') AND k % 2 = 0),
ed AS (SELECT *, CASE WHEN up THEN 1 ELSE -1 END AS d FROM st WHERE up <> was),
lv AS (SELECT *, sum(d) OVER (PARTITION BY f, member, spell ORDER BY n) AS c, coalesce(lead(ts) OVER (PARTITION BY f, member, spell ORDER BY n), (SELECT max(n) + 1 FROM ev e WHERE e.f = ed.f) * 700) AS nx FROM ed)"""


@query(f"""{_AURA} SELECT CAST(f AS INT) AS run_id, member AS actor, CAST(spell AS BIGINT) AS spell_id, CAST(sum(CASE WHEN c > 0 THEN nx - ts ELSE 0 END) AS BIGINT) AS up FROM lv GROUP BY ALL""")
def aura_uptime(ctx):
    """Time with a state on any target."""
    return reports.aura_uptime(ctx)


@query("""SELECT CAST(f AS INT) AS run_id, member AS actor, count(*) AS debuffs_applied FROM ev WHERE action = 'signup' AND k % 2 = 0 GROUP BY ALL""")
def debuffs_applied(ctx):
    """Debuffs put on enemies."""
    return moments.debuff_tallies(ctx).filter("debuffs_applied > 0").select("run_id", "actor", F.col("debuffs_applied").cast("long").alias("debuffs_applied"))


@query("""SELECT CAST(f AS INT) AS run_id, enemy, min(ts) AS first, CAST(count(*) AS BIGINT) AS hits, CAST(npc AS INT) AS npc_id FROM ev WHERE action IN ('click', 'view') GROUP BY f, enemy, npc""")
def engagements(ctx):
    """Enemies that traded blows with the party."""
    return reports.engagements(ctx).groupBy("run_id", "enemy", "npc_id").agg(F.min("ts").alias("first"), F.count("*").alias("hits"))


_SEGMENT = f""", blow AS (SELECT * FROM ev WHERE action IN ('click', 'view')),
boss AS (SELECT f, b, b * {BOSS_EVERY} - {BOSS_ROWS} AS n0 FROM (SELECT f, max(n) AS last FROM ev GROUP BY f), range(1, 100000) t(b) WHERE b * {BOSS_EVERY} < last),
first AS (SELECT f, enemy, min(n) AS n FROM blow GROUP BY f, enemy),
side AS (SELECT first.*, min(b) AS b FROM first LEFT JOIN boss ON boss.f = first.f AND first.n BETWEEN n0 AND n0 + {BOSS_ROWS} GROUP BY ALL)"""


@query(f"""{_SEGMENT},
peaks AS (SELECT s.*, bb.b AS near FROM side s LEFT JOIN boss bb ON s.b IS NULL AND bb.f = s.f AND s.n * 700 BETWEEN bb.n0 * 700 - 30000 AND (bb.n0 + {BOSS_ROWS}) * 700)
SELECT CAST(f AS INT) AS run_id, enemy, min(coalesce(b, near)) - 1 AS boss FROM peaks WHERE coalesce(b, near) IS NOT NULL GROUP BY ALL""")
def boss_claims(ctx):
    """Enemies of boss fights: first engaged inside one, or as sturdy as its enemies and engaged in the 30 s before (all have one health here)."""
    hp = ctx.events.withColumn("subject", F.when(F.col("src_ours"), F.col("dst")).otherwise(F.col("src"))).withColumn("hp_max", F.lit(100).cast("long"))
    _, of = reports.segments(reports.Context(hp, ctx.runs, ctx.party, ctx.actors, ctx.spells, ctx.controls))
    return of.filter("boss IS NOT NULL").select("run_id", "enemy", F.col("boss").cast("long").alias("boss"))


@query(f"""{_SEGMENT} SELECT CAST(t.f AS INT) AS run_id, CAST(sum(net) AS DOUBLE) AS total FROM eff t JOIN side s ON s.f = t.f AND s.enemy = t.enemy WHERE action = 'click' GROUP BY t.f""")
def conservation(ctx):
    """What the segments hold, summed over them, is what the run holds: each enemy is in one segment, and none is lost."""
    parts = reports.segments(ctx)
    rows = reports.counted_rows(ctx, "done").join(parts[1].select("run_id", F.col("enemy").alias("dst"), "segment"), ["run_id", "dst"])
    return rows.groupBy("run_id", "segment").agg(F.sum("value").alias("part")).groupBy("run_id").agg(F.sum("part").alias("total"))


@query("""SELECT CAST(f AS INT) AS run_id, count(*) AS deaths, CAST(sum(ts) AS BIGINT) AS times, count(DISTINCT member) AS members FROM ev WHERE action = 'view' AND k % 25 = 1 GROUP BY f""")
def deaths(ctx):
    """M1: deaths of members."""
    return death_plan.deaths(ctx).groupBy("run_id").agg(F.count("*").alias("deaths"), F.sum("ts").alias("times"), F.countDistinct("dst").alias("members"))


@query("""SELECT CAST(d.f AS INT) AS run_id, d.member AS dst, d.ts, CAST(coalesce(sum(e.net) FILTER (e.action = 'view' AND e.member = d.member), 0) AS DOUBLE) AS taken, CAST(coalesce(sum(e.net) FILTER (e.action = 'purchase' AND e.other = d.member), 0) AS DOUBLE) AS healed,
CAST(arg_max(e.spell, (CASE WHEN e.waste > 0 THEN 1 ELSE 0 END, e.n)) FILTER (e.action = 'view' AND e.member = d.member) AS BIGINT) AS blow
FROM eff d JOIN eff e ON e.f = d.f AND e.n <= d.n AND e.ts >= d.ts - 10000 WHERE d.action = 'view' AND d.k % 25 = 1 GROUP BY d.f, d.member, d.ts""")
def death_totals(ctx):
    """M2, M4, M6: the ten seconds before each death, and the killing blow."""
    dead = death_plan.deaths(ctx)
    t = death_plan.recap(ctx, dead, reports.LOOKBACK_MS).totals()
    return dead.join(t.withColumnRenamed("anchor", "row"), ["run_id", "row"]).select("run_id", "dst", "ts", "taken", "healed", F.col("blow.spell_id").alias("blow"))


@query("""SELECT CAST(d.f AS INT) AS run_id, d.member AS dst, d.ts, CAST(e.spell AS BIGINT) AS spell_id, CAST(sum(e.net) AS DOUBLE) AS total, count(*) AS hits FROM eff d JOIN eff e ON e.f = d.f AND e.n <= d.n AND e.ts >= d.ts - 10000 AND e.action = 'view' AND e.member = d.member
WHERE d.action = 'view' AND d.k % 25 = 1 GROUP BY d.f, d.member, d.ts, e.spell""")
def death_abilities(ctx):
    """M7: what hit each victim, by spell."""
    dead = death_plan.deaths(ctx)
    return dead.select("run_id", F.col("row").alias("anchor"), "dst", "ts").join(death_plan.recap(ctx, dead).by_ability(), ["run_id", "anchor"]).select("run_id", "dst", "ts", "spell_id", "total", "hits")


@query("""SELECT CAST(d.f AS INT) AS run_id, d.member AS dst, d.ts, count(*) AS samples, CAST(min(e.k + 1) AS BIGINT) AS least FROM ev d JOIN ev e ON e.f = d.f AND e.n <= d.n AND e.ts >= d.ts - 30000
AND ((e.action = 'click' AND e.member = d.member) OR (e.action = 'purchase' AND e.other = d.member)) WHERE d.action = 'view' AND d.k % 25 = 1 GROUP BY ALL""")
def death_trace(ctx):
    """M3: the health of each victim in the thirty seconds before."""
    dead = death_plan.deaths(ctx)
    g = death_plan.recap(ctx, dead).trace().groupBy("run_id", F.col("anchor").alias("row")).agg(F.count("*").alias("samples"), F.min("hp").alias("least"))
    return dead.join(g, ["run_id", "row"]).select("run_id", "dst", "ts", "samples", "least")


_CC = """, app AS (SELECT *, lead(ts) OVER (PARTITION BY f, enemy, spell ORDER BY n) AS nx, lead(action) OVER (PARTITION BY f, enemy, spell ORDER BY n) AS na FROM ev WHERE action IN ('signup', 'error') AND k % 2 = 0 AND spell IN (100, 102, 104)),
ons AS (SELECT *, nx - ts AS ms FROM app WHERE action = 'signup'), longest AS (SELECT f, spell, max(ms) AS top FROM ons GROUP BY f, spell),
lim AS (SELECT spell, max(ms) AS top FROM ons GROUP BY spell)"""


@query(f"""{_CC} SELECT CAST(f AS INT) AS run_id, member AS actor, enemy AS dst, ts, CAST(coalesce(ms, CASE WHEN top IS NULL THEN 0 ELSE least((SELECT max(ts) FROM ev e WHERE e.f = ons.f), ts + top) - ts END) AS BIGINT) AS ms,
CASE na WHEN 'signup' THEN 'refreshed' WHEN 'error' THEN 'removed' ELSE 'open' END AS ended FROM ons LEFT JOIN (SELECT f AS lf, spell AS ls, top FROM longest) ON lf = f AND ls = spell""")
def crowd_control(ctx):
    """Controls with how long they held and what ended them."""
    kinds = _dim(ctx, [(100, 4), (102, 4), (104, 8)], "spell_id long, mask int")
    return reports.crowd_control(ctx, kinds).select("run_id", "actor", "dst", "ts", "ms", "ended")


_KICK = """, press AS (SELECT * FROM ev WHERE action = 'signup' AND k % 2 = 1), win AS (SELECT f, enemy, ts AS s, least(coalesce(lead(ts) OVER (PARTITION BY f, enemy ORDER BY n), ts + 10000), ts + 10000) AS e, n FROM ev WHERE action = 'error' AND k % 2 = 1)"""


@query(f"""{_KICK}, judged AS (SELECT p.f, p.member, p.enemy, p.ts, bool_or(p.ts BETWEEN s AND e) AS inn, bool_or(e < p.ts AND e >= p.ts - 1000) AS late, bool_or(s > p.ts AND s <= p.ts + 1000) AS early FROM press p LEFT JOIN win w ON w.f = p.f AND w.enemy = p.enemy GROUP BY ALL)
SELECT CAST(f AS INT) AS run_id, member AS actor, ts, CASE WHEN inn THEN 'ignored' WHEN late THEN 'late' WHEN early THEN 'early' ELSE 'nothing' END AS outcome FROM judged""")
def interrupts(ctx):
    """Attempts to stop casts, judged by the target's casts."""
    return reports.interrupts(ctx, _dim(ctx, [(61,)], "spell_id long")).select("run_id", "actor", "ts", "outcome")


@query("""SELECT CAST(f AS INT) AS run_id, member AS actor, CAST(spell AS BIGINT) AS spell_id, ts, waste > 0 AS fatal FROM hit WHERE action = 'view' AND spell IN (101, 103)""")
def avoidable(ctx):
    """V1, V5: hits of listed abilities on members."""
    return reports.avoidable(ctx, _dim(ctx, [(101,), (103,)], "spell_id long")).select("run_id", "actor", "spell_id", "ts", "fatal")


@query("""SELECT CAST(f AS INT) AS run_id, member AS actor, count(*) AS hits, CAST(sum(amount) AS DOUBLE) AS amount, count(*) FILTER (waste > 0) AS fatal FROM hit WHERE action = 'view' AND spell IN (101, 103) GROUP BY ALL""")
def avoidable_members(ctx):
    """V6: avoidable hits per member."""
    return reports.avoidable_summary(ctx, reports.avoidable(ctx, _dim(ctx, [(101,), (103,)], "spell_id long")))[0]


@query("""SELECT CAST(f AS INT) AS run_id, member AS actor, CAST(max(amount) AS DOUBLE) AS best FROM ev WHERE action = 'click' GROUP BY ALL""")
def biggest_hits(ctx):
    """T4: each member's biggest gross hit."""
    return moments.biggest_hits(ctx).select("run_id", F.col("src_root").alias("actor"), "best")


@query("""SELECT CAST(f AS INT) AS run_id, member AS actor, CAST(sum(amount) AS DOUBLE) AS healing, CAST(sum(greatest(waste, 0)) AS BIGINT) AS overhealing FROM hit WHERE action = 'purchase' AND member <> other GROUP BY ALL""")
def healing_on_others(ctx):
    """Healing of other members."""
    return moments.healing_on_others(ctx).withColumn("overhealing", F.col("overhealing").cast("long"))


_POS = """, pos AS (SELECT f, n, ts, CASE WHEN action = 'purchase' THEN other ELSE member END AS actor, k + 0.5 AS x, n % 40 + 0.25 AS y, k % 2 + 1 AS map, least(100, k + 1) AS pct FROM ev WHERE action IN ('click', 'purchase'))"""


@query(f"""{_POS} SELECT CAST(f AS INT) AS run_id, actor, count(*) AS n, CAST(round(sum(x), 2) AS DOUBLE) AS xs FROM pos GROUP BY ALL""")
def position_tracks(ctx):
    """Samples of members (700 ms apart at least, so all are kept)."""
    return map_plan.tracks(ctx).groupBy("run_id", "actor").agg(F.count("*").alias("n"), F.round(F.sum("x"), 2).alias("xs"))


@query(f"""{_POS} SELECT CAST(f AS INT) AS run_id, actor, CAST(coalesce(arg_min(x, n) FILTER (pct = 100 AND n < coalesce(hurt, 1e18)), arg_min(x, n)) AS DOUBLE) AS x FROM (SELECT *, min(n) FILTER (pct < 100) OVER (PARTITION BY f, actor) AS hurt FROM pos) GROUP BY f, actor""")
def homes(ctx):
    """Where each member stood before anything hurt them."""
    return map_plan.homes(map_plan.tracks(ctx)).select("run_id", "actor", "x")


@query(f"""{_POS} SELECT CAST(f AS INT) AS run_id, actor, round(sum(CASE WHEN map = pm AND NOT (d > 50 AND d > 30 * dt) THEN d ELSE 0 END), 6) AS yards FROM (
SELECT *, lag(map) OVER w AS pm, sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2) AS d, (ts - lag(ts) OVER w) / 1000.0 AS dt FROM pos WINDOW w AS (PARTITION BY f, actor ORDER BY n)) GROUP BY ALL""")
def distance(ctx):
    """Way travelled on one map, teleports left out."""
    return reports.distance(map_plan.tracks(ctx))


@query(f"""{_POS}, fl AS (SELECT f, map, min(ts) AS first FROM pos GROUP BY ALL) SELECT CAST(f AS INT) AS run_id, CAST(map AS INT) AS map, CAST(row_number() OVER (PARTITION BY f ORDER BY first, map) AS INT) AS floor, CASE map WHEN 2 THEN 'Loft' ELSE 'Map 1' END AS label FROM fl""")
def floors(ctx):
    """Maps with samples, in order of first use."""
    return map_plan.floors(ctx, map_plan.samples(ctx)).select("run_id", F.col("map").cast("int").alias("map"), "floor", "label")


@query("""SELECT CAST(f AS INT) AS run_id, member AS actor, count(*) AS presses FROM ev WHERE action = 'signup' AND k % 2 = 1 GROUP BY ALL""")
def presses(ctx):
    """K1, K2: presses (700 ms apart at least, beyond any proc)."""
    dim = _dim(ctx, [(61, 1500, None, True)], "spell_id long, gcd_ms long, channel_ms long, button boolean")
    return casting.casting_report(casting.casting(ctx, dim)).select("run_id", "actor", "presses")


@query("""SELECT CASE action WHEN 'click' THEN 'SPELL_DAMAGE' WHEN 'view' THEN 'SPELL_DAMAGE' WHEN 'purchase' THEN 'SPELL_HEAL' END AS name, true AS known, count(*) AS n FROM ev WHERE action IN ('click', 'view', 'purchase') GROUP BY ALL""")
def width_drift(ctx):
    """P25: how often each event name comes, and whether it is known."""
    spark = ctx.events.sparkSession
    at = next(at for _, at, c in _OPEN.values() if c is ctx)
    drift = log.width_drift(log.tokens(spark.read.parquet(f"{at}/lines")))
    return drift.filter("name IN ('SPELL_DAMAGE', 'SPELL_HEAL')").groupBy("name", "known").agg(F.sum("n").alias("n"))


@query(f"""{_KICK}, judged AS (SELECT p.f, p.member, p.n, bool_or(p.ts BETWEEN s AND e) AS inn, bool_or(e < p.ts AND e >= p.ts - 1000) AS late, bool_or(s > p.ts AND s <= p.ts + 1000) AS early FROM press p LEFT JOIN win w ON w.f = p.f AND w.enemy = p.enemy GROUP BY ALL)
SELECT CAST(f AS INT) AS run_id, member AS actor, count(*) AS casts, count(*) FILTER (inn) AS ignored, count(*) FILTER (NOT coalesce(inn, false) AND late) AS late, count(*) FILTER (NOT coalesce(inn, false) AND NOT coalesce(late, false) AND NOT coalesce(early, false)) AS nothing FROM judged GROUP BY ALL""")
def interrupt_summary(ctx):
    """Attempts and outcomes per member."""
    return reports.interrupt_summary(reports.interrupts(ctx, _dim(ctx, [(61,)], "spell_id long"))).select("run_id", "actor", "casts", "ignored", "late", "nothing")


@query(f"""{_CC} SELECT CAST(f AS INT) AS run_id, member AS actor, count(*) AS targets, CAST(bit_or(CASE WHEN spell = 104 THEN 8 ELSE 4 END) AS INT) AS kinds FROM ons GROUP BY ALL""")
def control_summary(ctx):
    """Controls and their kinds per member."""
    kinds = _dim(ctx, [(100, 4), (102, 4), (104, 8)], "spell_id long, mask int")
    return reports.control_summary(reports.crowd_control(ctx, kinds)).select("run_id", "actor", "targets", "kinds")


@query("""SELECT CAST(f AS INT) AS run_id, guid, role, CAST(row_number() OVER (PARTITION BY f ORDER BY CASE role WHEN 'tank' THEN 0 WHEN 'healer' THEN 1 ELSE 2 END, m) AS INT) AS shown_at
FROM (SELECT f, m, 'Player-1-' || lpad(CAST(m AS VARCHAR), 4, '0') AS guid, ['dps', 'healer', 'tank', 'dps', 'dps'][m + 1] AS role FROM (SELECT DISTINCT f FROM ev), range(5) t(m))""")
def party_order(ctx):
    """The party as it is shown."""
    return views.party_order(ctx.party).select("run_id", "guid", "role", "shown_at")


@query(f"""{_DONE} SELECT CAST(f AS INT) AS run_id, actor, CAST(spell AS BIGINT) AS spell_id, round(total / hits, 6) AS per_hit, round(crits / hits, 6) AS crit_share FROM done""")
def rates(ctx):
    """Derived columns of a breakdown."""
    return reports.rates(reports.breakdown(ctx)).select("run_id", "actor", "spell_id", "per_hit", "crit_share")


_ABILITY = ", names AS (SELECT spell, arg_min(k % 4, (f, n)) AS name FROM ev WHERE action IN ('click', 'purchase', 'view', 'error') OR k % 2 = 0 GROUP BY spell)"


@query(f"""{_DONE.rstrip()} {_ABILITY} SELECT CAST(f AS INT) AS run_id, actor, 'Spell ' || name AS ability, CAST(sum(total) AS DOUBLE) AS total, CAST(sum(hits) AS BIGINT) AS hits, CAST(max(biggest) AS DOUBLE) AS biggest, count(*) AS parts FROM done JOIN names USING (spell) GROUP BY ALL""")
def abilities(ctx):
    """Spells of one ability together, named as first seen."""
    return views.by_ability(reports.breakdown(ctx)).select("run_id", "actor", "ability", "total", "hits", "biggest", "parts")


@query("""SELECT CAST(d.f AS INT) AS run_id, d.member AS dst, d.ts, CAST(e.spell AS BIGINT) AS spell_id, e.member AS source, CAST(sum(e.net) AS DOUBLE) AS net, count(*) AS times FROM eff d JOIN eff e ON e.f = d.f AND e.n <= d.n AND e.ts >= d.ts - 10000 AND e.action = 'purchase' AND e.other = d.member
WHERE d.action = 'view' AND d.k % 25 = 1 GROUP BY d.f, d.member, d.ts, e.spell, e.member""")
def death_healing(ctx):
    """Healing on each victim in the last ten seconds by spell and healer."""
    dead = death_plan.deaths(ctx)
    got = death_plan.healing_in(death_plan.recap(ctx, dead), 10_000).withColumnRenamed("anchor", "row")
    return dead.join(got, ["run_id", "row"]).select("run_id", "dst", "ts", "spell_id", "source", "net", "times")


@query("""SELECT CAST(d.f AS INT) AS run_id, d.member AS dst, d.ts, CAST(floor((e.ts - (d.ts - 30000)) / 1000.0) AS BIGINT) AS bucket, CAST(e.spell AS BIGINT) AS spell_id, CAST(sum(e.net) AS DOUBLE) AS net FROM eff d JOIN eff e ON e.f = d.f AND e.n <= d.n AND e.ts >= d.ts - 30000 AND e.action = 'view' AND e.member = d.member
WHERE d.action = 'view' AND d.k % 25 = 1 GROUP BY ALL""")
def death_buckets(ctx):
    """Damage before each death in steps of a second."""
    dead = death_plan.deaths(ctx)
    bars = death_plan.recap(ctx, dead).buckets(1000).filter("spell_id IS NOT NULL").withColumnRenamed("anchor", "row")
    return dead.join(bars, ["run_id", "row"]).select("run_id", "dst", "ts", "bucket", "spell_id", "net")


@query("""SELECT CAST(f AS INT) AS run_id, member AS dst, ts, CAST(row_number() OVER (PARTITION BY f, member ORDER BY n) AS INT) AS nth, ts - lag(ts) OVER (PARTITION BY f ORDER BY n) AS since_previous,
CAST((SELECT count(DISTINCT e.member) FROM ev e WHERE e.f = d.f AND e.n <= d.n AND e.action = 'view' AND e.k % 25 = 1) AS INT) AS dead_at_once FROM ev d WHERE action = 'view' AND k % 25 = 1""")
def death_anchors(ctx):
    """M1: deaths numbered, the time since the last one, and how many are down (nobody is raised in this log)."""
    return death_plan.deaths(ctx).select("run_id", "dst", "ts", "nth", "since_previous", F.col("dead_at_once").cast("int").alias("dead_at_once"))


@query("""SELECT CAST(f AS INT) AS run_id, actor, value FROM (SELECT f, member AS actor, CAST(sum(net) AS DOUBLE) AS value, rank() OVER (PARTITION BY f ORDER BY sum(net) DESC) AS r, count(*) OVER (PARTITION BY f) AS c FROM eff WHERE action = 'click' GROUP BY f, member) WHERE r = 1 AND c >= 2""")
def badge_pumper(ctx):
    """Who holds the badge for most damage."""
    parts = badges.measured(ctx, {"damage": reports.breakdown(ctx)})
    held = moments.badges(badges.values({"pumper": parts["pumper"]}, ctx.party), badges.metrics(ctx.events.sparkSession))
    return held.select("run_id", "actor", "value")


@query(f"""{_POS}, probe AS (SELECT f, actor, n, ts + 1000 AS at FROM pos WHERE n % 10 = 3), seen AS (SELECT p.f, p.actor, p.at, max(s.n) AS last FROM probe p JOIN pos s ON s.f = p.f AND s.actor = p.actor AND s.ts <= p.at GROUP BY ALL)
SELECT CAST(seen.f AS INT) AS run_id, seen.actor, seen.at AS ts, CAST(pos.x AS DOUBLE) AS x, CAST(pos.map AS INT) AS map FROM seen JOIN pos ON pos.f = seen.f AND pos.actor = seen.actor AND pos.n = seen.last""")
def replay(ctx):
    """Where each member was last seen, a second after some samples."""
    rows = map_plan.samples(ctx)
    probes = rows.filter(F.col("ts") % (10 * STEP_MS) == 3 * STEP_MS).select("run_id", "actor", (F.col("ts") + 1000).alias("ts"))
    return map_plan.replay(probes, rows, map_plan.track_deaths(ctx)).select("run_id", "actor", "ts", "x", F.col("map").cast("int").alias("map"))


_SPAN = """, st AS (SELECT f, enemy, spell, member, n, ts, action = 'signup' AS up FROM ev WHERE action IN ('signup', 'error') AND k % 2 = 0),
ghost AS (SELECT f, enemy, spell, arg_min(member, n) AS member, 0 AS n, 0 AS ts, true AS up FROM st GROUP BY f, enemy, spell HAVING NOT arg_min(up, n)),
al AS (SELECT *, coalesce(lag(up) OVER (PARTITION BY f, enemy, spell, member ORDER BY n), false) AS was FROM (FROM st UNION ALL FROM ghost)),
lv AS (SELECT *, sum(CASE WHEN up THEN 1 ELSE -1 END) OVER (PARTITION BY f, enemy, spell ORDER BY n) AS c, coalesce(lead(ts) OVER (PARTITION BY f, enemy, spell ORDER BY n), (SELECT max(n) + 1 FROM ev e WHERE e.f = al.f) * 700) AS nx FROM al WHERE up <> was)"""


@query(f"""{_SPAN} SELECT CAST(f AS INT) AS run_id, enemy AS wearer, CAST(spell AS BIGINT) AS spell_id, CAST(sum(CASE WHEN c > 0 THEN nx - ts ELSE 0 END) AS BIGINT) AS up FROM lv GROUP BY ALL HAVING up > 0""")
def aura_spans(ctx):
    """Time with a state on each enemy over all casters; a state first seen going was up from the start."""
    return reports.aura_spans(ctx).filter("spell_id <> 31").groupBy("run_id", "wearer", "spell_id").agg(F.sum(F.col("end") - F.col("start")).alias("up"))
