"""Queries of the dimension rules over the driver's tables, each through its operator in ``sources.dimensions``."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from millrace.session import table
from millrace.sources import dimensions as dim

QUERIES, SQL = {}, {}


def query(*tables: str, sql: str):
    def add(f):
        QUERIES[f"dim_{f.__name__}"] = lambda spark, sf_dir: f(*(table(spark, sf_dir, t) for t in tables))
        SQL[f"dim_{f.__name__}"] = sql
        return f

    return add


#: Lines as effects: a spell (order) has an effect (the line number) per line of some parts.
_EFFECTS = "SELECT l_orderkey AS spell_id, l_linenumber AS effect FROM lineitem WHERE l_partkey % 3 = 0"


def _effects(l: DataFrame) -> DataFrame:
    return l.filter("l_partkey % 3 = 0").select(F.col("l_orderkey").alias("spell_id"), F.col("l_linenumber").cast("long").alias("effect"))


def _ids(df: DataFrame, values: list[int], name: str = "effect") -> DataFrame:
    return df.sparkSession.createDataFrame([(v,) for v in values], f"{name} long")


@query("lineitem", sql=f"SELECT spell_id, CAST(bit_or(CASE effect WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 2 WHEN 5 THEN 8 END) AS BIGINT) AS bits FROM ({_EFFECTS}) WHERE effect IN (1, 2, 3, 5) GROUP BY spell_id")
def effect_bits(l):
    """Kinds of a spell's effects, or-ed."""
    rules = l.sparkSession.createDataFrame([(1, 1), (2, 2), (3, 2), (5, 8)], "effect long, bit long")
    return dim.effect_bits(_effects(l), rules)


@query("lineitem", sql=f"SELECT spell_id FROM ({_EFFECTS}) GROUP BY spell_id HAVING bool_or(effect = 1) AND bool_and(effect IN (1, 2, 3, 4))")
def dedicated(l):
    """Spells with a wanted effect and otherwise ignored ones alone."""
    return dim.dedicated(_effects(l), _ids(l, [1]), _ids(l, [2, 3, 4]))


@query("lineitem", sql=f"SELECT DISTINCT spell_id FROM ({_EFFECTS}) EXCEPT SELECT spell_id FROM ({_EFFECTS}) WHERE effect NOT IN (1, 2, 3)")
def inert(l):
    """Spells all of whose effects do nothing."""
    return dim.inert(_effects(l), _ids(l, [1, 2, 3]))


@query("part", "lineitem", sql="""
WITH aura AS (SELECT DISTINCT l_orderkey AS passive, l_partkey AS spell_id FROM lineitem WHERE l_linenumber <= 2),
clear AS (SELECT passive, any_value(spell_id) AS spell_id FROM aura GROUP BY passive HAVING count(*) = 1)
SELECT spell_id, min(passive) AS passive, arg_min(p_size, passive) AS rate FROM clear JOIN part ON p_partkey = passive % 7 + 1 GROUP BY spell_id""")
def proc_rates(p, l):
    """Four tables joined; ambiguous passives out, the lowest id wins."""
    auras = l.filter("l_linenumber <= 2").select(F.col("l_orderkey").alias("passive"), F.col("l_partkey").alias("spell_id"))
    passives = auras.select("passive").distinct().withColumn("rate_id", F.col("passive") % 7 + 1)
    return dim.proc_rates(passives, auras, p.select(F.col("p_partkey").alias("rate_id"), F.col("p_size").alias("rate")))


_TREE = "tree AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE o_orderkey // 3 END AS parent, o_custkey AS amount FROM orders)"


def _tree(o: DataFrame) -> DataFrame:
    parent = F.when(F.col("o_orderkey") % 5 == 0, 0).otherwise(F.floor(F.col("o_orderkey") / 3)).cast("long")
    return o.select(F.col("o_orderkey").alias("id"), parent.alias("parent"), F.col("o_custkey").alias("amount"))


@query("orders", sql=f"""
WITH RECURSIVE {_TREE}, below AS (SELECT id AS root, id, 0 AS level, amount FROM tree WHERE parent = 0 UNION ALL SELECT root, t.id, level + 1, t.amount FROM below b JOIN tree t ON t.parent = b.id WHERE level < 4)
SELECT root, id, level, amount FROM below WHERE level > 0""")
def descendants(o):
    """Nodes up to four levels below each root."""
    tree = _tree(o)
    return dim.descendants(tree, tree.filter("parent = 0").select(F.col("id").alias("root")), 4)


@query("orders", sql=f"""
WITH RECURSIVE {_TREE}, up AS (SELECT id, id AS root, 0 AS n FROM tree UNION ALL SELECT u.id, t.parent, n + 1 FROM up u JOIN tree t ON t.id = u.root WHERE t.parent <> 0 AND t.parent IN (SELECT id FROM tree) AND n < 12)
SELECT id, arg_max(root, n) AS root FROM up GROUP BY id""")
def root_of(o):
    """The topmost node above each."""
    return dim.root_of(_tree(o), 12)


@query("lineitem", sql="""
WITH v AS (SELECT l_suppkey % 20 AS mode_id, l_partkey % 50 AS npc_id, l_linenumber AS value FROM lineitem WHERE l_orderkey % 9 = 0), t AS (SELECT mode_id, max(value) * 100 AS total FROM v GROUP BY mode_id),
o AS (SELECT DISTINCT l_suppkey % 20 AS mode_id, l_partkey % 60 AS npc_id, l_linenumber AS value, 1 AS build, CASE WHEN l_suppkey % 2 = 0 THEN 700 ELSE 1 END AS total FROM lineitem WHERE l_orderkey % 9 = 1 AND l_linenumber = 2),
now AS (SELECT mode_id, npc_id, max(value) AS value FROM v GROUP BY ALL), back AS (SELECT mode_id, npc_id, max(value) AS value FROM o JOIN t USING (mode_id, total) WHERE (mode_id, npc_id) NOT IN (SELECT (mode_id, npc_id) FROM now) GROUP BY ALL)
SELECT CAST(mode_id AS BIGINT) AS mode_id, CAST(npc_id AS BIGINT) AS npc_id, CAST(value AS BIGINT) AS value, CAST(total AS BIGINT) AS total FROM (FROM now UNION ALL FROM back) JOIN t USING (mode_id)""")
def forces_table(l):
    """The union of variants with lost rows put back."""
    v = l.filter("l_orderkey % 9 = 0").select((F.col("l_suppkey") % 20).alias("mode_id"), (F.col("l_partkey") % 50).alias("npc_id"), F.col("l_linenumber").cast("long").alias("value"))
    v = v.join(v.groupBy("mode_id").agg((F.max("value") * 100).alias("total")), "mode_id")
    old = l.filter("l_orderkey % 9 = 1 AND l_linenumber = 2").select((F.col("l_suppkey") % 20).alias("mode_id"), (F.col("l_partkey") % 60).alias("npc_id"), F.col("l_linenumber").cast("long").alias("value"), F.lit(1).alias("build"), F.when(F.col("l_suppkey") % 2 == 0, 700).otherwise(1).cast("long").alias("total"))
    return dim.forces_table(v, old.distinct())


@query("lineitem", sql="WITH t AS (SELECT DISTINCT l_orderkey % 3 AS dungeon, l_partkey AS asset FROM lineitem WHERE l_orderkey % 16 = 0) SELECT dungeon, asset FROM t QUALIFY count(*) OVER (PARTITION BY asset) = 1")
def unique_assets(l):
    """Assets of one dungeon alone."""
    return dim.unique_assets(l.filter("l_orderkey % 16 = 0").select((F.col("l_orderkey") % 3).alias("dungeon"), F.col("l_partkey").alias("asset")).distinct())


@query("lineitem", sql="SELECT spell_id, arg_min(v, difficulty) AS v, min(difficulty) AS difficulty FROM (SELECT l_partkey AS spell_id, l_linenumber - 1 AS difficulty, min(l_orderkey) AS v FROM lineitem GROUP BY ALL) GROUP BY spell_id")
def by_difficulty(l):
    """One row per key, that of the lowest difficulty."""
    rows = l.groupBy(F.col("l_partkey").alias("spell_id"), (F.col("l_linenumber") - 1).alias("difficulty")).agg(F.min("l_orderkey").alias("v"))
    return dim.by_difficulty(rows, ["spell_id"])


@query("part", "supplier", sql="""
SELECT p_partkey AS spell_id, CASE WHEN n * 1000 > p_size * 900 THEN n * 1000 ELSE p_size * 900 END AS recovery_ms, CASE WHEN n * 1000 > p_size * 900 THEN greatest(n % 3, 1) ELSE 1 END AS charges
FROM part LEFT JOIN (SELECT s_suppkey AS c, s_nationkey AS n FROM supplier WHERE s_suppkey % 2 = 0) ON c = p_partkey % 13""")
def cooldowns(p, s):
    """Own recovery or the charge category's, whichever is longer."""
    own = p.select(F.col("p_partkey").alias("spell_id"), (F.col("p_size") * 900).alias("recovery_ms"), (F.col("p_partkey") % 13).alias("category_id"))
    pool = s.filter("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("category_id"), (F.col("s_nationkey") * 1000).alias("recovery_ms"), (F.col("s_nationkey") % 3).alias("charges"))
    return dim.cooldowns(own, pool)


@query("part", sql="""
SELECT p_partkey AS spell_id, round(CASE WHEN p_partkey % 3 = 0 THEN p_size / 10.0 ELSE 0 END * CASE WHEN p_partkey % 4 = 1 THEN 1.5 ELSE 1 END * CASE WHEN p_partkey % 5 = 2 THEN 0.8 * 1.1 ELSE 1 END, 6) AS per_minute FROM part""")
def procs_per_minute(p):
    """E5: the base rate times 1 + factor of every row of the class and the spec."""
    have = p.select(F.col("p_partkey").alias("spell_id"), (F.col("p_partkey") % 4).alias("class_id"), (F.col("p_partkey") % 5).alias("spec_id"))
    base = p.filter("p_partkey % 3 = 0").select(F.col("p_partkey").alias("spell_id"), (F.col("p_size") / 10).alias("rate"))
    factor = lambda kind, i, x: p.select(F.col("p_partkey").alias("spell_id"), F.lit(kind).alias("kind"), F.lit(i).cast("long").alias("id"), F.lit(x).alias("factor"))
    factors = factor("class", 1, 0.5).unionByName(factor("spec", 2, -0.2)).unionByName(factor("spec", 2, 0.1))
    return dim.procs_per_minute(have, base, factors).select("spell_id", F.round("per_minute", 6).alias("per_minute"))


@query("part", sql="SELECT p_partkey, p_partkey % 7 = 0 OR p_partkey > 150 AS button, CASE WHEN p_partkey % 7 = 0 THEN p_size ELSE 1500 END AS gcd_ms FROM part")
def buttons(p):
    """Listed ids, all above the frontier, and a valued dimension with its default."""
    listed = p.filter("p_partkey % 7 = 0").select("p_partkey")
    known = dim.buttons(p.select("p_partkey"), listed, "p_partkey", 150)
    return dim.valued(known, p.filter("p_partkey % 7 = 0").select("p_partkey", F.col("p_size").alias("gcd_ms")), "p_partkey", {"gcd_ms": 1500})


@query("customer", "nation", sql="""
SELECT c_custkey, round(0.5 * c_acctbal - 0.1 * c_custkey + n, 4) AS px, round(0.1 * c_acctbal + 0.5 * c_custkey - n, 4) AS py FROM customer LEFT JOIN (SELECT n_nationkey AS k, n_nationkey + 1.0 AS n FROM nation WHERE n_regionkey <> 2) ON k = c_nationkey""")
def on_planner(c, n):
    """Points on the planner's map by their floor's transform."""
    t = n.filter("n_regionkey <> 2").select(F.col("n_nationkey").alias("map"), F.lit(0.5).alias("re"), F.lit(0.1).alias("im"), (F.col("n_nationkey") + 1.0).alias("dx"), (-(F.col("n_nationkey") + 1.0)).alias("dy"))
    out = dim.on_planner(c.select("c_custkey", F.col("c_nationkey").alias("map"), F.col("c_acctbal").cast("double").alias("x"), F.col("c_custkey").cast("double").alias("y")), t, ["map"])
    return out.select("c_custkey", F.round("px", 4).alias("px"), F.round("py", 4).alias("py"))


@query("part", sql="SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN p_size ELSE -p_size END AS value FROM part WHERE p_partkey % 2 = 0 OR p_partkey % 3 = 0")
def first_wins(p):
    """Tables merged, the earliest one's row stays."""
    a, b = p.filter("p_partkey % 2 = 0").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("value")), p.filter("p_partkey % 3 = 0").select(F.col("p_partkey").alias("id"), (-F.col("p_size")).alias("value"))
    return dim.first_wins([a, b], ["id"])


@query("part", sql="SELECT p_partkey, p_partkey % 4 = 0 AS expected FROM part WHERE (p_partkey % 4 = 0) <> (p_partkey % 2 = 0 AND p_size > 5)")
def broken_witnesses(p):
    """Known ids that must be in or out of a table, and are not."""
    return dim.broken_witnesses(p.filter("p_partkey % 2 = 0 AND p_size > 5").select("p_partkey"), p.select("p_partkey", (F.col("p_partkey") % 4 == 0).alias("expected")), "p_partkey")


@query("orders", sql="""
WITH a AS (SELECT o_custkey % 50 AS c, o_orderstatus AS s FROM orders WHERE o_orderkey % 3 <> 0), b AS (SELECT o_custkey % 50 AS c, o_orderstatus AS s FROM orders WHERE o_orderkey % 3 <> 1)
SELECT *, 'lost' AS side FROM (FROM a EXCEPT ALL FROM b) UNION ALL SELECT *, 'gained' AS side FROM (FROM b EXCEPT ALL FROM a)""")
def drift(o):
    """Rows that only one of two builds has."""
    part = lambda k: o.filter(f"o_orderkey % 3 <> {k}").select((F.col("o_custkey") % 50).alias("c"), F.col("o_orderstatus").alias("s"))
    return dim.drift(part(0), part(1))


@query("orders", sql="""
WITH r AS (SELECT o_orderkey AS run_id, o_custkey % 5 AS level, o_orderkey * 40000 AS s FROM orders WHERE o_orderkey % 3 = 1),
f AS (SELECT o_orderkey AS fight, o_custkey % 5 AS level, o_orderkey * 40000 + o_orderkey % 7 * 20000 AS s FROM orders WHERE o_orderkey % 2 = 0)
SELECT run_id, arg_min(fight, (abs(f.s - r.s), fight)) AS fight FROM r JOIN f ON r.level = f.level AND abs(f.s - r.s) <= 120000 AND f.s <= r.s + 90000 AND f.s + 90000 >= r.s GROUP BY run_id""")
def matched_fights(o):
    """E19 without its network: runs matched with remote fights by level and time."""
    at, late = F.col("o_orderkey") * 40_000, F.col("o_orderkey") * 40_000 + F.col("o_orderkey") % 7 * 20_000
    frame = lambda c, name, s: o.filter(c).select(F.col("o_orderkey").alias(name), (F.col("o_custkey") % 5).alias("level"), s.alias("start_ms"), (s + 90_000).alias("end_ms"))
    return dim.matched_fights(frame("o_orderkey % 3 = 1", "run_id", at), frame("o_orderkey % 2 = 0", "fight", late))
