"""Queries over the driver's other tables: transfers, rankings, text, dimensions and ETL."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window as W

from millrace.functions import text as tx, times
from millrace.operators import attribution, ranking, sessions
from millrace.session import table
from millrace.sources import dimensions

QUERIES, SQL = {}, {}


def query(*tables: str, sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(*(table(spark, sf_dir, t) for t in tables))
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("supplier", "nation", "region", sql="""
SELECT r.r_name AS root, count(*) AS suppliers, round(sum(s_acctbal), 2) AS total FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region r ON n_regionkey = r_regionkey GROUP BY r.r_name""")
def owner_rollup(s, n, r):
    """Totals rolled up along owner links of up to four hops."""
    node = lambda kind, key: F.concat(F.lit(kind), key.cast("string"))
    links = s.select(node("s", F.col("s_suppkey")).alias("id"), node("n", F.col("s_nationkey")).alias("owner"))
    links = links.unionByName(n.select(node("n", F.col("n_nationkey")).alias("id"), node("r", F.col("n_regionkey")).alias("owner"))).unionByName(r.select(node("r", F.col("r_regionkey")).alias("id"), F.lit(None).cast("string").alias("owner")))
    roots = attribution.attribute_owner(links, "id", "owner")
    own = s.select(node("s", F.col("s_suppkey")).alias("id"), "s_acctbal").join(roots, "id")
    names = r.select(node("r", F.col("r_regionkey")).alias("root_id"), F.col("r_name").alias("root"))
    return own.join(names, own["root"] == names["root_id"]).groupBy(names["root"]).agg(F.count("*").alias("suppliers"), F.round(F.sum("s_acctbal"), 2).alias("total"))


_MOVE = """SELECT l_orderkey, l_linenumber, CAST(round(l_extendedprice * 100) AS BIGINT) AS want, CAST(round(o_totalprice * 50) AS BIGINT) AS cap FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_extendedprice > 0"""


@query("lineitem", "orders", sql=f"""
SELECT l_orderkey, l_linenumber, want, CAST(least(want, greatest(cap - before, 0)) AS BIGINT) AS moved FROM (
  SELECT *, coalesce(sum(want) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, want ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM ({_MOVE}))""")
def capped_transfer(l, o):
    """Credit moved in order until the carrier's total is spent."""
    want = l.select("l_orderkey", "l_linenumber", F.round(F.col("l_extendedprice") * 100).cast("long").alias("want"))
    caps = o.select(F.col("o_orderkey").alias("l_orderkey"), F.round(F.col("o_totalprice") * 50).cast("long").alias("cap"))
    return attribution.capped_transfer(want, caps, ["l_orderkey"], ["l_linenumber", "want"], "want", "cap").select("l_orderkey", "l_linenumber", "want", "moved")


@query("lineitem", sql="""
SELECT g.l_suppkey, round(g.gain - coalesce(d.loss, 0), 2) AS net FROM (SELECT l_suppkey, sum(l_extendedprice) AS gain FROM lineitem WHERE l_returnflag <> 'R' GROUP BY l_suppkey) g
LEFT JOIN (SELECT l_suppkey, sum(l_extendedprice) AS loss FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_suppkey) d USING (l_suppkey)""")
def netting(l):
    """Gains less the losses of the same key."""
    part = lambda c, name: l.filter(c).groupBy("l_suppkey").agg(F.sum("l_extendedprice").alias(name))
    return attribution.netted(part("l_returnflag <> 'R'", "gain"), part("l_returnflag = 'R'", "loss"), ["l_suppkey"], "gain", "loss").select("l_suppkey", F.round("net", 2).alias("net"))


# summed in whole cents: a sum of doubles depends on the rows' order, and so does the side to which a half is rounded
_PARTY = "p AS (SELECT c_nationkey AS party, o_custkey AS member, CAST(round(sum(CAST(round(o_totalprice * 100) AS BIGINT)) / 100) AS BIGINT) AS v, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)"


def _party(o, c):
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    return o.join(c, o["o_custkey"] == c["c_custkey"]).groupBy(F.col("c_nationkey").alias("party"), F.col("o_custkey").alias("member")).agg(F.round(F.sum(cents) / 100).cast("long").alias("v"), F.count("*").alias("n"))


@query("orders", "customer", sql=f"WITH {_PARTY} SELECT party, member, v, CAST((SELECT count(*) FROM p q WHERE q.party = p.party AND q.v < p.v) + 1 AS BIGINT) * CASE WHEN v > 0 THEN 1 ELSE 0 END AS points FROM p")
def rank_points(o, c):
    """One point more than members beaten."""
    return ranking.rank_points(_party(o, c), ["party"], "v").select("party", "member", "v", "points")


@query("orders", "customer", sql=f"""WITH {_PARTY}, t AS (SELECT *, max(n) OVER (PARTITION BY party) AS top, count(*) OVER (PARTITION BY party) AS size FROM p),
h AS (SELECT *, count(*) OVER (PARTITION BY party) AS ties FROM t WHERE n = top AND size >= 2) SELECT party, member, n FROM h WHERE 2 * ties <= size AND top > 0""")
def leaders(o, c):
    """Who holds the party's best value."""
    return ranking.leaders(_party(o, c), ["party"], "n").select("party", "member", "n")


@query("orders", "customer", sql=f"WITH {_PARTY} SELECT party, member, CAST(CASE WHEN v > 1000 AND m > 1000 THEN floor(10 * ((v - 1000.0) / (m - 1000.0)) + 0.5) ELSE 0 END AS BIGINT) AS points FROM (SELECT *, max(v) OVER (PARTITION BY party) AS m FROM p)")
def share_points(o, c):
    """Points by share of the best above a floor."""
    return ranking.share_points(_party(o, c), ["party"], "v", 10, 1000.0).select("party", "member", "points")


@query("orders", "customer", sql=f"""WITH {_PARTY}, q AS (SELECT *, max(v) OVER (PARTITION BY party) AS m, rank() OVER (PARTITION BY party ORDER BY v DESC) AS place FROM p)
SELECT party, member, CAST(CASE WHEN v > 0 THEN greatest(floor(10 * (v / m::DOUBLE) + 0.5), 10 - 2 * (place - 1), 0) ELSE 0 END AS BIGINT) AS points FROM q""")
def stepped_points(o, c):
    """Shared points with a floor that steps down by place."""
    return ranking.stepped_points(_party(o, c), ["party"], "v", 10, 2).select("party", "member", "points")


@query("orders", "customer", sql=f"""WITH {_PARTY}, pts AS (
  SELECT party, member, ((SELECT count(*) FROM p q WHERE q.party = p.party AND q.v < p.v) + 1) * CASE WHEN v > 0 THEN 1 ELSE 0 END + (SELECT count(*) FROM p q WHERE q.party = p.party AND q.n < p.n) + 1 AS total FROM p)
SELECT party, member, CAST(total AS BIGINT) AS total, CAST(rank() OVER (PARTITION BY party ORDER BY total DESC) AS INT) AS place FROM pts""")
def mvp_standings(o, c):
    """Places by the sum of points over categories."""
    p = _party(o, c)
    both = ranking.rank_points(p, ["party"], "v").select("party", "member", "points").unionByName(ranking.rank_points(p, ["party"], "n").select("party", "member", "points"))
    return ranking.standings(both, ["party"], "member")


@query("orders", "customer", sql=f"""WITH {_PARTY}, r AS (SELECT *, row_number() OVER (PARTITION BY party ORDER BY v DESC) AS k FROM p)
SELECT party, CAST(max(v) FILTER (k = 1) AS DOUBLE) AS best, CAST(coalesce(max(v) FILTER (k = 2), 0) AS DOUBLE) AS second, max(v) FILTER (k = 1) >= 1.2 * coalesce(max(v) FILTER (k = 2), 0) AS runaway FROM r GROUP BY party""")
def gap_titles(o, c):
    """Leaders far ahead of the runner-up."""
    return ranking.gap_title(_party(o, c).withColumn("v", F.col("v").cast("double")), ["party"], "v", 1.2)


@query("embeddings", sql="""
SELECT label, round(sum(CASE WHEN d <= 1.5 THEN d ELSE 0 END), 4) AS travelled FROM (
  SELECT label, sqrt((x - lag(x) OVER w) * (x - lag(x) OVER w) + (y - lag(y) OVER w) * (y - lag(y) OVER w)) AS d
  FROM (SELECT vec_id, label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings) WINDOW w AS (PARTITION BY label ORDER BY vec_id)) GROUP BY label""")
def distance_travelled(e):
    """Summed steps, without jumps."""
    w = W.partitionBy("label").orderBy("vec_id")
    p = e.select("vec_id", "label", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    d = F.hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w))
    return p.withColumn("d", d).groupBy("label").agg(F.round(F.sum(F.when(F.col("d") <= 1.5, F.col("d")).otherwise(0.0)), 4).alias("travelled"))


@query("embeddings", sql="""
SELECT label, round(regr_slope(y, x), 6) AS scale, round(regr_intercept(y, x), 6) AS shift, count(*) AS n FROM (SELECT label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings) GROUP BY label""")
def fit_transform(e):
    """least-squares scale and offset per group."""
    x, y = F.col("embedding")[0].cast("double"), F.col("embedding")[1].cast("double")
    return e.groupBy("label").agg(F.round(F.regr_slope(y, x), 6).alias("scale"), F.round(F.regr_intercept(y, x), 6).alias("shift"), F.count("*").alias("n"))


@query("conversations", sql="""
SELECT role, count(*) AS turns, CAST(sum(CASE WHEN chars > prev THEN 1 ELSE 0 END) AS BIGINT) AS longer FROM (SELECT role, length(text) AS chars, lag(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM conversations) GROUP BY role""")
def turn_gaps(c):
    """Lag over turns: how often a turn is longer than the one before."""
    prev = F.lag(F.length("text")).over(W.partitionBy("conv_id").orderBy("turn"))
    return c.withColumn("longer", (F.length("text") > prev).cast("long")).groupBy("role").agg(F.count("*").alias("turns"), F.sum(F.coalesce("longer", F.lit(0))).alias("longer"))


@query("conversations", sql="""
SELECT conv_id, count(*) AS runs, max(n) AS longest FROM (SELECT conv_id, g, count(*) AS n FROM (
  SELECT *, sum(new) OVER (PARTITION BY conv_id ORDER BY turn) AS g FROM (SELECT *, CASE WHEN role = lag(role) OVER (PARTITION BY conv_id ORDER BY turn) THEN 0 ELSE 1 END AS new FROM conversations)) GROUP BY conv_id, g) GROUP BY conv_id""")
def speaker_runs(c):
    """Consecutive turns of one speaker."""
    w = W.partitionBy("conv_id").orderBy("turn")
    new = F.when(F.col("role") == F.lag("role").over(w), 0).otherwise(1)
    runs = c.withColumn("new", new).withColumn("g", F.sum("new").over(w)).groupBy("conv_id", "g").agg(F.count("*").alias("n"))
    return runs.groupBy("conv_id").agg(F.count("*").alias("runs"), F.max("n").alias("longest"))


@query("pages", sql="""SELECT page_id, 7 AS fields, '"' || url || '"' AS third, '[1,(2,3)]' AS fifth FROM pages""")
def regexp_split(p):
    """Fields of a line whose quotes and brackets hold commas."""
    line = F.concat(F.lit('a,,"'), F.col("url"), F.lit('",(x,y),[1,(2,3)],"q,r",z'))
    f = tx.split_fields(line)
    return p.select("page_id", F.size(f).alias("fields"), f[2].alias("third"), f[4].alias("fifth"))


@query("part", sql="""SELECT p_partkey, regexp_replace(p_name, ' Off-Hand$', '') AS ability, p_partkey % 1000 AS leading, p_partkey % 4096 AS hexed FROM part""")
def name_strip(p):
    """Trailing tags off names; integer and hexadecimal field readers."""
    name = F.concat("p_name", F.lit(" (rank 2)"))
    return p.select("p_partkey", F.regexp_replace(tx.ability_name(name), " Off-Hand$", "").alias("ability"), tx.field_int(F.concat((F.col("p_partkey") % 1000).cast("string"), F.lit("x9"))).alias("leading"), tx.field_hex(F.concat(F.lit("0x"), F.hex(F.col("p_partkey") % 4096))).alias("hexed"))


@query("part", sql="""SELECT p_partkey, p_partkey + (p_partkey % 7) + (p_partkey % 11) AS last, 3 AS n FROM part""")
def delta_decode(p):
    """Base-36 deltas summed to ids."""
    packed = F.concat_ws(".", *(F.lower(F.conv(x.cast("string"), 10, 36)) for x in (F.col("p_partkey"), F.col("p_partkey") % 7, F.col("p_partkey") % 11)))
    return p.withColumn("ids", tx.delta_ids(packed)).select("p_partkey", F.element_at("ids", -1).alias("last"), F.size("ids").alias("n"))


@query("part", sql="""SELECT p_brand, CAST(bit_or(1 << (p_size % 5)) AS BIGINT) AS mask, len(list_distinct(list(p_size % 5))) AS kinds FROM part GROUP BY p_brand""")
def bitmask_rollup(p):
    """Bits OR-ed per key and named."""
    g = p.groupBy("p_brand").agg(F.bit_or(F.expr("shiftleft(1L, CAST(p_size % 5 AS INT))")).alias("mask"))
    return g.select("p_brand", "mask", F.size(tx.mask_names(F.col("mask"), ["a", "b", "c", "d", "e"])).cast("long").alias("kinds"))


@query("orders", sql="""SELECT o_orderkey, CAST(epoch_us(date_trunc('second', o_orderdate)) // 1000 + o_orderkey % 1000 AS BIGINT) AS wall_ms, CAST(-300 AS INT) AS offset_min FROM orders""")
def time_parse(o):
    """P5: stamps with year and offset as wall-clock milliseconds."""
    raw = F.concat(F.date_format("o_orderdate", "M/d/yyyy HH:mm:ss"), F.lit("."), F.lpad((F.col("o_orderkey") % 1000).cast("string"), 3, "0"), F.lit("-5"))
    rows = o.select("o_orderkey", raw.alias("raw"))
    return times.with_wall_ms(rows, "raw", ["o_orderkey"], "o_orderkey", 2024).select("o_orderkey", "wall_ms", "offset_min")


@query("lineitem", sql="""SELECT l_returnflag, l_linestatus, CAST(l_linenumber AS BIGINT) AS width, count(*) AS n FROM lineitem GROUP BY ALL""")
def width_histogram(l):
    """P25: how often each layout occurs."""
    return l.groupBy("l_returnflag", "l_linestatus", F.col("l_linenumber").cast("long").alias("width")).agg(F.count("*").alias("n"))


@query("lineitem", sql="""SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING bool_or(l_returnflag = 'A') AND NOT bool_or(l_returnflag = 'R')""")
def dedicated_ids(l):
    """Ids of one kind less those of another: orders with a line of one flag, none of another, whatever else they have."""
    kinds = l.select(F.col("l_orderkey").alias("spell_id"), F.col("l_returnflag").alias("effect"))
    flag = lambda *f: l.sparkSession.createDataFrame([(x,) for x in f], "effect string")
    return dimensions.dedicated(kinds, flag("A"), flag("N")).select(F.col("spell_id").alias("l_orderkey"))


@query("lineitem", "part", sql="""
SELECT p_brand, min(p_partkey) AS passive, arg_min(q, p_partkey) AS rate FROM (SELECT p_partkey, p_brand, CAST(sum(l_quantity) AS BIGINT) AS q FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_partkey, p_brand) GROUP BY p_brand""")
def proc_rates(l, p):
    """The lowest id's value per key after a join."""
    g = l.join(p, l["l_partkey"] == p["p_partkey"]).groupBy("p_partkey", "p_brand").agg(F.sum("l_quantity").cast("long").alias("q"))
    return g.groupBy("p_brand").agg(F.min("p_partkey").alias("passive"), F.min_by("q", "p_partkey").alias("rate"))


@query("orders", sql="""SELECT o_custkey, CAST(session AS BIGINT) AS session, min(o_orderkey) AS first_order, count(*) AS n FROM (
  SELECT *, sum(CASE WHEN gap > 30 OR gap IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS session FROM (
    SELECT *, date_diff('day', lag(o_orderdate::DATE) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), o_orderdate::DATE) AS gap FROM orders)) GROUP BY o_custkey, session""")
def order_sessions(o):
    """C4 on dates: order sprees at most thirty days apart."""
    d = o.withColumns({"day": F.unix_date(F.to_date("o_orderdate")), "o": F.struct("o_orderdate", "o_orderkey")})
    return sessions.sessionize_gap(d, ["o_custkey"], "day", "o", 30).groupBy("o_custkey", "session").agg(F.min("o_orderkey").alias("first_order"), F.count("*").alias("n"))


@query("documents", sql="""SELECT source, count(*) AS docs, CAST(sum(n_chars) AS BIGINT) AS chars, min(doc_id) AS first_doc FROM documents GROUP BY source""")
def source_inventory(d):
    """What each source holds."""
    return d.groupBy("source").agg(F.count("*").alias("docs"), F.sum("n_chars").alias("chars"), F.min("doc_id").alias("first_doc"))


