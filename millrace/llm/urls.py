"""URL filter: host/path rules first, a character language-model ratio for the rest.

Two interpolated Witten-Bell Markov models of variable order (contexts of two, one or no
characters, weighted by how often and how diversely each context was followed) are fitted to the
URLs that the rules accept and to those they reject. A URL without a rule is judged by the
log-likelihood difference per character against a threshold calibrated on labelled URLs that the
models did not see. DataFrame operations only.

Edge cases: a null URL, or one without ``://``, has an empty host and path and no rule; a null or
empty URL has no characters to judge and is allowed. Characters outside the model's alphabet
count as one symbol. Repeated rows keep their own verdicts; each distinct URL is one training
text. Without labelled URLs of both kinds every unruled URL is allowed. Extra columns pass through
``url_verdicts``; columns named like an output are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window as W

from millrace.llm.joins import spread_join
from millrace.llm.store import Workspace
from millrace.session import table

#: (action, host, path): a rule holds for the host and its subdomains where the URL's path starts with the rule's.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
ALPHABET = "a-z0-9./:_?=&#%-"
SYMBOLS = 26 + 10 + 10 + 3  # letters, digits, signs; other, start and end
BINS = 1000  # of one nat per character
HELD_OUT = 5  # every fifth labelled URL calibrates and does not train


def url_host(url: Column) -> Column:
    host = F.regexp_extract(url, r"^(?s)(?:(?!://).)*://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s)(?:(?!://).)*://[^/?#]*(/[^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, action) of the longest rule that fits, null if none does."""
    longest_first = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    name = action = F
    for what, h, p in longest_first:
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        name, action = name.when(fits, F.lit(h + p)), action.when(fits, F.lit(what))
    return name, action


def _trigrams(urls: DataFrame) -> DataFrame:
    """A row per character of each URL: the character with the two before it."""
    known = F.regexp_replace(F.translate("url", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), f"(?s)[^{ALPHABET}]", "~")
    return (
        urls.filter(F.length("url") > 0)
        .withColumn("_s", F.concat(F.lit("^^"), known, F.lit("$")))
        .withColumn("gram", F.explode(F.expr("transform(sequence(1, length(_s) - 2), i -> substring(_s, i, 3))")))
        .drop("_s")
    )


def _witten_bell(grams: DataFrame) -> DataFrame:
    """(gram, ratio): log p(accepted) - log p(rejected) of every trigram seen in any URL.

    At most SYMBOLS ** 3 rows, whatever the input.
    """
    counts = grams.groupBy("gram").agg(
        F.count_if(F.expr("train AND label")).alias("n_a"), F.count_if(F.expr("train AND NOT label")).alias("n_r")
    )
    g = counts.withColumns({"c2": F.substring("gram", 1, 2), "bc": F.substring("gram", 2, 2), "b": F.substring("gram", 2, 1), "c": F.substring("gram", 3, 1)})

    def total(df: DataFrame, key: str, name: str) -> DataFrame:
        """Occurrences and distinct successors per context, for both models."""
        return df.groupBy(key).agg(*(x for k in "ar" for x in (F.sum(f"n_{k}").alias(f"{name}n_{k}"), F.count_if(F.col(f"n_{k}") > 0).alias(f"{name}t_{k}"))))

    sums = lambda key: g.groupBy(key).agg(*(F.sum(f"n_{k}").alias(f"n_{k}") for k in "ar"))
    everything = W.partitionBy(F.lit(1))  # a row per symbol
    one = sums("c").withColumns({f"un_{k}": F.sum(f"n_{k}").over(everything) for k in "ar"})
    two = sums("bc").withColumn("b", F.substring("bc", 1, 1))
    two = two.join(total(two, "b", "b"), "b").select("bc", *(F.col(f"n_{k}").alias(f"m_{k}") for k in "ar"), *(f"b{x}_{k}" for x in "nt" for k in "ar"))
    one = one.select("c", *(F.col(f"n_{k}").alias(f"o_{k}") for k in "ar"), *(f"un_{k}" for k in "ar"))
    full = g.join(total(g, "c2", "c"), "c2").join(two, "bc").join(one, "c")
    p = {}
    for k in "ar":
        blend = lambda n, seen, kinds, lower: F.when(seen + kinds > 0, (n + kinds * lower) / (seen + kinds)).otherwise(lower)
        p1 = (F.col(f"o_{k}") + 1.0) / (F.col(f"un_{k}") + float(SYMBOLS))
        p2 = blend(F.col(f"m_{k}"), F.col(f"bn_{k}"), F.col(f"bt_{k}"), p1)
        p[k] = blend(F.col(f"n_{k}"), F.col(f"cn_{k}"), F.col(f"ct_{k}"), p2)
    return full.select("gram", (F.log(p["a"]) - F.log(p["r"])).alias("ratio"))


def url_verdicts(df: DataFrame, rules=RULES) -> DataFrame:
    """``df`` with host, path, rule, verdict and score (nats per character, null without characters).

    Each distinct URL is written once, and once more with its score; rows without characters, or with a
    rule, whose verdicts need no score, still get one, so that scores are whole.
    """
    space = Workspace(df.sparkSession, "urls")
    host, path = url_host(F.col("url")), url_path(F.col("url"))
    out = df.drop("host", "path", "rule", "verdict", "score").withColumns({"host": host, "path": path})
    name, action = rule_of(F.col("host"), F.col("path"), rules)
    out = out.withColumns({"rule": name, "_action": action})
    fold = F.conv(F.substring(F.md5("url"), 1, 4), 16, 10).cast("int") % HELD_OUT
    urls = out.filter(F.length("url") > 0).groupBy("url").agg((F.first("_action") == "allow").alias("label"), F.count("*").alias("weight"))
    urls = space.put(urls.withColumn("train", F.col("label").isNotNull() & (fold != 0)), "distinct")
    ratio = space.put(_witten_bell(_trigrams(urls.drop("weight"))), "ratio")
    scored = _trigrams(urls).join(F.broadcast(ratio), "gram").groupBy("url").agg(
        F.first("label").alias("label"), F.first("train").alias("train"), F.first("weight").alias("weight"), F.floor(F.sum("ratio") / F.count("*") * BINS).alias("bin")
    )
    scored = space.put(scored, "scored")
    total, cut = scored.agg(F.coalesce(F.sum("weight"), F.lit(0))).first()[0], _threshold(scored)
    judged = F.when(F.col("bin") >= cut, "allow").otherwise("block") if cut is not None else F.lit("allow")
    with_score = spread_join(out.filter(F.length("url") > 0), scored.select("url", "bin", "weight"), "url", total)
    with_score = with_score.withColumn("verdict", F.coalesce("_action", judged))
    without = out.filter("coalesce(length(url), 0) = 0").withColumns({"bin": F.lit(None).cast("bigint"), "verdict": F.coalesce("_action", F.lit("allow"))})
    return with_score.select(*without.columns).unionByName(without).withColumn("score", F.col("bin") / BINS).drop("_action", "bin")


def _threshold(scored: DataFrame) -> int | None:
    """Where the sum of both error rates over the calibration URLs is least, halfway to the next lower score; None if a kind is missing."""
    held = scored.filter("label is not null and not train").groupBy("bin").agg(F.count_if(F.col("label")).alias("good"), F.count_if(~F.col("label")).alias("bad"))
    up, everything = W.orderBy("bin").rowsBetween(W.unboundedPreceding, -1), W.partitionBy(F.lit(1))
    row = (
        held.withColumns({"lost": F.coalesce(F.sum("good").over(up), F.lit(0)), "caught": F.coalesce(F.sum("bad").over(up), F.lit(0)), "g": F.sum("good").over(everything), "b": F.sum("bad").over(everything)})
        .filter("g > 0 and b > 0")
        .selectExpr("CAST(floor((bin + lag(bin, 1, bin) OVER (ORDER BY bin)) / 2) AS BIGINT) AS bin", "lost / g + 1 - caught / b AS error")
        .orderBy(F.round("error", 9), "bin")
        .first()
    )
    return row and int(row["bin"])


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's host, path, rule and verdict."""
    return url_verdicts(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


_CASES = "\n".join(f"            WHEN (host = '{h}' OR host LIKE '%.{h}') AND path LIKE '{p}%' THEN '{{{i}}}'" for i, (_, h, p) in enumerate(sorted(RULES, key=lambda r: -len(r[1] + r[2]))))
_ORDERED = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
_SQL = f"""
WITH parts AS (
    SELECT page_id, url,
        coalesce(translate(regexp_extract(url, '^(?s)(.*?)://([^/?#]*)', 2), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
        coalesce(regexp_extract(url, '^(?s)(.*?)://[^/?#]*(/[^?#]*)', 2), '') AS path
    FROM pages),
ruled AS (
    SELECT *, CASE
{_CASES.format(*(h + p for _, h, p in _ORDERED))}
        END AS rule, CASE
{_CASES.format(*(a for a, _, _ in _ORDERED))}
        END AS action
    FROM parts),
urls AS (SELECT DISTINCT url, action = 'allow' AS label, action IS NOT NULL AND CAST('0x' || substr(md5(url), 1, 4) AS INT) % {HELD_OUT} <> 0 AS train FROM ruled WHERE length(url) > 0),
padded AS (SELECT *, '^^' || regexp_replace(translate(url, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '(?s)[^{ALPHABET}]', '~', 'g') || '$' AS s FROM urls),
grams AS (SELECT url, label, train, substring(s, i, 3) AS gram FROM (SELECT *, unnest(range(1, length(s) - 1)) AS i FROM padded)),
kinds AS (SELECT gram, k, count(*) FILTER (train AND label = (k = 'a')) AS n FROM grams, (VALUES ('a'), ('r')) v(k) GROUP BY ALL),
one AS (SELECT k, gram[3] AS c, sum(n) AS n FROM kinds GROUP BY ALL),
p1 AS (SELECT k, c, (n + 1.0) / (sum(n) OVER (PARTITION BY k) + {float(SYMBOLS)}) AS p FROM one),
two AS (SELECT k, gram[2:3] AS bc, sum(n) AS n FROM kinds GROUP BY ALL),
two_t AS (SELECT *, sum(n) OVER (PARTITION BY k, bc[1]) AS seen, count(*) FILTER (n > 0) OVER (PARTITION BY k, bc[1]) AS t FROM two),
p2 AS (SELECT k, bc, CASE WHEN seen + t > 0 THEN (CAST(n AS DOUBLE) + t * p) / (seen + t) ELSE p END AS p FROM two_t JOIN p1 USING (k) WHERE p1.c = bc[2]),
three AS (SELECT *, sum(n) OVER (PARTITION BY k, gram[1:2]) AS seen, count(*) FILTER (n > 0) OVER (PARTITION BY k, gram[1:2]) AS t FROM kinds),
p3 AS (SELECT k, gram, CASE WHEN seen + t > 0 THEN (CAST(n AS DOUBLE) + t * p) / (seen + t) ELSE p END AS p FROM three JOIN p2 USING (k) WHERE p2.bc = gram[2:3]),
ratio AS (SELECT a.gram, ln(a.p) - ln(r.p) AS d FROM p3 a JOIN p3 r ON a.gram = r.gram AND a.k = 'a' AND r.k = 'r'),
scored AS (SELECT url, label, train, CAST(floor(sum(d) / count(*) * {BINS}) AS BIGINT) AS bin FROM grams JOIN ratio USING (gram) GROUP BY ALL),
held AS (SELECT bin, count(*) FILTER (label) AS good, count(*) FILTER (NOT label) AS bad FROM scored WHERE label IS NOT NULL AND NOT train GROUP BY bin),
errors AS (
    SELECT CAST(floor((bin + lag(bin, 1, bin) OVER (ORDER BY bin)) / 2.0) AS BIGINT) AS bin, coalesce(sum(good) OVER w, 0) / sum(good) OVER () + 1 - coalesce(sum(bad) OVER w, 0) / sum(bad) OVER () AS error
    FROM held WINDOW w AS (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
cut AS (SELECT bin FROM errors WHERE isfinite(error) ORDER BY round(error, 9), bin LIMIT 1)
SELECT page_id, host, path, rule, coalesce(action, CASE WHEN coalesce(scored.bin < (SELECT bin FROM cut), false) THEN 'block' ELSE 'allow' END) AS verdict
FROM ruled LEFT JOIN scored USING (url)
"""

QUERIES = {"op7_url_filter": op7_url_filter}
SQL = {"op7_url_filter": _SQL}
