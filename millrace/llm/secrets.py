"""Secret scan: three fixed patterns, then a randomness test battery over all other long tokens.

A candidate is a maximal run of 20 or more characters of ``[A-Za-z0-9+/_-]`` (with up to two ``=``).
Its encoding is inferred from the characters it uses; within that alphabet three tests ask whether
it looks like uniform random symbols: a chi-squared test of the counts, a runs test around the
alphabet's middle and the lag-one serial correlation. Pearson's statistic is given the tail of the gamma
law with its exact mean and variance (by the cube-root transform), since a short token has less than
one expected symbol a letter; the tests depend on each other, so three times the least p decides, which
holds under any dependence. Of uniform random tokens 0.1 to 0.4 % are rejected at any length (measured
in the tests); a candidate that is rejected is no secret. What remains is compared with ordinary text:
the chi-squared statistic's mean and spread under letter frequencies follow the token's length, which
gives the probability that a text token of this length looks as even, and the Benjamini-Hochberg
step-up over all distinct candidates bounds the share of false discoveries. DataFrame operations only.

Positions are code points, ends exclusive. A null text counts as empty. Base matches stay whatever
the battery says; added spans (kind ``random``) never overlap a base span. Rows are judged one by
one, so repeated rows and null ids keep their own results; extra columns pass through and those
named like an output are replaced. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window as W

from millrace.llm.joins import spread_join
from millrace.llm.store import Workspace
from millrace.session import table

ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]{16,}"  # a run shorter than 20 in all cannot match at a later start either
HEX = "[0-9a-f]{24,}"
CANDIDATE = "[A-Za-z0-9+/_-]{20,}={0,2}"
MIN_VALUE = 6  # characters of an assigned value
KINDS = ("assign", "access", "hex")
RANDOM_P = 1e-3  # the battery rejects randomness below this
FDR = 0.05
#: Sums of the squares and cubes of letter frequencies of ordinary text.
TEXT_SQUARES, TEXT_CUBES = 0.070, 0.0065
#: (encoding, what its tokens match, alphabet in order), narrowest first.
ENCODINGS = (
    ("decimal", "^[0-9]+$", "0123456789"),
    ("hex", "^([0-9a-f]+|[0-9A-F]+)$", "0123456789abcdef"),
    ("base32", "^[A-Z2-7]+=*$", "234567ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("alphanumeric", "^[0-9A-Za-z]+$", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("base64", "^[0-9A-Za-z+/]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("base64url", "^[0-9A-Za-z_-]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
    ("mixed", "", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_"),
)
_SPAN = "array<struct<s:bigint,e:bigint,v:string>>"


def _sql(pattern: str) -> str:
    return "r'" + pattern.replace("'", r"\x27") + "'"


def spans_of(pattern: str, group: int = 0) -> Column:
    """(start, end, text of the group) of the leftmost non-overlapping matches in column ``_t``.

    The pieces between matches and the matches themselves alternate; their lengths sum to positions.
    """
    p = _sql(pattern)
    step = "named_struct('at', a.at + length(p[i]) + length(m[i]), 'out', concat(a.out, array(named_struct('s', a.at + length(p[i]), 'e', a.at + length(p[i]) + length(m[i]), 'v', g[i]))))"
    found = (
        f"transform(array(named_struct('m', regexp_extract_all(_t, {p}, 0), 'g', regexp_extract_all(_t, {p}, {group}), 'p', split(_t, {p}, -1))), x -> "
        f"aggregate(sequence(0, size(x.m) - 1), named_struct('at', 0L, 'out', cast(array() AS {_SPAN})), (a, i) -> {step.replace('p[i]', 'x.p[i]').replace('m[i]', 'x.m[i]').replace('g[i]', 'x.g[i]')}).out)[0]"
    )
    return F.expr(f"CASE WHEN _t RLIKE {p} THEN {found} ELSE cast(array() AS {_SPAN}) END")


def upper_tail(z: Column) -> Column:
    """P(Z >= z) of the standard normal (a rational approximation, 1e-7)."""
    a = F.abs(z)
    t = 1 / (1 + 0.2316419 * a)
    q = F.exp(-a * a / 2) * 0.3989422804 * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.greatest(F.when(z >= 0, q).otherwise(1 - q), F.lit(1e-300))


def battery(tokens: DataFrame) -> DataFrame:
    """(token, encoding, n, p_random, p_text) of distinct tokens."""
    name = alphabet = F
    for enc, match, letters in ENCODINGS:
        if match:
            name, alphabet = name.when(F.col("token").rlike(match), enc), alphabet.when(F.col("token").rlike(match), F.lit(letters))
    name, alphabet = name.otherwise(ENCODINGS[-1][0]), alphabet.otherwise(F.lit(ENCODINGS[-1][2]))
    t = tokens.select("token", name.alias("encoding"), alphabet.alias("_a")).withColumn("_b", F.expr("rtrim('=', CASE WHEN encoding = 'hex' THEN lower(token) ELSE token END)"))
    t = t.withColumn("_c", F.expr("transform(split(_b, ''), c -> instr(_a, c) - 1)"))
    steps = F.explode(F.arrays_zip(F.col("_c").alias("code"), F.expr("slice(_c, 2, size(_c))").alias("next")))
    codes = t.select("token", "encoding", F.length("_a").alias("k"), steps.alias("_x")).select("token", "encoding", "k", "_x.code", "_x.next")
    high = lambda c: (2 * F.col(c) >= F.col("k")).cast("int")
    sums = codes.groupBy("token", "encoding", "k", "code").agg(
        F.count("*").alias("c"), F.count("next").alias("pairs"), F.sum(F.col("code") * F.col("next")).alias("xy"), F.sum("next").alias("y"), F.sum((high("code") != high("next")).cast("int")).alias("turns")
    )
    s = sums.groupBy("token", "encoding", "k").agg(
        F.sum("c").cast("double").alias("n"), F.sum(F.col("c") * F.col("c")).alias("squares"), F.sum(F.coalesce("xy", F.lit(0))).alias("xy"), F.sum(F.col("c") * F.col("code")).alias("x"),
        F.sum(F.col("pairs") * F.col("code") + F.coalesce("y", F.lit(0))).alias("ends"), F.sum(F.col("c") * F.col("code") * F.col("code")).alias("xx"),
        F.sum(F.coalesce("turns", F.lit(0))).alias("turns"), F.sum(F.col("c") * high("code")).cast("double").alias("n1"),
    )
    n, n1, k, chi, two, mean, var = (F.col(c) for c in ("n", "n1", "k", "chi", "two", "mean", "var"))
    s = s.withColumns({"chi": k / n * F.col("squares") - n, "two": 2 * n1 * (n - n1), "mean": F.col("x") / n, "var": F.col("xx") / n - (F.col("x") / n) * (F.col("x") / n)})
    df = (k - 1) * n / (n - 1)  # of the gamma law (a scaled chi-squared) with the statistic's mean k - 1 and variance 2 (k - 1) (n - 1) / n
    serial = (F.col("xy") - mean * F.col("ends") + (n - 1) * mean * mean) / (n * var)
    s = s.withColumns({
        "z_chi": (F.cbrt(chi / (k - 1)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df)),
        "z_runs": F.abs((F.col("turns") - two / n) / F.sqrt(F.greatest(two * (two - n) / (n * n * (n - 1)), F.lit(1e-9)))),
        "z_serial": F.when(var > 0, F.abs((serial + 1 / n) * F.sqrt(n * n * (n - 1)) / (n - 2))).otherwise(40.0),
        "text_mean": k * (1 + (n - 1) * TEXT_SQUARES) - n,
        "text_var": 4 * n * (n - 1) * (n - 2) * (TEXT_CUBES - TEXT_SQUARES**2) + 2 * n * (n - 1) * (TEXT_SQUARES - TEXT_SQUARES**2),
    })
    s = s.withColumn("z_text", (F.col("text_mean") - chi) / (F.sqrt("text_var") * k / n))
    p = {name: upper_tail(F.col(f"z_{name}")) for name in ("chi", "runs", "serial", "text")}
    runs = F.when((n1 == 0) | (n1 == n), F.pow(F.lit(2.0), 1 - n)).otherwise(2 * p["runs"])
    p_random = F.least(F.lit(1.0), 3 * F.least(p["chi"], runs, 2 * p["serial"]))
    return s.select("token", "encoding", "n", p_random.alias("p_random"), p["text"].alias("p_text"))


def discoveries(tested: DataFrame) -> DataFrame:
    """The tested tokens that the battery lets pass and the step-up procedure selects.

    The step-up runs over tenths of a decade of p (a bounded histogram) and takes each bin at its
    upper end, which errs on the safe side.
    """
    bin_ = F.floor(-10 * F.log10("p_text"))
    held = tested.groupBy(bin_.alias("bin")).agg(F.count("*").alias("m"), F.count_if(F.col("p_random") >= RANDOM_P).alias("n"))
    down = W.orderBy(F.desc("bin")).rowsBetween(W.unboundedPreceding, 0)
    steps = held.select("bin", F.sum("n").over(down).alias("found"), F.sum("m").over(W.partitionBy(F.lit(1))).alias("all"))
    cut = steps.filter(F.col("all") * F.pow(F.lit(10.0), -F.col("bin") / 10) <= FDR * F.col("found")).agg(F.min("bin")).first()[0]
    return tested.filter(F.col("p_random") >= RANDOM_P).filter(bin_ >= cut if cut is not None else F.lit(False))


def scanned(df: DataFrame, space: Workspace, keep_text: bool) -> DataFrame:
    """``df``'s rows numbered (_row), with n_assign, n_access, n_hex, base (spans) and _cand (candidates clear of them), written once."""
    out = df.withColumn("_t", F.coalesce("text", F.lit("")))
    out = out.withColumns({"_assign": spans_of(ASSIGN, 2), "_access": spans_of(ACCESS), "_hex": spans_of(HEX), "_cand": spans_of(CANDIDATE)})
    out = out.withColumn("_assign", F.filter("_assign", lambda x: F.length(x["v"]) >= MIN_VALUE))
    tagged = [F.expr(f"transform(_{k}, x -> named_struct('s', x.s, 'o', {i}, 'e', x.e, 'kind', '{k}'))") for i, k in enumerate(KINDS)]
    out = out.withColumns({"base": F.array_sort(F.concat(*tagged)), **{f"n_{k}": F.size(f"_{k}").cast("long") for k in KINDS}}).drop("_t", "_assign", "_access", "_hex")
    out = out.withColumn("_cand", F.filter("_cand", lambda x: ~F.exists("base", lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"]))))
    return space.put((out if keep_text else out.drop("text")).withColumn("_row", F.monotonically_increasing_id()), "scanned")


def find_secrets(df: DataFrame, keep_text: bool = True) -> DataFrame:
    """``df`` (with or without its text) with n_assign, n_access, n_hex, base (spans), random (spans with token)."""
    space = Workspace(df.sparkSession, "secrets")
    rows = scanned(df.drop("n_assign", "n_access", "n_hex", "base", "random"), space, keep_text)
    some = rows.select("_row", F.explode("_cand").alias("c")).select("_row", F.col("c.s").alias("s"), F.col("c.e").alias("e"), F.col("c.v").alias("token"))
    times = space.put(some.groupBy("token").agg(F.count("*").alias("weight")), "tokens")
    tested = space.put(battery(times), "tested")
    chosen = space.put(discoveries(tested).select("token", "encoding").join(times, "token"), "chosen")
    found = spread_join(some, chosen, "token", chosen.agg(F.coalesce(F.sum("weight"), F.lit(0))).first()[0])
    added = found.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("s", "e", "token", "encoding"))).alias("random"))
    none = F.expr("cast(array() AS array<struct<s:bigint,e:bigint,token:string,encoding:string>>)")
    without = rows.filter(F.size("_cand") == 0).withColumn("random", none)
    return rows.filter(F.size("_cand") > 0).join(added, "_row", "left").withColumn("random", F.coalesce("random", none)).unionByName(without).drop("_row", "_cand")


def _written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's base matches (counted and digested) and all spans."""
    found = find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False)
    extra = F.transform("random", lambda x: F.struct(x["s"].alias("s"), F.lit(len(KINDS)).alias("o"), x["e"].alias("e"), F.lit("random").alias("kind")))
    return found.select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2(_written(F.col("base")), 256).alias("base_sha256"), _written(F.array_sort(F.concat("base", extra))).alias("spans")
    )


QUERIES = {"op4_secret_scan": op4_secret_scan}
SQL: dict[str, str] = {}
