"""Every operator on odd rows, on no rows, and against a brute-force version on small inputs."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import decontaminate, joins, language, mixture, neardup, planes, quality, secrets, shards, text, tokens, urls
from millrace.llm.store import Workspace
from millrace.session import table

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(t):
    return WORD.findall(t or "")


def shingle_set(t, lower=str.lower, k=5):
    w = words(lower(t or ""))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def ascii_lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, SF, "documents").cache()


@pytest.fixture(scope="module")
def rows(docs):
    return docs.toPandas()


# words and shingles


def test_words_split_at_rows_and_spaces():
    texts = ["a b", "", " c", "dé\x0bf ", "g"]
    raw = [t.encode() for t in texts]
    w = text.Words(np.frombuffer(b"".join(raw), dtype=np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]))
    got = [[b"".join(raw)[a:b].decode() for a, b in zip(w.start[i:j], w.end[i:j])] for i, j in zip(w.ptr[:-1], w.ptr[1:])]
    assert got == [words(t) for t in texts]
    assert len(set(w.hashes())) == 6


def test_shingles_equal_iff_words_equal():
    texts = ["a b c d e f", "b c d e f", "a b", "a b", "", "b a"]
    raw = [t.encode() for t in texts]
    h, ptr = text.Words(np.frombuffer(b"".join(raw), dtype=np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])])).shingles(5)
    assert np.diff(ptr).tolist() == [2, 1, 1, 1, 0, 1]
    assert h[1] == h[2] and h[3] == h[4] and len(set(h.tolist())) == 4


def doubled(n):
    """A word of n letters in which each half is the other with its letters exchanged, and its own exchange."""
    w = "a"
    while len(w) < n:
        w += w.translate(str.maketrans("ab", "ba"))
    return w, w.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("n", [1024, 4096])
def test_words_built_by_doubling_differ(n):
    raw = "".join(doubled(n)).encode()
    h = text.span_hashes(np.frombuffer(raw * 2, dtype=np.uint8), np.arange(4) * n, np.arange(1, 5) * n)
    assert h[0] != h[1] and h[0] == h[2] and h[1] == h[3]


@pytest.mark.parametrize("rows, keys", [(1, 10_000), (1_000, 10_000)])
def test_spread_join_loses_nothing(spark, monkeypatch, rows, keys):
    monkeypatch.setattr(joins, "HOT_ROWS", rows)
    left = spark.range(500).selectExpr("id", "CASE WHEN id < 400 THEN 1 WHEN id % 7 = 0 THEN NULL ELSE id END AS k")
    right = left.filter("k IS NOT NULL").groupBy("k").agg(F.count("*").alias("weight")).withColumn("v", F.col("k") * 2)
    got = sorted(map(tuple, joins.spread_join(left, right, "k", 500).select("id", "k", "v").collect()))
    assert got == [(i, k, 2 * k) for i, k in ((i, 1 if i < 400 else i) for i in range(500)) if i < 400 or i % 7]


# 1


def test_leaks_match_brute_force(spark, docs, rows):
    items = table(spark, SF, "benchmark").toPandas()
    fold = lambda t: t.casefold()
    sets = {d: shingle_set(t, fold) for d, t in zip(rows.doc_id, rows.text)}
    want = set()
    for i, t in zip(items.item_id, items.text):
        s = shingle_set(t, fold)
        want |= {(d, i) for d, x in sets.items() if s and 10 * len(s & x) >= 8 * len(s)}
    found = decontaminate.leaks(docs, table(spark, SF, "benchmark"))
    assert {(r.doc_id, r.item_id) for r in found.collect()} == want and want
    kept = decontaminate.without_leaks(docs, table(spark, SF, "benchmark"))
    assert {r.doc_id for r in kept.select("doc_id").collect()} == set(rows.doc_id) - {d for d, _ in want}


@pytest.mark.parametrize("limit", [0, 4_000_000])
def test_leaks_on_odd_rows(spark, odd_docs, no_docs, monkeypatch, limit):
    monkeypatch.setattr(decontaminate, "INDEX_LIMIT", limit)
    items = spark.createDataFrame([(1, " ".join(f"w{i}x{i * 7 % 13}" for i in range(20, 50))), (2, None), (3, ""), (4, "w200x9 w201x3 w202x10"), (5, "w200x9")], "item_id long, text string")
    got = Counter((r.doc_id, r.item_id) for r in decontaminate.leaks(odd_docs, items).collect())
    assert got[(1, 1)] == 1 and got[(2, 1)] == 1 and got[(3, 1)] == 1 and not [k for k in got if k[1] in (2, 3, 5)]
    kept = decontaminate.without_leaks(odd_docs, items)
    assert kept.columns == odd_docs.columns and {1, 2, 3}.isdisjoint({r.doc_id for r in kept.collect()})
    assert kept.filter("doc_id IS NULL").count() == 2
    assert decontaminate.leaks(no_docs, items).count() == 0 and decontaminate.without_leaks(no_docs, items).count() == 0
    assert decontaminate.without_leaks(odd_docs, items.limit(0)).count() == odd_docs.count()


# 2


def test_histogram_matches_counts(spark, docs, rows, odd_docs, no_docs):
    enc = tokens.encoding(tokens.ranks_path())
    lengths = sorted(len(enc.encode_ordinary(t)) for t in rows.text)
    out = {r.n_tokens: r for r in tokens.limits(tokens.histogram(docs, tokens.ranks_path())).collect()}
    assert {k: r.n_docs for k, r in out.items()} == Counter(lengths)
    for k, r in out.items():
        assert r.truncated_tokens == sum(min(n, k) for n in lengths) and r.docs_ge == sum(n >= k for n in lengths) and r.tokens_ge == sum(n for n in lengths if n >= k)
    hist = tokens.histogram(docs, tokens.ranks_path())
    q = {r.share: r.n_tokens for r in tokens.quantiles(hist, [0.5, 1.0]).collect()}
    assert q == {0.5: lengths[(len(lengths) + 1) // 2 - 1], 1.0: lengths[-1]}
    cut = {r.context: (r.docs_cut, r.tokens) for r in tokens.truncated_totals(hist, [10, 512]).collect()}
    assert cut == {c: (sum(n > c for n in lengths), sum(min(n, c) for n in lengths)) for c in (10, 512)}
    assert sum(r.n_docs for r in tokens.histogram(odd_docs, tokens.ranks_path()).collect()) == 13
    assert tokens.limits(tokens.histogram(no_docs, tokens.ranks_path())).count() == 0


# 3


def counts_of(t):
    t = t or ""
    w, seen, dups = words(t), set(), 0
    for line in t.split("\n"):
        if words(line):
            dups += line in seen
            seen.add(line)
    at = defaultdict(list)
    for i in range(len(w) - 2):
        at[tuple(w[i : i + 3])].append(i)
    covered = {i + k for v in at.values() if len(v) > 1 for i in v for k in range(3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dups, len(covered)


def test_quality_counts(docs, rows, odd_docs, no_docs):
    for df, source in ((docs, rows), (odd_docs, odd_docs.toPandas())):
        got = quality.judge(df.select("doc_id", "text")).toPandas()
        names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
        assert sorted(map(tuple, got[names].values.tolist())) == sorted(counts_of(t) for t in source.text)
        assert not (got.kept & got.base_failed).any() and got.posterior.between(0, 1).all()
    assert quality.judge(no_docs).count() == 0


def test_quality_separates_labels(spark):
    docs, labels = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    got = quality.judge(docs.select("doc_id", "text")).join(labels, "doc_id").filter("NOT base_failed").toPandas()
    assert got[got.quality == 0].kept.mean() < 0.1 and got[got.quality == 1].kept.mean() > 0.95


def test_constrained_maximum():
    """The closed form against a search over all chances on a grid."""
    grid = [(a / 40, b / 40, (40 - a - b) / 40) for a in range(1, 39) for b in range(1, 40 - a)]
    for good, bad in (((2, 3, 15), (10, 5, 5)), ((10, 2, 8), (5, 3, 12)), ((1, 9, 10), (1, 3, 16)), ((12, 6, 2), (4, 6, 10))):
        g, b = np.array(good, dtype=float), np.array(bad, dtype=float)
        value = lambda u, d: (g * np.log(u)).sum() + (b * np.log(d)).sum()
        up, down = quality.maximised(g, b)
        assert up.sum() == pytest.approx(1) and down.sum() == pytest.approx(1) and up[2] >= down[2] - 1e-9 and down[0] >= up[0] - 1e-9
        assert value(up, down) >= max(value(u, d) for u in grid for d in grid if u[2] >= d[2] and d[0] >= u[0]) - 1e-9


def test_estimate_equals_em_over_documents():
    """Patterns with counts give what a fold over single documents gives, and the objective never falls."""
    import pandas as pd

    rng = np.random.default_rng(8)
    chances = {True: (0.05, 0.15, 0.8), False: (0.6, 0.2, 0.2)}
    votes = [[int(rng.choice(3, p=chances[good])) for _ in quality.RULES] for good in rng.random(400) < 0.8]
    counts, trace = Counter("".join(map(str, v)) for v in votes), []
    got = quality.estimate(pd.DataFrame(sorted(counts.items()), columns=["pattern", "n"]), rounds=20, trace=trace).set_index("pattern").posterior
    assert all(b >= a - 1e-9 for a, b in zip(trace, trace[1:]))
    post = [1 / (1 + np.exp(2.0 * v.count(0) - 2.0)) for v in votes]
    for _ in range(20):
        rates = []
        for r in range(len(quality.RULES)):
            own = [[1.0, 1.0, 1.0], [1.0, 1.0, 1.0]]
            for v, p in zip(votes, post):
                own[0][v[r]] += p
                own[1][v[r]] += 1 - p
            rates.append(quality.maximised(np.array(own[0]), np.array(own[1])))
        prior = (sum(post) + 1) / (len(post) + 2)
        for i, v in enumerate(votes):
            yes, no = prior, 1 - prior
            for (up, down), x in zip(rates, v):
                yes, no = yes * up[x], no * down[x]
            post[i] = yes / (yes + no)
    assert [got["".join(map(str, v))] for v in votes] == pytest.approx(post)


def test_quality_letters_and_long_texts(spark):
    texts = ["！！ 🙂🙂 ab", "漢字漢字漢字漢字 ไทยไทย", "word " * 300_000, None]
    df = spark.createDataFrame([(i, t, "x", 0.5, 9) for i, t in enumerate(texts)], "doc_id long, text string, pattern string, posterior double, n_words int")
    got = {r.doc_id: r for r in quality.judge(df).collect()}
    assert (got[0].n_letters, got[0].word_chars) == (2, 6) and got[1].n_unspaced == got[1].n_letters == 14
    assert got[2].n_words == got[2].n_repeat_words == 300_000 and got[2].base_failed and got[3].n_words == 0 and got[0].pattern == "x"


# 4

ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)


def base_spans(t):
    t = t or ""
    out = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(t) if len(m[1]) >= 6]
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return sorted(out)


def test_secrets_base_matches_brute_force(spark, odd_docs, no_docs):
    texts = [
        "token=secret:abcdefgh", "é漢 API_KEY : 'abc.def-1' x", "Token = \"abc\" passwd=abcdef", "AKIA" + "B" * 16 + " AKIA123", "secret=token=x AKIA" + "AKIA" * 5, "f" * 23 + " " + "0" * 24, None, "",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").unionByName(odd_docs.select("doc_id", "text"))
    for r in secrets.find_secrets(df).collect():
        want = base_spans(r.text)
        assert [(b.s, b.o, b.e, b.kind) for b in r.base] == want
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(w[3] == k for w in want) for k in ("assign", "access", "hex"))
    assert secrets.find_secrets(no_docs).count() == 0


def test_battery_tells_random_from_text(spark):
    rng = np.random.default_rng(3)
    letters = np.array(list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"))
    random = ["".join(rng.choice(letters, 44)) for _ in range(40)]
    plain = ["thequickbrownfoxjumpsoverthelazydogs", "Donaudampfschifffahrtsgesellschaft", "a" * 40, "abababababababababababab", "1234567890123456789012345", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdef"]
    df = spark.createDataFrame([(i, f"say {t} now") for i, t in enumerate(random + plain)], "doc_id long, text string")
    got = {r.doc_id: [x.token for x in r.random] for r in secrets.find_secrets(df).collect()}
    assert sum(bool(got[i]) for i in range(40)) >= 38 and not any(got[i] for i in range(40, 40 + len(plain)))


@pytest.mark.parametrize("n", [20, 40, 1000, 4000])
def test_uniform_tokens_are_seldom_rejected(spark, n):
    rng, rows = np.random.default_rng(n), []
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    for kind, own in {"base64": letters + "+/", "base64url": letters + "-_", "hex": "0123456789abcdef", "decimal": "0123456789"}.items():
        rows += [(kind, "".join(rng.choice(list(own), n))) for _ in range(150)]
    got = secrets.battery(spark.createDataFrame(rows, "kind string, token string").select("token")).toPandas().set_index("token")
    assert (got.p_random < secrets.RANDOM_P).mean() < 0.012 and got.p_random.between(0, 1).all()
    if n >= 1000:
        assert all(got.encoding[t] == kind for kind, t in rows)


def test_battery_equals_its_formulas(spark):
    """p-values against numpy and the error function."""
    from math import erfc

    tail = lambda z: erfc(z / 2**0.5) / 2
    rng = np.random.default_rng(11)
    tokens_ = ["".join(rng.choice(list("0123456789abcdef"), 40)) for _ in range(5)] + ["0123456789abcdef" * 3, "aabbccddeeff00112233445566"]
    got = {r.token: r for r in secrets.battery(spark.createDataFrame([(t,) for t in tokens_], "token string")).collect()}
    for t in tokens_:
        c, n, k = np.array([int(x, 16) for x in t], dtype=float), len(t), 16
        chi = k / n * sum(x * x for x in Counter(t).values()) - n
        df = (k - 1) * n / (n - 1)
        p_chi = tail((np.cbrt(chi / (k - 1)) - (1 - 2 / (9 * df))) / (2 / (9 * df)) ** 0.5)
        high = c >= 8
        two = 2 * high.sum() * (n - high.sum())
        p_runs = 2 * tail(abs(((high[1:] != high[:-1]).sum() - two / n) / (two * (two - n) / (n * n * (n - 1))) ** 0.5))
        d = c - c.mean()
        p_serial = 2 * tail(abs((d[1:] * d[:-1]).sum() / (d * d).sum() + 1 / n) * n * (n - 1) ** 0.5 / (n - 2))
        assert got[t].encoding == "hex" and got[t].p_random == pytest.approx(min(1, 3 * min(p_chi, p_runs, p_serial)), rel=1e-2, abs=1e-7)


def test_step_up_selects_as_a_sorted_list_does(spark):
    rng = np.random.default_rng(3)
    p = np.concatenate([10 ** -rng.uniform(4, 9, 30), rng.uniform(0.01, 1, 200)])
    rows = [(f"t{i}", float(x), float(rng.choice([0.5, 1e-6], p=[0.9, 0.1]))) for i, x in enumerate(p)]
    upper = lambda x: 10.0 ** (-np.floor(-10 * np.log10(x)) / 10)  # noqa: E731  a bin's upper end stands for p
    live = sorted((upper(x), t) for t, x, r in rows if r >= secrets.RANDOM_P)
    best = max((k for k, (x, _) in enumerate(live, 1) if len(rows) * x <= secrets.FDR * sum(y <= x for y, _ in live)), default=0)
    bound = live[best - 1][0] if best else 0
    got = {r.token for r in secrets.discoveries(spark.createDataFrame(rows, "token string, p_text double, p_random double")).collect()}
    assert got == {t for x, t in live if x <= bound} and got


def test_spans_of_all_kinds(spark):
    rng = np.random.default_rng(4)
    key = "".join(rng.choice(list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"), 60))
    df = spark.createDataFrame([(None, f"é {key} token=abcdefg"), (None, f"é {key} token=abcdefg"), (1, "plain " * 50_000), (2, None)], "doc_id long, text string")
    got = [(r.doc_id, [(b.kind, b.s, b.e) for b in r.base], [(x.s, x.e, x.token, x.encoding) for x in r.random]) for r in secrets.find_secrets(df).collect()]
    assert sorted(got, key=str) == sorted([(None, [("assign", 63, 76)], [(2, 62, key, "base64")])] * 2 + [(1, [], []), (2, [], [])], key=str)


# 5


def test_targets():
    assert mixture.targets([10, 10, 10, 10]) == pytest.approx([40 / 7, 80 / 7, 120 / 7, 40 / 7])
    got = mixture.targets([100, 1, 0, 5])
    assert got[1:] == pytest.approx([3, 0, 15]) and sum(got) == pytest.approx(106) and mixture.targets([]) == [] and mixture.targets([0, 0]) == [0, 0]


def test_mixture_meets_targets(spark):
    a, b = (mixture.op5_mixture(spark, "/root/testdata/sf0.01").toPandas().sort_values("doc_id").reset_index(drop=True) for _ in range(2))
    assert a.equals(b) and (a.taken <= 3 * a["size"]).all() and (a.taken % a["size"].clip(lower=1) == 0).all()
    g = a.merge(table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "source").toPandas()).groupby("source").agg(taken=("taken", "sum"), target=("target", "first"))
    assert ((g.taken - g.target).abs() <= 0.02 * g.target).all() and g.target.sum() == pytest.approx(a["size"].sum())


@pytest.mark.parametrize("part, few", [(1024, 100_000), (3, 0)])
def test_mixture_follows_tree_and_seed(spark, monkeypatch, part, few):
    """Another seed takes other documents for the same targets; shards' places are disjoint; without quotas nothing is taken."""
    monkeypatch.setattr(mixture, "PART_DOCS", part)
    monkeypatch.setattr(mixture, "BROADCAST_SOURCES", few)
    docs = table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text", "source")
    source = docs.select("doc_id", "source").toPandas()
    a, b = (mixture.digest(docs, shards, seed).toPandas().merge(source) for shards, seed in ((24, 5), (7, 6)))
    for x in (a, b):
        g = x.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"), size=("size", "sum"), own=("source_size", "first"))
        assert ((g.taken - g.target).abs() <= 0.02 * g.target).all() and (g["size"] == g.own).all()
        sizes = dict(zip(g.index, g["size"]))
        names = sorted(sizes, key=lambda s: s.encode("utf-32-be"))
        assert [g.target[s] for s in names] == pytest.approx(mixture.targets([sizes[s] for s in names]))
    assert (a.sort_values("doc_id").taken.to_numpy() != b.sort_values("doc_id").taken.to_numpy()).mean() > 0.1
    keyed = mixture._keyed(docs, 5)
    plan = mixture.Plan(keyed.select("_src", "doc_id", "size", "_u"))
    where = defaultdict(set)
    for r in plan.drawn(keyed).select("_src", "_place", "mix_shard").collect():
        where[r["_src"], r["_place"]].add(r.mix_shard)
    assert all(len(v) == 1 for v in where.values()) and {s for v in where.values() for s in v} == set(range(24))
    real = mixture.split_tree
    monkeypatch.setattr(mixture, "split_tree", lambda q, s, rng: real(q, s, rng) * 0)
    assert mixture.digest(docs).agg(F.sum("taken")).first()[0] == 0


def test_tree_follows_its_law():
    """A shard's blocks of one source are hypergeometric: mean and variance over many seeds."""
    q = np.array([30, 70])
    x = np.array([mixture.split_tree(q, 4, np.random.default_rng(s))[1][0] for s in range(3000)])
    mean, var = 25 * 0.3, 25 * 0.3 * 0.7 * 75 / 99
    assert abs(x.mean() - mean) < 5 * (var / 3000) ** 0.5 and abs(x.var() / var - 1) < 0.15


def test_mixture_on_odd_rows(odd_docs, no_docs):
    out = mixture.mixed(odd_docs).toPandas()
    assert set(odd_docs.columns) <= set(out.columns) and out.groupby("text").size().max() <= 9 and out.mix_shard.between(0, 23).all()
    assert mixture.mixed(no_docs).count() == 0


def test_tree_decides_where_rows_land(spark):
    docs = table(spark, SF, "documents")
    want = defaultdict(list)
    for r in mixture.mixed(docs).select("doc_id", "mix_shard").collect():
        want[r.doc_id].append(r.mix_shard)
    part = mixture.stage(spark, docs, SF).select("doc_id", F.spark_partition_id().alias("p")).collect()
    assert Counter((r.doc_id, r.p // 2) for r in part) == Counter((d, s) for d, v in want.items() for s in v)
    for r in mixture.op5_mixture(spark, SF).collect():
        assert sorted(r.mix_shard) == sorted(want[r.doc_id]) and r.taken == r["size"] * len(r.mix_shard)


def test_large_mixes_are_cut_into_more_partitions(spark, monkeypatch):
    docs = table(spark, SF, "documents").select("doc_id", "text", "source")

    def placed():
        out = mixture.mixed(docs).select("doc_id", "mix_shard", "mix_key", F.spark_partition_id().alias("p")).withColumn("i", F.monotonically_increasing_id())
        return out.toPandas().sort_values("i").reset_index(drop=True)

    few = placed()
    monkeypatch.setattr(mixture, "PART_WORDS", 500)
    many = placed()
    assert few.p.nunique() <= 48 < many.p.nunique() and many.groupby("p").mix_shard.nunique().max() == 1
    assert many.drop(columns=["p", "i"]).equals(few.drop(columns=["p", "i"]))  # the same rows in the same order


def test_split_tree_keeps_quotas():
    q = np.array([100, 7, 0, 4096])
    m = mixture.split_tree(q, 24, np.random.default_rng(1))
    assert m.shape == (24, 4) and (m.sum(axis=0) == q).all() and m.sum(axis=1).max() - m.sum(axis=1).min() <= 1 and (m >= 0).all()


# 6


def brute_components(rows):
    sets = [shingle_set(t, ascii_lower) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            o = len(sets[i] & sets[j])
            if o and 100 * o >= 80 * (len(sets[i]) + len(sets[j]) - o):
                parent[root(i)] = root(j)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[root(i)].append(i)
    out = Counter()
    for g in groups.values():
        ids = [rows[i][0] for i in g if rows[i][0] is not None]
        for i in g:
            out[(rows[i][0], len(sets[i]), min(ids) if ids else None)] += 1
    return out


def joined(df):

    space = Workspace(df.sparkSession, "test")
    rows, labels = neardup.components(df.select("doc_id", "text"), space)
    own, _ = neardup.classes(rows, labels, space, F.col("doc_id"))
    got = Counter((r.doc_id, r.n, r["first"]) for r in rows.filter("n > 0").join(own, "key").collect())
    return got + Counter((r.doc_id, 0, r.doc_id) for r in rows.filter("n = 0").collect())


def test_jaccard_components(docs, rows, odd_docs, no_docs):
    assert joined(docs) == brute_components(list(zip(rows.doc_id, rows.text)))
    odd = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert joined(odd_docs) == brute_components(odd)
    assert not joined(no_docs)


def test_jaccard_components_of_edited_copies(spark):
    """Chains and stars of edits around the threshold, more than a hub alone can connect."""
    rng, out = np.random.default_rng(5), []
    for g in range(3):
        base = [f"g{g}w{i}" for i in range(120)]
        for k in range(60):
            w = list(base)
            for _ in range(rng.integers(0, 5)):
                at = int(rng.integers(0, len(w)))
                w[at : at + int(rng.integers(1, 3))] = [f"e{int(rng.integers(0, 40))}"] * int(rng.integers(0, 3))
            out.append((len(out), " ".join(w)))
    assert joined(spark.createDataFrame(out, "doc_id long, text string").repartition(5)) == brute_components(out)


@pytest.mark.parametrize(("rows", "room"), [(5, 1 << 28), (5, 9000), (5, 0), (1000, 1 << 28)])
def test_hub_pairs_are_verified_like_others(spark, monkeypatch, rows, room):
    """Pairs of hubs on either side, on both, and of none; hubs that fit in part or not at all."""
    monkeypatch.setattr(neardup, "HOT_ROWS", rows)
    monkeypatch.setattr(neardup, "HOT_BYTES", room)
    base = list(range(100))
    tokens = {k: sorted({t if (t * 7 + k) % 100 >= k % 25 else 1000 * k + t for t in base}) for k in range(60)}
    sets = spark.createDataFrame([(k, len(t), t) for k, t in tokens.items()], "key long, n long, tokens array<long>")
    pairs = [(k, h) for h in (0, 1) for k in range(2, 50)] + [(2, k) for k in range(50, 60)] + [(0, 1)] + [(k, k + 1) for k in range(50, 59)]
    got = neardup.verified(spark.createDataFrame(pairs, "a long, b long"), sets, Workspace(spark, "test"), "pairs").collect()
    links = [p for p in pairs if 100 * len(set(tokens[p[0]]) & set(tokens[p[1]])) >= 80 * len(set(tokens[p[0]]) | set(tokens[p[1]]))]
    assert sorted(tuple(sorted(r)) for r in got) == sorted(tuple(sorted(p)) for p in links) and 0 < len(links) < len(pairs)


def test_one_hub_is_verified_in_many_tasks(spark):
    sets = spark.range(3001).selectExpr("id AS key", "50L AS n", "transform(sequence(0, 49), x -> if(x = 0, -id, x)) AS tokens")
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions")}
    monkey = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "8"}
    try:
        for k, v in monkey.items():
            spark.conf.set(k, v)
        pairs = spark.range(1, 3001).selectExpr("id AS a", "0L AS b")
        tasks = neardup.verified(pairs, sets, Workspace(spark, "test"), "pairs").groupBy(F.spark_partition_id()).count().toPandas()["count"]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert tasks.sum() == 3000 and tasks.max() <= 2 * tasks.median()


def test_dedup_keeps_one_of_each(odd_docs, no_docs):
    kept = neardup.deduplicated(odd_docs)
    got = Counter(r.doc_id for r in kept.collect())
    assert kept.columns == odd_docs.columns and got[1] == 1 and 2 not in got and 3 not in got and got[None] == 2 and all(got[i] == 1 for i in (4, 5, 6, 7, 8, 9, 10))
    assert neardup.deduplicated(no_docs).count() == 0


# 7


def test_urls(spark):
    cases = {
        "http://a.b.NET/x?y": ("a.b.net", "/x", "net/", "block"), "https://q.example.net/en/1": ("q.example.net", "/en/1", "example.net/en/", "allow"), "x://example.com/de/": ("example.com", "/de/", "example.com/de/", "block"),
        "http://net": ("net", "", None, None), "http://y.org/fr/2#z": ("y.org", "/fr/2", "org/fr/", "allow"), "no url": ("", "", None, None), None: ("", "", None, "allow"), "": ("", "", None, "allow"),
        "http://xnet/": ("xnet", "/", None, None), "a://b://c.net/": ("b:", "//c.net/", None, None), "http://Ü.org?fr/": ("Ü.org", "", None, None),
    }
    df = spark.createDataFrame([(i, u, "h", 1.0) for i, u in enumerate(cases)] + [(0, "http://a.b.NET/x?y", "h", 1.0)], "page_id long, url string, host string, score double")
    got = urls.url_verdicts(df).collect()
    assert len(got) == len(cases) + 1
    for r in got:
        host, path, rule, verdict = cases[r.url]
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict in ({verdict} if verdict else {"allow", "block"})
    assert urls.url_verdicts(df.limit(0)).count() == 0


def test_url_model_learns(spark):
    rows = [(i, f"http://good{i % 17}.example.org/fr/page{i}") for i in range(200)] + [(i, f"http://casino-pills{i % 17}.net/{i}") for i in range(200)]
    rows += [(900, "http://good3.example.com/fr/page5"), (901, "http://casino-pills3.example.com/7")]
    got = {r.page_id: r.verdict for r in urls.url_verdicts(spark.createDataFrame(rows, "page_id long, url string")).filter("page_id >= 900").collect()}
    assert got == {900: "allow", 901: "block"}


# 8


def test_planes_round_trip():
    rng = np.random.default_rng(0)
    for mode in ("byte", "bit"):
        for n in (1, 7, 8, 16_384):
            for top in (1, 300, 50_257, 2**32):
                ids = rng.integers(0, top, n).astype("<u4")
                assert (planes.unpack(planes.pack(ids, mode), n, mode) == ids).all()


def test_encoding_equals_whole_texts(rows):
    from hypothesis import given, settings, strategies as st

    path = planes.tokenizer_path()
    t = planes._encoder(path).tokenizer
    whole = lambda x: t.encode(x, add_special_tokens=False).ids
    assert [e.tolist() for e in planes.encode(rows.text.tolist(), path)] == [whole(x) for x in rows.text]
    piece = st.sampled_from([*"ab'sé. \n\t\r0²\u3000\xa0\u0301<|>!漢ßT", " ", "  ", " a", "<|endoftext|>"])

    @settings(max_examples=300, deadline=None)
    @given(st.lists(st.lists(piece, max_size=12).map("".join), max_size=4))
    def same(texts):
        assert [e.tolist() for e in planes.encode(texts, path)] == [whole(x) for x in texts]

    same()


def test_store_on_odd_rows(spark, odd_docs, no_docs, tmp_path):
    path, tok = f"file://{tmp_path}/s", planes.tokenizer_path()
    for mode in ("byte", "bit"):
        planes.write_ids(odd_docs, path, tok, mode)
        got = sorted(planes.read_ids(spark, path).collect(), key=lambda r: r.start)
        want = [(r.doc_id, planes.encode([r.text], tok)[0].tolist() + [0]) for r in odd_docs.collect()]
        key = lambda x: (x[0] is not None, x[0] or 0, x[1])
        assert sorted(((r.doc_id, r.ids) for r in got), key=key) == sorted(want, key=key)
        assert [r.doc_id for r in got] == sorted((r.doc_id for r in got), key=lambda d: (d is not None, d or 0))
        assert [r.start for r in got] == np.concatenate([[0], np.cumsum([r.n_tokens for r in got])[:-1]]).tolist()
    crc = {r.start: r.ids_crc32 for r in planes.read_digests(spark, path).collect()}
    assert all(zlib.crc32(np.array(r.ids, dtype="<u4").tobytes()) == crc[r.start] for r in got)
    whole = [i for r in got for i in r.ids]
    for a, b in ((0, 1), (5, 40), (len(whole) - 3, len(whole) + 9), (0, len(whole))):
        parts = sorted((r.start, r.ids) for r in planes.read_range(spark, path, a, b).collect())
        assert [i for _, ids in parts for i in ids] == whole[a:b] and parts[0][0] == a
    planes.write_ids(no_docs, f"{path}0", tok)
    assert planes.read_ids(spark, f"{path}0").count() == 0


def test_ranges_cross_chunks_and_sections(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(planes, "BLOCK_IDS", 7)
    data = [planes._section(0, s, [s], [40], [np.arange(40, dtype="<u4") + 40 * s], "bit") for s in range(3)]
    assert all([b["n"] for b in d["blocks"]] == [7] * 5 + [5] and all(b["bytes"] == sum(map(len, b["planes"])) for b in d["blocks"]) for d in data)


def test_other_tokenizer_files_are_asked_for_whole_texts():
    import public_tokenizers

    e = planes._encoder(public_tokenizers.path("word_bpe_49k.json"))
    texts = ["Hello  World it's 2 words", "", "a b"]
    raw = [t.encode() for t in texts]
    got = e.encode(np.frombuffer(b"".join(raw), dtype=np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]))
    assert not e.by_words and [g.tolist() for g in got] == [e.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


# 9


def test_matrix_follows_its_law():
    """Chi-squared of a cell's counts over seeds against the hypergeometric law."""
    from math import comb

    got = Counter(int(shards.matrix([6, 10], 2, s)[0, 0]) for s in range(8000))
    want = {k: 8000 * comb(8, k) * comb(8, 6 - k) / comb(16, 6) for k in range(7)}
    assert sum((got[k] - w) ** 2 / w for k, w in want.items()) < 22.5  # 0.1 % of 6 degrees of freedom


def test_shards_rerun_and_without_broadcast(docs, monkeypatch):
    key = lambda df: sorted((r.doc_id, r.shard, r.slot) for r in df.select("doc_id", "shard", "slot").collect())
    a = key(shards.shuffled(docs))
    monkeypatch.setattr(shards, "MATRIX_BYTES", 0)
    assert a == key(shards.shuffled(docs)) and a != key(shards.shuffled(docs, seed=1))


@pytest.mark.parametrize("block", [65_536, 2])
def test_shards_are_exact(odd_docs, no_docs, docs, monkeypatch, block):
    monkeypatch.setattr(shards, "BLOCK_ROWS", block)
    for df, n in ((odd_docs, 5), (docs, 24)):
        out = shards.shuffled(df, n).toPandas()
        assert len(out) == df.count() and set(out.columns) == {*df.columns, "shard", "slot"}
        sizes = out.groupby("shard").slot.agg(list)
        assert len(sizes) == n and max(map(len, sizes)) - min(map(len, sizes)) <= 1 and all(sorted(s) == list(range(len(s))) for s in sizes)
    assert shards.shuffled(no_docs).count() == 0


def test_matrix_margins():
    counts = [5, 0, 1000, 17]
    m = shards.matrix(counts, 7, 1)
    assert m.sum(axis=1).tolist() == counts and m.sum(axis=0).max() - m.sum(axis=0).min() <= 1
    big = shards.matrix([10**10, 3, 2 * 10**9], 3, 1)
    assert big.sum(axis=1).tolist() == [10**10, 3, 2 * 10**9] and big.sum(axis=0).max() - big.sum(axis=0).min() <= 1 and (big >= 0).all()


def test_large_populations_are_drawn_exactly():
    rng, room = np.random.default_rng(4), np.array([10**8, 99 * 10**8])
    got = Counter(int(shards.draw(rng, room, 10)[0]) for _ in range(20_000))
    chance = [0.9044, 0.0914, 0.0042]  # of 10 rows, a hundredth each: 0, 1, 2
    assert all(abs(got[k] - 20_000 * p) < 5 * (20_000 * p) ** 0.5 for k, p in enumerate(chance))
    x = np.array([shards._count(rng, 4 * 10**9, 6 * 10**9, 10**8) for _ in range(400)])
    sd = (10**8 * 0.4 * 0.6 * 0.99) ** 0.5
    assert abs(x.mean() - 4 * 10**7) < 5 * sd / 20 and 0.8 < x.std() / sd < 1.2
    small = Counter(_inverted(rng, 7, 9, 6) for _ in range(20_000))
    exact = [84, 882, 2646, 2940, 1260, 189, 7]  # C(7, k) C(9, 6 - k) of C(16, 6)
    assert all(abs(small[k] - 20_000 * c / 8008) < 5 * (20_000 * c / 8008) ** 0.5 for k, c in enumerate(exact))
    for good, bad, n in ((10**12, 0, 5), (3, 10**12, 10**12 + 1), (10**12, 7, 10**12), (5 * 10**11, 5 * 10**11, 10**12)):
        assert max(0, n - bad) <= shards._count(rng, good, bad, n) <= min(good, n)


def _inverted(rng, good, bad, n):
    with pytest.MonkeyPatch.context() as m:
        m.setattr(shards, "_EXACT", 0)
        return shards._count(rng, good, bad, n)


def test_shards_digests(spark):
    docs = table(spark, SF, "documents").toPandas().set_index("doc_id")
    got = shards.op9_shards(spark, SF).toPandas()
    for d, size, crc in zip(got["doc_id"], got["size"], got["text_crc32"]):
        raw = docs.text[d].encode()
        assert (len(raw) + 8, zlib.crc32(raw)) == (size, crc)


def test_shards_digest_what_arrived(spark, monkeypatch):
    real = shards.shuffled
    monkeypatch.setattr(shards, "shuffled", lambda df, **k: real(df, **k).withColumn("text", F.concat("text", F.lit("!"))))
    docs = table(spark, SF, "documents").toPandas().set_index("doc_id")
    for r in shards.op9_shards(spark, SF).collect():
        raw = docs.text[r.doc_id].encode() + b"!"
        assert (r["size"], r.text_crc32) == (len(raw) + 8, zlib.crc32(raw))


# 10


def test_forward_sums_all_segmentations():
    vocab = language.vocabulary(language.vocabulary_path())
    rng = np.random.default_rng(2)
    logp = np.log(rng.dirichlet(np.ones(vocab[2]), 2).T + 1e-9)
    for word in ("the", "über", "漢\U0001f980x"):
        codes = np.array([language.MARK, *map(ord, word)], dtype=np.uint32)
        row = {(s, e): r[0] for s, e, r in language._lattice(codes[None, :], vocab) if r[0] >= 0}

        def total(at, k):
            return 1.0 if at == len(codes) else sum(np.exp(logp[r, k]) * total(e, k) for (s, e), r in row.items() if s == at)

        got = language.word_scores(codes[None, :], logp, vocab)[0]
        assert got == pytest.approx([np.log(total(0, 0)), np.log(total(0, 1))])


def test_long_words_are_scored_whole():
    """The rescaled pass against the plain one, across its steps, and against exact fractions of a long word."""
    vocab = language.vocabulary(language.vocabulary_path())
    logp = np.log(np.random.default_rng(5).dirichlet(np.ones(vocab[2]) * 0.3, 3).T + 1e-9)
    for word in ("international", "漢字" * 12, "a" * 30):
        codes = np.array([language.MARK, *map(ord, word)], dtype=np.uint32)
        assert language.long_score(codes, np.exp(logp), vocab) == pytest.approx(language.word_scores(codes[None, :], logp, vocab)[0])
    from fractions import Fraction

    codes = np.array([language.MARK, *map(ord, "thewordsofthis" * 9)], dtype=np.uint32)
    row = {(s, e): r[0] for s, e, r in language._lattice(codes[None, :], vocab) if r[0] >= 0}
    p, sums = np.exp(logp), [Fraction(1)] + [Fraction(0)] * len(codes)
    for s, e in sorted(row):
        sums[e] += sums[s] * Fraction(float(p[row[s, e], 0]))
    exact = np.log(float(sums[-1] * 10**300)) - 300 * np.log(10)
    assert language.long_score(codes, p, vocab)[0] == pytest.approx(exact)
    raw = ("ab" * 6000 + " cd").encode()
    total, n = language.score_rows(np.frombuffer(raw, dtype=np.uint8), np.array([0, len(raw)]), logp, vocab)
    assert n.tolist() == [2] and np.isfinite(total).all()


def test_fit_equals_brute_force_em():
    """One language, one round: expected piece counts over all segmentations of each word."""
    import pandas as pd

    vocab = language.vocabulary(language.vocabulary_path())
    words_ = {"the": 3, "then": 1, "über": 2}
    langs, logp = language._fit(pd.DataFrame([("en", w, c) for w, c in words_.items()], columns=["lang", "word", "count"]), vocab, 1)
    expected, start = np.full(vocab[2], language.PRIOR), 1 / vocab[2]
    for w, c in words_.items():
        codes = np.array([language.MARK, *map(ord, w)], dtype=np.uint32)
        row = {(s, e): r[0] for s, e, r in language._lattice(codes[None, :], vocab) if r[0] >= 0}

        def cuts(at):
            return [[]] if at == len(codes) else [[r, *rest] for (s, e), r in row.items() if s == at for rest in cuts(e)]

        ways = cuts(0)
        total = sum(start ** len(x) for x in ways)
        for x in ways:
            for r in x:
                expected[r] += c * start ** len(x) / total
    assert langs == ["en"] and np.exp(logp[:, 0]) == pytest.approx(expected / expected.sum())


@pytest.mark.parametrize("size", [20, 60, 5000])
def test_long_words_are_fitted_whole(size):
    """The rescaled expectations of one word equal the exact ones, and those of a word do not depend on its length's path."""
    vocab = language.vocabulary(language.vocabulary_path())
    rng = np.random.default_rng(size)
    word = np.array([language.MARK, *(ord(c) for c in "".join(rng.choice(["the", "and", "ing", "ü", "漢", "x"], size))[:size])], dtype=np.uint32)
    logp = np.log(rng.dirichlet(np.ones(vocab[2]), 2).T + 1e-9)
    weight, got = np.array([2.0, 0.5]), np.zeros((vocab[2], 2))
    language._long_expected(word, weight, logp, vocab, got)
    if size <= 60:  # plain sums stay within doubles here
        want = np.zeros_like(got)
        language._expected(word[None, :], weight[None, :], logp, vocab, want)
        assert np.allclose(got, want, rtol=1e-9, atol=1e-12)
    # every segmentation covers every character once: lengths of pieces times their counts give the word
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=language.vocabulary_path())
    length = [1] + [len(sp.id_to_piece(i)) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
    assert np.allclose(np.array(length) @ got, weight * len(word))
    assert np.allclose(language.long_score(word, np.exp(logp), vocab), language.long_forward(word, np.exp(logp), vocab)[-1])


def test_fit_uses_whole_long_words():
    """One word of three hundred letters has about one word-start piece, whatever its length."""
    import pandas as pd

    vocab = language.vocabulary(language.vocabulary_path())
    langs, logp = language._fit(pd.DataFrame([("en", "the" * 100, 1)], columns=["lang", "word", "count"]), vocab, 1)
    keys, rows = vocab[:2]
    expected = np.zeros((vocab[2], 1)) + language.PRIOR
    language._long_expected(np.array([language.MARK, *map(ord, "the" * 100)], dtype=np.uint32), np.ones(1), np.full((vocab[2], 1), -np.log(vocab[2])), vocab, expected)
    expected[0] = expected[0].mean()
    assert langs == ["en"] and np.exp(logp) == pytest.approx(expected / expected.sum())


def test_held_out_is_crc32(spark):
    got = spark.range(200).select("id", language.held_out("id").alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 3 == 1) for r in got)


def test_language_accuracy_and_edges(spark, odd_docs, no_docs):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    path = language.vocabulary_path()
    model = language.model_of(docs, path)
    got = language.identify(docs, model, path).filter(language.held_out("doc_id")).toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.98 and got.score.between(0, 1).all()
    odd = language.identify(odd_docs, model, path)
    found = [(r.text, r.lang_pred, r.score) for r in odd.collect()]
    assert len(found) == 13 and all((p == "und" and s == 0) == (not re.search(r"[^\W\d_]", t or "")) for t, p, s in found)
    assert language.identify(no_docs, model, path).count() == 0
    empty = language.train(no_docs.select("text", "lang"), path)
    assert {r.lang_pred for r in language.identify(odd_docs, empty, path).collect()} == {"und"}


def test_training_is_not_starved_by_copies(spark):
    hot = spark.range(20_000).select(F.lit("aa").alias("lang"), F.lit("one hot text").alias("text"))
    other = spark.createDataFrame([("aa", f"rare text {i}") for i in range(40)] + [("bb", f"other words {i}") for i in range(3)], "lang string, text string")
    langs, _ = language.train(hot.unionByName(other), language.vocabulary_path(), docs_per_lang=5, rounds=1)
    assert langs == ["aa", "bb"]
    drawn = Counter(r.lang for r in language.training_sample(hot.unionByName(other), 5).distinct().collect())
    assert drawn == {"aa": 5, "bb": 3}


def test_prediction_ignores_label_source_and_id(spark):
    docs = table(spark, SF, "documents")
    path = language.vocabulary_path()
    model = language.model_of(docs, path)
    a = {r.text: (r.lang_pred, r.score) for r in language.identify(docs, model, path).collect()}
    other = docs.withColumns({"lang": F.lit("xx"), "source": F.lit(None).cast("string"), "doc_id": -F.col("doc_id")})
    assert a == {r.text: (r.lang_pred, r.score) for r in language.identify(other, model, path).collect()}


def test_digest_is_sha256_of_spans(spark):
    df = secrets.op4_secret_scan(spark, SF).toPandas()
    texts = table(spark, SF, "documents").toPandas().set_index("doc_id").text
    for d, digest in zip(df.doc_id, df.base_sha256):
        line = ",".join(f"{k}:{s}:{e}" for s, _, e, k in base_spans(texts[d]))
        assert hashlib.sha256(line.encode()).hexdigest() == digest
