"""N-gram Jaccard join with adaptive multi-match prefixes, and its link components.

A text's set holds the distinct hashes of its five-word shingles (A-Z lower-cased; a shorter text
is one shingle). Two sets link when 100 |A & B| >= 80 |A | B|. The work is on distinct sets:

1. *First prefixes.* In hash order, linked sets share l tokens within their first
   n - ceil(0.8 n) + l ones, for any l. Each set's prefix is lengthened by l = n / 10; a set with too
   few prefix tokens that any other set has drops out. Only the tokens of these prefixes travel,
   packed by hash bucket; a token that several sets of one batch have travels once.
2. *Adaptive prefixes.* For the sets left, exact token frequencies among them put rare tokens
   first. A set with fewer than 0.8 n shared tokens drops out. Each other set picks the l with the
   least estimated cost - postings read, plus candidates to verify if they must match l times - and
   gets the prefix of that l; a pair must share as many prefix tokens as the smaller l of its two.
3. *Hubs.* Every prefix token names its most central set (the one with the most common tokens);
   sets are verified against their tokens' hubs only, and the links' components are taken. A group
   of near copies is thereby joined in as many comparisons as it has members.
4. *Rest.* Tokens whose sets are still in several components give the pairs across components.
   Sets with different reference hubs (the hub that most of a set's tokens name) are paired if they
   match often enough; sets of one hub are paired by the tokens in which they differ from it (see
   ``differing``). These pairs are verified, and the components are taken again. Every linked pair
   was therefore either verified or already connected.

Verification counts the exact intersection of both sets. Sets are told apart by 64-bit hashes of
their shingles' 64-bit hashes.

Edge cases: a null or empty text, or one of white space, has no shingles and is its own component;
so is a null id's (its component_id is then null unless a linked row has an id). Repeated rows and
equal texts form one set. Other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window as W

from millrace.llm.joins import HOT_BYTES, HOT_KEYS, HOT_ROWS, spread_join
from millrace.llm.store import Workspace
from millrace.llm.text import Words, mix, row_chunks, map_texts
from millrace.session import table

U64 = np.uint64
WORDS = 5
PERCENT = 80
LIFT = 10  # the first prefix is longer by one in LIFT tokens
BUCKET_TOKENS = 500_000  # prefix tokens handled in one task, about
CHUNK_SETS = 2048  # sets whose frequencies are looked up together, about
BROADCAST_ROWS = 1_000_000  # of two longs each; larger lists are joined by shuffles
VERIFY_COST = 8  # of a candidate, in postings
LOCAL = -1  # kind of a row with counts found within a batch


def least(n: int) -> int:
    """Tokens that a set linked with one of n must share with it."""
    return -(-PERCENT * n // 100)


def lift(n: int) -> int:
    return max(1, n // LIFT)


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _sets(data: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
    hashes, ptr = Words(data, off, lower=True).shingles(WORDS)
    return [np.unique(hashes[a:b]) for a, b in zip(ptr[:-1], ptr[1:], strict=True)]


def _key(s: np.ndarray) -> int:
    """A set's name: a hash of its hashes."""
    if not len(s):
        return 0
    return int(mix(np.array([mix(s).sum(dtype=np.uint64) + U64(len(s))], dtype=np.uint64)).view(np.int64)[0])


def named(df: DataFrame) -> DataFrame:
    """(doc_id, th, n, key) of each row: th names the text, key its set of n shingles."""

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, off in row_chunks(batches, "text"):
            sets = _sets(data, off)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array([_key(s) for s in sets], pa.int64())], names=["doc_id", "th", "n", "key"])

    return map_texts(df.select("doc_id", F.xxhash64("text").alias("th"), "text"), name, "doc_id bigint, th bigint, n bigint, key bigint")


def first_prefix(s: np.ndarray) -> np.ndarray:
    """The set's first tokens in hash order, longer by lift() than one match needs."""
    return s[: len(s) - least(len(s)) + lift(len(s))]


def _flat(column: pa.Array) -> np.ndarray:
    """The values of a list column of longs."""
    return column.flatten().to_numpy(zero_copy_only=False).view(np.uint64)


_REQUEST = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("tokens", pa.binary()), ("extra", pa.binary()), ("keys", pa.binary())])
_REQUEST_SQL = "bucket int, kind int, tokens binary, extra binary, keys binary"


def _bucket(tokens: np.ndarray, buckets: int) -> np.ndarray:
    """A token's bucket: ranges of the hash, so that sorted tokens are cut into runs."""
    return ((tokens >> U64(32)) * U64(buckets) >> U64(32)).astype(np.int64)


def _runs(sorted_tokens: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal tokens."""
    return np.flatnonzero(np.concatenate([[True], sorted_tokens[1:] != sorted_tokens[:-1]])) if len(sorted_tokens) else np.zeros(0, dtype=np.int64)


def shared_counts(df: DataFrame, buckets: int) -> DataFrame:
    """(key, shared): how many of a set's first-prefix tokens another set's first prefix has too."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, batch in enumerate(batches):
            own = {_key(s): first_prefix(s).copy() for _, data, off in row_chunks(iter([batch]), "text") for s in _sets(data, off) if len(s)}
            keys = np.array(list(own), dtype=np.int64)
            tokens = np.concatenate([np.zeros(0, dtype=np.uint64), *own.values()])
            owner = np.repeat(np.arange(len(keys), dtype=np.uint32), [len(s) for s in own.values()])
            order = np.argsort(tokens, kind="stable")
            tokens, owner = tokens[order], owner[order]
            start = _runs(tokens)
            many = np.diff(np.append(start, len(tokens))) > 1  # keys are distinct: several sets have it
            local = np.bincount(owner[np.repeat(many, np.diff(np.append(start, len(tokens))))], minlength=len(keys))
            tokens, owner = tokens[start], np.where(many, np.uint32(len(keys)), owner[start])
            rows = [{"bucket": b % buckets, "kind": LOCAL, "tokens": b"", "extra": local.astype(np.int64).tobytes(), "keys": keys.tobytes()}]
            cut = np.searchsorted(_bucket(tokens, buckets), np.arange(buckets + 1))
            for k in np.flatnonzero(np.diff(cut)):
                own = owner[cut[k] : cut[k + 1]]
                used, short = np.unique(own, return_inverse=True)
                names = np.append(keys, 0)[used]
                flag = used == len(keys)
                rows.append({"bucket": int(k), "kind": int(flag.any()), "tokens": tokens[cut[k] : cut[k + 1]].tobytes(), "extra": short.astype(np.uint32).tobytes(), "keys": names.tobytes()})
            yield pa.RecordBatch.from_pylist(rows, schema=_REQUEST)

    def answer(rows: pd.DataFrame) -> pd.DataFrame:
        out, tokens, names, many = [], [], [], []
        for kind, t, extra, keys in zip(rows["kind"], rows["tokens"], rows["extra"], rows["keys"], strict=True):
            own = np.frombuffer(keys, dtype=np.int64)
            if kind == LOCAL:
                out.append(pd.DataFrame({"key": own, "shared": np.frombuffer(extra, dtype=np.int64), "times": 1}))
                continue
            at = np.frombuffer(extra, dtype=np.uint32)
            tokens.append(np.frombuffer(t, dtype=np.uint64))
            names.append(own[at])
            many.append((at == len(own) - 1) if kind else np.zeros(len(at), dtype=bool))
        if tokens:
            tokens, names, many = map(np.concatenate, (tokens, names, many))
            order = np.argsort(tokens, kind="stable")
            start = _runs(tokens[order])
            lo, hi, some = np.minimum.reduceat(names[order], start), np.maximum.reduceat(names[order], start), np.logical_or.reduceat(many[order], start)
            shared = np.repeat((lo != hi) | some, np.diff(np.append(start, len(tokens))))
            key, n = np.unique(names[order][shared & ~many[order]], return_counts=True)
            out.append(pd.DataFrame({"key": key, "shared": n, "times": 0}))
        return pd.concat(out)

    asked = map_texts(df.select("text"), ask, _REQUEST_SQL)
    counted = asked.groupBy("bucket").applyInPandas(answer, "key bigint, shared bigint, times bigint").groupBy("key").agg(F.sum("shared").alias("shared"), F.sum("times").alias("times"))
    # a set met in several batches was counted in each
    return counted.select("key", (F.col("shared") / F.col("times")).cast("bigint").alias("shared"))


def full_sets(df: DataFrame, wanted: DataFrame, rows: int, chunks: int) -> DataFrame:
    """(c, key, n, tokens): each wanted set once, from one text of its class; c groups sets into chunks."""
    docs = df.select("text").withColumn("th", F.xxhash64("text")).join(_small(wanted.select("th"), rows), "th", "left_semi").select("text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for _, data, off in row_chunks(batches, "text"):
            sets = [(k, s) for s in _sets(data, off) if len(s) and (k := _key(s)) not in seen and not seen.add(k)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([k % chunks for k, _ in sets], pa.int64()), pa.array([k for k, _ in sets], pa.int64()), pa.array([len(s) for _, s in sets], pa.int64()), pa.array([s.view(np.int64) for _, s in sets], pa.list_(pa.int64()))],
                names=["c", "key", "n", "tokens"],
            )

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            keys = batch.column(1).to_pylist()
            fresh = [k != before for k, before in zip(keys, [last, *keys[:-1]], strict=True)]
            last = keys[-1] if keys else last
            yield batch.filter(pa.array(fresh))

    schema = "c bigint, key bigint, n bigint, tokens array<bigint>"
    return map_texts(docs, cut, schema).repartition("c").sortWithinPartitions("c", "key").mapInArrow(once, schema)


def choose(n: int, tokens: np.ndarray, df: np.ndarray) -> tuple[int, int, np.ndarray, float] | None:
    """(shared tokens, l, prefix, centrality) of a set of n with df >= 1 per token; None if nothing can link with it.

    Tokens of its own come first and match nothing, so only the shared part of a prefix is kept.
    """
    alone = int((df == 1).sum())
    shared = n - alone
    if shared < least(n):
        return None
    order = np.lexsort((tokens, df))[alone:]
    base = n - least(n) - alone  # shared tokens in a prefix of l are base + l
    ranked = df[order].astype(np.int64) - 1
    postings = np.cumsum(ranked)
    best, cost, size = 0, None, 1
    while base + size <= shared and size <= max(1, least(n)):
        if base + size >= 1:
            p = int(postings[base + size - 1])
            c = p + VERIFY_COST * p / size
            if cost is None or c < cost:
                best, cost = size, c
        size *= 2
    if not best:
        return None
    return shared, best, tokens[order[: base + best]], float(np.log2(df).sum() / n)


_CHOSEN = "key bigint, n bigint, shared bigint, l bigint, center double, prefix array<bigint>"


def adaptive_prefixes(sets: DataFrame, buckets: int) -> DataFrame:
    """The chosen prefix of every set that may link, from exact token frequencies among the sets."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chunk = batch.column(0).to_numpy(zero_copy_only=False)
            for c in np.unique(chunk):
                tokens, n = np.unique(_flat(batch.column(1).filter(pa.array(chunk == c))), return_counts=True)
                cut = np.searchsorted(_bucket(tokens, buckets), np.arange(buckets + 1))
                rows = [
                    {"bucket": int(k), "c": int(c), "tokens": tokens[cut[k] : cut[k + 1]].tobytes(), "n": n[cut[k] : cut[k + 1]].astype(np.uint32).tobytes()} for k in np.flatnonzero(np.diff(cut))
                ]
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("bucket", pa.int32()), ("c", pa.int64()), ("tokens", pa.binary()), ("n", pa.binary())]))

    def answer(rows: pd.DataFrame) -> pd.DataFrame:
        tokens = np.concatenate([np.frombuffer(t, dtype=np.uint64) for t in rows["tokens"]])
        n = np.concatenate([np.frombuffer(t, dtype=np.uint32) for t in rows["n"]])
        order = np.argsort(tokens, kind="stable")
        start = _runs(tokens[order])
        df = np.empty(len(tokens), dtype=np.uint32)
        df[order] = np.repeat(np.add.reduceat(n[order], start), np.diff(np.append(start, len(tokens))))
        ends = np.cumsum([len(t) // 8 for t in rows["tokens"]])
        out = []
        for c, a, b in zip(rows["c"], np.concatenate([[0], ends[:-1]]), ends, strict=True):
            more = df[a:b] > 1
            out.append((c, tokens[a:b][more].tobytes(), df[a:b][more].tobytes()))
        return pd.DataFrame(out, columns=["c", "tokens", "df"])

    def pick(own: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        known = np.concatenate([np.zeros(0, dtype=np.uint64), *(np.frombuffer(t, dtype=np.uint64) for t in answers["tokens"])])
        value = np.concatenate([np.zeros(0, dtype=np.uint32), *(np.frombuffer(t, dtype=np.uint32) for t in answers["df"])])
        order = np.argsort(known, kind="stable")  # a chunk read in two batches has two equal answers
        known, value = np.append(known[order], U64(2**64 - 1)), np.append(value[order], np.uint32(1))
        out = []
        for key, n, t in zip(own["key"], own["n"], own["tokens"], strict=True):
            tokens = np.asarray(t, dtype=np.int64).view(np.uint64)
            at = np.searchsorted(known, tokens)
            found = choose(int(n), tokens, np.where(known[at] == tokens, value[at], 1))
            if found:
                shared, l, prefix, center = found
                out.append((key, n, shared, l, center, prefix.view(np.int64)))
        return pd.DataFrame(out, columns=["key", "n", "shared", "l", "center", "prefix"])

    asked = sets.select("c", "tokens").mapInArrow(ask, "bucket int, c bigint, tokens binary, n binary")
    answers = asked.groupBy("bucket").applyInPandas(answer, "c bigint, tokens binary, df binary")
    return sets.groupBy("c").cogroup(answers.groupBy("c")).applyInPandas(pick, _CHOSEN)


def _may_link(a: str, b: str) -> str:
    """Size and shared-token bounds of a link: 100 o >= 80 (na + nb - o) needs o this large on both sides."""
    lo = f"least({a}.shared, {b}.shared)"
    return f"{100 + PERCENT} * {lo} >= {PERCENT} * ({a}.n + {b}.n)"


def _of(sets: DataFrame, keys: DataFrame, rows: int) -> DataFrame:
    """The sets named by ``keys`` (a column ``key``): sets are wide, so others are left out before any shuffle."""
    return sets.join(_small(keys.distinct(), rows), "key", "left_semi")


def _hot(pairs: DataFrame, sets: DataFrame, rows: int) -> DataFrame | None:
    """(key, n, tokens) of the sets that are in so many of the stored pairs that they must not meet them in one task.

    These are in over a HOT_KEYS-th part of all pairs; if their tokens exceed HOT_BYTES, only the hotter ones. None if there are none.
    """
    bar = max(HOT_ROWS, rows // HOT_KEYS)
    if rows <= bar:
        return None
    ends = pairs.select(F.col("a").alias("key")).unionByName(pairs.select(F.col("b").alias("key")))
    often = ends.groupBy("key").agg(F.count("*").alias("weight")).filter(F.col("weight") > bar)  # 2 x HOT_KEYS rows at most
    found = sets.select("key", "n").join(F.broadcast(often), "key").groupBy("weight").agg(F.count("*").alias("keys"), F.sum("n").alias("n")).orderBy(F.desc("weight")).collect()
    fits = used = 0
    for r in found:
        used += 8 * r["n"] + 64 * r["keys"]
        if used > HOT_BYTES:
            break
        fits = r["weight"]
    return sets.join(F.broadcast(often.filter(F.col("weight") >= fits).select("key")), "key").select("key", "n", "tokens") if fits else None


def verified(pairs: DataFrame, sets: DataFrame, space: Workspace, name: str) -> DataFrame:
    """The pairs whose sets link, counted exactly, each as (a, b) or (b, a).

    A set in many pairs - a hub - is sent to every executor once, and its pairs stay where their other sets are.
    """
    pairs = space.put(pairs, name)
    rows = pairs.count()

    def side(df: DataFrame, c: str) -> DataFrame:
        return df.select(F.col("key").alias(c), F.col("n").alias(f"n{c}"), F.col("tokens").alias(f"t{c}"))

    def met(some: DataFrame, *c: str) -> DataFrame:
        for x in c:
            some = some.join(side(_of(sets, some.select(F.col(x).alias("key")), rows), x), x)
        return some

    hot = _hot(pairs, sets, rows)
    if hot is None:
        both = met(pairs, "a", "b")
    else:
        hot = space.put(hot, f"{name}-hubs", "none")
        told = pairs
        for x in ("a", "b"):
            told = told.join(F.broadcast(hot.select(F.col("key").alias(x), F.lit(1).alias(f"hot_{x}"))), x, "left")
        hubs = F.coalesce("hot_a", F.lit(0)) + F.coalesce("hot_b", F.lit(0))
        first = F.col("hot_a").isNotNull() & F.col("hot_b").isNull()
        told = told.select(F.when(first, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(first, F.col("a")).otherwise(F.col("b")).alias("b"), hubs.alias("hubs"))
        told = space.put(told, f"{name}-told")
        one = met(told.filter("hubs = 1").select("a", "b"), "a").join(F.broadcast(side(hot, "b")), "b")
        two = told.filter("hubs = 2").select("a", "b").join(F.broadcast(side(hot, "a")), "a").join(F.broadcast(side(hot, "b")), "b")
        both = met(told.filter("hubs = 0").select("a", "b"), "a", "b").unionByName(one).unionByName(two)
    return both.filter((100 + PERCENT) * F.size(F.array_intersect("ta", "tb")) >= PERCENT * (F.col("na") + F.col("nb"))).select("a", "b")


def connected(edges: DataFrame, space: Workspace, label: str) -> DataFrame:
    """(key, comp) of the keys in edges (a, b): alternating large and small stars until nothing moves.

    Each star step sends a key's neighbours to the least key it sees, by aggregates and joins only,
    so that a hub of any degree is handled by partial sums and splittable joins. Each step's
    edges are written to the shared folder, which cuts the lineage.
    """
    now = space.put(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{label}-0")
    state, step = None, 0
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.unionByName(low.filter("m < u").select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        step += 1
        after = space.put(small.filter("u <> v").distinct(), f"{label}-{step}")
        new = tuple(after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.countDistinct("u")).first())
        space.drop(f"{label}-{step - 1}")
        if new == state or not new[0]:
            break
        state, now = new, after
    return after.select(F.col("u").alias("key"), F.col("v").alias("comp")).unionByName(after.select(F.col("v").alias("key"), F.col("v").alias("comp")).distinct())


def components(df: DataFrame, space: Workspace) -> tuple[DataFrame, DataFrame]:
    """(rows, labels): (doc_id, th, n, key) of each row of ``df``, and (key, comp) of the linked sets."""
    rows = space.put(named(df), "rows")
    classes = rows.filter("n > 0").groupBy("key").agg(F.first("n").alias("n"), F.min("th").alias("th"))
    tokens = rows.agg(F.sum(F.col("n") * (100 - PERCENT) / 100 + F.col("n") / LIFT + 2)).first()[0] or 0
    # lift() of the smallest set that may link with one of n
    some = F.greatest(F.lit(1), F.floor(F.ceil(F.col("n") * PERCENT / 100) / LIFT))
    alive = space.put(shared_counts(df, int(tokens // BUCKET_TOKENS) + 1).join(classes, "key").filter(F.col("shared") >= some).select("key", "n", "th"), "alive")
    left, size = alive.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    sets = space.put(full_sets(df, alive, left, left // CHUNK_SETS + 1), "sets", "none")
    chosen = space.put(adaptive_prefixes(sets, size // BUCKET_TOKENS + 1), "chosen")
    post = chosen.select("key", "n", "shared", "l", "center", F.explode("prefix").alias("token"))

    hubs = post.groupBy("token").agg(F.max_by(F.struct("key", "n", "shared"), F.struct("center", "key")).alias("h")).select("token", "h.*")
    named_by = post.alias("p").join(hubs.alias("h"), "token")
    near = named_by.filter(f"p.key <> h.key AND {_may_link('p', 'h')}").select(F.col("p.key").alias("a"), F.col("h.key").alias("b")).distinct()
    links = space.put(verified(near, sets, space, "hub-pairs"), "links")
    labels = connected(links, space, "hub-components")
    votes = named_by.groupBy(F.col("p.key").alias("key"), F.col("h.key").alias("h")).count()
    refs = votes.groupBy("key").agg(F.max_by("h", F.struct("count", "h")).alias("ref"))

    told = post.join(labels, "key", "left").withColumn("comp", F.coalesce("comp", "key"))
    open_ = told.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("token")
    rest = space.put(told.join(open_, "token").join(refs, "key").select("token", "key", "n", "shared", "l", "comp", "ref"), "rest")
    across = rest.alias("x").join(rest.alias("y"), F.expr(f"x.token = y.token AND x.comp < y.comp AND x.ref <> y.ref AND {_may_link('x', 'y')}"))
    pairs = across.groupBy(F.col("x.key").alias("a"), F.col("y.key").alias("b")).agg(F.count("*").alias("m"), F.first(F.least("x.l", "y.l")).alias("l")).filter("m >= l").select("a", "b")
    members = space.put(rest.select("key", "n", "comp", "ref").distinct(), "members")
    pairs = pairs.unionByName(differing(members, members.count(), labels, sets, space))
    more = space.put(verified(pairs, sets, space, "rest-pairs"), "rest-links")
    if more.isEmpty():
        return rows, labels
    return rows, connected(links.unionByName(more), space, "components")


def differing(members: DataFrame, rows: int, labels: DataFrame, sets: DataFrame, space: Workspace) -> DataFrame:
    """Candidate pairs (a, b) of one reference hub and different components, by what sets them apart from the hub.

    With D the tokens that a set and the hub do not share, |A ^ B| = |Da| + |Db| - 2 |Da & Db|, and
    A links with B when |A ^ B| <= q (|A| + |B|), q = (100 - P) / (100 + P). Sets linked with the hub
    are one component, so one of the two, B, is not: |Db| > q (|B| + |H|). Then Da and Db share more
    than half of |Da| - q (|A| - |H|) tokens, whatever A is, and at least half of |Db| - q (|B| + |H|).
    Prefixes of the D (rarest tokens first) of matching lengths find the pairs: a short one to meet
    sets that are not linked with the hub, a long one for these to meet those that are. What most of
    a group has in common with its hub, and hence with each other, is in no D.
    """
    q = (100 - PERCENT) / (100 + PERCENT)
    own = _of(sets, members.select("key"), rows).select("key", F.col("tokens").alias("t"))
    hub = _of(sets, members.select(F.col("ref").alias("key")), rows).select(F.col("key").alias("ref"), F.col("tokens").alias("th"), F.col("n").alias("nh"))
    hub = hub.join(labels.select(F.col("key").alias("ref"), F.col("comp").alias("hub_comp")), "ref", "left")
    # each hub's set meets its members once; the hubs with most members by broadcast, as far as their sets fit
    hub = space.put(hub.join(members.groupBy("ref").agg(F.count("*").alias("weight")), "ref"), "hubs")
    d = spread_join(space.put(members.join(own, "key"), "hub-members", "none"), hub, "ref", rows, 8 * F.col("nh") + 64)
    d = d.withColumn("linked", F.col("comp") == F.coalesce("hub_comp", "ref")).withColumn("d", F.concat(F.array_except("t", "th"), F.array_except("th", "t")))
    size = F.size("d")
    far = F.ceil((size - q * (F.col("n") + F.col("nh"))) / 2 - 1e-9)
    close = F.floor((size - q * (F.col("n") - F.col("nh"))) / 2 - 1e-9) + 1
    d = d.withColumns({"short": size - F.greatest(F.lit(1), close) + 1, "long": size - F.greatest(F.lit(1), far) + 1})
    d = d.withColumn("long", F.when(F.col("linked"), F.col("short")).otherwise(F.greatest("short", "long"))).select("ref", "key", "comp", "linked", "short", "long", F.explode("d").alias("token"))
    often = d.groupBy("ref", "token").agg(F.count("*").alias("df")).filter("df > 1")
    # tokens of one set only match nothing, but they come first and use up the prefix
    ranked = d.join(often, ["ref", "token"], "left").withColumn("r", F.row_number().over(W.partitionBy("key").orderBy(F.col("df").asc_nulls_first(), "token")))
    prefix = ranked.filter("r <= long AND df IS NOT NULL").select("ref", "token", "key", "comp", "linked", (F.col("r") <= F.col("short")).alias("early"))
    meets = "x.comp < y.comp AND NOT (x.linked AND y.linked) AND (y.linked OR x.early) AND (x.linked OR y.early)"
    hit = prefix.alias("x").join(prefix.alias("y"), F.expr(f"x.ref = y.ref AND x.token = y.token AND {meets}"))
    return hit.select(F.col("x.key").alias("a"), F.col("y.key").alias("b")).distinct()


def classes(rows: DataFrame, labels: DataFrame, space: Workspace, first) -> tuple[DataFrame, int]:
    """(key, comp, first, weight) of every set, and the rows of all: ``first`` is the least of its component's rows by that column.

    Minima are partial sums of rows, then of sets; a component or set of any size is split.
    """
    own = rows.filter("n > 0").groupBy("key").agg(F.count("*").alias("rows"), F.min(first).alias("own"))
    own = own.join(labels, "key", "left").withColumn("comp", F.coalesce("comp", "key"))
    own = space.put(own, "class-rows")
    firsts = space.put(own.groupBy("comp").agg(F.min("own").alias("first"), F.count("*").alias("weight")), "firsts")
    sets, total = firsts.agg(F.coalesce(F.sum("weight"), F.lit(0))).first()[0], own.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    return space.put(spread_join(own, firsts, "comp", sets).select("key", "comp", "first", F.col("rows").alias("weight")), "classes"), total


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's set size and the smallest id reachable by links."""
    space = Workspace(spark, "neardup")
    rows, labels = components(table(spark, sf_dir, "documents").select("doc_id", "text"), space)
    own, total = classes(rows, labels, space, F.col("doc_id"))
    found = spread_join(rows.filter("n > 0"), own, "key", total).select("doc_id", F.col("n").alias("n_shingles"), F.col("first").alias("component_id"))
    return found.unionByName(rows.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def deduplicated(df: DataFrame) -> DataFrame:
    """The rows of ``df`` with one row of each component: that of the smallest id (nulls last), then text hash."""
    space = Workspace(df.sparkSession, "neardup")
    rows, labels = components(df.select("doc_id", "text"), space)
    ranked = F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "th")
    own, total = classes(rows, labels, space, ranked)
    marked = spread_join(rows.filter("n > 0"), own, "key", total).groupBy("doc_id", "th").agg(F.first("first").alias("f"), F.count("*").alias("times"))
    marked = marked.withColumn("stays", F.col("doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("th") == F.col("f.th")))
    gone = space.put(marked.filter("NOT stays OR times > 1").select(F.col("doc_id").alias("_d"), F.col("th").alias("_th"), "stays"), "gone")
    n = gone.count()
    on = F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_t") == F.col("_th"))
    named = df.withColumn("_t", F.xxhash64("text"))
    kept = named.join(_small(gone.drop("stays"), n), on, "left_anti")
    if gone.filter("stays").isEmpty():
        return kept.drop("_t")
    twins = gone.filter("stays").drop("stays")
    return kept.unionByName(named.join(_small(twins, n), on, "left_semi").dropDuplicates(["doc_id", "_t"])).drop("_t")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each near-duplicate group stays."""
    return deduplicated(docs).select(*docs.columns)


_SQL = rf"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
sh AS (SELECT DISTINCT doc_id, hash(CASE WHEN len(ws) < {WORDS} THEN ws ELSE ws[i:i + {WORDS - 1}] END) AS s
       FROM (SELECT *, unnest(range(1, greatest(len(ws) - {WORDS - 1}, 1) + 1)) AS i FROM words WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
          GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= {PERCENT} * (na.n + nb.n - count(*))),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(r.b) AS component_id FROM documents d LEFT JOIN n USING (doc_id) JOIN reach r ON r.a = d.doc_id GROUP BY d.doc_id, n.n
"""

QUERIES = {"op6_jaccard_join": op6_jaccard_join}
SQL = {"op6_jaccard_join": _SQL}
