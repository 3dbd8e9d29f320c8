"""Language-model scoring by a weighted backoff automaton.

A text is its lower-cased words and one end. The model is an n-gram model of order three. The chance of
a token after nothing is the add-one estimate (c + 1) / (N + V + 1); after one or two tokens it is
(c(context, token) + K * chance in the shorter context) / (c(context) + K), where K is the number of distinct
n-grams of that length over that of the next shorter one, 1 at least (Witten-Bell smoothing with pooled types). Every context
that training saw is a state; every n-gram that it saw is an arc with its whole chance; a token without an
arc goes over the failure arc to the state of the shorter context, at the price K / (c + K). One left-to-right
traversal of a text carries the state and adds up log10 of what it passes. Chances of all tokens and of one
unknown token sum to 1 in every state.

Scale. The n-grams grow with the corpus, so no task and no driver holds the model:

* documents are packed, as they are read, into blocks of about ``BLOCK_BYTES``, one row each, in a stored table;
* every block asks for its distinct n-grams: 54 bits of their hashes, sorted and cut into hash buckets, with how
  often its own training documents have them. A bucket adds up what the blocks report and answers every
  block with the totals in the order it asked: the hashes travel once, the answers are counts alone;
* a block and its answers meet, and the block builds the part of the automaton that its texts can reach - all
  states and arcs of the model that they use - and runs its texts through it.

A block reports an n-gram once, so no bucket has a hot entry; the number of buckets grows with the bytes, so a
bucket has a bounded share. Of the whole model the driver sees four sums. Long texts are traversed in runs
of ``RUN`` tokens at once: a run starts two tokens early, which is all that a state remembers.

Edge cases: a null text is empty: one token, its end. Documents with null ids are training documents. Without
training documents N and V are 0 and every token has chance 1. Equal rows are scored each; in training they
count each. Extra columns are left out; an empty table gives an empty result. One text is held whole. Of 1e9
distinct n-grams some 30 share their name with another.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from millrace.llm.store import Workspace
from millrace.llm.text import Words, bytes_of, chunks, map_texts, mix
from millrace.session import table

U64 = np.uint64
BLOCK_BYTES = 8 << 20  # some 300 MB of a worker's arrays while its n-grams are sorted
BUCKET_BYTES = 4 << 20  # of text whose n-grams a bucket has on average
MIN_BUCKETS = 256  # so that the first byte of a hash is known from its bucket
RUN = 512  # tokens of one run of the traversal
START, END = U64(0x5851F42D4C957F2D), U64(0x14057B7EF767814F)
BITS = 56  # of an n-gram's name
KINDS = 4  # start, token, pair, triple: the low bits of an n-gram's hash
SUMS = ("tokens", "types", "pairs", "triples")  # training tokens; distinct tokens, pairs and triples in training
ANSWER = "bucket int, block long, counts binary, " + ", ".join(f"{c} long" for c in SUMS)


def held_out(doc_id: str, of: int = 7, rest: int = 2) -> Column:
    """True where crc32(doc_id as text) mod ``of`` is ``rest`` (null ids: false)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % of == rest, F.lit(False))


# blocks


def blocks(docs: DataFrame, limit: int = BLOCK_BYTES) -> DataFrame:
    """(block, size, doc_id, held, text): rows of ``docs`` (doc_id, held, text) packed as they come, each block one row of lists."""
    kinds = [pa.int64(), pa.bool_(), pa.string()]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first, waiting, size, n = TaskContext.get().partitionId() << 32, [], 0, 0

        def close() -> pa.RecordBatch:
            whole = [pa.concat_arrays([w.column(k).cast(kinds[k]) for w in waiting]) for k in range(3)]
            edge = pa.array([0, len(whole[0])], pa.int32())
            lists = [pa.ListArray.from_arrays(edge, w) for w in whole]
            return pa.RecordBatch.from_arrays([pa.array([first + n]), pa.array([size]), *lists], names=["block", "size", "doc_id", "held", "text"])

        for batch in batches:
            _, off = bytes_of(batch.column(2))
            at = 0
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(off, off[at] + limit - size, "right")) - 1)
                waiting.append(batch.slice(at, to - at))
                size, at = size + int(off[to] - off[at]), to
                if size >= limit:
                    yield close()
                    waiting, size, n = [], 0, n + 1
        if waiting:
            yield close()

    return map_texts(docs.select("doc_id", "held", "text"), pack, "block long, size long, doc_id array<long>, held array<boolean>, text array<string>")


@dataclass
class Grams:
    """The tokens of one block and their n-grams. Row r has tokens ptr[r]:ptr[r+1], the last its end.

    ``keys`` are the block's distinct n-gram hashes, sorted; ``token``, ``pair`` and ``triple`` are, for each
    token, the places in ``keys`` of the n-grams that end with it (-1: a triple before the start); ``start``
    is the place of the start.
    """

    ptr: np.ndarray
    keys: np.ndarray
    token: np.ndarray
    pair: np.ndarray
    triple: np.ndarray
    start: int

    @classmethod
    def of(cls, text: pa.Array) -> "Grams":
        data, off = bytes_of(text)
        hashes, sizes = [np.zeros(0, dtype=np.uint64)], [np.zeros(0, dtype=np.int64)]
        for i, j in chunks(off):
            words = Words(data[off[i] : off[j]], off[i : j + 1] - off[i], lower=True)
            hashes.append(words.hashes())
            sizes.append(np.diff(words.ptr))
        n = np.concatenate(sizes)
        ptr = np.concatenate([[0], np.cumsum(n + 1)])
        own = np.empty(int(ptr[-1]), dtype=np.uint64)
        last = np.zeros(len(own), dtype=bool)
        last[ptr[1:] - 1] = True
        own[~last], own[last] = np.concatenate(hashes), END
        before = np.empty_like(own)
        before[1:] = own[:-1]
        before[ptr[:-1]] = START
        two = np.empty_like(own)  # the token two before
        two[1:] = before[:-1]
        third = np.arange(len(own)) - np.repeat(ptr[:-1], n + 1) > 0
        pairs = _joined(before, own)
        triples = _joined(_joined(two, before), own)[third]
        every = np.concatenate([[_kind(START, 0)], _kind(own, 1), _kind(pairs, 2), _kind(triples, 3)])
        m, triple = len(own), np.full(len(own), -1)
        del hashes, own, before, two, pairs, triples
        keys, place = np.unique(every, return_inverse=True)
        triple[third] = place[1 + 2 * m :]
        return cls(ptr, keys, place[1 : 1 + m], place[1 + m : 1 + 2 * m], triple, int(place[0]))

    def counted(self, rows: np.ndarray) -> np.ndarray:
        """How often the given rows (booleans) have each n-gram."""
        use = np.repeat(rows, np.diff(self.ptr))
        out = np.zeros(len(self.keys), dtype=np.int64)
        for place in (self.token, self.pair, self.triple):
            out += np.bincount(place[use & (place >= 0)], minlength=len(out))
        out[self.start] = rows.sum()
        return out


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * U64(0x9E3779B97F4A7C15) + b)


def _kind(h: np.ndarray, kind: int) -> np.ndarray:
    """An n-gram's name: 54 bits of its hash and its kind."""
    return h >> U64(64 - BITS) & U64(2**64 - KINDS) | U64(kind)


def planes(values: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of 64-bit values, all first ones, then all second ones: what repeats lies together."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def values(packed: bytes, width: int) -> np.ndarray:
    """What ``planes`` wrote."""
    n = len(packed) // width
    out = np.zeros((n, 8), dtype=np.uint8)
    out[:, :width] = np.frombuffer(packed, dtype=np.uint8).reshape(width, n).T
    return out.view("<u8").reshape(n)


def packed_counts(counts: np.ndarray) -> bytes:
    """Counts in compressed planes, as many as the largest needs; their number comes first."""
    width = max(1, (int(counts.max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + zstandard.ZstdCompressor(level=1).compress(planes(counts, width))


def counts_of(packed: bytes) -> np.ndarray:
    return values(zstandard.ZstdDecompressor().decompress(packed[1:]), packed[0]).astype(np.int64)


def requests(stored: DataFrame, buckets: int) -> DataFrame:
    """(bucket, block, hashes, counts): what every block asks of every bucket."""
    bits = buckets.bit_length() - 1

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                grams, held = Grams.of(batch.column(2)[r].values), batch.column(1)[r].values
                counts = grams.counted(~np.asarray(held, dtype=bool))
                cut = np.searchsorted(grams.keys >> U64(BITS - bits), np.arange(buckets + 1, dtype=np.uint64))
                some = np.flatnonzero(np.diff(cut))
                parts = [(planes(grams.keys[cut[b] : cut[b + 1]], 6), packed_counts(counts[cut[b] : cut[b + 1]])) for b in some]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(some.astype(np.int32)), pa.array(np.full(len(some), batch.column(0)[r].as_py(), dtype=np.int64)), pa.array([h for h, _ in parts], pa.binary()), pa.array([c for _, c in parts], pa.binary())],
                    names=["bucket", "block", "hashes", "counts"],
                )

    return stored.select("block", "held", "text").mapInArrow(ask, "bucket int, block long, hashes binary, counts binary")


def answers(asked: DataFrame, buckets: int) -> DataFrame:
    """(bucket, block, counts) for every request, and one row a bucket (block null) with sums of the model's part there."""
    shift = buckets.bit_length() - 1 - 8

    def add_up(part: pa.Table) -> pa.Table:
        bucket, block = part.column("bucket")[0].as_py(), part.column("block")
        keys = [values(h, 6) | U64((bucket >> shift) << 48) for h in part.column("hashes").to_pylist()]
        own, place = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.zeros(len(own), dtype=np.int64)
        np.add.at(total, place, np.concatenate([counts_of(c) for c in part.column("counts").to_pylist()]))
        ends = np.cumsum([0, *map(len, keys)])
        replies = [packed_counts(total[place[a:b]]) for a, b in zip(ends[:-1], ends[1:])]
        kind, seen = own & U64(KINDS - 1), total > 0
        of = lambda k: int((seen & (kind == k)).sum())
        sums = [int(total[kind == 1].sum()), of(1), of(2), of(3)]
        none = pa.nulls(len(replies), pa.int64())
        columns = [pa.concat_arrays([block.combine_chunks(), pa.nulls(1, pa.int64())]), pa.array([*replies, None], pa.binary())]
        columns += [pa.concat_arrays([none, pa.array([s], pa.int64())]) for s in sums]
        return pa.Table.from_arrays([pa.array(np.full(len(replies) + 1, bucket, dtype=np.int32)), *columns], names=["bucket", "block", "counts", *SUMS])

    return asked.groupBy("bucket").applyInArrow(add_up, ANSWER)


# the automaton


@dataclass
class Model:
    """What the whole model has: training tokens, distinct ones, and K for contexts of one and of two tokens."""

    tokens: int
    types: int
    after_one: float
    after_two: float


def model_of(answered: DataFrame) -> Model:
    s = answered.filter("block is null").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in SUMS)).first()
    return Model(s["tokens"], s["types"], max(1.0, s["pairs"] / max(1, s["types"])), max(1.0, s["triples"] / max(1, s["pairs"])))


class Automaton:
    """The part of the model that a block can reach.

    State 0 has no context. ``keys`` are state * tokens + token of the arcs, sorted; ``to`` and ``gain`` their
    targets and log10 chances; ``fall`` and ``price`` every state's failure arc. ``first`` is the state of a text's
    beginning. ``base`` and ``known`` tell each local token's add-one log10 chance, and whether training had it.
    """

    def __init__(self, grams: Grams, count: np.ndarray, model: Model):
        names, self.token = np.unique(grams.token, return_inverse=True)
        n = len(names)
        end = int(np.searchsorted(names, np.searchsorted(grams.keys, _kind(END, 1))))
        # contexts of one token, then the start, then contexts of two tokens
        one = np.full(n + 1, 0)
        alive = np.concatenate([count[names] > 0, [count[grams.start] > 0]])
        alive[end] = False
        one[alive] = 1 + np.arange(alive.sum())
        pairs, at = np.unique(grams.pair, return_index=True)
        ends_text = self.token[at] == end
        left = np.full(len(grams.token), n)
        left[1:] = self.token[:-1]
        left[grams.ptr[:-1]] = n
        two = np.where((count[pairs] > 0) & ~ends_text, 0, -1)
        some = two == 0
        two[some] = 1 + alive.sum() + np.arange(some.sum())
        two[~some] = 0
        states = 1 + int(alive.sum()) + int(some.sum())
        self.size, self.first = n, one[n]
        # chances of tokens, of pairs and of triples
        chance = (count[names] + 1) / (model.tokens + model.types + 1)
        self.base, self.known = np.log10(chance), count[names] > 0
        context = np.concatenate([count[names], [count[grams.start]]])
        a, b = left[at], self.token[at]
        by_pair = (count[pairs] + model.after_one * chance[b]) / (context[a] + model.after_one)
        triples, first = np.unique(grams.triple[grams.triple >= 0], return_index=True)
        t = np.flatnonzero(grams.triple >= 0)[first]
        head, tail = np.searchsorted(pairs, grams.pair[t - 1]), np.searchsorted(pairs, grams.pair[t])
        by_triple = (count[triples] + model.after_two * by_pair[tail]) / (count[pairs[head]] + model.after_two)
        # arcs: all tokens without a context; seen pairs; seen triples
        p, q = count[pairs] > 0, count[triples] > 0
        source = np.concatenate([np.zeros(n, dtype=np.int64), one[a[p]], two[head[q]]])
        token = np.concatenate([np.arange(n), b[p], self.token[t[q]]])
        target = np.concatenate([one[:n], np.where(two[p] > 0, two[p], 0), np.where(two[tail[q]] > 0, two[tail[q]], 0)])
        keys = source * n + token
        order = np.argsort(keys, kind="stable")
        self.keys, self.to = keys[order], target[order]
        self.gain = np.log10(np.concatenate([chance, by_pair[p], by_triple[q]]))[order]
        self.fall, self.price = np.zeros(states, dtype=np.int64), np.zeros(states)
        self.price[one[alive]] = np.log10(model.after_one / (context[alive] + model.after_one))
        self.fall[two[some]] = one[b[some]]
        self.price[two[some]] = np.log10(model.after_two / (count[pairs[some]] + model.after_two))

    def step(self, state: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(next states, log10 chances) of one token each; a token without an arc takes failure arcs until it has one."""
        out, gain, state = np.zeros_like(state), np.zeros(len(state)), state.copy()
        rest = np.arange(len(state))
        while len(rest):
            key = state[rest] * self.size + token[rest]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[at] == key
            done = rest[hit]
            gain[done] += self.gain[at[hit]]
            out[done] = self.to[at[hit]]
            rest = rest[~hit]
            gain[rest] += self.price[state[rest]]
            state[rest] = self.fall[state[rest]]
        return out, gain

    def traverse(self, ptr: np.ndarray) -> np.ndarray:
        """Log10 chances of all tokens of the rows ptr."""
        runs = -(-np.diff(ptr) // RUN)
        row = np.repeat(np.arange(len(runs)), runs)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(runs) - runs, runs)
        begin, stop = ptr[row] + nth * RUN, np.minimum(ptr[row] + (nth + 1) * RUN, ptr[row + 1])
        state = np.where(nth == 0, self.first, 0)
        for back in (2, 1):  # a later run first reads the two tokens that its state remembers
            late = np.flatnonzero(nth > 0)
            state[late] = self.step(state[late], self.token[begin[late] - back])[0]
        order = np.argsort(begin - stop, kind="stable")  # longest first: those still running are a prefix
        begin, stop, state = begin[order], stop[order], state[order]
        size, out = stop - begin, np.zeros(len(self.token))
        for i in range(int(size[0]) if len(size) else 0):
            running = int(np.searchsorted(-size, -i, "left"))
            here = begin[:running] + i
            state[:running], out[here] = self.step(state[:running], self.token[here])
        return out


def scores(stored: DataFrame, answered: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, base_score, score) of every document."""

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        columns = [[] for _ in range(6)]
        for r in range(left.num_rows):  # one: blocks are rows
            text = left.column("text").combine_chunks()[r].values
            grams = Grams.of(text)
            order = np.argsort(right.column("bucket").to_numpy(), kind="stable")
            replies = right.column("counts").to_pylist()
            count = np.concatenate([counts_of(replies[i]) for i in order])
            auto = Automaton(grams, count, model)
            gain, n = auto.traverse(grams.ptr), np.diff(grams.ptr)
            total = lambda x: np.add.reduceat(x, grams.ptr[:-1])  # noqa: E731  every row has a token
            found = [left.column("doc_id").combine_chunks()[r].values, left.column("held").combine_chunks()[r].values, n, total(auto.known[auto.token].astype(np.int64)), total(auto.base[auto.token]), total(gain)]
            for c, x in zip(columns, found):
                c.append(x if isinstance(x, pa.Array) else pa.array(x))
        return pa.Table.from_arrays([pa.concat_arrays(c) for c in columns], names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    told = answered.filter("block is not null").select("block", "bucket", "counts")
    return stored.select("block", "doc_id", "held", "text").groupBy("block").cogroup(told.groupBy("block")).applyInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")


def score_documents(docs: DataFrame, label: str = "backoff", block_bytes: int = BLOCK_BYTES, bucket_bytes: int = BUCKET_BYTES) -> tuple[DataFrame, Model]:
    """(scores, model) of ``docs`` (doc_id, held, text), trained on the rows that are not held."""
    space = Workspace(docs.sparkSession, label)
    # rows are blocks: few to a row group, so that a reader holds few at once
    stored = space.put(blocks(docs, block_bytes), "blocks", **{"parquet.block.row.count.limit": "2"})
    size = stored.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    buckets = max(MIN_BUCKETS, 1 << (size // bucket_bytes).bit_length())
    answered = space.put(answers(requests(stored, buckets), buckets), "answers")
    model = model_of(answered)
    return scores(stored, answered, model), model


def op11_backoff_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's base and model log10 probability."""
    docs = table(spark, sf_dir, "documents").select("doc_id", held_out("doc_id").alias("held"), "text")
    found, model = score_documents(docs)
    rounded = {c: F.round(c, 6) for c in ("base_score", "score")}
    return found.withColumns({**rounded, "train_tokens": F.lit(model.tokens).cast("long")}).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


#: crc32 of the id's digits, bit by bit: DuckDB has none.
_CRC = "xor(list_reduce([4294967295] || list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)), lambda s, b: list_reduce([xor(s, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, i: xor(a >> 1, (a & 1) * 3988292384))), 4294967295)"

_ORACLE = f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce({_CRC} % 7 = 2, false) AS held,
list_append(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+'), chr(10)) AS ws FROM documents),
t AS (SELECT rid, held, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM d),
g AS MATERIALIZED (SELECT *, lag(w, 1, chr(9)) OVER (PARTITION BY rid ORDER BY i) AS b, CASE WHEN i > 1 THEN lag(w, 2, chr(9)) OVER (PARTITION BY rid ORDER BY i) END AS a FROM t),
n1 AS MATERIALIZED (SELECT w, count(*) AS c FROM g WHERE NOT held GROUP BY w),
n2 AS MATERIALIZED (SELECT b, w, count(*) AS c FROM g WHERE NOT held GROUP BY b, w),
n3 AS MATERIALIZED (SELECT a, b, w, count(*) AS c FROM g WHERE NOT held AND a IS NOT NULL GROUP BY a, b, w),
one AS (SELECT w, c FROM n1 UNION ALL SELECT chr(9), count(*) FROM d WHERE NOT held),
m AS (SELECT n, v, greatest(1.0, p / greatest(1, v)) AS k2, greatest(1.0, q / greatest(1, p)) AS k3 FROM (SELECT CAST(coalesce(sum(c), 0) AS DOUBLE) AS n, CAST(count(*) AS DOUBLE) AS v, (SELECT CAST(count(*) AS DOUBLE) FROM n2) AS p, (SELECT CAST(count(*) AS DOUBLE) FROM n3) AS q FROM n1)),
p1 AS (SELECT g.*, coalesce(n1.c, 0) AS c1, (coalesce(n1.c, 0) + 1) / (n + v + 1) AS p, k2, k3 FROM g LEFT JOIN n1 ON n1.w = g.w, m),
p2 AS (SELECT p1.*, (coalesce(n2.c, 0) + k2 * p) / (coalesce(one.c, 0) + k2) AS pp FROM p1 LEFT JOIN n2 ON n2.b = p1.b AND n2.w = p1.w LEFT JOIN one ON one.w = p1.b),
p3 AS (SELECT p2.*, CASE WHEN p2.a IS NULL THEN pp ELSE (coalesce(n3.c, 0) + k3 * pp) / (coalesce(x.c, 0) + k3) END AS ppp
FROM p2 LEFT JOIN n3 ON n3.a = p2.a AND n3.b = p2.b AND n3.w = p2.w LEFT JOIN n2 x ON x.b = p2.a AND x.w = p2.b),
s AS (SELECT rid, count(*) AS n_tokens, count(*) FILTER (c1 > 0) AS n_known, round(sum(log10(p)), 6) AS base_score, round(sum(log10(ppp)), 6) AS score FROM p3 GROUP BY rid)
SELECT doc_id, held AS held_out, n_tokens, n_known, (SELECT CAST(n AS BIGINT) FROM m) AS train_tokens, base_score, score FROM d JOIN s USING (rid)"""

QUERIES = {"op11_backoff_scores": op11_backoff_scores}
SQL = {"op11_backoff_scores": _ORACLE}
