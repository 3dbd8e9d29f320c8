"""Source divergence audit: how the sources of a language differ in their use of terms.

Terms are maximal runs of ASCII letters and code points from 0x80, with A-Z lower-cased. Two passes over the
texts. The first counts, per language, the documents that have each term, exactly; a language keeps the terms
of at least ``MIN_DOCS`` documents. The second builds an Aho-Corasick automaton (pyahocorasick) of a language's
kept terms, each between delimiters, and runs the texts through it, with every other character as delimiter: it
tells all occurrences of kept terms and nothing else. The counts are postings (language, term, source, count);
a source's share of a term is p = 1 + floor(1e9 (count + 5) / (N + 5 V)), N and V being its kept occurrences and
the language's kept terms. The difference of two sources is the sum of |p - q| over all kept terms.

Postings are sparse, so the difference of a and b is computed from what is there. With p0 a source's share of
a term that it lacks, and g(x, y) = |x - y|:

    V g(p0a, p0b) + sum over a's terms [g(pa, p0b) - g(p0a, p0b)] + the same for b's terms
    + sum over common terms [g(pa, pb) - g(pa, p0b) - g(p0a, pb) + g(p0a, p0b)]

The sums over one source's terms come from the histogram of its counts; the sum over common terms from blocks of
postings (all postings of a share of the terms), each of which adds up its terms' lists per pair before anything
is shuffled.

Scale. Both passes are scans with partial counts. The automaton's terms are bounded: they are broadcast in
slices of at most ``SLICE_TERMS`` terms, one scan of the texts a slice, so a vocabulary beyond one slice costs
further scans and no more memory. Shares are exact integers (decimals of 38 digits where products could leave 64 bits).

Edge cases: null text, language or source count as ''. A group without kept terms has its pairs; a language
without kept terms has differences 0 and no terms. A language with one source has no pairs. Ranks go by
value, then by the item's UTF-8 bytes. Repeated rows count each. An empty table gives an empty result; extra
columns are left out.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window as W

from millrace.llm.store import Workspace
from millrace.llm.text import CHUNK_BYTES, bytes_of, chunks, map_texts, span_hashes
from millrace.session import table

MIN_DOCS = 30
TOP_TERMS = 50
UNIT = 1_000_000_000  # shares are whole billionths
SMOOTH = 5  # occurrences added to every term
SLICE_TERMS = 500_000  # of one automaton: some 200 MB in a worker
FLUSH = 1 << 20  # counts that a task holds before it sends them on
BLOCK_POSTINGS = 1 << 16
_GAP = np.ones(256, dtype=bool)  # bytes that no term has
_GAP[65:91] = _GAP[97:123] = _GAP[128:] = False
#: Bytes of a text as the automaton reads it: terms in lower case, all else a delimiter.
_PLAIN = bytes(32 if _GAP[b] else b + 32 if 65 <= b < 91 else b for b in range(256))


def grouped(docs: DataFrame) -> DataFrame:
    """(lang, source, text) without nulls."""
    return docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")))


def document_frequencies(docs: DataFrame) -> DataFrame:
    """(lang, term, docs): in how many documents of a language every term is."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, (data, off) = np.asarray(batch.column(0).to_pylist(), dtype=object), bytes_of(batch.column(1))
            for i, j in chunks(off, 4 * CHUNK_BYTES):
                found = _chunk_frequencies(lang[i:j], data[off[i] : off[j]], off[i : j + 1] - off[i])
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(found, (pa.string(), pa.string(), pa.int64()))], names=["lang", "term", "docs"])

    counted = map_texts(docs.select("lang", "text"), count, "lang string, term string, docs long")
    return counted.groupBy("lang", "term").agg(F.sum("docs").alias("docs"))


def _chunk_frequencies(lang: np.ndarray, data: np.ndarray, off: np.ndarray) -> tuple[list, list, list]:
    plain = np.frombuffer(data.tobytes().translate(_PLAIN), dtype=np.uint8)
    ink = np.concatenate([[False], plain != 32, [False]])
    first, last = ink[1:-1] & ~ink[:-2], ink[1:-1] & ~ink[2:]
    inner = off[(off > 0) & (off < len(plain))]
    first[inner], last[inner - 1] = ink[1:-1][inner], ink[1:-1][inner - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    row = np.searchsorted(off, start, "right") - 1
    names, which = np.unique(lang, return_inverse=True)
    h = span_hashes(plain, start, end)
    # a document's terms once each, then a language's
    order = np.lexsort((h, row))
    h, row, start, end = h[order], row[order], start[order], end[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    h, of, start, end = h[new], which[row[new]], start[new], end[new]
    order = np.lexsort((h, of))
    h, of, start, end = h[order], of[order], start[order], end[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
    at = np.flatnonzero(new)
    text = plain.tobytes()
    terms = [text[a:b].decode("utf-8") for a, b in zip(start[at].tolist(), end[at].tolist())]
    return names[of[at]].tolist(), terms, np.diff(np.append(at, len(h))).tolist()


def occurrences(docs: DataFrame, kept: dict[str, list[str]]) -> DataFrame:
    """(lang, source, term, count): occurrences of each language's kept terms, by task; ``kept`` is bounded by the caller."""
    shared = docs.sparkSession.sparkContext.broadcast(kept)

    def recount(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automata, held = {}, defaultdict(Counter)

        def automaton(lang: str):
            if lang not in automata:
                made = ahocorasick.Automaton(ahocorasick.STORE_INTS)
                for i, term in enumerate(shared.value.get(lang, ())):
                    made.add_word(f" {term} ", i)
                if len(made):
                    made.make_automaton()
                automata[lang] = made
            return automata[lang]

        def flush() -> Iterator[pa.RecordBatch]:
            for (lang, source), counts in held.items():
                terms = shared.value[lang]
                n = len(counts)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * n, pa.string()), pa.array([source] * n, pa.string()), pa.array([terms[i] for i in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], names=["lang", "source", "term", "count"])
            held.clear()

        for batch in batches:
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                find = automaton(lang)
                if len(find):
                    plain = b" " + text.as_buffer().to_pybytes().translate(_PLAIN) + b" "
                    held[lang, source].update(i for _, i in find.iter(plain.decode("utf-8")))
            if sum(map(len, held.values())) > FLUSH:
                yield from flush()
        yield from flush()

    return map_texts(docs.select("lang", "source", "text"), recount, "lang string, source string, term string, count long")


def postings(docs: DataFrame, space: Workspace, min_docs: int = MIN_DOCS, slice_terms: int = SLICE_TERMS) -> tuple[DataFrame, DataFrame]:
    """(kept (lang, term), postings (lang, source, term, count)), both stored. ``docs`` is as ``grouped`` gives it."""
    kept = space.put(document_frequencies(docs).filter(F.col("docs") >= min_docs).select("lang", "term"), "kept")
    n = kept.count()
    slices, found = -(-n // (slice_terms // 2)) if n > slice_terms else 1, None
    for k in range(slices):  # a slice's share of hashed terms: about half the limit, so it stays below
        part = kept.filter(F.pmod(F.xxhash64("term"), F.lit(slices)) == k) if slices > 1 else kept
        terms = defaultdict(list)
        for r in part.toLocalIterator():
            terms[r["lang"]].append(r["term"])
        counted = occurrences(docs, dict(terms)).groupBy("lang", "source", "term").agg(F.sum("count").alias("count"))
        counted.write.mode("append").option("compression", "zstd").parquet(space.path("postings"))
        found = counted
    return kept, space.get("postings", found)


def share(count: Column, n: Column, v: Column) -> Column:
    """1 + floor(UNIT (count + SMOOTH) / (n + SMOOTH v)), exact; null where there are no kept terms."""
    wide = lambda c: c.cast("decimal(19,0)")
    above = (wide(count + SMOOTH) * F.lit(UNIT).cast("decimal(19,0)")).cast("decimal(38,0)")
    below = (wide(n) + wide(F.lit(SMOOTH)) * wide(v)).cast("decimal(38,0)")
    return F.when(v > 0, 1 + F.call_function("div", above, below)).cast("long")


def common_terms(post: DataFrame, blocks: int) -> DataFrame:
    """(lang, a, b, extra): for sources a < b with a common term, the sum over common terms (see the module's text), by block.

    ``post`` is (lang, term, source, p, p0). A block holds all postings of its terms, some BLOCK_POSTINGS in all.
    """

    def add_up(part: pa.Table) -> pa.Table:
        lang = part.column("lang")[0].as_py()
        names, who = np.unique(np.asarray(part.column("source").to_pylist(), dtype=object), return_inverse=True)
        term = np.unique(np.asarray(part.column("term").to_pylist(), dtype=object), return_inverse=True)[1]
        order = np.lexsort((who, term))
        term, who, p, p0 = term[order], who[order], part.column("p").to_numpy()[order], part.column("p0").to_numpy()[order]
        begin, size = np.searchsorted(term, np.arange(term.max() + 1)), np.bincount(term)
        rows = ([], [], [])
        by_source = np.argsort(who, kind="stable")
        edge = np.searchsorted(who[by_source], np.arange(len(names) + 1))
        for a in range(len(names)):
            mine = by_source[edge[a] : edge[a + 1]]
            n = size[term[mine]]  # this source's terms' whole lists, as one run
            other = np.repeat(begin[term[mine]] - np.cumsum(n) + n, n) + np.arange(n.sum())
            mine = np.repeat(mine, n)
            later = who[other] > a
            mine, other = mine[later], other[later]
            extra = np.abs(p[mine] - p[other]) - np.abs(p[mine] - p0[other]) - np.abs(p0[mine] - p[other]) + np.abs(p0[mine] - p0[other])
            total, met = np.zeros(len(names), dtype=np.int64), np.bincount(who[other], minlength=len(names))
            np.add.at(total, who[other], extra)
            for b in np.flatnonzero(met):
                for column, x in zip(rows, (names[a], names[b], int(total[b]))):
                    column.append(x)
        return pa.Table.from_arrays([pa.array([lang] * len(rows[0]), pa.string()), pa.array(map(str, rows[0]), pa.string()), pa.array(map(str, rows[1]), pa.string()), pa.array(rows[2], pa.int64())], names=["lang", "a", "b", "extra"])

    keyed = post.withColumn("block", F.pmod(F.xxhash64("term"), F.lit(blocks)))
    return keyed.groupBy("lang", "block").applyInArrow(add_up, "lang string, a string, b string, extra long").groupBy("lang", "a", "b").agg(F.sum("extra").alias("extra"))


def audit(docs: DataFrame, label: str = "divergence", min_docs: int = MIN_DOCS, top: int = TOP_TERMS, slice_terms: int = SLICE_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank) of ``docs`` (text, lang, source): see the module's text."""
    space, docs = Workspace(docs.sparkSession, label), grouped(docs)
    kept, post = postings(docs, space, min_docs, slice_terms)
    group, total = docs.select("lang", "source").distinct(), post.groupBy("lang", "source").agg(F.sum("count").alias("n"))
    terms = kept.groupBy("lang").agg(F.count("*").alias("v"))
    group = group.join(total, ["lang", "source"], "left").join(terms, "lang", "left").fillna(0, ["n", "v"])
    group = space.put(group.withColumn("p0", share(F.lit(0).cast("long"), F.col("n"), F.col("v"))), "groups")
    shared = space.put(post.join(group, ["lang", "source"]).withColumn("p", share(F.col("count"), F.col("n"), F.col("v"))).select("lang", "source", "term", "count", "v", "p", "p0"), "shares")
    return _pairs(group, shared, max(1, shared.count() // BLOCK_POSTINGS)).unionByName(_terms(shared, top))


def _pairs(group: DataFrame, shared: DataFrame, blocks: int) -> DataFrame:
    """Every group against each other source of its language, ranked."""
    other = lambda prefix: group.select("lang", F.col("source").alias(prefix), F.col("p0").alias(f"{prefix}0"))
    pair = other("a").join(other("b"), "lang").filter("a <> b").join(group.select("lang", F.col("source").alias("a"), "v"), ["lang", "a"])
    # one source's terms against the other's share of a term that it lacks: by the histogram of shares
    counts = shared.groupBy("lang", F.col("source").alias("a"), "p").agg(F.count("*").alias("m"))
    far = F.abs(F.col("p") - F.col("b0")) - F.abs(F.col("a0") - F.col("b0"))
    own = counts.join(other("a"), ["lang", "a"]).join(other("b"), "lang").filter("a <> b").groupBy("lang", "a", "b").agg(F.sum(F.col("m") * far).alias("own"))
    both = common_terms(shared.select("lang", "term", "source", "p", "p0"), blocks)
    both = both.unionByName(both.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "extra"))
    pair = pair.join(own, ["lang", "a", "b"], "left").join(own.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), F.col("own").alias("theirs")), ["lang", "a", "b"], "left").join(both, ["lang", "a", "b"], "left")
    value = sum((F.coalesce(x, F.lit(0)) for x in (F.col("own"), F.col("theirs"), F.col("extra"))), F.coalesce(F.col("v") * F.abs(F.col("a0") - F.col("b0")), F.lit(0)))
    rank = F.row_number().over(W.partitionBy("lang", "a").orderBy(F.desc("value"), "b"))
    return pair.withColumn("value", value.cast("long")).select("lang", F.col("a").alias("source"), F.lit("pair").alias("part"), F.col("b").alias("item"), "value", rank.alias("rank"))


def _terms(shared: DataFrame, top: int) -> DataFrame:
    """Every group's terms whose share is above that in its language, the first ``top``."""
    whole = shared.groupBy("lang").agg(F.sum("count").alias("n"))
    q = shared.groupBy("lang", "term").agg(F.sum("count").alias("c"), F.first("v").alias("v")).join(whole, "lang").select("lang", "term", share(F.col("c"), F.col("n"), F.col("v")).alias("q"))
    above = shared.join(q, ["lang", "term"]).filter("p > q").withColumn("value", F.col("p") - F.col("q"))
    rank = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "term"))
    return above.withColumn("rank", rank).filter(F.col("rank") <= top).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every group's difference from each other source of its language, and the terms that it uses more."""
    return audit(table(spark, sf_dir, "documents"))


_ORACLE = f"""WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS ts FROM documents),
o AS MATERIALIZED (SELECT rid, lang, source, unnest(ts) AS term FROM d),
k AS MATERIALIZED (SELECT lang, term FROM o GROUP BY lang, term HAVING count(DISTINCT rid) >= {MIN_DOCS}),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
g AS MATERIALIZED (SELECT DISTINCT lang, source FROM d),
c AS MATERIALIZED (SELECT lang, source, term, count(*) AS c FROM o JOIN k USING (lang, term) GROUP BY ALL),
n AS (SELECT lang, source, sum(c) AS n FROM c GROUP BY ALL),
p AS MATERIALIZED (SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c, CAST(1 + (CAST({UNIT} AS HUGEINT) * (coalesce(c.c, 0) + {SMOOTH})) // (coalesce(n.n, 0) + {SMOOTH} * v.v) AS BIGINT) AS p
FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN n ON n.lang = g.lang AND n.source = g.source LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
q AS (SELECT lang, term, CAST(1 + (CAST({UNIT} AS HUGEINT) * (sum(c) + {SMOOTH})) // ((SELECT sum(c) FROM c x WHERE x.lang = p.lang) + {SMOOTH} * any_value(v.v)) AS BIGINT) AS q FROM p JOIN v USING (lang) GROUP BY lang, term),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce((SELECT sum(abs(x.p - y.p)) FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source), 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM p JOIN q USING (lang, term) WHERE c > 0 AND p > q),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= {TOP_TERMS}"""

QUERIES = {"op12_source_divergence": op12_source_divergence}
SQL = {"op12_source_divergence": _ORACLE}
