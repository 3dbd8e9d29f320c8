"""Benchmark decontamination: size-partitioned MinHash containment search, verified exactly.

Texts are case-folded and cut into five-word shingles (a shorter text is one shingle). An item of
n shingles is contained in a document that has at least ``THRESHOLD`` of them. Of an item's n
shingle hashes the n - ceil(THRESHOLD n) + 1 smallest (a bottom-k MinHash sketch) cannot all be
missing from such a document, so a search for sketch hashes finds every contained item. Items are
partitioned by the power of two of their size; a partition keeps the largest hash of its sketches
and its smallest size, so that a document's shingles above that hash, and documents too small for
the partition, are not searched. Every candidate's containment is then counted on all its shingles.

The sketches travel to the documents while the items' shingles stay within ``INDEX_LIMIT`` hashes;
beyond that, documents' shingle hashes are joined with the sketches, and candidates with the
shingles, by shuffles.

Edge cases: a null or empty text, of an item or of a document, has no shingles and matches nothing.
An item shorter than five words matches only a document that is this very sequence. Repeated rows
are found each; pairs are distinct by document id and item id. Extra columns pass through
``without_leaks``. Without items nothing matches.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from millrace.llm.store import Workspace
from millrace.llm.text import Words, chunks, bytes_of, map_texts
from millrace.session import table

WORDS = 5
THRESHOLD = 0.8
INDEX_LIMIT = 4_000_000  # shingle hashes of all items that may be broadcast (about 64 MB with item numbers)
_PAIR = "doc_id bigint, item_id bigint, shared bigint, item_shingles bigint"


def least(n: int) -> int:
    """Shingles that a document must share with an item of n."""
    return ceil(THRESHOLD * n - 1e-9)


def _folded(batch: pa.RecordBatch, text: str) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, shingle hashes, ptr) by chunks of the case-folded texts."""
    column = batch.column(batch.schema.get_field_index(text))
    data, off = bytes_of(pa.array([x.casefold() if x else x for x in column.to_pylist()], pa.large_string()))
    for i, j in chunks(off):
        hashes, ptr = Words(data[off[i] : off[j]], off[i : j + 1] - off[i]).shingles(WORDS)
        yield i, j, hashes, ptr


def shingle_sets(df: DataFrame, key: str) -> DataFrame:
    """(key, n, hashes): the distinct shingle hashes of each text, ascending."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, hashes, ptr in _folded(batch, "text"):
                sets = [np.unique(hashes[a:b]).view(np.int64) for a, b in zip(ptr[:-1], ptr[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array([len(s) for s in sets], pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=[key, "n", "hashes"]
                )

    return map_texts(df.select(key, "text"), cut, f"{key} {dict(df.dtypes)[key]}, n bigint, hashes array<bigint>")


class Index:
    """The items' sketches by size partition and their shingles, as arrays."""

    def __init__(self, items: list[tuple[int, np.ndarray]]):
        self.ids = np.array([i for i, _ in items], dtype=np.int64)
        self.size = np.array([len(h) for _, h in items], dtype=np.int64)
        flat = np.concatenate([h for _, h in items] or [np.zeros(0, dtype=np.uint64)])
        owner = np.repeat(np.arange(len(items)), self.size)
        order = np.argsort(flat, kind="stable")
        self.hashes, self.owner = flat[order], owner[order]
        self.need = np.array([least(int(n)) for n in self.size], dtype=np.int64)
        self.parts = []  # (least document size, largest sketch hash, sketch hashes)
        power = np.array([int(n).bit_length() for n in self.size])
        for p in np.unique(power):
            members = np.flatnonzero(power == p)
            sketch = np.unique(np.concatenate([np.sort(items[m][1])[: self.size[m] - self.need[m] + 1] for m in members]))
            self.parts.append((int(self.need[members].min()), sketch[-1], sketch))

    def search(self, hashes: np.ndarray, ptr: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(row, items, shared shingles) of the rows that contain an item."""
        found = np.zeros(len(ptr) - 1, dtype=bool)
        sizes = np.diff(ptr)
        for small, top, sketch in self.parts:
            at = np.flatnonzero(hashes <= top)
            hit = at[sketch[np.minimum(np.searchsorted(sketch, hashes[at]), len(sketch) - 1)] == hashes[at]]
            row = np.searchsorted(ptr, hit, "right") - 1
            found[row[sizes[row] >= small]] = True
        for r in np.flatnonzero(found):
            own = np.unique(hashes[ptr[r] : ptr[r + 1]])
            lo, hi = np.searchsorted(self.hashes, own, "left"), np.searchsorted(self.hashes, own, "right")
            n = hi - lo
            at = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
            shared = np.bincount(self.owner[at], minlength=len(self.ids))
            items = np.flatnonzero((shared >= self.need) & (self.size > 0))
            if len(items):
                yield r, items, shared[items]


def _item_sets(items: DataFrame, space: Workspace) -> tuple[DataFrame, int]:
    sets = space.put(shingle_sets(items.select("item_id", "text"), "item_id").filter("n > 0"), "items")
    return sets, sets.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def _index(sets: DataFrame):
    rows = sets.select("item_id", "hashes").toPandas()
    return sets.sparkSession.sparkContext.broadcast(Index([(int(i), np.array(h, dtype=np.int64).view(np.uint64)) for i, h in zip(rows["item_id"], rows["hashes"], strict=True)]))


def _joined_pairs(docs: DataFrame, sets: DataFrame, space: Workspace) -> DataFrame:
    """(doc_id, _t, item_id, shared, n): the search by shuffles, for any number of items."""
    need = F.ceil(THRESHOLD * F.col("n") - 1e-9)
    # unsigned order of the hashes, as in the index: the sign bit flipped
    low = F.transform(F.array_sort(F.transform("hashes", lambda h: h.bitwiseXOR(F.lit(-(2**63))))), lambda h: h.bitwiseXOR(F.lit(-(2**63))))
    sketch = sets.select("item_id", need.alias("need"), F.explode(F.slice(low, F.lit(1), (F.col("n") - need + 1).cast("int"))).alias("h"))
    marked = docs.withColumn("_t", F.xxhash64("text"))
    keyed = marked.select(F.struct("doc_id", "_t").alias("key"), "text")
    own = space.put(_hashes_of(keyed), "documents")
    rows = own.select("key", "n", F.explode("hashes").alias("h")).withColumnRenamed("n", "size")
    candidates = rows.join(sketch, "h").filter("size >= need").select("key", "item_id").distinct()
    full = sets.select("item_id", "n", F.explode("hashes").alias("h"))
    counted = candidates.join(rows, "key").join(full, ["item_id", "h"]).groupBy("key", "item_id", "n").agg(F.countDistinct("h").alias("shared"))
    return counted.filter(F.col("shared") >= need).select("key.doc_id", "key._t", "item_id", "shared", "n")


def _hashes_of(keyed: DataFrame) -> DataFrame:
    flat = keyed.select(F.to_json("key").alias("k"), "key", "text").dropDuplicates(["k"])
    return shingle_sets(flat.select("k", "text"), "k").join(flat.select("k", "key"), "k").drop("k")


def leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, shared, item_shingles): the items contained in each document."""
    space = Workspace(docs.sparkSession, "leaks")
    sets, total = _item_sets(items, space)
    if total > INDEX_LIMIT:
        return _joined_pairs(docs, sets, space).select("doc_id", "item_id", "shared", F.col("n").alias("item_shingles")).distinct()
    index = _index(sets)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = index.value
        for batch in batches:
            ids = batch.column(0)
            for i, _, hashes, ptr in _folded(batch, "text"):
                for r, found, shared in ix.search(hashes, ptr):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([ids[i + r].as_py()] * len(found), pa.int64()), pa.array(ix.ids[found]), pa.array(shared.astype(np.int64)), pa.array(ix.size[found])], names=["doc_id", "item_id", "shared", "item_shingles"]
                    )

    return map_texts(docs.select("doc_id", "text"), search, _PAIR).distinct()


def without_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` that contain no item."""
    space = Workspace(docs.sparkSession, "leaks")
    sets, total = _item_sets(items, space)
    if total > INDEX_LIMIT:
        bad = _joined_pairs(docs.select("doc_id", "text"), sets, space).select(F.col("doc_id").alias("_d"), "_t").distinct()
        return docs.withColumn("_x", F.xxhash64("text")).join(bad, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_x") == F.col("_t")), "left_anti").drop("_x")
    index = _index(sets)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clean = np.ones(batch.num_rows, dtype=bool)
            for i, _, hashes, ptr in _folded(batch, "text"):
                for r, _, _ in index.value.search(hashes, ptr):
                    clean[i + r] = False
            yield batch.filter(pa.array(clean))

    return map_texts(docs, keep, docs.schema)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every (document, contained benchmark item) with the exact containment."""
    found = leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumn("containment", F.round(F.col("shared") / F.col("item_shingles"), 6))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents without benchmark items stay."""
    return without_leaks(docs, table(spark, sf_dir, "benchmark"))


def _sets_sql(source: str, key: str) -> str:
    return f"""SELECT DISTINCT {key}, CASE WHEN len(ws) < {WORDS} THEN ws ELSE ws[i:i + {WORDS - 1}] END AS s
        FROM (SELECT *, unnest(range(1, greatest(len(ws) - {WORDS - 1}, 1) + 1)) AS i
              FROM (SELECT {key}, regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[^\\x20\\x09-\\x0D]+') AS ws FROM {source}) WHERE len(ws) > 0)"""


_SQL = f"""
WITH d AS ({_sets_sql("documents", "doc_id")}),
i AS ({_sets_sql("benchmark", "item_id")}),
n AS (SELECT item_id, count(*) AS item_shingles FROM i GROUP BY item_id)
SELECT doc_id, item_id, count(*) AS shared, item_shingles, round(count(*) / item_shingles, 6) AS containment
FROM d JOIN i USING (s) JOIN n USING (item_id)
GROUP BY doc_id, item_id, item_shingles HAVING 10 * count(*) >= 8 * item_shingles
"""

QUERIES = {"op1_decontamination": op1_decontamination}
SQL = {"op1_decontamination": _SQL}
