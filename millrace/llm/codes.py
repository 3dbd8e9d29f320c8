"""Vector code compression: product codes from integer codebooks.

A vector's components become integers (floor of 256 times the component) and are cut into ``PARTS``
equal consecutive parts. Every part position has a codebook of up to ``ENTRIES`` entries, which
starts as that part of the vectors with the smallest ids. A round assigns every part to the nearest
entry and moves every used entry to the componentwise floor of the mean of its parts. A vector's code
is the list of its parts' entries.

The codebooks (``ENTRIES`` x components integers, whatever the table holds) are broadcast. Arrow batches
compute all squared distances of a position at once, |x|^2 - 2 x.c + |c|^2 with an exact int64 matrix
product, and take the first least; every task adds up its parts per entry before one grouped shuffle
merges the sums. Nothing else moves: vectors are read where they lie, once a round.

Edge cases: rows whose vector is null or has null or non-finite components are dropped. Ids may repeat
or be null: the codebooks start from the rows that sort first by (id, vector), nulls last; with fewer than
``ENTRIES`` rows there are as many entries, and equal entries lose ties to the lower index. An empty table
gives an empty result. Vectors must have as many components as the one that sorts first, a multiple of
``PARTS``, and components so small that distances fit 64 bits: anything else raises. An empty vector has
empty parts: code 0, error 0. Equal labels share ``label_error``; null labels are one group.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from millrace.llm.joins import spread_join
from millrace.llm.store import Workspace
from millrace.llm.text import map_texts
from millrace.session import table

PARTS, ENTRIES, ROUNDS = 16, 64, 2
SCALE = 256
BLOCK = 4096  # vectors whose distances to a codebook are held at once


def finite(vector: str) -> Column:
    """True for vectors without null or non-finite components."""
    return F.col(vector).isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def integers(column: pa.Array, size: int) -> np.ndarray:
    """The integer vectors [rows, size] of a list column without nulls."""
    offsets = np.asarray(column.offsets)
    if np.any(np.diff(offsets) != size):
        raise ValueError(f"vectors must have {size} components like the first one")
    values = np.asarray(column.values, dtype=np.float64)[offsets[0] : offsets[-1]]
    return np.floor(SCALE * values).astype(np.int64).reshape(len(column), size)


def nearest(vectors: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) [rows, parts] of every part's nearest entry; books are [parts, entries, part size]."""
    parts, _, width = books.shape
    entry = np.zeros((len(vectors), parts), dtype=np.int64)
    distance = np.zeros((len(vectors), parts), dtype=np.int64)
    norms = (books * books).sum(axis=2)
    for i in range(0, len(vectors), BLOCK):
        block = vectors[i : i + BLOCK]
        for p in range(parts):
            x = block[:, p * width : (p + 1) * width]
            d = (x * x).sum(axis=1)[:, None] - 2 * (x @ books[p].T) + norms[p]
            best = d.argmin(axis=1)  # the first of equal ones
            entry[i : i + BLOCK, p], distance[i : i + BLOCK, p] = best, d[np.arange(len(d)), best]
    return entry, distance


def entry_sums(vectors: np.ndarray, entry: np.ndarray, shape: tuple[int, int, int]) -> tuple[np.ndarray, np.ndarray]:
    """(sums [parts, entries, part size], counts [parts, entries]) of the parts assigned to each entry."""
    parts, entries, width = shape
    sums, counts = np.zeros(shape, dtype=np.int64), np.zeros((parts, entries), dtype=np.int64)
    for p in range(parts):
        np.add.at(sums[p], entry[:, p], vectors[:, p * width : (p + 1) * width])
        counts[p] = np.bincount(entry[:, p], minlength=entries)
    return sums, counts


def first_books(kept: DataFrame, id_: str, vector: str, entries: int, parts: int) -> np.ndarray | None:
    """The starting codebooks [parts, entries, part size]; None for an empty table. Takes ``entries`` rows to the driver."""
    first = kept.orderBy(F.col(id_).asc_nulls_last(), vector).select(vector).limit(entries).collect()
    if not first:
        return None
    size = len(first[0][0])
    if size % parts or any(len(r[0]) != size for r in first):
        raise ValueError(f"vectors must have equally many components, a multiple of {parts}")
    start = np.floor(SCALE * np.array([r[0] for r in first], dtype=np.float64).reshape(len(first), size)).astype(np.int64)
    return np.ascontiguousarray(start.reshape(len(first), parts, size // parts).swapaxes(0, 1))


def moved_books(kept: DataFrame, vector: str, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round. At most parts x entries x part size sums reach the driver."""
    shape, shared = books.shape, kept.sparkSession.sparkContext.broadcast(books)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        sums, counts = np.zeros(shape, dtype=np.int64), np.zeros(shape[:2], dtype=np.int64)
        for batch in batches:
            x = integers(batch.column(0), shape[0] * shape[2])
            more, n = entry_sums(x, nearest(x, own)[0], shape)
            sums, counts = sums + more, counts + n
        part, entry = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(part.astype(np.int32)), pa.array(entry.astype(np.int32)), pa.array(counts[part, entry]), pa.array(list(sums[part, entry]), pa.list_(pa.int64()))],
            names=["part", "entry", "n", "sums"],
        )

    found = map_texts(kept.select(vector), partial, "part int, entry int, n long, sums array<long>")
    total = found.groupBy("part", "entry").agg(F.sum("n").alias("n"), *(F.sum(F.col("sums")[j]).alias(f"s{j}") for j in range(shape[2]))).collect()
    shared.unpersist()
    out = books.copy()
    for r in total:
        out[r["part"], r["entry"]] = [r[f"s{j}"] // r["n"] for j in range(shape[2])]  # floors go down
    return out


def checked(kept: DataFrame, vector: str, size: int) -> None:
    """Raises where squared distances, or sums over all rows, could leave 64 bits."""
    most, rows = kept.agg(F.max(F.array_max(F.transform(vector, F.abs))), F.count("*")).first()
    bound = int(SCALE * float(most or 0)) + 1
    if 4 * bound * bound * max(1, size) >= 1 << 63 or bound * rows >= 1 << 63:
        raise ArithmeticError("components too large for exact 64-bit distances")


def train(kept: DataFrame, id_: str, vector: str, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray | None:
    """The codebooks [parts, entries, part size] of a table of finite vectors; None if it is empty."""
    books = first_books(kept, id_, vector, entries, parts)
    if books is not None:
        checked(kept, vector, parts * books.shape[2])
        for _ in range(rounds):
            books = moved_books(kept, vector, books)
    return books


def encode(kept: DataFrame, vector: str, books: np.ndarray) -> DataFrame:
    """``kept`` without its vectors, with ``codes`` (one byte a part) and ``error`` (long); columns so named are replaced."""
    rest = kept.drop("codes", "error")
    own = [c for c in rest.columns if c != vector]
    shared, size = kept.sparkSession.sparkContext.broadcast(books), books.shape[0] * books.shape[2]

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            entry, distance = nearest(integers(batch.column(len(own)), size), shared.value)
            packed = [row.tobytes() for row in entry.astype(np.uint8)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(own)], pa.array(packed, pa.binary()), pa.array(distance.sum(axis=1))],
                schema=pa.schema([*(batch.schema.field(i) for i in range(len(own))), pa.field("codes", pa.binary()), pa.field("error", pa.int64())]),
            )

    schema = rest.select(*own).schema.add("codes", "binary").add("error", "long")
    return map_texts(rest.select(*own, vector), code, schema)


def decode(codes: bytes, books: np.ndarray) -> np.ndarray:
    """The vector that a code stands for."""
    return np.concatenate([books[p, e] for p, e in enumerate(codes)]) / SCALE


def books_text(books: np.ndarray | None) -> str:
    """All entries' components by part, entry and position, in decimal and joined by commas."""
    return "" if books is None else ",".join(map(str, books.reshape(-1).tolist()))


def label_errors(coded: DataFrame, label: str, total: int) -> DataFrame:
    """``coded`` with ``label_error``: the error summed over equal labels, nulls together. ``coded`` is read twice: give a stored table."""
    key = F.when(F.col(label).isNull(), "").otherwise(F.concat(F.lit("="), F.col(label).cast("string")))
    keyed = coded.withColumn("_label", key)
    sums = keyed.groupBy("_label").agg(F.sum("error").alias("label_error"), F.count("*").alias("weight"))
    return spread_join(keyed, sums, "_label", total).drop("_label")


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every finite vector's code, its error and its label's error, with a digest of the codebooks."""
    kept = table(spark, sf_dir, "embeddings").filter(finite("embedding")).select("vec_id", "embedding", "label")
    books = train(kept, "vec_id", "embedding")
    digest = hashlib.sha256(books_text(books).encode()).hexdigest()
    if books is None:
        return spark.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    space = Workspace(spark, "codes")
    coded = space.put(encode(kept, "embedding", books), "coded")
    found = label_errors(coded, "label", coded.count())
    code = F.lower(F.hex("codes"))
    return found.select("vec_id", code.alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _oracle() -> str:
    """The rounds as SQL: (vec_id, part) rows against all entries, ties to the lower index."""
    rounds = []
    for r in range(ROUNDS + 1):
        rounds.append(f"""d{r} AS MATERIALIZED (SELECT x.vec_id, x.part, b.entry, list_sum(list_transform(list_zip(x.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM x JOIN b{r} b ON b.part = x.part),
a{r} AS MATERIALIZED (SELECT vec_id, part, min(d) AS d, arg_min(entry, (d, entry)) AS entry FROM d{r} GROUP BY vec_id, part)""")
        if r < ROUNDS:
            rounds.append(f"""m{r} AS (SELECT part, entry, list(f ORDER BY i) AS v FROM (SELECT part, entry, i, CAST(floor(sum(c) / count(*)) AS BIGINT) AS f
FROM (SELECT a.part, a.entry, unnest(x.v) AS c, generate_subscripts(x.v, 1) AS i FROM a{r} a JOIN x ON x.vec_id = a.vec_id AND x.part = a.part) GROUP BY part, entry, i) GROUP BY part, entry),
b{r + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(m.v, b.v) AS v FROM b{r} b LEFT JOIN m{r} m ON m.part = b.part AND m.entry = b.entry)""")
    last = ROUNDS
    return f"""WITH k AS (SELECT vec_id, label, [CAST(floor(256 * CAST(e AS DOUBLE)) AS BIGINT) FOR e IN embedding] AS v FROM embeddings
WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
x AS MATERIALIZED (SELECT vec_id, p AS part, v[p * len(v) // {PARTS} + 1 : (p + 1) * len(v) // {PARTS}] AS v FROM k, range({PARTS}) t(p)),
b0 AS MATERIALIZED (SELECT x.part, r.entry, x.v FROM x JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM k ORDER BY vec_id LIMIT {ENTRIES}) r USING (vec_id)),
{", ".join(rounds)},
c AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{last} GROUP BY vec_id),
s AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS h FROM b{last})
SELECT c.vec_id, c.code, c.error, CAST(sum(c.error) OVER (PARTITION BY k.label) AS BIGINT) AS label_error, s.h AS codebooks_sha256 FROM c JOIN k USING (vec_id), s"""


QUERIES = {"op13_vector_codes": op13_vector_codes}
SQL = {"op13_vector_codes": _oracle()}
