"""Token counts: an exact length histogram whose suffix sums answer every context limit.

Each task encodes its texts and hands on (length, documents) pairs; the pairs are summed to one row
per distinct length. Running sums over that small table give, for a context limit L, the documents
that fit, the tokens kept when longer ones are cut at L, and the share of documents (a quantile);
no second pass over the texts is needed.

Edge cases: a null or empty text has length 0 and is counted. Repeated rows count each time; other
columns are not read. An empty table gives an empty histogram, whose totals are 0.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window as W

from millrace.llm.text import map_texts
from millrace.session import table


def ranks_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@lru_cache(maxsize=2)
def encoding(path: str):
    """The byte-level BPE whose ranks are in the file; special strings in a text are ordinary text."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def histogram(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """(n_tokens, n_docs): documents by encoded length."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(path).encode_ordinary
        for batch in batches:
            lengths = np.array([len(encode(x)) if x else 0 for x in batch.column(0).to_pylist()], dtype=np.int64)
            size, n = np.unique(lengths, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(size), pa.array(n.astype(np.int64))], names=["n_tokens", "n_docs"])

    return map_texts(df.select(text), count, "n_tokens bigint, n_docs bigint").groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs"))


def limits(hist: DataFrame) -> DataFrame:
    """The histogram with, for every distinct length as the context limit: the documents and tokens of at
    least (``_ge``) and at most (``_le``) that length, all tokens left when longer documents are cut,
    and the share of documents that fit. One row per distinct length, so one task holds it."""
    everything = W.partitionBy(F.lit(1))
    below = W.orderBy("n_tokens").rowsBetween(W.unboundedPreceding, 0)
    tokens = F.col("n_tokens") * F.col("n_docs")
    h = hist.withColumns({"docs": F.sum("n_docs").over(everything), "tokens": F.sum(tokens).over(everything), "docs_le": F.sum("n_docs").over(below), "tokens_le": F.sum(tokens).over(below)})
    h = h.withColumns({"docs_ge": F.col("docs") - F.col("docs_le") + F.col("n_docs"), "tokens_ge": F.col("tokens") - F.col("tokens_le") + tokens})
    h = h.withColumns({"truncated_tokens": F.col("tokens_le") + F.col("n_tokens") * (F.col("docs") - F.col("docs_le")), "share_le": F.col("docs_le") / F.col("docs")})
    return h.select("n_tokens", "n_docs", "docs_le", "tokens_le", "docs_ge", "tokens_ge", "truncated_tokens", "share_le")


def truncated_totals(hist: DataFrame, contexts: list[int]) -> DataFrame:
    """(context, docs_cut, tokens): tokens left when every document is cut at each context."""
    out = hist.select(F.explode(F.array(*(F.lit(c).cast("long") for c in contexts))).alias("context"), "n_tokens", "n_docs")
    return out.groupBy("context").agg(F.sum(F.when(F.col("n_tokens") > F.col("context"), F.col("n_docs")).otherwise(0)).alias("docs_cut"), F.sum(F.least("n_tokens", "context") * F.col("n_docs")).alias("tokens"))


def quantiles(hist: DataFrame, shares: list[float]) -> DataFrame:
    """(share, n_tokens): the least length such that at least this share of documents is no longer."""
    found = limits(hist).select(F.explode(F.array(*(F.lit(float(s)) for s in shares))).alias("share"), "n_tokens", "share_le")
    return found.filter(F.col("share_le") >= F.col("share") - 1e-12).groupBy("share").agg(F.min("n_tokens").alias("n_tokens"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact length histogram of all documents with its suffix sums."""
    return limits(histogram(table(spark, sf_dir, "documents"), ranks_path()))


QUERIES = {"op2_token_counts": op2_token_counts}
SQL: dict[str, str] = {}
