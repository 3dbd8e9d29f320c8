"""Quality rules by weak supervision.

Rules over a document's counts vote good (+1), bad (-1) or abstain (0). The vote patterns are
counted over all documents; expectation-maximisation on those counts estimates how often each
rule is right when it votes on a good or a bad document; every document then gets the posterior
probability of being good. Nothing is filtered because one rule failed: the posterior decides.

The rules look at different things: repeated lines and repeated windows see the same passages, so they
are one rule. A vote may not speak against its own class; the maximisation step is the exact maximum under
that condition, so each class keeps a distribution over every rule's votes and the objective never falls.

Edge cases: a null or empty text has zero counts and fails the base. A line counts as repeated
only if it holds a word. Repeated rows and null ids are judged row by row; extra columns pass
through ``judge`` and those named like an output are replaced.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from millrace.llm.store import Workspace
from millrace.llm.text import Words, row_chunks, map_texts
from millrace.session import table

SYMBOL = np.zeros(256, dtype=bool)
SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_unspaced")
UNSPACED = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x3400, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF))  # blocks of scripts written without spaces
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50  # of the base
KEEP = 0.5  # least posterior of a kept document
ROUNDS = 50

#: name: (votes good where, votes bad where); neither: the rule abstains. Bad goes before good.
RULES = {
    "length": ("n_words >= 80", "n_words < 50"),
    "word_length": (
        "n_unspaced <= 0.3 * word_chars AND word_chars BETWEEN 3.5 * n_words AND 10 * n_words",
        "n_unspaced <= 0.3 * word_chars AND (word_chars < 2.5 * n_words OR word_chars > 14 * n_words)",
    ),
    "symbols": ("n_symbols <= 0.01 * word_chars", "n_symbols > 0.05 * word_chars"),
    "repeats": ("n_dup_lines <= 0.05 * n_lines AND n_repeat_words <= 0.15 * n_words", "n_dup_lines > 0.3 * n_lines OR n_repeat_words > 0.35 * n_words"),
    "letters": ("n_letters >= 0.93 * word_chars", "n_letters < 0.88 * word_chars"),
}


def _line_counts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lines with a word, those equal to an earlier line of the row) per row."""
    raw, lines, dups = data.tobytes(), [], []
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        seen, n = set(), 0
        for line in raw[a:b].split(b"\n"):
            if line.strip(b" \t\n\x0b\x0c\r"):
                n += 1
                seen.add(line)
        lines.append(n)
        dups.append(n - len(seen))
    return np.array(lines, dtype=np.int64), np.array(dups, dtype=np.int64)


def _repeat_words(words: Words) -> np.ndarray:
    """Words per row that lie in a three-word window found twice or more in the row."""
    h, ptr = words.shingles(3, whole_if_short=False)
    out, first = np.zeros(len(ptr) - 1, dtype=np.int64), words.ptr
    for r in range(len(ptr) - 1):
        own = h[ptr[r] : ptr[r + 1]]
        if len(own) > 1:
            order = np.argsort(own, kind="stable")
            same = own[order][1:] == own[order][:-1]
            if same.any():
                at = np.unique(np.concatenate([order[1:][same], order[:-1][same]]))
                covered = np.zeros(first[r + 1] - first[r], dtype=bool)
                covered[at] = covered[at + 1] = covered[at + 2] = True
                out[r] = covered.sum()
    return out


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """Per code point: 1 for a letter or mark, 3 for one of a script without spaces, else 0."""
    out = np.fromiter((unicodedata.category(chr(c))[0] in "LM" for c in range(0x110000)), dtype=np.uint8, count=0x110000)
    for lo, hi in UNSPACED:
        out[lo : hi + 1] *= 3
    return out


def _row_counts(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    words = Words(data, offsets)
    total = lambda mask, at: np.diff(np.concatenate([[0], np.cumsum(mask)])[at])
    lead = (data & 0xC0) != 0x80
    ink = lead & (data != 0x20) & ((data < 9) | (data > 13))
    codes = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), dtype=np.uint32)
    kind, chars = _kinds()[codes], np.concatenate([[0], np.cumsum(lead)])[offsets]
    lines, dups = _line_counts(data, offsets)
    return {
        "n_words": np.diff(words.ptr), "word_chars": total(ink, offsets), "n_symbols": total(SYMBOL[data], offsets), "n_dup_lines": dups, "n_repeat_words": _repeat_words(words),
        "n_lines": lines, "n_letters": total(kind > 0, chars), "n_unspaced": total(kind > 1, chars),
    }


def counted(df: DataFrame) -> DataFrame:
    """``df`` without its text, with the COUNTS of each whole text."""
    df = df.drop(*COUNTS)
    keep = [f for f in df.schema.fields if f.name != "text"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, off in row_chunks(batches, "text"):
            found = _row_counts(data, off)
            own = [f.name for f in keep]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in own), *(pa.array(found[c].astype(np.int64)) for c in COUNTS)], names=[*own, *COUNTS])

    return map_texts(df, count, T.StructType([*keep, *(T.StructField(c, T.LongType()) for c in COUNTS)]))


def _votes() -> Column:
    """The vote pattern, a digit per rule: 0 bad, 1 none, 2 good."""
    return F.concat(*(F.expr(f"CASE WHEN {bad} THEN '0' WHEN {good} THEN '2' ELSE '1' END") for good, bad in RULES.values()))


def maximised(good: np.ndarray, bad: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each class's chances of a rule's votes (bad, none, good) from the expected counts of both classes.

    The likelihood's maximum among the chances in which a good vote is no rarer in the good class than
    in the bad one, and a bad vote no rarer in the bad class. Where a vote's condition binds, its chance is
    the same in both classes - its share of all counts - and the other votes share the rest as their counts;
    of the four sets of conditions that may bind, the best one that meets both is taken.
    """
    best = None
    for tied in ((), (2,), (0,), (0, 2)):
        chances = []
        for own in (good, bad):
            p = own / own.sum()
            if tied:
                t = list(tied)
                p[t] = (good + bad)[t] / (good + bad).sum()
                rest = [v for v in range(3) if v not in tied]
                p[rest] = own[rest] / own[rest].sum() * (1 - p[t].sum())
            chances.append(p)
        up, down = chances
        if up[2] >= down[2] - 1e-12 and down[0] >= up[0] - 1e-12:
            value = (good * np.log(up)).sum() + (bad * np.log(down)).sum()
            if best is None or value > best[0] + 1e-12:
                best = value, up, down
    return best[1], best[2]


def estimate(patterns: pd.DataFrame, rounds: int = ROUNDS, trace: list[float] | None = None) -> pd.DataFrame:
    """Posterior of good for each vote pattern (columns pattern, n), by expectation-maximisation.

    Rules are independent given the class. For each class a rule has its chances of voting good,
    bad or nothing, smoothed by one document each (as is the share of good documents).
    ``trace`` receives the objective of each round: log-likelihood and smoothing.
    """
    votes = np.array([[int(c) for c in p] for p in patterns["pattern"]]).reshape(len(patterns), len(RULES))
    n = patterns["n"].to_numpy(dtype=float)
    good = 1 / (1 + np.exp(2.0 * (votes == 0).sum(axis=1) - 2.0))  # most rules have nothing against most documents: bad votes tell more
    hot = np.stack([votes == v for v in range(3)], axis=2).astype(float)  # pattern, rule, vote
    for _ in range(rounds):
        counts = [np.einsum("p,prv->rv", n * q, hot) + 1 for q in (good, 1 - good)]
        up, down = (np.array(x) for x in zip(*(maximised(a, b) for a, b in zip(*counts, strict=True)), strict=True))
        prior = ((n * good).sum() + 1) / (n.sum() + 2)
        yes = np.log(prior) + np.einsum("prv,rv->p", hot, np.log(up))
        no = np.log(1 - prior) + np.einsum("prv,rv->p", hot, np.log(down))
        both = np.logaddexp(yes, no)
        good = np.exp(yes - both)
        if trace is not None:
            trace.append((n * both).sum() + np.log(up).sum() + np.log(down).sum() + np.log(prior) + np.log(1 - prior))
    return patterns.assign(posterior=good)


def judge(df: DataFrame) -> DataFrame:
    """``df`` without its text, with counts, base_failed, posterior and kept. The counts are written once and read twice."""
    spark = df.sparkSession
    c = Workspace(spark, "quality").put(counted(df.drop("base_failed", "posterior", "kept")).withColumn("_pattern", _votes()), "counts")
    seen = c.groupBy(F.col("_pattern").alias("pattern")).agg(F.count("*").alias("n")).orderBy("pattern").toPandas()  # at most 3 ** rules rows
    model = estimate(seen) if len(seen) else seen.assign(posterior=pd.Series(dtype=float))
    known = spark.createDataFrame(pa.table({"_pattern": pa.array(model["pattern"], pa.string()), "posterior": pa.array(model["posterior"], pa.float64())}))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return c.join(F.broadcast(known), "_pattern").withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("posterior") >= KEEP)).drop("_pattern")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's counts, base failure and weakly supervised verdict."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")


QUERIES = {"op3_quality": op3_quality}
SQL: dict[str, str] = {}
