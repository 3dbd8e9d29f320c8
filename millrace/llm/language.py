"""Language ID by segmentation-marginalised unigrams.

Every language has a probability for each piece of a fixed public vocabulary. A word's probability
in a language is the sum, over all ways to cut it into pieces, of the product of the pieces'
probabilities; a forward pass over the word's positions computes it. A text's log-probability is
the sum over its words; the largest names the language. The score is that language's posterior
with the log-probabilities divided by the square root of the number of words (words of a text are
not independent, so the plain posterior is nearly always 0 or 1). The piece probabilities are fitted by
expectation-maximisation over the same lattices.

Training reads ``docs_per_lang`` distinct labelled texts of each language (those with the smallest
hashes; all where there are fewer); scoring reads every whole text.

Edge cases: a null text, or one without a letter, is ``und`` with score 0. Characters that no
piece covers cost one fixed piece (the same in all languages). Words of any length are scored whole:
in long ones the forward sums are rescaled as they go. Rows are scored one by one: repeated rows,
null ids and extra columns change nothing. Ties go to the language that sorts first. Without training
rows every text is ``und``. Training, too, sums over all segmentations of whole words of any length.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.window import Window as W

from millrace.llm.text import CHUNK_BYTES, bytes_of, chunks, mix, map_texts
from millrace.session import table

U64 = np.uint64
DOCS_PER_LANG = 400  # bound of the training sample
ROUNDS = 4  # of expectation-maximisation
RUN = 32  # code points of a word (with its mark) whose sums need no rescaling
LONG_STEP = 4096  # positions of a longer word looked up at once
PRIOR = 0.1  # pseudo-count of a piece in a language
MIN_SCORE = 0.5  # what the pipeline keeps
MARK = 0x2581  # starts a word in the vocabulary


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@lru_cache(maxsize=2)
def vocabulary(path: str) -> tuple[np.ndarray, np.ndarray, int, int]:
    """(sorted piece hashes, their row, rows, longest piece): row 0 is the unknown character, then the text pieces in order."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
    hashes = np.array([_piece_hash(p) for p in pieces], dtype=np.uint64)
    order = np.argsort(hashes)
    return hashes[order], (order + 1).astype(np.int32), len(pieces) + 1, max(map(len, pieces))


def _piece_hash(piece: str) -> int:
    codes = np.array([ord(c) for c in piece], dtype=np.uint64)
    return int(_span_hash((codes + U64(1))[None, :])[0, -1])


def _span_hash(codes: np.ndarray) -> np.ndarray:
    """Hashes of all prefixes of the sequences of code points plus one (last axis)."""
    h = np.zeros(codes.shape[:-1], dtype=np.uint64)
    out = np.empty(codes.shape, dtype=np.uint64)
    for j in range(codes.shape[-1]):
        h = mix(h * U64(0x9E3779B97F4A7C15) + codes[..., j])
        out[..., j] = h
    return out


def _rows_of(hashes: np.ndarray, vocab: tuple) -> np.ndarray:
    """The piece of each hash [..., reach], -1: not a piece. Single characters always have one, 0 if the vocabulary lacks them."""
    keys, rows = vocab[:2]
    at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
    row = np.where(keys[at] == hashes, rows[at], -1)
    row[..., 0] = np.maximum(row[..., 0], 0)
    return row


def _lattice(words: np.ndarray, vocab: tuple) -> list[tuple[int, int, np.ndarray]]:
    """(start, end, row) for every span of words [n, len] that is a piece in one of them."""
    size, out = words.shape[1], []
    for s in range(size):
        reach = min(size - s, vocab[3])
        row = _rows_of(_span_hash(words[:, s : s + reach].astype(np.uint64) + U64(1)), vocab)
        out += [(s, s + 1 + j, row[:, j]) for j in range(reach) if (row[:, j] >= 0).any()]
    return out


def _long_rows(word: np.ndarray, vocab: tuple) -> Iterator[tuple[int, np.ndarray]]:
    """(position, rows [positions, lengths]) of a long word, LONG_STEP positions at a time; -1: no piece."""
    reach = vocab[3]
    padded = np.concatenate([word.astype(np.uint64) + U64(1), np.zeros(reach, dtype=np.uint64)])
    for at in range(0, len(word), LONG_STEP):
        n = min(LONG_STEP, len(word) - at)
        row = _rows_of(_span_hash(np.lib.stride_tricks.sliding_window_view(padded[at : at + n + reach - 1], reach)), vocab)
        row[np.arange(at, at + n)[:, None] + np.arange(reach) >= len(word)] = -1
        yield at, row


def long_forward(word: np.ndarray, p: np.ndarray, vocab: tuple) -> np.ndarray:
    """Log-probabilities [positions + 1, languages] of the beginnings of one word of any length, by a rescaled forward pass."""
    reach, out = vocab[3], np.zeros((len(word) + 1, p.shape[1]))
    known = np.concatenate([p, np.zeros((1, p.shape[1]))])  # row -1: no piece
    ring = np.zeros((reach, p.shape[1]))  # sums up to the next positions, each over its scale
    ring[0] = 1
    for at, row in _long_rows(word, vocab):
        chance = known[row]  # position, length, language
        for k in range(len(row)):
            here = ring[0].copy()  # above 0: single characters are pieces
            out[at + k] = np.log(here) + (out[at + k - 1] if at + k else 0)
            ring[:-1], ring[-1] = ring[1:] / here, 0
            ring += chance[k]
    out[-1] = out[-2] + np.log(ring[0])
    return out


def long_score(word: np.ndarray, p: np.ndarray, vocab: tuple) -> np.ndarray:
    """Log-probabilities [languages] of one word of any length, from piece probabilities p."""
    return long_forward(word, p, vocab)[-1]


def _long_expected(word: np.ndarray, weight: np.ndarray, logp: np.ndarray, vocab: tuple, out: np.ndarray) -> None:
    """Adds the expected piece counts of one weighted word of any length to out (rescaled forward-backward)."""
    reach, p = vocab[3], np.exp(logp)
    known, forward = np.concatenate([p, np.zeros((1, p.shape[1]))]), long_forward(word, p, vocab)
    backward = np.zeros_like(forward)  # logs of what follows each position
    rows = np.concatenate([row for _, row in _long_rows(word, vocab)])
    ring = np.zeros((reach, p.shape[1]))  # what follows the next positions, over what follows the next one
    ring[0] = 1
    for i in range(len(word) - 1, -1, -1):
        here = (known[rows[i]] * ring).sum(axis=0)
        backward[i] = backward[i + 1] + np.log(here)
        ring[1:], ring[0] = ring[:-1] / here, 1
    for at in range(0, len(word), LONG_STEP):
        s, size = np.nonzero(rows[at : at + LONG_STEP] >= 0)
        s = s + at
        row = rows[s, size]
        value = weight * np.exp(forward[s] + logp[row] + backward[s + size + 1] - forward[-1])
        for k in range(out.shape[1]):
            out[:, k] += np.bincount(row, weights=value[:, k], minlength=len(out))


def word_scores(words: np.ndarray, logp: np.ndarray, vocab: tuple) -> np.ndarray:
    """Log-probabilities [n, languages] of equally long words [n, len], summed over all segmentations."""
    n, size = words.shape
    p = np.exp(logp)  # RUN code points at most: products stay far above the least double
    alpha = np.zeros((size + 1, n, logp.shape[1]))
    alpha[0] = 1
    for s, e, row in _lattice(words, vocab):
        hit = np.flatnonzero(row >= 0)
        if len(hit) == n:
            alpha[e] += alpha[s] * p[row]
        else:
            alpha[e, hit] += alpha[s, hit] * p[row[hit]]
    return np.log(np.maximum(alpha[size], 1e-300))


def _expected(words: np.ndarray, weight: np.ndarray, logp: np.ndarray, vocab: tuple, out: np.ndarray) -> None:
    """Adds the expected piece counts of weighted words to out [rows, languages] (forward-backward)."""
    n, size = words.shape
    p, edges = np.exp(logp), _lattice(words, vocab)
    alpha, beta = np.zeros((size + 1, n, p.shape[1])), np.zeros((size + 1, n, p.shape[1]))
    alpha[0] = beta[size] = 1
    for s, e, row in edges:
        alpha[e] += alpha[s] * np.where(row[:, None] >= 0, p[row], 0)
    for s, e, row in sorted(edges, key=lambda x: -x[0]):
        beta[s] += beta[e] * np.where(row[:, None] >= 0, p[row], 0)
    share = weight / np.maximum(alpha[size], 1e-300)
    rows = np.concatenate([row for _, _, row in edges])
    hit = np.flatnonzero(rows >= 0)
    value = np.concatenate([alpha[s] * beta[e] * share for s, e, _ in edges])[hit] * p[rows[hit]]
    for k in range(out.shape[1]):
        out[:, k] += np.bincount(rows[hit], weights=value[:, k], minlength=len(out))


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(code points, start, end, row) of the words of UTF-8 rows."""
    text = data.tobytes().decode("utf-8", "replace")
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32)
    lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])  # code points before each byte
    edge = lead[offsets]
    ink = (codes != 0x20) & ((codes < 9) | (codes > 13))
    first = ink.copy()
    first[1:] &= ~ink[:-1]
    inner = edge[(edge > 0) & (edge < len(codes))]
    first[inner] = ink[inner]
    start = np.flatnonzero(first)
    last = ink.copy()
    last[:-1] &= ~ink[1:]
    last[inner - 1] = ink[inner - 1]
    end = np.flatnonzero(last) + 1
    row = np.searchsorted(edge, start, "right") - 1
    return codes, start, end, row


def distinct_words(codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By length: (positions in start, distinct words [m, len + 1] with their MARK, each position's word)."""
    size = end - start
    for n in np.unique(size):
        at = np.flatnonzero(size == n)
        words = np.empty((len(at), n + 1), dtype=np.uint32)
        words[:, 0] = MARK
        words[:, 1:] = codes[start[at][:, None] + np.arange(n)]
        _, first, inverse = np.unique(_span_hash(words[:, 1:].astype(np.uint64))[:, -1], return_index=True, return_inverse=True)
        yield at, words[first], inverse


def score_rows(data: np.ndarray, offsets: np.ndarray, logp: np.ndarray, vocab: tuple) -> tuple[np.ndarray, np.ndarray]:
    """(log-probabilities [rows, languages], words per row)."""
    codes, start, end, row = words_of(data, offsets)
    total, p = np.zeros((len(offsets) - 1, logp.shape[1])), None
    for at, words, inverse in distinct_words(codes, start, end):
        if words.shape[1] <= RUN:
            scores = np.concatenate([word_scores(words[i : i + 4096], logp, vocab) for i in range(0, len(words), 4096)])
        else:
            p = np.exp(logp) if p is None else p
            scores = np.stack([long_score(w, p, vocab) for w in words])
        for k in range(logp.shape[1]):
            total[:, k] += np.bincount(row[at], weights=scores[inverse, k], minlength=len(total))
    return total, np.bincount(row, minlength=len(total))


def training_sample(labelled: DataFrame, docs_per_lang: int) -> DataFrame | None:
    """(lang, text): of each language min(docs_per_lang, distinct texts) texts, those with the smallest hashes. None: no labelled row."""
    hashed = labelled.filter("text is not null and lang is not null").select("lang", "text", F.xxhash64("text").alias("h"))
    # copies must not count: the share kept below is one of distinct texts
    distinct = hashed.select("lang", "h").distinct().groupBy("lang").agg(F.count("*").alias("n")).collect()  # a row per language
    if not distinct:
        return None
    share = {r["lang"]: min(1.0, 4 * docs_per_lang / r["n"]) for r in distinct}
    limit = F.create_map(*(F.lit(x) for lang, p in share.items() for x in (lang, min(int((2 * p - 1) * 2.0**63), 2**63 - 1))))
    near = hashed.filter(F.col("h") <= limit[F.col("lang")]).dropDuplicates(["lang", "h"])
    rank = F.row_number().over(W.partitionBy("lang").orderBy("h"))
    return near.withColumn("r", rank).filter(F.col("r") <= docs_per_lang).select("lang", "text")


def train(labelled: DataFrame, path: str, docs_per_lang: int = DOCS_PER_LANG, rounds: int = ROUNDS) -> tuple[list[str], np.ndarray]:
    """(languages in order, log piece probabilities [rows, languages]) from at most docs_per_lang texts each."""
    sample = training_sample(labelled, docs_per_lang)
    if sample is None:
        return [], np.zeros((vocabulary(path)[2], 0))
    words = sample.select("lang", F.explode(F.split("text", "[\\x20\\x09-\\x0D]+")).alias("word")).filter("word <> ''").groupBy("lang", "word").count()

    def fit(counts: pd.DataFrame) -> pd.DataFrame:
        langs, logp = _fit(counts, vocabulary(path), rounds)
        return pd.DataFrame({"lang": langs, "logp": [np.ascontiguousarray(logp[:, k]).tobytes() for k in range(len(langs))]})

    # the sample is bounded, so one task holds its words
    found = words.withColumn("all", F.lit(1)).groupBy("all").applyInPandas(fit, "lang string, logp binary").collect()
    return [r["lang"] for r in found], np.stack([np.frombuffer(r["logp"]) for r in found], axis=1) if found else np.zeros((vocabulary(path)[2], 0))


def _fit(counts: pd.DataFrame, vocab: tuple, rounds: int) -> tuple[list[str], np.ndarray]:
    """(languages, log piece probabilities) by expectation-maximisation from (lang, word, count)."""
    langs = sorted(counts["lang"].unique())
    table_ = counts.pivot_table(index="word", columns="lang", values="count", fill_value=0).reindex(columns=langs).sort_index()
    logp = np.full((vocab[2], len(langs)), -np.log(vocab[2]))
    text = [w.encode("utf-8", "replace") for w in table_.index]
    off = np.concatenate([[0], np.cumsum([len(t) for t in text])])
    codes, *spans = words_of(np.frombuffer(b"".join(text), dtype=np.uint8), off)
    start, end, row = spans
    weight, groups = table_.to_numpy(dtype=float), []
    for at, words, inverse in distinct_words(codes, start, end):
        groups.append((words, np.stack([np.bincount(inverse, weights=weight[row[at], k], minlength=len(words)) for k in range(len(langs))], axis=1)))
    some = max(64, 8192 // len(langs))  # words held at once, fewer for more languages
    for _ in range(rounds):
        expected = np.full_like(logp, PRIOR)
        for words, w in groups:
            if words.shape[1] > RUN:
                for word, weight_ in zip(words, w):
                    _long_expected(word, weight_, logp, vocab, expected)
                continue
            for i in range(0, len(words), some):
                _expected(words[i : i + some], w[i : i + some], logp, vocab, expected)
        expected[0] = expected[0].mean()  # unknown characters say nothing about the language
        logp = np.log(expected / expected.sum(axis=0))
    return langs, logp


def identify(df: DataFrame, model: tuple[list[str], np.ndarray], path: str) -> DataFrame:
    """``df`` with lang_pred and score (columns so named are replaced). The model is one row per piece: bounded."""
    langs, logp = model
    df = df.drop("lang_pred", "score")
    if not langs:
        return df.withColumns({"lang_pred": F.lit("und"), "score": F.lit(0.0)})
    shared = df.sparkSession.sparkContext.broadcast(logp)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch in batches:
            text = batch.column(batch.schema.get_field_index("text"))
            data, off = bytes_of(text)
            best, score = [np.zeros(0, dtype=int)], [np.zeros(0)]
            for i, j in chunks(off, 4 * CHUNK_BYTES):
                total, n = score_rows(data[off[i] : off[j]], off[i : j + 1] - off[i], shared.value, vocab)
                gap = (total - total.max(axis=1, keepdims=True)) / np.sqrt(np.maximum(n, 1))[:, None]
                best.append(total.argmax(axis=1))
                score.append(1 / np.exp(gap).sum(axis=1))
            lettered = pc.fill_null(pc.match_substring_regex(text, r"\p{L}"), False)
            name = pc.if_else(lettered, pa.array(np.array(langs, dtype=object)[np.concatenate(best)], pa.string()), "und")
            value = pc.if_else(lettered, pa.array(np.concatenate(score)), 0.0)
            own = list(batch.schema)
            yield pa.RecordBatch.from_arrays([*batch.columns, name, value], schema=pa.schema([*own, pa.field("lang_pred", pa.string()), pa.field("score", pa.float64())]))

    return map_texts(df, predict, T.StructType([*df.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))


def held_out(doc_id: str) -> Column:
    """True where crc32(doc_id as text) mod 3 is 1 (null ids: false)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def model_of(docs: DataFrame, path: str) -> tuple[list[str], np.ndarray]:
    return train(docs.filter(~held_out("doc_id")).select("text", "lang"), path)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's predicted language and score."""
    docs, path = table(spark, sf_dir, "documents"), vocabulary_path()
    found = identify(docs.select("doc_id", "text", held_out("doc_id").alias("held_out")), model_of(docs, path), path)
    return found.select("doc_id", "held_out", "lang_pred", "score")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents whose language is recognised stay."""
    path = vocabulary_path()
    found = identify(docs, model_of(docs, path), path)
    return found.filter((F.col("lang_pred") != "und") & (F.col("score") >= MIN_SCORE)).select(*docs.columns)


QUERIES = {"op10_language_id": op10_language_id}
SQL: dict[str, str] = {}
