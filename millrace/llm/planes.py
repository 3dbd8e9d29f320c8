"""Token ids in a plane-shuffled, chunk-indexed binary format.

Layout of a store: a Parquet table ``data`` with one row per section (a run of documents in
ascending id order, about ``SECTION_IDS`` ids or one longer document) and a Parquet table ``index``
with a row per chunk. A section holds its documents' ids and lengths and its token ids in chunks
of ``BLOCK_IDS``. A chunk is transposed: plane j has byte (or bit) j of every id. Planes are
compressed with zstandard one by one; planes of zeros at the top are left out. The index gives each
chunk's section, its place in the whole sequence and its compressed bytes, so that ``read_range``
fetches and expands only the chunks that a range of ids touches. Spark's commit protocol makes writing
safe against lost executors.

Edge cases: a null text counts as empty and has the end id alone. Null ids sort first. Rows with
equal ids are ordered by their text's hash, identical rows follow each other. Only the id and text
columns are stored. An empty table makes an empty store. A text's ids are held in memory whole.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window as W

from millrace.llm.store import Workspace
from millrace.llm.text import bytes_of, chunks, span_hashes, map_texts
from millrace.session import table

END_ID = 0
BLOCK_IDS = 16_384
SECTION_IDS = 262_144
LEVEL = 1
TEXT_BYTES = 4 << 20  # texts encoded together, about
CACHE = 800_000  # words a worker remembers
POOL = 4096  # new words encoded as one text
#: A text falls apart before a space between two characters that are no white space: the vocabulary's
#: pattern lets a token hold a space only at its start, so no token crosses such a place.
_INNER = re.compile(r"[\w!-~](?:.*[\w!-~])?", re.DOTALL)
_SECTION = "part int, section int, n_docs bigint, n_ids bigint, first_doc bigint, last_doc bigint, mode string, doc_ids array<bigint>, lengths array<bigint>, blocks array<struct<n:int,bytes:int,planes:array<binary>>>"
_DATA = pa.schema([
    ("part", pa.int32()), ("section", pa.int32()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("first_doc", pa.int64()), ("last_doc", pa.int64()), ("mode", pa.string()),
    ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("blocks", pa.list_(pa.struct([("n", pa.int32()), ("bytes", pa.int32()), ("planes", pa.list_(pa.binary()))]))),
])


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(maxsize=2)
def _encoder(path: str) -> "_Encoder":
    return _Encoder(path)


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if printable, else the next free one from 256."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b if b in plain else next(free)) for b in range(256)]


class _Encoder:
    """Encodes whole texts word by word, each distinct word once.

    A word is what stands between two spaces. ``known`` has its ids after a space, or None where
    texts may not be cut next to it; a text with such a word is encoded as it is.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        #: words may be encoded one by one only under the known pattern, with no normaliser and no template before or after
        self.by_words = self._known_pattern(path)
        vocab = self.tokenizer.get_vocab()
        self.model, self.letters = self.tokenizer.model, _byte_letters()
        self.width = np.zeros(max(vocab.values()) + 1, dtype=np.int64)  # bytes of a token: its letters stand for one each
        for token, i in vocab.items():
            self.width[i] = len(token)
        self.known: dict[bytes, bytes | None] = {}
        if self.by_words:
            self.stops = dict(zip(".,;:!?", self.whole(list(".,;:!?")), strict=True))
            (self.feed,) = self.whole(["\n"])

    def _known_pattern(self, path: str) -> bool:
        """Whether the file's text handling is byte-level with its standard pattern, no leading space and no normaliser, and its model plain BPE."""
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        split, model = spec.get("pre_tokenizer") or {}, spec.get("model") or {}
        plain = not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "unk_token", "byte_fallback", "ignore_merges"))
        plain &= all(spec.get(k) is None for k in ("truncation", "padding", "post_processor", "normalizer")) and all(t.get("special") for t in spec.get("added_tokens") or ())
        return plain and split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True) and model.get("type", "BPE") == "BPE"

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _spelled(self, word: bytes, text: str, lead: str) -> bytes | None:
        """Ids of letters, with a sign of punctuation or not, after ``lead`` (a space or nothing); None for other words.

        The pattern keeps a space and letters in one piece and parts them from signs, so the model alone is asked.
        """
        stop = b"" if text.isalpha() else self.stops.get(text[-1:])
        if stop is None or (stop and not text[:-1].isalpha()):
            return None
        piece = text[:-1] if stop else text
        piece = piece if piece.isascii() else "".join(map(self.letters.__getitem__, piece.encode()))
        return array("I", [t.id for t in self.model.tokenize(lead + piece)]).tobytes() + stop

    def _lines(self, word: bytes) -> bytes | None:
        """Ids of words joined by single line feeds, which are tokens of their own between characters that are no white space."""
        first, *more = word.split(b"\n")
        out = [self.known.get(first) or self._spelled(first, first.decode("utf-8", "replace"), self.letters[32])]
        for w in more:
            ids = self.known.get(b"\n" + w)
            if ids is None and (own := self._spelled(w, w.decode("utf-8", "replace"), "")):
                ids = self.known[b"\n" + w] = self.feed + own
            out.append(ids)
        return b"".join(out) if all(out) else None

    def learn(self, words: list[bytes]) -> None:
        known, rest = self.known, []
        for w in words:
            text = w.decode("utf-8", "replace")
            ids = self._spelled(w, text, self.letters[32]) or (self._lines(w) if b"\n" in w else None)
            if ids or not _INNER.fullmatch(text):
                known[w] = ids
            else:
                rest.append(text)
        for i in range(0, len(rest), POOL):
            part = rest[i : i + POOL]
            (raw,) = self.whole([" " + " ".join(part)])
            ends = np.cumsum(self.width[np.frombuffer(raw, dtype="<u4")])
            names = [w.encode() for w in part]
            want = np.cumsum([len(w) + 1 for w in names])
            at = np.searchsorted(ends, want) + 1
            if not (ends[at - 1] == want).all():
                raise ValueError("the vocabulary joins words across a space")
            known.update(zip(names, (raw[4 * a : 4 * b] for a, b in zip([0, *at[:-1].tolist()], at.tolist(), strict=True)), strict=True))

    def _ids_of(self, words: list[bytes]) -> list[bytes | None]:
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > CACHE:
            self.known.clear()
            new = words
        self.learn(new)
        return list(map(self.known.__getitem__, words))

    def encode(self, data: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
        """The ids of each row of a chunk of UTF-8 texts, equal to encoding each text whole."""
        n, raw = len(off) - 1, data.tobytes()
        if not self.by_words:
            return [np.frombuffer(x, dtype="<u4") for x in self.whole([raw[a:b].decode("utf-8", "replace") for a, b in zip(off[:-1], off[1:], strict=True)])]
        space = np.flatnonzero(data == 0x20)
        doc = np.concatenate([np.arange(n), np.searchsorted(off, space, "right") - 1])
        order = np.argsort(doc, kind="stable")
        doc, start = doc[order], np.concatenate([off[:-1], space + 1])[order]
        first = np.searchsorted(doc, np.arange(n))
        end = np.append(start[1:] - 1, 0)
        end[np.append(first[1:], len(doc)) - 1] = off[1:]
        inner = np.ones(len(doc), dtype=bool)
        inner[first] = False
        s, e = start[inner], end[inner]
        hashes = span_hashes(data, s, e, checked=True)
        by_hash = np.argsort(hashes)
        new = np.ones(len(hashes), dtype=bool)
        new[1:] = hashes[by_hash][1:] != hashes[by_hash][:-1]
        rep, which = by_hash[new], np.empty(len(hashes), dtype=np.int64)
        which[by_hash] = np.cumsum(new) - 1
        size = e - s
        same = size == size[rep][which]
        if same.all():
            ink = data != 0x20
            for a, b in zip(off[:-1].tolist(), end[first].tolist(), strict=True):
                ink[a:b] = False
            same = data[ink] == data[np.repeat(s[rep][which] - np.cumsum(size) + size, size) + np.arange(size.sum())]
        if not same.all():  # two words of one hash
            return [np.frombuffer(x, dtype="<u4") for x in self.whole([raw[a:b].decode("utf-8", "replace") for a, b in zip(off[:-1], off[1:], strict=True)])]
        ids = self._ids_of([raw[a:b] for a, b in zip(s[rep].tolist(), e[rep].tolist(), strict=True)])
        bad = np.array([x is None for x in ids], dtype=bool)
        heads = [raw[a:b].decode("utf-8", "replace") for a, b in zip(off[:-1].tolist(), end[first].tolist(), strict=True)]
        entries = [x or b"" for x in ids] + self.whole(heads)
        length = np.array([len(x) // 4 for x in entries], dtype=np.int64)
        pool = np.frombuffer(b"".join(entries), dtype="<u4")
        used = np.empty(len(doc), dtype=np.int64)
        used[inner], used[first] = which, len(ids) + np.arange(n)
        own = length[used]
        at = np.repeat((np.cumsum(length) - length)[used] - (np.cumsum(own) - own), own) + np.arange(own.sum())
        flat, ends = pool[at], np.cumsum(np.add.reduceat(own, first)) if n else np.zeros(0, dtype=np.int64)
        odd = np.bincount(doc[inner], weights=bad[which], minlength=n) > 0 if len(which) else np.zeros(n, dtype=bool)
        out = np.split(flat, ends[:-1]) if n else []
        for r in range(n):
            if odd[r] or (first[r] + 1 < (first[r + 1] if r + 1 < n else len(doc)) and not _INNER.fullmatch(heads[r][-1:])):
                out[r] = np.frombuffer(self.whole([raw[off[r] : off[r + 1]].decode("utf-8", "replace")])[0], dtype="<u4")
        return out


def encode(texts: list[str | None] | pa.Array, path: str) -> list[np.ndarray]:
    """Each text's token ids (unsigned 32-bit); null has none."""
    data, off = bytes_of(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()))
    return [x for i, j in chunks(off, TEXT_BYTES) for x in _encoder(path).encode(data[off[i] : off[j]], off[i : j + 1] - off[i])]


def pack(ids: np.ndarray, mode: str = "byte") -> list[bytes]:
    """The compressed planes of one block of ids (unsigned 32-bit), lowest first, without zero planes at the top."""
    raw = np.ascontiguousarray(ids, dtype="<u4").view(np.uint8).reshape(-1, 4)
    planes = raw.T if mode == "byte" else np.packbits(np.unpackbits(raw, axis=1, bitorder="little").T, axis=1)
    used = int(np.flatnonzero(planes.any(axis=1)).max(initial=-1)) + 1
    squeeze = zstandard.ZstdCompressor(level=LEVEL).compress
    return [squeeze(np.ascontiguousarray(p).tobytes()) for p in planes[:used]]


def unpack(planes: list[bytes], n: int, mode: str = "byte") -> np.ndarray:
    """The block's n ids."""
    full, width = (4, n) if mode == "byte" else (32, -(-n // 8))
    out = np.zeros((full, width), dtype=np.uint8)
    expand = zstandard.ZstdDecompressor().decompress
    for j, p in enumerate(planes):
        out[j] = np.frombuffer(expand(p, max_output_size=width), dtype=np.uint8)
    raw = out.T if mode == "byte" else np.packbits(np.unpackbits(out, axis=1, count=n).T, axis=1, bitorder="little")
    return np.ascontiguousarray(raw).reshape(-1).view("<u4")


def _section(part: int, number: int, docs: list, lengths: list[int], data: list[np.ndarray], mode: str) -> dict:
    ids = np.concatenate(data).astype("<u4", copy=False)
    packed = [(len(b), pack(b, mode)) for b in (ids[i : i + BLOCK_IDS] for i in range(0, len(ids), BLOCK_IDS))]
    blocks = [{"n": n, "bytes": sum(map(len, planes)), "planes": planes} for n, planes in packed]
    return {"part": part, "section": number, "n_docs": len(docs), "n_ids": len(ids), "first_doc": docs[0], "last_doc": docs[-1], "mode": mode, "doc_ids": docs, "lengths": lengths, "blocks": blocks}


def write_ids(df: DataFrame, path: str, tokenizer: str, mode: str = "byte", end_id: int = END_ID) -> None:
    """Encodes ``df``'s (doc_id, text) and writes the store at ``path``."""
    spark, end = df.sparkSession, np.array([end_id], dtype="<u4")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # ties and null ids are spread by the text's hash
    rows = df.select("doc_id", "text").withColumn("_h", F.xxhash64("text")).repartitionByRange(n, "doc_id", "_h").sortWithinPartitions("doc_id", "_h")

    def sections(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, docs, lengths, data, size = TaskContext.get().partitionId(), 0, [], [], [], 0
        for batch in batches:
            texts = batch.column(1)
            _, off = bytes_of(texts)
            for i, j in chunks(off, TEXT_BYTES):
                ids = batch.column(0).slice(i, j - i).to_pylist()
                for doc, own in zip(ids, encode(texts.slice(i, j - i), tokenizer), strict=True):
                    docs.append(doc)
                    lengths.append(len(own) + 1)
                    data += [own, end]
                    size += lengths[-1]
                    if size >= SECTION_IDS:
                        yield pa.RecordBatch.from_pylist([_section(part, number, docs, lengths, data, mode)], schema=_DATA)
                        number, docs, lengths, data, size = number + 1, [], [], [], 0
        if docs:
            yield pa.RecordBatch.from_pylist([_section(part, number, docs, lengths, data, mode)], schema=_DATA)

    map_texts(rows.select("doc_id", "text"), sections, _SECTION).write.mode("overwrite").option("compression", "none").parquet(f"{path}/data")
    meta = spark.read.parquet(f"{path}/data").select("part", "section", "n_docs", "n_ids", "first_doc", "last_doc", "blocks.n", "blocks.bytes")
    per_part = meta.groupBy("part").agg(F.sum("n_ids").alias("_ids"))
    base = per_part.select("part", (F.sum("_ids").over(W.orderBy("part")) - F.col("_ids")).alias("_base"))
    within = F.sum("n_ids").over(W.partitionBy("part").orderBy("section")) - F.col("n_ids")
    placed = meta.withColumn("_within", within).join(base, "part").withColumn("section_start", F.col("_base") + F.col("_within"))
    chunks_ = placed.select("part", "section", "section_start", "n_docs", "first_doc", "last_doc", F.posexplode(F.arrays_zip("n", "bytes")).alias("chunk", "x"), "n")
    before = F.aggregate(F.slice("n", F.lit(1), F.col("chunk")), F.lit(0).cast("bigint"), lambda a, v: a + v)
    chunks_.select("part", "section", "chunk", "section_start", (F.col("section_start") + before).alias("start"), F.col("x.n").alias("n_ids"), F.col("x.bytes").alias("bytes"), "n_docs", "first_doc", "last_doc").write.mode("overwrite").parquet(f"{path}/index")


def read_range(spark: SparkSession, path: str, start: int, stop: int) -> DataFrame:
    """(start, ids): the ids at places start to stop (exclusive) of the whole sequence, by chunks.

    The index names the chunks; only their sections are read from ``data`` and only they are expanded.
    """
    wanted = spark.read.parquet(f"{path}/index").filter((F.col("start") < stop) & (F.col("start") + F.col("n_ids") > start))
    wanted = wanted.groupBy("part", "section").agg(F.sort_array(F.collect_list(F.struct("chunk", "start"))).alias("want"))
    rows = spark.read.parquet(f"{path}/data").select("part", "section", "mode", "blocks").join(wanted, ["part", "section"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                for w in row["want"]:
                    b = row["blocks"][w["chunk"]]
                    lo, hi = max(0, start - w["start"]), min(b["n"], stop - w["start"])
                    ids = unpack(b["planes"], b["n"], row["mode"])[lo:hi].astype(np.int64)
                    yield pa.RecordBatch.from_pydict({"start": pa.array([w["start"] + lo], pa.int64()), "ids": pa.array([ids], pa.list_(pa.int64()))})

    return rows.mapInArrow(read, "start bigint, ids array<bigint>")


def _decoded(spark: SparkSession, path: str, schema: str, of_ids) -> DataFrame:
    """(doc_id, start, n_tokens, ...) per document; of_ids turns a document's ids into the last column."""
    name = schema.rpartition(",")[2].split()[0]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = np.concatenate([unpack(b["planes"], b["n"], row["mode"]) for b in row["blocks"]])
                ends = np.cumsum(row["lengths"])
                found = [of_ids(ids[e - n : e]) for e, n in zip(ends, row["lengths"], strict=True)]
                yield pa.RecordBatch.from_pydict({
                    "part": np.full(len(ends), row["part"], dtype=np.int32), "section": np.full(len(ends), row["section"], dtype=np.int32), "doc_id": pa.array(row["doc_ids"], pa.int64()),
                    "_at": ends - row["lengths"], "n_tokens": np.array(row["lengths"], dtype=np.int64), name: pa.array(found, pa.list_(pa.int64()) if "array" in schema else pa.int64()),
                })

    docs = spark.read.parquet(f"{path}/data").mapInArrow(read, f"part int, section int, doc_id bigint, _at bigint, n_tokens bigint, {schema}")
    index = spark.read.parquet(f"{path}/index").filter("chunk = 0").select("part", "section", F.col("section_start").alias("_start"))
    return docs.join(index, ["part", "section"]).select("doc_id", (F.col("_start") + F.col("_at")).alias("start"), "n_tokens", name)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of a store; ids end with the end id."""
    return _decoded(spark, path, "ids array<bigint>", lambda ids: ids.astype(np.int64))


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of a store."""
    return _decoded(spark, path, "ids_crc32 bigint", lambda ids: zlib.crc32(ids.tobytes()))


def op8_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes all documents' ids and reads every document's place, length and checksum back."""
    path = Workspace(spark, "ids").path("store")
    write_ids(table(spark, sf_dir, "documents"), path, tokenizer_path())
    return read_digests(spark, path)


QUERIES = {"op8_token_store": op8_token_store}
SQL: dict[str, str] = {}
