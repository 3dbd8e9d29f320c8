"""The backoff automaton, the source audit and the vector codes against plain versions, and on odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from millrace.llm import backoff, codes, divergence
from millrace.llm.store import Workspace
from tests.llm.test_operators import ascii_lower, words

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


# scoring


def plain_scores(texts, held):
    """(base, score, n_known) of each text by counts in dictionaries, and the number of training tokens."""
    rows = [["<s>", *words(ascii_lower(t or "")), "</s>"] for t in texts]
    train = [r for r, h in zip(rows, held) if not h]
    one, two, three = Counter(), Counter(), Counter()
    for r in train:
        one.update(r[1:])
        two.update(zip(r, r[1:]))
        three.update(zip(r, r[1:], r[2:]))
    n, v = sum(one.values()), len(one)
    k2, k3 = max(1, len(two) / max(1, v)), max(1, len(three) / max(1, len(two)))
    context = Counter(one)
    context["<s>"] = len(train)
    out = []
    for r in rows:
        base = score = known = 0
        for i in range(1, len(r)):
            p = (one[r[i]] + 1) / (n + v + 1)
            base, known = base + math.log10(p), known + (one[r[i]] > 0)
            p = (two[r[i - 1], r[i]] + k2 * p) / (context[r[i - 1]] + k2)
            if i > 1:
                p = (three[r[i - 2], r[i - 1], r[i]] + k3 * p) / (two[r[i - 2], r[i - 1]] + k3)
            score += math.log10(p)
        out.append((base, score, known))
    return out, n


def scored(spark, texts, held, **sizes):
    docs = spark.createDataFrame([(i, h, t) for i, (t, h) in enumerate(zip(texts, held))], "doc_id long, held boolean, text string")
    found, model = backoff.score_documents(docs.repartition(3), "test", **sizes)
    return {r.doc_id: r for r in found.collect()}, model


@pytest.mark.parametrize("block, bucket, run", [(1 << 20, 1 << 20, 512), (600, 50, 3), (1, 1, 1)])
def test_automaton_equals_counts(spark, monkeypatch, block, bucket, run):
    monkeypatch.setattr(backoff, "RUN", run)
    rng = random.Random(4)
    texts = [" ".join(rng.choice("a b c d E é x1".split()) for _ in range(rng.choice((0, 1, 2, 9, 70)))) for _ in range(60)] + [None, "", " \t", "new words", "a b c d " * 2000]
    held = [rng.random() < 0.3 for _ in texts]
    want, n = plain_scores(texts, held)
    got, model = scored(spark, texts, held, block_bytes=block, bucket_bytes=bucket)
    assert model.tokens == n and len(got) == len(texts)
    for i, (base, score, known) in enumerate(want):
        assert got[i].n_known == known and got[i].n_tokens == len(words(texts[i])) + 1 and got[i].held_out == held[i]
        assert got[i].base_score == pytest.approx(base, abs=1e-6) and got[i].score == pytest.approx(score, abs=1e-6)


def test_chances_sum_to_one():
    texts = ["a b c a b", "b c a", "c", "", "a a a b z"]
    grams = backoff.Grams.of(pa.array(texts))
    count = grams.counted(np.array([True, True, True, True, False]))
    tokens, types = 13, 4  # nine words and four ends: a, b, c and the end
    auto = backoff.Automaton(grams, count, backoff.Model(tokens, types, 2.5, 1.5))
    assert int(count[np.unique(grams.token)].sum()) == tokens and int((count[np.unique(grams.token)] > 0).sum()) == types
    for state in range(len(auto.fall)):
        gain = auto.step(np.full(auto.size, state), np.arange(auto.size))[1]
        known = gain[auto.known]
        unknown = gain[~auto.known]  # z: the one unknown token
        assert len(unknown) == 1 and (10**known).sum() + 10 ** unknown[0] == pytest.approx(1)


def test_scores_without_training_and_on_no_rows(spark, odd_docs, no_docs):
    got, model = scored(spark, ["a b", None], [True, True])
    assert model.tokens == 0 and all(r.score == 0 and r.base_score == 0 and r.n_known == 0 for r in got.values())
    held = backoff.held_out("doc_id").alias("held")
    assert backoff.score_documents(no_docs.select("doc_id", held, "text"), "none")[0].count() == 0
    rows = backoff.score_documents(odd_docs.select("doc_id", held, "text"), "odd")[0].collect()
    assert len(rows) == odd_docs.count() and len({r.score for r in rows if r.doc_id == 1}) == 1
    assert not any(r.held_out for r in rows if r.doc_id is None)


def test_planes_of_counts_round_trip():
    x = np.random.default_rng(1).integers(0, 1 << 56, 1000, dtype=np.uint64)
    assert (backoff.counts_of(backoff.packed_counts(x >> np.uint64(9))) == x >> np.uint64(9)).all() and len(backoff.counts_of(backoff.packed_counts(x[:0]))) == 0
    assert (backoff.values(backoff.planes(x, 7), 7) == x).all() and len(backoff.values(b"", 7)) == 0


# divergence


def plain_audit(rows, least, top):
    rows = [(g or "", s or "", TERM.findall(ascii_lower(t or ""))) for t, g, s in rows]
    df, groups = defaultdict(Counter), defaultdict(dict)
    for lang, source, terms in rows:
        df[lang].update(set(terms))
        groups[lang].setdefault(source, Counter()).update(terms)
    out = set()
    for lang, sources in groups.items():
        kept = {t for t, n in df[lang].items() if n >= least}
        share = lambda counts: {t: 1 + 10**9 * (counts[t] + 5) // (sum(counts[u] for u in kept) + 5 * len(kept)) for t in kept}
        p = {s: share(c) for s, c in sources.items()}
        q = share(sum(sources.values(), Counter()))
        for s in sources:
            pairs = sorted(((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in sources if o != s))
            terms = sorted((q[t] - p[s][t], t.encode()) for t in kept if sources[s][t] and p[s][t] > q[t])[:top]
            for part, found in (("pair", pairs), ("term", terms)):
                out |= {(lang, s, part, i.decode(), -v, r + 1) for r, (v, i) in enumerate(found)}
    return out


@pytest.mark.parametrize("slice_terms, blocks", [(1 << 20, 1 << 20), (6, 7)])
def test_audit_equals_brute_force(spark, monkeypatch, slice_terms, blocks):
    monkeypatch.setattr(divergence, "BLOCK_POSTINGS", blocks)
    rng = random.Random(9)
    vocabulary = [f"{a}{b}" for a in "abcé" for b in "xYZ漢"]
    rows = [(" ".join(rng.choices(vocabulary[: 4 + s * 3], k=rng.randrange(0, 25))) + rng.choice(["", ".", "\x00ax-ax1ax", "\t"]), rng.choice(["en", "de", None, ""]), rng.choice(["s", "t", None, "ü"])) for s in (0, 1, 3) for _ in range(60)]
    rows += [("only here", "fr", "x"), (None, "fr", "y"), (None, None, "z")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "text string, lang string, source string, rank int").repartition(5)
    got = divergence.audit(docs, "test", min_docs=5, top=4, slice_terms=slice_terms).collect()
    assert {tuple(r) for r in got} == plain_audit(rows, 5, 4) and len(got) == len({tuple(r) for r in got})


def test_audit_on_odd_rows(spark, odd_docs, no_docs):
    assert divergence.audit(no_docs, "none").count() == 0
    rows = [(r.text, r.lang, r.source) for r in odd_docs.select("text", "lang", "source").collect()]
    assert {tuple(r) for r in divergence.audit(odd_docs, "odd", min_docs=1).collect()} == plain_audit(rows, 1, 50)


def test_shares_are_exact_beyond_64_bits(spark):
    n = 3_000_000_000_000_000_000
    got = spark.range(1).select(divergence.share(divergence.F.lit(n), divergence.F.lit(n + 12345), divergence.F.lit(7).cast("long")).alias("p")).first().p
    assert got == 1 + 10**9 * (n + 5) // (n + 12345 + 35)


# codes


def plain_codes(rows, parts=16, entries=64, rounds=2):
    kept = sorted(((i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v, _ in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1]) // parts
    cut = [(i, [v[p * width : (p + 1) * width] for p in range(parts)]) for i, v in kept]
    books = [[v[p] for _, v in cut[:entries]] for p in range(parts)]
    gap = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda p, v: min((gap(v, e), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        for p in range(parts):
            own = defaultdict(list)
            for _, v in cut:
                own[near(p, v[p])[1]].append(v[p])
            books[p] = [[sum(c) // len(own[k]) for c in zip(*own[k])] if k in own else e for k, e in enumerate(books[p])]
    out = [(i, "".join(f"{near(p, v[p])[1]:02x}" for p in range(parts)), sum(near(p, v[p])[0] for p in range(parts))) for i, v in cut]
    return out, hashlib.sha256(",".join(str(c) for p in books for e in p for c in e).encode()).hexdigest()


def vectors(n, size, seed):
    rng = random.Random(seed)
    rows = [(i, [rng.choice([-0.5, 0.25, 0.1, rng.uniform(-1, 1)]) for _ in range(size)], rng.choice([None, 1, 2])) for i in range(n)]
    return rows + [(n, None, 1), (n + 1, [None] + [0.0] * (size - 1), 2), (n + 2, [float("nan")] + [0.0] * (size - 1), 1), (n + 3, [float("-inf")] + [0.0] * (size - 1), None), (3, rows[3][1], None), (None, rows[5][1], 2)]


@pytest.mark.parametrize("n, size, block", [(150, 32, 4096), (90, 16, 7), (20, 48, 4096)])
def test_codes_equal_plain_rounds(spark, monkeypatch, tmp_path, n, size, block):
    monkeypatch.setattr(codes, "BLOCK", block)
    rows = vectors(n, size, n)
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(4).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = codes.op13_vector_codes(spark, str(tmp_path)).collect()
    want, digest = plain_codes(rows)
    assert Counter((r.vec_id, r.code, r.error) for r in got) == Counter(want) and {r.codebooks_sha256 for r in got} == {digest}
    assert sum({r.label_error for r in got}) >= sum(e for _, _, e in want)


def test_codes_on_no_rows_and_refusals(spark, tmp_path):
    schema = "vec_id long, embedding array<float>, label int"
    spark.createDataFrame([(1, None, 1)], schema).write.parquet(f"{tmp_path}/embeddings.parquet")
    assert codes.op13_vector_codes(spark, str(tmp_path)).count() == 0
    one = lambda *v: spark.createDataFrame([(i, list(x), 1) for i, x in enumerate(v)], schema)
    with pytest.raises(ValueError):
        codes.train(one([0.0] * 17), "vec_id", "embedding")
    with pytest.raises(ArithmeticError):
        codes.train(one([1e30] * 16), "vec_id", "embedding")
    empty = one([], [])
    assert [r.codes for r in codes.encode(empty, "embedding", codes.train(empty, "vec_id", "embedding")).collect()] == [bytes(16)] * 2


def test_codes_keep_other_columns_and_decode(spark):
    rows = [(i, [i / 7.0 + j for j in range(16)], "x", b"old") for i in range(30)]
    table = spark.createDataFrame(rows, "vec_id long, v array<float>, error string, codes binary")
    books = codes.train(table, "vec_id", "v", entries=64)
    out = codes.encode(table, "v", books)
    assert out.columns == ["vec_id", "codes", "error"]
    for r in out.collect():  # as many entries as vectors: each is its own
        assert np.abs(codes.decode(r.codes, books) - rows[r.vec_id][1]).max() <= 1 / 256


def test_labels_are_summed_whole(spark, monkeypatch):
    monkeypatch.setattr(codes.spread_join.__globals__["F"], "broadcast", lambda df: df)
    monkeypatch.setitem(codes.spread_join.__globals__, "HOT_ROWS", 5)
    rows = [(i, "hot" if i % 3 else None if i % 2 else str(i), 10 + i) for i in range(60)]
    space = Workspace(spark, "labels")
    coded = space.put(spark.createDataFrame(rows, "vec_id long, label string, error long"), "coded")
    want = Counter()
    for _, label, e in rows:
        want[label] += e
    got = codes.label_errors(coded, "label", 60).collect()
    assert len(got) == 60 and all(r.label_error == want[r.label] for r in got)


def test_held_out_is_crc32_mod_seven(spark):
    got = spark.range(50).withColumn("h", backoff.held_out("id")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 7 == 2) for r in got)
