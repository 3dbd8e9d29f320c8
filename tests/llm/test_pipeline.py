"""The pipeline's stages against plain Python versions of what they may keep."""

from collections import Counter

import corpus_pipeline
from millrace.session import table
from tests.llm.test_operators import ascii_lower, shingle_set

SF = "/root/testdata/sf0.001"


def test_stages_keep_what_they_should(spark, tmp_path):
    docs, seen = table(spark, SF, "documents"), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        after = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "shards":
            assert after.columns == docs.columns
        seen[name], docs = (docs.toPandas(), after.toPandas()), after
    before, after = seen["language"]
    assert set(after.doc_id) == set(before.doc_id)  # all are prose in a known language
    before, after = seen["near_duplicates"]
    sets = {d: shingle_set(t, ascii_lower) for d, t in zip(before.doc_id, before.text)}
    links = lambda a, b: 100 * len(a & b) >= 80 * len(a | b)
    kept = set(after.doc_id)
    assert not any(links(sets[a], sets[b]) for a in kept for b in kept if a < b)
    assert all(any(links(sets[d], sets[k]) for k in sets if k != d) for d in set(sets) - kept)
    before, after = seen["decontamination"]
    items = [shingle_set(t, str.casefold) for t in table(spark, SF, "benchmark").toPandas().text]
    dirty = {d for d, t in zip(before.doc_id, before.text) if any(10 * len(i & shingle_set(t, str.casefold)) >= 8 * len(i) for i in items)}
    assert set(after.doc_id) == set(before.doc_id) - dirty
    before, after = seen["mixture"]
    assert set(after.doc_id) <= set(before.doc_id) and max(Counter(after.doc_id).values()) <= 3
    before, after = seen["shards"]
    assert Counter(before.doc_id) == Counter(after.doc_id)
    assert all(sorted(s) == list(range(len(s))) for s in after.groupby("shard").slot.agg(list))


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "text", "shard", "slot"} <= set(out.columns) and out.count() > 0


def test_stages_on_odd_rows(spark, odd_docs):
    """Each stage on nulls, empty texts, repeated rows and columns named like its own."""
    out = {name: stage(spark, odd_docs, SF).toPandas() for name, stage in corpus_pipeline.STAGES}
    assert all(set(out[name].columns) == set(odd_docs.columns) for name in out)
    ids = {name: Counter(None if d != d else int(d) for d in frame.doc_id) for name, frame in out.items()}
    everything = Counter({1: 2, **{k: 1 for k in range(2, 11)}, None: 2})
    assert not {4, 5, 6, 10} & set(ids["language"]) and out["language"].text.notna().all()  # no letter: und
    assert ids["near_duplicates"] == everything - Counter({1: 1, 2: 1, 3: 1})
    assert ids["decontamination"] == everything
    assert all(n <= 3 * everything[d] for d, n in ids["mixture"].items())
    assert ids["shards"] == everything and all(sorted(s) == list(range(len(s))) for s in out["shards"].groupby("shard").slot.agg(list))


def test_stages_on_no_rows(spark, no_docs):
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, no_docs, SF)
        assert out.columns == no_docs.columns or name == "shards"
        assert out.count() == 0


def test_stages_on_a_text_of_megabytes(spark):
    """Two near copies of 3 MB: a stage sees the text whole and keeps it unchanged."""
    words = [f"w{i}" for i in range(400_000)]
    texts = [" ".join(words), " ".join([*words[:-3], "x", "y", "z"])]
    docs = spark.createDataFrame([(i, t, "en", "a") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    for name, stage in corpus_pipeline.STAGES[1:]:
        got = stage(spark, docs, SF).select("doc_id", "text").toPandas()
        assert all(texts[d] == t for d, t in zip(got.doc_id, got.text)), name
        assert set(got.doc_id) == ({0} if name == "near_duplicates" else {0, 1}), name
