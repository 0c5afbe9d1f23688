"""The pipeline's stages against plain Python on a small table, each judged on its own input."""

import collections

import corpus_pipeline
from onledger.session import materialize
from tests.llm.conftest import words

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "ngram_jaccard_join", "substring_dedup", "benchmark_decontamination", "sentencepiece"]
    after = {"": docs}
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, SF), "pipeline-test")
        after[name] = docs
        if name != "sentencepiece":
            assert docs.columns == after[""].columns and docs.dtypes == after[""].dtypes
    rows = {n: {r.doc_id: r for r in d.collect()} for n, d in after.items()}

    # quality: kept rows are unchanged, and every rejected row fails a rule
    assert set(rows["quality_rules"]) <= set(rows[""]) and all(rows[""][i] == r for i, r in rows["quality_rules"].items())
    assert all(len(words(r.text)) >= 20 for r in rows["quality_rules"].values())
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    lost = [i for i in rows[""] if i not in rows["quality_rules"] and labels.get(i) == 1 and len(words(rows[""][i].text)) >= 20]
    assert len(lost) <= 2

    # near-duplicates: the smallest id of each class
    sets = {i: frozenset(tuple(words(r.text)[k:k + 5]) for k in range(len(words(r.text)) - 4)) for i, r in rows["quality_rules"].items()}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(sets[a] & sets[b])
            if both and 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    assert set(rows["ngram_jaccard_join"]) == {i for i in ids if root(i) == i}

    # repeated windows are cut, in the order of ids
    seen = set()
    for i in sorted(rows["ngram_jaccard_join"]):
        found = words(rows["ngram_jaccard_join"][i].text)
        gone = [False] * len(found)
        for at in range(len(found) - 19):
            window = tuple(found[at:at + 20])
            if window in seen:
                gone[at:at + 20] = [True] * 20
            seen.add(window)
        r = rows["substring_dedup"][i]
        assert words(r.text) == [w for w, g in zip(found, gone) if not g]
        assert r.n_chars == (len(r.text) if any(gone) else rows["ngram_jaccard_join"][i].n_chars)

    assert set(rows["benchmark_decontamination"]) < set(rows["substring_dedup"])
    assert set(rows["sentencepiece"]) == set(rows["benchmark_decontamination"])
    assert corpus_pipeline.run(spark, SF).count() == len(rows["sentencepiece"])


def test_repeated_rows_and_nulls_pass_through(spark, docs):
    kept = corpus_pipeline.near_duplicates(spark, docs, SF)
    count = collections.Counter(r.doc_id for r in kept.collect())
    assert kept.columns == docs.columns
    assert count[20] == 1 and count[2] == 0 and count[9] == 0 and count[5] == count[6] == count[7] == 1
    cut = corpus_pipeline.substring_dedup(spark, docs, SF)
    assert cut.count() == docs.count() and cut.columns == docs.columns
    assert corpus_pipeline.quality_rules(spark, docs, SF).columns == docs.columns
