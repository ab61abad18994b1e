"""The pipeline's stages against brute force, each on what the one before it kept."""

from __future__ import annotations

import corpus_pipeline
from prospecta.llm import decontaminate, repeats, toxicity
from prospecta.llm.common import store, table
from tests.llm.test_operators import leaks_brute, near_brute, pairs, repeats_brute, words


def test_stages_against_brute_force(spark, sf):
    docs = table(spark, sf, "documents")
    columns, names = docs.columns, [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_duplicates", "repeats", "decontamination", "mixing"]
    steps = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = store(stage(spark, docs, sf), f"test-{name}")
        steps[name] = before, docs
        assert name == "mixing" or docs.columns == columns

    before, after = steps["toxicity"]
    predicted = {r["doc_id"]: r["predicted"] for r in toxicity.classify(before, table(spark, sf, "labels")).collect()}
    assert sorted(pairs(after)) == sorted(p for p in pairs(before) if not predicted[p[0]])

    before, after = steps["near_duplicates"]
    kept = {d for d, _, _, k in near_brute(pairs(before)) if k}
    assert sorted(pairs(after)) == sorted(p for p in pairs(before) if p[0] in kept)

    before, after = steps["repeats"]
    rows = pairs(before)
    removed = {d: r[1] for (d, _), r in zip(rows, repeats_brute([t.encode() for _, t in rows], repeats.LENGTH))}
    for d, t in pairs(after):
        size = len(next(x for i, x in rows if i == d).encode()) - removed[d]
        assert size - 6 * 50 <= len(t.encode()) <= size  # characters that were cut in two are dropped
    assert all(r["n_chars"] == len(r["text"]) for r in after.collect())

    before, after = steps["decontamination"]
    items = [(r["item_id"], r["text"]) for r in table(spark, sf, "benchmark").collect()]
    clean = {r[0] for r in leaks_brute(pairs(before), items, decontaminate.WINDOW) if not r[5]}
    assert sorted(pairs(after)) == sorted(p for p in pairs(before) if p[0] in clean)

    before, after = steps["mixing"]
    sizes = {d: len(words(t)) for d, t in pairs(before)}
    assert {r["doc_id"]: r["size"] for r in after.collect()} == sizes
    assert abs(sum(r["taken"] for r in after.collect()) - 1.5 * sum(sizes.values())) < 21


def test_stages_on_odd_and_empty_tables(spark, sf, odd_docs, make_docs):
    for docs in (odd_docs, make_docs([])):
        n = docs.count()
        for name, stage in corpus_pipeline.STAGES:
            out = store(stage(spark, docs, sf), f"odd-{name}")
            assert out.count() <= n and (name == "mixing" or out.columns == docs.columns)
            if name == "repeats":
                assert out.where("text IS NULL").count() == docs.where("text IS NULL").count()
