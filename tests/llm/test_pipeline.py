"""The stages one after another against what each must do to its input."""

from __future__ import annotations

import corpus_pipeline
from sigmeter.session import materialise
from tests.llm.test_operators import LOW, SCHEMA, brute_components, brute_spans, docs, texts  # noqa: F401


def test_stages_follow_each_other(spark, docs):
    frames = [docs]
    for _, stage in corpus_pipeline.STAGES:
        frames.append(materialise(stage(spark, frames[-1], ""), "test-stage"))
    assert all(f.columns == docs.columns for f in frames[:-1])
    ids = [{r["doc_id"] for r in f.select("doc_id").collect()} for f in frames]
    assert all(b <= a for a, b in zip(ids, ids[1:]))
    first = {r["doc_id"]: r["text"] for r in frames[1].collect()}
    last = {}
    for i in sorted(first):
        last[first[i].translate(LOW)] = i
    assert ids[2] == set(last.values())
    second = [(r["doc_id"], r["text"]) for r in frames[2].orderBy("doc_id").collect()]
    comps = brute_components([t for _, t in second])
    assert ids[3] == {second[c][0] for _, c in comps.values()}
    assert ids[4] == ids[3] == ids[5]
    assert not any(brute_spans(r["text"]) for r in frames[4].collect())


def test_empty_documents(spark):
    docs = materialise(spark.createDataFrame([], SCHEMA), "test-none")
    for _, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, ""), "test-stage")
    assert docs.count() == 0
