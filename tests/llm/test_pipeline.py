"""The pipeline's stages one by one against what their operators tell, and on odd rows."""

import pytest

import corpus_pipeline
from lithograph.llm import decontamination, jaccard_join, pattern_grammar, queries


def ids(df):
    return sorted((r["doc_id"] for r in df.select("doc_id").collect()), key=lambda d: (d is None, d))


def test_stages_decide_as_their_operators_do(spark, sf):
    docs = queries.documents(spark, sf)
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "n-gram Jaccard join", "benchmark decontamination", "mixing sources to target weights", "sharding"]
    clean = stages["toxicity"](spark, docs, sf)
    scores = {r["doc_id"]: r["predicted"] for r in pattern_grammar.classify(docs, queries.labels(spark, sf)).collect()}
    assert ids(clean) == sorted(d for d, p in scores.items() if not p) and clean.columns == docs.columns
    one = stages["n-gram Jaccard join"](spark, clean, sf)
    assert ids(one) == sorted(r["doc_id"] for r in jaccard_join.components(clean).collect() if r["doc_id"] == r["component_id"]) and one.columns == docs.columns
    apart = stages["benchmark decontamination"](spark, one, sf)
    leaks = {r["doc_id"] for r in decontamination.contaminated(one, spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
    assert ids(apart) == [d for d in ids(one) if d not in leaks] and apart.columns == docs.columns
    mixed = stages["mixing sources to target weights"](spark, apart, sf)
    assert set(ids(mixed)) <= set(ids(apart)) and mixed.columns == docs.columns and max(map(ids(mixed).count, set(ids(mixed)))) <= 3
    last = stages["sharding"](spark, mixed, sf)
    assert ids(last) == ids(mixed) and {r["shard"] for r in last.select("shard").collect()} <= set(range(16))
    assert sorted(r["text"] or "" for r in last.collect()) == sorted(r["text"] or "" for r in mixed.collect())
    slots = [(r["shard"], r["slot"]) for r in last.collect()]
    assert len(set(slots)) == len(slots) and all((s, n - 1) in set(slots) for s, n in slots if n)


def test_run_gives_the_stages_in_turn(spark, sf):
    docs = queries.documents(spark, sf)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf).collect())) == sorted(map(tuple, docs.collect()))


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES], ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stages_of_odd_rows(spark, sf, odd, stage):
    out = stage(spark, odd, sf)
    assert out.count() >= 1
    assert stage(spark, odd.limit(0), sf).count() == 0
