"""The pipeline's stages one after another, each judged on its own input."""

import __spark_entry__ as contract
import corpus_pipeline
from spanloom.llm import quality
from spanloom.llm.common import stored
from spanloom.llm.queries import table
from test_documents import brute_hits
from test_minhash import brute


def test_stages(spark, sf):
    docs = table(spark, sf, "documents")
    columns, inputs = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        inputs[name] = docs
        docs = stored(stage(spark, docs, sf), f"test-{name}")
        assert name == "packing" or docs.columns == columns
    texts = {n: {r.doc_id: r.text for r in df.collect()} for n, df in inputs.items()}

    scored = quality.score(inputs["quality"], quality.train(inputs["quality"], table(spark, sf, "labels"))).collect()
    assert set(texts["near_duplicates"]) == {r.doc_id for r in scored if r.score >= quality.CUT}

    groups = brute(texts["near_duplicates"], 80)
    assert set(texts["decontamination"]) == {k for k, (_, root) in groups.items() if k == root}

    hits = brute_hits(list(texts["decontamination"].items()), [tuple(r) for r in table(spark, sf, "benchmark").select("item_id", "text").collect()])
    assert set(texts["pii"]) == {k for k, h in hits.items() if not h[3]}

    changed = [k for k, t in texts["packing"].items() if t != texts["pii"][k]]
    assert set(texts["packing"]) == set(texts["pii"]) and all("[" in texts["packing"][k] for k in changed)
    assert {r.doc_id for r in docs.collect()} == set(texts["packing"])


def test_registered():
    names = contract.queries()
    assert names["pipeline"] is corpus_pipeline.run and [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "pii", "packing"]
    assert all(any(q.startswith(f"op{i}_") for q in names) for i in range(1, 11))
