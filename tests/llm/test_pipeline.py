import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline  # noqa: E402
from tests.conftest import SF001  # noqa: E402
from threadscope.llm import decontam, mixing, ngram_join, toxicity  # noqa: E402


def test_every_stage_on_what_the_one_before_kept(spark, tmp_dir):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    labels, bench = spark.read.parquet(f"{SF001}/labels.parquet"), spark.read.parquet(f"{SF001}/benchmark.parquet")
    ids = lambda df: sorted(r[0] for r in df.select("doc_id").collect())
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF001)
        out.write.parquet(f"{tmp_dir}/{k}")
        out = spark.read.parquet(f"{tmp_dir}/{k}")
        if name != "token_ids":
            assert out.columns == docs.columns
        if name == "toxicity":
            want = ids(toxicity.score(docs, labels).where("predicted = 0"))
        elif name == "ngram_join":
            want = ids(ngram_join.ngram_components(docs).where("doc_id = component_id"))
        elif name == "decontamination":
            want = ids(decontam.contamination(docs, bench).where("not contaminated"))
        else:
            plan = mixing.mix(mixing.measure(docs)).select("doc_id", "copies").collect() if name == "mixing" else None
            want = sorted(r[0] for r in plan for _ in range(r[1])) if plan is not None else ids(docs)
        assert ids(out) == want, name
        docs = out
    rows = sorted(docs.collect(), key=lambda r: r["start"])
    assert rows[0]["start"] == 0 and all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(rows, rows[1:]))
    assert [r["doc_id"] for r in rows] == want


def test_run_equals_its_stages(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF001)
    assert sorted(corpus_pipeline.run(spark, SF001).collect()) == sorted(docs.collect())
