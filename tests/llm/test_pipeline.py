"""The pipeline's stages one after another, on a small folder of documents."""

import corpus_pipeline
from lanternql.llm import jaccard_join, mixing, quality, queries, secret_scan


def test_stages(spark, docs, tmp_path):
    plain = docs.drop("found", "size")
    plain.write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    now = plain
    for run in (quality.keep_good, jaccard_join.drop_copies, secret_scan.masked, mixing.apply_mix):
        now = run(now)
        assert now.columns == plain.columns
    kept = {r[0] for r in now.select("doc_id").distinct().collect()}
    assert {r["doc_id"] for r in out} == kept
    assert len([n for n, _ in corpus_pipeline.STAGES]) == 5


def test_registered():
    names = list(queries.queries())
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11))
