"""The pipeline against brute force, stage by stage on its own input."""

import pyarrow.parquet as pq
import llm_brute as brute

import corpus_pipeline
from quillmark.llm._store import table, written


def test_stages(spark, sf_dir):
    docs, items = table(spark, sf_dir, "documents"), pq.read_table(f"{sf_dir}/benchmark.parquet").to_pylist()
    rows = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = [r.asDict() for r in docs.collect()], written(stage(spark, docs, sf_dir))
        rows[name] = [r.asDict() for r in docs.collect()]
        if name != "byte_bpe":
            assert set(docs.columns) == {"doc_id", "text", "lang", "source", "n_chars"}
        if name == "language_id":
            assert {r["doc_id"] for r in before} - {r["doc_id"] for r in rows[name]} <= {r["doc_id"] for r in before if len(r["text"] or "") < 100}
        if name == "line_dedup":
            want = brute.deduped_lines(before)
            assert {r["doc_id"]: r["text"] for r in rows[name]} == {i: t for i, t in want.items() if t or not next(r["text"] for r in before if r["doc_id"] == i)}
        if name == "near_duplicates":
            assert {r["doc_id"] for r in rows[name]} == {i for i, x in brute.near_duplicates(before).items() if x[1] == i}
        if name == "decontaminate":
            assert {r["doc_id"] for r in rows[name]} == {r["doc_id"] for r in before}
            clean = {i for i, x in brute.contamination(before, items).items() if not x[4]}
            assert {r["doc_id"]: r["text"] for r in rows[name] if r["doc_id"] in clean} == {r["doc_id"]: r["text"] for r in before if r["doc_id"] in clean}
        if name == "byte_bpe":
            assert {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in rows[name]} == brute.encoded(before)
    assert sorted(map(str, (r.asDict() for r in corpus_pipeline.run(spark, sf_dir).collect()))) == sorted(map(str, rows["byte_bpe"]))
