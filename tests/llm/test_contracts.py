"""Every registered query of the package against brute force, and on empty tables."""

import duckdb
import llm_brute as brute
import pyarrow.dataset as ds
import pytest

from quillmark.llm import queries

PLAIN = {
    "op2_media_columns": (lambda d, b: brute.media(d), ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32"]),
    "op3_ngram_jaccard": (lambda d, b: brute.near_duplicates(d), ["n_shingles", "component_id", "n_links"]),
    "op4_decontaminate": (brute.contamination, ["n_words", "n_hit", "n_items", "items_sha256", "contaminated"]),
    "op6_substring_dedup": (lambda d, b: brute.substrings(d), ["n_words", "n_removed", "kept_sha256"]),
    "op7_lm_scoring": (lambda d, b: None, ["held_out", "n_tokens", "n_known", "train_tokens", "base_score"]),
    "op8_byte_bpe": (lambda d, b: brute.encoded(d), ["n_tokens", "ids_sha256", "decoded_sha256"]),
    "op10_pii": (lambda d, b: brute.personal(d), ["n_email", "n_ip", "n_card", "n_phone", "base_sha256"]),
}


def rows_of(folder, name):
    return ds.dataset(f"{folder}/{name}.parquet").to_table().to_pylist()


@pytest.mark.parametrize("name", PLAIN)
def test_equals_brute_force(spark, data_dir, name):
    make, columns = PLAIN[name]
    docs = rows_of(data_dir, "documents")
    want = brute.base_scores(docs) if name == "op7_lm_scoring" else make(docs, rows_of(data_dir, "benchmark"))
    got = queries.QUERIES[name](spark, data_dir).collect()
    assert len(got) == len(docs)
    for r in got:
        row = tuple(round(v, 5) if isinstance(v, float) else v for v in (r[c] for c in columns))
        assert row == want[r.doc_id], r.doc_id


@pytest.mark.parametrize("name", queries.ORACLE_SQL)
def test_equals_sql(spark, data_dir, name):
    database = duckdb.connect()
    for table in ("documents", "pages", "embeddings", "conversations"):
        path = f"{data_dir}/{table}.parquet"
        database.sql(f"CREATE VIEW {table} AS SELECT {'DISTINCT' if table == 'documents' else ''} * FROM '{path + '/*.parquet' if not path.startswith('/root/testdata') else path}'")
    got = queries.QUERIES[name](spark, data_dir)
    want = database.sql(queries.ORACLE_SQL[name])
    rows = [tuple(r[c] for c in want.columns) for r in got.collect()]
    if name == "op9_line_dedup":
        rows = set(rows)  # the repeated row
    if name == "op11_embedding_near_dedup":
        rows = [r for r in rows if r[0] is not None]  # SQL's kept of a row without vec_id is null
        want = want.filter("vec_id IS NOT NULL")
    assert sorted(rows, key=repr) == sorted(want.fetchall() if hasattr(want, "fetchall") else want.df().itertuples(index=False), key=repr)


@pytest.mark.parametrize("name", queries.QUERIES)
def test_empty_tables(spark, empty_dir, name):
    assert queries.QUERIES[name](spark, empty_dir).collect() == []


def test_language_id(spark, data_dir):
    got = {r.doc_id: r for r in queries.QUERIES["op1_language_id"](spark, data_dir).collect()}
    docs = {d["doc_id"]: d for d in rows_of(data_dir, "documents")}
    known = {d["lang"] for d in docs.values()} - {None}
    for i, r in got.items():
        lettered = any(c.isalpha() for c in docs[i]["text"] or "")
        assert 0 <= r.score <= 1 and (r.lang_pred in known if lettered else r.lang_pred == "und")
    if len(docs) > 100:
        held = [r.lang_pred == docs[i]["lang"] for i, r in got.items() if r.held_out]
        assert sum(held) / len(held) > 0.97


def test_terms_beside_an_entity(spark, tmp_path):
    docs = [(i, f"filler{i} words stand here zorro ann@x.org is near the end {'of all ' * (i % 3)}", None) for i in range(6)] + [(100 + i, f"words stand here is near the end of all {i}", None) for i in range(400)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.spans for r in queries.QUERIES["op10_pii"](spark, str(tmp_path)).collect()}
    for i, text, _ in docs:
        at = text.find("zorro")
        assert got[i] == (f"term:{at}:{at + 5},email:{at + 6}:{at + 15}" if i < 6 else "")


def test_model_probabilities_sum_to_one(spark):
    from quillmark.llm import lm

    texts = ["a b a c", "b a b d d", "a b", None, "c a b b a"] * 3
    model = lm.fit(spark.createDataFrame([(t,) for t in texts], "text string"))
    shards = lm.Shards(model.folder, model.bits)
    for past in (None, "a", "b", "never"):
        assert sum(10 ** _step(lm, model, shards, past, w) for w in ("a", "b", "c", "d", "unknown", None)) == pytest.approx(1)


def _step(lm, model, shards, past, word):
    """log10 of the probability of one bigram; None is the edge of the text."""
    import numpy as np
    import pyarrow as pa

    from quillmark.llm._words import words

    code = lambda w, edge: edge if w is None else next(words(pa.array([w]))).hashes[0]
    history, token = np.array([code(past, lm.BEGIN)]), np.array([code(word, lm.END)])
    n = shards.find("key", "n", lm.keys_of(history, token), np.zeros(1, np.int64))
    count = shards.find("token", "count", token, np.zeros((1, 2), np.int64))
    stats = shards.find("history", "stats", history, np.zeros((1, 4), np.float32)).astype(float)
    spare = sum(d * m for d, m in zip(model.lower, model.m)) / model.t
    lower = lm._cut(count[:, 1], model.lower) / model.t + spare / (model.v + 1)
    seen = max(stats[0, 0], 1)
    weight = stats[0, 1:] @ np.array(model.upper) / seen if stats[0, 0] else 1.0
    return float(np.log10(lm._cut(n, model.upper) / seen + weight * lower)[0])
