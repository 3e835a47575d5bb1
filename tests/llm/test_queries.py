"""The registered queries against their oracles, and the others' held-out accuracy, on small tables."""

import os

import pytest

pytest.importorskip("public_tokenizers")

from pyspark.sql import functions as F  # noqa: E402

from linkloom.llm import queries  # noqa: E402
from tests.oracle import SF, same  # noqa: E402

LARGER = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF) or not os.path.isdir(LARGER), reason="no tables")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, name):
    same(spark, queries.QUERIES[name], queries.ORACLES[name])


def test_token_counts_equal_the_library(spark):
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(queries.TOKENIZER))
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in queries.op1_token_counts(spark, SF).collect():
        assert r.n_tokens == len(sp.encode(texts[r.doc_id])) and r.n_bytes == len(texts[r.doc_id].encode()) and r.over_limit == (r.n_tokens > 4096)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{LARGER}/documents.parquet").select("doc_id", "lang")
    got = queries.op2_language_id(spark, LARGER).where("held_out").join(docs, "doc_id")
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.98
    labels = spark.read.parquet(f"{LARGER}/labels.parquet")
    for name, label, least in (("op8_toxicity", "toxic", 0.93), ("op10_quality_classifier", "quality", 0.95)):
        scored = queries.QUERIES[name](spark, LARGER).where("held_out").join(labels, "doc_id")
        assert scored.agg(F.avg((F.col("predicted") == F.col(label)).cast("int"))).first()[0] > least, name


def test_near_duplicates_link_what_shares_shingles(spark):
    from linkloom.llm.near_dedup import _WORD

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{LARGER}/documents.parquet").collect()}
    classes = {r.doc_id: r.class_id for r in queries.op9_near_dedup(spark, LARGER).collect()}
    sets, places = {}, {}
    for i, t in texts.items():
        w = _WORD.findall(t.lower())
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
        for s in sets[i]:
            places.setdefault(s, []).append(i)
    pairs = {(a, b) for at in places.values() if len(at) < 200 for a in at for b in at if a < b}
    similar = [(a, b) for a, b in pairs if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert len(similar) > 50 and all(classes[a] == classes[b] for a, b in similar)


def test_whitening_against_numpy(spark):
    import numpy as np

    rows = spark.read.parquet(f"{LARGER}/embeddings.parquet").orderBy("vec_id").collect()
    x = np.floor(1024 * np.array([r.embedding for r in rows], float)).astype(int) + 100_000
    n, far = len(x), len(x) * x - x.sum(axis=0)
    values, vectors = np.linalg.eigh((far / n).T @ (far / n) / n)
    want = np.abs(far / n @ vectors[:, ::-1][:, :8] / np.sqrt(values[::-1][:8]))
    got = queries.op12_whitening(spark, LARGER).orderBy("vec_id", "component").collect()
    assert [(r.vec_id, r.component) for r in got] == [(r.vec_id, c) for r in rows for c in range(1, 9)]
    assert np.allclose(np.abs(np.array([r.whitened for r in got]).reshape(n, 8)), want, atol=1e-8)
    assert np.allclose([r.explained for r in got[:8]], values[::-1][:8] / values.sum(), rtol=1e-9)
    assert [r.deviation for r in got[::8]] == (far * far).sum(axis=1).tolist() and {r.n for r in got} == {n} and got[0].identity_error < 1e-10
