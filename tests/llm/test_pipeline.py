"""The stages, each on what the one before it kept, against brute force."""

import hashlib

import numpy as np

import corpus_pipeline as cp
from mirrortab.llm.scratch import saved
from tests.llm.test_tables import base_counts, contaminated_by_hand, groups_by_hand
from tests.llm.test_text import reference_bpe

FOLDER = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    # A row twice, rows without text, letters or id, and one text under many ids.
    extra = [(10**6, None, "en", "s", 0), (10**6 + 1, "1 2 3 4 5 6 7 8 9 10 11 12", None, None, None), (None, docs.first()["text"], None, "s", 5)]
    docs = docs.unionByName(docs.where("doc_id < 3")).unionByName(spark.createDataFrame(extra, docs.schema))
    columns = docs.columns
    assert [n for n, _ in cp.STAGES] == ["quality", "language", "near_dup", "decontaminate", "byte_bpe"]

    def step(number, before):
        out = saved(cp.STAGES[number][1](spark, before, FOLDER), "stage")
        return out, [(r["doc_id"], r["text"]) for r in before.collect()]

    order = lambda ids: sorted(ids, key=lambda i: (i is None, i or 0))
    after, rows = step(0, docs)
    counts = {t: base_counts(t) for _, t in rows}
    # No source here has 20 documents, so no line is common and the base rules decide.
    want = order(i for i, t in rows if counts[t][0] >= 10 and 100 * counts[t][4] <= 20 * counts[t][0])
    assert after.columns == columns and order(r["doc_id"] for r in after.collect()) == want
    docs, before = after, after
    after, rows = step(1, docs)
    assert after.columns == columns
    gone = {i for i, _ in rows} - {r["doc_id"] for r in after.collect()}
    assert 10**6 + 1 in gone and len(gone) <= 3
    docs = after
    after, rows = step(2, docs)
    by_hand = groups_by_hand(rows, 5)
    assert after.columns == columns and order(r["doc_id"] for r in after.collect()) == order({c for _, _, c in by_hand})
    docs = after
    after, rows = step(3, docs)
    hits = contaminated_by_hand(rows, items)
    assert after.columns == columns
    assert order(r["doc_id"] for r in after.collect()) == order(i for i, (n, h, _) in hits.items() if not (h and 20 * h >= n))
    docs = after
    after, rows = step(4, docs)
    enc = reference_bpe()
    want = {i: (len(ids := enc.encode_ordinary(t)), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for i, t in rows}
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in after.collect()} == want


def test_run_on_an_empty_table(spark, tmp_path):
    for name in ("documents", "benchmark"):
        spark.read.parquet(f"{FOLDER}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0
