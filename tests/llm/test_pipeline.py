"""Every stage of the pipeline against a brute-force version, one after the other."""

import brute
import fixture
import pyarrow.parquet as pq
import pytest
from test_copies import near_copies

import corpus_pipeline
from forum_signals.llm import decontamination
from forum_signals.llm.common import stored

SF_DIR = "/root/testdata/sf0.001"


def least_of_groups(dicts, root):
    best = {}
    for at, r in enumerate(root):
        best[r] = min(best.get(r, at), at, key=lambda i: (brute.last(dicts[i]["doc_id"]), i))
    return sorted(best.values())


def brute_stage(name, dicts):
    """The rows that stay."""
    if name == "exact dedup":
        return [d for d, row in zip(dicts, brute.exact_dedup(dicts)) if row[3]]
    if name == "simhash near-dedup":
        return [dicts[i] for i in least_of_groups(dicts, near_copies(dicts))]
    if name == "benchmark decontamination":
        words = lambda t: " " + " ".join(decontamination.fold_words(t)) + " "
        items = [words(r["text"]) for r in pq.read_table(f"{SF_DIR}/benchmark.parquet").to_pylist()]
        return [d for d in dicts if not any(i in words(d["text"]) for i in items if i.strip())]
    return None


@pytest.mark.parametrize("odd", [False, True])
def test_stages(spark, odd):
    given = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    docs = fixture.documents(spark) if odd else given
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = [r.asDict() for r in docs.collect()]
        kept = stored(stage(spark, docs, SF_DIR), "stage")
        assert kept.columns == docs.columns and kept.dtypes == docs.dtypes
        rows = sorted((r.asDict() for r in kept.collect()), key=str)
        expected = brute_stage(name, before)
        if expected is None:  # the classifier: a subset of the rows, unchanged
            assert all(r in before for r in rows) and len(rows) >= 0.5 * len(before)
        else:
            assert [(str(r["doc_id"]), r["text"]) for r in rows] == [(str(r["doc_id"]), r["text"]) for r in sorted(expected, key=str)]
        docs = kept
    encoded = corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR).collect()
    expected = {(str(r[0]), r[1]) for r in brute.byte_bpe([r.asDict() for r in docs.collect()])}
    assert {(str(r.doc_id), r.n_tokens) for r in encoded} == expected and all(len(r.ids) == r.n_tokens for r in encoded)


def test_empty_documents_go_through(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SF_DIR), "stage")
        assert docs.count() == 0


def test_run(spark):
    out = corpus_pipeline.run(spark, SF_DIR)
    assert out.columns == ["doc_id", "n_tokens", "ids"] and 100 < out.count() < 200
