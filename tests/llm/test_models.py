"""LM scoring and the quality classifier: exact parts against brute force, gradients, held-out results."""

import math

import brute
import fixture
import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from forum_signals.llm import attention_lm as lm
from forum_signals.llm import lm_scoring, quality, queries

BPE = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
SMALL, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return fixture.documents(spark)


@pytest.mark.parametrize("common", [200_000, 3])
def test_scores_of_odd_rows(docs, common):
    """With three words in the broadcast the others are joined."""
    rows = lm_scoring.score_texts(docs, *BPE, common=common, every=1, task_windows=50).collect()
    key = lambda r: (str(r[0]), r[2], round(r[5], 6))
    got = sorted([(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in rows], key=key)
    for ours, theirs in zip(got, sorted(brute.base_scores(fixture.as_dicts()), key=key), strict=True):
        assert ours[:5] == theirs[:5] and ours[5] == pytest.approx(theirs[5], rel=1e-9)
    assert all(math.isfinite(r.score) and r.score < 0 for r in rows)
    ends = {r.score for r in rows if r.n_tokens == 1}
    assert len(ends) == 1  # null, empty and blank texts are the end alone


def test_scores_without_training_rows(spark, docs):
    held = [(r["doc_id"], r["text"]) for r in fixture.as_dicts() if r["doc_id"] is None]
    rows = lm_scoring.score_texts(spark.createDataFrame(held, "doc_id long, text string"), *BPE).collect()
    assert all(r.held_out and r.train_tokens == r.n_known == 0 and r.base_score == 0 and math.isfinite(r.score) for r in rows)
    assert lm_scoring.score_texts(docs.limit(0), *BPE).count() == 0


def random_model(seed=0):
    rng = np.random.default_rng(seed)
    model = lm.Model.initial()
    for part in model.parts():
        part += (rng.standard_normal(part.shape) * 0.2).astype(np.float32)
    counts = lm.ClassCounts.from_bigrams(rng.integers(0, 5, (lm.CLASSES + 1, lm.CLASSES)).astype(float))
    return model, counts


def plain_score(model, counts, ids, place):
    """log p of one place, from its window's context written out."""
    first = place // lm.STRIDE * lm.STRIDE
    before = [lm.START, *ids[:-1]]
    seen = [(p, before[p]) for p in range(max(0, first - lm.CONTEXT), place + 1)]
    e = np.array([model.embed[c] + model.place[p - first + lm.CONTEXT] for p, c in seen], dtype=np.float64)
    weight = np.exp((e[-1] @ model.query) @ (e @ model.key).T / math.sqrt(lm.WIDTH))
    o = weight / weight.sum() @ (e @ model.value)
    u = np.maximum((e[-1] + o @ model.mix) @ model.layer + model.bias, 0)
    g, m = divmod(ids[place], lm.GROUP)
    logits = u @ model.group + counts.group[before[place]], u @ model.member[g] + counts.member[before[place], g]
    return sum(x[i] - math.log(np.exp(x).sum()) for x, i in zip(logits, (g, m)))


def test_windows_score_each_place_once_with_masked_attention():
    rng = np.random.default_rng(1)
    model, counts = random_model()
    texts = [rng.integers(0, lm.CLASSES, n) for n in (1, 31, 32, 33, 48, 100)]
    vocabulary = lm_scoring.Vocabulary(np.arange(lm.CLASSES + 5, 5, -1).astype(np.int64))
    assert (vocabulary.class_of[: lm.CLASSES] == np.arange(lm.CLASSES)).all()
    got = lm_scoring.score_ids(texts, model, counts, vocabulary)
    for text, score in zip(texts, got):
        expected = sum(plain_score(model, counts, text.tolist(), p) for p in range(len(text)))
        own = vocabulary.within[text].sum()
        assert score * math.log(10) == pytest.approx(expected + own, rel=1e-4)
    alone = [lm_scoring.score_ids([t], model, counts, vocabulary)[0] for t in texts]
    assert alone == pytest.approx(got.tolist(), rel=1e-4)


def test_class_probabilities_add_up_to_one():
    model, counts = random_model(3)
    seen = np.random.default_rng(2).integers(0, lm.CLASSES, (1, lm.LENGTH))
    total = np.zeros(lm.STRIDE)
    for c in range(lm.CLASSES):
        total += np.exp(model.log_probabilities(seen, np.full((1, lm.STRIDE), c), counts)[0])
    assert total == pytest.approx(np.ones(lm.STRIDE), rel=1e-3)


def test_model_gradient():
    rng = np.random.default_rng(4)
    model, counts = random_model(5)
    seen, targets = rng.integers(0, lm.CLASSES, (3, lm.LENGTH)), rng.integers(0, lm.CLASSES, (3, lm.STRIDE))
    seen[0, : lm.CONTEXT] = lm.OUTSIDE
    counted = rng.random((3, lm.STRIDE)) < 0.8
    loss = lambda: -model.log_probabilities(seen, targets, counts)[counted].astype(np.float64).mean()
    for part, gradient in zip(model.parts(), model.gradient(seen, targets, counted, counts)):
        direction = gradient / (np.linalg.norm(gradient) + 1e-12)
        step = np.float32(1e-2) * direction.astype(np.float32)
        part += step
        up = loss()
        part -= 2 * step
        down = loss()
        part += step
        assert (up - down) / 2e-2 == pytest.approx(np.linalg.norm(gradient), rel=0.05, abs=2e-4)


def test_every_place_of_the_training_texts_is_trained_on(spark, docs):
    texts = docs.select("text", F.col("doc_id").alias("id"))
    counts = lm_scoring.count_subwords(lm_scoring.count_words(texts), *BPE)
    corpus = lm_scoring.read_corpus(texts, lm_scoring.Vocabulary(counts), *BPE, lm_scoring.TRAIN_EVERY)
    targets = [np.frombuffer(r.window, dtype=np.int16)[lm.LENGTH :] for r in corpus.where("window IS NOT NULL").collect()]
    own = lm_scoring.subwords(*BPE)
    ids = own.ids([lm_scoring.words_of((r.text or "").encode()) for r in texts.collect()])
    assert sum((x >= 0).sum() for x in targets) == sum(map(len, ids))
    assert lm.CONTEXT >= 16


def test_training_helps_on_held_out_texts(spark):
    from forum_signals.llm.common import id_bucket, table
    from pyspark.sql import functions as F

    texts = table(spark, LARGER, "documents").select(F.col("doc_id").alias("id"), "text")
    training = texts.where(id_bucket(F.col("id"), 10) != 0)
    by_id = lm_scoring.count_subwords(lm_scoring.count_words(training), *BPE)
    by_id[-1] += training.count()
    vocabulary = lm_scoring.Vocabulary(by_id)
    corpus = lm_scoring.read_corpus(training, vocabulary, *BPE, every=32)
    trained, counts = lm_scoring.train_model(corpus, task_windows=300)  # several copies, averaged
    held = [r.text for r in texts.where(id_bucket(F.col("id"), 10) == 0).collect()]
    own = lm_scoring.subwords(*BPE)
    ids = own.ids([lm_scoring.words_of(t.encode()) for t in held])
    before = lm_scoring.score_ids(ids, lm.Model.initial(), counts, vocabulary).sum()
    after = lm_scoring.score_ids(ids, trained, counts, vocabulary).sum()
    assert after > before


def test_registered_model_beats_the_unigram_base_on_held_out_documents(spark):
    rows = queries.op5_lm_scoring(spark, LARGER).where("held_out").collect()
    tokens = sum(r.n_tokens for r in rows)
    assert sum(r.score for r in rows) / tokens > sum(r.base_score for r in rows) / tokens + 0.05


def test_quality_on_held_out_documents(spark):
    rows = {r.doc_id: r for r in queries.op6_quality(spark, LARGER).collect()}
    assert len(rows) == 1000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows.values())
    labels = pq.read_table(f"{LARGER}/labels.parquet").to_pylist()
    held = [(x["quality"], rows[x["doc_id"]]) for x in labels if rows[x["doc_id"]].held_out]
    assert sum(q == r.predicted for q, r in held) / len(held) > 0.93
    good = [r.predicted for q, r in held if q == 1]
    assert sum(good) / len(good) > 0.97


def test_quality_of_odd_rows(spark, docs):
    labels = spark.createDataFrame([(i, i % 2, None) for i in range(1, 28)] + [(None, 1, 0), (2, None, 1), (2, 7, 1), (99, 1, 1), (7, 1, 1)], "doc_id long, quality int, text int")
    net = quality.fit_documents(docs, labels)
    rows = quality.score_documents(docs, net, docs.columns).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    blank = {r.score for r in rows if not r.row.text}
    assert len(blank) == 1
    again = quality.score_documents(docs.repartition(1), quality.fit_documents(docs.repartition(2), labels), ["doc_id"]).collect()
    assert sorted(round(r.score, 5) for r in rows) == sorted(round(r.score, 5) for r in again)
    for none in (quality.fit_documents(docs, labels.limit(0)), quality.fit_documents(docs.limit(0), labels)):
        assert {r.score for r in quality.score_documents(docs, none, ["doc_id"]).collect()} == {0.5}
    assert quality.score_documents(docs.limit(0), net, ["doc_id"]).count() == 0


def test_quality_sample_of_skewed_texts(spark):
    """One very long text first in hash order leaves no other out, and a label that comes late in it still takes part."""
    from forum_signals.llm.common import id_bucket
    from pyspark.sql import functions as F

    good, bad = "A plain line of words, as people write them.\n", "$$ ## 000 ||| @@ 999 %%% !!\n"
    ids = [r.id for r in spark.range(400).where(id_bucket(F.col("id"), 5) != 0).orderBy(F.xxhash64("id")).collect()]
    rows = [(n, (good if at % 2 else bad) * (20_000 if at == 0 else 3), at % 2) for at, n in enumerate(ids)]
    late = [(n, (bad if at > len(ids) - 20 else good) * 3, int(at <= len(ids) - 20)) for at, n in enumerate(ids)]
    for table, options in ((rows, {"max_bytes": 60_000}), (late, {"max_rows": 100})):
        docs = spark.createDataFrame([r[:2] for r in table], "doc_id long, text string")
        labels = spark.createDataFrame([(r[0], r[2]) for r in table], "doc_id long, quality int")
        net = quality.fit_documents(docs, labels, **options)
        found = {r.row.doc_id: r.score for r in quality.score_documents(docs, net, ["doc_id"]).collect()}
        assert all((found[n] >= 0.3) == bool(label) for n, _, label in table)


def test_passages():
    texts = [None, b"", b"ab\ncd", b"x" * 600, b"\n", b"last"]
    features, starts = quality.encode_passages(texts)
    assert starts.tolist() == [0, 1, 2, 4, 7, 8] and len(features) == 9
    alone = [quality.encode_passages([t])[0] for t in texts]
    assert np.array_equal(np.concatenate(alone), features)


def test_quality_gradient():
    rng = np.random.default_rng(6)
    net = quality.fit(np.zeros((0, quality.N_FEATURES), np.float32), np.zeros(0, np.int64), np.zeros(0, np.float32))
    for part in net.parts():
        part += (rng.standard_normal(part.shape) * 0.3).astype(part.dtype)
    x, starts = rng.random((9, quality.N_FEATURES)).astype(np.float32), np.array([0, 1, 5])
    labels = np.array([1, 0, 1], dtype=np.float32)

    def loss():
        p = net.score(x, starts)
        return -(labels * np.log(p) + (1 - labels) * np.log(1 - p)).mean()

    for part, gradient in zip(net.parts(), net.gradient(x, starts, labels)):
        direction = gradient / (np.linalg.norm(gradient) + 1e-12)
        step = (1e-2 * direction).astype(np.float32)
        part += step
        up = loss()
        part -= 2 * step
        down = loss()
        part += step
        assert (up - down) / 2e-2 == pytest.approx(np.linalg.norm(gradient), rel=0.05, abs=2e-4)


def test_quality_of_short_lines_and_long_texts():
    """Short lines are read together, and a long text in blocks scores like the whole; every byte counts in both."""
    rng = np.random.default_rng(4)
    lines = b"\n" * 300_000
    x, starts = quality.encode_passages([lines, b"ab\n" * 50, b"", None, b"one long line " * 40])
    sizes = np.diff(np.append(starts, len(x)))
    assert sizes[0] <= len(lines) // quality.LINE_BYTES + 2 and x.nbytes < 12 * len(lines) and sizes[2] == sizes[3] == 1
    text = b"".join(bytes(rng.integers(97, 110, rng.integers(1, 90), dtype=np.uint8)) + b"\n" for _ in range(2_000))
    net = quality.Network(*[rng.normal(size=s).astype(np.float32) / 4 for s in ((quality.N_FEATURES, quality.WIDTH), (quality.WIDTH, 8), (quality.WIDTH, 8), (8,), (quality.WIDTH,), (1,))])
    parts = [text[at : at + 10_000] for at in range(0, len(text), 10_000)]
    x = np.concatenate([quality.encode_passages([p])[0] for p in parts])
    whole = float(net.score(x, np.array([0]))[0])
    quality.BLOCK_BYTES, before = 10_000, quality.BLOCK_BYTES
    try:
        assert net.score_blocks(text) == pytest.approx(whole, rel=1e-4)
    finally:
        quality.BLOCK_BYTES = before
