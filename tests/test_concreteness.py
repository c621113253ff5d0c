import hashlib
import itertools
import random
import re
import statistics

import pytest
from pyspark.sql import functions as F

from forum_signals.operators import concreteness, sampling, topics
from forum_signals.settings import AnalysisSettings

NORMS = {"apple": 5.0, "idea": 1.5, "red": 4.0, "of": 1.25}
SIZES, RUNS, SEED = (3, 5, 40), 4, "q"
folders = itertools.count()
SETTINGS = AnalysisSettings(
    top_n=10, min_questions=5, sample_size=7, stability_sizes=SIZES, stability_runs=RUNS, stability_tags=3, seed=SEED
)


@pytest.fixture(scope="module")
def data(spark):
    """Tag "hot" holds most pairs, "few" has hardly any titles, "none" has no title at all."""
    rng = random.Random(3)
    words = ["Apple", "idea", "red", "of", "unknown", "x1"]
    titles, pairs = {}, []
    for qid in range(1, 601):
        titles[qid] = None if rng.random() < 0.2 else " ".join(rng.choices(words, k=rng.randint(0, 6)))
        pairs.append((qid, "hot"))
        if qid % 10 == 0:
            pairs.append((qid, "small"))
        if qid % 8 == 0:
            pairs.append((qid, "few"))
            titles[qid] = titles[qid] if qid % 120 == 0 else None
    for qid in range(601, 611):
        titles[qid] = None
        pairs.append((qid, "none"))
    questions = spark.createDataFrame(list(titles.items()), "question_id long, title string").cache()
    tags = spark.createDataFrame(pairs, "question_id long, tag string").repartition(7).cache()
    norms = spark.createDataFrame(list(NORMS.items()), "token string, score double")
    return titles, pairs, questions, tags, norms


def brute_sample(titles, pairs, tag, n, *prefix):
    candidates = [q for q, t in pairs if t == tag and titles[q] is not None]

    def key(q):
        return hashlib.md5("|".join(map(str, (*prefix, tag, q))).encode()).hexdigest(), q

    return sorted(candidates, key=key)[:n]


def brute_score(titles):
    scores = [NORMS[w] for t in titles for w in re.findall("[a-z]+", t.lower()) if w in NORMS]
    return len(scores), (sum(scores) / len(scores) if scores else None)


def test_sample_and_scores_against_brute_force(data, tmp_path):
    titles, pairs, questions, tags, norms = data
    sample = sampling.sample_titles(tags, questions, topics.tag_counts(tags), 7, SEED, str(tmp_path))
    got = {}
    for row in sample.collect():
        got.setdefault(row.tag, set()).add(row.question_id)
        assert row.title == titles[row.question_id]
    for tag in ("hot", "small", "few"):
        assert got[tag] == set(brute_sample(titles, pairs, tag, 7, SEED)), tag
    assert "none" not in got
    scores = {r.topic: r for r in concreteness.concreteness_per_topic(tags, questions, norms, SETTINGS, str(tmp_path / "c")).collect()}
    assert set(scores) == {"hot", "small", "few", "none"}
    for tag in ("hot", "small", "few"):
        chosen = brute_sample(titles, pairs, tag, 7, SEED)
        n, score = brute_score([titles[q] for q in chosen])
        assert (scores[tag].n_sampled, scores[tag].n_words_matched) == (len(chosen), n)
        assert scores[tag].concreteness_score == (None if score is None else pytest.approx(score, abs=1e-12))
    assert tuple(scores["none"])[1:] == (0, 0, None)


def test_stability_against_brute_force(data, tmp_path):
    titles, pairs, questions, tags, norms = data
    runs = concreteness.sample_stability(tags, questions, norms, SETTINGS, str(tmp_path / "c"))
    rows = runs.collect()
    assert len(rows) == 3 * len(SIZES) * RUNS and {r.tag for r in rows} == {"hot", "few", "small"}
    for r in rows:
        chosen = brute_sample(titles, pairs, r.tag, r.sample_size, SEED, r.sample_size, r.run)
        n, score = brute_score([titles[q] for q in chosen])
        assert r.n_words_matched == n
        assert r.concreteness_score == (None if score is None else pytest.approx(score, abs=1e-12))
    summary = {(r.tag, r.sample_size): r for r in concreteness.stability_summary(runs).collect()}
    draws = [r.concreteness_score for r in rows if (r.tag, r.sample_size) == ("hot", 5)]
    assert summary["hot", 5].mean == pytest.approx(statistics.mean(draws))
    assert summary["hot", 5].std == pytest.approx(statistics.stdev(draws))


def test_unlucky_draws_are_drawn_again(data, tmp_path):
    """With no chance to enter a draw at first, every draw must come from a later try."""
    titles, pairs, questions, tags, _ = data
    inflated = topics.tag_counts(tags).where("tag IN ('hot', 'small')").withColumn("n_questions", F.lit(10**12))
    sample = sampling.repeated_samples(tags, questions, inflated, SIZES, RUNS, SEED, str(tmp_path))
    got = {}
    for r in sample.collect():
        got.setdefault((r.tag, r.sample_size, r.run), []).append(r.title)
    for (tag, size, run), found in got.items():
        chosen = brute_sample(titles, pairs, tag, size, SEED, size, run)
        assert sorted(found) == sorted(titles[q] for q in chosen)
    assert len(got) == 2 * len(SIZES) * RUNS


def test_large_tag_with_mostly_missing_titles(spark, tmp_path):
    """More pairs than enter a draw, and too few titles among those that do."""
    questions = spark.range(20_000).select(
        F.col("id").alias("question_id"), F.when(F.col("id") % 100 == 0, F.concat(F.lit("t"), "id")).alias("title")
    )
    tags = questions.select("question_id", F.lit("big").alias("tag"))
    titles = {q: f"t{q}" if q % 100 == 0 else None for q in range(20_000)}
    pairs = [(q, "big") for q in range(20_000)]
    sample = sampling.sample_titles(tags, questions, topics.tag_counts(tags), 10, SEED, str(tmp_path / str(next(folders))))
    assert {r.question_id for r in sample.collect()} == set(brute_sample(titles, pairs, "big", 10, SEED))
    full = sampling.sample_titles(tags, questions.fillna("x", ["title"]), topics.tag_counts(tags), 10, SEED, str(tmp_path / str(next(folders))))
    filled = {q: t or "x" for q, t in titles.items()}
    assert {r.question_id for r in full.collect()} == set(brute_sample(filled, pairs, "big", 10, SEED))


@pytest.mark.parametrize("n", [50, 1280, 5000])
def test_few_pairs_enter_a_draw_whatever_its_size(spark, n):
    """About margin(n) pairs of a large tag become rows for a draw, and no window limit is relied on."""
    pairs = spark.range(60_000).select(F.col("id").alias("question_id"), F.lit("big").alias("tag"))
    tries = sampling._first_tries(topics.tag_counts(pairs), [(n, 1), (n, 2)])
    entered = sampling.entering(pairs, tries, lambda size, run, tag, question: sampling.draw_key("s", size, run, tag, question))
    counts = [r["count"] for r in entered.groupBy("run").count().collect()]
    assert len(counts) == 2 and all(n <= c <= sampling.margin(sampling.margin(n)) for c in counts)
    plan = entered._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" not in plan and "Window" not in plan


def test_score_range(spark):
    scores = spark.createDataFrame([("a", 1.0), ("b", None), ("c", 4.0)], "topic string, concreteness_score double")
    assert tuple(concreteness.score_range(scores).collect()[0]) == (1.0, 4.0, 2.5)
