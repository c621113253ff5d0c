"""Vocabulary concreteness of topics, from sampled question titles and word norms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forum_signals.functions.text import tokenize
from forum_signals.operators.sampling import all_draws, repeated_samples, sample_titles, with_draws
from forum_signals.operators.topics import supported_tags, top_tags
from forum_signals.settings import AnalysisSettings
from forum_signals.sources.tables import write_table


def matched_tokens(titles: DataFrame, norms: DataFrame, group: Sequence[str]) -> DataFrame:
    """``token, n, score`` per group: how often each token that has a norm occurs in ``title``.

    Tokens are counted per group before they meet the norms, so a frequent word is one row.
    Whether the norms are broadcast is left to Spark, which measures them.
    """
    tokens = titles.select(*group, F.explode(tokenize(F.col("title"))).alias("token"))
    counted = tokens.groupBy(*group, "token").agg(F.count("*").alias("n"))
    return counted.join(norms, "token", "inner")


def score_titles(titles: DataFrame, norms: DataFrame, group: Sequence[str]) -> DataFrame:
    """``n_words_matched`` and the mean norm of all matched tokens, per group."""
    return (
        matched_tokens(titles, norms, group).groupBy(*group)
        .agg(F.sum("n").alias("n_words_matched"), F.sum(F.col("n") * F.col("score")).alias("_sum"))
        .withColumn("concreteness_score", F.col("_sum") / F.col("n_words_matched"))
        .drop("_sum")
    )


def concreteness_per_topic(
    question_tags: DataFrame, questions: DataFrame, norms: DataFrame, settings: AnalysisSettings, folder: str
) -> DataFrame:
    """``topic, n_sampled, n_words_matched, concreteness_score`` for every supported tag.

    The tags are counted once, and the counts and the samples are kept below ``folder``.
    """
    topics = write_table(supported_tags(question_tags, settings.min_questions), f"{folder}/topics")
    sample = sample_titles(question_tags, questions, topics, settings.sample_size, settings.seed, folder)
    sizes = sample.groupBy("tag").agg(F.count("*").alias("n_sampled"))
    scores = score_titles(sample, norms, ["tag"])
    return (
        topics.join(sizes, "tag", "left")
        .join(scores, "tag", "left")
        .select(
            F.col("tag").alias("topic"),
            F.coalesce("n_sampled", F.lit(0).cast("bigint")).alias("n_sampled"),
            F.coalesce("n_words_matched", F.lit(0).cast("bigint")).alias("n_words_matched"),
            "concreteness_score",
        )
        .orderBy("topic")
    )


def score_range(scores: DataFrame) -> DataFrame:
    return scores.agg(
        F.min("concreteness_score").alias("min_score"),
        F.max("concreteness_score").alias("max_score"),
        F.avg("concreteness_score").alias("mean_score"),
    )


def sample_stability(
    question_tags: DataFrame, questions: DataFrame, norms: DataFrame, settings: AnalysisSettings, folder: str
) -> DataFrame:
    """Scores of repeated samples: ``tag, sample_size, run, n_words_matched, concreteness_score``.

    The tags are counted once, and the counts and the samples are kept below ``folder``.
    """
    sizes, runs = settings.stability_sizes, settings.stability_runs
    tags = write_table(top_tags(question_tags, settings.stability_tags, settings.min_questions), f"{folder}/topics")
    sample = repeated_samples(question_tags, questions, tags, sizes, runs, settings.seed, folder)
    group = ["tag", "sample_size", "run"]
    scores = score_titles(sample, norms, group)
    return (
        with_draws(tags.select("tag"), all_draws(sizes, runs))
        .join(scores, group, "left")
        .select(
            *group, F.coalesce("n_words_matched", F.lit(0).cast("bigint")).alias("n_words_matched"), "concreteness_score"
        )
        .orderBy(*group)
    )


def stability_summary(stability: DataFrame) -> DataFrame:
    """Mean and sample standard deviation of the scores per tag and sample size."""
    scored = stability.where(F.col("concreteness_score").isNotNull())
    return (
        scored.groupBy("tag", "sample_size")
        .agg(F.avg("concreteness_score").alias("mean"), F.stddev_samp("concreteness_score").alias("std"))
        .orderBy("tag", "sample_size")
    )
