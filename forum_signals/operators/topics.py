"""Topics: tags of questions, their frequencies, and the most frequent ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forum_signals.functions.text import parse_tags


def explode_tags(questions: DataFrame) -> DataFrame:
    """One ``question_id, tag`` row per tag; a question without tags gives none."""
    return questions.select("question_id", F.explode(parse_tags(F.col("raw_tags"))).alias("tag"))


def tag_counts(question_tags: DataFrame) -> DataFrame:
    return question_tags.groupBy("tag").agg(F.count("*").alias("n_questions"))


def top_tags(question_tags: DataFrame, n: int, min_questions: int = 0) -> DataFrame:
    """The n most frequent tags with enough questions; equal counts go by name."""
    counts = tag_counts(question_tags).where(F.col("n_questions") >= min_questions)
    return counts.orderBy(F.desc("n_questions"), "tag").limit(n)


def keep_top_tags(question_tags: DataFrame, n: int) -> DataFrame:
    """Rows of the n most frequent tags. The list is bounded by its limit, from which Spark decides whether to broadcast it."""
    top = top_tags(question_tags, n).select("tag")
    return question_tags.join(top, "tag", "left_semi").select("question_id", "tag")


def distinct_tag_count(question_tags: DataFrame) -> DataFrame:
    return tag_counts(question_tags).agg(F.count("*").alias("n_tags"))


def supported_tags(question_tags: DataFrame, min_questions: int) -> DataFrame:
    """Tags with at least ``min_questions`` rows, in no order."""
    return tag_counts(question_tags).where(F.col("n_questions") >= min_questions)
