"""Rates and contingency counts per topic, per topic and category, and overall."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forum_signals.functions.lexicon import CATEGORY_PREFIX, PHRASES
from forum_signals.functions.matching import HAS_MISCOMM, category_columns, flag_columns
from forum_signals.operators.model import ANSWER


def tagged_flags(question_tags: DataFrame, question_flags: DataFrame) -> DataFrame:
    """Each (question, tag) pair with the flags of the question."""
    return question_tags.join(question_flags, "question_id", "inner")


def as_int(flag: Column) -> Column:
    return flag.cast("int")


def negated_int(flag: Column) -> Column:
    return (~flag).cast("int")


def topic_counts(tagged: DataFrame, min_questions: int) -> DataFrame:
    """``topic, n_total`` and the number of flagged questions per flag column.

    This one aggregate feeds all four topic tables. It is combined map-side, so a topic that
    holds a large part of all rows costs no more than another.
    """
    counts = [F.sum(as_int(F.col(c))).alias(c) for c in flag_columns(tagged)]
    grouped = tagged.groupBy(F.col("tag").alias("topic")).agg(F.count("*").alias("n_total"), *counts)
    return grouped.where(F.col("n_total") >= min_questions)


def _by_category(counts: DataFrame) -> DataFrame:
    categories = category_columns(counts)
    long = counts.unpivot(["topic", "n_total"], categories, "category", "n_miscomm")
    return long.withColumn("category", F.substr("category", F.lit(len(CATEGORY_PREFIX) + 1)))


def _rate() -> Column:
    return F.try_divide(F.col("n_miscomm"), F.col("n_total")).alias("miscomm_rate")


def rate_per_topic(counts: DataFrame) -> DataFrame:
    rates = counts.withColumnRenamed(HAS_MISCOMM, "n_miscomm").select(
        "topic", F.col("n_total").alias("n_questions"), "n_miscomm", _rate()
    )
    return rates.orderBy(F.desc("miscomm_rate"), "topic")


def rate_per_topic_category(counts: DataFrame) -> DataFrame:
    return _by_category(counts).select(
        "topic", "category", F.col("n_total").alias("n_questions"), "n_miscomm", _rate()
    )


def contingency_per_topic(counts: DataFrame) -> DataFrame:
    split = counts.select(
        "topic",
        F.col(HAS_MISCOMM).alias("n_miscomm"),
        (F.col("n_total") - F.col(HAS_MISCOMM)).alias("n_no_miscomm"),
        "n_total",
    )
    return split.orderBy(F.desc("n_total"), "topic")


def contingency_per_topic_category(counts: DataFrame) -> DataFrame:
    return _by_category(counts).select(
        "topic", "category", "n_miscomm", (F.col("n_total") - F.col("n_miscomm")).alias("n_no_miscomm"), "n_total"
    )


def flag_totals(question_flags: DataFrame) -> DataFrame:
    """One row: number of questions and of flagged questions per flag column."""
    return question_flags.agg(
        F.count("*").alias("total_questions"), *[F.count_if(F.col(c)).alias(c) for c in flag_columns(question_flags)]
    )


def global_rate(question_flags: DataFrame) -> DataFrame:
    """``total_questions, total_miscomm, global_miscomm_rate`` in one row."""
    return question_flags.agg(
        F.count("*").alias("total_questions"), F.count_if(HAS_MISCOMM).alias("total_miscomm")
    ).withColumn("global_miscomm_rate", F.try_divide("total_miscomm", "total_questions"))


def global_summary(question_flags: DataFrame, posts: DataFrame, comments: DataFrame, tags: DataFrame) -> DataFrame:
    """The overall rate beside the sizes of the base tables (each counted on its own)."""
    answers = posts.where(F.col("PostTypeId") == ANSWER)
    return global_rate(question_flags).select(
        "total_questions",
        answers.agg(F.count("*")).scalar().alias("total_answers"),
        comments.agg(F.count("*")).scalar().alias("total_comments"),
        tags.agg(F.count("*")).scalar().alias("total_tags"),
        "total_miscomm",
        "global_miscomm_rate",
    )


def global_rate_per_category(question_flags: DataFrame) -> DataFrame:
    totals = flag_totals(question_flags)
    long = totals.unpivot(["total_questions"], category_columns(totals), "category", "total_miscomm")
    return long.select(
        F.substr("category", F.lit(len(CATEGORY_PREFIX) + 1)).alias("category"),
        "total_questions",
        "total_miscomm",
        F.try_divide("total_miscomm", "total_questions").alias("global_miscomm_rate"),
    )


def by_category_order(rows: DataFrame, *then: Column | str) -> DataFrame:
    """Category by category in the lexicon's order, then as given. For reports, whose rows are few."""
    order = F.array_position(F.array(*[F.lit(name) for name in PHRASES]), F.col("category"))
    return rows.orderBy(order, *then)
