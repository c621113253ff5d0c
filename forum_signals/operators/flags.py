"""Miscommunication flags per answer, per comment and per question."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forum_signals.functions.lexicon import CATEGORY_PREFIX
from forum_signals.functions.matching import HAS_MISCOMM, flag_columns, with_flags
from forum_signals.functions.text import html_to_text
from forum_signals.operators.model import linkable_roots, with_root_question


def flag_answers(answers: DataFrame) -> DataFrame:
    """Flags of the prose of each answer."""
    return with_flags(answers, html_to_text(F.col("body")), ["answer_id", "question_id"])


def flag_comments(comments: DataFrame) -> DataFrame:
    """Flags of the raw text of each linked comment (see ``model.comments_enriched``)."""
    return with_flags(with_root_question(comments), F.col("text"), ["comment_id", "question_id"])


def flag_comments_of(comments: DataFrame, posts: DataFrame) -> DataFrame:
    """The same rows from base tables, matched before the join so that no text is shuffled."""
    raw = comments.select(F.col("Id").alias("comment_id"), F.col("PostId").alias("post_id"), F.col("Text").alias("text"))
    flagged = with_flags(raw.where(F.col("post_id").isNotNull()), F.col("text"), ["comment_id", "post_id"])
    linked = flagged.join(linkable_roots(posts), "post_id", "inner")
    return linked.select("comment_id", "question_id", *flag_columns(flagged))


def union_flags(answers_flagged: DataFrame, comments_flagged: DataFrame) -> DataFrame:
    """All flagged texts with their question, keeping every row."""
    columns = ["question_id", *flag_columns(answers_flagged)]
    return answers_flagged.select(*columns).unionByName(comments_flagged.select(*columns))


def any_flag_per(flagged: DataFrame, key: str) -> DataFrame:
    """OR of all flags per key; map-side partial aggregation absorbs hot keys."""
    return flagged.groupBy(key).agg(*[F.bool_or(c).alias(c) for c in flag_columns(flagged)])


def question_miscomm(answers_flagged: DataFrame, comments_flagged: DataFrame) -> DataFrame:
    """One row per question that has an answer or comment, with the OR of their flags."""
    return any_flag_per(union_flags(answers_flagged, comments_flagged), "question_id")


def question_miscomm_of(posts: DataFrame, comments: DataFrame, answers: DataFrame) -> DataFrame:
    """The same from base tables, in the order that moves least data.

    Texts are matched where they are read. Comment flags are reduced to one row per post
    before they meet the posts, so neither texts nor hot posts are shuffled.
    """
    raw = comments.select(F.col("PostId").alias("post_id"), F.col("Text").alias("text"))
    per_post = any_flag_per(
        with_flags(raw.where(F.col("post_id").isNotNull()), F.col("text"), ["post_id"]), "post_id"
    )
    per_comment_question = per_post.join(linkable_roots(posts), "post_id", "inner")
    return question_miscomm(flag_answers(answers), per_comment_question)


def flag_prevalence(question_flags: DataFrame) -> DataFrame:
    """``signal, n_questions, n_flagged, pct``: overall and per category, from one scan."""
    columns = flag_columns(question_flags)
    totals = question_flags.agg(
        F.count("*").alias("n_questions"), *[F.count_if(F.col(c)).alias(c) for c in columns]
    )
    long = totals.unpivot(["n_questions"], columns, "signal", "n_flagged")
    return long.select(
        F.regexp_replace("signal", f"^{CATEGORY_PREFIX}", "").alias("signal"),
        "n_questions",
        "n_flagged",
        F.try_divide(F.col("n_flagged") * 100.0, F.col("n_questions")).alias("pct"),
    )


def flagged_only(flagged: DataFrame, column: str = HAS_MISCOMM) -> DataFrame:
    return flagged.where(F.col(column))


