"""The chain of derived tables, from the base tables to the topic aggregates."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame

from forum_signals.operators import flags, model, rates, topics
from forum_signals.session import scratch_path
from forum_signals.settings import DEFAULTS, AnalysisSettings
from forum_signals.sources.tables import write_table


@dataclass
class Forum:
    """Lazy frames over the three base tables; nothing runs until a result is asked for."""

    posts: DataFrame
    comments: DataFrame
    tags: DataFrame
    settings: AnalysisSettings = DEFAULTS

    @cached_property
    def questions(self) -> DataFrame:
        return model.questions(self.posts)

    @cached_property
    def answers(self) -> DataFrame:
        return model.answers(self.posts)

    @cached_property
    def comments_enriched(self) -> DataFrame:
        return model.comments_enriched(self.comments, self.posts)

    @cached_property
    def answers_flagged(self) -> DataFrame:
        return flags.flag_answers(self.answers)

    @cached_property
    def comments_flagged(self) -> DataFrame:
        return flags.flag_comments_of(self.comments, self.posts)

    @cached_property
    def question_miscomm(self) -> DataFrame:
        return flags.question_miscomm_of(self.posts, self.comments, self.answers)

    @cached_property
    def all_question_tags(self) -> DataFrame:
        return topics.explode_tags(self.questions)

    @cached_property
    def question_tags(self) -> DataFrame:
        return topics.keep_top_tags(self.all_question_tags, self.settings.top_n)

    @cached_property
    def topic_counts(self) -> DataFrame:
        tagged = rates.tagged_flags(self.question_tags, self.question_miscomm)
        return rates.topic_counts(tagged, self.settings.min_questions)

    def stored(self) -> Forum:
        """The same forum with its question flags written to the shared folder.

        For results that use the flags more than once: the texts are matched a single time.
        """
        kept = Forum(self.posts, self.comments, self.tags, self.settings)
        path = scratch_path(self.posts.sparkSession, "question_miscomm")
        kept.__dict__["question_miscomm"] = write_table(self.question_miscomm, path)
        return kept
