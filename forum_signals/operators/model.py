"""The forum model: questions, answers, and comments linked to their root question."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Post types of the dump format.
QUESTION = 1
ANSWER = 2


def questions(posts: DataFrame) -> DataFrame:
    return posts.where(F.col("PostTypeId") == QUESTION).select(
        F.col("Id").alias("question_id"),
        F.col("Title").alias("title"),
        F.col("Tags").alias("raw_tags"),
        F.col("Body").alias("body"),
        F.col("CreationDate").alias("created_at"),
        F.col("Score").alias("score"),
        F.col("AnswerCount").alias("answer_count"),
        F.col("ViewCount").alias("view_count"),
    )


def answers(posts: DataFrame) -> DataFrame:
    return posts.where(F.col("PostTypeId") == ANSWER).select(
        F.col("Id").alias("answer_id"),
        F.col("ParentId").alias("question_id"),
        F.col("Body").alias("body"),
        F.col("CreationDate").alias("created_at"),
        F.col("Score").alias("score"),
    )


def root_question(post_type: Column, own_id: Column, parent_id: Column) -> Column:
    """The question a post belongs to; NULL for other kinds of posts."""
    return F.when(post_type == QUESTION, own_id).when(post_type == ANSWER, parent_id)


def post_roots(posts: DataFrame) -> DataFrame:
    """``post_id, root_id``: the narrow side that comments are joined with."""
    return posts.select(
        F.col("Id").alias("post_id"),
        root_question(F.col("PostTypeId"), F.col("Id"), F.col("ParentId")).alias("question_id"),
    )


def comments_enriched(comments: DataFrame, posts: DataFrame) -> DataFrame:
    """Every comment on a known post, with its root question (NULL on other post types).

    A post with very many comments makes its join partition large; Spark's adaptive skew
    join splits it, since the post side is one narrow row.
    """
    commented = comments.select(
        F.col("Id").alias("comment_id"),
        F.col("PostId").alias("post_id"),
        F.col("Text").alias("text"),
        F.col("CreationDate").alias("created_at"),
        F.col("Score").alias("score"),
    )
    linked = commented.join(post_roots(posts), "post_id", "inner")
    return linked.select("comment_id", "post_id", "question_id", "text", "created_at", "score")


def linkable_roots(posts: DataFrame) -> DataFrame:
    """Only the posts that lead to a question; the type filter prunes the other partitions."""
    return with_root_question(post_roots(posts.where(F.col("PostTypeId").isin(QUESTION, ANSWER))))


def with_root_question(comments: DataFrame) -> DataFrame:
    return comments.where(F.col("question_id").isNotNull())
