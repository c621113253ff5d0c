"""Reproducible random samples of titles per tag, drawn for all tags in one job.

A draw keeps the rows with the smallest seeded hashes, which is a uniform sample without
replacement that any engine can repeat.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from forum_signals.sources.tables import write_table

#: (sample size, run, tag, question id) to the text whose order decides a draw.
DrawKey = Callable[[Column, Column, Column, Column], Column]

#: How much further a draw that came up short looks on its next try.
WIDER = 16


def titled(questions: DataFrame) -> DataFrame:
    return questions.where(F.col("title").isNotNull())


def tags_with_titles(question_tags: DataFrame, questions: DataFrame) -> DataFrame:
    """Each (question, tag) pair with the question's title; questions without one are left out."""
    titles = titled(questions).select("question_id", "title")
    return question_tags.select("question_id", "tag").join(titles, "question_id").select("question_id", "tag", "title")


def add_titles(sample: DataFrame, questions: DataFrame) -> DataFrame:
    """Titles of sampled questions, without those that have none. Spark measures the stored sample and broadcasts it if small."""
    return titled(questions).select("question_id", "title").join(sample, "question_id", "inner")


def with_draws(tags: DataFrame, draws: Sequence[tuple[int, int]]) -> DataFrame:
    """Every row of ``tags`` once per draw, a (sample size, run) pair."""
    pairs = [F.struct(F.lit(size).alias("sample_size"), F.lit(run).alias("run")) for size, run in draws]
    return tags.select("*", F.inline(F.array(*pairs)))


def draw_key(seed: str, *parts: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(seed), *[p.cast("string") for p in parts]))


def margin(n: int) -> int:
    """More than a count that varies like a random draw of n will ever need."""
    return n + 8 * math.isqrt(n) + 32


def entering(pairs: DataFrame, tries: DataFrame, key: DrawKey) -> DataFrame:
    """``tag, sample_size, run, question_id, draw`` of the pairs whose key is small enough for a draw.

    ``tries`` has per tag the draws still wanted, as an array of (sample_size, run, share): a pair enters a draw
    if its key is in the lowest ``share`` of all keys. The test runs inside the array, so a pair
    becomes rows only for the draws it enters, about margin(sample_size) of them per tag and draw.
    """

    def enter(draw: Column) -> Column:
        value = key(draw["sample_size"], draw["run"], F.col("tag"), F.col("question_id"))
        return F.struct(draw["sample_size"].alias("sample_size"), draw["run"].alias("run"), draw["share"].alias("share"), value.alias("draw"))

    def small(draw: Column) -> Column:
        return F.conv(F.substr(draw["draw"], F.lit(1), F.lit(8)), 16, 10).cast("double") / float(16**8) < draw["share"]

    found = pairs.join(tries, "tag").select("tag", "question_id", F.filter(F.transform("draws", enter), small).alias("draws"))
    return found.select("tag", "question_id", F.inline("draws")).drop("share")


def draw_titles(
    question_tags: DataFrame, questions: DataFrame, tags: DataFrame, draws: Sequence[tuple[int, int]], key: DrawKey, folder: str
) -> DataFrame:
    """``tag, sample_size, run, question_id, title``: for each draw the titles with the smallest keys.

    ``tags`` holds ``tag, n_questions`` of the tags to sample. A pair takes part in a draw only if
    its key is below a share of the key space that lets about margin(size) pairs of the tag in; pairs
    without a title then drop out, and the rest, a few hundred rows whatever the tag's size, are
    ranked. A draw that has too few titles left (most are missing, or unlucky keys) is tried again with a
    share WIDER times as large, until it is full or all of the tag has taken part, so the
    result is that of ranking everything. A wider try again lets in about as many titled pairs as are
    needed, since the narrower one showed how rare they are.

    Runs one job per try. Tables are written below ``folder``, which the caller owns and clears.
    """
    spark = question_tags.sparkSession
    group = ["tag", "sample_size", "run"]
    tries = write_table(_first_tries(tags, draws), f"{folder}/tries-0")
    drawn, number = None, 0
    while True:
        number += 1
        candidates = entering(question_tags, tries, key)
        found = write_table(add_titles(candidates, questions), f"{folder}/candidates-{number}")
        place = F.row_number().over(Window.partitionBy(*group).orderBy("draw", "question_id"))
        counted = found.groupBy(*group).agg(F.count("*").alias("n_found"))
        wanted = tries.select("tag", F.inline("draws")).join(counted, group, "left")
        full = (F.coalesce("n_found", F.lit(0)) >= F.col("sample_size")) | (F.col("share") >= 1)
        state = write_table(wanted.select(*group, "share", full.alias("full")), f"{folder}/state-{number}")
        done = found.join(state.where("full").select(*group), group, "left_semi").withColumn("_rank", place)
        part = done.where("_rank <= sample_size").select(*group, "question_id", "title")
        drawn = part if drawn is None else drawn.unionByName(part)
        short = state.where("NOT full")
        if short.isEmpty():
            return write_table(drawn, f"{folder}/drawn")
        again = F.struct("sample_size", "run", F.least(F.lit(1.0), F.col("share") * WIDER).alias("share"))
        tries = write_table(short.groupBy("tag").agg(F.collect_list(again).alias("draws")), f"{folder}/tries-{number}")


def _first_tries(tags: DataFrame, draws: Sequence[tuple[int, int]]) -> DataFrame:
    """(tag, draws) with the share of keys that lets about margin(size) of the tag's pairs in."""

    def share(size: int) -> Column:
        return F.least(F.lit(1.0), F.lit(float(margin(size))) / F.greatest(F.col("n_questions"), F.lit(1)))

    wanted = [
        F.struct(F.lit(size).alias("sample_size"), F.lit(run).alias("run"), share(size).alias("share")) for size, run in draws
    ]
    return tags.select("tag", F.array(*wanted).alias("draws"))


def sample_titles(question_tags: DataFrame, questions: DataFrame, tags: DataFrame, n: int, seed: str, folder: str) -> DataFrame:
    """``tag, question_id, title``: at most n random titles for each of ``tags``."""

    def key(size: Column, run: Column, tag: Column, question: Column) -> Column:
        return draw_key(seed, tag, question)

    return draw_titles(question_tags, questions, tags, [(n, 1)], key, folder).select("tag", "question_id", "title")


def repeated_samples(
    question_tags: DataFrame, questions: DataFrame, tags: DataFrame, sizes: Sequence[int], runs: int, seed: str, folder: str
) -> DataFrame:
    """``tag, sample_size, run, title``: independent draws for each size and run."""

    def key(size: Column, run: Column, tag: Column, question: Column) -> Column:
        return draw_key(seed, size, run, tag, question)

    sampled = draw_titles(question_tags, questions, tags, all_draws(sizes, runs), key, folder)
    return sampled.select("tag", "sample_size", "run", "title")


def all_draws(sizes: Sequence[int], runs: int) -> list[tuple[int, int]]:
    return [(size, run) for size in sizes for run in range(1, runs + 1)]
